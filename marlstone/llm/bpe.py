"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The vocabulary comes from a tokenizer file whose path is a parameter; the driver reads it (its size is fixed) and broadcasts
arrays. In a task, the words of many texts that are not yet known lie in one flat array of symbols. Each round looks all
neighbouring pairs up by binary search in the sorted pair keys, takes each word's lowest-ranked pair and merges all its
occurrences, left to right. Words without a mergeable pair are done.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import release, slices

#: How byte-level BPE splits a text into words before merging (fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
KNOWN_WORDS = 100_000


def byte_symbols() -> list[str]:
    """The character that the vocabulary writes for each byte: printable Latin-1 ones stand for themselves, the others for those from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE tokenizer file: first ids of bytes, sorted pair keys with their ranks and results, bytes of each id, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    odd = [k for k, on in (("normalizer", spec.get("normalizer")), ("add_prefix_space", (spec.get("pre_tokenizer") or {}).get("add_prefix_space")), ("ignore_merges", spec["model"].get("ignore_merges"))) if on]
    odd += [k for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word") if t.get(k)]
    if odd:
        raise ValueError(f"the tokenizer file asks for what is not supported: {sorted(set(odd))}")
    vocab = spec["model"]["vocab"]
    symbols = byte_symbols()
    to_byte = {c: b for b, c in enumerate(symbols)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    keys = (left << 32) | right
    order = np.argsort(keys, kind="stable")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    top = max([*vocab.values(), *special.values()]) + 1
    pieces = [b""] * top
    for token, i in vocab.items():
        pieces[i] = bytes(to_byte[c] for c in token)
    for token, i in special.items():
        pieces[i] = token.encode()
    return {
        "bytes": np.array([vocab[c] for c in symbols], np.int64), "keys": keys[order], "ranks": order.astype(np.int32), "made": made[order].astype(np.int32),
        "special": special, "lengths": np.array([len(p) for p in pieces], np.int64), "pieces": np.frombuffer(b"".join(pieces), np.uint8),
    }


def merge_words(words: list[str], v: dict) -> list[tuple[int, ...]]:
    """Ids of each word, by rounds over one flat array of all words' symbols.

    rank holds, for each symbol, the rank of its pair with the next one of its word. A round finds each word's least rank, merges all pairs of
    that rank and looks up only the pairs that a merge has made.
    """
    data = [w.encode() for w in words]
    sizes = np.array([len(b) for b in data], np.int64)
    sym = v["bytes"][np.frombuffer(b"".join(data), np.uint8)].astype(np.int32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    keys, ranks, made = v["keys"], v["ranks"], v["made"]
    rank, at = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int32)

    def look(i: np.ndarray) -> None:
        key = (sym[i].astype(np.int64) << 32) | sym[i + 1]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank[i] = np.where(keys[found] == key, ranks[found], NO_RANK)
        at[i] = found

    look(np.flatnonzero(word[1:] == word[:-1]))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, first)
        span = np.diff(first, append=len(sym))
        live = best != NO_RANK
        if 2 * np.count_nonzero(live) < len(live):  # words without a pair to merge are set aside
            open_ = np.repeat(live, span)
            done.append((word[~open_], sym[~open_]))
            sym, word, rank, at = sym[open_], word[open_], rank[open_], at[open_]
            continue
        m = np.flatnonzero((rank == np.repeat(best, span)) & (rank != NO_RANK))
        # a run of one symbol ("aaa") offers overlapping pairs: every second of neighbours is merged
        begins = np.diff(m, prepend=-2) != 1
        nth = np.arange(len(m))
        m = m[(nth - np.maximum.accumulate(np.where(begins, nth, 0))) % 2 == 0]
        sym[m] = made[at[m]]
        keep = np.ones(len(sym), bool)
        keep[m + 1] = False
        sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
        m -= np.arange(len(m))
        i = np.concatenate([m, m[m > 0] - 1])
        inside = i + 1 < len(word)
        inside[inside] = word[i[inside] + 1] == word[i[inside]]
        rank[i[~inside]] = NO_RANK
        look(i[inside])
    if not done:
        return [()] * len(words)
    word = np.concatenate([w for w, _ in done])
    order = np.argsort(word, kind="stable")
    ids = np.concatenate([s for _, s in done])[order].tolist()
    ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
    return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes texts with one vocabulary; keeps the ids of up to KNOWN_WORDS words."""

    def __init__(self, v: dict):
        self.v, self.known = v, {}
        self.words = regex.compile(PATTERN)
        longest = sorted(v["special"], key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def split(self, text: str) -> list[str]:
        """Words of a text. A special string in it is a word of its own, as the tokenizers library treats it."""
        if self.special is None or not any(s in text for s in self.v["special"]):
            return self.words.findall(text)
        return [w for part in self.special.split(text) for w in ([part] if part in self.v["special"] else self.words.findall(part))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; all texts' new words are merged together."""
        split = [self.split(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if len(self.known) + len(new) > KNOWN_WORDS:
            new = list(set(chain.from_iterable(split)))
            self.known = {}
        plain = [w for w in new if w not in self.v["special"]]
        self.known.update(zip(plain, merge_words(plain, self.v), strict=True))
        self.known.update({w: (self.v["special"][w],) for w in new if w in self.v["special"]})
        get = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, words)), np.int32) for words in split]


def decode_ids(lists: list, v: dict) -> list[str]:
    """Texts of lists of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)
    sizes = v["lengths"][flat]
    offset = np.cumsum(v["lengths"]) - v["lengths"]
    ends = np.cumsum(sizes)
    data = v["pieces"][np.repeat(offset[flat] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)] if lists else [0]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


def encode(spark: SparkSession, path: str, text: Column) -> Column:
    """Ids of whole texts as array<int>; null and empty texts have none."""
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for texts in batches:
            yield pa.concat_arrays([lists_of(encoder.encode(p.to_pylist())) for p in slices(texts)] or [lists_of([])])
        release()

    return run(text)


def decode(spark: SparkSession, path: str, ids: Column) -> Column:
    """Texts of ids: the exact inverse of encode for whole texts. Null ids give an empty text."""
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out: list[str] = []
            for lo in range(0, len(lists), 256):  # bounds the index arrays, which are eight times as large as the text
                out.extend(decode_ids([x or () for x in lists.slice(lo, 256).to_pylist()], shared.value))
            yield pa.array(out, pa.string())

    return run(ids)


def encode_and_decode(spark: SparkSession, path: str, text: Column) -> Column:
    """struct(ids, decoded): the ids, and the text decoded from them, in one pass of one Python worker."""
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    @F.arrow_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for texts in batches:
            ids, back = [lists_of([])], [pa.array([], pa.string())]
            for p in slices(texts):
                lists = encoder.encode(p.to_pylist())
                ids.append(lists_of(lists))
                back.append(pa.array(decode_ids(lists, shared.value), pa.string()))
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(back)], names=["ids", "decoded"])
        release()

    return run(text)

"""Language identification by hyperdimensional profiles.

Each letter owns a random vector of +1 and -1, made from its code point and a seed. A trigram inside a
word (a space marks the word's ends) binds its letters: the first rotated by two, the second by one, the third
as it is, multiplied component by component. A text is the bundle (sum) of its trigrams, a language the bundle of its texts'
unit vectors; a text gets the language whose prototype has the largest cosine.

Only prototypes (languages x dimensions numbers, summed by Spark) reach the driver. Scoring moves no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, free_names, mix64, release, slices
from .shingles import SPACE, code_points, fold_table

UNDETERMINED = "und"
#: A longer text is read in pieces of about so many characters, cut where a word ends.
PIECE = 1 << 19
#: Texts are bundled together up to so many characters.
GROUP_CHARS, GROUP_TEXTS = 1 << 19, 256
#: Cells of a table over all trigrams of a group's letters; with more of them the trigrams are sorted instead.
TABLE = 1 << 21


def letter_vectors(letters: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    with np.errstate(over="ignore"):
        start = mix64(letters.astype(np.uint64) * GOLDEN + np.uint64(seed))
        words = mix64(start[:, None] + np.arange(1, dims // 64 + 1, dtype=np.uint64)[None, :] * GOLDEN)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def bundle(texts: list[str], dims: int, seed: int) -> np.ndarray:
    """A row for each text: the sum of its trigram vectors (all zero for a text without letters)."""
    n = len(texts)
    out = np.zeros((n, dims), np.float32)
    joined = " " + " ".join(texts) + " "
    s = fold_table("letter")[code_points(joined)]
    owner = np.repeat(np.arange(n), [len(t) + 1 for t in texts])
    owner = np.concatenate([owner[:1], owner, owner[-1:]])[: len(s)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
    s, owner = s[keep], owner[keep]
    if len(s) < 3:
        return out
    seen = np.zeros(0x110000, bool)
    seen[s] = True
    letters = np.flatnonzero(seen)
    rank = np.zeros(0x110000, np.int32)
    rank[letters] = np.arange(len(letters))
    code, a = rank[s].astype(np.int64), len(letters)
    middle = np.flatnonzero(s[1:-1] != SPACE)
    key = (code[middle] * a + code[middle + 1]) * a + code[middle + 2]
    if not len(key):
        return out
    if a**3 <= TABLE:
        grams = np.flatnonzero(np.bincount(key, minlength=a**3))
        place = np.zeros(a**3, np.int32)
        place[grams] = np.arange(len(grams))
        index = place[key]
    else:
        grams, index = np.unique(key, return_inverse=True)
    base = letter_vectors(letters, dims, seed)
    base[letters == SPACE] = 1.0  # a word's end binds as the neutral vector, at its own place in the key
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    who = owner[middle + 1]
    for lo in range(0, len(grams), 4096):  # bounds the gram matrix, however many scripts meet in a batch
        g = grams[lo : lo + 4096]
        sel = slice(None) if len(grams) <= 4096 else (index >= lo) & (index < lo + 4096)
        counts = np.bincount(who[sel] * len(g) + (index[sel] - lo), minlength=n * len(g)).reshape(n, len(g)).astype(np.float32)
        out += counts @ (first[g // (a * a)] * second[g // a % a] * base[g % a])
    return out


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters. They end where a letter follows no letter, so the trigrams of the pieces are those of the text."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        while hi < len(text) and text[hi].isalpha():
            hi += 1
        yield text[lo:hi]
        lo = hi


def bundles(texts: list[str | None], dims: int, seed: int) -> np.ndarray:
    """Vectors of whole texts, however long: a long one is read in pieces, whose vectors add up."""
    out = np.zeros((len(texts), dims), np.float32)
    group: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            np.add.at(out, owner, bundle(group, dims, seed))
            group.clear()
            owner.clear()
            size = 0

    for i, t in enumerate(texts):
        for piece in pieces(t or ""):
            if group and (size + len(piece) > GROUP_CHARS or len(group) >= GROUP_TEXTS):
                flush()
            group.append(piece)
            owner.append(i)
            size += len(piece)
    flush()
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm == 0, 1, norm)


def fit_profiles(
    labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", rows_per_lang: int = 4000, dims: int = 512, seed: int = 7
) -> dict:
    """Prototypes from rows with a language and a text.

    About rows_per_lang rows of each language are used, chosen by a hash of `order`: the documented bound of this fit.
    Rows with a null language or text do not count. No usable row gives a model that answers `und`.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(order)).alias("h")).where("l is not null and t is not null")
    sizes = rows.groupBy("l").count()
    chosen = rows.join(F.broadcast(sizes), "l").where(F.expr(f"pmod(h, 1000000) * 1e-6 * count < {rows_per_lang}")).select("t", "l")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            vectors = unit(bundles(pdf["t"].tolist(), dims, seed))
            for name, at in pdf.groupby("l").indices.items():
                sums[name] = sums.get(name, 0) + vectors[at].sum(axis=0, dtype=np.float64)
        yield pd.DataFrame({"l": list(sums), "v": [x.tolist() for x in sums.values()]}, dtype=object)
        release()

    parts = chosen.mapInPandas(partial, "l string, v array<double>").select("l", F.posexplode("v").alias("i", "v"))
    # floating sums in any order: rounded, so that reruns agree
    cells = parts.groupBy("l", "i").agg(F.round(F.sum("v"), 3).alias("v")).collect()
    langs = sorted({r["l"] for r in cells})
    prototypes = np.zeros((len(langs), dims), np.float32)
    for r in cells:
        prototypes[langs.index(r["l"]), r["i"]] = r["v"]
    return {"langs": langs, "prototypes": unit(prototypes), "dims": dims, "seed": seed}


def language(model: dict, text: Column) -> Column:
    """struct(lang string, score double): the best language and its cosine, cut to 0..1; `und` and 0 for texts that are null or have no letter."""
    langs, prototypes, dims, seed = (model[k] for k in ("langs", "prototypes", "dims", "seed"))

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*langs, UNDETERMINED], dtype=object)
        for texts in batches:
            best, score = [np.empty(0, np.int64)], [np.empty(0)]
            for part in slices(texts):
                vectors = bundles(part.to_pylist(), dims, seed)
                empty = ~vectors.any(axis=1) | (len(langs) == 0)
                cos = unit(vectors) @ prototypes.T if langs else np.zeros((len(vectors), 1), np.float32)
                top = cos.argmax(axis=1)
                best.append(np.where(empty, len(langs), top))
                score.append(np.where(empty, 0.0, np.clip(cos[np.arange(len(top)), top], 0, 1)).astype(float))
            yield pa.StructArray.from_arrays([pa.array(names[np.concatenate(best)].tolist(), pa.string()), pa.array(np.concatenate(score), pa.float64())], names=["lang", "score"])
        release()

    return predict(text)


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of those names that docs already has are replaced, all others stay as they are.

    A null text, an empty one and one without letters is `und` with score 0; texts of any length are read whole. Repeated rows get the same answer;
    ties go to the language first by code point. An empty table gives an empty table.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    (found,) = free_names(docs, "found")
    rows = docs.select(*kept, language(model, F.col(text)).alias(found))
    return rows.select(*kept, F.col(f"{found}.lang").alias("lang_pred"), F.col(f"{found}.score").alias("score"))

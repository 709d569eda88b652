"""Spelling variants: words one edit apart, found by walking all words at once through a trie that is a distributed table.

A trie over the words and one over the reversed words are kept as edges (node, label, child). Only nodes where words part count, so a label
may have several letters and a chain without forks is one edge. Two words one edit apart share the first half or the last half of their letters, so in
one of the two tries they part at a node in the lower half of their path. The frontier of states (word so far, rest of the word, node, edits)
starts there with no edit; its first join with the edges makes the edit, each further one follows the rest of the word exactly. A state
that ends where a word ends has found a neighbour. Every level is a join of two tables by node and is written before the next one starts.

Nodes are named by 64-bit hashes of their prefix, letter by letter, so a word of any length makes as many rows as it has letters in its lower half, none of
which carries more than a digest of a long word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, mix64, release, slices, written
from .shingles import _powers, code_points

#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Words of more code points go by their digest where only their identity matters.
LONG = 64
END = 63


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, typo_modulus: int = 31) -> DataFrame:
    """word, n of the maximal runs of Latin letters in whole texts, A-Z lower-cased, of at least least_length code points and least_count occurrences.

    A run whose h (crc32 of `<key>:<run>`) typo_modulus divides loses its code point h modulo its length first (0: none does). Null and empty texts have no
    words, a null key counts as empty; repeated rows count as often as they come. An empty table gives an empty table.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
            words.clear()
            return out

        for batch in batches:
            lo = 0
            for part in slices(batch.column(1)):
                for k, t in zip(batch.column(0).slice(lo, len(part)).to_pylist(), part.to_pylist(), strict=True):
                    if not t:
                        continue
                    seed = zlib.crc32(f"{k or ''}:".encode())
                    # lower() of bytes touches A-Z only
                    for w, n in Counter(run.findall(t.encode().lower().decode())).items():
                        if typo_modulus and not (h := zlib.crc32(w.encode(), seed)) % typo_modulus:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        words[w] += n
                    if len(words) > HELD:
                        yield given()
                lo += len(part)
        yield given()
        release()

    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    sums = rows.mapInArrow(count, "word string, n long").where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= least_count)


def _paths(words: DataFrame) -> DataFrame:
    """side, node, depth, letter, word_key: the nodes on the lower half of each word's path, forwards (side 0) and backwards (1), with the letter that follows (0: the word ends)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for part in slices(batch.column(1), 1 << 18):
                keys = batch.column(0).slice(lo, len(part))
                lo += len(part)
                texts = part.to_pylist()
                size = np.array([len(t) for t in texts], np.int64)
                begin = np.cumsum(size) - size
                up, _ = _powers(int(size.max(initial=0)) + 1)
                for side in (0, 1):
                    s = code_points("".join(texts) if side == 0 else "".join([t[::-1] for t in texts]))
                    with np.errstate(over="ignore"):
                        place = np.arange(len(s)) - np.repeat(begin, size)
                        run = np.concatenate([[np.uint64(0)], np.cumsum((s.astype(np.uint64) + np.uint64(1)) * up[place], dtype=np.uint64)])
                        first = (size - 1) // 2 if side == 0 else size // 2
                        n = size - first + 1
                        of = np.repeat(np.arange(len(texts)), n)
                        depth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - first, n)
                        at = begin[of] + depth
                        node = mix64(run[at] - run[begin[of]] + (depth.astype(np.uint64) * np.uint64(2) + np.uint64(side)) * GOLDEN)
                    letter = np.where(depth < size[of], np.append(s, 0)[at], 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(of), side, np.int32)), pa.array(node.view(np.int64)), pa.array(depth.astype(np.int32)), pa.array(letter.astype(np.int32)), keys.take(pa.array(of))],
                        names=["side", "node", "depth", "letter", "word_key"],
                    )
        release()

    return words.select("word_key", "word").mapInArrow(walk, "side int, node long, depth int, letter int, word_key string")


def _bit(letter: Column) -> Column:
    """A bit for the first letter of a string, or for the end if it is empty."""
    return F.expr("shiftleft(1L, cast(case when {0} = '' then 63 else pmod(ascii({0}), 63) end as int))".format(letter))


def _tries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words in both directions with the forks on their path (side, word, n, forks), and the edges (node, label, child, m, ahead): m is the count of the word that ends with the edge, ahead the letters that may follow it."""
    identified = words.select("word", "n", F.when(F.length("word") > LONG, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word")).alias("word_key"))
    paths = written(_paths(identified), "trie-paths")
    forks = paths.groupBy("node").agg(F.min("letter").alias("least"), F.max("letter").alias("most")).where("least < most").select("node")
    held = paths.join(forks, "node", "left_semi")
    # as many forks as a word has letters, at most
    by_word = held.groupBy("word_key", "side").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("forks"))
    tries = identified.join(by_word, "word_key").select("side", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("word"), "n", "forks")
    tries = written(tries, "tries")
    legs = tries.select("word", "n", "forks", F.posexplode("forks").alias("i", "fork"))
    after = F.expr("get(forks, i + 1)")
    label = F.expr("substring(word, fork.depth + 1, coalesce(get(forks, i + 1).depth, length(word)) - fork.depth)")
    edges = legs.select(F.col("fork.node").alias("node"), label.alias("label"), after["node"].alias("child"), F.when(after.isNull(), F.col("n")).alias("m")).distinct()
    edges = written(edges, "trie-edges")
    ahead = edges.groupBy(F.col("node").alias("child")).agg(F.bit_or(_bit("label")).alias("ahead"))
    # edges that end a word, a large share, have no child to look for
    inner = edges.where("child is not null").join(ahead, "child").select("node", "label", "child", "m", "ahead")
    last = edges.where("child is null").select("node", "label", "child", "m", F.lit(0).cast("long").alias("ahead"))
    return tries, written(inner.unionByName(last), "trie-edges-ahead")


def _step(frontier: DataFrame, edges: DataFrame, edit: bool) -> DataFrame:
    """One level: each state with each edge of its node that it may follow. edit: the first letter of the label is put in place of the word's next letter, or before it."""
    both = frontier.join(edges, "node")
    after = "substring(rest, {} + 1)"
    fits = "case when child is null then {0} = '' else shiftright(ahead, cast(case when {0} = '' then 63 else pmod(ascii({0}), 63) end as int)) & 1 = 1 end"
    if edit:
        put = after.format("length(label)"), "label > '' and rest > '' and left(label, 1) > left(rest, 1) and startswith(substring(rest, 2), substring(label, 2))"
        add = after.format("length(label) - 1"), "label > '' and left(label, 1) <> left(rest, 1) and startswith(rest, substring(label, 2))"
        ways = F.array(*[F.expr(f"case when {ok} and {fits.format(rest)} then {rest} end") for rest, ok in (put, add)])
        both = both.withColumn("rests", F.filter(ways, lambda x: x.isNotNull())).where(F.size("rests") > 0).withColumn("left_over", F.explode("rests"))
    else:
        rest = after.format("length(label)")
        both = both.where(F.expr(f"startswith(rest, label) and (label > '' or rest = '') and {fits.format(rest)}")).withColumn("left_over", F.expr(rest))
    return both.select("side", "word", "n", F.concat("found", "label").alias("found"), F.col("left_over").alias("rest"), F.col("child").alias("node"), "m")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, m of all pairs of words(word, n) that differ by one inserted, deleted or replaced code point; each pair once, the shorter or smaller word first or last.

    Words must be distinct and not null, of at least three code points. Equal words are no pair. An empty table gives an empty table.
    """
    tries, edges = _tries(words)
    fork = F.col("fork")
    lower = F.when(F.col("side") == 0, F.floor(F.length("word") / 2)).otherwise(F.ceil(F.length("word") / 2))
    legs = tries.select("side", "word", "n", F.explode("forks").alias("fork")).where(fork["depth"] >= lower)
    frontier = legs.select("side", "word", "n", F.expr("left(word, fork.depth)").alias("found"), F.expr("substring(word, fork.depth + 1)").alias("rest"), fork["node"].alias("node"))
    ended, level = [], 0
    while True:
        states = written(_step(frontier, edges, edit=level == 0), "trie-frontier")
        ended.append(states.where("node is null"))
        frontier = states.where("node is not null").drop("m")
        level += 1
        if frontier.isEmpty():
            break
    pairs = ended[0]
    for e in ended[1:]:
        pairs = pairs.unionByName(e)
    way = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = pairs.select("side", way("word").alias("word"), "n", way("found").alias("near"), "m")
    # words that share their first half are the forward trie's, all others the backward one's
    shares = F.expr("left(word, length(word) div 2) = left(near, length(word) div 2)")
    return pairs.where(shares == (F.col("side") == 0)).drop("side")


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words(word, n).

    form: the near word of largest n (ties: the smallest in code-point order), if that n is at least factor times the word's, else null. root: where the
    forms lead in the end, the word itself if it has none. n_near: near words; form_n: the form's n. An empty table gives an empty table.
    """
    words = written(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    either = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("m").alias("n"), F.col("word").alias("near"), F.col("n").alias("m")))
    # strings compare by their UTF-8 bytes, which is code-point order
    best = either.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    fit = -F.col("best.less") >= factor * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fit, F.col("best.near")).alias("form"), F.when(fit, -F.col("best.less")).alias("form_n"))
    formed = written(formed, "forms")
    # a form is at least factor times as frequent, so chains are short; each round doubles what a pointer skips
    jumps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = written(jumps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not jumps.where("moved").isEmpty()
        jumps = jumps.drop("moved")
        if not moved:
            break
    return formed.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

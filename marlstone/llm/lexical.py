"""Ranked lexical search by inner products of impact vectors, in buckets of vector length.

Each document is a vector over the terms of the items: in integers, what a term's occurrences count for in a text of that length. An item is a vector of term weights.
Both are scaled by the root of the weight, which leaves their product as it is and makes common terms short. Documents are put in buckets by the length
of that vector and searched from the longest down. The k-th best score that an item has so far is its threshold: a bucket whose longest vector times the
item's length (Cauchy-Schwarz) stays below it is not searched, nor is the rest of a bucket below the same bound. In a bucket the item's heaviest terms are
added up first; documents whose sum, with what is left of both lengths, stays below the threshold drop out. The others are scored exactly in integers.

Items are searched in blocks of bounded size; for each block the documents are read once, counted and turned into vectors of the block's terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, slices, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms (with repeats over items) of a block of items, in expectation: what the driver and each task hold of the items.
BLOCK_TERMS = 1 << 17
#: Shares of the documents, from the longest vectors down, at which buckets end.
BUCKETS = (0.01, 0.05, 0.2, 0.5)
#: Numbers of documents' vectors that a task turns into columns at a time.
CHUNK = 1 << 20
#: Of an item's terms, so many of the heaviest are added up before documents drop out.
FOCUS = 6


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """item, terms (distinct, in order). Rows of one item are one item; null ids, null texts and texts without a term are none."""
    term = F.expr(r"explode(regexp_extract_all(translate({0}, '{1}', '{2}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0))".format(f"`{text}`", UPPER, LOWER))
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("item"), term.alias("term"))
    return rows.distinct().groupBy("item").agg(F.array_sort(F.collect_list("term")).alias("terms"))  # as many as one item has


def _vectors(docs: DataFrame, place: dict[str, int]) -> DataFrame:
    """doc, n (terms of the whole text), at, tf: the block's terms that a text has, by their places, and how often. A row for each document with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for part in slices(batch.column(1)):
                ids, sizes, at, tf, lengths = batch.column(0).slice(lo, len(part)), [], [], [], []
                lo += len(part)
                for t in part.to_pylist():
                    # lower() of bytes touches A-Z only
                    found = Counter(TERM.findall(t.encode().lower().decode())) if t else {}
                    sizes.append(sum(found.values()))
                    have = [(i, c) for w, c in found.items() if (i := place.get(w)) is not None]
                    lengths.append(len(have))
                    at.extend(i for i, _ in have)
                    tf.extend(c for _, c in have)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                columns = [ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "at", "tf"])
        release()

    return docs.mapInArrow(count, "doc long, n long, at array<int>, tf array<long>").where("n > 0")


def _impacts(vectors: DataFrame, weight: np.ndarray, docs: int, terms: int) -> DataFrame:
    """doc, at, impact, square (the vector's length squared, scaled by the weights) of documents' counts."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.astype(np.float64)
        for batch in batches:
            at, tf = batch.column("at"), batch.column("tf").flatten().to_numpy()
            places, offsets = at.flatten().to_numpy(), at.offsets.to_numpy().astype(np.int64)
            m = 50 + (50 * batch.column("n").to_numpy() * docs) // terms
            row = np.repeat(np.arange(len(at)), np.diff(offsets))
            impact = (1000000000 * tf) // (1000 * tf + 20 * m[row])
            square = np.bincount(row, w[places] * impact.astype(np.float64) ** 2, len(at)) * (1 + 1e-9)  # beyond what rounding takes
            lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(impact))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), at, lists, pa.array(square)], names=["doc", "at", "impact", "square"])
        release()

    return vectors.select("doc", "n", "at", "tf").mapInArrow(weigh, "doc long, at array<int>, impact array<long>, square double")


def _search(chunk: tuple, items: list[tuple[int, np.ndarray]], weight: np.ndarray, best: dict[int, tuple[np.ndarray, np.ndarray]], floors: dict[int, int], k: int) -> None:
    """Update best (by item: scores descending and their documents) with a chunk: documents, lengths squared, and their vectors as (document's place, term, impact)."""
    docs, square, row, term, impact = chunk
    order = np.argsort(-square, kind="stable")  # longest first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    docs, square, row = docs[order], square[order], rank[row]
    by = np.argsort(term, kind="stable")
    row, term, impact = row[by], term[by], impact[by]
    begin = np.searchsorted(term, np.arange(len(weight) + 1))
    length = np.sqrt(square)
    w = weight.astype(np.float64)
    for item, terms in items:
        scores, found = best.get(item, (np.empty(0, np.int64), np.empty(0, np.int64)))
        floor = max(floors.get(item, 1), int(scores[-1]) if len(scores) >= k else 1)
        rest = float(w[terms].sum())
        # Cauchy-Schwarz for whole vectors; the slack is far above what rounding takes
        n = int(np.searchsorted(-(length * np.sqrt(rest) * (1 + 1e-9)), -floor, "right"))
        if not n:
            continue
        heavy = terms[np.argsort(-weight[terms], kind="stable")]
        some, seen = np.zeros(n), np.zeros(n)
        for t in heavy[:FOCUS]:
            r, x = row[begin[t] : begin[t + 1]], impact[begin[t] : begin[t + 1]].astype(np.float64)
            inside = r < n
            r, x = r[inside], x[inside]
            some[r] += w[t] * x
            seen[r] += w[t] * x * x
            rest -= w[t]
        bound = some + np.sqrt(max(rest, 0.0) * np.maximum(square[:n] - seen, 0.0))
        alive = np.flatnonzero(bound * (1 + 1e-9) + 1e-3 >= floor)
        if not len(alive):
            continue
        slot = np.full(len(docs), -1, np.int64)
        slot[alive] = np.arange(len(alive))
        exact = np.zeros(len(alive), np.int64)
        for t in terms:
            at = slot[row[begin[t] : begin[t + 1]]]
            ok = at >= 0
            exact[at[ok]] += weight[t] * impact[begin[t] : begin[t + 1]][ok]
        good = exact >= floor
        s, f = np.concatenate([scores, exact[good]]), np.concatenate([found, docs[alive[good]]])
        first = np.lexsort((f, -s))[:k]
        best[item] = s[first], f[first]


def _bucket_search(rows: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, floors: dict[int, int], k: int) -> DataFrame:
    """item, doc, score: of each task's documents the k best of each item that reach its floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[pa.RecordBatch] = []
        size = 0

        def run() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table["at"].combine_chunks()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = [table[c].combine_chunks().flatten().to_numpy() for c in ("at", "impact")]
            _search((table["doc"].to_numpy(), table["square"].to_numpy(), row, *flat), items, weight, best, floors, k)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                held.append(part := batch.slice(lo, 1024))
                size += len(part.column("at").flatten())
                if size >= CHUNK:
                    run()
                    held, size = [], 0
        if held:
            run()
        for item, (scores, found) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), pa.array(found), pa.array(scores)], names=["item", "doc", "score"])
        release()

    return rows.select("doc", "square", "at", "impact").mapInArrow(search, "item long, doc long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0, equal scores by ascending doc_id.

    Documents count for the statistics whatever their id; those with a null id are not ranked. Null and empty texts, and texts without a term, take no part. Rows that repeat
    an id are documents of their own. Items: see item_terms. Either table may be empty: the result then is. All work is in 64-bit integers but for the weights and bounds.
    """
    wanted = written(item_terms(items, item_key, text), "items")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    texts = docs.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).cast("string").alias("t"))
    found = [_block_search(texts, wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")  # k rows of each task at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_search(texts: DataFrame, block: DataFrame, k: int) -> DataFrame:
    rows = block.collect()  # a block: about BLOCK_TERMS terms
    names = sorted({t for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(names)}
    items = [(r["item"], np.array([place[t] for t in r["terms"]], np.int64)) for r in rows]
    vectors = written(_vectors(texts, place), "vectors")
    sizes = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    docs, terms = sizes["docs"], sizes["terms"] or 1
    held = vectors.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df"))
    weighed = held.select("at", F.floor(1000 * F.log((2 * F.lit(docs) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).toArrow()  # a row for each term of the block
    weight = np.zeros(len(names), np.int64)
    weight[weighed["at"].to_numpy()] = weighed["w"].to_numpy()
    impacts = written(_impacts(vectors.where("doc is not null and size(at) > 0"), weight, docs, terms).where("square > 0"), "impacts")
    # where the buckets end: approximate quantiles, which decide what is searched first and nothing else
    ends = impacts.agg(F.expr(f"percentile_approx(square, array({', '.join(str(1 - s) for s in BUCKETS)}), 1000)").alias("e")).first()["e"] or []
    edges = [float("inf"), *ends, 0.0]
    best, floors = None, {}
    for high, low in zip(edges, edges[1:], strict=False):
        reach = float(np.sqrt(high)) * (1 + 1e-9)
        left = [(i, t) for i, t in items if len(t) and reach * float(np.sqrt(weight[t].sum())) >= floors.get(i, 0)]
        if not left or high == low:
            continue
        new = _bucket_search(impacts.where((F.col("square") <= high) & (F.col("square") > low)), left, weight, floors, k)
        best = written(_best(new if best is None else new.unionByName(best.drop("rank")), k), "best")
        kth = best.where(F.col("rank") == k).select("item", "score").collect()  # a number for each item of the block
        floors = {r["item"]: r["score"] for r in kth}
    if best is None:
        best = texts.sparkSession.createDataFrame([], "item long, doc long, score long, rank int")
    return best.select("item", F.col("rank").cast("int"), "doc", "score")

"""Bottom-k sketches of word-shingle hashes: fingerprints of texts that merge across parts.

A sketch holds the k smallest distinct hashes of a text's five-word shingles. Of two sketches' union, the k smallest are
a uniform sample of the union of the shingle sets: the share that both have estimates resemblance; the place of the k-th
hash estimates how many distinct shingles there are. A sketch with fewer than k hashes holds them all, so its figures are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import shingle_hashes, word_hashes

K = 128
#: Rows that a task turns into Python values at a time.
SLICE = 512
ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def sketch(text: str | None, k: int = K, size: int = 5) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending. Null and empty texts have an empty sketch."""
    h = shingle_hashes(word_hashes(text), size)
    if len(h) > 4 * k:  # the k-th of the distinct hashes is among these unless many repeat
        part = np.unique(np.partition(h, 2 * k)[: 2 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(h)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike (1), an empty and another one are not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    if len(a) < k and len(b) < k:
        return float(len(np.intersect1d(a, b, assume_unique=True)) / len(a))
    return min(1.0, j * distinct_count(merged(a, b, k), k) / distinct_count(a, k))


def packed(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def unpacked(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def fingerprint(text: Column, k: int = K) -> Column:
    """The sketch of each text as base64 of its big-endian hashes."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(sketch(t, k))).astype(object)

    return run(text)


def compare(a: Column, b: Column, k: int = K) -> Column:
    """struct(resemblance, containment, distinct_a, distinct_b) of two fingerprint columns; a null one counts as empty."""

    @F.pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(left, right, strict=True):
            p, q = unpacked(x or ""), unpacked(y or "")
            rows.append((resemblance(p, q, k), containment(p, q, k), distinct_count(p, k), distinct_count(q, k)))
        return pd.DataFrame(rows, columns=["resemblance", "containment", "distinct_a", "distinct_b"])

    return run(a, b)


def merge_parts(parts: DataFrame, keys: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each key, of the union of its parts' shingles.

    Parts are merged twice: first within 64 seeded pieces of a key, so that a key with very many parts is spread, then the
    pieces. A row of either step holds at most k hashes, as a running minimum over distinct hashes does.
    """
    h = F.explode(F.transform(F.sequence(F.lit(0), (F.length(F.unbase64(column)) / 8 - 1).cast("int")), lambda i: F.substring(F.hex(F.unbase64(column)), (i * 16 + 1).cast("int"), F.lit(16))))
    hashes = parts.where(F.length(column) > 0).select(*keys, h.alias("h")).distinct()
    piece = F.pmod(F.xxhash64("h"), F.lit(64))

    def smallest(df: DataFrame, by: list[str]) -> DataFrame:
        from pyspark.sql import Window

        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("__n") <= k).drop("__n")

    kept = smallest(smallest(hashes.withColumn("__p", piece), [*keys, "__p"]).drop("__p"), keys)
    found = kept.groupBy(*keys).agg(F.base64(F.unhex(F.array_join(F.array_sort(F.collect_list("h")), ""))).alias(column))
    return parts.select(*keys).distinct().join(found, keys, "left").withColumn(column, F.coalesce(F.regexp_replace(column, "[\r\n]", ""), F.lit("")))


def with_next(
    docs: DataFrame, row: Callable[[], Callable[[int | None, str, str], tuple]] | None = None, schema: str = "doc_id long, text string, next_text string",
    parts: int | None = None, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, text, next_text): each row's text and the next row's, in descending doc_id; after the last comes the first.

    row makes, once in each task, a function from those three values to an output row of `schema`; by default they are the row. Null texts are
    empty; null ids come last; rows of one id are ordered by their text, descending. Texts are shuffled once, into ranges of ids whose
    bounds are quantiles of the id column; a task reads its range in order and holds two rows at a time. The first row of a
    range is also sent to the range before it, where the last row needs it.
    """
    spark = docs.sparkSession
    low = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).isNull().alias("no_id"))
    n = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = sorted({int(x) for x in rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10_000)).first()[0] or []}, reverse=True)
    # range 0 has the largest ids: the number of bounds above the id
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.size(F.filter(bounds, lambda c: c > F.col("id")))
    rows = rows.withColumn("part", part)
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.max("id").alias("head")).collect())  # a row for each range
    if not heads:
        return spark.createDataFrame([], schema)
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]  # the head of range i follows the end of the range before; the first follows the last
    sent = spark.createDataFrame(before, "id long, target int")
    tails = rows.join(F.broadcast(sent), "id").withColumn("part", F.col("target")).drop("target").withColumn("tail", F.lit(1))
    both = rows.withColumn("tail", F.lit(0)).unionByName(tails)
    dealt = both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "tail", F.desc("id"), "no_id", F.desc("text"))

    fields = [(n, ARROW[t]) for n, t in (f.strip().split() for f in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = row() if row else lambda *values: values
        out_schema = pa.schema(fields)
        held = None  # the last row, which waits for the next one
        done = None  # the range whose first tail row has been used
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                rows = []
                columns = [c.to_pylist() for c in batch.slice(lo, SLICE).columns]
                for i, t, no_id, p, tail in zip(*columns, strict=True):
                    if tail and done == p:
                        continue
                    if held is not None:
                        rows.append(make(*held, t))
                    if tail:
                        held, done = None, p
                    else:
                        held = (None if no_id else i, t)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(out_schema), out_schema, strict=True)], schema=out_schema)

    return dealt.mapInArrow(run, schema)


def edited_prints(k: int = K) -> Callable[[], Callable[[int | None, str, str], tuple]]:
    """For with_next: compares a text with the next one and with itself as edited, its last half replaced by as much of the next one's beginning.

    Gives (doc_id, n_chars, edited text's SHA-256, fingerprint, edited fingerprint, resemblance to the edited, resemblance to the next).
    A text's sketch is kept for the row before, whose next text it is.
    """

    def start() -> Callable[[int | None, str, str], tuple]:
        last: tuple[str, np.ndarray] | None = None

        def one(doc_id: int | None, text: str, following: str) -> tuple:
            nonlocal last
            own = last[1] if last is not None and last[0] == text else sketch(text, k)
            last = (following, sketch(following, k))
            half = len(text) // 2
            changed = text[: len(text) - half] + following[:half]
            other = sketch(changed, k)
            return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), packed(own), packed(other), resemblance(own, other, k), resemblance(own, last[1], k)

        return one

    return start

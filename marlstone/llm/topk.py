"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates of a batch lie in vertical layout, a row for each dimension. Inner products are accumulated block of dimensions
by block. After a block a candidate can still gain or lose at most the product of what is left of its norm and of the
query's (Cauchy-Schwarz). Candidates whose best possible score is below the k-th best sure score drop out, and the rest is compacted
before the next block. The sure score of a query is carried from batch to batch, so later batches drop more.

Queries are written to the shared folder in blocks of bounded size. A task reads its candidates once; for each chunk of them it reads one block of queries after
another, so neither the driver nor a task holds all queries. Per chunk and query k rows come back, which Spark cuts to k rows for each query before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, release

QUERY_BLOCK = 2048
DIMENSION_BLOCK = 16
CANDIDATES = 8192
#: Numbers (components of candidates) that a task holds at a time, over which all query blocks are read once.
CHUNK = 1 << 22
#: Blocks whose best scores a task carries from chunk to chunk; those of further blocks are given out after each chunk.
CARRIED = 16


def to_integers(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as array<long>; null if the vector is null, empty or has a null or non-finite component."""
    x = embedding.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(embedding.isNotNull() & (F.size(x) > 0) & fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def search_batch(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Update best (for each query: scores descending and their ids) with one batch of candidates."""
    peak = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    kind = np.float64 if peak < 2**52 else np.int64  # sums are exact in either
    columns = np.ascontiguousarray(vectors.T.astype(kind))
    q = queries.astype(kind)
    dims = columns.shape[0]
    # the norms' rounding is far below this slack
    rest_c = np.sqrt(np.cumsum((columns.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    rest_q = np.sqrt(np.cumsum((q.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1])
    first = q[:, :DIMENSION_BLOCK] @ columns[:DIMENSION_BLOCK]
    for i in range(len(q)):
        scores, found = best[i]
        alive = np.flatnonzero(ids != query_ids[i])
        partial = first[i][alive]
        done = min(DIMENSION_BLOCK, dims)
        while True:
            if done < dims:
                slack = rest_c[done][alive] * rest_q[i, done] * (1 + 1e-9) + 1e-6
                sure = np.concatenate([scores, partial - slack])
                if len(sure) >= k:
                    floor_ = np.partition(sure, len(sure) - k)[len(sure) - k]
                    keep = partial + slack >= floor_
                    alive, partial = alive[keep], partial[keep]
                hi = min(done + DIMENSION_BLOCK, dims)
                block = columns[done:hi]
                partial = partial + (q[i, done:hi] @ (block if len(alive) == columns.shape[1] else block[:, alive]))
                done = hi
            else:
                break
        if len(scores) >= k:
            keep = partial >= scores[-1]
            alive, partial = alive[keep], partial[keep]
        if len(alive):
            s = np.concatenate([scores, partial.astype(np.int64)])
            f = np.concatenate([found, ids[alive]])
            if len(s) > 4 * k:  # all that may be among the first k, ties with the k-th included
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, f = s[keep], f[keep]
            order = np.lexsort((f, -s))[:k]
            best[i] = (s[order], f[order])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, vec: str = "ints", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest inner products among the candidates with another id.

    Both tables have a long id and array<long> vectors. Rows with a null id or vector take no part; a candidate of another
    length than the query's is none for it. Ties go to the smaller id. A query id that comes more than once counts once; candidates
    that come more than once count as often. Fewer than k rows come back where there are fewer candidates.
    """
    spark = queries.sparkSession
    qs = queries.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    # blocks of QUERY_BLOCK in expectation, by a hash of the id; one file each
    blocks = max(1, -(-qs.count() // QUERY_BLOCK))
    path = new_path(spark, "queries")
    qs.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition(min(blocks, 512), "block").write.partitionBy("block").parquet(path)
    cs = candidates.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).where("id is not null and v is not null")

    def read(block: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Ids and vectors of a block by length of vector."""
        store, root = pafs.FileSystem.from_uri(path)
        found = [f.path for f in store.get_file_info(pafs.FileSelector(f"{root}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
        out: dict[int, tuple[list, list]] = {}
        for f in sorted(found):
            with store.open_input_file(f) as opened:
                for i, v in zip(*pq.read_table(opened, columns=["id", "v"]).to_pydict().values(), strict=True):
                    ids, vectors = out.setdefault(len(v), ([], []))
                    ids.append(i)
                    vectors.append(v)
        return {d: (np.array(ids, np.int64), np.array(vectors, np.int64)) for d, (ids, vectors) in out.items()}

    def nothing(block: dict) -> dict:
        return {d: [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids) for d, (ids, _) in block.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[int, tuple[dict, dict]] = {}

        def given(block: dict, best: dict) -> Iterator[pa.RecordBatch]:
            for d, kept in best.items():
                lengths = [len(x) for x, _ in kept]
                if sum(lengths):
                    columns = [np.repeat(block[d][0], lengths), np.concatenate([f for _, f in kept]), np.concatenate([x for x, _ in kept])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        def search(chunk: dict[int, list]) -> Iterator[pa.RecordBatch]:
            """chunk: candidates (ids, vectors) by length of vector."""
            for b in range(blocks):
                block, best = carried[b] if b in carried else ((x := read(b)), nothing(x))
                if b < CARRIED:
                    carried[b] = block, best
                for d in set(chunk) & set(block):
                    ids, vectors = (np.concatenate(x) for x in zip(*chunk[d], strict=True))
                    for lo in range(0, len(ids), CANDIDATES):
                        search_batch(ids[lo : lo + CANDIDATES], vectors[lo : lo + CANDIDATES], *block[d], best[d], k)
                if b >= CARRIED:
                    yield from given(block, best)

        chunk: dict[int, list] = {}
        held = 0
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in set(sizes.tolist()):
                at = np.flatnonzero(sizes == d)
                for lo in range(0, len(at), CANDIDATES):
                    part = at[lo : lo + CANDIDATES]
                    chunk.setdefault(d, []).append((ids[part], flat[starts[part][:, None] + np.arange(d)]))
                    held += d * len(part)
                    if held >= CHUNK:
                        yield from search(chunk)
                        chunk, held = {}, 0
        if chunk:
            yield from search(chunk)
        for block, best in carried.values():
            yield from given(block, best)
        release()

    found = cs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Mixing sources to target weights by subset-sum budget fitting.

A source's budget is met by whole passes over all its documents, and one partial pass for what is left. Documents are counted by
exact length (source, length: a small table). From the counts alone it is settled how many documents of each length the partial
pass takes: the same share of all lengths, rounded on from shorter to longer ones, then a bounded-knapsack dynamic program over the lengths for the remaining budget.
Which ones is settled by a seeded hash: so many of a length, in hash order. All steps over documents are Spark aggregations and
windows over (source, length, hash piece); a source's counts are fitted in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
CAP = 3
PIECES = 1024
#: Budgets up to this, or up to twice the longest document if that is more, are fitted exactly; the equal share leaves less than the longest document.
EXACT = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Each source's share of the sum of all sizes, at most cap times its own size; what is above is shared anew among the others by weight.

    Sources by code point, null last, weigh `weights` in turn.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        full = set(over)
        open_ = [s for s in open_ if s not in full]
    return out


def fit_counts(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that the lengths' sum comes as near to the budget from below as can be.

    First the same share of all lengths: of the documents up to each length, in ascending order, the share rounded down is taken, so that lengths with few documents
    get it together and the sum is less than the longest document off the budget. What is above the budget is put back: of what the rounding added, the shortest document that covers it,
    else the longest one first. What is left then is fitted by a bounded-knapsack program over the documents left: bit b of a number says that sum b can be reached, a length's count is split into
    powers of two, and the items are walked back from the best sum. If the share rounded down for each length leaves no more than twice the longest document, that start is tried too.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    base = [c * budget // total for c in counts]
    take, before, so_far = [0] * len(lengths), 0, 0
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        so_far += counts[i]
        share = so_far * budget // total
        take[i], before = share - before, share
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    while left < 0:
        taken = [i for i, t in enumerate(take) if t > base[i] and lengths[i]]
        back = min((i for i in taken if lengths[i] >= -left), key=lambda i: lengths[i], default=None)
        if back is None:
            back = max(taken, key=lambda i: lengths[i])
        take[back] -= 1
        left += lengths[back]

    def spent(t: list[int]) -> int:
        return sum(n * k for n, k in zip(lengths, t, strict=True))

    even = filled(lengths, counts, take, left)
    if spent(even) == budget:
        return even
    # where the rounding stands in the way of a nearer sum, the rounded-down share of each length alone is the start
    if budget - spent(base) > exact_limit(lengths):
        return even
    return max(even, filled(lengths, counts, base, budget - spent(base)), key=spent)


def exact_limit(lengths: list[int]) -> int:
    return max(EXACT, 2 * max(lengths, default=0))


def filled(lengths: list[int], counts: list[int], take: list[int], left: int) -> list[int]:
    """take, and of the documents left those that fill the budget left as far as can be. left must be at most exact_limit.

    first[b] is the item with which sum b was first reached, from a sum that earlier items reach: a number for each sum, however many items there are.
    """
    take = list(take)
    if left <= 0:
        return take
    full = (1 << (left + 1)) - 1
    first = np.full(left + 1, -1, np.int32)
    reach, items = 1, []
    for i in sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i]):
        free = min(counts[i] - take[i], left // lengths[i])
        part = 1
        while free > 0 and not reach >> left & 1:
            n = min(part, free)
            new = (reach << (n * lengths[i])) & full & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(items)
                items.append((i, n))
                reach |= new
            free -= n
            part *= 2
        if reach >> left & 1:
            break
    best = reach.bit_length() - 1
    while best:
        i, n = items[first[best]]
        take[i] += n
        best -= n * lengths[i]
    return take


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 11, id_col: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, and the carried columns): how many times the mix takes each row.

    size is the number of words of the text (a null text has none). A row is taken at most cap times, as a source's target is at most cap times its
    size. Rows without words are taken with whole passes only. Repeated rows are rows of their own; rows that repeat id and text are alike, so it does not matter
    which of them is taken once more. Null ids, texts and sources count (a null text has no words). The same rows give the same mix. An empty table gives an empty
    table. Of docs only the named columns are read; carried columns must not be named like those of the result. One row for each distinct source reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), *carry,
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text)).alias("h"))
    rows = written(rows.withColumn("piece", F.pmod(F.col("h"), F.lit(PIECES)).cast("int")), "mix-sizes")
    pieces = rows.groupBy("source", "size", "piece").agg(F.count("*").alias("n"))
    pieces = written(pieces, "mix-pieces")
    by_length = pieces.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per_source = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()  # a row for each source
    sizes = {r["source"]: r["s"] for r in per_source}
    goal = targets(sizes, weights, cap)
    table = [(s, sizes[s], goal[s], min(cap, int(goal[s] // sizes[s])) if sizes[s] else 0) for s in sizes]
    plan = spark.createDataFrame(table, "source string, source_size long, target double, passes int")
    rest = [(s, n, 0 if p >= cap else int(round(t - p * n))) for s, n, t, p in table]
    budgets = spark.createDataFrame(rest, "source string, source_size long, budget long").select("source", "budget")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        pdf["take"] = fit_counts(pdf["size"].tolist(), pdf["n"].tolist(), int(pdf["budget"].iloc[0]))
        return pdf[["source", "size", "take"]]

    # a group is one source's table of lengths: as many rows as it has distinct lengths
    lengths = by_length.join(budgets, by_length["source"].eqNullSafe(budgets["source"])).select(by_length["source"], "size", "n", "budget")
    takes = lengths.groupBy("source").applyInPandas(fit, "source string, size long, take long")
    # where each hash piece of a length begins: 1024 rows for a length at most
    before = Window.partitionBy("source", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    a, b = starts.alias("a"), takes.alias("b")
    limits = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select("a.source", "a.size", "piece", "start", "n", "take")
    # of a piece all rows are taken, none, or (in one piece for each length) the first in hash order
    limits = limits.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - F.col("start")))).drop("start", "take", "n")
    local = rows.withColumn("i", F.row_number().over(Window.partitionBy("source", "size", "piece").orderBy("h", "doc_id")))
    x, y = local.alias("x"), limits.alias("y")
    chosen = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.piece") == F.col("y.piece"))).select("x.doc_id", "x.source", "x.size", (F.col("i") <= F.col("quota")).cast("int").alias("more"), *[F.col(f"x.{c}") for c in carry])
    p = plan.alias("p")
    whole = chosen.join(p, chosen["source"].eqNullSafe(F.col("p.source")))  # a row for each source; Spark broadcasts it if it is small
    return whole.select("doc_id", chosen["source"], "size", F.col("p.source_size"), F.col("p.target"), (F.col("p.passes") + F.col("more")).alias("copies"), *carry)

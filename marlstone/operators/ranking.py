"""Ranking: top-k per group, best and first rows, runners-up, modes, quotas and pages. Every order ends in a unique key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def top_lists(df: DataFrame, by: list[str], order: list[Column], k: int, value: Column, name: str) -> DataFrame:
    """(by, name): an array of the first k values of each group, in order. Each task cuts its part of a group to k rows before they are shuffled, so no group is ever held."""
    few = top_k(df, by, order, k, "__n").select(*by, F.struct("__n", value.alias("v")).alias("__v"))
    return few.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("__v")), lambda x: x["v"]).alias(name))


def counted_lists(rows: DataFrame, by: list[str], value: str, item: str, k: int, name: str) -> DataFrame:
    """(by, name): the k values with the most distinct items of each group, as struct(value, n); ties go to the smaller value. Null values do not count."""
    counts = rows.where(F.col(value).isNotNull()).select(*by, value, item).distinct().groupBy(*by, value).agg(F.count("*").alias("n"))
    return top_lists(counts, by, [F.desc("n"), F.asc(value)], k, F.struct(F.col(value).alias("value"), "n"), name)


def keep_best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the given order."""
    return top_k(df, key, order, 1, "__n").drop("__n")


def runner_up(scores: DataFrame, item: str, label: str, score: str, order: str, least: float = 4.0, conflict: float = 0.75) -> DataFrame:
    """item, best, best_score, second, lead, in_conflict: the best label of each item, the second if its score is at least `least`, how far the best is ahead."""
    ranked = top_k(scores, [item], [F.desc(score), F.asc(order)], 2, "__n")
    two = ranked.groupBy(item).agg(
        F.max(F.when(F.col("__n") == 1, F.col(label))).alias("best"), F.max(F.when(F.col("__n") == 1, F.col(score))).alias("best_score"),
        F.max(F.when((F.col("__n") == 2) & (F.col(score) >= least), F.col(label))).alias("second"), F.coalesce(F.max(F.when(F.col("__n") == 2, F.col(score))), F.lit(0.0)).alias("__s"),
    )
    return two.withColumn("lead", F.col("best_score") - F.col("__s")).withColumn("in_conflict", (F.col("__s") > 0) & (F.col("__s") >= conflict * F.col("best_score"))).drop("__s")


def mode_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent non-null value of each group with its count; ties go to the smaller value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return keep_best(counts, by, [F.desc("n"), F.asc(value)])


def dominant(df: DataFrame, by: str, value: str, item: str, share: float = 0.75, least: int = 5) -> DataFrame:
    """The value that at least `share` of a key's distinct items have, if the key has `least` items or more."""
    pairs = df.where(F.col(value).isNotNull()).select(by, value, item).distinct()
    each = pairs.groupBy(by, value).agg(F.count("*").alias("n"))
    whole = pairs.select(by, item).distinct().groupBy(by).agg(F.count("*").alias("total"))
    best = keep_best(each, [by], [F.desc("n"), F.asc(value)])
    return best.join(whole, by).where((F.col("total") >= least) & (F.col("n") >= share * F.col("total")))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of an ordered result."""
    return df.orderBy(*order).offset(number * size).limit(size)


def first_reason(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of several queues by key: the reason of the first queue that has a key wins."""
    tagged = None
    for i, (reason, df) in enumerate(parts):
        p = df.select(key).withColumn("reason", F.lit(reason)).withColumn("__p", F.lit(i))
        tagged = p if tagged is None else tagged.unionByName(p)
    return tagged.groupBy(key).agg(F.min_by("reason", "__p").alias("reason"))


def quotas(edges: DataFrame, classes: dict[str, tuple[Column, int]], order: list[Column]) -> DataFrame:
    """The union, without repetition, of the first n rows of each class of edges (name -> condition, n)."""
    chosen = None
    for cond, n in classes.values():
        part = edges.where(cond).orderBy(*order).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    return chosen.distinct()


def quick_lists(df: DataFrame, key: str, region: str, metrics: list[str], k: int, overall: int = -1) -> DataFrame:
    """(metric, region, key, rank): the first k by each metric, in every region and over all (region `overall`)."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = df.select(key, region, F.explode(each).alias("m")).select(key, F.explode(F.array(F.col(region), F.lit(overall))).alias("region"), "m.metric", "m.value")
    return top_k(rows, ["metric", "region"], [F.desc_nulls_last("value"), F.asc(key)], k).select("metric", "region", key, "rank")


def search_score(query: str, name: Column, text: Column, base: Column) -> Column:
    """How well a profile answers a query: 3 a token that its text has, 6 if it has all, 12 if its name, closed up, holds the query closed up, 4 if its name begins with the first token; and its base score."""
    tokens = list(dict.fromkeys(query.lower().split()))
    if not tokens:
        return base
    low, lname = F.lower(text), F.lower(name)
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    compact = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    closed = F.contains(F.regexp_replace(lname, "[^a-z0-9]", ""), F.lit(compact)) if compact else F.lit(False)
    return 3 * hits + 6 * (hits == len(tokens)).cast("int") + 12 * closed.cast("int") + 4 * F.startswith(lname, F.lit(tokens[0])).cast("int") + base


def ordered_by_modes(df: DataFrame, modes: dict[str, list[Column]], key: str, k: int) -> DataFrame:
    """(mode, key, place): the first k rows in each mode's order, ties to the smaller key."""
    parts = []
    for mode, order in modes.items():
        first = df.orderBy(*order, F.asc(key)).limit(k)
        parts.append(first.select(F.lit(mode).alias("mode"), key, F.row_number().over(Window.orderBy(*order, F.asc(key))).alias("place")))  # k rows
    return reduce(DataFrame.unionByName, parts)


def placed_in(df: DataFrame, by: str | None, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in its group, from 1; without a group, among all rows (for tables of a few rows)."""
    return df.withColumn(name, F.row_number().over((Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)))


def seeded_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum (all, if it has fewer), the same in every run and for any partitioning: those with the least hash of seed and key. Keys are unique."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return top_k(df.withColumn("__h", order), strata, [F.asc("__h"), F.asc(key)], n, "__n").drop("__h", "__n")


def guaranteed(df: DataFrame, order: list[Column], n: int, wanted: Column, last: list[Column] | None = None) -> DataFrame:
    """The first n rows in an order, with `place`; if none of them is wanted and there are wanted ones, the first of those (in the order `last`) takes the last place. For small tables: classes, topics."""
    placed = placed_in(df.withColumn("__w", F.coalesce(wanted, F.lit(False))), None, order, "place")
    first = placed.where(F.col("place") <= n)
    lacking = first.agg((~F.coalesce(F.bool_or("__w"), F.lit(False))).alias("__lacks"), F.max("place").alias("__last"))
    spare = placed_in(placed.where("__w"), None, last or order, "__n").where("__n = 1").drop("__n", "place")
    spare = spare.crossJoin(F.broadcast(lacking)).where("__lacks").withColumn("place", F.col("__last")).drop("__lacks", "__last")  # one row each
    kept = first.join(F.broadcast(spare.select(F.col("place").alias("__taken"))), F.col("place") == F.col("__taken"), "left_anti")
    return kept.unionByName(spare).drop("__w")


def or_fallback(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """df, or the fallback rows if it has none; decided within the query."""
    some = df.limit(1).agg(F.count("*").alias("__n"))
    return df.unionByName(fallback.crossJoin(F.broadcast(some)).where("__n = 0").drop("__n"))  # one row

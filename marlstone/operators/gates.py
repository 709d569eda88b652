"""Gates, routers, windows and facet filters. Gates are columns, so that Spark pushes and combines them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.rules import among, cascade, found, let, mentions


def relevance(title: Column, body: Column, metadata: Column, core: list[str], competing: list[str]) -> Column:
    """struct(keep, reason, mentions): is a record about the topic?

    In order: a core term in the title keeps; a competing one there drops; a core term among the metadata keeps; two mentions in title and body
    keep; one drops it as background; none drops it. Texts must be lower-cased; nulls count as blank.
    """
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    words = [(x, "word") for x in (*core, *competing)]
    seen = F.struct(found(t, words).alias("title"), F.exists(metadata, lambda m: F.lower(m).isin(*core)).alias("metadata"), mentions(F.concat_ws(" ", t, b), core).cast("long").alias("n"))

    def judged(seen: Column) -> Column:
        reason = cascade(
            [
                ("explicit_title", among(seen["title"], core, "word")), ("competing_title", among(seen["title"], competing, "word")), ("metadata_term", seen["metadata"]),
                ("repeated_mention", seen["n"] >= 2), ("background_mention", seen["n"] == 1),
            ],
            "no_mention",
        )
        return F.struct(reason.alias("reason"), seen["n"].alias("mentions"))

    # each text is read once: what it shows is bound before the reason is looked for, the reason before it is judged
    return let(let(seen, judged), lambda j: F.struct(j["reason"].isin("explicit_title", "metadata_term", "repeated_mention").alias("keep"), j["reason"].alias("reason"), j["mentions"].alias("mentions")))


def first_stop(gates: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first gate that a row does not pass, else `kept`. A null condition does not pass."""
    return cascade([(name, ~F.coalesce(passes, F.lit(False))) for name, passes in gates], kept)


def gate_counts(df: DataFrame, gate: str = "gate") -> DataFrame:
    return df.groupBy(gate).agg(F.count("*").alias("n"))


def newest(df: DataFrame, day: str) -> DataFrame:
    """One row with the newest date, to anchor windows on."""
    return df.agg(F.max(day).alias("__newest"))


def rolling_window(df: DataFrame, day: str, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows of the last `days` days up to as_of (default: the newest row's day), its start day included; rows without a date go."""
    if as_of is not None:
        return df.where(F.to_date(day) >= F.date_sub(as_of, days))
    anchored = df.crossJoin(F.broadcast(newest(df, day)))  # one row
    return anchored.where(F.to_date(day) >= F.date_sub(F.to_date("__newest"), days)).drop("__newest")


def recomputed(df: DataFrame, column: str, where: Column, fresh: Column) -> DataFrame:
    """df with `column` made anew where the condition holds, and `changed` telling whether that altered it."""
    value = F.when(F.coalesce(where, F.lit(False)), fresh).otherwise(F.col(column))
    return df.withColumn("__new", value).withColumn("changed", ~F.col("__new").eqNullSafe(F.col(column))).withColumn(column, F.col("__new")).drop("__new")


def all_filters(filters: dict[str, Column | None]) -> Column:
    """The conjunction of the filters that are set."""
    return reduce(lambda a, b: a & b, [f for f in filters.values() if f is not None], F.lit(True))


def cross_filtered_counts(df: DataFrame, facets: dict[str, str], filters: dict[str, Column]) -> DataFrame:
    """(facet, value, n): counts of each facet's values under all filters but the facet's own.

    One pass: each facet's row takes part if the others' filters hold, by grouping the exploded (facet, value) pairs.
    """
    pairs = [F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value"), all_filters({k: v for k, v in filters.items() if k != f}).alias("ok")) for f, c in facets.items()]
    return df.select(F.explode(F.array(*pairs)).alias("p")).where("p.ok").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def exact_match_override(df: DataFrame, match: Column, exact: Column) -> DataFrame:
    """Rows that match; only the exact ones where there are any."""
    found = df.where(match).withColumn("__exact", F.coalesce(exact, F.lit(False)))
    any_exact = found.agg(F.coalesce(F.bool_or("__exact"), F.lit(False)).alias("__any"))
    return found.crossJoin(F.broadcast(any_exact)).where(F.col("__exact") | ~F.col("__any")).drop("__exact", "__any")  # one row


def option_list(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their counts, nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def exclusive_allocation(candidates: DataFrame, item: str, modules: list[tuple[str, Column, int]], order: list[Column]) -> DataFrame:
    """(module, item, rank): modules in turn take their first n matching items that no earlier module has taken.

    A pass for each module of the (short) list; each is a distributed job over the candidates.
    """
    taken = None
    for name, cond, n in modules:
        free = candidates.where(cond)
        if taken is not None:
            free = free.join(taken.select(item), item, "left_anti")
        picked = _first(free, order, n).select(F.lit(name).alias("module"), item, "rank")
        taken = picked if taken is None else taken.unionByName(picked)
    return taken


def _first(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, numbered: a top-k first, so that only n rows are ever numbered in one task."""
    few = df.orderBy(*order).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))

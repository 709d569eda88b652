"""Snapshot diffs: classes of change, before/after maps, change texts and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import top_k


def joined(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, cur struct, old struct) by key, over both snapshots."""
    rest = [c for c in current.columns if c != key]
    a = current.select(F.col(key), F.struct(*rest).alias("cur"))
    b = baseline.select(F.col(key).alias("__k"), F.struct(*rest).alias("old"))
    return a.join(b, a[key] == b["__k"], "full_outer").select(F.coalesce(key, "__k").alias(key), "cur", "old")


def window_start(as_of: Column, previous: Column, days: int = 7, most: int = 28) -> Column:
    """The first day of a diff's window: `days` before as_of, or the day of the last baseline if that is longer ago, but at most `most` days before."""
    return F.least(F.date_sub(as_of, days), F.greatest(F.coalesce(previous, F.date_sub(as_of, days)), F.date_sub(as_of, most)))


def summarised(events: DataFrame, key: str, n: int) -> DataFrame:
    """events(key, event) with the number of its class (`in_class`), and `rank` 1 to n for the first n of each class by key (null for the others)."""
    counts = events.groupBy("event").agg(F.count("*").alias("in_class"))  # a row for each class
    first = top_k(events, ["event"], [F.asc(key)], n).select("event", key, "rank")
    return events.join(F.broadcast(counts), "event").join(F.broadcast(first), ["event", key], "left")  # n rows for each of five classes


def change_events(current: DataFrame, baseline: DataFrame, key: str, status: str, first: str, results: str, updated: str, start: Column) -> DataFrame:
    """(key, event): added (first date from start on), status_changed, results_posted, removed; updated (update date moved, from start on) only for rows
    without another event. A row may have two events. An empty baseline gives no events at all.
    """
    inside = lambda c: F.col(f"cur.{c}").isNotNull() & (F.to_date(F.col(f"cur.{c}")) >= start)
    j = joined(current, baseline, key)
    main = F.array_compact(
        F.array(
            F.when(F.col("old").isNull() & inside(first), F.lit("added")), F.when(F.col("cur").isNull(), F.lit("removed")),
            F.when(F.col("cur").isNotNull() & F.col("old").isNotNull() & ~F.col(f"cur.{status}").eqNullSafe(F.col(f"old.{status}")), F.lit("status_changed")),
            F.when(F.col("old").isNotNull() & F.col(f"cur.{results}").isNotNull() & F.col(f"old.{results}").isNull(), F.lit("results_posted")),
        )
    )
    moved = F.col("cur").isNotNull() & F.col("old").isNotNull() & ~F.col(f"cur.{updated}").eqNullSafe(F.col(f"old.{updated}")) & inside(updated)
    events = F.when(F.size("__m") > 0, F.col("__m")).when(moved, F.array(F.lit("updated"))).otherwise(F.array().cast("array<string>"))
    known = baseline.limit(1).agg((F.count("*") > 0).alias("__known"))
    out = j.withColumn("__m", main).crossJoin(F.broadcast(known)).where("__known")  # one row
    return out.select(key, F.explode(events).alias("event"))


def change_map(current: DataFrame, baseline: DataFrame, key: str, tracked: list[str], fillable: list[str] | None = None) -> DataFrame:
    """(key, kind, changes, filled): added, removed, updated, enriched or unchanged rows, with a map of field to before/after.

    A move from an empty value to a value, in one of the fillable fields (None: all are), is in `filled` and makes the row `enriched` if nothing else changed; other moves are in
    `changes`. Null and blank values are one value.
    """
    j = joined(current, baseline, key)
    empty = lambda c: c.isNull() | F.trim(c).isin("", "Unknown", "-", "N/A")
    pair = lambda f: F.struct(F.col(f"old.{f}").cast("string").alias("before"), F.col(f"cur.{f}").cast("string").alias("after"))
    fills = lambda f, v: empty(v["before"]) & ~empty(v["after"]) & (f.isin(fillable) if fillable is not None else F.lit(True))
    every = F.map_from_arrays(F.array(*[F.lit(f) for f in tracked]), F.array(*[pair(f) for f in tracked]))
    moved = F.map_filter(every, lambda _, v: F.coalesce(v["before"], F.lit("")) != F.coalesce(v["after"], F.lit("")))
    both = F.col("cur").isNotNull() & F.col("old").isNotNull()
    out = j.select(key, "cur", "old", moved.alias("m")).select(key, "cur", "old", F.map_filter("m", lambda f, v: ~fills(f, v)).alias("changes"), F.map_filter("m", fills).alias("filled"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("cur").isNull(), "removed").when(F.size("changes") > 0, "updated").when(F.size("filled") > 0, "enriched").otherwise("unchanged")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<before:string,after:string>>"))
    return out.select(key, kind.alias("kind"), F.when(both, F.col("changes")).otherwise(none).alias("changes"), F.when(both, F.col("filled")).otherwise(none).alias("filled"))


def list_moves(before: Column, after: Column, n: int = 2) -> Column:
    """`+a, +b, -c`: the first n entries of each that came and went."""
    came = F.transform(F.slice(F.array_sort(F.array_except(after, before)), 1, n), lambda x: F.concat(F.lit("+"), x))
    went = F.transform(F.slice(F.array_sort(F.array_except(before, after)), 1, n), lambda x: F.concat(F.lit("-"), x))
    return F.array_join(F.concat(came, went), ", ")


def guarded(new: DataFrame, last_good: DataFrame, least: float = 0.6) -> tuple[DataFrame, bool]:
    """The new snapshot, or the last good one if the new has less than `least` of its rows; and whether the new one was taken."""
    ok = new.count() >= least * last_good.count()
    return (new if ok else last_good), ok


def partial_refresh(new: DataFrame, last_good: DataFrame, key: str) -> DataFrame:
    """Re-read rows, and the last good rows of keys that were not re-read, with `carried`."""
    old = last_good.join(new.select(key), key, "left_anti").withColumn("carried", F.lit(True))
    return new.withColumn("carried", F.lit(False)).unionByName(old)


def preserved(computed: DataFrame, previous: DataFrame, same_revision: bool) -> DataFrame:
    """A rerun on the same revision that finds nothing keeps the earlier diff."""
    return previous if same_revision and computed.isEmpty() else computed

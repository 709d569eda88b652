"""Jobs over reviewed decisions and signals (model or expert output given as tables), and release checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.rules import cascade
from marlstone.sources.shared import written


def normalised(raw: DataFrame, pending: DataFrame, key: str, order: str, allowed: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """The first valid decision of each pending id, its score clamped."""
    ok = raw.where(F.col("decision").isin(*allowed)).join(pending.select(key), key, "left_semi")
    first = ok.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return first.withColumn("score", F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("score", F.lit(low)))))


def ceiling(decisions: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """decision after the first rule (name, condition, decision) that holds; the rule's name and the earlier decision are kept."""
    name, new = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for n, cond, d in rules:
        c = F.coalesce(cond, F.lit(False))
        name, new = name.when(c, F.lit(n)), new.when(c, F.lit(d))
    return decisions.withColumn("rule", name).withColumn("was", F.col("decision")).withColumn("decision", F.coalesce(new, F.col("decision")))


def claims(signals: DataFrame, included: DataFrame, key: str) -> DataFrame:
    """(signal, key) for ids that are included, each with the first signal that names it. signals: a (signal, key) row for each id that a signal names."""
    named = signals.select("signal", key).join(included.select(key), key, "left_semi")
    return named.groupBy(key).agg(F.min("signal").alias("signal"))


def accepted(signals: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """Signals all of whose ids they have claimed."""
    asked = signals.select("signal", key).distinct()
    held = asked.join(claimed.withColumn("__mine", F.lit(True)), ["signal", key], "left")
    return held.groupBy("signal").agg(F.bool_and(F.col("__mine").isNotNull()).alias("ok"), F.count("*").alias("n")).where("ok").select("signal", "n")


def with_fallback(claimed: DataFrame, every: DataFrame, fallback: Column, key: str) -> DataFrame:
    """(key, signal) of every id exactly once: the claimed signal, else the fallback."""
    return every.join(claimed, key, "left").select(key, F.coalesce("signal", fallback).alias("signal"))


def bounded(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def violations(rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, key): the union of the rows that break each rule; none means that all hold."""
    out = None
    for name, df in rules:
        part = df.select(F.lit(name).alias("rule"), F.col(df.columns[0]).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): ids that only one of two tables has."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit("only_left").alias("side"), key)
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").select(F.lit("only_right").alias("side"), key)
    return left.unionByName(right)


def counts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the number of rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def quote_head(quote: Column, share: float = 0.7, least: int = 24) -> Column:
    """The part of a quote that has to stand in its source: its first 70 %, and not below 24 letters."""
    return F.substring(quote, F.lit(1), F.greatest(F.lit(least), F.floor(F.length(quote) * share).cast("int")))


def quote_verdict(quote: Column, text: Column, share: float = 0.7, least_bare: int = 40) -> Column:
    """How a source has a quote (both already reduced to letters and digits): `whole`, else `prefix` (its head), else, for quotes of least_bare letters or more, `digits` (without digits), else `none`."""
    bare = lambda c: F.regexp_replace(c, r"\d+", "")
    some = F.length(quote) > 0
    digits = (F.length(quote) >= least_bare) & (bare(quote) != "") & F.contains(bare(text), bare(quote))
    return cascade([("whole", some & F.contains(text, quote)), ("prefix", some & F.contains(text, quote_head(quote, share))), ("digits", digits)], "none")


def numbered_references(cited: DataFrame, known: DataFrame, publication: str, order: str, key: str) -> DataFrame:
    """(publication, key, number): a publication's cited ids, numbered from 1 by first use; ids that are not known have no number."""
    first = cited.groupBy(publication, key).agg(F.min(order).alias("first")).join(known.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    place = F.row_number().over(Window.partitionBy(publication, "__known").orderBy("first", key))
    return first.withColumn("number", F.when(F.col("__known"), place)).select(publication, key, "number")


def humanised(docs: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """(key, text, replaced): every word that is a code replaced by its label. labels: (code, label)."""
    words = docs.select(key, F.posexplode(F.split(text, " ")).alias("pos", "code")).join(labels, "code", "left")
    one = F.struct("pos", F.coalesce("label", "code").alias("w"))
    g = words.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("ws"), F.count("label").alias("replaced"))  # the words of one text
    return g.select(key, F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("text"), "replaced")


def channel_feed(channels: list[tuple[str, DataFrame, str, Column, int]]) -> DataFrame:
    """(channel, id, place) of channels (name, rows, key, order, most): the first rows of each, largest order value first, in one schema."""
    parts = []
    for name, df, key, order, most in channels:
        first = df.select(F.lit(name).alias("channel"), F.col(key).alias("id"), order.alias("by")).orderBy(F.desc_nulls_last("by"), "id").limit(most)
        parts.append(first.select("channel", "id", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc_nulls_last("by"), "id")).alias("place")))
    return reduce(DataFrame.unionByName, parts)


def digest(sections: list[DataFrame]) -> DataFrame:
    """(section, line): the lines of sections, numbered from 1."""
    return reduce(DataFrame.unionByName, [s.select(F.lit(i).alias("section"), "line") for i, s in enumerate(sections, 1)])


def paired_sides(df: DataFrame, dimension: str, side: str, sides: list[str], key: str, quote: str, order: str) -> DataFrame:
    """A row for each dimension that has statements of every side: for each side its count, and the key and quote of its first statement in order (ties to the smaller key)."""
    of = lambda s, c: F.when(F.col(side) == s, c)
    first = lambda s, c: F.min_by(of(s, F.col(c)), of(s, F.struct(order, key)))
    aggs = [a for s in sides for a in (F.count_if(F.col(side) == s).alias(f"{s}_n"), first(s, key).alias(f"{s}_{key}"), first(s, quote).alias(f"{s}_{quote}"))]
    return df.groupBy(dimension).agg(*aggs).where(" and ".join(f"{s}_n > 0" for s in sides))


def delta_applied(df: DataFrame, deltas: DataFrame, key: str, text: str, fields: list[str]) -> DataFrame:
    """df with the fields of its reviewed deltas (key, quotes array<string>, fields) and a state.

    A delta is `applied` if every quote stands in the row's text, and then its non-null fields replace the row's; one quote that does not stand there and all of it is
    `rejected`. Rows without a delta or without text are `pending`.
    """
    new = deltas.select(key, F.col("quotes").alias("quotes_"), *[F.col(f).alias(f"{f}_") for f in fields])
    j = df.join(new, key, "left")
    ok = F.coalesce(F.forall("quotes_", lambda q: F.contains(F.col(text), q)), F.lit(False))
    state = cascade([("pending", F.col("quotes_").isNull() | (F.coalesce(text, F.lit("")) == "")), ("applied", ok)], "rejected")
    j = j.withColumn("state", state)
    for f in fields:
        j = j.withColumn(f, F.when(F.col("state") == "applied", F.coalesce(f"{f}_", f)).otherwise(F.col(f)))
    return j.drop("quotes_", *[f"{f}_" for f in fields])


def table_digest(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, n, digest): the number of rows and a hash of the multiset of rows, the same for any order and partitioning and another one for any changed cell.

    Each row's cells (null apart from empty) are hashed to four numbers, which are added up: partial sums of tasks are merged, nothing is collected.
    """
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    hashed = df.withColumn("__h", F.md5(F.concat_ws("\u0001", *[cell(c) for c in columns]).cast("binary")))
    lanes = [F.sum(F.conv(F.substring("__h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"__{i}") for i in range(4)]
    sums = hashed.groupBy(*(by or [])).agg(F.count("*").alias("n"), *lanes)
    return sums.select(*(by or []), "n", F.concat_ws("-", *[F.lower(F.hex(F.coalesce(F.col(f"__{i}"), F.lit(0).cast("long")))) for i in range(4)]).alias("digest"))


def freshness(newest: Column, as_of: Column, fresh: int, stale: int) -> Column:
    """fresh, ageing or stale by the days since the newest row; missing without one."""
    days = F.datediff(as_of, newest)
    return cascade([("missing", days.isNull()), ("fresh", days <= fresh), ("ageing", days <= stale)], "stale")


def quarantined(df: DataFrame, reason: Column, kept: str = "kept") -> DataFrame:
    """df with its `reason`, as it is read back from two tables: what was kept and what was set apart, by reason."""
    tagged = df.withColumn("reason", reason)
    return written(tagged.where(F.col("reason") == kept), "kept").unionByName(written(tagged.where(F.col("reason") != kept), "quarantine"))

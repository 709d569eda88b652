"""Keyed upsert, enrichment joins, carry-over, manifests and de-duplication by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graphs import least_earlier
from marlstone.sources.shared import written


def filled(df: DataFrame, column: str) -> Column:
    """Whether a value counts: not null, not a blank string, not an empty array."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    return c.isNotNull() & ((F.trim(c) != "") if kind == "string" else (F.size(c) > 0) if kind in ("array", "map") else F.lit(True))


def upsert(base: DataFrame, incoming: DataFrame, key: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """The merged table with `change`: added, updated, unchanged or untouched (no incoming row).

    An incoming value that is filled wins, except in protected columns, where a filled existing value stays. The tables have the same columns; the
    key is unique in each (deduplicate first if need be). Rows with a null key never match.
    """
    cols = [c for c in base.columns if c != key]
    a = base.select(key, F.struct(*cols).alias("__a"), *[filled(base, c).alias(f"__fa_{c}") for c in protected])
    b = incoming.select(F.col(key).alias("__key"), F.struct(*cols).alias("__b"), *[filled(incoming, c).alias(f"__fb_{c}") for c in cols])
    j = a.join(b, a[key] == b["__key"], "full_outer")
    value = {}
    for c in cols:
        old, new = F.col("__a")[c], F.col("__b")[c]
        take_new = F.coalesce(F.col(f"__fb_{c}"), F.lit(False))
        if c in protected:
            take_new = take_new & ~F.coalesce(F.col(f"__fa_{c}"), F.lit(False))
        value[c] = F.when(take_new, new).otherwise(F.coalesce(old, new) if c not in protected else F.coalesce(old, new))
    merged = j.select(F.coalesce(key, "__key").alias(key), "__a", "__b", F.struct(*[v.alias(c) for c, v in value.items()]).alias("__m"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "untouched").when(F.col("__m").eqNullSafe(F.col("__a")), "unchanged").otherwise("updated")
    return merged.select(key, "__m.*", change.alias("change"))


def fill_from(df: DataFrame, cache: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """df with columns from a dimension: only where empty (default), or wherever the dimension has another value. `action` tells kept, filled or overwritten."""
    c = cache.select(F.col(key).alias("__k"), *[F.col(x).alias(f"__{x}") for x in columns])
    j = df.join(c, df[key] == c["__k"], "left")
    was_empty, differs = F.lit(False), F.lit(False)
    for x in columns:
        new, empty = F.col(f"__{x}"), ~filled(df, x)
        was_empty = was_empty | (empty & new.isNotNull())
        differs = differs | (~empty & new.isNotNull() & ~new.eqNullSafe(F.col(x)))
    action = F.when(was_empty, "filled").when(differs & F.lit(overwrite), "overwritten").otherwise("kept")
    out = [F.when(F.col(f"__{x}").isNotNull() & (~filled(df, x) | F.lit(overwrite)), F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in df.columns]
    return j.select(*out, action.alias("action"))


def with_default(df: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """df left-joined to a dimension whose columns take defaults for keys that it lacks."""
    return df.join(dimension, key, "left").fillna(defaults)


def carried_over(previous: DataFrame, fresh: DataFrame, source: str, advanced: DataFrame) -> DataFrame:
    """Previous rows of sources that did not advance, and the fresh rows of those that did."""
    return previous.join(advanced.select(source), source, "left_anti").unionByName(fresh.join(advanced.select(source), source, "left_semi"))


def last_per_key(parts: list[DataFrame], key: str, order: Column) -> DataFrame:
    """The union of tables with one row for each key: that of the last table that has it; within a table the last by order."""
    every = None
    for i, p in enumerate(parts):
        t = p.withColumn("__src", F.lit(i))
        every = t if every is None else every.unionByName(t)
    w = Window.partitionBy(key).orderBy(F.desc("__src"), order)
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__src")


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def ingest_manifest(previous: DataFrame, added: DataFrame, as_of: Column, key: str) -> DataFrame:
    """(week_start, key): keys added in the week of as_of: those of the batch, and those of the previous manifest if it is of the same week."""
    this = added.select(week_start(as_of).alias("week_start"), key)
    same = previous.where(F.col("week_start") == week_start(as_of)).select("week_start", key)
    return same.union(this).distinct()


def unseen(keys: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(seen.select(key), key, "left_anti")


def enriched(df: DataFrame, metrics: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """df with an empty (null or zero) value filled from metrics of the same name, else of the same name in lower case without blanks around it; zeros count as none. metrics has a row a name."""
    filled = lambda c: F.nullif(F.col(c), F.lit(0))
    exact = metrics.select(F.col(name).alias(by), F.col(value).alias("exact_"))
    loose = metrics.groupBy(F.trim(F.lower(name)).alias("key_")).agg(F.max(filled(value)).alias("loose_"))
    j = df.join(exact, by, "left").withColumn("key_", F.trim(F.lower(by))).join(loose, "key_", "left")
    return j.withColumn(value, F.coalesce(filled(value), filled("exact_"), "loose_")).drop("key_", "exact_", "loose_")


def canonical_names(names: DataFrame, name: str, dictionary: DataFrame, least: int = 4) -> DataFrame:
    """(name, canonical `name`) by a dictionary (name, ord): the same name whatever its case, else the first entry that holds the name, or one of its words of `least` letters or more; null without one.

    Equal names meet by an equi-join; only the distinct names left over are tested against the dictionary, which is small by nature.
    """
    d = dictionary.select(F.col("name").alias("entry_"), F.col("ord").alias("ord_"), F.lower("name").alias("low_"))
    same = d.groupBy("low_").agg(F.min("entry_").alias("same_"))
    j = names.select(name).distinct().withColumn("low_", F.lower(name)).join(same, "low_", "left")
    words = F.filter(F.split(F.lower(name), " "), lambda w: F.length(w) >= least)
    held = F.contains("low_", F.lower(name)) | F.exists(words, lambda w: F.contains(F.col("low_"), w))
    rest = j.where("same_ is null").select(name).join(d, held, "left").groupBy(name).agg(F.min_by("entry_", "ord_").alias("name"))
    return j.where("same_ is not null").select(name, F.col("same_").alias("name")).unionByName(rest)


def earlier_records(records: DataFrame, order: str, ids: Column, title: Column, least: int = 40, merged_titles: bool = False) -> DataFrame:
    """(a, b, how): links from records to earlier ones, `a` and `b` being values of the unique column `order`, by which records come one after another.

    By `id`: to the record before it that carries one of the same ids. Only records without such a link go by `title`: its letters and digits in lower case, if they are `least` or more. They link to the
    first record with that title that went by no id, or, with merged_titles, to the last record before them with that title. Blank ids link nothing.
    """
    r = records.select(F.col(order).alias("a"), F.array_distinct(F.filter(F.transform(ids, lambda x: F.lower(F.trim(x))), lambda x: x != "")).alias("__ids"), F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "").alias("__title"))
    before = F.lag("a").over(Window.partitionBy("__id").orderBy("a"))
    by_id = r.select("a", F.explode("__ids").alias("__id")).select("a", before.alias("b")).where("b is not null").withColumn("how", F.lit("id"))
    titled = r.where(F.length("__title") >= least).select("a", "__title")
    if merged_titles:
        last = F.lag("a").over(Window.partitionBy("__title").orderBy("a"))
        every = by_id.unionByName(titled.select("a", last.alias("b"), F.lit("title").alias("how")).where("b < a"))
        # both kinds meet by record, so that ids are followed once; `id` is less than `title`
        return every.withColumn("__first", F.min("how").over(Window.partitionBy("a"))).where("how = __first").select("a", "b", "how").distinct()
    by_id = by_id.distinct()
    free = titled.join(by_id.select("a").distinct(), "a", "left_anti")
    by_title = free.join(free.groupBy("__title").agg(F.min("a").alias("b")), "__title").where("b < a")
    return by_id.unionByName(by_title.select("a", "b", F.lit("title").alias("how")))


def ordered_merge(records: DataFrame, order: str, ids: Column, title: Column, least: int = 40, merged_titles: bool = False) -> DataFrame:
    """(order, survivor, how): the record that each one is merged into, itself if it is `first`.

    Records come in the order of a unique column. One that shares an id with records before it joins the oldest of their survivors, and its ids count for that one from then on; else it joins
    by its title (see earlier_records). Two survivors that a later record links stay two: a record joins earlier ones only. What it joins is the least record that it reaches along links to earlier
    ones, which Spark finds by ranges of the order (see graphs.least_earlier), without one task that goes through all records.
    """
    links = written(earlier_records(records, order, ids, title, least, merged_titles), "earlier")
    merged = least_earlier(records.select(F.col(order).alias("node")), links)
    how = links.groupBy(F.col("a").alias("node")).agg(F.min("how").alias("how"))
    return merged.join(how, "node", "left").select(F.col("node").alias(order), F.col("label").alias("survivor"), F.coalesce("how", F.lit("first")).alias("how"))


def numbered(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """df with each row's place in its group, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def merged_events(events: DataFrame, survivor: str, order: str, material: str) -> DataFrame:
    """(survivor, n, kept, materiality, refs, source_events, cross_ids, candidate) of events(survivor, order, material, ref, ref_id, source_event, event, cross_id).

    The most material event of each survivor is kept, the first of several; references, source events and cross ids are those of all, each once and sorted. candidate: the reference
    ids and the kept event's kind. The sets hold an entry for each distinct value of one event's registries, as the merged record does.
    """
    sorted_set = lambda c, by: F.array_join(F.sort_array(F.collect_set(c)), by)
    best = F.max(F.struct(F.col(material).alias("material"), (-F.col(order)).alias("less"), F.col("event").alias("event"))).alias("best")
    g = events.groupBy(survivor).agg(
        F.count("*").alias("n"), best, sorted_set("ref", ",").alias("refs"), sorted_set("source_event", ",").alias("source_events"), sorted_set("cross_id", ",").alias("cross_ids"), sorted_set("ref_id", "|").alias("ids")
    )
    return g.select(survivor, "n", (-F.col("best.less")).alias("kept"), F.col("best.material").alias("materiality"), "refs", "source_events", "cross_ids", F.concat("ids", F.lit(":"), "best.event").alias("candidate"))

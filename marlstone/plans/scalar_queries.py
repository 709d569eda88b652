"""Queries of the scalar functions (inventory G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.plans.registering import Group, table

group = Group()
query = group.add


@query(
    "g1_lenient_date",
    """SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE)
         WHEN 2 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 3 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS day FROM orders""",
)
def g1(spark, sf):
    d = F.col("o_orderdate")
    r = F.col("o_orderkey") % 5
    written = F.when(r == 0, F.date_format(d, "yyyy/MM/dd HH:mm")).when(r == 1, F.date_format(d, "yyyy-MM-dd")).when(r == 2, F.concat(F.lit("in "), F.date_format(d, "yyyy-MM"))).when(r == 3, F.date_format(d, "yyyy")).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", S.lenient_date(written).alias("day"))


@query(
    "g2_date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) AS INT) AS age,
         CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS cutoff FROM orders""",
)
def g2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    last = o.agg(F.max("d").alias("last"))
    return o.crossJoin(F.broadcast(last)).select("o_orderkey", F.year("d").alias("y"), F.datediff("last", "d").alias("age"), S.months_back(F.col("d"), 6).alias("cutoff"))  # one row


@query("g3_publication_date", """SELECT o_orderkey, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') || '-04' END AS day FROM orders""")
def g3(spark, sf):
    d, r = F.col("o_orderdate"), F.col("o_orderkey") % 3
    written = F.when(r == 0, F.date_format(d, "yyyy MMM d")).when(r == 1, F.date_format(d, "yyyy MMM")).otherwise(F.concat(F.date_format(d, "yyyy"), F.lit(" Spring")))
    return table(spark, sf, "orders").select("o_orderkey", S.publication_date(written).alias("day"))


@query(
    "g4_keys",
    """SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS squeezed, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS bare,
         regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""",
)
def g4(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.squeezed(F.col("p_name")).alias("squeezed"), S.bare_key(F.col("p_name")).alias("bare"), S.slug(F.col("p_type")).alias("slug"))


@query("g5_quote_key", "SELECT doc_id, length(regexp_replace(lower(replace(nfc_normalize(text), chr(173), '')), '[^\\p{L}\\p{N}]+', '', 'g')) AS n FROM documents")
def g5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(S.quote_key(F.col("text"))).cast("long").alias("n"))


@query("g7_name_parts", r"SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda x: trim(x) <> '')) AS n, list_filter(string_split(p_type, ' '), lambda x: trim(x) <> '')[1] AS first, p_type || ' (' || p_brand || ')' AS label FROM part")
def g7(spark, sf):
    parts = S.name_parts(F.col("p_type"), " ")
    written = F.concat(F.lit(" 2*  The "), F.replace(F.col("p_type"), F.lit(" "), F.lit("\n  ")), F.lit(" ("), F.col("p_brand"), F.lit(") . ;"))
    return table(spark, sf, "part").select("p_partkey", F.size(parts).cast("long").alias("n"), F.get(parts, F.lit(0)).alias("first"), S.org_label(written).alias("label"))


@query("g9_extraction", r"""WITH t AS (SELECT doc_id, 'T' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS own, coalesce(text, '') || ' See [[Alpha ' || (doc_id % 7) || '|a]], [[Beta]], [[Beta]]: T' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || ', T00000001; PMID: ' || (10000 + doc_id % 9) || ', a' || (doc_id % 5) || '@x.org' AS t FROM documents)
 SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[A-Za-z0-9_.]+@[A-Za-z0-9.]+\.[a-z]+'))), ' ') AS emails, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\[\[([^\]|]+)', 1))), ';') AS links,
   array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(t, '\bT[0-9]{8}\b'))), lambda x: x <> own), ' ') AS ids, array_to_string(list_sort(list_distinct(regexp_extract_all(t, 'PMID:? *([0-9]{4,9})', 1))), ' ') AS pmids FROM t""")
def g9(spark, sf):
    own = F.concat(F.lit("T"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" See [[Alpha "), (F.col("doc_id") % 7).cast("string"), F.lit("|a]], [[Beta]], [[Beta]]: "), own, F.lit(", T00000001; PMID: "), (10000 + F.col("doc_id") % 9).cast("string"), F.lit(", a"), (F.col("doc_id") % 5).cast("string"), F.lit("@x.org"))
    d = table(spark, sf, "documents").select("doc_id", own.alias("own"), said.alias("t"))
    found = lambda p, group=0: S.found_all(F.col("t"), p, group)
    return d.select(
        "doc_id", F.array_join(found(r"[A-Za-z0-9_.]+@[A-Za-z0-9.]+\.[a-z]+"), " ").alias("emails"), F.array_join(found(r"\[\[([^\]|]+)", 1), ";").alias("links"),
        F.array_join(F.array_remove(found(r"\bT[0-9]{8}\b"), F.col("own")), " ").alias("ids"), F.array_join(found(r"PMID:? *([0-9]{4,9})", 1), " ").alias("pmids"),
    )


@query("g10_phase", "SELECT p_partkey, CASE WHEN p_size % 6 BETWEEN 1 AND 4 THEN 'Phase ' || ['I','II','III','IV'][p_size % 6] WHEN p_size % 6 = 5 THEN 'Phase I/II' ELSE 'NA' END AS label, CAST(CASE WHEN p_size % 6 BETWEEN 1 AND 4 THEN p_size % 6 WHEN p_size % 6 = 5 THEN 2 ELSE 0 END AS INT) AS rank FROM part")
def g10(spark, sf):
    r = F.col("p_size") % 6
    written = F.when(r.between(1, 4), F.concat(F.lit("phase "), r.cast("string"))).when(r == 5, "PHASE 1 / 2").otherwise("none")
    label = S.phase_label(written)
    return table(spark, sf, "part").select("p_partkey", label.alias("label"), S.phase_rank(label).alias("rank"))


@query("g12_sentinels", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 3 <> 0 THEN 'https://x.example/' || o_orderkey END AS url FROM orders")
def g12(spark, sf):
    day = F.when(F.col("o_orderkey") % 7 == 0, "1900-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    url = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "ftp").otherwise("https"), F.lit("://x.example/"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", S.without_sentinels(day).alias("day"), S.http_url(url).alias("url"))


@query("g13_script_share", "SELECT doc_id, round(len(regexp_extract_all(text, '[À-ÿ]')) / nullif(len(regexp_extract_all(text, '[À-ÿ]')) + len(regexp_extract_all(text, '[A-Za-z]')), 0), 6) AS share FROM documents")
def g13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(S.script_share(F.col("text"), "[À-ÿ]"), 6).alias("share"))


@query("g14_revision", "SELECT o_orderstatus, count(DISTINCT (o_custkey, o_orderpriority)) AS revisions, count(*) AS n FROM orders GROUP BY 1")
def g14(spark, sf):
    o = table(spark, sf, "orders").withColumn("rev", S.row_revision("o_custkey", "o_orderpriority"))
    return o.groupBy("o_orderstatus").agg(F.countDistinct("rev").alias("revisions"), F.count("*").alias("n"))


@query("g15_json_in_text", "SELECT event_id, user_id AS u, event_type AS kind FROM events")
def g15(spark, sf):
    e = table(spark, sf, "events")
    said = F.concat(F.lit("Sure, here it is:\n"), F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("kind"))), F.lit("\nThat is all."))
    return e.select("event_id", F.from_json(S.outer_json(said), "u long, kind string").alias("j")).select("event_id", "j.u", "j.kind")


@query("g17_values", "SELECT event_id, round(greatest(10.0, least(60.0, value)), 4) AS clamped, CASE WHEN value IS NULL THEN NULL WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS range_name FROM events")
def g17(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(S.clamped(v, 10.0, 60.0), 4).alias("clamped"), S.bucket(v, [10, 50], ["low", "middle", "high"]).alias("range_name"))

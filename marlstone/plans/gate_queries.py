"""Queries of scans' projections, gates and filters (inventory B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import gates, merging, ranking, rules
from marlstone.plans.registering import Group, table

group = Group()
query = group.add

CORE, COMPETING = ["the", "der", "les"], ["and", "und"]
TITLE = "lower(split_part(text, chr(10), 1))"
WORD = r"(^|[^\p{L}\p{N}])(%s)($|[^\p{L}\p{N}])"


def titled(spark, sf):
    """documents with lower-cased first line as title and the rest as body."""
    d = table(spark, sf, "documents")
    title = F.substring_index("text", "\n", 1)
    return d.withColumn("title", F.lower(title)).withColumn("body", F.lower(F.substring(F.col("text"), F.length(title) + 2, F.length("text")))).withColumn("low", F.lower("text"))


@query("b1_compact_projection", "SELECT doc_id, substr(text, 1, 60) AS title, coalesce(nullif(source, ''), 'unknown') AS source, 'https://docs.example/' || doc_id AS url, lang = 'en' AS is_english FROM documents")
def b1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), S.first_filled(F.col("source"), F.lit("unknown")).alias("source"), F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url"), (F.col("lang") == "en").alias("is_english"))


@query("b2_first_filled", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, nullif(trim(CASE WHEN p_size % 3 = 1 THEN '  ' ELSE p_brand END), ''), p_type) AS label FROM part")
def b2(spark, sf):
    r = F.col("p_size") % 3
    return table(spark, sf, "part").select("p_partkey", S.first_filled(F.when(r == 0, F.col("p_name")), F.when(r == 1, "  ").otherwise(F.col("p_brand")), F.col("p_type")).alias("label"))


@query(
    "b3_registry_normalisation",
    """WITH src AS (SELECT *, 'R' || (p_partkey % 500) AS id, CASE p_size % 4 WHEN 0 THEN 'recruiting' WHEN 1 THEN 'DONE' WHEN 2 THEN 'stopped' ELSE 'odd' END AS st FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0),
         n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey DESC) AS rn FROM src)
       SELECT id, p_name AS title, CASE st WHEN 'recruiting' THEN 'Recruiting' WHEN 'DONE' THEN 'Completed' WHEN 'stopped' THEN 'Terminated' ELSE 'Unknown' END AS status, CASE WHEN p_size % 5 = 0 THEN 'Unknown' ELSE p_brand END AS sponsor,
         'S' || p_partkey || ' ' || 'X' || p_size AS secondary_ids, CASE p_size % 3 WHEN 0 THEN '2/3' WHEN 1 THEN '1' ELSE '' END AS phase FROM n WHERE rn = 1""",
)
def b3(spark, sf):
    k, r, m3 = F.col("p_partkey"), F.col("p_size") % 4, F.col("p_size") % 3
    p = table(spark, sf, "part").where("p_partkey % 11 <> 0").select(
        F.concat(F.lit("R"), (k % 500).cast("string")).alias("reg_no"), F.when(k % 13 != 0, F.when(k % 2 == 0, F.col("p_name"))).alias("title"), F.when(k % 13 != 0, F.when(k % 2 == 1, F.col("p_name"))).alias("public_title"), "p_partkey",
        F.when(r == 0, "recruiting").when(r == 1, "DONE").when(r == 2, "stopped").otherwise("odd").alias("st"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_brand")).alias("sponsor"),
        F.concat(F.lit("S"), k.cast("string"), F.lit(" ; X"), F.col("p_size").cast("string"), F.lit(",,")).alias("others"), F.when(m3 == 0, "Phase II/III").when(m3 == 1, "phase 1").otherwise("N/A").alias("phase"),
    )
    named = F.create_map(*[F.lit(x) for kv in {"recruiting": "Recruiting", "done": "Completed", "stopped": "Terminated"}.items() for x in kv])
    rows = p.select(
        F.col("reg_no").alias("id"), S.first_filled(F.col("title"), F.col("public_title")).alias("title"), "p_partkey", F.coalesce(F.try_element_at(named, F.lower("st")), F.lit("Unknown")).alias("status"),
        F.coalesce(S.first_filled(F.col("sponsor")), F.lit("Unknown")).alias("sponsor"), F.array_join(S.name_parts(F.col("others"), "[,;]"), " ").alias("secondary_ids"), S.phase_digits(F.col("phase")).alias("phase"),
    )
    return ranking.keep_best(rows.where("id is not null and title is not null"), ["id"], [F.desc("p_partkey")]).select("id", "title", "status", "sponsor", "secondary_ids", "phase")


@query("b4_registry_enrichment", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'other' END AS status_class, coalesce(c_name, 'unknown') AS sponsor, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def b4(spark, sf):
    side = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("sponsor"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    kind = rules.cascade([("open", F.col("o_orderstatus") == "O"), ("closed", F.col("o_orderstatus") == "F")], "other")
    return merging.with_default(o, side, "o_custkey", {"sponsor": "unknown"}).select("o_orderkey", kind.alias("status_class"), "sponsor", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


B5_CTE = rf"""WITH d AS (SELECT *, {TITLE} AS title, lower(text) AS low FROM documents),
 m AS (SELECT *, len(list_filter(regexp_split_to_array(low, '[^\p{{L}}\p{{N}}]+'), lambda w: w IN ('the', 'der', 'les'))) AS mentions FROM d),
 r AS (SELECT *, CASE WHEN regexp_matches(title, '{WORD % "the|der|les"}') THEN 'explicit_title' WHEN regexp_matches(title, '{WORD % "and|und"}') THEN 'competing_title'
   WHEN source IN ('the', 'der', 'les') THEN 'metadata_term' WHEN mentions >= 2 THEN 'repeated_mention' WHEN mentions = 1 THEN 'background_mention' ELSE 'no_mention' END AS reason FROM m)"""


def gated(spark, sf):
    d = titled(spark, sf)
    return d.withColumn("g", gates.relevance(F.col("title"), F.col("body"), F.array("source"), CORE, COMPETING))


@query("b5_relevance_gate", B5_CTE + " SELECT doc_id, reason IN ('explicit_title', 'metadata_term', 'repeated_mention') AS keep, reason, mentions FROM r")
def b5(spark, sf):
    return gated(spark, sf).select("doc_id", "g.keep", "g.reason", "g.mentions")


@query("b6_eligibility", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 OR source IN ('src1', 'src2')")
def b6(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.where((F.col("quality") == 1) | F.col("source").isin("src1", "src2")).select("doc_id")


ROUTE_SQL = f"(regexp_matches({TITLE}, '{WORD % 'the'}') OR (lang = 'de' AND contains(lower(text), 'ung')))"


def routed():
    return rules.any_of(F.col("title"), ["the"], "word") | ((F.col("lang") == "de") & rules.has(F.col("low"), "ung"))


@query("b7_router", f"SELECT {ROUTE_SQL} AS routed, count(*) AS n FROM documents GROUP BY 1")
def b7(spark, sf):
    return titled(spark, sf).groupBy(routed().alias("routed")).agg(F.count("*").alias("n"))


@query(
    "b8_gate_cascade",
    B5_CTE + f""" SELECT CASE WHEN reason NOT IN ('explicit_title', 'metadata_term', 'repeated_mention') THEN 'relevance' WHEN {ROUTE_SQL} THEN 'routed' WHEN length(text) < 200 THEN 'eligibility' ELSE 'kept' END AS gate, count(*) AS n FROM r GROUP BY 1""",
)
def b8(spark, sf):
    stop = gates.first_stop([("relevance", F.col("g.keep")), ("routed", ~routed()), ("eligibility", F.length("text") >= 200)])
    return gates.gate_counts(gated(spark, sf).withColumn("gate", stop))


@query("b9_exclusions", "SELECT doc_id FROM documents WHERE NOT (source = 'src3' OR contains(lower(text), 'all rights reserved') OR contains(text, ' | '))")
def b9(spark, sf):
    d = table(spark, sf, "documents")
    low = F.lower("text")
    return d.where(~((F.col("source") == "src3") | rules.any_of(low, ["all rights reserved"]) | rules.has(F.col("text"), " | "))).select("doc_id")


@query("b10_rolling_window", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - 7")
def b10(spark, sf):
    return gates.rolling_window(table(spark, sf, "events").select("event_id", "ts"), "ts", 7).select("event_id")


@query("b11_selective_recompute", "SELECT CASE WHEN quality = 0 AND length(text) > 1000 THEN 'changed' ELSE 'same' END AS kind, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def b11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    out = gates.recomputed(d, "quality", F.col("quality") == 0, F.when(F.length("text") > 1000, 1).otherwise(0))
    return out.groupBy(F.when(F.col("changed"), "changed").otherwise("same").alias("kind")).agg(F.count("*").alias("n"))


@query("b12_facet_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND lang IN ('en', 'fr') AND n_chars BETWEEN 500 AND 5000 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def b12(spark, sf):
    keep = gates.all_filters({"keyword": rules.has(F.lower("text"), "tion"), "lang": F.col("lang").isin("en", "fr"), "size": F.col("n_chars").between(500, 5000), "journal": None})
    return table(spark, sf, "documents").where(keep).join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query(
    "b13_cross_filtered_facets",
    """SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL
       UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL
       UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY ALL""",
)
def b13(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return gates.cross_filtered_counts(o, {"status": "o_orderstatus", "priority": "o_orderpriority", "year": "year"}, {"status": F.col("o_orderstatus") == "O", "priority": F.col("o_orderpriority") == "1-URGENT"})


@query("b14_nested_row_filter", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AND count(*) >= 5")
def b14(spark, sf):
    nested = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("trials"))  # a customer's orders: tens
    return nested.where(F.exists("trials", lambda t: t["o_orderstatus"] == "P") & (F.size("trials") >= 5)).select("o_custkey")


@query("b15_abstract_filter", "SELECT doc_id, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS priority FROM documents JOIN labels USING (doc_id) WHERE contains(lower(concat_ws(' ', source, lang, text)), 'ention') AND toxic = 0 AND lang IN ('en', 'de')")
def b15(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    hay = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    keep = rules.has(hay, "ention") & (F.col("toxic") == 0) & F.array_contains(F.array(F.lit("en"), F.lit("de")), F.col("lang"))
    return d.where(keep).select("doc_id", F.when(F.col("quality") == 1, 2).otherwise(1).alias("priority"))


@query("b16_expert_filter", """WITH n AS (SELECT o_custkey, count(*) AS papers, count(*) FILTER (WHERE o_orderdate >= newest - INTERVAL 3 YEAR) AS recent FROM (SELECT *, max(o_orderdate) OVER () AS newest FROM orders) GROUP BY 1),
 p AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CASE WHEN papers < 5 THEN 'few' WHEN papers < 12 THEN 'some' ELSE 'many' END AS total_range, CASE WHEN recent < 2 THEN 'few' WHEN recent < 6 THEN 'some' ELSE 'many' END AS recent_range FROM customer JOIN n ON c_custkey = o_custkey),
 m AS (SELECT *, c_name = 'Customer#000000012' AS exact FROM p WHERE contains(c_name, '1') AND c_nationkey < 20 AND total_range IN ('some', 'many') AND recent_range <> 'few') SELECT c_custkey, c_name, total_range, recent_range FROM m WHERE exact OR NOT (SELECT bool_or(exact) FROM m)""")
def b16(spark, sf):
    o = table(spark, sf, "orders")
    x = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("newest"))))  # one row
    n = x.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("papers"), F.count_if(F.col("o_orderdate") >= F.expr("newest - interval 3 year")).alias("recent"))
    named = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").join(n, "c_custkey")
    named = named.withColumn("total_range", S.bucket(F.col("papers"), [5, 12], ["few", "some", "many"])).withColumn("recent_range", S.bucket(F.col("recent"), [2, 6], ["few", "some", "many"]))
    keep = gates.all_filters({"topic": None, "location": F.col("c_nationkey") < 20, "total": F.col("total_range").isin("some", "many"), "recent": F.col("recent_range") != "few", "name": rules.has(F.col("c_name"), "1")})
    return gates.exact_match_override(named, keep, F.col("c_name") == "Customer#000000012").select("c_custkey", "c_name", "total_range", "recent_range")


@query(
    "b17_exclusive_allocation",
    """WITH a AS (SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the ') ORDER BY n_chars DESC, doc_id LIMIT 20),
            b AS (SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'ing') AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n_chars DESC, doc_id LIMIT 20)
       SELECT 'first' AS module, doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM a
       UNION ALL SELECT 'second', doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) FROM b""",
)
def b17(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.lower("text").alias("low"))
    return gates.exclusive_allocation(d, "doc_id", [("first", rules.has(F.col("low"), "the "), 20), ("second", rules.has(F.col("low"), "ing"), 20)], [F.desc("n_chars"), F.asc("doc_id")])


@query(
    "b18_review_candidates",
    """SELECT doc_id, array_to_string(list_sort(list(term)), ',') AS hits FROM documents JOIN labels USING (doc_id), (VALUES ('tion'), ('ung'), ('mente')) t(term)
       WHERE quality = 1 AND doc_id % 5 = 0 AND contains(lower(text), term) GROUP BY doc_id""",
)
def b18(spark, sf):
    terms = rules.rule_table(spark, [rules.Rule("chapter", t) for t in ("tion", "ung", "mente")])
    every = table(spark, sf, "documents")
    base = every.where("doc_id % 5 <> 0").select("doc_id")  # the rows of the last snapshot
    d = every.join(base, "doc_id", "left_anti").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return rules.matched(d, "doc_id", "text", terms).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("hits"))


@query("b19_option_lists", "SELECT 'priority' AS facet, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(*) FROM orders GROUP BY ALL")
def b19(spark, sf):
    o = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    a = gates.option_list(o, "o_orderpriority").select(F.lit("priority").alias("facet"), "value", "n")
    return a.unionByName(gates.option_list(o, "month").select(F.lit("month").alias("facet"), "value", "n"))

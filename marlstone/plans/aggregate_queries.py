"""Queries of aggregations, rankings and graphs (inventory C11, C12, C21, C22, D, E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import gates, graphs, ranking, rules
from marlstone.plans.merge_queries import HITS_SQL, TERMS
from marlstone.plans.registering import Group, table

group = Group()
query = group.add


def scored(spark, sf):
    """(doc_id, label, score, ord) by the term rules."""
    m = rules.matched_rules(table(spark, sf, "documents"), "doc_id", "text", TERMS)
    return m.groupBy("doc_id", "label").agg(F.sum("weight").alias("score"), F.min("ord").alias("ord"))


SCORED_SQL = HITS_SQL + ", scored AS (SELECT doc_id, label, CAST(sum(weight) AS DOUBLE) AS score, min(ord) AS ord FROM hits GROUP BY ALL)"
BEST_SQL = SCORED_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM scored),
 best AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN label END) AS best, max(CASE WHEN rn = 1 THEN score END) AS best_score, max(CASE WHEN rn = 2 AND score >= 2 THEN label END) AS second,
   coalesce(max(CASE WHEN rn = 2 THEN score END), 0) AS s2 FROM ranked WHERE rn <= 2 GROUP BY 1)"""


def best(spark, sf):
    return ranking.runner_up(scored(spark, sf), "doc_id", "label", "score", "ord", least=2.0)


@query("e2_runner_up", f"WITH {BEST_SQL} SELECT doc_id, best, best_score, second, best_score - s2 AS lead, s2 > 0 AND s2 >= 0.75 * best_score AS in_conflict FROM best")
def e2(spark, sf):
    return best(spark, sf)


@query("c21_community_profile", f"WITH {BEST_SQL} SELECT source, best AS community, count(*) AS n FROM documents JOIN best USING (doc_id) GROUP BY ALL")
def c21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(best(spark, sf), "doc_id").groupBy("source", F.col("best").alias("community")).agg(F.count("*").alias("n"))


@query("c28_reference_collection", """WITH u AS (SELECT doc_id, 'label' AS src, quality AS q FROM labels UNION ALL SELECT doc_id, 'long', 0 FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 'english', 0 FROM documents WHERE lang = 'en')
 SELECT doc_id, max(q) AS q, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM u GROUP BY 1 ORDER BY q DESC, count(DISTINCT src) DESC, doc_id LIMIT 12""")
def c28(spark, sf):
    d = table(spark, sf, "documents")
    part = lambda df, name, q: df.select("doc_id", F.lit(name).alias("src"), q.cast("int").alias("q"))
    u = part(table(spark, sf, "labels"), "label", F.col("quality")).unionByName(part(d.where("n_chars > 3000"), "long", F.lit(0))).unionByName(part(d.where("lang = 'en'"), "english", F.lit(0)))
    g = u.groupBy("doc_id").agg(F.max("q").alias("q"), F.array_sort(F.collect_set("src")).alias("s"))
    return g.orderBy(F.desc("q"), F.desc(F.size("s")), "doc_id").limit(12).select("doc_id", "q", F.array_join("s", ",").alias("sources"))


@query("d1_grouped_counters", """SELECT 'month' AS facet, strftime(o_orderdate, '%Y-%m') AS value, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY ALL
 UNION ALL SELECT 'priority', o_orderpriority, count(DISTINCT o_orderkey) FROM orders GROUP BY ALL UNION ALL SELECT 'nation', n_name, count(DISTINCT o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def d1(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    o = table(spark, sf, "orders").join(c, "o_custkey").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return gates.cross_filtered_counts(o.select("o_orderkey", "month", "o_orderpriority", "n_name").distinct(), {"month": "month", "priority": "o_orderpriority", "nation": "n_name"}, {})


@query("d2_ranked_nested", """WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20), r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
 SELECT o_custkey, n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS newest FROM t JOIN r USING (o_custkey) WHERE rn <= 10 GROUP BY ALL""")
def d2(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    top = o.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)
    few = ranking.top_k(o.join(top, "o_custkey"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 10)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return few.groupBy("o_custkey", "n").agg(F.array_join(ids, ",").alias("newest"))


SIGNAL_SQL = "sig AS (SELECT doc_id, source, lang, n_chars, quality, toxic, round(n_chars / 1000.0 + CASE quality WHEN 1 THEN 5 ELSE 1 END + CASE WHEN lang <> 'en' THEN 1.5 ELSE 0 END - CASE WHEN toxic = 1 THEN 3 ELSE 0 END, 4) AS score, CASE WHEN quality = 1 AND n_chars > 2000 THEN 'strong' WHEN quality = 1 THEN 'medium' ELSE 'weak' END AS strength FROM documents JOIN labels USING (doc_id))"


def signals(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    s = F.col("n_chars") / 1000.0 + F.when(F.col("quality") == 1, 5).otherwise(1) + F.when(F.col("lang") != "en", 1.5).otherwise(0) - F.when(F.col("toxic") == 1, 3).otherwise(0)
    strength = rules.cascade([("strong", (F.col("quality") == 1) & (F.col("n_chars") > 2000)), ("medium", F.col("quality") == 1)], "weak")
    return d.select("doc_id", "source", "lang", "n_chars", "quality", "toxic", F.round(s, 4).alias("score"), strength.alias("strength"))


CLUSTER_SQL = SIGNAL_SQL + ", clu AS (SELECT source, count(*) AS members, round(max(score) + least(4, 0.8 * (count(*) - 1)), 4) AS score, min(CASE strength WHEN 'strong' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS tier, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM sig GROUP BY 1)"


def clusters(spark, sf):
    tier = F.when(F.col("strength") == "strong", 1).when(F.col("strength") == "medium", 2).otherwise(3)
    return signals(spark, sf).groupBy("source").agg(F.count("*").alias("members"), F.round(F.max("score") + F.least(F.lit(4.0), 0.8 * (F.count("*") - 1)), 4).alias("score"), F.min(tier).alias("tier"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("d5_signal_summary", f"WITH {SIGNAL_SQL}, k AS (SELECT lang, count(*) AS n, min(doc_id) AS first FROM sig WHERE strength <> 'weak' GROUP BY 1) SELECT 'strength' AS kind, strength AS name, count(*) AS n FROM sig GROUP BY ALL UNION ALL (SELECT 'topic', lang, n FROM k ORDER BY n DESC, first LIMIT 3)")
def d5(spark, sf):
    s = signals(spark, sf)
    a = s.groupBy(F.lit("strength").alias("kind"), F.col("strength").alias("name")).agg(F.count("*").alias("n"))
    t = s.where("strength <> 'weak'").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(F.desc("n"), "first").limit(3)
    return a.unionByName(t.select(F.lit("topic").alias("kind"), F.col("lang").alias("name"), "n"))


@query("d6_topic_hotspots", f"WITH {SCORED_SQL} SELECT label, count(*) AS n FROM scored JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1")
def d6(spark, sf):
    return scored(spark, sf).join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


ROLE_SQL = """au AS (SELECT l_orderkey AS paper, l_suppkey AS author, s_nationkey AS inst, l_linenumber AS pos, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
 ro AS (SELECT *, CASE WHEN pos = 1 THEN 'first' WHEN pos = last THEN 'last' END AS role FROM au)"""


def authors(spark, sf):
    """(paper, author, inst, pos, last, role): an order is a paper, its suppliers are authors, nations institutions."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("author"), F.col("l_linenumber").alias("pos"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("inst"))
    last = F.max("pos").over(Window.partitionBy("paper"))
    a = li.join(s, "author").withColumn("last", last)
    return a.withColumn("role", F.when(F.col("pos") == 1, "first").when(F.col("pos") == F.col("last"), "last"))


@query("d7_key_authors", f"WITH {ROLE_SQL} SELECT author, inst, count(DISTINCT paper) AS papers, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM ro WHERE role IS NOT NULL GROUP BY ALL ORDER BY papers DESC, author LIMIT 8")
def d7(spark, sf):
    a = authors(spark, sf).where("role is not null").groupBy("author", "inst").agg(F.countDistinct("paper").alias("papers"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return a.orderBy(F.desc("papers"), "author").limit(8)


@query("d8_institution_leads", f"WITH {ROLE_SQL}, p AS (SELECT paper, inst, count(DISTINCT author) AS n FROM ro GROUP BY ALL) SELECT inst, count(*) AS papers, CAST(sum(n) AS BIGINT) AS appearances FROM p GROUP BY 1 ORDER BY papers DESC, inst LIMIT 8")
def d8(spark, sf):
    p = authors(spark, sf).groupBy("paper", "inst").agg(F.countDistinct("author").alias("n"))
    return p.groupBy("inst").agg(F.count("*").alias("papers"), F.sum("n").alias("appearances")).orderBy(F.desc("papers"), "inst").limit(8)


@query("d9_author_rows", f"WITH {ROLE_SQL} SELECT author, inst, count(*) AS n, count(role) AS with_role FROM ro GROUP BY ALL")
def d9(spark, sf):
    return authors(spark, sf).groupBy("author", "inst").agg(F.count("*").alias("n"), F.count("role").alias("with_role"))


@query("d12_institution_index", "SELECT c_nationkey AS inst, count(DISTINCT o_orderkey) AS papers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS closed, arg_min(seg, (-n, seg)) AS usual FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def d12(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "inst")
    a = j.groupBy("inst").agg(F.countDistinct("o_orderkey").alias("papers"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("closed"))
    return a.join(ranking.mode_of(j, ["inst"], "c_mktsegment").select("inst", F.col("c_mktsegment").alias("usual")), "inst")


CARD_SQL = BEST_SQL + """, com AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS community), j AS (SELECT d.doc_id, best, quality, d.doc_id % 5 = 0 AS fresh, lang <> 'en' AS region, s2 > 0 AND s2 >= 0.75 * best_score AS conf, best_score FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN labels USING (doc_id)),
 card AS (SELECT community, count(doc_id) AS n, count(*) FILTER (WHERE fresh) AS fresh, count(*) FILTER (WHERE quality = 1) AS high, count(*) FILTER (WHERE region) AS region FROM com LEFT JOIN j ON best = community GROUP BY 1)"""


def assigned(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5 == 0).alias("fresh"), (F.col("lang") != "en").alias("region"), "n_chars")
    return d.join(best(spark, sf), "doc_id", "left").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


def cards(spark, sf):
    com = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "community string")
    j = assigned(spark, sf).groupBy(F.col("best").alias("community")).agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"), F.count_if(F.col("quality") == 1).alias("high"), F.count_if("region").alias("region"))
    return com.join(j, "community", "left").fillna(0)


@query("d14_community_weekly", f"WITH {CARD_SQL} SELECT coalesce(best, 'unassigned') AS community, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS high FROM j WHERE fresh GROUP BY 1")
def d14(spark, sf):
    return assigned(spark, sf).where("fresh").groupBy(F.coalesce("best", F.lit("unassigned")).alias("community")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("high"))


@query("d15_assignment_audit", f"WITH {CARD_SQL} SELECT count(*) FILTER (WHERE best IS NULL) AS unassigned, count(*) FILTER (WHERE best_score < 2) AS low, count(*) FILTER (WHERE conf) AS conflicts, count(*) FILTER (WHERE best IS NULL AND fresh) AS fresh_unassigned, (SELECT count(*) FROM card WHERE n > 0.25 * (SELECT count(*) FROM j WHERE best IS NOT NULL)) AS oversized FROM j")
def d15(spark, sf):
    a = assigned(spark, sf)
    whole = a.agg(F.count_if(F.col("best").isNull()).alias("unassigned"), F.count_if(F.col("best_score") < 2).alias("low"), F.count_if("in_conflict").alias("conflicts"), F.count_if(F.col("best").isNull() & F.col("fresh")).alias("fresh_unassigned"))
    sizes = a.where("best is not null").groupBy("best").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each community
    return whole.crossJoin(F.broadcast(sizes.withColumn("t", total).agg(F.count_if(F.col("n") > 0.25 * F.col("t")).alias("oversized"))))  # one row each


@query("d16_emerging_terms", f"""WITH {BEST_SQL}, t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{{5,}}'))) AS term FROM documents WHERE doc_id % 5 = 0 AND doc_id NOT IN (SELECT doc_id FROM best WHERE best_score >= 6))
 SELECT term, count(*) AS n FROM t WHERE term NOT IN ('there', 'which') GROUP BY 1 ORDER BY n DESC, term LIMIT 15""")
def d16(spark, sf):
    """Terms of added rows that no group was assigned: those with a best score below 6."""
    every = table(spark, sf, "documents")
    added = every.join(every.where("doc_id % 5 <> 0").select("doc_id"), "doc_id", "left_anti")
    d = added.join(best(spark, sf).where("best_score >= 6").select("doc_id"), "doc_id", "left_anti")
    t = d.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.substring_index("text", "\n", 1)), F.lit("[a-z]{5,}"), 0))).alias("term"))
    stop = spark.createDataFrame([("there",), ("which",)], "term string")
    return t.join(stop, "term", "left_anti").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(15)


@query("d17_coverage_gaps", f"WITH {CARD_SQL} SELECT best AS community FROM j WHERE best IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE region AND quality = 0) = 0")
def d17(spark, sf):
    a = assigned(spark, sf).where("best is not null").groupBy(F.col("best").alias("community")).agg(F.count_if(F.col("region") & (F.col("quality") == 0)).alias("n"))
    return a.where("n = 0").select("community")


@query("d18_candidate_list", f"WITH {CARD_SQL} SELECT community AS name, 'card' AS kind, 'high' AS confidence FROM card UNION ALL (SELECT term, 'term', 'low' FROM (SELECT unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{{9,}}')) AS term FROM documents) GROUP BY term ORDER BY count(*) DESC, term LIMIT 8)")
def d18(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.substring_index("text", "\n", 1)), F.lit("[a-z]{9,}"), 0)).alias("name"))
    few = t.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(8)
    return cards(spark, sf).select(F.col("community").alias("name"), F.lit("card").alias("kind"), F.lit("high").alias("confidence")).unionByName(few.select("name", F.lit("term").alias("kind"), F.lit("low").alias("confidence")))


NODE_SQL = "mem AS (SELECT DISTINCT l_orderkey AS item, s_nationkey AS node FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
EDGE_SQL = NODE_SQL + ", edg AS (SELECT x.node AS a, y.node AS b, count(*) AS n FROM mem x JOIN mem y ON x.item = y.item AND x.node < y.node GROUP BY ALL)"


def memberships(spark, sf):
    return authors(spark, sf).select(F.col("paper").alias("item"), F.col("inst").alias("node")).distinct()


KINDS_SQL = "kin AS (SELECT n_nationkey AS node, ['drug', 'topic', 'level', 'place', 'group'][n_regionkey + 1] AS kind, n_regionkey AS p FROM nation)"


def kinds(spark, sf):
    names = F.array(*[F.lit(x) for x in ("drug", "topic", "level", "place", "group")])
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), names[F.col("n_regionkey")].alias("kind"))


PRIORITY = {"drug": 0, "topic": 1, "level": 2, "place": 3, "group": 4}


@query("d21_evidence_matrix", f"""WITH {EDGE_SQL}, {KINDS_SQL}, t AS (SELECT CASE WHEN kb.p < ka.p THEN b ELSE a END AS source, CASE WHEN kb.p < ka.p THEN a ELSE b END AS target, CASE WHEN kb.p < ka.p THEN kb.kind ELSE ka.kind END AS source_kind,
   CASE WHEN kb.p < ka.p THEN ka.kind ELSE kb.kind END AS target_kind, n FROM edg JOIN kin ka ON ka.node = a JOIN kin kb ON kb.node = b) SELECT * FROM t WHERE source_kind <> target_kind ORDER BY n DESC, source, target LIMIT 180""")
def d21(spark, sf):
    e = graphs.directed(graphs.pairs(memberships(spark, sf), "item", "node"), kinds(spark, sf), PRIORITY)
    return e.where("source_kind <> target_kind").orderBy(F.desc("n"), "source", "target").limit(180)


@query("d22_graph_health", f"""WITH {EDGE_SQL}, {KINDS_SQL}, ends AS (SELECT a AS node, b AS other, n FROM edg UNION ALL SELECT b, a, n FROM edg), g AS (SELECT node, count(*) AS degree, CAST(sum(n) AS BIGINT) AS weight, count(*) FILTER (WHERE n < 10) AS weak FROM ends GROUP BY 1),
 req AS (SELECT unnest(['drug', 'level', 'topic']) AS need), h AS (SELECT DISTINCT e.node, kind FROM ends e JOIN kin k ON k.node = other), miss AS (SELECT k.node, string_agg(need, ',' ORDER BY need) AS missing FROM kin k CROSS JOIN req ANTI JOIN h ON h.node = k.node AND h.kind = need GROUP BY 1)
 SELECT k.node, coalesce(degree, 0) AS degree, coalesce(weight, 0) AS weight, coalesce(weak, 0) AS weak, coalesce(weight >= 0.09 * (SELECT sum(n) FROM edg), false) AS oversized, degree IS NULL AS isolated, coalesce(degree, 0) < 20 AS low_degree, coalesce(missing, '') AS missing
 FROM kin k LEFT JOIN g USING (node) LEFT JOIN miss ON miss.node = k.node""")
def d22(spark, sf):
    e = graphs.pairs(memberships(spark, sf), "item", "node")
    return graphs.health(e, kinds(spark, sf), ["drug", "level", "topic"], weak_below=10, share=0.09, least=20).drop("kind").withColumn("missing", F.array_join("missing", ","))


@query("d25_regional_heat", f"""WITH {ROLE_SQL}, h AS (SELECT n_regionkey AS region, inst, author, count(*) AS n, count(DISTINCT paper) AS p FROM ro JOIN nation ON inst = n_nationkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY region, inst ORDER BY p DESC, author) AS rn FROM h),
 g AS (SELECT n_regionkey AS region, inst, count(DISTINCT paper) AS papers FROM ro JOIN nation ON inst = n_nationkey GROUP BY ALL), a AS (SELECT region, inst, count(*) AS hospitals, CAST(sum(n) AS BIGINT) AS occurrences, string_agg(CAST(author AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 8) AS top_hospitals FROM r GROUP BY ALL)
 SELECT region, inst, hospitals, papers, occurrences, top_hospitals, round(100 * papers / sum(papers) OVER (PARTITION BY region), 4) AS percent FROM a JOIN g USING (region, inst)""")
def d25(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("inst"), F.col("n_regionkey").alias("region"))
    place = ["region", "inst"]
    one = authors(spark, sf).groupBy("inst", "author", "paper").agg(F.count("*").alias("n")).join(F.broadcast(n), "inst")
    h = one.groupBy(*place, "author").agg(F.sum("n").alias("n"), F.count("*").alias("p"))
    papers = one.select(*place, "paper").distinct().groupBy(*place).agg(F.count("*").alias("papers"))
    best8 = ranking.top_k(h, place, [F.desc("p"), F.asc("author")], 8).groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("rank", "author"))).alias("t"))
    a = h.groupBy(*place).agg(F.count("*").alias("hospitals"), F.sum("n").alias("occurrences")).join(papers, place)
    a = a.join(best8.select(*place, F.array_join(F.transform("t", lambda x: x["author"].cast("string")), ",").alias("top_hospitals")), place)
    return a.withColumn("percent", F.round(100 * F.col("papers") / F.sum("papers").over(Window.partitionBy("region")), 4))  # a row for each place


@query("d26_network_audit", f"WITH {ROLE_SQL} SELECT coalesce(role, 'middle') AS role, count(*) AS n, round(count(*) / (SELECT count(*) FROM ro), 6) AS share FROM ro GROUP BY 1")
def d26(spark, sf):
    g = authors(spark, sf).groupBy(F.coalesce("role", F.lit("middle")).alias("role")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # three rows


@query("d27_province_rollup", f"""WITH {ROLE_SQL}, j AS (SELECT n_regionkey AS region, inst, paper FROM ro JOIN nation ON inst = n_nationkey), h AS (SELECT region, inst, count(DISTINCT paper) AS n FROM j GROUP BY ALL),
 t AS (SELECT region, string_agg(inst || ':' || n, ',' ORDER BY n DESC, inst) AS top_places FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, inst) <= 3) GROUP BY 1)
 SELECT region, count(DISTINCT paper) AS papers, count(DISTINCT inst) AS places, any_value(top_places) AS top_places FROM j JOIN t USING (region) GROUP BY 1""")
def d27(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("inst"), F.col("n_regionkey").alias("region"))
    papers = authors(spark, sf).select("paper", "inst").distinct().join(F.broadcast(n), "inst")
    by_place = papers.groupBy("region", "inst").agg(F.count("*").alias("n"))
    best3 = ranking.top_k(by_place, ["region"], [F.desc("n"), F.asc("inst")], 3).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("rank", "inst", "n"))).alias("t"))
    leading = best3.select("region", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["inst"].cast("string"), x["n"].cast("string"))), ",").alias("top_places"))
    places = by_place.groupBy("region").agg(F.count("*").alias("places"))
    return papers.select("region", "paper").distinct().groupBy("region").agg(F.count("*").alias("papers")).join(places, "region").join(leading, "region")


@query("d29_active_pipeline", """WITH t AS (SELECT p_brand AS drug, l_orderkey AS trial, max(p_size) AS phase FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND p_size >= 10 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_partkey % 100 = 0) GROUP BY ALL),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY drug ORDER BY phase DESC, trial) AS INT) AS rank FROM t) SELECT drug, trial, phase, rank FROM r WHERE rank <= 5""")
def d29(spark, sf):
    p = table(spark, sf, "part")
    approved = p.where("p_size = 50 and p_partkey % 100 = 0").select("p_brand")
    live = p.where("p_size >= 10").join(approved, "p_brand", "left_anti")
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey", "left_semi").join(live, F.col("l_partkey") == F.col("p_partkey"))
    g = t.groupBy(F.col("p_brand").alias("drug"), F.col("l_orderkey").alias("trial")).agg(F.max("p_size").alias("phase"))
    return ranking.top_k(g, ["drug"], [F.desc("phase"), F.asc("trial")], 5)


@query("d30_trial_insights", "WITH a AS (SELECT max(o_orderdate) AS d FROM orders) SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS recruiting, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= CAST(CAST(d AS DATE) - INTERVAL 6 MONTH AS DATE)) AS recent, arg_min(o_orderpriority, (-n, o_orderpriority)) AS top_places FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), a")
def d30(spark, sf):
    o = table(spark, sf, "orders")
    last = o.agg(F.to_date(F.max("o_orderdate")).alias("last"))
    counts = o.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("o_orderstatus") == "O").alias("recruiting"), F.count_if(F.to_date("o_orderdate") >= F.add_months("last", -6)).alias("recent"))  # one row
    top = o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(1).select(F.col("o_orderpriority").alias("top_places"))
    return counts.crossJoin(F.broadcast(top))


@query("d33_competitive_matrix", f"WITH {SCORED_SQL} SELECT label AS drug, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS high, count(*) FILTER (WHERE lang <> 'en') AS region, CASE WHEN count(*) >= 500 THEN 'deep' WHEN count(*) >= 100 THEN 'some' ELSE 'thin' END AS depth FROM scored JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY 1")
def d33(spark, sf):
    j = scored(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = j.groupBy(F.col("label").alias("drug")).agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("high"), F.count_if(F.col("lang") != "en").alias("region"))
    return g.withColumn("depth", rules.cascade([("deep", F.col("total") >= 500), ("some", F.col("total") >= 100)], "thin"))


@query("d34_question_matrix", f"WITH {HITS_SQL}, h AS (SELECT label AS question, doc_id, count(*) AS hits FROM hits GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY hits DESC, doc_id DESC) AS INT) AS rank FROM h) SELECT * FROM r WHERE rank <= 6")
def d34(spark, sf):
    m = rules.matched_rules(table(spark, sf, "documents"), "doc_id", "text", TERMS)
    h = m.groupBy(F.col("label").alias("question"), "doc_id").agg(F.count("*").alias("hits")).where("hits >= 2")
    return ranking.top_k(h, ["question"], [F.desc("hits"), F.desc("doc_id")], 6)


@query("d35_summary_counts", "SELECT 'lang' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'total', 'all', count(*) FROM documents")
def d35(spark, sf):
    d = table(spark, sf, "documents").withColumn("total", F.lit("all"))
    return gates.cross_filtered_counts(d, {"lang": "lang", "source": "source", "total": "total"}, {}).select(F.col("facet").alias("kind"), F.col("value").alias("name"), "n")


@query("d36_coverage_rollup", f"WITH {CARD_SQL} SELECT community, count(DISTINCT source) AS topics, count(DISTINCT CASE WHEN j.quality = 1 THEN source END) AS confident FROM com LEFT JOIN j ON best = community LEFT JOIN documents d ON d.doc_id = j.doc_id GROUP BY 1")
def d36(spark, sf):
    a = assigned(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy(F.col("best").alias("community")).agg(F.countDistinct("source").alias("topics"), F.countDistinct(F.when(F.col("quality") == 1, F.col("source"))).alias("confident"))
    return cards(spark, sf).select("community").join(a, "community", "left").fillna(0)


@query("d38_conflict_pairs", f"WITH {BEST_SQL} SELECT best AS main, second, count(*) AS n FROM best WHERE second IS NOT NULL GROUP BY ALL ORDER BY n DESC, main, second LIMIT 12")
def d38(spark, sf):
    return best(spark, sf).where("second is not null").groupBy(F.col("best").alias("main"), "second").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "main", "second").limit(12)


@query("d42_distribution", "SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS level, lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def d42(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("level"), "lang").agg(F.count("*").alias("n"))


@query("d45_key_publications", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(split_part(text, chr(10), 1)), 'tion') AND NOT contains(text, ' | ') ORDER BY n_chars DESC, doc_id LIMIT 30")
def d45(spark, sf):
    d = table(spark, sf, "documents").where(rules.has(F.lower(F.substring_index("text", "\n", 1)), "tion") & ~rules.has(F.col("text"), " | "))
    return d.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(30)


@query("d47_topic_bridge", f"WITH {SCORED_SQL} SELECT label AS node, count(DISTINCT source) AS topics, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM scored JOIN documents USING (doc_id) GROUP BY 1")
def d47(spark, sf):
    j = scored(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy(F.col("label").alias("node")).agg(F.countDistinct("source").alias("topics"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("names"))


@query("d48_strength_index", f"WITH {CLUSTER_SQL}, first AS (SELECT source, arg_min(strength, doc_id) AS s FROM sig GROUP BY 1) SELECT d.doc_id, coalesce(sig.strength, first.s) AS strength FROM documents d LEFT JOIN sig USING (doc_id) LEFT JOIN first ON first.source = d.source")
def d48(spark, sf):
    s = signals(spark, sf)
    first = s.groupBy("source").agg(F.min_by("strength", "doc_id").alias("s"))
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.join(s.select("doc_id", "strength"), "doc_id", "left").join(first, "source", "left").select("doc_id", F.coalesce("strength", "s").alias("strength"))


@query("e1_top_references", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents) WHERE rank <= 8")
def e1(spark, sf):
    return ranking.top_k(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 8).select("source", "doc_id", "rank")


@query("e3_keep_best", "SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id FROM events GROUP BY 1")
def e3(spark, sf):
    return ranking.keep_best(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc_nulls_last("value"), F.asc("event_id")]).select("user_id", "event_id")


@query("e4_argmax_member", "SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS part FROM part GROUP BY 1")
def e4(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("part"))


@query("e5_modal_value", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS usual, max(n) AS n FROM c GROUP BY 1")
def e5(spark, sf):
    return ranking.mode_of(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", F.col("o_orderpriority").alias("usual"), "n")


@query("e6_composite_order", """WITH m AS (SELECT 'importance' AS mode, o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders UNION ALL SELECT 'newest', o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) FROM orders
  UNION ALL SELECT 'largest', o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) FROM orders) SELECT mode, o_orderkey, CAST(place AS INT) AS place FROM m WHERE place <= 50""")
def e6(spark, sf):
    modes = {
        "importance": [F.asc("o_orderpriority"), F.desc_nulls_last("o_totalprice")], "newest": [F.desc_nulls_last("o_orderdate"), F.asc("o_orderpriority")],
        "largest": [F.desc_nulls_last("o_totalprice"), F.desc_nulls_last("o_orderdate")],
    }
    return ranking.ordered_by_modes(table(spark, sf, "orders"), modes, "o_orderkey", 50)


@query("e7_review_queue", f"WITH {BEST_SQL}, q AS (SELECT doc_id, 'unassigned' AS reason, 0 AS p FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM best) UNION ALL SELECT doc_id, 'low', 1 FROM best WHERE best_score < 2 UNION ALL SELECT doc_id, 'conflict', 2 FROM best WHERE s2 > 0 AND s2 >= 0.75 * best_score) SELECT doc_id, arg_min(reason, p) AS reason FROM q GROUP BY 1 ORDER BY doc_id LIMIT 200")
def e7(spark, sf):
    b = best(spark, sf)
    un = table(spark, sf, "documents").select("doc_id").join(b, "doc_id", "left_anti")
    return ranking.first_reason([("unassigned", un), ("low", b.where("best_score < 2")), ("conflict", b.where("in_conflict"))], "doc_id").orderBy("doc_id").limit(200)


@query("e8_edge_quota", f"""WITH {EDGE_SQL}, pn AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 2), ends AS (SELECT a AS node, * FROM edg UNION ALL SELECT b, * FROM edg), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, a, b) AS rn FROM ends SEMI JOIN pn USING (node))
 (SELECT * FROM edg WHERE a % 2 = 0 ORDER BY n DESC, a, b LIMIT 60) UNION (SELECT * FROM edg WHERE b % 3 = 0 ORDER BY n DESC, a, b LIMIT 25) UNION SELECT a, b, n FROM r WHERE rn <= 10""")
def e8(spark, sf):
    e = graphs.pairs(memberships(spark, sf), "item", "node")
    order = [F.desc("n"), F.asc("a"), F.asc("b")]
    wanted = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("node"))
    classes = ranking.quotas(e, {"even": (F.col("a") % 2 == 0, 60), "third": (F.col("b") % 3 == 0, 25)}, order)
    ends = e.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "n").join(wanted, "node", "left_semi")
    return classes.unionByName(ranking.top_k(ends, ["node"], order, 10).select("a", "b", "n")).distinct()


TOP_SQL = EDGE_SQL + ", sel AS (SELECT * FROM edg ORDER BY n DESC, a, b LIMIT 40), ends AS (SELECT a AS node, b AS other, n FROM edg UNION ALL SELECT b, a, n FROM edg), mine AS (SELECT a AS node, b AS other FROM sel UNION ALL SELECT b, a FROM sel)"


@query("e9_coverage_top_up", f"WITH {TOP_SQL}, have AS (SELECT node, count(*) AS h FROM mine GROUP BY 1), r AS (SELECT e.node, e.other, e.n, row_number() OVER (PARTITION BY e.node ORDER BY e.n DESC, e.other) AS rn, coalesce(h, 0) AS h FROM ends e ANTI JOIN mine USING (node, other) LEFT JOIN have USING (node)) SELECT a, b, n FROM sel UNION SELECT least(node, other), greatest(node, other), n FROM r WHERE rn <= 4 - h")
def e9(spark, sf):
    e = graphs.pairs(memberships(spark, sf), "item", "node")
    return graphs.coverage_top_up(e.orderBy(F.desc("n"), "a", "b").limit(40), e, 4)


@query("e10_bridge_top_up", f"WITH {TOP_SQL}, {KINDS_SQL}, have AS (SELECT DISTINCT m.node, kind FROM mine m JOIN kin ON kin.node = other), l AS (SELECT e.node, e.other, e.n, k.kind, row_number() OVER (PARTITION BY e.node, k.kind ORDER BY e.n DESC, e.other) AS rn FROM ends e JOIN kin k ON k.node = e.other ANTI JOIN have h ON h.node = e.node AND h.kind = k.kind) SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b, n FROM l WHERE rn = 1")
def e10(spark, sf):
    e = graphs.pairs(memberships(spark, sf), "item", "node")
    return graphs.bridge_top_up(e.orderBy(F.desc("n"), "a", "b").limit(40), e, kinds(spark, sf))


@query("e11_quick_list", """WITH p AS (SELECT c_nationkey, c_custkey, count(*) FILTER (WHERE o_orderdate >= newest - INTERVAL 3 YEAR) AS recent, count(*) AS total, max(o_totalprice) AS top_value FROM (SELECT *, max(o_orderdate) OVER () AS newest FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
 u AS (SELECT 'recent' AS metric, c_nationkey AS region, c_custkey, CAST(recent AS DOUBLE) AS v FROM p UNION ALL SELECT 'total', c_nationkey, c_custkey, total FROM p UNION ALL SELECT 'top_value', c_nationkey, c_custkey, top_value FROM p), b AS (SELECT * FROM u UNION ALL SELECT metric, -1, c_custkey, v FROM u)
 SELECT metric, region, c_custkey, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY metric, region ORDER BY v DESC, c_custkey) AS INT) AS rank FROM b) WHERE rank <= 20""")
def e11(spark, sf):
    o = table(spark, sf, "orders")
    x = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("newest"))))  # one row
    p = x.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderdate") >= F.expr("newest - interval 3 year")).alias("recent"), F.count("*").alias("total"), F.max("o_totalprice").alias("top_value"))
    p = p.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return ranking.quick_lists(p, "c_custkey", "c_nationkey", ["recent", "total", "top_value"], 20)


@query("e12_search_ranking", """WITH p AS (SELECT p_partkey, p_size, lower(p_name) AS name, lower(concat_ws(' ', p_name, p_type, p_brand)) AS t FROM part), q AS (SELECT *, list_filter(['anodized', 'a', 'steel', 'brand#1'], lambda w: contains(t, w)) AS hits FROM p)
 SELECT p_partkey, score FROM (SELECT p_partkey, CAST(3 * len(hits) + CASE WHEN len(hits) = 4 THEN 6 ELSE 0 END + CASE WHEN contains(regexp_replace(name, '[^a-z0-9]', '', 'g'), 'anodizedasteelbrand1') THEN 12 ELSE 0 END
   + CASE WHEN starts_with(name, 'anodized') THEN 4 ELSE 0 END + p_size // 10 AS INT) AS score FROM q) ORDER BY score DESC, p_partkey LIMIT 40""")
def e12(spark, sf):
    score = ranking.search_score("Anodized a steel  Brand#1", F.col("p_name"), F.concat_ws(" ", "p_name", "p_type", "p_brand"), F.expr("p_size div 10"))
    return table(spark, sf, "part").select("p_partkey", score.cast("int").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(40)


@query("e13_neighbourhood", f"WITH {EDGE_SQL}, s AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 2), t AS (SELECT * FROM edg WHERE n >= 30) SELECT node FROM s UNION SELECT b FROM t WHERE a IN (SELECT node FROM s) UNION SELECT a FROM t WHERE b IN (SELECT node FROM s)")
def e13(spark, sf):
    seeds = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("node"))
    return graphs.neighbourhood(seeds, graphs.pairs(memberships(spark, sf), "item", "node", 30))


@query("e14_subgraph", f"WITH {EDGE_SQL}, k AS (SELECT * FROM edg WHERE n >= 10), d AS (SELECT node, sum(n) AS w FROM (SELECT a AS node, n FROM k UNION ALL SELECT b, n FROM k) GROUP BY 1 ORDER BY w DESC, node LIMIT 10) SELECT a, b, n FROM k WHERE a IN (SELECT node FROM d) AND b IN (SELECT node FROM d)")
def e14(spark, sf):
    return graphs.subgraph(graphs.pairs(memberships(spark, sf), "item", "node"), F.col("n") >= 10, 10)[1]


@query("e15_paging", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 75")
def e15(spark, sf):
    return ranking.page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 25).select("o_orderkey")

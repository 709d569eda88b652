"""Queries of the concept graph, the collaboration network, expert profiles and community cards (inventory D10, D13, D19, D20, D23, D24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import graphs, ranking, rules
from marlstone.plans.aggregate_queries import CARD_SQL, KINDS_SQL, NODE_SQL, ROLE_SQL, assigned, authors, cards, kinds, memberships
from marlstone.plans.registering import Group, table
from marlstone.plans.trial_queries import DRUGS, K, choice

group = Group()
query = group.add

ROOT = 19
LEVELS = ["I", "II", "III", "IV"]
LEVEL = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' WHEN '4' THEN 'IV' END"
SCORE = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 8.0 WHEN '2' THEN 5.0 WHEN '3' THEN 3.0 WHEN '4' THEN 1.5 ELSE 0.5 END"
DAY = "substring(concat('', o_orderdate), 1, 10)"
ITEM_SQL = f"art AS (SELECT {K} AS item, {LEVEL} AS level, CAST({SCORE} AS DOUBLE) AS score, {DAY} AS day, o_orderstatus AS study FROM orders)"
LEAST_NODE = [(("drug",), 2), (("topic",), 5), (("level",), 8), (("place",), 4), (("group",), 1)]
LEAST_EDGE = [(("drug",), 2), (("level",), 5)]
RELATIONS = [(("drug", "topic"), "studied in"), (("drug", "place"), "reported at"), (("drug", "level"), "evidence"), (("topic", "place"), "found in"), (("group", "topic"), "form"), (("level",), "evidence")]


def top_sql(rows: str, by: str, value: str, item: str, k: int, name: str) -> str:
    """The k values with the most distinct items of each group, as text."""
    return f"""{name} AS (SELECT {by}, string_agg({value} || ':' || n, ',' ORDER BY n DESC, {value}) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, {value}) AS rn FROM
 (SELECT {by}, {value}, count(DISTINCT {item}) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL)) WHERE rn <= {k} GROUP BY ALL)"""


def text_of(counts: str) -> Column:
    """An array of struct(value, n) as text."""
    return F.coalesce(F.array_join(F.transform(counts, lambda x: F.concat(x["value"].cast("string"), F.lit(":"), x["n"].cast("string"))), ","), F.lit("")).alias(counts)


def articles(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(f"{K} AS item", f"{LEVEL} AS level", f"CAST({SCORE} AS DOUBLE) AS score", f"date_format(o_orderdate, 'yyyy-MM-dd') AS day", "o_orderstatus AS study")


def rooted(spark, sf) -> DataFrame:
    """Memberships of the articles that have the root concept and another one."""
    m = memberships(spark, sf)
    kept = m.groupBy("item").agg(F.bool_or(F.col("node") == ROOT).alias("root"), F.count("*").alias("n")).where("root and n >= 2")
    return m.join(kept.select("item"), "item", "left_semi")


ROOTED_SQL = f"{NODE_SQL}, kept AS (SELECT item FROM mem GROUP BY 1 HAVING bool_or(node = {ROOT}) AND count(*) >= 2), rooted AS (SELECT * FROM mem SEMI JOIN kept USING (item)), {KINDS_SQL}, {ITEM_SQL}"


@query(
    "d19_graph_nodes",
    f"""WITH {ROOTED_SQL}, x AS (SELECT node, art.* FROM rooted JOIN art USING (item)), {top_sql('x', 'node', 'study', 'item', 4, 'studies')},
     hist AS (SELECT node, string_agg(coalesce(level, 'none') || ':' || n, ',' ORDER BY level NULLS LAST) AS levels FROM (SELECT node, level, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1),
     refs AS (SELECT node, string_agg(CAST(item AS VARCHAR), ',' ORDER BY rn) AS refs FROM (SELECT node, item, row_number() OVER (PARTITION BY node ORDER BY level NULLS LAST, day DESC, item) AS rn FROM x) WHERE rn <= 8 GROUP BY 1),
     g AS (SELECT node, count(*) AS n, count(*) FILTER (WHERE level IN ('I', 'II')) AS high, max(day) AS updated FROM x GROUP BY 1)
     SELECT node, kind, n, levels, coalesce(studies, '') AS studies, CASE WHEN n >= 40 AND high >= 3 THEN 'high' WHEN n >= 12 OR high >= 1 THEN 'medium' ELSE 'low' END AS confidence, updated, refs
     FROM g JOIN kin USING (node) JOIN hist USING (node) JOIN refs USING (node) LEFT JOIN studies USING (node) WHERE n >= CASE kind WHEN 'drug' THEN 2 WHEN 'topic' THEN 5 WHEN 'level' THEN 8 WHEN 'place' THEN 4 ELSE 1 END""",
)
def d19(spark, sf):
    """Concepts of the articles that have the root concept: how many, of which levels and study types, how sure, how new, and the eight best references."""
    x = rooted(spark, sf).join(articles(spark, sf), "item")
    g = x.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("I", "II")).alias("high"), F.max("day").alias("updated"))
    hist = x.groupBy("node", "level").agg(F.count("*").alias("c")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit("none")).alias("value"), F.col("c").alias("n")))).alias("levels"))  # five levels at most
    studies = ranking.counted_lists(x, ["node"], "study", "item", 4, "studies")
    refs = ranking.top_lists(x, ["node"], [F.asc_nulls_last("level"), F.desc("day"), F.asc("item")], 8, F.col("item").cast("string"), "refs")
    j = g.join(kinds(spark, sf), "node").join(hist, "node").join(refs, "node").join(studies, "node", "left")
    sure = rules.cascade([("high", (F.col("n") >= 40) & (F.col("high") >= 3)), ("medium", (F.col("n") >= 12) | (F.col("high") >= 1))], "low")
    kept = j.where(F.col("n") >= graphs.by_kinds(F.col("kind"), F.col("kind"), LEAST_NODE, 5))
    return kept.select("node", "kind", "n", text_of("levels"), text_of("studies"), sure.alias("confidence"), "updated", F.array_join("refs", ",").alias("refs"))


def kinds_sql(rows: list, default: str) -> str:
    one = lambda k: f"(ka = '{k}' OR kb = '{k}')"
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {' AND '.join([*map(one, ks), *(['ka <> kb'] if len(ks) == 2 else [])])} THEN {value(v)}" for ks, v in rows) + f" ELSE {value(default)} END"


@query(
    "d20_graph_edges",
    f"""WITH {ROOTED_SQL}, p AS (SELECT x.node AS a, y.node AS b, art.* FROM rooted x JOIN rooted y ON x.item = y.item AND x.node < y.node JOIN art ON art.item = x.item),
     g AS (SELECT a, b, count(*) AS n, min(level) AS best_level, count(*) FILTER (WHERE level IN ('I', 'II')) AS high, round(sum(score), 1) AS score, max(day) AS updated FROM p GROUP BY ALL),
     k AS (SELECT g.*, ka.kind AS ka, kb.kind AS kb FROM g JOIN kin ka ON ka.node = a JOIN kin kb ON kb.node = b WHERE NOT (ka.kind = 'level' AND kb.kind = 'level'))
     SELECT a, b, {kinds_sql(RELATIONS, 'named together')} AS relation, n, best_level, high, score, updated, CASE WHEN n >= 12 AND high >= 2 THEN 'high' WHEN n >= 5 OR best_level IN ('I', 'II') THEN 'medium' ELSE 'low' END AS confidence
     FROM k WHERE n >= {kinds_sql(LEAST_EDGE, 4)}""",
)
def d20(spark, sf):
    return graphs.evidence_edges(rooted(spark, sf), articles(spark, sf), kinds(spark, sf), "item", "node", LEVELS, "level", LEAST_EDGE, RELATIONS, 4, "named together")


NET_SQL = f"""{ROLE_SQL}, ppr AS (SELECT {K} AS paper, {DAY} AS day, o_orderpriority AS topic, {choice(DRUGS, K)} AS drugs FROM orders),
 net AS (SELECT ro.*, day, topic, drugs, concat('city ', author % 4) AS city FROM ro JOIN ppr USING (paper)), gra AS (SELECT * FROM net WHERE role IS NOT NULL), drg AS (SELECT paper, inst, unnest(list_filter(string_split(drugs, ';'), lambda x: x <> '')) AS drug FROM gra)"""


def network(spark, sf) -> DataFrame:
    """Authors with their paper's day, topic and drugs, and their city."""
    p = table(spark, sf, "orders").selectExpr(f"{K} AS paper", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "o_orderpriority AS topic", f"{choice(DRUGS, K)} AS drugs")
    return authors(spark, sf).join(p, "paper").withColumn("city", F.concat(F.lit("city "), (F.col("author") % 4).cast("string")))


def drugs_of(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode(F.filter(F.split("drugs", ";"), lambda d: d != "")).alias("drug"))


@query(
    "d23_network_nodes",
    f"""WITH {NET_SQL}, {top_sql('gra', 'inst', 'author', 'paper', 5, 'top_authors')}, {top_sql('gra', 'inst', 'topic', 'paper', 3, 'topics')}, {top_sql('drg', 'inst', 'drug', 'paper', 50, 'drug_papers')}, {top_sql('net', 'inst', 'city', 'paper', 1, 'location')},
     new AS (SELECT inst, string_agg(CAST(paper AS VARCHAR), ',' ORDER BY rn) AS newest FROM (SELECT inst, paper, row_number() OVER (PARTITION BY inst ORDER BY day DESC, paper DESC) AS rn FROM (SELECT DISTINCT inst, paper, day FROM gra)) WHERE rn <= 200 GROUP BY 1),
     m AS (SELECT DISTINCT paper, inst FROM gra), deg AS (SELECT x.inst, count(DISTINCT y.inst) AS degree FROM m x JOIN m y ON x.paper = y.paper AND x.inst <> y.inst GROUP BY 1),
     g AS (SELECT inst, count(DISTINCT paper) AS all_papers, count(DISTINCT paper) FILTER (WHERE role IS NOT NULL) AS papers, count(DISTINCT paper) FILTER (WHERE role = 'first') AS first_papers, count(DISTINCT paper) FILTER (WHERE role = 'last') AS last_papers FROM net GROUP BY 1)
     SELECT g.*, coalesce(degree, 0) AS degree, coalesce(top_authors, '') AS top_authors, coalesce(topics, '') AS topics, coalesce(drug_papers, '') AS drug_papers, coalesce(location, '') AS location, coalesce(newest, '') AS newest
     FROM g LEFT JOIN deg USING (inst) LEFT JOIN top_authors USING (inst) LEFT JOIN topics USING (inst) LEFT JOIN drug_papers USING (inst) LEFT JOIN location USING (inst) LEFT JOIN new USING (inst)""",
)
def d23(spark, sf):
    """Hospitals: papers of all authors, of graph authors and by role, collaborators, the usual authors, topics, drugs and place, and the newest 200 papers."""
    net = network(spark, sf)
    gra = net.where("role is not null")
    # one row for each paper of a hospital, then plain sums
    by_paper = net.groupBy("inst", "paper").agg(F.bool_or(F.col("role").isNotNull()).alias("graph"), F.bool_or(F.coalesce(F.col("role") == "first", F.lit(False))).alias("first"), F.bool_or(F.coalesce(F.col("role") == "last", F.lit(False))).alias("last"))
    g = by_paper.groupBy("inst").agg(F.count("*").alias("all_papers"), F.count_if("graph").alias("papers"), F.count_if("first").alias("first_papers"), F.count_if("last").alias("last_papers"))
    degree = graphs.degrees(graphs.pairs(gra, "paper", "inst")).select(F.col("node").alias("inst"), "degree")
    newest = ranking.top_lists(gra.select("inst", "paper", "day").distinct(), ["inst"], [F.desc("day"), F.desc("paper")], 200, F.col("paper").cast("string"), "newest")
    j = g.join(degree, "inst", "left").join(newest, "inst", "left")
    lists = {"top_authors": (gra, "author", 5), "topics": (gra, "topic", 3), "drug_papers": (drugs_of(gra), "drug", 50), "location": (net, "city", 1)}
    for name, (rows, value, k) in lists.items():
        j = j.join(ranking.counted_lists(rows, ["inst"], value, "paper", k, name), "inst", "left")
    return j.select("inst", "all_papers", "papers", "first_papers", "last_papers", F.coalesce("degree", F.lit(0)).alias("degree"), *[text_of(name) for name in lists], F.coalesce(F.array_join("newest", ","), F.lit("")).alias("newest"))


@query(
    "d24_network_edges",
    f"""WITH {NET_SQL}, m AS (SELECT DISTINCT paper, inst, day, topic, drugs FROM gra), p AS (SELECT x.inst AS a, y.inst AS b, x.paper, x.day, x.topic, x.drugs FROM m x JOIN m y ON x.paper = y.paper AND x.inst < y.inst),
     pa AS (SELECT a, b, p.paper, author FROM p JOIN gra ON gra.paper = p.paper AND gra.inst IN (a, b)), pd AS (SELECT a, b, paper, unnest(list_filter(string_split(drugs, ';'), lambda x: x <> '')) AS drug FROM p),
     {top_sql('pa', 'a, b', 'author', 'paper', 3, 'top_authors')}, {top_sql('p', 'a, b', 'topic', 'paper', 3, 'topics')}, {top_sql('pd', 'a, b', 'drug', 'paper', 50, 'drug_papers')}, g AS (SELECT a, b, count(*) AS n, max(day) AS latest FROM p GROUP BY ALL HAVING count(*) >= 2)
     SELECT g.*, CASE WHEN a % 2 = b % 2 THEN CASE a % 2 WHEN 0 THEN 'inner' ELSE 'outer' END ELSE 'inner,outer' END AS scopes, top_authors, topics, coalesce(drug_papers, '') AS drug_papers FROM g JOIN top_authors USING (a, b) JOIN topics USING (a, b) LEFT JOIN drug_papers USING (a, b)""",
)
def d24(spark, sf):
    """Pairs of hospitals with graph authors on the same papers: how many, the latest, the scopes of both ends, and the usual authors, topics and drugs."""
    gra = network(spark, sf).where("role is not null")
    p = graphs.item_pairs(gra, "paper", "inst").join(gra.select("paper", "day", "topic", "drugs").distinct(), "paper")
    g = p.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("day").alias("latest")).where("n >= 2")
    people = p.select("paper", "a", "b", F.explode(F.array("a", "b")).alias("inst")).join(gra.select("paper", "inst", "author"), ["paper", "inst"])
    scope = lambda c: F.when(F.col(c) % 2 == 0, "inner").otherwise("outer")
    j, lists = g, {"top_authors": (people, "author", 3), "topics": (p, "topic", 3), "drug_papers": (drugs_of(p), "drug", 50)}
    for name, (rows, value, k) in lists.items():
        j = j.join(ranking.counted_lists(rows, ["a", "b"], value, "paper", k, name), ["a", "b"], "left")
    return j.select("a", "b", "n", "latest", F.array_join(F.array_sort(F.array_distinct(F.array(scope("a"), scope("b")))), ",").alias("scopes"), *[text_of(name) for name in lists])


EXPERT_SQL = f"""x AS (SELECT o_custkey AS who, c_nationkey AS region, {K} AS paper, o_orderdate AS d, o_totalprice AS impact, o_orderpriority AS journal, {choice(DRUGS, K)} AS topics, concat('Name ', o_custkey, ' ', CASE WHEN {K} % 3 = 0 THEN 'A' ELSE 'B' END) AS alias, {K} % 4 = 0 AS regional,
   o_orderdate >= max(o_orderdate) OVER () - INTERVAL 3 YEAR AS recent FROM orders JOIN customer ON o_custkey = c_custkey), tp AS (SELECT who, paper, unnest(list_filter(string_split(topics, ';'), lambda t: t <> '')) AS topic FROM x)"""


@query(
    "d10_expert_profiles",
    f"""WITH {EXPERT_SQL}, {top_sql('x', 'who', 'alias', 'paper', 12, 'aliases')}, {top_sql('tp', 'who', 'topic', 'paper', 8, 'interests')}, {top_sql('x', 'who', 'journal', 'paper', 2, 'usual')},
     g AS (SELECT who, any_value(region) AS region, count(*) AS papers, count(*) FILTER (WHERE recent) AS recent, max(impact) AS impact, count(DISTINCT journal) AS journals, count(*) FILTER (WHERE regional) AS regional, arg_max(paper, (d, paper)) AS newest FROM x GROUP BY 1),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY papers DESC, recent DESC, impact DESC, who) AS INT) AS place FROM g), q AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY recent DESC, papers DESC, impact DESC, who) AS quick FROM r)
     SELECT 'E' || lpad(CAST(region AS VARCHAR), 2, '0') || '_' || lpad(CAST(place AS VARCHAR), 5, '0') AS id, who, regexp_extract(aliases, '^([^:]*)', 1) AS name, papers, recent, impact, journals, regional, newest, aliases, coalesce(interests, '') AS interests, usual, quick <= 20 AS quick
     FROM q JOIN aliases USING (who) LEFT JOIN interests USING (who) JOIN usual USING (who)""",
)
def d10(spark, sf):
    """Profiles of all authors: modal name and aliases, papers (all, of the last three years, of the region), highest impact, journals, interests and newest paper; numbered by region, the quick ones marked."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("who"), F.col("c_nationkey").alias("region"))
    o = table(spark, sf, "orders").selectExpr("o_custkey AS who", f"{K} AS paper", "o_orderdate AS d", "o_totalprice AS impact", "o_orderpriority AS journal", f"{choice(DRUGS, K)} AS drugs", f"concat('Name ', o_custkey, ' ', CASE WHEN {K} % 3 = 0 THEN 'A' ELSE 'B' END) AS alias", f"{K} % 4 = 0 AS regional")
    x = o.join(c, "who").crossJoin(F.broadcast(table(spark, sf, "orders").agg(F.max("o_orderdate").alias("last"))))  # one row
    by_journal = x.groupBy("who", "region", "journal").agg(
        F.count("*").alias("n"), F.count_if(F.col("d") >= F.expr("last - interval 3 year")).alias("r"), F.max("impact").alias("v"), F.count_if("regional").alias("g"), F.max(F.struct("d", "paper")).alias("new")
    )
    p = by_journal.groupBy("who", "region").agg(F.sum("n").alias("papers"), F.sum("r").alias("recent"), F.max("v").alias("impact"), F.count("journal").alias("journals"), F.sum("g").alias("regional"), F.max("new")["paper"].alias("newest"))
    for name, (rows, value, k) in {"aliases": (x, "alias", 12), "interests": (drugs_of(x), "drug", 8), "usual": (x, "journal", 2)}.items():
        p = p.join(ranking.counted_lists(rows, ["who"], value, "paper", k, name), "who", "left")
    ranked = ranking.placed_in(p, "region", [F.desc("papers"), F.desc("recent"), F.desc("impact"), F.asc("who")], "place")
    ranked = ranking.placed_in(ranked, "region", [F.desc("recent"), F.desc("papers"), F.desc("impact"), F.asc("who")], "quick")
    return ranked.select(
        F.format_string("E%02d_%05d", "region", "place").alias("id"), "who", F.get("aliases", F.lit(0))["value"].alias("name"), "papers", "recent", "impact", "journals", "regional", "newest", text_of("aliases"), text_of("interests"), text_of("usual"), (F.col("quick") <= 20).alias("quick")
    )


@query(
    "d13_community_cards",
    f"""WITH {CARD_SQL}, y AS (SELECT best AS community, j.doc_id, fresh, quality, n_chars, source AS study, CASE WHEN quality = 1 THEN 'I' WHEN quality = 0 THEN 'III' ELSE 'none' END AS level FROM j JOIN documents USING (doc_id) WHERE best IS NOT NULL), {top_sql('y', 'community', 'level', 'doc_id', 9, 'levels')}, {top_sql('y', 'community', 'study', 'doc_id', 6, 'studies')},
     refs AS (SELECT community, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS refs FROM (SELECT community, doc_id, row_number() OVER (PARTITION BY community ORDER BY level, n_chars DESC, doc_id) AS rn FROM y) WHERE rn <= 6 GROUP BY 1),
     news AS (SELECT community, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS new_refs FROM (SELECT community, doc_id, row_number() OVER (PARTITION BY community ORDER BY level, n_chars DESC, doc_id) AS rn FROM y WHERE fresh) WHERE rn <= 4 GROUP BY 1),
     a AS (SELECT c.*, CASE WHEN high > 0 AND fresh > 3 THEN 'active' WHEN fresh > 0 THEN 'watch' ELSE 'quiet' END AS activity, round(high / nullif(n, 0), 4) AS ratio FROM card c)
     SELECT a.*, coalesce(levels, '') AS levels, coalesce(studies, '') AS studies, coalesce(refs, '') AS refs, coalesce(new_refs, '') AS new_refs, CAST(row_number() OVER (ORDER BY CASE activity WHEN 'active' THEN 0 WHEN 'watch' THEN 1 ELSE 2 END, high DESC, fresh DESC, n DESC, community) AS INT) AS place
     FROM a LEFT JOIN levels USING (community) LEFT JOIN studies USING (community) LEFT JOIN refs USING (community) LEFT JOIN news USING (community)""",
)
def d13(spark, sf):
    """A card for each community, those without rows too: counts, activity, levels, the six usual study types, six references and four new ones, in the order in which they are shown."""
    y = assigned(spark, sf).where("best is not null").join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("study")), "doc_id").withColumnRenamed("best", "community")
    y = y.withColumn("level", rules.cascade([("I", F.col("quality") == 1), ("III", F.col("quality") == 0)], "none"))
    order = [F.asc("level"), F.desc("n_chars"), F.asc("doc_id")]
    c = cards(spark, sf)
    for name, value, k in (("levels", "level", 9), ("studies", "study", 6)):
        c = c.join(ranking.counted_lists(y, ["community"], value, "doc_id", k, name), "community", "left")
    c = c.join(ranking.top_lists(y, ["community"], order, 6, F.col("doc_id").cast("string"), "refs"), "community", "left")
    c = c.join(ranking.top_lists(y.where("fresh"), ["community"], order, 4, F.col("doc_id").cast("string"), "new_refs"), "community", "left")
    activity = rules.cascade([("active", (F.col("high") > 0) & (F.col("fresh") > 3)), ("watch", F.col("fresh") > 0)], "quiet")
    joined = lambda x: F.coalesce(F.array_join(x, ","), F.lit("")).alias(x)
    c = c.select("community", "n", "fresh", "high", "region", activity.alias("activity"), F.round(F.try_divide("high", "n"), 4).alias("ratio"), text_of("levels"), text_of("studies"), joined("refs"), joined("new_refs"))
    rank = F.when(F.col("activity") == "active", 0).when(F.col("activity") == "watch", 1).otherwise(2)
    return ranking.placed_in(c, None, [rank, F.desc("high"), F.desc("fresh"), F.desc("n"), F.asc("community")], "place")  # a row for each community

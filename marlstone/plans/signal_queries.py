"""Queries of signals and their clusters (inventory D3, D4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import classifiers as K
from marlstone.operators import ranking, rules
from marlstone.plans import study_rules as T
from marlstone.plans.classifier_queries import REC_SQL, records, tags_sql
from marlstone.plans.graph_queries import text_of, top_sql
from marlstone.plans.registering import Group
from marlstone.sources.shared import written

group = Group()
query = group.add

LEVEL_POINTS = {"I": 8.0, "II": 5.0, "III": 3.0, "IV": 1.5}
CASES = ("case_report", "case_series")
STRENGTHS = {"strong": 10.0, "medium": 4.0}
TIERS = {"strong": 1, "medium": 2, "weak": 3}
#: Days since a record's entry, and how many of them count as recent.
AGE, WINDOW = "doc_id % 45", 30

SIGNAL_SQL = f"""{REC_SQL}, lab AS (SELECT *, {T.map_sql('kind', T.LEVELS, 'none')} AS level FROM (SELECT *, {T.cascade_sql('low', T.STUDY_STEPS, 'other')} AS kind, {T.cascade_sql('low', T.CLUSTERS, 'other')} AS cluster, {tags_sql('low')} AS drugs, {T.flags_sql('low', T.INTENTS)} AS intents FROM rec)),
 str AS (SELECT *, CASE WHEN level IN ('I', 'II') AND drugs <> '' THEN 'strong' WHEN level IN ('I', 'II', 'III') THEN 'medium' ELSE 'weak' END AS strength, {AGE} AS age FROM lab),
 sig AS (SELECT *, round(CAST(coalesce(n_chars, 0) / 1000.0 AS DOUBLE) + {T.map_sql('level', {k: str(v) for k, v in LEVEL_POINTS.items()}, '0')}::DOUBLE + greatest(0, {WINDOW} - age) / 3.0::DOUBLE + CASE WHEN lang <> 'en' THEN 1.5 ELSE 0 END::DOUBLE - CASE WHEN kind IN {CASES} THEN 3 ELSE 0 END
   + CASE WHEN drugs <> '' THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(intents, ','), 'safety') THEN 1 ELSE 0 END + CASE strength WHEN 'strong' THEN 10 WHEN 'medium' THEN 4 ELSE 0 END, 3) AS score FROM str)"""


def signals(spark, sf):
    """Records with what makes a signal of them: impact, level, how recent they are, and whether they are of the region, a case, about a drug or its safety, and strong."""
    low = F.col("low")
    r = records(spark, sf).select(
        "doc_id", "lang", "n_chars", K.by_steps(low, T.STUDY_STEPS, "other").alias("kind"), K.by_steps(low, T.CLUSTERS, "other").alias("cluster"), rules.labels_hit(low, T.TAGS).alias("drugs"), K.flags(low, T.INTENTS).alias("intents"), F.expr(AGE).alias("age")
    )
    r = r.withColumn("level", K.level_of(F.col("kind"), T.LEVELS, "none"))
    some = F.size("drugs") > 0
    r = r.withColumn("strength", rules.cascade([("strong", F.col("level").isin("I", "II") & some), ("medium", F.col("level").isin("I", "II", "III"))], "weak"))
    points = lambda column, table: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column)), F.lit(0.0))
    flag = lambda test, x: F.when(F.coalesce(test, F.lit(False)), float(x)).otherwise(0.0)
    score = F.coalesce("n_chars", F.lit(0)) / 1000.0 + points("level", LEVEL_POINTS) + F.greatest(F.lit(0), WINDOW - F.col("age")) / 3.0 + flag(F.col("lang") != "en", 1.5) - flag(F.col("kind").isin(*CASES), 3)
    score = score + flag(some, 1) + flag(F.array_contains("intents", "safety"), 1) + points("strength", STRENGTHS)
    return r.withColumn("score", F.round(score, 3))


@query("d3_signal_scoring", f"WITH {SIGNAL_SQL} SELECT doc_id, score, strength FROM sig")
def d3(spark, sf):
    return signals(spark, sf).select("doc_id", "score", "strength")


@query(
    "d4_signal_clusters",
    f"""WITH {SIGNAL_SQL}, drg AS (SELECT doc_id, cluster, unnest(string_split(drugs, ',')) AS drug FROM sig WHERE drugs <> ''), kwd AS (SELECT doc_id, cluster, unnest(string_split(intents, ',')) AS keyword FROM sig WHERE intents <> ''),
     {top_sql('sig', 'cluster', 'level', 'doc_id', 9, 'levels')}, {top_sql('sig', 'cluster', 'kind', 'doc_id', 4, 'designs')}, {top_sql('drg', 'cluster', 'drug', 'doc_id', 12, 'agents')}, {top_sql('kwd', 'cluster', 'keyword', 'doc_id', 8, 'keywords')},
     top AS (SELECT cluster, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS top_members FROM (SELECT cluster, doc_id, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, doc_id) AS rn FROM sig) WHERE rn <= 5 GROUP BY 1),
     g AS (SELECT cluster, count(*) AS members, min(CASE strength WHEN 'strong' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS tier, round(max(score) + least(4, 0.8 * (count(*) - 1)), 3) AS score, min(age) AS newest, max(age) AS oldest FROM sig GROUP BY 1),
     o AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, cluster) AS place FROM g)
     SELECT 'L' || lpad(CAST(place AS VARCHAR), 2, '0') AS id, cluster, members, tier, score, newest, oldest, CASE WHEN tier = 1 AND members >= 3 THEN 5 WHEN tier = 1 THEN 4 WHEN tier = 2 AND members >= 3 THEN 3 WHEN tier = 2 THEN 2 ELSE 1 END AS points, levels, designs, coalesce(agents, '') AS agents, coalesce(keywords, '') AS keywords, top_members
     FROM o JOIN levels USING (cluster) JOIN designs USING (cluster) JOIN top USING (cluster) LEFT JOIN agents USING (cluster) LEFT JOIN keywords USING (cluster)""",
)
def d4(spark, sf):
    """Clusters of signals: the best member's strength, a score that grows with the members up to four points, the span of their ages, the mix of levels and designs, agents, keywords and the five best members."""
    s = written(signals(spark, sf).select("doc_id", "cluster", "level", "kind", "drugs", "intents", "strength", "score", "age"), "signals")  # texts are judged once
    tier = F.when(F.col("strength") == "strong", 1).when(F.col("strength") == "medium", 2).otherwise(3)
    g = s.groupBy("cluster").agg(
        F.count("*").alias("members"), F.min(tier).alias("tier"), F.round(F.max("score") + F.least(F.lit(4.0), 0.8 * (F.count("*") - 1)), 3).alias("score"), F.min("age").alias("newest"), F.max("age").alias("oldest")
    )
    each = lambda c, name: s.select("doc_id", "cluster", F.explode(c).alias(name))
    lists = {"levels": (s, "level", 9), "designs": (s, "kind", 4), "agents": (each("drugs", "drug"), "drug", 12), "keywords": (each("intents", "keyword"), "keyword", 8)}
    for name, (rows, value, k) in lists.items():
        g = g.join(ranking.counted_lists(rows, ["cluster"], value, "doc_id", k, name), "cluster", "left")
    g = g.join(ranking.top_lists(s, ["cluster"], [F.desc("score"), F.asc("doc_id")], 5, F.col("doc_id").cast("string"), "top_members"), "cluster")
    placed = ranking.placed_in(g, None, [F.asc("tier"), F.desc("score"), F.asc("cluster")], "place")  # a row for each cluster
    points = F.when((F.col("tier") == 1) & (F.col("members") >= 3), 5).when(F.col("tier") == 1, 4).when((F.col("tier") == 2) & (F.col("members") >= 3), 3).when(F.col("tier") == 2, 2).otherwise(1)
    return placed.select(F.format_string("L%02d", "place").alias("id"), "cluster", "members", "tier", "score", "newest", "oldest", points.alias("points"), *[text_of(n) for n in lists], F.array_join("top_members", ",").alias("top_members"))

"""Queries of communities: scores calibrated by flags, assignment, coverage of topics and fit to profiles (inventory C22, C27, H4, H6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import classifiers as K
from marlstone.operators import communities as C
from marlstone.operators import ranking
from marlstone.operators.communities import Adjustment, Forced
from marlstone.operators.rules import Rule, labels_hit
from marlstone.plans import study_rules as T
from marlstone.plans.classifier_queries import REC_SQL, records, tags_sql
from marlstone.plans.registering import Group, table

group = Group()
query = group.add

W = "word"
STRONG, NORMAL, WEAK = 4.0, 2.0, 1.0
BONUS = {STRONG: 1.5, NORMAL: 0.8}
ORDER = ["treatment", "access", "diagnosis", "safety", "biology"]
TERMS = {
    "treatment": {STRONG: ["veltoran", "placebo-controlled", "dorsuvimab"], NORMAL: ["randomized", "single arm", "add-on"], WEAK: ["patients"]},
    "access": {STRONG: ["cost-effectiveness", "budget impact"], NORMAL: ["reimbursement", "survey of"], WEAK: ["registry"]},
    "diagnosis": {STRONG: ["diagnostic accuracy", "nomogram"], NORMAL: ["sensitivity and specificity", "prediction model"], WEAK: ["cohort"]},
    "safety": {STRONG: ["adverse event reports", "disproportionality"], NORMAL: ["tolerability", "mortality"], WEAK: ["extension study"]},
    "biology": {STRONG: ["in vitro", "murine", "genome-wide"], NORMAL: ["polymorphism", "cell line", "pathway"], WEAK: ["animal"]},
}
RULES = [Rule(c, t, w, W) for c in ORDER for w, terms in TERMS[c].items() for t in terms]
#: What the text, or the title, is about: twelve flags of the text, eight of the title.
TEXT_FLAGS = [
    K.Step("heor", ("cost-effectiveness", "budget impact"), kind=W), K.Step("real_world", ("registry", "cohort", "chart review"), kind=W), K.Step("product", ("veltoran", "mirapexin", "mira-101", "dorsuvimab"), kind=W), K.Step("review", ("narrative review", "review of the literature"), kind=W),
    K.Step("compared", ("indirect comparison", "compared with"), kind=W), K.Step("diagnosing", ("diagnostic accuracy", "sensitivity and specificity"), kind=W), K.Step("subtype", ("subgroup", "phenotype"), kind=W), K.Step("harm", ("adverse event reports", "disproportionality"), kind=W),
    K.Step("incidental", ("no further detail",), kind=W), K.Step("pooled", ("were pooled",), kind=W), K.Step("survival", ("overall survival", "mortality"), kind=W), K.Step("laboratory", ("in vitro", "cell line", "murine"), no_terms=("patients",), kind=W),
]
TITLE_FLAGS = [
    K.Step("titled_product", ("veltoran", "mirapexin", "dorsuvimab"), kind=W), K.Step("titled_trial", ("randomized", "placebo-controlled", "single arm"), kind=W), K.Step("titled_review", ("systematic review", "narrative review", "meta-analysis"), kind=W), K.Step("titled_harm", ("adverse event reports",), kind=W),
    K.Step("titled_access", ("cost-effectiveness", "budget impact"), kind=W), K.Step("titled_case", ("case report", "case series"), kind=W), K.Step("titled_laboratory", ("in vitro", "murine", "genome-wide"), kind=W), K.Step("titled_guidance", ("practice guideline", "expert consensus"), kind=W),
]
ADJUSTMENTS = [
    Adjustment("treatment", ("product",), "add", 5), Adjustment("treatment", ("titled_product",), "add", 3), Adjustment("treatment", ("titled_product", "titled_trial"), "add", 13, ("heor", "real_world")), Adjustment("treatment", ("heor",), "times", 0.5),
    Adjustment("treatment", ("real_world",), "times", 0.75, ("titled_trial",)), Adjustment("treatment", ("review",), "times", 0.25, ("titled_product",)), Adjustment("treatment", ("incidental",), "times", 0.5, ("titled_product",)), Adjustment("treatment", ("laboratory",), "times", 0.25),
    Adjustment("access", ("titled_access",), "add", 8), Adjustment("access", ("heor", "compared"), "add", 4), Adjustment("access", ("titled_harm",), "times", 0.5), Adjustment("access", ("titled_case",), "times", 0.25),
    Adjustment("diagnosis", ("diagnosing",), "add", 6), Adjustment("diagnosis", ("subtype",), "add", 2), Adjustment("diagnosis", ("titled_trial",), "times", 0.5), Adjustment("diagnosis", ("titled_guidance",), "times", 1.25),
    Adjustment("safety", ("harm",), "add", 6), Adjustment("safety", ("survival",), "add", 1), Adjustment("safety", ("titled_harm",), "add", 4), Adjustment("safety", ("pooled",), "times", 0.75), Adjustment("safety", ("titled_review",), "times", 0.5),
    Adjustment("biology", ("laboratory",), "add", 5), Adjustment("biology", ("titled_laboratory",), "times", 1.5), Adjustment("biology", ("product",), "times", 0.5, ("laboratory",)),
]
FORCED = [Forced(("incidental",), 6.0, ("product",)), Forced(("titled_case",), 12.0, spared=("access",)), Forced(("titled_guidance",), 8.0)]
POPULATIONS = [Rule("animals", "mice", kind=W), Rule("animals", "murine", kind=W), Rule("cases", "consecutive cases", kind=W), Rule("cases", "case report", kind=W), Rule("patients", "patients", kind=W), Rule("patients", "participants", kind=W)]
MATURITY = {"I": "high", "II": "high", "III": "medium", "IV": "medium", "V": "early"}


def flagged(spark, sf):
    r = records(spark, sf)
    kind = K.by_steps(F.col("low"), T.STUDY_STEPS, "other")
    flags = F.concat(K.flags(F.col("low"), TEXT_FLAGS), K.flags(F.col("title"), TITLE_FLAGS))
    return r.select("doc_id", "low", "title", "lang", kind.alias("kind"), flags.alias("flags")).withColumn("level", K.level_of(F.col("kind"), T.LEVELS, "none"))


def scored(spark, sf):
    r = flagged(spark, sf)
    s = C.term_scores(r, "doc_id", "low", "title", RULES, BONUS, F.col("level").isin("I", "II", "III"), 0.8)
    return C.calibrated(s, r, "doc_id", ADJUSTMENTS)


def _flag_sql() -> str:
    named = {**{s.label: T.step_sql("low", s) for s in TEXT_FLAGS}, **{s.label: T.step_sql("title", s) for s in TITLE_FLAGS}}
    return ", ".join(f"{test} AS f_{name}" for name, test in named.items())


def _hit_sql() -> str:
    """A column for each term and text, made once."""
    return ", ".join(f"{T.hit_sql(col, (r.term,), W)} AS {pre}_{i}" for i, r in enumerate(RULES) for pre, col in (("x", "low"), ("t", "title")))


def _score_sql(c: str) -> str:
    mine = [(i, r) for i, r in enumerate(RULES) if r.label == c]
    parts = [f"CASE WHEN x_{i} THEN {r.weight} + CASE WHEN t_{i} THEN {BONUS.get(r.weight, 0.0)} ELSE 0 END ELSE 0 END" for i, r in mine]
    any_hit = " OR ".join(f"x_{i}" for i, _ in mine)
    hits = "list_sort(list_filter([" + ", ".join(f"CASE WHEN x_{i} THEN {T.quoted(r.term)} END" for i, r in mine) + "], lambda x: x IS NOT NULL))"
    out = f"SELECT *, CAST({' + '.join(parts)} + CASE WHEN level IN ('I', 'II', 'III') AND ({any_hit}) THEN 0.8 ELSE 0 END AS DOUBLE) AS s0, {hits} AS hits FROM flagged"
    steps = [a for a in ADJUSTMENTS if a.community == c]
    for i, a in enumerate(steps, 1):
        test = " AND ".join([*[f"f_{x}" for x in a.needs], *[f"NOT f_{x}" for x in a.unless]])
        out = f"SELECT *, CASE WHEN {test} THEN s{i - 1} {'+' if a.how == 'add' else '*'} CAST({a.amount} AS DOUBLE) ELSE s{i - 1} END AS s{i} FROM ({out})"
    return f"SELECT doc_id, '{c}' AS community, {ORDER.index(c) + 1} AS ord, s{len(steps)} AS score, hits FROM ({out}) WHERE s0 > 0"


FLAGGED_SQL = f"{REC_SQL}, flagged AS MATERIALIZED (SELECT *, {T.map_sql('kind', T.LEVELS, 'none')} AS level, {_flag_sql()}, {_hit_sql()} FROM (SELECT *, {T.cascade_sql('low', T.STUDY_STEPS, 'other')} AS kind FROM rec)), scored AS MATERIALIZED ({' UNION ALL '.join(map(_score_sql, ORDER))})"


@query("h4_community_scoring", f"WITH {FLAGGED_SQL} SELECT doc_id, community, round(score, 4) AS score, array_to_string(hits, ',') AS hits FROM scored")
def h4(spark, sf):
    return scored(spark, sf).select("doc_id", "community", F.round("score", 4).alias("score"), F.array_join("hits", ",").alias("hits"))


def _forced_sql() -> str:
    rows = [" AND ".join([*[f"f_{x}" for x in r.needs], *[f"NOT f_{x}" for x in r.unless], f"top < {r.below}", *([f"community NOT IN ({', '.join(map(T.quoted, r.spared))})"] if r.spared else [])]) for r in FORCED]
    return "(" + " OR ".join(f"({x})" for x in rows) + ")"


ASSIGNED_SQL = f"""{FLAGGED_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM scored WHERE score <> 0),
 tops AS (SELECT doc_id, any_value(community) FILTER (WHERE rn = 1) AS community, any_value(score) FILTER (WHERE rn = 1) AS top, any_value(hits) FILTER (WHERE rn = 1) AS hits, coalesce(any_value(score) FILTER (WHERE rn = 2), 0) AS second,
   string_agg(community || ':' || CAST(round(score, 2) AS DOUBLE), ',' ORDER BY rn) FILTER (WHERE rn IN (2, 3) AND score >= 4) AS secondary FROM rk GROUP BY 1),
 held AS (SELECT f.*, t.community, t.top, t.hits, t.second, t.secondary, coalesce(top < 3, true) AS none_, coalesce(top >= 3 AND {_forced_sql()}, false) AS held FROM flagged f LEFT JOIN tops t USING (doc_id)),
 asg AS (SELECT *, CASE WHEN none_ OR held THEN 'unassigned' WHEN top >= 10 AND top - second >= 3 THEN 'high' WHEN top >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM held)"""


def _labels_sql(c: str, rules: list[Rule]) -> str:
    names = list(dict.fromkeys(r.label for r in rules))
    tests = {x: " OR ".join(T.hit_sql(c, (r.term,), r.kind) for r in rules if r.label == x) for x in names}
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {tests[x]} THEN {T.quoted(x)} END" for x in names) + "], lambda x: x IS NOT NULL), ',')"


@query(
    "h6_assignment_decision",
    f"""WITH {ASSIGNED_SQL} SELECT doc_id, CASE WHEN NOT (none_ OR held) THEN community END AS community, CASE WHEN none_ OR held THEN '' ELSE coalesce(secondary, '') END AS secondary, confidence, CASE WHEN none_ OR held THEN 0 ELSE round(top, 2) END AS score,
     CASE WHEN none_ OR held THEN '' ELSE array_to_string(hits, ',') END AS hits, CASE WHEN held THEN 'unassigned,scope_review' WHEN none_ THEN 'unassigned' ELSE concat_ws(',', CASE WHEN confidence = 'low' THEN 'low_confidence' END, CASE WHEN second >= 4 AND second >= 0.75 * top THEN 'conflict' END) END AS state,
     {tags_sql('low')} AS products, {_labels_sql('low', POPULATIONS)} AS populations, {T.map_sql('level', MATURITY, 'unclassified')} AS maturity,
     CASE WHEN lang <> 'en' THEN concat_ws(',', CASE WHEN NOT (none_ OR held) AND community = 'access' THEN 'regional access' END, CASE WHEN {tags_sql('low')} <> '' THEN 'regional product' END) ELSE '' END AS context FROM asg""",
)
def h6(spark, sf):
    """The community of each record, the next two, how sure it is, and facets: products, populations, maturity and regional context."""
    r = flagged(spark, sf)
    a = C.assigned(r, scored(spark, sf), "doc_id", ORDER, FORCED).join(r.select("doc_id", "low", "lang", "level"), "doc_id")
    second = F.array_join(F.transform("secondary", lambda x: F.concat(x["community"], F.lit(":"), F.round(x["score"], 2).cast("string"))), ",")
    out = a.select("doc_id", "community", second.alias("secondary"), "confidence", F.round("score", 2).alias("score"), F.array_join("hits", ",").alias("hits"), "state", F.array_join(labels_hit(F.col("low"), T.TAGS), ",").alias("products"), F.array_join(labels_hit(F.col("low"), POPULATIONS), ",").alias("populations"), K.level_of(F.col("level"), MATURITY, "unclassified").alias("maturity"), "lang")
    context = F.when(F.col("lang") != "en", F.concat_ws(",", F.when(F.col("community") == "access", "regional access"), F.when(F.col("products") != "", "regional product"))).otherwise("")
    return out.withColumn("context", context).drop("lang")


@query(
    "c22_topic_coverage",
    f"""WITH {ASSIGNED_SQL}, a AS (SELECT doc_id, source AS topic, CASE WHEN NOT (none_ OR held) THEN community END AS community, CASE WHEN NOT (none_ OR held) THEN secondary END AS secondary, title, affiliation FROM asg),
     more AS (SELECT doc_id, topic, affiliation, split_part(unnest(string_split(secondary, ',')), ':', 1) AS community FROM a WHERE coalesce(secondary, '') <> ''),
     node AS (SELECT affiliation, community, count(*) AS n, row_number() OVER (PARTITION BY affiliation ORDER BY count(*) DESC, community) AS rn FROM a WHERE community IS NOT NULL GROUP BY 1, 2),
     anchor AS (SELECT DISTINCT topic, affiliation FROM a WHERE doc_id % 7 = 0), text AS (SELECT topic, string_agg(title, '. ' ORDER BY doc_id) AS text FROM a GROUP BY 1),
     parts AS (SELECT topic, community, 'anchors' AS kind, CASE rn WHEN 1 THEN 3.0 ELSE 0.75 END AS p, 1 AS n FROM anchor JOIN node USING (affiliation) WHERE rn <= 3 UNION ALL SELECT topic, community, 'evidence', 1.5, 1 FROM a WHERE community IS NOT NULL UNION ALL SELECT topic, community, 'evidence', 0.5, 1 FROM more
       UNION ALL SELECT topic, community, 'terms', w * least(sum(hit), 2), CAST(sum(hit) AS INT) FROM ({' UNION ALL '.join(f"SELECT topic, '{c}' AS community, {dict(zip((STRONG, NORMAL, WEAK), (4.0, 1.8, 0.75), strict=True))[w]} AS w, CASE WHEN {T.hit_sql('text', (t,), W)} THEN 1 ELSE 0 END AS hit FROM text" for c in ORDER for w, ts in TERMS[c].items() for t in ts)}) GROUP BY topic, community, w HAVING sum(hit) > 0),
     g AS (SELECT topic, community, CAST(sum(p) AS DOUBLE) AS score, CAST(sum(n) FILTER (WHERE kind = 'anchors') AS BIGINT) AS anchors, CAST(sum(n) FILTER (WHERE kind = 'evidence') AS BIGINT) AS evidence, CAST(sum(n) FILTER (WHERE kind = 'terms') AS BIGINT) AS terms, count(DISTINCT kind) AS kinds FROM parts GROUP BY ALL)
     SELECT topic, community, round(score, 2) AS score, coalesce(anchors, 0) AS anchors, coalesce(evidence, 0) AS evidence, coalesce(terms, 0) AS terms, CASE WHEN score >= 8 AND kinds >= 2 THEN 'high' WHEN score >= 5 OR kinds >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM g WHERE score >= 1""",
)
def c22(spark, sf):
    """Topics are sources: their anchors are institutions with the communities of their records, their evidence the records' own communities, their text all titles."""
    r = records(spark, sf).select("doc_id", F.col("source").alias("topic"), "affiliation", "title")
    a = r.join(C.assigned(flagged(spark, sf), scored(spark, sf), "doc_id", ORDER, FORCED), "doc_id")
    sizes = a.where("community is not null").groupBy("affiliation", "community").agg(F.count("*").alias("n"))
    nodes = ranking.top_k(sizes, ["affiliation"], [F.desc("n"), F.asc("community")], 3)
    anchors = a.where("doc_id % 7 = 0").select("topic", "affiliation").distinct().join(nodes, "affiliation").select("topic", "community", (F.col("rank") == 1).alias("main"))
    first = a.where("community is not null").select("topic", "community", F.lit(True).alias("main"))
    evidence = first.unionByName(a.select("topic", F.explode("secondary").alias("s")).select("topic", F.col("s.community").alias("community"), F.lit(False).alias("main")))
    # a topic's text has a term if one of its titles has it: the titles are looked through one by one, each term once a topic
    rules = table_of(spark)
    hits = C.terms_in_texts(rules.select("term"), r, "doc_id", "title").join(r.select("doc_id", "topic"), "doc_id").select("topic", "term").distinct().join(rules, "term").select("topic", "community", "weight")
    return C.coverage(anchors, evidence, hits, "topic")


def table_of(spark):
    """The communities' terms with what a hit in a topic's text is worth."""
    points = dict(zip((STRONG, NORMAL, WEAK), (4.0, 1.8, 0.75), strict=True))
    return spark.createDataFrame([(c, t, points[w]) for c in ORDER for w, ts in TERMS[c].items() for t in ts], "community string, term string, weight double")


@query(
    "c27_interest_scoring",
    """WITH w AS (SELECT c_custkey, c_mktsegment, unnest(string_split(p_name, ' ')) AS term FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
     i AS (SELECT c_custkey, term, n, rn - 1 AS place FROM (SELECT c_custkey, term, count(*) AS n, row_number() OVER (PARTITION BY c_custkey ORDER BY count(*) DESC, term) AS rn FROM w GROUP BY 1, 2) WHERE rn <= 8), tg AS (SELECT DISTINCT c_custkey, lower(c_mktsegment) AS tag FROM w),
     m AS (SELECT p_partkey AS module, lower(p_name || ' ' || p_type || ' for ' || ['building', 'machinery', 'household', 'furniture', 'automobile'][1 + p_partkey % 5] || ' use') AS text FROM part WHERE p_size <= 10),
     hit AS (SELECT c_custkey, module, greatest(1, 8 - place) + n / 12.0 AS points, 0 AS kind, place, term FROM i JOIN m ON list_contains(string_split(text, ' '), term) UNION ALL SELECT c_custkey, module, 2.0, 1, 0, tag FROM tg JOIN m ON list_contains(string_split(text, ' '), tag)),
     s AS (SELECT c_custkey, module, round(CAST(sum(points) AS DOUBLE), 4) AS fit, arg_min(term, kind * 100 + place) AS matched FROM hit GROUP BY ALL)
     SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY fit DESC, module) AS INT) AS rank FROM s) WHERE rank <= 4""",
)
def c27(spark, sf):
    """The four modules that fit each customer best: interest terms, by rank and count, and the segment's tag, found in the modules' texts."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf, "part")
    bought = li.join(o, "o_orderkey").join(part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("term")), "p_partkey")
    counts = bought.join(table(spark, sf, "customer").select("c_custkey"), "c_custkey").groupBy("c_custkey", "term").agg(F.count("*").alias("n"))
    interests = ranking.top_k(counts, ["c_custkey"], [F.desc("n"), F.asc("term")], 8).withColumn("place", F.col("rank") - 1)
    tags = table(spark, sf, "customer").join(interests.select("c_custkey").distinct(), "c_custkey").select("c_custkey", F.lower("c_mktsegment").alias("tag"))
    uses = F.element_at(F.array(*[F.lit(x) for x in ("building", "machinery", "household", "furniture", "automobile")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    modules = part.where("p_size <= 10").select(F.col("p_partkey").alias("module"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" for "), uses, F.lit(" use")).alias("text"))
    return C.best_fits(interests, tags, modules, "c_custkey", "module", "text", 4).withColumnRenamed("score", "fit")

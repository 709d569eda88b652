"""Queries of rule classifiers (inventory H, G8, G11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import classifiers as K
from marlstone.operators import ranking, rules
from marlstone.plans import study_rules as T
from marlstone.plans.aggregate_queries import BEST_SQL, ROLE_SQL, authors, best
from marlstone.plans.gate_queries import titled
from marlstone.plans.registering import Group, table

group = Group()
query = group.add

STEPS = [
    K.Step("notice", any_terms=("all rights reserved",)), K.Step("table", any_terms=(" | ",)), K.Step("german", any_terms=("ung",), all_terms=("der",)),
    K.Step("french", any_terms=("eau", "eux"), no_terms=("the ",)), K.Step("spanish", any_terms=("mente",), no_terms=("the ",)), K.Step("english", any_terms=("the ", "tion")),
]
STEP_SQL = """CASE WHEN contains(low, 'all rights reserved') THEN 'notice' WHEN contains(low, ' | ') THEN 'table' WHEN contains(low, 'ung') AND contains(low, 'der') THEN 'german'
 WHEN (contains(low, 'eau') OR contains(low, 'eux')) AND NOT contains(low, 'the ') THEN 'french' WHEN contains(low, 'mente') AND NOT contains(low, 'the ') THEN 'spanish' WHEN contains(low, 'the ') OR contains(low, 'tion') THEN 'english' ELSE 'other' END"""
LEVELS = {"notice": "V", "table": "IV", "german": "II", "french": "II", "english": "I"}
REC_SQL = f"""rec AS (SELECT doc_id, lang, source, n_chars, lower(design) AS title, lower(design || '. ' || context || ' ' || coalesce(text, '')) AS low, context, text, {T.choice_sql(T.AFFILIATIONS, 'doc_id')} AS affiliation
 FROM (SELECT *, {T.choice_sql(T.DESIGNS, 'doc_id')} || CASE WHEN doc_id % 4 = 0 THEN ' of mirapexin' ELSE '' END AS design, {T.choice_sql(T.CONTEXTS, '(doc_id // 3)')} AS context FROM documents))"""


def records(spark, sf):
    """documents as study records: a title that states a design, an abstract that begins with it and with a context, and an affiliation, dealt by doc_id."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    d = table(spark, sf, "documents")
    design = F.concat(pick(T.DESIGNS, F.col("doc_id")), F.when(F.col("doc_id") % 4 == 0, " of mirapexin").otherwise(""))
    d = d.withColumn("title", F.lower(design)).withColumn("context", pick(T.CONTEXTS, F.floor(F.col("doc_id") / 3))).withColumn("affiliation", pick(T.AFFILIATIONS, F.col("doc_id")))
    return d.withColumn("low", F.concat("title", F.lit(". "), F.lower("context"), F.lit(" "), F.lower(F.coalesce("text", F.lit("")))))


LOW = "low AS (SELECT *, lower(text) AS low, lower(split_part(text, chr(10), 1)) AS title FROM documents)"


@query("h1_study_cascade", f"WITH {REC_SQL}, t AS (SELECT doc_id, {T.cascade_sql('low', T.STUDY_STEPS, 'other')} AS kind FROM rec) SELECT doc_id, kind, {T.map_sql('kind', T.LEVELS, 'none')} AS level FROM t")
def h1(spark, sf):
    kind = K.by_steps(F.col("low"), T.STUDY_STEPS, "other")
    return records(spark, sf).select("doc_id", kind.alias("kind")).withColumn("level", K.level_of(F.col("kind"), T.LEVELS, "none"))


CONTEXT_SQL = f"""hit AS (SELECT doc_id, low, regexp_extract_all(low, {T.quoted(T.RANDOM)}) AS found, regexp_split_to_array(low, {T.quoted(T.RANDOM)}) AS pieces FROM rec),
 spot AS (SELECT doc_id, low, list_transform(found, lambda x, i: {{'at': length(coalesce(array_to_string(pieces[1:i], ''), '')) + length(coalesce(array_to_string(found[1:i-1], ''), '')) + 1, 'n': length(x)}}) AS spots FROM hit),
 around AS (SELECT doc_id, low, list_transform(spots, lambda s: substring(low, greatest(1, s.at - {T.BEFORE}), s.at - greatest(1, s.at - {T.BEFORE}) + s.n + {T.AFTER})) AS c FROM spot)"""


@query("h2_design_predicates", f"WITH {REC_SQL}, {CONTEXT_SQL} SELECT doc_id, CAST(len(c) - len(list_filter(c, lambda x: regexp_matches(x, {T.quoted(T.DERIVED)}))) AS INT) AS own, CAST(len(list_filter(c, lambda x: regexp_matches(x, {T.quoted(T.DERIVED)}))) AS INT) AS derived, regexp_matches(low, '(?s)patients.{{0,60}}survival|survival.{{0,60}}patients') AS outcome_near, {T.hit_sql('low', ('single arm', 'one-arm'), 'word')} AND NOT {T.hit_sql('low', ('placebo',), 'word')} AS uncontrolled FROM around")
def h2(spark, sf):
    low = F.col("low")
    own, derived = K.own_and_derived(low, T.RANDOM, T.DERIVED, T.BEFORE, T.AFTER)
    uncontrolled = rules.any_of(low, ["single arm", "one-arm"], "word") & ~rules.has(low, "placebo", "word")
    return records(spark, sf).select("doc_id", own.alias("own"), derived.alias("derived"), rules.near(low, "patients", "survival", 60).alias("outcome_near"), uncontrolled.alias("uncontrolled"))


@query("h3_question_domain", f"WITH {REC_SQL}, n AS (SELECT doc_id, low, list_max(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(low, {T.quoted(x)}, 1)" for x in T.NUMBERS[:2]) + f"), lambda x: CAST(x AS INT))) AS a, list_max(list_transform(regexp_extract_all(low, {T.quoted(T.NUMBERS[2])}, 1), lambda x: CAST(x AS INT))) AS b FROM rec) SELECT doc_id, greatest(a, b) AS sample, coalesce(greatest(a, b) >= 100, false) AS large, {T.cascade_sql('low', T.DOMAINS, 'none')} AS domain FROM n")
def h3(spark, sf):
    r = records(spark, sf).withColumn("sample", K.largest_number(F.col("low"), T.NUMBERS))
    return r.select("doc_id", "sample", F.coalesce(F.col("sample") >= 100, F.lit(False)).alias("large"), K.by_steps(F.col("low"), T.DOMAINS, "none").alias("domain"))


@query("h5_intent_flags", f"WITH {REC_SQL} SELECT doc_id, {T.flags_sql('low', T.INTENTS)} AS intents FROM rec")
def h5(spark, sf):
    return records(spark, sf).select("doc_id", F.array_join(K.flags(F.col("low"), T.INTENTS), ",").alias("intents"))


@query("h7_activity_level", f"WITH {BEST_SQL}, x AS (SELECT best AS community, count(*) AS n, bool_or(n_chars > 15000) AS high FROM best JOIN documents USING (doc_id) GROUP BY 1) SELECT community, CASE WHEN coalesce(high, false) THEN 'active' WHEN n > 0 THEN 'watch' ELSE 'quiet' END AS level FROM (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS community) LEFT JOIN x USING (community)")
def h7(spark, sf):
    j = best(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").withColumnRenamed("best", "community")
    every = spark.createDataFrame([("en",), ("de",), ("fr",), ("es",), ("it",)], "community string")
    return K.activity(j, "community", F.col("n_chars") > 15000, every)


@query("h8_cluster_key", f"WITH {REC_SQL}, k AS (SELECT doc_id, {T.cascade_sql('low', T.CLUSTERS, 'other')} AS key, string_split({T.flags_sql('low', T.INTENTS)}, ',')[1:5] AS topics FROM rec) SELECT doc_id, key, starts_with(key, 'agent:') AS product, array_to_string(topics, ',') AS topics FROM k")
def h8(spark, sf):
    key = K.by_steps(F.col("low"), T.CLUSTERS, "other")
    topics = F.slice(K.flags(F.col("low"), T.INTENTS), 1, 5)
    return records(spark, sf).select("doc_id", key.alias("key"), F.array_join(topics, ",").alias("topics")).withColumn("product", F.startswith("key", F.lit("agent:")))


def tags_sql(c: str) -> str:
    labels = list(dict.fromkeys(r.label for r in T.TAGS))
    tests = {x: " OR ".join(T.hit_sql(c, (r.term,), r.kind) for r in T.TAGS if r.label == x) for x in labels}
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {tests[x]} THEN {T.quoted(x)} END" for x in labels) + "], lambda x: x IS NOT NULL), ',')"


@query("h9_drug_tags", f"WITH {REC_SQL} SELECT doc_id, CASE WHEN {tags_sql('title')} <> '' THEN {tags_sql('title')} ELSE {tags_sql('low')} END AS tags FROM rec")
def h9(spark, sf):
    t = K.title_first(rules.labels_hit(F.col("title"), T.TAGS), rules.labels_hit(F.col("low"), T.TAGS))
    return records(spark, sf).select("doc_id", F.array_join(t, ",").alias("tags"))


PLACE_SQL = f"""loc AS (SELECT doc_id, source, affiliation, lower(trim(split_part(affiliation, ',', 1))) AS label, lower(affiliation) AS raw FROM rec),
 placed AS (SELECT *, CASE """ + " ".join(f"WHEN {T.hit_sql(c, (t,), 'word')} THEN {T.quoted(n)}" for c, rows in (("label", T.PLACES), ("raw", T.PLACES), ("raw", T.COUNTRIES)) for t, n in rows) + """ END AS place,
 CASE """ + " ".join(f"WHEN {T.hit_sql(c, (t,), 'word')} THEN '{how}'" for how, c, rows in (("label", "label", T.PLACES), ("raw", "raw", T.PLACES), ("country", "raw", T.COUNTRIES)) for t, n in rows) + " END AS via FROM loc)"


def placed(spark, sf):
    r = records(spark, sf).withColumn("label", F.lower(F.trim(F.substring_index("affiliation", ",", 1)))).withColumn("raw", F.lower("affiliation"))
    place, via = K.first_place(F.col("label"), F.col("raw"), T.PLACES, T.COUNTRIES)
    return r.withColumn("place", place).withColumn("via", via)


@query("h13_location", f"WITH {REC_SQL}, {PLACE_SQL} SELECT doc_id, place, via FROM placed")
def h13(spark, sf):
    return placed(spark, sf).select("doc_id", "place", "via")


@query("g8_institution", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel') THEN 'Steel Works' WHEN regexp_matches(lower(p_type), 'copper|tin') THEN string_split(p_type, ' ')[-1] ELSE string_split(p_type, ' ')[1] END AS inst, CASE WHEN regexp_matches(lower(p_type), 'steel') THEN 'family' WHEN regexp_matches(lower(p_type), 'copper|tin') THEN 'strong' ELSE 'fallback' END AS rule FROM part")
def g8(spark, sf):
    parts = S.name_parts(F.col("p_type"), " ")
    strong = F.element_at(F.filter(parts, lambda p: F.lower(p).rlike("copper|tin")), -1)
    family = F.when(F.lower("p_type").rlike("steel"), F.lit("Steel Works"))
    rule = rules.cascade([("family", family.isNotNull()), ("strong", F.exists(parts, lambda p: F.lower(p).rlike("copper|tin")))], "fallback")
    return table(spark, sf, "part").select("p_partkey", rule.alias("rule"), F.when(rule == "family", family).when(rule == "strong", strong).otherwise(F.element_at(parts, 1)).alias("inst"))


RAW_SQL = "CASE p_partkey % 7 WHEN 0 THEN 'Veltoran 10 mg oral tablets' WHEN 1 THEN 'MIRA-101 + Dorsuvimab 2.5 ml' WHEN 2 THEN 'placebo' WHEN 3 THEN 'VLT-7 injection plus saline' WHEN 4 THEN 'standard care combined with mirapexin XR' WHEN 5 THEN p_name ELSE 'Veltoran + vlt-7' END"


@query("g11_drug_names", f"""WITH p AS (SELECT p_partkey, unnest(regexp_split_to_array(lower({RAW_SQL}), '\\s*\\+\\s*|\\s+combined with\\s+|\\s+plus\\s+')) AS part, generate_subscripts(regexp_split_to_array(lower({RAW_SQL}), '\\s*\\+\\s*|\\s+combined with\\s+|\\s+plus\\s+'), 1) AS pos FROM part),
 b AS (SELECT p_partkey, pos, trim(regexp_replace(regexp_replace(part, '\\b\\d+([.]\\d+)?\\s*(mg|ml|g|mcg|iu)\\b', '', 'g'), '\\b(oral|tablets?|injections?|infusions?|intravenous|topical)\\b', '', 'g')) AS part FROM p),
 n AS (SELECT p_partkey, pos, CASE """ + " ".join(f"WHEN part = {T.quoted(a)} THEN {T.quoted(n)}" for a, n in sorted(T.ALIASES.items(), key=lambda kv: (-len(kv[0]), kv[0]))) + " " + " ".join(f"WHEN contains(part, {T.quoted(a)}) THEN {T.quoted(n)}" for a, n in sorted(T.ALIASES.items(), key=lambda kv: (-len(kv[0]), kv[0]))) + """ ELSE part END AS name FROM b),
 f AS (SELECT p_partkey, name, min(pos) AS pos FROM n WHERE name <> '' GROUP BY ALL) SELECT p.p_partkey, coalesce(string_agg(name, ';' ORDER BY pos), '') AS drugs FROM part p LEFT JOIN f USING (p_partkey) GROUP BY 1""")
def g11(spark, sf):
    raw = F.expr(RAW_SQL)
    return table(spark, sf, "part").select("p_partkey", F.array_join(K.agent_names(raw, T.ALIASES), ";").alias("drugs"))


@query("h14_hospital", f"""WITH {REC_SQL}, p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(affiliation, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM rec),
 c AS (SELECT doc_id, list_filter(parts, lambda x: regexp_matches(lower(x), '\\b(hospital|infirmary)\\b'))[1] AS h, list_filter(parts, lambda x: regexp_matches(lower(x), '\\b(centre|center|clinic|university|institute|board)\\b'))[1] AS o FROM p)
 SELECT doc_id, CASE lower(coalesce(h, o)) """ + " ".join(f"WHEN {T.quoted(a)} THEN {T.quoted(b)}" for a, b in T.OVERRIDES.items()) + """ ELSE coalesce(h, o) END AS name, CASE WHEN h IS NOT NULL THEN 'hospital' WHEN o IS NOT NULL THEN 'organisation' ELSE 'none' END AS kind FROM c""")
def h14(spark, sf):
    return records(spark, sf).select("doc_id", K.hospital_of(F.col("affiliation"), T.OVERRIDES).alias("h")).select("doc_id", "h.name", "h.kind")


@query("h15_author_roles", f"WITH {ROLE_SQL} SELECT paper, author, pos, CASE WHEN pos = 1 THEN 'first' WHEN author % 7 = 0 THEN 'explicit' WHEN pos = last AND NOT bool_or(author % 7 = 0) OVER (PARTITION BY paper) THEN 'last_fallback' END AS role FROM ro")
def h15(spark, sf):
    explicit = F.col("author") % 7 == 0
    any_explicit = F.bool_or(explicit).over(Window.partitionBy("paper"))
    role = F.when(F.col("pos") == 1, "first").when(explicit, "explicit").when((F.col("pos") == F.col("last")) & ~any_explicit, "last_fallback")
    return authors(spark, sf).select("paper", "author", "pos", role.alias("role"))


@query("h16_region_flag", f"WITH {LOW} SELECT doc_id, lang = 'fr' OR contains(low, 'eau') OR source IN ('src1', 'src2') AS flagged FROM low")
def h16(spark, sf):
    flag = (F.col("lang") == "fr") | rules.has(F.col("low"), "eau") | F.exists(F.array("source"), lambda s: s.isin("src1", "src2"))
    return titled(spark, sf).select("doc_id", flag.alias("flagged"))


@query("h17_conference_item", f"WITH {REC_SQL}, i AS (SELECT doc_id, n_chars, low, {T.cascade_sql('low', T.STUDY_STEPS, 'other')} AS kind, {tags_sql('low')} AS drugs, {T.flags_sql('low', T.INTENTS)} AS topics FROM rec) SELECT doc_id, kind, drugs, topics, contains(topics, 'experience') AS patient_lens, CAST(CASE {T.map_sql('kind', T.LEVELS, 'none')} WHEN 'I' THEN 4 WHEN 'II' THEN 3 WHEN 'III' THEN 2 ELSE 0 END + CASE WHEN drugs <> '' THEN 2 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS INT) AS priority FROM i")
def h17(spark, sf):
    r = records(spark, sf).select("doc_id", "n_chars", K.by_steps(F.col("low"), T.STUDY_STEPS, "other").alias("kind"), F.array_join(rules.labels_hit(F.col("low"), T.TAGS), ",").alias("drugs"), F.array_join(K.flags(F.col("low"), T.INTENTS), ",").alias("topics"))
    level = K.level_of(F.col("kind"), {k: {"I": "4", "II": "3", "III": "2"}.get(v, "0") for k, v in T.LEVELS.items()}, "0").cast("int")
    p = level + F.when(F.col("drugs") != "", 2).otherwise(0) + F.when(F.col("n_chars") > 2000, 1).otherwise(0)
    return r.select("doc_id", "kind", "drugs", "topics", F.contains("topics", F.lit("experience")).alias("patient_lens"), p.alias("priority"))


CLAIMS = [K.Step("result", ("report", "fell", "compared", "good"), kind="word"), K.Step("method", ("enrolled", "drawn", "studied", "added"), kind="word"), K.Step("open", ("no further",), kind="word"), K.Step("note", ("the", "and", "of"), kind="word")]


@query("h18_claims", f"WITH {REC_SQL}, l AS (SELECT doc_id, unnest(string_split(context || chr(10) || coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(context || chr(10) || coalesce(text, ''), chr(10))))) AS pos FROM rec), c AS (SELECT doc_id, CAST(pos AS INT) AS pos, {T.cascade_sql('lower(line)', CLAIMS, '')} AS kind FROM l WHERE length(line) BETWEEN 15 AND 300), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind = 'note', pos) AS INT) AS rank FROM c WHERE kind <> '') SELECT * FROM r WHERE rank <= 6")
def h18(spark, sf):
    """Lines that a claim rule fits, at most six of a record, stronger kinds before notes."""
    lines = records(spark, sf).select("doc_id", F.posexplode(F.split(F.concat("context", F.lit("\n"), F.coalesce("text", F.lit(""))), "\n")).alias("pos", "line"))
    kept = lines.where(F.length("line").between(15, 300)).select("doc_id", "pos", K.by_steps(F.lower("line"), CLAIMS, "").alias("kind")).where("kind <> ''")
    return ranking.top_k(kept.withColumn("weak", F.col("kind") == "note"), ["doc_id"], [F.asc("weak"), F.asc("pos")], 6).drop("weak")


CONCEPTS = [rules.Rule("survival", r"(overall|progression-free) survival|mortality", kind="regex"), rules.Rule("cost", r"cost-effective(ness)?|budget impact", kind="regex"), rules.Rule("gene", r"polymorphisms?|genome-wide", kind="regex"), rules.Rule("model", r"nomograms?|prediction models?", kind="regex"), rules.Rule("agent", r"veltoran|mira(pexin|-101)|dorsuvimab", kind="regex"), rules.Rule("review", r"(systematic|scoping|umbrella) review", kind="regex")]


@query("h19_concepts", f"WITH {REC_SQL} " + " UNION ALL ".join(f"SELECT {T.quoted(r.label)} AS concept, count(*) AS n FROM rec WHERE regexp_matches(low, {T.quoted(r.term)}) HAVING count(*) > 0" for r in CONCEPTS) + " UNION ALL SELECT 'region', count(*) FROM rec WHERE lang <> 'en' OR contains(affiliation, 'Region') HAVING count(*) > 0")
def h19(spark, sf):
    hits = rules.labels_hit(F.col("low"), CONCEPTS)
    region = F.when((F.col("lang") != "en") | F.contains("affiliation", F.lit("Region")), F.array(F.lit("region"))).otherwise(F.array().cast("array<string>"))
    return records(spark, sf).select(F.explode(F.concat(hits, region)).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


@query("h20_label_repair", f"WITH {REC_SQL}, {PLACE_SQL}, o AS (SELECT place, CASE source WHEN 'src0' THEN place WHEN 'src1' THEN NULL ELSE 'North' END AS old FROM placed) SELECT CASE WHEN place IS NULL THEN 'kept' WHEN place IS NOT DISTINCT FROM old THEN 'same' ELSE 'changed' END AS state, coalesce(place, old, '') AS label, count(*) AS n FROM o GROUP BY ALL")
def h20(spark, sf):
    """The location is computed anew for every stored profile; where none is found the old label stays."""
    r = placed(spark, sf).withColumn("old", F.when(F.col("source") == "src0", F.col("place")).when(F.col("source") == "src1", F.lit(None).cast("string")).otherwise("North"))
    state = rules.cascade([("kept", F.col("place").isNull()), ("same", F.col("place").eqNullSafe(F.col("old")))], "changed")
    return r.groupBy(state.alias("state"), F.coalesce("place", "old", F.lit("")).alias("label")).agg(F.count("*").alias("n"))

"""Queries of packing, samples, selections, digests and sentences (inventory D31, D37, D46, G6, G16, J3, J6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import classifiers as K
from marlstone.operators import decisions as D
from marlstone.operators import gates, packing, ranking, rules
from marlstone.plans import study_rules as T
from marlstone.plans.aggregate_queries import CARD_SQL, assigned, cards
from marlstone.plans.classifier_queries import REC_SQL, records
from marlstone.plans.registering import Group, table

group = Group()
query = group.add

BATCH = 20


@query(
    "g16_chunks",
    f"""WITH RECURSIVE g AS (SELECT source, lang, doc_id, CAST(greatest(1, ceil(length(text) / 1000.0)) AS BIGINT) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
     f(i, used, batch, nxt) AS (SELECT 1, n, 0, CASE WHEN n > {BATCH} THEN CAST(ceil(n / {BATCH}.0) AS BIGINT) ELSE 1 END FROM g WHERE i = 1
       UNION ALL SELECT g.i, CASE WHEN g.n > {BATCH} OR f.used > {BATCH} OR f.used + g.n > {BATCH} THEN g.n ELSE f.used + g.n END, CASE WHEN g.n > {BATCH} OR f.used > {BATCH} OR f.used + g.n > {BATCH} THEN f.nxt ELSE f.batch END,
         CASE WHEN g.n > {BATCH} THEN f.nxt + CAST(ceil(g.n / {BATCH}.0) AS BIGINT) WHEN f.used > {BATCH} OR f.used + g.n > {BATCH} THEN f.nxt + 1 ELSE f.nxt END FROM f JOIN g ON g.i = f.i + 1),
     c AS (SELECT doc_id, CAST(start_ AS INT) AS start, substr(text, CAST(start_ + 1 AS BIGINT), 1000) AS chunk, CAST(start_ / 1000 AS BIGINT) AS k FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text)), 1000)) AS start_ FROM documents WHERE text IS NOT NULL))
     SELECT c.doc_id, c.start, c.chunk, f.batch + k // {BATCH} AS batch FROM c JOIN g USING (doc_id) JOIN f ON f.i = g.i""",
)
def g16(spark, sf):
    """Documents in chunks of 1000 characters, and the batch of at most twenty chunks that each goes to: a document's chunks are not split over batches unless there are more than twenty."""
    # documents without an id come last in the order and meet none in the join; those of one id come as in the files
    d = table(spark, sf, "documents").where("text is not null and doc_id is not null")
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1000)).cast("long").alias("n")
    packed = packing.batches(d.select("doc_id", n, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")), "doc_id", "n", BATCH, ("file", "row"))
    c = d.select("doc_id", F.explode_outer(S.chunks(F.col("text"), 1000, 0)).alias("c"))
    c = c.select("doc_id", F.coalesce("c.start", F.lit(0)).alias("start"), F.coalesce("c.chunk", F.lit("")).alias("chunk"))  # an empty text is one chunk
    return c.join(packed.select("doc_id", "batch").hint("merge"), "doc_id").withColumn("batch", F.col("batch") + F.floor(F.col("start") / (1000 * BATCH)))


SEED, SAMPLE = 17, 12


@query(
    "d46_reviewer_agreement",
    f"""WITH {REC_SQL}, t AS (SELECT doc_id, {T.map_sql('kind', T.LEVELS, 'none')} AS rule FROM (SELECT doc_id, {T.cascade_sql('low', T.STUDY_STEPS, 'other')} AS kind FROM rec)), r AS (SELECT doc_id, rule, CASE WHEN rule IN ('I', 'II') THEN 1 ELSE 0 END AS said, quality FROM t JOIN labels USING (doc_id)),
     s AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY md5('{SEED}:' || doc_id), doc_id) AS rn FROM r), k AS (SELECT *, CAST(count(*) OVER (PARTITION BY rule) AS BIGINT) AS sampled, round(avg(CASE WHEN said = quality THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY rule), 6) AS agreement FROM s WHERE rn <= {SAMPLE})
     SELECT rule, sampled, agreement, doc_id, said, quality FROM k WHERE said <> quality UNION ALL SELECT DISTINCT rule, sampled, agreement, NULL, NULL, NULL FROM k""",
)
def d46(spark, sf):
    """Of a seeded sample by level of the rule: the rate at which rule and reviewer agree (a row with no doc_id), and the rows in which they do not."""
    r = records(spark, sf).select("doc_id", K.level_of(K.by_steps(F.col("low"), T.STUDY_STEPS, "other"), T.LEVELS, "none").alias("rule"))
    j = r.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").withColumn("said", F.when(F.col("rule").isin("I", "II"), 1).otherwise(0))
    s = ranking.seeded_sample(j, ["rule"], "doc_id", SAMPLE, SEED)
    rates = s.groupBy("rule").agg(F.count("*").alias("sampled"), F.round(F.avg((F.col("said") == F.col("quality")).cast("double")), 6).alias("agreement"))  # a row for each level
    wrong = s.where("said <> quality").join(rates, "rule").select("rule", "sampled", "agreement", "doc_id", "said", "quality")
    return wrong.unionByName(rates, allowMissingColumns=True)


MERGED = {"prognosis": "outcomes", "scale": "outcomes"}
SIDE = "CASE WHEN lang = 'es' THEN 'region' ELSE 'rest' END"


@query(
    "d31_theme_divergence",
    f"""WITH {REC_SQL}, t AS (SELECT doc_id, {SIDE} AS side, CASE topic WHEN 'prognosis' THEN 'outcomes' WHEN 'scale' THEN 'outcomes' ELSE topic END AS topic FROM (SELECT doc_id, lang, {T.cascade_sql('low', T.DOMAINS, 'other')} AS topic FROM rec)),
     g AS (SELECT topic, count(*) FILTER (WHERE side = 'rest') AS rest, count(*) FILTER (WHERE side = 'region') AS region FROM t WHERE topic <> 'other' GROUP BY 1), s AS (SELECT *, round(rest + region + 0.5 * abs(rest - region), 4) AS score FROM g),
     p AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, topic) AS INT) AS place, CAST(2 * region > rest AS BOOLEAN) AS leads FROM s), f AS (SELECT * FROM p WHERE place <= 5), x AS (SELECT * FROM p WHERE leads ORDER BY score DESC, topic LIMIT 1),
     c AS (SELECT topic, rest, region, score, place FROM f WHERE NOT ((SELECT NOT bool_or(leads) FROM f) AND EXISTS (SELECT * FROM x) AND place = (SELECT max(place) FROM f)) UNION ALL SELECT topic, rest, region, score, (SELECT max(place) FROM f) FROM x WHERE (SELECT NOT bool_or(leads) FROM f)),
     rf AS (SELECT topic, side, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY topic, side ORDER BY doc_id) AS rn FROM t) WHERE rn <= 3 GROUP BY ALL)
     SELECT c.*, CASE WHEN least(rest, region) < 5 THEN 'low' WHEN least(rest, region) >= 10 AND abs(rest - region) >= 10 THEN 'high' ELSE 'medium' END AS confidence, coalesce(a.ids, '') AS region_refs, coalesce(b.ids, '') AS rest_refs
     FROM c LEFT JOIN rf a ON a.topic = c.topic AND a.side = 'region' LEFT JOIN rf b ON b.topic = c.topic AND b.side = 'rest'""",
)
def d31(spark, sf):
    """Topics by priority rules, two of them taken together, on two sides: the five with the highest score, one in which the region leads (twice its rows are more than the rest's) among them if there is any."""
    topic = K.by_steps(F.col("low"), T.DOMAINS, "other")
    m = F.create_map(*[F.lit(x) for kv in MERGED.items() for x in kv])
    t = records(spark, sf).select("doc_id", F.when(F.col("lang") == "es", "region").otherwise("rest").alias("side"), topic.alias("t")).select("doc_id", "side", F.coalesce(F.try_element_at(m, "t"), "t").alias("topic"))
    g = t.where("topic <> 'other'").groupBy("topic").pivot("side", ["rest", "region"]).count().fillna(0)
    s = g.withColumn("score", F.round(F.col("rest") + F.col("region") + 0.5 * F.abs(F.col("rest") - F.col("region")), 4))
    chosen = ranking.guaranteed(s, [F.desc("score"), F.asc("topic")], 5, 2 * F.col("region") > F.col("rest"))
    refs = ranking.top_lists(t, ["topic", "side"], [F.asc("doc_id")], 3, F.col("doc_id").cast("string"), "ids")
    of = lambda side: refs.where(F.col("side") == side).select("topic", F.array_join("ids", ",").alias(f"{side}_refs"))
    low, gap = F.least("rest", "region"), F.abs(F.col("rest") - F.col("region"))
    j = chosen.join(of("region"), "topic", "left").join(of("rest"), "topic", "left").fillna("", ["region_refs", "rest_refs"])
    return j.withColumn("confidence", rules.cascade([("low", low < 5), ("high", (low >= 10) & (gap >= 10))], "medium"))


@query(
    "d37_insight_selection",
    f"""WITH {CARD_SQL}, w AS (SELECT best AS community, count(*) AS weekly FROM j WHERE fresh AND quality = 1 GROUP BY 1), a AS (SELECT c.*, coalesce(weekly, 0) AS weekly, CASE WHEN high > 0 AND fresh > 3 THEN 6 WHEN fresh > 0 THEN 2 ELSE 0 END AS activity FROM card c LEFT JOIN w USING (community) WHERE n > 0),
     s AS (SELECT *, CAST(4 * fresh + 8 * high + 2 * region + activity + 1.5 * weekly AS DOUBLE) AS score FROM a), p AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, community) AS INT) AS place FROM s QUALIFY place <= 6),
     rf AS (SELECT best AS community, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS refs FROM (SELECT best, doc_id, row_number() OVER (PARTITION BY best ORDER BY coalesce(quality, -1) DESC, n_chars DESC, doc_id) AS rn FROM j JOIN documents USING (doc_id) WHERE best IS NOT NULL) WHERE rn <= 6 GROUP BY 1),
     tp AS (SELECT community, string_agg(source, ',' ORDER BY rn) AS topics FROM (SELECT best AS community, source, row_number() OVER (PARTITION BY best ORDER BY count(*) DESC, source) AS rn FROM j JOIN documents USING (doc_id) WHERE best IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1)
     SELECT community, score, place, coalesce(topics, '') AS topics, coalesce(refs, '') AS refs, CASE WHEN high >= 10 AND fresh >= 5 THEN 'high' WHEN high >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM p LEFT JOIN rf USING (community) LEFT JOIN tp USING (community)
     UNION ALL SELECT 'none', 0.0, 1, '', '', 'low' WHERE NOT EXISTS (SELECT * FROM p)""",
)
def d37(spark, sf):
    """The six communities with most news, evidence and activity, with three topics and six references each; one row that says none where there is no community."""
    y = assigned(spark, sf).where("best is not null").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumnRenamed("best", "community")
    weekly = y.where("fresh and quality = 1").groupBy("community").agg(F.count("*").alias("weekly"))
    c = cards(spark, sf).where("n > 0").join(weekly, "community", "left").fillna(0)
    activity = F.when((F.col("high") > 0) & (F.col("fresh") > 3), 6).when(F.col("fresh") > 0, 2).otherwise(0)
    s = c.withColumn("score", (4 * F.col("fresh") + 8 * F.col("high") + 2 * F.col("region") + activity + 1.5 * F.col("weekly")).cast("double"))
    p = ranking.placed_in(s, None, [F.desc("score"), F.asc("community")], "place").where("place <= 6")  # a row for each community
    refs = ranking.top_lists(y, ["community"], [F.desc(F.coalesce("quality", F.lit(-1))), F.desc("n_chars"), F.asc("doc_id")], 6, F.col("doc_id").cast("string"), "refs")
    topics = ranking.counted_lists(y, ["community"], "source", "doc_id", 3, "topics")
    j = p.join(refs, "community", "left").join(topics, "community", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    sure = rules.cascade([("high", (F.col("high") >= 10) & (F.col("fresh") >= 5)), ("medium", F.col("high") >= 3)], "low")
    out = j.select("community", "score", "place", text(F.array_join(F.transform("topics", lambda x: x["value"]), ",")).alias("topics"), text(F.array_join("refs", ",")).alias("refs"), sure.alias("confidence"))
    return ranking.or_fallback(out, spark.createDataFrame([("none", 0.0, 1, "", "", "low")], out.schema))


def digest_sql(columns: list[str]) -> str:
    """The multiset digest of decisions.table_digest."""
    row = "md5(concat_ws(chr(1), " + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in columns) + "))"
    return "concat_ws('-', " + ", ".join(f"to_hex(CAST(sum(CAST('0x' || substr({row}, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT))" for i in range(4)) + ")"


DOC = ["doc_id", "text", "lang", "source"]
REASON = "CASE WHEN coalesce(length(text), 0) < 100 THEN 'too_short' WHEN contains(text, ' | ') THEN 'table' ELSE 'kept' END"


@query("j6_quarantine", f"SELECT {REASON} AS reason, count(*) AS n, lower({digest_sql(DOC)}) AS digest, min(doc_id) AS first_id, (SELECT lower({digest_sql(DOC)}) FROM documents) AS source_digest FROM documents GROUP BY 1")
def j6(spark, sf):
    """Kept and quarantined rows, written apart; read back: how many of each reason, their digest, and that of the source they came from."""
    d = table(spark, sf, "documents").select(*DOC)
    stop = gates.first_stop([("too_short", F.coalesce(F.length("text"), F.lit(0)) >= 100), ("table", ~rules.has(F.col("text"), " | "))])
    parts = D.quarantined(d, stop)
    found = D.table_digest(parts, DOC, ["reason"]).join(parts.groupBy("reason").agg(F.min("doc_id").alias("first_id")), "reason")
    return found.crossJoin(F.broadcast(D.table_digest(d, DOC).select(F.col("digest").alias("source_digest"))))  # one row


@query(
    "j3_count_consistency",
    f"""WITH w AS (SELECT 'documents' AS name, count(*) AS n, lower({digest_sql(['doc_id', 'lang'])}) AS digest FROM documents UNION ALL SELECT 'shards_by_lang', count(*), lower({digest_sql(['doc_id', 'lang'])}) FROM documents
       UNION ALL SELECT 'shards_by_source', count(*), lower({digest_sql(['doc_id', 'lang'])}) FROM documents WHERE source IS NULL OR source <> 'src3' UNION ALL SELECT 'edited', count(*), lower({digest_sql(['doc_id', "CASE WHEN doc_id = 5 THEN 'xx' ELSE lang END"])}) FROM documents),
     a AS (SELECT max(o_orderdate) AS last FROM orders), f AS (SELECT o_orderpriority AS name, max(CAST(o_orderdate AS DATE)) AS newest FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderdate > last - INTERVAL 40 DAY OR o_orderpriority = '1-URGENT' AND o_orderdate > last - INTERVAL 400 DAY) GROUP BY 1)
     SELECT name, n, CASE WHEN n = (SELECT n FROM w WHERE name = 'documents') THEN CASE WHEN digest = (SELECT digest FROM w WHERE name = 'documents') THEN 'ok' ELSE 'rows differ' END ELSE 'counts differ' END AS state FROM w
     UNION ALL SELECT name, datediff('day', newest, CAST(last AS DATE)), CASE WHEN datediff('day', newest, CAST(last AS DATE)) <= 10 THEN 'fresh' WHEN datediff('day', newest, CAST(last AS DATE)) <= 90 THEN 'ageing' ELSE 'stale' END FROM f, a""".replace("FROM orders WHERE NOT", "FROM orders, a WHERE NOT"),
)
def j3(spark, sf):
    """Artifacts that say the same rows have the same count and digest, however they are sharded; and the days since each source's newest row."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    columns = ["doc_id", "lang"]
    made = {
        "documents": d, "shards_by_lang": d.repartition(3, "lang"), "shards_by_source": d.where("source is null or source <> 'src3'"), "edited": d.withColumn("lang", F.when(F.col("doc_id") == 5, "xx").otherwise(F.col("lang"))),
    }
    w = reduce(DataFrame.unionByName, [D.table_digest(df, columns).withColumn("name", F.lit(name)) for name, df in made.items()])
    whole = w.where("name = 'documents'").select(F.col("n").alias("__n"), F.col("digest").alias("__d"))
    state = rules.cascade([("counts differ", F.col("n") != F.col("__n")), ("rows differ", F.col("digest") != F.col("__d"))], "ok")
    counts = w.crossJoin(F.broadcast(whole)).select("name", "n", state.alias("state"))  # one row
    o = table(spark, sf, "orders").crossJoin(F.broadcast(table(spark, sf, "orders").agg(F.max("o_orderdate").alias("last"))))  # one row
    late = ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderdate") > F.expr("last - interval 40 days"))) | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") > F.expr("last - interval 400 days")))
    f = o.where(~late).groupBy(F.col("o_orderpriority").alias("name")).agg(F.to_date(F.max("o_orderdate")).alias("newest"), F.to_date(F.max("last")).alias("last"))
    return counts.unionByName(f.select("name", F.datediff("last", "newest").cast("long").alias("n"), D.freshness(F.col("newest"), F.col("last"), 10, 90).alias("state")))


LABELS = ["background", "methods?", "results?", "conclusions?"]
WANTED = ["results?", "conclusions?"]
ANCHORS, NUMBERS, EXTRAS = r"mean change|response|reduction|improvement|%|week|month", r"\d", r"baseline|placebo|tolerated"
SAID = [
    "The mean change at week 12 was 4.2 points. Nothing else moved here today.", "A response was seen in 40% of patients. A Response was seen in 40% of patients; Placebo did less at baseline, by 3 points.", "No numbers are told in this one. It was well tolerated, they say.",
    "Reduction of the dose by 5 mg within a month was reached in most of those who took part in the trial, whatever the site, the age, the sex, the form of the illness, the time since it began, the drugs that had been given before and the score at the start of it all.",
]
FORMS = ["{0}", "Background: Known. Methods: As usual. Results: {0} Conclusions: It works.", "Background: {0} Conclusion: The end came at week 3 with 10% improvement.", "Methods: none given."]
ABSTRACTS = [f.format(s) for f in FORMS for s in SAID]


def _abstract_sql() -> str:
    return T.choice_sql(ABSTRACTS, "doc_id")


def _section_sql(c: str) -> str:
    one = lambda w: rf"trim(regexp_extract({c}, '(?is)(?:^|[\s.;])(?:{w})\s*:\s*(.*)\z', 1))"
    cut = lambda x: rf"trim(regexp_replace({x}, '(?is)(?:^|[\s.;])(?:{'|'.join(LABELS)})\s*:.*', ''))"
    return f"coalesce(nullif({cut(one(WANTED[0]))}, ''), nullif({cut(one(WANTED[1]))}, ''), {c})"


@query(
    "g6_excerpt",
    rf"""WITH a AS (SELECT doc_id, {_abstract_sql()} AS abstract, text FROM documents), b AS (SELECT *, rtrim({_section_sql('abstract')}, '. ') AS section, trim(regexp_replace(abstract, '\s+', ' ', 'g')) AS flat FROM a),
     s AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(flat, '([.;]) (\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')) AS s, unnest(range(1000)) AS i FROM b), k AS (SELECT doc_id, s, i, length(s) AS n, CASE WHEN regexp_matches(lower(s), '{ANCHORS}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(s), '{NUMBERS}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(s), '{EXTRAS}') THEN 1 ELSE 0 END AS p,
       substr(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), 1, 80) AS k FROM s WHERE s IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY p DESC, n, i) AS kn FROM k WHERE n >= 24 AND p >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, n, i) AS rn FROM f WHERE kn = 1),
     m AS (SELECT doc_id, string_agg(CASE WHEN length(s) > 220 THEN rtrim(substr(s, 1, 220)) || '…' ELSE s END, ' / ' ORDER BY rn) AS metrics FROM r WHERE rn <= 4 GROUP BY 1)
     SELECT b.doc_id, CASE WHEN length(section) <= 120 THEN section WHEN length(regexp_replace(substr(section, 1, 121), '\s+\S*$', '')) > 120 THEN substr(section, 1, 120) ELSE regexp_replace(substr(section, 1, 121), '\s+\S*$', '') END AS excerpt, regexp_extract(text, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1) AS sentence, coalesce(metrics, '') AS metrics FROM b LEFT JOIN m USING (doc_id)""",
)
def g6(spark, sf):
    """What an abstract reports: the section with results or conclusions, cut at a word's end; the sentences with figures, ranked; and the first sentence of the whole text."""
    pick = F.element_at(F.array(*[F.lit(x) for x in ABSTRACTS]), (F.col("doc_id") % len(ABSTRACTS) + 1).cast("int"))
    a = table(spark, sf, "documents").select("doc_id", "text", pick.alias("abstract"))
    section = F.rtrim(S.labelled_section(F.col("abstract"), WANTED, LABELS), F.lit(". "))
    metrics = F.array_join(S.metric_sentences(F.col("abstract"), ANCHORS, NUMBERS, EXTRAS, 4), " / ")
    return a.select("doc_id", S.cut_at_word(section, 120).alias("excerpt"), S.first_sentence(F.col("text")).alias("sentence"), metrics.alias("metrics"))

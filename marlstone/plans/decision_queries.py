"""Queries of decisions, feeds, set operations and checks (inventory C23–C26, C31, D32, D39–D46, F, I, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import decisions as D
from marlstone.operators import quotes as Q
from marlstone.operators import rules
from marlstone.plans.aggregate_queries import CLUSTER_SQL, SIGNAL_SQL, signals
from marlstone.plans.registering import Group, table

group = Group()
query = group.add


@query("c23_reference_numbering", "WITH c AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY ALL), k AS (SELECT p_partkey FROM part WHERE p_size > 5) SELECT l_orderkey, l_partkey, CASE WHEN p_partkey IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY l_orderkey, p_partkey IS NULL ORDER BY first, l_partkey) AS INT) END AS number FROM c LEFT JOIN k ON p_partkey = l_partkey")
def c23(spark, sf):
    known = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return D.numbered_references(table(spark, sf, "lineitem"), known, "l_orderkey", "l_linenumber", "l_partkey")


_PART = "substring(text, 1, CAST(floor(length(text) * 0.8) AS INT))"
_QUOTES = {"whole": "text", "ended": f"concat({_PART}, ' and so the story ended elsewhere')", "numbered": "replace(text, ' of ', ' of 12 ')", "never": "concat('it was never said that ', item_id, ' ', reverse(text))", "short": "substring(text, 1, 21)"}
QUOTE_SQL = rf"""q AS ({' UNION ALL '.join(f"SELECT concat(item_id, '/{way}') AS quote_id, {x} AS quote FROM benchmark" for way, x in _QUOTES.items())}),
 k AS (SELECT quote_id, regexp_replace(lower(replace(quote, chr(173), '')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS q FROM q), d AS (SELECT doc_id, regexp_replace(lower(replace(text, chr(173), '')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM documents),
 v AS (SELECT quote_id, doc_id, CASE WHEN contains(t, q) THEN 'whole' WHEN contains(t, substring(q, 1, greatest(24, CAST(floor(length(q) * 0.7) AS INT)))) THEN 'prefix' WHEN length(q) >= 40 AND regexp_replace(q, '\d+', '', 'g') <> '' AND contains(regexp_replace(t, '\d+', '', 'g'), regexp_replace(q, '\d+', '', 'g')) THEN 'digits' ELSE 'none' END AS verdict FROM k, d WHERE q <> '' AND t <> '')"""


@query("c24_quote_verification", f"WITH {QUOTE_SQL} SELECT * FROM v WHERE verdict <> 'none'")
def c24(spark, sf):
    """Every benchmark passage against every document, quoted in five ways: as it stands, with another end, with numbers put in, wrongly, and its beginning only."""
    b = table(spark, sf, "benchmark")
    quotes = reduce(DataFrame.unionByName, [b.selectExpr(f"concat(item_id, '/{way}') AS quote_id", f"{x} AS quote") for way, x in _QUOTES.items()])
    d = table(spark, sf, "documents").where("doc_id is not null")
    return Q.verified(quotes, d, "quote_id", S.quote_key(F.col("quote"), compatible=False), "doc_id", S.quote_key(F.col("text"), compatible=False))


@query("c25_stance_pairing", r"""WITH s AS (SELECT source AS dimension, lang, doc_id, regexp_extract(text, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1) AS quote, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE lang IN ('en', 'fr'))
 SELECT dimension, count(*) FILTER (WHERE lang = 'en') AS left_n, count(*) FILTER (WHERE lang = 'fr') AS right_n, max(doc_id) FILTER (WHERE lang = 'en' AND rn = 1) AS left_id, max(quote) FILTER (WHERE lang = 'en' AND rn = 1) AS left_quote,
   max(doc_id) FILTER (WHERE lang = 'fr' AND rn = 1) AS right_id, max(quote) FILTER (WHERE lang = 'fr' AND rn = 1) AS right_quote FROM s GROUP BY 1 HAVING count(DISTINCT lang) = 2""")
def c25(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("dimension"), F.when(F.col("lang") == "en", "left").when(F.col("lang") == "fr", "right").alias("side"), F.col("doc_id").alias("id"), S.first_sentence(F.col("text")).alias("quote"), (-F.col("n_chars")).alias("place"))
    return D.paired_sides(d.where("side is not null"), "dimension", "side", ["left", "right"], "id", "quote", "place")


@query("c26_reviewed_delta", """WITH x AS (SELECT *, CASE WHEN doc_id % 3 = 2 OR coalesce(text, '') = '' THEN 'pending' WHEN doc_id % 2 = 0 OR contains(text, 'a quote from elsewhere') THEN 'applied' ELSE 'rejected' END AS state FROM documents)
 SELECT doc_id, state, CASE WHEN state = 'applied' THEN 'revised' ELSE source END AS source, CASE WHEN state = 'applied' AND doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang FROM x""")
def c26(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    k = F.col("doc_id")
    quotes = F.array(F.substring("text", 5, 30), F.when(k % 2 == 0, F.substring("text", 20, 25)).otherwise("a quote from elsewhere"))
    deltas = d.where(k % 3 != 2).select("doc_id", quotes.alias("quotes"), F.lit("revised").alias("source"), F.when(k % 5 == 0, "xx").alias("lang"))
    return D.delta_applied(d, deltas, "doc_id", "text", ["source", "lang"]).select("doc_id", "state", "source", "lang")


@query("c31_code_labels", "WITH w AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS code, unnest(range(len(string_split(p_type, ' ')))) AS pos FROM part) SELECT p_partkey, string_agg(CASE code WHEN 'STEEL' THEN 'iron' WHEN 'TIN' THEN 'stannum' ELSE code END, ' ' ORDER BY pos) AS text, count(*) FILTER (WHERE code IN ('STEEL', 'TIN')) AS replaced FROM w GROUP BY 1")
def c31(spark, sf):
    labels = spark.createDataFrame([("STEEL", "iron"), ("TIN", "stannum")], "code string, label string")
    return D.humanised(table(spark, sf, "part"), "p_partkey", "p_type", labels)


@query("d32_label_validation", "WITH s AS (SELECT source AS topic, doc_id FROM documents UNION ALL SELECT source, doc_id + 1000000 FROM documents WHERE doc_id % 3 = 0) SELECT topic, count(*) AS valid FROM s JOIN documents d USING (doc_id) WHERE d.lang = 'en' GROUP BY 1")
def d32(spark, sf):
    d = table(spark, sf, "documents")
    said = d.select(F.col("source").alias("topic"), F.array_compact(F.array("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1000000))).alias("ids")).select("topic", F.explode("ids").alias("doc_id"))
    return said.join(d.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").groupBy("topic").agg(F.count("*").alias("valid"))


@query("d39_dashboard", f"WITH {SIGNAL_SQL} SELECT 'documents' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'signals', count(*) FROM sig UNION ALL SELECT 'strong', count(*) FROM sig WHERE strength = 'strong' UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'experts', count(DISTINCT o_custkey) FROM orders")
def d39(spark, sf):
    s = signals(spark, sf)
    parts = {"documents": table(spark, sf, "documents"), "signals": s, "strong": s.where("strength = 'strong'"), "orders": table(spark, sf, "orders"), "experts": table(spark, sf, "orders").select("o_custkey").distinct()}
    return D.counts_of(parts).select(F.col("name").alias("metric"), F.col("n").alias("value"))


@query("d40_weekly_digest", f"""WITH {SIGNAL_SQL}, t AS (SELECT doc_id, score FROM sig ORDER BY score DESC, doc_id LIMIT 3), h AS (SELECT lang, count(*) AS n FROM sig GROUP BY 1 ORDER BY n DESC, lang LIMIT 5), l AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 3),
 r AS (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 3)
 SELECT 1 AS section, 'signal ' || doc_id AS line FROM t UNION ALL SELECT 2, lang || ': ' || n FROM h UNION ALL SELECT 3, 'lead ' || o_custkey || ': ' || n FROM l UNION ALL SELECT 4, 'trial ' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 300000
 UNION ALL SELECT 5, 'orders ' || strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 5, 'events ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') FROM events UNION ALL SELECT 6, 'region ' || doc_id FROM r""")
def d40(spark, sf):
    s, o, d = signals(spark, sf), table(spark, sf, "orders"), table(spark, sf, "documents")
    window = lambda name, df, at: df.agg(F.format_string(f"{name} %s to %s", F.date_format(F.min(at), "yyyy-MM-dd"), F.date_format(F.max(at), "yyyy-MM-dd")).alias("line"))
    leads = o.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(3)
    return D.digest([
        s.orderBy(F.desc("score"), "doc_id").limit(3).select(F.format_string("signal %d", "doc_id").alias("line")),
        s.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(5).select(F.format_string("%s: %d", "lang", "n").alias("line")),
        leads.select(F.format_string("lead %d: %d", "o_custkey", "n").alias("line")),
        o.where("o_orderpriority = '1-URGENT' and o_totalprice >= 300000").select(F.format_string("trial %d", "o_orderkey").alias("line")),
        window("orders", o, "o_orderdate").unionByName(window("events", table(spark, sf, "events"), "ts")),
        d.where("lang = 'fr'").orderBy(F.desc("n_chars"), "doc_id").limit(3).select(F.format_string("region %d", "doc_id").alias("line")),
    ])


@query("d43_source_channels", """WITH c AS (SELECT 'literature' AS channel, doc_id AS id, CAST(n_chars AS DOUBLE) AS v, 40 AS most FROM documents UNION ALL SELECT 'trials', o_orderkey, epoch(o_orderdate), 12 FROM orders UNION ALL SELECT 'regulatory', event_id, value, 12 FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'guideline', item_id, CAST(length(text) AS DOUBLE), 20 FROM benchmark UNION ALL SELECT 'conference', conv_id, CAST(count(*) AS DOUBLE), 40 FROM conversations GROUP BY conv_id UNION ALL SELECT 'key publications', doc_id, CAST(n_chars AS DOUBLE), 12 FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id))
 SELECT channel, id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY v DESC NULLS LAST, id) AS INT) AS place FROM c) WHERE place <= most""")
def d43(spark, sf):
    d = table(spark, sf, "documents")
    key = d.join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    meetings = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    channels = [
        ("literature", d, "doc_id", F.col("n_chars"), 40), ("trials", table(spark, sf, "orders"), "o_orderkey", F.col("o_orderdate"), 12),
        ("regulatory", table(spark, sf, "events").where("event_type = 'purchase'"), "event_id", F.col("value"), 12), ("guideline", table(spark, sf, "benchmark"), "item_id", F.length("text"), 20),
        ("conference", meetings, "conv_id", F.col("turns"), 40), ("key publications", key, "doc_id", F.col("n_chars"), 12),
    ]
    return D.channel_feed(channels)


@query("d44_event_timeline", """WITH newest AS (SELECT max(o_orderdate) AS m FROM orders), u AS (SELECT 'trial' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'regulatory', event_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'purchase'
  UNION ALL (SELECT 'publication', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 4) UNION ALL SELECT 'start', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders, newest WHERE o_orderpriority = '2-HIGH' AND o_orderdate >= m - INTERVAL 365 DAY)
 SELECT * FROM u ORDER BY day DESC, kind, id LIMIT 10""")
def d44(spark, sf):
    o = table(spark, sf, "orders")
    day = lambda name, df, key, at: df.select(F.lit(name).alias("kind"), F.col(key).alias("id"), F.date_format(at, "yyyy-MM-dd").alias("day"))
    starts = o.where("o_orderpriority = '2-HIGH'").crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("newest")))).where("o_orderdate >= newest - interval 365 day")  # one row
    parts = [
        day("trial", o.where("o_orderpriority = '1-URGENT'"), "o_orderkey", "o_orderdate"), day("regulatory", table(spark, sf, "events").where("event_type = 'purchase'"), "event_id", "ts"),
        day("publication", o.where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(4), "o_orderkey", "o_orderdate"), day("start", starts, "o_orderkey", "o_orderdate"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.orderBy(F.desc("day"), "kind", "id").limit(10)


@query("f1_heterogeneous_union", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, NULL AS size FROM customer UNION ALL SELECT 'part', p_partkey, p_name, p_size FROM part")
def f1(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    p = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return c.unionByName(p, allowMissingColumns=True)


@query("f2_set_checks", "SELECT 'only_left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'only_right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def f2(spark, sf):
    return D.set_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("f3_ordered_distinct", "WITH w AS (SELECT p_partkey, list_concat(string_split(p_type, ' '), string_split(p_name, ' ')) AS a FROM part) SELECT p_partkey, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS names FROM w")
def f3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_distinct(F.concat(F.split("p_type", " "), F.split("p_name", " "))), " ").alias("names"))


RAW_SQL = "raw AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 3 = 0 THEN 'include' WHEN turn % 3 = 1 THEN 'exclude' ELSE 'what' END AS decision, CAST(length(text) % 9 AS INT) AS score FROM conversations)"
NORM_SQL = RAW_SQL + ", nrm AS (SELECT doc_id, decision, CAST(greatest(1, least(5, score)) AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS rn FROM raw WHERE decision <> 'what' AND doc_id IN (SELECT doc_id FROM labels)) WHERE rn = 1)"


def normal(spark, sf):
    kind = rules.cascade([("include", F.col("turn") % 3 == 0), ("exclude", F.col("turn") % 3 == 1)], "what")
    raw = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", kind.alias("decision"), (F.length("text") % 9).cast("int").alias("score"))
    return D.normalised(raw, table(spark, sf, "labels"), "doc_id", "turn", ["include", "exclude"]).select("doc_id", "decision", "score")


@query("i1_decision_normalisation", f"WITH {NORM_SQL} SELECT * FROM nrm")
def i1(spark, sf):
    return normal(spark, sf)


@query("i2_evidence_ceiling", f"WITH {NORM_SQL}, r AS (SELECT nrm.*, CASE WHEN toxic = 1 THEN 'toxic_text' WHEN quality = 0 AND decision = 'include' THEN 'low_quality' END AS rule FROM nrm JOIN labels USING (doc_id)) SELECT doc_id, rule, decision AS was, CASE rule WHEN 'toxic_text' THEN 'exclude' WHEN 'low_quality' THEN 'background' ELSE decision END AS decision FROM r")
def i2(spark, sf):
    j = normal(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return D.ceiling(j, [("toxic_text", F.col("toxic") == 1, "exclude"), ("low_quality", (F.col("quality") == 0) & (F.col("decision") == "include"), "background")]).select("doc_id", "rule", "was", "decision")


CLAIM_SQL = "raws AS (SELECT DISTINCT doc_id % 50 AS signal, doc_id FROM labels UNION SELECT doc_id % 30 + 100, doc_id FROM labels), inc AS (SELECT doc_id FROM labels WHERE quality = 1), cla AS (SELECT doc_id, min(signal) AS signal FROM raws WHERE doc_id IN (SELECT doc_id FROM inc) GROUP BY 1)"


def claim_parts(spark, sf):
    lab = table(spark, sf, "labels")
    named = lambda s: lab.select(s.alias("signal"), "doc_id")  # noqa: E731  a row for each id that a reviewer lists
    sig = named(F.col("doc_id") % 50).unionByName(named(F.col("doc_id") % 30 + 100))
    return sig, D.claims(sig, lab.where("quality = 1"), "doc_id")


@query("i3_signal_acceptance", f"WITH {CLAIM_SQL} SELECT r.signal, count(*) AS n FROM raws r LEFT JOIN cla c ON c.signal = r.signal AND c.doc_id = r.doc_id GROUP BY 1 HAVING bool_and(c.doc_id IS NOT NULL)")
def i3(spark, sf):
    sig, claimed = claim_parts(spark, sf)
    return D.accepted(sig, claimed, "doc_id")


@query("i4_signal_merge", f"WITH {CLAIM_SQL} SELECT l.doc_id, coalesce(cla.signal, 1000 + l.doc_id % 7) AS signal FROM labels l LEFT JOIN cla USING (doc_id)")
def i4(spark, sf):
    _, claimed = claim_parts(spark, sf)
    return D.with_fallback(claimed, table(spark, sf, "labels").select("doc_id"), F.col("doc_id") % 7 + 1000, "doc_id")


@query("i5_strength_bounds", f"WITH {CLUSTER_SQL} SELECT source, greatest(CASE WHEN bool_or(strength = 'strong') THEN 3.0 ELSE 1.0 END, least(CASE WHEN bool_or(toxic = 1) THEN 4.0 ELSE 5.0 END, round(avg(score), 4))) AS bounded FROM sig GROUP BY 1")
def i5(spark, sf):
    g = signals(spark, sf).groupBy("source").agg(F.bool_or(F.col("strength") == "strong").alias("st"), F.bool_or(F.col("toxic") == 1).alias("tx"), F.round(F.avg("score"), 4).alias("s"))
    return g.select("source", D.bounded(F.col("s"), F.when(F.col("st"), 3.0).otherwise(1.0), F.when(F.col("tx"), 4.0).otherwise(5.0)).alias("bounded"))


@query("i6_trial_decision_merge", f"WITH {NORM_SQL}, c AS (SELECT doc_id, CASE WHEN quality = 1 THEN 3 ELSE 1 END AS cap FROM labels) SELECT c.doc_id, CASE WHEN nrm.doc_id IS NULL THEN 'missing' ELSE 'matched' END AS state, CAST(least(coalesce(score, 1), cap) AS INT) AS score FROM c LEFT JOIN nrm ON nrm.doc_id = c.doc_id")
def i6(spark, sf):
    cap = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, 3).otherwise(1).alias("cap"))
    j = cap.join(normal(spark, sf), "doc_id", "full_outer").where("cap is not null")
    return j.select("doc_id", F.when(F.col("decision").isNull(), "missing").otherwise("matched").alias("state"), F.least(F.coalesce("score", F.lit(1)), "cap").alias("score"))


@query("i7_evidence_items", f"WITH {NORM_SQL} SELECT l.doc_id, coalesce(nrm.decision, 'fallback') AS finding, CAST(coalesce(nrm.score, 1) AS INT) AS tier FROM labels l LEFT JOIN nrm ON nrm.doc_id = l.doc_id WHERE l.quality = 1")
def i7(spark, sf):
    j = table(spark, sf, "labels").where("quality = 1").select("doc_id").join(normal(spark, sf), "doc_id", "left")
    return j.select("doc_id", F.coalesce("decision", F.lit("fallback")).alias("finding"), F.coalesce("score", F.lit(1)).alias("tier"))


@query("j1_contract_checks", "SELECT 'label_without_document' AS rule, CAST(doc_id AS VARCHAR) AS key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'n_chars_differs', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'order_without_customer', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'conversation_does_not_begin_with_user_or_system', CAST(conv_id AS VARCHAR) FROM conversations WHERE turn = 0 AND role = 'assistant' UNION ALL SELECT 'short_document', CAST(doc_id AS VARCHAR) FROM documents WHERE length(text) < 50")
def j1(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return D.violations(
        [
            ("label_without_document", lab.select("doc_id").join(d.select("doc_id"), "doc_id", "left_anti")), ("n_chars_differs", d.where(F.col("n_chars") != F.length("text")).select("doc_id")),
            ("order_without_customer", table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_anti").select("o_orderkey")),
            ("conversation_does_not_begin_with_user_or_system", table(spark, sf, "conversations").where("turn = 0 and role = 'assistant'").select("conv_id")), ("short_document", d.where(F.length("text") < 50).select("doc_id")),
        ]
    )

"""Queries of trial records: change texts, classes of change, de-duplication in order, events, importance, materiality and decisions (inventory C8, C10-C12, D28, H10-H12).

The records are orders: two snapshots of each trial, whose fields are written in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import diffing, merging, trials
from marlstone.plans.registering import Group, table

group = Group()
query = group.add


def choice(values: list[str], index: str) -> str:
    """A CASE that picks one of the texts by an integer expression."""
    return f"CASE ({index}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


K = "o_orderkey"
TITLES = [
    "Confirmatory study of veltoran in generalised disease", "Observational cohort of routine care", "Dose finding of mirapexin", "Veltoran given under the skin in children", "Dorsuvimab in refractory disease",
    "A first-in-class inhibitor against placebo", "Long-term safety of mirapexin", "Observational registry of refractory disease", "Veltoran for the ocular form",
]
DRUGS = ["veltoran", "mirapexin", "dorsuvimab", "veltoran;mirapexin", "mirapexin;standard care", "dorsuvimab;veltoran", ""]
CLASSES = {"veltoran": "blocker", "mirapexin": "inhibitor", "dorsuvimab": "antibody"}
PHASES = ["Phase 1", "Phase 2", "Phase 2/Phase 3", "Phase 3", "N/A", "Phase 4", "Early Phase 1"]
RANKS = {"Phase 1": 1.0, "Phase 2": 2.0, "Phase 2/Phase 3": 2.5, "Phase 3": 3.0, "Phase 4": 4.0, "Early Phase 1": 0.5}
REASONS = ["lack of efficacy", "sponsor decision", "Safety concern", "", "slow enrolment"]
REGISTRIES = ["NCT", "EU", "CHI"]
STATUS = "CASE o_orderstatus WHEN 'O' THEN 'RECRUITING' WHEN 'F' THEN 'COMPLETED' ELSE 'ACTIVE_NOT_RECRUITING' END"
NOW = {
    "id": K, "title": f"concat({choice(TITLES, K)}, ' ', {K} % 7)", "status": f"CASE WHEN {K} % 13 = 2 THEN 'TERMINATED' WHEN {K} % 13 = 4 THEN 'SUSPENDED' ELSE {STATUS} END", "phase": choice(PHASES, f"{K} + o_custkey"),
    "enrollment_count": f"100 + o_custkey % 50 + CASE WHEN {K} % 19 = 3 THEN 20 ELSE 0 END", "enrollment_type": f"CASE WHEN {K} % 2 = 0 THEN 'Estimated' ELSE 'Actual' END", "drugs": choice(DRUGS, f"{K} + 2"),
    "primary_completion_date": f"CASE WHEN {K} % 31 = 7 THEN '' ELSE concat('202', {K} % 5, '-0', 1 + {K} % 9) END", "locations_count": f"5 + o_custkey % 7 + CASE WHEN {K} % 29 = 0 THEN 1 ELSE 0 END",
    "results": f"CASE WHEN {K} % 5 = 0 THEN 'posted' END", "why_stopped": choice(REASONS, K), "registry": choice(REGISTRIES, "o_custkey"), "sponsor": f"CASE WHEN {K} % 8 = 0 THEN '' ELSE concat('sponsor ', o_custkey % 41) END",
    "on_topic": f"{K} % 6 <> 5",
}
THEN = NOW | {
    "status": f"CASE WHEN {K} % 11 = 3 THEN 'UNKNOWN' WHEN {K} % 11 = 5 THEN 'NOT_YET_RECRUITING' ELSE {STATUS} END", "phase": f"CASE WHEN {K} % 17 = 1 THEN 'Phase 1' ELSE {NOW['phase']} END", "enrollment_count": f"CASE WHEN {K} % 37 = 0 THEN NULL ELSE 100 + o_custkey % 50 END",
    "drugs": f"CASE WHEN {K} % 15 = 6 THEN 'veltoran' ELSE {NOW['drugs']} END", "primary_completion_date": f"concat('202', {K} % 5, '-0', 1 + CASE WHEN {K} % 23 = 2 THEN 3 ELSE {K} % 9 END)", "locations_count": "5 + o_custkey % 7", "results": f"CASE WHEN {K} % 10 = 0 THEN 'posted' END",
}
NAMES = ["id", "status", "phase", "enrollment_count", "enrollment_type", "primary_completion_date", "locations_count", "results"]


def snapshots(spark, sf):
    """The trials of this week and of the last: of every twenty one is new and one gone."""
    o = table(spark, sf, "orders")
    rows = lambda fields, where: o.where(where).selectExpr(*[f"{x} AS {c}" for c, x in fields.items()]).withColumn("interventions", F.filter(F.split("drugs", ";"), lambda d: d != ""))
    return rows(NOW, f"{K} % 20 <> 1"), rows(THEN, f"{K} % 20 <> 2")


def _sql(fields: dict[str, str], where: str) -> str:
    return f"(SELECT *, list_filter(string_split(drugs, ';'), lambda d: d <> '') AS interventions FROM (SELECT {', '.join(f'{x} AS {c}' for c, x in fields.items())} FROM orders WHERE {where}))"


SNAP = f"cur AS {_sql(NOW, f'{K} % 20 <> 1')}, old AS {_sql(THEN, f'{K} % 20 <> 2')}"
FIELDS = ["enrollment_count", "phase", "interventions", "primary_completion_date", "locations_count"]


def _gone(c: str) -> str:
    if c == "interventions":
        return "len(came) + len(went) > 0"
    return f"coalesce(trim(CAST(o.{c} AS VARCHAR)) <> '' AND trim(CAST(c.{c} AS VARCHAR)) <> '' AND o.{c} <> c.{c}, false)"


def _move(c: str, label: str, end: str = "''") -> str:
    return f"CASE WHEN {_gone(c)} THEN '{label}: ' || o.{c} || ' -> ' || c.{c} || {end} END"


_SIGNED = "list_concat(list_transform(came[1:2], lambda x: '+' || x), list_transform(went[1:2], lambda x: '-' || x))"
UPDATES_SQL = f"""{SNAP}, both_ AS (SELECT coalesce(c.id, o.id) AS id, c, o, c.id IS NOT NULL AND o.id IS NOT NULL AS both_in,
   list_sort(list_filter(c.interventions, lambda x: NOT list_contains(o.interventions, x))) AS came, list_sort(list_filter(o.interventions, lambda x: NOT list_contains(c.interventions, x))) AS went FROM cur c FULL JOIN old o ON c.id = o.id),
 made AS (SELECT id, o.status AS before, c.status AS after, list_filter([{', '.join(f"CASE WHEN both_in AND {_gone(x)} THEN '{x}' END" for x in FIELDS)}], lambda x: x IS NOT NULL) AS fields,
   CASE WHEN both_in THEN concat_ws('; ', {_move('status', 'status')}, {_move('enrollment_count', 'enrollment', "CASE WHEN c.enrollment_type = 'Estimated' THEN ' (estimated)' ELSE '' END")}, {_move('phase', 'phase')},
     CASE WHEN len(came) + len(went) > 0 THEN 'interventions: ' || array_to_string({_SIGNED}, ', ') END, {_move('primary_completion_date', 'completion')}, {_move('locations_count', 'sites')}) ELSE '' END AS text,
   list_filter([CASE WHEN o.id IS NULL THEN 'added' END, CASE WHEN c.id IS NULL THEN 'removed' END, CASE WHEN both_in AND c.results IS NOT NULL AND o.results IS NULL THEN 'results_posted' END, CASE WHEN both_in AND {_gone('status')} THEN 'status_changed' END], lambda x: x IS NOT NULL) AS events FROM both_),
 updates AS (SELECT id, unnest(CASE WHEN len(events) > 0 THEN events WHEN len(fields) > 0 THEN ['updated'] ELSE [] END) AS event, before, after, fields, text FROM made)"""


@query("c8_change_text", f"WITH {UPDATES_SQL} SELECT id, event, text FROM updates")
def c8(spark, sf):
    return trials.updates(*snapshots(spark, sf), "id").select("id", "event", "text")


C10_FIELDS = ["phase", "sponsor", "first_day", "title"]
_OLD10 = {"phase": f"CASE WHEN {K} % 4 = 2 THEN 'Unknown' ELSE {NOW['phase']} END", "sponsor": f"CASE WHEN {K} % 6 = 1 THEN '' ELSE {NOW['sponsor']} END", "first_day": f"CASE WHEN {K} % 9 = 4 THEN 'N/A' ELSE o_orderpriority END", "title": f"CASE WHEN {K} % 12 = 5 THEN concat('old ', {K}) WHEN {K} % 25 = 8 THEN '-' ELSE concat('clerk ', o_custkey % 13) END"}
_NEW10 = {"phase": NOW["phase"], "sponsor": NOW["sponsor"], "first_day": "o_orderpriority", "title": "concat('clerk ', o_custkey % 13)"}
_EMPTY = "(trim(coalesce(o.{0}, '')) IN ('', 'Unknown', '-', 'N/A'))"
_FILLABLE = ["phase", "sponsor", "first_day"]
_FILLS = [f"({_EMPTY.format(f)} AND NOT {_EMPTY.format(f).replace('o.', 'c.')})" for f in _FILLABLE]


def _c10(fields: dict[str, str], where: str) -> str:
    return f"(SELECT {K} AS id, {', '.join(f'{x} AS {c}' for c, x in fields.items())} FROM orders WHERE {where})"


@query(
    "c10_enriched_vs_updated",
    f"""WITH c AS {_c10(_NEW10, f'{K} % 10 <> 9')}, o AS {_c10(_OLD10, f'{K} % 10 <> 8')},
     j AS (SELECT coalesce(c.id, o.id) AS id, c.id IS NULL AS gone, o.id IS NULL AS fresh, list_filter([{', '.join(f"CASE WHEN coalesce(o.{f}, '') <> coalesce(c.{f}, '') AND NOT {x} THEN '{f}' END" for f, x in zip([*_FILLABLE, 'title'], [*_FILLS, 'false'], strict=True))}], lambda x: x IS NOT NULL) AS changed,
       list_filter([{', '.join(f"CASE WHEN coalesce(o.{f}, '') <> coalesce(c.{f}, '') AND {x} THEN '{f}' END" for f, x in zip(_FILLABLE, _FILLS, strict=True))}], lambda x: x IS NOT NULL) AS filled FROM c FULL JOIN o ON c.id = o.id)
     SELECT id, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' WHEN len(changed) > 0 THEN 'updated' WHEN len(filled) > 0 THEN 'enriched' ELSE 'unchanged' END AS kind,
       CASE WHEN fresh OR gone THEN '' ELSE array_to_string(changed, ',') END AS changes, CASE WHEN fresh OR gone THEN '' ELSE array_to_string(filled, ',') END AS filled FROM j""",
)
def c10(spark, sf):
    o = table(spark, sf, "orders")
    rows = lambda fields, where: o.where(where).selectExpr(f"{K} AS id", *[f"{x} AS {c}" for c, x in fields.items()])
    m = diffing.change_map(rows(_NEW10, f"{K} % 10 <> 9"), rows(_OLD10, f"{K} % 10 <> 8"), "id", C10_FIELDS, fillable=_FILLABLE)
    keys = lambda c: F.array_join(F.filter(F.array(*[F.lit(f) for f in C10_FIELDS]), lambda f: F.array_contains(F.map_keys(c), f)), ",")
    return m.select("id", "kind", keys("changes").alias("changes"), keys("filled").alias("filled"))


#: Records one after another: ids that a few share, and whole titles that others share. That links two survivors now and then.
IDS = f"concat_ws(';', concat('r', {K}), CASE WHEN {K} % 6 < 2 THEN concat('x', CAST(floor({K} / 12) AS BIGINT)) END, CASE WHEN {K} % 7 = 3 THEN concat('Y', CAST(floor({K} / 40) AS BIGINT)) END, CASE WHEN {K} % 11 = 0 THEN concat(' y', CAST(floor({K} / 40) AS BIGINT) - 1) END)"
LONG_TITLE = f"CASE WHEN {K} % 4 = 0 THEN concat('Randomised confirmatory study, in two parts, of agent ', {K} % 97) ELSE concat('Study ', {K} % 5) END"


def _ordered_sql(merged_titles: bool) -> str:
    titled = "SELECT k, lag(k) OVER (PARTITION BY t ORDER BY k) AS b FROM rec WHERE length(t) >= 40" if merged_titles else "SELECT k, min(k) OVER (PARTITION BY t) AS b FROM rec WHERE length(t) >= 40 AND k NOT IN (SELECT k FROM by_id)"
    return f"""rec AS (SELECT {K} AS k, list_distinct(list_transform(string_split({IDS}, ';'), lambda x: lower(trim(x)))) AS ids, regexp_replace(lower({LONG_TITLE}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM orders),
 by_id AS (SELECT DISTINCT k, b FROM (SELECT k, lag(k) OVER (PARTITION BY id ORDER BY k) AS b FROM (SELECT k, unnest(ids) AS id FROM rec)) WHERE b IS NOT NULL),
 by_title AS (SELECT * FROM ({titled}) WHERE b < k AND k NOT IN (SELECT k FROM by_id)), earlier AS (SELECT * FROM by_id UNION SELECT * FROM by_title),
 reach(k, seen) AS (SELECT k, k FROM rec UNION SELECT r.k, e.b FROM reach r JOIN earlier e ON e.k = r.seen),
 merged AS (SELECT k, min(seen) AS survivor, CASE WHEN k IN (SELECT k FROM by_id) THEN 'id' WHEN k IN (SELECT k FROM by_title) THEN 'title' ELSE 'first' END AS how FROM reach GROUP BY 1)"""


def _merged(spark, sf, merged_titles):
    o = table(spark, sf, "orders").selectExpr(f"{K} AS k", f"{IDS} AS ids", f"{LONG_TITLE} AS title")
    return merging.ordered_merge(o, "k", F.split("ids", ";"), F.col("title"), merged_titles=merged_titles)


@query("c11_registry_dedup", f"WITH RECURSIVE {_ordered_sql(False)} SELECT k, survivor, how, CAST(row_number() OVER (PARTITION BY survivor ORDER BY k) - 1 AS INT) AS place FROM merged")
def c11(spark, sf):
    """Each record, the survivor that it is linked to, how, and its place among the survivor's linked registries (0: the survivor)."""
    return merging.numbered(_merged(spark, sf, False), "survivor", "k", "place")


MATERIAL = "CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END"
EVENT = "CASE o_orderstatus WHEN 'O' THEN 'added' WHEN 'F' THEN 'status' ELSE 'updated' END"
SOURCE_EVENT = f"concat_ws('/', {choice(REGISTRIES, 'o_custkey')}, concat('R', o_custkey % 9), {EVENT}, substring(concat('', o_orderdate), 1, 7))"


@query(
    "c12_event_merge",
    f"""WITH RECURSIVE {_ordered_sql(True)}, ev AS (SELECT survivor, k, {MATERIAL} AS material, {SOURCE_EVENT} AS source_event, concat({choice(REGISTRIES, 'o_custkey')}, '/', 'R', o_custkey % 9) AS ref, concat('R', o_custkey % 9) AS ref_id, {EVENT} AS event, concat('c', o_custkey) AS cross_id FROM merged JOIN orders ON {K} = k),
     g AS (SELECT survivor, count(*) AS n, arg_max(k, CAST(material AS BIGINT) * 100000000000 - k) AS kept, arg_max(event, CAST(material AS BIGINT) * 100000000000 - k) AS event, max(material) AS materiality,
       string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs, string_agg(DISTINCT source_event, ',' ORDER BY source_event) AS source_events, string_agg(DISTINCT cross_id, ',' ORDER BY cross_id) AS cross_ids, string_agg(DISTINCT ref_id, '|' ORDER BY ref_id) AS ids FROM ev GROUP BY 1)
     SELECT survivor, n, kept, materiality, refs, source_events, cross_ids, ids || ':' || event AS candidate FROM g""",
)
def c12(spark, sf):
    """One event of all that go together: the most material one (the first of those) with the references, source events (distinct in registry, id, kind and month) and cross ids of all, under an id made anew."""
    o = table(spark, sf, "orders").selectExpr(f"{K} AS k", f"CAST({MATERIAL} AS INT) AS material", f"{SOURCE_EVENT} AS source_event", f"concat({choice(REGISTRIES, 'o_custkey')}, '/', 'R', o_custkey % 9) AS ref", "concat('R', o_custkey % 9) AS ref_id", f"{EVENT} AS event", "concat('c', o_custkey) AS cross_id")
    return merging.merged_events(o.join(_merged(spark, sf, True).select("k", "survivor"), "k"), "survivor", "k", "material")


TERMS = {"observational": ["observational"], "unmet": ["refractory", "children"], "novel": ["first-in-class"], "expansion": ["under the skin", "ocular"], "pivotal": ["pivotal", "confirmatory"]}


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


RANK_SQL = "CASE phase " + " ".join(f"WHEN '{p}' THEN {r}" for p, r in RANKS.items()) + " ELSE -1 END"
IMPORTANCE_SQL = f"""flagged AS (SELECT id, {RANK_SQL} AS rank, {', '.join(f'{_any("lower(title)", w)} AS {x}' for x, w in TERMS.items())} FROM cur),
 important AS (SELECT id, unmet OR novel OR expansion AS strategic, CASE WHEN NOT observational AND (rank >= 3 OR pivotal OR (rank >= 2 AND (unmet OR novel OR expansion))) THEN 'key' WHEN NOT observational AND rank >= 1.5 THEN 'general' ELSE 'early' END AS importance,
   array_to_string(list_filter([CASE WHEN rank >= 3 THEN 'late_phase' END, {', '.join(f"CASE WHEN {x} THEN '{x}' END" for x in ('unmet', 'novel', 'expansion', 'pivotal'))}], lambda x: x IS NOT NULL), ',') AS all_reasons FROM flagged)"""


def important(spark, sf):
    cur, _ = snapshots(spark, sf)
    m = F.create_map(*[x for p, r in RANKS.items() for x in (F.lit(p), F.lit(r))])
    return cur.select("id", "why_stopped", "on_topic", trials.importance(F.lower("title"), F.try_element_at(m, "phase"), TERMS).alias("i")).select("id", "why_stopped", "on_topic", "i.*")


@query("h10_trial_importance", f"WITH {SNAP}, {IMPORTANCE_SQL} SELECT id, importance, strategic, CASE WHEN importance = 'key' THEN all_reasons ELSE '' END AS reasons FROM important")
def h10(spark, sf):
    return important(spark, sf).select("id", "importance", "strategic", F.array_join("reasons", ",").alias("reasons"))


_key = lambda a, b: f"CASE WHEN importance = 'key' THEN '{a}' ELSE '{b}' END"
_in = lambda names: "(" + " OR ".join(f"list_contains(fields, '{n}')" for n in names) + ")"
_listed = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
MATERIAL_SQL = f"""judged AS (SELECT u.id, event, importance, strategic, coalesce(c.on_topic, true) AS on_topic, CASE WHEN event = 'added' THEN {_key('high', 'medium')} WHEN event = 'results_posted' THEN 'high' WHEN event = 'removed' THEN 'minor' WHEN {_in(trials.HIGH_FIELDS)} THEN 'high'
   WHEN event = 'status_changed' AND before = 'UNKNOWN' AND after IN {_listed(trials.RECRUITING)} AND len(fields) = 0 THEN 'minor' WHEN event = 'status_changed' AND after = 'COMPLETED' THEN {_key('high', 'medium')}
   WHEN event = 'status_changed' AND after IN {_listed(trials.STOPPED)} THEN CASE WHEN regexp_matches(lower(why_stopped), 'safety|futility|lack of efficacy|development') THEN 'high' ELSE {_key('medium', 'minor')} END
   WHEN event = 'status_changed' AND after IN {_listed(trials.RUNNING)} THEN {_key('high', 'medium')} WHEN {_in(trials.MEDIUM_FIELDS)} THEN 'medium' ELSE 'minor' END AS materiality FROM updates u LEFT JOIN important i ON i.id = u.id LEFT JOIN cur c ON c.id = u.id)"""


def judged(spark, sf):
    u = trials.updates(*snapshots(spark, sf), "id").join(important(spark, sf), "id", "left")
    material = trials.materiality(F.col("event"), F.col("before"), F.col("after"), F.col("fields"), F.col("why_stopped"), F.col("importance"))
    return u.withColumn("materiality", material).withColumn("on_topic", F.coalesce("on_topic", F.lit(True)))


@query("h11_update_materiality", f"WITH {UPDATES_SQL}, {IMPORTANCE_SQL}, {MATERIAL_SQL} SELECT id, event, materiality FROM judged")
def h11(spark, sf):
    return judged(spark, sf).select("id", "event", "materiality")


@query(
    "h12_decision_matrix",
    f"""WITH {UPDATES_SQL}, {IMPORTANCE_SQL}, {MATERIAL_SQL}, d AS (SELECT *, CASE WHEN NOT on_topic OR event = 'removed' THEN 'exclude' WHEN materiality = 'minor' THEN 'background' ELSE 'include' END AS decision FROM judged),
     s AS (SELECT *, CASE WHEN decision <> 'include' THEN '' WHEN importance = 'key' AND materiality = 'high' THEN 'strong' WHEN importance = 'key' AND materiality = 'medium' OR importance = 'general' AND materiality = 'high' OR importance = 'early' AND materiality = 'high' AND strategic THEN 'medium' ELSE 'weak' END AS strength FROM d)
     SELECT id, event, decision, strength, CASE WHEN decision = 'exclude' THEN 1 WHEN decision = 'background' THEN 2 WHEN strength = 'strong' THEN 5 WHEN strength = 'medium' THEN 4 ELSE 3 END AS score FROM s""",
)
def h12(spark, sf):
    d = trials.decision(F.col("on_topic"), F.col("event"), F.col("importance"), F.col("materiality"), F.col("strategic"))
    return judged(spark, sf).select("id", "event", d.alias("d")).select("id", "event", "d.*")


CLASS_SQL = "CASE agent " + " ".join(f"WHEN '{d}' THEN '{c}'" for d, c in CLASSES.items()) + " ELSE 'other' END"
MATRIX_SQL = f"""{SNAP}, t AS (SELECT DISTINCT agent, {CLASS_SQL} AS class, {RANK_SQL} AS rank, id, phase, status, registry, sponsor, nullif(primary_completion_date, '') AS completion, CASE WHEN results IS NOT NULL THEN nullif(primary_completion_date, '') END AS readout, substring(concat('', o_orderdate), 1, 10) AS start
   FROM (SELECT *, unnest(interventions) AS agent FROM cur) JOIN orders ON {K} = id), b AS (SELECT *, row_number() OVER (PARTITION BY class, agent ORDER BY rank DESC, id) AS rn FROM t)"""


@query(
    "d28_pipeline_matrix",
    f"""WITH {MATRIX_SQL}, src AS (SELECT class, agent, string_agg(registry || ':' || n, ',' ORDER BY registry) AS sources FROM (SELECT class, agent, registry, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
     sp AS (SELECT class, agent, array_to_string(list_sort(list_distinct(list(sponsor) FILTER (WHERE sponsor <> '')))[1:3], ',') AS sponsors FROM t GROUP BY ALL)
     SELECT b.class, b.agent, any_value(CASE WHEN rank >= 0 THEN phase ELSE 'none' END) FILTER (WHERE rn = 1) AS highest_phase, any_value(id) FILTER (WHERE rn = 1) AS key_trial, any_value(registry) FILTER (WHERE rn = 1) AS key_registry, count(*) AS studies,
       count(*) FILTER (WHERE status IN ('RECRUITING', 'ENROLLING_BY_INVITATION', 'NOT_YET_RECRUITING')) AS recruiting, count(*) FILTER (WHERE status = 'ACTIVE_NOT_RECRUITING') AS active, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
       count(*) FILTER (WHERE status IN ('TERMINATED', 'SUSPENDED', 'WITHDRAWN')) AS stopped, any_value(sources) AS sources, any_value(sponsors) AS sponsors, min(start) AS start, max(readout) AS readout, max(completion) AS completion
     FROM b JOIN src USING (class, agent) JOIN sp USING (class, agent) GROUP BY 1, 2""",
)
def d28(spark, sf):
    """Agents by class with the trials' stage, states, sources, sponsors, key trial and dates; the trials themselves are those of h10, by agent."""
    cur, _ = snapshots(spark, sf)
    days = table(spark, sf, "orders").select(F.col(K).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"))
    done = F.when(F.col("primary_completion_date") != "", F.col("primary_completion_date"))
    m = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    t = cur.join(days, "id").select(F.explode(F.array_distinct("interventions")).alias("agent"), F.col("id").alias("trial"), "phase", "status", "registry", "sponsor", "start", done.alias("completion"), F.when(F.col("results").isNotNull(), done).alias("readout"))
    t = t.withColumn("class", F.coalesce(F.try_element_at(m, "agent"), F.lit("other")))
    sources = F.array_join(F.transform("sources", lambda s: F.concat(s["registry"], F.lit(":"), s["n"].cast("string"))), ",")
    return trials.pipeline_matrix(t, RANKS).withColumn("sources", sources).withColumn("sponsors", F.array_join("sponsors", ","))

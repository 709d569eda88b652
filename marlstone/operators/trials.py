"""Trial records: importance, materiality of updates, the decision on them, change texts of all fields and the events of a diff with the fields that moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.diffing import joined, list_moves
from marlstone.operators.ranking import top_k
from marlstone.operators.rules import among, cascade, found, let

RECRUITING = ("RECRUITING", "ENROLLING_BY_INVITATION")
RUNNING = (*RECRUITING, "ACTIVE_NOT_RECRUITING")
STOPPED = ("TERMINATED", "SUSPENDED", "WITHDRAWN")
HIGH_FIELDS = ("phase", "primary_outcome", "interventions", "population")
MEDIUM_FIELDS = ("enrollment_count", "primary_completion_date", "locations_count", "eligibility")


def importance(text: Column, phase: Column, terms: dict[str, Sequence[str]]) -> Column:
    """struct(importance, strategic, reasons) of a trial: key, general or early.

    text: its lower-cased title, type, conditions and interventions; phase: its number (2.5 for two at once), null if it has none. terms: words for
    `observational`, `unmet` needs, `novel` mechanisms, `expansion` and `pivotal` designs. Key are interventional trials of phase 3 or more, pivotal ones, and those of phase 2 or more that
    are strategic (unmet, novel or expansion); general are other interventional ones from 1.5 on.
    """
    hits = found(text, [(t, "substring") for words in terms.values() for t in words])

    def judged(hits: Column) -> Column:
        is_ = {name: among(hits, list(words), "substring") for name, words in terms.items()}
        rank = F.coalesce(phase, F.lit(-1.0))
        strategic = is_["unmet"] | is_["novel"] | is_["expansion"]
        key = ~is_["observational"] & ((rank >= 3) | is_["pivotal"] | ((rank >= 2) & strategic))
        name = cascade([("key", key), ("general", ~is_["observational"] & (rank >= 1.5))], "early")
        reasons = F.array_compact(F.array(F.when(rank >= 3, "late_phase"), *[F.when(is_[x], F.lit(x)) for x in ("unmet", "novel", "expansion", "pivotal")]))
        return F.struct(name.alias("importance"), strategic.alias("strategic"), F.when(key, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))

    return let(F.coalesce(hits, F.array().cast("array<string>")), judged)


def materiality(event: Column, before: Column, after: Column, fields: Column, stopped_for: Column, important: Column, reasons: Sequence[str] = ("safety", "futility", "lack of efficacy", "development")) -> Column:
    """high, medium or minor: what an update means. event: added, removed, results_posted, status_changed or updated; before, after: its status move; fields: the names of fields that moved; stopped_for: the stated reason."""
    key = important == "key"
    among_ = lambda names: F.coalesce(F.arrays_overlap(fields, F.array(*[F.lit(n) for n in names])), F.lit(False))
    moved = event == "status_changed"
    stated = F.coalesce(F.lower(stopped_for).rlike("|".join(reasons)), F.lit(False))
    by = lambda yes, no: F.when(key, yes).otherwise(no)
    out = F.when(event == "added", by("high", "medium")).when(event == "results_posted", F.lit("high")).when(event == "removed", F.lit("minor")).when(among_(HIGH_FIELDS), F.lit("high"))
    out = out.when(moved & (before == "UNKNOWN") & after.isin(*RECRUITING) & (F.size(fields) == 0), F.lit("minor")).when(moved & (after == "COMPLETED"), by("high", "medium"))
    out = out.when(moved & after.isin(*STOPPED), F.when(stated, "high").otherwise(by("medium", "minor"))).when(moved & after.isin(*RUNNING), by("high", "medium"))
    return out.when(among_(MEDIUM_FIELDS), F.lit("medium")).otherwise("minor")


def decision(core: Column, event: Column, important: Column, material: Column, strategic: Column) -> Column:
    """struct(decision, strength, score): excluded are records off the topic and mere removals, background are minor updates; others are included, the stronger the more important and material."""
    kept = cascade([("exclude", ~F.coalesce(core, F.lit(False)) | (event == "removed")), ("background", material == "minor")], "include")
    strong = (important == "key") & (material == "high")
    medium = ((important == "key") & (material == "medium")) | ((important == "general") & (material == "high")) | ((important == "early") & (material == "high") & strategic)

    def scored(kept: Column) -> Column:
        strength = F.when(kept != "include", "").when(strong, "strong").when(medium, "medium").otherwise("weak")
        score = F.when(kept == "exclude", 1).when(kept == "background", 2).when(strong, 5).when(medium, 4).otherwise(3)
        return F.struct(kept.alias("decision"), strength.alias("strength"), score.alias("score"))

    return let(kept, scored)


def _moved(name: str) -> Column:
    return F.col(f"old.{name}").isNotNull() & F.col(f"cur.{name}").isNotNull() & (F.trim(F.col(f"old.{name}").cast("string")) != "") & (F.trim(F.col(f"cur.{name}").cast("string")) != "") & (F.col(f"old.{name}") != F.col(f"cur.{name}"))


def updates(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, event, before, after, fields, text): a row for each event of a record.

    Snapshots: key, status, phase, enrollment_count, enrollment_type, interventions (array), primary_completion_date, locations_count, results. Events are added, removed, results_posted, status_changed;
    `updated` stands alone, for records in which only other fields moved. fields: names of those that moved, the status aside, in a fixed order; text: all moves in words. A value
    that was or became empty is no move, as in a first reading of a detail page.
    """
    j = joined(current, baseline, key)
    both = F.col("cur").isNotNull() & F.col("old").isNotNull()
    came = F.size(F.array_except("cur.interventions", "old.interventions")) > 0
    went = F.size(F.array_except("old.interventions", "cur.interventions")) > 0
    tests = {x: _moved(x) for x in ("enrollment_count", "phase")} | {"interventions": F.coalesce(came | went, F.lit(False))} | {x: _moved(x) for x in ("primary_completion_date", "locations_count")}
    fields = F.array_compact(F.array(*[F.when(both & t, F.lit(x)) for x, t in tests.items()]))
    move = lambda name, label, end="": F.when(_moved(name), F.concat(F.lit(f"{label}: "), F.col(f"old.{name}").cast("string"), F.lit(" -> "), F.col(f"cur.{name}").cast("string"), end if isinstance(end, Column) else F.lit(end)))
    estimated = F.when(F.upper(F.coalesce("cur.enrollment_type", F.lit(""))) == "ESTIMATED", " (estimated)").otherwise("")
    listed = F.when(tests["interventions"], F.concat(F.lit("interventions: "), list_moves(F.col("old.interventions"), F.col("cur.interventions"))))
    text = F.when(both, F.concat_ws("; ", move("status", "status"), move("enrollment_count", "enrollment", estimated), move("phase", "phase"), listed, move("primary_completion_date", "completion"), move("locations_count", "sites", ""))).otherwise("")
    made = j.select(key, F.col("old.status").alias("before"), F.col("cur.status").alias("after"), fields.alias("fields"), text.alias("text"), F.array_compact(F.array(
        F.when(F.col("old").isNull(), F.lit("added")), F.when(F.col("cur").isNull(), F.lit("removed")),
        F.when(both & F.col("cur.results").isNotNull() & F.col("old.results").isNull(), F.lit("results_posted")), F.when(both & _moved("status"), F.lit("status_changed")),
    )).alias("events"))
    events = F.when(F.size("events") > 0, F.col("events")).when(F.size("fields") > 0, F.array(F.lit("updated"))).otherwise(F.array().cast("array<string>"))
    return made.select(key, F.explode(events).alias("event"), "before", "after", "fields", "text")


def pipeline_matrix(trials: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """A row for each agent of trials(class, agent, phase, status, registry, sponsor, trial, start, readout, completion), a trial for each of its agents.

    highest_phase and key_trial (of the highest phase, the least trial on ties), counts by status and by registry, the first three sponsors in alphabetical order, earliest start, latest
    readout and completion. Nothing that grows with a group is held: sponsors are reduced to three while they are counted. ranks: the rank of each phase label.
    """
    m = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    rank = F.coalesce(F.try_element_at(m, "phase"), F.lit(-1.0))
    t = trials.withColumn("__rank", rank).select("*", F.struct(F.col("__rank"), (-F.col("trial")).alias("less"), "phase", "registry").alias("__best"))
    by = ["class", "agent"]
    whole = t.groupBy(*by).agg(
        F.count("*").alias("studies"), F.max("__best").alias("best"), F.count_if(F.col("status").isin(*RECRUITING, "NOT_YET_RECRUITING")).alias("recruiting"),
        F.count_if(F.col("status") == "ACTIVE_NOT_RECRUITING").alias("active"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status").isin(*STOPPED)).alias("stopped"),
        F.min("start").alias("start"), F.max("readout").alias("readout"), F.max("completion").alias("completion"),
    )
    sources = t.groupBy(*by, "registry").agg(F.count("*").alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("registry", "n"))).alias("sources"))  # a few registries
    names = t.where("sponsor is not null and sponsor <> ''").groupBy(*by, "sponsor").agg(F.lit(1).alias("n"))
    few = top_k(names, by, [F.asc("sponsor")], 3).groupBy(*by).agg(F.array_sort(F.collect_list("sponsor")).alias("sponsors"))
    j = whole.join(sources, by, "left").join(few, by, "left")
    return j.select(
        *by, F.when(F.col("best.__rank") >= 0, F.col("best.phase")).otherwise("none").alias("highest_phase"), (-F.col("best.less")).alias("key_trial"), F.col("best.registry").alias("key_registry"), "studies",
        "recruiting", "active", "completed", "stopped", "sources", F.coalesce("sponsors", F.array().cast("array<string>")).alias("sponsors"), "start", "readout", "completion",
    )

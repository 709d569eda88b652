"""Ordered rule classifiers over texts and names, as nested column expressions whose rules are data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.rules import among, cascade, found, has, let


@dataclass(frozen=True)
class Step:
    """One step of a cascade: a label for texts that have one of `any_terms`, all of `all_terms` and none of `no_terms`."""

    label: str
    any_terms: tuple[str, ...] = ()
    all_terms: tuple[str, ...] = ()
    no_terms: tuple[str, ...] = ()
    kind: str = "substring"


def step_terms(steps: Sequence[Step]) -> list[tuple[str, str]]:
    return [(t, s.kind) for s in steps for t in (*s.any_terms, *s.all_terms, *s.no_terms)]


def step_test(hits: Column, s: Step) -> Column:
    """Whether a step fits a text of which the found terms are given."""
    out = among(hits, s.any_terms, s.kind) if s.any_terms else F.lit(True)
    for t in s.all_terms:
        out = out & among(hits, [t], s.kind)
    return out & ~among(hits, s.no_terms, s.kind) if s.no_terms else out


def by_steps(text: Column, steps: Sequence[Step], default: str) -> Column:
    """The label of the first step that fits the lower-cased text, whose terms are found in one pass."""
    return let(found(text, step_terms(steps)), lambda hits: cascade([(s.label, step_test(hits, s)) for s in steps], default))


def level_of(label: Column, levels: dict[str, str], default: str | None = None) -> Column:
    """A label's level by map."""
    m = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return F.coalesce(F.try_element_at(m, label), F.lit(default).cast("string"))


def largest_number(text: Column, patterns: Sequence[str]) -> Column:
    """The largest number that any of the patterns' first groups finds (sample sizes); null without one."""
    found = F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(text, F.lit(p), 1), F.array().cast("array<string>")) for p in patterns]))
    return F.array_max(F.transform(found, lambda x: F.regexp_replace(x, "[,. ]", "").cast("int")))


def calibrated(score: Column, adjustments: Sequence[tuple[Column, str, float]]) -> Column:
    """A score after ordered adjustments (condition, add or times, amount): each applies to the result of those before it."""
    out = score
    for cond, how, x in adjustments:
        out = F.when(F.coalesce(cond, F.lit(False)), out + x if how == "add" else out * x).otherwise(out)
    return out


def confidence(score: Column, lead: Column) -> Column:
    return cascade([("high", (score >= 10) & (lead >= 3)), ("medium", score >= 6)], "low")


def activity(df: DataFrame, by: str, high: Column, every: DataFrame | None = None) -> DataFrame:
    """(by, level): active if any row is of high activity, watch if there are other rows, quiet for groups of `every` without any."""
    seen = df.groupBy(by).agg(F.when(F.coalesce(F.bool_or(high), F.lit(False)), "active").otherwise("watch").alias("level"))
    return seen if every is None else every.select(by).join(seen, by, "left").withColumn("level", F.coalesce("level", F.lit("quiet")))


def title_first(title_tags: Column, other_tags: Column) -> Column:
    """Tags of the title are final; others count only where it has none."""
    return F.when(F.size(title_tags) > 0, title_tags).otherwise(other_tags)


def last_place(text: Column, places: Sequence[tuple[str, str]]) -> Column:
    """The place whose term stands last in the lower-cased text (longer terms first on ties); null without one."""
    spots = [F.struct((F.length(text) - F.instr(F.reverse(text), t[::-1]) + 1).alias("at"), F.lit(len(t)).alias("n"), F.lit(name).alias("name")) for t, name in places]
    found = F.array_compact(F.array(*[F.when(has(text, t), s) for (t, _), s in zip(places, spots, strict=True)]))
    return F.array_max(found)["name"]


def decision(levels: Sequence[Column], table: dict[tuple[str, ...], str], default: str) -> Column:
    """A decision table over several level columns."""
    key = F.concat_ws("|", *levels)
    m = F.create_map(*[F.lit(x) for k, v in table.items() for x in ("|".join(k), v)])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def flags(text: Column, steps: Sequence[Step]) -> Column:
    """Labels of all steps that fit the lower-cased text, in order."""
    return let(found(text, step_terms(steps)), lambda hits: F.array_compact(F.array(*[F.when(step_test(hits, s), F.lit(s.label)) for s in steps])))


def contexts(text: Column, pattern: str, before: int, after: int) -> Column:
    """For each match of a pattern, in order: the match with up to `before` characters in front of it and `after` behind it. Contexts of near matches overlap."""
    pieces, found = F.split(text, pattern, -1), F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))

    def one(match: Column, i: Column) -> Column:
        start = F.length(F.array_join(F.slice(pieces, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(found, F.lit(1), i), "")) + 1
        first = F.greatest(F.lit(1), start - before)
        return F.substring(text, first, start - first + F.length(match) + after)

    return F.transform(found, one)


def own_and_derived(text: Column, pattern: str, derived: str, before: int, after: int) -> tuple[Column, Column]:
    """How many matches of a design's pattern are the text's own, and how many stand beside words that show another work's design."""
    around = contexts(text, pattern, before, after)
    other = F.size(F.filter(around, lambda c: c.rlike(derived)))
    return F.size(around) - other, other


def first_place(label: Column, raw: Column, places: Sequence[tuple[str, str]], countries: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(place, how): the first rule whose bounded term the label has, else the raw text has, else the country that the raw text names. Both texts are lower-cased."""
    steps = [(how, name, has(text, term, "word")) for how, text, table in (("label", label, places), ("raw", raw, places), ("country", raw, countries)) for term, name in table]
    place, via = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for how, name, test in steps:
        place, via = place.when(test, F.lit(name)), via.when(test, F.lit(how))
    return place, via


def hospital_of(affiliation: Column, overrides: dict[str, str]) -> Column:
    """struct(name, kind): the first comma or semicolon part that names a hospital, or else another care organisation; a known other name is replaced."""
    parts = F.filter(F.transform(F.split(affiliation, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    hospital = F.get(F.filter(parts, lambda p: F.lower(p).rlike(r"\bhospital\b|\binfirmary\b")), F.lit(0))
    other = F.get(F.filter(parts, lambda p: F.lower(p).rlike(r"\b(centre|center|clinic|university|institute|board)\b")), F.lit(0))
    name = F.coalesce(hospital, other)
    m = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    kind = F.when(hospital.isNotNull(), "hospital").when(other.isNotNull(), "organisation").otherwise("none")
    return F.struct(F.coalesce(F.try_element_at(m, F.lower(name)), name).alias("name"), kind.alias("kind"))


def agent_names(raw: Column, aliases: dict[str, str]) -> Column:
    """Canonical names of the agents in an intervention: combinations are split, doses and routes stripped; an exact alias, else the longest alias inside the part, else the
    part itself. Aliases to '' (comparators that are no agent) are dropped, as repeats are."""
    parts = F.split(F.lower(raw), r"\s*\+\s*|\s+combined with\s+|\s+plus\s+")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\b\d+([.]\d+)?\s*(mg|ml|g|mcg|iu)\b", ""), r"\b(oral|tablets?|injections?|infusions?|intravenous|topical)\b", "")))
    by_length = sorted(aliases.items(), key=lambda kv: (-len(kv[0]), kv[0]))

    def name(p: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for a, n in by_length:
            out = out.when(p == a, F.lit(n))
        for a, n in by_length:
            out = out.when(F.contains(p, F.lit(a)), F.lit(n))
        return out.otherwise(p)

    return F.array_distinct(F.filter(F.transform(bare, name), lambda n: n != ""))

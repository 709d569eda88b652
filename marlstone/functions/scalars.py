"""Column functions for dates, names, texts and values. All but nfkc stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyyMMdd")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SEASONS = {"winter": 1, "spring": 4, "summer": 7, "autumn": 10, "fall": 10}


def lenient_date(value: Column) -> Column:
    """A date from mixed notations: full patterns first, then year-month-day, year-month or year found anywhere; missing parts count as 1."""
    tried = [F.to_date(F.try_to_timestamp(value, F.lit(p))) for p in DATE_PATTERNS]
    part = lambda pattern, n: F.expr("cast(null as int)") if n is None else F.nullif(F.regexp_extract(value, pattern, n), F.lit("")).cast("int")
    ymd, ym, y = r"(\d{4})\D(\d{1,2})\D(\d{1,2})", r"(\d{4})\D(\d{1,2})", r"(\d{4})"
    made = [
        F.try_make_timestamp(part(ymd, 1), part(ymd, 2), part(ymd, 3), F.lit(0), F.lit(0), F.lit(0)),
        F.try_make_timestamp(part(ym, 1), part(ym, 2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
        F.try_make_timestamp(part(y, 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
    ]
    return F.coalesce(*tried, *[F.to_date(m) for m in made])


def publication_date(value: Column) -> Column:
    """yyyy, yyyy-MM or yyyy-MM-dd from notations such as `2021 Mar 5`, `2021 Spring` and `2019 Nov-Dec`; null without a year."""
    year = F.nullif(F.regexp_extract(value, r"(\d{4})", 1), F.lit(""))
    word = F.lower(F.regexp_extract(value, r"\d{4}\s+([A-Za-z]+)", 1))
    month = F.coalesce(*[F.when(F.substring(word, 1, 3) == m, F.lit(f"{i + 1:02d}")) for i, m in enumerate(MONTHS)], *[F.when(word == s, F.lit(f"{m:02d}")) for s, m in SEASONS.items()])
    day = F.nullif(F.regexp_extract(value, r"\d{4}\s+[A-Za-z]+\s+(\d{1,2})$", 1), F.lit(""))
    return F.when(year.isNotNull(), F.concat_ws("-", year, month, F.when(month.isNotNull(), F.lpad(day, 2, "0"))))


def months_back(day: Column, n: int) -> Column:
    """The same day n months earlier, or that month's last."""
    return F.add_months(day, -n)


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def bare_key(value: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def camel(value: Column) -> Column:
    """camelCase of the words of a name."""
    joined = F.replace(F.initcap(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", " ")), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def nfkc(value: Column) -> Column:
    """Unicode compatibility form, for which Spark has no function."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))

    return run(value)


def quote_key(value: Column, compatible: bool = True) -> Column:
    """A text reduced for comparing quotes: compatibility form, no soft hyphens, lower case, letters and digits only."""
    base = nfkc(value) if compatible else value
    return F.regexp_replace(F.lower(F.replace(base, F.lit("­"), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def cut_at_word(value: Column, limit: int) -> Column:
    """At most limit characters, cut where a word ends."""
    head = F.substring(value, 1, limit + 1)
    cut = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(value) <= limit, value).otherwise(F.when(F.length(cut) > limit, F.substring(value, 1, limit)).otherwise(cut))


def first_sentence(value: Column) -> Column:
    return F.regexp_extract(value, r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1)


def name_parts(value: Column, separators: str = "[,;]") -> Column:
    """The trimmed, non-empty parts of a name."""
    return F.filter(F.transform(F.split(value, separators), lambda p: F.trim(p)), lambda p: p != "")


def found_all(value: Column, pattern: str, group: int = 0) -> Column:
    """All matches, distinct and sorted; an empty array for a null value."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(value, F.lit(pattern), group), F.array().cast("array<string>"))))


def phase_label(value: Column) -> Column:
    """Phase I to IV, also as 1/2 and the like; NA otherwise. Reads roman and arabic numbers after the word phase."""
    token = F.upper(F.regexp_extract(value, r"(?i)phase\s*([IV1-4]+(?:\s*/\s*[IV1-4]+)?)", 1))
    roman = token
    for digit, letters in (("4", "IV"), ("3", "III"), ("2", "II"), ("1", "I")):
        roman = F.replace(roman, F.lit(digit), F.lit(letters))
    return F.when(token == "", F.lit("NA")).otherwise(F.concat(F.lit("Phase "), F.regexp_replace(roman, r"\s+", "")))


def phase_rank(label: Column) -> Column:
    """The highest phase in a label, 0 for none."""
    ranks = F.transform(F.split(F.replace(label, F.lit("Phase "), F.lit("")), "/"), lambda p: F.when(p == "IV", 4).when(p == "III", 3).when(p == "II", 2).when(p == "I", 1).otherwise(0))
    return F.array_max(ranks)


def without_sentinels(day: Column, sentinels: tuple[str, ...] = ("1900",)) -> Column:
    """Null for blank dates and those that begin with a placeholder."""
    bad = F.trim(day) == ""
    for s in sentinels:
        bad |= F.startswith(day, F.lit(s))
    return F.when(~bad, day)


def http_url(value: Column) -> Column:
    """The URL if its scheme is http or https."""
    return F.when(F.lower(value).rlike(r"^https?://[^\s/]+"), value)


def script_share(value: Column, letters: str = r"\p{IsHan}", others: str = r"[A-Za-z]") -> Column:
    """Share of one script among letters of two; null where there are none."""
    a, b = F.regexp_count(value, F.lit(letters)), F.regexp_count(value, F.lit(others))
    return F.try_divide(a, a + b)


def row_revision(*columns: str) -> Column:
    """A hash of a row's content, of the named columns in name order; nulls differ from blanks."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def outer_json(value: Column) -> Column:
    """The text from the first opening to the last closing brace: an object inside free text."""
    return F.nullif(F.regexp_extract(value, r"(?s)(\{.*\})", 1), F.lit(""))


def chunks(value: Column, size: int, overlap: int) -> Column:
    """array<struct<start, chunk>>: overlapping pieces of a text that cover it; none for an empty one."""
    step = size - overlap
    starts = F.when(F.length(value) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(value) - overlap - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(value, s + 1, F.lit(size)).alias("chunk")))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b, rounded; 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)


def bucket(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the range that a value lies in; bounds are the ranges' upper ends, the last range has none. Null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for b, n in zip(bounds, names, strict=False):
        out = out.when(value < b, F.lit(n))
    return out.otherwise(F.lit(names[-1]))


def org_label(value: Column) -> Column:
    """An organisation's name without footnote marks and an article before it, without punctuation at its end, white space closed up."""
    squeezed = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(squeezed, r"^(?:[\d*†‡#,.;]+ *)*(?:(?i:the) )?", ""), r"[\s.,;:]+$", "")


def phase_digits(value: Column) -> Column:
    """The phases named in a text as digits: `Phase II/III` gives 2/3; empty without any."""
    digit = F.create_map(*[F.lit(x) for kv in {"I": "1", "II": "2", "III": "3", "IV": "4"}.items() for x in kv])
    named = F.regexp_extract_all(F.upper(value), F.lit(r"\b(IV|III|II|I|[1-4])\b"), F.lit(1))
    return F.coalesce(F.array_join(F.transform(named, lambda x: F.coalesce(F.try_element_at(digit, x), x)), "/"), F.lit(""))


def labelled_section(value: Column, wanted: list[str], labels: list[str]) -> Column:
    """The text under the first of the wanted labels (`Results: ...`) up to the next label, or the whole text if it has none of them."""
    found = [F.regexp_extract(value, rf"(?is)(?:^|[\s.;])(?:{w})\s*:\s*(.*?)(?=(?:^|[\s.;])(?:{'|'.join(labels)})\s*:|\z)", 1) for w in wanted]
    return F.coalesce(*[F.when(F.trim(f) != "", F.trim(f)) for f in found], value)


def sentences(value: Column) -> Column:
    """The sentences of a text with single spaces: cut behind a full stop or semicolon before a capital letter."""
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.filter(F.split(F.regexp_replace(flat, r"([.;]) (?=\p{Lu})", "$1\u0001"), "\u0001"), lambda s: s != "")


def metric_sentences(value: Column, anchors: str, numbers: str, extras: str, n: int, least_chars: int = 24, least_score: int = 3, limit: int = 220) -> Column:
    """The n sentences that report most: two points for an anchor, two for a number, one for an extra word; the short ones first, each of a key (its letters and digits, 80 of them) once."""
    low = lambda s: F.lower(s)
    points = lambda s: F.when(low(s).rlike(anchors), 2).otherwise(0) + F.when(low(s).rlike(numbers), 2).otherwise(0) + F.when(low(s).rlike(extras), 1).otherwise(0)
    scored = F.transform(sentences(value), lambda s, i: F.struct((-points(s)).alias("less"), F.length(s).alias("n"), i.alias("i"), s.alias("s"), F.substring(F.regexp_replace(low(s), r"[^\p{L}\p{N}]+", " "), 1, 80).alias("k")))
    ranked = F.array_sort(F.filter(scored, lambda x: (x["n"] >= least_chars) & (x["less"] <= -least_score)))
    once = F.filter(ranked, lambda x, i: ~F.exists(F.slice(ranked, F.lit(1), i), lambda y: y["k"] == x["k"]))
    cut = lambda s: F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit)), F.lit("…"))).otherwise(s)
    return F.transform(F.slice(once, 1, n), lambda x: cut(x["s"]))

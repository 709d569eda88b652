"""Rules as data: dictionary term matching, ordered cascades, weighted scores and tags."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KINDS = ("substring", "word", "regex")


@dataclass(frozen=True)
class Rule:
    """A label's term. kind: substring, word (bounded by anything but letters and digits) or regex."""

    label: str
    term: str
    weight: float = 1.0
    kind: str = "substring"


def term_pattern(term: str, kind: str) -> str:
    """A Java pattern for a term over lower-cased text."""
    if kind == "regex":
        return term
    body = re.escape(term)
    return body if kind == "substring" else rf"(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])"


def has(text: Column, term: str, kind: str = "substring") -> Column:
    """Whether the text, already lower-cased, has the term; false for null."""
    hit = F.contains(text, F.lit(term)) if kind == "substring" else text.rlike(term_pattern(term, kind))
    return F.coalesce(hit, F.lit(False))


def any_of(text: Column, terms: list[str], kind: str = "substring") -> Column:
    """Whether the text has one of the terms: one alternation, compiled once."""
    return F.coalesce(text.rlike("|".join(term_pattern(t, kind) for t in terms)), F.lit(False)) if terms else F.lit(False)


def mentions(text: Column, terms: list[str], kind: str = "word") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("|".join(term_pattern(t, kind) for t in terms))), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trie_pattern(terms: Iterable[str]) -> str:
    """A Java pattern for any of the terms, the longest first, that reads each letter once: alternatives with common beginnings share them."""
    trie: dict = {}
    for t in sorted(set(terms)):
        node = trie
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(c) + written(child) for c, child in sorted(node.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return body + "?" if "" in node else body

    return written(trie)


def tag(term: str, kind: str) -> str:
    return f"{kind}:{term}"


def _found_literally(text: Column, terms: set[str], kind: str) -> Column:
    body = trie_pattern(terms)
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?=({body})(?![\p{{L}}\p{{N}}]))" if kind == "word" else f"(?=({body}))"
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    whole = {t: [p for p in sorted(terms) if t.startswith(p) and (kind == "substring" or len(p) == len(t) or not t[len(p)].isalnum())] for t in sorted(terms)}
    if all(len(ps) == 1 for ps in whole.values()):
        return F.transform(hits, lambda t: F.concat(F.lit(f"{kind}:"), t))
    table = F.create_map(*[x for t, ps in whole.items() for x in (F.lit(t), F.array(*[F.lit(tag(p, kind)) for p in ps]))])
    return F.flatten(F.transform(hits, lambda t: F.element_at(table, t)))


def found(text: Column, terms: Iterable[tuple[str, str]]) -> Column:
    """Tags of the (term, kind) pairs that the lower-cased text has, by one pass over the text for words, one for substrings and one for each regular expression. Empty for null.

    A pass looks at every place for the longest term that begins there; shorter ones that begin there too are its beginnings, and are added from a table. So terms may overlap.
    """
    terms = list(dict.fromkeys(terms))
    parts = [_found_literally(text, {t for t, k in terms if k == kind and t}, kind) for kind in ("word", "substring") if any(k == kind for _, k in terms)]
    regexes = [F.when(text.rlike(t), F.lit(tag(t, k))) for t, k in terms if k == "regex"]
    if regexes:
        parts.append(F.array_compact(F.array(*regexes)))
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.concat(*parts)), none) if parts else none


def among(hits: Column, terms: Sequence[str], kind: str) -> Column:
    """Whether one of the terms is among the found ones."""
    return F.arrays_overlap(hits, F.array(*[F.lit(tag(t, kind)) for t in terms])) if terms else F.lit(False)


def labels_hit(text: Column, rules: list[Rule]) -> Column:
    """Labels with at least one hit, in the rules' order."""

    def labels(hits: Column) -> Column:
        names = list(dict.fromkeys(r.label for r in rules))
        tags = {x: [F.lit(tag(r.term, r.kind)) for r in rules if r.label == x] for x in names}
        return F.array_compact(F.array(*[F.when(F.arrays_overlap(hits, F.array(*tags[x])), F.lit(x)) for x in names]))

    return let(found(text, [(r.term, r.kind) for r in rules]), labels)


def score(text: Column, title: Column, rules: list[Rule], bonus: dict[float, float] | None = None) -> Column:
    """Sum of the weights of the terms that the text has, with a bonus by weight for those in the title."""
    terms = [(r.term, r.kind) for r in rules]

    def total(both: Column) -> Column:
        out = F.lit(0.0)
        for r in rules:
            extra = (bonus or {}).get(r.weight, 0.0)
            titled = F.when(among(both["title"], [r.term], r.kind), extra).otherwise(0.0) if extra else F.lit(0.0)
            out = out + F.when(among(both["text"], [r.term], r.kind), F.lit(r.weight) + titled).otherwise(0.0)
        return out

    return let(F.struct(found(text, terms).alias("text"), found(title, terms).alias("title")), total)


def cascade(steps: list[tuple[str, Column]], default: str) -> Column:
    """The label of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, cond in steps:
        out = out.when(F.coalesce(cond, F.lit(False)), F.lit(label))
    return out.otherwise(F.lit(default))


def near(text: Column, a: str, b: str, distance: int) -> Column:
    """Whether two terms stand within `distance` characters of each other, in either order."""
    x, y = re.escape(a), re.escape(b)
    return F.coalesce(text.rlike(rf"(?s){x}.{{0,{distance}}}{y}|{y}.{{0,{distance}}}{x}"), F.lit(False))


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """The rules as a table (label, term, weight, kind, ord)."""
    if odd := {r.kind for r in rules} - set(KINDS):
        raise ValueError(f"unknown kinds of rules: {sorted(odd)}")
    return spark.createDataFrame([(r.label, r.term, r.weight, r.kind, i) for i, r in enumerate(rules)], "label string, term string, weight double, kind string, ord int")


def matched_rules(df: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """(key, label, term, weight, ord) for every rule of a list that a row's lower-cased text has: one pass over each text, nothing moved. The same answer as `has` gives for each."""
    table = rule_table(df.sparkSession, rules).withColumn("__tag", F.concat_ws(":", "kind", "term"))  # as large as the list
    hits = df.select(key, F.explode(found(F.lower(text), [(r.term, r.kind) for r in rules])).alias("__tag"))
    return hits.join(F.broadcast(table), "__tag").select(key, "label", "term", "weight", "ord")


def matched(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, label, term, weight, ord) for every rule of a table that a row's lower-cased text has; the same answer as `has` gives for each. Where the rules are a list, matched_rules reads each text once.

    Rules of one word are matched by an equi-join on the text's distinct words. The others are tested against each text, for which the rules, a dictionary of
    bounded size, are broadcast: substrings by containment, regular expressions and words with other characters in them by their pattern.
    An unknown kind fails.
    """
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of rule: "), F.coalesce("kind", F.lit("null")))).cast("string"))
    rules = rules.withColumn("kind", known)
    one_word = (F.col("kind") == "word") & F.col("term").rlike(r"^[\p{L}\p{N}]+$")
    words = df.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("term"))
    by_word = words.join(F.broadcast(rules.where(one_word)), "term").select(key, "label", "term", "weight", "ord")
    literal = F.regexp_replace("term", r"([^\p{L}\p{N}\s])", r"\\$1")
    pattern = F.when(F.col("kind") == "regex", F.col("term")).when(F.col("kind") == "word", F.concat(F.lit(r"(?<![\p{L}\p{N}])"), literal, F.lit(r"(?![\p{L}\p{N}])")))
    other = rules.where(~one_word).withColumn("pattern", pattern)
    low = df.select(key, F.lower(text).alias("__t"))
    hit = F.when(F.col("pattern").isNull(), F.contains("__t", "term")).otherwise(F.regexp_like("__t", "pattern"))
    by_part = low.join(F.broadcast(other), hit).select(key, "label", "term", "weight", "ord")
    return by_word.unionByName(by_part)

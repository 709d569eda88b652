"""Operators on small inputs in the cases that the driver tables do not have."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import classifiers, communities, decisions, diffing, gates, graphs, merging, packing, ranking, rules, trials
from marlstone.operators import quotes as quote_index
from marlstone.plans import registry, source_queries
from marlstone.sources import readers, writers


def values(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


def test_upsert_precedence_and_classes(spark):
    base = spark.createDataFrame([("1", "a", "x"), ("2", "b", None), ("3", "c", "z")], "k string, v string, p string")
    inc = spark.createDataFrame([("1", "", "new"), ("2", "B", "new"), ("4", "d", "w")], "k string, v string, p string")
    out = {r["k"]: (r["v"], r["p"], r["change"]) for r in merging.upsert(base, inc, "k", protected=("p",)).collect()}
    assert out == {"1": ("a", "x", "unchanged"), "2": ("B", "new", "updated"), "3": ("c", "z", "untouched"), "4": ("d", "w", "added")}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("1", "a")], "k string, v string")
    inc = spark.createDataFrame([("1", "b"), ("2", "c")], "k string, v string")
    once = merging.upsert(base, inc, "k").drop("change")
    assert {r["change"] for r in merging.upsert(once, inc, "k").collect()} == {"unchanged"}


def test_relevance_gate_reasons(spark):
    rows = [(1, "a study of ague", "", []), (2, "gout and ague", "", []), (3, "gout", "ague ague", []), (4, "x", "", ["Ague"]), (5, "x", "ague ague", []), (6, "x", "one ague", []), (7, None, None, None)]
    df = spark.createDataFrame(rows, "id int, t string, b string, m array<string>")
    g = gates.relevance(F.col("t"), F.col("b"), F.col("m"), ["ague"], ["gout"])
    got = {r["id"]: (r["g"]["keep"], r["g"]["reason"]) for r in df.select("id", g.alias("g")).collect()}
    assert got == {
        1: (True, "explicit_title"), 2: (True, "explicit_title"), 3: (False, "competing_title"), 4: (True, "metadata_term"), 5: (True, "repeated_mention"), 6: (False, "background_mention"), 7: (False, "no_mention"),
    }


def test_snapshot_diff_classes(spark):
    ddl = "id string, status string, first string, upd string, res string"
    old = spark.createDataFrame([("a", "open", "2024-01-01", "2024-01-01", None), ("b", "open", "2024-01-01", "2024-01-01", None), ("c", "open", "2024-01-01", "2024-01-01", None), ("gone", "open", "2024-01-01", "2024-01-01", None)], ddl)
    cur = spark.createDataFrame([("a", "closed", "2024-01-01", "2024-03-01", "2024-03-01"), ("b", "open", "2024-01-01", "2024-03-01", None), ("c", "open", "2024-01-01", "2024-01-01", None), ("new", "open", "2024-03-01", "2024-03-01", None)], ddl)
    day = diffing.window_start(F.lit("2024-03-03").cast("date"), F.lit(None).cast("date"))
    got = values(diffing.change_events(cur, old, "id", "status", "first", "res", "upd", day), "id", "event")
    assert got == [("a", "results_posted"), ("a", "status_changed"), ("b", "updated"), ("gone", "removed"), ("new", "added")]
    assert diffing.change_events(cur, cur, "id", "status", "first", "res", "upd", day).count() == 0
    assert diffing.change_events(cur, old.limit(0), "id", "status", "first", "res", "upd", day).count() == 0


def test_window_stretches_back_to_the_last_baseline(spark):
    date = lambda d: F.lit(d).cast("date")
    starts = spark.range(1).select(*[diffing.window_start(date("2024-03-31"), date(p)).cast("string").alias(n) for n, p in (("fresh", "2024-03-29"), ("week", "2024-03-24"), ("outage", "2024-03-11"), ("long", "2023-01-01"), ("none", None))]).first()
    assert tuple(starts) == ("2024-03-24", "2024-03-24", "2024-03-11", "2024-03-03", "2024-03-24")


def test_change_map_separates_enrichment(spark):
    old = spark.createDataFrame([("1", "Unknown", "a"), ("2", "x", "a"), ("3", "x", "a")], "k string, f string, g string")
    cur = spark.createDataFrame([("1", "found", "a"), ("2", "y", "a"), ("3", "x", "a"), ("4", "n", "n")], "k string, f string, g string")
    assert values(diffing.change_map(cur, old, "k", ["f", "g"]), "k", "kind") == [("1", "enriched"), ("2", "updated"), ("3", "unchanged"), ("4", "added")]


def test_shrink_guard_and_preservation(spark):
    good = spark.range(10)
    assert diffing.guarded(spark.range(5), good)[1] is False and diffing.guarded(spark.range(6), good)[1] is True
    empty = good.where("id < 0")
    assert diffing.preserved(empty, good, True).count() == 10 and diffing.preserved(empty, good, False).count() == 0


def test_manifest_accumulates_and_resets(spark):
    prev = spark.createDataFrame([("2024-01-01", "a")], "week_start string, k string").withColumn("week_start", F.to_date("week_start"))
    new = spark.createDataFrame([("b",)], "k string")
    same = merging.ingest_manifest(prev, new, F.lit("2024-01-03").cast("date"), "k")
    later = merging.ingest_manifest(prev, new, F.lit("2024-01-09").cast("date"), "k")
    assert values(same, "k") == [("a",), ("b",)] and values(later, "k") == [("b",)]


def test_components_chain_cycle_and_single(spark):
    ids = spark.createDataFrame([(i,) for i in range(12)], "node long")
    links = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(9, 10), (10, 9), (11, 11)], "a long, b long")
    assert values(graphs.components(ids, links), "node", "label") == sorted([(i, 0) for i in range(9)] + [(9, 9), (10, 9), (11, 11)], key=repr)
    assert graphs.components(ids.limit(0), links.limit(0)).count() == 0


def test_dates(spark):
    df = spark.createDataFrame([("2024/03/05 10:20",), ("20240305",), ("on 2024-3-5",), ("2024-03",), ("2024",), ("",), (None,)], "s string")
    assert [str(r[0]) for r in df.select(S.lenient_date(F.col("s"))).collect()] == ["2024-03-05", "2024-03-05", "2024-03-05", "2024-03-01", "2024-01-01", "None", "None"]
    pub = spark.createDataFrame([("2021 Mar 5",), ("2021 Spring",), ("2019 Nov-Dec",), ("2020",), ("none",)], "s string")
    assert [r[0] for r in pub.select(S.publication_date(F.col("s"))).collect()] == ["2021-03-05", "2021-04", "2019-11", "2020", None]


def test_texts_and_names(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.quote_key(F.lit("ﬁne so­ft, 12!"))) == "finesoft12"
    assert get(S.camel(F.lit("A long-name here"))) == "aLongNameHere"
    assert get(S.outer_json(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'
    assert [c["chunk"] for c in get(S.chunks(F.lit("abcdefghij"), 4, 1))] == ["abcd", "defg", "ghij"]
    assert get(S.chunks(F.lit(""), 4, 1)) == []
    assert get(S.phase_label(F.lit("Phase 2/3 trial"))) == "Phase II/III" and get(S.phase_rank(F.lit("Phase II/III"))) == 3
    assert get(S.first_filled(F.lit(" "), F.lit(None).cast("string"), F.lit("c"))) == "c"


def test_rules(spark):
    df = spark.createDataFrame([(1, "an mg patient"), (2, "mgx"), (3, None)], "id int, t string")
    assert [r[0] for r in df.select(rules.has(F.col("t"), "mg", "word")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(rules.has(F.col("t"), "mg")).collect()] == [True, True, False]
    x = spark.range(1).select(classifiers.calibrated(F.lit(2.0), [(F.lit(True), "add", 3.0), (F.lit(True), "times", 0.5), (F.lit(None).cast("boolean"), "add", 9.0)]).alias("x"))
    assert x.first()["x"] == 2.5
    assert spark.range(1).select(classifiers.largest_number(F.lit("n = 1,204 and 30"), [r"([\d,]+)"])).first()[0] == 1204


def test_ranking_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 4, 1)], "g string, id int, s int")
    assert values(ranking.top_k(df, ["g"], [F.desc("s"), F.asc("id")], 2), "g", "id", "rank") == [("a", 1, 1), ("a", 2, 2), ("b", 4, 1)]
    assert values(ranking.mode_of(df.selectExpr("g", "cast(s as string) as v"), ["g"], "v"), "g", "v") == [("a", "5"), ("b", "1")]


def test_decisions_cover_every_id_once(spark):
    every = spark.createDataFrame([(i,) for i in range(6)], "id long")
    sig = spark.createDataFrame([(1, 0), (1, 1), (1, 99), (2, 1), (2, 2)], "signal long, id long")
    claimed = decisions.claims(sig, every, "id")
    assert values(claimed, "id", "signal") == [(0, 1), (1, 1), (2, 2)]
    merged = decisions.with_fallback(claimed, every, F.lit(7).cast("long"), "id")
    assert merged.count() == 6 and merged.select("id").distinct().count() == 6
    assert values(decisions.accepted(sig, claimed, "id"), "signal") == []


def test_quotes(spark):
    verdict = lambda q, t: spark.range(1).select(decisions.quote_verdict(F.lit(q), F.lit(t))).first()[0]
    long = "abcdefghij" * 5
    assert verdict("abc", "xxabcxx") == "whole" and verdict("", "abc") == "none" and verdict("zzz", "abc") == "none"
    assert verdict(long, long[:36] + "zzz") == "prefix" and verdict(long, long[:30]) == "none"
    assert verdict("12" + long, "xx" + long[:9] + "7" + long[9:]) == "digits" and verdict("1abc", "abc") == "none"


def test_quote_index_finds_what_all_pairs_find(spark):
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abc1"), n))
    texts = [letters(int(n)) for n in rng.integers(0, 300, 60)] + ["a" * 400, None, ""]
    quotes = []
    for i in range(80):
        t = texts[int(rng.integers(0, 60))]
        lo, n = int(rng.integers(0, 100)), int(rng.integers(1, 90))
        q = t[lo : lo + n]
        quotes.append(q if i % 3 == 0 else q[: int(len(q) * 0.8)] + letters(10) if i % 3 == 1 else q[:10] + "99" + q[10:])
    quotes += ["a" * 60, "", None]
    ts = spark.createDataFrame(list(enumerate(texts)), "text_id long, t string")
    qs = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, q string")
    want = qs.crossJoin(ts).select("quote_id", "text_id", decisions.quote_verdict(F.col("q"), F.col("t")).alias("v")).where("v <> 'none' and q <> '' and t <> ''")
    got = quote_index.verified(qs, ts, "quote_id", F.col("q"), "text_id", F.col("t"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want) and {r[2] for r in rows(got)} == {"whole", "prefix", "digits"}
    assert quote_index.verified(qs.limit(0), ts, "quote_id", F.col("q"), "text_id", F.col("t")).count() == 0


def test_headless_table_and_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("Junk,,\nReg. No.,Title,x\nR1,one,\n,two,\nR3,three,\n")
    (tmp_path / "t" / "b.csv").write_text("Title,Registration Number,x\nfour,R4,\n")
    out = readers.headless_table(spark, path, {"regno": "id", "registrationnumber": "id", "title": "title"}, "id", 3)
    assert values(out, "id", "title") == [("R1", "one"), ("R3", "three"), ("R4", "four")]
    listed = writers.file_manifest(spark, path)
    seen = {r["path"]: (r["bytes"], r["sha256"]) for r in listed.collect()}
    frozen = spark.createDataFrame([(p, b, s) for p, (b, s) in seen.items()], "path string, bytes long, sha256 string")
    assert writers.manifest_problems(writers.file_manifest(spark, path), frozen).count() == 0
    (tmp_path / "t" / "a.csv").write_text("other\n")
    (tmp_path / "t" / "c.csv").write_text("more\n")
    assert sorted(r["problem"] for r in writers.manifest_problems(writers.file_manifest(spark, path), frozen).collect()) == ["differs", "unlisted"]


def test_rules_of_every_kind_match_as_has_does(spark):
    from marlstone.operators import rules

    texts = ["in vitro work, then c++ code", "in  vitro", "the (vitro) cell-line", "Cell lines and randomised trials", None, ""]
    table = [rules.Rule("a", "in vitro", 1.0, "word"), rules.Rule("a", "cell-line", 1.0, "word"), rules.Rule("b", "c++", 1.0, "word"), rules.Rule("b", "vitro", 1.0, "word"), rules.Rule("c", r"randomi[sz]ed", 1.0, "regex"), rules.Rule("c", "cell line", 1.0)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["id"], r["term"]) for r in rules.matched(df, "id", "text", rules.rule_table(spark, table)).collect()}
    want = {(r["id"], t.term) for t in table for r in df.where(rules.has(F.lower("text"), t.term, t.kind)).collect()}
    assert got == want and {(0, "in vitro"), (0, "c++"), (2, "cell-line"), (3, "randomi[sz]ed"), (3, "cell line")} <= want and (1, "in vitro") not in want
    with pytest.raises(ValueError):
        rules.rule_table(spark, [rules.Rule("a", "b", 1.0, "fuzzy")])


def test_contexts_are_cut_around_each_match(spark):
    from marlstone.operators import classifiers

    text = "randomized aaaa randomly assigned bbbb were pooled cc randomized"
    df = spark.createDataFrame([(text,), ("none",), (None,)], "t string")
    rows = df.select(classifiers.contexts(F.col("t"), "randomized|randomly assigned", 6, 8).alias("c")).collect()
    assert rows[0]["c"] == ["randomized aaaa ra", " aaaa randomly assigned bbbb we", "ed cc randomized"] and rows[1]["c"] == [] and not rows[2]["c"]
    own, derived = classifiers.own_and_derived(F.col("t"), "randomized|randomly assigned", "were pooled", 6, 20)
    assert df.select(own.alias("o"), derived.alias("d")).first() == (2, 1)


def test_header_is_found_in_files_that_are_read_in_splits(spark, tmp_path):
    from marlstone.sources import readers

    (tmp_path / "a.csv").write_text("junk\n,,\nReg. No.,Note\n" + "".join(f"r{i},n{i}\n" for i in range(400)))
    (tmp_path / "b.csv").write_text("Note,Reg No\n" + "".join(f"m{i},s{i}\n" for i in range(300)) + "Reg No,Note\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = readers.headless_table(spark, str(tmp_path), {"regno": "id", "note": "note"}, "id", 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r["id"], r["note"]) for r in rows} == {(f"r{i}", f"n{i}") for i in range(400)} | {(f"s{i}", f"m{i}") for i in range(300)} | {("Note", "Reg No")}


def test_references_are_numbered_in_each_publication(spark):
    cited = spark.createDataFrame([("p", 9, 1), ("p", 4, 2), ("p", 9, 3), ("p", 7, 4), ("q", 7, 1)], "pub string, ref long, at long")
    known = spark.createDataFrame([(9,), (7,)], "ref long")
    got = {tuple(r) for r in decisions.numbered_references(cited, known, "pub", "at", "ref").collect()}
    assert got == {("p", 9, 1), ("p", 7, 2), ("p", 4, None), ("q", 7, 1)}


def test_author_roles_and_mails(spark):
    rows = [(1, [("A", ["x a@b.org; y a@b.org."], True), ("B", None, True), ("C", [None, "z"], False)]), (2, [("D", [], False), ("E", ["no mail"], True)]), (3, []), (4, None)]
    papers = spark.createDataFrame(rows, "paper int, authors array<struct<author: string, affiliations: array<string>, equal: boolean>>")
    got = {r["author"]: (r["pos"], r["emails"], r["is_first"], r["is_last"], r["is_corresponding"], r["corresponding_by"]) for r in readers.author_rows(papers, "paper", "authors").collect()}
    assert got == {
        "A": (1, ["a@b.org"], True, False, True, "email"), "B": (2, [], True, False, False, "email"), "C": (3, [], False, True, False, "email"),
        "D": (1, [], True, False, False, "last author"), "E": (2, [], False, True, True, "last author"),
    }


def test_tables_in_html_and_spreadsheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "<table><TR><th>A b:</th><td>1</td></tr><tr><td>a B</td><td>2</td></tr><tr><td>alone</td></tr></table>"), (2, ""), (3, None)], "id int, html string")
    got = {r["id"]: (r["n"], r["m"]) for r in df.select("id", F.size(readers.html_rows(F.col("html"))).alias("n"), readers.first_values(readers.html_rows(F.col("html"))).alias("m")).collect()}
    assert got == {1: (3, {"ab": "1"}), 2: (0, {}), 3: (0, {})}
    cell = '<Cell><Data ss:Type="String">{}</Data></Cell>'
    lines = [["junk"], ["Number", "The title"], ["7", "a&nbsp;&amp; b &what;"], ["", "no key"]]
    (tmp_path / "s.xml").write_text("<Workbook><Table>" + "".join("<Row ss:Height='1'>\n" + "\n".join(cell.format(c) for c in r) + "</Row>\n" for r in lines) + "</Table></Workbook>")
    found = readers.spreadsheet_table(spark, str(tmp_path / "s.xml"), {"number": "id", "thetitle": "title"}, "id").collect()
    assert [tuple(r) for r in found] == [("7", "a & b &what;")]


def test_deltas_are_applied_whole_or_not_at_all(spark):
    docs = spark.createDataFrame([(1, "one two", "a"), (2, "one two", "a"), (3, None, "a"), (4, "x", "a"), (5, "one", "a")], "id int, text string, f string")
    deltas = spark.createDataFrame([(1, ["one", "two"], "b"), (2, ["one", "three"], "b"), (3, ["one"], "b"), (5, ["one"], None)], "id int, quotes array<string>, f string")
    got = {r["id"]: (r["state"], r["f"]) for r in decisions.delta_applied(docs, deltas, "id", "text", ["f"]).collect()}
    assert got == {1: ("applied", "b"), 2: ("rejected", "a"), 3: ("pending", "a"), 4: ("pending", "a"), 5: ("applied", "a")}


def test_graph_health_of_lonely_and_heavy_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 90), (2, 3, 10)], "a int, b int, n long")
    nodes = spark.createDataFrame([(1, "drug"), (2, "topic"), (3, "drug"), (4, "topic")], "node int, kind string")
    got = {r["node"]: (r["degree"], r["weight"], r["weak"], r["oversized"], r["isolated"], r["missing"]) for r in graphs.health(edges, nodes, ["drug", "topic"], 20, 0.9, 2).collect()}
    assert got == {1: (1, 90, 0, True, False, ["drug"]), 2: (2, 100, 1, True, False, ["topic"]), 3: (1, 10, 1, False, False, ["drug"]), 4: (0, 0, 0, False, True, ["drug", "topic"])}
    none = graphs.health(edges.limit(0), nodes, ["drug"], 20, 0.9, 2).collect()
    assert len(none) == 4 and all(r["isolated"] and not r["oversized"] for r in none)


def test_names_labels_phases_and_search(spark):
    names = spark.createDataFrame([("LANCET",), ("New England",), ("of it",), (None,)], "short string")
    d = spark.createDataFrame([("Lancet", 1), ("The New England Journal", 2), ("England today", 3)], "name string, ord int")
    assert {r["short"]: r["name"] for r in merging.canonical_names(names, "short", d).collect()} == {"LANCET": "Lancet", "New England": "The New England Journal", "of it": None, None: None}
    t = spark.createDataFrame([("1* The  Big\nClinic. ;", "Phase II/III"), ("Theatre", "none"), (None, None)], "a string, p string")
    assert [tuple(r) for r in t.select(S.org_label(F.col("a")), S.phase_digits(F.col("p"))).collect()] == [("Big Clinic", "2/3"), ("Theatre", ""), (None, "")]
    p = spark.createDataFrame([("Ann Lee", "Ann Lee oncology")], "n string, t string")
    score = lambda q: p.select(ranking.search_score(q, F.col("n"), F.col("t"), F.lit(1)).alias("s")).first()["s"]
    assert (score("ann lee"), score("oncology"), score("xyz"), score("  ")) == (6 + 6 + 12 + 4 + 1, 3 + 6 + 1, 1, 1)


def test_terms_found_in_one_pass(spark):
    """Overlapping terms, terms that begin alike, edges of words, substrings and regular expressions: as `has` finds them one by one."""
    terms = [(t, "word") for t in ("meta", "meta analysis", "network meta", "analysis of", "a", "c++", "x-ray")] + [(t, "substring") for t in ("et", "ana", "analysis o", ".")] + [("[0-9]{3}", "regex")]
    texts = ["network meta analysis of x-ray", "metal x-rays 123", "c++ a.", "", None, "meta", "the analysis of\nmeta", "éa a9", "ANALYSIS"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    one_by_one = F.array_sort(F.array_compact(F.array(*[F.when(rules.has(F.col("t"), t, k), F.lit(f"{k}:{t}")) for t, k in terms])))
    for r in df.select("id", F.array_sort(rules.found(F.col("t"), terms)).alias("got"), one_by_one.alias("want")).collect():
        assert r["got"] == r["want"], texts[r["id"]]
    listed = [rules.Rule(f"l{i % 3}", t, float(i), k) for i, (t, k) in enumerate(terms)]
    assert values(rules.matched_rules(df, "id", "t", listed), "id", "label", "term", "ord") == values(rules.matched(df, "id", "t", rules.rule_table(spark, listed)), "id", "label", "term", "ord")


def fold(records, merged_titles):
    """The ordered merge, one record after another."""
    of_id, of_title, out = {}, {}, []
    for k, ids, title in records:
        keys = {x.strip().lower() for x in ids} - {""}
        key = "".join(c for c in title.lower() if c.isalnum())
        known = [of_id[x] for x in keys if x in of_id]
        at = min(known) if known else of_title.get(key) if len(key) >= 40 else None
        out.append((k, k if at is None else at, "first" if at is None else "id" if known else "title"))
        at = k if at is None else at
        of_id.update(dict.fromkeys(keys, at))
        if merged_titles or at == k:
            of_title[key] = at
    return sorted(out)


@pytest.mark.parametrize("merged_titles", [False, True])
def test_ordered_merge_is_the_fold(spark, merged_titles):
    rng = np.random.default_rng(5)
    title = lambda i: f"A study of the long effects of agent {i} in many places"
    for _ in range(4):
        records = [(k, [f"r{k}", *[f" X{int(x)}" for x in rng.integers(0, 25, int(rng.integers(0, 3)))], ""], title(int(rng.integers(0, 12))) if rng.random() < 0.5 else "short") for k in range(40)]
        df = spark.createDataFrame(records, "k long, ids array<string>, title string")
        got = merging.ordered_merge(df, "k", F.col("ids"), F.col("title"), merged_titles=merged_titles)
        assert values(got, "k", "survivor", "how") == sorted(fold(records, merged_titles), key=repr)
    bridge = [(1, ["x"], "a"), (2, ["y"], "b"), (3, ["x", "y"], "c"), (4, ["y"], "d")]
    df = spark.createDataFrame(bridge, "k long, ids array<string>, title string")
    # what a later record links stays apart, unlike in a connected component
    assert values(merging.ordered_merge(df, "k", F.col("ids"), F.col("title")), "k", "survivor") == [(1, 1), (2, 2), (3, 1), (4, 1)]


def test_merged_titles_follow_ids_once(spark):
    df = spark.createDataFrame([(1, ["x"], "a"), (2, ["x"], "b")], "k long, ids array<string>, title string")
    links = merging.earlier_records(df, "k", F.col("ids"), F.col("title"), merged_titles=True)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert values(links, "a", "b", "how") == [(2, 1, "id")]


def test_long_chains_of_titles_take_few_jobs(spark):
    """Every title links to the one before it and every third record to an id that crosses: rounds over all links took more jobs the longer the chains were."""
    title = "Randomised confirmatory study, in two parts, of agent "
    records = [(k, [f"r{k}", *([f"x{k // 12}"] if k % 6 < 2 else []), *([f"y{k // 40}"] if k % 7 == 3 else [])], f"{title}{k % 11}" if k % 4 == 0 else "short") for k in range(3000)]
    df = spark.createDataFrame(records, "k long, ids array<string>, title string")
    spark.sparkContext.setJobGroup("chains", "")
    try:
        got = values(merging.ordered_merge(df, "k", F.col("ids"), F.col("title"), merged_titles=True), "k", "survivor", "how")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chains")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted(fold(records, True), key=repr)
    assert len(jobs) <= 40


@pytest.mark.parametrize("size", [30, 1000])
def test_least_earlier_is_the_fold_over_ranges(spark, size):
    """Near and far links, followed in ranges that do and do not shrink."""
    rng = np.random.default_rng(3)
    for reach in (4, 150):
        links = [(a, int(b)) for a in range(1, 150) for b in {max(0, a - 1 - int(x)) for x in rng.integers(0, min(a, reach), int(rng.integers(0, 4)))}]
        want = list(range(150))
        for a, b in sorted(links):
            want[a] = min(want[a], want[b])
        ids, df = spark.range(150).select(F.col("id").alias("node")), spark.createDataFrame(links, "a long, b long")
        assert dict(values(graphs.least_earlier(ids, df, size), "node", "label")) == dict(enumerate(want))
    assert values(graphs.least_earlier(ids, df.limit(0), size).where("node < 2"), "node", "label") == [(0, 0), (1, 1)]


def test_backfill_tells_all_balances(spark, tmp_path):
    """Balances of -1 and null: a third of the customers each is filled, overwritten and kept, as the SQL says."""
    rows = [(k, "A", None if k > 5 else -1.0) for k in range(12)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.QUERIES["c4_metrics_backfill"](spark, str(tmp_path))
    assert values(got, "action", "n") == [("filled", 4), ("kept", 4), ("overwritten", 4)]


def test_signals_of_clusters_are_judged_once(spark):
    files = registry.QUERIES["d4_signal_clusters"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("documents.parquet" in f for f in files)


def test_xml_goes_into_small_files(spark, monkeypatch):
    monkeypatch.setattr(source_queries, "XML_ROWS", 100, raising=False)
    x = registry.QUERIES["a10_xml_flatten"](spark, "/root/testdata/sf0.001")
    assert len(x.inputFiles()) >= 15 and x.count() == 1500


def test_authors_are_gathered_without_their_texts(spark):
    plan = registry.QUERIES["a11_author_flatten"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    gathered = [line for line in plan.splitlines() if "partial_collect_list" in line]
    assert gathered and not any("Second unit" in line for line in gathered)


def test_best_fits_are_those_of_all_pairs(spark, monkeypatch):
    """Against all pairs, with many copies of texts, ties and matrices cut into pieces."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(9)]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(90)] + [(90, None)], "module long, t string")
    interests = spark.createDataFrame([(p, i, w, int(rng.integers(1, 9))) for p in range(30) for i, w in enumerate(rng.permutation(words)[:5].tolist())], "c long, place int, term string, n long")
    tags = spark.createDataFrame([(p, " W3") for p in range(20)], "c long, tag string")
    want = ranking.top_k(communities.profile_fit(interests, tags, texts, "c", "module", "t"), ["c"], [F.desc("score"), F.asc("module")], 4)
    monkeypatch.setattr(communities, "PROFILES", 7, raising=False)
    monkeypatch.setattr(communities, "SETS", 11, raising=False)
    columns = ["c", "module", "score", "matched", "rank"]
    assert values(communities.best_fits(interests, tags, texts, "c", "module", "t", 4), *columns) == values(want, *columns)


def test_quote_in_a_very_long_text(spark):
    """A text of 1.5 million letters is cut in one pass; counted off from its begin for every piece it took minutes."""
    text = "".join(np.random.default_rng(8).choice(list("abcdefghiñó"), 1_500_000))
    qs = spark.createDataFrame([(1, text[-60:]), (2, text[700_000:700_030]), (3, "z" * 60)], "quote_id long, q string")
    ts = spark.createDataFrame([(7, text)], "text_id long, t string")
    begin = time.monotonic()
    got = quote_index.verified(qs, ts, "quote_id", F.col("q"), "text_id", F.col("t"))
    assert values(got, "quote_id", "text_id", "verdict") == [(1, 7, "whole"), (2, 7, "whole")] and time.monotonic() - begin < 60


def test_batches_are_not_sent_to_the_driver(spark):
    """Only the sums of ranges, a row for each, are broadcast."""
    plan = registry.QUERIES["g16_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("__range" in line for line in joins)


def test_components_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT", 3)
    ids = spark.range(40).select(F.col("id").alias("node"))
    links = spark.createDataFrame([(0, i) for i in range(1, 20)] + [(i, i + 1) for i in range(20, 30)], "a long, b long")
    got = dict(values(graphs.components(ids, links), "node", "label"))
    assert got == {i: 0 if i < 20 else 20 if i <= 30 else i for i in range(40)}


def test_pairs_of_an_item_with_many_nodes(spark):
    """2,000 nodes of one item: all their pairs, over several tasks."""
    m = spark.range(2000).select(F.lit(1).alias("item"), F.col("id").alias("node")).unionByName(spark.createDataFrame([(2, 5), (2, 6), (2, 6), (None, 1), (3, None)], "item int, node long"))
    p = graphs.pairs(m, "item", "node")
    assert p.count() == 2000 * 1999 // 2 and p.where("a = 5 and b = 6").first()["n"] == 2 and p.where("a >= b").count() == 0
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        parts = graphs.item_pairs(m, "item", "node", split=100).where("item = 1").groupBy(F.spark_partition_id()).count().count()
    finally:
        for k in plain:
            spark.conf.unset(k)
    assert parts > 1


def test_evidence_edges_by_kinds(spark):
    m = spark.createDataFrame([(i, n) for i in range(6) for n in ("a", "b", "c", "d")] + [(9, "a"), (9, "b")], "item int, node string")
    items = spark.createDataFrame([(i, "II" if i < 2 else "IV", 1.5, f"2020-0{i + 1}-01") for i in range(6)] + [(9, None, 0.5, "2021-01-01")], "item int, level string, score double, day string")
    kinds = spark.createDataFrame([("a", "drug"), ("b", "topic"), ("c", "level"), ("d", "level")], "node string, kind string")
    e = graphs.evidence_edges(m, items, kinds, "item", "node", ["I", "II", "III", "IV"], "level", [(("drug",), 2), (("level",), 7)], [(("drug", "topic"), "studied in"), (("level",), "evidence")], 4, "together")
    # level with level is skipped; a level needs seven items unless a drug is the other end
    assert values(e, "a", "b", "relation", "n", "best_level", "high", "score", "updated", "confidence") == [
        ("a", "b", "studied in", 7, "II", 2, 9.5, "2021-01-01", "medium"), ("a", "c", "evidence", 6, "II", 2, 9.0, "2020-06-01", "medium"), ("a", "d", "evidence", 6, "II", 2, 9.0, "2020-06-01", "medium"),
    ]


def test_top_lists_are_cut_before_the_shuffle(spark, capsys):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = ranking.top_lists(df, ["g"], [F.desc("id")], 2, F.col("id"), "ids")
    assert {r["g"]: list(r["ids"]) for r in top.collect()} == {0: [999, 996], 1: [997, 994], 2: [998, 995]}
    top.explain()
    assert "Partial" in capsys.readouterr().out


def test_calibration_is_ordered(spark):
    a = communities.Adjustment
    scores = spark.createDataFrame([(1, "x", 4.0), (1, "y", 4.0), (2, "x", 4.0), (3, "x", 0.0), (4, "z", 1.0)], "id int, community string, score double")
    flags = spark.createDataFrame([(1, ["p", "q"]), (2, ["p", "r"]), (3, ["p"]), (4, [])], "id int, flags array<string>")
    table = [a("x", ("p",), "add", 6), a("x", ("q",), "times", 0.5), a("x", ("p",), "add", 1, ("r",)), a("y", ("q",), "times", 0.5), a("y", ("p",), "add", 6)]
    assert values(communities.calibrated(scores, flags, "id", table), "id", "community", "score") == [(1, "x", 6.0), (1, "y", 8.0), (2, "x", 10.0), (3, "x", 0.0), (4, "z", 1.0)]


def test_assignment(spark):
    records = spark.createDataFrame([(1, []), (2, ["case"]), (3, []), (4, []), (5, ["case"])], "id int, flags array<string>")
    scores = spark.createDataFrame([(1, "x", 12.0, ["t"]), (1, "y", 9.5, []), (2, "x", 7.0, []), (3, "x", 2.9, []), (5, "y", 7.0, ["u"]), (5, "x", 7.0, ["v"])], "id int, community string, score double, hits array<string>")
    got = communities.assigned(records, scores, "id", ["y", "x"], [communities.Forced(("case",), 8.0, spared=("y",))])
    assert values(got, "id", "community", "confidence", "state") == [(1, "x", "medium", "conflict"), (2, None, "unassigned", "unassigned,scope_review"), (3, None, "unassigned", "unassigned"), (4, None, "unassigned", "unassigned"), (5, "y", "medium", "conflict")]
    assert {r["id"]: [tuple(x) for x in r["secondary"]] for r in got.collect()} == {1: [("y", 9.5)], 2: [], 3: [], 4: [], 5: [("x", 7.0)]}


def test_terms_in_texts(spark):
    terms = spark.createDataFrame([("cell line",), ("line",), ("x-ray",), ("",), (None,), ("of the cell",)], "term string")
    texts = spark.createDataFrame([(1, "A Cell line of the cell"), (2, "cell-line; x-ray"), (3, "outline cells"), (4, None)], "id int, t string")
    assert values(communities.terms_in_texts(terms, texts, "id", "t"), "id", "term") == [(1, "cell line"), (1, "line"), (1, "of the cell"), (2, "line"), (2, "x-ray")]


def test_trial_updates_and_decisions(spark):
    ddl = "id int, status string, phase string, enrollment_count int, enrollment_type string, interventions array<string>, primary_completion_date string, locations_count int, results string"
    old = spark.createDataFrame([(1, "UNKNOWN", "Phase 2", 10, "ACTUAL", ["a", "b"], "2024", 3, None), (2, "RECRUITING", None, None, None, [], "", None, None), (3, "RECRUITING", "Phase 1", 5, None, ["a"], "2024", 1, None)], ddl)
    cur = spark.createDataFrame([(1, "RECRUITING", "Phase 3", 12, "Estimated", ["b", "c"], "2025", 3, "x"), (2, "RECRUITING", "Phase 1", 9, None, [], "2024", 4, None), (4, "RECRUITING", "Phase 1", 5, None, ["a"], "2024", 1, None)], ddl)
    got = {(r["id"], r["event"]): r for r in trials.updates(cur, old, "id").collect()}
    assert set(got) == {(1, "results_posted"), (1, "status_changed"), (3, "removed"), (4, "added")}  # 2: values that were empty are no moves
    assert got[1, "status_changed"]["fields"] == ["enrollment_count", "phase", "interventions", "primary_completion_date"]
    assert got[1, "status_changed"]["text"] == "status: UNKNOWN -> RECRUITING; enrollment: 10 -> 12 (estimated); phase: Phase 2 -> Phase 3; interventions: +c, -a; completion: 2024 -> 2025"
    rows = [("status_changed", "UNKNOWN", "RECRUITING", [], "", "key", "minor"), ("status_changed", "X", "COMPLETED", [], "", "general", "medium"), ("status_changed", "X", "TERMINATED", [], "lack of efficacy", "early", "high"), ("status_changed", "X", "WITHDRAWN", [], None, "key", "medium"),
            ("updated", None, None, ["phase"], None, "early", "high"), ("updated", None, None, ["locations_count"], None, "key", "medium"), ("removed", None, None, ["phase"], None, "key", "minor"), ("added", None, None, [], None, "key", "high"), ("updated", None, None, [], None, None, "minor")]
    df = spark.createDataFrame(rows, "event string, b string, a string, f array<string>, why string, i string, want string")
    c = F.col
    assert all(r["m"] == r["want"] for r in df.select("want", trials.materiality(c("event"), c("b"), c("a"), c("f"), c("why"), c("i")).alias("m")).collect())
    grid = [(core, e, i, m, s) for core in (True, False) for e in ("added", "removed") for i, m in itertools.product(("key", "general", "early"), ("high", "medium", "minor")) for s in (True, False)]
    d = spark.createDataFrame(grid, "core boolean, e string, i string, m string, s boolean").select("*", trials.decision(c("core"), c("e"), c("i"), c("m"), c("s")).alias("d"))
    for r in d.collect():
        if not r["core"] or r["e"] == "removed":
            want = ("exclude", "", 1)
        elif r["m"] == "minor":
            want = ("background", "", 2)
        else:
            medium = (r["i"], r["m"]) in (("key", "medium"), ("general", "high")) or (r["i"] == "early" and r["m"] == "high" and r["s"])
            want = ("include", "strong", 5) if (r["i"], r["m"]) == ("key", "high") else ("include", "medium", 4) if medium else ("include", "weak", 3)
        assert tuple(r["d"]) == want


def packed_by_hand(sizes, most):
    out, batch, used = [], 0, 0
    for n in sizes:
        if n > most:
            batch += used > 0
            out.append(batch)
            batch, used = batch + -(-n // most), 0
            continue
        if used and used + n > most:
            batch, used = batch + 1, 0
        out.append(batch)
        used += n
    return out


def test_batches_are_the_greedy_ones(spark):
    rng = np.random.default_rng(8)
    for most in (1, 5, 12):
        sizes = [int(x) for x in rng.integers(1, 9, 120)] + [40, 1, 1, 40, 40, 3]
        rng.shuffle(sizes)
        df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long").repartition(7)
        assert [r["batch"] for r in packing.batches(df, "k", "n", most).orderBy("k").collect()] == packed_by_hand(sizes, most)
    assert packing.batches(df.limit(0), "k", "n", 5).count() == 0


def test_batches_of_repeated_keys(spark):
    """Groups of equal keys are in one order in all steps, the smaller first or by further columns, also where rows come from several partitions."""
    rng = np.random.default_rng(9)
    sizes = sorted((k // 10, int(n)) for k, n in enumerate(rng.integers(1, 9, 200)))
    df = spark.createDataFrame(sizes, "k long, n long").repartition(7)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = values(packing.batches(df, "k", "n", 12), "k", "n", "batch")
        back = values(packing.batches(df.withColumn("later", -F.col("n")), "k", "n", 12, ("later",)), "k", "n", "batch")
    finally:
        spark.conf.unset(coalesce)
    for found, order in ((got, sizes), (back, sorted(sizes, key=lambda x: (x[0], -x[1])))):
        assert found == sorted([(k, n, b) for (k, n), b in zip(order, packed_by_hand([n for _, n in order], 12), strict=True)], key=repr)


def test_chunks_of_odd_documents(spark, tmp_path):
    """An empty text is one empty chunk, a text without an id has no chunk and no place before others, as the SQL says; texts of one id come as in the file."""
    rows = [(None, "x" * 19_500), (1, ""), (2, None), (3, "y" * 1001), (4, "z" * 17_500), (4, "z" * 17_500), (5, "")]
    rows += [(6, "v" * 1000 * n) for n in (19, 18, 1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["g16_chunks"](spark, str(tmp_path)).withColumn("n", F.length("chunk"))
    copies = [(4, 1000 * i, 500 if i == 17 else 1000, b) for i in range(18) for b in (1, 1, 2, 2)]
    copies += [(6, 1000 * i, 1000, b) for n in (19, 18, 1, 2) for i in range(n) for b in (3, 4, 4, 5)]
    assert values(got, "doc_id", "start", "n", "batch") == sorted([(1, 0, 0, 0), (3, 0, 1000, 0), (3, 1000, 1, 0), (5, 0, 0, 2), *copies], key=repr)


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(200)], "k long, v long").repartition(9)
    got = [r["t"] for r in packing.running_total(df, ["k"], F.col("v"), "t").orderBy("k").collect()]
    assert got == list(itertools.accumulate(i % 5 for i in range(200)))


def test_seeded_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 == 0).alias("s"))
    one = values(ranking.seeded_sample(df, ["s"], "id", 20, 3), "id")
    assert one == values(ranking.seeded_sample(df.repartition(13), ["s"], "id", 20, 3), "id") and len(one) == 40
    assert one != values(ranking.seeded_sample(df, ["s"], "id", 20, 4), "id")


def test_guaranteed_member_and_fallback(spark):
    df = spark.createDataFrame([("a", 9, False), ("b", 8, False), ("c", 7, False), ("d", 2, True), ("e", 1, True)], "t string, s int, w boolean")
    order = [F.desc("s"), F.asc("t")]
    assert values(ranking.guaranteed(df, order, 3, F.col("w")), "t", "place") == [("a", 1), ("b", 2), ("d", 3)]
    assert values(ranking.guaranteed(df, order, 4, F.col("w")), "t") == [("a",), ("b",), ("c",), ("d",)]
    assert values(ranking.guaranteed(df.where("not w"), order, 2, F.col("w")), "t") == [("a",), ("b",)]
    spare = spark.createDataFrame([("none", 0, False)], df.schema)
    assert values(ranking.or_fallback(df.limit(0), spare), "t") == [("none",)] and ranking.or_fallback(df, spare).count() == 5


def test_digest_of_a_multiset(spark):
    rows = [(i, None if i % 3 else "x", "") for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    cols = ["a", "b", "c"]
    d = lambda df: (lambda r: (r["n"], r["digest"]))(decisions.table_digest(df, cols).first())
    assert d(df) == d(df.repartition(7).orderBy(F.desc("a"))) and d(df) != d(df.unionByName(df.limit(1))) and d(df.limit(0))[0] == 0
    assert len({d(df), d(df.withColumn("b", F.when(F.col("a") == 5, "y").otherwise(F.col("b")))), d(df.withColumn("b", F.coalesce("b", F.lit("")))), d(df.select("a", F.col("c").alias("b"), F.col("b").alias("c")))}) == 4


def test_sections_and_sentences_with_figures(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    text = "Background: Old news. Methods: Ten were asked. RESULTS: The score fell by 4%. It held. Conclusions: Fine."
    labels = ["background", "methods?", "results?", "conclusions?"]
    assert one(S.labelled_section(F.lit(text), ["results?", "conclusions?"], labels)) == "The score fell by 4%. It held."
    assert one(S.labelled_section(F.lit("no labels"), ["results?"], labels)) == "no labels" and one(S.labelled_section(F.lit("Results: "), ["results?"], labels)) == "Results: "
    said = "The response was 40 % at week 4. THE RESPONSE WAS 40 % AT WEEK 4. A long sentence about nothing at all. The response reached 5 points. Short 5 %."
    got = one(S.metric_sentences(F.lit(said), "response|week|%", r"\d", "baseline", 2))
    assert got == ["The response reached 5 points.", "The response was 40 % at week 4."] and one(S.metric_sentences(F.lit(""), "a", "b", "c", 2)) == []

"""Corpus operators against brute force, and in their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, fingerprints, language_id, lexical, mixing, near_dedup, quality, queries, sharding, topk, toxicity, variants, warc
from marlstone.llm.shingles import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40_000


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


# language ID


def samples():
    en = ["the cat sat on the mat and the dog was there with them", "this is the house that stood by the river in the north"]
    fr = ["le chat est sur la table et le chien est avec eux dans la maison", "les enfants jouent dans le jardin avec leurs amis"]
    return [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in en] * 5 + [(t, "fr") for t in fr] * 5)]


def test_language_edges(spark):
    labelled = frame(spark, [*samples(), (100, None, "en"), (101, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit_profiles(labelled)
    rows = [(1, "the dog and the cat", "keep", 9), (2, None, "keep", 9), (3, "", "keep", 9), (4, "123 !!", "keep", 9), (5, LONG + " the cat", "keep", 9), (1, "the dog and the cat", "keep", 9), (None, "les enfants de la maison", "keep", 9)]
    out = language_id.identify(frame(spark, rows, "doc_id long, text string, lang_pred string, score int"), model).collect()
    got = [(r["doc_id"], r["lang_pred"]) for r in out]
    assert len(got) == 7 and got.count((1, "en")) == 2 and (None, "fr") in got
    assert {(2, "und"), (3, "und"), (4, "und")} <= set(got)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language_id.identify(frame(spark, []), model).count() == 0
    nothing = language_id.fit_profiles(labelled.limit(0))
    assert language_id.identify(frame(spark, [(1, "the")]), nothing).first()["lang_pred"] == "und"


def test_bundle_is_the_sum_of_bound_trigrams():
    text, dims, seed = "abba ab", 64, 3
    v = {c: language_id.letter_vectors(np.array([ord(c)]), dims, seed)[0] for c in "ab"} | {" ": np.ones(dims, np.float32)}
    want = np.zeros(dims)
    padded = " abba ab "
    for i in range(len(padded) - 2):
        x, y, z = padded[i : i + 3]
        if y != " ":
            want += np.roll(v[x], 2) * np.roll(v[y], 1) * v[z]
    assert np.allclose(language_id.bundle([text, "zz"], dims, seed)[0], want)
    assert np.allclose(language_id.bundles([text], dims, seed)[0], want)


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)


# WARC


def test_warc_round_trip_and_edges(spark, tmp_path):
    big = "é" * 600  # 1200 bytes
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "short"), (4, "http://c\r\nX: y", "short"), (5, "u", None), (6, "u", ""), (None, "n", big), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 100), (3, None, "short")]
    base = f"file://{tmp_path}/a"
    manifest = warc.write_archives(frame(spark, rows, "page_id long, url string, html string"), base, shard_bytes=1000, file_bytes=300)
    assert manifest.count() > 2 and not [p for p in (tmp_path / "a" / "_temporary").iterdir()]
    out = warc.read_archives(spark, base).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["page_id"]].append(r)
    assert by[2][0]["record_type"] == "response" and by[2][0]["payload"] == big
    assert (by[1][0]["record_type"], by[1][0]["refers_to"], by[1][0]["payload_bytes"]) == ("revisit", 2, 1200)
    assert by[None][0]["refers_to"] == 2 and by[None][0]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert len(by[3]) == 2 and all(r["record_type"] == "response" for i in (3, 4, 5, 6, 7) for r in by[i])
    assert by[5][0]["payload_bytes"] == 0 and by[7][0]["payload"] == rows[7][2]


def test_warc_is_deterministic_and_empty(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a = warc.write_archives(pages, f"file://{tmp_path}/a", shard_bytes=100_000, file_bytes=20_000)
    b = warc.write_archives(pages.repartition(7), f"file://{tmp_path}/b", shard_bytes=100_000, file_bytes=20_000)
    key = lambda m: sorted((r["final"], r["sha256"]) for r in m.collect())
    assert key(a) == key(b)
    none = f"file://{tmp_path}/c"
    assert warc.write_archives(pages.limit(0), none).count() == 0 and warc.read_archives(spark, none).count() == 0


# toxicity


@pytest.fixture(scope="module")
def grams():
    words = "idiot stupid moron trash loser worthless clown pathetic the dog sat on this mat with that house river stone better kitten".split()
    g = Counter()
    for w in words * 20:
        for i in range(len(w) + 1):
            g[("^^" + w + "$")[i : i + 3]] += 1
    return dict(g)


def test_viterbi_restores_words(grams):
    d = toxicity.Restorer(grams)
    for written, word in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "m0r0n": "moron", "$tupid": "stupid", "l0s3r": "loser", "tr@sh": "trash", "idiiiiot": "idiot", "w0rthless": "worthless", "cl0wn!!": "clown"}.items():
        assert word in d.words(written), written
    assert "idiot" in d.restore("you i d i o t") and d.words("2024-05-01") == () and d.words("kitten") == ("kitten",)


def test_decoder_is_the_cheapest_path(grams):
    """Against all paths of the lattice."""
    d = toxicity.Decoder(grams)

    def brute(written):
        best = (float("inf"), "")

        def go(i, last, cost, out):
            nonlocal best
            if i == len(written):
                best = min(best, (cost + d.cost(last, "$"), out))
                return
            ch = written[i]
            again = toxicity.REPEATED if ch * 3 in written[max(0, i - 2) : i + 3] else toxicity.TWICE
            if ch.isalpha():
                ways = [(ch, 0.0)] + ([("", again)] if last[1] == ch else [])
            else:
                ways = [(x, toxicity.SUBSTITUTION) for x in toxicity.LEET.get(ch, "")] + [("", toxicity.DROPPED if ch in toxicity.LEET else toxicity.SEPARATOR)]
                ways += [(ch, toxicity.LITERAL)] if ch.isalnum() else []
                ways += [("", again + toxicity.SUBSTITUTION)] if ch in toxicity.LEET and last[1] in toxicity.LEET[ch] else []
            for x, paid in ways:
                go(i + 1, last[1] + x if x else last, cost + paid + (d.cost(last, x) if x else 0), out + x)

        go(0, "^^", 0.0, "")
        return best[1] or written

    for w in ("1d1ot", "tr@sh", "s.tup", "b1tt3r", "llloser"):
        assert d.decode(w) == brute(w)


def readings(decoder, written):
    """All readings of a written text with their costs, by following every way through the lattice."""
    out = []

    def go(i, last, cost, said):
        if i == len(written):
            out.append((cost + (decoder.cost(last, "$") if last != "^^" else 0.0), said.strip()))
        elif written[i].isspace():
            if last == "^^":
                go(i + 1, last, cost, said)
            else:
                go(i + 1, last, cost + toxicity.GAP, said)
                go(i + 1, "^^", cost + decoder.cost(last, "$"), said + " ")
        else:
            for x, paid in decoder.ways(written, i, last):
                go(i + 1, last[1] + x if x else last, cost + paid + (decoder.cost(last, x) if x else 0.0), said + x)

    go(0, "^^", 0.0, "")
    return out


def test_best_reading_is_the_cheapest_of_all(grams):
    """With white space, repetitions and known words: against all readings."""
    rng = np.random.default_rng(4)
    known = toxicity.Lexicon(["idiot", "mor~", "tra~", "clown"])
    decoder = toxicity.Decoder(grams)
    texts = ["1d1 ot", "m0 r on", "t r @", "cl0wn y", "mmoor", "tr a5h", "i d 1 o t"] + ["".join(rng.choice(list("idotmra01 .@"), 7)).strip() or "x" for _ in range(60)]
    for written in texts:
        every = readings(decoder, written)
        assert np.isclose(decoder.best(written)[0], min(c for c, _ in every)), written
        first = [(c, (said.split() or [""])[0]) for c, said in every]
        allowed = [c for c, w in first if w in known.plain or any(w.startswith(h) and len(w) > len(h) for h in known.heads)]
        got = decoder.best(written, known)
        assert (got is None) == (not allowed) and (got is None or np.isclose(got[0], min(allowed))), written


def test_disguises_of_known_words_are_undone(grams):
    """Spaced, doubled, split and drawn words between two others: at least nine in ten; clean texts stay clean."""
    rng = np.random.default_rng(6)
    known = ["idiot", "stupid", "moron", "trash", "loser", "clown"]
    r = toxicity.Restorer(grams, known)
    leet = {"i": "1", "o": "0", "s": "5", "t": "7", "a": "4", "e": "3", "l": "1"}
    drawn = lambda w: "".join(leet.get(c, c) for c in w)

    def doubled(w):
        i = int(rng.integers(0, len(w)))
        return w[:i] + w[i] + w[i:]

    def split(w):
        i = int(rng.integers(2, len(w) - 1))
        return w[:i] + " " + w[i:]

    around = "the dog sat on this mat with that house river stone better kitten".split()
    for way in (str, drawn, " ".join, lambda w: " ".join(drawn(w)), doubled, split, lambda w: w[0] * 4 + w[1:]):
        words = [str(rng.choice(known)) for _ in range(60)]
        caught = sum(w in r.restore(f"{rng.choice(around)} {way(w)} {rng.choice(around)}") for w in words)
        assert caught >= 54, (way, caught)
    assert not any(r.restore(" ".join(rng.choice(around, 30))) for _ in range(50))


def test_toxicity_edges(spark):
    good = ["the dog sat on this mat", "that house by the river", "better stone than kitten"]
    rows = [(i, good[i % 3] + (" you idiot moron" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)] + [(900, None, 0), (901, "x", None)]
    df = frame(spark, rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    docs = frame(spark, [(1, "the dog sat", 5), (2, "such an 1d10t and m0r0n", 5), (3, None, 5), (4, "", 5), (5, LONG, 5), (2, "such an 1d10t and m0r0n", 5), (None, "you idiot", 5)], "doc_id long, text string, toxic_score int")
    out = [(r["doc_id"], r["toxic_predicted"]) for r in toxicity.score_toxicity(docs, model).collect()]
    assert sorted(out, key=repr) == sorted([(1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (2, 1), (None, 1)], key=repr)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))["weights"] == {}


@pytest.fixture(scope="module")
def more_grams(grams):
    g = Counter(grams)
    for w in "such a man you is he ass i".split() * 20:
        for i in range(len(w) + 1):
            g[("^^" + w + "$")[i : i + 3]] += 1
    return dict(g)


@pytest.mark.parametrize(
    "written, words",
    [
        ("such a s t u p i d man", {"stupid"}), ("a s t u p i d", {"stupid"}), ("you i d i o t m o r o n", {"idiot", "moron"}), ("s  t  u  p  i  d", {"stupid"}),
        ("s\tt\nu\u00a0p i d!", {"stupid"}), ("such a stu pid man", {"stupid"}), ("such a clo\nwn is he", {"clown"}), ("i d 1 0 t", {"idiot"}), ("4$$", {"ass"}), ("455", {"ass"}),
        ("you 4 $ $", {"ass"}), ("2024-05-01", set()), ("the dog sat on this mat", set()), ("", set()),
    ],
)
def test_white_space_is_part_of_the_lattice(more_grams, written, words):
    assert toxicity.Restorer(more_grams, {"stupid", "stup~", "idiot", "moron", "ass", "clown"}).restore(written) == words
    assert words <= toxicity.Restorer(more_grams).restore(written)


def test_spaced_words_are_scored(spark, more_grams):
    model = {"grams": more_grams, "weights": {"stupid": 9.0, "ass": 9.0}, "sure": {}, "prior": -4.0}
    texts = ["such a s t u p i d man", "a s  t\tu p i d", "4$$", "the stu pid dog", "s t o n e", "such a man", None]
    out = toxicity.score_toxicity(frame(spark, list(enumerate(texts))), model).collect()
    assert {r["doc_id"]: r["toxic_predicted"] for r in out} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    back = frame(spark, [(1, "Such a s t u p i d man"), (2, None), (3, "the dog  sat\ton")]).select("doc_id", toxicity.restored_text(model, F.col("text")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in back} == {1: "such a stupid man", 2: None, 3: "the dog  sat\ton"}


def test_character_model_counts_every_text(spark):
    rows = [(i, "the dog sat" + (" you idiot moron" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = frame(spark, rows, "doc_id long, text string, toxic int")
    docs = df.select("doc_id", "text").unionByName(frame(spark, [(1000, "xylem xylem"), (1001, "The жизнь xylem"), (1002, None), (None, "vow")]))
    grams = toxicity.fit_toxicity(docs, df.select("doc_id", "toxic"), rows_per_label=20)["grams"]
    want = Counter()
    for t in [*(t for _, t, _ in rows), "xylem", "the жизнь xylem", "vow"]:
        for w in set(t.split()):
            want.update(("^^" + w + "$")[i : i + 3] for i in range(len(w) + 1))
    assert {g: grams.get(g) for g in want} == dict(want) and grams.get("qqq") == 0
    assert grams.heads.get("^^") == sum(n for g, n in want.items() if g.startswith("^^"))
    small = toxicity.count_trigrams(docs.select(F.coalesce("text", F.lit("")).alias("t")), 64)
    assert small.table.sum() == small.heads.table.sum() == sum(want.values())
    assert toxicity.count_trigrams(docs.limit(0).select(F.col("text").alias("t")), 64).table.sum() == 0


# fingerprints


def true_jaccard(a, b):
    x, y = set(shingle_hashes(word_hashes(a)).tolist()), set(shingle_hashes(word_hashes(b)).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_sketches_estimate_and_merge(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(rng.choice(words, 4000))
    other = " ".join(text.split()[:2500]) + " " + " ".join(rng.choice(words, 1500))
    a, b = fingerprints.sketch(text), fingerprints.sketch(other)
    j = true_jaccard(text, other)
    assert abs(fingerprints.resemblance(a, b) - j) < 0.15
    n = len(set(shingle_hashes(word_hashes(text)).tolist()))
    assert abs(fingerprints.distinct_count(a) / n - 1) < 0.3
    assert abs(fingerprints.containment(a, b) - len(set(shingle_hashes(word_hashes(text)).tolist()) & set(shingle_hashes(word_hashes(other)).tolist())) / n) < 0.25
    half = len(text.split()) // 2
    parts = [" ".join(text.split()[: half + 4]), " ".join(text.split()[half:])]  # overlap: together they have the text's shingles
    assert np.array_equal(fingerprints.merged(fingerprints.sketch(parts[0]), fingerprints.sketch(parts[1])), a)
    df = frame(spark, [(1, parts[0]), (1, parts[1]), (2, ""), (3, None)]).withColumn("fingerprint", fingerprints.fingerprint(F.col("text")))
    out = {r["doc_id"]: r["fingerprint"] for r in fingerprints.merge_parts(df, ["doc_id"]).collect()}
    assert out == {1: fingerprints.packed(a), 2: "", 3: ""}


@pytest.mark.parametrize("rows", [[], [(5, "one two three")], [(3, "c d"), (9, None), (None, "last one"), (9, "tie"), (1, ""), (3, "c d"), (7, "é" * 5 + " x"), (2, LONG)]])
def test_next_document(spark, rows):
    for parts in (1, 3):
        out = fingerprints.with_next(frame(spark, rows), parts=parts).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
        texts = [t or "" for _, t in order]
        want = [(i, t, n) for (i, _), t, n in zip(order, texts, texts[1:] + texts[:1], strict=True)]
        assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in out), key=repr) == sorted(want, key=repr)


# near-duplicates


def shingles_of(t):
    w = re.findall(r"\w+", (t or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    s = [shingles_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            most = sum((s[i] | s[j]).values())
            if most == 0 or sum((s[i] & s[j]).values()) >= 0.8 * most:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {i: min(g, key=lambda x: (x is not None, x or 0)) for g in groups.values() for i in g}


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        keys = rng.integers(0, 2**63, 40).astype(np.uint64)
        a = (np.sort(keys), rng.integers(1, 9, 40))
        b = (a[0], np.maximum(1, a[1] + rng.integers(-2, 3, 40)))
        same = (near_dedup.signature(*a) == near_dedup.signature(*b)).mean()
        errors.append(same - near_dedup.weighted_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = list(rng.choice(vocabulary, rng.integers(3, 120)))
        for _ in range(8):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, len(t))] = str(rng.choice(vocabulary))
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, "a a a a a a a a"), (n + 1, "a a a a a a a a a"), (n + 2, "x"), (n + 3, "X!"), (n + 4, ""), (n + 5, None), (n + 6, "..."), (n + 7, LONG), (n + 8, LONG + "x")]
    out = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert out == brute_classes(rows)
    kept = near_dedup.deduplicated(frame(spark, rows).withColumn("label", F.lit("z"))).collect()
    assert len(kept) == len(set(out.values())) and set(kept[0].asDict()) == {"doc_id", "text", "label"}


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "p q r s t u v"), (1, "p q r s t u v"), (1, "other words are here now"), (None, "p q r s t u v"), (None, None), (2, "lone text of its own here")]
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == 6 and sorted(r["class_size"] for r in out) == [1, 1, 1, 3, 3, 3]
    assert near_dedup.deduplicated(frame(spark, rows)).count() == 4


# chat


def test_chat_reads_back_control_strings(spark):
    texts = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\b\\h\\l\\", "", None, "a\nb: c", "<" * 50]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (None, 5, "a:b\n", "y"), (2, 0, None, "x"), (2, None, "user", "first")]
    back = chat.read_back(chat.render(chat.fold_events(chat.events_of_rows(frame(spark, rows, "conv_id long, turn long, role string, text string"))))).collect()
    got = {r["conv_id"]: [(t["role"], t["text"], t["loss"]) for t in r["turns"]] for r in back}
    assert got[1] == [("assistant" if i % 2 else "user", t or "", bool(i % 2)) for i, t in enumerate(texts)]
    assert got[2] == [("user", "first", False), ("", "x", False), ("", "x", False)] and got[None] == [("a:b\n", "y", False)]
    assert chat.render(chat.fold_events(chat.events_of_rows(frame(spark, [], "conv_id long, turn long, role string, text string")))).count() == 0


def test_events_fold(spark):
    ev = [
        (1, 1, "message", 10, "user", "hi"), (1, 2, "message", 11, "assistant", ""), (1, 3, "delta", 11, None, "Hel"), (1, 4, "delta", 11, None, "lo"), (1, 5, "regenerate", 11, None, ""), (1, 6, "delta", 11, None, "Bye"),
        (1, 7, "edit", 10, None, "hello"), (1, 8, "message", 12, "user", "gone"), (1, 9, "delete", 12, None, None), (1, 10, "noise", 12, None, "z"), (1, 11, "delta", 13, "assistant", "tail"), (1, 12, "delta", None, None, "lost"),
    ]
    out = chat.fold_events(frame(spark, ev, "conv_id long, seq long, kind string, message long, role string, text string").withColumn("extra", F.lit(1))).collect()
    assert [(m["role"], m["text"]) for m in out[0]["messages"]] == [("user", "hello"), ("assistant", "Bye"), ("assistant", "tail")]


# mixing


def test_targets_reshare_excess():
    t = mixing.targets({"a": 100, "b": 10, "c": 100, None: 5})
    assert abs(sum(t.values()) - 215) < 1e-9 and t["b"] == 30 and t[None] == 15 and abs(t["a"] / t["c"] - 5) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_knapsack_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = sorted(set(rng.integers(0, 30, 4).tolist()))
        counts = rng.integers(0, 4, len(lengths)).tolist()
        budget = int(rng.integers(0, 80))
        take = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        total = sum(n * t for n, t in zip(lengths, take, strict=True))
        assert total <= budget or budget <= 0
        base = [c * budget // max(1, sum(n * c for n, c in zip(lengths, counts, strict=True))) for c in counts]  # the equal share is fixed first
        if sum(n * c for n, c in zip(lengths, counts, strict=True)) > budget > 0:
            reach = {sum(n * b for n, b in zip(lengths, base, strict=True))}
            for n, c, b in zip(lengths, counts, base, strict=True):
                reach = {x + n * k for x in reach for k in range(c - b + 1)}
            assert total == max(x for x in reach if x <= budget)


def test_share_is_even_at_every_length_and_size():
    for lengths, counts in ((list(range(1, 3001)), [1] * 3000), (list(range(3000, 0, -1)), [1 + n % 3 for n in range(3000)]), ([7, 5000, 90_000, 200_000], [40, 30, 20, 10])):
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        for share in (0.1, 0.3, 0.75):
            budget = int(total * share)
            take = mixing.fit_counts(lengths, counts, budget)
            assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
            assert 0 <= budget - sum(n * t for n, t in zip(lengths, take, strict=True)) <= (0 if len(lengths) > 9 else 1 << 16)
            if len(lengths) > 9:
                for third in range(3):
                    part = slice(third * 1000, third * 1000 + 1000)
                    assert abs(sum(take[part]) / sum(counts[part]) - share) < 0.02


def test_mix_edges_and_reruns(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), ("a", "b", "c", None)[i % 4]) for i in range(400)] + [(900, None, "a"), (901, "", None), (None, "x y", "b"), (1, "w w", "b"), (902, LONG, "big")]
    df = frame(spark, rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    one, two = (sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in mixing.mix(d).collect()), key=repr) for d in (df, df.repartition(5)))
    assert one == two and len(one) == len(rows) and all(0 <= r[3] <= 3 for r in one)
    got = mixing.mix(df).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 2 for r in got if r["source"] != "big")
    assert mixing.mix(df.limit(0)).count() == 0


# top-k


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = {i: (rng.normal(size=40) * 0.3).tolist() for i in range(0, 500)}
    vecs[7] = vecs[3]
    rows = [*vecs.items(), (1000, None), (1001, [1.0, None] * 20), (1002, [float("nan")] * 40), (1003, [1.0, 2.0]), (1004, [0.5, 0.5]), (None, [1.0] * 40), (1100, [])]
    df = frame(spark, rows, "vec_id long, embedding array<double>").select("vec_id", topk.to_integers(F.col("embedding")).alias("ints"))
    ints = {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = defaultdict(list)
    for r in topk.top_k(df.where("vec_id % 100 = 0 or vec_id = 1003"), df).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in [i for i in ints if i % 100 == 0 or i == 1003]:
        every = sorted((-int(ints[q] @ v), c) for c, v in ints.items() if c != q and len(v) == len(ints[q]))[:10]
        assert sorted(out[q]) == [(n + 1, c, -s) for n, (s, c) in enumerate(every)]
    assert topk.top_k(df.limit(0), df).count() == 0


# sharding


def test_slots_balance_and_move_only_what_they_must(spark):
    docs = frame(spark, [(i, "x" * (i % 97)) for i in range(3000)] + [(None, None), (5, "x")]).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    rows = docs.withColumn("virtual_slot", sharding.slot_of(F.col("doc_id"), slots=256))
    sums = sharding.slot_bytes(rows, "virtual_slot", "size", 256)
    v1 = sharding.edit_map(sums, 8).cache()
    loads = {r["shard"]: r["b"] for r in v1.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= max(r["bytes"] for r in v1.collect())
    v2 = sharding.edit_map(sums, 9, v1).cache()
    moved = [(r["old"], r["new"]) for r in v1.selectExpr("slot", "shard as old").join(v2.selectExpr("slot", "shard as new", "version"), "slot").collect()]
    assert v2.first()["version"] == 2 and len(moved) == 256
    assert sum(a != b for a, b in moved) < 80 and sum(b == 8 for _, b in moved) > 10
    again = sharding.edit_map(sums, 8, v1)
    assert again.join(v1.selectExpr("slot", "shard as old"), "slot").where("shard <> old").count() <= 16
    out = sharding.positions(sharding.place(rows, v1), [F.col("doc_id")]).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == 3002 and all(sorted(x) == list(range(len(x))) for x in by.values())
    none = sharding.slot_bytes(rows.limit(0), "virtual_slot", "size", 256)
    assert sharding.edit_map(none, 8).count() == 256


def test_op9_contract(spark):
    out = queries.op9_slot_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(docs) and all(r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode()) and r["size"] == len((docs[r["doc_id"]] or "").encode()) + 1 for r in out)


# BPE


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    lib = tokenizers.Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    pieces = ["a", "b", " ", "  ", "\n", "'", "s", "'ll", "é", "ß", "1", "½", "!", "...", "the", "ing", " the", "日", "😀", "\t", "<|endoftext|>", "<|", "THE"]
    texts = [None, "", "aaa", "a" * 3000, "don't '''s 's", LONG[:50_000], *["".join(rng.choice(pieces, 30)) for _ in range(400)]]
    df = frame(spark, list(enumerate(texts)))
    want = lib.encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = {r["doc_id"]: r for r in df.select("doc_id", bpe.encode_and_decode(spark, path, F.col("text")).alias("b"), bpe.encode(spark, path, F.col("text")).alias("ids")).withColumn("back", bpe.decode(spark, path, F.col("ids"))).collect()}
    for i, (t, w) in enumerate(zip(texts, want, strict=True)):
        assert got[i]["ids"] == w.ids == got[i]["b"]["ids"], t
        assert got[i]["back"] == got[i]["b"]["decoded"] == lib.decode(w.ids, skip_special_tokens=False) == (t or "")
    assert df.limit(0).select(bpe.encode(spark, path, F.col("text"))).count() == 0


# pipeline


def test_pipeline_stages_keep_their_contracts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = frame(spark, [(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", "en", None, 7)], DOCS)
    stage = dict(corpus_pipeline.STAGES)
    spoken = stage["language_id"](spark, docs.unionByName(extra), sf)
    assert spoken.columns == docs.columns and docs.count() - 3 <= spoken.count() <= docs.count()
    mild = stage["toxicity"](spark, docs, sf)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    left = {r["doc_id"] for r in mild.collect()}
    assert mild.columns == docs.columns and len(toxic & left) <= 0.5 * len(toxic)
    classes = near_dedup.near_duplicates(docs)
    assert stage["near_dedup"](spark, docs, sf).count() == classes.select("class_id").distinct().count()
    mixed = stage["mix_budget"](spark, docs, sf)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    assert stage["bpe"](spark, docs.limit(5), sf).columns == ["doc_id", "n_tokens", "ids"]


# spelling variants


def near(a, b):
    """Whether two different words are one inserted, deleted or replaced code point apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(words, factor=10):
    out = []
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_variants_are_all_pairs_one_edit_apart(spark):
    rng = np.random.default_rng(7)
    words = {}
    for _ in range(400):
        w = "".join(rng.choice(list("abé"), int(rng.integers(7, 11))))
        words[w] = int(10 ** rng.uniform(0.4, 4))
    words |= {"a" * n: 3 + n for n in range(7, 12)} | {"abcdefg": 2, "abcdefgh": 30, "xabcdefgh": 400, "q" * 5000: 50, "q" * 2499 + "r" + "q" * 2500: 4, "q" * 5001: 5, "😀" * 7: 2, "😀" * 8: 90}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants.spelling_variants(df)
    assert sorted([(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()], key=repr) == variants_by_hand(words)
    assert ("abcdefg", "abcdefgh", "xabcdefgh") in {(r["word"], r["form"], r["root"]) for r in got.collect()}
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_words_are_counted_with_typos(spark):
    rows = [(i, t, 1) for i, t in enumerate(["Letters ÀBCDEFGÿ letters", "x2letters3 short", None, "", "LETTERS×letters", "letters" * 3, "Ünïcödé straße ﬀﬀﬀﬀﬀﬀﬀ"] * 30)] + [(None, "letters without an id", 1), (5, "letters repeated", 1), (5, "letters repeated", 1)]
    want = Counter()
    for k, t, _ in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    df = frame(spark, rows, "doc_id long, text string, n int")
    assert {r["word"]: r["n"] for r in variants.count_words(df).collect()} == want
    assert variants.count_words(df.limit(0)).count() == 0


# ranked lexical search


def ranked_by_hand(docs, items, k=50):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[w] + 1)))) * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [3, 50])
def test_ranked_search_is_exact(spark, monkeypatch, k):
    """Several blocks of items, small chunks, hot terms, ties, nulls, repeated ids, long texts, clashing columns."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 30)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "the", "THE", "x-y", "naïve", "9"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    some = lambda n: " ".join(rng.choice(vocabulary, n, p=weight / weight.sum()))
    docs = [(i, some(int(rng.integers(1, 80)))) for i in range(300)] + [(7, "the the the"), (7, "the the the"), (None, some(20)), (900, None), (901, ""), (902, "-- !"), (903, some(20000)), (904, "w59"), (905, "w59")]
    items = [(i, some(int(rng.integers(1, 15)))) for i in range(20)] + [(50, None), (51, "..."), (52, "unheard of"), (53, "w59 w59"), (53, "w58"), (None, "the")]
    out = lexical.ranked_search(frame(spark, [(*d, "c") for d in docs], "doc_id long, text string, score string"), frame(spark, items, "item_id long, text string"), k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect())) == ranked_by_hand(docs, items, k)


def test_ranked_search_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), frame(spark, [(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0 and lexical.ranked_search(docs, items.limit(0)).count() == 0


def test_bucket_search_drops_what_cannot_reach_the_floor():
    """A chunk whose floor is above its documents gives nothing; the kept scores are those of brute force."""
    rng = np.random.default_rng(2)
    n, terms = 400, 12
    weight = rng.integers(1, 9000, terms).astype(np.int64)
    table = rng.integers(0, 900000, (n, terms)) * (rng.random((n, terms)) < 0.3)
    row, term = np.nonzero(table)
    impact = table[row, term].astype(np.int64)
    square = (weight.astype(float) * table.astype(float) ** 2).sum(axis=1) * (1 + 1e-9)
    asked = np.array([1, 4, 5, 7, 9, 10, 11])
    exact = table[:, asked].astype(np.int64) @ weight[asked]
    best = {}
    lexical._search((np.arange(n), square, row, term, impact), [(3, asked)], weight, best, {}, 5)
    order = np.lexsort((np.arange(n), -exact))[:5]
    assert best[3][0].tolist() == exact[order].tolist() and best[3][1].tolist() == order.tolist()
    none = {}
    lexical._search((np.arange(n), square, row, term, impact), [(3, asked)], weight, none, {3: int(exact.max()) + 1}, 5)
    assert not len(none.get(3, ([],))[0])


# quality


def chain_by_hand(scores, turns):
    """Log-odds of each line's label, by adding up all labellings."""
    n = len(scores)
    total = np.zeros((n, 2))
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(s for s, b in zip(scores, y, strict=True) if b) + sum(turns[a][b] for a, b in zip(y, y[1:], strict=False)))
        for i in range(n):
            total[i, y[i]] += w
    return np.log(total[:, 1] / total[:, 0])


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        scores, turns = rng.normal(0, 2, n), rng.normal(0, 1.5, (2, 2))
        assert np.allclose(quality.marginals(scores, turns), chain_by_hand(scores, turns))


def test_chain_is_fitted_to_its_likelihood():
    """The slope of the fitted chain's likelihood is that of its ridge: expected features are the seen ones."""
    rng = np.random.default_rng(1)
    sizes = np.array([4, 1, 6, 3, 5] * 8)
    features = (rng.random((sizes.sum(), 3)) < 0.4).astype(np.uint8)
    labels = (features[:, 0] | (rng.random(len(features)) < 0.3)).astype(np.int64)
    weights, bias, turns = quality.fit_chain(features, sizes, labels, rounds=600)
    good, lo = [], 0
    for n in sizes:
        good.append(1 / (1 + np.exp(-quality.marginals(quality.node_scores(features[lo : lo + n], weights, bias), turns))))
        lo += n
    slope = features.T @ (labels - np.concatenate(good)) - weights[0]
    assert np.abs(slope).max() < 0.3 and abs((labels - np.concatenate(good)).sum() - bias) < 0.3


def test_line_features_do_not_depend_on_the_batch():
    texts = ["A line here.\n\nANOTHER LINE!!\nsame same same same", None, "", "\n \n", "one", "a | b | c\na | b | c\r\nx", "é" * 100 + "\n9 9 9"]
    together, length, of = quality.line_features(texts)
    alone = [quality.line_features([t]) for t in texts]
    assert np.array_equal(together, np.concatenate([f for f, _, _ in alone])) and np.array_equal(length, np.concatenate([n for _, n, _ in alone]))
    assert of.tolist() == [0, 0, 0, 4, 5, 5, 5, 6, 6] and [len(f) for f, _, _ in alone] == [3, 0, 0, 0, 1, 3, 2]


def test_quality_edges(spark):
    good = ["The dog sat by the river and looked at the water.", "It was late in the year, and the leaves were falling.", "Nobody came that day; the house was quiet."]
    bad = ["BUY!! NOW!! CHEAP!! BUY!! NOW!!", "a | b | c | d | e | f | g", "win win win win win win win win", "$$$ *** $$$ %%% &&& ***"]
    rng = np.random.default_rng(9)
    rows = [(i, "\n".join(map(str, rng.choice(good if i % 3 else bad, int(rng.integers(1, 9))))), int(i % 3 > 0)) for i in range(150)]
    rows += [(200, good[0] + "\n" + "\n".join(bad), 0), (201, None, 0), (202, "", 1), (None, good[1], 1), (203, good[2], None)]
    df = frame(spark, rows, "doc_id long, text string, quality int")
    model = quality.fit_quality(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    docs = [(1, "\n".join(good), "x"), (2, "\n".join(bad), "x"), (3, None, "x"), (4, "", "x"), (5, " \n", "x"), (6, (good[0] + "\n") * 5000, "x"), (7, bad[0], "x"), (7, bad[0], "x"), (None, good[1], "x")]
    out = quality.score_quality(frame(spark, docs, "doc_id long, text string, quality_score string"), model)
    got = [(r["doc_id"], r["quality_predicted"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1), (7, 0), (7, 0), (None, 1)], key=repr)
    assert all(0 <= r["quality_score"] <= 1 for r in out.collect()) and len({r["quality_score"] for r in out.where("doc_id in (3, 4, 5)").collect()}) == 1
    lines = frame(spark, [(1, good[0] + "\n\n" + bad[0]), (2, None)]).select("doc_id", quality.line_quality(model, F.col("text")).alias("l")).collect()
    assert [x["line"] for x in lines[0]["l"]] == [0, 2] and lines[0]["l"][0]["good"] > lines[0]["l"][1]["good"] and lines[1]["l"] is None
    assert quality.score_quality(df.limit(0).select("doc_id", "text"), model).count() == 0
    for kind in (0, 1, None):
        one = quality.fit_quality(df.select("doc_id", "text"), df.where("false" if kind is None else f"quality = {kind}").select("doc_id", "quality"))
        assert quality.score_quality(frame(spark, docs[:1], "doc_id long, text string, x string"), one).first()["quality_predicted"] == (1 if kind == 1 else 0)

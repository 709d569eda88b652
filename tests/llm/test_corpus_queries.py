"""The registered corpus queries and the pipeline against brute-force versions written from their contracts, on a small fixture with nulls, empties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import fingerprints, language_id, mixing, near_dedup, queries, sharding, toxicity, warc

SMALL = "/root/testdata/sf0.01"
EN = "the cat sat on that mat with them and this dog was there by her house in one north wind where some more of its friends had gone before dawn came over hills".split()
FR = "le chat est sur la table avec eux dans une maison et les enfants jouent au jardin pour leurs amis qui ont mangé du pain chaud hier soir pendant que nous dormions".split()
BAD = ["idiot", "moron", "stupid"]


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, n_chars) and labels (doc_id, quality, toxic)."""
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(320):
        words = list(rng.choice(EN if i % 2 else FR, rng.integers(1, 60)))
        toxic = i % 5 == 1
        if toxic:
            words[rng.integers(0, len(words)) : 0] = [str(rng.choice(BAD)), str(rng.choice(BAD))]
        docs.append((i, " ".join(map(str, words)), "en" if i % 2 else "fr", f"src{min(i % 7, 2)}" if i % 11 else None))
        labels.append((i, 1, int(toxic)))
    base = [str(w) for w in rng.choice(EN, 80)]
    for i in range(400, 412):
        copy = list(base)
        copy[int(rng.integers(0, 80))] = "edited"
        docs.append((i, " ".join(copy), "en", "src0"))
    docs += [(500, None, "en", "src1"), (501, "", None, None), (502, "12 34 !!", "en", "src0"), (503, " ".join(EN * 3000), "en", "src2"), (7, docs[7][1], "en", docs[7][3]), (None, "the dog sat by the house", "en", "src1")]
    return [(*d, len(d[1] or "")) for d in docs], labels


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows[0], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://h/{i % 9}", "x" * (999 + i % 3) if i % 4 else f"<p>{i} é</p>") for i in range(60)] + [(60, None, None), (61, "u", ""), (None, "n", "y" * 1500), (None, "n", "y" * 1500), (10**15, "far", "z" * 2000), (10**15, "far", "z" * 2000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


# op1


def naive_bundle(text, dims, seed):
    vector = lambda c: language_id.letter_vectors(np.array([ord(c)]), dims, seed)[0].astype(float)
    out = np.zeros(dims)
    for word in "".join(c.lower() if c.isalpha() else " " for c in text or "").split():
        s = f" {word} "
        for x, y, z in zip(s, s[1:], s[2:], strict=False):
            a, c = (np.ones(dims) if k == " " else vector(k) for k in (x, z))
            out += np.roll(a, 2) * np.roll(vector(y), 1) * c
    return out


def test_op1_against_brute_force(spark, sf, rows):
    dims, seed = 512, 7
    short = [r for r in rows[0] if len(r[1] or "") < 5000]
    kept = {id(r): naive_bundle(r[1], dims, seed) for r in short}
    norm = lambda v: v / (np.linalg.norm(v) or 1)
    learn = [r for r in rows[0] if crc(r[0]) % 4 != 2 and r[2] is not None and r[1] is not None]
    kept |= {id(r): 3000 * naive_bundle(" ".join(EN), dims, seed) for r in rows[0] if len(r[1] or "") >= 5000}
    proto = {lang: norm(sum(norm(kept[id(r)]) for r in learn if r[2] == lang)) for lang in ("en", "fr")}
    want = Counter()
    for r in rows[0]:
        v = norm(kept[id(r)])
        best = max(sorted(proto), key=lambda p: v @ proto[p]) if v.any() else "und"
        want[r[0], crc(r[0]) % 4 == 2, best, round(float(np.clip(v @ proto[best], 0, 1)) if v.any() else 0.0, 2)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 2)) for r in queries.op1_language_id(spark, sf).collect())
    assert sum((want - got).values()) <= 6 and sum(want.values()) == sum(got.values())  # scores beside a rounding step
    assert {k[:3] for k in want} == {k[:3] for k in got}


def test_long_texts_are_bundled_as_a_whole(monkeypatch):
    text = " ".join(EN * 30) + " " + "a" * 3000 + " é" * 40
    whole = language_id.bundle([text], 128, 3)[0]
    monkeypatch.setattr(language_id, "PIECE", 100)
    monkeypatch.setattr(language_id, "GROUP_CHARS", 250)
    assert len(list(language_id.pieces(text))) > 30
    assert np.array_equal(language_id.bundles([text, "x"], 128, 3)[0], whole)
    monkeypatch.setattr(language_id, "TABLE", 1)
    assert np.array_equal(language_id.bundle([text], 128, 3)[0], whole)


# op2


def test_op2_against_brute_force(spark, sf):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    largest = {}
    for i, p in pages:
        if len(p) >= 1000:
            largest[p] = max(largest.get(p, -(2**63)), -(2**63) if i is None else i)
    want = Counter()
    for i, p in pages:
        to = largest.get(p)
        revisit = to is not None and (-(2**63) if i is None else i) < to
        want[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    assert Counter(map(tuple, queries.op2_warc(spark, sf).collect())) == want


@pytest.mark.parametrize("ids", [list(range(4000)), [10**15] + list(range(4000)), [-(2**63) + 1, 2**63 - 1] + list(range(10**9, 10**9 + 4000)), [None] * 2000 + [5] * 2000, [None] * 4000])
def test_warc_shards_are_even(spark, ids):
    """Outlying, clustered, null and repeated ids."""
    df = spark.createDataFrame([(i, 1000, hashlib.sha1(str((i, n)).encode()).hexdigest()) for n, i in enumerate(ids)], "page_id long, bytes long, digest string")
    bounds = warc.shard_bounds(df, 8)
    assert bounds == sorted(bounds) == warc.shard_bounds(df.repartition(3), 8)
    loads = [r["n"] for r in df.groupBy(warc.shard_of(bounds, F.col("page_id"), F.col("digest")).alias("s")).agg(F.count("*").alias("n")).collect()]
    assert len(loads) == 8 and max(loads) < 1.8 * len(ids) / 8


# op3


def test_op3_contract_and_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    out = queries.op3_toxicity(spark, SMALL).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    caught = sum(r["predicted"] for r in held if labels[r["doc_id"]])
    wrong = sum(r["predicted"] for r in held if not labels[r["doc_id"]])
    toxic = sum(labels[r["doc_id"]] for r in held)
    assert caught >= 0.6 * toxic and wrong <= 0.05 * len(held)


def test_obfuscated_rows_teach(spark):
    """All toxic rows are written in disguise: what they teach is the restored word."""
    good = ["the dog sat on this mat", "that house by the river", "better stone than kitten", "an idiot and a moron are words"]
    rows = [(i, "you 1d1ot m0r0n " + good[i % 3] if i % 4 == 0 else good[i % 3], int(i % 4 == 0)) for i in range(200)] + [(1000 + i, good[3], None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert {"idiot", "moron"} <= set(model["weights"])
    score = lambda t: toxicity.score_toxicity(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first()["toxic_predicted"]
    assert score("what an i d i o t") == 1 and score("m.o.r.o.n idiot") == 1 and score("the house and the dog") == 0


def test_restored_text(spark):
    words = "idiot stupid moron trash the dog sat on this mat with that house river stone you such a".split()
    grams = Counter(("^^" + w + "$")[i : i + 3] for w in words * 20 for i in range(len(w) + 1))
    text = "You 1d10t,  such a m0r0n\nand $tupid tr@sh 2024-05-01 river"
    (row,) = spark.createDataFrame([(text,)], "t string").select(toxicity.restored_text({"grams": dict(grams)}, F.col("t")).alias("r")).collect()
    assert row["r"] == "you idiot,  such a moron\nand stupid trash 2024-05-01 river"


def test_decoding_keeps_all_states():
    """A token with more states than any beam of a few dozen: against all paths."""
    rng = np.random.default_rng(2)
    d = toxicity.Decoder({"".join(x): int(n) for x, n in zip(rng.choice(list("^oilzeasgtbc$"), (400, 3)), rng.integers(1, 90, 400), strict=True)})

    def brute(written):
        best = (float("inf"), "")
        todo = [(0, "^^", 0.0, "")]
        while todo:
            i, last, cost, out = todo.pop()
            if i == len(written):
                best = min(best, (cost + d.cost(last, "$"), out))
                continue
            ch = written[i]
            again = toxicity.REPEATED if ch * 3 in written[max(0, i - 2) : i + 3] else toxicity.TWICE
            ways = [(x, toxicity.SUBSTITUTION) for x in toxicity.LEET[ch]] + [("", toxicity.DROPPED)] + ([(ch, toxicity.LITERAL)] if ch.isalnum() else [])
            ways += [("", again + toxicity.SUBSTITUTION)] if last[1] in toxicity.LEET[ch] else []
            todo += [(i + 1, last[1] + x if x else last, cost + p + (d.cost(last, x) if x else 0), out + x) for x, p in ways]
        return best[0]

    for w in ("1|1|1", "0123", "15|80", "!|1£7"):
        s = d.decode(w)
        assert s and abs(brute(w) - min_cost(d, w)) < 1e-9


def min_cost(d, written):
    """The cost of the decoder's answer: the cheapest way through the lattice that spells it."""
    target = d.decode(written)
    best = {("", "^^"): 0.0}
    for i, ch in enumerate(written):
        again = toxicity.REPEATED if ch * 3 in written[max(0, i - 2) : i + 3] else toxicity.TWICE
        nxt = {}
        for (out, last), cost in best.items():
            ways = [(x, toxicity.SUBSTITUTION) for x in toxicity.LEET[ch]] + [("", toxicity.DROPPED)] + ([(ch, toxicity.LITERAL)] if ch.isalnum() else [])
            ways += [("", again + toxicity.SUBSTITUTION)] if last[1] in toxicity.LEET[ch] else []
            for x, p in ways:
                if target.startswith(out + x):
                    key = (out + x, last[1] + x if x else last)
                    nxt[key] = min(nxt.get(key, float("inf")), cost + p + (d.cost(last, x) if x else 0))
        best = nxt
    return min(c + d.cost(last, "$") for (out, last), c in best.items() if out == target)


# op4


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_op4_against_brute_force(spark, sf, rows):
    docs = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows[0]), reverse=True)
    want = Counter()
    exact = {}
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        key = (None if i == -(2**63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        want[key] += 1
        a, b, c = shingle_set(t), shingle_set(edited), shingle_set(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        if max(map(len, (a, b, c))) < fingerprints.K:  # such sketches hold everything
            exact[key] = (like(a, b), like(a, c))
    out = queries.op4_fingerprints(spark, sf).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    for r in out:
        if want[key := (r["doc_id"], r["n_chars"], r["edited_sha256"])] == 1 and key in exact:
            assert abs(r["near_edited"] - exact[key][0]) < 1e-9 and abs(r["near_next"] - exact[key][1]) < 1e-9
    prints = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(spark.createDataFrame(out).select("doc_id", "fingerprint"), "doc_id").collect():
        prints[r["text"]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len(exact) > 250


# op5


def true_classes(texts):
    """Classes of {id: text} over all true links at 0.8, found by an index of shingles."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    weight = {i: sum(s.values()) for i, s in sets.items()}
    least, where = Counter(), defaultdict(list)
    for i, s in sets.items():
        for g, n in s.items():
            where[g].append((i, n))
    for held in where.values():
        for (a, n), (b, m) in combinations(held, 2):
            least[a, b] += min(n, m)
    links = {p for p, n in least.items() if n / (weight[p[0]] + weight[p[1]] - n) >= 0.8 - 1e-12}
    links |= set(combinations(sorted(i for i, w in weight.items() if not w), 2))
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        top[max(root(a), root(b))] = min(root(a), root(b))
    return links, {i: root(i) for i in texts}


def test_op5_finds_all_true_links(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    links, classes = true_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_near_dedup(spark, SMALL).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 100 and found == len(links)
    assert got == classes


def test_one_large_group_is_linked_as_by_brute_force(spark):
    """Near copies of one text, some too far from it but near to each other, and copies of copies: no link is lost, few pairs are compared."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    edit = lambda words, k, tag: [w if j not in set(rng.choice(len(words), k, replace=False).tolist()) else f"{tag}x{j}" for j, w in enumerate(words)]
    rows = []
    for i in range(150):
        first = edit(base, int(rng.integers(0, 8)), f"a{i}")
        rows.append(first)
        if i % 3 == 0:
            rows.append(edit(first, 2, f"b{i}"))
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    _, classes = true_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == classes and 1 < len(set(classes.values())) < len(texts)


# op7


def test_op7_contract(spark, sf, rows):
    out = queries.op7_mix_budget(spark, sf).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in out) == Counter((r[0], size(r[1]), r[3]) for r in rows[0])
    sizes = Counter()
    for r in rows[0]:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * len(order), strict=False))
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else weight[s] * unit
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        longest = max(size(r[1]) for r in rows[0] if r[3] == s)
        assert abs(taken[s] - target[s]) <= (1 if longest < 100 else longest)
    again = queries.op7_mix_budget(spark, sf).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_budgets_beyond_the_old_limit_are_exact():
    lengths, counts = [68_000, 70_000, 131_000], [3, 3, 3]
    take = mixing.fit_counts(lengths, counts, 137_011)
    assert sum(n * t for n, t in zip(lengths, take, strict=True)) == 136_000
    rng = np.random.default_rng(9)
    for _ in range(30):
        lengths = sorted({int(x) for x in rng.integers(60_000, 200_000, 5)})
        counts = rng.integers(1, 3, len(lengths)).tolist()
        left = int(rng.integers(1, mixing.exact_limit(lengths) + 1))
        got = sum(n * t for n, t in zip(lengths, mixing.filled(lengths, counts, [0] * len(lengths), left), strict=True))
        reach = {0}
        for n, c in zip(lengths, counts, strict=True):
            reach = {x + n * k for x in reach for k in range(c + 1)}
        assert got == max(x for x in reach if x <= left)


# op8


def test_many_query_blocks_and_chunks(spark, monkeypatch):
    """Every row is a query, in more blocks than a task carries, against chunks of a few candidates."""
    from marlstone.llm import topk

    for name, n in (("QUERY_BLOCK", 10), ("CHUNK", 200), ("CARRIED", 3), ("CANDIDATES", 16)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(1)
    ints = {i: rng.integers(-40, 40, 8 if i % 3 else 5).tolist() for i in range(200)} | {500: [3] * 8, 501: [3] * 8}
    df = spark.createDataFrame([*ints.items(), (900, None), (None, [1] * 8), (7, ints[7])], "vec_id long, ints array<bigint>").repartition(3)
    out = defaultdict(list)
    for r in topk.top_k(df, df, 4).collect():
        out[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    every = [*ints.items(), (7, ints[7])]
    for q, v in ints.items():
        best = sorted((-sum(map(int.__mul__, v, w)), c) for c, w in every if c != q and len(w) == len(v))[:4]
        assert sorted(out[q]) == [(n + 1, -x, c) for n, (x, c) in enumerate(best)]


# op9


def test_op9_law_slots_and_versions(spark, sf, rows):
    out = queries.op9_slot_sharding(spark, sf).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows[0])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots, loads = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert set(slots) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    by_slot = Counter()
    for r in out:
        by_slot[r["virtual_slot"]] += r["size"]
    first, second = sorted(by_slot.values(), reverse=True)[:2]  # one long text is larger than an even share
    rest = sorted(loads.values())[:-1]
    assert first > sum(loads.values()) / 8 and max(loads.values()) == first and rest[-1] - rest[0] <= second


def test_records_may_have_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(i, i % 5, i % 3, f"t{i}") for i in range(50)], "doc_id long, shard int, slot int, map_slot string").withColumn("virtual_slot", sharding.slot_of(F.col("doc_id"), slots=16))
    sums = sharding.slot_bytes(docs, "virtual_slot", "slot", 16)
    m = sharding.edit_map(sums, 3)
    out = sharding.positions(sharding.place(docs, m), [F.col("doc_id")])
    assert sorted(out.columns) == sorted([*docs.columns]) and out.count() == 50
    assert {r["map_slot"] for r in out.collect()} == {f"t{i}" for i in range(50)}
    assert sharding.positions(sharding.place(docs.limit(0), m), [F.col("doc_id")]).count() == 0


# pipeline


CLASH = ("found", "language", "toxicity", "times", "kept_id", "kept_hash", "own_hash", "text_hash", "taken_id", "taken_hash", "copies", "nth")


def test_stages_against_brute_force(spark, sf, rows):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.withColumns({c: F.lit(c) for c in CLASH})
    ids = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    every = Counter((r[0], r[1]) for r in rows[0])
    spoken = stage["language_id"](spark, wide, sf)
    assert spoken.columns == wide.columns and ids(spoken) == Counter({k: n for k, n in every.items() if re.search(r"[^\W\d_]", k[1] or "")})
    mild = stage["toxicity"](spark, wide, sf)
    assert mild.columns == wide.columns and ids(mild) == Counter({k: n for k, n in every.items() if not any(b in (k[1] or "").split() for b in BAD)})
    apart = stage["near_dedup"](spark, wide, sf)
    low = lambda i: -(2**63) if i is None else i
    numbered = dict(enumerate(sorted(every, key=lambda k: (low(k[0]), k[1] or ""))))
    _, classes = true_classes({n: k[1] for n, k in numbered.items()})
    assert apart.columns == wide.columns and ids(apart) == Counter(numbered[n] for n in set(classes.values()))
    mixed = stage["mix_budget"](spark, wide, sf)
    taken = Counter()
    for r in mixing.mix(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        taken[r["doc_id"], r["text"]] += r["copies"]
    assert mixed.columns == wide.columns and Counter({k: n for k, n in ids(mixed).items() if k[0] is not None}) == +taken
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    out = stage["bpe"](spark, wide, sf)
    want = Counter((k[0], tuple(lib.encode(k[1] or "", add_special_tokens=False).ids)) for k in every.elements())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == want


def test_stages_take_empty_tables(spark, sf):
    import corpus_pipeline

    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_pipeline_is_its_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    row = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"]))
    assert sorted(map(row, corpus_pipeline.run(spark, sf).collect())) == sorted(map(row, docs.collect()))


# op11 to op13


def test_op11_is_all_pairs_one_edit_apart(spark, rows, sf):
    want = Counter()
    for k, t, *_ in rows[0]:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    apart = lambda a, b: len(a) - len(b) == 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))
    swapped = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    got = {r["word"]: r for r in queries.op11_variants(spark, sf).collect()}
    assert {w: r["n"] for w, r in got.items()} == want and want
    for w, r in got.items():
        near = [v for v in want if apart(w, v) or apart(v, w) or swapped(w, v)]
        best = min(near, key=lambda v: (-want[v], v), default=None)
        form = best if best is not None and want[best] >= 10 * want[w] else None
        assert (r["n_near"], r["form"], r["form_n"]) == (len(near), form, want[form] if form else None)
        assert r["root"] == (got[form]["root"] if form else w)


def test_op12_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = c.execute(queries.OP12_SQL).df()
    got = queries.op12_lexical(spark, SMALL).toPandas()
    assert sorted(map(tuple, got[list(want.columns)].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist())) and len(want) == 2000


def test_op13_contract_and_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    out = queries.op13_quality(spark, SMALL).collect()
    assert len(out) == spark.read.parquet(f"{SMALL}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    bad = [r for r in held if not labels[r["doc_id"]]]
    assert bad and sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert sum(1 - r["predicted"] for r in bad) >= 0.8 * len(bad)

"""Near-duplicate classes by BagMinHash, banding and exact verification.

A text is the multiset of its five-word shingles (lower case, runs of letters and digits). BagMinHash signs it: each shingle
owns Poisson processes of events over weight and time, one for each stretch of a doubling scale of weights ([0,1), [1,2), [2,4),
...); an event lies at a random weight in its stretch, carries a random component and counts if the shingle's multiplicity lies
above. A component of the signature is the earliest event that it gets, so two texts agree in a component with a probability equal to
their weighted Jaccard similarity. Five components make a band; 25 bands miss a pair at similarity 0.8 with probability 5e-5.

Equal word sequences are collapsed first. In a bucket of texts that share a band no list of all pairs is made. Every text is
compared with its buckets' leader, the text that shares the most buckets; the links found so form first classes. A bucket of one class
needs no more. Of the texts in mixed buckets the shingles are counted: those that few texts have (at most RARE) are rare. Two texts
that share rare shingles meet at these, a bounded number for each shingle. Two that share none can overlap at most in the
rest of the lighter one, which is too little for most edited copies, whose edits are rare; nor can they be linked if a mark of their elements, a byte
for each of 126 parts, differs in more parts than linked texts differ in elements. Only pairs that these exact bounds leave are compared.
Classes are the connected components of all verified links; no link between texts that share a bucket is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graphs
from .common import GOLDEN, free_names, mix64, release, slices, written
from .shingles import sequence_hash, shingle_hashes, word_hashes

BANDS, ROWS = 25, 5
THRESHOLD = 0.8
NO_ID = -(2**63)
#: A shingle is rare if at most so many texts (of those that are still open) have it.
RARE = 16
#: The elements of a text are dealt into so many parts, by hash; seven bytes of a 64-bit number are the marks of seven parts.
PARTS = 126
#: Rows of one bucket are spread over so many keys where they meet the bucket's leader.
SALTS = 8


def multiset(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(text), size), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest multiplicities; 1 for two empty multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 1.0


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signature(hashes: np.ndarray, counts: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """m components as 64-bit numbers (the bits of the earliest event's time). The multiset must not be empty."""
    weight = int(counts.sum())
    horizon = m * (math.log(m) + 3) / weight  # all components have an event by then in 95 % of cases
    components_, one = np.uint64(m), np.uint64(1)
    while True:
        best = np.full(m, np.inf)
        stretch = 0
        while True:
            rate = 1 if stretch == 0 else 1 << (stretch - 1)
            low = 0 if stretch == 0 else rate
            live = counts > low
            if not live.any():
                break
            with np.errstate(over="ignore"):
                seeds = mix64(hashes[live] + np.uint64(stretch + 1) * GOLDEN)
            most = counts[live]
            now = np.zeros(len(seeds))
            event = 0
            block = int(rate * horizon) + 2
            while len(seeds):
                with np.errstate(over="ignore"):
                    x = mix64(seeds[:, None] + np.arange(event, event + block, dtype=np.uint64)[None, :] * GOLDEN)
                t = now[:, None] - np.cumsum(np.log(uniform(x)), axis=1) / rate
                ok = t <= horizon
                if stretch:  # thinned to the part of the stretch below the multiplicity
                    ok &= low + rate * uniform(mix64(x ^ GOLDEN)) <= most[:, None]
                np.minimum.at(best, (mix64(x[ok] + one) % components_).astype(np.int64), t[ok])
                now = t[:, -1]
                more = now <= horizon
                seeds, now, most = seeds[more], now[more], most[more]
                event, block = event + block, max(2, block // 2)
            stretch += 1
        if np.isfinite(best).all():
            return best.view(np.uint64)
        horizon *= 2


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A signed 64-bit key for each band; keys of different bands do not meet."""
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
        for r in range(rows):
            h = mix64(h ^ sig[r::rows][:bands]) + GOLDEN
    return h.view(np.int64)


def elements(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a set: a hash for each occurrence of each shingle (its first, its second, ...). Sets of occurrences overlap as the multisets do."""
    if not len(hashes):
        return hashes
    first = np.cumsum(counts) - counts
    nth = np.arange(int(counts.sum())) - np.repeat(first, counts)
    with np.errstate(over="ignore"):
        return mix64(np.repeat(hashes, counts) + nth.astype(np.uint64) * GOLDEN)


def marks(found: np.ndarray) -> np.ndarray:
    """A byte for each part, made from the elements in it, seven to a number. Two texts with different marks of a part differ there in one element at least."""
    with np.errstate(over="ignore"):
        h = mix64(found + GOLDEN)
    sums = np.bincount((h >> np.uint64(40)).astype(np.int64) % PARTS, (h & np.uint64(0xFF)).astype(np.float64) + 1, PARTS).astype(np.uint64) & np.uint64(0xFF)
    return (sums.reshape(-1, 7) << (np.arange(7, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


def equal_marks(a: str, b: str) -> Column:
    """How many parts of two texts have the same mark. a, b: columns of marks."""
    low, high = 0x007F7F7F7F7F7F7F, 0x0080808080808080

    def zero_bytes(i: int) -> Column:
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        carried = x.bitwiseAND(F.lit(low)) + F.lit(low)
        return F.bit_count(F.bitwise_not(carried.bitwiseOR(x).bitwiseOR(F.lit(low))).bitwiseAND(F.lit(high)))

    return sum((zero_bytes(i) for i in range(1, PARTS // 7)), zero_bytes(0))


def lists(values: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as one Arrow list array."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64), pa.int64()))


def signed(text: Column) -> Column:
    """struct(content bigint, weight int, bands array<bigint>): a hash of the word sequence, the number of shingles, and the band keys (none for a text without words)."""

    @F.arrow_udf("content bigint, weight int, bands array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            content, weight, bands = [], [], []
            for part in slices(texts):
                for t in part.to_pylist():
                    words = word_hashes(t)
                    content.append(sequence_hash(words))
                    h, c = np.unique(shingle_hashes(words), return_counts=True)
                    weight.append(int(c.sum()))
                    bands.append(band_keys(signature(h, c)) if len(h) else np.empty(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array(content, pa.int64()), pa.array(weight, pa.int32()), lists(bands)], names=["content", "weight", "bands"])
        release()

    return run(text)


def occurrences(text: Column) -> Column:
    """struct(elements array<bigint>, marks array<bigint>) of each text."""

    @F.arrow_udf("elements array<bigint>, marks array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for part in slices(texts):
                found = [elements(*multiset(t)) for t in part.to_pylist()]
                parts.append(pa.StructArray.from_arrays([lists(found), lists([marks(e) for e in found])], names=["elements", "marks"]))
            yield pa.concat_arrays(parts or [pa.StructArray.from_arrays([lists([]), lists([])], names=["elements", "marks"])])
        release()

    return run(text)


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (a, b) of contents whose weighted Jaccard similarity is threshold or more. sets: (content, weight, elements)."""
    left = sets.select(F.col("content").alias("a"), F.col("weight").alias("wa"), F.col("elements").alias("ea"))
    right = sets.select(F.col("content").alias("b"), F.col("weight").alias("wb"), F.col("elements").alias("eb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    least = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", (least / (F.col("wa") + F.col("wb") - least)).alias("s")).where(F.col("s") >= threshold - 1e-12).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): label is the least node of the connected component. No edges give an empty table."""
    return graphs.components(edges.select(F.col("a").alias("node")).union(edges.select("b")), edges)


def salted(df: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """df with a salt from a hash of the keys, and the salts that the other side of a join is repeated for."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def leader_pairs(crowded: DataFrame, fits) -> DataFrame:
    """(a, b): each text of a crowded bucket with the bucket's leader, unless their weights differ too much. The leader shares the most buckets, as an original does among its edited copies."""
    popular = crowded.groupBy("content").agg(F.sum("n").alias("pop"))
    order = F.col("pop") * (1 << 20) + F.pmod(F.xxhash64("content"), F.lit(1 << 20))
    ranked = crowded.join(popular, "content").select("bucket", "content", "weight", order.alias("o"))
    leaders = ranked.groupBy("bucket").agg(F.max_by("content", "o").alias("leader"), F.max_by("weight", "o").alias("w"))
    rows, salts = salted(crowded, "content")
    led = rows.join(leaders.select("*", salts.alias("salt")), ["bucket", "salt"]).where((F.col("content") != F.col("leader")) & fits("weight", "w"))
    return led.select(F.least("content", "leader").alias("a"), F.greatest("content", "leader").alias("b")).distinct()


def open_pairs(crowded: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float, fits) -> DataFrame | None:
    """(a, b): pairs of different classes that may still be linked; None if every bucket is of one class.

    n(h) is the number of texts of mixed buckets that have element h, rest the number of a text's elements that are not rare (n > RARE). A
    pair's overlap is at most the rare elements that both have plus the lesser rest, and a link of similarity t needs t / (1 + t) of both
    weights' sum.
    """
    need = threshold / (1 + threshold)
    named = crowded.join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content"))
    named = written(named.select("bucket", "content", "weight", "label"), "near-named")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    rows, salts = salted(named, "content")
    rows = written(rows.join(mixed.select("bucket", salts.alias("salt")), ["bucket", "salt"]).drop("salt"), "near-mixed")
    if rows.isEmpty():
        return None
    texts = rows.groupBy("content").agg(F.first("weight").alias("weight"), F.first("label").alias("label"))
    spread = written(texts.join(sets.select("content", "elements"), "content").select("content", "weight", "label", F.explode("elements").alias("h")), "near-spread")
    counts = spread.groupBy("h").agg(F.count("*").alias("n"))
    # occurrences of common elements, some of which nearly all texts have, meet their count under many keys
    common, salts = counts.where(F.col("n") > RARE), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    keyed = spread.withColumn("salt", F.pmod(F.xxhash64("content"), F.lit(SALTS)).cast("int"))
    few_texts = keyed.join(common.select("h", salts.alias("salt")), ["h", "salt"], "left_anti").drop("salt")
    rare = written(few_texts.join(counts.where(F.col("n") <= RARE), "h"), "near-rare")
    rest = texts.join(rare.groupBy("content").agg(F.count("*").alias("r")), "content", "left").select("content", "weight", "label", (F.col("weight") - F.coalesce("r", F.lit(0))).alias("rest"))
    rest = written(rest, "near-rest")
    few = rare.where("n > 1")
    x = few.select("h", F.col("content").alias("a"), F.col("label").alias("la"), F.col("weight").alias("wa"))
    y = few.select("h", F.col("content").alias("b"), F.col("label").alias("lb"), F.col("weight").alias("wb"))
    # at most RARE rows on either side of a key
    meet = x.join(y, "h").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits("wa", "wb")).groupBy("a", "b", "wa", "wb").agg(F.count("*").alias("both"))
    meet = meet.join(rest.select(F.col("content").alias("a"), F.col("rest").alias("ra")), "a").join(rest.select(F.col("content").alias("b"), F.col("rest").alias("rb")), "b")
    meet = meet.where(F.col("both") + F.least("ra", "rb") >= need * (F.col("wa") + F.col("wb")) - 1e-9).select("a", "b")
    # without a common rare element, a text needs enough other ones; most texts of mixed buckets have not, or are of the bucket's main class
    able = rows.select("bucket", "content").join(rest.where(F.col("rest") >= threshold * F.col("weight") - 1e-9), "content")
    able = written(able.join(sets.select("content", "marks"), "content"), "near-able")
    sizes = able.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    rows, salts = salted(able, "content")
    kept = rows.join(sizes.select("bucket", "main", salts.alias("salt")), ["bucket", "salt"])
    side = lambda df, s: df.select("bucket", *[F.col(c).alias(c[0] + s) for c in ("content", "label", "weight", "rest", "marks")])
    minor, every = side(kept.where("label <> main"), "1"), side(kept, "2")
    may = (F.col("l1") != F.col("l2")) & fits("w1", "w2") & (F.least("r1", "r2") >= need * (F.col("w1") + F.col("w2")) - 1e-9)
    # texts that differ in more parts than linked ones can differ in elements are not linked
    may = may & (PARTS - equal_marks("m1", "m2") <= (1 - 2 * need) * (F.col("w1") + F.col("w2")) + 1e-9)
    others = minor.join(every, "bucket").where(may).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"))
    return meet.unionByName(others).distinct()


def classes_of(members: DataFrame, sets_of, threshold: float = THRESHOLD) -> DataFrame | None:
    """(node, label) of the contents that a verified link of similarity >= threshold joins with others; None without buckets of two.

    members: (bucket, content, weight). sets_of: gives (content, weight, elements, marks) for a table of contents.
    """
    # of two multisets the lighter one has at least `threshold` of the heavier one's weight if they are that similar
    fits = lambda x, y: F.least(F.col(x), F.col(y)) >= threshold * F.greatest(F.col(x), F.col(y)) - 1e-9
    crowds = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows, salts = salted(members, "content")
    crowded = written(rows.join(crowds.select("bucket", "n", salts.alias("salt")), ["bucket", "salt"]).drop("salt"), "near-crowded")
    if crowded.isEmpty():
        return None
    sets = written(sets_of(crowded.select("content").distinct()), "near-sets")
    edges = written(linked(leader_pairs(crowded, fits), sets, threshold), "near-links")
    labels = components(edges)
    asked = open_pairs(crowded, labels, sets, threshold, fits)
    if asked is None:
        return labels
    more = written(linked(written(asked, "near-asked"), sets, threshold), "near-links")
    if more.isEmpty():
        return labels
    return components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, class_id, class_size, kept) for each row: its near-duplicate class, by the class's least id, and whether it is the one that stays.

    Texts of less than five words are one shingle; null texts and texts without words form one class. Of a class the row with the least id
    stays (null ids come first, then the least hash of the text). Rows that repeat id and text are all marked kept or none is: text_hash
    (xxhash64 of the text) tells a caller which rows those are. Texts of any length are read whole. An empty table gives an empty table.
    Other columns of docs are ignored, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(text).alias("text"))
    signs = rows.select("id", "no_id", F.xxhash64("text").alias("text_hash"), signed(F.col("text")).alias("s"))
    signs = written(signs.select("id", "no_id", "text_hash", "s.content", "s.weight", "s.bands"), "near-signs")
    # the row that lends a content its text, by id and hash of the text
    reps = written(signs.groupBy("content").agg(F.min("id").alias("rep"), F.min_by("text_hash", "id").alias("rep_hash")), "near-reps")
    lent = (F.col("id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
    members = signs.join(reps.withColumnRenamed("content", "c"), (F.col("content") == F.col("c")) & lent).dropDuplicates(["content"])
    members = written(members.select("content", "weight", F.explode("bands").alias("bucket")), "near-members")

    def sets_of(wanted: DataFrame) -> DataFrame:
        lenders = wanted.join(reps, "content")
        found = rows.withColumn("text_hash", F.xxhash64("text")).join(lenders, lent)
        found = found.dropDuplicates(["content"]).select("content", occurrences(F.col("text")).alias("o"))
        return found.select("content", F.size("o.elements").alias("weight"), "o.elements", "o.marks")

    labels = classes_of(members, sets_of, threshold)
    if labels is None:
        classes = reps.select("content", F.col("content").alias("label"))
    else:
        classes = reps.join(labels, reps["content"] == labels["node"], "left").select("content", F.coalesce("label", "content").alias("label"))
    named = signs.select("id", "no_id", "text_hash", "content").join(classes, "content")
    by_id = named.groupBy("label", "id").agg(F.min("text_hash").alias("th"), F.count("*").alias("n"))
    heads = by_id.groupBy("label").agg(F.min("id").alias("head"), F.min_by("th", "id").alias("head_hash"), F.sum("n").alias("class_size"))
    # a class of one row is its own head; the others' heads meet their rows under SALTS keys, so a large class is spread
    spread, salts = salted(named, "id", "text_hash")
    out = spread.join(heads.where("class_size > 1").select("*", salts.alias("salt")), ["label", "salt"], "left")
    head, head_hash = F.coalesce("head", "id"), F.coalesce("head_hash", "text_hash")
    kept = (F.col("id") == head) & (F.col("text_hash") == head_hash)
    size = F.coalesce("class_size", F.lit(1)).cast("long")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text_hash", F.when(head != NO_ID, head).alias("class_id"), size.alias("class_size"), kept.alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each near-duplicate class, all columns as they are. Columns made on the way get names that docs does not have."""
    n, i, h, own = free_names(docs, "times", "kept_id", "kept_hash", "own_hash")
    found = near_duplicates(docs, id_col, text, threshold).where("kept").groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.count("*").alias(n))
    mine = docs.withColumn(own, F.xxhash64(text)).join(found, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).eqNullSafe(F.coalesce(i, F.lit(NO_ID))) & (F.col(own) == F.col(h)))
    again = mine.where(F.col(n) > 1).dropDuplicates([i, h])
    return mine.where(F.col(n) == 1).unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])

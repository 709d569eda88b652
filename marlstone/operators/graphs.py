"""Co-occurrence graphs: nodes, pairs, selections, neighbourhoods and connected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ranking import top_k
from marlstone.sources.shared import written


def nodes(memberships: DataFrame, item: str, node: str, least: int = 1) -> DataFrame:
    """(node, n): distinct items of each node, for nodes with at least `least`."""
    return memberships.groupBy(F.col(node).alias("node")).agg(F.countDistinct(item).alias("n")).where(F.col("n") >= least)


#: Nodes of one item that a task pairs with all others of the item; items with more are split.
SPLIT = 256


def item_pairs(memberships: DataFrame, item: str, node: str, split: int = SPLIT) -> DataFrame:
    """(item, a, b): the unordered pairs of distinct nodes of each item, a < b. Null items and nodes pair with nothing.

    An item with k nodes has k(k-1)/2 pairs, whatever is done; the nodes of one with more than `split` are dealt over several tasks, each of which meets all nodes of the item.
    """
    m = memberships.select(F.col(item).alias("__i"), F.col(node).alias("__n")).where("__i is not null and __n is not null").distinct()
    sizes = m.groupBy("__i").agg(F.ceil(F.count("*") / split).cast("int").alias("__parts")).where("__parts > 1")
    sized = m.join(sizes, "__i", "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    one = sized.select("__i", "__n", F.pmod(F.xxhash64("__n"), F.col("__parts")).cast("int").alias("__part"))
    every = sized.select("__i", F.col("__n").alias("__m"), F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    return one.join(every, ["__i", "__part"]).where("__n < __m").select(F.col("__i").alias(item), F.col("__n").alias("a"), F.col("__m").alias("b"))


def pairs(memberships: DataFrame, item: str, node: str, least: int = 1) -> DataFrame:
    """(a, b, n): unordered pairs of nodes that share items, with the number of distinct items."""
    return item_pairs(memberships, item, node).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def by_kinds(first: Column, second: Column, table: list[tuple[tuple[str, ...], object]], default: object) -> Column:
    """The value of the first row whose kinds two ends have between them (one kind: either end has it)."""
    out = F.when(F.lit(False), F.lit(default))
    for kinds, value in table:
        test = F.lit(True)
        for k in kinds:
            test = test & ((first == k) | (second == k))
        if len(kinds) == 2:
            test = test & (first != second)
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def evidence_edges(
    memberships: DataFrame, items: DataFrame, kinds: DataFrame, item: str, node: str, levels: list[str], skipped: str, least: list[tuple[tuple[str, ...], int]], relations: list[tuple[tuple[str, ...], str]], default_least: int, default_relation: str
) -> DataFrame:
    """(a, b, relation, n, best_level, high, score, updated, confidence) of pairs of nodes that share items.

    memberships(item, node); items(item, level, score, day); kinds(node, kind). Pairs with both ends of the `skipped` kind are left out. n: distinct items, kept where it reaches the threshold of the ends' kinds
    (`least`, rows tried in order); best_level: the first of `levels` that an item has (null: none); high: items of the first two levels; score: the items' sum; updated: the newest day; relation by the ends' kinds.
    """
    m = memberships.join(kinds.select(F.col("node").alias(node), "kind"), node)
    rank = F.when(F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level")) > 0, F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level")))
    attributes = items.select(item, rank.alias("__rank"), "score", "day")
    both = item_pairs(memberships, item, node).join(attributes, item)
    g = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("__rank").alias("__best"), F.count_if(F.col("__rank") <= 2).alias("high"), F.round(F.sum("score"), 1).alias("score"), F.max("day").alias("updated"))
    ends = m.select(F.col(node).alias("node"), "kind").distinct()
    j = g.join(ends.select(F.col("node").alias("a"), F.col("kind").alias("ka")), "a").join(ends.select(F.col("node").alias("b"), F.col("kind").alias("kb")), "b")
    kept = j.where(~((F.col("ka") == skipped) & (F.col("kb") == skipped)) & (F.col("n") >= by_kinds(F.col("ka"), F.col("kb"), least, default_least)))
    confidence = F.when((F.col("n") >= 12) & (F.col("high") >= 2), "high").when((F.col("n") >= 5) | (F.col("__best") <= 2), "medium").otherwise("low")
    best = F.get(F.array(*[F.lit(x) for x in levels]), (F.col("__best") - 1).cast("int"))
    return kept.select("a", "b", by_kinds(F.col("ka"), F.col("kb"), relations, default_relation).alias("relation"), "n", best.alias("best_level"), "high", "score", "updated", confidence.alias("confidence"))


def both_ends(edges: DataFrame) -> DataFrame:
    """(node, other, and the edge's columns): each edge from either end."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), *rest).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), *rest))


def degrees(edges: DataFrame, weight: str = "n") -> DataFrame:
    return both_ends(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum(weight).alias("weight"))


def directed(edges: DataFrame, kinds: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Edges turned so that the end of the kind with the smaller priority comes first (ties: the smaller node). kinds: (node, kind), a small table."""
    p = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    ka = kinds.select(F.col("node").alias("a"), F.col("kind").alias("ka"))
    kb = kinds.select(F.col("node").alias("b"), F.col("kind").alias("kb"))
    j = edges.join(ka, "a").join(kb, "b")
    swap = p[F.col("kb")] < p[F.col("ka")]
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return j.select(pick("a", "b").alias("source"), pick("b", "a").alias("target"), pick("ka", "kb").alias("source_kind"), pick("kb", "ka").alias("target_kind"), *rest)


def coverage_top_up(selected: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Selected edges, and for each node below `least` selected ones its heaviest others until it has as many (if it has them)."""
    have = both_ends(selected).groupBy("node").agg(F.count("*").alias("have"))
    rest = both_ends(edges.join(selected.select("a", "b"), ["a", "b"], "left_anti")).join(have, "node", "left")
    w = Window.partitionBy("node").orderBy(F.desc("n"), "other")
    more = rest.withColumn("r", F.row_number().over(w)).where(F.col("r") <= least - F.coalesce("have", F.lit(0)))
    added = more.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "n").distinct()
    return selected.select("a", "b", "n").unionByName(added)


def bridge_top_up(selected: DataFrame, edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each node and each neighbour kind that its selected edges lack, its heaviest edge to that kind."""
    k = kinds.select(F.col("node").alias("other"), "kind")
    have = both_ends(selected).join(k, "other").select("node", "kind").distinct()
    lacking = both_ends(edges).join(k, "other").join(have, ["node", "kind"], "left_anti")
    best = top_k(lacking, ["node", "kind"], [F.desc("n"), F.asc("other")], 1)
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "n").distinct()


def neighbourhood(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Seed nodes and their direct neighbours."""
    return seeds.select("node").unionByName(both_ends(edges).join(seeds.select("node"), "node", "left_semi").select(F.col("other").alias("node"))).distinct()


def subgraph(edges: DataFrame, keep: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The `most` heaviest nodes of the kept edges, and the kept edges between them."""
    e = edges.where(keep)
    n = degrees(e).orderBy(F.desc("weight"), "node").limit(most)
    inner = e.join(n.select(F.col("node").alias("a")), "a", "left_semi").join(n.select(F.col("node").alias("b")), "b", "left_semi")
    return n, inner


#: Rows of one key from which a join on it is not left to one task.
HOT = 1 << 16


def _looked_up(rows: DataFrame, n: int, key: str, table: DataFrame) -> DataFrame:
    """n rows joined to a table with one row for each key. Keys of HOT rows or more, at most one in HOT of the rows, are broadcast with their value; the others are shuffled. Fewer than HOT rows have no such key."""
    if n < HOT:
        return rows.join(table, key)
    counts = written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select(key), "hot-keys")
    if counts.isEmpty():
        return rows.join(table, key)
    hot = table.join(F.broadcast(counts), key, "left_semi")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(counts), key, "left_anti").join(table, key))


def least_reached(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of every id: the least id that can be reached from it along links, itself included. ids: (node); links: (a, b), from a to b.

    Each node takes the least label of itself and of those it links to, then its label's label, until nothing changes; every round is written to the
    shared folder, and labels stay on the executors.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = written(ids.select("node").distinct().withColumn("label", F.col("node")), "labels")
    n_links, n_labels = links.count(), labels.count()
    while True:
        near = _looked_up(links, n_links, "b", labels.select(F.col("node").alias("b"), "label")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        if n_labels >= HOT:
            hooked = written(hooked, "labels-hooked")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = written(_looked_up(hooked, n_labels, "label", jump).select("node", "was", F.least("label", "next").alias("label")), "labels")
        labels = stepped.select("node", "label")
        if stepped.where("label <> was").isEmpty():
            return labels


#: Links that one task follows by itself, and the most targets before its range for which it says which of its nodes reach them.
RANGE, EXITS = 1 << 18, 1 << 12
INNER, EXIT, END, ASKED = range(4)


def _contracted(links: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of a range's links (a, b, role): from each node that later ranges ask for to the targets before the range that it reaches (EXIT), and to the least end that it reaches within (END, a node without links). Ranges with too many targets, or with no fewer links thereby, stay as they are."""
    links = links.sort_values("a", kind="stable")
    own = links[links["role"] != ASKED]
    exits = {b: i for i, b in enumerate(sorted(set(own.loc[own["role"] == EXIT, "b"])))}
    if len(exits) > EXITS:
        return own[["a", "b"]]
    names, reach = list(exits), {}
    for a, b, role in zip(own["a"].tolist(), own["b"].tolist(), own["role"].tolist(), strict=True):
        mask, end = reach[b] if role == INNER else (1 << exits[b], None) if role == EXIT else (0, b)
        was, least = reach.get(a, (0, None))
        reach[a] = (was | mask, end if least is None else least if end is None else min(least, end))
    out = []
    for a in links.loc[links["role"] == ASKED, "a"].tolist():
        mask, end = reach[a]
        out += [(a, end)] if end is not None else []
        out += [(a, names[i]) for i, bit in enumerate(reversed(bin(mask)[2:])) if bit == "1"]
    return pd.DataFrame(out, columns=["a", "b"]) if len(out) < len(own) else own[["a", "b"]]


def _settled(links: pd.DataFrame) -> pd.DataFrame:
    """(node, label) of a range's links, those that leave it being to labels."""
    links, label = links.sort_values("a", kind="stable"), {}
    for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
        label[a] = min(label.get(a, a), label.get(b, b))
    return pd.DataFrame({"node": list(label), "label": list(label.values())})


def _least_ends(links: DataFrame, size: int) -> DataFrame:
    """(node, label) of every `a` of distinct links (a, b) with b < a: the least node that it reaches."""
    kind = links.schema["a"].dataType.simpleString()
    n = links.count()
    settled = lambda placed: placed.groupBy("chunk").applyInPandas(lambda g: _settled(g), f"node {kind}, label {kind}")
    if n <= size:
        return settled(links.withColumn("chunk", F.lit(0)))
    dealt = written(links.repartitionByRange(-(-n // size), "a").withColumn("chunk", F.spark_partition_id()), "ranges")
    homes = dealt.select(F.col("a").alias("b"), F.col("chunk").alias("home")).distinct()
    role = F.when(F.col("home").isNull(), END).when(F.col("home") == F.col("chunk"), INNER).otherwise(EXIT)
    placed = written(dealt.join(homes, "b", "left").select("a", "b", "chunk", "home", role.alias("role")), "placed")
    asked = placed.where(F.col("role") == EXIT).select(F.col("b").alias("a"), "b", F.col("home").alias("chunk"), F.lit(ASKED).alias("role")).distinct()
    fewer = placed.select("a", "b", "chunk", "role").unionByName(asked).groupBy("chunk").applyInPandas(lambda g: _contracted(g), f"a {kind}, b {kind}")
    fewer = written(fewer, "contracted")
    # ranges that hold together too loosely are left to rounds over all links
    below = _least_ends(fewer, size) if 2 * fewer.count() <= n else least_reached(fewer.select(F.explode(F.array("a", "b")).alias("node")), fewer)
    ahead = placed.where(F.col("role") == EXIT).join(below.select(F.col("node").alias("b"), "label"), "b").select("a", F.col("label").alias("b"), "chunk")
    return settled(placed.where(F.col("role") != EXIT).select("a", "b", "chunk").unionByName(ahead))


def least_earlier(ids: DataFrame, links: DataFrame, size: int = RANGE) -> DataFrame:
    """(node, label) as least_reached says it, for links (a, b) to smaller nodes only, b < a.

    Nodes are dealt into ranges of at most about `size` links. A range is followed in order by one task, which says what the nodes that later ranges ask for reach before it; that makes fewer links, for which the same
    is done again. With their labels every range is followed once more. So links are shuffled a few times, however long their paths are and however these cross.
    """
    links = written(links.select("a", "b").where("b < a").distinct(), "links")
    found = written(_least_ends(links, size), "least")
    return ids.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of every id: label is the least id of its connected component. ids: (node); links: (a, b), in either direction."""
    return least_reached(ids, links.select("a", "b").union(links.select("b", "a")))


def shared_key_components(records: DataFrame, node: str, keys: Column) -> DataFrame:
    """(node, label): records that share a key, directly or over others, have one label. keys: an array column; null keys link nothing.

    A key links its records to the least of them, so a key of n records gives n - 1 links.
    """
    k = records.select(F.col(node).alias("node"), F.explode(keys).alias("key")).where("key is not null")
    heads = k.groupBy("key").agg(F.min("node").alias("a"))
    return components(k.select("node").union(records.select(node)), k.join(heads, "key").select("a", F.col("node").alias("b")))


def health(edges: DataFrame, nodes: DataFrame, required: list[str], weak_below: int, share: float, least: int) -> DataFrame:
    """nodes (node, kind) with degree, weight, weak (edges lighter than weak_below), oversized (weight at least that share of all edges'), isolated, low_degree and the required kinds that no neighbour has."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "n"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "n"))).alias("e")).select("e.*")
    kinds = nodes.select(F.col("node").alias("other"), F.col("kind").alias("near"))
    g = ends.join(kinds, "other", "left").groupBy("node").agg(F.count("*").alias("degree"), F.sum("n").alias("weight"), F.count_if(F.col("n") < weak_below).alias("weak"), F.collect_set("near").alias("has"))
    j = nodes.join(g, "node", "left").crossJoin(F.broadcast(edges.agg(F.sum("n").alias("total"))))  # one row
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce("has", F.array().cast("array<string>")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(
        "node", "kind", zero("degree"), zero("weight"), zero("weak"), F.coalesce(F.col("weight") >= share * F.col("total"), F.lit(False)).alias("oversized"),
        F.col("degree").isNull().alias("isolated"), (F.coalesce("degree", F.lit(0)) < least).alias("low_degree"), missing.alias("missing"),
    )

"""Sharding by fixed virtual slots, in DataFrame functions only.

A record's key is hashed into one of a fixed number of slots. Bytes are summed per slot, and a versioned map says which shard
has each slot. Editing the map for other sizes or another number of shards keeps what it can: shards over their share give slots
up, which the emptiest shards take, largest slot first. Only the map (a row for each slot, whatever the data) is ever
gathered; records are joined to it by a broadcast of that fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names

SLOTS = 4096
MAP = "version int, slot int, shard int, bytes long"


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; it depends on the key alone. Null keys have a slot too; rows that repeat a key share its slot."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slot: str, size: str, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes) of every slot, those without records included (0, also for an empty table). A null size counts as none."""
    sums = records.groupBy(F.col(slot).alias("slot")).agg(F.sum(size).alias("bytes"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(sums, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def edit_map(sums: DataFrame, shards: int, current: DataFrame | None = None) -> DataFrame:
    """The next version of a slot-to-shard map for these bytes per slot and this number of shards.

    Without a current map every slot is dealt: largest first, each to the shard with the least bytes so far. With one, a shard keeps its
    slots, largest first, while their bytes stay within an even share (or it has but one slot, larger than that); slots beyond that, and those of shards that are no more, are dealt so.
    Both are one fold over the slots, of fixed size. Ties go to the smaller slot and shard.
    """
    if current is None:
        placed = sums.select("slot", "bytes", F.lit(None).cast("int").alias("old"), F.lit(0).alias("was"))
    else:
        placed = sums.join(current.select("slot", F.col("shard").alias("old"), F.col("version").alias("was")), "slot", "left")
    state = placed.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot", "old"))).alias("all"),
        F.sum("bytes").alias("total"), F.coalesce(F.max("was"), F.lit(0)).alias("was"),
    )
    # a slot above an even share has a shard of its own; the others share what is left
    def without_large(acc: Column, s: Column) -> Column:
        alone = (acc["n"] > 1) & (-s["less"] * acc["n"] > acc["bytes"])
        return F.when(alone, F.struct((acc["bytes"] + s["less"]).alias("bytes"), (acc["n"] - 1).alias("n"))).otherwise(acc)

    evened = F.aggregate("all", F.struct(F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("bytes"), F.lit(shards).alias("n")), without_large, lambda a: F.ceil(a["bytes"] / a["n"]).cast("long"))
    none = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda _: F.lit(0).cast("long"))

    def put(loads: Column, shard: Column, more: Column) -> Column:
        return F.transform(loads, lambda load, i: F.when(i == shard, load + more).otherwise(load))

    # first what stays, then what moves
    keep0 = F.struct(none.alias("loads"), F.array().cast("array<struct<slot:int,shard:int,bytes:bigint>>").alias("kept"), F.array().cast("array<struct<slot:int,bytes:bigint>>").alias("moved"), evened.alias("share"))  # the share rides along, so that it is made once

    def keep(acc: Column, s: Column) -> Column:
        load = F.coalesce(F.get(acc["loads"], s["old"]), F.lit(0))
        stays = s["old"].isNotNull() & (s["old"] < shards) & ((load - s["less"] <= acc["share"]) | (load == 0))
        return F.struct(
            F.when(stays, put(acc["loads"], s["old"], -s["less"])).otherwise(acc["loads"]).alias("loads"),
            F.when(stays, F.concat(acc["kept"], F.array(F.struct(s["slot"].alias("slot"), s["old"].alias("shard"), (-s["less"]).alias("bytes"))))).otherwise(acc["kept"]).alias("kept"),
            F.when(stays, acc["moved"]).otherwise(F.concat(acc["moved"], F.array(F.struct(s["slot"].alias("slot"), (-s["less"]).alias("bytes"))))).alias("moved"),
            acc["share"].alias("share"),
        )

    def deal(acc: Column, s: Column) -> Column:
        shard = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(put(acc["loads"], shard, s["bytes"]).alias("loads"), F.concat(acc["kept"], F.array(F.struct(s["slot"].alias("slot"), shard.alias("shard"), s["bytes"].alias("bytes")))).alias("kept"))

    if current is None:  # nothing to keep
        move_all = F.transform("all", lambda s: F.struct(s["slot"].alias("slot"), (-s["less"]).alias("bytes")))
        sorted_ = state.select(F.struct(keep0["loads"].alias("loads"), keep0["kept"].alias("kept"), move_all.alias("moved")).alias("a"), "was")
    else:
        sorted_ = state.select(F.aggregate("all", keep0, keep).alias("a"), "was")
    dealt = sorted_.select(F.aggregate("a.moved", F.struct(F.col("a.loads").alias("loads"), F.col("a.kept").alias("kept")), deal)["kept"].alias("m"), "was")
    return dealt.select((F.col("was") + 1).alias("version"), F.explode("m").alias("x")).select("version", "x.slot", "x.shard", "x.bytes")


def latest_map(store: DataFrame) -> DataFrame:
    """The newest version in a store of maps."""
    newest = store.agg(F.max("version").alias("newest"))
    return store.join(F.broadcast(newest), F.col("version") == F.col("newest")).drop("newest")  # one row


def place(records: DataFrame, current: DataFrame, slot: str = "virtual_slot") -> DataFrame:
    """records with the `shard` of their slot; a column of that name is replaced, all others stay. Records without a slot of the map do not appear."""
    own, to = free_names(records, "map_slot", "map_shard")
    m = current.select(F.col("slot").alias(own), F.col("shard").alias(to))  # SLOTS rows
    return records.join(F.broadcast(m), F.col(slot) == F.col(own)).withColumn("shard", F.col(to)).drop(own, to)


def positions(placed: DataFrame, order: list, slot: str = "virtual_slot") -> DataFrame:
    """placed with `slot` (a column of that name is replaced): a gapless number from 0 within the shard, slot by slot and in the given order within a slot.

    Rows are numbered within their virtual slot (thousands of small windows, never a shard at once); where a slot begins in its
    shard comes from the counts per slot. Rows that tie in the order are numbered in either way.
    """
    own, shard, n, start, i = free_names(placed, "map_slot", "map_shard", "rows", "start", "nth")
    counts = placed.groupBy(F.col(slot).alias(own), F.col("shard").alias(shard)).agg(F.count("*").alias(n))
    before = Window.partitionBy(shard).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(own, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))  # SLOTS rows at most
    local = placed.withColumn(i, F.row_number().over(Window.partitionBy(slot).orderBy(*order)) - 1)
    return local.join(F.broadcast(starts), F.col(slot) == F.col(own)).withColumn("slot", (F.col(start) + F.col(i)).cast("long")).drop(own, start, i)

"""Running totals over a whole order, and greedy packing of ordered groups into batches, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import written


def running_total(df: DataFrame, order: list[str], value: Column, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of value over all rows up to each one, in the order of the columns `order`; rows that are equal in these come in that of the columns `ties`.

    Rows are dealt into ranges of the order; each range is summed by itself, and the ranges' sums, a row for each, are added up and given back.
    """
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumn("__value", value)
    dealt = written(dealt, "ranges")  # the ranges stay what they are
    sums = dealt.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__range", "__before")  # a row for each range
    inner = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + inner).drop("__range", "__before", "__value")


def batches(groups: DataFrame, order: str, size: str, most: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """groups(order, size, *ties) without ties, with `batch`, from 0: the batch, or the first of those, that a group's rows go to when batches of at most `most` rows are filled in order.

    A group goes to the current batch if it fits, else it begins the next one; a group of more than `most` rows ends the current batch and has ceil(size / most) of its own. Sizes are one or more. Groups of equal `order` come in the order of the columns `ties`, then the smaller first.
    Where a batch that begins at a group ends follows from running totals; which groups begin one is found by doubling steps from the first group on, so no task goes through them one by one.
    """
    weight = F.least(F.col(size), F.lit(most + 1)).cast("long")  # a group that is too large fits nowhere
    g = running_total(groups, [order], weight, "__to", (*ties, size)).withColumn("__from", F.col("__to") - weight)
    g = written(g.select(order, size, "__from", "__to"), "packing")
    # the batch that begins at x holds all groups that end up to x + most: those of its stretch of the totals and of the next one
    stretch = lambda c: F.floor(F.col(c) / (most + 1)).cast("long")
    ends = g.select(F.explode(F.array(stretch("__to"), stretch("__to") - 1)).alias("__s"), F.col("__to").alias("__at"), F.lit(None).cast("long").alias("__begin"))
    begins = g.select(stretch("__from").alias("__s"), F.col("__from").alias("__at"), F.col("__from").alias("__begin"))
    ahead = Window.partitionBy("__s").orderBy("__at").rangeBetween(0, most)
    reach = ends.unionByName(begins).withColumn("__end", F.max(F.when(F.col("__begin").isNull(), F.col("__at"))).over(ahead)).where("__begin is not null")
    jumps = reach.join(g.select(F.col("__from").alias("__begin"), F.col("__to").alias("__own")).hint("merge"), "__begin").select("__begin", F.greatest("__end", "__own").alias("__next"))
    jumps = written(jumps, "packing-jumps")
    found = written(g.agg(F.min("__from").alias("__begin")).where("__begin is not null"), "packing-begins")
    # begins and jumps are joined in the executors, not sent to the driver to be broadcast in every step
    while True:
        # all begins found so far, and where 2^k batches on from each of them one begins
        more = found.join(jumps.hint("merge"), "__begin").select(F.col("__next").alias("__begin")).join(jumps.select("__begin").hint("merge"), "__begin", "left_semi")
        grown = written(found.unionByName(more).distinct(), "packing-begins")
        done = grown.count() == found.count()
        found = grown
        if done:
            break
        twice = jumps.select("__begin", F.col("__next").alias("__mid")).join(jumps.select(F.col("__begin").alias("__mid"), "__next").hint("merge"), "__mid", "left")
        jumps = written(twice.select("__begin", F.coalesce("__next", "__mid").alias("__next")), "packing-jumps")
    opened = g.join(found.select(F.col("__begin").alias("__from"), F.lit(1).alias("__opens")).hint("merge"), "__from", "left")
    many = F.when(F.col("__opens") == 1, F.greatest(F.lit(1), F.ceil(F.col(size) / most))).otherwise(0).cast("long")
    counted = running_total(opened, ["__from"], many, "__batches")  # `order` may repeat, and its equals would come in another order here
    own = F.greatest(F.lit(1), F.ceil(F.col(size) / most)).cast("long")
    return counted.select(order, size, F.when(F.col(size) > most, F.col("__batches") - own).otherwise(F.col("__batches") - 1).alias("batch"))

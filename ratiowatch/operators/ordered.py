"""Ordered work without a single-task window.

A plain window sends every row of a key to one task. When a key has no bound on its
rows, the helpers here cut the ordered data into range partitions, run the window
inside each slice, and carry one row per slice boundary across. The slices are
written out once, so a slice number never changes when a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratiowatch.session import cut_lineage

SLICE = "slice_no"


def range_slices(frame: DataFrame, keys: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """Rows cut into ordered slices; equal (keys, order) values always share a slice.

    The cluster's shuffle width sets the number of slices, so their size follows the
    partition size the cluster is tuned for.
    """
    conf = frame.sparkSession.conf
    width = slices or max(int(conf.get("spark.sql.shuffle.partitions")),
                          int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1")))
    ordered = frame.repartitionByRange(width, *[F.col(key).asc_nulls_first() for key in keys], *order)
    return cut_lineage(ordered.withColumn(SLICE, F.spark_partition_id()))


def prior_values(frame: DataFrame, key: str, order: list[str], values: list[str],
                 slices: int | None = None) -> DataFrame:
    """Add ``prior_<value>``: the previous row's values within ``key``, nulls of the order last.

    ``order`` must end in a unique column. Any number of rows per key is fine: as rows are cut
    in the order of their keys, only the last row of a slice can be the previous row of one in
    the next, so one row per slice is kept and carried, whatever the number of keys.
    """
    ordering = [F.col(name).asc_nulls_last() for name in order]
    cut = range_slices(frame, [key], ordering, slices)
    packed = F.struct(*[F.col(name) for name in values])
    position = F.struct(F.col(key).isNotNull(), F.col(key), *[part for name in order for part in (F.col(name).isNull(), F.col(name))])
    last = cut.groupBy(SLICE).agg(F.max_by(F.struct(F.col(key).alias("key"), packed.alias("held")), position).alias("last"))
    before = F.lag("last").over(Window.orderBy(SLICE))  # a row per slice
    carried = last.select(F.col(SLICE).alias("carry_slice"), before.alias("before")).filter(F.col("before").isNotNull()).select(
        "carry_slice", F.col("before.key").alias("carry_key"), F.col("before.held").alias("carried"))
    inside = Window.partitionBy(SLICE, key).orderBy(*ordering)
    within = cut.select(*[c for c in cut.columns], F.lag(packed).over(inside).alias("previous"))
    joined = within.join(
        F.broadcast(carried),
        F.col(key).eqNullSafe(F.col("carry_key")) & (F.col(SLICE) == F.col("carry_slice")), "left")
    source = F.coalesce(F.col("previous"), F.col("carried"))
    return joined.select(*[F.col(c) for c in frame.columns],
                         *[source[name].alias(f"prior_{name}") for name in values])


def running_totals(frame: DataFrame, order: list[Column], amounts: list[str],
                   slices: int | None = None) -> DataFrame:
    """Add ``cum_<amount>``: inclusive running sums over the whole table in ``order``."""
    cut = range_slices(frame, [], order, slices)
    sums = cut.groupBy(SLICE).agg(*[F.sum(name).alias(f"total_{name}") for name in amounts])
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(SLICE).alias("offset_slice"), *[
        F.coalesce(F.sum(f"total_{name}").over(before), F.lit(0)).alias(f"before_{name}") for name in amounts])
    inside = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.select("*", *[F.sum(name).over(inside).alias(f"inner_{name}") for name in amounts])
    joined = within.join(F.broadcast(offsets), F.col(SLICE) == F.col("offset_slice"))
    return joined.select(*frame.columns, *[
        (F.col(f"inner_{name}") + F.col(f"before_{name}")).alias(f"cum_{name}") for name in amounts])


def numbered(frame: DataFrame, order: list[Column], name: str = "position",
             slices: int | None = None) -> DataFrame:
    """Add a 1-based position in a total order, without sorting everything in one task."""
    counted = running_totals(frame.withColumn("one", F.lit(1)), order, ["one"], slices)
    return counted.drop("one").withColumnRenamed("cum_one", name)

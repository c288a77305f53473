"""Order-dependent primitives that never put all rows into one window.

Rows are cut into buckets of at most ``width`` rows by ``row_id div width``: row ids
are unique, so the bound holds whatever their distribution. A bucket is sorted by
itself, and what it needs from the buckets before it is one small row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from datalathe.functions.scalars import col, present
from datalathe.session import cut_lineage

BUCKET_ROWS = 1 << 20


def _floor_div(column: str, width: int) -> Column:
    """Whole-number division rounding down, exact for every long."""
    return F.expr(f"({column} - pmod({column}, {width}L)) div {width}L")


def carry_fill(
    df: DataFrame, columns: list[str], row_id: str, backward: bool = False, width: int = BUCKET_ROWS
) -> DataFrame:
    """Fill each missing value with the last (or next) present one in row order.

    The data is shuffled once, by bucket; the carried values join on the same key
    and the window reuses that partitioning.
    """
    names = df.columns
    position = -col(row_id) if backward else col(row_id)
    df = df.select(*[present(df, n).alias(n) if n in columns else col(n) for n in names])
    keyed = df.withColumn("__pos", position.cast("long")).withColumn("__bucket", _floor_div("__pos", width))
    ends = keyed.groupBy("__bucket").agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), F.col("__pos"))).alias(f"__t{i}") for i, c in enumerate(columns)]
    )
    # One small row per bucket: hashing it leaves the rows unsorted until the window sorts them.
    carried = _carried_in(ends, [f"__t{i}" for i in range(len(columns))], width).hint("shuffle_hash")
    window = Window.partitionBy("__bucket").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = keyed.join(carried, "__bucket", "left").select(
        "*", *[F.last(col(c), ignorenulls=True).over(window).alias(f"__l{i}") for i, c in enumerate(columns)]
    )
    out = []
    for n in names:
        if n in columns:
            i = columns.index(n)
            out.append(F.coalesce(F.col(f"__l{i}"), F.col(f"__t{i}")).alias(n))
        else:
            out.append(col(n))
    return filled.select(*out)


def _carried_in(ends: DataFrame, values: list[str], width: int) -> DataFrame:
    """For each bucket the last present value of all earlier buckets.

    Bucket numbers that span more than one bucket are cut the same way again; each
    level divides their number by ``width``, so two levels serve 10^18 rows.
    """
    spread = ends.agg(F.min("__bucket").alias("lo"), F.max("__bucket").alias("hi")).first()
    single = spread["lo"] is None or spread["hi"] - spread["lo"] < width
    above = F.lit(0) if single else _floor_div("__bucket", width)
    tagged = ends.withColumn("__super", above)
    window = Window.partitionBy("__super").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select(
        "__bucket", "__super", *[F.last(F.col(v), ignorenulls=True).over(window).alias(v) for v in values]
    )
    if single:
        return local.drop("__super")
    tops = (
        tagged.groupBy("__super")
        .agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("__bucket"))).alias(v) for v in values])
        .withColumnRenamed("__super", "__bucket")
    )
    upper = _carried_in(tops, values, width).select(
        F.col("__bucket").alias("__super"), *[F.col(v).alias(f"__u{v}") for v in values]
    )
    return local.join(upper, "__super", "left").select(
        "__bucket", *[F.coalesce(F.col(v), F.col(f"__u{v}")).alias(v) for v in values]
    )


def assign_row_id(df: DataFrame, order_by: list[str], row_id: str) -> DataFrame:
    """Dense row ids 0, 1, ... in the order of the given columns.

    Range-partitioned and sorted by Spark; the partition sizes then shift the
    positions within partitions. The ids are written once, so later reads agree.
    """
    ordered = df.repartitionByRange(*[col(c) for c in order_by]).sortWithinPartitions(*[col(c) for c in order_by])
    return densify(cut_lineage(ordered.withColumn("__mono", F.monotonically_increasing_id())), row_id)


def densify(tagged: DataFrame, row_id: str) -> DataFrame:
    """Turn ``__mono`` (partition number in the upper bits) into dense row ids."""
    part = F.shiftright(F.col("__mono"), 33)
    sizes = tagged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # One row per partition: as many rows as the job has tasks.
    before = F.coalesce(
        F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # Written out so its true size is known and Spark broadcasts it instead of moving the rows.
    offsets = cut_lineage(sizes.select("__part", before.alias("__offset")))
    within = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    joined = tagged.withColumn("__part", part).join(offsets, "__part")
    data = [col(c) for c in tagged.columns if c != "__mono"]
    return joined.select((F.col("__offset") + within).cast("long").alias(row_id), *data)


def running_total(df: DataFrame, group: str, value: str, weight: str, bounded: bool) -> DataFrame:
    """``df`` plus ``before``: the weight of all smaller values in the same group.

    ``value`` is unique within ``group``. With ``bounded`` the caller vouches that a
    group fits one task. Otherwise rows are range-partitioned over all groups, each
    partition is summed by itself, and small per-partition and per-group offsets
    correct the sums.
    """
    if bounded:
        window = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum(weight).over(window), F.lit(0)))
    ordered = df.repartitionByRange(col(group), col(value)).sortWithinPartitions(col(group), col(value))
    # Written out because sampled partition borders may differ when recomputed.
    placed = cut_lineage(ordered.withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(group, value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    parts = placed.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    # One row per partition: as many rows as the job has tasks.
    offset = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = cut_lineage(parts.select("__part", F.coalesce(offset, F.lit(0)).alias("__offset")))
    total = local.join(parts, "__part").withColumn("__global", F.col("__offset") + F.col("__local"))
    starts = total.groupBy(group).agg(F.min("__global").alias("__start"))
    out = total.join(starts, group).withColumn("before", F.col("__global") - F.col("__start"))
    return out.select(*[col(n) for n in df.columns], "before")

"""Exact ranks, tails and quantiles for groups too large for one task.

A plain window sends a whole group to one task. Here a group is cut into ordered buckets: counts per
bucket are pre-aggregated, a running sum over the (few) buckets gives each bucket's offset, and only
the rows inside one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.session import written


def bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str, descending: bool = False) -> DataFrame:
    """(keys, bucket, bucket_rows, rows_before, group_rows): one row per bucket, nulls kept apart."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("bucket_rows"))
    order = F.col(bucket).desc() if descending else F.col(bucket).asc()
    group = Window.partitionBy(*keys)
    before = F.sum("bucket_rows").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return (counts.withColumn("rows_before", F.coalesce(before, F.lit(0)))
            .withColumn("group_rows", F.sum("bucket_rows").over(group)))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
           descending: bool = False, rank: str = "rank", total: str | None = None) -> DataFrame:
    """Exact row number within `keys`; `bucket` must not decrease (or increase) along `order`."""
    cut = df.withColumn("_bucket", bucket)
    offsets = bucket_offsets(cut, keys, "_bucket", descending)
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    local = cut.withColumn("_inside", inside)
    offsets = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_bucket").alias("_o_bucket"),
                             "rows_before", "group_rows")
    condition = F.col("_bucket").eqNullSafe(F.col("_o_bucket"))
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = local.join(offsets, condition).withColumn(rank, (F.col("_inside") + F.col("rows_before")).cast("bigint"))
    if total:
        joined = joined.withColumn(total, F.col("group_rows"))
    return joined.select(*df.columns, rank, *([total] if total else []))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """All rows with their place in `order`, from 0; `order` should tell all rows apart.

    Rows are sorted by ranges whose limits come from a sample, so ids with one long common prefix or one crowded stretch of numbers still spread
    over all tasks. Only the number of rows of each range passes through a single window.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = written(placed, "numbered")
    part = F.shiftrightunsigned(F.col("_at"), 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    joined = stored.withColumn("_part", part).join(starts, "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_at")


def tail_bounds(df: DataFrame, key: str, position: str, quota: int, bucket_rows: int = 100_000) -> DataFrame:
    """Per key: rows seen, whether the newest `quota` rows leave some out, and the kept positions' bounds.

    `position` must be unique within the key, as offsets are.
    """
    if quota <= 0 or bucket_rows <= 0:
        raise ValueError("Choose a positive tail size")
    cut = df.select(key, position).withColumn("_bucket", F.expr(f"`{position}` div {bucket_rows}"))
    offsets = bucket_offsets(cut, [key], "_bucket", descending=True)
    edges = offsets.where((F.col("rows_before") < quota)
                          & (F.col("rows_before") + F.col("bucket_rows") >= F.least(F.lit(quota), F.col("group_rows"))))
    edge_rows = cut.join(edges, [key, "_bucket"])
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(F.col(position).desc()))
    kept = edge_rows.withColumn("_n", inside).where(F.col("_n") <= quota - F.col("rows_before"))
    lowest = kept.groupBy(key).agg(F.min(position).alias("lowest_position"))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_seen"), F.max(position).alias("highest_position"))
    return (sizes.join(lowest, key)
            .withColumn("rows_kept", F.least(F.col("rows_seen"), F.lit(quota)))
            .withColumn("tail_capped", F.col("rows_seen") > quota)
            .select(key, "rows_seen", "rows_kept", "tail_capped", "lowest_position", "highest_position"))


def bounded_tail(df: DataFrame, key: str, position: str, quota: int, bucket_rows: int = 100_000) -> DataFrame:
    """The newest `quota` rows of every key."""
    bounds = tail_bounds(df, key, position, quota, bucket_rows).select(key, "lowest_position")
    return df.join(bounds, key).where(F.col(position) >= F.col("lowest_position")).drop("lowest_position")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float],
              bucket: Column | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles: (keys, fraction, quantile), without gathering a group.

    Values are ranked through ordered buckets (their integer part by default); only the two values
    around each wanted position are then picked.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranks = ranked(known, keys, [F.col(value)], F.floor(F.col(value)) if bucket is None else bucket,
                   rank="_rank", total="_rows")
    spots = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    wanted = ranks.select(*keys, value, "_rank", "_rows", spots).withColumn(
        "_spot", (F.col("_rows") - 1) * F.col("fraction"))
    low = F.floor("_spot") + 1
    near = wanted.where((F.col("_rank") == low) | (F.col("_rank") == F.least(low + 1, F.col("_rows"))))
    return near.groupBy(*keys, "fraction").agg(
        F.round(F.min(value) + (F.max(value) - F.min(value)) * (F.max("_spot") - F.floor(F.max("_spot"))), 3)
        .alias("quantile"))

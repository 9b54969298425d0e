"""Follow-up joins: does something happen strictly inside (t, t + width)?

Time is cut into buckets as long as the follow-up. The interval of a probe in bucket b covers the end
of b and the start of b + 1, so per key and bucket two numbers are enough: the newest event in b and
the oldest in b + 1. The event side is aggregated to them before any join: no event pairs are built,
hot keys shrink on the map side, and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width_micros(seconds: float) -> int:
    width = round(seconds * 1_000_000)
    if width <= 0:
        raise ValueError("The follow-up must be positive")
    return width


def time_bucket(ts: Column, width: int) -> Column:
    return F.floor(F.unix_micros(ts).cast("decimal(20,0)") / F.lit(width).cast("decimal(20,0)")).cast("bigint")


def follow_up_marks(events: DataFrame, keys: Sequence[str], ts: str, seconds: float) -> DataFrame:
    """(keys, bucket, newest_here, oldest_next) of the events, for probes falling into `bucket`."""
    width = width_micros(seconds)
    here = time_bucket(F.col(ts), width)
    twice = events.select(*keys, ts, F.explode(F.array(here, here - 1)).alias("bucket"), here.alias("_here"))
    own = F.col("_here") == F.col("bucket")
    return twice.groupBy(*keys, "bucket").agg(
        F.max(F.when(own, F.col(ts))).alias("newest_here"),
        F.min(F.when(~own, F.col(ts))).alias("oldest_next"))


def followed(probes: DataFrame, events: DataFrame, keys: Sequence[str], probe_ts: str, event_ts: str,
             seconds: float, how: str = "left_semi") -> DataFrame:
    """Probes with (or with how="left_anti", without) an event strictly inside their follow-up."""
    width = width_micros(seconds)
    marks = follow_up_marks(events, keys, event_ts, seconds)
    end = F.col(probe_ts) + F.make_dt_interval(secs=F.lit(width / 1_000_000).cast("decimal(18,6)"))
    left = probes.withColumn("_bucket", time_bucket(F.col(probe_ts), width)).alias("p")
    right = marks.alias("m")
    same = F.col("p._bucket") == F.col("m.bucket")
    for key in keys:
        same = same & (F.col(f"p.{key}") == F.col(f"m.{key}"))
    hit = (F.col("m.newest_here") > F.col(probe_ts)) | (F.col("m.oldest_next") < end)
    return left.join(right, same & F.coalesce(hit, F.lit(False)), how).drop("_bucket")


def preceding(events: DataFrame, impressions: DataFrame, keys: Sequence[str], event_ts: str, served_at: str,
              seconds: float) -> DataFrame:
    """Inner join of each event to the impressions served in [t - seconds, t): equi on keys and bucket."""
    width = width_micros(seconds)
    spread = impressions.withColumn("_bucket", time_bucket(F.col(served_at), width)).withColumn(
        "_bucket", F.explode(F.array(F.col("_bucket"), F.col("_bucket") + 1)))
    placed = events.withColumn("_bucket", time_bucket(F.col(event_ts), width))
    start = F.col(event_ts) - F.make_dt_interval(secs=F.lit(width / 1_000_000).cast("decimal(18,6)"))
    return (placed.join(spread, [*keys, "_bucket"])
            .where((F.col(served_at) >= start) & (F.col(served_at) < F.col(event_ts))).drop("_bucket"))

"""Watch sessions and the newest watch per user and movie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt
from slatewise.functions.scalars import micros, watch_order

WATCH_KEY = ("source_id", "topic", "user_id", "movie_id")
DAY = 86_400_000_000


def parsed_watches(events: DataFrame) -> DataFrame:
    return events.where((F.col("event_type") == "watch") & (F.col("parse_status") == "parsed")
                        & F.col("user_id").isNotNull() & F.col("movie_id").isNotNull())


def latest_watches(events: DataFrame) -> DataFrame:
    """The newest watch of every (source, topic, user, movie): an aggregation, not a sorted window."""
    order = watch_order(F.col("event_ts"), F.col("broker_timestamp_ms"), F.col("partition"), F.col("offset"))
    rest = [c for c in events.columns if c not in WATCH_KEY]
    newest = parsed_watches(events).groupBy(*WATCH_KEY).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(*WATCH_KEY, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def sessions(watches: DataFrame, keys: Sequence[str] = WATCH_KEY, ts: str = "event_ts", tie: str = "offset",
             idle_seconds: float = fmt.IDLE_SECONDS) -> DataFrame:
    """Number the sessions of each key; a gap of exactly `idle_seconds` already starts a new one.

    Keys are cut into days, so a key with very many watches is spread: inside a day neighbours are
    compared by a window, across days only each day's newest time and session count travel. A watch without
    a time of its own counts at the broker's, else at its ingestion, else at the epoch, so none is lost.
    """
    idle = round(idle_seconds * 1_000_000)
    other = [F.timestamp_millis(c) if c == "broker_timestamp_ms" else F.col(c) for c in ("broker_timestamp_ms", "ingested_at") if c in watches.columns]
    rows = watches.withColumn("_us", F.coalesce(micros(F.coalesce(F.col(ts), *other)), F.lit(0))).withColumn("_day", F.expr(f"_us div {DAY}"))
    by_day, across = Window.partitionBy(*keys, "_day"), Window.partitionBy(*keys).orderBy("_day")
    days = rows.groupBy(*keys, "_day").agg(F.max("_us").alias("_newest")).withColumn(
        "_previous", F.lag("_newest").over(across)).select(*keys, "_day", "_previous")
    inside = by_day.orderBy("_us", tie)
    joined = rows.join(days, [*keys, "_day"])
    gap = F.col("_us") - F.coalesce(F.lag("_us").over(inside), F.col("_previous"))
    marked = joined.withColumn("_starts", F.coalesce(gap >= idle, F.lit(True)).cast("int"))
    earlier = marked.groupBy(*keys, "_day").agg(F.sum("_starts").alias("_count")).withColumn(
        "_before", F.coalesce(F.sum("_count").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(
        *keys, "_day", "_before")
    numbered = marked.withColumn("_local", F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.join(earlier, [*keys, "_day"]).withColumn(
        "session", (F.col("_local") + F.col("_before")).cast("bigint")).drop(
        "_us", "_day", "_previous", "_starts", "_local", "_before")


def session_records(numbered: DataFrame, keys: Sequence[str] = WATCH_KEY, ts: str = "event_ts",
                    tie: str = "offset") -> DataFrame:
    """(keys, session, watches, first/last time and position): what coalescing keeps of each session."""
    order = F.struct(ts, tie)
    return numbered.groupBy(*keys, "session").agg(
        F.count(F.lit(1)).alias("watches"), F.min(order).alias("_first"), F.max(order).alias("_last")).select(
        *keys, "session", "watches", F.col(f"_first.{ts}").alias("first_ts"), F.col(f"_first.{tie}").alias(f"first_{tie}"),
        F.col(f"_last.{ts}").alias("last_ts"), F.col(f"_last.{tie}").alias(f"last_{tie}"))

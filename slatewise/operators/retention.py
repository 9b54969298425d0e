"""What may be dropped from the event history: ledger, pins, expiry plan and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt
from slatewise.functions.scalars import retention_day
from slatewise.operators.sessions import latest_watches, parsed_watches

PAYLOAD = ("key", "value")


def payload_bytes(*columns: str) -> Column:
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("bigint")


def with_retention_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", retention_day(F.col("ingested_at"), F.col("event_ts"), F.col("broker_timestamp_ms")))


def daily_ledger(events: DataFrame, payload: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """Rows, bytes and offset bounds per (day, source, topic, partition)."""
    return with_retention_day(events).groupBy("day", "source_id", "topic", "partition").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(payload_bytes(*payload)).alias("bytes"),
        F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"))


def protected_days(pins: DataFrame) -> DataFrame:
    """Distinct UTC days (text) touched by the pin intervals (pin_id, start, end), both ends included."""
    if pins.where("not coalesce(start < end, false)").limit(1).count():
        raise ValueError("Invalid protected interval")
    days = F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("d")
    return pins.select(days).select(F.date_format("d", "yyyy-MM-dd").alias("day")).distinct()


def ledger_status(ledger: DataFrame, pinned: DataFrame, history_bytes: int) -> DataFrame:
    """One row of totals: all, pinned and unpinned bytes, and whether the unpinned ones are over budget."""
    days = ledger.groupBy("day").agg(F.sum("row_count").alias("row_count"), F.sum("bytes").alias("bytes"))
    marked = days.join(pinned.withColumn("_pin", F.lit(True)), "day", "left").withColumn(
        "pinned", F.coalesce("_pin", F.lit(False)) | (F.col("day") == fmt.UNKNOWN_DAY))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return marked.agg(
        zero(F.sum("row_count")).alias("row_count"), zero(F.sum("bytes")).alias("total_bytes"),
        zero(F.sum(F.when(F.col("pinned"), F.col("bytes")))).alias("pinned_bytes"),
        zero(F.sum(F.when(~F.col("pinned"), F.col("bytes")))).alias("unpinned_bytes"),
        F.count(F.lit(1)).alias("accounted_days"), F.min("day").alias("oldest_day"),
    ).withColumn("over_target", F.col("unpinned_bytes") > history_bytes)


def expire_plan(ledger: DataFrame, pinned: DataFrame, history_bytes: int, cutoff_day: str) -> DataFrame:
    """Days with running size and `expire`: oldest unpinned days before the cut-off, until the rest fits.

    A day goes when it and everything newer (unpinned) exceed the budget. One row per day, so the
    running sum is over a few thousand rows whatever the history holds.
    """
    days = ledger.groupBy("day").agg(F.sum("row_count").alias("row_count"), F.sum("bytes").alias("bytes"))
    marked = days.join(pinned.withColumn("_pin", F.lit(True)), "day", "left").withColumn(
        "pinned", F.coalesce("_pin", F.lit(False)) | (F.col("day") == fmt.UNKNOWN_DAY)).drop("_pin")
    counted = F.when(F.col("pinned"), 0).otherwise(F.col("bytes"))
    newest_first = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("running_bytes", F.sum(counted).over(newest_first)).withColumn(
        "expire", ~F.col("pinned") & (F.col("day") < cutoff_day) & (F.col("running_bytes") > history_bytes))


def expired_events(events: DataFrame, plan: DataFrame, pinned: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows the plan drops: their day expires, none of their own days is pinned, and they were processed.

    processed: (source_id, topic, partition, last_offset).
    """
    dated = with_retention_day(events)
    doomed = dated.join(plan.where("expire").select("day"), "day", "left_semi")
    done = doomed.join(processed, ["source_id", "topic", "partition"], "left").where(
        F.col("offset") <= F.coalesce("last_offset", F.lit(-1)))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    flagged = done.withColumns({"_d1": text(F.col("ingested_at")), "_d2": text(F.col("event_ts")),
                                "_d3": text(F.timestamp_millis(F.col("broker_timestamp_ms")))})
    for name in ("_d1", "_d2", "_d3"):
        flagged = flagged.join(pinned.select(F.col("day").alias(name)), name, "left_anti")
    return flagged.drop("_d1", "_d2", "_d3", "last_offset")


def compact_watches(events: DataFrame) -> DataFrame:
    """All other records plus the newest watch of every user and movie."""
    is_watch = ((F.col("event_type") == "watch") & (F.col("parse_status") == "parsed")
                & F.col("user_id").isNotNull() & F.col("movie_id").isNotNull())
    others = events.where(~F.coalesce(is_watch, F.lit(False)))
    return others.unionByName(latest_watches(events).select(*events.columns))


def compaction_counts(events: DataFrame) -> DataFrame:
    """One row: watches retained and removed by compaction."""
    before = parsed_watches(events).agg(F.count(F.lit(1)).alias("_all"))
    after = parsed_watches(events).select("source_id", "topic", "user_id", "movie_id").distinct().agg(
        F.count(F.lit(1)).alias("retained_watch_events"))
    return before.crossJoin(after).select(  # one row each
        "retained_watch_events", (F.col("_all") - F.col("retained_watch_events")).alias("removed_watch_events"))

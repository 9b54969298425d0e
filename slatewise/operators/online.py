"""Online measurement: eligible impressions and watches, coverage and subsequent-watch hit rates."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt
from slatewise.functions.scalars import in_window, ratio, slate_is_sound, valid_slate
from slatewise.operators.intervals import followed
from slatewise.operators.quality import DataError, reason_column, tally


@dataclass(frozen=True)
class Window:
    """Requests in [start, end), watches in [start, observation_end); times as UTC text or datetime."""

    start: object
    end: object
    observation_end: object
    follow_up_seconds: float = 3600.0
    server: str = ""


def recommendation_reasons(events: DataFrame, window: Window, size: int = fmt.SLATE_SIZE) -> DataFrame:
    """Recommendation events of the request window with `drop_reason` and the ordered top `slate`."""
    rows = events.where((F.col("event_type") == "recommendation") & in_window(F.col("event_ts"), window.start, window.end))
    items = F.coalesce("fields.recommendations", F.array().cast("array<struct<movie_id:string,rank:int>>"))
    return rows.withColumn("drop_reason", reason_column(
        ("unparsed_rows", F.col("parse_status") != "parsed"),
        ("invalid_user_rows", ~F.coalesce(F.col("user_id") > 0, F.lit(False))),
        ("other_server_recommendations", ~F.col("fields.server").eqNullSafe(F.lit(window.server))),
        ("unsuccessful_recommendations", ~F.col("fields.status").eqNullSafe(F.lit(200))),
        ("invalid_recommendation_slates", ~slate_is_sound(items)),
        ("short_recommendation_slates", F.size(items) < size),
    )).withColumn("slate", F.when(F.col("drop_reason").isNull(), valid_slate(items, size)))


def watch_reasons(events: DataFrame, window: Window) -> DataFrame:
    """Watch events of the observation window with `drop_reason`."""
    rows = events.where((F.col("event_type") == "watch")
                        & in_window(F.col("event_ts"), window.start, window.observation_end))
    return rows.withColumn("drop_reason", reason_column(
        ("unparsed_rows", F.col("parse_status") != "parsed"),
        ("invalid_user_rows", ~F.coalesce(F.col("user_id") > 0, F.lit(False))),
        ("invalid_watch_rows", ~F.coalesce((F.col("movie_id") != "") & (F.col("fields.minute") >= 0), F.lit(False))),
    ))


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("drop_reason").isNull()).drop("drop_reason")


def impressions(eligible: DataFrame) -> DataFrame:
    """Distinct (user, time, ordered slate) with a digest as id."""
    rows = eligible.select("user_id", "event_ts", "slate").withColumn("impression_id", F.concat_ws(
        ":", F.col("user_id").cast("string"), F.unix_micros("event_ts").cast("string"),
        F.substring(F.sha2(F.to_json("slate"), 256), 1, 32)))
    return rows.dropDuplicates(["impression_id"])


def viewing_units(watches: DataFrame, start=None, end=None) -> DataFrame:
    """Distinct observed (user, movie) pairs."""
    return watches.where(in_window(F.col("event_ts"), start, end)).select("user_id", "movie_id").distinct()


def hits(shown: DataFrame, watches: DataFrame, follow_up_seconds: float) -> DataFrame:
    """Impression ids followed by a watch of one of their movies, strictly inside the follow-up."""
    slots = shown.select("impression_id", "user_id", "event_ts",
                         F.explode(F.array_distinct("slate")).alias("movie_id"))
    found = followed(slots, watches.withColumnRenamed("event_ts", "watch_ts"), ["user_id", "movie_id"],
                     "event_ts", "watch_ts", follow_up_seconds)
    return found.select("impression_id").distinct()


def observed_watchers(shown: DataFrame, watches: DataFrame, follow_up_seconds: float) -> DataFrame:
    """Impressions whose user watched anything inside the follow-up."""
    return followed(shown, watches.withColumnRenamed("event_ts", "watch_ts"), ["user_id"], "event_ts", "watch_ts",
                    follow_up_seconds)


def hit_rate_summary(shown: DataFrame, watches: DataFrame, follow_up_seconds: float) -> DataFrame:
    """One row of counts and rates; a rate without a denominator is null."""
    base = shown.agg(F.count(F.lit(1)).alias("eligible_recommendations"),
                     F.countDistinct("user_id").alias("unique_recommended_users"))
    hit = hits(shown, watches, follow_up_seconds).agg(F.count(F.lit(1)).alias("hits"))
    watched = observed_watchers(shown, watches, follow_up_seconds).agg(F.count(F.lit(1)).alias("observed_watchers"))
    row = base.crossJoin(hit).crossJoin(watched)  # single rows
    total, seen = F.col("eligible_recommendations"), F.col("observed_watchers")
    return row.withColumns({
        "hit_rate": ratio(F.col("hits"), total), "conditional_hit_rate": ratio(F.col("hits"), seen),
        "observed_watch_rate": ratio(seen, total), "without_observed_watch": total - seen,
        "observed_without_match": seen - F.col("hits"), "no_observed_watch_rate": ratio(total - seen, total)})


def partition_coverage(events: DataFrame, start, end) -> DataFrame:
    """Per partition: rows, time and offset bounds, and whether they enclose [start, end]."""
    per = events.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_ts").alias("oldest_event"), F.max("event_ts").alias("newest_event"),
        F.min("offset").alias("lowest_offset"), F.max("offset").alias("highest_offset"))
    inside = ((F.col("oldest_event") <= F.lit(start).cast("timestamp"))
              & (F.col("newest_event") >= F.lit(end).cast("timestamp")))
    return per.withColumn("bracketed", F.coalesce(inside, F.lit(False)))


def all_bracketed(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.coalesce(F.every("bracketed"), F.lit(False)).alias("window_bracketed"))


def exclusion_tally(events: DataFrame, window: Window) -> DataFrame:
    """(drop_reason, n) over recommendations of the request window and watches of the observation window."""
    recs = tally(recommendation_reasons(events, window)).select(F.lit("recommendation").alias("kind"), "drop_reason", "n")
    return recs.unionByName(tally(watch_reasons(events, window)).select(F.lit("watch").alias("kind"), "drop_reason", "n"))


def check_window(window: Window) -> None:
    start, end, last = (pd.Timestamp(v) for v in (window.start, window.end, window.observation_end))
    if not (start < end and end + pd.Timedelta(seconds=window.follow_up_seconds) <= last) or window.follow_up_seconds <= 0:
        raise ValueError("Choose an increasing window with complete follow-up through end + follow-up")
    if not window.server.strip():
        raise ValueError("Name the recommendation server")


def evaluate_online(events: DataFrame, window: Window, require_coverage: bool = True) -> DataFrame:
    """Hit-rate summary of deduplicated parsed events, refused unless every partition spans the window."""
    check_window(window)
    if require_coverage:
        coverage = partition_coverage(events.where("event_ts is not null"), window.start, window.observation_end)
        if not all_bracketed(coverage).first()[0]:
            raise DataError("A partition does not span the requested window and follow-up")
    shown = impressions(kept(recommendation_reasons(events, window)))
    return hit_rate_summary(shown, kept(watch_reasons(events, window)), window.follow_up_seconds)

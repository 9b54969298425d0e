"""Linking watches and ratings to earlier slates, and logged responses to served requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.scalars import micros, ranking_key, ratio
from slatewise.operators.intervals import preceding
from slatewise.operators.ranks import quantiles

IMPRESSION = ("origin", "identity", "user_id", "served_at", "available_at", "recommendations")
EVENT_KEY = ("source_id", "topic", "partition", "offset")
PERSONAL_METHODS = ("ease", "llm_cold_start")


def request_impressions(requests: DataFrame) -> DataFrame:
    """Complete, successful API responses, dated when they finished."""
    return requests.where((F.col("status") == 200) & F.col("response_complete") & F.col("finished_at").isNotNull()
                          & F.col("user_id").isNotNull() & F.col("recommendations").isNotNull()).select(
        F.lit("recommendation_requests").alias("origin"), F.col("request_id").alias("identity"), "user_id",
        F.col("finished_at").alias("served_at"), F.col("finished_at").alias("available_at"),
        F.transform("recommendations", lambda r: F.struct(r["movie_id"].alias("movie_id"), r["rank"].alias("rank")))
        .alias("recommendations"))


def event_impressions(events: DataFrame) -> DataFrame:
    """Successful recommendation lines of the stream."""
    return events.where((F.col("event_type") == "recommendation") & (F.col("parse_status") == "parsed")
                        & (F.col("fields.status") == 200) & F.col("event_ts").isNotNull()
                        & F.col("user_id").isNotNull() & F.col("fields.recommendations").isNotNull()).select(
        F.lit("kafka_events").alias("origin"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in EVENT_KEY]).alias("identity"), "user_id",
        F.col("event_ts").alias("served_at"), F.col("ingested_at").alias("available_at"),
        F.col("fields.recommendations").alias("recommendations"))


def all_impressions(requests: DataFrame, events: DataFrame) -> DataFrame:
    return request_impressions(requests).unionByName(event_impressions(events))


def observed_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("watch", "rating") & (F.col("parse_status") == "parsed")
                        & F.col("event_ts").isNotNull() & F.col("user_id").isNotNull() & F.col("movie_id").isNotNull())


def candidate_links(impressions: DataFrame, observed: DataFrame, seconds: float = 86_400) -> DataFrame:
    """Each observed event with every impression of its movie for its user in [t - seconds, t).

    One link per event and impression, with the movie's ranks in the slate. `ambiguous` marks events
    with several candidates.
    """
    slots = impressions.withColumn("movie_id", F.explode(F.array_distinct(
        F.transform("recommendations", lambda r: r["movie_id"])))).select(
        "origin", "identity", "user_id", "movie_id", "served_at",
        F.transform(F.filter("recommendations", lambda r: r["movie_id"] == F.col("movie_id")), lambda r: r["rank"]).alias("ranks"))
    events = observed.select(*EVENT_KEY, "user_id", "movie_id", "event_ts", "event_type")
    links = preceding(events, slots, ["user_id", "movie_id"], "event_ts", "served_at", seconds)
    count = F.count(F.lit(1)).over(Window.partitionBy(*EVENT_KEY))
    return links.withColumns({
        "seconds_after": (micros(F.col("event_ts")) - micros(F.col("served_at"))) / 1_000_000,
        "candidate_count": count}).withColumn("ambiguous", F.col("candidate_count") > 1)


def candidate_counts(impressions: DataFrame, observed: DataFrame, seconds: float = 86_400) -> DataFrame:
    """Every observed event with its number of candidate impressions, zero included."""
    links = candidate_links(impressions, observed, seconds).groupBy(*EVENT_KEY).agg(
        F.count(F.lit(1)).alias("candidate_count"))
    return observed.join(links, list(EVENT_KEY), "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0))).withColumn("ambiguous", F.col("candidate_count") > 1)


def match_one_to_one(course: DataFrame, api: DataFrame, tolerance_seconds: float = 5.0) -> DataFrame:
    """Course rows with the API request they match alone, or null.

    course: (course_id, user_id, ids, at); api: (request_id, user_id, ids, at). Same user, same ordered
    ids, at most `tolerance_seconds` apart. Among course rows with a single candidate, an API request
    wanted by several of them matches none.
    """
    width = round(tolerance_seconds * 1_000_000)
    place = lambda ts: F.expr(f"unix_micros({ts}) div {width}")
    left = course.select("course_id", "user_id", ranking_key(F.col("ids")).alias("slate_key"), F.col("at").alias("course_at"))
    left = left.withColumn("_bucket", place("course_at"))
    right = api.select("request_id", "user_id", ranking_key(F.col("ids")).alias("slate_key"), F.col("at").alias("api_at"))
    right = right.withColumn("_here", place("api_at")).withColumn(
        "_bucket", F.explode(F.array(F.col("_here") - 1, F.col("_here"), F.col("_here") + 1)))
    near = left.join(right, ["user_id", "slate_key", "_bucket"]).where(
        F.abs(micros(F.col("course_at")) - micros(F.col("api_at"))) <= width)
    single = near.groupBy("course_id").agg(F.count(F.lit(1)).alias("_n"), F.min("request_id").alias("request_id")).where("_n = 1")
    wanted = single.groupBy("request_id").agg(F.count(F.lit(1)).alias("_m"), F.min("course_id").alias("course_id")).where("_m = 1")
    return course.join(wanted.select("course_id", "request_id"), "course_id", "left")


def latency_percentiles(df: DataFrame, keys: Sequence[str], value: str, limit_ms: float = 600) -> DataFrame:
    """(keys, samples, p50, p95, max, over_limit) of the known values, interpolated and rounded to 3."""
    known = df.where(F.col(value).isNotNull())
    spots = quantiles(known, keys, value, [0.5, 0.95]).groupBy(*keys).agg(
        F.max(F.when(F.col("fraction") == 0.5, F.col("quantile"))).alias("p50"),
        F.max(F.when(F.col("fraction") == 0.95, F.col("quantile"))).alias("p95"))
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.max(value).alias("max"),
                                      F.count_if(F.col(value) > limit_ms).alias("over_limit"))
    return counts.join(spots, list(keys)) if keys else counts.crossJoin(spots)  # one row each


def personalised_share(matched: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: requests, confirmed personal ones, distinct users and rankings, share in per cent.

    matched: course rows with user_id, ids and serving_method of their unique API match (null without).
    """
    personal = F.col("serving_method").isin(*PERSONAL_METHODS)
    found = matched.agg(
        F.count("serving_method").alias("matched"), F.count_if(personal).alias("personalised"),
        F.countDistinct(F.when(personal, F.col("user_id"))).alias("personalised_users"),
        F.countDistinct(F.when(personal, ranking_key(F.col("ids")))).alias("personalised_rankings"))
    total = requests.agg(F.count(F.lit(1)).alias("requests"))
    return found.crossJoin(total).withColumn(  # one row each
        "personalised_percent", F.round(100 * ratio(F.col("personalised"), F.col("requests")), 3))


def methods(matched: DataFrame) -> DataFrame:
    """Matched requests by serving method and version."""
    return matched.where("request_id is not null").groupBy(
        F.coalesce("serving_method", F.lit("unknown")).alias("serving_method"), "version").agg(F.count(F.lit(1)).alias("requests"))

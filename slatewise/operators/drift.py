"""Feature histograms of external data and the distance between two of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt
from slatewise.functions import metadata as meta
from slatewise.functions.scalars import band, in_window, valid_response_body
from slatewise.operators.ranks import bounded_tail, tail_bounds

PROFILE = ("source", "feature", "category", "n")


def _long(source: str, df: DataFrame, error: Column, features: dict[str, Column]) -> DataFrame:
    """Rows to (source, feature, category, n): one explode, one map-side combined count.

    Error and features are columns of their own before the explode, which would compute them again for each mention, and the outer
    form keeps the optimizer from repeating them all in a derived filter.
    """
    staged = df.select(error.alias("_error"), *[c.alias(f"_{n}") for n, c in features.items()])
    bad = F.col("_error").isNotNull()
    pair = lambda name, value: F.struct(F.lit(name).alias("feature"), value.alias("category"))
    pairs = F.array(pair("schema", F.when(bad, "invalid").otherwise("valid")), pair("error", F.col("_error")),
                    *[pair(n, F.when(~bad, F.col(f"_{n}"))) for n in features])
    return (staged.select(F.explode_outer(pairs).alias("p")).where("p.category is not null")
            .groupBy("p.feature", "p.category").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(source).alias("source"), "feature", "category", "n"))


def profile_events(events: DataFrame) -> DataFrame:
    error = F.when(~F.col("parse_status").eqNullSafe(F.lit("parsed")), F.coalesce("error_type", F.lit("unsupported_event")))
    return _long("kafka", events, error, {
        "event_type": F.col("event_type"),
        "rating": F.when(F.col("event_type") == "rating", F.col("fields.rating").cast("string"))})


def profile_users(records: DataFrame, record: str = "record") -> DataFrame:
    """records: VARIANT metadata, or null with the reason under `fetch_error`."""
    value = F.col(record)
    described = lambda name: F.coalesce(meta.text_of(meta.field(value, name)) != "", F.lit(False))
    present = described("self_description_likes") | described("self_description_dislikes")
    error = F.coalesce(F.col("fetch_error"), F.when(value.isNull(), "missing_metadata"), meta.metadata_error("user", value))
    return _long("user_api", records, error, {
        "age": band(meta.number(meta.field(value, "age"))["value"], fmt.AGE_BANDS),
        "description_present": F.when(present, "True").otherwise("False")})


def profile_movies(records: DataFrame, record: str = "record") -> DataFrame:
    value = F.col(record)
    cost = F.coalesce(meta.field(value, "cost"), meta.field(value, "license_cost"))
    names = F.array_sort(F.array_distinct(meta.genres(meta.field(value, "genres"))["names"]))
    error = F.coalesce(F.col("fetch_error"), F.when(value.isNull(), "missing_metadata"), meta.metadata_error("movie", value))
    return _long("movie_api", records, error, {
        "runtime": band(meta.number(meta.field(value, "runtime"))["value"], fmt.RUNTIME_BANDS),
        "cost": band(meta.number(cost)["value"], fmt.COST_BANDS),
        "genres": F.coalesce(F.nullif(F.array_join(names, "|"), F.lit("")), F.lit("missing"))})


def profile_requests(requests: DataFrame) -> DataFrame:
    """requests: user_id, status, response_body, serving_method, latency_ms."""
    ok = F.col("status").eqNullSafe(F.lit(200))
    error = (F.when(~F.coalesce(F.col("user_id") > 0, F.lit(False)), "invalid_request_user")
             .when(ok & ~valid_response_body(F.col("response_body")), "invalid_recommendation_response")
             .when((F.col("latency_ms") < 0) | F.isnan("latency_ms"), "invalid_latency"))
    return _long("recommendation_api", requests, error, {
        "status": F.coalesce(F.col("status").cast("string"), F.lit("None")),
        "serving_method": F.coalesce(F.nullif("serving_method", F.lit("")), F.lit("none")),
        "latency": band(F.col("latency_ms"), fmt.LATENCY_BANDS)})


def sample_sizes(profile: DataFrame) -> DataFrame:
    """(source, samples, invalid) for every known source, zero when nothing was seen."""
    spark = profile.sparkSession
    known = spark.createDataFrame([(s,) for s in fmt.QUALITY_SOURCES], "source string")
    seen = profile.where("feature = 'schema'").groupBy("source").agg(
        F.sum("n").alias("samples"), F.coalesce(F.sum(F.when(F.col("category") == "invalid", F.col("n"))), F.lit(0)).alias("invalid"))
    return known.join(seen, "source", "left").na.fill(0, ["samples", "invalid"])


def _comparable(profile: DataFrame) -> DataFrame:
    """Watches are coalesced before storage, so their share is not a stream frequency."""
    mix = (F.col("source") == "kafka") & (F.col("feature") == "event_type")
    return profile.where((F.col("feature") != "error") & ~(mix & (F.col("category") == "watch"))).withColumn(
        "feature", F.when(mix, "event_type_non_watch").otherwise(F.col("feature")))


def drift_distances(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(source, feature, distance): total variation, null when either side has under 50 observations."""
    enough = sample_sizes(reference).select("source", F.col("samples").alias("a")).join(
        sample_sizes(current).select("source", F.col("samples").alias("b")), "source").where(
        (F.col("a") >= fmt.MIN_SAMPLES) & (F.col("b") >= fmt.MIN_SAMPLES)).select("source")
    left = _comparable(reference).select("source", "feature", "category", F.col("n").alias("before"))
    right = _comparable(current).select("source", "feature", "category", F.col("n").alias("after"))
    both = left.join(right, ["source", "feature", "category"], "full_outer").na.fill(0, ["before", "after"])
    totals = both.groupBy("source", "feature").agg(F.sum("before").alias("before_total"), F.sum("after").alias("after_total"))
    gaps = both.join(totals, ["source", "feature"]).groupBy("source", "feature", "before_total", "after_total").agg(
        F.sum(F.abs(F.try_divide(F.col("before").cast("double"), F.col("before_total"))
                    - F.try_divide(F.col("after").cast("double"), F.col("after_total")))).alias("gap"))
    fits = F.least("before_total", "after_total") >= fmt.MIN_SAMPLES
    return gaps.join(enough, "source", "left_semi").select(
        "source", "feature", F.when(fits, F.round(0.5 * F.col("gap"), 6)).alias("distance"))


def drift_findings(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(source, feature, reason, value): too few samples, too many invalid rows, strong drift."""
    sizes = sample_sizes(reference).select("source", F.col("samples").alias("before")).join(sample_sizes(current), "source")
    fewest = F.least("before", "samples")
    none = F.lit(None).cast("string")
    few = sizes.where(fewest < fmt.MIN_SAMPLES).select(
        "source", none.alias("feature"), F.lit("insufficient_samples").alias("reason"), fewest.cast("double").alias("value"))
    share = F.try_divide(F.col("invalid").cast("double"), F.col("samples"))
    broken = sizes.where((fewest >= fmt.MIN_SAMPLES) & (share > fmt.MAX_INVALID_FRACTION)).select(
        "source", none.alias("feature"), F.lit("schema_failure_rate").alias("reason"), share.alias("value"))
    strong = drift_distances(reference, current).where(F.col("distance") > fmt.DRIFT_THRESHOLD).select(
        "source", "feature", F.lit("strong_drift").alias("reason"), F.col("distance").alias("value"))
    return few.unionByName(broken).unionByName(strong)


def passes_against_itself(snapshot: DataFrame) -> bool:
    """A reference is kept only when it has no finding of its own."""
    return drift_findings(snapshot, snapshot).limit(1).count() == 0


def metadata_cohort(events: DataFrame, movies: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Users seen and movies whose metadata are to be profiled: all of them, or a fixed cohort of `size` each, the first users seen (by partition,
    newest offset first) and the first movies by id."""
    users = (events.where("user_id is not null").groupBy("user_id")
             .agg(F.min(F.struct(F.col("partition"), -F.col("offset"))).alias("_seen")))
    ids = movies.select("movie_id").distinct()
    if size is None:
        return users.select("user_id"), ids
    return users.orderBy("_seen").limit(size).select("user_id"), ids.orderBy("movie_id").limit(size)


def quality_snapshot(events: DataFrame, requests: DataFrame, user_records: DataFrame, movie_records: DataFrame,
                     start, end, limit: int | None = None, partitions: int = 1) -> DataFrame:
    """Profile of all four sources over the whole window, or over bounded tails of `limit` events and requests, and the given metadata.

    events need partition, offset, ingested_at; requests need started_at and request_id.
    """
    tail, recent = events, requests
    if limit is not None:
        tail = bounded_tail(events, "partition", "offset", max(1, limit // max(1, partitions)))
        recent = requests.orderBy(F.col("started_at").desc(), F.col("request_id").desc()).limit(limit)
    parts = [profile_events(tail.where(in_window(F.col("ingested_at"), start, end))),
             profile_requests(recent.where(in_window(F.col("started_at"), start, end))), profile_users(user_records), profile_movies(movie_records)]
    return reduce(DataFrame.unionByName, parts)


def tail_coverage(events: DataFrame, limit: int, partitions: int = 1) -> DataFrame:
    """Per partition whether its newest `limit` (shared between partitions) rows leave some out."""
    return tail_bounds(events, "partition", "offset", max(1, limit // max(1, partitions)))

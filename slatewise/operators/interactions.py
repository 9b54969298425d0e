"""Events to user/movie interactions, histories and candidate pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt
from slatewise.functions.scalars import available, in_window, positive
from slatewise.operators.quality import reason_column
from slatewise.operators.ranks import ranked
from slatewise.session import settle

PAIR = ("user_id", "movie_id")


def interactions(events: DataFrame, sequence: Sequence[Column | str]) -> DataFrame:
    """One row per (user, movie): watches, newest rating, first and last time.

    A single hash aggregation with map-side combine, so a hot user or movie costs no more than a cold
    one. `sequence` orders events with equal times; the last one wins.
    """
    rated = F.col("event_type") == "rating"
    order = F.struct(F.col("timestamp"), *[F.col(c) if isinstance(c, str) else c for c in sequence])
    return (events.where(F.col("event_type").isin("watch", "rating")).groupBy(*PAIR).agg(
        F.count_if(F.col("event_type") == "watch").alias("watch_count"),
        F.max_by(F.when(rated, F.col("rating")), F.when(rated, order)).alias("rating"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp")))


def positives(pairs: DataFrame, min_rating: int = fmt.DEFAULT_POSITIVE_RATING) -> DataFrame:
    """(user, movie) pairs that count as liked."""
    return pairs.where(positive(F.col("rating"), F.col("watch_count"), min_rating)).select(*PAIR)


def popularity(pairs: DataFrame, min_rating: int = fmt.DEFAULT_POSITIVE_RATING) -> DataFrame:
    """(movie, likes, popularity): likes over all users with any interaction."""
    liked = positives(pairs, min_rating).groupBy("movie_id").agg(F.count(F.lit(1)).alias("likes"))
    users = pairs.agg(F.countDistinct("user_id").alias("users"))
    return (liked.crossJoin(F.broadcast(users))  # one row
            .select("movie_id", "likes", (F.col("likes") / F.col("users")).alias("popularity")))


def cold_start_users(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users without any watch or rating."""
    active = events.where(F.col("event_type").isin("watch", "rating")).select("user_id").distinct()
    return users.join(active, "user_id", "left_anti")


def dataset_counts(events: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """(measure, n): table sizes, events by type, cold-start users and those with a description."""
    count = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("n"))
    kinds = events.groupBy(F.concat(F.lit("events_"), F.col("event_type")).alias("measure")).agg(
        F.count(F.lit(1)).alias("n"))
    cold = cold_start_users(users, events).agg(
        F.count(F.lit(1)).alias("cold_start_users"),
        F.count_if(F.concat("self_description_likes", "self_description_dislikes").rlike(r"(?U)\S"))
        .alias("cold_start_with_description")).unpivot(
            [], ["cold_start_users", "cold_start_with_description"], "measure", "n")
    return (count(events, "events").unionByName(count(users, "users")).unionByName(count(movies, "movies"))
            .unionByName(kinds).unionByName(cold))


def active_users(events: DataFrame, n: int) -> DataFrame:
    """The n users with most events, lower id first among equals."""
    return (events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
            .orderBy(F.col("events").desc(), "user_id").limit(n))


def popular_catalogue(catalogue: DataFrame, prior: DataFrame, n: int) -> DataFrame:
    """Candidate pool fixed before looking at outcomes: top n by prior popularity, then by id."""
    known = prior.select("movie_id", F.col("popularity").alias("prior_popularity"))
    return (catalogue.join(known, "movie_id", "left")
            .withColumn("prior_popularity", F.coalesce("prior_popularity", F.lit(0.0)))
            .orderBy(F.col("prior_popularity").desc(), "movie_id").limit(n))


def recent_training_events(events: DataFrame, allowed_movies: DataFrame, start, end) -> DataFrame:
    """Parsed events with `drop_reason`: outside the window, not training material, unknown movie, invalid.

    The movie check is a left join against the candidate pool, which the caller bounds.
    """
    pool = allowed_movies.select("movie_id", F.lit(True).alias("_allowed")).distinct()
    known = events.join(pool, "movie_id", "left")
    stars = F.col("fields.rating")
    return known.withColumn("drop_reason", reason_column(
        ("timestamp_missing", F.col("event_ts").isNull() | F.col("ingested_at").isNull()),
        ("outside_window", ~in_window(F.col("event_ts"), start, end) | ~available(F.col("ingested_at"), end)),
        ("not_training_event", (F.col("parse_status") != "parsed") | ~F.coalesce(
            F.col("event_type").isin("watch", "rating"), F.lit(False))),
        ("outside_candidate_catalogue", F.col("_allowed").isNull()),
        ("invalid_rating", (F.col("event_type") == "rating")
         & ~F.coalesce(stars.between(fmt.MIN_RATING, fmt.MAX_RATING), F.lit(False))),
        ("invalid_user", ~F.coalesce(F.col("user_id") > 0, F.lit(False))),
    )).drop("_allowed")


def merge_history(static: DataFrame, live: DataFrame, min_rating: int = fmt.DEFAULT_POSITIVE_RATING,
                  source_id: str | None = None, topic: str | None = None) -> DataFrame:
    """(user, movie, liked) over both sources; every row counts as seen.

    Static: rating, watch_count. Live: watched, rating. A live rating beats everything, a static
    dislike beats a live watch, and any other watch or like counts. Live state is kept per source and topic: name
    them where it holds more than one, so that every pair comes out once.
    """
    for name, value in (("source_id", source_id), ("topic", topic)):
        live = live.where(F.col(name) == value) if value is not None else live
    old = static.select(*PAIR, positive(F.col("rating"), F.col("watch_count"), min_rating).alias("_was_liked"))
    new = live.select(*PAIR, F.col("watched").alias("_watched"), F.col("rating").alias("_live_rating"))
    merged = old.join(new, list(PAIR), "full_outer")
    liked = (F.when(F.col("_live_rating").isNotNull(), F.col("_live_rating") >= min_rating)
             .when(F.col("_was_liked").isNotNull(), F.col("_was_liked"))
             .otherwise(F.coalesce(F.col("_watched"), F.lit(False))))
    return merged.select(*PAIR, liked.alias("liked"))


def seen_pairs(*sources: DataFrame) -> DataFrame:
    """Distinct (user, movie) over static, live, title-match and excluded-genre sources."""
    first, *rest = [s.select(*PAIR) for s in sources]
    for other in rest:
        first = first.unionByName(other)
    return first.distinct()


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop candidates the user already watched or rated, whatever the rating."""
    return candidates.join(seen.select(*PAIR), list(PAIR), "left_anti")


def ladder(movies: DataFrame, *lead: Column, bucket: Column | None = None) -> DataFrame:
    """movies with a global `position`, ordered by the lead columns, popularity (high first) and id.

    One row per movie, stored, because walking it reads it several times.
    """
    order = [*lead, F.col("popularity").desc(), F.col("movie_id")]
    cut = F.struct(-F.col("popularity"), F.substring("movie_id", 1, 2)) if bucket is None else bucket
    return settle(ranked(settle(movies), [], order, cut, rank="position"))


def first_unseen(users: DataFrame, seen: DataFrame, steps: DataFrame, k: int) -> DataFrame:
    """The first k ladder positions each user has not seen: (user, movie, rank, ...ladder columns).

    No user × movie product. A user's seen positions leave gaps: the j-th seen position s has s - j
    unseen ones below it. Only gaps that start before the k-th unseen position are opened, so at most
    k rows per user are produced.
    """
    everyone = users.select("user_id").distinct()
    size = steps.agg(F.coalesce(F.max("position"), F.lit(0)).alias("ladder_size"))
    marks = seen.select(*PAIR).distinct().join(steps.select("movie_id", "position"), "movie_id")
    per_user = Window.partitionBy("user_id").orderBy("position")
    placed = marks.withColumn("_j", F.row_number().over(per_user))
    near = placed.where(F.col("position") - F.col("_j") < k)
    start = F.coalesce(F.lag("position").over(per_user), F.lit(0)) + 1
    closed = near.select("user_id", start.alias("lo"), (F.col("position") - 1).alias("hi"),
                         (start - F.col("_j")).alias("taken"))
    last = near.groupBy("user_id").agg(F.max("position").alias("_last"), F.count(F.lit(1)).alias("_seen"))
    open_end = (everyone.join(last, "user_id", "left").crossJoin(F.broadcast(size))  # one row
                .select("user_id", (F.coalesce("_last", F.lit(0)) + 1).alias("lo"), F.col("ladder_size").alias("hi"),
                        (F.coalesce("_last", F.lit(0)) - F.coalesce("_seen", F.lit(0))).alias("taken")))
    gaps = closed.join(everyone, "user_id", "left_semi").unionByName(open_end)
    top = F.least(F.col("hi"), F.col("lo") + (F.lit(k) - F.col("taken")) - 1)
    opened = gaps.where((F.col("taken") < k) & (top >= F.col("lo"))).select(
        "user_id", "taken", F.posexplode(F.sequence(F.col("lo"), top)).alias("_n", "position"))
    return (opened.withColumn("rank", (F.col("taken") + F.col("_n") + 1).cast("int"))
            .join(steps, "position").drop("taken", "_n", "position"))


def popular_unseen(users: DataFrame, seen: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """Top k popular movies each user has not seen: (user, movie, rank, popularity)."""
    steps = ladder(popular.where("popularity > 0").select("movie_id", "popularity"))
    return first_unseen(users, seen, steps, k).select("user_id", "movie_id", "rank", "popularity")


def user_timeline(records: DataFrame, user_id: int, order: Sequence[str], limit: int = 100) -> DataFrame:
    """One user's records in time order, 1..10,000 of them."""
    if not 1 <= limit <= 10_000:
        raise ValueError("The limit must be between 1 and 10000")
    return records.where(F.col("user_id") == user_id).orderBy(*order).limit(limit)

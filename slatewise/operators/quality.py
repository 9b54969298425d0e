"""Whole-table checks: violations, duplicates, conflicts and reasons for dropping rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt


class DataError(ValueError):
    """The data is missing, malformed or inconsistent."""


# Fixed value: the event kinds of the static history.
EVENT_TYPES = ("watch", "rating", "account_created")


def _tally(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass: (rule, n) with the number of rows breaking each rule."""
    counts = df.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n") if rules else counts


def repeated_keys(df: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, n): rows beyond the first of every repeated key."""
    copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    return copies.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))


def referential_check(child: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, n): child rows whose key is unknown to the parent, counted per key before the join."""
    used = child.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    lost = used.join(parent.select(key).distinct(), key, "left_anti")
    return lost.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def validate_dataset(events: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """(rule, n) for every rule of the static tables; all zero means the data set is sound."""
    about_movie = F.col("event_type").isin("watch", "rating")
    is_rating = F.col("event_type") == "rating"
    event_rules = {
        "event_timestamp_missing": F.col("timestamp").isNull(),
        "event_type_unknown": ~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)),
        "rating_out_of_range": is_rating & ~F.coalesce(
            F.col("rating").between(fmt.MIN_RATING, fmt.MAX_RATING), F.lit(False)),
        "rating_on_other_event": ~is_rating & F.col("rating").isNotNull(),
        "movie_on_account_event": ~about_movie & (F.coalesce(F.col("movie_id"), F.lit("")) != ""),
    }
    parts = [
        _tally(events, event_rules),
        _tally(users, {"user_not_positive": F.col("user_id") <= 0}),
        _tally(movies, {"movie_id_empty": F.coalesce(F.col("movie_id"), F.lit("")) == ""}),
        repeated_keys(users, "user_id", "user_repeated"),
        repeated_keys(movies, "movie_id", "movie_repeated"),
        referential_check(events, users, "user_id", "event_user_unknown"),
        referential_check(events.where(about_movie), movies, "movie_id", "event_movie_unknown"),
    ]
    return reduce(DataFrame.unionByName, [p.select("rule", F.col("n").cast("bigint").alias("n")) for p in parts])


def require_valid(violations: DataFrame) -> None:
    """Raise, naming the broken rules (a dozen rows at most)."""
    broken = [f"{row.rule}: {row.n}" for row in violations.where("n > 0").orderBy("rule").collect()]
    if broken:
        raise DataError("; ".join(broken))


def fingerprinted(df: DataFrame, columns: Sequence[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """Add a digest of the row contents."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256))


def dedup_or_conflict(df: DataFrame, keys: Sequence[str], fingerprint: str = "fingerprint") -> DataFrame:
    """One row per key: copies, exact duplicates beyond the first, and whether contents differ.

    Equal fingerprints have equal minimum and maximum, so two hot-key-safe aggregates decide it.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"),
        (F.min(fingerprint) != F.max(fingerprint)).alias("conflict"),
    ).withColumn("duplicates", F.when(~F.col("conflict"), F.col("copies") - 1).otherwise(0))


def first_copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without exact repeats of the key; conflicts must have been ruled out before."""
    return df.dropDuplicates(list(keys))


def reason_column(*reasons: tuple[str, Column]) -> Column:
    """First applicable reason for dropping the row; null keeps it."""
    return F.coalesce(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in reasons])


def tally(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """(reason, n) with the kept rows under `kept`."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias(reason)).agg(F.count(F.lit(1)).alias("n"))


def fresh(fetched_at: Column, now: Column, max_age_seconds: float) -> Column:
    """Younger than the limit and not from the future."""
    age = (F.unix_micros(now) - F.unix_micros(fetched_at)) / 1_000_000
    return F.coalesce((age >= 0) & (age < max_age_seconds), F.lit(False))

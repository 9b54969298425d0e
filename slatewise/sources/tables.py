"""Static tables: all-text CSV in, typed columns out, prepared Parquet back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions.parse import with_event_time
from slatewise.operators.interactions import dataset_counts
from slatewise.operators.quality import DataError

# Required columns of each table.
COLUMNS = {
    "events": ("timestamp", "user_id", "event_type", "movie_id", "rating"),
    "users": ("user_id", "self_description_likes", "self_description_dislikes"),
    "movies": ("movie_id", "title", "genres", "overview", "runtime", "license_cost"),
}
_NEVER = "\u0000"


def read_text_table(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV (gzip or not) with every column as text and blanks kept; extra columns are tolerated."""
    reader = spark.read.option("header", True).option("nullValue", _NEVER).option("emptyValue", "")
    reader = reader.option("multiLine", True).option("escape", '"')
    header = reader.option("inferSchema", False).csv(path).columns
    missing = sorted(set(required) - set(header))
    if missing:
        raise DataError(f"{path} is missing columns: {', '.join(missing)}")
    table = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    table = table.na.fill("")
    if table.isEmpty():
        raise DataError(f"{path} contains no rows")
    return table


def read_course_tables(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The untyped events, users and movies tables."""
    return tuple(read_text_table(spark, f"{directory}/{name}.csv.gz", COLUMNS[name]) for name in ("events", "users", "movies"))


def cast_checked(df: DataFrame, table: str, casts: dict) -> DataFrame:
    """Apply casts; a value that is present but does not convert is an error naming table and column."""
    staged = df.withColumns({f"_{c}": cast for c, cast in casts.items()})
    bad = staged.agg(*[F.count_if((F.col(c) != "") & F.col(c).isNotNull() & F.col(f"_{c}").isNull()).alias(c)
                       for c in casts]).first()
    wrong = [c for c in casts if bad[c]]
    if wrong:
        raise DataError(f"{table} has invalid values in column {', '.join(wrong)}")
    return staged.withColumns({c: F.col(f"_{c}") for c in casts}).drop(*[f"_{c}" for c in casts])


def typed_events(events: DataFrame) -> DataFrame:
    """user_id BIGINT, timestamp UTC (naive means UTC), rating nullable INT."""
    timed = with_event_time(events, "timestamp", "UTC").drop("timestamp_status", "time_error")
    return cast_checked(timed, "events", {
        "user_id": F.col("user_id").try_cast("bigint"), "timestamp": F.col("event_ts"),
        "rating": F.nullif("rating", F.lit("")).try_cast("int")}).drop("event_ts")


def typed_users(users: DataFrame) -> DataFrame:
    return cast_checked(users, "users", {"user_id": F.col("user_id").try_cast("bigint")})


def write_prepared(interactions: DataFrame, cold_start: DataFrame, events: DataFrame, users: DataFrame,
                   movies: DataFrame, path: str) -> DataFrame:
    """Save the prepared tables and return the table counts."""
    interactions.write.mode("errorifexists").parquet(f"{path}/interactions")
    cold_start.write.mode("errorifexists").parquet(f"{path}/cold_start_users")
    return dataset_counts(events, users, movies)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip or not, with a declared schema; malformed lines fail the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").option("ignoreNullFields", False).mode("errorifexists").json(path)

"""Which code, model and data produced a response, and whether the audit records fit together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions.scalars import content_version

REVISION = r"^[0-9a-f]{40}\z"
PROFILE_ORIGINS = ("llm", "legacy_cache")


def trace_lineage(requests: DataFrame, serving: DataFrame, training: DataFrame, files: DataFrame) -> DataFrame:
    """Request → serving version → model → training files, with checks and the first reason against it.

    requests: (request_id, status, serving_version, model_version); serving: (serving_version,
    model_version, training_id); training: (training_id, dataset_version, revision, actual_version);
    files: (training_id, name, expected, actual). Version tables are per release, so Spark broadcasts
    them by size.
    """
    checks = files.groupBy("training_id").agg(
        F.every(F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))).alias("files_verified"),
        F.count(F.lit(1)).alias("files"))
    sources = training.join(checks, "training_id", "left")
    joined = (requests.join(serving.withColumnRenamed("model_version", "_served_model"), "serving_version", "left")
              .join(sources, "training_id", "left"))
    dataset = F.coalesce(F.col("files_verified") & (F.col("dataset_version") == F.col("actual_version")), F.lit(False))
    revision = F.coalesce(F.col("revision").rlike(REVISION), F.lit(False))
    reason = (F.when(~F.col("status").eqNullSafe(F.lit(200)), "request_not_successful")
              .when(F.col("_served_model").isNull(), "serving_version_unknown")
              .when(F.col("_served_model") != F.col("model_version"), "model_differs_from_serving_version")
              .when(F.col("dataset_version").isNull(), "training_set_unknown")
              .when(~dataset, "training_files_changed").when(~revision, "revision_not_recorded"))
    return joined.select("request_id", "serving_version", "model_version", "training_id", "dataset_version",
                         dataset.alias("dataset_verified"), revision.alias("revision_recorded"),
                         reason.alias("reason"), reason.isNull().alias("lineage_verified"))


def dataset_version(files: DataFrame) -> DataFrame:
    """(training_id, version): digest over the names and digests of its files, in name order."""
    listed = F.array_sort(F.collect_list(F.concat_ws("=", "name", "actual")))  # a handful of files
    return files.groupBy("training_id").agg(
        F.concat(F.lit("sha256:"), F.sha2(F.array_join(listed, ";"), 256)).alias("version"))


def profile_versions(profiles: DataFrame, fields: list[str]) -> DataFrame:
    """Profiles with `expected_version` recomputed from their contents."""
    return profiles.withColumn("expected_version", content_version({f: F.col(f"profile.{f}") for f in fields}))


def profile_integrity(uses: DataFrame, profiles: DataFrame, attempts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(rule, n) over audit tables; every join is on a record id.

    uses: use_id, profile_id, used_at, user_id, source_snapshot_id; profiles: profile_id, cache_key,
    created_at, attempt_id, origin, content_version, expected_version; attempts: attempt_id, cache_key,
    status, started_at, finished_at; snapshots: snapshot_id, entity_type, entity_id.
    """
    made = profiles.select("profile_id", "created_at")
    tried = attempts.select("attempt_id", F.col("cache_key").alias("_key"), F.col("status").alias("_status"))
    shot = snapshots.select(F.col("snapshot_id").alias("source_snapshot_id"), "entity_type", "entity_id")
    generated = profiles.where("origin = 'llm'").join(tried, "attempt_id", "left")
    final = attempts.where(F.col("status").isin("success", "failed")).dropDuplicates()
    owned = (F.col("entity_type") == "user") & (F.col("entity_id") == F.col("user_id").cast("string"))
    finished = F.col("status").isin("success", "failed")
    cases = {
        "use_without_profile": uses.join(made, "profile_id", "left_anti"),
        "use_before_profile": uses.join(made, "profile_id").where(F.col("used_at") < F.col("created_at")),
        "snapshot_of_other_user": uses.where("source_snapshot_id is not null").join(shot, "source_snapshot_id", "left").where(
            ~F.coalesce(owned, F.lit(False))),
        "generated_without_success": generated.where(~F.coalesce(
            (F.col("_status") == "success") & (F.col("_key") == F.col("cache_key")), F.lit(False))),
        "legacy_with_attempt": profiles.where("origin = 'legacy_cache' and attempt_id is not null"),
        "unknown_origin": profiles.where(~F.coalesce(F.col("origin").isin(*PROFILE_ORIGINS), F.lit(False))),
        "version_differs": profiles.where(~F.col("content_version").eqNullSafe(F.col("expected_version"))),
        "finished_before_start": attempts.where(finished & ~F.coalesce(F.col("finished_at") >= F.col("started_at"), F.lit(False))),
        "finished_attempt_changed": final.groupBy("attempt_id").count().where("count > 1"),
    }
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n")) for rule, df in cases.items()])

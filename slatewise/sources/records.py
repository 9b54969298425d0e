"""Audit records: request log, fees, metadata snapshots, exports and manifests."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.redact import redact
from slatewise.functions.scalars import (available, canonical_json, content_version, in_window, normalize_movie_id,
                                         normalize_user_id)
from slatewise.operators.cost import MONEY
from slatewise.operators.quality import DataError, dedup_or_conflict, fingerprinted, reason_column

SCHEMA_VERSION = 1
FETCH_STATES = ("success", "partial", "failed")


# --- fees --------------------------------------------------------------------------------------------

def typed_fees(rows: DataFrame, column: str = "license_cost") -> DataFrame:
    """(movie_id, fee, fee_status): blank is missing; text, negative, NaN and infinite are invalid."""
    raw = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    fee = F.when(raw.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), raw.try_cast(MONEY))
    status = F.when(raw == "", "missing").when(fee.isNull() | (fee < 0), "invalid").otherwise("known")
    return rows.select("movie_id", F.when(status == "known", fee).alias("fee"), status.alias("fee_status"))


def load_fees(rows: DataFrame, column: str = "license_cost") -> DataFrame:
    """Typed fees of a text table, refusing empty or repeated ids."""
    bad = rows.groupBy("movie_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or coalesce(movie_id, '') = ''")
    if bad.limit(1).count():
        raise DataError("Catalog movie IDs must be nonempty and unique")
    return typed_fees(rows, column)


# --- request log -----------------------------------------------------------------------------------

def prepare_request_log(requests: DataFrame, text: list[str], json: list[str] = ()) -> DataFrame:
    """Requests with schema version, redacted columns and `problem` (null when acceptable)."""
    problem = reason_column(
        ("request_id_missing", ~F.coalesce(F.col("request_id").rlike(r"(?U)\S"), F.lit(False))),
        ("started_at_missing", F.col("started_at").isNull()),
        ("user_not_positive", F.col("user_id") <= 0))
    safe = redact(requests, text, json)
    return safe.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "problem": problem})


def request_log_conflicts(prepared: DataFrame) -> DataFrame:
    """(request_id, copies, duplicates, conflict) of acceptable requests."""
    return dedup_or_conflict(fingerprinted(prepared.where("problem is null")), ["request_id"])


# --- metadata snapshots ------------------------------------------------------------------------------

def snapshot_violations(fetches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(id, problem) of fetches and snapshots that break a rule.

    fetches: fetch_id, source_id, entity_type, requested_ids, started_at, finished_at, status,
    http_status, error_type; snapshots: snapshot_id, fetch_id, source_id, entity_type, entity_id,
    fetched_at.
    """
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))
    own = fetches.select(F.col("fetch_id").alias("id"), reason_column(
        ("identifier_missing", blank("fetch_id") | blank("source_id")),
        ("entity_type_invalid", ~F.coalesce(F.col("entity_type").isin("user", "movie"), F.lit(False))),
        ("finished_before_start", ~F.coalesce(F.col("finished_at") >= F.col("started_at"), F.lit(False))),
        ("status_invalid", ~F.coalesce(F.col("status").isin(*FETCH_STATES), F.lit(False))),
        ("http_status_invalid", ~F.col("http_status").between(100, 599)),
        ("error_type_unsafe", ~F.col("error_type").rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"))).alias("problem"))
    parent = fetches.select("fetch_id", F.col("source_id").alias("_source"), F.col("entity_type").alias("_kind"),
                            "requested_ids", "started_at", "finished_at", F.col("status").alias("_status"))
    entity = entity_id(F.col("entity_type"), F.col("entity_id"))
    joined = snapshots.join(parent, "fetch_id", "left").withColumn("_entity", entity)
    child = joined.select(F.col("snapshot_id").alias("id"), reason_column(
        ("fetch_unknown", F.col("_status").isNull()),
        ("failed_fetch_has_snapshot", F.col("_status") == "failed"),
        ("source_or_kind_differs", (F.col("source_id") != F.col("_source")) | (F.col("entity_type") != F.col("_kind"))),
        ("entity_not_requested", ~F.coalesce(F.array_contains(
            F.transform("requested_ids", lambda v: entity_id(F.col("entity_type"), v)), F.col("_entity")), F.lit(False))),
        ("fetched_outside_fetch", ~F.coalesce(F.col("fetched_at").between(F.col("started_at"), F.col("finished_at")), F.lit(False))),
    ).alias("problem"))
    return own.unionByName(child).where("problem is not null")


def entity_id(kind: Column, value: Column) -> Column:
    return F.when(kind == "user", normalize_user_id(value)).when(kind == "movie", normalize_movie_id(value))


def stamp_snapshots(snapshots: DataFrame, record_fields: list[str]) -> DataFrame:
    """Add the content version of the `record` struct and a fingerprint of the whole snapshot."""
    stamped = snapshots.withColumn("content_version", content_version({f: F.col(f"record.{f}") for f in record_fields}))
    return stamped.withColumn("fingerprint", F.sha2(canonical_json({c: F.col(c) for c in stamped.columns}), 256))


def latest_snapshot_as_of(snapshots: DataFrame, as_of=None, keys: tuple[str, ...] = ("source_id", "entity_type", "entity_id")) -> DataFrame:
    """Newest snapshot of each entity at or before the cut-off, ties by snapshot id; a hash aggregation."""
    rest = [c for c in snapshots.columns if c not in keys]
    known = snapshots.where(available(F.col("fetched_at"), as_of))
    newest = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("fetched_at", "snapshot_id")).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def snapshot_for_each(requests: DataFrame, snapshots: DataFrame, key: str, at: str,
                      bucket_seconds: int = 86_400) -> DataFrame:
    """Every request row with `snapshot`: the newest one of its entity at or before its own time.

    Per-row as-of join. Inside one time bucket requests and snapshots are sorted together; the newest
    snapshot of earlier buckets is carried forward over one row per entity and bucket.
    """
    record = F.struct("fetched_at", "snapshot_id", *[c for c in snapshots.columns if c not in (key, "fetched_at", "snapshot_id")])
    row_type = requests.select(F.struct("*").alias("r")).schema["r"].dataType
    snap_type = snapshots.select(record.alias("s")).schema["s"].dataType
    left = requests.select(F.col(key).alias("_key"), F.col(at).alias("_time"), F.lit(1).alias("_kind"),
                           F.struct("*").alias("_row"), F.lit(None).cast(snap_type).alias("_snap"))
    right = snapshots.select(F.col(key).alias("_key"), F.col("fetched_at").alias("_time"), F.lit(0).alias("_kind"),
                             F.lit(None).cast(row_type).alias("_row"), record.alias("_snap"))
    both = left.unionByName(right).withColumn("_bucket", F.expr(f"unix_micros(_time) div {bucket_seconds * 1_000_000}"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_time", "_kind", "_snap.snapshot_id")
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("_key", "_bucket").agg(F.max("_snap").alias("_newest")).select(
        "_key", "_bucket", F.last("_newest", ignorenulls=True).over(earlier).alias("_carried"))
    local = both.withColumn("_local", F.last("_snap", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = local.where("_kind = 1").join(carried, ["_key", "_bucket"])
    return found.select("_row.*", F.coalesce("_local", "_carried").alias("snapshot"))


# --- export and manifest -----------------------------------------------------------------------------

# Fixed values: (event time, availability time) of each stored table.
ROW_TIMES = {
    "recommendation_requests": ("started_at", "finished_at"),
    "kafka_events": ("coalesce(event_ts, ingested_at)", "ingested_at"),
    "metadata_fetches": ("started_at", "finished_at"),
    "metadata_snapshots": ("fetched_at", "fetched_at"),
    "llm_attempts": ("started_at", "if(status = 'pending', started_at, coalesce(finished_at, updated_at))"),
    "preference_profiles": ("created_at", "created_at"),
    "profile_uses": ("used_at", "used_at"),
}


def _instant(value) -> datetime:
    """A window bound as an instant; without a zone it is UTC."""
    moment = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    return moment if moment.tzinfo else moment.replace(tzinfo=UTC)


def export_rows(table: str, df: DataFrame, source_id=None, topic=None, start=None, end=None, as_of=None) -> DataFrame:
    """Rows of one stored table inside the event window and known by the as-of time, bytes as base64."""
    if start is not None and end is not None and _instant(start) >= _instant(end):
        raise ValueError("The window is empty: it starts at or after its end")
    event_time, known_at = (F.expr(e) for e in ROW_TIMES[table])
    rows = df.where(in_window(event_time, start, end) & available(known_at, as_of))
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id) if "source_id" in df.columns else rows.where(F.lit(False))
    if topic is not None:
        rows = rows.where(F.col("topic") == topic) if table == "kafka_events" else rows.where(F.lit(False))
    encoded = [F.base64(f.name).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f.name) for f in df.schema]
    return rows.select(*encoded)


def export_records(tables: dict[str, DataFrame], path: str, **filters) -> DataFrame:
    """Write every selected table as gzip JSON lines below `path`; (table, n) counts come back."""
    counts = []
    for name, df in tables.items():
        rows = export_rows(name, df, **filters)
        rows.write.option("compression", "gzip").mode("errorifexists").json(f"{path}/{name}")
        counts.append(rows.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, counts)


def row_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): independent of row order and partitioning, sensitive to every value."""
    line = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    head = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(head.alias("_h")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_h"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


def snapshot_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, digest) of a data set."""
    return reduce(DataFrame.unionByName, [
        row_digest(df).select(F.lit(name).alias("table"), "rows", "digest") for name, df in sorted(tables.items())])


def manifest_version(manifest: DataFrame) -> DataFrame:
    """One version for the whole data set, from its table digests (one row per table)."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "table", "rows", "digest")))
    return manifest.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(lines, "|"), 256)).alias("version"))


def manifest_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables that are missing, extra or different."""
    both = expected.select("table", F.struct("rows", "digest").alias("e")).join(
        actual.select("table", F.struct("rows", "digest").alias("a")), "table", "full_outer")
    return both.where(~F.col("e").eqNullSafe(F.col("a"))).select("table")


def require_manifest(expected: DataFrame, actual: DataFrame) -> None:
    wrong = [r.table for r in manifest_mismatches(expected, actual).orderBy("table").collect()]
    if wrong:
        raise DataError(f"Data does not match its manifest: {', '.join(wrong)}")


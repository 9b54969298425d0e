"""Small column expressions shared by the operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions import formats as fmt

_KEEP_NULLS = {"ignoreNullFields": "false"}


# --- identifiers and hashes -------------------------------------------------------------------

def normalize_user_id(value: Column) -> Column:
    """Digits without leading zeros, within 1 .. 2^63-1, as text; anything else is null."""
    digits = F.regexp_replace(value, r"^0+(?=[0-9])", "")
    fits = F.when(value.rlike(r"^[0-9]+\z") & (F.length(digits) <= fmt.MAX_ID_DIGITS), digits).try_cast("bigint")
    return F.when(fits > 0, fits.cast("string"))


def normalize_movie_id(value: Column) -> Column:
    """A nonblank id is kept as it is."""
    return F.when(value.rlike(r"(?U)\S"), value)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in name order and explicit nulls."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), _KEEP_NULLS)


def content_version(fields: dict[str, Column]) -> Column:
    """`sha256:` and the digest of the canonical JSON of the given fields."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(fields), 256))


def source_fingerprint(key: Column, value: Column, headers: Column, broker_ms: Column, broker_type: Column) -> Column:
    """Stable digest of a source record, independent of when it was ingested."""
    pairs = F.transform(headers, lambda h: F.array(h["key"], F.base64(h["value"])))
    return F.sha2(canonical_json({
        "key": F.base64(key), "value": F.base64(value), "headers": pairs,
        "broker_timestamp_ms": broker_ms, "broker_timestamp_type": broker_type}), 256)


def ranking_key(ids: Column) -> Column:
    """Digest of an ordered list of ids."""
    return F.sha2(F.to_json(ids), 256)


def assignment_bucket(salt: str, user_id: Column) -> Column:
    """First 8 bytes of sha256("salt:user") modulo 10,000."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), user_id.cast("string")), 256)
    head = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % fmt.ASSIGNMENT_BUCKETS).cast("int")


def assigned_arm(salt: str, user_id: Column, treatment_percent: int) -> Column:
    return F.when(assignment_bucket(salt, user_id) < treatment_percent * 100, "treatment").otherwise("control")


def hostname(server: Column) -> Column:
    """Lower-case host, with or without scheme, credentials and port."""
    return F.lower(F.regexp_extract(server, r"^(?:[^/?#]*://|//)?(?:[^/?#@]*@)?\[?([^:/?#\]]*)", 1))


# --- time ----------------------------------------------------------------------------------------

def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def watch_order(event_ts: Column, broker_ms: Column, partition: Column, offset: Column) -> Column:
    """Comparable order of watch records: dated before undated, then time, partition, offset."""
    stamp = F.coalesce(event_ts, F.timestamp_millis(broker_ms))
    return F.struct(stamp.isNotNull().alias("dated"), stamp.alias("stamp"),
                    partition.alias("partition"), offset.alias("offset"))


def retention_day(ingested_at: Column, event_ts: Column, broker_ms: Column) -> Column:
    """UTC day of the latest of ingestion, event and broker time; unknown ingestion never expires."""
    latest = F.greatest(ingested_at, event_ts, F.timestamp_millis(broker_ms))
    return F.when(ingested_at.isNull(), fmt.UNKNOWN_DAY).otherwise(F.date_format(latest, "yyyy-MM-dd"))


def in_window(ts: Column, start=None, end=None) -> Column:
    """Half-open event window; an unknown time is outside any bounded window."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        inside = inside & (ts < F.lit(end).cast("timestamp"))
    return F.coalesce(inside, F.lit(False))


def available(ts: Column, as_of=None) -> Column:
    """Known no later than the as-of time."""
    if as_of is None:
        return F.lit(True)
    return F.coalesce(ts <= F.lit(as_of).cast("timestamp"), F.lit(False))


# --- slates and ratings ----------------------------------------------------------------------------

def valid_slate(items: Column, size: int = fmt.SLATE_SIZE) -> Column:
    """First `size` ids by rank when ranks are exactly 1..n, ids nonempty and n >= size; else null."""
    count = F.size(items)
    ordered = F.array_sort(F.transform(items, lambda i: F.struct(i["rank"].alias("rank"), i["movie_id"].alias("movie_id"))))
    good = (count >= size) & slate_is_sound(items)
    return F.when(good, F.transform(F.slice(ordered, 1, size), lambda i: i["movie_id"]))


def slate_is_sound(items: Column) -> Column:
    """Ranks are exactly 1..n and every id is nonempty."""
    ranks = F.array_sort(F.transform(items, lambda i: i["rank"]))
    complete = F.when(F.size(items) == 0, True).otherwise(ranks == F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))))
    return F.coalesce(complete & F.forall(items, lambda i: F.coalesce(i["movie_id"] != "", F.lit(False))), F.lit(False))


def valid_response_body(body: Column) -> Column:
    """A comma list of 1..20 distinct, nonempty ids without white space."""
    ids = F.split(body, ",")
    good = ((F.size(ids) <= fmt.SLATE_SIZE) & (F.size(F.array_distinct(ids)) == F.size(ids))
            & F.forall(ids, lambda i: i.rlike(r"(?U)^\S+\z")))
    return F.coalesce(good, F.lit(False))


def positive(rating: Column, watch_count: Column, min_rating: int = fmt.DEFAULT_POSITIVE_RATING) -> Column:
    """A good rating, or a watch without rating; a rating always overrides the watch."""
    return F.when(rating.isNotNull(), rating >= min_rating).otherwise(F.coalesce(watch_count > 0, F.lit(False)))


# --- text ----------------------------------------------------------------------------------------

def normalize_description(text: Column) -> Column:
    """Collapse white space, cut at 2000 characters, trim."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.trim(F.substring(flat, 1, fmt.MAX_DESCRIPTION))


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is left outside ASCII; one text at a time, so that a batch is held once and not once a step."""
    return text.map(_folded, na_action="ignore")


def _folded(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


def normalize_title(title: Column) -> Column:
    """Title without a trailing year, accents, leading article, case and punctuation."""
    untagged = F.regexp_replace(title, r"(?U)\s*\(\d{4}\)\s*\z", "")
    plain = fold_accents(F.replace(untagged, F.lit("¢"), F.lit("c")))
    bare = F.regexp_replace(F.lower(plain), r"^\s+|\s+\z", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(the|an|a)\s+", ""), r"[^a-z0-9]", "")


def profile_from_answers(answers: Column, likes: Column, dislikes: Column) -> Column:
    """Per-genre like / avoid / none answers to a preference profile; an exclusion beats a like."""
    chosen = lambda choice: F.transform(F.filter(answers, lambda a: a["choice"] == choice), lambda a: a["name"])
    blank = F.array().cast("array<string>")
    return F.struct(
        F.array_except(chosen("like"), chosen("avoid")).alias("liked_genres"),
        chosen("avoid").alias("excluded_genres"),
        blank.alias("liked_titles"), blank.alias("disliked_titles"),
        likes.alias("likes_summary"), dislikes.alias("dislikes_summary"))


def profile_error(profile: Column, genres: Sequence[str]) -> Column:
    """First problem of a preference profile, or null: blank entries, unknown genres, no summaries."""
    lists = ("liked_genres", "excluded_genres", "liked_titles", "disliked_titles")
    nonblank = lambda items: F.coalesce(F.forall(items, lambda v: F.coalesce(v.rlike(r"(?U)\S"), F.lit(False))), F.lit(False))
    known = F.array(*[F.lit(g) for g in genres])
    checks = [F.when(profile.isNull(), "invalid_profile")]
    checks += [F.when(~nonblank(profile[name]), f"invalid_{name}") for name in lists]
    checks += [F.when(F.size(F.array_except(profile[name], known)) > 0, f"unknown_{name}") for name in lists[:2]]
    checks += [F.when(profile[name].isNull(), f"invalid_{name}") for name in ("likes_summary", "dislikes_summary")]
    return F.coalesce(*checks)


# --- measures ------------------------------------------------------------------------------------

def band(value: Column, boundaries: Sequence[float]) -> Column:
    """How many boundaries the value reaches, as text; `missing` when unknown."""
    reached = sum(((value >= b).cast("int") for b in boundaries), F.lit(0))
    return F.when(value.isNull(), "missing").otherwise(reached.cast("string"))


def ratio(part: Column, whole: Column) -> Column:
    """Share that is null, not zero, when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))

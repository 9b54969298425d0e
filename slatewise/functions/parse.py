"""Raw log lines to typed event columns, entirely as built-in expressions."""

from __future__ import annotations

import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt

PARSED_COLUMNS = ("parse_status", "error_type", "event_type", "event_ts", "event_time_raw", "timestamp_status",
                  "user_id", "user_id_raw", "movie_id", "fields")

# Whole ISO-8601 date with optional time, fraction and offset; separators may be left out.
_ISO = (r"^[0-9]{4}(?<!0000)-?[0-9]{2}-?[0-9]{2}(?:\D(?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?"
        r"(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9])?)?)?)?\z")
_HAS_ZONE = r"T[^TZ+-]*[Z+-]"
_FOLDS = ("30 minutes", "1 hour", "2 hours")


# Fixed value: every Unicode white-space character.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
               "\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def split_envelope(value: Column) -> Column:
    """Bytes to struct(error, text, time_raw, user_raw, body); three comma-separated parts."""
    text = value.cast("string")
    parts = F.split(text, ",", 3)
    error = (F.when(value.isNull(), "Tombstone")
             .when(~F.is_valid_utf8(text), "UnicodeDecodeError")
             .when(F.size(parts) != 3, "InvalidEnvelope"))
    part = lambda n: F.when(error.isNull(), strip(F.get(parts, F.lit(n))))
    return F.struct(
        error.alias("error"),
        F.when(error.isNull() | (error == "InvalidEnvelope"), text).alias("text"),
        part(0).alias("time_raw"), part(1).alias("user_raw"), part(2).alias("body"),
    )


def user_id_from_text(raw: Column) -> Column:
    """Decimal digits to a positive 64-bit id; anything else is null."""
    digits = F.regexp_replace(raw, r"^0+(?=[0-9])", "")
    number = F.when(raw.rlike(r"^[0-9]+\z") & (F.length(digits) <= fmt.MAX_ID_DIGITS), digits)
    parsed = number.try_cast("bigint")
    return F.when(parsed > 0, parsed)


def canonical_time(text: Column) -> Column:
    """Any accepted ISO spelling to `YYYY-MM-DDTHH:MM[:SS[.f]][zone]`; null when it is not ISO."""
    dated = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})", "$1-$2-$3")
    spaced = F.regexp_replace(dated, r"^(.{10})\D([0-9]{2})", "$1T$2")
    minutes = F.regexp_replace(spaced, r"^(.{10}T[0-9]{2}):?([0-9]{2}):?([0-9]{2})", "$1:$2:$3")
    minutes = F.regexp_replace(minutes, r"^(.{10}T[0-9]{2})([0-9]{2})(?=\z|[Z+-])", "$1:$2")
    hours = F.regexp_replace(minutes, r"^(.{10}T[0-9]{2})(?=\z|[Z+-])", "$1:00")
    return F.when(text.rlike(_ISO), F.translate(hours, ",", "."))


def with_event_time(df: DataFrame, text: str, default_zone: str | None = None) -> DataFrame:
    """Add event_ts, timestamp_status and time_error, parsed from an ISO text column.

    Naive times need `default_zone`; in a region, a local time inside a clock gap is invalid and one
    inside an overlap is ambiguous. Done in steps so that each pattern is matched once per row.
    """
    raw, canon, local, utc = F.col(text), F.col("_canon"), F.col("_local"), F.col("_utc")
    read = (df.withColumn("_canon", canonical_time(raw))
            .withColumns({"_zoned": canon.rlike(_HAS_ZONE), "_local": canon.try_cast("timestamp_ntz")})
            .withColumn("_utc", _naive_utc(local, default_zone)))
    ts = F.when(F.col("_zoned"), canon.try_cast("timestamp")).otherwise(utc.cast("timestamp"))
    found = read.withColumn("_ts", ts)
    error = (F.when(raw.isNull() | (raw == ""), "MissingTimestamp")
             .when(local.isNull() | (F.col("_zoned") & F.col("_ts").isNull()), "InvalidTimestamp")
             .when(~F.col("_zoned"), _naive_error(local, utc, default_zone)))
    judged = found.withColumn("time_error", error)
    return judged.withColumns({
        "event_ts": F.when(F.col("time_error").isNull(), F.col("_ts")),
        "timestamp_status": F.when(F.col("time_error") == "MissingTimestamp", "missing")
        .when(F.col("time_error").isNotNull(), "invalid")
        .when(~F.col("_zoned") & F.lit(default_zone is None), "timezone_missing").otherwise("utc"),
    }).drop("_canon", "_zoned", "_local", "_utc", "_ts")


def _region(zone: str | None) -> str | None:
    """The zone in a spelling Spark accepts, or None when there is no such zone."""
    offset = re.fullmatch(r"[+-]([0-9]{2}):?([0-9]{2})", zone)
    if offset:
        return f"{zone[:3]}:{zone[-2:]}" if int(offset[1]) <= 23 and int(offset[2]) <= 59 else None
    try:
        ZoneInfo(zone)
    except (ValueError, OSError, KeyError):
        return None
    return zone


def _naive_utc(local: Column, zone: str | None) -> Column:
    if zone is None or _region("UTC" if zone.upper() == "Z" else zone) is None:
        return F.lit(None).cast("timestamp_ntz")
    if zone.upper() in ("UTC", "Z"):
        return local
    return F.convert_timezone(F.lit(_region(zone)), F.lit("UTC"), local)


def _naive_error(local: Column, utc: Column, zone: str | None) -> Column:
    if zone is None or zone.upper() in ("UTC", "Z"):
        return F.lit(None).cast("string")
    if _region(zone) is None:
        return F.lit("InvalidTimezone")
    shown = lambda instant: F.convert_timezone(F.lit("UTC"), F.lit(_region(zone)), instant)
    repeated = F.lit(False)
    for fold in _FOLDS:
        step = F.expr(f"interval '{fold}'")
        repeated = repeated | (shown(utc + step) == local) | (shown(utc - step) == local)
    return F.when(shown(utc) != local, "InvalidTimestamp").when(repeated, "AmbiguousTimestamp")


def response_ms(text: Column) -> Column:
    """`12.5 ms`, `0.1s`, `1500 us`, ... to milliseconds; a number without unit stays null."""
    pattern = "(?i)" + fmt.DURATION
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    factor = (F.when(unit.isin("s", "second", "seconds"), 1000.0)
              .when(unit.isin("us", "µs", "microsecond", "microseconds"), 0.001).otherwise(1.0))
    return F.when(text.rlike(pattern), number * factor)


def ranked(ids: Column) -> Column:
    """Ordered ids to [(movie_id, rank)], ranks from 1, repeats kept."""
    return F.transform(ids, lambda item, n: F.struct(item.alias("movie_id"), (n + 1).cast("int").alias("rank")))


# Literals as a list of them may hold: strings within a line, numbers without leading zeros, and the three names.
_QUOTED = r"""'(?:[^'\\\n]++|\\[\s\S])*+'|"(?:[^"\\\n]++|\\[\s\S])*+\""""
_DIGITS = "[0-9](?:_?[0-9])*+"
_NUMBER = rf"[+-]?(?:0[xX](?:_?[0-9a-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS}|{_DIGITS}(?=[eEjJ]))(?:[eE][+-]?{_DIGITS})?[jJ]?|0(?:_?0)*+|[1-9](?:_?[0-9])*+)"
_STRING = rf"[uU]?(?:{_QUOTED})"
_ATOM = rf"(?:[bBrRuU]{{0,2}}(?:{_QUOTED})|{_NUMBER}|None|True|False)"
_QUOTED_LIST = rf"^\[\s*(?:{_STRING}\s*(?:,\s*{_STRING}\s*)*+,?\s*)?\]\z"
_LITERAL_LIST = rf"^\[\s*(?:{_ATOM}\s*(?:,\s*{_ATOM}\s*)*+,?\s*)?\]\z"
_STRETCH = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|[\s\S])|[^\\]+"
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "'": "'", '"': '"', "\\": "\\", "\n": ""}


def _unescape(item: Column) -> Column:
    """The string that a quoted literal stands for: escapes by kind, an unknown one stays as it is."""
    sign = lambda number: F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")

    def stretch(part: Column) -> Column:
        rest = F.substring(part, F.lit(2), F.length(part))
        coded, octal = part.rlike(r"^\\[xuU]."), part.rlike(r"^\\[0-7]")
        plain = F.when(~part.startswith("\\"), part)
        for name, value in _SHORT.items():
            plain = plain.when(rest == name, value)
        return plain.when(coded, sign(F.substring(rest, F.lit(2), F.length(rest)))).when(octal, sign(F.conv(rest, 8, 16))).otherwise(part)

    inner = F.substring(item, F.lit(2), F.length(item) - 2)
    return F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(f"({_STRETCH})"), 1), stretch), "")


def parse_slate(text: Column) -> Column:
    """`a,b`, `[a,b]` or a quoted list to struct(items, error); one bad id spoils the slate.

    A bracketed text that reads as a list of literals has to hold strings alone; any other bracketed text is a plain list.
    """
    quoted = text.rlike(_QUOTED_LIST)
    literal = F.transform(F.regexp_extract_all(text, F.lit(f"({_QUOTED})"), 1), _unescape)
    bare = F.when(text.startswith("[") & text.endswith("]") & (F.length(text) >= 2),
                  strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    listed = F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(bare, ","), strip))
    ids = F.when(quoted, literal).otherwise(listed)
    bad = (text.rlike(_LITERAL_LIST) & ~quoted) | ~F.forall(ids, lambda item: item.rlike(fmt.MOVIE_ID))
    return F.struct(F.when(~bad, ranked(ids)).alias("items"),
                    F.when(bad, "InvalidRecommendationResult").alias("error"))


def query_map(url: Column) -> Column:
    """Query string to name → values; repeated names keep their order, blank values stay."""
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    pieces = F.filter(F.split(query, "&"), lambda piece: piece != "")
    decode = lambda value: F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))
    pairs = F.transform(pieces, lambda piece: F.struct(
        decode(F.substring_index(piece, "=", 1)).alias("name"),
        decode(F.regexp_extract(piece, "=(.*)$", 1)).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda pair: pair["name"]))
    grouped = F.map_from_entries(F.transform(names, lambda name: F.struct(
        name, F.transform(F.filter(pairs, lambda pair: pair["name"] == name), lambda pair: pair["value"]))))
    return F.when(F.size(pieces) > 0, grouped)


def with_body(df: DataFrame, body: str = "body") -> DataFrame:
    """Add event_type, movie_id, body_error and fields, parsed from one request body column.

    Done in steps so that each pattern is matched once per row.
    """
    text, column = F.col(body), F.col
    kinds = df.withColumns({
        "_watch": text.rlike(fmt.WATCH_BODY), "_rating": text.rlike(fmt.RATING_BODY),
        "_slate": text.rlike(fmt.RECOMMENDATION_BODY)})
    pieces = kinds.withColumns({
        "event_type": F.when(column("_watch") | text.startswith(fmt.WATCH_PREFIX), "watch")
        .when(column("_rating") | text.startswith(fmt.RATING_PREFIX), "rating")
        .when(text == fmt.SIGNUP_BODY, "account_created")
        .when(column("_slate") | text.startswith(fmt.RECOMMENDATION_PREFIX), "recommendation"),
        "movie_id": F.when(column("_watch"), F.regexp_extract(text, fmt.WATCH_BODY, 1))
        .when(column("_rating"), F.regexp_extract(text, fmt.RATING_BODY, 1)),
        "_minute": F.when(column("_watch"), F.regexp_extract(text, fmt.WATCH_BODY, 2).try_cast("bigint")),
        "_stars": F.when(column("_rating"), F.regexp_extract(text, fmt.RATING_BODY, 2).try_cast("bigint")),
        "_server": F.when(column("_slate"), strip(F.regexp_extract(text, fmt.RECOMMENDATION_BODY, 1))),
        "_status": F.when(column("_slate"), F.regexp_extract(text, fmt.RECOMMENDATION_BODY, 2).try_cast("int")),
        "_tail": F.when(column("_slate"), F.regexp_extract(text, fmt.RECOMMENDATION_BODY, 3)),
    })
    parts = pieces.withColumns({
        "_result": strip(F.regexp_replace(column("_tail"), r",[^,]*\z", "")),
        "_took": F.when(column("_tail").contains(","), strip(F.substring_index(column("_tail"), ",", -1))),
    })
    listed = parts.withColumn("_listed", F.when(column("_status") == 200, parse_slate(column("_result"))))
    malformed = (F.when(column("_took").isNull() | (column("_server") == ""), "InvalidRecommendationEvent")
                 .when(~column("_status").between(100, 599), "InvalidRecommendationStatus")
                 .when(response_ms(column("_took")) == float("inf"), "InvalidResponseTime"))
    checked = listed.withColumn("_malformed", F.when(column("_slate"), malformed))
    error = (F.when(column("movie_id").isNotNull() & ~column("movie_id").rlike(fmt.MOVIE_ID), "InvalidMovieID")
             .when(column("_watch"), F.when(column("_minute").isNull() | (column("_minute") < 0), "InvalidWatchMinute"))
             .when(column("_rating"), F.when(
                 column("_stars").isNull() | ~column("_stars").between(fmt.MIN_RATING, fmt.MAX_RATING), "InvalidRating"))
             .when(column("_slate"), F.coalesce(column("_malformed"), column("_listed.error")))
             .when(column("event_type") == "watch", "InvalidWatchEvent")
             .when(column("event_type") == "rating", "InvalidRatingEvent")
             .when(column("event_type") == "recommendation", "InvalidRecommendationEvent"))
    is_get = text.startswith("GET ")
    opaque = ~(column("_watch") | column("_rating") | column("_slate") | (text == fmt.SIGNUP_BODY))
    well_formed = column("_slate") & column("_malformed").isNull()
    fields = F.struct(
        column("_minute").alias("minute"), column("_stars").alias("rating"), column("_server").alias("server"),
        column("_status").alias("status"), F.when(well_formed, response_ms(column("_took"))).alias("response_time_ms"),
        column("_took").alias("response_time_raw"), column("_result").alias("result_text"),
        F.when(well_formed, column("_listed.items")).alias("recommendations"),
        F.when(is_get | opaque, text).alias("body"),
        F.when(is_get, query_map(F.substring(text, F.lit(5), F.length(text)))).alias("query"))
    return checked.withColumns({"body_error": error, "fields": fields}).drop(
        "_watch", "_rating", "_slate", "_minute", "_stars", "_server", "_status", "_tail", "_result", "_took",
        "_listed", "_malformed")


def parse_events(df: DataFrame, value: str = "value", default_zone: str | None = None) -> DataFrame:
    """Add the parsed columns to raw records: projections only, no Python, no shuffle.

    Error precedence: envelope, body, user, time. Bodies outside the grammar are `unrecognized`. The
    closing one-row `inline` marks the columns as computed, so that later filters and joins use them
    instead of repeating the parsing expressions.
    """
    column = F.col
    opened = df.withColumn("_env", split_envelope(column(value)))
    flat = opened.withColumns({
        "_broken": column("_env.error"), "_time_raw": column("_env.time_raw"),
        "user_id": user_id_from_text(column("_env.user_raw")), "_user_raw": column("_env.user_raw"),
        "body": column("_env.body")})
    timed = with_event_time(with_body(flat), "_time_raw", default_zone)
    error = F.coalesce(column("_broken"), column("body_error"),
                       F.when(column("user_id").isNull(), "InvalidUserID"), column("time_error"))
    named = timed.withColumns({
        "error_type": error,
        "event_time_raw": F.nullif(column("_time_raw"), F.lit("")),
        "timestamp_status": F.when(column("_broken").isNull(), column("timestamp_status")).otherwise("missing"),
        "user_id_raw": F.when(column("_broken").isNull() & column("user_id").isNull(), column("_user_raw")),
    }).withColumn("parse_status", F.when(column("error_type").isNotNull(), "failed")
                  .when(column("event_type").isNotNull(), "parsed").otherwise("unrecognized"))
    return named.select(*df.columns, F.inline(F.array(F.struct(*PARSED_COLUMNS))))

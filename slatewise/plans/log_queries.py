"""Parsing, scalar functions and per-line checks over the activity log and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewise.functions import scalars as s
from slatewise.functions.parse import (query_map, parse_slate, response_ms, split_envelope, strip, user_id_from_text, with_body,
                                       with_event_time)
from slatewise.operators.intervals import time_bucket
from slatewise.operators.quality import tally
from slatewise.operators.ranks import bounded_tail, tail_bounds
from slatewise.plans import inputs as i
from slatewise.plans.registry import query
from slatewise.streaming.ingest import ingest_stats


@query(f"""with {i.LOG}
select "offset", "partition", parse_status, error_type, event_type, epoch_us(event_ts) as event_us, user_id, movie_id,
  minute, rating, server, cast(status as bigint) as status,
  round(case when error_type is distinct from 'InvalidRecommendationEvent' then response_ms end, 6) as response_ms,
  case when error_type is null or error_type = 'InvalidUserID' then items end as items from log""")
def parsed_events(spark, directory):
    """Envelope, grammar, time and error precedence of every line."""
    return i.parsed_lines(spark, directory).select(
        "offset", F.col("partition").cast("bigint").alias("partition"), "parse_status", "error_type", "event_type",
        F.unix_micros("event_ts").alias("event_us"), "user_id", "movie_id", "fields.minute", "fields.rating", "fields.server",
        F.col("fields.status").cast("bigint").alias("status"), F.round("fields.response_time_ms", 6).alias("response_ms"),
        F.size("fields.recommendations").cast("bigint").alias("items"))


@query(f"""with {i.LOG}
select parse_status, coalesce(error_type, 'none') as error_type, count(*) as n from log group by all""")
def parse_errors(spark, directory):
    """How many lines end in which state."""
    return i.parsed_lines(spark, directory).groupBy("parse_status", F.coalesce("error_type", F.lit("none")).alias("error_type")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""with d as (select doc_id, text, regexp_extract(text, '^([^,]*),([^,]*),((?s:.*))$', ['a', 'b', 'c']) as m,
             length(text) - length(replace(text, ',', '')) as commas from documents)
select doc_id, case when commas < 2 then 'InvalidEnvelope' end as error,
  case when commas >= 2 then regexp_replace(m.a, '^\\s+|\\s+$', '', 'g') end as first_part,
  case when commas >= 2 then regexp_replace(m.b, '^\\s+|\\s+$', '', 'g') end as second_part,
  case when commas >= 2 then sha256(regexp_replace(m.c, '^\\s+|\\s+$', '', 'g')) end as body_digest from d""")
def envelope_parts(spark, directory):
    """Three-part envelope split over whole documents."""
    env = split_envelope(F.encode("text", "UTF-8"))
    return i.table(spark, directory, "documents").withColumn("env", env).select(
        "doc_id", "env.error", F.col("env.time_raw").alias("first_part"), F.col("env.user_raw").alias("second_part"),
        F.sha2("env.body", 256).alias("body_digest"))


@query(f"""with {i.LOG},
slots as (select "offset", k, items, cast(r.i as bigint) as rank, cast((k + r.i - 1) % 100 as varchar) as movie_id
          from log, (select unnest(range(1, 21)) as i) r where items is not null and r.i <= items and error_type is distinct from 'Tombstone')
select "offset", rank, movie_id from slots""")
def slate_ranks(spark, directory):
    """Ranked slates from plain, bracketed and quoted lists, one row per slot."""
    return i.parsed_lines(spark, directory).select("offset", F.explode("fields.recommendations").alias("r")).select(
        "offset", F.col("r.rank").cast("bigint").alias("rank"), "r.movie_id")


#: Slates around a customer's number ({n}), and the ids they hold; None where they are invalid.
_SLATES = {
    "['{n}', 'b']": "{n}|b", '["{n}", b]': '"{n}"|b', "[{n}x, b]": "{n}x|b", r"['a\x41{n}', 'b']": "aA{n}|b", r"['a\n{n}']": None, r"['a\'{n}']": "a'{n}",
    "[1{n}, 'a']": None, "[None, '{n}']": None, "[1{n}.5e3]": None, "[0{n}, b]": "0{n}|b", "[u'{n}']": "{n}", "[b'{n}']": None, "{n},b": "{n}|b", "['{n}',]": "{n}",
}
_text = lambda value: "null" if value is None else "'" + value.replace("'", "''") + "'"


@query(" union all ".join(f"select c_custkey, {n} as number, replace({_text(ids)}, '{{n}}', cast(c_custkey + 1 as varchar)) as ids from customer" for n, ids in enumerate(_SLATES.values())))
def slate_cases(spark, directory):
    """Slates as lists of literals of many kinds: strings with escapes, numbers, names, prefixes, and lists that only look like them."""
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("number"), F.lit(text).alias("text")) for n, text in enumerate(_SLATES)]))
    rows = i.table(spark, directory, "customer").select("c_custkey", cases.alias("case"))
    slate = parse_slate(F.replace("case.text", F.lit("{n}"), (F.col("c_custkey") + 1).cast("string")))
    return rows.select("c_custkey", F.col("case.number").alias("number"), slate.alias("slate")).select(
        "c_custkey", "number", F.array_join(F.transform("slate.items", lambda item: item["movie_id"]), "|").alias("ids"))


@query(f"""with {i.LOG}
select "offset", case "offset" % 4 when 0 then round(n * 0.001e0, 6) when 1 then n * 1e0 when 2 then n * 1000e0 end as ms
from log where source_type = 'click'""")
def response_times(spark, directory):
    """Durations in ms, s, us and without unit."""
    lines = i.line_text(i.table(spark, directory, "events")).where("event_type = 'click' and line is not null and line <> 'lost'")
    return lines.select(F.col("event_id").alias("offset"), F.round(response_ms(strip(F.substring_index("line", ",", -1))), 6).alias("ms"))


@query("""select event_id, epoch_us(ts) as utc_us, epoch_us(timezone('America/New_York', ts)) as new_york_us,
  epoch_us(ts - interval 330 minute) as offset_us from events""")
def event_times(spark, directory):
    """UTC, regional and fixed-offset readings of the same local time."""
    rows = i.table(spark, directory, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"))
    read = lambda df, zone, name: with_event_time(df, "t", zone).withColumn(name, F.unix_micros("event_ts")).drop(
        "time_error", "event_ts", "timestamp_status")
    out = read(read(rows, "UTC", "utc_us"), "America/New_York", "new_york_us")
    fixed = out.withColumn("t", F.concat("t", F.lit("+05:30")))
    return read(fixed, None, "offset_us").drop("t")


@query("""with p as (select page_id, regexp_extract(url, '^[^#?]*\\?([^#]*)', 1) as q from pages),
parts as (select page_id, unnest(string_split(q, '&')) as piece from p where q <> '')
select page_id, url_decode(split_part(piece, '=', 1)) as name, url_decode(regexp_extract(piece, '=(.*)$', 1)) as value
from parts where piece <> ''""")
def url_queries(spark, directory):
    """Query parameters of every page address."""
    q = i.table(spark, directory, "pages").select("page_id", F.explode(query_map(F.col("url"))).alias("name", "values"))
    return q.select("page_id", "name", F.explode("values").alias("value"))


@query(f"""with {i.LOG}, names as (select * from (values ('src', 1), ('src', 2), ('note', 1)) v(name, position))
select "offset", name, cast(position as bigint) as position,
  case when name = 'note' then '' when position = 1 then cast(k as varchar) else 'web page' end as value
from log, names where source_type = 'signup' and fifth = 0""")
def line_query_maps(spark, directory):
    """Repeated, encoded and blank parameters of unrecognised signup lines."""
    q = i.parsed_lines(spark, directory).select("offset", F.explode("fields.query").alias("name", "values"))
    return q.select("offset", "name", F.posexplode("values").alias("position", "value")).withColumn(
        "position", (F.col("position") + 1).cast("bigint"))


@query("""with b as (select item_id as id, text as body from benchmark union all select conv_id * 1000 + turn, text from conversations)
select id, cast(null as varchar) as event_type, cast(null as varchar) as body_error, sha256(body) as body_digest from b""")
def free_text_bodies(spark, directory):
    """Text outside the grammar is unrecognised, never failed."""
    bodies = i.table(spark, directory, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("body")).unionByName(
        i.table(spark, directory, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body")))
    return with_body(bodies).select("id", "event_type", "body_error", F.sha2("fields.body", 256).alias("body_digest"))


@query("""select o_orderkey, case when o_orderkey > 0 then cast(o_orderkey as varchar) end as padded_id,
  case when o_orderkey > 0 then o_orderkey end as parsed_id, cast(null as varchar) as too_long from orders""")
def entity_ids(spark, directory):
    """Padded, zero and over-long user ids."""
    padded = F.lpad(F.col("o_orderkey").cast("string"), 25, "0")
    return i.table(spark, directory, "orders").select(
        "o_orderkey", s.normalize_user_id(padded).alias("padded_id"), user_id_from_text(padded).alias("parsed_id"),
        s.normalize_user_id(F.concat(F.lit("9"), padded)).alias("too_long"))


@query("""select l_orderkey, l_linenumber, l_partkey, cast((case when l_extendedprice >= 100 then 1 else 0 end)
  + (case when l_extendedprice >= 1000 then 1 else 0 end) + (case when l_extendedprice >= 10000 then 1 else 0 end) as varchar) as price_band,
  case when l_discount = 0 then 'missing' else cast((case when l_discount >= 0.05 then 1 else 0 end) as varchar) end as discount_band from lineitem""")
def value_bands(spark, directory):
    """Band numbers with unknown kept apart."""
    return i.table(spark, directory, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", s.band(F.col("l_extendedprice"), (100, 1000, 10000)).alias("price_band"),
        s.band(F.nullif("l_discount", F.lit(0.0)), (0.05,)).alias("discount_band"))


@query("""select doc_id, length(n) as characters, sha256(n) as digest from (
  select doc_id, trim(substr(trim(regexp_replace(text, '[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), 1, 2000)) as n
  from documents) d""")
def short_descriptions(spark, directory):
    """Collapsed and cut descriptions, from whole documents."""
    d = s.normalize_description(F.col("text"))
    return i.table(spark, directory, "documents").select("doc_id", F.length(d).cast("bigint").alias("characters"), F.sha2(d, 256).alias("digest"))


@query("""with users as (select distinct user_id from events), h as (
  select user_id, sha256('sample-salt:' || cast(user_id as varchar)) as d from users)
select user_id, cast(('0x' || substr(d, 1, 16))::ubigint % 10000 as bigint) as bucket,
  case when ('0x' || substr(d, 1, 16))::ubigint % 10000 < 5000 then 'treatment' else 'control' end as arm from h""")
def assignments(spark, directory):
    """Experiment arm of every user."""
    users = i.table(spark, directory, "events").select("user_id").distinct()
    return users.select("user_id", s.assignment_bucket("sample-salt", F.col("user_id")).cast("bigint").alias("bucket"),
                        s.assigned_arm("sample-salt", F.col("user_id"), 50).alias("arm"))


@query("""select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as with_scheme,
  lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as without_scheme from pages""")
def hostnames(spark, directory):
    """Hosts with and without scheme and port."""
    bare = F.concat(F.upper(F.regexp_extract("url", "^https?://([^/?#]+)", 1)), F.lit(":8082"))
    return i.table(spark, directory, "pages").select("page_id", s.hostname(F.col("url")).alias("with_scheme"), s.hostname(bare).alias("without_scheme"))


@query("""with r as (select user_id, l.k, sha256('[' || (select string_agg('"' || cast((l.k + i) % 100 as varchar) || '"', ',' order by i)
    from (select unnest(range(0, 20)) as i) x) || ']') as ranking_key
  from (select distinct user_id, cast(regexp_extract(props, '[0-9]+') as int) as k from events where event_type = 'click') l)
select user_id, k, ranking_key from r""")
def ranking_keys(spark, directory):
    """Digest of each ordered slate."""
    rows = i.table(spark, directory, "events").where("event_type = 'click'").select(
        "user_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k")).distinct()
    ids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda n: ((F.col("k") + n) % 100).cast("string"))
    return rows.select("user_id", "k", s.ranking_key(ids).alias("ranking_key"))


@query(f"""with {i.LOG}
select "offset", items is not null as has_slate, coalesce(items, 0) >= 20 as full_slate,
  coalesce(items, 0) > 0 as body_valid from log where event_type = 'recommendation'""")
def slate_checks(spark, directory):
    """Complete rankings, full slates and valid response bodies."""
    rec = F.col("fields.recommendations")
    ids = F.array_join(F.transform(rec, lambda r: r["movie_id"]), ",")
    return i.parsed_lines(spark, directory).where("event_type = 'recommendation'").select(
        "offset", F.coalesce(s.slate_is_sound(rec), F.lit(False)).alias("has_slate"),
        s.valid_slate(rec).isNotNull().alias("full_slate"), F.coalesce(s.valid_response_body(ids), F.lit(False)).alias("body_valid"))


@query(f"""with {i.LOG}
select "offset", strftime(greatest(ingested_at, event_ts, ts), '%Y-%m-%d') as day,
  event_ts >= timestamp '2024-01-10' and event_ts < timestamp '2024-01-20' as inside,
  ingested_at <= timestamp '2024-01-15' as known from log where event_ts is not null""")
def retention_days(spark, directory):
    """Retention day, half-open window and as-of availability of each line."""
    rows = i.parsed_lines(spark, directory).where("event_ts is not null")
    return rows.select(
        "offset", s.retention_day(F.col("ingested_at"), F.col("event_ts"), F.col("broker_timestamp_ms")).alias("day"),
        s.in_window(F.col("event_ts"), "2024-01-10", "2024-01-20").alias("inside"), s.available(F.col("ingested_at"), "2024-01-15").alias("known"))


@query(f"""with {i.LOG},
r as (select *, row_number() over (partition by "partition" order by "offset" desc) as place, count(*) over (partition by "partition") as c from log)
select "partition", max(c) as rows_seen, count(*) as rows_kept, bool_or(c > 1500) as tail_capped, min("offset") as lowest_position,
  max("offset") as highest_position from r where place <= 1500 group by "partition" """)
def tail_limits(spark, directory):
    """Newest 1,500 lines per partition: bounds and cap flag."""
    return tail_bounds(i.log_lines(spark, directory), "partition", "offset", 1500, 1000).withColumn("partition", F.col("partition").cast("bigint"))


@query(f"""with {i.LOG},
r as (select *, row_number() over (partition by "partition" order by "offset" desc) as place from log)
select "partition", parse_status, count(*) as n, cast(sum("offset") as bigint) as offsets from r where place <= 1500 group by "partition", parse_status""")
def tail_states(spark, directory):
    """Parse states inside the bounded tail."""
    return bounded_tail(i.parsed_lines(spark, directory), "partition", "offset", 1500, 1000).groupBy(
        F.col("partition").cast("bigint").alias("partition"), "parse_status").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets"))


@query(f"""with {i.LOG}, t as (select * from log union all select * from log where "offset" % 3 = 0)
select * from (select 'received' as measure, count(*) as n from t union all select 'stored', count(distinct "offset") from t
union all select 'duplicates', count(*) - count(distinct "offset") from t
union all select parse_status, count(*) from t group by parse_status) x""")
def ingest_counts(spark, directory):
    """Received, stored, duplicate and parse-state counts with every third line replayed."""
    rows = i.parsed_lines(spark, directory)
    return ingest_stats(rows.unionByName(rows.where("offset % 3 = 0")))


@query("""select event_type, cast(floor(epoch_us(ts) / 3600000000.0) as bigint) as hour_bucket, count(*) as n from events group by all""")
def hourly_buckets(spark, directory):
    """Time buckets that follow-up joins are keyed by."""
    return i.table(spark, directory, "events").groupBy("event_type", time_bucket(F.col("ts"), 3_600_000_000).alias("hour_bucket")).agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""with {i.LOG}
select coalesce(error_type, 'kept') as drop_reason, count(*) as n from log group by 1""")
def error_tally(spark, directory):
    """One-pass tally of failure classes."""
    return tally(i.parsed_lines(spark, directory), "error_type").withColumnRenamed("error_type", "drop_reason")

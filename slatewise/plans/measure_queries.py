"""Online hit rates, cost, availability, drift, attribution, sessions and retention over the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewise.operators import attribution as at
from slatewise.operators import availability as av
from slatewise.operators import cost, drift, online, retention
from slatewise.operators import sessions as se
from slatewise.operators.intervals import followed
from slatewise.plans import inputs as i
from slatewise.plans.registry import ORACLES, query
from slatewise.session import settle
from slatewise.sources.records import load_fees, typed_fees

HOURS_48 = 172_800
WINDOW = online.Window("2024-01-03", "2024-01-25", "2024-01-28", HOURS_48, "node-1:8082")

ONLINE = i.LOG + """,
recs as (select *, case when parse_status <> 'parsed' then 'unparsed_rows' when not coalesce(user_id > 0, false) then 'invalid_user_rows'
    when server is distinct from 'node-1:8082' then 'other_server_recommendations' when status is distinct from 200 then 'unsuccessful_recommendations'
    when coalesce(items, 0) < 20 then 'short_recommendation_slates' end as drop_reason
  from log where event_type = 'recommendation' and event_ts >= timestamp '2024-01-03' and event_ts < timestamp '2024-01-25'),
seen as (select *, case when parse_status <> 'parsed' then 'unparsed_rows' when not coalesce(user_id > 0, false) then 'invalid_user_rows'
    when not coalesce(movie_id <> '' and minute >= 0, false) then 'invalid_watch_rows' end as drop_reason
  from log where event_type = 'watch' and event_ts >= timestamp '2024-01-03' and event_ts < timestamp '2024-01-28'),
shown as (select distinct user_id, event_ts, k from recs where drop_reason is null),
watches as (select * from seen where drop_reason is null),
slots as (select user_id, event_ts, k, cast((k + r.i) % 100 as varchar) as movie_id from shown, (select unnest(range(20)) as i) r),
hit as (select distinct s.user_id, s.event_ts, s.k from slots s join watches w on w.user_id = s.user_id and w.movie_id = s.movie_id
  and w.event_ts > s.event_ts and w.event_ts < s.event_ts + interval 48 hour),
watched as (select distinct s.user_id, s.event_ts, s.k from shown s join watches w on w.user_id = s.user_id
  and w.event_ts > s.event_ts and w.event_ts < s.event_ts + interval 48 hour)
"""


def _shown_and_watches(spark, directory):
    events = i.parsed(spark, directory)
    return (online.impressions(online.kept(online.recommendation_reasons(events, WINDOW))),
            online.kept(online.watch_reasons(events, WINDOW)))


@query(f"""with {ONLINE}
select 'recommendation' as kind, coalesce(drop_reason, 'kept') as drop_reason, count(*) as n from recs group by 2
union all select 'watch', coalesce(drop_reason, 'kept'), count(*) from seen group by 2""")
def exclusion_tally(spark, directory):
    """Why recommendation and watch lines are left out of the hit rate."""
    return online.exclusion_tally(i.parsed(spark, directory), WINDOW)


@query(f"with {ONLINE} select user_id, epoch_us(event_ts) as event_us, cast(k as varchar) as first_movie from shown")
def impressions(spark, directory):
    """Distinct eligible impressions."""
    shown, _ = _shown_and_watches(spark, directory)
    return shown.select("user_id", F.unix_micros("event_ts").alias("event_us"), F.element_at("slate", 1).alias("first_movie"))


@query(f"""with {ONLINE} select distinct user_id, movie_id from watches where event_ts < timestamp '2024-01-25'""")
def viewing_units(spark, directory):
    """Distinct observed user/movie pairs of the request window."""
    _, watches = _shown_and_watches(spark, directory)
    return online.viewing_units(watches, WINDOW.start, WINDOW.end)


@query(f"with {ONLINE} select user_id, epoch_us(event_ts) as event_us from hit")
def subsequent_hits(spark, directory):
    """Impressions followed by a watch of a shown movie."""
    shown, watches = _shown_and_watches(spark, directory)
    return shown.join(online.hits(shown, watches, HOURS_48), "impression_id", "left_semi").select(
        "user_id", F.unix_micros("event_ts").alias("event_us"))


@query(f"with {ONLINE} select user_id, epoch_us(event_ts) as event_us from watched")
def observed_watchers(spark, directory):
    """Impressions followed by any watch."""
    shown, watches = _shown_and_watches(spark, directory)
    return online.observed_watchers(shown, watches, HOURS_48).select("user_id", F.unix_micros("event_ts").alias("event_us"))


@query(f"""with {ONLINE}, t as (select (select count(*) from shown) as eligible_recommendations, (select count(distinct user_id) from shown) as unique_recommended_users,
  (select count(*) from hit) as hits, (select count(*) from watched) as observed_watchers)
select *, round(hits / nullif(cast(eligible_recommendations as double), 0), 6) as hit_rate, round(hits / nullif(cast(observed_watchers as double), 0), 6) as conditional_hit_rate,
  round(observed_watchers / nullif(cast(eligible_recommendations as double), 0), 6) as observed_watch_rate,
  eligible_recommendations - observed_watchers as without_observed_watch, observed_watchers - hits as observed_without_match,
  round((eligible_recommendations - observed_watchers) / nullif(cast(eligible_recommendations as double), 0), 6) as no_observed_watch_rate from t""")
def hit_rate_summary(spark, directory):
    """Online hit rate at 20 with 48 hours of follow-up."""
    row = online.evaluate_online(i.parsed(spark, directory), WINDOW)
    return row.withColumns({c: F.round(c, 6) for c in row.columns if c.endswith("rate")})


@query("""with c as (select user_id, ts from events where event_type = 'click'), v as (select user_id, ts from events where event_type = 'view')
select user_id, epoch_us(ts) as click_us, exists (select 1 from v where v.user_id = c.user_id and v.ts > c.ts and v.ts < c.ts + interval 6 hour) as followed from c""")
def clicks_followed(spark, directory):
    """Clicks with and without a view strictly inside six hours."""
    events = i.table(spark, directory, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"))
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"))
    mark = lambda how, value: followed(clicks, views, ["user_id"], "click_ts", "view_ts", 21_600, how).select(
        "user_id", F.unix_micros("click_ts").alias("click_us"), F.lit(value).alias("followed"))
    return mark("left_semi", True).unionByName(mark("left_anti", False))


@query(f"""with {i.LOG}
select "partition", count(*) as rows, epoch_us(min(event_ts)) as oldest_us, epoch_us(max(event_ts)) as newest_us,
  min("offset") as lowest_offset, max("offset") as highest_offset,
  coalesce(min(event_ts) <= timestamp '2024-01-02' and max(event_ts) >= timestamp '2024-01-30', false) as bracketed from log group by 1""")
def partition_coverage(spark, directory):
    """Bounds per partition and whether they enclose the window."""
    c = online.partition_coverage(i.parsed_lines(spark, directory), "2024-01-02", "2024-01-30")
    return c.select(F.col("partition").cast("bigint").alias("partition"), "rows", F.unix_micros("oldest_event").alias("oldest_us"),
                    F.unix_micros("newest_event").alias("newest_us"), "lowest_offset", "highest_offset", "bracketed")


# --- cost ------------------------------------------------------------------------------------------------

UNITS = i.FEES + ", " + i.PAIRS + """,
units as (select distinct user_id, case when cast(movie_id as int) % 29 = 0 then 'gone-' || movie_id else movie_id end as movie_id from pairs),
priced as (select u.*, case when f.movie_id is null then 'missing_catalog' when fee_status = 'invalid' then 'invalid_fee'
             when fee_status = 'missing' then 'missing_fee' else 'covered' end as unit_status, fee from units u left join fees f using (movie_id))
"""


def _units(spark, directory):
    gone = F.col("movie_id").cast("int") % 29 == 0
    return i.pairs(spark, directory).select("user_id", F.when(gone, F.concat(F.lit("gone-"), F.col("movie_id"))).otherwise(
        F.col("movie_id")).alias("movie_id")).distinct()


COST_COLUMNS = """count(*) as observed_units, count(*) filter (unit_status = 'covered') as covered_units,
  count(*) filter (unit_status = 'missing_catalog') as missing_catalog_units, count(*) filter (unit_status = 'missing_fee') as missing_fee_units,
  count(*) filter (unit_status = 'invalid_fee') as invalid_fee_units, round(cast(coalesce(sum(fee), 0) as double), 4) as known_cost,
  round(count(*) filter (unit_status = 'covered') / cast(count(*) as double), 6) as fee_coverage,
  round(cast(case when count(*) filter (unit_status = 'covered') = count(*) then coalesce(sum(fee), 0) end as double), 4) as total_cost,
  round(cast(sum(fee) as double) / nullif(count(*) filter (unit_status = 'covered'), 0), 6) as mean_known_fee"""


def _plain_cost(df):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("known_cost", "total_cost")}).withColumns(
        {c: F.round(c, 6) for c in ("fee_coverage", "mean_known_fee")})


@query(f"with {i.FEES} select movie_id, round(cast(fee as double), 4) as fee, fee_status from fees")
def licence_fees(spark, directory):
    """Known, missing and invalid fees of the catalogue."""
    return load_fees(i.movies(spark, directory)).withColumn("fee", F.round(F.col("fee").cast("double"), 4))


@query(f"with {UNITS} select unit_status, count(*) as n, round(cast(sum(fee) as double), 4) as fees from priced group by 1")
def unit_statuses(spark, directory):
    """Viewing units by fee status."""
    return cost.price_units(_units(spark, directory), i.fees(spark, directory)).groupBy("unit_status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("fee").cast("double"), 4).alias("fees"))


@query(f"with {UNITS} select {COST_COLUMNS} from priced")
def licence_cost(spark, directory):
    """Licence cost proxy over all viewing units."""
    return _plain_cost(cost.licence_cost(cost.price_units(_units(spark, directory), i.fees(spark, directory))))


@query(f"with {UNITS} select user_id, {COST_COLUMNS} from priced group by user_id")
def licence_cost_by_user(spark, directory):
    """Licence cost per user, total only when every unit is priced."""
    return _plain_cost(cost.licence_cost(cost.price_units(_units(spark, directory), i.fees(spark, directory)), "user_id"))


@query(f"""with {i.FEES}, saved as (select cast(p_partkey as varchar) as movie_id, case when p_partkey % 3 = 0 then 5.5 end as fee from part),
fetched as (select cast(p_partkey as varchar) as movie_id, case when p_partkey % 5 = 0 then 7.25 end as fee from part)
select movie_id, round(cast(coalesce(g.fee, s.fee, f.fee) as double), 4) as fee,
  case when coalesce(g.fee, s.fee) is not null then 'known' else fee_status end as fee_status
from fees f left join saved s using (movie_id) left join fetched g using (movie_id)""")
def overlaid_fees(spark, directory):
    """Later fee sources override only where they know a value."""
    parts = i.table(spark, directory, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("movie_id"))
    source = lambda step, value: typed_fees(parts.select("movie_id", F.when(F.col("p_partkey") % step == 0, value).alias("license_cost")))
    merged = cost.overlay_fees(i.fees(spark, directory), source(3, "5.5"), source(5, "7.25"))
    return merged.withColumn("fee", F.round(F.col("fee").cast("double"), 4))


@query(f"""with {UNITS} select u.movie_id, count(*) as viewers from units u where u.movie_id not in (select movie_id from fees where fee_status = 'known') group by 1""")
def missing_fee_priority(spark, directory):
    """Movies without a fee by number of viewers."""
    return cost.missing_fee_priority(_units(spark, directory), i.fees(spark, directory))


ATTEMPTS = """
raw as (select o_orderkey as id, o_orderdate as started_at, case o_orderstatus when 'F' then 'failed' when 'O' then 'success' else 'pending' end as status,
  case when o_custkey % 4 = 0 then 'model-a' when o_custkey % 4 = 1 then 'model-a-mini' when o_custkey % 4 = 2 then 'model-b' end as model,
  o_orderkey % 9 <> 0 as has_usage, cast(floor(o_totalprice) as bigint) as input_tokens, case when o_orderkey % 11 = 0 then -1 else o_orderkey % 50 end as output_tokens,
  o_orderkey % 13 = 0 as bad_total, o_orderkey % 7 <> 0 as has_details, cast(floor(o_totalprice / 4) as bigint) as cached, o_orderkey % 100 as written,
  case when o_orderkey % 3 = 0 then '12h' when o_orderkey % 3 = 1 then '30m' end as retention from orders),
attempts as (select *, case when not has_usage then 'missing' when output_tokens < 0 or bad_total then 'invalid' else 'usable' end as state,
  has_details and cached between 0 and input_tokens and written between 0 and input_tokens as detailed from raw)
"""


def _attempts(spark, directory):
    orders, key = i.table(spark, directory, "orders"), F.col("o_orderkey")
    inputs = F.floor("o_totalprice")
    outputs = F.when(key % 11 == 0, F.lit(-1)).otherwise(key % 50)
    details = F.struct(F.floor(F.col("o_totalprice") / 4).alias("cached_tokens"), (key % 100).alias("cache_write_tokens"))
    usage = F.struct(inputs.alias("input_tokens"), outputs.alias("output_tokens"),
                     F.when(key % 13 == 0, F.lit(7)).otherwise(inputs + outputs).alias("total_tokens"),
                     F.when(key % 7 != 0, details).alias("input_tokens_details"))
    return orders.select(
        key.alias("attempt_id"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("pending").alias("status"),
        F.when(F.col("o_custkey") % 4 == 0, "model-a").when(F.col("o_custkey") % 4 == 1, "model-a-mini").when(F.col("o_custkey") % 4 == 2, "model-b").alias("model"),
        F.lit("/v1/decide").alias("endpoint"), F.when(key % 9 != 0, usage).alias("usage"),
        F.when(key % 3 == 0, "12h").when(key % 3 == 1, "30m").alias("cache_retention"))


@query(f"""with {ATTEMPTS}
select coalesce(case when grouping(coalesce(model, 'unknown')) = 1 then '(all)' end, coalesce(model, 'unknown')) as model, count(*) as attempts,
  count(*) filter (state = 'usable') as attempts_with_usage, count(*) filter (state = 'missing') as missing_usage_attempts,
  count(*) filter (state = 'invalid') as invalid_usage_attempts,
  cast(coalesce(sum(input_tokens) filter (state = 'usable'), 0) as bigint) as known_input_tokens,
  cast(coalesce(sum(output_tokens) filter (state = 'usable'), 0) as bigint) as known_output_tokens,
  cast(coalesce(sum(input_tokens + output_tokens) filter (state = 'usable'), 0) as bigint) as known_total_tokens,
  cast(coalesce(sum(cached) filter (state = 'usable' and detailed), 0) as bigint) as known_cached_input_tokens,
  cast(coalesce(sum(written) filter (state = 'usable' and detailed), 0) as bigint) as known_cache_write_tokens,
  count(*) filter (state = 'usable' and not detailed) as missing_cache_detail_attempts,
  count(*) filter (status = 'pending') as status_pending, count(*) filter (status = 'responded') as status_responded,
  count(*) filter (status = 'success') as status_success, count(*) filter (status = 'failed') as status_failed,
  cast(null as bigint) as total_tokens from attempts group by rollup (coalesce(model, 'unknown'))""")
def attempt_usage(spark, directory):
    """Provider tokens per model and in total; unknown usage leaves the total unknown."""
    return cost.attempt_usage(_attempts(spark, directory))


@query(f"""with {ATTEMPTS}, p as (select *, case when has_usage and has_details and (model = 'model-a' or model like 'model-a-%') and input_tokens between 0 and 272000
  and cached + written <= input_tokens then ((input_tokens - cached - written) * cast(0.10 as decimal(12,6)) + cached * cast(0.01 as decimal(12,6))
  + written * cast(case when retention = '12h' then 0.25 else 0.125 end as decimal(12,6))) * cast(0.000001 as decimal(7,6)) end as price from attempts)
select count(*) as attempts, count(price) as priced_attempts, count(*) - count(price) as unknown_attempts,
  round(cast(coalesce(sum(price), 0) as double), 6) as known_cost, cast(null as double) as estimated_cost from p""")
def provider_cost(spark, directory):
    """Exact decimal price of provider attempts; unpriced ones stay unknown."""
    tariff = cost.Tariff("model-a", "/v1/decide", "0.10", "0.01", "0.125", "0.25")
    row = cost.provider_cost(_attempts(spark, directory), tariff)
    return row.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("known_cost", "estimated_cost")})


# --- availability ----------------------------------------------------------------------------------------

AVAILABLE = i.LOG + """,
calls as (select *, case when "offset" % 19 = 0 then null else server end as host from log
  where event_type = 'recommendation' and event_ts >= timestamp '2024-01-05' and event_ts < timestamp '2024-01-26'),
mine as (select *, host is not null as attributed, coalesce(cast(status as varchar), 'unknown') as status_text from calls where host is null or host = 'node-1:8082')
"""


def _calls(events):
    hidden = events.withColumn("fields", F.when(F.col("offset") % 19 == 0, F.col("fields").withField("server", F.lit(None).cast("string"))).otherwise(F.col("fields")))
    return av.server_requests(hidden, "node-1:8082", "2024-01-05", "2024-01-26")


@query(f"with {AVAILABLE} select status_text, count(*) as requests from mine where attributed group by 1")
def status_histogram(spark, directory):
    """Response statuses of one server."""
    return av.status_histogram(_calls(i.parsed(spark, directory)))


@query(f"""with {AVAILABLE}, s as (select count(*) filter (attributed) as requests, count(*) filter (attributed and status_text = '200') as successful,
  count(*) filter (attributed and status_text <> '200') as failed, count(*) filter (not attributed) as unattributed from mine)
select *, true as window_bracketed, round(successful / cast(requests as double), 6) as observed_ratio, round(successful / cast(requests as double), 6) as ratio,
  round(successful / cast(requests + unattributed as double), 6) as conservative_ratio from s""")
def availability(spark, directory):
    """Success ratio, observed and conservative."""
    events = i.parsed(spark, directory)
    covered = online.all_bracketed(online.partition_coverage(events, "2024-01-05", "2024-01-26"))
    row = av.availability(_calls(events), covered)
    return row.withColumns({c: F.round(c, 6) for c in row.columns if c.endswith("ratio")})


@query(f"""with {AVAILABLE} select coalesce(case when event_ts < timestamp '2024-01-15' then 'before' else 'after' end, 'overall') as phase,
  count(*) filter (attributed) as requests, count(*) filter (attributed and status_text = '200') as successful,
  count(*) filter (attributed and status_text <> '200') as failed, count(*) filter (not attributed) as unattributed,
  round(count(*) filter (attributed and status_text = '200') / nullif(cast(count(*) filter (attributed) as double), 0), 6) as availability
from mine group by rollup (case when event_ts < timestamp '2024-01-15' then 'before' else 'after' end)""")
def before_after(spark, directory):
    """Availability before, after and over a change."""
    return av.before_after(_calls(i.parsed(spark, directory)), "2024-01-15").withColumn("availability", F.round("availability", 6))


@query(f"""with {AVAILABLE} select (select count(*) from mine where not attributed) = 0 as usable""")
def evidence_usable(spark, directory):
    """Whether the evidence around the change can be used."""
    events = i.parsed(spark, directory)
    covered = online.all_bracketed(online.partition_coverage(events, "2024-01-05", "2024-01-26"))
    return av.evidence_usable(av.before_after(_calls(events), "2024-01-15"), covered)


@query("""with r as (select count(*) filter (event_type = 'click') as requests, sum(value) as value_sum, avg(value) filter (event_type = 'view') as view_mean from events)
select v.name, v.value from r, lateral (values ('collector_age_seconds', 30e0), ('collector_fresh', 1e0), ('course_requests', cast(requests as double)),
  ('value_sum', round(value_sum, 3)), ('view_mean', round(view_mean, 3))) v(name, value)""")
def metric_gauges(spark, directory):
    """A fresh report as gauge rows."""
    report = i.table(spark, directory, "events").agg(
        F.count_if(F.col("event_type") == "click").alias("course_requests"), F.round(F.sum("value"), 3).alias("value_sum"),
        F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 3).alias("view_mean")).withColumn("collector_age_seconds", F.lit(30))
    return av.metric_gauges(report, 60)


@query("""with r as (select count(*) as requests from events)
select v.name, v.value from r, lateral (values ('collector_age_seconds', 90e0), ('collector_fresh', 0e0), ('course_requests', cast(null as double))) v(name, value)""")
def stale_gauges(spark, directory):
    """A stale report keeps only collector values."""
    report = i.table(spark, directory, "events").agg(F.count(F.lit(1)).alias("course_requests")).withColumn("collector_age_seconds", F.lit(90))
    return av.metric_gauges(report, 60)


# --- drift ----------------------------------------------------------------------------------------------

PROFILES = """
prof as (select half, feature, category, count(*) as n from (
  select ts < timestamp '2024-01-16' as half, unnest([{'f': 'schema', 'c': case when parse_status = 'parsed' then 'valid' else 'invalid' end},
    {'f': case when parse_status = 'parsed' then 'event_type' else 'error' end, 'c': case when parse_status = 'parsed' then event_type else coalesce(error_type, 'unsupported_event') end},
    {'f': case when parse_status = 'parsed' and event_type = 'rating' then 'rating' end, 'c': cast(rating as varchar)}]) as p from log) x,
  lateral (select p.f as feature, p.c as category) y where feature is not null group by all)
"""


def _halves(spark, directory):
    events = i.parsed(spark, directory)
    first = F.timestamp_millis("broker_timestamp_ms") < F.lit("2024-01-16").cast("timestamp")
    return drift.profile_events(events.where(first)), drift.profile_events(events.where(~first))


@query(f"with {i.LOG}, {PROFILES} select 'kafka' as source, feature, category, n from prof where half")
def event_profile(spark, directory):
    """Feature histogram of the first half of the log."""
    return _halves(spark, directory)[0]


@query(f"""with {i.LOG}, {PROFILES}, c as (select half, case when feature = 'event_type' then 'event_type_non_watch' else feature end as feature, category, n from prof
  where feature <> 'error' and not (feature = 'event_type' and category = 'watch')),
j as (select feature, category, coalesce(sum(n) filter (half), 0) as a, coalesce(sum(n) filter (not half), 0) as b from c group by 1, 2),
t as (select *, sum(a) over (partition by feature) as ta, sum(b) over (partition by feature) as tb from j)
select 'kafka' as source, feature, case when least(max(ta), max(tb)) >= 50 then round(0.5 * sum(abs(a / cast(ta as double) - b / cast(tb as double))), 6) end as distance
from t group by feature""")
def drift_distances(spark, directory):
    """Total variation between the two halves of the log."""
    return drift.drift_distances(*_halves(spark, directory))


@query(f"""with {i.LOG}, s as (select count(*) as n, count(*) filter (parse_status <> 'parsed') as bad from log where ts >= timestamp '2024-01-16')
select 'kafka' as source, cast(null as varchar) as feature, 'schema_failure_rate' as reason, round(bad / cast(n as double), 6) as value from s where bad / cast(n as double) > 0.1
union all select v.s, null, 'insufficient_samples', 0e0 from (values ('user_api'), ('movie_api'), ('recommendation_api')) v(s)""")
def drift_findings(spark, directory):
    """Findings between the halves: invalid share of the log, no samples elsewhere."""
    return drift.drift_findings(*_halves(spark, directory)).withColumn("value", F.round("value", 6))


@query("""select 'user_api' as source, f.feature, f.category, count(*) as n from customer, lateral (values ('schema', 'valid'),
  ('age', cast((case when c_custkey % 90 >= 18 then 1 else 0 end) + (case when c_custkey % 90 >= 30 then 1 else 0 end) + (case when c_custkey % 90 >= 45 then 1 else 0 end)
     + (case when c_custkey % 90 >= 60 then 1 else 0 end) as varchar)),
  ('description_present', case when c_custkey % 3 = 0 then 'False' else 'True' end)) f(feature, category) group by 2, 3""")
def user_profile(spark, directory):
    """Feature histogram of user records."""
    return drift.profile_users(_user_records(spark, directory))


def _user_records(spark, directory):
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"age":'), (k % 90).cast("string"), F.lit(',"self_description_likes":"'),
                    F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.lit('"}'))
    return i.spread(i.table(spark, directory, "customer").select("c_custkey", "c_mktsegment")).select(
        F.try_parse_json(text).alias("record"), F.lit(None).cast("string").alias("fetch_error"))


@query("""select 'movie_api' as source, f.feature, f.category, count(*) as n from part, lateral (values ('schema', 'valid'),
  ('runtime', cast((case when p_size >= 1 then 1 else 0 end) as varchar)), ('cost', '4'),
  ('genres', case when p_type < p_brand then p_type || '|' || p_brand else p_brand || '|' || p_type end)) f(feature, category) group by 2, 3""")
def movie_profile(spark, directory):
    """Feature histogram of movie records."""
    return drift.profile_movies(_movie_records(spark, directory))


def _movie_records(spark, directory):
    text = F.to_json(F.struct(F.col("p_size").alias("runtime"), F.col("p_retailprice").alias("cost"), F.concat_ws("|", "p_type", "p_brand").alias("genres")))
    return i.spread(i.table(spark, directory, "part").select("p_size", "p_retailprice", "p_type", "p_brand")).select(
        F.try_parse_json(text).alias("record"), F.lit(None).cast("string").alias("fetch_error"))


@query(f"""with {i.REQUESTS}, p as (select *, case when not coalesce(user_id > 0, false) then 'invalid_request_user' end as err from requests)
select 'recommendation_api' as source, f.feature, f.category, count(*) as n from p, lateral (values
  ('schema', case when err is null then 'valid' else 'invalid' end), ('error', err), ('status', case when err is null then cast(status as varchar) end),
  ('serving_method', case when err is null then serving_method end),
  ('latency', case when err is null then cast((case when n >= 100 then 1 else 0 end) + (case when n >= 400 then 1 else 0 end) + (case when n >= 600 then 1 else 0 end) as varchar) end)) f(feature, category)
where f.category is not null group by 2, 3""")
def request_profile(spark, directory):
    """Feature histogram of API requests."""
    return drift.profile_requests(i.request_log(spark, directory))


#: The first half of the log by ingestion and of the requests by their start, and all metadata.
HALF = f"""snap as (select 'kafka' as source, feature, category, n from (with {i.LOG}, {PROFILES.replace("ts < timestamp '2024-01-16' as half", "ingested_at < timestamp '2024-01-16' as half")} select * from prof where half)
  {"".join(f" union all select source, feature, category, n from ({sql})" for sql in (ORACLES["user_profile"], ORACLES["movie_profile"], ORACLES["request_profile"].replace("err from requests)", "err from requests where started_at < timestamp '2024-01-16')")))})"""


def _snapshot(spark, directory):
    return drift.quality_snapshot(i.parsed(spark, directory), i.request_log(spark, directory), _user_records(spark, directory), _movie_records(spark, directory),
                                  "2000-01-01", "2024-01-16")


@query(f"with {HALF} select source, feature, category, n from snap")
def quality_snapshot(spark, directory):
    """Profile of all four sources over one whole window: the log and the requests by their times, and all metadata."""
    return _snapshot(spark, directory)


@query(f"""with {HALF}, size as (select source, sum(n) as samples, coalesce(sum(n) filter (category = 'invalid'), 0) as invalid from snap where feature = 'schema' group by 1),
known as (select s.source, coalesce(samples, 0) as samples, coalesce(invalid, 0) as invalid from (values ('kafka'), ('recommendation_api'), ('user_api'), ('movie_api')) s(source) left join size using (source))
select source, case when samples < 50 then 'insufficient_samples' else 'schema_failure_rate' end as reason,
  round(case when samples < 50 then samples else invalid / cast(samples as double) end, 6) as value from known where samples < 50 or invalid / cast(samples as double) > 0.1""")
def snapshot_against_itself(spark, directory):
    """What keeps a snapshot from becoming the reference: findings against itself, so too few samples or too many invalid rows."""
    snapshot = settle(_snapshot(spark, directory))
    return drift.drift_findings(snapshot, snapshot).select("source", "reason", F.round("value", 6).alias("value"))


@query(f"""with {i.LOG}, s as (select "partition", count(*) as n, max("offset") as highest from log group by 1),
r as (select "partition", "offset", row_number() over (partition by "partition" order by "offset" desc) as k from log)
select "partition", n as rows_seen, least(n, 100) as rows_kept, n > 100 as tail_capped, (select min("offset") from r where r."partition" = s."partition" and k <= 100) as lowest, highest from s""")
def tail_coverage(spark, directory):
    """Whether a tail of 200 rows, shared by two partitions, leaves rows of a partition out, and which offsets it keeps."""
    found = drift.tail_coverage(i.parsed(spark, directory), 200, 2)
    return found.select(F.col("partition").cast("bigint").alias("partition"), "rows_seen", F.col("rows_kept").cast("bigint").alias("rows_kept"), "tail_capped",
                        F.col("lowest_position").alias("lowest"), F.col("highest_position").alias("highest"))


# --- attribution -----------------------------------------------------------------------------------------

LINKS = i.REQUESTS + """,
slates as (select 'recommendation_requests' as origin, request_id as identity, user_id, finished_at as served_at, k, items from requests where status = 200 and user_id is not null
  union all select 'kafka_events', 'sample-log/activity/' || cast("partition" as varchar) || '/' || cast("offset" as varchar), user_id, event_ts, k, items from log
    where event_type = 'recommendation' and parse_status = 'parsed' and status = 200 and user_id is not null and items is not null),
ev as (select "offset", user_id, movie_id, event_ts, event_type from log where parse_status = 'parsed' and event_type in ('watch', 'rating') and user_id is not null),
links as (select e."offset", s.origin, s.identity, s.served_at, e.user_id, e.movie_id, e.event_ts from ev e join slates s on s.user_id = e.user_id
  and (cast(e.movie_id as int) - s.k + 100) % 100 < s.items and s.served_at >= e.event_ts - interval 24 hour and s.served_at < e.event_ts)
"""


def _links(spark, directory):
    events = i.parsed(spark, directory)
    return at.all_impressions(i.request_log(spark, directory), events), at.observed_events(events)


@query(f"with {LINKS} select origin, count(*) as n, count(distinct user_id) as users, cast(sum(items) as bigint) as slots from slates group by 1")
def impression_sources(spark, directory):
    """Impressions of request log and stream in one shape."""
    shown, _ = _links(spark, directory)
    return shown.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"),
                                       F.sum(F.size("recommendations")).alias("slots"))


@query(f"""with {LINKS} select "offset", origin, identity, round((epoch_us(event_ts) - epoch_us(served_at)) / 1000000e0, 3) as seconds_after,
  count(*) over (partition by "offset") as candidate_count, count(*) over (partition by "offset") > 1 as ambiguous from links""")
def attribution_links(spark, directory):
    """Watches and ratings linked to the slates that showed their movie within a day."""
    return at.candidate_links(*_links(spark, directory)).select(
        "offset", "origin", "identity", F.round("seconds_after", 3).alias("seconds_after"), "candidate_count", "ambiguous")


@query(f"""with {LINKS}, c as (select "offset", count(*) as n from links group by 1)
select coalesce(c.n, 0) as candidate_count, coalesce(c.n, 0) > 1 as ambiguous, count(*) as events from ev left join c using ("offset") group by 1, 2""")
def attribution_counts(spark, directory):
    """Events by number of candidate impressions."""
    return at.candidate_counts(*_links(spark, directory)).groupBy("candidate_count", "ambiguous").agg(F.count(F.lit(1)).alias("events"))


MATCH = i.REQUESTS + """,
course as (select "offset" as course_id, user_id, k, items, event_ts as at from log where event_type = 'recommendation' and parse_status = 'parsed' and status = 200 and items is not null),
api as (select request_id, user_id, k, items, started_at as at, serving_method, version, n from requests where status = 200),
near as (select c.course_id, a.request_id from course c join api a on a.user_id = c.user_id and a.k = c.k and a.items = c.items and abs(epoch_us(a.at) - epoch_us(c.at)) <= 5000000),
one as (select course_id, min(request_id) as request_id from near group by 1 having count(*) = 1),
won as (select request_id, min(course_id) as course_id from one group by 1 having count(*) = 1),
matched as (select c.*, w.request_id, a.serving_method, a.version, a.n as latency from course c left join won w using (course_id) left join api a on a.request_id = w.request_id)
"""


def _matched(spark, directory, events=None):
    events = (i.parsed(spark, directory) if events is None else events).where("event_type = 'recommendation' and parse_status = 'parsed' and fields.status = 200")
    course = events.where("fields.recommendations is not null").select(
        F.col("offset").alias("course_id"), "user_id", F.transform("fields.recommendations", lambda r: r["movie_id"]).alias("ids"),
        F.col("event_ts").alias("at"))
    requests = i.request_log(spark, directory).where("status = 200")
    api = requests.select("request_id", "user_id", "ids", F.col("started_at").alias("at"))
    found = at.match_one_to_one(course, api)
    return found.join(requests.select("request_id", "serving_method", "version", "latency_ms"), "request_id", "left")


@query(f"with {MATCH} select course_id, request_id from matched")
def one_to_one_matches(spark, directory):
    """Logged responses and the one API request each belongs to."""
    return _matched(spark, directory).select("course_id", "request_id")


@query(f"""with {MATCH}, p as (select *, serving_method in ('ease', 'llm_cold_start') as personal from matched)
select count(serving_method) as matched, count(*) filter (personal) as personalised, count(distinct user_id) filter (personal) as personalised_users,
  count(distinct k * 100 + items) filter (personal) as personalised_rankings, (select count(*) from log where event_type = 'recommendation') as requests,
  round(100e0 * count(*) filter (personal) / (select count(*) from log where event_type = 'recommendation'), 3) as personalised_percent from p""")
def personalised_share(spark, directory):
    """Share of requests with a confirmed personal response."""
    events = i.parsed(spark, directory)
    return at.personalised_share(_matched(spark, directory, events), events.where("event_type = 'recommendation'"))


@query(f"with {MATCH} select serving_method, version, count(*) as requests from matched where request_id is not null group by 1, 2")
def serving_methods(spark, directory):
    """Matched responses by method and version."""
    return at.methods(_matched(spark, directory))


@query(f"""with {i.LOG} select server, count(response_ms) as samples, round(quantile_cont(response_ms, 0.5), 3) as p50, round(quantile_cont(response_ms, 0.95), 3) as p95,
  max(response_ms) as max, count(*) filter (response_ms > 600) as over_limit
from log where response_ms is not null and event_type = 'recommendation' and error_type is distinct from 'InvalidRecommendationEvent' group by server""")
def latency_percentiles(spark, directory):
    """Interpolated response-time quantiles per server."""
    rows = i.parsed(spark, directory).select(F.col("fields.server").alias("server"), F.col("fields.response_time_ms").alias("ms"))
    return at.latency_percentiles(rows, ["server"], "ms")


@query("""select count(*) as samples, round(quantile_cont(l_extendedprice, 0.5), 3) as p50, round(quantile_cont(l_extendedprice, 0.95), 3) as p95,
  max(l_extendedprice) as max, count(*) filter (l_extendedprice > 600) as over_limit from lineitem""")
def price_percentiles(spark, directory):
    """Exact quantiles over one large group."""
    return at.latency_percentiles(i.table(spark, directory, "lineitem"), [], "l_extendedprice")


# --- sessions and retention ------------------------------------------------------------------------------

SESSIONS = i.LOG + """,
w as (select * from log where event_type = 'watch' and parse_status = 'parsed' and user_id is not null),
g as (select *, epoch_us(event_ts) - lag(epoch_us(event_ts)) over (partition by user_id, movie_id order by event_ts, "offset") as gap from w),
n as (select *, sum(case when gap is null or gap >= 604800000000 then 1 else 0 end) over (partition by user_id, movie_id order by event_ts, "offset") as session from g)
"""


@query(f"""with {SESSIONS} select user_id, movie_id, cast(session as bigint) as session, count(*) as watches, epoch_us(min(event_ts)) as first_us,
  epoch_us(max(event_ts)) as last_us, arg_min("offset", event_ts) as first_offset, arg_max("offset", event_ts) as last_offset from n group by 1, 2, 3""")
def watch_sessions(spark, directory):
    """Sessions of each user and movie after a week without watching."""
    numbered = se.sessions(se.parsed_watches(i.parsed(spark, directory)), idle_seconds=604_800)
    return se.session_records(numbered).select("user_id", "movie_id", "session", "watches", F.unix_micros("first_ts").alias("first_us"),
                                               F.unix_micros("last_ts").alias("last_us"), "first_offset", "last_offset")


@query(f"""with {i.LOG}, r as (select *, row_number() over (partition by user_id, movie_id order by event_ts desc, "partition" desc, "offset" desc) as place from log
  where event_type = 'watch' and parse_status = 'parsed' and user_id is not null) select user_id, movie_id, "offset", minute from r where place = 1""")
def latest_watches(spark, directory):
    """Newest watch of each user and movie."""
    return se.latest_watches(i.parsed_lines(spark, directory)).select("user_id", "movie_id", "offset", F.col("fields.minute").alias("minute"))


@query(f"""with {i.LOG}, w as (select * from log where event_type = 'watch' and parse_status = 'parsed' and user_id is not null),
k as (select count(*) as n from (select distinct user_id, movie_id from w) x)
select k.n as retained_watch_events, (select count(*) from w) - k.n as removed_watch_events from k""")
def compaction_counts(spark, directory):
    """Watches kept and removed by compaction."""
    return retention.compaction_counts(i.parsed(spark, directory))


@query(f"""with {i.LOG}, w as (select *, event_type = 'watch' and parse_status = 'parsed' and user_id is not null as is_watch from log),
r as (select *, row_number() over (partition by user_id, movie_id order by event_ts desc, "offset" desc) as place from w where coalesce(is_watch, false))
select "offset" from w where not coalesce(is_watch, false) union all select "offset" from r where place = 1""")
def compacted_log(spark, directory):
    """Offsets that survive compaction."""
    return retention.compact_watches(i.parsed(spark, directory)).select("offset")


LEDGER = i.LOG + """,
lines as (select event_id as "offset", octet_length(encode(cast(user_id as varchar))) as key_bytes from events),
led as (select strftime(ingested_at, '%Y-%m-%d') as day, "partition", count(*) as row_count, cast(sum(key_bytes) as bigint) as bytes, min("offset") as min_offset, max("offset") as max_offset
  from log join lines using ("offset") group by 1, 2),
days as (select day, cast(sum(row_count) as bigint) as row_count, cast(sum(bytes) as bigint) as bytes, day in ('2024-01-02', '2024-01-03', '2024-01-04', '2024-01-10', '2024-01-11') as pinned from led group by 1),
plan as (select *, cast(sum(case when pinned then 0 else bytes end) over (order by day desc) as bigint) as running_bytes from days),
expiry as (select *, not pinned and day < '2024-01-20' and running_bytes > (select sum(bytes) from led) * 0.5 as expire from plan)
"""


def _pins(spark, directory):
    """Pinned intervals around two moments that the data itself gives: day 2 and day 10 of the log."""
    start = F.date_trunc("day", F.min("ts"))
    bounds = i.table(spark, directory, "events").agg(start.alias("s"))
    pin = lambda name, a, b: bounds.select(F.lit(name).alias("pin_id"), (F.col("s") + F.expr(f"interval {a}")).alias("start"), (F.col("s") + F.expr(f"interval {b}")).alias("end"))
    return pin("a", "25 hours", "73 hours").unionByName(pin("b", "225 hours", "245 hours"))


def _plan(spark, directory, events=None):
    ledger = settle(retention.daily_ledger(i.parsed_lines(spark, directory) if events is None else events, ("key",)))
    pinned = retention.protected_days(_pins(spark, directory))
    budget = ledger.agg(F.sum("bytes")).first()[0] * 0.5
    return ledger, pinned, retention.expire_plan(ledger, pinned, budget, "2024-01-20")


@query(f"""with {LEDGER} select * from led""")
def daily_ledger(spark, directory):
    """Rows, key bytes and offset bounds per day and partition."""
    return retention.daily_ledger(i.parsed_lines(spark, directory), ("key",)).select(
        "day", F.col("partition").cast("bigint").alias("partition"), "row_count", "bytes", "min_offset", "max_offset")


@query("select * from (values ('2024-01-02'), ('2024-01-03'), ('2024-01-04'), ('2024-01-10'), ('2024-01-11')) v(day)")
def protected_days(spark, directory):
    """Days touched by pinned intervals."""
    return retention.protected_days(_pins(spark, directory))


@query(f"with {LEDGER} select day, row_count, bytes, pinned, running_bytes, expire from expiry")
def expire_plan(spark, directory):
    """Running size by day and the days to drop."""
    return _plan(spark, directory)[2]


@query(f"""with {LEDGER} select cast(sum(row_count) as bigint) as row_count, cast(sum(bytes) as bigint) as total_bytes, cast(coalesce(sum(bytes) filter (pinned), 0) as bigint) as pinned_bytes,
  cast(sum(bytes) filter (not pinned) as bigint) as unpinned_bytes, count(*) as accounted_days, min(day) as oldest_day, sum(bytes) filter (not pinned) > 1000 as over_target from days""")
def ledger_status(spark, directory):
    """Totals of the history and whether it is over budget."""
    ledger, pinned, _ = _plan(spark, directory)
    return retention.ledger_status(ledger, pinned, 1000)


@query(f"""with {LEDGER}, pins as (select day from days where pinned)
select "offset" from log where strftime(ingested_at, '%Y-%m-%d') in (select day from expiry where expire)
  and "offset" <= case "partition" when 0 then 3000 else 4001 end
  and not coalesce(strftime(event_ts, '%Y-%m-%d') in (select day from pins), false) and strftime(ts, '%Y-%m-%d') not in (select day from pins)
  and strftime(ingested_at, '%Y-%m-%d') not in (select day from pins)""")
def expired_events(spark, directory):
    """Lines the plan drops: unpinned and already processed."""
    events = i.parsed(spark, directory)
    _, pinned, plan = _plan(spark, directory, events)
    done = events.groupBy("source_id", "topic", "partition").agg(F.lit(0).alias("z")).select(
        "source_id", "topic", "partition", F.when(F.col("partition") == 0, 3000).otherwise(4001).cast("bigint").alias("last_offset"))
    return retention.expired_events(events, plan, pinned, done).select("offset")

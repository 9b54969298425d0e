"""A randomised experiment replayed over orders (requests) and line items (outcomes)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from slatewise.functions import scalars as s
from slatewise.operators import experiment as ex
from slatewise.plans import inputs as i
from slatewise.plans.registry import query

YEAR = 365 * 86_400
PLAN = ex.Plan("sample-1", "sample-salt", datetime(1997, 1, 1, tzinfo=UTC), datetime(1999, 1, 1, tzinfo=UTC), YEAR, "v-control", "v-treated")


def _requests(spark, directory):
    orders, key = i.table(spark, directory, "orders"), F.col("o_orderkey")
    arm = s.assigned_arm(PLAN.salt, F.col("o_custkey") + 1, 50)
    rows = orders.select(key.cast("string").alias("request_id"), (F.col("o_custkey") + 1).alias("user_id"), F.col("o_orderdate").alias("started_at"),
                         F.lit(PLAN.id).alias("experiment_id"), arm.alias("assigned_arm"), key.alias("_k"))
    return rows.withColumns({
        "status": F.when(F.col("_k") % 23 == 0, 503).otherwise(200), "actual_arm": F.when(F.col("_k") % 31 == 0, "control").otherwise(F.col("assigned_arm")),
        "served_version": F.when(F.when(F.col("_k") % 31 == 0, "control").otherwise(F.col("assigned_arm")) == "control", PLAN.control_version)
        .otherwise(PLAN.treatment_version)}).drop("_k")


def _observations(spark, directory):
    """Outcome per line item; the offset orders all columns, so repeated line keys stay apart."""
    items = i.history(spark, directory)
    return items.select(
        (F.col("l_orderkey") % 4).cast("int").alias("partition"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), F.lpad(F.col("movie_id"), 12, "0"),
                    F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"), F.date_format("timestamp", "yyyyMMdd"), F.col("event_type")).alias("offset"),
        "user_id", "movie_id", "timestamp", F.col("event_type").alias("kind"),
        F.coalesce(F.col("rating"), F.col("l_quantity").cast("int")).cast("bigint").alias("value")).dropDuplicates(["partition", "offset"])


EXPERIMENT = i.HISTORY + ", " + i.FEES + """,
req as (select o_orderkey as k, o_custkey + 1 as user_id, o_orderdate as started_at,
  case when ('0x' || substr(sha256('sample-salt:' || cast(o_custkey + 1 as varchar)), 1, 16))::ubigint % 10000 < 5000 then 'treatment' else 'control' end as arm from orders),
cohort as (select user_id, arm, min(started_at) as exposure from req where started_at >= timestamp '1997-01-01' and started_at < timestamp '1999-01-01' group by 1, 2),
obs as (select distinct l_orderkey % 4 as "partition", lpad(cast(l_orderkey as varchar), 12, '0') || '-' || cast(l_linenumber as varchar) || '-' || lpad(movie_id, 12, '0') || '-'
    || lpad(cast(cast(l_quantity as int) as varchar), 3, '0') || '-' || strftime("timestamp", '%Y%m%d') || '-' || event_type as "offset", user_id, movie_id, "timestamp", event_type as kind,
    cast(coalesce(rating, cast(l_quantity as int)) as bigint) as value from history),
inside as (select o.*, c.arm, c.exposure from obs o join cohort c using (user_id) where o."timestamp" > c.exposure and o."timestamp" < c.exposure + interval 365 day),
pair as (select user_id, movie_id, min("timestamp") filter (kind = 'watch') as first_watch, arg_max(value, ("timestamp", "partition", "offset")) filter (kind = 'rating') as last_rating,
    max("timestamp") filter (kind = 'rating') as rated_at from inside group by 1, 2),
outcome as (select user_id, movie_id, first_watch, case when rated_at >= first_watch then last_rating end as rating from pair where first_watch is not null),
priced as (select o.*, case when f.movie_id is null then 'missing_catalog' when fee_status = 'invalid' then 'invalid_fee' when fee_status = 'missing' then 'missing_fee' else 'covered' end as unit_status, fee
  from outcome o left join fees f using (movie_id)),
per_user as (select user_id, count(*) as observed_units, count(*) filter (unit_status = 'covered') as covered_units, count(*) filter (unit_status = 'missing_catalog') as missing_catalog_units,
  count(*) filter (unit_status = 'missing_fee') as missing_fee_units, count(*) filter (unit_status = 'invalid_fee') as invalid_fee_units, sum(fee) as known_spend,
  count(rating) as rated_units, cast(sum(rating) as bigint) as rating_sum, avg(rating) as mean_rating from priced group by 1),
people as (select c.*, coalesce(observed_units, 0) as observed_units, coalesce(covered_units, 0) as covered_units, coalesce(missing_catalog_units, 0) as missing_catalog_units,
  coalesce(missing_fee_units, 0) as missing_fee_units, coalesce(invalid_fee_units, 0) as invalid_fee_units, coalesce(known_spend, 0) as known_spend, coalesce(rated_units, 0) as rated_units,
  coalesce(rating_sum, 0) as rating_sum, mean_rating from cohort c left join per_user using (user_id))
"""


def _users(spark, directory):
    cohort = ex.first_exposure(_requests(spark, directory), PLAN)
    inside = ex.outcomes_in_follow_up(cohort, _observations(spark, directory), PLAN.follow_up_seconds)
    return ex.user_rows(cohort, ex.user_outcomes(inside), i.fees(spark, directory))


@query(f"with {EXPERIMENT} select user_id, arm, epoch_us(exposure) as exposure_us from cohort")
def first_exposure(spark, directory):
    """Arm and first request of every enrolled user."""
    return ex.first_exposure(_requests(spark, directory), PLAN).select("user_id", "arm", F.unix_micros("exposure").alias("exposure_us"))


@query("""select 'consistent' as problem, count(*) as n from orders union all select 'conflicting_duplicate', 0""")
def request_problems(spark, directory):
    """Assignment, version and duplicate checks of the experiment log."""
    return ex.request_problems(_requests(spark, directory), PLAN)


@query(f"""with {EXPERIMENT} select count(*) as requests, count(*) filter (k % 23 <> 0 and k % 31 = 0 and arm <> 'control') as fallback_requests,
  count(*) filter (k % 23 = 0) as failed_requests from req""")
def experiment_telemetry(spark, directory):
    """Requests, fallbacks and failures."""
    return ex.telemetry(_requests(spark, directory), PLAN)


@query(f"with {EXPERIMENT} select kind, arm, count(*) as n, count(distinct user_id) as users from inside group by 1, 2")
def follow_up_outcomes(spark, directory):
    """Outcomes strictly inside each user's own follow-up."""
    cohort = ex.first_exposure(_requests(spark, directory), PLAN)
    rows = ex.outcomes_in_follow_up(cohort, _observations(spark, directory), PLAN.follow_up_seconds)
    return rows.groupBy("kind", "arm").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"with {EXPERIMENT} select user_id, movie_id, epoch_us(first_watch) as first_us, rating from outcome")
def user_outcomes(spark, directory):
    """First watch and later rating per user and movie."""
    cohort = ex.first_exposure(_requests(spark, directory), PLAN)
    rows = ex.outcomes_in_follow_up(cohort, _observations(spark, directory), PLAN.follow_up_seconds)
    return ex.user_outcomes(rows).select("user_id", "movie_id", F.unix_micros("first_watch").alias("first_us"), "rating")


@query(f"""with {EXPERIMENT}
select arm, count(*) as assigned_users, count(*) filter (observed_units > 0) as users_with_watches, cast(sum(observed_units) as bigint) as observed_units,
  cast(sum(covered_units) as bigint) as covered_units, cast(sum(missing_catalog_units) as bigint) as missing_catalog_units, cast(sum(missing_fee_units) as bigint) as missing_fee_units,
  cast(sum(invalid_fee_units) as bigint) as invalid_fee_units, cast(sum(rated_units) as bigint) as rated_units, cast(sum(rating_sum) as bigint) as rating_sum,
  round(cast(sum(known_spend) as double), 4) as known_spend, count(*) filter (covered_units = observed_units) as users_with_complete_fees,
  count(mean_rating) as rating_users, round(avg(mean_rating), 6) as mean_user_rating, round(sum(covered_units) / cast(sum(observed_units) as double), 6) as fee_coverage,
  cast(null as double) as total_spend, cast(null as double) as mean_spend_per_assigned_user,
  round(cast(sum(known_spend) as double) / count(*), 6) as mean_known_spend_per_assigned_user, cast(null as double) as mean_fee_per_observed_unit,
  round(cast(sum(known_spend) as double) / sum(covered_units), 6) as mean_known_fee_per_covered_unit, round(count(mean_rating) / cast(count(*) as double), 6) as rating_user_coverage,
  round(sum(rated_units) / cast(sum(observed_units) as double), 6) as rating_unit_coverage, round(sum(rating_sum) / cast(sum(rated_units) as double), 6) as mean_submitted_rating
from people group by arm""")
def arm_summary(spark, directory):
    """Arm totals, coverage and means with unknown spend kept null."""
    out = ex.arm_summary(_users(spark, directory))
    doubles = [f.name for f in out.schema if f.dataType.typeName() == "double"]
    return out.withColumn("known_spend", F.round(F.col("known_spend").cast("double"), 4)).withColumns({c: F.round(c, 6) for c in doubles})


@query(f"""with {EXPERIMENT}, x as (select arm, 'spend_per_user_with_complete_fees' as metric, cast(known_spend as double) as v from people where covered_units = observed_units
  union all select arm, 'mean_rating_per_rater', mean_rating from people where mean_rating is not null)
select arm, metric, count(*) as n, round(avg(v), 6) as mean, round(var_samp(v), 4) as variance from x group by 1, 2""")
def arm_moments(spark, directory):
    """Count, mean and variance behind each test."""
    return ex.arm_moments(_users(spark, directory)).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


def _inner(t: str, df: str) -> str:
    """SQL for the chance that Student's t lies between 0 and `t`: Simpson's rule with 1,000 steps."""
    return (f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * {t} / 3000 * list_sum([(case when k = 0 or k = 1000 then 1 when k % 2 = 1 then 4 else 2 end) "
            f"* pow(1 + pow({t} * k / 1000, 2) / {df}, -({df} + 1) / 2) for k in range(0, 1001)])")


TESTS = EXPERIMENT + f""",
samples as (select arm, 'spend_per_user_with_complete_fees' as metric, cast(known_spend as double) as v from people where covered_units = observed_units
  union all select arm, 'mean_rating_per_rater', mean_rating from people where mean_rating is not null),
moments as (select metric, count(v) filter (arm = 'control') as n0, count(v) filter (arm = 'treatment') as n1, avg(v) filter (arm = 'control') as m0, avg(v) filter (arm = 'treatment') as m1,
    coalesce(var_samp(v) filter (arm = 'control'), 0) as v0, coalesce(var_samp(v) filter (arm = 'treatment'), 0) as v1
  from (select unnest(['spend_per_user_with_complete_fees', 'mean_rating_per_rater']) as metric) left join samples using (metric) group by 1),
spread as (select metric, m1 - m0 as gap, sqrt(v0 / n0 + v1 / n1) as error, pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)) as df
  from moments where n0 > 1 and n1 > 1 and v0 + v1 > 0),
halving as (select metric, df, 0e0 as lo, 64e0 as hi, 0 as step from spread union all
  select metric, df, case when inner_mass < 0.475 then (lo + hi) / 2 else lo end, case when inner_mass < 0.475 then hi else (lo + hi) / 2 end, step + 1
  from (select *, {_inner("((lo + hi) / 2)", "df")} as inner_mass from halving where step < 50)),
limits as (select metric, (lo + hi) / 2 as most from halving where step = 50),
tested as (select m.metric, n0 as control_users, n1 as treatment_users, m1 - m0 as difference, gap - most * error as ci_low, gap + most * error as ci_high,
    1 - 2 * {_inner("(abs(gap) / error)", "s.df")} as p_value,
    case when least(n0, n1) < 2 then 'insufficient_users' when v0 + v1 = 0 then 'no_observed_variation' else 'estimated' end as status
  from moments m left join spread s using (metric) left join limits using (metric)),
gaps as (select count(*) filter (covered_units <> observed_units) as missing from people),
spend as (select 'spend_per_assigned_user' as metric, t.* exclude (metric) from tested t where metric = 'spend_per_user_with_complete_fees'),
arms as (select count(*) filter (arm = 'control') as n0, count(*) filter (arm = 'treatment') as n1, count(*) as n from people),
pooled as (select arm, case when sum(covered_units) = sum(observed_units) then cast(sum(known_spend) as double) / nullif(sum(observed_units), 0) end as fee from people group by 1),
tail as (select 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) as p from (select n, unnest(range(0, least(n0, n1) + 1)) as k from arms)),
compared as (select * from tested
  union all select metric, control_users, treatment_users, case when missing = 0 then difference end, case when missing = 0 then ci_low end, case when missing = 0 then ci_high end,
    case when missing = 0 then p_value end, case when missing = 0 then status else 'unknown_missing_fees' end from spend, gaps
  union all select 'assignment_balance', n0, n1, null, null, null, case when n0 = n1 then 1 else least(p, 1) end, 'estimated' from arms, tail
  union all select 'mean_fee_per_observed_unit', n0, n1, (select t.fee - c.fee from pooled c, pooled t where c.arm = 'control' and t.arm = 'treatment'), null, null, null, 'descriptive' from arms
  union all select 'users_in_both_arms', n0, n1, null, null, null, null, case when n0 > 0 and n1 > 0 then 'yes' else 'no' end from arms)
"""


@query(f"""with recursive {TESTS} select metric, control_users, treatment_users, round(difference, 6) as difference, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high,
  round(cast(p_value as double), 6) as p_value, status from compared""")
def arm_comparison(spark, directory):
    """Welch tests and assignment balance."""
    out = ex.compare_arms(_users(spark, directory))
    return out.withColumns({c: F.round(c, 6) for c in ("difference", "ci_low", "ci_high", "p_value")})

"""Randomised experiment: assignment, exposure, outcomes, arm summaries and tests."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt
from slatewise.functions.scalars import assigned_arm, in_window, ratio
from slatewise.functions.statistics import balance_p_value, welch
from slatewise.operators.cost import MONEY, price_units
from slatewise.operators.quality import DataError, dedup_or_conflict, fingerprinted, reason_column
from slatewise.session import written

ARMS = ("control", "treatment")


@dataclass(frozen=True)
class Plan:
    """Fixed parameters of one experiment; times are timezone-aware."""

    id: str
    salt: str
    start: datetime
    enrollment_end: datetime
    follow_up_seconds: float
    control_version: str
    treatment_version: str
    treatment_percent: int = 50

    def __post_init__(self):
        if re.fullmatch(r"[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}", self.id) is None:
            raise ValueError("Experiment ID must contain 1-64 letters, digits, hyphens or underscores")
        if self.start.tzinfo is None or self.enrollment_end.tzinfo is None:
            raise ValueError("Experiment times need a timezone")
        if self.start >= self.enrollment_end or self.follow_up_seconds <= 0:
            raise ValueError("Enrollment has to end after it starts, and the follow-up to last some time")
        if self.treatment_percent != 50 or not self.salt:
            raise ValueError("Experiments use a fixed 50/50 split and a saved salt")
        if not self.control_version or not self.treatment_version:
            raise ValueError("Record both served versions before starting")

    @property
    def observation_end(self) -> datetime:
        return self.enrollment_end + timedelta(seconds=self.follow_up_seconds)


def checked_requests(requests: DataFrame, plan: Plan) -> DataFrame:
    """Distinct requests with `problem` (null when consistent), `fallback` and `failed` flags."""
    rows = requests.dropDuplicates(["request_id"])
    expected = assigned_arm(plan.salt, F.col("user_id"), plan.treatment_percent)
    served = F.when(F.col("actual_arm") == "control", plan.control_version).when(
        F.col("actual_arm") == "treatment", plan.treatment_version)
    ok = F.col("status").eqNullSafe(F.lit(200))
    return rows.withColumns({
        "problem": reason_column(
            ("other_experiment", F.col("experiment_id") != plan.id),
            ("assignment_differs", ~F.col("assigned_arm").eqNullSafe(expected)),
            ("served_version_changed", ok & ~F.col("served_version").eqNullSafe(served))),
        "fallback": ok & (F.col("actual_arm") != F.col("assigned_arm")), "failed": ~ok})


def request_problems(requests: DataFrame, plan: Plan) -> DataFrame:
    """(problem, n), with conflicting copies of a request id counted as `conflicting_duplicate`."""
    copies = dedup_or_conflict(fingerprinted(requests), ["request_id"])
    conflicts = copies.agg(F.lit("conflicting_duplicate").alias("problem"), F.count_if("conflict").alias("n"))
    found = checked_requests(requests, plan).groupBy(F.coalesce("problem", F.lit("consistent")).alias("problem")).agg(
        F.count(F.lit(1)).alias("n"))
    return found.unionByName(conflicts)


def telemetry(requests: DataFrame, plan: Plan) -> DataFrame:
    return checked_requests(requests, plan).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("fallback").alias("fallback_requests"),
        F.count_if("failed").alias("failed_requests"))


def first_exposure(requests: DataFrame, plan: Plan) -> DataFrame:
    """(user, arm, exposure): earliest request inside the enrolment window."""
    rows = checked_requests(requests, plan).where(
        in_window(F.col("started_at"), plan.start, plan.enrollment_end))
    return rows.groupBy("user_id").agg(F.min("started_at").alias("exposure"), F.min("assigned_arm").alias("arm")).select(
        "user_id", "arm", "exposure")


def outcomes_in_follow_up(cohort: DataFrame, observations: DataFrame, follow_up_seconds: float) -> DataFrame:
    """Observations strictly inside each user's own follow-up.

    Plain equi-join: the cohort has one row per user, so a very active user is a skewed probe side
    only, which AQE splits.
    """
    distinct = observations.dropDuplicates(["partition", "offset"])
    end = F.col("exposure") + F.make_dt_interval(secs=F.lit(follow_up_seconds).cast("decimal(18,6)"))
    return distinct.join(cohort, "user_id").where((F.col("timestamp") > F.col("exposure")) & (F.col("timestamp") < end))


def user_outcomes(outcomes: DataFrame) -> DataFrame:
    """(user, movie, first_watch, rating): the newest rating, if not older than the first watch."""
    watch, rating = F.col("kind") == "watch", F.col("kind") == "rating"
    order = F.struct("timestamp", "partition", "offset")
    pairs = outcomes.groupBy("user_id", "movie_id").agg(
        F.min(F.when(watch, F.col("timestamp"))).alias("first_watch"),
        F.max_by(F.when(rating, F.col("value")), F.when(rating, order)).alias("_rating"),
        F.max(F.when(rating, F.col("timestamp"))).alias("_rated_at"))
    return pairs.where("first_watch is not null").select(
        "user_id", "movie_id", "first_watch",
        F.when(F.col("_rated_at") >= F.col("first_watch"), F.col("_rating")).alias("rating"))


def user_rows(cohort: DataFrame, pairs: DataFrame, fees: DataFrame) -> DataFrame:
    """One row per assigned user, including users without any outcome."""
    priced = price_units(pairs, fees)
    count = lambda state: F.count_if(F.col("unit_status") == state).alias(f"{state}_units")
    per_user = priced.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("observed_units"), *[count(s) for s in ("covered", "missing_catalog", "missing_fee", "invalid_fee")],
        F.sum("fee").alias("known_spend"), F.count("rating").alias("rated_units"), F.sum("rating").alias("rating_sum"),
        F.avg("rating").alias("mean_rating"))
    counts = [c for c in per_user.columns if c.endswith("_units")] + ["rating_sum"]
    return (cohort.join(per_user, "user_id", "left")
            .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
            .withColumn("known_spend", F.coalesce("known_spend", F.lit(0).cast(MONEY)).cast(MONEY)))


def arm_summary(users: DataFrame) -> DataFrame:
    """One row per arm: users, units, coverage, spend, ratings; anything with an unknown part is null."""
    units, covered, rows = F.col("observed_units"), F.col("covered_units"), F.col("assigned_users")
    known = F.col("known_spend").cast("double")
    complete = covered == units
    summed = users.groupBy("arm").agg(
        F.count(F.lit(1)).alias("assigned_users"), F.count_if(units > 0).alias("users_with_watches"),
        *[F.sum(c).alias(c) for c in ("observed_units", "covered_units", "missing_catalog_units", "missing_fee_units",
                                      "invalid_fee_units", "rated_units", "rating_sum", "known_spend")],
        F.count_if(covered == units).alias("users_with_complete_fees"),
        F.count("mean_rating").alias("rating_users"), F.avg("mean_rating").alias("mean_user_rating"))
    return summed.withColumns({
        "fee_coverage": ratio(covered, units), "total_spend": F.when(complete, known),
        "mean_spend_per_assigned_user": F.when(complete, ratio(known, rows)),
        "mean_known_spend_per_assigned_user": ratio(known, rows),
        "mean_fee_per_observed_unit": F.when(complete, ratio(known, units)),
        "mean_known_fee_per_covered_unit": ratio(known, covered),
        "rating_user_coverage": ratio(F.col("rating_users"), rows),
        "rating_unit_coverage": ratio(F.col("rated_units"), units),
        "mean_submitted_rating": ratio(F.col("rating_sum"), F.col("rated_units"))})


def arm_moments(users: DataFrame) -> DataFrame:
    """(arm, metric, n, mean, variance) of the per-user samples behind each comparison."""
    spend = F.col("known_spend").cast("double")
    complete = F.col("covered_units") == F.col("observed_units")
    metrics = F.explode(F.array(
        F.struct(F.lit("spend_per_user_with_complete_fees").alias("metric"), F.when(complete, spend).alias("x")),
        F.struct(F.lit("mean_rating_per_rater").alias("metric"), F.col("mean_rating").alias("x"))))
    long = users.select("arm", metrics.alias("m")).select("arm", "m.metric", "m.x").where("x is not null")
    return long.groupBy("arm", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))


def compare_arms(users: DataFrame) -> DataFrame:
    """(metric, difference, ci_low, ci_high, p_value, status, ...): Welch tests from two moments per arm, the difference of the
    pooled fee per viewing unit (a description, null where a fee is unknown), and whether both arms have users.

    Only a few numbers per arm reach the driver.
    """
    spark = users.sparkSession
    users = written(users.select("arm", "covered_units", "observed_units", "known_spend", "mean_rating"), "arms")  # read three times
    moments = {(r.metric, r.arm): (r.n, r.mean, r.variance or 0.0) for r in arm_moments(users).collect()}
    gaps = users.agg(F.count_if(F.col("covered_units") != F.col("observed_units")).alias("n")).first().n
    units, covered = F.sum("observed_units"), F.sum("covered_units")
    arms = {r.arm: r for r in users.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.when(covered == units, ratio(F.sum("known_spend").cast("double"), units)).alias("fee")).collect()}
    sizes = {arm: r.n for arm, r in arms.items()}
    fees = [arms[arm].fee if arm in arms else None for arm in ARMS]
    empty = (0, None, 0.0)
    rows = []
    for metric in ("spend_per_user_with_complete_fees", "mean_rating_per_rater"):
        rows.append((metric, welch(*[moments.get((metric, arm), empty) for arm in ARMS])))
    spend = dict(rows[0][1])
    if gaps:
        spend.update(status="unknown_missing_fees", difference=None, ci_low=None, ci_high=None, p_value=None)
    rows.append(("spend_per_assigned_user", spend))
    total = sum(sizes.values())
    rows.append(("assignment_balance", {
        "control_users": sizes.get("control", 0), "treatment_users": sizes.get("treatment", 0), "difference": None,
        "ci_low": None, "ci_high": None, "p_value": balance_p_value(sizes.get("treatment", 0), total),
        "status": "estimated" if total else "insufficient_users"}))
    counts = {f"{arm}_users": sizes.get(arm, 0) for arm in ARMS} | dict.fromkeys(("difference", "ci_low", "ci_high", "p_value"))
    rows.append(("mean_fee_per_observed_unit", counts | {"difference": None if None in fees else fees[1] - fees[0], "status": "descriptive"}))
    rows.append(("users_in_both_arms", counts | {"status": "yes" if all(sizes.get(arm, 0) for arm in ARMS) else "no"}))
    fields = ("control_users", "treatment_users", "difference", "ci_low", "ci_high", "p_value", "status")
    return spark.createDataFrame(
        [(name, *[row[f] for f in fields]) for name, row in rows],
        "metric string, control_users long, treatment_users long, difference double, ci_low double, ci_high double, "
        "p_value double, status string")


def analyze(requests: DataFrame, observations: DataFrame, fees: DataFrame, plan: Plan) -> DataFrame:
    """Per-user rows of a consistent experiment; raises when any check fails."""
    bad = request_problems(requests, plan).where("problem <> 'consistent' and n > 0").collect()
    if bad:
        raise DataError("; ".join(f"{r.problem}: {r.n}" for r in bad))
    wrong = observations.where((F.col("kind") == "rating") & ~F.coalesce(
        F.col("value").between(fmt.MIN_RATING, fmt.MAX_RATING), F.lit(False)))
    if wrong.limit(1).count():
        raise DataError("Ratings must be submitted integers from 1 to 10")
    conflicts = dedup_or_conflict(fingerprinted(observations), ["partition", "offset"]).where("conflict")
    if conflicts.limit(1).count():
        raise DataError("Conflicting outcomes at one offset")
    cohort = first_exposure(requests, plan)
    return user_rows(cohort, user_outcomes(outcomes_in_follow_up(cohort, observations, plan.follow_up_seconds)), fees)

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slatewise.functions.statistics import balance_p_value, t_quantile, t_two_sided, welch
from slatewise.operators import availability, cost, drift, experiment, online, sessions
from slatewise.operators.quality import DataError
from slatewise.sources.records import typed_fees

FIELDS = ("struct<minute:bigint,rating:bigint,server:string,status:int,response_time_ms:double,"
          "recommendations:array<struct<movie_id:string,rank:int>>>")
EVENT = (f"partition int, offset bigint, event_ts timestamp, ingested_at timestamp, event_type string, parse_status string, "
         f"error_type string, user_id bigint, movie_id string, fields {FIELDS}")
DAY = datetime(2026, 10, 29)


def at(text):
    return datetime.fromisoformat(f"2026-10-29T{text}")


def slate(offset, time, user, movies=20, server="main", status=200, ranks=None):
    recs = [(f"movie-{n}", (ranks or range(1, movies + 1))[n - 1]) for n in range(1, movies + 1)]
    return (0, offset, at(time), at(time), "recommendation", "parsed", None, user, None, (None, None, server, status, 5.0, recs))


def watch(offset, time, user, movie, minute=1):
    return (0, offset, at(time), at(time), "watch", "parsed", None, user, movie, (minute, None, None, None, None, None))


WINDOW = online.Window("2026-10-29 04:00:00", "2026-10-29 04:30:00", "2026-10-29 05:30:00", 3600, "main")


def measure(spark, rows):
    return online.evaluate_online(spark.createDataFrame(rows, EVENT), WINDOW, require_coverage=False).first()


BASE = [slate(1, "04:00:00", 1), slate(2, "04:00:00", 2)]


def test_base_case(spark):
    row = measure(spark, [*BASE, watch(3, "04:30:00", 1, "movie-1")])
    assert (row.eligible_recommendations, row.hits, row.hit_rate, row.conditional_hit_rate) == (2, 1, 0.5, 1.0)


@pytest.mark.parametrize("time, movie, hit", [
    ("03:59:59", "movie-1", 0), ("04:00:00", "movie-1", 0), ("05:00:00", "movie-1", 0), ("04:30:00", "movie-21", 0),
    ("04:00:01", "movie-20", 1), ("04:59:59", "movie-1", 1)])
def test_boundaries(spark, time, movie, hit):
    row = measure(spark, [*BASE, watch(3, time, 1, movie)])
    assert row.hits == hit
    if movie == "movie-1" and not hit:
        assert row.observed_watchers == 0 and row.conditional_hit_rate is None


def test_eligibility(spark):
    rows = [*BASE, slate(2, "04:00:00", 2), slate(4, "04:10:00", 1, server="other"), slate(5, "04:10:00", 1, status=503), slate(6, "04:10:00", 1, movies=19),
            slate(7, "04:10:00", 1, ranks=[1] * 20), slate(8, "04:30:00", 1), slate(9, "04:10:00", 0), watch(10, "04:10:00", 1, "", 1), watch(11, "04:11:00", 1, "m", -1)]
    tally = {(r.kind, r.drop_reason): r.n for r in online.exclusion_tally(spark.createDataFrame(rows, EVENT), WINDOW).collect()}
    assert tally == {("recommendation", "kept"): 3, ("recommendation", "other_server_recommendations"): 1, ("recommendation", "unsuccessful_recommendations"): 1,
                     ("recommendation", "short_recommendation_slates"): 1, ("recommendation", "invalid_recommendation_slates"): 1,
                     ("recommendation", "invalid_user_rows"): 1, ("watch", "invalid_watch_rows"): 2}
    assert measure(spark, rows).eligible_recommendations == 2  # identical impressions count once
    with pytest.raises(DataError):
        online.evaluate_online(spark.createDataFrame(rows, EVENT), WINDOW)


def test_unknown_cost_is_not_zero(spark):
    units = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "user_id long, movie_id string")
    fees = lambda rows: typed_fees(spark.createDataFrame(rows, "movie_id string, license_cost string"))
    full = cost.licence_cost(cost.price_units(units, fees([("a", "0.1"), ("b", "0.2")]))).first()
    assert str(full.total_cost.normalize()) == "0.4" and full.fee_coverage == 1.0
    for gap in ([("a", "0.1"), ("b", "")], [("a", "0.1"), ("b", "oops")], [("a", "0.1")]):
        row = cost.licence_cost(cost.price_units(units, fees(gap))).first()
        assert row.total_cost is None and str(row.known_cost.normalize()) == "0.2" and row.covered_units == 2
    none = cost.licence_cost(cost.price_units(units.where("false"), fees([("a", "1")]))).first()
    assert none.fee_coverage is None and none.mean_known_fee is None


def test_phases_around_a_switch(spark):
    rows = [slate(n, t, 1, server=s, status=c) for n, (t, s, c) in enumerate([
        ("11:54:00", "main", 200), ("11:58:00", "main", 200), ("12:00:00", "main", 504), ("12:04:59", "main", 200), ("12:05:00", "main", 200), ("12:01:00", "other", 200)])]
    requests = availability.server_requests(spark.createDataFrame(rows, EVENT), "main", "2026-10-29 11:55:00", "2026-10-29 12:05:00")
    phases = {r.phase: r for r in availability.before_after(requests, "2026-10-29 12:00:00").collect()}
    assert phases["overall"].requests == 3 and abs(phases["overall"].availability - 2 / 3) < 1e-12
    assert phases["before"].successful == 1 and phases["after"].failed == 1
    open_ended = availability.availability(requests, spark.createDataFrame([(False,)], "window_bracketed boolean")).first()
    assert open_ended.ratio is None and open_ended.observed_ratio is not None


def test_sessions_split_at_exactly_the_gap(spark):
    times = ["12:00:00", "12:01:00", "12:06:00", "12:07:00"]
    rows = [watch(n, t, 42, "movie_a") for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, EVENT).withColumns({"source_id": F.lit("s"), "topic": F.lit("t")})
    across = df.unionByName(df.withColumn("event_ts", F.col("event_ts") + F.expr("interval 11 hours 57 minutes")).withColumn("offset", F.col("offset") + 10))
    out = sessions.session_records(sessions.sessions(df)).orderBy("session").collect()
    assert [(r.session, r.watches, r.first_ts, r.last_ts) for r in out] == [
        (1, 2, at("12:00:00"), at("12:01:00")), (2, 2, at("12:06:00"), at("12:07:00"))]
    later = sessions.session_records(sessions.sessions(across)).orderBy("session").collect()
    assert [(r.session, r.watches) for r in later] == [(1, 2), (2, 2), (3, 2), (4, 2)]  # 23:57, 23:58 | 00:03, 00:04


# --- experiment -----------------------------------------------------------------------------------------

PLAN = experiment.Plan("p", "fixed-test-salt", datetime(2026, 11, 20, 12, tzinfo=UTC), datetime(2026, 11, 20, 13, tzinfo=UTC), 3600, "v0", "v1")


def arms(spark, n=60):
    from slatewise.functions.scalars import assigned_arm
    rows = spark.range(1, n).select(F.col("id").alias("user_id"), assigned_arm(PLAN.salt, F.col("id"), 50).alias("arm")).collect()
    control, treated = ([r.user_id for r in rows if r.arm == a] for a in experiment.ARMS)
    return control[:3], treated[:3]


def build(spark, outcomes, fees):
    control, treated = arms(spark)
    start = datetime(2026, 11, 20, 12, 10)
    requests = [(f"r{u}-{n}", u, start + timedelta(minutes=n), "p", arm, 200, arm, v) for arm, v, us in (("control", "v0", control), ("treatment", "v1", treated))
                for u in us for n in (0, 5)]
    req = spark.createDataFrame(requests, "request_id string, user_id long, started_at timestamp, experiment_id string, assigned_arm string, status int, actual_arm string, served_version string")
    people = control + treated
    obs = [(0, n, people[i], movie, start + timedelta(minutes=m), kind, value) for n, (i, movie, m, kind, value) in enumerate(outcomes)]
    obs = spark.createDataFrame(obs, "partition int, offset long, user_id long, movie_id string, timestamp timestamp, kind string, value long")
    fee = typed_fees(spark.createDataFrame(fees, "movie_id string, license_cost string"))
    return req, obs, fee


FEES = [("movie", "2"), ("expensive", "4"), ("cheap", "1")]


def test_arm_summary(spark):
    outcomes = [(0, "expensive", 10, "watch", 1), (0, "expensive", 11, "rating", 9), (1, "movie", 5, "watch", 1), (1, "movie", 4, "rating", 3),
                (3, "cheap", 5, "watch", 1), (3, "cheap", 6, "rating", 7), (4, "cheap", 5, "watch", 1), (4, "cheap", 7, "rating", 2), (4, "cheap", 9, "rating", 8),
                (2, "movie", 0, "watch", 1), (2, "movie", 60, "watch", 1)]
    users = experiment.analyze(*build(spark, outcomes, FEES), PLAN)
    got = {r.arm: r for r in experiment.arm_summary(users).collect()}
    assert (got["control"].assigned_users, got["control"].observed_units, got["control"].mean_spend_per_assigned_user) == (3, 2, 2.0)
    assert got["control"].mean_user_rating == 9 and abs(got["control"].rating_user_coverage - 1 / 3) < 1e-12  # rating before the watch is ignored
    assert abs(got["treatment"].mean_spend_per_assigned_user - 2 / 3) < 1e-12 and got["treatment"].mean_user_rating == 7.5
    tests = {r.metric: r for r in experiment.compare_arms(users).collect()}
    assert tests["mean_rating_per_rater"].status == "insufficient_users" and tests["assignment_balance"].p_value == 1.0


def test_unknown_fee_blocks_spend(spark):
    users = experiment.analyze(*build(spark, [(0, "new", 5, "watch", 1), (3, "cheap", 5, "watch", 1)], FEES), PLAN)
    got = {r.arm: r for r in experiment.arm_summary(users).collect()}
    assert got["control"].total_spend is None and got["control"].missing_catalog_units == 1 and got["treatment"].total_spend == 1.0
    tests = {r.metric: r for r in experiment.compare_arms(users).collect()}
    assert tests["spend_per_assigned_user"].status == "unknown_missing_fees" and tests["spend_per_assigned_user"].difference is None


def test_inconsistent_requests_stop_the_analysis(spark):
    req, obs, fee = build(spark, [], FEES)
    with pytest.raises(DataError, match="assignment_differs"):
        experiment.analyze(req.withColumn("assigned_arm", F.lit("control")), obs, fee, PLAN)
    with pytest.raises(DataError, match="conflicting_duplicate"):
        experiment.analyze(req.unionByName(req.limit(1).withColumn("status", F.lit(500))), obs, fee, PLAN)
    with pytest.raises(DataError, match="served_version_changed"):
        experiment.analyze(req.withColumn("served_version", F.lit("v9")), obs, fee, PLAN)


def test_statistics():
    assert abs(t_two_sided(2.0, 10) - 0.07338803) < 1e-7 and abs(t_quantile(0.95, 10) - 2.228138852) < 1e-7
    assert abs(t_quantile(0.95, 1e6) - 1.959966) < 1e-5
    assert balance_p_value(5, 10) == 1.0 and abs(balance_p_value(2, 10) - 0.109375) < 1e-12 and balance_p_value(0, 0) is None
    row = welch((4, 2.0, 5 / 3), (5, 4.0, 2.5))
    t, df = 2 / (5 / 12 + 0.5) ** 0.5, (5 / 12 + 0.5) ** 2 / ((5 / 12) ** 2 / 3 + 0.25 / 4)
    assert abs(row["p_value"] - t_two_sided(t, df)) < 1e-12 and abs((row["ci_low"] + row["ci_high"]) / 2 - 2.0) < 1e-9
    assert welch((2, 1.0, 0.0), (2, 1.0, 0.0))["status"] == "no_observed_variation" and welch((1, 1.0, 0.0), (2, 1.0, 1.0))["status"] == "insufficient_users"


# --- drift ----------------------------------------------------------------------------------------------

def histogram(spark, n=100, **changes):
    base = {("kafka", "event_type", "rating"): n, ("user_api", "age", "2"): n, ("movie_api", "cost", "3"): n, ("recommendation_api", "status", "200"): n}
    rows = []
    for (source, feature, category), count in base.items():
        if source in changes:
            feature, category = changes[source]
        bad = feature == "error"
        rows += [(source, "schema", "invalid" if bad else "valid", count), (source, feature, category, count)]
    return spark.createDataFrame(rows, "source string, feature string, category string, n long")


def test_drift_findings(spark):
    reference = histogram(spark)
    assert drift.passes_against_itself(reference)
    for source, change in (("kafka", ("event_type", "account_created")), ("user_api", ("age", "4")), ("movie_api", ("cost", "0")), ("recommendation_api", ("status", "500"))):
        found = drift.drift_findings(reference, histogram(spark, **{source: change})).collect()
        assert {(r.source, r.reason) for r in found} == {(source, "strong_drift")}
    few = drift.drift_findings(reference, histogram(spark, 49)).collect()
    assert len(few) == 4 and {r.reason for r in few} == {"insufficient_samples"}
    broken = {r.reason for r in drift.drift_findings(reference, histogram(spark, movie_api=("error", "invalid_cost"))).where("source = 'movie_api'").collect()}
    assert "schema_failure_rate" in broken
    watches = spark.createDataFrame([("kafka", "event_type", "watch", 4675)], reference.schema)
    assert drift.drift_findings(reference, reference.unionByName(watches)).count() == 0


def test_undated_watches_are_kept(spark):
    """A watch without a time counts at the broker's time."""
    rows = [("s", "t", 1, "m", "2026-01-01 12:00:00", 1767268800000, 1), ("s", "t", 1, "m", None, 1767268860000, 2), ("s", "t", 1, "m", None, None, 3)]
    df = spark.createDataFrame(rows, "source_id string, topic string, user_id long, movie_id string, at string, broker_timestamp_ms long, offset long")
    out = sessions.sessions(df.withColumn("event_ts", F.to_timestamp("at"))).orderBy("offset").collect()
    assert [r.offset for r in out] == [1, 2, 3] and out[0].session == out[1].session != out[2].session

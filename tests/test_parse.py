import pytest
from pyspark.sql import functions as F

from slatewise.functions.parse import parse_events, with_event_time

CASES = [  # body, status, error, event type, checks on fields
    ("GET /data/m/movie_name+2026/17.mpg", "parsed", None, "watch", {"minute": 17}),
    ("GET /rate/movie_a=10", "parsed", None, "rating", {"rating": 10}),
    ("GET /rate/movie_a=0", "failed", "InvalidRating", "rating", {"rating": 0}),
    ("GET /rate/movie_a=11", "failed", "InvalidRating", "rating", {}),
    ("GET /rate/movie_a=-1", "failed", "InvalidRating", "rating", {}),
    ("GET /rate/movie_a=1.5", "failed", "InvalidRatingEvent", "rating", {}),
    ("GET /data/m/movie_a/-1.mpg", "failed", "InvalidWatchMinute", "watch", {"minute": -1}),
    ("GET /data/m/movie_a/1.mpg/extra", "failed", "InvalidWatchEvent", "watch", {}),
    ("GET /data/m/a,b/1.mpg", "failed", "InvalidMovieID", "watch", {}),
    ("GET /rate/[a]=9", "failed", "InvalidMovieID", "rating", {}),
    ("GET /create_account", "parsed", None, "account_created", {}),
    ("GET /create_account?role=admin", "unrecognized", None, None, {"query": {"role": ["admin"]}}),
    ("POST /create_account", "unrecognized", None, None, {}),
    ("recommendation request server-1:8082, status 200, result: movie_b,movie_a,movie_b, 12.5 ms", "parsed", None,
     "recommendation", {"ids": ["movie_b", "movie_a", "movie_b"], "response_time_ms": 12.5}),
    ("recommendation request server-1:8082, status 200, result: ['movie_a', 'movie_b'], 5 ms", "parsed", None,
     "recommendation", {"ids": ["movie_a", "movie_b"], "response_time_ms": 5.0}),
    ("recommendation request server-1:8082, status 200, result: [movie_a, movie_b], 5 ms", "parsed", None,
     "recommendation", {"ids": ["movie_a", "movie_b"]}),
    ("recommendation request server-1:8082, status 200, result: [1, 2], 5 ms", "failed", "InvalidRecommendationResult", "recommendation", {}),
    ("recommendation request server-1:8082, status 200, result: a b,c, 5 ms", "failed", "InvalidRecommendationResult", "recommendation", {}),
    ("recommendation request s, status 503, result: Service unavailable, retry later, 1s", "parsed", None, "recommendation",
     {"ids": None, "response_time_ms": 1000.0, "result_text": "Service unavailable, retry later"}),
    ("recommendation request s, status 200, result: movie_a, 1500 us", "parsed", None, "recommendation", {"response_time_ms": 1.5}),
    ("recommendation request s, status 200, result: movie_a, 0.125s", "parsed", None, "recommendation", {"response_time_ms": 125.0}),
    ("recommendation request s, status 200, result: movie_a, 12.5", "parsed", None, "recommendation", {"response_time_ms": None}),
    ("recommendation request s, status 999, result: movie_a, 1s", "failed", "InvalidRecommendationStatus", "recommendation", {}),
    ("recommendation request s, status 200, result: movie_a", "failed", "InvalidRecommendationEvent", "recommendation", {}),
    ("recommendation request nonsense", "failed", "InvalidRecommendationEvent", "recommendation", {}),
]


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(n, bytearray(f"2026-01-01T00:00:00Z,5,{case[0]}".encode())) for n, case in enumerate(CASES)]
    df = parse_events(spark.createDataFrame(rows, "n int, value binary"))
    return {r.n: r for r in df.collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_body(bodies, n):
    _, status, error, kind, checks = CASES[n]
    row = bodies[n]
    assert (row.parse_status, row.error_type, row.event_type) == (status, error, kind)
    for name, value in checks.items():
        if name == "ids":
            found = row.fields.recommendations
            assert (None if found is None else [r.movie_id for r in found]) == value
            assert found is None or [r.rank for r in found] == list(range(1, len(found) + 1))
        else:
            assert row.fields[name] == value


ENVELOPES = [
    (None, "failed", "Tombstone", None), (b"\xff,1,x", "failed", "UnicodeDecodeError", None), (b"a,b", "failed", "InvalidEnvelope", None),
    (b"2026-01-01T00:00:00Z,0,GET /create_account", "failed", "InvalidUserID", None),
    (b"2026-01-01T00:00:00Z, 007 ,GET /create_account", "parsed", None, 7),
    (b"2026-01-01T00:00:00Z,9223372036854775807,GET /create_account", "parsed", None, 2**63 - 1),
    (b"2026-01-01T00:00:00Z,9223372036854775808,GET /create_account", "failed", "InvalidUserID", None),
    (b"bad,0,GET /rate/a=99", "failed", "InvalidRating", None),      # body before user before time
    (b"bad,0,GET /create_account", "failed", "InvalidUserID", None),
    (b"bad,1,GET /create_account", "failed", "InvalidTimestamp", 1),
    (b",1,GET /create_account", "failed", "MissingTimestamp", 1),
]


def test_envelopes_and_precedence(spark):
    rows = [(n, bytearray(e[0]) if e[0] is not None else None) for n, e in enumerate(ENVELOPES)]
    found = {r.n: r for r in parse_events(spark.createDataFrame(rows, "n int, value binary")).collect()}
    for n, (_, status, error, user) in enumerate(ENVELOPES):
        assert (found[n].parse_status, found[n].error_type, found[n].user_id) == (status, error, user), n


@pytest.mark.parametrize("zone, text, expected", [
    ("America/New_York", "2026-03-08T02:30:00", "InvalidTimestamp"), ("America/New_York", "2026-11-01T01:30:00", "AmbiguousTimestamp"),
    ("America/New_York", "2026-07-01T12:00:00", "2026-07-01 16:00:00"), ("UTC", "20260701T120000", "2026-07-01 12:00:00"),
    ("UTC", "2026-07-01", "2026-07-01 00:00:00"), ("UTC", "2026-02-30", "InvalidTimestamp"), ("UTC", "2026-07-01T24:00", "InvalidTimestamp"),
    ("+05:30", "2026-07-01 12:00", "2026-07-01 06:30:00"), ("Nowhere/City", "2026-07-01", "InvalidTimezone"),
    (None, "2026-07-01T12:00:00+01:00", "2026-07-01 11:00:00"), (None, "2026-07-01", None)])
def test_times(spark, zone, text, expected):
    row = with_event_time(spark.createDataFrame([(text,)], "t string"), "t", zone).withColumn("s", F.col("event_ts").cast("string")).first()
    assert (row.time_error or row.s) == expected
    if zone is None and expected is None:
        assert row.timestamp_status == "timezone_missing"


def test_literals_of_slates(spark):
    """Escapes are undone by kind; a list of literals has to hold strings alone, any other bracketed text is a plain list."""
    from slatewise.functions.parse import parse_slate
    bad = "InvalidRecommendationResult"
    cases = [(r"['a\-b', 'c']", ["a\\-b", "c"]), (r"""['it\'s',"x"]""", ["it's", "x"]), ("[b'a']", bad), ("['a', 3]", bad), ("['a', 'b',]", ["a", "b"]), ("a,b", ["a", "b"]),
             (r"['a\nb','c']", bad), (r"['\x41','\u0042\103']", ["A", "BC"]), ("[1,'a']", bad), ("[None,'a']", bad), ("[1.5e3]", bad), ('["a", b]', ['"a"', "b"]),
             ("[007, 8x]", ["007", "8x"]), ("[0x1F]", bad), ("[12, -3]", bad), ("[u'a']", ["a"]), ("[]", []), ("[ ]", []), ("['a' b]", bad), ("['a", ["['a"] and bad)]
    rows = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(cases)], "n int, v string").select("n", parse_slate(F.col("v")).alias("x")).orderBy("n").collect()
    found = [[i.movie_id for i in r.x["items"]] if r.x["items"] is not None else r.x.error for r in rows]
    assert found == [want for _, want in cases]


def test_endless_response_time(spark):
    line = b"2026-01-01T00:00:00Z,5,recommendation request s, status 200, result: a, " + b"9" * 400 + b" s"
    row = parse_events(spark.createDataFrame([(line,)], "value binary")).first()
    assert (row.parse_status, row.error_type, row.fields.response_time_ms, row.fields.recommendations) == ("failed", "InvalidResponseTime", None, None)

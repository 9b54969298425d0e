from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slatewise.functions import metadata as meta
from slatewise.functions import redact as rd
from slatewise.functions import scalars as s
from slatewise.operators import coldstart, retention
from slatewise.operators import text as tx
from slatewise.operators.quality import DataError
from slatewise.plans import inputs
from slatewise.sources import records as rc
from slatewise.sources import tables


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r.x for r in rows.select("n", expr(F.col("v")).alias("x")).orderBy("n").collect()]


def test_redaction(spark):
    found = column(spark, ["password: hunter2", "api_key=abc&x=1", "Authorization: Bearer abc def", "input_tokens: 5", "https://u:p@host/x?token=1&y=2", "my token = \"a,b\" end", "plain"], rd.redact_text)
    assert found[0] == 'password: "[redacted]"' and found[1] == 'api_key="[redacted]"&x=1' and "abc" not in found[2]
    assert found[3] == "input_tokens: 5" and "u:p@" not in found[4] and "token=1" not in found[4] and "y=2" in found[4]
    assert "a,b" not in found[5] and found[5].endswith("end") and found[6] == "plain"
    documents = column(spark, ['{"a": {"Secret-Key": [1]}, "output_tokens": 3}', "not json", None], rd.redact_json)
    assert documents == ['{"a": {"Secret-Key": "[redacted]"}, "output_tokens": 3}', "not json", None]


def test_scalars(spark):
    assert column(spark, ["007", "0", "9223372036854775807", "9223372036854775808", "1a", "+5"], s.normalize_user_id) == ["7", None, str(2**63 - 1), None, None, None]
    assert column(spark, ["http://A.b:80/x", "A.b:8082", "//u@C.d/", "[::1]:80"], s.hostname)[:3] == ["a.b", "a.b", "c.d"]
    assert column(spark, ["The Movie A (1995)", "MOVIE-A", "Amélie", "Bad ¢ents", "An Ant"], s.normalize_title) == ["moviea", "moviea", "amelie", "badcents", "ant"]
    assert column(spark, ["  a \n b  ", "x" * 3000], s.normalize_description) == ["a b", "x" * 2000]
    assert column(spark, ["a,b", "a,a", "a, b", "", ",".join(map(str, range(21)))], s.valid_response_body) == [True, False, False, False, False]
    assert column(spark, [None, 0.0, 18.0, 60.0], lambda v: s.band(v, (18, 30, 45, 60)), "double") == ["missing", "0", "1", "4"]


def test_metadata_errors(spark):
    error = lambda kind: lambda v: meta.metadata_error(kind, F.try_parse_json(v))
    users = ['{"age": 30}', '{"age": "30"}', '{"age": 30.5}', '{"age": 121}', '{"age": true}', '{"gender": 3}', '{"age": ""}', "[]", '{"age": "nan"}']
    assert column(spark, users, error("user")) == [None, None, "invalid_age", "invalid_age", "invalid_age", "invalid_gender", None, "invalid_metadata_object", "invalid_age"]
    movies = ['{"genres": "A|B", "cost": "0.5"}', '{"genres": [{"name": "A"}, "B"]}', '{"genres": [1]}', '{"genres": {"a": 1}}', '{"cost": -1}', '{"license_cost": "x"}', '{"title": 1}', '{"runtime": null}']
    assert column(spark, movies, error("movie")) == [None, None, "invalid_genres", "invalid_genres", "invalid_cost", "invalid_license_cost", "invalid_title", None]


def test_fees(spark):
    raw = spark.createDataFrame([("a", "0.5"), ("b", ""), ("c", "-1"), ("d", "NaN"), ("e", "Infinity"), ("f", "1e2"), ("g", "x")], "movie_id string, license_cost string")
    assert [r.fee_status for r in rc.load_fees(raw).orderBy("movie_id").collect()] == ["known", "missing", "invalid", "invalid", "invalid", "known", "invalid"]
    with pytest.raises(DataError):
        rc.load_fees(raw.unionByName(raw.limit(1)))


def test_manifest_ignores_order_and_sees_changes(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    one, two = rc.snapshot_manifest({"t": df}), rc.snapshot_manifest({"t": df.orderBy(F.rand(3)).repartition(7)})
    rc.require_manifest(one, two)
    assert rc.manifest_version(one).first() == rc.manifest_version(two).first()
    with pytest.raises(DataError, match="t"):
        rc.require_manifest(one, rc.snapshot_manifest({"t": df.withColumn("x", F.when(F.col("id") == 5, 0).otherwise(F.col("x")))}))


def test_as_of_ties(spark):
    t = datetime(2026, 1, 1)
    snaps = spark.createDataFrame([("s1", "u", t), ("s2", "u", t), ("s0", "u", t + timedelta(days=40)), ("x", "v", t + timedelta(days=1))],
                                  "snapshot_id string, entity_id string, fetched_at timestamp")
    pick = lambda as_of: {r.entity_id: r.snapshot_id for r in rc.latest_snapshot_as_of(snaps, as_of, ("entity_id",)).collect()}
    assert pick("2026-01-01") == {"u": "s2"} and pick(None) == {"u": "s0", "v": "x"}
    asks = spark.createDataFrame([(1, "u", t - timedelta(seconds=1)), (2, "u", t), (3, "u", t + timedelta(days=39)), (4, "u", t + timedelta(days=60)), (5, "w", t)], "n int, entity_id string, at timestamp")
    got = {r.n: r.snapshot.snapshot_id if r.snapshot else None for r in rc.snapshot_for_each(asks, snaps, "entity_id", "at").collect()}
    assert got == {1: None, 2: "s2", 3: "s2", 4: "s0", 5: None}


def test_jsonl_round_trip_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id long, name string")
    tables.write_jsonl(df, str(tmp_path / "rows"))
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "rows"), "id long, name string").collect())) == [(1, None), (2, "b")]
    uses = spark.createDataFrame([("u1", datetime(2026, 1, 1)), ("u2", datetime(2026, 1, 2)), ("u3", None)], "use_id string, used_at timestamp")
    counts = rc.export_records({"profile_uses": uses}, str(tmp_path / "export"), start="2026-01-01", end="2026-01-02")
    assert [(r.table, r.n) for r in counts.collect()] == [("profile_uses", 1)]
    with pytest.raises(ValueError):
        rc.export_rows("profile_uses", uses, start="2026-01-02", end="2026-01-01")


def test_expiry(spark):
    ledger = spark.createDataFrame([(f"2026-11-{d:02d}", "s", "t", 0, 1, 100, d, d) for d in range(1, 11)] + [("9999-12-31", "s", "t", 0, 1, 100, 99, 99)],
                                   "day string, source_id string, topic string, partition int, row_count long, bytes long, min_offset long, max_offset long")
    pins = spark.createDataFrame([("p", datetime(2026, 11, 2, 23), datetime(2026, 11, 3, 1))], "pin_id string, start timestamp, end timestamp")
    pinned = retention.protected_days(pins)
    assert {r.day for r in pinned.collect()} == {"2026-11-02", "2026-11-03"}
    plan = retention.expire_plan(ledger, pinned, 500, "2026-11-09")
    assert sorted(r.day for r in plan.where("expire").collect()) == ["2026-11-01", "2026-11-04", "2026-11-05"]  # 6..10 fit exactly
    assert retention.expire_plan(ledger, pinned, 0, "2026-11-05").where("expire").count() == 2  # the minimum age holds
    with pytest.raises(ValueError):
        retention.protected_days(pins.select("pin_id", F.col("end").alias("start"), F.col("start").alias("end")))


# --- cold start ----------------------------------------------------------------------------------------------

MOVIES = [("a", "Movie A", "Drama", "quiet rooms"), ("b", "Movie B", "Horror", "loud screams"), ("c", "Movie C", "Crime|Drama", "a quiet heist"),
          ("d", "Movie D", "Comedy", "jokes"), ("e", "Movie E", "Thriller", "chase")]


def test_cold_start(spark):
    movies = spark.createDataFrame(MOVIES, "movie_id string, title string, genres string, overview string")
    pop = spark.createDataFrame([("a", 0.2), ("d", 0.5), ("e", 0.1)], "movie_id string, popularity double")
    schema = ("user_id long, profile struct<liked_genres:array<string>,excluded_genres:array<string>,liked_titles:array<string>,"
              "disliked_titles:array<string>,likes_summary:string,dislikes_summary:string>")
    rows = [(1, (["Drama"], ["Horror", "Comedy"], ["The Movie A (1995)"], [], "quiet dramas", "gore")), (2, ([], [], [], [], "", ""))]
    seen = spark.createDataFrame([(1, "e")], "user_id long, movie_id string")
    top = coldstart.cold_start_rank(spark.createDataFrame(rows, schema), movies, pop, seen=seen, k=4)
    got = {u: [(r.movie_id, r.reason) for r in top.where(F.col("user_id") == u).orderBy("rank").collect()] for u in (1, 2)}
    assert got[1] == [("c", "Genres you asked for: Drama.")]
    assert [m for m, _ in got[2]] == ["d", "a", "e", "b"]  # nothing personal: popularity, then id
    weights = spark.createDataFrame([("a", "b", 0.4), ("a", "c", 0.8), ("a", "d", -0.5), ("d", "c", 0.8)], "src_movie string, dst_movie string, weight float")
    ex = lambda rows: spark.createDataFrame(rows, "user_id long, movie_id string")
    c = {r.movie_id: r.collaborative for r in coldstart.collaborative(ex([(1, "a")]), ex([(1, "d")]), weights).collect()}
    assert abs(c["b"] - 1.0) < 1e-6 and abs(c["c"] - 1.0) < 1e-6 and "d" not in c


def test_genre_mentions(spark):
    texts = spark.createDataFrame([(1, "I love SciFi and comedies"), (2, "some dramma, please"), (3, "nothing here"), (4, "romantic westerns")], "id int, t string")
    got = {(r.id, r.genre) for r in tx.genre_mentions(texts, "id", "t", ["Comedy", "Science Fiction", "Drama", "Romance", "Western"]).collect()}
    assert got == {(1, "Comedy"), (1, "Science Fiction"), (2, "Drama"), (4, "Romance"), (4, "Western")}


def test_profiles(spark):
    rows = spark.createDataFrame([([("A", "like"), ("B", "avoid"), ("C", "none")],)], "answers array<struct<name:string,choice:string>>")
    p = rows.select(s.profile_from_answers(F.col("answers"), F.lit("x"), F.lit("y")).alias("p"))
    row = p.select("p.*", s.profile_error(F.col("p"), ["A", "B"]).alias("ok"), s.profile_error(F.col("p"), ["A"]).alias("bad")).first()
    assert (row.liked_genres, row.excluded_genres, row.likes_summary, row.ok, row.bad) == (["A"], ["B"], "x", None, "unknown_excluded_genres")


def test_redaction_skips_only_texts_without_a_hint(spark):
    """Texts that hold no hint stay as they are; names that no sign follows are no assignment, and all others are masked as before."""
    plain = ["", None, "token", "the token of the session was lost, a secret = kept", "x" * 50_000, "p%61ssword: a", "my.pass-word: a", "a:b session :c", "COOKIE: x", "ftp://u@h"]
    found = column(spark, plain, rd.redact_text)
    assert found[:3] == plain[:3] and found[4] == plain[4] and found[9] == plain[9]
    assert found[3] == 'the token of the session was lost, a secret = "[redacted]"'
    assert found[5:9] == ['p%61ssword: "[redacted]"', 'my.pass-word: "[redacted]"', 'a:b session :"[redacted]"', "COOKIE: [redacted]"]


def test_a_movie_of_two_names_meets_a_user_once(spark):
    profiles = spark.createDataFrame([(1, ["The A", "B"]), (2, ["a", "A!"]), (3, [None])], "user_id long, titles array<string>")
    movies = spark.createDataFrame([("m", "A"), ("m", "B"), ("n", "a (1999)"), ("n", "a (1999)"), ("o", None), (None, "b")], "movie_id string, title string")
    found = sorted((r.user_id, r.movie_id or "") for r in tx.match_titles(profiles, "titles", movies).collect())
    assert found == [(1, ""), (1, "m"), (1, "n"), (2, "m"), (2, "n")]


def test_small_files_are_dealt_over_the_cores(spark, tmp_path):
    """A file of one split is worked on by every core, in batch and in a stream."""
    spark.range(64).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows = spark.read.parquet(str(tmp_path / "events.parquet"))
    assert rows.rdd.getNumPartitions() == 1
    used = inputs.spread(rows).select("id", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.id for r in used) == list(range(64)) and len({r.p for r in used}) >= spark.sparkContext.defaultParallelism


def test_metadata_is_read_once_for_each_mention(spark):
    """`once` computes its value a single time, and numbers read as they did."""
    calls = column(spark, ['{"a": 7}', '{"a": " "}', '{"a": -1}', '{"a": true}', '{"a": null}', "[1]", None],
                   lambda v: meta.number(meta.field(F.try_parse_json(v), "a")), "string")
    assert [(r.value, r.invalid) for r in calls] == [(7.0, False), (None, True), (None, True), (None, True), (None, False), (None, False), (None, False)]
    assert column(spark, [3], lambda v: meta.once(v, lambda x: x * x + x), "long") == [12]

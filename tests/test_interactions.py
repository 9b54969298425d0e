import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from slatewise.operators import interactions as op
from slatewise.operators.quality import DataError, require_valid, validate_dataset
from slatewise.operators.split import split
from slatewise.sources import tables

EVENTS = """timestamp,user_id,event_type,movie_id,rating
2026-01-01T10:00:00Z,1,watch,a,
2026-01-01T11:00:00Z,1,rating,a,9
2026-01-02T11:00:00Z,1,rating,a,4
2026-01-02T11:00:00Z,1,rating,a,6
2026-01-03T11:00:00Z,1,watch,c,
2026-01-03T11:00:00Z,2,rating,a,8
2026-01-04T10:10:00Z,3,watch,d,
2026-01-05T11:00:00Z,3,watch,d,
2026-01-04T12:00:00Z,3,rating,d,9
2026-01-01T09:00:00Z,4,account_created,,
"""
USERS = "user_id,self_description_likes,self_description_dislikes\n" + "".join(f"{u},,\n" for u in (1, 2, 3, 4)) + "1001,quiet dramas,gore\n"
MOVIES = "movie_id,title,genres,overview,runtime,license_cost,extra\n" + "".join(f"{m},Movie {m},Drama,A film.,100,0.5,x\n" for m in "abcdef")


@pytest.fixture()
def folder(tmp_path):
    for name, text in (("events", EVENTS), ("users", USERS), ("movies", MOVIES)):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as out:
            out.write(text)
    return tmp_path


def read(spark, folder):
    events, users, movies = tables.read_course_tables(spark, str(folder))
    return tables.typed_events(events), tables.typed_users(users), movies


def test_interactions_and_checks(spark, folder):
    events, users, movies = read(spark, folder)
    require_valid(validate_dataset(events, users, movies))
    numbered = events.withColumn("n", F.monotonically_increasing_id())
    for df in (numbered, numbered.repartition(5)):
        got = {(r.user_id, r.movie_id): r for r in op.interactions(df, ["n"]).collect()}
        assert len(got) == 4
        assert got[(1, "a")].rating == 6 and got[(1, "a")].watch_count == 1  # last row wins an equal time
        assert got[(1, "c")].rating is None and got[(2, "a")].watch_count == 0
        d = got[(3, "d")]
        assert (d.rating, d.watch_count, d.first_timestamp, d.last_timestamp) == (9, 2, datetime(2026, 1, 4, 10, 10), datetime(2026, 1, 5, 11))
    assert {r.user_id for r in op.cold_start_users(users, events).collect()} == {4, 1001}
    counts = {r.measure: r.n for r in op.dataset_counts(events, users, movies).collect()}
    assert counts["cold_start_users"] == 2 and counts["cold_start_with_description"] == 1 and counts["events_rating"] == 5


@pytest.mark.parametrize("line, rule", [
    ("2026-01-01T10:00:00Z,9,watch,a,", "event_user_unknown"), ("2026-01-01T10:00:00Z,1,watch,zz,", "event_movie_unknown"),
    ("2026-01-01T10:00:00Z,1,other,,", "event_type_unknown"), ("2026-01-01T10:00:00Z,1,rating,a,11", "rating_out_of_range"),
    ("2026-01-01T10:00:00Z,1,rating,a,", "rating_out_of_range"), ("2026-01-01T10:00:00Z,1,watch,a,3", "rating_on_other_event"),
    ("2026-01-01T10:00:00Z,1,account_created,a,", "movie_on_account_event"), (",1,watch,a,", "event_timestamp_missing")])
def test_violations(spark, folder, line, rule):
    with gzip.open(folder / "events.csv.gz", "at") as out:
        out.write(line + "\n")
    broken = {r.rule for r in validate_dataset(*read(spark, folder)).where("n > 0").collect()}
    assert broken == {rule}


def test_bad_files(spark, folder):
    with gzip.open(folder / "events.csv.gz", "at") as out:
        out.write("yesterday,1,watch,a,\n")
    with pytest.raises(DataError, match="timestamp"):
        read(spark, folder)
    with gzip.open(folder / "users.csv.gz", "wt") as out:
        out.write("user_id,self_description_likes\n1,x\n")
    with pytest.raises(DataError, match="self_description_dislikes"):
        tables.read_course_tables(spark, str(folder))
    with gzip.open(folder / "users.csv.gz", "wt") as out:
        out.write("user_id,self_description_likes,self_description_dislikes\n")
    with pytest.raises(DataError, match="no rows"):
        tables.read_course_tables(spark, str(folder))


def test_popular_unseen_equals_brute_force(spark):
    popular = [(f"m{n}", float(20 - n // 2)) for n in range(20)] + [("zero", 0.0)]
    seen = {1: [], 2: ["m0", "m1", "m2"], 3: [f"m{n}" for n in range(19)], 4: ["m5", "m18"], 5: ["zero"]}
    df = spark.createDataFrame([(u, m) for u, ms in seen.items() for m in ms], "user_id long, movie_id string")
    users = spark.createDataFrame([(u,) for u in seen], "user_id long")
    for k in (1, 3, 25):
        out = op.popular_unseen(users, df, spark.createDataFrame(popular, "movie_id string, popularity double"), k).collect()
        for u, mine in seen.items():
            order = sorted((m for m, p in popular if p > 0 and m not in mine), key=lambda m: (-dict(popular)[m], m))[:k]
            assert [r.movie_id for r in sorted((r for r in out if r.user_id == u), key=lambda r: r["rank"])] == order


def test_merge_history(spark):
    static = spark.createDataFrame([(1, "a", 8, 1), (1, "b", 4, 1), (1, "c", None, 1)], "user_id long, movie_id string, rating int, watch_count long")
    live = spark.createDataFrame([(1, "b", True, None), (1, "c", True, 2), (1, "d", True, None), (1, "e", False, 9)],
                                 "user_id long, movie_id string, watched boolean, rating long")
    got = {r.movie_id: r.liked for r in op.merge_history(static, live).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": True}  # a watch never undoes a dislike


def test_split_sizes_and_repeatability(spark):
    rows = [(u, f"movie-{n}") for u in (1, 2, 3) for n in range(10)] + [(9, "x"), (9, "y")]
    df = spark.createDataFrame(rows, "user_id long, movie_id string")
    one = {(r.user_id, r.movie_id): r.part for r in split(df).collect()}
    again = {(r.user_id, r.movie_id): r.part for r in split(df.orderBy(F.rand(5)).repartition(7)).collect()}
    assert one == again and len(one) == 32
    for u in (1, 2, 3):
        parts = [p for (v, _), p in one.items() if v == u]
        assert (parts.count("training"), parts.count("validation"), parts.count("test")) == (6, 2, 2)
    assert {one[(9, "x")], one[(9, "y")]} == {"training"}
    assert one != {(r.user_id, r.movie_id): r.part for r in split(df, seed=7).collect()}


def test_no_movie_of_the_catalogue_is_outside_the_pool(spark):
    """At sf0.01 (2,000 movies) a pool of 1,000 drops valid events, the whole catalogue does not."""
    import __spark_entry__ as entry
    sample = "/root/testdata/sf0.01"
    count = lambda name: {r.drop_reason: r.n for r in entry.queries()[name](spark, sample).collect()}
    whole, small = count("whole_catalogue_training_reasons"), count("recent_training_reasons")
    outside = "outside_candidate_catalogue"
    assert sum(whole.values()) == sum(small.values()) and whole["kept"] == small["kept"] + small[outside] and outside not in whole

"""Validation, interactions, histories and candidate pools over the whole history."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewise.functions import metadata as meta
from slatewise.functions.scalars import positive
from slatewise.operators import interactions as op
from slatewise.operators.quality import dedup_or_conflict, fingerprinted, fresh, referential_check, validate_dataset
from slatewise.operators.split import split
from slatewise.plans import inputs as i
from slatewise.plans.registry import query
from slatewise.session import settle, written
from slatewise.streaming.project import live_interactions

POPULAR = i.PAIRS + """,
likes as (select movie_id, count(*) as likes from pairs where case when rating is not null then rating >= 6 else watch_count > 0 end group by 1),
popular as (select movie_id, likes, likes * 1.0 / (select count(distinct user_id) from pairs) as popularity from likes)
"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""with {i.PAIRS}
select user_id, movie_id, watch_count, rating, epoch_us(first_timestamp) as first_us, epoch_us(last_timestamp) as last_us from pairs""")
def interactions(spark, directory):
    """Watches, newest rating, first and last time per user and movie."""
    return i.pairs(spark, directory).select(
        "user_id", "movie_id", "watch_count", "rating", F.unix_micros("first_timestamp").alias("first_us"),
        F.unix_micros("last_timestamp").alias("last_us"))


@query(f"""with {i.PAIRS}
select user_id, count(*) as liked from pairs where case when rating is not null then rating >= 6 else watch_count > 0 end group by 1""")
def liked_counts(spark, directory):
    """Liked movies per user."""
    return op.positives(i.pairs(spark, directory)).groupBy("user_id").agg(F.count(F.lit(1)).alias("liked"))


@query(f"with {POPULAR} select movie_id, likes, round(popularity, 6) as popularity from popular")
def popularity(spark, directory):
    """Share of users liking each movie."""
    return _rounded(op.popularity(i.pairs(spark, directory)), "popularity")


@query(f"""with {POPULAR}, {i.USERS},
open as (select u.user_id, p.movie_id, p.popularity, row_number() over (partition by u.user_id order by p.popularity desc, p.movie_id) as rank
  from users u, popular p where not exists (select 1 from pairs s where s.user_id = u.user_id and s.movie_id = p.movie_id))
select user_id, movie_id, cast(rank as bigint) as rank, round(popularity, 6) as popularity from open where rank <= 20""")
def popular_unseen_top20(spark, directory):
    """Top 20 popular movies each user has not seen."""
    pairs = written(i.pairs(spark, directory), "pairs")
    top = op.popular_unseen(i.users(spark, directory), pairs, op.popularity(pairs), 20)
    return _rounded(top, "popularity").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""with {i.HISTORY}, {i.USERS}, {i.MOVIES},
ev as (select *, case when l_orderkey % 50 = 0 then 'other' else event_type end as kind,
  case when l_orderkey % 70 = 0 then 11 else rating end as stars, case when l_orderkey % 90 = 0 then -1 else user_id end as uid,
  case when l_orderkey % 110 = 0 then 'none' else movie_id end as mid from history)
select 'event_timestamp_missing' as rule, count(*) filter ("timestamp" is null) as n from ev
union all select 'event_type_unknown', count(*) filter (kind = 'other') from ev
union all select 'rating_out_of_range', count(*) filter (kind = 'rating' and not coalesce(stars between 1 and 10, false)) from ev
union all select 'rating_on_other_event', count(*) filter (kind <> 'rating' and stars is not null) from ev
union all select 'movie_on_account_event', count(*) filter (kind = 'other' and mid <> '') from ev
union all select 'user_not_positive', count(*) filter (user_id <= 0) from users
union all select 'movie_id_empty', count(*) filter (movie_id = '') from movies
union all select 'user_repeated', coalesce(cast(sum(c - 1) as bigint), 0) from (select count(*) as c from users group by user_id having count(*) > 1) x
union all select 'movie_repeated', coalesce(cast(sum(c - 1) as bigint), 0) from (select count(*) as c from movies group by movie_id having count(*) > 1) x
union all select 'event_user_unknown', count(*) from ev where uid not in (select user_id from users)
union all select 'event_movie_unknown', count(*) from ev where kind in ('watch', 'rating') and mid not in (select movie_id from movies)""")
def dataset_violations(spark, directory):
    """Rule violations of a history with seeded errors."""
    bad = i.history(spark, directory).withColumns({
        "event_type": F.when(F.col("l_orderkey") % 50 == 0, "other").otherwise(F.col("event_type")),
        "rating": F.when(F.col("l_orderkey") % 70 == 0, 11).otherwise(F.col("rating")),
        "user_id": F.when(F.col("l_orderkey") % 90 == 0, -1).otherwise(F.col("user_id")),
        "movie_id": F.when(F.col("l_orderkey") % 110 == 0, "none").otherwise(F.col("movie_id"))})
    return validate_dataset(bad, i.users(spark, directory), i.movies(spark, directory))


@query("""select 'line_part_not_in_documents' as rule, count(*) as n from lineitem where l_partkey not in (select doc_id from documents)""")
def unknown_references(spark, directory):
    """Line items whose part has no document."""
    child = i.table(spark, directory, "lineitem").select(F.col("l_partkey").alias("doc_id"))
    return referential_check(child, i.table(spark, directory, "documents"), "doc_id", "line_part_not_in_documents")


@query(f"""with {i.HISTORY}, {i.USERS} select user_id, self_description_likes from users
where user_id not in (select user_id from history)""")
def cold_start_users(spark, directory):
    """Users without any watch or rating."""
    return op.cold_start_users(i.users(spark, directory), i.history(spark, directory)).select("user_id", "self_description_likes")


@query(f"""with {i.HISTORY}, {i.USERS}, {i.MOVIES},
cold as (select * from users where user_id not in (select user_id from history))
select 'events' as measure, count(*) as n from history union all select 'users', count(*) from users union all select 'movies', count(*) from movies
union all select 'events_' || event_type, count(*) from history group by event_type
union all select 'cold_start_users', count(*) from cold
union all select 'cold_start_with_description', count(*) filter (trim(self_description_likes) <> '') from cold""")
def dataset_counts(spark, directory):
    """Table sizes, events by type and cold-start users."""
    return op.dataset_counts(i.history(spark, directory), i.users(spark, directory), i.movies(spark, directory))


@query(f"with {i.HISTORY} select user_id, count(*) as events from history group by 1 order by 2 desc, 1 limit 500")
def active_users(spark, directory):
    """The 500 most active users."""
    return op.active_users(i.history(spark, directory), 500)


@query(f"""with {POPULAR}, {i.MOVIES} select m.movie_id, round(coalesce(p.popularity, 0), 6) as prior_popularity
from movies m left join popular p using (movie_id) order by coalesce(p.popularity, 0) desc, m.movie_id limit 500""")
def popular_catalogue(spark, directory):
    """Candidate pool of 500 movies by prior popularity."""
    pool = op.popular_catalogue(i.movies(spark, directory), op.popularity(i.pairs(spark, directory)), 500)
    return _rounded(pool.select("movie_id", "prior_popularity"), "prior_popularity")


@query(f"""with {i.LOG}, {POPULAR}, pool as (select movie_id from popular order by popularity desc, movie_id limit 1000)
select coalesce(case when event_ts is null then 'timestamp_missing'
  when not (event_ts >= timestamp '2024-01-05' and event_ts < timestamp '2024-01-25') or ingested_at > timestamp '2024-01-25' then 'outside_window'
  when parse_status <> 'parsed' or event_type is null or event_type not in ('watch', 'rating') then 'not_training_event'
  when l.movie_id not in (select movie_id from pool) then 'outside_candidate_catalogue'
  when event_type = 'rating' and not coalesce(rating between 1 and 10, false) then 'invalid_rating'
  when not coalesce(user_id > 0, false) then 'invalid_user' end, 'kept') as drop_reason, count(*) as n from log l group by 1""")
def recent_training_reasons(spark, directory):
    """Why log lines do or do not become training events."""
    pool = op.popularity(i.pairs(spark, directory)).orderBy(F.col("popularity").desc(), "movie_id").limit(1000)
    rows = op.recent_training_events(i.parsed(spark, directory), pool, "2024-01-05", "2024-01-25")
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {i.LOG}, {i.MOVIES}
select coalesce(case when event_ts is null then 'timestamp_missing'
  when not (event_ts >= timestamp '2024-01-05' and event_ts < timestamp '2024-01-25') or ingested_at > timestamp '2024-01-25' then 'outside_window'
  when parse_status <> 'parsed' or event_type is null or event_type not in ('watch', 'rating') then 'not_training_event'
  when l.movie_id not in (select movie_id from movies) then 'outside_candidate_catalogue'
  when event_type = 'rating' and not coalesce(rating between 1 and 10, false) then 'invalid_rating'
  when not coalesce(user_id > 0, false) then 'invalid_user' end, 'kept') as drop_reason, count(*) as n from log l group by 1""")
def whole_catalogue_training_reasons(spark, directory):
    """The same reasons with all movies as candidates, where `recent_training_reasons` is the case of a pool of 1,000."""
    rows = op.recent_training_events(i.parsed(spark, directory), i.movies(spark, directory), "2024-01-05", "2024-01-25")
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


LIVE = """
live as (select user_id, movie_id, bool_or(event_type = 'watch') as watched,
           arg_max(rating, (event_ts, "partition", "offset")) filter (event_type = 'rating') as rating
         from log where parse_status = 'parsed' and event_type in ('watch', 'rating') and user_id is not null group by 1, 2)
"""


@query(f"""with {i.PAIRS}, {i.LOG}, {LIVE}
select coalesce(s.user_id, l.user_id) as user_id, coalesce(s.movie_id, l.movie_id) as movie_id,
  case when l.rating is not null then l.rating >= 6
    when s.user_id is not null then case when s.rating is not null then s.rating >= 6 else s.watch_count > 0 end
    else l.watched end as liked
from pairs s full join live l on s.user_id = l.user_id and s.movie_id = l.movie_id""")
def merged_history(spark, directory):
    """Static history with the live log on top."""
    live = live_interactions(i.parsed(spark, directory))
    return op.merge_history(i.pairs(spark, directory), live)


@query(f"""with {i.PAIRS}, {i.LOG} select user_id, movie_id from pairs union
select user_id, movie_id from log where parse_status = 'parsed' and event_type in ('watch', 'rating') and user_id is not null""")
def seen_union(spark, directory):
    """Seen pairs of both sources."""
    live = i.parsed(spark, directory).where("parse_status = 'parsed' and event_type in ('watch', 'rating') and user_id is not null")
    return op.seen_pairs(i.pairs(spark, directory), live)


@query(f"""with {i.PAIRS}, {i.LOG}, c as (select distinct user_id, cast((k + r.i - 1) % 100 as varchar) as movie_id from log,
  (select unnest(range(1, 21)) as i) r where parse_status = 'parsed' and items is not null and r.i <= items)
select user_id, movie_id from c where not exists (select 1 from pairs p where p.user_id = c.user_id and p.movie_id = c.movie_id)""")
def unseen_candidates(spark, directory):
    """Recommended movies the user had not seen."""
    shown = i.parsed(spark, directory).where("parse_status = 'parsed'").select("user_id", F.explode("fields.recommendations").alias("r")).select(
        "user_id", "r.movie_id").distinct()
    return op.exclude_seen(shown, i.pairs(spark, directory))


@query(f"""with {i.PAIRS}, r as (select *, row_number() over (partition by user_id order by
  sha256('42:' || cast(user_id as varchar) || ':' || movie_id), movie_id) as place, count(*) over (partition by user_id) as c from pairs),
s as (select *, least(greatest(1, cast(floor(c * 0.2) as bigint)), c - 2) as v from r),
t as (select *, least(greatest(1, cast(floor(c * 0.2) as bigint)), c - v - 1) as w from s)
select user_id, movie_id, case when c < 3 then 'training' when place <= v then 'validation' when place <= v + w then 'test' else 'training' end as part from t""")
def seeded_split(spark, directory):
    """Training, validation and test part of every pair."""
    return split(i.pairs(spark, directory)).select("user_id", "movie_id", "part")


@query(f"""with {i.PAIRS}, r as (select *, row_number() over (partition by user_id order by
  sha256('42:' || cast(user_id as varchar) || ':' || movie_id), movie_id) as place, count(*) over (partition by user_id) as c from pairs),
s as (select *, least(greatest(1, cast(floor(c * 0.2) as bigint)), c - 2) as v from r),
t as (select *, least(greatest(1, cast(floor(c * 0.2) as bigint)), c - v - 1) as w from s)
select user_id, count(*) as pairs from t where c < 3 or not (place > v and place <= v + w) group by 1""")
def final_training_pairs(spark, directory):
    """Training and validation parts joined for the final fit, per user."""
    parts = split(i.pairs(spark, directory))
    final = parts.where("part = 'training'").unionByName(parts.where("part = 'validation'"))
    return final.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("""select l_orderkey, l_linenumber, count(*) as copies, min(d) <> max(d) as conflict from (
  select l_orderkey, l_linenumber, cast(l_partkey as varchar) || '|' || cast(l_suppkey as varchar) as d from lineitem) x group by 1, 2""")
def repeated_line_keys(spark, directory):
    """Copies and conflicts of the line item key."""
    rows = fingerprinted(i.table(spark, directory, "lineitem"), ["l_partkey", "l_suppkey"])
    return dedup_or_conflict(rows, ["l_orderkey", "l_linenumber"]).drop("duplicates")


@query("""select o_orderkey, timestamp '2000-01-01' >= o_orderdate and epoch_us(timestamp '2000-01-01') - epoch_us(o_orderdate) < 86400000000 * 365 as fresh
from orders""")
def fresh_orders(spark, directory):
    """Records younger than a year and not from the future."""
    return i.table(spark, directory, "orders").select("o_orderkey", fresh(
        F.col("o_orderdate"), F.lit("2000-01-01").cast("timestamp"), 86_400 * 365).alias("fresh"))


@query("""select p_partkey, case
  when p_partkey % 13 = 0 then 'invalid_metadata_object' when p_partkey % 7 = 1 then 'invalid_runtime' when p_partkey % 7 = 2 then 'invalid_cost'
  when p_partkey % 7 = 3 then 'invalid_license_cost' when p_partkey % 7 = 4 then 'invalid_genres' when p_partkey % 7 = 5 then 'invalid_title' end as error from part""")
def movie_metadata_errors(spark, directory):
    """First failing field of movie records with seeded errors."""
    return _movie_records(spark, directory).select("p_partkey", meta.metadata_error("movie", F.col("record")).alias("error"))


def _movie_records(spark, directory):
    k = F.col("p_partkey")
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    text = F.concat(
        F.lit('{"movie_id":'), k.cast("string"),
        F.lit(',"runtime":'), F.when(k % 7 == 1, "-5").otherwise(F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))),
        F.lit(',"cost":'), F.when(k % 7 == 2, "true").otherwise(F.col("p_retailprice").cast("string")),
        F.lit(',"license_cost":'), F.when(k % 7 == 3, '"NaN"').otherwise('""'),
        F.lit(',"genres":'), F.when(k % 7 == 4, '["", 3]').when(k % 7 == 6, F.concat(F.lit('[{"name":"'), F.col("p_type"), F.lit('"}]')))
        .otherwise(F.concat(F.lit('"'), F.col("p_type"), F.lit("|"), F.col("p_brand"), F.lit('"'))),
        F.lit(',"title":'), F.when(k % 7 == 5, "12").otherwise(quoted(F.col("p_name"))), F.lit(',"overview":null}'))
    record = F.when(k % 13 == 0, "[1]").otherwise(text)
    return i.table(spark, directory, "part").select("p_partkey", "p_type", "p_brand", F.try_parse_json(record).alias("record"))


@query("""select p_partkey, case when p_partkey % 13 = 0 or p_partkey % 7 = 4 then null when p_partkey % 7 = 6 then p_type
  else p_type || ',' || p_brand end as genres from part""")
def movie_genres(spark, directory):
    """Genres from text, lists and objects."""
    names = meta.genres(meta.field(F.col("record"), "genres"))["names"]
    return _movie_records(spark, directory).select(
        "p_partkey", F.when(F.col("p_partkey") % 13 != 0, F.array_join(names, ",")).alias("genres"))


@query("""select c_custkey, case when c_custkey % 5 = 0 then 'invalid_age' when c_custkey % 5 = 1 then 'invalid_gender' end as error,
  case when c_acctbal < 0 or c_acctbal > 5000 then null else round(c_acctbal, 6) end as balance,
  c_acctbal < 0 or c_acctbal > 5000 as balance_invalid from customer""")
def user_metadata_errors(spark, directory):
    """User records: whole ages up to 120, text fields, bounded numbers."""
    k = F.col("c_custkey")
    text = F.concat(
        F.lit('{"age":'), F.when(k % 5 == 0, F.when(k % 2 == 0, "30.5").otherwise("121")).otherwise('"44"'), F.lit(',"gender":'),
        F.when(k % 5 == 1, "[1]").otherwise('"x"'), F.lit(',"balance":"'), F.col("c_acctbal").cast("string"), F.lit('"}'))
    rows = i.table(spark, directory, "customer").select("c_custkey", F.try_parse_json(text).alias("record"))
    number = meta.number(meta.field(F.col("record"), "balance"), 5000)
    return rows.select("c_custkey", meta.metadata_error("user", F.col("record")).alias("error"),
                       F.round(number["value"], 6).alias("balance"), number["invalid"].alias("balance_invalid"))


@query(f"""with {i.HISTORY} select user_id, movie_id, event_type, rating, epoch_us("timestamp") as us from history where user_id = 7
order by "timestamp", l_orderkey, l_linenumber, l_quantity limit 100""")
def user_timeline(spark, directory):
    """One user's first 100 events."""
    rows = op.user_timeline(i.history(spark, directory), 7, ["timestamp", "l_orderkey", "l_linenumber", "l_quantity"], 100)
    return rows.select("user_id", "movie_id", "event_type", "rating", F.unix_micros("timestamp").alias("us"))


@query(f"""with {i.PAIRS}, c as (select movie_id as id from pairs), p as (select cast(doc_id as varchar) as id from documents)
select 'not_in_documents' as side, count(distinct id) as n from c where id not in (select id from p)
union all select 'not_in_history', count(distinct id) from p where id not in (select id from c)""")
def key_containment(spark, directory):
    """Movie ids missing on either side."""
    a = i.pairs(spark, directory).select("movie_id").distinct()
    b = i.table(spark, directory, "documents").select(F.col("doc_id").cast("string").alias("movie_id")).distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a.join(b, "movie_id", "left_anti"), "not_in_documents").unionByName(count(b.join(a, "movie_id", "left_anti"), "not_in_history"))


@query(f"""with {i.PAIRS} select user_id, movie_id, case when rating is not null then rating >= 8 else watch_count > 0 end as liked from pairs""")
def strict_likes(spark, directory):
    """Likes at a stricter rating threshold."""
    return i.pairs(spark, directory).select("user_id", "movie_id", positive(F.col("rating"), F.col("watch_count"), 8).alias("liked"))

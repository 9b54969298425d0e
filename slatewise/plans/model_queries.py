"""Item-item model, offline metrics, text features and cold start over the whole history."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewise.functions.scalars import normalize_title
from slatewise.operators import blocks, coldstart, ease, krylov, metrics, ranks
from slatewise.operators import interactions as op
from slatewise.operators import text as tx
from slatewise.operators.split import split
from slatewise.plans import inputs as i
from slatewise.plans.catalogue_queries import POPULAR
from slatewise.plans.registry import query
from slatewise.session import settle, written
from slatewise.streaming.project import live_interactions

STOP = ("a", "an", "and", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "or", "the", "to", "with")

LIKES = i.PAIRS + """,
liked as (select user_id, movie_id from pairs where case when rating is not null then rating >= 6 else watch_count > 0 end),
co as (select a.movie_id as src, b.movie_id as dst, count(*) as n from liked a join liked b on a.user_id = b.user_id group by 1, 2)
"""


_POPULAR = POPULAR.removeprefix(i.PAIRS + ",")


def _members(spark, directory, pairs=None):
    """Liked pairs with movie numbers, and how many numbers there are."""
    liked = written(op.positives(i.pairs(spark, directory) if pairs is None else pairs), "liked")
    index = liked.select("movie_id").distinct().select("movie_id", F.col("movie_id").cast("int").alias("idx"))
    size = i.table(spark, directory, "part").agg(F.max("p_partkey")).first()[0] + 1
    return liked, index, size


@query(f"""with {LIKES} select src as movie_id, count(*) as partners, cast(sum(n) as bigint) as common_likes, max(n) as most from co group by 1""")
def cooccurrence(spark, directory):
    """Common likes of all movie pairs, summed up per movie."""
    liked, index, size = _members(spark, directory)
    counts = blocks.cooccurrence(liked.join(index, "movie_id").select(F.col("user_id").alias("owner"), "idx"), size, both=True)
    return counts.groupBy(F.col("i").cast("string").alias("movie_id")).agg(
        F.count(F.lit(1)).alias("partners"), F.sum("n").alias("common_likes"), F.max("n").alias("most"))


@query(f"""with {LIKES}, {_POPULAR},
scored as (select l.user_id, c.dst as movie_id, cast(sum(c.n) as double) as score from liked l join co c on c.src = l.movie_id and c.dst <> l.movie_id group by 1, 2),
r as (select s.*, row_number() over (partition by s.user_id order by score desc, popularity desc, s.movie_id) as rank from scored s join popular p using (movie_id)
  where not exists (select 1 from pairs x where x.user_id = s.user_id and x.movie_id = s.movie_id))
select user_id, movie_id, rank, score from r where rank <= 10""")
def weighted_scores(spark, directory):
    """Top 10 unseen movies by added co-occurrence weights, as joins."""
    pairs = written(i.pairs(spark, directory), "pairs")
    liked, index, size = _members(spark, directory, pairs)
    numbered = lambda rows: rows.join(index, "movie_id").select("user_id", F.col("idx").alias("movie_id"))
    counts = blocks.cooccurrence(numbered(liked).withColumnsRenamed({"user_id": "owner", "movie_id": "idx"}), size, both=True).where("i <> j")
    weights = counts.select(F.col("j").alias("src_movie"), F.col("i").alias("dst_movie"), F.col("n").alias("weight"))
    popular = op.popularity(pairs)
    places = ranks.numbered(popular.where("popularity > 0").join(index, "movie_id"), [F.col("popularity").desc(), F.col("movie_id")], "place").select(
        F.col("idx").alias("movie_id"), "place")
    scores = ease.score_users(numbered(liked), weights, (10, numbered(pairs), places)).withColumnRenamed("movie_id", "idx").join(index, "idx")
    open_scores = op.exclude_seen(scores.select("user_id", "movie_id", "score"), pairs).join(popular, "movie_id")
    return ease.top_k(open_scores, 10).select("user_id", "movie_id", F.col("rank").cast("bigint").alias("rank"), "score")


def _model(spark, directory, pairs=None):
    pairs = settle(i.pairs(spark, directory)) if pairs is None else pairs
    pool = settle(i.movies(spark, directory).select("movie_id", "title"))
    return ease.fit(pairs, pool), pool


@query()
def ease_weights(spark, directory):
    """Fitted weights per target movie: count, extremes and total."""
    model, _ = _model(spark, directory)
    return ease.weight_summary(model).select("movie_id", "weights", *(F.round(c, 4).alias(c) for c in ("lowest", "highest")), F.round("total", 3).alias("total"))


@query(f"""with {LIKES} select cast(floor(r / w) as bigint) as panel, count(*) as movies, 0.0 as residual from (
  select row_number() over (order by movie_id) - 1 as r, greatest(least(floor(1048576 / count(*) over ()), 16, count(*) over ()), 4) as w
  from (select distinct movie_id from liked)) m group by 1""")
def ease_residuals(spark, directory):
    """Largest entry of |(G + λI) x - e| over the columns of each panel of the fitted inverse, to eight digits."""
    model, _ = _model(spark, directory)
    return model.panels.select(F.col("panel").cast("bigint").alias("panel"), F.expr(f"octet_length(data) div {4 * model.size}").cast("bigint").alias("movies"),
                               F.round("residual", 8).alias("residual"))


@query()
def ease_slates(spark, directory):
    """Top 20 of every user: personal where possible, popular otherwise."""
    model, _ = _model(spark, directory)
    return ease.recommend_all(model, i.users(spark, directory)).select("user_id", "movie_id", "rank", F.round("score", 6).alias("score"), "method")


@query()
def profile_slates(spark, directory):
    """Slates from merged static and live histories instead of the training ones."""
    live = _live(spark, directory)
    model, _ = _model(spark, directory)
    merged = settle(op.merge_history(i.pairs(spark, directory), live))
    return ease.recommend_all(model, merged, 20, histories=merged).select("user_id", "movie_id", "rank", F.round("score", 6).alias("score"), "method")


def _live(spark, directory):
    return live_interactions(i.parsed(spark, directory)).select("user_id", "movie_id", "watched", "rating")


@query()
def penalised_slates(spark, directory):
    """Slates with 0.0001 points per unit of licence fee."""
    model, _ = _model(spark, directory)
    penalties = ease.licence_penalties(model.movies, i.fees(spark, directory), 0.0001)
    return ease.recommend_all(model, i.users(spark, directory), 20, penalties).select("user_id", "movie_id", "rank", F.round("score", 6).alias("score"), "method")


@query(f"""with {i.FEES} select movie_id, round(cast(0.01 * coalesce(fee, (select max(fee) from fees)) as double), 6) as penalty from fees""")
def licence_penalties(spark, directory):
    """Ranking penalties; unknown fees count as the highest known one."""
    rows = ease.licence_penalties(i.movies(spark, directory), i.fees(spark, directory), 0.01)
    return rows.withColumn("penalty", F.round("penalty", 6))


@query()
def policy_replay(spark, directory):
    """Slate overlap, fees and scores with and without the penalty, on a seeded user sample."""
    model, _ = _model(spark, directory)
    return ease.policy_replay(model, i.fees(spark, directory), 0.0001)


@query()
def candidate_checks(spark, directory):
    """Checks of a candidate model against the running one."""
    model, pool = _model(spark, directory)
    return ease.candidate_checks(model, model, pool, i.movies(spark, directory))


BRAND_MODEL = """with recursive pairs as (select o_custkey as user_id, p_brand as b, max(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2),
liked as (select user_id, b from pairs where q > 45),
popular as (select b, count(*) as likes from liked group by 1),
ids as (select b, likes, row_number() over (order by b) as i from popular),
co as (select x.b as src, y.b as dst, count(*) as c from liked x join liked y on x.user_id = y.user_id group by 1, 2),
cells as (select x.i, y.i as j, coalesce(c, 0) + case when x.i = y.i then 100 else 0 end as v from ids x cross join ids y left join co on src = x.b and dst = y.b),
lines as (select i, list(cast(v as double) order by j) as line from cells group by 1),
start as (select list(line order by i) as m from lines),
steps as (select 0 as k, m from start union all
  select k + 1, [[case when i = k + 1 and j = k + 1 then 1 / m[i][j] when i = k + 1 then m[i][j] / m[i][i] when j = k + 1 then -m[i][j] / m[j][j]
    else m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] end for j in range(1, len(m) + 1)] for i in range(1, len(m) + 1)]
  from steps where k < len(m)),
inverse as (select m from steps where k = len(m)),
weights as (select s.b as src, d.b as dst, -m[s.i][d.i] / m[d.i][d.i] as weight from inverse, ids s, ids d where s.i <> d.i)
"""


def brand_pairs(spark, directory):
    """Brands as movies over all line items: a customer's best quantity of a brand is the rating."""
    orders = i.table(spark, directory, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    parts = i.table(spark, directory, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("movie_id"))
    lines = i.table(spark, directory, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey").groupBy("user_id", "movie_id").agg(
        F.ceil(F.max("l_quantity") / 5).cast("int").alias("rating"), F.count(F.lit(1)).alias("watch_count"))


def brands(spark, directory):
    return i.table(spark, directory, "part").select(F.col("p_brand").alias("movie_id"), F.col("p_brand").alias("title")).distinct()


def _brand_model(spark, directory, by_tiles=False):
    """A model of brands; columns on their own, or four tiles a side."""
    return ease.fit(settle(brand_pairs(spark, directory)), brands(spark, directory), 100.0, 10, likes_limit=0 if by_tiles else krylov.LIKES, tile=8)


@query(f"{BRAND_MODEL} select src as src_movie, dst as dst_movie, round(weight, 4) as weight from weights")
def brand_weights(spark, directory):
    """All weights of a model of brands, fitted on every line item."""
    found = ease.weights(_brand_model(spark, directory, by_tiles=True))
    return found.select("src_movie", "dst_movie", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query(f"""{BRAND_MODEL},
scored as (select user_id, dst as b, sum(weight) as score from liked join weights on src = b group by 1, 2),
open as (select s.*, row_number() over (partition by user_id order by score desc, likes desc, b) as rank from scored s join ids using (b)
  where not exists (select 1 from liked x where x.user_id = s.user_id and x.b = s.b))
select user_id, b as movie_id, rank, round(score, 4) as score from open where rank <= 5""")
def brand_slates(spark, directory):
    """The five brands, of those a customer has not liked, that the model of brands scores highest."""
    model = _brand_model(spark, directory)
    found = ease.recommend(model, model.histories.where("liked"), 5)
    return found.select("user_id", "movie_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


METRICS = i.PAIRS + """,
r as (select *, row_number() over (partition by user_id order by sha256('42:' || cast(user_id as varchar) || ':' || movie_id), movie_id) as place, count(*) over (partition by user_id) as c from pairs),
s as (select *, least(greatest(1, cast(floor(c * 0.2) as bigint)), c - 2) as v from r),
t as (select *, least(greatest(1, cast(floor(c * 0.2) as bigint)), c - v - 1) as w from s),
parts as (select *, case when c < 3 then 'training' when place <= v then 'validation' when place <= v + w then 'test' else 'training' end as part from t),
train as (select * from parts where part <> 'test'), held as (select * from parts where part = 'test'),
likes as (select movie_id, count(*) as likes from train where case when rating is not null then rating >= 6 else watch_count > 0 end group by 1),
target as (select distinct user_id, movie_id from held where rating >= 7),
ranked as (select u.user_id, p.movie_id, row_number() over (partition by u.user_id order by p.likes desc, p.movie_id) as rank from (select distinct user_id from target) u, likes p
  where not exists (select 1 from train x where x.user_id = u.user_id and x.movie_id = p.movie_id)),
recs as (select * from ranked where rank <= 10),
per_user as (select t.user_id, count(*) as targets, count(k.rank) as hits, count(l.movie_id) as supported, coalesce(sum(1 / log2(k.rank + 1)), 0) as gain
  from target t left join recs k on k.user_id = t.user_id and k.movie_id = t.movie_id left join likes l on l.movie_id = t.movie_id group by 1),
scored as (select *, gain / (select sum(1 / log2(g.i + 1)) from (select unnest(range(1, 11)) as i) g where g.i <= least(targets, 10)) as ndcg from per_user)
"""


@query(f"""with {METRICS} select count(*) as evaluated_users, cast(sum(targets) as bigint) as relevant_interactions, round(avg(hits / 10e0), 6) as precision_at_k,
  round(avg(hits / cast(targets as double)), 6) as recall_at_k, round(avg(ndcg), 6) as ndcg_at_k, round(avg(case when hits > 0 then 1e0 else 0e0 end), 6) as hit_rate_at_k,
  round(sum(supported) / cast(sum(targets) as double), 6) as supported_target_fraction,
  round((select count(distinct movie_id) from recs) / cast((select count(*) from part) as double), 6) as catalog_coverage,
  (select count(distinct user_id) from held) - count(*) as users_without_relevant_ratings from scored""")
def popularity_metrics(spark, directory):
    """Ranking metrics of the popularity baseline on the test part."""
    parts = written(split(i.pairs(spark, directory)), "parts")
    train, held = parts.where("part <> 'test'"), parts.where("part = 'test'")
    movies = i.movies(spark, directory).select("movie_id").join(op.popularity(train), "movie_id", "left").select(
        "movie_id", F.coalesce("popularity", F.lit(0.0)).alias("popularity"))
    users = held.where("rating >= 7").select("user_id").distinct()
    out = metrics.ranking_metrics(op.popular_unseen(users, train, movies, 10), held, movies, 10)
    return out.withColumns({f.name: F.round(f.name, 6) for f in out.schema if f.dataType.typeName() == "double"})


@query()
def offline_evaluation(spark, directory):
    """Fixed-parameter evaluation on the test part."""
    parts = settle(split(i.pairs(spark, directory)))
    return metrics.offline_evaluation(parts, i.movies(spark, directory).select("movie_id", "title"))


@query("""with g as (select p_size % 5 as a, p_size % 3 as b, cast(p_partkey % 7 as double) as regularization, p_partkey % 4 as min_rating from part)
select cast(a as double) as ndcg_at_k, cast(b as double) as recall_at_k, regularization, min_rating from g order by a desc, b desc, regularization desc, min_rating desc limit 1""")
def grid_choice(spark, directory):
    """Best grid point by the four-key rule."""
    grid = i.table(spark, directory, "part").select(
        (F.col("p_size") % 5).cast("double").alias("ndcg_at_k"), (F.col("p_size") % 3).cast("double").alias("recall_at_k"),
        (F.col("p_partkey") % 7).cast("double").alias("regularization"), (F.col("p_partkey") % 4).alias("min_rating"))
    return metrics.select_best(grid)


# --- text and cold start ------------------------------------------------------------------------------------

_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
TEXT = i.MOVIES + f""",
doc as (select movie_id, title || ' ' || replace(genres, '|', ' ') || ' ' || overview as text from movies),
words as (select movie_id, [x for x in regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') if not list_contains({_STOP_SQL}, x)] as w from doc),
tokens as (select movie_id, unnest(list_concat(w, [w[k] || ' ' || w[k + 1] for k in range(1, len(w))])) as term from words),
tf as (select movie_id, term, count(*) as tf from tokens group by 1, 2),
vocab as (select term, ln((1 + (select count(*) from doc)) / cast(1 + count(*) as double)) + 1 as idf from tf group by term),
raw as (select movie_id, term, tf * idf as weight from tf join vocab using (term)),
vec as (select movie_id, term, weight / sqrt(sum(weight * weight) over (partition by movie_id)) as weight from raw)
"""


@query(f"with {TEXT} select movie_id, count(*) as terms, round(sum(weight), 5) as total, round(max(weight), 6) as highest from vec group by 1")
def tfidf_vectors(spark, directory):
    """TF-IDF vectors of all movies, summed up per movie."""
    vectors, _ = tx.tfidf(i.movies(spark, directory), STOP)
    return vectors.groupBy("movie_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 5).alias("total"),
                                           F.round(F.max("weight"), 6).alias("highest"))


@query(f"""with {TEXT}, q as (select s_suppkey as user_id, movie_id, weight, term from supplier join vec on movie_id = cast(s_suppkey as varchar)),
s as (select q.user_id, v.movie_id, sum(q.weight * v.weight) as similarity from q join vec v using (term) group by 1, 2)
select user_id, count(*) as movies, round(sum(similarity), 4) as total, round(max(similarity), 6) as highest from s group by 1""")
def text_similarities(spark, directory):
    """Cosine of one example movie per supplier with all movies."""
    vectors, _ = tx.tfidf(i.movies(spark, directory), STOP)
    vectors = settle(vectors)
    examples = i.table(spark, directory, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_suppkey").cast("string").alias("movie_id"))
    none = vectors.where("false").select(F.lit(0).cast("bigint").alias("user_id"), "term", "weight")
    return tx.text_similarity(none, examples, vectors).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("movies"), F.round(F.sum("similarity"), 4).alias("total"), F.round(F.max("similarity"), 6).alias("highest"))


@query("""with d as (select doc_id, regexp_replace(replace(text, '¢', 'c'), '\\s*\\([0-9]{4}\\)\\s*$', '') as t from documents),
p as (select doc_id, regexp_replace(lower(regexp_replace(strip_accents(t), '[^\\x00-\\x7F]', '', 'g')), '^\\s+|\\s+$', '', 'g') as t from d)
select doc_id, sha256(regexp_replace(regexp_replace(t, '^(the|an|a)\\s+', ''), '[^a-z0-9]', '', 'g')) as digest from p""")
def normalized_titles(spark, directory):
    """Title normalisation over whole documents."""
    return i.table(spark, directory, "documents").select("doc_id", F.sha2(normalize_title(F.col("text")), 256).alias("digest"))


@query(f"""with {i.MOVIES}, n as (select movie_id, replace(regexp_replace(title, ' \\([0-9]+\\)$', ''), ' ', '') as key from movies),
w as (select s_suppkey as user_id, replace(p_name, ' ', '') as key from supplier join part on p_partkey = s_suppkey)
select user_id, movie_id from w join n using (key)""")
def matched_titles(spark, directory):
    """Example titles matched to all movies of the same name."""
    parts = i.table(spark, directory, "part").select(F.col("p_partkey").alias("user_id"), "p_name")
    wanted = i.table(spark, directory, "supplier").select(F.col("s_suppkey").alias("user_id")).join(parts, "user_id").select(
        "user_id", F.array(F.concat(F.lit("The "), F.initcap("p_name"), F.lit("! (1999)"))).alias("titles"))
    return tx.match_titles(wanted, "titles", i.movies(spark, directory))


def _profiles(spark, directory):
    """A profile per supplier: genres of its part, its document as liked text, its nation as disliked."""
    parts = i.table(spark, directory, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_type", "p_brand", "p_name")
    docs = i.table(spark, directory, "documents").select(F.col("doc_id").alias("s_suppkey"), "text")
    nation = i.table(spark, directory, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = (i.table(spark, directory, "supplier").join(parts, "s_suppkey").join(docs, "s_suppkey", "left").join(nation, "s_nationkey"))
    none = F.array().cast("array<string>")
    return rows.select((F.col("s_suppkey") + 1_000_001).alias("user_id"), F.struct(
        F.array("p_type").alias("liked_genres"), F.array(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string"))).alias("excluded_genres"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array("p_name")).otherwise(none).alias("liked_titles"), none.alias("disliked_titles"),
        F.coalesce("text", F.lit("")).alias("likes_summary"), F.col("n_name").alias("dislikes_summary")).alias("profile"))


@query()
def cold_start_slates(spark, directory):
    """Slates of users without history from their profiles."""
    pairs = settle(i.pairs(spark, directory))
    top = coldstart.cold_start_rank(_profiles(spark, directory), i.movies(spark, directory), op.popularity(pairs), stop_words=STOP)
    return top.select("user_id", "movie_id", "rank", F.round("score", 6).alias("score"), "reason")


@query(f"""with {LIKES}, {i.USERS}, ids as (select user_id from users union all select 5000000 + n_nationkey from nation)
select method, fallback_reason, count(*) as users from (select user_id, case when user_id in (select user_id from liked) then 'ease'
    when user_id > 1000000 and user_id < 5000000 and user_id % 2 = 1 and trim((select max(self_description_likes) from users u where u.user_id = ids.user_id)) <> '' then 'llm_cold_start' else 'popularity' end as method,
  case when user_id in (select user_id from liked) then null when user_id >= 5000000 then 'user_not_in_dataset'
    when trim((select max(self_description_likes) from users u where u.user_id = ids.user_id)) <> '' then case when user_id > 1000000 and user_id % 2 = 1 then null else 'cold_start_profile_unavailable' end
    else 'no_description_or_positive_history' end as fallback_reason from ids) x group by 1, 2""")
def user_routes(spark, directory):
    """How many users are served by which method, and why some only get popular movies."""
    everyone = i.users(spark, directory)
    strangers = i.table(spark, directory, "nation").select((F.col("n_nationkey") + 5_000_000).cast("bigint").alias("user_id"))
    ready = everyone.where("user_id > 1000000 and user_id % 2 = 1")
    routes = coldstart.route_users(everyone.select("user_id").unionByName(strangers), op.positives(i.pairs(spark, directory)), ready, everyone)
    return routes.groupBy("method", "fallback_reason").agg(F.count(F.lit(1)).alias("users"))


@query()
def routed_slates(spark, directory):
    """Every user's slate by its route."""
    model, _ = _model(spark, directory)
    profiles = _profiles(spark, directory)
    cold = coldstart.cold_start_rank(profiles, i.movies(spark, directory), model.movies, stop_words=STOP)
    routes = coldstart.route_users(i.users(spark, directory), model.histories.where("liked"), profiles, i.users(spark, directory))
    out = coldstart.serve_routes(routes, ease.recommend(model), cold, model.histories, model.supported, 20)
    return out.withColumn("score", F.round("score", 6))


GENRE_NAMES = ("Comedy", "Science Fiction", "Romance", "Animation", "Documentary", "Drama", "Horror", "Western")


@query()
def genre_mentions(spark, directory):
    """Genres named, or nearly named, in whole documents."""
    return tx.genre_mentions(i.table(spark, directory, "documents"), "doc_id", "text", GENRE_NAMES)

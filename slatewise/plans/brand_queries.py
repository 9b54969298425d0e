"""The item-item model over brands: all line items, but so few items that SQL can invert the same matrix.

A customer's best quantity of a brand is the rating, brands are the movies. What the queries do with the model (ad-hoc
histories, penalties, replay, grid, stored versions, candidate checks) is the code that serves the whole catalogue.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from slatewise.operators import ease, metrics
from slatewise.operators.split import split
from slatewise.plans import inputs as i
from slatewise.plans.model_queries import BRAND_MODEL, _brand_model, brand_pairs, brands
from slatewise.plans.registry import query
from slatewise.session import fresh_path, settle

FIRST = 5


def _score(df, *more):
    return df.select("user_id", "movie_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"), *more)


def _baskets(spark, directory):
    """Histories from outside the training: brands a supplier shipped fifty pieces of, liked where a discount was high."""
    lines = i.table(spark, directory, "lineitem").where("l_quantity = 50").select("l_partkey", "l_suppkey", "l_discount")
    parts = i.table(spark, directory, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("movie_id"))
    return lines.join(parts, "l_partkey").select(F.col("l_suppkey").alias("user_id"), "movie_id", (F.col("l_discount") >= 0.08).alias("liked"))


BASKETS = BRAND_MODEL + """,
basket as (select l_suppkey as user_id, p_brand as b, bool_or(l_discount >= 0.08) as liked_it from lineitem join part on l_partkey = p_partkey where l_quantity = 50 group by 1, 2),
personal as (select user_id, dst as b, sum(weight) as score, 'ease' as method from basket join weights on src = b where liked_it group by 1, 2),
fallback as (select s_suppkey as user_id, ids.b, likes / cast((select count(distinct user_id) from pairs) as double) as score, 'popularity' as method from supplier, ids
  where s_suppkey not in (select user_id from basket join ids using (b) where liked_it)),
open as (select x.*, row_number() over (partition by user_id order by score desc, likes desc, b) as rank from (select * from personal union all select * from fallback) x join ids using (b)
  where not exists (select 1 from basket k where k.user_id = x.user_id and k.b = x.b))
"""


@query(f"{BASKETS} select user_id, b as movie_id, rank, round(score, 4) as score, method from open where rank <= {FIRST}")
def brand_profile_slates(spark, directory):
    """Slates for histories that were not trained on, popular brands where nothing was liked."""
    baskets = _baskets(spark, directory).groupBy("user_id", "movie_id").agg(F.max("liked").alias("liked"))
    users = i.table(spark, directory, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return _score(ease.recommend_all(_brand_model(spark, directory), users, FIRST, histories=baskets), "method")


def _brand_fees(spark, directory):
    """The highest retail price of a brand as its fee, unknown for brands that end in 5."""
    known = ~F.col("p_brand").endswith("5")
    return i.table(spark, directory, "part").groupBy(F.col("p_brand").alias("movie_id")).agg(
        F.max(F.when(known, F.col("p_retailprice"))).alias("fee"), F.max(F.when(known, "known").otherwise("missing")).alias("fee_status"))


PENALTY = 0.00001
PRICED = BRAND_MODEL + f""",
fees as (select p_brand as b, max(p_retailprice) filter (not ends_with(p_brand, '5')) as fee from part group by 1),
penalties as (select b, fee, {PENALTY} * coalesce(fee, (select max(fee) from fees)) as penalty from fees),
scored as (select user_id, dst as b, sum(weight) as base from liked join weights on src = b group by 1, 2),
free as (select s.*, likes, fee, base - penalty as priced from scored s join ids using (b) join penalties using (b)
  where not exists (select 1 from liked x where x.user_id = s.user_id and x.b = s.b)),
slates as (select 'control' as policy, *, row_number() over (partition by user_id order by base desc, likes desc, b) as rank from free union all
  select 'treatment', *, row_number() over (partition by user_id order by priced desc, likes desc, b) from free)
"""


def _liked_only(model):
    return replace(model, histories=model.histories.where("liked"))


@query(f"{PRICED} select user_id, b as movie_id, rank, round(priced, 4) as score, round(base, 4) as base_score from slates where policy = 'treatment' and rank <= {FIRST}")
def brand_penalised_slates(spark, directory):
    """Slates with points taken off for a brand's fee; an unknown fee counts as the highest one."""
    model = _liked_only(_brand_model(spark, directory))
    top = ease.recommend(model, None, FIRST, ease.licence_penalties(model.movies, _brand_fees(spark, directory), PENALTY))
    return _score(top, F.round("base_score", 4).alias("base_score"))


@query(f"""{PRICED}, per_user as (select policy, user_id, list(b) as ids, case when count(fee) = count(*) then avg(fee) end as fee,
  count(*) filter (fee is null) as unknown, avg(base) as score from slates where rank <= {FIRST} group by 1, 2),
shared as (select avg(len(list_intersect(a.ids, c.ids)) / cast(len(a.ids) as double)) as o from per_user a join per_user c using (user_id) where a.policy = 'control' and c.policy = 'treatment')
select policy, count(*) as users, cast(sum(unknown) as bigint) as unknown_fees, round(case when count(fee) = count(*) then avg(fee) end, 4) as mean_fee,
  round(avg(score), 6) as mean_base_score, round((select o from shared), 6) as mean_overlap from per_user group by 1""")
def brand_policy_replay(spark, directory):
    """Overlap, fees and scores of slates with and without the penalty, over all customers."""
    found = ease.policy_replay(_liked_only(_brand_model(spark, directory)), _brand_fees(spark, directory), PENALTY, k=FIRST)
    return found.select("policy", "users", "unknown_fees", F.round("mean_fee", 4).alias("mean_fee"), F.round("mean_base_score", 6).alias("mean_base_score"),
                        F.round("mean_overlap", 6).alias("mean_overlap"))


@query(f"""{BRAND_MODEL},
scored as (select user_id, dst as b, sum(weight) as score from liked join weights on src = b group by 1, 2),
open as (select s.*, row_number() over (partition by user_id order by score desc, likes desc, b) as rank from scored s join ids using (b)
  where not exists (select 1 from liked x where x.user_id = s.user_id and x.b = s.b))
select user_id, b as movie_id, rank, round(score, 4) as score from open where rank <= {FIRST}""")
def brand_stored_slates(spark, directory):
    """Slates of a model that was stored and loaded again by its version."""
    version = fresh_path(spark, "model")
    ease.save_model(_liked_only(_brand_model(spark, directory)), version)
    return _score(ease.recommend(ease.load_model(spark, version), None, FIRST))


CHECKS = ("movies_match_training", "movies_in_catalogue", "finite_weights", "finite_popularity", "fallback_nonempty", "same_parameters")


@query("with c(name) as (values " + ", ".join(f"('{c}')" for c in ("good", *CHECKS)) + "), k(name) as (values " + ", ".join(f"('{c}')" for c in CHECKS) + """)
select c.name as candidate, k.name as "check", c.name <> k.name as passed from c, k where (select count(*) from lineitem) > 0""")
def brand_candidate_checks(spark, directory):
    """A good candidate, and one that fails each check, against the model in use."""
    running = _brand_model(spark, directory)
    known = settle(running.movies)
    catalogue = known.select("movie_id", "title")
    broken = F.col("movie_id") == known.agg(F.min("movie_id")).first()[0]
    infinite = F.unhex(F.concat(F.lit("0000807f"), F.substring(F.hex("data"), 9, 1 << 30)))
    candidates = {
        "good": (running, catalogue, catalogue),
        "movies_match_training": (running, catalogue.where(~broken), catalogue),
        "movies_in_catalogue": (running, catalogue, catalogue.where(~broken)),
        "finite_weights": (replace(running, panels=running.panels.withColumn("data", infinite)), catalogue, catalogue),
        "finite_popularity": (replace(running, movies=known.withColumn("popularity", F.when(broken, float("nan")).otherwise(F.col("popularity")))), catalogue, catalogue),
        "fallback_nonempty": (replace(running, movies=known.withColumn("popularity", F.lit(0.0))), catalogue, catalogue),
        "same_parameters": (replace(running, regularization=running.regularization + 1), catalogue, catalogue)}
    found = None
    for name, (model, training, serving) in candidates.items():
        rows = ease.candidate_checks(model, running, training, serving).select(F.lit(name).alias("candidate"), "check", "passed")
        found = rows if found is None else found.unionByName(rows)
    return found


# --- grid and protocol --------------------------------------------------------------------------------------

LAMBDAS, THRESHOLDS, RELEVANT, BASELINE = (20.0, 200.0), (9, 10), 10, (100.0, 10)

PARTS = """with recursive pairs as (select o_custkey as user_id, p_brand as b, cast(ceil(max(l_quantity) / 5) as int) as rating
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2),
r as (select *, row_number() over (partition by user_id order by sha256('42:' || cast(user_id as varchar) || ':' || b), b) as place, count(*) over (partition by user_id) as c from pairs),
s as (select *, least(greatest(1, cast(floor(c * 0.2) as bigint)), c - 2) as v from r),
t as (select *, least(greatest(1, cast(floor(c * 0.2) as bigint)), c - v - 1) as w from s),
parts as (select *, case when c < 3 then 'training' when place <= v then 'validation' when place <= v + w then 'test' else 'training' end as part from t)"""


def _measured(tag: str, train: str, held: str, regularization: float, threshold: int, popularity_only: bool = False) -> str:
    """CTEs that end in m_<tag>, the metrics of one model on one held-out part."""
    return f""",
tr_{tag} as (select * from parts where part in ({train})), he_{tag} as (select * from parts where part = '{held}'),
lk_{tag} as (select user_id, b from tr_{tag} where rating >= {threshold}),
id_{tag} as (select b, count(*) as likes, row_number() over (order by b) as i from lk_{tag} group by b),
co_{tag} as (select x.b as src, y.b as dst, count(*) as c from lk_{tag} x join lk_{tag} y on x.user_id = y.user_id group by 1, 2),
ce_{tag} as (select x.i, y.i as j, coalesce(c, 0) + case when x.i = y.i then {regularization} else 0 end as v from id_{tag} x cross join id_{tag} y left join co_{tag} on src = x.b and dst = y.b),
li_{tag} as (select i, list(cast(v as double) order by j) as line from ce_{tag} group by 1),
st_{tag} as (select 0 as k, (select list(line order by i) from li_{tag}) as m union all
  select k + 1, [[case when i = k + 1 and j = k + 1 then 1 / m[i][j] when i = k + 1 then m[i][j] / m[i][i] when j = k + 1 then -m[i][j] / m[j][j]
    else m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] end for j in range(1, len(m) + 1)] for i in range(1, len(m) + 1)] from st_{tag} where k < len(m)),
we_{tag} as (select s.b as src, d.b as dst, -m[s.i][d.i] / m[d.i][d.i] as weight from st_{tag}, id_{tag} s, id_{tag} d where s.i <> d.i and k = len(m)),
ta_{tag} as (select distinct user_id, b from he_{tag} where rating >= {RELEVANT}), us_{tag} as (select distinct user_id from ta_{tag}),
sc_{tag} as (select user_id, dst as b, sum(weight) as score from lk_{tag} join us_{tag} using (user_id) join we_{tag} on src = b where {not popularity_only} group by 1, 2 union all
  select user_id, b, cast(likes as double) from us_{tag}, id_{tag} where {popularity_only} or user_id not in (select user_id from lk_{tag})),
ra_{tag} as (select x.user_id, x.b, row_number() over (partition by x.user_id order by score desc, likes desc, x.b) as rank from sc_{tag} x join id_{tag} using (b)
  where not exists (select 1 from tr_{tag} k where k.user_id = x.user_id and k.b = x.b)),
re_{tag} as (select * from ra_{tag} where rank <= {FIRST}),
pu_{tag} as (select user_id, count(*) as targets, count(k.rank) as hits, count(l.b) as supported, coalesce(sum(1 / log2(k.rank + 1)), 0) as gain
  from ta_{tag} a left join re_{tag} k using (user_id, b) left join id_{tag} l using (b) group by 1),
m_{tag} as (select count(*) as evaluated_users, cast(sum(targets) as bigint) as relevant_interactions, round(avg(hits / {FIRST}e0), 6) as precision_at_k,
  round(avg(hits / cast(targets as double)), 6) as recall_at_k,
  round(avg(gain / (select sum(1 / log2(g.i + 1)) from (select unnest(range(1, {FIRST + 1})) as i) g where g.i <= least(targets, {FIRST}))), 6) as ndcg_at_k,
  round(avg(case when hits > 0 then 1e0 else 0e0 end), 6) as hit_rate_at_k, round(sum(supported) / cast(sum(targets) as double), 6) as supported_target_fraction,
  round((select count(distinct b) from re_{tag}) / cast((select count(distinct p_brand) from part) as double), 6) as catalog_coverage,
  (select count(distinct user_id) from he_{tag}) - count(*) as users_without_relevant_ratings from pu_{tag})"""


def _protocol() -> str:
    points = [(r, t) for t in THRESHOLDS for r in LAMBDAS]
    both = "'training', 'validation'"
    sql = PARTS
    for n, point in enumerate(points):
        sql += _measured(f"g{n}", "'training'", "validation", *point) + _measured(f"f{n}", both, "test", *point)
    for stage, train in (("validation", "'training'"), ("test", both)):
        sql += _measured(f"b_{stage}", train, stage, *BASELINE) + _measured(f"p_{stage}", train, stage, *BASELINE, True)
    row = lambda stage, name, point, tag: f"select '{stage}' as stage, '{name}' as model, {point[0]}e0 as regularization, {point[1]} as min_rating, * from m_{tag}"
    sql += ", grid as (" + " union all ".join(row("validation", "grid", p, f"g{n}") for n, p in enumerate(points)) + ")"
    sql += ", final as (" + " union all ".join(row("test", "selected", p, f"f{n}") for n, p in enumerate(points)) + ")"
    sql += ", best as (select regularization, min_rating from grid order by ndcg_at_k desc, recall_at_k desc, regularization desc, min_rating desc limit 1)"
    rows = ["select * from grid", "select * from final where (regularization, min_rating) in (select (regularization, min_rating) from best)"]
    rows += [row(stage, name, BASELINE, f"{name[0]}_{stage}") for stage in ("validation", "test") for name in ("baseline", "popularity")]
    return sql + " " + " union all ".join(rows)


@query(_protocol())
def brand_evaluation(spark, directory):
    """The whole protocol: a grid of two λ and two thresholds on validation, baseline and popularity, the chosen model on test."""
    parts = settle(split(brand_pairs(spark, directory)))
    found = metrics.offline_evaluation(parts, brands(spark, directory), LAMBDAS, THRESHOLDS, FIRST, RELEVANT, BASELINE)
    return found.withColumns({f.name: F.round(f.name, 6) for f in found.schema if f.dataType.typeName() == "double"})

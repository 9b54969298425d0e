"""Redaction, fingerprints, request log, snapshots, lineage, profiles, exports and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewise.functions import redact as rd
from slatewise.functions import scalars as s
from slatewise.operators import lineage as li
from slatewise.operators.interactions import cold_start_users
from slatewise.plans import inputs as i
from slatewise.plans.registry import query
from slatewise.session import fresh_path, written
from slatewise.sources import records as rc
from slatewise.sources import tables
from slatewise.sources.stream import append_new, with_fingerprint


# Expected text is written out by hand: the samples hold one kind of secret, a quoted token.
@query("""with d as (select doc_id, text, regexp_replace(text, '(token) = "[0-9a-fA-F]*"', '\\1 = "[redacted]"', 'gi') as safe from documents)
select doc_id, sha256(safe) as digest, safe <> text as redacted from d""")
def redacted_documents(spark, directory):
    """Documents with secret assignments, headers and URL credentials masked."""
    docs = rd.redact(i.spread(i.table(spark, directory, "documents").select("doc_id", "text")), ["text"])
    return docs.select("doc_id", F.sha2("text", 256).alias("digest"), "redacted")


@query("""select page_id, sha256('https://' || regexp_replace(url, '^https?://', '') || case when url like '%?%' then '&' else '?' end || 'api_key=[redacted]&x=1') as digest from pages""")
def redacted_urls(spark, directory):
    """Page addresses with a login and a secret parameter."""
    url = F.concat(F.lit("https://user:pw@"), F.regexp_replace("url", "^https?://", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"),
                   F.lit("api_key="), F.col("page_id").cast("string"), F.lit("&x=1"))
    return i.table(spark, directory, "pages").select("page_id", F.sha2(rd.redact_text(url), 256).alias("digest"))


#: Awkward secrets around a customer's name ({n}), and what must be left of them.
_AWKWARD = {
    '{"password": ["x1", "{n}"], "a": 1}': '{"password": "[redacted]", "a": 1}',
    '{"secret": {"a": 1, "b": "{n}"}, "c": [{"auth": {"d": "{n}"}}]}': '{"secret": "[redacted]", "c": [{"auth": "[redacted]"}]}',
    'password="{n},def': 'password="[redacted]"',
    "see https://user:p@{n}@host/x": "see https://host/x",
    "GET /x?api%5Fkey={n}&y=2": "GET /x?api%5Fkey=[redacted]&y=2",
    "GET /go?next=https%3A%2F%2Fh%2F%3Fpassword%3D{n}&y=2": "GET /go?next=https%3A%2F%2Fh%2F%3Fpassword%3D[redacted]&y=2",
    "input_tokens: 5, name: {n}": "input_tokens: 5, name: {n}",
    'x {"secret": {"a": {"c": 1}, "b": "{n}"}} y': 'x {"secret": "[redacted]"} y',
    "my_token: [a, [b, c], {n}], z: 1": 'my_token: "[redacted]", z: 1',
    'password: {"a": "}", "b": [{n}, {]} z': 'password: "[redacted]"',
}


@query(" union all ".join(f"select c_custkey, {n} as number, replace('{safe}', '{{n}}', replace(c_name, '#', '-')) as safe from customer" for n, safe in enumerate(_AWKWARD.values())))
def redaction_cases(spark, directory):
    """Secrets in lists, nested records, open quotes, logins with two signs, and encoded names."""
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("number"), F.lit(text).alias("text")) for n, text in enumerate(_AWKWARD)]))
    rows = i.spread(i.table(spark, directory, "customer").select("c_custkey", "c_name")).select("c_custkey", "c_name", cases.alias("case"))
    text = F.replace("case.text", F.lit("{n}"), F.translate("c_name", "#", "-"))
    return rows.select("c_custkey", F.col("case.number").alias("number"), rd.redact_text(rd.redact_json(text)).alias("safe"))


@query("""select c_custkey, '{"api_key": "[redacted]", "input_tokens": ' || cast(c_custkey as varchar) || ', "nested": [{"session_id": "[redacted]", "name": "' || c_name || '"}]}' as masked from customer""")
def redacted_json(spark, directory):
    """Values of any type under secret names of JSON records; token counts survive."""
    text = F.concat(F.lit('{"api_key": {"a": [1, 2]}, "input_tokens": '), F.col("c_custkey").cast("string"), F.lit(', "nested": [{"session_id": 7, "name": "'),
                    F.col("c_name"), F.lit('"}]}'))
    return i.table(spark, directory, "customer").select("c_custkey", rd.redact_json(text).alias("masked"))


@query("""select c_custkey, 'sha256:' || sha256('{"balance":' || cast(cast(floor(c_acctbal) as bigint) as varchar) || ',"missing":null,"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') as version from customer""")
def content_versions(spark, directory):
    """Digest of the canonical JSON of customer records."""
    return i.table(spark, directory, "customer").select("c_custkey", s.content_version({
        "segment": F.col("c_mktsegment"), "name": F.col("c_name"), "balance": F.floor("c_acctbal"), "missing": F.lit(None).cast("string")}).alias("version"))


@query("""select o_orderkey, sha256('{"broker_timestamp_ms":' || cast(epoch_ms(o_orderdate) as varchar) || ',"broker_timestamp_type":0,"headers":[["trace","' || to_base64(encode(o_orderstatus))
  || '"],["empty",null]],"key":null,"value":"' || to_base64(encode(o_orderpriority)) || '"}') as fingerprint from orders""")
def source_fingerprints(spark, directory):
    """Replay fingerprints of records made from orders."""
    rows = i.table(spark, directory, "orders")
    headers = F.array(F.struct(F.lit("trace").alias("key"), F.encode("o_orderstatus", "UTF-8").alias("value")),
                      F.struct(F.lit("empty").alias("key"), F.lit(None).cast("binary").alias("value")))
    return rows.select("o_orderkey", s.source_fingerprint(F.lit(None).cast("binary"), F.encode("o_orderpriority", "UTF-8"), headers,
                                                          F.unix_millis("o_orderdate"), F.lit(0)).alias("fingerprint"))


@query(f"""with {i.LOG}, t as (select "offset" from log where "offset" % 4 = 0)
select 'appended' as outcome, count(*) as n from log where "offset" % 4 <> 0 union all select 'conflicts', count(*) from log where "offset" % 40 = 0""")
def append_outcome(spark, directory):
    """Appending the log where a quarter is stored already, a tenth of that with other content."""
    batch = with_fingerprint(i.log_lines(spark, directory))
    changed = F.when(F.col("offset") % 40 == 0, F.concat("source_fingerprint", F.lit("x"))).otherwise(F.col("source_fingerprint"))
    stored = batch.where("offset % 4 = 0").withColumn("source_fingerprint", changed)
    fresh, conflicts = append_new(batch.unionByName(batch.where("offset % 3 = 0")), stored)
    count = lambda df, name: df.agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("n"))
    return count(fresh, "appended").unionByName(count(conflicts, "conflicts"))


@query(f"""with {i.REQUESTS}, p as (select *, case when user_id is null and event_id % 2 = 0 then 'user_not_positive' end as problem from requests)
select request_id, problem, cast(1 as bigint) as schema_version, event_id % 5 = 0 as redacted from p""")
def request_log_entries(spark, directory):
    """Validated and redacted request records."""
    rows = i.request_log(spark, directory).withColumn("_id", F.split("request_id", "-")[1].cast("bigint"))
    rows = rows.withColumns({"user_id": F.when(F.col("user_id").isNull() & (F.col("_id") % 2 == 0), F.lit(0)).otherwise(F.col("user_id")),
                             "note": F.when(F.col("_id") % 5 == 0, "password: hunter2").otherwise("token_count: 3")}).drop("_id")
    out = rc.prepare_request_log(rows, ["note"])
    return out.select("request_id", "problem", F.col("schema_version").cast("bigint").alias("schema_version"), "redacted")


@query(f"""with {i.REQUESTS}, t as (select request_id, event_id, c.copy from requests join (values (1), (2)) c(copy) on c.copy = 1 or event_id % 3 = 0 where user_id is not null)
select request_id, count(*) as copies, max(case when event_id % 6 = 0 then 1 else 0 end) = 1 as conflict,
  case when max(case when event_id % 6 = 0 then 1 else 0 end) = 1 then 0 else count(*) - 1 end as duplicates from t group by 1""")
def request_log_conflicts(spark, directory):
    """Repeated request ids with equal or different content."""
    rows = i.request_log(spark, directory).where("user_id is not null").withColumn("_id", F.split("request_id", "-")[1].cast("bigint"))
    again = rows.where("_id % 3 = 0").withColumn("latency_ms", F.when(F.col("_id") % 6 == 0, -1.0).otherwise(F.col("latency_ms")))
    prepared = rc.prepare_request_log(rows.unionByName(again).drop("_id").withColumn("note", F.lit("x")), ["note"])
    return rc.request_log_conflicts(prepared)


# --- snapshots: orders as versions of their customer ------------------------------------------------------

def _snapshots(spark, directory):
    orders = i.table(spark, directory, "orders")
    return orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("snapshot_id"), F.lit("meta").alias("source_id"), F.lit("user").alias("entity_type"),
        (F.col("o_custkey") + 1).cast("string").alias("entity_id"), F.col("o_orderdate").alias("fetched_at"),
        F.struct("o_orderstatus", "o_orderpriority").alias("record"))


SNAPSHOTS = """
snaps as (select lpad(cast(o_orderkey as varchar), 10, '0') as snapshot_id, cast(o_custkey + 1 as varchar) as entity_id, o_orderdate as fetched_at, o_orderstatus, o_orderpriority from orders)
"""


@query(f"""with {SNAPSHOTS}, r as (select *, row_number() over (partition by entity_id order by fetched_at desc, snapshot_id desc) as place from snaps where fetched_at <= timestamp '1998-06-01')
select entity_id, snapshot_id, epoch_us(fetched_at) as fetched_us, o_orderstatus as status from r where place = 1""")
def snapshots_as_of(spark, directory):
    """Newest snapshot of every entity at a cut-off."""
    return rc.latest_snapshot_as_of(_snapshots(spark, directory), "1998-06-01").select(
        "entity_id", "snapshot_id", F.unix_micros("fetched_at").alias("fetched_us"), F.col("record.o_orderstatus").alias("status"))


@query(f"""with {SNAPSHOTS}, {i.HISTORY}, h as (select distinct user_id, "timestamp" as at from history)
select h.user_id, epoch_us(h.at) as at_us, s.snapshot_id from h asof left join (select distinct on (entity_id, fetched_at) cast(entity_id as bigint) as user_id, fetched_at, snapshot_id
  from snaps order by entity_id, fetched_at, snapshot_id desc) s on h.user_id = s.user_id and h.at >= s.fetched_at""")
def snapshots_per_event(spark, directory):
    """The snapshot each event could have seen: a per-row as-of join."""
    events = i.history(spark, directory).select("user_id", F.col("timestamp").alias("at")).distinct()
    snaps = _snapshots(spark, directory).select(F.col("entity_id").cast("bigint").alias("user_id"), "snapshot_id", "fetched_at")
    return rc.snapshot_for_each(events, snaps, "user_id", "at", 30 * 86_400).select(
        "user_id", F.unix_micros("at").alias("at_us"), F.col("snapshot.snapshot_id").alias("snapshot_id"))


@query("""with f as (select o_orderkey as k, case when o_orderkey % 17 = 0 then 'failed' when o_orderkey % 19 = 0 then 'lost' else 'success' end as status from orders)
select 'fetch-' || cast(k as varchar) as id, case when k % 29 = 0 then 'finished_before_start' when status = 'lost' then 'status_invalid' end as problem from f where k % 29 = 0 or status = 'lost'
union all select 'snap-' || cast(k as varchar), case when status = 'failed' then 'failed_fetch_has_snapshot' when k % 7 = 0 then 'entity_not_requested' else 'fetched_outside_fetch' end from f
  where status = 'failed' or k % 7 = 0 or k % 29 = 0 or k % 11 = 0""")
def snapshot_violations(spark, directory):
    """Fetches and snapshots that do not fit together."""
    k = F.col("o_orderkey")
    orders = i.table(spark, directory, "orders")
    fetches = orders.select(
        F.concat(F.lit("fetch-"), k.cast("string")).alias("fetch_id"), F.lit("meta").alias("source_id"), F.lit("user").alias("entity_type"),
        F.array(F.concat(F.lit("00"), (F.col("o_custkey") + 1).cast("string"))).alias("requested_ids"), F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.when(k % 29 == 0, F.expr("interval -1 hours")).otherwise(F.expr("interval 1 hours"))).alias("finished_at"),
        F.when(k % 17 == 0, "failed").when(k % 19 == 0, "lost").otherwise("success").alias("status"), F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("error_type"))
    snaps = orders.select(
        F.concat(F.lit("snap-"), k.cast("string")).alias("snapshot_id"), F.concat(F.lit("fetch-"), k.cast("string")).alias("fetch_id"), F.lit("meta").alias("source_id"),
        F.lit("user").alias("entity_type"), (F.col("o_custkey") + 1 + F.when(k % 7 == 0, 1).otherwise(0)).cast("string").alias("entity_id"),
        (F.col("o_orderdate") + F.when(k % 11 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 1 minutes"))).alias("fetched_at"))
    return rc.snapshot_violations(fetches, snaps)


@query("""select o_orderkey, 'sha256:' || sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') as content_version from orders""")
def stamped_snapshots(spark, directory):
    """Content versions of all snapshots."""
    rows = rc.stamp_snapshots(_snapshots(spark, directory), ["o_orderstatus", "o_orderpriority"])
    return rows.select(F.col("snapshot_id").cast("bigint").alias("o_orderkey"), "content_version")


# --- lineage -------------------------------------------------------------------------------------------------

@query("""with r as (select o_orderkey as k, case when o_orderkey % 41 = 0 then 500 else 200 end as status, o_orderkey % 60 as v, case when o_orderkey % 37 = 0 then 99 else o_orderkey % 60 % 25 end as m from orders),
j as (select r.*, n.n_nationkey as served, case when n.n_nationkey is not null then n.n_regionkey end as t from r left join nation n on n.n_nationkey = r.v),
x as (select *, t <> 3 and t is not null as data_ok, t is not null and t <> 4 as rev_ok from j)
select k as request_id, case when status <> 200 then 'request_not_successful' when served is null then 'serving_version_unknown' when served <> m then 'model_differs_from_serving_version'
  when not data_ok then 'training_files_changed' when not rev_ok then 'revision_not_recorded' end as reason, data_ok as dataset_verified, rev_ok as revision_recorded from x""")
def lineage_trace(spark, directory):
    """Responses traced to serving versions (nations) and training sets (regions)."""
    k = F.col("o_orderkey")
    requests = i.table(spark, directory, "orders").select(
        k.alias("request_id"), F.when(k % 41 == 0, 500).otherwise(200).alias("status"), (k % 60).cast("int").alias("serving_version"),
        F.when(k % 37 == 0, 99).otherwise(k % 60 % 25).cast("int").alias("model_version"))
    nation = i.table(spark, directory, "nation")
    serving = nation.select(F.col("n_nationkey").alias("serving_version"), F.col("n_nationkey").alias("model_version"), F.col("n_regionkey").alias("training_id"))
    region, r = i.table(spark, directory, "region"), F.col("r_regionkey")
    training = region.select(r.alias("training_id"), F.col("r_name").alias("dataset_version"), F.col("r_name").alias("actual_version"),
                             F.when(r == 4, "unknown").otherwise(F.substring(F.sha2("r_name", 256), 1, 40)).alias("revision"))
    files = nation.select(F.col("n_regionkey").alias("training_id"), F.col("n_name").alias("name"), F.col("n_name").alias("expected"),
                          F.when(F.col("n_regionkey") == 3, "changed").otherwise(F.col("n_name")).alias("actual"))
    return li.trace_lineage(requests, serving, training, files).select("request_id", "reason", "dataset_verified", "revision_recorded")


@query("""select n_regionkey as training_id, 'sha256:' || sha256(string_agg(n_name || '=' || n_name, ';' order by n_name || '=' || n_name)) as version from nation group by 1""")
def dataset_versions(spark, directory):
    """One version per training set from its files."""
    return li.dataset_version(i.table(spark, directory, "nation").select(F.col("n_regionkey").alias("training_id"), F.col("n_name").alias("name"), F.col("n_name").alias("actual")))


@query("""with p as (select c_custkey as k from customer), a as (select o_orderkey as k from orders)
select 'use_without_profile' as rule, (select count(*) from orders where o_custkey % 50 = 0) as n
union all select 'use_before_profile', (select count(*) from orders where o_custkey % 50 <> 0 and o_orderdate < timestamp '1996-01-01')
union all select 'snapshot_of_other_user', (select count(*) from orders where o_orderkey % 10 = 0)
union all select 'generated_without_success', (select count(*) from p left join orders on o_orderkey = k where k % 2 = 0 and not coalesce(o_orderstatus = 'F' and k % 6 <> 0, false))
union all select 'legacy_with_attempt', (select count(*) from p where k % 2 = 1 and k % 9 = 0)
union all select 'unknown_origin', 0 union all select 'version_differs', (select count(*) from p where k % 14 = 0)
union all select 'finished_before_start', (select count(*) from orders where o_orderstatus in ('F', 'O') and o_orderkey % 8 = 0)
union all select 'finished_attempt_changed', (select count(*) from orders where o_orderkey % 16 = 1 and o_orderstatus = 'F')""")
def profile_integrity(spark, directory):
    """Audit rules over profile uses (orders), profiles (customers), attempts (orders) and snapshots."""
    orders, customers, k = i.table(spark, directory, "orders"), i.table(spark, directory, "customer"), F.col("o_orderkey")
    uses = orders.select(
        k.cast("string").alias("use_id"), F.when(F.col("o_custkey") % 50 == 0, -1).otherwise(F.col("o_custkey")).cast("string").alias("profile_id"),
        F.col("o_orderdate").alias("used_at"), (F.col("o_custkey") + 1).alias("user_id"),
        F.when(k % 2 == 0, F.lpad(F.when(k % 10 == 0, F.lit(10**9)).otherwise(k).cast("string"), 10, "0")).alias("source_snapshot_id"))
    c = F.col("c_custkey")
    own = customers.select(
        c.cast("string").alias("profile_id"), c.cast("string").alias("cache_key"), F.lit("1996-01-01").cast("timestamp").alias("created_at"),
        F.when((c % 2 == 0) | (c % 9 == 0), c.cast("string")).alias("attempt_id"), F.when(c % 2 == 0, "llm").otherwise("legacy_cache").alias("origin"),
        F.struct(F.col("c_name").alias("likes"), F.col("c_mktsegment").alias("dislikes")).alias("profile"))
    profiles = li.profile_versions(own, ["likes", "dislikes"]).withColumn(
        "content_version", F.when(F.col("profile_id").cast("bigint") % 14 == 0, "sha256:0").otherwise(F.col("expected_version")))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    attempts = orders.select(
        k.cast("string").alias("attempt_id"), F.when(k % 6 == 0, "other").otherwise(k.cast("string")).alias("cache_key"), status.alias("status"),
        F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.when(k % 8 == 0, F.expr("interval -1 days")).otherwise(F.expr("interval 1 days"))).alias("finished_at"))
    again = attempts.where("attempt_id % 16 = 1 and status = 'success'").withColumn("finished_at", F.col("started_at") + F.expr("interval 2 days"))
    return li.profile_integrity(uses, profiles, attempts.unionByName(again), _snapshots(spark, directory))


GENRES = ("ECONOMY", "STANDARD", "SMALL", "MEDIUM", "LARGE", "PROMO")


def _answers(spark, directory):
    c = F.col("c_custkey")
    choice = lambda n: F.element_at(F.array(*[F.lit(v) for v in ("like", "avoid", "none")]), ((c + n) % 3 + 1).cast("int"))
    answers = F.array(*[F.struct(F.lit(g).alias("name"), choice(n).alias("choice")) for n, g in enumerate(GENRES)])
    return i.table(spark, directory, "customer").select("c_custkey", s.profile_from_answers(answers, F.col("c_name"), F.col("c_mktsegment")).alias("profile"))


@query("""select c_custkey, case c_custkey % 3 when 0 then 'ECONOMY,MEDIUM' when 1 then 'SMALL,PROMO' else 'STANDARD,LARGE' end as liked,
  case c_custkey % 3 when 0 then 'STANDARD,LARGE' when 1 then 'ECONOMY,MEDIUM' else 'SMALL,PROMO' end as excluded, c_name as likes from customer""")
def profiles_from_answers(spark, directory):
    """Preference profiles from per-genre answers."""
    return _answers(spark, directory).select("c_custkey", F.array_join("profile.liked_genres", ",").alias("liked"),
                                             F.array_join("profile.excluded_genres", ",").alias("excluded"), F.col("profile.likes_summary").alias("likes"))


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'invalid_liked_titles' when c_custkey % 3 = 2 then 'unknown_liked_genres' when c_custkey % 3 = 0 then 'unknown_excluded_genres' end as error from customer""")
def profile_errors(spark, directory):
    """Profiles with blank titles or genres outside a shorter list."""
    known = [g for g in GENRES if g != "LARGE"]
    rows = _answers(spark, directory).withColumn("profile", F.when(F.col("c_custkey") % 4 == 0, F.col("profile").withField(
        "liked_titles", F.array(F.lit("x"), F.lit(" ")))).otherwise(F.col("profile")))
    return rows.select("c_custkey", s.profile_error(F.col("profile"), known).alias("error"))


# --- export and manifest -------------------------------------------------------------------------------------

@query(f"""with {i.LOG} select "offset", to_base64(encode(cast(e.user_id as varchar))) as key from log join events e on e.event_id = "offset"
where coalesce(event_ts, ingested_at) >= timestamp '2024-01-08' and coalesce(event_ts, ingested_at) < timestamp '2024-01-12' and ingested_at <= timestamp '2024-01-11 12:00:00'""")
def exported_events(spark, directory):
    """Event table filtered by event and availability time, bytes as base64."""
    rows = rc.export_rows("kafka_events", i.parsed(spark, directory), i.SOURCE, i.TOPIC, "2024-01-08", "2024-01-12", "2024-01-11 12:00:00")
    return rows.select("offset", "key")


def _counts(names):
    return " union all ".join(f"select '{n}' as \"table\", count(*) as rows from {n}" for n in names)


SAMPLE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


@query(f"select *, true as same_contents from ({_counts(SAMPLE_TABLES)}) t")
def manifest_rows(spark, directory):
    """Row counts of the manifest of all tables, and whether a stored copy in another order and partitioning has the same digest."""
    given = {n: i.table(spark, directory, n) for n in SAMPLE_TABLES}
    copies = {n: written(t.repartition(*reversed(t.columns)), "copy") for n, t in given.items()}  # as many parts as the rows take
    first, second = rc.snapshot_manifest(given), rc.snapshot_manifest(copies)
    wrong = rc.manifest_mismatches(first, second).withColumn("_wrong", F.lit(True))
    return first.join(wrong, "table", "left").select("table", "rows", F.col("_wrong").isNull().alias("same_contents"))


@query("""with t as (select sha256('{"n_name":"' || n_name || '","n_nationkey":' || cast(n_nationkey as varchar) || ',"n_regionkey":' || cast(n_regionkey as varchar) || '}') as h from nation)
select count(*) as rows, cast(sum(cast(('0x' || substr(h, 1, 15))::ubigint as hugeint)) as varchar) as digest from t""")
def nation_digest(spark, directory):
    """Order-free fingerprint of one table."""
    return rc.row_digest(i.table(spark, directory, "nation"))


@query("select unnest(['embeddings', 'lineitem']) as \"table\"")
def manifest_differences(spark, directory):
    """Tables whose contents changed, of all: one line item quantity and one component of a vector are edited."""
    before = {n: i.table(spark, directory, n) for n in SAMPLE_TABLES}
    lines = before["lineitem"].withColumn("l_quantity", F.when(F.col("l_orderkey") == 7, 0.0).otherwise(F.col("l_quantity")))
    nudged = F.transform("embedding", lambda x, n: F.when((n == 5) & (F.col("vec_id") == 3), x + F.lit(0.5).cast("float")).otherwise(x))
    vectors = before["embeddings"].withColumn("embedding", nudged)
    return rc.manifest_mismatches(rc.snapshot_manifest(before), rc.snapshot_manifest({**before, "lineitem": lines, "embeddings": vectors}))


@query(f"""with {i.LOG} select "partition", count(*) as n from log where parse_status = 'failed' group by 1""")
def failed_lines(spark, directory):
    """Failed lines per partition."""
    return i.parsed(spark, directory).where("parse_status = 'failed'").groupBy(F.col("partition").cast("bigint").alias("partition")).agg(F.count(F.lit(1)).alias("n"))


# --- text tables, prepared tables and JSON lines, written below the shared folder and read again ----------------

@query(f"""with {i.HISTORY} select user_id, movie_id, event_type, rating, epoch_us(cast("timestamp" as timestamp)) as us from history""")
def text_tables(spark, directory):
    """Watch and rating history as compressed text tables with blanks, read back typed."""
    path = fresh_path(spark, "text")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    save = lambda df, name: df.write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(f"{path}/{name}.csv.gz")
    save(i.history(spark, directory).select(*map(text, ("timestamp", "user_id", "event_type", "movie_id", "rating"))), "events")
    save(i.users(spark, directory).select(*map(text, ("user_id", "self_description_likes", "self_description_dislikes"))), "users")
    titles = i.table(spark, directory, "part").select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), *[F.lit("").alias(c) for c in ("genres", "overview", "runtime", "license_cost")])
    save(titles.select(*map(text, titles.columns)), "movies")
    events, users, movies = tables.read_course_tables(spark, path)
    typed = tables.typed_events(events).join(tables.typed_users(users).select("user_id"), "user_id", "left_semi").join(movies.select("movie_id"), "movie_id", "left_semi")
    return typed.select("user_id", "movie_id", "event_type", "rating", F.unix_micros("timestamp").alias("us"))


@query(f"with {i.PAIRS} select user_id, movie_id, watch_count, rating from pairs")
def prepared_pairs(spark, directory):
    """Interactions as the prepared table holds them."""
    path = fresh_path(spark, "prepared")
    events, users, movies = i.history(spark, directory), i.users(spark, directory), i.movies(spark, directory)
    pairs = i.pairs(spark, directory)
    tables.write_prepared(pairs, cold_start_users(users, events), events, users, movies, path)
    return spark.read.parquet(f"{path}/interactions").select("user_id", "movie_id", "watch_count", "rating")


@query("select conv_id, turn, role, text from conversations")
def json_lines(spark, directory):
    """Whole conversations through compressed JSON lines, with any text and explicit nulls."""
    path, rows = fresh_path(spark, "lines"), i.table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    tables.write_jsonl(rows, path)
    return tables.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")

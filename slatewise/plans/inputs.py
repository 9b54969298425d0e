"""Log, history, catalogue and audit tables derived from the sample tables by plain projections.

Every derived table uses all rows of its source. The SQL strings state the same derivations for the
reference answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.parse import parse_events
from slatewise.operators.interactions import interactions
from slatewise.session import written
from slatewise.sources.records import typed_fees

SOURCE, TOPIC = "sample-log", "activity"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    zoned = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoned}) if zoned else df


def line_text(events: DataFrame) -> DataFrame:
    """events with the log line they stand for under `line`, and `ts` as a timestamp."""
    text = lambda c: c.cast("string")
    k, n = F.regexp_extract("props", "[0-9]+", 0).cast("int"), F.floor("value")
    ids = F.transform(F.sequence(F.lit(0), F.when(F.col("k") % 7 == 1, 9).otherwise(19)), lambda i: text((F.col("k") + i) % 100))
    plain = F.array_join(ids, ",")
    listed = (F.when(F.col("k") % 7 == 2, F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")))
              .when(F.col("k") % 7 == 3, F.concat(F.lit("['"), F.array_join(ids, "', '"), F.lit("']"))).otherwise(plain))
    result = F.when(F.col("k") % 10 == 0, "Service unavailable, retry later").otherwise(listed)
    took = F.concat(text(F.col("n")), F.element_at(F.array(*[F.lit(u) for u in (" us", " ms", "s", "")]), (F.col("event_id") % 4 + 1).cast("int")))
    watch = F.concat(F.lit("GET /data/m/"), text(F.col("k")), F.lit("/"), text(F.col("n")), F.lit(".mpg"))
    rate = F.concat(F.lit("GET /rate/"), text(F.col("k")), F.lit("="), text(F.col("n") % 12 + 1))
    signup = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("GET /create_account?src="), text(F.col("k")), F.lit("&src=web+page&note="))).otherwise("GET /create_account")
    slate = F.concat(F.lit("recommendation request node-"), text(F.col("event_id") % 3), F.lit(":8082, status "),
                     F.when(F.col("k") % 10 == 0, "503").otherwise("200"), F.lit(", result: "), result, F.lit(", "), took)
    broken = F.element_at(F.array(
        F.concat(F.lit("GET /data/m/"), text(F.col("k")), F.lit("/x.mpg")), F.concat(F.lit("GET /rate/"), text(F.col("k")), F.lit("=1.5")),
        F.concat(F.lit("GET /rate/["), text(F.col("k")), F.lit("]=9")), F.lit("recommendation request broken"), F.lit("POST /other"),
        F.concat(F.lit("GET /data/m/"), text(F.col("k")), F.lit("/-1.mpg"))), F.col("k") % 6 + 1)
    body = (F.when(F.col("event_type") == "view", watch).when(F.col("event_type") == "purchase", rate)
            .when(F.col("event_type") == "signup", signup).when(F.col("event_type") == "click", slate).otherwise(broken))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 97 == 0, "").otherwise("Z"))
    line = F.concat_ws(",", stamp, text(F.col("user_id")), body)
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withColumns({"k": k, "n": n})
            .withColumn("line", F.when(F.col("event_id") % 103 == 0, F.lit(None)).when(F.col("event_id") % 101 == 0, "lost").otherwise(line)))


def envelopes(events: DataFrame) -> DataFrame:
    """Sample events as source records; also works on a stream of them."""
    return line_text(events).select(
        F.lit(SOURCE).alias("source_id"), F.lit(TOPIC).alias("topic"), (F.col("event_id") % 2).cast("int").alias("partition"),
        F.col("event_id").alias("offset"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.encode("line", "UTF-8").alias("value"),
        F.array(F.struct(F.lit("trace").alias("key"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value"))).alias("headers"),
        F.unix_millis("ts").alias("broker_timestamp_ms"), F.lit(0).alias("broker_timestamp_type"),
        (F.col("ts") + F.expr("interval 2 seconds")).alias("ingested_at"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, where a small file would be read by a few tasks; for work that costs much per row."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.isStreaming or df.rdd.getNumPartitions() < tasks else df


def log_lines(spark: SparkSession, directory: str) -> DataFrame:
    return envelopes(spread(table(spark, directory, "events")))


def parsed_lines(spark: SparkSession, directory: str) -> DataFrame:
    """The parsed log, computed where it is used."""
    return parse_events(log_lines(spark, directory), "value", "UTC")


def parsed(spark: SparkSession, directory: str) -> DataFrame:
    """The parsed log as an event table, for queries that read it several times."""
    return written(parsed_lines(spark, directory), "events")


# The parsed log in SQL: one row per line.
LOG = """
e as (select event_id, ts, user_id as uid, event_type as source_type, cast(regexp_extract(props, '[0-9]+') as int) as k,
             cast(floor(value) as bigint) as n from events),
b as (select *, case when event_id % 103 = 0 then 'Tombstone' when event_id % 101 = 0 then 'InvalidEnvelope' end as broken,
             case source_type when 'view' then 'watch' when 'purchase' then 'rating' when 'click' then 'recommendation'
               when 'signup' then case when event_id % 5 = 0 then null else 'account_created' end
               else case k % 6 when 0 then 'watch' when 1 then 'rating' when 2 then 'rating' when 3 then 'recommendation'
                    when 5 then 'watch' end end as kind,
             case when source_type in ('view', 'purchase') then cast(k as varchar)
               when source_type = 'error' and k % 6 = 2 then '[' || cast(k as varchar) || ']'
               when source_type = 'error' and k % 6 = 5 then cast(k as varchar) end as movie,
             case when source_type = 'purchase' and n % 12 >= 10 then 'InvalidRating'
               when source_type = 'click' and k % 7 = 2 and k % 10 <> 0 then 'InvalidRecommendationResult'
               when source_type = 'error' then case k % 6 when 0 then 'InvalidWatchEvent' when 1 then 'InvalidRatingEvent'
                 when 2 then 'InvalidMovieID' when 3 then 'InvalidRecommendationEvent' when 5 then 'InvalidWatchMinute' end
               end as body_error from e),
log as (select event_id as "offset", event_id % 2 as "partition", ts, ts + interval 2 second as ingested_at, k, n,
             case when broken is null then source_type end as source_type,
             case when broken is null then kind end as event_type, case when broken is null then movie end as movie_id,
             case when broken is null and uid > 0 then uid end as user_id,
             case when broken is null then ts end as event_ts,
             coalesce(broken, body_error, case when uid = 0 then 'InvalidUserID' end) as error_type,
             case when coalesce(broken, body_error) is not null or uid = 0 then 'failed'
               when kind is not null then 'parsed' else 'unrecognized' end as parse_status,
             case when broken is not null then null when source_type = 'view' then n
               when source_type = 'error' and k % 6 = 5 then -1 end as minute,
             case when broken is not null then null when source_type = 'purchase' then n % 12 + 1
               when source_type = 'error' and k % 6 = 2 then 9 end as rating,
             case when broken is null and source_type = 'click' then 'node-' || cast(event_id % 3 as varchar) || ':8082' end as server,
             case when broken is null and source_type = 'click' then case when k % 10 = 0 then 503 else 200 end end as status,
             case when broken is null and source_type = 'click' then case event_id % 4 when 0 then n * 0.001e0 when 1 then n * 1e0
               when 2 then n * 1000e0 end end as response_ms,
             case when broken is null and source_type = 'click' and k % 10 <> 0 and k % 7 <> 2 then case when k % 7 = 1 then 10 else 20 end end as items,
             event_id % 5 as fifth
        from b)
"""


def history(spark: SparkSession, directory: str) -> DataFrame:
    """Watch and rating history of all line items: returned ones are rated, others watched."""
    items, orders = table(spark, directory, "lineitem"), table(spark, directory, "orders")
    rows = items.join(orders.select("o_orderkey", "o_custkey"), items.l_orderkey == F.col("o_orderkey"))
    rated = F.col("l_returnflag") == "R"
    return rows.select(
        (F.col("o_custkey") + 1).alias("user_id"), F.col("l_partkey").cast("string").alias("movie_id"),
        F.when(rated, "rating").otherwise("watch").alias("event_type"),
        F.when(rated, (F.col("l_quantity") % 10 + 1).cast("int")).alias("rating"), F.col("l_shipdate").alias("timestamp"),
        "l_orderkey", "l_linenumber", "l_quantity")


SEQUENCE = ("l_orderkey", "l_linenumber", "l_quantity")

HISTORY = """
history as (select o_custkey + 1 as user_id, cast(l_partkey as varchar) as movie_id,
              case when l_returnflag = 'R' then 'rating' else 'watch' end as event_type,
              case when l_returnflag = 'R' then cast(l_quantity % 10 + 1 as int) end as rating,
              l_shipdate as "timestamp", l_orderkey, l_linenumber, l_quantity
            from lineitem join orders on l_orderkey = o_orderkey)
"""

PAIRS = HISTORY + """,
pairs as (select user_id, movie_id, count(*) filter (event_type = 'watch') as watch_count,
            arg_max(rating, ("timestamp", l_orderkey, l_linenumber, l_quantity)) filter (event_type = 'rating') as rating,
            min("timestamp") as first_timestamp, max("timestamp") as last_timestamp
          from history group by user_id, movie_id)
"""


def pairs(spark: SparkSession, directory: str) -> DataFrame:
    return interactions(history(spark, directory), SEQUENCE)


def users(spark: SparkSession, directory: str) -> DataFrame:
    """Customers, and suppliers as users who never watched anything."""
    customers = table(spark, directory, "customer").select(
        (F.col("c_custkey") + 1).alias("user_id"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("self_description_likes"),
        F.lit("").alias("self_description_dislikes"))
    suppliers = table(spark, directory, "supplier").select(
        (F.col("s_suppkey") + 1_000_001).alias("user_id"),
        F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.col("s_name")).alias("self_description_likes"),
        F.lit("").alias("self_description_dislikes"))
    return customers.unionByName(suppliers)


USERS = """
users as (select c_custkey + 1 as user_id, case when c_custkey % 3 = 0 then '' else c_mktsegment end as self_description_likes,
            '' as self_description_dislikes from customer
          union all
          select s_suppkey + 1000001, case when s_suppkey % 4 = 0 then ' ' else s_name end, '' from supplier)
"""


def movies(spark: SparkSession, directory: str) -> DataFrame:
    """All parts as movies; the overview is the document of the same number, if there is one."""
    docs = table(spark, directory, "documents").select(F.col("doc_id").alias("p_partkey"), "text")
    parts = table(spark, directory, "part").join(docs, "p_partkey", "left")
    k = F.col("p_partkey")
    fee = (F.when(k % 11 == 0, "").when(k % 17 == 0, "-1").when(k % 23 == 0, "NaN")
           .otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")))
    return parts.select(
        k.cast("string").alias("movie_id"), F.concat(F.col("p_name"), F.lit(" ("), (k % 70 + 1950).cast("string"), F.lit(")")).alias("title"),
        F.concat_ws("|", "p_type", "p_brand").alias("genres"), F.coalesce("text", F.lit("")).alias("overview"),
        F.col("p_size").cast("string").alias("runtime"), fee.alias("license_cost"))


MOVIES = """
movies as (select cast(p_partkey as varchar) as movie_id, p_name || ' (' || cast(p_partkey % 70 + 1950 as varchar) || ')' as title,
             p_type || '|' || p_brand as genres, coalesce(d.text, '') as overview, cast(p_size as varchar) as runtime,
             case when p_partkey % 11 = 0 then '' when p_partkey % 17 = 0 then '-1' when p_partkey % 23 = 0 then 'NaN'
               else cast(cast(p_retailprice as decimal(12,2)) as varchar) end as license_cost
           from part left join documents d on d.doc_id = p_partkey)
"""

FEES = MOVIES + """,
fees as (select movie_id, case when license_cost = '' then 'missing' when license_cost in ('-1', 'NaN') then 'invalid'
           else 'known' end as fee_status,
           case when license_cost not in ('', '-1', 'NaN') then cast(license_cost as decimal(38,18)) end as fee from movies)
"""


def fees(spark: SparkSession, directory: str) -> DataFrame:
    return typed_fees(movies(spark, directory))


def request_log(spark: SparkSession, directory: str) -> DataFrame:
    """API requests behind the recommendation lines: a little earlier, every 13th twice, every 17th lost."""
    clicks = line_text(spread(table(spark, directory, "events").where("event_type = 'click'")))
    ids = F.transform(F.sequence(F.lit(0), F.when(F.col("k") % 7 == 1, 9).otherwise(19)),
                      lambda i: ((F.col("k") + i) % 100).cast("string"))
    copies = F.explode(F.sequence(F.lit(1), (F.when(F.col("event_id") % 17 == 0, 0).when(F.col("event_id") % 13 == 0, 2).otherwise(1)))).alias("copy")
    kept = clicks.where("event_id % 17 <> 0").select("*", copies)
    started = F.col("ts") - F.make_dt_interval(secs=(F.col("event_id") % 7).cast("decimal(18,6)"))
    return kept.select(
        F.concat_ws("-", F.lit("req"), F.col("event_id").cast("string"), F.col("copy").cast("string")).alias("request_id"),
        F.when(F.col("user_id") > 0, F.col("user_id")).alias("user_id"), started.alias("started_at"),
        (started + F.make_dt_interval(secs=(F.col("n") / 1000).cast("decimal(18,6)"))).alias("finished_at"),
        F.when(F.col("k") % 10 == 0, 503).otherwise(200).alias("status"), F.lit(True).alias("response_complete"),
        F.transform(ids, lambda v, i: F.struct(v.alias("movie_id"), (i + 1).cast("int").alias("rank"))).alias("recommendations"),
        ids.alias("ids"), F.array_join(ids, ",").alias("response_body"),
        F.element_at(F.array(*[F.lit(m) for m in ("ease", "popularity", "llm_cold_start")]), (F.col("event_id") % 3 + 1).cast("int")).alias("serving_method"),
        F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("version"), F.col("n").cast("double").alias("latency_ms"))


REQUESTS = LOG + """,
requests as (select 'req-' || cast(event_id as varchar) || '-' || cast(c.copy as varchar) as request_id,
               case when uid > 0 then uid end as user_id, ts - to_seconds(event_id % 7) as started_at,
               ts - to_seconds(event_id % 7) + to_microseconds(n * 1000) as finished_at,
               case when k % 10 = 0 then 503 else 200 end as status, k, n, event_id,
               case when k % 7 = 1 then 10 else 20 end as items,
               case event_id % 3 when 0 then 'ease' when 1 then 'popularity' else 'llm_cold_start' end as serving_method,
               'v' || cast(event_id % 2 as varchar) as version
             from e join (values (1), (2)) c(copy) on c.copy = 1 or event_id % 13 = 0
             where source_type = 'click' and event_id % 17 <> 0)
"""

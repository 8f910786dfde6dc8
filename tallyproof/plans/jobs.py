"""Queries on stage events, verdicts, responses and proposed edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.operators import jobs as jb
from tallyproof.plans.registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("""
select job_id, run::int as run, stage, started, message, lead(started) over (partition by job_id order by run) as completed from (
  select user_id as job_id, run, any_value(event_type) as stage, min(ts) as started, arg_max(props, (ts, event_id)) as message from (
    select *, sum(new) over (partition by user_id order by ts, event_id) as run from (
      select *, (event_type is distinct from lag(event_type) over w or lag(event_id) over w is null)::int as new from events window w as (partition by user_id order by ts, event_id)))
  group by user_id, run)""")
def stage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("props").alias("message"))
    return jb.stage_history(e).withColumn("run", F.col("run").cast("int"))


@query("""select user_id as job_id, max(ts) as finished from events group by user_id
having max(ts) >= (select max(ts) from events) - interval 100 hours order by finished desc, job_id desc limit 50""")
def job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _events(spark, sf_dir).groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("finished"))
    now = jobs.agg(F.max("finished")).first()[0]
    return jb.job_retention(jobs, now, 50, 100)


@query("""select user_id as doc_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as k from events) where k <= 10""")
def topk_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), "event_id", "value")
    return jb.top_per_document(e, [F.desc("value"), "event_id"], 10)


@query("""
with v as (select md5(o_custkey::varchar) as cache_key, o_orderpriority as payload, o_orderdate + to_seconds(o_orderkey % 86400) as created_at from orders),
fresh as (select cache_key, arg_max(payload, created_at) as payload from v where created_at >= timestamp '1998-01-01' group by cache_key)
select c_custkey, payload, payload is not null as hit from customer left join fresh on md5(c_custkey::varchar) = cache_key""")
def verdict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v = o.select(F.md5(F.col("o_custkey").cast("string")).alias("cache_key"), F.col("o_orderpriority").alias("payload"), (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("created_at"))
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("cache_key"))
    return jb.verdict_lookup(asked, v, datetime.datetime(1998, 1, 8), 7).select("c_custkey", "payload", "hit")


@query("""select event_id as id, case when event_id % 11 = 0 then 'rejected' else 'ok' end as status, case when event_id % 11 <> 0 then (props ->> 'k')::bigint end as k from events""")
def response_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = F.col("props"), F.col("event_id")
    cut = F.when(i % 11 == 0, F.substring(p, 1, 4)).otherwise(p)
    slashed = F.when(i % 13 == 0, F.regexp_replace(cut, r"\}$", r', "note": "5\\%"}')).otherwise(cut)
    raw = F.when(i % 7 == 0, F.concat(F.lit("Here it is:\n```json\n"), slashed, F.lit("\n```"))).otherwise(slashed)
    x = jb.response_contract(_events(spark, sf_dir).select(i.alias("id"), raw.alias("raw")), "k bigint, note string", ["k"])
    return x.select("id", "status", F.col("parsed.k").alias("k"))


@query("""select doc_id, n::int as occurrences, n = 1 and doc_id % 3 <> 0 as accepted from (
  select doc_id, case when length(o) > 0 then (length(text) - length(replace(text, o, ''))) // length(o) else 0 end as n from (select doc_id, coalesce(text, '') as text, coalesce(string_split(text, chr(10))[1], '') as o from documents))""")
def splice_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document is to be replaced by itself with a mark, or, for a third, by a heading."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("original", F.split("text", "\n")[0])
    d = d.withColumn("suggested", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## "), F.col("original"))).otherwise(F.concat(F.col("original"), F.lit("!"))))
    return jb.splice_guard(d).select("doc_id", "occurrences", "accepted")


@query("""select user_id as doc_id, event_type as original, case when count(distinct props) = 1 then 'apply' else 'review' end as status, case when count(distinct props) = 1 then min(props) end as suggested from events group by user_id, event_type""")
def proposal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.proposal_conflicts(_events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("original"), F.col("props").alias("suggested")))

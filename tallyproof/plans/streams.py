"""Streaming queries: the tables arrive as files, all that is there is taken in, and the outcome is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.operators import consensus as con, forecast as fc, lines as ln, repair as rp
from tallyproof.plans.forecasts import _ANNUAL
from tallyproof.plans.registry import query
from tallyproof.sources.reports import reports, with_views
from tallyproof.sources.tables import read_reports, shared_folder, stored
from tallyproof.streaming import jobs as st


def _arrived(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for the files there are, written as batches; in update mode the last row of a key is the
    one of its latest batch."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/arrived_batch={batch_id}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("arrived_batch")


def _stream(df: DataFrame) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{shared_folder(df.sparkSession)}/arrivals-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("""select job_id, (run)::int as run, stage, started, message, completed from (
  select *, lead(started) over (partition by job_id order by run) as completed from (
    select user_id as job_id, run, any_value(event_type) as stage, min(ts) as started, arg_max(props, (ts, event_id)) as message from (
      select *, sum(new) over (partition by user_id order by ts, event_id) as run from (
        select *, (event_type is distinct from lag(event_type) over w or lag(event_id) over w is null)::int as new from events window w as (partition by user_id order by ts, event_id)))
    group by user_id, run)) where completed is not null""")
def stream_stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed stages, from events that arrive in one batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("props").alias("message"))
    return _arrived(st.stage_progress(_stream(e.coalesce(1)), 24 * 365), "append").filter("completed is not null").select("job_id", "run", "stage", F.col("started").cast("timestamp_ntz").alias("started"), "message", F.col("completed").cast("timestamp_ntz").alias("completed"))


@query("""select job_id, run::int as run, stage, started, message, lead(started) over (partition by job_id order by run) as completed from (
  select user_id as job_id, run, any_value(event_type) as stage, min(ts) as started, arg_max(props, (ts, event_id)) as message from (
    select *, sum(new) over (partition by user_id order by ts, event_id) as run from (
      select *, (event_type is distinct from lag(event_type) over w or lag(event_id) over w is null)::int as new from events window w as (partition by user_id order by ts, event_id)))
  group by user_id, run)""")
def stream_ordered_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, open ones included, from events in four shares by time, a seventh of them a share late, out of order within
    a share; a last event of another job closes the stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("props").alias("message"))
    first, last, n_events = e.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    share = int((last - first).total_seconds() // 4) + 1
    number = F.floor((F.unix_timestamp("ts") - int(first.timestamp())) / share) + F.when(F.col("seq") % 7 == 0, 1).otherwise(0)
    path = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    for n in range(6):
        part = e.filter(number == n).repartitionByRange(4, F.xxhash64("seq")).sortWithinPartitions(F.xxhash64("seq")) if n < 5 else spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.timestamp_seconds(F.lit(int(last.timestamp()) + 3 * share + 366 * 86_400)).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("end").alias("stage"), F.lit("").alias("message"))
        part.select(e.columns).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(path)
    buckets = max(16, n_events // 50_000)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(min(tasks, buckets))}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        done = _arrived(st.ordered_progress(stream, f"{2 * share + 1} seconds", 24 * 365, buckets), "append")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return done.filter("job_id <> -1").select("job_id", "run", "stage", F.col("started").cast("timestamp_ntz").alias("started"), "message", F.col("completed").cast("timestamp_ntz").alias("completed"))


@query("select sha256(concat('rules', chr(0), coalesce(text, ''))) as text_sha, count(*) > 0 as seen from documents group by 1")
def stream_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 60).alias("arrived_at"))
    return _arrived(st.first_arrivals(_stream(d), "rules"), "append").select("text_sha", F.lit(True).alias("seen"))


@query("select o_custkey as entity, year(o_orderdate)::int as year, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as amount_won, max(o_orderdate::date) as entry_date from orders group by 1, 2")
def stream_latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as values of their customer and year, arriving in several files."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("date").alias("entry_date"), F.col("o_orderkey").alias("line_no"), F.col("o_totalprice").alias("amount_won"))
    rows = _arrived(st.latest_values(_stream(o.repartition(4, "line_no"))), "update")
    return rows.groupBy("entity", "year").agg(F.max_by(F.struct("amount_won", "entry_date"), "_batch").alias("l")).select("entity", "year", "l.*")


@query("select date_trunc('hour', ts) as hour, event_type as kind, count(*) as n from events group by 1, 2")
def stream_hourly_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as corrections; hours still open at the end come from the last update."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    rows = _arrived(st.hourly_corrections(_stream(e), "10000 hours"), "update")
    return rows.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour"), "kind").agg(F.max_by("n", "_batch").alias("n"))


@query(with_views(_ANNUAL))
def stream_annual_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports arriving as JSON files; every batch runs the annual repair and keeps its rows once."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    reports(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text").write.json(f"{path}/in")

    def repair(batch: DataFrame) -> DataFrame:
        lines = stored(fc.parsed(ln.doc_lines(batch)))
        blocks = stored(con.blocks(lines, stored(con.block_lines(lines))))
        return rp.annual_repair(lines, blocks).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("year").cast("int").alias("year"), "label", "factor", "old_won", "new_won")

    st.repair_arrivals(read_reports(spark, f"{path}/in", "json", stream=True), repair, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch_id")

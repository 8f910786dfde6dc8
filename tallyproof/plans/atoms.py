"""Queries on fact atoms: reading, merging, coercing, flagging. Text comes from fact reports; oracles from their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.operators import atoms as at, graph as gr, lines as ln
from tallyproof.plans.registry import query
from tallyproof.sources.facts import fact_reports, with_facts
from tallyproof.sources.tables import stored


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(ln.chunk_documents(ln.doc_lines(fact_reports(spark, sf_dir))))


def atoms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(at.merge_atoms(at.mandatory_atoms(chunks_of(spark, sf_dir))))


@query(with_facts("""
select doc_id, 1 as chunk_no, 'table_row' as kind, '실적 요약' as section, '항목: 매출액 | ' || string_agg(year || '년: ' || case when err = 5 then '-' else rev || '억원' end, ' | ' order by k) as text from figures group by doc_id
union all select doc_id, 2, 'table_row', '실적 요약', '항목: 영업이익 | ' || string_agg(year || '년: ' || case when err = 5 then '-' else op || '억원' end, ' | ' order by k) from figures group by doc_id
union all select doc_id, (k + 2)::int, 'paragraph', year || '년 실적', year || '년 매출액은 ' || rev || '억원, 영업이익은 ' || op || '억원이다. ' || year || '년 영업이익률은 ' || m10 // 10 || '.' || m10 % 10 || '%이다.' || chr(10) || year || '년 환율 영향 때문에 매출액이 달라졌다.' || chr(10) || year || '년 매출액은 개선될 전망이다.' from figures"""))
def report_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select("doc_id", "chunk_no", "kind", "section", "text")


@query(with_facts("""select doc_id, chunk_no::int as chunk_no, statement, metric, value, '억원' as unit, period from atoms where chunk_no <= 2"""))
def table_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.table_atoms(chunks_of(spark, sf_dir)).select("doc_id", "chunk_no", "statement", "metric", "value", "unit", "period")


@query(with_facts("""select doc_id, chunk_no::int as chunk_no, statement, metric, value, case what when 'margin' then '%' else '억원' end as unit, period from atoms where chunk_no > 2 and value <> ''"""))
def text_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.text_atoms(chunks_of(spark, sf_dir)).select("doc_id", "chunk_no", "statement", "metric", "value", "unit", "period")


@query(with_facts("""select doc_id, chunk_no::int as chunk_no, statement, metric, period, unnest(case what when 'cause' then ['causal_driver'] else ['forecast_or_opinion', 'trend_or_comparison'] end) as unit_type from atoms where what in ('cause', 'view')"""))
def marker_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.marker_atoms(chunks_of(spark, sf_dir)).select("doc_id", "chunk_no", "statement", "metric", "period", "unit_type")


@query(with_facts("select doc_id, atom_id, chunk_no::int as chunk_no, statement, metric, value, period, unit_type from atoms"))
def merge_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms_of(spark, sf_dir).select("doc_id", "atom_id", "chunk_no", "statement", "metric", "value", "period", "unit_type")


@query(with_facts("""select c.doc_id, c.chunk_no::int as chunk_no, c.kind from (
  select distinct doc_id, unnest([1, 2]) as chunk_no, 'table_row' as kind from figures union all select doc_id, k + 2, 'paragraph' from figures) c
where c.kind = 'paragraph' or (c.doc_id, c.chunk_no) not in (select (doc_id, chunk_no) from atoms)"""))
def chunks_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    return at.chunks_pending(chunks, at.mandatory_atoms(chunks)).select("doc_id", "chunk_no", "kind")


@query(with_facts("""select f.doc_id, (count(*) + 2)::bigint as chunks, any_value(a.n)::bigint as atoms, any_value(a.n)::bigint as mandatory
from figures f join (select doc_id, count(*) as n from atoms group by doc_id) a on f.doc_id = a.doc_id group by f.doc_id"""))
def atom_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    return at.atom_counts(chunks, at.merge_atoms(at.mandatory_atoms(chunks)))


@query(with_facts("""select doc_id, atom_id as margin_id, round(v, 1) as margin, round(computed, 6) as computed from (
  select a.doc_id, a.atom_id, f.m10 / 10.0::double as v, f.op::double / f.rev * 100.0 as computed from atoms a join figures f on a.doc_id = f.doc_id and a.year = f.year where what = 'margin')
where abs(computed - v) > 0.5"""))
def margin_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = at.margin_mismatch(atoms_of(spark, sf_dir))
    return x.select("doc_id", "margin_id", F.round("margin", 1).alias("margin"), F.round("computed", 6).alias("computed"))


_CLAIMS = """
select o_custkey as doc_id, o_orderkey as ord, case o_orderkey % 3 when 0 then '매출액' when 1 then '영업이익' else '영업이익률' end as metric,
       year(o_orderdate) as y, case o_orderkey % 3 when 0 then floor(o_totalprice / 1000) + 1 when 1 then floor(o_totalprice / 10000) + 1 else 5 + o_orderkey % 10 end as n from orders"""


@query(f"""
with c as (select doc_id, ord, metric, y, n::double as amount from ({_CLAIMS})),
f as (select doc_id, arg_min(amount, ord) filter (metric = '매출액') * arg_min(amount, ord) filter (metric = '영업이익률') / 100.0 as certified from c group by doc_id),
g as (select c.doc_id, metric, y, count(*) filter (abs(amount - certified) / certified <= 0.05) as good, count(*) as n, any_value(certified) as certified
      from c join f on c.doc_id = f.doc_id group by c.doc_id, metric, y having count(*) > 1 and (max(amount) - min(amount)) / max(amount) > 0.2)
select c.doc_id, c.ord, case when g.n is null then null when settled then (case when abs(amount - certified) / certified <= 0.05 then 'certified' else 'wrong' end) else 'conflict' end as status,
       case when settled then round(certified, 6) end as certified
from c left join (select *, metric = '영업이익' and certified is not null and good > 0 and good < n as settled from g) g on c.doc_id = g.doc_id and c.metric = g.metric and c.y = g.y""")
def conflict_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stated revenues, profits and margins of their customer and year."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    said = F.concat(F.col("n").cast("bigint").cast("string"), F.when(F.col("metric") == "영업이익률", "%").otherwise("억원"))
    x = spark.sql(_CLAIMS).select("doc_id", "ord", "metric", F.concat("y", F.lit("년")).alias("period"), said.alias("value"), F.lit("").alias("statement"))
    return at.conflict_arbitration(x).select("doc_id", "ord", "status", F.round("certified", 6).alias("certified"))


@query("""
select conv_id as doc_id, turn::bigint as ord, left(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1000) as statement, case role when 'user' then 'positive' else 'unknown' end as polarity,
       case turn % 3 when 0 then 1.0 when 1 then 0.5 else 0.0 end::double as confidence, 'a' || lpad((row_number() over (partition by conv_id order by turn))::varchar, 3, '0') as atom_id
from conversations where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def coerce_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as raw atoms; ids of their own are tested apart."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    empty = {f: F.lit(None).cast("string") for f in at.LIMITS if f != "statement"}
    x = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("bigint").alias("ord"), F.lit(None).cast("string").alias("id"), F.col("text").alias("statement"), F.when(F.col("role") == "user", " Positive").otherwise(F.col("role")).alias("polarity"),
                 F.when(F.col("turn") % 3 == 0, "7").when(F.col("turn") % 3 == 1, "0.5").otherwise("high").alias("confidence")).withColumns(empty)
    return at.coerce_atoms(x).select("doc_id", "ord", "statement", "polarity", "confidence", "atom_id")


@query("""
select doc_id, 'a' || lpad((row_number() over (partition by doc_id order by ord))::varchar, greatest(3, length((row_number() over (partition by doc_id order by ord))::varchar))::int, '0') as atom_id, coalesce(nullif(said, ''), claim) as statement
from (select user_id as doc_id, event_id as ord, event_type as claim, case when event_id % 3 = 0 then props else '' end as said, event_id % 4 <> 0 as display, row_number() over (partition by user_id order by event_id) as k from events)
where k <= 80 and display and coalesce(nullif(said, ''), claim) <> ''""")
def seed_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    x = e.select(F.col("user_id").alias("doc_id"), i.alias("ord"), F.col("event_type").alias("claim"), F.when(i % 3 == 0, F.col("props")).alias("statement"), F.when(i % 4 == 0, False).when(i % 4 == 1, True).alias("display"), F.lit(None).cast("string").alias("evidence"))
    return at.seed_atoms(x).select("doc_id", "atom_id", "statement")


_MONTHS = """select o_custkey as doc_id, year(o_orderdate) * 100 + month(o_orderdate) as ym, cast(sum(floor(o_totalprice)) as bigint) as v, cast(count(*) as bigint) as n from orders group by o_custkey, year(o_orderdate) * 100 + month(o_orderdate)"""


@query(f"""select doc_id, (ym // 100)::varchar || '-' || lpad((ym % 100)::varchar, 2, '0') as period, unnest(['DRAM', 'NAND']) as metric, unnest([v::varchar, n::varchar]) as value from ({_MONTHS})""")
def literal_rows_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly figures written into a paragraph as a list of records."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    row = "concat(\"{'Date': '\", floor(ym / 100), '-', lpad(ym % 100, 2, '0'), \"', 'DRAM': \", v, ', \"NAND\": \"', n, '\"}')"
    docs = spark.sql(f"select doc_id, concat('자료 [', array_join(array_sort(collect_list(struct(ym, {row} as r))).r, ', '), '] 끝.') as text from ({_MONTHS}) group by doc_id")
    chunks = docs.select("doc_id", F.lit(1).alias("chunk_no"), F.lit("root").alias("section"), F.lit("paragraph").alias("kind"), "text")
    return at.literal_atoms(chunks).select("doc_id", "period", "metric", "value")


@query(with_facts("""
select doc_id, atom_id, place::int as place from (select *, row_number() over (partition by doc_id order by case when unit_type in ('causal_driver', 'forecast_or_opinion') then 0 else 1 end, ord) as place from atoms)"""))
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.priority_order(atoms_of(spark, sf_dir)).select("doc_id", "atom_id", "place")


_SHIPPED = """select o_custkey as doc_id, o_orderkey as n, (year(o_orderdate) + 10) * 100 + month(o_orderdate) as ym, cast(floor(o_totalprice) as bigint) as v, row_number() over (partition by o_custkey order by o_orderkey) as place from orders"""


@query(f"""select doc_id, (ym // 100)::varchar || '-' || lpad((ym % 100)::varchar, 2, '0') as period, (max(place) + 1)::int as line_no, arg_max(v, place) as dram, arg_max(v + 1, place) as nand, arg_max(n, place) as dram_kg, 7::bigint as nand_kg from ({_SHIPPED}) group by doc_id, ym""")
def embedded_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as rows of an export table below a title; a month with several orders has several rows."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    row = "concat('  ', place, ' ', floor(ym / 100), '-', lpad(ym % 100, 2, '0'), '  ', format_number(v, 0), ' ', v + 1, '\t', n, ' 7 ')"
    docs = spark.sql(f"select doc_id, concat('기간  DRAM_금액 NAND_금액\\n', array_join(array_sort(collect_list(struct(place, {row} as r))).r, '\\n')) as text from ({_SHIPPED}) group by doc_id")
    return ln.export_rows(ln.doc_lines(docs)).select("doc_id", "period", "line_no", "dram", "nand", "dram_kg", "nand_kg")

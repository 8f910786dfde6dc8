"""Queries on relation edges, context, propagation and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.operators import atoms as at, facts as fa, graph as gr
from tallyproof.plans.atoms import atoms_of, chunks_of
from tallyproof.plans.facts import _CHAIN, _chain
from tallyproof.plans.registry import query
from tallyproof.sources.facts import with_facts
from tallyproof.sources.tables import stored

_EDGES = """,
margins as (select m.*, f.err, f.m10 / 10.0 as said, f.op::double / f.rev * 100.0 as computed from atoms m join figures f on m.doc_id = f.doc_id and m.year = f.year where what = 'margin'),
firsts as (select doc_id, year, arg_min(atom_id, ord) filter (what = 'rev') as rev_id, arg_min(atom_id, ord) filter (what = 'op') as op_id, arg_min(atom_id, ord) filter (what = 'cause') as cause_id, arg_min(atom_id, ord) filter (what = 'view') as view_id from atoms group by doc_id, year),
edges as (
  select m.doc_id, m.atom_id as source, unnest([rev_id, op_id]) as target, 'derived_from' as relation, 0.95::double as confidence from margins m join firsts f on m.doc_id = f.doc_id and m.year = f.year where abs(computed - said) <= 0.15
  union all select m.doc_id, m.atom_id, a.atom_id, 'derived_from', 0.86 from margins m join atoms a on m.doc_id = a.doc_id and m.year = a.year where abs(computed - said) > 0.15 and a.what <> 'margin'
  union all select doc_id, view_id, rev_id, 'depends_on', 0.69 from firsts
  union all select doc_id, cause_id, view_id, 'supports', 0.7 from firsts
  union all select * from (select doc_id, atom_id, lag(atom_id) over (partition by doc_id, metric order by ord) as t, 'same_metric', 0.78 from atoms) where t is not null
  union all select * from (select doc_id, atom_id, lag(atom_id) over (partition by doc_id, period order by ord) as t, 'same_period', 0.74 from atoms) where t is not null)"""


def edges_of(atoms: DataFrame) -> DataFrame:
    return stored(gr.relation_edges(atoms))


@query(with_facts("select doc_id, source, target, relation, confidence from edges").replace("\nselect doc_id, source", _EDGES + "\nselect doc_id, source"))
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.relation_edges(atoms_of(spark, sf_dir))


@query(f"""with e as ({_CHAIN}), named as (
  select doc_id, source, target, relation, 0.5::double as confidence from e where relation in ('causes', 'derived_from', 'same_metric', 'same_period', 'contradicts', 'supports')
  union all select doc_id, case when t and not s then target else source end, case when t and not s then source else target end, relation, 0.5 from (select *, target % 4 = 0 as t, source % 4 = 0 as s from e where relation = 'depends_on'))
select distinct * from named""")
def directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge twice, once with an unknown relation and once to an atom that is not there; every fourth order is an
    opinion."""
    e = _chain(spark, sf_dir).withColumns({"ord": F.lit(1), "confidence": F.lit(0.5)})
    noise = e.withColumns({"ord": F.lit(2), "confidence": F.lit(3.0)})
    odd = e.withColumn("relation", F.lit("likes")).unionByName(e.withColumn("target", -F.col("target")))
    atoms = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("atom_id"), F.lit("").alias("statement"), F.when(F.col("o_orderkey") % 4 == 0, "forecast_or_opinion").alias("unit_type"))
    return gr.directed_edges(e.unionByName(noise).unionByName(odd), atoms).select("doc_id", "source", "target", "relation", "confidence")


#: A table atom quotes its row with the column names put in, which no chunk holds as such: the first longest number of the
#: row is looked for in all chunks as they stand.
@query(with_facts("""
, cells as (select doc_id, 1 as chunk_no, '매출액' as name, k, year, case when err <> 5 then rev || '억원' end as v from figures union all select doc_id, 2, '영업이익', k, year, case when err <> 5 then op || '억원' end from figures),
said as (select doc_id, chunk_no, '| ' || any_value(name) || ' | ' || string_agg(coalesce(v, '-'), ' | ' order by k) || ' |' as raw, list_filter(flatten(list([year::varchar, v] order by k)), lambda x: x is not null) as tokens from cells group by doc_id, chunk_no),
probes as (select doc_id, chunk_no as place, list_filter(tokens, lambda t: len(t) = list_max(list_transform(tokens, lambda u: len(u))))[1] as probe from said),
raws as (select doc_id, chunk_no, raw from said union all
  select doc_id, k + 2, year || '년 매출액은 ' || rev || '억원, 영업이익은 ' || op || '억원이다. ' || year || '년 영업이익률은 ' || m10 // 10 || '.' || m10 % 10 || '%이다.' || chr(10) || year || '년 환율 영향 때문에 매출액이 달라졌다.' || chr(10) || '  ' || year || '년 매출액은 개선될 전망이다.' from figures),
found as (select doc_id, place, min(chunk_no) as spot from probes join raws using (doc_id) where contains(raw, probe) group by doc_id, place)
select a.doc_id, a.atom_id, (case when a.chunk_no <= 2 then 2 when a.year % 2 = 1 then 1 else 0 end)::int as tier, (case when a.chunk_no <= 2 then spot else a.chunk_no end)::int as chunk_no
from atoms a left join found f on f.doc_id = a.doc_id and f.place = a.chunk_no""").replace(")\n\n, cells as", "),\ncells as"))
def atom_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All atoms; those of odd years have lost their chunk and point to the first one."""
    chunks = chunks_of(spark, sf_dir)
    atoms = stored(at.merge_atoms(at.mandatory_atoms(chunks)))
    lost = F.substring("statement", 1, 4).cast("int") % 2 == 1
    return gr.atom_anchor(atoms.withColumn("chunk_no", F.when(lost, 1).otherwise(F.col("chunk_no"))), chunks).select("doc_id", "atom_id", "tier", "chunk_no")


@query(f"""with e as (select * from ({_CHAIN}) where relation not in ('same_metric', 'same_period')),
n as (select doc_id, source as atom_id, target as other, source as ord from e union all select doc_id, target, source, source from e),
o as (select o_custkey as doc_id, o_orderkey as atom_id, o_orderkey // 3 as chunk_no from orders)
select o.doc_id, o.atom_id, coalesce(s.statements, '') as statements, coalesce(c.chunks, '') as chunk_nos from o
left join (select doc_id, atom_id, string_agg('atom ' || other, ',' order by ord, other) as statements from n group by doc_id, atom_id) s on o.doc_id = s.doc_id and o.atom_id = s.atom_id
left join (select doc_id, atom_id, string_agg(chunk_no::varchar, ',' order by spot, other) as chunks from (
    select n.doc_id, n.atom_id, b.chunk_no, min(n.ord) as spot, arg_min(n.other, n.ord) as other from n join o a on n.doc_id = a.doc_id and n.atom_id = a.atom_id join o b on n.doc_id = b.doc_id and n.other = b.atom_id where a.chunk_no <> b.chunk_no group by all) group by doc_id, atom_id) c
  on o.doc_id = c.doc_id and o.atom_id = c.atom_id""")
def related_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("atom_id"), F.concat(F.lit("atom "), F.col("o_orderkey")).alias("statement"), F.expr("o_orderkey div 3").alias("chunk_no"))
    x = gr.related_context(_chain(spark, sf_dir).withColumn("ord", F.col("source")), o)
    return x.select("doc_id", "atom_id", F.array_join("statements", ",").alias("statements"), F.array_join(F.col("chunk_nos").cast("array<string>"), ",").alias("chunk_nos"))


_PLACED = "select o_custkey as doc_id, o_orderkey as atom_id, o_orderkey // 2 as chunk_no from orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("atom_id"), F.expr("o_orderkey div 2").alias("chunk_no"))


@query(f"""
with recursive edges as ({_CHAIN}), steps as (select doc_id, source as a, target as b, 'downstream' as d from edges where relation not in ('same_metric', 'same_period') union all select doc_id, target, source, 'upstream' from edges where relation not in ('same_metric', 'same_period')),
reached(doc_id, seed, node, d, depth) as (
  select doc_id, atom_id, atom_id, unnest(['downstream', 'upstream']), 0 from ({_PLACED})
  union all select r.doc_id, r.seed, s.b, r.d, r.depth + 1 from reached r join steps s on r.doc_id = s.doc_id and r.node = s.a and r.d = s.d where r.depth < 2),
o as ({_PLACED})
select r.doc_id, seed, n.chunk_no, case when bool_or(d = 'upstream') and bool_or(d = 'downstream') then 'both' when bool_or(d = 'upstream') then 'upstream' else 'downstream' end as direction, string_agg(distinct node::varchar, ',' order by node::varchar) as atom_ids
from reached r join o n on r.doc_id = n.doc_id and r.node = n.atom_id join o s on r.doc_id = s.doc_id and r.seed = s.atom_id where node <> seed and n.chunk_no <> s.chunk_no group by all""".replace("group by all", "group by r.doc_id, seed, n.chunk_no"))
def affected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, o = stored(_chain(spark, sf_dir)), _orders(spark, sf_dir)
    seeds = o.select("doc_id", F.col("atom_id").alias("seed"))
    both = [fa.reachability(edges, seeds, 2, d).withColumn("direction", F.lit(d)) for d in ("downstream", "upstream")]
    return gr.affected_chunks(both[0].unionByName(both[1]), o).withColumn("atom_ids", F.array_join(F.array_sort(F.col("atom_ids").cast("array<string>")), ","))


@query(f"""
with recursive edges as ({_CHAIN}), steps as (select * from edges where relation not in ('same_metric', 'same_period')), o as (select *, chunk_no % 4 = 0 or chunk_no % 3 <> 0 as is_open from ({_PLACED})),
reached(doc_id, seed, node, depth) as (
  select doc_id, atom_id, atom_id, 0 from o
  union all select r.doc_id, r.seed, s.target, r.depth + 1 from reached r join o n on r.doc_id = n.doc_id and r.node = n.atom_id join o z on r.doc_id = z.doc_id and r.seed = z.atom_id
    join steps s on r.doc_id = s.doc_id and r.node = s.source where r.depth < 3 and (r.node = r.seed or n.chunk_no = z.chunk_no or n.is_open))
select doc_id, seed, node, min(depth)::int as depth from reached group by doc_id, seed, node""")
def pruned_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every fourth number have no verdict; of the others every third is unaffected."""
    o = _orders(spark, sf_dir)
    verdicts = o.select("doc_id", "chunk_no").distinct().filter("chunk_no % 4 <> 0").withColumn("affected", F.col("chunk_no") % 3 != 0)
    return gr.pruned_propagation(stored(_chain(spark, sf_dir)), o, verdicts, o.select("doc_id", F.col("atom_id").alias("seed")), 3)


_PACKED = """
with recursive o as (select o_custkey as doc_id, o_orderkey as ord, floor(o_totalprice)::bigint as size, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
packed(doc_id, i, ord, batch, n, used) as (
  select doc_id, i, ord, 1, 1, size from o where i = 1
  union all select o.doc_id, o.i, o.ord, case when p.n >= 4 or p.used + o.size > 500000 then p.batch + 1 else p.batch end, case when p.n >= 4 or p.used + o.size > 500000 then 1 else p.n + 1 end, case when p.n >= 4 or p.used + o.size > 500000 then o.size else p.used + o.size end
  from packed p join o on o.doc_id = p.doc_id and o.i = p.i + 1)"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.floor("o_totalprice").alias("size"))
    return gr.greedy_packing(o, ["doc_id"], ["ord"], "size", 4, 500_000).select("doc_id", "ord", "batch_no")


@query(f"{_PACKED} select doc_id, ord, batch::int as batch_no from packed")
def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


@query(f"{_PACKED}, e as ({_CHAIN}) select e.doc_id, a.batch::int as batch_no, e.source, e.target, e.relation from e join packed a on e.doc_id = a.doc_id and e.source = a.ord join packed b on e.doc_id = b.doc_id and e.target = b.ord and a.batch = b.batch")
def batch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _chain(spark, sf_dir).withColumn("ord", F.col("source"))
    return gr.batch_edges(e.unionByName(e), _packed(spark, sf_dir).withColumnRenamed("ord", "atom_id"))


@query()
def component_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates in batches of three; its walk order is tested against brute force."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("atom_id"), F.when(F.col("o_orderkey") % 5 > 0, F.expr("o_orderkey div 8")).alias("chunk_no"), F.col("o_orderkey").alias("ord"))
    e = _chain(spark, sf_dir).filter("source % 3 = 0").select("doc_id", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    return gr.component_batches(o, e, o.select("doc_id", "atom_id"), 3)

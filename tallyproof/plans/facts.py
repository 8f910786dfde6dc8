"""Queries on fact atoms and their graphs, over orders, line items and vectors read as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.operators import facts as fa, graph as gr, lines as ln
from tallyproof.plans.registry import query
from tallyproof.sources.tables import stored

#: A customer is a document, an order a chunk, a year a period; metrics take turns.
ATOMS_SQL = """
select o_custkey as doc_id, o_orderkey as ord, cast(o_orderkey as {text}) as atom_id, cast(year(o_orderdate) as {text}) as period,
       case o_orderkey % 3 when 0 then 'revenue' when 1 then 'profit' else 'margin' end as metric, o_totalprice as amount
from orders"""


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(ATOMS_SQL.format(text="string"))


def _oracle(sql: str) -> str:
    return f"with atoms as ({ATOMS_SQL.format(text='varchar')})\n{sql}"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    norm = F.nullif(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(0.0))
    unit = F.transform("embedding", lambda x: x.cast("double") / norm)
    return v.select(F.expr("vec_id div 50").alias("doc_id"), F.col("vec_id").alias("ord"), F.expr("vec_id div 5").alias("chunk_no"), F.col("label").alias("metric"), unit.alias("vec"))


@query(_oracle("""select doc_id, atom_id, amount is not null and (max(amount) over w - min(amount) over w) / greatest(max(abs(amount)) over w, 1e-9) > 0.2 as suspect
from atoms window w as (partition by doc_id, metric, period)"""))
def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.value_conflicts(_atoms(spark, sf_dir)).select("doc_id", "atom_id", "suspect")


@query(_oracle("""select doc_id, source, target, 'same_metric' as relation from
  (select doc_id, atom_id as target, lag(atom_id) over (partition by doc_id, metric order by ord) as source from atoms) where source is not null"""))
def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.chain_edges(_atoms(spark, sf_dir), "metric", "same_metric")


@query(_oracle("""select s.doc_id, s.atom_id as source, arg_min(t.atom_id, t.ord) as target from atoms s join atoms t
  on s.doc_id = t.doc_id and s.metric = 'margin' and t.metric = 'revenue' and s.period = t.period group by s.doc_id, s.atom_id"""))
def first_support_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.first_support(_atoms(spark, sf_dir), "margin", "revenue")


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts of an order: price is revenue, price times discount profit, and the discount their margin."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("amount")) for m, v in (("revenue", F.col("l_extendedprice")), ("profit", F.col("l_extendedprice") * F.col("l_discount")), ("margin", F.col("l_discount") * 100))]))
    x = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("ord"), F.lit("").alias("period"), one.alias("f")).select("doc_id", "ord", "period", "f.*")
    return x.withColumn("atom_id", F.concat("metric", F.lit("_"), F.col("ord")))


@query("""
select doc_id, margin_id, b.r as revenue_id, b.p as profit_id from (
  select m.doc_id, 'margin_' || m.ord as margin_id,
         arg_min({'r': 'revenue_' || r.ord, 'p': 'profit_' || p.ord}, {'a': abs(p.v / r.v * 100 - m.v), 'b': r.ord, 'c': p.ord}) as b
  from (select l_orderkey as doc_id, l_linenumber as ord, l_discount * 100 as v from lineitem) m
  join (select l_orderkey as doc_id, l_linenumber as ord, l_extendedprice as v from lineitem where l_extendedprice > 0) r on m.doc_id = r.doc_id
  join (select l_orderkey as doc_id, l_linenumber as ord, l_extendedprice * l_discount as v from lineitem) p on m.doc_id = p.doc_id
  where abs(p.v / r.v * 100 - m.v) <= 0.15 group by m.doc_id, m.ord)""")
def margin_verified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.margin_pairs(_margins(spark, sf_dir)).select("doc_id", "margin_id", "revenue_id", "profit_id")


_CHAIN = """
  select doc_id, source, target, ['causes', 'derived_from', 'depends_on', 'supports', 'same_metric', 'same_period', 'contradicts'][(source % 7 + 1)::int] as relation
  from (select o_custkey as doc_id, o_orderkey as source, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as target from orders) where target is not null"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    names = F.array(*map(F.lit, ("causes", "derived_from", "depends_on", "supports", "same_metric", "same_period", "contradicts")))
    target = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    x = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("source"), target.alias("target")).filter("target is not null")
    return x.withColumn("relation", F.element_at(names, (F.col("source") % 7 + 1).cast("int")))


_REACHED = f"""
with recursive edges as ({_CHAIN}), steps as (select * from edges where relation not in ('same_metric', 'same_period')),
reached(doc_id, seed, node, depth) as (
  select doc_id, source, source, 0 from edges
  union all select r.doc_id, r.seed, s.target, r.depth + 1 from reached r join steps s on r.doc_id = s.doc_id and r.node = s.source where r.depth < 3)
select doc_id, seed, node, min(depth)::int as depth from reached group by doc_id, seed, node"""


@query(_REACHED)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(_chain(spark, sf_dir))
    return fa.reachability(edges, edges.select("doc_id", F.col("source").alias("seed")), 3)


@query(_REACHED)
def reachability_every_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reachability(spark, sf_dir)


@query(f"""with e as ({_CHAIN}) select doc_id, source, target, relation, max(confidence) as confidence from (
  select doc_id, source, target, relation, 0.9::double as confidence from e
  union all select doc_id, source, target, relation, 0.7::double from e where source % 2 = 0
  union all select doc_id, target, source, 'supports', 0.7::double from e where source % 2 = 1) group by all""")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _chain(spark, sf_dir)
    back = e.filter("source % 2 = 1").select("doc_id", F.col("target").alias("source"), F.col("source").alias("target"), F.lit("supports").alias("relation"))
    again = e.filter("source % 2 = 0").unionByName(back).withColumn("confidence", F.lit(0.7))
    return fa.edge_union(e.withColumn("confidence", F.lit(0.9)), again)


#: Vectors as atoms of documents of 50, in chunks of five; their labels are metrics. Thresholds fit these vectors.
_GROUPS = """
with recursive v as (select vec_id // 50 as doc_id, vec_id as ord, vec_id // 5 as chunk_no, label::varchar as metric, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as vec from embeddings),
near as (select a.doc_id, a.ord as a, b.ord as b, a.metric = b.metric as same, abs(a.chunk_no - b.chunk_no) as gap, list_dot_product(a.vec, b.vec) as similarity from v a join v b on a.doc_id = b.doc_id and a.ord <> b.ord),
walk(doc_id, ord, rep) as (select doc_id, ord, ord from v union select w.doc_id, n.b, w.rep from walk w join near n on w.doc_id = n.doc_id and w.ord = n.a where n.same and n.similarity >= 0.4),
groups as (select doc_id, ord as member, min(rep) as rep from walk group by doc_id, ord)"""

_PAIRS = f"""{_GROUPS},
pairs as (select n.doc_id, g.rep as source, h.rep as target, max(similarity) as similarity, bool_or(gap = 0) as same_chunk, bool_or(gap = 1) as neighbour_chunk, bool_or(same) as same_metric
  from near n join groups g on n.doc_id = g.doc_id and n.a = g.member join groups h on n.doc_id = h.doc_id and n.b = h.member where g.rep < h.rep group by all),
gated as (select *, list_concat(list_filter([case when same_chunk then 'same_chunk' end, case when neighbour_chunk then 'neighbour_chunk' end], lambda x: x is not null),
  case when similarity >= 0.3 and same_metric then ['same_metric', 'embedding_gate'] when similarity >= 0.35 then ['strong_embedding_gate'] else [] end) as reasons from pairs)"""


def _groups(v: DataFrame) -> DataFrame:
    return stored(gr.near_duplicate_groups(v.withColumns({"polarity": F.lit(None).cast("string"), "signature": F.array().cast("array<string>")}), 0.4))


def _member_pairs(v: DataFrame, groups: DataFrame, least: float | None = None) -> DataFrame:
    return fa.member_pairs(v.withColumns({"period": F.lit(""), "subject": F.lit("")}), groups, least)


@query(f"{_GROUPS} select doc_id, rep, member from groups")
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(_vectors(spark, sf_dir))


#: Atoms with numbers in their statements (one of three), a polarity that may be blank, and a metric that may be (a null
#: label is a blank one). A vector that is null or zero, or has a component that is null or not finite, is similar to none:
#: a comparison with not-a-number holds in DuckDB.
_SIGNED = """
with recursive v as (select vec_id // 50 as doc_id, vec_id as ord, vec_id % 3 as sign, case vec_id % 4 when 0 then '' when 1 then 'positive' when 2 then 'negative' else 'positive' end as polarity, case when vec_id % 5 = 0 then '' else coalesce(label::varchar, '') end as metric,
  case when list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) and list_bool_or(list_transform(embedding, lambda x: x <> 0)) then list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) end as vec from embeddings),
near as (select a.doc_id, a.ord as a, b.ord as b, a.sign = b.sign and (a.metric = b.metric or a.metric = '' or b.metric = '') and (a.polarity = b.polarity or a.polarity = '' or b.polarity = '') as agree
  from v a join v b on a.doc_id = b.doc_id and a.ord <> b.ord where list_dot_product(a.vec, b.vec) >= 0.25),
walk(doc_id, ord, rep) as (select doc_id, ord, ord from v union select w.doc_id, n.b, w.rep from walk w join near n on w.doc_id = n.doc_id and w.ord = n.a where n.agree)"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("ord")
    v = _vectors(spark, sf_dir).withColumn("metric", F.when(i % 5 == 0, "").otherwise(F.col("metric").cast("string")))
    said = F.concat(F.lit("영업이익 "), i % 3, F.lit("조원"))
    polarity = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 2, " Negative").otherwise("positive")
    return v.withColumns({"polarity": polarity, "signature": gr.number_signature(F.lit(""), F.lit(""), F.lit(""), said)})


@query(f"{_SIGNED} select doc_id, ord as member, min(rep) as rep from walk group by doc_id, ord")
def signed_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups where numbers, metric and polarity keep similar atoms apart."""
    return gr.near_duplicate_groups(_signed(spark, sf_dir), 0.25)


@query(f"{_SIGNED} select doc_id, count(b)::bigint as blocked from (select distinct doc_id from v) left join (select * from near where a < b and not agree) using (doc_id) group by doc_id")
def blocked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.blocked_duplicates(_signed(spark, sf_dir), 0.25)


@query(f"{_GROUPS} select doc_id, member as source, rep as target, unnest(['supports', 'same_metric']) as relation, 0.92::double as confidence from groups where rep <> member")
def alias_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.alias_links(_groups(_vectors(spark, sf_dir)))


@query(f"{_GROUPS} select doc_id, a as source, b as target, round(similarity, 6) as similarity from near where a < b")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _member_pairs(v, v.select("doc_id", F.col("ord").alias("rep"), F.col("ord").alias("member"))).select("doc_id", "source", "target", F.round("similarity", 6).alias("similarity"))


@query(f"{_PAIRS} select doc_id, source, target, round(similarity, 6) as similarity, array_to_string(reasons, ',') as reasons from gated where len(reasons) > 0")
def pair_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    kept = fa.pair_gate(_member_pairs(v, _groups(v), 0.3), 0.3, 0.35)
    return kept.withColumns({"similarity": F.round("similarity", 6), "reasons": F.array_join("reasons", ",")})


@query(f"""{_PAIRS}, ranked as (select *, row_number() over (partition by doc_id order by similarity) - 1 as k, count(*) over (partition by doc_id) as n from gated)
select g.doc_id, g.n * (g.n - 1) // 2 as enumerated, coalesce(p.n, 0)::bigint as representatives, coalesce(kept, 0)::bigint as kept, (coalesce(p.n, 0) - coalesce(kept, 0))::bigint as pruned, g.n - g.r as deduplicated, low, p50, p90, high
from (select doc_id, count(*) as n, count(distinct rep) as r from groups group by doc_id) g left join (
  select doc_id, any_value(n) as n, count(*) filter (len(reasons) > 0) as kept, round(max(similarity) filter (k = 0), 6) as low, round(max(similarity) filter (k = least(n - 1, round_even((n - 1) * 0.5, 0))), 6) as p50,
    round(max(similarity) filter (k = least(n - 1, round_even((n - 1) * 0.9, 0))), 6) as p90, round(max(similarity), 6) as high from ranked group by doc_id) p on g.doc_id = p.doc_id""")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    groups = _groups(v)
    return fa.pair_stats(stored(_member_pairs(v, groups)), groups, 0.3, 0.35).withColumns({c: F.round(c, 6) for c in ("low", "p50", "p90", "high")})


@query(f"""with e as ({_CHAIN}) select distinct doc_id, s * 10 + i as source, t * 10 + j as target from
  (select doc_id, source as s, target as t, unnest([0, 1]) as i from e), (select unnest([0, 1]) as j) where s * 10 + i <> t * 10 + j""")
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _chain(spark, sf_dir)
    nodes = e.select("doc_id", F.col("source").alias("rep")).unionByName(e.select("doc_id", F.col("target").alias("rep"))).distinct()
    members = nodes.select("doc_id", "rep", F.explode(F.array(F.col("rep") * 10, F.col("rep") * 10 + 1)).alias("member"))
    return fa.alias_expand(e, members)


_LINES = r"""
with raw as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, n, line, regexp_replace(line, '^\s+|\s+$', '', 'g') as clean from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as n from raw)),
kinds as (select *, case when clean = '' then 'blank' when clean like '#%' or regexp_matches(clean, '^[0-9]+(\.[0-9]+)*\.') then 'heading' when clean like '|%' then 'table_row' else 'paragraph' end as kind from x),
titled as (select *, case when kind = 'heading' then regexp_replace(clean, '^[#\s]+', '') end as t1 from kinds),
sections as (select *, coalesce(last_value(case when kind = 'heading' then coalesce(nullif(trim(regexp_replace(t1, '^[0-9]+(\.[0-9]+)*\.\s*', '')), ''), t1) end ignore nulls) over (partition by doc_id order by n), 'root') as section,
  (kind is distinct from lag(kind) over (partition by doc_id order by n))::int as new from titled),
runs as (select *, sum(new) over (partition by doc_id order by n) as run from sections where true),
cells as (select *, case when kind = 'table_row' then list_transform(string_split(regexp_replace(clean, '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c)) end as c from runs where kind in ('table_row', 'paragraph')),
reals as (select *, coalesce(len(c) > 1 and len(list_filter(c, lambda v: not regexp_full_match(v, ':?-+:?'))) > 0, false) as real from cells),
heads as (select *, min(case when real then n end) over (partition by doc_id, run) as head from reals),
rows_ as (select a.doc_id, a.n, 0 as part, 'table_row' as kind, a.section, a.clean, list_filter(list_zip(b.c, a.c), lambda p: coalesce(p[1], '') <> '' and coalesce(p[2], '') <> '') as p
  from heads a join heads b on a.doc_id = b.doc_id and b.n = a.head where a.kind = 'table_row' and a.real and a.n > a.head),
tables as (select doc_id, n, part, kind, section, case when len(p) = 0 then clean else array_to_string(list_transform(p, lambda q: q[1] || ': ' || q[2]), ' | ') end as text from rows_),
paras as (select doc_id, run, n, section, clean, row_number() over (partition by doc_id, run order by n) as i, sum(length(clean) + 1) over (partition by doc_id, run) - 1 as total from runs where kind = 'paragraph'),
cut(doc_id, run, i, seg, used) as (
  select doc_id, run, 1::bigint, 0, length(clean) + 1 from paras where total > 20000 and i = 1
  union all select p.doc_id, p.run, p.i, case when c.used + length(p.clean) > 20000 then c.seg + 1 else c.seg end, case when c.used + length(p.clean) > 20000 then 0 else c.used end + length(p.clean) + 1
  from cut c join paras p on c.doc_id = p.doc_id and c.run = p.run and p.i = c.i + 1),
texts as (select p.doc_id, min(min(p.n)) over (partition by p.doc_id, p.run) as n, coalesce(c.seg, 0) as part, 'paragraph' as kind, any_value(p.section) as section, string_agg(p.clean, chr(10) order by p.n) as text
  from paras p left join cut c on p.doc_id = c.doc_id and p.run = c.run and p.i = c.i group by p.doc_id, p.run, coalesce(c.seg, 0))
select doc_id, (row_number() over (partition by doc_id order by n, part))::int as chunk_no, kind, section, md5(text) as digest from (select * from tables union all select * from texts)""".replace("with raw", "with recursive raw")


@query(_LINES)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their headings, table rows and blank lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ln.chunk_documents(ln.doc_lines(docs)).select("doc_id", "chunk_no", "kind", "section", F.md5("text").alias("digest"))


@query(_LINES)
def chunk_every_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(spark, sf_dir)

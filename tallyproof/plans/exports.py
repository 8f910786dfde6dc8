"""Queries on export units: statements rendered from the order figures, one of nine wordings each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.operators import exports as ex
from tallyproof.plans.registry import query
from tallyproof.plans.reviews import _tenths
from tallyproof.sources.reports import views, with_views
from tallyproof.sources.tables import stored

#: A raw value of each metric in thousand dollars, what is displayed of it, and the wording.
_VALUES = """select doc_id, year, (doc_id + year) % 9 as c, dram, nand, cast(floor((dram + 5000) / 10000) as bigint) as d, cast(floor((nand + 5000) / 10000) as bigint) as dn, doc_id % 90 + 1 as x, doc_id % 900 + 1 as k, year % 10 as t from (
  select doc_id, year, 1000000 + (doc_id * 7919 + year * 131) % 90000000 as dram, 1000000 + (doc_id * 104729 + year * 17) % 90000000 as nand from book)"""


def _statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statements and the chunks that hold the year's export table."""
    views(spark, sf_dir)
    v = spark.sql(_VALUES)
    said = F.expr("""case c
        when 0 then concat(year, '-03 DRAM 수출금액은 ', d, '만 달러(', format_number(dram, 0), ' 천달러)로 늘었다.')
        when 1 then concat('DRAM ', dram, ', NAND ', nand, ' 천달러이며 각각 ', d, '만 천달러와 ', dn, '만 천달러다.')
        when 2 then concat(year, '-02 이후 ', year, '-03 NAND 수출금액은 ', x, '억 천달러였다.')
        when 3 then concat('DRAM 수출은 약 ', d, '만 천달러였다.')
        when 4 then concat('DRAM 수출(', d div 2 + 1, '~', d, '만 천달러)은 늘었다.')
        when 5 then concat('수출금액 천달러 기준 합계는 ', k, '.', t, '억 달러다.')
        when 6 then concat('DRAM 중량은 ', d, '만kg이고 천달러 기준이 아니다.')
        when 7 then concat(year, '-03 NAND ', x, '억 천달러, 그리고 2099-01 DRAM ', d, '억 천달러.')
        else concat('NAND 수출금액 ', x, '억 천달러(', year, '-03)') end""")
    s = v.select("doc_id", F.col("year").alias("atom_id"), F.col("year").alias("chunk_no"), said.alias("statement"), F.lit(None).cast("string").alias("source_quote"), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("인용: "), said)).alias("target_text"))
    table = F.expr("concat('기간  DRAM_금액 NAND_금액\n  1 ', year, '-02 ', format_number(nand, 0), ' ', format_number(dram, 0), ' 10 20\n  2 ', year, '-03 ', format_number(dram, 0), ' ', format_number(nand, 0), ' 10 20\n단위: 천달러')")
    return s, v.select("doc_id", F.col("year").alias("chunk_no"), table.alias("raw_text"))


def _usd(v: str, inside: str = "false") -> str:
    tenths = f"round({_tenths(f'(({v}) / 100000.0::double)')} * 10)::bigint"
    short = f"format('{{:,}}', ({tenths}) // 10) || case when ({tenths}) % 10 > 0 then '.' || ({tenths}) % 10 else '' end"
    raw = f"format('{{:,}}', ({v})::bigint) || '천달러'"
    return f"('약 ' || {short} || case when {inside} then '억 달러, 원자료 ' || {raw} else '억 달러(원자료 ' || {raw} || ')' end)"


@query(with_views(f"""
select doc_id, year as atom_id, case when c <> 7 then s end as corrected_statement, case when c <> 7 then case when doc_id % 2 = 1 then '인용: ' else '' end || s end as suggested_quote,
       [ 'unit', 'text,text', 'table', 'display', 'range,display', 'summary', '', 'table', 'table'][(c + 1)::int] as sources, case when c = 7 then 'unresolved' else 'corrected' end as status
from (select *, case c
    when 0 then year || '-03 DRAM 수출금액은 ' || {_usd('dram')} || '로 늘었다.'
    when 1 then 'DRAM ' || dram || ', NAND ' || nand || ' 천달러이며 각각 ' || {_usd('a')} || '와 ' || {_usd('b')} || '다.'
    when 2 then year || '-02 이후 ' || year || '-03 NAND 수출금액은 ' || {_usd('nand')} || '였다.'
    when 3 then 'DRAM 수출은 ' || {_usd('d * 10000')} || '였다.'
    when 4 then 'DRAM 수출(' || {_usd('(d // 2 + 1) * 10000', 'true')} || '~' || {_usd('d * 10000', 'true')} || ')은 늘었다.'
    when 5 then '수출금액 천달러 기준 합계는 ' || {_usd('k * 1000000 + t * 100000')} || '다.'
    when 8 then 'NAND 수출금액 ' || {_usd('nand')} || '(' || year || '-03)' end as s
  from (select *, case when swapped then nand else dram end as a, case when swapped then dram else nand end as b
        from (select *, abs(nand / 10000.0 - d) < abs(dram / 10000.0 - d) as swapped from ({_VALUES}))) where c <> 6)"""))
def export_unit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of a value, nearest periods in both directions, weights left alone, units that stay in doubt."""
    statements, chunks = _statements(spark, sf_dir)
    x = ex.export_unit_resolution(stored(statements), stored(chunks))
    return x.select("doc_id", "atom_id", "corrected_statement", "suggested_quote", F.array_join("sources", ",").alias("sources"), "status")

"""Fact reports rendered from the order tables: a table of figures and a section of sentences for each year.

The figures behind a year: revenue and profit in hundred millions of won and the margin in tenths of a percent. ``err`` 5
leaves the year's cells empty, 7 states a margin five points too high.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyproof.sources.reports import BOOK_SQL, views

#: One row for each document and year, with its place among the document's years.
FIGURES_SQL = """
select doc_id, year, err, k, rev, op, m10 + case when err = 7 then 50 else 0 end as m10, m10 as true_m10
from (select *, cast(floor(op * 1000.0 / rev) as bigint) as m10
      from (select doc_id, year, err, row_number() over (partition by doc_id order by year) as k,
                   cast(floor(annual / 100000000.0) as bigint) + 40 as rev, cast(floor(h1 / 100000000.0) as bigint) + 1 as op from book) a) b"""


def fact_views(spark: SparkSession, sf_dir: str) -> None:
    """Register book and figures beside the report views."""
    views(spark, sf_dir)
    spark.sql(FIGURES_SQL).createOrReplaceTempView("figures")


def fact_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    fact_views(spark, sf_dir)
    return spark.sql("""
        select doc_id, concat('# 실적 요약\n\n| 항목 | ', array_join(transform(y, x -> concat(x.year, '년')), ' | '), ' |\n|---|', repeat('---|', size(y)), '\n',
            '| 매출액 | ', array_join(transform(y, x -> if(x.err = 5, '-', concat(x.rev, '억원'))), ' | '), ' |\n',
            '| 영업이익 | ', array_join(transform(y, x -> if(x.err = 5, '-', concat(x.op, '억원'))), ' | '), ' |\n',
            array_join(transform(y, x -> concat('\n', x.k, '. ', x.year, '년 실적\n', x.year, '년 매출액은 ', x.rev, '억원, 영업이익은 ', x.op, '억원이다. ',
                x.year, '년 영업이익률은 ', cast(floor(x.m10 / 10) as bigint), '.', x.m10 % 10, '%이다.\n', x.year, '년 환율 영향 때문에 매출액이 달라졌다.\n  ', x.year, '년 매출액은 개선될 전망이다.\n')), '')) as text
        from (select doc_id, array_sort(collect_list(struct(k, year, err, rev, op, m10))) as y from figures group by doc_id)""")


_RAW_ATOMS = """
select doc_id, 1 as chunk_no, k as spot, year, 'rev' as what, rev::varchar || '억원' as value from figures where err <> 5
union all select doc_id, 2, k, year, 'op', op::varchar || '억원' from figures where err <> 5
union all select doc_id, k + 2, 2, year, 'rev', rev::varchar || '억원' from figures
union all select doc_id, k + 2, 1, year, 'op', op::varchar || '억원' from figures
union all select doc_id, k + 2, 3, year, 'margin', (m10 // 10)::varchar || '.' || (m10 % 10)::varchar || '%' from figures
union all select doc_id, k + 2, 4, year, 'cause', '' from figures
union all select doc_id, k + 2, 5, year, 'view', '' from figures"""

#: The merged atoms of the fact reports, in DuckDB.
ATOMS_SQL = f"""
select doc_id, ord, 'a' || lpad(ord::varchar, greatest(3, length(ord::varchar))::int, '0') as atom_id, chunk_no, year, what, value,
  case what when 'rev' then '매출액' when 'op' then '영업이익' when 'margin' then '영업이익률' else '매출액' end as metric, year::varchar || '년' as period,
  case what when 'cause' then 'causal_driver' when 'view' then 'forecast_or_opinion' else 'metric_value' end as unit_type,
  case what when 'rev' then year || '년 매출액은 ' || value || '이다.' when 'op' then year || '년 영업이익은 ' || value || '이다.' when 'margin' then year || '년 영업이익률은 ' || value || '이다.'
    when 'cause' then year || '년 환율 영향 때문에 매출액이 달라졌다.' else year || '년 매출액은 개선될 전망이다.' end as statement
from (select *, row_number() over (partition by doc_id order by chunk_no, spot) as ord from ({_RAW_ATOMS}))"""


def with_facts(sql: str) -> str:
    """A DuckDB query over book, figures and atoms."""
    return f"with recursive book as ({BOOK_SQL}), figures as ({FIGURES_SQL}), atoms as ({ATOMS_SQL})\n{sql}"

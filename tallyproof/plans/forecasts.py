"""Queries on consensus series, forecasts and their repair."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyproof.operators import consensus as con, forecast as fc, lines as ln, repair as rp, review as rv, runs
from tallyproof.plans.registry import query
from tallyproof.sources.reports import case_reports, reports, titled_cases, undated_reports, with_views
from tallyproof.sources.sinks import publish, published
from tallyproof.sources.tables import job_tables, shared_folder, stored

#: Where a section stands in its report: 18 lines and a blank one, one more with scenarios.
_PLACE = """(select doc_id, year, err, 1 + (row_number() over (partition by doc_id order by year) - 1) * (case when doc_id % 2 = 1 then 19 else 20 end) as h,
  row_number() over (partition by doc_id order by year) as block_no from book)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports' lines with what patterns find in them, written once; all operators of a run read them."""
    return stored(fc.parsed(ln.doc_lines(reports(spark, sf_dir))))


def _inside(lines: DataFrame) -> DataFrame:
    return stored(con.block_lines(lines))


def _blocks(lines: DataFrame) -> DataFrame:
    """The consensus blocks of the lines: small, read by every repair."""
    return stored(con.blocks(lines, _inside(lines)))


def _whole(c: str = "year") -> Column:
    return F.col(c).cast("int").alias(c)


def _nine(c: str) -> Column:
    return F.round(c, 9).alias(c)


@query("select doc_id, n::int as line_no, l[n] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as n from (select doc_id, string_split(text, chr(10)) as l from documents))")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.doc_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "line_no", "line")


@query("select doc_id, md5(text) as digest from documents")
def reassemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ln.doc_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ln.reassemble(lines).select("doc_id", F.md5("text").alias("digest"))


@query("""select doc_id, case when trim(text) = '' then 'blank_text' when doc_id % 5 = 0 then 'bad_consensus' else 'valid' end as status
from (select doc_id, case when doc_id % 7 = 0 then '  ' else text end as text from documents)""")
def intake_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 5 == 0, 0.0).when(F.col("doc_id") % 5 == 1, None).otherwise(F.col("n_chars").cast("double")).alias("consensus_won")
    )
    return ln.intake(docs).select("doc_id", "status")


@query(with_views(f"""select doc_id, block_no::int as block_no, h::int as heading_line, (h + case when doc_id % 2 = 1 then 12 else 10 end)::int as stop_line, year::int as next_year from {_PLACE}"""))
def consensus_block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.block_bounds(_lines(spark, sf_dir)).select("doc_id", _whole("block_no"), "heading_line", "stop_line", _whole("next_year"))


@query(with_views("select doc_id, year::int as year, make_date(year::int, m::int, 28) as entry_date, amount_won::double as amount_won from consensus"))
def consensus_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    inside = _inside(lines)
    years = con.block_years(lines, inside).select("doc_id", "block_no", "forecast_year")
    return con.entries(lines, inside).filter("not mismatch").join(years, ["doc_id", "block_no"]).select("doc_id", F.col("forecast_year").cast("int").alias("year"), "entry_date", "amount_won")


#: Every third document states both won and hundred millions; in every seventh year of an odd document a revenue column
#: stands before the profit.
@query(with_views("""select doc_id, year::int as year, (case when doc_id % 3 <> 0 and doc_id % 2 = 1 and year % 7 = 0 then 2 else 1 end)::int as value_column, '원' as unit, (case when doc_id % 3 = 0 then 1 else 0 end)::int as n_checks from book"""))
def table_value_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ln.doc_lines(reports(spark, sf_dir))
    section = F.last(F.nullif(F.regexp_extract("line", "^## (20[0-9]{2})", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no"))
    moved = (F.col("doc_id") % 3 != 0) & (F.col("doc_id") % 2 == 1) & (section.cast("int") % 7 == 0)
    line = F.when(moved & F.col("line").startswith("| 날짜 |"), F.lit("| 날짜 | 매출 (원) | 영업이익 (원) |")).when(moved & F.col("line").rlike(r"^\| [0-9]{4}-"), F.regexp_replace("line", r"^(\| [0-9-]+ \|)", "$1 5 |")).otherwise(F.col("line"))
    lines = stored(fc.parsed(raw.withColumn("_line", line).drop("line").withColumnRenamed("_line", "line")))
    inside = _inside(lines)
    years = con.block_years(lines, inside).select("doc_id", "block_no", "forecast_year")
    x = inside.filter("_is_header").drop("forecast_year").join(years, ["doc_id", "block_no"])
    return x.select("doc_id", F.col("forecast_year").cast("int").alias("year"), F.col("table.i").alias("value_column"), F.col("table.unit").alias("unit"), F.coalesce(F.size("table.others"), F.lit(0)).alias("n_checks"))


@query(with_views("""select doc_id, year::int as year, (count(*) filter (m % 2 = 0 and doc_id % 3 = 0))::bigint as n_rejected, (count(*) filter (not (m % 2 = 0 and doc_id % 3 = 0)))::bigint as n_kept from consensus group by doc_id, year"""))
def unit_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other row's second column is damaged first; it must be rejected."""
    damaged = F.when(F.col("line").rlike("^\\| [0-9]{4}-0[246]-28 \\| [0-9]+ \\| "), F.regexp_replace("line", "\\| ([0-9.]+) \\|$", "| 1$1 |")).otherwise(F.col("line"))
    lines = stored(fc.parsed(ln.doc_lines(reports(spark, sf_dir)).withColumn("line", damaged)))
    inside = _inside(lines)
    years = con.block_years(lines, inside).select("doc_id", "block_no", "forecast_year")
    x = con.entries(lines, inside).join(years, ["doc_id", "block_no"]).groupBy("doc_id", F.col("forecast_year").cast("int").alias("year"))
    return x.agg(F.count_if("mismatch").alias("n_rejected"), F.count_if(~F.col("mismatch")).alias("n_kept"))


#: By (document + year) modulo 5: the heading's year; none in the heading but one tied to the consensus below; two such years
#: (a conflict); the profit column's; none but the next forecast's.
@query(with_views("""select doc_id, block_no::int as block_no, (case when c = 2 then null else year end)::int as year, case c when 0 then 'heading' when 1 then 'section_text' when 2 then 'section_text' when 3 then case when doc_id % 3 = 0 then 'next_forecast' else 'value_column' end else 'next_forecast' end as year_source, c = 2 as year_conflict
from (select *, (doc_id + year) % 5 as c, row_number() over (partition by doc_id order by year) as block_no from book)"""))
def block_year_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ln.doc_lines(reports(spark, sf_dir))
    section = F.last(F.nullif(F.regexp_extract("line", "^## (20[0-9]{2})", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no"))
    x = raw.withColumn("_y", section).withColumn("_c", (F.col("doc_id") + F.col("_y").cast("int")) % 5)
    head, column = F.col("line").startswith("## "), F.col("line").startswith("| 날짜 |")
    told = F.concat("_y", F.lit("년 영업이익 컨센서스"))
    line = (
        F.when(head & (F.col("_c") > 0), F.regexp_replace("line", "20[0-9]{2}년 ", ""))
        .when(column & (F.col("_c") == 1), F.concat(told, F.lit("\n"), "line"))
        .when(column & (F.col("_c") == 2), F.concat(told, F.lit("\n2099년 영업이익 컨센서스\n"), "line"))
        .when(column & (F.col("_c") == 3), F.replace("line", F.lit("영업이익 (원)"), F.concat("_y", F.lit("E 영업이익 (원)"))))
        .otherwise(F.col("line"))
    )
    lines = stored(fc.parsed(ln.doc_lines(ln.reassemble(x.select("doc_id", "line_no", line.alias("line"), "eol")))))
    return con.block_years(lines, _inside(lines)).select("doc_id", _whole("block_no"), F.col("forecast_year").cast("int").alias("year"), "year_source", "year_conflict")


_UNDATED = "(select *, 10 * (row_number() over (partition by doc_id order by year) - 1) as above from written)"


@query(with_views(f"select doc_id, year::int as year, (above + 2)::int as line_no, make_date(year::int, 1, 1) as entry_date, annual::double as amount_won, 'prose_consensus' as source from {_UNDATED}"))
def undated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consensus without dates counts for its heading's year."""
    lines = stored(fc.parsed(ln.doc_lines(undated_reports(spark, sf_dir))))
    return con.entries(lines, _inside(lines)).select("doc_id", F.year("entry_date").alias("year"), "line_no", "entry_date", "amount_won", "source")


@query(with_views(f"select doc_id, year::int as year, (above + 6)::int as line_no from {_UNDATED}"))
def concrete_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that a more concrete one follows are left out."""
    return fc.headers(fc.parsed(ln.doc_lines(undated_reports(spark, sf_dir)))).select("doc_id", _whole(), "line_no")


@query(with_views("select doc_id, arg_max(amount_won, year * 10 + m)::double as amount_won, max(make_date(year::int, m::int, 28)) as entry_date from consensus group by doc_id"))
def latest_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.latest_consensus(_blocks(_lines(spark, sf_dir)))


@query(with_views("""select t.doc_id, t.year::int as year, case when b.year is not null then b.annual::double end as consensus_won
from (select doc_id, year from book union all select doc_id, year + 1 from book) t left join book b on t.doc_id = b.doc_id and t.year = b.year and b.year <= t.upto""".replace("select doc_id, year from book union all select doc_id, year + 1 from book", "select doc_id, year, year as upto from book union all select doc_id, year + 1, year from book")))
def consensus_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each forecast header's own year, and the year after it, which no block up to there names."""
    lines = _lines(spark, sf_dir)
    heads = fc.headers(lines).select("doc_id", "line_no", "year")
    later = heads.withColumn("year", (F.col("year").cast("int") + 1).cast("string"))
    return con.consensus_asof(heads.unionByName(later), _blocks(lines)).select("doc_id", _whole(), "consensus_won")


@query(with_views("""select doc_id, year::int as year, case when doc_id % 3 = 0 then doc_id * 1e9 else annual end::double as consensus_won, doc_id % 3 = 0 as from_request from book"""))
def consensus_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third report's request gives its own value, which holds before all tiers."""
    lines = _lines(spark, sf_dir)
    given = lines.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 1e9).alias("consensus_won"))
    x = con.consensus_asof(fc.headers(lines).select("doc_id", "line_no", "year"), _blocks(lines), given)
    return x.select("doc_id", _whole(), "consensus_won", F.col("consensus_line").isNull().alias("from_request"))


@query(with_views("""select doc_id, year::int as year, p as period, (case p when '상반기' then h1_written when '하반기' then h2_written else annual_written end)::double as won
from written, (select unnest(['상반기', '하반기', '연간']) as p) where doc_id % 2 = 1"""))
def forecast_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return fc.value_lines(lines, "half").unionByName(fc.value_lines(lines, "annual")).select("doc_id", _whole(), "period", "won")


@query(with_views("select doc_id, year::int as year, up_written::double as up, mid_written::double as mid, down_written::double as down from written where doc_id % 2 = 0"))
def scenario_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.scenario_blocks(_lines(spark, sf_dir)).select("doc_id", _whole(), *[F.col(f"{n}.won").alias(n) for n in rp.NAMES])


@query(with_views("""select doc_id, year::int as year, f as factor, case when f is not null then 0.0::double end as residual, r as ratio
from (select doc_id, year, case when err in (0, 1, 2, 3, 4, 5) then power(10, [1, 2, 3, 1, 2, 3][(err + 1)::int])::double end as r,
  case err when 0 then 0.1 when 1 then 0.01 when 2 then 0.001 when 3 then 10.0 when 4 then 100.0 when 5 then 1000.0 end::double as f from written where doc_id % 2 = 1)"""))
def scale_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    cells = rp.annual_cells(lines, _blocks(lines))
    return rp.scale_decisions(cells).select("doc_id", _whole(), "factor", F.round("residual", 9).alias("residual"), F.round("ratio", 6).alias("ratio"))


_ANNUAL = """
select doc_id, year::int as year, label, factor, old_won, old_won * factor as new_won from (
  select doc_id, year, case err when 0 then 0.1 when 1 then 0.01 when 2 then 0.001 when 3 then 10.0 when 4 then 100.0 when 5 then 1000.0 end::double as factor,
         label, (case label when '연간' then annual_written when '상반기' then h1_written else h2_written end)::double as old_won
  from written, (select unnest(['연간', '상반기', '하반기']) as label)
  where doc_id % 2 = 1 and err <= 5 and (label = '연간' or abs(annual_written - h1_written - h2_written) / greatest(1, abs(annual_written), abs(h1_written + h2_written)) <= 0.05))"""


@query(with_views(_ANNUAL))
def annual_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return rp.annual_repair(lines, _blocks(lines)).select("doc_id", _whole(), "label", "factor", "old_won", "new_won")


@query(with_views("select doc_id, year::int as year, case err when 7 then 'ratio' else 'sign' end as reason_code from written where doc_id % 2 = 1 and err in (7, 8)"))
def annual_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return rp.annual_reviews(lines, _blocks(lines)).select("doc_id", _whole(), "reason_code")


@query(with_views("""select doc_id, year::int as year, h1_written::double as h1_won, h2_written::double as h2_won, annual_written::double as annual_won,
  abs(annual_written - h1_written - h2_written) / greatest(1, abs(annual_written), abs(h1_written + h2_written)) <= 0.05 as is_sum
from written where doc_id % 2 = 1"""))
def companion_half_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    annual = rp.annual_cells(lines, _blocks(lines))
    found = rp.companions(lines, annual).select("doc_id", "year", F.lit(True).alias("is_sum"))
    halves = fc.identity_cells(lines).select("doc_id", "year", F.col("h1").alias("h1_won"), F.col("h2").alias("h2_won"), F.col("annual").alias("annual_won"))
    return halves.join(found, ["doc_id", "year"], "left").select("doc_id", _whole(), "h1_won", "h2_won", "annual_won", F.coalesce("is_sum", F.lit(False)).alias("is_sum"))


_SCENARIO = """
select doc_id, year::int as year, label, factor, old_won, old_won * factor as new_won from (
  select doc_id, year, label, case err when 0 then 0.1 when 1 then 0.01 when 2 then 0.001 when 6 then 0.1 end::double as factor,
         (case label when '상방' then up_written when '중간' then mid_written else down_written end)::double as old_won
  from written, (select unnest(['상방', '중간', '하방']) as label) where doc_id % 2 = 0 and (err <= 2 or (err = 6 and label = '상방')))"""


@query(with_views(_SCENARIO))
def scenario_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return rp.scenario_repair(lines, _blocks(lines)).select("doc_id", _whole(), "label", "factor", "old_won", "new_won")


@query(with_views("""select doc_id, year::int as year, h1_written::double as h1, h2_written::double as h2, annual_written::double as annual, round(r, 9) as residual, r <= 0.02 as identity_ok
from (select *, abs(h1_written::double + h2_written::double - annual_written::double) / greatest(abs(annual_written::double), abs(h1_written::double + h2_written::double), 1.0) as r from written where doc_id % 2 = 1)"""))
def half_year_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.identity_cells(_lines(spark, sf_dir)).select("doc_id", _whole(), "h1", "h2", "annual", _nine("residual"), "identity_ok")


def _changes(lines: DataFrame) -> DataFrame:
    blocks = _blocks(lines)
    return stored(rp.annual_repair(lines, blocks).unionByName(rp.scenario_repair(lines, blocks)))


#: After the repair halves and years agree where both were scaled, or where only the year was wrong; err 0 scales halves
#: and year alike. A document is locked if all its repaired odd-numbered years add up; others have no halves to compare.
_GUARD = """select doc_id, year, case when doc_id % 2 = 0 then null else abs(a - h1 - h2) / greatest(abs(a), abs(h1 + h2), 1.0) end as r from (
  select doc_id, year, annual::double as a, h1_written::double * case when comp and err <= 5 then f else 1.0 end as h1, h2_written::double * case when comp and err <= 5 then f else 1.0 end as h2
  from (select *, abs(annual_written - h1_written - h2_written) / greatest(1, abs(annual_written), abs(h1_written + h2_written)) <= 0.05 as comp,
          case err when 0 then 0.1 when 1 then 0.01 when 2 then 0.001 when 3 then 10.0 when 4 then 100.0 when 5 then 1000.0 else 1.0 end::double as f from written)
  where (doc_id % 2 = 1 and err <= 5) or (doc_id % 2 = 0 and err in (0, 1, 2, 6)))"""


@query(with_views(f"select doc_id, coalesce(bool_and(r <= 0.02), true) as locked, not coalesce(bool_and(r <= 0.02), true) as manual_review from ({_GUARD}) group by doc_id"))
def arithmetic_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    changes = _changes(lines)
    return rp.arithmetic_guard(stored(fc.parsed(rp.apply_changes(lines, changes))), changes).select("doc_id", "locked", "manual_review")


#: The conclusion below each repaired section repeats its value; only half-year lines lie between it and the header.
_RESTATED = f"""
select b.doc_id, b.year, (h + case when b.doc_id % 2 = 1 then 14 else 15 end)::int as line_no, c.old_won, c.new_won
from {_PLACE} b join (select * from ({_ANNUAL}) where label = '연간' union all select * from ({_SCENARIO}) where label = '중간') c on b.doc_id = c.doc_id and b.year = c.year"""


def _restated(lines: DataFrame, changes: DataFrame) -> DataFrame:
    return rp.restatement_repair(ln.line_context(rp.apply_changes(lines, changes)), rv.scale_mappings(changes))


@query(with_views(f"select doc_id, line_no, old_won, new_won, 1::bigint as replacements, '결론: ' || year || '년 영업이익은 ' || new_won::decimal(38, 0)::varchar || '원 수준이다.' as new_line from ({_RESTATED})"))
def restatement_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return _restated(lines, _changes(lines)).select("doc_id", "line_no", "old_won", "new_won", "replacements", "new_line")


@query(with_views(f"select doc_id, line_no, old_won, new_won, year::int as year from ({_RESTATED})"))
def restatement_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    changes = _changes(lines)
    maps = rv.scale_mappings(changes)
    found = rp.restatement_matches(ln.line_context(rp.apply_changes(lines, changes)), maps)
    return found.join(maps.select("doc_id", "mapping_no", "year"), ["doc_id", "mapping_no"]).select("doc_id", "line_no", "old_won", "new_won", _whole())


_EVERY_CHANGE = f"select * from ({_ANNUAL}) union all select * from ({_SCENARIO})"
_NUMBERED = f"""select *, row_number() over (partition by doc_id order by year, case label when '상반기' then 1 when '하반기' then 2 when '연간' then 3 when '상방' then 1 when '중간' then 2 else 3 end) as mapping_no from ({_EVERY_CHANGE}) where old_won <> 0"""


@query(with_views(f"select doc_id, mapping_no::int as mapping_no, year, label, old_won, new_won from ({_NUMBERED})"))
def scale_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.scale_mappings(_changes(_lines(spark, sf_dir))).select("doc_id", "mapping_no", _whole(), "label", "old_won", "new_won")


@query(with_views(f"""select doc_id, mapping_no::int as mapping_no, case when hit and pins <= 2 then 'y' || year end as atom_id, case when not hit then 'none' when pins <= 2 then 'pinned' else 'cap' end as status
from (select *, label in ('연간', '중간') as hit, sum((label in ('연간', '중간'))::int) over (partition by doc_id order by mapping_no) as pins from ({_NUMBERED}))"""))
def pin_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conclusions as atoms; at most two of a document are pinned."""
    lines = _lines(spark, sf_dir)
    maps = stored(rv.scale_mappings(_changes(lines)))
    said = lines.filter("line like '결론:%'").select("doc_id", F.concat(F.lit("y"), F.regexp_extract("line", "(20[0-9]{2})", 1)).alias("atom_id"), F.col("line").alias("statement"), F.col("line").alias("source_quote"), F.lit("영업이익").alias("metric"), F.lit("").alias("value"), F.lit("").alias("period"))
    return rv.pin_assignment(maps, rv.pin_candidates(maps, said), 2)


_LINE_OF = """case label when '연간' then '- ' || year || '년 영업이익 전망: ' when '상반기' then '- ' || year || '년 상반기 전망: ' when '하반기' then '- ' || year || '년 하반기 전망: ' else '- ' || label || ': ' end"""


@query(with_views(f"""
select doc_id, 'scale' as kind, old_won, new_won, {_LINE_OF} || new_won::decimal(38, 0)::varchar || '원' as new_line from ({_EVERY_CHANGE})
union all select doc_id, 'restatement', old_won, new_won, '결론: ' || year || '년 영업이익은 ' || new_won::decimal(38, 0)::varchar || '원 수준이다.' from ({_RESTATED})"""))
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changed lines, values and their restatements alike, as they stand in the corrected report."""
    lines = _lines(spark, sf_dir)
    changes = _changes(lines)
    return rp.applied_changes(changes, _restated(lines, changes)).drop("line_no")


#: The corrected text itself, rendered from the figures: repaired values in place of the written ones.
_CORRECTED = """select doc_id, string_agg(section, chr(10) order by year) as text from (
  select w.doc_id, w.year, '## ' || w.year || '년 최근 컨센서스 전망치 분석' || chr(10) ||
    case when w.doc_id % 3 = 0 then '| 날짜 | 금액 (원) | 금액 (억원) |' || chr(10) || '|---|---|---|' else '| 날짜 | 영업이익 (원) |' || chr(10) || '|---|---|' end || chr(10) || t.said || chr(10) || chr(10) ||
    case when w.doc_id % 2 = 1 then '- ' || w.year || '년 상반기 전망: ' || case when err = 0 then h1 else h1_written end || '원' || chr(10) || '- ' || w.year || '년 하반기 전망: ' || case when err = 0 then h2 else h2_written end || '원' || chr(10)
        || '- ' || w.year || '년 영업이익 전망: ' || value || '원' || chr(10)
      else '### ' || w.year || '년 영업이익 전망' || chr(10) || '- 상방: ' || case when err in (0, 1, 2, 6) then annual // 10 * 11 else up_written end || '원' || chr(10) || '- 중간: ' || value || '원' || chr(10)
        || '- 하방: ' || case when err in (0, 1, 2, 6) then annual // 10 * 9 else down_written end || '원' || chr(10) end ||
    chr(10) || '결론: ' || w.year || '년 영업이익은 ' || value || '원 수준이다.' || chr(10) || '```' || chr(10) || w.year || '년 영업이익 ' || annual || '원' || chr(10) || '```' || chr(10) as section
  from (select *, case when doc_id % 2 = 1 and err > 5 then annual_written when doc_id % 2 = 0 and err not in (0, 1, 2, 6) then mid_written else annual end as value from written) w
  join (select doc_id, year, string_agg(line, chr(10) order by case when doc_id % 2 = 1 then -m else m end) as said from (
      select doc_id, year, m, '| ' || year || '-0' || m || '-28 | ' || amount_won || case when doc_id % 3 = 0 then ' | ' || (((amount_won + 50) // 100)::decimal(38, 6) / 1000000)::decimal(38, 6)::varchar else '' end || ' |' as line from consensus) group by doc_id, year) t
    on t.doc_id = w.doc_id and t.year = w.year) group by doc_id"""


@query(with_views(f"select doc_id, md5(case when doc_id % 5 = 0 then replace(text, chr(10), chr(13) || chr(10)) else text end) as digest from ({_CORRECTED})"))
def corrected_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the corrected texts."""
    return runs.repair_run(reports(spark, sf_dir))["corrected"].select("doc_id", F.md5("text").alias("digest"))


@query("""select doc_id, case when len(l) > 1 and n1 = 1 then md5(replace(text, o, o || '!')) else md5(coalesce(text, '')) end as digest from (
  select *, (length(text) - length(replace(text, o, ''))) // greatest(1, length(o)) as n1 from (select doc_id, text, string_split(text, chr(10)) as l, coalesce(nullif(string_split(text, chr(10))[1], ''), chr(1)) as o from documents))""".replace("case when len(l) > 1 and n1 = 1", "case when n1 = 1"))
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document is marked where it stands once; the same edit again finds the marked line, which is
    left; an edit of an absent text does nothing."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first = F.split("text", "\n")[0]
    spans = d.filter("text is not null").select("doc_id", F.lit(1).cast("bigint").alias("ord"), first.alias("original"), F.concat(first, F.lit("!")).alias("suggested"))
    absent = spans.select("doc_id", F.lit(2).cast("bigint").alias("ord"), F.lit("\x01").alias("original"), F.lit("x").alias("suggested"))
    return rp.apply_spans(d, spans.unionByName(absent)).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query(with_views(f"""
select kind, count(distinct doc_id)::bigint as docs, count(distinct (doc_id, year))::bigint as corrections, count(*)::bigint as cells
from (select *, case when doc_id % 2 = 1 then 'annual' else 'scenario' end as kind from (select * from ({_ANNUAL}) union all select * from ({_SCENARIO})))
group by rollup(kind)"""))
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 1, "annual").otherwise("scenario")
    x = _changes(_lines(spark, sf_dir)).withColumn("kind", kind)
    return x.rollup("kind").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.struct("doc_id", "year")).alias("corrections"), F.count("*").alias("cells"))


@query(with_views("""select doc_id, year::int as year from written where (doc_id % 2 = 1 and err in (7, 8)) or (doc_id % 2 = 0 and err in (7, 8))"""))
def unrepaired_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header years whose annual or middle value stays more than 2.8 times off, or of the other sign: for review."""
    lines = _lines(spark, sf_dir)
    blocks = _blocks(lines)
    fixed = stored(fc.parsed(rp.apply_changes(lines, stored(rp.annual_repair(lines, blocks).unionByName(rp.scenario_repair(lines, blocks))))))
    annual = rp.annual_cells(fixed, blocks).select("doc_id", "year", "won", "consensus_won")
    mid = con.consensus_asof(fc.scenario_blocks(fixed).withColumn("line_no", F.col("header_line")), blocks).select("doc_id", "year", F.col("mid.won").alias("won"), "consensus_won")
    off = (F.signum("won") != F.signum("consensus_won")) | (rp.scale_ratio(F.col("won"), F.col("consensus_won")) > 2.8)
    return annual.unionByName(mid).filter(off).select("doc_id", _whole())


@query(with_views("""select doc_id, year::int as year from book where err % 2 = 0 and doc_id % 2 = 1"""))
def unchecked_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header years without a value: those whose annual line has lost its digits."""
    damaged = F.when((F.col("doc_id") * 31 + F.regexp_extract("line", "(20[0-9]{2})년", 1).try_cast("bigint")) % 11 % 2 == 0, F.regexp_replace("line", "(영업이익 전망: )-?[0-9]+원", "$1미정")).otherwise(F.col("line"))
    lines = stored(fc.parsed(ln.doc_lines(reports(spark, sf_dir)).withColumn("line", damaged)))
    checked = runs.header_states(lines, _blocks(lines)).filter("checked")
    return runs.unparsed_years(lines, checked).select("doc_id", _whole())


# ------------------------------------------------------------------ sums of halves


def _ratio(a: str, b: str) -> str:
    return f"greatest(abs({a}), abs({b})) / greatest(1.0, least(abs({a}), abs({b})))"


def _off(a: str, p: str, q: str) -> str:
    return f"abs({a} - {p} - {q}) / greatest(1.0, abs({a}), abs({p} + {q}))"


def _falls(*x: str) -> str:
    return f"{x[0]} >= {x[1]} and {x[1]} >= {x[2]}"


#: Brute force over the figures of the case reports: each year's sums, the single cells they point at, then every pair of
#: factors for the halves. a, p, q: cases (up, mid, down) of the year and its halves as written.
_SUMS = f"""
wide as (
  select doc_id, year, [annual // 10 * 11, annual, annual // 10 * 9]::double[] as a,
         [h1 // 10 * 11 * case when err >= 9 then 10 else 1 end, h1 * case when err = 10 then 10 else 1 end, h1 // 10 * 9 * case when err = 10 then 10 else 1 end]::double[] as p,
         [h2 // 10 * 11 * case when err = 10 then 10 else 1 end, h2 * case when err = 10 then 10 else 1 end, h2 // 10 * 9 * case when err = 10 then 10 else 1 end]::double[] as q from book),
gated as (select * from wide where greatest({', '.join(_off(f'a[{n}]', f'p[{n}]', f'q[{n}]') for n in (1, 2, 3))}) >= 0.2),
labels as (select *, a[n] as an, p[n] as pn, q[n] as qn, {_off('a[n]', 'p[n]', 'q[n]')} > 0.02 as broken from gated, (select unnest([1, 2, 3]) as n)),
asked as (select doc_id, year, n, k, case k when 1 then pn else qn end as v, case k when 1 then an - qn else an - pn end as t from labels, (select unnest([1, 2]) as k) where broken),
tried as (select *, row_number() over (partition by doc_id, year, n, k order by abs(v * f - t), i) as place
  from asked, (select unnest([0.001, 0.01, 0.1, 10.0, 100.0, 1000.0]::double[]) as f, unnest([1, 2, 3, 4, 5, 6]) as i) where v <> 0 and t <> 0 and (v < 0) = (t < 0) and {_ratio('v', 't')} >= 5),
found as (select doc_id, year, n, k, v, f from tried where place = 1 and abs(v * f - t) / abs(t) <= 0.02),
mended as (
  select doc_id, year, n, any_value(an) as an, any_value(broken) as broken, count(k) as hits, coalesce(max(v * f) filter (k = 1), any_value(pn)) as np, coalesce(max(v * f) filter (k = 2), any_value(qn)) as nq
  from labels left join found using (doc_id, year, n) group by doc_id, year, n),
one as (
  select doc_id, year from (select doc_id, year, bool_and(not broken or hits = 1) as sure, list(np order by n) as np, list(nq order by n) as nq, list(an order by n) as an from mended group by doc_id, year)
  where sure and {_falls('np[1]', 'np[2]', 'np[3]')} and {_falls('nq[1]', 'nq[2]', 'nq[3]')} and {_falls('an[1]', 'an[2]', 'an[3]')} and greatest({', '.join(_off(f'an[{n}]', f'np[{n}]', f'nq[{n}]') for n in (1, 2, 3))}) <= 0.02),
cells as (select doc_id, year, k, n, f, v as old_won, v * f as new_won, 'identity_cell' as stage from found semi join one using (doc_id, year)),
scaled as (
  select *, worst + 0.001 * ((f1 <> 1)::int + (f2 <> 1)::int) as cost from (
    select *, greatest({', '.join(_off(f'a[{n}]', f'(p[{n}] * f1)', f'(q[{n}] * f2)') for n in (1, 2, 3))}) as worst
    from gated anti join one using (doc_id, year), (select unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]::double[]) as f1), (select unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]::double[]) as f2)
    where not (f1 = 1 and f2 = 1) and {_falls('p[1] * f1', 'p[2] * f1', 'p[3] * f1')} and {_falls('q[1] * f2', 'q[2] * f2', 'q[3] * f2')} and {_falls('a[1]', 'a[2]', 'a[3]')})),
ranked as (select *, row_number() over w as place, lead(cost) over w as next_cost from scaled window w as (partition by doc_id, year order by cost, f1, f2)),
pairs as (select * from ranked where place = 1 and worst <= 0.02 and not coalesce(abs(next_cost - cost) <= 1e-9, false)),
blocks as (
  select doc_id, year, k, n, case k when 1 then f1 else f2 end as f, case k when 1 then p[n] else q[n] end as old_won, case k when 1 then p[n] * f1 else q[n] * f2 end as new_won, 'identity_block' as stage
  from pairs, (select unnest([1, 2]) as k), (select unnest([1, 2, 3]) as n) where case k when 1 then f1 else f2 end <> 1),
identity as (select * from cells union all select * from blocks)"""


def _by_sums(sql: str) -> str:
    return with_views("~" + sql).replace(")\n~", f"),{_SUMS}\n")


_CASE = "doc_id, year::int as year, 'H' || k as period, ['상방', '중간', '하방'][n] as label, f as factor"


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(fc.parsed(ln.doc_lines(case_reports(spark, sf_dir))))
    return stored(rp.invariant_gate(lines, _blocks(lines)))


def _case_columns(x: DataFrame) -> DataFrame:
    return x.select("doc_id", _whole(), "period", "label", "factor", F.round("new_won", 0).alias("new_won"))


@query(_by_sums(f"select {_CASE}, round(new_won, 0) as new_won from cells"))
def invariant_cell_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year, those with several possible repairs included."""
    return _case_columns(rp.invariant_cell_repair(_gated(spark, sf_dir)))


@query(_by_sums(f"select {_CASE}, round(new_won, 0) as new_won from blocks"))
def invariant_block_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year; where two pairs of factors cost the same there is no repair."""
    gated = _gated(spark, sf_dir)
    return _case_columns(rp.invariant_block_repair(gated, rp.invariant_cell_repair(gated)))


@query(_by_sums(f"select {_CASE}, round(new_won, 0) as new_won from cells"))
def invariant_cell_repair_every_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return invariant_cell_repair(spark, sf_dir)


@query(_by_sums(f"select {_CASE}, round(new_won, 0) as new_won from blocks"))
def invariant_block_repair_every_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return invariant_block_repair(spark, sf_dir)


# ------------------------------------------------------------------ whole runs

#: Case reports stand beside the others under ids of their own.
_CASES_FROM = 1_000_000_000


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = titled_cases(spark, sf_dir).select((F.col("doc_id") + _CASES_FROM).alias("doc_id"), "text")
    return stored(reports(spark, sf_dir).select("doc_id", "text").unionByName(cases))


_EVERY_STAGE = f"""select doc_id, 'consensus' as stage, year, label, factor, old_won, new_won from ({_EVERY_CHANGE})
union all select doc_id, 'restatement', null, null, new_won / old_won, old_won, new_won from ({_RESTATED})
union all select doc_id + {_CASES_FROM}, stage, year::int, ['상방', '중간', '하방'][n], f, old_won, new_won from identity"""

#: Titles of case reports stand above any consensus: their item goes where the sum of halves repairs the year.
_OPEN = f"""select doc_id, 'forecast' as stage, year::varchar as year, case when doc_id % 2 = 1 then case err when 7 then 'ratio' else 'sign' end else case err when 7 then 'undecided' else 'order' end end as reason_code from written where err in (7, 8)
union all select doc_id + {_CASES_FROM}, 'forecast', year::varchar, 'no_consensus' from (select doc_id, min(year) as year from book group by doc_id) anti join identity using (doc_id, year)
union all select doc_id + {_CASES_FROM}, 'half_year_sum', year::varchar, 'ambiguous' from gated anti join identity using (doc_id, year)"""


@query(_by_sums(f"select doc_id, stage, year, label, factor, old_won, round(new_won, 0) as new_won from ({_EVERY_STAGE})"))
def changes_of_all_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the consensus, the sums of halves and the restatements changed in a run over both kinds of reports."""
    x = runs.repair_run(_corpus(spark, sf_dir))["changes"]
    return x.select("doc_id", "stage", _whole(), "label", "factor", "old_won", F.round("new_won", 0).alias("new_won"))


@query(_by_sums(f"select * from ({_OPEN})"))
def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a run over both kinds of reports; items that the sum of halves settles are gone."""
    return runs.repair_run(_corpus(spark, sf_dir))["review_items"].select("doc_id", "stage", "year", "reason_code")


_TOTALS = f"""
counts as (
  select doc_id, checked, coalesce(corrections, 0) as corrections, coalesce(cells, 0) as cells, coalesce(restated, 0) as restated, coalesce(items, 0) as items
  from (select doc_id, count(*) as checked from written group by doc_id union all select doc_id + {_CASES_FROM}, count(*) from book group by doc_id)
  left join (select doc_id, count(distinct (stage, year, period)) filter (stage <> 'restatement') as corrections, count(*) filter (stage <> 'restatement') as cells, count(*) filter (stage = 'restatement') as restated
             from (select doc_id, stage, year, null as period from ({_EVERY_STAGE}) where doc_id < {_CASES_FROM} union all select doc_id + {_CASES_FROM}, stage, year, k from identity) group by doc_id) using (doc_id)
  left join (select doc_id, count(*) as items from ({_OPEN}) group by doc_id) using (doc_id))"""


@query(_by_sums(f"""select source, lang, count(*) as docs, sum(checked)::bigint as blocks_checked, sum(corrections)::bigint as corrections, sum(cells)::bigint as cells_changed, sum(restated)::bigint as restated, sum(items)::bigint as review_items, count(*) filter (items > 0) as docs_in_review
from (select *, 'desk' || (doc_id % 4)::varchar as source, case when doc_id % 3 = 0 then 'ko' else 'kr' end as lang from (with {_TOTALS.strip()} select * from counts)) group by rollup(source, lang)"""))
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks checked, corrections, cells and review items by source and language, with subtotals."""
    corpus = _corpus(spark, sf_dir)
    about = corpus.select("doc_id", F.concat(F.lit("desk"), F.col("doc_id") % 4).alias("source"), F.when(F.col("doc_id") % 3 == 0, "ko").otherwise("kr").alias("lang"))
    return runs.corpus_stats(runs.repair_run(corpus)["run_stats"], about)


@query(_by_sums(f"""select run_date, name, n::bigint as n, docs::bigint as docs from (select unnest(['2026-01-01', '2026-01-03']) as run_date), (
  select 'changes' as name, count(*) as n, count(distinct doc_id) as docs from ({_EVERY_STAGE})
  union all select 'review_items', count(*), count(distinct doc_id) from ({_OPEN})
  union all select 'corrected', 2 * count(distinct doc_id), 2 * count(distinct doc_id) from book
  union all select 'run_stats', 2 * count(distinct doc_id), 2 * count(distinct doc_id) from book)"""))
def published_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's four tables written for two dates, for one of them twice; a further date is stopped after its first table
    and a second attempt at it, too, and shows nothing."""
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    with job_tables(spark):
        tables = runs.repair_run(_corpus(spark, sf_dir))
        # Written four times: joined once.
        tables |= {n: stored(tables[n], dealt=True) for n in ("corrected", "run_stats")}
        for date in ("2026-01-01", "2026-01-01", "2026-01-03"):
            publish(tables, path, date)

        class Stopped(Exception):
            pass

        def broken(name: str) -> DataFrame:
            raise Stopped(name)

        class Tables(dict):
            def items(self):
                yield "corrected", self["corrected"]
                broken("changes")

        for _ in range(2):
            try:
                publish(Tables(tables), path, "2026-01-02")
            except Stopped:
                continue
    counts = [published(spark, path, n).groupBy("run_date").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).withColumn("name", F.lit(n)) for n in ("changes", "review_items", "corrected", "run_stats")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.select("run_date", "name", "n", "docs")

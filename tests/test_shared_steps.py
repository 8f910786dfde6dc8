"""The steps that all report queries share: what they carry, how often they pass over the lines, and that nothing is lost."""

import contextlib
import io

from tallyproof.operators import consensus as con, forecast as fc, lines as ln

TEXT = """앞줄
## 2027년 최근 컨센서스 전망치 분석
컨센서스는 9억원
| Date | 영업이익 (원) |
|---|---|
| 2027-01-28 | 100 |
2027년 2월 3일 5억원, 2027년 3월 7억원
### 2027년 영업이익 전망
| 2027-06-28 | 999 |
## 최근 컨센서스 전망치 분석
2028년 영업이익 컨센서스는 3억원
날짜 AMOUNT (억원)
### 2029년 영업이익 전망
## 2030년 최근 컨센서스 전망치 분석
날짜 AMOUNT [원]
2030-05-01 12
"""


def _parsed(spark):
    return fc.parsed(ln.doc_lines(spark.createDataFrame([(1, TEXT), (2, "ohne"), (3, None)], "doc_id long, text string")))


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_entries_of_every_source_stay(spark):
    found = {(r.block_no, r.line_no, str(r.entry_date), r.amount_won, r.source) for r in con.entries(_parsed(spark)).collect()}
    assert found == {(1, 6, "2027-01-28", 100.0, "table"), (1, 7, "2027-02-03", 5e8, "prose_dated"), (1, 7, "2027-03-01", 7e8, "prose_dated"), (2, 11, "2028-01-01", 3e8, "prose_consensus"), (3, 16, "2030-05-01", 12.0, "frame")}


def test_blocks_keep_years_and_bounds(spark):
    lines = _parsed(spark)
    assert [tuple(r) for r in con.block_years(lines).select("block_no", "heading_line", "forecast_year", "year_source").orderBy("block_no").collect()] == [(1, 2, "2027", "heading"), (2, 10, "2028", "section_text"), (3, 14, "2030", "heading")]
    assert [(r.block_no, r.stop_line, r.next_year) for r in con.block_bounds(lines).orderBy("block_no").collect()] == [(1, 8, "2027"), (2, 13, "2029"), (3, 17, None)]


def test_block_lines_leave_parsed_values_behind(spark):
    assert not {"scenario", "annual", "half", "eol"} & set(con.block_lines(_parsed(spark)).columns)


def test_entries_read_the_block_lines_once(spark, tmp_path):
    lines = _parsed(spark)
    for name, df in (("inside", con.block_lines(lines)), ("years", con.block_years(lines))):
        df.write.parquet(str(tmp_path / name))
    inside, years = (spark.read.parquet(str(tmp_path / n)) for n in ("inside", "years"))
    plan = _plan(con.entries(lines, inside, years))
    assert plan.count("/inside]") == 1

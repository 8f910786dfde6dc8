"""Lines are read once: each pattern is tried once on a line, and headers meet cells without the text of the lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyproof.functions.amounts import ANNUAL_LINE, HALF_LINE, SCENARIO_LINE
from tallyproof.operators import forecast as fc


def test_a_pattern_is_tried_once_on_a_line(spark):
    lines = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(1).alias("line_no"), F.concat(F.lit("- 상방: "), F.col("id")).alias("line"), F.lit("").alias("eol"))
    plan = fc.parsed(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in (SCENARIO_LINE, ANNUAL_LINE, HALF_LINE)] == [1, 1, 1]


def test_text_between_cells_ends_a_block_and_lists_and_blanks_do_not(spark):
    said = ["2030년 영업이익 전망", "표", "- 상방: 30원", "", "- 기타", "- 중간: 20원", "글", "- 하방: 10원", "2031년 영업이익 전망", "- 상방: 30원", "* 주", "- 중간: 2조원", " ", "- 하방: -1,000.5 억원 이하"]
    lines = spark.createDataFrame([(1, i, s, "\n") for i, s in enumerate(said, 1)], "doc_id long, line_no int, line string, eol string")
    found = fc.scenario_blocks(fc.parsed(lines)).collect()
    assert [(r.year, r.header_line, r.up.won, r.mid.won, r.down.won) for r in found] == [("2031", 9, 30.0, 2e12, -1000.5e8)]
    assert (found[0].down.prefix, found[0].down.value_text, found[0].down.unit, found[0].down.trailing) == ("- 하방: ", "-1,000.5", " 억원", " 이하")

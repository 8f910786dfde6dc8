"""Export units: every source of a value, contexts that are left alone, odd rows."""

import pytest
from pyspark.sql import functions as F

from tallyproof.operators import exports as ex

TABLE = "  1 2025-02 5,061,234 1,200,000 10 20\n  2 2025-03 4,000,000 2,345,678 10 20\n  3 2025-03 4,100,000 2,345,000 10 20\n"
CASES = {
    "2025-03 DRAM 수출금액은 506.1만 달러(5,061,234 천달러)로 늘었다.": ("2025-03 DRAM 수출금액은 약 50.6억 달러(원자료 5,061,234천달러)로 늘었다.", ["unit"]),
    "DRAM 5061234 과 NAND 1200000 천달러, 각각 506만 천달러와 120만 천달러였다.": ("DRAM 5061234 과 NAND 1200000 천달러, 각각 약 50.6억 달러(원자료 5,061,234천달러)와 약 12억 달러(원자료 1,200,000천달러)였다.", ["text", "text"]),
    "2025-03 NAND 수출금액은 23억 천달러였다.": ("2025-03 NAND 수출금액은 약 23.4억 달러(원자료 2,345,000천달러)였다.", ["table"]),
    "DRAM 23억 천달러 (2025/02)": ("DRAM 약 50.6억 달러(원자료 5,061,234천달러) (2025/02)", ["table"]),
    "DRAM은 약 5백만 천달러였다.": ("DRAM은 약 50억 달러(원자료 5,000,000천달러)였다.", ["display"]),
    "DRAM은 400→506만 천달러였다.": ("DRAM은 약 40억 달러(원자료 4,000,000천달러)→약 50.6억 달러(원자료 5,060,000천달러)였다.", ["range", "display"]),
    "수출금액 천달러 기준 합계는 12.3억 달러, 3억불이다.": ("수출금액 천달러 기준 합계는 약 123억 달러(원자료 12,300,000천달러), 약 30억 달러(원자료 3,000,000천달러)이다.", ["summary", "summary"]),
    "(506만 천달러)": ("(약 50.6억 달러, 원자료 5,060,000천달러)", ["display"]),
    "중량은 12만 톤, 단위가치 12만 천달러.": None,
    "DRAM은 12만kg이고 천달러가 아니다.": None,
    "2025-03 NAND 23억 천달러, 2099-01 DRAM 12억 천달러.": (None, ["table"]),
    "단위 없는 문장": None,
    "": None,
    None: None,
}


def _tables(spark, rows):
    s = spark.createDataFrame(rows, "doc_id long, atom_id long, chunk_no int, statement string, source_quote string, target_text string")
    return s, spark.createDataFrame([(1, 1, TABLE), (1, 2, None)], "doc_id long, chunk_no int, raw_text string")


def test_every_source(spark):
    got = {r.atom_id: r for r in ex.export_unit_resolution(*_tables(spark, [(1, i, 1, t, None, None) for i, t in enumerate(CASES)])).collect()}
    for i, want in enumerate(CASES.values()):
        assert (i in got) == (want is not None)
        if want:
            assert (got[i].corrected_statement, got[i].sources) == want and got[i].status == ("corrected" if want[0] else "unresolved")


def test_target_text_takes_the_statement_values(spark):
    rows = [(1, 1, 2, "DRAM 5061234 천달러는 506만 천달러다.", "", "표: 506만 천달러"), (1, 2, 9, "120만 천달러", "원자료 1200000, 천달러", "다른 말"), (1, 3, 1, "말 없음", "", "506만 천달러")]
    got = {r.atom_id: r.suggested_quote for r in ex.export_unit_resolution(*_tables(spark, rows)).collect()}
    assert got == {1: "표: 약 50.6억 달러(원자료 5,061,234천달러)", 2: "약 12억 달러(원자료 1,200,000천달러)"}


@pytest.mark.parametrize("text, want", [
    ("2025-01 가 2025-02 나 10만 천달러 2025-03", "2025-02"), ("2025-01" + "가" * 120 + "10만 천달러 2025/03", "2025-03"), ("2025-01" + "가" * 120 + "10만 천달러", ""),
    ("10만 달러(2025-05 천달러) 2025-06", "2025-05"), ("2025-01 10만 천달러" , "2025-01"), ("10만 천달러", ""),
])
def test_nearest_period(spark, text, want):
    texts = spark.createDataFrame([(1, 1, "statement", text)], "doc_id long, atom_id long, kind string, text string")
    assert [r.period for r in ex.nearest_period(ex.ambiguous_spans(texts), ex.positions(texts, ex.PERIOD)).collect()] == [want]


def test_brackets_are_flattened(spark):
    x = "(2월 약 50.6억 달러(원자료 5,061,234천달러)) 약 1억 달러(원자료 100,000천달러)"
    assert spark.range(1).select(ex.flattened(F.lit(x))).first()[0] == "(2월 약 50.6억 달러, 원자료 5,061,234천달러) 약 1억 달러(원자료 100,000천달러)"


def test_no_statements(spark):
    assert ex.export_unit_resolution(*[t.limit(0) for t in _tables(spark, [(1, 1, 1, "", "", "")])]).collect() == []

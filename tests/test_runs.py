"""Whole runs on literal reports: requests' own consensus, both passes into the text, the ledger, published tables."""

import glob
import os

import pytest

from tallyproof.operators import runs
from tallyproof.sources.sinks import publish, published
from tallyproof.sources.tables import job_tables, shared_folder, stored

HEAD = "## 2026년 최근 컨센서스 전망치 분석\n2026년 6월 28일 {0}원으로 모였다.\n\n"
HALVES = "".join(f"#### 2026년 {name} 영업이익 전망\n- 상방: {{{i}}}조원\n- 중간: {{{i + 1}}}조원\n- 하방: {{{i + 2}}}조원\n\n" for i, name in ((0, "상반기"), (3, "하반기"), (6, "연간")))
TITLE = "# 2026년 영업이익 전망 시나리오 분석\n" + "비고\n" * 10
REPORTS = {
    1: TITLE + HEAD.format(30 * 10**12) + HALVES.format(110, 100, 90, 220, 200, 180, 33, 30, 27),  # both halves times ten
    2: TITLE + HEAD.format(30 * 10**12) + HALVES.format(110, 10, 9, 22, 20, 18, 33, 30, 27),  # one cell
    3: HALVES.format(110, 100, 90, 220, 200, 180, 33, 30, 27),  # nothing to hold the year by
    4: (HEAD.format(30 * 10**12) + "- 2026년 영업이익 전망: 300조원 (추정)\n\n결론: 2026년 영업이익은 300조원이다.\n").replace("\n", "\r\n"),
    5: "- 2026년 영업이익 전망: 300조원\n- 2027년 영업이익 전망: 90조원\n2028년 영업이익 전망\n없음\n",
    6: "",
    7: None,
}


@pytest.fixture(scope="module")
def run(spark):
    rows = [(k, t, 30e12 if k == 5 else None) for k, t in REPORTS.items()]
    tables = runs.repair_run(spark.createDataFrame(rows, "doc_id long, text string, consensus_won double"))
    return {n: stored(t) for n, t in tables.items()}


def test_repairs_reach_the_text(run):
    got = {r.doc_id: r.text for r in run["corrected"].collect()}
    assert got[1] == REPORTS[1].replace("110조", "11조").replace("100조", "10조").replace("90조", "9조").replace("220조", "22조").replace("200조", "20조").replace("180조", "18조")
    assert got[2] == REPORTS[2].replace("110조", "11조") and got[3] == REPORTS[3]
    assert got[4] == REPORTS[4].replace("300조", "30조")
    assert got[5] == REPORTS[5].replace("300조", "30조") and set(got) == {1, 2, 3, 4, 5}


def test_changes_name_their_stage(run):
    got = {(r.doc_id, r.stage, r.label, r.factor) for r in run["changes"].collect()}
    assert {x for x in got if x[0] == 2} == {(2, "identity_cell", "상방", 0.1)}
    assert {x[1:] for x in got if x[0] == 1} == {("identity_block", label, 0.1) for label in ("상방", "중간", "하방")}
    assert {x for x in got if x[0] in (4, 5)} == {(4, "consensus", "연간", 0.1), (4, "restatement", None, 0.1), (5, "consensus", "연간", 0.1)}


def test_settled_items_are_taken_back(run):
    got = {(r.doc_id, r.stage, r.year, r.reason_code) for r in run["review_items"].collect()}
    assert got == {
        (3, "forecast", "2026", "no_consensus"), (3, "half_year_sum", "2026", "no_consensus"), (3, "forecast", "2026", "unparsed"),
        (5, "forecast", "2027", "ratio"), (5, "forecast", "2028", "unparsed"),
    }


def test_statistics_of_every_report(run):
    got = {r.doc_id: (r.blocks_checked, r.corrections, r.cells_changed, r.restated, r.review_items, r.needs_review) for r in run["run_stats"].collect()}
    assert got == {1: (1, 2, 6, 0, 0, False), 2: (1, 1, 1, 0, 0, False), 3: (0, 0, 0, 0, 3, True), 4: (1, 1, 1, 1, 0, False), 5: (2, 1, 1, 0, 2, True), 6: (0,) * 5 + (False,), 7: (0,) * 5 + (False,)}


def test_units_that_disagree_and_values_with_two_targets(spark):
    table = "## 2026년 최근 컨센서스 전망치 분석\n| 날짜 | 금액 (원) | 금액 (억원) |\n|---|---|---|\n| 2026-05-28 | 30000000000000 | 300000 |\n| 2026-06-28 | 30000000000000 | 999 |\n\n- 2026년 영업이익 전망: 30조원\n"
    two = HEAD.format(30 * 10**12) + "- 2026년 영업이익 전망: 300조원\n\n## 2027년 최근 컨센서스 전망치 분석\n2026년 7월 28일 3조원으로 모였다.\n\n- 2027년 영업이익 전망: 300조원\n\n결론: 2026년과 2027년 영업이익은 300조원이다.\n"
    tables = runs.repair_run(spark.createDataFrame([(1, table), (2, two)], "doc_id long, text string"))
    got = {(r.doc_id, r.stage, r.reason_code) for r in tables["review_items"].collect()}
    assert got == {(1, "consensus", "unit_mismatch"), (2, "restatement", "conflict")}


def test_an_empty_table(spark):
    tables = runs.repair_run(spark.createDataFrame([], "doc_id long, text string"))
    assert all(t.collect() == [] for t in tables.values())


def test_published_again_and_stopped(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    read = lambda: {n: sorted((str(r.run_date), r.doc_id) for r in published(spark, path, n).collect()) for n in ("a", "b")}
    publish({"a": rows(1, 2), "b": rows(3)}, path, "2026-01-01")
    publish({"a": rows(9), "b": rows(8)}, path, "2026-01-02")
    publish({"a": rows(1, 2), "b": rows()}, path, "2026-01-01")
    assert read() == {"a": [("2026-01-01", 1), ("2026-01-01", 2), ("2026-01-02", 9)], "b": [("2026-01-02", 8)]}

    class Broken:
        sparkSession = spark

        def withColumns(self, _):
            raise RuntimeError

    with pytest.raises(RuntimeError):
        publish({"a": rows(5), "b": Broken()}, path, "2026-01-02")
    assert read() == {"a": [("2026-01-01", 1), ("2026-01-01", 2)], "b": []}
    publish({"a": rows(5), "b": rows(6)}, path, "2026-01-02")
    assert read() == {"a": [("2026-01-01", 1), ("2026-01-01", 2), ("2026-01-02", 5)], "b": [("2026-01-02", 6)]}


def test_a_job_leaves_no_tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/table-*"))
    with pytest.raises(ZeroDivisionError), job_tables(spark):
        with job_tables(spark):
            assert stored(spark.range(3)).count() == 3
        assert set(glob.glob(f"{folder}/table-*")) > before
        1 / 0
    assert set(glob.glob(f"{folder}/table-*")) == before and os.path.isdir(folder)

"""Row-level cases of the report operators: literal documents, exact outcomes."""

import hashlib
import re

import pytest

from tallyproof.operators import consensus as con, forecast as fc, lines as ln, repair as rp, review as rv

BOOK = "## 2026년 최근 컨센서스 전망치 분석\n| 날짜 | 매출 (원) | 영업이익 (원) |\n|---|---|---|\n| 2026-06-30 | 9 | {0} |\n| 2026-05-30 | 9 | 1 |\n\n"
CASES = "### 2026년 영업이익 전망\n- 상방: {0}조원\n- 중간: {1}조원\n- 하방: {2}조원\n"


def _run(spark, text):
    lines = ln.doc_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).persist()
    return lines, con.blocks(lines)


def test_lines_round_trip(spark):
    rows = [(1, "a\r\nb\n\nc"), (2, ""), (3, None), (4, "x\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = ln.doc_lines(docs)
    assert [(r.line, r.eol) for r in lines.filter("doc_id = 1").orderBy("line_no").collect()] == [("a", "\r\n"), ("b", "\n"), ("", "\n"), ("c", "")]
    assert {r.doc_id: r.text for r in ln.reassemble(lines).collect()} == {1: rows[0][1], 4: "x\n"}


def test_scale_block_is_repaired(spark):
    lines, blocks = _run(spark, BOOK.format("3.5e13") + CASES.format("4,000", "3,500", "3,000"))
    changes = {r.label: (r.factor, r.new_line) for r in rp.scenario_repair(lines, blocks).collect()}
    assert changes == {"상방": (0.01, "- 상방: 40조원"), "중간": (0.01, "- 중간: 35조원"), "하방": (0.01, "- 하방: 30조원")}


def test_mixed_cells_change_only_the_wrong_ones(spark):
    lines, blocks = _run(spark, BOOK.format("3.5e13") + CASES.format("400", "350", "30"))
    assert {r.label for r in rp.scenario_repair(lines, blocks).collect()} == {"상방", "중간"}


def test_no_consensus_changes_nothing(spark):
    lines, blocks = _run(spark, CASES.format("4,000", "3,500", "3,000"))
    assert rp.scenario_repair(lines, blocks).count() == 0


def test_other_year_is_not_used(spark):
    lines, blocks = _run(spark, BOOK.format("3.5e13") + CASES.format("4,000", "3,500", "3,000").replace("2026", "2027"))
    assert rp.scenario_repair(lines, blocks).count() == 0


@pytest.mark.parametrize("prose, won", [("2025년 7월 40.8조원, 2026년 1월 86.4조원으로 올랐다.", 86.4e12), ("현재 컨센서스는 35조원이다.", 35e12)])
def test_prose_series(spark, prose, won):
    _, blocks = _run(spark, "## 최근 컨센서스 전망치 분석\n" + prose + "\n")
    assert con.latest_consensus(blocks).first().amount_won == pytest.approx(won)


def test_annual_value_takes_its_halves_along(spark):
    text = BOOK.format("350000") + "- 2026년 상반기 전망: 15000원\n- 2026년 하반기 전망: 20000원\n- **2026년 영업이익 전망**: 35,000원 (주석)\n"
    lines, blocks = _run(spark, text)
    new = {r.label: r.new_line for r in rp.annual_repair(lines, blocks).collect()}
    assert new == {"연간": "- **2026년 영업이익 전망**: 350,000원 (주석)", "상반기": "- 2026년 상반기 전망: 150000원", "하반기": "- 2026년 하반기 전망: 200000원"}


def test_ratio_of_three_is_for_review(spark):
    lines, blocks = _run(spark, BOOK.format("40000000000") + "2026년 영업이익 전망: 1200억원\n")
    assert rp.annual_repair(lines, blocks).count() == 0
    assert [r.reason_code for r in rp.annual_reviews(lines, blocks).collect()] == ["ratio"]


def test_signed_sum_holds_and_broken_sum_does_not(spark):
    text = "2026년 상반기 전망: -406원\n2026년 하반기 전망: 610원\n2026년 영업이익 전망: 204원\n2027년 상반기 전망: 10원\n2027년 하반기 전망: 20원\n2027년 영업이익 전망: 200원\n"
    lines, _ = _run(spark, text)
    assert {r.year: r.identity_ok for r in fc.identity_cells(lines).collect()} == {"2026": True, "2027": False}


def test_restatement_outside_fences_only(spark):
    text = BOOK.format("3.5e13") + CASES.format("4,000", "3,500", "3,000") + "\n2026년 영업이익은 3,500조원이다.\n2026년 매출은 3,500조원이다.\n```\n영업이익 3,500조원\n```\n"
    lines, blocks = _run(spark, text)
    changes = rp.scenario_repair(lines, blocks)
    context = ln.line_context(rp.apply_changes(lines, changes))
    found = rp.restatement_repair(context, rv.scale_mappings(changes)).collect()
    assert [(r.old_won, r.new_won, r.new_line) for r in found] == [(3.5e15, 3.5e13, "2026년 영업이익은 35조원이다.")]


def test_restated_values_keep_unit_and_commas(spark):
    lines = ln.doc_lines(spark.createDataFrame([(1, "2026년 영업이익 전망\n영업이익은 12,000 억원(1.2조원)이다. 매출은 12,000억원.\n2027년 영업이익 12,000억원")], "doc_id long, text string"))
    maps = spark.createDataFrame([(1, 1, "2026", "연간", 1.2e12, 1.2e11), (1, 2, "2027", "연간", 1.2e12, 1.2e11), (1, 3, "2027", "상방", 1.2e12, 5e11)], "doc_id long, mapping_no int, year string, label string, old_won double, new_won double")
    got = {r.line_no: (r.replacements, r.new_line) for r in rp.restatement_repair(ln.line_context(lines), maps).collect()}
    assert got == {2: (3, "영업이익은 1,200 억원(0.12조원)이다. 매출은 1,200억원.")}
    values = rp.restatement_values(rp.restatement_matches(ln.line_context(lines), maps)).filter("line_no = 3").collect()
    assert [(r.status, r.mapping_nos, r.new_won) for r in values] == [("review", [2, 3], None)]


def test_year_comes_from_forecast_lines_only(spark):
    text = "2025년 매출 전망\n2026년 영업이익 전망\n2024년 매출\n```\n2030년 영업이익 전망\n```\n영업이익"
    got = [(r.active_year, r.in_fence) for r in ln.line_context(ln.doc_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("line_no").collect()]
    assert got == [(None, False), ("2026", False), ("2026", False), ("2026", True), ("2026", True), ("2026", True), ("2026", False)]


def test_spans_apply_where_they_stand_once(spark):
    texts = spark.createDataFrame([(1, "a b a c"), (2, "x"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 1, "a", "z"), (1, 2, "b a", "b q"), (1, 3, "a", "z"), (1, 4, "nothing", "y")], "doc_id long, ord long, original string, suggested string")
    assert {r.doc_id: (r.text, r.applied) for r in rp.apply_spans(texts, spans).collect()} == {1: ("z b q c", [2, 3]), 2: ("x", []), 3: (None, [])}


def test_every_document_is_chunked_against_brute_force(spark, tmp_path):
    from tallyproof.plans import registry

    long = "\n".join(f"{'w' * 900} {i}" for i in range(60))
    texts = ["one\n two \n\nthree", "# A\nx\n| a | b |\n|---|:-:|\n| 1 | 2 |\n|  | 3 |\ny\nz\n ## B c \n\n edge \n#no heading", "\n\n", "a | b\n#\n# \nq\r\nr\n2.1. Two\nt\n3.\nu", "", None, "| x |\n\n| y | k |\nlast\n| p | q |\n| - | |\n| 5 |\n| 6 | 7 | 8 |", long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for doc, text in enumerate(texts):
        section, header, chunks, para = "root", None, [], []

        def close():
            if sum(map(len, para)) + len(para) - 1 <= 20_000:
                parts = [para] if para else []
            else:
                parts, used = [[]], 0
                for p in para:
                    if parts[-1] and used + len(p) > 20_000:
                        parts, used = [*parts, []], 0
                    parts[-1].append(p)
                    used += len(p) + 1
            chunks.extend(["paragraph", section, "\n".join(p)] for p in parts)

        for line in [*re.split(r"\r\n|\n", text or ""), ""]:
            clean = line.strip()
            title, row = clean.startswith("#") or re.match(r"\d+(\.\d+)*\.", clean), clean.startswith("|")
            if not clean or title or row:
                close()
                para = []
            if row:
                cells = [c.strip() for c in clean.strip("|").split("|")]
                if len(cells) > 1 and not all(re.fullmatch(":?-+:?", c) for c in cells):
                    if header is None:
                        header = cells
                    else:
                        pairs = [f"{h}: {c}" for h, c in zip(header, cells) if h and c]
                        chunks.append(["table_row", section, " | ".join(pairs) or clean])
                continue
            header = None
            if title:
                bare = re.sub(r"^[#\s]+", "", clean)
                section = re.sub(r"^\d+(\.\d+)*\.\s*", "", bare).strip() or bare
            elif clean:
                para.append(clean)
        want |= {(doc, n, kind, head, hashlib.md5(c.encode()).hexdigest()) for n, (kind, head, c) in enumerate(chunks, 1)}
    got = registry.QUERIES["chunk_documents"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want

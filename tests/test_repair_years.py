"""Sums of halves in years whose halves differ widely, where several repairs compete: brute force over the figures."""

import datetime
import itertools

from tallyproof.functions.amounts import BLOCK_FACTORS, FACTORS
from tallyproof.operators import consensus as con, lines as ln, repair as rp
from tallyproof.plans import registry

LABELS = ("상방", "중간", "하방")


def _error(a, h1, h2):
    return abs(a - h1 - h2) / max(1.0, abs(a), abs(h1 + h2))


def _decision(v, target):
    if v == 0 or target == 0 or (v < 0) != (target < 0) or max(abs(v), abs(target)) / max(1.0, min(abs(v), abs(target))) < 5:
        return None
    d, _, f = min((abs(v * f - target), i, f) for i, f in enumerate(FACTORS))
    return f if d / abs(target) <= 0.02 else None


def _in_order(b):
    return b[0] >= b[1] >= b[2]


def _repairs(h1, h2, a):
    """("cell" or "block", [(period, label, factor, new)]) of three blocks of three cases."""
    if max(map(_error, a, h1, h2)) < 0.2:
        return "", []
    new, rows, sure = [list(h1), list(h2)], [], True
    for n in range(3):
        if _error(a[n], h1[n], h2[n]) > 0.02:
            f = (_decision(h1[n], a[n] - h2[n]), _decision(h2[n], a[n] - h1[n]))
            sure &= (f[0] is None) != (f[1] is None)
            for k in range(2):
                if f[k] is not None:
                    new[k][n] *= f[k]
                    rows.append((f"H{k + 1}", LABELS[n], f[k], round(new[k][n])))
    if sure and all(map(_in_order, (*new, a))) and max(map(_error, a, *new)) <= 0.02 and rows:
        return "cell", rows
    ranked = []
    for f in itertools.product(BLOCK_FACTORS, BLOCK_FACTORS):
        if f != (1.0, 1.0) and all(map(_in_order, (h1, h2, a))):
            worst = max(_error(a[n], h1[n] * f[0], h2[n] * f[1]) for n in range(3))
            ranked.append((worst + 0.001 * sum(x != 1.0 for x in f), f, worst))
    ranked.sort()
    if not ranked or ranked[0][2] > 0.02 or abs(ranked[1][0] - ranked[0][0]) <= 1e-9:
        return "", []
    return "block", [(f"H{k + 1}", LABELS[n], x, round((h1, h2)[k][n] * x)) for k, x in enumerate(ranked[0][1]) if x != 1.0 for n in range(3)]


def test_every_year_against_brute_force(spark, tmp_path):
    docs = [d for d in range(1, 120) if (d * 31 + 2026) % 11 in (9, 10)]
    sizes = [(700, 700), (7700, 700), (7000, 700), (70000, 700), (7000000, 70), (700, 7700), (700, 70000), (70, 7000000), (30000, 700), (700, 30000)]
    orders, want = [], {"cell": set(), "block": set()}
    for i, doc in enumerate(docs):
        halves = sizes[i // 2 % len(sizes)]
        orders += [(doc, datetime.date(2016, month, 1), float(x)) for month, x in zip((2, 9), halves)]
        h1, h2 = (x * 100000 for x in halves)
        err = (doc * 31 + 2026) % 11
        one, two = [[float(h // 10 * 11), float(h), float(h // 10 * 9)] for h in (h1, h2)]
        year = [float((h1 + h2) // 10 * 11), float(h1 + h2), float((h1 + h2) // 10 * 9)]
        if err == 9:
            one[0] *= 10
        else:
            one, two = [x * 10 for x in one], [x * 10 for x in two]
        kind, rows = _repairs(one, two, year)
        if kind:
            want[kind] |= {(doc, 2026, *r) for r in rows}
    wide = {d for i, d in enumerate(docs) if max(s := sizes[i // 2 % len(sizes)]) > 10 * min(s)}
    assert all(wide & {r[0] for r in rows} for rows in want.values())
    spark.createDataFrame(orders, "o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    for kind, rows in want.items():
        got = registry.QUERIES[f"invariant_{kind}_repair_every_year"](spark, str(tmp_path)).collect()
        assert {(r.doc_id, r.year, r.period, r.label, r.factor, round(r.new_won)) for r in got} == rows and len(got) == len(rows)


def test_two_repairs_of_one_cost_change_nothing(spark):
    blocks = "".join(f"#### 2026년 {name} 영업이익 전망\n- 상방: {11 * x}원\n- 중간: {10 * x}원\n- 하방: {9 * x}원\n\n" for name, x in (("상반기", 10**9), ("하반기", 10**9), ("연간", 1001 * 10**6)))
    text = f"## 2026년 최근 컨센서스 전망치 분석\n2026년 6월 28일 {1001 * 10**7}원으로 모였다.\n\n" + blocks
    lines = ln.doc_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).persist()
    gated = rp.invariant_gate(lines, con.blocks(lines)).persist()
    by_cell = rp.invariant_cell_repair(gated)
    assert gated.count() == 1 and by_cell.count() == 0
    assert rp.invariant_block_repair(gated, by_cell).count() == 0

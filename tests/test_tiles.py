"""Pairs and duplicates of large documents in tiles, against one matrix."""

import numpy as np
from pyspark.sql import functions as F

from tallyproof.operators import facts as fa, graph as gr


def _atoms(spark, n=600, docs=2, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(docs):
        vec = rng.normal(size=(n, 6))
        vec[n // 2 :] = vec[: n - n // 2] + rng.normal(size=(n - n // 2, 6)) * 0.05
        vec /= np.linalg.norm(vec, axis=1)[:, None]
        rows += [(d, i, i // 4 if i % 9 else None, ["", "매출", "이익"][i % 3], "2026" if i % 5 == 0 else None, "", ["", "positive", "negative"][i % 3 if i % 2 else 0], [str(i % (n // 2) % 7)], vec[i].tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, ord long, chunk_no int, metric string, period string, subject string, polarity string, signature array<string>, vec array<double>")


def test_pairs_of_tiles(spark):
    rows, atoms = _atoms(spark, 60)
    groups = atoms.select("doc_id", (F.col("ord") - F.col("ord") % 3 % 2).alias("rep"), F.col("ord").alias("member"))
    rep = {i: i - i % 3 % 2 for i in range(60)}
    want = {}
    for d in (0, 1):
        own = [r for r in rows if r[0] == d]
        order = {c: k for k, c in enumerate(dict.fromkeys(r[2] for r in own if r[2] is not None))}
        for x in own:
            for y in own:
                a, b = rep[x[1]], rep[y[1]]
                if a < b:
                    gap = abs(order[x[2]] - order[y[2]]) if x[2] is not None and y[2] is not None else -1
                    new = [float(np.dot(x[8], y[8])), gap == 0, gap == 1, x[3] == y[3] != "", x[4] == y[4] is not None, False]
                    old = want.get((d, a, b), [-2.0] + [False] * 5)
                    want[d, a, b] = [max(old[0], new[0]), *(p or q for p, q in zip(old[1:], new[1:]))]
    for size in (7, 1024):
        got = {(r[0], r[1], r[2]): [r[3], *r[4:]] for r in fa.member_pairs(atoms, groups, size=size).collect()}
        assert got.keys() == want.keys() and all(abs(got[k][0] - v[0]) < 1e-12 and got[k][1:] == v[1:] for k, v in want.items())
    gated = fa.pair_gate(fa.member_pairs(atoms, groups, 0.8, 7), 0.8, 0.9)
    plain = lambda df: sorted(map(repr, df.withColumn("similarity", F.round("similarity", 9)).collect()))
    assert plain(gated) == plain(fa.pair_gate(fa.member_pairs(atoms, groups), 0.8, 0.9))


def test_duplicates_of_tiles(spark):
    rows, atoms = _atoms(spark)
    blocked, label = {0: 0, 1: 0}, {}
    for d in (0, 1):
        own = [r for r in rows if r[0] == d]
        label |= {(d, i): i for i in range(len(own))}
        near = np.array([r[8] for r in own])
        for i, j in zip(*np.nonzero(np.triu(near @ near.T >= 0.98, 1))):
            x, y = own[i], own[j]
            if x[7] == y[7] and all(p == q or not p or not q for p, q in ((x[3], y[3]), (x[6], y[6]))):
                a, b = sorted((label[d, i], label[d, j]))
                label = {k: a if k[0] == d and v == b else v for k, v in label.items()} if a != b else label
            else:
                blocked[d] += 1
    assert 0 < len(set(label.items())) and min(blocked.values()) > 0
    for size in (50, 1024):
        got = {(r.doc_id, r.member): r.rep for r in gr.near_duplicate_groups(atoms, 0.98, size).collect()}
        assert got == label
        assert {r.doc_id: r.blocked for r in gr.blocked_duplicates(atoms, 0.98, size).collect()} == blocked


def test_no_atoms(spark):
    _, atoms = _atoms(spark, 4)
    none = atoms.limit(0)
    assert gr.near_duplicate_groups(none).collect() == [] and gr.blocked_duplicates(none).collect() == []
    assert fa.member_pairs(none, none.select("doc_id", F.col("ord").alias("rep"), F.col("ord").alias("member"))).collect() == []

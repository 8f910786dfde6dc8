"""Hard negatives, source audit and SimHash components against brute force, with odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

# ------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, label int, embedding array<float>"


def _vectors(n=240, d=13, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in np.float32(rng.normal(0, 0.3, d))]) for i in range(n)]
    rows += [(i + 1000, rows[i][1], rows[i][2]) for i in range(0, 60, 2)]  # ties
    rows += [(2000, None, rows[0][2]), (2050, 1, None), (2100, 1, [0.1, None]), (2150, 2, [float("nan")] * d), (2200, 2, [float("inf")] * d), (2250, 1, []), (2300, 1, [0.5, -0.5]), (None, 1, rows[1][2]), (2350, 3, [1e9] * d), (2400, 77, rows[2][2])]
    return rows


def _mined(rows, anchor, positives=5, negatives=3):
    use = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)]
    out = []
    for i, k, v in use:
        if not anchor(i):
            continue
        met = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in use if j != i)
        for s, j, _ in [x for x in met if x[2] == k][:positives]:
            good = [x for x in met if x[2] != k and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("part", [64 << 20, 4000])
def test_hard_negatives_against_brute_force(spark, part):
    from tallyproof.llm.hard_negatives import Mining, mine_hard_negatives

    rows = _vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("anchor", F.lit("own")).withColumn("part", F.lit("own"))
    got = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, Mining(part=part, block=7)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    want = _mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 100
    assert sorted(map(tuple, got)) == want


def test_hard_negatives_of_nothing_and_of_repeated_rows(spark):
    from tallyproof.llm.hard_negatives import Mining, mine_hard_negatives

    assert mine_hard_negatives(spark.createDataFrame([], VECTORS), F.lit(True)).collect() == []
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.6, 0.6]), (2, 2, [0.6, 0.6])]
    got = mine_hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, Mining(negatives=2)).select("anchor_id", "positive_id", "rank", "negative_id").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2)] * 2 + [(0, 1, 2, 2)] * 2


def test_bit_plane_scores_are_inner_products():
    from tallyproof.llm.hard_negatives import bit_planes, scores, subset_sums

    rng = np.random.default_rng(1)
    for top in (1, 160, 2**24):
        a, b = rng.integers(-top, top, (5, 19)), rng.integers(-top, top, (33, 19))
        assert (scores(subset_sums(a, np.int64), bit_planes(b)) == b @ a.T).all()
    assert (scores(subset_sums(a[:1] * 0 - 3, np.int32), bit_planes(np.array([[-1] * 19, [0] * 19]))) == [[57], [0]]).all()


# ------------------------------------------------------------------ source audit


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _audited(rows, least=10, top=10):
    docs = [((lang or ""), (source or ""), _terms(text)) for lang, source, text in rows]
    groups, out = sorted({(a, b) for a, b, _ in docs}), []
    for lang in {a for a, _ in groups}:
        df = collections.Counter(t for a, _, ts in docs if a == lang for t in set(ts))
        kept = {t for t, n in df.items() if n >= least}
        counts = {b: collections.Counter(t for x, y, ts in docs if (x, y) == (lang, b) for t in ts if t in kept) for a, b in groups if a == lang}
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        whole = sum(counts.values(), collections.Counter())
        for b, own in counts.items():
            pair = [(-sum(f(p(own, t), p(other, t)) for t in kept), c) for c, other in counts.items() if c != b]
            term = [(-f(p(own, t), p(whole, t)), t) for t in kept if own[t] > 0 and p(own, t) > p(whole, t)]
            for part, found in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, b, part, item, -v, r + 1) for r, (v, item) in enumerate(found)]
    return sorted(out)


def _sources(seed=3):
    rng = random.Random(seed)
    words = ["a", "de", "Été", "straße", "eightbyt", "ninebytes", "sixteenbyteslong", "seventeenbyteslon", "x" * 40, "日本語の文章です", "İ", "end"] + ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 20))) for _ in range(40)]
    rows = []
    for i in range(300):
        own = words[i % 5 :: 2] if i % 3 else words
        text = "".join(rng.choice(own) + rng.choice([" ", ", ", "\n", "-", "1"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "fr"]), f"s{i % 7}", text))
    return rows + [(None, None, "only one"), ("en", None, None), ("en", "", ""), ("fr", "s0", "..."), ("de", "s1", None), ("de", "s2", "rare words"), ("en", "s1", "long " * 30_000 + "y" * 70_000)]


@pytest.mark.parametrize("sizes", [{}, {"block": 5, "tile": 2, "batch": 900}])
def test_source_audit_against_brute_force(spark, sizes):
    from tallyproof.llm.source_audit import Audit, audit_sources

    rows = _sources()
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("own")).withColumn("p", F.lit("own"))
    got = audit_sources(df, Audit(**sizes)).select("lang", "source", "part", "item", "value", "rank").collect()
    want = _audited(rows)
    assert sum(r[2] == "term" for r in want) > 20
    assert sorted(map(tuple, got)) == want


def test_source_audit_of_nothing(spark):
    from tallyproof.llm.source_audit import audit_sources

    assert audit_sources(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_terms_in_radix_order_are_runs():
    from tallyproof.llm.source_audit import term_order

    terms = [t.encode() for _, _, text in _sources() for t in _terms(text)]
    lengths = np.array([len(t) for t in terms])
    data = np.frombuffer(b"".join(terms), np.uint8)
    seen = []
    for order, new in term_order(data, np.cumsum(lengths) - lengths, lengths):
        got = [terms[i] for i in order]
        assert got == sorted(got) and new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]
        assert all(a < b for a, b, n in zip(order, order[1:], new[1:]) if not n)
        seen += order.tolist()
    assert sorted(seen) == list(range(len(terms)))


# ------------------------------------------------------------------ SimHash


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _labels(values, bits=4):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("sizes", [{}, {"trie": 3, "frontier": 5, "leaf": 1}])
def test_simhash_components_against_brute_force(spark, sizes):
    from tallyproof.llm.simhash import SimHash, fingerprint_components

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 300))] for _ in range(25)]
    texts = [" ".join(b) for b in base] + ["  ".join(b[:-1] + ["Changed"]).upper() for b in base] + [" ".join(b[3:]) for b in base]
    rows = [(i + 5, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (None, "no id at all here"), (903, "no id at all here"), (904, "lorem ipsum " * 30_000), (3, texts[0]), (3, texts[1]), (3, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own")).withColumn("component", F.lit("own"))
    got = sorted(map(tuple, fingerprint_components(df, SimHash(**sizes)).collect()), key=repr)
    fps = [_fingerprint(t) for _, t in rows]
    label = _labels(fps)
    least = {c: min((d for (d, _), x in zip(rows, label) if x == c and d is not None), default=None) for c in set(label)}
    assert len(set(label)) < len(set(fps))
    assert got == sorted(((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, label)), key=repr)


def test_trie_join_on_clusters():
    from tallyproof.llm.simhash import SimHash, trie_components

    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(40)} | {rng.getrandbits(20) for _ in range(60)}
    values = sorted(values)
    for sizes in ({}, {"leaf": 1, "frontier": 3}):
        got = trie_components(np.array(values, dtype=np.uint64), SimHash(**sizes))
        assert got.tolist() == _labels(values)

"""Fact operators on literal rows and against plain Python."""

import random

from pyspark.sql import functions as F

from tallyproof.functions import facts as fx
from tallyproof.operators import atoms as at, graph as gr, jobs as jb, review as rv


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_values_belong_to_the_metric_before_them(spark):
    said = F.lit("2026년 매출 97조1467억원, 영업이익은 12억원, 영업이익률 12.5%(잠정), 당기순이익 5억원")
    got = [(v.metric, v.value) for v in _one(spark, fx.metric_values(said))]
    assert got == [("매출", "97조1467억원"), ("영업이익", "12억원"), ("영업이익률", "12.5%(잠정)"), ("순이익", "5억원")]
    assert _one(spark, fx.metrics_in(F.lit("영업이익률과 영업이익, 매출액"))) == ["영업이익률", "영업이익", "매출액"]
    assert _one(spark, fx.metrics_in(F.lit("영업이익률만"))) == ["영업이익률"]
    assert _one(spark, fx.periods_in(F.lit("2026년, 2027 2063억원 3Q25 2026년 2024/Q1"))) == ["2026년", "2027", "3Q25", "2024/Q1"]
    assert _one(spark, fx.amount_in(F.lit("약 49조2063억원"))) == 492063.0
    assert _one(spark, fx.amount_after(F.lit("매출액은 늘었다. 매출액 3,000억원"), "매출액")) == 3000.0


def test_ids_of_raw_atoms(spark):
    rows = [(1, k, i, s) for k, (i, s) in enumerate([(None, "a"), ("a002", "b"), ("a002", "c"), ("x", " "), ("a1", "d"), ("a010", "e"), (None, "f")])]
    raw = spark.createDataFrame(rows, "doc_id long, ord long, id string, statement string").withColumns({f: F.lit(None).cast("string") for f in [*at.LIMITS, "polarity", "confidence"] if f != "statement"})
    # In order: the place, the own id, one after the place where the own id is taken, …
    assert [r.atom_id for r in at.coerce_atoms(raw).orderBy("ord").collect()] == ["a001", "a002", "a004", "a005", "a010", "a006"]


def test_merging_fills_both_ways(spark):
    fields = {f: "" for f in at._FILLED}
    items = [{"statement": "A b", "metric": "m"}, {"statement": "a B", "value": "1", "period": "p", "unit_type": "u"}, {"statement": "ab", "metric": "other", "source_quote": "q"}, {"statement": " "}]
    rows = [{**fields, **x, "doc_id": 1, "chunk_no": 1, "ord": k, "confidence": 0.1 * k, "mandatory": k == 0} for k, x in enumerate(items)]
    got = at.merge_atoms(spark.createDataFrame(rows)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.atom_id, r.statement, r.metric, r.value, r.period, r.source_quote) == ("a001", "a B", "m", "1", "p", "q")


def test_first_balanced_object(spark):
    texts = ['x {"a": "}"} {"b": 1}', '{"a": {"b": 1}} tail }', '{"a": 1', "none", '```json\n{"a": 5}\n```', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, raw string")
    got = [r.v for r in df.select("id", jb.first_object(F.coalesce("raw", F.lit(""))).alias("v")).orderBy("id").collect()]
    assert got == ['{"a": "}"}', '{"a": {"b": 1}}', None, None, '{"a": 5}', None]
    x = jb.response_contract(spark.createDataFrame([(1, '{"k": 3, "note": "5\\% \\n"} {"k": 4}'), (2, '{"note": "x"}')], "id long, raw string"), "k bigint, note string", ["k"])
    assert [(r.status, r.parsed.k) for r in x.orderBy("id").collect()] == [("ok", 3), ("rejected", None)]


def test_values_move_into_the_quote_once(spark):
    rows = [("매출 10억원", "매출 20억원", "전년 110억원, 올해 10억원이다"), ("5% 상승", "7% 상승", "5%대"), ("값 3", "값 4", "33 3번 3"), ("1 2", "1 2", "1 2")]
    df = spark.createDataFrame(rows, "original_statement string, corrected_statement string, quote string")
    assert [r.merged for r in rv.value_transplant(df).collect()] == ["전년 110억원, 올해 20억원이다", "7%대", "33 3번 4", None]


def _batches(ids, edges, chunks, size):
    """Components in walk order, cut into batches, by the plain algorithm."""
    out, inn, near = {}, {}, {i: set() for i in ids}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
        inn.setdefault(t, set()).add(s)
        if s in near and t in near:
            near[s].add(t)
            near[t].add(s)
    by_chunk = {}
    for i in ids:
        by_chunk.setdefault(chunks[i], []).append(i)
    for members in by_chunk.values():
        for a, b in zip(members, members[1:]):
            near[a].add(b)
            near[b].add(a)
    left, rows = set(ids), []
    while left:
        queue, found = [min(left)], []
        left.discard(queue[0])
        while queue:
            found.append(queue.pop(0))
            new = sorted(near[found[-1]] & left)
            left -= set(new)
            queue += new
        inside = set(found)
        queue, walked = sorted(i for i in inside if not inn.get(i, set()) & inside) or [min(inside)], []
        while queue:
            i = queue.pop(0)
            if i not in walked:
                walked.append(i)
                queue += sorted(out.get(i, set()) & inside) or sorted(near[i] & inside)
        walked += [i for i in found if i not in walked]
        for k in range(0, len(walked), size):
            part = walked[k : k + size]
            rank = lambda i: (walked.index(i) if i in inside else 10**9, i)
            up = sorted(inn.get(part[0], set()) - set(part), key=rank)[:1]
            down = sorted(out.get(part[-1], set()) - set(part), key=rank)[:1]
            listed = [(i, "parent+child" if up == down else "parent") for i in up] + [(i, "active") for i in part] + [(i, "child") for i in down if up != down]
            rows += [(walked[0], k // size, i, n, role) for n, (i, role) in enumerate(listed, 1)]
    return sorted(rows)


def test_component_batches_against_plain_python(spark):
    rng = random.Random(4)
    nodes, edges, want = [], [], {}
    for doc in range(6):
        ids = [f"a{n}" for n in rng.sample(range(1, 40), 14)]
        chunks = {i: rng.randint(1, 9) for i in ids}
        own = {(a, b) for a, b in (rng.sample([*ids, "b1", "b2"], 2) for _ in range(rng.randint(3, 14)))}
        nodes += [(doc, i, chunks[i], k) for k, i in enumerate(ids)]
        edges += [(doc, a, b) for a, b in own]
        want[doc] = _batches(ids, own, chunks, 3)
    c = spark.createDataFrame(nodes, "doc_id long, atom_id string, chunk_no int, ord long")
    known = c.select("doc_id", "atom_id").unionByName(spark.createDataFrame([(d, b) for d in range(6) for b in ("b1", "b2")], "doc_id long, atom_id string"))
    got = gr.component_batches(c, spark.createDataFrame(edges, "doc_id long, source string, target string"), known, 3).collect()
    for doc in range(6):
        assert sorted((r.component, r.batch_no, r.atom_id, r.place, r.role) for r in got if r.doc_id == doc) == want[doc]


def test_tenths_round_the_exact_value(spark):
    import random

    from pyspark.sql import functions as F

    from tallyproof.functions import facts as fx

    rng = random.Random(7)
    values = [130.35, 14.850000000000001, 430.34999999999997, 0.25, 0.75, -0.25, -2.35, 0.0, 1e18, 14.85] + [rng.randrange(1, 10**6) / 20 for _ in range(500)] + [rng.uniform(-1e4, 1e4) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", fx.to_tenths(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(v, round(v, 1)) for v in values]


def test_quotes_are_found_by_rare_keys(spark):
    import random

    from tallyproof.operators import graph as gr

    rng = random.Random(3)
    words = ["ab", "abc", "1,234억원", "5%", "매출액은", "x", "yz", "a b", "｡"]
    chunks = [(d, k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for d in (1, 2) for k in range(1, 30)] + [(1, 40, None), (1, 41, "")]
    asks = []
    for i in range(300):
        d, _, text = rng.choice(chunks[:-2])
        a = rng.randint(0, len(text))
        asks.append((d, i, rng.choice([text[a : a + rng.randint(0, 25)], "not there at all", "zz"])))
    got = gr.containing_chunks(spark.createDataFrame(asks, "doc_id long, atom_id long, needle string"), spark.createDataFrame(chunks, "doc_id long, chunk_no int, text string")).collect()
    want = [(d, i, n, k) for d, i, n in asks for e, k, t in chunks if n and d == e and t is not None and n in t]
    assert sorted((r.doc_id, r.atom_id, r.needle, r.chunk_no) for r in got) == sorted(want) and len(want) > 300


def test_values_meet_within_their_tolerance(spark):
    from tallyproof.operators import review as rv

    texts = [(1, 1, "영업이익 35조원과 350,000억원, 3조원"), (1, 2, "영업이익 -35조원"), (2, 1, "35조원"), (1, 3, "0.5원, 0원"), (1, 4, "없음")]
    maps = [(1, 1, 35e12), (1, 2, 35e12 * (1 + 5e-11)), (1, 3, 35e12 * (1 + 5e-10)), (1, 4, -35e12), (1, 5, 0.5), (1, 6, 0.0), (2, 7, None)]
    rows = spark.createDataFrame(texts, "doc_id long, line_no int, line string")
    got = rv.with_value(rows, F.col("line"), spark.createDataFrame(maps, "doc_id long, mapping_no int, old_won double")).collect()
    assert sorted((r.line_no, r.mapping_no) for r in got) == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 4), (3, 5), (3, 6)]


def test_a_large_group_is_packed_and_numbered_in_one_pass(spark):
    n = 300_000
    items = spark.range(n).selectExpr("id div 299999 as doc_id", "id as ord", "id % 7 as size")
    got = gr.greedy_packing(items, ["doc_id"], ["ord"], "size", 5, 12).groupBy("doc_id", "batch_no").agg(F.count("*").alias("n"), F.sum("size").alias("used"), F.min("ord").alias("first")).orderBy("doc_id", "batch_no").collect()
    assert all(r.n <= 5 and r.used <= 12 for r in got) and sum(r.n for r in got) == n and got[-1].doc_id == 1 and got[-1].batch_no == 1
    batch, count, used = 1, 0, 0
    for i in range(1000):
        if count and (count >= 5 or used + i % 7 > 12):
            batch, count, used = batch + 1, 0, 0
        count, used = count + 1, used + i % 7
    assert max(r.batch_no for r in got if r.first < 1000 and r.doc_id == 0) == batch

    named = at._numbered(spark.range(n).selectExpr("0L as doc_id", "id as ord", "case when id % 3 = 0 then concat('a', lpad(string(id div 2 + 1), greatest(3, length(string(id div 2 + 1))), '0')) end as _own"))
    assert named.select("atom_id").distinct().count() == n

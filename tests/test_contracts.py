"""Response contracts on literal texts."""

from tallyproof.operators import contracts as ct

CASES = [
    ("approval", 'Sure: ```json\n{"approve": true, "reason": "a } b"}\n```', None), ("approval", '{"approve": "true", "reason": "x"}', "type:approve"), ("approval", '{"reason": "x"}', "missing:approve"),
    ("approval", '{"approve": null, "reason": "x"}', "type:approve"), ("approval", '{"approve": true, "reason": "x"', "truncated"), ("approval", "no", "no_object"), ("approval", None, "no_object"), ("approval", "", "no_object"),
    ("approval", "{approve: true}", "not_json"), ("approval", '{"approve": true, "reason": "5\\% of \\"x\\""}', None), ("approval", '{"approve": true, "reason": "x", "more": 1}', None), ("other", "{}", "unknown_kind"), (None, "{}", "unknown_kind"),
    ("atom_graph", '{"atoms": []}', None), ("atom_graph", '{"atoms": [], "edges": {}}', "type:edges"), ("relations", '{"edges": [1]} {"edges": 2}', None), ("rewrite", '} {"suggested_text": "s", "reason": "r"}', None), ("rewrite", '{"reason": 1}', "missing:suggested_text"),
]


def _reasons(spark, **more):
    rows = spark.createDataFrame([(i, k, r) for i, (k, r, _) in enumerate(CASES)], "i int, kind string, raw string")
    return [r.reason_code for r in ct.response_bodies(rows, **more).orderBy("i").collect()]


def test_every_reason(spark):
    assert _reasons(spark) == [w for _, _, w in CASES]


def test_strict_contracts_refuse_more(spark):
    want = [w for _, _, w in CASES]
    want[10], want[15] = "extra", "item:edges"
    assert _reasons(spark, strict=True) == want


def test_items_and_an_empty_table(spark):
    rows = spark.createDataFrame([(1, "suspects", '{"suspects": [{"id": 4}, {}]}'), (2, "suspects", '{"suspects": 1}')], "i int, kind string, raw string")
    got = ct.response_items(ct.response_bodies(rows), "suspects").selectExpr("i", "place", "try_variant_get(item, '$.id', 'int') as id").collect()
    assert sorted((r.i, r.place, r.id) for r in got) == [(1, 0, 4), (1, 1, None)]
    assert ct.response_bodies(rows.limit(0)).count() == 0

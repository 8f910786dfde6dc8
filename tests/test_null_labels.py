"""A null label is a blank metric, in the query and in its SQL."""

from __future__ import annotations

import duckdb

import __spark_entry__ as e


def test_signed_duplicates_with_null_labels_equal_their_sql(spark, tmp_path):
    rows = [(1, [1.0, 0.0], None), (13, [1.0, 0.0], 3), (61, [1.0, 0.0], 4), (73, [1.0, 0.0], 3)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
        want = {tuple(r) for r in c.execute(e.oracle_sql()["signed_duplicate_groups"]).fetchall()}
    got = {(r.doc_id, r.member, r.rep) for r in e.queries()["signed_duplicate_groups"](spark, folder).collect()}
    assert got == want == {(0, 1, 1), (0, 13, 1), (1, 61, 61), (1, 73, 73)}


def test_groups_take_numbers_as_metrics(spark):
    from tallyproof.operators import graph as gr

    rows = [(1, i, m, None, [], [1.0, 0.0]) for i, m in ((1, 3), (2, None), (3, 4))]
    atoms = spark.createDataFrame(rows, "doc_id long, ord long, metric int, polarity string, signature array<string>, vec array<double>")
    assert {(r.member, r.rep) for r in gr.near_duplicate_groups(atoms, 0.9).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_signed_duplicates_of_odd_vectors_and_ids_equal_their_sql(spark, tmp_path):
    far = 9_007_199_254_740_000  # doubles no longer tell ids apart
    vectors = {1: [1.0, 0.0], 13: [1.0, 0.0], 25: [float("nan"), 1.0], 37: [float("inf"), 1.0], 7: None, 19: [0.0, 0.0], 31: [None, 1.0], 43: [1.0, 0.1], 3: [1.0, 0.0]}
    rows = [(i + k, v, 3) for i, v in vectors.items() for k in (0, 300, far * 4)] + [(13, [1.0, 0.0], 3), (13, [-1.0, 0.0], 4), (301, [0.0, 0.0], 3), (501, None, 3)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    for name, columns in (("signed_duplicate_groups", "doc_id, member, rep"), ("blocked_duplicates", "doc_id, blocked")):
        with duckdb.connect() as c:
            c.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
            want = c.execute(f"select {columns} from ({e.oracle_sql()[name]}) order by all").fetchall()
        got = e.queries()[name](spark, folder).select(*columns.split(", "))
        assert sorted(tuple(r) for r in got.collect()) == want
        if name == "signed_duplicate_groups":
            assert (0, 13, 1) in want and (0, 25, 25) in want and (10, 501, 501) in want

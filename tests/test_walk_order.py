"""Levels of a walk meet only the nodes that are left."""

from tallyproof.operators import graph as gr


def test_finished_components_stay_out_of_further_levels(spark, monkeypatch):
    nodes = spark.createDataFrame([(d, "a", "a") for d in range(200)] + [(999, "a", n) for n in "abcdef"], "doc_id long, component string, node string")
    steps = spark.createDataFrame([(999, a, b) for a, b in zip("abcde", "bcdef")] + [(999, "a", "c"), (999, "f", "a")], "doc_id long, node string, next string")
    starts = nodes.filter("node = 'a'").select("doc_id", "node")
    written, stored = [], gr.stored

    def counted(df):
        out = stored(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(gr, "stored", counted)
    got = sorted(tuple(r) for r in gr.walk_order(steps, starts, nodes).select("doc_id", "node", "rank").collect())
    assert got == [*((d, "a", 1) for d in range(200)), *((999, n, k) for n, k in zip("abcdef", (1, 2, 3, 4, 5, 6)))]
    assert sum(written) < 300

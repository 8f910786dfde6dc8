"""Look-up of quotes in chunks: wanted keys carried to the chunks, dealt in a join, or both by document."""

from tallyproof.operators import graph as gr

CHUNKS = [(1, 1, "매출액은 100억원이다. 끝"), (1, 2, "a b c d e"), (1, 3, "영업이익 2,345 그리고 끝"), (2, 1, "b c"), (2, 2, "x b c\ny"), (2, 3, None)]
ASKS = [(1, 1, "100억원"), (1, 2, "a b c d"), (1, 3, "2,345"), (1, 4, "b c"), (1, 5, ""), (1, 6, "fehlt ganz weit weg"), (2, 1, "b c"), (2, 2, "y"), (2, 3, "x b c"), (3, 1, "b")]


def test_carried_and_dealt_keys_find_the_same(spark):
    asks = spark.createDataFrame(ASKS, "doc_id long, atom_id long, needle string")
    chunks = spark.createDataFrame(CHUNKS, "doc_id long, chunk_no int, text string")
    want = sorted((d, a, n, c) for d, a, n in ASKS for e, c, t in CHUNKS if d == e and n and t and n in t)
    for carried in (0, 3, gr.CARRIED):
        got = gr.containing_chunks(asks, chunks, carried).select("doc_id", "atom_id", "needle", "chunk_no").collect()
        assert sorted(map(tuple, got)) == want

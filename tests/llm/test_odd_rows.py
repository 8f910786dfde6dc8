"""Every operator on empty tables, clashing columns, repeated rows, very long texts; the pipeline against plain Python."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string"
LONG = "lorem ipsum dolor sit amet " * 20_000
CLASHES = ["row", "host", "path", "text_a", "node", "batch", "size", "n", "_key", "_pass", "_found", "_words", "_text", "c0", "kept_", "component", "taken_", "number", "doc_key", "line_keys", "passes", "base_all"]


def _operators():
    from tallyproof.llm.decontaminate import clean_documents, digest
    from tallyproof.llm.jaccard_join import jaccard_components, keep_one
    from tallyproof.llm.mixing import mix, mixed_documents
    from tallyproof.llm.personal_data import find_personal_data
    from tallyproof.llm.quality_rules import judge_documents, remove_frequent_lines
    from tallyproof.llm.substring_dedup import remove_repeated_windows
    from tallyproof.llm.suffix_dedup import remove_repeated_strings
    from tallyproof.llm.token_file import round_trip
    from tallyproof.llm.tokens import token_counts
    from tallyproof.llm.url_filters import judge_urls

    bench = lambda d: d.sparkSession.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet")], "item_id long, text string")
    labels = lambda d: d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")

    def urls(d):
        names = [n for n in d.columns if n not in ("doc_id", "text")]
        return judge_urls(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.co.uk/"), F.length("text")).alias("url"), *names), labels(d)).withColumnRenamed("page_id", "doc_id")

    return {
        "op1": (remove_repeated_strings, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]), "op2": (jaccard_components, ["n_shingles", "component_id"]), "op2 keep": (keep_one, ["text"]),
        "op3": (token_counts, ["n_tokens"]), "op4": (round_trip, ["start", "n_tokens", "ids_crc32"]), "op5": (mix, ["size", "taken"]), "op5 mixed": (mixed_documents, ["text"]),
        "op6": (remove_repeated_windows, ["n_removed", "kept_sha256"]), "op7": (judge_documents, ["n_words", "n_repeat_words", "kept"]), "op7 clean": (remove_frequent_lines, ["text"]), "op8": (urls, ["host", "path", "rule", "verdict"]),
        "op9": (find_personal_data, ["base_sha256", "spans"]), "op10": (lambda d: digest(d, bench(d)), ["n_words", "n_hit", "contaminated"]), "op10 clean": (lambda d: clean_documents(d, bench(d)), ["text"]),
    }


NAMES = ["op1", "op2", "op2 keep", "op3", "op4", "op5", "op5 mixed", "op6", "op7", "op7 clean", "op8", "op9", "op10", "op10 clean"]


def _odd_docs(spark):
    rows = [(1, None, "a"), (2, "", None), (3, " \n", "a"), (4, LONG, "a"), (5, "one a@b.co 1.2.3.4", "b"), (5, "one a@b.co 1.2.3.4", "b"), (5, "another text under the same id", "b"), (None, "no id", "b")]
    rows += [(i, " ".join(f"w{j % 7}{i}" for j in range(80)), "ab"[i % 2]) for i in range(10, 16)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    operator, results = _operators()[name]
    assert operator(spark.createDataFrame([], DOCS)).select(*results).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(spark, name):
    """Nulls, empty and very long texts, repeated rows and shared ids come along."""
    operator, results = _operators()[name]
    docs = _odd_docs(spark)
    wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    key = lambda r: tuple(map(repr, r))
    plain = sorted(operator(docs).select("doc_id", *results).collect(), key=key)
    got = operator(wide)
    assert sorted(got.select("doc_id", *results).collect(), key=key) == plain
    for c in set(CLASHES) & set(got.columns):
        if c not in results:
            assert {r[0] for r in got.select(f"`{c}`").collect()} <= {f"own {c}"}


def test_bad_hosts_are_blocked_and_thin_ones_shrink(spark):
    from tallyproof.llm.url_filters import bare_host, domain_of, host_reputation, page_outcomes, suffix_of

    pages = [(i, f"http://good.example.com/{i}") for i in range(300)] + [(1000 + i, f"http://bad.example.org/{i}") for i in range(200)] + [(5000, "http://thin.example.com/"), (5001, "http://new.example.com/"), (5002, "http://user@x.bad.example.org:8080/")]
    labels = [(i, int(i % 10 > 0), 0) for i in range(300)] + [(1000 + i, int(i % 10 == 0), 0) for i in range(200)] + [(5000, 0, 0)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    o = page_outcomes(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    hosts = spark.createDataFrame([("good.example.com",), ("bad.example.org",), ("thin.example.com",), ("new.example.com",), ("user@x.bad.example.org:8080",)], "host string")
    got = {r.host: (r.rate, r.bound) for r in host_reputation(o, hosts).collect()}
    assert got["good.example.com"][1] > 0.8 and got["bad.example.org"][1] < 0.2
    assert got["thin.example.com"][0] > 0.3 and got["new.example.com"][0] > got["thin.example.com"][0]
    assert got["user@x.bad.example.org:8080"][0] < 0.5
    names = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk:80",), ("1.2.3.4",), ("me@x.y.com.",)], "h string").select(domain_of(bare_host(F.col("h"))).alias("d"), suffix_of(bare_host(F.col("h"))).alias("s")).collect()
    assert [tuple(r) for r in names] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("1.2.3.4", "1.2.3.4"), ("y.com", "com")]


def test_a_depleted_document_is_rejected(spark):
    from tallyproof.llm.quality_rules import judge_documents

    line = "this very line stands in many documents of the host and says nothing at all"
    letters = lambda k: chr(97 + k // 26 % 26) + chr(97 + k % 26)
    own = lambda i, n: " ".join(f"own{letters(i)}x{letters(j)}" for j in range(n))  # noqa: E731  (digits all count as 0)
    rows = [(i, f"{own(i, 60)}\n{line}", "h") for i in range(8)] + [(100, "\n".join([line] * 5) + "\n" + own(100, 40), "h"), (101, own(101, 60), "h"), (102, f"{own(102, 60)}\n{line}", "other")]
    got = {r.doc_id: (r.kept, r.n_line_words) for r in judge_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[100] == (False, 75) and got[101] == (True, 0) and got[102] == (True, 0) and got[0] == (True, 15)


# ------------------------------------------------------------------ pipeline


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _shingles(text):
    w = [x.lower() for x in _words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline as cp
    from tallyproof.llm.tokens import vocabulary_path
    from tokenizers import Tokenizer

    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    fresh = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "ly", "ing"]) for _ in range(n))
    line = "common line number 7 that every page of this host repeats below its text"
    rows = [(i, fresh(90) + (f"\n{line}" if i % 2 else ""), "h" if i % 3 else "g") for i in range(1, 41)]
    rows += [(50, rows[0][1], "h"), (51, rows[1][1].replace(" ", "  ", 3), "h"), (52, "too short", "h"), (53, "same words again " * 40, "h"), (54, None, "h"), (55, "\n".join([line] * 6) + " " + fresh(20), "h")]
    item = fresh(12)
    rows += [(60, fresh(60) + " " + item.upper() + " " + fresh(30), "g"), (61, fresh(80), "h")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Quality: base rules, then lines in more than 5 documents and 5 % of a host.
    norm = lambda x: re.sub("[0-9]", "0", " ".join(_words(x.lower())))
    holders, texts = {}, {}
    for _, t, h in rows:
        if t is not None:
            texts.setdefault(h, set()).add(t)
            for x in t.split("\n"):
                if norm(x):
                    holders.setdefault((h, norm(x)), set()).add(t)
    hot = {k for k, v in holders.items() if len(v) > 5 and 100 * len(v) > 5 * len(texts[k[0]])}
    assert hot
    docs = []
    for d, t, h in rows:
        w = _words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 3)}
        lost = sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if (h, norm(x)) in hot)
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 100 * (len(w) - lost) >= 50 * len(w):
            docs.append((d, "\n".join(x for x in t.split("\n") if (h, norm(x)) not in hot), h))
    stage = cp.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(map(tuple, stage.collect())) == sorted(docs)

    # Near duplicates: the smallest id of each component.
    sets, label = {d: _shingles(t) for d, t, _ in docs}, {d: d for d, _, _ in docs}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    docs = [r for r in docs if label[r[0]] == r[0]]
    assert len(docs) < len(label)

    # Benchmark: documents with a window of ten words of an item go.
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(plain(item)[i : i + 10]) for i in range(len(plain(item)) - 9)}
    clean = [r for r in docs if not windows & {tuple(plain(r[1])[i : i + 10]) for i in range(len(plain(r[1])) - 9)}]
    assert 60 not in {r[0] for r in clean} and len(clean) == len(docs) - 1
    for _, f in cp.STAGES[:3][1:]:
        stage = f(spark, stage, str(tmp_path))
    assert sorted(map(tuple, stage.collect())) == sorted(clean)

    # Mixture and file: each document at most three times; what is written is what the library encodes.
    mixed = cp.STAGES[3][1](spark, stage, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= {r[0] for r in clean}
    tokenizer = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    got = cp.run(spark, str(tmp_path)).collect()
    want = sorted((r.doc_id, zlib.crc32(np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixed)
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_items_without_ids_hit_words_and_no_benchmark_hits_nothing(spark):
    from tallyproof.llm.decontaminate import clean_documents, digest

    docs = spark.createDataFrame([(1, "some words before a b c d e f g h i j and after"), (2, "None of it")], "doc_id long, text string")
    items = [(None, "a b c d e f g h i j"), ("None", "none of it"), ("x", "a b c d e f g h i j k")]
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in digest(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {1: (10, 1, True), 2: (3, 1, True)}
    none = spark.createDataFrame([], "item_id string, text string")
    assert {(r.n_hit, r.n_items, r.contaminated) for r in digest(docs, none).collect()} == {(0, 0, False)} and clean_documents(docs, none).count() == 2


def test_a_shard_is_cut_into_pieces(spark):
    from tallyproof.llm.mixing import Mix, mixed_documents

    docs = spark.createDataFrame([(i, f"text {i} " * 40, "abc"[i % 3]) for i in range(300)], DOCS)
    rows = lambda cfg: sorted(map(tuple, mixed_documents(docs, cfg, "shard").collect()))
    whole, cut = Mix(), Mix(part_bytes=300)
    assert rows(cut) == rows(whole)
    assert mixed_documents(docs, cut).rdd.getNumPartitions() > mixed_documents(docs, whole).rdd.getNumPartitions()


def test_pipeline_on_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{j}" for j in range(80)), "h") for i in range(12)] + [(50, None, None), (51, "", "h")], DOCS)
    for name, table in (("empty", docs.limit(0)), ("plain", docs), ("wide", docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    run = lambda name: sorted(tuple(r) for r in cp.run(spark, f"{tmp_path}/{name}").select("doc_id", "n_tokens", "ids_crc32").collect())
    assert run("empty") == [] and run("plain") == run("wide") and run("plain")


def test_a_single_block_is_coded(spark):
    from tallyproof.llm.token_codec import decode_blocks, encode_blocks

    for n in (0, 1, 5, 300):
        ids = np.arange(n, dtype=np.uint32) % 7 * 1000
        assert [x.tolist() for x in decode_blocks(encode_blocks([ids]), [n])] == [ids.tolist()]


def test_texts_stay_out_of_the_join_of_verdicts(spark):
    """op7: where the frequent lines do not fit a broadcast, the rows that meet them carry no text."""
    from tallyproof.llm.quality_rules import judge_documents

    docs = spark.createDataFrame([(i, f"line {i}\nsame for all", "s") for i in range(20)], "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = judge_documents(docs).select("doc_id", "n_words", "kept")._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sides = [n for n in plan.toString().split("Join LeftOuter")[1:]]
    join = plan
    while not join.nodeName().startswith("Join"):
        join = join.children().apply(0)
    left = join.children().apply(0).output().mkString(",") if hasattr(join.children().apply(0).output(), "mkString") else str(join.children().apply(0).output())
    assert sides and "text#" not in left and "r1#" not in left and "row#" not in left

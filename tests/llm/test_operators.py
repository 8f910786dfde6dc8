"""The corpus operators on small fixtures: brute force, round trips, odd rows (null, empty, ties, repeats, long)."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string"
LONG = "ab cd. " * 20000


def _docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _texts(seed=1, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        out.append(t + (" " + shared if i % 3 == 0 else "") + ("\n" if i % 4 == 0 else ""))
    return out + [out[3], out[3]]


ROWS = [(i, t) for i, t in enumerate(_texts())] + [(900, None), (901, ""), (902, " \n\t"), (None, "alone é 日本"), (903, LONG)]


def test_suffix_dedup_against_brute_force(spark):
    from tallyproof.llm.suffix_dedup import Strings, remove_repeated_strings
    from tallyproof.llm.winnow import Sizes

    rows = ROWS + [(904, "a" * 500)]
    seen, want = set(), {}
    for doc, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            gone[i : i + 100] |= s in seen
            seen.add(s)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want[doc] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest())
    for crowd in (3000, 2):
        got = remove_repeated_strings(_docs(spark, rows), Strings(sizes=Sizes(4000, 40000, crowd))).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_substring_dedup_against_brute_force(spark):
    from tallyproof.llm.substring_dedup import WordWindows, remove_repeated_windows
    from tallyproof.llm.winnow import Sizes

    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in ROWS}
    count: dict = {}
    for w in words.values():
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] = count.get(tuple(w[i : i + 35]), 0) + 1
    want = {}
    for k, w in words.items():
        gone = {p for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        want[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    got = remove_repeated_windows(_docs(spark, ROWS), WordWindows(sizes=Sizes(4000, 40000))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_window_questions_over_lots_of_batches(spark):
    """A key of every batch, contents of several batches, and a key with more contents than the limit, in lots of three."""
    from tallyproof.llm.winnow import ASK, COMPARE, CROWDED, REPEATED, answered

    pack = lambda x, kind: np.array(x, dtype=kind).tobytes()
    asked = {b: [(7, 70, 100 - b), (8, 80 + b % 2, b), (9, 900 + b, b), *([(b + 10, 5, b)] if b % 3 else [])] for b in range(10)}
    rows = [(b, 0, 0, pack([e[0] for e in x], "u8"), pack([e[1] for e in x], "u8"), pack([e[2] for e in x], "i8"), b"", b"") for b, x in asked.items()]
    for ordered in (True, False):
        want = {}
        for batch, x in asked.items():
            codes = []
            for key, content, doc in x:
                same = sorted((d if ordered else 0, b) for b, y in asked.items() for k, c, d in y if (k, c) == (key, content))
                kinds = len({c for y in asked.values() for k, c, _ in y if k == key})
                first = same[0][1] == batch
                code = REPEATED if (not first if ordered else len(same) > 1) else 0
                codes.append(code | (0 if not first or kinds == 1 else COMPARE if kinds <= 4 else CROWDED))
            want[batch] = codes
        got = answered(spark.createDataFrame(rows, ASK).repartition(4), ordered, 4, 3).collect()
        assert {r.batch: list(r.codes) for r in got} == want
        assert not answered(spark.createDataFrame([], ASK), ordered, 4, 3).collect()


def test_one_passage_in_every_document(spark):
    """Repeats around a passage that all documents share, in many batches and lots, below and above the limit of contents."""
    from tallyproof.llm.substring_dedup import WordWindows, remove_repeated_windows
    from tallyproof.llm.suffix_dedup import Strings, remove_repeated_strings
    from tallyproof.llm.winnow import Sizes

    rng = random.Random(5)
    passage = " ".join(f"licence{i}" for i in range(50))
    rows = [(i, " ".join(f"w{rng.randint(0, 9)}" for _ in range(30)) + f" {passage} " + " ".join(f"v{rng.randint(0, 9)}" for _ in range(30))) for i in range(80)]
    count: dict = {}
    words = {i: t.split() for i, t in rows}
    for w in words.values():
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] = count.get(tuple(w[i : i + 35]), 0) + 1
    gone = {k: len({p for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}) for k, w in words.items()}
    seen, cut = set(), {}
    for doc, text in rows:
        at = set()
        for i in range(len(text) - 99):
            if text[i : i + 100] in seen:
                at.update(range(i, i + 100))
            seen.add(text[i : i + 100])
        cut[doc] = len(at)
    for crowd in (3000, 2):
        sizes = Sizes(1000, 20000, crowd)
        assert {r.doc_id: r.n_removed for r in remove_repeated_windows(_docs(spark, rows), WordWindows(sizes=sizes)).collect()} == gone
        assert {r.doc_id: r.n_removed for r in remove_repeated_strings(_docs(spark, rows), Strings(sizes=sizes)).collect()} == cut


def _linked(rows):
    """doc_id -> (shingles, component) by comparing all pairs."""
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= 75 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_jaccard_components_against_brute_force(spark):
    from tallyproof.llm.jaccard_join import Shingles, jaccard_components
    from tallyproof.llm.winnow import Sizes

    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a  B"), (5, "a b c d e"), (6, LONG)]
    for i in range(12):
        base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice((6, 20, 90)))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "x" + str(rng.randint(0, 9))
            rows.append((10 + len(rows), " ".join(copy)))
    got = jaccard_components(_docs(spark, rows), Shingles(crowd=3, sizes=Sizes(3000, 30000))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _linked(rows)


def test_jaccard_components_of_one_passage_in_all_texts(spark):
    """Texts around passages that most of them share, few of them similar: large groups of several components."""
    from tallyproof.llm.jaccard_join import Shingles, jaccard_components
    from tallyproof.llm.winnow import Sizes

    rng = random.Random(5)
    passage, other = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(30)]
    rows = []
    for i in range(60):
        own = [f"w{rng.randint(0, 40)}" for _ in range(rng.choice((0, 4, 8, 12, 20)))]
        middle = rng.choice((passage, passage[:40] + other, passage[20:] + other, other + passage))
        at = rng.choice((0, 0, len(own)))
        rows.append((i + 1, " ".join([*own[:at], *middle, *own[at:]])))
    want = _linked(rows)
    assert 5 < len({c for _, c in want.values()}) < 55
    got = jaccard_components(_docs(spark, rows), Shingles(crowd=2, sizes=Sizes(3000, 30000))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def _tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(places.path("word_bpe_49k.json"))


ODD = ["I'm we'll x's", "<|endoftext|>a<|endoftext|> B <|STARTOFTEXT|>", "ΟΔΟΣ Σ", "İstanbul", "\x1ca\x1fb c\x85d\xa0e", "日本語 🙂🙂 ab1234 ½²", "Å ﬁ _a_b__", "\x00 a\x01b"]


def test_token_counts_and_files_match_the_library(spark):
    from tallyproof.llm.token_file import TokenFile, round_trip
    from tallyproof.llm.tokens import token_counts

    t = _tokenizer()
    rows = [(i, x) for i, x in enumerate(ODD)] + [(100 + i if i is not None else None, x) for i, x in ROWS]
    ids = {k: t.encode(x or "", add_special_tokens=False).ids for k, x in rows}
    counted = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(_docs(spark, rows)).collect()}
    assert counted == {k: (len((x or "").encode()), len(ids[k]), len(ids[k]) > 2048) for k, x in rows}
    want, start = {}, 0
    for k, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        full = [*ids[k], 2]
        want[k] = (start, len(full), zlib.crc32(np.array(full, "<u4").tobytes()))
        start += len(full)
    got = round_trip(_docs(spark, rows), TokenFile(block_ids=64, row_ids=1000)).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_codec_round_trip():
    from tallyproof.llm.token_codec import decode_blocks, encode_blocks

    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 10, 900), rng.integers(0, 60000, 300), np.zeros(0, int), np.array([2**30 - 1, 0, 1, 7, 8, 15, 16]), rng.zipf(1.5, 500) % 49000]
    # A long repeat takes all weight from order 0 before a surprise.
    blocks += [np.concatenate([np.tile([5, 70, 900, 31_000], 500), rng.integers(0, 49_000, 200)]), np.full(4000, 3)]
    payloads = encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decode_blocks(payloads, [len(b) for b in blocks])))
    assert len(payloads[0]) < 900


def test_codec_beats_deflate_on_text_ids():
    """Blocks of equal size: skewed ids that often follow what followed before."""
    from tallyproof.llm.token_codec import encode_blocks

    rng = np.random.default_rng(1)
    blocks = []
    for _ in range(8):
        phrases = [rng.zipf(1.3, rng.integers(2, 9)) % 40_000 for _ in range(120)]
        blocks.append(np.concatenate([phrases[i] for i in rng.zipf(1.3, 900) % 120])[:2048])
    deflated = sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    assert sum(map(len, encode_blocks(blocks))) < 0.92 * deflated


def test_mix_meets_its_targets(spark):
    from tallyproof.llm.mixing import mix, mixed_documents

    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice(["a", "b", "c", None, "d"])) for i in range(300)] + [(500, None, "e"), (500, "x y", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6 for r in got)
    for source in {r.source for r in got}:
        of = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 2
    assert sorted(map(tuple, mix(docs).select("doc_id", "size", "taken").collect())) == sorted((r.doc_id, r.size, r.taken) for r in got)
    assert mixed_documents(docs).columns == docs.columns
    assert mix(docs.limit(0)).count() == 0


def test_quality_rules(spark):
    from tallyproof.llm.quality_rules import judge_documents, remove_frequent_lines

    letters = "abcdefghijklmnopqrst"
    good = [" ".join(letters[i // 20] + letters[i % 20] + letters[j // 20] + letters[j % 20] for j in range(70)) for i in range(60)]
    rows = [(i, t + "\nSHARED line 7", "h") for i, t in enumerate(good)] + [(90, None, "h"), (91, "", None), (92, "a b c " * 40, "h"), (93, LONG, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in judge_documents(docs).collect()}
    assert got[0].kept and got[0].n_line_words == 3 and got[0].n_repeat_words == 0
    assert got[90].base_failed and got[91].n_words == 0 and got[92].n_repeat_words == 120 and not got[93].kept
    assert {r.text for r in remove_frequent_lines(docs).collect()} == set(good)


def test_quality_rules_judge_each_copy_by_its_own_words(spark):
    from tallyproof.llm.quality_rules import judge_documents, remove_frequent_lines

    texts = [" ".join(f"w{chr(97 + i)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(70)) for i in range(8)]
    boiler = "\nall rights reserved by us\nall rights reserved by us"
    rows = [(i, t + boiler, "h") for i, t in enumerate(texts)] + [(100 + i, texts[0] + boiler, "h") for i in range(39)] + [(200, texts[0] + boiler, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept, r.n_line_words, r.n_line_docs) for r in judge_documents(docs).collect()}
    assert got == {k: (True, 10, 8) if host else (True, 0, 0) for k, _, host in rows}
    cleaned = {r.doc_id: r.text for r in remove_frequent_lines(docs).collect()}
    assert cleaned == {k: t.removesuffix(boiler) if host else t for k, t, host in rows}


def test_urls(spark):
    from tallyproof.llm.url_filters import judge_urls

    urls = ["http://A.Example.net/en/1?x", "https://example.net/de/", "http://x.example.com/de/a#b", "http://org/fr/", "http://net", "nothing", None, "http://h.q/?://z/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in judge_urls(pages, labels).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/"), 1: ("example.net", "/de/", "net/"), 2: ("x.example.com", "/de/a", "example.com/de/"), 3: ("org", "/fr/", "org/fr/"),
        4: ("net", "", None), 5: ("", "", None), 6: ("", "", None), 7: ("h.q", "/", None),
    }


def test_personal_data_base_against_brute_force(spark):
    from tallyproof.llm.personal_data import find_personal_data

    texts = [None, "", "a@b.c_d@e.f x", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111 1111 1111x4111-1111-1111-1111", "9" * 5000, "a" * 5000, "+1 (123) 555-1234 +12345678901234567", "🙂 a@b.co 1.2.3.4"]
    want = {2: "email:0:5,email:5:11", 3: "email:0:5", 9: "email:2:8,ip:9:16", 5: "card:0:19,card:20:39"}
    got = {r.doc_id: r for r in find_personal_data(_docs(spark, list(enumerate(texts)))).collect()}
    for k, spans in want.items():
        assert got[k].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert got[0].n_email == 0 and got[8].n_phone == 1 and got[6].n_card == 0 and got[4].n_ip == 2


def test_personal_data_hints_hide_no_span(spark):
    from tallyproof.llm.personal_data import cell_counts, find_personal_data

    texts = ["call +1 2 3 4 5 6 7 8 9 now", "+4-9-1-5-1-2-3-4-5", "write to jane at example.com"]
    docs = _docs(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_phone, r.base_sha256) for r in find_personal_data(docs).collect()}
    assert got == {k: (n, hashlib.sha256(spans.encode()).hexdigest()) for k, n, spans in [(0, 1, "phone:5:23"), (1, 1, "phone:0:18"), (2, 0, "")]}
    assert sum(n for cell, n in cell_counts(docs).items() if cell.startswith("email|0|")) == 1


def test_decontamination(spark):
    from tallyproof.llm.decontaminate import Windows, clean_documents, contaminated_spans, digest

    item = "One two, three four five six seven eight nine ten eleven"
    docs = _docs(spark, [(1, "Start. " + item.upper() + " end"), (2, "one two three"), (3, None), (4, "short item!"), (5, "clean")])
    bench = spark.createDataFrame([(7, item), (8, "Short   ITEM"), (9, None), (10, "")], "item_id long, text string")
    for block in (16_000_000, 30):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in digest(docs, bench, Windows(block_bytes=block)).collect()}
        assert got == {1: (13, 11, 1, True), 2: (3, 0, 0, False), 3: (0, 0, 0, False), 4: (2, 2, 1, True), 5: (1, 0, 0, False)}
    assert [tuple(r) for r in contaminated_spans(docs, bench).filter("doc_id = 1").collect()] == [(1, 7, 7 + len(item))]
    assert sorted(r.doc_id for r in clean_documents(docs, bench).collect()) == [2, 3, 5]

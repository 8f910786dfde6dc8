"""Exact search for repeated fixed-length windows over a whole corpus, by questions and answers between batches.

Documents are dealt into batches of about a megabyte. A batch cuts its windows into segments: runs of windows whose
least k-gram hash (the leftmost one) stands at the same place. Equal windows have equal least k-grams, so they lie in
segments with equal keys, wherever they are. Each batch asks once for each distinct (key, content) it holds; the
bucket of a key answers whether the content has occurred before and whether the key has other contents. Only the
latter segments need their windows compared, which is a small part of a corpus. Questions travel as packed arrays: a
common key or content is one entry a batch. Batches are salted into lots; a lot asks its bucket once for each of its
pairs, so that a key of every batch is one entry a lot there, and no task collects the batches of the corpus.

A document's text is shuffled once, to its batch; the three passes over the batches share that exchange.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyproof.llm.common import RollingHash, mixed, total_bytes

#: Answer bits: all windows of the content occur elsewhere (before, if ordered); compare by segment; compare by window.
REPEATED, COMPARE, CROWDED = 1, 2, 4

ASK = "batch long, bucket long, kind int, keys binary, contents binary, docs binary, sizes binary, bytes binary"
ANSWER = "batch long, bucket long, kind int, codes binary"
LOT = "bucket long, lot long, keys binary, contents binary, docs binary, many binary"
LOT_ANSWER = "bucket long, lot long, codes binary"
ASK_SCHEMA = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("keys", "contents", "docs", "sizes", "bytes"))])
ANSWER_SCHEMA = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("codes", pa.binary())])
LOT_SCHEMA = pa.schema([("bucket", pa.int64()), ("lot", pa.int64()), *((n, pa.binary()) for n in ("keys", "contents", "docs", "many"))])
LOT_ANSWER_SCHEMA = pa.schema([("bucket", pa.int64()), ("lot", pa.int64()), ("codes", pa.binary())])


@dataclass(frozen=True)
class Sizes:
    """batch, bucket: bytes of text in a batch and behind a bucket; their numbers grow with the data. crowd: a key with
    more distinct contents is compared window by window, where equal windows of a batch are one entry, instead of
    segment by segment in one task."""

    batch: int = 1 << 20
    bucket: int = 32 << 20
    crowd: int = 3000


def batched(docs: DataFrame, sizes: Sizes = Sizes()) -> tuple[DataFrame, int, int]:
    """doc_id, text, batch; the number of buckets, and of batches in a lot. Batches are dealt by doc_id and text, so that
    neither a common nor a null doc_id fills one. Lots grow with the batches to the power 2/3, their number to the power
    1/3: a key of every batch is few entries in a lot, and fewer in its bucket, beside the others there."""
    n = total_bytes(docs)
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    batches = n // sizes.batch + 1
    return docs.select("doc_id", "text", F.pmod(key, F.lit(batches)).alias("batch")), n // sizes.bucket + 1, math.ceil(batches ** (2 / 3))


@dataclass
class Documents:
    """A batch's documents by doc_id (null first), then text: ids, order keys, and texts as UTF-8 one after another."""

    ids: list
    order: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, separator: bytes = b"") -> "Documents":
        ids = table.column("doc_id").to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        least = np.iinfo(np.int64).min
        keys = [least if i is None else i for i in ids]
        by = sorted(range(len(ids)), key=lambda i: (keys[i], texts[i]))
        lengths = np.array([len(texts[i]) + len(separator) for i in by], dtype=np.int64)
        ends = np.cumsum(lengths)
        data = b"".join(x for i in by for x in (texts[i], separator))
        return cls([ids[i] for i in by], np.array([keys[i] for i in by], dtype=np.int64), data, ends - lengths, ends - len(separator))


@dataclass
class Segments:
    """starts: of the first window; counts: windows; keys: least k-gram hash. Units may be bytes or words."""

    starts: np.ndarray
    counts: np.ndarray
    keys: np.ndarray


_PLACE = np.uint64((1 << 24) - 1)


def cut(roll: RollingHash, starts: np.ndarray, ends: np.ndarray, window: int, k: int) -> Segments:
    """Segments of all windows that lie inside one of the ranges [start, end)."""
    n = len(roll.sums) - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = np.zeros(n + 2, dtype=np.int32)
    long = ends - starts >= window
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, ends[long] - window + 1, -1)
    valid = np.cumsum(edges)[:n] > 0
    grams = window - k + 1
    step = 1 << 23
    for lo in range(0, max(0, n - window + 1), step):
        hi = min(lo + step, n - window + 1)
        at = np.arange(lo, hi + grams - 1)
        hashes = mixed(roll.of(at, at + k))
        least = (hashes & ~_PLACE) | (at - lo).astype(np.uint64)
        span = 1
        while span * 2 <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: hi - lo], least[grams - span : grams - span + hi - lo])
        place = (least & _PLACE).astype(np.int64)
        inside = valid[lo:hi]
        same = np.zeros(hi - lo + 1, dtype=bool)
        same[1:-1] = (place[1:] == place[:-1]) & inside[1:] & inside[:-1]
        first = np.flatnonzero(inside & ~same[:-1])
        last = np.flatnonzero(inside & ~same[1:])
        found.append((first + lo, last - first + 1, hashes[place[first]]))
    if not found:
        return Segments(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Segments(*(np.concatenate(x) for x in zip(*found)))


class Questions:
    """The distinct (key, content) pairs of a batch, by bucket, and which item asks which."""

    def __init__(self, keys: np.ndarray, contents: np.ndarray, buckets: int):
        by = np.lexsort((contents, keys))
        k, c = keys[by], contents[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        group = np.cumsum(new) - 1
        first = by[new]  # lexsort is stable: the earliest item
        bucket = (keys[first] % np.uint64(buckets)).astype(np.int64)
        deal = np.lexsort((first, bucket))
        spot = np.empty(len(first), dtype=np.int64)
        spot[deal] = np.arange(len(first))
        self.first, self.bucket = first[deal], bucket[deal]
        self.of_item = np.empty(len(by), dtype=np.int64)
        self.of_item[by] = spot[group]
        self.asked = np.bincount(self.of_item, minlength=len(first)) if len(by) else np.zeros(0, np.int64)
        self.leads = np.zeros(len(keys), dtype=bool)
        self.leads[self.first] = True

    def parts(self):
        """(bucket, slice of the entries) of each bucket asked."""
        at = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(at, [*at[1:], len(self.bucket)]):
            yield int(self.bucket[a]), slice(a, b)

    def gather(self, answers: dict[int, bytes]) -> np.ndarray:
        """The entries' codes from the buckets' answers."""
        out = np.zeros(len(self.first), dtype=np.uint8)
        for bucket, part in self.parts():
            out[part] = np.frombuffer(answers[bucket], dtype=np.uint8)
        return out


def ask_rows(batch: int, kind: int, q: Questions, keys: np.ndarray, contents: np.ndarray, docs: np.ndarray | None) -> list[dict]:
    return [
        {
            "batch": batch, "bucket": bucket, "kind": kind, "keys": keys[q.first[part]].tobytes(), "contents": contents[q.first[part]].tobytes(),
            "docs": b"" if docs is None else docs[q.first[part]].tobytes(), "sizes": b"", "bytes": b"",
        }
        for bucket, part in q.parts()
    ]


@dataclass
class _Pairs:
    """Entries by key, content, document and asker (batch or lot): the order, and which stand first of a key or pair."""

    by: np.ndarray
    new_key: np.ndarray
    new: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, contents: np.ndarray, docs: np.ndarray, askers: np.ndarray) -> "_Pairs":
        by = np.lexsort((askers, docs, contents, keys))  # which batch is asked for its windows must not hang on arrival
        k, c = keys[by], contents[by]
        new_key = np.ones(len(by), dtype=bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key.copy()
        new[1:] |= c[1:] != c[:-1]
        return cls(by, new_key, new)


def _entries(table: pa.Table, asker: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Keys, contents, documents (0 where order doesn't count) and askers of the entries; and the entries of each row."""
    rows = {n: table.column(n).to_pylist() for n in (asker, "keys", "contents", "docs")}
    lengths = [len(x) // 8 for x in rows["keys"]]
    keys, contents = (np.frombuffer(b"".join(rows[n]), dtype=np.uint64) for n in ("keys", "contents"))
    docs = np.frombuffer(b"".join(rows["docs"]), dtype=np.int64)
    askers = np.repeat(np.array(rows[asker], dtype=np.int64), lengths)
    return keys, contents, docs if len(docs) else np.zeros(len(keys), np.int64), askers, lengths


def lot_questions(table: pa.Table) -> pa.Table:
    """A lot's question row: its distinct (key, content) pairs with their first document, and whether several batches ask."""
    keys, contents, docs, batch, _ = _entries(table, "batch")
    pairs = _Pairs.of(keys, contents, docs, batch)
    first = pairs.by[pairs.new]
    many = np.diff([*np.flatnonzero(pairs.new), len(pairs.by)]) > 1
    row = {"bucket": table.column("bucket")[0].as_py(), "lot": table.column("lot")[0].as_py(), "keys": keys[first].tobytes(), "contents": contents[first].tobytes(), "docs": docs[first].tobytes(), "many": many.tobytes()}
    return pa.Table.from_pylist([row], schema=LOT_SCHEMA)


def bucket_answers(table: pa.Table, ordered: bool, crowd: int) -> pa.Table:
    """Codes of a bucket's lots, in the order of each lot's pairs."""
    keys, contents, docs, lot, lengths = _entries(table, "lot")
    many = np.frombuffer(b"".join(table.column("many").to_pylist()), dtype=bool)
    pairs = _Pairs.of(keys, contents, docs, lot)
    group = np.cumsum(pairs.new_key) - 1
    kinds = np.bincount(group, weights=pairs.new).astype(np.int64)[group]
    codes = np.where(pairs.new, 0, REPEATED).astype(np.uint8)
    if not ordered:
        item = np.cumsum(pairs.new) - 1
        codes[np.bincount(item, weights=1 + many[pairs.by])[item] > 1] = REPEATED
    codes[pairs.new & (kinds > 1) & (kinds <= crowd)] |= COMPARE
    codes[pairs.new & (kinds > crowd)] |= CROWDED
    out = np.empty(len(codes), dtype=np.uint8)
    out[pairs.by] = codes
    ends = np.cumsum(lengths)
    rows = [{"bucket": b, "lot": t, "codes": out[e - n : e].tobytes()} for b, t, n, e in zip(table.column("bucket").to_pylist(), table.column("lot").to_pylist(), lengths, ends)]
    return pa.Table.from_pylist(rows, schema=LOT_ANSWER_SCHEMA)


def batch_answers(table: pa.Table, of_lot: pa.Table) -> pa.Table:
    """Answers to a lot's question rows, in the order of each row's entries: the first entry of a pair has the lot's code,
    the others repeat it."""
    if not table.num_rows:
        return pa.Table.from_pylist([], schema=ANSWER_SCHEMA)
    keys, contents, docs, batch, lengths = _entries(table, "batch")
    pairs = _Pairs.of(keys, contents, docs, batch)
    codes = np.full(len(pairs.by), REPEATED, dtype=np.uint8)
    codes[pairs.by[pairs.new]] = np.frombuffer(of_lot.column("codes")[0].as_py(), dtype=np.uint8)
    ends = np.cumsum(lengths)
    asked = zip(*(table.column(n).to_pylist() for n in ("batch", "bucket", "kind")))
    rows = [{"batch": b, "bucket": u, "kind": t, "codes": codes[e - n : e].tobytes()} for (b, u, t), n, e in zip(asked, lengths, ends)]
    return pa.Table.from_pylist(rows, schema=ANSWER_SCHEMA)


def answered(asks: DataFrame, ordered: bool, crowd: int, lot: int) -> DataFrame:
    """Answers to question rows of one kind, lots of ``lot`` batches first. The lots' exchange of ``asks`` is used twice."""

    def reply(table: pa.Table) -> pa.Table:
        return bucket_answers(table, ordered, crowd)

    salted = asks.withColumn("lot", F.expr(f"batch div {lot}"))
    codes = salted.groupBy("bucket", "lot").applyInArrow(lot_questions, LOT).groupBy("bucket").applyInArrow(reply, LOT_ANSWER)
    return salted.groupBy("bucket", "lot").cogroup(codes.groupBy("bucket", "lot")).applyInArrow(batch_answers, ANSWER)


def answers_of(table: pa.Table) -> dict[int, dict[int, bytes]]:
    """kind -> bucket -> codes of a batch's answer rows."""
    out: dict[int, dict[int, bytes]] = {}
    for kind, bucket, codes in zip(*(table.column(n).to_pylist() for n in ("kind", "bucket", "codes"))):
        out.setdefault(kind, {})[bucket] = codes
    return out


def covered(flags: np.ndarray, window: int) -> np.ndarray:
    """Units covered by the flagged window starts."""
    marks = np.zeros(len(flags) + 1, dtype=np.int32)
    at = np.flatnonzero(flags)
    marks[at] += 1
    np.subtract.at(marks, np.minimum(at + window, len(flags)), 1)
    return np.cumsum(marks)[:-1] > 0

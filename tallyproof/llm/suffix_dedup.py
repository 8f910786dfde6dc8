"""Suffix-array dedup: bytes of strings that also start earlier in the corpus are removed.

Method: column-wise construction of a collection's suffix order. In every round one symbol of each sequence is
inserted, from its end to its start; the collection's Burrows-Wheeler transform and the common prefixes of neighbours
are rewritten in one sequential pass over their arrays. Suffixes that share a long enough prefix are neighbours at the
end, and all but the first of them in the corpus repeat it.

Rounds are as many as the longest sequence has symbols, so sequences are the segments of ``winnow``: windows with one
least k-gram, at most ``window + grams`` bytes. Equal strings lie in segments of one key, and a key's segments meet in
one task; segments whose key has no other content take no part. Keys with very many contents are compared string by
string through hashes instead, so that no task collects an unbounded group. The transform and prefix arrays of a task
stay in its memory, a few thousand sequences at a time: executors share no local disk to keep them on.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyproof.llm.common import BYTE_VALUE, RollingHash, checkpointed, mixed
from tallyproof.llm.winnow import ANSWER, ANSWER_SCHEMA, ASK, ASK_SCHEMA, COMPARE, CROWDED, REPEATED, Documents, Questions, Sizes, answered, answers_of, ask_rows, batched, covered, cut

_SECOND_RADIX = 0xC2B2AE3D27D4EB4F


@dataclass(frozen=True)
class Strings:
    """length: bytes of a string that counts as repeated; k: bytes in the sketch that segments are cut by; sequences:
    put in order at a time."""

    length: int = 100
    k: int = 32
    sequences: int = 3000
    sizes: Sizes = Sizes()


def suffix_order(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, common prefix with the row before) of every suffix, empty ones first, in sorted order.

    ``data`` holds UTF-8 bytes, so that byte + 1 fits a byte and 0 can stand for a symbol yet to come. Sequences end
    in distinct marks, below all bytes, in their order. Lengths stay below 255.
    """
    m, most = len(lengths), int(lengths.max(initial=0))
    symbols = np.zeros(m, dtype=np.uint8)
    transform = np.zeros(m, dtype=np.uint8)
    prefix = np.zeros(m + 1, dtype=np.uint8)  # one more, so that ranges may end at the end
    row_of = np.arange(m)
    for round_ in range(1, most + 1):
        active = np.flatnonzero(lengths >= round_)
        symbols = data[starts[active] + lengths[active] - round_] + np.uint8(1)
        at = row_of[active]
        transform[at] = symbols
        n = len(transform)
        order = np.argsort(transform, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        rank = place[at]
        new = rank - (m - len(active)) + m

        before = order[np.maximum(rank - 1, 0)]
        joined = (rank > 0) & (transform[before] == symbols)
        after = order[np.minimum(rank + 1, n - 1)]
        follows = (rank + 1 < n) & (transform[after] == symbols)
        up = np.zeros(len(active), dtype=np.uint8)
        down = np.zeros(len(active), dtype=np.uint8)
        if joined.any():
            up[joined] = _range_min(prefix, before[joined] + 1, at[joined] + 1) + 1
        if follows.any():
            down[follows] = _range_min(prefix, at[follows] + 1, after[follows] + 1) + 1

        total = n + len(active)
        old = np.ones(total, dtype=bool)
        old[new] = False
        longer = np.zeros(total, dtype=np.uint8)
        longer[old] = transform
        transform = longer
        longer = np.zeros(total + 1, dtype=np.uint8)
        longer[:-1][old] = prefix[:-1]
        longer[new] = up
        longer[new[follows] + 1] = down[follows]
        prefix = longer
        row_of[active] = new
    n = len(transform)
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(transform, kind="stable")] = np.arange(n)
    sequence, offset = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    row = np.arange(m)
    sequence[row], offset[row] = np.arange(m), lengths
    for back in range(1, most + 1):
        active = np.flatnonzero(lengths >= back)
        row[active] = place[row[active]]  # m rows have no symbol, m rows are empty suffixes
        sequence[row[active]], offset[row[active]] = active, lengths[active] - back
    return sequence, offset, prefix[:-1]


def _range_min(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, np.stack([starts, ends], axis=1).ravel())[::2]


def repeats(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """For every byte of ``data`` that starts a string of ``length`` inside its sequence: does an earlier sequence
    hold the string? Sequences come in corpus order and hold a string once each."""
    flags = np.zeros(len(data), dtype=bool)
    sequence, offset, prefix = suffix_order(data, starts, lengths)
    alike = prefix >= length
    group = np.cumsum(~alike)
    size = np.bincount(group)
    rows = np.flatnonzero(size[group] > 1)
    if len(rows):
        g = group[rows]
        head = np.flatnonzero(np.diff(g, prepend=-1))
        least = np.minimum.reduceat(sequence[rows], head)
        later = sequence[rows] != np.repeat(least, np.diff([*head, len(rows)]))
        flags[starts[sequence[rows[later]]] + offset[rows[later]]] = True
    return flags


class _Batch:
    """A batch's bytes, segments and first questions: the same in every pass."""

    def __init__(self, table: pa.Table, cfg: Strings, buckets: int):
        self.cfg, self.buckets = cfg, buckets
        self.docs = Documents.of(table)
        self.data = np.frombuffer(self.docs.data, dtype=np.uint8)
        values = BYTE_VALUE[self.data]
        self.roll, self.second = RollingHash(values), RollingHash(values, _SECOND_RADIX)
        self.segments = cut(self.roll, self.docs.starts, self.docs.ends, cfg.length, cfg.k)
        s = self.segments
        self.ends = s.starts + s.counts + cfg.length - 1
        self.contents = self._hash(self.second, s.starts, self.ends)
        self.questions = Questions(s.keys, self.contents, buckets)
        self.order = self.docs.order[np.searchsorted(self.docs.starts, s.starts, side="right") - 1] if len(s.starts) else np.zeros(0, np.int64)

    def _hash(self, roll: RollingHash, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(roll.of(a, b) + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def judge_segments(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each segment: all its strings are repeats; and for each entry of the questions: compare, crowded."""
        q = self.questions
        codes = q.gather(answers)
        return (codes[q.of_item] & REPEATED > 0) | ~q.leads, codes & COMPARE > 0, codes & CROWDED > 0

    def segment_rows(self, batch: int, compared: np.ndarray) -> list[dict]:
        """Question rows of kind 1: the bytes of the segments to be put in order."""
        rows, s, q = [], self.segments, self.questions
        for bucket, part in q.parts():
            chosen = q.first[part][compared[part]]
            if len(chosen):
                pieces = [self.docs.data[a:b] for a, b in zip(s.starts[chosen].tolist(), self.ends[chosen].tolist())]
                sizes = (self.ends - s.starts)[chosen].astype(np.int64)
                rows.append({"batch": batch, "bucket": bucket, "kind": 1, "keys": s.keys[chosen].tobytes(), "contents": b"", "docs": self.order[chosen].tobytes(), "sizes": sizes.tobytes(), "bytes": b"".join(pieces)})
        return rows

    def strings(self, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Questions]:
        """Starts, two hashes and order keys of the strings of crowded segments, and the questions about them."""
        chosen = self.questions.first[crowded]
        chosen.sort()
        s, n = self.segments, self.segments.counts[chosen]
        starts = np.repeat(s.starts[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
        ends = starts + self.cfg.length
        one, two = self._hash(self.roll, starts, ends), self._hash(self.second, starts, ends)
        return starts, one, two, np.repeat(self.order[chosen], n), Questions(one, two, self.buckets)


def order_segments(table: pa.Table, cfg: Strings) -> list[dict]:
    """Answers to a bucket's rows of kind 1: a byte for each string of each segment, 1 if it is a repeat."""
    rows = {n: table.column(n).to_pylist() for n in ("batch", "bucket", "keys", "docs", "sizes", "bytes")}
    if not rows["batch"]:
        return []
    keys = np.frombuffer(b"".join(rows["keys"]), dtype=np.uint64)
    sizes = np.frombuffer(b"".join(rows["sizes"]), dtype=np.int64)
    data = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
    per_row = [len(x) // 8 for x in rows["keys"]]
    batch = np.repeat(np.array(rows["batch"], dtype=np.int64), per_row)
    starts = np.cumsum(sizes) - sizes
    # By key; inside a key in corpus order: document, then batch, then place in the batch (the stable sort keeps it).
    by = np.lexsort((batch, np.frombuffer(b"".join(rows["docs"]), dtype=np.int64), keys))
    flags = np.zeros(len(data), dtype=bool)
    sorted_keys = keys[by]
    a = 0
    while a < len(by):
        b = min(a + cfg.sequences, len(by))
        b = int(np.searchsorted(sorted_keys, sorted_keys[b - 1], side="right"))  # whole keys
        take = by[a:b]
        n = sizes[take]
        where = np.repeat(starts[take] - np.cumsum(n) + n, n) + np.arange(n.sum())
        flags[where] = repeats(data[where], np.cumsum(n) - n, n, cfg.length)
        a = b
    out, at, base = [], 0, 0
    for r, n in enumerate(per_row):
        codes = []
        for k in range(at, at + n):
            codes.append(flags[starts[k] : starts[k] + sizes[k] - cfg.length + 1])
        at += n
        out.append({"batch": rows["batch"][r], "bucket": rows["bucket"][r], "kind": 1, "codes": np.concatenate(codes).astype(np.uint8).tobytes()})
    return out


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def remove_repeated_strings(docs: DataFrame, cfg: Strings = Strings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for every row of ``docs`` (doc_id, text).

    The first occurrence (smallest doc_id, then earliest start) of a string stays. Null and empty texts have no
    bytes. Null doc_ids come first; rows with equal doc_ids come in an order of their own that every run repeats.
    Other columns are ignored.
    """
    parts, buckets, lot = batched(docs, cfg.sizes)

    def ask(table: pa.Table) -> pa.Table:
        b = _Batch(table, cfg, buckets)
        return _table(ask_rows(table.column("batch")[0].as_py(), 0, b.questions, b.segments.keys, b.contents, b.order), ASK_SCHEMA)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], ASK_SCHEMA)
        b, batch = _Batch(left, cfg, buckets), left.column("batch")[0].as_py()
        _, compared, crowded = b.judge_segments(answers_of(right)[0])
        rows = b.segment_rows(batch, compared)
        if crowded.any():
            _, one, two, order, q = b.strings(crowded)
            rows += ask_rows(batch, 2, q, one, two, order)
        return _table(rows, ASK_SCHEMA)

    def compare(table: pa.Table) -> pa.Table:
        return _table(order_segments(table, cfg), ANSWER_SCHEMA)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Batch(left, cfg, buckets) if left.num_rows else None
        flags = np.zeros(len(b.data) if b else 0, dtype=bool)
        answers = answers_of(right)
        if b and 0 in answers:
            s, q = b.segments, b.questions
            repeated, compared, crowded = b.judge_segments(answers[0])
            n = s.counts[repeated]
            flags[np.repeat(s.starts[repeated] - np.cumsum(n) + n, n) + np.arange(n.sum())] = True
            for bucket, part in q.parts():
                chosen = q.first[part][compared[part]]
                if len(chosen):
                    n = s.counts[chosen]
                    at = np.repeat(s.starts[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    flags[at] = np.frombuffer(answers[1][bucket], dtype=np.uint8) > 0
            if crowded.any():
                starts, _, _, _, q = b.strings(crowded)
                flags[starts] = (q.gather(answers[2])[q.of_item] & REPEATED > 0) | ~q.leads
        gone = covered(flags, cfg.length)
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, doc in enumerate(b.docs.ids if b else []):
            a, z = int(b.docs.starts[i]), int(b.docs.ends[i])
            mask = gone[a:z]
            removed = int(mask.sum())
            kept = b.data[a:z][~mask].tobytes() if removed else b.docs.data[a:z]
            spans = int((np.diff(mask.astype(np.int8), prepend=0) > 0).sum())
            for n, v in zip(out, (doc, z - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                out[n].append(v)
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    answers = checkpointed(answered(parts.groupBy("batch").applyInArrow(ask, ASK), True, cfg.sizes.crowd, lot))
    sent = checkpointed(parts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(send, ASK))
    ordered = sent.filter("kind = 1").groupBy("bucket").applyInArrow(compare, ANSWER)
    every = answers.unionByName(ordered).unionByName(answered(sent.filter("kind = 2"), True, cfg.sizes.crowd, lot))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return parts.groupBy("batch").cogroup(every.groupBy("batch")).applyInArrow(finish, schema)

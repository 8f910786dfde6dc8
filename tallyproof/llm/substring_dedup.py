"""Substring dedup: every word that a repeated fixed-length window covers is removed, wherever it stands.

Method: Rabin-Karp hashes of every window of words; windows are counted over the corpus and repeated ones merge into
maximal removal intervals. The rolling hashes also cut windows into segments (see ``winnow``), so that a window whose
segment key occurs once is known to be single without travelling; all others are counted by Spark, as a grouped sum over
two independent 64-bit hashes, each batch adding what it holds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyproof.llm.common import RollingHash, checkpointed, mixed, word_bounds, word_hashes
from tallyproof.llm.winnow import ASK, ASK_SCHEMA, COMPARE, CROWDED, REPEATED, Documents, Questions, Sizes, answered, answers_of, ask_rows, batched, covered, cut

_SECOND_RADIX = 0xC2B2AE3D27D4EB4F
_COUNT = "batch long, one long, two long, n long"
_COUNT_SCHEMA = pa.schema([(n, pa.int64()) for n in ("batch", "one", "two", "n")])


@dataclass(frozen=True)
class WordWindows:
    """words: length of a window; k: words in the sketch that segments are cut by."""

    words: int = 35
    k: int = 12
    sizes: Sizes = Sizes()


class _Batch:
    """A batch's words, windows, segments and its first questions: the same in every pass."""

    def __init__(self, table: pa.Table, cfg: WordWindows, buckets: int):
        self.cfg, self.buckets = cfg, buckets
        self.docs = Documents.of(table, b"\n")
        data = np.frombuffer(self.docs.data, dtype=np.uint8)
        self.word_start, self.word_end = word_bounds(data)
        hashes = word_hashes(data, self.word_start, self.word_end)
        self.first_word = np.searchsorted(self.word_start, self.docs.starts)
        self.last_word = np.searchsorted(self.word_start, self.docs.ends)
        self.roll, self.second = RollingHash(hashes), RollingHash(hashes, _SECOND_RADIX)
        self.segments = cut(self.roll, self.first_word, self.last_word, cfg.words, cfg.k)
        s = self.segments
        self.contents = self._hash(self.second, s.starts, s.starts + s.counts + cfg.words - 1)
        self.questions = Questions(s.keys, self.contents, buckets)

    def _hash(self, roll: RollingHash, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(roll.of(a, b) + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def judge_segments(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each segment: all its windows repeat; its windows are to be counted."""
        q = self.questions
        codes = q.gather(answers)[q.of_item]
        return (codes & REPEATED > 0) | (q.asked[q.of_item] > 1), (codes & (COMPARE | CROWDED) > 0) & q.leads

    def windows(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and two hashes of the windows of the segments to be counted."""
        s, n = self.segments, self.segments.counts[counted]
        starts = np.repeat(s.starts[counted] - np.cumsum(n) + n, n) + np.arange(n.sum())
        ends = starts + self.cfg.words
        return starts, self._hash(self.roll, starts, ends), self._hash(self.second, starts, ends)


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def remove_repeated_windows(docs: DataFrame, cfg: WordWindows = WordWindows()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_intervals, kept for every row of ``docs`` (doc_id, text).

    kept is the text of the words that stay, joined by one space. Null and empty texts have no words. Repeated rows
    are documents of their own, so their windows repeat. Other columns are ignored.
    """
    parts, buckets, lot = batched(docs, cfg.sizes)

    def ask(table: pa.Table) -> pa.Table:
        b = _Batch(table, cfg, buckets)
        return _table(ask_rows(table.column("batch")[0].as_py(), 0, b.questions, b.segments.keys, b.contents, None), ASK_SCHEMA)

    def count_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        """The distinct windows of the batch that are to be counted, and how often it holds each."""
        if not left.num_rows or not right.num_rows:
            return _table([], _COUNT_SCHEMA)
        b = _Batch(left, cfg, buckets)
        _, one, two = b.windows(b.judge_segments(answers_of(right)[0])[1])
        pairs, n = np.unique(np.stack([one, two]), axis=1, return_counts=True)
        batch = np.full(len(n), left.column("batch")[0].as_py(), dtype=np.int64)
        return pa.table([pa.array(batch), pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64)), pa.array(n.astype(np.int64))], schema=_COUNT_SCHEMA)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Batch(left, cfg, buckets) if left.num_rows else None
        flags = np.zeros(len(b.word_start) if b else 0, dtype=bool)
        answers = answers_of(right.filter(pc.equal(right.column("kind"), 0)))
        if b and 0 in answers:
            repeated, counted = b.judge_segments(answers[0])
            s, n = b.segments, b.segments.counts[repeated]
            flags[np.repeat(s.starts[repeated] - np.cumsum(n) + n, n) + np.arange(n.sum())] = True
            if counted.any():
                starts, one, two = b.windows(counted)
                many = right.filter(pc.equal(right.column("kind"), 1))
                found = np.stack([many.column(n).to_numpy().view(np.uint64) for n in ("one", "two")], axis=1)
                own = np.stack([one, two], axis=1)
                flags[starts[np.isin(np.ascontiguousarray(own).view("V16").ravel(), np.ascontiguousarray(found).view("V16").ravel())]] = True
        gone = covered(flags, cfg.words)
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals", "kept")}
        for i, doc in enumerate(b.docs.ids if b else []):
            words = b.docs.data[b.docs.starts[i] : b.docs.ends[i]].split()
            mask = gone[b.first_word[i] : b.last_word[i]]
            removed = int(mask.sum())
            kept = b" ".join([w for w, g in zip(words, mask.tolist()) if not g] if removed else words)
            for n, v in zip(out, (doc, len(words), removed, hashlib.sha256(kept).hexdigest(), int((np.diff(mask.astype(np.int8), prepend=0) > 0).sum()), kept.decode("utf-8", "surrogatepass"))):
                out[n].append(v)
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_intervals", pa.int64()), ("kept", pa.string())]))

    answers = checkpointed(answered(parts.groupBy("batch").applyInArrow(ask, ASK), False, cfg.sizes.crowd, lot))
    windows = checkpointed(parts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(count_windows, _COUNT))
    repeated = windows.groupBy("one", "two").agg(F.sum("n").alias("n")).filter("n > 1").select("one", "two")
    again = windows.join(repeated, ["one", "two"]).select("batch", F.lit(None).cast("long").alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("codes"), "one", "two")
    every = answers.withColumns({"one": F.lit(None).cast("long"), "two": F.lit(None).cast("long")}).unionByName(again)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_intervals long, kept string"
    return parts.groupBy("batch").cogroup(every.groupBy("batch")).applyInArrow(finish, schema)

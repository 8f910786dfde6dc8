"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised (ASCII letters lower-cased, words ``[a-z0-9]`` and everything beyond ASCII, joined by one
space) and scanned once; matches are mapped back to the original text. There is no shuffle: each task scans its
own documents with an automaton built from the broadcast windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Upper to lower case; ASCII other than letters and digits to a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Windows:
    """words: length of a window. block_bytes: most benchmark text that one broadcast automaton is built from; a
    larger benchmark is scanned in several blocks, one pass of the documents each."""

    words: int = 10
    block_bytes: int = 16_000_000


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def item_windows(items: list[tuple[object, str | None]], words: int) -> list[tuple[str, int, tuple[str, ...]]]:
    """(pattern, words in it, ids of its items). Patterns are bytes read as Latin-1, a space at either end."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        w = normal_words(text)
        for i in range(max(1, len(w) - words + 1) if w else 0):
            owners.setdefault(b" ".join(w[i : i + words]), set()).update(() if item is None else (str(item),))
    return [(f" {k.decode('latin-1')} ", k.count(b" ") + 1, tuple(sorted(v))) for k, v in owners.items()]


_built: dict[str, object] = {}


def _automaton(key: str, patterns: list[tuple[str, int, tuple[str, ...]]]):
    """Built once in a Python worker for each block of windows."""
    import ahocorasick

    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for pattern, n, owners in patterns:
            a.add_word(pattern, (len(pattern), n, owners))
        a.make_automaton()
        _built[key] = a
    return _built[key]


def scan_text(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words in the text, merged runs of hit words (start, end exclusive), items that occur."""
    words = normal_words(text)
    line = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(line.decode("latin-1"))) if words and len(automaton) else []
    if not hits:
        return len(words), [], set()
    before = np.cumsum(np.frombuffer(line, dtype=np.uint8) == 32)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    items: set[str] = set()
    for end, (length, n, owners) in hits:
        first = before[end - length + 1] - 1
        marks[first] += 1
        marks[first + n] -= 1
        items.update(owners)
    covered = np.concatenate(([0], (np.cumsum(marks)[:-1] > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(covered))
    return len(words), list(zip(edges[0::2].tolist(), edges[1::2].tolist())), items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code-point ranges of the original text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_NORMAL), dtype=np.uint8)
    inside = np.concatenate(([0], (data != 32).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(points[edges[2 * a]]), int(points[edges[2 * b - 1]])) for a, b in runs]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan_block(docs: DataFrame, text: str, carried: list[str], items: list[tuple[object, str | None]], cfg: Windows) -> DataFrame:
    """``docs`` with one more block's hits added to n_words, runs and items; ``carried`` columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(item_windows(items, cfg.words))
    key = uuid.uuid4().hex
    again = "_items" in docs.columns
    schema = StructType([docs.schema[c] for c in carried] + StructType.fromDDL("_n_words long, _runs array<struct<start:long,end:long>>, _items array<string>").fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        for batch in batches:
            found = [scan_text(automaton, t) for t in batch.column(text).to_pylist()]
            runs = [[{"start": a, "end": b} for a, b in f[1]] for f in found]
            items = [sorted(f[2]) for f in found]
            if again:
                runs = [x + y for x, y in zip(batch.column("_runs").to_pylist(), runs)]
                items = [sorted({*x, *y}) for x, y in zip(batch.column("_items").to_pylist(), items)]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), *columns], names=[*carried, "_n_words", "_runs", "_items"])

    return docs.mapInArrow(scan, schema)


def scan_documents(docs: DataFrame, benchmark: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """Every row of ``docs``, its columns named c0, c1, ... in their order, with _n_words, _runs (of words hit) and
    _items (ids that occur).

    Null and empty texts have no words and no hits. An item shorter than a window is one window, an item without
    words none. Repeated rows and items are scanned as they come; rows with equal item ids are one item. The windows of
    an item with a null id hit words, but no item is named for them. Without items nothing is hit.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // cfg.block_bytes + 1
    text = f"c{docs.columns.index('text')}"
    out = docs.toDF(*(carried := [f"c{i}" for i in range(len(docs.columns))]))
    for k in range(blocks):
        # At most about block_bytes of benchmark text reach the driver and a broadcast at a time.
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else benchmark
        out = _scan_block(out, text, carried, [(r.item_id, r.text) for r in part.select("item_id", "text").collect()], cfg)
    return out


def digest(docs: DataFrame, benchmark: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    hit = F.expr("""aggregate(array_sort(_runs), named_struct('to', 0L, 'n', 0L),
        (a, r) -> named_struct('to', greatest(a.to, r.end), 'n', a.n + greatest(0L, r.end - greatest(r.start, a.to))), a -> a.n)""")
    return scan_documents(docs.select("doc_id", "text"), benchmark, cfg).select(
        F.col("c0").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.size("_runs") > 0).alias("contaminated"),
    )


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """doc_id, start, end (code points of the original text, end exclusive) of every run of hit words."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *x) for d, t, runs in zip(*(batch.column(c).to_pylist() for c in ("c0", "c1", "_runs"))) for x in original_spans(t, [(r["start"], r["end"]) for r in runs])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], names=["doc_id", "start", "end"])

    found = scan_documents(docs.select("doc_id", "text"), benchmark, cfg).filter("size(_runs) > 0")
    return found.mapInArrow(spans, "doc_id long, start long, end long")


def clean_documents(docs: DataFrame, benchmark: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """The rows of ``docs`` without a hit, with its columns."""
    return scan_documents(docs, benchmark, cfg).filter("size(_runs) = 0").drop("_n_words", "_runs", "_items").toDF(*docs.columns)

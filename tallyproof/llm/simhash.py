"""Near duplicates by SimHash fingerprints that differ in few bits.

Method (binary trie self-join): sorted distinct fingerprints are a binary trie, whose nodes are ranges of the list. Pairs of
nodes are followed down together from (root, root). The bits that both nodes fix are compared, and a pair whose differing
bits exceed the budget is dropped with all below it; otherwise the node that fixes fewer bits is split. Links only matter for
components, so a pair of nodes whose fingerprints are all in one component already is dropped too: a cluster makes a tree
of links, not all its pairs.

Spark deals the fingerprints to tries by one more bit block than the budget has bits: of five blocks, two fingerprints that
differ in four bits share one (pigeonhole). A trie that would hold too many fingerprints is dealt again by blocks of the bits
that its members do not yet share, until every trie is small; n bits left cannot hold more than 2**n fingerprints, so this
ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tallyproof.llm.common import checkpointed
from tallyproof.llm.components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONE = np.uint64(1)


@dataclass(frozen=True)
class SimHash:
    """words: of a shingle; seed: of its hash; bits: most differing bits of a link. trie: fingerprints of one trie;
    frontier: node pairs followed at once; leaf: ranges whose product is no larger are compared one by one."""

    words: int = 4
    seed: int = 42
    bits: int = 4
    trie: int = 200_000
    frontier: int = 1 << 17
    leaf: int = 16


# ------------------------------------------------------------------ fingerprints


def fingerprint(text: str | None, cfg: SimHash) -> int:
    """Bits set in over half of the shingles' hashes; 0 without words. Long texts go in pieces of shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(cfg.words, len(words))
    first = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    last = ends[k - 1 :].tolist()
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), 1 << 14):
        hashes = np.fromiter((xxh64_intdigest(line[a:b], cfg.seed) for a, b in zip(first[at : at + (1 << 14)], last[at : at + (1 << 14)])), np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def hashed(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), cfg) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long")


# ------------------------------------------------------------------ a trie with itself


def _shared_bits(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Leading bits that two values share."""
    x = first ^ last
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return 64 - np.bitwise_count(x).astype(np.int64)


def _above(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The leading ``bits`` of 64-bit values, as a number; 0 bits give 0."""
    return np.where(bits == 0, np.uint64(0), x >> (np.uint64(64) - np.maximum(bits, 1).astype(np.uint64)))


class Forest:
    """Components of the fingerprints of a trie, as trees of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.renew()

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while np.any(r != (up := self.parent[r])):
            r = up
        return r

    def renew(self) -> None:
        """Compress all paths and note where the component changes along the list."""
        self.parent = self.roots(np.arange(len(self.parent)))
        self.changes = np.concatenate([[0], np.cumsum(self.parent[1:] != self.parent[:-1])]) if len(self.parent) else np.zeros(0, np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def open(self, s: np.ndarray, e: np.ndarray, t: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Pairs of ranges that are not one component altogether, as of the last renewal."""
        c, p = self.changes, self.parent
        return (c[e - 1] != c[s]) | (c[f - 1] != c[t]) | (p[s] != p[t])


def trie_components(values: np.ndarray, cfg: SimHash) -> np.ndarray:
    """For sorted distinct 64-bit ``values``: the place of the least member of each one's component."""
    forest = Forest(len(values))
    if len(values) < 2:
        return forest.parent
    whole = np.array([0]), np.array([len(values)])
    stack = [(*whole, *whole)]
    while stack:
        s, e, t, f = stack.pop()
        if len(s) > cfg.frontier:
            stack.append(tuple(x[cfg.frontier :] for x in (s, e, t, f)))
            s, e, t, f = (x[: cfg.frontier] for x in (s, e, t, f))
        keep = forest.open(s, e, t, f)
        s, e, t, f = s[keep], e[keep], t[keep], f[keep]
        own, other = _shared_bits(values[s], values[e - 1]), _shared_bits(values[t], values[f - 1])
        fixed = np.minimum(own, other)
        keep = np.bitwise_count(_above(values[s] ^ values[t], fixed)) <= cfg.bits
        s, e, t, f, own, other = (x[keep] for x in (s, e, t, f, own, other))
        small = (e - s) * (f - t) <= cfg.leaf
        if small.any():
            a, b = _cells(s[small], e[small], t[small], f[small])
            near = np.bitwise_count(values[a] ^ values[b]) <= cfg.bits
            if near.any():
                forest.link(a[near], b[near])
                forest.renew()
        s, e, t, f, own, other = (x[~small] for x in (s, e, t, f, own, other))
        if len(s):
            same = (s == t) & (e == f)
            left = (own <= other) | same  # split the node that fixes fewer bits, a pair of one node on both sides
            m = _split(values, np.where(left, s, t), np.where(left, own, other))
            # One node with itself: (low, high), (low, low), (high, high); the latter come first off the stack.
            low, high = (np.where(left, s, t), m), (m, np.where(left, e, f))
            rest = np.where(left, t, s), np.where(left, f, e)
            d = ~same
            parts = [(m[same] * 0 + s[same], m[same], m[same], e[same]), *((x[0][d], x[1][d], rest[0][d], rest[1][d]) for x in (low, high)), *((x[0][same], x[1][same]) * 2 for x in (low, high))]
            for part in (parts[0], tuple(np.concatenate(x) for x in zip(*parts[1:3])), tuple(np.concatenate(x) for x in zip(*parts[3:]))):
                if len(part[0]):
                    stack.append(part)
    return forest.roots(np.arange(len(values)))


def _split(values: np.ndarray, s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Where the ranges that start at s and fix ``bits`` leading bits have their next bit set first."""
    shift = (63 - bits).astype(np.uint64)
    return np.searchsorted(values, ((values[s] >> shift) | _ONE) << shift)


def _cells(s: np.ndarray, e: np.ndarray, t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) of the products of ranges, a < b where the ranges are one."""
    width = f - t
    n = (e - s) * width
    base = np.repeat(np.cumsum(n) - n, n)
    k = np.arange(len(base)) - base
    w = np.repeat(width, n)
    a, b = np.repeat(s, n) + k // w, np.repeat(t, n) + k % w
    return a[a != b], b[a != b]


# ------------------------------------------------------------------ jobs


def _blocks(mask: int, n: int) -> list[int]:
    """The set bits of ``mask`` in n blocks of about one size, as masks."""
    places = [b for b in range(63, -1, -1) if mask >> b & 1]
    edges = [len(places) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in places[i:j]) for i, j in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """a, b: links between the distinct fingerprints of ``fps`` (fp), enough for their components.

    Members of a trie share the bits outside ``mask``; key holds those bits and the mask tells which they are.
    """
    blocks = _blocks((1 << 64) - 1, cfg.bits + 1)
    dealt = fps.select("fp", F.explode(F.array(*[F.lit(_signed(b)) for b in blocks])).alias("shared"))
    ready = None
    while True:
        dealt = checkpointed(dealt.select("fp", "shared", F.col("fp").bitwiseAND(F.col("shared")).alias("key")))
        sizes = dealt.groupBy("shared", "key").agg(F.count("*").alias("_n")).filter("_n > 1")
        over = (F.col("_n") > cfg.trie) & (F.bit_count(F.bitwise_not("shared")) > cfg.bits)
        large = checkpointed(sizes.filter(over).select("shared", "key"))
        crowded = not large.isEmpty()
        fit = dealt.join(sizes.filter(~over).select("shared", "key"), ["shared", "key"], "left_semi")
        ready = fit if ready is None else ready.unionByName(fit)
        if not crowded:
            break
        # The masks of a round are few: each is one choice of a block in every round.
        masks = [r.shared for r in large.select("shared").distinct().collect()]
        again = [(m, _signed((m | b) & (2**64 - 1))) for m in masks for b in _blocks(~m & (2**64 - 1), cfg.bits + 1)]
        finer = fps.sparkSession.createDataFrame(again, "shared long, _finer long")
        dealt = dealt.join(large, ["shared", "key"], "left_semi").join(finer, "shared").select("fp", F.col("_finer").alias("shared"))

    def trie(table: pa.Table) -> pa.Table:
        values = np.unique(table.column("fp").to_numpy().view(np.uint64))
        top = trie_components(values, cfg)
        linked = np.flatnonzero(top != np.arange(len(top)))
        return pa.table({"a": pa.array(values[top[linked]].view(np.int64)), "b": pa.array(values[linked].view(np.int64))})

    return ready.select("shared", "key", "fp").groupBy("shared", "key").applyInArrow(trie, "a long, b long")


def fingerprint_components(docs: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links) of every row.

    Null and empty texts and texts without words have the fingerprint zero and are linked like any other; texts shorter
    than a shingle are one. Repeated rows share a fingerprint. A null doc_id is a component_id only where nothing else is in
    the component. Other columns are ignored; an empty table gives nothing.
    """
    rows = checkpointed(fingerprints(docs, cfg))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = checkpointed(components(checkpointed(fingerprint_links(fps.select("fp"), cfg))).withColumnRenamed("node", "fp"))
    placed = fps.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    own = checkpointed(placed.join(least, "component").select("fp", "component_id"))
    return rows.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Hard negatives for labelled vectors by exact integer inner products with every row.

Method (Four Russians): an anchor's components are taken in groups of eight; for each group a table holds the sums of all
256 subsets of its components. Candidates are packed into bit planes: one byte for each plane and group says which of
the eight components have that bit. The sum of a group's products with a plane is then one table look-up, and a score is
the look-ups added with a shift for each plane; the topmost plane is that of the sign.

Every anchor meets every row, in blocks: rows are dealt to parts of bounded size, anchors go to each part that may hold a
partner, and a task keeps one part while the anchors pass. First come the rows of the anchor's own label, dealt by label
and salt, for its positives; then all parts for its negatives, whose bounds hang on the positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.llm.common import checkpointed


@dataclass(frozen=True)
class Mining:
    """scale: components become floor(scale * x). positives, negatives: most of an anchor and of a positive. low, high:
    bounds of a negative's score in percent of the positive's. part: bytes of components that a task holds; spread: bytes
    of a part while there are fewer parts than shuffle partitions. block: anchors whose tables are made together.
    largest: components whose size reaches this after scaling have no exact 64-bit scores."""

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    part: int = 64 << 20
    spread: int = 1 << 20
    block: int = 64
    largest: int = 1 << 25


# ------------------------------------------------------------------ scoring inside tasks


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """[group, subset, anchor]: sums over every subset of each eight components of the anchors (rows)."""
    n, d = anchors.shape
    wide = np.zeros((n, -(-d // 8) * 8), dtype=dtype)
    wide[:, :d] = anchors
    tables = np.zeros((wide.shape[1] // 8, 256, n), dtype=dtype)
    for j in range(8):
        tables[:, 1 << j : 2 << j] = tables[:, : 1 << j] + wide[:, j::8].T[:, None, :]
    return tables


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """[plane, group, row]: bytes of the rows' components in two's complement; the last plane is the sign."""
    n, d = rows.shape
    wide = np.zeros((n, -(-d // 8), 8), dtype=np.int64)
    wide.reshape(n, -1)[:, :d] = rows
    planes = int(np.max(np.where(wide < 0, ~wide, wide), initial=0)).bit_length() + 1
    return np.stack([np.packbits((wide >> p & 1).astype(np.uint8), axis=2, bitorder="little")[:, :, 0].T for p in range(planes)])


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[row, anchor]: inner products, by look-ups alone."""
    total = np.zeros((planes.shape[2], tables.shape[2]), dtype=tables.dtype)
    for p in range(len(planes) - 1, -1, -1):
        total += total
        for table, byte in zip(tables, planes[p]):
            if p == len(planes) - 1:
                total -= table[byte]
            else:
                total += table[byte]
    return total


class Part:
    """The rows of one part: ids, labels and, in slices that keep scores in cache, bit planes."""

    SLICE = 4096

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        by = np.argsort(ids, kind="stable")  # of equal scores the smaller id comes first
        self.ids, self.labels = ids[by], labels[by]
        self.largest = int(np.abs(rows).max(initial=0))
        self.slices = [(a, bit_planes(rows[by[a : a + self.SLICE]])) for a in range(0, len(by), self.SLICE)]

    def scores_of(self, anchors: np.ndarray):
        """(first row, [row, anchor] scores) of each slice."""
        narrow = anchors.shape[1] * int(np.abs(anchors).max(initial=0)) * self.largest < 2**31
        tables = subset_sums(anchors, np.int32 if narrow else np.int64)
        for start, planes in self.slices:
            yield start, scores(tables, planes)


def _first(anchor: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Which hits are among the first k of their anchor (score down, row up)."""
    by = np.lexsort((row, -score, anchor))
    a = anchor[by]
    head = np.flatnonzero(np.diff(a, prepend=-1))
    place = np.arange(len(a)) - np.repeat(head, np.diff([*head, len(a)]))
    return by[place < k]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, scale: int) -> np.ndarray:
    """Scaled components, short vectors filled with zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


_MET = "anchor long, place int, positive_id long, positive_score long, partner_id long, score long"


def _meet(rows: DataFrame, anchors: DataFrame, parts: int, same_label: bool, cfg: Mining) -> DataFrame:
    """Partners of each anchor, the best of each part: rows of its label (positives), or rows of another label within the
    bounds of each of its positives (negatives; place is the positive's). Both tables: part, salt, id, label, vector;
    anchors: anchor, positives as well.

    A partition holds its rows of a part, then the part's anchors stream past in Arrow batches."""
    sides = rows.withColumns({"anchor": F.lit(None).cast("long"), "positives": F.lit(None).cast(anchors.schema["positives"].dataType)})
    dealt = sides.unionByName(anchors).repartition(parts, "part", "salt").sortWithinPartitions("part", "salt", F.col("anchor").isNotNull())

    def meet(batches):
        held, part, of = [], None, None
        for batch in batches:
            keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "salt")]
            is_row = batch.column("anchor").is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.any([np.diff(k, prepend=k[:1]) != 0 for k in (*keys, is_row.astype(np.int8))], axis=0))
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if b == a:
                    continue
                piece = batch.slice(a, b - a)
                if (key := (keys[0][a], keys[1][a])) != part:
                    held, part, of = [], key, None
                if is_row[a]:
                    held.append(piece)
                elif held:
                    of = of or _part_of(pa.Table.from_batches(held), cfg)
                    yield _partners(of, piece, same_label, cfg)

    return dealt.mapInArrow(meet, _MET)


def _part_of(table: pa.Table, cfg: Mining) -> Part:
    vectors = table.column("vector").combine_chunks()
    width = max(1, int(np.max(vectors.value_lengths().to_numpy(zero_copy_only=False), initial=0)))
    return Part(table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(vectors, width, cfg.scale))


def _partners(of: Part, anchors: pa.RecordBatch, same_label: bool, cfg: Mining) -> pa.RecordBatch:
    found: list[list[np.ndarray]] = []
    ids, labels, numbers = (anchors.column(n).to_numpy(zero_copy_only=False) for n in ("id", "label", "anchor"))
    vectors = anchors.column("vector")
    width = max(1, int(np.max(vectors.value_lengths().to_numpy(zero_copy_only=False), initial=0)))
    matrix = _matrix(vectors, width, cfg.scale)
    positives = anchors.column("positives").to_pylist()
    for lo in range(0, len(ids), cfg.block):
        some = slice(lo, min(lo + cfg.block, len(ids)))
        # (positive id, its score, least and most of a negative's score) of each anchor, by place
        bounds = [] if same_label else [[p[k] if k < len(p) else None for p in positives[some]] for k in range(cfg.positives)]
        least = None if same_label else np.array([min((_low(p["score"], cfg) for p in ps), default=2**62) for ps in positives[some]])
        best: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3 for _ in range(max(1, len(bounds)))]
        for start, score in of.scores_of(matrix[some]):
            own = of.labels[start : start + len(score), None] == labels[some][None, :]
            if same_label:
                row, anchor = np.nonzero(own & (of.ids[start : start + len(score), None] != ids[some][None, :]))
            else:
                row, anchor = np.nonzero(~own & (score >= least[None, :]))
            value = score[row, anchor].astype(np.int64)
            row += start
            for k, kept in enumerate(best):
                fits = slice(None)
                if not same_label:
                    low = np.array([2**62 if p is None else _low(p["score"], cfg) for p in bounds[k]])
                    high = np.array([-(2**62) if p is None else _high(p["score"], cfg) for p in bounds[k]])
                    fits = (value >= low[anchor]) & (value <= high[anchor])
                both = [np.concatenate(x) for x in zip(kept, (anchor[fits], value[fits], row[fits]))]
                first = _first(*both, cfg.positives if same_label else cfg.negatives)
                best[k] = [x[first] for x in both]
        for k, (anchor, value, row) in enumerate(best):
            # Positives have no bound; nulls are made of what is left empty.
            of_positive = [np.zeros(len(anchor), np.int64) if same_label else np.array([p[n] if p else 0 for p in bounds[k]], dtype=np.int64)[anchor] for n in ("id", "score")]
            found.append([numbers[some][anchor], np.full(len(anchor), k), *of_positive, of.ids[row], value])
    columns = [np.concatenate(x) for x in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=["anchor", "place", "positive_id", "positive_score", "partner_id", "score"])


def _low(score: int, cfg: Mining) -> int:
    """Least s with low * score <= 100 * s."""
    return -(-cfg.low * score // 100)


def _high(score: int, cfg: Mining) -> int:
    """Most s with 100 * s <= high * score."""
    return cfg.high * score // 100


# ------------------------------------------------------------------ jobs


def usable(vectors: DataFrame, anchor: Column, cfg: Mining) -> DataFrame:
    """id, label, vector, is_anchor of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    limit = float(cfg.largest) / cfg.scale
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(F.coalesce(sound, F.lit(False)))


def mine_hard_negatives(vectors: DataFrame, anchor: Column, cfg: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors`` (vec_id, label, embedding).

    ``anchor``: a condition that chooses the anchors. An anchor's positives are its best rows of the same label; for each,
    the negatives are the best rows of other labels whose score lies within the bounds. Scores go down, ties up by vec_id.
    Rows take no part with a null vec_id, label or vector, a component that is null or not finite, or one too large for
    exact 64-bit scores (2**17 at the scale of 256). Short and empty vectors count as filled up with zeros. Rows that share
    the anchor's vec_id are never its partners; repeated rows otherwise are rows of their own, and a repeated anchor gives
    its results once for each row. Other columns are ignored. An empty table gives none.
    """
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors, anchor, cfg))
    anchors = checkpointed(rows.filter("is_anchor").select("id", "label", "vector", F.monotonically_increasing_id().alias("anchor")))
    # Part sizes come from the bytes of each label; a label that fills several parts is salted.
    size = rows.groupBy("label").agg(F.sum(F.size("vector") * 8 + 16).alias("bytes"))
    total = size.agg(F.sum("bytes")).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = max(total // cfg.part + 1, min(width, total // cfg.spread + 1))
    label_parts = size.select("label", F.greatest(F.expr(f"bytes div {cfg.part} + 1"), F.ceil(F.col("bytes") * whole / max(1, total))).cast("long").alias("n_parts"))
    salt = F.pmod(F.xxhash64("id", "vector"), F.col("n_parts"))
    empty = F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives")
    own = ["id", "label", "vector"]

    mine = rows.join(label_parts, "label").select(F.col("label").alias("part"), salt.alias("salt"), *own)
    asked = anchors.join(label_parts, "label").select(F.col("label").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("salt"), *own, "anchor", empty)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "partner_id")
    near = _meet(mine, asked, whole, True, cfg).withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= cfg.positives)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("_k", F.col("partner_id").alias("id"), "score"))).alias("_p"))
    near = checkpointed(near.select("anchor", F.transform("_p", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives")))

    every = F.lit(0).cast("long").alias("part")
    mine = rows.select(every, F.pmod(F.xxhash64("id", "vector"), F.lit(whole)).alias("salt"), *own)
    asked = anchors.join(near, "anchor").select(every, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(whole - 1).cast("long"))).alias("salt"), *own, "anchor", "positives")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "partner_id")
    far = _meet(mine, asked, whole, False, cfg).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.negatives)
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return far.join(names, "anchor").select("anchor_id", "positive_id", "rank", F.col("partner_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

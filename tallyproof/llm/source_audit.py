"""Which sources of a language use other words than the rest, in exact integer arithmetic.

Method (length-bucketed packing): a task cuts its texts into terms and sorts them by length. Terms of up to eight bytes are
one 64-bit word, terms of up to sixteen two; they are brought into order by stable radix passes over 16-bit digits, and
runs are counted. Longer terms go to buckets of fixed width, sorted as bytes. Each task so sends one row for each term and
group, with occurrences and documents, and Spark sums these rows.

Divergences of pairs of sources are summed in tiles: a block of a language's terms by two ranges of its sources, so that no
term makes a row for each pair of sources.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.llm.common import checkpointed

#: What a term is made of: ASCII letters and all bytes of other characters; upper case becomes lower case.
_IN_TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Audit:
    """least_documents: of a language that a kept term is in. unit: of probabilities; add: occurrences added to each term.
    top: terms reported of a group. block, tile: terms and sources of a tile. batch: bytes of text worked on at once."""

    least_documents: int = 10
    unit: int = 1_000_000_000
    add: int = 2
    top: int = 10
    block: int = 4096
    tile: int = 128
    batch: int = 4 << 20


# ------------------------------------------------------------------ counting inside tasks


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order by 64-bit words, the first the most significant: passes over 16-bit digits, the least first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms as big-endian 64-bit words, filled with zero bytes, which no term has."""
    at = np.arange(8 * words)
    chars = np.where(at < lengths[:, None], data[np.minimum(starts[:, None] + at, len(data) - 1)], 0).astype(np.uint8)
    return list(np.ascontiguousarray(chars.reshape(-1, words, 8)).view(">u8")[:, :, 0].astype(np.uint64).T)


def term_order(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(order, new) for each length bucket: the bucket's terms so that equal ones follow each other, in their order
    before, and which of them differ from the one ahead."""
    for words, chosen in ((1, lengths <= 8), (2, (lengths > 8) & (lengths <= 16))):
        at = np.flatnonzero(chosen)
        if len(at):
            values = packed(data, starts[at], lengths[at], words)
            order = radix_order(values)
            new = np.ones(len(at), dtype=bool)
            new[1:] = np.any([v[order[1:]] != v[order[:-1]] for v in values], axis=0)
            yield at[order], new
    left = np.flatnonzero(lengths > 16)
    width = np.ceil(np.log2(np.maximum(lengths[left], 1))).astype(np.int64)
    for w in np.unique(width).tolist():  # a bucket holds terms of up to twice the shortest one's length
        at = left[width == w]
        most = int(lengths[at].max())
        terms = np.zeros(len(at), dtype=f"S{most}")
        cells = terms.view(np.uint8).reshape(len(at), most)
        for i, (s, n) in enumerate(zip(starts[at].tolist(), lengths[at].tolist())):
            cells[i, :n] = data[s : s + n]
        order = np.argsort(terms, kind="stable")
        new = np.ones(len(at), dtype=bool)
        new[1:] = terms[order[1:]] != terms[order[:-1]]
        yield at[order], new


def _slices(batch: pa.RecordBatch, size: int):
    ends = np.cumsum(np.fromiter((0 if (t := x.as_buffer()) is None else t.size for x in batch.column("text")), np.int64, batch.num_rows)) // size
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _counted(batch: pa.RecordBatch):
    """Rows (group, term, occurrences, documents) of a batch with lang, source and text, none of them null."""
    table = pa.Table.from_batches([batch]).sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
    text = table.column("text").combine_chunks().cast(pa.large_binary())
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return None
    data = _LOWER[data]
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]  # a term ends with its document
    ends = inside.copy()
    ends[:-1] &= ~(inside[1:] & ~begins[1:])
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    pair = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
    pair = [p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p for p in pair]
    codes = [p.indices.to_numpy() for p in pair]
    group = np.zeros(n, dtype=np.int64)
    group[1:] = np.cumsum((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1]))
    head = np.flatnonzero(np.diff(group, prepend=-1))
    out = []
    for order, new in term_order(data, starts, lengths):
        of = doc[order]
        run = new.copy()
        run[1:] |= group[of[1:]] != group[of[:-1]]
        at = np.flatnonzero(run)
        first = new | run
        first[1:] |= of[1:] != of[:-1]
        out.append((order[at], group[of[at]], np.diff([*at, len(order)]), np.add.reduceat(first.astype(np.int64), at)))
    if not out:
        return None
    term, group_of, count, docs = (np.concatenate(x) for x in zip(*out))
    size = lengths[term]
    to = np.zeros(len(term) + 1, dtype=np.int64)
    np.cumsum(size, out=to[1:])
    chars = data[np.repeat(starts[term] - to[:-1], size) + np.arange(to[-1])]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(term), [None, pa.py_buffer(to.tobytes()), pa.py_buffer(chars.tobytes())]).cast(pa.binary())
    rows = head[group_of]
    columns = [p.dictionary.take(pa.array(c[rows])) for p, c in zip(pair, codes)]
    return pa.RecordBatch.from_arrays([*columns, terms, pa.array(count.astype(np.int64)), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, cfg: Audit = Audit()) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), for every term that occurs."""

    def count(batches):
        for batch in batches:
            for piece in _slices(batch, cfg.batch):
                if (rows := _counted(piece)) is not None:
                    yield rows

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = texts.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ------------------------------------------------------------------ divergences


def _p(count: Column, total: Column, kept: Column, cfg: Audit) -> Column:
    """1 + floor(unit * (count + add) / (total + add * kept)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(28,0)")
    return (F.lit(1) + F.call_function("div", F.lit(cfg.unit).cast("decimal(10,0)") * wide(count + cfg.add), wide(total + cfg.add * kept))).cast("long")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(cells: DataFrame, cfg: Audit) -> DataFrame:
    """lang, a, b, value: each tile's sums over its terms. cells: lang, block, ti, tj, side (which of the two ranges of
    sources), source, term, p; a row without term has the p of an absent term, and terms, how many the block has."""

    def tile(table: pa.Table) -> pa.Table:
        x = {n: table.column(n).to_numpy() for n in ("ti", "tj", "side", "place", "p", "terms")}
        names = table.column("source").to_pylist()
        is_head = np.asarray(table.column("term").is_null())
        term = table.column("term").combine_chunks().dictionary_encode()
        codes = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(codes.max(initial=-1)) + 1
        terms = int(x["terms"][is_head].max())
        sides = []
        for side in (0, 1):
            heads = np.flatnonzero(is_head & (x["side"] == side))
            row = {int(k): i for i, k in enumerate(x["place"][heads].tolist())}
            matrix = np.repeat(x["p"][heads][:, None], width + 1, axis=1)  # the last column is an absent term's
            own = np.flatnonzero(~is_head & (x["side"] == side))
            matrix[[row[int(k)] for k in x["place"][own].tolist()], codes[own]] = x["p"][own]
            sides.append(([names[i] for i in heads], matrix))
        weight = np.ones(width + 1, dtype=np.int64)
        weight[-1] = terms - width
        (left, p), (right, q) = sides if len(sides[1][0]) else (sides[0], sides[0])
        rows = []
        for name, one in zip(left, p):
            gap = q - one[None, :]
            value = (gap * gap // (q + one[None, :])) @ weight
            rows.append((name, right, value))
        return pa.table({
            "lang": pa.array([table.column("lang")[0].as_py()] * (len(left) * len(right)), pa.string()),
            "a": pa.array([n for n, r, _ in rows for _ in r], pa.string()),
            "b": pa.array([b for _, r, _ in rows for b in r], pa.string()),
            "value": pa.array(np.concatenate([v for _, _, v in rows]) if rows else [], pa.int64()),
        })

    sums = cells.groupBy("lang", "block", "ti", "tj").applyInArrow(tile, "lang string, a string, b string, value long")
    # A tile of two ranges gives each pair once, that of one range gives both directions.
    both = sums.filter("a <> b").select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value", (F.col("a") < F.col("b")).alias("_up"))
    total = both.groupBy("lang", "a", "b").agg(F.sum(F.when(F.col("_up"), F.col("value"))).alias("up"), F.sum(F.when(~F.col("_up"), F.col("value"))).alias("down"))
    value = F.coalesce("up", "down").alias("value")
    return total.select("lang", "a", "b", value).unionByName(total.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), value))


def audit_sources(docs: DataFrame, cfg: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank for ``docs`` (lang, source, text).

    Part ``pair``: how far each other source of the language diverges from the group, over all kept terms; all of them.
    Part ``term``: the terms that the group uses more than its language does, the ``top`` by divergence. Ranks go by value
    down, then item as UTF-8 up. Null lang, source and text count as empty; every row is a document, repeated ones too. A
    group without terms has pairs, at the probabilities of absent terms (value 0 where its language keeps no term), and no
    terms. Other columns are ignored; an empty table gives nothing.
    """
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = checkpointed(term_counts(clean, cfg))
    groups = clean.select("lang", "source").distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= cfg.least_documents)
    own = checkpointed(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    vocabulary = own.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "v", "total_lang"]).withColumn("place", place)
    absent = F.when(F.col("v") > 0, _p(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)), cfg)).otherwise(F.lit(1)).alias("p")
    sources = checkpointed(sources.select("lang", "source", "place", "total", "v", "total_lang", F.expr(f"cast(v div {cfg.block} + 1 as int)").alias("blocks"), F.count("*").over(Window.partitionBy("lang")).cast("int").alias("sources"), absent))

    block = lambda blocks: F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block")
    named = checkpointed(own.join(sources.drop("p"), ["lang", "source"]).select("*", _p(F.col("n"), F.col("total"), F.col("v"), cfg).alias("p"), block(F.col("blocks"))))
    in_block = named.select("lang", "term", "block").distinct().groupBy("lang", "block").agg(F.count("*").alias("terms"))
    heads = sources.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(in_block, ["lang", "block"], "left").na.fill(0, ["terms"])
    cell = ["lang", "block", "place", "sources", "source", "term", "p", "terms"]
    cells = heads.withColumn("term", F.lit(None).cast("string")).select(cell).unionByName(named.withColumn("terms", F.lit(0).cast("long")).select(cell))
    # Tiles (i, j), i <= j, of ranges of sources: a source is in the first range of some and in the second of others.
    mine, last = F.expr(f"cast(place div {cfg.tile} as int)"), F.expr(f"cast((sources - 1) div {cfg.tile} as int)")
    as_first = F.transform(F.sequence(mine, last), lambda j: F.struct(mine.alias("ti"), j.alias("tj"), F.lit(0).alias("side")))
    as_second = F.when(mine > 0, F.transform(F.sequence(F.lit(0), mine - 1), lambda i: F.struct(i.alias("ti"), mine.alias("tj"), F.lit(1).alias("side"))))
    dealt = cells.select("*", F.explode(F.concat(as_first, F.coalesce(as_second, F.array().cast("array<struct<ti:int,tj:int,side:int>>")))).alias("_t"))
    pairs = _pair_sums(dealt.select("lang", "block", "_t.ti", "_t.tj", "_t.side", "place", "source", "term", "p", "terms"), cfg)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    q = _p(F.col("n_lang"), F.col("total_lang"), F.col("v"), cfg)
    terms = named.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.top)
    return pairs.unionByName(terms)

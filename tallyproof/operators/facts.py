"""Fact atoms, relations between them, and graphs over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions.facts import key_text
from tallyproof.sources.tables import stored

#: Relations along which a correction spreads.
CAUSAL = ("causes", "contradicts", "derived_from", "depends_on", "supports")


def value_conflicts(atoms: DataFrame, spread: float = 0.2) -> DataFrame:
    """atoms (doc_id, metric, period, amount) with suspect: its metric and period hold values further apart than
    ``spread`` of the largest. Aggregates of the groups join back; no group is collected."""
    key = [F.coalesce(key_text(F.col(c)), F.lit("")).alias(f"_{c}") for c in ("metric", "period")]
    x = atoms.select("*", *key)
    groups = x.filter("amount is not null").groupBy("doc_id", "_metric", "_period").agg(F.min("amount").alias("_lo"), F.max("amount").alias("_hi"), F.max(F.abs("amount")).alias("_most"))
    far = groups.filter((F.col("_hi") - F.col("_lo")) / F.greatest(F.col("_most"), F.lit(1e-9)) > spread).select("doc_id", "_metric", "_period", F.lit(True).alias("_far"))
    return x.join(far, ["doc_id", "_metric", "_period"], "left").withColumn("suspect", F.coalesce("_far", F.lit(False)) & F.col("amount").isNotNull()).drop("_metric", "_period", "_far")


def margin_pairs(atoms: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """doc_id, margin_id, revenue_id, profit_id, residual: for each stated margin the revenue and profit of its period
    (any, if the margin names none) that reproduce it best, within ``tolerance`` points; first atoms on ties.

    Profits meet revenues by document and period once; the ratios then meet margins in steps of the tolerance, so a
    margin sees only ratios in its own and the two neighbouring steps.
    """
    step = lambda c: F.floor(c / tolerance).cast("long")
    m = atoms.filter("metric = 'margin'").select("doc_id", F.col("atom_id").alias("margin_id"), F.col("period").alias("_p"), F.col("amount").alias("_m"))
    r = atoms.filter("metric = 'revenue' and amount > 0").select("doc_id", F.col("atom_id").alias("revenue_id"), F.col("period").alias("_rp"), F.col("ord").alias("_ro"), F.col("amount").alias("_r"))
    p = atoms.filter("metric = 'profit'").select("doc_id", F.col("atom_id").alias("profit_id"), F.col("period").alias("_rp"), F.col("ord").alias("_po"), F.col("amount").alias("_o"))
    ratios = r.join(p, ["doc_id", "_rp"]).withColumn("_ratio", F.col("_o") / F.col("_r") * 100).withColumn("_step", step(F.col("_ratio")))
    near = F.explode(F.sequence(step(F.col("_m")) - 1, step(F.col("_m")) + 1)).alias("_step")
    x = m.select("*", near).join(ratios, ["doc_id", "_step"]).filter("_p = '' or _rp = _p")
    x = x.withColumn("residual", F.abs(F.col("_ratio") - F.col("_m"))).filter(F.col("residual") <= tolerance)
    best = x.groupBy("doc_id", "margin_id").agg(F.min_by(F.struct("revenue_id", "profit_id", "residual"), F.struct("residual", "_ro", "_po")).alias("b"))
    return best.select("doc_id", "margin_id", "b.*")


def chain_edges(atoms: DataFrame, by: str, relation: str) -> DataFrame:
    """doc_id, source, target, relation: each atom to the one before it with the same ``by``."""
    before = F.lag("atom_id").over(Window.partitionBy("doc_id", by).orderBy("ord"))
    return atoms.withColumn("source", before).filter("source is not null").select("doc_id", "source", F.col("atom_id").alias("target"), F.lit(relation).alias("relation"))


def first_support(atoms: DataFrame, source_metric: str, target_metric: str) -> DataFrame:
    """doc_id, source, target: for each atom of one metric the first atom, in document order, of the other one whose
    period is the same or blank on either side. A named period meets the first target of that period and the first
    blank one, a blank one the first of the document: three look-ups of minima."""
    s = atoms.filter(F.col("metric") == source_metric).select("doc_id", F.col("atom_id").alias("source"), F.col("period").alias("_p"))
    t = atoms.filter(F.col("metric") == target_metric).select("doc_id", F.struct("ord", F.col("atom_id").alias("target")).alias("f"), F.col("period").alias("_p"))
    by_period = t.groupBy("doc_id", "_p").agg(F.min("f").alias("_same"))
    whole = t.groupBy("doc_id").agg(F.min("f").alias("_any"), F.min(F.when(F.col("_p") == "", F.col("f"))).alias("_blank"))
    x = s.join(by_period, ["doc_id", "_p"], "left").join(whole, "doc_id", "left")
    first = F.when(F.col("_p") == "", F.col("_any")).otherwise(F.array_min(F.array_compact(F.array("_same", "_blank"))))
    return x.select("doc_id", "source", first["target"].alias("target")).filter("target is not null")


def edge_union(*edges: DataFrame) -> DataFrame:
    """doc_id, source, target, relation, confidence: distinct edges; of equal ones the first source of edges wins."""
    numbered = [e.withColumn("_k", F.lit(i)) for i, e in enumerate(edges)]
    every = numbered[0]
    for e in numbered[1:]:
        every = every.unionByName(e)
    every = every.filter("source <> target")
    return every.groupBy("doc_id", "source", "target", "relation").agg(F.min_by("confidence", "_k").alias("confidence"))


def reachability(edges: DataFrame, seeds: DataFrame, depth: int | None, direction: str = "downstream") -> DataFrame:
    """doc_id, seed, node, depth of every node reachable from the seeds (doc_id, seed) over causal edges in at most
    ``depth`` steps (None: any number), with its least depth. Each level is a stored table of the nodes first reached
    there; the walk ends with an empty one."""
    a, b = ("source", "target") if direction == "downstream" else ("target", "source")
    steps = edges.filter(F.col("relation").isin(*CAUSAL)).select("doc_id", F.col(a).alias("node"), F.col(b).alias("_next")).distinct()
    reached = frontier = stored(seeds.select("doc_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())
    level = 0
    while depth is None or level < depth:
        level += 1
        after = frontier.select("doc_id", "seed", "node").join(steps, ["doc_id", "node"]).select("doc_id", "seed", F.col("_next").alias("node")).distinct()
        frontier = stored(after.join(reached, ["doc_id", "seed", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors held as arrays of floats."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Atoms of a block of a document; a task holds two blocks and their pairs.
TILE = 1024


def tiled(rows: DataFrame, size: int = TILE) -> DataFrame:
    """rows (doc_id, ord, ...) dealt to pairs of blocks of their document: ti, tj (ti <= tj) and side (0: of block ti, 1: of
    tj). Any two atoms of a document meet in one tile, a block meets itself once; a document has as many blocks as its size
    asks for, so no task gets a whole large one."""
    blocks = rows.groupBy("doc_id").agg(F.expr(f"count(*) div {size} + 1").alias("_blocks"))
    own = F.pmod(F.xxhash64("ord"), F.col("_blocks"))
    to = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda k: F.struct(F.least(own, k).alias("ti"), F.greatest(own, k).alias("tj"), F.when(own <= k, 0).otherwise(1).alias("side")))
    return rows.join(blocks, "doc_id").select(*rows.columns, F.explode(to).alias("_t")).select(*rows.columns, "_t.*")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the two blocks' rows, and which pairs count: each once."""
    side = table.column("side").to_numpy()
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if table.column("ti")[0].as_py() == table.column("tj")[0].as_py():
        return first, first, np.triu(np.ones((len(first), len(first)), dtype=bool), 1)
    return first, second, np.ones((len(first), len(second)), dtype=bool)


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors as rows; one that is null is not a number in all places, so that it is similar to none."""
    vectors = table.column("vec").combine_chunks()
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.full((table.num_rows, len(flat) // max(1, there.sum())), np.nan)
    out[there] = flat.reshape(there.sum(), out.shape[1])
    return out


def _codes(table: pa.Table, column: str) -> np.ndarray:
    """A number for each distinct text of a column; 0 for the blank one."""
    known = {"": 0}
    return np.array([known.setdefault(v or "", len(known)) for v in table.column(column).to_pylist()], dtype=np.int64)


_FLAGS = ("same_chunk", "neighbour_chunk", "same_metric", "same_period", "same_subject")


def member_pairs(atoms: DataFrame, groups: DataFrame, least: float | None = None, size: int = TILE) -> DataFrame:
    """doc_id, source, target (representatives in document order), similarity (the best of their members) and what members
    share: same_chunk, neighbour_chunk, same_metric, same_period, same_subject, for all pairs of groups of a document.

    atoms: doc_id, ord, chunk_no, metric, period, subject, vec (of one length, not null); groups: doc_id, rep, member. A
    document's atoms are dealt to tiles of two blocks; a tile is one matrix product. least: two atoms that are groups of their
    own, share nothing and are less similar are left out where they meet (a gate that asks for no less loses nothing).
    """
    text = lambda c: key_text(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    place = atoms.filter("chunk_no is not null").groupBy("doc_id", "chunk_no").agg(F.min("ord").alias("_first")).withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy("_first")))
    x = atoms.join(place.drop("_first"), ["doc_id", "chunk_no"], "left").join(groups.select("doc_id", "rep", F.col("member").alias("ord")), ["doc_id", "ord"])
    x = x.join(groups.groupBy("doc_id", "rep").agg((F.count("*") == 1).alias("alone")), ["doc_id", "rep"])
    x = x.select("doc_id", "ord", "alone", F.col("rep").cast("long").alias("rep"), F.coalesce("_place", F.lit(-9)).alias("place"), text("metric"), text("period"), text("subject"), "vec")

    def pairs(table: pa.Table) -> pa.Table:
        a, b, counts = _sides(table)
        rep, spot, vec = table.column("rep").to_numpy(), table.column("place").to_numpy(), _matrix(table)
        similarity = vec[a] @ vec[b].T
        counts &= rep[a][:, None] != rep[b][None, :]
        gap = np.abs(spot[a][:, None] - spot[b][None, :])
        known = (spot[a][:, None] > 0) & (spot[b][None, :] > 0)
        flags = [known & (gap == 0), known & (gap == 1)]
        for c in ("metric", "period", "subject"):
            codes = _codes(table, c)
            flags.append((codes[a][:, None] == codes[b][None, :]) & (codes[a][:, None] > 0))
        if least is not None:
            alone = table.column("alone").to_numpy()
            counts &= (similarity >= least) | np.any(flags, axis=0) | ~(alone[a][:, None] & alone[b][None, :])
        i, j = np.nonzero(counts)
        low, high = np.minimum(rep[a[i]], rep[b[j]]), np.maximum(rep[a[i]], rep[b[j]])
        columns = [low, high, similarity[i, j], *(f[i, j] for f in flags)]
        doc = table.column("doc_id").combine_chunks().take(pa.array(np.zeros(len(i), dtype=np.int64)))
        return pa.table([doc, *(pa.array(c) for c in columns)], names=["doc_id", "source", "target", "similarity", *_FLAGS])

    kind = atoms.schema["doc_id"].dataType.simpleString()
    met = tiled(x, size).groupBy("doc_id", "ti", "tj").applyInArrow(pairs, f"doc_id {kind}, source long, target long, similarity double, " + ", ".join(f"{f} boolean" for f in _FLAGS))
    return met.groupBy("doc_id", "source", "target").agg(F.max("similarity").alias("similarity"), *[F.bool_or(f).alias(f) for f in _FLAGS])


def duplicate_links(atoms: DataFrame, duplicate: float, size: int = TILE) -> DataFrame:
    """doc_id, a, b, blocked: links between atoms (doc_id, ord, metric, polarity, signature as texts, vec) with a cosine of at
    least ``duplicate`` whose metrics and polarities agree or are blank and whose signatures are equal; of each tile as many
    as its components need. Rows without a and b count in blocked the pairs that are similar enough and do not agree."""

    def links(table: pa.Table) -> pa.Table:
        a, b, counts = _sides(table)
        vec, ord_ = _matrix(table), table.column("ord").to_numpy()
        near = counts & (vec[a] @ vec[b].T >= duplicate) & (ord_[a][:, None] != ord_[b][None, :])
        agree = np.ones_like(near)
        for c in ("metric", "polarity", "signature"):
            codes = _codes(table, c)
            x, y = codes[a][:, None], codes[b][None, :]
            agree &= (x == y) | ((x == 0) | (y == 0) if c != "signature" else False)
        i, j = np.nonzero(near & agree)
        blocked = int((near & ~agree).sum())
        # A tree of the links: each node points to a smaller one until nothing changes.
        parent = np.arange(table.num_rows)
        one, two, tree = a[i], b[j], []
        while len(one):
            p, q = parent[one], parent[two]
            low, high = np.minimum(p, q), np.maximum(p, q)
            apart = low != high
            one, two, low, high = one[apart], two[apart], low[apart], high[apart]
            at = np.unique(high, return_index=True)[1]
            tree.append((one[at], two[at]))
            parent[high[at]] = low[at]
            while np.any(parent != parent[parent]):
                parent = parent[parent]
        ends = [np.concatenate(x) for x in zip(*tree)] if tree else [np.zeros(0, np.int64)] * 2
        doc = table.column("doc_id").combine_chunks().take(pa.array(np.zeros(len(ends[0]) + 1, dtype=np.int64)))
        columns = [pa.concat_arrays([pa.array(ord_[e], pa.int64()), pa.nulls(1, pa.int64())]) for e in ends]
        return pa.table([doc, *columns, pa.array([0] * len(ends[0]) + [blocked], pa.int64())], names=["doc_id", "a", "b", "blocked"])

    x = atoms.select("doc_id", F.col("ord").cast("long").alias("ord"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("metric", "polarity", "signature")], "vec")
    kind = atoms.schema["doc_id"].dataType.simpleString()
    return tiled(x, size).groupBy("doc_id", "ti", "tj").applyInArrow(links, f"doc_id {kind}, a long, b long, blocked long")


def pair_reasons(shared: float, alone: float) -> Column:
    """array of the reasons to keep a pair of member_pairs: near each other; or similar enough with a shared feature; or
    more similar without. Empty if there is none."""
    name = lambda n: F.when(F.col(n), F.lit(n))
    features = [name(n) for n in ("same_metric", "same_period", "same_subject")]
    some = F.col("same_metric") | F.col("same_period") | F.col("same_subject")
    gated = F.when((F.col("similarity") >= shared) & some, F.array_compact(F.array(*features, F.lit("embedding_gate")))).when(F.col("similarity") >= max(shared, alone), F.array(F.lit("strong_embedding_gate"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_compact(F.array(name("same_chunk"), name("neighbour_chunk"))), gated)


def pair_gate(pairs: DataFrame, shared: float, alone: float) -> DataFrame:
    """doc_id, source, target, similarity, reasons of the pairs of member_pairs that may be related."""
    return pairs.withColumn("reasons", pair_reasons(shared, alone)).filter("size(reasons) > 0").select("doc_id", "source", "target", "similarity", "reasons")


def pair_stats(pairs: DataFrame, groups: DataFrame, shared: float, alone: float) -> DataFrame:
    """doc_id, enumerated, representatives, kept, pruned, deduplicated and low, p50, p90, high of the similarities (nearest
    rank, half to even) of each document with atoms."""
    atoms = groups.groupBy("doc_id").agg(F.count("*").alias("_n"), F.count_distinct("rep").alias("_r"))
    ranked = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("similarity")) - 1).withColumn("_all", F.count("*").over(Window.partitionBy("doc_id")))
    at = lambda q: F.max(F.when(F.col("_k") == F.least(F.col("_all") - 1, F.rint((F.col("_all") - 1) * F.lit(q))), F.col("similarity")))
    p = ranked.groupBy("doc_id").agg(F.count("*").alias("representatives"), F.count_if(F.size(pair_reasons(shared, alone)) > 0).alias("kept"), at(0.0).alias("low"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(1.0).alias("high"))
    x = atoms.join(p, "doc_id", "left").na.fill(0, ["representatives", "kept"])
    half = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    return x.select("doc_id", half("_n").alias("enumerated"), "representatives", "kept", (F.col("representatives") - F.col("kept")).alias("pruned"), (F.col("_n") - F.col("_r")).alias("deduplicated"), "low", "p50", "p90", "high")


def alias_expand(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges between representatives as edges between all members (doc_id, rep, member); self-links and repeats drop."""
    a = aliases.select("doc_id", F.col("rep").alias("source"), F.col("member").alias("_s"))
    b = aliases.select("doc_id", F.col("rep").alias("target"), F.col("member").alias("_t"))
    x = edges.join(a, ["doc_id", "source"]).join(b, ["doc_id", "target"])
    return x.select("doc_id", F.col("_s").alias("source"), F.col("_t").alias("target")).filter("source <> target").distinct()

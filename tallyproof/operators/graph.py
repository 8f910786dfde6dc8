"""Graphs of fact atoms: near-duplicate groups, relation edges, context, propagation, batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions import facts as fx
from tallyproof.functions.facts import KOREAN, Lexicon
from tallyproof.operators.atoms import best_margin_pairs
from tallyproof.operators.facts import CAUSAL, TILE, duplicate_links
from tallyproof.operators.passes import ordered_pass
from tallyproof.sources.tables import stored

ALL_RELATIONS = (*CAUSAL, "same_metric", "same_period")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, node, component (its smallest node) of every node of ``edges`` (doc_id, a, b).

    Labels spread along edges, then each label takes the label of the node it names, so that rounds grow with the
    logarithm of a component's width. Every round is a stored table; the driver sees one count.
    """
    both = stored(edges.select("doc_id", "a", "b").unionByName(edges.selectExpr("doc_id", "b as a", "a as b")).distinct())
    labels = stored(both.groupBy("doc_id", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), ["doc_id", "b"]).groupBy("doc_id", F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        spread = labels.join(near, ["doc_id", "node"]).select("doc_id", "node", F.least("component", "_near").alias("_to"), F.col("component").alias("_was"))
        jump = spread.select("doc_id", F.col("node").alias("_to"), F.col("_to").alias("component"))
        after = stored(spread.join(jump, ["doc_id", "_to"]).select("doc_id", "node", F.least("_to", "component").alias("component"), "_was"))
        labels = after.drop("_was")
        if after.filter("component <> _was").isEmpty():
            return labels


def number_signature(value: Column, unit: Column, period: Column, statement: Column) -> Column:
    """array: value, unit and period where there is a value, else the numbers of the statement."""
    v = fx.key_text(F.coalesce(value, F.lit("")))
    numbers = F.transform(F.regexp_extract_all(F.coalesce(statement, F.lit("")), F.lit(r"[+-]?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))
    return F.when(v != "", F.array(F.replace(v, F.lit(","), F.lit("")), fx.key_text(F.coalesce(unit, F.lit(""))), fx.key_text(F.coalesce(period, F.lit(""))))).otherwise(numbers)


def _duplicates(atoms: DataFrame, duplicate: float, size: int) -> DataFrame:
    """duplicate_links of atoms whose signature is an array."""
    clean = [fx.key_text(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("metric", "polarity")]
    signed = F.array_join("signature", "\x1f", "\x1e")
    return duplicate_links(atoms.select("doc_id", "ord", *clean, signed.alias("signature"), "vec"), duplicate, size)


def near_duplicate_groups(atoms: DataFrame, duplicate: float = 0.92, size: int = TILE) -> DataFrame:
    """doc_id, rep, member: groups of atoms (doc_id, ord, metric, signature, polarity, vec) linked by a cosine of at
    least ``duplicate`` where number signatures are equal and metric and polarity agree or are blank; the first atom is the
    representative. Atoms alone are groups too, and those without a vector of finite numbers; rows of one ord are one member. Links are found in tiles of two blocks of a document's atoms."""
    links = _duplicates(atoms, duplicate, size).filter("a is not null").select("doc_id", "a", "b")
    named = atoms.select("doc_id", F.col("ord").alias("member")).distinct().join(components(links).toDF("doc_id", "member", "rep"), ["doc_id", "member"], "left")
    return named.select("doc_id", F.coalesce("rep", "member").alias("rep"), "member")


def blocked_duplicates(atoms: DataFrame, duplicate: float = 0.92, size: int = TILE) -> DataFrame:
    """doc_id, blocked: how many pairs of a document's atoms are similar enough for near_duplicate_groups, but differ in
    metric, polarity or numbers."""
    return _duplicates(atoms, duplicate, size).groupBy("doc_id").agg(F.sum("blocked").alias("blocked"))


def alias_links(groups: DataFrame) -> DataFrame:
    """Two edges, supports and same_metric, from each further member of a group to its representative."""
    x = groups.filter("rep <> member").select("doc_id", F.col("member").alias("source"), F.col("rep").alias("target"), F.explode(F.array(F.lit("supports"), F.lit("same_metric"))).alias("relation"))
    return x.withColumn("confidence", F.lit(0.92))


# ------------------------------------------------------------------ relations


def _first_compatible(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, target: for each source the first other target in document order whose metric and period are the
    same or blank on either side. Four equi-joins on minima take the place of an OR: for each combination of named and
    blank keys the two first targets are enough, one of which may be the source itself."""
    s = sources.select("doc_id", F.col("atom_id").alias("source"), "_m", "_p")
    t = targets.select("doc_id", F.col("atom_id").alias("target"), F.col("ord").alias("_o"), F.col("_m").alias("_tm"), F.col("_p").alias("_tp"))
    first_two = F.slice(F.array_sort(F.collect_set(F.struct("_o", "target"))), 1, 2)
    found = []
    for with_metric in (True, False):
        for with_period in (True, False):
            key = ["doc_id", *(["_tm"] if with_metric else []), *(["_tp"] if with_period else [])]
            ranked = t.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("_o", "target"))).filter("_k <= 2").groupBy(*key).agg(first_two.alias("_firsts"))
            # A named source key meets the same key and the blank one; a blank source key meets every target.
            own = s.filter(("_m <> ''" if with_metric else "_m = ''") + " and " + ("_p <> ''" if with_period else "_p = ''"))
            metrics = F.array(F.col("_m"), F.lit("")) if with_metric else F.array(F.lit(""))
            periods = F.array(F.col("_p"), F.lit("")) if with_period else F.array(F.lit(""))
            asks = own.withColumn("_tm", F.explode(metrics)).withColumn("_tp", F.explode(periods)).drop(*([] if with_metric else ["_tm"]), *([] if with_period else ["_tp"]))
            found.append(asks.join(ranked, key).select("doc_id", "source", F.explode("_firsts").alias("f")))
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).filter("f.target <> source")
    return every.groupBy("doc_id", "source").agg(F.min_by("f.target", "f._o").alias("target"))


def relation_edges(atoms: DataFrame, lx: Lexicon = KOREAN, tolerance: float = 0.15) -> DataFrame:
    """doc_id, source, target, relation, confidence by rule, distinct: margins derived from the revenue and profit that
    reproduce them (0.95), else from every margin input of their period (0.86); forecasts and trends depend on the
    first atom of their metric and period that can carry them (0.69); drivers support the first conclusion (0.70); each
    atom is tied to the one before of its metric (0.78) and period (0.74)."""
    said = F.coalesce("statement", F.lit(""))
    x = atoms.withColumns({"_m": fx.key_text(F.coalesce("metric", F.lit(""))), "_p": fx.key_text(F.coalesce("period", F.lit(""))), "_s": said, "_u": F.coalesce("unit_type", F.lit(""))})
    verified = best_margin_pairs(atoms).filter(F.col("residual") <= tolerance)
    exact = verified.select("doc_id", F.col("margin_id").alias("source"), F.explode(F.array("revenue_id", "profit_id")).alias("target"))
    margins = x.filter(fx.is_margin(F.col("_s"))).join(verified.select("doc_id", F.col("margin_id").alias("atom_id")), ["doc_id", "atom_id"], "left_anti").select("doc_id", F.col("atom_id").alias("source"), F.col("_p").alias("_want"))
    inputs = x.filter(fx.is_margin_input(F.col("_s"))).select("doc_id", F.col("atom_id").alias("target"), F.col("_p").alias("_want"))
    likely = margins.filter("_want <> ''").join(inputs, ["doc_id", "_want"]).select("doc_id", "source", "target").unionByName(margins.filter("_want = ''").drop("_want").join(inputs.drop("_want"), "doc_id"))
    judged = ("forecast_or_opinion", "trend_or_comparison")
    depends = _first_compatible(x.filter(F.col("_u").isin(*judged)), x.filter(F.col("_u").isin("metric_value", "causal_driver", "trend_or_comparison")))
    supports = _first_compatible(x.filter("_u = 'causal_driver'"), x.filter(F.col("_u").isin(*judged) | fx.is_conclusion(F.col("_s"), lx)))
    tied = [x.filter(f"{c} <> ''").withColumn("target", F.lag("atom_id").over(Window.partitionBy("doc_id", c).orderBy("ord"))).filter("target is not null").select("doc_id", F.col("atom_id").alias("source"), "target") for c in ("_m", "_p")]
    parts = ((exact, "derived_from", 0.95), (likely, "derived_from", 0.86), (depends, "depends_on", 0.69), (supports, "supports", 0.7), (tied[0], "same_metric", 0.78), (tied[1], "same_period", 0.74))
    named = [e.select("doc_id", "source", "target", F.lit(r).alias("relation"), F.lit(c).alias("confidence")) for e, r, c in parts]
    every = named[0]
    for e in named[1:]:
        every = every.unionByName(e)
    return every.filter("source <> target").groupBy("doc_id", "source", "target", "relation").agg(F.max("confidence").alias("confidence"))


def directed_edges(edges: DataFrame, atoms: DataFrame, lx: Lexicon = KOREAN) -> DataFrame:
    """edges (doc_id, ord, source, target, relation, confidence) that are well formed: both ends exist and differ, the
    relation is known; a judgement depends on its ground and a margin on its inputs, so such edges are turned round;
    of equal ones the first stays."""
    ends = atoms.select("doc_id", "atom_id", F.coalesce("statement", F.lit("")).alias("_s"), (fx.is_conclusion(F.coalesce("statement", F.lit("")), lx) | (F.coalesce("unit_type", F.lit("")) == "forecast_or_opinion")).alias("_c"))
    x = edges.filter(F.col("relation").isin(*ALL_RELATIONS) & (F.col("source") != F.col("target")))
    x = x.join(ends.toDF("doc_id", "source", "_ss", "_sc"), ["doc_id", "source"]).join(ends.toDF("doc_id", "target", "_ts", "_tc"), ["doc_id", "target"])
    turned = ((F.col("relation") == "depends_on") & F.col("_tc") & ~F.col("_sc")) | (F.col("relation").isin("depends_on", "derived_from") & fx.is_margin(F.col("_ts")) & fx.is_margin_input(F.col("_ss")))
    a, b = F.when(turned, F.col("target")).otherwise(F.col("source")), F.when(turned, F.col("source")).otherwise(F.col("target"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return x.select("doc_id", a.alias("source"), b.alias("target"), "relation", sure.alias("confidence"), "ord").groupBy("doc_id", "source", "target", "relation").agg(F.min_by("confidence", "ord").alias("confidence"))


# ------------------------------------------------------------------ context of an atom


def related_context(edges: DataFrame, atoms: DataFrame, most: int = 12, chunks: int = 4) -> DataFrame:
    """doc_id, atom_id, statements (array, in edge order) and chunk_nos (array, first seen, own chunk left out) of the
    atoms tied to it directly by a causal edge, in either direction."""
    e = edges.filter(F.col("relation").isin(*CAUSAL))
    either = e.select("doc_id", F.col("source").alias("atom_id"), F.col("target").alias("_other"), "ord").unionByName(e.select("doc_id", F.col("target").alias("atom_id"), F.col("source").alias("_other"), "ord"))
    first = either.filter("atom_id <> _other").groupBy("doc_id", "atom_id", "_other").agg(F.min("ord").alias("_at"))
    known = atoms.select("doc_id", F.col("atom_id").alias("_other"), F.col("statement").alias("_said"), F.col("chunk_no").alias("_where"))
    own = atoms.select("doc_id", "atom_id", F.col("chunk_no").alias("_own"))
    x = first.join(known, ["doc_id", "_other"]).join(own, ["doc_id", "atom_id"])
    # The numbered rows of an atom beyond the caps are not collected.
    order = Window.partitionBy("doc_id", "atom_id").orderBy("_at", "_other")
    said = x.filter("_said <> ''").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).groupBy("doc_id", "atom_id").agg(F.array_sort(F.collect_list(F.struct("_k", "_said"))).alias("_l")).select("doc_id", "atom_id", F.col("_l._said").alias("statements"))
    places = x.filter("_where <> _own").groupBy("doc_id", "atom_id", "_where").agg(F.min(F.struct("_at", "_other")).alias("_f"))
    places = places.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "atom_id").orderBy("_f"))).filter(F.col("_k") <= chunks).groupBy("doc_id", "atom_id").agg(F.array_sort(F.collect_list(F.struct("_k", "_where"))).alias("_l")).select("doc_id", "atom_id", F.col("_l._where").alias("chunk_nos"))
    out = own.select("doc_id", "atom_id").join(said, ["doc_id", "atom_id"], "left").join(places, ["doc_id", "atom_id"], "left")
    return out.select("doc_id", "atom_id", F.coalesce("statements", F.array().cast("array<string>")).alias("statements"), F.coalesce("chunk_nos", F.array().cast("array<int>")).alias("chunk_nos"))


#: Characters of the keys by which texts of one or two words are looked up.
GRAM = 8
#: Wanted keys of a document that go to its chunks in one array; more of them meet the chunks' keys in a join.
CARRIED = 4096


def containing_chunks(asks: DataFrame, chunks: DataFrame, carried: int = CARRIED) -> DataFrame:
    """The asks (doc_id, atom_id, needle) with chunk_no: every chunk (doc_id, chunk_no, text) of the document that holds the
    needle. Empty needles are in none.

    A chunk that holds a needle has all its inner words as words; a needle without inner ones has runs of characters that
    the chunk has too. These are the keys of an inverted index over the wanted ones only; each needle is asked by the key that
    the fewest chunks of its document have, and only these chunks are searched. Up to ``carried`` wanted keys of a document
    come to its chunks, so that of a chunk's keys only wanted ones are rows; a document with more of them deals all keys.
    """
    words = F.split("needle", r"(?U)\s+", -1)
    inner = F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    width = F.least(F.length("needle"), F.lit(GRAM))
    grams = lambda text, n: F.array_distinct(F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), n, F.lit("}))")), F.lit(1)))
    a = asks.filter("needle <> ''").withColumn("_n", F.when(F.size(inner) == 0, width).otherwise(0))
    a = stored(a.withColumn("_keys", F.when(F.col("_n") == 0, inner).otherwise(grams(F.col("needle"), F.col("_n")))))
    wanted = a.select(*asks.columns, "_n", F.explode("_keys").alias("_key"))
    keys = stored(wanted.select("doc_id", "_n", "_key").distinct())
    width = keys.groupBy("doc_id", "_n").agg(F.count("*").alias("_keys"))
    own = F.when(F.col("_n") == 0, F.array_distinct(F.split("text", r"(?U)\s+", -1))).otherwise(grams(F.col("text"), F.col("_n")))
    few = keys.join(width.filter(F.col("_keys") <= carried).drop("_keys"), ["doc_id", "_n"], "left_semi").groupBy("doc_id", "_n").agg(F.collect_list("_key").alias("_asked"))
    index = chunks.join(few, "doc_id").select("doc_id", "chunk_no", "_n", F.explode(F.array_intersect(own, "_asked")).alias("_key"))
    many_keys = stored(width.filter(F.col("_keys") > carried).select("doc_id", "_n"))
    if not many_keys.isEmpty():
        spoken = chunks.join(many_keys, "doc_id").select("doc_id", "chunk_no", "_n", F.explode(own).alias("_key"))
        index = index.unionByName(spoken.join(keys, ["doc_id", "_n", "_key"], "left_semi"))
    index = stored(index)
    many = index.groupBy("doc_id", "_n", "_key").agg(F.count("*").alias("_many"))
    rarest = wanted.join(many, ["doc_id", "_n", "_key"], "left").groupBy(*asks.columns, "_n").agg(F.min(F.struct(F.coalesce("_many", F.lit(0)).alias("m"), F.col("_key").alias("k"))).alias("_r"))
    found = rarest.filter("_r.m > 0").withColumn("_key", F.col("_r.k")).join(index, ["doc_id", "_n", "_key"]).select(*asks.columns, "chunk_no")
    return found.join(chunks, ["doc_id", "chunk_no"]).filter(F.col("text").contains(F.col("needle"))).select(*asks.columns, "chunk_no")


def atom_anchor(atoms: DataFrame, chunks: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, atom_id, chunk_no, tier of the chunk that holds an atom's quote: its own (0), else the first that does
    (1), else the first that holds the quote's longest number of ``least`` characters or more (2), else its own (3;
    null where there is none). Only atoms that their own chunk does not hold are looked for in the document's others."""
    quote = F.coalesce(F.nullif(fx.trimmed(F.coalesce("source_quote", F.lit(""))), F.lit("")), F.col("statement"))
    c = chunks.select("doc_id", "chunk_no", F.coalesce("raw_text", "text").alias("text"))
    a = atoms.select("doc_id", "atom_id", "chunk_no", quote.alias("_q")).join(c.withColumnRenamed("text", "_own"), ["doc_id", "chunk_no"], "left")
    held = F.coalesce(F.col("_own").contains(F.col("_q")), F.lit(False))
    tokens = fx.value_tokens(F.col("_q"))
    probe = F.element_at(F.array_sort(F.transform(tokens, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))), -1)
    a = stored(a.withColumns({"_held": held, "_probe": F.when(F.size(tokens) > 0, F.when(probe["n"] >= least, probe["t"])), "_here": F.col("_own").isNotNull()}).drop("_own"))
    lost = a.filter("not _held")
    asks = lost.select("doc_id", "atom_id", F.lit(1).alias("tier"), F.col("_q").alias("needle")).unionByName(lost.filter("_probe is not null").select("doc_id", "atom_id", F.lit(2).alias("tier"), F.col("_probe").alias("needle")))
    found = containing_chunks(asks, c).groupBy("doc_id", "atom_id").agg(F.min(F.struct("tier", F.col("chunk_no").alias("_at"))).alias("_f"))
    x = a.join(found, ["doc_id", "atom_id"], "left")
    return x.select("doc_id", "atom_id", F.when(F.col("_held"), F.col("chunk_no")).otherwise(F.coalesce("_f._at", F.when(F.col("_here"), F.col("chunk_no")))).alias("chunk_no"), F.when(F.col("_held"), 0).otherwise(F.coalesce("_f.tier", F.lit(3))).alias("tier"))


# ------------------------------------------------------------------ propagation


def affected_chunks(reached: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc_id, seed, chunk_no, direction (upstream, downstream or both), atom_ids of the chunks, other than the seed's own,
    that hold atoms reached from it. reached: doc_id, seed, node, direction."""
    home = atoms.select("doc_id", F.col("atom_id").alias("node"), "chunk_no")
    own = atoms.select("doc_id", F.col("atom_id").alias("seed"), F.col("chunk_no").alias("_own"))
    x = reached.filter("node <> seed").join(home, ["doc_id", "node"]).join(own, ["doc_id", "seed"]).filter("chunk_no <> _own")
    x = x.groupBy("doc_id", "seed", "chunk_no").agg(F.array_sort(F.collect_set("node")).alias("atom_ids"), F.bool_or(F.col("direction") == "upstream").alias("_u"), F.bool_or(F.col("direction") == "downstream").alias("_d"))
    return x.select("doc_id", "seed", "chunk_no", F.when(F.col("_u") & F.col("_d"), "both").when(F.col("_u"), "upstream").otherwise("downstream").alias("direction"), "atom_ids")


def pruned_propagation(edges: DataFrame, atoms: DataFrame, verdicts: DataFrame, seeds: DataFrame, depth: int | None = 2, direction: str = "downstream") -> DataFrame:
    """doc_id, seed, node, depth of the atoms that a correction of the seed reaches over causal edges, expanding only
    through chunks that a verdict (doc_id, chunk_no, affected) calls affected, chunks without a verdict (they need a
    person) and the seed's own. A node at the greatest depth is reached but not expanded. Each level is a stored
    table of the frontier; it ends when the frontier is empty, so ``depth`` may be None."""
    a, b = ("source", "target") if direction == "downstream" else ("target", "source")
    steps = edges.filter(F.col("relation").isin(*CAUSAL)).select("doc_id", F.col(a).alias("node"), F.col(b).alias("_next")).distinct()
    home = atoms.select("doc_id", F.col("atom_id").alias("node"), "chunk_no")
    open_ = home.join(verdicts.select("doc_id", "chunk_no", "affected"), ["doc_id", "chunk_no"], "left").select("doc_id", "node", "chunk_no", F.coalesce("affected", F.lit(True)).alias("_open"))
    own = home.toDF("doc_id", "seed", "_own")
    reached = frontier = stored(seeds.select("doc_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    level = 0
    while depth is None or level < depth:
        level += 1
        free = frontier.join(own, ["doc_id", "seed"], "left").join(open_, ["doc_id", "node"], "left").filter("node = seed or chunk_no is null or chunk_no = _own or _open")
        after = free.select("doc_id", "seed", "node").join(steps, ["doc_id", "node"]).select("doc_id", "seed", F.col("_next").alias("node")).distinct()
        frontier = stored(after.join(reached, ["doc_id", "seed", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


# ------------------------------------------------------------------ batches


def priority_order(atoms: DataFrame, lx: Lexicon = KOREAN) -> DataFrame:
    """atoms with place (from 1): opinions, trends, causes and conclusions first, each in document order."""
    first = F.coalesce("unit_type", F.lit("")).isin("forecast_or_opinion", "trend_or_comparison", "causal_driver") | fx.is_conclusion(F.coalesce("statement", F.lit("")), lx)
    return atoms.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(first, 0).otherwise(1), "ord")))


def greedy_packing(items: DataFrame, group: list[str], order: list[str], size: str, most: int = 128, room: int = 24_000) -> DataFrame:
    """items with batch_no (from 1 in each group): items in order fill a batch until ``most`` of them are in it or the
    next would pass ``room``; an item larger than that is a batch of its own. A null size counts as nothing."""

    def start():
        batch, n, used = 1, 0, 0

        def place(size: int | None) -> int:
            nonlocal batch, n, used
            size = int(size or 0)
            if n and (n >= most or used + size > room):
                batch, n, used = batch + 1, 0, 0
            n, used = n + 1, used + size
            return batch

        return place

    return ordered_pass(items, group, order, [size], start, "batch_no", "int", pa.int32())


def batch_edges(edges: DataFrame, batches: DataFrame, most: int = 256) -> DataFrame:
    """doc_id, batch_no, source, target, relation: the distinct edges with both ends in a batch (doc_id, batch_no,
    atom_id), at most ``most`` of a batch, in edge order."""
    b = batches.select("doc_id", "batch_no", "atom_id").distinct()
    x = edges.filter("source <> target").join(b.withColumnRenamed("atom_id", "source"), ["doc_id", "source"]).join(b.withColumnRenamed("atom_id", "target"), ["doc_id", "batch_no", "target"])
    x = x.groupBy("doc_id", "batch_no", "source", "target", "relation").agg(F.min("ord").alias("_at"))
    return x.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "batch_no").orderBy("_at", "source", "target", "relation"))).filter(F.col("_k") <= most).drop("_k", "_at")


def walk_order(steps: DataFrame, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, component, node, rank (from 1) of a first-in-first-out walk of every component (nodes: doc_id, component,
    node) from its starts (in id order) along ``steps`` (doc_id, node, next): a node comes after the first node that leads
    to it, and of nodes with one such the smaller id first. Level by level; unreached nodes are left out."""
    key = ["doc_id", "component"]
    by_id = Window.partitionBy(*key).orderBy("node")
    frontier = stored(starts.join(nodes, ["doc_id", "node"]).withColumn("rank", F.row_number().over(by_id)).select(*key, "node", "rank"))
    ways = stored(steps.join(starts.select("doc_id", F.col("node").alias("next")), ["doc_id", "next"], "left_anti"))
    ranked, levels, left = frontier, 0, nodes
    while True:
        # Only nodes that are left, in components still on their way, meet the next level.
        left = stored(left.join(frontier.select(*key, "node"), [*key, "node"], "left_anti").join(frontier.select(*key).distinct(), key, "left_semi"))
        after = frontier.join(ways, ["doc_id", "node"]).select(*key, F.col("next").alias("node"), "rank").groupBy(*key, "node").agg(F.min("rank").alias("_by"))
        after = after.join(left, [*key, "node"], "left_semi")
        # Ranks rise from level to level.
        taken = frontier.groupBy(*key).agg(F.max("rank").alias("_taken"))
        frontier = stored(after.join(taken, key).withColumn("rank", F.col("_taken") + F.row_number().over(Window.partitionBy(*key).orderBy("_by", "node"))).select(*key, "node", "rank"))
        if frontier.isEmpty():
            return ranked
        levels += 1
        ranked = ranked.unionByName(frontier)
        if levels % 16 == 0:
            ranked = stored(ranked)


def component_batches(candidates: DataFrame, edges: DataFrame, known: DataFrame, size: int = 128) -> DataFrame:
    """doc_id, component, batch_no (from 0), atom_id, place, role: candidates (doc_id, atom_id, chunk_no, ord) in batches of
    at most ``size`` that never mix components; role is active, or parent / child / parent+child for the one atom of
    ``known`` (doc_id, atom_id) just above the first and just below the last atom of a batch, for reference only.

    Candidates are tied by edges (doc_id, source, target) between them and to the one before in their chunk. A component
    is walked from its atoms without a parent in it (else from the smallest) along its edges, or, where an atom has none,
    along any tie; what that leaves out follows in the order of a walk along all ties. Ids compare as text.
    """
    c = candidates.select("doc_id", F.col("atom_id").alias("node"), "chunk_no", "ord")
    ids = c.select("doc_id", "node")
    inner = edges.filter("source <> target").select("doc_id", "source", "target").distinct()
    within = stored(inner.join(ids.withColumnRenamed("node", "source"), ["doc_id", "source"], "left_semi").join(ids.withColumnRenamed("node", "target"), ["doc_id", "target"], "left_semi"))
    before = c.filter("chunk_no is not null").withColumn("a", F.lag("node").over(Window.partitionBy("doc_id", "chunk_no").orderBy("ord"))).filter("a is not null").select("doc_id", "a", F.col("node").alias("b"))
    ties = stored(within.select("doc_id", F.col("source").alias("a"), F.col("target").alias("b")).unionByName(before).distinct())
    labels = components(ties)
    nodes = stored(ids.join(labels, ["doc_id", "node"], "left").select("doc_id", F.coalesce("component", "node").alias("component"), "node"))
    key = ["doc_id", "component"]
    roots = nodes.join(within.select("doc_id", F.col("target").alias("node")).distinct(), ["doc_id", "node"], "left_anti")
    rootless = nodes.join(roots.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min("node").alias("node"))
    all_ties = ties.select("doc_id", F.col("a").alias("node"), F.col("b").alias("next")).unionByName(ties.select("doc_id", F.col("b").alias("node"), F.col("a").alias("next"))).distinct()
    down = within.select("doc_id", F.col("source").alias("node"), F.col("target").alias("next"))
    steps = stored(down.unionByName(all_ties.join(down.select("doc_id", "node").distinct(), ["doc_id", "node"], "left_anti")))
    walked = walk_order(steps, roots.select("doc_id", "node").unionByName(rootless.select("doc_id", "node")), nodes)
    rest = nodes.join(walked.select(*key, "node"), [*key, "node"], "left_anti")
    if not rest.isEmpty():
        wide = walk_order(all_ties, nodes.groupBy(*key).agg(F.min("node").alias("node")).select("doc_id", "node"), nodes)
        rest = rest.join(wide, [*key, "node"])
        most = walked.groupBy(*key).agg(F.max("rank").alias("_n"))
        rest = rest.join(most, key).withColumn("rank", F.col("_n") + F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).select(*key, "node", "rank")
        walked = walked.unionByName(rest)
    first = F.min_by("node", "rank").over(Window.partitionBy(*key))
    placed = stored(walked.withColumns({"component": first, "batch_no": F.floor((F.col("rank") - 1) / size).cast("int")}))
    ends = placed.groupBy(*key, "batch_no").agg(F.min_by("node", "rank").alias("_first"), F.max_by("node", "rank").alias("_last"))
    ranks = placed.select("doc_id", F.col("component").alias("_c"), F.col("batch_no").alias("_b"), F.col("node").alias("_r"), "rank")
    sides = []
    for role, end, own, other in (("parent", "_first", "target", "source"), ("child", "_last", "source", "target")):
        x = ends.join(inner.select("doc_id", F.col(own).alias(end), F.col(other).alias("_r")), ["doc_id", end]).join(known.select("doc_id", F.col("atom_id").alias("_r")).distinct(), ["doc_id", "_r"], "left_semi")
        x = x.join(ranks, ["doc_id", "_r"], "left").filter("not coalesce(_c = component and _b = batch_no, false)")
        # Atoms of the same component come first, by rank.
        order = F.struct(F.when(F.col("_c") == F.col("component"), F.col("rank")).otherwise(F.lit(1_000_000_000)), F.col("_r"))
        sides.append(x.groupBy(*key, "batch_no").agg(F.min_by("_r", order).alias("node")).withColumn("role", F.lit(role)))
    both = sides[0].unionByName(sides[1]).groupBy(*key, "batch_no", "node").agg(F.array_join(F.array_sort(F.collect_set("role"), lambda a, b: F.when(a == b, 0).when(a == "parent", -1).otherwise(1)), "+").alias("role"))
    active = placed.select(*key, "batch_no", "node", F.lit("active").alias("role"), "rank")
    every = active.unionByName(both.withColumn("rank", F.when(F.col("role").startswith("parent"), F.lit(0)).otherwise(F.lit(2_000_000_000))))
    place = F.row_number().over(Window.partitionBy(*key, "batch_no").orderBy("rank"))
    return every.select("doc_id", "component", "batch_no", F.col("node").alias("atom_id"), place.alias("place"), "role")

"""Mixing sources to target weights, in built-in functions only.

Method: each source's documents lie in blocks by a permuting hash. A source's quota of words is some whole passes
over its blocks and a last pass over the first blocks in permuted order, cut inside one block. A splitting tree deals
these block draws to the output shards: at every node the draws of all sources are permuted and halved, so each
source's quota on the left is a multivariate hypergeometric draw, and the quotas add up exactly. Shards hold disjoint
draws and are shuffled by a hash of their own.

Text is read once, for its size. What meets in one place are sources and blocks, whose number does not depend on the
data (at most 4096 plus one a source).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.llm.common import checkpointed, total_bytes, word_count

_CELLS = 4096


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code-point order, repeating, null last. most_copies: a target's cap as a multiple of
    its source's size. levels: of the splitting tree; there are 2**levels shards. seed: names the permutation. part_bytes: of
    text behind one piece of a shard; a shard has as many pieces as the data needs."""

    weights: tuple[int, ...] = (5, 2, 1)
    most_copies: int = 3
    levels: int = 4
    seed: str = "mix"
    part_bytes: int = 64 << 20


def _place(doc_id: Column, cfg: Mix) -> Column:
    """Hexadecimal place in the permuted order."""
    return F.md5(F.concat(F.lit(cfg.seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def sized(docs: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, place of every row: all that the mix needs of a document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _place(F.col("doc_id"), cfg).alias("place"))


def source_targets(sizes: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """One row for each source: source, number (from 1, code-point order, null last), source_size, weight, target.

    Water-filling: sources sorted by cap per weight; those whose cap is under their share at the current level are
    capped, the others share the rest by weight.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy((F.col("cap") / F.col("weight")), "number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("number", F.row_number().over(every))
    weights = F.array(*map(F.lit, cfg.weights))
    sources = sources.withColumn("weight", F.element_at(weights, (F.col("number") - 1) % len(cfg.weights) + 1).cast("long")).withColumn("cap", cfg.most_copies * F.col("source_size"))
    sources = sources.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(filled), F.lit(0)))
    sources = sources.withColumn("heavy", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    sources = sources.withColumn("full", F.col("cap") * F.col("heavy") <= F.col("left") * F.col("weight"))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))).cast("double")
    level = F.try_divide(level, F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole).cast("double"))
    sources = sources.withColumn("level", level)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return sources.select("source", "number", "source_size", "weight", target.alias("target"))


def quotas(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with blocks (their number), quota (words), passes (whole ones), extra (words of the last pass)."""
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = targets.withColumn("blocks", F.greatest(F.lit(1), F.coalesce(F.ceil(F.try_divide(F.lit(_CELLS) * F.col("source_size"), F.sum("source_size").over(whole))), F.lit(1))).cast("int"))
    out = out.withColumn("quota", F.floor(F.col("target") + 0.5))
    out = out.withColumn("passes", F.coalesce(F.expr("try_divide(quota - quota % greatest(source_size, 1), source_size)"), F.lit(0)).cast("int"))
    return out.withColumn("extra", F.col("quota") - F.col("passes") * F.col("source_size"))


def _block() -> Column:
    return F.expr(f"cast(conv(substr(place, 1, 3), 16, 10) as int) * blocks div {_CELLS}").cast("int")


def placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row with its source's plan and its block. The plan is a row for each source; Spark broadcasts it while
    it is small."""
    return sizes.join(plan.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("block", _block())


def cuts(rows: DataFrame) -> DataFrame:
    """For each source with a last pass: number, cut_block, cut_place, cut_part, cut_size. Rows before the cut are
    taken whole in the last pass; those at cut_place (one document, or rows with one doc_id) share cut_part words of
    their cut_size."""
    blocks = rows.filter("extra > 0").groupBy("number", "extra", "block").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut = blocks.filter("before < extra and before + words >= extra").selectExpr("number as _number", "block as _block", "extra - before as rest")
    inside = rows.join(cut, (F.col("number") == F.col("_number")) & (F.col("block") == F.col("_block")))
    inside = inside.groupBy("number", "block", "rest", "place").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return inside.filter("before < rest and before + words >= rest").selectExpr("number", "block as cut_block", "place as cut_place", "rest - before as cut_part", "words as cut_size")


def splitting_tree(plan: DataFrame, cut: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """number, block, shards: the shard of each pass over the block, in order of the passes.

    The draws of a node are permuted and its first half goes left; an odd draw goes left.
    """
    draws = plan.join(cut, "number", "left").select("number", "passes", "cut_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    last = F.when(F.col("block") <= F.coalesce("cut_block", F.lit(-1)), 1).otherwise(0)
    draws = draws.withColumn("n", F.col("passes") + last).filter("n > 0").select("number", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pass"), F.lit(0).alias("node"))
    for level in range(cfg.levels):
        key = F.md5(F.concat_ws(":", F.lit(cfg.seed), F.lit(str(level)), F.col("number").cast("string"), F.col("block").cast("string"), F.col("pass").cast("string")))
        node = Window.partitionBy("node")
        draws = draws.withColumn("rank", F.row_number().over(node.orderBy(key))).withColumn("n", F.count("*").over(node))
        draws = draws.withColumn("node", 2 * F.col("node") + F.when(F.col("rank") > F.expr("(n + 1) div 2"), 1).otherwise(0)).drop("rank", "n")
    return draws.groupBy("number", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "node"))), lambda d: d["node"]).alias("shards"))


def mix(docs: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, place, source_size, target, taken, shards (one for each pass that draws the document).

    One row for each row of ``docs``. taken is size times the whole passes, and in the last pass the size again or, for
    the document at a source's cut, a part of it; it is at most most_copies times size. Null and empty texts have size
    0 and nothing taken; a null source is a source. Rows with one doc_id lie at one place. Empty tables give no rows.
    """
    sizes = checkpointed(sized(docs, cfg))  # narrow; the text is not read again
    plan = checkpointed(quotas(sizes, source_targets(sizes, cfg)))
    rows = placed(sizes, plan)
    cut = checkpointed(cuts(rows))
    shards = splitting_tree(plan, cut, cfg)
    out = rows.join(cut, "number", "left").join(shards.withColumnRenamed("number", "_n").withColumnRenamed("block", "_b"), (F.col("number") == F.col("_n")) & (F.col("block") == F.col("_b")), "left")
    last = F.expr("""case when cut_block is null or block > cut_block then 0
        when block < cut_block or place < cut_place then size
        when place = cut_place then cut_part * size div cut_size else 0 end""")
    out = out.withColumn("last", last).withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))
    drawn = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0))
    return out.select("doc_id", "source", "size", "place", "source_size", "target", "taken", F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), drawn).alias("shards"))


def mixed_documents(docs: DataFrame, cfg: Mix = Mix(), shard: str | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, with its columns (and its shard, if named).

    The document at a cut is drawn in its last pass if at least half of it is taken. Within a shard rows are ordered by a
    hash of document and pass; a shard is cut into pieces along that order, so that no task holds a whole large one.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = f"c{names.index('doc_id')}"
    drawn = mix(docs, cfg).groupBy("doc_id", "source", "size", "shards", "taken").agg(F.count("*").alias("rows")).drop("rows")
    whole = F.slice("shards", F.lit(1), F.least(F.size("shards"), F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest(F.col("size"), F.lit(1)))).cast("int")))
    drawn = drawn.filter("taken > 0").select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.posexplode(whole).alias("_pass", "_shard"))
    same = F.col(key).eqNullSafe(F.col("_doc")) & F.col(f"c{names.index('source')}").eqNullSafe(F.col("_source")) & (word_count(F.col(f"c{names.index('text')}")) == F.col("_size"))
    out = own.join(drawn, same)
    pieces = total_bytes(docs) // (cfg.part_bytes << cfg.levels) + 1
    out = out.withColumn("_key", F.md5(F.concat_ws(":", F.lit(cfg.seed), "_doc", "_pass")))
    out = out.withColumn("_piece", F.expr(f"cast(conv(substr(_key, 1, 6), 16, 10) as bigint) * {pieces} div {16**6}"))
    out = out.repartition(pieces << cfg.levels, "_shard", "_piece").sortWithinPartitions("_shard", "_key")
    columns = [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    return out.select(*columns, *([F.col("_shard").alias(shard)] if shard else []))

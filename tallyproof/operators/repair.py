"""Power-of-ten repairs: scale decisions, annual and scenario repair, sums of halves, restatements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions import facts as fx
from tallyproof.functions.amounts import ANNUAL, BLOCK_FACTORS, FACTORS, FIRST_HALF, rendered
from tallyproof.operators import lines as ln
from tallyproof.operators.consensus import consensus_asof
from tallyproof.operators.review import fits_context, with_value
from tallyproof.operators.forecast import headers, identity_cells, parsed, period_blocks, scenario_blocks, value_lines

NAMES = ("up", "mid", "down")


def scale_ratio(value: Column, target: Column) -> Column:
    return F.greatest(F.abs(value), F.abs(target)) / F.greatest(F.lit(1.0), F.least(F.abs(value), F.abs(target)))


def scale_decision(value: Column, target: Column) -> Column:
    """struct(factor, residual, ratio) of the nearest power of ten, the first listed on ties; null unless both are
    non-zero, of one sign, and at least five times apart."""
    best = F.array_min(F.array(*[F.struct(F.abs(value * f - target).alias("d"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(FACTORS)]))
    ratio = scale_ratio(value, target)
    decided = (value != 0) & (target != 0) & ((value < 0) == (target < 0)) & (ratio >= 5)
    return F.when(decided, F.struct(best["f"].alias("factor"), (best["d"] / F.abs(target)).alias("residual"), ratio.alias("ratio")))


def scale_decisions(cells: DataFrame) -> DataFrame:
    """cells (won, consensus_won) with factor, residual, ratio; null where nothing is decided."""
    return cells.withColumn("_d", scale_decision(F.col("won"), F.col("consensus_won"))).select(*cells.columns, "_d.factor", "_d.residual", "_d.ratio")


def annual_cells(lines: DataFrame, blocks: DataFrame, overrides: DataFrame | None = None, full: DataFrame | None = None) -> DataFrame:
    """Annual value lines that are headers of their own, without a scenario block below, with their consensus. full:
    scenario_blocks(lines), if it is stored already."""
    heads = headers(lines).filter("is_annual").select("doc_id", "line_no", "year")
    blocked = (full if full is not None else scenario_blocks(lines)).select("doc_id", F.col("header_line").alias("line_no"))
    cells = value_lines(lines, "annual").drop("year").join(heads, ["doc_id", "line_no"]).join(blocked, ["doc_id", "line_no"], "left_anti")
    return consensus_asof(cells, blocks, overrides)


def companions(lines: DataFrame, annual: DataFrame) -> DataFrame:
    """The first half-year line of each period within six lines of an annual line of the same year, for annual lines
    where both are there and sum to it within five percent."""
    half = value_lines(lines, "half").select("doc_id", "year", F.col("period").alias("p"), F.col("line_no").alias("n"), F.struct("line_no", "period", "prefix", "value_text", "unit", "trailing", "won", "line").alias("cell"))
    near = annual.select("doc_id", "year", "line_no", "won").join(half, ["doc_id", "year"]).filter("n <> line_no and n between line_no - 6 and line_no + 6")
    first = near.groupBy("doc_id", "year", "line_no", "won").agg(
        F.min_by("cell", F.when(F.col("p") == FIRST_HALF, F.col("n"))).alias("c1"), F.min_by("cell", F.when(F.col("p") != FIRST_HALF, F.col("n"))).alias("c2")
    )
    total = F.col("c1.won") + F.col("c2.won")
    return first.filter(F.abs(F.col("won") - total) / F.greatest(F.lit(1.0), F.abs("won"), F.abs(total)) <= 0.05)


def _changed(cell: str, factor: Column, label: Column) -> Column:
    new = F.col(f"{cell}.won") * factor
    line = F.concat(F.col(f"{cell}.prefix"), rendered(new, F.col(f"{cell}.unit"), F.col(f"{cell}.value_text")), F.col(f"{cell}.unit"), F.col(f"{cell}.trailing"))
    return F.struct(label.alias("label"), F.col(f"{cell}.line_no").alias("line_no"), factor.alias("factor"), F.col(f"{cell}.won").alias("old_won"), new.alias("new_won"), F.col(f"{cell}.line").alias("old_line"), line.alias("new_line"))


def annual_repair(lines: DataFrame, blocks: DataFrame, overrides: DataFrame | None = None, full: DataFrame | None = None) -> DataFrame:
    """changes (doc_id, year, label, line_no, factor, old_won, new_won, old_line, new_line, residual) of annual values
    and of the half-year lines that go with them. full: as in annual_cells."""
    cells = annual_cells(lines, blocks, overrides, full).withColumn("_d", scale_decision(F.col("won"), F.col("consensus_won"))).filter("_d is not null")
    own = cells.withColumn("cell", F.struct("line_no", "prefix", "value_text", "unit", "trailing", "won", "line"))
    halves = companions(lines, cells).select("doc_id", "year", "line_no", "c1", "c2")
    x = own.select("doc_id", "year", "line_no", "cell", "_d").join(halves, ["doc_id", "year", "line_no"], "left")
    f = F.col("_d.factor")
    changes = F.array_compact(F.array(_changed("cell", f, F.lit(ANNUAL)), F.when(F.col("c1").isNotNull(), _changed("c1", f, F.col("c1.period"))), F.when(F.col("c2").isNotNull(), _changed("c2", f, F.col("c2.period")))))
    return x.select("doc_id", "year", F.col("_d.residual").alias("residual"), F.explode(changes).alias("c")).select("doc_id", "year", "c.*", "residual")


def annual_reviews(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, line_no, year, reason_code of annual values that a person must see: no_consensus, sign or ratio."""
    cells = annual_cells(lines, blocks)
    c, v = F.col("consensus_won"), F.col("won")
    reason = F.when(c.isNull(), "no_consensus").when(scale_decision(v, c).isNotNull(), None).when((v < 0) != (c < 0), "sign").when(scale_ratio(v, c) > 2.8, "ratio")
    return cells.withColumn("reason_code", reason).filter("reason_code is not null").select("doc_id", "line_no", "year", "reason_code")


_ALL_DECIDED = "_f_up is not null and _f_mid is not null and _f_down is not null"
_ORDERED = "up.won >= mid.won and mid.won >= down.won"
_ORDERED_AFTER = "up.won * _f_up >= mid.won * _f_mid and mid.won * _f_mid >= down.won * _f_down"


def _case_factors(x: DataFrame) -> DataFrame:
    """x with the factor of each case, 1 where it is fine, null where the consensus does not decide."""
    c = F.col("consensus_won")
    for n in NAMES:
        v = F.col(f"{n}.won")
        fine = ((v < 0) == (c < 0)) & (F.abs(v) / F.abs(c)).between(0.35, 2.8)
        x = x.withColumn(f"_f_{n}", F.coalesce(scale_decision(v, c)["factor"], F.when(fine, 1.0)))
    return x


def scenario_repair(lines: DataFrame, blocks: DataFrame, overrides: DataFrame | None = None, full: DataFrame | None = None) -> DataFrame:
    """changes of scenario blocks: every cell decidable (a ratio of 0.35 to 2.8 is fine), order kept before and after. full: as
    in annual_cells."""
    x = consensus_asof((full if full is not None else scenario_blocks(lines)).withColumn("line_no", F.col("header_line")), blocks, overrides).filter("consensus_won is not null")
    c = F.col("consensus_won")
    x = _case_factors(x).filter(f"{_ALL_DECIDED} and {_ORDERED} and {_ORDERED_AFTER}")
    residual = F.abs(F.col("mid.won") * F.col("_f_mid") - c) / F.abs(c)
    changes = F.array_compact(F.array(*[F.when(F.col(f"_f_{n}") != 1.0, _changed(n, F.col(f"_f_{n}"), F.col(f"{n}.label"))) for n in NAMES]))
    return x.select("doc_id", "year", residual.alias("residual"), F.explode(changes).alias("c")).select("doc_id", "year", "c.*", "residual")


def apply_changes(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """lines with the changed ones replaced; of several changes of a line the one of the earliest header (smallest
    old line, then factor) holds."""
    one = changes.groupBy("doc_id", "line_no").agg(F.min_by("new_line", F.struct("old_line", "factor")).alias("_new"))
    return lines.select("doc_id", "line_no", "line", "eol").join(one, ["doc_id", "line_no"], "left").withColumn("line", F.coalesce("_new", "line")).drop("_new")


def rewritten(reports: DataFrame, *stages: DataFrame) -> DataFrame:
    """doc_id, line_no, line, eol of the lines of reports (doc_id, text) after the changes of each stage, in order.

    Texts and changes are dealt by document, so that texts are shuffled once, and lines neither here nor in a window or
    grouping by document that follows.
    """
    lines = ln.doc_lines(reports.select("doc_id", "text").repartition("doc_id"))
    for changes in stages:
        lines = apply_changes(lines, changes.select("doc_id", "line_no", "old_line", "new_line", "factor").repartition("doc_id"))
    return lines


# ------------------------------------------------------------------ sums of halves


def identity_wide(lines: DataFrame) -> DataFrame:
    """doc_id, year and h1, h2, annual (structs of header_line, up, mid, down) of the years with all three blocks."""
    b = period_blocks(lines).withColumn("b", F.struct("header_line", "up", "mid", "down"))
    x = b.groupBy("doc_id", "year").agg(*[F.max(F.when(F.col("period") == p, F.col("b"))).alias(n) for p, n in (("H1", "h1"), ("H2", "h2"), ("annual", "annual"))])
    return x.filter("h1 is not null and h2 is not null and annual is not null")


def _error(a: Column, h1: Column, h2: Column) -> Column:
    return F.abs(a - h1 - h2) / F.greatest(F.lit(1.0), F.abs(a), F.abs(h1 + h2))


def _won(block: str, name: str) -> Column:
    return F.col(f"{block}.{name}.won")


def invariant_states(lines: DataFrame, blocks: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The years of identity_wide with baseline (largest error of the sum), consensus_won and state: fine; order (the sum is
    right, but cases are not in order); no_consensus; not_anchored (the consensus does not hold the annual block in place);
    or gated: off by twenty percent or more, and to be repaired."""
    x = identity_wide(lines)
    x = x.withColumn("baseline", F.greatest(*[_error(_won("annual", n), _won("h1", n), _won("h2", n)) for n in NAMES]))
    x = consensus_asof(x.withColumn("line_no", F.col("annual.header_line")), blocks, overrides).drop("line_no")
    c, mid = F.col("consensus_won"), F.col("annual.mid.won")
    ordered = reduce(lambda p, q: p & q, [(_won(b, "up") >= _won(b, "mid")) & (_won(b, "mid") >= _won(b, "down")) for b in ("h1", "h2", "annual")])
    held = ((mid < 0) == (c < 0)) & (F.abs(mid) / F.greatest(F.lit(1.0), F.abs(c))).between(0.35, 2.8)
    small = F.col("baseline") < 0.2
    return x.withColumn("state", F.when(small & ordered, "fine").when(small, "order").when(c.isNull(), "no_consensus").when(held, "gated").otherwise("not_anchored"))


def invariant_gate(lines: DataFrame, blocks: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Years whose sum is off by twenty percent or more and whose annual block its consensus holds in place."""
    return invariant_states(lines, blocks, overrides).filter("state = 'gated'")


def _new_case(block: str, n: str, factor: Column) -> Column:
    """The change of one case of a half's block."""
    return F.struct(F.lit(block.upper()).alias("period"), _changed(f"{block}.{n}", factor, F.col(f"{block}.{n}.label")).alias("c"))


_IDENTITY = ("doc_id", "year", "p.period", "p.c.*", "residual")


def invariant_cell_repair(gated: DataFrame) -> DataFrame:
    """doc_id, year, period, label, line_no, factor, old_won, new_won, old_line, new_line, residual: single cells that the sum
    alone identifies, one for each broken label, whose repair restores order and sum."""
    x = gated
    for n in NAMES:
        a, h1, h2 = (_won(b, n) for b in ("annual", "h1", "h2"))
        broken = _error(a, h1, h2) > 0.02
        d1, d2 = scale_decision(h1, a - h2), scale_decision(h2, a - h1)
        f1, f2 = F.when(broken & (d1["residual"] <= 0.02), d1["factor"]), F.when(broken & (d2["residual"] <= 0.02), d2["factor"])
        x = x.withColumns({f"_h1_{n}": f1, f"_h2_{n}": f2, f"_ok_{n}": ~broken | (f1.isNotNull() != f2.isNotNull())})

    def new(block: str, n: str) -> Column:
        return _won(block, n) * (F.lit(1.0) if block == "annual" else F.coalesce(F.col(f"_{block}_{n}"), F.lit(1.0)))

    ordered = [(new(b, "up") >= new(b, "mid")) & (new(b, "mid") >= new(b, "down")) for b in ("h1", "h2", "annual")]
    errors = F.greatest(*[_error(new("annual", n), new("h1", n), new("h2", n)) for n in NAMES])
    x = x.filter(reduce(lambda p, q: p & q, [F.col(f"_ok_{n}") for n in NAMES] + ordered) & (errors <= 0.02))
    rows = F.array_compact(F.array(*[F.when(F.col(f"_{b}_{n}").isNotNull(), _new_case(b, n, F.col(f"_{b}_{n}"))) for b in ("h1", "h2") for n in NAMES]))
    return x.select("doc_id", "year", errors.alias("residual"), F.explode(rows).alias("p")).select(*_IDENTITY)


def invariant_block_repair(gated: DataFrame, by_cell: DataFrame) -> DataFrame:
    """The columns of invariant_cell_repair: the cases of the halves by the unique best pair of factors, annual held at 1, tried
    where no single-cell repair exists; no repair where the two best pairs cost the same. The 48 pairs are an array in the
    row, not a join."""
    pairs = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2")) for a in BLOCK_FACTORS for b in BLOCK_FACTORS if (a, b) != (1.0, 1.0)])
    x = gated.join(by_cell.select("doc_id", "year").distinct(), ["doc_id", "year"], "left_anti").withColumn("f", F.explode(pairs))
    worst = F.greatest(*[_error(_won("annual", n), _won("h1", n) * F.col("f.f1"), _won("h2", n) * F.col("f.f2")) for n in NAMES])
    ordered = reduce(lambda p, q: p & q, [(_won(b, "up") * f >= _won(b, "mid") * f) & (_won(b, "mid") * f >= _won(b, "down") * f) for b, f in (("h1", F.col("f.f1")), ("h2", F.col("f.f2")), ("annual", F.lit(1.0)))])
    x = x.withColumn("worst", worst).filter(ordered)
    cost = F.col("worst") + 0.001 * ((F.col("f.f1") != 1.0).cast("int") + (F.col("f.f2") != 1.0).cast("int"))
    ranked = x.withColumn("cost", cost)
    order = Window.partitionBy("doc_id", "year").orderBy("cost", "f.f1", "f.f2")
    ranked = ranked.withColumns({"rank": F.row_number().over(order), "runner_up": F.lead("cost").over(order)})
    best = ranked.filter("rank = 1 and worst <= 0.02 and not coalesce(abs(runner_up - cost) <= 1e-9, false)")
    rows = F.array_compact(F.array(*[F.when(F.col(f) != 1.0, _new_case(b, n, F.col(f))) for b, f in (("h1", "f.f1"), ("h2", "f.f2")) for n in NAMES]))
    return best.select("doc_id", "year", F.col("worst").alias("residual"), F.explode(rows).alias("p")).select(*_IDENTITY)


def arithmetic_guard(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id, locked (all touched identities hold), manual_review, max_residual of the documents with changes."""
    touched = changes.groupBy("doc_id", "year").agg(F.max("residual").alias("r"))
    x = touched.join(identity_cells(lines).select("doc_id", "year", "residual", "identity_ok"), ["doc_id", "year"], "left")
    x = x.groupBy("doc_id").agg(F.coalesce(F.bool_and("identity_ok"), F.lit(True)).alias("locked"), F.max("residual").alias("_i"), F.max("r").alias("_r"))
    worst = F.when(F.col("locked"), F.col("_r")).otherwise(F.col("_i"))
    return x.select("doc_id", "locked", (~F.col("locked") | (F.col("_r") > 0.25)).alias("manual_review"), worst.alias("max_residual"))


# ------------------------------------------------------------------ restatements


def restating_lines(context: DataFrame) -> DataFrame:
    """The lines of context (lines.line_context) that may restate a value: outside fences, with operating profit and money."""
    return context.filter(F.col("line").contains("영업이익") & ~F.col("in_fence") & F.col("line").rlike(fx.MONEY))


def restatement_matches(context: DataFrame, mappings: DataFrame) -> DataFrame:
    """doc_id, line_no, line, mapping_no, old_won, new_won: lines outside fences that name operating profit, with each
    mapping (doc_id, mapping_no, year, label, old_won, new_won) whose old value they repeat, in any unit, for its year and
    scenario."""
    x = with_value(restating_lines(context).select("doc_id", "line_no", "line", "active_year"), F.col("line"), mappings.select("doc_id", "mapping_no", "year", "label", "old_won", "new_won"))
    x = x.filter(fits_context(F.col("year"), F.col("label"), F.col("line"), F.col("active_year")))
    return x.select("doc_id", "line_no", "line", "mapping_no", "old_won", "new_won").distinct()


def restatement_values(matches: DataFrame) -> DataFrame:
    """doc_id, line_no, line, old_won, new_won, mapping_nos, status of each old value in a line: apply, or review where its
    mappings disagree on the new one (null then)."""
    x = matches.groupBy("doc_id", "line_no", "line", "old_won").agg(F.array_sort(F.collect_set("mapping_no")).alias("mapping_nos"), F.min("new_won").alias("_lo"), F.max("new_won").alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    return x.select("doc_id", "line_no", "line", "old_won", F.when(one, F.col("_lo")).alias("new_won"), "mapping_nos", F.when(one, "apply").otherwise("review").alias("status"))


def restatement_repair(context: DataFrame, mappings: DataFrame) -> DataFrame:
    """doc_id, line_no, old_won, new_won, replacements, old_line, new_line of the lines whose restated values are rewritten,
    one row for each value; values are replaced in the order of their mappings, each in the line that the one before
    left, so only matched tokens change and keep their unit, spacing and commas. old_line and new_line are the whole
    line before and after all of them."""
    return restated_lines(restatement_values(restatement_matches(context, mappings)))


def restated_lines(values: DataFrame) -> DataFrame:
    """restatement_repair from the values (restatement_values) found."""
    steps = values.filter("status = 'apply'").groupBy("doc_id", "line_no", "line").agg(F.array_sort(F.collect_list(F.struct(F.col("mapping_nos")[0].alias("k"), F.col("old_won").alias("old"), F.col("new_won").alias("new")))).alias("_steps"))
    start = F.struct(F.col("line").alias("text"), F.expr("cast(array() as array<struct<old: double, new: double, n: int>>)").alias("done"))

    def apply(a: Column, s: Column) -> Column:
        n = fx.money_hits(a["text"], s["old"])
        return F.struct(fx.money_replaced(a["text"], s["old"], s["new"]).alias("text"), F.array_append(a["done"], F.struct(s["old"].alias("old"), s["new"].alias("new"), n.alias("n"))).alias("done"))

    x = steps.withColumn("_r", F.aggregate("_steps", start, apply)).select("doc_id", "line_no", F.col("line").alias("old_line"), F.col("_r.text").alias("new_line"), F.explode("_r.done").alias("d"))
    return x.filter("d.n > 0").select("doc_id", "line_no", F.col("d.old").alias("old_won"), F.col("d.new").alias("new_won"), F.col("d.n").cast("long").alias("replacements"), "old_line", "new_line")


def apply_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, applied (array of ord) of texts (doc_id, text) after spans (doc_id, ord, original, suggested) in order: a
    span is replaced where the text, as the spans before left it, holds it exactly once. Documents without a span pass
    unchanged. A fold over one document's spans."""
    listed = spans.filter("original <> '' and original <> suggested").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "original", "suggested"))).alias("_spans"))
    start = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.expr("cast(array() as array<bigint>)").alias("done"))

    def apply(a: Column, s: Column) -> Column:
        once = F.length(a["text"]) - F.length(F.replace(a["text"], s["original"], F.lit(""))) == F.length(s["original"])
        return F.struct(F.when(once, F.replace(a["text"], s["original"], s["suggested"])).otherwise(a["text"]).alias("text"), F.when(once, F.array_append(a["done"], s["ord"].cast("long"))).otherwise(a["done"]).alias("done"))

    x = texts.join(listed, "doc_id", "left").withColumn("_r", F.aggregate(F.coalesce("_spans", F.expr("cast(array() as array<struct<ord: bigint, original: string, suggested: string>>)")), start, apply))
    return x.select("doc_id", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.col("_r.text")).alias("text"), F.col("_r.done").alias("applied"))


def applied_changes(changes: DataFrame, restated: DataFrame) -> DataFrame:
    """doc_id, kind (scale or restatement), line_no, old_won, new_won, new_line: all that the stages changed."""
    a = changes.select("doc_id", F.lit("scale").alias("kind"), "line_no", "old_won", "new_won", "new_line")
    return a.unionByName(restated.select("doc_id", F.lit("restatement").alias("kind"), "line_no", "old_won", "new_won", "new_line"))

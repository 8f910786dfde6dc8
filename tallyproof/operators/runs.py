"""A whole repair of a table of reports: both passes over the lines, restatements, corrected texts, the review ledger."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from tallyproof.operators import consensus as con, forecast as fc, lines as ln, repair as rp
from tallyproof.operators.review import scale_mappings
from tallyproof.sources.tables import release, stored

#: Review codes that a later repair of the sum of halves settles: they say what the consensus alone could not tell.
SETTLED = ("no_consensus", "undecided", "sign", "ratio")


def header_states(lines: DataFrame, blocks: DataFrame, overrides: DataFrame | None = None, full: DataFrame | None = None) -> DataFrame:
    """doc_id, line_no, year, checked, reason_code, ratio of the concrete forecast headers. checked: there is a consensus and a
    full scenario block or an annual value. reason_code: no_consensus; of scenarios order, undecided, order_after; of an
    annual value sign, ratio; null if nothing is open. full: fc.scenario_blocks(lines), if it is stored already."""
    x = con.consensus_asof(fc.headers(lines).select("doc_id", "line_no", "year", "is_section"), blocks, overrides)
    x = x.join((full if full is not None else fc.scenario_blocks(lines)).withColumnRenamed("header_line", "line_no").drop("year"), ["doc_id", "line_no"], "left")
    x = x.join(fc.value_lines(lines, "annual").select("doc_id", "line_no", "won"), ["doc_id", "line_no"], "left")
    x = rp._case_factors(x)
    c, v = F.col("consensus_won"), F.col("won")
    cases = F.when(~F.expr(rp._ORDERED), "order").when(~F.expr(rp._ALL_DECIDED), "undecided").when(~F.expr(rp._ORDERED_AFTER), "order_after")
    ratio = rp.scale_ratio(v, c)
    single = F.when(rp.scale_decision(v, c).isNotNull(), None).when((v < 0) != (c < 0), "sign").when(ratio > 2.8, "ratio")
    full, section = F.col("up").isNotNull(), F.col("is_section")
    reason = F.when(c.isNull(), "no_consensus").when(section, None).when(full, cases).when(v.isNotNull(), single)
    checked = c.isNotNull() & ~section & (full | v.isNotNull())
    return x.select("doc_id", "line_no", "year", checked.alias("checked"), reason.alias("reason_code"), F.when(~full, ratio).alias("ratio"))


def header_years(lines: DataFrame) -> DataFrame:
    """doc_id, year of every forecast header, those above a more concrete one included."""
    return fc.parsed(lines).filter("head_year is not null").select("doc_id", F.col("head_year").alias("year")).distinct()


def unparsed_years(lines: DataFrame, checked: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """doc_id, year of headers without a year's value that could be checked (checked: doc_id, year). years:
    header_years(lines), if they are stored already."""
    return (years if years is not None else header_years(lines)).join(checked.select("doc_id", "year").distinct(), ["doc_id", "year"], "left_anti")


def _reviews(rows: DataFrame, stage: str, **detail) -> DataFrame:
    """Ledger rows of rows (doc_id, reason_code; year and line_no where they have them)."""
    optional = lambda c, t: (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
    pairs = [x for name, c in detail.items() for x in (F.lit(name), c.cast("string"))]
    more = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return rows.select("doc_id", F.lit(stage).alias("stage"), optional("year", "string"), optional("line_no", "int"), "reason_code", more.alias("detail"))


def review_ledger(rejected: DataFrame, headers: DataFrame, states: DataFrame, identity: DataFrame, unparsed: DataFrame, conflicts: DataFrame) -> DataFrame:
    """doc_id, stage, year, line_no, reason_code, detail: what a person must see after all stages.

    rejected: consensus rows whose units disagree (doc_id, heading_line), one item a block. headers: header_states. states:
    invariant_states; a gated year without a change in ``identity`` is ambiguous. unparsed: unparsed_years. conflicts:
    restatement values whose mappings disagree (doc_id, line_no, old_won). Items about the consensus are taken back for
    the years that the sum of halves has repaired: an anti-join by document and year.
    """
    repaired = identity.select("doc_id", "year").distinct()
    blocks = rejected.groupBy("doc_id", F.col("heading_line").alias("line_no")).agg(F.count("*").alias("n")).withColumn("reason_code", F.lit("unit_mismatch"))
    first = headers.filter("reason_code is not null")
    settled = F.col("reason_code").isin(*SETTLED)
    open_ = first.filter(~settled).unionByName(first.filter(settled).join(repaired, ["doc_id", "year"], "left_anti"))
    gated = states.filter("state = 'gated'").join(repaired, ["doc_id", "year"], "left_anti").withColumn("reason_code", F.lit("ambiguous"))
    sums = states.filter("state in ('order', 'no_consensus', 'not_anchored')").withColumn("reason_code", F.col("state")).unionByName(gated)
    parts = [
        _reviews(blocks, "consensus", rejected=F.col("n")),
        _reviews(open_, "forecast", ratio=F.when(F.col("reason_code").isin("sign", "ratio"), F.round("ratio", 6))),
        _reviews(sums, "half_year_sum", residual=F.round("baseline", 6)),
        _reviews(unparsed.withColumn("reason_code", F.lit("unparsed")), "forecast"),
        _reviews(conflicts.withColumn("reason_code", F.lit("conflict")), "restatement", old_won=F.col("old_won").cast("decimal(38,2)")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repair_run(reports: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run over reports (doc_id, text; consensus_won where requests give one): corrected (doc_id, text),
    changes (doc_id, stage, year, period, label, line_no, factor, old_won, new_won, old_line, new_line, residual), review_items
    and run_stats (by document).

    The consensus decides first, then the sum of halves over the lines as they are by then, then restatements. Reports without
    lines have neither text nor items. Lines are stored parsed for the steps of a pass and go after it; those after a pass
    are made from the texts and the changes so far (rewritten), so reports are read for each pass and by corrected.
    """
    kept = partial(stored, dealt=True)
    overrides = reports.select("doc_id", "consensus_won") if "consensus_won" in reports.columns else None
    lines = kept(fc.parsed(ln.doc_lines(reports)))
    inside = kept(con.block_lines(lines))
    rejected = kept(con.entries(lines, inside).filter("mismatch"))
    blocks = kept(con.blocks(lines, inside))
    release(inside)
    full = kept(fc.scenario_blocks(lines))
    first = kept(rp.annual_repair(lines, blocks, overrides, full).unionByName(rp.scenario_repair(lines, blocks, overrides, full)))
    headers = kept(header_states(lines, blocks, overrides, full))
    years = kept(header_years(lines))
    release(lines, full)
    second = kept(fc.parsed(rp.rewritten(reports, first)))
    states = kept(rp.invariant_states(second, blocks, overrides))
    release(second)
    gated = states.filter("state = 'gated'")
    by_cell = kept(rp.invariant_cell_repair(gated))
    identity = kept(by_cell.withColumn("stage", F.lit("identity_cell")).unionByName(rp.invariant_block_repair(gated, by_cell).withColumn("stage", F.lit("identity_block"))))
    changes = first.withColumns({"stage": F.lit("consensus"), "period": F.lit(None).cast("string")}).unionByName(identity)
    naming = kept(rp.restating_lines(ln.line_context(rp.rewritten(reports, first, identity))))
    mappings = kept(scale_mappings(changes))
    values = kept(rp.restatement_values(rp.restatement_matches(naming, mappings)))
    release(naming)
    restated = kept(rp.restated_lines(values))
    said = restated.select("doc_id", F.lit("restatement").alias("stage"), F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("label"), "line_no", (F.col("new_won") / F.nullif("old_won", F.lit(0.0))).alias("factor"), "old_won", "new_won", "old_line", "new_line", F.lit(None).cast("double").alias("residual"))
    every = kept(changes.select(said.columns).unionByName(said))
    final = rp.rewritten(reports, first, identity, restated.withColumn("factor", F.lit(1.0)))
    checked = headers.filter("checked").select("doc_id", "year").unionByName(identity.select("doc_id", "year"))
    reviews = kept(review_ledger(rejected, headers, states, identity, unparsed_years(lines, checked, years), values.filter("status = 'review'")))
    return {"corrected": ln.reassemble(final), "changes": every, "review_items": reviews, "run_stats": document_stats(reports, headers, every, reviews)}


def document_stats(reports: DataFrame, headers: DataFrame, changes: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id, blocks_checked, corrections (years changed, restatements aside), cells_changed, restated, review_items,
    needs_review of every report."""
    count = lambda df, *c: df.groupBy("doc_id").agg(*c)
    own = F.col("stage") != "restatement"
    x = reports.select("doc_id").distinct()
    x = x.join(count(headers, F.count_if("checked").alias("blocks_checked")), "doc_id", "left")
    x = x.join(count(changes, F.count_distinct(F.when(own, F.struct("stage", "year", "period"))).alias("corrections"), F.count_if(own).alias("cells_changed"), F.count_if(~own).alias("restated")), "doc_id", "left")
    x = x.join(count(reviews, F.count("*").alias("review_items")), "doc_id", "left").na.fill(0, ["blocks_checked", "corrections", "cells_changed", "restated", "review_items"])
    return x.withColumn("needs_review", F.col("review_items") > 0)


def corpus_stats(stats: DataFrame, documents: DataFrame) -> DataFrame:
    """source, lang, docs, blocks_checked, corrections, cells_changed, restated, review_items, docs_in_review: document_stats
    summed by source and language (documents: doc_id, source, lang), by source, and over all (rollup; nulls where summed)."""
    sums = [F.sum(c).alias(c) for c in ("blocks_checked", "corrections", "cells_changed", "restated", "review_items")]
    return stats.join(documents.select("doc_id", "source", "lang"), "doc_id").rollup("source", "lang").agg(F.count("*").alias("docs"), *sums, F.count_if("needs_review").alias("docs_in_review"))

"""Consensus series in report lines: block bounds, dated entries, block years, and the value that holds for a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions.amounts import (
    CONSENSUS_HEADING, DATED_AMOUNT, HEADER, ISO_DATE, PROSE_DATED, PROSE_UNDATED, YEAR, cells, group, header_unit, leading, number, says, target_year, won,
)
from tallyproof.sources.tables import stored


def _marked(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line, is_heading (a consensus heading) and forecast_year (of a forecast header in that line)."""
    year = F.col("head_year") if "head_year" in lines.columns else leading(F.col("line"), HEADER)
    heading = F.col("line").contains("컨센서스") & F.col("line").rlike(CONSENSUS_HEADING)
    return lines.select("doc_id", "line_no", "line", heading.alias("is_heading"), year.alias("forecast_year"))


def numbered_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line, is_heading and forecast_year of the lines from each consensus heading to the next, with block_no
    and heading_line. One window by line; the other columns of the lines take no part in its sort."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = _marked(lines).withColumns({"block_no": F.sum(F.col("is_heading").cast("int")).over(so_far), "heading_line": F.last(F.when(F.col("is_heading"), F.col("line_no")), ignorenulls=True).over(so_far)})
    return x.filter("block_no > 0")


def block_bounds(lines: DataFrame) -> DataFrame:
    """doc_id, block_no, heading_line, stop_line (the first forecast header, else one past the last line), next_year."""
    x = numbered_blocks(lines)
    stop = F.min(F.when(~F.col("is_heading"), F.when(F.col("forecast_year").isNotNull(), F.col("line_no"))))
    after = F.min_by("forecast_year", F.when(~F.col("is_heading") & F.col("forecast_year").isNotNull(), F.col("line_no")))
    return x.groupBy("doc_id", "block_no").agg(F.min("line_no").alias("heading_line"), F.coalesce(stop, F.max("line_no") + 1).alias("stop_line"), after.alias("next_year"))


def block_lines(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line, block_no, heading_line of the lines inside the blocks, headings excluded, with the table state
    carried down: value column, its unit, the columns to check it against and their units, and the year its header names."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A block is over at its first forecast header: the last one so far stands below the block's heading.
    last_header = F.last(F.when(~F.col("is_heading") & F.col("forecast_year").isNotNull(), F.col("line_no")), ignorenulls=True).over(so_far)
    x = numbered_blocks(lines).withColumn("_passed", last_header).filter("not is_heading and not coalesce(_passed > heading_line, false)").drop("_passed")
    x = x.withColumn("_cells", F.when(F.col("line").contains("|"), cells(F.col("line"))))
    dated = F.col("_names_date")
    x = x.withColumn("_names_date", F.col("line").rlike("(?i)date|날짜"))
    x = x.withColumn("_is_header", F.coalesce(F.when(dated, F.exists("_cells", lambda c: c.rlike(r"(?i)^date\z") | c.contains("날짜"))), F.lit(False)))
    at = F.when(F.col("_is_header"), F.transform("_cells", lambda c, i: F.struct(i.alias("i"), c.alias("c"))))
    profit = F.filter(at, lambda s: s["c"].contains("영업이익") & ~s["c"].contains("률"))
    amount = F.filter(at, lambda s: s["c"].rlike("(?i)amount|금액"))
    x = x.withColumns({"_profit": profit, "_amount": amount})
    in_won = F.filter("_amount", lambda s: header_unit(s["c"]) == "원")
    chosen = F.when(F.size("_profit") == 1, F.get("_profit", F.lit(0))).when(F.size("_amount") <= 1, F.get("_amount", F.lit(0))).when(F.size(in_won) == 1, F.get(in_won, F.lit(0))).otherwise(F.get("_amount", F.lit(0)))
    others = F.when((F.size("_profit") != 1) & (F.size("_amount") > 1), F.transform(F.filter("_amount", lambda s: s["i"] != F.col("_chosen.i")), lambda s: F.struct(s["i"].alias("i"), header_unit(s["c"]).alias("unit"))))
    x = x.withColumn("_chosen", F.when(F.col("_is_header"), chosen))
    state = F.struct(F.col("_chosen.i").alias("i"), header_unit(F.col("_chosen.c")).alias("unit"), group(F.col("_chosen.c"), YEAR, 1).alias("year"), others.alias("others"))
    # Of the block: the last state so far of the document counts if it comes from there, so that one order of lines serves all.
    of_block = lambda c, s: F.last(F.when(c, F.struct(F.col("block_no").alias("b"), s.alias("s"))), ignorenulls=True).over(so_far)
    held = lambda c: F.when(F.col(f"{c}.b") == F.col("block_no"), F.col(f"{c}.s"))
    words = F.col("_cells").isNull() & dated & F.col("line").rlike(r"(?iU)\bdate\b|날짜") & F.col("line").rlike(r"(?iU)\bamount\b|금액|영업이익")
    x = x.withColumns({"_table": of_block(F.col("_is_header"), state), "_frame": of_block(words, header_unit(F.col("line")))})
    x = x.withColumns({"table": held("_table"), "frame_unit": F.coalesce(held("_frame"), F.lit("")), "candidate_year": target_year(F.col("line"))})
    return x.drop("_profit", "_amount", "_chosen", "_table", "_frame", "_names_date")


def entries(lines: DataFrame, inside: DataFrame | None = None, years: DataFrame | None = None) -> DataFrame:
    """doc_id, block_no, heading_line, line_no, entry_date, amount_won, declared_unit, source, and mismatch: rows whose
    unit columns disagree by more than 0.1 % keep their place with mismatch true and are no entries. inside: block_lines(lines), years: block_years(lines), if they are stored already.

    Each line is looked at once: it states an entry of a table, of a frame, dated ones in prose, or one without date, which
    counts where its block has no dated one.
    """
    x = inside if inside is not None else block_lines(lines)
    key = ("doc_id", "block_no", "heading_line", "line_no")
    row = F.col("_cells").isNotNull() & ~F.col("_is_header")
    x = x.withColumn("_date", F.when(row & F.get("_cells", F.lit(0)).rlike(f"^{ISO_DATE}$"), F.get("_cells", F.lit(0)).try_cast("date")))
    x = x.withColumn("_won", F.when(F.col("_date").isNotNull(), won(number(F.get("_cells", F.col("table.i"))), F.col("table.unit"))))
    checks = F.transform(F.filter("table.others", lambda o: ~F.coalesce(F.get("_cells", o["i"]), F.lit("-")).isin("", "-")), lambda o: won(number(F.get("_cells", o["i"])), o["unit"]))
    x = x.withColumn("_checks", F.when(F.col("_won").isNotNull(), checks))
    apart = F.exists("_checks", lambda v: F.abs(v - F.col("_won")) / F.greatest(F.lit(1.0), F.abs(v), F.abs("_won")) > 0.001)
    ruled = F.col("_date").isNotNull() & F.col("_won").isNotNull() & ~F.coalesce(F.exists("_checks", lambda v: v.isNull()), F.lit(False))

    def entry(date: Column, amount: Column, unit: Column, source: str, mismatch: Column = F.lit(False)) -> Column:
        return F.struct(date.alias("entry_date"), amount.alias("amount_won"), unit.alias("declared_unit"), F.lit(source).alias("source"), mismatch.alias("mismatch"))

    line = F.col("line")
    tabled = entry(F.col("_date"), F.col("_won"), F.coalesce(F.nullif(F.col("table.unit"), F.lit("")), F.lit("원")), "table", F.coalesce(apart, F.lit(False)))
    plain = ~F.col("_is_header") & (F.col("_cells").isNull() | ~line.rlike(ISO_DATE))
    framed = entry(F.regexp_extract(line, DATED_AMOUNT, 1).try_cast("date"), won(number(F.regexp_extract(line, DATED_AMOUNT, 2)), F.col("frame_unit")), F.coalesce(F.nullif(F.col("frame_unit"), F.lit("")), F.lit("원")), "frame")
    found = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(PROSE_DATED), F.lit(i)).alias(n) for i, n in enumerate(("y", "m", "d", "v", "u"), 1)])
    day = lambda f: F.concat_ws("-", f["y"], F.lpad(f["m"], 2, "0"), F.lpad(F.coalesce(F.nullif(f["d"], F.lit("")), F.lit("1")), 2, "0"))
    told = F.transform(found, lambda f: entry(day(f).try_cast("date"), won(number(f["v"]), f["u"]), f["u"], "prose_dated"))
    dated = F.when(ruled, F.array(tabled)).when(~plain, None).when(line.contains("-") & line.rlike(DATED_AMOUNT), F.array(framed)).when(line.contains("월") & line.rlike(PROSE_DATED), told)
    undated = F.when(line.contains("컨센서스") & line.rlike(PROSE_UNDATED), entry(F.lit(None).cast("date"), won(number(F.regexp_extract(line, PROSE_UNDATED, 1)), F.regexp_extract(line, PROSE_UNDATED, 2)), F.regexp_extract(line, PROSE_UNDATED, 2), "prose_consensus"))
    good = lambda e: (e["amount_won"] != 0) & (e["entry_date"].isNotNull() | (e["source"] == "prose_consensus"))
    said = F.concat(F.coalesce(F.filter(dated, good), F.array().cast(_ENTRIES)), F.coalesce(F.filter(F.array(undated), good), F.array().cast(_ENTRIES)))
    every = x.select(*key, F.explode(said).alias("e")).select(*key, "e.*")
    told_date = F.max(F.col("entry_date").isNotNull() & ~F.col("mismatch")).over(Window.partitionBy("doc_id", "block_no"))
    every = every.withColumn("_dated", told_date).filter("entry_date is not null or not _dated").drop("_dated")

    known = (years if years is not None else block_years(lines, inside)).select("doc_id", "block_no", F.col("explicit_year").alias("_year"))
    first = F.try_to_date(F.concat(F.coalesce("_year", F.lit("1970")), F.lit("-01-01")), "yyyy-MM-dd")
    return every.join(known, ["doc_id", "block_no"], "left").withColumn("entry_date", F.coalesce("entry_date", first)).select(*key, "entry_date", "amount_won", "declared_unit", "source", "mismatch")


_ENTRIES = "array<struct<entry_date: date, amount_won: double, declared_unit: string, source: string, mismatch: boolean>>"


def block_years(lines: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """doc_id, block_no, heading_line, explicit_year, forecast_year, year_source, year_conflict of every block.

    The heading's year, else the first year a line ties to the consensus; another such year is a conflict and leaves the
    block without one. Then the value column's year, then the next forecast's.
    """
    # Headings and forecast headers alone tell where blocks start and which forecast comes next.
    marks = _marked(lines).filter(F.col("is_heading") | F.col("forecast_year").isNotNull())
    own = F.when(F.col("is_heading"), group(F.col("line"), YEAR, 1))
    after = F.min_by("forecast_year", F.when(~F.col("is_heading"), F.col("line_no")))
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marks.select("doc_id", "line_no", "is_heading", "forecast_year", own.alias("_own")).withColumn("block_no", F.sum(F.col("is_heading").cast("int")).over(so_far)).filter("block_no > 0")
    heads = numbered.groupBy("doc_id", "block_no").agg(F.min("line_no").alias("heading_line"), after.alias("next_year"), F.max("_own").alias("_heading_year"))
    named = (inside if inside is not None else block_lines(lines)).groupBy("doc_id", "block_no").agg(
        F.min_by("candidate_year", F.when(F.col("candidate_year").isNotNull(), F.col("line_no"))).alias("_first"),
        F.collect_set("candidate_year").alias("_all"),
        F.max_by("table.year", F.when(F.col("_is_header"), F.col("line_no"))).alias("_column_year"),
    )
    x = heads.join(named, ["doc_id", "block_no"], "left")
    explicit = F.coalesce("_heading_year", "_first")
    x = x.withColumn("explicit_year", explicit).withColumn("year_conflict", F.coalesce(F.exists("_all", lambda y: y != F.col("explicit_year")), F.lit(False)))
    source = F.when(F.col("_heading_year").isNotNull(), "heading").when(F.col("_first").isNotNull(), "section_text").when(F.col("_column_year").isNotNull(), "value_column").when(F.col("next_year").isNotNull(), "next_forecast")
    year = F.when(~F.col("year_conflict"), F.coalesce("explicit_year", "_column_year", "next_year"))
    return x.select("doc_id", "block_no", "heading_line", "explicit_year", year.alias("forecast_year"), source.alias("year_source"), "year_conflict")


def blocks(lines: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """block_years with latest (struct of entry_date, amount_won, line_no; null if the block has no entry): by date,
    then line."""
    inside = inside if inside is not None else block_lines(lines)
    years = stored(block_years(lines, inside))
    last = entries(lines, inside, years).filter("not mismatch").groupBy("doc_id", "block_no").agg(F.max(F.struct("entry_date", "line_no", "amount_won")).alias("latest"))
    return years.join(last, ["doc_id", "block_no"], "left")


def latest_consensus(all_blocks: DataFrame) -> DataFrame:
    """doc_id, amount_won, entry_date of each document's last block, by position, that has a value and no conflict."""
    good = all_blocks.filter("latest is not null and not year_conflict")
    return good.groupBy("doc_id").agg(F.max_by("latest.amount_won", "block_no").alias("amount_won"), F.max_by("latest.entry_date", "block_no").alias("entry_date"))


def consensus_asof(targets: DataFrame, all_blocks: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """targets (doc_id, line_no, year) with consensus_won, consensus_date, consensus_line: an as-of join with fallbacks.

    The value that a document's request gives (overrides: doc_id, consensus_won; nulls do not count) holds for all its
    lines, without date and line. Else the latest preceding good block of the same year; none, if every preceding good block names a year; else the last
    preceding good block; else the last block of the document without a year.
    """
    b = all_blocks.filter("latest is not null").select("doc_id", "block_no", F.col("heading_line").alias("_at"), F.col("forecast_year").alias("_year"), F.col("year_conflict").alias("_conflict"), F.struct("latest.amount_won", "latest.entry_date", "heading_line").alias("_value"))
    good = (F.col("_at") <= F.col("line_no")) & ~F.col("_conflict")
    tiers = targets.select("doc_id", "line_no", "year").distinct().join(b, "doc_id", "left").groupBy("doc_id", "line_no", "year").agg(
        F.max_by("_value", F.when(good & (F.col("_year") == F.col("year")), F.col("block_no"))).alias("_same"),
        F.max_by("_value", F.when(good, F.col("block_no"))).alias("_before"),
        F.count_if(good).alias("_n"),
        F.coalesce(F.bool_and(F.when(good, F.col("_year").isNotNull())), F.lit(False)).alias("_all_named"),
        F.max_by("_value", F.when(F.col("_year").isNull(), F.col("block_no"))).alias("_unnamed"),
    )
    chosen = F.when(F.col("_same").isNotNull(), F.col("_same")).when((F.col("_n") > 0) & F.col("_all_named"), None).when(F.col("_n") > 0, F.col("_before")).otherwise(F.col("_unnamed"))
    found = tiers.withColumn("_v", chosen).select("doc_id", "line_no", "year", F.col("_v.amount_won").alias("consensus_won"), F.col("_v.entry_date").alias("consensus_date"), F.col("_v.heading_line").alias("consensus_line"))
    out = targets.join(found, ["doc_id", "line_no", "year"])
    if overrides is None:
        return out
    given = overrides.filter("consensus_won is not null").groupBy("doc_id").agg(F.max("consensus_won").alias("_given"))
    free = F.col("_given").isNull()
    out = out.join(given, "doc_id", "left").withColumns({"consensus_won": F.coalesce("_given", "consensus_won"), "consensus_date": F.when(free, F.col("consensus_date")), "consensus_line": F.when(free, F.col("consensus_line"))})
    return out.drop("_given")

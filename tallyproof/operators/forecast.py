"""Forecast headers, value cells and scenario blocks in report lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions.amounts import (
    ANNUAL, ANNUAL_LINE, FIRST_HALF, HALF_LINE, HEADER, LABELS, OUTLOOK, PERIOD_HEADER, SCENARIO_LINE, SECOND_HALF, SECTION_TITLE, leading, number, parts, says, won,
)

REACH = 15


_CELL = ("prefix", "value_text", "unit", "trailing", "won")


def _value(found: Column, *more: str) -> Column:
    """The value of a line with its surroundings from the text of the groups found (amounts.parts: more, then those of the cell);
    null where the line is none. In a lambda it stays out of the generated loop over the lines, which the JVM would not
    compile at its length."""
    names = (*more, *_CELL[:-1])

    def value(p: Column) -> Column:
        texts = {n: F.get(p, F.lit(i)) for i, n in enumerate(names, 1)}
        worth = won(number(F.nullif(texts["value_text"], F.lit(""))), texts["unit"])
        return F.struct(*[texts[n].alias(n) for n in names], worth.alias("won"))

    return F.get(F.transform(F.when(found.startswith("\n"), F.array(F.split(found, "\n", -1))), value), F.lit(0))


def parsed(lines: DataFrame) -> DataFrame:
    """lines with everything that patterns find in them, each tried once and only where the words that it needs are there:
    head_year (of a forecast header that starts the line), period_year and period_half (of a header of any period), is_title
    (a scenario-analysis title), and scenario, annual, half (value structs, null where the line is none). Lines parsed before
    pass unchanged."""
    if "scenario" in lines.columns:
        return lines
    line = F.col("line")
    colon, profit = says(line, ":", "："), line.contains("영업이익")
    x = lines.withColumns({
        "_scenario": F.when(says(line, *LABELS) & colon, parts(line, SCENARIO_LINE, 2, 1, 3, 4, 5)),
        "_outlook": line.contains(OUTLOOK) & line.contains("년"),
    })
    on = lambda found, c: F.when(F.col("_outlook") & found, c)
    halves = says(line, FIRST_HALF, SECOND_HALF)
    x = x.withColumns({
        "head_year": on(profit, leading(line, HEADER)), "period_year": on(profit | halves, leading(line, PERIOD_HEADER)), "period_half": on(halves, leading(line, PERIOD_HEADER, 2)),
        "_annual": on(profit & colon, parts(line, ANNUAL_LINE, 2, 1, 3, 4, 5)), "_half": on(halves & colon, parts(line, HALF_LINE, 2, 3, 1, 4, 5, 6)),
    })
    x = x.withColumns({"scenario": _value(F.col("_scenario"), "label"), "annual": _value(F.col("_annual"), "year"), "half": _value(F.col("_half"), "year", "period")})
    x = x.withColumn("is_title", line.contains(SECTION_TITLE) & F.col("annual").isNull())
    return x.select(*lines.columns, "scenario", "head_year", "period_year", "period_half", "annual", "half", "is_title")


def value_lines(lines: DataFrame, kind: str) -> DataFrame:
    """doc_id, line_no, line and year, period, label, prefix, value_text, unit, trailing, won of the lines of a kind:
    scenario, annual or half."""
    none = F.lit(None).cast("string")
    year = none if kind == "scenario" else F.col(f"{kind}.year")
    period = F.col("half.period") if kind == "half" else F.lit(ANNUAL if kind == "annual" else None).cast("string")
    label = F.col("scenario.label") if kind == "scenario" else none
    x = parsed(lines).filter(F.col(kind).isNotNull())
    return x.select("doc_id", "line_no", "line", year.alias("year"), period.alias("period"), label.alias("label"), *[F.col(f"{kind}.{c}").alias(c) for c in _CELL])


def headers(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line, year, is_annual (the header line holds the value itself), is_section (a scenario-analysis
    title) of the forecast headers that are concrete: no further header within nine lines before a scenario line."""
    x = parsed(lines).withColumns({"year": F.col("head_year"), "is_annual": F.col("annual").isNotNull(), "_scenario": F.col("scenario").isNotNull()})
    # Only headers and scenario lines matter to each other; lines are numbered without gaps, so nine lines are a range.
    x = x.filter("year is not null or _scenario").select("doc_id", "line_no", "line", "year", "is_annual", "is_title", "_scenario")
    ahead = Window.partitionBy("doc_id").orderBy("line_no").rangeBetween(1, 9)
    next_header = F.min(F.when(F.col("year").isNotNull() & ~F.col("_scenario"), F.col("line_no"))).over(ahead)
    next_scenario = F.min(F.when(F.col("_scenario"), F.col("line_no"))).over(ahead)
    nested = ~F.col("is_annual") & next_header.isNotNull() & (next_scenario.isNull() | (next_header < next_scenario))
    x = x.withColumn("_nested", nested).filter("year is not null and not _nested")
    return x.select("doc_id", "line_no", "line", "year", "is_annual", F.col("is_title").alias("is_section"))


def _blocks(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """For each header (doc_id, header_line, ...): the cells of the scenario block in the next lines, as a map by label.

    The block ends at its third label or at text that is no list item after the first hit; a repeated label counts with
    its last line.
    """
    cell = F.when(F.col("scenario").isNotNull(), F.struct("line_no", F.col("scenario.label").alias("label"), *[F.col(f"scenario.{c}").alias(c) for c in _CELL], "line"))
    text = F.col("scenario").isNull() & (F.trim("line") != "") & ~F.col("line").rlike(r"^\s*[-+*]")
    # A cell knows how many lines of text stand above it in its document: the same number for all cells that no text parts. So
    # the lines of a document are put in order without their text, and headers meet cells only.
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = parsed(lines).select("doc_id", "line_no", text.cast("int").alias("_text"), cell.alias("cell")).filter("_text = 1 or cell is not null")
    near = marks.withColumn("_above", F.sum("_text").over(so_far)).filter("cell is not null").drop("_text")
    # Headers are dealt as the window has dealt the cells, by document: neither the lines that they ask for nor the cells are
    # shuffled again.
    asks = heads.repartition("doc_id").withColumn("line_no", F.explode(F.sequence(F.col("header_line") + 1, F.col("header_line") + REACH)))
    joined = asks.join(near, ["doc_id", "line_no"])
    keys = heads.columns
    order = Window.partitionBy("doc_id", "header_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = Window.partitionBy("doc_id", "header_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    full = reduce(lambda a, b: a & b, [F.coalesce(F.max(F.col("cell.label") == label).over(past), F.lit(False)) for label in LABELS])
    joined = joined.withColumns({"_first": F.first("_above").over(order), "_full": full}).filter("_above = _first and not _full")
    names = zip(LABELS, ("up", "mid", "down"))
    return joined.groupBy(*keys).agg(*[F.max_by("cell", F.when(F.col("cell.label") == label, F.col("line_no"))).alias(name) for label, name in names])


def scenario_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, header_line, year, up, mid, down (cells) of the concrete headers with all three labels."""
    heads = headers(lines).filter("not is_section").select("doc_id", F.col("line_no").alias("header_line"), "year")
    return _blocks(heads, lines).filter("up is not null and mid is not null and down is not null")


def period_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, year, period (H1, H2, annual), header_line, up, mid, down: of each year and period the last full block."""
    half = F.col("period_half")
    period = F.when(half == FIRST_HALF, "H1").when(half.isNotNull(), "H2").otherwise("annual")
    heads = parsed(lines).withColumn("year", F.col("period_year")).filter("year is not null and not is_title")
    heads = heads.select("doc_id", F.col("line_no").alias("header_line"), "year", period.alias("period"))
    full = _blocks(heads, lines).filter("up is not null and mid is not null and down is not null")
    return full.groupBy("doc_id", "year", "period").agg(F.max_by(F.struct("header_line", "up", "mid", "down"), "header_line").alias("b")).select("doc_id", "year", "period", "b.*")


def identity_cells(lines: DataFrame) -> DataFrame:
    """doc_id, year, h1, h2, annual, residual, identity_ok where a document states all three; the last line of a kind
    counts. The sum is signed; two percent are tolerated."""
    cells = value_lines(lines, "half").unionByName(value_lines(lines, "annual"))

    def last(period: Column) -> Column:
        return F.max_by("won", F.when(period, F.col("line_no")))

    p = F.col("period")
    x = cells.groupBy("doc_id", "year").agg(last(p == FIRST_HALF).alias("h1"), last((p != FIRST_HALF) & (p != ANNUAL)).alias("h2"), last(p == ANNUAL).alias("annual"))
    x = x.filter("h1 is not null and h2 is not null and annual is not null")
    x = x.withColumn("residual", F.abs(F.col("h1") + F.col("h2") - F.col("annual")) / F.greatest(F.abs("annual"), F.abs(F.col("h1") + F.col("h2")), F.lit(1.0)))
    return x.withColumn("identity_ok", F.col("residual") <= 0.02)

"""Documents and lines: intake, numbering, reassembly, running line context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions.facts import LINE_END, trimmed


def intake(docs: DataFrame) -> DataFrame:
    """docs (text, consensus_won) with status: valid, blank_text or bad_consensus (zero, infinite or not a number)."""
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == "", F.lit(True))
    c = F.col("consensus_won")
    bad = c.isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")) | (c == 0))
    return docs.withColumn("status", F.when(blank, "blank_text").when(bad, "bad_consensus").otherwise("valid"))


def doc_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no (from 1), line, eol of every line; an end at the very end opens no further line."""
    text = F.coalesce("text", F.lit(""))
    ends = F.regexp_extract_all(text, F.lit(LINE_END), F.lit(0))
    pairs = F.arrays_zip(F.split(text, LINE_END, -1).alias("line"), ends.alias("eol"))
    rows = docs.select(key, F.posexplode(pairs).alias("p", "x")).select(key, (F.col("p") + 1).alias("line_no"), F.col("x.line").alias("line"), F.coalesce("x.eol", F.lit("")).alias("eol"))
    return rows.filter("not (eol = '' and line = '')")


def reassemble(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: the lines joined in order with their own ends."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line", "eol")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["line"], x["eol"])), "").alias("text"))


def line_context(lines: DataFrame) -> DataFrame:
    """lines with in_fence (inside a code fence, its marks included) and active_year: the year of the last line so far,
    outside fences, that names an operating profit and a forecast."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.ltrim("line").startswith("```")
    marks = F.sum(fence.cast("int")).over(so_far)
    x = lines.withColumn("in_fence", fence | (marks % 2 == 1))
    naming = ~F.col("in_fence") & F.col("line").contains("영업이익") & F.col("line").contains("전망")
    year = F.when(naming, F.nullif(F.regexp_extract("line", "20[0-9]{2}", 0), F.lit("")))
    return x.withColumn("active_year", F.last(year, ignorenulls=True).over(so_far))


def chunk_documents(lines: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, chunk_no, kind (paragraph or table_row), section, text, raw_text.

    Headings (# or numbered) open a section and make no chunk; before the first it is ``root``. Rows of pipes without
    other lines between them are a table: the first one names the columns, rules are skipped, every further row is a
    chunk ``column: cell | …``. Other lines without a blank one between them are a paragraph; one of more than ``most``
    characters is cut at line ends. raw_text is the text as it stands in the document.
    """
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clean = trimmed(F.col("line"))
    heading = F.col("_clean").startswith("#") | F.col("_clean").rlike(r"^[0-9]+(?:\.[0-9]+)*\.")
    titled = F.regexp_replace("_clean", r"(?U)^[#\s]+", "")
    title = F.coalesce(F.nullif(trimmed(F.regexp_replace(titled, r"(?U)^[0-9]+(?:\.[0-9]+)*\.\s*", "")), F.lit("")), titled)
    x = lines.withColumn("_clean", clean)
    x = x.withColumn("_kind", F.when(F.col("_clean") == "", "blank").when(heading, "heading").when(F.col("_clean").startswith("|"), "table_row").otherwise("paragraph"))
    x = x.withColumn("section", F.coalesce(F.last(F.when(F.col("_kind") == "heading", title), ignorenulls=True).over(so_far), F.lit("root")))
    # A run goes on while the kind stays the same.
    start = ~F.col("_kind").eqNullSafe(F.lag("_kind").over(Window.partitionBy("doc_id").orderBy("line_no")))
    x = x.withColumn("_run", F.sum(start.cast("int")).over(so_far)).filter("_kind in ('table_row', 'paragraph')")
    cells = F.transform(F.split(F.regexp_replace("_clean", r"^\|+|\|+$", ""), r"\|", -1), trimmed)
    x = x.withColumn("_cells", F.when(F.col("_kind") == "table_row", cells))
    real = (F.size("_cells") > 1) & ~F.forall("_cells", lambda c: c.rlike("^:?-+:?$"))
    x = x.withColumn("_real", real)
    in_run = Window.partitionBy("doc_id", "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.struct("line_no", F.col("_cells").alias("names"))
    x = x.withColumn("_head", F.first(F.when(F.col("_real"), first), ignorenulls=True).over(in_run))
    rows = x.filter("_kind = 'table_row' and _real and line_no > _head.line_no")
    pairs = F.filter(F.arrays_zip(F.col("_head.names").alias("h"), F.col("_cells").alias("c")), lambda p: (F.coalesce(p["h"], F.lit("")) != "") & (F.coalesce(p["c"], F.lit("")) != ""))
    said = F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit(": "), p["c"])), " | ")
    rows = rows.select("doc_id", "line_no", F.lit(0).alias("_part"), F.lit("table_row").alias("kind"), "section", F.when(said == "", F.col("_clean")).otherwise(said).alias("text"), F.col("line").alias("raw_text"))

    runs = x.filter("_kind = 'paragraph'").groupBy("doc_id", "_run").agg(F.first("section").alias("section"), F.array_sort(F.collect_list(F.struct("line_no", "_clean", "line"))).alias("_lines"))
    whole = F.struct(F.array_join("_lines._clean", "\n").alias("text"), F.array_join("_lines.line", "\n").alias("raw_text"))
    none = F.expr("struct(cast(null as string) as text, cast(null as string) as raw_text, 0 as n, cast(array() as array<struct<text: string, raw_text: string>>) as out)")

    def add(a: Column, s: Column) -> Column:
        n = F.length(s["_clean"])
        full = a["text"].isNotNull() & (a["n"] + n > most)
        opened = a["text"].isNull() | full
        return F.struct(
            F.when(opened, s["_clean"]).otherwise(F.concat(a["text"], F.lit("\n"), s["_clean"])).alias("text"), F.when(opened, s["line"]).otherwise(F.concat(a["raw_text"], F.lit("\n"), s["line"])).alias("raw_text"),
            (F.when(opened, 0).otherwise(a["n"]) + n + 1).alias("n"), F.when(full, F.array_append(a["out"], F.struct(a["text"].alias("text"), a["raw_text"].alias("raw_text")))).otherwise(a["out"]).alias("out"),
        )

    cut = F.aggregate("_lines", none, add, lambda a: F.array_append(a["out"], F.struct(a["text"].alias("text"), a["raw_text"].alias("raw_text"))))
    parts = F.when(F.length(whole["text"]) <= most, F.array(whole)).otherwise(cut)
    paragraphs = runs.select("doc_id", F.col("_lines")[0]["line_no"].alias("line_no"), "section", F.posexplode(parts).alias("_part", "_p"))
    paragraphs = paragraphs.select("doc_id", "line_no", "_part", F.lit("paragraph").alias("kind"), "section", F.col("_p.text").alias("text"), F.col("_p.raw_text").alias("raw_text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "_part"))
    return rows.unionByName(paragraphs).withColumn("chunk_no", number).select("doc_id", "chunk_no", "kind", "section", "text", "raw_text")


#: The columns of an export table, after a row number and a month.
EXPORT_COLUMNS = ("dram", "nand", "dram_kg", "nand_kg")


def export_rows(lines: DataFrame) -> DataFrame:
    """doc_id, period, line_no, dram, nand, dram_kg, nand_kg of the rows of export tables set in a text by white space; of
    a month's rows the last one in the document counts."""
    number = r"([0-9,]+)"
    pattern = rf"(?U)^\s*[0-9]+\s+(20[0-9]{{2}}-[0-9]{{2}})\s+{number}\s+{number}\s+{number}\s+{number}\s*$"
    value = lambda i: F.replace(F.regexp_extract("line", pattern, i), F.lit(","), F.lit("")).try_cast("bigint")
    x = lines.filter(F.col("line").rlike(pattern)).select("doc_id", "line_no", F.regexp_extract("line", pattern, 1).alias("period"), *[value(i).alias(n) for i, n in enumerate(EXPORT_COLUMNS, 2)])
    last = x.groupBy("doc_id", "period").agg(F.max_by(F.struct("line_no", *EXPORT_COLUMNS), "line_no").alias("r"))
    return last.select("doc_id", "period", "r.*")

"""Export amounts whose unit reads as a count of thousand dollars: found, tied to the raw value of the export table, and
written out in dollars with that raw value.

Spans, periods and raw values of a text are rows with positions. What is nearest to a span comes from two ordered passes
over these rows, one up and one down the text, so that no span is joined with all periods of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions.facts import to_tenths
from tallyproof.operators.lines import doc_lines, export_rows
from tallyproof.sources.tables import stored

#: The marks of export prose, the spans whose unit is in doubt, and the raw values in thousand dollars.
THOUSAND_USD = "천달러"
AMBIGUOUS = r"(?U)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(만\s*(?:달러)?(?:\s*\([^)]*천달러[^)]*\)|\s*천달러(?:\s*기준|\s*단위)?)?|백만\s*(?:천달러|달러)|억\s*(?:천달러|(?:달러|불)\s*(?:\([^)]*천달러[^)]*\)|(?=[^,\n)]{0,40}천달러\s*기준))))"
UNRESOLVED = r"(?U)[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:만천달러|만\s*천달러|백만\s*천달러|억\s*천달러|만달러\s*\(천달러)"
PERIOD = r"20[0-9]{2}[-/][0-9]{2}"
RAW = r"(?U)\b[1-9][0-9]{5,}\b"
RAW_IN_UNIT = r"(?U)\b[1-9][0-9]{0,2}(?:,[0-9]{3})+\b|\b[1-9][0-9]{5,}\b"
WEIGHT_UNIT = r"kg|KG|㎏|톤"
UNIT_VALUE = r"(?iU)(ASP\s*/\s*kg|단위가치|금액\s*/\s*중량)"
RANGE_START = r"(?U)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:→|->|~|-)\s*\z"
SUMMARY = r"(?U)([0-9][0-9,]*(?:\.[0-9]+)?)\s*억\s*(?:달러|불)"
WRITTEN = r"(?U)(약\s+[0-9][0-9,.]*\s*억\s*달러)\(원자료\s+([0-9,]+천달러)\)"
LEAST_RAW, MOST_RAW = 100_000, 99_999_999
REACH = 100

_KEY = ["doc_id", "atom_id", "kind"]


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def scale_of(unit: Column) -> Column:
    """Thousand dollars in one of the displayed unit."""
    return F.when(unit.contains("백만"), 1e6).when(unit.contains("억"), 1e5).otherwise(1e4)


def thousand_usd(value: Column, inside: Column) -> Column:
    """A raw value in thousand dollars as hundred millions of dollars, with the raw value behind it; without brackets of its
    own where it stands ``inside`` some."""
    short = F.regexp_replace(F.format_number(to_tenths(value / F.lit(100_000.0)), 1), r"\.0$", "")
    raw = F.format_number(value, 0)
    return F.when(inside, F.concat(F.lit("약 "), short, F.lit("억 달러, 원자료 "), raw, F.lit("천달러"))).otherwise(F.concat(F.lit("약 "), short, F.lit("억 달러(원자료 "), raw, F.lit("천달러)")))


def flattened(text: Column) -> Column:
    """``text`` without brackets within brackets around raw values."""
    gaps, tokens = F.split(text, WRITTEN, -1), F.regexp_extract_all(text, F.lit(WRITTEN), F.lit(0))
    before = lambda i: F.concat(F.array_join(F.slice(gaps, 1, i + 1), ""), F.array_join(F.slice(tokens, 1, i), ""))
    bare = F.transform(tokens, lambda t, i: F.when(_count(before(i), "(") > _count(before(i), ")"), F.regexp_replace(t, WRITTEN, "$1, 원자료 $2")).otherwise(t))
    return F.array_join(F.zip_with(gaps, bare, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def raw_values(text: Column) -> Column:
    """array of the raw values of the usual size in ``text``, in its order."""
    values = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW), F.lit(0)), lambda t: t.try_cast("bigint"))
    return F.filter(values, lambda v: v.between(LEAST_RAW, MOST_RAW))


def raw_in_unit(unit: Column, shown: Column) -> Column:
    """The raw value inside a span's unit: the one nearest the number shown, the first if none is near; null without one."""
    found = F.filter(F.transform(F.regexp_extract_all(unit, F.lit(RAW_IN_UNIT), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("bigint")), lambda v: v.between(LEAST_RAW, MOST_RAW))
    gap = lambda v: F.when(unit.contains("억") & unit.contains(THOUSAND_USD), F.least(F.abs(v / scale_of(unit) - shown), F.abs(v / F.lit(1e6) - shown))).otherwise(F.abs(v / scale_of(unit) - shown))
    best = F.array_min(F.transform(found, lambda v, i: F.struct(gap(v).alias("d"), i.alias("i"), v.alias("v"))))
    near = (F.coalesce(shown, F.lit(0.0)) != 0) & (best["d"] <= F.greatest(F.lit(2.0), F.abs(shown) * 0.03))
    return F.when(near, best["v"]).otherwise(F.get(found, F.lit(0)))


def from_display(shown: Column, unit: Column, context: Column) -> Column:
    """The raw value that a displayed number of ten thousands or millions of thousand dollars stands for."""
    told = unit.contains(THOUSAND_USD) | context.contains(THOUSAND_USD)
    return F.when(told & ~unit.contains("억") & (shown > 0), F.rint(shown * scale_of(unit)).cast("bigint"))


def positions(texts: DataFrame, pattern: str) -> DataFrame:
    """key columns, start, end (characters from 0), token of every match of ``pattern`` in texts (key, text): running sums
    over the pieces between the matches."""
    pieces = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("token"))
    x = texts.filter(F.col("text").rlike(pattern)).select(*_KEY, F.posexplode(pieces).alias("_i", "_p"))
    order = Window.partitionBy(*_KEY).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("_p.gap") + F.coalesce(F.length("_p.token"), F.lit(0))).over(order)
    x = x.withColumn("end", end.cast("int")).filter("_p.token is not null")
    return x.select(*_KEY, (F.col("end") - F.length("_p.token")).alias("start"), "end", F.col("_p.token").alias("token"))


def nearest_period(spans: DataFrame, periods: DataFrame) -> DataFrame:
    """spans (key, start, end, token, ...) with period: the last one that ends before the span, if at most ``REACH`` characters
    before; else one that overlaps it; else the nearest that follows within that reach; else empty.

    Spans and periods are merged by where they begin: going up, a span takes the last period begun, which knows the one
    ahead of it; going down, the next one. Periods do not overlap each other.
    """
    of_text = Window.partitionBy(*_KEY)
    at = F.struct("start", "end", F.replace("token", F.lit("/"), F.lit("-")).alias("period"))
    p = periods.select(*_KEY, F.col("start").alias("_place"), at.alias("_at"))
    p = p.withColumns({"_prior": F.lag("_at").over(of_text.orderBy("_place")), "_span": F.lit(None).cast(spans.select(F.struct(*spans.columns).alias("s")).schema["s"].dataType)})
    s = spans.select(*_KEY, F.col("start").alias("_place"), F.struct(*spans.columns).alias("_span"))
    rows = p.unionByName(s, allowMissingColumns=True)
    side = F.col("_span").isNotNull()
    up = of_text.orderBy("_place", side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = of_text.orderBy(F.desc("_place"), side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.withColumn("_b", F.last(F.when(~side, F.struct("_at", "_prior")), ignorenulls=True).over(up)).withColumn("_n", F.last("_at", ignorenulls=True).over(down))
    x = x.filter(side).select("_span.*", "_b", "_n")
    over = F.col("_b._at.end") > F.col("start")
    before = F.when(over, F.col("_b._prior")).otherwise(F.col("_b._at"))
    ended = F.when(F.col("start") - before["end"] <= REACH, before["period"])
    inside = F.coalesce(F.when(over, F.col("_b._at.period")), F.nullif(F.replace(F.regexp_extract("token", PERIOD, 0), F.lit("/"), F.lit("-")), F.lit("")))
    follows = F.when(F.col("_n.start") - F.col("end") <= REACH, F.col("_n.period"))
    return x.withColumn("period", F.coalesce(ended, inside, follows, F.lit(""))).drop("_b", "_n")


def ambiguous_spans(texts: DataFrame) -> DataFrame:
    """texts with start, end, token, number (as shown), unit of every span whose unit is in doubt; whether it tells a weight
    or a value by unit; metric: the last one that its clause names, else the text around it, else DRAM; and what an edit
    needs of the surroundings."""
    x = positions(texts, AMBIGUOUS).join(texts, _KEY)
    x = x.withColumns({"number": F.regexp_extract("token", AMBIGUOUS, 1), "unit": F.regexp_extract("token", AMBIGUOUS, 2), "_before": F.expr("substring(text, 1, start)"), "_behind": F.expr("substring(text, end + 1)")})
    clause = lambda left, right: F.concat(F.regexp_extract("_before", left, 0), F.col("token"), F.regexp_extract("_behind", right, 0))
    told = clause(r"[^,:.\n]*\z", r"^[^,.\n]*")
    near = F.expr("right(_before, 24)").contains("중량") & F.expr("left(_behind, 32)").rlike(WEIGHT_UNIT)
    weight = F.lower(F.expr("left(_behind, 8)")).rlike(r"^(kg|㎏|톤)") | near | (told.contains("중량") & told.rlike(WEIGHT_UNIT))
    last = lambda c: F.nullif(F.regexp_extract(c, r"(?s)^.*(NAND|DRAM)", 1), F.lit(""))
    metric = F.coalesce(last(clause(r"[^\n+\-:]*\z", r"^[^\n.,]*")), last(F.concat(F.expr("right(_before, 80)"), F.expr("left(_behind, 40)"))), F.lit("DRAM"))
    x = x.withColumns({"_weight": weight, "_unit_value": told.rlike(UNIT_VALUE), "metric": metric, "_tail": F.expr("right(_before, 29)"), "_head": F.expr("left(_behind, 32)"), "_depth": _count(F.col("_before"), "(") - _count(F.col("_before"), ")")})
    return x.drop("_before", "_behind")


def _with_raw(x: DataFrame) -> DataFrame:
    """x with in_unit and in_text: the raw value inside the unit; else the nearest of the statement's raw values that no
    span ahead has taken. A fold over the spans of one statement."""
    x = x.withColumn("_shown", _plain(F.col("number"))).withColumn("in_unit", raw_in_unit(F.col("unit"), F.col("_shown")))
    asked = x.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", *[c for c in x.columns if c not in (*_KEY, "start", "raws", "text")]))).alias("_s"), F.first("raws").alias("_raws"), F.first("text").alias("text"))
    begin = F.expr("struct(cast(array() as array<int>) as used, cast(array() as array<bigint>) as found)")

    def take(a: Column, s: Column) -> Column:
        left = F.filter(F.transform(F.col("_raws"), lambda v, i: F.struct(F.abs(v / scale_of(s["unit"]) - s["_shown"]).alias("d"), i.alias("i"), v.alias("v"))), lambda c: ~F.array_contains(a["used"], c["i"]))
        best = F.array_min(left)
        hit = s["in_unit"].isNull() & (best["d"] <= F.greatest(F.lit(2.0), F.abs(s["_shown"]) * 0.03))
        return F.struct(F.when(hit, F.array_append(a["used"], best["i"])).otherwise(a["used"]).alias("used"), F.array_append(a["found"], F.when(hit, best["v"])).alias("found"))

    both = F.arrays_zip(F.col("_s").alias("s"), F.aggregate("_s", begin, take)["found"].alias("v"))
    return asked.select(*_KEY, "text", F.explode(both).alias("_z")).select(*_KEY, "text", "_z.s.*", F.col("_z.v").alias("in_text"))


def _table_rows(statements: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, atom_id, period, row of the export tables in an atom's statement, else its chunk, else its quote."""
    inside = lambda df, key: export_rows(doc_lines(df.select(F.struct(*key).alias("doc_id"), "text"))).select(*[F.col(f"doc_id.{k}").alias(k) for k in key], "period", F.struct("dram", "nand").alias("row"))
    own = ["doc_id", "atom_id"]
    sources = [
        inside(statements.select(*own, F.col("statement").alias("text")), own).withColumn("_tier", F.lit(0)),
        inside(chunks.select("doc_id", "chunk_no", F.col("raw_text").alias("text")), ["doc_id", "chunk_no"]).join(statements.select(*own, "chunk_no"), ["doc_id", "chunk_no"]).select(*own, "period", "row", F.lit(1).alias("_tier")),
        inside(statements.select(*own, F.col("source_quote").alias("text")), own).withColumn("_tier", F.lit(2)),
    ]
    rows = sources[0].unionByName(sources[1]).unionByName(sources[2])
    return rows.groupBy(*own, "period").agg(F.min_by("row", "_tier").alias("row"))


def export_values(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """key, text, start, end, token, value, source of the spans that a source tells: unit (a raw value in its brackets), text
    (one of the statement's raw values), table (the export row of its period and metric), display (the number shown).
    Weights and values by unit are left out. texts: key, text, raws; rows: doc_id, atom_id, period, row."""
    spans = ambiguous_spans(texts).filter("not _weight and not _unit_value")
    x = nearest_period(_with_raw(spans), positions(texts, PERIOD)).join(rows, ["doc_id", "atom_id", "period"], "left")
    table = F.when(F.col("metric") == "NAND", F.col("row.nand")).otherwise(F.col("row.dram"))
    context = F.concat(F.expr("right(_tail, 12)"), F.col("token"), F.col("_head"))
    tiers = (("unit", F.col("in_unit")), ("text", F.col("in_text")), ("table", table), ("display", from_display(F.col("_shown"), F.col("unit"), context)))
    source = F.coalesce(*[F.when(v.isNotNull(), n) for n, v in tiers])
    return x.withColumns({"value": F.coalesce(*[v for _, v in tiers]), "source": source}).filter("value is not null")


def _edits(x: DataFrame) -> DataFrame:
    """key, text, edits (start, end, new, source): each span, and the number before it where the span ends a range."""
    about = F.expr("right(_tail, 2)") == "약 "
    inside = (F.col("_depth") > 0) | ((F.expr("right(_tail, 1)") == "(") & (F.expr("left(_head, 1)") == ")"))
    own = F.struct((F.col("start") - F.when(about, 2).otherwise(0)).alias("start"), "end", thousand_usd(F.col("value"), inside).alias("new"), "source")
    reach = F.expr("right(_tail, 28)")
    whole, number = F.regexp_extract(reach, RANGE_START, 0), F.regexp_extract(reach, RANGE_START, 1)
    at = (F.col("start") - F.length(whole)).cast("int")
    # What stands right behind the number is white space or the range mark, which the pattern sees to.
    ahead = F.col("_tail").substr(F.lit(1), F.length("_tail") - F.length(whole))
    free = (number != "") & ~F.substring(ahead, -1, 1).rlike(r"[0-9A-Za-z가-힣.]")
    context = F.concat(whole, F.col("token"), F.col("_head"))
    first = F.when(free, F.coalesce(raw_in_unit(F.col("unit"), _plain(number)), from_display(_plain(number), F.col("unit"), context)))
    opened = F.col("_depth") - _count(whole, "(") + _count(whole, ")") > 0
    range_ = F.when(first.isNotNull(), F.struct(at.alias("start"), (at + F.length(number)).cast("int").alias("end"), thousand_usd(first, opened).alias("new"), F.lit("range").alias("source")))
    return x.select(*_KEY, "text", F.explode(F.array_compact(F.array(range_, own))).alias("edit"))


def _rewritten(edits: DataFrame) -> DataFrame:
    """key, text, corrected, sources: the texts with their edits made."""
    x = edits.groupBy(*_KEY, "text").agg(F.array_sort(F.collect_list("edit")).alias("_e"))
    start = lambda i: F.when(i == 0, 0).otherwise(F.coalesce(F.get("_e", i - 1)["end"], F.lit(0)))
    pieces = F.transform("_e", lambda e, i: F.concat(F.substr(F.col("text"), start(i) + 1, e["start"] - start(i)), e["new"]))
    last = F.element_at("_e", -1)["end"]
    return x.select(*_KEY, "text", F.concat(F.array_join(pieces, ""), F.substr(F.col("text"), last + 1, F.length("text"))).alias("corrected"), F.transform("_e", lambda e: e["source"]).alias("sources"))


def _summaries(texts: DataFrame) -> DataFrame:
    """key, corrected, sources of sums in thousand dollars that are told as hundred millions of dollars."""
    told = F.col("text").contains("천달러 기준 합계") & F.col("text").contains("수출금액") & ~F.col("text").rlike(r"(?U)\b[1-9][0-9]{0,2}(?:,[0-9]{3})+\b") & F.col("text").rlike(SUMMARY)
    new = F.transform(F.regexp_extract_all("text", F.lit(SUMMARY), F.lit(1)), lambda n: thousand_usd(F.rint(_plain(n) * 1e6).cast("bigint"), F.lit(False)))
    corrected = F.array_join(F.zip_with(F.split("text", SUMMARY, -1), new, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
    return texts.filter(told).select(*_KEY, corrected.alias("corrected"), F.transform(new, lambda _: F.lit("summary")).alias("sources"))


def export_unit_resolution(statements: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, atom_id, corrected_statement, suggested_quote, sources, status of the statements (doc_id, atom_id, chunk_no,
    statement, source_quote, target_text) whose export units can be told, with chunks (doc_id, chunk_no, raw_text).

    A statement is looked at if it, its quote or its chunk speaks of thousand dollars. status: corrected, or unresolved where
    the corrected statement still holds a unit in doubt (then nothing is suggested). suggested_quote is the target text
    corrected by the same values, else the corrected statement. Null texts count as empty; statements without a change have
    no row; a statement's key must be its own. The statements looked at and the corrected texts are written once, as
    several steps read them.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    s = statements.select("doc_id", "atom_id", "chunk_no", *[text(c).alias(c) for c in ("statement", "source_quote", "target_text")])
    s = s.join(chunks.select("doc_id", "chunk_no", "raw_text"), ["doc_id", "chunk_no"], "left")
    told = F.concat_ws("\n", "source_quote", "raw_text", "statement").contains(THOUSAND_USD) & F.concat("statement", "source_quote").rlike("만|억")
    own = raw_values(F.col("statement"))
    s = s.filter(told).withColumn("raws", F.when(F.size(own) > 0, own).otherwise(raw_values(F.col("source_quote")))).drop("raw_text")
    s = stored(s)
    parts = F.array(F.struct(F.lit("statement").alias("kind"), F.col("statement").alias("text")), F.struct(F.lit("target").alias("kind"), F.col("target_text").alias("text")))
    texts = s.select("doc_id", "atom_id", "raws", F.explode(parts).alias("_t")).select("doc_id", "atom_id", "_t.kind", "_t.text", "raws")
    done = stored(_rewritten(_edits(export_values(texts, _table_rows(s, chunks)))).filter("corrected <> text").drop("text"))
    done = stored(done.unionByName(_summaries(texts.join(done.select(*_KEY), _KEY, "left_anti"))))
    left = ambiguous_spans(done.select(*_KEY, F.col("corrected").alias("text"))).filter(~F.col("unit").contains("원자료") & ~F.col("_weight")).select(*_KEY).distinct()
    done = done.join(left.withColumn("_left", F.lit(True)), _KEY, "left").withColumn("_open", F.col("_left").isNotNull() | F.col("corrected").rlike(UNRESOLVED)).drop("_left")
    both = done.groupBy("doc_id", "atom_id").agg(*[F.max(F.when(F.col("kind") == k, F.struct("corrected", "sources", "_open"))).alias(n) for k, n in (("statement", "_s"), ("target", "_t"))])
    ok = ~F.col("_s._open")
    quote = F.coalesce("_t.corrected", "_s.corrected")
    return both.filter("_s is not null").select("doc_id", "atom_id", F.when(ok, F.col("_s.corrected")).alias("corrected_statement"), F.when(ok, quote).alias("suggested_quote"), F.col("_s.sources").alias("sources"), F.when(ok, "corrected").otherwise("unresolved").alias("status"))

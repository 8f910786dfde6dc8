"""Fact atoms: statements read from the chunks of reports, coerced, merged and flagged.

An atom has doc_id, chunk_no, ord (its place in the document), statement, source_quote, subject, metric, value, unit,
period, polarity, confidence, section, unit_type, extraction_rule, mandatory.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions import facts as fx
from tallyproof.functions.facts import KOREAN, Lexicon
from tallyproof.operators.passes import ordered_pass

_KEY = ("doc_id", "chunk_no")
_RECORD = "struct<sentence:int,rule:int,at:int,statement:string,source_quote:string,metric:string,value:string,unit:string,period:string,unit_type:string,extraction_rule:string,confidence:double>"


def _record(place: tuple, statement: Column, quote: Column, metric: Column, value: Column, period: Column, unit_type: str, rule: str, confidence: float, lx: Lexicon) -> Column:
    sentence, order, at = place
    return F.struct(
        sentence.cast("int").alias("sentence"), F.lit(order).alias("rule"), at.cast("int").alias("at"), fx.trimmed(statement).alias("statement"), fx.trimmed(quote).alias("source_quote"),
        fx.trimmed(metric).alias("metric"), fx.trimmed(value).alias("value"), fx.unit_of(value, lx).alias("unit"), fx.trimmed(period).alias("period"),
        F.lit(unit_type).alias("unit_type"), F.lit(rule).alias("extraction_rule"), F.lit(confidence).alias("confidence"),
    )


def _atoms(chunks: DataFrame, records: Column) -> DataFrame:
    """One row for each record of each chunk, in the order of sentence, rule and place."""
    x = chunks.select(*_KEY, "section", F.explode(records.cast(f"array<{_RECORD}>")).alias("r")).select(*_KEY, "section", "r.*")
    return x.withColumns({"subject": F.lit(""), "polarity": F.lit("unknown"), "mandatory": F.lit(True)})


def table_atoms(chunks: DataFrame, lx: Lexicon = KOREAN) -> DataFrame:
    """An atom for each further ``header: value`` of a table-row chunk. A first cell under a title column names the
    metric; a header is a period only if it looks like one. Null and empty texts have none."""
    cells = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), r"\|", -1), lambda p: p.contains(":")), lambda p: F.struct(fx.trimmed(F.substring_index(p, ":", 1)).alias("k"), fx.trimmed(F.regexp_replace(p, "(?s)^[^:]*:", "")).alias("v")))
    cells = F.filter(cells, lambda c: (c["k"] != "") & (c["v"] != ""))
    x = chunks.filter("kind = 'table_row'").withColumn("_cells", cells).filter("size(_cells) >= 2")
    x = x.withColumn("_metric", F.when(F.col("_cells")[0]["k"].isin(*lx.row_titles), F.col("_cells")[0]["v"]).otherwise(F.col("_cells")[0]["k"]))

    def one(c: Column, i: Column) -> Column:
        period = F.when(F.size(fx.periods_in(c["k"], lx)) > 0, c["k"]).otherwise("")
        said = F.concat(F.when(period != "", F.concat(period, F.lit(" "))).otherwise(""), F.col("_metric"), F.lit("은 "), c["v"], F.lit("이다."))
        return F.when(~fx.is_empty_cell(c["v"]), _record((F.lit(0), 0, i), said, F.col("text"), F.col("_metric"), c["v"], period, "metric_value", "table_metric_value", 1.0, lx))

    return _atoms(x, F.array_compact(F.transform(F.slice("_cells", 2, 1 << 20), one)))


def literal_rows(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, section, list_no, row_no, period and entries (array of key, value as text) of the lists of
    records written into a chunk's text as literals, if a record has a date. Quotes of either kind are read; a list that
    is no literal is skipped whole."""
    lists = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?s)\[\s*\{.*?\}\s*\]"), F.lit(0)), lambda s: s.rlike(r"""['"][Dd]ate['"]"""))
    as_json = F.regexp_replace(F.regexp_replace(F.col("_src"), r"(?<=[\[{,:\s])'|'(?=\s*[,:}\]])", '"'), r"(?<=[:\s])(None|True|False)(?=\s*[,}\]])", '"$1"')
    rows = F.from_json(as_json, "array<map<string,string>>")
    x = chunks.select(*_KEY, "section", F.posexplode(lists).alias("list_no", "_src")).select(*_KEY, "section", "list_no", F.posexplode(rows).alias("row_no", "_row"))
    named = [F.nullif(F.try_element_at("_row", F.lit(n)), F.lit("")) for n in ("Date", "date", "기간")]
    return x.select(*_KEY, "section", "list_no", "row_no", fx.trimmed(F.coalesce(*named)).alias("period"), F.map_entries("_row").alias("entries")).filter("period <> ''")


def literal_atoms(chunks: DataFrame, lx: Lexicon = KOREAN) -> DataFrame:
    """An atom for each value of each literal row."""
    x = literal_rows(chunks).select("*", F.posexplode("entries").alias("_i", "e"))
    x = x.filter(~(F.lower(fx.trimmed(F.col("e.key"))) == "date") & (fx.trimmed(F.col("e.key")) != "기간") & (fx.trimmed(F.col("e.key")) != "") & ~fx.is_empty_cell(F.coalesce("e.value", F.lit("None"))))
    key, value = fx.trimmed(F.col("e.key")), fx.trimmed(F.coalesce("e.value", F.lit("None")))
    at = F.col("list_no") * 1_000_000 + F.col("row_no") * 1000 + F.col("_i")
    said = F.concat(F.col("period"), F.lit(" "), key, F.lit("은 "), value, F.lit("이다."))
    quote = F.concat(F.lit("{"), F.array_join(F.transform("entries", lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), F.coalesce(e["value"], F.lit("None")), F.lit("'"))), ", "), F.lit("}"))
    return _atoms(x, F.array(_record((F.lit(-1), 0, at), said, quote, key, value, F.col("period"), "metric_value", "structured_list_metric_value", 1.0, lx)))


def text_atoms(chunks: DataFrame, lx: Lexicon = KOREAN) -> DataFrame:
    """An atom for each sentence, metric and value of the paragraph chunks."""
    x = chunks.filter("kind <> 'table_row'").select(*_KEY, "section", F.posexplode(fx.sentences(F.coalesce("text", F.lit("")), lx)).alias("_n", "_sentence"))
    x = x.withColumns({"_periods": F.array_join(fx.periods_in(F.col("_sentence"), lx), ", "), "_plain": fx.without_literals(F.col("_sentence"))})
    x = x.withColumns({"_metrics": fx.metrics_in(F.col("_plain"), lx), "_values": fx.metric_values(F.col("_plain"), lx)})
    x = x.select("*", F.posexplode(F.flatten(F.transform("_metrics", lambda m: F.filter("_values", lambda v: (v["metric"] == m) & (v["value"] != m))))).alias("_i", "f"))
    return _atoms(x, F.array(_record((F.col("_n"), 0, F.col("_i")), fx.statement_of(F.col("f.metric"), F.col("f.value"), F.col("_periods")), F.col("_plain"), F.col("f.metric"), F.col("f.value"), F.col("_periods"), "metric_value", "text_metric_value", 0.95, lx)))


def marker_atoms(chunks: DataFrame, lx: Lexicon = KOREAN) -> DataFrame:
    """An atom for each sentence and kind of marker in it: forecast or opinion, trend or comparison, cause."""
    x = chunks.filter("kind <> 'table_row'").select(*_KEY, "section", F.posexplode(fx.sentences(F.coalesce("text", F.lit("")), lx)).alias("_n", "_s"))
    x = x.withColumns({"_periods": F.array_join(fx.periods_in(F.col("_s"), lx), ", "), "_metric": F.coalesce(F.get(fx.metrics_in(F.col("_s"), lx), F.lit(0)), F.lit(""))})
    kinds = (("forecast_or_opinion", f"(?i){lx.forecast}"), ("trend_or_comparison", lx.trend), ("causal_driver", f"(?i){lx.causal}"))
    rows = [F.when(F.col("_s").rlike(p), _record((F.col("_n"), k, F.lit(0)), F.col("_s"), F.col("_s"), F.col("_metric"), F.lit(""), F.col("_periods"), name, f"{name}_statement", 0.9, lx)) for k, (name, p) in enumerate(kinds, 1)]
    return _atoms(x, F.array_compact(F.array(*rows)))


def mandatory_atoms(chunks: DataFrame, lx: Lexicon = KOREAN) -> DataFrame:
    """All rule-made atoms of the chunks with ord, their place in the document from 1."""
    every = table_atoms(chunks, lx).unionByName(literal_atoms(chunks, lx)).unionByName(text_atoms(chunks, lx)).unionByName(marker_atoms(chunks, lx))
    order = Window.partitionBy("doc_id").orderBy("chunk_no", "sentence", "rule", "at")
    return every.withColumn("ord", F.row_number().over(order)).drop("sentence", "rule", "at")


_FIELDS = ("unit_type", "metric", "value", "period", "source_quote")
_FILLED = ("statement", "source_quote", "subject", "metric", "value", "unit", "period", "polarity", "section", "unit_type", "extraction_rule")


def merge_atoms(atoms: DataFrame) -> DataFrame:
    """One atom for each document, chunk and normalised statement, numbered a001, a002, … by first place.

    In order of place: a record with more filled fields takes the one before it over, and what is blank in either is
    filled from the other; richness is judged after filling, so this is a fold and no ranking. Blank statements drop.
    A group holds the mentions of one sentence in one chunk.
    """
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in _FILLED]
    item = F.struct("ord", *fields, "confidence", "mandatory")
    x = atoms.withColumn("_key", fx.key_text(F.coalesce("statement", F.lit("")))).filter("_key <> ''")
    x = x.groupBy("doc_id", "chunk_no", "_key").agg(F.array_sort(F.collect_list(item)).alias("_items"))

    def rich(r: Column) -> Column:
        return sum((fx.trimmed(r[f]) != "").cast("int") for f in _FIELDS)

    def filled(first: Column, second: Column, place: Column) -> Column:
        return F.struct(place.alias("ord"), *[F.when(fx.trimmed(first[f]) == "", second[f]).otherwise(first[f]).alias(f) for f in _FILLED], first["confidence"].alias("confidence"), first["mandatory"].alias("mandatory"))

    merged = F.aggregate(F.slice("_items", 2, 1 << 20), F.col("_items")[0], lambda a, b: F.when(rich(b) > rich(a), filled(b, a, a["ord"])).otherwise(filled(a, b, a["ord"])))
    x = x.select("doc_id", "chunk_no", merged.alias("m")).select("doc_id", "chunk_no", "m.*")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return x.withColumn("atom_id", F.concat(F.lit("a"), F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), F.lit("0"))))


#: The longest text of a field.
LIMITS = {"statement": 1000, "source_quote": 1000, "subject": 200, "metric": 160, "value": 120, "unit": 80, "period": 120, "section": 200, "unit_type": 80, "extraction_rule": 120}


def coerce_atoms(raw: DataFrame, lx: Lexicon = KOREAN) -> DataFrame:
    """raw (doc_id, ord, id, and text fields that may be null) as atoms: trimmed and cut, polarity one of four,
    confidence within 0 and 1 (0 if it is no number), conclusion_like; atom_id is a well-formed id of its own, else the
    place's number. Rows without a statement drop; of rows with one id the first keeps it."""
    x = raw.withColumns({f: F.substring(fx.trimmed(F.coalesce(F.col(f), F.lit(""))), 1, n) for f, n in LIMITS.items()}).filter("statement <> ''")
    polarity = F.lower(fx.trimmed(F.coalesce("polarity", F.lit(""))))
    sure = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    x = x.withColumns({
        "polarity": F.when(polarity.isin("positive", "negative", "neutral", "unknown"), polarity).otherwise("unknown"),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(sure), 1.0).otherwise(sure))),
        "conclusion_like": fx.is_conclusion(F.col("statement"), lx) | (F.col("unit_type") == "forecast_or_opinion"),
        "_own": F.when(fx.trimmed(F.coalesce("id", F.lit(""))).rlike("^a[0-9]{3,}$"), fx.trimmed(F.col("id"))),
    }).drop("id")
    return x.join(_numbered(x), ["doc_id", "ord"]).drop("_own")


def _numbered(rows: DataFrame) -> DataFrame:
    """doc_id, ord, atom_id: in order, the own id if it is free, else the first free number from the row's place (or from
    the one after it, where the own id is taken)."""

    def start():
        used: set[str] = set()
        onward: dict[int, int] = {}  # from a taken number to one that may be free
        place = 0

        def name(own: str | None) -> str:
            nonlocal place
            place += 1
            if own is not None and own not in used:
                used.add(own)
                return own
            n, seen = place + (own is not None), []
            while f"a{n:03d}" in used:
                seen.append(n)
                n = onward.get(n, n + 1)
            onward.update(dict.fromkeys(seen, n))
            used.add(f"a{n:03d}")
            return f"a{n:03d}"

        return name

    return ordered_pass(rows.select("doc_id", "ord", "_own"), ["doc_id"], ["ord"], ["_own"], start, "atom_id", "string", pa.string()).drop("_own")


def seed_atoms(findings: DataFrame, most: int = 80, lx: Lexicon = KOREAN) -> DataFrame:
    """findings (doc_id, ord, claim, statement, display, evidence) as atoms where no graph was made: of a document's
    first ``most`` those that are not hidden, with the statement, else the claim."""
    first = findings.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).filter(F.col("_k") <= most)
    said = F.coalesce(F.nullif(fx.trimmed(F.coalesce("statement", F.lit(""))), F.lit("")), fx.trimmed(F.coalesce("claim", F.lit(""))))
    x = first.filter(F.coalesce("display", F.lit(True))).withColumn("_said", said).filter("_said <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("string")
    return x.select("doc_id", F.concat(F.lit("a"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))).alias("atom_id"), F.substring("_said", 1, 500).alias("statement"), F.substring(F.coalesce("evidence", F.lit("")), 1, 500).alias("source_quote"), F.lit("unknown").alias("polarity"), F.lit(0.0).alias("confidence"))


def chunks_pending(chunks: DataFrame, atoms: DataFrame, rows: int = 8) -> DataFrame:
    """The chunks (doc_id, chunk_no, kind) that the rules have not covered: no table row with an atom, and no chunk with
    a literal list and ``rows`` atoms or more."""
    done = atoms.groupBy(*_KEY).agg(F.count("*").alias("_n"), F.bool_or(F.col("extraction_rule") == "structured_list_metric_value").alias("_list"))
    covered = F.col("_n").isNotNull() & ((F.col("kind") == "table_row") | (F.col("_list") & (F.col("_n") >= rows)))
    return chunks.join(done, list(_KEY), "left").filter(~covered).drop("_n", "_list")


# ------------------------------------------------------------------ suspects


def marked(atoms: DataFrame, reason: str, when: Column) -> DataFrame:
    """atoms with ``reason`` added to suspect_reasons (array, distinct) where the condition holds, and suspect."""
    before = F.coalesce(F.col("suspect_reasons"), F.array().cast("array<string>")) if "suspect_reasons" in atoms.columns else F.array().cast("array<string>")
    reasons = F.when(F.coalesce(when, F.lit(False)), F.array_union(before, F.array(F.lit(reason)))).otherwise(before)
    return atoms.withColumn("suspect_reasons", reasons).withColumn("suspect", F.size("suspect_reasons") > 0)


def conflict_arbitration(atoms: DataFrame, spread: float = 0.2, close: float = 0.05) -> DataFrame:
    """atoms (doc_id, ord, metric, period, value, statement) with amount, status and certified: where values of one
    metric and period lie further apart than ``spread``, all are ``conflict``; but a profit conflict is settled by the
    document's first revenue times its first margin: values within ``close`` of it are ``certified``, the others
    ``wrong``, if there are both. Other atoms have no status. Aggregates of the groups join back."""
    x = atoms.withColumns({"_metric": fx.key_text(F.coalesce("metric", F.lit(""))), "_period": fx.key_text(F.coalesce("period", F.lit(""))), "amount": fx.comparable(F.col("value"), F.col("statement"))})
    first = x.groupBy("doc_id").agg(
        F.min_by("amount", F.when(F.col("_metric").contains("매출액") & F.col("amount").isNotNull(), F.col("ord"))).alias("_revenue"),
        F.min_by("amount", F.when(F.col("_metric").rlike("영업이익[률율]") & F.col("amount").isNotNull(), F.col("ord"))).alias("_margin"),
    ).withColumn("certified", F.col("_revenue") * F.col("_margin") / 100.0).select("doc_id", F.when(F.col("certified") > 0, F.col("certified")).alias("certified"))
    key = ["doc_id", "_metric", "_period"]
    near = F.abs(F.col("amount") - F.col("certified")) / F.col("certified") <= close
    groups = x.filter("amount is not null and _metric <> ''").join(first, "doc_id").groupBy(*key).agg(
        ((F.max("amount") - F.min("amount")) / F.nullif(F.max(F.abs("amount")), F.lit(0.0))).alias("_spread"), F.count("*").alias("_n"), F.count_if(near).alias("_good"), F.first("certified").alias("certified")
    ).filter(f"_n > 1 and _spread > {spread}")
    profit = F.col("_metric").contains("영업이익") & ~F.col("_metric").rlike("[률율]")
    settled = profit & F.col("certified").isNotNull() & (F.col("_good") > 0) & (F.col("_good") < F.col("_n"))
    groups = groups.select(*key, F.when(settled, F.col("certified")).alias("certified"), F.lit(True).alias("_hit"))
    y = x.join(groups, key, "left")
    status = F.when(F.col("_hit") & F.col("amount").isNotNull(), F.when(F.col("certified").isNull(), "conflict").when(near, "certified").otherwise("wrong"))
    return y.withColumn("status", status).withColumn("certified", F.when(F.col("status").isNotNull(), F.col("certified"))).drop("_metric", "_period", "_hit")


def margin_inputs(atoms: DataFrame) -> DataFrame:
    """doc_id, ord, atom_id, period (normalised) and margin, revenue, profit: what a statement says of each, else null."""
    s = F.coalesce("statement", F.lit(""))
    return atoms.select(
        "doc_id", "ord", "atom_id", fx.key_text(F.coalesce("period", F.lit(""))).alias("period"), F.when(fx.is_margin(s), fx.percent_in(s)).alias("margin"),
        F.when(s.contains("매출액"), F.nullif(fx.amount_after(s, "매출액"), F.lit(0.0))).alias("revenue"),
        F.when(s.contains("영업이익") & ~s.contains("영업이익률"), fx.amount_after(s, "영업이익")).alias("profit"),
    )


def best_margin_pairs(atoms: DataFrame) -> DataFrame:
    """doc_id, margin_id, margin, revenue_id, profit_id, computed, residual: of every stated margin the revenue and
    profit of its period (of any, if it names none) that come nearest, first atoms on ties.

    Profits and revenues meet by document and period; blank margins meet all of their document's.
    """
    x = margin_inputs(atoms)
    m = x.filter("margin is not null").select("doc_id", F.col("atom_id").alias("margin_id"), "margin", F.col("period").alias("_p"))
    r = x.filter("revenue is not null").select("doc_id", F.col("atom_id").alias("revenue_id"), "revenue", F.col("ord").alias("_ro"), F.col("period").alias("_p"))
    o = x.filter("profit is not null").select("doc_id", F.col("atom_id").alias("profit_id"), "profit", F.col("ord").alias("_po"), F.col("period").alias("_p"))
    named = m.filter("_p <> ''").join(r, ["doc_id", "_p"]).join(o, ["doc_id", "_p"])
    blank = m.filter("_p = ''").drop("_p").join(r.drop("_p"), "doc_id").join(o.drop("_p"), "doc_id")
    y = named.drop("_p").unionByName(blank).filter("margin_id <> revenue_id and margin_id <> profit_id")
    y = y.withColumn("computed", F.col("profit") / F.col("revenue") * 100.0).withColumn("residual", F.abs(F.col("computed") - F.col("margin")))
    best = y.groupBy("doc_id", "margin_id").agg(F.min_by(F.struct("margin", "revenue_id", "profit_id", "computed", "residual"), F.struct("residual", "_ro", "_po")).alias("b"))
    return best.select("doc_id", "margin_id", "b.*")


def margin_mismatch(atoms: DataFrame, points: float = 0.5) -> DataFrame:
    """The margins that even the nearest revenue and profit miss by more than ``points``."""
    return best_margin_pairs(atoms).filter(F.col("residual") > points).select("doc_id", "margin_id", "margin", "computed")


def atom_counts(chunks: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc_id, chunks, atoms, mandatory of every document with a chunk."""
    a = atoms.groupBy("doc_id").agg(F.count("*").alias("atoms"), F.count_if("mandatory").alias("mandatory"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")).join(a, "doc_id", "left").na.fill(0, ["atoms", "mandatory"])

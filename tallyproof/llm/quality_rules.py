"""Quality rules: text statistics and cross-document line frequency, in built-in functions only.

Method: normalised lines are hashed, the distinct documents of each host that hold a line are counted,
lines above the limit are taken out, and a document that loses too much is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyproof.llm.common import GAP, checkpointed, word_array


@dataclass(frozen=True)
class LineRules:
    """min_words, repeat_percent: base rule. A line is above the limit if more than min_documents distinct
    documents of its host hold it, and more than share_percent of them. A document is depleted if less than
    keep_percent of its words stay."""

    min_words: int = 50
    repeat_percent: int = 50
    min_documents: int = 5
    share_percent: int = 5
    keep_percent: int = 50


def _repeated_words() -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Window hashes carry their position in the low bits (as many as the length needs), so one sort of primitive longs
    brings equal windows together: n log n for the longest text, no shuffle. Where cut hashes agree and whole ones do
    not, which a text of a million words may see, whole hashes and positions are sorted instead.
    """
    spots = """
        filter(_sorted, (x, j) -> coalesce(shiftright(get(_sorted, j - 1), _bits) = shiftright(x, _bits), false)
                               or coalesce(shiftright(get(_sorted, j + 1), _bits) = shiftright(x, _bits), false))"""
    at = "cast(x & (shiftleft(1L, _bits) - 1L) as int)"
    before = "cast(get(_sorted, j - 1) & (shiftleft(1L, _bits) - 1L) as int)"
    mixed = f"""
        exists(transform(_sorted, (x, j) -> coalesce(shiftright(get(_sorted, j - 1), _bits) = shiftright(x, _bits), false)
                                            and get(_hashes, {at}) <> get(_hashes, {before})), v -> v)"""
    whole = """
        transform(filter(_pairs, (x, j) -> coalesce(get(_pairs, j - 1).h = x.h, false) or coalesce(get(_pairs, j + 1).h = x.h, false)), x -> x.i)"""
    exact = f"""
        element_at(transform(array(array_sort(transform(_hashes, (h, i) -> named_struct('h', h, 'i', i)))), _pairs -> {whole}), 1)"""
    return F.expr(f"""
        aggregate(
          array_sort(case when {mixed} then {exact} else transform({spots}, x -> {at}) end),
          named_struct('last', -3, 'n', 0),
          (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)),
          a -> cast(a.n as long))""")


def _window_hashes() -> Column:
    return F.expr("""
        case when size(_words) < 4 then cast(array() as array<bigint>) else
          transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) end""")


def text_statistics(docs: DataFrame, cfg: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts have no words: all counts are 0 and base_failed is true. Columns of ``docs`` keep their names,
    whatever these are, but for those named like results, which are replaced.
    """
    names = [n for n in docs.columns if n not in STATISTICS]
    own = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    t = F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    x = own.withColumn("_words", word_array(t)).withColumns({"_hashes": _window_hashes(), "_bits": F.expr("greatest(1, cast(ceil(log2(size(_words) + 1)) as int) + 1)")})
    x = x.withColumn("_sorted", F.expr("sort_array(transform(_hashes, (h, i) -> shiftleft(shiftright(h, _bits), _bits) | cast(i as bigint)))")).withColumn("_lines", lines)
    out = x.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)],
        F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.when(t.rlike("[#*$%&|<>]"), F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), _repeated_words().alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < cfg.min_words) | (100 * F.col("n_repeat_words") > cfg.repeat_percent * F.col("n_words")))


def normalised_line(line: Column) -> Column:
    """Lower case, words joined by one space, digits as 0; empty if the line has no word."""
    low = F.lower(line)
    spaced = F.trim(F.when(low.rlike("[\\t-\\r]|  "), F.regexp_replace(low, GAP + "+", " ")).otherwise(low))
    return F.when(spaced.rlike("[1-9]"), F.regexp_replace(spaced, "[1-9]", "0")).otherwise(spaced)


def line_key(line: Column) -> Column:
    """128 bits for a normalised line, as 10**10 lines share 64 too often."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(7)).alias("b"))


def _document_key(host: Column, text: Column) -> Column:
    whole = (F.coalesce(host, F.lit("\0")), F.coalesce(text, F.lit("")))
    return F.struct(F.xxhash64(*whole).alias("a"), F.xxhash64(*whole, F.lit(7)).alias("b"))


def document_lines(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """One row for each distinct normalised line of each distinct (host, text): host_key, doc_key, line_key, n_words (of
    all its repeats in one such text). Exact copies within a host are one document.

    Copies meet by a mark in each row's lines, whose count is the number of copies.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), normalised_line), lambda x: x != "")
    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(host), F.lit("\0")).alias("host_key"), _document_key(F.col(host), F.col(text)).alias("doc_key"), F.explode(lines).alias("line"))
    words = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    rows = rows.select("host_key", "doc_key", line_key(F.col("line")).alias("line_key"), words.alias("w"))
    # Repeats and copies meet here: the first grouping is by document too, so a common line has many keys.
    return rows.groupBy("host_key", "line_key", "doc_key").agg(F.sum("w").alias("n_words_all"))


def copy_counts(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """doc_key, n_copies of each (host, text) held by more than one row. No text is shuffled."""
    keys = docs.filter(F.col(text).isNotNull()).select(_document_key(F.col(host), F.col(text)).alias("doc_key"))
    return keys.groupBy("doc_key").agg(F.count("*").alias("n_copies")).filter("n_copies > 1")


def frequent_lines(lines: DataFrame, cfg: LineRules = LineRules()) -> DataFrame:
    """host_key, line_key, n_docs of the lines above their host's limit."""
    counted = lines.groupBy("host_key", "line_key").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > cfg.min_documents)
    hosts = lines.groupBy("host_key", "doc_key").agg(F.lit(1).alias("_one")).groupBy("host_key").agg(F.count("*").alias("host_docs"))
    return counted.join(hosts, "host_key").filter(100 * F.col("n_docs") > cfg.share_percent * F.col("host_docs")).select("host_key", "line_key", "n_docs")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
VERDICTS = ("n_line_words", "n_line_docs", "kept")


def lost_words(docs: DataFrame, cfg: LineRules, host: str, text: str) -> DataFrame:
    """doc_key, n_line_words, n_line_docs and line_keys (array) of the distinct texts that hold frequent lines. The lines
    of all documents are written once, as keys, and read for the counts and for the join."""
    lines = checkpointed(document_lines(docs, host, text))
    hot = frequent_lines(lines, cfg)
    lost = lines.join(hot, ["host_key", "line_key"]).groupBy("doc_key").agg(F.sum("n_words_all").alias("_lost"), F.max("n_docs").alias("n_line_docs"), F.collect_set("line_key").alias("line_keys"))
    # Copies have the same lines, so the division leaves no rest.
    copies = copy_counts(docs, host, text)
    return checkpointed(lost.join(copies, "doc_key", "left").select("doc_key", F.expr("_lost div coalesce(n_copies, 1)").alias("n_line_words"), "n_line_docs", "line_keys"))


def _judged(docs: DataFrame, cfg: LineRules, host: str, text: str) -> DataFrame:
    """The columns of docs as r0, r1, ... beside the statistics, the verdict and the keys of its frequent lines. They stand
    alone, so that those not asked for, the text above all, are left out of the join."""
    own = docs.select(*[F.col(f"`{n}`").alias(f"r{i}") for i, n in enumerate(docs.columns)], F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("host"))
    lost = lost_words(own, cfg, "host", "text")
    stated = text_statistics(own, cfg, "text").withColumn("doc_key", _document_key(F.col("host"), F.col("text"))).join(lost, "doc_key", "left")
    stated = stated.withColumns({"n_line_words": F.coalesce("n_line_words", F.lit(0)).cast("long"), "n_line_docs": F.coalesce("n_line_docs", F.lit(0)).cast("long")})
    stays = 100 * (F.col("n_words") - F.col("n_line_words")) >= cfg.keep_percent * F.col("n_words")
    return stated.withColumn("kept", ~F.col("base_failed") & stays)


def judge_documents(docs: DataFrame, cfg: LineRules = LineRules(), host: str = "source", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with the statistics, n_line_words (words in removed lines), n_line_docs (documents of
    the most frequent one) and kept.

    Null host: one host of its own. Null or empty text: no lines, base_failed, not kept. Repeated rows get the
    same judgement each. Columns of ``docs`` named like results are replaced; all others stay, whatever their names.
    """
    results = (*STATISTICS, *VERDICTS)
    names = docs.columns
    own = [F.col(f"r{i}").alias(n) for i, n in enumerate(names) if n not in results]
    return _judged(docs, cfg, host, text).select(*own, *results)


def remove_frequent_lines(docs: DataFrame, cfg: LineRules = LineRules(), host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, frequent lines taken out of their texts, with the columns of ``docs``.

    A text without a frequent line is returned byte for byte. Null and empty texts go; repeated rows are judged each.
    """
    names = docs.columns
    # Written first: a filter on kept would be pushed below the statistics and compute them anew for each condition.
    judged = checkpointed(_judged(docs, cfg, host, text).select(*[f"r{i}" for i in range(len(names))], "kept", "line_keys")).filter("kept")
    t = F.col(f"r{names.index(text)}")
    rest = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.array_contains("line_keys", line_key(normalised_line(x)))), "\n")
    clean = F.when(F.col("line_keys").isNotNull(), rest).otherwise(t)
    return judged.select(*[(clean if n == text else F.col(f"r{i}")).alias(n) for i, n in enumerate(names)])

"""Queries on proposed corrections, pins, premises, verdict rows and review rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.operators import atoms as at, graph as gr, review as rv
from tallyproof.plans.atoms import atoms_of
from tallyproof.plans.registry import query
from tallyproof.sources.facts import fact_views, with_facts


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact_views(spark, sf_dir)
    return spark.sql("select *, (doc_id + year) % 7 as c, concat(year, '년 매출액은 ', rev, '억원이다.') as said from figures")


_CASES = "(select *, (doc_id + year) % 7 as c, year || '년 매출액은 ' || rev || '억원이다.' as said from figures)"


@query("""select o_custkey as doc_id, o_orderkey as line_no from orders where o_orderkey % 3 = 0""")
def malformed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as report lines; every third is damaged in one of three ways."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"i": F.col("o_orderkey"), "v": F.format_number("o_totalprice", 0)})
    line = F.when(F.col("i") % 9 == 0, F.concat(F.lit("매출 "), "v", F.lit("%2063억원"))).when(F.col("i") % 9 == 3, F.concat("v", F.lit(" % 7"))).when(F.col("i") % 9 == 6, F.concat(F.lit("5%"), "v"))
    line = F.coalesce(line, F.when(F.col("i") % 2 == 0, F.concat("v", F.lit("% 성장"))).otherwise(F.concat("v", F.lit("억원, 7%"))))
    return rv.malformed_amounts(o.select(F.col("o_custkey").alias("doc_id"), F.col("i").alias("line_no"), line.alias("line"))).select("doc_id", "line_no")


@query(with_facts("""select doc_id, atom_id, case when row_number() over (partition by doc_id order by ord) <= 2 then 'candidate' else 'overflow' end as status from atoms where metric = '영업이익' and ord % 3 <> 0 and ord % 4 <> 0"""))
def suspect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third atom is pinned already, every fourth is no suspect."""
    a = atoms_of(spark, sf_dir).withColumn("_n", F.substring("atom_id", 2, 9).cast("int"))
    return rv.suspect_candidates(a.withColumns({"suspect": F.col("_n") % 4 != 0, "ord": F.col("_n")}), a.filter("_n % 3 = 0"), 2)


@query(with_facts(f"""select doc_id, year::int as year, case c when 1 then 'same' when 2 then 'lines' when 3 then 'table' when 4 then 'length' when 5 then 'numbers' else 'ok' end as status, true as actionable from {_CASES}"""))
def rewrite_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.expr("concat(year, '년 매출액은 ', rev + 1, '억원이다.')")
    c = F.col("c")
    suggested = F.when(c == 1, F.col("said")).when(c == 2, F.concat(right, F.lit("\n또한"))).when(c == 3, F.concat(right, F.lit(" |"))).when(c == 4, F.concat(right, F.repeat(F.lit("가"), 700))).when(c == 5, F.replace(right, F.lit("억원"), F.lit("억원, 9999999명"))).otherwise(right)
    x = _figures(spark, sf_dir).select("doc_id", F.col("year").cast("int").alias("year"), F.col("said").alias("original"), F.col("said").alias("original_statement"), suggested.alias("suggested"), right.alias("corrected_statement"))
    return rv.rewrite_validation(x).select("doc_id", "year", "status", "actionable")


@query(with_facts(f"""select doc_id, year::int as year, case c when 0 then 'unchanged' when 1 then 'undecided' when 2 then 'common_sense' when 3 then 'label_swap' else 'accepted' end as status, c = 6 as affirms_original from {_CASES}"""))
def judgment_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario statements: the upper value may become ten times itself, or by mistake the lower one's."""
    said = "concat('상방 ', {0}, '억원, 중간: ', rev * 2, '억원, 하방 ', rev, '억원')"
    reason = F.expr("case c when 1 then '근거 부족으로 후보만 제시' when 2 then '도메인 상식에 맞지 않음' when 4 then '도메인 상식과 원문 계산' when 6 then '원문의 수치가 정확하다' else '산술 계산' end")
    proposed = F.expr(f"case c when 0 then '  ' when 3 then {said.format('rev')} else {said.format('rev * 30')} end")
    x = _figures(spark, sf_dir).select("doc_id", F.col("year").cast("int").alias("year"), F.expr(said.format("rev * 3")).alias("original"), proposed.alias("proposed"), reason.alias("reason"))
    return rv.judgment_acceptance(x).select("doc_id", "year", "status", "affirms_original")


@query(with_facts(f"""select doc_id, year::int as year, case c % 3 when 0 then '보고서는 ' || year || '년 매출액 ' || rev + 1 || '억원(추정)을 말한다.' when 1 then '올해 ' || rev + 1 || '억원, 전년 ' || rev || '7억원' end as merged from {_CASES}"""))
def value_transplant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's own sentence; one where the number also is part of a larger one; one without it."""
    quote = F.expr("case c % 3 when 0 then concat('보고서는 ', year, '년 매출액 ', rev, '억원(추정)을 말한다.') when 1 then concat('올해 ', rev, '억원, 전년 ', rev, '7억원') else '매출액은 그대로다.' end")
    x = _figures(spark, sf_dir).select("doc_id", F.col("year").cast("int").alias("year"), F.col("said").alias("original_statement"), F.expr("concat(year, '년 매출액은 ', rev + 1, '억원이다.')").alias("corrected_statement"), quote.alias("quote"))
    return rv.value_transplant(x).select("doc_id", "year", "merged")


@query(with_facts(f"select doc_id, year::int as year, c not in (1, 2, 5) as is_restatement from {_CASES}"))
def pin_restatement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions with the new value in the old unit; with another amount changed too; with new words; in a unit of its
    own; with a line end; without given values."""
    text = "concat(year, '년 영업이익은 ', format_number(rev * 100000000, 0), '원, 매출은 7조원이다.')"
    new = "concat(year, '년 영업이익은 ', format_number(rev * 1000000000, 0), '원, 매출은 {0}조원이다.')"
    suggested = F.expr(f"case c when 1 then {new.format(8)} when 2 then concat({new.format(7)}, ' 확인함') when 3 then concat({new.format(7)}, '\n') when 5 then {text} else {new.format(7)} end")
    x = _figures(spark, sf_dir).select("doc_id", F.col("year").cast("int").alias("year"), F.expr(text).alias("original"), suggested.alias("suggested"), F.expr("case when c <> 4 then rev * 1e8 end").alias("old_won"), F.expr("rev * 1e9").alias("new_won"),
                                       F.expr("concat('영업이익 ', rev, '억원')").alias("original_statement"), F.expr("concat('영업이익 ', rev, '0억원')").alias("corrected_statement"))
    return rv.pin_restatement_check(x).select("doc_id", "year", "is_restatement")


@query("""select doc_id, md5(coalesce(list_filter(l, lambda x: contains(x, s) or contains(s, x))[1], text)) as span from (
  select doc_id, text, l, coalesce(l[1 + len(l) // 2], '') as s from (select doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as l from documents))""")
def target_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line in the middle of each document, looked for in the whole of it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = rv._full_lines(F.coalesce("text", F.lit("")))
    x = d.select("doc_id", F.coalesce(F.get(lines, F.floor(F.size(lines) / 2).cast("int")), F.lit("")).alias("statement"), F.lit("").alias("quote"), F.col("text").alias("chunk_text"))
    return rv.target_span(x).select("doc_id", F.md5("span").alias("span"))


def _tenths(x: str) -> str:
    """DuckDB's expression for a positive double, one or more, rounded half to even at its exact binary value, which is a
    whole number of 2**-52."""
    twice = f"(({x} * 4503599627370496)::hugeint * 20 + 4503599627370496)"
    return f"(({twice} // 9007199254740992) - case when {twice} % 9007199254740992 = 0 then {twice} // 9007199254740992 % 2 else 0 end)::double / 10.0"


@query(with_facts(f"""
, m as (select a.doc_id, a.atom_id, f.year, f.rev, f.op, (f.m10 + 20) / 10.0::double as new, abs(f.op::double / f.rev * 100.0 - f.m10 / 10.0) <= 0.15 as exact from atoms a join figures f on a.doc_id = f.doc_id and a.year = f.year where what = 'margin'),
t as (select *, new / 100.0 * rev as x_op, op / (new / 100.0) as x_rev from m where exact),
o as (select *, {_tenths('x_op')} as new_op, {_tenths('x_rev')} as new_rev from t),
p as (select doc_id, atom_id, 'profit' as role, op::double as old_value, new_op as new_value, year || '년 영업이익은 ' || format('{{:,}}', round_even(new_op, 0)::bigint) || '억원이다.' as suggested from o where abs(new_op / rev * 100.0 - new) <= 0.15
      union all select doc_id, atom_id, 'revenue', rev, new_rev, year || '년 매출액은 ' || format('{{:,}}', round_even(new_rev, 0)::bigint) || '억원이다.' from o where new_rev > 0 and abs(op / new_rev * 100.0 - new) <= 0.15)
select doc_id, atom_id, role, old_value, new_value, round(abs(new_value - old_value) / old_value, 9) as rel_change, suggested, (row_number() over (partition by doc_id, atom_id order by abs(new_value - old_value) / old_value, role))::int as rank, count(*) over (partition by doc_id, atom_id) >= 2 as underdetermined from p""").replace(")\n\n, m as", "),\nm as"))
def premise_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every margin corrected by two points, with the premises that the text's own sentences or table state."""
    a = atoms_of(spark, sf_dir)
    margins = a.filter("metric = '영업이익률'").select("doc_id", "atom_id", F.regexp_replace("statement", r"[0-9.]+%", F.lit("")).alias("_"), F.concat(F.lit("영업이익률은 "), ((F.regexp_extract("value", r"([0-9.]+)", 1).cast("double") * 10 + 20).cast("bigint") / 10).cast("string"), F.lit("%이다.")).alias("corrected_statement"))
    quoted = a.withColumn("source_quote", F.col("statement"))
    exact = gr.relation_edges(a).filter("confidence = 0.95D")
    x = rv.premise_options(margins.drop("_"), exact, quoted)
    return x.select("doc_id", "atom_id", "role", "old_value", "new_value", F.round("rel_change", 9).alias("rel_change"), "suggested", F.col("rank").cast("int").alias("rank"), "underdetermined")


# ------------------------------------------------------------------ verdict rows

_BATCHES = "select o_custkey as doc_id, o_orderkey % 3 as batch_no, o_orderkey as atom_id, o_orderkey % 5 = 0 as is_context from orders"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), (i % 3).alias("batch_no"), i.alias("atom_id"), (i % 5 == 0).alias("is_context"))


def _responses(batches: DataFrame) -> DataFrame:
    """Two rows for most atoms, of which the second counts; none for every seventh; rows for atoms of other batches."""
    i = F.col("atom_id")
    b = batches.filter("atom_id % 7 <> 0")
    said = F.element_at(F.array(*map(F.lit, ("keep", " Correct", "review", "maybe"))), (i % 4 + 1).cast("int"))
    rows = b.select("doc_id", "batch_no", F.lit(2).alias("ord"), i.alias("atom_id"), said.alias("verdict"), F.concat(F.lit(" why "), i).alias("reason"))
    return rows.unionByName(b.select("doc_id", "batch_no", F.lit(1).alias("ord"), i.alias("atom_id"), F.lit("keep").alias("verdict"), F.lit("old").alias("reason"))).unionByName(rows.withColumn("batch_no", F.col("batch_no") + 1))


@query(f"""select doc_id, batch_no, atom_id, case when atom_id % 7 = 0 then 'missing' when is_context then 'keep' else ['keep', 'correct', 'review', 'review'][(atom_id % 4 + 1)::int] end as verdict, case when atom_id % 7 = 0 then '' else 'why ' || atom_id end as reason from ({_BATCHES})""")
def judgment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _batches(spark, sf_dir)
    return rv.judgment_rows(b, _responses(b))


@query(f"select doc_id, batch_no, atom_id from ({_BATCHES}) where atom_id % 7 = 0")
def response_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _batches(spark, sf_dir)
    return rv.response_missing_ids(b, _responses(b))


@query(f"""select doc_id, atom_id, case when atom_id % 2 = 0 and atom_id % 3 = 0 then 'rule,verdict' when atom_id % 2 = 0 then 'rule' when atom_id % 3 = 0 then 'verdict' else '' end as reasons, atom_id % 2 = 0 or atom_id % 3 = 0 as suspect from ({_BATCHES})""")
def suspect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second atom is suspect by rule; verdicts add every third, twice, and one for an atom that is not there."""
    a = at.marked(_batches(spark, sf_dir).select("doc_id", "atom_id"), "rule", F.col("atom_id") % 2 == 0)
    v = a.select("doc_id", "atom_id", (F.col("atom_id") % 3 == 0).alias("suspect"), F.lit("verdict ").alias("reason"))
    x = rv.suspect_verdicts(a, v.unionByName(v).unionByName(v.withColumn("atom_id", -F.col("atom_id"))))
    return x.select("doc_id", "atom_id", F.array_join("suspect_reasons", ",").alias("reasons"), "suspect")


_ROUTED = f"""select doc_id, year, c, 'y' || year as atom_id, said, year || '년 매출액은 ' || rev + 1 || '억원이다.' as new from {_CASES}"""


@query(with_facts(f"""select doc_id, atom_id, case c when 0 then 'keep' when 5 then 'correct' when 6 then 'correct' else 'review' end as route,
  case c when 0 then 'kept' when 1 then 'undecided' when 2 then 'missing' when 3 then 'no_correction' when 4 then 'splice' else 'ok' end as reason_code, case when c >= 5 then said end as original, case when c >= 5 then new end as suggested from ({_ROUTED})"""))
def correction_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is the lines of its years; years of the fifth case stand in it twice."""
    x = _figures(spark, sf_dir).withColumns({"atom_id": F.concat(F.lit("y"), "year"), "new": F.expr("concat(year, '년 매출액은 ', rev + 1, '억원이다.')")})
    texts = x.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("c") == 4, F.concat("said", F.lit("\n"), "said")).otherwise(F.col("said")))), "\n").alias("text"))
    judged = x.select("doc_id", "atom_id", F.col("said").alias("statement"), F.expr("case c when 0 then 'keep' when 1 then 'review' when 2 then 'missing' else 'correct' end").alias("verdict"), F.lit("산술").alias("reason"))
    corrections = x.filter("c <> 3").select("doc_id", "atom_id", F.col("new").alias("corrected_statement"), F.col("said").alias("target_text"), F.col("new").alias("suggested_quote"), F.lit("계산").alias("reason"))
    return rv.correction_routing(judged, corrections, texts)


@query("""select c_custkey as doc_id, case when c_custkey % 5 = 0 then 'skipped' when c_custkey % 3 = 0 then 'passed' when c_custkey % 2 = 0 and c_custkey % 7 < 3 then 'reverted' else 'advisory' end as status,
  case when c_custkey % 5 <> 0 and c_custkey % 3 <> 0 and c_custkey % 2 = 0 and c_custkey % 7 < 3 then c_name else c_mktsegment end as text from customer""")
def review_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents: every third is approved, every fourth verdict is missing, sums of some are broken."""
    k = F.col("c_custkey")
    d = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("doc_id"), F.col("c_name").alias("original"), F.col("c_mktsegment").alias("corrected"), F.when(k % 5 == 0, 0).otherwise(2).alias("n_changes"), (k % 2 == 0).alias("has_scale"))
    guard = d.select("doc_id", (F.col("doc_id") % 7 >= 3).alias("locked"))
    return rv.review_outcome(d, guard, d.filter("doc_id % 4 <> 1 or doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 3 == 0).alias("approve")))


@query("""
with d as (select doc_id, text, trim(string_split(text, chr(10))[1], ' ' || chr(9)) as o from documents where text is not null),
p as (select *, instr(text, o) as spot from d where o <> '')
select doc_id, 1::bigint as ord, md5(o) as original, md5(substring(text, greatest(1, spot - 220), spot - greatest(1, spot - 220))) as before, md5(substring(text, spot + length(o), 220)) as after, case when doc_id % 2 = 0 then 'j1,j3,j4' else 'j1' end as related from p""")
def review_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document gets a mark. One judgment names the atom, one is about another text, and every
    second document has three more that quote the line."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first = F.split("text", "\n")[0]
    changes = d.filter("text is not null").select("doc_id", F.lit(1).cast("bigint").alias("ord"), F.lit("a1").alias("atom_id"), first.alias("original"), F.concat(first, F.lit("!")).alias("corrected"))
    row = lambda n, atom, said: F.struct(F.lit(n).alias("ord"), F.lit(f"j{n}").alias("atom"), F.lit(atom).alias("of"), said.alias("statement"))
    said = F.regexp_replace("original", r"^[ \t]+|[ \t]+$", "")
    rows = F.explode(F.array(row(1, "a1", F.lit("")), row(2, "x", F.lit("\x01 elsewhere")), *[row(n, "x", F.when(F.col("doc_id") % 2 == 0, said)) for n in (3, 4, 5)])).alias("j")
    judgments = changes.select("doc_id", "original", rows).select("doc_id", "j.ord", F.when(F.col("j.of") == "a1", "a1").otherwise(F.col("j.atom")).alias("atom_id"), "j.statement")
    x = rv.review_diff_rows(changes, d, judgments)
    names = F.transform("related", lambda r: F.when(r == "a1", "j1").otherwise(r))
    return x.select("doc_id", "ord", F.md5("original").alias("original"), F.md5("before").alias("before"), F.md5("after").alias("after"), F.array_join(names, ",").alias("related"))


@query("""
with f as (select ['Supported', 'Contradict', 'Weak', 'Error', 'Other'][(event_id % 5 + 1)::int] as verdict, event_id % 3 as e, event_id % 4 as m, event_id % 2 as n, event_id % 6 = 0 as k from events)
select count(*) as total, count(*) filter (verdict = 'Supported') as supported, count(*) filter (verdict = 'Contradict') as contradict, count(*) filter (verdict = 'Weak') as weak, count(*) filter (verdict = 'Error') as errors, count(*) filter (k) as kb_errors,
  count(*) filter (e > 0) as with_evidence, count(*) filter (e = 0) as without_evidence, sum(e)::bigint as evidence, sum(e * m)::bigint as field_matches, sum(e * n)::bigint as field_mismatches, count(*) filter (e * n > 0) as mismatch_checks from f""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    item = F.struct(F.array_repeat(F.lit("f"), (i % 4).cast("int")).alias("field_matches"), F.array_repeat(F.lit("f"), (i % 2).cast("int")).alias("field_mismatches"))
    verdict = F.element_at(F.array(*map(F.lit, ("Supported", "Contradict", "Weak", "Error", "Other"))), (i % 5 + 1).cast("int"))
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select(verdict.alias("verdict"), F.when(i % 3 > 0, F.array_repeat(item, (i % 3).cast("int"))).alias("evidence"), F.array(F.struct(F.when(i % 6 == 0, "Error").otherwise("Supported").alias("verdict"))).alias("per_kb"))
    return rv.evidence_summary(x)

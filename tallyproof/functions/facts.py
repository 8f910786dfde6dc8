"""Expressions on fact statements: metrics, periods, values, units, amounts, markers.

The words of the report language are one lexicon; every pattern is built from it. ``(?U)`` makes white space Unicode's.
"""

from __future__ import annotations

import re
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Lexicon:
    """Fixed values of the report language: metrics, what must not follow two of them, amount units with their worth
    in hundred millions of won, other units, and the words that mark a statement's kind."""

    metrics: tuple[str, ...] = ("목표주가", "투자의견", "매출액", "매출", "영업이익률", "영업이익", "순이익", "당기순이익", "EPS", "BPS", "PER", "PBR", "ROE", "OPM", "컨센서스", "주가", "시가총액")
    not_before: tuple[tuple[str, str], ...] = (("영업이익", "률"), ("매출", "액"))
    amount_units: tuple[tuple[str, float], ...] = (("조원", 10_000.0), ("십억원", 10.0), ("백만원", 0.01), ("억원", 1.0), ("조", 10_000.0), ("억", 1.0))
    units: tuple[str, ...] = ("조원", "억원", "원", "십억원", "백만원", "만원", "%", "배", "조", "억")
    row_titles: tuple[str, ...] = ("항목", "구분", "계정", "Metric")
    forecast: str = "전망|예상|추정|가이던스|목표주가|투자의견|매수|중립|매도|유지|상향|하향|recommendation|target price|outlook|guidance"
    trend: str = "증가|감소|개선|악화|상회|하회|QoQ|YoY|qoq|yoy|연속|대비|상승|하락"
    causal: str = "때문|영향|기인|전제|기반|근거|요인|driver|due to|because|based on"
    conclusion: str = "전망|결론|투자의견|목표주가|판단|시나리오|전제|기반|유지|상향|하향|outlook|recommendation|target price"
    sentence_ends: str = "[.!?。함됨임음다]"


KOREAN = Lexicon()
#: Everything that ends a line.
LINE_END = r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"
_NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_MIXED = rf"(?U)([-+]?{_NUMBER})\s*조\s*({_NUMBER})\s*억(?:원)?"


#: White space as patterns with (?U) know it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def key_text(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def metric_pattern(metric: str, lx: Lexicon = KOREAN) -> str:
    after = dict(lx.not_before).get(metric)
    return re.escape(metric) + (f"(?!{after})" if after else "")


def _owners(lx: Lexicon) -> str:
    """Any metric occurrence that can own values: one with a further metric inside leaves them to that one."""
    outer = {m for m in lx.metrics if any((x := re.search(metric_pattern(o, lx), m)) and x.start() > 0 for o in lx.metrics if o != m)}
    return "|".join(metric_pattern(m, lx) for m in sorted(set(lx.metrics) - outer, key=len, reverse=True))


def metrics_in(text: Column, lx: Lexicon = KOREAN) -> Column:
    """array of the metrics that ``text`` names, longest first; one inside a longer one counts only if it also occurs
    by itself."""
    names = sorted(lx.metrics, key=len, reverse=True)
    tests = []
    for k, m in enumerate(names):
        longer = [o for o in names[:k] if m in o]
        inside = reduce(lambda a, o: a | text.contains(o), longer, F.lit(False))
        tests.append(F.when(text.contains(m) & (~inside | text.rlike(metric_pattern(m, lx))), F.lit(m)))
    return F.array_compact(F.array(*tests))


def periods_in(text: Column, lx: Lexicon = KOREAN) -> Column:
    """array of the distinct years and quarters in ``text``; a year that is part of an amount is none."""
    money = "|".join(u for u in lx.units if u not in ("%", "배"))
    pattern = rf"(?U)(?<![0-9,])20[0-9]{{2}}(?:년|/Q[1-4])|(?<![0-9,])20[0-9]{{2}}(?![0-9])(?!\s*(?:{money}))|[1-4]Q[0-9]{{2}}|20[0-9]{{2}}\s*년\s*[1-4]\s*분기"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def unit_of(value: Column, lx: Lexicon = KOREAN) -> Column:
    return F.when(value.rlike(_MIXED), F.lit("조+억원")).otherwise(F.regexp_extract(value, "(" + "|".join(lx.units) + ")", 1))


def is_empty_cell(value: Column) -> Column:
    return trimmed(value).isin("", "-", "—", "–", "N/A", "n/a")


def value_pattern(lx: Lexicon = KOREAN) -> str:
    """A number with its unit and a remark in brackets; trillions and hundred millions together are one value."""
    units = "|".join(["%", *(u for u in lx.units if u != "%")])
    return rf"(?U)(?:[-+]?{_NUMBER}\s*조\s*{_NUMBER}\s*억(?:원)?|[-+]?{_NUMBER}\s*(?:{units})?)(?:\s*\([A-Za-z가-힣]+\))?"


def metric_values(sentence: Column, lx: Lexicon = KOREAN) -> Column:
    """array<struct<metric, value>>: the values between a metric and the next one belong to it. Years, quarter numbers
    and bare numbers below ten are no values."""
    owners = _owners(lx)
    windows = F.slice(F.split(sentence, owners, -1), 2, 1 << 20)
    owned = F.arrays_zip(F.regexp_extract_all(sentence, F.lit(owners), F.lit(0)).alias("m"), windows.alias("w"))
    units = "|".join(["%", *(u for u in lx.units if u != "%")])

    def wanted(v: Column, w: Column) -> Column:
        bare = F.replace(v, F.lit(","), F.lit(""))
        quarter = bare.rlike("^[1-4]$") & F.regexp_like(w, F.concat(F.lit(r"(?iU)Q\s*"), bare, F.lit("|"), bare, F.lit(r"\s*분기")))
        small = ~v.rlike(units) & bare.rlike(r"^[0-9]+(\.[0-9]+)?$") & (bare.try_cast("double") < 10)
        return ~(bare.rlike("^20[0-9]{2}$") | quarter | small)

    found = F.transform(owned, lambda o: F.transform(F.filter(F.transform(F.regexp_extract_all(o["w"], F.lit(value_pattern(lx)), F.lit(0)), trimmed), lambda v: wanted(v, o["w"])), lambda v: F.struct(o["m"].alias("metric"), v.alias("value"))))
    return F.array_distinct(F.flatten(found))


def sentences(text: Column, lx: Lexicon = KOREAN) -> Column:
    """array of the sentences of ``text``: lines, cut after an end mark that white space follows."""
    lines = F.split(text, LINE_END, -1)
    parts = F.transform(lines, lambda x: F.split(trimmed(x), rf"(?U)(?<={lx.sentence_ends})\s+", -1))
    return F.filter(F.transform(F.flatten(parts), trimmed), lambda s: s != "")


def without_literals(text: Column) -> Column:
    """``text`` without lists of records written into it."""
    return trimmed(F.regexp_replace(text, r"(?sU)\[\s*\{.*?\}\s*\]", " "))


def statement_of(metric: Column, value: Column, periods: Column) -> Column:
    particle = F.when(metric.endswith("가") | metric.endswith("표"), "는").otherwise("은")
    return F.concat(F.when(periods != "", F.concat(periods, F.lit(" "))).otherwise(""), metric, particle, F.lit(" "), value, F.lit("이다."))


def _plain(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def amount_in(text: Column, lx: Lexicon = KOREAN) -> Column:
    """The first amount in hundred millions of won; trillions and hundred millions written together come first."""
    worth = dict(lx.amount_units)
    pattern = rf"(?U)([-+]?{_NUMBER})\s*({'|'.join(worth)})"
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.lit(None).cast("double")
    for u, w in worth.items():
        factor = F.when(unit == u, w).otherwise(factor)
    mixed = _plain(F.regexp_extract(text, _MIXED, 1)) * worth["조"] + _plain(F.regexp_extract(text, _MIXED, 2)) * worth["억"]
    return F.when(text.rlike(_MIXED), mixed).otherwise(_plain(F.regexp_extract(text, pattern, 1)) * factor)


def to_tenths(x: Column) -> Column:
    """A double rounded to one decimal as its exact binary value stands, ties to even. (The built-in functions round the
    shortest decimal that reads back as the double, which can lie on the other side of a tie.)"""
    whole = F.floor(x)
    part = (x - whole) * F.lit(2.0**52)
    twice = part.cast("long") * 20 + F.lit(2**52)
    k = F.call_function("div", twice, F.lit(2**53))
    tie = (twice % F.lit(2**53) == 0) & (part == F.floor(part)) & (k % 2 == 1)
    exact = (whole * 10 + k - tie.cast("long")) / F.lit(10.0)
    return F.when(F.abs(x) < 2.0**52, exact).otherwise(x)


def percent_in(text: Column) -> Column:
    return _plain(F.nullif(F.regexp_extract(text, rf"(?U)([-+]?{_NUMBER})\s*%", 1), F.lit("")))


def comparable(value: Column, statement: Column, lx: Lexicon = KOREAN) -> Column:
    """An amount, else a percentage; of the value, else of the statement. Bare numbers compare with nothing."""
    v, s = F.coalesce(value, F.lit("")), F.coalesce(statement, F.lit(""))
    return F.coalesce(amount_in(v, lx), percent_in(v), amount_in(s, lx), percent_in(s))


def amount_after(text: Column, keyword: str, lx: Lexicon = KOREAN, reach: int = 40) -> Column:
    """The first amount within ``reach`` characters after an occurrence of the metric."""
    windows = F.slice(F.split(text, metric_pattern(keyword, lx), -1), 2, 1 << 20)
    # A window goes on across further occurrences: their text is put back before it is cut.
    tails = F.transform(windows, lambda w, i: F.substring(F.array_join(F.slice(windows, i + 1, F.size(windows)), keyword), 1, reach))
    return F.get(F.filter(F.transform(tails, lambda t: amount_in(t, lx)), lambda a: a.isNotNull()), F.lit(0))


def is_margin(statement: Column) -> Column:
    return statement.contains("영업이익률") | statement.rlike(r"(?iU)\b(OPM|margin)\b")


def is_margin_input(statement: Column) -> Column:
    return statement.contains("매출액") | (statement.contains("영업이익") & ~statement.contains("영업이익률"))


def is_conclusion(statement: Column, lx: Lexicon = KOREAN) -> Column:
    return statement.rlike(f"(?i){lx.conclusion}")


def value_tokens(text: Column, lx: Lexicon = KOREAN) -> Column:
    """array of the numbers in ``text`` with their units."""
    units = "|".join(["%", *(u for u in lx.units if u != "%")])
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?U)[-+]?{_NUMBER}\s*(?:{units})?"), F.lit(0)), trimmed), lambda t: t != "")


# ------------------------------------------------------------------ money in won

#: Won in a unit.
WON = {"조원": 1e12, "억원": 1e8, "조": 1e12, "억": 1e8, "원": 1.0}
MONEY = rf"(?U)(?<![0-9,.])[+-]?{_NUMBER}\s*(?:{'|'.join(WON)})"


def won_of(token: Column) -> Column:
    """A money token in won."""
    unit = F.regexp_extract(token, f"({'|'.join(WON)})$", 1)
    factor = F.lit(1.0)
    for u, w in WON.items():
        factor = F.when(unit == u, w).otherwise(factor)
    return _plain(F.regexp_extract(token, rf"^([+-]?{_NUMBER})", 1)) * factor


def same_won(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(a), F.abs(b)) * 1e-10


def money_like(won: Column, token: Column) -> Column:
    """``won`` written as ``token`` is: its unit and spacing, commas if it has some, at most six decimals."""
    unit = F.regexp_extract(token, rf"(?U)(\s*(?:{'|'.join(WON)}))$", 1)
    factor = F.lit(1.0)
    for u, w in WON.items():
        factor = F.when(trimmed(unit) == u, w).otherwise(factor)
    # Decimals, as whole won can pass 2**53 in no double but its text would show an exponent.
    exact = (won / factor).cast("decimal(38,6)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(exact, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole, rest = F.regexp_extract(plain, "^([+-]?[0-9]+)", 1), F.regexp_extract(plain, r"(\.[0-9]+)$", 1)
    grouped = F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
    return F.concat(F.when(token.contains(","), grouped).otherwise(whole), rest, unit)


def money_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), F.lit(0))


def value_step(won: Column) -> Column:
    """A number for values of about one size: values that same_won takes as one are in the same step or in neighbouring
    ones."""
    return F.floor(F.signum(won) * F.log1p(F.abs(won)) / 1e-6)


def money_hits(text: Column, old: Column) -> Column:
    """How many money tokens of ``text`` are worth ``old``."""
    return F.size(F.filter(money_tokens(text), lambda t: same_won(won_of(t), old)))


def money_replaced(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the money tokens worth ``old`` rewritten to ``new``."""
    gaps = F.split(text, MONEY, -1)
    tokens = F.transform(money_tokens(text), lambda t: F.when(same_won(won_of(t), old), money_like(new, t)).otherwise(t))
    return F.array_join(F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")

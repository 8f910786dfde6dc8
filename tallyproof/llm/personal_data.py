"""Personal data: base patterns, and further spans by weak supervision. Built-in functions only.

Method: candidate spans are the base matches, matches of the base patterns that fail their check (a card number with a
typing error, say), and matches of wider patterns (spelled out, bracketed, without a plus). Five labelers vote on each
(+1, 0, -1): its form, a gazetteer, the words before it, a structural check, and the company of other personal data in
the document. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each
kind of data; a naive Bayes classifier on the votes and the span's shape is then trained on the resulting probabilities
and decides on candidates outside the base. The counts come from all documents; their cells are few by construction
(five votes of three values, 24 shapes), so the fit itself is arithmetic on a small table in the driver.

Patterns here keep to possessive repeats and anchored starts, so that no text makes them quadratic or recursive. The
wider ones take names of at most 64 and labels of at most 63 characters, as mail addresses do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns. A start inside a run fails wherever the run's start does, but right after a match (\G).
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns for candidates outside the base.
_DOT = r"(?:\x20?[(\[][dD][oO][tT][)\]]\x20?|\x20[dD][oO][tT]\x20|\.)"
_SPREAD_DOT = r"(?:\x20?[(\[]\.[)\]]\x20?|\x20?[(\[][dD][oO][tT][)\]]\x20?|\x20\.\x20|\x20[dD][oO][tT]\x20)"
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:\x20?[(\[][aA][tT][)\]]\x20?|\x20[aA][tT]\x20|\x20@\x20?|@\x20)[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_SPREAD_DOT}[0-9]{{1,3}}){{3}}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]{1,2}[0-9]{4}){2}[\x20.-]{1,2}[0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: Texts without these letters hold no span of the kind: each is a part that BASE and WIDER cannot do without.
_HINT = {"email": "@|[(\\[][aA][tT][)\\]]|\\x20[aA][tT]\\x20", "ip": "[0-9](?:\\.|\\x20?[(\\[]|\\x20\\.|\\x20[dD][oO][tT])", "card": "[0-9][\\x20.-]{0,2}[0-9]", "phone": "\\+[0-9]|[0-9]{2}"}

#: Top-level domains, reserved address starts, words that go with each kind, words that speak against.
_DOMAINS = "com|org|net|edu|gov|info|biz|io|co|eu|de|fr|es|uk|us|ch|at|it|nl|be|ca|au|jp|cn|in|br|mx"
_RESERVED = r"^(0|10|127|255|169\.254|192\.168)\."
_WORDS = {
    "email": "(?i)(e-?mail|mail|contact|write|correo|courriel|schreib|adresse)",
    "ip": r"(?i)(\bip\b|host|server|address|login|adresse|direcci)",
    "card": "(?i)(card|visa|master|amex|credit|debit|karte|carte|tarjeta)",
    "phone": "(?i)(phone|tel|call|mobile|cell|fax|whatsapp|telefon|handy|llam|appel|portable)",
}
_AGAINST = r"(?i)(version|licen|isbn|issn|doi|section|release|build|order|invoice)"


@dataclass(frozen=True)
class WeakLabels:
    """accept: least probability of an added span. rounds: of expectation-maximisation. before: characters of context."""

    accept: float = 0.8
    rounds: int = 60
    before: int = 24


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>>, leftmost and non-overlapping, in code points.

    The matches and the gaps between them come from the same scan order, so their lengths add up to the offsets.
    """
    pieces = F.filter(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match"))),
        lambda x: x["match"].isNotNull(),
    )
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,match:string>>))")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))).alias("out"))

    return F.aggregate(pieces, empty, step, lambda acc: acc["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    values = F.transform(F.split(back, ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def well_formed(kind: str, match: Column) -> Column:
    """The condition that a match of the base pattern must meet."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(match))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, match>> of the base pattern's well-formed matches."""
    found = F.when(text.rlike(_HINT[kind]), F.filter(matches(text, BASE[kind]), lambda m: well_formed(kind, m["match"])))
    return F.coalesce(found, F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)"))


_NONE = "cast(array() as array<struct<start:int,end:int,match:string>>)"


def _failed_spans(text: Column, kind: str) -> Column:
    """Matches of the base pattern that fail its check but are not far from it."""
    n = lambda m: F.length(_digits(m["match"]))
    near = {"card": lambda m: n(m).between(12, 19), "phone": lambda m: n(m).between(7, 17), "ip": lambda m: n(m) <= 12}.get(kind)
    if near is None:
        return F.expr(_NONE)
    return F.filter(matches(text, BASE[kind]), lambda m: ~well_formed(kind, m["match"]) & near(m))


def _wider_spans(text: Column, kind: str) -> Column:
    """Candidates outside the base: failed matches and, where they touch none of these, wider ones."""
    failed = _failed_spans(text, kind)
    wider = F.filter(matches(text, WIDER[kind]), lambda s: ~_overlaps(s, failed))
    return F.coalesce(F.when(text.rlike(_HINT[kind]), F.concat(failed, wider)), F.expr(_NONE))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _gazetteer(kind: str, match: Column) -> Column:
    if kind == "email":
        known = match.rlike(rf"(?i)({_DOMAINS})$")
    elif kind == "ip":
        known = ~match.rlike(_RESERVED)
    elif kind == "card":
        known = _digits(match).rlike("^[3-6]")
    else:
        known = match.rlike(r"^(\+|00|0|\()")
    return _vote(known, ~known)


def _check(kind: str, match: Column) -> Column:
    if kind == "email":
        right = (F.length(match) <= 254) & ~match.contains("..")
    else:
        right = well_formed(kind, match)
    return _vote(right, ~right)


def _form(kind: str, match: Column) -> Column:
    """Whether the span is written as such data mostly is."""
    if kind == "email":
        return _vote(match.contains("@") & ~match.contains(" "), F.lit(False))
    if kind == "ip":
        return _vote(match.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.lit(False))
    if kind == "card":
        usual = F.length(_digits(match)).isin(13, 15, 16)
        return _vote(usual, ~usual)
    return _vote(match.startswith("+"), F.lit(False))


def _cell(kind: str, span: Column, text: Column, company: Column, cfg: WeakLabels) -> Column:
    """The votes and the shape of a span as one short string, ``kind|form|gazetteer|context|check|company|length|separators``."""
    before = F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - cfg.before), F.least(F.lit(cfg.before), span["start"]))
    votes = (_form(kind, span["match"]), _gazetteer(kind, span["match"]), _vote(before.rlike(_WORDS[kind]), before.rlike(_AGAINST)), _check(kind, span["match"]), company)
    shape = (F.least(F.lit(5), F.floor(F.length(span["match"]) / 6)), F.least(F.lit(3), F.length(F.regexp_replace(span["match"], r"[^\x20().-]", ""))))
    return F.concat_ws("|", F.lit(kind), *[x.cast("string") for x in votes + shape])


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _with_spans(text: DataFrame) -> DataFrame:
    """text (row, text) with base_<kind>, base_all and more_<kind>: wider candidates that touch no base span."""
    out = text.withColumns({f"base_{k}": base_spans(F.col("text"), k) for k in KINDS})
    out = out.withColumn("base_all", F.concat(*[F.transform(f"base_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    return out.withColumns({f"more_{k}": F.filter(_wider_spans(F.col("text"), k), lambda s: ~_overlaps(s, F.col("base_all"))) for k in KINDS})


def _company(own: int) -> Column:
    """+1 beside other base spans of the document, else -1; own: how many of them are the span itself."""
    return F.when(F.size("base_all") > own, 1).otherwise(-1)


def _cells(kind: str, prefix: str, cfg: WeakLabels) -> Column:
    return F.transform(f"{prefix}_{kind}", lambda s: _cell(kind, s, F.col("text"), _company(1 if prefix == "base" else 0), cfg))


def cell_counts(docs: DataFrame, text: str = "text", cfg: WeakLabels = WeakLabels()) -> dict[str, int]:
    """Candidates of all documents in each cell; at most 4 kinds x 3**5 votes x 24 shapes."""
    spans = _with_spans(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))
    cells = F.concat(*[_cells(k, p, cfg) for k in KINDS for p in ("base", "more")])
    counted = spans.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return {r.cell: r.n for r in counted.collect()}


LABELERS = 5


def estimate_reliabilities(patterns: dict[tuple[int, ...], float], rounds: int) -> tuple[float, list[float], dict[tuple[int, ...], float]]:
    """Expectation-maximisation of the share of true spans and each labeler's accuracy from vote-pattern counts.

    Returns share, accuracies, and the probability of a true span for each pattern. Starts from accuracies of 0.8, so
    that votes mean what they say; a little prior weight keeps empty cells defined. The share stays within 0.1 and 0.9:
    where nearly all candidates are true, a prior near one would outvote all labelers together.
    """
    share, right = 0.5, [0.8] * LABELERS
    chance: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in patterns:
            odds = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, right))
            chance[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(patterns.values())
        share = min(0.9, max(0.1, (1 + sum(n * chance[v] for v, n in patterns.items())) / (total + 2)))
        for j in range(LABELERS):
            voted = sum(n for v, n in patterns.items() if v[j])
            agreed = sum(n * (chance[v] if v[j] > 0 else 1 - chance[v]) for v, n in patterns.items() if v[j])
            right[j] = min(0.98, max(0.5, (agreed + 4) / (voted + 5)))
    return share, right, chance


def accepted_cells(counts: dict[str, int], cfg: WeakLabels = WeakLabels()) -> list[str]:
    """Cells whose spans the final classifier takes: naive Bayes on votes and shape, trained on the estimated labels."""
    out = []
    for kind in KINDS:
        cells = {tuple(map(int, c.split("|")[1:])): n for c, n in counts.items() if c.startswith(kind + "|")}
        if not cells:
            continue
        patterns: dict[tuple[int, ...], float] = {}
        for c, n in cells.items():
            patterns[c[:LABELERS]] = patterns.get(c[:LABELERS], 0) + n
        chance = estimate_reliabilities(patterns, cfg.rounds)[2]
        weights = {label: sum(n * (p if label else 1 - p) for c, n in cells.items() for p in [chance[c[:LABELERS]]]) for label in (0, 1)}
        seen: dict[tuple[int, int, int], float] = {}
        for c, n in cells.items():
            for j, v in enumerate(c):
                for label in (0, 1):
                    p = chance[c[:LABELERS]]
                    seen[label, j, v] = seen.get((label, j, v), 0) + n * (p if label else 1 - p)
        sizes = (3,) * LABELERS + (6, 4)
        for c in cells:
            odds = math.log((weights[1] + 1) / (weights[0] + 1))
            for j, v in enumerate(c):
                odds += math.log((seen[1, j, v] + 0.5) / (weights[1] + 0.5 * sizes[j])) - math.log((seen[0, j, v] + 0.5) / (weights[0] + 0.5 * sizes[j]))
            if 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) >= cfg.accept:
                out.append("|".join([kind, *map(str, c)]))
    return sorted(out)


def _taken(kind: str, cells: list[str], cfg: WeakLabels) -> Column:
    """The wider candidates in accepted cells."""
    if not cells:
        return F.slice(f"more_{kind}", 1, 0)
    return F.filter(f"more_{kind}", lambda s: _cell(kind, s, F.col("text"), _company(0), cfg).isin(cells))


def _numbered(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def _listed(prefixes: dict[str, Column]) -> Column:
    """``kind:start:end`` by start, then kind in the order of KINDS, joined by commas."""
    rows = [_numbered(k, spans) for k, spans in prefixes.items()]
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(reduce(F.concat, rows)), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, text: str = "text", cfg: WeakLabels = WeakLabels()) -> DataFrame:
    """Every row of ``docs`` with n_email, n_ip, n_card, n_phone, base_sha256 and spans (base and added).

    Null and empty texts have no spans. Overlaps between kinds of the base stay, as each kind is scanned alone; added
    spans never touch a base span. Repeated rows are treated each. Columns of ``docs`` named like results are
    replaced; all others stay, whatever their names.
    """
    results = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    names = [n for n in docs.columns if n not in results]
    taken = accepted_cells(cell_counts(docs, text, cfg), cfg)
    own = docs.select(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = _with_spans(own).withColumns({f"added_{k}": _taken(k, [c for c in taken if c.startswith(k + "|")], cfg) for k in KINDS})
    return found.select(
        *[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)],
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed({k: F.col(f"base_{k}") for k in KINDS}), 256).alias("base_sha256"),
        _listed({k: F.concat(f"base_{k}", f"added_{k}") for k in KINDS}).alias("spans"),
    )

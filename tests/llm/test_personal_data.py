"""Weak supervision of personal data: the fit on simulated votes, and all spans against plain Python."""

import hashlib
import random

import regex

from tallyproof.llm import personal_data as pd


def test_reliabilities_are_found_on_simulated_votes():
    rng = random.Random(5)
    right, share, patterns = [0.95, 0.9, 0.75, 0.85, 0.65], 0.4, {}
    for _ in range(20_000):
        truth = rng.random() < share
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == truth else -1) for a in right)
        patterns[votes] = patterns.get(votes, 0) + 1
    found_share, found, _ = pd.estimate_reliabilities(patterns, 80)
    assert abs(found_share - share) < 0.04
    assert all(abs(a - b) < 0.05 for a, b in zip(right, found))


def _luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def _good(kind, m):
    digits = regex.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def _sign(yes, no=None):
    no = not yes if no is None else no
    return -1 if no else 1 if yes else 0


def _cell(kind, start, end, text, company):
    m = text[start:end]
    digits, before = regex.sub("[^0-9]", "", m), text[max(0, start - 24) : start]
    form = {"email": "@" in m and " " not in m, "ip": bool(regex.match(r"[0-9]{1,3}(\.[0-9]{1,3}){3}$", m)), "card": len(digits) in (13, 15, 16), "phone": m.startswith("+")}[kind]
    known = {
        "email": bool(regex.search(f"(?i)({pd._DOMAINS})$", m)), "ip": not regex.search(pd._RESERVED, m),
        "card": bool(regex.match("[3-6]", digits)), "phone": bool(regex.match(r"(\+|00|0|\()", m)),
    }[kind]
    check = len(m) <= 254 and ".." not in m if kind == "email" else (_good(kind, m) if kind != "ip" or regex.match(r"[0-9.]+$", m) else False)
    votes = [_sign(form) if kind == "card" else int(form), _sign(known), _sign(bool(regex.search(pd._WORDS[kind], before)), bool(regex.search(pd._AGAINST, before))), _sign(check), company]
    return "|".join([kind, *map(str, votes), str(min(5, len(m) // 6)), str(min(3, len(regex.sub(r"[^\x20().-]", "", m))))])


def _spans(text):
    """base and further candidates of a text, by kind."""
    base, more = {}, {}
    for k in pd.KINDS:
        found = [m.span() for m in regex.finditer(pd.BASE[k], text)]
        base[k] = [s for s in found if _good(k, text[slice(*s)])]
        near = {"card": (12, 19), "phone": (7, 17), "ip": (0, 12)}.get(k)
        failed = [s for s in found if near and not _good(k, text[slice(*s)]) and near[0] <= len(regex.sub("[^0-9]", "", text[slice(*s)])) <= near[1]]
        wider = [m.span() for m in regex.finditer(pd.WIDER[k], text)]
        more[k] = failed + [w for w in wider if not any(f[0] < w[1] and w[0] < f[1] for f in failed)]
    every = [s for spans in base.values() for s in spans]
    more = {k: [m for m in spans if not any(b[0] < m[1] and m[0] < b[1] for b in every)] for k, spans in more.items()}
    return base, more, len(every)


def _texts():
    rng = random.Random(11)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "release", "order", "call", "mail", "card", "server"]
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = [
        lambda: f"{rng.choice('abc')}{number(2)}@site{number(1)}.com", lambda: f"jane{number(1)} (at) example (dot) org", lambda: f"joe at mail{number(1)}.de",
        lambda: ".".join(str(rng.randint(1, 300)) for _ in range(4)), lambda: "[.]".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: "4" + number(15), lambda: " ".join(number(4) for _ in range(4)), lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}",
    ]
    out = [None, "", "x" * 3000]
    for _ in range(150):
        out.append(" ".join(rng.choice(forms)() if rng.random() < 0.25 else rng.choice(words) for _ in range(rng.randint(1, 30))))
    return out


def test_spans_against_plain_python(spark):
    texts = _texts()
    counts: dict[str, int] = {}
    cells = []
    for t in texts:
        base, more, n = _spans(t or "")
        of = {k: [(s, _cell(k, *s, t, 1 if n > 0 else -1)) for s in more[k]] for k in pd.KINDS} if t else {k: [] for k in pd.KINDS}
        cells.append((base, of))
        for k in pd.KINDS:
            for c in [_cell(k, *s, t, 1 if n > 1 else -1) for s in base[k]] + [c for _, c in of[k]]:
                counts[c] = counts.get(c, 0) + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pd.cell_counts(docs) == counts
    taken = set(pd.accepted_cells(counts))
    added = 0
    got = {r.doc_id: r for r in pd.find_personal_data(docs).collect()}
    for i, (base, of) in enumerate(cells):
        spans = sorted((s, pd.KINDS.index(k), e) for k in pd.KINDS for s, e in base[k])
        every = sorted(spans + [(s, pd.KINDS.index(k), e) for k in pd.KINDS for (s, e), c in of[k] if c in taken])
        added += len(every) - len(spans)
        text = lambda rows: ",".join(f"{pd.KINDS[k]}:{s}:{e}" for s, k, e in rows)
        assert got[i].base_sha256 == hashlib.sha256(text(spans).encode()).hexdigest()
        assert got[i].spans == text(every)
        assert [got[i][f"n_{k}"] for k in pd.KINDS] == [len(base[k]) for k in pd.KINDS]
    assert added > 0 and added < sum(len(c) for _, of in cells for c in of.values())

"""Contracts of model responses by kind: the object in a response, its fields and their types, as a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Of each kind of response its fields, in order, with their types; required ones carry a mark.
CONTRACTS: dict[str, tuple[tuple[str, str, bool], ...]] = {
    "atom_judgment": (("corrected_statement", "string", True), ("reason", "string", True)),
    "rewrite": (("suggested_text", "string", True), ("reason", "string", True)),
    "approval": (("approve", "boolean", True), ("reason", "string", True)),
    "propagation": (("affected", "boolean", True), ("suggested_text", "string", True), ("reason", "string", True)),
    "atom_judgments": (("judgments", "array", True),),
    "atom_corrections": (("corrections", "array", True),),
    "atom_graph": (("atoms", "array", True), ("edges", "array", False)),
    "relations": (("edges", "array", True),),
    "suspects": (("suspects", "array", True),),
}
#: Strings with their escapes, single braces, and what lies between.
_TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"?|[{}]|[^{}"]++'
_STEP = "struct(0 as at, 0 as depth, 0 as start, 0 as end)"


def object_in(text: Column) -> Column:
    """struct(object, open): the first balanced ``{…}``, braces inside strings not counted, null if none ends; open: one
    begins and none ends. One pass over strings, braces and the rest."""

    def step(a: Column, t: Column) -> Column:
        opens, closes = (t == "{") & (a["depth"] == 0), (t == "}") & (a["depth"] == 1)
        depth = a["depth"] + F.when(t == "{", 1).when((t == "}") & (a["depth"] > 0), -1).otherwise(0)
        end = F.when(a["end"] > 0, a["end"]).when(closes, a["at"] + 1).otherwise(0)
        return F.struct((a["at"] + F.length(t)).alias("at"), depth.alias("depth"), F.when(opens & (a["end"] == 0), a["at"]).otherwise(a["start"]).alias("start"), end.alias("end"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.expr(_STEP), step, lambda a: F.struct(F.when(a["end"] > 0, F.substr(text, a["start"] + 1, a["end"] - a["start"])).alias("object"), ((a["end"] == 0) & (a["depth"] > 0)).alias("open")))


def _field(body: Column, name: str) -> Column:
    return F.try_variant_get(body, f"$.{name}", "variant")


def _is(body: Column, name: str, kind: str) -> Column:
    shape = F.schema_of_variant(_field(body, name))
    return shape.startswith("ARRAY") if kind == "array" else shape == kind.upper()


def response_bodies(responses: DataFrame, contracts: dict = CONTRACTS, strict: bool = False) -> DataFrame:
    """responses (kind, raw) with body (VARIANT, null unless ok), status (ok or rejected) and reason_code.

    Fences and text around the first whole object are dropped; if it does not parse, backslashes that escape nothing JSON
    knows are taken out. reason_code: unknown_kind; truncated (an object begins and does not end), no_object, not_json;
    missing:<field> of a required field, in the contract's order; type:<field> for a value of another type, JSON's null
    included, so that a text where a boolean belongs is told from a field that is not there. Fields beyond the contract pass;
    ``strict`` refuses them (extra) and entries of its arrays that are no objects (item:<field>). Null texts hold no object; an
    object with a key twice does not parse. Each response is parsed once.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("raw", F.lit(""))), r"(?iU)^```(?:json)?\s*", ""), r"(?U)\s*```$", "")
    x = responses.withColumn("_found", object_in(text))
    plain = F.regexp_replace("_found.object", r'\\(?!["\\/bfnrtu])', "")
    x = x.withColumn("_body", F.coalesce(F.try_parse_json("_found.object"), F.try_parse_json(plain)))
    body = F.col("_body")
    checks = [
        F.when(~F.coalesce(F.col("kind").isin(*contracts), F.lit(False)), "unknown_kind"),
        F.when(F.col("_found.open"), "truncated").when(F.col("_found.object").isNull(), "no_object").when(body.isNull(), "not_json"),
    ]
    for kind, fields in contracts.items():
        own = F.col("kind") == kind
        there = lambda n: _field(body, n).isNotNull()
        tests = [F.when(~there(n), f"missing:{n}") for n, _, required in fields if required]
        tests += [F.when(there(n) & ~_is(body, n, t), f"type:{n}") for n, t, _ in fields]
        if strict:
            keys = F.map_keys(F.try_variant_get(body, "$", "map<string,variant>"))
            tests.append(F.when(F.size(F.array_except(keys, F.array(*[F.lit(n) for n, _, _ in fields]))) > 0, "extra"))
            tests += [F.when(F.exists(F.try_variant_get(body, f"$.{n}", "array<variant>"), lambda v: v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")), f"item:{n}") for n, t, _ in fields if t == "array"]
        checks.append(F.when(own, F.coalesce(*tests)))
    x = x.withColumn("reason_code", F.coalesce(*checks))
    ok = F.col("reason_code").isNull()
    return x.withColumns({"body": F.when(ok, body), "status": F.when(ok, "ok").otherwise("rejected")}).drop("_found", "_body")


def response_items(bodies: DataFrame, field: str) -> DataFrame:
    """The entries of an array field of accepted responses, a row each: item (VARIANT), place (from 0), and the other columns."""
    entries = F.posexplode(F.try_variant_get("body", f"$.{field}", "array<variant>")).alias("place", "item")
    return bodies.filter("status = 'ok'").select(*[c for c in bodies.columns if c not in ("body", "status", "reason_code")], entries)

"""Queries on response contracts: events as responses of every kind, whole and damaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.operators import contracts as ct
from tallyproof.plans.registry import query

#: By event: the kind, and the damage: none, fences, cut short, no braces, a field under another name, a value of another
#: type, an escape that JSON does not know, braces in strings beside a field of its own.
_KINDS = ("atom_judgment", "rewrite", "approval", "propagation", "atom_judgments", "atom_corrections", "atom_graph", "relations", "suspects")
_FIRST = ("corrected_statement", "suggested_text", "approve", "affected", "judgments", "corrections", "atoms", "edges", "suspects")
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), (F.col("event_id") % 9).alias("k"), (F.col("event_id") % 8).alias("d"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("k") + 1).cast("int"))
    first = F.element_at(F.array(*map(F.lit, _FIRST)), (F.col("k") + 1).cast("int"))
    value = F.when(F.col("k") < 2, F.format_string('"text %d"', "id")).when(F.col("k") < 4, F.when(F.col("id") % 2 == 0, "true").otherwise("false")).otherwise(F.format_string('[{"atom_id": "a%d"}, {"atom_id": "b{"}, {}]', "id"))
    wrong = F.when(F.col("k") < 2, "17").when(F.col("k") < 4, '"true"').otherwise(F.when(F.col("id") % 3 == 0, "null").otherwise('{"0": {}}'))
    rest = F.when(F.col("k") == 3, ', "suggested_text": "t", "reason": "r"').when(F.col("k") < 4, ', "reason": "r"').otherwise("")
    body = F.concat(F.lit('{"'), F.when(F.col("d") == 4, "other").otherwise(first), F.lit('": '), F.when(F.col("d") == 5, wrong).otherwise(value), rest, F.when(F.col("d") == 6, ', "note": "5\\% \\"}"').when(F.col("d") == 7, ', "note": "}{"').otherwise(""), F.lit("}"))
    raw = F.when(F.col("d") == 1, F.concat(F.lit("Here:\n```json\n"), F.col("body"), F.lit("\n``` {}"))).when(F.col("d") == 2, F.expr("left(body, length(body) - 1)")).when(F.col("d") == 3, "none of this").otherwise(F.col("body"))
    return e.select("id", kind.alias("kind"), body.alias("body"), "d").select("id", "kind", raw.alias("raw"))


@query(f"""
select id, kind, case when reason_code is null then 'ok' else 'rejected' end as status, reason_code from (
  select event_id as id, {_LIST(_KINDS)}[(event_id % 9 + 1)::int] as kind,
         case event_id % 8 when 2 then 'truncated' when 3 then 'no_object' when 4 then 'missing:' || {_LIST(_FIRST)}[(event_id % 9 + 1)::int] when 5 then 'type:' || {_LIST(_FIRST)}[(event_id % 9 + 1)::int] end as reason_code from events)""")
def response_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.response_bodies(_responses(spark, sf_dir)).select("id", "kind", "status", "reason_code")


@query("""select event_id as id, place::int as place, case place when 0 then 'a' || event_id when 1 then 'b{' end as atom_id
from events, (select unnest([0, 1, 2]) as place) where event_id % 9 = 4 and event_id % 8 in (0, 1, 6, 7)""")
def response_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of accepted judgments."""
    x = ct.response_items(ct.response_bodies(_responses(spark, sf_dir)).filter("kind = 'atom_judgments'"), "judgments")
    return x.select("id", F.col("place").cast("int").alias("place"), F.try_variant_get("item", "$.atom_id", "string").alias("atom_id"))

"""White space at the ends of a text goes without a pattern, every kind of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyproof.functions import facts as fx


def test_trimmed_equals_its_pattern_for_every_character_and_tries_none(spark):
    c = spark.range(1, 0xD800).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "utf-16be").alias("c"))
    texts = c.select(F.explode(F.array("c", F.concat("c", F.lit(" 가 b "), "c"), F.concat(F.lit("\t"), "c", F.lit("x\r\n")), F.concat(F.lit("나"), "c", F.lit("\n")))).alias("t"))
    assert texts.filter(~fx.trimmed(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).isEmpty()
    plan = texts.select(fx.trimmed(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan

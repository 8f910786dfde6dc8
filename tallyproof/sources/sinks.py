"""Published tables of a run: partitions by run date, shown only when all of them are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.sources.tables import append_partition


def _manifest(spark: SparkSession, path: str, run_date: str, attempt: str, state: str, tables: list[str]) -> None:
    rows = spark.createDataFrame([(run_date, attempt, state, tables)], "run_date string, attempt string, state string, tables array<string>")
    append_partition(rows.coalesce(1), f"{path}/manifest", "run_date")


def publish(tables: dict[str, DataFrame], path: str, run_date: str) -> str:
    """Write the tables of a run under ``path``/<name>/run_date=<run_date>, each in place of what an earlier run of that date
    left there, and return the attempt's id.

    The date is withdrawn first and shown again when everything is written: readers (published) see all tables of one
    attempt or none of the date. A table without rows leaves older files of its partition, but their attempt is not the
    one shown. Sources are never written to.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    _manifest(spark, path, run_date, attempt, "open", sorted(tables))
    for name, df in tables.items():
        append_partition(df.withColumns({"attempt": F.lit(attempt), "run_date": F.lit(run_date)}), f"{path}/{name}", "run_date")
    _manifest(spark, path, run_date, attempt, "complete", sorted(tables))
    return attempt


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's rows, with run_date, of the dates that are completely written."""
    shown = spark.read.parquet(f"{path}/manifest").filter(F.col("state") == "complete").filter(F.array_contains("tables", F.lit(name))).select(F.col("run_date").cast("string").alias("run_date"), "attempt")
    rows = spark.read.option("mergeSchema", False).parquet(f"{path}/{name}").withColumn("run_date", F.col("run_date").cast("string"))
    return rows.join(shown, ["run_date", "attempt"], "left_semi").drop("attempt")

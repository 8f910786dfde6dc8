"""Tables that a job writes for its own later steps, and readers for incoming reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors see. A local session without one gets a temporary
    folder; a cluster without one is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: Paths of the tables that the current job has stored; none outside of one.
_OWN: ContextVar[list[str] | None] = ContextVar("own_tables", default=None)


@contextmanager
def job_tables(spark: SparkSession) -> Iterator[None]:
    """A job whose stored tables go when it ends, in success or failure. Results that read them must be written by then. A
    job within a job leaves its tables to the outer one."""
    if _OWN.get() is not None:
        yield
        return
    mark = _OWN.set([])
    try:
        yield
    finally:
        for path in _OWN.get():
            _delete(spark, path)
        _OWN.reset(mark)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: The shuffle files of a write go when it ends, as no other execution reads them, and not only when the driver collects its plan.
_WRITE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Sides of a join that are dealt by some of its keys meet as they are.
_DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings for the writes inside."""
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


#: Where the tables of stored lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors recompute nothing
    before it. Inside job_tables the table is the job's own. dealt: rows that a step has dealt by document stay so in joins by
    document and line, in place of a further shuffle; a document's rows are then in one task, as in its windows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _OWN.get() is not None:
        _OWN.get().append(path)
    with _set(df.sparkSession, _WRITE | (_DEALT if dealt else {})):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of stored that no later step and no result reads."""
    for table in tables:
        _delete(table.sparkSession, _PATHS.pop(table))


def append_partition(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` into the partitions of ``path`` that it has rows of, in place of what they held."""
    with _set(df.sparkSession, _WRITE):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_reports(spark: SparkSession, path: str, kind: str = "parquet", stream: bool = False) -> DataFrame:
    """Reports (doc_id, text, consensus_won) from a folder of Parquet tables, JSON lines, or whole text files (``text``:
    a file is a report, its path the doc_id). As a stream, files that arrive later are read too."""
    schema = "doc_id string, text string, consensus_won double"
    reader = spark.readStream if stream else spark.read
    if kind == "text":
        raw = reader.option("wholetext", True).text(path)
        return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"), F.lit(None).cast("double").alias("consensus_won"))
    return reader.schema(schema).format(kind).load(path)

"""What a run leaves on disk: shuffles go with their write, tables that nothing reads go early, texts are shuffled and not lines."""

import contextlib
import glob
import io
import time

from pyspark.sql import functions as F

from tallyproof.operators import lines as ln, repair as rp, runs
from tallyproof.sources.tables import append_partition, release, shared_folder, stored


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}


def test_shuffles_go_with_their_write(spark, tmp_path):
    before, was = _shuffle_files(spark), dict(spark.sparkContext.getConf().getAll())
    rows = spark.range(1000).withColumn("day", F.lit("a"))
    assert stored(rows.groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    append_partition(rows.repartition("id"), str(tmp_path / "out"), "day")
    left = _shuffle_files(spark) - before
    for _ in range(50):
        if not left:
            break
        time.sleep(0.2)
        left &= _shuffle_files(spark)
    # The count above is an execution of its own; its one shuffle is not a write's.
    assert len({f.split("_")[1] for f in left}) <= 1
    assert dict(spark.sparkContext.getConf().getAll()) == was and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_released_tables_are_gone(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/table-*"))
    one, two = stored(spark.range(3)), stored(spark.range(4))
    release(one)
    assert len(set(glob.glob(f"{folder}/table-*")) - before) == 1 and two.count() == 4


def test_later_stages_go_over_earlier_ones_without_a_shuffle_of_lines(spark):
    reports = spark.createDataFrame([(1, "a\r\nb\nc"), (2, "x\n\ny\n"), (3, ""), (4, None)], "doc_id long, text string")
    kind = "doc_id long, line_no int, old_line string, new_line string, factor double"
    first = spark.createDataFrame([(1, 1, "a", "A", 10.0), (1, 2, "b", "B2", 10.0), (1, 2, "b", "B1", 0.1), (2, 3, "y", "Y", 10.0)], kind)
    second = spark.createDataFrame([(1, 1, "A", "AA", 10.0)], kind)
    done = rp.rewritten(reports, first, second)
    assert {r.doc_id: r.text for r in ln.reassemble(done).collect()} == {1: "AA\r\nB1\nc", 2: "x\n\nY\n"}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            ln.line_context(done).explain()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    # The texts and the two tables of changes.
    assert out.getvalue().count("Exchange hashpartitioning") == 3


def test_a_run_leaves_no_table_of_lines(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/table-*"))
    year = "## 2026년 최근 컨센서스 전망치 분석\n2026년 6월 28일 300억원으로 모였다.\n\n- 2026년 영업이익 전망: 3,000억원\n\n결론: 2026년 영업이익은 3,000억원이다.\n"
    run = runs.repair_run(spark.createDataFrame([(1, year)], "doc_id long, text string"))
    assert run["corrected"].collect()[0].text == year.replace("3,000억", "300억")
    left = [spark.read.parquet(p) for p in set(glob.glob(f"{folder}/table-*")) - before]
    assert not any({"line", "eol"} & set(t.columns) for t in left if "mapping_nos" not in t.columns)

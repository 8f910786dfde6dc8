"""Stage progress of late and unordered events: all jobs of a bucket in one call, against plain Python."""

import datetime as dt
import itertools

import pandas as pd

from tallyproof.streaming import jobs as st

START = dt.datetime(2026, 1, 1)


def _want(events):
    out = []
    for job, own in itertools.groupby(sorted(events, key=lambda e: (e[0], e[1], e[2])), key=lambda e: e[0]):
        run, last = 0, None
        for stage, part in itertools.groupby(own, key=lambda e: e[3]):
            part, run = list(part), run + 1
            if last:
                out.append((*last, part[0][1]))
            last = (job, run, stage, part[0][1], part[-1][4])
        out.append((*last, None))
    return sorted(out, key=repr)


def test_jobs_of_a_bucket_are_followed_together(spark, tmp_path):
    events = [(j, START + dt.timedelta(minutes=(i * 7 + j) % 240, microseconds=j * 137), i, ["a", "b", None, "b"][(i + j) // 3 % 4], f"m{i}" if i % 4 else None) for j in range(9) for i in range(40)]
    late = lambda e: (e[1] - START).seconds // 3600 + (e[2] % 5 == 0)
    schema = "job_id long, ts timestamp, seq long, stage string, message string"
    end = [(-1, START + dt.timedelta(days=9), 0, "end", "")]
    for k in range(6):
        part = [e for e in events if late(e) == k] if k < 5 else end
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = st.ordered_progress(stream, "3 hours", 24, buckets=2).writeStream.foreachBatch(lambda b, n: calls.extend(b.collect()))
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        keys = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    finally:
        spark.conf.set(store, before)
    plain = lambda t: None if t is None or pd.isna(t) else t
    assert sorted(((*r[:5], plain(r[5])) for r in calls if r[0] != -1), key=repr) == _want(events)
    assert keys < 60


def test_no_due_events_leave_open_stages_alone():
    opened = pd.DataFrame([(1, 3, "a", 5, "x", 9)], columns=st._OPEN.names)
    done, still = st._followed(opened, st._WAITING.empty_table().to_pandas())
    assert len(done) == 0 and still.to_numpy().tolist() == opened.to_numpy().tolist()

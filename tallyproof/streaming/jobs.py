"""Structured Streaming: intake and repair of arriving reports, duplicates, stage progress, latest values, hourly counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def repair_arrivals(reports: DataFrame, repair: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run ``repair`` (a batch plan from reports to rows) on every batch of a stream of reports and keep its rows under
    ``path`` by batch_id. A batch that is run again after a failure overwrites its own rows, so each report counts once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        repair(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return reports.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(reports: DataFrame, mode: str, keep: str = "1 hour") -> DataFrame:
    """The reports (text, arrived_at) of a stream, each text once within ``keep``, with text_sha, the key under which what
    is made of a text in this mode is kept."""
    keyed = reports.withColumn("text_sha", F.sha2(F.concat_ws("\x00", F.lit(mode), F.coalesce("text", F.lit(""))), 256))
    return keyed.withWatermark("arrived_at", keep).dropDuplicatesWithinWatermark(["text_sha"])


_PROGRESS = "job_id long, run int, stage string, started timestamp, message string, completed timestamp"
_STATE = "run int, stage string, started timestamp, message string"


def stage_progress(events: DataFrame, idle_hours: int = 1) -> DataFrame:
    """job_id, run, stage, started, message, completed of the stages of a stream of events (job_id, ts, seq, stage,
    message): a stage is sent when the next one of its job closes it, and, still open (completed is null), once its job has
    been idle for ``idle_hours`` of event time, when its state goes. A repeated stage updates its message. Events of one
    job are taken in order of time within a batch."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["job_id", "run", "stage", "started", "message", "completed"]
        if state.hasTimedOut:
            run, stage, started, message = state.get
            state.remove()
            yield pd.DataFrame([(key[0], run, stage, started, message, pd.NaT)], columns=names)
            return
        run, stage, started, message = state.get if state.exists else (0, None, None, None)
        done = []
        for e in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples(index=False):
            if run and e.stage == stage:
                message = e.message
                continue
            if run:
                done.append((key[0], run, stage, started, message, e.ts))
            run, stage, started, message = run + 1, e.stage, e.ts, e.message
        state.update((run, stage, pd.Timestamp(started).to_pydatetime(), message))
        last = pd.Timestamp(e.ts).tz_localize("UTC") if pd.Timestamp(e.ts).tzinfo is None else pd.Timestamp(e.ts)
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + idle_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=names)

    timed = events.withWatermark("ts", f"{idle_hours} hours")
    return timed.groupBy("job_id").applyInPandasWithState(follow, _PROGRESS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: Waiting events and open stages of the jobs of a bucket; times in microseconds.
_WAITING = pa.schema([("job_id", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("stage", pa.string()), ("message", pa.string())])
_OPEN = pa.schema([("job_id", pa.int64()), ("run", pa.int64()), ("stage", pa.string()), ("started", pa.int64()), ("message", pa.string()), ("at", pa.int64())])


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return out.getvalue().to_pybytes()


def _unpacked(parts: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(p).read_all() for p in parts]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


def _followed(opened: pd.DataFrame, due: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Stages that the due events close, and those open after them, of all jobs; an open stage stands before the events of
    its job like one that began it."""
    if due.empty:
        return opened.head(0).assign(completed=pd.array([], "Int64")), opened
    moved = opened["job_id"].isin(due["job_id"])
    events = due.sort_values(["job_id", "at", "seq"]).assign(run=0, started=lambda e: e["at"])
    x = pd.concat([opened[moved], events[opened.columns]]).sort_values("job_id", kind="stable", ignore_index=True)
    job, stage = x["job_id"].to_numpy(), pd.factorize(x["stage"])[0]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (job[1:] != job[:-1]) | (stage[1:] != stage[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(x)) - 1
    runs = x.loc[begins].reset_index(drop=True)
    for c in ("message", "at"):
        runs[c] = x[c].to_numpy()[ends]
    jobs = runs.groupby("job_id")
    runs["run"] = jobs["run"].transform("first").clip(lower=1) + jobs.cumcount()
    runs["completed"] = jobs["started"].shift(-1).astype("Int64")
    closed = runs["completed"].notna()
    return runs[closed], pd.concat([opened[~moved], runs.loc[~closed, opened.columns]])


def ordered_progress(events: DataFrame, delay: str, idle_hours: int = 1, buckets: int = 256) -> DataFrame:
    """stage_progress for events that arrive late and over several batches: an event waits in a buffer until the watermark,
    ``delay`` behind the latest time seen, has passed it, and is then taken in its place by (ts, seq); so stages come out as
    the batch operator stage_history gives them. Events later than the delay are dropped. An open stage is sent, completed
    null, when its job has been idle for ``idle_hours`` of event time, and its state goes. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).

    Jobs share state by ``buckets``: a call of the processor and a read of its state serve all jobs of a bucket. A task holds the
    waiting events of one bucket."""
    # Needs packages that the batch operators do without.
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    names = ["job_id", "run", "stage", "started", "message", "completed"]
    millis = lambda micros: micros // 1000 + 1  # noqa: E731  (the first whole one behind it)
    idle = idle_hours * 3_600_000

    class Progress(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.pending = handle.getListState("pending", "rows binary")
            self.current = handle.getValueState("current", "rows binary")
            self.timer = handle.getValueState("timer", "at long")

        def wake(self, at: int) -> None:
            """A bucket has one timer, for the earliest of its jobs."""
            self.handle.registerTimer(at)
            self.timer.update((at,))

        def handleInputRows(self, key, rows, timerValues):
            new = pd.concat(list(rows))[_WAITING.names]
            self.pending.appendValue((_packed(new, _WAITING),))
            at = int(millis(new["at"].min()))
            known = self.timer.get()[0] if self.timer.exists() else None
            if known is None or at < known:
                if known is not None:
                    self.handle.deleteTimer(known)
                self.wake(at)
            yield pd.DataFrame([], columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark = timerValues.getCurrentWatermarkInMs()
            waiting = _unpacked([r[0] for r in self.pending.get()] if self.pending.exists() else [], _WAITING)
            opened = _unpacked([self.current.get()[0]] if self.current.exists() else [], _OPEN)
            due = millis(waiting["at"]) <= mark
            left = waiting[~due]
            done, opened = _followed(opened, waiting[due])
            ends = millis(opened["at"]) + idle
            alone = ~opened["job_id"].isin(left["job_id"])
            over = alone & (ends <= mark)
            self.pending.clear()
            self.current.clear()
            self.timer.clear()
            if len(left):
                self.pending.put([(_packed(left, _WAITING),)])
            if not over.all():
                self.current.update((_packed(opened[~over], _OPEN),))
            later = [*millis(left["at"]).nsmallest(1), *ends[alone & ~over].nsmallest(1)]
            if later:
                self.wake(int(min(later)))
            yield pd.concat([done[names], opened.loc[over].assign(completed=pd.array([pd.NA] * int(over.sum()), "Int64"))[names]])

        def close(self) -> None:
            pass

    timed = events.withWatermark("ts", delay).select(F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("_bucket"), "ts", "job_id", F.unix_micros("ts").alias("at"), "seq", "stage", "message")
    rows = timed.groupBy("_bucket").transformWithStateInPandas(Progress(), "job_id long, run int, stage string, started long, message string, completed long", "append", "eventTime")
    return rows.withColumns({c: F.timestamp_micros(c) for c in ("started", "completed")})


def latest_values(values: DataFrame) -> DataFrame:
    """entity, year, amount_won, entry_date: the latest value of a stream (entity, year, entry_date, line_no, amount_won), kept
    as it changes; for update mode."""
    last = F.max(F.struct("entry_date", "line_no", "amount_won"))
    return values.groupBy("entity", "year").agg(last.alias("l")).select("entity", "year", F.col("l.amount_won").alias("amount_won"), F.col("l.entry_date").alias("entry_date"))


def hourly_corrections(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, kind, n of a stream of corrections (at, kind); hours close when nothing later than ``late`` is awaited."""
    x = changes.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "kind").agg(F.count("*").alias("n"))
    return x.select(F.col("window.start").alias("hour"), "kind", "n")

"""Stage histories, retention, verdict look-ups, response contracts, edit guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.functions.facts import LINE_END


def stage_history(events: DataFrame) -> DataFrame:
    """job_id, run, stage, started, message, completed: repeated stages update their message, a new stage closes the
    one before. events: job_id, ts, seq, stage, message."""
    order = Window.partitionBy("job_id").orderBy("ts", "seq")
    x = events.withColumn("_new", (~F.col("stage").eqNullSafe(F.lag("stage").over(order)) | F.lag("seq").over(order).isNull()).cast("int"))
    x = x.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = x.groupBy("job_id", "run").agg(F.first("stage").alias("stage"), F.min("ts").alias("started"), F.max_by("message", F.struct("ts", "seq")).alias("message"))
    return runs.withColumn("completed", F.lead("started").over(Window.partitionBy("job_id").orderBy("run")))


def job_retention(jobs: DataFrame, now, keep: int, hours: int) -> DataFrame:
    """The newest ``keep`` finished jobs (job_id, finished) not older than ``hours``. The limit is taken by a top-k, not
    by numbering all jobs."""
    fresh = jobs.filter(F.col("finished") >= F.lit(now) - F.expr(f"interval {hours} hours"))
    return fresh.orderBy(F.desc("finished"), F.desc("job_id")).limit(keep)


def top_per_document(rows: DataFrame, order: list, k: int, key: str = "doc_id") -> DataFrame:
    """The first ``k`` rows of each document."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def verdict_lookup(requests: DataFrame, verdicts: DataFrame, now, days: int = 7) -> DataFrame:
    """requests (cache_key) with payload of the newest verdict not older than ``days``, and hit."""
    fresh = verdicts.filter(F.col("created_at") >= F.lit(now) - F.expr(f"interval {days} days"))
    newest = fresh.groupBy("cache_key").agg(F.max_by("payload", "created_at").alias("payload"))
    return requests.join(newest, "cache_key", "left").withColumn("hit", F.col("payload").isNotNull())


def first_object(text: Column) -> Column:
    """The first balanced ``{…}`` of a text, braces inside strings not counted; null if none ends. A fold over strings,
    braces and the rest."""
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"?|[{}]|[^{}"]++'), F.lit(0))

    def step(a: Column, t: Column) -> Column:
        depth = a["depth"] + F.when(t == "{", 1).when((t == "}") & (a["depth"] > 0), -1).otherwise(0)
        opens, closes = (t == "{") & (a["depth"] == 0), (t == "}") & (a["depth"] == 1)
        end = F.when(a["end"] > 0, a["end"]).when(closes, a["at"] + 1).otherwise(0)
        return F.struct((a["at"] + F.length(t)).alias("at"), depth.alias("depth"), F.when(opens & (a["end"] == 0), a["at"]).otherwise(a["start"]).alias("start"), end.alias("end"))

    found = F.aggregate(tokens, F.expr("struct(0 as at, 0 as depth, 0 as start, 0 as end)"), step)
    return F.when(found["end"] > 0, F.substring(text, found["start"] + 1, found["end"] - found["start"]))


def response_contract(raw: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """raw (id, raw) with parsed (struct) and status: ok, or rejected for text without a whole object or with a
    required field missing or of another type. Of several objects the first counts; fences and text around it are
    dropped, and so are backslashes that escape nothing JSON knows."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("raw", F.lit(""))), r"(?iU)^```(?:json)?\s*", ""), r"(?U)\s*```$", "")
    clean = F.regexp_replace(F.col("_object"), r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})(?<!\\\\)', "")
    x = raw.withColumn("_object", first_object(text))
    x = x.withColumn("parsed", F.coalesce(F.from_json("_object", schema, {"mode": "PERMISSIVE"}), F.from_json(clean, schema, {"mode": "PERMISSIVE"})))
    good = F.lit(True)
    for name in required:
        good = good & F.col(f"parsed.{name}").isNotNull()
    again = F.when(good, F.col("parsed")).otherwise(F.from_json(clean, schema, {"mode": "PERMISSIVE"}))
    return x.withColumn("parsed", again).withColumn("status", F.when(good, "ok").otherwise("rejected")).drop("_object")


def splice_guard(proposals: DataFrame) -> DataFrame:
    """proposals (text, original, suggested) with occurrences and accepted: the original is there once and differs from
    the suggestion, which has at least half its length, as many line ends, and as many fences, headings, lines with
    pipes and list items. Null texts count as empty; an empty original is never accepted."""
    t, o, s = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "original", "suggested"))
    n = F.when(F.length(o) > 0, ((F.length(t) - F.length(F.replace(t, o, F.lit("")))) / F.length(o)).cast("int")).otherwise(0)

    def shape(c: Column) -> Column:
        lines = F.split(c, LINE_END, -1)
        many = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
        return F.array((F.length(c) - F.length(F.replace(c, F.lit("```"), F.lit("")))).cast("int"), many(r"(?U)^\s*#"), many(r"\|"), many(r"(?U)^\s*[-+*]\s+"), F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))))

    same = (s != "") & (o != s) & (F.length(s) >= F.greatest(F.lit(1), F.floor(F.length(o) * 0.5))) & (shape(o) == shape(s))
    return proposals.withColumn("occurrences", n).withColumn("accepted", (F.col("occurrences") == 1) & same)


def proposal_conflicts(proposals: DataFrame) -> DataFrame:
    """doc_id, original, status (apply or review), suggested: spans with one proposed text apply, others are reviewed."""
    x = proposals.groupBy("doc_id", "original").agg(F.count_distinct("suggested").alias("_n"), F.min("suggested").alias("_s"))
    return x.select("doc_id", "original", F.when(F.col("_n") == 1, "apply").otherwise("review").alias("status"), F.when(F.col("_n") == 1, F.col("_s")).alias("suggested"))

"""Execution traces: validation as a batch, and the same records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.source_text import once
from ..session import Scratch

STATUSES = ["ok", "error", "cancelled", "inconclusive"]


def violations(log: DataFrame) -> DataFrame:
    """run_id, rule, n: how often each rule of a well-formed trace is broken in each run.

    Repeated rows of a record_id count once. Every rule is a filter, an aggregate by (run, span) or a join on it, never a window
    over a run: one run may hold a third of all rows. Rules: seq_gap (no record with the number before, but for the first),
    no_start, no_end, many_starts, many_ends, unknown_parent, ends_after_parent, unstable (kind, name or parent differ between
    start and end, nulls too), bad_status, bad_duration, event_outside (its span is unknown or over), roots (not exactly one run span).
    """
    tmp = Scratch(log.sparkSession)
    used = ["run_id", "record_id", "record", "span_id", "parent_span_id", "seq", "kind", "name", "status", "duration_ms"]
    r = tmp.write(once(log.where("run_id is not null and record_id is not null").select(*used), "record_id"))  # read from many sides, so written once
    spans = r.where("record in ('span.start', 'span.end') and span_id is not null")
    start, end = F.col("record") == "span.start", F.col("record") == "span.end"
    parent = F.when(F.col("parent_span_id") != "", F.col("parent_span_id"))
    s = spans.groupBy("run_id", "span_id").agg(
        F.count_if(start).alias("starts"), F.count_if(end).alias("ends"), F.max(F.when(start, F.col("seq"))).alias("s_seq"), F.max(F.when(end, F.col("seq"))).alias("e_seq"), F.max(parent).alias("parent"),
        F.count_if(start & (F.col("kind") == "run")).alias("run_starts"),
        *(F.countDistinct(F.coalesce(F.col(c), F.lit(""))).alias(f"d_{c}") for c in ("kind", "name", "parent_span_id")),
        F.count_if(end & ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False))).alias("bad_status"), F.count_if(end & ~F.coalesce(F.col("duration_ms") >= 0, F.lit(False))).alias("bad_duration"),
    )
    s = tmp.write(s)
    up = s.select("run_id", F.col("span_id").alias("parent"), F.lit(True).alias("known"), F.col("e_seq").alias("p_end"))
    s = s.join(up, ["run_id", "parent"], "left")
    both = (F.col("starts") > 0) & (F.col("ends") > 0)
    per_span = {
        "no_start": F.col("starts") == 0, "no_end": F.col("ends") == 0, "many_starts": F.col("starts") > 1, "many_ends": F.col("ends") > 1,
        "unknown_parent": F.col("parent").isNotNull() & F.col("known").isNull(), "ends_after_parent": F.col("e_seq") > F.col("p_end"),
        "unstable": both & ((F.col("d_kind") > 1) | (F.col("d_name") > 1) | (F.col("d_parent_span_id") > 1)), "bad_status": F.col("bad_status") > 0, "bad_duration": F.col("bad_duration") > 0,
    }
    a = s.select("run_id", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in per_span.items())))).alias("rule"))
    roots = s.groupBy("run_id").agg(F.sum("run_starts").alias("n")).where("n <> 1").select("run_id", F.lit("roots").alias("rule"))
    first = r.groupBy("run_id").agg(F.min("seq").alias("first"))
    before = r.select("run_id", (F.col("seq") + 1).alias("seq")).distinct()
    gaps = r.join(before, ["run_id", "seq"], "left_anti").join(first, "run_id").where("seq > first").select("run_id", F.lit("seq_gap").alias("rule"))
    ev = r.where("record = 'event'").select("run_id", "span_id", "seq").join(s.select("run_id", "span_id", "starts", "s_seq", "e_seq"), ["run_id", "span_id"], "left")
    outside = ev.where("coalesce(starts, 0) = 0 or seq < s_seq or seq > e_seq").select("run_id", F.lit("event_outside").alias("rule"))
    return a.unionByName(roots).unionByName(gaps).unionByName(outside).groupBy("run_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def summary(log: DataFrame) -> DataFrame:
    """run_id, records, spans, events, failed: each run's size."""
    r = once(log.where("run_id is not null and record_id is not null"), "record_id")
    return r.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct(F.when(F.col("record") == "span.start", F.col("span_id"))).alias("spans"),
        F.count_if(F.col("record") == "event").alias("events"), F.count_if((F.col("record") == "span.end") & (F.col("status") == "error")).alias("failed"),
    )


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there and give what it wrote. Output and progress lie in the shared folder, so a lost executor costs a batch again, no more."""
    tmp = Scratch(spark)
    out = f"{tmp.base}/stream"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp.base}/progress").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_whole(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run an aggregating stream over everything that is there and give its whole last result, in complete mode: nothing is late
    and no window stays open. The state holds a row for each group."""
    tmp = Scratch(spark)
    out = f"{tmp.base}/whole"
    q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n:09d}")).option("checkpointLocation", f"{tmp.base}/progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    done = (q.lastProgress or {}).get("batchId")
    got = spark.read.schema(stream.schema).parquet(f"{out}/batch={done:09d}") if done is not None else spark.createDataFrame([], stream.schema)
    return got.select(*stream.columns)


def window_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """key, window_start, n: tumbling windows. With `late` under a watermark, which drops what is later than that and keeps only
    open windows in its state; without, for a stream that is drained, every row counts."""
    rows = stream.withWatermark(ts, late) if late else stream
    w = rows.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("window.start").alias("window_start"), "n")


def paired_spans(stream: DataFrame) -> DataFrame:
    """run_id, span_id, kind, name, status, duration_ms: each span once its start and its end have both come, in any order.

    Repeated rows are dropped by (run, span, record), then starts and ends meet in a stream-stream join. Spans may stay open for
    any time, so the state of both is kept for good; it is one small row for each start and end.
    """
    rows = stream.where("record in ('span.start', 'span.end') and run_id is not null and span_id is not null").select("run_id", "span_id", "record", "kind", "name", "status", "duration_ms").dropDuplicates(["run_id", "span_id", "record"])
    s = rows.where("record = 'span.start'").select("run_id", "span_id", "kind", "name")
    e = rows.where("record = 'span.end'").select("run_id", "span_id", "status", "duration_ms")
    return s.join(e, ["run_id", "span_id"]).select("run_id", "span_id", "kind", "name", "status", "duration_ms")

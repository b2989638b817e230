"""Structured Streaming: tolerant ingest of JSON lines, once-per-session hints, call-to-result joins, idempotent bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.instants import instant
from tracelode.operators.delivery_index import DeliveryIndex
from tracelode.session import file_system, stored
from tracelode.sources.jsonl import TRACE_EVENT


def event_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """Trace events of all .jsonl files that turn up below `root`, with `ts`; lines that are no objects are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.jsonl").text(root)
    return lines.filter(F.ltrim("value").startswith("{")).select(F.from_json("value", TRACE_EVENT).alias("e")).select("e.*").filter("id is not null").withColumn("ts", instant(F.col("timestamp")))


def first_fires(hints: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each hint once per session (`session_id`, `hint_id`, `ts`); state is dropped after `delay`."""
    return hints.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "hint_id"])


def calls_with_results(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Inner stream-stream join of tool calls and their results by session and call id, at most `within` apart."""
    side = lambda kind, p: events.filter(F.col("type") == kind).select(F.col("sessionId").alias(f"{p}_session"), F.get_json_object("payload", "$.toolCallId").alias(f"{p}_call"), F.col("ts").alias(f"{p}_ts"), F.col("payload").alias(f"{p}_payload")).withWatermark(f"{p}_ts", within)
    return side("tool_call", "c").join(side("tool_result", "r"), F.expr(f"c_session = r_session and c_call = r_call and r_ts between c_ts and c_ts + interval {within}"))


def failure_windows(events: DataFrame, window: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Failures and tool results per window and harness, with late rows up to `delay`."""
    failed = F.coalesce(F.col("metrics.outcome") == "failure", F.lit(False))
    return events.filter("type = 'tool_result'").withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "harness").agg(F.count("*").alias("results"), F.count_if(failed).alias("failures")).select("w.start", "w.end", "harness", "results", "failures")


def bundle_sink(index: DeliveryIndex, out: str):
    """foreachBatch function: each batch goes through the delivery index; `kept` holds exactly one copy of each delivery.

    A copy that a later batch displaces leaves the folder of the batch that brought it: the folders concerned are rewritten
    in the same write as the new one (only those of batches that lost a copy). A batch that is run again after a failure
    gets the verdict that the index has for its number and writes the same folders again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = stored(batch, f"batch-{number}")
        lost = index.offer(batch, number).select(F.col("seq").alias("ingest_seq"))
        lost.write.mode("overwrite").parquet(f"{out}/surplus/batch={number}")
        gone = lost
        for later in sorted(n for n in index.batches if n > number):  # an old batch run again: what was displaced since stays away
            gone = gone.unionByName(index.verdict(later).withColumnRenamed("seq", "ingest_seq"))
        new = batch.join(gone, "ingest_seq", "left_anti").withColumn("batch", F.lit(number))
        fs, where = file_system(spark, f"{out}/kept")
        emptied: list[int] = []
        if fs.exists(where):
            kept = spark.read.schema(new.schema).parquet(f"{out}/kept").filter(F.col("batch") != number)
            touched = [r[0] for r in kept.join(lost, "ingest_seq", "left_semi").select("batch").distinct().toLocalIterator()]
            if touched:  # batch numbers, not rows
                rest = stored(kept.filter(F.col("batch").isin(touched)).join(lost, "ingest_seq", "left_anti"), f"rest-{number}")
                emptied = sorted(set(touched) - {r[0] for r in rest.select("batch").distinct().toLocalIterator()})
                new = new.unionByName(rest)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/kept")
        for b in emptied:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/kept/batch={b}"), True)

    return sink

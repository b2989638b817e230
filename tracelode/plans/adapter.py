"""The trace view of `trace_events`: the same columns for the Spark queries and for their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import payload as P
from tracelode.functions.instants import instant_micros
from tracelode.functions.text import session_part
from tracelode.operators import issues
from tracelode.session import table

_COUNTERS = {"tok_in": "inputUncached", "tok_cached": "inputCached", "tok_out": "output", "tok_think": "thinking", "tok_write": "cacheWrite"}


def _str(key: str) -> str:
    return f"CASE WHEN json_type(doc, '$.{key}') = 'VARCHAR' THEN json_extract_string(doc, '$.{key}') END"


def _filled(key: str) -> str:
    return f"CASE WHEN regexp_matches({_str(key)}, '\\S') THEN {_str(key)} END"


#: Rows with a session id and a readable instant; an event is a failure or success by its outcome or its boolean isError.
TRACE_SQL = f"""
raw AS (
  SELECT *, CASE WHEN json_valid(payload) THEN payload END AS doc,
         CASE WHEN regexp_matches("timestamp", '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN try_cast("timestamp" AS TIMESTAMPTZ) END AS ts,
         string_split(lower(trim("sessionId")), '::') AS parts
  FROM trace_events WHERE regexp_matches("sessionId", '\\S')),
read AS (
  SELECT *, coalesce({_str("command")}, '') AS command, coalesce({", ".join(_filled(k) for k in P.OUTCOME_KEYS)}, '') AS output,
         CASE WHEN json_type(doc, '$.isError') = 'BOOLEAN' THEN CAST(json_extract(doc, '$.isError') AS BOOLEAN) END AS is_error
  FROM raw WHERE ts IS NOT NULL),
traced AS (
  SELECT ingest_seq AS seq, id, epoch_us(ts) // 1000 AS ts_ms, "sessionId" AS session_id, type, is_error, metrics.outcome AS outcome,
         type = 'tool_result' AND (coalesce(metrics.outcome = 'failure', false) OR coalesce(is_error, false)) AS is_failure,
         type = 'tool_result' AND (coalesce(metrics.outcome = 'success', false) OR coalesce(NOT is_error, false)) AS is_success,
         ingest_seq AS k, CAST(coalesce(metrics."latencyMs", 0) AS DECIMAL(18,2)) AS latency_ms, command, output,
         {", ".join(f'CAST(coalesce(metrics.tokens."{f}", 0) AS DECIMAL(18,2)) AS {c}' for c, f in _COUNTERS.items())},
         CAST(coalesce(metrics.cost.usd, 0) AS DECIMAL(18,6)) AS usd,
         coalesce(harness, 'unknown') AS model, coalesce("actorId", '') AS actor,
         CASE WHEN len(parts) IN (3, 4) AND parts[3] IN ('off', 'on') THEN parts[3] WHEN md5("sessionId") < '8' THEN 'off' ELSE 'on' END AS variant
  FROM read)
"""


def traced(spark: SparkSession, sf: str) -> DataFrame:
    """seq, id, ts_ms, session_id, type, is_error, outcome, is_failure, is_success, k, latency_ms, command, output, tok_*, usd, model, actor, variant."""
    s = F.col("sessionId")
    doc = F.when(P.valid(F.col("payload")), F.try_parse_json("payload"))
    dec = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,2)")
    read = (
        table(spark, sf, "trace_events").filter(s.rlike(r"\S")).select("*", instant_micros(F.col("timestamp")).alias("us"), doc.alias("doc")).filter("us is not null")
        .withColumns({"command": F.coalesce(P.string_at(F.col("doc"), "command"), F.lit("")), "output": P.first_text(F.col("doc")), "is_error": P.flag_at(F.col("doc"), "isError")})
    )
    outcome, result = F.col("metrics.outcome"), F.col("type") == "tool_result"
    is_it = lambda name, flag: result & (F.coalesce(outcome == name, F.lit(False)) | F.coalesce(flag, F.lit(False)))
    side = session_part(s, 3)
    return read.select(
        F.col("ingest_seq").alias("seq"), "id", F.floor(F.col("us") / 1000).alias("ts_ms"), s.alias("session_id"), "type", "is_error", outcome.alias("outcome"),
        is_it("failure", F.col("is_error")).alias("is_failure"), is_it("success", ~F.col("is_error")).alias("is_success"),
        F.col("ingest_seq").alias("k"), dec("metrics.latencyMs").alias("latency_ms"), "command", "output", *[dec(f"metrics.tokens.{f}").alias(c) for c, f in _COUNTERS.items()],
        F.coalesce(F.col("metrics.cost.usd"), F.lit(0.0)).cast("decimal(18,6)").alias("usd"), F.coalesce("harness", F.lit("unknown")).alias("model"), F.coalesce("actorId", F.lit("")).alias("actor"),
        F.when(side.isin("off", "on"), side).when(F.md5(s) < "8", "off").otherwise("on").alias("variant"),
    )


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """Recovery episodes of `episodes`, each once, that have a readable start, in the columns of extracted ones.

    The issue of an episode is classified from its signature (command and first error line); its retries are all of that kind.
    """
    dec = lambda c, kind="decimal(18,2)": F.coalesce(F.col(c), F.lit(0.0)).cast(kind)
    retries, kind = F.coalesce(F.col("retries"), F.lit(0.0)).cast("bigint"), F.col("kind")
    family = F.coalesce(F.nullif(F.trim("familySignature"), F.lit("")), F.lit("recovery"))
    e = table(spark, sf, "episodes").dropDuplicates(["episode_no"]).withColumns({"started_ms": F.floor(instant_micros(F.col("startedAt")) / 1000), "ended_ms": F.floor(instant_micros(F.col("endedAt")) / 1000), "family": family})
    e = e.filter("started_ms is not null").withColumn("kind", issues.classify(F.lit(""), F.col("family"))["kind"])
    some = lambda test: F.when(test, retries).otherwise(F.lit(0).cast("bigint"))
    return e.select(
        F.coalesce("sessionId", F.lit("")).alias("session_id"), F.col("episode_no").alias("start_seq"), "started_ms", "ended_ms", retries.alias("retries"), dec("wallTimeMs").alias("wall_ms"), dec("tokenCount").alias("tokens"), dec("tokenProxy").alias("proxy"),
        dec("costUsd", "decimal(18,6)").alias("usd"), F.coalesce("success", F.lit(False)).alias("success"), "family", F.coalesce("source", F.lit("unknown")).alias("model"), F.coalesce("split", F.lit("")).alias("split"), "kind",
        some(kind.isin(*issues.HARMFUL)).alias("harmful"), some(kind.isin("benign_probe", "transient_external")).alias("benign"), some(kind == "unknown_failure").alias("abstained"),
    )

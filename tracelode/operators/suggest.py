"""Suggestions for many queries at once: retrieved hints, a mismatch warning, a mined fix, and a fallback, in rank order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators import search

#: Commands that tell nothing (fixed values).
TRIVIAL = r"^(?:ls|pwd|cd|echo|true|clear|whoami|date)(?:\s|$)"
MISMATCH = r"unknown option|command not found|no such option|cannot find module|no module named|permission denied"


def suggestions(documents: DataFrame, queries: DataFrame, fixes: DataFrame, most: int = 5) -> DataFrame:
    """query_id, rank, kind, title, confidence, evidence.

    Retrieval gives confidence min(.95, score / best score); a document of a trivial command is scaled by .15; below .2 it
    is dropped. A mismatch warning comes first, then hints by confidence, then at most one mined fix, and a query without
    any has the advice to verify first.
    """
    hits = search.bm25(documents, queries, 20).join(documents.select(F.col("doc_id").alias("doc"), "text", "event_id"), "doc")
    best = F.max("score").over(Window.partitionBy("query_id"))
    scale = F.when(F.lower("text").rlike(TRIVIAL), 0.15).otherwise(1.0)
    hits = hits.withColumn("confidence", F.least(F.lit(0.95), F.col("score") / best) * scale).filter("confidence >= 0.2")
    once = F.row_number().over(Window.partitionBy("query_id", "event_id").orderBy(F.desc("confidence"), "doc"))
    hits = hits.withColumn("n", once).filter("n = 1")
    hints = hits.select("query_id", F.lit(1).alias("lane"), F.lit("hint").alias("kind"), F.substring("text", 1, 120).alias("title"), "confidence", F.col("event_id").alias("evidence"))
    warn = hits.filter(F.lower("text").rlike(MISMATCH) & (F.col("confidence") >= 0.12)).groupBy("query_id").agg(F.max("confidence").alias("c"), F.min_by("event_id", "rank").alias("evidence"))
    warnings = warn.select("query_id", F.lit(0).alias("lane"), F.lit("warning").alias("kind"), F.lit("The command or the environment did not match").alias("title"), F.least(F.lit(0.75), F.greatest(F.lit(0.25), "c")).alias("confidence"), "evidence")
    top = fixes.filter("strong").orderBy(F.desc("sessions"), F.desc("support"), F.desc("confidence"), "failure_sig").limit(1)  # the best fix is the feature
    fix = queries.select("query_id").join(F.broadcast(top)).select("query_id", F.lit(2).alias("lane"), F.lit("fix").alias("kind"), F.concat_ws(" -> ", "failure_sig", "success_sig").alias("title"), F.least(F.lit(0.9), F.greatest(F.lit(0.2), F.col("confidence") * 0.95)).alias("confidence"), F.col("first_seq").cast("string").alias("evidence"))
    found = warnings.unionByName(hints).unionByName(fix)
    none = queries.select("query_id").join(found, "query_id", "left_anti").select("query_id", F.lit(3).alias("lane"), F.lit("verify").alias("kind"), F.lit("Verify the command before running it").alias("title"), F.lit(0.2).alias("confidence"), F.lit(None).cast("string").alias("evidence"))
    w = Window.partitionBy("query_id").orderBy("lane", F.round("confidence", 9).desc(), "evidence")
    return found.unionByName(none).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "rank", "kind", "title", F.round("confidence", 6).alias("confidence"), "evidence")

"""Mining of failure-to-fix patterns: each failure with the first acceptable success among the next tool results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.text import command_signature, error_signatures, jaccard
from tracelode.operators.ordered import running


def fix_arcs(trace: DataFrame, ahead: int = 6) -> DataFrame:
    """session_id, failure_seq, success_seq, failure_sig, success_sig.

    Tool results are numbered in the order of arrival (`ordered.running`, so a hot session is not one task); a success meets
    the `ahead` numbers before its own, and each failure keeps the first that is no unchanged retry. `ahead` bounds the rows.
    """
    calls = running(trace.filter("type = 'tool_result'").select("session_id", "seq", "is_failure", "command", "output"), "session_id", ["seq"], n=F.lit(1))
    failed = calls.filter("is_failure").select("session_id", "n", F.col("seq").alias("failure_seq"), "command", "output")
    after = calls.filter("not is_failure").select("session_id", F.col("seq").alias("success_seq"), F.col("command").alias("fix"), F.explode(F.sequence(F.col("n") - ahead, F.col("n") - 1)).alias("n"))
    same = (F.trim("command") == F.trim("fix")) | (jaccard(F.col("command"), F.col("fix")) >= 0.95)
    unchanged = (F.trim("command") != "") & (F.trim("fix") != "") & same
    met = failed.join(after, ["session_id", "n"]).filter(~unchanged)
    first = met.groupBy("session_id", "failure_seq").agg(F.min(F.struct("success_seq", "command", "output", "fix")).alias("x")).select("session_id", "failure_seq", "x.*")
    sig = F.coalesce(F.nullif(command_signature(F.col("command")), F.lit("")), F.try_element_at(error_signatures(F.col("output"), 1), F.lit(1)), F.substring("output", 1, 120))
    return first.select("session_id", "failure_seq", "success_seq", sig.alias("failure_sig"), command_signature(F.col("fix")).alias("success_sig"))


def evidence(arcs: DataFrame, most: int = 8) -> DataFrame:
    """failure_sig, success_sig, evidence: the first `most` distinct events of each fingerprint, failures and their fixes in order.

    Ranks are counted along sorted pieces, so a fingerprint of a third of all arcs is not one task.
    """
    events = arcs.select("failure_sig", "success_sig", F.explode(F.array("failure_seq", "success_seq")).alias("event")).distinct()
    key = F.concat_ws("\u0001", "failure_sig", "success_sig")
    ranked = running(events.withColumn("k", key), "k", ["event"], n=F.lit(1)).filter(F.col("n") < most)
    return ranked.groupBy("failure_sig", "success_sig").agg(F.array_sort(F.collect_list("event")).alias("evidence"))


def fixes(arcs: DataFrame) -> DataFrame:
    """Arcs by fingerprint: support, sessions, confidence; `evidence` has their first events."""
    g = arcs.groupBy("failure_sig", "success_sig").agg(F.count("*").alias("support"), F.count_distinct("session_id").alias("sessions"), F.min("failure_seq").alias("first_seq"))
    n, s = F.least(F.lit(1.0), (F.col("support") - 1) / 4.0), F.least(F.lit(1.0), (F.col("sessions") - 1) / 2.0)
    return g.withColumn("confidence", F.round(F.least(F.lit(0.9), 0.45 + 0.2 * n + 0.25 * s), 6)).withColumn("strong", (F.col("sessions") >= 2) | (F.col("support") >= 3))

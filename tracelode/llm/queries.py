"""The pN_ queries of the llm problems: each over the whole of its tables, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import conversations, leaks, overlap, personal, runs, splits, tokens
from tracelode.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.consecutive_runs(table(spark, sf, "trace_events"), min_length=2)
    return found.select("session_id", "first_event_id", "last_event_id")


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return runs.consecutive_runs(table(spark, sf, "trace_events"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf, "episodes"))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf, "episodes"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.components(table(spark, sf, "episodes")).filter("members > 1").select("episode_no", "group_no")


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf, "episodes"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.session_verdicts(table(spark, sf, "trace_events")).filter("dropped").select("session_id")


def p6_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversations(table(spark, sf, "trace_events"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal.find_details(table(spark, sf, "documents"), table(spark, sf, "roster"))


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """With the key of the session (`spark.tracelode.surrogate.key`), else with one of this run."""
    key = spark.conf.get("spark.tracelode.surrogate.key", None) or secrets.token_hex(16)
    return personal.redact(table(spark, sf, "documents"), table(spark, sf, "roster"), key)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}

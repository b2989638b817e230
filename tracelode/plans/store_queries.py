"""Queries over the trace store itself: trace_events, bundles, documents built from them, suggestions and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import payload as P
from tracelode.operators import issues, mining, search, suggest
from tracelode.operators.bootstrap import bootstrap_reductions
from tracelode.plans.adapter import traced
from tracelode.plans.episode_queries import PAIR_SQL, pairs
from tracelode.sources import jsonl
from tracelode.session import table


def trace_query(spark: SparkSession, sf: str) -> DataFrame:
    """Tool results and user inputs of two days, unreadable timestamps included, the earliest 50 by raw timestamp."""
    rows = jsonl.query(table(spark, sf, "trace_events"), ["tool_result", "user_input"], "2026-01-02 00:00:00", "2026-01-03 23:59:59", 50)
    return rows.select("ingest_seq", "id", "timestamp", "type")


def canonical_events(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.canonicalize(table(spark, sf, "trace_events").select("ingest_seq", "id", "sessionId", "type")).select("ingest_seq", "id", "sessionId")


def bundle_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = jsonl.bundle_key(F.col("teamId"), F.trim("sessionId"), F.lower("contentSha256"))
    return table(spark, sf, "trace_bundles").select("ingest_seq", key.alias("object_key"))


def event_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Events, outcomes and token sums by type and harness, from the nested metrics."""
    e = table(spark, sf, "trace_events")
    tok = lambda c: F.coalesce(F.sum(F.col(f"metrics.tokens.{c}").cast("decimal(18,2)")), F.lit(0)).cast("double")
    return e.groupBy("type", "harness").agg(F.count("*").alias("events"), F.count_if(F.col("metrics.outcome") == "failure").alias("failures"), F.count_if(F.col("metrics.outcome") == "success").alias("successes"), tok("inputUncached").alias("input_tokens"), tok("output").alias("output_tokens"))


def command_usage(spark: SparkSession, sf: str) -> DataFrame:
    """How often each tool is called by surface, with inline scripts and pipes told apart."""
    p = table(spark, sf, "trace_events").filter("type = 'tool_result'").select(P.parsed(F.col("payload"))["command"].alias("c")).filter("c is not null")
    c = F.col("c")
    return p.groupBy(issues.tool_surface(c).alias("surface")).agg(F.count("*").alias("calls"), F.count_if(c.contains("<<") | c.rlike(r"python3? -c ")).alias("inline_scripts"), F.count_if(c.contains("|")).alias("pipes"), F.sum(F.floor(F.length(c) / 4 + 0.5)).alias("tokens"))


def reinvention_tips(spark: SparkSession, sf: str) -> DataFrame:
    """Commands of at least 20 characters against ordered rules; the first rule that matches wins."""
    c = P.squeeze(P.parsed(F.col("payload"))["command"])
    e = table(spark, sf, "trace_events").filter("type = 'tool_call'").select("ingest_seq", c.alias("c")).filter("length(c) >= 20")
    rule = F.when(F.col("c").rlike("^(python|node) .*(-c|-e) "), "inline_script").when(F.col("c").rlike("^(rg|grep) "), "search").when(F.col("c").rlike("^(sed|awk) "), "text_edit").when(F.col("c").rlike("^curl "), "http")
    return e.select("ingest_seq", rule.alias("tip")).filter("tip is not null")


def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of five reductions over all kept pairs, 2,000 resamples."""
    p = pairs(spark, sf).filter("kept")
    found = bootstrap_reductions(p, ["retries", "harmful", "wall_ms", "tokens", "proxy"], "on_start_seq")
    return found.select("statistic", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


def suggest_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions for three queries from the documents built of all tool results, and the mined fixes."""
    t = traced(spark, sf)
    docs = search.build_documents(t.filter("type = 'tool_result'"))
    asked = spark.createDataFrame([("q1", "unknown option tool_b"), ("q2", "cannot find module core/index.ts"), ("q3", "zzz nothing")], "query_id string, text string")
    return suggest.suggestions(docs, asked, mining.fixes(mining.fix_arcs(t)))


QUERIES = {f.__name__: f for f in (trace_query, canonical_events, bundle_keys, event_metrics, command_usage, reinvention_tips, bootstrap_intervals, suggest_batch)}

_BOOT = ("retries", "harmful", "wall_ms", "tokens", "proxy")
_CMD = "json_extract_string(payload, '$.command')"
SQL = {
    "trace_query": """WITH t AS (SELECT *, CASE WHEN regexp_matches("timestamp", '^\\s*\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}') THEN try_cast("timestamp" AS TIMESTAMPTZ) END AS ts FROM trace_events WHERE type IN ('tool_result', 'user_input'))
SELECT ingest_seq, id, "timestamp", type FROM t WHERE (ts IS NULL OR ts >= TIMESTAMPTZ '2026-01-02 00:00:00+00') AND (ts IS NULL OR ts <= TIMESTAMPTZ '2026-01-03 23:59:59+00') ORDER BY "timestamp" NULLS FIRST, ingest_seq LIMIT 50""",
    "canonical_events": """WITH e AS (SELECT ingest_seq, id, "sessionId", string_split(lower(trim("sessionId")), '::') AS p FROM trace_events), r AS (SELECT *, row_number() OVER (PARTITION BY "sessionId", id ORDER BY ingest_seq) AS n FROM e WHERE len(p) IN (3, 4) AND trim(p[2]) <> '') SELECT ingest_seq, id, "sessionId" FROM r WHERE n = 1""",
    "bundle_keys": """SELECT ingest_seq, CASE WHEN regexp_full_match("teamId", '[A-Za-z0-9_-]{1,64}') AND regexp_full_match(trim("sessionId"), '[A-Za-z0-9_.:-]{1,200}') AND regexp_full_match(lower("contentSha256"), '[0-9a-f]{64}') THEN 'teams/' || "teamId" || '/sessions/' || trim("sessionId") || '/' || lower("contentSha256") || '.jsonl.gz' END AS object_key FROM trace_bundles""",
    "bootstrap_intervals": f"""WITH RECURSIVE {PAIR_SQL},
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY on_start_seq) - 1 AS pos, {", ".join(f"CAST({s}_{c} AS DOUBLE) AS {s}_{c}" for c in _BOOT for s in ("off", "on"))} FROM pairs WHERE kept),
powers(bit, a, c) AS (SELECT 0, CAST(1664525 AS HUGEINT), CAST(1013904223 AS HUGEINT) UNION ALL SELECT bit + 1, a * a % 4294967296, (a * c + c) % 4294967296 FROM powers WHERE bit < 30),
maps AS (SELECT list({{'a': a, 'c': c}} ORDER BY bit) AS m FROM powers), size AS (SELECT count(*) AS n FROM p),
draws AS (SELECT k.range AS sample, k.range * n + j.range + 1 AS steps, n FROM size, range(2000) k, range(1000000) j WHERE j.range < n),
states AS (SELECT sample, n, list_reduce(list_prepend(CAST(31 AS HUGEINT), list_transform(range(31), lambda b: CAST(b AS HUGEINT))), lambda s, b: CASE WHEN (steps >> CAST(b AS INTEGER)) & 1 = 1 THEN (m[CAST(b AS INTEGER) + 1].a * s + m[CAST(b AS INTEGER) + 1].c) % 4294967296 ELSE s END) AS s FROM draws, maps),
sums AS (SELECT sample, {", ".join(f"sum({s}_{c}) AS {s}_{c}" for c in _BOOT for s in ("off", "on"))} FROM states JOIN p ON pos = s * n // 4294967296 GROUP BY sample),
v AS ({" UNION ALL ".join(f"SELECT '{c}' AS statistic, CASE WHEN off_{c} <= 0 THEN CASE WHEN on_{c} <= 0 THEN 0.0 ELSE -1.0 END ELSE (off_{c} - on_{c}) / off_{c} END AS x FROM sums" for c in _BOOT)})
SELECT statistic, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.975), 6) AS high FROM v GROUP BY statistic""",
    "event_metrics": "SELECT type, harness, count(*) AS events, count(*) FILTER (metrics.outcome = 'failure') AS failures, count(*) FILTER (metrics.outcome = 'success') AS successes, CAST(coalesce(sum(CAST(metrics.tokens.\"inputUncached\" AS DECIMAL(18,2))), 0) AS DOUBLE) AS input_tokens, CAST(coalesce(sum(CAST(metrics.tokens.output AS DECIMAL(18,2))), 0) AS DOUBLE) AS output_tokens FROM trace_events GROUP BY type, harness",
    "command_usage": f"WITH c AS (SELECT {_CMD} AS c FROM trace_events WHERE type = 'tool_result' AND json_valid(payload)), w AS (SELECT c, split_part(trim(c), ' ', 1) AS w FROM c WHERE c IS NOT NULL) SELECT CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in issues.SURFACES) + " ELSE 'other' END AS surface, count(*) AS calls, count(*) FILTER (contains(c, '<<') OR regexp_matches(c, 'python3? -c ')) AS inline_scripts, count(*) FILTER (contains(c, '|')) AS pipes, CAST(sum(floor(length(c) / 4 + 0.5)) AS BIGINT) AS tokens FROM w GROUP BY 1",
    "reinvention_tips": f"WITH c AS (SELECT ingest_seq, trim(regexp_replace({_CMD}, '[\\s\x0b\u00a0]+', ' ', 'g')) AS c FROM trace_events WHERE type = 'tool_call' AND json_valid(payload)), t AS (SELECT ingest_seq, CASE WHEN regexp_matches(c, '^(python|node) .*(-c|-e) ') THEN 'inline_script' WHEN regexp_matches(c, '^(rg|grep) ') THEN 'search' WHEN regexp_matches(c, '^(sed|awk) ') THEN 'text_edit' WHEN regexp_matches(c, '^curl ') THEN 'http' END AS tip FROM c WHERE length(c) >= 20) SELECT * FROM t WHERE tip IS NOT NULL",
}

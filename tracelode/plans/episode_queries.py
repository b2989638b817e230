"""Episodes, pairs, aggregates, gates and strata over the trace view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import episodes as E
from tracelode.operators import issues
from tracelode.operators.ordered import running
from tracelode.plans.adapter import TRACE_SQL, observed, traced

_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[0-9a-f]{{8,}}', '<hex>', 'g'), '\\b[0-9]+\\b', '<num>', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_ERROR = "(?i)(error|exception|failed|failure|fatal|panic|traceback|not found|denied|cannot|unable to)"
_FAMILY_SQL = f"""coalesce(
  nullif(substr(trim(concat_ws(' ', substr({_NORMAL.format("command")}, 1, 240), substr({_NORMAL.format(f"list_filter(string_split(output, chr(10)), lambda x: regexp_matches(x, '{_ERROR}'))[1]")}, 1, 240))), 1, 240), ''),
  list_filter(list_transform(string_split(output, chr(10)), lambda x: substr({_NORMAL.format("x")}, 1, 240)), lambda x: x <> '')[1], 'recovery')
"""

EPISODE_SQL = f"""
{TRACE_SQL},
islands AS (
  SELECT *, coalesce(sum(CAST(is_success AS INT)) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM traced),
marked AS (
  SELECT *, min(CASE WHEN is_failure AND NOT is_success THEN (ts_ms, seq) END) OVER g AS start, max(CASE WHEN is_success THEN (ts_ms, seq) END) OVER g AS stop
  FROM islands WINDOW g AS (PARTITION BY session_id, grp)),
spans AS (SELECT *, {_FAMILY_SQL} AS fam FROM marked WHERE start IS NOT NULL AND stop IS NOT NULL AND (ts_ms, seq) >= start),
episodes AS (
  SELECT session_id, arg_min(seq, (ts_ms, seq)) AS start_seq, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms, CAST(sum(CAST(is_failure AS INT)) AS BIGINT) AS retries,
         sum(latency_ms) AS wall_ms, sum(tok_in + tok_cached + tok_out + tok_think + tok_write) AS tokens, sum(tok_in * 1.0 + tok_cached * 0.2 + tok_out * 1.0 + tok_think * 1.0 + tok_write * 0.2) AS proxy,
         arg_min(fam, (ts_ms, seq)) AS family, arg_min(model, (ts_ms, seq)) AS model, count(*) AS events
  FROM spans GROUP BY session_id, grp)
"""

_RATIO = "CASE WHEN {a} = 0 AND {b} = 0 THEN 1.0 WHEN {a} <= 0 OR {b} <= 0 THEN CAST('Infinity' AS DOUBLE) ELSE greatest(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / least(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END"
_COLS = ("session_id", "start_seq", "started_ms", "retries", "wall_ms", "tokens", "proxy", "model", "usd", "success", "harmful", "benign", "abstained")


def _says(pattern: str) -> str:
    return f"regexp_matches(plain, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


_INSTANT = "CASE WHEN regexp_matches({0}, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN epoch_us(try_cast({0} AS TIMESTAMPTZ)) // 1000 END"
#: The episodes of the table, classified by what their signature says (rules that need a command can't hold).
OBSERVED_SQL = f"""
known AS (SELECT DISTINCT * FROM episodes),
dated AS (
  SELECT *, {_INSTANT.format('"startedAt"')} AS started_ms, {_INSTANT.format('"endedAt"')} AS ended_ms, coalesce(nullif(trim("familySignature"), ''), 'recovery') AS family FROM known),
said AS (SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_replace(family, '\\x1b\\[[0-9;]*m', '', 'g')), '[0-9a-f]{{8,}}', '<hex>', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS plain FROM dated WHERE started_ms IS NOT NULL),
kinds AS (
  SELECT *, CASE WHEN {_says(issues.TRANSIENT)} THEN 'transient_external' WHEN {_says(issues.COMMAND_MISMATCH)} THEN 'command_mismatch' WHEN {_says(issues.MISSING_CONTEXT)} THEN 'missing_context'
    WHEN {_says(issues.ENVIRONMENT_MISMATCH)} OR starts_with(family, '(no output)') THEN 'environment_mismatch' ELSE 'unknown_failure' END AS kind, CAST(coalesce(retries, 0) AS BIGINT) AS n FROM said),
observed AS (
  SELECT coalesce("sessionId", '') AS session_id, episode_no AS start_seq, started_ms, ended_ms, n AS retries, CAST(coalesce("wallTimeMs", 0) AS DECIMAL(18,2)) AS wall_ms, CAST(coalesce("tokenCount", 0) AS DECIMAL(18,2)) AS tokens,
    CAST(coalesce("tokenProxy", 0) AS DECIMAL(18,2)) AS proxy, CAST(coalesce("costUsd", 0) AS DECIMAL(18,6)) AS usd, coalesce(success, false) AS success, family, coalesce(source, 'unknown') AS model, coalesce(split, '') AS split, kind,
    CASE WHEN kind IN ('command_mismatch', 'missing_context', 'environment_mismatch') THEN n ELSE 0 END AS harmful, CASE WHEN kind IN ('benign_probe', 'transient_external') THEN n ELSE 0 END AS benign, CASE WHEN kind = 'unknown_failure' THEN n ELSE 0 END AS abstained
  FROM kinds)
"""
PAIR_SQL = f"""
{OBSERVED_SQL},
lagged AS (
  SELECT family, {", ".join(f"lag({c}) OVER w AS off_{c}" for c in _COLS)}, {", ".join(f"{c} AS on_{c}" for c in _COLS)}
  FROM observed WINDOW w AS (PARTITION BY family ORDER BY started_ms, start_seq)),
rated AS (
  SELECT *, {_RATIO.format(a="off_wall_ms", b="on_wall_ms")} AS wall_ratio, {_RATIO.format(a="off_tokens", b="on_tokens")} AS token_ratio, off_session_id <> on_session_id AS crossed
  FROM lagged WHERE off_start_seq IS NOT NULL),
pairs AS (SELECT *, wall_ratio <= 4 AND token_ratio <= 4 AND crossed AS kept FROM rated)
"""


def _red(c: str) -> str:
    return f"round(CASE WHEN off_{c} <= 0 THEN CASE WHEN on_{c} <= 0 THEN 0.0 ELSE -1.0 END ELSE CAST(off_{c} - on_{c} AS DOUBLE) / CAST(off_{c} AS DOUBLE) END, 6)"


_SUMS = ", ".join(f"coalesce(sum({s}_{c}), 0) AS {s}_{c}" for s in ("off", "on") for c in ("retries", "wall_ms", "tokens", "proxy"))
_REDS = f"{_red('retries')} AS dead_end_reduction, {_red('wall_ms')} AS wall_reduction, {_red('tokens')} AS token_reduction, {_red('proxy')} AS proxy_reduction"
_OUT = [f"{s}_{c}" for s in ("off", "on") for c in ("retries", "wall_ms", "tokens", "proxy")]


def _doubles(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in names})


def _dsql(names: list[str]) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in names)


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return E.extract_episodes(traced(spark, sf))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return E.adjacent_pairs(observed(spark, sf))


_EP = ["wall_ms", "tokens", "proxy"]


def episodes_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(episodes(spark, sf), _EP).select("session_id", "start_seq", "started_ms", "ended_ms", "retries", "family", "model", "events", *_EP)


def pairs_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).filter("kept").select("family", "off_start_seq", "on_start_seq", F.round("wall_ratio", 6).alias("wall_ratio"), F.round("token_ratio", 6).alias("token_ratio"), F.round(E.quality(), 6).alias("quality"))


def pairing_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    eps, prs = observed(spark, sf), pairs(spark, sf)
    fam = eps.groupBy("family").agg(F.count("*").alias("n")).agg(F.count("*").alias("families_seen"), F.count_if(F.col("n") > 1).alias("families_eligible"))
    trans = prs.agg(F.count("*").alias("transitions"), F.count_if("crossed").alias("crossed"), F.count_if("kept").alias("kept"), F.count_if(F.col("crossed") & ~F.col("kept")).alias("dropped_outliers"))
    return fam.join(trans)


def pair_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(E.aggregate_pairs(pairs(spark, sf)), _OUT)


def strata_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by model, by tool, and by both, in one pass."""
    p = pairs(spark, sf).filter("kept").withColumn("tool", F.split("family", " ")[0])
    sets = p.groupingSets([["on_model"], ["tool"], ["on_model", "tool"]], "on_model", "tool")
    g = sets.agg(F.count("*").alias("pairs"), F.sum("off_retries").alias("off_retries"), F.sum("on_retries").alias("on_retries"), F.grouping_id().cast("int").alias("level"))
    return g.select("on_model", "tool", "pairs", "off_retries", "on_retries", "level", F.round((F.col("off_retries") - F.col("on_retries")) / F.col("off_retries"), 6).alias("reduction"))


def family_totals(spark: SparkSession, sf: str) -> DataFrame:
    return observed(spark, sf).groupBy("family").agg(F.count("*").alias("episodes"), F.count_distinct("session_id").alias("sessions"), F.sum("retries").alias("retries"), F.round(F.sum("wall_ms").cast("double"), 6).alias("wall_ms"), F.substring(F.sha2("family", 256), 1, 16).alias("family_id"))


def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions in the order of their start; the last half is the evaluation side."""
    s = traced(spark, sf).groupBy("session_id").agg(F.min("ts_ms").alias("started_ms")).withColumn("all", F.lit(""))
    placed = running(s, "all", ["started_ms", "session_id"], before=F.lit(1))
    sized = placed.join(F.broadcast(s.agg(F.count("*").alias("total"))))  # one row
    held = F.least(F.col("total") - 1, F.greatest(F.lit(1), F.floor(F.col("total") * 0.5 + 0.5)))
    return sized.select("session_id", F.when((F.col("total") > 1) & (F.col("before") >= F.col("total") - held), "eval").otherwise("train").alias("side"))


def family_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out episodes whose family is not in train (left anti join)."""
    e = observed(spark, sf)
    train = e.filter("split = 'train'").select("family").distinct()
    return e.filter("split <> 'train'").join(train, "family", "left_anti").select("session_id", "start_seq", "family")


def family_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Families on both sides, with their held-out episodes (left semi join)."""
    e = observed(spark, sf)
    train = e.filter("split = 'train'").select("family").distinct()
    return e.filter("split <> 'train'").join(train, "family", "left_semi").groupBy("family").agg(F.count("*").alias("eval_episodes"))


_SPLIT_SQL = """
starts AS (SELECT session_id, min(ts_ms) AS started_ms FROM traced GROUP BY 1),
placed AS (SELECT session_id, row_number() OVER (ORDER BY started_ms, session_id) AS position, count(*) OVER () AS total FROM starts),
sides AS (SELECT session_id, CASE WHEN total > 1 AND position > total - least(total - 1, greatest(1, CAST(floor(total * 0.5 + 0.5) AS BIGINT))) THEN 'eval' ELSE 'train' END AS side FROM placed)
"""

QUERIES = {f.__name__: f for f in (episodes_extract, pairs_adjacent, pairing_diagnostics, pair_aggregate, strata_grouping_sets, family_totals, holdout_split, family_disjoint, family_overlap)}

_AGG = f"{PAIR_SQL}, sums AS (SELECT count(*) AS pairs, {_SUMS} FROM pairs WHERE kept), agg AS (SELECT *, {_REDS} FROM sums)"

SQL = {
    "episodes_extract": f"WITH {EPISODE_SQL} SELECT session_id, start_seq, started_ms, ended_ms, retries, family, model, events, {_dsql(_EP)} FROM episodes",
    "pairs_adjacent": f"WITH {PAIR_SQL} SELECT family, off_start_seq, on_start_seq, round(wall_ratio, 6) AS wall_ratio, round(token_ratio, 6) AS token_ratio, round(1 / (1 + abs(log2(wall_ratio)) + abs(log2(token_ratio))), 6) AS quality FROM pairs WHERE kept",
    "pairing_diagnostics": f"WITH {PAIR_SQL}, fam AS (SELECT family, count(*) AS n FROM observed GROUP BY 1) SELECT (SELECT count(*) FROM fam) AS families_seen, (SELECT count(*) FROM fam WHERE n > 1) AS families_eligible, count(*) AS transitions, count(*) FILTER (crossed) AS crossed, count(*) FILTER (kept) AS kept, count(*) FILTER (crossed AND NOT kept) AS dropped_outliers FROM pairs",
    "pair_aggregate": f"WITH {_AGG} SELECT pairs, {_dsql(_OUT)}, dead_end_reduction, wall_reduction, token_reduction, proxy_reduction FROM agg",
    "strata_grouping_sets": f"WITH {PAIR_SQL}, k AS (SELECT *, split_part(family, ' ', 1) AS tool FROM pairs WHERE kept) SELECT on_model, tool, count(*) AS pairs, CAST(sum(off_retries) AS BIGINT) AS off_retries, CAST(sum(on_retries) AS BIGINT) AS on_retries, CAST(grouping(on_model, tool) AS INTEGER) AS level, round((sum(off_retries) - sum(on_retries)) / sum(off_retries), 6) AS reduction FROM k GROUP BY GROUPING SETS ((on_model), (tool), (on_model, tool))",
    "family_totals": f"WITH {OBSERVED_SQL} SELECT family, count(*) AS episodes, count(DISTINCT session_id) AS sessions, CAST(sum(retries) AS BIGINT) AS retries, round(CAST(sum(wall_ms) AS DOUBLE), 6) AS wall_ms, substr(sha256(family), 1, 16) AS family_id FROM observed GROUP BY family",
    "holdout_split": f"WITH {TRACE_SQL}, {_SPLIT_SQL} SELECT session_id, side FROM sides",
    "family_disjoint": f"WITH {OBSERVED_SQL} SELECT session_id, start_seq, family FROM observed WHERE split <> 'train' AND family NOT IN (SELECT family FROM observed WHERE split = 'train')",
    "family_overlap": f"WITH {OBSERVED_SQL} SELECT family, count(*) AS eval_episodes FROM observed WHERE split <> 'train' AND family IN (SELECT family FROM observed WHERE split = 'train') GROUP BY family",
}

"""Calibration, feasibility, gates, lanes and canary decisions over the trace view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.functions.metrics import checks, f1, relative_reduction, safe_rate, token_proxy
from tracelode.operators import issues
from tracelode.operators.ordered import running
from tracelode.plans.adapter import TRACE_SQL, traced
from tracelode.plans.text_queries import _CONF, _HARM, _KIND

_CLASSES = ("benign_probe", "command_mismatch", "environment_mismatch", "missing_context", "transient_external", "unknown_failure")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Classified failures with a second opinion: every fifth by k has the next class, every seventh is unlabelled."""
    f = traced(spark, sf).filter("is_failure").withColumn("i", issues.classify(F.col("command"), F.col("output")))
    names = F.array(*[F.lit(c) for c in _CLASSES])
    nxt = F.element_at(names, (F.pmod(F.array_position(names, F.col("i.kind")), F.lit(6)) + 1).cast("int"))
    manual = F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 5 == 0, nxt).otherwise(F.col("i.kind"))
    rows = f.select("seq", "session_id", "variant", "k", F.col("i.kind").alias("predicted"), F.col("i.harmful").alias("harmful"), F.col("i.confidence").alias("confidence"), F.col("i.abstained").alias("abstained"), manual.alias("manual"))
    return rows.withColumn("manual_harmful", F.when(F.col("manual").isNotNull(), F.col("manual").isin("command_mismatch", "environment_mismatch", "missing_context")))


def calibration_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Dense confusion matrix of predicted and manual kinds."""
    rows = _labelled(spark, sf)
    spine = spark.createDataFrame([(a, b) for a in _CLASSES for b in _CLASSES], "predicted string, manual string")
    counts = rows.filter("manual is not null").groupBy("predicted", "manual").agg(F.count("*").alias("n"))
    return spine.join(counts, ["predicted", "manual"], "left").select("predicted", "manual", F.coalesce("n", F.lit(0)).alias("n"))


def calibration_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of each kind."""
    m = calibration_confusion(spark, sf)
    per = m.groupBy(F.col("predicted").alias("kind")).agg(F.sum("n").alias("predicted_n"), F.sum(F.when(F.col("predicted") == F.col("manual"), F.col("n")).otherwise(0)).alias("hits")).join(m.groupBy(F.col("manual").alias("kind")).agg(F.sum("n").alias("support")), "kind")
    per = per.withColumns({"precision": safe_rate(F.col("hits"), F.col("predicted_n")), "recall": safe_rate(F.col("hits"), F.col("support"))})
    return per.select("kind", "support", "predicted_n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


def harmful_metrics(spark: SparkSession, sf: str) -> DataFrame:
    full = _labelled(spark, sf).filter("manual is not null")
    h, m = F.col("harmful"), F.col("manual_harmful")
    c = full.agg(F.count_if(h & m).alias("tp"), F.count_if(h & ~m).alias("fp"), F.count_if(~h & m).alias("fn"), F.count_if(~h & ~m).alias("tn"), F.count_if("abstained").alias("abstained"), F.count("*").alias("rows"))
    col = F.col
    return c.withColumns({"precision": F.round(safe_rate(col("tp"), col("tp") + col("fp")), 6), "recall": F.round(safe_rate(col("tp"), col("tp") + col("fn")), 6), "accuracy": F.round(safe_rate(col("tp") + col("tn"), col("rows")), 6), "abstain_rate": F.round(safe_rate(col("abstained"), col("rows")), 6)})


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Harmful F1 at each confidence threshold from 0 to .95; below it a row abstains. Rows are counted once per confidence."""
    full = _labelled(spark, sf).filter("manual is not null").groupBy("confidence", "abstained", "harmful", "manual_harmful").agg(F.count("*").alias("n"))
    grid = spark.range(96).select((F.col("id") / 100).alias("threshold"))
    judged = (~F.col("abstained")) & (F.col("confidence") >= F.col("threshold"))
    n = lambda cond: F.sum(F.when(judged & cond, F.col("n")).otherwise(0))
    h, m = F.col("harmful"), F.col("manual_harmful")
    g = full.join(F.broadcast(grid)).groupBy("threshold").agg(n(h & m).alias("tp"), n(h & ~m).alias("fp"), F.sum(F.when(m & ~(judged & h), F.col("n")).otherwise(0)).alias("fn"), n(F.lit(True)).alias("judged"), F.sum("n").alias("rows"))
    p, r = safe_rate(F.col("tp"), F.col("tp") + F.col("fp")), safe_rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select(F.round("threshold", 2).alias("threshold"), "tp", "fp", "fn", F.round(f1(p, r), 6).alias("f1"), F.round(safe_rate(F.col("judged"), F.col("rows")), 6).alias("coverage"))


def adjudication(spark: SparkSession, sf: str) -> DataFrame:
    """Two reviewers (b answers only even rows): agreement, conflicts and what is missing."""
    base = _labelled(spark, sf)
    a = base.filter("manual is not null").select("seq", F.col("manual").alias("a"))
    b = base.filter("k % 2 = 0").select("seq", F.col("predicted").alias("b"))
    j = base.select("seq").join(a, "seq", "left").join(b, "seq", "left")
    state = F.when(F.col("a").isNull() & F.col("b").isNull(), "none").when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "agreed").otherwise("conflict")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


def dual_review(spark: SparkSession, sf: str) -> DataFrame:
    """The first tenth (by a hash order) goes to both reviewers, the rest in turns."""
    rows = _labelled(spark, sf).select("seq")
    placed = running(rows.select("seq", F.lit("").alias("all"), F.sha2(F.col("seq").cast("string"), 256).alias("h")), "all", ["h", "seq"], i=F.lit(1))
    n = placed.join(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    both = F.floor(F.col("n") * 0.1 + 0.5)
    return n.select("seq", F.when(F.col("i") < both, "both").when((F.col("i") - both) % 2 == 0, "a").otherwise("b").alias("reviewer"))


def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of each session: sums, retries by outcome only, success = the last outcome, true where there is none."""
    t = traced(spark, sf)
    proxy = F.sum(token_proxy(F.col("tok_in"), F.col("tok_cached"), F.col("tok_out")))
    last = F.max_by(F.col("outcome") == "success", F.when(F.col("outcome").isNotNull(), F.struct("ts_ms", "seq")))
    return t.groupBy("session_id").agg(F.round(F.sum("latency_ms").cast("double"), 6).alias("latency_ms"), F.round(proxy.cast("double"), 6).alias("proxy"), F.count_if((F.col("type") == "tool_result") & (F.col("outcome") == "failure")).alias("retries"), F.coalesce(last, F.lit(True)).alias("success"))


def session_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Long-horizon sessions: at least two tool results, and a minute or 100 ms of latency."""
    g = traced(spark, sf).groupBy("session_id").agg(F.min("ts_ms").alias("started_ms"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"), F.count("*").alias("events"), F.count_if(F.col("type") == "tool_result").alias("tool_results"), F.round(F.sum("latency_ms").cast("double"), 6).alias("latency_ms"))
    return g.filter("tool_results >= 2 and (duration_ms >= 60000 or latency_ms >= 100)")


def model_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The model of each user's day, `mixed:` with all of them where there are several (by tool result parity)."""
    t = traced(spark, sf).withColumn("m", F.when(F.col("k") % 3 == 0, "unknown").when(F.col("k") % 2 == 0, F.col("model")).otherwise("model-x"))
    keys = F.array_sort(F.collect_set(F.when(F.col("m") != "unknown", F.col("m"))))
    g = t.groupBy("session_id").agg(keys.alias("keys"))
    return g.select("session_id", F.when(F.size("keys") == 0, "unknown").when(F.size("keys") == 1, F.col("keys")[0]).otherwise(F.concat(F.lit("mixed:"), F.array_join("keys", "|"))).alias("model_key"))


def variant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The k-th off session with the k-th on session of each task instance and replicate (positional join)."""
    sid = F.col("session_id")
    t = traced(spark, sf).withColumns({"instance": T.session_part(sid, 2), "side": T.session_part(sid, 3), "replicate": F.coalesce(T.session_part(sid, 4), F.lit("r1"))}).filter("instance is not null")
    tokens = F.col("tok_in") + F.col("tok_cached") + F.col("tok_out") + F.col("tok_think") + F.col("tok_write")
    f = t.withColumn("harmful", F.col("is_failure") & issues.classify(F.col("command"), F.col("output"))["harmful"])
    s = f.groupBy("instance", "replicate", "side", "session_id").agg(F.min("ts_ms").alias("t"), F.count_if("is_failure").alias("failures"), F.count_if("harmful").alias("harmful"), F.sum("latency_ms").alias("latency"), F.sum(tokens).alias("tokens"))
    rn = s.withColumn("rn", F.row_number().over(Window.partitionBy("instance", "replicate", "side").orderBy("t", "session_id")))  # the sessions of one replicate
    off, on = (rn.filter(F.col("side") == v).select("instance", "replicate", "rn", F.col("session_id").alias(f"{v}_session"), *[F.col(c).alias(f"{v}_{c}") for c in ("failures", "harmful", "latency", "tokens")]) for v in ("off", "on"))
    red = lambda c: F.round(relative_reduction(F.col(f"off_{c}"), F.col(f"on_{c}")), 6).alias(f"{c}_reduction")
    return off.join(on, ["instance", "replicate", "rn"]).select("instance", "replicate", "rn", "off_session", "on_session", "off_failures", "on_failures", "off_harmful", "on_harmful", red("latency"), red("tokens"))


def paired_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over all variant pairs: failures, harmful ones, their rate among failures, reductions, and the validity gate."""
    p = variant_pairs(spark, sf).agg(F.count("*").alias("pairs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("off_failures", "on_failures", "off_harmful", "on_harmful")])
    rate = lambda v: F.round(safe_rate(F.col(f"{v}_harmful"), F.col(f"{v}_failures")), 6)
    red = lambda c: F.round(relative_reduction(F.col(f"off_{c}"), F.col(f"on_{c}")), 6)
    out = p.withColumns({"off_rate": rate("off"), "on_rate": rate("on"), "failure_reduction": red("failures")}).withColumn("rate_reduction", F.round(relative_reduction(F.col("off_rate"), F.col("on_rate")), 6))
    return out.withColumn("failures", checks(("pairs", F.col("pairs") >= 3), ("reduction", F.col("failure_reduction") >= 0.1)))


def pairing_counters(spark: SparkSession, sf: str) -> DataFrame:
    """How sessions pair: with an identity, without, by side, runs, runs with both sides, and sessions left without a partner."""
    sid = F.col("session_id")
    s = traced(spark, sf).select("session_id").distinct().withColumns({"instance": T.session_part(sid, 2), "side": T.session_part(sid, 3), "replicate": F.coalesce(T.session_part(sid, 4), F.lit("r1"))})
    known = F.col("instance").isNotNull()
    r = s.groupBy(known.alias("known"), "instance", "replicate").agg(F.count_if(F.col("side") == "off").alias("off"), F.count_if(F.col("side") == "on").alias("on"), F.count("*").alias("n"))
    k, pair = F.col("known"), F.least("off", "on")
    total = lambda c, cond=k: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    return r.agg(
        total(F.col("n"), F.lit(True)).alias("sessions"), total(F.col("n"), ~k).alias("without_identity"), total(F.col("off")).alias("off_sessions"), total(F.col("on")).alias("on_sessions"), total(F.col("n") - F.col("off") - F.col("on")).alias("other_sessions"),
        F.count_if(k).alias("runs"), F.count_if(k & (pair > 0)).alias("runs_with_both"), total(pair).alias("pairs"), total(F.col("off") + F.col("on") - 2 * pair).alias("unpaired"),
    )


def variant_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Exact medians of session totals by model and variant."""
    s = traced(spark, sf).groupBy("session_id", "model", "variant").agg(F.count("*").cast("double").alias("events"), F.sum("latency_ms").cast("double").alias("latency"))
    return s.groupBy("model", "variant").agg(F.count("*").alias("sessions"), F.round(F.percentile("events", 0.5), 6).alias("events_median"), F.round(F.percentile("latency", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))[1], 6).alias("latency_median"))


def run_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Censored sessions (at most one event, no checkpoint, or no tool result) and coverage by variant."""
    s = traced(spark, sf).groupBy("session_id", "variant").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "checkpoint").alias("checkpoints"), F.count_if(F.col("type") == "tool_result").alias("tool_results"))
    s = s.withColumn("censored", (F.col("events") <= 1) | (F.col("checkpoints") < 1) | (F.col("tool_results") < 1))
    return s.groupBy("variant").agg(F.count("*").alias("sessions"), F.count_if("censored").alias("censored"), F.count_if(F.col("checkpoints") > 0).alias("with_checkpoint"), F.round(F.count_if("censored") / F.count("*"), 6).alias("censor_rate"))


def feasibility(spark: SparkSession, sf: str) -> DataFrame:
    """Estimate by scenario (a family's first hit rank): assist 1, .6, .35 or 0, retries removed, gate over the totals."""
    t = traced(spark, sf).filter("is_failure")
    s = t.groupBy("session_id").agg(F.count("*").alias("retries"), F.sum("latency_ms").alias("overhead"), F.min(F.col("k") % 5).alias("rank"))
    assist = F.when(F.col("rank") == 1, 1.0).when(F.col("rank") == 2, 0.6).when(F.col("rank") == 3, 0.35).otherwise(0.0)
    s = s.withColumn("assist", assist).withColumn("removed", F.when(F.col("assist") > 0, F.greatest(F.lit(1), F.ceil(F.col("retries") * F.col("assist")))).otherwise(0))
    hit = lambda n: F.count_if((F.col("rank") >= 1) & (F.col("rank") <= n)) / F.count("*")
    a = s.agg(F.count("*").alias("scenarios"), F.round(hit(1), 6).alias("hit1"), F.round(hit(3), 6).alias("hit3"), F.round(F.avg(F.when(F.col("rank").between(1, 3), 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"), F.sum("retries").alias("off_retries"), (F.sum("retries") - F.sum("removed")).alias("on_retries"))
    return a.withColumn("failures", checks(("hit1", F.col("hit1") >= 0.1), ("hit3", F.col("hit3") >= 0.9), ("mrr", F.col("mrr") >= 0.3), ("retries", relative_reduction(F.col("off_retries"), F.col("on_retries")) >= 0.25)))


def canary_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Hold, roll back or promote each model by its success rate; rolling back is tested first."""
    w = traced(spark, sf).filter("outcome is not null").groupBy("model").agg(F.count("*").alias("samples"), F.count_if("is_success").alias("successes"))
    rate = F.col("successes") / F.col("samples")
    return w.select("model", "samples", "successes", F.when(F.col("samples") < 50, "hold").when(1 - rate >= 0.55, "rollback").when(rate >= 0.5, "promote").otherwise("hold").alias("decision"))


def dominant_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent issue kind of each session: by count, top confidence, then name."""
    g = _labelled(spark, sf).groupBy("session_id", F.col("predicted").alias("kind")).agg(F.count("*").alias("n"), F.max("confidence").alias("top"), F.max_by("seq", F.struct("confidence", "seq")).alias("event_seq"))
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), F.desc("top"), "kind"))
    return g.withColumn("rn", rn).filter("rn = 1").select("session_id", "kind", "n", "event_seq")


_LAB = f"""{TRACE_SQL}, i AS (SELECT *, {_KIND} AS predicted, {_CONF} AS confidence FROM traced WHERE is_failure),
c AS (SELECT [{", ".join(repr(x) for x in _CLASSES)}] AS names),
lab AS (SELECT seq, session_id, variant, k, predicted, {_HARM.replace("kind", "predicted")} AS harmful, CAST(confidence AS DOUBLE) AS confidence, predicted = 'unknown_failure' AS abstained,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN names[list_position(names, predicted) % 6 + 1] ELSE predicted END AS manual FROM i, c),
labelled AS (SELECT *, {_HARM.replace("kind", "manual")} AS manual_harmful FROM lab)"""
_CONFUSION = f"{_LAB}, spine AS (SELECT a.n AS predicted, b.n AS manual FROM (SELECT unnest(names) AS n FROM c) AS a, (SELECT unnest(names) AS n FROM c) AS b), m AS (SELECT s.predicted, s.manual, count(l.seq) AS n FROM spine s LEFT JOIN labelled l ON l.predicted = s.predicted AND l.manual = s.manual GROUP BY 1, 2)"
_RATE = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / ({1}) ELSE 0.0 END"
_F1 = "CASE WHEN {0} + {1} > 0 THEN 2 * {0} * {1} / ({0} + {1}) ELSE 0.0 END"
_RED = "CASE WHEN {0} <= 0 THEN CASE WHEN {1} <= 0 THEN 0.0 ELSE -1.0 END ELSE CAST({0} - {1} AS DOUBLE) / CAST({0} AS DOUBLE) END"
_VP = f"""{TRACE_SQL}, f AS (SELECT *, {_KIND} AS kind, string_split(lower(trim(session_id)), '::') AS p FROM traced),
s AS (SELECT trim(p[2]) AS instance, coalesce(nullif(trim(p[4]), ''), 'r1') AS replicate, nullif(trim(p[3]), '') AS side, session_id, min(ts_ms) AS t, count(*) FILTER (is_failure) AS failures, count(*) FILTER (is_failure AND {_HARM}) AS harmful,
  sum(latency_ms) AS latency, sum(tok_in + tok_cached + tok_out + tok_think + tok_write) AS tokens FROM f WHERE len(p) IN (3, 4) AND trim(p[2]) <> '' GROUP BY 1, 2, 3, 4),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY instance, replicate, side ORDER BY t, session_id) AS INTEGER) AS rn FROM s),
vp AS (SELECT instance, replicate, rn, a.session_id AS off_session, b.session_id AS on_session, a.failures AS off_failures, b.failures AS on_failures, a.harmful AS off_harmful, b.harmful AS on_harmful,
  round({_RED.format("a.latency", "b.latency")}, 6) AS latency_reduction, round({_RED.format("a.tokens", "b.tokens")}, 6) AS tokens_reduction
  FROM r a JOIN r b USING (instance, replicate, rn) WHERE a.side = 'off' AND b.side = 'on')"""

QUERIES = {
    f.__name__: f
    for f in (calibration_confusion, calibration_classes, harmful_metrics, threshold_sweep, adjudication, dual_review, run_outcomes, session_summaries, model_keys, variant_pairs, paired_totals, pairing_counters, variant_medians, run_quality, feasibility, canary_decision, dominant_issues)
}

SQL = {
    "calibration_confusion": f"WITH {_CONFUSION} SELECT predicted, manual, n FROM m",
    "calibration_classes": f"WITH {_CONFUSION}, p AS (SELECT predicted AS kind, CAST(sum(n) AS BIGINT) AS predicted_n, CAST(sum(n) FILTER (predicted = manual) AS BIGINT) AS hits FROM m GROUP BY 1), s AS (SELECT manual AS kind, CAST(sum(n) AS BIGINT) AS support FROM m GROUP BY 1), r AS (SELECT kind, support, predicted_n, {_RATE.format('hits', 'predicted_n')} AS p, {_RATE.format('hits', 'support')} AS q FROM p JOIN s USING (kind)) SELECT kind, support, predicted_n, round(p, 6) AS precision, round(q, 6) AS recall, round({_F1.format('p', 'q')}, 6) AS f1 FROM r",
    "harmful_metrics": f"WITH {_LAB}, g AS (SELECT count(*) FILTER (harmful AND manual_harmful) AS tp, count(*) FILTER (harmful AND NOT manual_harmful) AS fp, count(*) FILTER (NOT harmful AND manual_harmful) AS fn, count(*) FILTER (NOT harmful AND NOT manual_harmful) AS tn, count(*) FILTER (abstained) AS abstained, count(*) AS rows FROM labelled WHERE manual IS NOT NULL) SELECT *, round({_RATE.format('tp', 'tp + fp')}, 6) AS precision, round({_RATE.format('tp', 'tp + fn')}, 6) AS recall, round({_RATE.format('(tp + tn)', 'rows')}, 6) AS accuracy, round({_RATE.format('abstained', 'rows')}, 6) AS abstain_rate FROM g",
    "threshold_sweep": f"WITH {_LAB}, t AS (SELECT unnest(range(96)) / 100 AS threshold), j AS (SELECT threshold, NOT abstained AND confidence >= threshold AS judged, harmful AS h, manual_harmful AS m FROM labelled, t WHERE manual IS NOT NULL), g AS (SELECT threshold, count(*) FILTER (judged AND h AND m) AS tp, count(*) FILTER (judged AND h AND NOT m) AS fp, count(*) FILTER (m AND NOT (judged AND h)) AS fn, count(*) FILTER (judged) AS judged, count(*) AS rows FROM j GROUP BY 1), r AS (SELECT *, {_RATE.format('tp', 'tp + fp')} AS p, {_RATE.format('tp', 'tp + fn')} AS q FROM g) SELECT round(threshold, 2) AS threshold, tp, fp, fn, round({_F1.format('p', 'q')}, 6) AS f1, round({_RATE.format('judged', 'rows')}, 6) AS coverage FROM r",
    "adjudication": f"WITH {_LAB}, j AS (SELECT manual AS a, CASE WHEN k % 2 = 0 THEN predicted END AS b FROM labelled) SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN a IS NULL THEN 'only_b' WHEN b IS NULL THEN 'only_a' WHEN a = b THEN 'agreed' ELSE 'conflict' END AS state, count(*) AS rows FROM j GROUP BY 1",
    "dual_review": f"WITH {_LAB}, o AS (SELECT seq, row_number() OVER (ORDER BY sha256(CAST(seq AS VARCHAR))) - 1 AS i, floor(count(*) OVER () * 0.1 + 0.5) AS nb FROM labelled) SELECT seq, CASE WHEN i < nb THEN 'both' WHEN (i - nb) % 2 = 0 THEN 'a' ELSE 'b' END AS reviewer FROM o",
    "run_outcomes": f"WITH {TRACE_SQL} SELECT session_id, round(CAST(sum(latency_ms) AS DOUBLE), 6) AS latency_ms, round(CAST(sum(tok_in * 1.0 + tok_cached * 0.2 + tok_out * 1.0) AS DOUBLE), 6) AS proxy, count(*) FILTER (type = 'tool_result' AND outcome = 'failure') AS retries, coalesce(arg_max(outcome = 'success', (ts_ms, seq)) FILTER (outcome IS NOT NULL), true) AS success FROM traced GROUP BY session_id",
    "session_summaries": f"WITH {TRACE_SQL}, g AS (SELECT session_id, min(ts_ms) AS started_ms, max(ts_ms) - min(ts_ms) AS duration_ms, count(*) AS events, count(*) FILTER (type = 'tool_result') AS tool_results, round(CAST(sum(latency_ms) AS DOUBLE), 6) AS latency_ms FROM traced GROUP BY 1) SELECT * FROM g WHERE tool_results >= 2 AND (duration_ms >= 60000 OR latency_ms >= 100)",
    "model_keys": f"WITH {TRACE_SQL}, m AS (SELECT session_id, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN model ELSE 'model-x' END AS m FROM traced), g AS (SELECT session_id, count(DISTINCT m) AS n, string_agg(DISTINCT m, '|' ORDER BY m) AS ks FROM m GROUP BY 1) SELECT session_id, CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN ks ELSE 'mixed:' || ks END AS model_key FROM g",
    "variant_pairs": f"WITH {_VP} SELECT * FROM vp",
    "paired_totals": f"""WITH {_VP}, g AS (SELECT count(*) AS pairs, {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("off_failures", "on_failures", "off_harmful", "on_harmful"))} FROM vp),
h AS (SELECT *, round(CASE WHEN off_failures > 0 THEN off_harmful / off_failures ELSE 0 END, 6) AS off_rate, round(CASE WHEN on_failures > 0 THEN on_harmful / on_failures ELSE 0 END, 6) AS on_rate, round({_RED.format("off_failures", "on_failures")}, 6) AS failure_reduction FROM g),
rr AS (SELECT *, round({_RED.format("off_rate", "on_rate")}, 6) AS rate_reduction FROM h) SELECT *, concat_ws(',', CASE WHEN NOT pairs >= 3 THEN 'pairs' END, CASE WHEN NOT failure_reduction >= 0.1 THEN 'reduction' END) AS failures FROM rr""",
    "pairing_counters": f"""WITH {TRACE_SQL}, d AS (SELECT DISTINCT session_id, string_split(lower(trim(session_id)), '::') AS p FROM traced),
s AS (SELECT CASE WHEN len(p) IN (3, 4) THEN nullif(trim(p[2]), '') END AS instance, CASE WHEN len(p) IN (3, 4) THEN nullif(trim(p[3]), '') END AS side, coalesce(CASE WHEN len(p) = 4 THEN nullif(trim(p[4]), '') END, 'r1') AS replicate FROM d),
r AS (SELECT instance IS NOT NULL AS known, instance, replicate, count(*) FILTER (side = 'off') AS o, count(*) FILTER (side = 'on') AS w, count(*) AS n FROM s GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS sessions, CAST(coalesce(sum(n) FILTER (NOT known), 0) AS BIGINT) AS without_identity, CAST(coalesce(sum(o) FILTER (known), 0) AS BIGINT) AS off_sessions, CAST(coalesce(sum(w) FILTER (known), 0) AS BIGINT) AS on_sessions, CAST(coalesce(sum(n - o - w) FILTER (known), 0) AS BIGINT) AS other_sessions,
  count(*) FILTER (known) AS runs, count(*) FILTER (known AND least(o, w) > 0) AS runs_with_both, CAST(coalesce(sum(least(o, w)) FILTER (known), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(o + w - 2 * least(o, w)) FILTER (known), 0) AS BIGINT) AS unpaired FROM r""",
    "variant_medians": f"WITH {TRACE_SQL}, s AS (SELECT session_id, model, variant, CAST(count(*) AS DOUBLE) AS events, CAST(sum(latency_ms) AS DOUBLE) AS latency FROM traced GROUP BY 1, 2, 3) SELECT model, variant, count(*) AS sessions, round(quantile_cont(events, 0.5), 6) AS events_median, round(quantile_cont(latency, 0.5), 6) AS latency_median FROM s GROUP BY 1, 2",
    "run_quality": f"WITH {TRACE_SQL}, s AS (SELECT session_id, variant, count(*) AS events, count(*) FILTER (type = 'checkpoint') AS checkpoints, count(*) FILTER (type = 'tool_result') AS tool_results FROM traced GROUP BY 1, 2), c AS (SELECT *, events <= 1 OR checkpoints < 1 OR tool_results < 1 AS censored FROM s) SELECT variant, count(*) AS sessions, count(*) FILTER (censored) AS censored, count(*) FILTER (checkpoints > 0) AS with_checkpoint, round(count(*) FILTER (censored) / count(*), 6) AS censor_rate FROM c GROUP BY 1",
    "feasibility": f"WITH {TRACE_SQL}, s AS (SELECT session_id, count(*) AS retries, min(k % 5) AS rank FROM traced WHERE is_failure GROUP BY 1), a AS (SELECT *, CASE rank WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.35 ELSE 0.0 END AS assist FROM s), b AS (SELECT *, CASE WHEN assist > 0 THEN greatest(1, CAST(ceil(retries * assist) AS BIGINT)) ELSE 0 END AS removed FROM a), g AS (SELECT count(*) AS scenarios, round(count(*) FILTER (rank = 1) / count(*), 6) AS hit1, round(count(*) FILTER (rank BETWEEN 1 AND 3) / count(*), 6) AS hit3, round(avg(CASE WHEN rank BETWEEN 1 AND 3 THEN 1.0 / CAST(rank AS DOUBLE) ELSE 0.0 END), 6) AS mrr, CAST(sum(retries) AS BIGINT) AS off_retries, CAST(sum(retries) - sum(removed) AS BIGINT) AS on_retries FROM b) SELECT *, concat_ws(',', CASE WHEN NOT hit1 >= 0.1 THEN 'hit1' END, CASE WHEN NOT hit3 >= 0.9 THEN 'hit3' END, CASE WHEN NOT mrr >= 0.3 THEN 'mrr' END, CASE WHEN NOT {_RED.format('off_retries', 'on_retries')} >= 0.25 THEN 'retries' END) AS failures FROM g",
    "canary_decision": f"WITH {TRACE_SQL}, w AS (SELECT model, count(*) AS samples, count(*) FILTER (is_success) AS successes FROM traced WHERE outcome IS NOT NULL GROUP BY 1) SELECT model, samples, successes, CASE WHEN samples < 50 THEN 'hold' WHEN 1 - successes / samples >= 0.55 THEN 'rollback' WHEN successes / samples >= 0.5 THEN 'promote' ELSE 'hold' END AS decision FROM w",
    "dominant_issues": f"WITH {_LAB}, g AS (SELECT session_id, predicted AS kind, count(*) AS n, max(confidence) AS top, arg_max(seq, (confidence, seq)) AS event_seq FROM labelled GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, top DESC, kind) AS rn FROM g) SELECT session_id, kind, n, event_seq FROM r WHERE rn = 1",
}

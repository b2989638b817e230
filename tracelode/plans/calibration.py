"""Calibration reports over labelled failures: summary, tuning, examples, adjudication by policy, packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.metrics import f1, safe_rate
from tracelode.operators import review
from tracelode.plans import evaluation as E

POLICIES = ("unresolved", "reviewer_a", "reviewer_b", "predicted")


def calibration_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, F1 averaged over the classes that occur and weighted by their support, and how complete the labels are."""
    c = E.calibration_classes(spark, sf)
    active = (F.col("support") > 0) | (F.col("predicted_n") > 0)
    hits = F.round(F.col("recall") * F.col("support"))
    m = c.agg(F.round(safe_rate(F.sum(F.when(active, F.col("f1"))), F.count_if(active)), 5).alias("macro_f1"), F.round(safe_rate(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 5).alias("weighted_f1"), F.round(safe_rate(F.sum(hits), F.sum("support")), 6).alias("accuracy"))
    rows = E._labelled(spark, sf)
    full = F.col("manual").isNotNull()
    n = rows.agg(F.count("*").alias("rows"), F.count_if(full).alias("full"), F.count_if(~full).alias("unlabeled"))
    return m.join(n)  # one row each


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted kinds over all rows, manual ones over labelled rows only."""
    rows = E._labelled(spark, sf)
    pairs = rows.select(F.explode(F.array(F.struct(F.col("predicted").alias("kind"), F.lit(1).alias("p"), F.lit(0).alias("m")), F.struct(F.col("manual").alias("kind"), F.lit(0).alias("p"), F.lit(1).alias("m")))).alias("x")).select("x.*").filter("kind is not null")
    return pairs.groupBy("kind").agg(F.sum("p").alias("predicted_n"), F.sum("m").alias("manual_n"))


def threshold_choice(spark: SparkSession, sf: str, coverage: float = 0.3, most: int = 5) -> DataFrame:
    """The best thresholds: those of enough coverage first, by F1, then by coverage, then the lowest."""
    s = E.threshold_sweep(spark, sf).withColumn("eligible", F.col("coverage") >= coverage)
    return s.orderBy(F.desc("eligible"), F.desc("f1"), F.desc("coverage"), "threshold").limit(most).select("threshold", "eligible", "f1", "coverage")


def calibration_examples(spark: SparkSession, sf: str, most: int = 5) -> DataFrame:
    """Example rows by confidence: disagreements, missed and falsely claimed harm, and harmful rows that were abstained from."""
    r = E._labelled(spark, sf).filter("manual is not null")
    h, m = F.col("harmful"), F.col("manual_harmful")
    lists = {"disagreement": F.col("predicted") != F.col("manual"), "false_negative": ~h & m, "false_positive": h & ~m, "abstained_harmful": F.col("abstained") & m}
    rows = r.select("seq", "confidence", "predicted", "manual", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lists.items()]))).alias("list")).withColumn("slice", F.pmod(F.xxhash64("seq"), F.lit(64)))
    best = lambda df, *more: df.groupBy("list", *more).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "seq", "predicted", "manual"))), 1, most).alias("b"))
    local = best(rows, "slice").select("list", F.inline("b")).withColumn("confidence", -F.col("c")).drop("c")
    return best(local).select("list", F.posexplode("b").alias("rank", "x")).select("list", (F.col("rank") + 1).alias("rank"), "x.seq", "x.predicted", "x.manual", F.round(-F.col("x.c"), 3).alias("confidence"))


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with two reviewers: a gives the manual label, b the predicted one of even rows; harm is theirs by kind."""
    r = E._labelled(spark, sf)
    return r.select("seq", "predicted", F.col("manual").alias("a"), F.when(F.col("k") % 2 == 0, F.col("predicted")).alias("b"))


def adjudication_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven counters of the reviews."""
    a, b, p = F.col("a"), F.col("b"), F.col("predicted")
    harm = lambda c: c.isin(*E.issues.HARMFUL)
    both = a.isNotNull() & b.isNotNull()
    return _reviewed(spark, sf).agg(
        F.count("*").alias("rows"), F.count_if(a.isNotNull()).alias("by_a"), F.count_if(b.isNotNull()).alias("by_b"), F.count_if(both).alias("by_both"), F.count_if(a.isNull() & b.isNull()).alias("by_none"), F.count_if(a.isNotNull() & b.isNull()).alias("only_a"), F.count_if(a.isNull() & b.isNotNull()).alias("only_b"),
        F.count_if(both & (a == b)).alias("agreed"), F.count_if(both & (a != b)).alias("kind_conflicts"), F.count_if(both & (harm(a) != harm(b))).alias("harm_conflicts"), F.count_if(both & (a == b) & (a == p)).alias("confirmed"),
    )


def adjudication_policies(spark: SparkSession, sf: str) -> DataFrame:
    """What each conflict policy makes of the reviews: rows by policy and final label."""
    r = _reviewed(spark, sf)
    labels = [F.struct(F.lit(p).alias("policy"), review.adjudicated(p, F.col("a"), F.col("b"), F.col("predicted")).alias("label")) for p in POLICIES]
    return r.select(F.inline(F.array(*labels))).groupBy("policy", F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (calibration_summary, label_counts, threshold_choice, calibration_examples, adjudication_stats, adjudication_policies)}

_LAB = E._LAB
_REV = f"{_LAB}, rev AS (SELECT seq, predicted, manual AS a, CASE WHEN k % 2 = 0 THEN predicted END AS b FROM labelled)"
_H = "IN ('command_mismatch', 'missing_context', 'environment_mismatch')"
_CLASS_SQL = E.SQL["calibration_classes"]
_TESTS = {"disagreement": "predicted <> manual", "false_negative": f"NOT predicted {_H} AND manual {_H}", "false_positive": f"predicted {_H} AND NOT manual {_H}", "abstained_harmful": f"predicted = 'unknown_failure' AND manual {_H}"}
SQL = {
    "calibration_summary": f"""WITH cls AS ({_CLASS_SQL}), m AS (SELECT round(avg(f1) FILTER (support > 0 OR predicted_n > 0), 5) AS macro_f1, round(sum(f1 * support) / sum(support), 5) AS weighted_f1, round(sum(round(recall * support)) / sum(support), 6) AS accuracy FROM cls),
n AS (WITH {_LAB} SELECT count(*) AS rows, count(manual) AS "full", count(*) FILTER (manual IS NULL) AS unlabeled FROM labelled) SELECT * FROM m, n""",
    "label_counts": f"WITH {_LAB}, u AS (SELECT predicted AS kind, 1 AS p, 0 AS m FROM labelled UNION ALL SELECT manual, 0, 1 FROM labelled WHERE manual IS NOT NULL) SELECT kind, CAST(sum(p) AS BIGINT) AS predicted_n, CAST(sum(m) AS BIGINT) AS manual_n FROM u GROUP BY kind",
    "threshold_choice": f"WITH s AS ({E.SQL['threshold_sweep']}) SELECT threshold, coverage >= 0.3 AS eligible, f1, coverage FROM s ORDER BY coverage >= 0.3 DESC, f1 DESC, coverage DESC, threshold LIMIT 5",
    "calibration_examples": f"WITH {_LAB}, x AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS list, * FROM labelled WHERE manual IS NOT NULL AND {t}' for n, t in _TESTS.items())}) SELECT list, CAST(row_number() OVER w AS INTEGER) AS rank, seq, predicted, manual, round(confidence, 3) AS confidence FROM x WINDOW w AS (PARTITION BY list ORDER BY confidence DESC, seq, predicted, manual) QUALIFY row_number() OVER w <= 5",
    "adjudication_stats": f"WITH {_REV} SELECT count(*) AS rows, count(a) AS by_a, count(b) AS by_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS by_both, count(*) FILTER (a IS NULL AND b IS NULL) AS by_none, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_a, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_b, count(*) FILTER (a = b) AS agreed, count(*) FILTER (a <> b) AS kind_conflicts, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (a {_H}) <> (b {_H})) AS harm_conflicts, count(*) FILTER (a = b AND a = predicted) AS confirmed FROM rev",
    "adjudication_policies": f"WITH {_REV}, p AS (SELECT unnest({list(POLICIES)}) AS policy), l AS (SELECT policy, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a ELSE CASE policy WHEN 'reviewer_a' THEN a WHEN 'reviewer_b' THEN b WHEN 'predicted' THEN predicted END END AS label FROM rev, p) SELECT policy, coalesce(label, '') AS label, count(*) AS rows FROM l GROUP BY ALL",
}

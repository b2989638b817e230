"""Aggregates, gates, strata and ranked lists over paired episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.metrics import checks, relative_reduction, safe_rate
from tracelode.operators import issues
from tracelode.plans.adapter import observed
from tracelode.plans.episode_queries import OBSERVED_SQL, PAIR_SQL, pairs

#: Thresholds of the observed and of the trajectory gate (fixed values).
OBSERVED = {"pairs": 3, "dead_end": 0.25, "wall": 0.1, "tokens": 0.1, "proxy": 0.1, "recovery": 0.9, "drop": 0.0}
TRAJECTORY = {"pairs": 3, "harmful": 0.2, "wall": 0.1, "tokens": 0.1, "recovery": 0.9, "drop": 0.0, "coverage": 0.6}
_COUNTS = ("retries", "harmful", "benign", "abstained")
_AMOUNTS = ("wall_ms", "tokens", "proxy", "usd")
_REDUCED = {"dead_end": "retries", "harmful": "harmful", "wall": "wall_ms", "tokens": "tokens", "proxy": "proxy"}


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    both = F.concat(F.lit("mixed:"), F.array_join(F.array_sort(F.array("off_model", "on_model")), "|"))
    model = F.when(F.col("off_model") == F.col("on_model"), F.col("on_model")).otherwise(both)
    return pairs(spark, sf).filter("kept").withColumn("surface", issues.tool_surface(F.lower("family"))).withColumn("pair_model", model)


def _totals(grouped, idle_coverage: float = 1.0) -> DataFrame:
    """Totals, rates, coverage and reductions of groups of pairs; `idle_coverage` holds where nothing was retried."""
    sums = [F.coalesce(F.sum(f"{s}_{c}"), F.lit(0)).alias(f"{s}_{c}") for s in ("off", "on") for c in (*_COUNTS, *_AMOUNTS)]
    t = grouped.agg(F.count("*").alias("pairs"), *sums, *[F.count_if(f"{s}_success").alias(f"{s}_recovered") for s in ("off", "on")])
    c = F.col
    cover = lambda s: F.when(c(f"{s}_retries") > 0, F.greatest(F.lit(0), c(f"{s}_retries") - c(f"{s}_abstained")) / c(f"{s}_retries")).otherwise(F.lit(idle_coverage))
    rates = {f"{s}_{n}": F.round(safe_rate(c(f"{s}_{x}"), c("pairs")), 6) for s in ("off", "on") for x, n in (("recovered", "recovery"), ("harmful", "harmful_rate"))}
    reductions = {f"{k}_reduction": F.round(relative_reduction(c(f"off_{v}"), c(f"on_{v}")), 6) for k, v in _REDUCED.items()}
    full = t.withColumns(rates | {f"{s}_coverage": F.round(cover(s), 6) for s in ("off", "on")} | reductions)
    return full.withColumns({f"{s}_{a}": F.round(c(f"{s}_{a}").cast("double"), 4) for s in ("off", "on") for a in _AMOUNTS})


def _observed_checks(t: dict[str, float] = OBSERVED) -> Column:
    c = F.col
    return checks(("pairs", c("pairs") >= t["pairs"]), *[(k, c(f"{k}_reduction") >= t[k]) for k in ("dead_end", "wall", "tokens", "proxy")], ("recovery", c("on_recovery") >= t["recovery"]), ("drop", c("off_recovery") - c("on_recovery") <= t["drop"]))


def _trajectory_checks(t: dict[str, float] = TRAJECTORY) -> Column:
    c = F.col
    return checks(
        ("pairs", c("pairs") >= t["pairs"]), *[(k, c(f"{k}_reduction") >= t[k]) for k in ("harmful", "wall", "tokens")],
        ("recovery", c("on_recovery") >= t["recovery"]), ("drop", c("off_recovery") - c("on_recovery") <= t["drop"]), ("off_coverage", c("off_coverage") >= t["coverage"]), ("on_coverage", c("on_coverage") >= t["coverage"]),
    )


def gate_observed(spark: SparkSession, sf: str) -> DataFrame:
    """The observed gate with its seven thresholds."""
    a = _totals(_kept(spark, sf).groupBy())
    return a.select("pairs", "dead_end_reduction", "wall_reduction", "tokens_reduction", "proxy_reduction", "off_recovery", "on_recovery", _observed_checks().alias("failures")).withColumn("passed", F.col("failures") == "")


def trajectory_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(_kept(spark, sf).groupBy())


def trajectory_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The trajectory gate with its eight checks."""
    a = _totals(_kept(spark, sf).groupBy())
    return a.select("pairs", "harmful_reduction", "wall_reduction", "tokens_reduction", "off_recovery", "on_recovery", "off_coverage", "on_coverage", _trajectory_checks().alias("failures")).withColumn("passed", F.col("failures") == "")


def _strata(spark: SparkSession, sf: str, idle: float) -> DataFrame:
    sets = _kept(spark, sf).groupingSets([["pair_model"], ["surface"], ["pair_model", "surface"]], "pair_model", "surface")
    return _totals(sets, idle).withColumn("stratum", F.concat_ws("__", "pair_model", "surface"))


def stratum_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The observed gate for every stratum by model, by tool surface, and by both."""
    return _strata(spark, sf, 1.0).select("stratum", "pairs", "dead_end_reduction", _observed_checks().alias("failures"))


def trajectory_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectory columns by stratum; coverage is 0 where a stratum has no retries."""
    return _strata(spark, sf, 0.0).select("stratum", "pairs", "off_harmful", "on_harmful", "harmful_reduction", "off_coverage", "on_coverage", _trajectory_checks().alias("failures"))


def pair_power(spark: SparkSession, sf: str, least: int = 2, preferred: int = 4) -> DataFrame:
    """Strata by their power (ready, usable, thin) with the ten best of each by pairs, then by name."""
    s = _strata(spark, sf, 1.0).select("stratum", "pairs", F.when(F.col("pairs") >= preferred, "ready").when(F.col("pairs") >= least, "usable").otherwise("thin").alias("power"))
    top = s.groupBy("power").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("pairs")).alias("p"), "stratum"))), 1, 10).alias("best"))  # strata, not pairs
    return top.select("power", F.posexplode("best").alias("rank", "x")).select("power", (F.col("rank") + 1).alias("rank"), "x.stratum", (-F.col("x.p")).alias("pairs"))


def top_stratum(spark: SparkSession, sf: str) -> DataFrame:
    """The first stratum of each grouping: most pairs, then by name."""
    s = _strata(spark, sf, 1.0).withColumn("grouping", F.when(F.col("surface").isNull(), "model").when(F.col("pair_model").isNull(), "surface").otherwise("both"))
    return s.groupBy("grouping").agg(F.min(F.struct((-F.col("pairs")).alias("p"), "stratum")).alias("x")).select("grouping", "x.stratum", (-F.col("x.p")).alias("pairs"))


def lane_gate(spark: SparkSession, sf: str, floor: int = 20, cap: float = 0.2) -> DataFrame:
    """The lane passes if the trajectory gate does, few families are on both sides, and enough pairs are family-disjoint; with the exit code."""
    gate = trajectory_gate(spark, sf).select(F.col("passed").alias("primary"))
    e = observed(spark, sf).groupBy("family").agg(F.max((F.col("split") == "train").cast("int")).alias("t"), F.max((F.col("split") != "train").cast("int")).alias("h"))
    rate = e.agg(F.count_if(F.col("h") == 1).alias("held_families"), F.count_if((F.col("h") == 1) & (F.col("t") == 1)).alias("shared_families")).withColumn("overlap_rate", F.round(safe_rate(F.col("shared_families"), F.col("held_families")), 6))
    disjoint = _kept(spark, sf).join(e.filter("t = 0").select("family"), "family", "left_semi").agg(F.count("*").alias("disjoint_pairs"))
    one = gate.join(rate).join(disjoint)  # one row each
    failures = checks(("gate", F.col("primary")), ("overlap", F.col("overlap_rate") <= cap), ("disjoint", F.col("disjoint_pairs") >= floor))
    return one.withColumn("failures", failures).withColumn("exit_code", F.when(F.col("overlap_rate") > cap, 3).when(F.col("failures") != "", 2).otherwise(0))


_LISTS = {"harmful": "harmful", "retries": "retries", "wall": "wall_ms", "tokens": "tokens", "cost": "usd", "abstained": "abstained"}


def family_lists(spark: SparkSession, sf: str, most: int = 10) -> DataFrame:
    """Six ranked lists of families, the first ten of each: the best of each of 256 slices first, then of those."""
    e = observed(spark, sf).groupBy(F.substring(F.sha2("family", 256), 1, 16).alias("family_id")).agg(*[F.round(F.sum(c).cast("double"), 4).alias(n) for n, c in _LISTS.items()])
    rows = e.select("family_id", F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("value")) for n in _LISTS])).alias("x")).select("family_id", "x.*")
    best = lambda df, *by: df.groupBy("list", *by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "family_id"))), 1, most).alias("b"))
    local = best(rows.withColumn("part", F.pmod(F.xxhash64("family_id"), F.lit(256))), "part").select("list", F.explode("b").alias("x")).select("list", (-F.col("x.v")).alias("value"), "x.family_id")
    return best(local).select("list", F.posexplode("b").alias("rank", "x")).select("list", (F.col("rank") + 1).alias("rank"), "x.family_id", (-F.col("x.v")).alias("value"))


def pair_debug(spark: SparkSession, sf: str) -> DataFrame:
    """Per pair: deltas, the pair's model key, and hashed ids in the place of sessions and families."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    delta = lambda c: F.col(f"on_{c}") - F.col(f"off_{c}")
    return _kept(spark, sf).select("on_start_seq", short("family").alias("family_id"), short("on_session_id").alias("session_hash"), "pair_model", delta("retries").alias("retry_delta"), delta("harmful").alias("harmful_delta"), delta("wall_ms").cast("double").alias("wall_delta"), delta("tokens").cast("double").alias("token_delta"))


def files_per_model(spark: SparkSession, sf: str, least: int = 5, most: int = 8) -> DataFrame:
    """Models with enough sessions, most sessions first; the first few are the report."""
    g = observed(spark, sf).groupBy("model").agg(F.count_distinct("session_id").alias("sessions")).filter(F.col("sessions") >= least)
    return g.orderBy(F.desc("sessions"), "model").limit(most)


QUERIES = {f.__name__: f for f in (gate_observed, trajectory_aggregate, trajectory_gate, stratum_gates, trajectory_strata, pair_power, top_stratum, lane_gate, family_lists, pair_debug, files_per_model)}


# ---- the same in SQL ---------------------------------------------------------------------------------------------------

_SURFACE = "CASE split_part(lower(family), ' ', 1) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in issues.SURFACES) + " ELSE 'other' END"
_KEPT = f"{PAIR_SQL}, k AS (SELECT *, {_SURFACE} AS surface, CASE WHEN off_model = on_model THEN on_model ELSE 'mixed:' || least(off_model, on_model) || '|' || greatest(off_model, on_model) END AS pair_model FROM pairs WHERE kept)"


def _red(c: str) -> str:
    return f"round(CASE WHEN off_{c} <= 0 THEN CASE WHEN on_{c} <= 0 THEN 0.0 ELSE -1.0 END ELSE CAST(off_{c} - on_{c} AS DOUBLE) / CAST(off_{c} AS DOUBLE) END, 6)"


def _tot(keys: str, by: str, idle: float = 1.0) -> str:
    sides = ("off", "on")
    sums = ", ".join([f"CAST(coalesce(sum({s}_{c}), 0) AS BIGINT) AS {s}_{c}" for s in sides for c in _COUNTS] + [f"coalesce(sum({s}_{c}), 0) AS {s}_{c}" for s in sides for c in _AMOUNTS])
    rec = ", ".join(f"count(*) FILTER ({s}_success) AS {s}_recovered" for s in sides)
    rate = ", ".join(f"round(CASE WHEN pairs > 0 THEN {s}_{c} / pairs ELSE 0.0 END, 6) AS {s}_{n}" for s in sides for c, n in (("recovered", "recovery"), ("harmful", "harmful_rate")))
    cov = ", ".join(f"round(CASE WHEN {s}_retries > 0 THEN greatest(0, {s}_retries - {s}_abstained) / {s}_retries ELSE {idle} END, 6) AS {s}_coverage" for s in sides)
    red = ", ".join(f"{_red(v)} AS {k}_reduction" for k, v in _REDUCED.items())
    amounts = ", ".join(f"round(CAST({s}_{a} AS DOUBLE), 4) AS {s}_{a}" for s in sides for a in _AMOUNTS)
    left_out = ", ".join(f"{s}_{x}" for s in sides for x in _AMOUNTS)
    return f"{_KEPT}, t AS (SELECT {keys}count(*) AS pairs, {sums}, {rec} FROM k {by}), a AS (SELECT * EXCLUDE ({left_out}), {rate}, {cov}, {red}, {amounts} FROM t)"


def _fails(*tests: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({t}, false) THEN '{n}' END" for n, t in tests) + ")"


_OBS = _fails(("pairs", "pairs >= 3"), ("dead_end", "dead_end_reduction >= 0.25"), ("wall", "wall_reduction >= 0.1"), ("tokens", "tokens_reduction >= 0.1"), ("proxy", "proxy_reduction >= 0.1"), ("recovery", "on_recovery >= 0.9"), ("drop", "off_recovery - on_recovery <= 0"))
_TRA = _fails(("pairs", "pairs >= 3"), ("harmful", "harmful_reduction >= 0.2"), ("wall", "wall_reduction >= 0.1"), ("tokens", "tokens_reduction >= 0.1"), ("recovery", "on_recovery >= 0.9"), ("drop", "off_recovery - on_recovery <= 0"), ("off_coverage", "off_coverage >= 0.6"), ("on_coverage", "on_coverage >= 0.6"))
_SETS = "GROUP BY GROUPING SETS ((pair_model), (surface), (pair_model, surface))"
_NAME = "concat_ws('__', pair_model, surface)"
_UNION = " UNION ALL ".join(f"SELECT '{n}' AS list, family_id, {n} AS value FROM e" for n in _LISTS)
_LANE = _fails(("gate", '"primary"'), ("overlap", "overlap_rate <= 0.2"), ("disjoint", "disjoint_pairs >= 20"))
SQL = {
    "gate_observed": f"WITH {_tot('', '')}, g AS (SELECT pairs, dead_end_reduction, wall_reduction, tokens_reduction, proxy_reduction, off_recovery, on_recovery, {_OBS} AS failures FROM a) SELECT *, failures = '' AS passed FROM g",
    "trajectory_aggregate": f"WITH {_tot('', '')} SELECT * FROM a",
    "trajectory_gate": f"WITH {_tot('', '')}, g AS (SELECT pairs, harmful_reduction, wall_reduction, tokens_reduction, off_recovery, on_recovery, off_coverage, on_coverage, {_TRA} AS failures FROM a) SELECT *, failures = '' AS passed FROM g",
    "stratum_gates": f"WITH {_tot('pair_model, surface, ', _SETS)} SELECT {_NAME} AS stratum, pairs, dead_end_reduction, {_OBS} AS failures FROM a",
    "trajectory_strata": f"WITH {_tot('pair_model, surface, ', _SETS, 0.0)} SELECT {_NAME} AS stratum, pairs, off_harmful, on_harmful, harmful_reduction, off_coverage, on_coverage, {_TRA} AS failures FROM a",
    "pair_power": f"WITH {_KEPT}, s AS (SELECT {_NAME} AS stratum, count(*) AS pairs FROM k {_SETS}), p AS (SELECT *, CASE WHEN pairs >= 4 THEN 'ready' WHEN pairs >= 2 THEN 'usable' ELSE 'thin' END AS power FROM s), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY power ORDER BY pairs DESC, stratum) AS INTEGER) AS rank FROM p) SELECT power, rank, stratum, pairs FROM r WHERE rank <= 10",
    "top_stratum": f"WITH {_KEPT}, s AS (SELECT pair_model, surface, count(*) AS pairs FROM k {_SETS}), g AS (SELECT CASE WHEN surface IS NULL THEN 'model' WHEN pair_model IS NULL THEN 'surface' ELSE 'both' END AS grouping, {_NAME} AS stratum, pairs FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY grouping ORDER BY pairs DESC, stratum) AS n FROM g) SELECT grouping, stratum, pairs FROM r WHERE n = 1",
    "lane_gate": f"""WITH {_tot('', '')}, p AS (SELECT {_TRA} = '' AS "primary" FROM a), f AS (SELECT family, bool_or(split = 'train') AS t, bool_or(split <> 'train') AS h FROM observed GROUP BY family),
r AS (SELECT count(*) FILTER (h) AS held_families, count(*) FILTER (h AND t) AS shared_families FROM f), o AS (SELECT *, round(CASE WHEN held_families > 0 THEN shared_families / held_families ELSE 0.0 END, 6) AS overlap_rate FROM r),
d AS (SELECT count(*) AS disjoint_pairs FROM k WHERE family IN (SELECT family FROM f WHERE NOT t)), j AS (SELECT * FROM p, o, d), x AS (SELECT *, {_LANE} AS failures FROM j)
SELECT *, CASE WHEN overlap_rate > 0.2 THEN 3 WHEN failures <> '' THEN 2 ELSE 0 END AS exit_code FROM x""",
    "family_lists": f"WITH {OBSERVED_SQL}, e AS (SELECT substr(sha256(family), 1, 16) AS family_id, {', '.join(f'round(CAST(sum({c}) AS DOUBLE), 4) AS {n}' for n, c in _LISTS.items())} FROM observed GROUP BY family), u AS ({_UNION}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY list ORDER BY value DESC, family_id) AS INTEGER) AS rank FROM u) SELECT list, rank, family_id, value FROM r WHERE rank <= 10",
    "pair_debug": f"WITH {_KEPT} SELECT on_start_seq, substr(sha256(family), 1, 16) AS family_id, substr(sha256(on_session_id), 1, 16) AS session_hash, pair_model, on_retries - off_retries AS retry_delta, on_harmful - off_harmful AS harmful_delta, CAST(on_wall_ms - off_wall_ms AS DOUBLE) AS wall_delta, CAST(on_tokens - off_tokens AS DOUBLE) AS token_delta FROM k",
    "files_per_model": f"WITH {OBSERVED_SQL} SELECT model, count(DISTINCT session_id) AS sessions FROM observed GROUP BY model HAVING count(DISTINCT session_id) >= 5 ORDER BY sessions DESC, model LIMIT 8",
}

"""Hint policy: what sessions with and without hints of a kind led to, and which hint a context gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("none", "artifact", "failure_warning", "retrieval", "other")
# Prior failures (harmful, not harmful), least confidence and risks by kind, and the weights of the policy (fixed values).
PRIORS = {"none": (6, 6), "artifact": (5, 7), "failure_warning": (5, 8), "retrieval": (6, 6), "other": (6, 6)}
LEAST = {"artifact": 0.45, "failure_warning": 0.2, "retrieval": 0.55, "other": 0.6}
TIMEOUT_RISK = {"artifact": 0.08, "failure_warning": 0.14, "retrieval": 0.28, "other": 0.2}
TOKEN_RISK = {"artifact": 0.04, "failure_warning": 0.06, "retrieval": 0.14, "other": 0.1}
TIMEOUT_WEIGHT, TOKEN_WEIGHT, EXPLORATION, LEAST_REDUCTION, LEAST_UTILITY, OVERRIDE, NEGATIVE_LIFT, LEAST_SESSIONS = 0.65, 0.35, 0.04, 0.01, 0.15, 0.92, -0.03, 2


def by_kind(kind: Column, values: dict[str, float]) -> Column:
    """The value of a kind."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(kind == k, F.lit(float(v))).otherwise(out)
    return out


def suggestion_kind(id: Column, title: Column) -> Column:
    """The kind of a suggestion by its id's beginning or its title."""
    return F.when(id.startswith("artifact-") | (title == "Learned wrong-turn correction"), "artifact").when(title == "Prior failure warning", "failure_warning").when(id.startswith("retrieval-"), "retrieval").otherwise("other")


def smoothed_rate(kind: Column, harmful: Column, failures: Column) -> Column:
    """Harmful failures among all, with the prior counts of the kind."""
    return (by_kind(kind, {k: v[0] for k, v in PRIORS.items()}) + harmful) / (by_kind(kind, {k: sum(v) for k, v in PRIORS.items()}) + failures)


def memory(sessions: DataFrame) -> DataFrame:
    """Statistics of sessions (context, kind, signature, failures, harmful) by kind, by context and kind, and by context and
    signature, in one pass: level `kind`, `context` or `signature`, sessions, failures, harmful."""
    sets = sessions.groupingSets([["kind"], ["context", "kind"], ["context", "kind", "signature"]], "context", "kind", "signature")
    g = sets.agg(F.count("*").alias("sessions"), F.sum("failures").alias("failures"), F.sum("harmful").alias("harmful"), F.grouping_id().alias("g"))
    return g.withColumn("level", F.when(F.col("g") == 0, "signature").when(F.col("g") == 1, "context").otherwise("kind")).drop("g")


def decide(candidates: DataFrame, sessions: DataFrame) -> DataFrame:
    """Candidates (context, id, title, confidence, signature) with kind, rates, bandit score, utility and the reason they are out.

    A context's rate is blended with that of all contexts by how many sessions it has (three quarters at most). The memory is
    joined on its keys; contexts are as many as task instances.
    """
    m = memory(sessions)
    c = candidates.withColumn("kind", suggestion_kind(F.col("id"), F.col("title")))
    stats = lambda level, keys, name: m.filter(F.col("level") == level).select(*keys, F.struct("sessions", "failures", "harmful").alias(name))
    wide = c.join(stats("kind", ["kind"], "all"), "kind", "left").join(stats("context", ["context", "kind"], "own"), ["context", "kind"], "left").join(stats("signature", ["context", "kind", "signature"], "sig"), ["context", "kind", "signature"], "left")
    none = m.filter("kind = 'none'")
    wide = wide.join(none.filter("level = 'context'").select("context", F.struct("sessions", "failures", "harmful").alias("own0")), "context", "left")
    whole = none.filter("level = 'kind'").agg(F.first(F.struct("sessions", "failures", "harmful")).alias("all0")).join(sessions.agg(F.count("*").alias("total")))  # one row
    wide = wide.join(F.broadcast(whole))
    n = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), F.lit(0))
    rate = lambda kind, s: smoothed_rate(kind, n(s, "harmful"), n(s, "failures"))

    def blended(kind: Column, own: str, every: str) -> Column:
        weight = F.least(F.lit(0.75), n(own, "sessions") / 8)
        return F.when(n(own, "sessions") > 0, rate(kind, own) * weight + rate(kind, every) * (1 - weight)).otherwise(rate(kind, every))

    samples = F.when(n("own", "sessions") > 0, n("own", "sessions")).otherwise(n("all", "sessions"))
    base, mine = blended(F.lit("none"), "own0", "all0"), blended(F.col("kind"), "own", "all")
    out = wide.withColumns({"base_rate": base, "kind_rate": mine, "utility": F.col("confidence") - by_kind(F.col("kind"), TIMEOUT_RISK) * TIMEOUT_WEIGHT - by_kind(F.col("kind"), TOKEN_RISK) * TOKEN_WEIGHT})
    out = out.withColumns({"bandit": F.col("base_rate") - F.col("kind_rate") + EXPLORATION * F.sqrt(F.log(F.greatest(F.lit(1), "total") + 1) / (samples + 1)), "suppressed": (n("sig", "sessions") >= LEAST_SESSIONS) & (F.col("base_rate") - rate(F.col("kind"), "sig") < NEGATIVE_LIFT)})
    reason = F.when(F.col("confidence") < by_kind(F.col("kind"), LEAST), "low_confidence").when(F.col("suppressed"), "suppressed").when(~(F.col("bandit") > LEAST_REDUCTION), "harmful")
    return out.select("context", "id", "kind", "confidence", "base_rate", "kind_rate", "bandit", "utility", reason.alias("reason"))


def select_one(decided: DataFrame, artifacts_only: bool = False) -> DataFrame:
    """The hint of each context: retrieval yields to an artifact candidate unless it is very sure; then the best bandit score,
    utility, confidence and id; none if its utility is too low. With the counts of what fell out and why."""
    ok = F.col("reason").isNull() & ((F.col("kind") == "artifact") if artifacts_only else F.lit(True))
    per = decided.groupBy("context").agg(
        F.count("*").alias("available"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("low_confidence", "suppressed", "harmful")],
        F.sort_array(F.collect_list(F.when(ok, F.struct((-F.round("bandit", 9)).alias("b"), (-F.round("utility", 9)).alias("u"), (-F.col("confidence")).alias("c"), "id", "kind")))).alias("left"),
    )  # fmt: skip  a context's candidates are as many as suggestions of one turn
    has = F.exists("left", lambda x: x["kind"] == "artifact")
    yields = lambda x: has & (x["kind"] == "retrieval") & (-x["c"] < OVERRIDE)
    best = F.try_element_at(F.filter("left", lambda x: ~yields(x)), F.lit(1))
    low = F.coalesce(-best["u"] < LEAST_UTILITY, F.lit(False))
    return per.select("context", "available", "low_confidence", "suppressed", "harmful", F.size(F.filter("left", yields)).alias("yielded"), low.alias("low_utility"), F.when(~low, best["id"]).alias("selected"))

"""The hint policy over the trace view: memory of sessions, decisions for candidates, one hint a context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import issues, policy
from tracelode.plans.adapter import traced
from tracelode.plans.text_queries import _HARM, _HINT_SQL, _KIND, error_hints

#: Suggestions of a turn: id, title, confidence (as a retrieval would give them).
CANDIDATES = (
    ("artifact-module", "Learned wrong-turn correction", 0.72), ("artifact-weak", "Learned wrong-turn correction", 0.4), ("warn-file", "Prior failure warning", 0.5),
    ("retrieval-lock", "Related attempt", 0.81), ("retrieval-sure", "Related attempt", 0.95), ("retrieval-low", "Related attempt", 0.5), ("verify-first", "Verify first", 0.65),
)
#: The kind of hint that each rule's hint is.
_KIND_OF = {"h-module": "artifact", "h-lock": "artifact", "h-file": "failure_warning", "h-timeout": "retrieval", "h-option": "retrieval", "h-error": "other"}


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """context, kind, signature, failures, harmful of each session; the kind and signature are those of its last hint."""
    last = error_hints(spark, sf).groupBy("session_id").agg(F.max_by("hint_id", "seq").alias("hint"))
    harmful = issues.classify(F.col("command"), F.col("output"))["harmful"]
    s = traced(spark, sf).groupBy("session_id").agg(F.count_if("is_failure").alias("failures"), F.count_if(F.col("is_failure") & harmful).alias("harmful")).join(last, "session_id", "left")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _KIND_OF.items() for x in kv])[F.col("hint")], F.lit("none"))
    instance = T.session_part(F.col("session_id"), 2)
    return s.select(F.when(instance.isNotNull(), F.concat(F.lit("swebench:"), instance)).otherwise("global").alias("context"), kind.alias("kind"), F.coalesce("hint", F.lit("")).alias("signature"), "failures", "harmful")


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    sessions = _sessions(spark, sf)
    offered = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("title"), F.lit(c).alias("confidence")) for i, t, c in CANDIDATES])
    signature = F.concat(F.lit("h-"), F.split("id", "-")[1])
    return policy.decide(sessions.select("context").distinct().select("context", F.inline(offered)).withColumn("signature", signature), sessions)


def policy_memory(spark: SparkSession, sf: str) -> DataFrame:
    m = policy.memory(_sessions(spark, sf))
    return m.select("level", "context", "kind", "signature", "sessions", "failures", "harmful", F.round(policy.smoothed_rate(F.col("kind"), F.col("harmful"), F.col("failures")), 6).alias("rate"))


def policy_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("context", "id", "kind", *[F.round(c, 6).alias(c) for c in ("base_rate", "kind_rate", "bandit", "utility")], "reason")


def policy_selection(spark: SparkSession, sf: str) -> DataFrame:
    return policy.select_one(_decided(spark, sf))


def policy_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Only artifacts may be selected."""
    return policy.select_one(_decided(spark, sf), artifacts_only=True).select("context", "selected")


QUERIES = {f.__name__: f for f in (policy_memory, policy_decisions, policy_selection, policy_artifacts)}


def _case(column: str, values: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in values.items()) + " END"


def _rate(kind: str, harmful: str, failures: str) -> str:
    return f"(({_case(kind, {k: v[0] for k, v in policy.PRIORS.items()})} + coalesce({harmful}, 0)) / ({_case(kind, {k: sum(v) for k, v in policy.PRIORS.items()})} + coalesce({failures}, 0)))"


_SESS = f"""{_HINT_SQL}, last AS (SELECT session_id, arg_max(hint_id, seq) AS hint FROM hints GROUP BY 1), i AS (SELECT *, {_KIND} AS kind FROM traced),
t AS (SELECT session_id, count(*) FILTER (is_failure) AS failures, count(*) FILTER (is_failure AND {_HARM}) AS harmful FROM i GROUP BY 1),
sess AS (SELECT CASE WHEN len(p) IN (3, 4) AND trim(p[2]) <> '' THEN 'swebench:' || trim(p[2]) ELSE 'global' END AS context, coalesce(CASE hint {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND_OF.items())} END, 'none') AS kind, coalesce(hint, '') AS signature, failures, harmful
  FROM (SELECT *, string_split(lower(trim(session_id)), '::') AS p FROM t) AS u LEFT JOIN last USING (session_id)),
bykind AS (SELECT kind, count(*) AS n, sum(failures) AS f, sum(harmful) AS h FROM sess GROUP BY 1), bycontext AS (SELECT context, kind, count(*) AS n, sum(failures) AS f, sum(harmful) AS h FROM sess GROUP BY 1, 2),
bysig AS (SELECT context, kind, signature, count(*) AS n, sum(failures) AS f, sum(harmful) AS h FROM sess GROUP BY 1, 2, 3)"""
_OFFER = ", ".join(f"('{i}', '{t}', {c})" for i, t, c in CANDIDATES)
_BASE = f"CASE WHEN coalesce(o0.n, 0) > 0 THEN {_rate(chr(39) + 'none' + chr(39), 'o0.h', 'o0.f')} * least(0.75, o0.n / 8) + {_rate(chr(39) + 'none' + chr(39), 'a0.h', 'a0.f')} * (1 - least(0.75, o0.n / 8)) ELSE {_rate(chr(39) + 'none' + chr(39), 'a0.h', 'a0.f')} END"
_MINE = f"CASE WHEN coalesce(o.n, 0) > 0 THEN {_rate('c.kind', 'o.h', 'o.f')} * least(0.75, o.n / 8) + {_rate('c.kind', 'a.h', 'a.f')} * (1 - least(0.75, o.n / 8)) ELSE {_rate('c.kind', 'a.h', 'a.f')} END"
_DEC = f"""{_SESS}, offer(id, title, confidence) AS (VALUES {_OFFER}),
c AS (SELECT context, id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN starts_with(id, 'artifact-') OR title = 'Learned wrong-turn correction' THEN 'artifact' WHEN title = 'Prior failure warning' THEN 'failure_warning' WHEN starts_with(id, 'retrieval-') THEN 'retrieval' ELSE 'other' END AS kind, 'h-' || split_part(id, '-', 2) AS signature
  FROM (SELECT DISTINCT context FROM sess) AS x, offer),
r AS (SELECT c.*, {_BASE} AS base_rate, {_MINE} AS kind_rate, {_rate('c.kind', 's.h', 's.f')} AS sig_rate, coalesce(s.n, 0) AS sig_n, CASE WHEN coalesce(o.n, 0) > 0 THEN o.n ELSE coalesce(a.n, 0) END AS samples, (SELECT count(*) FROM sess) AS total
  FROM c LEFT JOIN bykind a ON a.kind = c.kind LEFT JOIN bycontext o ON o.context = c.context AND o.kind = c.kind LEFT JOIN bysig s ON s.context = c.context AND s.kind = c.kind AND s.signature = c.signature
  LEFT JOIN bycontext o0 ON o0.context = c.context AND o0.kind = 'none' LEFT JOIN bykind a0 ON a0.kind = 'none'),
v AS (SELECT *, base_rate - kind_rate + 0.04 * sqrt(ln(greatest(1, total) + 1) / (samples + 1)) AS bandit, confidence - {_case('kind', policy.TIMEOUT_RISK)} * 0.65 - {_case('kind', policy.TOKEN_RISK)} * 0.35 AS utility, sig_n >= 2 AND base_rate - sig_rate < -0.03 AS suppressed FROM r),
dec AS (SELECT *, CASE WHEN confidence < {_case('kind', policy.LEAST)} THEN 'low_confidence' WHEN suppressed THEN 'suppressed' WHEN NOT bandit > 0.01 THEN 'harmful' END AS reason FROM v)"""


def _pick(test: str) -> str:
    return f"""{_DEC}, g AS (SELECT *, {test} AS ok FROM dec), hasart AS (SELECT context, bool_or(ok AND kind = 'artifact') AS art FROM g GROUP BY 1), y AS (SELECT g.*, ok AND art AND kind = 'retrieval' AND confidence < 0.92 AS yields FROM g JOIN hasart USING (context)),
top AS (SELECT context, id, utility FROM y WHERE ok AND NOT yields QUALIFY row_number() OVER (PARTITION BY context ORDER BY round(bandit, 9) DESC, round(utility, 9) DESC, confidence DESC, id) = 1),
cnt AS (SELECT context, count(*) AS available, count(*) FILTER (reason = 'low_confidence') AS low_confidence, count(*) FILTER (reason = 'suppressed') AS suppressed, count(*) FILTER (reason = 'harmful') AS harmful, CAST(count(*) FILTER (yields) AS INTEGER) AS yielded FROM y GROUP BY 1),
sel AS (SELECT cnt.*, coalesce(round(utility, 9) < 0.15, false) AS low_utility, CASE WHEN round(utility, 9) >= 0.15 THEN id END AS selected FROM cnt LEFT JOIN top USING (context))"""


SQL = {
    "policy_memory": f"WITH {_SESS}, u AS (SELECT 'kind' AS level, NULL AS context, kind, NULL AS signature, n, f, h FROM bykind UNION ALL SELECT 'context', context, kind, NULL, n, f, h FROM bycontext UNION ALL SELECT 'signature', context, kind, signature, n, f, h FROM bysig) SELECT level, context, kind, signature, n AS sessions, CAST(f AS BIGINT) AS failures, CAST(h AS BIGINT) AS harmful, round({_rate('kind', 'h', 'f')}, 6) AS rate FROM u",
    "policy_decisions": f"WITH {_DEC} SELECT context, id, kind, round(base_rate, 6) AS base_rate, round(kind_rate, 6) AS kind_rate, round(bandit, 6) AS bandit, round(utility, 6) AS utility, reason FROM dec",
    "policy_selection": f"WITH {_pick('reason IS NULL')} SELECT context, available, low_confidence, suppressed, harmful, yielded, low_utility, selected FROM sel",
    "policy_artifacts": f"WITH {_pick(chr(40) + 'reason IS NULL AND kind = ' + chr(39) + 'artifact' + chr(39) + chr(41))} SELECT context, selected FROM sel",
}

"""Text, search, mining and issue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import issues, mining, search
from tracelode.operators.ordered import predecessors, running
from tracelode.plans.adapter import TRACE_SQL, traced
from tracelode.session import table

_TERMS = (("q1", "cached prompt tokens gate"), ("q2", "error signature worker retry"), ("q3", "checkpoint writer nightly report"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_TERMS), "query_id string, text string")


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "episodes").select("episode_no", T.command_signature(F.col("familySignature")).alias("signature")).distinct()


def error_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", F.explode(T.error_signatures(F.regexp_replace("text", "[^\\x00-\\x7F]", ""))).alias("signature"))
    return d.groupBy("doc_id").agg(F.count("*").alias("signatures"))


def path_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.explode(T.file_paths(F.col("text"), None)).alias("path")).groupBy("path").agg(F.count("*").alias("documents"))


def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = search.postings(_docs(spark, sf))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(_docs(spark, sf), _questions(spark)).select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    allowed = d.filter(F.col("lang") == "en").select(F.col("doc_id").alias("doc"))
    return search.bm25(d, _questions(spark), filters=allowed).select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over whole texts, fused with BM25 over first lines."""
    d = _docs(spark, sf)
    whole = search.bm25(d, _questions(spark), 20)
    heads = search.bm25(d.withColumn("text", F.split(F.col("text"), "\n")[0]), _questions(spark), 20)
    return search.fuse(whole, heads).select("query_id", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


def document_build(spark: SparkSession, sf: str) -> DataFrame:
    return search.build_documents(traced(spark, sf).filter("type = 'tool_result'"))


def jaccard_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each episode's signature against the one before it in its source."""
    e = table(spark, sf, "episodes").dropDuplicates(["episode_no"])
    both = predecessors(e.select("episode_no", "familySignature", F.coalesce("source", F.lit("")).alias("source")), "source", ["episode_no"], ["familySignature"], "before_")
    return both.filter("before_familySignature is not null and familySignature is not null").select("episode_no", F.round(T.jaccard(F.col("familySignature"), F.col("before_familySignature")), 6).alias("similarity"))


def session_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Task instance, variant and replicate of the session ids that carry them."""
    s = table(spark, sf, "episodes").select("sessionId").distinct()
    return s.select("sessionId", T.session_part(F.col("sessionId"), 2).alias("instance"), T.session_part(F.col("sessionId"), 3).alias("variant"), F.coalesce(T.session_part(F.col("sessionId"), 4), F.lit("r1")).alias("replicate")).filter("instance is not null")


def canary_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Known actors by hash bucket: a quarter goes to the canary."""
    bucket = F.pmod(T.fnv1a32(F.col("actorId")), F.lit(100))
    return table(spark, sf, "roster").select("actorId", bucket.cast("int").alias("bucket"), (bucket < 25).alias("canary"))


def prompt_bounding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.clip_middle(F.col("text"), 400).alias("prompt"))


def mine_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return mining.fixes(mining.fix_arcs(traced(spark, sf)))


def fix_lookahead(spark: SparkSession, sf: str) -> DataFrame:
    return mining.fix_arcs(traced(spark, sf)).select("session_id", "failure_seq", "success_seq")


def issue_kinds(spark: SparkSession, sf: str) -> DataFrame:
    f = traced(spark, sf).filter("is_failure").withColumn("issue", issues.classify(F.col("command"), F.col("output")))
    return f.groupBy(F.col("issue.kind").alias("kind")).agg(F.count("*").alias("failures"), F.count_if("issue.harmful").alias("harmful"), F.count_if("issue.abstained").alias("abstained"), F.round(F.max("issue.confidence"), 6).alias("top_confidence"))


def tool_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "episodes").filter("familySignature is not null").dropDuplicates(["episode_no"])
    return e.groupBy(issues.tool_surface(F.lower(F.trim("familySignature"))).alias("surface")).agg(F.count("*").alias("episodes"), F.count_distinct("source").alias("sources"))


_HINTS = (("h-timeout", "timed out", 0.6, 1), ("h-module", "cannot find module", 0.8, 2), ("h-file", "no such file", 0.7, 3), ("h-error", "error", 0.5, 4), ("h-option", "no such option", 0.8, 5), ("h-lock", "lock", 0.7, 6))


def error_hints(spark: SparkSession, sf: str) -> DataFrame:
    texts = traced(spark, sf).filter("is_failure").select("seq", "session_id", "output")
    rules = [(hint, f"(?i){pattern}", confidence, priority) for hint, pattern, confidence, priority in _HINTS]
    return issues.match_rules(texts, rules, "output").select("seq", "session_id", "hint_id", "confidence")


def hint_first_fire(spark: SparkSession, sf: str) -> DataFrame:
    """Once per session and hint: the first fire, with running counts."""
    h = error_hints(spark, sf)
    first = h.groupBy("session_id", "hint_id").agg(F.min("seq").alias("first"))
    marked = h.join(first, ["session_id", "hint_id"]).withColumn("fires", F.col("seq") == F.col("first"))
    counted = running(marked.select("seq", "session_id", "hint_id", "fires"), "session_id", ["seq"], so_far=F.lit(1), distinct_so_far=F.col("fires"))
    return counted.select("seq", "session_id", "hint_id", "fires", (F.col("so_far") + 1).alias("so_far"), (F.col("distinct_so_far") + F.col("fires").cast("long")).alias("distinct_so_far"))


def hint_policy_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions' failures by last hint, by (variant, hint) and by hint: grouping sets, with bandit scores."""
    t = traced(spark, sf)
    last = error_hints(spark, sf).groupBy("session_id").agg(F.max_by("hint_id", "seq").alias("hint_id"))
    s = t.groupBy("session_id", "variant").agg(F.count_if("is_failure").alias("failures"), F.count_if(F.col("is_failure") & issues.classify(F.col("command"), F.col("output"))["harmful"]).alias("harmful")).join(last, "session_id")
    g = s.groupingSets([["hint_id"], ["variant", "hint_id"]], "variant", "hint_id").agg(F.count("*").alias("sessions"), F.sum("failures").alias("failures"), F.sum("harmful").alias("harmful"))
    return g.withColumn("rate", F.round(issues.harmful_rate(F.col("harmful"), F.col("failures")), 6)).withColumn("score", F.round(issues.bandit(0.25 - F.col("rate"), F.lit(1000), F.col("sessions")), 6))


_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_./:-]+'), lambda x: length(x) > 1)"
_POST = f"{{n}}_d AS (SELECT doc_id AS doc, len({_TOK}) AS length, unnest({_TOK}) AS term FROM {{src}}), {{n}}_p AS (SELECT doc, length, term, count(*) AS tf FROM {{n}}_d GROUP BY ALL), {{n}}_s AS (SELECT count(*) AS n, greatest(avg(len({_TOK})), 1.0) AS avgdl FROM {{src}})"
_QS = ", ".join(f"('{a}', '{b}')" for a, b in _TERMS)
_QT = f"qs(query_id, text) AS (VALUES {_QS}), qe AS (SELECT query_id, unnest({_TOK}) AS term, generate_subscripts({_TOK}, 1) AS pos FROM qs), q AS (SELECT query_id, term, count(*) AS qtf, min(pos) AS first_at FROM qe GROUP BY ALL)"


def _bm25_sql(src: str, name: str, k: int, where: str = "") -> str:
    return f"""{_POST.format(src=src, n=name)},
{name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_sc AS (SELECT query_id, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl)) * qtf) AS score, min(first_at) AS first_at
  FROM {name}_p JOIN q USING (term) JOIN {name}_df USING (term) CROSS JOIN {name}_s {where} GROUP BY query_id, doc),
{name} AS (SELECT * FROM (SELECT query_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_at, doc) AS INTEGER) AS rank FROM {name}_sc) AS r WHERE rank <= {k})"""


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[0-9a-f]{{8,}}', '<hex>', 'g'), '\\b[0-9]+\\b', '<num>', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_JW = "list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda w: length(w) > 2))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\x1b\[[0-9;]*m', '', 'g')), '[0-9a-f]{{8,}}', '<hex>', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


def _says(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


_BOTH, _LINE, _BARE = f"({_CLEAN.format('command')} || chr(10) || {_CLEAN.format('output')})", f"lower({_STRIP.format('command')})", _STRIP.format("output")
_PARTS = f"list_filter(list_transform(string_split_regex({_LINE}, '&&|\\|\\||;'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_PROBE = f"(list_contains({list(issues.PROBES)}, string_split_regex(coalesce({_PARTS}[-1], {_LINE}), '\\s+')[1]) AND NOT {_says(_LINE, issues.NO_PROBE)})"
#: Number of the first rule that holds, then what the rules say.
_RULE = f"""CASE WHEN {_says(_BOTH, issues.TRANSIENT)} OR ({_says("output", issues.TRACEBACK)} AND {_says("command", issues.TRACEBACK_COMMAND)}) THEN 1
 WHEN {_says("command", issues.GATE_COMMAND)} AND {_says("output", issues.GATE_OUTPUT)} THEN 2
 WHEN {_says("command", issues.CHECKS_COMMAND)} AND {_says("output", issues.CHECKS_OUTPUT)} THEN 3
 WHEN {_PROBE} AND ({_BARE} IN ('', '(no output)') OR {_says("output", issues.PROBE_FAILURE)}) THEN 4
 WHEN {_says(_BOTH, issues.COMMAND_MISMATCH)} THEN 5
 WHEN {_says(_BOTH, issues.MISSING_CONTEXT)} OR ({_says("output", issues.AUTH_OUTPUT)} AND {_says("command", issues.AUTH_COMMAND)}) THEN 6
 WHEN {_says(_BOTH, issues.ENVIRONMENT_MISMATCH)} THEN 7 WHEN {_BARE} = '' OR starts_with({_BARE}, '(no output)') THEN 8 ELSE 9 END"""
_KIND = f"['transient_external', 'benign_probe', 'benign_probe', 'benign_probe', 'command_mismatch', 'missing_context', 'environment_mismatch', 'environment_mismatch', 'unknown_failure'][{_RULE}]"
_CONF = f"[0.84, 0.80, 0.78, 0.82, 0.90, 0.78, 0.86, 0.55, 0.35][{_RULE}]"
_ISSUES = f"{TRACE_SQL}, issues AS (SELECT *, {_KIND} AS kind, {_CONF} AS confidence FROM traced WHERE is_failure)"
_HARM = "kind IN ('command_mismatch', 'missing_context', 'environment_mismatch')"
_HINT_SQL = f"{TRACE_SQL}, rules(hint_id, pattern, confidence, priority) AS (VALUES {', '.join(str(h) for h in _HINTS)}), hits AS (SELECT seq, session_id, hint_id, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY seq ORDER BY confidence DESC, priority) AS rn FROM traced JOIN rules ON regexp_matches(output, pattern, 'i') WHERE is_failure), hints AS (SELECT seq, session_id, hint_id, confidence FROM hits WHERE rn = 1)"
_ERR = "(?i)(error|exception|failed|failure|fatal|panic|traceback|not found|denied|cannot|unable to)"
_ERRS = f"list_transform(list_filter(string_split(output, chr(10)), lambda x: regexp_matches(x, '{_ERR}')), lambda x: substr({_NORM.format('x')}, 1, 240))"
_FIRST_ERR = f"{_ERRS}[1]"
_SIG = f"coalesce(nullif(substr({_NORM.format('command')}, 1, 240), ''), {_FIRST_ERR}, substr(output, 1, 120))"
_ARCS = f"""{TRACE_SQL}, calls AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, {_JW.format("command")} AS words, {_SIG} AS sig, substr({_NORM.format("command")}, 1, 240) AS short FROM traced WHERE type = 'tool_result'),
met AS (SELECT f.session_id, f.seq AS failure_seq, f.sig AS failure_sig, s.seq AS success_seq, s.short AS success_sig, trim(f.command) AS a, trim(s.command) AS b, len(list_intersect(f.words, s.words)) AS shared, len(list_distinct(list_concat(f.words, s.words))) AS every
  FROM calls f JOIN calls s ON f.session_id = s.session_id AND s.i BETWEEN f.i + 1 AND f.i + 6 AND NOT s.is_failure WHERE f.is_failure),
arcs AS (SELECT session_id, failure_seq, min(success_seq) AS success_seq, any_value(failure_sig) AS failure_sig, arg_min(success_sig, success_seq) AS success_sig
  FROM met WHERE NOT (a <> '' AND b <> '' AND (a = b OR CASE WHEN every = 0 THEN true ELSE shared >= 0.95 * every END)) GROUP BY session_id, failure_seq)"""

QUERIES = {
    f.__name__: f
    for f in (text_normalize, error_lines, path_counts, term_statistics, bm25_topk, bm25_filtered, rrf_fuse, document_build, jaccard_neighbours, session_identity, canary_assignment, prompt_bounding, mine_fixes, fix_lookahead, issue_kinds, tool_surfaces, error_hints, hint_first_fire, hint_policy_memory)
}

SQL = {
    "text_normalize": f"SELECT DISTINCT episode_no, substr({_NORM.format('\"familySignature\"')}, 1, 240) AS signature FROM episodes",
    "term_statistics": f"WITH {_POST.format(src='documents', n='t')} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM t_p GROUP BY term",
    "path_counts": "SELECT path, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\\.[A-Za-z0-9]+'))) AS path FROM documents) AS p GROUP BY path",
    "bm25_topk": f"WITH {_QT}, {_bm25_sql('documents', 'b', 10)} SELECT query_id, doc AS doc_id, round(score, 6) AS score, rank FROM b",
    "bm25_filtered": f"WITH {_QT}, {_bm25_sql('documents', 'b', 10, 'WHERE doc IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT query_id, doc AS doc_id, round(score, 6) AS score, rank FROM b",
    "rrf_fuse": f"""WITH heads AS (SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents), {_QT}, {_bm25_sql("documents", "b", 20)}, {_bm25_sql("heads", "h", 20)},
u AS (SELECT query_id, doc, 1.25 / (60 + rank) AS s, rank AS r1, NULL AS r2 FROM b UNION ALL SELECT query_id, doc, 1.0 / (60 + rank), NULL, rank FROM h),
f AS (SELECT query_id, doc, sum(s) AS score, min(r1) AS r1, min(r2) AS r2 FROM u GROUP BY query_id, doc)
SELECT * FROM (SELECT query_id, doc AS doc_id, round(CAST(score AS DOUBLE), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, r1 ASC NULLS LAST, r2 ASC NULLS LAST, doc) AS INTEGER) AS rank FROM f) AS r WHERE rank <= 10""",
    "document_build": f"""WITH {TRACE_SQL}, t AS (SELECT id, trim(regexp_replace(type || ' ' || command || ' ' || output, '[ \t\n\r\f]+', ' ', 'g')) AS base, {_ERRS} AS errs, regexp_extract_all(output, '[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\\.[A-Za-z0-9]+') AS paths FROM traced WHERE type = 'tool_result'),
d AS (SELECT *, list_filter(errs, lambda x, i: list_position(errs, x) = i)[1:8] AS e, list_filter(paths, lambda x, i: list_position(paths, x) = i)[1:12] AS p FROM t)
SELECT id || ':base' AS doc_id, id AS event_id, 'base' AS kind, CASE WHEN length(base) > 6000 THEN substr(base, 1, 6000) || chr(10) || '...[truncated]' ELSE base END AS text FROM d
UNION ALL SELECT id || ':err:' || (generate_subscripts(e, 1) - 1), id, 'err', unnest(e) FROM d
UNION ALL SELECT id || ':path:' || (generate_subscripts(p, 1) - 1), id, 'path', unnest(p) FROM d""",
    "jaccard_neighbours": f"""WITH e AS (SELECT DISTINCT episode_no, "familySignature" AS f, source FROM episodes), l AS (SELECT episode_no, f, lag(f) OVER (PARTITION BY coalesce(source, '') ORDER BY episode_no) AS b FROM e),
w AS (SELECT episode_no, {_JW.format("f")} AS x, {_JW.format("b")} AS y FROM l WHERE f IS NOT NULL AND b IS NOT NULL)
SELECT episode_no, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS similarity FROM w""",
    "session_identity": """WITH s AS (SELECT DISTINCT "sessionId", string_split(lower(trim("sessionId")), '::') AS p FROM episodes) SELECT "sessionId", nullif(trim(p[2]), '') AS instance, nullif(trim(p[3]), '') AS variant, coalesce(nullif(trim(p[4]), ''), 'r1') AS replicate FROM s WHERE len(p) IN (3, 4) AND trim(p[2]) <> ''""",
    "canary_assignment": """WITH h AS (SELECT "actorId", list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split("actorId", ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda a, c: ((CAST(xor(CAST(a AS BIGINT), CAST(c AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296)) AS v FROM roster) SELECT "actorId", CAST(v % 100 AS INTEGER) AS bucket, v % 100 < 25 AS canary FROM h""",
    "prompt_bounding": "WITH t AS (SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS x FROM benchmark) SELECT item_id, CASE WHEN length(x) <= 400 THEN x ELSE substr(x, 1, 260) || ' ... ' || right(x, 135) END AS prompt FROM t",
    "mine_fixes": f"WITH {_ARCS}, g AS (SELECT failure_sig, success_sig, count(*) AS support, count(DISTINCT session_id) AS sessions, min(failure_seq) AS first_seq FROM arcs GROUP BY ALL) SELECT *, round(least(0.9, 0.45 + 0.2 * least(1.0, (support - 1) / 4.0) + 0.25 * least(1.0, (sessions - 1) / 2.0)), 6) AS confidence, sessions >= 2 OR support >= 3 AS strong FROM g",
    "fix_lookahead": f"WITH {_ARCS} SELECT session_id, failure_seq, success_seq FROM arcs",
    "issue_kinds": f"WITH {_ISSUES} SELECT kind, count(*) AS failures, count(*) FILTER ({_HARM}) AS harmful, count(*) FILTER (kind = 'unknown_failure') AS abstained, round(CAST(max(confidence) AS DOUBLE), 6) AS top_confidence FROM issues GROUP BY kind",
    "tool_surfaces": """WITH e AS (SELECT DISTINCT episode_no, split_part(lower(trim("familySignature")), ' ', 1) AS w, source FROM episodes WHERE "familySignature" IS NOT NULL) SELECT CASE w """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in issues.SURFACES) + " ELSE 'other' END AS surface, count(*) AS episodes, count(DISTINCT source) AS sources FROM e GROUP BY 1",
    "error_hints": f"WITH {_HINT_SQL} SELECT seq, session_id, hint_id, confidence FROM hints",
    "hint_first_fire": f"WITH {_HINT_SQL}, m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_id, hint_id ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM hints) SELECT seq, session_id, hint_id, fresh = 1 AS fires, count(*) OVER r AS so_far, CAST(sum(fresh) OVER r AS BIGINT) AS distinct_so_far FROM m WINDOW r AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    "hint_policy_memory": f"""WITH {_HINT_SQL}, last AS (SELECT session_id, arg_max(hint_id, seq) AS hint_id FROM hints GROUP BY 1), i AS (SELECT *, {_KIND} AS kind FROM traced),
s AS (SELECT session_id, variant, count(*) FILTER (is_failure) AS failures, count(*) FILTER (is_failure AND {_HARM}) AS harmful FROM i GROUP BY 1, 2), j AS (SELECT * FROM s JOIN last USING (session_id)),
g AS (SELECT variant, hint_id, count(*) AS sessions, CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(harmful) AS BIGINT) AS harmful FROM j GROUP BY GROUPING SETS ((hint_id), (variant, hint_id))),
r AS (SELECT *, round((harmful + 1.0) / (failures + 4.0), 6) AS rate FROM g) SELECT *, round(0.25 - rate + 0.04 * sqrt(ln(1001) / (sessions + 1)), 6) AS score FROM r""",
}

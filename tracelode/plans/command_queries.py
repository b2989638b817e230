"""Commands, payload texts, keyword queries and hints over the trace view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import commands as C
from tracelode.functions import payload as P
from tracelode.functions import text as T
from tracelode.operators import mining
from tracelode.plans.adapter import TRACE_SQL, traced
from tracelode.plans.text_queries import _ARCS
from tracelode.session import table


def command_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Of every tool result: low signal and its confidence scale, machine-bound, mismatch, and the outcome in three states."""
    t = traced(spark, sf).filter("type = 'tool_result'")
    low = C.low_signal(F.col("command"))
    bad, good = F.coalesce(F.col("is_error"), F.lit(False)) | F.coalesce(F.col("outcome") == "failure", F.lit(False)), F.coalesce(~F.col("is_error"), F.lit(False)) | F.coalesce(F.col("outcome") == "success", F.lit(False))
    state = F.when(bad, "failure").when(good, "success").otherwise("unknown")
    return t.select("seq", low.alias("low_signal"), F.when(low, 0.15).otherwise(1.0).alias("scale"), C.machine_bound(F.col("command")).alias("machine_bound"), C.mismatch(F.col("command"), F.col("output")).alias("mismatch"), state.alias("state"))


def payload_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text of an event as the miner (first string, even an empty one, else the payload), the classifier (first filled one)
    and the pairing (text, then output) pick it, with the classifier's clipped in three ways."""
    e = table(spark, sf, "trace_events").filter("type = 'tool_result'").withColumn("doc", F.when(P.valid(F.col("payload")), F.try_parse_json("payload")))
    doc = F.col("doc")
    miner = F.coalesce(*[P.string_at(doc, k) for k in P.OUTCOME_KEYS], F.col("payload"), F.lit(""))
    picked = e.select("ingest_seq", miner.alias("miner"), P.first_text(doc).alias("picked"), P.first_text(doc, ("text", "output")).alias("paired"))
    p = F.col("picked")
    return picked.select("ingest_seq", F.md5("miner").alias("miner"), F.md5("paired").alias("paired"), C.clip(p, 180, "…", within=1).alias("hint_clip"), C.clip(p, 60, "...", within=3).alias("sample_clip"), C.clip(p, 120, "…", trim_end=True).alias("query_clip"), T.redact(C.clip(p, 200, "")).alias("redacted"))


def fix_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Each failure with its fix as a scenario: id, query text and expected phrases; the first of an id wins."""
    t = traced(spark, sf)
    arcs = mining.fix_arcs(t).select("session_id", "failure_seq", "success_seq")
    side = lambda p: t.select(F.col("seq").alias(f"{p}_seq"), F.col("command").alias(f"{p}_command"), F.col("output").alias(f"{p}_output"))
    full = arcs.join(side("failure"), "failure_seq").join(side("success"), "success_seq")
    made = full.select(
        T.slug(F.concat_ws("-", F.lit("scenario"), "session_id", F.col("failure_seq").cast("string"))).alias("scenario_id"), "failure_seq", "success_seq",
        C.query_text(F.col("failure_output"), F.col("failure_command")).alias("query"), C.expected_phrases(F.col("failure_command"), F.col("success_command"), F.col("success_output")).alias("phrases"),
    )
    changed = made.filter(F.size("phrases") > 0)
    return changed.groupBy("scenario_id").agg(F.min(F.struct("failure_seq", "success_seq", "query", "phrases")).alias("x")).select("scenario_id", "x.failure_seq", "x.success_seq", "x.query", F.array_join("x.phrases", " ").alias("phrases"))


def keyword_terms(spark: SparkSession, sf: str) -> DataFrame:
    """In how many task statements each telling word stands."""
    k = table(spark, sf, "benchmark").filter("text is not null").select("item_id", F.explode(C.keywords(F.col("text"))).alias("word"))
    return k.groupBy("word").agg(F.count("*").alias("items"))


def hint_signatures(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "episodes").filter("description is not null").select("episode_no", C.hint_signature(F.col("description")).alias("signature"), T.slug(F.col("description")).alias("slug")).distinct()
    return e


def document_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Files that patches within documents touch, and the status that a document reports, where there is one."""
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", C.patch_paths(F.col("text")).alias("p"), C.final_status(F.col("text")).alias("status"))
    return d.select("doc_id", F.size("p").alias("files"), F.array_join("p", ",").alias("paths"), "status")


def tag_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Tags written as JSON or by commas come back as the list they were."""
    t = table(spark, sf, "trace_events").filter("tags is not null and size(tags) > 0").select("ingest_seq", "tags")
    both = t.select("ingest_seq", "tags", C.string_list(F.to_json("tags")).alias("a"), C.string_list(F.array_join("tags", " ,\n")).alias("b"))
    return both.select("ingest_seq", F.array_join("a", "|").alias("from_json"), F.array_join("b", "|").alias("from_text"))


#: Hints: id, pattern, confidence, action, words whose presence in the documentation makes the hint needless.
HINTS = (
    ("h-lock", "lock", 0.7, "Wait for the other process or remove its lock", ("lock timeout",)), ("h-file", "no such file", 0.8, "List the folder before reading from it", ("working directory",)),
    ("h-remote", "declined|rejected|failed to push", 0.75, "Fetch and rebase before pushing", ("rebase", "protected branch")), ("h-module", "cannot find module|modulenotfound", 0.9, "Install the package first", ()), ("h-memory", "out of memory", 0.6, "Use fewer workers", ("memory",)),
)
DOCUMENTATION = "Branches are protected: rebase before you push. Set the working directory with -C."


def _known(words: tuple[str, ...]) -> bool:
    return any(w.lower() in DOCUMENTATION.lower() for w in words)


def error_time_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The hint of each failure: its text collapsed and clipped to 8,000, hints that the documentation tells are left out, the
    highest confidence wins, the first on a tie; rendered verbose, terse, and by confidence."""
    t = traced(spark, sf).filter("is_failure").select("seq", F.substring(F.trim(F.regexp_replace(F.concat_ws(" ", "command", "output"), r"\s+", " ")), 1, 8000).alias("said"))
    out = None
    for hint, pattern, confidence, action, words in sorted(HINTS, key=lambda h: -h[2]):
        if _known(words):
            continue
        test, hit = F.col("said").rlike(f"(?i){pattern}"), F.struct(F.lit(hint).alias("hint"), F.lit(confidence).alias("confidence"), F.lit(action).alias("action"))
        out = F.when(test, hit) if out is None else out.when(test, hit)
    h = t.select("seq", out.alias("h")).filter("h is not null").select("seq", "h.*")
    percent = F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    verbose, terse = F.concat(F.lit("Hint ("), percent, F.lit("): "), "action", F.lit(".")), C.clip(F.col("action"), 30, "...", within=3)
    return h.select("seq", "hint", verbose.alias("verbose"), terse.alias("terse"), F.when(F.col("confidence") >= 0.75, verbose).otherwise(terse).alias("adaptive"))


def scenario_index(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks by their task id: how many statements, and which; the number of tasks that share a trap (a shared first word)."""
    b = table(spark, sf, "benchmark").filter("text is not null").select("item_id", "task_id", F.explode(F.array_distinct(F.slice(C.keywords(F.col("text")), 1, 6))).alias("trap"))
    g = b.groupBy("trap").agg(F.count_distinct("task_id").alias("tasks"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col("item_id").cast("int"))), 1, 5).cast("array<string>"), ",").alias("first_items"))
    return g.filter("tasks > 1")


QUERIES = {f.__name__: f for f in (command_signals, payload_texts, fix_templates, keyword_terms, hint_signatures, document_patches, tag_lists, error_time_hints, scenario_index)}


# ---- the same in SQL ---------------------------------------------------------------------------------------------------


def _m(text: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}'{f', {chr(39)}{flags}{chr(39)}' if flags else ''})"


_C = r"lower(regexp_replace(command, '^\s+|\s+$', '', 'g'))"
_LOW = f"({_C} <> '' AND ({_m(_C, C.TRIVIAL, '')} OR ({_m(_C, C.BROAD_TEST, '')} AND ({_m(_C, C.SWEEP, '')} OR NOT {_m(_C, C.TARGETED, '')}))))"
_GEN = ", ".join(f"'{w}'" for w in C.GENERIC)


def _kw(text: str) -> str:
    words = f"list_filter(list_transform(string_split_regex({text}, '\\s+'), lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w: length(w) BETWEEN 3 AND 32 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({_GEN}))"
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"


def _first(alias: str) -> str:
    return f"list_filter({alias}, lambda w, i: list_position({alias}, w) = i)"


def _str(key: str) -> str:
    return f"CASE WHEN json_type(doc, '$.{key}') = 'VARCHAR' THEN json_extract_string(doc, '$.{key}') END"


def _fill(key: str) -> str:
    return f"CASE WHEN regexp_matches({_str(key)}, '\\S') THEN {_str(key)} END"


def _hint_sql() -> str:
    left = [h for h in sorted(HINTS, key=lambda h: -h[2]) if not _known(h[4])]
    case = lambda i: "CASE " + " ".join(f"WHEN {_m('said', h[1])} THEN {h[i] if isinstance(h[i], float) else chr(39) + str(h[i]) + chr(39)}" for h in left) + " END"
    return f"""h AS (SELECT seq, {case(0)} AS hint, CAST({case(2)} AS DOUBLE) AS confidence, {case(3)} AS action FROM (SELECT seq, substr(trim(regexp_replace(command || ' ' || output, '\\s+', ' ', 'g')), 1, 8000) AS said FROM traced WHERE is_failure) AS t)"""


_VERBOSE, _TERSE = "'Hint (' || CAST(round(confidence * 100) AS INTEGER) || '%): ' || action || '.'", "CASE WHEN length(action) <= 30 THEN action ELSE substr(action, 1, 27) || '...' END"
_RED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(picked, 1, 200), '(?i)bearer [a-z0-9._-]+', 'bearer <redacted>', 'g'), '(?i)(api[_-]?key|token|secret)=[^ ]+', '\\1=<redacted>', 'g'), '/(home|Users)/[^/ ]+', '~', 'g'), '[0-9a-f]{32,}', '<hash>', 'g')"
_PATHS = r"list_transform(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '^diff --git a/.+? b/.+$')), lambda x: trim(regexp_extract(x, '^diff --git a/(.+?) b/(.+)$', 2)))"
_QUERY = r"trim(regexp_replace(concat_ws(' ', nullif(string_split_regex(fo, '\r?\n')[1], ''), nullif(fc, '')), '\s+', ' ', 'g'))"
SQL = {
    "command_signals": f"WITH {TRACE_SQL} SELECT seq, {_LOW} AS low_signal, CASE WHEN {_LOW} THEN 0.15 ELSE 1.0 END AS scale, {_m('command', C.MACHINE_BOUND)} AS machine_bound, {_m('(command || chr(10) || output)', C.MISMATCH)} AS mismatch, CASE WHEN coalesce(is_error, false) OR coalesce(outcome = 'failure', false) THEN 'failure' WHEN coalesce(NOT is_error, false) OR coalesce(outcome = 'success', false) THEN 'success' ELSE 'unknown' END AS state FROM traced WHERE type = 'tool_result'",
    "payload_texts": f"""WITH d AS (SELECT ingest_seq, payload, CASE WHEN json_valid(payload) THEN payload END AS doc FROM trace_events WHERE type = 'tool_result'),
p AS (SELECT ingest_seq, coalesce({", ".join(_str(k) for k in P.OUTCOME_KEYS)}, payload, '') AS miner, coalesce({", ".join(_fill(k) for k in P.OUTCOME_KEYS)}, '') AS picked, coalesce({_fill("text")}, {_fill("output")}, '') AS paired FROM d)
SELECT ingest_seq, md5(miner) AS miner, md5(paired) AS paired, CASE WHEN length(picked) <= 180 THEN picked ELSE substr(picked, 1, 179) || '…' END AS hint_clip, CASE WHEN length(picked) <= 60 THEN picked ELSE substr(picked, 1, 57) || '...' END AS sample_clip,
  CASE WHEN length(picked) <= 120 THEN picked ELSE regexp_replace(substr(picked, 1, 120), '\\s+$', '') || '…' END AS query_clip, {_RED} AS redacted FROM p""",
    "fix_templates": f"""WITH {_ARCS}, j AS (SELECT a.session_id, failure_seq, success_seq, f.command AS fc, f.output AS fo, s.command AS sc, s.output AS so FROM arcs a JOIN traced f ON f.seq = failure_seq JOIN traced s ON s.seq = success_seq),
k AS (SELECT *, {_kw("fc")} AS kf, {_kw("sc")} AS ks, {_kw("so")} AS kt, {_QUERY} AS q FROM j),
n AS (SELECT *, list_filter(ks, lambda w: NOT list_contains(kf, w)) AS fresh FROM k), m AS (SELECT *, list_concat(CASE WHEN len(fresh) > 0 THEN fresh ELSE ks END, kt) AS merged FROM n),
o AS (SELECT regexp_replace(regexp_replace(lower('scenario-' || session_id || '-' || failure_seq), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS scenario_id, failure_seq, success_seq, CASE WHEN length(q) <= 280 THEN q ELSE regexp_replace(substr(q, 1, 280), '\\s+$', '') || '…' END AS query, {_first("merged")}[1:3] AS phrases FROM m)
SELECT scenario_id, failure_seq, success_seq, query, array_to_string(phrases, ' ') AS phrases FROM o WHERE len(phrases) > 0 QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY failure_seq, success_seq) = 1""",
    "keyword_terms": f"SELECT word, count(*) AS items FROM (SELECT item_id, unnest({_kw('text')}) AS word FROM benchmark WHERE text IS NOT NULL) AS k GROUP BY word",
    "hint_signatures": r"SELECT DISTINCT episode_no, substr(trim(regexp_replace(regexp_replace(lower(description), '\b[0-9a-f]{8,}\b', '', 'g'), '\s+', ' ', 'g')), 1, 160) AS signature, regexp_replace(regexp_replace(lower(description), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM episodes WHERE description IS NOT NULL",
    "document_patches": f"WITH d AS (SELECT doc_id, {_PATHS} AS l, regexp_extract_all(lower(text), 'final_status:\\s*(success|partial|blocked)', 1)[-1] AS status FROM documents WHERE text IS NOT NULL), p AS (SELECT *, {_first('l')} AS p FROM d) SELECT doc_id, CAST(len(p) AS INTEGER) AS files, array_to_string(p, ',') AS paths, status FROM p",
    "tag_lists": "SELECT ingest_seq, array_to_string(tags, '|') AS from_json, array_to_string(tags, '|') AS from_text FROM trace_events WHERE len(tags) > 0",
    "error_time_hints": f"WITH {TRACE_SQL}, {_hint_sql()} SELECT seq, hint, {_VERBOSE} AS verbose, {_TERSE} AS terse, CASE WHEN confidence >= 0.75 THEN {_VERBOSE} ELSE {_TERSE} END AS adaptive FROM h WHERE hint IS NOT NULL",
    "scenario_index": f"WITH b AS (SELECT item_id, task_id, unnest({_kw('text')}[1:6]) AS trap FROM benchmark WHERE text IS NOT NULL), g AS (SELECT trap, count(DISTINCT task_id) AS tasks, array_to_string(list_sort(list_distinct(list(item_id)))[1:5], ',') AS first_items FROM b GROUP BY trap) SELECT * FROM g WHERE tasks > 1",
}

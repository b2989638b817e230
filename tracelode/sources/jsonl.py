"""JSON-lines sources: tolerant reading, file formats, sessions by file, and sinks that don't write twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = ("user_input", "assistant_output", "tool_call", "tool_result", "turn_summary", "feedback", "checkpoint")
#: Outputs that tell a failure where no flag does (fixed values).
FAILED = r"command exited with code [1-9]\d*|command timed out|command aborted"
TRACE_EVENT = (
    "id STRING, timestamp STRING, sessionId STRING, agentId STRING, actorId STRING, harness STRING, scope STRING, type STRING, payload STRING, tags ARRAY<STRING>, "
    "metrics STRUCT<latencyMs: DOUBLE, tokens: STRUCT<inputUncached: DOUBLE, inputCached: DOUBLE, output: DOUBLE, thinking: DOUBLE, cacheWrite: DOUBLE>, cost: STRUCT<usd: DOUBLE>, outcome: STRING>"
)


def read_lines(spark: SparkSession, root: str, sessions: list[str] | None = None) -> DataFrame:
    """value, file, of all .jsonl files below `root` (any case of the ending); missing and broken files count as empty.

    With `sessions`, only the files of these names are listed and opened.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    glob = "*.[jJ][sS][oO][nN][lL]" if not sessions else "{" + ",".join(f"{s}.jsonl" for s in sessions) + "}"
    lines = reader.option("pathGlobFilter", glob).text(root)
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def parse_objects(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, as VARIANT `v`; blank, malformed and scalar lines are dropped."""
    v = F.expr("try_parse_json(value)")
    return lines.withColumn("v", F.when(F.ltrim("value").startswith("{"), v)).filter("v is not null")


def trace_events(lines: DataFrame) -> DataFrame:
    """Lines in the shape of trace events (the seven required fields are strings or an object), parsed; file stays."""
    e = F.from_json("value", TRACE_EVENT)
    required = ("id", "timestamp", "sessionId", "harness", "scope", "type")
    strings = F.expr(" and ".join(f"schema_of_variant(variant_get(v, '$.{f}')) = 'STRING'" for f in required) + " and schema_of_variant(variant_get(v, '$.payload')) like 'OBJECT%'")
    return parse_objects(lines).filter(F.coalesce(strings, F.lit(False))).withColumn("e", e).select("file", "e.*").filter(F.col("type").isin(*EVENT_TYPES))


def file_formats(lines: DataFrame) -> DataFrame:
    """file, format: `trace` if a file has at least one trace event, else `session`."""
    seen = trace_events(lines).select("file").distinct().withColumn("format", F.lit("trace"))
    return lines.select("file").distinct().join(seen, "file", "left").select("file", F.coalesce("format", F.lit("session")).alias("format"))


def query(events: DataFrame, types: list[str] | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Filter by type and inclusive instants (unreadable timestamps stay), ordered by raw timestamp and arrival; the earliest `limit`."""
    from tracelode.functions.instants import instant

    ts = instant(F.col("timestamp"))
    out = events if not types else events.filter(F.col("type").isin(types))
    if since:
        out = out.filter(ts.isNull() | (ts >= F.lit(since).cast("timestamp")))
    if until:
        out = out.filter(ts.isNull() | (ts <= F.lit(until).cast("timestamp")))
    out = out.orderBy("timestamp", *(["ingest_seq"] if "ingest_seq" in events.columns else []))
    return out if limit is None else out.limit(max(0, limit))


def canonicalize(events: DataFrame) -> DataFrame:
    """One row per (session, id), the first to arrive, of sessions whose id carries a task instance."""
    from tracelode.functions.text import session_part

    kept = events.filter(session_part(F.col("sessionId"), 2).isNotNull())
    w = Window.partitionBy("sessionId", "id").orderBy("ingest_seq")
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def session_events(lines: DataFrame) -> DataFrame:
    """Raw agent sessions as trace rows: tool results joined to the latest earlier call of their id, with latencies and shares.

    Columns: file, at, tool_call_id, command, output, is_error, call_latency_ms, tool_latency_ms, tokens, cost. The model's
    time since the message before, its tokens and its cost are shared evenly by the calls of a message.
    """
    schema = (
        "type STRING, id STRING, timestamp STRING, message STRUCT<role: STRING, toolCallId: STRING, toolName: STRING, isError: BOOLEAN, content: ARRAY<STRUCT<type: STRING, text: STRING, id: STRING, name: STRING, arguments: STRUCT<command: STRING>, partialJson: STRING>>, "
        "usage: STRUCT<input: DOUBLE, inputTokens: DOUBLE, output: DOUBLE, outputTokens: DOUBLE, cacheRead: DOUBLE, cachedInputTokens: DOUBLE, cacheWrite: DOUBLE, thinking: DOUBLE, reasoning: DOUBLE, cost: STRUCT<total: DOUBLE, input: DOUBLE, output: DOUBLE, cacheRead: DOUBLE, cacheWrite: DOUBLE>>>"
    )
    from tracelode.functions.instants import instant_micros

    at = F.monotonically_increasing_id() if "at" not in lines.columns else F.col("at")
    m = lines.withColumn("at", at).withColumn("r", F.from_json("value", schema)).filter("r.type = 'message'").withColumn("ts", instant_micros(F.col("r.timestamp")) / 1000)
    before = F.last("ts", ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("before", before)
    calls_in = F.filter("r.message.content", lambda c: c["type"] == "toolCall")
    u = F.col("r.message.usage")
    n0 = lambda *names: F.coalesce(*[u[c] for c in names], F.lit(0.0))  # noqa: E731  a counter under any of its names
    used = n0("input", "inputTokens") + n0("output", "outputTokens") + n0("cacheRead", "cachedInputTokens") + n0("cacheWrite") + n0("thinking", "reasoning")
    spent = F.coalesce(u["cost"]["total"], sum((F.coalesce(u["cost"][c], F.lit(0.0)) for c in ("input", "output", "cacheRead", "cacheWrite")), start=F.lit(0.0)))
    calls = (
        m.filter("r.message.role = 'assistant'").withColumn("calls", calls_in).filter(F.size("calls") > 0).withColumn("k", F.size("calls"))
        .select("file", "at", "ts", (F.greatest(F.lit(0.0), F.coalesce(F.col("ts") - F.col("before"), F.lit(0.0))) / F.col("k")).alias("call_latency_ms"), (used / F.col("k")).alias("tokens"), (spent / F.col("k")).alias("cost"), F.explode("calls").alias("c"))
        .select("*", F.col("c.id").alias("tool_call_id"), F.coalesce("c.arguments.command", F.get_json_object("c.partialJson", "$.command")).alias("command"))
    )
    texts = F.array_join(F.transform(F.filter("r.message.content", lambda c: c["type"] == "text"), lambda c: F.trim(c["text"])), "\n")
    results = m.filter("r.message.role = 'toolResult'").select("file", F.col("at").alias("result_at"), F.col("ts").alias("result_ts"), F.col("r.message.toolCallId").alias("tool_call_id"), F.col("r.message.isError").alias("flag"), texts.alias("output"))
    joined = results.join(calls, ["file", "tool_call_id"]).filter("at < result_at")
    latest = joined.groupBy("file", "result_at").agg(F.max_by(F.struct("tool_call_id", "command", "output", "flag", "call_latency_ms", "tokens", "cost", "ts", "result_ts"), "at").alias("x")).select("file", F.col("result_at").alias("at"), "x.*")
    o = F.lower("output")
    inferred = F.when(F.col("flag").isNotNull(), F.col("flag")).when(o.contains("exited with code 0"), F.lit(False)).otherwise(o.rlike(FAILED))
    return latest.select("file", "at", "tool_call_id", "command", "output", inferred.alias("is_error"), "call_latency_ms", F.greatest(F.lit(0.0), F.coalesce(F.col("result_ts") - F.col("ts"), F.lit(0.0))).alias("tool_latency_ms"), "tokens", "cost")


def session_hint(file: Column) -> Column:
    """The session that a file's name tells."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/\\\\]*)$", 1), r"(?i)\.jsonl$", "")


def file_models(lines: DataFrame) -> DataFrame:
    """file, model of raw sessions: the first record that names a model (of itself or of its message), with its provider, else `unknown`."""
    r = F.from_json("value", "type STRING, modelId STRING, provider STRING, model STRING, message STRUCT<provider: STRING, model: STRING>")
    key = lambda provider, model: F.when(F.trim(model) != "", F.concat_ws("/", F.nullif(F.trim(provider), F.lit("")), F.trim(model)))
    x = lambda c: F.col(f"r.{c}")
    named = F.when(x("type") == "model_change", key(x("provider"), x("modelId"))).when(x("type") == "message", F.coalesce(key(x("provider"), x("model")), key(x("message.provider"), x("message.model"))))
    at = F.monotonically_increasing_id() if "at" not in lines.columns else F.col("at")
    m = lines.select("file", at.alias("at"), r.alias("r")).select("file", "at", named.alias("m"))
    return m.groupBy("file").agg(F.coalesce(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("at"))), F.lit("unknown")).alias("model"))


def session_models(files: DataFrame) -> DataFrame:
    """session_id, model of (session_id, model) rows: the only one known, or `mixed:` and all of them."""
    known = F.array_sort(F.collect_set(F.when(F.col("model") != "unknown", F.col("model"))))
    g = files.groupBy("session_id").agg(known.alias("k"))
    return g.select("session_id", F.when(F.size("k") == 0, "unknown").when(F.size("k") == 1, F.col("k")[0]).otherwise(F.concat(F.lit("mixed:"), F.array_join("k", "|"))).alias("model"))


def changed_sessions(spark: SparkSession, root: str, state: DataFrame | None = None) -> DataFrame:
    """session_id, path, sha256, body of the session files below `root` that `state` (session_id, sha256) has not seen so.

    Files are hashed where they are read; unreadable ones are left out. The state is joined, not collected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").load(root)
    own = files.select(session_hint(F.col("path")).alias("session_id"), "path", F.sha2("content", 256).alias("sha256"), F.col("content").alias("body"))
    return own if state is None else own.join(state.select("session_id", "sha256"), ["session_id", "sha256"], "left_anti")


def ship_sessions(spark: SparkSession, root: str, state_path: str, out: str, most: int | None = None, dry_run: bool = False) -> dict[str, int]:
    """Append changed sessions, compressed, to `out` and to the state below `state_path`; counts of scanned, shipped and unchanged.

    `most` bounds the sessions of a call (the least ids first); a dry run counts only. What was appended twice after a failure is
    one bundle for the delivery index, as its content hash is the same.
    """
    from tracelode.session import file_system, stored

    fs, where = file_system(spark, state_path)
    state = spark.read.parquet(state_path) if fs.exists(where) else None
    latest = None if state is None else state.groupBy("session_id").agg(F.max_by("sha256", "at").alias("sha256"))
    scanned = changed_sessions(spark, root).select("session_id").count()
    todo = changed_sessions(spark, root, latest)
    changed = todo.count()
    if most is not None:
        todo = todo.orderBy("session_id").limit(most)
    if dry_run or not changed:
        return {"scanned": scanned, "shipped": min(changed, most if most is not None else changed) if dry_run else 0, "unchanged": scanned - changed}
    kept = stored(todo, "shipment")
    kept.select("session_id", "sha256", "body").write.mode("append").option("compression", "gzip").parquet(out)
    kept.select("session_id", "sha256", F.current_timestamp().alias("at")).write.mode("append").parquet(state_path)
    return {"scanned": scanned, "shipped": kept.count(), "unchanged": scanned - changed}


def report_json(report: DataFrame) -> DataFrame:
    """A report as one JSON object a row, null fields included."""
    return report.select(F.to_json(F.struct(*[F.col(c) for c in report.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as one JSON-lines file folder."""
    report_json(report).coalesce(1).write.mode("overwrite").text(path)


def memo(title: str, gate: DataFrame) -> str:
    """The decision of a gate (one row) as a Markdown note: pass or fail, what failed, and the figures."""
    row = gate.first().asDict()
    failures = [x for x in (row.get("failures") or "").split(",") if x]
    lines = [f"# {title}", "", f"Decision: **{'hold' if failures else 'proceed'}**", ""]
    lines += ["Failed checks:", *[f"- {x}" for x in failures], ""] if failures else []
    return "\n".join([*lines, "| figure | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in row.items() if k != "failures"]]) + "\n"


def published(report: DataFrame, columns: list[str]) -> DataFrame:
    """The allowed columns of a report that are there, home folders and secrets in their texts replaced."""
    from tracelode.functions.text import redact

    kinds = dict(report.dtypes)
    return report.select(*[redact(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in columns if c in kinds])


def write_events(events: DataFrame, root: str) -> None:
    """Append events as JSON lines below a folder per session."""
    events.withColumn("session_folder", F.regexp_replace("sessionId", "[^A-Za-z0-9_.-]", "_")).write.mode("append").partitionBy("session_folder").json(root)


def bundle_key(team, session, sha):
    """The canonical key of a bundle, null where a part isn't valid."""
    ok = team.rlike("^[A-Za-z0-9_-]{1,64}$") & session.rlike("^[A-Za-z0-9_.:-]{1,200}$") & sha.rlike("^[0-9a-f]{64}$")
    return F.when(ok, F.concat_ws("/", F.lit("teams"), team, F.lit("sessions"), session, F.concat(sha, F.lit(".jsonl.gz"))))

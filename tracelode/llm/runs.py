"""Problem 1: collapse runs of the same consecutive tool result into one event.

Adjacent agglomeration: within a session, every tool result starts as a run of its own in a linked list; a priority
queue holds the links between neighbours, and the most similar neighbouring runs are merged first, until no link
meets the similarity and gap limits. The similarity of two runs is that of the last event of the one and the first of
the other: 1 if command and output are equal apart from layout, 0.9 if they are equal once machine-made values are
masked, else 0; events of different error state have 0. As a link's similarity does not change when its ends grow, the
result does not depend on where the input is cut, and long sessions are worked on in pieces (operators/ordered.py).

Defined results: rows without session id (null or blank) or readable timestamp are left out; a null id is an event of
its own; null, blank and broken payloads count as the step with their squeezed raw text as output and no command; equal
timestamps are ordered by `ingest_seq`; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import payload as P
from tracelode.functions.instants import instant_micros
from tracelode.operators.ordered import first_arrival, sorted_pieces
from tracelode.session import stored

#: Values that a machine makes anew at each execution, as fixed values: (pattern, what stands for it).
_MASK_BOTH = (
    (r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", "<uuid>"),
    (r"(?:/private)?(?:/var)?/tmp/[A-Za-z]+[-_.][0-9A-Fa-f]{4,}", "<tmp>"),
    (r"\b0x[0-9A-Fa-f]{6,}\b", "<addr>"),
)
_MASK_OUTPUT = (
    (r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?:Z|[+-]\d\d:?\d\d)?", "<time>"),
    (r"\b\d\d?:\d\d:\d\d(?:[.,]\d+)?\b", "<time>"),
    (r"\b(?=[0-9]*[A-Fa-f]|[0-9]{8,})[0-9A-Fa-f]{7,}\b(?!\.\d)", "<hex>"),
    (r"\b\d+(?:\.\d+)? ?(?:ns|us|µs|ms|s|sec|secs|seconds)\b", "<span>"),
    (r"(?i)(\"?\b(?:took|elapsed|duration|latency)(?:_?ms)?\"?[:=] ?)\d+(?:\.\d+)?", "$1<span>"),
    (r"(?i)(\b(?:pid|tid|ppid|worker|process|thread)[ =:#\[]\"?)\d+", "$1<pid>"),
    (r"(\b[a-z]+\[)\d+(\]:)", "$1<pid>$2"),
)


def _masked(text: Column, rules: tuple) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def step_events(events: DataFrame) -> DataFrame:
    """The tool results: session_id, ts, ingest_seq, id, err, and the step's keys before and after masking.

    Texts end here: only ids, instants and 64-bit hashes are shuffled.
    """
    own = events.select("ingest_seq", "id", "sessionId", "timestamp", "payload", F.col("metrics.outcome").alias("outcome"), "type").filter(F.col("type") == "tool_result")
    p = F.col("p")
    raw = F.when(p.isNull() | F.coalesce(p["command"], *[p[k] for k in P.TEXT_KEYS]).isNull() & ~F.coalesce(F.col("payload").rlike(r"^\s*\{"), F.lit(False)), F.coalesce(F.col("payload"), F.lit(""))).otherwise(P.text_of(p))
    narrow = (
        own.withColumn("p", P.parsed(F.col("payload")))
        .select("ingest_seq", "id", "sessionId", "timestamp", (F.coalesce(F.col("outcome") == "failure", F.lit(False)) | F.coalesce(p["isError"], F.lit(False))).alias("err"), P.squeeze(F.coalesce(p["command"], F.lit(""))).alias("command"), P.squeeze(raw).alias("output"))
        .withColumns({"c": _masked(F.col("command"), _MASK_BOTH), "o": _masked(F.col("output"), _MASK_BOTH + _MASK_OUTPUT)})
        .select(
            "ingest_seq", "id",
            F.when(~P.is_blank(F.col("sessionId")), F.col("sessionId")).alias("session_id"),
            instant_micros(F.col("timestamp")).alias("ts"), "err",
            F.xxhash64("command", "output").alias("raw_key"), F.xxhash64("c", "o").alias("step_a"), F.xxhash64("o", F.lit("|"), "c").alias("step_b"),
        )
    )
    columns = ["ingest_seq", "id", "session_id", "ts", "err", "raw_key", "step_a", "step_b"]
    return first_arrival(narrow, "id", "ingest_seq", columns).filter("session_id is not null and ts is not null")


def agglomerate(similarity: np.ndarray, start: np.ndarray, end: np.ndarray, min_similarity: float, max_gap: int | None) -> np.ndarray:
    """The run (its first position) of each of n neighbours in order; similarity[i] is that of i and i+1.

    The queue gives the most similar link first, ties from the left. `max_gap` bounds the time between two runs.
    """
    n = len(start)
    head, tail, after = np.arange(n), np.arange(n), np.arange(1, n + 1)
    queue = [(-float(similarity[i]), int(i)) for i in np.flatnonzero(similarity >= min_similarity)]
    heapq.heapify(queue)
    ends = end.copy()
    while queue:
        _, i = heapq.heappop(queue)  # the link between position i and i+1: the end of one run, the start of the next
        left, right = head[i], i + 1
        if max_gap is not None and start[right] - ends[left] > max_gap:
            continue
        last = tail[right]
        tail[left], head[last], head[right], ends[left], after[left] = last, left, left, ends[right], after[right]
    run = np.empty(n, dtype=np.int64)
    at = 0
    while at < n:  # along the list of what is left
        run[at : tail[at] + 1] = at
        at = tail[at] + 1
    return run


def _similarity(t: pa.Table) -> np.ndarray:
    sid = t["session_id"].combine_chunks()
    col = {c: t[c].to_numpy() for c in ("raw_key", "step_a", "step_b")}
    err = t["err"].to_numpy(zero_copy_only=False)
    codes = sid.dictionary_encode().indices.to_numpy()
    same = (codes[1:] == codes[:-1]) & (err[1:] == err[:-1])
    step = same & (col["step_a"][1:] == col["step_a"][:-1]) & (col["step_b"][1:] == col["step_b"][:-1])
    return np.where(step & (col["raw_key"][1:] == col["raw_key"][:-1]), 1.0, np.where(step, 0.9, 0.0))


_RUN = "session_id STRING, piece LONG, at INT, edge BOOLEAN, n LONG, first_ts LONG, last_ts LONG, first_seq LONG, first_event_id STRING, last_event_id STRING, err BOOLEAN, step_a LONG, step_b LONG, first_raw LONG, last_raw LONG"


def consecutive_runs(events: DataFrame, min_similarity: float = 0.9, max_gap_seconds: float | None = None, min_length: int = 1) -> DataFrame:
    """One row per run: session_id, first_event_id, last_event_id, n_events, started_us, duration_ms, is_error."""
    gap = None if max_gap_seconds is None else int(max_gap_seconds * 1e6)

    def piece(t: pa.Table, number: int) -> pa.Table:
        ts = t["ts"].to_numpy()
        run = agglomerate(_similarity(t), ts, ts, min_similarity, gap)
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        last = np.append(first[1:], len(run)) - 1
        edge = np.zeros(len(first), dtype=bool)
        edge[0] = edge[-1] = True
        keep = edge | (last - first + 1 >= min_length)
        f, e = first[keep], last[keep]
        take = lambda c, i: t[c].take(pa.array(i))
        return pa.table(
            {
                "session_id": take("session_id", f), "piece": pa.array(np.full(len(f), number)), "at": pa.array(np.arange(len(f), dtype=np.int32)), "edge": pa.array(edge[keep]),
                "n": pa.array(e - f + 1), "first_ts": pa.array(ts[f]), "last_ts": pa.array(ts[e]), "first_seq": take("ingest_seq", f), "first_event_id": take("id", f), "last_event_id": take("id", e),
                "err": take("err", f), "step_a": take("step_a", f), "step_b": take("step_b", f), "first_raw": take("raw_key", f), "last_raw": take("raw_key", e),
            }
        )

    rows = stored(sorted_pieces(step_events(events), "session_id", ["ts", "ingest_seq"], piece, _RUN), "runs")
    # The edges: the first and last run of each piece. All events of a run are the same step, so one key speaks for it.
    w = Window.partitionBy("session_id").orderBy("piece", "at")
    prev = lambda c: F.lag(c).over(w)
    joins = (F.col("piece") != prev("piece")) & (F.col("err") == prev("err")) & (F.col("step_a") == prev("step_a")) & (F.col("step_b") == prev("step_b"))
    if gap is not None:
        joins = joins & (F.col("first_ts") - prev("last_ts") <= gap)
    # The link over an edge is that of the last event before it and the first one after it, as within a piece.
    joins = joins & (F.when(F.col("first_raw") == prev("last_raw"), 1.0).otherwise(0.9) >= min_similarity)
    stitched = (
        rows.filter("edge")
        .withColumn("new", F.when(joins, 0).otherwise(1))
        .withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("session_id", "grp")
        .agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min_by("first_event_id", F.struct("piece", "at")).alias("first_event_id"), F.max_by("last_event_id", F.struct("piece", "at")).alias("last_event_id"), F.first("err").alias("err"))
        .drop("grp")
    )
    inner = rows.filter("not edge").select(*stitched.columns)
    return (
        inner.unionByName(stitched)
        .filter(F.col("n") >= min_length)
        .select("session_id", "first_event_id", "last_event_id", F.col("n").alias("n_events"), F.col("first_ts").alias("started_us"), ((F.col("last_ts") - F.col("first_ts")) / 1000).alias("duration_ms"), F.col("err").alias("is_error"))
    )

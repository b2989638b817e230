"""Problem 6: rebuild ordered conversations from message rows, and drop the broken, empty and unanswered ones.

Rows are sessionised by their channel (the session id), ordered by instant and `ingest_seq`, given roles by event type,
and split into segments at inactivity gaps; the gap is calibrated on the gaps of all sessions unless it is given. A
session is dropped when it has a payload that is no valid JSON, no message, an assistant message first, or a user
message without a reply before the next user message or the end.

The rows are sorted and written once without their texts; the gap is calibrated on them, and they are split and judged from
there. Each stretch of a session in a task is reduced to a summary (messages, segments, roles at both ends, unanswered user
messages, broken payloads), and the summaries are folded in order, so a session that holds a third of the rows is never in
one task. A reply that comes after a gap is a reply: a session is judged by what its segments, in order, leave unanswered.

Defined results: rows without session id or readable timestamp are left out (after a redelivered id has been reduced to
its first arrival); null payloads and texts of only white space are no messages; an empty or blank payload string is no
valid JSON; several assistant messages in a row are fine; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import payload as P
from tracelode.functions.instants import instant_micros
from tracelode.operators.ordered import first_arrival, sorted_pieces
from tracelode.session import stored

USER, ASSISTANT = 0, 1
_ROLES = {"user_input": USER, "assistant_output": ASSISTANT}


def message_rows(events: DataFrame, with_text: bool = False) -> DataFrame:
    """The user and assistant rows: session_id, ts, ingest_seq, role, is_message, broken (and text)."""
    own = events.select("ingest_seq", "id", "sessionId", "timestamp", "type", "payload").filter(F.col("type").isin(list(_ROLES)))
    text = P.text_of(P.parsed(F.col("payload")))
    # Valid JSON: it parses, and nothing but white space follows what was parsed (a parser stops at the first value).
    valid = F.expr("try_parse_json(payload)").isNotNull() & F.coalesce(F.trim(F.regexp_replace("payload", r"[\s]+", " ")).rlike(r'^(\{.*\}|\[.*\]|".*"|-?[0-9][0-9.eE+-]*|true|false|null)$'), F.lit(False))
    narrow = own.select(
        "ingest_seq", "id",
        F.when(~P.is_blank(F.col("sessionId")), F.col("sessionId")).alias("session_id"),
        instant_micros(F.col("timestamp")).alias("ts"),
        F.when(F.col("type") == "user_input", F.lit(USER)).otherwise(F.lit(ASSISTANT)).cast("tinyint").alias("role"),
        (valid & ~P.is_blank(text)).alias("is_message"),
        (F.col("payload").isNotNull() & ~valid).alias("broken"),
        *([text.alias("text")] if with_text else []),
    )
    columns = ["ingest_seq", "id", "session_id", "ts", "role", "is_message", "broken", *(["text"] if with_text else [])]
    narrow = narrow.withColumns({"is_message": F.coalesce("is_message", F.lit(False)), "broken": F.coalesce("broken", F.lit(False))})
    return first_arrival(narrow, "id", "ingest_seq", columns).filter("session_id is not null and ts is not null")


_TURN = "session_id STRING, piece LONG, at LONG, ts LONG, role TINYINT, is_message BOOLEAN, broken BOOLEAN, gap LONG"
_SUMMARY = "session_id STRING, piece LONG, at LONG, messages LONG, first_role TINYINT, last_role TINYINT, unanswered LONG, segments LONG, broken LONG"


def _turns(t: pa.Table, number: int) -> pa.Table:
    """The rows of a sorted piece with their place in it, and for messages the time since the message before (null at the start)."""
    code = t["session_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    ts, msg = t["ts"].to_numpy(), t["is_message"].to_numpy(zero_copy_only=False)
    at = np.flatnonzero(msg)
    gap, known = np.zeros(len(ts), dtype=np.int64), np.zeros(len(ts), dtype=bool)
    if len(at) > 1:
        gap[at[1:]] = ts[at[1:]] - ts[at[:-1]]
        known[at[1:]] = code[at[1:]] == code[at[:-1]]
    return pa.table({"session_id": t["session_id"], "piece": pa.array(np.full(len(ts), number)), "at": pa.array(np.arange(len(ts))), "ts": t["ts"], "role": t["role"], "is_message": t["is_message"], "broken": t["broken"], "gap": pa.array(gap, mask=~known)})


def sorted_turns(events: DataFrame) -> DataFrame:
    """The message rows without texts, sorted and written once; gaps are exact: those over the edges of pieces are filled in."""
    rows = stored(sorted_pieces(message_rows(events).select("session_id", "ts", "ingest_seq", "role", "is_message", "broken"), "session_id", ["ts", "ingest_seq"], _turns, _TURN), "turns")
    ends = rows.filter("is_message").groupBy("session_id", "piece").agg(F.min(F.struct("at", "ts")).alias("a"), F.max("ts").alias("t1"))
    w = Window.partitionBy("session_id").orderBy("piece")
    # Only sessions that lie in several pieces have such edges: no more rows than pieces.
    edges = ends.withColumn("edge", F.col("a.ts") - F.lag("t1").over(w)).filter("edge is not null").select("session_id", "piece", F.col("a.at").alias("at"), "edge")
    return rows.join(F.broadcast(edges), ["session_id", "piece", "at"], "left").withColumn("gap", F.coalesce("gap", "edge")).drop("edge")


def calibrated_gap_us(turns: DataFrame, share: float = 0.995, floor_seconds: float = 1800.0) -> float:
    """An inactivity gap in microseconds: the `share` quantile of all gaps between messages of a session, at least the floor.

    The quantile is approximate with an error of a thousandth of the rows, whatever their number.
    """
    found = turns.agg(F.percentile_approx("gap", share, 1000).alias("g")).first()["g"]
    return max(floor_seconds * 1e6, found or 0.0)


def _summaries(limit: float):
    """Stretches of a session as they lie in a task: split at inactivity gaps, each segment judged, and folded in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            sid = t["session_id"].combine_chunks().dictionary_encode()
            code, piece, at = sid.indices.to_numpy(), t["piece"].to_numpy(), t["at"].to_numpy()
            new = np.append(True, (code[1:] != code[:-1]) | (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1))
            stretch = np.cumsum(new) - 1
            k, start = int(stretch[-1]) + 1, np.flatnonzero(new)
            msg = np.flatnonzero(t["is_message"].to_numpy(zero_copy_only=False))
            role, of = t["role"].to_numpy()[msg].astype(np.int8), stretch[msg]
            gap = np.nan_to_num(t["gap"].to_numpy(zero_copy_only=False).astype(np.float64)[msg], nan=-1.0)
            first, last = np.full(k, -1, dtype=np.int8), np.full(k, -1, dtype=np.int8)
            last[of] = role
            first[of[::-1]] = role[::-1]
            count = lambda x: np.bincount(x, minlength=k).astype(np.int64)
            # Within a segment a user message that another one follows has no reply; over a gap it has none either, unless
            # the next segment opens with the assistant: neighbours are compared in both cases.
            twice = (of[1:] == of[:-1]) & (role[1:] == USER) & (role[:-1] == USER) if len(msg) else np.zeros(0, dtype=bool)
            split = gap > limit
            broken = np.flatnonzero(t["broken"].to_numpy(zero_copy_only=False))
            yield from pa.table(
                {
                    "session_id": sid.dictionary.take(pa.array(code[start])).cast(pa.string()), "piece": pa.array(piece[start]), "at": pa.array(at[start]), "messages": pa.array(count(of)), "first_role": pa.array(first), "last_role": pa.array(last),
                    "unanswered": pa.array(count(of[1:][twice])), "segments": pa.array(count(of[split])), "broken": pa.array(count(stretch[broken])),
                }
            ).to_batches()

    return run


def session_verdicts(events: DataFrame, gap_seconds: float | None = None) -> DataFrame:
    """One row per session: messages, segments (between inactivity gaps), unanswered, starts_with_assistant, broken, dropped."""
    turns = sorted_turns(events)
    return verdicts(turns, calibrated_gap_us(turns) if gap_seconds is None else gap_seconds * 1e6)


def verdicts(turns: DataFrame, gap_us: float) -> DataFrame:
    """The verdicts of `sorted_turns` for a gap."""
    pieces = turns.mapInArrow(_summaries(gap_us), _SUMMARY)
    # The fold over a session's stretches, of which there are no more than batches that hold it.
    ordered = F.array_sort(F.collect_list(F.when(F.col("messages") > 0, F.struct("piece", "at", "first_role", "last_role"))))
    zero = F.struct(F.lit(-1).cast("tinyint").alias("last"), F.lit(0).cast("bigint").alias("twice"))
    step = lambda acc, x: F.struct(x["last_role"].alias("last"), (acc["twice"] + F.when((acc["last"] == USER) & (x["first_role"] == USER), 1).otherwise(0)).alias("twice"))
    folded = pieces.groupBy("session_id").agg(
        F.sum("messages").alias("messages"), F.sum("unanswered").alias("inner"), F.sum("broken").alias("broken"), F.sum("segments").alias("gaps"),
        F.min_by("first_role", F.when(F.col("messages") > 0, F.struct("piece", "at"))).alias("first_role"), F.aggregate(ordered, zero, step).alias("f"),
    )
    unanswered = F.col("inner") + F.col("f.twice") + F.when(F.col("f.last") == USER, 1).otherwise(0)
    return folded.select(
        "session_id", "messages", F.when(F.col("messages") > 0, F.col("gaps") + 1).otherwise(0).alias("segments"), unanswered.alias("unanswered"),
        F.coalesce(F.col("first_role") == ASSISTANT, F.lit(False)).alias("starts_with_assistant"), (F.col("broken") > 0).alias("broken"),
    ).withColumn("dropped", F.col("broken") | (F.col("messages") == 0) | F.col("starts_with_assistant") | (F.col("unanswered") > 0))


def conversations(events: DataFrame, gap_seconds: float | None = None) -> DataFrame:
    """The messages of the sessions that stay: session_id, segment, position, role, ts, text.

    `position` counts from 0 over the session, `segment` counts the stretches between inactivity gaps. Both are
    exact across pieces: a piece numbers its own rows, and the counts of the pieces before it are added.
    """
    turns = sorted_turns(events)
    gap = calibrated_gap_us(turns) if gap_seconds is None else gap_seconds * 1e6

    def number(t: pa.Table, piece: int) -> pa.Table:
        code = t["session_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        ts = t["ts"].to_numpy()
        new = np.append(True, code[1:] != code[:-1])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        breaks = np.append(False, (ts[1:] - ts[:-1] > gap) & (code[1:] == code[:-1]))
        before = np.cumsum(breaks)
        role = np.where(t["role"].to_numpy() == USER, "user", "assistant")
        return pa.table({"session_id": t["session_id"], "piece": pa.array(np.full(len(ts), piece)), "at": pa.array(np.arange(len(ts)) - start), "breaks": pa.array(before - before[start]), "ts": t["ts"], "role": pa.array(role.tolist()), "text": t["text"]})

    keep = verdicts(turns, gap).filter("not dropped").select("session_id")
    kept = message_rows(events, with_text=True).filter("is_message").select("session_id", "ts", "ingest_seq", "role", "text").join(keep, "session_id", "left_semi")
    rows = stored(sorted_pieces(kept, "session_id", ["ts", "ingest_seq"], number, "session_id STRING, piece LONG, at LONG, breaks LONG, ts LONG, role STRING, text STRING"), "texts")
    sizes = rows.groupBy("session_id", "piece").agg(F.max("at").alias("a"), F.max("breaks").alias("b"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    w = Window.partitionBy("session_id").orderBy("piece")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    jump = F.when(F.col("t0") - F.lag("t1").over(w) > gap, 1).otherwise(0)
    base = sizes.withColumn("jump", jump).select("session_id", "piece", F.coalesce(F.sum(F.col("a") + 1).over(earlier), F.lit(0)).alias("a0"), (F.coalesce(F.sum("b").over(earlier), F.lit(0)) + F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("b0"))
    return rows.join(base, ["session_id", "piece"]).select("session_id", (F.col("breaks") + F.col("b0")).alias("segment"), (F.col("at") + F.col("a0")).alias("position"), "role", F.timestamp_micros("ts").alias("ts"), "text")

"""Problem 5: schemas that drift between files.

Rescue-column ingestion: every line that is a JSON object becomes a row of the target schema. A value whose JSON type is
that of its column goes there; what is unknown or of another type is kept as JSON in `_rescued`. Approved fields (renamed
ones, and those of another type that can be cast) are promoted afterwards: their rescued values are replayed into the
typed columns, and what can't be cast stays rescued.

The change report profiles each file from what ingestion made of it: how many records carry a path, as which type, and a
fixed number of counters of the content (hashed shapes, leading words and words of whole strings, magnitudes of numbers).
Counters are summed per (file, path, counter) before and in the shuffle, so neither a hot client nor a hot file meets in one
task; a file is then compared with its client's preceding one. A removed path whose content goes on under an added one is
a rename.

Defined results: null, blank and malformed lines and JSON other than objects count for nothing; JSON text that holds an
object counts as that object; a key that occurs twice has its last value; an empty object has no field; a file without
records has no field; the first file of a client has no changes; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import spread, stored

#: Target schema: dotted path and type of a trace event.
TARGET = {
    "id": "string", "timestamp": "string", "sessionId": "string", "agentId": "string", "actorId": "string", "harness": "string", "scope": "string", "type": "string",
    "payload.command": "string", "payload.output": "string", "payload.text": "string", "payload.toolName": "string", "payload.toolCallId": "string", "payload.isError": "boolean", "payload.exitCode": "number",
    "metrics.latencyMs": "number", "metrics.outcome": "string", "metrics.cost.usd": "number", "metrics.tokens.inputUncached": "number", "metrics.tokens.output": "number", "tags": "array",
}
TYPES = ("string", "number", "boolean", "array")
_SQL = {"string": "STRING", "number": "DOUBLE", "boolean": "BOOLEAN", "array": "STRING"}


def column_of(path: str) -> str:
    """The column of a target path."""
    return path.replace(".", "_")


def flatten(o: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths of all values that are not objects."""
    for k, v in o.items():
        path = f"{prefix}.{k}" if prefix else k
        if isinstance(v, str) and v.lstrip()[:1] == "{":
            try:
                inner = json.loads(v)
                v = inner if isinstance(inner, dict) else v
            except ValueError:
                pass
        if isinstance(v, dict):
            yield from flatten(v, path)
        else:
            yield path, v


def json_type(v: object) -> str:
    """One of TYPES."""
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array"


def ingest_line(line: str | None, target: dict[str, str]) -> tuple[dict[str, object], dict[str, object]] | None:
    """(typed values by path, rescued values by path) of a line; None if it is no JSON object. Nulls are dropped."""
    if not line or line.lstrip()[:1] != "{":
        return None
    try:
        o = json.loads(line)
    except (ValueError, RecursionError):
        return None
    typed, rescued = {}, {}
    for path, v in flatten(o):
        if v is not None:
            (typed if target.get(path) == json_type(v) else rescued)[path] = v
    return typed, rescued


def ingest(raw: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """record_no, clientId, fileName, file_seq, the target's columns (arrays as JSON text), `_rescued` (JSON by path, or null)."""
    own = target or TARGET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keep = [], []
            for i, line in enumerate(b.column(4).to_pylist()):
                if (row := ingest_line(line, own)) is not None:
                    rows.append(row)
                    keep.append(i)
            cols = [b.column(k).take(pa.array(keep, pa.int64())) for k in range(4)]
            for path, kind in own.items():
                got = [t.get(path) for t, _ in rows]
                if kind == "array":
                    cols.append(pa.array([None if v is None else json.dumps(v, ensure_ascii=False) for v in got], pa.string()))
                else:
                    cols.append(pa.array([None if v is None else float(v) for v in got] if kind == "number" else got, {"string": pa.string(), "number": pa.float64(), "boolean": pa.bool_()}[kind]))
            cols.append(pa.array([json.dumps(r, ensure_ascii=False) if r else None for _, r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["record_no", "clientId", "fileName", "file_seq", *map(column_of, own), "_rescued"])

    schema = "record_no LONG, clientId STRING, fileName STRING, file_seq INT, " + ", ".join(f"{column_of(p)} {_SQL[t]}" for p, t in own.items()) + ", _rescued STRING"
    return _source(raw).mapInArrow(run, schema)


def _source(raw: DataFrame) -> DataFrame:
    return spread(raw.select(F.col("record_no").cast("long"), "clientId", "fileName", F.col("file_seq").cast("int"), "line"))


def promote(events: DataFrame, approved: dict[str, str], target: dict[str, str] | None = None) -> DataFrame:
    """Replay rescued values: `approved` sends a rescued path to a target path (itself for values of another type).

    A column takes the first value that can be cast; paths whose value was cast leave `_rescued`.
    """
    own = target or TARGET
    m = F.col("_m")

    def cast(value: Column, kind: str) -> Column:
        text = F.lower(F.trim(value))
        if kind == "number":
            return F.coalesce(value.try_cast("double"), F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)))
        if kind == "boolean":
            return F.when(text.isin("true", "1", "yes"), F.lit(True)).when(text.isin("false", "0", "no"), F.lit(False))
        return value

    columns, used = {}, []
    for to in own:
        paths = [p for p, t in approved.items() if t == to]
        if not paths:
            continue
        col, values = F.col(column_of(to)), [cast(m[p], own[to]) for p in paths]
        columns[column_of(to)] = F.coalesce(col, *values)
        for i, p in enumerate(paths):
            used.append(F.when(F.coalesce(col, *values[:i]).isNull() & values[i].isNotNull(), F.lit(p)))
    # What was used is settled before the columns change, or names within the lambda would mean the new ones.
    settled = events.withColumn("_m", F.from_json("_rescued", "MAP<STRING,STRING>")).withColumn("_used", F.array(*used) if used else F.array().cast("array<string>"))
    left = F.map_filter(m, lambda k, v: ~F.coalesce(F.array_contains(F.col("_used"), k), F.lit(False)))
    return settled.withColumns({**columns, "_rescued": F.when(F.size(F.map_keys(left)) > 0, F.to_json(left))}).drop("_m", "_used")


# ---- the change report -------------------------------------------------------------------------------------------------

_BUCKETS = 128
_WORD = re.compile(r"[^\W_]+")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![A-Za-z0-9])")
_RECORDS, _TYPE, _SHAPE, _LEAD, _WORDS, _SIZE = 0, 10, 1000, 2000, 3000, 4000


_DIGITS, _LETTERS, _RUN, _FIRST = re.compile(r"\d+"), re.compile(r"[^\W\d_]+"), re.compile(r"(?:a[ .,;:'-]*){5,}"), re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1 << 16)
def _bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % _BUCKETS


def _shape(text: str) -> str:
    return _RUN.sub("A", _LETTERS.sub("a", _DIGITS.sub("9", text)))


def _counters(x: str) -> tuple[int, ...]:
    """Of a whole string: the shapes of its lines in pieces of 60 characters, its leading word with what follows, and all its words."""
    plain = _HEX.sub("\u0001", x)
    lead = _FIRST.match(plain)
    if lead and lead.end() == len(plain):  # one word
        return (_SHAPE + 10 + _bucket("a"), _LEAD + _bucket(plain), _WORDS + _bucket(plain.lower()))
    out = [_SHAPE + 10 + _bucket(shape[i : i + 60]) for shape in _shape(plain).split("\n") for i in range(0, max(1, len(shape)), 60)]
    tail = _shape(plain[lead.end() : lead.end() + 60]) if lead else _shape(plain[:200])
    out.append(_LEAD + _bucket((lead[0] if lead else "") + tail[:12]))
    out += [_WORDS + _bucket(w) for w in _WORD.findall(_DIGITS.sub("9", plain.lower()))]
    return tuple(out)


#: For short strings, which often come again; long ones would fill the memory.
_short_counters = lru_cache(maxsize=1 << 16)(_counters)


def content_counters(v: object) -> Iterator[int]:
    """The counters that a value adds to."""
    yield _TYPE + TYPES.index(json_type(v))
    if isinstance(v, bool):
        yield _SHAPE + (5 if v else 6)
    elif isinstance(v, (int, float)):
        finite = v == v and abs(v) != math.inf
        size = math.frexp(abs(v))[1] if finite else 0
        yield _SIZE + max(-20, min(80, size)) + 20
        yield _SHAPE + (1 if v == int(v) else 2) if finite else _SHAPE + 3
    else:
        for x in v if isinstance(v, list) else [v]:
            if isinstance(x, str):
                yield from _short_counters(x) if len(x) <= 2000 else _counters(x)
            elif x is not None:
                yield _SHAPE + 4


def file_profiles(raw: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """clientId, file_seq, fileName, path, records, counters (map): what ingestion saw in each file."""
    own = target or TARGET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: Counter = Counter()
            by_field: dict[tuple, Counter] = {}
            for client, name, seq, line in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4))):
                if (row := ingest_line(line, own)) is None:
                    continue
                file = (client, seq, name)
                sums[(*file, "", _RECORDS)] += 1
                for part in row:  # what was typed, and what was rescued
                    for path, v in part.items():
                        have = by_field.get((file, path))
                        if have is None:
                            have = by_field[(file, path)] = Counter()
                        for c in content_counters(v):
                            have[c] += 1
            for (file, path), have in by_field.items():
                for c, n in have.items():
                    sums[(*file, path, c)] = n
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.string()), pa.array([k[4] for k in keys], pa.int32()), pa.array([sums[k] for k in keys], pa.int64())],
                names=["clientId", "file_seq", "fileName", "path", "counter", "n"],
            )

    return _source(raw).mapInArrow(run, "clientId STRING, file_seq INT, fileName STRING, path STRING, counter INT, n LONG").groupBy("clientId", "file_seq", "fileName", "path", "counter").agg(F.sum("n").alias("n"))


def _cosine(a: dict[int, int], b: dict[int, int], low: int, high: int) -> float | None:
    x = {k: v for k, v in a.items() if low <= k < high}
    y = {k: v for k, v in b.items() if low <= k < high}
    if not x or not y:
        return None
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def content_similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """From 0 to 1: how much the content of one field looks like that of another."""
    shape = _cosine(a, b, _SHAPE, _LEAD) or 0.0
    lead, words, size = _cosine(a, b, _LEAD, _WORDS), _cosine(a, b, _WORDS, _SIZE), _cosine(a, b, _SIZE, _SIZE + 1000)
    if size is not None:
        return 0.3 * shape + 0.7 * size
    if lead is None and words is None:
        return shape
    return 0.4 * shape + 0.6 * max(lead or 0.0, words or 0.0)


def _bare(path: str) -> str:
    return re.sub(r"[_\W]", "", path.rpartition(".")[2]).lower()


def compare_files(old: dict[str, dict[int, int]], new: dict[str, dict[int, int]], old_n: int, new_n: int, least: float = 0.6) -> list[tuple[str, str, str | None]]:
    """(field, change, former path of a rename) from what ingestion typed or rescued of a file and of its predecessor."""
    count = lambda f: sum(f.get(_TYPE + i, 0) for i in range(len(TYPES)))
    kind = lambda f: max(range(len(TYPES)), key=lambda i: (f.get(_TYPE + i, 0), -i))
    before = {p: f for p, f in old.items() if count(f) * 10 >= old_n}
    after = {p: f for p, f in new.items() if count(f) * 10 >= new_n}
    gone, came = sorted(set(before) - set(after)), sorted(set(after) - set(before))
    pairs = []
    for a in gone:
        for b in came:
            if kind(before[a]) != kind(after[b]):
                continue
            x, y = count(before[a]) / old_n, count(after[b]) / new_n
            same_parent = a.rpartition(".")[0] == b.rpartition(".")[0]
            like = content_similarity(before[a], after[b])
            named = _bare(a) == _bare(b)
            if like >= (least if same_parent else 0.85) and (min(x, y) / max(x, y) >= 0.4 or named) or named and same_parent and like >= 0.3:
                pairs.append((-(like + 0.15 * same_parent + 0.3 * named + 0.1 * min(x, y) / max(x, y)), a, b))
    out, used = [], set()
    for _, a, b in sorted(pairs):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((b, "renamed", a))
    out += [(p, "removed", None) for p in gone if p not in used] + [(p, "added", None) for p in came if p not in used]
    out += [(p, "retyped", None) for p in sorted(set(before) & set(after)) if kind(before[p]) != kind(after[p])]
    return out


def _report(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    sides: dict[str, dict[str, dict[int, int]]] = {"old": {}, "new": {}}
    n = {"old": 0, "new": 0}
    for r in rows:
        counters = dict(zip(r["counters"], r["ns"]))
        if r["path"] == "":
            n[r["side"]] = counters.get(_RECORDS, 0)
        else:
            sides[r["side"]][r["path"]] = counters
    found = compare_files(sides["old"], sides["new"], n["old"], n["new"]) if n["old"] and n["new"] else []
    first = rows[0]
    column = lambda i: pa.array([f[i] for f in found], pa.string())
    return pa.table({"client_id": pa.array([first["clientId"]] * len(found), pa.string()), "file_name": pa.array([first["fileName"]] * len(found), pa.string()), "field": column(0), "change": column(1), "former": column(2)})


def schema_changes(raw: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """client_id, file_name, field, change: how each file differs from the client's preceding one."""
    return traced_changes(raw, target).drop("former")


def traced_changes(raw: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """The same with `former`, the path that a renamed field had before."""
    counters = file_profiles(raw, target)
    file = ["clientId", "file_seq", "fileName"]
    fields = stored(counters.groupBy(*file, "path").agg(F.collect_list(F.struct("counter", "n")).alias("c")).select(*file, "path", F.col("c.counter").alias("counters"), F.col("c.n").alias("ns")), "profiles")
    w = Window.partitionBy("clientId").orderBy("file_seq", "fileName")
    # Only files go through the window, not their records.
    files = raw.select("clientId", F.col("file_seq").cast("int").alias("file_seq"), "fileName").distinct()
    nexts = files.select(*file, F.lead("file_seq").over(w).alias("next_seq"), F.lead("fileName").over(w).alias("next_name")).filter("next_name is not null")
    on = [F.col("f.clientId").eqNullSafe(F.col("g.clientId")), F.col("f.file_seq").eqNullSafe(F.col("g.file_seq")), F.col("f.fileName").eqNullSafe(F.col("g.fileName"))]
    old = fields.alias("f").join(nexts.alias("g"), on).select("f.clientId", F.col("g.next_seq").alias("file_seq"), F.col("g.next_name").alias("fileName"), "f.path", "f.counters", "f.ns", F.lit("old").alias("side"))
    new = fields.withColumn("side", F.lit("new"))
    return old.unionByName(new).groupBy(*file).applyInArrow(_report, "client_id STRING, file_name STRING, field STRING, change STRING, former STRING")


def approvals(renames: list[tuple[str, str, int]], target: dict[str, str] | None = None) -> dict[str, str]:
    """Rescued path and target path, from (former path, new path, files) of the report's renames.

    A path stands for the target path that renames link it to, in either direction, by the strongest chain (the link of the
    fewest files counts, then the shorter chain, then the name). Target paths stand for themselves, for values of another type.
    """
    own = target or TARGET
    links: dict[str, Counter] = {}
    for a, b, n in renames:
        links.setdefault(a, Counter())[b] += n
        links.setdefault(b, Counter())[a] += n
    best: dict[str, tuple] = {}  # of each path: (-weakest link, length, target)
    queue = [(-math.inf, 0, t, t) for t in own]
    heapq.heapify(queue)
    while queue:
        weak, length, t, path = heapq.heappop(queue)
        if path in best:
            continue
        best[path] = (weak, length, t)
        for other, n in links.get(path, {}).items():
            if other not in best and other not in own:
                heapq.heappush(queue, (max(weak, -n), length + 1, t, other))
    return {path: t for path, (_, _, t) in best.items()}


def consistent_events(raw: DataFrame, approved: dict[str, str] | None = None) -> DataFrame:
    """One table of all files: ingested, then promoted. Without a list, the renames that the change report finds are
    approved: their rescued values are replayed into the columns that the fields had."""
    if approved is None:
        counted = traced_changes(raw).filter("change = 'renamed'").groupBy("former", "field").agg(F.count("*").alias("n"))
        approved = approvals([(r["former"], r["field"], r["n"]) for r in counted.collect()])  # pairs of paths, as many as a schema has
    return promote(ingest(raw), approved)

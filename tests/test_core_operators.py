"""Core operators on small fixtures: brute force, edge cases, streams, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelode.functions import metrics, text
from tracelode.functions.instants import instant_micros
from tracelode.operators import bootstrap, delivery_index, episodes, schema_drift, search
from tracelode.sources import jsonl

BUNDLE = "ingest_seq long, teamId string, sessionId string, contentSha256 string, receivedAtUtc string, duplicate boolean, key string, rank string"


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2026-01-01T00:00:00Z", 1767225600000000), ("2026-01-01T02:00:00.5+02:00", 1767225600500000), ("2026-01-01T00:00:00.000001Z", 1767225600000001), ("n/a", None), ("", None), (None, None), ("12:30", None), ("Invalid Date", None)],
)
def test_instants(spark, raw, want):
    assert one(spark, instant_micros, raw) == want


def test_text_functions(spark):
    assert one(spark, text.normalize, " Run 12 of  abcdef0123 v2 ") == "run <num> of <hex> v2"
    assert one(spark, text.tokens, "A src/x.ts -> tool_a") == ["src/x.ts", "tool_a"]
    assert one(spark, text.error_signatures, "ok\nError: no 5\n Error: no 6 \nfine") == ["error: no <num>"]
    assert one(spark, text.file_paths, "see src/a/b.py and src/a/b.py, lib/c.ts") == ["src/a/b.py", "lib/c.ts"]
    assert one(spark, text.fnv1a32, "actor-1") == 4272952780
    assert one(spark, text.slug, "  Fix: A/B  ") == "fix-a-b"
    assert one(spark, lambda c: text.session_part(c, 2), " SWE::Repo__x-1::off ") == "repo__x-1"
    assert one(spark, lambda c: text.session_part(c, 2), "a::b") is None
    many = [f"t{i}" for i in range(200)]
    got = one(spark, text.bounded_terms, many, "array<string>")
    assert got[:96] == many[:96] and got[96:] == many[-32:]
    assert one(spark, text.bounded_terms, ["a", "a"], "array<string>") == ["a", "a"]


def test_path_counts_has_all_paths(spark, tmp_path):
    from tracelode.plans import catalog

    docs = [(1, " ".join(f"src/d{i}/f.py" for i in range(1500))), (2, "src/d1499/f.py")]
    cols = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([(*d, "en", "s") for d in docs], cols).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.path: r.documents for r in catalog.queries()["path_counts"](spark, str(tmp_path)).collect()}
    assert len(got) == 1500 and got["src/d1499/f.py"] == 2


def test_ratios(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (10.0, 5.0), (4.0, 8.0)], "a double, b double")
    got = rows.select(metrics.relative_reduction(F.col("a"), F.col("b")).alias("r"), metrics.positive_ratio(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r.r, r.p) for r in got] == [(0.0, 1.0), (-1.0, float("inf")), (0.5, 2.0), (-1.0, 2.0)]


def brute_surplus(rows):
    best = {}
    for seq, team, session, sha, at, *_ in rows:
        if not (sha or "").strip():
            continue
        key = (team, session and session.strip(), sha.strip().lower())
        best.setdefault(key, []).append((at is None, at or "", seq))
    return sorted(s for v in best.values() for _, _, s in sorted(v)[1:])


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_delivery_index(spark, batches):
    rnd = random.Random(batches)
    rows = []
    for i in range(400):
        hot = rnd.random() < 0.33
        sha = "ab" * 32 if hot else f"{rnd.randrange(60):064x}"
        at = rnd.choice([None, f"2026-01-0{rnd.randrange(1, 9)}T00:00:00Z"])
        rows.append((i, rnd.choice(["t1", None]), rnd.choice(["s", " s "]), rnd.choice([sha, sha.upper()]), at, True, "x", "y"))
    rows.append((1000, "t1", "s", None, None, None, None, None))
    df = spark.createDataFrame(rows, BUNDLE)
    index = delivery_index.DeliveryIndex(spark, prefix_bits=2, fan=2)
    got = sorted(r[0] for r in delivery_index.surplus_deliveries(df, batches, index).collect())
    assert got == brute_surplus(rows)
    assert len(index.runs) == bin(batches).count("1")  # tiers of a fan of two: the binary digits of the number of runs


def test_delivery_index_replay_and_reopen(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, "t", "s", f"{rnd.randrange(30):064x}", rnd.choice([None, f"2026-01-0{rnd.randrange(1, 9)}T00:00:00Z"]), None, None, None) for i in range(120)]
    parts = [spark.createDataFrame(rows[i : i + 40], BUNDLE) for i in (0, 40, 80)]
    seqs = lambda df: sorted(r[0] for r in df.collect())
    path = str(tmp_path / "index")
    index = delivery_index.DeliveryIndex(spark, path, prefix_bits=2, fan=2)
    first = [seqs(index.offer(p)) for p in parts[:2]]
    index = delivery_index.DeliveryIndex(spark, path, fan=2)  # opened again: bits, runs and verdicts are those it had
    assert index.bits == 2 and sorted(index.batches) == [0, 1]
    assert seqs(index.offer(parts[1], 1)) == first[1]
    last = seqs(index.offer(parts[2]))
    assert sorted({*first[0], *first[1], *last}) == brute_surplus(rows)
    again = seqs(index.offer(parts[2], 99))  # the same rows under another number: none of the kept ones is lost
    kept = set(range(120)) - set(brute_surplus(rows))
    assert not kept & set(again)


def test_delivery_batches_stay_whole(spark):
    cols = "ingest_seq long, batchId string, teamId string, sessionId string, contentSha256 string, receivedAtUtc string"
    rows = [(i, None if i % 11 == 0 else f"b{i % 7}", "t", "s", f"{i % 13:064x}", f"2026-01-0{1 + i % 5}T00:00:00Z") for i in range(90)]
    got = sorted(r[0] for r in delivery_index.surplus_deliveries(spark.createDataFrame(rows, cols), 4).collect())
    assert got == brute_surplus([(r[0], *r[2:]) for r in rows])


def test_delivery_index_empty_and_all_once(spark):
    empty = spark.createDataFrame([], BUNDLE)
    assert delivery_index.surplus_deliveries(empty).count() == 0
    single = spark.createDataFrame([(1, "t", "s", "aa", "bad", None, None, None)], BUNDLE)
    assert delivery_index.kept_deliveries(single).count() == 1


def test_prefix_bits():
    assert delivery_index.prefix_bits_for(0) == 3 and delivery_index.prefix_bits_for(10**10) == 16
    with pytest.raises(ValueError):
        delivery_index.DeliveryIndex(None, "x", 99)


RAW = "record_no long, clientId string, fileName string, file_seq int, schemaVersion string, line string, path string, n long"


def drift(spark, files):
    rows = [(i, "c", f"f{s}", s, None, line, "clash", 1) for i, (s, line) in enumerate((s, x) for s, lines in files for x in lines)]
    return sorted((r.file_name, r.field, r.change) for r in schema_drift.schema_changes(spark.createDataFrame(rows, RAW)).collect())


def test_schema_changes(spark):
    a = [json.dumps({"id": f"ev-{i:04x}ab12", "agentId": f"agent-{w}", "n": i, "gone": True, "p": {"text": "hello you"}}) for i, w in enumerate("kotu felo drun kotu felo".split())]
    b = [json.dumps({"id": f"ev-{i:04x}cd34", "agent_id": f"agent-{w}", "n": str(i), "list": [1], "p": json.dumps({"text": "hello all"})}) for i, w in enumerate("felo kotu drun felo kotu".split())]
    got = drift(spark, [(1, [*a, "", None, "[1]", "{broken", '"text"']), (3, b)])
    assert got == [("f3", "agent_id", "renamed"), ("f3", "gone", "removed"), ("f3", "list", "added"), ("f3", "n", "retyped")]


def test_profiles_read_whole_texts(spark):
    head = " ".join(f"word{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(60))
    for filler in (head, head + " " + "x" * 2500):  # behind the 40th word, the 200th and the 2,000th character
        text = lambda words, i: f"{filler}\n" + "".join(f"{w} = {i + k};\n" for k, w in enumerate(words.split() * 9))
        ours, theirs = (lambda i: text("felo drun kotu", i)), (lambda i: text("mira <sapo> (lenu) vako", i))
        old = [json.dumps({"id": "x", "out": ours(i)}) for i in range(5)]
        new = [json.dumps({"id": "x", "aa": theirs(i), "bb": ours(i)}) for i in range(5)]
        assert drift(spark, [(1, old), (2, new)]) == [("f2", "aa", "added"), ("f2", "bb", "renamed")]


def test_schema_share_of_a_tenth(spark):
    base = [json.dumps({"id": "x"})] * 20
    rare, tenth = json.dumps({"id": "x", "stray": 1}), json.dumps({"id": "x", "field": 1})
    assert drift(spark, [(1, base), (2, [*base[:19], rare])]) == []
    assert drift(spark, [(1, base), (2, [*base[:18], tenth, tenth])]) == [("f2", "field", "added")]
    assert drift(spark, [(1, [])]) == []


def test_ingest_and_promote(spark):
    lines = [json.dumps({"id": "e1", "type": "x", "payload": {"isError": True}, "odd": 1}), json.dumps({"event_id": "e2", "payload": {"isError": "false", "exitCode": "bad"}}), "nonsense"]
    raw = spark.createDataFrame([(i, "c", "f", 1, None, x, None, None) for i, x in enumerate(lines)], RAW)
    first = {r.record_no: r for r in schema_drift.ingest(raw).collect()}
    assert set(first) == {0, 1} and first[0].payload_isError is True and first[1].id is None
    same = {p: p for p in schema_drift.TARGET}
    got = {r.record_no: r for r in schema_drift.consistent_events(raw, same | {"event_id": "id"}).collect()}
    assert got[1].id == "e2" and got[1].payload_isError is False and json.loads(got[1]._rescued) == {"payload.exitCode": "bad"} and json.loads(got[0]._rescued) == {"odd": "1"}


def test_renames_of_the_report_are_promoted(spark):
    old = [json.dumps({"id": f"ev-{i}", "payload": {"command": f"make all{i} -j {i}"}}) for i in range(8)]
    new = [json.dumps({"eventKey": f"ev-{i}", "payload": {"cmdline": f"make all{i} -j {i}"}}) for i in range(8)]
    rows = [(i, "c", f"f{s}", s, None, x, None, None) for i, (s, x) in enumerate([(1, x) for x in old] + [(2, x) for x in new])]
    got = schema_drift.consistent_events(spark.createDataFrame(rows, RAW)).collect()
    assert len(got) == 16 and all(r.id and r.payload_command and r._rescued is None for r in got)
    assert schema_drift.approvals([("id", "a", 2), ("a", "b", 1), ("type", "b", 3), ("x", "y", 9)]) == {p: p for p in schema_drift.TARGET} | {"a": "id", "b": "type"}


def brute_episodes(rows):
    found = []
    by = {}
    for r in sorted(rows):
        by.setdefault(r[2], []).append(r)
    for s, rs in by.items():
        start = None
        for seq, _, _, fail, ok in rs:
            if ok:
                if start is not None:
                    found.append((s, start))
                start = None
            elif fail and start is None:
                start = seq
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_episodes_against_scan(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, i * 10, f"s{rnd.randrange(4)}", (f := rnd.random() < 0.3), not f and rnd.random() < 0.2) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, ts_ms long, session_id string, is_failure boolean, is_success boolean")
    extra = {"latency_ms": F.lit(1).cast("decimal(18,2)"), "tok_in": F.lit(1).cast("decimal(18,2)"), "tok_cached": F.lit(0).cast("decimal(18,2)"), "tok_out": F.lit(0).cast("decimal(18,2)"), "tok_think": F.lit(0).cast("decimal(18,2)"), "tok_write": F.lit(0).cast("decimal(18,2)"), "command": F.lit("c"), "output": F.lit(""), "model": F.lit("m")}
    got = sorted((r.session_id, r.start_seq) for r in episodes.extract_episodes(df.withColumns(extra)).collect())
    assert got == brute_episodes(rows)


def test_running_counts_in_any_partitioning(spark):
    from tracelode.operators import ordered

    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", "hot", "a", "b"]), rnd.random() < 0.4) for i in range(400)]
    want, seen = {}, {}
    for i, g, f in rows:
        n, k = seen.get(g, (0, 0))
        want[i] = (n, k)
        seen[g] = (n + 1, k + f)
    df = spark.createDataFrame(rows, "i long, g string, f boolean")
    for parts in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = {r.i: (r.n, r.k) for r in ordered.running(df, "g", ["i"], n=F.lit(1), k=F.col("f")).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
        assert got == want
    before = {r.i: r.p_i for r in ordered.predecessors(df, "g", ["i"], ["i"], "p_").collect()}
    assert all(before[i] == max(j for j, h, _ in rows if h == g and j < i) for i, g, _ in rows if want[i][0])


#: A tool result and what its failure is (the rule that comes first holds).
ISSUES = [
    ("git push", "connection timed out", "transient_external", 0.84), ("python scripts/search.py x", "Traceback (most recent call last):\n KeyError", "transient_external", 0.84), ("npm run eval:gate", "gate pass: false", "benign_probe", 0.80),
    ("gh pr checks 4", "no checks reported on the 'main' branch", "benign_probe", 0.78), ("cd a && rg foo", "", "benign_probe", 0.82), ("curl -s x", "404 page", "benign_probe", 0.82), ("make x || grep y z", "No matches found", "benign_probe", 0.82), ("curl x; make deploy", "not found", "unknown_failure", 0.35),
    ("tool --fast", "error: unknown option --fast", "command_mismatch", 0.90), ("node x", "TypeError: y", "missing_context", 0.78), ("ls nope", "ls: nope: No such file or directory", "missing_context", 0.78), ("gh repo view", "HTTP 403", "missing_context", 0.78),
    ("cat nope", "cat: nope: No such file or directory", "environment_mismatch", 0.86), ("foo", "bash: foo: command not found", "environment_mismatch", 0.86), ("make", "", "environment_mismatch", 0.55), ("make", "(no output) exit 2", "environment_mismatch", 0.55), ("make", "3 tests red", "unknown_failure", 0.35), ("", "", "environment_mismatch", 0.55),
]


def test_issue_classifier(spark):
    from tracelode.operators import issues

    rows = spark.createDataFrame([(i, c, o) for i, (c, o, _, _) in enumerate(ISSUES)], "i int, c string, o string")
    got = {r.i: r.x for r in rows.select("i", issues.classify(F.col("c"), F.col("o")).alias("x")).collect()}
    for i, (c, o, kind, confidence) in enumerate(ISSUES):
        assert (got[i].kind, got[i].confidence, got[i].harmful, got[i].abstained) == (kind, confidence, kind in issues.HARMFUL, kind == "unknown_failure"), (c, o)


def test_first_events_are_the_evidence(spark):
    from tracelode.operators import mining

    arcs = spark.createDataFrame([("s", i, i + 1, "f", "g") for i in range(0, 40, 2)] + [("s", 90, 91, "h", "g")], "session_id string, failure_seq long, success_seq long, failure_sig string, success_sig string")
    got = {r.failure_sig: r.evidence for r in mining.evidence(arcs).collect()}
    assert got == {"f": list(range(8)), "h": [90, 91]}


def test_bootstrap_draws(spark):
    state, states = 31, []
    for _ in range(50):
        state = (state * 1664525 + 1013904223) % 2**32
        states.append(state)
    assert [bootstrap.jump(31, k) for k in range(1, 51)] == states
    pairs = spark.createDataFrame([(1, 4, 2), (2, 6, 6), (3, 2, 1)], "o int, off_x int, on_x int")
    r = bootstrap.bootstrap_reductions(pairs, ["x"], "o", samples=200).first()
    off, on, got, s = [4, 6, 2], [2, 6, 1], [], 31
    for _ in range(200):
        a = b = 0
        for _ in range(3):
            s = (s * 1664525 + 1013904223) % 2**32
            p = s * 3 // 2**32
            a, b = a + off[p], b + on[p]
        got.append((a - b) / a)
    got.sort()
    mid = (got[99] + got[100]) / 2
    assert abs(r.median - mid) < 1e-9 and r.low <= r.median <= r.high
    assert bootstrap.bootstrap_reductions(pairs.limit(0), ["x"], "o").count() == 0


def test_fusion_rejects_weights(spark):
    with pytest.raises(ValueError):
        search.fuse(None, None, (0.0, 1.0))


def write_lines(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def event(i, session="s1", kind="tool_result", **payload):
    return json.dumps({"id": f"e{i}", "timestamp": f"2026-01-01T00:00:{i:02d}Z", "sessionId": session, "harness": "h", "scope": "team", "type": kind, "payload": payload or {"text": "x"}})


def test_jsonl_sources(spark, tmp_path):
    write_lines(tmp_path / "a/s1.jsonl", [event(1), "", "broken{", "[1]", event(2)])
    write_lines(tmp_path / "b/s2.JSONL", ['{"type":"session","id":"x"}', json.dumps({"id": 5, "payload": {}})])
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert sorted(r.id for r in jsonl.trace_events(lines).collect()) == ["e1", "e2"]
    assert sorted(r.format for r in jsonl.file_formats(lines).collect()) == ["session", "trace"]
    assert jsonl.read_lines(spark, str(tmp_path), ["s1"]).select("file").distinct().count() == 1
    assert [r.id for r in jsonl.query(jsonl.trace_events(lines), limit=1).collect()] == ["e1"]
    jsonl.write_events(jsonl.trace_events(lines).drop("file"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_raw_sessions(spark, tmp_path):
    msg = lambda t, **m: json.dumps({"type": "message", "timestamp": f"2026-01-01T00:00:{t:02d}Z", "message": m})
    call = lambda i, c: {"type": "toolCall", "id": i, "name": "bash", "arguments": {"command": c}}
    lines = [
        msg(1, role="user", content=[{"type": "text", "text": "go"}]),
        msg(3, role="assistant", content=[call("c1", "ls"), call("c2", "pwd")], usage={"input": 10, "output": 4}),
        msg(4, role="toolResult", toolCallId="c1", content=[{"type": "text", "text": " ok "}]),
        msg(7, role="toolResult", toolCallId="c2", isError=True, content=[]),
        msg(9, role="toolResult", toolCallId="zz", content=[]),
    ]
    df = spark.createDataFrame([(i, x, "f") for i, x in enumerate(lines)], "at long, value string, file string")
    got = {r.tool_call_id: r for r in jsonl.session_events(df).collect()}
    assert set(got) == {"c1", "c2"}
    assert got["c1"].call_latency_ms == 1000 and got["c1"].tool_latency_ms == 1000 and got["c1"].tokens == 7 and got["c1"].output == "ok"
    assert got["c2"].is_error is True and got["c2"].tool_latency_ms == 4000


def test_session_models_and_names(spark):
    rows = [("a/s1.JSONL", 1, {"type": "session"}), ("a/s1.JSONL", 2, {"type": "message", "message": {"provider": "p", "model": " m1 "}}), ("a/s1.JSONL", 3, {"type": "model_change", "modelId": "m2"}), ("b/s1.jsonl", 4, {"type": "model_change", "provider": "q", "modelId": "m2"}), ("c/s2.jsonl", 5, {"type": "message", "model": ""})]
    lines = spark.createDataFrame([(f, i, json.dumps(o)) for f, i, o in rows], "file string, at long, value string")
    models = jsonl.file_models(lines)
    assert {r.file: r.model for r in models.collect()} == {"a/s1.JSONL": "p/m1", "b/s1.jsonl": "q/m2", "c/s2.jsonl": "unknown"}
    named = models.withColumn("session_id", jsonl.session_hint(F.col("file")))
    assert {r.session_id: r.model for r in jsonl.session_models(named).collect()} == {"s1": "mixed:p/m1|q/m2", "s2": "unknown"}


def test_shipping_is_idempotent(spark, tmp_path):
    write_lines(tmp_path / "in/s1.jsonl", [event(1)])
    write_lines(tmp_path / "in/s2.jsonl", [event(2)])
    ship = lambda **kw: jsonl.ship_sessions(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), **kw)
    assert ship(dry_run=True) == {"scanned": 2, "shipped": 2, "unchanged": 0}
    assert ship(most=1) == {"scanned": 2, "shipped": 1, "unchanged": 0}
    assert ship() == {"scanned": 2, "shipped": 1, "unchanged": 1} and ship()["shipped"] == 0
    write_lines(tmp_path / "in/s1.jsonl", [event(1), event(3)])
    assert ship()["shipped"] == 1
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.session_id for r in got.collect()) == ["s1", "s1", "s2"] and got.filter("sha2(body, 256) <> sha256").count() == 0


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([("/home/ann/x", None, "pairs,wall", 2)], "path string, empty string, failures string, pairs int")
    jsonl.write_report(report, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"path": "/home/ann/x", "empty": None, "failures": "pairs,wall", "pairs": 2}
    assert "- wall" in jsonl.memo("Gate", report) and "**hold**" in jsonl.memo("Gate", report)
    assert jsonl.published(report, ["path", "pairs", "none"]).first().asDict() == {"path": "~/x", "pairs": 2}


def test_reviews(spark):
    from tracelode.operators import review

    state, order = 7, list(range(10))
    for i in range(9, 0, -1):
        state = (state * 1664525 + 1013904223) % 2**32
        j = int(state / 2**32 * (i + 1))
        order[i], order[j] = order[j], order[i]
    assert review.shuffled(range(10), 7) == order and review.shuffled([], 1) == []
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else "c") for i in range(300)], "id long, kind string")
    got = review.stratified_sample(rows, "kind", "id", 24)
    assert len(set(got)) == 24 and sum(i % 3 == 0 and i < 30 for i in got) == 8 and got == review.stratified_sample(rows.repartition(7), "kind", "id", 24)
    assert sorted(review.stratified_sample(rows.limit(5), "kind", "id", 24)) == [0, 1, 2, 3, 4]
    both = review.dual_assignment(range(20))
    assert sum(len(v) == 2 for v in both.values()) == 2 and sum(v == ("a",) for v in both.values()) == 9
    with pytest.raises(ValueError):
        review.require_unique(spark.createDataFrame([(1,), (1,)], "id long"), "id")


def test_streams(spark, tmp_path):
    from tracelode.streaming import ingest

    write_lines(tmp_path / "in/s1.jsonl", [event(1, kind="tool_call", toolCallId="k"), event(2, toolCallId="k"), "junk"])
    q = ingest.calls_with_results(ingest.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select * from joined").count() == 1
    w = ingest.failure_windows(ingest.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert spark.sql("select sum(results) from windows").first()[0] == 1


def test_bundle_stream_sink(spark, tmp_path):
    from tracelode.streaming import ingest

    index = delivery_index.DeliveryIndex(spark, prefix_bits=1)
    sink = ingest.bundle_sink(index, str(tmp_path))
    row = lambda i, at, sha="aa": (i, "t", "s", sha, at, None, None, None)
    batches = [[row(1, "2026-01-02T00:00:00Z"), row(2, "2026-01-03T00:00:00Z")], [row(3, "2026-01-01T00:00:00Z"), row(4, None, "bb")], [row(5, "2026-01-01T00:00:00Z", "bb")]]
    kept = lambda: sorted(r.ingest_seq for r in spark.read.parquet(f"{tmp_path}/kept").collect())
    want = [[1], [3, 4], [3, 5]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # every batch is run again, as after a failure
            sink(spark.createDataFrame(rows, BUNDLE), n)
            assert kept() == want[n]
    sink(spark.createDataFrame(batches[0], BUNDLE), 0)
    assert kept() == [3, 5]
    lost = [r.ingest_seq for r in spark.read.parquet(f"{tmp_path}/surplus").collect()]
    assert sorted(lost) == [1, 2, 4]

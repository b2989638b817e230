"""The llm operators on small fixtures: brute force, edge cases, round trips."""

import json
import random
from collections import Counter
import unicodedata
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import conversations, leaks, overlap, personal, runs, splits, tokens

EVENT = "ingest_seq long, id string, timestamp string, sessionId string, type string, payload string, metrics struct<outcome: string>, extra string, ts string, session_id string"
EPISODE = "episode_no long, familySignature string, sessionId string, split string, source string, cls string, words string"
DOC = "doc_id long, text string, source string, ids string, kind string"


def event(i, session, text, kind="tool_result", command="make x", at=None, outcome=None, payload="auto", id=None, error=None):
    body = {"command": command, "text": text}
    if error is not None:
        body["isError"] = error
    return (i, id or f"e{i}", at or f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}Z", session, kind, json.dumps(body) if payload == "auto" else payload, (outcome,), "x", "clash", "clash")


def found_runs(spark, rows, **kw):
    df = spark.createDataFrame(rows, EVENT)
    return sorted((r.session_id, r.first_event_id, r.last_event_id, r.n_events) for r in runs.consecutive_runs(df, **{"min_length": 2, **kw}).collect())


def test_runs_mask_machine_values(spark):
    rows = [
        event(1, "a", "4 passed in 5.2s"), event(2, "a", "4  passed\nin 17.03s"), event(3, "a", "5 passed in 5.2s"),
        event(4, "a", "x", kind="user_input"), event(5, "a", "5 passed in 1.0s", error="true"), event(6, "a", "5 passed in 1.0s", error=True),
        event(7, "a", "make[12]: *** pid 77 at 10:11:12 /tmp/wk-ab12cd34 3e90b374-9dbb-e719-4359-1101cf9387d6", outcome="failure"),
        event(8, "a", "make[99]: *** pid 1 at 01:02:03 /tmp/run-0011ffee 86c8c089-6b19-3d46-4c04-4f7ec3dd7888", error=True),
        event(9, "b", None), event(10, "b", "", payload=None), event(11, "b", "", command=""), event(12, None, "z"), event(13, "  ", "z"), event(14, "b", "", command="", at="n/a"),
    ]
    assert found_runs(spark, rows) == [("a", "e1", "e2", 2), ("a", "e3", "e5", 2), ("a", "e7", "e8", 2), ("b", "e10", "e11", 2)]


def test_runs_redelivery_and_order(spark):
    rows = [event(5, "s", "a", at="2026-01-01T10:00:00Z"), event(6, "s", "a", at="2026-01-01T11:00:00+02:00"), event(7, "s", "b", at="2026-01-01T09:30:00Z"), event(9, "s", "b", id="e5"), event(8, "s", "a", at="2026-01-01T10:00:00Z")]
    assert found_runs(spark, rows) == [("s", "e5", "e8", 2)]
    assert found_runs(spark, []) == []


@pytest.mark.parametrize("seed", range(2))
def test_runs_against_scan_with_a_hot_session(spark, seed):
    rnd = random.Random(seed)
    rows, state = [], "a"
    for i in range(600):
        state = state if rnd.random() < 0.6 else rnd.choice("abc")
        rows.append(event(i, "hot" if rnd.random() < 0.5 else f"s{rnd.randrange(5)}", state))
    want = []
    for s in {r[3] for r in rows}:
        for _, g in groupby([r for r in rows if r[3] == s], key=lambda r: r[5]):
            g = list(g)
            if len(g) > 1:
                want.append((s, g[0][1], g[-1][1], len(g)))
    assert found_runs(spark, rows) == sorted(want)


def test_agglomerate_gap_and_order():
    t = np.array([0, 1, 2, 50, 51])
    same = np.array([1.0, 0.9, 1.0, 1.0])
    assert runs.agglomerate(same, t, t, 0.9, None).tolist() == [0, 0, 0, 0, 0]
    assert runs.agglomerate(same, t, t, 0.9, 10).tolist() == [0, 0, 0, 3, 3]
    assert runs.agglomerate(same, t, t, 0.95, None).tolist() == [0, 0, 2, 2, 2]


def chat(i, session, role, text="hi", payload="auto"):
    return event(i, session, text, kind="user_input" if role == "u" else "assistant_output", command=None, payload=payload)


def test_conversations(spark):
    rows, i = [], 0
    for session, roles in {"ok": "uaauA".lower() + "", "first": "aua", "double": "uua", "open": "uau", "hot": "ua" * 150}.items():
        for r in roles:
            i += 1
            rows.append(chat(i, session, r))
    extra = [chat(900, "blank", "u", "  \n"), chat(901, "broken", "u"), chat(902, "broken", "a", payload='{"text":"x'), chat(903, "null", "u", payload=None), chat(904, "list", "u", payload='{"content":[{"type":"text","text":"q"}]}'), chat(905, "list", "a", payload='{"message":"r"}'), chat(906, "chunk", "u", payload='{"content":[]}'), chat(907, "empty", "u", payload=""), chat(908, None, "u")]
    df = spark.createDataFrame(rows + extra, EVENT)
    verdict = {r.session_id: r for r in conversations.session_verdicts(df).collect()}
    assert {s for s, r in verdict.items() if not r.dropped} == {"ok", "hot", "list"}
    assert verdict["broken"].broken and verdict["first"].starts_with_assistant and verdict["double"].unanswered == 1 and verdict["blank"].messages == 0
    turns = conversations.conversations(df, gap_seconds=3600).filter("session_id = 'hot'").orderBy("position").collect()
    assert [t.role for t in turns] == ["user", "assistant"] * 150 and [t.position for t in turns] == list(range(300))
    assert conversations.session_verdicts(df.limit(0)).count() == 0


def test_segments_do_not_depend_on_partitions(spark):
    rnd = random.Random(6)
    rows, at = [], {"hot": 0, "b": 0}
    for i in range(300):
        s = "hot" if rnd.random() < 0.8 else "b"
        at[s] += 5000 if rnd.random() < 0.05 else 20
        stamp = f"2026-01-{1 + at[s] // 86400:02d}T{at[s] // 3600 % 24:02d}:{at[s] // 60 % 60:02d}:{at[s] % 60:02d}Z"
        rows.append(event(i, s, "hi", kind="user_input" if i % 2 == 0 else "assistant_output", at=stamp))
    want = {s: 1 + sum(1 for a, b in zip(t, t[1:]) if b - a > 3600e6) for s in at for t in [[r for r in sorted(conv_time(r) for r in rows if r[3] == s)]]}
    df, got = spark.createDataFrame(rows, EVENT), []
    for parts in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got.append(sorted(tuple(r) for r in conversations.session_verdicts(df, gap_seconds=3600).collect()))
        turns = conversations.sorted_turns(df)
        got.append(conversations.calibrated_gap_us(turns, 0.5, 0.0))
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert got[0] == got[2] and got[1] == got[3] == 20e6
    assert {r[0]: r[2] for r in got[0]} == want


def conv_time(row):
    from datetime import datetime

    return datetime.fromisoformat(row[2].replace("Z", "+00:00")).timestamp() * 1e6


def brute_pairs(rows):
    seen = {}
    for no, sig, _, split, *_ in rows:
        seen[no] = (sig, split)
    words = lambda s: [w for w in s.lower().split() if w]

    def ed(a, b):
        row = list(range(len(b) + 1))
        for i, w in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, v in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (w != v))
        return row[-1]

    ok = {k: v for k, v in seen.items() if v[0] and v[0].strip() and v[0] != "recovery"}
    return sorted((a, b) for a in ok for b in ok if a < b and (ok[a][1] == "train") != (ok[b][1] == "train") and ed(words(ok[a][0]), words(ok[b][0])) <= 2)


@pytest.mark.parametrize(("seed", "hot"), [(0, 4096), (1, 1), (2, 0)])
def test_overlap_against_all_pairs(spark, seed, hot):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 9))] for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            at, do = rnd.randrange(len(w) + 1), rnd.random()
            w[at : at + (do < 0.6)] = [] if do < 0.3 else [f"w{rnd.randrange(30)}"]
        rows.append((i, " ".join(w), None, rnd.choice(["train", "train", "validation", "test"]), "s", None, None))
    rows += [(900, None, None, "train", "s", None, None), (901, " ", None, "test", "s", None, None), (902, "recovery", None, "train", "s", None, None), (903, "recovery", None, "test", "s", None, None), rows[0], rows[1]]
    df = spark.createDataFrame(rows, EPISODE)
    sigs = overlap.classes(overlap.signed(df)).cache()
    near = {tuple(r) for r in overlap.near_classes(sigs, hot_pairs=hot).collect()}
    assert near == {tuple(r) for r in overlap.near_classes(sigs, hot_pairs=10**9).collect()}
    assert sorted(tuple(r) for r in overlap.cross_split_pairs(df).collect()) == brute_pairs(rows)


def test_short_signatures_are_joined_in_proportion(spark):
    counts = []
    for n in (2000, 4000, 8000):
        rnd = random.Random(n)
        rows = [(i, " ".join(f"w{rnd.randrange(n)}" for _ in range(3)), None, ("train", "test")[i % 2], "s", None, None) for i in range(n)]
        sigs = overlap.classes(overlap.signed(spark.createDataFrame(rows, EPISODE))).cache()
        counts.append(overlap.candidates(sigs).count())
    assert counts[0] < 20 * 2000 and counts[1] < 3 * counts[0] and counts[2] < 3 * counts[1]


def test_word_distance(spark):
    rnd = random.Random(4)
    rows = [([f"w{rnd.randrange(6)}" for _ in range(rnd.randrange(7))], [f"w{rnd.randrange(6)}" for _ in range(rnd.randrange(7))]) for _ in range(300)]
    rows += [([f"x{i}" for i in range(300)], [f"x{i}" for i in range(1, 301)]), ([], [])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", overlap.word_distance("a", "b").alias("d")).collect()

    def ed(a, b):
        row = list(range(len(b) + 1))
        for i, w in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, v in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (w != v))
        return row[-1]

    assert all(r.d == (d if (d := ed(r.a, r.b)) <= 2 else -1) for r in got)


def test_overlap_masks_and_empty(spark):
    rows = [(1, 'Go "a/b.py" at x:<num> (<hex> z) - now', None, "train", "s", None, None), (2, "go a/b.py AT x:12 (0123456789abcdef z) now", None, "test", "t", None, None)]
    df = spark.createDataFrame(rows, EPISODE)
    assert [tuple(r) for r in overlap.cross_split_pairs(df).collect()] == [(1, 2)]
    assert [tuple(r) for r in overlap.overlap_report(df).collect()] == [("test", "t", 1, 1, 0)]
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def brute_groups(rows):
    keys, seen = {}, {}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for no, f, s, *_ in rows:
        k = []
        f, s = " ".join((f or "").lower().split()), (s or "").strip().lower()
        if f and f != "recovery":
            k.append("f" + f)
        if s:
            k.append("s" + s)
            if len(p := s.split("::")) in (3, 4) and p[1]:
                k.append("i" + p[1])
        for x in k:
            a, b = find(no), find(x)
            parent[a] = b
        seen[no] = keys
    groups = {}
    for no in seen:
        groups.setdefault(find(no), []).append(no)
    return sorted((n, min(g)) for g in groups.values() if len(g) > 1 for n in g)


@pytest.mark.parametrize("seed", range(2))
def test_components_and_splits(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(200):
        f = rnd.choice([None, "", "recovery", "Hot  family", *(f"F{rnd.randrange(80)}" for _ in range(6))])
        s = rnd.choice([None, "  ", f" S{rnd.randrange(90)} ", f"swe::T{rnd.randrange(30)}::on", f"swe::t{rnd.randrange(30)}::off::r1"])
        rows.append((i, f, s, "train", "x", None, None))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, EPISODE)
    got = sorted((r.episode_no, r.group_no) for r in splits.components(df).filter("members > 1").collect())
    assert got == brute_groups(rows)
    placed = splits.assign_splits(df).collect()
    assert len(placed) == 200 and len({r.group_no for r in placed}) == len({(r.group_no, r.split) for r in placed})
    assert splits.components(df.limit(0)).count() == 0


def test_split_proportions(spark):
    rows = [(i, f"f{i // 2}", None, None, None, None, None) for i in range(2000)]
    counts = {r.split: r["count"] for r in splits.assign_splits(spark.createDataFrame(rows, EPISODE)).groupBy("split").count().collect()}
    assert abs(counts["train"] - 1600) <= 4 and abs(counts["validation"] - 200) <= 4 and abs(counts["test"] - 200) <= 4


TEXTS = [None, "", "   ", "Hello world", "<|endoftext|> it's 12345 naïve 😀👩‍👩‍👧\r\n\tx", "a" * 3000, "word " * 2000, "日本語のテキスト", "​﻿́é", "Hello world"]


def test_tokens_match_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokens.read_vocabulary()
    ref = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "s", "clash", None) for i, t in enumerate(TEXTS)], DOC)
    got = {r.doc_id: r.ids for r in tokens.encode_column(df.select("doc_id", "text", "ids")).collect()}
    assert got == {i: ref.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    back = lambda ids: b"".join(ref.decode_single_token_bytes(x) for x in ids).decode()
    assert all(back(got[i]) == (t or "") for i, t in enumerate(TEXTS))
    assert tokens.encode_column(df.limit(0).select("doc_id", "text")).count() == 0


def test_perfect_hash_is_minimal():
    words = {f"w{i}".encode(): i for i in range(5000)}
    table = tokens.PerfectHash(words)
    assert table.lookup(list(words)).tolist() == list(range(5000))
    assert (table.lookup([b"", b"no", b"w5000", b"w" * 999]) == -1).all()
    assert sorted(table.ids.tolist()) == list(range(5000))


ITEM = "item_id long, task_id string, split string, text string"


def test_leaks(spark):
    rnd = random.Random(5)
    name = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(4))
    sentence = lambda: f"The {name()} gate compares {name()} with {name()} by text, hence {name()} sorts before {name()} as soon as {name()} is empty."
    shared = "Run the verify command from the repository root and report its exit code before you make any change to the files there."
    items = [(i, f"t{i}", "test", " ".join([sentence(), shared, sentence(), sentence()])) for i in range(40)] + [(90, "t", "test", None), (91, "t", "test", " "), (92, "t", "test", "Too short to leak.")]
    text = dict((i, t) for i, _, _, t in items)
    w = text[3].split()
    noisy = [("zzz" if k % 11 == 5 else x) for k, x in enumerate(text[7].split())]
    docs = [
        (1, text[2].upper().replace(" ", "\n> ")), (2, " ".join(w[:20])), (3, " ".join(w[:12])), (4, shared), (5, f"filler words here {sentence()} {sentence()}"), (6, " ".join(noisy)), (7, None), (8, ""), (9, json.dumps({"note": text[11]})),
        (10, "x " * 4000 + " ".join(text[20].split()[:30]) + " y" * 4000), (11, text[2]), (11, text[2]),
    ]
    df = spark.createDataFrame([(d, t, "s", None, None) for d, t in docs], DOC)
    it = spark.createDataFrame(items, ITEM)
    got = {tuple(r) for r in leaks.leaked_items(df, it).collect()}
    assert got == {(1, 2), (2, 3), (6, 7), (9, 11), (10, 20), (11, 2)}
    sparse = it.withColumn("item_id", F.col("item_id") * 1_000_003)
    for words in (7 * 120, 100 * 120):
        assert {(d, i // 1_000_003) for d, i in leaks.leaked_items(df, sparse, block_words=words).collect()} == got
    assert leaks.leaked_items(df, it.limit(0)).count() == 0 and leaks.leaked_items(df.limit(0), it).count() == 0


def test_leaks_beside_better_alignments_that_fail(spark):
    rnd = random.Random(8)
    words = lambda n: ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(n)]
    shared = " ".join(words(34)).capitalize() + "."
    own = {i: [words(75), words(40)] for i in range(30)}
    items = [(i, "t", "test", " ".join(a).capitalize() + ". " + shared + " " + " ".join(b).capitalize() + ".") for i, (a, b) in own.items()]
    a = lambda i: own[i][0]
    docs = [
        (1, a(1)[:20] + a(1)[36:56]),  # two exact passages, 16 words left out between them
        (2, a(2)[:30] + a(2)[55:75] + words(5)), (3, a(3)[:30] + a(3)[52:75] + words(9)),
        (4, own[4][1][:20] + words(30) + shared.split()),  # an own passage and a longer common sentence
        (5, shared.split() + words(24) + a(5)[10:30]), (6, shared.split()), (7, a(7)[:10] + a(7)[40:50] + shared.split()),
        (11, a(12)[:22] + words(15) + shared.split() + words(15) + own[12][1][:22] + words(15) + shared.split()), (12, a(13)[:24] + shared.split()[:20] + words(6) + own[14][1][5:30]),
        (8, [x if k % 2 else "zz" for k, x in enumerate(a(8)[:70])]), (9, a(9)[:12] + words(30) + a(9)[40:52]), (10, a(10)[:12] + words(3) + own[11][1][:12]),
    ]
    df = spark.createDataFrame([(d, " ".join(x), "s", None, None) for d, x in docs], DOC)
    got = {tuple(r) for r in leaks.leaked_items(df, spark.createDataFrame(items, ITEM)).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (11, 12), (12, 13), (12, 14)}


def test_stretches_are_all_tried():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        n = int(rnd.integers(1, 60))
        hit, weight = (rnd.random(n) < rnd.choice([0.5, 0.7, 0.8])).astype(float), rnd.random(n)
        want = any(hit[x:y].sum() >= 0.75 * (y - x) - 1e-9 and (hit * weight)[x:y].sum() >= 0.65 * weight[x:y].sum() - 1e-9 for x in range(n) for y in range(x + 20, n + 1))
        assert leaks.holds(hit, weight, 20, 0.75, 0.65) == want


def test_wand_finds_what_exhaustive_scoring_finds():
    rnd = random.Random(1)
    vocab = [f"v{i}" for i in range(300)]
    items = {i: [rnd.choice(vocab[: 60 if rnd.random() < 0.5 else 300]) for _ in range(60)] for i in range(120)}
    df = Counter(w for x in items.values() for w in set(x))
    for k in range(200):
        if k % 100 == 0:
            index = leaks.ItemIndex(items, df, len(items), 60.0, blocks=15 if k else 512)
        terms = list({index.term[w] for w in (rnd.choice(vocab) for _ in range(40)) if w in index.term})
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.docs[t]] += index.impact[t]
        assert sorted(index.retrieve(terms)) == np.flatnonzero(score >= 1 + 1e-9).tolist() or np.any(np.abs(score - 1) < 1e-6)


ROSTER = "actorId string, displayName string, teamId string"
PEOPLE = [("a1", "Remax Krasova", "t"), ("a2", "Híbax Horekova", "t"), ("a3", "Dozol Lulmar", "t"), ("a4", "Nijen Flundmar", "t"), ("a5", "Hosyl Festanova", "t"), ("a6", "Wekrak Thurmar", "t"), ("a7", None, "t")]
TEXT = (
    "Thanks to Híbax S. Horekova for the trace. cc KRASOVA, REMAX, please rerun. Yesterday D. Lulmar and I watched.\n"
    "Harness Board shows git@forge.velm.example:kit/x.git and steps/fetch@v6. Mail <a.b+ci (at) mail (dot) tarvik (dot) example> or c_d@example.org.\n"
    "Call +44 20 7946 0826 or (600) 555-0170, 030/23125419, 01.99.00.17.04. Epoch 17165616564. Version 2.8.0178 on port 4000. Chunk 591-22-2343 of it.\n"
    "SSN 924 15 1641, Steuer-ID 08 135 747 712, passport: Q17239382, DNI 99384927-H.\n"
    "We met at Flat 14, 159 North Dastearais Ave after. Das Gerät steht in der Jufosdaweg 107a, 40211 Brelin. Le matériel est au 39 bis, avenue Heatamis, 40211 X. dirección: Avenida de Pubrurdis, 210"
)
WANT = {
    "name": {"Híbax S. Horekova", "KRASOVA, REMAX", "D. Lulmar"}, "email": {"a.b+ci (at) mail (dot) tarvik (dot) example", "c_d@example.org"}, "phone": {"+44 20 7946 0826", "(600) 555-0170", "030/23125419", "01.99.00.17.04"},
    "id_number": {"924 15 1641", "08 135 747 712", "Q17239382", "99384927-H"}, "address": {"Flat 14, 159 North Dastearais Ave", "Jufosdaweg 107a", "39 bis, avenue Heatamis", "Avenida de Pubrurdis, 210"},
}


def test_personal_details(spark):
    df = spark.createDataFrame([(1, TEXT + "\n" + TEXT, "s", None, "clash"), (2, None, "s", None, None), (3, "", "s", None, None), (4, " \n", "s", None, None), (5, "x " * 50_000, "s", None, None)], DOC)
    roster = spark.createDataFrame(PEOPLE, ROSTER)
    rows = personal.find_details(df, roster).collect()
    got = {}
    for r in rows:
        got.setdefault(r.kind, set()).add(r.found)
    assert got == WANT and len(rows) == sum(map(len, WANT.values()))
    clean = {r.doc_id: r.text for r in personal.redact(df, roster, "k").collect()}
    assert clean[2] is None and clean[3] == "" and not any(x in clean[1] for v in WANT.values() for x in v) and "[name: " in clean[1]
    assert personal.find_details(df.limit(0), roster).count() == 0 and personal.find_details(df, roster.limit(0)).filter("kind = 'email'").count() == 2


def test_roster_of_any_size(spark):
    docs = spark.createDataFrame([(1, TEXT, "s", None, None), (2, "cc Remax Krasova and Anna Festanova, please", "s", None, None), (3, None, "s", None, None), (3, "", "s", None, None), (None, "Thanks to Nijen Flundmar.", "s", None, None)], DOC)
    people = spark.createDataFrame([*PEOPLE, *[(f"b{i}", f"Vor{chr(97 + i)}x Mur{chr(97 + i)}kova", "t") for i in range(20)]], ROSTER)
    rows = lambda **kw: sorted((r.doc_id or -1, r.kind, r.found) for r in personal.find_details(docs, people, **kw).collect())
    assert rows(max_roster=3) == rows()
    texts = lambda **kw: sorted((r.doc_id or -1, r.text or "") for r in personal.redact(docs, people, "k", **kw).collect())
    assert texts(max_roster=3) == texts()
    with pytest.raises(ValueError):
        personal.redact(docs, people, "")


def test_surrogates_are_distinct_and_stable():
    lex = personal.Lexicon([p[1] for p in PEOPLE])
    text = "Thanks to Remax Krasova and thanks to R. Krasova. Frau Dozol Lulmar, +1 646-555-0145, +1 646-555-0146"
    a, b = (personal.redacted(text, lex, k) for k in (b"k1", b"k1"))
    assert a == b != personal.redacted(text, lex, b"k2")
    names = [x.split("]")[0] for x in a.split("[name: ")[1:]]
    assert names[0].split()[1] == names[1].split()[1] and names[2].split()[0] in personal.FEMALE and names[2].split()[1] != names[0].split()[1]
    phones = [x.split("]")[0] for x in a.split("[phone: ")[1:]]
    assert len(set(phones)) == 2 and all(p.startswith("+1 ") and len(p) == 15 for p in phones)


def test_people_of_one_initial_are_told_apart():
    lex = personal.Lexicon(["Hosyl Gesepova", "Hejek Gesepova", "Remax Krasova", "Иван Петров", "Ирина Петров", "Άννα Παππά", "محمد علي"])
    names = lambda text: [x.split("]")[0] for x in personal.redacted(text, lex, b"k").split("[name: ")[1:]]
    a, b, c, d = names("cc Hosyl Gesepova, please. cc Hejek Gesepova, please. cc H. Gesepova, please. cc GESEPOVA, HOSYL, please.")
    assert len({a.split()[-1], b.split()[-1], c.split()[-1]}) == 3 and d == ", ".join(reversed(a.upper().split()))
    assert names("cc H. Gesepova, please") == [c] and names("cc Hejek Gesepova, please") == [b]
    full, bare = names("cc Remax Krasova, please")[0].split(), names("cc R. Krasova, please")[0].split()
    assert bare == [full[0][0] + ".", full[1]]
    for text, script in (("cc Иван Петров, please", "CYRILLIC"), ("cc Ирина Петров, please", "CYRILLIC"), ("cc Άννα Παππά, please", "GREEK"), ("cc محمد علي, please", "ARABIC"), ("cc Remax Krasova, please", "LATIN")):
        (new,) = names(text)
        assert {unicodedata.name(c).split()[0] for c in new if c.isalpha()} == {script} and new not in text
    assert names("Frau Ирина Петров, cc Иван Петров, please")[0].split()[0] in personal.POOLS["CYRILLIC"][0]


def test_a_person_has_one_gender_in_all_documents(spark):
    people = [f"{g}{x} Zor{x}mar" for g, x in zip(["Pa", "Re", "Ti", "Ku", "Mu"] * 4, "bdfghjklmnpqrstvwxyz")]
    texts = [f"Frau {n} said no." for n in people] + [f"cc {n}, please." for n in people] * 2 + [f"Herr {people[0]} said no."] * 3 + [None]
    df = spark.createDataFrame([(k if k else None, t, "s", None, None) for k, t in enumerate(texts)], DOC)
    roster = spark.createDataFrame([("a", n, "t") for n in people], ROSTER)
    clean = {r.doc_id: r.text for r in personal.redact(df, roster, "k").collect()}
    assert len(clean) == len(texts)
    new = [clean[k or None].split("[name: ")[1].split("]")[0] for k in range(60)]
    assert new[:20] == new[20:40] == new[40:] and len(set(new)) == 20
    assert new[0].split()[0] in personal.MALE and all(x.split()[0] in personal.FEMALE for x in new[1:20])


def test_no_street_name_survives():
    lex = personal.Lexicon([])
    forms = {
        "Plaza Kaibremoick 87": ["kaibremoick"], "Calle de la Trisk, 5": ["trisk"], "AVENIDA DEL ZOLWICK 12": ["zolwick"], "Flat 12, 6 Feaganoa St": ["feaganoa"], "25 Upper Trylisuis Road": ["upper", "trylisuis"],
        "118 Roplo-Kwiick St, Apt 3": ["roplo", "kwiick"], "115 OLD SHYNDICK LANE": ["old ", "shyndick"], "97 chemin du Thondaen": ["thondaen"], "76 rue des Trearea": ["trearea"], "9, avenue de l'Ostéa, appt 4": ["ostéa"], "Miraengasse 140": ["mira"],
        "Jufosdaweg 107a, Whg 3": ["jufosda"], "KRASOISSTRASSE 4": ["krasois"], "Lulstr. 7": ["lul"], "12 Upper Street": ["upper"], "7 Holm Street": ["holm "],
    }
    for form, gone in forms.items():
        assert [form[a:b] for k, a, b in personal.details(form, lex) if k == "address"] == [form]
        for n in range(40):
            clean = personal.redacted(form + " then", lex, b"k%d" % n)
            assert clean.startswith("[address: ") and not any(x in clean.lower() for x in gone), (form, clean)
            assert clean.split(": ")[1].split("]")[0].isupper() == form.isupper()
    assert personal.redacted("Miraengasse 140", lex, b"k").split("gasse ")[1].rstrip("]").isdigit() and "rue des " in personal.redacted("76 rue des Trearea", lex, b"k")


def test_queries_are_listed(spark):
    from tracelode.llm import queries

    names = set(queries.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 6, 8, 9)} | {"p7_ids"} <= names
    small = queries.queries()["p7_ids"](spark, "/root/testdata/sf0.001")
    assert small.columns == ["doc_id", "ids"] and small.select(F.count("*")).first()[0] > 0

"""Operators that work in rounds or keep state, held against plain loops over random input."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import chunking, gates
from tidewell.operators import conflicts, consolidation, cover, promotion, sets, similar
from tidewell.operators.text_index import TextIndex
from tidewell.plans.trace import Trace
from tidewell.sources import trees
from tidewell.streaming import ingest, jobs, stateful


def clouds(rng, n, spread, d=12):
    """Vectors around a few centers, some of them copies, one of zeros."""
    centers = rng.normal(size=(4, d))
    out = [(centers[i % 4] + rng.normal(size=d) * spread).round(4).tolist() for i in range(n)]
    for i in range(0, n, 9):
        out[i] = out[(i + 4) % n]
    out[n // 2] = [0.0] * d
    return out


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def greedy(rows, near):
    """(centers, row -> first center) of a loop over the rows in their order."""
    centers, of = [], {}
    for r in rows:
        hit = next((c for c in centers if near(c, r)), None)
        if hit is None:
            centers.append(r)
        else:
            of[r] = hit
    return centers, of


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_dedup_is_the_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = clouds(rng, 60, 0.35)
    rows = [(f"r{i}", v, [0.9, 0.5, None][i % 3], i, "a" if i % 5 else "b") for i, v in enumerate(vectors)] + [("none", None, 0.9, 99, "a")]
    df = spark.createDataFrame(rows, "id string, vector array<double>, importance double, position int, batch string")
    got = {r["id"]: r for r in similar.batch_dedup(df, 0.93, ["batch"]).collect()}
    for batch in "ab":
        own = sorted((r for r in rows if r[4] == batch), key=lambda r: (-(r[2] if r[2] is not None else 0.5), r[3], r[0]))
        by = {r[0]: r[1] for r in own}
        kept, of = greedy([r[0] for r in own], lambda c, r: by[c] is not None and by[r] is not None and cos(by[c], by[r]) > 0.93)
        assert {i for i in by if got[i]["kept"]} == set(kept)
        assert {i: got[i]["like"] for i in by if not got[i]["kept"]} == of


def test_bands_reach_their_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    angle = math.acos(0.86)  # pairs just over the threshold
    twin = base * math.cos(angle) + other * math.sin(angle)
    df = spark.createDataFrame([(f"a{i:03}", v.tolist()) for i, v in enumerate(base)] + [(f"b{i:03}", v.tolist()) for i, v in enumerate(twin)], "id string, vector array<double>")
    every = np.concatenate([base, twin])
    truth = {tuple(sorted((("a" if i < 400 else "b") + f"{i % 400:03}", ("a" if j < 400 else "b") + f"{j % 400:03}"))) for i, j in zip(*np.nonzero(np.triu(every @ every.T >= 0.855, 1)))}
    for recall in (0.9, 0.99):
        found = similar.near_pairs(df, 0.855, recall=recall, block=64).collect()
        pairs = {(r["a"], r["b"]) for r in found}
        assert len(pairs) == len(found) and pairs <= truth and len(pairs) >= (recall - 0.04) * len(truth)
    bands, bits = similar.choose_bands(0.855, 0.99)
    assert 1 - (1 - (1 - math.acos(0.855) / math.pi) ** bits) ** bands >= 0.99


def test_large_buckets_are_cut_into_blocks(spark):
    rng = np.random.default_rng(4)
    center = rng.normal(size=16)
    rows = [(f"x{i:03}", (center + rng.normal(size=16) * 0.01).tolist()) for i in range(90)]
    found = similar.near_pairs(spark.createDataFrame(rows, "id string, vector array<double>"), 0.95, block=16).collect()
    assert len(found) == len({(r["a"], r["b"]) for r in found}) == 90 * 89 // 2


def plain_consolidation(rows, facts):
    """One run over (id, scope, category, vector, importance, accesses, place)."""
    out = {}
    for group in {(r[1], r[2]) for r in rows}:
        own = sorted((r for r in rows if (r[1], r[2]) == group), key=lambda r: (r[6], r[0]))
        by = {r[0]: r for r in own}
        score = lambda a, b: 1 / (2 - (1.0 if by[a][3] == by[b][3] and any(by[a][3]) else cos(by[a][3], by[b][3])))
        centers, of = greedy(list(by), lambda c, r: score(c, r) >= 0.82 - 1e-9)
        for seed in centers:
            members = [seed, *(r for r in by if of.get(r) == seed)]
            if len(members) < 2:
                continue
            worth = {m: round(by[m][4] * (1 + math.log1p(by[m][5])) * min(1.1, 1 + 0.06 * math.log1p(max((n for i, _, n in facts if i == m), default=0))), 9) for m in members}
            best = min(members, key=lambda m: (-worth[m], by[m][6], m))
            for m in members:
                a, b = ({f for i, f, _ in facts if i == x} for x in (m, best))
                alike = len(a & b) / len(a | b) if len(a) > 1 and len(b) > 1 else 0.0
                out[m] = (best, "canonical" if m == best else "merge" if round(score(m, best), 9) >= 0.92 or alike >= 0.5 else "link")
    return out


def test_consolidation_runs_to_a_fixed_point(spark):
    rng = np.random.default_rng(5)
    vectors = clouds(rng, 70, 0.42)
    rows = [(f"m{i:02}", f"s{i % 2}", "cases" if i % 3 else "events", v, round(0.3 + (i * 7 % 10) / 15, 3), i % 6, (i * 31) % 70) for i, v in enumerate(vectors)]
    facts = [(f"m{i:02}", f"f{(i + k * k) % 12}", 1 + i % 4) for i in range(0, 70, 2) for k in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "id string, scope string, category string, vector array<double>, importance double, accesses int, place int")
    known = spark.createDataFrame(facts, "id string, fact string, mentions int")
    facts = list({(i, f): (i, f, n) for i, f, n in facts}.values())
    one = {r["id"]: (r["canonical"], r["action"]) for r in consolidation.consolidate_once(df, known).collect()}
    assert one == plain_consolidation(rows, facts) and {"merge", "link", "canonical"} == {a for _, a in one.values()}
    want, left, run = {}, rows, 0
    while True:
        run += 1
        found = plain_consolidation(left, facts)
        gone = {m for m, (_, a) in found.items() if a == "merge"}
        want |= {m: (c, a, run) for m, (c, a) in found.items() if m in gone or not gone}
        if not gone:
            break
        left = [r for r in left if r[0] not in gone]
    assert {r["id"]: (r["canonical"], r["action"], r["run"]) for r in consolidation.consolidate(df, known).collect()} == want
    assert run > 2  # a merge opened the way for another one
    assert consolidation.consolidate_once(df.limit(0), known).count() == 0


def test_event_segments():
    s = chunking.Segmenter(300, 60)
    kinds = lambda text: [k for k, _ in s.segments(text)]
    assert s.segments(None) == [] and s.segments(" \n ") == [] and s.segments(" short ") == [("initial", "short")]
    talk = "word " * 20
    assert kinds(f"{talk}\n{talk}") == ["initial"]
    assert kinds(f"{talk}\nBy the way, {talk}") == ["topic_shift", "max_size"]
    assert kinds(f"{talk}\n另外 {talk}") == ["topic_shift", "max_size"]
    assert kinds(f"[用户] {talk}\n[助手] {talk}\n[用户] {talk}") == ["qa_boundary", "max_size"]
    assert kinds(f"{talk}\n2024-03-01 {talk}") == ["time_jump", "max_size"]
    assert kinds(f"{talk}\n- one\n- two\n{talk}") == ["list_end", "max_size"]
    assert kinds(f"{talk}\n" * 5)[0] == "max_size"
    block = "```\n" + "By the way\n- no list\n2024-01-01\n" * 3 + "```"
    assert [k for k, _ in chunking.Segmenter(600, 60).segments(f"{talk}\n{block}\n{talk}")] == ["initial"]  # nothing in a block ends a segment
    assert kinds(f"{talk}\n```\n" + "x = 1\n" * 150)[0] == "code_block"
    assert kinds(f"{talk}\nBy the way, short") == ["topic_shift"]  # a short last one joins the one before
    for text in (f"{talk}\n- a\n\n- b\nend {talk}\nanyway {talk}", f"{block}\n" * 4):
        assert "".join("".join(t for _, t in s.segments(text)).split()) == "".join(text.split())


def test_event_segments_as_a_table(spark):
    talk = "word " * 60
    df = spark.createDataFrame([(1, f"{talk}\nBy the way, {talk}"), (2, None), (3, "x")], "i int, text string")
    got = sorted((r["i"], r["segment_no"], r["segment_kind"]) for r in chunking.event_segments(df).collect())
    assert got == [(1, 0, "topic_shift"), (1, 1, "max_size"), (3, 0, "initial")]


def test_message_trees(spark):
    r = random.Random(6)
    rows, want = [], {}
    for tree in range(12):
        n = r.randint(1, 60)
        ids = [f"n{i}" for i in range(n)]
        parent = {ids[i]: ids[r.randrange(i)] if tree % 2 else ids[i - 1] for i in range(1, n)}
        parent[ids[0]] = None if tree % 3 else "gone"
        if n > 8:
            parent[ids[5]] = ids[7]
            parent[ids[7]] = ids[5]  # a cycle, and what hangs below it
        if n > 20:
            parent[ids[19]] = None  # another root
        place = {x: p for p, x in enumerate(r.sample(ids, n))}
        at = {x: r.randrange(5) for x in ids}
        rows += [(tree, x, parent[x], place[x], at[x]) for x in ids]
        root = min((x for x in ids if parent[x] not in parent), key=place.get)
        queue, order = [root], []
        while queue:
            x = queue.pop(0)
            order.append(x)
            queue += sorted((y for y in ids if parent[y] == x), key=lambda y: (at[y], place[y]))
        want[tree] = order
    df = spark.createDataFrame(rows, "tree long, id string, parent string, place long, at long")
    got = {}
    for x in trees.tree_order(df).orderBy("tree", "depth", "path").collect():
        got.setdefault(x["tree"], []).append(x["id"])
    assert got == want
    chain = spark.createDataFrame([(0, str(i), str(i - 1) if i else None, i, 0) for i in range(3000)], "tree long, id string, parent string, place long, at long")
    assert trees.tree_order(chain).agg(F.max("depth")).first()[0] == 2999


def test_chat_exports_as_trees(spark):
    export = """[{"mapping": {"b": {"parent": "a", "children": ["d", "c"], "message": {"author": {"role": "user"}, "content": {"parts": ["one", {"image": 1}, "two"]}}},
      "a": {"parent": null, "children": ["b"], "message": null}, "c": {"parent": "b", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["late"]}}},
      "d": {"parent": "b", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": [" first "]}, "create_time": 5}}}}]"""
    got = trees.ordered_messages(trees.export_nodes(spark.createDataFrame([("f", export), ("g", "broken"), ("h", "{}")], "file string, text string"))).orderBy("position").collect()
    assert [(x["tree"], x["role"], x["text"], x["at_s"]) for x in got] == [("f#0", "user", "one\ntwo", None), ("f#0", "assistant", "first", 5.0), ("f#0", "assistant", "late", None)]


def test_state_ends_with_its_keys(spark, tmp_path):
    base = 1_700_000_000
    batches = [
        [(i, base + i % 3, i % 500) for i in range(1500)],  # many keys at once
        [(2000, base + 7200, 9999)],  # two hours later: all that was before can go
        [(3000, base + 10, 7), (3001, base + 14_400, 9999)],  # one row that is late
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set(*stateful.STATE_STORE)
    found, sizes = [], []

    def keep(batch, n):
        found.extend(tuple(x) for x in batch.collect())

    q = stateful.limited(events, F.col("user_id"), 2, 60.0, "1 hour").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) >= 500 and sizes[-1] < 50  # keys whose minute is over are gone
    ok = {e for _, e, a in found if a}
    first_two = {i for key in range(500) for i in sorted((i for i in range(key, 1500, 500)), key=lambda i: (i % 3, i))[:2]}
    assert ok == first_two | {2000, 3001} and len(found) == 1503  # two of a key's three; the late one is refused


def test_limits_and_flushes_equal_a_loop(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, r.randrange(40_000_000), r.randrange(4)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, us long, user_id long").select("event_id", F.timestamp_micros(F.col("us") + 1_700_000_000_000_000).alias("ts"), "user_id")
    df.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    got = {x["event_id"]: x["accepted"] for x in jobs.run_once(stateful.limited(events, F.col("user_id"), 3, 1.5, "1 hour"), "append", str(tmp_path)).collect()}
    out = [tuple(x) for x in jobs.run_once(stateful.flushed_accesses(events, F.col("user_id"), 0.2, 1.0), "append", str(tmp_path)).collect()]
    for key in range(4):
        held, last, pending, flushed = [], None, [], []
        for t, e in sorted((t, e) for e, t, k in rows if k == key):
            held = [h for h in held if h > t - 1_500_000]
            assert got[e] == (len(held) < 3)
            held += [t] if got[e] else []
            if pending and t >= pending[0] + 1_000_000:
                flushed.append((len(pending), pending[0] + 1_000_000 + 1_700_000_000_000_000))
                pending = []
            if last is None or t - last >= 200_000:
                last, pending = t, [*pending, t]
        assert sorted((n, at) for k, n, at in out if k == key) == sorted(flushed)


def test_ingest_survives_failures_at_any_batch(spark, tmp_path):
    r = random.Random(9)
    rows = [(str(r.randrange(20)), i, f"v{i}") for i in range(120)]
    r.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], "id string, seq long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = ingest.KeptTable(spark, str(tmp_path / "t"), "id string, seq long, text string", most_segments=2)
    failed = set()

    def fail(n):
        if n not in failed:
            failed.add(n)
            raise RuntimeError("lost")

    for _ in range(7):
        stream = spark.readStream.schema("id string, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        try:
            ingest.ingest(stream, table, str(tmp_path / "c"), before_commit=fail)
            break
        except Exception as e:
            assert "lost" in str(e)
    assert failed == set(range(5)) and table.log.batches() == list(range(5)) and len(table.log.live()) <= 2
    newest = {}
    for i, s, t in rows:
        newest[i] = max(newest.get(i, (0, "")), (s, t))
    assert {x["id"]: (x["seq"], x["text"]) for x in table.current().collect()} == newest
    assert not table.write(spark.createDataFrame([("0", 999, "again")], "id string, seq long, text string"), 4)
    assert table.log.vacuum() > 0 and table.current().count() == len(newest)


def test_kept_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=8, most_segments=2)
    texts = lambda *rows: spark.createDataFrame(rows, "id string, text string")
    ask = spark.createDataFrame([("q", "red fox 狐")], "query_id string, query string")
    hits = lambda: [x["id"] for x in index.search(ask).orderBy("rank").collect()]
    assert hits() == []
    assert index.apply(0, texts(("1", "red fox"), ("2", "a fox of foxes"), ("3", "blue whale"), ("4", "")))
    assert hits() == ["1", "2"]
    assert index.apply(1, texts(("1", "green frog"), ("5", "狐 red red")), spark.createDataFrame([("2",)], "id string"))
    assert hits() == ["5"]
    assert not index.apply(1, texts(("1", "red fox")))
    before = [tuple(x) for x in index.search(ask).collect()]
    assert index.merge(2) and len(index.log.live()) == 1 and [tuple(x) for x in index.search(ask).collect()] == before


def test_similar_sets_equal_brute_force(spark):
    r = random.Random(10)
    things = {f"s{i:02}": frozenset(r.sample(["hot", *map(str, range(30))], r.randint(1, 9))) | ({"hot"} if i % 2 else set()) for i in range(90)}
    things["t1"] = things["s01"]
    items = spark.createDataFrame([(k, x) for k, v in things.items() for x in v], "id string, item string")
    classes = sets.set_classes(items, 2)
    of = {x["id"]: x["class"] for x in classes.collect()}
    assert of == {k: min(j for j, w in things.items() if w == v) for k, v in things.items() if len(v) >= 2}
    for t in (0.4, 0.6, 0.9):
        got = {(x["a"], x["b"]): x["jaccard"] for x in sets.similar_sets(classes, t).collect()}
        firsts = sorted(set(of.values()))
        want = {(a, b): len(things[a] & things[b]) / len(things[a] | things[b]) for a in firsts for b in firsts if a < b and len(things[a] & things[b]) / len(things[a] | things[b]) >= t}
        assert got == pytest.approx(want) and (want or t > 0.6)


def test_conflict_log_equals_a_loop(spark):
    r = random.Random(11)
    rows = [(r.randrange(12), r.randrange(60), i, r.choice(["detect", "resolve", "note"] if i % 3 else ["resolve", "detect"]), r.choice(["merged", "kept"])) for i in range(500)]
    rows += [(50, 1, 900, "resolve", "x"), (51, 1, 901, "resolve", "x"), (51, 2, 902, "detect", "x"), (52, 3, 903, "note", "x")]
    df = spark.createDataFrame(rows, "key long, at long, seq long, kind string, outcome string")
    want = {}
    for key in {x[0] for x in rows}:
        open_, status, s = False, None, Counter()
        first = back = done = None
        for _, at, _, kind, outcome in sorted((x for x in rows if x[0] == key), key=lambda x: x[1:3]):
            if kind == "detect":
                s["detections"] += 1
                if status is not None and not open_:
                    s["reopens"] += 1
                    back = at
                first = at if first is None else first
                open_, status = True, "open"
            elif kind == "resolve":
                if open_:
                    s["resolved"] += 1
                    open_, status, done = False, outcome, at
                else:
                    s["refused"] += 1
        if s["detections"]:
            want[key] = (status, s["detections"], s["reopens"], s["resolved"], s["refused"], first, back, None if open_ else done)
    for cell in (1, 7, 1000):
        assert {x["key"]: tuple(x)[1:] for x in conflicts.fold_log(df, cell).collect()} == want
    assert set(want) == {*range(12), 51}


def test_greedy_cover_equals_the_loop(spark):
    r = random.Random(12)
    rows, cues, want = [], [], {}
    for task in range(15):
        own = []
        for i in range(r.randint(0, 9)):
            text, priority, has = r.choice(["A b", "a  B", "c", f"t{i}", " "]), r.randrange(5), set(r.sample("uvwxyz", r.randint(0, 4)))
            rows.append((task, f"{task}.{i}", text, float(priority), i))
            cues += [(task, f"{task}.{i}", c) for c in has]
            own.append((text, float(priority), has))
        places = {}
        for i, (t, _, _) in enumerate(own):
            places.setdefault(" ".join(t.split()).lower(), i)
        want[task] = [f"{task}.{places[' '.join(t.split()).lower()]}" for t in gates.cover(own, 3)]
    got = {t: [] for t in range(15)}
    found = cover.greedy_cover(spark.createDataFrame(rows, "task int, id string, text string, priority double, position int"), spark.createDataFrame(cues, "task int, id string, cue string"), 3)
    for x in found.orderBy("task", "rank").collect():
        got[x["task"]].append(x["id"])
    assert got == want


def test_clusters_and_their_sums(spark):
    rng = np.random.default_rng(13)
    vectors = clouds(rng, 50, 0.4)
    rows = [(f"c{i:02}", v, "t", (i * 17) % 50, 0.5 + i % 2 / 4, i, i % 4) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id string, vector array<double>, topic string, place int, importance double, reads int, readers int")
    members = promotion.clusters(df, 0.8, ["topic"], [F.col("place")])
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    by = {r[0]: r[1] for r in order}
    centers, _ = greedy(list(by), lambda c, r: cos(by[c], by[r]) >= 0.8)
    place = {c: i for i, c in enumerate(by)}
    want = {i: i if i in centers else min((c for c in centers if cos(by[c], by[i]) >= 0.8), key=lambda c: (-round(cos(by[c], by[i]), 9), place[c])) for i in by}
    assert {x["id"]: x["center"] for x in members.collect()} == want
    for x in promotion.cluster_sums(df, members, ["topic"]).collect():
        own = [i for i, c in want.items() if c == x["center"]]
        pairs = [cos(by[a], by[b]) for k, a in enumerate(own) for b in own[k + 1 :]]
        assert x["n"] == len(own) and (len(own) < 2 or not any(by[own[0]]) or x["tightness"] == pytest.approx(np.mean(pairs), abs=1e-6))
    p = spark.createDataFrame([("p", "Use the big hammer slowly\nTools: Hammer, saw", 1)], "id string, text string, readers int")
    c = spark.createDataFrame([("x", "the hammer was slowly used\nTools: hammer", 0), ("y", "nothing alike", 3), ("z", "slowly hammer", 0)], "id string, text string, readers int")
    (v,) = promotion.verify_patterns(p, c, spark.createDataFrame([("p", i) for i in "xyz"], "id string, case_id string")).collect()
    assert (v["cases"], v["coverage"], v["ok"]) == (3, 0.5, True) and v["resonance"] == pytest.approx(2 / 3) and v["confidence"] == pytest.approx(0.6 + 0.75 * 0.15)


def test_trace(spark):
    t = Trace()
    df = t.stage(spark.range(10).withColumn("score", F.col("id") / 10), "one", ())
    df = t.stage(df.where("id > 3"), "two")
    assert t.stage(df.where("score > 0.8"), "three").count() == 1
    assert t.rows() == [(1, "one", 0, 10, 0, 0.0, 0.9), (2, "two", 10, 6, 4, 0.4, 0.9), (3, "three", 6, 1, 5, 0.9, 0.9)]


def test_signatures_of_cases(spark):
    from tidewell.functions import errors

    rows = [(1, "Error: disk is full now", "", "exit code 0, all well", []), (2, "", None, "still fails: exit code 7", ["ran it"]), (3, None, None, None, ["TypeError: x is not a function"]), (4, "calm", "quiet", "exit code 0", ["exit code 0"])]
    df = spark.createDataFrame(rows, "i int, p string, c string, o string, s array<string>")
    got = {r["i"]: r["x"] for r in df.select("i", errors.case_signatures(F.col("p"), F.col("c"), F.col("o"), F.col("s")).alias("x")).collect()}
    assert got[1] == ["Error: disk is full now"] and got[4] == []
    assert any("exit code 7" in x for x in got[2]) and any("TypeError" in x for x in got[3])


def test_low_thresholds_compare_whole_groups_in_blocks(spark):
    """Every near pair of a group comes once, however it is cut; rows of other lengths, empty and zero vectors are near to none."""
    rng = np.random.default_rng(8)
    vectors = clouds(rng, 160, 0.6)
    rows = [(f"p{i:03}", i % 2, v) for i, v in enumerate(vectors)] + [("short", 0, [1.0, 2.0]), ("none", 0, []), ("null", 0, None), ("zero", 0, [0.0] * len(vectors[0]))]
    df = spark.createDataFrame(rows, "id string, g int, vector array<double>")
    truth = {(f"p{i:03}", f"p{j:03}") for i in range(160) for j in range(i + 1, 160) if i % 2 == j % 2 and cos(vectors[i], vectors[j]) >= 0.5}
    for most in (16, 1000):
        found = similar._block_pairs(df, 0.5, ["g"], spread=3, small=8, most=most).collect()
        assert {(r["a"], r["b"]) for r in found} == truth and len(found) == len(truth) > 100
        assert all(abs(r["cos"] - cos(vectors[int(r["a"][1:])], vectors[int(r["b"][1:])])) < 1e-12 for r in found)
    found = similar.near_pairs(df, 0.5, ["g"], recall=0.5).collect()
    assert {(r["a"], r["b"]) for r in found} == truth  # bands of that recall would miss some


def test_near_pairs_at_low_thresholds_carry_a_row_a_few_times(spark):
    """What is dealt grows with blocks, not with bands: at 0.75 bands took each row up to 159 times."""
    rows = [(f"x{i:03}", np.random.default_rng(i).normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    assert similar.choose_bands(0.75)[0] > 100
    plan = similar.near_pairs(df, 0.75)._jdf.queryExecution().optimizedPlan().toString()
    assert "buckets" not in plan and "parts" in plan


def test_sets_little_alike_are_pairs_too(spark):
    """Without a threshold every pair of sets with a common item comes, down to the least alike."""
    rng = random.Random(3)
    items = [(f"s{i:02}", f"x{rng.randrange(30)}") for i in range(25) for _ in range(2 + i % 5)]
    by = {i: {x for j, x in items if j == i} for i, _ in items}
    firsts = {min(j for j in by if by[j] == by[i]) for i in by if len(by[i]) > 1}
    want = {(a, b): len(by[a] & by[b]) / len(by[a] | by[b]) for a in firsts for b in firsts if a < b and by[a] & by[b]}
    got = sets.similar_sets(sets.set_classes(spark.createDataFrame(items, "id string, item string"), 2), 0.0).collect()
    assert {(r["a"], r["b"]): pytest.approx(r["jaccard"]) for r in got} == want and min(want.values()) < 0.2
    sql = __import__("tidewell.queries", fromlist=["ORACLE_SQL"]).ORACLE_SQL["U4_jaccard"]
    assert "0.5" not in sql


def test_years_of_the_whole_century_count(spark):
    from tidewell.plans import measures
    from tidewell.queries import ORACLE_SQL

    df = spark.createDataFrame([("since 2021, legacy of 2019 and 2027, not 1999",)], "html string")
    assert {r["year"]: r["n"] for r in measures.years(df, "html").collect()} == {2019: 1, 2021: 1, 2027: 1}
    assert "BETWEEN" not in ORACLE_SQL["B12_years"]

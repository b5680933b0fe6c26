"""What a query moves, holds or works out, which should grow no faster than its input."""

from __future__ import annotations

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_set_similarity_works_its_arrays_out_once(spark):
    from tidewell.functions import text as T

    rows = spark.createDataFrame([("abcd", "abce"), ("", "abcd"), ("ab", "ab")], "a string, b string")
    out = rows.select(T.set_similarity(T.trigrams(F.col("a")), T.trigrams(F.col("b"))).alias("s"))
    assert [round(x["s"], 6) for x in out.collect()] == [round(1 / 3, 6), 0.0, 1.0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 2


def test_cue_scopes_works_a_text_out_once(spark):
    from tidewell.plans import measures

    rows = spark.createDataFrame([("1", "MIT\n License"), ("2", "none"), ("3", "mit license apache")], "id string, text string")
    cues = spark.createDataFrame([("mit license", "m"), ("Apache", "a")], "cue string, scope string")
    out = measures.cue_scopes(rows, cues)
    assert {x["id"]: (x["scope"], x["reason"]) for x in out.collect()} == {"1": ("m", "matched"), "2": (None, "no cue match"), "3": (None, "conflicting cues: a, m")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join") < plan.index("regexp_replace")  # below the join, so not within what runs for each cue


def test_ingest_reads_batches_of_many_files(spark, tmp_path):
    import glob

    from tidewell.operators.graph import shared_path
    from tidewell.queries.kept import r8

    spark.read.parquet(f"{SF}/documents.parquet").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    held, most = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    before = set(glob.glob(f"{shared_path(spark).removeprefix('file:')}/ingest/*"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        r8(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    (new,) = set(glob.glob(f"{shared_path(spark).removeprefix('file:')}/ingest/*")) - before
    assert len(glob.glob(f"{new}/in/*.parquet")) > 3


def test_band_join_sums_pairs_where_they_are(spark):
    from tidewell.queries.memory import j15

    assert _plan(j15(spark, SF)).split("Initial Plan")[0].count("Exchange hashpartitioning") == 2  # the two sides, no pairs


def test_band_join_makes_no_pairs_and_repeated_ids_are_one_row(spark, tmp_path):
    import datetime
    import random

    from tidewell.queries.memory import j15

    r, zero = random.Random(7), datetime.datetime(1969, 12, 31, 23, 55)
    at = lambda: zero + datetime.timedelta(seconds=r.choice([0, 30, 90, 600, 630, 3600, 4000]) + r.randint(0, 8) * 15)
    rows = [(i % 60, r.choice([at(), at(), at(), None]), r.choice([0, 5, 1, -1, None]), r.choice(["a", "b", None])) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    scope = lambda u: abs(u) % 5 * (1 if u > 0 else -1)
    met: dict[int, list] = {}
    for i, t, u, kind in rows:
        for j, t2, u2, kind2 in rows:
            if None not in (t, t2, u, u2, kind) and kind == kind2 and scope(u) != scope(u2) and abs(t - t2).total_seconds() <= 90:
                met.setdefault(i, []).append((abs(t - t2), j, scope(u2)))
    want = {i: min(x)[1] for i, x in met.items() if len({s for *_, s in x}) == 1}
    out = j15(spark, str(tmp_path))
    assert len(want) > 5 and {x["a"]: x["nearest"] for x in out.collect()} == want and out.count() == len(want)
    assert "Join" not in _plan(out)


def test_components_broadcast_no_table(spark, monkeypatch):
    from tidewell.operators import graph

    plans, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: (plans.append(_plan(df)), write(df))[1])
    out = graph.components(spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8)], "a long, b long"))
    assert {x["id"]: x["root"] for x in out.collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}
    assert plans and not any("Broadcast" in p for p in plans)


def test_similar_links_hold_few_products_and_rows_travel_seldom(spark, monkeypatch):
    import random

    from tidewell.operators import lifecycle

    r = random.Random(3)
    rows = [(f"{i:04}", "g", [r.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, grp string, vector array<double>")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    near = lambda v, w: sum(x * y for x, y in zip(v, w)) / norm(v) / norm(w) >= 0.8
    want = {i: sum(near(v, w) for j, _, w in rows if i != j) for i, _, v in rows}
    monkeypatch.setattr(lifecycle, "CELLS", 3_000)
    for block in (2048, 20):  # one unit, and 8 blocks of 50 rows, not 20 of 20
        got = {x["id"]: x["links"] for x in lifecycle.similar_links(df, 0.8, ["grp"], block).collect()}
        assert got == {i: n for i, n in want.items() if n}


def test_greedy_cover_writes_the_open_cues_once(spark, monkeypatch):
    from tidewell.operators import cover

    sizes, write = [], cover.materialise

    def counted(df):
        out = write(df)
        if "cue" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(cover, "materialise", counted)
    rows = spark.createDataFrame([("t", str(i), f"text {i}", 0.1, i) for i in range(30)], "task string, id string, text string, priority double, position int")
    cues = spark.createDataFrame([("t", str(i), f"c{i}x{k}") for i in range(30) for k in range(1 + i % 3)], "task string, id string, cue string")
    assert [x["id"] for x in cover.greedy_cover(rows, cues, 4).orderBy("rank").collect()] == ["2", "5", "8", "11"]
    assert sizes[0] == 60 and sum(sizes[1:]) == 9


def test_index_search_equals_brute_force_and_shuffles_no_pairs(spark, tmp_path, monkeypatch):
    import math
    import random

    from tidewell.operators import text_index as X

    r = random.Random(5)
    texts = {f"{i}": " ".join(r.choice("red blue green fox frog whale".split()) for _ in range(r.randint(0, 6))) for i in range(120)}
    asked = {"q1": "red fox", "q2": "blue blue whale", "q3": "nothing here", "q4": "frog"}
    monkeypatch.setattr(X, "QUERIES", 2)
    monkeypatch.setattr(X, "CELLS", 10)
    index = X.TextIndex(spark, str(tmp_path / "ix"), buckets=4)
    index.apply(0, spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3))
    out = index.search(spark.createDataFrame(list(asked.items()), "query_id string, query string"), 5)
    words = {i: t.split() for i, t in texts.items() if t}
    mean = sum(map(len, words.values())) / len(words)
    df = {w: sum(w in t for t in words.values()) for t in words.values() for w in t}
    idf = {w: math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    want = {}
    for q, text in asked.items():
        raw = {i: sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(text.split()) if w in t) for i, t in words.items()}
        want[q] = sorted((i for i in raw if raw[i] > 0), key=lambda i: (-round(raw[i], 9), i))[:5]
    got = {q: [x["id"] for x in out.where(F.col("query_id") == q).orderBy("rank").collect()] for q in asked}
    assert got == want
    assert "sum(part" not in _plan(out) and "partial_sum" not in _plan(out)


def test_index_search_reads_its_segments_once(spark, tmp_path, monkeypatch):
    import math

    from tidewell.operators import text_index as X

    monkeypatch.setattr(X, "CELLS", 8)
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string").repartition(3)
    index = X.TextIndex(spark, str(tmp_path / "ix"), buckets=4)
    first = {str(i): "fox 7 red_9 fox" if i % 3 else "fox 狐 x whale" for i in range(40)}
    index.apply(0, frame(list(first.items())))
    index.apply(1, frame([("3", "fox fox fox"), ("4", "none")]), spark.createDataFrame([("1",), ("2",)], "id string"))
    out = index.search(spark.createDataFrame([("q1", "red_9 fox"), ("q2", "狐 whale 7"), ("q3", "x")], "query_id string, query string"), 7)
    live = {i: [w for w in t.split() if len(w) > 1 or w == "狐"] for i, t in (first | {"3": "fox fox fox", "4": "none"}).items() if i not in ("1", "2")}
    mean = sum(map(len, live.values())) / len(live)
    df = {w: sum(w in t for t in live.values()) for t in live.values() for w in t}
    score = lambda w, t: math.log(1 + (len(live) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    for q, words in {"q1": ["red_9", "fox"], "q2": ["狐", "whale"], "q3": []}.items():
        raw = {i: sum(score(w, t) for w in words) for i, t in live.items()}
        want = sorted((i for i in raw if raw[i] > 0), key=lambda i: (-round(raw[i], 9), i))[:7]  # most scores are equal
        assert [x["id"] for x in out.where(F.col("query_id") == q).orderBy("rank").collect()] == want
    assert out.inputFiles() and not any("/segments/" in f for f in out.inputFiles())  # the live texts are written once


def test_index_cuts_texts_once(spark, tmp_path):
    from tidewell.operators import text_index as X

    cut = "regexp_extract_all"
    texts = spark.createDataFrame([("1", "red fox"), ("2", None), ("3", ""), ("4", "the fox fox")], "id string, text string")
    rows = X.entries_of(texts, "id", "text")
    assert sorted((x["id"], x["term"] or "", x["tf"], x["length"]) for x in rows.collect()) == [("1", "", 0, 2), ("1", "fox", 1, 2), ("1", "red", 1, 2), ("2", "", 0, 0), ("3", "", 0, 0), ("4", "", 0, 2), ("4", "fox", 2, 2)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(cut) == 1
    index = X.TextIndex(spark, str(tmp_path / "ix"), buckets=2)
    index.apply(0, texts, spark.createDataFrame([("1",)], "id string"))
    assert [x["id"] for x in index.search(spark.createDataFrame([("q", "red fox")], "query_id string, query string")).collect()] == ["4"]


def test_index_merges_its_smallest_segments_and_keeps_deletions(spark, tmp_path):
    from tidewell.operators import text_index as X

    texts = lambda *rows: spark.createDataFrame(rows, "id string, text string")
    ask = spark.createDataFrame([("q", "fox")], "query_id string, query string")
    index = X.TextIndex(spark, str(tmp_path / "ix"), buckets=2, most_segments=2)
    index.apply(0, texts(*((f"{i}", f"fox {'red ' * i}") for i in range(6))))
    first = index.log.live()
    index.apply(1, texts(("1", "no more"), ("9", "fox")))
    index.apply(2, None, spark.createDataFrame([("2",), ("9",)], "id string"))
    assert len(index.log.live()) == 2 and index.log.live()[0] == first[0]  # what is large was not written again
    hits = lambda: [tuple(x) for x in index.search(ask).orderBy("rank").collect()]
    before = hits()
    assert [x[1] for x in before] == ["0", "3", "4", "5"]
    index.merge(3)
    assert hits() == before and len(index.log.live()) == 1


def test_profiles_share_their_nearest_rows_and_no_text_travels(spark, monkeypatch):
    from tidewell.operators import search
    from tidewell.queries import retrieval as Q

    calls, real = [], search.knn_batch
    monkeypatch.setattr(search, "knn_batch", lambda *a, **b: calls.append(1) or real(*a, **b))
    out = Q.k11(spark, SF)
    assert len(calls) == 1  # for four profiles
    assert "text" not in Q._rows(spark, SF).columns and " text#" not in _plan(out)
    assert out.count()


def test_trace_searches_once_for_both_pipelines(spark, monkeypatch):
    from tidewell.operators import search
    from tidewell.queries import retrieval as Q

    calls, real = [], search.knn_batch
    monkeypatch.setattr(search, "knn_batch", lambda *a, **b: calls.append(1) or real(*a, **b))
    assert Q.g34(spark, SF).count() == 31 and len(calls) == 1


def test_consolidation_works_its_facts_out_once(spark):
    from tidewell.operators import consolidation

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("1", "s", "c", [1.0, 0.0], 0.5, 1, 1), ("2", "s", "c", [1.0, 0.1], 0.5, 2, 2)], "id string, scope string, category string, vector array<double>, importance double, accesses int, place long")
    facts = spark.createDataFrame([("1", "x", 2), ("1", "y", 1), ("2", "x", 2)], "id string, fact string, mentions long")
    out = consolidation.consolidate_once(rows, facts.mapInArrow(count, facts.schema))
    assert {x["id"]: x["canonical"] for x in out.collect()} == {"1": "2", "2": "2"} and seen.value == 3

"""run() against a plain version of the same five steps, on planted cases, odd rows included."""

import json
import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

R = random.Random(31)
POOL = ["".join(R.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(900)]
say = lambda n: [R.choice(POOL) for _ in range(n)]
RUDE = ["vilest", "wretches", "slurry"]
ITEM = say(20), say(6)


def grams(text):
    w = re.findall(r"\w+", text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def best_sum(sizes, budget):
    sums = 1
    for n in sizes:
        sums |= sums << n
    return (sums & ((1 << int(budget + 1e-9) + 1) - 1)).bit_length() - 1


def plain(rows):
    rows = [r for r in rows if not set((r[1] or "").split()) & set(RUDE)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        g = grams(r[1] or "")
        if not g or all(len(g & o) < 0.8 * len(g | o) for _, o in kept if o):
            kept.append((r, g))
    leak = " ".join(ITEM[0] + ITEM[1])
    rows = [r for r, _ in kept if leak not in (r[1] or "")]
    masked = [(i, t and re.sub(r"password = \w{6,}", "[secret]", t), s) for i, t, s in rows]
    sizes = [(i, len((t or "").split()), s) for i, t, s in masked]
    source = Counter()
    for _, n, s in sizes:
        source[s] += n
    order = sorted(source, key=lambda s: (s is None, s or ""))
    weight, capped, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, sum(source.values())
    while True:
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = [s for s in share if share[s] > 3 * source[s]]
        if not over:
            break
        capped |= {s: 3 * source[s] for s in over}
    out = {}
    for s, target in (share | capped).items():
        copies, own = int(target / source[s] + 1e-12), [n for _, n, x in sizes if x == s and n]
        out[s] = (source[s], round(target, 6), copies * source[s] + best_sum(own, target - copies * source[s]))
    return sizes, out


def test_run_equals_plain_steps(spark, tmp_path):
    rows = [(i, " ".join(say(60)), f"s{i % 3}") for i in range(300)]
    for i in range(0, 300, 2):
        if i % 4 == 0:
            w = rows[i][1].split()
            w[10:20:3] = [R.choice(RUDE) for _ in w[10:20:3]]
            rows[i] = (i, " ".join(w), rows[i][2])
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, r[1] + " end", "s0") for k, r in enumerate(clean[:12])] + [(2000, clean[20][1], "s1")] * 3
    rows += [(3000, " ".join(say(20) + ITEM[0] + ITEM[1] + say(20)), "s2"), (3001, " ".join(say(20) + ITEM[0] + say(20)), "s2"), (3002, " ".join(say(30)) + " password = hunter2222 x", None)]
    rows += [(5, " ".join(say(40)), "s0"), (None, " ".join(say(50)), "s1"), (None, clean[30][1], "s1"), (7000, None, "s0"), (7001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "text_class": F.lit("extra")})
    df.select("doc_id", "text", "lang", "source", "n_chars", "text_class").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(ITEM[0]) + "? " + " ".join(ITEM[1]) + ".")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sizes, by_source = plain(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter((i, n) for i, n, s in sizes if n)
    found = Counter((r["doc_id"], r["size"]) for r in got)
    assert not found - want
    of = {x[0]: x for x in by_source.values()}
    assert len(of) == len(by_source)
    taken = Counter()
    for r in got:
        taken[r["source_size"]] += r["taken"]
        assert round(r["target"], 6) == of[r["source_size"]][1] and 0 < r["taken"] <= 3 * r["size"]
    assert {n: t for n, (_, _, t) in of.items() if t} == dict(taken)
    assert json.dumps(sorted(map(str, found))) == json.dumps(sorted(map(str, Counter((r["doc_id"], r["size"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))))

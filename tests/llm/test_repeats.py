"""Repeated and null ids, texts whose case changes their length, parts of items, wrapped keys."""

import base64
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import decontamination, fingerprints, language_id, licenses, mixing, near_duplicates, quality, secrets
from tidewell.llm.common import first_rows, join_counted

R = random.Random(21)
POOL = ["".join(R.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
say = lambda n, r=R: " ".join(r.choice(POOL) for _ in range(n))
A, P, Q = say(40), say(40), say(40)


def test_ids_that_repeat_or_are_null_merge_nothing(spark):
    near_p = P + " and a few more"
    rows = [(3, A), (5, A), (5, P), (7, Q), (7, Q), (None, Q), (None, A), (5, near_p), (None, say(30)), (None, ""), (None, None), (9, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.monotonically_increasing_id())
    kept = Counter(r["text"] for r in near_duplicates.keep_one(df).collect())
    assert kept == Counter({A: 1, P: 1, Q: 1, rows[8][1]: 1, "": 3, None: 1}) or kept == Counter({A: 1, near_p: 1, Q: 1, rows[8][1]: 1, "": 3, None: 1})
    got = near_duplicates.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_class = Counter(r["class_id"] for r in got)
    assert by_class[3] == 3 and by_class[7] == 3 and sorted(by_class.values()) == [1] * 5 + [2, 3, 3]  # A, Q, P and its near copy, five alone
    of_five = [r for r in got if r["doc_id"] == 5]
    assert sorted(r["n_links"] for r in of_five) == [1, 1, 2] and len({r["class_id"] for r in of_five}) == 2


def test_one_fingerprint_for_each_row(spark):
    rows = [(1, A), (1, A), (2, P), (1, P), (None, A), (None, A), (3, None)]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert len({r["fingerprint"] for r in got}) == 3


def test_hot_keys_and_cuts(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", (i * 7) % 5, i) for i in range(6000)], "i long, k string, h long, __row long")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert join_counted(rows, counts, ["k"], "n", 6000).count() == 6000
    assert join_counted(rows, counts.where("k <> 'hot'"), ["k"], "n", 6000, "left").where("n is null").count() == 4000
    want = rows.withColumn("w", F.when(F.col("k") == "hot", 1234).otherwise(0))
    got = [r for r in first_rows(want, ["k"], "w", ["h", "__row"], 6000).collect() if r["chosen"]]
    assert sorted((r["h"], r["i"]) for r in got) == sorted(((i * 7) % 5, i) for i in range(6000) if i % 3)[:1234]


def test_mixing_equal_rows(spark):
    rows = [(None, "one two three", "a")] * 300 + [(1, "four five", "a")] * 200 + [(i, say(9), "b") for i in range(50)] + [(2, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for target, taken in {(r["target"], sum(x["taken"] for x in got if x["target"] == r["target"])) for r in got}:
        assert abs(target - taken) < 9 or target == 0  # documents of 9 words only
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_equal_keys_are_drawn_by_count(spark):
    df = spark.createDataFrame([(None, "same words here")] * 400 + [(i, say(5)) for i in range(100)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    for share in (0.1, 0.5, 0.77):
        got = quality.resample(df, lab, share=share).collect()
        assert len(got) == 500 and sum(r["selected"] for r in got) == round(500 * share)
    sums = {r["doc_id"]: r["log_weight"] for r in got}
    assert sums[None] < min(v for k, v in sums.items() if k is not None)


def test_licenses_in_texts_whose_case_changes_their_length(spark):
    notice = "Released under the MIT License."
    rows = [(1, "İx " * 300 + notice), (2, "İx " * 3 + notice + " and more words"), (3, (notice + " İ and so on ") * 400), (4, "// SPDX-License-Identifier: BSD-3-Clause\n" + say(20))]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (1, 2):
        (m,) = got[i]["matches"]
        assert rows[i - 1][1][m["start"] : m["end"]] == notice[:-1] and m["license"] == "MIT"
    assert got[3]["n_matches"] >= 1 and all(rows[2][1][m["start"] : m["end"]].startswith("Released") for m in got[3]["matches"])
    assert got[4]["licenses"] == ["BSD-3-Clause"]


def test_licenses_equal_a_plain_scan():
    index = licenses.Templates(licenses.TEMPLATES, 64, 0.9)
    hashes = licenses.LowerHash()
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [say(R.randint(0, 90)) + ". " + R.choice(notices) + " " + say(R.randint(0, 90)) for _ in range(150)]
    shingles = [licenses.shingle_hashes(hashes.of(licenses.words.findall(t)), 2) for t in texts]
    found = {(t, k) for t, _, k in licenses.candidates(shingles, index)}
    for i, s in enumerate(shingles):
        for k, template in enumerate(index.sets):
            whole = len(template & set(s.tolist())) >= index.least[k] and any(n in texts[i] for n, name in ((n, x) for x, ns in licenses.TEMPLATES.items() for n in ns) if name == index.names[k])
            assert not whole or (i, k) in found


def test_part_of_a_question_is_no_leak():
    q, a = [say(1) for _ in range(140)], [say(1) for _ in range(15)]
    index = decontamination.ItemIndex([(1, " ".join(q) + "? " + " ".join(a) + ".")], 0.6)
    assert len(index.words) == 3
    texts = [say(60) + " " + " ".join(w) + " " + say(60) for w in (q[:50], q, q + a, [*q[:70], "x", *q[71:], *a], a)]
    assert [x[0] for x in decontamination.search(texts, index, 0.7)] == [2, 3]


def test_leaks_equal_a_plain_search():
    r = random.Random(17)
    items = [(i, say(r.randint(6, 70), r) + "? " + say(r.randint(1, 20), r) + ".") for i in range(80)]
    texts = []
    for _ in range(80):
        w = items[r.randrange(80)][1].split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(POOL)
        texts.append(say(r.randint(0, 150), r) + " " + " ".join(w[: r.randint(len(w) // 2, len(w))]) + " " + say(r.randint(0, 50), r))
    index = decontamination.ItemIndex(items, 0.6)
    want = set()
    for t, text in enumerate(texts):
        words, found = decontamination.find_words(text.lower()), {}
        for start in range(0, max(len(words), 1), decontamination.STRIDE):
            passage = words[start : start + 2 * decontamination.STRIDE]
            terms = {index.vocabulary[w] for w in passage if w in index.vocabulary}
            for s in range(len(index.words)):
                if sum(w for t_ in terms for x, w in index.postings[t_] if x == s) >= 0.6 - 1e-9:
                    c = index.covered(s, passage, 0.7)
                    found.setdefault(index.whole[s], {})[s] = c | found.get(index.whole[s], {}).get(s, np.zeros(len(c), bool))
        want |= {(t, index.ids[i]) for i, f in found.items() if min(index.shares(index.segments[i], f)) >= 0.7}
    assert {x[:2] for x in decontamination.search(texts, index, 0.7)} == want and len(want) > 10


def test_wrapped_and_locked_keys():
    der = b"\x30\x82\x01\x08\x02\x82\x01\x01" + bytes(range(1, 256)) + b"\x01\x02" + b"\x02\x01\x03"
    body = base64.b64encode(der).decode()
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    text = "the key:\n  " + "\n  ".join(lines) + "\nends here"
    assert [(k, text[a:b]) for k, a, b in secrets.confirmed_spans(text)] == [("der", "\n  ".join(lines))]
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + base64.b64encode(bytes(range(64))).decode() + "\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _, _ in secrets.confirmed_spans(locked)] == ["pem"]
    assert secrets.confirmed_spans(locked.replace("ENCRYPTED", "PLAIN")) == []


def test_long_texts_are_learned_from(spark):
    r = random.Random(3)
    word = {"xx": "kato mira tomi", "yy": "schung berein unger"}
    rows = [(i, " ".join(r.choice(word[k].split()) for _ in range(6000 if k == "yy" else 20)), k) for i, k in enumerate(["xx", "yy"] * 40)]
    got = language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got)
    assert language_id.windows_of("x" * 1_000_000, 25, 4, 8) and max(map(len, language_id.windows_of("x" * 1_000_000, 25, 4, 8))) < 800

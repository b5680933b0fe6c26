"""Quality rules, source divergence and whitening against plain Python; adverse texts, short items and clashing columns."""

import base64
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidewell.llm import decontamination, licenses, near_duplicates, quality_rules, secrets, source_divergence, toxicity, whitening

R = random.Random(33)
POOL = ["".join(R.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
say = lambda n, r=R: " ".join(r.choice(POOL) for _ in range(n))
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    runs = list(zip(words, words[1:], words[2:]))
    times, inside = Counter(runs), set()
    for i, run in enumerate(runs):
        if times[run] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_rules_equal_plain_counts(spark):
    r, pool = random.Random(2), ["the", "of", "a", "and", "it", "é", "😀😀", "x|y", "###", "...", " ", "\xa0b", "word", "longerword"]
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\r\n", "\n\n"]
    texts = [None, "", " ", "\n\n", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\ny\nx\n x\nx "] + ["".join(r.choice(pool) + r.choice(gaps) for _ in range(r.randint(0, 120))) for _ in range(150)]
    rows = [(i % 7 or None, t, "k", 1) for i, t in enumerate(texts)] + [(1, texts[-1], "k", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, __id int")
    got = Counter(tuple(x[:8]) for x in quality_rules.apply_rules(df).collect())
    want = Counter()
    for i, t, *_ in rows:
        n, chars, symbols, lines, repeats = plain_counts(t)
        want[i, n, chars, symbols, lines, repeats, n < 50 or 100 * repeats > 50 * n] += 1
    assert Counter(k[:7] for k in got.elements()) == want
    assert not any(k[6] and k[7] for k in got)
    assert quality_rules.apply_rules(df.where("doc_id < 0")).count() == 0


def test_quality_rules_judge_by_their_table(spark):
    clean = ". ".join("the {} of {} is in {}".format(*say(3, random.Random(i)).split()) for i in range(40))
    junk = {"symbols": clean.replace(" ", "### "), "stop_words": say(200), "mean_word_length": " ".join("abcdefghijklmnop" + w for w in clean.split()), "bullet_lines": "\n".join("- " + x for x in clean.split(". "))}
    df = spark.createDataFrame([(0, clean)] + list(enumerate(junk.values(), 1)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in quality_rules.apply_rules(df).collect()}
    assert got[0]["kept"] and got[0]["broken"] == []
    for i, name in enumerate(junk, 1):
        assert not got[i]["base_failed"] and not got[i]["kept"] and name in got[i]["broken"]
    alone = [quality_rules.Rule("short", "n_words", "n_lines", None, 3000)]
    assert all(x["kept"] == (not x["base_failed"] and x["n_words"] <= 30 * x["n_lines"]) for x in quality_rules.apply_rules(df, alone).collect())
    began = time.time()
    long = quality_rules.apply_rules(spark.createDataFrame([(1, "one two three " * 100_000)], "doc_id long, text string")).first()
    assert long["n_repeat_words"] == long["n_words"] == 300_000 and time.time() - began < 30


def test_radix_tries_merge_by_prefix_in_byte_order():
    r = random.Random(4)
    for most in (3, 1_000_000):
        for _ in range(40):
            plain, merged, seen = Counter(), {}, Counter()
            for _ in range(r.randint(1, 4)):  # tries of several partitions
                counters = {}
                for _ in range(r.randint(0, 60)):
                    t, s = "".join(r.choice("abé好\U0001f600") for _ in range(r.randint(1, 5))).encode(), r.choice([b"x", b"y", b""])
                    n, docs = counters.setdefault(s, (Counter(), Counter()))
                    n[t] += 2
                    docs[t] += 1
                    plain[t, s] += 2
                    seen[t] += 1
                for batch in source_divergence.nodes(b"l", counters, 7):
                    for lang, prefix, terms, names, *columns in zip(*(c.to_pylist() for c in batch.columns)):
                        if terms:
                            assert all(t[:3].ljust(3, b"\0") == prefix for t in terms.split(b" "))
                            merged.setdefault(prefix, source_divergence.Container(most)).add(terms, names, *columns)
                        else:
                            assert prefix == b"" and sorted(names) == sorted(counters)
            walked = [row for prefix in sorted(merged) for b in merged[prefix].walk(b"l", 2) for row in zip(*(c.to_pylist() for c in b.columns))]
            assert {(t, s): n for _, t, s, n in walked} == {k: n for k, n in plain.items() if seen[k[0]] >= 2} and len(walked) == len(set(walked))
            assert [t for _, t, _, _ in walked] == sorted(t for _, t, _, _ in walked)


def test_terms_are_not_cut():
    text = "Ab ÉÉ12c_d" * 5 + "x" * 50 + " " * 20 + "y z"
    want = [re.sub("[A-Z]", lambda m: m[0].lower(), t).encode() for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
    for size in (1, 2, 3, 7, 1000):
        assert [t for part in source_divergence.terms_of(text.encode(), size) for t in part] == want


def plain_audit(rows, least=10, top=10):
    find = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    out, gap = set(), lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {r[1] or "" for r in rows}:
        own = [(r[2] or "", find(r[0])) for r in rows if (r[1] or "") == lang]
        docs = Counter(t for _, ts in own for t in set(ts))
        kept = sorted((t for t, n in docs.items() if n >= least), key=str.encode)
        counts = {s: Counter(t for x, ts in own if x == s for t in ts) for s, _ in own}
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        p = {s: [1 + 10**9 * (c[t] + 2) // (total[s] + 2 * len(kept)) for t in kept] for s, c in counts.items()}
        every = sum(counts.values(), Counter())
        q = [1 + 10**9 * (every[t] + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept]
        for s in counts:
            pairs = sorted(((-sum(map(gap, p[s], p[o])), o.encode(), o) for o in counts if o != s))
            terms = sorted((-gap(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[s][t] and a > b)[:top]
            out |= {(lang, s, part, name, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, name) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("counters", [40, 400_000])
def test_audit_equals_plain_python(spark, monkeypatch, counters):
    r = random.Random(counters)
    pool = ["The", "the", "é", "É", "好", "word", "Zed", "zed", "a", "b", "c", "ab", "abc", "\U0001f600"] + [f"rare{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(r.choices(pool, [40] * 14 + [1] * 20, k=r.randint(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s", "s", "s", "t", "u", None, "É"])) for _ in range(400)]
    rows += [(None, "fr", "only"), ("", "fr", "other"), ("unseen words", "xx", None)] + [rows[0]] * 5
    df = spark.createDataFrame([(*x, "extra") for x in rows], "text string, lang string, source string, term string")
    for name in ("count_terms", "merge_ranges"):
        f = getattr(source_divergence, name)
        monkeypatch.setattr(source_divergence, name, lambda *a, f=f: f(*a, most_counters=counters))
    if counters < 100:
        walk = source_divergence.walk_pairs
        monkeypatch.setattr(source_divergence, "walk_pairs", lambda *a: walk(*a, most_sources=5, most_heaps=2))
    found = [tuple(x) for x in source_divergence.audit(df).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_audit(rows)
    assert source_divergence.audit(df.where("lang = 'none'")).count() == 0
    few = source_divergence.audit(df, least_docs=10_000).collect()  # no term is kept
    assert {x["part"] for x in few} == {"pair"} and {x["value"] for x in few} == {0}


def test_scatter_is_exact():
    r = random.Random(5)
    for most in (3, 1 << 19, 1 << 40, (1 << 62) - 1):
        x = np.array([[r.randint(-most, most) for _ in range(3)] for _ in range(40)], np.int64)
        sums, products = whitening.scatter(x)
        rows = x.tolist()
        assert sums.tolist() == [sum(v[i] for v in rows) for i in range(3)]
        assert products.tolist() == [[sum(v[i] * v[j] for v in rows) for j in range(3)] for i in range(3)]
    for v in (0, 1, -1, 1 << 31, -(1 << 31) - 1, 3**90, -(3**90)):
        assert sum(limb << (32 * k) for _, _, k, limb in whitening._to_limbs(0, 0, v)) == v
    big = np.full((whitening.BLOCK + 5, 2), (1 << 20) - 1, np.int64)
    assert whitening.scatter(big)[1][0][1] == len(big) * ((1 << 20) - 1) ** 2


def test_whitening_equals_exact_fractions(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(120, 5)) @ r.normal(size=(5, 5))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(base)] + [(500, base[0].tolist(), "c")] * 90 + [(None, base[1].tolist(), "c")]
    rows += [(601, None, "c"), (602, [1.0, None, 0.0, 0.0, 0.0], "c"), (603, [float("nan")] * 5, "c"), (604, [float("inf")] + [0.0] * 4, "c"), (605, [1.0], "c"), (606, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    got = whitening.whiten(df).collect()
    ok = [x for x in rows if x[1] and len(x[1]) == 5 and all(c is not None and np.isfinite(c) for c in x[1])]
    assert Counter((x["vec_id"], x["component"]) for x in got) == Counter((i, k) for i, *_ in ok for k in range(1, 6))
    whole = {tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for _, v, _ in ok}
    n, sums = len(whole), [sum(c) for c in zip(*whole)]
    exact = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in whole), n**3) for j in range(5)] for i in range(5)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in exact]))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = {}
    by_id = {i: v for i, v, _ in ok}
    for x in got:
        v = [int(np.floor(64 * c)) + 1_000_000 for c in by_id[x["vec_id"]]]
        k = x["component"] - 1
        assert x["n"] == n and x["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums))
        w = float(sum((Fraction(c) - Fraction(s, n)) * Fraction(float(e)) for c, s, e in zip(v, sums, vectors[:, k]))) / values[k] ** 0.5
        assert abs(abs(w) - abs(x["whitened"])) < 1e-9
        if abs(w) > 1e-3:
            assert signs.setdefault(k, w * x["whitened"] > 0) == (w * x["whitened"] > 0)
        assert abs(x["explained"] - values[k] / values.sum()) < 1e-9 and x["identity_error"] < 1e-9
    assert whitening.whiten(df.where("vec_id > 600")).collect()[0]["n"] == 1  # only [1.0] is left
    assert whitening.whiten(df.where("vec_id > 700")).count() == 0
    one = whitening.whiten(df.where("vec_id = 500")).collect()
    assert len(one) == 450 and all(x["whitened"] is None and x["deviation"] == 0 and x["identity_error"] is None for x in one)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and {x["deviation"] for x in huge} == {None} or min(x["deviation"] or 0 for x in huge) >= 0


def test_adverse_texts_for_secrets_end_soon():
    mark = "-----BEGIN RSA PRIVATE KEY-----\n"
    line = base64.b64encode(bytes(48)).decode()
    texts = [mark + "A: b\n" * 200_000, (mark + "A: b\n\n") * 20_000, mark + "A: b\n" + "\n" * 1_000_000, mark * 30_000, "A" * 1_000_000, (line + "\n") * 15_000, '"' + line + '" +\n"' * 9_000, ("a" * 40 + '"' + " " * 80) * 8_000, "eyJ" * 300_000 + ".", "-----BEGIN X-----" + "\\" * 500_000]
    for text in texts:
        began = time.time()
        secrets.base_spans(text)
        secrets.confirmed_spans(text)
        assert time.time() - began < 3, text[:60]


def test_wrapped_keys_end_where_their_lengths_say():
    der = b"\x30\x82\x01\x0a\x02\x82\x01\x01" + bytes(range(1, 256)) + b"\x01\x02" + b"\x02\x03\x01\x00\x01"
    body = base64.b64encode(der).decode()
    assert len(der) % 3 == 0  # no padding says where it ends
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    wrapped = "\n".join(lines)
    text = "key:\n" + wrapped + "\nProse\nfollows the key\nhere"
    assert [(k, text[a:b]) for k, a, b in secrets.confirmed_spans(text)] == [("der", wrapped)]
    hexed = "\n".join(der.hex()[i : i + 64] for i in range(0, 2 * len(der), 64))
    text = "dump\n" + hexed + "\nabc\n"
    assert ("der", 5, 5 + len(hexed)) in secrets.confirmed_spans(text)
    quoted = " +\n    ".join(f'"{x}"' for x in lines)
    text = "String k = " + quoted + ";"
    assert [(k, text[a:b]) for k, a, b in secrets.confirmed_spans(text)] == [("der", quoted[1:-1])]
    blob = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
    key = base64.b64encode(blob * 1).decode()
    text = key[:40] + "\n" + key[40:] + "\nword"
    assert [k for k, _, _ in secrets.confirmed_spans(text)] == ["ssh"]
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b' {"alg": "HS256"}', b'{"sub": 1}', b"sig"))
    assert [k for k, _, _ in secrets.confirmed_spans("token " + token)] == ["jwt"]


CLASH = ["__row", "__id", "__n", "__h1", "__h2", "__bands", "id", "c0", "size"]


def test_columns_of_any_name_pass_through(spark):
    near = say(60)
    rows = [(1, near, "a"), (2, near + " end", "b"), (3, say(50), "c"), (4, "token = abcdef123456", "d"), (5, "you vile brute " * 9, "e"), (6, None, None)]
    df = spark.createDataFrame([(i, t, s, s, *([s] * len(CLASH))) for i, t, s in rows], "doc_id long, Text string, n_chars string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))
    labels = spark.createDataFrame([(i, int(i == 5)) for i in range(1, 6)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "Which words are here? " + " ".join(rows[2][1].split()[:20]))], "item_id long, text string")
    for stage in (near_duplicates.keep_one, lambda d: decontamination.drop_leaks(d, items), secrets.mask_secrets, lambda d: toxicity.drop_toxic(d, labels)):
        out = stage(df)
        assert out.columns == df.columns
        for x in out.collect():
            mark = rows[x["doc_id"] - 1][2]
            assert all(x[c] == mark for c in ["n_chars", "source", *CLASH])
    assert {x["doc_id"] for x in near_duplicates.keep_one(df).collect()} == {1, 3, 4, 5, 6}
    assert "[secret]" in {x["doc_id"]: x["Text"] for x in secrets.mask_secrets(df).collect()}[4]
    with pytest.raises(TypeError):
        secrets.mask_secrets(df, length_col="n_chars")


def test_short_items_count_as_a_run():
    index = decontamination.ItemIndex([(1, "Yes."), (2, "What is love?"), (3, "Who wrote it? Homer."), (4, " ".join(POOL[:20]) + "? " + POOL[20] + ".")], 0.6)
    texts = ["yes it is", "what is love to them", "they ask who wrote it homer they say", "homer is who wrote it, they ask who wrote it", " ".join(POOL[:21])]
    assert [x[:2] for x in decontamination.search(texts, index, 0.7)] == [(2, 3), (4, 4)]


def test_families_of_licenses_and_repeated_notices(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    rows = [
        (1, gnu.format("Affero General Public License")),
        (2, gnu.format("Lesser General Public License")),
        (3, gnu.format("General Public License")),
        (4, "Released under the MIT License. " * 2),
        (5, "either version 3 of the License, or (at your option) any later version."),
        (6, gnu.format("General Public License").replace("version 3", "version 2")),
    ]
    got = {x["doc_id"]: x for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(1, 7)] == [["AGPL-3.0"], ["LGPL"], ["GPL", "GPL-3.0"], ["MIT"], [], ["GPL", "GPL-2.0"]]
    assert got[4]["n_matches"] == 2


def test_evidence_is_the_mean_likelihood_ratio_of_the_passages():
    r = np.random.default_rng(8)
    for n in (1, 3, 4, 5, 50):
        ratios = r.normal(size=n)
        sums = [ratios[i : i + 4].sum() for i in range(n - 3)] if n > 4 else [ratios.sum()]
        assert abs(toxicity.text_evidence(ratios) - np.log(np.mean(np.exp(sums))) / min(n, 4)) < 1e-9 or n <= 4 and abs(toxicity.text_evidence(ratios) - ratios.mean()) < 1e-9
    ordinary = [toxicity.text_evidence(r.normal(-0.5, 0.5, n)) for n in [40] * 300 + [4000] * 300]
    assert abs(np.mean(ordinary[:300]) - np.mean(ordinary[300:])) < 0.05  # length says nothing
    assert toxicity.text_evidence(np.zeros(0)) == 0 and np.isfinite(toxicity.text_evidence(np.full(100, 800.0)))

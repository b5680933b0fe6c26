"""Cases in which a text operator once did less than its whole job."""

import base64
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidewell.llm import decontamination, secrets, toxicity


def test_keys_in_every_form_are_found_and_masked():
    body = bytes(range(1, 25))
    number = b"\x02\x18" + body
    key = b"\x30" + bytes([len(number) + 3]) + number + b"\x02\x01\x03"
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))
    k, s = base64.b64encode(key).decode(), base64.b64encode(ssh).decode()
    mixed = key.hex()[:20].upper() + key.hex()[20:]
    assert mixed not in (mixed.lower(), mixed.upper())
    for text, kind, value in (
        (f"PRIVATE_KEY={k}", "der", k),
        (f"export KEY={s}", "ssh", s),
        (f"https://x.org/?key={k}&b=1", "der", k),
        (f"A_VERY_LONG_NAME_OF_A_SETTING={k}", "der", k),
        (f"KEY: {k}", "der", k),
        (f'KEY="{k}"', "der", k),
        (f"x {mixed} y", "der", mixed),
    ):
        assert (kind, value) in [(n, text[a:b]) for n, a, b in secrets.confirmed_spans(text)], text
        assert value not in secrets.mask(text, secrets.confirmed_spans(text))
    long = base64.b64encode(b"\x30\x82\x01\x08\x02\x82\x01\x01" + bytes([255]) * 257 + b"\x02\x01\x03").decode()
    lines = "\n".join(long[i : i + 64] for i in range(0, len(long), 64))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----\n"
    plain = json.dumps({"key": pem})
    for text in (pem, plain, plain.replace("/", "\\/"), json.dumps(plain), plain.replace("\\n", "\\r\\n"), plain.replace("\\n", "\\u000a")):
        spans = secrets.confirmed_spans(text)
        assert [n for n, _, _ in spans] == ["der"], text
        assert long[:40] not in secrets.mask(text, spans) and long[-40:] not in secrets.mask(text, spans)


def test_runs_that_are_no_keys_stay():
    for text in ("KEY=" + "A" * 60, "a" * 64, "x=" + base64.b64encode(bytes(60)).decode(), "-----BEGIN X-----\\nAAAA\\n-----END X-----"):
        assert secrets.confirmed_spans(text) == []


def evidence_by_dictionaries(docs, marks, words):
    """Evidence of words from counts kept in dictionaries."""
    split = lambda w: "\x02" + w + "\x03"
    grams, top = [set() for _ in range(6)], (Counter(), Counter())
    for i, text in docs:
        fold = zlib.crc32(str(i).encode()) % 4
        for w in map(split, toxicity.find_words(text.lower())):
            for k in range(1, 5):
                grams[k + 1].update(w[j - k : j + 1] for j in range(k, len(w)))
            if fold in (0, 1):
                top[marks[i]].update(w[max(0, j - 4) : j + 1] for j in range(1, len(w)))
    shared = Counter(g[1:] for k in range(2, 6) for g in grams[k])
    tables = []
    for counts in (shared, *top):
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in counts.items():
            total[g[:-1], len(g)] += n
            kinds[g[:-1], len(g)] += 1
        tables.append((counts, total, kinds))

    def chance(table, g, lower):
        counts, total, kinds = table
        h = (g[:-1], len(g))
        return (max(counts[g] - 0.75, 0) + 0.75 * kinds[h] * lower) / total[h] if total.get(h) else lower

    out = []
    for w in map(split, words):
        llr = 0.0
        for j in range(1, len(w)):
            p = 1 / 256
            for k in range(1, min(j, 4) + 1):
                p = chance(tables[0], w[j - k + 1 : j + 1], p)
            g = w[max(0, j - 4) : j + 1]
            llr += math.log(chance(tables[2], g, p)) - math.log(chance(tables[1], g, p))
        out.append(llr)
    return out


def test_toxicity_counts_stay_exact_with_many_grams(spark):
    r = random.Random(12)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    docs = [(i, " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(400))) for i in range(400)]
    rude = ["vilest", "wretches", "slurry"]
    docs += [(1000 + i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", *(rude if i % 2 else [])]) for _ in range(60))) for i in range(80)]
    marks = {i: int(i >= 1000 and i % 2) for i, _ in docs}
    words = [*rude, "alpha", "vile", "slurries", *(w for _, t in docs[:3] for w in t.split()[:30])]
    model, curve = toxicity.fit(spark.createDataFrame(docs, "__id long, __text string"), spark.createDataFrame(list(marks.items()), "doc_id long, toxic int"), "toxic", "doc_id", 15_000, 6)
    got, want = toxicity.Evidence(model.value).ratio(words), evidence_by_dictionaries(docs, marks, words)
    assert curve and max(want) > 5
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5), list(zip(words, got, want, strict=True))[:8]


def test_one_changed_word_clears_no_copy():
    r = random.Random(13)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4000)]
    say = lambda n: [r.choice(pool) for _ in range(n)]
    items = [(i, say(r.randint(6, 40)), say(1 + i % 12)) for i in range(60)]
    index = decontamination.ItemIndex([(i, f"{' '.join(q)}? {' '.join(a)}.") for i, q, a in items], 0.6)
    copies = []
    for i, q, a in items:
        copies.append((i, [*q, "Answer:", *a]))
        for k in range(len(q + a)):
            w = q + a
            copies += [(i, [*w[:k], "changed", *w[k + 1 :]]), (i, [*w[:k], "added", *w[k:]]), (i, w[:k] + w[k + 1 :])]
    texts = [" ".join(say(30) + w + say(30)) for _, w in copies]
    found = {(t, item) for t, item, *_ in decontamination.search(texts, index, 0.7)}
    lost = [w for t, (i, w) in enumerate(copies) if (t, i) not in found]
    assert not lost, (len(lost), len(copies), lost[:3])
    assert len(found) == len(copies)
    alone = [" ".join(say(30) + q + say(30)) for _, q, a in items if len(a) > 2]
    assert not decontamination.search(alone, index, 0.7)  # a question without its answer

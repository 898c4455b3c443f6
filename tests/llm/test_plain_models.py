"""Learned operators against the same models in plain loops, and all of them on the table of odd rows."""
import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import language, mixing, quality, toxicity, warc
from tessera.llm.labelled import third
from test_operators import frame, labelled, odd      # noqa: F401


def grams_of(text):
    """(Bytes before, byte) expressions of four letters' bytes of a text, in order."""
    out, last = [], True
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        letter = 97 <= b <= 122 or b >= 128
        if letter or not last or not out:
            out.append(b if letter else 32)
        last = not letter
    return [bytes(out[j] if j >= 0 else 32 for j in range(i - 3, i + 1)) for i in range(len(out))]


def stretch(values, n):
    return max(sum(values[i:i + n]) / min(n, len(values)) for i in range(max(1, len(values) - n + 1))) if values else 0.0


def plain_kneser_ney(rows, discount=0.75):
    """Log ratio of an expression by dictionaries: class counts of texts, shared continuation counts below."""
    count = {1: Counter(), 0: Counter()}
    for text, label in rows:
        count[label].update(set(grams_of(text)))
    total = {k: sum(c.values()) for k, c in count.items()}
    grams = set(count[0]) | set(count[1])
    levels = [grams]
    for order in (3, 2, 1):
        levels.append({g[-order:] for g in levels[-1]})
    cont = [Counter(g[-order:] for g in levels[i]) for i, order in enumerate((3, 2, 1))]

    def lower(tail):
        if not tail:
            return 1 / 256
        c = cont[3 - len(tail)]
        same = [k for k in c if k[:-1] == tail[:-1]]
        every = sum(c[k] for k in same)
        return max(c[tail] - 0.75, 0) / every + 0.75 * len(same) / every * lower(tail[1:])

    def side(g, k):
        d = discount * total[k] / min(total.values())
        same = [x for x in grams if x[:3] == g[:3]]
        every = sum(count[k][x] for x in same)
        if not every:
            return 0.0, 1.0
        over = sum(max(count[k][x] - d, 0) for x in same)
        return max(count[k][g] - d, 0) / every, max(1 - over / every, 1e-4)
    def ratio(g):
        if not any(max(count[k][x] - discount * total[k] / min(total.values()), 0) for x in grams if x[:3] == g[:3] for k in (0, 1)):
            return 0.0
        (pt, bt), (po, bo) = side(g, 1), side(g, 0)
        if g in grams and (pt > 0 or po > 0):
            p = lower(g[1:])
            return math.log(pt + bt * p) - math.log(po + bo * p)
        return math.log(bt) - math.log(bo)
    return ratio


def test_toxicity_equals_dictionaries(spark, monkeypatch):
    rng = random.Random(4)
    words = ["ab", "ba", "abc", "Cab", "éa", "b2b"]
    rows = [(" ".join(rng.choice(words + (["vil", "vile"] if y else ["van"])) for _ in range(6)), y) for y in [0, 1, 0] * 12]
    model = toxicity.fit_counts(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "id long, text string, label int"))
    ratio = plain_kneser_ney(rows)
    texts = [t for t, _ in rows] + ["", None, "zzz", "vile vile", "AB! ab", "12"]
    of = {g: ratio(g) for t in texts for g in grams_of(t)}
    want = [stretch([of[g] for g in grams_of(t)], toxicity.STRETCH) for t in texts]
    assert max(len(grams_of(t)) for t in texts) < 64 and np.allclose(model.ratios(pa.array(texts)), want, atol=1e-9)
    monkeypatch.setattr(toxicity, "STRETCH", 5)
    assert np.allclose(model.ratios(pa.array(texts)), [stretch([of[g] for g in grams_of(t)], 5) for t in texts], atol=1e-9)


def test_toxicity_beats_a_word_model(spark):
    """Held-out rows of sf0.1: the area under the curve is at least that of naive Bayes over words."""
    import duckdb
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    score = {r.id: r.score for r in toxicity.score(known, toxicity.fit(known, labels, third(1))).collect()}
    rows = duckdb.sql(f"SELECT doc_id, lower(coalesce(text, '')), toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id)").fetchall()
    count, size = {0: Counter(), 1: Counter()}, Counter()
    for i, t, y in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            count[y].update(set(t.split()))
            size[y] += 1
    plain = {i: sum(math.log((count[1][w] + 0.5) / (size[1] + 1)) - math.log((count[0][w] + 0.5) / (size[0] + 1)) for w in set(t.split())) for i, t, _ in rows}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]

    def area(of):
        toxic, other = (sorted(of[i] for i, y in held if y == k) for k in (1, 0))
        return np.mean([(np.searchsorted(other, x, "left") + np.searchsorted(other, x, "right")) / 2 for x in toxic]) / len(other)
    assert area(score) >= max(0.85, area(plain)) and sum(y for _, y in held) > 100


def test_quality_ratios_equal_counts(spark):
    docs, labels = labelled(spark)
    rows = [(r.text, r.quality) for r in docs.join(labels.dropna().groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").collect()]
    good, bad = quality.cell_totals(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, label int"))
    plain = {1: Counter(), 0: Counter()}
    for text, label in rows:
        buf = np.frombuffer(text.encode(), np.uint8)
        plain[label].update(set(quality.features(buf, np.array([0, len(buf)]))[0].tolist()))
    assert all(Counter({c: int(n) for c, n in enumerate(x) if n}) == plain[k] for k, x in ((1, good), (0, bad)))
    ratio = quality.log_ratios(good, bad)
    g, b = sum(plain[1].values()) + len(ratio), sum(plain[0].values()) + len(ratio)
    for c in list(plain[0])[:50] + [0]:
        assert abs(ratio[c] - (math.log((plain[1][c] + 1) / g) - math.log((plain[0][c] + 1) / b))) < 1e-4


def test_language_scores_equal_loops():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], rng.normal(size=(language.CELLS, 2)).astype(np.float32), np.array([0.1, -0.2]), temperature=0.7)
    texts = ["The cat", "é é!", "", None, "12", "a" * 50]
    for text, got in zip(texts, model.scores(pa.array(texts))):
        buf = np.frombuffer((text or "").encode(), np.uint8)
        total, n = np.zeros(2), 0
        for cell, _ in language.subwords(buf, np.array([0, len(buf)])):
            for c in cell:
                total, n = total + model.logit[c].astype(float), n + 1
        z = (total / max(n, 1) + model.bias) / 0.7
        assert np.allclose(got, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-5)


def test_raking_equals_loops():
    """The same scaling cell by cell in plain loops."""
    rng = random.Random(3)
    cells = [(s, t, rng.randrange(1, 90)) for s in range(4) for t in range(3)]
    want = {0: {0: 0.4, 1: 0.3, 2: 0.3, 3: 0.0}, 1: {0: 0.2, 1: 0.3, 2: 0.5}}
    total, keep = sum(n for *_, n in cells), 0.5
    p = {c: keep for c in cells}
    for _ in range(500):
        for axis, shares in want.items():
            for name, share in shares.items():
                mine = [c for c in cells if c[axis] == name]
                have = sum(c[2] * p[c] for c in mine)
                stuck = sum(c[2] for c in mine if p[c] >= 1)
                goal = keep * total * share
                for c in mine:
                    if goal < stuck:
                        p[c] *= goal / max(have, 1e-12)
                    elif p[c] < 1:
                        p[c] *= (goal - stuck) / max(have - stuck, 1e-12) if have > stuck else 1
                for c in mine:
                    p[c] = min(1.0, max(0.0, p[c]))
    got = mixing.rake(np.array([n for *_, n in cells], float), [np.array([c[a] for c in cells]) for a in (0, 1)],
                      [np.array([want[a][k] for k in sorted(want[a])]) for a in (0, 1)], keep)
    assert np.allclose(got, [p[c] for c in cells], atol=1e-6) and all(p[c] == 0 for c in cells if c[0] == 3)


def test_records_equal_plain_digests(spark):
    """Every field of a derived record from the standard library alone."""
    page = "<html lang=de><title>T</title><p>x &lt; y</p><a href='/q'>z</a>"
    pages = spark.createDataFrame([(5, "http://u/", page)], "page_id long, url string, html string")
    digest = lambda t: "sha1:" + base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()     # noqa: E731
    meta, conv = sorted(warc.derive(warc.responses(pages)).collect(), key=lambda r: r.record_type, reverse=True)
    assert (conv.record_type, conv.text, conv.page_id) == ("conversion", "T\nx < y\nz", 5)
    assert meta.text.startswith("title: T\r\nlanguages-html: de\r\n") and meta.text.endswith("outlink: /q\r\n")
    for r in (meta, conv):
        assert r.payload_digest == digest(page) and r.block_digest == digest(r.text) and r.content_length == len(r.text.encode())
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and "WARC-Target-URI: http://u/\r\n" in r.header


def test_learned_operators_on_odd_rows(spark, odd):      # noqa: F811
    """Nulls, a 30,000-word text, repeated rows and ids: one answer a row, each in range."""
    docs, rows = odd
    ids = Counter(i for i, *_ in rows)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    never = lambda c: F.lit(False)      # noqa: E731
    for score in (toxicity.score(docs, toxicity.fit(docs, labels, never)), quality.score(docs, quality.fit(docs, labels, never))):
        found = score.collect()
        assert Counter(r.id for r in found) == ids and all(0 <= r.score <= 1 for r in found)
        by = defaultdict(set)
        for r in found:
            by[r.id].add(round(r.score, 12))
        assert len(by[5]) == 1
    model = language.fit(docs, lambda c: F.lit(True))
    found = language.identify(docs, model).collect()
    assert Counter(r.id for r in found) == ids and {r.lang for r in found if r.id in (1, 2, 3, 9)} == {"und"}
    assert all(r.lang in ("en", "fr") for r in found if r.id in (4, 5, 6, 7))
    for t in (toxicity.score(docs.limit(0), toxicity.fit(docs, labels, never)), language.identify(docs.limit(0), model)):
        assert t.count() == 0

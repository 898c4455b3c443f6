"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact, idfilter, jaccard, language, mixing, neighbours, packing, quality, sharding, toxicity, warc
from tessera.llm.labelled import platt, sigmoid
from tessera.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, kept boolean"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, la, so, 0, 7, "x", True) for i, t, la, so in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "déjà", "vu", "x1", "the", "of"]
    long_text = " ".join(rng.choice(words) for _ in range(30000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n ", "en", "a"), (4, "one", "en", "a"), (5, "one two", "fr", "b"),
            (6, long_text, "en", "a"), (7, long_text, "en", "b"), (8, long_text + " end", "en", "a"), (8, "one two", "fr", "b"),
            (None, "one", None, "b"), (9, "12 34 !!", "en", "a"), (5, "one two", "fr", "b")]
    return frame(spark, rows), rows


def empty(spark):
    return frame(spark, [(1, "x", "en", "a")]).limit(0)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, odd, weak):
    docs, rows = odd
    fn = (lambda t: F.length(t)) if weak else exact.md5_bytes   # a weak hash makes texts collide
    got = exact.exact_groups(docs, keep="largest", hash_fn=fn).collect()
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    want = [(i, max(x for x in by[t or ""] if x is not None), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t, *_ in rows]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    stay = exact.drop_duplicates(docs, hash_fn=fn)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in stay.collect()) == sorted(
        (min(x for x in ids if x is not None), t) for t, ids in by.items())
    assert exact.exact_groups(empty(spark)).count() == 0


def components_of(rows, k, percent):
    """Brute force: all pairs of shingle sets."""
    def words(t):
        out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            out = out.replace(c, " ")
        return [w for w in out.split(" ") if w]
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least.get(top(i))) for i, (d, *_) in enumerate(rows)]


def near_copies(seed=3, groups=6):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        base = ["w%d" % rng.randrange(400) for _ in range(rng.choice([8, 20, 60, 150]))]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = "e%d" % rng.randrange(99)
            rows.append((n := n + 1, " ".join(t), "en", "a"))
    return rows


@pytest.mark.parametrize("k,percent,crowd", [(3, 90, 4096), (5, 80, 3)])
def test_jaccard_components(spark, odd, k, percent, crowd):
    rows = near_copies() + [(1000 + i if i is not None else None, t, la, so) for i, t, la, so in odd[1] if i not in (5, 8)]
    got = jaccard.jaccard_join(frame(spark, rows), k=k, percent=percent, crowd=crowd).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == Counter(components_of(rows, k, percent))


def test_jaccard_near_threshold(spark, monkeypatch):
    """One base text with edits: many pairs pass the narrow bound and few link, so rows meet again with wide bitmaps."""
    rng = random.Random(11)
    base = ["w%d" % i for i in range(120)]
    rows = []
    for d in range(70):
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = "e%d" % rng.randrange(10 ** 6)
        rows.append((d, " ".join(t), "en", "a"))
    met, plain = [], jaccard.wide_bitmaps
    monkeypatch.setattr(jaccard, "wide_bitmaps", lambda *a: met.append(1) or plain(*a))
    got = jaccard.jaccard_join(frame(spark, rows), k=5, percent=80).collect()
    assert met
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == Counter(components_of(rows, 5, 80))


def test_without_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "doc_id long, __dropped string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long")
    assert Counter(map(tuple, idfilter.without_ids(rows, ids, "doc_id").collect())) == Counter([(2, "c"), (None, "d"), (3, None)])
    assert idfilter.without_ids(rows, ids.limit(0), "doc_id").count() == 5


def test_jaccard_empty(spark):
    assert jaccard.jaccard_join(empty(spark)).count() == 0


def test_bit_bound_never_too_low():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, 90)).astype(np.uint64) for _ in range(2))
        x, y = (np.frombuffer(jaccard.bitmap(s, 128), np.uint64) for s in (a, b))
        bound = jaccard.overlap_bound(len(a), len(b), int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum()))
        assert bound >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.5}])
def test_packing_round_trip(spark, odd, targets):
    docs, rows = odd
    got = packing.pack(docs, vocabulary(), 128, targets).toPandas()
    tok = packing.tokenizer(vocabulary())
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, *_ in rows)
    filled = Counter()
    for s, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part["offset"].to_numpy() == np.cumsum([0, *part["length"]])[:-1]).all()
        filled[s] = int(part["length"].sum())
    assert sorted(filled) == list(range(len(filled))) and all(v == 128 for s, v in filled.items() if s < len(filled) - 1)
    assert got["length"].sum() == sum(len(x) * n for (_, x), n in want.items())
    single = [i for i in (1, 2, 3, 4, 6, 7, 9)]
    for i in single:
        ids = [x for p in got[got["id"] == i].sort_values("start")["ids"] for x in np.frombuffer(p, "<u4").tolist()]
        assert (i, tuple(ids)) in want
    assert packing.pack(empty(spark), vocabulary()).count() == 0


def test_word_ids_equal_the_tokenizer():
    rng = random.Random(2)
    letters = list(" \n\t\r\x0b\xa0 aBsé1.,-'日𝄞ñ\x85") + ["<|endoftext|>", " 's", "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    words, tok, bad = packing.WordIds(vocabulary()), packing.tokenizer(vocabulary()), 0
    for i, j, buf, off in packing.chunks(pa.array(texts), 4096):
        ids, n = words.encode(buf, off)
        first = np.cumsum(n) - n
        bad += sum(ids[first[r]:first[r] + n[r]].tolist() != tok.encode(texts[i + r], add_special_tokens=False).ids for r in range(j - i))
    assert bad == 0


def test_rounds_cover_every_place_once():
    rng = random.Random(4)
    for trial in range(60):
        totals = [rng.randrange(0, 900) for _ in range(rng.randrange(1, 30))]
        shares = totals if trial % 2 else [rng.random() for _ in totals]
        rounds, seen = packing.Rounds(totals, shares, 32), []
        for q, n in enumerate(totals):
            if n:
                row, at, length, window, offset = rounds.cut(q, np.array([0]), np.array([n]))
                assert length.sum() == n
                seen += [w * 32 + o + z for w, o, m in zip(window, offset, length) for z in range(m)]
        assert sorted(seen) == list(range(sum(totals)))


def test_windows_hold_target_shares():
    rounds = packing.Rounds([5000, 5000], [0.75, 0.25], 100)
    _, _, length, window, _ = rounds.cut(0, np.array([0]), np.array([5000]))
    each = np.bincount(window, length)
    assert (each[:60] == 75).all()


def test_sharding(spark, odd):
    docs, rows = odd
    tree = sharding.uniform_tree(4, 2, 2)
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_rows(many, tree, sharding.grown_tree(tree)).toPandas()
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 900 < len(moved) < 1500
    assert got.groupby("shard").size().between(1000, 1500).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    small = sharding.shard_rows(docs, tree, sharding.grown_tree(tree)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in small) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.shard_rows(empty(spark), tree, tree).count() == 0


def test_sharding_of_a_repeated_id(spark, monkeypatch):
    """An id, and no id, with thousands of rows: slots without gaps, and no bucket holds the rows of one id."""
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 500)
    tree = sharding.uniform_tree(2, 2, 1)
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 7).when(F.col("id") >= 3100, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = rows.unionByName(rows.filter("doc_id is null").limit(50)).unionByName(spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")))
    got = sharding.shard_rows(rows, tree, sharding.grown_tree(tree)).toPandas()
    assert len(got) == 11050 and got["doc_id"].isna().sum() == 2150
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    mine = got[got["doc_id"] == 7].sort_values("slot")
    assert mine["shard"].nunique() == 1 and (mine["slot"].diff().dropna() > 1).sum() > 5      # spread over the shard


def test_shard_weights(spark):
    tree = {0: {0: {0: 3.0, 1: 1.0}}, 1: {0: {2: 4.0}}}
    heavier = {0: {0: {0: 3.0, 1: 1.0}}, 1: {0: {2: 8.0}}}
    rows = spark.range(20000).select(F.col("id").alias("doc_id"))
    got = sharding.place(sharding.place(rows, tree), heavier, name="then").toPandas()
    share = got["shard"].value_counts(normalize=True)
    assert abs(share[0] - 0.375) < 0.02 and abs(share[2] - 0.5) < 0.02
    moved = got[got["shard"] != got["then"]]
    assert set(moved["then"]) == {2}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 8)), np.tile(centres[0], (300, 1))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [float("nan")] * 8, 0),
                                                          (2060, [None] * 8, 0), (2080, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int")
    got = neighbours.search(df, lambda c: c % 20 == 0, k=5, leaf_rows=32).toPandas()
    hit = total = 0
    for q in range(0, 1200, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1200), -s))[:5]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine["score"], s[mine["vec_id"]], rtol=0, atol=1e-12)
        hit, total = hit + len(set(want) & set(mine["vec_id"])), total + 5
    assert hit / total >= 0.9 and set(got["query_id"]) == set(range(0, 1200, 20))
    assert neighbours.search(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = '<html lang="fr"><head><title>A &amp; B</title></head><body><p>Un<br>deux <a href="/x">lien</a><script>no()</script></p></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", page, "z"), (2, None, None, "z"), (None, "http://c/", "", "z"), (1, "http://a/", page, "z")],
                                  "page_id long, url string, html string, record_id string")
    found = warc.derive(warc.responses(pages)).cache()
    rows = found.collect()
    assert len(rows) == 8 and [r.text for r in rows if r.page_id == 1 and r.record_type == "conversion"][0] == "Un\ndeux lien"
    warc.write_warc(found, str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("part-*"))
    seen = []
    while data:   # an independent reader: headers, then as many bytes as they say
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        block, data = rest[:n], rest[n:]
        assert data[:4] == b"\r\n\r\n" and warc.sha1(block) == fields["WARC-Block-Digest"]
        data = data[4:]
        seen.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields["WARC-Refers-To"], block.decode()))
    assert Counter(seen) == Counter((r.record_type, r.record_id, r.refers_to, r.text) for r in rows)
    assert "outlink: /x" in [r.text for r in rows if r.record_type == "metadata" and r.page_id == 1][0]
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_raking_meets_marginals():
    rng = np.random.default_rng(3)
    tokens = rng.integers(50, 500, 60).astype(float)
    names = [np.arange(60) % 5, np.arange(60) // 5 % 3, np.arange(60) // 15]
    want = [mixing.tempered(tokens, of, of.max() + 1, 0.7) for of in names]
    p = mixing.rake(tokens, names, want, 0.5)
    for of, share in zip(names, want):
        assert np.allclose(np.bincount(of, tokens * p) / (tokens * p).sum(), share, atol=1e-3)
    assert abs((tokens * p).sum() / tokens.sum() - 0.5) < 1e-3 and p.max() <= 1


def test_mixing_samples_by_probability(spark, odd):
    docs, rows = odd
    fate = mixing.mix_sources(docs).collect()
    assert Counter(r.id for r in fate) == Counter(i for i, *_ in rows)
    stay = mixing.sample(docs)
    assert stay.columns == docs.columns
    dropped = {r.id for r in fate if not r.kept and r.id is not None}
    assert Counter(r.doc_id for r in stay.collect()) == Counter(i for i, *_ in rows if i not in dropped)
    assert mixing.sample(empty(spark)).count() == 0
    # a source with target 0 is never sampled
    none = mixing.mix_sources(docs, targets={"source": {"a": 1.0, "b": 0.0}}).collect()
    assert not any(r.kept or r.probability for r in none if r.source == "b" and r.tokens)


def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["stone", "river", "cloud", "house", "green", "walk"]) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["vilefool", "scumbag"])
        junk = i % 5 == 0
        rows.append((i, " ".join(["buy"] * 40 + words if junk else words), ["en", "fr"][i % 2], "a"))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "en", "a"), (1002, "!!", "en", "a")]
    return frame(spark, rows), spark.createDataFrame(labels + [(0, None, 1), (None, 1, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_and_quality(spark):
    docs, labels = labelled(spark)
    hold = lambda c: c % 3 == 1
    tox = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, hold)).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(tox[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.95
    good = {r.id: r.score for r in quality.score(docs, quality.fit(docs, labels, hold)).collect()}
    assert np.mean([(good[i] >= 0.5) == (i % 5 != 0) for i in held]) > 0.95
    for s in (tox, good):
        assert len(s) == 403 and all(0 <= x <= 1 for x in s.values())
    none = labels.limit(0)
    assert toxicity.score(docs, toxicity.fit(docs, none, hold)).count() == 403
    assert quality.score(empty(spark), quality.fit(docs, none, hold)).count() == 0
    clean = toxicity.keep_clean(docs, toxicity.fit(docs, labels, hold))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i in tox if tox[i] < 0.7}


def test_rare_language_is_learned(spark):
    rng = random.Random(1)
    words = {"en": ["the", "and", "with", "shore", "that"], "pl": ["szczęście", "źdźbło", "przez", "który", "więc"]}
    text = lambda la: " ".join(rng.choice(words[la]) for _ in range(12))     # noqa: E731
    rows = [(i, text("en"), "en", "a") for i in range(12000)] + [(20000 + i, text("pl"), "pl", "a") for i in range(6)]
    rows += [(30000 + i, text("pl"), None, "a") for i in range(20)]
    docs = frame(spark, rows)
    model = language.fit(docs, lambda c: F.lit(True))
    assert model.names == ["en", "pl"]
    got = {r.id: r.lang for r in language.identify(docs.filter("doc_id < 100 or doc_id >= 20000"), model).collect()}
    assert all(got[30000 + i] == "pl" for i in range(20)) and sum(got[i] == "en" for i in range(100)) > 95


def test_language(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice([["the", "and", "with", "shore"], ["être", "dans", "quelle", "avec"]][i % 2]) for _ in range(20)),
             ["en", "fr"][i % 2], "a") for i in range(300)] + [(900, None, "en", "a"), (901, "12 !", "en", "a"), (902, "the and", None, "a")]
    docs = frame(spark, rows)
    model = language.fit(docs, lambda c: c % 5 != 0)
    got = {r.id: r for r in language.identify(docs, model).collect()}
    assert np.mean([got[i].lang == ["en", "fr"][i % 2] for i in range(0, 300, 5)]) > 0.95
    assert got[900].lang == got[901].lang == "und" and not got[900].accepted and got[902].lang == "en"
    assert language.identify(docs, language.fit(empty(spark), lambda c: c > 0)).select("lang").distinct().collect()[0][0] == "und"


def test_platt_is_monotone():
    m = np.array([-2.0, -1, 0, 1, 2, 3])
    a, b = platt(m, np.array([0, 0, 1, 0, 1, 1]))
    assert a > 0 and (np.diff(sigmoid(a * m + b)) > 0).all()

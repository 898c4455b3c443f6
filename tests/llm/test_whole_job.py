"""Operators keep the whole job where bounds used to cut it."""
import numpy as np
import pyarrow as pa

from tessera.llm import jaccard, mixing, neighbours, packing, textarrays, toxicity


def test_toxicity_evidence_at_any_size(spark, monkeypatch):
    """An expression of 100 toxic texts counts too where a class holds 1e9 expressions; slices change nothing."""
    def packed(word):
        return int.from_bytes(word.encode(), "big")
    table = [(packed(w), t, o) for w, t, o in [("vile", 100, 0), ("vilm", 0, 100), ("ston", 5 * 10 ** 8, 5 * 10 ** 8), ("rive", 5 * 10 ** 8, 5 * 10 ** 8)]]
    monkeypatch.setattr(toxicity, "counts", lambda rows: spark.createDataFrame(table, "gram long, toxic long, ordinary long"))
    texts = pa.array(["vile", "vilm", "stone", None, "river vile"])
    model = toxicity.fit_counts(spark.range(1))
    whole = model.ratios(texts)
    assert whole[0] > 0.5 > -0.5 > whole[1] and whole[3] == 0
    monkeypatch.setattr(toxicity, "SLICE", 1)
    cut = toxicity.fit_counts(spark.range(1))
    assert len(model.slices) == 1 and len(cut.slices) > 1
    assert np.array_equal(cut.ratios(texts), whole)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "doc_id long, text string")
    got = {r.id: r.ratio for r in toxicity.score(docs, cut).collect()}
    assert [got[i] for i in range(5)] == whole.tolist()


def test_mixing_keeps_every_source(spark, monkeypatch):
    """More than 512 sources: names stay, targets by name hold, and raking by Spark equals raking on the driver."""
    rows = [(i, f"w{i % 7} " * (5 + i % 11), ["en", "fr", "de"][i // 3 % 3], "big" if i % 3 == 1 else f"s{i % 700}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix_sources(docs, 0.5).toPandas()
    assert dict(zip(got["id"], got["source"])) == {i: s for i, _, _, s in rows}
    aim = {"source": {"big": 0.5, **{f"s{i}": 0.5 / 700 for i in range(700)}}}
    aimed = mixing.mix_sources(docs, 0.3, targets=aim).toPandas()
    mass = (aimed["tokens"] * aimed["probability"]).groupby(aimed["source"]).sum()
    assert abs(mass["big"] / mass.sum() - 0.5) < 0.05
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mixing, "ROUNDS_A_TABLE", 3)
    cells = spark.createDataFrame([(f"s{i % 9}", "abc"[i % 3], str(i % 4), 10 + i * i % 97) for i in range(36)],
                                  "source string, lang string, topic string, tokens long")
    cells = cells.groupBy(*mixing.AXES).agg(mixing.F.sum("tokens").alias("tokens"))
    for targets in (None, {"source": {"s1": 0.4, "s2": 0.3, "s3": 0.3}}):
        want = {tuple(r[:3]): r[4] for r in mixing.probabilities(cells, 0.5, 0.7, targets).itertuples(index=False)}
        have = {tuple(r[:3]): r[3] for r in mixing.raked_table(cells, 0.5, 0.7, targets).collect()}
        assert set(want) == set(have) and max(abs(want[c] - have[c]) for c in want) < 1e-6


def window_counts(totals, shares, width):
    rounds = packing.Rounds(totals, shares, width)
    out = np.zeros((-(-sum(totals) // width), len(totals)), int)
    seen = []
    for q, n in enumerate(totals):
        _, _, length, window, offset = rounds.cut(q, np.array([0]), np.array([n]))
        np.add.at(out[:, q], window, length)
        seen.append(np.concatenate([window[i] * width + offset[i] + np.arange(length[i]) for i in range(len(length))]))
    assert (np.sort(np.concatenate(seen)) == np.arange(sum(totals))).all()
    return out


def test_every_window_holds_its_shares():
    """100 equal queues: each in every window, not about ten of them; also next to a large one."""
    each = window_counts([1024] * 100, [1.0] * 100, 1024)
    assert each[:-1].min() >= 9 and each[:-1].max() <= 12
    each = window_counts([40000] + [400] * 100, [0.5] + [0.005] * 100, 1000)
    assert abs(each[:-1, 0] - 500).max() <= 8 and each[:-1, 1:].min() >= 4 and each[:-1, 1:].max() <= 6
    # queues of less than a token a window, and one without a target after all others
    each = window_counts([60] * 300 + [500], [1.0] * 300 + [0.0], 100)
    assert each[:179].sum(axis=1).tolist() == [100] * 179 and each[:180, -1].sum() == 0 and each[:179].max() <= 1


def test_targets_by_source_with_many_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 80)
    rows = [(i, "one two three four " * 8, "big" if i % 2 else f"s{i % 400}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, packing_vocabulary(), 64, {"big": 0.75, **{f"s{i}": 0.25 / 200 for i in range(0, 400, 2)}}).toPandas()
    each = got[got["id"] % 2 == 1].groupby("sequence_id")["length"].sum()
    assert (each.loc[:100] - 48).abs().max() <= 6
    assert got["length"].sum() == got.drop_duplicates("id")["doc_tokens"].sum()


def packing_vocabulary():
    from tessera.llm.queries import vocabulary
    return vocabulary()


def test_isolated_queries_get_k_rows(spark):
    """Nearly all queries sit among 25 copies in one leaf; one among nine others gets its 20 rows too."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(161, 8))
    x = np.concatenate([np.repeat(x[:160], 25, axis=0), x[160] + 0.01 * rng.normal(size=(10, 8))])
    x /= np.sqrt((x ** 2).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, lambda c: c % 20 == 0, k=20, leaf_rows=30).toPandas()
    assert set(got["query_id"]) == set(range(0, 4010, 20)) and (got.groupby("query_id").size() == 20).all()
    assert set(range(4001, 4010)) <= set(got[got["query_id"] == 4000]["vec_id"])
    # its own repeated rows are no candidates and don't count
    more = df.union(spark.createDataFrame([(4000, x[4000].tolist())] * 15, df.schema))
    some = neighbours.search(more, lambda c: c == 4000, k=20, leaf_rows=30).toPandas()
    assert set(some["query_id"]) == {4000} and len(some) == 20 and 4000 not in set(some["vec_id"])


def colliding_words():
    """Words that one polynomial modulo 2^64 takes for equal, halves swapped, and words over 64 KB."""
    word = b"a"
    while len(word) < 1 << 17:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    flip = word.translate(bytes.maketrans(b"ab", b"ba"))
    swapped = [b"x" * i + b"q" + b"x" * 511 + b"z" + b"x" * (512 - i) for i in (0, 1)]
    return [w.decode() for n in (1024, 2048, 4096, 1 << 17) for w in (word[:n], flip[:n])] + [w.decode() for w in swapped]


def test_colliding_words_stay_apart(spark, monkeypatch):
    words = colliding_words()
    docs = spark.createDataFrame([(i, f"a {w} b", "en", "s") for i, w in enumerate(words)], "doc_id long, text string, lang string, source string")
    got = {r.id: r.component_id for r in jaccard.jaccard_join(docs, k=3, percent=90).collect()}
    assert got == {i: i for i in range(len(words))}
    tok = packing.tokenizer(packing_vocabulary())
    for weak in (False, True):      # with a hash of the length alone, too
        if weak:
            monkeypatch.setattr(packing, "hash_runs", lambda buf, s, e, v: (e - s).astype(np.uint64))
        cache = packing.WordIds(packing_vocabulary())
        for texts in (words[:3], words, [w + " " + w[::-1] for w in words[:4]], ["the cat", "a dog ate", "eta god"]):
            buf, off = textarrays.texts(pa.array(texts))
            ids, n = cache.encode(buf, off)
            want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

import math

import pytest

from tessera.operators import classify as nb


def test_priors_and_likelihoods(spark):
    docs = spark.createDataFrame([(1, 1, ["good", "fun"]), (2, 1, ["good"]), (3, 1, ["fun", "long"]),
                                  (4, 0, ["long", "bad"]), (5, 0, ["bad"])],
                                 "doc_id bigint, label int, tokens array<string>")
    vocab = nb.vocabulary(docs, 3)  # bad, fun, good, long by count then word -> bad(2), fun(2), good(2)
    assert [r.word for r in vocab.orderBy("rank").collect()] == ["bad", "fun", "good"]
    present = nb.presence(docs, vocab, keep=["label"])
    model = nb.fit_nb(present, docs.select("doc_id", "label"), vocab)
    pri = {r.label: r.prior for r in model.class_stats.collect()}
    assert pri == {1: pytest.approx(3.5 / 6), 0: pytest.approx(2.5 / 6)}
    th = {(r.label, r.word): r.theta for r in model.theta.collect()}
    assert th[(1, "good")] == pytest.approx(2.5 / 4) and th[(0, "good")] == pytest.approx(0.5 / 3)
    pred = {r.doc_id: r for r in nb.predict_nb(model, present, docs.select("doc_id")).collect()}
    # brute-force score of doc 1 for both classes
    def score(c, words):
        s = math.log(pri[c])
        for w in ["bad", "fun", "good"]:
            t = th[(c, w)]
            s += math.log(t) if w in words else math.log(1 - t)
        return s
    s1, s0 = score(1, {"good", "fun"}), score(0, {"good", "fun"})
    assert pred[1].p_1 == pytest.approx(math.exp(s1) / (math.exp(s1) + math.exp(s0)))
    assert pred[1].prediction == 1 and pred[5].prediction == 0
    top = nb.informative_features(model, 2).collect()
    assert top[0].ratio >= top[1].ratio

from conftest import rows
from pyspark.sql import functions as F

from tessera.functions.text import clean_tokens, key_words, remove_punctuation, remove_stop_words, tokenize
from tessera.operators.textstats import most_common, word_degrees, word_freq


def test_filters(spark):
    df = spark.createDataFrame([(["the", "The", ",", "--", "'", "film", "()", "isn't"],)], "t array<string>")
    r = df.select(remove_stop_words("t").alias("s"), remove_punctuation("t").alias("p"),
                  clean_tokens("t").alias("c")).collect()[0]
    assert r.s == ["The", ",", "--", "'", "film", "()"]      # case-sensitive list, tokens are lowered earlier
    assert r.p == ["the", "The", "--", "film", "isn't"]       # substring test: '--' survives, '()' goes
    assert r.c == ["The", "--", "film"]


def test_tokenize_unicode(spark):
    df = spark.createDataFrame([("Élan, vital; don't -- ÜBER_x 42.",)], "s string")
    assert df.select(tokenize("s")).collect()[0][0] == ["élan", ",", "vital", ";", "don", "'", "t", "-", "-",
                                                        "über_x", "42", "."]


def _rake_degrees(tokens, breaker):
    deg, phrase = {}, []
    for w in tokens + [None]:
        if w is None or breaker(w):
            for x in phrase:
                deg[x] = deg.get(x, 0) + len(phrase)
            phrase = []
        else:
            phrase.append(w)
    return deg


def test_word_degrees_brute_force(spark):
    from tessera.functions.constants import PUNCTUATION, STOP_WORDS
    text = "Red apples and green apples, the best apples of the fresh red market. Market red"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    toks = docs.select(tokenize("text")).collect()[0][0]
    expect = _rake_degrees(toks, lambda w: w in STOP_WORDS or w in PUNCTUATION)
    got = {r.word: r.degree for r in word_degrees(docs).collect()}
    assert got == expect
    assert got["red"] == 2 + 3 + 2  # "red apples", "fresh red market", "market red"


def test_key_words_order(spark):
    docs = spark.createDataFrame([("Bob ann the cat bob, dog eel fox gnu hen ibis jay kid",)], "text string")
    assert docs.select(key_words("text", 10)).collect()[0][0] == ["bob", "ann", "cat", "dog", "eel", "fox", "gnu",
                                                                  "hen", "ibis", "jay"]


def test_most_common_ties(spark):
    toks = spark.createDataFrame([(["b", "a", "c", "a", "b", "d"],)], "tokens array<string>")
    got = rows(most_common(word_freq(toks), 3), "rank", "word", "n")
    assert got == [(1, "a", 2), (2, "b", 2), (3, "c", 1)]

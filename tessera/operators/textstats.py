"""Corpus statistics over whole texts.

Tokenising is a row-local array expression; counting is ``explode`` plus a
hash aggregate with map-side combine, so a very frequent word (or a very
large document) is pre-aggregated inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_tokens, explode_terms, is_breaker, key_words as key_words_col, tokenize
from tessera.operators.skew import hot_keys, salted_join


def doc_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", clean: bool = False,
               keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, [keep...], tokens)``: lower-cased tokens of the whole text;
    with ``clean`` stop words and punctuation are removed (K10-K12)."""
    toks = tokenize(text)
    if clean:
        toks = clean_tokens(toks)
    return docs.select(doc_id, *(keep or []), toks.alias("tokens"))


def word_freq(tokens: DataFrame, col: str = "tokens") -> DataFrame:
    """``(word, n)`` occurrences over all documents."""
    return explode_terms(tokens, col, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def freq_summary(freq: DataFrame) -> DataFrame:
    """Distinct words ("samples") and total occurrences ("outcomes")."""
    return freq.agg(F.count(F.lit(1)).alias("samples"), F.sum("n").cast("bigint").alias("outcomes"))


def most_common(freq: DataFrame, n: int) -> DataFrame:
    """``(rank, word, n)`` for the ``n`` most frequent words (ties by word).

    ``orderBy().limit(n)`` plans as a top-n per task plus a merge of n rows
    per task; the rank is numbered on those n rows only.
    """
    top = freq.orderBy(F.desc("n"), F.asc("word")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("word"))))


def rank_range(freq: DataFrame, first: int, last: int) -> DataFrame:
    """ranks ``first..last`` (1-based, inclusive) of :func:`most_common`."""
    return most_common(freq, last).filter(F.col("rank") >= first)


def corpus_counts(labelled_tokens: DataFrame, label: str = "label", col: str = "tokens") -> DataFrame:
    """D3: documents and words per class plus the total row (``rollup``).

    ``label`` is null on the total row.
    """
    return (labelled_tokens.rollup(label)
            .agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(col)).cast("bigint").alias("words")))


def word_degrees(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Keyword degree per ``(doc_id, word)``.

    Candidate phrases are maximal runs of tokens that are neither stop words
    nor punctuation; every occurrence of a word adds its phrase's length.
    Phrases are cut row-locally: breaker tokens become newlines in a
    blank-joined token string (tokens never contain blanks), which is split
    into phrases; only then are the words exploded and summed.
    """
    toks = tokenize(text)
    marked = F.array_join(F.transform(toks, lambda w: F.when(is_breaker(w), F.lit("\n")).otherwise(w)), " ")
    # one plain character to split at, and trimming after the explode: neither a pattern nor a lambda runs over the phrases
    exploded = (explode_terms(docs, F.split(marked, "\n"), "phrase", doc_id)
                .select(doc_id, F.trim("phrase").alias("phrase")).filter(F.col("phrase") != "")
                .select(doc_id, F.split("phrase", " ").alias("words"))
                .select(doc_id, F.size("words").alias("plen"), F.explode("words").alias("word")))
    return exploded.groupBy(doc_id, "word").agg(F.sum("plen").cast("bigint").alias("degree"))


def key_words(docs: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, kw_rank, word)`` for the first ``k`` distinct content
    words of each text, in text order (the order of first appearance)."""
    return explode_terms(docs, key_words_col(text, k), "word", doc_id, pos="pos") \
        .select(doc_id, (F.col("pos") + 1).alias("kw_rank"), "word")


def tfidf(tokens: DataFrame, col: str = "tokens", doc_id: str = "doc_id", clean: bool = False) -> DataFrame:
    """``(doc_id, term, tf, df, tfidf)`` with idf = ln((N + 1) / (df + 1))
    (Spark ML's ``IDF`` formula). Term counts and document frequencies are
    both hash aggregates; the document count is one scalar aggregate. Terms
    with a large share of the (document, term) rows are dealt over salts. With
    ``clean`` stop words and punctuation are left out here, after the explode,
    in generated code (a lambda over the array is interpreted)."""
    from pyspark import StorageLevel
    # tf feeds both the scores and the document frequencies: persisted so the
    # corpus is tokenised once (memory, spilling to disk)
    terms = explode_terms(tokens, col, "term", doc_id)
    tf = ((terms.filter(~is_breaker(F.col("term"))) if clean else terms)
          .groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))
          .persist(StorageLevel.MEMORY_AND_DISK))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs = tokens.count()
    hot = hot_keys(df, ["term"], "df", tf.count())
    return (salted_join(tf, df, ["term"], hot, [doc_id])
            .withColumn("tfidf", F.col("tf") * F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1))))


def top_terms(scored: DataFrame, n: int = 5, doc_id: str = "doc_id", score: str = "tfidf",
              term: str = "term") -> DataFrame:
    """Top ``n`` terms per document by score (ties by term); ``row_number() <= n``
    plans as a partial window-group limit before the shuffle."""
    w = Window.partitionBy(doc_id).orderBy(F.desc(score), F.asc(term))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

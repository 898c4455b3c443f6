"""Text column functions: tokenise, lower-case, stop-word and punctuation filters.

All are SQL array expressions; the word lists are literal arrays that Catalyst
folds into the generated code (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.constants import COUNT_TOKEN_PATTERN, PUNCTUATION, STOP_WORDS, TOKEN_PATTERN


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stop_words_array(words=STOP_WORDS) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokenize(text: str | Column, lower: bool = True, pattern: str = TOKEN_PATTERN) -> Column:
    """K13 (+K2): the whole text split into word tokens and single punctuation tokens."""
    t = _c(text)
    if lower:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(pattern), 0)


def count_tokens(text: str | Column, lower: bool = True) -> Column:
    """I2 tokens: words of two or more word characters."""
    return tokenize(text, lower, COUNT_TOKEN_PATTERN)


def is_stop_word(word: Column, words=STOP_WORDS) -> Column:
    """Membership in the word list; ``isin`` over many literals is planned as a
    hash-set lookup (InSet), not a scan of the list."""
    return word.isin(list(words))


def is_punctuation(word: Column, punctuation: str = PUNCTUATION) -> Column:
    """Substring test against the punctuation string (so ``--`` is kept)."""
    return F.instr(F.lit(punctuation), word) > 0


def is_breaker(word: Column) -> Column:
    """A stop word or a punctuation token."""
    return is_stop_word(word) | is_punctuation(word)


def remove_stop_words(tokens: str | Column) -> Column:
    """K10."""
    return F.filter(_c(tokens), lambda w: ~is_stop_word(w))


def remove_punctuation(tokens: str | Column) -> Column:
    """K11."""
    return F.filter(_c(tokens), lambda w: ~is_punctuation(w))


def clean_tokens(tokens: str | Column) -> Column:
    """Both filters."""
    return F.filter(_c(tokens), lambda w: ~is_breaker(w))


def key_words(text: str | Column, k: int = 10) -> Column:
    """The first ``k`` distinct content words of the text, in text order."""
    return F.slice(F.array_distinct(clean_tokens(tokenize(text))), 1, k)


def explode_terms(df, array_col, alias: str, *keep, pos: str | None = None):
    """Rows of ``df`` exploded over a token array, dropping empty arrays.

    ``explode`` makes Spark infer a ``size(array) > 0`` filter that evaluates
    the array expression (the tokeniser) a second time in its own operator;
    ``explode_outer`` plus a null filter on the element evaluates it once.
    """
    arr = F.col(array_col) if isinstance(array_col, str) else array_col
    if pos is None:
        out = df.select(*keep, F.explode_outer(arr).alias(alias))
    else:
        out = df.select(*keep, F.posexplode_outer(arr).alias(pos, alias))
    return out.filter(F.col(alias).isNotNull())

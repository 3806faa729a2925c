"""Text normalisation and tokenisers as Column expressions.

All regular expressions run with ``(?U)`` so that ``\\w \\d \\s \\b`` are
Unicode-aware as in Python's ``re``.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The masking patterns, placeholder words and character whitelist
# of the text normaliser, which must match the reference exactly.
URL_PATTERN = r"(https?://\S+|www\.\S+)"
EMAIL_PATTERN = r"\b[\w\.-]+@[\w\.-]+\.\w+\b"
NUM_PATTERN = r"\b\d+(\.\d+)?\b"
URL_TOKEN, EMAIL_TOKEN, NUM_TOKEN = " URL ", " EMAIL ", " NUM "
NOT_WHITELIST_PATTERN = r"[^a-z0-9 _\-\+]"
# vectoriser token rule: runs of two or more word characters
VECTOR_TOKEN_PATTERN = r"\b\w\w+\b"


@lru_cache(maxsize=1)
def english_stop_words() -> tuple:
    """Spark's default English stop-word list (181 words), shipped as a file so
    the same literal list can be handed to an SQL oracle."""
    path = os.path.join(os.path.dirname(__file__), "stopwords_en.txt")
    with open(path, encoding="utf-8") as fh:
        return tuple(w for w in fh.read().split("\n") if w)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_text(c) -> Column:
    """null -> '' , anything else -> string (A4)."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def normalize_text(c, keep_placeholders: bool = False) -> Column:
    """Lowercase, mask URLs / e-mails / numbers, keep ``[a-z0-9 _-+]``,
    collapse whitespace and trim.

    The placeholders are inserted in upper case after lower-casing, so the
    whitelist turns them into spaces: masked spans vanish (the reference's
    behaviour).  ``keep_placeholders=True`` inserts lower-case words instead."""
    url, email, num = URL_TOKEN, EMAIL_TOKEN, NUM_TOKEN
    if keep_placeholders:
        url, email, num = url.lower(), email.lower(), num.lower()
    s = F.lower(safe_text(c))                                          # C2
    s = F.regexp_replace(s, "(?iU)" + URL_PATTERN, url)                # C3
    s = F.regexp_replace(s, "(?iU)" + EMAIL_PATTERN, email)            # C4
    s = F.regexp_replace(s, "(?U)" + NUM_PATTERN, num)                 # C5
    s = F.regexp_replace(s, NOT_WHITELIST_PATTERN, " ")                # C6
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))                # C7


def tokenize(normalized, max_tokens: int = 0) -> Column:
    """Split the normalised text on single spaces, keep tokens of length
    >= 2, optionally keep only the first ``max_tokens``."""
    toks = F.filter(F.split(_c(normalized), " "), lambda t: F.length(t) >= 2)
    if max_tokens and max_tokens > 0:
        toks = F.slice(toks, 1, int(max_tokens))
    return toks


def vector_tokens(normalized) -> Column:
    """The vectoriser's tokeniser (word runs of >= 2 word characters);
    deliberately different from ``tokenize``."""
    return F.regexp_extract_all(_c(normalized), F.lit("(?U)" + VECTOR_TOKEN_PATTERN), F.lit(0))


def remove_stop_words(tokens, words=None) -> Column:
    """Order- and duplicate-preserving removal of stop words."""
    words = english_stop_words() if words is None else tuple(words)
    lit = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    return F.filter(_c(tokens), lambda t: ~F.array_contains(lit, t))


def ngrams(tokens, n_max: int = 2) -> Column:
    """C11: all 1..n_max-grams over the surviving tokens, joined by a space.

    Built from shifted slices zipped together, so no lambda captures the token
    array (a captured array would be re-evaluated per element)."""
    toks = _c(tokens)
    out = toks
    for n in range(2, int(n_max) + 1):
        length = F.greatest(F.size(toks) - n + 1, F.lit(0))
        g = F.slice(toks, 1, length)
        for j in range(1, n):
            g = F.zip_with(g, F.slice(toks, j + 1, length), lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.concat(out, g)
    return out


def analyzer(text, stop_words: bool = True, n_max: int = 2, keep_placeholders: bool = False) -> Column:
    """Full vectoriser analyser: normalise -> C9 -> C10 -> C11."""
    toks = vector_tokens(normalize_text(text, keep_placeholders))
    if stop_words:
        toks = remove_stop_words(toks)
    return ngrams(toks, n_max)


def with_terms(df: DataFrame, text: str = "text", out: str = "terms", stop_words: bool = True,
               n_max: int = 2, keep_placeholders: bool = False) -> DataFrame:
    """Analyser as two projections: the token array is materialised once and
    the n-gram expression reads the column."""
    toks = vector_tokens(normalize_text(text, keep_placeholders))
    if stop_words:
        toks = remove_stop_words(toks)
    return df.withColumn("_toks", toks).withColumn(out, ngrams("_toks", n_max)).drop("_toks")


class TextNormalizer(Transformer, HasInputCol, HasOutputCol,
                     DefaultParamsReadable, DefaultParamsWritable):
    """ML transformer wrapping ``normalize_text``; fit is a no-op and
    transform is a single column expression (no Python per row)."""

    def __init__(self, inputCol: str = "text", outputCol: str = "clean"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), normalize_text(self.getInputCol()))

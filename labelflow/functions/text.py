"""Text expressions: missing tokens, Unicode strip, word tokens, 1-2 grams.

All are built-in Spark SQL expressions, so they stay inside whole-stage
code generation and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NA_TOKENS, STRIP_CHARS, WORD_PATTERN


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """Raw field -> null when it is one of the missing-value tokens."""
    c = _c(c)
    return F.when(~c.isin(*NA_TOKENS), c)


def strip(c) -> Column:
    """Strip leading/trailing Unicode whitespace, as Python ``str.strip``.

    ``btrim`` with the whitespace set walks in from both ends only; the
    equivalent regex would probe every inner space."""
    return F.btrim(_c(c), F.lit(STRIP_CHARS))


def normalise_label(c) -> Column:
    return F.lower(strip(c))


def is_blank(c) -> Column:
    """True for null, empty or whitespace-only text."""
    return F.coalesce(strip(c), F.lit("")) == F.lit("")


def word_tokens(c) -> Column:
    """Lower-cased runs of >= 2 letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_PATTERN), 0)


def word_bigrams(tokens) -> Column:
    """Adjacent token pairs joined by one space (after short tokens are gone)."""
    tokens = _c(tokens)
    tail = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.transform(tail, lambda y, i: F.concat(tokens[i], F.lit(" "), y))


def ngrams_1_2(tokens) -> Column:
    """Unigrams followed by bigrams."""
    tokens = _c(tokens)
    return F.concat(tokens, word_bigrams(tokens))


def run_starts(sorted_terms) -> Column:
    """0-based positions where a new term starts in a sorted term array."""
    s = _c(sorted_terms)
    n = F.size(s)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (s[i] != F.get(s, i - 1)),
    )
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def term_frequencies(sorted_terms, starts) -> Column:
    """Run-length counts of a sorted term array, inside the row.

    ``sorted_terms`` (``array_sort`` of the terms) and ``starts``
    (``run_starts`` of it) must be columns computed in earlier projections,
    so neither is re-evaluated inside the lambda. Returns
    ``array<struct<term: string, tf: int>>`` in term order; counting within
    the row means term frequencies need no shuffle. O(n log n) per row.
    """
    s, st = _c(sorted_terms), _c(starts)
    n = F.size(s)
    return F.transform(
        st,
        lambda b, j: F.struct(
            s[b].alias("term"),
            (F.coalesce(F.get(st, j + 1), n) - b).alias("tf"),
        ),
    )

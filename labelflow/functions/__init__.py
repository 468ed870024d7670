"""Column expressions (JVM-side; lambdas over arrays are interpreted, the rest is code-generated)."""

from .text import (  # noqa: F401
    is_blank,
    na_to_null,
    ngrams_1_2,
    normalise_label,
    run_starts,
    strip,
    term_frequencies,
    word_bigrams,
    word_tokens,
)
from .arrays import argmax, prob_map, softmax  # noqa: F401
from .numeric import safe_div  # noqa: F401

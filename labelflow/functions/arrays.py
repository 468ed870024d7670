"""Array expressions for scores: softmax, argmax, label -> probability map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits) -> Column:
    """Numerically stable softmax of an ``array<double>``."""
    logits = _c(logits)
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def argmax(values) -> Column:
    """0-based index of the maximum; the lowest index wins a tie."""
    values = _c(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def prob_map(labels, probs, digits: int | None = None) -> Column:
    """``map<label, probability>``, optionally rounded."""
    probs = _c(probs)
    if digits is not None:
        probs = F.transform(probs, lambda p: F.round(p, digits))
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probs)

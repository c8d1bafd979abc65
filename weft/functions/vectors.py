"""Column functions over numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binarise(vec: Column | str, bits: int) -> Column:
    """Sign bits of the first ``bits`` components: 1 where the component is above zero."""
    return F.transform(F.slice(_col(vec), 1, bits), lambda v: F.when(v > 0, 1).otherwise(0))


def pack_bits(bits: Column | str) -> Column:
    """Integer whose bit *i* is element *i* (the first element is the lowest bit)."""
    weighted = F.transform(
        _col(bits), lambda b, i: b.cast("bigint") * F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    )
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def saturating_sigmoid(c: Column | str) -> Column:
    """Logistic curve stretched to [-0.1, 1.1] and cut to [0, 1]."""
    curve = F.lit(1.2) / (F.lit(1.0) + F.exp(-_col(c).cast("double"))) - F.lit(0.1)
    return F.least(F.greatest(curve, F.lit(0.0)), F.lit(1.0))


def argmax(scores: Column | str) -> Column:
    """Index (from 0) of the largest score; the first one wins."""
    return F.array_position(_col(scores), F.array_max(_col(scores))) - 1


def log_softmax_at(scores: Column | str, y: Column | str) -> Column:
    """Log-probability of class ``y`` under the softmax of ``scores``."""
    scores, top = _col(scores), F.array_max(_col(scores))
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.get(scores, _col(y).cast("int")) - top - F.log(total)


def nll(scores: Column | str, y: Column | str) -> Column:
    """Negative log-likelihood of class ``y``."""
    return -log_softmax_at(scores, y)

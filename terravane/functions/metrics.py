"""Precision, recall and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def pairs_of(n: Column) -> Column:
    """n choose 2."""
    return n * (n - 1) / 2


def confidence(n: Column, spread: Column) -> Column:
    """Support of a cluster: full from five observations on, half of it for tightness."""
    return F.least(F.lit(1.0), n / 5) * (0.5 + 0.5 * F.greatest(F.lit(0.0), 1 - spread / 2))


def boosted(similarity: Column, positive: Column, negative: Column, alpha: float, beta: float) -> Column:
    """similarity + alpha * positive - beta * negative, within [-1, 1]; a null prototype similarity counts as 0."""
    raised = similarity + alpha * F.coalesce(positive, F.lit(0.0)) - beta * F.coalesce(negative, F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raised))

"""Vector and score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: float = 1e-9) -> Column:
    """guard > 0 is added to the product of norms; with 0 a zero vector has similarity 0."""
    scale = norm(a) * norm(b)
    return dot(a, b) / (scale + guard) if guard else F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean}


def min_max(score: Column, by: str = "query_id") -> Column:
    """Per query to 0..1; 1 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def cosine_to_unit(score: Column) -> Column:
    return F.when(score < 0, (score + 1) / 2).otherwise(score)


def sigmoid(score: Column, midpoint: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(score - midpoint)))


def softmax(score: Column, by: str = "query_id", temperature: float = 1.0) -> Column:
    w = Window.partitionBy(by)
    e = F.exp((score - F.max(score).over(w)) / temperature)
    return e / F.sum(e).over(w)

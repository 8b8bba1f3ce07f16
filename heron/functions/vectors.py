"""Distances between array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(v: Column | str | Sequence[float]) -> Column:
    if isinstance(v, str):
        return F.col(v)
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column | str, b: Column | str | Sequence[float]) -> Column:
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str | Sequence[float]) -> Column:
    return F.sqrt(F.aggregate(_column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column | str, b: Column | str | Sequence[float]) -> Column:
    """NaN where one of the two is a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(dot(a, b) / scale)


def cosine_distance(a: Column | str, b: Column | str | Sequence[float]) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def euclidean_distance(a: Column | str, b: Column | str | Sequence[float]) -> Column:
    squares = F.zip_with(_column(a), _column(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def manhattan_distance(a: Column | str, b: Column | str | Sequence[float]) -> Column:
    steps = F.zip_with(_column(a), _column(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


#: Distances by name; register_distance adds to them.
DISTANCES: dict[str, Callable[..., Column]] = {"cosine": cosine_distance, "euclidean": euclidean_distance}


def register_distance(name: str, function: Callable[..., Column]) -> None:
    DISTANCES[name] = function


def distance(name: str) -> Callable[..., Column]:
    try:
        return DISTANCES[name]
    except KeyError:
        raise ValueError(f"no distance {name!r}; there are {', '.join(sorted(DISTANCES))}") from None


def valid_embedding(v: Column | str) -> Column:
    """Not null, not empty, every value finite."""
    c = _column(v)
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

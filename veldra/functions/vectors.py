"""Distances and projections of float vectors as column expressions.

Every sum runs over doubles from left to right, so that the result does not
depend on the machine. A null, or vectors of different lengths, give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def squared_l2(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _total(F.zip_with(a, b, term))


def integer_squared_l2(a: Column, b: Column) -> Column:
    """For vectors of small integers: an exact bigint."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y.cast("bigint")) * (x.cast("bigint") - y.cast("bigint"))), F.lit(0).cast("bigint"), lambda total, x: total + x)


def inner_product(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def inner_product_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - inner_product(a, b)


def squared_norm(v: Column) -> Column:
    return _total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def signed_projection(v: Column) -> Column:
    """The sum of elements with signs + - + - from the first."""
    return _total(F.transform(v, lambda x, i: F.when(i % 2 == 0, x.cast("double")).otherwise(-x.cast("double"))))

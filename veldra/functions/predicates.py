"""Conjunctions of closed ranges over numeric attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Types whose values are compared as 64-bit integers.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _inside(value: Column, low: Column, high: Column) -> Column:
    """Whether a value lies in a closed range: whole numbers as 64-bit integers, bounds rounded inwards, others as floats."""
    number = F.isnan(low.cast("double")) | F.isnan(high.cast("double"))
    exact = ~number & value.cast("long").between(F.ceil(low), F.floor(high))
    return F.when(F.typeof(value).isin(*WHOLE), exact).otherwise(value.cast("float").between(low.cast("float"), high.cast("float")))


def in_ranges(attributes: list[Column], bounds: Column, active: Column | None = None) -> Column:
    """Whether each attribute lies in its range ``bounds[i].low .. bounds[i].high``.

    ``active`` is an array of flags; an attribute whose flag is false is not
    tested, and a null or empty array means all. Attributes of whole-number
    types are compared as 64-bit integers, others as floats. A reversed range
    holds nothing; a wrong number of bounds gives false.
    """
    tests = []
    for i, a in enumerate(attributes):
        own = F.get(bounds, F.lit(i))
        test = _inside(a, own["low"], own["high"])
        if active is not None:
            test = test | F.coalesce(F.size(active) > 0, F.lit(False)) & ~F.coalesce(F.get(active, F.lit(i)), F.lit(True))
        tests.append(test)
    right_size = F.size(bounds) == len(attributes)
    return F.coalesce(reduce(Column.__and__, tests, right_size), F.lit(False))


def parse_attributes(text: str, count: int) -> list[bool]:
    """The mask that a text names: empty or ``all``, ``none``, or numbers parted by spaces; no number twice or out of range."""
    text = text.strip()
    if text in ("", "all"):
        return [True] * count
    if text == "none":
        return [False] * count
    chosen = [int(x) for x in text.split()]
    if len(set(chosen)) != len(chosen):
        raise ValueError("an attribute is named twice")
    if any(not 0 <= a < count for a in chosen):
        raise ValueError("an attribute is out of range")
    return [i in chosen for i in range(count)]


def validate_arity(given: int, count: int) -> None:
    if given != count:
        raise ValueError(f"{given} bounds for {count} attributes")


def float_bounds(pairs: list[tuple[Column, Column]]) -> Column:
    """An array of range structs with float ends."""
    return F.array(*[F.struct(low.cast("float").alias("low"), high.cast("float").alias("high")) for low, high in pairs])

"""Global orders: running totals, ranks by (value, id), rank ranges and dense codes.

An order over a whole table is never made in one task: rows are dealt out by
ranges of the order and stored, each part is numbered by itself, and the parts'
totals, one row each, are added up and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.session import stored


def running_totals(frame: DataFrame, order: list[str], totals: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """Adds columns with the sums of expressions over this row and all before it, in the order of columns.

    ``within`` names leading columns whose every value has totals of its own.
    The order should be total; rows that it leaves equal are taken as they come.
    """
    keys = within or []
    sort = [*keys, *order]
    parted = frame.withColumns({f"__{k}": v for k, v in totals.items()}).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__part", F.spark_partition_id())
    parted = stored(parted, "ordered")
    local = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parted.withColumns({f"__{k}": F.sum(f"__{k}").over(local) for k in totals})
    sizes = parted.groupBy("__part", *keys).agg(*[F.sum(f"__{k}").alias(f"__all_{k}") for k in totals])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", *keys, *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in totals])
    joined = rows.join(F.broadcast(offsets), ["__part", *keys])
    return joined.select(*frame.columns, *[(F.col(f"__{k}") + F.col(f"__before_{k}")).alias(k) for k in totals])


def row_numbers(frame: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """Adds the rows' numbers from 0 in the given order."""
    return running_totals(frame, order, {name: F.lit(1).cast("long")}, within).withColumn(name, F.col(name) - 1)


def long_form(rows: DataFrame, attributes: list[str], id_col: str = "id", kind: str = "float") -> DataFrame:
    """``attr``, ``id``, ``value``: a row for each attribute of each row, all values of one type."""
    pairs = F.array(*[F.struct(F.lit(i).alias("attr"), F.col(a).cast(kind).alias("value")) for i, a in enumerate(attributes)])
    return rows.select(F.col(id_col).alias("id"), F.explode(pairs).alias("x")).select("x.attr", "id", "x.value")


def ranks(values: DataFrame) -> DataFrame:
    """``attr``, ``id``, ``rnk``: 0-based ranks by (value, id) of rows ``attr``, ``id``, ``value``."""
    return row_numbers(values, ["value", "id"], "rnk", ["attr"]).select("attr", "id", "rnk")


def filter_ranges(filters: DataFrame) -> DataFrame:
    """``qid``, ``attr``, ``low``, ``high``: a row for each range of each query."""
    return filters.select("qid", F.posexplode("bounds").alias("attr", "b")).select("qid", "attr", F.col("b.low").cast("float").alias("low"), F.col("b.high").cast("float").alias("high"))


def rank_ranges(values: DataFrame, filters: DataFrame) -> DataFrame:
    """``qid``, ``attr``, ``lo``, ``hi``, ``span``: closed rank ranges of value ranges, (1, 0) if empty.

    Values and bounds are merged in one order, a low end before the values that
    equal it and a high end after them; the running count of values at an end
    is its rank. Values are counted first, so that one row per distinct value
    is ordered: work grows with values and queries, not with their product.
    Null values are in no range, a null low end is open, a null high end holds nothing.
    """
    counts = values.where("value is not null").groupBy("attr", "value").agg(F.count("*").alias("n"))
    wanted = filter_ranges(filters)
    ends = [wanted.select("attr", F.col(end).alias("value"), F.lit(side).alias("side"), F.lit(0).cast("long").alias("n"), "qid") for end, side in (("low", 0), ("high", 2))]
    rows = counts.select("attr", "value", F.lit(1).alias("side"), "n", F.lit(None).cast("long").alias("qid")).unionByName(ends[0]).unionByName(ends[1])
    placed = running_totals(rows, ["value", "side"], {"before": F.col("n")}, ["attr"]).where("side <> 1")
    found = placed.groupBy("qid", "attr").agg(F.max(F.when(F.col("side") == 0, F.col("before"))).alias("lo"), (F.max(F.when(F.col("side") == 2, F.col("before"))) - 1).alias("hi"))
    empty = F.col("lo") > F.col("hi")
    return found.select("qid", "attr", F.when(empty, 1).otherwise(F.col("lo")).cast("long").alias("lo"), F.when(empty, 0).otherwise(F.col("hi")).cast("long").alias("hi")).withColumn("span", F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0).cast("long")))


def codes(values: DataFrame) -> DataFrame:
    """``attr``, ``id``, ``code``: dense 0-based codes of the distinct values; equal values share one."""
    distinct = row_numbers(values.select("attr", "value").distinct(), ["value"], "code", ["attr"])
    return values.join(distinct, ["attr", "value"]).select("attr", "id", F.col("code").cast("int").alias("code"))


def bound_codes(values: DataFrame, filters: DataFrame) -> DataFrame:
    """``qid``, ``attr``, ``low_code``, ``high_code``: closed code ranges that select what the value ranges do."""
    ones = values.select("attr", "value").distinct().withColumn("id", F.lit(0))
    return rank_ranges(ones, filters).select("qid", "attr", F.col("lo").cast("int").alias("low_code"), F.col("hi").cast("int").alias("high_code"))


def rank_ordered(rows: DataFrame, attribute: str, id_col: str = "id") -> DataFrame:
    """Rows in the physical order of one attribute, for files whose row groups a range can skip."""
    return rows.repartitionByRange(attribute, id_col).sortWithinPartitions(attribute, id_col)

"""Choice of the navigation attribute and of the strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def choose_navigation(spans: DataFrame, queries: DataFrame, indexed: list[int], weights: dict[int, float] | None = None, fixed: int | None = None) -> DataFrame:
    """``qid``, ``nav_attr``, ``span``, ``fallback`` from rows ``qid``, ``attr``, ``span``, ``active``.

    Among the indexed attributes that a query constrains, the one with the
    least span (times its weight) navigates, the lowest number of equals; an
    empty span therefore wins at once. ``fixed`` names the only candidate. A
    query without a candidate has a null attribute and falls back to a scan.
    """
    if fixed is not None and fixed not in indexed:
        raise ValueError("the fixed attribute is not indexed")
    own = spans.where(F.col("active") & F.col("attr").isin([fixed] if fixed is not None else indexed or [-1]))
    weight = F.lit(1.0)
    for a, w in (weights or {}).items():
        weight = F.when(F.col("attr") == a, F.lit(float(w))).otherwise(weight)
    best = own.withColumn("cost", F.col("span") * weight).groupBy("qid").agg(F.min(F.struct("cost", "attr", "span")).alias("x"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.col("x.attr").alias("nav_attr"), F.col("x.span").alias("span"), F.col("x").isNull().alias("fallback"))


def narrowest_by_value(ranges: DataFrame) -> DataFrame:
    """``qid``, ``primary_attr``: the attribute with the least raw width max(0, high - low + 1), the lowest of equals."""
    width = F.greatest(F.col("high").cast("double") - F.col("low").cast("double") + 1, F.lit(0.0))
    return ranges.withColumn("width", width).groupBy("qid").agg(F.min(F.struct("width", "attr")).alias("x")).select("qid", F.col("x.attr").alias("primary_attr"))


def hybrid_choice(legal: DataFrame, threshold: int) -> DataFrame:
    """Adds ``choice``: the exact prefilter for queries with at most ``threshold`` legal rows, the graph for others."""
    return legal.withColumn("choice", F.when(F.col("legal_n") <= threshold, "prefilter").otherwise("graph"))


def expected_matches(n: int, ratios: DataFrame) -> DataFrame:
    """``qid``, ``expected``: rows times the product of the attributes' ratios, as if these were independent."""
    return ratios.groupBy("qid").agg((F.lit(float(n)) * F.product("ratio")).alias("expected"))


def histogram(choices: DataFrame) -> DataFrame:
    return choices.groupBy("nav_attr").agg(F.count("*").alias("n"))

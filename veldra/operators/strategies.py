"""Exact forms of the query strategies: prefilter with counts, and post-filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.functions.predicates import in_ranges
from veldra.functions.vectors import squared_l2
from veldra.operators.exact import candidates, exact_topk, pairs, ranked, with_queries


def range_filter(base: DataFrame, queries: DataFrame, attributes: list[str], masked: bool = False) -> DataFrame:
    """``qid``, ``id`` of all rows in the ranges of each stated query."""
    active = F.col("active") if masked else None
    wanted = queries.select("qid", "bounds", *(["active"] if masked else []))
    return pairs(base.select("id", *attributes), wanted, in_ranges([F.col(a) for a in attributes], F.col("bounds"), active)).select("qid", "id")


def legal_counts(base: DataFrame, queries: DataFrame, attributes: list[str]) -> DataFrame:
    """``qid``, ``legal_n``: rows in all ranges; 0 is kept."""
    found = range_filter(base, queries, attributes).groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("legal_n"))


def prefilter(base: DataFrame, queries: DataFrame, primary: DataFrame, attributes: list[str], k: int) -> DataFrame:
    """``qid``, ``scanned`` (in the primary range), ``passed`` (in all ranges), ``rank``, ``id``; a query without rows has one row of nulls.

    The primary slice comes first and is only counted; what is measured is at most k rows a query and task, of those that pass.
    """
    wanted = queries.select("qid", "bounds").join(primary, "qid").select("qid", "bounds", "primary_attr")
    masks = F.transform(F.array(*[F.lit(i) for i in range(len(attributes))]), lambda i: i == F.col("primary_attr"))
    columns = [F.col(a) for a in attributes]
    in_slice, passes = in_ranges(columns, F.col("bounds"), masks), in_ranges(columns, F.col("bounds"))
    counts = pairs(base.select("id", *attributes), wanted, in_slice).groupBy("qid").agg(F.count("*").alias("scanned"), F.count_if(passes).alias("passed"))
    top = exact_topk(base, queries, k, attributes).select("qid", "rank", "id")
    counted = queries.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("scanned", F.lit(0)).alias("scanned"), F.coalesce("passed", F.lit(0)).alias("passed"))
    return counted.join(top, "qid", "left")


def sliced_files(spark, path: str, attribute: str, low: float, high: float) -> DataFrame:
    """The slice of files that ``ranks.rank_ordered`` laid out: row groups outside the range are not read."""
    return spark.read.parquet(path).where(F.col(attribute).between(low, high))


def postfilter(base: DataFrame, queries: DataFrame, attributes: list[str], candidate_k: int, k: int) -> DataFrame:
    """``qid``, ``raw_n``, ``passed_n``, ``rank``, ``id``: the nearest ``candidate_k`` rows first, their predicates after."""
    near = candidates(base, queries, candidate_k).withColumn("dist", squared_l2(F.col("v"), F.col("qv")))
    raw = ranked(near, candidate_k).select("qid", "id", "dist")
    judged = raw.join(base.select("id", *attributes), "id")
    judged = with_queries(judged, queries.select("qid", "bounds")).withColumn("ok", in_ranges([F.col(a) for a in attributes], F.col("bounds")))
    counts = judged.groupBy("qid").agg(F.count("*").alias("raw_n"), F.count_if("ok").alias("passed_n"))
    kept = ranked(judged.where("ok"), k).select("qid", "rank", "id")
    counted = queries.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("raw_n", F.lit(0)).alias("raw_n"), F.coalesce("passed_n", F.lit(0)).alias("passed_n"))
    return counted.join(kept, "qid", "left")


def legal_rows(base: DataFrame, queries: DataFrame, attributes: list[str]) -> DataFrame:
    """``qid``, ``id``, ``dist`` of all rows in the ranges, measured."""
    near = pairs(base.select("id", "v", *attributes), queries.select("qid", "qv", "bounds"), in_ranges([F.col(a) for a in attributes], F.col("bounds")))
    return near.select("qid", "id", squared_l2(F.col("v"), F.col("qv")).alias("dist"))


def legal_among(proposed: DataFrame, base: DataFrame, queries: DataFrame, attributes: list[str]) -> DataFrame:
    """``legal_rows`` of the proposed ``qid``, ``id`` alone: they are looked up by id, and no other pair is made."""
    near = with_queries(proposed.select("qid", "id").distinct().join(base.select("id", "v", *attributes), "id"), queries.select("qid", "qv", "bounds"))
    return near.where(in_ranges([F.col(a) for a in attributes], F.col("bounds"))).select("qid", "id", squared_l2(F.col("v"), F.col("qv")).alias("dist"))

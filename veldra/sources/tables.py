"""Text tables of attributes and filters, snapshots and their metadata."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions.predicates import float_bounds, parse_attributes
from veldra.operators.overlay import snapshot
from veldra.operators.ranks import row_numbers
from veldra.session import stored
from veldra.sources import binary


def read_attributes(spark: SparkSession, path: str, attributes: list[str], expected: int | None = None) -> DataFrame:
    """A headerless table ``id,attr0,...``: ids must be 0 .. n - 1, each once, and values finite."""
    rows = spark.read.schema("id long, " + ", ".join(f"{a} float" for a in attributes)).csv(path)
    bad = F.count_if(F.greatest(*[F.col(a).isNull() | F.isnan(a) | (F.abs(F.col(a)) == float("inf")) for a in attributes], F.lit(False)))
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi"), bad.alias("bad")).first()
    if seen.n != seen.d or seen.n and (seen.lo != 0 or seen.hi != seen.n - 1) or seen.bad or expected is not None and seen.n != expected:
        raise ValueError("ids are not 0 .. n - 1, each once, or values are not finite")
    return rows


def read_filters(spark: SparkSession, path: str, attributes: int) -> DataFrame:
    """``qid``, ``profile``, ``primary_attr``, ``bounds``, ``active`` of a table with a header.

    ``profile`` and ``query_attrs`` are found by name and may be absent; bounds
    are the columns ``attr<i>_low`` and ``attr<i>_high``.
    """
    rows = spark.read.option("header", True).csv(path)
    profile = F.col("profile") if "profile" in rows.columns else F.lit("all")
    bounds = float_bounds([(F.col(f"attr{i}_low"), F.col(f"attr{i}_high")) for i in range(attributes)])
    active = F.array(*[F.lit(True)] * attributes)
    if "query_attrs" in rows.columns:  # the few masks that a table names are parsed once, and a wrong one refuses the table
        named = rows.select(F.coalesce("query_attrs", F.lit("")).alias("m")).distinct().collect()
        for m in sorted(r.m for r in named):
            active = F.when(F.coalesce("query_attrs", F.lit("")) == m, F.array(*map(F.lit, parse_attributes(m, attributes)))).otherwise(active)
    return rows.select(F.col("query_idx").cast("long").alias("qid"), profile.alias("profile"), F.col("primary_attr").cast("int").alias("primary_attr"), bounds.alias("bounds"), active.alias("active"))


def write_snapshot(live: DataFrame, path: str, next_id: int, sequence: int, next_version: int) -> None:
    """Rows with dense local ids and a one-row table of the allocator."""
    snapshot(live).write.parquet(f"{path}/rows")
    live.sparkSession.createDataFrame([(next_id, sequence, next_version)], "next_id long, sequence long, next_version long").write.parquet(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int | None]]:
    """The rows and the allocator of a snapshot; one without ``next_id`` (an old one) reads as None and allows no inserts."""
    meta = spark.read.parquet(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/rows"), {k: (meta[k] if k in meta else None) for k in ("next_id", "sequence", "next_version")}


def export_snapshot(live: DataFrame, folder: str, attributes: list[str], next_id: int, sequence: int, next_version: int) -> int:
    """The four files of a snapshot on a shared mount: vectors, attributes, the mapping to stable ids, and the counters as ``key=value`` lines."""
    os.makedirs(folder, exist_ok=True)
    rows = stored(snapshot(live), "snapshot")
    n = binary.write_fbin(rows, f"{folder}/base.snapshot.fbin", "local_id", "v")
    binary.write_ibin(rows, f"{folder}/snapshot_to_original.ibin", "local_id", "id")
    rows.select("local_id", *attributes).repartitionByRange("local_id").sortWithinPartitions("local_id").write.mode("overwrite").csv(f"{folder}/attrs.snapshot.csv")
    with open(f"{folder}/snapshot.meta", "w", encoding="utf-8") as file:
        file.write(f"rows={n}\nnext_original_id={next_id}\nsequence={sequence}\nnext_version={next_version}\n")
    return n


def import_snapshot(spark: SparkSession, folder: str, attributes: list[str], allow_legacy: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The rows ``local_id``, ``id``, ``v`` and attributes, and the counters; metadata without a high-water mark is refused, or with ``allow_legacy`` reads as 0."""
    with open(f"{folder}/snapshot.meta", encoding="utf-8") as file:
        meta = {k: int(v) for k, _, v in (line.strip().partition("=") for line in file) if k}
    if "next_original_id" not in meta:
        if not allow_legacy:
            raise ValueError("the snapshot has no high-water mark")
        meta["next_original_id"] = 0
    vectors = spark.read.format("fbin").option("path", f"{folder}/base.snapshot.fbin").load().select(F.col("id").alias("local_id"), "v")
    ids = spark.read.format("ibin").option("path", f"{folder}/snapshot_to_original.ibin").load().select(F.col("pos").alias("local_id"), F.col("value").alias("id"))
    values = spark.read.schema("local_id long, " + ", ".join(f"{a} float" for a in attributes)).csv(f"{folder}/attrs.snapshot.csv")
    return ids.join(vectors, "local_id").join(values, "local_id"), meta


def write_groundtruth(rows: DataFrame, root: str) -> None:
    """Static ground truth ``bucket``, ``qid``, ``l``, ``r``, ``rank``, ``id``, one folder a bucket."""
    rows.repartition("bucket").sortWithinPartitions("bucket", "qid", "rank").write.partitionBy("bucket").mode("errorifexists").parquet(root)


def read_groundtruth(spark: SparkSession, root: str, buckets: int = 7) -> DataFrame:
    """Ground truth of all buckets; refused if one is missing."""
    rows = spark.read.parquet(root)
    found = {r.bucket for r in rows.select("bucket").distinct().collect()}
    if found != set(range(buckets)):
        raise ValueError(f"buckets {sorted(set(range(buckets)) - found)} are missing")
    return rows


def read_legacy_groundtruth(spark: SparkSession, path: str) -> DataFrame:
    """``l``, ``r``, ``ids`` of headerless comma tables whose second and third fields are a range and whose eighth holds ids parted by spaces."""
    fields = F.split("value", ",")
    ids = F.transform(F.filter(F.split(F.trim(F.get(fields, F.lit(7))), r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))
    return spark.read.text(path).where(F.size(fields) >= 8).select(F.get(fields, F.lit(1)).cast("int").alias("l"), F.get(fields, F.lit(2)).cast("int").alias("r"), ids.alias("ids"))


def write_results(per_query: DataFrame, path: str) -> None:
    """A line of JSON for each query ``q``, ``ms``, ``dist``, ``hops``, ``ids``, ``distances``, in the order of queries."""
    per_query.repartitionByRange("q").sortWithinPartitions("q").write.mode("errorifexists").json(path)


def per_query_results(results: DataFrame, work: DataFrame) -> DataFrame:
    """Rows for ``write_results`` from results ``qid``, ``rank``, ``id``, ``dist`` and ``work`` ``qid``, ``ms``, ``dist``, ``hops``."""
    lists = results.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "dist"))).alias("x"))
    joined = work.join(lists, "qid", "left")
    empty = F.array().cast("array<struct<rank:int,id:long,dist:double>>")
    x = F.coalesce("x", empty)
    return joined.select(F.col("qid").alias("q"), "ms", "dist", "hops", F.transform(x, lambda r: r["id"]).alias("ids"), F.transform(x, lambda r: r["dist"]).alias("distances"))


def freeze_inputs(queries: DataFrame, folder: str) -> None:
    """Queries ``qid``, ``qv``, ``profile``, ``primary_attr``, ``bounds`` as a vector file and a table of filters, numbered from 0 in the order of ids."""
    os.makedirs(folder, exist_ok=True)
    rows = stored(row_numbers(queries, ["qid"], "query_idx"), "frozen")
    binary.write_fbin(rows, f"{folder}/queries.fbin", "query_idx", "qv")
    width = rows.agg(F.max(F.size("bounds"))).first()[0] or 0
    bounds = [F.get("bounds", F.lit(i))[end].alias(f"attr{i}_{end}") for i in range(width) for end in ("low", "high")]
    filters = rows.select("query_idx", "profile", "primary_attr", *bounds).repartitionByRange("query_idx").sortWithinPartitions("query_idx")
    filters.write.mode("errorifexists").option("header", True).csv(f"{folder}/filters.csv")

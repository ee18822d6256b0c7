"""Tables over measured runs: ablations, replays, comparisons, and checks of exported evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ablation(runs: DataFrame) -> DataFrame:
    """``mode``, ``ef``: runs, recall of all queries, pooled latency with its deviation over runs, and work per query.

    ``runs`` has ``mode``, ``ef``, ``run``, ``queries``, ``recall``, ``ms``, ``hops``, ``distances``, ``pruned``, ``insufficient`` (a
    count). Means are weighted by queries, QPS is that of the pooled mean latency, not a mean of rates.
    """

    def pooled(c: str) -> Column:
        return (F.sum(F.col(c) * F.col("queries")) / F.sum("queries")).alias(c)

    return runs.groupBy("mode", "ef").agg(
        F.count("*").alias("runs"), F.sum("queries").alias("queries"), pooled("recall"), pooled("ms"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("ms_std"),
        (1000.0 * F.sum("queries") / F.sum(F.col("ms") * F.col("queries"))).alias("qps"), pooled("hops"), pooled("distances"), pooled("pruned"), F.max("insufficient").alias("insufficient"),
    )


def replay_summary(values: DataFrame, variants: list[str], metrics: list[str]) -> DataFrame:
    """``variant``, ``metric``, ``runs``, ``mean``, ``std``, ``least``, ``largest`` and ``complete`` for every variant and metric that is asked for.

    ``values`` has ``variant``, ``metric``, ``run``, ``value``. A cell is complete if it has every run that any cell has, each once.
    """
    spark = values.sparkSession
    cells = spark.createDataFrame([(v, m) for v in variants for m in metrics], "variant string, metric string")
    every = values.agg(F.sort_array(F.collect_set("run")).alias("every"))
    found = values.groupBy("variant", "metric").agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("least"), F.max("value").alias("largest"), F.sort_array(F.collect_list("run")).alias("own"))
    joined = cells.join(found, ["variant", "metric"], "left").crossJoin(F.broadcast(every))
    return joined.select("variant", "metric", F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), "mean", "std", "least", "largest", F.coalesce(F.col("own") == F.col("every"), F.lit(False)).alias("complete"))


def evidence_checks(rows: DataFrame, columns: list[str], keys: list[str], source: str = "source", digest: str = "sha256") -> DataFrame:
    """One row of counts over exported evidence: missing ``columns``, repeated keys, null keys, and sources with more than one digest."""
    missing = len(set(columns) - set(rows.columns))
    repeated = rows.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("repeated_keys"))
    nulls = rows.agg(F.count_if(F.least(*[F.col(k).isNotNull().cast("int") for k in keys], F.lit(1)) == 0).alias("null_keys"))
    clashing = rows.groupBy(source).agg(F.count_distinct(digest).alias("d")).agg(F.count_if(F.col("d") > 1).alias("clashing_sources"))
    return repeated.crossJoin(nulls).crossJoin(clashing).select(F.lit(missing).cast("long").alias("missing_columns"), "repeated_keys", "null_keys", "clashing_sources")


def regressions(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose value is gone, new, or differs by more than the relative tolerance: the keys, ``old``, ``new``, ``kind``."""
    both = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("was")).join(new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("is")), keys, "full")
    kind = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.abs(F.col("new") - F.col("old")) > tolerance * F.abs(F.col("old")), "changed")
    return both.select(*keys, "old", "new", kind.alias("kind")).where("kind IS NOT NULL")


def key_comparison(points: DataFrame, ours: str, floor: float) -> DataFrame:
    """``workload``, the operating points ``ms`` and ``other_ms`` at or above a recall floor, and the ``speedup`` over the best other method.

    ``points`` has ``workload``, ``method``, ``ef``, ``recall``, ``ms``; of each method its fastest setting counts.
    """
    best = points.where(F.col("recall") >= floor).groupBy("workload", "method").agg(F.min("ms").alias("ms"))
    own = best.where(F.col("method") == ours).select("workload", "ms")
    other = best.where(F.col("method") != ours).groupBy("workload").agg(F.min(F.struct("ms", "method")).alias("x")).select("workload", F.col("x.method").alias("other"), F.col("x.ms").alias("other_ms"))
    return own.join(other, "workload", "full").select("workload", "ms", "other", "other_ms", (F.col("other_ms") / F.col("ms")).alias("speedup"))


def file_manifest(spark, path: str) -> DataFrame:
    """``path``, ``bytes`` and ``sha256`` of every file under a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of two manifests that are gone, new or different."""
    both = old.select("path", F.col("sha256").alias("was")).join(new.select("path", F.col("sha256").alias("now")), "path", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))

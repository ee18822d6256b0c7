"""Recall, audits and summaries of query results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tolerances for distances that a result reports.
RELATIVE, ABSOLUTE = 2e-5, 1e-5


def recall(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid``, ``recall``: hits over min(k, size of the truth); 1 if the truth is empty."""
    want = truth.groupBy("qid").agg(F.count("*").alias("n"))
    hits = results.select("qid", "id").distinct().join(truth.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("h"))
    joined = queries.select("qid").join(want, "qid", "left").join(hits, "qid", "left")
    n = F.least(F.lit(k), F.coalesce("n", F.lit(0)))
    return joined.select("qid", F.when(n == 0, 1.0).otherwise(F.coalesce("h", F.lit(0)) / n).alias("recall"))


def tie_recall(results: DataFrame, truth: DataFrame, legal: DataFrame, queries: DataFrame, k: int, tolerance: float = 0.0) -> DataFrame:
    """``qid``, ``tie_recall``: hits strictly inside the truth's radius, and any legal rows at the radius for the slots that are left.

    ``legal`` has ``qid``, ``id``, ``dist`` of all legal rows. ``radius_recall``
    counts every legal row within the radius.
    """
    radius = truth.groupBy("qid").agg(F.max("dist").alias("radius"), F.count("*").alias("n"))
    slack = F.when(F.lit(tolerance > 0), F.greatest(F.lit(1e-9), F.col("radius") * 1e-7)).otherwise(F.lit(0.0))
    inside = truth.join(radius, "qid").groupBy("qid").agg(F.count_if(F.col("dist") < F.col("radius") - slack).alias("strict"))
    got = results.select("qid", "id").distinct().join(legal, ["qid", "id"]).join(radius, "qid")
    hits = got.groupBy("qid").agg(F.count_if(F.col("dist") < F.col("radius") - slack).alias("hs"), F.count_if(F.abs(F.col("dist") - F.col("radius")) <= slack).alias("hb"))
    rows = queries.select("qid").join(radius, "qid", "left").join(inside, "qid", "left").join(hits, "qid", "left").na.fill(0, ["n", "strict", "hs", "hb"])
    n = F.least(F.lit(k), F.col("n"))
    credit = F.least("hs", "strict") + F.least(F.col("hb"), n - F.least("strict", n))
    return rows.select("qid", F.when(n == 0, 1.0).otherwise(credit / n).alias("tie_recall"), F.when(n == 0, 1.0).otherwise(F.least(n, F.col("hs") + F.col("hb")) / n).alias("radius_recall"))


def audit(results: DataFrame, base_ids: DataFrame, legal: DataFrame, queries: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """One row of counts over results ``qid``, ``id``, ``dist``.

    ``illegal_ids`` don't exist, ``illegal`` fail a predicate, ``duplicates``
    repeat an id, ``mismatched`` report another distance, ``insufficient``
    queries have fewer valid results than min(k, legal rows), ``empty_errors``
    have results though no row is legal. With ``targets`` (``qid``, ``n``: all
    legal rows of a query, none left out as 0) ``legal`` may lack rows that are no results.
    """
    known = base_ids.select("id", F.lit(True).alias("known"))
    judged = results.join(known, "id", "left").join(legal.select("qid", "id", F.col("dist").alias("true_dist")), ["qid", "id"], "left")
    wrong = F.abs(F.col("dist") - F.col("true_dist")) > ABSOLUTE + RELATIVE * F.abs(F.col("true_dist"))
    counts = judged.agg(F.count_if(F.col("known").isNull()).alias("illegal_ids"), F.count_if(F.col("known").isNotNull() & F.col("true_dist").isNull()).alias("illegal"), F.count_if(wrong).alias("mismatched"))
    repeats = results.groupBy("qid", "id").agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))
    valid = judged.where(F.col("true_dist").isNotNull()).select("qid", "id").distinct().groupBy("qid").agg(F.count("*").alias("valid"))
    returned = results.groupBy("qid").agg(F.count("*").alias("returned"))
    target = legal.groupBy("qid").agg(F.count("*").alias("target")) if targets is None else targets.select("qid", F.col("n").alias("target"))
    per = queries.select("qid").join(valid, "qid", "left").join(returned, "qid", "left").join(target, "qid", "left").na.fill(0)
    short = per.agg(F.count_if(F.col("valid") < F.least(F.lit(k), F.col("target"))).alias("insufficient"), F.count_if((F.col("target") == 0) & (F.col("returned") > 0)).alias("empty_errors"))
    return counts.crossJoin(repeats).crossJoin(short).select("illegal_ids", "illegal", "duplicates", "mismatched", "insufficient", "empty_errors")


def dynamic_audit(results: DataFrame, live: DataFrame, resolved: DataFrame, base: DataFrame, legal: DataFrame, next_id: int | None = None) -> DataFrame:
    """One row of eight violation counts over results ``qid``, ``id``, ``version`` of a mutated dataset."""
    last = resolved.where("accepted").groupBy("id").agg(F.max_by("op", "sequence").alias("last_op"), F.max_by("erased", "sequence").alias("gone"))
    state = live.select("id", F.col("version").alias("live_version"), F.lit(True).alias("alive"))
    judged = results.join(state, "id", "left").join(last, "id", "left").join(base.select("id", F.lit(True).alias("in_base")), "id", "left").join(legal.select("qid", "id", F.lit(True).alias("ok")), ["qid", "id"], "left")
    counts = judged.agg(
        F.count_if(F.col("alive") & (F.col("version") != F.col("live_version"))).alias("stale_version"),
        F.count_if(F.coalesce("gone", F.lit(False))).alias("deleted_id"),
        F.count_if(F.col("alive") & F.col("ok").isNull()).alias("predicate"),
        F.count_if(F.col("in_base").isNull() & F.col("last_op").isNull()).alias("invalid_id"),
        F.count_if((F.col("last_op") == "insert") & F.col("alive").isNull()).alias("inserted_invisible"),
        F.count_if(F.col("last_op").isin("upsert", "attributes") & F.col("alive").isNull()).alias("updated_invisible"),
        F.count_if((F.col("last_op") == "erase") & F.coalesce("alive", F.lit(False))).alias("deleted_visible"),
    )
    repeats = results.groupBy("qid", "id").agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate"))
    return counts.crossJoin(repeats)


def profile_metrics(per_query: DataFrame) -> DataFrame:
    """``profile`` (``total`` for all), ``queries``, ``mean_recall``, ``mean_ms``, ``qps`` from rows ``profile``, ``recall``, ``ms``."""
    rolled = per_query.rollup("profile").agg(F.grouping("profile").alias("g"), F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"), F.avg("ms").alias("mean_ms"), (1000.0 * F.count("*") / F.sum("ms")).alias("qps"))
    return rolled.select(F.when(F.col("g") == 1, "total").otherwise(F.col("profile")).alias("profile"), "queries", "mean_recall", "mean_ms", "qps")


def pooled_latency(times: DataFrame) -> DataFrame:
    """``run``, ``n``, ``mean_ms``, exact interpolating ``p50`` and ``p95``, sample ``std`` (0 for one row), ``qps`` of the pooled mean, from ``run``, ``ms``."""
    return times.groupBy("run").agg(
        F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"),
        F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("std"), (1000.0 * F.count("*") / F.sum("ms")).alias("qps"),
    )


def weighted_mean(runs: DataFrame, keys: list[str], value: str, weight: str = "n") -> DataFrame:
    """Runs pooled by their numbers of queries."""
    return runs.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))


def variability(runs: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Mean, sample deviation (0 for one run), least and largest value of repeated runs."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.max(value).alias("largest"))


def operating_point(curve: DataFrame, floor: float) -> DataFrame:
    """``workload``, ``ef``: the fastest setting whose recall is at least the floor, the smallest ``ef`` of equals."""
    best = curve.where(F.col("recall") >= floor).groupBy("workload").agg(F.min(F.struct("mean_ms", "ef")).alias("x"))
    return best.select("workload", "x.ef")


def parse_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """``name`` and ``metrics`` map of lines ``name key=value key=value``; other lines are left out."""
    line = F.trim(column)
    pairs = F.filter(F.split(line, r"\s+"), lambda x: x.contains("="))
    return lines.where(line.rlike(r"^\S+(\s+\S+=\S+)+$")).select(F.substring_index(line, " ", 1).alias("name"), F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", "")))).alias("metrics"))


def work_metrics(per_query: DataFrame) -> DataFrame:
    """``profile_metrics`` with the means of ``hops``, ``distances``, ``pruned`` and the number of ``insufficient`` queries (a flag)."""
    rolled = per_query.rollup("profile").agg(
        F.grouping("profile").alias("g"), F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"), F.avg("ms").alias("mean_ms"), (1000.0 * F.count("*") / F.sum("ms")).alias("qps"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("hops", "distances", "pruned")], F.count_if("insufficient").alias("insufficient"),
    )
    return rolled.select(F.when(F.col("g") == 1, "total").otherwise(F.col("profile")).alias("profile"), *rolled.columns[2:])


def insufficient(results: DataFrame, truth: DataFrame, legal_counts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid`` and three flags of too few results: ``of_graph`` (fewer than k although k exist), ``of_index`` (fewer than k), ``of_evaluator`` (fewer than min(k, legal rows))."""
    count = lambda rows, name: rows.select("qid", "id").distinct().groupBy("qid").agg(F.count("*").alias(name))
    per = queries.select("qid").join(count(results, "got"), "qid", "left").join(count(truth, "best"), "qid", "left").join(legal_counts.select("qid", "legal_n"), "qid", "left").na.fill(0)
    short = F.col("got") < k
    return per.select("qid", (short & (F.col("best") >= k)).alias("of_graph"), short.alias("of_index"), (F.col("got") < F.least(F.lit(k), F.col("legal_n"))).alias("of_evaluator"))

"""Generation of query workloads: ranges, profiles, traces and subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.operators.ranks import row_numbers

#: Least and most stars of the band around a rating of 1 to 5 (fixed values).
STAR_BANDS = ((1, 2), (1, 3), (2, 4), (3, 5), (4, 5))
DAYS_30 = 30 * 86_400


def centred(value: Column, n: int, ratio: Column) -> tuple[Column, Column]:
    """Ends of the closed rank range of about n times the ratio ranks around a value, shifted to lie in 0 .. n - 1."""
    width = F.least(F.greatest(F.bround(F.lit(float(n)) * ratio), F.lit(1.0)), F.lit(float(n))).cast("long")
    low = F.least(F.greatest(value - F.floor(width / 2), F.lit(0).cast("long")), F.lit(n) - width)
    return low.cast("long"), (low + width - 1).cast("long")


def profile_ratios(attributes: int, narrow: float = 0.1, wide: float = 0.5, balanced: float = 0.3) -> list[tuple[str, list[float]]]:
    """A profile with each attribute narrow and the others wide, and one with all alike."""
    own = [(f"attr{i}_narrow", [narrow if j == i else wide for j in range(attributes)]) for i in range(attributes)]
    return [*own, ("balanced", [balanced] * attributes)]


def selectivity_ratios(attributes: int, shares: list[float]) -> list[tuple[str, list[float]]]:
    """For each total selectivity the equal ratio of independent attributes that gives it."""
    return [(f"sel_{s:g}", [s ** (1 / attributes)] * attributes) for s in shares]


#: The eight total selectivities of the published workload (fixed values).
SELECTIVITIES = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)


def independent_attributes(rows: DataFrame, count: int, seed: int = 2029) -> DataFrame:
    """``attr``, ``id``, ``value``: for each attribute a permutation of 0 .. n - 1, in the order of a hash of seed, attribute and id."""
    mixed = rows.select("id", F.explode(F.array(*map(F.lit, range(count)))).alias("attr")).withColumn("key", F.xxhash64(F.lit(seed), "attr", "id"))
    return row_numbers(mixed, ["key", "id"], "value", ["attr"]).select("attr", "id", "value")


def mixed_attributes(measures: DataFrame, count: int, seed: int = 2029) -> DataFrame:
    """``attr``, ``id``, ``value``: ranks of ``norm2`` and of ``proj``, then hashed permutations, of rows ``id``, ``norm2``, ``proj``."""
    named = measures.select("id", F.posexplode(F.array("norm2", "proj")).alias("attr", "key"))
    own = row_numbers(named, ["key", "id"], "value", ["attr"]).select("attr", "id", "value")
    rest = independent_attributes(measures.select("id"), count - 2, seed).withColumn("attr", F.col("attr") + 2) if count > 2 else own.where("false")
    return own.unionByName(rest)


def single_attribute_queries(ranges: DataFrame, n: int, every: int = 5) -> DataFrame:
    """Ranges ``qid``, ``attr``, ``low``, ``high`` of which every ``every``-th query keeps one attribute's, in turn, and is open in the others."""
    attributes = ranges.agg(F.max("attr") + 1).first()[0] or 1
    kept = (F.pmod("qid", F.lit(every)) != 0) | (F.col("attr") == F.pmod(F.floor(F.col("qid") / every), F.lit(attributes)))
    return ranges.withColumns({"low": F.when(kept, F.col("low")).otherwise(F.lit(0)).cast("long"), "high": F.when(kept, F.col("high")).otherwise(F.lit(n - 1)).cast("long")})


def noisy_queries(anchors: DataFrame, seed: int = 2029, spread: float = 0.01) -> DataFrame:
    """``qid``, ``qv``: anchors ``qid``, ``v`` with hashed noise, uniform between -spread and spread, on every dimension."""
    noise = lambda x, d: (x + spread * (F.pmod(F.xxhash64(F.lit(seed), "qid", d), F.lit(2_000_001)) / 1_000_000.0 - 1)).cast("float")
    return anchors.select("qid", F.transform("v", noise).alias("qv"))


def smoke_ranges(spark, attributes: int) -> DataFrame:
    """``qid``, ``profile``, ``bounds``: an empty range, an equality, infinite ends, and a range that nearly all rows pass."""
    inf = float("inf")
    first = {"empty": (1e9, 2e9), "equality": (3.0, 3.0), "infinite": (-inf, inf), "high_cardinality": (-1.0, 1e9)}
    rows = [(i, name, [own, *[(-inf, inf)] * (attributes - 1)]) for i, (name, own) in enumerate(first.items())]
    return spark.createDataFrame(rows, "qid long, profile string, bounds array<struct<low:float,high:float>>")


def schedule(spark, methods: list[str], repetitions: int, seed: int = 2029) -> DataFrame:
    """``repetition``, ``pos``, ``method``: all methods once in each repetition, in an order of its own."""
    import random

    rows = []
    for r in range(repetitions):
        own = sorted(methods)
        random.Random(seed + r).shuffle(own)
        rows += [(r, i, m) for i, m in enumerate(own)]
    return spark.createDataFrame(rows, "repetition int, pos int, method string")


def centred_ranges(anchors: DataFrame, n: int, profiles: list[tuple[str, list[float]]], one_anchor: bool = False) -> DataFrame:
    """``qid``, ``profile``, ``attr``, ``low``, ``high`` around anchors ``qid``, ``attr``, ``value`` (ranks).

    Queries take the profiles in turn. With ``one_anchor`` the value of
    attribute 0 serves for all, so that the windows lie at equal places.
    """
    spark = anchors.sparkSession
    table = [(k, name, a, float(r)) for k, (name, ratios) in enumerate(profiles) for a, r in enumerate(ratios)]
    own = spark.createDataFrame(table, "k int, profile string, attr int, ratio double")
    turn = F.pmod(F.col("qid"), F.lit(len(profiles))).cast("int").alias("k")
    values = anchors.where("attr = 0").select("qid", turn, "value").join(F.broadcast(own), "k") if one_anchor else anchors.select("qid", turn, "attr", "value").join(F.broadcast(own), ["k", "attr"])
    low, high = centred(F.col("value").cast("long"), n, F.col("ratio"))
    return values.select("qid", "profile", "attr", low.alias("low"), high.alias("high"))


def static_buckets(queries: DataFrame, n: int, ratios: list[float]) -> DataFrame:
    """``bucket``, ``qid``, ``l``, ``r``: for each ratio a closed range of positions at a hashed place."""
    own = queries.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(ratios)], "bucket int, ratio double")
    width = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(float(n)) * F.col("ratio")))
    place = F.pmod(F.crc32(F.concat_ws(":", F.col("qid").cast("string"), F.col("bucket").cast("string")).cast("binary")), F.lit(n) - width + 1)
    return queries.select("qid").crossJoin(F.broadcast(own)).select("bucket", "qid", place.cast("long").alias("l"), (place + width - 1).cast("long").alias("r"))


def part_of(position: Column, n: int, parts: int) -> Column:
    """The part of a position when n positions are inserted in equal parts, the rest in the last."""
    return F.least(F.floor(position / F.lit(max(1, n // parts))), F.lit(parts - 1)).cast("int")


def insert_traces(values: DataFrame, n: int, initial: float = 0.8) -> DataFrame:
    """``trace``, ``pos``, ``id``, ``is_initial``: ids in the order of each attribute, and in a hashed order (``unordered``)."""
    named = values.select(F.concat(F.lit("attr"), F.col("attr").cast("string")).alias("trace"), F.col("value").cast("double").alias("key"), "id")
    mixed = values.where("attr = 0").select(F.lit("unordered").alias("trace"), F.crc32(F.col("id").cast("string").cast("binary")).cast("double").alias("key"), "id")
    rows = row_numbers(named.unionByName(mixed), ["key", "id"], "pos", ["trace"])
    cut = F.bround(F.lit(float(n)) * F.lit(initial)).cast("long")
    return rows.select("trace", "pos", "id", (F.col("pos") < cut).alias("is_initial"))


def app_filters(queries: DataFrame) -> DataFrame:
    """``qid``, ``lows``, ``highs``: length within 30, the 30 days before, and a band of stars, from ``qid``, ``length``, ``time``, ``star``."""
    low = F.element_at(F.array(*[F.lit(a) for a, _ in STAR_BANDS]), F.col("star").cast("int"))
    high = F.element_at(F.array(*[F.lit(b) for _, b in STAR_BANDS]), F.col("star").cast("int"))
    length, time = F.col("length").cast("float"), F.col("time").cast("float")
    lows = F.array((length - 30).cast("float"), (F.col("time") - DAYS_30).cast("float"), low.cast("float"))
    highs = F.array((length + 30).cast("float"), time, high.cast("float"))
    return queries.select("qid", lows.alias("lows"), highs.alias("highs"))


def subset(queries: DataFrame, split: DataFrame) -> DataFrame:
    """``new_qid``, ``qid``: the queries of a split ``pos``, ``qid``, renumbered from 0 in its order."""
    kept = split.join(queries.select("qid"), "qid", "left_semi")
    return row_numbers(kept, ["pos"], "new_qid").select("new_qid", "qid")


def split_parts(rows: DataFrame, n: int, parts: int, position: str = "pos") -> DataFrame:
    """Rows with the ``part`` of about n / parts positions that each belongs to, the last one shorter."""
    return rows.withColumn("part", F.floor(F.col(position) / F.lit(-(-n // parts))).cast("int"))


def synthesised_queries(base: DataFrame, count: int, dim: int, seed: int) -> DataFrame:
    """``qid``, ``qv``: every dimension of a query is copied from a row picked for it by hash."""
    spark = base.sparkSession
    n = base.count()
    slots = spark.range(count).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d"))
    picks = slots.withColumn("pos", F.pmod(F.xxhash64(F.lit(seed), "qid", "d"), F.lit(n)))
    rows = row_numbers(base.select("id", "v"), ["id"], "pos").select("pos", "v")
    parts = picks.join(rows, "pos").select("qid", F.struct("d", F.get("v", F.col("d")).alias("x")).alias("p"))
    return parts.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"]).alias("qv"))

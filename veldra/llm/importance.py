"""Resampling of documents towards a target distribution, by hashed runs of words.

Words are exploded with their positions; of each position, a window over the
document leads to the words that follow, so that runs of every order are
strings of one row. Runs are hashed to buckets, counted over all documents and
over all target texts, and each bucket gets a gain, the logarithm of the ratio
of the two smoothed shares. The gains, a row per bucket, are joined back to the
runs and averaged by document; Gumbel noise from a hash of the id turns the
averages into a sample without replacement.

Counting combines before its shuffle to a row per bucket and task, and sums to
a row per document. Runs of one word need no window, and then no word is
shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators.ranks import row_numbers
from veldra.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, once A-Z is lower-cased: ASCII that is neither a digit nor a small letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets up to which the gains (16 bytes each) are broadcast.
BROADCAST_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def runs(rows: DataFrame, max_order: int) -> DataFrame:
    """``row``, ``doc_id``, ``ord`` and ``run`` of every run of 1 to ``max_order`` words of ``text``; a row without words has one of nulls."""
    placed = rows.select("row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    if max_order == 1:
        return placed.select("row", "doc_id", F.when(F.col("word").isNotNull(), 1).alias("ord"), F.col("word").alias("run"))
    order = Window.partitionBy("row", "doc_id").orderBy("pos")
    led = placed.withColumns({f"next{k}": F.lead("word", k).over(order) for k in range(1, max_order)})
    following = ["word", *[f"next{k}" for k in range(1, max_order)]]
    longer = [F.when(F.col(following[n - 1]).isNotNull(), F.struct(F.lit(n).alias("ord"), F.concat_ws(" ", *following[:n]).alias("run"))) for n in range(1, max_order + 1)]
    each = led.select("row", "doc_id", "word", F.explode(F.array(*longer)).alias("x")).where(F.col("x").isNotNull() | F.col("word").isNull())
    return each.select("row", "doc_id", "x.ord", "x.run")


def bucket(buckets: int) -> Column:
    return F.pmod(F.crc32(F.col("run").cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(rows: DataFrame, max_order: int, buckets: int) -> DataFrame:
    """``bucket``, ``n``: how often runs fall in each bucket that any does."""
    found = runs(rows, max_order).where("run is not null")
    return found.groupBy(bucket(buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, max_order: int, buckets: int) -> DataFrame:
    """``bucket`` and ``gain`` (in thousandths, rounded down) of every bucket."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    source, wanted = bucket_counts(docs, max_order, buckets).withColumnRenamed("n", "s"), bucket_counts(target, max_order, buckets).withColumnRenamed("n", "t")
    counts = stored(every.join(source, "bucket", "left").join(wanted, "bucket", "left").fillna(0), "bucket-counts")
    in_docs, in_target = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = ((F.col("t") + 1) * (in_docs + buckets)).cast("double") / ((F.col("s") + 1) * (in_target + buckets)).cast("double")
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = 10, max_order: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every input row.

    ``target`` has the column ``text``. The weight is the mean gain of the row's
    runs, rounded down, 0 without runs; the score adds the noise. ``rank`` is 1
    for the highest score, equal ones by ascending id, among the drawn rows:
    ``share`` percent, rounded down, of those with ``min_words`` words. Others
    have null. A null text is empty, a null id sorts first and has the noise of
    an empty id; repeated rows are weighed and ranked each by itself, texts of
    any length whole; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wanted = target.select(F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_bucket = gains(rows, wanted, max_order, buckets)
    by_bucket = F.broadcast(by_bucket) if buckets <= BROADCAST_BUCKETS else by_bucket
    hashed = runs(rows, max_order).select("row", "doc_id", "ord", bucket(buckets).alias("bucket"))
    summed = hashed.join(by_bucket, "bucket", "left").groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.count_if(F.col("ord") == 1).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    scored = stored(summed.withColumn("weight", mean.cast("long")).withColumn("score", (F.col("weight") + noise(seed)).cast("long")), "weights")
    few, lower = F.col("n_words") < min_words, -F.col("score")
    drawn = scored.where(~few).count() * share // 100
    placed = row_numbers(scored.withColumns({"few": few, "lower": lower}), ["few", "lower", "doc_id"], "place")
    rank = F.when(~F.col("few") & (F.col("place") < drawn), F.col("place") + 1).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))

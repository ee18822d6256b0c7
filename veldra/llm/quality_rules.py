"""Quality rules of documents and of their hosts, all in DataFrame functions.

A document fails a base rule by itself. Failures are then aggregated by host:
a host's failure rate is shrunk towards the rate of all hosts with a beta prior
whose strength is estimated, by moments, from the spread of the hosts' rates,
so that a host of few documents is not condemned by one of them. Documents of
hosts whose shrunk rate is above ``max_host_rate`` are not kept either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.session import scratch

#: Rules of a document: least words, and most percent of words in repeated windows.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected above this shrunk rate of failed documents.
MAX_HOST_RATE = 0.5
#: Hosts up to which their verdicts are broadcast; beyond it they are joined by a shuffle.
BROADCAST_HOSTS = 100_000

SPACES = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that the list holds twice or more.

    Windows are compared by 64-bit hashes. Each word is hashed once; the hashes
    of two neighbouring windows give that of one twice as wide, and two that
    overlap that of any width between. Only if two windows are equal are they
    sorted with their places; the places of equal neighbours, in order, then
    give the words covered.
    """

    def joined(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(step + 1), F.size(h) - step), lambda a, b: F.xxhash64(a, b)))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(width), p - acc["last"])).alias("total")), lambda acc: acc["total"])

    def of_windows(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        equal = let(placed, lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull()))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(F.sort_array(equal)))

    def of_words(w: Column) -> Column:
        hashes, wide = F.transform(w, lambda x: F.xxhash64(x)), 1
        while wide < width:
            step = min(wide, width - wide)
            hashes, wide = joined(hashes, step), wide + step
        return F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(let(hashes, of_windows))

    return let(words, of_words)


def measure(text: Column) -> Column:
    """A struct of the base measures and ``base_failed`` for a text; a null text has no word."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, SPACES + " ", "")) > 0)
    base = F.struct(
        text.alias("text"),
        words_of(text).alias("words"),
        lines.alias("lines"),
    )

    def measures(x: Column) -> Column:
        return F.struct(
            F.size(x["words"]).cast("long").alias("n_words"),
            F.length(F.translate(x["text"], SPACES + " ", "")).cast("long").alias("word_chars"),
            (F.length(x["text"]) - F.length(F.translate(x["text"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(x["words"]).alias("n_repeat_words"),
        )

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        return F.struct(*[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"))

    return let(let(base, measures), verdict)


def host_verdicts(failures: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host``, ``n_docs``, ``n_failed``, ``host_rate`` (shrunk) and ``host_rejected`` from rows of ``host`` and ``failed``.

    The prior has the mean rate of all documents and the strength that the
    variance of the hosts' rates tells; without a spread it is infinite, and
    all hosts then have the mean rate.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_pop(rate).alias("spread"))
    prior = moments.select("mean", F.when(F.col("spread") > 0, F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1, F.lit(0.0))).alias("strength"))
    shrunk = F.when(F.col("strength").isNull(), F.col("mean")).otherwise((F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength")))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > max_host_rate)


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: list[str] | None = None, max_host_rate: float = MAX_HOST_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Rows (``row`` struct of the input columns ``keep``, all if None, ``base`` measures, ``host_rate``, ``kept``) for every input row.

    The struct keeps input columns apart from the results, whatever their
    names. A null host is a host of its own kind (all such rows together); a
    null text has no word, one of any length is measured whole; repeated rows
    each count and each give a row; an empty table gives no rows. Measured rows are written once to the shared
    folder, so that texts are measured once. Verdicts of up to ``broadcast_hosts`` hosts are broadcast and no text is
    shuffled; of more hosts, kept columns are shuffled by host, a host with a large share in parts where adaptive
    execution splits it.
    """
    spark = docs.sparkSession
    path = scratch(spark, "rules")
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    docs.select(row.alias("row"), measure(F.col(f"`{text_col}`")).alias("base"), F.col(f"`{host_col}`").alias("host")).write.parquet(path)
    measured = spark.read.parquet(path)
    verdicts = host_verdicts(measured.select("host", F.col("base.base_failed").alias("failed")), max_host_rate)
    path = scratch(spark, "hosts")
    verdicts.write.parquet(path)
    verdicts = spark.read.parquet(path).select(F.col("host").alias("of_host"), "host_rate", "host_rejected")
    few = verdicts.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    joined = measured.join(F.broadcast(verdicts) if few else verdicts, F.col("host").eqNullSafe(F.col("of_host")))
    return joined.select("row", "base", "host_rate", (~F.col("base.base_failed") & ~F.col("host_rejected")).alias("kept"))

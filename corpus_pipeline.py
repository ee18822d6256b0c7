"""A corpus pipeline in stages; each works on all rows that the one before it kept.

In every stage a null text is empty, texts of any length are read whole, rows
without an id take part, an empty table gives an empty one, and extra columns of
any name are kept as they are up to the last stage. Repeated rows count as one
document in line dedup, of which SimHash keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import bpe, decontam, line_dedup, quality_rules, simhash
from veldra.llm.common import table, text_hash
from veldra.llm.queries import bpe_digest, vocabulary
from veldra.session import stored

#: Contaminated documents up to which they are broadcast (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_LEAKS = 200_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host does."""
    return quality_rules.quality_rules(docs).where("kept").select("row.*")


def drop_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template an earlier document has; ``n_chars`` follows the text."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return line_dedup.line_dedup(docs).select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; input columns stay apart from the verdicts, whatever their names."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = stored(found.select(F.col("doc_id").alias("leak_id"), F.col("hash").alias("leak_hash")).distinct(), "leaks")
    few = leaks.limit(BROADCAST_LEAKS + 1).count() <= BROADCAST_LEAKS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_hash(F.col("text")).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("leak_id")) & (F.col("own_hash") == F.col("leak_hash"))
    return rows.join(F.broadcast(leaks) if few else leaks, same, "left_anti").select("row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, its token ids, and the digests of the ids and of the text decoded from them."""
    rows = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json"))
    return rows.select("doc_id", "ids", *bpe_digest())


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_templates),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("bpe", to_tokens),
]

#: SQL can express neither SimHash components nor BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage before it returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs

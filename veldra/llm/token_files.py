"""Token ids in Parquet files that allow selective reads.

A file holds the rows of a range of ids, in ascending order: ``doc_id``,
``n_tokens`` and ``file_start`` (tokens before the document in its file) in
delta encoding, and ``tokens`` in dictionary encoding. Row groups are small and
pages hold few rows, each with column and offset indexes, so that a reader can
take the metadata without any token, or the tokens of some ids without the
other pages. A document's place in the corpus is its place in its file plus
the tokens of the files before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.llm.common import id_text, text_chunks
from veldra.llm.word_pieces import CHUNK_BYTES, word_pieces
from veldra.session import ship_package

#: Bytes of text that one file holds at most, besides a longer document: more text makes more ranges of ids.
RANGE_BYTES = 256 << 20
#: Characters of a text that order, and part, the rows of one id.
LEAD = 16

#: Writer settings of the format.
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 256
PAGE_BYTES = 256 << 10

SCHEMA = "doc_id long, file_start long, n_tokens long, tokens array<int>"


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the files under ``path``.

    One shuffle deals whole texts out by ranges of ids; they are encoded after
    it. There are as many ranges as the session's shuffle partitions, and more
    if a range would pass RANGE_BYTES of text, which a first pass adds up.

    Null or empty texts have the end id alone. Null ids come first; rows of one
    id stand in the order of their texts' first LEAD characters, and if they
    are too many for one file they go on in the next. A text of any length is
    encoded whole. Repeated rows are written as often as they come, other
    columns are ignored whatever their names, an empty table writes no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_pieces(vocabulary)
        before = 0
        for chunk in text_chunks(batches, most=CHUNK_BYTES):
            ids, counts = own.encode_texts(chunk.column("text"))
            rows = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rows))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(before + ends - counts), pa.array(counts), tokens], ["doc_id", "file_start", "n_tokens", "tokens"])
            before += int(ends[-1])

    rows = id_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, usual = -(-size // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "lead", "nth"]  # the last parts an id with too many rows of one beginning
    keyed = rows.withColumns({"lead": F.left("text", F.lit(LEAD)), "nth": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(ranges, *keys) if ranges > usual else keyed.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    writer = ordered.mapInArrow(kernel, SCHEMA).write.mode("errorifexists")
    settings = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": "true",
        "maxRecordsPerFile": 0,
        "compression": "snappy",
    }
    for key, value in settings.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``offset`` (tokens of all files before it): one row per file, from the metadata columns alone."""
    files = spark.read.parquet(path).select(F.input_file_name().alias("file"), "doc_id", "n_tokens")
    sizes = files.groupBy("file").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n_tokens").alias("tokens"))
    order = Window.orderBy(F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), F.length("file"), "file")  # files of one id are numbered
    return sizes.select("file", (F.sum("tokens").over(order) - F.col("tokens")).alias("offset"))


def read_token_files(spark: SparkSession, path: str, where: Column | None = None, tokens: bool = True) -> DataFrame:
    """The documents of the files: ``doc_id``, ``start``, ``n_tokens`` and, if asked for, ``tokens``.

    ``where`` is a condition on ``doc_id`` or ``n_tokens``, pushed to the row
    groups and pages; with ``tokens`` false no token page is read. The table of
    offsets has a row per file, a number that the writer's partitions bound.
    """
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.where(where)
    own = ["doc_id", "file_start", "n_tokens", *(["tokens"] if tokens else [])]
    rows = rows.select(*own, F.input_file_name().alias("file"))
    placed = rows.join(F.broadcast(file_offsets(spark, path)), "file")
    return placed.select("doc_id", (F.col("file_start") + F.col("offset")).alias("start"), "n_tokens", *(["tokens"] if tokens else []))


def checksum(token_lists: DataFrame) -> DataFrame:
    """Adds ``ids_crc32``: the unsigned CRC-32 of the tokens as little-endian unsigned 32-bit integers."""
    import zlib

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in token_lists.drop("tokens").schema) + ", ids_crc32 long"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values, offsets = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            kept = [n for n in batch.schema.names if n != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sums, pa.int64())], [*kept, "ids_crc32"])

    return token_lists.mapInArrow(kernel, schema)

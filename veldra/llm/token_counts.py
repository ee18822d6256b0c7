"""Token counts from distinct pre-tokens.

Each pre-token that a chunk of a partition holds is encoded once, and the
number of its pieces is all that is kept of it. These counts are joined, by
the pre-token's code, to the documents' pre-token frequencies and summed. No
document's ids are ever made. The join stays within a chunk, so nothing is
shuffled and a hot pre-token costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import id_text, text_chunks
from veldra.llm.word_pieces import CHUNK_BYTES, word_pieces
from veldra.session import ship_package


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row.

    A null or empty text has 0 of both; a text of any length is counted whole.
    Every row gives one row, whatever repeats; columns besides the two read are
    ignored, whatever their names. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_pieces(path)
        for chunk in text_chunks(batches, most=CHUNK_BYTES):
            counts = pa.array(own.count_texts(chunk.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_text(docs, id_col, text_col).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.mapInArrow(kernel, "doc_id long, n_bytes long, n_tokens long")

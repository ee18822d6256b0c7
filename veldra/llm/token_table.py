"""White-space tokens of a chunk of texts as codes into their distinct strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens whose attributes are laid out at once.
TOKEN_BLOCK = 1 << 17


def coded_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all tokens in order, each text's bounds in them, and the distinct tokens (the empty one stands for no token)."""
    parted = pc.utf8_split_whitespace(texts)
    coded = parted.flatten().dictionary_encode()
    bounds = np.asarray(parted.offsets, dtype=np.int64)
    return np.asarray(coded.indices, dtype=np.int64), bounds - bounds[0], coded.dictionary.to_pylist()


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over each text's tokens; values may have columns. A text without tokens has 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        out[filled] = np.add.reduceat(values, bounds[filled], axis=0)
    return out


def attribute_sums(table: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each text's sums of its tokens' rows of ``table``, a block of tokens at a time: memory doesn't grow with a text's length times the columns."""
    out = np.zeros((len(bounds) - 1, table.shape[1]))
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for at in range(0, len(codes), TOKEN_BLOCK):
        own = rows[at : at + TOKEN_BLOCK]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[starts]] += np.add.reduceat(table[codes[at : at + TOKEN_BLOCK]], starts, axis=0)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``limit`` labelled documents, those whose hashed ids come first.

    ``usable`` is a condition on the column ``doc_id``. Null labels don't
    count; of several labels of an id the largest does, and of several rows of
    an id the one whose text has the least hash, the least of equals. The chosen
    ids are at most ``limit`` rows of 12 bytes, and so they are broadcast to one
    scan; of an id's rows one is left before the shuffle.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    first = lambda frame: frame.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = first(rows.where(usable).groupBy("doc_id").agg(F.max("label").alias("label")))
    found = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"), F.first("label").alias("label"))
    return found.select("doc_id", "one.text", "label")


def held_out(divisor: int, remainder: int) -> Column:
    """Whether crc32 of ``doc_id`` as text leaves the remainder; an id that is null is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == remainder, F.lit(False))

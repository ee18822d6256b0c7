"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel works on at once; bounds its memory whatever the batch holds.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, as ``doc_id`` and ``text``; a null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart; a null text has the hash of the empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of text each, a longer row alone."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for row, length in enumerate(lengths):
            if size and size + (length or 0) > most:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def return_blocks() -> None:
    """Give memory that a kernel has freed back to the system: a worker goes on to other groups, and the allocators would keep it for them."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


class Known:
    """A bounded table of what a worker knows of pre-tokens: the number of pieces and, if kept, their ids.

    ``make`` gives both for new ones. Beyond ``most`` entries the half that is
    used least goes. Strings lie in an Arrow array and numbers in NumPy's.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep_ids: bool, most: int):
        self.make, self.keep_ids, self.most = make, keep_ids, most
        self.words = pa.array([], pa.string())
        self.sizes = self.uses = self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct pre-tokens stand in the table; those that it lacks are encoded together and added."""
        if len(self.words) > self.most:
            self._shrink()
        if len(self.words):
            found = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1))
        else:
            found = np.full(len(words), -1, dtype=np.int32)
        found = found.astype(np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            added = words.take(pa.array(new))
            sizes, ids = self.make(added.to_pylist())
            found[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, added])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int32)])
            if self.keep_ids:
                self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes])
                self.ids = np.concatenate([self.ids, ids])
        self.uses[found] += 1
        return found

    def gather(self, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in order, given by codes into places, and where each one's ids end."""
        per = self.sizes[at][codes]
        ends = np.cumsum(per, dtype=np.int64)
        place = np.repeat(self.starts[at][codes] - ends + per, per)
        place += np.arange(len(place))
        return self.ids[place], ends

    def _shrink(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        self.words, self.uses, sizes = self.words.take(pa.array(stay)), self.uses[stay] >> 1, self.sizes[stay]
        if self.keep_ids:
            ends = np.cumsum(sizes, dtype=np.int64)
            self.ids = self.ids[np.repeat(self.starts[stay] - (ends - sizes), sizes) + np.arange(ends[-1])]
            self.starts = ends - sizes
        self.sizes = sizes

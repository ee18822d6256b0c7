"""Byte-pair encoding and decoding with a pair occurrence index.

All distinct pre-tokens of a chunk of a partition are laid out as one linked
list of symbols. An index maps every mergeable pair, named by its rank, to all
positions where it stands. Active ranks are taken in ascending order from a
heap; a rank is applied at all its positions at once, and the lists of the
pairs that this creates are extended. Words are never looked at again one by
one, and no pair is searched for.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import Known, id_text, text_chunks
from veldra.session import ship_package

#: Distinct pre-tokens that a worker keeps encoded; beyond it the half that is used least goes.
CACHE_ENTRIES = 300_000

#: Bytes of text that are cut at once: their pre-tokens are strings of Python, some twenty times as large.
CHUNK_BYTES = 1 << 20

#: The byte-level pre-tokenisation pattern that the vocabulary is published with (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Characters whose classes are the same in every Unicode version; other texts are cut by the library itself.
STABLE = regex.compile(r"[\t\n\r\x20-\x7e\xa0-ɏЀ-ҁҊ-ӿ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]*+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _check(spec: dict) -> None:
    """Refuse a file whose texts are handled otherwise than this module does."""
    cutter = spec.get("pre_tokenizer") or {}
    right = spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    if not right or spec["model"].get("type", "BPE") != "BPE" or any(spec["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        raise ValueError("the vocabulary's normaliser, pre-tokenizer or model is not of the kind that this operator reads")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t.get("content") for t in spec["added_tokens"]):
        raise ValueError("an added token is matched otherwise than by its plain string")


class PairIndexCodec:
    """Encoder and decoder of one byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        _check(spec)
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.byte_ids = [vocab.get(alphabet[b], -1) for b in range(256)]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_start = os.path.commonprefix(list(self.specials))  # a text without it has no special token
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.left, self.right, self.merged = [], [], []
        self.ranks: dict[int, int] = {}
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            made.setdefault(z, rank)
            self.left.append(x), self.right.append(y), self.merged.append(z)
            self.ranks[x << 32 | y] = rank
        if any(max(made.get(x, -1), made.get(y, -1)) >= rank for rank, (x, y) in enumerate(zip(self.left, self.right))):
            raise ValueError("a merge uses a symbol that a later merge makes")
        self.byte_table = np.array(self.byte_ids, dtype=np.int64)
        self.byte_pairs = np.array([self.ranks.get(x << 32 | y, -1) if x >= 0 <= y else -1 for x in self.byte_ids for y in self.byte_ids], dtype=np.int64)
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.path = path
        self.back = back
        self.token_sizes = np.array([len(b) for b in self.token_bytes], dtype=np.int32)
        self.token_starts = np.cumsum(self.token_sizes, dtype=np.int64) - self.token_sizes
        self.token_flat = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self.cache = Known(self.encode_new, True, CACHE_ENTRIES)

    @cached_property
    def library(self):
        """The tokenizers library's own form of the file, read when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no special token."""
        if text.isascii() or STABLE.fullmatch(text):
            return PATTERN.findall(text)
        return [bytes(self.back[c] for c in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each distinct pre-token or special token has, and all ids."""
        special = np.array([self.specials.get(w, -1) for w in words], dtype=np.int32)
        sizes, ids = self.merge_all(["" if s >= 0 else w for w, s in zip(words, special.tolist())])
        at = np.flatnonzero(special >= 0)
        ends = np.cumsum(sizes, dtype=np.int64)
        sizes[at] = 1
        return sizes, np.insert(ids, ends[at], special[at])

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all; one pair occurrence index serves all of them."""
        if not any(words):
            return np.zeros(len(words), dtype=np.int32), np.empty(0, dtype=np.int32)
        ranks = self.ranks
        raw = [word.encode() for word in words]
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        starts = np.concatenate([[0], ends[:-1]])
        octets = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        symbols = self.byte_table[octets]
        if (symbols < 0).any():
            raise ValueError("a byte is missing from the vocabulary")
        following, previous = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        filled = ends > starts
        following[ends[filled] - 1] = previous[starts[filled]] = -1
        # The index at first: positions of every pair of bytes that merges, by rank.
        pair_ranks = np.append(self.byte_pairs[octets[:-1] << 8 | octets[1:]], -1)
        pair_ranks[ends[filled] - 1] = -1
        held = np.flatnonzero(pair_ranks >= 0)
        held = held[np.argsort(pair_ranks[held], kind="stable")]
        own = pair_ranks[held]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        held_list, firsts = held.tolist(), cuts.tolist()
        index = {rank: held_list[x:y] for rank, x, y in zip(own[cuts].tolist(), firsts, [*firsts[1:], len(held_list)])}
        sym, after, before = symbols.tolist(), following.tolist(), previous.tolist()
        rank_of, known = ranks.get, index.get
        active = sorted(index)  # a sorted list is a heap
        while active:
            rank = heappop(active)
            places = index.pop(rank)
            a, b, made = self.left[rank], self.right[rank], self.merged[rank]
            places.sort()
            for i in places:
                if sym[i] != a:
                    continue
                j = after[i]
                if j < 0 or sym[j] != b:
                    continue
                k, h = after[j], before[i]
                sym[i], sym[j] = made, -1
                after[i] = k
                if k >= 0:
                    before[k] = i
                    new = rank_of(made << 32 | sym[k])
                    if new is not None:
                        own = known(new)
                        if own is None:
                            index[new] = [i]
                            heappush(active, new)
                        else:
                            own.append(i)
                if h >= 0:
                    new = rank_of(sym[h] << 32 | made)
                    if new is not None:
                        own = known(new)
                        if own is None:
                            index[new] = [h]
                            heappush(active, new)
                        else:
                            own.append(h)
        final = np.array(sym, dtype=np.int32)
        left = final >= 0
        counts = np.concatenate([[0], np.cumsum(left)])
        return (counts[ends] - counts[starts]).astype(np.int32), final[left]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of whole texts in order, as the library gives them without added special tokens, and each text's bounds in them."""
        words: list[str] = []
        bounds = [0]
        for text in texts:
            if self.special_pattern is not None and self.special_start in text and self.special_pattern.search(text):
                at = 0
                for found in self.special_pattern.finditer(text):
                    words += self.cut(text[at : found.start()]) if found.start() > at else []
                    words.append(found.group())
                    at = found.end()
                text = text[at:]
            if text:
                words += self.cut(text)
            bounds.append(len(words))
        if not words:
            return np.empty(0, dtype=np.int32), np.zeros(len(bounds), dtype=np.int64)
        coded = pa.array(words, pa.string()).dictionary_encode()
        del words
        ids, ends = self.cache.gather(self.cache.places(coded.dictionary), np.asarray(coded.indices))
        return ids, np.concatenate([[0], ends])[bounds]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, bounds = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def decode_flat(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of lists of ids, special tokens included; ids outside the vocabulary give nothing, bytes that are no UTF-8 the replacement character."""
        known = (ids >= 0) & (ids < len(self.token_sizes))
        safe = np.where(known, ids, 0)
        sizes = np.where(known, self.token_sizes[safe], 0)
        ends = np.cumsum(sizes, dtype=np.int64)
        place = np.repeat(self.token_starts[safe] - ends + sizes, sizes)
        place += np.arange(len(place))
        octets = self.token_flat[place]
        cuts = np.concatenate([[0], ends])[bounds]
        if len(octets) < 1 << 31:
            texts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(octets))
            try:
                texts.validate(full=True)
                return texts
            except pa.ArrowInvalid:
                pass
        return pa.array([octets[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])], pa.string())

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_flat(ids, np.array([0, len(ids)]))[0].as_py()


@lru_cache(maxsize=2)
def codec(path: str) -> PairIndexCodec:
    """A worker's codec for a vocabulary file; the file must lie on every machine at that path."""
    return PairIndexCodec(path)


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of every row, in one pass and without a shuffle.

    A null or empty text has no ids, one of any length is encoded whole. Rows, ids and columns besides the two read
    may repeat, be null or clash with the result's names: every row gives one row.
    """
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for chunk in text_chunks(batches, most=CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), _lists(*own.encode_flat(chunk.column("text").to_pylist()))], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(kernel, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded string`` of every row; a null list decodes to the empty text."""
    ship_package(encoded.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            bounds = np.asarray(lists.offsets, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own.decode_flat(np.asarray(lists.flatten().fill_null(-1)), bounds - bounds[0])], ["doc_id", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(kernel, "doc_id long, decoded string")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and the text ``decoded`` from these ids, both in one pass over the rows."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for chunk in text_chunks(batches, most=CHUNK_BYTES):
            ids, bounds = own.encode_flat(chunk.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), _lists(ids, bounds), own.decode_flat(ids, bounds)], ["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(kernel, "doc_id long, ids array<int>, decoded string")

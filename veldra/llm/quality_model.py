"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: hashed words with damped counts, and a binned
value of each statistic of its structure and of its size. Every feature has a
weight and a vector of ``RANK`` factors; all pairs of features interact by the
product of their factors. The sum over pairs is taken in linear time, as half
of (the square of the sum less the sum of the squares) of each factor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veldra.llm.common import id_text, text_chunks
from veldra.llm.token_table import attribute_sums, coded_tokens
from veldra.session import ship_package

#: Most labelled documents that the model is fitted on.
TRAIN_ROWS = 10_000
#: Buckets of hashed words, and factors of a feature.
BUCKETS = 1 << 15
RANK = 8
EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 6, 450, 128, 0.05, 1e-5, 11
#: Tokens a worker keeps the attributes of.
CACHE_ENTRIES = 300_000

#: Marks taken off a word's ends, and symbols (fixed values).
EDGES = ".,;:!?\"'()#*$%&|<>"
SYMBOLS = str.maketrans("", "", "#*$%&|<>@{}\\~^=+")
ENDS = (".", "!", "?")

#: Borders of the bins of each statistic.
SHARES = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8])
SIZES = np.array([0, 3, 8, 15, 30, 60, 120, 250, 500, 1000, 3000, 10000], dtype=float)
WIDTHS = np.array([1, 2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15], dtype=float)
STATISTICS = (
    ("words", SIZES), ("characters", SIZES * 6), ("lines", SIZES), ("word_length", WIDTHS), ("words_per_line", SIZES), ("distinct", SHARES), ("capitals", SHARES), ("capital_words", SHARES),
    ("digits", SHARES), ("symbols", SHARES), ("marks", SHARES), ("ends", SHARES), ("pipes", SHARES), ("long_words", SHARES), ("short_words", SHARES), ("top_word", SHARES), ("repeated_lines", SHARES),
)
WIDE = len(SIZES) + 1
FEATURES = BUCKETS + WIDE * len(STATISTICS)


class Vectors:
    """Sparse vectors of whole texts; attributes of a distinct token are made once."""

    def __init__(self):
        self.cache: dict[str, tuple[float, ...]] = {}

    def attributes(self, token: str) -> tuple[float, ...]:
        bare = token.strip(EDGES)
        word = bare.lower()
        if bare.isalpha() or not bare:
            letters, digits = len(bare), 0
        else:
            letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
        upper = 0 if word == bare else sum(map(str.isupper, token))
        symbols = 0 if word == token or bare == token and bare.isalpha() else len(token) - len(token.translate(SYMBOLS))
        return (
            float(zlib.crc32((word or token).encode("utf-8", "surrogatepass")) % BUCKETS), float(len(token)), float(upper), float(upper > 1 and token.isupper()), float(digits),
            float(symbols), float(len(token) - letters - digits), float(token[-1:] in ENDS), float(token == "|"), float(len(token) > 12), float(len(token) < 3),
        )

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, values, and each text's bounds in them."""
        codes, bounds, distinct = coded_tokens(texts)
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for t in distinct:
            if t not in cache:
                cache[t] = self.attributes(t)
        table = np.array([cache[t] for t in distinct]).reshape(-1, 11)
        filled = np.array([bool(t) for t in distinct], dtype=bool)
        rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
        there = filled[codes] if len(codes) else np.zeros(0, dtype=bool)
        codes, rows = codes[there], rows[there]
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        total = attribute_sums(table, codes, bounds)
        bucket = table[:, 0].astype(np.int64) if len(table) else np.zeros(1, dtype=np.int64)
        n = np.diff(bounds).astype(float)
        words, chars = np.maximum(n, 1), np.maximum(total[:, 1], 1)
        pairs, counts = np.unique(rows * BUCKETS + bucket[codes], return_counts=True)
        owner = pairs // BUCKETS
        different = np.bincount(owner, minlength=len(texts))
        most = np.zeros(len(texts))
        np.maximum.at(most, owner, counts)
        lines, repeated = np.zeros(len(texts)), np.zeros(len(texts))
        for i, text in enumerate(texts.to_pylist()):
            own = [x for x in text.split("\n") if x.strip()]
            lines[i], repeated[i] = len(own), len(own) - len(set(own))
        values = (n, total[:, 1] + n, lines, total[:, 1] / words, n / np.maximum(lines, 1), different / words, total[:, 2] / chars, total[:, 3] / words, total[:, 4] / chars, total[:, 5] / chars, total[:, 6] / chars, total[:, 7] / words, total[:, 8] / words, total[:, 9] / words, total[:, 10] / words, most / words, repeated / np.maximum(lines, 1))
        bins = np.stack([BUCKETS + k * WIDE + np.searchsorted(borders, v, side="left") for k, ((_, borders), v) in enumerate(zip(STATISTICS, values))], axis=1)
        damped = np.log1p(counts)
        norm = np.sqrt(np.bincount(owner, damped**2, minlength=len(texts)))
        weights = damped / norm[owner]
        width = different + bins.shape[1]
        out = np.concatenate([[0], np.cumsum(width)])
        features, scaled = np.empty(out[-1], dtype=np.int64), np.empty(out[-1])
        first = np.concatenate([[0], np.cumsum(different)])
        at = np.arange(len(pairs)) - first[owner] + out[owner]
        features[at], scaled[at] = pairs % BUCKETS, weights
        at = out[:-1, None] + different[:, None] + np.arange(bins.shape[1])
        features[at], scaled[at] = bins, 1 / np.sqrt(bins.shape[1])
        return features, scaled, out


class Machine:
    """Bias, weights and factors; ``margin`` is linear in the number of features present."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor
        self.vectors: Vectors | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vectors": None}

    def margin(self, features: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        scaled = self.factor[features] * values[:, None]
        total, squares = np.add.reduceat(scaled, bounds[:-1]), np.add.reduceat(scaled**2, bounds[:-1])
        return self.bias + np.add.reduceat(self.weight[features] * values, bounds[:-1]) + 0.5 * (total**2 - squares).sum(axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        self.vectors = self.vectors or Vectors()
        return 1 / (1 + np.exp(-self.margin(*self.vectors(texts))))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
    """Logistic loss by mini-batches with adaptive steps, EPOCHS times over the rows and STEPS batches at least; the same rows always give the same machine."""
    rnd = np.random.default_rng(SEED)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    machine = Machine(float(np.log(rate / (1 - rate))), np.zeros(FEATURES), rnd.normal(0, 0.02, (FEATURES, RANK)))
    seen_w, seen_f, seen_b = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6), 1e-6
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(BATCH, len(rows))))):
        order = rnd.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            features = np.concatenate([rows[i][0] for i in own])
            values = np.concatenate([rows[i][1] for i in own])
            sizes = np.array([len(rows[i][0]) for i in own])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            excess = 1 / (1 + np.exp(-machine.margin(features, values, bounds))) - y[own]
            scaled = machine.factor[features] * values[:, None]
            total = np.repeat(np.add.reduceat(scaled, bounds[:-1]), sizes, axis=0)
            each = np.repeat(excess, sizes) * values
            which, where = np.unique(features, return_inverse=True)
            g_w = np.bincount(where, each, len(which)) / len(own) + DECAY * machine.weight[which]
            pull = each[:, None] * (total - scaled)
            g_f = np.stack([np.bincount(where, pull[:, k], len(which)) for k in range(RANK)], axis=1) / len(own) + DECAY * machine.factor[which]
            g_b = excess.mean()
            seen_b += g_b**2
            seen_w[which] += g_w**2
            seen_f[which] += g_f**2
            machine.bias -= RATE * g_b / np.sqrt(seen_b)
            machine.weight[which] -= RATE * g_w / np.sqrt(seen_w[which])
            machine.factor[which] -= RATE * g_f / np.sqrt(seen_f[which])
    return machine


def fit(sample: DataFrame) -> Machine:
    """A machine from ``doc_id``, ``text`` and ``label`` of at most TRAIN_ROWS documents; the driver gets their sparse vectors.

    Labels of one kind alone give their (smoothed) share as every score, no labels at all a half.
    """
    ship_package(sample.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectors()
        for chunk in text_chunks(batches):
            features, values, bounds = own(chunk.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (features.astype(np.int32), values.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("label"), *lists], ["doc_id", "label", "f", "x"])

    found = sample.mapInArrow(kernel, "doc_id long, label int, f array<int>, x array<float>").toArrow().sort_by("doc_id")
    y = np.array([float(v > 0) for v in found.column("label").to_pylist()])
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES), np.zeros((FEATURES, RANK)))
    rows = [(np.array(f.as_py(), dtype=np.int64), np.array(x.as_py())) for f, x in zip(found.column("f"), found.column("x"))]
    return fit_machine(rows, y)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row, null and empty texts included, in one pass over whole texts.

    The machine has FEATURES x (RANK + 1) numbers, 2.4 MB, whatever the table
    holds. Other columns are ignored, whatever their names, repeated rows score
    alike, an empty table gives no rows. A text longer than a chunk is read
    alone and whole; memory is then a few times its size.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(shared.value.score(chunk.column("text")))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(kernel, "doc_id long, score double")

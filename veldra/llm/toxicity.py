"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a lexicon (words and word beginnings, learned from
labelled documents and joined with their de-obfuscated forms), the nearness of
second-person words to them, and rates of capitals, punctuation and
obfuscation. Trees are fitted on one part of the labelled documents, from which
the lexicon comes too; an isotonic map from their sums to probabilities is
fitted on the other part, which neither has seen.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import id_text, text_chunks
from veldra.llm.token_table import attribute_sums, coded_tokens, sums
from veldra.session import ship_package

#: Most labelled documents that the model is fitted on.
TRAIN_ROWS = 20_000
#: Entries of the lexicon, and documents that an entry must be in.
LEXICON_ENTRIES = 4000
LEXICON_MIN_DOCS = 5
#: Every such labelled document, by crc32 of its id, calibrates.
CALIBRATION_PART = 4
#: Share of the trees' own probability in a score: it tells documents of one step of the isotonic map apart.
OWN_SHARE = 0.02
#: Tokens a worker keeps the attributes of.
CACHE_ENTRIES = 300_000
#: Bytes of text that share a table of tokens.
CHUNK_BYTES = 8 << 20

TREES, DEPTH, RATE, BINS, LEAF_PENALTY, LEAF_LEAST = 80, 3, 0.15, 32, 2.0, 10

#: Words for the person spoken to, in the languages covered (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os vuestro".split())
#: Signs that stand for letters in obfuscated words (fixed values).
STAND_INS = str.maketrans("013457@$!|", "oieastasil")
EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’…-–—*#%&$|/\\_~`+="
INNER = str.maketrans("", "", ".-_*'’·/\\+~")

ODD = re.compile(r"[013457@$!|*._-]")
STRETCHED = re.compile(r"(.)\1\1")

PREFIXES = (4, 5, 6)


def core(token: str) -> str:
    return token.strip(EDGES).lower()


def revealed(token: str) -> str:
    """The word that an obfuscated token stands for: its inner marks taken out and stand-ins put back."""
    return token.lower().strip(".,;:?\"'()").translate(INNER).translate(STAND_INS).strip(EDGES)


def keys(word: str) -> list[str]:
    """The lexicon keys of a word: itself, and its beginnings if it is longer than them."""
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)] if word else []


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log odds of the keys that labelled documents of ``text`` and ``label`` tell apart best."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for chunk in text_chunks(batches):
            for text, label in zip(chunk.column("text").to_pylist(), chunk.column("label").to_pylist()):
                y = int(label > 0)
                n[y] += 1
                found[y].update({k for t in set(text.split()) for k in keys(core(t))})
        every = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array([*every, ""]), pa.array([*(found[0][k] for k in every), n[0]], pa.int64()), pa.array([*(found[1][k] for k in every), n[1]], pa.int64())], ["key", "clean", "toxic"])

    counts = sample.select("text", "label").mapInArrow(kernel, "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.where("key = ''").first()
    if total is None or not total.toxic or not total.clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(total.toxic) + 1.0)) - F.log((F.col("clean") + 0.5) / (F.lit(total.clean) + 1.0))
    best = counts.where((F.col("key") != "") & (F.col("toxic") >= LEXICON_MIN_DOCS)).withColumn("odds", odds).where("odds > 2.5").orderBy(F.desc("odds"), "key").limit(LEXICON_ENTRIES)
    return {r.key: r.odds for r in best.collect()}


NAMES = (
    "lexicon_density", "lexicon_count", "lexicon_weight", "stem_density", "stem_count", "revealed_density", "second_person", "near_density", "near_count",
    "capital_letters", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "single_letters", "stretched", "digits", "symbols", "word_length", "log_words",
)


class Features:
    """Dense features of whole texts; attributes of a distinct token are made once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.stems = {k[:-1]: odds for k, odds in lexicon.items() if k[-1:] == "~"}
        self.heads = {k[: PREFIXES[0]] for k in self.stems}
        self.cache: dict[str, tuple[float, ...]] = {}

    def stem(self, word: str) -> float:
        """The largest odds of the word's beginnings."""
        if word[: PREFIXES[0]] not in self.heads:
            return 0.0
        return max(self.stems.get(word[:n], 0.0) if len(word) > n else 0.0 for n in PREFIXES)

    def attributes(self, token: str) -> tuple[float, ...]:
        if not token:
            return (0.0,) * 15
        bare = token.strip(EDGES)
        word = bare.lower()
        whole = self.lexicon.get(word, 0.0)
        stem = self.stem(word)
        odd = hidden = 0.0
        if bare.isalpha() or not bare:
            letters, digits = len(bare), 0
        else:
            letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
            plain = revealed(token)
            if letters and plain != word and ODD.search(bare):
                odd = 1.0
                if not whole and not stem:
                    hidden = max(self.lexicon.get(plain, 0.0), self.stem(plain))
        upper = 0 if word == bare else sum(map(str.isupper, token))
        return (
            float(whole > 0), max(whole, stem, hidden), float(stem > 0), float(hidden > 0), float(word in SECOND_PERSON), float(upper), float(upper > 1 and token.isupper()),
            float(token.count("!")), float(token.count("?")), float(len(token) - letters - digits), odd, float(letters == 1 and len(word) == 1), float(STRETCHED.search(token) is not None), float(digits), float(letters),
        )

    def __call__(self, texts: pa.Array) -> np.ndarray:
        codes, bounds, distinct = coded_tokens(texts)
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for t in distinct:
            if t not in cache:
                cache[t] = self.attributes(t)
        table = np.array([cache[t] for t in distinct]).reshape(-1, 15)
        real = np.array([bool(t) for t in distinct])
        total = attribute_sums(table, codes, bounds)
        real = real if len(real) else np.zeros(1, dtype=bool)
        table = table if len(table) else np.zeros((1, 15))
        n = sums(real[codes].astype(float), bounds)
        weight = table[:, 1][codes]
        hits = (weight > 0).astype(float)
        you = np.concatenate([[0], np.cumsum(table[:, 4][codes])])
        place = np.arange(len(codes))
        lengths = np.diff(bounds)
        low, high = np.repeat(bounds[:-1], lengths), np.repeat(bounds[1:], lengths)
        near = hits * ((you[np.minimum(high, place + 6)] - you[np.maximum(low, place - 5)]) > 0)
        nears, hit = sums(near, bounds), sums(hits, bounds)
        most = np.zeros(len(texts))
        filled = lengths > 0
        if len(codes):
            most[filled] = np.maximum.reduceat(weight, bounds[:-1][filled])
        words, chars = np.maximum(n, 1), np.maximum(total[:, 14] + total[:, 13] + total[:, 9], 1)
        letters = np.maximum(total[:, 14], 1)
        columns = (
            hit / words, np.log1p(hit), most, total[:, 2] / words, np.log1p(total[:, 2]), total[:, 3] / words, total[:, 4] / words, nears / words, np.log1p(nears),
            total[:, 5] / letters, total[:, 6] / words, total[:, 7] / words, total[:, 8] / words, total[:, 9] / chars, total[:, 10] / words, total[:, 11] / words, total[:, 12] / words, total[:, 13] / chars, total[:, 9] / words, total[:, 14] / words, np.log1p(n),
        )
        return np.stack(columns, axis=1)


class Trees:
    """Boosted trees of the logistic loss with second-order leaf values; every tree has all nodes to its depth."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Histogram boosting; ties between cuts go to the first feature and lowest cut."""
    rows, wide = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(wide)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    base = math.log(rate / (1 - rate))
    margin = np.full(rows, base)
    inner = 2**DEPTH - 1
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(rows, dtype=np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            local = node - first
            best = np.full(width, 1e-6)
            chosen = np.zeros((width, 2), dtype=np.int64) - 1
            for j in range(wide):
                if not len(edges[j]):
                    continue
                cell = local * BINS + binned[:, j]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                ns = np.bincount(cell, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + LEAF_PENALTY) + (gt - gs) ** 2 / (ht - hs + LEAF_PENALTY) - gt**2 / (ht + LEAF_PENALTY)
                gain[(ns < LEAF_LEAST) | (nt - ns < LEAF_LEAST)] = 0
                gain = gain[:, : len(edges[j])]
                at = gain.argmax(axis=1)
                won = gain[np.arange(width), at] > best
                best[won] = gain[np.arange(width), at][won]
                chosen[won, 0], chosen[won, 1] = j, at[won]
            split = np.zeros(rows, dtype=bool)
            for k in range(width):
                j, at = chosen[k]
                if j >= 0:
                    feature[first + k], cut[first + k] = j, edges[j][at]
                    split |= (local == k) & (binned[:, j] > at)
            node = 2 * node + 1 + split
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + LEAF_PENALTY)
        margin += value[leaf]
        features.append(feature), cuts.append(cut), leaves.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(leaves))


class Isotonic:
    """A rising step map, read with straight lines between the means of its blocks."""

    def __init__(self, margins: np.ndarray, y: np.ndarray):
        blocks: list[list[float]] = []
        points, where, counts = np.unique(margins, return_inverse=True, return_counts=True)  # equal margins are one point
        hits = np.bincount(where, y, len(points))
        for m, hit, n in zip(points.tolist(), hits.tolist(), counts.tolist()):
            blocks.append([hit, n, m * n])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                top = blocks.pop()
                last = blocks[-1]
                last[0], last[1], last[2] = last[0] + top[0], last[1] + top[1], last[2] + top[2]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.p = np.array([b[0] / b[1] for b in blocks])

    def __call__(self, margins: np.ndarray) -> np.ndarray:
        return np.interp(margins, self.x, self.p)


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, calibrated: Isotonic | None, constant: float):
        self.lexicon, self.trees, self.calibrated, self.constant = lexicon, trees, calibrated, constant
        self.features: Features | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"features": None}

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        self.features = self.features or Features(self.lexicon)
        margins = self.trees(self.features(texts))
        own = 1 / (1 + np.exp(-margins))
        return np.clip((1 - OWN_SHARE) * self.calibrated(margins) + OWN_SHARE * own, 0.0, 1.0) if self.calibrated is not None else own


def fit(sample: DataFrame) -> Model:
    """A model from ``doc_id``, ``text`` and ``label`` of at most TRAIN_ROWS documents.

    Without labels of both kinds every score is the share of label 1 (a half
    if there are no labels). Without both kinds among the documents that
    calibrate, scores are the trees' own probabilities.
    """
    ship_package(sample.sparkSession)
    part = F.pmod(F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")), F.lit(CALIBRATION_PART)) == 0
    lexicon = learn_lexicon(sample.where(~part))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(lexicon)
        for chunk in text_chunks(batches):
            rows = own(chunk.column("text"))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = sorted(sample.mapInArrow(kernel, "doc_id long, label int, x array<double>").collect())
    y = np.array([float(r.label > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return Model({}, None, None, float(y.mean()) if len(y) else 0.5)
    x = np.array([r.x for r in rows])
    calibrates = np.array([zlib.crc32(f"part{r.doc_id}".encode()) % CALIBRATION_PART == 0 for r in rows])
    fitted = ~calibrates if 0 < y[~calibrates].mean() < 1 else np.ones(len(y), dtype=bool)
    trees = fit_trees(x[fitted], y[fitted])
    both = calibrates.any() and 0 < y[calibrates].mean() < 1
    return Model(lexicon, trees, Isotonic(trees(x[calibrates]), y[calibrates]) if both else None, float(y.mean()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row, null and empty texts included, in one pass over whole texts.

    The model has at most LEXICON_ENTRIES words and TREES trees and travels
    with the kernel. Other columns are ignored, whatever their names, repeated
    rows score alike, an empty table gives no rows. A text longer than a chunk
    is read alone and whole; memory is then a few times its size.
    """
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, most=CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(model.score(chunk.column("text")))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(kernel, "doc_id long, score double")

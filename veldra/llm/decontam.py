"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items are indexed: postings sorted by item, in blocks with their
largest impact. An item's impacts are divided by the score that the item's own
text would have, so that one threshold means the same share of any item.
Every document is cut into passages that overlap by half, as wide as two of
the longest items of the index; each passage is a query, and all items at or
above the threshold are retrieved. What is retrieved is verified by the
5-word shingles of the item's question and of its answer that the passage and
its surroundings hold: 0.8 of all of them, and shingles found must cover half
of the words of the question and half of those of the answer.

Inverse document frequencies and the mean length are those of all items,
counted in Spark, however many indexes and passage widths the items make: a
pair has the same score in any of them.

Most passages can't reach the threshold for any item. For a whole chunk of
text at once, the impacts of the rarer terms are summed by passage and item,
and a passage is evaluated only if this sum and all that the item's frequent
terms could add reach the threshold. This is an upper bound, so nothing that
is above the threshold is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import text_chunks, text_hash
from veldra.session import Scratch, ship_package

K1, B = 1.2, 0.75
#: Least share of an item's own BM25 score at which it is retrieved.
THRESHOLD = 0.5
#: Words of a shingle, and the least overlap with question and answer together.
SHINGLE = 5
OVERLAP = 0.8
#: Least share of the words of the question, and of the answer, that shingles found cover. A changed word takes up to
#: five shingles, most of a short answer's, and so parts are measured by the words covered.
PART_OVERLAP = 0.5
#: Postings of a block.
BLOCK = 16
#: Bytes of test items in one broadcast index; more items are indexed in several, one pass over the documents each.
INDEX_BYTES = 32 << 20
#: Terms in more than this share of the items count as frequent.
FREQUENT = 0.1

#: White space besides the plain space, and characters that part words like it, as text.
MARKS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" "\t\n\x0b\f\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—·"


def normalised(text: Column) -> Column:
    """Lower-case words parted by single characters of space."""
    return F.lower(F.translate(F.coalesce(text.cast("string"), F.lit("")), MARKS, " " * len(MARKS)))


def parted(texts: pa.Array) -> pa.Array:
    """The words of normalised texts, of documents and items alike."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))


def words_of(text: str) -> list[str]:
    return [w for w in parted(pa.array([text]))[0].as_py() if w]


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: its last line, else its last sentence, else its last third, is the answer."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    text = text.strip()
    cut = max(text.rstrip(".!? ").rfind(m) for m in (". ", "! ", "? "))
    if cut > 0:
        return text[: cut + 1], text[cut + 1 :]
    words = text.split()
    third = max(1, len(words) // 3)
    return " ".join(words[:-third]), " ".join(words[-third:])


def shingles(words: list[str], width: int = SHINGLE) -> set[str]:
    """The shingles of a part; a part of fewer words is one shingle, an empty one has none."""
    if not words:
        return set()
    width = min(width, len(words))
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def covered(words: list[str], found: set[str], width: int) -> list[bool]:
    """Which words lie in a shingle of ``width`` words that was found."""
    out = [False] * len(words)
    for i in range(len(words) - width + 1 if width else 0):
        if " ".join(words[i : i + width]) in found:
            out[i : i + width] = [True] * width
    return out


@dataclass
class Statistics:
    """Of all items that have words: how many, their mean length, and in how many each term is."""

    count: int
    average: float
    frequency: dict[str, int]


def statistics_of(texts: list[list[str]]) -> Statistics:
    frequency: dict[str, int] = {}
    for words in texts:
        for w in set(words):
            frequency[w] = frequency.get(w, 0) + 1
    return Statistics(len(texts), sum(map(len, texts)) / max(1, len(texts)), frequency)


class BlockMaxIndex:
    """Postings of test items whose lengths share a passage width."""

    def __init__(self, items: list[tuple[int | None, list[str], list[str], list[str]]], stride: int, every: Statistics):
        self.stride = stride
        self.ids = [item for item, *_ in items]
        self.parts = [(q, a) for _, _, q, a in items]
        self.lengths = [len(words) for _, words, _, _ in items]
        count = len(items)
        postings: dict[str, list[tuple[int, int]]] = {}
        for d, (_, words, _, _) in enumerate(items):
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            for w, n in tf.items():
                postings.setdefault(w, []).append((d, n))
        self.terms = sorted(postings)
        own = np.zeros(count)
        raw = []
        for t in self.terms:
            ds = np.array([d for d, _ in postings[t]])
            tf = np.array([n for _, n in postings[t]], dtype=float)
            own_n = every.frequency[t]
            idf = np.log(1 + (every.count - own_n + 0.5) / (own_n + 0.5))
            norm = K1 * (1 - B + B * np.array(self.lengths)[ds] / every.average)
            impact = idf * tf * (K1 + 1) / (tf + norm)
            own[ds] += impact
            raw.append((ds, impact))
        self.postings = [(ds.tolist(), (impact / own[ds]).tolist()) for ds, impact in raw]
        self.largest = [max(x) for _, x in self.postings]
        self.block_max = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for _, x in self.postings]
        self.block_last = [[ds[min(i + BLOCK, len(ds)) - 1] for i in range(0, len(ds), BLOCK)] for ds, _ in self.postings]
        frequent = np.array([len(ds) > max(1, FREQUENT * count) for ds, _ in self.postings])
        self.rest = np.zeros(count)
        for t in np.flatnonzero(frequent):
            ds, x = self.postings[t]
            self.rest[ds] += x
        sizes = np.array([0 if f else len(ds) for f, (ds, _) in zip(frequent, self.postings)])
        self.rare_start = np.concatenate([[0], np.cumsum(sizes)])
        rare = [p for f, p in zip(frequent, self.postings) if not f]
        self.rare_item = np.array([d for ds, _ in rare for d in ds], dtype=np.int64)
        self.rare_impact = np.array([v for _, x in rare for v in x])

    def candidates(self, codes: np.ndarray, segment: np.ndarray, last_of_doc: np.ndarray, threshold: float) -> np.ndarray:
        """First segments of the passages (a segment and the next of its document) that might reach the threshold."""
        count = len(self.ids)
        hit = np.flatnonzero(codes >= 0)
        hit = hit[self.rare_start[codes[hit] + 1] > self.rare_start[codes[hit]]]
        if not len(hit) and self.rest.max() < threshold:
            return np.empty(0, np.int64)
        pairs = np.unique(segment[hit] * len(self.terms) + codes[hit])
        seg, term = pairs // len(self.terms), pairs % len(self.terms)
        sizes = self.rare_start[term + 1] - self.rare_start[term]
        at = np.repeat(self.rare_start[term] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        cells, where = np.unique(np.repeat(seg, sizes) * count + self.rare_item[at], return_inverse=True)
        sums = np.bincount(where, weights=self.rare_impact[at], minlength=len(cells))
        seg, item = cells // count, cells % count
        following = np.searchsorted(cells, cells + count)
        following[following == len(cells)] = max(0, len(cells) - 1)
        both = sums + np.where((cells[following] == cells + count) & ~last_of_doc[seg], sums[following], 0) if len(cells) else sums
        slack = threshold - 1e-9
        found = [seg[both + self.rest[item] >= slack]]
        alone = np.flatnonzero(self.rest >= slack)
        if len(alone):  # an item of frequent terms only: every passage is evaluated
            found.append(np.arange(len(last_of_doc)))
        before = seg[sums + self.rest[item] >= slack] - 1  # a passage whose second segment has it all
        found.append(before[(before >= 0) & ~last_of_doc[np.maximum(before, 0)]])
        return np.unique(np.concatenate(found))

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the query's distinct terms is at or above the threshold, by block-max WAND."""
        found = []
        slack = threshold - 1e-9
        cursors = [[self.postings[t][0][0], t, 0] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.largest[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block_bound, border = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)
            for _, t, i in cursors[: pivot + 1]:
                b = i // BLOCK
                lasts = self.block_last[t]
                while b < len(lasts) and lasts[b] < item:
                    b += 1
                if b < len(lasts):
                    block_bound += self.block_max[t][b]
                    border = min(border, lasts[b] + 1)
            if block_bound >= slack:
                if cursors[0][0] == item:
                    score = sum(self.postings[t][1][i] for _, t, i in cursors[: pivot + 1])
                    if score >= slack:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
                moved = [c for c in cursors[: pivot + 1] if c[0] < target]
            else:
                target = max(border, item + 1)
                moved = cursors[: pivot + 1]
            for c in moved:
                items = self.postings[c[1]][0]
                i, blocks = c[2], self.block_last[c[1]]
                b = i // BLOCK
                while b < len(blocks) and blocks[b] < target:
                    b += 1
                    i = b * BLOCK
                while i < len(items) and items[i] < target:
                    i += 1
                c[2] = i
                c[0] = items[i] if i < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def overlaps(self, item: int, words: list[str]) -> tuple[float, float, float]:
        """Shares of the question's and of the answer's words that shingles found cover, and the share of all their shingles that is found.

        A word is covered by a shingle of its part, or by one of question and answer read on.
        """
        question, answer = self.parts[item]
        whole = question + answer
        wide = min(SHINGLE, len(whole))
        have = {width: {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} for width in {wide, min(SHINGLE, len(question)), min(SHINGLE, len(answer))} if width}
        across = covered(whole, have[wide], wide) if wide else []
        out, found, every = [], 0, 0
        for part, both in ((question, across[: len(question)]), (answer, across[len(question) :])):
            width = min(SHINGLE, len(part))
            own = shingles(part)
            there = own & have[width] if width else own
            seen = [x or y for x, y in zip(covered(part, there, width), both)]
            out.append(sum(seen) / len(part) if part else 1.0)
            found, every = found + len(there), every + len(own)
        return out[0], out[1], found / every if every else 0.0


def build_indexes(rows: list[tuple[int | None, str, str, str]], every: Statistics | None = None) -> list[BlockMaxIndex]:
    """An index for each class of item lengths (64 words, then twice as many each); rows hold normalised texts, questions, answers.

    ``every`` are the statistics of all items; without it those of the rows.
    """
    items = [(item, words, words_of(question), words_of(answer)) for item, text, question, answer in rows if (words := words_of(text))]
    every = every or statistics_of([words for _, words, _, _ in items])
    classes: dict[int, list] = {}
    for own in items:
        stride = 64
        while stride < len(own[1]):
            stride *= 2
        classes.setdefault(stride, []).append(own)
    return [BlockMaxIndex(own, stride, every) for stride, own in sorted(classes.items())]


def search_chunk(index: BlockMaxIndex, vocabulary: pa.Array, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, float, float, float]]:
    """Row, item's place, score and overlaps of all that the passages of a chunk retrieve; one of the best passage per pair."""
    lists = parted(texts)
    flat = lists.flatten()
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    lengths = np.diff(bounds)
    codes = np.asarray(pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1), dtype=np.int64)
    segments = np.maximum(1, -(-lengths // index.stride))
    first = np.concatenate([[0], np.cumsum(segments)])
    inside = np.arange(len(codes)) - np.repeat(bounds[:-1], lengths)
    segment = np.repeat(first[:-1], lengths) + inside // index.stride
    last = np.zeros(first[-1], dtype=bool)
    last[first[1:] - 1] = True
    best: dict[tuple[int, int], tuple[bool, float, float, float, float]] = {}
    for s in index.candidates(codes, segment, last, threshold).tolist():
        row = int(np.searchsorted(first, s, side="right")) - 1
        start = int(bounds[row] + (s - first[row]) * index.stride)
        end = int(min(start + 2 * index.stride, bounds[row + 1]))
        terms = [t for t in np.unique(codes[start:end]).tolist() if t >= 0]
        for item, score in index.retrieve(terms, threshold):
            reach = index.lengths[item]
            words = flat.slice(max(start - reach, int(bounds[row])), min(end + reach, int(bounds[row + 1])) - max(start - reach, int(bounds[row]))).to_pylist()
            question, answer, overlap = index.overlaps(item, words)
            found = (min(question, answer) >= PART_OVERLAP, overlap, question, answer, score)
            if (row, item) not in best or found > best[row, item]:
                best[row, item] = found
    for (row, item), (_, overlap, question, answer, score) in best.items():
        yield row, item, score, question, answer, overlap


def retrieve(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``hash`` (of the text), ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``, ``overlap`` of every document and item above the threshold.

    Null or empty texts and items match nothing; an empty table gives no row.
    Texts of any length are searched whole. Repeated documents or items give
    repeated rows, an item without an id a null ``item_id``; other columns are
    ignored, whatever their names. Items are read by the driver in parts of
    about ``INDEX_BYTES``, with the terms that a part has of the table of
    document frequencies; each part is a pass over ``docs``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    raw = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [question_answer(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("t"), pa.array([q for q, _ in pairs], pa.string()), pa.array([a for _, a in pairs], pa.string())], ["item_id", "t", "q", "a"])

    passages = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_hash(F.col(f"`{text_col}`")).alias("hash"), normalised(F.col(f"`{text_col}`")).alias("text"))
    schema = "doc_id long, hash long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
    types = dict(zip(("doc_id", "hash", "item_id", "score", "question_overlap", "answer_overlap", "overlap"), [pa.int64()] * 3 + [pa.float64()] * 4))
    out: DataFrame | None = None
    with Scratch(spark) as work:
        parsed = raw.mapInArrow(split, "item_id long, t string, q string, a string")
        items = work.store(parsed.select("item_id", "t", normalised(F.col("t")).alias("n"), normalised(F.col("q")).alias("q"), normalised(F.col("a")).alias("a")), "items")
        words = F.filter(F.split("n", " "), lambda w: w != "")
        size = items.agg(F.sum(F.octet_length("t")).alias("size"), F.count_if(F.size(words) > 0).alias("n"), F.sum(F.size(words)).alias("words")).first()
        parts = max(1, -(-(size["size"] or 0) // INDEX_BYTES))
        part_of = F.pmod(F.xxhash64("t", "item_id"), F.lit(parts)).alias("part")
        terms = items.select(part_of, F.explode(F.array_distinct(words)).alias("word"))
        frequency = work.store(terms.groupBy("word").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")), "item-terms")
        for part in range(parts):
            rows = sorted(((r.item_id, r.n, r.q, r.a) for r in items.where(part_of == part).collect()), key=lambda r: (r[0] is None, r))
            own = frequency.where(F.array_contains("parts", F.lit(part).cast("long"))).select("word", "n").collect()
            every = Statistics(size["n"], (size["words"] or 0) / max(1, size["n"]), {r.word: r.n for r in own})
            shared = spark.sparkContext.broadcast(build_indexes(rows, every))

            def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                indexes = [(x, pa.array(x.terms)) for x in shared.value]
                for chunk in text_chunks(batches):
                    ids, hashes = chunk.column("doc_id"), chunk.column("hash")
                    found = [(ids[row].as_py(), hashes[row].as_py(), index.ids[item], *measured) for index, terms in indexes for row, item, *measured in search_chunk(index, terms, chunk.column("text"), threshold)]
                    columns = list(zip(*found)) if found else [()] * len(types)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))

            found = passages.mapInArrow(kernel, schema)
            out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, part_overlap: float = PART_OVERLAP, **settings) -> DataFrame:
    """The retrieved pairs that are verified: the share of the shingles of question and answer together, and of the words of each."""
    sure = (F.col("overlap") >= overlap) & (F.col("question_overlap") >= part_overlap) & (F.col("answer_overlap") >= part_overlap)
    return retrieve(docs, benchmark, **settings).where(sure)

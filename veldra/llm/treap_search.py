"""Ranked lexical search with inverted treaps.

The words of all documents are matched against the terms of the stated items,
chunk by chunk, and the postings of those terms are stored: a row per chunk,
the shard of an index. From the stored shards alone come the statistics, and
with them each posting's impact on a score.

In a shard, the postings of a term are a treap: a search tree by document and a
heap by impact, so that a root has the largest impact of its subtree. An item's
treaps are walked together. A state is an interval of documents and, for each
term, the root of that term's postings in the interval; the sum of the roots'
impacts bounds every score in it. States are taken best bound first, some
thousand at once; one whose bound cannot reach the item's k-th score so far is
pruned with all below it; of the others the document of the largest impact is
scored, and the interval is split there: on the way down to this document each
treap shows its own posting of it and the roots of both sides.

A task keeps the best k of an item over all its shards and hands on no more
than k rows per item, of which a last aggregate takes the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import id_text, text_chunks
from veldra.session import Scratch, ship_package, stored

#: Bytes of text in one shard of the index.
SHARD_BYTES = 16 << 20
#: States of an item that are taken at once.
STATES = 2048
#: Items searched in one pass over the index; their terms are sent to all workers (some 100 bytes each).
ITEMS = 4096

#: ASCII bytes that belong to words, besides all bytes over 127.
WORD_BYTES = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[list(WORD_BYTES)] = True
_IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SHARD = "n_docs long, n_words long, doc_ids binary, sizes binary, starts binary, docs binary, counts binary"


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and each text's bounds in them."""
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = _IS_WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    starts[edges] = inside[edges]  # a word ends with its text
    first = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int32)
    letters = _LOWER[data[inside]]
    begins = before[first].astype(np.int64) - 1
    bounds = pa.py_buffer(np.append(begins, len(letters)).astype(np.int64).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, bounds, pa.py_buffer(letters.tobytes())]), np.searchsorted(first, offsets)


def words_of(text: str) -> list[bytes]:
    return tokens(pa.array([text]))[0].to_pylist()


def postings(doc_ids: np.ndarray, texts: pa.Array, terms: pa.Array) -> dict:
    """One shard: the documents that have a word, and the terms' postings by term and document."""
    found, bounds = tokens(texts)
    sizes = np.diff(bounds)
    code = np.asarray(pc.fill_null(pc.index_in(found, value_set=terms), -1)).astype(np.int64)
    row = np.repeat(np.cumsum(sizes > 0) - 1, sizes)
    hit = code >= 0
    n_docs = int((sizes > 0).sum())
    key, counts = np.unique(code[hit] * max(1, n_docs) + row[hit], return_counts=True)
    term, doc = np.divmod(key, max(1, n_docs))
    packed = {"doc_ids": doc_ids[sizes > 0].astype(np.int64), "sizes": sizes[sizes > 0].astype(np.int64), "starts": np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int32), "docs": doc.astype(np.int32), "counts": counts.astype(np.int32)}
    return {"n_docs": n_docs, "n_words": int(sizes.sum())} | {k: v.tobytes() for k, v in packed.items()}


def build_index(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored shards of an index of ``terms`` over all documents; those without an id are not ranked, but they count."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.large_binary())
        kinds = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), *[(n, pa.binary()) for n in ("doc_ids", "sizes", "starts", "docs", "counts")]])

        def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = np.asarray(pc.fill_null(whole["doc_id"], NO_ID).combine_chunks())
            return pa.RecordBatch.from_pylist([postings(ids, pa.concat_arrays(whole["text"].chunks), wanted)], kinds)

        held, size = [], 0
        for chunk in text_chunks(batches, "text", shard_bytes):
            nbytes = pc.sum(pc.binary_length(chunk.column("text"))).as_py() or 0
            if held and size + nbytes > shard_bytes:
                yield shard(held)
                held, size = [], 0
            held.append(chunk)
            size += nbytes
        if held:
            yield shard(held)

    return stored(id_text(docs, id_col, text_col).mapInArrow(kernel, SHARD), "treap-shards")


#: Stands for a null id in a shard.
NO_ID = np.iinfo(np.int64).min


def statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """How many documents have a word, how many words there are, and in how many documents each term is."""
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for starts in batch.column("starts"):
                total += np.diff(np.frombuffer(starts.as_buffer(), dtype=np.int32))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    frequency = np.zeros(n_terms, dtype=np.int64)
    for r in index.select("starts").mapInArrow(sizes, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per term of the items
        frequency[r.term] = r.n
    return totals[0], totals[1], frequency


def term_weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequency + 1))).astype(np.int64)


class Treaps:
    """The postings of a shard as one treap per term; nodes are postings, -1 is none."""

    def __init__(self, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        n = len(docs)
        term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.docs, self.impacts = np.append(docs, -1), np.append(impacts, 0)
        self.left, self.right = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
        before, after = _nearest_above(impacts, term, -1), _nearest_above(impacts, term, 1)
        # the lower of the two nearest nodes above a node is its parent; equal ones: the later is the lower
        height = lambda at: np.where(at < 0, -1, impacts[at]) if n else at
        high_before, high_after = height(before), height(after)
        under_before = (before >= 0) & ((after < 0) | (high_before < high_after))
        under_after = (after >= 0) & ~under_before
        nodes = np.arange(n)
        self.right[before[under_before]] = nodes[under_before]
        self.left[after[under_after]] = nodes[under_after]
        self.roots = np.full(len(starts) - 1, -1, dtype=np.int64)
        top = nodes[(before < 0) & (after < 0)]
        self.roots[term[top]] = top

    def split(self, at: np.ndarray, after: np.ndarray, doc: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Splits states, a row of roots each, at their documents.

        ``after`` and ``before`` bound a state's interval, open on both sides:
        the subtree of a root may hold documents beyond them. Gives the roots
        of the left and right sides, and the documents' summed impacts.
        """
        width = at.shape[1]
        flat = at.ravel().copy()
        after, wanted, before = (np.repeat(x, width) for x in (after, doc, before))
        low, high, own = np.full(len(flat), -1), np.full(len(flat), -1), np.zeros(len(flat), dtype=np.int64)
        live = np.flatnonzero(flat >= 0)
        while len(live):  # down to the document
            node = flat[live]
            here, goal = self.docs[node], wanted[live]
            less, more = here < goal, here > goal
            same = ~(less | more)
            for side, inside in ((low, less & (here > after[live])), (high, more & (here < before[live]))):
                place = live[inside]
                side[place] = np.where(side[place] < 0, node[inside], side[place])
            place, found = live[same], node[same]
            own[place] = self.impacts[found]
            for side, child in ((low, self.left), (high, self.right)):
                side[place] = np.where(side[place] < 0, child[found], side[place])
            flat[live] = np.where(less, self.right[node], self.left[node])
            live = live[~same]
            live = live[flat[live] >= 0]
        for side, bound, child, sign in ((low, after, self.right, 1), (high, before, self.left, -1)):  # below the document, into the interval
            live = np.flatnonzero(side >= 0)
            while len(live):
                live = live[sign * (self.docs[side[live]] - bound[live]) <= 0]
                side[live] = child[side[live]]
                live = live[side[live] >= 0]
        return low.reshape(at.shape), high.reshape(at.shape), own.reshape(at.shape).sum(axis=1)


def _nearest_above(impacts: np.ndarray, term: np.ndarray, step: int) -> np.ndarray:
    """The nearest posting of the same term, before (-1) or after (1), that is above: of larger impact or, before, of equal impact; -1 if none."""
    n = len(impacts)
    at = np.arange(n) + step
    outside = (at < 0) | (at >= n)
    at[outside] = -1
    at[(at >= 0) & (term[at] != term)] = -1
    live = np.flatnonzero(at >= 0)
    while len(live):
        lower = impacts[at[live]] < impacts[live] if step < 0 else impacts[at[live]] <= impacts[live]
        live = live[lower]
        at[live] = at[at[live]]  # all between are lower still
        live = live[at[live] >= 0]
    return at


class Best:
    """An item's k best documents so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])  # an equal score may still have a smaller id


def walk(treaps: Treaps, doc_ids: np.ndarray, terms: np.ndarray, best: Best, states: int = STATES) -> int:
    """Adds a shard's documents to an item's best; returns how many it scored."""
    roots = treaps.roots[terms]
    waiting = roots[roots >= 0][None, :]
    bounds, after, before = treaps.impacts[waiting].sum(axis=1), np.array([-1]), np.array([len(doc_ids)])
    scored = 0
    while len(waiting):
        hopeful = np.flatnonzero(bounds >= best.least)
        if not len(hopeful):
            break
        if len(hopeful) > states:
            hopeful = hopeful[np.argpartition(-bounds[hopeful], states - 1)]
        taken, left = hopeful[:states], hopeful[states:]
        now = waiting[taken]
        peak = now[np.arange(len(now)), treaps.impacts[now].argmax(axis=1)]
        doc = treaps.docs[peak]
        low, high, score = treaps.split(now, after[taken], doc, before[taken])
        known = doc_ids[doc] != NO_ID
        best.add(score[known], doc_ids[doc[known]])
        scored += len(now)
        below = np.concatenate([low, high])
        fresh = treaps.impacts[below].sum(axis=1)
        kept = fresh >= best.least
        waiting, bounds = np.concatenate([waiting[left], below[kept]]), np.concatenate([bounds[left], fresh[kept]])
        after, before = (np.concatenate([old[left], new[kept]]) for old, new in ((after, np.concatenate([after[taken], doc])), (before, np.concatenate([doc, before[taken]]))))
    return scored


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", items_per_pass: int = ITEMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``k`` best documents with a score above 0, equal scores by ascending id.

    Items are a stated set of queries: they are read on the driver
    ``items_per_pass`` at a time, with one index and one walk for each such
    part. A null or empty item, or one of unknown words, has no rows; items of
    one id are searched as one, with the words of all. A null text has no words, and
    texts of any length are read whole. Documents without an id count in the
    statistics and are not ranked; repeated rows are documents of their own. No
    documents give no rows.
    """
    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("item_id is not null and text is not null")
    with Scratch(docs.sparkSession) as work:
        listed = work.store(rows.groupBy("item_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text")).repartitionByRange("item_id").sortWithinPartitions("item_id"), "items")
        found, part = None, []
        for row in listed.toLocalIterator():
            part.append((row.item_id, words_of(row.text)))
            if len(part) == items_per_pass:
                found, part = _joined(found, _searched(docs, part, k, id_col, text_col)), []
        if part or found is None:
            found = _joined(found, _searched(docs, part, k, id_col, text_col))
    return found


def _joined(found: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if found is None else found.unionByName(more)


def _searched(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    terms = sorted({w for _, ws in items for w in ws})
    place = {w: i for i, w in enumerate(terms)}
    wanted = [(item, np.array(sorted({place[w] for w in ws}), dtype=np.int64)) for item, ws in items]
    index = build_index(docs, terms, id_col, text_col)
    n_docs, n_words, frequency = statistics(index, len(terms))
    weights = term_weights(n_docs, frequency)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [Best(k) for _ in wanted]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, starts, held, counts = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=t) for c, t in (("doc_ids", np.int64), ("sizes", np.int64), ("starts", np.int32), ("docs", np.int32), ("counts", np.int32)))
                shard = Treaps(starts, held, impacts_of(weights, n_docs, n_words, sizes, starts, held, counts))
                for (_, own), best in zip(wanted, every):
                    walk(shard, ids, own, best)
        columns = [np.concatenate([np.repeat(item, len(b.ids)) for (item, _), b in zip(wanted, every)] or [[]]).astype(np.int64), *(np.concatenate([x for x in xs] or [[]]).astype(np.int64) for xs in ([b.ids for b in every], [b.scores for b in every]))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "doc_id", "score"])

    best = index.mapInArrow(kernel, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return stored(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")


def impacts_of(weights: np.ndarray, n_docs: int, n_words: int, sizes: np.ndarray, starts: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What each posting adds to a score."""
    length = 50 + (50 * sizes * n_docs) // max(1, n_words)
    frequency = counts.astype(np.int64)
    return np.repeat(weights, np.diff(starts)) * ((1_000_000_000 * frequency) // (1000 * frequency + 20 * length[docs]))

"""Removal of repeated substrings with a sparse suffix array, sorted deep-shallow.

A byte goes if a window of ``WINDOW`` bytes over it also starts in a document
with a smaller id. A suffix array over all documents would hold every byte's
suffix with its context, fifty times the text. This one is sparse: each window
has an anchor, the position in it whose ``GRAM`` bytes hash lowest. Equal
windows have equal anchors, so that windows need to be compared only among
those whose anchors have the same gram, and the suffixes that are sorted are
those at anchors, one for some twenty windows.

1. Documents are dealt into chunks of a few megabytes, once; both later uses of
   the texts read the same exchange.
2. The grams of a chunk's anchors go to buckets, five bytes each, which tell the
   chunk which of them another document has.
3. Only for these, a chunk sends its pieces: for an anchor, the bytes of the
   windows it stands for, each distinct piece once, with the least and the
   largest id that has it. Pieces meet by gram.
4. A bucket sorts the pieces' suffixes from their anchors: grams deal them into
   groups, multikey quicksort orders a group by the next ``SHALLOW`` bytes, and
   blind tries order what is still equal. The bytes before anchors are sorted
   alike, backwards. Two windows are equal if their pieces are in one run of
   the first order at the depth that the window reaches to the right and in one
   run of the second at the depth that it reaches to the left.
5. Each chunk is told the first document of its windows, and removes.

A gram in more than ``HOT`` chunks sends its pieces in parts of ``PART`` windows
that are dealt by the bytes which all windows of a part hold, nearly a window's
length, instead of by the gram: a frequent gram does not bring all that follows
it to one bucket, and of what is really equal a bucket gets one entry a chunk,
however many documents hold it. Where the occurrences of a piece are, a chunk
tells itself, by the same exchange but past the buckets.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import return_blocks
from veldra.session import ship_package

#: Bytes of a string that counts as repeated.
WINDOW = 50
#: Bytes that choose an anchor; a window has WINDOW - GRAM + 1 places for it.
GRAM = 16
PLACES = WINDOW - GRAM + 1
#: Bytes after a gram, and before it, that multikey quicksort orders; blind tries order the rest.
SHALLOW = 16
#: Bytes of text in a chunk, and positions whose hashes are held at once.
CHUNK_BYTES, BLOCK = 2 << 20, 1 << 19
#: Bytes of all texts for one bucket of grams, and of pieces.
GRAM_BUCKET, PIECE_BUCKET = 16 << 20, 2 << 20
#: Chunks beyond which a gram's pieces are dealt in parts, and the windows of a part.
HOT, PART = 256, 7
#: Width of a sorted context in bytes: whole words that hold the longest one.
WIDTH = 56

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Kinds of messages.
PARKED, PIECES = 0, 1
MESSAGE = "bucket long, chunk long, kind int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    raw = b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), a.nbytes) + a.tobytes() for a in arrays)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=struct.unpack("<q", data[:8])[0], codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        kind, size = struct.unpack_from("<2sq", raw, at)
        out.append(np.frombuffer(raw, dtype=kind.decode(), count=size // int(kind[1:]), offset=at + 10))
        at += 10 + size
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts.astype(np.int64) - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all slices, one after the other; places are laid out for some thousand slices at once."""
    return np.concatenate([data[spread(starts[at : at + 8192], sizes[at : at + 8192])] for at in range(0, len(starts), 8192)] or [data[:0]])


def words_at(data: np.ndarray, shift: int, n: int) -> np.ndarray:
    """The eight bytes from every position, as numbers."""
    return np.ndarray(n, dtype="<u8", buffer=data, offset=shift, strides=(1,))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M3
    return h ^ (h >> np.uint64(29))


class Chunk:
    """The documents of a chunk in a fixed order: bytes, bounds and ids; those without an id take no part."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"]
        texts = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.binary())
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
        body = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, dtype=np.uint8)
        self.bounds = offsets - offsets[0]
        self.data = np.concatenate([body, np.zeros(WIDTH + 8, dtype=np.uint8)])
        self.size = len(body)
        self.numbers = np.asarray(self.ids.fill_null(0)).astype(np.int64)
        self.usable = ~np.asarray(self.ids.is_null())

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors with the first window that each stands for and how many."""
        last = np.repeat((self.bounds[1:] - WINDOW).astype(np.int32), np.diff(self.bounds))  # the last window of each position's document
        last[np.repeat(~self.usable, np.diff(self.bounds))] = -1
        found, firsts, sizes = [], [], []
        for low in range(0, self.size, BLOCK):
            high = min(self.size, low + BLOCK)
            n = high - low + PLACES - 1
            view = self.data[low:] if low + n + GRAM <= len(self.data) else np.concatenate([self.data[low:], np.zeros(GRAM + PLACES, dtype=np.uint8)])
            least = (gram_hash(words_at(view, 0, n), words_at(view, 8, n)) & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
            width = 1
            while 2 * width <= PLACES:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < PLACES:
                shift = PLACES - width
                least = np.minimum(least[:-shift], least[shift:])
            windows = np.flatnonzero(np.arange(low, high) <= last[low:high])
            at = (least[windows] & np.uint64(0xFFFFFF)).astype(np.int64) + low
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            found.append(at[starts])
            firsts.append(windows[starts] + low)
            sizes.append(np.diff(starts, append=len(at)))
        join = lambda xs: np.concatenate(xs) if xs else np.empty(0, dtype=np.int64)
        return join(found), join(firsts), join(sizes)

    def grams(self, at: np.ndarray) -> np.ndarray:
        """What stands for the anchors' grams: not the hashes that chose them, which are all low."""
        body = self.data[at[:, None] + np.arange(GRAM)].view("<u8")
        return mixed(gram_hash(body[:, 0], body[:, 1]) * M2)

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        """64 bits of the ``size`` bytes from each start, for dealing only."""
        out = np.full(len(starts), M2)
        for shift in (*range(0, size - 8, 8), size - 8):
            out = mixed((out ^ self.data[starts[:, None] + np.arange(shift, shift + 8)].view("<u8")[:, 0]) * M1)
        return out


def gram_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed((first * M1) ^ mixed(second * M2))


def distinct_grams(chunk: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams in order, each anchor's place among them, and which grams two documents of the chunk have."""
    grams, place = np.unique(chunk.grams(at), return_inverse=True)
    ids = chunk.numbers[chunk.documents(at)]
    low, high = extremes(place, ids, len(grams))
    return grams, place, low != high


def extremes(place: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest value of each place; every place has one."""
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(n))
    return (np.minimum.reduceat(values[order], starts), np.maximum.reduceat(values[order], starts)) if n else (values[:0], values[:0])


def buckets_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def send_grams(table: pa.Table, bits: int) -> pa.Table:
    """A chunk's distinct grams by bucket, forty further bits of each, and whether two documents of the chunk have it."""
    chunk = Chunk(table)
    grams, _, many = distinct_grams(chunk, chunk.anchors()[0])
    bucket = buckets_of(grams, bits)
    short = (grams >> np.uint64(24 - bits)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    keys, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts[1:], len(bucket))
    rows = [{"bucket": int(k), "chunk": table["chunk"][0].as_py(), "grams": short[a:b].tobytes(), "many": np.packbits(many[a:b]).tobytes()} for k, a, b in zip(keys, starts, ends)]
    return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("many", pa.binary())]))


def mark_grams(table: pa.Table, hot: int) -> pa.Table:
    """For every chunk of a bucket, which of its grams another document has, and which are in more than ``hot`` chunks."""
    sent = [np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(-1, 5) for x in table["grams"]]
    sizes = [len(x) for x in sent]
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), dtype=np.uint8), count=n) for x, n in zip(table["many"], sizes)]).astype(bool)
    padded = np.zeros((sum(sizes), 8), dtype=np.uint8)
    padded[:, :5] = np.concatenate(sent)
    _, place, counts = np.unique(padded.view("<u8")[:, 0], return_inverse=True, return_counts=True)
    shared, frequent = many | (counts[place] > 1), counts[place] > hot
    ends = np.cumsum(sizes)
    cut = lambda x: pa.array([np.packbits(x[b - n : b]).tobytes() for b, n in zip(ends, sizes)], pa.binary())
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "n": pa.array(sizes, pa.int64()), "shared": cut(shared), "frequent": cut(frequent)})


def send_pieces(table: pa.Table, marks: pa.Table, bits: int) -> pa.Table:
    """A chunk's messages: its pieces by bucket, and to itself where they occur."""
    chunk, kinds = Chunk(table), pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
    if not table.num_rows or not marks.num_rows:
        return kinds.empty_table()
    number = table["chunk"][0].as_py()
    at, firsts, sizes = chunk.anchors()
    grams, place, _ = distinct_grams(chunk, at)
    marks = marks.sort_by("bucket")
    bits_of = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), dtype=np.uint8), count=n.as_py()) for x, n in zip(marks[name], marks["n"])]).astype(bool)
    shared, frequent = bits_of("shared")[place], bits_of("frequent")[place]
    at, firsts, sizes, dealt_by, frequent = at[shared], firsts[shared], sizes[shared], grams[place[shared]], frequent[shared]
    if not len(at):
        return kinds.empty_table()
    if frequent.any():
        at, firsts, sizes, dealt_by = in_parts(chunk, at, firsts, sizes, dealt_by, frequent)

    lengths = sizes + WINDOW - 1
    code = distinct_texts(gathered(chunk.data, firsts, lengths), lengths)
    ids = chunk.numbers[chunk.documents(at)]
    order = np.argsort(code, kind="stable")
    begins = np.searchsorted(code[order], np.arange(code.max() + 2))
    own = order[begins[:-1]]  # a piece's first occurrence
    low, high = np.minimum.reduceat(ids[order], begins[:-1]), np.maximum.reduceat(ids[order], begins[:-1])
    rows = [(-1 - number, PARKED, pack(np.diff(begins).astype("<u4"), firsts[order].astype("<u4"), ids[order]))]
    for bucket, some in grouped(buckets_of(dealt_by[own], bits)):
        held = own[some]
        rows.append((bucket, PIECES, pack(some.astype("<u4"), sizes[held].astype("u1"), (at[held] - firsts[held]).astype("u1"), low[some], high[some], gathered(chunk.data, firsts[held], lengths[held]))))
    return pa.Table.from_pylist([{"bucket": b, "chunk": number, "kind": k, "payload": p} for b, k, p in rows], kinds)


def in_parts(chunk: Chunk, at: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, grams: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with those of frequent grams in parts of windows, by the bytes before the anchor, and what each part is dealt by."""
    hot = np.flatnonzero(frequent)
    reach = at[hot] - firsts[hot]  # bytes before the anchor that the first window has; the last has reach - sizes + 1
    least, most = (reach - sizes[hot] + 1) // PART, reach // PART
    part = spread(least, most - least + 1)
    owner = np.repeat(np.arange(len(hot)), most - least + 1)
    far = np.minimum(reach[owner], part * PART + PART - 1)
    near = np.maximum((reach - sizes[hot] + 1)[owner], part * PART)
    anchor = at[hot][owner]
    common = chunk.hashes(anchor - part * PART, WINDOW - PART + 1)
    rest = ~frequent
    return tuple(np.concatenate(x) for x in ((at[rest], anchor), (firsts[rest], anchor - far), (sizes[rest], far - near + 1), (grams[rest], common)))


def distinct_texts(body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The number of each text, one after the other in ``body``; equal texts have one, numbered as they first occur."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return np.asarray(texts.dictionary_encode().indices).astype(np.int64)


def grouped(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places of each key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return [(int(keys[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def resolve(table: pa.Table) -> pa.Table:
    """Answers of a bucket: for each chunk, the first document of its windows where that is before the last that has them."""
    kind = table["kind"]
    parked = table.filter(pa.compute.equal(kind, PARKED)).select(["chunk", "kind", "payload"])
    held = table.filter(pa.compute.equal(kind, PIECES))
    if not held.num_rows:
        return parked
    parts = [unpack(x.as_py()) for x in held["payload"]]
    answers = answer_pieces(*(np.concatenate(x) for x in zip(*parts)), [len(p[0]) for p in parts])
    rows = [{"chunk": c.as_py(), "kind": PIECES, "payload": p} for c, p in zip(held["chunk"], answers) if p is not None]
    return pa.concat_tables([parked, pa.Table.from_pylist(rows, parked.schema)])


def answer_pieces(code: np.ndarray, counts: np.ndarray, lefts: np.ndarray, low: np.ndarray, high: np.ndarray, body: np.ndarray, sizes: list[int]) -> list[bytes | None]:
    counts, lefts = counts.astype(np.int64), lefts.astype(np.int64)
    ends = np.cumsum(counts + WINDOW - 1)
    piece = distinct_texts(body, counts + WINDOW - 1)
    order = np.argsort(piece, kind="stable")
    begins = np.searchsorted(piece[order], np.arange(piece.max() + 1))
    own = order[begins]
    first, offsets = first_documents(body, (ends - counts - WINDOW + 1)[own], counts[own], lefts[own], np.minimum.reduceat(low[order], begins))
    # runs of windows with one first document, of every distinct piece
    window_piece, j = np.repeat(np.arange(len(own)), counts[own]), spread(np.zeros(len(own), dtype=np.int64), counts[own])
    run = np.flatnonzero((j == 0) | (np.diff(first, prepend=0) != 0))
    run_size, run_piece = np.diff(run, append=len(first)), window_piece[run]
    run_begin = np.searchsorted(run_piece, np.arange(len(own) + 1))
    out = []
    for end, n in zip(np.cumsum(sizes), sizes):
        mine = np.arange(end - n, end)
        per = (run_begin[1:] - run_begin[:-1])[piece[mine]]
        runs, holder = spread(run_begin[piece[mine]], per), np.repeat(mine, per)
        some = first[run[runs]] < high[holder]
        runs, holder = runs[some], holder[some]
        out.append(pack(code[holder], j[run[runs]].astype("u1"), run_size[runs].astype("u1"), first[run[runs]]) if len(runs) else None)
    return out


def first_documents(body: np.ndarray, starts: np.ndarray, counts: np.ndarray, lefts: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each window of distinct pieces, one piece after the other, and where each piece's windows begin."""
    offsets = np.cumsum(counts) - counts
    first = np.repeat(low, counts)
    gram = body[(starts + lefts)[:, None] + np.arange(GRAM)].view("<u8")
    order = np.lexsort((gram[:, 1], gram[:, 0]))
    new = (np.diff(gram[order], axis=0, prepend=~gram[order[:1]]) != 0).any(axis=1)
    gram = np.empty(len(order), dtype=np.int64)
    gram[order] = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(gram)[gram] > 1)  # of pieces alone with their gram nothing else is equal
    if not len(several):
        return first, offsets
    gram, lefts, counts, low, offset, anchor = gram[several], lefts[several], counts[several], low[several], offsets[several], (starts + lefts)[several]
    right = context(body, anchor, counts + WINDOW - 1 - lefts)
    left = context(body, anchor, lefts, backwards=True)
    forward, backward = deep_shallow(right, gram, GRAM), deep_shallow(left, gram, 0)
    for reach in range(PLACES):  # bytes of a window before the anchor
        some = np.flatnonzero((lefts >= reach) & (lefts - reach < counts))
        key = runs_at(*forward, WINDOW - reach)[some] * (len(gram) + 1) + runs_at(*backward, reach)[some]
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        if len(new) < len(order):
            least = np.repeat(np.minimum.reduceat(low[some[order]], new), np.diff(new, append=len(order)))
            first[offset[some[order]] + lefts[some[order]] - reach] = least
    return first, offsets


def context(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray, backwards: bool = False) -> np.ndarray:
    """Rows of the bytes from each start, or of those before it backwards, with zeros after their ends."""
    out = np.zeros((len(starts), WIDTH), dtype=np.uint8)
    for step in range(WINDOW):
        some = np.flatnonzero(lengths > step)
        out[some, step] = body[starts[some] - 1 - step if backwards else starts[some] + step]
    return out


def deep_shallow(rows: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts rows of bytes within their groups, whose first ``depth`` bytes are equal: order, common prefixes of neighbours, and group starts."""
    words = rows.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
    deep = multikey_quicksort(words, order, cuts, np.diff(cuts, append=len(order)), depth // 8, (depth + SHALLOW) // 8)
    for low, high in deep:
        members = order[low:high]
        order[low:high] = members[blind_order([r.tobytes() for r in rows[members]], depth + SHALLOW)]
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    starts = np.zeros(len(order), dtype=bool)
    starts[cuts] = True
    return order, np.append(0, common), starts


def multikey_quicksort(words: np.ndarray, order: np.ndarray, lows: np.ndarray, sizes: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    """Orders ranges of ``order`` by words ``first`` to ``last`` - 1, all ranges a step at a time; gives the ranges that are equal in these.

    A range is parted around the word of its middle row: lower ones, equal
    ones, higher ones. The equal ones go on with the next word, the others with
    the same.
    """
    deep: list[tuple[int, int]] = []
    depth = np.full(len(lows), first)
    while len(lows):
        done = (sizes < 2) | (depth >= last)
        for low, size in zip(lows[done], sizes[done]):
            if size > 1:
                deep.append((int(low), int(low + size)))
        lows, sizes, depth = lows[~done], sizes[~done], depth[~done]
        if not len(lows):
            break
        place, part = spread(lows, sizes), np.repeat(np.arange(len(lows)), sizes)
        rows = order[place]
        key = words[rows, depth[part]]
        pivot = words[order[lows + sizes // 2], depth][part]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        slot = 3 * part + side
        order[place] = rows[np.argsort(slot, kind="stable")]
        counts = np.bincount(slot, minlength=3 * len(lows)).reshape(-1, 3)
        begin = lows[:, None] + np.cumsum(counts, axis=1) - counts
        below = depth[:, None] + np.array([0, 1, 0])
        lows, sizes, depth = begin.ravel(), counts.ravel(), below.ravel()
    return deep


def blind_order(rows: list[bytes], depth: int) -> list[int]:
    """The order of rows of one length whose first ``depth`` bytes are equal, by a blind trie.

    An inner node holds only the place where its rows first differ and a child
    for each byte there. A row goes down blindly to some leaf; one comparison
    with it tells where the row leaves the path.
    """
    root: list | int = 0
    equal: dict[int, list[int]] = {0: [0]}
    for i in range(1, len(rows)):
        row, node = rows[i], root
        while not isinstance(node, int):
            node = node[1].get(row[node[0]]) if row[node[0]] in node[1] else next(iter(node[1].values()))
        met = rows[node]
        if row == met:
            equal[node].append(i)
            continue
        differ = int.from_bytes(row, "big") ^ int.from_bytes(met, "big")
        at = len(row) - (differ.bit_length() + 7) // 8
        parent, node = None, root
        while not isinstance(node, int) and node[0] < at:
            parent, node = node, node[1][row[node[0]]]
        equal[i] = [i]
        if not isinstance(node, int) and node[0] == at:
            node[1][row[at]] = i
        elif parent is None:
            root = [at, {met[at]: node, row[at]: i}]
        else:
            parent[1][row[parent[0]]] = [at, {met[at]: node, row[at]: i}]
    out: list[int] = []
    stack: list[list | int] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out += equal[node]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def runs_at(order: np.ndarray, common: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For every row, the run of the order in which neighbours have ``depth`` bytes in common."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(starts | (common < depth))
    return out


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a chunk without the bytes of windows that an earlier document has."""
    chunk = Chunk(table)
    begun, ended = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]

    kinds = np.asarray(answers["kind"]) if answers.num_rows else np.empty(0)
    told = {k: [unpack(answers["payload"][int(i)].as_py()) for i in np.flatnonzero(kinds == k)] for k in (PARKED, PIECES)}
    for per, firsts, ids in told[PARKED]:
        begins, firsts = np.cumsum(per, dtype=np.int64) - per, firsts.astype(np.int64)
        for code, j, n, first in told[PIECES]:
            code = code.astype(np.int64)
            held = spread(begins[code], per[code].astype(np.int64))
            run = np.repeat(np.arange(len(code)), per[code])
            later = ids[held] > first[run]
            held, run = held[later], run[later]
            begun.append(firsts[held] + j[run])
            ended.append(firsts[held] + j[run] + n[run].astype(np.int64) + WINDOW - 1)
    starts, ends = np.concatenate(begun), np.concatenate(ended)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, (starts[1:] > ends[:-1]) | (np.diff(chunk.documents(starts)) > 0))[: len(starts)])  # spans that touch are one
    starts, ends = starts[new], ends[np.append(new[1:], len(ends)).astype(np.int64) - 1] if len(new) else ends
    document = chunk.documents(starts)
    base = chunk.bounds[document]
    spans = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["start", "end"])
    per_document = np.searchsorted(document, np.arange(len(chunk.ids) + 1)).astype(np.int32)
    removed = np.bincount(document, weights=ends - starts, minlength=len(chunk.ids)).astype(np.int64)
    rest = (chunk.bounds - np.append(0, np.cumsum(removed))).astype(np.int32)
    edges = np.append(0, np.stack([starts, ends], axis=1).ravel())  # kept and removed bytes take turns
    kept_bytes = chunk.data[: chunk.size][np.repeat(np.arange(len(edges)) % 2 == 0, np.diff(np.append(edges, chunk.size)))]
    kept = pa.BinaryArray.from_buffers(pa.binary(), len(chunk.ids), [None, pa.py_buffer(rest), pa.py_buffer(kept_bytes)])
    return pa.table({"doc_id": chunk.ids, "n_bytes": pa.array(np.diff(chunk.bounds)), "spans": pa.ListArray.from_arrays(pa.array(per_document), spans), "kept": kept})


def _bits(size: int, per: int) -> int:
    return max(0, (-(-size // per) - 1).bit_length())


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed bytes, from and up to) and ``kept`` (the other bytes) of every input row.

    Bytes are those of the text in UTF-8; a removed span may cut a character,
    so ``kept`` is binary. A null text is empty. Texts shorter than a window
    lose nothing. Rows of one id don't remove from each other; a row without an
    id neither loses bytes nor takes them from others. Texts of any length are
    read whole; an empty table gives no rows. Extra columns are not read.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text")
    gram_bits, piece_bits = _bits(size, GRAM_BUCKET), _bits(size, PIECE_BUCKET)

    def frugal(kernel: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
        def call(*tables: pa.Table) -> pa.Table:
            out = kernel(*tables)
            return_blocks()
            return out

        return call

    one, two = lambda kernel: lambda t: frugal(kernel)(t), lambda kernel: lambda t, other: frugal(kernel)(t, other)
    grams = dealt.groupBy("chunk").applyInArrow(one(lambda t: send_grams(t, gram_bits)), "bucket long, chunk long, grams binary, many binary")
    marks = grams.groupBy("bucket").applyInArrow(one(lambda t: mark_grams(t, hot)), "chunk long, bucket long, n long, shared binary, frequent binary")
    pieces = dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(two(lambda t, m: send_pieces(t, m, piece_bits)), MESSAGE)
    answers = pieces.groupBy("bucket").applyInArrow(one(resolve), "chunk long, kind int, payload binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(two(remove), RESULT)

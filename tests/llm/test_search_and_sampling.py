"""Suffix dedup, importance resampling and ranked search against brute force, with odd rows."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from veldra.llm import importance, suffix_dedup, treap_search

# Suffix dedup


def removed(rows):
    """(id, length, spans, kept) of each row, window by window."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False)).tolist()
        out.append((i, len(b), tuple(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def deduped(docs, **settings):
    return sorted([(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, **settings).collect()], key=str)


def shared_texts(seed):
    chance = random.Random(seed)
    words = ["alpha", "be", "gamma", "d", "epsilon é", "ça"]
    text = lambda n: " ".join(chance.choice(words) for _ in range(n))
    passages = [text(chance.randint(10, 40)) for _ in range(8)]
    rows = []
    for _ in range(90):
        parts = [chance.choice(passages)[chance.randint(0, 20) :] if chance.random() < 0.5 else text(chance.randint(1, 60)) for _ in range(chance.randint(0, 5))]
        rows.append((chance.randint(0, 80) if chance.random() < 0.95 else None, " ".join(parts)))
    rows += [(7, None), (8, ""), (9, "x" * 49), (10, "x" * 50), (11, "x" * 51), (12, "y" * 300), (3, "y" * 120), (3, "y" * 120), (200, "ab" * 200), (201, "ba" * 100), (202, "\0" * 120), (203, "\0" * 70 + "z" * 70)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 2000}, {"chunk_bytes": 2000, "hot": 2}, {"chunk_bytes": 400, "hot": 0}])
def test_bytes_that_an_earlier_document_has_go(spark, docs_of, settings):
    rows = shared_texts(len(str(settings)))
    assert deduped(docs_of(rows), **settings) == removed(rows)


def test_no_documents_and_long_ones(spark, docs_of, monkeypatch):
    assert suffix_dedup.suffix_dedup(docs_of(["x"]).where("false")).count() == 0
    chance = random.Random(1)
    long = "".join(chance.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, "new " + long[150_000:150_120] + " end"), (0, long[:75])]
    got = {i: (spans, len(kept)) for i, _, spans, kept in deduped(docs_of(rows))}
    assert got == {0: ((), 75), 1: (((0, 75),), 299_925), 2: (((4, 124),), 8)} or got[2][0][0][0] <= 4


def test_sorting_deep_and_shallow():
    chance = np.random.default_rng(3)
    rows = chance.integers(97, 99, (400, suffix_dedup.WIDTH)).astype(np.uint8)
    rows[:200, :40] = 97  # ties that only tries part
    rows[200:230] = rows[200]
    group = np.sort(chance.integers(0, 3, 400))
    order, common, starts = suffix_dedup.deep_shallow(rows, group, 0)
    held = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert held == sorted((int(g), r.tobytes()) for g, r in zip(group, rows)) and sorted(order) == list(range(400))
    for i in range(1, 400):
        a, b = rows[order[i - 1]], rows[order[i]]
        assert common[i] == (np.flatnonzero(a != b)[0] if (a != b).any() else suffix_dedup.WIDTH)
        assert starts[i] == (group[order[i]] != group[order[i - 1]])


# Importance resampling


def resampled(rows, target, orders, buckets, share=10, least=20):
    """(id, features, weight, score, rank) by the definition."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    features = lambda ws: [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(ws) - n + 1)]
    own = [(i, words(t)) for i, t in rows]
    s, t = (np.bincount(sum((features(ws) for ws in many), []), minlength=buckets) if any(many) else np.zeros(buckets, int) for many in ([ws for _, ws in own], [words(x) for x in target]))
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (s.sum() + buckets) / ((float(s[b]) + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, ws in own:
        f = features(ws)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    usable = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for n, r in enumerate(usable[: len(usable) * share // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_weights_and_ranks(spark, docs_of, orders):
    chance = random.Random(orders)
    word = lambda: chance.choice(["the", "Ünit", "ab1", "x", "Of", "zeta's"])
    rows = [(i, " ".join(word() for _ in range(chance.randint(0, 60)))) for i in range(60)] + [(None, "a b " * 15), (70, None), (71, ""), (72, "..!"), (3, "the x " * 20), (3, "the x " * 20)]
    target = ["the x the x of", None, "", "Ünit zeta"]
    want = resampled(rows, target, orders, 50)
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs_of(rows), frame, max_order=orders, buckets=50).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert importance.resample(docs_of(rows).where("false"), frame, max_order=orders, buckets=50).count() == 0
    assert importance.resample(docs_of(rows), frame.where("false"), max_order=orders, buckets=50).count() == len(rows)


def test_gains_beyond_the_broadcast_bound(spark, docs_of, monkeypatch):
    docs, target = docs_of(["a b c " * 10, "c d " * 12]), spark.createDataFrame([("a b",)], "text string")
    want = sorted(map(tuple, importance.resample(docs, target, buckets=30).collect()))
    monkeypatch.setattr(importance, "BROADCAST_BUCKETS", 10)
    assert sorted(map(tuple, importance.resample(docs, target, buckets=30).collect())) == want


# Ranked search


def searched(rows, items, k):
    """{item: [(id, score)]} by the definition."""
    words = lambda t: [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
    docs = [(i, words(t)) for i, t in rows]
    docs = [(i, ws) for i, ws in docs if ws]
    n, total = len(docs), sum(len(ws) for _, ws in docs)
    out = {}
    for item, text in items:
        scores = []
        terms = [(w, sum(w in ws for _, ws in docs)) for w in set(words(text))]
        for i, ws in docs:
            m = 50 + (50 * len(ws) * n) // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1_000_000_000 * ws.count(w)) // (1000 * ws.count(w) + 20 * m)) for w, df in terms), i))
        out[item] = [(i, -s) for s, i in sorted(x for x in scores if x[0] < 0 and x[1] is not None)[:k]]
    return {item: found for item, found in out.items() if found}


def ranked(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.item_id, r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_treaps_rank_as_brute_force(spark, docs_of, seed, monkeypatch):
    chance = random.Random(seed)
    word = lambda: chance.choice(["the", "Été", "b1", "x", "Of", "rare" + str(chance.randint(0, 9))])
    rows = [(i, " ".join(word() for _ in range(chance.randint(0, 30)))) for i in range(150)] + [(500, None), (501, ""), (502, "!?"), (None, "the x rare1"), (7, "the x"), (7, "the x"), (600, "Word\0other x" * 400)]
    items = [(i, " ".join(word() for _ in range(chance.randint(1, 12)))) for i in range(12)] + [(90, None), (91, ""), (92, "unknown words"), (93, "the"), (94, "THE the.x")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = searched(rows, items, 9)
    assert ranked(treap_search.search(docs_of(rows), frame, 9)) == want
    monkeypatch.setattr(treap_search.build_index, "__defaults__", ("doc_id", "text", 700))  # many shards
    assert ranked(treap_search.search(docs_of(rows), frame, 9, items_per_pass=5)) == want
    assert treap_search.search(docs_of(rows).where("false"), frame, 9).count() == treap_search.search(docs_of(rows), frame.where("false"), 9).count() == 0


def test_walks_prune_and_lose_nothing():
    chance = np.random.default_rng(5)
    n, terms = 3000, 12
    docs = [np.sort(chance.choice(n, size, replace=False)) for size in chance.integers(5, n, terms)]
    starts, flat = np.concatenate([[0], np.cumsum([len(d) for d in docs])]), np.concatenate(docs)
    impacts = chance.integers(0, 50, len(flat)) ** 3
    treaps = treap_search.Treaps(starts, flat, impacts)
    for low, high in zip(starts[:-1], starts[1:]):
        held = []

        def down(node, most):
            if node >= 0:
                assert impacts[node] <= most
                down(treaps.left[node], impacts[node])
                held.append(node)
                down(treaps.right[node], impacts[node])

        down(treaps.roots[len(starts[starts <= low]) - 1], np.inf)
        assert held == list(range(low, high))
    for own in ([0, 3, 5], [1], list(range(terms))):
        scores = np.zeros(n, dtype=np.int64)
        for t in own:
            np.add.at(scores, docs[t], impacts[starts[t] : starts[t + 1]])
        order = np.lexsort((np.arange(n), -scores))[:20]
        for states in (1, 7, 2048):
            best = treap_search.Best(20)
            scored = treap_search.walk(treaps, np.arange(n), np.array(own), best, states)
            assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
            assert scored < n

"""Construction of range-aware proximity graphs, one per attribute, as edge tables.

An edge ``src`` -> ``dst`` of ranks carries an envelope: it may be used by a
query on ranks [L, R] if ll <= L <= lu and rl <= R <= ru. All steps but one are
relational; the compression of a node's candidates is a bounded kernel per node.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions.vectors import squared_l2
from veldra.operators.exact import candidates, ranked, typed
from veldra.operators.knn import RIGHT_ROWS, _near, _vectors, exact_neighbours, near_by_pieces, summed
from veldra.session import scratch, ship_package
from veldra.sources.binary import header, write_fbin

#: Nodes of a shard are numbered from a multiple of this, in the order of their ranks.
SHARD_SPAN = 1 << 32
#: The share of rows that a short edge spans; such edges are kept first.
SHORT_SHARE = 50
#: Of this many edges of a node one is pruned.
PRUNE_ONE_OF = 11

EDGE = "src long, dst long, ll long, lu long, rl long, ru long"


def neighbours(base: DataFrame, count: int, block_rows: int | None = None) -> DataFrame:
    """``src``, ``pos`` (from 0), ``dst``, ``dist``: the nearest other rows of every row, ties by id; exact, see ``knn.descent_neighbours`` for large tables."""
    return exact_neighbours(base, count, block_rows)


def compress_node(center: int, labels: np.ndarray, dists: np.ndarray, vectors: np.ndarray, n: int, most: int, alpha: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """Kept candidates of a node, each with its envelope (dst, ll, lu, rl, ru).

    Candidates come in the order of distance. Chains of candidates are walked
    depth first: a chain takes a candidate whose rank lies in the chain's open
    range [L, R] and that no member dominates (is nearer to it than the node,
    by alpha). A taken candidate's envelope is the union over its visits of
    [L, caps of the members on the left] x [caps on the right, R]. After a
    candidate beyond the caps was followed, the range ends before it; one
    within the caps ends the walk at that depth.
    """
    square = (vectors**2).sum(axis=1)
    apart = np.maximum(square[:, None] + square[None, :] - 2 * vectors @ vectors.T, 0)
    shadowed = np.packbits(apart < (dists / alpha)[None, :], axis=1, bitorder="little")  # [member, candidate]
    shadows = [int.from_bytes(row.tobytes(), "little") for row in shadowed]
    ranks = labels.tolist()
    order = sorted(range(len(ranks)), key=ranks.__getitem__)
    every = (1 << len(ranks)) - 1
    lit = [every & ~dark for dark in shadows]
    greater, less, so_far = [0] * len(ranks), [0] * len(ranks), 0  # sets of the candidates of greater and of lesser rank, as bits
    for i in order:
        less[i] = so_far
        so_far |= 1 << i
        greater[i] = every & ~so_far
    boxes: dict[int, list[int]] = {}
    # At a depth: candidates still open (not looked at, in the open range, dominated by none of the chain), open range, caps; above it the same and the candidate taken.
    above: list[tuple[int, int, int, int, int, int]] = []
    live, left, right, cap_left, cap_right = every, 0, n - 1, center, center
    while live or above:
        if live:
            bit = live & -live
            i = bit.bit_length() - 1
            live ^= bit
            rank = ranks[i]
            low, high = rank if rank < cap_left else cap_left, rank if rank > cap_right else cap_right
            box = boxes.get(i)
            if box is None:
                boxes[i] = [left, low, high, right]
            else:
                if left < box[0]:
                    box[0] = left
                if low > box[1]:
                    box[1] = low
                if high < box[2]:
                    box[2] = high
                if right > box[3]:
                    box[3] = right
            deeper = live & lit[i] if len(above) + 1 < most else 0
            if deeper:
                above.append((live, left, right, cap_left, cap_right, i))
                live, cap_left, cap_right = deeper, low, high
                continue
        else:
            live, left, right, cap_left, cap_right, i = above.pop()
            rank = ranks[i]
        if rank < cap_left:  # back from the chain that ended in the one taken
            left = rank + 1
            live &= greater[i]
        elif rank > cap_right:
            right = rank - 1
            live &= less[i]
        else:
            live = 0
    return [(ranks[i], *box) for i, box in sorted(boxes.items())]


#: Candidates of a node up to which many nodes are compressed side by side, as bits of one word, and nodes at once.
WORD, SIDE_BY_SIDE = 64, 4096


def compress_nodes(centers: np.ndarray, starts: np.ndarray, labels: np.ndarray, dists: np.ndarray, vectors: np.ndarray, places: np.ndarray, n: np.ndarray, most: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """What ``compress_node`` keeps of many nodes: the node's place, and rows (dst, ll, lu, rl, ru), in its order.

    The candidates of node i are those from ``starts[i]`` to ``starts[i + 1]``; their vectors lie at ``places`` of ``vectors``.
    Nodes of at most WORD candidates walk their chains together, one step of each at a time; others walk alone.
    """
    sizes = np.diff(starts)
    kept_of, kept = [], []
    for i in np.flatnonzero(sizes > WORD).tolist():
        own = slice(starts[i], starts[i + 1])
        edges = compress_node(int(centers[i]), labels[own], dists[own], vectors[places[own]].astype(np.float64), int(n[i]), most, alpha)
        kept_of.append(np.full(len(edges), i)), kept.append(np.array(edges, dtype=np.int64).reshape(-1, 5))
    small = np.flatnonzero((sizes <= WORD) & (sizes > 0))
    for at in range(0, len(small), SIDE_BY_SIDE):
        nodes = small[at : at + SIDE_BY_SIDE]
        of, edges = _side_by_side(centers[nodes], starts[nodes], sizes[nodes], labels, dists, vectors, places, n[nodes], most, alpha)
        kept_of.append(nodes[of]), kept.append(edges)
    of, edges = np.concatenate([*kept_of, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*kept, np.empty((0, 5), np.int64)])
    order = np.argsort(of, kind="stable")
    return of[order], edges[order]


def _side_by_side(centers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, dists: np.ndarray, vectors: np.ndarray, places: np.ndarray, n: np.ndarray, most: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The walks of ``compress_node``, a step of every node at a time; sets of candidates are words, ranges of ranks are ranges of places in their order."""
    m, width, deep = len(centers), int(sizes.max()), most + 1
    one = np.uint64(1)
    inside = np.arange(width)[None, :] < sizes[:, None]
    at = np.where(inside, starts[:, None] + np.arange(width)[None, :], 0)
    ranks = np.where(inside, labels[at], np.iinfo(np.int64).max)
    shadows = np.zeros((m, WORD), dtype=np.uint64)  # of a member, the candidates that it dominates
    for i in range(m):
        own = slice(starts[i], starts[i] + sizes[i])
        v = vectors[places[own]].astype(np.float64)
        square = (v**2).sum(axis=1)
        apart = np.maximum(square[:, None] + square[None, :] - 2 * v @ v.T, 0)
        bits = np.zeros((sizes[i], 8), dtype=np.uint8)
        packed = np.packbits(apart < (dists[own] / alpha)[None, :], axis=1, bitorder="little")
        bits[:, : packed.shape[1]] = packed
        shadows[i, : sizes[i]] = bits.view("<u8")[:, 0]
    order = np.argsort(ranks, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(width)[None, :], axis=1)
    upto = np.zeros((m, width + 1), dtype=np.uint64)  # sets of the candidates of the least ranks
    np.bitwise_or.accumulate(one << order.astype(np.uint64), axis=1, out=upto[:, 1:])
    row = np.arange(m)
    every = upto[row, sizes]
    less = np.take_along_axis(upto, place, axis=1).ravel()  # sets of the candidates of lesser and of greater rank
    greater = (~np.take_along_axis(upto, place + 1, axis=1) & every[:, None]).ravel()
    lit = ~shadows[:, :width].ravel()
    # a frame per depth: candidates still open, the one taken last, and its range and caps so that the least of each is the widest: left, -cap_left, cap_right, -right
    live, taken, frames = np.zeros(m * deep, dtype=np.uint64), np.zeros(m * deep, dtype=np.int64), np.zeros((m * deep, 4), dtype=np.int64)
    root = row * deep
    live[root], frames[root] = every, np.stack([np.zeros(m, dtype=np.int64), -centers, centers, 1 - n], axis=1)
    boxes = np.full((m * width, 4), np.iinfo(np.int64).max)
    ranks = ranks.ravel()

    def back(f: np.ndarray, at: np.ndarray) -> None:
        """Frames to which the chain of the candidate taken last comes back: the range ends before it, or the walk at this depth ends."""
        rank, caps = ranks[at], frames.take(f, axis=0)
        below, above = rank < -caps[:, 1], rank > caps[:, 2]
        frames[f[below], 0], frames[f[above], 3] = rank[below] + 1, 1 - rank[above]
        live[f] &= np.where(below, greater[at], np.where(above, less[at], np.uint64(0)))

    depth, active = np.zeros(m, dtype=np.int64), row
    while len(active):
        i, t = active, depth[active]
        f = i * deep + t
        live_now = live[f]
        done = live_now == 0
        if done.any():
            ended = i[done]
            depth[ended] -= 1
            up = ended[depth[ended] >= 0]
            higher = up * deep + depth[up]
            back(higher, up * width + taken[higher])
            go = ~done
            i, t, f, live_now = i[go], t[go], f[go], live_now[go]
            active = active[depth[active] >= 0]
        bit = live_now & (~live_now + one)
        c = np.log2(bit.astype(np.float64)).astype(np.int64)  # a power of two is exact
        rest, at, own = live_now ^ bit, i * width + c, frames.take(f, axis=0)
        live[f], taken[f] = rest, c
        rank = ranks[at]
        np.maximum(own[:, 1], -rank, out=own[:, 1]), np.maximum(own[:, 2], rank, out=own[:, 2])
        boxes[at] = np.minimum(boxes.take(at, axis=0), own)
        deeper = rest & lit[at]
        on = (deeper != 0) & (t + 1 < most)
        leaf = ~on
        back(f[leaf], at[leaf])
        i, f = i[on], f[on] + 1
        live[f], frames[f] = deeper[on], own[on]
        depth[i] += 1
    boxes *= np.array([1, -1, 1, -1])
    of, c = np.nonzero(boxes[:, 0].reshape(m, width) < np.iinfo(np.int64).max)
    return of, np.concatenate([ranks[of * width + c][:, None], boxes[of * width + c]], axis=1)


def compress(candidate_lists: DataFrame, vectors: DataFrame, n: int | Column, most: int = 16, alpha: float = 1.0) -> DataFrame:
    """Edges with envelopes from rows ``src``, ``dst``, ``dist`` of ranks; each node's bounded list is one kernel call.

    ``n`` is the number of rows, or a column of the lists where graphs of
    several shards are made at once; nodes are then ``node`` numbers.
    """
    ship_package(candidate_lists.sparkSession)
    size = n if isinstance(n, Column) else F.lit(n)
    rows = candidate_lists.withColumn("n", size.cast("long")).join(vectors.select(F.col("id").alias("dst"), "v"), "dst")
    lists = rows.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst", "v"))).alias("c"), F.first("n").alias("n"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for src, own, count in zip(batch.column("src").to_pylist(), batch.column("c"), batch.column("n").to_pylist()):
                fields = own.values
                labels = np.asarray(fields.field("dst"), dtype=np.int64)
                first = src - src % SHARD_SPAN
                v = np.asarray(fields.field("v").flatten(), dtype=np.float64).reshape(len(labels), -1)
                edges = compress_node(src - first, labels - first, np.asarray(fields.field("dist")), v, count, most, alpha)
                out += [(src, first + dst, *box) for dst, *box in edges]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["src", "dst", "ll", "lu", "rl", "ru"])

    return lists.mapInArrow(kernel, EDGE)


def symmetrised(edges: DataFrame, *keep: str, by_node: bool = False) -> DataFrame:
    """Edges both ways with the same envelope; of several between two nodes the union of envelopes. Columns ``keep`` are the same for all edges of a graph; with them or ``by_node``, edges are dealt by node, as ``pruned`` asks for."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ll", "lu", "rl", "ru", *keep)
    both = edges.select("src", "dst", "ll", "lu", "rl", "ru", *keep).unionByName(back)
    both = both.repartition("src") if keep or by_node else both  # what follows is by node, too
    return both.groupBy("src", "dst", *keep).agg(F.min("ll").alias("ll"), F.max("lu").alias("lu"), F.min("rl").alias("rl"), F.max("ru").alias("ru"))


def supported(edges: DataFrame, n: int | Column) -> DataFrame:
    """Adds ``support`` (query ranges that the envelope admits), ``score`` (support over the edge's length) and ``protected`` (short edges)."""
    length = F.abs(F.col("dst") - F.col("src")) + 1
    support = (F.col("lu") - F.col("ll") + 1) * (F.col("ru") - F.col("rl") + 1)
    return edges.withColumn("support", support).withColumn("score", F.expr("support div (abs(dst - src) + 1)")).withColumn("protected", length <= F.ceil((n if isinstance(n, Column) else F.lit(n)) / SHORT_SHARE))


def pruned(edges: DataFrame, n: int | Column, *keep: str) -> DataFrame:
    """Of the edges, those that stay: a node loses one in ``PRUNE_ONE_OF`` of its edges, those of the least score, protected ones last; ties by dst."""
    own = Window.partitionBy("src")
    order = own.orderBy(F.desc("protected"), F.desc("score"), "dst")
    ranked_edges = supported(edges, n).withColumns({"nth": F.row_number().over(order), "degree": F.count("*").over(own)})
    return ranked_edges.where(F.col("nth") <= F.col("degree") - F.floor(F.col("degree") / PRUNE_ONE_OF)).select("src", "dst", "ll", "lu", "rl", "ru", *keep)


def eligible(edges: DataFrame, query_ranges: DataFrame, n: int, small_share: float = 0.02) -> DataFrame:
    """``qid``, ``src``, ``dst`` of edges usable for stated queries ``qid``, ``lo``, ``hi``; within small ranges envelopes are not tested.

    A query is a point (lo, hi) and an edge a box of such points, or two: one
    for small ranges, which both ends must lie in, and its envelope for others.
    A box lies in at most four cells of the grid whose cells are powers of two
    no smaller than its sides; a point lies in one cell of each grid that has
    boxes. Points and boxes are joined by cell, and tested exactly there.
    """
    width = max(0, -int(-(small_share * n) // 1) - 1)  # the longest small range
    first, last = F.least("src", "dst"), F.greatest("src", "dst")
    envelope = F.struct(F.lit(False).alias("small"), F.col("ll").alias("a"), F.least("lu", first).alias("b"), F.greatest("rl", last).alias("c"), F.col("ru").alias("d"))
    narrow = F.struct(F.lit(True).alias("small"), (last - width + 1).alias("a"), first.alias("b"), last.alias("c"), (first + width - 1).alias("d"))
    cast = "struct<small:boolean,a:bigint,b:bigint,c:bigint,d:bigint>"
    boxes = edges.select("src", "dst", F.explode(F.array(envelope.cast(cast), narrow.cast(cast))).alias("x")).select("src", "dst", "x.*").where("a <= b and c <= d")
    level = lambda low, high: F.length(F.conv(F.col(high) - F.col(low), 10, 2)).cast("int")
    cells = lambda low, high, size: F.explode(F.sequence(F.expr(f"shiftright({low}, {size})"), F.expr(f"shiftright({high}, {size})")))
    placed = boxes.withColumns({"g": level("a", "b"), "h": level("c", "d")}).withColumn("p", cells("a", "b", "g")).withColumn("q", cells("c", "d", "h"))
    grids = F.array(*[F.struct(F.lit(r.g).alias("g"), F.lit(r.h).alias("h")) for r in placed.select("g", "h").distinct().collect()] or [F.lit(None).cast("struct<g:int,h:int>")])  # at most 64 x 64
    points = query_ranges.select("qid", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.explode(grids).alias("x")).where("x is not null")
    points = points.select("qid", "lo", "hi", (F.col("hi") - F.col("lo") + 1 < F.lit(small_share * n)).alias("small"), "x.g", "x.h")
    points = points.withColumns({"p": F.expr("shiftright(lo, g)"), "q": F.expr("shiftright(hi, h)")})
    met = placed.join(points, ["small", "g", "h", "p", "q"])
    return met.where(F.col("lo").between(F.col("a"), F.col("b")) & F.col("hi").between(F.col("c"), F.col("d"))).select("qid", "src", "dst")


def edge_boxes(edges: DataFrame, ranks: DataFrame, primary: int, n: int) -> DataFrame:
    """``src``, ``dst``, ``attr``, ``low_lo``, ``low_hi``, ``high_lo``, ``high_hi``: the envelope for the primary attribute, else what the destination's rank admits."""
    rank = ranks.select(F.col("id").alias("dst"), "attr", "rnk")
    own = F.col("attr") == primary
    joined = edges.join(rank, "dst")
    return joined.select(
        "src", "dst", "attr", F.when(own, F.col("ll")).otherwise(0).alias("low_lo"), F.when(own, F.col("lu")).otherwise(F.col("rnk")).alias("low_hi"),
        F.when(own, F.col("rl")).otherwise(F.col("rnk")).alias("high_lo"), F.when(own, F.col("ru")).otherwise(F.lit(n - 1)).alias("high_hi"),
    )


def statistics(edges: DataFrame) -> DataFrame:
    """``rows``, ``edges``, ``avg_deg``, ``self_loops``, ``dup_edges`` of an edge table."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.agg(
        F.count_distinct("src").alias("rows"), F.sum("n").alias("edges"), (F.sum("n") / F.count_distinct("src")).alias("avg_deg"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("self_loops"), F.sum(F.col("n") - 1).alias("dup_edges"),
    )


def build(base: DataFrame, ranks: DataFrame, attribute: int, n: int, ef: int = 64, most: int = 16, alpha: float = 1.0) -> DataFrame:
    """The graph of one attribute: candidates, compression in rank space, symmetry, pruning."""
    own = ranks.where(F.col("attr") == attribute)
    placed = base.select("id", "v").join(own, "id").select(F.col("rnk").alias("id"), "v")
    lists = neighbours(placed, ef)
    return pruned(symmetrised(compress(lists, placed, n, most, alpha)), n)


def recompressed(edges: DataFrame, changed: DataFrame, vectors: DataFrame, n: int, most: int = 16, alpha: float = 1.0) -> DataFrame:
    """Edges after the rows of ``changed`` (``src``) are compressed anew from the edges they have; other rows stay."""
    a, b = vectors.select(F.col("id").alias("src"), F.col("v").alias("sv")), vectors.select(F.col("id").alias("dst"), F.col("v").alias("dv"))
    own = edges.join(changed, "src", "left_semi").join(a, "src").join(b, "dst").select("src", "dst", squared_l2(F.col("sv"), F.col("dv")).alias("dist"))
    new = pruned(compress(own, vectors, n, most, alpha), n)
    return edges.join(changed, "src", "left_anti").select("src", "dst", "ll", "lu", "rl", "ru").unionByName(new)


def inserted(edges: DataFrame, new_rows: DataFrame, vectors: DataFrame, n: int, ef: int = 64, most: int = 16) -> DataFrame:
    """Edges after rows ``id``, ``v`` (already in ``vectors``) are searched exactly, linked both ways, and the nodes they reach recompressed."""
    near = candidates(vectors.select("id", "v"), new_rows.select(F.col("id").alias("qid"), F.col("v").alias("qv")), ef + 1).where("qid <> id")
    lists = ranked(near.withColumn("dist", squared_l2(F.col("v"), F.col("qv"))), ef).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")
    own = symmetrised(compress(lists, vectors, n, most))
    touched = own.select("src").distinct()
    return recompressed(symmetrised(edges.select("src", "dst", "ll", "lu", "rl", "ru").unionByName(own)), touched, vectors, n, most)


def checked_labels(labels: DataFrame, n: int) -> None:
    """Refuse labels ``rnk`` of a graph's rows that repeat, are null or lie outside 0 .. n - 1."""
    seen = labels.agg(F.count("*").alias("n"), F.count_distinct("rnk").alias("d"), F.min("rnk").alias("lo"), F.max("rnk").alias("hi")).first()
    if seen.n != seen.d or seen.n and (seen.lo < 0 or seen.hi >= n):
        raise ValueError("labels must be unique and lie in the range of the rows")


#: Nodes that a task links to the rows of a whole table, and rows of it that they meet at once, as a multiple of the candidates: the first of these bound what others add.
TABLE_NODES, TABLE_ROWS = 256, 160


def table_edges(path: str, n: int, dim: int, spark: SparkSession, count: int, most: int, alpha: float = 1.0) -> DataFrame:
    """Compressed edges of the rows of an ``fbin`` file in the order of their ranks: every row's ``count`` nearest others, exact, ties by rank.

    A task links TABLE_NODES rows. It meets the file a piece at a time through a map of it and holds only the candidates of
    its rows, so that neither vectors nor candidates are shuffled and its memory does not grow with the table.
    """
    ship_package(spark)
    step = max(RIGHT_ROWS, TABLE_ROWS * count)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                rows = np.memmap(path, dtype="<f4", mode="r", offset=8, shape=(n, dim))
                ids = np.arange(part * TABLE_NODES, min(n, (part + 1) * TABLE_NODES))
                pieces = ((np.arange(at, min(n, at + step)), rows[at : at + step].astype(np.float64)) for at in range(0, n, step))
                src, dst, dist = near_by_pieces(ids, pieces, rows[ids].astype(np.float64), count)
                centers, starts = np.unique(src, return_index=True)
                of, edges = compress_nodes(centers, np.append(starts, len(src)), dst, dist, rows, dst, np.full(len(centers), n), most, alpha)
                yield pa.RecordBatch.from_arrays([pa.array(centers[of]), *(pa.array(np.ascontiguousarray(edges[:, i])) for i in range(5))], ["src", "dst", "ll", "lu", "rl", "ru"])

    parts = -(-n // TABLE_NODES)
    return spark.range(0, parts, 1, min(parts, 10_000)).mapInArrow(kernel, EDGE)


def build_static(base: DataFrame, ranks: DataFrame, attribute: int, k: int = 16, ef_max: int = 400, alpha: float = 1.0) -> DataFrame:
    """The graph of one attribute with the published settings, after its labels are checked.

    Candidates are many, so tasks read the vectors from one file in the order of the labels. Where the shared folder is no mount
    or the labels leave numbers out, blocks of rows meet instead (``build``), which shuffles the candidates; the edges are the same.
    """
    n = base.count()
    own = ranks.where(F.col("attr") == attribute)
    checked_labels(own, n)
    spark = base.sparkSession
    path = re.sub("^file:/+", "/", scratch(spark, "static-vectors"))
    placed = base.select("id", "v").join(own, "id").select(F.col("rnk").alias("id"), F.col("v").cast("array<float>").alias("v"))
    if n < 2 or not path.startswith("/") or placed.count() != n:
        return build(base, ranks, attribute, n, ef_max, k, alpha)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    write_fbin(placed, path)
    return pruned(symmetrised(table_edges(path, n, header(path, 2)[1], spark, ef_max, k, alpha), by_node=True), n)


#: The form of stored graphs.
GRAPH_VERSION = 1


def save(edges: DataFrame, path: str, n: int | None = None, **settings: str) -> None:
    """Files sorted by node under ``edges``, one folder per attribute if there is an ``attr`` column, and one row under ``meta``.

    The row holds the form's version, the number of rows of the table and of
    edges, and settings of the build; it is written last, so that a folder
    without it is no graph.
    """
    spark = edges.sparkSession
    rows = edges.repartitionByRange("src").sortWithinPartitions("src", "dst")
    (rows.write.partitionBy("attr") if "attr" in edges.columns else rows.write).mode("errorifexists").parquet(f"{path}/edges")
    count = spark.read.parquet(f"{path}/edges").count()
    meta = [(GRAPH_VERSION, -1 if n is None else n, count, {k: str(v) for k, v in settings.items()})]
    spark.createDataFrame(meta, "version int, rows long, edges long, settings map<string,string>").coalesce(1).write.parquet(f"{path}/meta")


def load(spark, path: str, n: int | None = None) -> tuple[DataFrame, dict]:
    """The edges of a stored graph and its row of ``meta``; refused if the version, the table's size or the number of edges differs."""
    meta = spark.read.parquet(f"{path}/meta").first()
    edges = spark.read.parquet(f"{path}/edges")
    if meta.version != GRAPH_VERSION:
        raise ValueError(f"the graph has form {meta.version}, not {GRAPH_VERSION}")
    if n is not None and meta["rows"] != n:
        raise ValueError(f"the graph is of {meta['rows']} rows, the table has {n}")
    if edges.count() != meta["edges"]:
        raise ValueError("edges of the graph are missing")
    return edges, meta.asDict()


def insertion_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: nodes ``inserted``, ``edges_added``, ``edges_removed`` and nodes ``touched`` between two edge tables."""
    a, b = before.select("src", "dst", F.lit(1).alias("x")), after.select("src", "dst", F.lit(1).alias("y"))
    both = a.join(b, ["src", "dst"], "full")
    known = before.select("src").distinct()
    new = after.select("src").distinct().join(known, "src", "left_anti").agg(F.count("*").alias("inserted"))
    counts = both.agg(F.count_if(F.col("x").isNull()).alias("edges_added"), F.count_if(F.col("y").isNull()).alias("edges_removed"), F.count_distinct(F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("src"))).alias("touched"))
    return new.crossJoin(counts)


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counts over a graph of ``nodes`` (``id``): self loops, repeated edges, edges to or from no node, nodes that no edge reaches."""
    own = nodes.select("id").distinct()
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    repeated = edges.groupBy("src", "dst").agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("repeated"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    dangling = ends.join(own, "id", "left_anti").agg(F.count("*").alias("dangling"))
    unreached = own.join(edges.where("src <> dst").select(F.col("dst").alias("id")).distinct(), "id", "left_anti").agg(F.count("*").alias("unreached"))
    return loops.crossJoin(repeated).crossJoin(dangling).crossJoin(unreached)


def sharded_nodes(base: DataFrame, attributes: list[str], indexed: list[int], shard_rows: int, shard: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """``attr``, ``shard``, ``n`` (rows of the shard), ``node``, ``id``, ``v``, the attributes and ``extra`` columns: each shard's rows numbered by (value, id) of each indexed attribute.

    Shards are dealt by a hash of the id, about ``shard_rows`` rows each, or
    given by a column of numbers below the number of shards. A row
    whose attribute is null is in no range over it, and so not in its graph.
    Whole numbers stay such, other attributes become floats.
    """
    shards = max(1, -(-base.count() // shard_rows)) if shard is None else (base.agg(F.max(shard)).first()[0] or 0) + 1
    dealt = base.select("id", "v", *typed(base, attributes), *(extra or []), (F.pmod(F.xxhash64("id"), F.lit(shards)) if shard is None else shard).alias("shard"))
    orders = {i: F.row_number().over(Window.partitionBy("shard").orderBy(F.col(attributes[i]).asc_nulls_last(), "id")) - 1 for i in indexed}
    counts = {i: F.count(attributes[i]).over(Window.partitionBy("shard")) for i in indexed}
    each = F.explode(F.array(*[F.when(F.col(attributes[i]).isNotNull(), F.struct(F.lit(i).alias("attr"), F.col(f"__rnk{i}").alias("rnk"), F.col(f"__n{i}").alias("n"))) for i in indexed]))
    numbered = dealt.withColumns({f"__rnk{i}": o for i, o in orders.items()} | {f"__n{i}": c for i, c in counts.items()}).withColumn("x", each).where("x is not null")
    numbered = numbered.select("x.attr", "x.rnk", "x.n", "shard", "id", "v", *attributes, *(extra or []))
    node = (F.col("attr").cast("long") * shards + F.col("shard")) * SHARD_SPAN + F.col("rnk")
    return numbered.select("attr", "shard", "n", node.alias("node"), "id", "v", *attributes, *(extra or []))


#: Nodes of a shard that one task links, at least; and graphs of shards from which on a task links a whole one.
PART_ROWS, WHOLE_GRAPHS = 4096, 64


def shard_parts(graphs: int) -> Column:
    """Tasks that link a shard of ``n`` rows, of so many graphs of shards."""
    return F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(-(-WHOLE_GRAPHS // graphs)))


def shard_edges(nodes: DataFrame, ef: int, most: int, alpha: float = 1.0) -> DataFrame:
    """Compressed edges of ``node`` numbers with ``attr``, ``shard``, ``n``: every row's ``ef`` nearest others within its shard, exact, ties by node.

    Every task has the rows of one shard, and links them all or, where there
    are few shards, a part of about PART_ROWS: a shard's rows are sent once a
    part. Their candidates and the candidates' vectors never leave the task.
    """
    ship_package(nodes.sparkSession)
    graphs = max(1, nodes.select("attr", "shard").distinct().count())
    parts = shard_parts(graphs)
    rows = nodes.select("attr", "shard", "n", "node", "v", parts.alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumn("linked", F.pmod("node", F.col("parts")) == F.col("part")).drop("parts")

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, v, n = np.asarray(table["node"], dtype=np.int64), _vectors(table), table.num_rows
        first = int(node[0] - node[0] % SHARD_SPAN)
        linked = np.flatnonzero(np.asarray(table["linked"], dtype=bool))
        out = [np.empty((0, 6), dtype=np.int64)]
        for at in range(0, len(linked), SIDE_BY_SIDE):
            own = linked[at : at + SIDE_BY_SIDE]
            src, dst, dist = _near(node[own], v[own], node, v, ef, summed)
            centers, starts = np.unique(src - first, return_index=True)  # rows of one node lie together, nearest first
            of, edges = compress_nodes(centers, np.append(starts, len(src)), dst - first, dist, v, dst - first, np.full(len(centers), n), most, alpha)
            out.append(np.concatenate([first + centers[of][:, None], first + edges[:, :1], edges[:, 1:]], axis=1))
        made = np.concatenate(out)
        columns = {c: pa.array(made[:, i]) for i, c in enumerate(("src", "dst", "ll", "lu", "rl", "ru"))}
        same = {c: pa.array(np.full(len(made), table[c][0].as_py()), table[c].type) for c in ("attr", "shard", "n")}
        return pa.table(columns | same)

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in ("attr", "shard", "n"))
    dealt = rows.repartition(min(4096, 2 * max(graphs, WHOLE_GRAPHS)), "attr", "shard", "part")  # by their bytes many would be put into one task
    return dealt.groupBy("attr", "shard", "part").applyInArrow(lambda t: kernel(t), f"{EDGE}, {kinds}")


def build_sharded(nodes: DataFrame, ef: int = 64, most: int = 16, alpha: float = 1.0) -> DataFrame:
    """``attr``, ``shard`` and edges of ``node`` numbers: graphs of all shards and indexed attributes of ``sharded_nodes`` at once.

    No step holds more than one shard's rows or one node's list in a task, and nothing passes the driver.
    """
    keep = ["attr", "shard", "n"]
    kept = pruned(symmetrised(shard_edges(nodes, ef, most, alpha), *keep), F.col("n"), *keep)
    return kept.select("attr", "shard", "src", "dst", "ll", "lu", "rl", "ru")


def valid_condition(n: int) -> Column:
    """What every edge of a graph of n rows meets."""
    return F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1) & (F.col("src") != F.col("dst")) & (F.col("ll") <= F.col("lu")) & (F.col("rl") <= F.col("ru"))

"""Nearest rows of every row: exact by pairs of blocks, or approximate by descent over neighbours of neighbours.

Neither form sends rows to the driver. ``exact_neighbours`` compares all rows
with all, as two-dimensional blocks, and is meant for tables for which that is
wanted. ``descent_neighbours`` starts from rows that fall on the same side of
random hyperplanes and then, round by round, lets the neighbours of a row meet
each other: work grows with the rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.session import Scratch, ship_package, stored

#: Blocks that the exact form deals rows into, and the least and most rows of a block; two blocks meet in one task.
BLOCKS, BLOCK_ROWS, BLOCK_MOST = 12, 4096, 65_536
#: Rows of two blocks that meet in one matrix, and pairs that are measured exactly at once.
LEFT_ROWS, RIGHT_ROWS, MEASURED = 256, 8192, 16_384
#: Trees of hyperplanes that the descent starts from, and rows of a leaf, about.
TREES, LEAF_ROWS = 6, 200
#: Most rows of a leaf; larger ones, as of equal vectors, are parted by a hash of the id.
LEAF_MOST = 2 * LEAF_ROWS
#: Neighbours, of those that point to a row and those it points to, that meet in a round.
SAMPLE = 16
#: Rounds at most, and the share of changed neighbours below which they end.
ROUNDS, LEAST_CHANGE = 8, 0.002

PAIR = "src long, dst long, dist double"


def _vectors(table: pa.Table, column: str = "v") -> np.ndarray:
    return np.asarray(pa.concat_arrays(table.column(column).chunks).flatten() if table.num_rows else [], dtype=np.float64).reshape(table.num_rows, -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed from left to right as the column expression does."""
    return np.cumsum((a - b) ** 2, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in the order that is fastest."""
    return ((a - b) ** 2).sum(axis=1)


def _true_places(flags: np.ndarray) -> np.ndarray:
    """Places of the few true flags in a flattened array, looked for eight at a time."""
    flat = np.ascontiguousarray(flags).ravel()
    whole = len(flat) // 8 * 8
    some = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([some[flat[some]], whole + np.flatnonzero(flat[whole:])])


def _near(left_ids: np.ndarray, left: np.ndarray, right_ids: np.ndarray, right: np.ndarray, count: int, measure=_exact, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each left row's ``count`` nearest other right rows, ties by id; with ``within``, those at most so far from it.

    A few left rows meet the right ones a piece at a time, in one matrix of
    bounded size. A row's ``count`` least upper bounds so far give a limit, and
    of every piece only what may lie below it is measured exactly.
    """
    src, dst, dist = [], [], []
    norms = (right**2).sum(axis=1)
    most = float(max((left**2).max(initial=0), (right**2).max(initial=0))) * max(1, right.shape[1])
    kind = np.float32 if most < 1e30 and 1e-30 < most else np.float64  # rough distances; the slack covers their rounding
    slack_of = (4 * right.shape[1] + 32) * float(np.finfo(kind).eps)
    rough_right = np.ascontiguousarray(np.concatenate([right, norms[:, None]], axis=1).astype(kind).T)  # a product with (-2 v, 1) is the distance less the left row's own norm
    order = np.argsort(right_ids, kind="stable")
    first, last = (np.searchsorted(right_ids[order], left_ids, side=x) for x in ("left", "right"))
    for at in range(0, len(left), LEFT_ROWS):
        some, ids = left[at : at + LEFT_ROWS], left_ids[at : at + LEFT_ROWS]
        own = (some**2).sum(axis=1)
        slack = slack_of * (own + norms.max(initial=0) + 1e-30)
        twice = np.concatenate([-2 * some, np.ones((len(some), 1))], axis=1).astype(kind)
        copies = last[at : at + LEFT_ROWS] - first[at : at + LEFT_ROWS]
        self_row = np.repeat(np.arange(len(some)), copies)  # where a row meets itself
        self_col = order[np.repeat(first[at : at + LEFT_ROWS] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())]
        limit = np.full(len(some), np.inf) if within is None else within[at : at + LEFT_ROWS].copy()
        best_d, best_id, best_row = np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for start in range(0, len(right), RIGHT_ROWS):
            rough = twice @ rough_right[:, start : start + RIGHT_ROWS]
            here = (self_col >= start) & (self_col < start + RIGHT_ROWS)
            rough[self_row[here], self_col[here] - start] = np.inf
            if not start and rough.shape[1] > count and not np.isfinite(limit).all():
                limit = np.partition(rough, count - 1, axis=1)[:, count - 1].astype(np.float64) + own + slack
            row, col = np.divmod(_true_places(rough <= (limit - own + 2 * slack)[:, None].astype(kind)), rough.shape[1])
            finite = np.isfinite(rough[row, col])
            row, col = row[finite], col[finite] + start
            d, i, r = [best_d], [best_id], [best_row]
            for part in range(0, len(row), MEASURED):  # vectors of so many pairs at once
                x, y = row[part : part + MEASURED], col[part : part + MEASURED]
                d.append(measure(some[x], right[y])), i.append(right_ids[y]), r.append(x)
            best_d, best_id, best_row = np.concatenate(d), np.concatenate(i), np.concatenate(r)
            best = np.lexsort((best_id, best_d, best_row))
            placed = best_row[best]
            best = best[np.arange(len(best)) - np.searchsorted(placed, placed) < count]
            best_d, best_id, best_row = best_d[best], best_id[best], best_row[best]
            held = np.bincount(best_row, minlength=len(some))
            full = held >= count
            ends = np.cumsum(held) - 1
            limit[full] = np.minimum(limit[full], best_d[ends[full]])
        src.append(ids[best_row]), dst.append(best_id), dist.append(best_d)
    join = lambda x, t: np.concatenate([*x, np.empty(0, t)]).astype(t)
    return join(src, np.int64), join(dst, np.int64), join(dist, np.float64)


def near_by_pieces(ids: np.ndarray, pieces: Iterator[tuple[np.ndarray, np.ndarray]], left: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_near`` for right rows that come a piece (ids, vectors) at a time: of the rows so far only the best are held, and the last of them bounds what a piece may add."""
    best, limit = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.full(len(ids), np.inf)
    place = np.argsort(ids, kind="stable")
    for other, right in pieces:
        src, dst, dist = (np.concatenate(x) for x in zip(best, _near(ids, left, other, right, count, within=limit)))
        order = np.lexsort((dst, dist, src))
        placed = src[order]
        order = order[np.arange(len(order)) - np.searchsorted(placed, placed) < count]
        best = src, dst, dist = src[order], dst[order], dist[order]
        ends = np.searchsorted(src, ids[place], side="right")
        full = ends - np.searchsorted(src, ids[place]) == count
        limit[place[full]] = dist[ends[full] - 1]
    return best


def _pairs(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "dist": pa.array(dist, pa.float64())})


def nearest_of(pairs: DataFrame, count: int) -> DataFrame:
    """``src``, ``pos`` (from 0), ``dst``, ``dist``: the first ``count`` of each row by (distance, id); a task keeps no more of a row before the shuffle."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return pairs.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < count).select("src", "pos", "dst", "dist")


def block_count(n: int, block_rows: int | None = None) -> int:
    """Blocks of about ``block_rows`` rows, or at most BLOCKS of them as long as none is larger than BLOCK_MOST."""
    if block_rows is None:
        block_rows = min(BLOCK_MOST, max(BLOCK_ROWS, -(-n // BLOCKS)))
    return max(1, -(-n // block_rows))


def exact_neighbours(base: DataFrame, count: int, block_rows: int | None = None) -> DataFrame:
    """``src``, ``pos`` (from 0), ``dst``, ``dist``: the nearest other rows of every row, ties by id.

    Rows are dealt into blocks by a hash of the id, and every block meets every
    other in a task of its own; so each row is sent to twice as many tasks as
    there are blocks, of which there are at most BLOCKS up to BLOCKS times
    BLOCK_MOST rows. Work grows with the square of the rows. Ids are unique.
    """
    ship_package(base.sparkSession)
    blocks = block_count(base.count(), block_rows)
    every = F.array(*[F.lit(b) for b in range(blocks)])
    rows = base.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    left = rows.select("id", "v", F.col("own").alias("a"), F.explode(every).alias("b"))
    right = rows.select(F.col("id").alias("other"), F.col("v").alias("w"), F.col("own").alias("d"), F.explode(every).alias("c"))  # names of their own: both sides stem from one frame
    tasks = max(1, min(blocks * blocks, 10_000))

    def kernel(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not mine.num_rows or not others.num_rows:
            return _pairs(*[np.empty(0)] * 3)
        return _pairs(*_near(np.asarray(mine["id"], dtype=np.int64), _vectors(mine), np.asarray(others["other"], dtype=np.int64), _vectors(others, "w"), count))

    met = left.repartition(tasks, "a", "b").groupBy("a", "b").cogroup(right.repartition(tasks, "c", "d").groupBy("c", "d")).applyInArrow(lambda m, o: kernel(m, o), PAIR)
    return nearest_of(met, count)


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(bits, dim))


def leaves(rows: DataFrame, bits: int, trees: int = TREES) -> DataFrame:
    """``tree``, ``leaf``, ``id``, ``v``: for each tree, the side of ``bits`` hyperplanes that a row lies on.

    Planes go through the mean of the rows. A leaf with too many rows is parted by a hash of the id, which loses
    candidates between its parts in this tree only.
    """
    means = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x")).collect()  # a row per dimension
    centre = np.array([r.x for r in sorted(means)])

    def kernel(batches):
        planes = [_planes(len(centre), bits, seed) for seed in range(trees)]
        for batch in batches:
            v = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(batch.num_rows, -1) - centre
            codes = [(v @ p.T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(v), dtype=np.int64) for p in planes]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(np.stack(codes, axis=1).astype(np.int64).tolist(), pa.list_(pa.int64()))], ["id", "v", "codes"])

    coded = rows.mapInArrow(kernel, "id long, v array<float>, codes array<long>").select("id", "v", F.posexplode("codes").alias("tree", "leaf"))
    sizes = coded.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > LEAF_MOST).select("tree", "leaf", F.ceil(F.col("n") / LEAF_ROWS).alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "tree"), F.col("parts")))
    return coded.join(large, ["tree", "leaf"], "left").select("tree", "leaf", part.alias("part"), "id", "v")


def descent_neighbours(base: DataFrame, count: int, rounds: int = ROUNDS, sample: int = SAMPLE, trees: int = TREES, work_report: list | None = None) -> DataFrame:
    """``src``, ``pos``, ``dst``, ``dist``: about the nearest other rows of every row.

    Of the rows of a leaf every two meet first. In a round, every row's sample
    of neighbours, at most ``sample`` that it has and ``sample`` that have it,
    new ones first, meet each other in a task of the row, each with its vector
    and the distance of its last neighbour so far: only pairs that come before
    one of these are handed on. The best ``count`` of a row are kept by key.
    Rounds end when few neighbours change; ``work_report`` gets the number of
    changes of each. Ids are unique; rows of one vector are neighbours like others.
    """
    spark = base.sparkSession
    ship_package(spark)
    rows = stored(base.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")), "knn-rows")
    n = rows.count()
    bits = max(0, (max(1, n) // LEAF_ROWS).bit_length())

    def within(table: pa.Table) -> pa.Table:
        ids, v = np.asarray(table["id"], dtype=np.int64), _vectors(table)
        return _pairs(*_near(ids, v, ids, v, count)) if len(ids) > 1 else _pairs(*[np.empty(0)] * 3)

    first = leaves(rows, bits, trees).groupBy("tree", "leaf", "part").applyInArrow(lambda t: within(t), PAIR)
    graph = stored(nearest_of(first.groupBy("src", "dst").agg(F.first("dist").alias("dist")), count).withColumn("fresh", F.lit(True)), "knn-graph")
    for _ in range(rounds):
        last = graph.groupBy("src").agg(F.max("dist").alias("worst"), F.count("*").alias("own"))
        last = last.select(F.col("src").alias("member"), F.when(F.col("own") < count, F.lit(float("inf"))).otherwise(F.col("worst")).alias("worst"))
        with Scratch(spark) as work:
            picked = Window.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("at", "member"))
            sides = [graph.select(F.col(a).alias("at"), F.col(b).alias("member"), "fresh") for a, b in (("src", "dst"), ("dst", "src"))]
            some = [s.withColumn("nth", F.row_number().over(picked)).where(F.col("nth") <= sample).drop("nth") for s in sides]
            meeting = some[0].unionByName(some[1]).groupBy("at", "member").agg(F.max("fresh").alias("fresh"))
            full = rows.withColumnRenamed("id", "member").join(last, "member", "left").na.fill(float("inf"), ["worst"])
            met = meeting.join(full, "member").groupBy("at").applyInArrow(lambda t: _introduced(t), PAIR)
            better = work.store(met.groupBy("src", "dst").agg(F.first("dist").alias("dist")), "knn-met")
            known = graph.select("src", "dst", "dist", F.lit(True).alias("known"))
            both = known.unionByName(better.withColumn("known", F.lit(False))).groupBy("src", "dst").agg(F.first("dist").alias("dist"), F.max("known").alias("known"))
            order = Window.partitionBy("src").orderBy("dist", "dst")
            graph = stored(both.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < count).select("src", "pos", "dst", "dist", (~F.col("known")).alias("fresh")), "knn-graph")
        changed = graph.where("fresh").count()
        if work_report is not None:
            work_report.append(changed)
        if changed <= LEAST_CHANGE * n * count:
            break
    return graph.select("src", "pos", "dst", "dist")


def _introduced(table: pa.Table) -> pa.Table:
    """Pairs of a row's sampled neighbours, of which one is new, that come before the last neighbour of one of them."""
    ids, v, worst, fresh = np.asarray(table["member"], dtype=np.int64), _vectors(table), np.asarray(table["worst"], dtype=np.float64), np.asarray(table["fresh"], dtype=bool)
    a, b = np.triu_indices(len(ids), 1)
    some = fresh[a] | fresh[b]
    a, b = a[some], b[some]
    gaps = _exact(v[a], v[b])
    forth, back = gaps <= worst[a], gaps <= worst[b]
    return _pairs(np.concatenate([ids[a[forth]], ids[b[back]]]), np.concatenate([ids[b[forth]], ids[a[back]]]), np.concatenate([gaps[forth], gaps[back]]))

"""Approximate search over sharded graphs: bounded best-first walks, one task a shard.

A shard's graph and vectors in rank order are arrays of one task; stated
queries are sent to all shards. A walk admits only rows that pass the exact
test of every range. What it proposes is measured and ranked again by the exact
column expression.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions.vectors import squared_l2
from veldra.operators.exact import Ranges, _bounds, exact_topk, query_blocks, ranked, whole_numbers, with_queries
from veldra.session import ship_package

#: Share of rows below which an interval's edges are not tested by their envelopes.
SMALL_SHARE = 0.02
#: Steps to the right that a seed looks for a row of the graph, and rows that are tried from the left end if none is found.
SEED_STEPS, SEED_SCAN = 64, 4096
#: Admitted rows spaced over a range of which the nearest start a walk, and how many do.
PROBES, PROBE_SEEDS = 256, 8
#: Admitted rows, as a multiple of ef, up to which they are measured all instead of walked to.
SCAN_EF = 8

#: Queries that walk at once: every block of them is a pass over the graphs.
WALK_BLOCK = 16_384


class Graph:
    """A graph of one attribute as arrays: rows in rank order, edges by source."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, edges: np.ndarray):
        self.ids, self.vectors = ids, vectors
        order = np.lexsort((edges[:, 1], edges[:, 0])) if len(edges) else np.empty(0, dtype=np.int64)
        self.edges = edges[order]
        self.first = np.searchsorted(self.edges[:, 0], np.arange(len(ids) + 1)) if len(edges) else np.zeros(len(ids) + 1, dtype=np.int64)

    @classmethod
    def stored(cls, ids: np.ndarray, vectors: np.ndarray, offsets: np.ndarray, edges: np.ndarray) -> Graph:
        """A graph of edges that are sorted by source already: ``dst`` and the envelope, and where each source's begin."""
        graph = cls.__new__(cls)
        graph.ids, graph.vectors, graph.first, graph.edges = ids, vectors, offsets, np.concatenate([np.zeros((len(edges), 1), dtype=edges.dtype), edges], axis=1)
        return graph

    def indexed(self, rank: int) -> bool:
        return self.first[rank + 1] > self.first[rank]

    def seeds(self, left: int, right: int) -> list[int]:
        span = right - left
        out = []
        for start in (left, left + span // 2, left + span // 4, left + 3 * span // 4):
            found = next((r for r in range(start, min(right, start + SEED_STEPS) + 1) if self.indexed(r)), None)
            if found is not None and found not in out:
                out.append(found)
        if not out:
            out = [r for r in range(left, min(right, left + SEED_SCAN) + 1) if self.indexed(r)][:1]
        return out

    def walk(self, query: np.ndarray, left: int, right: int, admitted: np.ndarray, k: int, ef: int, hard_prune: bool = False, probes: int = 0, scan_ef: int = SCAN_EF) -> tuple[list[int], int, int]:
        """Ranks of at most k admitted rows, nearest first, with the numbers of distances and hops.

        A reached row enters the exploration set if that has room or the row is
        strictly nearer than its worst; it enters the results if it entered the
        exploration set and is ``admitted``. Rows that are not are bridges, unless ``hard_prune`` keeps them out altogether. The walk ends
        when both sets are full and the next row is farther than all explored.
        It starts at four places of the range and, with ``probes``, at the
        nearest of so many admitted rows spaced evenly over it: links lead to
        near rows only, and do not join clusters that lie apart. Where fewer
        rows are admitted than a walk would measure anyway, at most ``scan_ef``
        times ef, they are measured all, but for a walk without ``probes``.
        """
        if left > right or k < 1:
            return [], 0, 0
        inside = np.flatnonzero(admitted[left : right + 1]) + left if probes else None
        if inside is not None and len(inside) <= scan_ef * ef:
            gaps = ((self.vectors[inside] - query) ** 2).sum(axis=1)
            return inside[np.lexsort((self.ids[inside], gaps))[:k]].tolist(), len(inside), 0
        small = right - left + 1 < SMALL_SHARE * len(self.ids)
        seen: set[int] = set()
        frontier: list[tuple[float, int]] = []
        explored: list[float] = []  # negated, worst first
        results: list[tuple[float, int]] = []  # negated distance and id, worst first
        distances = hops = 0

        def offer(ranks: np.ndarray) -> None:
            nonlocal distances
            gaps = ((self.vectors[ranks] - query) ** 2).sum(axis=1).tolist()
            distances += len(gaps)
            for rank, d in zip(ranks.tolist(), gaps):
                full = len(explored) >= ef
                if full and d >= -explored[0]:
                    continue
                ok = bool(admitted[rank])
                if hard_prune and not ok:
                    continue
                heappush(frontier, (d, rank))
                heapreplace(explored, -d) if full else heappush(explored, -d)
                if ok:
                    entry = (-d, -int(self.ids[rank]))
                    if len(results) < k:
                        heappush(results, entry)
                        placed[entry] = rank
                    elif entry > results[0]:
                        placed.pop(heapreplace(results, entry), None)
                        placed[entry] = rank

        placed: dict[tuple[float, int], int] = {}
        start = np.array(self.seeds(left, right), dtype=np.int64)
        if inside is not None:
            spaced = inside[np.unique(np.linspace(0, len(inside) - 1, min(probes, len(inside))).astype(np.int64))]
            gaps = ((self.vectors[spaced] - query) ** 2).sum(axis=1)
            distances += len(spaced)
            start = np.unique(np.concatenate([start, spaced[np.argsort(gaps, kind="stable")[:PROBE_SEEDS]]]))
        seen.update(start.tolist())
        if len(start):
            offer(start)
        while frontier:
            d, rank = heappop(frontier)
            if len(explored) >= ef and len(results) >= k and d > -explored[0]:
                break
            hops += 1
            own = self.edges[self.first[rank] : self.first[rank + 1]]
            usable = (own[:, 1] >= left) & (own[:, 1] <= right)
            if not small:
                usable &= (own[:, 2] <= left) & (left <= own[:, 3]) & (own[:, 4] <= right) & (right <= own[:, 5])
            fresh = [r for r in own[usable, 1].tolist() if r not in seen]
            if fresh:
                seen.update(fresh)
                offer(np.array(fresh, dtype=np.int64))
        return [placed[e] for e in sorted(results, reverse=True)], distances, hops


class Documents:
    """A stop condition that counts groups instead of rows: a walk keeps the ``ef`` nearest distinct groups it has met."""

    def __init__(self, groups: np.ndarray, ef: int):
        self.groups, self.ef = groups, ef
        self.kept: list[tuple[float, int]] = []  # negated distance and rank, farthest first
        self.rows: dict[int, int] = {}  # kept rows of each group

    def considers(self, d: float) -> bool:
        return len(self.rows) < self.ef or d < -self.kept[0][0]

    def add(self, rank: int, d: float) -> None:
        group = int(self.groups[rank])
        heappush(self.kept, (-d, rank))
        self.rows[group] = self.rows.get(group, 0) + 1
        while len(self.rows) > self.ef:
            last = int(self.groups[heappop(self.kept)[1]])
            self.rows[last] -= 1
            if not self.rows[last]:
                del self.rows[last]

    def stops(self, d: float) -> bool:
        return len(self.rows) >= self.ef and d > -self.kept[0][0]

    def found(self) -> list[int]:
        return [rank for _, rank in sorted(self.kept, reverse=True)]


class Radius:
    """A stop condition for all rows within a squared distance: the ``most`` nearest, after ``least`` admitted rows of any distance were met."""

    def __init__(self, radius: float, least: int, most: int):
        self.radius, self.least, self.most, self.met = radius, least, most, 0
        self.kept: list[tuple[float, int]] = []

    def considers(self, d: float) -> bool:
        return len(self.kept) < self.most or d < -self.kept[0][0]

    def add(self, rank: int, d: float) -> None:
        self.met += 1
        if d <= self.radius:
            heappush(self.kept, (-d, rank)) if len(self.kept) < self.most else heapreplace(self.kept, max(self.kept[0], (-d, rank)))

    def stops(self, d: float) -> bool:
        return self.met >= self.least and (d > self.radius or len(self.kept) >= self.most and d > -self.kept[0][0])

    def found(self) -> list[int]:
        return [rank for _, rank in sorted(self.kept, reverse=True)]


def walk_until(graph: Graph, query: np.ndarray, left: int, right: int, admitted: np.ndarray, condition: Documents | Radius, probes: int = PROBES) -> list[int]:
    """Ranks that a condition keeps, nearest first: a best-first walk that the condition steers and ends.

    Rows that are not admitted are bridges as far as the condition still
    considers their distance. Starts are those of ``Graph.walk``.
    """
    if left > right:
        return []
    inside = np.flatnonzero(admitted[left : right + 1]) + left
    spaced = inside[np.unique(np.linspace(0, len(inside) - 1, min(probes, len(inside))).astype(np.int64))] if len(inside) else inside
    near = spaced[np.argsort(((graph.vectors[spaced] - query) ** 2).sum(axis=1), kind="stable")[:PROBE_SEEDS]]
    frontier: list[tuple[float, int]] = []
    fresh = np.unique(np.concatenate([np.array(graph.seeds(left, right), dtype=np.int64), near]))
    seen = set(fresh.tolist())
    small = right - left + 1 < SMALL_SHARE * len(graph.ids)
    while True:
        for rank, d in zip(fresh.tolist(), ((graph.vectors[fresh] - query) ** 2).sum(axis=1).tolist()):
            if condition.considers(d):
                heappush(frontier, (d, rank))
                if admitted[rank]:
                    condition.add(rank, d)
        if not frontier:
            return condition.found()
        d, rank = heappop(frontier)
        if condition.stops(d):
            return condition.found()
        own = graph.edges[graph.first[rank] : graph.first[rank + 1]]
        usable = (own[:, 1] >= left) & (own[:, 1] <= right)
        if not small:
            usable &= (own[:, 2] <= left) & (left <= own[:, 3]) & (own[:, 4] <= right) & (right <= own[:, 5])
        fresh = np.array([r for r in own[usable, 1].tolist() if r not in seen], dtype=np.int64)
        seen.update(fresh.tolist())


def _two(kernel):
    """A function of two tables, as a cogroup asks for."""
    return lambda rows, own: kernel(rows, own)


def walk_shards(nodes: DataFrame, edges: DataFrame, queries: DataFrame, attributes: list[str], k: int, ef: int, hard_prune: bool = False, whole: bool = False, judged: DataFrame | None = None, probes: int = PROBES, scan_ef: int = SCAN_EF) -> DataFrame:
    """``qid``, ``rank``, ``id``, ``dist``, ``distances``, ``hops`` of stated queries ``qid``, ``qv``, ``nav_attr``, ``bounds``.

    ``judged`` are ``nodes`` with a flag ``gone``: such rows are bridges and never results.

    ``nodes`` and ``edges`` come from ``graph.sharded_nodes`` and
    ``graph.build_sharded``. Every shard walks the queries that its attribute
    navigates, within the ranks that the query's range has there (all ranks if
    ``whole``), and the shards' results are merged; work is summed over the
    shards that have results.
    Queries without ``nav_attr`` have no rows here: see ``with_fallback``.
    """
    near = lambda graph, rows: lambda query, left, right, admitted: [graph.walk(query, left, right, admitted, k, ef, hard_prune, probes, scan_ef)]
    found = _walked(nodes if judged is None else judged, edges, queries, attributes, near, whole)
    measured = with_queries(found, queries.select("qid", "qv")).withColumn("dist", squared_l2(F.col("v"), F.col("qv")))
    work = Window.partitionBy("qid")
    per_shard = F.sum("distances").over(work), F.sum("hops").over(work)
    return ranked(measured.select("qid", "id", "dist", per_shard[0].alias("distances"), per_shard[1].alias("hops")), k).select("qid", "rank", "id", "dist", "distances", "hops")


def walk_each(nodes: DataFrame, edges: DataFrame, queries: DataFrame, attributes: list[str], k: int, settings: list[tuple[int, bool]], probes: int = PROBES, scan_ef: int = SCAN_EF) -> DataFrame:
    """``walk``, ``qid``, ``rank``, ``id``, ``dist``: what ``walk_shards`` finds with each of the settings (ef, hard_prune), by their places; the graphs are sent to tasks once."""
    near = lambda graph, rows: lambda query, left, right, admitted: [graph.walk(query, left, right, admitted, k, ef, hard, probes, scan_ef) for ef, hard in settings]
    found = _walked(nodes, edges, queries, attributes, near, False)
    measured = with_queries(found, queries.select("qid", "qv")).select("walk", "qid", "id", squared_l2(F.col("v"), F.col("qv")).alias("dist"))
    order = Window.partitionBy("walk", "qid").orderBy("dist", "id")
    return measured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("walk", "qid", "rank", "id", "dist")


def top_documents(nodes: DataFrame, edges: DataFrame, queries: DataFrame, attributes: list[str], group: str, k: int, ef: int, probes: int = PROBES) -> DataFrame:
    """``qid``, the group and ``best_dist``: about the k groups with the nearest row in the ranges; ties by group.

    ``group`` is a whole-number column of the nodes. Every shard's walk goes on
    until it has met ``ef`` distinct groups and the next row is farther than all of them.
    """

    def near(graph: Graph, rows: pa.Table):
        groups = np.asarray(rows.column(group).fill_null(-1), dtype=np.int64)
        return lambda query, left, right, admitted: [(walk_until(graph, query, left, right, admitted & (groups != -1), Documents(groups, ef), probes), 0, 0)]

    found = _walked(nodes, edges, queries, attributes, near, False).select("qid", "id", "v").join(nodes.select("id", group).distinct(), "id")
    measured = with_queries(found, queries.select("qid", "qv")).select("qid", group, squared_l2(F.col("v"), F.col("qv")).alias("dist"))
    return ranked(measured.groupBy("qid", group).agg(F.min("dist").alias("best_dist")), k, "best_dist", group).select("qid", group, "best_dist")


def within_radius(nodes: DataFrame, edges: DataFrame, queries: DataFrame, attributes: list[str], radius: float, least: int, most: int, probes: int = PROBES) -> DataFrame:
    """``qid``, ``id``, ``dist`` of about all rows in the ranges within a squared distance, the ``most`` nearest; a shard's walk meets ``least`` rows before it stops."""
    near = lambda graph, rows: lambda query, left, right, admitted: [(walk_until(graph, query, left, right, admitted, Radius(radius, least, most), probes), 0, 0)]
    found = _walked(nodes, edges, queries, attributes, near, False)
    measured = with_queries(found, queries.select("qid", "qv")).select("qid", "id", squared_l2(F.col("v"), F.col("qv")).alias("dist"))
    return ranked(measured.where(F.col("dist") <= radius), most).select("qid", "id", "dist")


def _walked(nodes: DataFrame, edges: DataFrame, queries: DataFrame, attributes: list[str], walker, whole: bool) -> DataFrame:
    """``walk``, ``qid``, ``id``, ``v``, ``distances``, ``hops`` of what the walks of ``walker(graph, rows)(query, left, right, admitted)``, numbered from 0, find in every shard."""
    spark = nodes.sparkSession
    ship_package(spark)
    out: DataFrame | None = None
    kinds = {"walk": pa.int32(), "qid": pa.int64(), "id": pa.int64(), "v": pa.list_(pa.float32()), "distances": pa.int64(), "hops": pa.int64()}
    schema = "walk int, qid long, id long, v array<float>, distances long, hops long"
    for block in query_blocks(queries.select("qid", "qv", "nav_attr", "bounds").where("nav_attr IS NOT NULL"), WALK_BLOCK):
        low, high = _bounds(block, attributes, whole_numbers(nodes, attributes))
        by_attr: dict[int, list[int]] = {}
        for q, r in enumerate(block):
            by_attr.setdefault(r.nav_attr, []).append(q)
        shared = spark.sparkContext.broadcast((by_attr, np.array([r.qid for r in block], dtype=np.int64), np.array([r.qv for r in block], dtype=np.float64), low, high))

        def kernel(rows: pa.Table, own: pa.Table, shared=shared) -> pa.Table:
            found: list[list[np.ndarray]] = [[] for _ in range(5)]
            vectors = np.empty((0, 1), dtype=np.float32)
            if rows.num_rows:
                by_attr, qids, vectors_of, low, high = shared.value
                rows = rows.sort_by("node")
                attr = rows.column("attr")[0].as_py()
                first = rows.column("node")[0].as_py()
                ids = np.asarray(rows.column("id"), dtype=np.int64)
                vectors = np.asarray(rows.column("v").combine_chunks().flatten(), dtype=np.float32).reshape(rows.num_rows, -1)
                ranges = Ranges(rows, attributes, low, high)
                order = ranges.values[attr]
                table = np.stack([np.asarray(own.column(c), dtype=np.int64) for c in ("src", "dst", "ll", "lu", "rl", "ru")], axis=1)
                table[:, :2] -= first
                if "gone" in rows.column_names:
                    ranges.there &= ~np.asarray(rows.column("gone").fill_null(False), dtype=bool)
                graph = Graph(ids, vectors.astype(np.float64), table.astype(np.int32))
                del table
                walk = walker(graph, rows)
                for q in by_attr.get(attr, ()):
                    left = 0 if whole else int(np.searchsorted(order, low[attr][q], side="left"))
                    right = rows.num_rows - 1 if whole else int(np.searchsorted(order, high[attr][q], side="right")) - 1
                    for w, (near, distances, hops) in enumerate(walk(vectors_of[q], left, right, ranges.admitted(q))):
                        work = np.zeros((2, len(near)), dtype=np.int64)
                        work[:, :1] = [[distances], [hops]]
                        for kept, x in zip(found, (np.full(len(near), w), np.full(len(near), qids[q]), np.array(near, dtype=np.int64), *work)):
                            kept.append(x)
            w, qid, place, distances, hops = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in found)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors[place].ravel()))
            columns = [w, qid, ids[place] if len(place) else place, v, distances, hops]
            return pa.table({n: c if n == "v" else pa.array(c).cast(t) for (n, t), c in zip(kinds.items(), columns)})

        own = edges.withColumnsRenamed({"attr": "edge_attr", "shard": "edge_shard"})
        found = nodes.groupBy("attr", "shard").cogroup(own.groupBy("edge_attr", "edge_shard")).applyInArrow(_two(kernel), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def with_fallback(walked: DataFrame, base: DataFrame, queries: DataFrame, k: int, attributes: list[str]) -> DataFrame:
    """``qid``, ``rank``, ``id``, ``dist``, ``fallback``: walked results, and an exact scan for the queries that no indexed attribute navigates."""
    lost = queries.where("nav_attr IS NULL")
    scanned = exact_topk(base, lost, k, attributes).select("qid", "rank", "id", "dist", F.lit(True).alias("fallback"))
    return walked.select("qid", "rank", "id", "dist", F.lit(False).alias("fallback")).unionByName(scanned)


def hybrid(walked: DataFrame, base: DataFrame, choices: DataFrame, queries: DataFrame, k: int, attributes: list[str]) -> DataFrame:
    """``qid``, ``choice``, ``rank``, ``id``, ``dist``: each query's rows by the strategy that ``choices`` (``qid``, ``choice``) names."""
    few = queries.join(choices.where("choice = 'prefilter'"), "qid", "left_semi")
    scanned = exact_topk(base, few, k, attributes).withColumn("choice", F.lit("prefilter"))
    others = walked.join(choices.where("choice = 'graph'").select("qid", "choice"), "qid")
    columns = ["qid", "choice", "rank", "id", "dist"]
    return scanned.select(*columns).unionByName(others.select(*columns))

"""Layered proximity graphs (HNSW) over shards of the rows: the baseline index.

Rows are dealt into shards of a bounded size by a hash of their ids. A task
builds the graph of one shard; links are a table ``shard``, ``level``, ``src``,
``dst`` that can be written and read. A search walks all shards in parallel and
merges their best rows; distances are summed in the order of the exact expression.
A node's top level comes from a hash of its id, so that a build can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from heapq import heappop, heappush, heapreplace, nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.operators.exact import Ranges, _bounds, query_blocks, ranked, typed, whole_numbers
from veldra.operators.knn import _exact
from veldra.session import ship_package

#: Rows of a shard; the number of shards follows from a count.
SHARD_ROWS = 20_000
M, EF_CONSTRUCTION = 16, 100
#: Tasks that shards are dealt to, as a multiple of the shards.
TASKS = 16

LINKS = "shard long, level int, src long, dst long"
RESULT = "qid long, id long, dist double"


class Layers:
    """One shard's graph: vectors by position and, for each level, the neighbours of its nodes."""

    def __init__(self, vectors: np.ndarray, m: int = M):
        self.vectors, self.m = vectors, m
        self.levels: list[dict[int, list[int]]] = []
        self.entry = -1

    def gaps(self, query: np.ndarray, nodes: list[int]) -> list[float]:
        apart = self.vectors.take(nodes, axis=0)
        apart -= query
        return np.einsum("ij,ij->i", apart, apart).tolist()

    def descend(self, query: np.ndarray, lowest: int) -> int:
        """The nearest node that greedy steps reach on the levels above ``lowest``."""
        at, (best,) = self.entry, self.gaps(query, [self.entry])
        for level in range(len(self.levels) - 1, lowest, -1):
            moved = True
            while moved and (near := self.levels[level].get(at)):
                gaps = self.gaps(query, near)
                k = int(np.argmin(gaps))
                moved = gaps[k] < best
                at, best = (near[k], gaps[k]) if moved else (at, best)
        return at

    def beam(self, query: np.ndarray, start: int, level: int, ef: int, admits: Callable[[int], bool] | None = None) -> list[tuple[float, int]]:
        """The ef nearest reached nodes that are admitted; others are passed through."""
        (first,) = self.gaps(query, [start])
        frontier, seen = [(first, start)], {start}
        found = [(-first, start)] if admits is None or admits(start) else []
        bound = first if found else math.inf
        while frontier:
            gap, node = heappop(frontier)
            if gap > bound and len(found) >= ef:
                break
            fresh = [x for x in self.levels[level].get(node, ()) if x not in seen]
            seen.update(fresh)
            for g, x in zip(self.gaps(query, fresh) if fresh else (), fresh):
                if len(found) < ef or g < bound:
                    heappush(frontier, (g, x))
                    if admits is None or admits(x):
                        heappush(found, (-g, x)) if len(found) < ef else heapreplace(found, (-g, x))
                        bound = -found[0][0]
        return sorted((-g, x) for g, x in found)

    def spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes by distance those that are nearer to the centre than to any taken before, ``most`` at most."""
        kept: list[int] = []
        for gap, x in near:
            if len(kept) == most:
                break
            if not kept or min(self.gaps(self.vectors[x], kept)) >= gap:
                kept.append(x)
        return kept

    def insert(self, node: int, top: int) -> None:
        query = self.vectors[node]
        at = self.descend(query, top) if self.entry >= 0 else -1
        for level in range(min(top, len(self.levels) - 1), -1, -1):
            near = self.beam(query, at, level, EF_CONSTRUCTION)
            links = self.levels[level]
            links[node] = self.spread(near, self.m)
            for x in links[node]:
                links[x].append(node)
                most = self.m * (2 if level == 0 else 1)
                if len(links[x]) > most:
                    links[x] = self.spread(sorted(zip(self.gaps(self.vectors[x], links[x]), links[x])), most)
            at = near[0][1]
        if top >= len(self.levels):
            for _ in range(len(self.levels), top + 1):
                self.levels.append({node: []})
            self.entry = node

    def within(self, query: np.ndarray, radius: float, least: int, most: int, admits: Callable[[int], bool] | None = None) -> list[int]:
        """Admitted nodes within a squared distance, ``most`` at most: the walk goes on beyond the radius until it has met ``least`` of any distance."""
        if self.entry < 0 or most < 1:
            return []
        at = self.descend(query, 0)
        (first,) = self.gaps(query, [at])
        frontier, seen = [(first, at)], {at}
        found = [(-first, at)] if admits is None or admits(at) else []
        while frontier:
            gap, node = heappop(frontier)
            if len(found) >= most and gap > -found[0][0] or gap > radius and len(found) >= least:
                break
            fresh = [x for x in self.levels[0].get(node, ()) if x not in seen]
            seen.update(fresh)
            for g, x in zip(self.gaps(query, fresh) if fresh else (), fresh):
                if len(found) < most or g < -found[0][0]:
                    heappush(frontier, (g, x))
                    if admits is None or admits(x):
                        heappush(found, (-g, x)) if len(found) < most else heapreplace(found, (-g, x))
        return [x for g, x in sorted((-g, x) for g, x in found) if g <= radius]

    def search(self, query: np.ndarray, k: int, ef: int, admits: Callable[[int], bool] | None = None) -> list[int]:
        if self.entry < 0:
            return []
        return [x for _, x in nsmallest(k, self.beam(query, self.descend(query, 0), 0, max(ef, k), admits))]


def sharded(base: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows with their ``shard``."""
    shards = max(1, -(-base.count() // shard_rows))
    return base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))


def apart(rows: DataFrame, shards: int) -> DataFrame:
    """Rows dealt by shard to so many tasks that few have two shards: one shard takes long, and by their bytes many would be put into one task."""
    return rows.repartition(max(1, min(4096, TASKS * shards)), "shard")


def shard_count(rows: DataFrame) -> int:
    """Shards, from their largest number."""
    return (rows.agg(F.max("shard")).first()[0] or 0) + 1


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table.column("id").combine_chunks(), dtype=np.int64)
    vectors = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
    return ids, vectors


def build(rows: DataFrame, m: int = M) -> DataFrame:
    """The links of rows ``shard``, ``id``, ``v``. A node without neighbours has a row whose ``dst`` is itself."""
    ship_package(rows.sparkSession)

    def shard_links(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, vectors = _arrays(table)
        graph = Layers(vectors, m)
        chance = (np.asarray(table.column("h").combine_chunks(), dtype=np.int64).astype(np.float64) % 2.0**53 + 1) / (2.0**53 + 1)
        for node, level in enumerate((-np.log(chance) / math.log(m)).astype(int).tolist()):
            graph.insert(node, level)
        out = [(level, src, dst) for level, own in enumerate(graph.levels) for src, near in own.items() for dst in near or [src]]
        levels, src, dst = (np.array(x, dtype=np.int64) for x in zip(*out))
        shard = table.column("shard")[0].as_py()
        return pa.table({"shard": pa.array(np.full(len(src), shard)), "level": pa.array(levels.astype(np.int32)), "src": pa.array(ids[src]), "dst": pa.array(ids[dst])})

    hashed = rows.select("shard", F.col("id").cast("long").alias("id"), "v", F.abs(F.xxhash64(F.lit("level"), "id").bitwiseAND(F.lit(2**62 - 1))).alias("h"))
    return apart(hashed, shard_count(rows)).groupBy("shard").applyInArrow(shard_links, LINKS)


def _walked(rows: DataFrame, links: DataFrame, queries: DataFrame, attributes: list[str] | None, pick: Callable[..., list[int]]) -> DataFrame:
    """``qid``, ``id``, ``dist`` of the nodes that ``pick(layers, query, admits)`` gives in every shard; blocks of queries are walked one after the other.

    Distances are measured where the shard's vectors are, in the order of the column expression, so that no vector is joined to a result.
    """
    spark = rows.sparkSession
    ship_package(spark)
    names, shards = attributes or [], shard_count(rows)
    left = apart(rows.select(F.col("shard").cast("long").alias("shard"), F.col("id").cast("long").alias("id"), "v", *typed(rows, names)), shards)
    links = apart(links, shards)
    out: DataFrame | None = None
    for block in query_blocks(queries.select("qid", "qv", *(["bounds"] if names else []))):
        low, high = _bounds(block, names, whole_numbers(rows, names))
        shared = spark.sparkContext.broadcast(([r.qid for r in block], np.array([r.qv for r in block], dtype=np.float64), low, high))
        found = left.groupBy("shard").cogroup(links.groupBy("shard")).applyInArrow(_shard_results(shared, names, pick), RESULT)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT) if out is None else out


def _shard_results(shared, names: list[str], pick: Callable[..., list[int]]):
    def results(table: pa.Table, own: pa.Table) -> pa.Table:
        qids, found, dists = [], [], [np.empty(0)]
        if table.num_rows and own.num_rows:
            table = table.sort_by("id")
            ids, vectors = _arrays(table)
            graph = Layers(vectors)
            level = np.asarray(own.column("level").combine_chunks())
            ends = [np.asarray(own.column(c).combine_chunks(), dtype=np.int64) for c in ("src", "dst")]
            there = np.isin(ends[0], ids) & np.isin(ends[1], ids)
            src, dst = (np.searchsorted(ids, e[there]) for e in ends)
            for lv, a, b in zip(level[there].tolist(), src.tolist(), dst.tolist()):
                while len(graph.levels) <= lv:
                    graph.levels.append({})
                near = graph.levels[lv].setdefault(a, [])
                if a != b:
                    near.append(b)
            graph.entry = min(graph.levels[-1]) if graph.levels else -1
            wanted, vectors_of, low, high = shared.value
            ranges = Ranges(table, names, low, high)
            for q, qid in enumerate(wanted):
                admits = None
                if names:
                    admits = ranges.admitted(q).tobytes().__getitem__
                near = pick(graph, vectors_of[q], admits)
                qids += [qid] * len(near)
                found += ids[near].tolist()
                dists.append(_exact(vectors[near], vectors_of[q]))
        return pa.table({"qid": pa.array(qids, pa.int64()), "id": pa.array(found, pa.int64()), "dist": pa.array(np.concatenate(dists), pa.float64())})

    return results


def search(rows: DataFrame, links: DataFrame, queries: DataFrame, k: int, ef: int, attributes: list[str] | None = None) -> DataFrame:
    """``qid``, ``rank``, ``id``, ``dist`` of stated queries ``qid``, ``qv`` and, with attributes, ``bounds``.

    With attributes the walk passes through rows outside the ranges but keeps
    only rows inside them; without, it is a plain nearest-row search whose
    results a caller may filter afterwards. Rows that must not be found are
    taken out of ``rows`` (``unmarked``); their links are then skipped. With
    ``k`` equal to ``ef`` all that a walk keeps is returned.
    """
    return ranked(_walked(rows, links, queries, attributes, lambda graph, query, admits: graph.search(query, k, ef, admits)), k).select("qid", "rank", "id", "dist")


def within(rows: DataFrame, links: DataFrame, queries: DataFrame, radius: float, least: int, most: int, attributes: list[str] | None = None) -> DataFrame:
    """``qid``, ``id``, ``dist`` of rows that walks find within a squared distance, the ``most`` nearest; a walk goes on until it has met ``least`` rows of any distance."""
    near = _walked(rows, links, queries, attributes, lambda graph, query, admits: graph.within(query, radius, least, most, admits))
    return ranked(near.where(F.col("dist") <= radius), most).select("qid", "id", "dist")


def unmarked(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows without those marked as deleted (``id``); a row comes back as soon as its mark is gone, as links stay."""
    return rows.join(deleted.select("id"), "id", "left_anti")


def updated(rows: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """Links after rows of ``changed`` (``shard``) were added, replaced or taken out: their shards are built anew, the others stay."""
    shards = changed.select("shard").distinct()
    return links.join(shards, "shard", "left_anti").select("shard", "level", "src", "dst").unionByName(build(rows.join(shards, "shard", "left_semi")))


def save(links: DataFrame, path: str, **settings: str) -> None:
    """The links by shard, and one row of their number and settings, written last."""
    links.repartition("shard").sortWithinPartitions("shard", "level", "src", "dst").write.mode("errorifexists").parquet(f"{path}/links")
    count = links.sparkSession.read.parquet(f"{path}/links").count()
    links.sparkSession.createDataFrame([(count, {k: str(v) for k, v in settings.items()})], "links long, settings map<string,string>").coalesce(1).write.parquet(f"{path}/meta")


def load(spark, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Stored links and settings; refused if links are missing."""
    meta, links = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/links")
    if links.count() != meta.links:
        raise ValueError("links of the index are missing")
    return links, dict(meta.settings)

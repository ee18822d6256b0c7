"""A stored index: range-aware graphs over clustered shards, which searches read without a shuffle.

Rows are dealt to the nearest of a bounded number of centroids, and the rows of
a centroid to shards of about ``shard_rows`` by a hash of the id. Of each shard
a small table holds its centroid, its radius (the distance of its farthest row)
and the least and largest value of every attribute; for each indexed attribute
one row holds its graph, packed: ids, vectors and attributes in the order of
the attribute, and edges by source with offsets and envelopes.

A search first walks the few shards nearest to each query, which gives the
distance of a k-th row so far. By the triangle inequality no row of a shard is
nearer than its centroid less its radius, so that shards beyond that distance,
or without a row in the ranges, are skipped, and skipping loses nothing that a
walk of all shards would find. Packed rows are scanned where they lie: folders
of centroids that no query asks for are not read, and no row or edge is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions.vectors import squared_l2
from veldra.operators.exact import Ranges, _bounds, query_blocks, ranked, typed, whole_numbers, with_queries
from veldra.operators.graph import build_sharded, sharded_nodes
from veldra.operators.search import PROBES, Graph
from veldra.session import Scratch, ship_package, stored

INDEX_VERSION = 1
#: Rows of a shard, about.
SHARD_ROWS = 20_000
#: Centroids at most, and rows of the sample that one is fitted on: they bound what the driver holds.
CELLS, SAMPLE_ROWS, LLOYD_ROUNDS = 1024, 64, 12
#: Shards that a query walks before others are judged by its k-th distance.
FIRST_SHARDS = 2
#: Pairs of a query and a shard that are sent to the tasks of one scan.
PAIRS = 1_000_000
#: Relative slack of bounds by floating point.
SLACK = 1e-6

GRAPH = "attr int, shard long, cell int, n long, ids binary, vectors binary, attributes binary, offsets binary, edges binary"


def fit_centroids(base: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centroids by Lloyd's rounds over a sample of at most ``sample_rows`` rows a centroid, those whose hashed ids come first."""
    sample = base.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(cells * sample_rows).toArrow()
    v = np.asarray(pa.concat_arrays(sample["v"].chunks).flatten(), dtype=np.float64).reshape(sample.num_rows, -1) if sample.num_rows else np.zeros((1, 1))
    centres = v[:: max(1, len(v) // cells)][:cells].copy()
    for _ in range(LLOYD_ROUNDS if len(centres) > 1 else 1):
        own = nearest_centroid(v, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest_centroid(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the first of equals, and the distance."""
    gaps = (v**2).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres**2).sum(axis=1)[None, :]
    own = gaps.argmin(axis=1)
    return own, np.sqrt(((v - centres[own]) ** 2).sum(axis=1))


def build(base: DataFrame, attributes: list[str], indexed: list[int], path: str, shard_rows: int = SHARD_ROWS, ef: int = 64, most: int = 16) -> None:
    """Writes the index of rows ``id``, ``v`` and attributes; ``meta`` is written last, so that a folder without it is no index.

    Rows whose vector is null can't be found and are left out; a null attribute
    lies in no range. Repeated rows are rows. An empty table gives an index
    that finds nothing.
    """
    spark = base.sparkSession
    ship_package(spark)
    rows = base.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"), *typed(base, attributes))
    n = rows.count()
    centres = fit_centroids(rows, max(1, min(CELLS, -(-n // shard_rows))))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            cell, far = nearest_centroid(v, centres) if batch.num_rows else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    with Scratch(spark) as work:
        dealt = work.store(rows.mapInArrow(deal, f"{kinds}, cell int, far double"), "index-rows")
        parts = {r.cell: -(-r.n // shard_rows) for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
        starts, total = [], 0
        for cell in range(len(centres)):
            starts.append(total)
            total += parts.get(cell, 0)
        by_cell = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell"))
        shard = (by_cell(starts) + F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), by_cell([parts.get(c, 0) for c in range(len(centres))])))).cast("long")
        placed = work.store(dealt.withColumn("shard", shard), "index-shards")
        ends = [f(a).alias(f"{name}_{a}") for a in attributes for f, name in ((F.min, "least"), (F.max, "most"))]
        shards = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), *ends)
        shards.coalesce(max(1, total // 100_000)).write.parquet(f"{path}/shards")
        nodes = work.store(sharded_nodes(placed, attributes, indexed, shard_rows, F.col("shard")), "index-nodes")
        edges = work.store(build_sharded(nodes, ef, most), "index-edges").withColumnsRenamed({"attr": "edge_attr", "shard": "edge_shard"})
        cell_of = np.array(starts)  # of an empty cell the next one has the same start

        def pack(own: pa.Table, links: pa.Table) -> pa.Table:
            if not own.num_rows:
                return pa.Table.from_pylist([], _packed_schema())
            return packed(own, links, attributes, int(np.searchsorted(cell_of, own["shard"][0].as_py(), side="right")) - 1)

        graphs = nodes.groupBy("attr", "shard").cogroup(edges.groupBy("edge_attr", "edge_shard")).applyInArrow(lambda o, e: pack(o, e), GRAPH)
        graphs.repartition("attr", "cell").write.option("parquet.block.size", 32 << 20).partitionBy("attr", "cell").parquet(f"{path}/graphs")
    kept = [[float(x) for x in c] for c in centres]
    spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
    whole = whole_numbers(base, attributes)
    spark.createDataFrame([(INDEX_VERSION, n, total, attributes, whole, indexed)], "version int, rows long, shards long, attributes array<string>, whole array<boolean>, indexed array<int>").coalesce(1).write.parquet(f"{path}/meta")


def _packed_schema() -> pa.Schema:
    return pa.schema([("attr", pa.int32()), ("shard", pa.int64()), ("cell", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("ids", "vectors", "attributes", "offsets", "edges")]])


def packed(own: pa.Table, links: pa.Table, attributes: list[str], cell: int) -> pa.Table:
    """One row with a shard's graph; ranks are 32-bit numbers within the shard."""
    own = own.sort_by("node")
    first = own["node"][0].as_py()
    vectors = np.asarray(pa.concat_arrays(own["v"].chunks).flatten(), dtype=np.float32)
    table = np.stack([np.asarray(links[c], dtype=np.int64) for c in ("src", "dst", "ll", "lu", "rl", "ru")], axis=1)
    table[:, :2] -= first
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    offsets = np.searchsorted(table[:, 0], np.arange(own.num_rows + 1)).astype(np.int32)
    values = pa.record_batch([pa.concat_arrays(own[a].chunks) for a in attributes], attributes)
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, values.schema) as stream:
            stream.write_batch(values)
        held = out.getvalue().to_pybytes()
    row = {"attr": own["attr"][0].as_py(), "shard": own["shard"][0].as_py(), "cell": cell, "n": own.num_rows, "ids": np.asarray(own["id"], dtype=np.int64).tobytes(), "vectors": vectors.tobytes(), "attributes": held, "offsets": offsets.tobytes(), "edges": table[:, 1:].astype(np.int32).tobytes()}
    return pa.Table.from_pylist([row], _packed_schema())


class Index:
    """A stored index, opened: nothing of it is held but its path and ``meta``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = spark.read.parquet(f"{path}/meta").first()
        if self.meta.version != INDEX_VERSION:
            raise ValueError(f"the index has form {self.meta.version}, not {INDEX_VERSION}")
        self.shards, self.cells = spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/cells")
        if self.shards.count() != self.meta.shards:
            raise ValueError("shards of the index are missing")

    def search(self, queries: DataFrame, k: int, ef: int, hard_prune: bool = False, first_shards: int = FIRST_SHARDS, prune: bool = True, probes: int = PROBES, pairs: int = PAIRS) -> DataFrame:
        """``qid``, ``rank``, ``id``, ``dist``, ``shards`` (walked for the query) of stated queries ``qid``, ``qv``, ``nav_attr``, ``bounds``.

        ``nav_attr`` is one of the indexed attributes; queries without it have
        no rows, see ``search.with_fallback``. With ``prune`` false every shard
        that has rows in the ranges is walked.
        """
        ship_package(self.spark)
        out: DataFrame | None = None
        wanted = queries.select(F.col("qid").cast("long").alias("qid"), "qv", F.col("nav_attr").cast("int").alias("nav_attr"), "bounds").where("nav_attr is not null")
        for block in query_blocks(wanted):
            found = self._block(block, queries, k, ef, hard_prune, first_shards, prune, probes, pairs)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], "qid long, rank int, id long, dist double, shards long") if out is None else out

    def _block(self, block: list, queries: DataFrame, k: int, ef: int, hard_prune: bool, first_shards: int, prune: bool, probes: int, pairs: int) -> DataFrame:
        near = self._shard_pairs(block, None, first_shards if prune else None, None)
        found = self._walked(block, near, k, ef, hard_prune, probes, pairs)
        measured = self._measured(found, queries)
        if prune:
            last = ranked(measured.where("id is not null"), k).groupBy("qid").agg(F.max("dist").alias("dist"), F.count("*").alias("n")).where(F.col("n") == k).collect()  # a row a query of the block
            reach = {r.qid: float(np.sqrt(r.dist)) for r in last}
            rest = self._shard_pairs(block, reach, None, near)
            near = near.unionByName(rest)
            measured = measured.unionByName(self._measured(self._walked(block, rest, k, ef, hard_prune, probes, pairs), queries))
        walked = near.groupBy("qid").agg(F.count("*").alias("shards"))
        return ranked(measured.select("qid", "id", "dist"), k).join(F.broadcast(walked), "qid").select("qid", "rank", "id", "dist", "shards")

    def _shard_pairs(self, block: list, reach: dict | None, most: int | None, done: DataFrame | None) -> DataFrame:
        """Stored ``qid``, ``attr``, ``shard``, ``cell`` of shards with rows in a query's ranges: the ``most`` nearest, or those within ``reach`` and not ``done``."""
        names, whole = list(self.meta.attributes), list(self.meta.whole)
        low, high = _bounds(block, names, whole)
        centres = np.array([r.centre for r in self.cells.orderBy("cell").collect()])  # at most CELLS rows
        qv, qids, navs = np.array([r.qv for r in block], dtype=np.float64), np.array([r.qid for r in block]), np.array([r.nav_attr for r in block])
        gaps = np.sqrt(np.maximum(0, ((qv[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))) if len(centres) * len(block) * centres.shape[1] < 1 << 24 else np.stack([np.sqrt(((centres - q) ** 2).sum(axis=1)) for q in qv])
        limit = np.array([(reach or {}).get(int(q), np.inf) for q in qids])
        shared = self.spark.sparkContext.broadcast((low, high, gaps, qids, navs, limit))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, gaps, qids, navs, limit = shared.value
            for batch in batches:
                inside = np.ones((len(qids), batch.num_rows), dtype=bool)
                for i, a in enumerate(names):
                    ends = [batch.column(f"{x}_{a}") for x in ("least", "most")]
                    there = np.asarray(ends[0].is_valid(), dtype=bool)
                    least, most_ = (np.asarray(e.fill_null(0), dtype=low[i].dtype) for e in ends)
                    inside &= there & ~(most_[None, :] < low[i][:, None]) & ~(least[None, :] > high[i][:, None]) & (low[i] <= high[i])[:, None]
                far = gaps[:, np.asarray(batch.column("cell"))]
                bound = far - np.asarray(batch.column("radius"))[None, :]
                inside &= bound <= (limit * (1 + SLACK) + SLACK * (1 + np.where(np.isfinite(limit), limit, 0)))[:, None]
                q, s = np.nonzero(inside)
                if most is not None and len(q):  # the nearest of this batch
                    order = np.lexsort((far[q, s], q))
                    order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < most]
                    q, s = q[order], s[order]
                chosen = batch.take(pa.array(s))
                yield pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(navs[q].astype(np.int32)), chosen.column("shard"), chosen.column("cell"), pa.array(far[q, s])], ["qid", "attr", "shard", "cell", "far"])

        met = self.shards.mapInArrow(kernel, "qid long, attr int, shard long, cell int, far double")
        if most is not None:
            met = ranked(met, most, "far", "shard")
        if done is not None:
            met = met.join(done.select("qid", "shard"), ["qid", "shard"], "left_anti")
        return stored(met.select("qid", "attr", "shard", "cell"), "index-pairs")

    def _walked(self, block: list, near: DataFrame, k: int, ef: int, hard_prune: bool, probes: int, pairs: int) -> DataFrame:
        """``qid``, ``id``, ``v`` that walks of the pairs' shards find; pairs are sent ``pairs`` at a time, whole queries."""
        place = {int(r.qid): i for i, r in enumerate(block)}
        counts = {r.qid: r.n for r in near.groupBy("qid").agg(F.count("*").alias("n")).collect()}
        slices, size = [[]], 0
        for qid, n in sorted(counts.items()):
            if slices[-1] and size + n > pairs:
                slices.append([])
                size = 0
            slices[-1].append(qid)
            size += n
        names, whole = list(self.meta.attributes), list(self.meta.whole)
        low, high = _bounds(block, names, whole)
        qv, qids = np.array([r.qv for r in block], dtype=np.float64), np.array([r.qid for r in block])
        out = self.spark.createDataFrame([], "qid long, id long, v array<float>")
        for own in slices:
            if not own:
                continue
            some = near if len(slices) == 1 else near.where(F.col("qid").isin(own))
            wanted: dict[tuple[int, int], list[int]] = {}
            cells: set[int] = set()
            for r in some.toLocalIterator():
                wanted.setdefault((r.attr, r.shard), []).append(place[r.qid])
                cells.add(r.cell)
            shared = self.spark.sparkContext.broadcast((wanted, qids, qv, low, high))

            def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                wanted, qids, qv, low, high = shared.value
                for batch in batches:
                    for i, key in enumerate(zip(batch.column("attr").to_pylist(), batch.column("shard").to_pylist())):
                        if key in wanted:
                            yield walk_packed(batch.slice(i, 1), wanted[key], names, qids, qv, low, high, k, ef, hard_prune, probes)

            attrs = sorted({a for a, _ in wanted})
            rows = self.spark.read.parquet(f"{self.path}/graphs").where(F.col("attr").isin(attrs) & F.col("cell").isin(sorted(cells)))
            out = out.unionByName(rows.select("attr", "shard", "n", "ids", "vectors", "attributes", "offsets", "edges").mapInArrow(kernel, "qid long, id long, v array<float>"))
        return stored(out, "index-found")

    @staticmethod
    def _measured(found: DataFrame, queries: DataFrame) -> DataFrame:
        return with_queries(found, queries.select("qid", "qv")).select("qid", "id", squared_l2(F.col("v"), F.col("qv")).alias("dist"))


def walk_packed(row: pa.RecordBatch, own: list[int], names: list[str], qids: np.ndarray, qv: np.ndarray, low: list, high: list, k: int, ef: int, hard_prune: bool, probes: int) -> pa.RecordBatch:
    """What the queries ``own`` (places among all) find in one packed shard."""
    attr, n = row.column("attr")[0].as_py(), row.column("n")[0].as_py()
    array = lambda c, t: np.frombuffer(row.column(c)[0].as_buffer(), dtype=t)
    ids, vectors = array("ids", np.int64), array("vectors", np.float32).reshape(n, -1)
    values = pa.ipc.open_stream(row.column("attributes")[0].as_buffer()).read_all()
    ranges = Ranges(values.combine_chunks().to_batches()[0], names, low, high)
    graph = Graph.stored(ids, vectors.astype(np.float64), array("offsets", np.int32), array("edges", np.int32).reshape(-1, 5))
    order, found = ranges.values[attr], []
    for q in own:
        left, right = int(np.searchsorted(order, low[attr][q], side="left")), int(np.searchsorted(order, high[attr][q], side="right")) - 1
        near, _, _ = graph.walk(qv[q], left, right, ranges.admitted(q), k, ef, hard_prune, probes)
        found += [(q, r) for r in near]
    q, r = (np.array(x, dtype=np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors[r].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(ids[r]), lists], ["qid", "id", "v"])

"""Graphs of shards: nodes compressed side by side, in parts of a shard, and several walks in one pass."""

import numpy as np
import pytest

from veldra.operators import graph, knn, search
from veldra.plans import catalogue, fixtures


@pytest.mark.parametrize("kind, count, most, alpha", [("normal", 64, 16, 1.0), ("whole", 32, 5, 1.0), ("copies", 64, 16, 1.0), ("normal", 80, 16, 1.0), ("normal", 20, 1, 1.3)])
def test_nodes_side_by_side_have_the_edges_of_each_alone(kind, count, most, alpha, monkeypatch):
    monkeypatch.setattr(graph, "SIDE_BY_SIDE", 50)
    chance = np.random.default_rng(5)
    v = {"normal": chance.normal(size=(120, 4)), "whole": chance.integers(0, 3, (120, 5)).astype(float), "copies": np.repeat(chance.normal(size=(6, 4)), 20, axis=0)}[kind]
    ids = np.arange(len(v))
    src, dst, dist = knn._near(ids, v, ids, v, count)
    centers, starts = np.unique(src, return_index=True)
    starts = np.append(starts, len(src))
    of, edges = graph.compress_nodes(centers, starts, dst, dist, v, dst, np.full(len(centers), len(v)), most, alpha)
    want = []
    for i, c in enumerate(centers):
        own = slice(starts[i], starts[i + 1])
        want += [(i, *e) for e in graph.compress_node(int(c), dst[own], dist[own], v[dst[own]], len(v), most, alpha)]
    assert [(int(i), *map(int, e)) for i, e in zip(of, edges)] == want and want


def test_parts_of_a_shard_give_one_graph_and_send_no_candidates(spark, sf_dir, monkeypatch):
    nodes = graph.sharded_nodes(fixtures.base(spark, sf_dir), fixtures.ATTRIBUTES, [0, 1], 300)
    once = sorted(map(tuple, graph.build_sharded(nodes, ef=20).collect()))
    monkeypatch.setattr(graph, "PART_ROWS", 40)
    made = graph.build_sharded(nodes, ef=20)
    assert sorted(map(tuple, made.collect())) == once and once
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_walks_of_one_pass_are_those_of_each(spark, sf_dir):
    nodes, edges = catalogue.sharded_graphs(spark, sf_dir, [0, 1])
    wanted = catalogue.routed(spark, sf_dir, [0, 1])
    settings = [(16, False), (48, True)]
    found = search.walk_each(nodes, edges, wanted, fixtures.ATTRIBUTES, 10, settings, scan_ef=0).collect()
    for i, (ef, hard) in enumerate(settings):
        alone = search.walk_shards(nodes, edges, wanted, fixtures.ATTRIBUTES, 10, ef, hard, scan_ef=0).select("qid", "rank", "id", "dist").collect()
        assert sorted((r.qid, r["rank"], r.id, r.dist) for r in found if r.walk == i) == sorted(map(tuple, alone)) and alone

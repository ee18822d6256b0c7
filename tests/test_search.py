"""Graph walks and other routes against the exact search: whole-number ranges, nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.operators import exact, graph, hnsw, search, strategies

NAMES = ["a0", "a1"]
BOUNDS = "array<struct<low:{0},high:{0}>>"


def rows_of(spark, n, whole, nulls=False, seed=3):
    chance = np.random.default_rng(seed)
    kind = "long" if whole else "float"
    big = 1_500_000_000 if whole else 0
    data = [(i, [float(x) for x in chance.normal(size=4)], None if nulls and i % 3 == 1 else big + i, None if nulls and i % 5 == 2 else big + i * 7 % n) for i in range(n)]
    return spark.createDataFrame([(i, v, a if a is None or whole else float(a), b if b is None or whole else float(b)) for i, v, a, b in data], f"id long, v array<float>, a0 {kind}, a1 {kind}").repartition(3), big


def queries_of(spark, ranges, kind, nav=0):
    chance = np.random.default_rng(9)
    rows = [(q, [float(x) for x in chance.normal(size=4)], nav, list(r)) for q, r in enumerate(ranges)]
    return spark.createDataFrame(rows, f"qid long, qv array<float>, nav_attr int, bounds {BOUNDS.format(kind)}")


def ids(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.qid, set()).add(r.id)
    return out


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("nulls", [True, False])
def test_every_route_gives_the_exact_rows(spark, whole, nulls):
    rows, big = rows_of(spark, 400, whole, nulls)
    kind = "long" if whole else "float"
    make = int if whole else float
    ranges = [[(make(big), make(big + 10)), (make(big), make(big + 399))], [(make(big + 100), make(big + 200)), (make(big + 50), make(big + 250))], [(make(big + 399), make(big + 5000)), (make(big - 5), make(big + 399))], [(make(big + 7), make(big + 3)), (make(big), make(big + 399))]]
    wanted = queries_of(spark, ranges, kind)
    want = ids(exact.exact_topk(rows, wanted, 50, NAMES))
    legal = ids(strategies.range_filter(rows, wanted, NAMES))
    assert {q: len(x) for q, x in legal.items()} == {q: len(x) for q, x in ids(exact.exact_topk(rows, wanted, 400, NAMES)).items()}
    assert ids(strategies.legal_rows(rows, wanted, NAMES)) == legal
    nodes = graph.sharded_nodes(rows, NAMES, [0, 1], 150)
    edges = graph.build_sharded(nodes, ef=32)
    for nav in (0, 1):
        own = wanted.withColumn("nav_attr", F.lit(nav))
        for how in ({}, {"whole": True}):
            found = ids(search.walk_shards(nodes, edges, own, NAMES, 50, 400, **how))
            assert all(found.get(q, set()) <= legal.get(q, set()) for q in legal)
            assert found == want
    shards = hnsw.sharded(rows, 150)
    assert ids(hnsw.search(shards, hnsw.build(shards), wanted, 50, 400, NAMES)) == want


def clustered(spark, n, dim=8, seed=4):
    chance = np.random.default_rng(seed)
    centres = chance.normal(scale=10, size=(10, dim))
    v = centres[chance.integers(0, 10, n)] + chance.normal(size=(n, dim))
    rows = [(i, [float(x) for x in v[i]], None if i % 17 == 3 else i * 7 % n, float(chance.integers(0, 50))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<float>, a0 long, a1 float").repartition(3), v


def test_a_stored_index_skips_shards_and_loses_nothing(spark, tmp_path):
    from veldra.operators import index

    rows, v = clustered(spark, 1500)
    index.build(rows, NAMES, [0, 1], str(tmp_path / "i"), shard_rows=100, ef=32)
    opened = index.Index(spark, str(tmp_path / "i"))
    asked = [(q, [float(x) for x in v[q * 30] + 0.1], q % 2, [(0.0, 1500.0), (5.0 + q % 3, 40.0)]) for q in range(40)]
    wanted = spark.createDataFrame(asked, f"qid long, qv array<float>, nav_attr int, bounds {BOUNDS.format('double')}")
    want = ids(exact.exact_topk(rows, wanted, 10, NAMES))
    found = opened.search(wanted, 10, 64).collect()
    every = opened.search(wanted, 10, 64, prune=False).collect()
    key = lambda r: (r.qid, r.rank, r.id, r.dist)
    assert sorted(map(key, found)) == sorted(map(key, every))
    assert sorted(map(key, opened.search(wanted, 10, 64, pairs=7).collect())) == sorted(map(key, every))
    share = sum({r.qid: r.shards for r in found}.values()) / (40 * opened.meta.shards)
    assert share < 0.4 and {r.shards for r in every} == {opened.meta.shards}
    assert sum(r.id in want[r.qid] for r in found) >= 0.95 * sum(map(len, want.values()))
    plan = spark.read.parquet(f"{tmp_path}/i/graphs").where(F.col("cell").isin([0]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_an_index_of_no_rows_and_of_missing_shards(spark, tmp_path):
    import shutil

    from veldra.operators import index

    rows, _ = clustered(spark, 60)
    index.build(rows.where("false"), NAMES, [0], str(tmp_path / "e"), shard_rows=10)
    wanted = spark.createDataFrame([(0, [0.0] * 8, 0, [(0.0, 9.0), (0.0, 90.0)])], f"qid long, qv array<float>, nav_attr int, bounds {BOUNDS.format('double')}")
    assert index.Index(spark, str(tmp_path / "e")).search(wanted, 5, 16).count() == 0
    index.build(rows, NAMES, [0], str(tmp_path / "f"), shard_rows=1000)
    assert index.Index(spark, str(tmp_path / "f")).search(wanted.where("false"), 5, 16).count() == 0
    shutil.rmtree(tmp_path / "f" / "shards")
    rows.limit(0).selectExpr("0L as shard", "0 as cell").write.parquet(str(tmp_path / "f" / "shards"))
    with pytest.raises(ValueError, match="missing"):
        index.Index(spark, str(tmp_path / "f"))


def test_recall_where_every_attribute_has_a_range(spark, sf_dir):
    from veldra.plans import catalogue

    rows = {(r.profile, r.method, r.ef): r.recall for r in catalogue.walk_recall(spark, sf_dir).collect()}
    profiles = {p for p, _, _ in rows}
    assert len(rows) == 2 * len(catalogue.REPORTED_EF) * len(profiles)
    assert all(rows[p, "bridge", 128] >= 0.9 for p in profiles)
    assert sum(rows[p, "hard_prune", 16] for p in profiles) <= sum(rows[p, "bridge", 128] for p in profiles)


def test_few_admitted_rows_are_measured_all():
    chance = np.random.default_rng(8)
    v = chance.normal(size=(500, 6))
    lone = search.Graph(np.arange(500), v, np.empty((0, 6), dtype=np.int64))  # without an edge a walk finds its starts only
    admitted = chance.random(500) < 0.2
    inside = np.flatnonzero(admitted[100:401]) + 100
    want = inside[np.argsort(((v[inside] - v[7]) ** 2).sum(axis=1))[:10]].tolist()
    assert lone.walk(v[7], 100, 400, admitted, 10, 16, probes=64)[0] == want
    assert lone.walk(v[7], 100, 400, admitted, 10, 16, probes=64, scan_ef=0)[0] != want


def test_stop_conditions_find_documents_and_rows_in_ranges(spark, sf_dir):
    from veldra.plans import catalogue, fixtures

    rows, wanted = fixtures.base(spark, sf_dir), fixtures.range_profiles(spark, sf_dir)
    legal = [(r.qid, r.id, r.dist) for r in strategies.legal_rows(rows, wanted, fixtures.ATTRIBUTES).collect()]
    docs, near = {}, {}
    for q, i, d in legal:
        docs.setdefault(q, {}).setdefault(i // 5, []).append(d)
        near.setdefault(q, []).append((d, i))
    want = {q: sorted((min(ds), doc) for doc, ds in own.items())[: catalogue.K] for q, own in docs.items()}
    got = {(r.qid, r.doc): r.best_dist for r in catalogue.graph_top_documents(spark, sf_dir).collect()}
    assert all(d == pytest.approx(min(docs[q][doc])) for (q, doc), d in got.items())
    assert sum((q, doc) in got for q, own in want.items() for _, doc in own) >= 0.9 * sum(map(len, want.values()))
    want = {(q, i) for q, own in near.items() for d, i in sorted(own)[:50] if d <= 1.5}
    got = {(r.qid, r.id) for r in catalogue.graph_within_radius(spark, sf_dir).collect()}
    assert got <= {(q, i) for q, i, d in legal if d <= 1.5} and len(got & want) >= 0.9 * len(want)


def test_conditions_count_as_stated():
    held = search.Documents(np.array([0, 0, 1, 2, 2, 3]), 2)
    for rank, d in ((3, 5.0), (0, 4.0), (1, 6.0), (2, 3.0)):
        assert held.considers(d) or rank == 1
        held.add(rank, d)
    assert held.found() == [2, 0] and held.stops(4.5) and not held.stops(3.5)  # document 2 went, and the farther row of 0 with it
    ball = search.Radius(4.0, 3, 2)
    for rank, d in enumerate((9.0, 3.0, 1.0, 2.0)):
        assert ball.stops(9.5) == (rank >= 3)
        ball.add(rank, d)
    assert ball.found() == [2, 3] and ball.stops(2.5) and not ball.stops(1.5)

"""Neighbours of all rows: exact pairs of blocks and the descent."""

import numpy as np
import pytest

from veldra.operators import knn


def table_of(spark, v):
    return spark.createDataFrame([(i * 3, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<float>").repartition(3)


def brute(v, count):
    out = {}
    for i, row in enumerate(v):
        gaps = np.cumsum((v - row) ** 2, axis=1)[:, -1]
        order = [j for j in np.lexsort((np.arange(len(v)), gaps)) if j != i][:count]
        out[i * 3] = [(3 * int(j), float(gaps[j])) for j in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.src, r.pos)):
        out.setdefault(r.src, []).append((r.dst, r.dist))
    return out


@pytest.mark.parametrize("block_rows", [1000, 70])
def test_blocks_give_the_exact_rows(spark, block_rows):
    chance = np.random.default_rng(1)
    v = chance.integers(0, 4, (230, 3)).astype(np.float32).astype(float)  # many ties and equal rows
    assert found(knn.exact_neighbours(table_of(spark, v), 6, block_rows)) == brute(v, 6)


def test_few_rows(spark):
    v = np.array([[0.0], [2.0]])
    for make in (knn.exact_neighbours, knn.descent_neighbours):
        assert found(make(table_of(spark, v), 5)) == {0: [(3, 4.0)], 3: [(0, 4.0)]}
        assert found(make(table_of(spark, v[:1]), 5)) == {}


@pytest.mark.parametrize("shape", ["clustered", "uniform", "equal"])
def test_descent_finds_most_neighbours(spark, shape):
    chance = np.random.default_rng(2)
    centres = chance.normal(scale=8, size=(12, 8))
    v = {"clustered": centres[chance.integers(0, 12, 2500)] + chance.normal(size=(2500, 8)), "uniform": chance.random((2500, 8)), "equal": np.repeat(chance.random((5, 8)), 300, axis=0)}[shape].astype(np.float32).astype(float)
    want, changes = brute(v, 10), []
    got = found(knn.descent_neighbours(table_of(spark, v), 10, work_report=changes))
    assert len(got) == len(v) and all(len(x) == 10 for x in got.values())
    assert sum(d <= want[i][-1][1] for i, x in got.items() for _, d in x) >= 0.9 * 10 * len(v)
    assert all(d == pytest.approx(float(((v[i // 3] - v[j // 3]) ** 2).sum())) for i, x in list(got.items())[:50] for j, d in x)
    assert changes == sorted(changes, reverse=True)


def test_a_frame_that_comes_from_a_join(spark):
    from pyspark.sql import functions as F

    v = np.random.default_rng(3).integers(0, 4, (60, 3)).astype(np.float32).astype(float)
    rows = table_of(spark, v)
    joined = rows.select(F.col("id").alias("old"), "v").join(rows.select(F.col("id").alias("old")), "old").select(F.col("old").alias("id"), "v")
    assert found(knn.exact_neighbours(joined, 5, 25)) == brute(v, 5)


def test_blocks_stay_few_as_rows_grow():
    assert [knn.block_count(n) for n in (0, 1, 4096, 4097, 50_000, 102_564, 615_384)] == [1, 1, 1, 2, 12, 12, 12]
    assert knn.block_count(10_000_000) == 153 and knn.block_count(230, 70) == 4


def test_pieces_of_the_right_rows_lose_nothing(monkeypatch):
    chance = np.random.default_rng(4)
    for v in (chance.normal(size=(300, 16)), np.repeat(chance.normal(size=(15, 4)), 20, axis=0), chance.normal(size=(200, 3)) * 1e20, np.zeros((90, 2))):
        ids = 3 * np.arange(len(v))
        monkeypatch.setattr(knn, "RIGHT_ROWS", 37)
        src, dst, dist = knn._near(ids, v, ids, v, 7)
        got = {}
        for s, d, x in zip(src.tolist(), dst.tolist(), dist.tolist()):
            got.setdefault(s, []).append((d, x))
        assert got == brute(v, 7)


def test_edges_are_found_once(spark, sf_dir):
    from veldra.plans import catalogue

    plan = catalogue.graph_integrity(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Relation" in plan

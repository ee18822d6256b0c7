"""The graph over a whole table, whose candidates stay in the tasks that find them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.operators import graph, knn


def test_pieces_give_the_nearest_of_all():
    chance = np.random.default_rng(6)
    v = chance.normal(size=(700, 5)).round(1)
    v[100:140] = v[0]  # ties go by id
    ids = chance.permutation(700)
    left = chance.choice(700, 90, replace=False)
    for count in (3, 50, 699, 900):
        want = knn._near(ids[left], v[left], ids, v, count)
        key = np.lexsort((want[1], want[2], want[0]))
        for step in (40, 256, 700):
            pieces = ((ids[at : at + step], v[at : at + step]) for at in range(0, 700, step))
            got = knn.near_by_pieces(ids[left], pieces, v[left], count)
            assert all((g == w[key]).all() for g, w in zip(got, want))


@pytest.mark.parametrize("kept", ["id >= 0", "id <> 77"])
def test_candidates_of_a_static_graph_are_not_shuffled(spark, monkeypatch, kept):
    chance = np.random.default_rng(7)
    made = [(i, [float(x) for x in v], i * 7 % 400) for i, v in enumerate(chance.normal(size=(400, 6)))]
    rows = spark.createDataFrame(made, "id long, v array<float>, a long").where(kept)
    order = rows.select("id", F.lit(0).alias("attr"), F.col("a").cast("long").alias("rnk")) if kept == "id >= 0" else rows.select("id", F.lit(0).alias("attr"), (F.col("a") - (F.col("a") > 77 * 7 % 400).cast("int")).cast("long").alias("rnk"))
    monkeypatch.setattr(graph, "TABLE_NODES", 90)  # several tasks, and pieces of the file
    monkeypatch.setattr(graph, "RIGHT_ROWS", 70)
    monkeypatch.setattr(graph, "TABLE_ROWS", 1)
    n = rows.count()
    for ef, most in ((100, 8), (20, 16)):
        static = graph.build_static(rows, order, 0, most, ef)
        assert "CoGroup" not in static._jdf.queryExecution().optimizedPlan().toString()
        want = graph.build(rows, order, 0, n, ef, most)
        got = sorted(map(tuple, static.collect()))
        assert got == sorted(map(tuple, want.collect())) and len(got) > 400

"""How tables are dealt into shards, and what a search hands on."""

import numpy as np
from pyspark.sql import functions as F

from veldra.functions.vectors import squared_l2
from veldra.operators import hnsw
from veldra.plans import catalogue


def test_a_query_meets_no_more_shards_of_a_larger_table():
    for least in (200, 500):
        assert catalogue.shard_rows(least, least) == catalogue.shard_rows(36 * least, least) == least  # small tables as before
        shards = [-(-n // catalogue.shard_rows(n, least)) for n in (51_282, 102_564, 307_692, 615_384)]
        assert max(shards) <= catalogue.SHARDS
    assert catalogue.shard_rows(10**9, 500) == catalogue.SHARD_ROWS


def test_layered_results_are_measured_in_their_shards(spark):
    chance = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in v], float(i % 5)) for i, v in enumerate(chance.normal(size=(300, 6)))], "id long, v array<float>, a float")
    wanted = rows.where("id < 20").select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.array(F.struct(F.lit(1.0).cast("float").alias("low"), F.lit(3.0).cast("float").alias("high"))).alias("bounds"))
    dealt = hnsw.sharded(rows, 100)
    found = hnsw.search(dealt, hnsw.build(dealt), wanted, 7, 60, ["a"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # vectors are not joined to results
    exact = rows.where("a between 1 and 3").crossJoin(wanted).select("qid", "id", squared_l2(F.col("v"), F.col("qv")).alias("dist"))
    dists = {(r.qid, r.id): r.dist for r in exact.collect()}
    got = found.collect()
    assert len(got) == 140 and all(dists[r.qid, r.id] == r.dist for r in got)


def test_many_graphs_are_sent_to_tasks_once(spark, monkeypatch):
    from veldra.operators import graph

    sizes = spark.createDataFrame([(400,), (20_000,)], "n long")
    parts = lambda graphs: [r[0] for r in sizes.select(graph.shard_parts(graphs)).collect()]
    assert parts(3) == [1, 5] and parts(40) == [1, 2] and parts(64) == parts(400) == [1, 1]
    chance = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in v], float(i % 7)) for i, v in enumerate(chance.normal(size=(400, 4)))], "id long, v array<float>, a float")
    monkeypatch.setattr(graph, "PART_ROWS", 20)
    nodes = graph.sharded_nodes(rows, ["a"], [0], 200)
    made = []
    for whole in (1, 64):  # each of the graphs in one task, or in parts
        monkeypatch.setattr(graph, "WHOLE_GRAPHS", whole)
        made.append(sorted(map(tuple, graph.shard_edges(nodes, 10, 4).collect())))
    assert made[0] == made[1] and made[0]

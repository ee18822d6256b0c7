"""Pairs measured in arrays, counts by range, and audits of proposed pairs alone."""

import pytest
from pyspark.sql import functions as F

from veldra.functions import vectors
from veldra.operators import evaluate, exact, strategies
from veldra.plans import catalogue, fixtures


@pytest.mark.parametrize("measure", ["l2", "ip", "integer_l2"])
def test_array_pairs_equal_the_expressions(spark, measure, monkeypatch):
    for name, few in (("PAIR_ROWS", 7), ("PAIR_BLOCK", 30), ("PAIR_BATCH", 11), ("PAIR_QUERIES", 4)):
        monkeypatch.setattr(exact, name, few)
    rows = spark.createDataFrame([(i, None if i == 5 else [float((i * 37 + d * 11) % 19 - 9) / 7 for d in range(6)]) for i in range(40)], "id long, v array<float>").repartition(3)
    wanted = rows.where("id % 4 = 0 or id = 5").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    scaled = lambda v: F.transform(v, lambda x: F.floor(x.cast("double") * 100))
    value = {"l2": vectors.squared_l2(F.col("v"), F.col("qv")), "ip": vectors.inner_product_distance(F.col("v"), F.col("qv")), "integer_l2": vectors.integer_squared_l2(scaled("v"), scaled("qv"))}[measure]
    want = rows.crossJoin(wanted).select("qid", "id", value.alias("x"))
    order = lambda frame: sorted(map(tuple, frame.collect()), key=lambda r: r[:2])
    assert order(exact.measured_pairs(rows, wanted, measure, "x")) == order(want)  # to the last bit
    assert exact.measured_pairs(rows, wanted.where("false"), measure).count() == exact.measured_pairs(rows.where("false"), wanted, measure).count() == 0


def test_pairs_run_without_a_cross_join(spark, sf_dir):
    plan = catalogue.integer_l2_pairs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastNestedLoopJoin" not in plan


def test_proposed_pairs_are_judged_as_among_all_legal_rows(spark, sf_dir):
    rows, wanted = fixtures.base(spark, sf_dir), fixtures.queries(spark, sf_dir)
    legal = strategies.legal_rows(rows, wanted, fixtures.ATTRIBUTES)
    proposed = wanted.select("qid").crossJoin(rows.where("id % 9 = 0").select("id")).unionByName(wanted.select("qid", (F.col("qid") + 10**9).alias("id")))
    got = sorted(map(tuple, strategies.legal_among(proposed.unionByName(proposed), rows, wanted, fixtures.ATTRIBUTES).collect()))
    assert got == sorted(map(tuple, legal.where("id % 9 = 0").collect())) and got
    counts = {r.qid: r.n for r in exact.range_counts(rows, wanted, fixtures.ATTRIBUTES).collect()}
    assert counts == {r.qid: r.n for r in wanted.select("qid").join(legal.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").na.fill(0).collect()}
    results = spark.createDataFrame([(0, 9, 1.0)], "qid long, id long, dist double")
    some, every = strategies.legal_among(results, rows, wanted, fixtures.ATTRIBUTES), evaluate.audit(results, rows, legal, wanted, 10).first()
    assert evaluate.audit(results, rows, some, wanted, 10, exact.range_counts(rows, wanted, fixtures.ATTRIBUTES)).first() == every


@pytest.mark.parametrize("name", ["result_audit", "result_audit_faults", "dynamic_audit_faults", "dynamic_audit", "boundary_tie_recall"])
def test_audits_make_no_pairs_of_all_rows(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(strategies, "legal_rows", None)
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_queries_step_by_step_find_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float((i * 37 + d * 11) % 19 - 9) / 7 for d in range(3)], float(i % 6)) for i in range(700)], "id long, v array<float>, a float").repartition(2)
    bounds = F.array(F.struct(F.lit(1.0).alias("low"), F.lit(4.0).alias("high")))
    wanted = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"), bounds.alias("bounds"))
    monkeypatch.setattr(exact, "QUERY_STEP", 3)  # the array of distances has at most so many queries
    monkeypatch.setattr(exact, "ROW_BLOCK", 90)
    near = rows.crossJoin(wanted).where("a between 1 and 4").withColumn("dist", vectors.squared_l2(F.col("v"), F.col("qv")))
    want = exact.ranked(near, 4).select("qid", "rank", "id", "dist")
    assert sorted(map(tuple, exact.exact_topk(rows, wanted, 4, ["a"]).collect())) == sorted(map(tuple, want.collect()))

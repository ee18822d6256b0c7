"""Rank ranges by merge and edges by cells, against brute force."""

import random

import pytest

from veldra.operators import graph, ranks


def test_rank_ranges_equal_counts(spark):
    chance = random.Random(3)
    values = [(a, i, None if chance.random() < 0.1 else float(chance.randint(-5, 5))) for a in range(2) for i in range(200)]
    bounds = [[tuple(sorted((float(chance.randint(-7, 7)), float(chance.randint(-7, 7))))) for _ in range(2)] for _ in range(30)] + [[(3.0, -3.0), (-5.0, -5.0)], [(None, 0.0), (0.0, None)]]
    frame = spark.createDataFrame(values, "attr int, id long, value float").repartition(3)
    filters = spark.createDataFrame(list(enumerate(bounds)), "qid long, bounds array<struct<low:float,high:float>>")
    rows = ranks.rank_ranges(frame, filters)
    got = {(r.qid, r.attr): (r.lo, r.hi, r.span) for r in rows.collect()}
    want = {}
    for q, own in enumerate(bounds):
        for a, (low, high) in enumerate(own):
            held = [v for attr, _, v in values if attr == a and v is not None]
            lo = sum(low is not None and v < low for v in held)
            hi = sum(high is not None and v <= high for v in held) - 1
            want[q, a] = (1, 0, 0) if lo > hi else (lo, hi, hi - lo + 1)
    assert got == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join" in line and "attr" in line and "__part" not in line]
    assert ranks.rank_ranges(frame.where("false"), filters).where("span > 0").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_eligible_edges_equal_brute_force(spark, share):
    chance, n = random.Random(7), 60
    edges = []
    for _ in range(300):
        s, d = chance.randrange(n), chance.randrange(n)
        ends = sorted(chance.randrange(n) for _ in range(4))
        edges.append((s, d, ends[0], ends[1], ends[2], ends[3]) if chance.random() < 0.5 else (s, d, 0, min(s, d), max(s, d), n - 1))
    asked = [(q, *sorted((chance.randrange(n), chance.randrange(n)))) for q in range(80)] + [(80, 1, 0), (81, 0, n - 1)]
    got = sorted(map(tuple, graph.eligible(spark.createDataFrame(edges, graph.EDGE), spark.createDataFrame(asked, "qid long, lo long, hi long"), n, share).collect()))
    want = sorted((q, s, d) for q, lo, hi in asked for s, d, ll, lu, rl, ru in edges if lo <= min(s, d) and max(s, d) <= hi and (hi - lo + 1 < share * n or ll <= lo <= lu and rl <= hi <= ru))
    assert got == want and want

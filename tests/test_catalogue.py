"""Every registered query against its SQL, and recall of those that SQL can't express."""

import pytest
from rows import same_rows

from veldra.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name], sf_dir)


@pytest.mark.parametrize("name", ["graph_search_bridge", "graph_search_hard_prune", "insearch_filter", "hnsw_insearch", "graph_search_partial", "hybrid_topk"])
def test_walk_recall(spark, sf_dir, name):
    found = {(r.qid, r.id) for r in catalogue.QUERIES[name](spark, sf_dir).collect()}
    want = {(r.qid, r.id) for r in catalogue.exact_topk(spark, sf_dir).collect()}
    assert len(found & want) >= 0.9 * len(want)


def test_layered_recall(spark, sf_dir):
    from veldra.operators import evaluate, exact
    from veldra.plans.fixtures import base, queries

    wanted = queries(spark, sf_dir)
    truth = exact.exact_topk(base(spark, sf_dir), wanted, 10)
    got = [r.recall for r in evaluate.recall(catalogue.hnsw_topk(spark, sf_dir), truth, wanted, 10).collect()]
    assert sum(got) >= 0.9 * len(got)


def test_static_buckets_stay_in_their_ranges(spark, sf_dir):
    rows = catalogue.static_range_buckets(spark, sf_dir).collect()
    assert rows and all(r.l <= r.id <= r.r for r in rows)


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def recall_of(rows, truth):
    want = {(r.qid, r.id) for r in truth}
    return len({(r.qid, r.id) for r in rows} & want) / len(want)


def test_walks_of_mutated_rows(spark, sf_dir):
    truth = catalogue.dynamic_topk(spark, sf_dir).collect()
    assert recall_of(catalogue.dynamic_graph_topk(spark, sf_dir).collect(), truth) >= 0.9
    assert recall_of(catalogue.rebuilt_topk(spark, sf_dir).collect(), truth) >= 0.9


def test_queries_without_an_indexed_attribute_are_scanned(spark, sf_dir):
    wanted = {r.qid: r.active[0] for r in catalogue.queries(spark, sf_dir).collect()}
    rows = catalogue.graph_search_partial(spark, sf_dir).collect()
    truth = catalogue.exact_topk(spark, sf_dir).collect()
    assert {r.qid for r in rows} == {r.qid for r in truth} and all(r.fallback != wanted[r.qid] for r in rows)
    scanned = {(r.qid, r["rank"], r.id) for r in rows if r.fallback}
    assert scanned == {(r.qid, r["rank"], r.id) for r in truth if not wanted[r.qid]}


def test_single_attribute_search_and_post_filter_against_brute_force(spark, sf_dir):
    from veldra.operators import exact, strategies
    from veldra.plans.fixtures import ATTRIBUTES, base, queries

    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    one = wanted.withColumn("bounds", catalogue.F.array(catalogue.F.get("bounds", catalogue.F.lit(0))))
    truth = exact.exact_topk(rows, one, 10, ["a0"]).collect()
    assert recall_of(catalogue.graph_search_single_attr(spark, sf_dir).collect(), truth) >= 0.9
    after = strategies.postfilter(rows, wanted, ATTRIBUTES, 64, 10).where("id IS NOT NULL").collect()
    assert recall_of(catalogue.hnsw_postfilter(spark, sf_dir).collect(), after) >= 0.9


def test_walks_within_a_distance_and_after_updates(spark, sf_dir):
    from veldra.operators import exact
    from veldra.plans.fixtures import base, queries

    truth = catalogue.epsilon_ball(spark, sf_dir).collect()
    got = catalogue.hnsw_epsilon(spark, sf_dir).collect()
    assert recall_of(got, truth) >= 0.9 and all(r.dist <= 1.5 for r in got)
    left = base(spark, sf_dir).where("id % 11 <> 5")
    rows = catalogue.hnsw_updated(spark, sf_dir).collect()
    assert all(r.id % 11 != 5 for r in rows) and recall_of(rows, exact.exact_topk(left, queries(spark, sf_dir), 10).collect()) >= 0.9


def test_static_buckets_equal_brute_force(spark, sf_dir):
    import zlib

    import numpy as np
    import pandas as pd

    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id")
    v, ids, n = np.stack(table.embedding).astype(float), table.vec_id.to_numpy(), len(table)
    want = set()
    for q in ids[ids % 100 == 0].tolist():
        for b, share in enumerate(catalogue.BUCKETS):
            width = max(1, int(n * share))
            left = zlib.crc32(f"{q}:{b}".encode()) % (n - width + 1)
            own = np.flatnonzero((ids >= left) & (ids <= left + width - 1))
            dist = ((v[own] - v[ids == q][0]) ** 2).sum(axis=1)
            want |= {(b, q, left, left + width - 1, k + 1, int(ids[own[j]])) for k, j in enumerate(np.lexsort((ids[own], dist))[:10])}
    assert {(r.bucket, r.qid, r.l, r.r, r["rank"], r.id) for r in catalogue.static_range_buckets(spark, sf_dir).collect()} == want


def test_hashed_workloads(spark, sf_dir):
    import zlib

    import numpy as np

    base = {r.id: list(r.v) for r in catalogue.base(spark, sf_dir).collect()}
    for query in (catalogue.independent_attributes, catalogue.mixed_attributes):
        rows = query(spark, sf_dir).collect()
        for a in range(3):
            assert sorted(r.value for r in rows if r.attr == a) == list(range(len(base))) == sorted(r.id for r in rows if r.attr == a)
    first = {r.id: r.value for r in catalogue.mixed_attributes(spark, sf_dir).collect() if r.attr == 0}
    want = catalogue.vector_norm_projection(spark, sf_dir).collect()
    assert [i for i in sorted(first, key=first.get)] == [r.id for r in sorted(want, key=lambda r: (r.norm2, r.id))]
    for r in catalogue.noisy_queries(spark, sf_dir).collect():
        gap = np.abs(np.array(r.qv) - np.array(base[r.qid]))
        assert 0 < gap.max() <= 0.0100001
    trace = sorted(catalogue.unordered_insert_trace(spark, sf_dir).collect(), key=lambda r: r.pos)
    assert [r.id for r in trace] == sorted(base, key=lambda i: (zlib.crc32(str(i).encode()), i)) and sum(r.is_initial for r in trace) == round(0.8 * len(base))


def test_a_static_graph_has_valid_edges(spark, sf_dir):
    from veldra.operators import graph

    rows = catalogue.graph_build_static(spark, sf_dir)
    assert rows.count() > 0 and rows.where(~graph.valid_condition(catalogue.base(spark, sf_dir).count())).count() == 0

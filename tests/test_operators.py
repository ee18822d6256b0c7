"""Hand-checked and model-based cases of the search operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.functions.predicates import parse_attributes
from veldra.operators import evaluate, exact, graph, overlay, ranks, workload
from veldra.session import stored
from veldra.sources import binary, tables

SANE = [(0, 0), (1, 0), (0, 2), (3, 0), (0, 4), (5, 0), (0, 6), (7, 0)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<float>")


def generated(i):
    return [float((i * (4 * d + 7) + d) % 101) for d in range(8)], float(i % 17), float(7 * i % 23), float(13 * i % 31)


def test_ties_go_to_the_lower_id(spark):
    base = vectors(spark, enumerate(SANE))
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (1, [4.0, 0.0]), (2, [0.0, 5.0])], "qid long, qv array<float>")
    rows = exact.exact_topk(base, queries, 3).orderBy("qid", "rank").collect()
    assert [[r.id for r in rows if r.qid == q] for q in range(3)] == [[0, 1, 2], [3, 5, 1], [4, 6, 2]]
    assert [[r.dist for r in rows if r.qid == q] for q in range(3)] == [[0, 1, 4], [1, 1, 9], [1, 1, 9]]


@pytest.mark.parametrize("k", [0, 1, 7, 2000])
def test_exact_topk_equals_brute_force(spark, k):
    rows = [(i, *generated(i)) for i in range(400)]
    base = spark.createDataFrame(rows, "id long, v array<float>, a0 float, a1 float, a2 float").repartition(5)
    wanted = [(q, generated(19 * q)[0], [(-1e9, 1e9), (2.0, 9.0) if q % 2 else (None, None), (5.0, 3.0) if q == 4 else (0.0, 20.0)]) for q in range(6)]
    queries = spark.createDataFrame(wanted, "qid long, qv array<float>, bounds array<struct<low:float,high:float>>")
    got = exact.exact_topk(base, queries, k, ["a0", "a1", "a2"]).collect()
    for q, qv, bounds in wanted:
        legal = [(sum((a - b) ** 2 for a, b in zip(v, qv)), i) for i, v, *a in rows if all((lo is None or x >= lo) and (hi is None or x <= hi) for x, (lo, hi) in zip(a, bounds))]
        assert [(r.dist, r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == sorted(legal)[:k]


def test_no_rows_and_no_queries(spark):
    base = vectors(spark, enumerate(SANE))
    none = spark.createDataFrame([], "qid long, qv array<float>")
    assert exact.exact_topk(base, none, 3).count() == 0
    some = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, qv array<float>")
    assert exact.exact_topk(base.where("id < 0"), some, 3).count() == 0


def test_row_numbers_over_many_parts(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 9), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g int, x int, i int")
    got = {r.i: r.n for r in ranks.row_numbers(frame, ["x", "i"], "n", ["g"]).collect()}
    for g in range(4):
        assert [got[i] for _, i in sorted((x, i) for h, x, i in rows if h == g)] == list(range(sum(h == g for h, _, _ in rows)))


def test_attribute_masks():
    assert parse_attributes("", 2) == [True, True] == parse_attributes("all", 2)
    assert parse_attributes("none", 2) == [False, False]
    assert parse_attributes("1", 2) == [False, True]
    for bad in ("1 1", "2"):
        with pytest.raises(ValueError):
            parse_attributes(bad, 2)


def test_overlay_against_a_model(spark):
    rnd = random.Random(5)
    n = 20
    base = spark.createDataFrame([(i, [float(i)], float(i)) for i in range(n)], "id long, v array<float>, a0 float")
    state = {i: (float(i), float(i), 0, False) for i in range(n)}
    log, version, top = [], 0, n
    for sequence in range(1, 301):
        op = rnd.choice(["insert", "upsert", "attributes", "erase"])
        i = top if op == "insert" else rnd.randint(0, top + 3)
        top = top + 1 if op == "insert" else top
        x, a = float(rnd.randint(0, 99)), float(rnd.randint(0, 99))
        log.append((sequence, i, op, [x] if op in ("insert", "upsert") else None, [a] if op != "erase" else None))
        if op == "erase":
            state.pop(i, None)
        elif op != "attributes" or i in state:
            version += 1
            state[i] = (state[i][0] if op == "attributes" else x, a, version, True)
    resolved = overlay.resolve(spark.createDataFrame(log, "sequence long, id long, op string, v array<float>, attrs array<float>"), base)
    live = {r.id: (r.v[0], r.a0, r.version, r.from_delta) for r in overlay.live_view(resolved, base, ["a0"]).collect()}
    assert live == state


def test_journal_is_rejected_as_a_whole(spark):
    schema = "sequence long, id long, erased boolean, v array<float>, attrs array<float>, version long"
    good = spark.createDataFrame([(4, 1, False, [1.0], [1.0], 3), (5, 2, True, None, None, None), (6, 3, False, [1.0], [2.0], 4)], schema)
    overlay.validate_journal(good, 3, 1)
    for bad, cut, arity in ((good, 4, 1), (good, 3, 2), (good.where("sequence <> 4").union(spark.createDataFrame([(7, 9, False, [1.0], [1.0], 9)], schema)), 3, 1)):
        with pytest.raises(ValueError):
            overlay.validate_journal(bad, cut, arity)


def test_corrupted_journals_are_refused(spark):
    base = spark.createDataFrame([(i, [float(i)], float(i)) for i in range(6)], "id long, v array<float>, a0 float")
    log = [(1, 0, "erase"), (2, 0, "attributes"), (3, 6, "insert"), (4, 1, "erase"), (5, 0, "attributes"), (6, 2, "attributes"), (7, 3, "erase"), (8, 7, "insert"), (9, 0, "attributes"), (10, 4, "erase")]
    rows = [(s, i, op, [1.0] if op == "insert" else None, None if op == "erase" else [2.0]) for s, i, op in log]
    resolved = stored(overlay.resolve(spark.createDataFrame(rows, "sequence long, id long, op string, v array<float>, attrs array<float>"), base), "log")
    assert [r.accepted_no for r in resolved.orderBy("sequence").collect()] == [1, None, 2, 3, None, 4, 5, 6, None, 7]
    journal = overlay.journal_since(resolved, 3)
    overlay.validate_journal(journal, 3, 1, 2)  # rejected mutations leave holes in the sequence, not in the numbers
    overlay.validate_journal(journal.where("false"), 3, 1, 2)
    lost_erase, lost_image, lost_first = journal.where("sequence <> 7"), journal.where("sequence <> 6"), journal.where("sequence <> 4")
    twice = journal.unionByName(journal.where("sequence = 7"))
    swapped = journal.withColumn("sequence", F.when(F.col("sequence") == 6, 7).when(F.col("sequence") == 7, 6).otherwise(F.col("sequence")))
    bad_version = journal.withColumn("version", F.when(F.col("sequence") == 8, F.col("version") + 1).otherwise(F.col("version")))
    wrong_arity = journal.withColumn("attrs", F.when(F.col("sequence") == 8, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("attrs").cast("array<double>")))
    image_of_erase = journal.withColumn("version", F.when(F.col("sequence") == 7, F.lit(5)).otherwise(F.col("version")))
    for bad in (lost_erase, lost_image, lost_first, twice, swapped, bad_version, wrong_arity, image_of_erase):
        with pytest.raises(ValueError):
            overlay.validate_journal(bad, 3, 1, 2)


def test_base_validation(spark):
    good = spark.createDataFrame([(0, [1.0], 1.0), (3, [2.0], 2.0)], "id long, v array<float>, a0 float")
    overlay.validate_base(good, ["a0"], 4)
    for bad, top in ((good, 3), (good.union(good), 9), (good.withColumn("a0", F.lit(float("nan")).cast("float")), 9), (good.withColumn("v", F.when(F.col("id") > 0, F.col("v"))), 9)):
        with pytest.raises(ValueError):
            overlay.validate_base(bad, ["a0"], top)


def test_insert_ids_end_at_the_limit(spark):
    rows = spark.createDataFrame([(x,) for x in "ba"], "x string")
    assert [(r.x, r.id) for r in overlay.allocate_inserts(rows, 7, ["x"]).orderBy("id").collect()] == [("a", 7), ("b", 8)]
    with pytest.raises(ValueError):
        overlay.allocate_inserts(rows, overlay.ID_LIMIT - 1, ["x"])


def greedy(center, labels, dists, v, left, right, most):
    """The candidates within [left, right] that are taken nearest first, but for those that one taken before is nearer to than the centre."""
    taken = []
    for i, x in enumerate(labels):
        if left <= x <= right and len(taken) < most and all(((v[i] - v[j]) ** 2).sum() >= dists[i] for j in taken):
            taken.append(i)
    return {labels[i] for i in taken}


@pytest.mark.parametrize("seed", range(12))
def test_every_range_finds_its_greedy_edges(seed):
    rnd = np.random.default_rng(seed)
    n = 14
    v = rnd.integers(0, 9, (n, 3)).astype(float)
    center = int(rnd.integers(n))
    order = sorted((float(((v[i] - v[center]) ** 2).sum()), i) for i in range(n) if i != center)
    labels, dists = [i for _, i in order], [d for d, _ in order]
    for most in (1, 3, 16):
        got = graph.compress_node(center, np.array(labels), np.array(dists), v[labels], n, most)
        assert len({e[0] for e in got}) == len(got) and all(ll <= lu and rl <= ru for _, ll, lu, rl, ru in got)
        reached = set()
        for left in range(center + 1):
            for right in range(center, n):
                want = greedy(center, labels, dists, v[labels], left, right, most)
                assert want <= {dst for dst, ll, lu, rl, ru in got if ll <= left <= lu and rl <= right <= ru}
                reached |= want
        assert {e[0] for e in got} == reached  # and no edge that no range asks for


def test_neighbours_in_blocks_find_the_same_rows(spark):
    base = spark.createDataFrame([(i, generated(i)[0]) for i in range(300)], "id long, v array<float>")
    exactly = {(r.src, r.dst) for r in graph.neighbours(base, 5).collect()}
    cells = {(r.src, r.dst) for r in graph.neighbours(base, 5, block_rows=100).collect()}
    assert len(cells) > 1000 and len(exactly & cells) > 0.4 * len(exactly)


def test_neighbours_are_exact_beyond_the_bound(spark):
    rows = [(i, generated(i)[0]) for i in range(300)] + [(300 + i, generated(7)[0]) for i in range(300)]
    base = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    v = np.array([x for _, x in rows], dtype=np.float32).astype(float)
    want = {(i, k, int(j)) for i in range(600) for k, j in enumerate([j for j in np.lexsort((np.arange(600), ((v - v[i]) ** 2).sum(axis=1))) if j != i][:5])}
    for block_rows in (1000, 250):
        assert {(r.src, r.pos, r.dst) for r in graph.neighbours(base, 5, block_rows=block_rows).collect()} == want


def test_graph_edits_keep_edges_valid(spark):
    base = spark.createDataFrame([(i, generated(i)[0]) for i in range(60)], "id long, v array<float>")
    old = base.where("id < 58")
    edges = graph.pruned(graph.symmetrised(graph.compress(graph.neighbours(old, 10), base, 60)), 60)
    grown = graph.inserted(edges, base.where("id >= 58"), base, 60, ef=10)
    assert grown.where(~graph.valid_condition(60)).count() == 0
    assert {r.src for r in grown.select("src").distinct().collect()} >= {58, 59}


def test_binary_files(spark, tmp_path):
    binary.register(spark)
    rows = [(i, [float(i), float(i) / 2, -1.0]) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    path = str(tmp_path / "x.fbin")
    assert binary.write_fbin(frame, path) == 1000
    back = spark.read.format("fbin").option("path", path).option("splitBytes", 3000).load()
    assert sorted((r.id, list(r.v)) for r in back.collect()) == rows
    assert spark.read.format("fbin").option("path", path).option("limit", 7).load().count() == 7
    ids = spark.createDataFrame([(2, 9), (0, 4), (1, 2**32 - 1)], "pos long, value long")
    binary.write_ibin(ids, str(tmp_path / "x.ibin"))
    assert [r.value for r in spark.read.format("ibin").option("path", str(tmp_path / "x.ibin")).load().orderBy("pos").collect()] == [4, 2**32 - 1, 9]
    lists = spark.createDataFrame([(0, [3, 1]), (1, [2, 0])], "pos long, ids array<int>")
    binary.write_neighbors(lists, str(tmp_path / "x.nbr"))
    assert [list(r.ids) for r in spark.read.format("neighbors").option("path", str(tmp_path / "x.nbr")).load().orderBy("pos").collect()] == [[3, 1], [2, 0]]
    with open(path, "ab") as file:
        file.write(b"x")
    with pytest.raises(Exception, match="header says"):
        spark.read.format("fbin").option("path", path).load().count()


def test_text_tables_and_snapshots(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0,1.5,2\n1,3,4\n")
    assert tables.read_attributes(spark, str(tmp_path / "a.csv"), ["a0", "a1"], 2).count() == 2
    (tmp_path / "b.csv").write_text("0,1,2\n0,3,4\n")
    with pytest.raises(ValueError):
        tables.read_attributes(spark, str(tmp_path / "b.csv"), ["a0", "a1"])
    (tmp_path / "f.csv").write_text("query_idx,primary_attr,attr0_low,attr0_high,query_attrs\n0,0,1,2,none\n1,0,-3,4,0\n")
    rows = tables.read_filters(spark, str(tmp_path / "f.csv"), 1).orderBy("qid").collect()
    assert [(r.profile, r.bounds[0].low, r.bounds[0].high, r.active) for r in rows] == [("all", 1.0, 2.0, [False]), ("all", -3.0, 4.0, [True])]
    live = spark.createDataFrame([(5, 1), (2, 0)], "id long, version long")
    tables.write_snapshot(live, str(tmp_path / "s"), 9, 3, 2)
    back, meta = tables.read_snapshot(spark, str(tmp_path / "s"))
    assert meta["next_id"] == 9 and [(r.local_id, r.id) for r in back.orderBy("id").collect()] == [(0, 2), (1, 5)]


def test_metric_lines(spark):
    lines = spark.createDataFrame([("total recall=0.5 ms=2",), ("note",)], "value string")
    assert [(r.name, r.metrics) for r in evaluate.parse_metrics(lines).collect()] == [("total", {"recall": "0.5", "ms": "2"})]


def test_tie_recall_counts_any_row_at_the_radius(spark):
    schema = "qid long, id long, dist double"
    legal = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (0, 3, 2.0)], schema)
    truth = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0)], schema)
    results = spark.createDataFrame([(0, 1), (0, 3)], "qid long, id long")
    queries = spark.createDataFrame([(0,), (1,)], "qid long")
    assert {r.qid: r.recall for r in evaluate.recall(results, truth, queries, 2).collect()} == {0: 0.5, 1: 1.0}
    assert {r.qid: r.tie_recall for r in evaluate.tie_recall(results, truth, legal, queries, 2).collect()} == {0: 1.0, 1: 1.0}


def test_centred_ranges_stay_inside(spark):
    anchors = spark.createDataFrame([(q, a, v) for q in range(8) for a, v in ((0, 0), (1, 50), (2, 99))], "qid long, attr int, value long")
    rows = workload.centred_ranges(anchors, 100, workload.profile_ratios(3)).collect()
    assert len(rows) == 24 and all(0 <= r.low <= r.high <= 99 for r in rows)
    assert {r.high - r.low + 1 for r in rows if r.profile == "balanced"} == {30}


def test_synthesised_queries(spark):
    base = spark.createDataFrame([(i, [float(i), float(i) + 0.5]) for i in range(10)], "id long, v array<float>")
    rows = workload.synthesised_queries(base, 5, 2, 1).collect()
    assert len(rows) == 5 and all(r.qv[0] in range(10) and r.qv[1] - 0.5 in range(10) for r in rows)


def test_stream_of_mutations(spark, tmp_path):
    from veldra.streaming.mutations import append_log

    source = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame([(10 * k + i, "upsert") for i in (2, 1)], "id long, op string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id long, op string").option("maxFilesPerTrigger", 1).parquet(str(source))
    append_log(stream, str(tmp_path / "log"), str(tmp_path / "cp"), ["id"]).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "log")).orderBy("sequence").collect()
    assert [r.sequence for r in rows] == [1, 2, 3, 4] and [r.id % 10 for r in rows] == [1, 2, 1, 2]


def test_whole_numbers_above_2_24_are_told_apart(spark):
    top = 1 << 24
    base = spark.createDataFrame([(top + i, [float(i)]) for i in range(8)] + [(9, [0.0])], "id long, v array<float>").withColumn("p", F.col("id"))
    bounds = "array<struct<low:long,high:long>>"
    queries = spark.createDataFrame([(0, [0.0], [(top + 1, top + 1)]), (1, [0.0], [(top + 3, top + 5)]), (2, [0.0], [(None, top)]), (3, [0.0], [(top + 9, None)])], f"qid long, qv array<float>, bounds {bounds}")
    got = {}
    for r in exact.exact_topk(base, queries, 5, ["p"]).collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {0: [top + 1], 1: [top + 3, top + 4, top + 5], 2: [9, top]}
    missing = base.withColumn("p", F.when(F.col("id") != top + 3, F.col("p")))
    assert [r.id for r in exact.exact_topk(missing, queries.where("qid = 1"), 5, ["p"]).collect()] == [top + 4, top + 5]
    real = spark.createDataFrame([(0, [0.0], [(2.5, float("inf"))]), (1, [0.0], [(float("-inf"), 9.9)])], "qid long, qv array<float>, bounds array<struct<low:double,high:double>>")
    assert {(r.qid, r.id) for r in exact.exact_topk(base, real, 1, ["p"]).collect()} == {(0, 9), (1, 9)}


@pytest.mark.parametrize("inner", [False, True])
def test_nearest_groups_equal_brute_force(spark, inner):
    rnd = np.random.default_rng(2)
    v, g = rnd.integers(-3, 4, (500, 4)).astype(float), rnd.integers(0, 40, 500)
    base = spark.createDataFrame([(i, v[i].tolist(), None if g[i] == 7 else int(g[i])) for i in range(500)], "id long, v array<float>, g int").repartition(4)
    q = rnd.integers(-3, 4, (5, 4)).astype(float)
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(5)], "qid long, qv array<float>")
    for k in (1, 6, 100):
        rows = exact.top_groups(base, queries, "g", k, inner).collect()
        for i in range(5):
            dist = 1 - v @ q[i] if inner else ((v - q[i]) ** 2).sum(axis=1)
            best = sorted((float(dist[g == x].min()), -1 if x == 7 else int(x)) for x in set(g.tolist()))[:k]
            assert sorted((r.best_dist, -1 if r.g is None else r.g) for r in rows if r.qid == i) == best
    assert exact.top_groups(base.where("false"), queries, "g", 3, inner).count() == 0


def test_more_pair_queries_than_are_broadcast(spark, monkeypatch):
    from veldra.operators import strategies

    base = spark.createDataFrame([(i, [float(i)], float(i)) for i in range(30)], "id long, v array<float>, a0 float")
    queries = spark.createDataFrame([(q, [float(q)], [(float(q), float(q + 2))]) for q in range(20)], "qid long, qv array<float>, bounds array<struct<low:float,high:float>>")
    whole = sorted(map(tuple, strategies.legal_rows(base, queries, ["a0"]).collect()))
    monkeypatch.setattr(exact, "PAIR_QUERIES", 6)
    monkeypatch.setattr(exact, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, strategies.legal_rows(base, queries, ["a0"]).collect())) == whole and len(whole) == 60
    assert exact.exact_topk(base, queries, 2, ["a0"]).count() == 40


def test_sharded_graphs_at_the_scale_of_many_shards(spark):
    from veldra.operators import search

    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16)) * 4
    v = (centres[rnd.integers(0, 12, 3000)] + rnd.normal(size=(3000, 16))).astype(np.float32)
    base = spark.createDataFrame([(i, v[i].tolist(), float(i * 7 % 101), float(i * 13 % 211)) for i in range(3000)], "id long, v array<float>, a0 float, a1 float")
    open_end = float("inf")
    queries = spark.createDataFrame([(i, v[i].tolist(), i % 2, [(10.0, 60.0) if i % 2 == 0 else (-open_end, open_end), (50.0, 150.0) if i % 2 else (-open_end, open_end)]) for i in range(0, 3000, 75)], "qid long, qv array<float>, nav_attr int, bounds array<struct<low:float,high:float>>")
    truth = {(r.qid, r.id) for r in exact.exact_topk(base, queries, 10, ["a0", "a1"]).collect()}
    nodes = stored(graph.sharded_nodes(base, ["a0", "a1"], [0, 1], 700), "nodes")
    edges = stored(graph.build_sharded(nodes, ef=32), "graph")
    assert edges.select("attr", "shard").distinct().count() == 10
    rows = search.walk_shards(nodes, edges, queries, ["a0", "a1"], 10, 64).collect()
    assert len({(r.qid, r.id) for r in rows} & truth) >= 0.9 * len(truth)
    walked = {(r.qid, r.id): r.distances for r in rows}
    assert 0 < max(walked.values()) <= 3000


def test_stored_graphs_are_checked(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 0, 0, 1, 1), (1, 0, 0, 0, 1, 1)], graph.EDGE)
    graph.save(edges, str(tmp_path / "g"), 2, k=16)
    back, meta = graph.load(spark, str(tmp_path / "g"), 2)
    assert sorted(map(tuple, back.select("src", "dst").collect())) == [(0, 1), (1, 0)] and meta["settings"] == {"k": "16"}
    with pytest.raises(ValueError, match="rows"):
        graph.load(spark, str(tmp_path / "g"), 3)
    edges.limit(1).write.mode("append").parquet(str(tmp_path / "g" / "edges"))
    with pytest.raises(ValueError, match="missing"):
        graph.load(spark, str(tmp_path / "g"), 2)
    labels = spark.createDataFrame([(0,), (1,)], "rnk long")
    graph.checked_labels(labels, 2)
    for bad in (labels.union(labels), labels.withColumn("rnk", F.col("rnk") + 1), labels.withColumn("rnk", F.col("rnk") - 1)):
        with pytest.raises(ValueError):
            graph.checked_labels(bad, 2)
    after = edges.union(spark.createDataFrame([(2, 0, 0, 0, 1, 1)], graph.EDGE)).where("src <> 1")
    assert tuple(graph.insertion_statistics(edges, after).first()) == (1, 1, 1, 2)


def test_layered_index_is_stored_and_updated(spark, tmp_path):
    from veldra.operators import hnsw

    base = spark.createDataFrame([(i, generated(i)[0]) for i in range(120)], "id long, v array<float>")
    rows = hnsw.sharded(base, 40)
    links = hnsw.build(rows)
    hnsw.save(links, str(tmp_path / "h"), m=16)
    back, settings = hnsw.load(spark, str(tmp_path / "h"))
    assert settings == {"m": "16"} and back.count() == links.count()
    queries = spark.createDataFrame([(7, generated(7)[0])], "qid long, qv array<float>")
    assert [r.id for r in hnsw.search(rows, back, queries, 1, 30).collect()] == [7]
    marked = hnsw.unmarked(rows, base.where("id = 7"))
    assert 7 not in {r.id for r in hnsw.search(marked, back, queries, 5, 30).collect()}
    moved = rows.withColumn("v", F.when(F.col("id") == 50, F.array(*[F.lit(x).cast("float") for x in generated(7)[0]])).otherwise(F.col("v")))
    again = hnsw.updated(moved, back, moved.where("id = 50"))
    assert [r.id for r in hnsw.search(moved, again, queries, 2, 30).orderBy("rank").collect()] == [7, 50]
    far = hnsw.within(rows, back, queries, 0.0, 30, 40).collect()
    assert sorted((r.id, r.dist) for r in far) == [(7, 0.0), (108, 0.0)]  # vectors of the fixture repeat


def mutated(spark):
    from veldra.operators import dynamic

    base = spark.createDataFrame([(i, [float(i)], float(i)) for i in range(10)], "id long, v array<float>, a0 float")
    return base, overlay.resolve(dynamic.scenario(base, 3, 4, 2, ["a0"]), base)


def test_a_scenario_and_its_statistics(spark):
    from veldra.operators import dynamic

    base, log = mutated(spark)
    rows = sorted(log.collect(), key=lambda r: r.sequence)
    assert [(r.sequence, r.id, r.op) for r in rows] == [(1, 10, "insert"), (2, 11, "insert"), (3, 12, "insert"), (4, 0, "attributes"), (5, 1, "attributes"), (6, 2, "attributes"), (7, 3, "attributes"), (8, 8, "erase"), (9, 9, "erase")]
    assert [r.attrs[0] for r in rows[3:7]] == [5.0, 6.0, 7.0, 8.0] and all(abs(r.v[0] - i) <= 0.01 for i, r in enumerate(rows[:3]))
    assert tuple(dynamic.statistics(log, base, ["a0"]).first()) == (10, 7, 6, 11, 9, 0, 8)


def test_one_capture_at_a_time_and_a_whole_acknowledgement(spark, tmp_path):
    from veldra.operators import dynamic

    base, log = mutated(spark)
    own = dynamic.Capture(spark, str(tmp_path))
    early = log.where("sequence <= 5")
    token = own.begin(early, base, ["a0"])
    with pytest.raises(ValueError, match="open"):
        own.begin(early, base, ["a0"])
    with pytest.raises(ValueError, match="token"):
        own.state("other")
    state = own.state(token)
    assert (state["cut"], state["next_id"], state["next_version"], own.live().count()) == (5, 13, 6, 13)
    journal = overlay.journal_since(log, 5)
    fresh = own.live()
    dynamic.check_replay(own.live(), fresh, journal, state, ["a0"])
    for bad_fresh, bad_journal in ((fresh.where("id > 0"), journal), (fresh.withColumn("a0", F.col("a0") + 1), journal), (fresh, journal.withColumn("version", F.col("version") + 1)), (fresh, journal.withColumn("sequence", F.col("sequence") - 3))):
        with pytest.raises(ValueError):
            dynamic.check_replay(own.live(), bad_fresh, bad_journal, state, ["a0"])
    with pytest.raises(ValueError, match="lost"):
        own.finish(token, log, 7)
    own.finish(token, log, 9)
    with pytest.raises(ValueError, match="no capture"):
        own.state(token)
    assert own.begin(log, base, ["a0"]) != token


def test_field_updates_are_rejected_as_a_whole(spark):
    from veldra.operators import dynamic

    live = spark.createDataFrame([(1, [1.0], 5.0, 6.0)], "id long, v array<float>, a0 float, a1 float")
    nan = float("nan")
    rows = [(0, 1, [9.0], [(1, 7.0)]), (1, 1, None, []), (2, 2, None, [(0, 1.0)]), (3, 1, None, [(0, 1.0), (0, 2.0)]), (4, 1, None, [(2, 1.0)]), (5, 1, None, [(0, nan)]), (6, 1, None, [(-1, 1.0)])]
    changes = spark.createDataFrame(rows, "c int, id long, new_v array<float>, fields array<struct<attr:int,value:float>>")
    got = {r.c: (r.accepted, r.v, r.a0, r.a1) for r in dynamic.field_updates(live, changes, ["a0", "a1"], ["c"]).collect()}
    assert got == {0: (True, [9.0], 5.0, 7.0), 1: (True, [1.0], 5.0, 6.0), **{i: (False, None, None, None) for i in range(2, 7)}}


def test_more_files(spark, tmp_path):
    binary.register(spark)
    pairs = spark.createDataFrame([(1, 5, 9), (0, -2, 3)], "pos long, l int, r int")
    binary.write_ranges(pairs, str(tmp_path / "r.bin"))
    back = spark.read.format("ranges").option("path", str(tmp_path / "r.bin")).load().orderBy("pos").collect()
    assert [(r.l, r.r) for r in back] == [(-2, 3), (5, 9)]
    for name, dim in (("b", 2), ("q", 2), ("w", 3)):
        binary.write_fbin(spark.createDataFrame([(i, [float(i)] * dim) for i in range(300)], "id long, v array<float>").repartition(5), str(tmp_path / name))
    rows, wanted = binary.read_pair(spark, str(tmp_path / "b"), f"file://{tmp_path}/q")
    assert rows.count() == 300 and wanted.columns == ["qid", "qv"] and {(r.qid, r.qv[1]) for r in wanted.collect()} == {(i, float(i)) for i in range(300)}
    with pytest.raises(ValueError, match="dimensions"):
        binary.read_pair(spark, str(tmp_path / "b"), str(tmp_path / "w"))
    with pytest.raises(ValueError, match="lengths"):
        binary.write_fbin(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<float>"), str(tmp_path / "x"))
    truth = spark.createDataFrame([(b, 1, 0, 9, 1, 3) for b in range(7)], "bucket int, qid long, l int, r int, rank int, id long")
    tables.write_groundtruth(truth, str(tmp_path / "t"))
    assert tables.read_groundtruth(spark, str(tmp_path / "t")).count() == 7
    tables.write_groundtruth(truth.where("bucket <> 2"), str(tmp_path / "u"))
    with pytest.raises(ValueError, match="2"):
        tables.read_groundtruth(spark, str(tmp_path / "u"))
    (tmp_path / "old.csv").write_text("0,5,9,a,b,c,d, 3 1 2 \nshort,1\n")
    assert [tuple(r) for r in tables.read_legacy_groundtruth(spark, str(tmp_path / "old.csv")).collect()] == [(5, 9, [3, 1, 2])]
    work = spark.createDataFrame([(1, 0.5, 10, 2), (2, 0.1, 3, 1)], "qid long, ms double, dist long, hops long")
    found = spark.createDataFrame([(1, 2, 8, 2.0), (1, 1, 4, 1.0)], "qid long, rank int, id long, dist double")
    tables.write_results(tables.per_query_results(found, work), str(tmp_path / "out"))
    assert [(r.q, r.ids, r.distances) for r in spark.read.json(str(tmp_path / "out")).orderBy("q").collect()] == [(1, [4, 8], [1.0, 2.0]), (2, [], [])]


def test_snapshot_files_and_frozen_inputs(spark, tmp_path):
    binary.register(spark)
    live = spark.createDataFrame([(9, [1.0, 2.0], 5.0, 3), (4, [3.0, 4.0], 6.0, 0)], "id long, v array<float>, a0 float, version long")
    folder = str(tmp_path / "s")
    assert tables.export_snapshot(live, folder, ["a0"], 10, 7, 4) == 2
    rows, meta = tables.import_snapshot(spark, folder, ["a0"])
    assert sorted((r.local_id, r.id, r.v, r.a0) for r in rows.collect()) == [(0, 4, [3.0, 4.0], 6.0), (1, 9, [1.0, 2.0], 5.0)]
    assert meta["next_original_id"] == 10 and meta["sequence"] == 7 and meta["next_version"] == 4
    (tmp_path / "s" / "snapshot.meta").write_text("rows=2\n")
    with pytest.raises(ValueError, match="high-water"):
        tables.import_snapshot(spark, folder, ["a0"])
    assert tables.import_snapshot(spark, folder, ["a0"], allow_legacy=True)[1]["next_original_id"] == 0
    queries = spark.createDataFrame([(40, [1.0], "p", 0, [(0.0, 1.0)]), (20, [2.0], "p", 0, [(2.0, 3.0)])], "qid long, qv array<float>, profile string, primary_attr int, bounds array<struct<low:float,high:float>>")
    tables.freeze_inputs(queries, str(tmp_path / "f"))
    assert [r.v for r in spark.read.format("fbin").option("path", str(tmp_path / "f" / "queries.fbin")).load().orderBy("id").collect()] == [[2.0], [1.0]]
    assert [(r.qid, r.bounds[0].low) for r in tables.read_filters(spark, str(tmp_path / "f" / "filters.csv"), 1).orderBy("qid").collect()] == [(0, 2.0), (1, 0.0)]


def test_manifests_regressions_and_schedules(spark, tmp_path):
    from veldra.operators import summaries

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    old = summaries.file_manifest(spark, str(tmp_path / "d")).collect()
    assert old[0].bytes == 3 and len(old[0].sha256) == 64
    (tmp_path / "d" / "b.txt").write_text("two")
    changed = summaries.changed_files(spark.createDataFrame(old), summaries.file_manifest(spark, str(tmp_path / "d"))).collect()
    assert [r.path.rsplit("/")[-1] for r in changed] == ["b.txt"]
    rows = lambda x: spark.createDataFrame(x, "k string, x double")
    found = summaries.regressions(rows([("a", 1.0), ("b", 1.0), ("c", 1.0)]), rows([("a", 1.01), ("b", 2.0), ("d", 1.0)]), ["k"], "x", 0.05)
    assert sorted((r.k, r.kind) for r in found.collect()) == [("b", "changed"), ("c", "gone"), ("d", "new")]
    plan = workload.schedule(spark, ["x", "y", "z"], 4).collect()
    assert all(sorted(r.method for r in plan if r.repetition == k) == ["x", "y", "z"] for k in range(4))


def test_arity_is_checked():
    from veldra.functions.predicates import validate_arity

    validate_arity(3, 3)
    with pytest.raises(ValueError):
        validate_arity(2, 3)


def test_an_audit_of_nothing_and_of_each_fault(spark):
    schema = "qid long, id long, dist double"
    legal = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0)], schema)
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    queries = spark.createDataFrame([(0,), (1,)], "qid long")
    good = [(0, 1, 1.0), (0, 2, 2.0)]
    faults = {0: good + [(0, 99, 1.0)], 1: good + [(0, 3, 1.0)], 2: good + [(0, 1, 1.0)], 3: [(0, 1, 1.5), (0, 2, 2.0)], 4: good[:1], 5: good + [(1, 3, 1.0)]}
    assert tuple(evaluate.audit(spark.createDataFrame(good, schema), ids, legal, queries, 2).first()) == (0, 0, 0, 0, 0, 0)
    for place, rows in faults.items():
        assert evaluate.audit(spark.createDataFrame(rows, schema), ids, legal, queries, 2).first()[place] == 1

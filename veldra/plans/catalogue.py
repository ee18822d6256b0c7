"""Registered queries of the search engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions import predicates, vectors
from veldra.operators import dynamic, evaluate, exact, graph, hnsw, index, knn, overlay, ranks, routing, runs, search, strategies, summaries, workload
from veldra.plans import fixtures
from veldra.plans.fixtures import ATTRIBUTES, MUTATIONS_SQL, PROFILES_SQL, WITH_SQL, base, dist_sql, queries, resolved, table
from veldra.session import scratch, stored

K = 10
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None, mutated: bool = False) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = f"WITH {WITH_SQL}{',' + MUTATIONS_SQL if mutated else ''}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return query

    return add


def all_pairs(spark: SparkSession, sf_dir: str, measure: str, name: str = "dist") -> DataFrame:
    return exact.measured_pairs(base(spark, sf_dir).select("id", "v"), queries(spark, sf_dir).select("qid", "qv"), measure, name)


# Distances


@registered(f"SELECT q.qid, b.id, {dist_sql()} AS dist FROM base b, q")
def l2_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir, "l2")


@registered("SELECT q.qid, b.id, 1.0 - list_sum(list_transform(list_zip(b.v, q.qv), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS ip_dist FROM base b, q")
def inner_product_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir, "ip", "ip_dist")


@registered("SELECT q.qid, b.id, list_sum(list_transform(list_zip(b.v, q.qv), lambda x: (floor(x[1]::DOUBLE * 100)::BIGINT - floor(x[2]::DOUBLE * 100)::BIGINT) * (floor(x[1]::DOUBLE * 100)::BIGINT - floor(x[2]::DOUBLE * 100)::BIGINT)))::BIGINT AS dist FROM base b, q")
def integer_l2_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir, "integer_l2")


@registered(""", m AS (SELECT id, list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)) AS norm2, list_sum(list_transform(list_zip(v, range(len(v))), lambda x: CASE WHEN x[2] % 2 = 0 THEN x[1]::DOUBLE ELSE -x[1]::DOUBLE END)) AS proj FROM base)
SELECT id, norm2, proj, row_number() OVER (ORDER BY norm2, id) - 1 AS norm_rank, row_number() OVER (ORDER BY proj, id) - 1 AS proj_rank FROM m""")
def vector_norm_projection(spark, sf_dir):
    rows = stored(base(spark, sf_dir).select("id", vectors.squared_norm(F.col("v")).alias("norm2"), vectors.signed_projection(F.col("v")).alias("proj")), "norms")
    numbered = ranks.ranks(ranks.long_form(rows, ["norm2", "proj"], kind="double"))
    own = numbered.groupBy("id").agg(F.max(F.when(F.col("attr") == 0, F.col("rnk"))).alias("norm_rank"), F.max(F.when(F.col("attr") == 1, F.col("rnk"))).alias("proj_rank"))
    return rows.join(own, "id").select("id", "norm2", "proj", "norm_rank", "proj_rank")


# Filters and ranks


@registered("SELECT qid, id FROM legal")
def range_filter(spark, sf_dir):
    return strategies.range_filter(base(spark, sf_dir), queries(spark, sf_dir), ATTRIBUTES)


@registered("SELECT q.qid, b.id FROM base b JOIN q ON CASE primary_attr WHEN 0 THEN a0 BETWEEN l0 AND h0 WHEN 1 THEN a1 BETWEEN l1 AND h1 ELSE a2 BETWEEN l2 AND h2 END")
def masked_filter(spark, sf_dir):
    return strategies.range_filter(base(spark, sf_dir), queries(spark, sf_dir), ATTRIBUTES, masked=True)


@registered("SELECT attr, id, row_number() OVER (PARTITION BY attr ORDER BY value, id) - 1 AS rnk FROM vals")
def attr_ranks(spark, sf_dir):
    return ranks.ranks(ranks.long_form(base(spark, sf_dir), ATTRIBUTES))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = queries(spark, sf_dir)
    found = ranks.rank_ranges(ranks.long_form(base(spark, sf_dir), ATTRIBUTES), wanted)
    return found.join(wanted.select("qid", "active"), "qid").withColumn("active", F.get("active", F.col("attr")))


@registered("SELECT qid, attr, lo, hi, span FROM spans")
def rank_ranges(spark, sf_dir):
    return ranks.rank_ranges(ranks.long_form(base(spark, sf_dir), ATTRIBUTES), queries(spark, sf_dir))


@registered("SELECT attr, id, (dense_rank() OVER (PARTITION BY attr ORDER BY value) - 1)::INT AS code FROM vals")
def ordinal_encoding(spark, sf_dir):
    return ranks.codes(ranks.long_form(base(spark, sf_dir), ATTRIBUTES))


@registered(", c AS (SELECT qid, count(*) AS n FROM legal GROUP BY qid) SELECT q.qid, coalesce(n, 0) AS raw_n, coalesce(n, 0) AS enc_n, 0::BIGINT AS diff_n FROM q LEFT JOIN c USING (qid)")
def ordinal_predicate_check(spark, sf_dir):
    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    values = ranks.long_form(rows, ATTRIBUTES)
    coded = ranks.codes(values).groupBy("id").agg(*[F.max(F.when(F.col("attr") == i, F.col("code"))).cast("float").alias(a) for i, a in enumerate(ATTRIBUTES)])
    bounds = ranks.bound_codes(values, wanted).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("attr", "low_code", "high_code"))).alias("b"))
    encoded = bounds.select("qid", F.transform("b", lambda x: F.struct(x["low_code"].cast("float").alias("low"), x["high_code"].cast("float").alias("high"))).alias("bounds"))
    raw = strategies.range_filter(rows, wanted, ATTRIBUTES).withColumn("raw", F.lit(1))
    both = raw.join(strategies.range_filter(coded, encoded, ATTRIBUTES).withColumn("enc", F.lit(1)), ["qid", "id"], "full")
    counts = both.groupBy("qid").agg(F.count("raw").alias("raw_n"), F.count("enc").alias("enc_n"), F.count_if(F.col("raw").isNull() | F.col("enc").isNull()).alias("diff_n"))
    return wanted.select("qid").join(counts, "qid", "left").na.fill(0)


# Exact search


@registered("SELECT qid, rank, id, dist FROM exact")
def exact_topk(spark, sf_dir):
    return exact.exact_topk(base(spark, sf_dir), queries(spark, sf_dir), K, ATTRIBUTES)


@registered(f"""SELECT qid, pos, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist DESC, id DESC) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM
  (SELECT q.qid, b.id, {dist_sql()} AS dist FROM base b, q WHERE b.id BETWEEN q.qid // 2 AND q.qid // 2 + 200)) WHERE rank <= 10)""")
def exact_topk_desc_range(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("a", F.col("id"))
    half = F.expr("qid div 2")
    wanted = queries(spark, sf_dir).withColumn("bounds", F.array(F.struct(half.alias("low"), (half + 200).alias("high"))))
    near = exact.exact_topk(rows, wanted, K, ["a"])
    last = Window.partitionBy("qid").orderBy(F.desc("dist"), F.desc("id"))
    return near.select("qid", F.row_number().over(last).alias("pos"), "id")


@registered(f"SELECT qid, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT q.qid, b.id, {dist_sql()} AS dist FROM base b, q WHERE b.label < 5)) WHERE rank <= 10")
def subset_topk(spark, sf_dir):
    return exact.exact_topk(base(spark, sf_dir).where("label < 5"), queries(spark, sf_dir), K).select("qid", "rank", "id")


@registered(f"SELECT qid, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT q.qid, b.id, {dist_sql()} AS dist FROM base b, q) WHERE dist <= 1.5) WHERE rank <= 50")
def epsilon_ball(spark, sf_dir):
    return exact.epsilon_ball(base(spark, sf_dir), queries(spark, sf_dir), 1.5, 50)


@registered(f"SELECT qid, label, best_dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best_dist, label) AS rank FROM (SELECT q.qid, b.label, min({dist_sql()}) AS best_dist FROM base b, q GROUP BY q.qid, b.label)) WHERE rank <= 3")
def multivector_top_docs(spark, sf_dir):
    return exact.top_groups(base(spark, sf_dir), queries(spark, sf_dir), "label", 3)


# Routing and strategies

NAV = "SELECT q.qid, coalesce(n.attr, -1) AS nav_attr, coalesce(n.span, -1) AS span, n.qid IS NULL AS fallback FROM q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {cost}, attr) AS rn FROM spans WHERE {who}) WHERE rn = 1) n USING (qid)"


def shown(choice: DataFrame) -> DataFrame:
    """-1 for no attribute and no span."""
    return choice.na.fill(-1, ["nav_attr", "span"])


@registered(NAV.format(cost="span", who="attr < 2 AND (active OR attr = 0)"))
def nav_adaptive(spark, sf_dir):
    own = spans(spark, sf_dir).withColumn("active", F.col("active") | (F.col("attr") == 0))
    return shown(routing.choose_navigation(own, queries(spark, sf_dir), [0, 1]))


@registered(NAV.format(cost="span * CASE attr WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 1.0 END", who="true"))
def nav_weighted(spark, sf_dir):
    return shown(routing.choose_navigation(spans(spark, sf_dir).withColumn("active", F.lit(True)), queries(spark, sf_dir), [0, 1, 2], {0: 2.0, 1: 0.5}))


@registered(NAV.format(cost="span", who="active AND attr = 1"))
def nav_fixed(spark, sf_dir):
    return shown(routing.choose_navigation(spans(spark, sf_dir), queries(spark, sf_dir), [0, 1, 2], fixed=1))


@registered(", n AS (" + NAV.format(cost="span", who="active AND attr < 2") + ") SELECT nav_attr, count(*) AS n FROM n GROUP BY nav_attr")
def nav_histogram(spark, sf_dir):
    return routing.histogram(shown(routing.choose_navigation(spans(spark, sf_dir), queries(spark, sf_dir), [0, 1])))


PRIMARY = "p AS (SELECT qid, arg_min(attr, (greatest(high::DOUBLE - low::DOUBLE + 1, 0), attr)) AS pa FROM fr GROUP BY qid)"


@registered(f""", {PRIMARY}, s AS (SELECT p.qid, count(*) AS scanned, count(l.id) AS passed FROM p JOIN fr ON fr.qid = p.qid AND fr.attr = p.pa JOIN vals ON vals.attr = p.pa AND value BETWEEN low AND high LEFT JOIN legal l ON l.qid = p.qid AND l.id = vals.id GROUP BY p.qid)
SELECT q.qid, coalesce(scanned, 0) AS scanned, coalesce(passed, 0) AS passed, e.rank, e.id FROM q LEFT JOIN s USING (qid) LEFT JOIN exact e USING (qid)""")
def prefilter(spark, sf_dir):
    wanted = queries(spark, sf_dir)
    return strategies.prefilter(base(spark, sf_dir), wanted, routing.narrowest_by_value(ranks.filter_ranges(wanted)), ATTRIBUTES, K)


POST = f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rn FROM (SELECT q.qid, b.id, {dist_sql()} AS dist FROM base b, q)) WHERE rn <= 64),
j AS (SELECT near.*, l.id IS NOT NULL AS ok FROM near LEFT JOIN legal l USING (qid, id)),
post AS (SELECT qid, rank, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM j WHERE ok) WHERE rank <= 10)"""


@registered(f", {POST} SELECT c.qid, raw_n, passed_n, rank, id FROM (SELECT qid, count(*) AS raw_n, count(*) FILTER (WHERE ok) AS passed_n FROM j GROUP BY qid) c LEFT JOIN post USING (qid)")
def postfilter(spark, sf_dir):
    return strategies.postfilter(base(spark, sf_dir), queries(spark, sf_dir), ATTRIBUTES, 64, K)


@registered("SELECT q.qid, coalesce(n, 0) AS legal_n, CASE WHEN coalesce(n, 0) <= 150 THEN 'prefilter' ELSE 'graph' END AS choice FROM q LEFT JOIN (SELECT qid, count(*) AS n FROM legal GROUP BY qid) USING (qid)")
def hybrid_route(spark, sf_dir):
    return routing.hybrid_choice(strategies.legal_counts(base(spark, sf_dir), queries(spark, sf_dir), ATTRIBUTES), 150)


@registered("SELECT qid, (SELECT count(*) FROM base) * product(span / (SELECT count(*) FROM base)) AS expected FROM spans GROUP BY qid")
def expected_matches(spark, sf_dir):
    n = base(spark, sf_dir).count()
    found = spans(spark, sf_dir).select("qid", (F.col("span") / n).alias("ratio"))
    return routing.expected_matches(n, found)


# The mutable overlay


@registered("SELECT id, version, from_delta, a0, a1, a2 FROM live", mutated=True)
def live_view(spark, sf_dir):
    return overlay.live_view(resolved(spark, sf_dir), base(spark, sf_dir), ATTRIBUTES).select("id", "version", "from_delta", *ATTRIBUTES)


@registered("SELECT id, version, from_delta, a0, a1, a2 FROM live", mutated=True)
def live_view_runs(spark, sf_dir):
    """The live view from sorted runs, to which the log came in four batches, two of them compacted."""
    log, rows = stored(fixtures.mutations(spark, sf_dir), "mutations"), base(spark, sf_dir)
    top = log.agg(F.max("sequence")).first()[0] or 0
    kept = runs.Runs(spark, scratch(spark, "runs"), rows, ATTRIBUTES)
    for part in range(1, 5):
        kept.append(log.where(F.col("sequence") <= top * part // 4))
        if part == 2:
            kept.compact()
    return kept.live_view().select("id", "version", "from_delta", *ATTRIBUTES)


@registered("SELECT qid, rank, id, dist, version, from_delta FROM dtop", mutated=True)
def dynamic_topk(spark, sf_dir):
    live = stored(overlay.live_view(resolved(spark, sf_dir), base(spark, sf_dir), ATTRIBUTES), "live")
    near = exact.exact_topk(live, queries(spark, sf_dir), K, ATTRIBUTES)
    return near.join(live.select("id", "version", "from_delta"), "id").select("qid", "rank", "id", "dist", "version", "from_delta")


@registered(", c AS (SELECT id FROM de UNION SELECT id FROM la WHERE in_base) SELECT (SELECT n FROM nb) AS base_n, count(*) AS changed_n, greatest(1, floor((SELECT n FROM nb) * 0.05))::BIGINT AS threshold, count(*) >= greatest(1, floor((SELECT n FROM nb) * 0.05)) AS needs_rebuild FROM c", mutated=True)
def rebuild_trigger(spark, sf_dir):
    return overlay.rebuild_trigger(resolved(spark, sf_dir), base(spark, sf_dir))


@registered("SELECT row_number() OVER (ORDER BY id) - 1 AS local_id, id, version FROM live", mutated=True)
def snapshot_compaction(spark, sf_dir):
    return overlay.snapshot(overlay.live_view(resolved(spark, sf_dir), base(spark, sf_dir), ATTRIBUTES)).select("local_id", "id", "version")


def capture_point(log: DataFrame) -> int:
    return log.agg(F.max("sequence")).first()[0] // 2


@registered("SELECT sequence, id, erased, coalesce(version, 0) AS version FROM re WHERE accepted AND sequence > (SELECT max(sequence) // 2 FROM re)", mutated=True)
def journal_since(spark, sf_dir):
    log = resolved(spark, sf_dir)
    return overlay.journal_since(log, capture_point(log)).select("sequence", "id", "erased", F.coalesce("version", F.lit(0).cast("long")).alias("version"))


@registered("SELECT 0::BIGINT AS only_old_n, 0::BIGINT AS only_new_n", mutated=True)
def replay_equivalence(spark, sf_dir):
    """Capture, journal and replay give the live view that the whole log gives."""
    log, rows = stored(resolved(spark, sf_dir), "log"), base(spark, sf_dir)
    cut = capture_point(log)
    captured = overlay.live_view(log.where(F.col("sequence") <= cut), rows, ATTRIBUTES)
    journal = overlay.journal_since(log, cut)
    overlay.validate_journal(journal, cut, len(ATTRIBUTES), log.where(F.col("accepted") & (F.col("sequence") <= cut)).count())
    columns = ["id", "version", *ATTRIBUTES]
    new = overlay.replay(captured, journal, ATTRIBUTES).select(*columns)
    old = overlay.live_view(log, rows, ATTRIBUTES).select(*columns)
    return old.exceptAll(new).agg(F.count("*").alias("only_old_n")).crossJoin(new.exceptAll(old).agg(F.count("*").alias("only_new_n")))


@registered("SELECT greatest((SELECT max(id) + 1 FROM base), (SELECT max(id) + 1 FROM re WHERE accepted AND NOT erased)) AS next_id, (SELECT max(version) + 1 FROM re) AS next_version, (SELECT count(*) FROM re WHERE accepted) AS sequence", mutated=True)
def allocator_state(spark, sf_dir):
    return overlay.allocator_state(resolved(spark, sf_dir), base(spark, sf_dir))


# Graphs. The fixed edges of the relational steps: the 8 nearest rows, with the widest envelope that holds both ends.

EDGES = f"""nn AS (SELECT src, pos, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS pos FROM (SELECT a.id AS src, b.id AS dst, {dist_sql("b.v", "a.v")} AS dist FROM base a JOIN base b ON a.id <> b.id)) WHERE pos < 8),
e AS (SELECT src, dst, 0::BIGINT AS ll, least(src, dst) AS lu, greatest(src, dst) AS rl, (SELECT count(*) - 1 FROM base) AS ru FROM nn)"""
SYMMETRIC = f"{EDGES}, se AS (SELECT src, dst, min(ll) AS ll, max(lu) AS lu, min(rl) AS rl, max(ru) AS ru FROM (SELECT * FROM e UNION ALL SELECT dst, src, ll, lu, rl, ru FROM e) GROUP BY src, dst)"
SUPPORT = f"{SYMMETRIC}, su AS (SELECT *, (lu - ll + 1) * (ru - rl + 1) AS support, ((lu - ll + 1) * (ru - rl + 1)) // (abs(dst - src) + 1) AS score, abs(dst - src) + 1 <= ceil((SELECT count(*) FROM base) / 50) AS protected FROM se)"


def fixed_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = base(spark, sf_dir)
    n = rows.count()
    near = stored(graph.neighbours(rows, 8), "neighbours")  # the steps read them more than once
    return near.select("src", "dst", F.lit(0).cast("long").alias("ll"), F.least("src", "dst").alias("lu"), F.greatest("src", "dst").alias("rl"), F.lit(n - 1).cast("long").alias("ru")), n


@registered(f", {EDGES} SELECT src, pos, dst, dist FROM nn")
def knn_candidates(spark, sf_dir):
    return graph.neighbours(base(spark, sf_dir), 8).select("src", F.col("pos").cast("long").alias("pos"), "dst", "dist")


@registered(f", {SYMMETRIC} SELECT src, dst, ll, lu, rl, ru FROM se")
def edge_symmetrize_merge(spark, sf_dir):
    return graph.symmetrised(fixed_edges(spark, sf_dir)[0])


@registered(f", {SUPPORT} SELECT src, dst, support, score, protected FROM su")
def edge_support(spark, sf_dir):
    edges, n = fixed_edges(spark, sf_dir)
    return graph.supported(graph.symmetrised(edges), n).select("src", "dst", "support", "score", "protected")


@registered(f", {SUPPORT} SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY protected DESC, score DESC, dst) AS nth, count(*) OVER (PARTITION BY src) AS degree FROM su) WHERE nth <= degree - degree // 11")
def edge_prune(spark, sf_dir):
    edges, n = fixed_edges(spark, sf_dir)
    return graph.pruned(graph.symmetrised(edges), n).select("src", "dst")


@registered(f", {SYMMETRIC}, b AS (SELECT count(*) AS n FROM base), qr AS (SELECT qid, qid // 4 AS lo, qid // 4 + n // 2 - 1 AS hi FROM q, b) SELECT qid, src, dst FROM se, qr, b WHERE src BETWEEN lo AND hi AND dst BETWEEN lo AND hi AND (hi - lo + 1 < 0.02 * n OR lo BETWEEN ll AND lu AND hi BETWEEN rl AND ru)")
def edge_eligible(spark, sf_dir):
    edges, n = fixed_edges(spark, sf_dir)
    wanted = queries(spark, sf_dir).select("qid", F.expr("qid div 4").alias("lo"), F.expr(f"qid div 4 + {n // 2 - 1}").alias("hi"))
    return graph.eligible(graph.symmetrised(edges), wanted, n)


@registered(f", {EDGES}, rk AS (SELECT attr, id, row_number() OVER (PARTITION BY attr ORDER BY value, id) - 1 AS rnk FROM vals), b AS (SELECT count(*) AS n FROM base) SELECT src, dst, attr, CASE WHEN attr = 0 THEN ll ELSE 0 END AS low_lo, CASE WHEN attr = 0 THEN lu ELSE rnk END AS low_hi, CASE WHEN attr = 0 THEN rl ELSE rnk END AS high_lo, CASE WHEN attr = 0 THEN ru ELSE n - 1 END AS high_hi FROM e JOIN rk ON rk.id = e.dst, b")
def edge_box(spark, sf_dir):
    edges, n = fixed_edges(spark, sf_dir)
    return graph.edge_boxes(edges, attr_ranks(spark, sf_dir), 0, n)


@registered(f", {SYMMETRIC} SELECT count(DISTINCT src) AS rows, count(*) AS edges, count(*) / count(DISTINCT src) AS avg_deg, count(*) FILTER (WHERE src = dst) AS self_loops, 0::BIGINT AS dup_edges FROM se")
def graph_stats(spark, sf_dir):
    return graph.statistics(graph.symmetrised(fixed_edges(spark, sf_dir)[0]))


@registered()
def knn_descent(spark, sf_dir):
    """Nearest rows of every row by descent over neighbours of neighbours."""
    return knn.descent_neighbours(base(spark, sf_dir), 8)


@registered()
def graph_compress(spark, sf_dir):
    rows = base(spark, sf_dir)
    n = rows.count()
    return graph.compress(graph.neighbours(rows, 32), rows, n)


#: Rows of a shard of the range-aware graphs.
SHARD_ROWS = 20_000
#: Shards over which a table of more rows than these hold is dealt, until they hold SHARD_ROWS each.
SHARDS = 36


def shard_rows(n: int, least: int) -> int:
    """Rows of a shard: ``least``, and so many of a large table that their number does not grow with it, as every query meets every shard; SHARD_ROWS at most."""
    return max(least, min(SHARD_ROWS, -(-n // SHARDS)))


def sharded_graphs(spark: SparkSession, sf_dir: str, indexed: list[int]) -> tuple[DataFrame, DataFrame]:
    nodes = stored(graph.sharded_nodes(base(spark, sf_dir), ATTRIBUTES, indexed, SHARD_ROWS), "nodes")
    return nodes, stored(graph.build_sharded(nodes), "graph")


def routed(spark: SparkSession, sf_dir: str, indexed: list[int]) -> DataFrame:
    wanted = queries(spark, sf_dir)
    return wanted.join(routing.choose_navigation(spans(spark, sf_dir), wanted, indexed).select("qid", "nav_attr"), "qid")


@registered(f", {PROFILES_SQL} SELECT qid, profile, rank, id, dist FROM pexact")
def exact_topk_profiles(spark, sf_dir):
    """Exact rows where every attribute has a range."""
    wanted = fixtures.range_profiles(spark, sf_dir)
    return exact.with_queries(exact.exact_topk(base(spark, sf_dir), wanted, K, ATTRIBUTES), wanted.select("qid", "profile")).select("qid", "profile", "rank", "id", "dist")


#: Sizes of the exploration set whose recall is reported.
REPORTED_EF = (16, 32, 64, 128)


@registered()
def walk_recall(spark, sf_dir):
    """``profile``, ``method``, ``ef``, ``recall`` of walks without scans, where every attribute has a range: rows found of those within the exact k-th distance."""
    rows, wanted = base(spark, sf_dir), fixtures.range_profiles(spark, sf_dir)
    exactly = stored(exact_topk_profiles(spark, sf_dir), "exact")
    nodes, edges = sharded_graphs(spark, sf_dir, [0, 1, 2])
    navigated = wanted.join(routing.choose_navigation(ranks.rank_ranges(ranks.long_form(rows, ATTRIBUTES), wanted).withColumn("active", F.lit(True)), wanted, [0, 1, 2]).select("qid", "nav_attr"), "qid")
    navigated = stored(navigated.select("qid", "qv", "nav_attr", "bounds"), "navigated")
    settings = [(m, e) for m in ("bridge", "hard_prune") for e in REPORTED_EF]
    found = search.walk_each(nodes, edges, navigated, ATTRIBUTES, K, [(e, m == "hard_prune") for m, e in settings], scan_ef=0)
    named = F.get(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(e).alias("ef")) for m, e in settings]), F.col("walk"))
    out = found.select("qid", "dist", named.alias("x")).select("qid", "dist", "x.*")
    limits = exactly.groupBy("qid", "profile").agg(F.max("dist").alias("limit"), F.count("*").alias("want"))
    each = limits.withColumn("x", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(e).alias("ef")) for m, e in settings]))).select("qid", "profile", "limit", "want", "x.*")
    hits = each.join(out, ["qid", "method", "ef"], "left").groupBy("qid", "profile", "method", "ef", "want").agg(F.count_if(F.col("dist") <= F.col("limit")).alias("hit"))
    return hits.groupBy("profile", "method", "ef").agg((F.sum(F.least("hit", "want")) / F.sum("want")).alias("recall"))


def profile_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with their group (``doc``: five rows each), edges, and navigated queries with a range on every attribute."""
    rows, wanted = base(spark, sf_dir).withColumn("doc", F.expr("id div 5")), fixtures.range_profiles(spark, sf_dir)
    nodes = stored(graph.sharded_nodes(rows, ATTRIBUTES, [0, 1, 2], SHARD_ROWS, extra=["doc"]), "nodes")
    edges = stored(graph.build_sharded(nodes), "graph")
    navigated = routing.choose_navigation(ranks.rank_ranges(ranks.long_form(rows, ATTRIBUTES), wanted).withColumn("active", F.lit(True)), wanted, [0, 1, 2]).select("qid", "nav_attr")
    return nodes, edges, stored(wanted.join(navigated, "qid"), "navigated")


@registered()
def graph_top_documents(spark, sf_dir):
    """The nearest documents, of which every fifth row starts one, under ranges on every attribute: walks that count documents."""
    nodes, edges, wanted = profile_graphs(spark, sf_dir)
    return search.top_documents(nodes, edges, wanted, ATTRIBUTES, "doc", K, 64)


@registered()
def graph_within_radius(spark, sf_dir):
    """Rows within a distance under ranges on every attribute: walks that a radius ends."""
    nodes, edges, wanted = profile_graphs(spark, sf_dir)
    return search.within_radius(nodes, edges, wanted, ATTRIBUTES, 1.5, 100, 50)


#: Rows of a shard of the stored index, of small tables: few, so that these give several shards.
INDEX_ROWS = 200


def stored_index(spark: SparkSession, sf_dir: str, least: int = INDEX_ROWS) -> index.Index:
    path, rows = scratch(spark, "index"), base(spark, sf_dir)
    index.build(rows, ATTRIBUTES, [0, 1, 2], path, shard_rows(rows.count(), least))
    return index.Index(spark, path)


@registered()
def index_search(spark, sf_dir):
    """Ranges navigated over a stored index of clustered shards, with the number of shards that each query walks."""
    return stored_index(spark, sf_dir).search(routed(spark, sf_dir, [0, 1, 2]), K, 128)


@registered()
def index_search_hard_prune(spark, sf_dir):
    return stored_index(spark, sf_dir).search(routed(spark, sf_dir, [0, 1, 2]), K, 128, hard_prune=True)


@registered("SELECT q.qid, 0::BIGINT AS outside_n, 0::BIGINT AS only_pruned_n FROM q")
def index_audit(spark, sf_dir):
    """Of each query, results outside its ranges, and results that a walk of all shards does not have."""
    opened, wanted, rows = stored_index(spark, sf_dir), routed(spark, sf_dir, [0, 1, 2]), base(spark, sf_dir)
    found = stored(opened.search(wanted, K, 128).select("qid", "id"), "found")
    every = opened.search(wanted, K, 128, prune=False).select("qid", "id", F.lit(True).alias("all_have"))
    judged = exact.with_queries(found.join(rows.select("id", *ATTRIBUTES), "id"), wanted.select("qid", "bounds")).join(every, ["qid", "id"], "left")
    counts = judged.groupBy("qid").agg(F.count_if(~predicates.in_ranges([F.col(a) for a in ATTRIBUTES], F.col("bounds"))).alias("outside_n"), F.count_if(F.col("all_have").isNull()).alias("only_pruned_n"))
    return wanted.select("qid").join(counts, "qid", "left").na.fill(0)


def _searched(spark: SparkSession, sf_dir: str, indexed: tuple[int, ...] = (0, 1, 2), **how) -> DataFrame:
    nodes, edges = sharded_graphs(spark, sf_dir, list(indexed))
    wanted = routed(spark, sf_dir, list(indexed))
    walked = search.walk_shards(nodes, edges, wanted, ATTRIBUTES, K, 128, scan_ef=0, **how)
    return search.with_fallback(walked, base(spark, sf_dir), wanted, K, ATTRIBUTES)


@registered()
def graph_search_bridge(spark, sf_dir):
    return _searched(spark, sf_dir).select("qid", "rank", "id", "dist")


@registered()
def graph_search_hard_prune(spark, sf_dir):
    return _searched(spark, sf_dir, hard_prune=True).select("qid", "rank", "id", "dist")


@registered()
def graph_search_partial(spark, sf_dir):
    """Attribute 0 alone is indexed: queries that don't constrain it are scanned."""
    return _searched(spark, sf_dir, (0,))


@registered()
def graph_build_static(spark, sf_dir):
    """The graph of attribute 0 with the published settings, stored, read back and checked."""
    rows = base(spark, sf_dir)
    n = rows.count()
    order = stored(attr_ranks(spark, sf_dir), "ranks")
    path = scratch(spark, "static-graph")
    graph.save(graph.build_static(rows, order, 0), path, n, attribute=0, k=16, ef_max=400)
    edges, _ = graph.load(spark, path, n)
    return edges.select("src", "dst", "ll", "lu", "rl", "ru")


@registered(f", {SYMMETRIC} SELECT count(*) FILTER (WHERE src = dst) AS self_loops, 0::BIGINT + count(*) - count(DISTINCT (src, dst)) AS repeated, (SELECT count(*) FROM (SELECT src AS id FROM se UNION ALL SELECT dst FROM se) WHERE id NOT IN (SELECT id FROM base WHERE id % 7 <> 0)) AS dangling, (SELECT count(*) FROM base WHERE id % 7 <> 0 AND id NOT IN (SELECT dst FROM se)) AS unreached FROM se")
def graph_integrity(spark, sf_dir):
    """Counts over the fixed edges and the rows whose id is not divisible by seven, so that some edges dangle."""
    return graph.integrity(graph.symmetrised(fixed_edges(spark, sf_dir)[0]), base(spark, sf_dir).where("id % 7 <> 0"))


@registered()
def hybrid_topk(spark, sf_dir):
    """Each query by the strategy that its number of legal rows chooses."""
    rows, wanted = base(spark, sf_dir), routed(spark, sf_dir, [0, 1, 2])
    nodes, edges = sharded_graphs(spark, sf_dir, [0, 1, 2])
    choices = stored(hybrid_route(spark, sf_dir).select("qid", "choice"), "choices")
    walked = search.walk_shards(nodes, edges, wanted.join(choices.where("choice = 'graph'"), "qid", "left_semi"), ATTRIBUTES, K, 128)
    return search.hybrid(walked, rows, choices, wanted, K, ATTRIBUTES)


def _one_graph(spark: SparkSession, sf_dir: str, bounds: Column, whole: bool) -> DataFrame:
    nodes, edges = sharded_graphs(spark, sf_dir, [0])
    wanted = queries(spark, sf_dir).select("qid", "qv", F.lit(0).alias("nav_attr"), bounds.alias("bounds"))
    return search.walk_shards(nodes, edges, wanted, ATTRIBUTES, K, 128, whole=whole).select("qid", "rank", "id")


@registered()
def graph_search_single_attr(spark, sf_dir):
    """The ranges of attribute 0 alone, by its own graph."""
    open_range = F.struct(F.lit(-1e30).cast("float").alias("low"), F.lit(1e30).cast("float").alias("high"))
    return _one_graph(spark, sf_dir, F.array(F.get("bounds", F.lit(0)), open_range, open_range), False)


@registered()
def insearch_filter(spark, sf_dir):
    """A walk over the whole graph in which only rows that pass all ranges are results."""
    return _one_graph(spark, sf_dir, F.col("bounds"), True)


def layered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = base(spark, sf_dir)
    rows = hnsw.sharded(rows, shard_rows(rows.count(), 500))
    return rows, stored(hnsw.build(rows), "links")


@registered()
def hnsw_topk(spark, sf_dir):
    rows, links = layered(spark, sf_dir)
    return hnsw.search(rows, links, queries(spark, sf_dir), K, 64)


@registered()
def hnsw_insearch(spark, sf_dir):
    rows, links = layered(spark, sf_dir)
    return hnsw.search(rows, links, queries(spark, sf_dir), K, 64, ATTRIBUTES)


@registered()
def hnsw_postfilter(spark, sf_dir):
    """The 64 nearest rows of the index, and of these the nearest that pass."""
    rows, links = layered(spark, sf_dir)
    wanted = queries(spark, sf_dir)
    near = hnsw.search(rows, links, wanted, 64, 128).drop("rank").join(rows.select("id", *ATTRIBUTES), "id")
    judged = exact.with_queries(near, wanted.select("qid", "bounds")).where(predicates.in_ranges([F.col(a) for a in ATTRIBUTES], F.col("bounds")))
    return exact.ranked(judged, K).select("qid", "rank", "id", "dist")


# Evaluation


@registered(f", {POST}, t AS (SELECT qid, count(*) AS n FROM exact GROUP BY qid), h AS (SELECT qid, count(*) AS h FROM post JOIN exact USING (qid, id) GROUP BY qid) SELECT q.qid, CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(h, 0) / least(10, n) END AS recall FROM q LEFT JOIN t USING (qid) LEFT JOIN h USING (qid)")
def recall_at_k(spark, sf_dir):
    wanted = queries(spark, sf_dir)
    return evaluate.recall(postfilter(spark, sf_dir).where("id IS NOT NULL"), exact_topk(spark, sf_dir), wanted, K)


@registered(f""", {POST}, r AS (SELECT qid, max(dist) AS radius, count(*) AS n FROM exact GROUP BY qid), s AS (SELECT qid, count(*) AS strict FROM exact JOIN r USING (qid) WHERE dist < radius GROUP BY qid),
h AS (SELECT qid, count(*) FILTER (WHERE dist < radius) AS hs, count(*) FILTER (WHERE dist = radius) AS hb FROM post JOIN legal USING (qid, id) JOIN r USING (qid) GROUP BY qid)
SELECT q.qid, CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE (least(coalesce(hs, 0), coalesce(strict, 0)) + least(coalesce(hb, 0), n - coalesce(strict, 0))) / n END AS tie_recall,
CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE least(n, coalesce(hs, 0) + coalesce(hb, 0)) / n END AS radius_recall FROM q LEFT JOIN r USING (qid) LEFT JOIN s USING (qid) LEFT JOIN h USING (qid)""")
def boundary_tie_recall(spark, sf_dir):
    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    found = stored(postfilter(spark, sf_dir).where("id IS NOT NULL").select("qid", "id"), "found")
    truth = stored(exact_topk(spark, sf_dir), "exact")
    return evaluate.tie_recall(found, truth, strategies.legal_among(found, rows, wanted, ATTRIBUTES), wanted, K)


@registered(f""", {POST}, c AS (SELECT q.qid, (SELECT count(*) FROM post WHERE post.qid = q.qid) AS valid, (SELECT count(*) FROM legal WHERE legal.qid = q.qid) AS target FROM q)
SELECT 0::BIGINT AS illegal_ids, 0::BIGINT AS illegal, 0::BIGINT AS duplicates, 0::BIGINT AS mismatched, count(*) FILTER (WHERE valid < least(10, target)) AS insufficient, count(*) FILTER (WHERE target = 0 AND valid > 0) AS empty_errors FROM c""")
def result_audit(spark, sf_dir):
    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    found = stored(postfilter(spark, sf_dir).where("id IS NOT NULL").select("qid", "id"), "found")
    legal = stored(strategies.legal_among(found, rows, wanted, ATTRIBUTES), "legal")
    results = found.join(legal, ["qid", "id"], "left").select("qid", "id", "dist")
    return evaluate.audit(results, rows, legal, wanted, K, exact.range_counts(rows, wanted, ATTRIBUTES))


@registered("SELECT 0::BIGINT AS stale_version, 0::BIGINT AS deleted_id, 0::BIGINT AS predicate, 0::BIGINT AS invalid_id, 0::BIGINT AS inserted_invisible, 0::BIGINT AS updated_invisible, 0::BIGINT AS deleted_visible, 0::BIGINT AS duplicate", mutated=True)
def dynamic_audit(spark, sf_dir):
    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    log = stored(resolved(spark, sf_dir), "log")
    live = stored(overlay.live_view(log, rows, ATTRIBUTES), "live")
    results = stored(exact.exact_topk(live, wanted, K, ATTRIBUTES).join(live.select("id", "version"), "id"), "results")
    return evaluate.dynamic_audit(results, live, log, rows, strategies.legal_among(results, live, wanted, ATTRIBUTES))


@registered(", p AS (SELECT event_type AS profile, (event_id % 11) / 10.0::DOUBLE AS recall, value AS ms FROM events) SELECT coalesce(profile, 'total') AS profile, count(*) AS queries, avg(recall) AS mean_recall, avg(ms) AS mean_ms, 1000.0 * count(*) / sum(ms) AS qps FROM p GROUP BY GROUPING SETS ((profile), ())")
def profile_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return evaluate.profile_metrics(rows.select(F.col("event_type").alias("profile"), ((F.col("event_id") % 11) / F.lit(10.0)).alias("recall"), F.col("value").alias("ms")))


@registered("SELECT event_type AS run, count(*) AS n, avg(value) AS mean_ms, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, coalesce(stddev_samp(value), 0) AS std, 1000.0 * count(*) / sum(value) AS qps FROM events GROUP BY event_type")
def latency_pooled(spark, sf_dir):
    return evaluate.pooled_latency(table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("value").alias("ms")))


CURVE = "cu AS (SELECT event_type AS workload, (event_id % 7)::INT AS ef, (event_id % 7) / 7.0::DOUBLE AS recall, max(value) AS mean_ms FROM events GROUP BY event_type, event_id % 7)"


@registered(f", {CURVE} SELECT workload, arg_min(ef, (mean_ms, ef)) AS ef FROM cu WHERE recall >= 0.5 GROUP BY workload")
def operating_point(spark, sf_dir):
    step = (F.col("event_id") % 7).cast("int")
    curve = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("workload"), step.alias("ef")).agg(F.max("value").alias("mean_ms"))
    return evaluate.operating_point(curve.withColumn("recall", F.col("ef") / F.lit(7.0)), 0.5)


@registered("SELECT event_type AS workload, count(*) AS runs, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS least, max(value) AS largest FROM events GROUP BY event_type")
def run_variability(spark, sf_dir):
    return evaluate.variability(table(spark, sf_dir, "events").select(F.col("event_type").alias("workload"), F.col("value").alias("ms")), ["workload"])


# Workloads

CENTRED = """rk AS (SELECT attr, id, row_number() OVER (PARTITION BY attr ORDER BY value, id) - 1 AS rnk FROM vals), nb0 AS (SELECT count(*) AS n FROM base),
pr AS (SELECT unnest([0,0,0,1,1,1,2,2,2,3,3,3]) AS k, unnest(['attr0_narrow','attr0_narrow','attr0_narrow','attr1_narrow','attr1_narrow','attr1_narrow','attr2_narrow','attr2_narrow','attr2_narrow','balanced','balanced','balanced']) AS profile, unnest([0,1,2,0,1,2,0,1,2,0,1,2]) AS attr, unnest([0.1,0.5,0.5,0.5,0.1,0.5,0.5,0.5,0.1,0.3,0.3,0.3])::DOUBLE AS ratio),
ce AS (SELECT id AS qid, profile, attr, rnk, least(greatest(round_even(n * ratio, 0), 1), n)::BIGINT AS width, n FROM rk JOIN pr USING (attr) JOIN nb0 ON true WHERE id % 100 = 0 AND pr.k = id % 4)"""


@registered(f", {CENTRED} SELECT qid, profile, attr, least(greatest(rnk - width // 2, 0), n - width) AS low, least(greatest(rnk - width // 2, 0), n - width) + width - 1 AS high FROM ce")
def centered_ranges(spark, sf_dir):
    n = base(spark, sf_dir).count()
    anchors = attr_ranks(spark, sf_dir).where(F.col("id") % fixtures.QUERY_STEP == 0).select(F.col("id").alias("qid"), "attr", F.col("rnk").alias("value"))
    return workload.centred_ranges(anchors, n, workload.profile_ratios(3))


BUCKETS = [0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64]


@registered()
def static_range_buckets(spark, sf_dir):
    """The nearest rows of each query within each of its seven ranges of positions; places are hashed, which SQL here can't follow."""
    rows = base(spark, sf_dir)
    wanted = queries(spark, sf_dir)
    ranges = workload.static_buckets(wanted, rows.count(), BUCKETS)
    placed = rows.select("id", "v", F.col("id").alias("p"))
    own = ranges.join(wanted.select("qid", "qv"), "qid").select((F.col("qid") * 7 + F.col("bucket")).alias("qid"), "qv", F.array(F.struct(F.col("l").alias("low"), F.col("r").alias("high"))).alias("bounds"), "l", "r")
    near = exact.exact_topk(placed, own.select("qid", "qv", "bounds"), K, ["p"])
    return near.join(own.select("qid", "l", "r"), "qid").select(F.pmod(F.col("qid"), F.lit(7)).cast("int").alias("bucket"), F.expr("qid div 7").alias("qid"), "l", "r", "rank", "id", "dist")


@registered(f""", nb0 AS (SELECT count(*) AS n FROM base), pt AS (SELECT id, v, least(id // greatest(1, n // 4), 3)::INT AS part FROM base, nb0), ps AS (SELECT unnest([0,1,2,3])::INT AS upto)
SELECT upto AS part, qid, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY upto, qid ORDER BY dist, id) AS rank FROM (SELECT upto, q.qid, b.id, {dist_sql()} AS dist FROM pt b JOIN ps ON b.part <= upto, q)) WHERE rank <= 10""")
def incremental_groundtruth(spark, sf_dir):
    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    n = rows.count()
    parted = rows.withColumn("part", workload.part_of(F.col("id"), n, 4).cast("float"))
    steps = [exact.exact_topk(parted, wanted.withColumn("bounds", F.array(F.struct(F.lit(0.0).cast("float").alias("low"), F.lit(float(i)).cast("float").alias("high")))), K, ["part"]).select(F.lit(i).alias("part"), "qid", "rank", "id") for i in range(4)]
    return reduce(DataFrame.unionByName, steps)


@registered(", nb0 AS (SELECT count(*) AS n FROM base), t AS (SELECT 'attr' || attr AS trace, row_number() OVER (PARTITION BY attr ORDER BY value, id) - 1 AS pos, id FROM vals) SELECT trace, pos, id, pos < round_even(n * 0.8, 0) AS is_initial FROM t, nb0")
def insert_traces(spark, sf_dir):
    rows = base(spark, sf_dir)
    return workload.insert_traces(ranks.long_form(rows, ATTRIBUTES), rows.count()).where("trace <> 'unordered'")


@registered()
def unordered_insert_trace(spark, sf_dir):
    """The trace in the order of the ids' crc32, which DuckDB doesn't have."""
    rows = base(spark, sf_dir)
    return workload.insert_traces(ranks.long_form(rows, ATTRIBUTES), rows.count()).where("trace = 'unordered'")


@registered(", s AS (SELECT event_id AS qid, (event_id % 500 + 20)::INT AS length, floor(epoch(ts))::BIGINT AS time, (event_id % 5 + 1)::INT AS star FROM events) SELECT qid, [(length::FLOAT - 30)::FLOAT, (time - 2592000)::FLOAT, ([1,1,2,3,4])[star]::FLOAT] AS lows, [(length::FLOAT + 30)::FLOAT, time::FLOAT, ([2,3,4,5,5])[star]::FLOAT] AS highs FROM s")
def app_style_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), (F.col("event_id") % 500 + 20).cast("int").alias("length"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), (F.col("event_id") % 5 + 1).cast("int").alias("star"))
    return workload.app_filters(rows)


@registered(", s AS (SELECT event_id AS pos, event_id * 3 AS qid FROM events WHERE event_id * 3 IN (SELECT event_id FROM events)) SELECT row_number() OVER (ORDER BY pos) - 1 AS new_qid, qid FROM s")
def query_subset(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return workload.subset(events.select(F.col("event_id").alias("qid")), events.select(F.col("event_id").alias("pos"), (F.col("event_id") * 3).alias("qid")))


@registered("SELECT count(*) AS n, count(DISTINCT id) AS distinct_ids, count(*) FILTER (WHERE a0 IS NULL OR isnan(a0) OR isinf(a0)) AS bad_values, count(DISTINCT len(v)) AS dims FROM base")
def input_validation(spark, sf_dir):
    rows = base(spark, sf_dir)
    overlay.validate_base(rows, ATTRIBUTES)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.count_if(F.col("a0").isNull() | F.isnan("a0") | (F.abs("a0") == float("inf"))).alias("bad_values"), F.count_distinct(F.size("v")).alias("dims"))


# Checked updates, sessions and rebuilds


@registered(""", ch AS (SELECT event_id AS change, event_id % (2 * n) AS id, [event_id % 4, user_id % 3] AS named, [(event_id % 10)::FLOAT, (user_id % 7)::FLOAT] AS x FROM events, nb),
ok AS (SELECT ch.*, b.a0, b.a1, b.a2, b.id IS NOT NULL AND named[1] < 3 AND named[1] <> named[2] AS accepted FROM ch LEFT JOIN base b ON b.id = ch.id)
SELECT change, id, accepted, """ + ", ".join(f"CASE WHEN accepted THEN CASE WHEN named[1] = {i} THEN x[1] WHEN named[2] = {i} THEN x[2] ELSE a{i} END END AS a{i}" for i in range(3)) + " FROM ok", mutated=True)
def partial_updates(spark, sf_dir):
    rows = base(spark, sf_dir)
    n = rows.count()
    pair = lambda at, x: F.struct(at.cast("int").alias("attr"), x.cast("float").alias("value"))
    fields = F.array(pair(F.col("event_id") % 4, F.col("event_id") % 10), pair(F.col("user_id") % 3, F.col("user_id") % 7))
    changes = table(spark, sf_dir, "events").select(F.col("event_id").alias("change"), (F.col("event_id") % (2 * n)).alias("id"), F.lit(None).cast("array<float>").alias("new_v"), fields.alias("fields"))
    return dynamic.field_updates(rows, changes, ATTRIBUTES, ["change"]).drop("v")


@registered("SELECT event_id AS change, event_id % (2 * n) AS id, event_id % (2 * n) < n AS accepted FROM events, nb", mutated=True)
def full_updates(spark, sf_dir):
    rows = base(spark, sf_dir)
    n = rows.count()
    return dynamic.updates(rows, table(spark, sf_dir, "events").select(F.col("event_id").alias("change"), (F.col("event_id") % (2 * n)).alias("id")))


@registered("SELECT (SELECT n FROM nb) AS base_n, (SELECT count(*) FROM de) AS delta_n, (SELECT count(*) FROM la WHERE in_base) AS tombstone_n, (SELECT count(*) FROM live) AS live_n, count(*) AS log_n, count(*) FILTER (WHERE NOT accepted) AS rejected_n, max(version) + 1 AS next_version FROM re", mutated=True)
def overlay_statistics(spark, sf_dir):
    return dynamic.statistics(stored(resolved(spark, sf_dir), "log"), base(spark, sf_dir), ATTRIBUTES)


@registered("SELECT greatest((SELECT max(id) + 1 FROM base), (SELECT max(id) + 1 FROM re WHERE accepted AND NOT erased)) AS next_id, (SELECT max(version) + 1 FROM re) AS next_version, (SELECT count(*) FROM re WHERE accepted) AS sequence, (SELECT max(sequence) FROM re) AS cut, (SELECT count(*) FROM live) AS live_n", mutated=True)
def capture_session(spark, sf_dir):
    """A capture is opened, read and finished."""
    log, rows = stored(resolved(spark, sf_dir), "log"), base(spark, sf_dir)
    own = dynamic.Capture(spark, scratch(spark, "session"))
    token = own.begin(log, rows, ATTRIBUTES)
    state = own.state(token)
    live_n = own.live().count()
    own.finish(token, log, state["cut"])
    return spark.createDataFrame([(state["next_id"], state["next_version"], state["sequence"], state["cut"], live_n)], "next_id long, next_version long, sequence long, cut long, live_n long")


SCENARIO = """sc AS (SELECT id + 1 AS sequence, id + n AS id, 'insert' AS op, a0, a1, a2 FROM base, nb WHERE id < 20 UNION ALL
SELECT (id - n // 2 + n) % n + 21, (id - n // 2 + n) % n, 'attributes', a0, a1, a2 FROM base, nb WHERE (id - n // 2 + n) % n < 30 UNION ALL SELECT id - (n - 10) + 51, id, 'erase', NULL, NULL, NULL FROM base, nb WHERE id >= n - 10)"""


@registered(f", {SCENARIO} SELECT sequence, id, op, a0, a1, a2 FROM sc", mutated=True)
def update_scenario(spark, sf_dir):
    log = dynamic.scenario(base(spark, sf_dir), 20, 30, 10, ATTRIBUTES)
    return log.select("sequence", "id", "op", *[F.get("attrs", F.lit(i)).alias(a) for i, a in enumerate(ATTRIBUTES)])


def _on_base(spark: SparkSession, sf_dir: str, gone: DataFrame, indexed: list[int]) -> DataFrame:
    """What walks on Base find of the rows that are not suppressed; queries without an indexed attribute are scanned."""
    rows, wanted = base(spark, sf_dir).join(gone, "id", "left_anti"), routed(spark, sf_dir, indexed)
    nodes, edges = sharded_graphs(spark, sf_dir, indexed)
    judged = nodes.join(gone.select("id", F.lit(True).alias("gone")), "id", "left")
    walked = search.walk_shards(nodes, edges, wanted, ATTRIBUTES, K, 128, judged=judged)
    return search.with_fallback(walked, rows, wanted, K, ATTRIBUTES).select("qid", "id", "dist")


@registered()
def dynamic_graph_topk(spark, sf_dir):
    """Graphs on Base whose suppressed rows are bridges only, merged with an exact scan of Delta."""
    log, rows = stored(resolved(spark, sf_dir), "log"), base(spark, sf_dir)
    gone = stored(overlay.tombstones(log, rows), "gone")
    live = overlay.live_view(log, rows, ATTRIBUTES)
    return dynamic.dynamic_search(live.where("from_delta"), gone, _on_base(spark, sf_dir, gone, [0, 1, 2]), queries(spark, sf_dir), K, ATTRIBUTES)


@registered()
def rebuilt_topk(spark, sf_dir):
    """The live view as a new Base of dense ids, its graph of attribute 1, walked; results under stable ids."""
    live = stored(overlay.live_view(stored(resolved(spark, sf_dir), "log"), base(spark, sf_dir), ATTRIBUTES), "live")
    rows, mapping = dynamic.rebuilt_base(live, ATTRIBUTES)
    rows, mapping = stored(rows, "rebuilt"), stored(mapping, "mapping")
    nodes = stored(graph.sharded_nodes(rows, ATTRIBUTES, [1], SHARD_ROWS), "nodes")
    edges = stored(graph.build_sharded(nodes), "graph")
    wanted = routed(spark, sf_dir, [1])
    found = search.with_fallback(search.walk_shards(nodes, edges, wanted, ATTRIBUTES, K, 128), rows, wanted, K, ATTRIBUTES)
    return dynamic.with_stable_ids(found.select("qid", "rank", "id", "dist"), mapping, K).select("qid", "rank", "id", "dist")


# Audits over results with planted faults, of which every counter has some

FAULTS = """w AS (SELECT e.qid, CASE WHEN rank = 2 THEN e.id + 1000000000 ELSE e.id END AS id, CASE WHEN rank = 1 THEN dist + 1 ELSE dist END AS dist FROM exact e WHERE rank <> 4
  UNION ALL SELECT qid, id, dist FROM exact WHERE rank = 3 UNION ALL SELECT q.qid, b.id, 0.5::DOUBLE FROM q JOIN base b ON b.id = q.qid + 1)"""


@registered(f""", {FAULTS}, j AS (SELECT w.*, b.id IS NOT NULL AS known, l.dist AS true_dist FROM w LEFT JOIN base b ON b.id = w.id LEFT JOIN legal l ON l.qid = w.qid AND l.id = w.id),
v AS (SELECT q.qid, (SELECT count(DISTINCT j.id) FROM j WHERE j.qid = q.qid AND true_dist IS NOT NULL) AS valid, (SELECT count(*) FROM j WHERE j.qid = q.qid) AS returned, (SELECT count(*) FROM legal l WHERE l.qid = q.qid) AS target FROM q)
SELECT (SELECT count(*) FROM j WHERE NOT known) AS illegal_ids, (SELECT count(*) FROM j WHERE known AND true_dist IS NULL) AS illegal, (SELECT count(*) - count(DISTINCT (qid, id)) FROM j) AS duplicates,
(SELECT count(*) FROM j WHERE abs(dist - true_dist) > 1e-5 + 2e-5 * abs(true_dist)) AS mismatched, (SELECT count(*) FROM v WHERE valid < least(10, target)) AS insufficient, (SELECT count(*) FROM v WHERE target = 0 AND returned > 0) AS empty_errors""")
def result_audit_faults(spark, sf_dir):
    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    found = stored(exact_topk(spark, sf_dir), "exact")
    moved = found.where("rank <> 4").select("qid", F.when(F.col("rank") == 2, F.col("id") + 1_000_000_000).otherwise(F.col("id")).alias("id"), F.when(F.col("rank") == 1, F.col("dist") + 1).otherwise(F.col("dist")).alias("dist"))
    planted = wanted.select("qid", (F.col("qid") + 1).alias("id"), F.lit(0.5).alias("dist")).join(rows.select("id"), "id", "left_semi").select("qid", "id", "dist")
    faulty = moved.unionByName(found.where("rank = 3").select("qid", "id", "dist")).unionByName(planted)
    return evaluate.audit(faulty, rows, stored(strategies.legal_among(faulty, rows, wanted, ATTRIBUTES), "legal"), wanted, K, exact.range_counts(rows, wanted, ATTRIBUTES))


@registered(""", lost AS (SELECT id, version FROM live WHERE id % 5 <> 0), w AS (SELECT qid, id, CASE WHEN rank = 1 THEN version + 1 ELSE version END AS version FROM dtop UNION ALL SELECT qid, id, version FROM dtop WHERE rank = 2
  UNION ALL SELECT qid, qid + 5000000000, 0 FROM q UNION ALL SELECT q.qid, d.id, 0 FROM q, (SELECT min(id) AS id FROM la WHERE erased) d),
lo AS (SELECT id, op AS last_op, erased AS gone FROM la), j AS (SELECT w.*, lost.version AS live_version, lost.id IS NOT NULL AS alive, last_op, gone, b.id IS NOT NULL AS in_base, dl.id IS NOT NULL AS ok
  FROM w LEFT JOIN lost ON lost.id = w.id LEFT JOIN lo ON lo.id = w.id LEFT JOIN base b ON b.id = w.id LEFT JOIN dlegal dl ON dl.qid = w.qid AND dl.id = w.id)
SELECT count(*) FILTER (WHERE alive AND version <> live_version) AS stale_version, count(*) FILTER (WHERE coalesce(gone, false)) AS deleted_id, count(*) FILTER (WHERE alive AND NOT ok) AS predicate, count(*) FILTER (WHERE NOT in_base AND last_op IS NULL) AS invalid_id,
count(*) FILTER (WHERE last_op = 'insert' AND NOT alive) AS inserted_invisible, count(*) FILTER (WHERE last_op IN ('upsert', 'attributes') AND NOT alive) AS updated_invisible, count(*) FILTER (WHERE last_op = 'erase' AND alive) AS deleted_visible,
count(*) - count(DISTINCT (qid, id)) AS duplicate FROM j""", mutated=True)
def dynamic_audit_faults(spark, sf_dir):
    """Results with stale versions, repeated, deleted and unknown ids, against a view that lacks every fifth row."""
    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    log = stored(resolved(spark, sf_dir), "log")
    live = stored(overlay.live_view(log, rows, ATTRIBUTES), "live")
    near = stored(exact.exact_topk(live, wanted, K, ATTRIBUTES).join(live.select("id", "version"), "id"), "near")
    erased = overlay.last_images(log).where("erased").agg(F.min("id").alias("id"))
    faulty = near.select("qid", "id", F.when(F.col("rank") == 1, F.col("version") + 1).otherwise(F.col("version")).alias("version")).unionByName(near.where("rank = 2").select("qid", "id", "version"))
    faulty = faulty.unionByName(wanted.select("qid", (F.col("qid") + 5_000_000_000).alias("id"), F.lit(0).cast("long").alias("version")))
    faulty = faulty.unionByName(wanted.select("qid").crossJoin(F.broadcast(erased)).select("qid", "id", F.lit(0).cast("long").alias("version")))
    return evaluate.dynamic_audit(faulty, live.where("id % 5 <> 0"), log, rows, strategies.legal_among(faulty, live, wanted, ATTRIBUTES))


@registered(", lost AS (SELECT id, version, a0, a1, a2 FROM live WHERE id % 5 <> 0), new AS (SELECT id, CASE WHEN id % 7 = 0 THEN version + 1 ELSE version END AS version, a0, a1, a2 FROM live) SELECT (SELECT count(*) FROM (SELECT * FROM lost EXCEPT ALL SELECT * FROM new)) AS only_old_n, (SELECT count(*) FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM lost)) AS only_new_n", mutated=True)
def replay_differences(spark, sf_dir):
    """Two views that differ: one lacks rows, the other has changed versions."""
    live = stored(overlay.live_view(resolved(spark, sf_dir), base(spark, sf_dir), ATTRIBUTES).select("id", "version", *ATTRIBUTES), "live")
    old, new = live.where("id % 5 <> 0"), live.withColumn("version", F.when(F.col("id") % 7 == 0, F.col("version") + 1).otherwise(F.col("version")))
    return old.exceptAll(new).agg(F.count("*").alias("only_old_n")).crossJoin(new.exceptAll(old).agg(F.count("*").alias("only_new_n")))


# More evaluation


@registered(f""", {POST} SELECT q.qid, coalesce(g, 0) < 10 AND coalesce(b, 0) >= 10 AS of_graph, coalesce(g, 0) < 10 AS of_index, coalesce(g, 0) < least(10, coalesce(n, 0)) AS of_evaluator
FROM q LEFT JOIN (SELECT qid, count(*) AS g FROM post GROUP BY qid) USING (qid) LEFT JOIN (SELECT qid, count(*) AS b FROM exact GROUP BY qid) USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM legal GROUP BY qid) USING (qid)""")
def insufficient_queries(spark, sf_dir):
    rows, wanted = base(spark, sf_dir), queries(spark, sf_dir)
    return evaluate.insufficient(postfilter(spark, sf_dir).where("id IS NOT NULL"), exact_topk(spark, sf_dir), strategies.legal_counts(rows, wanted, ATTRIBUTES), wanted, K)


@registered(", p AS (SELECT event_type AS profile, (event_id % 11) / 10.0::DOUBLE AS recall, value AS ms, event_id % 50 AS hops, event_id % 900 AS distances, event_id % 70 AS pruned, event_id % 13 = 0 AS insufficient FROM events) SELECT coalesce(profile, 'total') AS profile, count(*) AS queries, avg(recall) AS mean_recall, avg(ms) AS mean_ms, 1000.0 * count(*) / sum(ms) AS qps, avg(hops) AS mean_hops, avg(distances) AS mean_distances, avg(pruned) AS mean_pruned, count(*) FILTER (WHERE insufficient) AS insufficient FROM p GROUP BY GROUPING SETS ((profile), ())")
def work_metrics(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("profile"), ((e % 11) / F.lit(10.0)).alias("recall"), F.col("value").alias("ms"), (e % 50).alias("hops"), (e % 900).alias("distances"), (e % 70).alias("pruned"), (e % 13 == 0).alias("insufficient"))
    return evaluate.work_metrics(rows)


RUNS = "ru AS (SELECT event_type AS mode, (event_id % 3)::INT AS ef, (event_id % 5)::INT AS run, count(*) AS queries, avg(event_id % 11) / 10 AS recall, avg(value) AS ms, avg(event_id % 50) AS hops, avg(event_id % 900) AS distances, avg(event_id % 70) AS pruned, count(*) FILTER (WHERE event_id % 13 = 0) AS insufficient FROM events GROUP BY ALL)"


def measured_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    keys = F.col("event_type").alias("mode"), (e % 3).cast("int").alias("ef"), (e % 5).cast("int").alias("run")
    return table(spark, sf_dir, "events").groupBy(*keys).agg(F.count("*").alias("queries"), (F.avg(e % 11) / 10).alias("recall"), F.avg("value").alias("ms"), F.avg(e % 50).alias("hops"), F.avg(e % 900).alias("distances"), F.avg(e % 70).alias("pruned"), F.count_if(e % 13 == 0).alias("insufficient"))


def _pooled_sql(c: str) -> str:
    return f"sum({c} * queries) / sum(queries) AS {c}"


@registered(f", {RUNS} SELECT mode, ef, count(*) AS runs, sum(queries)::BIGINT AS queries, {_pooled_sql('recall')}, {_pooled_sql('ms')}, coalesce(stddev_samp(ms), 0) AS ms_std, 1000.0 * sum(queries) / sum(ms * queries) AS qps, {_pooled_sql('hops')}, {_pooled_sql('distances')}, {_pooled_sql('pruned')}, max(insufficient) AS insufficient FROM ru GROUP BY mode, ef")
def ablation_summary(spark, sf_dir):
    return summaries.ablation(measured_runs(spark, sf_dir))


@registered(f", {RUNS} SELECT mode, sum(queries * ms) / sum(queries) AS ms, sum(queries)::BIGINT AS queries FROM ru GROUP BY mode")
def pooled_runs(spark, sf_dir):
    return evaluate.weighted_mean(measured_runs(spark, sf_dir), ["mode"], "ms", "queries").withColumn("queries", F.col("queries").cast("long"))


@registered(", va AS (SELECT event_type AS variant, 'm' || (event_id % 3) AS metric, (event_id % 5)::INT AS run, max(value) AS value FROM events WHERE NOT (event_type = 'view' AND event_id % 15 = 7) GROUP BY ALL), c2 AS (SELECT variant, metric FROM (SELECT unnest(['view', 'click', 'none']) AS variant), (SELECT unnest(['m0', 'm1', 'm2']) AS metric)) SELECT c2.variant, c2.metric, count(va.run) AS runs, avg(value) AS mean, CASE WHEN count(va.run) > 0 THEN coalesce(stddev_samp(value), 0) END AS std, min(value) AS least, max(value) AS largest, coalesce(list(run ORDER BY run) FILTER (WHERE run IS NOT NULL) = (SELECT list(DISTINCT run ORDER BY run) FROM va), false) AS complete FROM c2 LEFT JOIN va USING (variant, metric) GROUP BY c2.variant, c2.metric")
def replay_runs(spark, sf_dir):
    e = F.col("event_id")
    kept = table(spark, sf_dir, "events").where(~((F.col("event_type") == "view") & (e % 15 == 7)))
    values = kept.groupBy(F.col("event_type").alias("variant"), F.concat(F.lit("m"), (e % 3).cast("string")).alias("metric"), (e % 5).cast("int").alias("run")).agg(F.max("value").alias("value"))
    return summaries.replay_summary(values, ["view", "click", "none"], ["m0", "m1", "m2"])


@registered("SELECT 1::BIGINT AS missing_columns, (SELECT count(*) - count(DISTINCT (event_type, user_id)) FROM events) AS repeated_keys, 0::BIGINT + (SELECT count(*) FROM events WHERE event_type IS NULL OR user_id IS NULL) AS null_keys, (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1)) AS clashing_sources")
def evidence_audit(spark, sf_dir):
    return summaries.evidence_checks(table(spark, sf_dir, "events"), ["event_type", "user_id", "absent"], ["event_type", "user_id"], "user_id", "event_type")


@registered(f", {CURVE}, pt AS (SELECT 'w' || (ef % 2) AS workload, workload AS method, ef, recall, mean_ms AS ms FROM cu), be AS (SELECT workload, method, min(ms) AS ms FROM pt WHERE recall >= 0.3 GROUP BY ALL) SELECT workload, o.ms, x.method AS other, x.ms AS other_ms, x.ms / o.ms AS speedup FROM (SELECT workload, ms FROM be WHERE method = 'view') o FULL JOIN (SELECT workload, arg_min(method, (ms, method)) AS method, min(ms) AS ms FROM be WHERE method <> 'view' GROUP BY workload) x USING (workload)")
def method_comparison(spark, sf_dir):
    step = (F.col("event_id") % 7).cast("int")
    curve = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method"), step.alias("ef")).agg(F.max("value").alias("ms"))
    points = curve.select(F.concat(F.lit("w"), (F.col("ef") % 2).cast("string")).alias("workload"), "method", "ef", (F.col("ef") / F.lit(7.0)).alias("recall"), "ms")
    return summaries.key_comparison(points, "view", 0.3)


# More search and workloads


@registered(f"SELECT qid, label, best_dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best_dist, label) AS rank FROM (SELECT q.qid, b.label, min(1.0 - list_sum(list_transform(list_zip(b.v, q.qv), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))) AS best_dist FROM base b, q GROUP BY q.qid, b.label)) WHERE rank <= 3")
def multivector_inner_product(spark, sf_dir):
    return exact.top_groups(base(spark, sf_dir), queries(spark, sf_dir), "label", 3, inner=True)


@registered("SELECT id, v FROM base WHERE id IN (3, 41, 100, 999999)")
def vectors_of_ids(spark, sf_dir):
    return exact.by_id(base(spark, sf_dir), [3, 41, 100, 999_999]).select("id", "v")


@registered("SELECT id, a1 FROM base WHERE a1 BETWEEN 5 AND 9")
def rank_ordered_slice(spark, sf_dir):
    """Rows laid out in the order of an attribute, of which a range is read."""
    path = scratch(spark, "rank-ordered")
    ranks.rank_ordered(base(spark, sf_dir).select("id", "v", "a1"), "a1").write.parquet(path)
    return strategies.sliced_files(spark, path, "a1", 5, 9).select("id", "a1")


@registered(f", {CENTRED} SELECT qid, profile, attr, CASE WHEN qid % 5 <> 0 OR attr = (qid // 5) % 3 THEN least(greatest(rnk - width // 2, 0), n - width) ELSE 0 END AS low, CASE WHEN qid % 5 <> 0 OR attr = (qid // 5) % 3 THEN least(greatest(rnk - width // 2, 0), n - width) + width - 1 ELSE n - 1 END AS high FROM ce")
def single_attribute_ranges(spark, sf_dir):
    return workload.single_attribute_queries(centered_ranges(spark, sf_dir), base(spark, sf_dir).count())


@registered(""", rk AS (SELECT id, row_number() OVER (ORDER BY value, id) - 1 AS rnk FROM vals WHERE attr = 0), nb0 AS (SELECT count(*) AS n FROM base), sh AS (SELECT unnest(range(8)) AS k, unnest([0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5])::DOUBLE AS share),
ce AS (SELECT id AS qid, 'sel_' || share AS profile, rnk, least(greatest(round_even(n * share ** (1 / 3.0::DOUBLE), 0), 1), n)::BIGINT AS width, n FROM rk JOIN nb0 ON true JOIN sh ON sh.k = id % 8 WHERE id % 100 = 0)
SELECT qid, profile, a.attr, least(greatest(rnk - width // 2, 0), n - width) AS low, least(greatest(rnk - width // 2, 0), n - width) + width - 1 AS high FROM ce, (SELECT unnest([0, 1, 2]) AS attr) a""")
def selectivity_profiles(spark, sf_dir):
    """Eight total selectivities, around one anchor for all attributes."""
    anchors = attr_ranks(spark, sf_dir).where(F.col("id") % fixtures.QUERY_STEP == 0).select(F.col("id").alias("qid"), "attr", F.col("rnk").alias("value"))
    return workload.centred_ranges(anchors, base(spark, sf_dir).count(), workload.selectivity_ratios(3, list(workload.SELECTIVITIES)), one_anchor=True)


@registered("SELECT id, (id // ceil((SELECT count(*) FROM base) / 4)::BIGINT)::INT AS part FROM base")
def parts_of_rows(spark, sf_dir):
    rows = base(spark, sf_dir).select("id")
    return workload.split_parts(rows, rows.count(), 4, "id")


@registered()
def independent_attributes(spark, sf_dir):
    return workload.independent_attributes(base(spark, sf_dir), 3)


@registered()
def mixed_attributes(spark, sf_dir):
    rows = base(spark, sf_dir)
    return workload.mixed_attributes(rows.select("id", vectors.squared_norm(F.col("v")).alias("norm2"), vectors.signed_projection(F.col("v")).alias("proj")), 3)


@registered()
def noisy_queries(spark, sf_dir):
    return workload.noisy_queries(queries(spark, sf_dir).select("qid", F.col("qv").alias("v")))


@registered("SELECT 0 AS qid, 'empty' AS profile, 0::BIGINT AS n UNION ALL SELECT 1, 'equality', (SELECT count(*) FROM base WHERE a0 = 3) UNION ALL SELECT 2, 'infinite', (SELECT count(*) FROM base) UNION ALL SELECT 3, 'high_cardinality', (SELECT count(*) FROM base WHERE a0 >= -1)")
def smoke_workload(spark, sf_dir):
    wanted = workload.smoke_ranges(spark, 3)
    return wanted.select("qid", "profile").join(strategies.legal_counts(base(spark, sf_dir), wanted, ATTRIBUTES), "qid").select("qid", "profile", F.col("legal_n").alias("n"))


@registered()
def hnsw_epsilon(spark, sf_dir):
    """Rows that walks find within a squared distance of 1.5, the 50 nearest."""
    rows, links = layered(spark, sf_dir)
    return hnsw.within(rows, links, queries(spark, sf_dir), 1.5, 200, 50)


@registered()
def hnsw_updated(spark, sf_dir):
    """The index after every eleventh row was taken out, without a rebuild of the shards it was in, and then with one of shard 0."""
    rows, links = layered(spark, sf_dir)
    left = hnsw.unmarked(rows, rows.where("id % 11 = 5"))
    return hnsw.search(left, hnsw.updated(left, links, rows.where("shard = 0")), queries(spark, sf_dir), K, 64)

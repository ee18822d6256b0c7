"""Search fixtures over the test tables: rows, stated queries, ranges and mutations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions.predicates import float_bounds
from veldra.operators.overlay import resolve
from veldra.operators.ranks import running_totals

ATTRIBUTES = ["a0", "a1", "a2"]
#: Queries are the rows whose id is divisible by this.
QUERY_STEP = 100
WIDE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attribute_columns(key: str) -> list:
    return [(F.col(key) * 7 % 23).cast("float").alias("a1"), (F.col(key) * 13 % 31).cast("float").alias("a2")]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``v``, ``label`` and three float attributes of every embedding."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), "label", F.col("label").cast("float").alias("a0"), *_attribute_columns("vec_id"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid``, ``qv``, ``profile``, ``primary_attr``, ``bounds``: one attribute in turn is narrow."""
    own = base(spark, sf_dir).where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.expr(f"id div {QUERY_STEP}").alias("i"))
    turn, low, high = F.col("i") % 3, F.lit(-WIDE), F.lit(WIDE)
    starts = [F.col("i") % 5, F.col("i") % 7, F.col("i") % 7]
    widths = [4, 5, 5]
    bounds = float_bounds([(F.when(turn == a, s).otherwise(low), F.when(turn == a, s + w).otherwise(high)) for a, (s, w) in enumerate(zip(starts, widths))])
    return own.select("qid", "qv", F.concat(F.lit("p"), turn.cast("string")).alias("profile"), turn.cast("int").alias("primary_attr"), bounds.alias("bounds"), F.array(*[turn == a for a in range(3)]).alias("active"))


#: Half widths of the ranges around a query's own values: of all attributes alike, and of one narrow attribute and wide others.
BALANCED, NARROW, WIDER = (2, 6, 8), (1, 2, 3), (5, 12, 16)


def range_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid``, ``qv``, ``profile``, ``bounds``: every attribute of a query has a range around the query row's own value.

    Profiles by turn: ``balanced``, and ``narrow0`` to ``narrow2``, of which the named attribute alone is narrow.
    """
    own = base(spark, sf_dir).where(F.col("id") % QUERY_STEP == 0).withColumn("turn", F.expr(f"id div {QUERY_STEP}") % 4)
    width = lambda a: F.when(F.col("turn") == 0, BALANCED[a]).when(F.col("turn") == a + 1, NARROW[a]).otherwise(WIDER[a])
    bounds = float_bounds([(F.col(name) - width(a), F.col(name) + width(a)) for a, name in enumerate(ATTRIBUTES)])
    profile = F.when(F.col("turn") == 0, "balanced").otherwise(F.concat(F.lit("narrow"), (F.col("turn") - 1).cast("string")))
    return own.select(F.col("id").alias("qid"), F.col("v").alias("qv"), profile.alias("profile"), bounds.alias("bounds"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sequence`` (from 1), ``id``, ``op``, ``v``, ``attrs`` from all events but views, in the order of time."""
    rows = base(spark, sf_dir).select("id", "v")
    n = rows.count()
    ops = F.create_map(*[F.lit(x) for x in ("signup", "insert", "purchase", "upsert", "error", "erase", "click", "attributes")])
    events = table(spark, sf_dir, "events").where("event_type <> 'view'").select("ts", "event_id", "user_id", ops[F.col("event_type")].alias("op"))
    numbered = running_totals(events, ["ts", "event_id"], {"sequence": F.lit(1).cast("long"), "nth": (F.col("op") == "insert").cast("long")})
    targeted = numbered.withColumn("id", F.when(F.col("op") == "insert", F.col("nth") - 1 + n).otherwise(F.col("user_id").cast("long")))
    attrs = F.array((F.col("event_id") % 10).cast("float"), *_attribute_columns("event_id"))
    images = targeted.join(rows.select(F.col("id").alias("source"), "v"), F.col("event_id") % n == F.col("source"), "left")
    full = F.col("op").isin("insert", "upsert")
    return images.select("sequence", "id", "op", F.when(full, F.col("v")).alias("v"), F.when(F.col("op") != "erase", attrs).alias("attrs"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(mutations(spark, sf_dir), base(spark, sf_dir))


DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


def dist_sql(a: str = "b.v", b: str = "q.qv") -> str:
    return DIST.format(a=a, b=b)


WITH_SQL = f"""
base AS (SELECT vec_id::BIGINT AS id, embedding AS v, label, label::FLOAT AS a0, ((vec_id * 7) % 23)::FLOAT AS a1, ((vec_id * 13) % 31)::FLOAT AS a2 FROM embeddings),
qi AS (SELECT id AS qid, v AS qv, id // {QUERY_STEP} AS i FROM base WHERE id % {QUERY_STEP} = 0),
q AS (SELECT qid, qv, 'p' || (i % 3) AS profile, (i % 3)::INT AS primary_attr,
  CASE WHEN i % 3 = 0 THEN i % 5 ELSE -1000 END::FLOAT AS l0, CASE WHEN i % 3 = 0 THEN i % 5 + 4 ELSE 1000 END::FLOAT AS h0,
  CASE WHEN i % 3 = 1 THEN i % 7 ELSE -1000 END::FLOAT AS l1, CASE WHEN i % 3 = 1 THEN i % 7 + 5 ELSE 1000 END::FLOAT AS h1,
  CASE WHEN i % 3 = 2 THEN i % 7 ELSE -1000 END::FLOAT AS l2, CASE WHEN i % 3 = 2 THEN i % 7 + 5 ELSE 1000 END::FLOAT AS h2 FROM qi),
vals AS (SELECT 0 AS attr, id, a0 AS value FROM base UNION ALL SELECT 1, id, a1 FROM base UNION ALL SELECT 2, id, a2 FROM base),
fr AS (SELECT qid, 0 AS attr, l0 AS low, h0 AS high, profile, primary_attr FROM q UNION ALL SELECT qid, 1, l1, h1, profile, primary_attr FROM q UNION ALL SELECT qid, 2, l2, h2, profile, primary_attr FROM q),
legal AS (SELECT q.qid, b.id, {DIST.format(a="b.v", b="q.qv")} AS dist FROM base b JOIN q ON a0 BETWEEN l0 AND h0 AND a1 BETWEEN l1 AND h1 AND a2 BETWEEN l2 AND h2),
exact AS (SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM legal) WHERE rank <= 10),
rr AS (SELECT qid, attr, CASE WHEN lo > hi THEN 1 ELSE lo END AS lo, CASE WHEN lo > hi THEN 0 ELSE hi END AS hi FROM
  (SELECT fr.qid, fr.attr, count(*) FILTER (WHERE value < low) AS lo, count(*) FILTER (WHERE value <= high) - 1 AS hi FROM fr JOIN vals USING (attr) GROUP BY fr.qid, fr.attr)),
spans AS (SELECT rr.*, greatest(hi - lo + 1, 0) AS span, attr = primary_attr AS active FROM rr JOIN q USING (qid))
"""

_HALF = ["CASE turn WHEN 0 THEN {} WHEN {} THEN {} ELSE {} END".format(BALANCED[a], a + 1, NARROW[a], WIDER[a]) for a in range(3)]
#: The exact rows of ``range_profiles``: pexact.
PROFILES_SQL = f"""
pq AS (SELECT id AS qid, v AS qv, a0, a1, a2, CASE turn WHEN 0 THEN 'balanced' ELSE 'narrow' || (turn - 1) END AS profile, {", ".join(f"{h} AS w{a}" for a, h in enumerate(_HALF))}
  FROM (SELECT *, (id // {QUERY_STEP}) % 4 AS turn FROM base WHERE id % {QUERY_STEP} = 0)),
plegal AS (SELECT q.qid, q.profile, b.id, {DIST.format(a="b.v", b="q.qv")} AS dist FROM base b JOIN pq q ON {" AND ".join(f"b.a{a} BETWEEN q.a{a} - w{a} AND q.a{a} + w{a}" for a in range(3))}),
pexact AS (SELECT qid, profile, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM plegal) WHERE rank <= 10)
"""

MUTATIONS_SQL = """
nb AS (SELECT count(*) AS n FROM base),
ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS sequence, event_id, user_id,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'upsert' WHEN 'error' THEN 'erase' ELSE 'attributes' END AS op FROM events WHERE event_type <> 'view'),
mu AS (SELECT sequence, event_id, op, CASE WHEN op = 'insert' THEN n + count(*) FILTER (WHERE op = 'insert') OVER (ORDER BY sequence) - 1 ELSE user_id END::BIGINT AS id FROM ev, nb),
ju AS (SELECT mu.*, b.id IS NOT NULL AS in_base, last_value(CASE WHEN op <> 'attributes' THEN op END IGNORE NULLS) OVER (PARTITION BY mu.id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_op,
  last_value(CASE WHEN op IN ('insert', 'upsert') THEN event_id END IGNORE NULLS) OVER (PARTITION BY mu.id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v_event FROM mu LEFT JOIN base b ON mu.id = b.id),
ac AS (SELECT *, (op <> 'attributes' OR CASE WHEN last_op IS NULL THEN in_base ELSE last_op <> 'erase' END) AS accepted, op = 'erase' AS erased FROM ju),
re AS (SELECT sequence, id, op, event_id, v_event, in_base, accepted, erased, CASE WHEN accepted AND NOT erased THEN count(*) FILTER (WHERE accepted AND NOT erased) OVER (ORDER BY sequence) END AS version FROM ac),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence DESC) AS rn FROM re WHERE accepted) WHERE rn = 1),
de AS (SELECT la.id, coalesce(s.v, o.v) AS v, (event_id % 10)::FLOAT AS a0, ((event_id * 7) % 23)::FLOAT AS a1, ((event_id * 13) % 31)::FLOAT AS a2, version
  FROM la JOIN nb ON true LEFT JOIN base s ON s.id = v_event % n LEFT JOIN base o ON o.id = la.id WHERE NOT erased),
live AS (SELECT id, v, a0, a1, a2, 0::BIGINT AS version, false AS from_delta FROM base WHERE id NOT IN (SELECT id FROM la) UNION ALL SELECT id, v, a0, a1, a2, version, true FROM de),
dlegal AS (SELECT q.qid, b.id, version, from_delta, list_sum(list_transform(list_zip(b.v, q.qv), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS dist FROM live b JOIN q ON a0 BETWEEN l0 AND h0 AND a1 BETWEEN l1 AND h1 AND a2 BETWEEN l2 AND h2),
dtop AS (SELECT qid, rank, id, dist, version, from_delta FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM dlegal) WHERE rank <= 10)
"""

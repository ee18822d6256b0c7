"""SimHash near-duplicate detection with the generalised pigeonhole principle.

Fingerprints link at ``radius`` or fewer differing bits. The 64 bits are
grouped into m parts, correlated bits together, and a threshold t_i is dealt to
each part with sum(t_i) = radius - m + 1: whatever way the differing bits fall,
two linked fingerprints differ in at most t_i bits of some part i (a part of
threshold -1 is never probed). Grouping and thresholds come from statistics of
all fingerprints: dynamic programming takes the allocation with the fewest
estimated candidates and probes.

A part of threshold t is probed by masking out every choice of t of its bits;
fingerprints with the same masked value share a bucket and are verified there.
A bucket leaves a star over each of its linked sets, never all pairs. A bucket
of more than ``BUCKET`` fingerprints is dealt out again by the same principle
over the bits that its members need not share. Each such step fixes at least a
third of these bits, and distinct fingerprints that share all but 10 bits are
at most 1,024, so every bucket ends within the bound, exactly.

Copies fold into their distinct fingerprint before any of this, and components
are found among distinct fingerprints by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.llm.common import id_text, text_chunks, text_hash
from veldra.session import Scratch, ship_package, stored

#: Distinct fingerprints that one bucket may hold before it is dealt out again.
BUCKET = 1024
#: A bucket whose members may differ in this many bits at most is never dealt out again: it has 2 to this power members at most.
FREE_BITS = 10
#: Numbers of parts among which the plan is chosen.
PARTS = (2, 3, 4)
#: Estimated work of making and shuffling a probe, in verified candidate pairs.
PROBE_COST = 4.0


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends - 1)[-n:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id``, ``hash`` (of the text) and ``fp`` (the fingerprint's bits as a signed long) of every row. Null and empty texts have fingerprint 0."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            found = np.array([fingerprint(t, width) for t in chunk.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("hash"), pa.array(found.view(np.int64))], ["doc_id", "hash", "fp"])

    rows = id_text(docs, id_col, text_col)
    return rows.select("doc_id", text_hash(F.col("text")).alias("hash"), "text").mapInArrow(kernel, "doc_id long, hash long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for all pairs of bits, in how many both are set: at most 2,081 numbers."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64), dtype=np.int64), 0
        for batch in batches:
            values = np.asarray(batch.column("fp"), dtype=np.int64)
            for at in range(0, len(values), 8192):
                bits = np.unpackbits(np.ascontiguousarray(values[at : at + 8192]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(values)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), -1], pa.int32()), pa.array([*j.tolist(), -1], pa.int32()), pa.array([*both[i, j].tolist(), n], pa.int64())], ["i", "j", "n"])

    both, total = np.zeros((64, 64)), 0
    for i, j, n in distinct.select("fp").mapInArrow(kernel, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if i < 0:
            total = n
        else:
            both[i, j] = both[j, i] = n
    return total, both


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of about 64 / ``parts`` bits; each grows by the bit that is most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    strength = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(strength, 0)
    free, groups = set(range(64)), []
    for k in range(parts):
        want = (64 - sum(map(len, groups))) // (parts - k)
        own = [min(free, key=lambda b: (-max((strength[b, c] for c in free), default=0), b))]
        free -= {*own}
        while len(own) < want:
            best = min(free, key=lambda b: (-strength[b, own].sum(), b))
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds with the given sum and the least summed cost, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in own.items():
                if spent + t not in step or cost + c < step[spent + t][0]:
                    step[spent + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def plan_masks(distinct: DataFrame, radius: int) -> list[int]:
    """The bit masks whose values are the buckets: for each part, one for every choice of its masked bits."""
    n, both = bit_statistics(distinct)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    ratio = differ / np.maximum(1 - differ, 1e-9)
    layouts = {m: group_bits(both, n, m) for m in PARTS}
    masks = [(m, k, sum(1 << b for b in part)) for m, parts in layouts.items() for k, part in enumerate(parts)]
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v")) for m, k, mask in masks]))
    counts = distinct.select(keys.alias("x")).select("x.*").groupBy("m", "k", "v").agg(F.count("*").alias("c"))
    same = {(m, k): x for m, k, x in counts.groupBy("m", "k").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("x")).collect()}
    choices = []
    for m, parts in layouts.items():
        costs = []
        for k, part in enumerate(parts):
            r = ratio[part]
            e1, e2 = r.sum(), (r.sum() ** 2 - (r**2).sum()) / 2
            pairs = same.get((m, k), 0.0)
            w = len(part)
            options = {-1: 0.0, 0: pairs + PROBE_COST * n, 1: pairs * (1 + e1) + PROBE_COST * n * w, 2: pairs * (1 + e1 + e2) + PROBE_COST * n * w * (w - 1) / 2}
            costs.append({t: c for t, c in options.items() if t <= radius})
        cost, thresholds = allocate(costs, radius - m + 1)
        choices.append((cost, m, thresholds))
    _, m, thresholds = min(choices)
    out = []
    for part, t in zip(layouts[m], thresholds):
        out += [sum(1 << b for b in part) & ~sum(1 << b for b in gone) for gone in combinations(part, t)] if t >= 0 else []
    return out


def _forest(lists: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Stars over the linked sets of each bucket: its pairs are verified here and stay here."""
    for batch in lists:
        left, right = [], []
        for bucket in batch.column("fps").to_pylist():
            values = np.array(bucket, dtype=np.int64).view(np.uint64)  # bits of a signed number would be counted in its absolute value
            near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
            label = np.arange(len(values))
            while True:
                least = np.where(near, label[None, :], len(values)).min(axis=1)
                least = least[least]
                if (least == label).all():
                    break
                label = least
            linked = label != np.arange(len(values))
            left += values[linked].view(np.int64).tolist()
            right += values[label[linked]].view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _probes(rows: DataFrame, masks: list[int]) -> DataFrame:
    key = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return rows.select("fp", key.alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))


def refined_masks(mask: Column, radius: int) -> Column:
    """For a bucket's mask: masks that also fix one of ``radius`` + 1 parts of its free bits."""
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)), lambda x: mask.bitwiseAND(x) == 0)

    def part(k: int) -> Column:
        return F.aggregate(F.filter(bits, lambda _, i: i % (radius + 1) == k), mask, lambda acc, x: acc.bitwiseOR(x))

    return F.array(*map(part, range(radius + 1)))


def star_edges(spark: SparkSession, distinct: DataFrame, radius: int = 2, bucket: int = BUCKET, work: Scratch | None = None) -> DataFrame:
    """Edges (``a``, ``b``) whose components are those of all links between distinct fingerprints; they read frames that ``work`` stores."""
    work = work or Scratch(spark)
    rows = _probes(distinct, plan_masks(distinct, radius))
    found: DataFrame | None = None
    while True:
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
        sizes = work.store(sizes, "buckets")
        edges = sizes.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select(F.col("hi").alias("a"), F.col("lo").alias("b"))
        shared = rows.join(sizes.where("n > 2").select("mask", "value", "n"), ["mask", "value"])
        small = (F.col("n") <= bucket) | (F.bit_count("mask") >= 64 - FREE_BITS)
        lists = shared.where(small).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        edges = edges.unionByName(lists.mapInArrow(lambda it: _forest(it, radius), "a long, b long"))
        found = edges if found is None else found.unionByName(edges)
        if not sizes.where(~small).limit(1).count():
            return found.distinct()
        finer = shared.where(~small).select("fp", F.explode(refined_masks(F.col("mask"), radius)).alias("mask"))
        rows = work.store(finer.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")).distinct(), "refined")


def components(spark: SparkSession, edges: DataFrame, work: Scratch | None = None) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) of every node with an edge, by alternating large and small stars, each stored by ``work``."""
    work = work or Scratch(spark)

    def kept(frame: DataFrame) -> tuple[DataFrame, tuple]:
        frame = work.store(frame, "stars")
        return frame, tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs, state = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        pairs, now = kept(small)
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``hash`` (of the text), ``fp``, ``root`` (of the component: its least fingerprint) and ``component_id``, the least id reachable by links, for every row.

    Null and empty texts share fingerprint 0 and link like any other. A row
    without an id takes part, but names no component; a component of such rows
    alone has a null ``component_id``. Repeated rows give repeated results,
    texts of any length are hashed whole, other columns are ignored, whatever
    their names, and an empty table gives no rows. The result reads two stored
    frames, one row a row and one a fingerprint; the others are deleted.
    """
    spark = docs.sparkSession
    marked = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    with Scratch(spark) as work:
        distinct = work.store(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        roots = components(spark, star_edges(spark, distinct.select("fp"), radius, work=work), work)
        rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = work.keep(rooted.join(names, "root").select("fp", "root", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "hash", "fp", "root", "component_id")


def as_hex(fp: Column) -> Column:
    """The 16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least id (rows without an id last), of equal rows one."""
    found = simhash_components(docs, id_col, text_col, **settings)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("x"))
    stay = least.select(F.col("x.doc_id").alias("stay_id"), F.col("x.hash").alias("stay_hash"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), text_hash(F.col(f"`{text_col}`")).alias("own_hash"))
    left = keyed.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_hash") == F.col("stay_hash")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("own_id", "own_hash").orderBy(F.lit(0)))
    return left.withColumn("nth", nth).where("nth = 1").select("row.*")

"""A mutable dataset as Base, Delta and Tombstones, from an append-only log of mutations.

A mutation is a row ``sequence``, ``id``, ``op``, ``v``, ``attrs``. ``insert``
and ``upsert`` give a full image, ``attributes`` keeps the vector and needs a
live id, ``erase`` is idempotent and accepts any id. The latest accepted image
of an id wins; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators.ranks import row_numbers, running_totals

#: Ids are below this number.
ID_LIMIT = 1 << 32


def resolve(mutations: DataFrame, base: DataFrame) -> DataFrame:
    """Accepted mutations as full images: ``sequence``, ``id``, ``erased``, ``v``, ``attrs``, ``version``, ``accepted_no``; all are returned with ``accepted``.

    An update of attributes is accepted if its id is live at that point: by its
    last earlier insert, upsert or erase, or else by being in Base. ``version``
    counts the accepted images up to this one, ``accepted_no`` the accepted
    mutations, erases too: rejected ones have a place in the log only.
    """
    before = Window.partitionBy("id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    full = F.col("op").isin("insert", "upsert")
    known = base.select("id", F.col("v").alias("base_v"), F.lit(True).alias("in_base"))
    rows = mutations.join(known, "id", "left")
    last = F.last(F.when(F.col("op") != "attributes", F.col("op")), ignorenulls=True).over(before)
    live = F.when(last.isNull(), F.coalesce("in_base", F.lit(False))).otherwise(last != "erase")
    vector = F.coalesce(F.last(F.when(full, F.col("v")), ignorenulls=True).over(upto), F.col("base_v"))
    judged = rows.withColumns({"accepted": (F.col("op") != "attributes") | live, "erased": F.col("op") == "erase", "image": vector})
    judged = judged.select("sequence", "id", "op", "accepted", "erased", F.when(~F.col("erased"), F.col("image")).alias("v"), F.when(~F.col("erased"), F.col("attrs")).alias("attrs"))
    counted = running_totals(judged, ["sequence"], {"version": (F.col("accepted") & ~F.col("erased")).cast("long"), "accepted_no": F.col("accepted").cast("long")})
    return counted.withColumns({"version": F.when(F.col("accepted") & ~F.col("erased"), F.col("version")), "accepted_no": F.when(F.col("accepted"), F.col("accepted_no"))})


def last_images(resolved: DataFrame) -> DataFrame:
    """The last accepted mutation of each id; combined before the shuffle."""
    best = resolved.where("accepted").groupBy("id").agg(F.max_by(F.struct("erased", "v", "attrs", "version"), "sequence").alias("x"))
    return best.select("id", "x.*")


def delta(resolved: DataFrame) -> DataFrame:
    return last_images(resolved).where(~F.col("erased")).select("id", "v", "attrs", "version")


def tombstones(resolved: DataFrame, base: DataFrame) -> DataFrame:
    """Base ids that a mutation has replaced or erased."""
    return resolved.where("accepted").select("id").distinct().join(base.select("id"), "id", "left_semi")


def changed_ids(resolved: DataFrame, base: DataFrame) -> DataFrame:
    return delta(resolved).select("id").union(tombstones(resolved, base)).distinct()


def live_view(resolved: DataFrame, base: DataFrame, attributes: list[str]) -> DataFrame:
    """``id``, ``v``, the attributes, ``version`` and ``from_delta`` of the live rows: Base less tombstones, and Delta."""
    last = last_images(resolved)
    old = base.join(last.select("id"), "id", "left_anti").select("id", "v", *attributes, F.lit(0).cast("long").alias("version"), F.lit(False).alias("from_delta"))
    new = last.where(~F.col("erased")).select("id", "v", *[F.get("attrs", F.lit(i)).cast("float").alias(a) for i, a in enumerate(attributes)], "version", F.lit(True).alias("from_delta"))
    return old.unionByName(new)


def rebuild_trigger(resolved: DataFrame, base: DataFrame, fraction: float = 0.05) -> DataFrame:
    """``base_n``, ``changed_n``, ``threshold``, ``needs_rebuild``: a rebuild is due at max(1, Base times the fraction) changed ids."""
    counts = base.agg(F.count("*").alias("base_n")).crossJoin(changed_ids(resolved, base).agg(F.count("*").alias("changed_n")))
    limit = F.greatest(F.lit(1).cast("long"), F.floor(F.col("base_n") * F.lit(fraction)))
    return counts.withColumn("threshold", limit).withColumn("needs_rebuild", F.col("changed_n") >= F.col("threshold"))


def snapshot(live: DataFrame) -> DataFrame:
    """Live rows with new dense ``local_id`` in the order of ids."""
    return row_numbers(live, ["id"], "local_id")


def journal_since(resolved: DataFrame, cut: int) -> DataFrame:
    """Accepted mutations after the captured sequence number."""
    return resolved.where(F.col("accepted") & (F.col("sequence") > cut))


def validate_journal(journal: DataFrame, cut: int, arity: int, accepted: int | None = None) -> None:
    """Reject a journal as a whole before anything is applied.

    Accepted mutations are numbered without gaps, from ``accepted`` + 1 if that
    is given, by ``accepted_no`` or, in a journal without it, by ``sequence``
    from ``cut`` + 1. So a lost mutation shows, an erase too; as do repeated or
    disordered ones, images of the wrong arity, erases with an image, and
    versions that don't rise by one from image to image.
    """
    own = "accepted_no" if "accepted_no" in journal.columns else "sequence"
    rows = journal.select("sequence", F.col(own).alias("own"), "erased", "attrs", "version")
    order = running_totals(rows, ["sequence"], {"nth": F.lit(1).cast("long"), "image": (~F.col("erased")).cast("long")})
    shape = F.when(F.col("erased"), F.col("version").isNotNull() | F.col("attrs").isNotNull()).otherwise(F.col("version").isNull() | (F.coalesce(F.size("attrs"), F.lit(-1)) != arity))
    seen = order.agg(
        F.count("*").alias("n"), F.count_distinct("sequence").alias("places"), F.min("sequence").alias("first"), F.min("own").alias("least"), F.count_if(shape | F.col("own").isNull()).alias("bad"),
        F.min(F.col("own") - F.col("nth")).alias("low"), F.max(F.col("own") - F.col("nth")).alias("high"), F.min(F.col("version") - F.col("image")).alias("old"), F.max(F.col("version") - F.col("image")).alias("new"),
    ).first()
    if not seen.n:
        return
    start = accepted if accepted is not None else cut if own == "sequence" else seen.least - 1
    if seen["first"] <= cut or seen.bad:
        raise ValueError("the journal doesn't continue the capture or has images of the wrong form")
    if seen.places != seen.n or seen.low != seen.high or seen.least != start + 1:
        raise ValueError("the journal has gaps or repeats mutations")
    if seen.old != seen.new:
        raise ValueError("the versions of the journal are not contiguous")


def replay(captured: DataFrame, journal: DataFrame, attributes: list[str]) -> DataFrame:
    """The live view after a journal of full images is applied to a captured live view; versions of untouched rows stay."""
    last = journal.groupBy("id").agg(F.max_by(F.struct("erased", "v", "attrs", "version"), "sequence").alias("x")).select("id", "x.*")
    old = captured.join(last.select("id"), "id", "left_anti").select("id", "v", *attributes, "version")
    new = last.where(~F.col("erased")).select("id", "v", *[F.get("attrs", F.lit(i)).cast("float").alias(a) for i, a in enumerate(attributes)], "version")
    return old.unionByName(new)


def allocator_state(resolved: DataFrame, base: DataFrame) -> DataFrame:
    """``next_id``, ``next_version``, ``sequence`` after all mutations; a rejected one consumes none of them but its place in the log."""
    top = base.agg(F.coalesce(F.max("id") + 1, F.lit(0).cast("long")).alias("base_next"))
    own = resolved.where("accepted").agg(F.max(F.when(~F.col("erased"), F.col("id") + 1)).alias("new_next"), (F.coalesce(F.max("version"), F.lit(0).cast("long")) + 1).alias("next_version"), F.count("*").alias("sequence"))
    return top.crossJoin(own).select(F.greatest("base_next", F.coalesce("new_next", F.lit(0).cast("long"))).alias("next_id"), "next_version", "sequence")


def allocate_inserts(inserts: DataFrame, next_id: int, order: list[str]) -> DataFrame:
    """Ids for new rows from the high-water mark on; refused as a whole if they would pass ``ID_LIMIT``."""
    if next_id + inserts.count() > ID_LIMIT:
        raise ValueError("ids are exhausted")
    return row_numbers(inserts, order, "id").withColumn("id", F.col("id") + next_id)


def validate_base(base: DataFrame, attributes: list[str], next_id: int | None = None) -> None:
    """Reject nulls, NaN or infinite attributes, repeated ids, and a high-water mark that is not above every id."""
    bad = F.count_if(F.col("id").isNull() | F.col("v").isNull())
    for a in attributes:
        bad = bad + F.count_if(F.col(a).isNull() | F.isnan(a) | (F.abs(F.col(a)) == float("inf")))
    row = base.agg(bad.alias("bad"), F.max("id").alias("top"), F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.count_distinct(F.size("v")).alias("dims")).first()
    if row.bad or row.n != row.d or row.dims > 1:
        raise ValueError("rows with missing or infinite values, repeated ids or vectors of different dimensions")
    if next_id is not None and (next_id <= (-1 if row.top is None else row.top) or next_id > ID_LIMIT):
        raise ValueError("the high-water mark is not above every id")

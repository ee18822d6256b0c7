"""The overlay kept as sorted runs: each batch of mutations is resolved once, against the ids that it touches.

A store is a folder: runs, each the last accepted image of every id of one
batch, erases as marks, sorted by id; and manifests, of which the latest names
the runs that count. A batch is what lies after the high-water mark. It is
judged by the live rows of its own ids alone, which a join of the runs and Base
with these ids gives; no older mutation is resolved again. The live view merges
on read: of several images of an id the one of the highest sequence. Compaction
merges runs into one.

Runs are written before the manifest that names them, so that a batch whose
executors or driver are lost half-way leaves no trace but a folder that no
manifest names. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.operators import overlay
from veldra.session import Scratch, scratch

IMAGE = ["id", "sequence", "erased", "v", "attrs", "version"]


class Runs:
    """The store of one dataset over its Base (``id``, ``v`` and attributes)."""

    def __init__(self, spark: SparkSession, folder: str, base: DataFrame, attributes: list[str]):
        self.spark, self.folder, self.base, self.attributes = spark, folder.rstrip("/"), base, attributes
        held = self._names("manifests")
        self.number = max(map(int, held), default=0)
        row = spark.read.parquet(f"{self.folder}/manifests/{self.number:08d}").first() if held else None
        self.active, self.high_water, self.versions, self.accepted = (list(row.runs), row.high_water, row.versions, row.accepted) if row else ([], 0, 0, 0)

    def _names(self, part: str) -> list[str]:
        """Folders of complete writes: those with Spark's mark of success."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        files = path.getFileSystem(conf)
        if not files.exists(path):
            return []
        return [s.getPath().getName() for s in files.listStatus(path) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]

    def _commit(self, runs: list[str], high_water: int, versions: int, accepted: int) -> None:
        self.number += 1
        row = [(runs, high_water, versions, accepted)]
        self.spark.createDataFrame(row, "runs array<string>, high_water long, versions long, accepted long").coalesce(1).write.parquet(f"{self.folder}/manifests/{self.number:08d}")
        self.active, self.high_water, self.versions, self.accepted = runs, high_water, versions, accepted

    def _write(self, images: DataFrame) -> str:
        path = scratch(self.spark, "run").rsplit("/", 1)[-1]
        images.select(IMAGE).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.folder}/runs/{path}")
        return path

    def images(self) -> DataFrame:
        """The last image of every id that a mutation touched, erases as marks; combined before the shuffle."""
        schema = f"id long, sequence long, erased boolean, v {self.base.schema['v'].dataType.simpleString()}, attrs array<float>, version long"
        if not self.active:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.parquet(*[f"{self.folder}/runs/{r}" for r in self.active])
        best = rows.groupBy("id").agg(F.max_by(F.struct("sequence", "erased", "v", "attrs", "version"), "sequence").alias("x"))
        return best.select("id", "x.*")

    def append(self, mutations: DataFrame) -> int:
        """Resolves the mutations (``sequence``, ``id``, ``op``, ``v``, ``attrs``) after the high-water mark as one run; returns how many it read.

        Mutations up to the mark were resolved before and are left out, so that
        a batch may be sent again. A batch without new ones changes nothing.
        """
        with Scratch(self.spark) as work:
            batch = work.store(mutations.where(F.col("sequence") > self.high_water), "batch")
            seen = batch.agg(F.count("*").alias("n"), F.max("sequence").alias("top")).first()
            if not seen.n:
                return 0
            touched = work.store(batch.select("id").distinct(), "touched")
            known = self.images().join(touched, "id", "left_semi")
            untouched = self.base.join(touched, "id", "left_semi").select("id", "v").join(known.select("id"), "id", "left_anti")
            live = work.store(known.where(~F.col("erased")).select("id", "v").unionByName(untouched), "touched-live")
            resolved = work.store(overlay.resolve(batch, live), "resolved")
            last = resolved.where("accepted").groupBy("id").agg(F.max_by(F.struct("sequence", "erased", "v", "attrs", "version"), "sequence").alias("x")).select("id", "x.*")
            run = self._write(last.withColumn("version", F.col("version") + self.versions))
            counts = resolved.agg(F.count_if("accepted").alias("accepted"), F.coalesce(F.max("version"), F.lit(0)).alias("versions")).first()
        self._commit([*self.active, run], seen.top, self.versions + counts.versions, self.accepted + counts.accepted)
        return seen.n

    def live_view(self) -> DataFrame:
        """``id``, ``v``, the attributes, ``version`` and ``from_delta`` of the live rows, merged on read."""
        last = self.images()
        old = self.base.join(last.select("id"), "id", "left_anti").select("id", "v", *self.attributes, F.lit(0).cast("long").alias("version"), F.lit(False).alias("from_delta"))
        new = last.where(~F.col("erased")).select("id", "v", *[F.get("attrs", F.lit(i)).cast("float").alias(a) for i, a in enumerate(self.attributes)], "version", F.lit(True).alias("from_delta"))
        return old.unionByName(new)

    def compact(self) -> None:
        """Merges all runs into one; marks of ids that Base does not have go, as nothing is left for them to hide."""
        if len(self.active) < 2:
            return
        rows = self.images()
        needed = rows.where(~F.col("erased")).unionByName(rows.where("erased").join(self.base.select("id"), "id", "left_semi"))
        self._commit([self._write(needed)], self.high_water, self.versions, self.accepted)

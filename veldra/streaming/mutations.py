"""The log of mutations as a stream: micro-batches append images with contiguous sequence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldra.operators.ranks import row_numbers


def append_log(stream: DataFrame, path: str, checkpoint: str, order: list[str], once: bool = True) -> StreamingQuery:
    """Append a stream of mutations to the log at ``path``.

    Each batch continues the sequence of the batches before it, in the given
    order, and has a folder of its own that a repeated delivery overwrites, so
    that every mutation is in the log exactly once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = 0
        if epoch:
            log = spark.read.parquet(path).where(F.col("batch") < epoch)
            before = (log.agg(F.max("sequence")).first()[0] or 0)
        rows = row_numbers(batch, order, "sequence").withColumn("sequence", F.col("sequence") + before + 1)
        rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

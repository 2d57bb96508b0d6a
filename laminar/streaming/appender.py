"""Appending a stream to a table part by part, each key's rows cut into runs that go on from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.sources.writer import append, cut_by_key


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, max_rows: int = 0):
    """Starts a query that writes each micro-batch's rows with the run of their key's sequence that they fall in.

    Data and rows by key are written under the batch's number, so a batch that is given again replaces itself; runs go on
    from the rows by key of all batches before.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            rows, done = batch, None
            if max_rows and _exists(spark, f"{path}/counts"):
                before = spark.read.parquet(f"{path}/counts").where(F.col("epoch") < epoch).groupBy(key).agg(F.sum("n").alias("_done"))
                before = before.select(F.col(key).alias("_key"), "_done")
                rows = batch.join(before, batch[key].eqNullSafe(before["_key"]), "left").drop("_key")
                done = F.coalesce("_done", F.lit(0))
            append(cut_by_key(rows, key, order, max_rows, done).drop("_done"), path, epoch)
            batch.groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()

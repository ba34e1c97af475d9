"""Keeping arc methods current as measured segments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import methods


def refresh_arcs(stream: DataFrame, segments_path: str, out_path: str, checkpoint: str, key: str = "ID_ARC", buckets: int = 256, **settings):
    """A streaming query that stores each micro-batch of segments and recomputes the arcs it touches.

    The store is parted by a hash bucket of the arc, and a batch reads back
    only the buckets it touches.  Batches are written under their number, so a
    batch that runs again replaces itself; the changed arcs' results are
    written by batch too, the latest batch of an arc being current.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{segments_path}/batch={number}")
        mine = [r[0] for r in rows.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        if not mine:
            return
        known = spark.read.parquet(segments_path).where(F.col("batch") <= number).where(F.col("bucket").isin(mine)).drop("batch", "bucket")
        touched = batch.select(key).distinct()
        found = methods.aggregate_methods(known.join(touched, key, "left_semi"), key, **settings)
        found.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def current(results: DataFrame, key: str = "ID_ARC") -> DataFrame:
    """The latest row of each arc of what :func:`refresh_arcs` wrote."""
    cols = [c for c in results.columns if c not in (key, "batch")]
    last = results.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("r"))
    return last.select(key, "r.*")

"""Signal files that arrive over time: checked and appended to a track table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spantable.operators import validate


def stream_bedgraph(spark: SparkSession, folder: str) -> DataFrame:
    """chrom, s, e, v of the lines of bedGraph files as they come into a folder."""
    p = F.split("value", "\t", 5)
    rows = spark.readStream.text(folder).filter("value <> ''")
    return rows.select(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("long").alias("s"), F.get(p, F.lit(2)).cast("long").alias("e"), F.get(p, F.lit(3)).cast("float").cast("double").alias("v"))


def append_checked(rows: DataFrame, sizes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of a streamed signal to a Parquet table by chromosome; a batch that breaks a rule stops the stream.

    Every batch is its own folder, named by its number, so a batch that is
    repeated after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if batch.limit(1).count():
                validate.check(batch, sizes).sortWithinPartitions("chrom", "s").write.mode("overwrite").partitionBy("chrom").parquet(f"{target}/batch={number}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

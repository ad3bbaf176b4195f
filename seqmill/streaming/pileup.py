"""A pileup that grows as reads arrive.

Counts are sums, so reads may come in any order and need no watermark. The state is one row of
four counts for each position that was seen; it is kept by Spark and survives restarts by the
query's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seqmill.operators.pileup import pileup
from seqmill.sources.alignments import READ_DDL


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Reads from Parquet files as they appear in a folder."""
    return spark.readStream.schema(READ_DDL).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def growing_pileup(reads: DataFrame, min_bq: int = 20) -> DataFrame:
    """The pileup of all reads so far; use output mode update or complete."""
    return pileup(reads, min_bq)


def start(reads: DataFrame, folder: str, checkpoint: str, min_bq: int = 20) -> StreamingQuery:
    """Write the changed positions of every batch to a folder of its own, so a batch that is done again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return growing_pileup(reads, min_bq).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()

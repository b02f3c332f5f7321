"""Structured Streaming over folders into which archives are dropped.

An archive that can't be read to its end is reported as failed.  A file is read once; its entries and issues come with the micro-batch that found it, and reports go
through foreachBatch, as an archive's entries all arrive together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packrel.config import SecurityConfig
from packrel.operators import verify
from packrel.sources.archive import entries_of_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_entries(spark: SparkSession, folder: str, files_per_batch: int = 100, budget: int = 4 << 20) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return entries_of_files(files, budget=budget)


def verify_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str, config: SecurityConfig | None = None, available_now: bool = False):
    """Writes a report row an archive to Parquet; the started query is returned."""
    config = config or SecurityConfig()

    def report(batch: DataFrame, batch_id: int) -> None:
        verify.verify_entries(batch, config).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = arriving_entries(spark, folder, budget=config.max_tar_metadata_bytes).writeStream.foreachBatch(report).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

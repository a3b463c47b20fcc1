"""A folder of manuscripts, checked as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scriptorium.sources.files import decoded


def watch(spark: SparkSession, folder: str, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a check over each batch of new text files and appends its rows to out; seen files are in the checkpoint.

    Documents are named by the hash of their path. A batch that is run again overwrites its own rows only.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{txt,md}").load(folder)

    def run(batch: DataFrame, number: int) -> None:
        docs = decoded(batch).selectExpr("xxhash64(path) AS doc_id", "path", "text")
        check(docs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

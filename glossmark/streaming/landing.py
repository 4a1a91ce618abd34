"""Incremental landing: the resumable loops as one streaming job.

The batch loops skip documents whose output exists. Here a file stream only sees
new files, codes that are in the target are left out, and a batch is written once:
its id names the output folder, so a retried batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossmark.operators.ordering import first_per_key


def landed_documents(spark: SparkSession, folder: str, schema: str = "codigo string, text string") -> DataFrame:
    """Stream of landed documents (JSON lines)."""
    return spark.readStream.schema(schema).json(folder)


def process_landed(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    key: str = "codigo",
) -> StreamingQuery:
    """Run ``transform`` on each batch's new documents, one per key, and write it under its batch id.

    Keys that other batches have written are left out by reading the target, so no state is kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = first_per_key(batch, [key], batch.columns)
        try:
            done = batch.sparkSession.read.parquet(target).where(F.col("batch") != batch_id).select(key).distinct()
            fresh = fresh.join(done, key, "left_anti")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        transform(fresh).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Linking as a stream: micro-batches of documents against a static mention index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import linking

DOCUMENTS = "doc_id long, text string, spans array<struct<start:int,length:int>>"


def read_documents(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New JSON files of a folder as a stream of documents."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", max_files).json(path)


def link_stream(documents: DataFrame, index: DataFrame, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a JSON response for every streamed document as Parquet under ``output``.

    Each micro-batch is the batch plan, windows inside documents included, so a stream
    gives what a batch over the same documents gives. The index is read by every batch;
    the batch id names its folder, so a repeated batch overwrites itself.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        linking.answer(batch, index).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

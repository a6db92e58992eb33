"""Documents as a stream: the same chunkers over files as they arrive, and counts of events in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillstone.operators import chunking, document_tasks


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """doc_id, text of Parquet files that appear in a folder."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def chunk_stream(docs: DataFrame, strategy: str = "simple") -> DataFrame:
    """Chunkers keep no state between documents, so a stream of documents is chunked as a table is."""
    if strategy == "simple":
        return chunking.annotated(chunking.chunked(docs, chunking.word_chunks(F.col("text")), "simple"))
    return document_tasks.chunk_documents(docs, strategy)


def write_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, exactly once, to Parquet."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; windows close once the watermark has passed them."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

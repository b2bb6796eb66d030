"""A file stream of changed sources that upserts through the batch operators; an addition of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, indexing, symbols
from ..plans.engine import Tables


def refresh_stream(spark: SparkSession, source: str, tables: Tables, checkpoint: str) -> StreamingQuery:
    """Rows of (repo_path, file_path, language, text, content_hash) as Parquet files in ``source``; each micro-batch upserts its chunks once."""
    stream = spark.readStream.schema("repo_path string, file_path string, language string, text string, content_hash string").parquet(source)

    def apply(batch: DataFrame, _: int) -> None:
        keys = ["repo_path", "file_path"]
        new = chunking.chunk_files(symbols.with_symbols(batch.dropDuplicates(keys)))
        tables.write("chunks", indexing.delete(tables.read("chunks"), batch, keys).unionByName(new.select(tables.read("chunks").columns)))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

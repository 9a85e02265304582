"""Incremental indexing: an extension, new documents are added to the index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ferrule.operators.index import by_shard, doc_store, write_meta


def index_stream(docs: DataFrame, path: str, checkpoint: str, num_shards: int = 64) -> StreamingQuery:
    """Index a stream of (doc_id, text) in the layout that ``Index`` opens. Each batch has folders of its own that a repeated
    batch replaces. A document that comes again in a later batch replaces the earlier one; of several rows of one id in a batch one counts."""
    write_meta(docs.sparkSession, path, num_shards)

    def add(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["doc_id"]).persist()  # both tables must have the same row of each id
        by_shard(doc_store(once), num_shards).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings/batch={number}")
        doc_store(once).write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        once.unpersist()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

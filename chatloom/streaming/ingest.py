"""Batch documents as a stream into an archive: each micro-batch is one version, written before its files count as read, so a
batch that is run again after a failure finds nothing to change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.operators.archive import Archive
from chatloom.sources.inbox import Envelope, chat_net


def document_stream(spark: SparkSession, folder: str, pattern: str = "*.json", files_each: int = 100) -> DataFrame:
    """source_file, value of documents as they come in. A producer writes a document beside and renames it when it is whole."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_each)
    return reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")


def chat_ingest(documents: DataFrame, archive: Archive, envelope: Envelope, source: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Run all documents that are there into the archive; those without a right envelope are listed in the folder `rejected`."""

    def commit(batch: DataFrame, number: int) -> None:
        kept = [batch.persist()]
        try:
            net, bad = chat_net(batch, envelope, source)
            kept.append(net.persist())  # a commit looks at it more than once
            net.count()  # with its size known, a commit sends it to the archive's ids, not these to it
            archive.commit_delta(net.where("up = 1").select("id", "row.*"), net.where("up = 0").select("id"))
            bad.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            for df in kept[::-1]:
                df.unpersist()

    return documents.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_windows(events: DataFrame, late: str = "1 hour", width: str = "30 minutes") -> DataFrame:
    """user_id, kind, start, events, latest of event streams in windows of their own time; later ones than `late` are dropped."""
    seen = events.withWatermark("start_ts", late)
    out = seen.groupBy(F.window("start_ts", width), "user_id", "kind").agg(F.count("*").alias("events"), F.max("start_ts").alias("latest"))
    return out.select("user_id", "kind", F.col("window.start").alias("start"), "events", "latest")


def conversations_live(messages: DataFrame) -> DataFrame:
    """key, messages, first_ts, last_ts of a stream of messages, kept up with every batch (update mode)."""
    return messages.groupBy("key").agg(F.count("*").alias("messages"), F.min("captured_ts").alias("first_ts"), F.max("captured_ts").alias("last_ts"))

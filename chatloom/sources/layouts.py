"""Tables laid out as the files that the sources read: exports a conversation, batch documents, compressed segments.

Every writer is Spark's own; a file is a row or a sorted group of rows of bounded size, so layouts grow with their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.sources.staging import new_path


def _ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each folder in one file, in their order."""
    return rows.repartition("kind", "folder").sortWithinPartitions("kind", "folder", "ord").select("kind", "folder", *columns)


def trees(messages: DataFrame) -> str:
    """A JSON document for each conversation, its name and role beside the list of its messages. messages: kind, folder, ord, at
    (seconds), speaker, own (whether it is one's own), text. A conversation is a document, as in an export."""
    path = new_path(messages.sparkSession, "export-json")
    each = F.struct("ord", F.col("at").alias("timestamp"), F.col("own").alias("isSelf"), F.col("text").alias("content"), F.struct(F.col("speaker").alias("nickName")).alias("sender"))
    listed = F.transform(F.array_sort(F.collect_list(each)), lambda x: F.struct(x["timestamp"], x["isSelf"], x["sender"], x["content"]))
    documents = messages.groupBy("kind", "folder").agg(F.struct(F.lit("1").alias("version"), F.struct(listed.alias("list")).alias("body")).alias("chat"))
    documents.repartition("kind", "folder").write.partitionBy("kind", "folder").json(path)
    return path


def tables(messages: DataFrame) -> str:
    """A CSV file for each conversation, with headers; texts with line breaks and quotes are quoted."""
    path = new_path(messages.sparkSession, "export-csv")
    rows = _ordered(messages.withColumns({"Send Time": F.col("at").cast("string"), "Sender Name": F.col("speaker"), "is_send": F.col("own").cast("int").cast("string"), "Message": F.col("text")}), "Send Time", "Sender Name", "is_send", "Message")
    rows.write.partitionBy("kind", "folder").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def lines(messages: DataFrame) -> str:
    """A text file for each conversation: [time] speaker: text, with the line breaks of the text; without a time only the text."""
    path = new_path(messages.sparkSession, "export-text")
    at = F.date_format(F.timestamp_seconds("at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    value = F.when(F.col("at").isNull(), F.col("text")).otherwise(F.concat(F.lit("["), at, F.lit("] "), "speaker", F.lit(": "), "text"))
    _ordered(messages.withColumn("value", value), "value").write.partitionBy("kind", "folder").text(path)
    return path


def documents(rows: DataFrame, by: str, document, apart: bool = True) -> str:
    """A JSON document for each `by`: what `document` (an aggregate) makes of its rows, a file each. Apart, each is in a folder of its own,
    which whoever lists them has to look into; otherwise all are in one."""
    path = new_path(rows.sparkSession, "documents")
    each = rows.groupBy(F.col(by).cast("string").alias("of")).agg(document.alias("doc")).repartition("of").select("of", F.to_json("doc").alias("value"))
    if apart:
        each.write.partitionBy("of").text(path)
    else:
        each.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def segments(operations: DataFrame, schema: str) -> str:
    """Compressed segments, one for each seq, of operations (seq, ord, op, id, item): a header and a line each, in their order; named
    <seq>-ops.jsonl.gz. Renaming goes over the segments, not over their rows."""
    spark = operations.sparkSession
    path, out = new_path(spark, "segments-raw"), new_path(spark, "segments")
    line = F.to_json(F.struct("op", "id", "item"))
    heads = operations.select("seq").distinct().select("seq", F.lit(-1).cast("long").alias("ord"), F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit("delta").alias("kind"))).alias("value"))
    rows = heads.unionByName(operations.select("seq", F.col("ord").cast("long").alias("ord"), line.alias("value")))
    rows.repartition("seq").sortWithinPartitions("seq", "ord").select("seq", "value").write.partitionBy("seq").option("compression", "gzip").text(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(out))
    for folder in fs.listStatus(base):
        name = folder.getPath().getName()
        if name.startswith("seq="):
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, hadoop.Path(f"{out}/{int(name[4:]):010d}-ops.jsonl.gz"))
    return out


def local_path(spark: SparkSession, path: str) -> str:
    """A path as pyarrow's file systems know it: a local one without its scheme."""
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")

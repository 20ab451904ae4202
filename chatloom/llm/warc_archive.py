"""WARC: a content-addressed archive of web pages.

Every page becomes a WARC/1.1 record of its html in UTF-8. The archive keeps each payload once, under its SHA-256, in
the table `payloads`, and each record's exact header bytes in the table `records`; `read_records` joins them to the
original records. A payload of at least `min_bytes` bytes that several pages have is a response in the record of the
largest page_id and a revisit in the others, which refer to that one.

Payloads are bucketed by digest, so they cross the network once, when the first of equal ones is chosen, and not again
when records are rebuilt. Stored payloads are verified when they are read, and so is every rebuilt record: bytes that do not
have the digest they are kept under, or the length or SHA-1 that the record's header states, raise an error.

Defined results: a null html is an empty payload; pages without a page_id are archived, and as none of them is the
largest, they revisit a page that has one if there is any, and are responses otherwise; rows that repeat the largest
page_id with the same payload are all responses; a null url gives an empty WARC-Target-URI; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, new_path, staged

END = "\r\n"
#: Responses of one payload that are rebuilt one by one.
HOT = 1024


def _uuid(page_id: Column, digest: Column) -> Column:
    """A version-5-like record id of the page's id and payload, the same on every run."""
    h = F.sha1(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _header(date: str) -> Column:
    """The record's header, to the empty line."""
    revisit = F.col("record_type") == "revisit"

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    return F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _uuid(F.col("page_id"), F.col("digest")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<"), _uuid(F.col("refers_to"), F.col("digest")), F.lit(">"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(END),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the tables path/payloads (digest, payload) and path/records (page_id, header, digest) of pages (page_id, url, html); gives the first."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    index = read.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n_bytes"))
    index_path = f"{path}/index"
    index.write.parquet(index_path)
    index = spark.read.schema(index.schema).parquet(index_path)
    rows = index.groupBy("digest", "page_id").agg(F.count("*").alias("times"))
    owners = rows.groupBy(F.col("digest").alias("owned")).agg(F.max(F.struct("page_id", "times")).alias("last"))
    owners = owners.select("owned", F.col("last.page_id").alias("owner"), F.col("last.times").alias("times"))
    owners.write.parquet(f"{path}/owners")
    owners = spark.read.schema(owners.schema).parquet(f"{path}/owners")

    typed = index.join(owners, F.col("digest") == F.col("owned"))
    again = (F.col("n_bytes") >= min_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    typed = typed.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("owner")))
    typed.select("page_id", _header(date).alias("header"), "digest").write.parquet(f"{path}/records")

    # one page's bytes for each digest: the owner's
    own = F.sha2("payload", 256)
    stored = read.select("page_id", "payload", own.alias("digest")).join(owners, (F.col("digest") == F.col("owned")) & F.col("page_id").eqNullSafe(F.col("owner")))
    if not owners.where("times > 1").isEmpty():
        stored = stored.where("times = 1").unionByName(stored.where("times > 1").dropDuplicates(["digest"]))
    return bucketed(stored.select("digest", "payload"), f"{path}/payloads", ["digest"], compression="zstd")


def _right(column: Column, right: Column, message: Column) -> Column:
    """The binary column, or an error."""
    return F.when(right, column).otherwise(F.raise_error(message).cast("binary"))


def read_payloads(spark: SparkSession, path: str, stored: DataFrame | None = None) -> DataFrame:
    """digest and payload of every stored payload, verified; stored: that table, if it is known by its buckets."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads") if stored is None else stored
    return stored.select("digest", _right(F.col("payload"), F.sha2("payload", 256) == F.col("digest"), F.concat(F.lit("payload does not have the digest "), F.col("digest"))).alias("payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest (SHA-1), length, digest, header of every record, from its header."""
    records = spark.read.schema("page_id long, header string, digest string").parquet(f"{path}/records")

    def field(name):
        return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)

    return records.select("page_id", field("WARC-Type").alias("record_type"), F.expr("try_cast(nullif(regexp_extract(header, '\\r\\nX-Refers-To-Page: ([^\\r\\n]*)', 1), '') AS bigint)").alias("refers_to"), F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})", 1).alias("payload_digest"), F.regexp_extract("header", r"\r\nContent-Length: ([0-9]+)", 1).cast("long").alias("length"), "digest", "header")


def _rebuilt(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """headers with `payload`, checked against them, and `record`: header, block, two line ends; a revisit has no block."""
    joined = headers.join(payloads, "digest")
    is_revisit = F.col("record_type") == "revisit"
    stated = (F.sha1("payload") == F.col("payload_digest")) & (F.col("length") == F.when(is_revisit, 0).otherwise(F.octet_length("payload")))
    joined = joined.withColumn("payload", _right(F.col("payload"), stated, F.concat(F.lit("header and payload disagree: "), F.col("header"))))
    return joined.withColumn("record", F.concat(F.encode("header", "UTF-8"), F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")))


def read_records(spark: SparkSession, path: str, stored: DataFrame | None = None) -> DataFrame:
    """page_id, record_type, refers_to, the whole record as it was archived, and its payload."""
    return _rebuilt(read_headers(spark, path), read_payloads(spark, path, stored)).select("page_id", "record_type", "refers_to", "record", "payload")


def _blocks(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, digest, and of each record's rebuilt block payload_bytes and payload_digest."""
    ahead = F.octet_length("header")
    block = F.substring("record", ahead + 1, F.octet_length("record") - ahead - 4)
    whole = _rebuilt(headers, payloads).select("page_id", "digest", block.alias("block"))
    return whole.select("page_id", "digest", F.octet_length("block").cast("long").alias("payload_bytes"), F.sha1("block").alias("payload_digest"))


def _responses(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The same for all responses. A small payload may be that of any number of pages, all of them responses: one that more than
    HOT have is rebuilt and checked once for each length and digest that their headers state, which is all that tells them
    apart, and the others stand beside it; so no bucket of payloads gets more than HOT headers of one digest."""
    stated = ["digest", "length", "payload_digest"]
    hot = staged(headers.groupBy(*stated).agg(F.count("*").alias("n"), F.min("header").alias("header")).where(F.col("n") > HOT).select(*stated, "header"), "hot_payloads")
    if hot.isEmpty():
        return _blocks(headers, payloads)
    rest = headers.join(hot.select(*stated), stated, "left_anti")
    checked = _blocks(hot.withColumns({"page_id": F.lit(None).cast("long"), "record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}), payloads)
    checked = staged(checked.select("digest", F.col("payload_bytes").alias("length"), "payload_digest"), "hot_blocks")
    beside = headers.join(checked, stated).select("page_id", "digest", F.col("length").alias("payload_bytes"), "payload_digest")
    return _blocks(rest, payloads).unionByName(beside)


def archived(pages: DataFrame, path: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Archive pages, rebuild the records: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has the payload of the record that it refers to, whose bytes are rebuilt once and not for every revisit."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    stored = write_archive(pages, path, min_bytes)
    headers = read_headers(spark, path)
    whole = staged(_responses(headers.where("record_type = 'response'"), read_payloads(spark, path, stored)), "rebuilt")
    again = headers.where("record_type = 'revisit'").select("page_id", "refers_to", "digest", F.col("payload_digest").alias("stated"))
    one = whole.select(F.col("page_id").alias("refers_to"), "digest", "payload_bytes", "payload_digest").distinct()
    again = again.join(one, ["refers_to", "digest"], "left")
    right = F.coalesce(F.col("payload_digest") == F.col("stated"), F.lit(False))
    digest = F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no such record: "), F.col("refers_to").cast("string"))).cast("string"))
    again = again.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    first = whole.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again)

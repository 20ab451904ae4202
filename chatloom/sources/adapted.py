"""The driver's tables in the roles of the archive's: messages, device events, the operation log, tasks, claims, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WHEN = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id * 6 AS INT), CAST(turn * 7 AS INT), 0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('m-', conv_id, '-', turn) AS id",
        "CASE conv_id % 3 WHEN 0 THEN 'export-a' WHEN 1 THEN 'export-b' ELSE 'journal' END AS source",
        "CASE WHEN conv_id % 10 = 9 THEN NULL ELSE concat('conv-', conv_id) END AS conversation_id",
        "concat('Conversation ', conv_id) AS conversation_name",
        "CASE conv_id % 4 WHEN 0 THEN 'group' WHEN 3 THEN 'unknown' ELSE 'direct' END AS conversation_kind",
        "CASE role WHEN 'user' THEN 'me' WHEN 'assistant' THEN concat('peer-', conv_id % 7) ELSE NULL END AS speaker",
        "CASE role WHEN 'user' THEN 'self' WHEN 'assistant' THEN 'other' ELSE 'unknown' END AS speaker_role",
        "text AS content",
        f"CASE WHEN (conv_id + turn) % 23 = 0 THEN NULL ELSE {_WHEN} END AS captured_ts",
        "CASE WHEN turn % 3 = 0 THEN 'reviewed' ELSE 'new' END AS status",
    )


def context_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('e-', event_id) AS id",
        "CASE event_type WHEN 'view' THEN 'screen-time' WHEN 'purchase' THEN 'payment' WHEN 'click' THEN 'activity' WHEN 'error' THEN 'device' ELSE 'custom' END AS kind",
        "ts AS start_ts",
        "CASE WHEN event_type IN ('view', 'purchase') THEN ts + make_dt_interval(0, 0, 0, CAST(floor(value) AS DECIMAL(18,6))) ELSE NULL END AS end_ts",
        "user_id",
        "event_type AS title",
    )


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(day(ts) AS BIGINT) AS seq",
        "event_id AS ord",
        "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op",
        "concat('k-', user_id * 10 + event_id % 5) AS id",
        "CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value",
    )


def task(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "concat('t-', o_orderkey) AS id",
        "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'available' ELSE 'done' END AS status",
        "o_orderdate AS start_ts",
        "CAST(c_nationkey AS BIGINT) AS location_id",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('t-', o_orderkey - 1) END AS parent_id",
        "o_orderpriority AS title",
    )


def place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS place_id", "n_name AS name")


def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, some of which later messages repeat."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("*", "explode(sequence(0, CAST(turn % 3 AS INT))) AS again")
    return rows.selectExpr(
        "concat('peer-', conv_id % 7) AS person_id",
        "CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'event' END AS kind",
        "lower(text) AS claim_key",
        "concat('m-', conv_id, '-', turn + again) AS source_id",
        f"{_WHEN} + make_dt_interval(again * 20 * (1 + CAST(conv_id % 2 AS INT)), 0, 0, 0) AS observed_ts",
        "CAST(length(text) % 17 AS BIGINT) AS score",
    )


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task candidates, four from each message as several passes find them: the first sentence is the title and the rest the
    description; wording, sources, dates and places drift between passes and now and then disagree."""
    rows = table(spark, sf_dir, "conversations").selectExpr("*", "explode(array(0, 1, 2, 3)) AS pass", "split_part(text, '.', 1) AS first")
    return rows.selectExpr(
        "concat('c-', conv_id, '-', turn, '-', pass) AS id",
        "CAST(conv_id * 1000 + turn * 10 + pass AS BIGINT) AS ord",
        "CASE pass WHEN 1 THEN concat(first, '!') WHEN 3 THEN concat('Again ', first) ELSE first END AS title",
        "CASE pass WHEN 2 THEN concat('About ', first) ELSE substring(text, length(first) + 1) END AS description",
        "concat('m-', conv_id, '-', turn + CASE WHEN pass = 1 THEN turn % 2 ELSE 0 END) AS source_id",
        "CASE WHEN (turn + pass) % 3 = 0 THEN NULL ELSE concat('2024-01-0', 1 + (conv_id * pass) % 2) END AS start_at",
        "CASE WHEN (turn + pass) % 4 = 0 THEN NULL WHEN (conv_id + pass) % 5 = 0 THEN 'North Library' WHEN (conv_id + pass) % 5 = 1 THEN 'Gym' ELSE 'Library' END AS place",
        "CASE WHEN (turn + pass) % 2 = 0 THEN 'exact' ELSE 'approximate' END AS location_precision",
        "CASE (turn + pass) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'dismissed' ELSE 'created' END AS status",
    )

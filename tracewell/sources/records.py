"""Records from tables: views that name a table's columns as record fields, without copying data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event table as records; event ids and hosts are derived from user ids."""
    return event_records(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_records(e: DataFrame) -> DataFrame:
    user = F.col("user_id").cast("string")
    return e.select(
        F.lit("events.parquet").alias("file"), "ts", F.col("event_type").alias("channel"), (F.col("user_id") % 8).cast("string").alias("event_id"),
        F.concat(F.lit("host-"), user).alias("computer"), F.col("event_type").alias("provider"), F.col("event_id").cast("string").alias("record_id"),
        user.alias("f_user_id"), F.get_json_object("props", "$.k").alias("f_k"), F.col("value").cast("string").alias("f_value"),
        F.concat(F.lit("10."), F.col("user_id") % 4, F.lit(".0."), F.col("user_id") % 256).alias("f_ip"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("User-"), user)).alias("f_owner"), F.concat(F.lit("USER-"), user).alias("f_login"),
        F.array(user, F.get_json_object("props", "$.k"), F.col("event_type")).alias("data_array"), F.col("props").alias("data_string"), F.lit(False).alias("recovered"),
    )


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("source").alias("file"), F.lit(None).cast("timestamp").alias("ts"), F.col("lang").alias("channel"), (F.col("doc_id") % 4).cast("string").alias("event_id"),
        F.col("source").alias("computer"), F.col("lang").alias("provider"), F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("f_text"),
        F.col("n_chars").cast("string").alias("f_n_chars"), F.array("text").alias("data_array"), F.col("text").alias("data_string"), F.lit(False).alias("recovered"),
    )

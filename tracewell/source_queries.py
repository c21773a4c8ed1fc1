"""Queries over files that Spark writes from the event table: JSON of several shapes, one file a channel."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import filters
from tracewell.operators.detect import detections, resolver
from tracewell.plans.rules import Rule
from tracewell.sources import files, prune
from tracewell.sources.records import event_records, from_events
from tracewell.storage import shared_dir
from tracewell.streaming.counts import count_stream

#: The event table's channels under the names of channels that reports read.
REPORTED = {"error": filters.LOGON_CHANNELS[0], "click": filters.LOGON_CHANNELS[1]}


def _place(spark: SparkSession) -> str:
    """A new folder; what a query reads of it stays until the shared folder is cleaned up."""
    return f"{shared_dir(spark)}/lines-{uuid.uuid4().hex[:12]}"


def _object(more: dict | None = None):
    own = {"Channel": F.col("channel"), "EventID": F.col("event_id"), "Hostname": F.col("computer"), "RecordNumber": F.col("record_id"), "user_id": F.col("f_user_id"), "k": F.col("f_k"), "owner": F.col("f_owner")}
    return F.to_json(F.struct(*[c.alias(n) for n, c in (own | (more or {})).items()]))


def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects one behind the other on one line a file, with braces, quotes and backslashes in their strings."""
    told = {"Msg": F.concat(F.lit('if (x) {a} }{ "'), F.col("f_user_id"), F.lit('\\" { \\\\'), F.col("data_string")), "In": F.struct(F.struct(F.col("f_k").alias("deep")).alias("er"))}
    place = _place(spark)
    from_events(spark, sf_dir).select(_object(told)).write.option("lineSep", " ").text(place)
    back = files.json_files(spark, place, extensions=("txt",))
    return back.select("record_id", F.col("event_data")["Msg"].alias("msg"), F.col("event_data")["deep"].alias("deep"))


def _by_channel(spark: SparkSession, records: DataFrame, line) -> str:
    place = _place(spark)
    records.select(line.alias("value"), F.col("channel").alias("part")).repartition("part").write.partitionBy("part").text(place)
    return place


def file_channels(spark: SparkSession, sf_dir: str, rules: list[Rule]) -> DataFrame:
    """Detections over files of one channel each, of which only those that a rule can match are read."""
    place = _by_channel(spark, from_events(spark, sf_dir), _object())
    read = files.json_lines(spark, place, channels=prune.rule_channels(rules), extensions=("txt",))
    return detections(read, rules, resolver(read)).select("record_id", "rule_id", "channel")


def report_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per channel and event id of the files that the logon report reads."""
    records = from_events(spark, sf_dir)
    for name, reported in REPORTED.items():
        records = records.withColumn("channel", F.when(F.col("channel") == name, reported).otherwise(F.col("channel")))
    place = _by_channel(spark, records, _object())
    read = files.json_lines(spark, place, channels=filters.LOGON_CHANNELS, extensions=("txt",))
    return read.groupBy("channel", "event_id").agg(F.count(F.lit(1)).alias("n"))


def stream_counts(spark: SparkSession, sf_dir: str, rules: list[Rule], delay: str) -> DataFrame:
    """Windows of count rules over the event table as a stream, run until its files are used up."""
    table = f"{sf_dir}/events.parquet"
    glob = f"{sf_dir}/event[s].parquet"  # a source of files takes a folder or a pattern
    read = event_records(spark.readStream.schema(spark.read.parquet(table).schema).parquet(glob))
    place = _place(spark)
    out = count_stream(read, rules, resolver(read), delay=delay).writeStream.format("parquet").outputMode("append")
    out.option("checkpointLocation", f"{place}-state").trigger(availableNow=True).start(place).awaitTermination()
    made = spark.read.schema("rule_no int, agg_key string, win_start long, win_end long, n_rows long, win_count long").parquet(place)
    return made.select("agg_key", F.timestamp_micros("win_start").cast("timestamp_ntz").alias("win_start"), F.timestamp_micros("win_end").cast("timestamp_ntz").alias("win_end"), "n_rows", "win_count")

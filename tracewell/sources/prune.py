"""Leaving out files that no rule can match, by the channel of each file's first record.

All records of a file are taken to share the channel of its first one, as in exports of one log a file. What remains is a
filter on the file's path, which Spark applies to the list of files before it plans the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.leaves import Lists, selection
from tracewell.plans.rules import Rule
from tracewell.plans.scope import scope_of

#: Patterns of channels, one of which must match; None: any.
Channels = Iterable[str]


def rule_channels(rules: list[Rule]) -> set[str] | None:
    """Patterns of the channels that rules can match; None if one of them may match any."""
    scopes = [scope_of(r).channels for r in rules]
    return None if not scopes or any(s is None for s in scopes) else set().union(*scopes)


def channel_files(firsts: DataFrame, channels: Channels | None) -> list[str] | None:
    """Files whose first record, in firsts (file, channel), has one of the channels; None: all files. The list is as long
    as Spark's own list of the files."""
    if channels is None:
        return None
    test: Column = selection(sorted(channels), lambda _: F.col("channel"), Lists(), "Channel") if channels else F.lit(False)
    return sorted(r["file"] for r in firsts.where(test).select("file").collect())


def of_files(rows: DataFrame, files: list[str] | None) -> DataFrame:
    """rows of these files: `file` is their path as the source's metadata has it."""
    return rows if files is None else rows.where(F.col("file").isin(files))


def parquet_files(spark: SparkSession, path: str, channels: Channels | None, channel: str = "Channel") -> DataFrame:
    """A folder of Parquet files, less those whose first row has none of the channels; with the column `file`."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    held = rows.select("*", F.col("_metadata.file_path").alias("file"))
    if channels is None:
        return held
    firsts = rows.where(F.col("_metadata.row_index") == 0).select(F.col("_metadata.file_path").alias("file"), F.col(channel).alias("channel"))
    return of_files(held, channel_files(firsts, channels))

"""Sharding by extendible hashing, with DataFrame functions only.

A document's key is a hash of its id, read from the highest bit. A bucket is a prefix of the key's bits; one
that is larger than the byte limit is split on the next bit, the others stay as they are. The sizes of all
prefixes come from one aggregation over the cells of the directory, so that no bucket is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import free_name
from tracewell.storage import cut

#: Bits of the key; a bucket that no bit parts any more (repeated ids, one huge text) stays as it is.
KEY_BITS = 60
LIMIT = 16 << 20
#: Directory bits beyond those that equal sizes would need; buckets still too large there are looked at again, deeper.
SPARE_BITS = 6


def key_of(doc_id: Column) -> Column:
    """The first 60 bits of md5 of the id as text; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(cells: DataFrame, limit: int, start: int, depth: int) -> DataFrame:
    """(cell, bits, prefix, shard_bytes): the bucket of each cell of `depth` bits. cells: (cell, bytes). Prefixes of
    fewer than `start` bits are known to be too large."""
    levels = cells.withColumn("bits", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - bits)"))
    sizes = levels.groupBy("bits", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
    fit = sizes.where((F.col("shard_bytes") <= limit) | (F.col("bits") == depth))
    found = levels.join(fit, ["bits", "prefix"]).groupBy("cell").agg(F.min(F.struct("bits", "prefix", "shard_bytes")).alias("b"))
    return found.select("cell", "b.*")


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, bytes, shard (its bucket's bits), shard_bits, shard_bytes, oversized.

    Every shard holds `limit` bytes at most, unless its rows share a key or one text alone is larger; such a
    shard is not split further than KEY_BITS and marked oversized. Null text has 0 bytes, null ids share a key,
    repeated rows go to one shard, an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("bytes"), key_of(F.col(doc_id)).alias("key"))
    rows = cut(rows, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts: list[DataFrame] = []
    start, left = 0, rows
    while left is not None:
        depth = min(KEY_BITS, max(start, (total // max(limit, 1)).bit_length()) + SPARE_BITS)
        left = left.withColumn("cell", F.shiftright("key", KEY_BITS - depth))
        cells = left.groupBy("cell").agg(F.sum("bytes").alias("bytes"))
        found = cut(directory(cells, limit, start, depth), "shard-directory")
        placed = left.join(found, "cell")
        deep = depth < KEY_BITS and found.where(F.col("shard_bytes") > limit).head() is not None
        ready = placed.where(F.col("shard_bytes") <= limit) if deep else placed
        parts.append(ready.select("doc_id", "bytes", F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("bits"), F.lit("0")).alias("shard"), "bits", "shard_bytes"))
        left, start = (cut(placed.where(F.col("shard_bytes") > limit).select("doc_id", "bytes", "key"), "shard-rows"), depth + 1) if deep else (None, start)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    name = F.when(F.col("bits") == 0, F.lit("")).otherwise(F.col("shard"))
    return out.select("doc_id", "bytes", name.alias("shard"), F.col("bits").cast("int").alias("shard_bits"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", *, limit: int = LIMIT) -> None:
    """docs as Parquet, a folder per shard. Null texts and ids, repeated rows, clashing columns and empty tables are treated as
    in shard(); an empty table writes no folder of a shard. Rows that share an id lie in one shard. An existing path is an error."""
    name = free_name(docs.columns, "shard")
    keys = shard(docs, text, doc_id, limit=limit).select(F.col("doc_id").alias(f"__{name}_id"), F.col("shard").alias(name)).distinct()
    joined = docs.join(keys, F.col(doc_id).cast("long").eqNullSafe(F.col(f"__{name}_id"))).drop(f"__{name}_id")
    joined.repartition(name).write.partitionBy(name).parquet(path)

"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import before, hash_bucket, phase, share_bucket

SEED = 20240611


def interleaved_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """Shard and slot of each row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source``.

    Within each source, rows are put in a seeded random order; a row's fractional rank is (rank + u) / rows of
    the source, u being a seeded number between 0 and 1 for the source, so that many small sources don't meet at
    one fraction. Sorted by fractional rank, every stretch of the table holds each source in proportion, so equal
    cuts give shards that match the mixture. The law is ``rows``: shard sizes differ by one row at most.

    Ranks come from :func:`before`: rows are dealt by (source, hash bucket) and then by fraction bucket, and
    bucket totals give each bucket's starting rank. Only ids, hashes and sizes are shuffled, never texts.

    Nulls: a null text has size 1 and CRC 0; rows of null source form a source of their own; null ids sort
    first among equal hashes. Repeated rows each take a slot of their own. An empty table gives no rows.
    """
    text = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("_from"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_hash"),
        F.lit(1).cast("long").alias("_one"),
    )
    rows = rows.withColumn("_bucket", hash_bucket(F.col("_hash")))
    tie = ["_hash", "doc_id", "size", "text_crc32"]
    ranked = before(rows, ["_from"], "_bucket", tie, "_one", "_rank", "_of")
    ranked = ranked.withColumn("_part", (F.col("_rank") + phase(F.col("_from"))) / F.col("_of"))
    ranked = ranked.withColumn("_bucket", share_bucket(F.col("_part")))
    placed = before(ranked, [], "_bucket", ["_part", "_from", *tie], "_one", "_at", "_all")
    shard = F.expr(f"_at * {shards} div _all")
    return placed.withColumn("_shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_at - (_shard * _all + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )

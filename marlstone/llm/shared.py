"""Helpers that several operators share: staged tables, running totals and fixed-size bitmaps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 2 << 20  # of rows that go to a Python worker at once; a longer row goes by itself
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS  # that running totals are spread over, at any size


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is set for it once. On a cluster a
    temporary folder would be another one for each executor, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """As :func:`staged`, in buckets of ``column``, written without a shuffle: later joins on it move the other side only."""
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"marlstone_{uuid.uuid4().hex}"
    # fewer buckets than shuffle partitions would be dealt anew
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    return spark.table(table)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in Arrow batches of about ``BATCH_BYTES``, in this session. By default they
    are of up to 10,000 rows or 64 MB, whole row groups of texts, and each task holds two or three of them on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(column: Column) -> Column:
    """The SHA-256 of a text, null counting as empty; with a row's id it tells which row is meant."""
    return F.unhex(F.sha2(F.coalesce(column.cast("string"), F.lit("")), 256))


def matched_rows(df: DataFrame, wanted: DataFrame, id_col: str, key: Column, how: str = "left_semi") -> DataFrame:
    """The rows of ``df``, all columns, whose id and ``key`` are those of a row of ``wanted`` (``doc_id, text_key``), or
    with ``left_anti`` the others. Ids alone don't decide: a row of the same id with another text is another row.
    Null ids are compared like others. Only rows whose id may be wanted (:func:`with_likely`) are shuffled."""
    ids = wanted.select(F.col("doc_id").alias("_wanted_id"), F.col("text_key").alias("_wanted_key")).distinct()
    id_ = F.col(id_col).cast("long")
    likely = with_likely(df, [id_], ids, [F.col("_wanted_id")], "_likely")
    keyed = likely.filter("_likely").withColumn("_own_key", key).withColumn("_own_id", id_)
    found = keyed.join(ids, keyed["_own_id"].eqNullSafe(ids["_wanted_id"]) & (keyed["_own_key"] == ids["_wanted_key"]), how).select(*df.columns)
    return found if how == "left_semi" else likely.filter("NOT _likely").select(*df.columns).unionByName(found)


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list[str], how: str = "inner", least: int = 1000, parts: int = 50_000) -> DataFrame:
    """``rows`` joined to ``groups`` (one row for each value of ``keys``) where single keys may hold most rows.

    ``size`` is a group's number of rows. Groups of over n / ``parts`` rows, n being the sum of all sizes, and of
    over ``least``, are hot; there are at most ``parts`` of them, so that their keys can be broadcast. Rows of a hot
    group are dealt over as many salts as it is times too large, by a hash of ``spread``, and the group is repeated
    for each, so that no key of the join has more rows than a group may have. ``groups`` is read three times.
    """
    most = max(least, (groups.agg(F.sum(size)).first()[0] or 0) // parts)
    salts = F.ceil(F.col(size) / most).cast("int")
    hot = groups.filter(F.col(size) > most).select(*keys, salts.alias("_salts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    each = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted.join(each, [*keys, "_salt"], how).drop("_salt")


def filter_bits(rows: int, most: int = 1 << 27) -> int:
    """Bits of a bitmap in which ``rows`` hashed keys set one in 16 or fewer, a power of two up to ``most`` (16 MB)."""
    return min(most, max(1 << 16, 1 << (16 * max(1, rows) - 1).bit_length()))


def bit_of(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def bitmap_of(bit: DataFrame) -> np.ndarray:
    """The numbers in the only column of ``bit`` as a packed bitmap. They come back as bitmaps of 2**15 bits each."""
    one = F.col(bit.columns[0]) + 1
    found = bit.groupBy(F.bitmap_bucket_number(one).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits")).toArrow()
    marks = np.zeros(4096 * max([1, *found["part"].to_pylist()]), np.uint8)
    for part, own in zip(found["part"].to_pylist(), found["bits"], strict=True):
        marks[(part - 1) * 4096 : part * 4096] = np.frombuffer(own.as_buffer(), np.uint8)
    return marks


def marked(marks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of ``bits`` are set."""
    at = bits >> 3
    return (at < len(marks)) & ((marks[np.minimum(at, len(marks) - 1)] >> (bits & 7).astype(np.uint8)) & 1).astype(bool)


def with_likely(rows: DataFrame, keys: list[Column], wanted: DataFrame, wanted_keys: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: false for most rows whose ``keys`` aren't in ``wanted``, true for all that are.

    Hashed keys are a bitmap of at most 2**26 bits, as a broadcast table of its 64-bit words, so that rows with
    large columns needn't be shuffled to learn that nothing is joined to them. No Python is involved.
    """
    bits = filter_bits(wanted.count(), 1 << 26)
    hashed = lambda own: F.pmod(F.xxhash64(*own), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_mark_bit", F.lit(64)).cast("int"))
    words = wanted.select(hashed(wanted_keys).alias("_mark_bit")).groupBy(F.expr("_mark_bit div 64").alias("_mark_word")).agg(F.bit_or(one).alias("_mark_bits"))
    both = rows.withColumn("_mark_bit", hashed(keys)).withColumn("_mark_word", F.expr("_mark_bit div 64")).join(F.broadcast(words), "_mark_word", "left")
    return both.withColumn(name, F.coalesce(F.getbit("_mark_bits", F.pmod("_mark_bit", F.lit(64)).cast("int")) == 1, F.lit(False))).drop("_mark_bit", "_mark_word", "_mark_bits")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def phase(column: Column) -> Column:
    """A seeded number between 0 and 1, exclusive, for each value."""
    return (F.pmod(F.xxhash64(F.lit(3), column), F.lit(1 << 20)) + 0.5) / (1 << 20)


def hash_bucket(column: Column) -> Column:
    """The bucket of a 64-bit hash, 0 to ``BUCKETS`` - 1, rising with the signed hash."""
    top = F.shiftrightunsigned(column, 64 - BUCKET_BITS)
    return top.bitwiseXOR(F.lit(BUCKETS // 2)).cast("long")


def share_bucket(column: Column) -> Column:
    """The bucket of a number from 0 to 1, rising with it."""
    return F.least(F.floor(column * BUCKETS), F.lit(BUCKETS - 1)).cast("long")


def before(df: DataFrame, group: list[str], bucket: str, order: list, weight: str, out: str, totals: str) -> DataFrame:
    """Adds ``out``, the sum of ``weight`` over the rows of the same ``group`` that precede a row, and
    ``totals``, the sum over its whole group.

    ``bucket`` is a long from 0 to some fixed number that must rise with ``order``. Totals for each bucket
    give its starting point, so that a group of any size is spread over its buckets: what meets in one task
    is one bucket's rows, or one row for each bucket. Rows equal in all of ``order`` are interchangeable.
    """
    keys = [*group, bucket]
    each = df.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
    all_ = Window.partitionBy(*group)
    starts = each.select(
        *keys,
        F.coalesce(F.sum("_sum").over(all_.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_sum").over(all_).alias(totals),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, keys)
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_start")
    )

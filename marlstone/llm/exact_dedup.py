"""Exact deduplication that stands hot groups: local, salted, then global combining on full content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, matched_rows, spread_join, staged, unused

SALTS = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; the largest id of a group stays.

    Three combining steps, each keyed by the digest *and* the whole normalised text, so that two texts are
    merged only when their content is equal:

    1. each task merges what it has read (the partial aggregation of the salted grouping);
    2. rows of a digest meet by salt, the salt being that of the reading task, so that a group of any size
       brings at most one row per task, spread over ``salts`` tasks;
    3. the winners of the salts, at most ``salts`` for each text, are combined.

    The winner goes back to its members by digest (:func:`spread_join`: a hot group's members are dealt over as many
    salts as its size asks for). Should two different texts ever share a digest, the digest's rows are matched on their text instead. The winners, a row without text for
    each digest, are staged in the shared folder.

    Nulls: a null text counts as empty. A null id never wins over another id; a group without any id has a null
    ``keep_id`` and stays. Rows that repeat both id and text are one document: they are kept or dropped
    together and each counts for ``group_size``. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"))
    rows = rows.withColumn("text_sha256", F.sha2("_norm", 256))
    salted = (
        rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("text_sha256", "_salt", "_norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    whole = salted.groupBy("text_sha256", "_norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    # one row for each digest; _texts > 1 is a digest shared by different texts
    winners = staged(
        whole.groupBy("text_sha256").agg(
            F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "winners",
    )
    groups = winners.filter("group_size > 1")
    joined = spread_join(rows.select("doc_id", "text_sha256"), groups, ["text_sha256"], "group_size", ["doc_id"], "left")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    plain = joined.filter(F.coalesce("_texts", F.lit(1)) == 1)
    plain = plain.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )
    shared = winners.filter("_texts > 1").select("text_sha256")
    if shared.isEmpty():
        return plain
    own = whole.join(shared, "text_sha256", "left_semi")
    clash = rows.join(own, ["text_sha256", "_norm"]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
    return plain.unionByName(clash)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_groups` keeps; of rows that repeat id and text, one.

    A row is told by its id and the SHA-256 of its normalised text, so that of an id with several texts only the
    copies go. Texts of null id go if another row has theirs and an id; among themselves one stays.
    """
    groups = staged(exact_groups(docs, id_col, text_col).select("doc_id", "kept", F.unhex("text_sha256").alias("text_key")), "groups")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    key = F.unhex(F.sha2(norm, 256))
    left = matched_rows(docs, groups.filter(~F.col("kept")), id_col, key, "left_anti")
    again = staged(groups.filter("kept").groupBy("doc_id", "text_key").count().filter("count > 1"), "repeated")
    if again.isEmpty():
        return left
    once, name = matched_rows(left, again, id_col, key, "left_anti"), unused(docs, "norm")
    twice = matched_rows(left, again, id_col, key).withColumn(name, norm)
    return once.unionByName(twice.dropDuplicates([id_col, name]).drop(name))

"""Primary keys, unique columns, automatic ids and generated keys for rows to be added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import short_key

KEYS_A_MILLISECOND = 1 << 23  # four digits of base 62 hold that many, whatever the process
BLOCK = 1 << 16  # ordinals that one task numbers together


class ConstraintError(ValueError):
    """Rows that a table can't take."""


def with_ordinal(df: DataFrame, name: str = "_ordinal") -> DataFrame:
    """Rows numbered from 0 in their order, without gaps: counts by partition, then positions."""
    marked = df.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("_part", part).join(starts, "_part").withColumn(name, (F.col("_start") + inside).cast("long")).drop("_place", "_part", "_start")


def _running(df: DataFrame, value: Column, ordinal: str, out: str, how, inclusive: bool) -> DataFrame:
    """A running sum or maximum by ordinal, in blocks whose own totals are carried on."""
    marked = df.withColumn("_block", F.expr(f"{ordinal} div {BLOCK}")).withColumn("_v", value)
    blocks = marked.groupBy("_block").agg(how("_v").alias("_w"))
    carried = blocks.select("_block", how("_w").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    inside = Window.partitionBy("_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = marked.join(carried, "_block").withColumn("_i", how("_v").over(inside))
    both = F.greatest("_c", "_i") if how is F.max else F.coalesce("_c", F.lit(0)) + F.coalesce("_i", F.lit(0))
    return joined.withColumn(out, both).drop("_block", "_v", "_c", "_i")


def assign_ids(df: DataFrame, column: str, next_id: int, ordinal: str) -> DataFrame:
    """Fills null ids as if rows came one by one: each takes the next id, and an explicit id at or above it moves
    the next id past itself. Ids aren't used again."""
    auto = F.col(column).isNull()
    rows = _running(df, F.when(auto, 1).otherwise(0), ordinal, "_g", F.sum, True)
    rows = _running(rows, F.when(~auto, F.col(column) + 1 - F.col("_g")), ordinal, "_m", F.max, False)
    given = F.col("_g") - 1 + F.greatest(F.lit(next_id), F.coalesce("_m", F.lit(next_id)))
    return rows.withColumn(column, F.when(auto, given).otherwise(F.col(column)).cast("long")).drop("_g", "_m")


def next_id_after(df: DataFrame, column: str, next_id: int) -> int:
    """The next id once the rows of ``df``, whose ids are set, are in."""
    top = df.agg(F.max(column)).first()[0]
    return next_id if top is None else max(next_id, top + 1)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, and how often; nulls are exempt."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_unique(new: DataFrame, old: DataFrame, column: str, nulls: bool = True) -> None:
    """Raises unless the values of ``column`` in ``new`` are unique, also against ``old``."""
    if not nulls and not new.filter(F.col(column).isNull()).isEmpty():
        raise ConstraintError(f"{column} is null")
    if not duplicates(new, column).isEmpty():
        raise ConstraintError(f"{column} repeats among the new rows")
    if not new.select(column).join(old.select(column), column, "left_semi").isEmpty():
        raise ConstraintError(f"{column} has a value that is in the table")


def fill_short_keys(df: DataFrame, column: str, millis: Column, ordinal: str, process: int, attempt: int = 0) -> DataFrame:
    """Gives a time-ordered key to rows whose ``column`` is null or empty; ``attempt`` salts another try. After each
    ``KEYS_A_MILLISECOND`` rows the time moves on by one, so that any number of rows have different keys."""
    salt = F.pmod(F.xxhash64(F.col(ordinal), F.lit(attempt)), F.lit(62)) if attempt else F.lit(0)
    key = short_key(millis + F.expr(f"{ordinal} div {KEYS_A_MILLISECOND}"), F.col(ordinal) % KEYS_A_MILLISECOND, process, salt)
    return df.withColumn(column, F.when(F.col(column).isNull() | (F.col(column) == ""), key).otherwise(F.col(column)))

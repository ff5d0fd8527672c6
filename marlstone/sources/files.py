"""Imports of CSV and JSON with types that all rows fit, and exports."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Column, Database


#: Types in the order in which they are tried, and what a cell of each looks like.
LOOKS = {
    "BOOLEAN": r"(?i)^(true|false)$", "INTEGER": r"^[+-]?\d{1,18}$", "NUMBER": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$",
}


def column_types(raw: DataFrame) -> list[str]:
    """For each column of strings the first type that all of its cells have, blank ones aside; else, or where all are
    blank, TEXT. All rows count, so that no cell is lost to a type that others have."""
    cells = {n: F.trim(F.col(f"`{n}`")) for n in raw.columns}
    checks = [F.coalesce(F.bool_and(F.when(c != "", c.rlike(look))), F.lit(False)).alias(f"{k}_{kind}") for k, c in enumerate(cells.values()) for kind, look in LOOKS.items()]
    found = raw.agg(*checks).first()
    return [next((kind for kind in LOOKS if found[f"{k}_{kind}"]), "TEXT") for k in range(len(raw.columns))]


def _typed(name: str, kind: str) -> C:
    """A cell as its column's type; cells of another type are null."""
    c = F.trim(F.col(f"`{name}`"))
    return (c if kind == "TEXT" else c.try_cast(Column(name, kind).spark_type)).alias(name)


def read_csv(spark: SparkSession, path: str, columns: list[Column] | None = None) -> tuple[DataFrame, list[Column]]:
    """Rows of CSV files with a header, quoted fields included, and their columns: types that all rows fit, the
    first column as primary key. Blank lines are skipped, missing cells of text are empty."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', mode="PERMISSIVE", nullValue="\x00", emptyValue="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if columns is None:
        columns = [Column(n, kind, primary_key=k == 0) for k, (n, kind) in enumerate(zip(raw.columns, column_types(raw), strict=True))]
        columns[0] = Column(columns[0].name, columns[0].type, True, columns[0].type in ("INTEGER", "NUMBER"))
    filled = raw.select(*(F.coalesce(F.col(f"`{c.name}`"), F.lit("")).alias(c.name) for c in columns))
    return filled.select(*(_typed(c.name, c.type) for c in columns)), columns


def read_json(spark: SparkSession, path: str, lines: bool = True, schema: T.StructType | str | None = None) -> tuple[DataFrame, list[Column]]:
    """Objects of JSON files, one in each line or in arrays; malformed ones are skipped. Nested values come back as
    JSON text."""
    reader = spark.read.option("mode", "DROPMALFORMED").option("multiLine", not lines)
    raw = (reader.schema(schema) if schema is not None else reader).json(path)
    flat = raw.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name) for f in raw.schema))
    kinds = {T.LongType: "INTEGER", T.DoubleType: "NUMBER", T.BooleanType: "BOOLEAN"}
    columns = [Column(f.name, kinds.get(type(f.dataType), "TEXT"), k == 0, k == 0 and isinstance(f.dataType, T.LongType)) for k, f in enumerate(flat.schema)]
    return flat, columns


def import_rows(db: Database, table: str, rows: DataFrame, columns: list[Column], append: bool = False) -> DataFrame:
    """Puts rows into a table: a new one, replacing any of that name, or at the end of one that is there."""
    if not append or not db.exists(table):
        db.drop_table(table, if_exists=True)
        db.create_table(table, columns)
    return db.insert(table, rows)


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled, with a header."""
    df.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def block_ranges(df: DataFrame, key: str, rows: int = 500) -> DataFrame:
    """``block, min_key, max_key, rows`` for blocks of ``rows`` consecutive integer keys."""
    return df.groupBy(F.expr(f"`{key}` div {rows}").alias("block")).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("rows"))

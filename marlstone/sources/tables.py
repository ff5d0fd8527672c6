"""Typed tables in Spark's catalog, with keys, versions, checks and restore.

A table is a view over Parquet parts. A change writes new parts and then replaces the view, which is one step in the
catalog: readers see the table before or after it. Inserts write only their own rows; updates and deletes write the
table anew. Parts of the last ``KEPT_VERSIONS`` versions stay for :meth:`Database.restore` until :meth:`Database.optimize`. One writer at
a time is assumed. Any query is Spark SQL over the views.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changes
from ..operators.constraints import ConstraintError, assign_ids, check_unique, fill_short_keys, next_id_after, with_ordinal

KEPT_VERSIONS = 10  # of a table, for restore
MOST_PARTS = 32  # of a version; then an insert writes all of them as one
NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
#: Declared types and what they are here.
TYPES: dict[str, T.DataType] = (
    dict.fromkeys(("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"), T.LongType())
    | dict.fromkeys(("NUMBER", "NUMERIC", "DECIMAL", "FLOAT", "DOUBLE"), T.DoubleType())
    | dict.fromkeys(("BOOLEAN", "BOOL"), T.BooleanType())
    | dict.fromkeys(("DATE", "DATETIME", "TIMESTAMP"), T.TimestampNTZType())
)


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "TEXT"
    primary_key: bool = False
    auto_increment: bool = False
    short_key: bool = False
    unique: bool = False
    index: bool = False

    @property
    def spark_type(self) -> T.DataType:
        return TYPES.get(self.type.upper().split("(")[0].strip(), T.StringType())


@dataclass
class Definition:
    """A version of a table: its columns, next id and parts, with the row count and checksum of each part."""

    name: str
    columns: list[Column]
    next_id: int
    version: int
    parts: list[dict]
    marks: dict[str, int] = field(default_factory=dict)  # the last batch of each import that is in

    @property
    def key(self) -> str:
        return next(c.name for c in self.columns if c.primary_key)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type) for c in self.columns])


def checksum(df: DataFrame) -> tuple[C, C]:
    """Rows, and a sum of row hashes that doesn't depend on their order."""
    return F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash")


class Database:
    def __init__(self, spark: SparkSession, name: str = "marlstone", process: int = 4242) -> None:
        if not NAME.match(name):
            raise ValueError(f"not a name: {name}")
        self.spark, self.name, self.process = spark, name, process
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")

    # definitions

    def _full(self, table: str) -> str:
        if not NAME.match(table):
            raise ValueError(f"not a name: {table}")
        return f"{self.name}.{table}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._full(table))

    def _properties(self, table: str) -> dict[str, str]:
        if not self.exists(table):
            raise KeyError(f"no table {table}")
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._full(table)}").collect()}

    def definition(self, table: str, version: int | None = None) -> Definition:
        all_ = json.loads(self._properties(table)["versions"])
        found = all_[-1] if version is None else next((x for x in all_ if x["version"] == version), None)
        if found is None:
            raise KeyError(f"{table} has no version {version}")
        return Definition(table, [Column(**c) for c in found["columns"]], found["next_id"], found["version"], found["parts"], found.get("marks", {}))

    def _publish(self, new: Definition, versions: list[dict]) -> None:
        own = {"columns": [asdict(c) for c in new.columns], "next_id": new.next_id, "version": new.version, "parts": new.parts, "marks": new.marks}
        versions, old = [*versions, own][-KEPT_VERSIONS:], versions[: max(0, len(versions) + 1 - KEPT_VERSIONS)]
        text = json.dumps(versions).replace("\\", "\\\\").replace("'", "\\'")
        columns = {p["part"]: set(p["columns"]) for p in new.parts}
        selects = [
            "SELECT " + ", ".join(f"CAST({f'`{f.name}`' if f.name in columns[p['part']] else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in new.schema) + f" FROM {self.name}.{p['part']}"
            for p in new.parts
        ]
        self.spark.sql(f"CREATE OR REPLACE VIEW {self._full(new.name)} TBLPROPERTIES ('versions' = '{text}') AS {' UNION ALL '.join(selects)}")
        for part in {p["part"] for v in old for p in v["parts"]} - {p["part"] for v in versions for p in v["parts"]}:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}.{part}")

    def _versions(self, table: str) -> list[dict]:
        return json.loads(self._properties(table)["versions"]) if self.exists(table) else []

    def _write(self, table: str, df: DataFrame) -> dict:
        """A new part, and its row count and checksum, taken while it is written."""
        part, seen = f"{table}__{uuid.uuid4().hex[:12]}", Observation()
        df.observe(seen, *checksum(df)).write.format("parquet").saveAsTable(f"{self.name}.{part}")
        return {"part": part, "columns": df.columns, **seen.get}

    def create_table(self, table: str, columns: Iterable[Column], if_not_exists: bool = False) -> bool:
        """False if the table was there. Without a primary key, ``id`` or else the first column is one."""
        if self.exists(table):
            if if_not_exists:
                return False
            raise ValueError(f"{table} exists")
        columns = list(columns)
        if not columns or len({c.name for c in columns}) < len(columns) or sum(c.primary_key for c in columns) > 1:
            raise ValueError("columns need different names and one primary key")
        if not any(c.primary_key for c in columns):
            at = next((k for k, c in enumerate(columns) if c.name == "id"), 0)
            columns[at] = Column(**asdict(columns[at]) | {"primary_key": True})
        new = Definition(table, columns, 1, 1, [])
        new.parts = [self._write(table, self.spark.createDataFrame([], new.schema))]
        self._publish(new, [])
        return True

    def drop_table(self, table: str, if_exists: bool = False) -> bool:
        if not self.exists(table):
            if if_exists:
                return False
            raise KeyError(f"no table {table}")
        parts = {p["part"] for v in self._versions(table) for p in v["parts"]}
        self.spark.sql(f"DROP VIEW {self._full(table)}")
        for part in parts:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}.{part}")
        return True

    def table(self, table: str, version: int | None = None) -> DataFrame:
        if version is None:
            return self.spark.table(self._full(table))
        found = self.definition(table, version)
        out = None
        for p in found.parts:
            own = self.spark.table(f"{self.name}.{p['part']}")
            own = own.select(*((F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema))
            out = own if out is None else out.unionByName(own)
        return out

    # changes

    def _result(self, affected: int, now: Definition) -> DataFrame:
        return self.spark.createDataFrame([(affected, now.name, now.next_id)], "affected_rows long, table string, next_id long")

    def _checked(self, table: str, rows: DataFrame, old: DataFrame, columns: list[Column]) -> dict:
        """A new part of ``rows`` whose keys, as they were written, are unique, also against ``old``."""
        part = self._write(table, rows)
        written = self.spark.table(f"{self.name}.{part['part']}")
        try:
            for c in columns:
                if c.primary_key or c.unique or c.short_key:
                    check_unique(written, old, c.name, nulls=not c.primary_key)
        except ConstraintError:
            self.spark.sql(f"DROP TABLE {self.name}.{part['part']}")
            raise
        return part

    def insert(self, table: str, rows: DataFrame | list[dict[str, Any]], millis: C | None = None, mark: tuple[str, int] | None = None) -> DataFrame:
        """Adds rows, or none of them. Null primary keys of an auto-increment column get ids in the rows' order;
        null or empty short-key columns get keys, with new salts up to ten times if one is taken. What was written
        is checked, then published. ``mark`` is an import's name and batch number, published with the rows: a batch
        that is in already adds nothing. After ``MOST_PARTS`` inserts all parts are written as one."""
        now = self.definition(table)
        if mark and now.marks.get(mark[0], -1) >= mark[1]:
            return self._result(0, now)
        if isinstance(rows, list):
            rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in now.schema) for r in rows], now.schema)
        rows = changes.inserted(self.spark.createDataFrame([], now.schema), rows)
        old, next_id = self.table(table), now.next_id
        rows = with_ordinal(rows)
        key = next(c for c in now.columns if c.primary_key)
        filled = assign_ids(rows, key.name, now.next_id, "_ordinal") if key.auto_increment else rows
        stamp = F.coalesce(F.lit(None).cast("long") if millis is None else millis, F.unix_millis(F.current_timestamp()))
        for attempt in range(10):
            keyed = filled
            for c in now.columns:
                if c.short_key:
                    keyed = fill_short_keys(keyed, c.name, stamp, "_ordinal", self.process, attempt)
            try:
                part = self._checked(table, keyed.drop("_ordinal"), old, now.columns)
                break
            except ConstraintError:
                if attempt == 9 or not any(c.short_key for c in now.columns):
                    raise
        written = self.spark.table(f"{self.name}.{part['part']}")
        if key.auto_increment:
            next_id = next_id_after(written, key.name, next_id)
        parts = [*now.parts, part] if len(now.parts) < MOST_PARTS else [self._write(table, old.unionByName(written))]
        new = Definition(table, now.columns, next_id, now.version + 1, parts, now.marks | ({mark[0]: mark[1]} if mark else {}))
        self._publish(new, self._versions(table))
        if part not in parts:
            self.spark.sql(f"DROP TABLE {self.name}.{part['part']}")
        return self._result(part["rows"], new)

    def _replace(self, table: str, df: DataFrame, affected: int, next_id: int | None = None) -> DataFrame:
        now = self.definition(table)
        new = Definition(table, now.columns, now.next_id if next_id is None else next_id, now.version + 1, [self._write(table, df)], now.marks)
        self._publish(new, self._versions(table))
        return self._result(affected, new)

    def update(self, table: str, values: dict[str, Any], where: C | None = None) -> DataFrame:
        """Sets columns in the rows where ``where`` is true. The primary key can't change; unique columns are checked."""
        now, old = self.definition(table), self.table(table)
        if now.key in values:
            raise ConstraintError("a primary key can't change")
        if unknown := set(values) - set(old.columns):
            raise KeyError(f"no columns {sorted(unknown)}")
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        new = changes.updated(old, values, where)
        for c in now.columns:
            if c.unique and c.name in values:
                check_unique(new, old.limit(0), c.name)
        return self._replace(table, new, old.filter(hit).count())

    def delete(self, table: str, where: C | None = None) -> DataFrame:
        """Removes rows; ids aren't used again."""
        old = self.table(table)
        gone = old.count() if where is None else old.filter(where).count()
        return self._replace(table, changes.deleted(old, where), gone)

    def load(self, table: str, rows: DataFrame, next_id: int = 1) -> DataFrame:
        """Replaces all rows, whose keys must be unique."""
        now = self.definition(table)
        none = self.spark.createDataFrame([], now.schema)
        part = self._checked(table, changes.inserted(none, rows), none, now.columns)
        new = Definition(table, now.columns, next_id, now.version + 1, [part], now.marks)
        self._publish(new, self._versions(table))
        return self._result(part["rows"], new)

    def alter_columns(self, table: str, columns: Iterable[Column]) -> None:
        """Other columns, the table being written anew: new ones are null, those left out are gone."""
        now, old, columns = self.definition(table), self.table(table), list(columns)
        if sum(c.primary_key for c in columns) != 1:
            raise ValueError("one primary key is needed")
        rows = old.select(*((F.col(c.name) if c.name in old.columns else F.lit(None)).cast(c.spark_type).alias(c.name) for c in columns))
        self._publish(Definition(table, columns, now.next_id, now.version + 1, [self._write(table, rows)], now.marks), self._versions(table))

    # versions

    def restore(self, table: str, version: int) -> None:
        """The table as it was; a new version."""
        old, now = self.definition(table, version), self.definition(table)
        self._publish(Definition(table, old.columns, max(old.next_id, now.next_id), now.version + 1, old.parts, now.marks), self._versions(table))

    def damaged_parts(self, table: str, version: int | None = None) -> list[str]:
        """Parts whose rows or checksum differ from what was written."""
        bad = []
        for p in self.definition(table, version).parts:
            try:
                own = self.spark.table(f"{self.name}.{p['part']}")
                rows, total = own.agg(*checksum(own)).first()
                whole = (rows, total) == (p["rows"], p["hash"])
            except Exception as error:  # files that can't be read at all
                if isinstance(error, KeyboardInterrupt):
                    raise
                whole = False
            if not whole:
                bad.append(p["part"])
        return bad

    def recover(self, table: str) -> int:
        """Restores the latest version whose parts are whole, if the present one isn't; the version that is read."""
        for v in reversed(self._versions(table)):
            if not self.damaged_parts(table, v["version"]):
                if v["version"] != self.definition(table).version:
                    self.restore(table, v["version"])
                return v["version"]
        raise ValueError(f"no version of {table} is whole")

    def optimize(self, table: str, partitions: int | None = None) -> None:
        """Writes all parts as one, sorted within tasks by primary key, and drops earlier versions."""
        now, old = self.definition(table), {p["part"] for v in self._versions(table) for p in v["parts"]}
        rows = self.table(table)
        rows = (rows.repartitionByRange(partitions, now.key) if partitions else rows.repartitionByRange(now.key)).sortWithinPartitions(now.key)
        new = Definition(table, now.columns, now.next_id, now.version + 1, [self._write(table, rows)], now.marks)
        self._publish(new, [])
        for part in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}.{part}")

    # what there is

    def names(self, like: str | None = None) -> list[str]:
        """Table names, those that match ``like`` (% and _, in any case) if given."""
        views = [r["viewName"] for r in self.spark.sql(f"SHOW VIEWS IN {self.name}").collect() if not r["isTemporary"]]
        pattern = re.compile("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in like), re.I | re.S) if like else None
        return sorted(v for v in views if pattern is None or pattern.fullmatch(v))

    def show_tables(self, like: str | None = None) -> DataFrame:
        found = [self.definition(n) for n in self.names(like)]
        rows = [(d.name, sum(p["rows"] for p in d.parts), d.key, d.next_id, d.version, sum(c.unique or c.index or c.primary_key for c in d.columns)) for d in found]
        return self.spark.createDataFrame(rows, "table string, rows long, primary_key string, next_id long, version long, indexes int")

    def show_index(self, table: str) -> DataFrame:
        kinds = [(c.name, "PRIMARY" if c.primary_key else "UNIQUE" if c.unique or c.short_key else "INDEX") for c in self.definition(table).columns if c.primary_key or c.unique or c.short_key or c.index]
        return self.spark.createDataFrame([(table, *k) for k in kinds], "table string, column string, kind string")

    def show_create(self, table: str) -> str:
        d = self.definition(table)
        words = (("primary_key", "PRIMARY KEY"), ("auto_increment", "AUTOINCREMENT"), ("short_key", "SHORTKEY"), ("unique", "UNIQUE"), ("index", "INDEX"))
        return f"CREATE TABLE {table} (\n" + ",\n".join("  " + " ".join([c.name, c.type.upper(), *(w for a, w in words if getattr(c, a))]) for c in d.columns) + "\n)"

    def status(self) -> DataFrame:
        conf = self.spark.conf
        names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")
        rows = [("tables", str(len(self.names()))), ("spark_version", self.spark.version), *((n, conf.get(n)) for n in names)]
        return self.spark.createDataFrame(rows, "name string, value string")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables by their names."""
        self.spark.catalog.setCurrentDatabase(self.name)
        return self.spark.sql(text)

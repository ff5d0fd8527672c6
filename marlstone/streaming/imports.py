"""Incremental imports: new files of a folder into a table, resuming where the last run ended."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import Database


@dataclass
class ImportJob:
    """What an import has done so far."""

    table: str
    state: str = "PENDING"
    batches: int = 0
    rows: int = 0
    errors: list[str] = field(default_factory=list)


def import_stream(db: Database, table: str, path: str, schema: T.StructType | str, checkpoint: str, kind: str = "csv", job: ImportJob | None = None, **options) -> ImportJob:
    """Reads the files of ``path`` that earlier runs with this checkpoint haven't, in batches, and inserts each batch
    under the table's constraints. A batch that breaks one ends the run, as FAILED, and comes again next time.

    A batch's number is published together with its rows, so that one that was inserted just before a crash is
    recognised and skipped."""
    job = job or ImportJob(table)
    spark = db.spark
    reader = spark.readStream.format(kind).schema(schema).option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)

    def put(rows: DataFrame, batch: int) -> None:
        job.rows += db.insert(table, rows, mark=(checkpoint.rstrip("/"), batch)).first()["affected_rows"]
        job.batches += 1

    job.state = "PROCESSING"
    query: StreamingQuery = reader.load(path).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        job.state = "COMPLETED"
    except Exception as error:
        job.state = "FAILED"
        job.errors.append(str(error)[:500])
        raise
    return job

"""Every query that SQL can express gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from marlstone.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(float(r[k])) if isinstance(r[k], float) else repr(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(found.fetchall(), columns)


def test_crc(spark):
    import zlib

    for r in QUERIES["crc_rows"](spark, SF).collect():
        assert r.crc.startswith("0x") and len(r.crc) == 10
    from pyspark.sql import functions as F

    from marlstone.functions.keys import crc32_hex

    assert spark.range(1).select(crc32_hex(F.lit("123456789"))).first()[0] == f"0x{zlib.crc32(b'123456789'):08X}" == "0xCBF43926"


def test_pushdown_and_top_k(spark):
    from marlstone.plans.explain import explain, plan_text

    text = plan_text(QUERIES["pk_lookup"](spark, SF), "formatted")
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in text
    steps = [r.operation for r in explain(QUERIES["topk_multi"](spark, SF)).collect()]
    assert "TakeOrderedAndProject" in steps and "Exchange" not in steps
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan_text(QUERIES["sec_gt"](spark, SF), "formatted")

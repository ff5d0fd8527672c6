from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.keys import decode_base62, encode_base62, key_time, number_of, short_key
from marlstone.operators.constraints import ConstraintError, assign_ids, check_unique, with_ordinal
from marlstone.operators.predicates import Filter, all_of, chain, predicate
from marlstone.operators.relational import find_page, mean_of_all, page_rows, top, total


def test_base62(spark):
    values = [0, 1, 61, 62, 3843, 1_767_225_600_000, 2**53, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "n long").select("n", encode_base62(F.col("n")).alias("e"))
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def plain(n):
        out = ""
        while True:
            n, k = divmod(n, 62)
            out = digits[k] + out
            if not n:
                return out

    rows = df.withColumn("d", decode_base62(F.col("e"))).collect()
    assert all(r.e == plain(r.n) and r.d == r.n for r in rows)
    with pytest.raises(Exception, match="not Base62"):
        spark.range(1).select(decode_base62(F.lit("a-b"))).collect()


def test_short_keys_sort_by_time(spark):
    df = spark.range(200).select("id", short_key(F.lit(1_767_225_600_000) + F.col("id") * 977, F.col("id")).alias("k"))
    rows = df.withColumn("t", F.unix_millis(key_time(F.col("k")))).orderBy("k").collect()
    assert [r.id for r in rows] == list(range(200)) and all(len(r.k) == 13 and r.t == 1_767_225_600_000 + r.id * 977 for r in rows)
    with pytest.raises(Exception, match="too short"):
        spark.range(1).select(key_time(F.lit("abc"))).collect()


def test_short_keys_are_compiled(spark):
    """Beyond 8000 bytes the JVM interprets a method; a function that takes a lambda keeps the whole projection out."""
    df = spark.range(10).select(key_time(short_key(F.lit(1_767_225_600_000) + F.col("id") * 977, F.col("id"))).alias("t"))
    parts = df._jdf.queryExecution().debug().codegenToSeq()
    assert parts.size() == 1 and "Project" in parts.apply(0)._1() and 0 < parts.apply(0)._3().maxMethodCodeSize() < 8000


def test_base62_of_nulls_zeros_and_long_strings(spark):
    df = spark.createDataFrame([(None,), ("0",), ("0" * 40,), ("0" * 30 + "Z",)], "e string")
    assert [r[0] for r in df.select(decode_base62(F.col("e"))).collect()] == [None, 0, 0, 35]
    assert spark.range(1).select(encode_base62(F.lit(None).cast("long")), key_time(F.lit(None).cast("string"))).first()[:] == (None, None)
    for wrong in ("", "ab\n", "1" * 12, "0" + "z" * 11, "10" + "0" * 30):
        with pytest.raises(Exception, match="not Base62|overflow"):
            spark.range(1).select(decode_base62(F.lit(wrong))).collect()


def test_loose_numbers(spark):
    df = spark.createDataFrame([("",), (None,), ("true",), (" 2.5 ",), ("x",), ("false",)], "v string")
    assert [r[0] for r in df.select(number_of(F.col("v"))).collect()] == [0.0, 0.0, 1.0, 2.5, None, 0.0]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Abc", None), (2, "xaBy", 3), (3, None, 5)], "id int, s string, v int")
    ids = lambda c: sorted(r.id for r in df.filter(c).collect())
    assert ids(predicate(Filter("s", "like", "AB"))) == [1, 2]
    assert ids(predicate(Filter("s", "ilike", "a_c"))) == [1]
    assert ids(predicate(Filter("v", "=", None))) == [1] and ids(predicate(Filter("v", "!=", None))) == [2, 3]
    assert ids(predicate(Filter("v", "between", 3, 5))) == [2, 3] and ids(predicate(Filter("v", "<", 5))) == [2]
    assert ids(all_of([])) == [1, 2, 3]
    assert ids(chain(Filter("id", "=", 3), ("and", Filter("id", "=", 1)), ("or", Filter("v", "=", 5)))) == [3]
    with pytest.raises(ValueError):
        predicate(Filter("id", "~", 1))


def test_aggregates(spark):
    df = spark.createDataFrame([(1, None), (1, 4), (2, None)], "k int, v int")
    rows = {r.k: (r.t, r.m) for r in df.groupBy("k").agg(total("v").alias("t"), mean_of_all("v").alias("m")).collect()}
    assert rows == {1: (4, 2.0), 2: (0, 0.0)}


def test_pages_put_together_are_the_sorted_table(spark):
    df = spark.range(95).select("id", (F.col("id") * 7 % 10).alias("v"))
    rows = [r.id for k in range(1, 6) for r in page_rows(df, "id", k, 20, "v", True).collect()]
    assert rows == [r.id for r in df.orderBy(F.desc("v"), "id").collect()]
    page = find_page(df, "id", 2, 5000)
    assert (page.page_size, page.total_rows, page.total_pages, page.rows.count()) == (1000, 95, 1, 0)


def test_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id int, v int")
    assert [r.id for r in top(df, 3, "v").collect()] == [3, 2, 1] and [r.id for r in top(df, 3, ("v", "desc")).collect()] == [2, 3, 1]


def test_ids_as_if_one_by_one(spark, monkeypatch):
    from marlstone.operators import constraints

    monkeypatch.setattr(constraints, "BLOCK", 7)
    rng = random.Random(4)
    for _ in range(3):
        given = [rng.choice([None, None, rng.randrange(1, 80)]) for _ in range(40)]
        next_id, expected = 5, []
        for x in given:
            if x is None:
                x = next_id
            next_id = max(next_id, x + 1)
            expected.append(x)
        df = spark.createDataFrame(list(enumerate(given)), "o long, id long").repartition(3)
        assert [r.id for r in assign_ids(df, "id", 5, "o").orderBy("o").collect()] == expected


def test_ordinals(spark):
    rows = with_ordinal(spark.range(100).repartition(7)).collect()
    assert sorted(r._ordinal for r in rows) == list(range(100))


def test_unique(spark):
    a, b = spark.createDataFrame([(1,), (None,), (None,)], "x int"), spark.createDataFrame([(1,)], "x int")
    check_unique(a, b.filter("x = 2"), "x")
    for new, old, nulls in ((a, b, True), (a, b.limit(0), False), (b.union(b), b.limit(0), True)):
        with pytest.raises(ConstraintError):
            check_unique(new, old, "x", nulls)


def test_short_keys_of_any_number_of_rows(spark):
    from marlstone.operators.constraints import KEYS_A_MILLISECOND, fill_short_keys

    n = KEYS_A_MILLISECOND
    rows = spark.createDataFrame([(k, None) for k in (*range(50), *range(n - 50, n + 50), 62**4, 62**4 + 4242, 2 * n, 9 * n + 1)], "o long, k string")
    assert fill_short_keys(rows, "k", F.lit(1_767_225_600_000), "o", 4242).select("k").distinct().count() == rows.count()


def test_a_limit_has_one_result(spark):
    from marlstone.operators.relational import query

    df = spark.range(100).repartition(7)
    assert [r.id for r in query(df, [Filter("id", ">", 10)], 3).collect()] == [11, 12, 13]

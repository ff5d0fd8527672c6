"""The catalogue of queries over the sample tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import ALPHABET, crc32_hex, decode_base62, encode_base62, key_time, number_of, short_key
from ..operators import changes
from ..operators.constraints import assign_ids, duplicates, with_ordinal
from ..operators.predicates import Filter, all_of, chain, predicate
from ..operators.relational import by_key, first_rows, join_all, mean_of_all, ordered, page_rows, query, top, total
from ..sources.files import block_ranges, import_rows, read_csv, read_json, write_csv, write_json
from ..sources.tables import Column, Database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# scans and lookups


@_register("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def scan_project(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@_register("SELECT * FROM nation")
def scan_all(spark, d):
    return table(spark, d, "nation").select("*")


@_register("SELECT * FROM orders WHERE o_orderkey = 5")
def pk_lookup(spark, d):
    return by_key(table(spark, d, "orders"), "o_orderkey", 5)


@_register("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000001'")
def unique_lookup(spark, d):
    return by_key(table(spark, d, "customer"), "c_name", "Customer#000000001").select("c_custkey", "c_name", "c_acctbal")


@_register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sec_eq(spark, d):
    return query(table(spark, d, "orders"), [Filter("o_orderstatus", "=", "F")]).select("o_orderkey", "o_totalprice")


@_register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def sec_between(spark, d):
    return query(table(spark, d, "orders"), [Filter("o_totalprice", "between", 100000, 150000)]).select("o_orderkey", "o_totalprice")


@_register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def sec_gt(spark, d):
    return query(table(spark, d, "orders"), [Filter("o_totalprice", ">", 300000)]).select("o_orderkey", "o_totalprice")


@_register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 20000")
def sec_le(spark, d):
    return query(table(spark, d, "orders"), [Filter("o_totalprice", "<=", 20000)]).select("o_orderkey", "o_totalprice")


@_register("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def ordered_pk_page(spark, d):
    return top(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), 20, "o_orderkey", offset=40)


@_register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def ordered_sec_page(spark, d):
    return top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, ("o_totalprice", "desc"), "o_orderkey", offset=5)


@_register("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 30")
def limit_pk_order(spark, d):
    return first_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 30, "o_orderkey")


@_register("SELECT o_orderkey // 500 AS block, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(*) AS rows FROM orders GROUP BY 1")
def chunk_minmax(spark, d):
    return block_ranges(table(spark, d, "orders"), "o_orderkey")


# predicates


@_register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
def ne_filter(spark, d):
    return query(table(spark, d, "orders"), [Filter("o_orderstatus", "!=", "O")]).select("o_orderkey", "o_orderstatus")


@_register("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_filter(spark, d):
    return query(table(spark, d, "orders"), [Filter("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])]).select("o_orderkey", "o_orderpriority")


@_register("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_suppkey")
def col_vs_col(spark, d):
    return table(spark, d, "lineitem").filter(predicate(Filter("l_partkey", "<", F.col("l_suppkey")))).select("l_orderkey", "l_partkey", "l_suppkey")


@_register("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A_E%'")
def like_ci(spark, d):
    return query(table(spark, d, "part"), [Filter("p_name", "ilike", "%A_E%")]).select("p_partkey", "p_name")


@_register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' OR l_linestatus = 'O')")
def and_or_rightassoc(spark, d):
    where = chain(Filter("l_quantity", ">", 45), ("and", Filter("l_returnflag", "=", "R")), ("or", Filter("l_linestatus", "=", "O")))
    return table(spark, d, "lineitem").filter(where).select("l_orderkey", "l_linenumber", "l_quantity")


@_register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 48 OR (l_returnflag = 'R' AND l_linestatus = 'F')")
def or_and_rightassoc(spark, d):
    where = chain(Filter("l_quantity", ">", 48), ("or", Filter("l_returnflag", "=", "R")), ("and", Filter("l_linestatus", "=", "F")))
    return table(spark, d, "lineitem").filter(where).select("l_orderkey", "l_linenumber", "l_quantity")


@_register("SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value >= 10 AND value < 60")
def typed_filters_and(spark, d):
    return query(table(spark, d, "events"), [Filter("event_type", "=", "click"), Filter("value", ">=", 10), Filter("value", "<", 60)]).select("event_id", "event_type", "value")


@_register("SELECT event_id, event_type FROM events WHERE contains(lower(event_type), 'ic')")
def typed_like_contains(spark, d):
    return query(table(spark, d, "events"), [Filter("event_type", "like", "IC")]).select("event_id", "event_type")


@_register("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL")
def equals_null(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    joined = c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 400000), "left")
    return joined.filter(predicate(Filter("o_orderkey", "=", None))).select("c_custkey", "o_orderkey")


# order, limits, pages


@_register("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 3")
def mysql_limit(spark, d):
    """``LIMIT 3, 10``."""
    return top(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 10, "o_orderkey", offset=3)


@_register(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem "
    "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 40"
)
def topk_multi(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return top(rows, 40, ("l_extendedprice", "desc"), "l_orderkey", "l_linenumber", "l_partkey")


@_register(
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000 "
    "ORDER BY o_orderkey DESC NULLS LAST, c_custkey LIMIT 60"
)
def nulls_last_sort(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    joined = c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 350000), "left").select("c_custkey", "o_orderkey")
    return top(joined, 60, ("o_orderkey", "desc"), "c_custkey")


@_register("SELECT * FROM part ORDER BY p_partkey")
def full_sort(spark, d):
    return ordered(table(spark, d, "part"), "p_partkey")


@_register("SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 50")
def paged_browse(spark, d):
    return page_rows(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", 3, 25, "p_size", True, [Filter("p_size", ">=", 10)])


# joins


@_register(
    "SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey "
    "WHERE o_totalprice > 100 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"
)
def flagship(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = join_all(o, (c, o.o_custkey == c.c_custkey, "inner")).filter("o_totalprice > 100")
    return top(rows.select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice"), 5, ("o_totalprice", "desc"), "o_orderkey")


@_register("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return join_all(o, (c, o.o_custkey == c.c_custkey, "inner")).select("o_orderkey", "c_name", "o_totalprice")


@_register("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return join_all(c, (o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 400000), "left")).select("c_custkey", "o_orderkey", "o_totalprice")


@_register("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, d):
    return join_all(table(spark, d, "nation"), (table(spark, d, "region"), None, "cross")).select("n_name", "r_name")


@_register("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def join_comma(spark, d):
    return join_all(table(spark, d, "nation"), (table(spark, d, "region"), None, "cross")).filter("n_regionkey = r_regionkey").select("n_name", "r_name")


@_register("SELECT a.n_nationkey AS a_key, b.r_regionkey AS b_key FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey OR a.n_nationkey = b.r_regionkey")
def join_theta(spark, d):
    a, b = table(spark, d, "nation"), table(spark, d, "region")
    on = (a.n_regionkey < b.r_regionkey) | (a.n_nationkey == b.r_regionkey)
    return join_all(a, (b, on, "inner")).select(F.col("n_nationkey").alias("a_key"), F.col("r_regionkey").alias("b_key"))


@_register(
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"
)
def join_multiway(spark, d):
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    rows = join_all(o, (c, o.o_custkey == c.c_custkey, "inner"), (n, c.c_nationkey == n.n_nationkey, "inner"), (r, n.n_regionkey == r.r_regionkey, "inner"))
    return rows.filter("r_name = 'ASIA'").select("o_orderkey", "c_name", "n_name", "r_name")


@_register("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return join_all(a, (b, on, "inner")).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@_register("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > 250000 AND c_acctbal > 5000")
def join_pk_compound_on(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    on = (o.o_custkey == c.c_custkey) & (o.o_totalprice > 250000) & (c.c_acctbal > 5000)
    return join_all(o, (c, on, "inner")).select("o_orderkey", "c_custkey")


# aggregates


@_register(
    "SELECT count(*) AS n, count(o_orderpriority) AS n_priority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, "
    "min(o_totalprice) AS min_price, max(o_totalprice) AS max_price FROM orders"
)
def agg_global(spark, d):
    return table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("n_priority"), total(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("sum_price"),
        F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"),
    )


@_register(
    "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_returnflag"
)
def agg_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), total(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.min("l_shipdate").alias("first_ship")
    )


@_register(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, "
    "max(l_discount) AS max_discount FROM lineitem GROUP BY l_returnflag, l_linestatus"
)
def agg_multi_key(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), total(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.max("l_discount").alias("max_discount")
    )


@_register(
    "SELECT c_mktsegment, count(*) AS total_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spent "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
)
def agg_join_group(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = join_all(o, (c, o.o_custkey == c.c_custkey, "inner")).groupBy("c_mktsegment")
    return rows.agg(F.count(F.lit(1)).alias("total_orders"), total(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_spent"))


@_register("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@_register("SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS sum_price, CAST(0 AS DOUBLE) AS avg_price, min(o_orderkey) AS min_key FROM orders WHERE o_orderkey < 0")
def agg_empty(spark, d):
    rows = table(spark, d, "orders").filter("o_orderkey < 0")
    return rows.agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("sum_price"), mean_of_all("o_totalprice").alias("avg_price"), F.min("o_orderkey").alias("min_key"))


@_register("SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey ORDER BY n_orders DESC, o_custkey LIMIT 10")
def agg_order_alias_limit(spark, d):
    return top(table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")), 10, ("n_orders", "desc"), "o_custkey")


@_register(
    "WITH j AS (SELECT c_nationkey, CAST(o_totalprice > 300000 AS INT) AS big FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey % 7 = 0) "
    "SELECT c_nationkey, round(avg(coalesce(big, 0)), 2) AS avg_big FROM j GROUP BY c_nationkey"
)
def agg_mean_of_all(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    rows = c.join(o, (c.c_custkey == o.o_custkey) & (o.o_orderkey % 7 == 0), "left").select("c_nationkey", (F.col("o_totalprice") > 300000).cast("int").alias("big"))
    return rows.groupBy("c_nationkey").agg(mean_of_all("big").alias("avg_big"))


# functions


def _sql_base62(x: str, width: int) -> str:
    return " || ".join(f"substr('{ALPHABET}', CAST((({x}) // {62**k}) % 62 AS BIGINT) + 1, 1)" for k in reversed(range(width)))


@_register(f"SELECT event_id, regexp_replace({_sql_base62('event_id * 7919 + 61', 8)}, '^0+(.)', '\\1') AS code FROM events")
def base62_encode(spark, d):
    return table(spark, d, "events").select("event_id", encode_base62(F.col("event_id") * 7919 + 61).alias("code"))


@_register("SELECT event_id, event_id * 104729 + 3 AS back FROM events")
def base62_decode(spark, d):
    return table(spark, d, "events").select("event_id", decode_base62(encode_base62(F.col("event_id") * 104729 + 3)).alias("back"))


@_register(
    f"SELECT event_id, {_sql_base62('epoch_us(ts) // 1000', 9)} || right({_sql_base62('xor(event_id & 16777215, 4242)', 4)}, 4) AS code FROM events"
)
def short_keys(spark, d):
    return table(spark, d, "events").select("event_id", short_key(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id")).alias("code"))


@_register("SELECT event_id, date_trunc('milliseconds', ts) AS made FROM events")
def short_key_time(spark, d):
    key = short_key(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id"))
    return table(spark, d, "events").select("event_id", key_time(key).cast("timestamp_ntz").alias("made"))


@_register("SELECT count(*) AS n, count(DISTINCT event_id) AS n_keys FROM events")
def shortkey_unique(spark, d):
    keys = table(spark, d, "events").select(short_key(F.lit(1_767_225_600_000), F.col("event_id")).alias("k"))
    return keys.agg(F.count("k").alias("n"), F.count_distinct("k").alias("n_keys"))


@_register(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN CAST(p_size AS DOUBLE) END AS number FROM part"
)
def loose_numbers(spark, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "").when(k == 1, "true").when(k == 2, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", number_of(text).alias("number"))


@_register(None)
def crc_rows(spark, d):
    return table(spark, d, "nation").select("n_nationkey", crc32_hex(F.col("n_name")).alias("crc"))


# changes and constraints


@_register(
    "WITH e AS (SELECT event_id AS o, CASE WHEN event_id % 10 = 3 THEN event_id * 2 END AS id FROM events), "
    "g AS (SELECT *, sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY o) AS g FROM e), "
    "m AS (SELECT *, max(CASE WHEN id IS NOT NULL THEN id + 1 - g END) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM g) "
    "SELECT o AS ordinal, CAST(coalesce(id, g - 1 + greatest(1, coalesce(m, 1))) AS BIGINT) AS id FROM m"
)
def autoincrement(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 10 == 3, F.col("event_id") * 2).alias("id"))
    return assign_ids(rows, "id", 1, "ordinal").select("ordinal", "id")


@_register("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal FROM customer")
def ordinals(spark, d):
    return with_ordinal(table(spark, d, "customer").orderBy("c_custkey").select("c_custkey"), "ordinal")


@_register("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 1 UNION ALL SELECT 101, 'MU', NULL")
def insert_union(spark, d):
    rows = spark.createDataFrame([(100, "ATLANTIS", 1), (101, "MU", None)], "n_nationkey int, n_name string, n_regionkey int")
    return changes.inserted(table(spark, d, "nation"), rows)


@_register("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_cow(spark, d):
    return changes.updated(table(spark, d, "nation"), {"n_name": "renamed"}, F.col("n_regionkey") == 2)


@_register("SELECT * FROM nation WHERE NOT (n_regionkey = 1 AND n_nationkey > 5)")
def delete_cow(spark, d):
    return changes.deleted(table(spark, d, "nation"), all_of([Filter("n_regionkey", "=", 1), Filter("n_nationkey", ">", 5)]))


@_register("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def unique_violations(spark, d):
    return duplicates(table(spark, d, "customer"), "c_nationkey")


@contextmanager
def _database(spark: SparkSession) -> Iterator[Database]:
    name = f"catalogue_{uuid.uuid4().hex[:12]}"
    try:
        yield Database(spark, name)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def _kept(df: DataFrame) -> DataFrame:
    """The few rows of ``df``, so that they outlive the tables that they come from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


NATIONS = [Column("id", "INT", True, True), Column("name", unique=True), Column("region", "INT")]


@_register("SELECT 'nations' AS \"table\", count(*) AS rows, 'id' AS primary_key, max(n_nationkey) + 3 AS next_id FROM nation UNION ALL SELECT 'regions', count(*), 'id', 1 FROM region")
def show_tables(spark, d):
    with _database(spark) as db:
        db.create_table("nations", NATIONS)
        db.insert("nations", table(spark, d, "nation").selectExpr("n_nationkey + 1 AS id", "n_name AS name", "n_regionkey AS region").orderBy("id"))
        db.insert("nations", [{"name": "ATLANTIS"}])
        db.delete("nations", F.col("name") == "ATLANTIS")
        db.create_table("regions", [Column("id", "INT", True), Column("name")])
        db.load("regions", table(spark, d, "region").selectExpr("r_regionkey AS id", "r_name AS name"))
        return _kept(db.show_tables().select("table", "rows", "primary_key", "next_id"))


@_register(
    "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey <> 1 "
    "UNION ALL SELECT max(n_nationkey) + 2, 'ATLANTIS', 7 FROM nation UNION ALL SELECT max(n_nationkey) + 3, NULL, 7 FROM nation"
)
def table_changes(spark, d):
    """Rows with generated ids, an update, a delete, and a version that is left and restored."""
    with _database(spark) as db:
        db.create_table("nations", NATIONS)
        db.insert("nations", table(spark, d, "nation").orderBy("n_nationkey").selectExpr("n_name AS name", "n_regionkey AS region"))
        db.insert("nations", [{"name": "ATLANTIS", "region": 7}, {"region": 7}])
        db.update("nations", {"name": F.lower("name")}, F.col("region") == 2)
        db.delete("nations", F.col("region") == 1)
        version = db.definition("nations").version
        db.delete("nations")
        db.restore("nations", version)
        return _kept(db.table("nations"))


def _round_trip(spark: SparkSession, d: str, name: str) -> DataFrame:
    source = table(spark, d, name)
    with _database(spark) as db:
        folder = spark.sql(f"DESCRIBE DATABASE {db.name}").filter("info_name = 'Location'").first()["info_value"]
        write_csv(source, f"{folder}/csv")
        write_json(source, f"{folder}/json")
        from_csv, columns = read_csv(spark, f"{folder}/csv")
        from_json, _ = read_json(spark, f"{folder}/json")
        import_rows(db, "t", from_csv, columns)
        both = db.table("t").withColumn("kind", F.lit("csv")).unionByName(from_json.withColumn("kind", F.lit("json")))
        return _kept(both)


@_register("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, kind FROM nation CROSS JOIN (SELECT unnest(['csv', 'json']) AS kind)")
def import_roundtrip(spark, d):
    """Written as CSV and as JSON, and read back, the CSV through a table."""
    return _round_trip(spark, d, "nation")

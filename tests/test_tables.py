from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone.operators.constraints import ConstraintError
from marlstone.sources.files import import_rows, read_csv, read_json, write_csv, write_json
from marlstone.sources.tables import Column, Database
from marlstone.streaming.imports import import_stream

PRODUCTS = [Column("id", "INT", True, True), Column("sku", "VARCHAR(32)", short_key=True, unique=True), Column("title"), Column("price", "NUMBER", index=True), Column("in_stock", "BOOLEAN")]


@pytest.fixture()
def db(spark, request):
    out = Database(spark, "t_" + request.node.name[:20].lower().replace("[", "_").replace("]", ""))
    yield out
    spark.catalog.setCurrentDatabase("default")
    spark.sql(f"DROP DATABASE IF EXISTS {out.name} CASCADE")


def test_insert_update_delete_restore(db):
    assert db.create_table("products", PRODUCTS) and not db.create_table("products", PRODUCTS, if_not_exists=True)
    done = db.insert("products", [{"title": "a", "price": 1.5}, {"id": 10, "title": "b"}, {"title": "c", "in_stock": True}]).first()
    assert (done.affected_rows, done.next_id) == (3, 12)
    rows = {r.id: r for r in db.table("products").collect()}
    assert sorted(rows) == [1, 10, 11] and all(len(r.sku) == 13 for r in rows.values()) and len({r.sku for r in rows.values()}) == 3
    db.update("products", {"price": 9}, F.col("id") > 5)
    assert db.delete("products", F.col("title") == "b").first().affected_rows == 1
    assert db.insert("products", [{"title": "d"}]).first().next_id == 13
    assert sorted((r.id, r.price) for r in db.table("products").collect() if r.price) == [(1, 1.5), (11, 9.0)]
    assert db.sql("SELECT count(*) AS n FROM products WHERE price > 2 OR title = 'd'").first().n == 2
    db.restore("products", 2)
    assert sorted(r.id for r in db.table("products").collect()) == [1, 10, 11] and db.definition("products").next_id == 13
    db.optimize("products")
    assert db.table("products").count() == 3 and [r.kind for r in db.show_index("products").collect()] == ["PRIMARY", "UNIQUE", "INDEX"]
    assert "sku VARCHAR(32) SHORTKEY UNIQUE" in db.show_create("products")


def test_constraints_are_atomic(db):
    db.create_table("u", [Column("id", "INT", True, True), Column("email", unique=True)])
    db.insert("u", [{"email": "a"}, {"email": None}, {"email": None}])
    for bad in ([{"email": "x"}, {"email": "a"}], [{"id": 1, "email": "y"}], [{"email": "z"}, {"email": "z"}]):
        with pytest.raises(ConstraintError):
            db.insert("u", bad)
    assert db.table("u").count() == 3
    with pytest.raises(ConstraintError):
        db.update("u", {"email": "same"})
    with pytest.raises(ConstraintError):
        db.update("u", {"id": 5})
    assert {r.email for r in db.table("u").collect()} == {"a", None}


def test_catalog(db):
    for n in ("orders", "orders2", "people"):
        db.create_table(n, [Column("id", "INT")])
    assert db.names("ORD%") == ["orders", "orders2"] and db.show_tables().count() == 3 and db.status().count() > 2
    assert db.drop_table("people") and not db.drop_table("people", if_exists=True)
    with pytest.raises(KeyError):
        db.definition("people")
    with pytest.raises(ValueError):
        db.create_table("a-b", [Column("id")])
    db.insert("orders", [{"id": 1}])
    db.alter_columns("orders", [Column("id", "INT", True), Column("note")])
    assert db.table("orders").first().asDict() == {"id": 1, "note": None}
    db.update("orders", {"note": "seen"})
    db.alter_columns("orders", [Column("id", "INT", True)])
    db.alter_columns("orders", [Column("id", "INT", True), Column("note")])
    assert db.table("orders").first().asDict() == {"id": 1, "note": None}


def test_history_is_bounded(db, monkeypatch):
    from marlstone.sources import tables

    monkeypatch.setattr(tables, "MOST_PARTS", 3)
    monkeypatch.setattr(tables, "KEPT_VERSIONS", 2)
    db.create_table("h", [Column("id", "INT", True, True)])
    for _ in range(5):
        db.insert("h", [{}])
    assert sorted(r.id for r in db.table("h").collect()) == [1, 2, 3, 4, 5] and len(db.definition("h").parts) <= 3
    kept = {p["part"] for v in db._versions("h") for p in v["parts"]}
    assert len(db._versions("h")) == 2 and {r.tableName for r in db.spark.sql(f"SHOW TABLES IN {db.name}").collect() if "__" in r.tableName} == kept
    rows = db.spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(ConstraintError):
        db.load("h", rows)
    assert db.load("h", rows.distinct()).first().affected_rows == 1


def test_a_batch_is_inserted_once(db):
    db.create_table("b", [Column("id", "INT", True, True)])
    assert [db.insert("b", [{}], mark=("import", k)).first().affected_rows for k in (0, 0, 1, 1, 0)] == [1, 0, 1, 0, 0]
    db.update("b", {}, None)
    assert db.insert("b", [{}], mark=("import", 1)).first().affected_rows == 0 and db.table("b").count() == 2


def test_damage_is_found_and_recovered(db, spark):
    db.create_table("m", [Column("id", "INT", True)])
    db.insert("m", [{"id": k} for k in range(50)])
    db.insert("m", [{"id": 99}])
    assert db.damaged_parts("m") == []
    part = db.definition("m").parts[-1]["part"]
    folder = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + f"/{db.name}.db/{part}"
    for f in glob.glob(f"{folder}/part-*.parquet"):
        with open(f, "r+b") as out:
            out.seek(6)
            out.write(b"\xff" * 20)
        crc = f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    spark.catalog.refreshTable(f"{db.name}.{part}")
    assert db.damaged_parts("m") == [part]
    assert db.recover("m") == 2 and db.table("m").count() == 50


def test_csv(db, spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(b'id,name,price,ok\r\n1,"Smith, ""J""",2.5,true\r\n\r\n2,plain,x,false\r\n,short\r\n')
    rows, columns = read_csv(spark, str(path))
    assert [c.type for c in columns] == ["INTEGER", "TEXT", "TEXT", "BOOLEAN"] and columns[0].auto_increment
    assert import_rows(db, "c", rows, columns).first().affected_rows == 3
    got = sorted(tuple(r) for r in db.table("c").collect())
    assert got == [(1, 'Smith, "J"', "2.5", True), (2, "plain", "x", False), (3, "short", "", None)]
    import_rows(db, "c", rows.filter("id IS NULL"), columns, append=True)
    assert db.table("c").count() == 4
    write_csv(db.table("c"), str(tmp_path / "out"))
    again, _ = read_csv(spark, str(tmp_path / "out"))
    assert again.count() == 4


def test_json(db, spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([json.dumps({"id": 1, "tags": ["x", "{"], "s": 'a"}'}), "{broken", json.dumps({"id": 2, "tags": [], "s": None})]))
    rows, columns = read_json(spark, str(tmp_path / "a.json"), schema="id long, tags array<string>, s string")
    import_rows(db, "j", rows, columns)
    assert sorted((r.id, r.tags, r.s) for r in db.table("j").collect() if r.id) == [(1, '["x","{"]', 'a"}'), (2, "[]", None)]
    (tmp_path / "b.json").write_text(json.dumps([{"id": 5}, {"id": 6}]))
    assert read_json(spark, str(tmp_path / "b.json"), lines=False)[0].count() == 2
    write_json(db.table("j"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_stream_resumes(db, tmp_path):
    db.create_table("s", [Column("id", "INT", True, True), Column("v", "NUMBER")])
    source, mark = tmp_path / "in", str(tmp_path / "mark")
    source.mkdir()
    (source / "1.csv").write_text("id,v\n,1.5\n,2.5\n")
    job = import_stream(db, "s", str(source), "id long, v double", mark)
    assert (job.state, job.rows) == ("COMPLETED", 2)
    (source / "2.csv").write_text("id,v\n,3.5\n")
    assert import_stream(db, "s", str(source), "id long, v double", mark).rows == 1
    assert sorted(r.id for r in db.table("s").collect()) == [1, 2, 3]
    (source / "3.csv").write_text("id,v\n1,3.5\n")
    with pytest.raises(Exception):
        import_stream(db, "s", str(source), "id long, v double", mark)
    assert db.table("s").count() == 3

import random

import pytest

from keystrata.sources import tables as T


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id int, name string")


def test_random_operations_equal_a_dict(spark, tmp_path):
    rng, model, db = random.Random(3), {}, T.Database(spark, str(tmp_path / "db"))
    db.create_table("users", "id", "integer", {"name": "varchar"})
    for step in range(14):
        keys = rng.sample(range(8), 3)
        what = rng.choice(["insert", "insert", "delete", "minor", "major", "reopen"])
        if what == "insert":
            db.insert("users", rows(spark, [(k, f"v{step}") for k in keys]))
            model |= {k: f"v{step}" for k in keys}
        elif what == "delete":
            db.delete("users", spark.createDataFrame([(k,) for k in keys], "id int"))
            for k in keys:
                model.pop(k, None)
        elif what == "reopen":
            db = T.Database(spark, str(tmp_path / "db"))
        else:
            db.compact("users", major=what == "major")
            db.vacuum("users")
    assert [tuple(r) for r in db.list_rows("users").collect()] == sorted(model.items())
    assert [r["name"] for r in db.get("users", 99).collect()] == []


def test_errors(spark, tmp_path):
    db = T.Database(spark, str(tmp_path / "db"))
    db.create_table("users", "id", "integer", {"name": "varchar"})
    for error, act in (
        (T.TableExists, lambda: db.create_table("users", "id", "integer", {})),
        (T.TableNotFound, lambda: db.drop_table("none")),
        (T.InvalidSchema, lambda: db.create_table("../x", "id", "integer", {})),
        (T.PrimaryKeyTypeMismatch, lambda: db.insert("users", spark.createDataFrame([("1", "a")], "id string, name string"))),
        (T.ColumnCountMismatch, lambda: db.insert("users", spark.createDataFrame([(1,)], "id int"))),
        (T.ColumnTypeMismatch, lambda: db.insert("users", spark.createDataFrame([(1, 2)], "id int, name int"))),
        (T.InvalidSchema, lambda: db.insert("users", rows(spark, [(1, "a"), (1, "b")]))),
    ):
        with pytest.raises(error):
            act()
    with pytest.raises(Exception, match="null in name"):
        db.insert("users", rows(spark, [(1, None)]))
    db.drop_table("users")
    assert db.table_names() == [] and db.table_schema("users") is None

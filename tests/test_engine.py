"""The engine beyond batches: buffers, races, vacuum, key types, configuration, streams."""

import datetime
import random

import pytest

from keystrata.sources import tables as T
from keystrata.sources.config import Config
from keystrata.sources.errors import ConfigError
from keystrata.streaming import upsert


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id int, name string")


def listed(db, name="users"):
    return [tuple(r) for r in db.list_rows(name).collect()]


@pytest.fixture
def db(spark, tmp_path):
    db = T.Database(spark, str(tmp_path / "db"))
    db.create_table("users", "id", "integer", {"name": "varchar"})
    return db


def test_twenty_puts_at_ten_make_two_runs(spark, tmp_path):
    db = T.Database(spark, str(tmp_path / "db"), Config(memtable_size=10, max_frozen_memtables=5))
    db.create_table("users", "id", "integer", {"name": "varchar"})
    assert db.flush("users") == 0
    for k in range(20):
        db.put("users", k, {"name": f"v{k}"})
    assert db.gauges("users")["frozen_memtables"] == 2 and db.flush("users") == 2
    assert db.gauges("users")["level_0_runs"] == 2 and len(listed(db)) == 20


def test_a_full_queue_is_flushed(spark, tmp_path):
    db = T.Database(spark, str(tmp_path / "db"), Config(memtable_size=1, max_frozen_memtables=1, level_0_size=2))
    db.create_table("users", "id", "integer", {"name": "varchar"})
    for k in (1, 2, 3, 1):
        db.put("users", k, {"name": f"v{k}"})
    gauges = db.gauges("users")
    assert gauges["frozen_memtables"] == 1 and gauges["level_1_runs"] == 1 and gauges["level_0_runs"] == 1
    db.close()
    assert listed(T.Database(spark, db.path)) == [(1, "v1"), (2, "v2"), (3, "v3")]


def test_random_rows_equal_a_dict(spark, tmp_path):
    rng, model = random.Random(5), {}
    db = T.Database(spark, str(tmp_path / "db"), Config(memtable_size=3, level_0_size=3))
    db.create_table("users", "id", "integer", {"name": "varchar"})
    for step in range(40):
        k, what = rng.randrange(6), rng.choice(["put", "put", "put", "remove", "flush", "compact"])
        if what == "put":
            db.put("users", k, {"name": f"v{step}"})
            model[k] = f"v{step}"
        elif what == "remove":
            db.remove("users", k)
            model.pop(k, None)
        elif what == "flush":
            db.flush("users")
        else:
            db.compact("users", major=step % 2 == 0)
        if step % 10 == 9:
            assert listed(db) == sorted(model.items())
            assert [r["name"] for r in db.get("users", k).collect()] == [v for x, v in model.items() if x == k]


def test_a_stale_handle_loses_no_data(spark, db):
    other = T.Database(spark, db.path)
    other.insert("users", rows(spark, [(1, "a")]))
    db.vacuum("users", grace=0)  # this handle doesn't know of the run
    assert listed(T.Database(spark, db.path)) == [(1, "a")]
    db.insert("users", rows(spark, [(2, "b")]))  # taken to the next version
    db.insert("users", rows(spark, [(1, "c")]))
    assert listed(db) == listed(T.Database(spark, db.path)) == [(1, "c"), (2, "b")]
    other.compact("users")
    with pytest.raises(T.VersionConflict):
        db.compact("users")
    assert listed(db) == [(1, "c"), (2, "b")]
    with pytest.raises(T.TableExists):
        T.Database(spark, db.path).create_table("users", "id", "integer", {})


def test_vacuum_keeps_what_is_young(spark, db):
    db.insert("users", rows(spark, [(1, "a")]))
    before = T.Database(spark, db.path)
    db.compact("users", major=True)
    db.vacuum("users")
    assert listed(before) == [(1, "a")]


def test_keys(spark, db):
    with pytest.raises(T.NullValue):
        db.delete("users", spark.createDataFrame([(None,)], "id int"))
    for bad in ("1", 1.0, True, 1 << 31, None):
        with pytest.raises(T.PrimaryKeyTypeMismatch):
            db.get("users", bad)
    for bad, error in (({"name": 5}, T.ColumnTypeMismatch), ({"name": None}, T.NullValue), ({}, T.ColumnCountMismatch)):
        with pytest.raises(error):
            db.put("users", 1, bad)
    db.remove("users", 7)
    assert listed(db) == []
    db.drop_table("users")
    db.create_table("users", "id", "integer", {"name": "varchar"})
    assert listed(db) == [] and listed(T.Database(spark, db.path)) == []
    db.destroy()


def test_timestamps_without_a_zone_keep_their_reading(spark, db):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        db.create_table("log", "ts", "timestamp", {"at": "timestamp"})
        db.insert("log", spark.sql("select timestamp_ntz'2024-01-01 12:00:00' as ts, timestamp_ntz'2024-06-01 12:00:00' as at"))
        assert [tuple(r) for r in db.current("log").selectExpr("string(ts)", "string(at)").collect()] == [("2024-01-01 12:00:00", "2024-06-01 12:00:00")]
        when = datetime.datetime(2024, 1, 1, 17, tzinfo=datetime.timezone.utc)
        assert db.get("log", when).count() == 1 and db.get("log", int(when.timestamp() * 1e6)).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_config():
    assert Config.from_env({}) == Config("data", 10_000, 15, 4096, 2)
    assert Config.from_env({"KEYSTRATA_MEMTABLE_SIZE": "7", "KEYSTRATA_DATA_DIRECTORY": "x"}) == Config("x", memtable_size=7)
    for bad in ({"KEYSTRATA_MEMTABLE_SIZE": "0"}, {"KEYSTRATA_BLOCK_SIZE": "a"}, {"KEYSTRATA_DATA_DIRECTORY": ""}):
        with pytest.raises(ConfigError):
            Config.from_env(bad)


def test_a_replayed_batch_does_nothing(spark, db, tmp_path):
    for k in range(3):
        rows(spark, [(1, f"v{k}"), (k + 10, "x")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id int, name string").parquet(str(tmp_path / "in"))
        upsert.start(db, "users", stream, ["name"], str(tmp_path / "check")).awaitTermination()
    db.refresh()
    assert listed(db) == [(1, "v2"), (10, "x"), (11, "x"), (12, "x")]
    runs = len(db.state["tables"]["users"]["runs"])
    db.insert("users", rows(spark, [(1, "old")]), batch=(str(tmp_path / "check"), 1))
    assert len(db.state["tables"]["users"]["runs"]) == runs and listed(db)[0] == (1, "v2")


def test_metrics(spark, db):
    db.put("users", 1, {"name": "a"})
    db.get("users", 1)
    db.flush("users")
    assert {m for m, _ in db.metrics.counts} == {"put_duration_us", "get_duration_us", "flush_duration_ms"}
    assert len(db.metrics.counts["put_duration_us", "users"]) == 17 and len(db.metrics.counts["flush_duration_ms", "users"]) == 13
    from keystrata.operators import metrics

    assert metrics.process_gauges()["resident_bytes"] > 0
    with pytest.raises(ValueError):
        db.metrics.record("rows", "users", 1)

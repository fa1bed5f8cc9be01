"""Queries of the keyed-table engine over the driver's tables, each with its SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import codec
from keystrata.operators import bitmap, bloom, histogram, merge, runs
from keystrata.plans import workload
from keystrata.sources.config import Config
from keystrata.sources.tables import Database
from keystrata.streaming import upsert


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, d):
    return _t(spark, d, "events").withColumn("_deleted", F.col("event_type") == "error")


EVENT_ORDER = ["ts", "event_id"]
EVENT_COLS = ["user_id", "event_id", "event_type", "value"]


def point_get(spark, d):
    return merge.get(_t(spark, d, "orders"), "o_orderkey", 42)


def point_get_miss(spark, d):
    return merge.get(_t(spark, d, "orders"), "o_orderkey", -1)


def list_rows(spark, d):
    return _t(spark, d, "customer").orderBy("c_custkey")


def upsert_latest_wins(spark, d):
    return merge.latest(_events(spark, d), ["user_id"], EVENT_ORDER).select(*EVENT_COLS)


def delete_tombstone_scan(spark, d):
    return merge.live(_events(spark, d), ["user_id"], EVENT_ORDER).select(*EVENT_COLS)


def tombstone_count(spark, d):
    return merge.latest(_events(spark, d), ["user_id"], EVENT_ORDER).agg(F.count_if("_deleted").alias("tombstones"))


def lineitem_upsert(spark, d):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return merge.latest(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select(*cols)


def run_merge(spark, d):
    """Each run's latest versions first (minor compaction), then across the runs."""
    log = _events(spark, d).withColumn("run", F.expr("event_id div 1000"))
    return merge.live(merge.latest(log, ["run", "user_id"], EVENT_ORDER), ["user_id"], EVENT_ORDER).select(*EVENT_COLS)


def run_inventory(spark, d):
    return runs.inventory(_events(spark, d).withColumn("run", F.expr("event_id div 1000")), "run", "user_id")


def block_index(spark, d):
    return runs.sparse_index(_t(spark, d, "orders"), "o_orderkey", 4096)


def block_seek(spark, d):
    index = runs.sparse_index(_t(spark, d, "orders"), "o_orderkey", 4096)
    keys = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return runs.floor_seek(keys, "key", index, "first_key")


def _wanted(spark, d):
    return _t(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))


def multi_get(spark, d):
    return merge.multi_get(_t(spark, d, "orders"), "o_orderkey", _wanted(spark, d)).select("o_orderkey", "o_custkey", "o_totalprice")


def multi_get_misses(spark, d):
    keys = _t(spark, d, "lineitem").select((F.col("l_orderkey") + 7000).alias("o_orderkey"))
    return merge.multi_get_misses(_t(spark, d, "orders"), "o_orderkey", keys)


def bloom_sizing(spark, d):
    counts = [_t(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("orders", "customer", "part")]
    return bloom.sizing(reduce(DataFrame.unionByName, counts), "n", 0.1).select("name", "n", "n_bits", "n_bytes", "n_hashes")


def duration_hist(spark, d):
    return histogram.bucket_counts(_t(spark, d, "events"), "value", histogram.MILLISECOND_BOUNDS)


def duration_us_hist(spark, d):
    micros = _t(spark, d, "events").select((F.col("value") * 1000).alias("us"))
    return histogram.bucket_counts(micros, "us", histogram.bounds_of("event_duration_us"))


# Through the engine: tables written as runs, then read back.


def _folder(spark, name: str) -> str:
    """A fresh folder below the one that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return os.path.join(base.removeprefix("file://").removeprefix("file:"), f"{name}-{uuid.uuid4().hex}")


EVENT_TYPES = {"event_id": "big_integer", "event_type": "varchar", "value": "double"}


def _event_database(spark, d, batches: int = 3, **settings) -> Database:
    """events by user in ``batches`` runs, then deletes of the users whose latest event is an error."""
    db = Database(spark, _folder(spark, "events"), Config(**settings))
    db.create_table("events", "user_id", "big_integer", EVENT_TYPES)
    log = _t(spark, d, "events").select("user_id", *EVENT_TYPES)
    for k in range(batches):
        db.insert("events", log.where(F.col("event_id") % batches == k).where("event_id % 2 = 0"), "event_id")
    db.insert("events", log, "event_id")
    db.delete("events", db.current("events").where("event_type = 'error'").select("user_id"))
    return db


def engine_upsert(spark, d):
    db = Database(spark, _folder(spark, "events"))
    db.create_table("events", "user_id", "big_integer", EVENT_TYPES)
    log = _t(spark, d, "events").select("user_id", *EVENT_TYPES)
    for half in ("event_id < 2000", "event_id >= 2000"):
        db.insert("events", log.where(half), "event_id")
    return db.list_rows("events")


def engine_deleted_list(spark, d):
    return _event_database(spark, d).list_rows("events")


def engine_compacted_list(spark, d):
    """Minor compaction keeps tombstones, major drops them; the list stays."""
    db = _event_database(spark, d)
    db.compact("events")
    db.compact("events", major=True)
    db.vacuum("events", grace=0)
    return db.list_rows("events")


def engine_auto_compaction(spark, d):
    """The runs of each level after seven inserts at a limit of three level-0 runs."""
    db = Database(spark, _folder(spark, "parts"), Config(level_0_size=3))
    db.create_table("part", "p_partkey", "big_integer", {"p_size": "integer"})
    part = _t(spark, d, "part").select("p_partkey", "p_size")
    for k in range(7):
        db.insert("part", part.where(F.col("p_partkey") % 7 == k))
    gauges = db.gauges("part")
    return db.current("part").agg(F.count("*").alias("entries")).select("entries", *[F.lit(gauges[g]).alias(g) for g in ("level_0_runs", "level_1_runs")])


def _order_database(spark, d) -> Database:
    db = Database(spark, _folder(spark, "orders"))
    db.create_table("orders", "o_orderkey", "big_integer", {"o_custkey": "big_integer", "o_totalprice": "double", "o_orderdate": "timestamp"})
    db.insert("orders", _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    return db


def engine_point_get(spark, d):
    return _order_database(spark, d).get("orders", 42).select("o_orderkey", "o_custkey", "o_totalprice")


def engine_point_get_miss(spark, d):
    return _order_database(spark, d).get("orders", -1).select("o_orderkey", "o_custkey", "o_totalprice")


def engine_buffered_list(spark, d):
    """Rows put one by one over a batch, some flushed and some still buffered, and one removed."""
    db = Database(spark, _folder(spark, "nation"), Config(memtable_size=4))
    db.create_table("nation", "n_nationkey", "integer", {"n_name": "varchar", "n_regionkey": "integer"})
    rows = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    db.insert("nation", rows)
    for k in range(10):
        db.put("nation", k, {"n_name": f"name {k}", "n_regionkey": 9})
    db.remove("nation", 24)
    return db.list_rows("nation")


def stream_upsert(spark, d):
    """events as a stream of files into a table, one run a micro-batch.

    The stream stops after each of its two batches and goes on from its checkpoint,
    so that a batch may be many files.  A file is a row group, which one task sorts
    whole; its rows are bounded, as 128 MB of compressed events are 15 million.
    """
    folder = _folder(spark, "stream")
    log = _t(spark, d, "events").select("user_id", *EVENT_TYPES, (F.col("event_type") == "error").alias("gone"))
    db = Database(spark, f"{folder}/db")
    db.create_table("events", "user_id", "big_integer", EVENT_TYPES)
    for part in ("event_id < 3000", "event_id >= 3000"):
        log.where(part).write.mode("append").option("maxRecordsPerFile", 1 << 20).parquet(f"{folder}/in")
        changes = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
        upsert.start(db, "events", changes, ["event_id"], f"{folder}/checkpoint", "gone").awaitTermination()
    db.refresh()
    return db.current("events")


ORDER_TYPES = {"o_custkey": "big_integer", "o_orderstatus": "varchar", "o_totalprice": "double"}


def json_encode_decode(spark, d):
    """orders as JSON objects and back by the strict decoder."""
    body = _t(spark, d, "orders").select("o_orderkey", codec.encode(ORDER_TYPES).alias("body"))
    told = body.select("o_orderkey", codec.decode(F.col("body"), ORDER_TYPES).alias("_d"))
    return told.select("o_orderkey", *[F.col(f"_d.row.{c}").alias(c) for c in ORDER_TYPES], F.col("_d.error").alias("error"))


def json_list(spark, d):
    """customer as the objects of a list, key first."""
    kinds = {"c_name": "varchar", "c_nationkey": "integer", "c_mktsegment": "varchar"}
    return _t(spark, d, "customer").select("c_custkey", codec.encode(kinds, "c_custkey", "big_integer").alias("body"))


def json_strict(spark, d):
    """Why bodies made from orders are refused: a field left out, a number as text, one too large, a text for a number."""
    o = _t(spark, d, "orders")
    body = F.concat(
        F.lit('{"id":'), F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('"'))).when(F.col("o_orderkey") % 4 == 2, F.lit("3000000000")).otherwise(F.col("o_orderkey").cast("string")),
        F.when(F.col("o_orderkey") % 4 == 3, F.lit("")).otherwise(F.lit(',"name":"n"')), F.lit(',"more":[1]}'),
    )
    told = o.select("o_orderkey", codec.decode(body, {"id": "integer", "name": "varchar"}).alias("_d"))
    return told.select("o_orderkey", F.col("_d.row.id").cast("string").alias("id"), F.col("_d.row.name").alias("name"), F.col("_d.error").alias("error"))


def key_parse(spark, d):
    """Keys spelt in several ways: plain, signed, with zeros, with blanks, with letters, beyond 32 bits."""
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("k"))
    forms = ["{}", "+{}", "00{}", " {} ", "{}x", "9{}000000000"]
    text = reduce(lambda out, f: F.when(F.col("k") == f[0], F.concat(*_parts(f[1]))).otherwise(out), enumerate(forms), F.lit(None).cast("string"))
    return o.select("o_orderkey", text.alias("text")).select("o_orderkey", codec.parse_key(F.col("text"), "integer").cast("string").alias("as_integer"), codec.parse_key(F.col("text"), "big_integer").cast("string").alias("as_big_integer"), codec.parse_key(F.col("text"), "varchar").alias("as_varchar"))


def _parts(form: str) -> list:
    before, after = form.split("{}")
    return [F.lit(before), F.col("o_orderkey").cast("string"), F.lit(after)]


BLOOM = bloom.Shape.of(2000, 0.1)


def bloom_membership(spark, d):
    """A filter of the part keys, asked for the customer keys and some beyond: no present key is denied."""
    words = bloom.build(_t(spark, d, "part"), "p_partkey", BLOOM)
    probes = _t(spark, d, "customer").select(F.col("c_custkey").alias("key")).unionByName(_t(spark, d, "customer").select((F.col("c_custkey") + 100000).alias("key")))
    return bloom.contains(probes, "key", words, BLOOM)


def bitmap_words(spark, d):
    """The bitmap of the order keys whose status is F, those of priority 1-URGENT cleared again."""
    o = _t(spark, d, "orders")
    return bitmap.reset(bitmap.build(o.where("o_orderstatus = 'F'"), "o_orderkey"), o.where("o_orderpriority = '1-URGENT'"), "o_orderkey").select("word", F.bit_count("bits").alias("n_set"))


def bitmap_lookup(spark, d):
    words = bitmap.build(_t(spark, d, "orders").where("o_totalprice > 100000"), "o_orderkey")
    return bitmap.is_set(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", words)


def workload_logs(spark, d):
    return workload.logs(spark, 5000).select("id", "level", "message", F.unix_millis("ts").alias("ts_ms"))


def workload_keys(spark, d):
    return workload.sampled_keys(spark, 3000, 1000)


QUERIES = {f.__name__: f for f in (
    point_get, point_get_miss, list_rows, upsert_latest_wins, delete_tombstone_scan, tombstone_count, lineitem_upsert,
    run_merge, run_inventory, block_index, block_seek, multi_get, multi_get_misses, bloom_sizing, duration_hist, duration_us_hist,
    engine_upsert, engine_deleted_list, engine_compacted_list, engine_auto_compaction, engine_point_get, engine_point_get_miss, engine_buffered_list,
    stream_upsert, json_encode_decode, json_list, json_strict, key_parse, bloom_membership, bitmap_words, bitmap_lookup, workload_logs, workload_keys,
)}

_LATEST = "select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k = 1"
_INDEX = """select cast(b as bigint) as block, min(o_orderkey) as first_key, max(o_orderkey) as last_key, count(*) as entries
from (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 4096 as b from orders) group by b"""
_BY_ID = "select * from (select *, row_number() over (partition by user_id order by event_id desc) k from events) where k = 1"
_LISTS = [str(workload.LEVELS), str(workload.MESSAGES)]


def _buckets(value: str, bounds: list[float]) -> str:
    return " ".join(f"when {value} <= {b} then {i}" for i, b in enumerate(bounds))


def _bloom(key: str) -> str:
    return ", ".join(f"('0x' || substr(md5({key} || ':{i}'), 1, 15))::bigint % {BLOOM.n_bits}" for i in range(BLOOM.n_hashes))


_BUCKETS = " ".join(f"when value <= {b} then {i}" for i, b in enumerate(histogram.MILLISECOND_BOUNDS))

ORACLE_SQL = {
    "point_get": "select * from orders where o_orderkey = 42",
    "point_get_miss": "select * from orders where o_orderkey = -1",
    "list_rows": "select * from customer order by c_custkey",
    "upsert_latest_wins": f"select user_id, event_id, event_type, value from ({_LATEST})",
    "delete_tombstone_scan": f"select user_id, event_id, event_type, value from ({_LATEST}) where event_type <> 'error'",
    "tombstone_count": f"select count(*) as tombstones from ({_LATEST}) where event_type = 'error'",
    "lineitem_upsert": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from (
        select *, row_number() over (partition by l_orderkey, l_linenumber
            order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) k from lineitem) where k = 1""",
    "run_merge": f"select user_id, event_id, event_type, value from ({_LATEST}) where event_type <> 'error'",
    "run_inventory": """select event_id // 1000 as run, count(*) as entries, count(distinct user_id) as distinct_keys, min(user_id) as min_key,
        max(user_id) as max_key, count(*) filter (event_type = 'error') as tombstones from events group by 1""",
    "block_index": _INDEX,
    "block_seek": f"""select key, max(first_key) as first_key from (select distinct l_orderkey as key from lineitem)
        join ({_INDEX}) i on i.first_key <= key group by key""",
    "multi_get": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity = 50)",
    "multi_get_misses": """select distinct l_orderkey + 7000 as o_orderkey from lineitem
        where l_orderkey + 7000 not in (select o_orderkey from orders)""",
    "bloom_sizing": """select name, n, cast(floor(x) as bigint) as n_bits, 8 * cast(ceil(floor(x) / 64) as bigint) as n_bytes,
        cast(ceil(x / n * ln(2)) as bigint) as n_hashes from (select *, -n * ln(0.1) / (ln(2) * ln(2)) as x from (
        select 'orders' as name, count(*) as n from orders union all select 'customer', count(*) from customer
        union all select 'part', count(*) from part))""",
    "duration_hist": f"""select cast(case {_BUCKETS} else {len(histogram.MILLISECOND_BOUNDS)} end as int) as bucket, count(*) as n
        from events where value is not null group by 1""",
    "duration_us_hist": f"""select cast(case {_buckets('value * 1000', histogram.MICROSECOND_BOUNDS)} else {len(histogram.MICROSECOND_BOUNDS)} end as int) as bucket, count(*) as n
        from events where value is not null group by 1""",
    "engine_upsert": f"select user_id, event_id, event_type, value from ({_BY_ID})",
    "engine_deleted_list": f"select user_id, event_id, event_type, value from ({_BY_ID}) where event_type <> 'error'",
    "engine_compacted_list": f"select user_id, event_id, event_type, value from ({_BY_ID}) where event_type <> 'error'",
    "engine_auto_compaction": "select count(*) as entries, 1 as level_0_runs, 2 as level_1_runs from part",
    "engine_point_get": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 42",
    "engine_point_get_miss": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = -1",
    "engine_buffered_list": """select n_nationkey, case when n_nationkey < 10 then 'name ' || n_nationkey else n_name end as n_name,
        case when n_nationkey < 10 then 9 else n_regionkey end as n_regionkey from nation where n_nationkey <> 24""",
    "stream_upsert": f"select user_id, event_id, event_type, value from ({_BY_ID}) where event_type <> 'error'",
    "json_encode_decode": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(null as varchar) as error from orders",
    "json_list": """select c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey
        || ',"c_mktsegment":"' || c_mktsegment || '"}' as body from customer""",
    "json_strict": """select o_orderkey, case when o_orderkey % 4 = 0 then cast(o_orderkey as varchar) end as id, case when o_orderkey % 4 = 0 then 'n' end as name,
        case o_orderkey % 4 when 1 then 'column id: expected integer' when 2 then 'column id: value out of range for integer' when 3 then 'missing column: name' end as error from orders""",
    "key_parse": """select o_orderkey, case when k < 3 then cast(o_orderkey as varchar) end as as_integer, case when k < 3 then cast(o_orderkey as varchar) when k = 5 then t end as as_big_integer, t as as_varchar from (
        select o_orderkey, k, case k when 0 then '' || o_orderkey when 1 then '+' || o_orderkey when 2 then '00' || o_orderkey when 3 then ' ' || o_orderkey || ' ' when 4 then o_orderkey || 'x'
        else '9' || o_orderkey || '000000000' end as t from (select o_orderkey, o_orderkey % 6 as k from orders))""",
    "bloom_membership": f"""with places as (select distinct p from (select unnest([{_bloom('p_partkey')}]) as p from part)),
        keys as (select distinct key from (select c_custkey as key from customer union all select c_custkey + 100000 from customer)),
        asked as (select key, unnest([{_bloom('key')}]) as p from keys)
        select key, bool_and(places.p is not null) as maybe from asked left join places on asked.p = places.p group by key""",
    "bitmap_words": """select o_orderkey // 64 as word, cast(count(distinct o_orderkey) as int) as n_set from orders where o_orderstatus = 'F'
        and o_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT') group by 1""",
    "bitmap_lookup": "select o_orderkey, o_orderkey in (select o_orderkey from orders where o_totalprice > 100000) as is_set from orders",
    "workload_logs": f"select range as id, {_LISTS[0]}[range % 3 + 1] as level, {_LISTS[1]}[range % 10 + 1] as message, range as ts_ms from range(5000)",
    "workload_keys": f"select range as id, (range * {workload.MULTIPLIER} + {workload.INCREMENT}) % 1000 as key from range(3000)",
}

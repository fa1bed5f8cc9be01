"""Strict JSON, key text, bloom filters and bitmaps."""

import pytest
from pyspark.sql import functions as F

from keystrata.functions import codec
from keystrata.operators import bitmap, bloom

COLUMNS = {"b": "boolean", "i": "integer", "l": "big_integer", "f": "float", "d": "double", "s": "varchar", "t": "timestamp"}
GOOD = {"b": "true", "i": "1", "l": "9223372036854775807", "f": "1.5", "d": "1", "s": '"x"', "t": "5"}


def body(**changes):
    cells = {k: v for k, v in (GOOD | changes).items() if v is not None}
    return "{" + ", ".join(f'"{k}": {v}' for k, v in cells.items()) + "}"


CASES = [
    (body(), None), (body(more="[1, {}]"), None), (body(f="3", d="-2.5e3"), None), (body(d="123456789012345678901234567890"), None),
    (body(i=None), "missing column: i"), (body(s=None), "missing column: s"), (body(i="null"), "column i: expected integer"), (body(s="null"), "column s: expected varchar"),
    (body(i="3.0"), "column i: expected integer"), (body(i='"5"'), "column i: expected integer"), (body(i="3000000000"), "column i: value out of range for integer"),
    (body(l="9223372036854775808"), "column l: expected big_integer"), (body(s="5"), "column s: expected varchar"), (body(s="true"), "column s: expected varchar"),
    (body(s="{}"), "column s: expected varchar"), (body(b='"true"'), "column b: expected boolean"), (body(b="1"), "column b: expected boolean"), (body(d='"1"'), "column d: expected double"),
    (body(t="1.5"), "column t: expected timestamp"), (body(t='"2024-01-01"'), "column t: expected timestamp"), ("[1]", "body is no JSON object"), ("{", "body is no JSON object"), (None, "body is no JSON object"),
]


def test_decoding_is_strict(spark):
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "k int, body string")
    got = {r.k: r for r in df.select("k", codec.decode(F.col("body"), COLUMNS).alias("d")).select("k", "d.error", "d.row", F.unix_micros("d.row.t").alias("t")).collect()}
    assert {k: r.error for k, r in got.items()} == {k: e for k, (_, e) in enumerate(CASES)}
    assert all((r.row is None) == (r.error is not None) for r in got.values())
    row = got[0].row
    assert (row.b, row.i, row.l, row.f, row.d, row.s, got[0].t) == (True, 1, (1 << 63) - 1, 1.5, 1.0, "x", 5)


def test_names_with_marks(spark):
    df = spark.createDataFrame([('{"a.b": 1, "it\'s": "y"}',)], "body string")
    assert df.select(codec.decode(F.col("body"), {"a.b": "integer", "it's": "varchar"}).alias("d")).first().d.row.asDict() == {"a.b": 1, "it's": "y"}


def test_encoding(spark):
    df = spark.sql("select 7 as id, true as b, 1 as i, 2L as l, float(1.5) as f, 2.0D as d, 'é\"' as s, timestamp_micros(-5) as t")
    assert df.select(codec.encode(COLUMNS).alias("x")).first().x == '{"b":true,"i":1,"l":2,"f":1.5,"d":2.0,"s":"é\\"","t":-5}'
    assert df.select(codec.encode({"i": "integer"}, "id", "integer").alias("x")).first().x == '{"id":7,"i":1}'


def test_keys(spark):
    texts = {"12": 12, "+5": 5, "-7": -7, "007": 7, " 12 ": None, "12x": None, "": None, "-": None, "3.0": None, "2147483648": None, "1\n": None, "٣": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.k for r in df.select("t", codec.parse_key(F.col("t"), "integer").alias("k")).collect()} == texts
    assert df.select(codec.parse_key(F.lit("2147483648"), "big_integer").alias("k")).first().k == 1 << 31
    assert df.select(F.unix_micros(codec.parse_key(F.lit("-9223372036854775808"), "timestamp")).alias("k")).first().k == -(1 << 63)
    assert df.select(codec.parse_key(F.lit(" a "), "varchar").alias("k")).first().k == " a "


def test_false_positives(spark):
    shape = bloom.Shape.of(10_000, 0.1)
    assert (shape.n_bits, shape.n_hashes) == (47_925, 4) and bloom.Shape.of(100_000, 0.2).n_hashes == 3
    words = bloom.build(spark.range(10_000), "id", shape)
    assert bloom.contains(spark.range(10_000), "id", words, shape).where("not maybe").count() == 0
    hits = bloom.contains(spark.range(10_000, 110_000), "id", words, shape).where("maybe").count()
    assert abs(hits / 100_000 - 0.1) < 0.01
    with pytest.raises(ValueError):
        bloom.Shape.of(0, 0.1)


def test_bitmaps(spark):
    places = lambda *x: spark.createDataFrame([(k,) for k in x], "p long")
    words = bitmap.put(bitmap.build(places(0, 3, 63), "p"), places(64, 700), "p")
    asked = places(0, 1, 3, 63, 64, 65, 700, 9000)
    told = lambda w: {r.p for r in bitmap.is_set(asked, "p", w).where("is_set").collect()}
    assert told(words) == {0, 3, 63, 64, 700} and bitmap.cardinality(words).first().n == 5
    assert told(bitmap.reset(words, places(3, 64, 9000), "p")) == {0, 63, 700}
    assert bitmap.sizes(12) == (1, 8) and bitmap.sizes(800) == (13, 104)

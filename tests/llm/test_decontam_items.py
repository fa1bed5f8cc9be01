"""Benchmarks with repeated rows and with items that share words."""

from keystrata.llm import decontam

ITEMS = "item_id string, text string"
DOCS = "doc_id long, text string"


def prose(name, n=20):
    return " ".join(f"{name}{k}" for k in range(n))


def test_items_of_one_id_count_as_one(spark):
    bench = spark.createDataFrame([("a", prose("a")), ("a", prose("a")), ("b", prose("b"))], ITEMS)
    docs = spark.createDataFrame([(1, prose("a")), (2, prose("a") + " " + prose("b")), (3, prose("c"))], DOCS)
    assert sorted(r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()) == [1, 3]
    for size in (300, 1 << 24):
        found = decontam.find_matches(docs, bench, ["doc_id"], block_bytes=size).collect()
        assert {r.doc_id: sorted(r._item_ids) for r in found} == {1: ["a"], 2: ["a", "b"], 3: []}

"""Rows of one id or of none are rows of their own."""

from keystrata.llm import ngramjoin

SCHEMA = "doc_id long, text string"


def prose(name, end=""):
    return " ".join(f"{name}{k}" for k in range(40)) + end


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in ngramjoin.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


def test_rows_of_one_id_go_by_their_own_text(spark):
    rows = [(1, prose("a")), (2, prose("a", " more")), (2, prose("b")), (3, prose("c")), (3, prose("d")), (4, prose("e")), (4, prose("f", " more")), (5, prose("f"))]
    assert kept(spark, rows) == sorted([(1, prose("a")), (2, prose("b")), (3, prose("c")), (3, prose("d")), (4, prose("e")), (4, prose("f", " more"))], key=str)
    told = {(r.n_links, r.group_id) for r in ngramjoin.join_classes(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 2").collect()}
    assert told == {(1, 1), (0, 2)}


def test_rows_without_an_id_are_compared_too(spark):
    rows = [(None, prose("a")), (None, prose("a")), (None, prose("b")), (7, prose("b", " more")), (None, prose("c")), (None, prose("c", " more")), (None, ""), (None, "")]
    left = kept(spark, rows)
    assert len(left) == 5 and left.count((None, "")) == 2 and left.count((None, prose("a"))) == 1 and (7, prose("b", " more")) in left
    assert sum(t.startswith("c0") for _, t in left) == 1
    links = [r.n_links for r in ngramjoin.join_classes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(links) == [0, 0, 1, 1, 1, 1, 1, 1]

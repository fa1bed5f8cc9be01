"""The banded join against all pairs, on whole texts of a driver table and on planted copies."""

import re

from keystrata.llm import ngramjoin

DOCS = "/root/testdata/sf0.001/documents.parquet"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_links_equal_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    sets = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = {i: sum(bool(s and x) and k != i and len(s & x) >= 0.8 * len(s | x) for k, x in sets) for i, s in sets}
    assert sum(want.values()) > 0
    for exact in (False, True):
        assert {r.doc_id: r.n_links for r in ngramjoin.join_classes(docs, exact=exact).collect()} == want


def test_copies_at_the_threshold_are_found(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(f"d{k}{w}" for w in base)) for k in range(40)] + [(100 + k, " ".join([f"d{k}{w}" for w in base[:-6]])) for k in range(40)]
    got = ngramjoin.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_links == 1 for r in got)

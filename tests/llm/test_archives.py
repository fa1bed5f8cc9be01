"""Archives of awkward pages: equal and missing ids, no rows, and each record by the index."""

import base64
import hashlib
from collections import Counter

from keystrata.llm import store, warc

PAGES = "page_id long, url string, html string"
ROWS = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, "v", "a"), (None, None, "b"), (None, "w", "b"), (7, "x", None), (5, "y", ""), (9, "z", "é" * 2000), (3, "l\r\nX: y", "only")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    out = Counter()
    for text in {r[2] or "" for r in rows}:
        ids = sorted((r[0] for r in rows if (r[2] or "") == text), key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            out[i, len(text.encode()), digest(text), "revisit" if k else "response", ids[0] if k else None] += 1
    return out


def test_the_smallest_id_is_the_response(spark):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    got = warc.archive_round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(ROWS)
    assert len({r.record_id for r in got}) == len(ROWS)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = warc.archive_round_trip(spark.createDataFrame(ROWS, PAGES), least_bytes=2).collect()
    assert sum(r.record_type == "revisit" for r in got) == 0


def test_each_record_is_found_by_the_index(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k % 7}</p>" * 50) for k in range(60)], PAGES).repartition(2)
    folder = store.run_dir(spark, "warc-test")
    index = warc.write_archives(warc.with_types(pages), folder, frame_bytes=2000)
    for entry in index.collect():
        headers, payload = warc.lookup(folder, entry)
        assert headers["WARC-Record-ID"] == entry.record_id and headers["X-Page-Id"] == str(entry.page_id)
        if headers["WARC-Type"] == "response":
            assert payload.decode() == f"<p>{entry.page_id % 7}</p>" * 50
    assert index.select("frame_at").distinct().count() > 2

"""The longest verbatim match over all items, against a plain search."""

import numpy as np
import pyarrow as pa

from keystrata.llm import decontam
from keystrata.llm import textvec as tv


def longest(doc, items):
    """(words, place, first item): the longest, then leftmost, match of a window of eight words or a whole shorter item."""
    best = (0, -1, -1)
    for d in range(len(doc)):
        for k, item in enumerate(items):
            for t in range(len(item)):
                n = 0
                while t + n < len(item) and d + n < len(doc) and item[t + n] == doc[d + n]:
                    n += 1
                if n >= 8 or (len(item) < 8 and t == 0 and n == len(item)):
                    best = max(best, (n, d, k), key=lambda x: (x[0], -x[1] if x[0] else 0, -x[2]))
    return best


def found(docs, items):
    raw, offsets = tv.column_bytes(pa.array([" ".join(x) for x in docs]))
    bench = decontam.build_benchmark(list(range(len(items))), [" ".join(x) for x in items])
    h = decontam.match_shard(raw, offsets, bench)
    return list(zip(h.longest.tolist(), h.longest_at.tolist(), h.longest_item.tolist()))


def test_items_that_share_their_first_words():
    start = [f"s{k}" for k in range(30)]
    items = [start + [f"{x}{k}" for k in range(30)] for x in "abc"]
    docs = [["x", *items[1], "y"], items[2], [*start, "z"], ["q"]]
    assert found(docs, items) == [(60, 1, 1), (60, 0, 2), (30, 0, 0), (0, -1, -1)]


def test_longest_match_equals_a_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = lambda n: [f"w{k}" for k in rng.integers(0, 2, n)]
        items = [text(n) for n in (3, 7, 8, 12, 25, 25, 40)]
        docs = [text(30), items[4][2:] + text(5), text(4) + items[6] + items[0], text(2) + ["other"] + items[5]]
        assert found(docs, items) == [longest(d, items) for d in docs]
    assert found([["w1", "w2"]], []) == [(0, -1, -1)] and found([["w1", "w2"]], [["w2"], []]) == [(1, 1, 0)]

"""Connected components: right on shapes of every kind, with about one edge a vertex in each round."""

import random

from keystrata.llm import components as module


def plain(edges):
    root = {v: v for e in edges for v in e if e[0] != e[1]}
    while True:
        before = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_a_group_of_many_shared_neighbours_joins_few_rows(spark, monkeypatch):
    rng = random.Random(4)
    group = [(1000 + v, rng.randrange(40)) for v in range(300) for _ in range(30)]
    edges = [*group, *((k, k + 1) for k in range(5000, 5040)), (0, 1000), (9000, 9000), (9001, 9002), (9002, 9001)]
    made, write = {}, module.materialise

    def counted(df, name):
        out = write(df, name)
        made.setdefault(name, out.count())
        return out

    monkeypatch.setattr(module, "materialise", counted)
    want = plain(edges)
    got = {r.v: r.root for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert made["edges"] <= 4 * len(want)  # both directions; as given there are some 40 a vertex

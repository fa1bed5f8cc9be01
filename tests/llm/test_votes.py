"""The vote against a plain one, and training texts that share an id."""

import numpy as np

from keystrata.llm import quality


def rows(texts):
    data = [t.encode() for t in texts]
    return quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_vote_equals_a_plain_one():
    texts = [f"plain words number {i} in a line of prose, {'good' * (i % 3)}." if i % 2 else f"#{i} $$ %% {'JUNK ' * (i % 7)}" for i in range(90)]
    x, y = rows(texts), np.arange(90) % 2
    model = quality.fit(x[:60], y[:60])
    got = quality.vote(model, x[60:])
    for k, row in enumerate(x[60:]):
        v = ((row - model.mean) * model.scale) @ model.basis
        near = [float(v @ w / max(np.linalg.norm(v), 1e-12)) for w in model.vectors]
        best = sorted(range(60), key=lambda j: -near[j])[: quality.NEIGHBOURS]
        weight = [max(near[j], 1e-6) ** 4 for j in best]
        assert abs(got[k] - sum(w * model.labels[j] for w, j in zip(weight, best)) / sum(weight)) < 1e-3


def test_texts_that_share_an_id(spark):
    texts = [(i % 5, f"text {i} " + "word " * i) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    one, two = (quality.train(spark.createDataFrame(t, "doc_id long, text string").repartition(n), labels) for t, n in ((texts, 1), (texts[::-1], 4)))
    assert len(one.labels) and (one.vectors == two.vectors).all() and (one.labels == two.labels).all()

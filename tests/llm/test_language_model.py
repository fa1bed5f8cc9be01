"""The language model: normalised, scored as plain Python scores it, the same in blocks, better than the unigram."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import lm
from keystrata.llm import textvec as tv

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(150)]
    verbs = [f"v{i}" for i in range(150)]
    texts = [" ".join(w for _ in range(40) for w in ("the", rng.choice(names), "will", rng.choice(verbs))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate([*texts, None, "", "neverSeen the n1", texts[0]])] + [(None, "the n1", "x"), (3, texts[3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, _text string").repartition(3).cache()


def test_scores_equal_a_plain_version(table):
    model, vectors, top, n, v, texts = lm.learn(table.select(F.col("text").alias("_text"), lm.held_out(F.col("doc_id")).alias("o")).where("not o"))
    known = {r.h % (1 << 64): (r.c, np.array([r.d0, r.d1]).view("<f2").astype(float)) for r in vectors.union(top).collect()}
    k = model.classes
    assert len(known) == v - 1

    def cls(h):
        return int(lm.classes_of(np.array([h], np.uint64), k.ranked, k.ranked_class)[0])

    def inside(h, c, kind):
        count, d = known.get(h, (0, np.zeros(lm.AXES + 1)))
        return 0.0 if c < lm.END else float(k.log_share(np.array([c]), np.array([count]))[0] + model.x[kind] @ d - model.log_z[c, kind])

    def plain(text):
        far = before = lm.START
        out = 0.0
        for w in [*WORD.findall(text or ""), None]:
            h = None if w is None else tv.one_hash("".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in w))
            c = lm.END if w is None else cls(h)
            out += float(model.logs[before * lm.KINDS + lm.KIND_OF[far], c]) + (0.0 if w is None else inside(h, c, lm.KIND_OF[before]))
            far, before = before, c
        return out / lm.LN10

    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in lm.score(table).collect())
    want = sorted((-1 if r.doc_id is None else r.doc_id, plain(r.text)) for r in table.collect())
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=0.02)
    assert np.allclose(np.exp(model.logs).sum(axis=1), 1, atol=1e-4)
    for kind in (0, 3, 48, 50):
        total = {}
        for h in known:
            total.setdefault(cls(h), []).append(np.exp(inside(h, cls(h), kind)))
        for c, parts in total.items():
            never = np.exp(inside(-1, c, kind)) if c >= lm.RARE0 else 0.0
            assert c < lm.END or sum(parts) + never == pytest.approx(1, abs=1e-6)


def test_blocks_agree(table, monkeypatch):
    one = sorted((-1 if r.doc_id is None else r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in lm.score(table).collect())
    monkeypatch.setattr(lm, "BLOCK", 100)
    many = sorted((-1 if r.doc_id is None else r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in lm.score(table).collect())
    assert [x[:3] for x in one] == [x[:3] for x in many] and np.allclose([x[3] for x in one], [x[3] for x in many], atol=0.01)


def test_held_out_texts_gain_over_the_unigram(table):
    score, base = lm.score(table).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.85 * base


def test_word_vectors_follow_the_words_before():
    n = np.zeros((2, lm.KINDS))
    n[0, 0], n[1, 1] = 400, 400
    after = np.zeros((lm.CLASSES, lm.KINDS))
    after[lm.BAND0, :2] = 400
    x = lm.features(np.cov(n.T), after[lm.BAND0] / 800)
    cls = np.full(2, lm.BAND0)
    d = lm.fit_words(n, cls, np.log(np.full(2, 0.5)), after, x)
    said = d @ x[:2].T
    assert said[0, 0] > said[0, 1] + 1 and said[1, 1] > said[1, 0] + 1

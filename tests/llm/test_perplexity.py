"""The Kneser-Ney model against a plain one, and in several blocks."""

import math
from collections import Counter

from keystrata.llm import rules

SCHEMA = "doc_id long, text string, lang string"
ROWS = [(1, "the cat sat on the mat. the cat ran.", "en"), (2, "the dog sat on the log and the mat", "en"), (3, "le chat est là, le chien est là", "fr"), (4, "", "fr"), (5, None, None), (6, "aaaa aaaa", None), (7, "é", "en")]


def plain(rows, order):
    """Mean loss a byte of each text by modified Kneser-Ney, from dictionaries."""
    grams = {k: [tuple([0] * (order - 1) + list((t or "").encode()))[i : i + order] for i in range(len((t or "").encode()))] for k, t, _ in rows}
    out = {}
    for lang in {x for _, _, x in rows}:
        own = [k for k, _, x in rows if x == lang]
        counts = [Counter(g for k in own for g in grams[k])]
        for _ in range(order - 1):
            counts.append(Counter(g[1:] for g in counts[-1]))
        p = {}
        for level in reversed(counts):
            n = [max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [0] + [min(k, max(0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
            total, back = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                back[g[:-1]] += d[min(c, 3)]
            p = {g: max(0, c - d[min(c, 3)]) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * p.get(g[1:], 1 / 256) for g, c in level.items()}
        for k in own:
            out[k] = -sum(math.log(p[g]) for g in grams[k]) / max(1, len(grams[k]))
    return out


def test_perplexity_equals_a_plain_model(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    want = plain(ROWS, rules.ORDER)
    for block, held in ((rules.BLOCK, rules.HELD), (40, 20)):
        monkeypatch.setattr(rules, "BLOCK", block)
        monkeypatch.setattr(rules, "HELD", held)
        got = {r.doc_id: r.log_perplexity for r in rules.judge(docs).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_text_unlike_its_language_is_rejected(spark):
    words = ["water", "house", "under", "river", "stone", "small", "light", "green"]
    rows = [(k, " ".join(words[(k * i + i * i) % 8] for i in range(80 + k % 7)) + f" {k}", "en") for k in range(60)]
    rows += [(100, " ".join(f"x{k * k % 97}q{k}zj" for k in range(80)), "en")]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[100].base_failed and not got[100].kept and got[100].log_perplexity > got[100].band_high

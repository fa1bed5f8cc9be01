"""The grouping genetic algorithm where best fit is not enough."""

import numpy as np
import public_tokenizers

from keystrata.llm import packing


def triplets(n, capacity, seed):
    """3 n sizes that fill n bins to the brim."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(capacity * 38 // 100, capacity // 2))
        b = int(rng.integers((capacity - a) // 2 * 80 // 100, (capacity - a) // 2))
        out += [a, b, capacity - a - b]
    return out


def valid(bins, sizes, capacity):
    return sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in bins)


def test_crossover_gains_over_best_fit():
    gained = 0
    for seed in range(4):
        sizes = triplets(40, 1000, seed)
        first = packing.first_packing(sizes, 1000)
        best = packing.breed(sizes, 1000, seed, generations=150)
        assert valid(first, sizes, 1000) and valid(best, sizes, 1000) and len(best) <= len(first)
        gained += len(first) - len(best)
    assert gained > 0


def test_elites_are_kept():
    sizes = triplets(20, 1000, 9)
    perfect = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(20)]
    assert len(packing.breed(sizes, 1000, 1, elite=[perfect], generations=1)) == 20


def test_chunks_and_islands(spark, monkeypatch):
    """Several chunks, islands and rounds: every piece once, gapless, and no more sequences than best fit alone needs."""
    monkeypatch.setattr(packing, "CHUNK", 60)
    names = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(k, " a" * int(n)) for k, n in enumerate(rng.integers(10, 45, 300))], "doc_id long, text string")
    got = packing.pack(docs, *names, capacity=100).toPandas()
    assert sorted(got.doc_id) == list(range(300))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 100 and (g.offset == g.length.cumsum() - g.length).all()
    chunks = [got.sort_values("doc_id").length.tolist()[k : k + 60] for k in range(0, 300, 60)]
    assert got.sequence_id.nunique() <= sum(len(packing.first_packing(c, 100)) for c in chunks) + 2

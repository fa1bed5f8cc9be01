"""The pipeline's stages against plain versions, each on its own input; shards recomputed; odd and empty tables."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from keystrata.llm import decontam, linededup, ngramjoin, quality, sharding
from keystrata.llm.store import materialise

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), name))
    assert all(d.columns == docs.columns for d in out[1:-1])
    return [d.toPandas() for d in out]


def test_quality_stage(spark, steps):
    told = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert sorted(steps[1].doc_id) == sorted(told.doc_id[told.predicted == 1])


def test_line_stage(steps):
    want, seen = {}, []
    for r in steps[1].sort_values("doc_id").itertuples():
        kept, own = [], (r.text or "").split("\n")
        for line in own:
            w = frozenset(line.lower().split())
            if not w or not any(4 * max(len(w), len(x)) <= 5 * min(len(w), len(x)) and 5 * len(w & x) >= 4 * len(w | x) for x in seen):
                kept.append(line)
            if w:
                seen.append(w)
        if len(kept) == len(own) or words("\n".join(kept)):
            want[r.doc_id] = "\n".join(kept)
    assert dict(zip(steps[2].doc_id, steps[2].text)) == want


def test_near_duplicate_stage(steps):
    rows = sorted((i, words(t)) for i, t in zip(steps[2].doc_id, steps[2].text))
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) for i, w in rows]
    root = {i: i for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {v: low if r == high else r for v, r in root.items()}
    assert sorted(steps[3].doc_id) == sorted(set(root.values()))


def test_benchmark_stage(spark, steps):
    def tokens(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))

    items = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = tokens(r.text)
        size = min(8, len(w))
        items.setdefault(r.item_id, set()).update(" ".join(w[k : k + size]) for k in range(len(w) - size + 1) if size)

    def hits(text):
        own = f" {' '.join(tokens(text))} "
        return sum(any(f" {x} " in own for x in windows) for windows in items.values())

    assert sorted(steps[4].doc_id) == sorted(i for i, t in zip(steps[3].doc_id, steps[3].text) if hits(t) < 2)


def test_packing_stage(steps):
    assert set(steps[5].doc_id) == set(steps[4].doc_id)
    for _, g in steps[5].sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()


def test_shards_recomputed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = sorted((r.doc_id, len((r.text or "").encode()) + 16) for r in docs.collect())
    total, before, slots, want = sum(s for _, s in sizes), 0, Counter(), {}
    for i, size in sizes:
        shard = (2 * before + size) * 40 // (2 * total)
        want[i], before = (size, shard, slots[shard]), before + size
        slots[shard] += 1
    assert {r.doc_id: (r["size"], r.shard, r.slot) for r in sharding.assign_shards(docs, 40).collect()} == want


CLASH = "_id long, _text string, _score double, _gone string, _rid long, _c0 string"


def test_clashing_names_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten"
    schema = f"doc_id long, text string, {CLASH}"
    docs = spark.createDataFrame([(1, text, 1, "a", 0.5, "b", 2, "c"), (2, "other words stand in this line", 3, None, None, None, None, None), (None, None, 1, "a", 0.5, "b", 2, "c")], schema)
    bench = spark.createDataFrame([(1, text), (2, text)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rest = {tuple(r) for r in docs.collect() if r.doc_id != 1}
    nothing = spark.createDataFrame([], schema)
    for stage in (linededup.drop_lines, ngramjoin.keep_one, lambda d: decontam.remove_contaminated(d, bench), lambda d: quality.keep_good(d, labels)):
        assert stage(docs).columns == docs.columns and stage(nothing).count() == 0
    assert {tuple(r) for r in ngramjoin.keep_one(docs).collect()} == {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in decontam.remove_contaminated(docs, bench).collect()} == rest

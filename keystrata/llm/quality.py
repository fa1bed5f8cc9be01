"""Quality classifier: similarity-weighted votes of labelled latent-semantic vectors.

A bounded sample of labelled rows (``SAMPLE``, the rows of lowest id hash) fits
the feature weights, a truncated SVD and the labelled vectors.  These are
broadcast: their size is fixed by SAMPLE, FEATURES and RANK.  Every document is
then turned into its vector and compared with all labelled ones by blocked
matrix products, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

SAMPLE = 4000  # labelled rows used at most
GRAMS = 1024  # hashed byte bigrams, word-shape blind to language names
SHAPES = 16
FEATURES = GRAMS + SHAPES
RANK = 32
NEIGHBOURS = 25
THRESHOLD = 0.7
BLOCK = 512  # documents in one product

_UPPER, _LOWER, _DIGIT = (tv.byte_set(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
_HIGH, _LINE = tv.byte_set(range(128, 256)), tv.byte_set({10})
_MARK = tv.byte_set(b"!?#*$%&|<>@_=+/\\~^{}[]()")
_STOP = tv.byte_set(b".,;:")


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers per text; an empty text is all zero but for the constant."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((n, FEATURES), np.float32)
    doc = np.repeat(np.arange(n), sizes)
    if len(raw) > 1:
        low = tv.lower_ascii(raw)
        gram = (tv.mix(low[:-1].astype(np.uint64) * np.uint64(256) + low[1:]) % np.uint64(GRAMS)).astype(np.int64)
        inside = doc[:-1] == doc[1:]
        counts = np.bincount((doc[:-1] * GRAMS + gram)[inside], minlength=n * GRAMS)
        out[:, :GRAMS] = np.sqrt(counts.reshape(n, GRAMS) / np.maximum(1, sizes)[:, None])
    share = lambda table: np.bincount(doc[table[raw]], minlength=n) / np.maximum(1, sizes)
    starts, ends, hashes, first = tv.words(raw, offsets, tv.NOT_SPACE)
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    distinct = lambda keys, where: _distinct(keys, where, n)
    s, e = tv.spans(~_LINE[raw], offsets)
    lines = np.searchsorted(s, offsets)
    line_of = np.repeat(np.arange(n), np.diff(lines))
    line_hash = tv.hash_spans(raw, s, e)
    at, tri = tv.windows(hashes, first, 3)
    n_lines, n_tri = np.diff(lines), np.bincount(of[at], minlength=n)
    shape = [
        np.ones(n), np.log1p(sizes) / 10, share(_UPPER), share(_LOWER), share(_DIGIT), share(_HIGH), share(_MARK), share(_STOP),
        np.bincount(of, ends - starts, minlength=n) / np.maximum(1, words) / 10,
        distinct(hashes, of) / np.maximum(1, words), distinct(line_hash, line_of) / np.maximum(1, n_lines),
        distinct(tri, of[at]) / np.maximum(1, n_tri), np.log1p(n_lines) / 8, np.log1p(words) / 10,
        np.minimum(1, words / np.maximum(1, n_lines) / 50), words == 0,
    ]
    out[:, GRAMS:] = np.stack(shape, axis=1)
    return out


def _distinct(keys: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys in each document, told apart by a hash of both."""
    if not len(keys):
        return np.zeros(n)
    _, at = np.unique(tv.mix(keys + tv.mix(where.astype(np.uint64))), return_index=True)
    return np.bincount(where[at], minlength=n)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray  # unit rows
    labels: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = 1 / np.maximum(spread, 1e-4)
    scale[:GRAMS] *= 0.25  # the many bigrams together weigh about as much as the few shapes
    _, _, v = np.linalg.svd((x - mean) * scale, full_matrices=False)
    basis = v[:RANK].T.astype(np.float32)
    return Model(mean, scale.astype(np.float32), basis, _unit(((x - mean) * scale) @ basis), labels.astype(np.float32))


def vote(model: Model, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest; 0.5 where there are none."""
    k = min(k, len(model.labels))
    if not k:
        return np.full(len(x), 0.5)
    near = _unit(((x - model.mean) * model.scale) @ model.basis) @ model.vectors.T
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** 4
    return (weight * model.labels[best]).sum(axis=1) / weight.sum(axis=1)


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of their id."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = own.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = "_id long, _y int, _x array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tv.column_bytes(batch.column("_text"))
            for a, b in tv.slices(offsets):
                x = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                ends = pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y").cast(pa.int32()), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["_id", "_y", "_x"])

    joined = texts.join(F.broadcast(chosen), "_id").select("_id", F.col("_y").cast("int").alias("_y"), "_text")  # at most `sample` rows
    # Of texts that share an id the one of least features is taken, whatever the order of rows.
    rows = joined.mapInArrow(run, schema).groupBy("_id").agg(F.min(F.struct("_y", "_x")).alias("_r")).select("_id", "_r._y", "_r._x").toArrow()
    order = np.argsort(rows.column("_id").to_numpy())
    x = rows.column("_x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)[order]
    return fit(x, rows.column("_y").to_numpy()[order]) if len(x) else Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32), np.zeros((0, RANK), np.float32), np.zeros(0, np.float32))


def with_score(docs: DataFrame, model: Model, text_col: str, score_col: str) -> DataFrame:
    """docs and a score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"`{score_col}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            raw, offsets = tv.column_bytes(batch.column(names.index(text_col)))
            scores = [np.zeros(0)]
            for a, b in tv.slices(offsets, 1 << 21):
                for c in range(a, b, BLOCK):
                    d = min(b, c + BLOCK)
                    scores.append(vote(own, features(raw[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null texts count as empty and are scored like them; repeated rows each get a
    result; other columns are ignored; an empty table gives no rows; without
    usable labels every score is 0.5.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return with_score(slim, model, "_text", "_score").select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects; the same columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    scored = with_score(plain, model, f"_c{docs.columns.index(text_col)}", "_score")
    return scored.where(F.col("_score") >= threshold).drop("_score").toDF(*docs.columns)

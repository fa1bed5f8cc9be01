"""Language-model scores: a class-factored log-bilinear model with noise-contrastive estimation.

P(word | context) = P(class | two words before) * P(word | class, word before).

The ``TOP`` most frequent words are classes of their own, the end of a text is
one, the next words up to rank ``RANKED`` form ``BANDS`` classes by rank and all
others ``RARE`` classes by hash.  Over classes the model is log-bilinear in the
two classes before (the farther one by its kind, ``KINDS`` of them); numpy trains
it on the corpus-wide table of class triples, whose size is fixed.

Inside a class every training word has a vector of its own, so what is learnt
grows with the corpus.  Spark counts each word after each kind of word; the
principal axes of those counts are the context features, and each word's vector
is fitted to them against its class's unigram noise.  Given the features the
words are independent, so tasks fit batches of words and no class is in one task.
Both noise terms are summed exactly, not sampled.

Word counts and vectors reach the scoring tasks as sorted hash arrays in blocks of
about ``BLOCK`` words; the texts are read once a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import discard, materialise

TOP, BANDS, RARE, RANKED = 127, 48, 16, 1 << 16
END, BAND0, RARE0 = TOP, TOP + 1, TOP + 1 + BANDS
CLASSES = RARE0 + RARE
START = CLASSES  # the context before the first word
KINDS = 64
DIM, NOISE, STEPS = 24, 10, 200
AXES, PRIOR, NEWTON = 7, 40.0, 6
BLOCK = 2_000_000
LN10 = float(np.log(10))
WORD_ROW = "h long, c long, d0 long, d1 long"  # a word's AXES + 1 vector elements are eight halves, four in each of d0 and d1


def _kinds() -> np.ndarray:
    """The kind of a class as a context: 40 words, 8 groups of words, the start, 11 of bands, 4 of rare classes."""
    c = np.arange(CLASSES + 1)
    kind = np.where(c < 40, c, 40 + (c - 40) * 8 // (TOP - 40))
    kind = np.where(c >= BAND0, 49 + (c - BAND0) * 11 // BANDS, kind)
    kind = np.where(c >= RARE0, 60 + (c - RARE0) * 4 // RARE, kind)
    kind[[END, START]] = 48
    return kind


KIND_OF = _kinds()


def rank_class(ranks: np.ndarray) -> np.ndarray:
    """Class of a word of this rank, 0 the most frequent."""
    band = np.log(np.maximum(ranks, TOP) / TOP) / np.log(RANKED / TOP) * BANDS
    return np.where(ranks < TOP, ranks, BAND0 + np.minimum(band.astype(np.int64), BANDS - 1))


def classes_of(hashes: np.ndarray, ranked: np.ndarray, ranked_class: np.ndarray) -> np.ndarray:
    rare = RARE0 + (hashes % np.uint64(RARE)).astype(np.int64)
    if not len(ranked):
        return rare
    at = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
    return np.where(ranked[at] == hashes, ranked_class[at], rare)


def train(cells: np.ndarray, counts: np.ndarray, dim: int = DIM, noise: int = NOISE, steps: int = STEPS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """ln P(class | class before * KINDS + kind before that), and the table of counts it was trained on.

    ``cells`` are context * CLASSES + class.  A context's vector is the sum of
    one for each of its two words.  Noise-contrastive estimation by Adam with
    exact expectations: the noise is the smoothed unigram distribution.
    """
    rng = np.random.default_rng(seed)
    n = np.zeros(((CLASSES + 1) * KINDS, CLASSES), np.float32)
    n.reshape(-1)[cells] = counts
    total = max(1.0, float(n.sum(dtype=np.float64)))
    unigram = ((n.sum(axis=0, dtype=np.float64) + 1) / (total + CLASSES)).astype(np.float32)
    log_noise = np.log(noise * unigram)
    joint, weight = n / np.float32(total), (n.sum(axis=1, keepdims=True) / np.float32(total)) * (noise * unigram)
    p = [rng.normal(0, 0.1, (CLASSES + 1, dim)), rng.normal(0, 0.1, (KINDS, dim)), rng.normal(0, 0.1, (CLASSES, dim)), np.log(unigram)]
    p = [x.astype(np.float32) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, steps + 1):
        h = (p[0][:, None, :] + p[1][None, :, :]).reshape(-1, dim)
        right = 1 / (1 + np.exp(-np.clip(h @ p[2].T + p[3] - log_noise, -30, 30)))
        pull = joint - (joint + weight) * right
        to_h = (pull @ p[2]).reshape(CLASSES + 1, KINDS, dim)
        for k, g in enumerate((to_h.sum(axis=1), to_h.sum(axis=0), pull.T @ h, pull.sum(axis=0))):
            m[k], v[k] = 0.9 * m[k] - 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - np.float32(0.03) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-10)
    s = (p[0][:, None, :] + p[1][None, :, :]).reshape(-1, dim) @ p[2].T + p[3]
    s -= s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True)), n


class Classes(NamedTuple):
    """What tasks need of the classes: after[class, kind] counts, words and tokens of each class."""

    ranked: np.ndarray
    ranked_class: np.ndarray
    after: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    def log_share(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """ln of a word's smoothed share of its class; a count of 0 is the class's place for words never seen."""
        unseen = cls >= RARE0
        return np.log(c + 1.0) - np.log(self.tokens[cls] + self.words[cls] + unseen)


def fit_words(n: np.ndarray, cls: np.ndarray, log_share: np.ndarray, after: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Vectors d of words, one a row: ln P(word | class, kind) is log_share + x[kind] @ d, less the normaliser.

    For every word noise-contrastive estimation is a convex problem: its counts
    n after each kind against NOISE times the class's own after that kind.  A
    Gaussian prior holds rare words to their share.  Newton's method.
    """
    expected = NOISE * after[cls] * np.exp(log_share)[:, None]
    square = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    d = np.zeros((len(n), x.shape[1]))
    for _ in range(NEWTON):
        right = 1 / (1 + np.exp(-np.clip(d @ x.T - np.log(NOISE), -30, 30)))
        slope = (n - (n + expected) * right) @ x - PRIOR * d
        curve = (((n + expected) * right * (1 - right)) @ square).reshape(len(n), x.shape[1], x.shape[1]) + PRIOR * np.eye(x.shape[1])
        d += np.clip(np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -1.5, 1.5)
    return np.clip(d, -8, 8)


def features(scatter: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """One and the AXES principal axes of the words' deviations, per kind, of unit variance over ``mean``."""
    axes = np.linalg.eigh(scatter)[1][:, ::-1][:, :AXES]
    return np.hstack([np.ones((KINDS, 1)), np.clip(axes / np.sqrt(mean + 1e-6)[:, None], -4, 4)])


def _parts(batch: pa.RecordBatch):
    raw, offsets = tv.column_bytes(batch.column("_text"))
    for a, b in tv.slices(offsets, 1 << 21):
        _, _, hashes, first = tv.words(tv.lower_ascii(raw[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], tv.NOT_SPACE)
        yield batch.slice(a, b - a), hashes, first


def count_words(training: DataFrame) -> DataFrame:
    """(h, c) of every word of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_of = np.concatenate([np.empty(0, np.uint64), *[h for _, h, _ in _parts(batch)]])
            keys, counts = np.unique(all_of, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

    return training.select("_text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _sequence(hashes: np.ndarray, first: np.ndarray, ranked, ranked_class):
    """(document, class triple's context, class, is a word) of every token, the end of each text included."""
    n = len(first) - 1
    sizes = np.diff(first) + 1
    doc, ends = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    own = np.empty(int(sizes.sum()), np.int64)
    is_word = np.ones(len(own), bool)
    is_word[ends] = False
    own[ends], own[is_word] = END, classes_of(hashes, ranked, ranked_class)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[starts] = START
    farther = np.empty_like(own)
    farther[1:] = before[:-1]
    farther[starts] = START
    return doc, before * KINDS + KIND_OF[farther], own, is_word


def gather(training: DataFrame, ranked: np.ndarray, ranked_class: np.ndarray) -> DataFrame:
    """(h, m, n): n of word h after kind m; with m = -1, n of the class triple of cell h."""

    def rows(h, m, n):
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(m, pa.int32()), pa.array(n, pa.int64())], names=["h", "m", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CLASSES + 1) * KINDS * CLASSES, np.int64)
        for batch in batches:
            held, kinds = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for _, hashes, first in _parts(batch):
                _, context, own, is_word = _sequence(hashes, first, ranked, ranked_class)
                np.add.at(table, context * CLASSES + own, 1)
                rest = own[is_word] > END
                held.append(hashes[rest])
                kinds.append(KIND_OF[context[is_word][rest] // KINDS])
            keys, at = np.unique(np.concatenate(held), return_inverse=True)
            both, counts = np.unique(at * KINDS + np.concatenate(kinds), return_counts=True)
            yield rows(keys.view(np.int64)[both // KINDS], both % KINDS, counts)
        at = np.flatnonzero(table)
        yield rows(at, np.full(len(at), -1), table[at])

    return training.select("_text").mapInArrow(run, "h long, m int, n long")


def _counted(batch: pa.RecordBatch, classes: Classes, step: int = 8192):
    """(rows, hashes, counts by kind, classes) of a batch of word lists, in steps of bounded size."""
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        lists = part.column("l")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        n = np.zeros((part.num_rows, KINDS))
        n[np.repeat(np.arange(part.num_rows), sizes), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
        h = part.column("h").to_numpy().view(np.uint64)
        yield part, n, classes_of(h, classes.ranked, classes.ranked_class)


def _sums(df: DataFrame, run, size: int) -> np.ndarray:
    """Sum of the vectors of ``size`` doubles that ``run`` yields, one a task."""

    def emit(batches):
        total = np.zeros(size)
        for x in run(batches):
            total += x.reshape(-1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["i", "x"])

    got = df.mapInArrow(emit, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return out


def learn_words(pairs: DataFrame, classes: Classes) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """WORD_ROW of every word that isn't a class of its own, the features, and ln of the normalisers [class, kind]."""
    # h is the partitioning of both groups, and a word has at most KINDS rows: one shuffle and no heavy key.
    lists = pairs.repartition("h").groupBy("h", "m").agg(F.sum("n").alias("n")).groupBy("h").agg(F.collect_list(F.struct("m", "n")).alias("l"))
    lists = materialise(lists, "lm-lists")
    spark = lists.sparkSession
    told = spark.sparkContext.broadcast(classes)
    mean = classes.after / np.maximum(1, classes.after.sum(axis=1, keepdims=True))

    def scatter(batches):
        for batch in batches:
            for _, n, cls in _counted(batch, told.value):
                e = n.sum(axis=1, keepdims=True) * mean[cls]
                y = (n - e) / np.sqrt(e + 1)
                yield y.T @ y

    x = features(_sums(lists, scatter, KINDS * KINDS).reshape(KINDS, KINDS), classes.after.sum(axis=0) / max(1, classes.after.sum()))

    def fit(batches):
        for batch in batches:
            for part, n, cls in _counted(batch, told.value):
                c = n.sum(axis=1)
                d = fit_words(n, cls, told.value.log_share(cls, c), told.value.after, x).astype("<f2")
                halves = d.view("<i8").T
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(c.astype(np.int64)), pa.array(halves[0].copy()), pa.array(halves[1].copy())], names=["h", "c", "d0", "d1"])

    vectors = materialise(lists.mapInArrow(fit, WORD_ROW), "lm-vectors")
    discard(lists)

    def normalise(batches):
        for batch in batches:
            h, c, d = _arrays(batch)
            cls = classes_of(h, told.value.ranked, told.value.ranked_class)
            out = np.zeros((CLASSES, KINDS))
            for a in range(0, len(h), 8192):
                s = slice(a, a + 8192)
                np.add.at(out, cls[s], np.exp(told.value.log_share(cls[s], c[s])[:, None] + d[s].astype(np.float64) @ x.T))
            yield out

    z = _sums(vectors, normalise, CLASSES * KINDS).reshape(CLASSES, KINDS)
    rare = np.arange(RARE0, CLASSES)
    z[rare] += np.exp(classes.log_share(rare, np.zeros(RARE)))[:, None]
    told.unpersist()
    return vectors, x, np.log(np.where(z > 0, z, 1.0))


def _arrays(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, vectors) of rows WORD_ROW."""
    d = np.stack([rows.column("d0").to_numpy(), rows.column("d1").to_numpy()], axis=1).view("<f2")
    return rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy(), d


def _block(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of one block, about BLOCK of them, as arrays sorted by hash."""
    keys, counts, d = _arrays(table.toArrow())
    order = np.argsort(keys)
    out = keys[order], counts[order], d[order]
    del keys, counts, d
    pa.default_memory_pool().release_unused()
    return out


def held_out(id_col: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Model(NamedTuple):
    classes: Classes
    logs: np.ndarray  # ln P(class | context)
    x: np.ndarray
    log_z: np.ndarray


def learn(training: DataFrame) -> tuple[Model, DataFrame, int, int, int]:
    """The model, the words as WORD_ROW, the numbers of training tokens, of distinct ones and of texts."""
    words = materialise(count_words(training), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    texts = training.count()
    best = words.orderBy(F.desc("c"), "h").limit(RANKED).toArrow()
    h, c = best.column("h").to_numpy().view(np.uint64), best.column("c").to_numpy()
    order = np.argsort(h)
    ranked, ranked_class = h[order], rank_class(np.arange(len(h)))[order]
    top = words.sparkSession.createDataFrame([(int(a), int(b), 0, 0) for a, b in zip(h[:TOP].view(np.int64), c[:TOP])], WORD_ROW)

    def members(batches):
        for batch in batches:
            cls = classes_of(batch.column("h").to_numpy().view(np.uint64), ranked, ranked_class)
            yield np.bincount(cls, minlength=CLASSES)

    in_class = _sums(words, members, CLASSES)
    gathered = materialise(gather(training, ranked, ranked_class), "lm-gathered")
    cells = gathered.where("m < 0").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    logs, n = train(cells.column("h").to_numpy(), cells.column("n").to_numpy())
    by_before = n.reshape(CLASSES + 1, KINDS, CLASSES).sum(axis=1, dtype=np.float64)
    after = np.zeros((KINDS, CLASSES))
    np.add.at(after, KIND_OF, by_before)
    classes = Classes(ranked, ranked_class, after.T.copy(), after.sum(axis=0), in_class)
    vectors, x, log_z = learn_words(gathered.where("m >= 0"), classes)
    discard(words, gathered)
    return Model(classes, logs.astype(np.float32), x, log_z), vectors, top, total + texts, distinct + (1 if texts else 0), texts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end alone.  A null id counts as a training row.
    Repeated rows each count and get a result; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), held_out(F.col(id_col)).alias("held_out"))
    fitted, vectors, top, n, v, texts = learn(slim.where(~F.col("held_out")))
    model = spark.sparkContext.broadcast(fitted)
    end_log = float(np.log10(texts + 1))
    blocks = 1
    while blocks * BLOCK < v:
        blocks *= 2  # a power of two: h is signed in Spark, and its remainder is the same
    table = vectors.unionByName(top)
    out = slim.withColumns({"_sum": F.lit(0.0), "_known": F.lit(0).cast("long"), "_tokens": F.lit(0).cast("long"), "_lm": F.lit(0.0)})
    for b in range(blocks):
        shared = spark.sparkContext.broadcast(_block(table.where(F.pmod("h", F.lit(blocks)) == b)))
        last, read = b == blocks - 1, out
        out = _pass(out, shared, model, b, blocks, last)
        if not last:
            out = materialise(out, "lm-pass")
            shared.destroy()
            if b:
                discard(read)
    discard(vectors)
    return out.select(
        F.col("_id").alias(id_col), "held_out", F.col("_tokens").alias("n_tokens"), (F.col("_known") + (1 if texts else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_sum") + end_log - F.col("_tokens") * float(np.log10(n + v + 1))).alias("base_score"), F.col("_lm").alias("score"),
    )


def _pass(df: DataFrame, shared, model, block: int, blocks: int, last: bool) -> DataFrame:
    """Add the words of one block: log10(c+1) and the part inside the class; in the first pass the part over classes."""
    names = ["_id", "held_out", "_sum", "_known", "_tokens", "_lm"] + ([] if last else ["_text"])
    schema = "_id long, held_out boolean, _sum double, _known long, _tokens long, _lm double" + ("" if last else ", _text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, d = shared.value
        classes, logs, x, log_z = model.value
        features = x.astype(np.float32)
        for batch in batches:
            for part, hashes, first in _parts(batch):
                n = len(first) - 1
                doc, context, own, is_word = _sequence(hashes, first, classes.ranked, classes.ranked_class)
                lm = part.column("_lm").to_numpy()
                if block == 0:
                    lm = lm + np.bincount(doc, logs[context, own] / LN10, minlength=n)
                mine = hashes % np.uint64(blocks) == block
                h, of, cls = hashes[mine], doc[is_word][mine], own[is_word][mine]
                kind = KIND_OF[context[is_word][mine] // KINDS]
                found, inner = np.zeros(len(h), np.int64), np.zeros(len(h), np.float32)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[at] == h
                    found[hit] = counts[at[hit]]
                    inner[hit] = np.einsum("ij,ij->i", d[at[hit]].astype(np.float32), features[kind[hit]])
                inside = np.where(cls > END, classes.log_share(cls, found) + inner - log_z[cls, kind], 0.0)
                lm = lm + np.bincount(of, inside / LN10, minlength=n)
                total = part.column("_sum").to_numpy() + np.bincount(of, np.log10(found + 1.0), minlength=n)
                known = part.column("_known").to_numpy() + np.bincount(of[found > 0], minlength=n)
                cols = [part.column("_id"), part.column("held_out"), pa.array(total), pa.array(known, pa.int64()), pa.array(np.diff(first) + 1, pa.int64()), pa.array(lm)]
                yield pa.RecordBatch.from_arrays(cols + ([] if last else [part.column("_text")]), names=names)

    return df.mapInArrow(run, schema)

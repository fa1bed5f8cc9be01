"""Quality rules: counts of words, symbols and repeats, and bands of n-gram perplexity.

The model is a modified Kneser-Ney model of order ``ORDER`` over UTF-8 bytes, one
for each language value, null too.  Bytes and not words: word trigrams are about
as many as the words of the corpus, and neither their counts nor the look-ups fit
a shuffle of less than the input.  Spark counts the n-grams of all documents and
makes each order's probabilities by joins with the order below, so no task or
driver holds the model as a whole; sorted hash arrays of ``BLOCK`` n-grams reach
the scoring tasks, one pass over the texts each.  A language's band of log
perplexity is [q1 - w*(q3-q1), q3 + w*(q3-q1)] over all its documents of enough
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .store import materialise

ORDER = 5
BLOCK = 4_000_000  # n-grams broadcast at once
HELD = 2_000_000  # distinct n-grams counted in a task before they are given on
BYTES = 8 * ORDER  # the language stands above these bits
WIDTH = 3.0
LEAST_WORDS = 50
SYMBOLS = tv.byte_set(b"#*$%&|<>")
CONTINUATION = tv.byte_set(range(0x80, 0xC0))


def grams(raw: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of each byte with the ORDER - 1 before it (0 before the start); the language stands above."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(raw)) - offsets[:-1][doc]
    code = raw.astype(np.int64)
    for k in range(1, ORDER):
        before = np.zeros(len(raw), np.int64)
        before[k:] = raw[:-k] if len(raw) > k else 0
        before[at < k] = 0
        code |= before << (8 * k)
    return doc, code | (lang[doc] << BYTES)


class HashArray:
    """Values by key: keys' hashes in order, with the place where each of many equal ranges begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = tv.mix(keys.astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.append(values[order], 0.0)
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        ranges = np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift
        self.starts = np.searchsorted(self.hashes[:-1], ranges)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """0 for keys that aren't held."""
        h = tv.mix(keys.astype(np.uint64))
        at = self.starts[h >> self.shift]
        low = np.flatnonzero(self.hashes[at] < h)
        while len(low):
            at[low] += 1
            low = low[self.hashes[at[low]] < h[low]]
        return np.where(self.hashes[at] == h, self.values[at], 0.0)


def _discounts(level: DataFrame) -> DataFrame:
    """_lang, d1, d2, d3: the discounts of a count of one, two and more, from the counts of counts of each language."""
    n = [F.greatest(F.lit(1), F.count_if(F.col("c") == k)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    between = lambda x, most: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), x))
    found = level.groupBy("_lang").agg(*n)
    return found.select("_lang", *[between(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), k).alias(f"d{k}") for k in (1, 2, 3)])


def _level(level: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """level (_lang, g, c) with p, interpolated with the next lower order (256 equal bytes below the first)."""
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = level.join(F.broadcast(_discounts(level)), "_lang").select("_lang", "g", "c", d.alias("d"), F.shiftright("g", 8).alias("context"))  # one row a language
    totals = own.groupBy("_lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("back"))
    own = own.join(totals, ["_lang", "context"])
    if lower is None:
        below = own.withColumn("below", F.lit(1 / 256))
    else:
        below = own.withColumn("short", F.col("g").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))).join(lower.select("_lang", F.col("g").alias("short"), F.col("p").alias("below")), ["_lang", "short"])
    return below.select("_lang", "g", (F.greatest(F.lit(0.0), F.col("c") - F.col("d")) / F.col("total") + F.col("back") / F.col("total") * F.col("below")).alias("p"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(_lang, g, p) of the n-grams of the highest order, from their counts (g, c); lower orders count the n-grams they continue."""
    levels = [materialise(counts.select(F.shiftright("g", BYTES).alias("_lang"), F.col("g").bitwiseAND(F.lit((1 << BYTES) - 1)).alias("g"), "c"), f"grams-{ORDER}")]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("g")
        levels.append(materialise(levels[-1].groupBy("_lang", suffix).agg(F.count("*").alias("c")), f"grams-{order}"))
    p = None
    for order, level in enumerate(reversed(levels), 1):
        p = materialise(_level(level, order, p), f"model-{order}")
    return p


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """_id, _text and the number of the language (from 0, null first) of each row."""
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(lang_col).alias("_name"))
    langs = plain.select("_name").distinct().select(F.col("_name").alias("_n"), (F.row_number().over(Window.orderBy("_name")) - 1).cast("long").alias("_lang"))
    langs = materialise(langs, "languages")
    return plain.join(F.broadcast(langs), F.col("_name").eqNullSafe(F.col("_n"))).select("_id", "_text", "_lang")


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def count_grams(slim: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        give = lambda: pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], names=["g", "c"])
        for batch in batches:
            raw, offsets = tv.column_bytes(batch.column("_text"))
            lang = batch.column("_lang").to_numpy()
            for a, b in tv.slices(offsets, 1 << 22):
                own = np.unique(grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lang[a:b])[1], return_counts=True)
                keys.append(own[0])
                counts.append(own[1])
                if sum(map(len, keys[1:])) > HELD // 2:
                    keys, counts = map(lambda x: [x], _merged(keys, counts))
                if len(keys) == 1 and len(keys[0]) > HELD:
                    yield give()
                    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        keys, counts = map(lambda x: [x], _merged(keys, counts))
        yield give()

    return slim.select("_text", "_lang").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def measures(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    inside = tv.NOT_SPACE[raw]
    starts, ends, hashes, first = tv.words(raw, offsets, tv.NOT_SPACE)
    words = np.diff(first)
    chars = np.bincount(doc[inside & ~CONTINUATION[raw]], minlength=n)
    symbols = np.bincount(doc[SYMBOLS[raw]], minlength=n)
    s, e = tv.spans(raw != 10, offsets)
    line_doc = doc[s] if len(s) else np.empty(0, np.int64)
    has_word = np.searchsorted(starts, e) > np.searchsorted(starts, s)
    keys = tv.mix(tv.hash_spans(raw, s, e) + tv.mix(line_doc.astype(np.uint64)))
    _, firsts = np.unique(keys, return_index=True)
    again = has_word.copy()
    again[firsts] = False
    at, value = tv.windows(hashes, first, 3)
    of = np.repeat(np.arange(n), words)
    _, code, times = np.unique(tv.mix(value + tv.mix(of[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = at[times[code] > 1] if len(at) else at
    hit = np.zeros(len(hashes), bool)
    for k in range(3):
        hit[twice + k] = True
    return [words, chars, symbols, np.bincount(line_doc[again], minlength=n), np.bincount(of[hit], minlength=n)]


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _pass(df: DataFrame, shared, first: bool, last: bool) -> DataFrame:
    """Add one block's part of the loss a byte, and in the first pass the measures; the text goes with the last."""
    kept = ["_id", "_lang", *NAMES, "log_perplexity"] + ([] if last else ["_text"])
    kinds = {"log_perplexity": "double", "_text": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            raw, offsets = tv.column_bytes(batch.column("_text"))
            lang = batch.column("_lang").to_numpy()
            for a, b in tv.slices(offsets, 1 << 21):
                r, o, part = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.slice(a, b - a)
                doc, codes = grams(r, o, lang[a:b])
                loss = -np.bincount(doc, own.get(codes), minlength=b - a) / np.maximum(1, np.diff(o))
                cells = {"_id": part.column("_id"), "_lang": part.column("_lang"), "_text": part.column("_text")}
                if first:
                    cells |= dict(zip(NAMES, (pa.array(m, pa.int64()) for m in measures(r, o))))
                else:
                    cells |= {n: part.column(n) for n in NAMES}
                    loss = loss + part.column("log_perplexity").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(loss) if n == "log_perplexity" else cells[n] for n in kept], names=kept)

    return df.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in kept))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """One row per row of docs with its counts, base_failed, kept, log_perplexity and the band.

    Null texts have no words and fail.  A null language is a language of its own,
    apart from the empty one.
    Repeated rows each get a result; an empty table gives no rows.
    """
    slim = _slim(docs, id_col, text_col, lang_col)
    spark = docs.sparkSession
    model = kneser_ney(count_grams(slim)).select(F.shiftleft("_lang", BYTES).bitwiseOR(F.col("g")).alias("g"), F.log("p").alias("log"))
    size = model.count()
    blocks, out = max(1, -(-size // BLOCK)), slim
    for k in range(blocks):
        rows = model.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == k).toArrow()  # about BLOCK rows
        shared = spark.sparkContext.broadcast(HashArray(rows.column("g").to_numpy(), rows.column("log").to_numpy()))
        out = materialise(_pass(out, shared, k == 0, k == blocks - 1), "quality-measures")
        shared.unpersist()
    q = F.percentile_approx("log_perplexity", [0.25, 0.75], 10000)
    bands = out.where(F.col("n_words") >= LEAST_WORDS).groupBy("_lang").agg(q.alias("_q")).select(
        "_lang", (F.col("_q")[0] - width * (F.col("_q")[1] - F.col("_q")[0])).alias("band_low"), (F.col("_q")[1] + width * (F.col("_q")[1] - F.col("_q")[0])).alias("band_high")
    )  # one row a language
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.join(F.broadcast(bands), "_lang", "left").select(
        F.col("_id").alias(id_col), *NAMES, failed.alias("base_failed"),
        F.coalesce(~failed & F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False)).alias("kept"), "log_perplexity", "band_low", "band_high",
    )

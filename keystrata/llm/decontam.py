"""Benchmark decontamination with suffix arrays of the training text.

The benchmark is broadcast in blocks of a checked size: one pass over the
documents for each block, with what earlier passes found carried along.  Each Arrow batch of documents is a shard: its words become
benchmark word codes, the suffixes that could match at all are sorted into a
suffix array, and every benchmark suffix is binary-searched in it.  That gives
the occurrences of every window.  Each occurrence is then searched in the
benchmark's own suffix array, of suffixes at their full length, which gives the
longest verbatim matches over all items and where they lie.  No document text is ever shuffled.

The suffix array leaves out suffixes whose first words are not in the
benchmark, since no benchmark suffix can share a window with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import materialise

WINDOW = 8
_BASE = 0x9E3779B97F4A7C15
BLOCK_BYTES = 16 << 20  # of benchmark text broadcast at once


@dataclass
class Benchmark:
    """Codes of all item words, each item followed by a code that occurs nowhere."""

    vocabulary: np.ndarray  # sorted word hashes; a word's code is its place
    codes: np.ndarray
    item_of: np.ndarray  # index into ids for each code
    ids: list
    width: np.ndarray  # window length at each place, 0 where none begins
    pairs: np.ndarray  # sorted first * V + second of all places with a second word
    short_first: np.ndarray  # codes that are windows of one word
    ends: np.ndarray  # end of the item of each code
    order: np.ndarray  # places of the widest windows, by the words from there to the item's end
    sums: np.ndarray  # running sums of the codes, see _sums


def build_benchmark(ids: list, texts: list[str | None], window: int = WINDOW) -> Benchmark:
    raw, offsets = tv.column_bytes(pa.array(texts, pa.string()))
    _, _, hashes, first = tv.words(tv.lower_ascii(raw), offsets, tv.ALNUM)
    vocabulary, code = np.unique(hashes, return_inverse=True)
    sizes = np.diff(first)
    codes, item_of, width = [], [], []
    for k, n in enumerate(sizes):
        own = min(window, int(n))
        codes += [code[first[k] : first[k + 1]], [-1]]
        item_of += [k] * (n + 1)
        width += [own] * (n - own + 1 if own else 0) + [0] * (own if own else 1)
    codes = np.concatenate([np.asarray(c, np.int64) for c in codes]) if codes else np.empty(0, np.int64)
    width = np.asarray(width, np.int64)
    v = max(1, len(vocabulary))
    both = (codes[:-1] >= 0) & (codes[1:] >= 0)
    pairs = np.unique(codes[:-1][both] * v + codes[1:][both])
    cut = np.flatnonzero(codes < 0)
    ends = cut[np.searchsorted(cut, np.arange(len(codes)))]
    order = _full_order(codes)
    order = order[width[order] == max(1, width.max())] if len(order) else order
    return Benchmark(vocabulary, codes, np.asarray(item_of, np.int64), ids, width, pairs, np.unique(codes[width == 1]), ends, order, _sums(codes))


def _full_order(codes: np.ndarray) -> np.ndarray:
    """All places by their suffixes at full length, by prefix doubling; a suffix that ends earlier comes first."""
    n, ends = len(codes), codes < 0
    rank = np.where(ends, np.cumsum(ends) - 1, codes + ends.sum())
    order, k = np.argsort(rank, kind="stable"), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - k)] = rank[k:]
        order = np.lexsort([second, rank])
        rank[order] = np.cumsum(np.concatenate([[False], (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)])[:n])
        if not n or rank.max() == n - 1:
            return order
        k *= 2


def _sums(codes: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial over the codes: equal stretches have equal differences, but for a power of the base."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(tv.mix((codes + 3).astype(np.uint64)) * tv._power(_BASE, len(codes)), out=out[1:])
    return out


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def encode(hashes: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Benchmark codes of words, -1 for words that no item has."""
    if not len(bench.vocabulary):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(bench.vocabulary, hashes), len(bench.vocabulary) - 1)
    return np.where(bench.vocabulary[at] == hashes, at, -1)


def suffix_array(codes: np.ndarray, last: np.ndarray, bench: Benchmark, depth: int) -> np.ndarray:
    """Places of suffixes that may match, ordered by their first ``depth`` words.

    last: for each place the end of its document.  A suffix that ends earlier
    sorts before its extensions.
    """
    keep = codes >= 0
    v = max(1, len(bench.vocabulary))
    two = np.zeros(len(codes), dtype=bool)
    if len(codes) > 1:
        two[:-1] = keep[:-1] & keep[1:] & (last[:-1] > np.arange(1, len(codes)))
        at = np.flatnonzero(two)
        two[at] = _member(bench.pairs, codes[at] * v + codes[at + 1])
    if len(bench.short_first):
        two |= keep & _member(bench.short_first, codes)
    places = np.flatnonzero(two)
    keys = [word_at(codes, last, places, k) for k in range(depth)]
    return places[np.lexsort(keys[::-1])] if depth else places


def word_at(codes: np.ndarray, last: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k-th word after each place; -2 past the document's end."""
    at = places + k
    inside = at < last[places]
    return np.where(inside, codes[np.where(inside, at, 0)], -2)


def search(codes, last, array, wanted: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """For each wanted row (its first ``length`` words count) the first suffix not below it, or above it."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(array), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        place = array[np.minimum(mid, len(array) - 1)]
        sign = np.zeros(len(wanted), np.int64)  # of suffix against wanted
        for k in range(wanted.shape[1]):
            word = word_at(codes, last, place, k)
            undecided = (sign == 0) & (k < lengths)
            sign = np.where(undecided, np.sign(word - wanted[:, k]), sign)
        right = (sign < 0) | ((sign == 0) & upper)
        low = np.where(open_ & right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


@dataclass
class Hits:
    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[list[int]]  # indexes of items with an occurring window
    longest: np.ndarray  # words of the longest verbatim match
    longest_at: np.ndarray  # its first word in the document
    longest_item: np.ndarray  # -1: none
    covered: np.ndarray  # for each word whether it is hit
    first: np.ndarray  # first word of each document


def match_shard(raw: np.ndarray, offsets: np.ndarray, bench: Benchmark) -> Hits:
    n_docs = len(offsets) - 1
    _, _, hashes, first = tv.words(tv.lower_ascii(raw), offsets, tv.ALNUM)
    n_words = np.diff(first)
    hits = Hits(n_words, np.zeros(n_docs, np.int64), [[] for _ in range(n_docs)], np.zeros(n_docs, np.int64), np.full(n_docs, -1, np.int64), np.full(n_docs, -1, np.int64), np.zeros(len(hashes), dtype=bool), first)
    starts = np.flatnonzero(bench.width)
    if not len(hashes) or not len(starts):
        return hits
    codes = encode(hashes, bench)
    doc_of = np.repeat(np.arange(n_docs), n_words)
    last = np.repeat(first[1:], n_words)
    depth = int(bench.width.max())
    array = suffix_array(codes, last, bench, depth)
    if not len(array):
        return hits
    lengths = bench.width[starts]
    columns = np.minimum(starts[:, None] + np.arange(depth), len(bench.codes) - 1)
    wanted = bench.codes[columns]
    wanted[np.arange(depth) >= lengths[:, None]] = -3
    kinds, back = np.unique(np.concatenate([lengths[:, None], wanted], axis=1), axis=0, return_inverse=True)  # equal suffixes are searched once
    back = back.reshape(-1)
    low = search(codes, last, array, kinds[:, 1:], kinds[:, 0], False)
    high = search(codes, last, array, kinds[:, 1:], kinds[:, 0], True)
    found = high - low
    if not found.any():
        return hits
    # Occurrences of each kind of window: a flat range of the suffix array.
    kind = np.repeat(np.arange(len(kinds)), found)
    nth = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    place = array[low[kind] + nth]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + kinds[kind, 0], -1)
    hits.covered = np.cumsum(edge[:-1]) > 0
    hits.n_hit = np.bincount(doc_of[hits.covered], minlength=n_docs)
    # A kind belongs to every item that has it: distinct (kind, item), distinct (document, kind).
    owners = np.unique(np.stack([back, bench.item_of[starts]], axis=1), axis=0)
    owner_from = np.searchsorted(owners[:, 0], np.arange(len(kinds) + 1))
    seen = np.unique(doc_of[place] * len(kinds) + kind)
    for key in seen.tolist():
        doc, one = divmod(key, len(kinds))
        hits.items[doc] += owners[owner_from[one] : owner_from[one + 1], 1].tolist()
    hits.items = [sorted(set(x)) for x in hits.items]
    _prolong(hits, codes, last, doc_of, first, bench, starts, back, kind, place, kinds)
    return hits


def _prolong(hits: Hits, codes, last, doc_of, first, bench: Benchmark, starts, back, kind, place, kinds) -> None:
    """The longest match from each occurrence; windows overlap, so the leftmost one spans the whole match.

    The suffixes next to an occurrence in the benchmark's order share the most
    words with it.  A window of a shorter item is that whole item already.
    """
    own = _sums(codes)
    power = tv._power(_BASE, max(len(codes), len(bench.codes)) + 1)

    def shared(t, d, most):
        """How many words are equal from the benchmark's place t and the document's place d."""
        most = np.minimum(most, bench.ends[t] - t)
        size = np.zeros(len(t), np.int64)
        for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            more = np.minimum(size + (1 << bit), most)
            same = (bench.sums[t + more] - bench.sums[t]) * power[d] == (own[d + more] - own[d]) * power[t]
            size = np.where(same, more, size)
        return size

    def below(d, most, upper: bool):
        """How many suffixes of the benchmark come before the ``most`` words from d, those that begin with them included or not."""
        low, high = np.zeros(len(d), np.int64), np.full(len(d), len(bench.order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            t = bench.order[np.minimum(mid, len(bench.order) - 1)]
            n = shared(t, d, most)
            word = bench.codes[t + n]  # -1 at the item's end
            less = np.where(n == most, upper, (t + n == bench.ends[t]) | (word < codes[np.minimum(d + n, len(codes) - 1)]))
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return low

    source = np.zeros(len(kinds), np.int64)
    source[back[::-1]] = starts[::-1]
    size = kinds[kind, 0].copy()
    wide = size == bench.width.max()
    d = place[wide]
    most = last[d] - d
    at = below(d, most, False)
    near = [shared(bench.order[np.clip(at + k, 0, len(bench.order) - 1)], d, most) for k in (-1, 0)]
    size[wide] = np.maximum(*near)
    docs = doc_of[place]
    order = np.lexsort([place, -size, docs])
    best = order[np.concatenate([[True], np.diff(docs[order]) != 0])]
    item = bench.item_of[source[kind[best]]]
    wide = wide[best]
    d, n = place[best][wide], size[best][wide]
    item[wide] = [bench.item_of[bench.order[x:y]].min() for x, y in zip(below(d, n, False), below(d, n, True), strict=True)]  # the first of those that share it
    d = docs[best]
    hits.longest[d], hits.longest_at[d], hits.longest_item[d] = size[best], place[best] - first[d], item


def _add_earlier(h: Hits, k: int, spans: list[int]) -> list[int]:
    """Join the hit words of earlier blocks to document k's; returns the joint spans."""
    own = h.covered[h.first[k] : h.first[k + 1]]
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        own[a:b] = True
    h.n_hit[k] = own.sum()
    return np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist()


FOUND = "`_n_words` long, `_n_hit` long, `_item_ids` array<string>, `_longest_match` long, `_longest_at` long, `_longest_item` string, `_spans` array<long>"
FOUND_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
FOUND_NAMES = [part.split("`")[1] for part in FOUND.split(", ")]


def _match(slim: DataFrame, bench: Benchmark, keep: list[str], last: bool) -> DataFrame:
    """One block of the benchmark against all rows; spans are kept while more blocks follow."""
    shared = slim.sparkSession.sparkContext.broadcast(bench)
    again = "_spans" in slim.columns
    columns = keep if last and "_text" not in keep else [*keep, *(["_text"] if "_text" not in keep else [])]
    schema = ", ".join([f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in columns] + [FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ids = [str(i) for i in own.ids]
        for batch in batches:
            raw, offsets = tv.column_bytes(batch.column("_text"))
            for a, b in tv.slices(offsets):
                part = batch.slice(a, b - a)
                h = match_shard(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], own)
                items = [sorted({ids[k] for k in x}) for x in h.items]
                longest = [ids[k] if k >= 0 else None for k in h.longest_item]
                size, at, spans = h.longest.tolist(), h.longest_at.tolist(), [[] for _ in items]
                for k, before in enumerate(part.select(FOUND_NAMES).to_pylist()) if again else ():
                    spans[k] = _add_earlier(h, k, before["_spans"])
                    items[k] = sorted({*items[k], *before["_item_ids"]})
                    if before["_longest_match"] >= size[k]:
                        size[k], at[k], longest[k] = before["_longest_match"], before["_longest_at"], before["_longest_item"]
                if not again and not last:
                    spans = [_add_earlier(h, k, []) for k in range(len(items))]
                values = [h.n_words, h.n_hit, items, size, at, longest, spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in columns] + [pa.array(v, t) for v, t in zip(values, FOUND_TYPES, strict=True)], names=columns + FOUND_NAMES
                )

    return slim.mapInArrow(run, schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of each row of docs plus those of FOUND.

    Null texts have no words; an item without words has no window; items with a
    null id are left out; items with equal ids count as one.  Rows keep their
    number: repeated rows each get a result.  Empty tables give no rows, an empty
    benchmark no hits.  A benchmark above ``block_bytes`` is dealt by a hash of the
    item id into blocks of about that size, each matched in a pass of its own.
    """
    items = benchmark.select(F.col(item_col).alias("_i"), F.col(item_text_col).alias("_t")).where("_i is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)) + 64 * F.count("*")).first()[0]
    blocks = 1 if size <= block_bytes else -(-2 * size // block_bytes)
    out = docs.select(*keep, *([F.col(text_col).alias("_text")] if "_text" not in keep else []))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == k).collect()  # of a checked size
        rows.sort(key=lambda r: (str(r[0]), r[1] or ""))
        bench = build_benchmark([r[0] for r in rows], [r[1] for r in rows])
        out = _match(out, bench, keep, k == blocks - 1)
        if k < blocks - 1:
            out = materialise(out, "decontam-pass")
    return out.drop("_spans") if "_text" in keep else out.drop("_spans", "_text")


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match."""
    found = find_matches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), benchmark, ["_id"], "_body", item_col)
    items = F.array_sort(F.array_distinct("_item_ids"))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size(items) >= least_items).alias("contaminated"),
        F.col("_longest_match").alias("longest_match"),
        F.col("_longest_at").alias("longest_at"),
        F.col("_longest_item").alias("longest_item"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, text_col: str = "text") -> DataFrame:
    """docs without the rows in which windows of ``least_items`` items occur; the same columns."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    found = find_matches(plain, benchmark, names, names[docs.columns.index(text_col)])
    return found.where(F.size(F.array_distinct("_item_ids")) < least_items).select(*names).toDF(*docs.columns)

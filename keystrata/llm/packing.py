"""Best-fit packing by a grouping genetic algorithm on islands.

Texts are tokenised once; from then on only piece lengths travel.  Pieces are
dealt to chunks of about ``CHUNK``.  Each chunk is first packed by best fit,
longest first; where that meets the volume bound nothing can be gained.  Every
other chunk gets ``ISLANDS`` populations of packings, each bred in a task of its
own: a child takes whole well-filled bins of one parent, drops the other parent's
bins that hold the same pieces, and best-fits what is displaced.  After each of
``ROUNDS`` rounds the elite of an island, its best packing, migrates to the next
island of the chunk, as a row of bin numbers; the best of all is kept.

Bins of 99.5 % or more are then final, and the pieces of the others are dealt to
new chunks, as long as that leaves less than half of them each time; the last
chunks close all their bins.  A task never holds more than a chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

CAPACITY = 2048
CHUNK = 8192
ISLANDS, ROUNDS = 3, 2
POPULATION, GENERATIONS = 4, 6
WELL_FILLED = 0.995
PIECES = "_id long, piece int, start long, length long, ids_crc32 long"


#: Texts of these characters alone are coded by the faster library, which has the same vocabulary
#: and gives the same ids for them; any other text goes to ``tokenizers`` itself.
PLAIN = r"[\t\n\r\x20-\x7e\u00a1-\u024f\u2013\u2014\u2018-\u201f\u2026\u20ac]*"


def coder(tokenizer: str, ranks: str | None):
    """text -> ids, as ``tokenizers`` gives them without added special tokens."""
    import base64
    import re

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast, plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), re.compile(PLAIN)
    return lambda text: fast.encode_ordinary(text) if plain.fullmatch(text) and not any(s in text for s in special) else slow(text)


def tokenise(docs: DataFrame, tokenizer: str, ranks: str | None, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every whole text; one longer than a sequence is cut, its first piece being the shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = coder(tokenizer, ranks)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[tuple] = []
            for k, doc in enumerate(ids):
                tokens = encode(texts[k].as_py() or "")
                code = np.empty(len(tokens) + 1, "<u4")
                code[:-1], code[-1] = tokens, end_id
                n = len(code)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                out += [(doc, i, a, b - a, zlib.crc32(code[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, PIECES)


class Space:
    """Open amounts (free space or lengths) as a bit set with stacks: best fit in a few big-integer steps."""

    def __init__(self, capacity: int):
        self.bits, self.stacks = 0, [[] for _ in range(capacity + 1)]

    def put(self, amount: int, what: int) -> None:
        self.stacks[amount].append(what)
        self.bits |= 1 << amount

    def take_least(self, amount: int):
        """(amount, what) with the least amount not under this one, or None."""
        above = self.bits >> amount
        if not above:
            return None
        at = amount + (above & -above).bit_length() - 1
        what = self.stacks[at].pop()
        if not self.stacks[at]:
            self.bits ^= 1 << at
        return at, what


def best_fit(bins: list[list[int]], items, sizes: list[int], capacity: int) -> list[list[int]]:
    """Put each item, in this order, in the fullest bin that can take it, else in a new one."""
    space = Space(capacity)
    for k, b in enumerate(bins):
        if free := capacity - sum(sizes[i] for i in b):
            space.put(free, k)
    for i in items:
        size = sizes[i]
        if found := space.take_least(size):
            free, k = found
            bins[k].append(i)
        else:
            free, k = capacity, len(bins)
            bins.append([i])
        if free > size:
            space.put(free - size, k)
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def cross(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject half of other's well-filled bins into one; displaced pieces are best-fitted, longest first."""
    full = [b for b in other if sum(sizes[i] for i in b) >= WELL_FILLED * capacity]
    given = [full[k] for k in np.flatnonzero(rng.random(len(full)) < 0.5)]
    taken = {i for b in given for i in b}
    kept, displaced = [list(b) for b in given], []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit(kept, sorted(displaced, key=lambda i: -sizes[i]), sizes, capacity)


def bound(sizes: list[int], capacity: int) -> int:
    """Bins that the volume alone calls for, and that pieces of more than half a bin call for."""
    return max(-(-sum(sizes) // capacity), sum(2 * x > capacity for x in sizes))


def first_packing(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best fit, longest first."""
    return best_fit([], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)


def breed(sizes: list[int], capacity: int = CAPACITY, seed: int = 0, elite: list[list[list[int]]] = (), generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing of one island's population: the elite it is given, and best fits of disturbed orders."""
    rng, least, size = np.random.default_rng(seed), bound(sizes, capacity), np.asarray(sizes)
    people = [(fitness(bins, sizes, capacity), k, bins) for k, bins in enumerate([first_packing(sizes, capacity), *elite])]
    for k in range(max(0, POPULATION - len(people))):
        order = np.argsort(-size * (1 + 0.2 * (k + 1) * rng.random(len(size))), kind="stable").tolist()
        bins = best_fit([], order, sizes, capacity)
        people.append((fitness(bins, sizes, capacity), len(people), bins))
    people.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    for n in range(generations):
        if len(people[0][2]) == least:
            break
        a, b = sorted(rng.choice(len(people), 2, replace=False)) if len(people) > 1 else (0, 0)
        for one, other in ((a, b), (b, a)):
            bins = cross(people[one][2], people[other][2], sizes, capacity, rng)
            people.append((fitness(bins, sizes, capacity), len(people) + n, bins))
        people.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        people = people[:POPULATION]
    return people[0][2]


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin of each piece."""
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(numbers: np.ndarray) -> list[list[int]]:
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if len(order) else []


CHUNKS = "_chunk long, rids array<long>, sizes array<int>, bins array<int>, open boolean"
ISLES = "_chunk long, isle int, sizes array<int>, elite array<array<int>>"


def _first(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """A chunk as one row, packed by best fit; open: above the volume bound."""
    rows = rows.sort_values("_rid")
    sizes = rows["length"].tolist()
    bins = first_packing(sizes, capacity)
    return pd.DataFrame({"_chunk": [rows["_chunk"].iloc[0]], "rids": [rows["_rid"].to_numpy()], "sizes": [np.asarray(sizes, np.int32)], "bins": [_numbers(bins, len(sizes))], "open": [len(bins) > bound(sizes, capacity)]})


def evolve(chunks: DataFrame, capacity: int) -> DataFrame:
    """(_chunk, bins): the best packing of each open chunk over all islands."""
    isles = chunks.where("open").select("_chunk", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("isle"), "sizes", F.array("bins").alias("elite"))
    for step in range(ROUNDS):

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            chunk, isle, sizes, elite = next(rows[["_chunk", "isle", "sizes", "elite"]].itertuples(index=False))  # a group is one island
            best = breed(sizes.tolist(), capacity, seed=hash((chunk, isle, step)) & 0xFFFFFFFF, elite=[_bins(np.asarray(e)) for e in elite])
            return pd.DataFrame({"_chunk": [chunk], "isle": [isle], "sizes": [sizes], "elite": [[_numbers(best, len(sizes))]]})

        isles = materialise(isles.groupBy("_chunk", "isle").applyInPandas(run, ISLES), "isles")
        if step < ROUNDS - 1:  # each island keeps its elite and gets that of the one before
            moved = isles.select("_chunk", ((F.col("isle") + 1) % ISLANDS).alias("isle"), F.col("elite").alias("_more"))
            isles = isles.join(moved, ["_chunk", "isle"]).select("_chunk", "isle", "sizes", F.concat("elite", "_more").alias("elite"))
    used = F.array_max(F.col("elite")[0])
    return isles.groupBy("_chunk").agg(F.min_by(F.col("elite")[0], F.struct(used, "isle")).alias("bins"))


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone.  Repeated rows each get pieces of
    their own.  Other columns are ignored.  An empty table gives no rows.  A full
    piece is a sequence by itself.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenise(docs, tokenizer, ranks, id_col, text_col, capacity, end_id), "pieces")
    pieces = materialise(pieces.withColumn("_rid", F.monotonically_increasing_id()), "piece-ids")
    done = [pieces.where(F.col("length") >= capacity).select("_rid", (-1 - F.col("_rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, step = pieces.where(F.col("length") < capacity).select("_rid", "length"), 0
    left = pool.count()
    while left:
        n = -(-left // CHUNK)
        dealt = pool.withColumn("_chunk", F.pmod(F.xxhash64("_rid", F.lit(step)), F.lit(n)))
        chunks = materialise(dealt.groupBy("_chunk").applyInPandas(lambda rows: _first(rows, capacity), CHUNKS), "chunks")
        better = chunks.drop("bins").join(evolve(chunks, capacity), "_chunk") if not chunks.where("open").isEmpty() else chunks.limit(0)
        packed = chunks.where("not open").select("_chunk", "rids", "sizes", "bins").unionByName(better.select("_chunk", "rids", "sizes", "bins"))

        def close(batches: Iterator[pd.DataFrame], least: float, base: int) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for chunk, rids, sizes, numbers in batch.itertuples(index=False):
                    volume = np.bincount(numbers, sizes)
                    order = np.argsort(numbers, kind="stable")
                    ends = np.cumsum(sizes[order], dtype=np.int64)
                    at = np.empty(len(rids), np.int64)
                    at[order] = ends - sizes[order] - np.concatenate([[0], np.cumsum(volume)])[numbers[order]].astype(np.int64)
                    final = volume[numbers] >= least
                    yield pd.DataFrame({"_rid": rids, "length": sizes, "sequence_id": np.where(final, base | (chunk << 14) | numbers.astype(np.int64), -1), "offset": np.where(final, at, 0)})

        def closed(least: float, name: str, base: int = step << 56) -> DataFrame:
            return materialise(packed.mapInPandas(lambda x: close(x, least, base), "_rid long, length int, sequence_id long, offset long"), name)

        out = closed(WELL_FILLED * capacity if n > 1 else 0, "packed")
        pool = out.where("sequence_id < 0").select("_rid", F.col("length").cast("long").alias("length"))
        after = pool.count()
        if after and 2 * after > left:  # bins that stay open are as good as it gets
            out, after = closed(0, "packed"), 0
        done.append(out.where("sequence_id >= 0").select("_rid", "sequence_id", "offset"))
        left, step = after, step + 1
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    joined = pieces.join(placed, "_rid")
    return joined.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

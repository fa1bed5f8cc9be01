"""N-gram Jaccard join with Bayesian candidate pruning.

Texts of equal shingle sets are one class.  Classes that share a MinHash band
are brought together as components, whose members are dealt to blocks; each
pair of blocks is one task.  There, pairs are compared a few MinHash values at
a time and dropped once the posterior probability (uniform prior) of reaching
the threshold is below the tolerance; the rest are verified exactly on their
whole shingle sets by products of incidence matrices.  Only sums of links and
a spanning forest leave a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .store import checked_broadcast, discard, materialise, release

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND = 42, 6  # a pair of similarity 0.8 misses all bands with probability 3e-6, one of 0.4 with 0.84
HASHES = 128  # values compared when pairs are pruned
STEP, TOLERANCE = 16, 1e-5
BLOCK, TILE = 1024, 256
_SEEDS = tv.mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle of all its words."""
    _, _, hashes, first = tv.words(tv.lower_ascii(raw), offsets, tv.NOT_SPACE)
    at, value = tv.windows(hashes, first, size)
    cuts = np.searchsorted(at, first)
    out = []
    for k in range(len(offsets) - 1):
        own = np.unique(value[cuts[k] : cuts[k + 1]])
        n = int(first[k + 1] - first[k])
        if not len(own) and n:
            own = tv.windows(hashes[first[k] : first[k + 1]], np.array([0, n]), n)[1]
        out.append(own)
    return out


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(HASHES MinHash values, a hash of each band)."""
    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = (shingles[a : a + 2048, None] ^ _SEEDS[None, :]) * np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(29)
        low = np.minimum(low, part.min(axis=0))
    low = tv.mix(low)
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        band = tv.mix(band * np.uint64(0x9E3779B97F4A7C15) + low[k::BAND])
    return (low[:HASHES] >> np.uint64(33)).astype(np.int32), band.view(np.int64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(tv.mix(shingles + np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (3, 11))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each n compared values the fewest matches at which P(similarity >= threshold) is still tolerable."""
    p = (np.arange(20000) + 0.5) / 20000
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[p >= threshold].sum() / weight.sum() >= tolerance:
                out[n] = m
                break
    return out


def candidates(one: np.ndarray, two: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that Bayesian pruning leaves."""
    count = np.zeros((len(one), len(two)), np.int16)
    for k in range(STEP):
        count += one[:, k][:, None] == two[:, k][None, :]
    i, j = np.nonzero(count >= least[STEP])
    hits = count[i, j].astype(np.int64)
    for n in range(2 * STEP, HASHES + 1, STEP):
        if not len(i):
            break
        hits = hits + (one[i, n - STEP : n] == two[j, n - STEP : n]).sum(axis=1)
        keep = hits >= least[n]
        i, j, hits = i[keep], j[keep], hits[keep]
    return i, j


def verified(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold: exact counts of shared shingles."""
    a, b = np.unique(i), np.unique(j)
    flat = np.concatenate([left[k] for k in a] + [right[k] for k in b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(left[k]) for k in a] + [len(right[k]) for k in b])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[code] > 1
    shared_codes, code = np.unique(code[keep], return_inverse=True)
    row, shared = row[keep], np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for c in range(0, len(shared_codes), 8192):
        x, y = np.searchsorted(code, [c, c + 8192])
        m = np.zeros((len(a) + len(b), 8192), np.float32)
        m[row[x:y], code[x:y] - c] = 1
        shared += m[: len(a)] @ m[len(a) :].T
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    both = np.rint(shared[np.searchsorted(a, i), np.searchsorted(b, j)]).astype(np.int64)
    return both >= threshold * (n[i] + m[j] - both) - 1e-9


def _shingled(docs: DataFrame, with_sets: bool) -> DataFrame:
    """The columns of docs but _text, c1, c2 and a signature or the set; c1 is null where there is no word."""
    names = [c for c in docs.columns if c != "_text"]
    last = ["_set array<long>"] if with_sets else ["_sig array<int>", "_bands array<long>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tv.column_bytes(batch.column("_text"))
            for a, b in tv.slices(offsets, 1 << 21):
                sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys = [digest(s) if len(s) else (None, None) for s in sets]
                if with_sets:
                    more = [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                else:
                    pairs = [signature(s) if len(s) else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for s in sets]
                    more = [pa.array([x[0] for x in pairs], pa.list_(pa.int32())), pa.array([x[1] for x in pairs], pa.list_(pa.int64()))]
                named = [*names, "c1", "c2", *[x.split()[0] for x in last]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in names], pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *more], names=named)

    kept = "".join(f"{c} long, " for c in names)
    return docs.mapInArrow(run, f"{kept}c1 long, c2 long, {', '.join(last)}")


CELL_OUT = "cls long, links long, root long"


def _compare(rows: pd.DataFrame, threshold: float, least: dict[int, int]) -> pd.DataFrame:
    """Links of the classes of one pair of blocks (x, y), and their forest inside it."""
    rows = rows.sort_values("cls", ignore_index=True)
    cls, copies = rows["cls"].to_numpy(), rows["copies"].to_numpy()
    sig, sets = np.stack(rows["_sig"].to_numpy()), [np.asarray(s).view(np.uint64) for s in rows["_set"]]
    same = rows["x"].iloc[0] == rows["y"].iloc[0]
    one = np.flatnonzero(rows["b"] == rows["x"])
    two = one if same else np.flatnonzero(rows["b"] == rows["y"])
    links, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
    for a in range(0, len(one), TILE):
        for b in range(a if same else 0, len(two), TILE):
            p, q = one[a : a + TILE], two[b : b + TILE]
            i, j = candidates(sig[p], sig[q], least)
            if same and a == b:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            ok = verified([sets[k] for k in p], [sets[k] for k in q], i, j, threshold)
            u, v = p[i[ok]], q[j[ok]]
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            while True:  # minimum labels over this tile's links
                before = root.copy()
                low = np.minimum(root[u], root[v])
                for end in (u, v):
                    np.minimum.at(root, root[end], low)
                root = root[root]
                if (before == root).all() and (root[u] == root[v]).all():
                    break
    hit = links > 0
    return pd.DataFrame({"cls": cls[hit], "links": links[hit], "root": cls[root[hit]]})


def _components(classes: DataFrame) -> DataFrame:
    """(cls, comp): classes that are linked by bands."""
    banded = classes.select("cls", F.explode("_bands").alias("h"))
    least = banded.withColumn("a", F.min("cls").over(Window.partitionBy("h"))).where("a <> cls")
    together = components(materialise(least.select("a", F.col("cls").alias("b")).distinct(), "band-edges"))
    return together.select(F.col("v").alias("cls"), F.col("root").alias("comp"))


def _classes(docs: DataFrame, threshold: float, exact: bool = False) -> DataFrame:
    """The columns of docs (_id, _text and other numbers) but _text, class_id, n_links, group_id and grp.

    grp names the linked group, null where there is no word.  Ids only name what
    is found: rows of one id may be of several classes, and ids may be null.
    """
    names, spark = [c for c in docs.columns if c != "_text"], docs.sparkSession
    docs = docs.withColumn("_th", F.xxhash64("_text"))
    marked = materialise(_shingled(docs, False), "shingled")
    named = marked.where("c1 is not null")
    classes = named.groupBy("c1", "c2").agg(F.min("_id").alias("first"), F.min(F.struct("_id", "_th")).alias("home"), F.count("*").alias("copies"), F.min(F.struct("_sig", "_bands")).alias("_s"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cls"), "c1", "c2", "first", "home", "copies", "_s._sig", "_s._bands"), "classes")
    release(spark)
    together = classes.select("cls", F.lit(0).cast("long").alias("comp")) if exact else _components(classes)
    together = materialise(together, "band-components")
    release(spark)
    sizes = together.groupBy("comp").agg(F.count("*").alias("_size"))
    blocked = together.join(sizes, "comp").where("_size > 1").select("cls", "comp", F.expr(f"cast(ceil(_size / {BLOCK}) as int)").alias("nb"))
    blocked = materialise(blocked.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")).join(classes.drop("_bands"), "cls"), "blocked")
    where = blocked.select(F.col("home._id").alias("_i"), F.col("home._th").alias("_h")).distinct()
    homes = docs.join(checked_broadcast(where, F.lit(32)), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_h")), "left_semi").select("_text")
    sets = materialise(_shingled(homes, True).where("c1 is not null").dropDuplicates(["c1", "c2"]).select("c1", "c2", "_set"), "shingle-sets")
    release(spark)
    cells = blocked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("cls", "comp", "copies", "_sig", "b", "c1", "c2", F.least("b", "_o").alias("x"), F.greatest("b", "_o").alias("y"))
    least = least_matches(threshold)
    out = cells.join(sets, ["c1", "c2"]).drop("c1", "c2").groupBy("comp", "x", "y").applyInPandas(lambda rows: _compare(rows, threshold, least), CELL_OUT)
    out = materialise(out, "links")
    release(spark)
    discard(sets, blocked, together)
    links = out.groupBy("cls").agg(F.sum("links").alias("_links"))
    forest = out.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))
    groups = components(forest).withColumnsRenamed({"v": "cls", "root": "grp"})
    leasts = groups.join(classes.select("cls", "first"), "cls").groupBy("grp").agg(F.min("first").alias("_least"))
    groups = groups.join(leasts, "grp")
    told = classes.join(links, "cls", "left").join(groups, "cls", "left").select(
        "c1", "c2", F.col("first").alias("class_id"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("_least", "first").alias("group_id"), F.coalesce("grp", "cls").alias("grp"),
    )
    with_words = named.select(*names, "c1", "c2").join(told, ["c1", "c2"]).drop("c1", "c2")
    alone = marked.where("c1 is null").select(*names, F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("group_id"), F.lit(None).cast("long").alias("grp"))
    return with_words.unionByName(alone)


def join_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, group_id.

    class_id is the least id of the rows with an equal shingle set, n_links the
    number of other rows of similarity ``threshold`` or more (copies included),
    group_id the least id of the linked rows.  A text without words (or null) is
    linked to nothing.  Rows with equal ids are rows of their own.  Null ids are
    not allowed to name a class unless all its ids are null.  An empty table gives no rows.
    ``exact`` leaves the bands out and compares all classes, in blocks.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return _classes(slim, threshold, exact).drop("grp").withColumnRenamed("_id", id_col)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each linked group, one of the least id (null ids last); the same columns.

    Rows are told apart by a number of their own, so rows of one id go or stay
    each by its text.  A text without words stays.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)
    plain = materialise(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    told = _classes(plain.select("_row", F.col(names[i]).cast("long").alias("_id"), F.col(names[t]).alias("_text")), threshold).where("grp is not null")
    told = materialise(told.select("_row", "_id", "grp"), "groups")
    stays = told.groupBy("grp").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_s"), F.count("*").alias("_n")).where("_n > 1").select("grp", F.col("_s._row").alias("_stays"))
    gone = told.join(stays, "grp").where("_row <> _stays").select("_row")
    gone = checked_broadcast(materialise(gone, "copies"), F.lit(16))
    return plain.join(gone, "_row", "left_anti").drop("_row").toDF(*docs.columns)

"""Keyed tables: append-only Parquet runs under a versioned manifest.

A write adds a run; a read unions the runs of one manifest version and keeps the
newest version of each key, dropping tombstones last.  The order of runs is a
number in the manifest, so that a writer who loses a race publishes the same
files again under the next number.  Files are never changed in place, a manifest
is published by a hard link that fails if its version is taken, and ``vacuum``
removes only what the newest manifest doesn't name and nobody may still read.

Single rows go to a buffer on the driver, the newest data of its table, which
becomes a run at ``memtable_size`` distinct keys or by flush() and close().
"""

from __future__ import annotations

import copy
import datetime
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import merge
from keystrata.operators.metrics import Metrics
from keystrata.sources.config import Config
from keystrata.sources.errors import (
    ColumnCountMismatch,
    ColumnTypeMismatch,
    InvalidSchema,
    NullValue,
    PrimaryKeyTypeMismatch,
    TableError,
    TableExists,
    TableNotFound,
    VersionConflict,
)

__all__ = [
    "TYPES", "KEY_TYPES", "Database", "TableError", "TableExists", "TableNotFound", "InvalidSchema", "PrimaryKeyTypeMismatch",
    "ColumnCountMismatch", "ColumnTypeMismatch", "NullValue", "VersionConflict",
]

TYPES = {"boolean": "boolean", "integer": "int", "big_integer": "bigint", "float": "float", "double": "double", "varchar": "string", "timestamp": "timestamp"}
KEY_TYPES = {"integer", "big_integer", "varchar", "timestamp"}
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def fits(value, kind: str) -> bool:
    """Whether a Python value is exactly of a column type; no coercion but int and float to a timestamp's micros and a double."""
    whole = isinstance(value, int) and not isinstance(value, bool)
    if kind == "boolean":
        return isinstance(value, bool)
    if kind in ("integer", "big_integer"):
        return whole and -(1 << (31 if kind == "integer" else 63)) <= value < 1 << (31 if kind == "integer" else 63)
    if kind in ("float", "double"):
        return isinstance(value, float)
    return isinstance(value, str) if kind == "varchar" else isinstance(value, datetime.datetime) or (whole and -(1 << 63) <= value < 1 << 63)


def _timestamp(value):
    return EPOCH + datetime.timedelta(microseconds=value) if isinstance(value, int) and not isinstance(value, bool) else value


class Database:
    """Tables below a folder on a POSIX file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path, config or Config(data_directory=path)
        self.metrics = Metrics()
        self.active: dict[str, dict] = {}
        self.frozen: dict[str, list[dict]] = {}
        os.makedirs(path, exist_ok=True)
        self.refresh()

    # Manifest.

    def _manifests(self) -> list[str]:
        return sorted(f for f in os.listdir(self.path) if re.fullmatch(r"manifest-\d{12}\.json", f))

    def refresh(self) -> None:
        """Take over the newest published version."""
        names = self._manifests()
        if names:
            with open(os.path.join(self.path, names[-1])) as file:
                self.state = json.load(file)
        else:
            self.state = {"version": 0, "tables": {}}

    def _publish(self, state: dict) -> bool:
        """Publish ``state`` as the next version; False if another writer was first."""
        version = state["version"] + 1
        tmp, final = os.path.join(self.path, f"tmp-{uuid.uuid4().hex}"), os.path.join(self.path, f"manifest-{version:012d}.json")
        with open(tmp, "w") as file:
            json.dump(state | {"version": version}, file)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(tmp, final)
        except FileExistsError:
            return False
        finally:
            os.unlink(tmp)
        self.state = state | {"version": version}
        return True

    def _commit(self, change: Callable[[dict], None]) -> None:
        """Apply ``change`` to a copy of the state and publish it, again from the newest version where that has moved."""
        for _ in range(100):
            state = copy.deepcopy(self.state)
            change(state)
            if self._publish(state):
                return
            self.refresh()
        raise VersionConflict(f"version {self.state['version'] + 1} is always taken")

    # Catalog.

    def destroy(self) -> None:
        self.active, self.frozen = {}, {}
        shutil.rmtree(self.path)

    def close(self) -> None:
        """Flush every buffer."""
        for name in list(self.active):
            if name in self.state["tables"]:
                self.flush(name)

    def create_table(self, name: str, key: str, key_type: str, columns: dict[str, str]) -> None:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise InvalidSchema(f"bad table name {name!r}")
        if key_type not in KEY_TYPES or any(t not in TYPES for t in columns.values()) or key in columns or not key or "" in columns or {"_seq", "_deleted"} & {key, *columns}:
            raise InvalidSchema(f"bad columns of {name}")

        def change(state):
            if name in state["tables"]:
                raise TableExists(name)
            state["tables"][name] = {"id": uuid.uuid4().hex, "key": key, "key_type": key_type, "columns": columns, "runs": [], "last_seq": 0, "batches": {}}

        self._commit(change)

    def drop_table(self, name: str) -> None:
        folder = self._folder(name)

        def change(state):
            if state["tables"].pop(name, None) is None:
                raise TableNotFound(name)

        self._commit(change)
        self.active.pop(name, None)
        self.frozen.pop(name, None)
        shutil.rmtree(folder, ignore_errors=True)

    def table_names(self) -> list[str]:
        return sorted(self.state["tables"])

    def table_schema(self, name: str) -> dict | None:
        t = self.state["tables"].get(name)
        return t and {k: t[k] for k in ("key", "key_type", "columns")}

    def _table(self, name: str, state: dict | None = None) -> dict:
        tables = (state or self.state)["tables"]
        if name not in tables:
            raise TableNotFound(name)
        return tables[name]

    def _folder(self, name: str) -> str:
        """A dropped and recreated table has another folder."""
        return os.path.join(self.path, f"{name}-{self._table(name)['id']}")

    # Batches.

    def _checked(self, t: dict, df: DataFrame) -> DataFrame:
        """Exact types and no nulls; Spark fails the write at the first null.  A timestamp without a zone is one of the session's zone."""
        kinds = {f.name: f.dataType.simpleString().replace("timestamp_ntz", "timestamp") for f in df.schema}
        if kinds.get(t["key"]) != TYPES[t["key_type"]]:
            raise PrimaryKeyTypeMismatch(f"{t['key']}: {kinds.get(t['key'])}")
        if set(kinds) - {t["key"]} != set(t["columns"]):
            raise ColumnCountMismatch(f"{sorted(kinds)}")
        for c, kind in t["columns"].items():
            if kinds[c] != TYPES[kind]:
                raise ColumnTypeMismatch(f"{c}: {kinds[c]}")
        return df.select(*[_present(c, kinds[c]) for c in (t["key"], *t["columns"])])

    def _write(self, name: str, df: DataFrame) -> str:
        """A run of (key, columns, _deleted), sorted by key in ranges, with a bloom filter of the keys."""
        key, run = self._table(name)["key"], f"run-{uuid.uuid4().hex}"
        path = os.path.join(self._folder(name), run)
        width = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = df.repartitionByRange(width, key).sortWithinPartitions(key)
        try:
            dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.fpp#" + key, "0.1").parquet(path)
        except Exception as e:
            shutil.rmtree(path, ignore_errors=True)
            if found := re.search(r"null in [^\s'\"\]]+", str(e)):
                raise NullValue(found[0]) from e
            raise
        return run

    def _append(self, name: str, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        run = self._write(name, df)

        def change(state):
            t = self._table(name, state)
            t["last_seq"] += 1
            t["runs"].append({"id": run, "level": 0, "seq": t["last_seq"]})
            if batch:
                t["batches"][batch[0]] = batch[1]

        self._commit(change)
        self._compact_if_due(name)

    def insert(self, name: str, df: DataFrame, order: str | list[str] | None = None, batch: tuple[str, int] | None = None) -> None:
        """Upsert a batch.  Keys must be distinct unless ``order`` names the columns that rank their versions.

        ``batch`` (a stream's name and its batch number) makes a repeated batch do nothing.
        """
        t = self._table(name)
        if batch and t["batches"].get(batch[0], -1) >= batch[1]:
            return
        rows = self._checked(t, df)
        if order:
            rows = merge.latest(rows, [t["key"]], [order] if isinstance(order, str) else order)
        elif not df.groupBy(t["key"]).count().where("count > 1").isEmpty():
            raise InvalidSchema("repeated keys in a batch need an order column")
        self.flush(name)  # buffered rows are older
        self._append(name, rows.withColumn("_deleted", F.lit(False)), batch)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Blind tombstones: a missing key is no error, a null one is."""
        t = self._table(name)
        kind = keys.schema[t["key"]].dataType.simpleString().replace("timestamp_ntz", "timestamp")
        if kind != TYPES[t["key_type"]]:
            raise PrimaryKeyTypeMismatch(f"{t['key']}: {kind}")
        rows = keys.select(_present(t["key"], kind)).distinct().withColumns({c: F.lit(None).cast(TYPES[k]) for c, k in t["columns"].items()})
        self.flush(name)
        self._append(name, rows.withColumn("_deleted", F.lit(True)))

    def write_log(self, name: str, df: DataFrame, order: list[str], deleted: str, batch: tuple[str, int] | None = None) -> None:
        """A batch of upserts and deletes in one run: rows where ``deleted`` holds are tombstones."""
        t = self._table(name)
        if batch and t["batches"].get(batch[0], -1) >= batch[1]:
            return
        newest = merge.latest(df, [t["key"]], order)
        flag = F.coalesce(F.col(deleted), F.lit(False)).alias("_deleted")
        kinds = {f.name: f.dataType.simpleString().replace("timestamp_ntz", "timestamp") for f in df.schema}
        if kinds.get(t["key"]) != TYPES[t["key_type"]]:
            raise PrimaryKeyTypeMismatch(f"{t['key']}: {kinds.get(t['key'])}")
        for c, kind in t["columns"].items():
            if kinds.get(c) != TYPES[kind]:
                raise ColumnTypeMismatch(f"{c}: {kinds.get(c)}")
        cells = [F.when(F.coalesce(F.col(deleted), F.lit(False)), F.lit(None)).otherwise(_present(c, kinds[c])).cast(TYPES[t["columns"][c]]).alias(c) for c in t["columns"]]
        self.flush(name)
        self._append(name, newest.select(_present(t["key"], kinds[t["key"]]), *cells, flag), batch)

    # Single rows.

    def _key(self, t: dict, key):
        if not fits(key, t["key_type"]):
            raise PrimaryKeyTypeMismatch(f"expected {t['key_type']}, got {key!r}")
        return _timestamp(key) if t["key_type"] == "timestamp" else key

    def put(self, name: str, key, row: dict) -> None:
        """Upsert one row into the buffer; its types are checked as they stand."""
        with self.metrics.timed("put_duration_us", name):
            t = self._table(name)
            key = self._key(t, key)
            if set(row) != set(t["columns"]):
                raise ColumnCountMismatch(f"{sorted(row)}")
            for c, kind in t["columns"].items():
                if row[c] is None:
                    raise NullValue(f"null in {c}")
                if not fits(row[c], kind):
                    raise ColumnTypeMismatch(f"{c}: expected {kind}, got {row[c]!r}")
            self._buffer(name, key, {c: _timestamp(v) if t["columns"][c] == "timestamp" else v for c, v in row.items()})

    def remove(self, name: str, key) -> None:
        """A tombstone in the buffer; a missing key is no error."""
        with self.metrics.timed("delete_duration_us", name):
            self._buffer(name, self._key(self._table(name), key), None)

    def _buffer(self, name: str, key, row: dict | None) -> None:
        active = self.active.setdefault(name, {})
        active[key] = row
        if len(active) >= self.config.memtable_size:
            self.freeze(name)

    def freeze(self, name: str) -> None:
        """Close the active buffer.  A writer whose queue is full waits for a flush of it."""
        if self.active.get(name):
            queue = self.frozen.setdefault(name, [])
            if len(queue) >= self.config.max_frozen_memtables:
                self._flush_frozen(name)
            queue.append(self.active.pop(name))

    def _flush_frozen(self, name: str) -> int:
        done, queue = 0, self.frozen.get(name, [])
        while queue:
            with self.metrics.timed("flush_duration_ms", name):
                self._append(name, self._rows(self._table(name), queue[0]))
            queue.pop(0)  # only now: a reader never misses it
            done += 1
        return done

    def flush(self, name: str) -> int:
        """Write the buffers as runs, oldest first; the number of runs.  An empty buffer writes none."""
        self._table(name)
        self.freeze(name)
        return self._flush_frozen(name)

    def _schema(self, t: dict) -> str:
        return ", ".join([f"`{t['key']}` {TYPES[t['key_type']]}", *(f"`{c}` {TYPES[k]}" for c, k in t["columns"].items()), "_deleted boolean"])

    def _rows(self, t: dict, buffer: dict) -> DataFrame:
        rows = [(k, *[r[c] if r else None for c in t["columns"]], r is None) for k, r in buffer.items()]
        return self.spark.createDataFrame(rows, self._schema(t))

    # Reads.

    def _log(self, name: str, runs: list[dict]) -> DataFrame:
        t = self._table(name)
        parts = [self.spark.read.schema(self._schema(t)).parquet(os.path.join(self._folder(name), r["id"])).withColumn("_seq", F.lit(r["seq"]).cast("long")) for r in runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._schema(t) + ", _seq bigint")

    def _buffers(self, name: str) -> list[dict]:
        return [*self.frozen.get(name, []), *([self.active[name]] if self.active.get(name) else [])]

    def current(self, name: str) -> DataFrame:
        t = self._table(name)
        log = self._log(name, t["runs"])
        for k, buffer in enumerate(self._buffers(name), 1):
            log = log.unionByName(self._rows(t, buffer).withColumn("_seq", F.lit(t["last_seq"] + k).cast("long")))
        return merge.live(log, [t["key"]], ["_seq"]).drop("_seq", "_deleted")

    def list_rows(self, name: str) -> DataFrame:
        return self.current(name).orderBy(self._table(name)["key"])

    def get(self, name: str, value) -> DataFrame:
        """The row of one key; the filter reaches every run's scan."""
        with self.metrics.timed("get_duration_us", name):
            t = self._table(name)
            key = self._key(t, value)
            for buffer in reversed(self._buffers(name)):  # the newest version may not have left the driver
                if key in buffer:
                    return self._rows(t, {key: buffer[key]} if buffer[key] else {}).drop("_deleted")
            return merge.live(self._log(name, t["runs"]).where(F.col(t["key"]) == F.lit(key)), [t["key"]], ["_seq"]).drop("_seq", "_deleted")

    # Maintenance.

    def _compact_if_due(self, name: str) -> None:
        if sum(r["level"] == 0 for r in self._table(name)["runs"]) >= self.config.level_0_size:
            self.compact(name)

    def compact(self, name: str, major: bool = False) -> None:
        """Minor: level-0 runs become one level-1 run, tombstones kept.  Major: all runs, tombstones dropped.

        The new run takes the place of the newest run it replaces.
        """
        runs = [r for r in self._table(name)["runs"] if major or r["level"] == 0]
        if not runs:
            return
        with self.metrics.timed("compaction_duration_ms", name):
            fold = merge.live if major else merge.latest
            run = self._write(name, fold(self._log(name, runs), [self._table(name)["key"]], ["_seq"]).drop("_seq"))
            old = {r["id"] for r in runs}

            def change(state):
                t = self._table(name, state)
                if not old <= {r["id"] for r in t["runs"]}:
                    raise VersionConflict(f"another writer has compacted {name}")
                t["runs"] = sorted([r for r in t["runs"] if r["id"] not in old] + [{"id": run, "level": 1, "seq": max(r["seq"] for r in runs)}], key=lambda r: r["seq"])

            self._commit(change)

    def gauges(self, name: str) -> dict[str, int]:
        """Runs of each level and buffered entries."""
        runs = self._table(name)["runs"]
        return {"level_0_runs": sum(r["level"] == 0 for r in runs), "level_1_runs": sum(r["level"] == 1 for r in runs), "frozen_memtables": len(self.frozen.get(name, [])), "buffered_entries": sum(map(len, self._buffers(name)))}

    def vacuum(self, name: str, grace: float = 3600.0) -> None:
        """Delete runs that the newest manifest doesn't name and that are older than ``grace`` seconds, and manifests before it.

        Younger runs may be of writers about to publish or of readers of an earlier version.
        """
        folder, limit, names = self._folder(name), time.time() - grace, self._manifests()
        with open(os.path.join(self.path, names[-1])) as file:
            newest = json.load(file)["tables"].get(name, {"runs": []})
        keep = {r["id"] for r in newest["runs"]}
        for run in os.listdir(folder) if os.path.isdir(folder) else ():
            path = os.path.join(folder, run)
            if run not in keep and os.path.getmtime(path) < limit:
                shutil.rmtree(path)
        for old in names[:-1]:
            path = os.path.join(self.path, old)
            if os.path.getmtime(path) < limit:
                os.unlink(path)


def _present(name: str, kind: str):
    """A column that fails the write where it is null, of its declared type."""
    return F.coalesce(F.col(name).cast(kind), F.raise_error(F.lit(f"null in {name}")).cast(kind)).alias(name)

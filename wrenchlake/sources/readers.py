"""Data sources: listings of a store's keys, and tables of a SQLite file.

Both run in Spark's Python data source interface, so partitions are listed or read by executors.  Register them once a session
with ``register``; their classes travel by value, so executors need pyarrow but not this package.
"""

from __future__ import annotations

import sqlite3
import sys
from collections.abc import Iterator
from contextlib import closing
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .tables import SCHEMAS, schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Partitions of a listing or of a table; each takes a range of names or rowids.
PARTITIONS = 32


class Slice(InputPartition):
    def __init__(self, value):
        super().__init__(value)


# ---- keys


def entries(store, folder: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds, in the order of the keys: a folder sorts by its name and a slash."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(((x.base_name + "/" * (x.type == fs.FileType.Directory), x.type == fs.FileType.Directory) for x in found), key=lambda x: x[0].encode())


def walk(store, root: str, key: str, prefix: str) -> Iterator[str]:
    """Keys below the folder ``key``, in order, that begin with the prefix; folders that cannot hold any are not listed."""
    for name, is_folder in entries(store, f"{root}/{key}".rstrip("/")):
        full = key + name
        if is_folder and (full.startswith(prefix) or prefix.startswith(full)):
            yield from walk(store, root, full, prefix)
        elif not is_folder and full.startswith(prefix):
            yield full


class KeyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.prefix, self.most = options["path"], options.get("prefix", ""), int(options.get("max_keys", "500"))

    def store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")
        return store, root.rstrip("/")

    def partitions(self) -> list[Slice]:
        """Runs of neighbouring entries of the folder that the prefix ends in."""
        store, root = self.store()
        folder = self.prefix[: self.prefix.rfind("/") + 1]
        names = [(folder + n, d) for n, d in entries(store, f"{root}/{folder}".rstrip("/")) if (folder + n).startswith(self.prefix)]
        size = max(1, -(-len(names) // PARTITIONS))
        return [Slice(names[i : i + size]) for i in range(0, len(names), size)] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        """The first ``max_keys`` keys of the run; more cannot be among the first of all."""
        store, root = self.store()
        left = self.most
        for name, is_folder in partition.value:
            for key in walk(store, root, name, self.prefix) if is_folder else [name]:
                if left <= 0:
                    return
                left -= 1
                yield (key,)


class KeyListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "key_listing"

    def schema(self) -> str:
        return "key string"

    def reader(self, schema) -> KeyReader:
        return KeyReader(self.options)


def listed(spark: SparkSession, path: str, prefix: str = "", max_keys: int = 500) -> DataFrame:
    """The first ``max_keys`` keys (paths below ``path``) with the prefix, in order.  Each partition stops at as many."""
    register(spark)
    rows = spark.read.format("key_listing").option("prefix", prefix).option("max_keys", max_keys).load(path)
    return rows.orderBy("key").limit(max_keys)


# ---- SQLite

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[tuple[str, str]]):
        self.path, self.table, self.columns, self.where = options["path"], options["table"], columns, []

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of numbers and texts go to SQLite; Spark keeps the others."""
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and isinstance(f.value, int | str) and not isinstance(f.value, bool):
                self.where.append((f.attribute[0], COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Slice]:
        """Ranges of rowids, which the table is stored by."""
        with closing(self.connect()) as con:
            lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if lo is None:
            return [Slice((0, -1))]
        size = max(1, -(-(hi - lo + 1) // PARTITIONS))
        return [Slice((a, min(a + size - 1, hi))) for a in range(lo, hi + 1, size)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        tests = "".join(f' AND "{c}" {op} ?' for c, op, _ in self.where)
        with closing(self.connect()) as con:
            have = {r[1] for r in con.execute(f'PRAGMA table_info("{self.table}")')}
            if any(c not in have for c, _, _ in self.where):
                return  # a column that is null throughout compares with nothing
            names = ", ".join(f'"{c}"' if c in have else "NULL" for c, _ in self.columns)
            rows = con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?{tests}', [*partition.value, *[v for _, _, v in self.where]])
            for row in rows:
                yield tuple(typed(v, kind) for v, (_, kind) in zip(row, self.columns, strict=True))


def typed(value, kind: str):
    """SQLite's numbers and ISO texts as Spark's booleans and times."""
    if value is None:
        return None
    if kind == "boolean":
        return bool(value)
    if kind.startswith("timestamp"):
        return datetime.fromisoformat(value) if isinstance(value, str) else datetime.fromtimestamp(value)
    if kind == "date":
        return datetime.fromisoformat(value).date()
    return str(value) if kind == "string" else value


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, [(f.name, f.dataType.simpleString()) for f in schema.fields])


def load_sqlite(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the engine's tables from a SQLite file that executors can reach by ``path``; columns that it lacks are null."""
    register(spark)
    if name not in SCHEMAS:
        raise ValueError(f"no table {name}")
    return spark.read.format("sqlite_table").schema(schema(name)).option("table", name).load(path)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (KeyListing, SqliteTable):
        spark.dataSource.register(source)

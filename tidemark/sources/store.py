"""Tables as versioned snapshots, with numbered pointers that are created and never rewritten.

A pointer says which folders make up the table, bucket by bucket, and which micro-batch of
which writer it holds. A reader takes the last one, so it sees the old table or the new one,
and a failed write changes nothing. A write claims the number behind the one it began with;
if someone else has it, the write fails. Raw tables are appended by folders of writer and
batch: a repeated batch replaces itself and nothing else. Paths go through Hadoop's file
system, so any store that Spark writes will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINTERS = "_pointers"
_BUCKET = "__bucket"
#: How files are written: differences and common beginnings, then compressed; small row groups, as a task may have several files open.
OPTIONS = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(32 << 20)}
#: While a table is written: rows aren't sorted by partition while a task has few of them, and shuffle files go when the write is done.
_WRITING = {"spark.sql.maxConcurrentOutputFileWriters": "8", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def writing(rows: DataFrame) -> Iterator[None]:
    """Settings of a write, put back afterwards. ``rows`` must not be cached: their shuffle files go."""
    conf = rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


class Conflict(RuntimeError):
    """The table was written by someone else meanwhile."""


@dataclass(frozen=True)
class Version:
    """What a pointer says: its number, folders by bucket, the schema, and the last batch of each writer."""

    number: int = -1
    folders: dict[str, str] = field(default_factory=dict)
    schema: str = ""
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, table: str) -> list[int]:
        folder = self._path(table, _POINTERS)
        fs = self._fs(folder)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getLen() and not s.getPath().getName().startswith((".", "_"))) if fs.exists(folder) else []

    def _pointer(self, table: str, number: int) -> Version:
        path = self._path(table, _POINTERS, f"{number:012d}")
        stream = self._fs(path).open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def version(self, table: str) -> Version | None:
        """The current snapshot: the last complete pointer's."""
        numbers = self._numbers(table)
        return self._pointer(table, numbers[-1]) if numbers else None

    def exists(self, table: str) -> bool:
        return bool(self._numbers(table))

    def read(self, table: str) -> DataFrame:
        version = self.version(table)
        if version is None:
            raise LookupError(f"no table {table}")
        return self._read(table, version)

    def _read(self, table: str, version: Version, folders: Iterable[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(version.schema))
        places = [f"{self.root}/{table}/{f}" for f in (version.folders.values() if folders is None else folders)]
        return self.spark.read.schema(schema).parquet(*places).select(*schema.fieldNames()) if places else self.spark.createDataFrame([], schema)

    def _point(self, table: str, version: Version) -> None:
        """Claim the version's number: the file is created where there is none, with one write."""
        path = self._path(table, _POINTERS, f"{version.number:012d}")
        text = json.dumps({"folders": version.folders, "schema": version.schema, "batches": version.batches})
        try:
            stream = self._fs(path).create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"{table} was written by someone else meanwhile") from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def overwrite(self, table: str, rows: DataFrame, partition_by: Iterable[str] = (), since: Version | None = None, batch: tuple[str, int] | None = None) -> None:
        """Write a whole new snapshot, then point to it. ``rows`` may read the old one.

        ``since`` is the version that ``rows`` derive from, if they were read before this call;
        ``batch`` is the writer and number of the micro-batch that they now hold.
        """
        since = since or self.version(table) or Version()
        folder = f"v{uuid.uuid4().hex}"
        with writing(rows):
            rows.write.options(**OPTIONS).partitionBy(*partition_by).parquet(f"{self.root}/{table}/{folder}")
        self._point(table, Version(since.number + 1, {"": folder}, rows.schema.json(), since.batches | (dict([batch]) if batch else {})))

    def merge(self, table: str, updates: DataFrame, key: str, how: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64, batch: tuple[str, int] | None = None, bytes_each: int = 64 << 20) -> None:
        """Merge updates into a table dealt into buckets by a hash of the key; only the buckets they touch are rewritten.

        ``how`` gives the new rows from the old ones and the updates. A table that isn't in buckets yet is dealt out.
        Some buckets at a time are written, of about ``bytes_each`` together or one, so that a merge shuffles a part of
        the table at once; the table changes with the last of them.
        """
        since = self.version(table) or Version(schema=updates.schema.json())
        cell: Column = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")
        whole = "" in since.folders
        updates = updates.withColumn(_BUCKET, cell)
        touched = list(map(str, range(buckets))) if whole else sorted(r[0] for r in updates.select(_BUCKET).distinct().collect())  # at most ``buckets``
        if not touched and since.number >= 0:
            return self._point(table, Version(since.number + 1, since.folders, since.schema, since.batches | (dict([batch]) if batch else {})))
        read = [f for b, f in since.folders.items() if whole or b in touched]
        size = sum(self._fs(p).getContentSummary(p).getLength() for p in (self._path(table, f) for f in read)) + _known_bytes(updates)
        turns = max(1, min(len(touched), -(-size // bytes_each)))
        folders = {} if whole else {b: f for b, f in since.folders.items() if b not in touched}
        for group in (touched[i::turns] for i in range(turns)):
            old = self._read(table, since, None if whole else [since.folders[b] for b in group if b in since.folders])
            mine = updates
            if turns > 1:
                old, mine = old.filter(cell.isin(group)) if whole else old, updates.filter(F.col(_BUCKET).isin(group))
            rows = how(old, mine.drop(_BUCKET)).withColumn(_BUCKET, cell)
            name = f"v{uuid.uuid4().hex}"
            with writing(rows):
                rows.repartition(_BUCKET).write.options(**OPTIONS).partitionBy(_BUCKET).parquet(f"{self.root}/{table}/{name}")
            made = self._path(table, name)
            fresh = {s.getPath().getName().split("=", 1)[1] for s in self._fs(made).listStatus(made) if "=" in s.getPath().getName()}
            folders |= {b: f"{name}/{_BUCKET}={b}" for b in sorted(fresh)}
        self._point(table, Version(since.number + 1, folders, updates.drop(_BUCKET).schema.json(), since.batches | (dict([batch]) if batch else {})))

    def holds(self, table: str, batch: tuple[str, int]) -> bool:
        """Whether the table has that micro-batch of that writer, or a later one, already."""
        version = self.version(table)
        return version is not None and version.batches.get(batch[0], -1) >= batch[1]

    def vacuum(self, table: str, keep: int = 2) -> int:
        """Remove pointers behind the last ``keep`` and folders that none of those names; how many folders went.

        Not while the table is written: what a write has not pointed to yet would go as well.
        """
        numbers = self._numbers(table)
        used = {f.split("/")[0] for n in numbers[-keep:] for f in self._pointer(table, n).folders.values()}
        inner = {f for n in numbers[-keep:] for f in self._pointer(table, n).folders.values()}
        top, gone = self._path(table), 0
        fs = self._fs(top)
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            if name.startswith("v") and name not in used:
                gone += fs.delete(status.getPath(), True)
            elif name.startswith("v"):
                for part in fs.listStatus(status.getPath()):
                    if part.getPath().getName().startswith(f"{_BUCKET}=") and f"{name}/{part.getPath().getName()}" not in inner:
                        gone += fs.delete(part.getPath(), True)
        for n in numbers[:-keep]:
            fs.delete(self._path(table, _POINTERS, f"{n:012d}"), False)
        return gone

    def replace_where(self, table: str, rows: DataFrame, column: str, value: str) -> None:
        """Replace the rows with column = value (also by nothing), keeping all others."""
        since = self.version(table)
        if since:
            rows = self._read(table, since).filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(rows)
        self.overwrite(table, rows, since=since)

    def drop(self, table: str) -> None:
        """Remove a table with all its snapshots and batches."""
        self._fs(self._path(table)).delete(self._path(table), True)

    def delete_all(self, table: str) -> None:
        self.overwrite(table, self.read(table).limit(0))

    def create(self, table: str, schema: T.StructType, partition_by: Iterable[str] = ()) -> None:
        """An empty table unless there is one."""
        if not self.exists(table):
            self.overwrite(table, self.spark.createDataFrame([], schema), partition_by)

    def append_batch(self, table: str, rows: DataFrame, writer: str, batch: int, partition_by: Iterable[str] = ()) -> None:
        """Add a writer's numbered batch; writing the same one again replaces it, another writer's stays."""
        with writing(rows):
            rows.write.options(**OPTIONS).mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{table}/writer={writer}/batch={batch}")

    def has_batches(self, table: str) -> bool:
        found = self._fs(self._path(table)).globStatus(self._path(table, "writer=*", "batch=*"))
        return bool(found)

    def read_batches(self, table: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}/writer=*/batch=*")

    def register(self, tables: Iterable[str]) -> None:
        """Temporary views of the current snapshots."""
        for t in tables:
            self.read(t).createOrReplaceTempView(t)

    def run_script(self, text: str) -> None:
        """Run SQL statements separated by semicolons; semicolons in quotes and comments don't count."""
        for statement in split_statements(text):
            self.spark.sql(statement)


def _known_bytes(rows: DataFrame) -> int:
    """Bytes of what ``rows`` read, by the optimizer's statistics; 0 where it has none."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(n for n in (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) if n < 1 << 60)


def split_statements(text: str) -> list[str]:
    found, now, i, quote = [], [], 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            now.append(c)
            quote = "" if c == quote else quote
        elif text.startswith("--", i):
            i = (text.find("\n", i) + 1 or len(text) + 1) - 1
            now.append("\n")
        elif c == ";":
            found.append("".join(now).strip())
            now = []
        else:
            quote = c if c in "'\"`" else ""
            now.append(c)
        i += 1
    return [s for s in [*found, "".join(now).strip()] if s]

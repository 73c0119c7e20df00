"""Tables with atomic commits and a history, on plain Parquet.

A write puts its files into a new folder of a name of its own; nothing sees them
until a commit names that folder. A commit is a small file, ``_commits/N.json``, that
holds the table's schema and the folders it consists of; it is written under
another name and renamed to a number that no other commit has. So a reader sees one
version or the other, a writer that dies leaves nothing that counts, of two writers
of one version one fails, an append adds a folder without rewriting any, and a table
can be rewritten from itself, read at a version, and restored (by one more commit).
Files go through Hadoop's file system, whichever it is.

A table may be ``dealt``: its rows lie by the hash of a column in so many buckets, as
Spark's own bucketed files, so that what meets or is grouped by that column isn't
shuffled. Each task that writes puts its rows into a file for each bucket.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.cleaning import conform

_NAME = re.compile(r"[a-z_][a-z0-9_]*")
#: Tries of an append that meets another writer's commit.
TRIES = 5


@dataclass(frozen=True)
class Context:
    """Where a run reads and writes; passed to every stage, never global."""

    spark: SparkSession
    root: str
    run_id: str = ""
    run_date: str = "1970-01-01"
    keep: int = 5

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.
    Where it is unset, a local session gets one of its own, removed when Python
    ends; on a cluster it is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return base


def hadoop(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A new file, whole from the moment it is there; False if there is one."""
    folder, _, name = path.rpartition("/")
    fs, part = hadoop(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    files, _ = hadoop(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(part, at, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as error:
        if "FileAlreadyExists" not in str(error) and not fs.exists(at):
            raise
        fs.delete(part, False)
        return False


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = hadoop(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    held = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
    stream.close()
    return bytes(held).decode()


def write_parquet(df: DataFrame, path: str, dealt: tuple[str, int] | None = None) -> None:
    """``df`` as Parquet in a new folder; ``dealt``, a column and how many buckets. A task
    then keeps a file open for each bucket and sorts nothing."""
    out = df.write.option("compression", "zstd")
    if dealt is None:
        out.parquet(path)
        return
    spark, (column, n), known = df.sparkSession, dealt, f"ledgerline_{uuid.uuid4().hex}"
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, str(n))
    try:
        # Spark writes buckets for tables of its catalog only; the files stay without it.
        fs, at = hadoop(spark, path)
        out.format("parquet").option("path", fs.makeQualified(at).toString()).bucketBy(n, column).saveAsTable(known)
    finally:
        spark.conf.set(writers, before)
        spark.sql(f"DROP TABLE IF EXISTS {known}")


def _read_dealt(spark: SparkSession, schema: StructType, paths: list[str], dealt: tuple[str, int]) -> DataFrame:
    """Folders of ``write_parquet`` with their buckets, which the reader has no option for."""
    jvm, column, n = spark._jvm, *dealt
    held, option = jvm.org.apache.spark.api.python.PythonUtils, jvm.scala.Option.apply
    buckets = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(n, held.toSeq([column]), held.toSeq([]))
    kinds = jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json())
    source = jvm.org.apache.spark.sql.execution.datasources.DataSource(spark._jsparkSession, "parquet", held.toSeq(paths), option(kinds), held.toSeq([]), option(buckets), held.toScalaMap({}), option(None))
    return DataFrame(spark._jsparkSession.baseRelationToDataFrame(source.resolveRelation(True, True)), spark)


@dataclass(frozen=True)
class Commit:
    """A version of a table: its schema with comments and what mustn't be null, its
    folders, of each stream that writes it the last batch, and how it is dealt."""

    number: int
    schema: StructType
    folders: tuple[str, ...]
    comment: str = ""
    batches: tuple[tuple[str, int], ...] = ()
    dealt: tuple[str, int] | None = None

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "folders": self.folders, "comment": self.comment, "batches": dict(self.batches), "dealt": self.dealt})

    @classmethod
    def parse(cls, number: int, text: str) -> Commit:
        held = json.loads(text)
        return cls(number, StructType.fromJson(held["schema"]), tuple(held["folders"]), held["comment"], tuple(held["batches"].items()), tuple(held["dealt"]) if held.get("dealt") else None)


def _described(schema: StructType, like: StructType | None) -> StructType:
    """``schema``, with what ``like`` declares of the columns of the same name."""
    known = {f.name: f for f in like} if like is not None else {}
    return StructType([StructField(f.name, f.dataType, known[f.name].nullable if f.name in known else True, known[f.name].metadata if f.name in known else f.metadata) for f in schema])


class Tables:
    """The tables of a context, by layer and name (``gold.dim_date``)."""

    def __init__(self, context: Context) -> None:
        self.context, self.spark = context, context.spark

    def _folder(self, name: str) -> str:
        parts = name.split(".")
        if len(parts) != 2 or not all(_NAME.fullmatch(p) for p in parts):
            raise ValueError(f"a table is named layer.table, not {name}")
        return self.context.path(*parts)

    # --- layers -------------------------------------------------------------
    def ensure_layers(self, *names: str) -> list[str]:
        """Layers made where they aren't there; all that are."""
        for name in names:
            if not _NAME.fullmatch(name):
                raise ValueError(f"no name for a layer: {name}")
            fs, at = hadoop(self.spark, self.context.path(name))
            fs.mkdirs(at)
        fs, at = hadoop(self.spark, self.context.root)
        return sorted(n for s in fs.listStatus(at) if s.isDirectory() and _NAME.fullmatch(n := s.getPath().getName()) and not n.startswith("_"))

    # --- versions -----------------------------------------------------------
    def history(self, name: str) -> list[int]:
        """The versions that are kept, oldest first: those that were committed."""
        fs, at = hadoop(self.spark, f"{self._folder(name)}/_commits")
        if not fs.exists(at):
            return []
        found = (re.fullmatch(r"(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(at))
        return sorted(int(m[1]) for m in found if m)

    def exists(self, name: str) -> bool:
        return bool(self.history(name))

    def version(self, name: str) -> int:
        held = self.history(name)
        if not held:
            raise LookupError(f"there is no table {name}")
        return held[-1]

    def commit(self, name: str, version: int | None = None) -> Commit:
        number = self.version(name) if version is None else version
        if number not in self.history(name):
            raise LookupError(f"{name} has no version {number}")
        return Commit.parse(number, read_text(self.spark, f"{self._folder(name)}/_commits/{number}.json"))

    def _commit(self, name: str, commit: Commit) -> None:
        folder = self._folder(name)
        fs, at = hadoop(self.spark, f"{folder}/_commits")
        fs.mkdirs(at)
        if not _write_new(self.spark, f"{folder}/_commits/{commit.number}.json", commit.text()):
            raise Conflict(f"{name} has a version {commit.number} by another writer")
        self._forget(name)

    def _forget(self, name: str) -> None:
        """Versions beyond the ones to keep, and folders that only these had. What no
        commit names may be another writer's, and stays."""
        held, folder = self.history(name), self._folder(name)
        old, kept = held[: -self.context.keep], held[-self.context.keep :]
        if not old:
            return
        used = {f for n in kept for f in self.commit(name, n).folders}
        gone = {f for n in old for f in self.commit(name, n).folders} - used
        for path in [*(f"{folder}/_commits/{n}.json" for n in old), *(f"{folder}/{f}" for f in gone)]:
            fs, at = hadoop(self.spark, path)
            fs.delete(at, True)

    # --- reading ------------------------------------------------------------
    def read(self, name: str, version: int | None = None) -> DataFrame:
        now = self.commit(name, version)
        return self._frame(name, now.schema, now.folders, now.dealt)

    def _frame(self, name: str, schema: StructType, folders: tuple[str, ...], dealt: tuple[str, int] | None = None) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        if dealt:
            return _read_dealt(self.spark, schema, [f"{self._folder(name)}/{f}" for f in folders], dealt)
        return self.spark.read.schema(schema).parquet(*(f"{self._folder(name)}/{f}" for f in folders))

    def count(self, name: str) -> int:
        """Rows; 0 for a table that isn't there, while any other error is one."""
        return self.read(name).count() if self.exists(name) else 0

    def describe(self, name: str) -> DataFrame:
        """(column_name, data_type, nullable, comment) of a table."""
        rows = [(f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment")) for f in self.commit(name).schema]
        return self.spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean, comment string")

    # --- writing ------------------------------------------------------------
    def create(self, name: str, ddl: str, comment: str = "") -> bool:
        """An empty table of a schema in DDL (with ``NOT NULL`` and ``COMMENT``), if
        there is none; whether it was made."""
        if self.exists(name):
            return False
        try:
            self._commit(name, Commit(0, StructType.fromDDL(ddl), (), comment))
        except Conflict:
            return False
        return True

    def declare(self, name: str, not_null: tuple[str, ...] = (), comments: dict[str, str] | None = None, comment: str | None = None) -> None:
        """What columns mean and which mustn't be null, from now on."""
        now, comments = self.commit(name), comments or {}
        unknown = (set(not_null) | set(comments)) - set(now.schema.names)
        if unknown:
            raise LookupError(f"{name} has no {', '.join(sorted(unknown))}")
        schema = StructType([StructField(f.name, f.dataType, f.nullable and f.name not in not_null, f.metadata | ({"comment": comments[f.name]} if f.name in comments else {})) for f in now.schema])
        if schema == now.schema and comment in (None, now.comment):
            return
        self._no_nulls(name, schema, now.folders)
        self._commit(name, Commit(now.number + 1, schema, now.folders, now.comment if comment is None else comment, now.batches, now.dealt))

    def _no_nulls(self, name: str, schema: StructType, folders: tuple[str, ...]) -> None:
        required = [f.name for f in schema if not f.nullable]
        if required and folders:
            found = self._frame(name, StructType([StructField(f.name, f.dataType) for f in schema]), folders)
            if not found.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])).isEmpty():
                raise ValueError(f"{name} must not hold nulls in {', '.join(required)}")

    def _written(self, name: str, df: DataFrame, dealt: tuple[str, int] | None = None) -> str:
        part = f"part={uuid.uuid4().hex}"
        write_parquet(df, f"{self._folder(name)}/{part}", dealt)
        return part

    def replace(self, name: str, df: DataFrame, comment: str | None = None, dealt: tuple[str, int] | None = None) -> int:
        """``df`` becomes the table; returns its rows."""
        now = self.commit(name) if self.exists(name) else None
        part = self._written(name, df, dealt) if dealt else self._written(name, df)
        return self._replaced(name, now, part, df.schema, comment, dealt)

    def adopt(self, name: str, path: str, schema: StructType, comment: str | None = None, dealt: tuple[str, int] | None = None) -> int:
        """The Parquet files of ``path``, a folder of the same file system that nothing
        else reads, become the table, by a rename; returns its rows. ``dealt`` is how
        they were written."""
        now, part = self.commit(name) if self.exists(name) else None, f"part={uuid.uuid4().hex}"
        fs, at = hadoop(self.spark, path)
        _, to = hadoop(self.spark, f"{self._folder(name)}/{part}")
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise OSError(f"{path} can't become a part of {name}")
        return self._replaced(name, now, part, schema, comment, dealt)

    def _replaced(self, name: str, now: Commit | None, part: str, schema: StructType, comment: str | None, dealt: tuple[str, int] | None = None) -> int:
        """``part`` becomes the table, if its version is still ``now``."""
        schema = _described(schema, now.schema if now else None)
        self._no_nulls(name, schema, (part,))
        self._commit(name, Commit(now.number + 1 if now else 0, schema, (part,), (now.comment if now else "") if comment is None else comment, now.batches if now else (), dealt))
        return self._frame(name, schema, (part,)).count()

    @contextmanager
    def dealt_out(self, df: DataFrame, dealt: tuple[str, int]) -> Iterator[DataFrame]:
        """``df`` dealt through files, which are removed at the end: in columns, wide rows
        are less than half of what they are in a shuffle."""
        stage = self.context.path("_stages", uuid.uuid4().hex)
        try:
            write_parquet(df, stage, dealt)
            yield _read_dealt(self.spark, StructType([StructField(f.name, f.dataType) for f in df.schema]), [stage], dealt)
        finally:
            fs, at = hadoop(self.spark, stage)
            fs.delete(at, True)

    def append(self, name: str, df: DataFrame, evolve: bool = False, batch: tuple[str, int] | None = None, dealt: tuple[str, int] | None = None) -> int:
        """Rows added, without rewriting any; how many. The table's columns and types
        hold; with ``evolve``, columns that it lacks are added, null in older rows,
        and those that ``df`` lacks are null. A new table is made, ``dealt`` as said; rows
        that are added to one that is there are dealt as it is. Of a stream's ``batch``
        (stream, number), one that was added before adds nothing."""
        part = None
        for _ in range(TRIES):
            now = self.commit(name) if self.exists(name) else None
            known, lies = dict(now.batches) if now else {}, dealt
            dealt = now.dealt if now else dealt
            part = part if dealt == lies else None
            if batch and known.get(batch[0], -1) >= batch[1]:
                return 0
            schema = _described(df.schema, None) if now is None else now.schema
            if now is not None and evolve:
                schema = StructType([*schema.fields, *(StructField(f.name, f.dataType, True, f.metadata) for f in df.schema if f.name not in schema.names)])
                missing = [f for f in schema if f.name not in df.columns]
                df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df
            if part is None or (evolve and set(df.columns) != written):
                part, written = self._written(name, conform(df, schema), *([dealt] if dealt else [])), set(df.columns)
            self._no_nulls(name, schema, (part,))
            folders = (*(now.folders if now else ()), part)
            try:
                self._commit(name, Commit(now.number + 1 if now else 0, schema, folders, now.comment if now else "", tuple((known | ({batch[0]: batch[1]} if batch else {})).items()), dealt))
            except Conflict:
                continue
            return self._frame(name, schema, (part,)).count()
        raise Conflict(f"{name} is written by others without end")

    def evolve(self, name: str, df: DataFrame) -> int:
        """Rows added; columns that either side lacks are null there. All rows' number."""
        self.append(name, df, evolve=True)
        return self.count(name)

    def compact(self, name: str) -> int:
        """The same rows in one folder, after many appends."""
        return self.replace(name, self.read(name), dealt=self.commit(name).dealt)

    def restore(self, name: str, version: int) -> None:
        """An earlier version is current again; what came since stays in the history."""
        old, now = self.commit(name, version), self.commit(name)
        self._commit(name, Commit(now.number + 1, old.schema, old.folders, old.comment, now.batches, old.dealt))

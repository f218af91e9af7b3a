"""Helpers that the operators of this subpackage share: sessions, shared folders, Arrow text."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own setting: the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's checkout (on a cluster: from --py-files).

    Two things stay set for the session: the workers' environment, and smaller Arrow batches where the session has the
    default. Both take effect when a plan runs, which is after the operators have returned.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    # workers give large arrays back as soon as they are done with, instead of keeping them for later beside the executor
    for name, value in WORKERS.items():
        env.setdefault(name, value)
    # numpy arrays of a batch are some times its bytes: smaller batches than the default 64 MB
    if spark.conf.get(BATCH, None) == "67108864b":
        spark.conf.set(BATCH, "4m")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_base(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(folder: str):
    """The file system of a folder's URI, and the path in it; a local path means storage that all machines mount."""
    u = urlparse(folder)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(u.path) if u.scheme else folder
    return fs.FileSystem.from_uri(folder)


#: Folders that results still read, oldest first.
_READ: list[str] = []


def delete(folder: str) -> None:
    at, path = open_folder(folder)
    if at.get_file_info(path).type == fs.FileType.Directory:
        at.delete_dir(path)


def mark() -> int:
    """How many folders results read by now; for release."""
    return len(_READ)


def release(since: int = 0) -> None:
    """Delete the folders that results made after a mark read: call it when those results have been consumed.

    What is left goes when the program ends.
    """
    while len(_READ) > since:
        delete(_READ.pop())


@atexit.register
def _release_all() -> None:
    try:
        release()
    except OSError:  # the storage has gone before the program
        pass


class Scratch:
    """The tables that a run of an operator writes into the shared folder, each a cut of the lineage.

    Use it in a `with`: at its end the tables go, but for those that were kept because the result reads them. Inside it
    Spark deletes the shuffle files of each query as soon as that has ended.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n, self.kept = spark, scratch_path(spark, name), 0, []

    def __enter__(self) -> Scratch:
        self.cleanup = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(CLEANUP, self.cleanup)
        at, path = open_folder(self.folder)
        for f in at.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name not in self.kept:
                at.delete_dir(f.path)
        if self.kept:
            _READ.append(self.folder)
        else:
            delete(self.folder)

    def written(self, df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
        """df as Parquet, read back; keep: the operator's result reads it."""
        own = f"{name}-{self.n}"
        self.n += 1
        if keep:
            self.kept.append(own)
        path = f"{self.folder}/{own}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = own
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        for df in tables:
            delete(f"{self.folder}/{df._scratch}")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer where docs has a column of that name."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def column(name: str):
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id as long and the text, so that no other column, however named, can clash."""
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))


#: Estimated bytes up to which a side of a join is broadcast; a larger one is shuffled.
BROADCAST = 32 << 20


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST else df


def trim() -> None:
    """Give a task's memory back: Python workers stay, idle, beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def filtered(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of docs for whose texts `keep` (Texts -> mask) is true, with all columns as they are."""
    at = docs.columns.index(text_col)

    def run(it):
        for batch in it:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(Texts(batch.column(at).cast(pa.string())))))
        trim()

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # mapInArrow reads a dot in a name as a field
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


class Texts:
    """Numpy view of an Arrow string column: bytes, start and end of each row; null is empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
        off = off.astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        base = int(off[0]) if len(off) else 0
        self.data = raw[base : int(off[-1])] if len(off) else raw[:0]
        self.bounds = off - base
        self.starts, self.ends = self.bounds[:-1], self.bounds[1:]

    def __len__(self) -> int:
        return len(self.starts)

    def pieces(self, most: int):
        """Runs of rows (first, last exclusive) of about `most` bytes; a longer row is a piece of its own."""
        first = 0
        while first < len(self):
            last = int(np.searchsorted(self.bounds, self.starts[first] + most, "right")) - 1
            last = min(max(last, first + 1), len(self))
            yield first, last
            first = last


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def batches(spec):
    """A mapInArrow function from one that makes a list of columns of a RecordBatch; spec: [(name, type)]."""
    schema = pa.schema(spec)

    def wrap(make):
        def run(it):
            for batch in it:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, (_, t) in zip(make(batch), spec, strict=True)], schema=schema)
            trim()

        return run

    return wrap

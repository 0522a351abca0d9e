"""What the training-data operators share: hashing, shared storage and batch plumbing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Text handed to one vectorised step, in UTF-8 bytes; bounds a worker's memory whatever the batch size.
SLICE_BYTES = 1_000_000
#: Entries a worker's memo tables may hold before they start anew.
MEMO_MAX = 200_000
#: Rows that small_batches() puts in a batch.
BATCH_ROWS = 2000
#: Bytes of a table of numbers that may be broadcast, at 8 for each value; beyond it the join shuffles.
BROADCAST_BYTES = 16_000_000

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_local_dirs: dict[str, str] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_MAX:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One memo for all operators that a worker runs.
HASHES = WordHashes()


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of which each holds about `most` bytes, or one longer row."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def map_slices(df: DataFrame, step: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """Applies step to bounded row ranges of df, given and returned as lists by column.

    step runs in the Python workers, on Arrow batches, whose bytes Spark bounds
    (spark.sql.execution.arrow.maxBytesPerBatch); every row reaches it whole.
    """
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
            for i, j in slices(sizes, most):
                out = step(batch.slice(i, j - i).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _slices_of(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    for i, j in slices(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        yield batch.slice(i, j - i)


def filter_slices(df: DataFrame, keep: Callable[[list], list], text: str = "text") -> DataFrame:
    """The rows of df for whose texts keep says so; all columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in _slices_of(batch, at):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_slices(df: DataFrame, change: Callable[[list], list], text: str = "text") -> DataFrame:
    """df with other texts; all other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in _slices_of(batch, at):
                new = pa.array(change(part.column(at).to_pylist()), batch.schema.field(at).type)
                yield part.set_column(at, batch.schema.field(at), new)

    return df.mapInArrow(run, df.schema)


def free(df: DataFrame, *names: str) -> list[str]:
    """names with underscores before them until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """For an application whose executors are small: fewer rows in the batches that go to Python workers, for its whole session.

    No operator calls this by itself; without it Spark's own bounds hold.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def to_arrow(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        held = tempfile.TemporaryDirectory(prefix="checkpoints-", ignore_cleanup_errors=True)
        atexit.register(held.cleanup)
        _local_dirs[app] = f"file://{held.name}"
    return _local_dirs[app]


#: What is stored and not yet forgotten: path -> (its file system, the JVM's path).
_stored: dict[str, tuple] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted at the driver's end if forget() hasn't done so."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not _stored:
        atexit.register(_sweep)
    _stored[path] = (at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back; this cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for frames, once nothing reads it any more."""
    for x in frames:
        files, at = _stored.pop(x.stored_path)
        files.delete(at, True)


def _sweep() -> None:
    """Deletes what lazy results still read when the driver ended; a driver that is gone already leaves it."""
    with contextlib.suppress(Exception):
        for files, at in _stored.values():
            files.delete(at, True)


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted, on a stored frame; by default BROADCAST_BYTES of numbers); else as it is."""
    rows = BROADCAST_BYTES // (8 * len(df.columns)) if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

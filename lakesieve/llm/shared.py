"""Helpers that the operators share: scratch tables, Arrow batches, id bounds."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that an operator handles at a time; longer single texts make a slice of their own.
SLICE_BYTES = 1 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); in local mode, as in tests, one is set where it is unset, elsewhere that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lakesieve-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Spark removes an execution's shuffle files when it ends, rather than when the JVM happens to collect its plan.
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, codec: str = "snappy", done_with_shuffles: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/lakesieve-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES, None)
    if done_with_shuffles:
        spark.conf.set(SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if done_with_shuffles:
            spark.conf.set(SHUFFLES, before) if before is not None else spark.conf.unset(SHUFFLES)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as a large_string array without nulls or offsets from a slice."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("")


def slices(n_bytes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes, one row at least."""
    at = total = 0
    for i, n in enumerate(n_bytes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(n_bytes):
        yield at, len(n_bytes)


def trim() -> None:
    """Gives memory that is no longer held back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """A function over Arrow batches that gives memory back to the system when its partition is done: Python workers are used again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def cut(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about limit bytes of text, so that what is made of a batch is bounded too; a longer text is a piece of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.coalesce(pc.binary_length(batch.column(at)), 0).to_pylist() if at >= 0 else [0] * batch.num_rows
        for a, b in slices(sizes, limit):
            yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", limit: int = 1 << 22) -> DataFrame:
    """f on every Arrow batch, in pieces of a few MB of text."""

    def run(batches):
        yield from map(f, cut(batches, text, limit))

    return df.mapInArrow(tidied(run), schema)

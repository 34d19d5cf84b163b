"""op1: threshold-scaled document fingerprints.

A fingerprint keeps every distinct five-word shingle hash that lies below a fixed fraction (2**-LEVEL) of the hash range, whatever the
text's length. So fingerprints merge by union, the merged one being that of both documents together, and give containment and
likeness between documents of very unequal length, since two documents keep or leave the same hash alike. A fingerprint also
carries a digest of all its text's shingles: texts with equal sets are told as equal even if they are too short to keep a
hash. Between different texts of n and m shingles an estimate of likeness rests on about (n + m) / 2**(LEVEL + 1) hashes; where neither
text keeps one, the estimate is 0.

Nulls and empty texts have the fingerprint "0:" and likeness 1 to each other and 0 to any other; a text of one to four words has one
shingle, all its words. Equal texts have equal fingerprints. Repeated rows, and rows with equal ids, are texts of their own, taken
in the order of id and text; a null id comes last. A table of one row is its own next. Input columns other than the id and the
text are ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bytewords import Words, split_by_text

SHINGLE_WORDS, LEVEL = 5, 2
#: Texts in a range of ids, about; and the most ranges, which bounds what is broadcast: larger tables have longer ranges.
RANGE_ROWS, MAX_RANGES = 4096, 1 << 15
Sketch = tuple[int, np.ndarray]


def sketch(shingles: np.ndarray, level: int = LEVEL) -> Sketch:
    """(digest of the set, sorted hashes below 2**(64-level)) of one text's shingle hashes; the digest of none is 0."""
    own = np.unique(shingles)
    return (xxhash.xxh3_64_intdigest(own.tobytes()) | 1) * bool(len(own)), own[: np.searchsorted(own, np.uint64((1 << (64 - level)) - 1), "right")]


def sketches(texts: pa.Array, k: int = SHINGLE_WORDS, level: int = LEVEL) -> list[Sketch]:
    out = []
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)).tolist() if len(texts) else []
    for a, b in shared.slices(sizes):
        hashes, doc = Words(texts.slice(a, b - a)).shingles(k)
        out += [sketch(x, level) for x in split_by_text(hashes, doc, b - a)]
    return out


def encode(digest: int, hashes: np.ndarray) -> str:
    return f"{digest:x}:{base64.b64encode(hashes.astype('<u8').tobytes()).decode()}"


def decode(fingerprint: str) -> Sketch:
    digest, _, body = fingerprint.partition(":")
    return int(digest, 16), np.frombuffer(base64.b64decode(body), "<u8")


def common(a: Sketch, b: Sketch) -> int:
    """How many hashes both keep."""
    x, y = a[1], b[1]
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(x) and len(y) else 0


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity; 1 for equal sets."""
    if a[0] == b[0]:
        return 1.0
    both = common(a, b)
    union = len(a[1]) + len(b[1]) - both
    return both / union if union else 0.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has."""
    if a[0] == b[0]:
        return 1.0
    return common(a, b) / len(a[1]) if len(a[1]) else 0.0


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The fingerprint of both documents' shingles together; its digest is of the two digests, unless one set is the other or empty."""
    hashes = np.union1d(a[1], b[1])
    if a[0] == b[0] or not b[0]:
        return a[0], hashes
    return (xxhash.xxh3_64_intdigest(np.array(sorted((a[0], b[0])), "<u8").tobytes()) | 1 if a[0] else b[0]), hashes


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with each row's fingerprint; no shuffle. A column of the name out is replaced."""
    df = df.drop(out) if out != text else df

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [encode(*s) for s in sketches(shared.texts_of(batch, text))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*batch.schema.names, out])

    from pyspark.sql.types import StringType, StructType

    return shared.map_arrow(df, add, StructType([*df.schema.fields]).add(out, StringType()))


def with_successor(docs: DataFrame) -> DataFrame:
    """doc_id, text in runs of descending doc_id (equal ids by text), each run closed by the row that follows it.

    Ids are cut at quantiles into ranges of about RANGE_ROWS rows; a range's first row is also sent to the end of
    the range before it, so that no task needs another's rows and nothing but texts is shuffled, once.
    Columns: run int, closes boolean, doc_id, text. A null id comes after all others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def run_of(ids: pd.Series) -> pd.Series:  # runs ascend as ids descend
        at = np.searchsorted(cuts, ids.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy(), "left")
        return pd.Series((len(cuts) - at).astype("int32"))

    dealt = docs.withColumn("run", run_of("doc_id"))
    # the largest id of each range: MAX_RANGES rows at most, so it is sent to the driver and broadcast
    firsts = {r["run"]: r["top"] for r in docs.select("doc_id").withColumn("run", run_of("doc_id")).groupBy("run").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(firsts)
    before = [(firsts[r], order[i - 1]) for i, r in enumerate(order)]
    spark = docs.sparkSession
    to = spark.createDataFrame(before, "top long, goes_to int").coalesce(1)
    heads = docs.join(F.broadcast(to), docs.doc_id.eqNullSafe(to.top)).groupBy("goes_to", "doc_id").agg(F.min("text").alias("text"))
    both = dealt.select("run", F.lit(False).alias("closes"), "doc_id", "text").unionByName(heads.select(F.col("goes_to").alias("run"), F.lit(True).alias("closes"), "doc_id", "text"))
    # runs are numbered from 0, so that each is a task of its own
    return both.repartitionById(ranges, F.col("run")).sortWithinPartitions("run", "closes", F.desc_nulls_last("doc_id"), "text")


OP1_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"


def _edited(batches):
    """Each row but those that close a run, with its fingerprint and that of its edited text."""
    held: tuple | None = None  # the last row seen: run, closes, doc_id, text, sketch
    for batch in shared.cut(batches):
        run, closes, ids = (batch.column(i).to_pylist() for i in range(3))
        texts = shared.texts_of(batch)
        rows = list(zip(run, closes, ids, texts.to_pylist(), sketches(texts), strict=True))
        rows, held = ([held] if held else []) + rows, rows[-1] if rows else held
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for (_, _, _, t, _), (_, _, _, u, _) in pairs]
        marks = sketches(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([encode(*a[4]) for a, _ in pairs], pa.string()),
                pa.array([encode(*m) for m in marks], pa.string()),
                pa.array([likeness(a[4], m) for (a, _), m in zip(pairs, marks, strict=True)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                pa.array([containment(a[4], m) for (a, _), m in zip(pairs, marks, strict=True)], pa.float64()),
            ],
            [f.split()[0] for f in OP1_SCHEMA.split(", ")],
        )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successor(shared.documents(spark, sf_dir)).mapInArrow(shared.tidied(_edited), OP1_SCHEMA)

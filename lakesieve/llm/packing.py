"""op10: packing documents into sequences of a fixed number of tokens, planned on lengths alone.

Only how many pieces there are of each length matters for packing, and there are at most `capacity` lengths. So the
executors count lengths, the driver plans on those counts (its work and memory are bounded by the capacity, not by
the number of documents), and the executors place each piece by its rank among those of its length.

The plan: pieces above a third of the capacity are large, and a sequence holds two of them at most; from the longest
down, each is paired with the longest large piece that still fits. Smaller pieces, longest first, go to the
sequence with the smallest gap that holds them (best fit); a new sequence is opened only if no gap does. Steps treat all
sequences of one gap and all pieces of one length together.

A document longer than the capacity is cut into whole sequences, of which the first may be shorter. Null and empty texts
are documents of one token, the end. Each input row is a document of its own, equal or not. Sequence numbers have no
meaning beyond naming sequences. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .pieces import TOGETHER_BYTES, default_vocabulary, library_pieces

CAPACITY, END = 1024, 2


@dataclass(frozen=True)
class Run:
    """Pieces of one length with ranks first_rank .. + n - 1 go to sequences first_bin .. + n - 1, all at one offset."""

    length: int
    first_rank: int
    n: int
    first_bin: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs that place counts[length] pieces of each length."""
    left, used = dict(counts), defaultdict(int)
    runs: list[Run] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> groups of sequences (first, how many)

    def place(length: int, n: int, first_bin: int, offset: int) -> None:
        runs.append(Run(length, used[length], n, first_bin, offset))
        used[length] += n
        left[length] -= n

    def opened(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps[gap].append((first, n))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for x in large:
        while left[x]:
            mate = next((y for y in large if y <= capacity - x and y <= x and left[y] >= (2 if y == x else 1)), None)
            n = left[x] if mate is None else left[x] // 2 if mate == x else min(left[x], left[mate])
            place(x, n, bins, 0)
            if mate is not None:
                place(mate, n, bins, x)
            opened(capacity - x - (mate or 0), bins, n)
            bins += n
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            fit = min((g for g in gaps if g >= x), default=None)
            if fit is None:
                first, n, fit = bins, -(-left[x] // (capacity // x)), capacity
                bins += n
            else:
                first, n = gaps[fit].pop()
                if not gaps[fit]:
                    del gaps[fit]
            each = fit // x  # after one is placed, the gap left is the smallest that holds the next, as long as it does
            whole = min(n, left[x] // each)
            for j in range(each if whole else 0):
                place(x, whole, first, capacity - fit + j * x)
            opened(fit - each * x, first, whole)
            rest = left[x] if whole < n else 0
            for j in range(rest):
                place(x, 1, first + whole, capacity - fit + j * x)
            if rest:
                opened(fit - rest * x, first + whole, 1)
            opened(fit, first + whole + bool(rest), n - whole - bool(rest))
    return runs


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> one row for each piece, numbered by length within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, part, seen = library_pieces(path), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END], "<u4").tobytes()
        for batch in shared.cut(batches, limit=TOGETHER_BYTES):
            rows = []
            for doc, short in zip(batch.column(0).to_pylist(), pieces.ids_of(shared.texts_of(batch).to_pylist()), strict=True):
                ids = np.frombuffer(short, "<u2").astype("<u4").tobytes() + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shared.tidied(run), PIECES)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with (length, part, local) -> the same with sequence_id and offset in place of part and local.

    pieces must be a stored table, so that its numbering holds in each of the passes made here.
    """
    # one row for each partition and length; the window runs over partitions, not over pieces
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "part", before.alias("before"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    by_length: dict[int, list[Run]] = defaultdict(list)
    for r in plan(total, capacity):
        by_length[r.length].append(r)
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*((r.first_rank, r.first_bin, r.offset) for r in v), strict=True)) for k, v in by_length.items()}
    fields = [f for f in pieces.schema.fields if f.name not in ("part", "local")]

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, edges):
            first_rank, first_bin, at = tables[int(length[rows[0]])]
            i = np.searchsorted(first_rank, rank[rows], "right") - 1
            sequence[rows], offset[rows] = first_bin[i] + rank[rows] - first_rank[i], at[i]
        kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
        return pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*(f.name for f in fields), "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("local") + F.col("before")).drop("part", "local", "before").select(*(f.name for f in fields), "rank")
    return shared.map_arrow(ranked, put, StructType([*fields]).add("sequence_id", LongType()).add("offset", LongType()))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = shared.stored(token_pieces(docs, path or default_vocabulary(), capacity), "pieces")
    return placed(pieces, capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.documents(spark, sf_dir))

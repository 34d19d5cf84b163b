"""op9: token files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids and scaled to 2**20, is shared by every block. A block holds the ids of
whole documents and can be decoded alone: LANES interleaved coders with 64-bit states give 32-bit words; before every
CHECKPOINT_ROWS-th row the states and the place in the words are kept, so that a reader can start there, and all parts
of a block are decoded side by side. Each block carries the CRC-32 of its ids; a mismatch raises an error.

A token file is a folder with two Parquet tables, written by Spark's own committer (tasks and executors may be lost at any time), and can
be read from its path alone. `blocks`: shard and block number, the shard's ids before the block, the documents' ids and token
counts, the coded body, and a CRC-32 over all of these. `header`, written last: the frequency table and, for each shard, how many
blocks and ids it has, each row with its CRC-32. A reader raises an error if the header is not there, a block is missing or
occurs twice, or a checksum does not hold. Shards ascend in doc_id, null first, equal ids by their tokens. A null or empty text is one id,
the end. Each row is a document of its own, repeated ones too. A document larger than a block makes a block of its own. An empty table gives
a header alone and no rows. Other columns are not written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .pieces import TOGETHER_BYTES, default_vocabulary, library_pieces

END, SYMBOLS = 2, 1 << 16
SCALE = 20
LANES, CHECKPOINT_ROWS, BLOCK_IDS = 1024, 128, 1 << 19
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of sum 2**scale in proportion to the counts, one at least for each symbol that occurs."""
    total = 1 << scale
    n = int(counts.sum())
    if not n:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * total // n), 0).astype(np.int64)
    short = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if short > 0:
        freq[order[0]] += short
    i = 0
    while short < 0:  # taken from the most frequent, a share each
        take = min(-short, int(freq[order[i]]) // 2)
        freq[order[i]] -= take
        short += take
        i += 1
    return freq


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
        self.usual = int(np.argmax(freq))

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_ROWS) -> tuple[int, bytes, bytes, bytes]:
        """(lanes, words, states at each checkpoint, word positions there); the last row is filled with the most usual id."""
        lanes = max(1, min(lanes, len(ids) // 16))
        rows = -(-len(ids) // lanes)
        s = np.full(rows * lanes, self.usual, np.int64)
        s[: len(ids)] = ids
        s = s.reshape(rows, lanes)
        x = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []
        states, left, n = [], [], 0
        shift, bits = np.uint64(63 - SCALE), np.uint64(SCALE)
        for t in range(rows - 1, -1, -1):
            f = self.freq[s[t]]
            full = x >= f << shift
            if full.any():
                words.append(x[full].astype(np.uint32))  # the low 32 bits
                n += len(words[-1])
                x = np.where(full, x >> _WORD, x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.first[s[t]]
            if t % every == 0:
                states.append(x)
                left.append(n)
        at = n - np.array(left[::-1], np.int64)
        return lanes, np.concatenate([*words[::-1], np.zeros(0, np.uint32)]).astype("<u4").tobytes(), np.array(states[::-1], "<u8").tobytes(), at.astype("<i8").tobytes()

    def decode(self, n: int, lanes: int, words: bytes, states: bytes, at: bytes, every: int = CHECKPOINT_ROWS) -> np.ndarray:
        """The n ids of a block; all its checkpoints are followed at once."""
        w = np.frombuffer(words, "<u4")
        x = np.frombuffer(states, "<u8").reshape(-1, lanes).copy()
        place = np.frombuffer(at, "<i8").copy()
        rows, parts = -(-n // lanes), len(place)
        out = np.zeros((parts, every, lanes), np.uint16)
        mask, bits = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for j in range(min(every, rows)):
            live = parts if (parts - 1) * every + j < rows else parts - 1
            y = x[:live]
            slot = y & mask
            s = self.symbol[slot]
            out[:live, j] = s
            y = self.freq[s] * (y >> bits) + slot - self.first[s]
            low = y < _LOW
            if low.any():
                k = place[:live, None] + np.cumsum(low, axis=1) - 1
                y[low] = (y[low] << _WORD) | w[k[low]]
                place[:live] += low.sum(axis=1)
            x[:live] = y
        return out.reshape(-1, lanes)[:rows].ravel()[:n] if parts else np.zeros(0, np.uint16)


def _ids_of(path: str):
    end = np.array([END], "<u2").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = library_pieces(path)
        ids = [x + end for x in pieces.ids_of(shared.texts_of(batch).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=SYMBOLS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["symbol", "n"])


BLOCKS = "shard int, block int, before long, n_ids long, crc32 long, doc_ids array<long>, n_tokens array<long>, lanes int, words binary, states binary, positions binary, meta_crc32 long"
HEADER = "shard int, n_blocks long, n_ids long, freq binary, crc32 long"


def _seal(*values) -> int:
    """CRC-32 over numbers, lists of numbers and bytes, in order."""
    crc = 0
    for v in values:
        crc = zlib.crc32(v if isinstance(v, bytes) else repr(v).encode(), crc)
    return crc


def write_token_files(docs: DataFrame, to: str, vocabulary: str | None = None, shards: int | None = None) -> str:
    """(doc_id, text) -> a token file in the folder `to`, which must be new and shared by all executors; returns `to`."""
    vocabulary = vocabulary or default_vocabulary()
    tokens = shared.stored(shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _ids_of(vocabulary), "doc_id long, ids binary", limit=TOGETHER_BYTES), "tokens")
    counts = np.zeros(SYMBOLS, np.int64)
    for r in tokens.select("ids").mapInArrow(_count, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # SYMBOLS rows at most
        counts[r["symbol"]] = r["n"]
    freq = scaled(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard, block = Coder(freq), TaskContext.get().partitionId(), 0
        docs, parts, n, before = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            raw = b"".join(parts)
            lanes, words, states, positions = coder.encode(np.frombuffer(raw, "<u2"))
            row = [shard, block, before, n, zlib.crc32(raw), docs, [len(p) // 2 for p in parts], lanes, words, states, positions]
            row.append(_seal(*row))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                parts.append(ids)
                n += len(ids) // 2
                if n >= BLOCK_IDS:
                    yield closed()
                    docs, parts, n, block, before = [], [], 0, block + 1, before + n
        if parts:
            yield closed()

    ordered = tokens.repartitionByRange(shards, "doc_id") if shards else tokens.repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "ids").mapInArrow(shared.tidied(run), BLOCKS).write.parquet(f"{to}/blocks")
    spark = docs.sparkSession
    sizes = spark.read.schema(BLOCKS).parquet(f"{to}/blocks").groupBy("shard").agg(F.count("*"), F.sum("n_ids")).orderBy("shard").collect()
    table = freq.astype("<u4").tobytes()
    rows = [(-1, 0, 0, table), *((*r, b"") for r in sizes)]
    spark.createDataFrame([(*r, _seal(*r)) for r in rows], HEADER).coalesce(1).write.parquet(f"{to}/header")
    return to


def read_token_files(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """A token file -> doc_id, start, n_tokens, ids_crc32 (and the ids, if raw) of each document, by decoding."""
    header = [tuple(r) for r in spark.read.schema(HEADER).parquet(f"{path}/header").orderBy("shard").collect()]  # a row for each shard
    if not header or header[0][0] != -1 or any(_seal(*r[:4]) != r[4] for r in header):
        raise ValueError("the header is damaged")
    freq = np.frombuffer(header[0][3], "<u4").astype(np.int64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    there = blocks.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("block").alias("d"), F.max("block").alias("last"), F.sum("n_ids").alias("ids")).collect()
    if {r["shard"]: (r["n"], r["ids"]) for r in there} != {r[0]: r[1:3] for r in header[1:]} or any(r["n"] != r["d"] or r["last"] != r["n"] - 1 for r in there):
        raise ValueError("blocks are missing or occur twice")
    base, at = {}, 0  # one number for each shard; where a block starts in its shard is written in the block
    for shard, _, n, _, _ in header[1:]:
        base[shard] = at
        at += n

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = Coder(freq)
        out: list[list] = [[], [], [], [], []]
        for r in batch.to_pylist():
            if _seal(*list(r.values())[:-1]) != r["meta_crc32"]:
                raise ValueError(f"block {r['shard']}/{r['block']} is damaged")
            ids = coder.decode(r["n_ids"], r["lanes"], r["words"], r["states"], r["positions"])
            if zlib.crc32(ids.astype("<u2").tobytes()) != r["crc32"]:
                raise ValueError(f"block {r['shard']}/{r['block']} is damaged")
            wide, n = ids.astype("<u4"), np.array(r["n_tokens"], np.int64)
            ends = np.cumsum(n)
            first = base[r["shard"]] + r["before"]
            out[0] += r["doc_ids"]
            out[1] += (first + ends - n).tolist()
            out[2] += n.tolist()
            body = memoryview(wide.tobytes())
            out[3] += [zlib.crc32(body[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            if raw:
                out[4] += [wide[e - k : e].astype(np.int32) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        columns = [pa.array(c, pa.int64()) for c in out[:4]] + ([pa.array(out[4], pa.list_(pa.int32()))] if raw else [])
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return shared.map_arrow(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * raw, text="words")


def op9_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared.checkpoint_root(spark)}/lakesieve-tokenfile-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(shared.documents(spark, sf_dir), to))

"""op8: byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the positions of a pre-token; a leaf holds the merge rank of the symbol there with the
next live symbol, an inner node the smallest rank below it, and the left child wins ties. The root so names the
leftmost pair of lowest rank. A merge joins two symbols, which changes two pair ranks and clears one: three point
updates of logarithmic cost, until no pair in the tree can be merged. Long pre-tokens cost O(n log n).

A null text is encoded as the empty text: no ids. Ids follow the tokenizer file: byte-level pre-tokens, its
merges by rank, its added tokens (such as the end-of-text string) found in the text before anything else.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared
from .pieces import TOGETHER_BYTES, Pieces, byte_letters, default_vocabulary

#: The byte-level pre-token pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 60


class SegmentTreeBPE:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocabulary[c] for c in letters]
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> rank, id of the merged symbol
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.joined.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.pre_tokens = regex.compile(PATTERN).findall
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, list[int]] = {}  # pre-tokens

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges to the symbols of one pre-token."""
        n, joined = len(symbols), self.joined
        if n < 2:
            return symbols
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        # a node holds rank * n + position, so that the smaller one is of lower rank, or else further left
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            if (m := joined.get((symbols[i], symbols[i + 1]))) is not None:
                tree[width + i] = m[0] * n + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        if tree[1] == _NONE:
            return symbols
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        while (top := tree[1]) != _NONE:
            i = top % n
            j = following[i]
            symbols[i] = joined[symbols[i], symbols[j]][1]
            symbols[j] = -1
            k = following[i] = following[j]
            if j < n - 1:
                update(j, _NONE)
            if k < n:
                preceding[k] = i
                m = joined.get((symbols[i], symbols[k]))
                update(i, _NONE if m is None else m[0] * n + i)
            else:
                update(i, _NONE)
            if (p := preceding[i]) >= 0:
                m = joined.get((symbols[p], symbols[i]))
                update(p, _NONE if m is None else m[0] * n + p)
        return [s for s in symbols if s >= 0]

    def encode_plain(self, text: str) -> list[int]:
        ids: list[int] = []
        for t in self.pre_tokens(text):
            got = self.known.get(t)
            if got is None:
                got = self.merge([self.byte_id[b] for b in t.encode("utf-8", "replace")])
                if len(self.known) < 200_000 and len(t) < 64:
                    self.known[t] = got
            ids += got
        return ids

    def encode(self, text: str) -> list[int]:
        if self.split_added is None:
            return self.encode_plain(text)
        ids: list[int] = []
        for i, part in enumerate(self.split_added.split(text)):
            ids += [self.added[part]] if i % 2 else self.encode_plain(part) if part else []
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, tuple[SegmentTreeBPE, Pieces, list[str]]] = {}


def encoder(path: str) -> tuple[SegmentTreeBPE, Pieces, list[str]]:
    """The encoder, its remembered pieces, and each id in decimal; one for each Python worker and file."""
    if path not in _encoders:
        bpe = SegmentTreeBPE(path)
        _encoders[path] = bpe, Pieces(lambda s: np.array(bpe.encode(s), "<u2").tobytes()), [str(i) for i in range(len(bpe.bytes_of))]
    return _encoders[path]


def encode_texts(df: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each row's text as array<int>; no shuffle. A column of the name out is replaced."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    path, df = path or default_vocabulary(), df.drop(out)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, pieces, _ = encoder(path)
        ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in pieces.ids_of(shared.texts_of(batch, text).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out])

    return shared.map_arrow(df, add, StructType([*df.schema.fields]).add(out, ArrayType(IntegerType())))


OP8_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_vocabulary()

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, pieces, decimal = encoder(path)
        counts, written, decoded = [], [], []
        for x in pieces.ids_of(shared.texts_of(batch).to_pylist()):
            ids = np.frombuffer(x, "<u2").tolist()
            counts.append(len(ids))
            written.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(written), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return shared.map_arrow(shared.documents(spark, sf_dir).select("doc_id", "text"), digest, OP8_SCHEMA, limit=TOGETHER_BYTES)

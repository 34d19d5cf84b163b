"""op7: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words (runs of letters, digits and non-ASCII bytes, A-Z as a-z) and their first 4 to 7 bytes are hashed to BUCKETS buckets; a
bucket that enough training texts hold has an embedding of its own, all others share one. A word's embedding is the sum of
its five, so that inflected and compound words share what their stems mean. Filters over WIDTHS neighbouring words are followed by
max pooling over the whole text and a logistic unit. Adam minimizes the log loss on a bounded sample of the labelled rows
(SAMPLE_ROWS, smallest hashes of the id, and SAMPLE_WORDS words); the epoch that does best on a tenth of it, set aside, is kept. That tenth
also gives each language's threshold, the one of best F1, held between 0.1 and 0.7. The score sees the text alone, never language, source,
id or labels.

Null and empty texts, and texts without words, get the score of an empty pooling (all features at zero). Texts of any length are
scored whole. Rows with a null id or label are not learned from; several labels of one id count as their maximum. With
labels of one class only, the score is that class's share. Equal texts get equal scores. Repeated rows are scored each; an empty
table gives no rows; a column named like the score is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bytewords import IS_MARK, Words

BUCKETS, DIMENSIONS, FILTERS, WIDTHS, PREFIXES = 1 << 22, 8, 12, (1, 2, 3), (4, 5, 6, 7)
#: Of the sample, no text of more than LONGEST words is learned from, and no more texts once it has SAMPLE_WORDS words, 20 bytes each.
SAMPLE_WORDS, LONGEST = 6_000_000, 100_000
SAMPLE_ROWS, EPOCHS, STEPS, BATCH, RATE, MIN_TEXTS = 4_000, 10, 400, 64, 0.01, 3


def buckets(texts: pa.Array) -> list[np.ndarray]:
    """One row of hash buckets (the word, its prefixes) for each of a text's words, in order."""
    out: list[np.ndarray] = []
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)).tolist() if len(texts) else []
    for a, b in shared.slices(sizes):
        words = Words(texts.slice(a, b - a), blank=IS_MARK)
        every = np.stack([words.hash, *map(words.prefixes, PREFIXES)], 1)
        out += np.split((every % np.uint64(BUCKETS)).astype(np.int32), np.cumsum(words.count)[:-1])
    return out


@dataclass
class ConvNet:
    """Rows of `embedding`: 0 pads, 1 is any bucket without one of its own. `place` maps a bucket to its row."""

    kept: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    place: np.ndarray | None = None

    def rows(self, words: np.ndarray) -> np.ndarray:
        if self.place is None:
            self.place = np.ones(BUCKETS, np.int32)
            self.place[self.kept] = np.arange(len(self.kept)) + 2
        return self.place[words]

    def pooled(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of each text, the position in the joined text where each was largest, and the joined rows."""
        pad, n_f = np.zeros((max(WIDTHS) - 1, 1 + len(PREFIXES)), np.int32), len(WIDTHS) * FILTERS
        joined = np.concatenate([x for d in docs for x in (d, pad)])
        lengths = np.array([len(d) for d in docs])
        heads = np.cumsum(lengths + len(pad)) - lengths - len(pad)
        x = self.embedding[joined[:, 0]]
        for j in range(1, joined.shape[1]):
            x += self.embedding[joined[:, j]]
        features, where = np.zeros((len(docs), n_f), np.float32), np.full((len(docs), n_f), -1)
        full = np.flatnonzero(lengths)
        for k, (w, b, width) in enumerate(zip(self.filters, self.bias, WIDTHS, strict=True)):
            z = np.zeros((len(joined), FILTERS), np.float32) + b
            for j in range(width):
                z[: len(joined) - j] += x[j:] @ w[j]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for i in full:
                part = z[heads[i] : heads[i] + lengths[i]]
                at = part.argmax(0)
                best = part[at, np.arange(FILTERS)]
                features[i, cols] = np.maximum(best, 0)
                where[i, cols] = np.where(best > 0, heads[i] + at, -1)
        return features, where, joined

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """docs: rows of the embedding for each text."""
        if not docs:
            return np.zeros(0)
        features, _, _ = self.pooled(docs)
        return 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ self.out + self.out_bias, -30, 30)))


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1, midway between the scores around it."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(len(y)) + 1 + y.sum())
    i = int(np.argmax(f1))
    return float((p[order[i]] + (p[order[i + 1]] if i + 1 < len(y) else 0.0)) / 2)


def train(words: list[np.ndarray], toxic: np.ndarray, lang: list[str], seed: int = 11) -> ConvNet:
    """Fit on texts given as buckets; every tenth text is set aside to choose the epoch and the thresholds."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(words)) % 10 == 9
    y = toxic.astype(np.float64)
    held = [np.unique(w) for w, a in zip(words, aside, strict=True) if not a]
    seen, n = np.unique(np.concatenate([*held, np.zeros(0, np.int32)]), return_counts=True)  # texts, not occurrences
    kept = seen[n >= MIN_TEXTS]
    net = ConvNet(
        kept,
        rng.normal(0, 0.1, (len(kept) + 2, DIMENSIONS)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS),
        0.0,
    )
    net.embedding[:2] = 0
    share = float(y.mean()) if len(y) else 0.0
    net.out_bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not 0 < y.sum() < len(y):
        net.out = np.zeros_like(net.out)
        return net
    docs = [net.rows(w) for w in words]
    words.clear()
    own = np.flatnonzero(~aside)
    state: dict[str, list[np.ndarray]] = {}
    t = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad * grad
        value[at] -= RATE * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.999**t)) + 1e-8) + RATE * 0.01 * value[at]

    best, since = (np.inf, None), 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(own))))  # small samples are gone over more often
    test = np.flatnonzero(aside) if aside.any() else own
    bias = np.array([net.out_bias])
    for _ in range(epochs):
        order = rng.permutation(own)
        for a in range(0, len(order), BATCH):
            t += 1
            chosen = order[a : a + BATCH]
            # some buckets are hidden, so that no single one is learned by heart
            batch = [np.where(rng.random(docs[i].shape) < 0.1, 1, docs[i]).astype(np.int32) for i in chosen]
            features, where, joined = net.pooled(batch)
            p = 1 / (1 + np.exp(-np.clip(features @ net.out + bias[0], -30, 30)))
            d = (p - y[chosen]) / len(chosen)
            up = np.outer(d, net.out) * (where >= 0)
            rows_at, grads_at = [], []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                i, f = np.nonzero(where[:, cols] >= 0)
                g, at = up[:, cols][i, f], where[:, cols][i, f]
                gw = np.zeros_like(net.filters[k])
                for j in range(width):
                    r = joined[at + j]
                    np.add.at(gw[j].T, f, g[:, None] * net.embedding[r].sum(1))
                    rows_at.append(r.ravel())
                    grads_at.append(np.repeat(g[:, None] * net.filters[k][j].T[f], r.shape[1], 0))
                gb = np.bincount(f, g, FILTERS)
                adam(f"w{k}", net.filters[k], gw.astype(np.float32))
                adam(f"b{k}", net.bias[k], gb.astype(np.float32))
            adam("out", net.out, features.T @ d)
            adam("bias", bias, np.array([d.sum()]))
            r, inverse = np.unique(np.concatenate(rows_at), return_inverse=True)
            ge = np.zeros((len(r), DIMENSIONS), np.float32)
            np.add.at(ge, inverse, np.concatenate(grads_at).astype(np.float32))
            adam("embedding", net.embedding, ge, r)
            net.embedding[0] = 0
        net.out_bias = float(bias[0])
        loss = log_loss(net.score([docs[i] for i in test]), y[test])
        since += 1
        if loss < best[0]:
            since, best = 0, (loss, (net.embedding.copy(), [w.copy() for w in net.filters], [b.copy() for b in net.bias], net.out.copy(), net.out_bias))
        if since > epochs // 3:
            break
    net.embedding, net.filters, net.bias, net.out, net.out_bias = best[1]
    p = net.score([docs[i] for i in test])
    names = np.array([lang[i] or "" for i in test])
    for name in ["", *sorted({*names} - {""})]:  # "" is for languages of which too few texts were set aside
        own_rows = np.ones(len(test), bool) if not name else names == name
        if y[test][own_rows].sum() >= 5:
            net.thresholds[name] = min(0.7, max(0.1, best_threshold(p[own_rows], y[test][own_rows])))
    net.thresholds.setdefault("", 0.3)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ConvNet:
    """Learn from at most sample_rows labelled rows outside the held-out quarter (crc32 of the id modulo 4 is 2)."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where("id is not null and toxic is not null").where(shared.crc_of_id("id") % 4 != 2)
    rows = rows.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample_rows)
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in rows.collect()], "id long, toxic int").coalesce(1)  # sample_rows at most
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    chosen = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "toxic", "lang", "text")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [w.tobytes() if len(w) <= LONGEST else None for w in buckets(shared.texts_of(batch))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary())], ["doc_id", "toxic", "lang", "words"])

    found = shared.stored(shared.map_arrow(chosen, hashed, "doc_id long, toxic int, lang string, words binary").where("words is not null"), "sample")
    got, total = [], 0
    for r in found.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "words").toLocalIterator():
        total += len(r["words"]) // (4 * (1 + len(PREFIXES)))
        if total > SAMPLE_WORDS:
            break
        got.append(tuple(r))
    got.sort()
    got = [got[i] for i in np.random.default_rng(5).permutation(len(got))]
    words, marks, langs = [np.frombuffer(r[3], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in got], np.array([r[1] > 0 for r in got], bool), [r[2] for r in got]
    del got
    net = train(words, marks, langs)
    shared.trim()
    return net


def scored(docs: DataFrame, net: ConvNet, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each row's text; no shuffle. A column of the name out is replaced."""
    from pyspark.sql.types import DoubleType, StructType

    docs, net.place = docs.drop(out), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.cut(batches, text):
            rows = [net.rows(w) for w in buckets(shared.texts_of(batch, text))]
            scores = [net.score(rows[a:b]) for a, b in shared.slices([r.nbytes for r in rows])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, out])

    return docs.mapInArrow(shared.tidied(run), StructType([*docs.schema.fields]).add(out, DoubleType()))


def toxic(net: ConvNet, lang: str | None = "lang", score: str = "score"):
    """The verdict on a scored row: its language's threshold, else the common one."""
    limit = F.lit(net.thresholds.get("", 0.3))
    for name, t in net.thresholds.items():
        if lang and name:
            limit = F.when(F.col(lang) == name, F.lit(t)).otherwise(limit)
    return F.col(score) >= limit


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (shared.crc_of_id() % 4 == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

"""op3: MinHash near-duplicates with tensored banding, every link verified on the full shingle sets.

Instead of independent minhashes for each table, a text gets a small collection of BUNDLES bundles of three minhashes
each; a table's key combines two bundles, so that 54 minhashes serve 153 tables of six minhashes each, where independent
tables would take 918. Bundles that one class has alone can't meet in any table: they are told first, and make no keys. Two sets of Jaccard similarity s share a key if two bundles or more agree: at s = 0.8 this fails
for 5e-5 of the pairs, at 0.85 for 1e-6, at 0.9 for 1e-9.

Equal sets are collapsed to one class first. Within each key all classes are compared to a head (a star, not all pairs): the
class that shares most keys with others, which in a group of edited copies is the one nearest to their origin. That leaves
open the classes that share a key and still lie in different components. Those are compared among each other through a
prefix and positional filter, which loses no link: under any one order of shingles, two sets of n and m shingles that share t or more
have their first common shingle at places i and j with 1 + min(n - i, m - j) >= t. The order puts shingles that are rare in
the corpus first, so passages that many documents share bring no pairs. Candidates whose minhashes agree in fewer than
LEAST_AGREE of 54 places are left out (at s = 0.8 that drops 1e-7 of the pairs); all others are confirmed on the whole
sets. No count of partners, bucket size or text length is capped.

Rows: a null or empty text, or one without words, has an empty set and is linked with nothing. A text with fewer words
than a shingle has one shingle, all its words. Rows with equal doc_id count as one document. A null doc_id is linked with
nothing: its component is null and it is kept. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bytewords import Words, mix, split_by_text
from .components import components, joined

BUNDLES, HASHES = 18, 3
#: Of BUNDLES * HASHES minhashes, so many must agree before two texts are compared.
LEAST_AGREE = 27
#: The most counters of shingle frequency, which only set an order; their number follows the documents that are compared by prefixes.
MOST_COUNTERS = 1 << 20
#: Ids that are broadcast at most, 24 bytes each; more are met by shuffling.
BROADCAST_ROWS = 1 << 18
#: Pairs of one text that one group of a comparison is expected to hold at most.
PAIRS_A_GROUP = 1 << 8
_RANDOM = np.random.default_rng(97)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
SIGNED = "doc_id long, n_shingles long, digest binary, minhash array<int>"


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)).tolist() if len(texts) else []
    for a, b in shared.slices(sizes):
        out += map(np.unique, split_by_text(*Words(texts.slice(a, b - a)).shingles(k), b - a))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BUNDLES * HASHES 32-bit minhashes for each set, zeros for an empty one."""
    n = BUNDLES * HASHES
    out = np.zeros((len(sets), n), np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        lengths = np.array([len(sets[i]) for i in full])
        flat, heads = np.concatenate([sets[i] for i in full]), np.cumsum(lengths) - lengths
        for j in range(n):
            low = np.minimum.reduceat(flat * _MULTIPLY[j] + _ADD[j], heads)
            out[full, j] = (mix(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Of (doc_id, text): set size, a 128-bit digest of the set, and minhashes; digest is null for an empty set."""
    import xxhash

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(shared.texts_of(batch), k)
        marks = minhashes(sets)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * marks.shape[1]), pa.array(marks.ravel(), pa.int32())),
            ],
            ["doc_id", "n_shingles", "digest", "minhash"],
        )

    return shared.map_arrow(docs, sign, SIGNED)


def table_keys(classes: DataFrame) -> DataFrame:
    """(doc_id, minhash) -> (doc_id, key) for the tables in which a class can meet another: pairs of bundles that other classes have too.

    A key is met only by classes that agree in both of its bundles, so that a bundle of one class alone makes no keys. Of the
    BUNDLES * (BUNDLES - 1) / 2 tables most classes are in none.
    """
    bundle = ", ".join(f"xxhash64({i}, {', '.join(f'minhash[{i * HASHES + j}]' for j in range(HASHES))})" for i in range(BUNDLES))
    bundles = classes.select("doc_id", F.posexplode(F.expr(f"array({bundle})")).alias("i", "b"))
    common = shared.stored(bundles.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b"), "bundles")
    held = bundles.join(common, "b", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "b"))).alias("h")).where("size(h) > 1")
    pairs = "flatten(transform(sequence(1, size(h) - 1), p -> transform(slice(h, p + 1, size(h)), y -> xxhash64(h[p - 1].b, y.b))))"
    return held.select("doc_id", F.explode(F.expr(pairs)).alias("key")).distinct()


def plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b) pairs whose minhashes agree often enough."""
    marks = marks.select("doc_id", "minhash")
    agree = f"aggregate(zip_with(x, y, (p, q) -> int(p = q)), 0, (s, v) -> s + v) >= {LEAST_AGREE}"
    first = shared.stored(pairs.join(marks.select(F.col("doc_id").alias("b"), F.col("minhash").alias("y")), "b"), "marked")
    return first.join(marks.select(F.col("doc_id").alias("a"), F.col("minhash").alias("x")), "a").where(F.expr(agree)).select("a", "b")


def of_ids(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows joined with docs by doc_id. Up to BROADCAST_ROWS rows are sent to the documents; more are met by shuffling both."""
    rows = shared.stored(rows, "wanted")
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "doc_id")


def measured(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(a, b) -> (a, b, both, union): sizes of the intersection and the union of the full sets.

    The text of a comes once to each group of b's: those of one a are dealt by hash over so many groups that none is expected to hold
    more than PAIRS_A_GROUP, whatever share of all pairs a has. An id that has several texts is compared by each.
    """
    pairs = shared.stored(pairs, "pairs")
    salt = F.pmod(F.xxhash64("b"), F.lit(pairs.count() // PAIRS_A_GROUP + 1)).alias("salt")
    members = pairs.select(F.col("b").alias("doc_id"), "a", salt, F.lit(1).alias("kind"))
    heads = pairs.select(F.col("a").alias("doc_id"), "a", salt, F.lit(0).alias("kind")).distinct()
    texts = of_ids(docs.select("doc_id", "text"), members.unionByName(heads)).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def compare(batches):
        at, heads = None, []
        for batch in shared.cut(batches):
            ids, a, salts, kinds = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "a", "salt", "kind"))
            out: list[tuple[int, int, int, int]] = []
            for x, i, s, kind, own in zip(a, ids, salts, kinds, shingle_sets(shared.texts_of(batch), k), strict=True):
                if (x, s) != at:
                    at, heads = (x, s), []
                if not kind:
                    heads.append(own)
                    continue
                for head in heads:
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    out.append((x, i, both, len(head) + len(own) - both))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "both", "union"])

    return texts.mapInArrow(shared.tidied(compare), "a long, b long, both long, union long")


def outward(pairs: DataFrame) -> DataFrame:
    """(a, b) pairs turned so that a is in more of them than b, or in as many."""
    pairs = shared.stored(pairs, "pairs")
    degree = shared.stored(pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count("*").alias("n")), "degree")
    of = lambda c: degree.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"))
    more = F.col("n_a") >= F.col("n_b")
    both = shared.stored(pairs.join(of("a"), "a"), "pairs").join(of("b"), "b")
    return both.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("b"))


def shingle_counts(docs: DataFrame, k: int, counters: int) -> np.ndarray:
    """How often shingles occur, by hash modulo counters: sums of each task's counters."""

    def count(batches):
        total = np.zeros(counters, np.int64)
        for batch in shared.cut(batches):
            texts = shared.texts_of(batch)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)).tolist() if len(texts) else []
            for a, b in shared.slices(sizes):
                total += np.bincount((Words(texts.slice(a, b - a)).shingles(k)[0] % np.uint64(counters)).astype(np.int64), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    out = np.zeros(counters, np.int64)
    found = docs.select("text").mapInArrow(shared.tidied(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def prefix_pairs(docs: DataFrame, rest: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of different components in rest (doc_id, component) whose prefixes share a shingle at places that allow a link.

    Only texts of rest are read, twice: the first time for how often shingles occur in them, at most MOST_COUNTERS numbers."""
    rest = shared.stored(rest, "open")
    n = rest.count()
    small = n <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(rest) if small else rest, "doc_id")
    texts = texts if small else shared.stored(texts, "opentexts")
    counters = 1 << min(MOST_COUNTERS.bit_length() - 1, max(12, (n * 64).bit_length()))
    counts = shingle_counts(texts, k, counters).astype(np.float32)

    def prefix(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(shared.texts_of(batch), k)
        heads = [s[np.lexsort((s, counts[(s % np.uint64(counters)).astype(np.int64)]))[: len(s) - -(-percent * len(s) // 100) + 1]].view(np.int64) for s in sets]
        at = np.cumsum([0, *map(len, heads)]).astype(np.int32)
        flat = np.concatenate([*heads, np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "component", "n", "prefix"])

    heads = shared.map_arrow(texts.select("doc_id", "text", "component"), prefix, "doc_id long, component long, n long, prefix array<long>")
    rows = shared.stored(heads.select("doc_id", "component", "n", F.posexplode("prefix").alias("i", "shingle")), "prefixes")
    by_component = rows.groupBy("shingle", "component").agg(F.count("*").alias("m"))
    mixed = shared.stored(by_component.groupBy("shingle").agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.count("*").alias("c")).where("c > 1").select("shingle", "largest"), "mixed")
    some = shared.stored(rows.join(mixed, "shingle"), "prefixes")
    # rows of a shingle's largest component are met by those of its others only, never by each other
    few = some.where("component != largest").select("shingle", F.col("doc_id").alias("x"), F.col("component").alias("of_x"), F.col("n").alias("nx"), F.col("i").alias("ix"))
    many = some.select("shingle", F.col("doc_id").alias("y"), F.col("component").alias("of_y"), F.col("n").alias("ny"), F.col("i").alias("iy"))
    # both >= percent/100 * union is (100 + percent) * both >= percent * (nx + ny); places count from 0 here
    fits = (F.col("of_x") != F.col("of_y")) & ((100 + percent) * F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= percent * (F.col("nx") + F.col("ny")))
    return few.join(many, "shingle").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, class_id, component_id, kept for each row.

    class_id is the smallest doc_id with an equal set, component_id the smallest that links of at least `percent`
    similarity reach, kept whether the row's doc_id is that.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = shared.stored(signatures(docs, shingle_words), "signed")
    sized = rows.where("digest is not null and doc_id is not null")
    classes = shared.stored(sized.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("minhash").alias("minhash")), "classes")
    marks = shared.stored(classes.groupBy("doc_id").agg(F.min("minhash").alias("minhash")), "marks")

    keys = shared.stored(table_keys(classes), "keys")
    sizes = shared.stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    tables = shared.stored(keys.join(sizes, "key"), "tables")
    central = shared.stored(tables.groupBy("doc_id").agg(F.sum("n").alias("degree")), "degrees")
    heads = shared.stored(tables.join(central, "doc_id").groupBy("key").agg((-F.max(F.struct("degree", (-F.col("doc_id")).alias("id")))["id"]).alias("head")), "heads")
    star = tables.join(heads, "key").where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    linked = f"100 * both >= {percent} * union"
    edges = measured(plausible(star, marks), docs, shingle_words).where(linked).select("a", "b")
    labels = components(edges)
    placed = shared.stored(tables.select("key", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    mixed = shared.stored(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low != high and n > 2").select("key"), "mixed")
    found = labels
    if not mixed.isEmpty():
        open_rows = placed.join(mixed, "key", "left_semi").select("doc_id", "component").distinct()
        open_pairs = shared.stored(prefix_pairs(docs, open_rows, shingle_words, percent), "open")
        found = joined(labels, measured(outward(plausible(open_pairs, marks)), docs, shingle_words).where(linked).select("a", "b"))

    named = shared.stored(classes.select("digest", F.col("doc_id").alias("class_id")).join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("digest", "class_id", F.coalesce("component", "class_id").alias("component")), "named")
    own = rows.select("doc_id", "n_shingles", "digest")
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()  # many texts can be empty: they take no part in the join
    out = own.where(~alone).join(named, "digest").select("doc_id", "n_shingles", "class_id", F.col("component").alias("component_id"))
    out = out.unionByName(own.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of one document of each component; of rows equal in id and text one stays.

    Ids that go, and ids of several rows, are what meets the documents, by broadcast up to BROADCAST_ROWS of them; texts are shuffled
    only beyond that. A row without an id stays; of several equal ones, one.
    """
    ids = shared.stored(near_duplicates(docs, shingle_words, percent).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "leaving")
    go = ids.where("not kept").select("doc_id")
    left = docs.join(F.broadcast(go) if go.count() <= BROADCAST_ROWS else go, "doc_id", "left_anti")
    again = shared.stored(ids.where("kept").select(F.col("doc_id").alias("_again")), "repeated")
    n = again.count()
    if not n:
        return left
    again, same = F.broadcast(again) if n <= BROADCAST_ROWS else again, F.col("doc_id").eqNullSafe(F.col("_again"))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.documents(spark, sf_dir), shingle_words=2).drop("class_id")

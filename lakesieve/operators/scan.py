"""Leak scan: which stored texts hold a secret item exactly, nearly or in traces.

The scan is an inverted-index join. Both sides are cut into k-word windows, for all k of a manifest in one pass; windows meet on a
64-bit hash, and only those that meet get the SHA-256 that reports show. Containment is checked on the pairs that share a window,
which loses none: a text that holds an item of n words holds its n - 2 inner words whole, and an item too short to have a window
among them is met by those inner words instead. Only hashes and short ids of items are sent to the texts, and texts are read once
more for the few that have met an item; neither they nor the items' texts are shuffled with the windows.

A store row is told apart by id and text: rows of one id and different texts are scanned each by itself, equal rows count once. Equal
manifest rows give a finding each. A null `retired` counts as active, a null store id as an id. No output holds text: findings carry
ids, counts and hashes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.functions import text as T

MIN_OVERLAP, NEAR_PERCENT, MAX_BYTES = 2, 5.0, 8 * 1024 * 1024
#: Items of a manifest that are broadcast at most; larger manifests are joined by shuffling.
BROADCAST_WINDOWS = 1_000_000


def add_instances(files: DataFrame, unicode_fold: bool = True, k: int = T.SHINGLE_WORDS) -> DataFrame:
    """(instance, seed, position, text) files -> manifest rows; an instance's text is its files in order, joined by line feeds."""
    blob = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n")
    return manifest(files.groupBy("instance", "seed").agg(blob.alias("text")), unicode_fold, k)


def manifest(items: DataFrame, unicode_fold: bool = True, k: int = T.SHINGLE_WORDS) -> DataFrame:
    """(instance, seed, text[, retired]) -> manifest rows with the normalised text, its SHA-256 and distinct shingles."""
    retired = F.coalesce(F.col("retired"), F.lit(False)) if "retired" in items.columns else F.lit(False)
    a = items.select("instance", "seed", retired.alias("retired"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("full_sha256"), T.normalized("text", unicode_fold).alias("normalized"))
    b = a.withColumn("w", T.words("normalized"))
    return b.withColumn("shingles", F.sort_array(F.array_distinct(F.transform(T.windows("w", k), lambda x: T.sha(x))))).withColumn("shingle_words", F.lit(k)).drop("w")


def retire(rows: DataFrame, instance: str) -> DataFrame:
    """Every active row of the instance becomes retired."""
    return rows.withColumn("retired", F.coalesce(F.col("retired"), F.lit(False)) | (F.col("instance") == instance))


def listed(rows: DataFrame) -> DataFrame:
    """Metadata of manifest rows only."""
    return rows.select("instance", "seed", "retired", F.size("shingles").alias("n_shingles"))


def gated(store: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(store_file, text or content, n_bytes) with skip_reason: too-large, binary (a NUL in the first 1024 bytes), or null."""
    content = "content" if "content" in store.columns else "encode(coalesce(text, ''), 'utf-8')"
    binary = F.expr(f"position(X'00', substring({content}, 1, 1024)) > 0")
    return store.withColumn("skip_reason", F.when(F.col("n_bytes") > max_bytes, "too-large").when(binary, "binary"))


def skipped(store: DataFrame) -> DataFrame:
    """Gated rows that were not scanned, counted by reason."""
    return store.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def severity_order(severity: Column) -> Column:
    return F.when(severity == "exact", 2).when(severity == "near", 1).otherwise(0)


def active(items: DataFrame) -> DataFrame:
    """Manifest rows that are scanned for; what is not marked as retired is."""
    return items.where(~F.coalesce(F.col("retired"), F.lit(False)))


def _cut(rows: DataFrame, key: list[str], sizes: str = "sizes") -> DataFrame:
    """One row for each window of each of the sizes: key, size, place, a 64-bit hash, and the window."""
    cut = rows.select(*key, T.words("normalized").alias("w"), F.explode(sizes).alias("size"))
    return cut.select(*key, "size", F.posexplode(T.windows("w", F.col("size"))).alias("pos", "window")).withColumn("x", F.xxhash64("size", "window"))


def findings(store: DataFrame, items: DataFrame, min_overlap: int = MIN_OVERLAP, unicode_fold: bool = True) -> DataFrame:
    """(store_file, text) against manifest rows -> one row for each store row and item that match.

    Two jobs run at once: one over the manifest, which tells whether its hashes may be broadcast, and one that finds the pairs that share a
    window, which tells whether their ids may.
    """
    if min_overlap < 1:
        raise ValueError("min_overlap must be 1 or more")
    key = ["instance", "seed", "full_sha256", "shingle_words"]
    own = active(items).withColumn("n_words", F.size(T.words("normalized")))
    own = own.groupBy(*key).agg(F.count("*").alias("copies"), F.max("normalized").alias("normalized"), F.max("n_words").alias("n_words"), F.max(F.array_min("shingles")).alias("least"), F.max(F.greatest(F.size("shingles"), F.lit(1))).alias("total"))
    own = own.withColumn("iid", F.xxhash64(*key)).withColumn("k", F.col("shingle_words"))
    size = own.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    sent = (lambda d: F.broadcast(d)) if size <= BROADCAST_WINDOWS else (lambda d: d)

    whole = _cut(own.withColumn("sizes", F.array("k")), ["iid", "k"]).select("iid", "x", "size", F.lit(True).alias("whole"))
    brief = own.where((F.col("n_words") >= F.col("k")) & (F.col("n_words") < F.col("k") + 2) & (F.col("n_words") > 2))
    inner = brief.select("iid", (F.col("n_words") - 2).alias("size"), F.array_join(F.slice(T.words("normalized"), 2, F.col("n_words") - 2), " ").alias("window"))
    index = whole.unionByName(inner.select("iid", F.xxhash64("size", "window").alias("x"), "size", F.lit(False).alias("whole"))).distinct()
    sizes = index.agg(F.sort_array(F.collect_set("size")).alias("sizes"))  # one row

    texts = store.select("store_file", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), T.normalized("text", unicode_fold).alias("normalized"))
    meet = _cut(texts.join(F.broadcast(sizes)), ["store_file", "row"]).join(sent(index.drop("size")), "x")
    h = F.when(F.col("whole"), T.sha("window"))
    hits = meet.groupBy("store_file", "row", "iid").agg(F.count_distinct(h).alias("matched"), F.min(F.when(F.col("whole"), F.col("pos"))).alias("first_pos"), F.min(h).alias("evidence")).persist()
    few = hits.count() <= BROADCAST_WINDOWS
    found = hits.withColumnRenamed("store_file", "s").withColumnRenamed("row", "r")
    same = F.col("store_file").eqNullSafe(F.col("s")) & (F.col("row") == F.col("r"))
    pairs = texts.join(F.broadcast(found) if few else found, same).drop("s", "r")
    # items of one or two words have no inner window; they are tried on every text
    tiny = own.where((F.col("n_words") >= F.col("k")) & (F.col("n_words") < 3) & (F.col("n_words") > 0)).select("iid", F.col("normalized").alias("word"))
    alone = texts.join(sent(tiny), F.expr("contains(normalized, word)")).join(F.broadcast(hits.select(F.col("store_file").alias("s"), F.col("row").alias("r"), F.col("iid").alias("i"))) if few else hits.select(F.col("store_file").alias("s"), F.col("row").alias("r"), F.col("iid").alias("i")), same & (F.col("iid") == F.col("i")), "left_anti")
    alone = alone.select("store_file", "row", "normalized", "iid", F.lit(0).cast("long").alias("matched"), F.lit(None).cast("int").alias("first_pos"), F.lit(None).cast("string").alias("evidence"))

    texted = own.select("iid", *key, "copies", F.col("normalized").alias("item_text"), "n_words", "least", "total")
    out = pairs.unionByName(alone).join(sent(texted), "iid").withColumn("exact", F.expr("contains(normalized, item_text)") & (F.col("n_words") >= F.col("shingle_words")))
    out = out.withColumn("at", F.when(F.col("exact"), F.expr("instr(normalized, item_text)"))).drop("normalized", "item_text")
    out = out.where(F.col("exact") | (F.col("matched") >= min_overlap)).dropDuplicates(["store_file", "row", "iid"])
    matched = F.when(F.col("exact"), F.col("total")).otherwise(F.col("matched")).cast("int")
    share = 100.0 * matched / F.col("total")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "store_file",
        "instance",
        "seed",
        F.when(F.col("exact"), "exact").when(share >= NEAR_PERCENT, "near").otherwise("trace").alias("severity"),
        matched.alias("matched_shingles"),
        F.col("total").cast("int").alias("total_shingles"),
        F.bround(share, 2).alias("overlap_pct"),
        F.when(F.col("exact"), F.col("at") - 1).otherwise(F.col("first_pos")).cast("int").alias("first_word_pos"),
        F.when(F.col("exact"), F.col("least")).otherwise(F.col("evidence")).alias("evidence_shingle"),
        T.content_ref("full_sha256").alias("content_ref"),
    )


def ranked(found: DataFrame) -> DataFrame:
    """Findings by severity, overlap, then store and item."""
    return found.orderBy(F.desc(severity_order(F.col("severity"))), F.desc("overlap_pct"), "store_file", "instance")


def overlapping_items(items: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of different items that share `least` shingles or more. A shingle of one item alone is left before pairs are made."""
    h = items.select("instance", F.explode("shingles").alias("h")).distinct()
    shared = h.join(h.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "h", "left_semi")
    a, b = shared.withColumnRenamed("instance", "a"), shared.withColumnRenamed("instance", "b")
    return a.join(b, "h").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)


def numbered(rows: DataFrame, by: list[str], name: str = "manifest_pos") -> DataFrame:
    """Rows numbered in an order; for manifests, which are small."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*by)) - 1)

"""Append-only logs: latest states, hash chains, divergence, counters. `seq` is the order of a log, never its clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def latest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last record of each key: one aggregate with partial sums, no window."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def slot_states(log: DataFrame) -> DataFrame:
    """slot -> state: created, prepared, or the status of the last closing record."""
    created = latest(log.where("kind = 'trial-created'").select("slot", "seq", "task", "arm"), "slot").drop("seq")
    after = latest(log.where("kind != 'trial-created'").select("slot", "seq", "kind", "status"), "slot").drop("seq")
    state = F.when(F.col("kind").isNull(), "created").when(F.col("kind") == "closed", F.col("status")).otherwise(F.col("kind"))
    return created.join(after, "slot", "left").select("slot", "task", "arm", state.alias("state"))


def status(states: DataFrame, reveal: bool = False) -> DataFrame:
    """States of slots; arms only on request."""
    return states.select("slot", "task", (F.col("arm") if reveal else F.lit("***")).alias("arm"), "state")


def valid_slot(slot: Column) -> Column:
    return slot.rlike("^t-.{8}$")


def chain_breaks(log: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """(seq, line, prev) rows whose prev is not the SHA-256 of the line before with its line feed; parts: columns of separate logs."""
    before = F.lag(F.sha2(F.concat("line", F.lit("\n")), 256), 1, GENESIS).over(Window.partitionBy(*(parts or [])).orderBy("seq"))
    return log.withColumn("expected", before).where("prev is null or prev != expected")


def chained(log: DataFrame, payload: Column, parts: list[str] | None = None) -> DataFrame:
    """(seq, ...) -> the same with line, and prev as the hash of the line before; payload is a record without its prev."""
    w = Window.partitionBy(*(parts or [])).orderBy("seq")
    lined = log.withColumn("line", payload)
    return lined.withColumn("prev", F.lag(F.sha2(F.concat("line", F.lit("\n")), 256), 1, GENESIS).over(w))


def next_counter(used: DataFrame, family: str = "family", n: str = "n") -> DataFrame:
    """The smallest number from 0 on that each family has not used: where the sorted distinct numbers first leave their rank."""
    ranked = used.select(family, n).where(F.col(n) >= 0).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(family).orderBy(n)) - 1)
    kept = ranked.groupBy(family).agg(F.coalesce(F.min(F.when(F.col(n) != F.col("rank"), F.col("rank"))), F.max("rank") + 1).alias("next_n"))
    return used.select(family).distinct().join(kept, family, "left").withColumn("next_n", F.coalesce("next_n", F.lit(0)))


def divergence(manifest: DataFrame, ledger: DataFrame, family: str) -> DataFrame:
    """Where a family's manifest rows (instance, seed, retired) and ledger entries (kind, instance) disagree: (instance, problem)."""
    own = manifest.where(F.col("seed").startswith(family + ":"))
    made = ledger.where("kind = 'generated'").select("instance").distinct()
    ended = ledger.where("kind = 'retired'").select("instance").distinct()
    a = made.join(own.select("instance"), "instance", "left_anti").withColumn("problem", F.lit("in ledger, not in manifest"))
    b = own.where("retired").select("instance").join(ended, "instance", "left_anti").withColumn("problem", F.lit("retired in manifest, not in ledger"))
    c = ended.join(own.where("retired").select("instance"), "instance", "left_anti").withColumn("problem", F.lit("retired in ledger, not in manifest"))
    return a.unionByName(b).unionByName(c).distinct()


def kind_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count("*").alias("n"))

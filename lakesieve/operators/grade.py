"""Grading: paired signs between two arms, a bootstrap interval, and the verdict."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.functions import draws, twister
from lakesieve.functions.text import stripped

TASK_DRAWS = 1 << 28  # of a bootstrap, made by one task: some seconds


# The rule of decision and its resampling.
@dataclass(frozen=True)
class GradeConfig:
    margin: float = 0.10
    bootstrap_b: int = 10_000
    seed: int = 20260918
    require_every_task: bool = False
    max_excluded_pct: float = 25.0
    alpha: float = 0.05


def verified(content: Column, equals: Column, pattern: Column) -> Column:
    """1.0 if a file has the expected content: equality of stripped texts if that is given, else an unanchored match; 0.0 else."""
    same = F.when(equals.isNotNull(), stripped(content) == stripped(equals)).when(pattern.isNotNull(), content.rlike(pattern) if isinstance(pattern, str) else F.regexp_like(content, pattern))
    return F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0)


def scored(closed: DataFrame, created: DataFrame, judge: DataFrame | None = None) -> DataFrame:
    """Closed records (seq, slot, status, score) -> seq, slot, task, arm, score, reason; a reason quarantines the record."""
    rows = closed.join(created.select("slot", "task", "arm"), "slot", "left")
    if judge is not None:
        rows = rows.drop("score").join(judge, "slot", "left")
    reason = F.when(F.col("status") == "sealed-drift", "environment drift").when(F.col("score").isNull(), "no score")
    return rows.select("seq", "slot", "task", "arm", "score", reason.alias("reason"))


def pairs(rows: DataFrame, primary: str, baseline: str) -> DataFrame:
    """Each primary trial against each baseline trial of its task: task, a_seq, b_seq, sign."""
    a = rows.where(F.col("arm") == primary).select("task", F.col("seq").alias("a_seq"), F.col("score").alias("a"))
    b = rows.where(F.col("arm") == baseline).select("task", F.col("seq").alias("b_seq"), F.col("score").alias("b"))
    return a.join(b, "task").select("task", "a_seq", "b_seq", F.signum(F.col("a") - F.col("b")).cast("int").alias("sign"))


def per_task(signs: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Pairs and mean sign (4 places) by task; tasks without pairs have none."""
    got = signs.groupBy("task").agg(F.count("*").alias("n_pairs"), F.bround(F.avg("sign"), 4).alias("mean_sign"))
    return got if tasks is None else tasks.select("task").distinct().join(got, "task", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def ranks(b: int, alpha: float) -> tuple[int, int]:
    """Places, from 0, of the two bounds among b sorted means."""
    return int(b * alpha / 2), min(b - 1, int(b * (1 - alpha / 2)))


def in_fours(signs: np.ndarray) -> np.ndarray:
    """Signs, raised to 0, 1 and 2, four to a byte: a table that processors' caches hold longer."""
    raised = np.zeros(-(-len(signs) // 4) * 4, np.uint8)
    raised[: len(signs)] = signs + 1
    return raised[0::4] | raised[1::4] << 2 | raised[2::4] << 4 | raised[3::4] << 6


def resampled(fours: np.ndarray, n: int, first: int, last: int, seed: int) -> np.ndarray:
    """Sums of the replicates first to last - 1 of n signs, drawn as the standard library's choices does: place floor(random() * n)."""
    draw = twister.generator(twister.ahead(twister.seeded(seed), twister.steps(2 * n * first)))  # a number takes two words
    some = min(n, 1 << 15)
    number, place, at, drawn, low = (np.empty(some, t) for t in (np.float64, np.int32 if n < 1 << 31 else np.int64, np.int64, np.uint8, np.uint8))
    sums = np.full(last - first, -n, np.int64)
    for r in range(last - first):
        for done in range(0, n, some):
            if n - done < some:  # the last numbers of a replicate
                number, place, at, drawn, low = (x[: n - done] for x in (number, place, at, drawn, low))
            draw.random(out=number)
            np.multiply(number, n, out=number)
            np.copyto(place, number, casting="unsafe")
            np.take(fours, np.right_shift(place, 2, out=at), out=drawn, mode="wrap")
            np.copyto(low, place, casting="unsafe")
            drawn >>= (low & 3) << 1
            drawn &= 3
            sums[r] += int(drawn.sum())
        number, place, at, drawn, low = (x if x.base is None else x.base for x in (number, place, at, drawn, low))
    return sums


def percentiles(sums: np.ndarray, n: int, alpha: float) -> tuple[float, float]:
    low, high = (int(np.sort(sums)[i]) for i in ranks(len(sums), alpha))
    return low / n, high / n


def bootstrap_ci(signs: list[int], b: int, seed: int, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of the mean by resampling with the standard library's generator."""
    return percentiles(resampled(in_fours(np.asarray(signs, np.int8)), len(signs), 0, b, seed), len(signs), alpha) if signs else (0.0, 0.0)


def in_order(signs: DataFrame) -> np.ndarray:
    """All signs in the order task, a_seq, b_seq (nulls last; equal places by sign), a byte each."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()  # an error for null signs: rows without a score are quarantined before
            yield pa.RecordBatch.from_arrays([pa.array([own.astype(np.int8).tobytes()], pa.binary())], ["signs"])

    own = signs.orderBy(*(F.asc_nulls_last(c) for c in ("task", "a_seq", "b_seq")), "sign").select("sign")
    return np.frombuffer(b"".join(r["signs"] for r in own.mapInArrow(packed, "signs binary").collect()), np.int8)


def _in_java(places: DataFrame, signs: np.ndarray, b: int, tasks: int, seed: int) -> np.ndarray:
    """Sums of b replicates, drawn by the executors' JVMs; Python finds where in the generator's sequence each task begins."""
    spark, n = places.sparkSession, len(signs)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                first, last = b * i // tasks, b * (i + 1) // tasks
                state = twister.ahead(twister.seeded(seed), twister.steps(2 * n * first))  # a number takes two words
                yield pa.RecordBatch.from_arrays([pa.array([state.astype("<u4").tobytes()], pa.binary()), pa.array([last - first], pa.int32())], ["state", "replicates"])

    shared = draws.broadcast(spark, in_fours(signs))
    drawn = draws.summed(places.mapInArrow(begin, "state binary, replicates int"), shared, n)
    sums = np.frombuffer(b"".join(r["sums"] for r in drawn.collect()), "<i8")
    shared.destroy()
    return sums


def _in_python(places: DataFrame, signs: np.ndarray, b: int, tasks: int, seed: int) -> np.ndarray:
    """The same for more signs than Java's arrays have places."""
    n, shared = len(signs), places.sparkSession.sparkContext.broadcast(in_fours(signs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                sums = resampled(shared.value, n, b * i // tasks, b * (i + 1) // tasks, seed)
                yield pa.RecordBatch.from_arrays([pa.array(sums)], ["total"])

    sums = places.mapInArrow(run, "total long").toArrow()["total"].to_numpy()
    shared.destroy()
    return sums


def interval(signs: DataFrame, config: GradeConfig) -> DataFrame:
    """One row (lo, hi, n), none without pairs: the standard generator over pairs in the order task, a_seq, b_seq. Runs its jobs when called.

    Tasks draw replicates from the places in the generator's sequence where these begin; each executor holds all signs, as any draw can be any of them.
    """
    spark, own = signs.sparkSession, in_order(signs)
    n, b = len(own), config.bootstrap_b
    schema = "lo double, hi double, n long"
    if not n:
        return spark.createDataFrame([], schema)
    tasks = min(b, -(-n * b // TASK_DRAWS))
    places = spark.range(0, tasks, 1, tasks)
    if n > draws.MOST:
        sums = _in_python(places, own, b, tasks, config.seed)
    else:
        sums = _in_java(places, own, b, tasks, config.seed)
    return spark.createDataFrame([(*percentiles(sums, n, config.alpha), n)], schema)


def hash_draws(b: int, n: int, seed: int) -> Iterator[np.ndarray]:
    """n numbers for each replicate, some replicates (rows) at a time: number i of replicate r is the 32 bits at i mod 8 of sha256(seed:r:i div 8)."""
    eights = -(-n // 8)
    some = max(1, (1 << 20) // eights)
    for first in range(0, b, some):
        raw = b"".join(hashlib.sha256(b"%d:%d:%d" % (seed, r, i)).digest() for r in range(first, min(b, first + some)) for i in range(eights))
        yield np.frombuffer(raw, ">u4").reshape(-1, 8 * eights)[:, :n]


def hash_interval(signs: DataFrame, group: list[str], b: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """The interval of each group by resampling with hashes, which any engine can repeat; groups are resampled side by side.

    Draw i of replicate r is the sign at place v mod n, v being the number that hash_draws has for it.

    Signs of a group are held as counts of -1, 0 and 1, one row a group, so that a draw is a comparison and no pair is joined back.
    """
    low, high = ranks(b, alpha)

    def resample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = list(zip(pdf["n"], pdf["neg"], pdf["zero"], strict=True))
            means: list[list[np.ndarray]] = [[] for _ in own]
            for v in hash_draws(b, max((n for n, _, _ in own), default=1), seed):  # the same numbers serve all groups
                for (n, neg, zero), m in zip(own, means, strict=True):
                    place = v[:, :n] % np.uint32(n)
                    m.append(((place >= neg + zero).sum(1) - (place < neg).sum(1).astype(np.int64)) / n)
            bounds = [np.sort(np.concatenate(m))[[low, high]] for m in means]
            yield pdf[group].assign(lo=[x for x, _ in bounds], hi=[x for _, x in bounds])

    g = signs.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("sign") < 0).alias("neg"), F.count_if(F.col("sign") == 0).alias("zero"))
    spread = g.repartition(*group)  # else adaptive execution puts these few rows, each long to work on, into one task
    return spread.mapInPandas(resample, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in signs.schema.fields if f.name in group), "lo double", "hi double"]))


def decision(n: Column, excluded_pct: Column, lo: Column, hi: Column, short: Column, config: GradeConfig) -> Column:
    """keep, revert or provisional; short: number of tasks without a positive mean."""
    kept = F.when(F.lit(config.require_every_task) & (short > 0), "provisional").otherwise("keep")
    return F.when(n == 0, "provisional").when(excluded_pct > config.max_excluded_pct, "provisional").when(lo > config.margin, kept).when(hi < -config.margin, "revert").otherwise("provisional")


def verdict(records: DataFrame, primary: str, baseline: str, tasks: DataFrame, config: GradeConfig = GradeConfig(), ci: DataFrame | None = None) -> DataFrame:
    """One row: decision, pairs_graded, net_winrate, lo, hi, excluded_pct, n_short from scored records."""
    good = records.where("reason is null")
    signs = pairs(good, primary, baseline)
    shares = records.agg((100.0 * F.count_if(F.col("reason").isNotNull()) / F.greatest(F.lit(1), F.count("*"))).alias("excluded_pct"))
    net = signs.agg(F.count("*").alias("pairs_graded"), F.coalesce(F.avg("sign"), F.lit(0.0)).alias("net"))
    short = per_task(signs, tasks).agg(F.count_if(F.coalesce(F.col("mean_sign"), F.lit(0.0)) <= 0).alias("n_short"))
    bounds = (ci if ci is not None else interval(signs, config).select("lo", "hi")).agg(F.coalesce(F.max("lo"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("hi"), F.lit(0.0)).alias("hi"))
    one = net.crossJoin(shares).crossJoin(short).crossJoin(bounds)  # one row each
    return one.select(
        decision(F.col("pairs_graded"), F.col("excluded_pct"), F.col("lo"), F.col("hi"), F.col("n_short"), config).alias("decision"),
        F.lit(primary).alias("primary"),
        F.lit(baseline).alias("baseline"),
        "pairs_graded",
        F.bround("net", 4).alias("net_winrate"),
        F.bround("lo", 4).alias("lo"),
        F.bround("hi", 4).alias("hi"),
        F.bround("excluded_pct", 1).alias("excluded_pct"),
        "n_short",
    )


def exit_code(decided: Column, integrity_ok: Column) -> Column:
    return F.when(~integrity_ok, 3).when(decided == "keep", 0).when(decided == "revert", 1).otherwise(2)


def public_face(excluded: DataFrame) -> DataFrame:
    """Excluded records with their reason replaced by a hash."""
    return excluded.withColumn("reason", F.substring(F.sha2("reason", 256), 1, 12))


def trial_matrix(tasks: DataFrame, arms: DataFrame, repeats: int, seed: int) -> DataFrame:
    """tasks x arms x repeats in an order set by a keyed hash: position from 1, task, arm, repeat.

    Rows are sorted within the 4,096 groups of a key's first three digits, and placed after the rows of all groups before.
    """
    every = tasks.select("task").crossJoin(F.broadcast(arms.select("arm"))).select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    keyed = every.withColumn("key", F.sha2(F.concat_ws(":", F.lit(seed), "task", "arm", "repeat"), 256)).withColumn("part", F.substring("key", 1, 3))
    sizes = keyed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each group
    own = F.row_number().over(Window.partitionBy("part").orderBy("key", "task", "arm", "repeat"))
    return keyed.withColumn("own", own).join(F.broadcast(before), "part").select((F.col("before") + F.col("own")).alias("position"), "task", "arm", "repeat")


def blind(closed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Jobs under pseudonyms in hashed order, and the map back; one job for each closed record."""
    named = closed.withColumn("pseud", F.substring(F.sha2(F.concat_ws(":", F.lit(key), "slot", "seq"), 256), 1, 12))
    return named.select("pseud", "task", "status").orderBy("pseud"), named.select("pseud", "slot", "arm", "task")

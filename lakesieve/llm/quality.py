"""op4: quality rules as a learned decision list. DataFrame expressions only.

Text statistics are computed by built-in functions in one pass over each text, without a shuffle. From the
statistics of a bounded sample of labelled rows (SAMPLE_ROWS, the smallest hashes of the id) sequential covering
learns an ordered list of rules on the driver: a rule grows condition by condition (statistic, <= or >, threshold)
by information gain on two thirds of the rows, loses its last conditions as long as that does not lower its worth on
the other third, and is kept if its share of poor documents there is high; the rows that it covers leave, and the
next rule is learned from the rest. The list is emitted as one ordered CASE expression whose default keeps.

Null and empty texts have zero statistics and fail the base rule. Without labelled rows of both classes the list
is empty and keeps all. Rows with a null doc_id take part but are never in the sample. Equal rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SAMPLE_ROWS, MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 10_000, 12, 4, 24
#: Of the rows that a rule covers, this share must be poor, in growing and in pruning rows alike.
LEAST_PRECISION, LEAST_COVER = 0.9, 8
BLANK = r"[\x20\x09-\x0D]+"
STATISTICS = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mean_word", "unique_share", "exclaim_share", "line_words", "lone_symbol_share", "n_words")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df's doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares that rules may use.

    A struct column named _row, if there is one, is carried along.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = ["doc_id"] + ["_row"] * ("_row" in df.columns)
    a = df.select(*own, t.alias("t"), F.filter(F.split(t, BLANK), lambda w: w != "").alias("w"))
    # w, h and s are each used more than once below, so that they stay columns of their own and are computed once
    b = a.select(*own, "t", "w", F.size("w").alias("n"), F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("h"))
    c = b.withColumn("s", F.when(F.size(F.array_distinct("h")) == F.size("h"), F.expr("array()").cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    d = c.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])), lambda x: x["i"])))
    lines = F.filter(F.split("t", "\n"), lambda x: F.rtrim(F.translate(x, "\t\n\x0b\x0c\r", "     ")) != "")
    e = d.select(
        *own,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.coalesce(F.aggregate(F.transform("p", lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get("p", i - 1)))), F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long").alias("n_repeat_words"),
        lines.alias("lines"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "0123456789", ""))).alias("n_digits"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).alias("n_exclaim"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.size(F.filter("w", lambda w: w.isin(*"|#*<>"))).alias("n_lone"),
    )
    e = e.withColumns({"n_lines": F.size("lines"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines")
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    shares = {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "mean_word": F.col("word_chars") / words,
        "unique_share": F.col("n_distinct") / words,
        "exclaim_share": F.col("n_exclaim") / words,
        "line_words": F.col("n_words") / F.greatest("n_lines", F.lit(1)),
        "lone_symbol_share": F.col("n_lone") / words,
    }
    return e.withColumns(shares).select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *shares)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] > self.threshold if self.above else x[self.statistic] <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents that it covers get the verdict keep."""

    conditions: tuple[Condition, ...]
    keep: bool = False

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.rows(x) for c in self.conditions])

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def verdict(rules: list[Rule]) -> Column:
    """One ordered conditional: the first rule that covers a document decides; none keeps it."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(r.column(), F.lit(r.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def grow(x: dict[str, np.ndarray], poor: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[Condition, ...]:
    """Add the condition of most information gain until no good document is covered, or no condition helps."""
    inside, out = np.ones(len(poor), bool), []
    while len(out) < MAX_CONDITIONS:
        p, n = int((inside & poor).sum()), int((inside & ~poor).sum())
        if not p or not n:
            break
        had, best = np.log2(p / (p + n)), (1e-9, None)
        for name, at in cuts.items():
            v = x[name]
            # rows at or below each cut, of both classes
            low_p, low_n = (np.searchsorted(np.sort(v[inside & of]), at, "right") for of in (poor, ~poor))
            for above, ps, ns in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - had), -1)
                if len(gain) and gain[i := int(np.argmax(gain))] > best[0]:
                    best = (float(gain[i]), Condition(name, above, float(at[i])))
        if best[1] is None:
            break
        out.append(best[1])
        inside &= best[1].rows(x)
    return tuple(out)


def prune(conditions: tuple[Condition, ...], x: dict[str, np.ndarray], poor: np.ndarray) -> tuple[Condition, ...]:
    """The prefix of the conditions that is worth most, (p - n) / (p + n), on rows not grown on; ties to the shorter."""

    def worth(k: int) -> float:
        inside = Rule(conditions[:k]).rows(x)
        p, n = int((inside & poor).sum()), int((inside & ~poor).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return conditions[: max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))]


def learn(x: dict[str, np.ndarray], poor: np.ndarray, third: np.ndarray) -> list[Rule]:
    """Sequential covering: rules for poor documents in the order learned. third marks the rows to prune on."""
    rules, left = [], np.ones(len(poor), bool)
    while len(rules) < MAX_RULES:
        g, h = left & ~third, left & third
        if not (poor & g).any() or not (~poor & g).any() or not h.any():
            break
        at = {k: v[g] for k, v in x.items()}
        cuts = {k: np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, THRESHOLDS)), np.quantile(v[poor[g]], np.linspace(0, 1, THRESHOLDS))])) for k, v in at.items()}
        conditions = grow(at, poor[g], cuts)
        if not conditions:
            break
        conditions = prune(conditions, {k: v[h] for k, v in x.items()}, poor[h])
        rule = Rule(conditions)
        covered = rule.rows(x) & left
        if covered.sum() < LEAST_COVER or min((poor[covered & part].mean() if (covered & part).any() else 0.0) for part in (~third, third)) < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def learned_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, after_base: bool = True) -> list[Rule]:
    """The decision list from at most sample_rows labelled rows, the smallest hashes of their ids.

    after_base: learn only from those that pass the base rule, for use behind it.
    """
    rows = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").withColumn("order", F.xxhash64("doc_id", F.lit(7))).orderBy("order", "doc_id", "quality").limit(sample_rows)
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in rows.collect()] or [(-1, 1, 0)], "id long, quality int, order long").coalesce(1)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"), "left_semi")
    joined = statistics(chosen).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    got = [r for r in joined.select("quality", "order", base_failed().alias("failed"), *STATISTICS).collect() if not (after_base and r["failed"])]
    if not got:
        return []
    got.sort(key=lambda r: (r["order"], *(r[name] for name in STATISTICS)))
    x = {name: np.array([float(r[name]) for r in got]) for name in STATISTICS}
    return learn(x, np.array([r["quality"] == 0 for r in got]), np.arange(len(got)) % 3 == 2)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of each row of docs (doc_id, text).

    The condition on monotonically_increasing_id always holds. Being non-deterministic it keeps the optimizer from
    moving a filter on kept below the statistics, where it would put whole array expressions into each other's
    lambdas and compute them anew for each element.
    """
    kept = F.when(F.monotonically_increasing_id() >= 0, ~F.col("base_failed") & verdict(rules))
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", kept)


def kept_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs, all columns, that the decision list keeps; the base rule takes no part. The verdict is a column, for the reason given at judged."""
    rows = statistics(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")))
    return rows.withColumn("_kept", F.when(F.monotonically_increasing_id() >= 0, verdict(rules))).where("_kept").select("_row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    rules = learned_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Seals over files and environments: what is missing, modified or added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TREE_FILES = 20_000


def differences(sealed: DataFrame, current: DataFrame, key: str = "path", sha: str = "sha") -> DataFrame:
    """(path, sha) before and now -> path, problem; one full outer join."""
    a, b = sealed.select(key, F.col(sha).alias("was")), current.select(key, F.col(sha).alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def sealable(files: DataFrame, prefix: str = "task/") -> DataFrame:
    """Output files without the task's own; prefix "task" drops every name that begins so."""
    return files.where(~F.col("path").startswith(prefix))


def package_diff(start: DataFrame, end: DataFrame) -> DataFrame:
    """(name, version) at the start and at the end -> change, package; an upgrade is listed as added, removed and changed."""
    pin = F.concat_ws("==", "name", "version")
    added = end.join(start, ["name", "version"], "left_anti").select(F.lit("pkg+").alias("change"), pin.alias("package"))
    removed = start.join(end, ["name", "version"], "left_anti").select(F.lit("pkg-").alias("change"), pin.alias("package"))
    a, b = start.withColumnRenamed("version", "was"), end.withColumnRenamed("version", "now")
    changed = a.join(b, "name").where("was != now").select(F.lit("pkg~").alias("change"), F.format_string("%s: %s -> %s", "name", "was", "now").alias("package"))
    return added.unionByName(removed).unionByName(changed)


def tree_digest(files: DataFrame, by: list[str], entry: Column, n: int = 64) -> DataFrame:
    """SHA-256 (n digits) over the entries of each group in path order, by path parts; too many files give a mark instead."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.split("path", "/").alias("p"), entry.alias("e")))), lambda x: x["e"])
    digest = F.substring(F.sha2(F.array_join(ordered, "\n"), 256), 1, n)
    small = files.groupBy(*by).agg(F.count("*").alias("n_files"))
    few = files.join(small.where(F.col("n_files") <= MAX_TREE_FILES), by, "left_semi").groupBy(*by).agg(digest.alias("digest"))
    return small.join(few, by, "left").withColumn("digest", F.coalesce("digest", F.lit("too-many-files")))

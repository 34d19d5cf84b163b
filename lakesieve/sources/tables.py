"""Manifests, ledgers, families and verdicts as JSON lines or Parquet."""

from __future__ import annotations

import hashlib
import json
import os
from contextlib import contextmanager
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.operators.holdout import SLOTS
from lakesieve.operators.ledger import GENESIS

MANIFEST = "instance string, seed string, created string, retired boolean, full_sha256 string, normalized string, shingles array<string>, shingle_words int"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a malformed line is an error; retired and shingle_words have defaults."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    return rows.withColumns({"retired": F.coalesce("retired", F.lit(False)), "shingle_words": F.coalesce("shingle_words", F.lit(8))})


def append_manifest(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines with keys in order."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def rewrite_manifest(rows: DataFrame, path: str) -> None:
    """Writes a new version; a table is never overwritten while it is read."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in file order -> seq, line, and the fields of schema. A ledger is one file; its line order is its time."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("seq", "line")).where("line != ''")
    return lines.select("seq", "line", F.from_json("line", schema).alias("r")).select("seq", "line", "r.*")


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def append_record(path: str, record: dict) -> None:
    """One ledger record, on disk when this returns."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")
        f.flush()
        os.fsync(f.fileno())


def append_chained(path: str, record: dict) -> dict:
    """Validates the whole chain, then appends the record with seq and prev; the file is private to its owner."""
    lines = Path(path).read_bytes().splitlines(keepends=True) if os.path.exists(path) else []
    expected = GENESIS
    for i, line in enumerate(lines, 1):
        if json.loads(line)["prev"] != expected:
            raise ValueError(f"the chain is broken at line {i}")
        expected = hashlib.sha256(line).hexdigest()
    entry = record | {"seq": len(lines) + 1, "prev": expected}
    os.close(os.open(path, os.O_CREAT, 0o600))
    append_record(path, entry)
    return entry


@contextmanager
def operation_lock(path: str):
    """One operation at a time; a lock left behind is an error, not a wait."""
    try:
        os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600))
    except FileExistsError as e:
        raise RuntimeError(f"another operation holds {path}") from e
    try:
        yield
    finally:
        os.unlink(path)


def read_family(spark: SparkSession, path: str) -> DataFrame:
    """A family file -> family, prompt, slots."""
    spec = json.loads(Path(path).read_text())
    if spec.get("schema") != 1:
        raise ValueError("family schema must be 1")
    slots = [(n, s.get("kind"), s.get("min"), s.get("max"), s.get("count"), [json.dumps(x) for x in s["of"]] if isinstance(s.get("of"), list) else None, s.get("sep")) for n, s in spec.get("slots", {}).items()]
    return spark.createDataFrame([(spec.get("id"), spec.get("prompt"), slots)], f"family string, prompt string, slots {SLOTS}")


def packages(spark: SparkSession) -> DataFrame:
    """Installed packages of this interpreter, lower-case, distinct."""
    return spark.createDataFrame(sorted({(d.metadata["Name"].lower(), d.version) for d in metadata.distributions() if d.metadata["Name"]}), "name string, version string")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row, for verdicts, findings and audits."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

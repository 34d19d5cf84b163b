"""Which files and directories could hold leaked items, from metadata alone: names, sizes, dates. Contents are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.functions.text import human_size

# Names and suffixes that the classification goes by.
MEMORY_FILES = ["memory.md", "memories.md", "lessons.md", "learnings.md", "now.md", "agents.md", "claude.md", "journal.md", "aider.chat.history.md"]
STATE_DIRS = [".agent-state", "agent-state", ".memory", "memory", "memories", "journal", "journals", ".claude", ".codex", ".cursor", ".continue", ".gemini", ".opencode"]
TRANSCRIPT_DIRS = ["logs", "log", "transcripts", "trajectories", "sessions", ".sessions", "evals", "eval-outputs", "runs", "outputs", "results"]
TEXT_SUFFIXES = [".md", ".txt", ".jsonl", ".ndjson", ".json", ".log", ".yaml", ".yml"]
VECTOR_DIRS = [".chroma", ".chromadb", ".lancedb", ".qdrant", "faiss_indexes", ".mem0"]
VECTOR_SUFFIXES = [".faiss", ".lance"]
DATABASE_SUFFIXES = [".sqlite", ".sqlite3", ".db", ".duckdb"]
VECTOR_HINTS = ["vector", "vectors", "memory", "memories", "embedding", "embeddings", "chroma", "lancedb", "qdrant", "faiss", "mem0", "memgpt", "letta"]
STORE_SKIP = [".git", ".venv", "node_modules", "__pycache__", ".uv-cache"]
WALK_SKIP = [
    ".cache", "cache", "caches", ".npm", ".cargo", ".rustup", ".local", ".volta", ".nvm", ".rbenv", ".pyenv", ".gradle", ".m2", ".android", ".docker", ".kube", ".terraform", ".ollama",
    ".lm-studio", ".vscode", ".config", "Library", ".Trash", "snap", "target", "dist", "build", ".next", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".hypothesis", ".eggs",
]
KINDS = ["memory-file", "agent-state", "transcripts", "vector-store"]


def suffix(name: Column) -> Column:
    """The last suffix of a file name, lower-case; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def classified(entries: DataFrame) -> DataFrame:
    """(path, is_dir, size, modified[, has_text, note]) -> path, kind, size, modified of the surfaces; size is -1 for directories.

    Without has_text, a directory holds text if an entry below it does."""
    if "note" in entries.columns:
        entries = entries.where("note is null")
    e = entries.withColumns({"name": F.element_at(F.split("path", "/"), -1), "parent": F.regexp_replace("path", "/[^/]*$", "")})
    low, ext = F.lower("name"), suffix(F.col("name"))
    if "has_text" not in entries.columns:
        with_text = e.where(~F.col("is_dir") & ext.isin(TEXT_SUFFIXES)).select(F.col("parent").alias("path")).distinct().withColumn("has_text", F.lit(True))
        e = e.join(with_text, "path", "left")
    hinted = F.lit(False)
    for h in VECTOR_HINTS:
        hinted = hinted | low.contains(h)
    is_dir = F.col("is_dir")
    kind = (
        F.when(is_dir & F.col("name").isin(STORE_SKIP + WALK_SKIP), None)
        .when(~is_dir & low.isin(MEMORY_FILES), KINDS[0])
        .when(is_dir & low.isin(STATE_DIRS), KINDS[1])
        .when(is_dir & low.isin(TRANSCRIPT_DIRS) & F.col("has_text"), KINDS[2])
        .when((is_dir & low.isin(VECTOR_DIRS)) | (~is_dir & (ext.isin(VECTOR_SUFFIXES) | (ext.isin(DATABASE_SUFFIXES) & hinted))), KINDS[3])
    )
    return e.select("path", kind.alias("kind"), F.when(is_dir, -1).otherwise(F.col("size")).cast("long").alias("size"), F.coalesce(F.date_format("modified", "yyyy-MM-dd"), F.lit("?")).alias("modified")).where("kind is not null")


def ordered(surfaces: DataFrame) -> DataFrame:
    return surfaces.orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "path")


def report(surfaces: DataFrame) -> DataFrame:
    """Surfaces as lines of text."""
    return surfaces.select(F.format_string("%-13s %10s  %s  %s", "kind", human_size(F.col("size")), "modified", "path").alias("line"))


def walked(entries: DataFrame) -> DataFrame:
    """One row over a walk: entries, directories, what could not be read, unknown roots, and whether it was cut."""
    n = lambda c: F.count_if(c)
    plain = F.col("note").isNull()
    return entries.agg(n(plain).alias("entries"), n(plain & F.col("is_dir")).alias("directories"), n(F.col("note") == "unreadable").alias("unreadable"), n(F.col("note") == "unknown-root").alias("unknown_roots"), (n(F.col("note") == "truncated") > 0).alias("truncated"))


def counts(surfaces: DataFrame) -> DataFrame:
    return surfaces.groupBy("kind").agg(F.count("*").alias("n"))

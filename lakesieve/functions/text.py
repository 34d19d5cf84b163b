"""Normalising, tokenising, shingling and hashing of text as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SHINGLE_WORDS = 8


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility folding, which Spark has no function for."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalized(text: Column | str, unicode_fold: bool = True) -> Column:
    """Folded, lower-case, runs of anything but a-z and 0-9 as one space, trimmed. Without unicode_fold it stays in the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.coalesce(c, F.lit(""))
    if unicode_fold:  # ASCII texts, which folding leaves as they are, are not sent to Python
        c = F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def words(norm: Column | str) -> Column:
    """Words of a normalised text; none for the empty one."""
    c = F.col(norm) if isinstance(norm, str) else norm
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def windows(of: str, k: int | Column = SHINGLE_WORDS) -> Column:
    """Every k-word window of the words column `of`, joined by spaces; none if there are fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    w = F.col(of)
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))


def sha(c: Column | str, n: int = 16) -> Column:
    """The first n hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(F.col(c) if isinstance(c, str) else c, 256), 1, n)


def content_ref(full_sha256: Column | str) -> Column:
    """A reference to content by the hash of its hash."""
    return sha(full_sha256, 16)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def template_refs(template: Column) -> Column:
    """Names that a template refers to as {{ name }}."""
    return F.regexp_extract_all(template, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1))


def rendered(template: Column | str, values: Column | str) -> Column:
    """The template with {{ name }} replaced from a map of strings, in one pass: replaced text is not looked at again."""
    t = F.col(template) if isinstance(template, str) else template
    m = F.col(values) if isinstance(values, str) else values
    plain = F.split(t, r"\{\{\s*\w+\s*\}\}", -1)  # what stands between the references
    names = F.concat(template_refs(t), F.array(F.lit("")))
    shown = F.transform(F.arrays_zip(plain.alias("p"), names.alias("n")), lambda x: F.concat(x["p"], F.coalesce(m[x["n"]], F.lit(""))))
    return F.array_join(shown, "")


def human_size(n: Column) -> Column:
    """1024-based size; - for directories, whose size is -1."""
    return F.when(n < 0, "-").when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.1f GB", n / 1024**3))

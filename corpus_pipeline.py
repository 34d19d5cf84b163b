"""A corpus pipeline: toxic and poor documents go, near-duplicates leave one, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs; all but the
last return the columns of documents, clashing or further ones too. Null and empty texts, null and repeated ids and empty tables pass through
every stage as its operator defines; a document without an id has no near duplicates, and of rows equal in id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesieve.llm import neardup, packing, quality, secrets, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at their language's threshold or above go."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.scored(docs, net, out="_toxicity")
    return scored.where(~toxicity.toxic(net, "lang" if "lang" in docs.columns else None, "_toxicity")).drop("_toxicity")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list rejects go; short documents are judged by the list like any other."""
    rules = quality.learned_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), after_base=False)
    return quality.kept_documents(docs, rules)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity of 0.8 or more over five-word shingles, the one of the smallest id stays."""
    return neardup.without_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text, encoded ones too, are replaced by a mask."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces placed in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("neardup", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]

#: No stage can be written in SQL; tests/llm holds the operators that the stages call against brute force, and the stages on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.stored(docs, name)
    return docs

"""op5: perspective rotation of multi-party dialogues. DataFrame expressions only.

Every participant of a conversation (each distinct role but "system") in turn becomes the assistant: their turns are written as
the assistant's, all others' as a user's with the speaker's name, system turns as they are. The mask covers what the model
is to learn, the speaker's own words and the end mark after them, as a span in the rendered dialogue; it is null on other turns.

One row for each conversation, speaker and turn, in the order of position; a dialogue is the concatenation of its rows, so no
dialogue is gathered into one task. Offsets are prefix sums in two levels, within blocks of BLOCK turns and over the blocks, so
that one very long conversation spreads over tasks.

Turns order by turn, then role, then text; equal rows are turns of their own. A null role speaks as "unknown", a null text is empty, a
null turn comes last, rows with a null conv_id form one conversation. A conversation of system turns only gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 64


def rotated(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, speaker, position, turn, rendered, starts_at, ends_at, mask_from, mask_to."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = rows.where("role != 'system'").select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    both = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("role") == F.col("speaker")
    head = F.when(own, "<|assistant|>\n").when(F.col("role") == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user|>\n"), "role", F.lit(": ")))
    both = both.withColumns({"own": own, "head": head, "block": F.floor(F.col("turn") / BLOCK)}).withColumn("rendered", F.concat("head", "text", F.lit("<|end|>\n")))
    within = Window.partitionBy("conv_id", "speaker", "block").orderBy(F.asc_nulls_last("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    dialogue = Window.partitionBy("conv_id", "speaker").orderBy(F.asc_nulls_last("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("conv_id", "speaker", "block").agg(F.sum(F.length("rendered")).alias("chars"), F.count("*").alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("chars").over(dialogue), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("n").over(dialogue), F.lit(0)).alias("n_before"))
    both = both.withColumns({"chars_in": F.coalesce(F.sum(F.length("rendered")).over(within), F.lit(0)), "n_in": F.coalesce(F.count(F.lit(1)).over(within), F.lit(0))})
    both = both.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & F.col("block").eqNullSafe(F.col("b")))
    start = F.col("chars_before") + F.col("chars_in")
    body = start + F.length("head")
    return both.select(
        "conv_id",
        "speaker",
        (F.col("n_before") + F.col("n_in")).alias("position"),
        "turn",
        "rendered",
        start.alias("starts_at"),
        (start + F.length("rendered")).alias("ends_at"),
        F.when(F.col("own"), body).alias("mask_from"),
        F.when(F.col("own"), body + F.length("text") + len("<|end|>")).alias("mask_to"),
    )


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
b AS (
  SELECT r.*, s.speaker, r.role = s.speaker AS own,
         CASE WHEN r.role = s.speaker THEN '<|assistant|>' || chr(10) WHEN r.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user|>' || chr(10) || r.role || ': ' END AS head
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
x AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM b),
y AS (
  SELECT *, coalesce(sum(length(rendered)) OVER w, 0)::BIGINT AS starts_at, (count(*) OVER w)::BIGINT AS position FROM x
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, speaker, position, turn, rendered, starts_at, starts_at + length(rendered) AS ends_at,
       CASE WHEN own THEN starts_at + length(head) END AS mask_from,
       CASE WHEN own THEN starts_at + length(head) + length(text) + 7 END AS mask_to
FROM y
"""

"""Chat formatting of logged conversations, without the snapshots that longer ones contain.

A log that is written after each exchange holds every prefix of a conversation. Rolling hashes over
the turns name each prefix; conversations whose whole hash names a proper prefix of another go, as do
later copies; what stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthframe.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, role, text, pos, n, h1, h2).

    pos counts the turns of a conversation of n turns from 1; (pos, h1, h2) names its first pos turns by
    two 64-bit rolling hashes.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = said.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    own = said.withColumn("a", F.xxhash64("pos", "role", "text")).withColumn("b", F.xxhash64("text", F.lit(1), "role", "pos"))
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("conv_id", "role", "text", "pos", "n", F.bit_xor("a").over(so_far).alias("h1"), F.bit_xor("b").over(so_far).alias("h2"))


def maximal(found: DataFrame) -> DataFrame:
    """The conv_ids of prefixes() that no other conversation contains as its beginning; of copies the smallest."""
    name = ["pos", "h1", "h2"]
    whole = found.where("pos = n").groupBy(*name).agg(F.min(F.struct(F.col("conv_id").isNull().alias("no"), "conv_id")).alias("id"))
    inner = found.where("pos < n").select(*name).distinct()
    return whole.join(inner, name, "left_anti").select("id.conv_id")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, n_turns, text), one row for each maximal conversation.

    Turns are ordered by turn, then role, then text, nulls first; a null role or text counts as empty;
    rows with a null conv_id form one conversation; a repeated row is a repeated turn; an empty table
    gives an empty one. Other columns are ignored.
    """
    found = prefixes(turns)
    keep = maximal(found).withColumnRenamed("conv_id", "kept")
    said = found.join(keep, F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    parts = F.sort_array(F.collect_list(F.struct("pos", rendered(F.col("role"), F.col("text")).alias("said"))))
    out = said.groupBy("conv_id").agg(F.count("*").alias("n_turns"), parts.alias("parts"))
    return out.select("conv_id", "n_turns", F.array_join(F.col("parts.said"), "").alias("text"))


def op10(spark, sf_dir: str) -> DataFrame:
    return chats(table(spark, sf_dir, "conversations"))


OP10_SQL = f"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
grown AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY pos)
           OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS so_far
  FROM said),
whole AS (SELECT so_far, min(conv_id) AS conv_id FROM grown WHERE pos = n GROUP BY so_far),
kept AS (SELECT conv_id FROM whole WHERE so_far NOT IN (SELECT so_far FROM grown WHERE pos < n))
SELECT conv_id, count(*) AS n_turns,
       string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' ORDER BY pos) AS text
FROM said WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""

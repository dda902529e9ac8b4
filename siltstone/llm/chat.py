"""Chat formatting: one rendering of each dialogue per participant, with that speaker as assistant.

Every turn of a conversation is rendered once per perspective: the perspective's own turns get the
role `assistant` and are trained on (mask 1), other speakers become users named after themselves,
and system turns stay system turns; both have mask 0. The result is a row per (conversation,
perspective, turn), so that a conversation of any length is never gathered in one task: a third of
all rows may be one conversation, whose turns Spark splits as a skewed join.

Nulls and odd rows: a null or blank role is the speaker `unknown`; a null text is empty; null
conversation ids form one conversation; a null turn sorts first; repeated rows are rendered each.
A conversation of system turns alone has no perspective and no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """Render `turns` (conv_id, turn, role, text) from the perspective of every participant."""
    speaker = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("body"))
    seats = base.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("seat_conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user"))
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(BEGIN), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))
    rendered = F.concat(head, F.col("body"), F.lit(END + "\n"))
    return (
        base.join(seats, base["conv_id"].eqNullSafe(seats["seat_conv"]))
        .select(
            "conv_id", "perspective", "turn", role.alias("role"), name.alias("name"), rendered.alias("rendered"),
            own.cast("int").alias("mask"),
            F.when(own, F.length(head)).otherwise(F.lit(0)).alias("mask_start"),
            F.when(own, F.length(rendered) - 1).otherwise(F.lit(0)).alias("mask_end"),
        )
    )


ROTATE_SQL = """
WITH base AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
told AS (
  SELECT b.*, s.perspective, b.speaker = s.perspective AS own,
    CASE WHEN b.speaker = s.perspective THEN 'assistant' WHEN b.speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM base b JOIN seats s ON b.conv_id IS NOT DISTINCT FROM s.conv_id),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM told)
SELECT conv_id, perspective, turn, role, name, head || body || '<|im_end|>' || chr(10) AS rendered, CAST(own AS INTEGER) AS mask,
  CAST(CASE WHEN own THEN length(head) ELSE 0 END AS INTEGER) AS mask_start,
  CAST(CASE WHEN own THEN length(head || body || '<|im_end|>') ELSE 0 END AS INTEGER) AS mask_end
FROM headed
"""

"""Multi-party perspective rotation of dialogues, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; only the speaker's own words are trained on.
A rendered dialogue is kept as its segments in order, one row each, with its place in the
rendered text. So a conversation of any length is never gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose lengths are summed in one piece before the pieces are.
PIECE = 256
# fixed values: the marks of the chat template, and the role that is nobody's turn
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
SYSTEM = "system"


def _plain(said: Column) -> Column:
    return F.replace(said, F.lit("<|im_"), F.lit("<| im_"))


def _header(role: Column, name: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(" name="), name)), F.lit(MIDDLE))


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn.

    conv_id, perspective (the speaker who is the assistant), turn, role (assistant, user or
    system), name (of a user), rendered, mask_start and mask_end (the trained code points
    of the whole rendered dialogue: the assistant's text and its closing mark; null for
    others), char_start, char_end (of the segment there).

    A null or empty speaker is called "unknown"; a null text is empty. Turns are ordered by
    number (null first), then speaker and text, and repeated rows are turns of their own. System
    turns are no participant's; a conversation without participants gives no row, as does
    an empty table. Rows with a null conv_id form one conversation. Other columns are ignored.
    Marks of the template in a name or text get a space after their bar, and line ends in a
    name become spaces, so that no turn can pose as another.
    """
    said = conversations.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.replace(_plain(F.coalesce(F.nullif(F.col(speaker), F.lit("")), F.lit("unknown"))), F.lit("\n"), F.lit(" ")).alias("speaker"), _plain(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    ).withColumn("key", F.struct("conv_id"))
    people = said.where(F.col("speaker") != SYSTEM).groupBy("key").agg(F.collect_set("speaker").alias("people"))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    seen = said.join(people, "key").select("conv_id", F.explode("people").alias("perspective"), "turn", "speaker", "text")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    seen = seen.withColumn("header", _header(F.col("role"), F.col("name")))
    seen = seen.withColumn("rendered", F.concat("header", "text", F.lit(CLOSE))).withColumn("length", F.char_length("rendered").cast("long"))
    seen = seen.withColumn("piece", F.floor(F.coalesce("turn", F.lit(-1)) / PIECE))
    # running lengths inside a piece of turns, then over the pieces
    inside = Window.partitionBy("conv_id", "perspective", "piece").orderBy(F.asc_nulls_first("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "perspective").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = seen.groupBy("conv_id", "perspective", "piece").agg(F.sum("length").alias("n"))
    pieces = pieces.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("piece").alias("q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = seen.withColumn("within", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    placed = placed.join(pieces, placed.conv_id.eqNullSafe(pieces.c) & (placed.perspective == pieces.p) & (placed.piece == pieces.q))
    start = F.col("base") + F.col("within")
    trained = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "role", "name", "rendered",
        F.when(trained, start + F.char_length("header")).alias("mask_start"), F.when(trained, start + F.col("length")).alias("mask_end"),
        start.alias("char_start"), (start + F.col("length")).alias("char_end"),
    )


#: The same in DuckDB.
ROTATE_SQL = """
WITH said AS (
  SELECT conv_id, turn, replace(replace(coalesce(nullif(role, ''), 'unknown'), '<|im_', '<| im_'), chr(10), ' ') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), seen AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.text,
    CASE WHEN s.speaker = 'system' THEN 'system' WHEN s.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), named AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS header FROM seen
), placed AS (
  SELECT *, header || text || '<|im_end|>' || chr(10) AS rendered,
    coalesce(sum(length(header || text || '<|im_end|>' || chr(10))) OVER (
      PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
  FROM named
)
SELECT conv_id, perspective, turn, role, name, rendered,
  CASE WHEN role = 'assistant' THEN char_start + length(header) END AS mask_start,
  CASE WHEN role = 'assistant' THEN char_start + length(rendered) END AS mask_end,
  char_start, char_start + length(rendered) AS char_end
FROM placed
"""

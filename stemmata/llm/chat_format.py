"""Chat formatting: each assistant turn becomes an example of its own, with all turns before it as context.

One shuffle on the conversation gathers its turns; the rest is built-in array functions in the JVM. Only the reply is
trainable: ``train_start`` and ``train_end`` count characters of prompt and completion put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    """A turn can't forge the template's own marks."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, n_context, prompt, completion, train_start, train_end) of each assistant turn.

    ``conversations(conv_id, turn, role, text)``; roles are compared without case or blanks around them, a null role
    is ``unknown``. Turns are ordered by number, equal numbers by role and text; rows that repeat a whole turn count once.
    Rows with a null conv_id or turn have no place and are left out. A null text is an empty turn; an
    assistant turn without text stays as context but gives no example. ``<|`` in texts and roles is written ``< |``.
    An example holds all turns before it, whole, so the longest conversation is what one row must hold, and its examples together grow
    with its square. An empty table gives an empty result; other columns are ignored.
    """
    role = F.coalesce(F.lower(F.trim("role")), F.lit("unknown"))
    turns = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    ordered = ordered.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(F.lit(OPEN), _clean(t.role), F.lit("\n"), _clean(t.text), F.lit(CLOSE + "\n"))).alias("written"))
    each = ordered.select("conv_id", "turns", "written", F.posexplode("turns").alias("at", "t")).where("t.role = 'assistant' AND t.text <> ''")
    built = each.select(
        "conv_id",
        F.col("t.turn").alias("turn"),
        F.col("at").alias("n_context"),
        F.concat(F.array_join(F.slice("written", F.lit(1), F.col("at")), ""), F.lit(f"{OPEN}assistant\n")).alias("prompt"),
        F.concat(_clean(F.col("t.text")), F.lit(CLOSE)).alias("completion"),
    )
    return built.select("*", F.length("prompt").alias("train_start"), (F.length("prompt") + F.length("completion")).alias("train_end"))


SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(lower(trim(role)), 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), marked AS (
  SELECT *, row_number() OVER w - 1 AS n_context,
    string_agg('{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10), '')
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), built AS (
  SELECT conv_id, turn, CAST(n_context AS INTEGER) AS n_context, coalesce(before, '') || '{OPEN}assistant' || chr(10) AS prompt,
    replace(text, '<|', '< |') || '{CLOSE}' AS completion
  FROM marked WHERE role = 'assistant' AND text <> ''
)
SELECT *, CAST(length(prompt) AS INTEGER) AS train_start, CAST(length(prompt) + length(completion) AS INTEGER) AS train_end FROM built
"""

"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it are the context, and only that reply
is trainable. A turn is written ``<|role|>`` newline text ``<|end|>`` newline; ``prompt`` ends with
the opening of the reply, and ``[train_from, train_to)`` are the character positions, in
``prompt || completion``, that a loss may be taken of: the reply and its end mark.

No text can forge a mark: a backslash is written after each ``<`` that a bar follows, with any number of
backslashes between the two, and can be taken out again without loss. Of a role, characters other than letters, digits,
``_``, ``.`` and ``-`` are written as ``_``.

One shuffle, by conversation; the examples are cut from the ordered turns within the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.names import named

END = "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    """The text that was written."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(f"{END}\n"))


def expand(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """(conv_id, turn, n_context, prompt, completion, train_from, train_to), one row a target turn.

    Rows without a conversation id are left out. A null role is ``unknown`` and never a target; a
    null text is empty; an empty reply is still an example, of which the end mark is trained. Turns
    are ordered by number, a null number first, and equal numbers by role and text, so repeated rows
    are turns of their own in a defined order. Texts may be of any length; an empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    parts = turns.where(named(conv_col).isNotNull()).select(
        named(conv_col).alias("conv_id"),
        F.struct(
            named(turn_col).cast("bigint").alias("turn"),
            F.regexp_replace(F.coalesce(named(role_col), F.lit("unknown")), "[^A-Za-z0-9_.-]", "_").alias("role"),
            escaped(F.coalesce(named(text_col), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    convs = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.where(F.exists("ts", lambda t: t["role"] == target))
    convs = convs.withColumn("written", F.transform("ts", lambda t: _turn(t["role"], t["text"])))
    at = convs.select("conv_id", "written", F.posexplode("ts").alias("i", "t")).where(F.col("t.role") == target)
    prompt = F.concat(F.array_join(F.slice("written", F.lit(1), F.col("i")), ""), F.lit(f"<|{target}|>\n"))
    out = at.select("conv_id", F.col("t.turn").alias("turn"), F.col("i").cast("bigint").alias("n_context"), prompt.alias("prompt"), F.concat(F.col("t.text"), F.lit(END)).alias("completion"))
    return out.withColumns({"train_from": F.length("prompt").cast("bigint"), "train_to": (F.length("prompt") + F.length("completion")).cast("bigint")})


#: DuckDB SQL of op6_prefix_target.
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[^A-Za-z0-9_.-]', '_', 'g') AS role,
    regexp_replace(coalesce(text, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS text FROM conversations WHERE conv_id IS NOT NULL
), w AS (
  SELECT conv_id, turn, role, text,
    row_number() OVER c - 1 AS n_context,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '{END}' || chr(10), '') OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
  FROM t WINDOW c AS (PARTITION BY conv_id ORDER BY turn, role, text)
), p AS (
  SELECT conv_id, turn, n_context, context || '<|assistant|>' || chr(10) AS prompt, text || '{END}' AS completion FROM w WHERE role = 'assistant'
)
SELECT conv_id, turn, n_context::BIGINT AS n_context, prompt, completion,
  length(prompt)::BIGINT AS train_from, (length(prompt) + length(completion))::BIGINT AS train_to FROM p
"""

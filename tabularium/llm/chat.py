"""Chat formatting with perspective rotation, with DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that speaker as assistant, all others as named
users and system turns as they are, with a mask that trains on the speaker's own contents alone.

A dialogue is rendered in parts of PART_TURNS turn numbers, so no task gathers an unbounded group: a dialogue of up to
that many turns is one row for each speaker, a longer one gives further parts and loses nothing. Turns are ordered by turn
number, then role and text; a null turn comes first, in part 0; a null text is empty, a null role is the participant "unknown".
A dialogue of system turns alone has no participants and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS = 512
# Fixed values of the chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, n_turns, n_trained, text, mask) from turns (conv_id, turn, role, text).

    mask has a run for each stretch of text: "0:n" for n characters without and "1:n" with training, joined by commas.
    """
    t = turns.select(
        "conv_id",
        F.floor(F.coalesce(F.greatest("turn", F.lit(0)), F.lit(0)) / part_turns).cast("long").alias("part"),
        F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text")).alias("m"),
    )
    parts = t.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("m")).alias("m"))
    speakers = t.select("conv_id", F.col("m.role").alias("speaker")).filter("speaker <> 'system'").distinct()
    both = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.conv_id", "part", "speaker", "m")

    def head(m):
        named = F.concat(F.lit("user name="), m["role"])
        return F.concat(F.lit(OPEN), F.when(m["role"] == F.col("speaker"), "assistant").when(m["role"] == "system", "system").otherwise(named), F.lit("\n"))

    def runs(m):
        own = F.when(m["role"] == F.col("speaker"), "1:").otherwise("0:")
        return F.concat(F.lit("0:"), F.length(head(m)), F.lit(","), own, F.length(m["text"]), F.lit(f",0:{len(CLOSE)}"))

    text = F.array_join(F.transform("m", lambda m: F.concat(head(m), m["text"], F.lit(CLOSE))), "")
    mask = F.array_join(F.transform("m", runs), ",")
    trained = F.size(F.filter("m", lambda m: m["role"] == F.col("speaker")))
    return both.select("conv_id", "speaker", "part", F.size("m").alias("n_turns"), trained.alias("n_trained"), text.alias("text"), mask.alias("mask"))


#: DuckDB SQL for perspectives() of the table conversations.
PERSPECTIVES_SQL = f"""
WITH t AS (
  SELECT conv_id, CAST(floor(coalesce(greatest(turn, 0), 0) / {PART_TURNS}) AS BIGINT) AS part, turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
m AS (
  SELECT t.conv_id, s.speaker, t.part, t.turn, t.role, t.text,
         '{OPEN}' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system'
                          ELSE 'user name=' || t.role END || chr(10) AS head,
         CASE WHEN t.role = s.speaker THEN '1:' ELSE '0:' END AS own
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, speaker, part, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (own = '1:') AS INTEGER) AS n_trained,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
       string_agg('0:' || length(head) || ',' || own || length(text) || ',0:{len(CLOSE)}', ','
                  ORDER BY turn NULLS FIRST, role, text) AS mask
FROM m GROUP BY conv_id, speaker, part
"""

"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that
participant as ``assistant``, every other speaker as a named ``user``, and a loss
mask over the assistant's contents only.

Long conversations: a dialogue is cut into pieces of ``turns_per_segment``
consecutive turn numbers, one output row per (conversation, speaker, segment).
No task ever holds more than a segment, so one conversation with a third of all
turns spreads over many tasks. The pieces of a dialogue, in the order of their
segments, concatenate to the whole rendering and its mask; offsets count from the
start of the dialogue, ``start`` says where a piece begins. Dialogues below the bound
are a single row.

Defined results for odd input:

* null ``conv_id`` or null ``turn``: such rows belong to no dialogue, are skipped.
* null or empty ``role``: rendered as a user without a name, no perspective of
  its own.
* null ``text``: an empty content (kept, its mask span is empty).
* ties (equal turn): ordered by role, then text; repeated rows are kept.
* empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS_PER_SEGMENT = 256


def _segments(turns: DataFrame, turns_per_segment: int) -> DataFrame:
    return turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id",
        F.floor(F.col("turn") / turns_per_segment).cast("long").alias("segment"),
        "turn",
        F.when(F.col("role") != "", F.col("role")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _header(message: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("user name="), message["role"])
    who = F.when(message["role"] == speaker, F.lit("assistant")).otherwise(F.coalesce(named, F.lit("user")))
    return F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))


FOOTER = "<|im_end|>\n"


def _placed(cut: DataFrame) -> DataFrame:
    """``conv_id, segment, speaker, start``: every piece of every perspective and where it
    begins in its dialogue, from lengths alone."""
    as_other = F.coalesce(F.length("role") + len("user name="), F.lit(len("user")))
    fixed = len("<|im_start|>") + 1 + len(FOOTER)
    counted = cut.groupBy("conv_id", "segment", "role").agg(
        F.sum(as_other + fixed + F.length("text")).alias("length"),
        F.sum(len("assistant") - as_other).alias("change"),
    )
    speakers = counted.where("role IS NOT NULL").select("conv_id", F.col("role").alias("speaker")).distinct()
    pieces = counted.groupBy("conv_id", "segment").agg(F.sum("length").alias("length"))
    own = counted.select("conv_id", "segment", F.col("role").alias("speaker"), "change")
    sized = pieces.join(speakers, "conv_id").join(own, ["conv_id", "segment", "speaker"], "left")
    length = F.col("length") + F.coalesce("change", F.lit(0))
    before = Window.partitionBy("conv_id", "speaker").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("conv_id", "segment", "speaker", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long").alias("start"))


def rotate_perspectives(turns: DataFrame, turns_per_segment: int = TURNS_PER_SEGMENT) -> DataFrame:
    """Render every dialogue from every participant's point of view.

    Input columns ``conv_id, turn, role, text``. Output one row per
    (conv_id, speaker, segment): ``start``, ``n_messages``, ``n_trained`` (messages by the
    speaker), ``rendered``, ``mask`` (one character per message, 1 = trained) and
    ``mask_spans`` (``start:end`` code points of the trained contents inside the whole
    dialogue, end exclusive, comma-joined).

    The text is shuffled once, by (conversation, segment). Participants and places
    come from a text-free scan and are joined on the same keys, so the large side is
    not moved again, and no list of participants is collected.
    """
    cut = _segments(turns, turns_per_segment)
    dialogues = cut.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    )
    rows = dialogues.join(_placed(cut), ["conv_id", "segment"])
    speaker = F.col("speaker")
    rows = rows.withColumn(
        "parts",
        F.transform(
            "messages",
            lambda m: F.struct(
                _header(m, speaker).alias("head"),
                m["text"].alias("body"),
                m["role"].eqNullSafe(speaker).alias("own"),
            ),
        ),
    )
    spans = F.aggregate(
        "parts",
        F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(FOOTER))).alias("at"),
            F.when(
                p["own"],
                F.array_append(
                    acc["found"],
                    F.concat_ws(
                        ":",
                        (acc["at"] + F.length(p["head"])).cast("string"),
                        (acc["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string"),
                    ),
                ),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    own = F.transform("parts", lambda p: F.when(p["own"], "1").otherwise("0"))
    return rows.select(
        "conv_id",
        "speaker",
        "segment",
        "start",
        F.size("parts").cast("long").alias("n_messages"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(FOOTER))), "").alias("rendered"),
        F.array_join(own, "").alias("mask"),
        F.array_join(spans, ",").alias("mask_spans"),
    )


ORACLE_SQL = """
WITH cut AS (
  SELECT conv_id, CAST(floor(turn / 256.0) AS BIGINT) AS segment, turn,
         nullif(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM cut WHERE role IS NOT NULL),
parts AS (
  SELECT c.conv_id, s.speaker, c.segment, c.turn, c.role, c.text,
         '<|im_start|>' || CASE WHEN c.role = s.speaker THEN 'assistant'
           WHEN c.role IS NULL THEN 'user' ELSE 'user name=' || c.role END || chr(10) AS head,
         coalesce(c.role = s.speaker, false) AS own
  FROM cut c JOIN speakers s ON c.conv_id = s.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(text) + 11) OVER w - (length(head) + length(text) + 11) AS pos0,
         row_number() OVER w AS k
  FROM parts
  WINDOW w AS (PARTITION BY conv_id, speaker
               ORDER BY turn, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, segment, CAST(min(pos0) AS BIGINT) AS start, count(*) AS n_messages,
       CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_trained,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
       string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY k) AS mask,
       coalesce(string_agg(CAST(CAST(pos0 + length(head) AS BIGINT) AS VARCHAR) || ':'
         || CAST(CAST(pos0 + length(head) + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY k)
         FILTER (WHERE own), '') AS mask_spans
FROM placed GROUP BY conv_id, speaker, segment
"""

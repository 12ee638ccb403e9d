"""Public corpora as clip rows: labels fixed by where the audio comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.operators.ordering import first_ranked

COMMAND_INTENTS = {"stop": "stop", "yes": "confirm.yes", "no": "confirm.no"}


def sample_per_group(df: DataFrame, key: str, n: int, seed: int, row_id: str) -> DataFrame:
    """At most n rows per key by a seeded draw, the same in any partitioning."""
    draw = F.xxhash64(F.lit(seed), F.col(row_id))
    return first_ranked(df, [key], [draw, F.col(row_id)], n, F.col(row_id)).drop("rank")


def _constants(**facts) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in facts.items()}


def meeting_rows(segments: DataFrame, per_meeting: int = 150, seed: int = 0) -> DataFrame:
    """Segments ``meeting, start, end`` of meetings: always people talking to each other.

    The far-field channel mixes speakers, so the meeting is speaker and session.
    """
    keyed = segments.withColumn("__id", F.concat_ws("@", "meeting", F.col("start").cast("string")))
    kept = sample_per_group(keyed, "meeting", per_meeting, seed, "__id")
    who = F.concat(F.lit("ami-"), F.col("meeting"))
    return kept.select(
        F.concat(who, F.lit("-"), F.round("start", 4).cast("string")).alias("id"), "meeting",
        F.round("start", 4).alias("start"), F.round("end", 4).alias("end")).withColumns({
            **_constants(text="", g_addressed=V.HUMAN, category="real_human", source="ami",
                         license="CC-BY-4.0", consent="", mic="array1-01"),
            "speaker": who, "session": who,
            "room": F.concat(F.lit("ami-"), F.substring("meeting", 1, 2))})


def command_rows(files: DataFrame, per_word: int = 120, seed: int = 0) -> DataFrame:
    """Single-word command clips ``word, name``: always for the assistant."""
    known = files.where(F.col("word").isin(*COMMAND_INTENTS))
    kept = sample_per_group(known, "word", per_word, seed, "name")
    pairs = F.create_map(*[F.lit(x) for kv in COMMAND_INTENTS.items() for x in kv])
    return kept.select(
        F.concat_ws("-", F.lit("sc"), "word", F.regexp_replace("name", r"\.wav$", "")).alias("id"),
        F.col("word").alias("text"), pairs[F.col("word")].alias("g_intent")).withColumns({
            **_constants(g_addressed=V.ASSISTANT, category="real_command",
                         source="speech_commands", license="CC-BY-4.0", consent="",
                         room="speech_commands", mic="various")}).withColumn(
        "speaker", F.regexp_extract("id", r"^sc-[^-]*-([^_]*)", 1)).withColumn(
        "speaker", F.concat(F.lit("sc-"), F.col("speaker"))).withColumn(
        "session", F.col("speaker"))

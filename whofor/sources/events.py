"""The event log: one JSON line per stage of a turn, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor import fixed as V

EVENT_TYPE = (
    "t double, mono double, stage string, event string, turn string, reason string, "
    "would_skip boolean, skip boolean, mode string, confidence double, "
    "learned_confidence double, latency_ms string, feature_ms double, "
    "features map<string,double>, signals array<struct<signal:string,w:double,detail:string>>, "
    "route string, addressed struct<value:string,p:double,probs:map<string,double>>, "
    "intent struct<value:string,p:double>, "
    "slots map<string,struct<value:string,p:double>>, transcript string, text string")


def read_event_log(spark: SparkSession, path: str, streaming: bool = False,
                   schema: str = EVENT_TYPE) -> DataFrame:
    """Events with a turn; malformed lines are dropped, ``raw`` keeps the rest of the record.

    The file and the place in it order events of the same instant.
    """
    reader = spark.readStream if streaming else spark.read
    # A stream has no line numbers; there (t, mono, file) is the order.
    line = F.lit(0).cast("long") if streaming else F.monotonically_increasing_id()
    lines = reader.format("text").load(path)
    parsed = lines.select(
        F.from_json("value", schema + ", _corrupt string",
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"),
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"),
        line.alias("line"))
    good = parsed.where(F.col("e._corrupt").isNull()
                        & (F.coalesce("e.turn", F.lit("")) != ""))
    return good.select("e.*", "raw", "file", "line").drop("_corrupt")


def gate_latency():
    """Gate events log a number; decision events log a map of stages."""
    return F.col("latency_ms").try_cast("double")


def decision_latency(stage: str = "system_one"):
    return F.get_json_object("latency_ms", f"$.{stage}").try_cast("double")


def as_decisions(events: DataFrame) -> DataFrame:
    """The columns ``decision_pairs`` reads."""
    return events.select(
        "turn", "event", "t", "mono", "file", "line", "route", F.col("intent.value").alias("intent"),
        F.transform_values("slots", lambda k, v: v["value"]).alias("slots"),
        F.try_element_at(F.col("addressed.probs"), F.lit(V.ASSISTANT)).alias("p_assistant"),
        "transcript", decision_latency().alias("ms"))


def event_json(df: DataFrame, fields: list[str]) -> DataFrame:
    """``value`` lines: the envelope (t, mono at 6 places) and the named fields, nulls left out."""
    turn = F.nullif(F.col("turn"), F.lit(""))
    return df.select(F.to_json(F.struct(
        F.round("t", 6).alias("t"), F.round("mono", 6).alias("mono"), "stage", "event",
        turn.alias("turn"), *fields)).alias("value"),
        F.to_date(F.timestamp_seconds("t")).alias("date"))


def write_event_log(df: DataFrame, path: str, fields: list[str], checkpoint: str | None = None):
    """Append events, one folder per day. A stream returns its running query."""
    lines = event_json(df, fields)
    if df.isStreaming:
        return (lines.writeStream.format("text").partitionBy("date").option("path", path)
                .option("checkpointLocation", checkpoint).outputMode("append")
                .trigger(availableNow=True).start())
    lines.write.mode("append").partitionBy("date").text(path)
    return None

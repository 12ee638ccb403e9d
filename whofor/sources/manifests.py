"""Clip manifests (JSON Lines) and gate feature tables (CSV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from whofor import fixed as V

MANIFEST_TYPE = (
    "id string, path string, start double, end double, text string, g_addressed string, "
    "g_intent string, g_slots map<string,string>, category string, source string, "
    "license string, consent string, speaker string, session string, room string, mic string, "
    "augment struct<seed:bigint,babble:array<string>>, generate struct<kind:string,seed:bigint>, "
    "augment_info map<string,string>, transcript string, t_reliable boolean, t_accept boolean, "
    "t_confidence double, t_method string, t_addressed map<string,double>, t_intent string, "
    "t_intent_p double, t_slots map<string,string>, t_intent_probs map<string,double>, "
    "t_engine_addressed map<string,double>, t_judge_addressed map<string,double>, "
    "stt_ms double, text_ms double, t_teacher string, step int, duration double, _base string")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"/[^/]*$", "")


def read_manifest(spark: SparkSession, paths, schema: str = MANIFEST_TYPE) -> DataFrame:
    """Union of JSONL files; every row knows the folder its relative paths start from."""
    df = spark.read.schema(schema).json(paths)
    return df.withColumn("_base", F.coalesce("_base", folder_of(F.col("_metadata.file_path"))))


def absolute_paths(df: DataFrame) -> DataFrame:
    """``path`` and every babble path made absolute; the base is dropped."""
    def whole(p):
        return F.when(p.isNull() | F.startswith(p, F.lit("/")), p) \
            .otherwise(F.concat_ws("/", F.col("_base"), p))
    babble = F.when(F.col("augment.babble").isNotNull(), F.transform("augment.babble", whole))
    return df.withColumns({
        "path": whole(F.col("path")),
        "augment": F.when(F.col("augment").isNotNull(),
                          F.col("augment").withField("babble", babble))}).drop("_base")


def write_manifest(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per row, nulls kept. A NaN or infinity fails the write."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.coalesce(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(False))
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    checked = F.when(bad, F.raise_error(F.lit("a number is not finite"))).otherwise(text)
    df.select(checked.alias("value")).write.mode(mode).text(path)


def read_feature_rows(spark: SparkSession, paths) -> DataFrame:
    """Gate feature tables as doubles; a row with a blank feature fails the read."""
    columns = [*V.META_NAMES, *V.FEATURE_NAMES]
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)) \
        .option("enforceSchema", "false").csv(paths, header=True)

    def text(n):
        return F.trim(F.coalesce(F.col(n), F.lit("")))
    # The check is a filter over every feature, so it holds whichever columns are read later.
    blank = F.coalesce(*[F.when(text(n) == "", F.lit(n)) for n in V.FEATURE_NAMES])
    whole = F.when(blank.isNull(), True).otherwise(
        F.raise_error(F.concat(F.lit("row without "), blank)).cast("boolean"))
    return raw.where(whole).select(*[text(c).alias(c) for c in V.META_NAMES],
                                   *[text(n).cast("double").alias(n) for n in V.FEATURE_NAMES])


def write_feature_rows(df: DataFrame, path: str, mode: str = "error") -> None:
    """Fixed column order; what is missing is written blank."""
    have = set(df.columns)
    out = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c)
           for c in (*V.META_NAMES, *V.FEATURE_NAMES)]
    df.select(*out).write.mode(mode).csv(path, header=True, emptyValue="")

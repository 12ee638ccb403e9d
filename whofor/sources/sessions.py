"""Vector tables and saved sessions.

Vectors live in parquet partitioned by a file-safe encoder name, so reading
one encoder prunes the others at the scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spec_name(spec: Column) -> Column:
    """An encoder spec as a file-safe name."""
    return F.replace(F.translate(spec, "/@", "__"), F.lit(":"), F.lit("__"))


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    df.withColumn("spec_name", spec_name(F.col("spec"))) \
        .write.mode(mode).partitionBy("spec_name").parquet(path)


def one_encoder(df: DataFrame) -> DataFrame:
    """The vectors, or an error when they come from different encoders."""
    bounds = df.agg(F.min("spec").alias("a"), F.max("spec").alias("b")).first()
    if bounds["a"] != bounds["b"]:
        raise ValueError(f"{bounds['a']} and {bounds['b']}: one encoder at a time")
    return df


def table_order(table: int, file: Column, block: Column, row: Column) -> Column:
    return F.struct(F.lit(table).alias("table"), file.alias("file"), block.alias("block"), row.alias("row"))


def load_vectors(spark: SparkSession, paths: list[str], spec: str | None = None) -> DataFrame:
    """``id, vector, encode_ms, spec, seq`` of one encoder from one or more tables.

    ``seq`` orders rows by table, file and place; fields of their own cannot run into each other.
    """
    out = None
    for i, path in enumerate(paths):
        d = spark.read.parquet(path).withColumn(
            "seq", table_order(i, F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                               F.monotonically_increasing_id()))
        if spec is not None:
            name = spec.replace("/", "_").replace("@", "_").replace(":", "__")
            d = d.where(F.col("spec_name") == name)
        out = d if out is None else out.unionByName(d)
    return one_encoder(out)


def write_session(rows: DataFrame, vectors: DataFrame, facts: dict, path: str) -> None:
    """A manifest, a vector table per encoder and one metadata row, under one folder."""
    from whofor.sources.manifests import write_manifest
    write_manifest(rows, f"{path}/manifest")
    write_vectors(vectors, f"{path}/vectors")
    counts = rows.groupBy("g_addressed").agg(F.count(F.lit(1)).alias("n"))
    meta = counts.groupBy().agg(
        F.sum("n").alias("rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("g_addressed", "n"))))
        .alias("counts"))
    encoders = vectors.groupBy().agg(F.array_sort(F.collect_set("spec")).alias("encoders"))
    meta = meta.withColumn("encoders", encoders.scalar()) \
        .withColumn("collected_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    for k, v in facts.items():
        meta = meta.withColumn(k, F.lit(v))
    meta.select(F.to_json(F.struct(*meta.columns)).alias("value")).coalesce(1) \
        .write.text(f"{path}/session")


SESSION_TYPE = ("rows long, counts map<string,long>, encoders array<string>, "
                "collected_at string, session string, consent string, room string, "
                "speakers string, kind string")
MODEL_TYPE = ("tag string, encoder string, trained_at string, distributable boolean, "
              "targets string, thresholds map<string,double>, holdout struct<rows:long,"
              "stt_avoided:double,false_ignore:double,false_activation:double>")


def list_sessions(metadata: DataFrame, json_col: str = "value", path_col: str = "path") -> DataFrame:
    """Saved sessions, newest first; unreadable entries are left out."""
    d = metadata.select(path_col, F.from_json(json_col, SESSION_TYPE).alias("m"))
    return d.where(F.col("m.rows").isNotNull()).select(path_col, "m.*") \
        .orderBy(F.desc_nulls_last("collected_at"), path_col)


def list_models(metadata: DataFrame, json_col: str = "value", path_col: str = "path",
                modified: str = "modified") -> DataFrame:
    """Saved models with their holdout metrics, newest first; bad ones stay, with an error."""
    d = metadata.select(path_col, modified, F.from_json(json_col, MODEL_TYPE).alias("m"))
    bad = F.col("m.encoder").isNull()
    return d.select(path_col, modified, "m.tag", "m.encoder", "m.trained_at",
                    F.coalesce("m.distributable", F.lit(False)).alias("distributable"),
                    "m.targets", "m.holdout", F.when(bad, "not a model card").alias("error")) \
        .orderBy(F.desc(modified), path_col)


def session_data(rows: DataFrame, vectors: DataFrame, sessions: list[str], spec: str):
    """(rows, vectors) of the chosen sessions; one not recorded with the encoder is refused."""
    if not sessions:
        raise ValueError("pick at least one session")
    r = rows.where(F.col("session").isin(*sessions))
    v = vectors.where((F.col("spec_name") == spec.replace("/", "_").replace("@", "_")
                       .replace(":", "__")) & F.col("session").isin(*sessions))
    missing = r.select("session").distinct().join(v.select("session").distinct(), "session",
                                                  "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"{missing[0]['session']} was not recorded with {spec}")
    return r, v


def read_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, value, modified`` of small JSON metadata files."""
    return spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value",
        F.col("_metadata.file_modification_time").alias("modified"))


def dumps(facts: dict) -> str:
    return json.dumps(facts, allow_nan=False, sort_keys=True)

"""Provenance and data policy: what a row may be used for.

The registries hold a handful of sources, so they are compiled into column
expressions: no join, no shuffle, evaluated inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import is_true, literal_map

SOURCE_SCHEMA = ("registry string, source string, name string, license string, url string, "
                 "attribution string, distributable string")


def source_registry(spark: SparkSession) -> DataFrame:
    """Every registered source: licence, url, attribution, distributable yes/no/depends."""
    def word(flag):
        return {True: "yes", False: "no", None: "depends"}[flag]
    rows = [("gate", *s, "depends" if s[2] in (None, "consent") else
             "yes" if s[2] in V.OPEN_LICENSES else "no") for s in V.GATE_SOURCES]
    rows += [("clips", *s[:5], word(s[5])) for s in V.CLIP_SOURCES]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def _trim(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def resolve_provenance(df: DataFrame) -> DataFrame:
    """Adds ``p_source, p_license, p_consent`` and ``refusal`` (null when accepted)."""
    source, consent = F.lower(_trim(F.col("source"))), F.lower(_trim(F.col("consent")))
    registered = F.try_element_at(
        literal_map({s[0]: s[2] for s in V.GATE_SOURCES if s[2]}), source)
    given = F.nullif(_trim(F.col("license")), F.lit(""))
    license_ = F.coalesce(given, registered)
    known = source.isin([s[0] for s in V.GATE_SOURCES])
    refusal = (F.when(~known, F.concat(F.lit("unknown source "), source))
               .when(source == "shadow_log", "shadow-log rows come from a log export")
               .when((source == "consented") & ~consent.isin(*V.CONSENT_SCOPES),
                     "consented rows need consent release or internal")
               .when(source == "consented", F.lit(None))
               .when(registered.isNotNull() & (license_ != registered),
                     F.concat(source, F.lit(" is "), registered, F.lit("; the row says "),
                              license_))
               .when(~is_true(license_.isin(*V.OPEN_LICENSES)),
                     F.concat(F.lit("licence "), F.coalesce(license_, F.lit("none")),
                              F.lit(" is not open"))))
    taken = F.col("refusal").isNull()
    return (df.withColumn("refusal", refusal)
            .withColumn("p_source", F.when(taken, source))
            .withColumn("p_license", F.when(taken, F.when(source == "consented", "consent")
                                            .otherwise(license_)))
            .withColumn("p_consent", F.when(taken, F.when(source == "consented", consent)
                                            .otherwise(""))))


def gate_trainable(allow_internal: bool = False) -> Column:
    """May a gate feature row be trained on?"""
    scope = ["release", "internal"] if allow_internal else ["release"]
    return is_true(F.when(F.col("source") == "shadow_log", False)
                   .when(F.col("source") == "consented", F.col("consent").isin(*scope))
                   .otherwise(F.col("license").isin(*V.OPEN_LICENSES)))


def row_distributable() -> Column:
    """May a model trained on this clip be published?"""
    decided = {s[0]: s[5] for s in V.CLIP_SOURCES if s[5] is not None}
    return is_true(F.when(F.col("source") == "consented", F.col("consent") == "release")
                   .when(F.col("source").isin(*decided),
                         F.try_element_at(literal_map(decided), F.col("source")))
                   .otherwise(F.col("license").isin(*V.OPEN_LICENSES)))


def row_trainable(allow_internal: bool = False) -> Column:
    """Open or released; anything else only with ``allow_internal`` and a stated scope."""
    no_scope = ((F.col("source") == "consented")
                & ~is_true(F.col("consent").isin(*V.CONSENT_SCOPES)))
    return is_true(F.when(F.col("source") == "shadow_log", False).when(no_scope, False)
                   .otherwise(row_distributable() | F.lit(allow_internal)))


def provenance_summary(df: DataFrame, registry: str = "gate") -> DataFrame:
    """Rows per (source, licence, consent) with attribution and a per-group verdict."""
    sources = V.GATE_SOURCES if registry == "gate" else V.CLIP_SOURCES

    def look(i):
        return F.try_element_at(literal_map({s[0]: s[i] for s in sources}), F.col("source"))

    counts = (df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c)
                          for c in ("source", "license", "consent")])
              .groupBy("source", "license", "consent").agg(F.count(F.lit(1)).alias("rows")))
    ok = (is_true(F.col("license").isin(*V.OPEN_LICENSES) | (F.col("consent") == "release"))
          if registry == "gate" else row_distributable())
    return counts.select(
        "source", F.coalesce(look(1), F.col("source")).alias("name"), "license", "consent",
        "rows", F.coalesce(look(3), F.lit("")).alias("url"),
        F.coalesce(look(4), F.lit("")).alias("attribution"), ok.alias("distributable"))


def distributable(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.bool_and("distributable"), F.lit(True))
                       .alias("distributable"))


def refusal_report(df: DataFrame, trainable: Column) -> DataFrame:
    """Rows that may not be trained on, counted by source."""
    return df.where(~trainable).groupBy("source").agg(F.count(F.lit(1)).alias("refused"))

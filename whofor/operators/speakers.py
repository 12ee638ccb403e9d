"""Speaker verification over embedding tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whofor.functions.scalars import is_true
from whofor.operators.ordering import first_ranked
from whofor.operators.quantiles import quantiles

SCALE_FULL_SECONDS = 1.2
SCALE_FLOOR = 0.5
P_OWN_SLOPE = 0.08
SWEEP_STEPS = 19
FALSE_PASS_COST = 3.0
ENROL_WANTED = 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; null when it is too short to have a direction."""
    n = F.sqrt(dot(v, v))
    return F.when(n >= 1e-6, F.transform(v, lambda x: x.cast("double") / n))


def enrol(df: DataFrame, by: list[str], vector: str, dim: int) -> DataFrame:
    """One profile per speaker: the renormalised mean of unit vectors.

    One buffer per speaker and task sums all dimensions before the exchange, so
    a speaker with a third of the clips costs one partial row per task. No
    profile (null) from fewer than two usable vectors of ``dim`` numbers.
    """
    u = df.withColumn("__u", unit(F.col(vector))).where(F.size("__u") == dim)
    agg = u.groupBy(*by).agg(F.count(F.lit(1)).alias("clips"), vector_to_array(
        Summarizer.mean(array_to_vector(F.col("__u").cast("array<double>")))).alias("mean"))
    return agg.select(*by, "clips", F.when(F.col("clips") >= 2, unit(F.col("mean")))
                      .alias("profile"))


def similarity(df: DataFrame, profiles: DataFrame, on: list[str], vector: str) -> DataFrame:
    """Cosine similarity of each clip to the profile it is claimed to be."""
    p = profiles.select(*on, "profile")
    return df.join(p, on, "left").withColumn(
        "similarity", dot(unit(F.col(vector)), F.col("profile"))).drop("profile")


def scaled_threshold(threshold: Column, seconds: Column) -> Column:
    """The line for this much speech: short answers get half of it at the least."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(SCALE_FLOOR), seconds / SCALE_FULL_SECONDS))
    return threshold * share


def voice_estimate(df: DataFrame, threshold: Column, device: Column | None = None,
                   calibrated_for: Column | None = None) -> DataFrame:
    """Adds ``p_own, voice_confident, is_wearer, voice_line`` from similarity and seconds.

    No score is no evidence: p_own 1.0 and not confident. A line measured on
    another (or an unknown) device is no score either.
    """
    usable = F.col("similarity").isNotNull()
    if calibrated_for is not None:
        stamp = F.trim(F.coalesce(calibrated_for, F.lit("")))
        usable = usable & ((stamp == "") | is_true(F.coalesce(device, F.lit("")) == stamp))
    line = scaled_threshold(threshold, F.col("seconds"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("similarity") - line) / P_OWN_SLOPE))
    sim4, line4 = F.round("similarity", 4), F.round(line, 4)
    return df.withColumns({
        "p_own": F.when(usable, F.round(p, 4)).otherwise(1.0),
        "voice_confident": usable,
        "voice_line": F.when(usable, line4).otherwise(0.0),
        "is_wearer": F.when(usable, sim4 >= line4).otherwise(False)})


def sweep_voice_threshold(scores: DataFrame) -> DataFrame:
    """One row with the line that costs least, from ``similarity`` and ``is_owner``.

    Scores are counted into the 20 gaps between the 19 thresholds first; the
    sweep then runs over at most 40 counts. Among equal costs the middle
    threshold is taken.
    """
    steps = [k / 20.0 for k in range(SWEEP_STEPS)]
    d = scores.where(F.col("similarity").isNotNull())
    gap = reduce(lambda a, b: a + b,
                 [F.when(F.col("similarity") >= t, 1).otherwise(0) for t in steps])
    cells = d.groupBy("is_owner", gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("is_owner")
    # An owner's score silences every step from its gap up; another's passes every step below.
    touched = F.when(own, F.sequence(F.col("gap"), F.lit(SWEEP_STEPS))) \
        .otherwise(F.sequence(F.lit(-1), F.col("gap") - 1))
    counts = cells.withColumn("step", F.explode(touched)).groupBy("step").agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("silenced_n"),
        F.sum(F.when(~own, F.col("n")).otherwise(0)).alias("passed_n"))
    totals = cells.groupBy().agg(F.sum(F.when(own, F.col("n"))).alias("mine"),
                                 F.sum(F.when(~own, F.col("n"))).alias("theirs"))
    table = d.sparkSession.range(SWEEP_STEPS).select(F.col("id").cast("int").alias("step")) \
        .join(counts, "step", "left") \
        .withColumns({"mine": totals.select("mine").scalar(),
                      "theirs": totals.select("theirs").scalar()}).select(
        (F.col("step") / 20.0).alias("threshold"),
        (F.coalesce("silenced_n", F.lit(0)) / F.col("mine")).alias("silenced"),
        (F.coalesce("passed_n", F.lit(0)) / F.col("theirs")).alias("passed"))
    cost = F.col("silenced") + FALSE_PASS_COST * F.col("passed")
    # 19 rows: one task by construction.
    tied = table.withColumn("cost", cost).withColumn(
        "best", F.min("cost").over(Window.partitionBy(F.lit(0)))) \
        .where(F.col("cost") <= F.col("best") + 1e-9)
    chosen = tied.groupBy().agg(F.array_sort(F.collect_list(
        F.struct("threshold", "silenced", "passed"))).alias("t")) \
        .select(F.get("t", F.floor(F.size("t") / 2).cast("int")).alias("c")).select("c.*")
    med = quantiles(d, ["is_owner"], F.col("similarity"), {"median": 0.5})

    def median(flag):
        return med.where(F.col("is_owner") == F.lit(flag)).select("median").scalar()
    return chosen.withColumns({"m": median(True), "t": median(False)}).select(
        F.round("threshold", 2).alias("threshold"),
        F.round("silenced", 3).alias("wearer_silenced"),
        F.round("passed", 3).alias("bystander_passed"),
        F.round("m", 3).alias("wearer_median"), F.round("t", 3).alias("bystander_median"),
        (F.col("m") - F.col("t") > 0.15).alias("separated"))


def admit_enrolment(clips: DataFrame, order: list, wanted: int = ENROL_WANTED,
                    keys=("speaker", "side"), clip_id: str = "clip_id") -> DataFrame:
    """Usable clips only (0.4 to 12 s), the first few per speaker and side."""
    ok = clips.where((F.col("seconds") >= 0.4) & (F.col("seconds") <= 12.0))
    return first_ranked(ok, list(keys), order, wanted, F.col(clip_id))


def solo_voice_threshold(clips: DataFrame, by: list[str], vector: str, dim: int) -> DataFrame:
    """A line from one voice alone, from ``admit_enrolment`` rows (at most 8 per speaker).

    The first half enrols, the rest is scored; the line goes below the worst.
    """
    counts = clips.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    d = clips.join(counts, by)
    first = F.col("rank") <= F.greatest(F.lit(2), F.floor(F.col("__n") / 2))
    profiles = enrol(d.where(first), by, vector, dim).select(*by, "profile")
    held = similarity(d.where(~first), profiles, by, vector)
    worst = held.where(F.col("similarity").isNotNull()).groupBy(*by) \
        .agg(F.min("similarity").alias("worst"))
    line = F.greatest(F.lit(0.15), F.least(F.lit(0.5), F.col("worst") - 0.15))
    return worst.select(*by, F.round(line, 2).alias("threshold"),
                        F.round("worst", 3).alias("self_consistency"))

"""Frame streams in batch: voice activity, speech segments, level meter.

Frames are ``stream_id, frame_idx, ts`` plus a level or a probability. The
index counts a stream's frames without gaps, so it is the position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whofor.operators.ordering import carry_all, carry_last, overlap, own_rows, run_window
from whofor.session import cut_lineage

KEYS = ["stream_id"]
FLOOR_FRAMES = 100
FLOOR_MIN_SEEN = 10
FLOOR_PERCENTILE = 0.2
FLOOR_START, FLOOR_LEAST = 1e-3, 1e-5
SENSITIVITY = 3.0


def placed(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.col("frame_idx").cast("long"))


def speech_probability(level: Column, noise: Column) -> Column:
    ratio = level / (noise * SENSITIVITY)
    raw = (F.log10(ratio + 1e-9) + 0.5) / 1.2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def energy_vad(df: DataFrame) -> DataFrame:
    """Adds ``prob``: level against a rolling percentile of the last 100 frames."""
    d = overlap(placed(df), KEYS, back=FLOOR_FRAMES - 1)
    w = run_window(KEYS).rowsBetween(-(FLOOR_FRAMES - 1), 0)
    level = F.col("rms") + 1e-9
    d = d.withColumn("__level", level)
    quiet = F.percentile("__level", F.lit(FLOOR_PERCENTILE)).over(w)
    noise = F.when(F.col("pos") + 1 >= FLOOR_MIN_SEEN,
                   F.greatest(quiet, F.lit(FLOOR_LEAST))).otherwise(FLOOR_START)
    d = d.withColumn("prob", speech_probability(F.col("__level"), noise))
    return own_rows(d).drop("__level", "pos")


def level_meter(df: DataFrame, width: str = "100 milliseconds") -> DataFrame:
    """Peak level per tumbling window in dBFS; batch or stream (with a watermark)."""
    return (df.groupBy("stream_id", F.window("ts", width).alias("w"))
            .agg(F.max("rms").alias("peak"))
            .select("stream_id", F.col("w.start").alias("at"),
                    F.round(20 * F.log10(F.greatest("peak", F.lit(1e-6))), 1).alias("db")))


# -- segments -------------------------------------------------------------------------------

@dataclass(frozen=True)
class SegmentSettings:
    threshold: float = 0.5
    frame_ms: float = 32.0
    min_speech_ms: float = 200.0
    min_silence_ms: float = 550.0
    min_segment_ms: float = 350.0
    max_segment_ms: float = 20000.0
    preroll_s: float = 0.4

    @property
    def opening_frames(self) -> int:
        """Voiced frames in a row that open a segment."""
        return max(1, -int(-self.min_speech_ms // self.frame_ms))

    @property
    def closing_frames(self) -> int:
        """Unvoiced frames in a row after which nothing is open any more."""
        return -int(-self.min_silence_ms // self.frame_ms)

    @property
    def preroll_frames(self) -> int:
        return int(self.preroll_s * 1000.0 // self.frame_ms)

    @property
    def max_frames(self) -> int:
        return -int(-self.max_segment_ms // self.frame_ms)


SEGMENT_TYPE = ("stream_id long, start_s double, end_s double, seconds double, "
                "speech_seconds double, confidence double, truncated boolean")


@dataclass
class SegmentState:
    """Where one stream is: counters, the pre-roll's times and the open segment."""

    heard: int = 0              # voiced frames in a row while nothing is open
    quiet: int = 0              # unvoiced frames in a row while a segment is open
    length: int = 0             # frames in the open segment; 0 when none is open
    start: float = 0.0
    p_sum: float = 0.0
    p_n: int = 0
    preroll: list = field(default_factory=list)


def advance(s: SegmentState, cfg: SegmentSettings, at: float, p: float):
    """Take one frame; the finished segment as a tuple, or None."""
    voiced = p >= cfg.threshold
    if voiced:
        s.p_sum, s.p_n = s.p_sum + p, s.p_n + 1
    if s.length == 0:
        s.preroll = (s.preroll + [at])[-cfg.preroll_frames:] if cfg.preroll_frames else []
        s.heard = s.heard + 1 if voiced else 0
        if not voiced:
            s.p_sum, s.p_n = 0.0, 0
        elif s.heard * cfg.frame_ms >= cfg.min_speech_ms:
            s.length, s.quiet = max(1, len(s.preroll)), 0
            s.start = s.preroll[0] if s.preroll else at
        return None
    s.length += 1
    s.quiet = 0 if voiced else s.quiet + 1
    full = s.length >= cfg.max_frames
    if s.quiet * cfg.frame_ms < cfg.min_silence_ms and not full:
        return None
    seconds = s.length * cfg.frame_ms / 1000.0
    speech = seconds - cfg.min_silence_ms / 1000.0
    done = (s.start, at + cfg.frame_ms / 1000.0, seconds, round(speech, 3),
            s.p_sum / s.p_n if s.p_n else 0.0, full)
    s.heard, s.quiet, s.length, s.p_sum, s.p_n, s.preroll = 0, 0, 0, 0.0, 0, []
    return done if speech >= cfg.min_segment_ms / 1000.0 else None


def islands(df: DataFrame, cfg: SegmentSettings = SegmentSettings()) -> DataFrame:
    """Frames with ``pos`` and ``island``: stretches that can be read on their own.

    Enough unvoiced frames in a row close any segment and reset every counter,
    so a stream may be cut there. The cut is made a pre-roll before the next
    voiced frame, which is all the history that frame's segment can reach.
    """
    back, ahead = cfg.closing_frames + cfg.preroll_frames, cfg.preroll_frames
    d = overlap(placed(df).withColumn("__v", (F.col("prob") >= cfg.threshold).cast("int")),
                KEYS, back=back + ahead, ahead=ahead)
    w = run_window(KEYS)
    before = w.rowsBetween(-back, -1)
    fresh = (F.col("__v") == 1) & (F.coalesce(F.sum("__v").over(before), F.lit(0)) == 0) \
        & (F.count("__v").over(before) == back)
    d = d.withColumn("__fresh", fresh.cast("int"))
    cut = F.coalesce(F.lead("__fresh", ahead).over(w), F.lit(0)) == 1 if ahead \
        else F.col("__fresh") == 1
    d = own_rows(d.withColumn("__cut", cut))
    d = carry_last(d, KEYS, F.when(F.col("__cut") | (F.col("pos") == 0), F.col("pos")),
                   "island", inclusive=True)
    return d.drop("__v", "__fresh", "__cut")


def carry_next(df: DataFrame, value: Column, out: str) -> DataFrame:
    """The first non-null ``value`` after each row."""
    d = df.withColumn("__back", -F.col("pos"))
    return carry_last(d, KEYS, value, out, pos="__back").drop("__back")


def closings(df: DataFrame, cfg: SegmentSettings = SegmentSettings()) -> DataFrame:
    """``stream_id, island, was, opened, length, shut``: where a segment would open and close next.

    ``was`` is the frame before the stretch begins or one at which a segment may have closed: then
    the next segment opens at ``opened``, holding ``length`` frames, and closes at ``shut``. It opens
    at the first frame that ends enough voiced frames in a row since ``was``; it closes at the first
    run of enough unvoiced frames after that, or when it is full. All of this is the same whatever
    went before ``was``, so it is found for every frame that may matter, by windows. In stretches
    too short to fill a segment these are the ends of the unvoiced runs; elsewhere every frame.
    """
    k, q, most, lead = cfg.opening_frames, cfg.closing_frames, cfg.max_frames, cfg.preroll_frames
    d = islands(df, cfg).select(*KEYS, "pos", "island", (F.col("prob") >= cfg.threshold).alias("v"))
    d = carry_all(d, KEYS, {"__dumb": F.when(~F.col("v"), F.col("pos")), "__loud": F.when(F.col("v"), F.col("pos"))},
                  inclusive=True)
    voiced = F.col("pos") - F.coalesce("__dumb", F.lit(-1))
    d = d.withColumn("ends", (F.col("pos") - F.coalesce("__loud", F.lit(-1)) == q) if q else F.lit(True))
    d = carry_next(d, F.when(F.col("ends"), F.col("pos")), "quiet")
    opens = F.struct(F.col("pos").alias("at"), "quiet", F.col("island").alias("island"))
    d = d.withColumn("__here", F.when(voiced >= k, opens))
    d = carry_next(d, F.when(voiced == k, opens), "__later")
    d = d.withColumn("open", F.coalesce("__here", "__later")).where(F.col("open.island") == F.col("island"))
    # The row k frames after ``was`` knows the opening; whether ``was`` matters is looked up k rows back.
    size = Window.partitionBy(*KEYS, "run").orderBy("pos")
    marks = overlap(d.select(*KEYS, "pos", "island", "ends", "open"), KEYS, back=k)
    marks = own_rows(marks.withColumn("__ended", F.coalesce(F.lag("ends", k).over(size), F.lit(False))))
    was = F.col("pos") - k
    stretch = d.groupBy(*KEYS, "island").agg(F.max("pos").alias("__last"))
    long = F.col("__last") - F.col("island") + 1 >= most - max(1, lead)
    first = was == F.col("island") - 1
    d = marks.join(stretch, [*KEYS, "island"]).where(first | (was >= F.col("island")) & (F.col("__ended") | long))
    length = F.greatest(F.lit(1), F.least(F.lit(lead), F.col("open.at") - was))
    full = F.greatest(F.col("open.at") + 1, F.col("open.at") + most - length)
    return d.select(*KEYS, "island", was.alias("was"), F.col("open.at").alias("opened"), length.alias("length"),
                    F.least("open.quiet", full).alias("shut"), first.alias("first"))


def reached(steps: DataFrame) -> DataFrame:
    """The rows of ``closings`` that each stretch really comes to, by pointer jumping.

    Every round takes what is reached ahead by twice the steps of the round before, so rounds are
    about the logarithm of the segments in the longest stretch.
    """
    key = [*KEYS, "island"]
    steps = cut_lineage(steps)
    jump = steps.select(*key, "was", F.col("shut").alias("to"))
    found = steps.where("first").select(*key, "was")
    n = 0
    while True:
        # What is reached is met with the jumps of this round; a stretch that ends has none.
        ahead = found.join(jump, [*key, "was"]).select(*key, F.col("to").alias("was"))
        found = cut_lineage(found.union(ahead.join(steps.select(*key, "was"), [*key, "was"], "left_semi")).distinct())
        now = found.count()
        if now == n:
            return steps.join(found, [*key, "was"])
        n = now
        further = jump.select(*key, F.col("was").alias("to"), F.col("to").alias("__to"))
        jump = cut_lineage(jump.join(further, [*key, "to"]).select(*key, "was", F.col("__to").alias("to")))


def detect_segments(df: DataFrame, cfg: SegmentSettings = SegmentSettings()) -> DataFrame:
    """One row per closed speech segment. Frames need ``at_s`` and ``prob``.

    Frames are never stepped through: possible openings and closings are found by windows over
    bounded runs, those that happen by pointer jumping, and their frames by carrying each segment's
    beginning on to its end.
    """
    found = reached(closings(df, cfg))
    last = placed(df).groupBy(*KEYS).agg(F.max("pos").alias("__end"))
    begin = F.least(F.col("opened") - F.col("length"), F.col("opened") - cfg.opening_frames) + 1
    found = found.join(last, KEYS).where(F.col("shut") <= F.col("__end")).select(
        *KEYS, begin.alias("pos"), F.struct("opened", "length", "shut").alias("seg"))
    d = placed(df).select(*KEYS, "pos", "at_s", "prob").join(found, [*KEYS, "pos"], "left")
    d = carry_last(d, KEYS, F.col("seg"), "of", inclusive=True).where(F.col("pos") <= F.col("of.shut"))
    counted = (F.col("prob") >= cfg.threshold) & (F.col("pos") > F.col("of.opened") - cfg.opening_frames)
    seconds = (F.col("of.length") + F.col("of.shut") - F.col("of.opened")) * F.lit(cfg.frame_ms) / 1000.0
    done = d.groupBy(*KEYS, "of").agg(
        F.max(F.when(F.col("pos") == F.col("of.opened") - F.col("of.length") + 1, F.col("at_s"))).alias("start_s"),
        (F.max(F.when(F.col("pos") == F.col("of.shut"), F.col("at_s"))) + cfg.frame_ms / 1000.0).alias("end_s"),
        F.coalesce(F.avg(F.when(counted, F.col("prob"))), F.lit(0.0)).alias("confidence"))
    speech = seconds - cfg.min_silence_ms / 1000.0
    return done.where(speech >= cfg.min_segment_ms / 1000.0).select(
        "stream_id", "start_s", "end_s", seconds.alias("seconds"), F.round(speech, 3).alias("speech_seconds"),
        "confidence", (F.col("of.length") + F.col("of.shut") - F.col("of.opened") >= cfg.max_frames).alias("truncated"))


def vad_confidence(df: DataFrame, by: list[str], p: Column, threshold: float = 0.5) -> DataFrame:
    """Mean probability over voiced frames, 0 when none was voiced."""
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(p >= threshold, p)), F.lit(0.0))
                               .alias("vad_confidence"))

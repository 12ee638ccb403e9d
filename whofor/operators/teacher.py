"""The slow path as a labeller: soft answers from transcripts, kept next to gold labels."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions import text as T
from whofor.functions.scalars import argmax, count_if, is_true, rate_columns, safe_div
from whofor.operators.catalogue import CORE, Catalogue
from whofor.operators.parsing import missing_required, no_slots, parse_intent
from whofor.operators.signals import SignalSettings, TextContext, classify
from whofor.session import cut_lineage

PRIOR = {V.ASSISTANT: 0.02, V.HUMAN: 0.18, V.MEDIA: 0.80}
DIST = "map<string,double>"


def distribution(p: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(a) for a in p]), F.array(*p.values()))


def addressed_distribution(text: Column, confidence: Column, ai_intent: Column,
                           reliable: Column) -> Column:
    """Three probabilities from the engine's one; the rest split between people and media."""
    body = T.collapse(F.coalesce(text, F.lit("")))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    share = F.when(F.coalesce(reliable, F.lit(True)), 0.85).otherwise(0.35)
    share = F.when((T.word_count(body) <= 1) & ~ai_intent, F.least(share, F.lit(0.6))) \
        .otherwise(share)
    heard = distribution({V.ASSISTANT: p, V.HUMAN: (1.0 - p) * share,
                          V.MEDIA: (1.0 - p) * (1.0 - share)})
    prior = distribution({k: F.lit(v) for k, v in PRIOR.items()})
    return F.when((body == "") | confidence.isNull(), prior).otherwise(heard)


def slow_path_decision(df: DataFrame, catalogue: Catalogue = CORE) -> DataFrame:
    """Adds ``slow_route, slow_addressed, slow_intent, slow_p, slow_slots, slow_reason``.

    Expects the columns of ``classify`` and ``parse_intent`` and a map ``addressed``.
    """
    accepted = is_true(F.col("ai_intent"))
    rest, _ = argmax([(a, F.col("addressed")[a]) for a in (V.HUMAN, V.MEDIA)])
    short = missing_required(F.col("parse_intent"), F.col("parse_slots"), catalogue)
    return df.withColumns({
        "slow_route": F.when(accepted, "act").otherwise("ignore"),
        "slow_addressed": F.when(accepted, V.ASSISTANT).otherwise(rest),
        "slow_intent": F.when(accepted & short, V.OPEN_REQUEST)
        .when(accepted, F.col("parse_intent")),
        "slow_p": F.when(accepted, F.col("parse_p")),
        "slow_slots": F.when(accepted & ~short, F.col("parse_slots")).otherwise(no_slots()),
        "slow_reason": F.when(~accepted, "the intent engine says it was not for the assistant")
        .when(short, "a required slot was not said")
        .otherwise(F.concat(F.lit("parsed by "), F.col("parse_method")))})


def label_transcripts(df: DataFrame, judged: DataFrame | None = None, weight: float = 0.8,
                      settings: SignalSettings = SignalSettings(),
                      catalogue: Catalogue = CORE) -> DataFrame:
    """Teacher columns for a table with ``transcript``, ``reliable`` and ``tail_reliable``.

    Every row is judged cold. ``judged`` (from ``judge_batch``) joins on the
    normalised transcript key and is blended in by ``weight``.
    """
    d = df.withColumn("transcript", T.strip(F.coalesce(F.col("transcript"), F.lit(""))))
    silent = F.col("transcript") == ""
    ctx = TextContext(reliable=F.col("reliable"), tail_reliable=F.col("tail_reliable"))
    d = classify(d, F.col("transcript"), ctx, settings)
    d = parse_intent(d, F.col("transcript"), catalogue, settings.name, settings.aliases,
                     read_once=settings.read_once)
    d = d.withColumn("addressed", addressed_distribution(
        F.col("transcript"), F.when(~silent, F.col("confidence")),
        is_true(F.col("ai_intent")), F.col("reliable")))
    engine = F.col("addressed")
    base_method = F.when(silent, "no_transcript").otherwise(F.col("method"))
    cols = {
        "t_reliable": F.col("reliable"), "t_accept": ~silent & is_true(F.col("ai_intent")),
        "t_confidence": F.when(silent, 0.0).otherwise(F.col("confidence")),
        "t_method": base_method, "t_addressed": engine,
        "t_intent": F.when(~silent, F.col("parse_intent")),
        "t_intent_p": F.when(silent, 0.0).otherwise(F.col("parse_p")),
        "t_slots": F.when(silent, no_slots()).otherwise(F.col("parse_slots")),
        "t_intent_probs": F.lit(None).cast(DIST), "t_engine_addressed": F.lit(None).cast(DIST),
        "t_judge_addressed": F.lit(None).cast(DIST), "t_teacher": F.lit("engine")}
    if judged is not None:
        d = d.withColumn("judge_key", judge_key(F.col("transcript"))) \
            .join(judged.select("judge_key", "judge_addressed", "judge_intent"),
                  "judge_key", "left")
        cols = {**cols, **_blended(cols, engine, base_method, silent, weight, catalogue)}
    d = d.withColumns(cols)
    return d.select(*df.columns, *cols)


def _blended(cols, engine, base_method, silent, weight, catalogue) -> dict[str, Column]:
    ja, ji = F.col("judge_addressed"), F.col("judge_intent")
    asked = ~silent & ja.isNotNull()
    mix = distribution({a: weight * ja[a] + (1.0 - weight) * engine[a] for a in V.ADDRESSEES})
    settled = distribution({V.ASSISTANT: F.lit(0.98), V.HUMAN: F.lit(0.01),
                            V.MEDIA: F.lit(0.01)})
    addressed = F.when(asked & F.col("method").isin("named", "retry"), settled) \
        .when(asked, mix).otherwise(engine)
    names = catalogue.names
    has_intent = asked & (F.coalesce(F.size(ji), F.lit(0)) > 0)
    top, top_p = argmax([(n, F.try_element_at(ji, F.lit(n))) for n in names])
    exact = F.col("parse_method").isin("rule", "example") \
        & (F.col("parse_intent") != V.OPEN_REQUEST)
    slots = F.col("parse_slots")
    served = ~missing_required(top, slots, catalogue)
    sharpened = F.transform_values(
        F.map_concat(ji, F.map_filter(
            F.create_map(F.col("parse_intent"), F.lit(0.0)),
            lambda k, v: ~F.array_contains(F.map_keys(ji), k))),
        lambda k, v: 0.1 * v + F.when(k == F.col("parse_intent"), 0.9).otherwise(0.0))
    p_assist = addressed[V.ASSISTANT]
    return {
        "t_addressed": addressed,
        "t_engine_addressed": F.when(asked, engine), "t_judge_addressed": F.when(asked, ja),
        "t_method": F.when(asked, F.concat(F.lit("judge+"), base_method)).otherwise(base_method),
        "t_accept": F.when(asked, p_assist >= 0.5).otherwise(cols["t_accept"]),
        "t_confidence": F.when(asked, p_assist).otherwise(cols["t_confidence"]),
        "t_intent": F.when(has_intent & ~exact, F.when(served, top).otherwise(V.OPEN_REQUEST))
        .otherwise(cols["t_intent"]),
        "t_intent_p": F.when(has_intent & ~exact & served, top_p)
        .when(has_intent & ~exact, F.coalesce(
            F.try_element_at(ji, F.lit(V.OPEN_REQUEST)), F.lit(0.0)))
        .otherwise(cols["t_intent_p"]),
        "t_slots": F.when(has_intent & ~exact & ~served, no_slots())
        .otherwise(cols["t_slots"]),
        "t_intent_probs": F.when(has_intent & exact, sharpened)
        .when(has_intent & served, ji),
        "t_teacher": F.when(asked, f"judge x{weight:g}+engine").otherwise("engine")}


def label(clips: DataFrame, transcribe: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
          **kw) -> DataFrame:
    """Attach transcripts through a batch function, then label. Rows it leaves out are skipped.

    ``transcribe`` yields ``id, transcript, reliable, tail_reliable, stt_ms``.
    """
    # Kept, as rows and their distinct texts both read it: no clip is transcribed twice.
    heard = cut_lineage(clips.mapInPandas(
        transcribe, "id string, transcript string, reliable boolean, tail_reliable boolean, "
                    "stt_ms double"))
    rest = clips.drop("pcm", "content", "transcript", "reliable", "tail_reliable", "stt_ms")
    return label_transcripts(rest.join(heard, "id"), **kw)


def relabel(df: DataFrame, **kw) -> DataFrame:
    """Judge stored transcripts again: every teacher column is replaced, timings stay."""
    d = df.where(F.col("transcript").isNotNull()) \
        .withColumn("reliable", F.coalesce(F.col("t_reliable"), F.lit(True))) \
        .withColumn("tail_reliable", F.lit(True))
    old = [c for c in d.columns if c.startswith("t_")]
    return label_transcripts(d.drop(*old), **kw)


# -- the judge ------------------------------------------------------------------------------

def judge_key(text: Column) -> Column:
    return T.clean(F.coalesce(text, F.lit("")))


def judge_batch(df: DataFrame, text: str, who: Callable, what: Callable,
                catalogue: Catalogue = CORE, intent_threshold: float = 0.2) -> DataFrame:
    """One row per distinct text: ``judge_key, judge_addressed, judge_intent``.

    ``who(texts) -> n x 3`` and ``what(texts) -> n x intents`` are vectorised
    scorers. Repeats are asked once; the second question is asked only where
    the first leaves enough probability, by filtering between the two stages.
    """
    distinct = df.groupBy(judge_key(F.col(text)).alias("judge_key")) \
        .agg(F.min(T.collapse(F.col(text))).alias("text"))
    silent = distinct.where("judge_key = ''").select(
        "judge_key", distribution({k: F.lit(v) for k, v in PRIOR.items()})
        .alias("judge_addressed"), F.create_map().cast(DIST).alias("judge_intent"))

    def ask(fn, names):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    p = fn(list(pdf["text"]))
                    yield pdf.assign(dist=[dict(zip(names, map(float, row))) for row in p])
        return run
    spoken = distinct.where("judge_key <> ''")
    # Kept, as both what follows and the result read it: no text is asked twice.
    first = cut_lineage(spoken.mapInPandas(ask(who, list(V.ADDRESSEES)),
                                           f"judge_key string, text string, dist {DIST}"))
    likely = first.where(F.col("dist")[V.ASSISTANT] >= intent_threshold)
    second = likely.select("judge_key", "text").mapInPandas(
        ask(what, catalogue.names), f"judge_key string, text string, dist {DIST}") \
        .select("judge_key", F.col("dist").alias("judge_intent"))
    both = first.select("judge_key", F.col("dist").alias("judge_addressed")) \
        .join(second, "judge_key", "left") \
        .withColumn("judge_intent", F.coalesce("judge_intent", F.create_map().cast(DIST)))
    return both.unionByName(silent)


ANSWER_TYPE = f"judge_key string, judge_addressed {DIST}, judge_intent {DIST}"


def judge_with_store(df: DataFrame, text: str, who: Callable, what: Callable, store: str,
                     catalogue: Catalogue = CORE, intent_threshold: float = 0.2) -> DataFrame:
    """``judge_batch`` that asks only for texts without an answer in ``store``.

    ``store`` is a Parquet folder of answers by normalised text (one for each pair of scorers and
    catalogue). What is not in it is asked and appended, so repeats are free across runs too. Two
    runs at once may both ask; any one of equal keys is taken. The result reads from the store.
    """
    spark = df.sparkSession

    def known() -> DataFrame:
        return spark.read.schema(ANSWER_TYPE).parquet(store)
    spark.createDataFrame([], ANSWER_TYPE).write.mode("append").parquet(store)
    wanted = df.select(F.col(text).alias("text"), judge_key(F.col(text)).alias("judge_key"))
    fresh = wanted.join(known().select("judge_key"), "judge_key", "left_anti")
    asked = judge_batch(fresh, "text", who, what, catalogue, intent_threshold)
    asked.write.mode("append").parquet(store)
    return known().join(wanted.select("judge_key").distinct(), "judge_key", "left_semi").dropDuplicates(["judge_key"])


def option_probs(reply: Column, n: int) -> Column:
    """A lettered reply as probabilities: .9 on the letter, uniform when there is none."""
    up = F.upper(T.strip(F.coalesce(reply, F.lit(""))))
    alone = F.regexp_extract(up, r"\b([A-Z])\b", 1)
    letter = F.when(alone != "", alone).otherwise(F.regexp_extract(up, r"^([A-Z])", 1))
    at = F.when(letter != "", F.ascii(letter) - 65)
    # What each letter answers, worked out beforehand; letters beyond the options answer nothing.
    spread = 0.1 / max(n - 1, 1)
    answers = [_shares([0.9 if i == k else spread for i in range(n)]) for k in range(min(n, 26))]
    return F.coalesce(F.get(F.array(*[F.array(*map(F.lit, a)) for a in answers]), at),
                      F.array(*map(F.lit, _shares([1.0 / n] * n))))


def _shares(p: list[float]) -> list[float]:
    s = reduce(add, p, 0.0)
    return [x / s for x in p]


def normalised_probs(p: Column) -> Column:
    def shares(v):
        return F.get(F.transform(F.array(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)),
                                 lambda s: F.transform(v, lambda x: x / s)), 0)
    # One-element arrays hold the values and their sum: neither is worked out again for each element.
    return F.get(F.transform(F.array(p), shares), 0)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    top = F.array_max(logits)
    return normalised_probs(F.transform(logits, lambda z: F.exp((z - top) / t)))


def teacher_report(df: DataFrame, weights=(0.0, 0.5, 0.8, 1.0)) -> DataFrame:
    """Each blend weight against gold, from stored opinions; one pass over the rows."""
    rows = df.where(F.col("g_addressed").isNotNull() & F.col("t_judge_addressed").isNotNull())
    j, e = F.col("t_judge_addressed")[V.ASSISTANT], F.col("t_engine_addressed")[V.ASSISTANT]
    gold = F.col("g_addressed") == V.ASSISTANT
    d = rows.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    accept = F.col("w") * j + (1.0 - F.col("w")) * e >= 0.5
    d = d.select("w", F.coalesce("category", F.lit("?")).alias("category"),
                 accept.alias("accept"), gold.alias("gold"),
                 (F.col("t_intent") == F.col("g_intent")).alias("same"),
                 F.col("g_intent").isNotNull().alias("has_intent"))
    acc, g = F.col("accept"), F.col("gold")
    per_cat = d.groupBy("w", "category").agg(
        F.count(F.lit(1)).alias("n"), count_if(acc == g).alias("hits"),
        count_if(g).alias("gold_n"), count_if(g & ~acc).alias("missed"),
        count_if(~g).alias("other_n"), count_if(~g & acc).alias("false_act"),
        count_if(g & acc & F.col("has_intent")).alias("intent_n"),
        count_if(g & acc & F.col("has_intent") & is_true(F.col("same"))).alias("intent_ok"))
    out = per_cat.groupBy("w").agg(
        *[F.sum(c).alias(c) for c in ("n", "hits", "gold_n", "missed", "other_n", "false_act",
                                      "intent_n", "intent_ok")],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "category", F.round(safe_div(F.col("hits"), F.col("n")), 3).alias("acc")))))
        .alias("by_category"))
    return out.select(
        F.col("w").alias("weight"), F.col("n").alias("rows"),
        F.round(safe_div(F.col("hits"), F.col("n")), 4).alias("who_for_accuracy"),
        *rate_columns("missed", F.col("missed"), F.col("gold_n")),
        *rate_columns("false_activation", F.col("false_act"), F.col("other_n")),
        F.round(safe_div(F.col("intent_ok"), F.col("intent_n")), 4)
        .alias("intent_accuracy_when_accepted"), "by_category")


def transcript_reliability(pieces: DataFrame, engine: str = "segments") -> DataFrame:
    """Per clip, from recogniser pieces ``id, pos, text, score, no_speech``.

    ``segments``: score is a log-probability, reliable above -1, tail = last piece.
    ``segments_whole``: the same, but the clip's verdict is reused for the tail.
    ``tokens``: score is a confidence, reliable from .5, tail = last third.
    """
    def finite(c):
        return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if engine == "tokens":
        # Token positions are dense, so the last third needs only the clip's last position.
        ends = pieces.groupBy("id").agg((F.max("pos") + 1).alias("n"))
        d = pieces.join(ends, "id")
        in_tail = F.col("pos") >= F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 3))
        agg = d.groupBy("id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))),
                                     lambda s: s["text"]), "").alias("transcript"),
            finite(F.avg("score")).alias("score"),
            finite(F.avg(F.when(in_tail, F.col("score")))).alias("tail_score"),
            F.lit(None).cast("double").alias("no_speech"))
        line = 0.5
        ok, tail_ok = F.col("score") >= line, F.col("tail_score") >= line
    else:
        agg = pieces.groupBy("id").agg(
            T.collapse(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("pos", T.strip(F.col("text")).alias("t")))),
                lambda s: s["t"]), " ")).alias("transcript"),
            finite(F.avg("score")).alias("score"),
            finite(F.max_by("score", "pos")).alias("tail_score"),
            finite(F.max("no_speech")).alias("no_speech"))
        ok, tail_ok = F.col("score") > -1.0, F.col("tail_score") > -1.0
    out = agg.withColumn("reliable", F.coalesce(ok, F.lit(True)))
    tail = F.col("reliable") if engine == "segments_whole" else F.coalesce(tail_ok, F.lit(True))
    return out.withColumn("tail_reliable", tail)

"""Worth transcribing? The rule layer, the logistic layer and their decision.

Everything is a column expression over one row, so a decision over any table
is a single map stage with no shuffle and no Python worker.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import any_of, count_if, is_true, sigmoid, total
from whofor.operators.ordering import settle
from whofor.operators.quantiles import order_statistics


@dataclass(frozen=True)
class GateInputs:
    """What is known before anyone decodes a segment, as columns."""

    seconds: Column = field(default_factory=lambda: F.col("seconds"))
    confidence: Column = field(default_factory=lambda: F.col("confidence"))
    p_own: Column = field(default_factory=lambda: F.col("p_own"))
    voice_confident: Column = field(default_factory=lambda: F.col("voice_confident"))
    is_wearer: Column = field(default_factory=lambda: F.col("is_wearer"))
    since_ai: Column = field(default_factory=lambda: F.col("since_ai"))
    awaiting_answer: Column = field(default_factory=lambda: F.col("awaiting_answer"))
    confirming: Column = field(default_factory=lambda: F.col("confirming"))
    offer_pending: Column = field(default_factory=lambda: F.col("offer_pending"))
    recent_verdicts: Column = field(default_factory=lambda: F.col("recent_verdicts"))


@dataclass(frozen=True)
class GateModel:
    """A 20-feature logistic model: fixed size, so it travels as literals."""

    weights: tuple
    bias: float
    mean: tuple
    scale: tuple
    threshold: float | None = None
    feature_names: tuple = V.FEATURE_NAMES


def trailing_ignored(verdicts: Column) -> Column:
    """Length of the run of ``false`` at the newest end; null is not false."""
    return F.coalesce(F.aggregate(
        verdicts, F.lit(0),
        lambda run, v: F.when(v == F.lit(False), run + 1).otherwise(F.lit(0))), F.lit(0))


def newest_accepted(verdicts: Column) -> Column:
    return is_true(F.try_element_at(verdicts, F.lit(-1)))


# -- feature columns -------------------------------------------------------------

def gate_features(inp: GateInputs) -> dict[str, Column]:
    """The 11 context features; prosody columns are joined on by name."""
    since = F.when(inp.since_ai.isNull() | (inp.since_ai > 3600.0), F.lit(3600.0)) \
        .otherwise(inp.since_ai)

    def flag(c):
        return F.when(is_true(c), 1.0).otherwise(0.0)

    return {
        "duration": inp.seconds.cast("double"),
        "vad_confidence": inp.confidence.cast("double"),
        "p_own": F.coalesce(inp.p_own.cast("double"), F.lit(0.5)),
        "voice_confident": flag(inp.voice_confident),
        "is_wearer": F.when(inp.is_wearer, 1.0).when(~inp.is_wearer, 0.0).otherwise(0.5),
        "since_ai_log": F.log1p(F.greatest(F.lit(0.0), since)),
        "ignored_run": F.least(trailing_ignored(inp.recent_verdicts), F.lit(5)).cast("double"),
        "accepted_recently": flag(newest_accepted(inp.recent_verdicts)),
        "awaiting_answer": flag(inp.awaiting_answer),
        "confirming": flag(inp.confirming),
        "offer_pending": flag(inp.offer_pending),
    }


def context_from_features() -> GateInputs:
    """Read the inputs back from stored feature columns."""
    voice = F.col("voice_confident") >= 0.5
    wearer = F.when(F.abs(F.col("is_wearer") - 0.5) < 1e-6, F.lit(None)) \
        .otherwise(F.col("is_wearer") >= 0.5)
    run = F.round(F.col("ignored_run")).cast("int")
    return GateInputs(
        seconds=F.col("duration"), confidence=F.col("vad_confidence"),
        p_own=F.when(voice, F.col("p_own")), voice_confident=voice,
        is_wearer=F.when(voice, wearer), since_ai=F.expm1(F.col("since_ai_log")),
        awaiting_answer=F.col("awaiting_answer") >= 0.5,
        confirming=F.col("confirming") >= 0.5,
        offer_pending=F.col("offer_pending") >= 0.5,
        recent_verdicts=_verdicts(run, F.col("accepted_recently") >= 0.5))


def _verdicts(run: Column, accepted: Column) -> Column:
    none = F.array().cast("array<boolean>")
    return (F.when(run > 0, F.array_repeat(F.lit(False), run))
            .when(is_true(accepted), F.array(F.lit(True))).otherwise(none))


def context_from_manifest(seconds: Column, confidence: Column) -> GateInputs:
    """Inputs from free-text manifest columns; a blank means unknown."""
    def text(name):
        return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))

    def flag(name):
        return text(name).isin("1", "true", "yes", "y")

    def num(name, default=None):
        return F.coalesce(F.nullif(text(name), F.lit("")).try_cast("double"), F.lit(default))

    voice = flag("voice_confident")
    return GateInputs(
        seconds=seconds, confidence=confidence,
        p_own=F.when(voice, num("p_own")), voice_confident=voice,
        is_wearer=F.when(voice & (text("is_wearer") != ""), flag("is_wearer")),
        since_ai=num("since_ai", V.NEVER_SPOKEN), awaiting_answer=flag("awaiting_answer"),
        confirming=flag("confirming"), offer_pending=flag("offer_pending"),
        recent_verdicts=_verdicts(num("ignored_run", 0.0).cast("int"),
                                  flag("accepted_recently")))


# -- the rule layer -------------------------------------------------------------------

def signal_weights(inp: GateInputs, limits: dict = V.GATE_LIMITS,
                   weights: dict = V.GATE_WEIGHTS) -> dict[str, Column]:
    """Name -> weight, null where the signal did not fire."""
    w, lim = weights, limits
    run = trailing_ignored(inp.recent_verdicts)
    cold = inp.since_ai >= lim["cold_after"]
    return {
        "bias": F.lit(w["bias"]),
        "cold_conversation": F.when(cold, w["cold_conversation"]),
        "very_cold_conversation": F.when(cold & (inp.since_ai >= lim["very_cold_after"]),
                                         w["very_cold_conversation"]),
        "ignored_run": F.when(run > 0, F.lit(w["ignored_run"])
                              * F.least(run, F.lit(int(lim["ignored_run_cap"])))),
        "accepted_recently": F.when((run == 0) & newest_accepted(inp.recent_verdicts),
                                    w["accepted_recently"]),
        "not_wearer": F.when(inp.voice_confident & ~inp.is_wearer, w["not_wearer"]),
        "very_long": F.when(inp.seconds >= lim["long_seconds"], w["very_long"]),
        "very_short": F.when(~(inp.seconds >= lim["long_seconds"])
                             & (inp.seconds <= lim["short_seconds"]), w["very_short"]),
        "low_vad_confidence": F.when(inp.confidence < lim["low_confidence"],
                                     w["low_vad_confidence"]),
    }


def signal_details(inp: GateInputs) -> dict[str, Column]:
    return {
        "cold_conversation": F.when(inp.since_ai >= V.NEVER_SPOKEN, "never spoken").otherwise(
            F.format_string("%.0fs since the assistant spoke", inp.since_ai)),
        "ignored_run": F.format_string("%d ignored in a row",
                                       trailing_ignored(inp.recent_verdicts)),
        "not_wearer": F.when(inp.p_own.isNotNull(), F.format_string("p_own=%.2f", inp.p_own)),
        "very_long": F.format_string("%.1fs", inp.seconds),
        "very_short": F.format_string("%.2fs", inp.seconds),
        "low_vad_confidence": F.format_string("%.2f", inp.confidence),
    }


def signal_array(weights: dict[str, Column], details: dict[str, Column]) -> Column:
    """array<struct<signal, w, detail>> of what fired, in declared order."""
    return F.array_compact(F.array(*[
        F.when(w.isNotNull(), F.struct(
            F.lit(n).alias("signal"), w.cast("double").alias("w"),
            details.get(n, F.lit(None)).cast("string").alias("detail")))
        for n, w in weights.items()]))


def confidence_of(weights: dict[str, Column]) -> Column:
    return sigmoid(total([F.coalesce(w, F.lit(0.0)) for w in weights.values()]))


def licensed(weights: dict[str, Column]) -> Column:
    return any_of([weights[n].isNotNull() for n in V.GATE_LICENSING])


def context_must(inp: GateInputs, protect_wearer: bool = True,
                 limits: dict = V.GATE_LIMITS) -> Column:
    """Why both layers must transcribe, or null."""
    out = (F.when(inp.confirming, "a confirmation is open")
           .when(inp.offer_pending, "an offer is waiting for an answer")
           .when(inp.awaiting_answer, "the assistant asked a question")
           .when(inp.since_ai < limits["cold_after"], "inside the follow-up window"))
    if protect_wearer:
        out = out.when(inp.voice_confident & inp.is_wearer,
                       "the enrolled voice was confidently detected")
    return out


def must_transcribe(inp: GateInputs, protect_wearer: bool = True,
                    limits: dict = V.GATE_LIMITS) -> Column:
    """Why the rules must transcribe, or null."""
    return F.coalesce(context_must(inp, protect_wearer, limits),
                      F.when(~is_true(inp.voice_confident), "the voice could not be checked"))


# -- the logistic layer ------------------------------------------------------------------

def predict_gate(model: GateModel) -> Column:
    terms = [(F.col(n) - F.lit(m)) / F.lit(max(s, 1e-8)) * F.lit(w)
             for n, m, s, w in zip(model.feature_names, model.mean, model.scale, model.weights)]
    return sigmoid(total(terms) + F.lit(model.bias))


def feature_problem(samples: Column | None = None) -> Column:
    """Why a vector is not something to skip on, or null."""
    finite = any_of([F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == float("inf"))
                     for n in V.FEATURE_NAMES])
    out = F.when(finite, "non-finite features")
    if samples is not None:
        out = out.when(samples == 0, "no audio")
    return (out.when(F.col("voiced_ratio") <= 0.0, "nothing voiced in the segment")
            .when(F.col("duration") <= 0.0, "zero-length segment"))


def model_problem(feature_names, weights, mean, scale) -> Column:
    """DQ on a table of models: names, lengths and finiteness. Null when usable."""
    def bad(c):
        return F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    n = len(V.FEATURE_NAMES)
    sizes = any_of([F.coalesce(F.size(c), F.lit(-1)) != n for c in (weights, mean, scale)])
    return (F.when(feature_names.isNotNull()
                   & (feature_names != F.array(*map(F.lit, V.FEATURE_NAMES))),
                   "model was trained on a different feature set")
            .when(sizes, f"model vectors must have {n} entries")
            .when(any_of([bad(c) for c in (weights, mean, scale)]),
                  "model contains non-finite values"))


# -- the decision ------------------------------------------------------------------------

def gate_decide(df: DataFrame, inp: GateInputs, mode: str = "shadow",
                model: GateModel | None = None, learned: bool = False,
                protect_wearer: bool = True, samples: Column | None = None,
                limits: dict = V.GATE_LIMITS) -> DataFrame:
    """Adds the gate's decision columns, from stored features when a model is given."""
    if mode not in ("off", "shadow", "skip"):
        raise ValueError("mode must be off, shadow or skip")
    if mode == "off":
        return df.withColumns({
            "gate_confidence": F.lit(1.0), "would_skip": F.lit(False), "skip": F.lit(False),
            "must": F.lit(None).cast("string"), "reason": F.lit("")})
    weights = signal_weights(inp, limits)
    must = must_transcribe(inp, protect_wearer, limits)
    p_rule = confidence_of(weights)
    rule = must.isNull() & licensed(weights) & (p_rule < limits["skip_below"])
    if model is None:
        p_learned = F.lit(None).cast("double")
        why = F.lit("model unavailable (not loaded)" if learned else "")
        skip_learned = F.lit(False)
    else:
        p_learned = F.round(predict_gate(model), 4)
        why = F.coalesce(context_must(inp, protect_wearer, limits), feature_problem(samples),
                         F.lit("" if model.threshold is not None
                               else "model has no calibrated threshold"))
        skip_learned = is_true((why == "") & (p_learned < F.lit(model.threshold)))
    out = df.withColumns({
        "gate_confidence": F.round(p_rule, 4), "must": must,
        "rule_would_skip": is_true(rule), "learned_confidence": p_learned,
        "learned_reason": why, "learned_would_skip": skip_learned})
    would = F.col("learned_would_skip" if learned else "rule_would_skip")
    reason = F.col("learned_reason") if learned else F.coalesce(F.col("must"), F.lit(""))
    out = out.withColumns({
        "would_skip": would, "skip": would & F.lit(mode == "skip"),
        "reason": F.when(would, F.lit("")).otherwise(reason)})
    out = settle(out, ["gate_confidence", "must", "rule_would_skip", "learned_confidence",
                       "learned_reason", "learned_would_skip", "would_skip", "skip", "reason"])
    return out.withColumn("gate_signals", signal_array(weights, signal_details(inp)))


def loggable(seconds: Column) -> Column:
    """A seconds value that is safe in JSON: NaN and infinity become 'never'."""
    s = seconds.cast("double")
    return F.when(s.isNull() | F.isnan(s) | (s > V.NEVER_SPOKEN), F.lit(V.NEVER_SPOKEN)) \
        .otherwise(F.round(s, 1))


def gate_log(with_features: bool = False) -> Column:
    """The JSON record of a decision made by ``gate_decide``."""
    fields = [F.round("gate_confidence", 3).alias("confidence"), F.col("would_skip"),
              F.col("skip"), F.col("reason"), F.col("rule_would_skip"),
              F.transform("gate_signals", lambda s: F.struct(
                  s["signal"].alias("signal"), F.round(s["w"], 3).alias("w"),
                  s["detail"].alias("detail"))).alias("signals"),
              F.col("learned_confidence"),
              F.when(F.col("learned_confidence").isNotNull()
                     | (F.col("learned_reason") != ""),
                     F.col("learned_would_skip")).alias("learned_would_skip"),
              F.when(F.col("learned_confidence").isNotNull()
                     | (F.col("learned_reason") != ""),
                     F.col("learned_reason")).alias("learned_reason")]
    if with_features:
        fields.append(F.struct(*[F.round(F.col(n), 5).alias(n)
                                 for n in V.FEATURE_NAMES]).alias("features"))
    return F.to_json(F.struct(*fields))


def _imagined(inp: GateInputs, seconds: Column, wearer: bool | None) -> GateInputs:
    return GateInputs(
        seconds=seconds, confidence=F.lit(1.0), p_own=F.lit(None).cast("double"),
        voice_confident=F.lit(True), is_wearer=F.lit(wearer).cast("boolean"),
        since_ai=inp.since_ai, awaiting_answer=inp.awaiting_answer,
        confirming=inp.confirming, offer_pending=inp.offer_pending,
        recent_verdicts=inp.recent_verdicts)


def worth_acknowledging(inp: GateInputs, limits: dict = V.GATE_LIMITS) -> Column:
    """Is an early look worth it, judged on the conversation alone?"""
    guess = _imagined(inp, F.lit(1.0), None)
    dead = (is_true(inp.since_ai >= limits["very_cold_after"])
            & (trailing_ignored(inp.recent_verdicts) >= 2))
    return must_transcribe(guess, limits=limits).isNotNull() | ~dead


def worth_head_start(inp: GateInputs, limits: dict = V.GATE_LIMITS) -> Column:
    """Should transcription start during the hangover? (Asked in skip mode.)"""
    guess = _imagined(inp, inp.seconds, True)
    w = signal_weights(guess, limits)
    return (must_transcribe(guess, limits=limits).isNotNull() | ~licensed(w)
            | (confidence_of(w) >= limits["skip_below"]))


def gate_counters(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Running totals of what the gate did; works on a stream in update mode."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scored"), count_if(F.col("would_skip")).alias("would_skip"),
        count_if(F.col("skip")).alias("skipped"),
        count_if(F.col("must").isNotNull()).alias("never_skip"))


# -- thresholds and explanations -----------------------------------------------------------

def eligibility(df: DataFrame, model: GateModel, protect_wearer: bool = True) -> DataFrame:
    """Adds ``p`` and ``may_skip``: would anything but the score forbid a skip?"""
    inp = context_from_features()
    open_ended = (context_must(inp, protect_wearer).isNull() & feature_problem().isNull())
    return settle(df.withColumns({"p": F.round(predict_gate(model), 4), "may_skip": open_ended}),
                  ["p", "may_skip"])


def choose_threshold(df: DataFrame, p: Column, may_skip: Column, positive: Column,
                     max_false_skip: float, ceiling: float = 0.5) -> DataFrame:
    """One row ``threshold``: skipping below it stays within the budget.

    Null when there is no positive row to choose on.
    """
    found = (df.groupBy().agg(count_if(positive).alias("n_pos")))
    budget = F.floor(F.lit(max_false_skip) * F.col("n_pos") + F.lit(1e-9))
    exposed = df.where(is_true(positive & may_skip))
    at = order_statistics(exposed, [], p, {"next": budget}, extra=found)
    both = (found.select("n_pos", F.lit(None).cast("double").alias("value"))
            .unionByName(at.select(F.lit(None).cast("long").alias("n_pos"), "value")))
    return both.groupBy().agg(F.max("n_pos").alias("n_pos"), F.max("value").alias("value")) \
        .select(F.when(F.col("n_pos") > 0,
                       F.least(F.coalesce(F.col("value"), F.lit(float(ceiling))),
                               F.lit(float(ceiling)))).alias("threshold"))


def explain(model: GateModel, top: int = 3) -> Column:
    """The features that pushed hardest towards a skip, hardest first."""
    parts = F.array(*[
        F.struct(((F.col(n) - F.lit(m)) / F.lit(max(s, 1e-8)) * F.lit(w)).alias("logit"),
                 F.lit(i).alias("i"), F.lit(n).alias("feature"), F.col(n).alias("value"))
        for i, (n, m, s, w) in enumerate(
            zip(model.feature_names, model.mean, model.scale, model.weights))])
    return F.transform(F.slice(F.array_sort(parts), 1, top), lambda x: F.struct(
        x["feature"].alias("feature"), F.round(x["value"], 4).alias("value"),
        F.round(x["logit"], 3).alias("logit")))

"""Who was it for? Named, weighted text signals and the decision they make.

One utterance is one row; context arrives as columns. Scoring is a chain of
projections (clean text -> weights -> score -> decision), so a table of any
size is scored in one map stage. The only sequential part, a verdict that
depends on the verdict before it, lives in ``conversation.py``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions import text as T
from whofor.functions.scalars import any_of, is_true, sigmoid, total
from whofor.operators.ordering import settle
from whofor.session import small_methods

SIGNAL_ORDER = (
    "bias", "assistant_name", "assistant_name_mentioned", "bystander_addressed",
    "human_vocative", "request_verb", "question_lead", "question_mark", "knowledge_seeking",
    "tool_domain", "polite_request", "human_discourse_lead", "backchannel",
    "social_register", "joint_planning", "reported_speech", "third_person_about_ai",
    "self_talk", "not_own_voice", "physical_request", "driving_browser", "followup_window",
    "answering_ai_question", "topical_continuity", "anaphoric_reference",
    "human_exchange_in_progress", "very_short_fragment", "long_utterance",
    "retry_of_ignored", "unreliable_transcript")
PATTERN_SIGNALS = (
    "human_vocative", "request_verb", "question_lead", "knowledge_seeking", "tool_domain",
    "polite_request", "human_discourse_lead", "backchannel", "social_register",
    "joint_planning", "reported_speech", "third_person_about_ai", "self_talk",
    "physical_request")


@dataclass(frozen=True)
class SignalSettings:
    name: str = V.DEFAULT_NAME
    aliases: tuple = ()
    bystanders: tuple = ()
    followup_window: float = 20.0
    followup_bonus: float = 0.3
    topical_window: float = 45.0
    topical_bonus: float = 1.3
    answering_bonus: float = 1.2
    accept: float = 0.62
    reject: float = 0.34
    llm_weight: float = 0.65
    own_voice_veto: float = 0.35
    #: Short texts that repeat, as spoken ones do, are read once each and joined back; long ones are
    #: better read where they stand. Streams always are.
    read_once: bool = True
    weights: tuple = tuple(V.SIGNAL_WEIGHTS.items())


@dataclass(frozen=True)
class TextContext:
    """Context columns; the defaults are a cold start."""

    reliable: Column | None = None
    tail_reliable: Column | None = None
    own_voice: Column | None = None
    driving: Column | None = None
    since_ai: Column | None = None
    last_ai_text: Column | None = None
    human_exchange: Column | None = None
    retry: Column | None = None
    tail_retry: Column | None = None
    llm_score: Column | None = None


def text_facts(body: Column, s: SignalSettings) -> dict[str, Column]:
    """What a cleaned text says whatever the context."""
    out = {n: T.found_named(body, n) for n in (*PATTERN_SIGNALS, "anaphoric_reference")}
    pattern = T.name_pattern(s.name, s.aliases)
    if pattern:
        out["named"] = T.found(body, pattern)
        out["addressed"] = T.is_vocative(body, pattern)
    if s.bystanders:
        anyone = r"\b(?:" + "|".join(re.escape(b.lower()) for b in s.bystanders) + r")\b"
        out["bystander_addressed"] = T.found(body, anyone)
    alone = ~T.found(F.regexp_replace(body, V.PATTERNS["driving_polite_lead"], ""),
                     V.PATTERNS["driving_somebody_else"])
    return out | {"driving_browser": alone & T.found(body, V.PATTERNS["driving_browser"]),
                  "question_mark": F.endswith(body, F.lit("?")), "words": T.word_count(body),
                  "topics": T.content_words(body)}


def matches(body: Column, s: SignalSettings) -> dict[str, Column]:
    """What of a cleaned text makes each signal fire that has a pattern or a name."""
    out = {n: F.regexp_extract(body, V.PATTERNS[n], 0) for n in SIGNAL_ORDER if n in V.PATTERNS}
    pattern = T.name_pattern(s.name, s.aliases)
    if pattern:
        out["assistant_name"] = out["assistant_name_mentioned"] = F.regexp_extract(body, pattern, 0)
    if s.bystanders:
        out["bystander_addressed"] = F.coalesce(*[
            F.when(T.found(body, rf"\b{re.escape(b.lower())}\b"), b.lower()) for b in s.bystanders])
    return out


def _clauses(df: DataFrame, text: Column) -> DataFrame:
    d = df.withColumn("body", T.clean(F.coalesce(text, F.lit(""))))
    d = d.withColumn("tail_text", T.last_sentence(F.coalesce(text, F.lit(""))))
    return d.withColumn("tail_body", T.clean(F.col("tail_text")))


def _read(df: DataFrame, text: Column, s: SignalSettings) -> tuple[DataFrame, dict, dict, list[str]]:
    """``df`` with its clauses, their facts and matches by clause, and the columns that hold them."""
    bodies = ("body", "tail_body")
    small_methods(df.sparkSession)
    if not s.read_once or df.isStreaming:
        return (_clauses(df, text), {b: text_facts(F.col(b), s) for b in bodies},
                {b: matches(F.col(b), s) for b in bodies}, [])

    def facts(d):
        d = _clauses(d, F.col("__said"))
        return d.withColumns({f"__{b}_{n}": c for b in bodies for n, c in text_facts(F.col(b), s).items()} | {
            f"__{b}_matches": F.struct(*[c.alias(n) for n, c in matches(F.col(b), s).items()]) for b in bodies})
    d = T.once_a_text(df, text, facts)
    names, found = list(text_facts(F.lit(""), s)), list(matches(F.lit(""), s))
    return (d, {b: {n: F.col(f"__{b}_{n}") for n in names} for b in bodies},
            {b: {n: F.col(f"__{b}_matches")[n] for n in found} for b in bodies},
            [f"__{b}_{n}" for b in bodies for n in (*names, "matches")])


def _weights(fact: dict[str, Column], ctx: TextContext, s: SignalSettings,
             reliable: Column | None, driving: Column | None,
             retry: Column | None) -> dict[str, Column]:
    w = dict(s.weights)

    def fire(cond, weight):
        return F.when(cond, F.lit(float(weight)))

    out: dict[str, Column] = {"bias": F.lit(w["bias"])}
    if "named" in fact:
        out["assistant_name"] = fire(fact["named"] & fact["addressed"], w["assistant_name"])
        out["assistant_name_mentioned"] = fire(fact["named"] & ~fact["addressed"],
                                               w["assistant_name_mentioned"])
    for name in ("bystander_addressed", *PATTERN_SIGNALS, "question_mark"):
        if name in fact:
            out[name] = fire(fact[name], w[name])

    presence: Column = F.lit(1.0)
    if ctx.own_voice is not None:
        p = F.least(F.greatest(ctx.own_voice, F.lit(1e-3)), F.lit(1.0 - 1e-3))
        against = F.greatest(F.lit(-3.0), F.least(F.lit(0.0), F.log(p / (1.0 - p))))
        out["not_own_voice"] = F.when(ctx.own_voice.isNotNull() & (against < 0),
                                      F.round(against, 3))
        presence = F.coalesce(F.least(F.lit(1.0), ctx.own_voice / 0.5), F.lit(1.0))
    if driving is not None:
        out["driving_browser"] = fire(is_true(driving) & fact["driving_browser"],
                                      w["driving_browser"])

    if ctx.since_ai is not None:
        since = F.coalesce(ctx.since_ai, F.lit(V.NEVER_SPOKEN))
        near = since < s.followup_window
        share = since / s.followup_window
        bonus = F.lit(s.followup_bonus) * (1.0 - share * share) * 2.0 * presence
        out["followup_window"] = F.when(near & (bonus > 0), bonus)
        out["anaphoric_reference"] = fire(
            near & fact["anaphoric_reference"], w["anaphoric_reference"])
        if ctx.last_ai_text is not None:
            asked = F.endswith(T.strip(F.coalesce(ctx.last_ai_text, F.lit(""))), F.lit("?"))
            answer = F.lit(s.answering_bonus) * presence
            out["answering_ai_question"] = F.when(near & asked & (answer > 0), answer)
            shared = F.when(
                (since <= s.topical_window) & (F.length(ctx.last_ai_text) > 0),
                F.size(F.array_intersect(fact["topics"], T.content_words(ctx.last_ai_text))))
            weight = (F.lit(s.topical_bonus) * F.least(shared, F.lit(3)) / 3.0
                      * (1.0 - 0.5 * (since / s.topical_window)))
            out["topical_continuity"] = F.when(shared > 0, F.round(weight, 3))
    if ctx.human_exchange is not None:
        out["human_exchange_in_progress"] = fire(is_true(ctx.human_exchange),
                                                 w["human_exchange_in_progress"])
    strong = any_of([out[n].isNotNull() for n in V.STRONG_POSITIVE if n in out])
    words = fact["words"]
    short = (words <= 2) & ~fact["question_mark"] & ~strong
    out["very_short_fragment"] = fire(short, w["very_short_fragment"])
    out["long_utterance"] = fire(~short & (words > 28), w["long_utterance"])
    if retry is not None:
        out["retry_of_ignored"] = fire(is_true(retry), w["retry_of_ignored"])
    if reliable is not None:
        out["unreliable_transcript"] = fire(~F.coalesce(reliable, F.lit(True)),
                                            w["unreliable_transcript"])
    return {n: out[n] for n in SIGNAL_ORDER if n in out}


def _pack(weights: dict[str, Column]) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in weights.items()])


def _logit(struct: str, names) -> Column:
    return total([F.coalesce(F.col(f"{struct}.{n}"), F.lit(0.0)) for n in names])


def _signals(weights: Column, facts: dict, found: dict, names, ctx: TextContext) -> Column:
    """array<struct<signal, w, detail>> of what fired, with what made it fire.

    The detail is the matched text, the name or bystander that was heard, the estimate of the own
    voice, or up to three shared topic words; signals of shape and momentum have none.
    """
    def scored(by_clause, n):
        whole, tail = by_clause["body"][n], by_clause["tail_body"][n]
        return F.when(F.col("use_tail"), tail).otherwise(whole)
    known = {}
    if ctx.own_voice is not None:
        known["not_own_voice"] = F.format_string("p_own=%.2f", ctx.own_voice.cast("double"))
    if ctx.last_ai_text is not None:
        shared = F.array_intersect(scored(facts, "topics"), T.content_words(ctx.last_ai_text))
        known["topical_continuity"] = F.array_join(F.slice(F.array_sort(shared), 1, 3), ", ")

    def detail(n):
        if n in known:
            return known[n]
        return scored(found, n) if n in found["body"] else F.lit(None).cast("string")
    return F.array_compact(F.array(*[
        F.when(weights[n].isNotNull(), F.struct(F.lit(n).alias("signal"),
                                                weights[n].alias("w"),
                                                detail(n).alias("detail")))
        for n in names]))


def weigh(df: DataFrame, text: Column, ctx: TextContext = TextContext(),
          settings: SignalSettings = SignalSettings()) -> DataFrame:
    """Adds ``whole`` and ``tail`` weight structs, their logits and scores.

    ``tail`` re-reads the trailing clause of a multi-sentence utterance, with
    audience evidence from the whole carried across; it is null otherwise.
    """
    d, _, _, helpers = _weighed(df, text, ctx, settings)
    return d.drop(*helpers)


def _weighed(df, text, ctx, settings) -> tuple[DataFrame, dict, dict, list[str]]:
    tail_reliable = ctx.reliable if ctx.tail_reliable is None else ctx.tail_reliable
    d, facts, found, helpers = _read(df, text, settings)
    whole = _weights(facts["body"], ctx, settings, ctx.reliable, ctx.driving, ctx.retry)
    tail = _weights(facts["tail_body"], ctx, settings, tail_reliable, None, ctx.tail_retry)
    # Plain structs, null field by field: reading one field then costs only that field.
    spoken = F.col("tail_text").isNotNull()
    tail = {n: F.when(spoken, c) for n, c in tail.items()}
    d = d.withColumns({"whole": _pack(whole), "own_tail": _pack(tail)})
    names = list(dict.fromkeys([*whole, *tail]))
    merged = {}
    for n in names:
        mine = F.col(f"own_tail.{n}") if n in tail else F.lit(None).cast("double")
        carried = n in V.AUDIENCE_SIGNALS and n in whole
        merged[n] = F.coalesce(mine, F.when(spoken, F.col(f"whole.{n}"))) if carried else mine
    d = d.withColumn("tail", _pack(merged))
    d = d.withColumns({
        "whole_logit": _logit("whole", list(whole)),
        "tail_logit": F.when(spoken, _logit("tail", names)),
    }).withColumns({
        "whole_p": sigmoid(F.col("whole_logit"), 30.0),
        "tail_p": sigmoid(F.col("tail_logit"), 30.0)}).drop("own_tail")
    return d, facts, found, helpers


def heuristic_score(df: DataFrame, text: Column, ctx: TextContext = TextContext(),
                    settings: SignalSettings = SignalSettings()) -> DataFrame:
    """Adds ``heuristic``, ``scored_clause``, ``weights`` and ``signals``."""
    d, facts, found, helpers = _weighed(df, text, ctx, settings)
    names = list(d.schema["tail"].dataType.names)
    whole_names = set(d.schema["whole"].dataType.names)
    use_tail = is_true(F.col("tail_p") > F.col("whole_p"))

    def chosen(n):
        whole = F.col(f"whole.{n}") if n in whole_names else F.lit(None).cast("double")
        return F.when(F.col("use_tail"), F.col(f"tail.{n}")).otherwise(whole).alias(n)
    d = d.withColumn("use_tail", use_tail)
    use_tail = F.col("use_tail")
    d = d.withColumns({
        "heuristic": F.when(use_tail, F.col("tail_p")).otherwise(F.col("whole_p")),
        "scored_clause": F.when(use_tail, F.col("tail_text")),
        "weights": F.struct(*[chosen(n) for n in names])})
    d = settle(d, ["heuristic", "scored_clause", "weights"])
    return d.withColumn("signals", _signals(
        F.col("weights"), facts, found, names, ctx)) \
        .drop(*helpers, "whole", "tail", "tail_text", "tail_body", "body", "use_tail",
              "whole_logit", "tail_logit", "whole_p", "tail_p")


def has_audience(weights: Column, names) -> Column:
    """Did any signal say a person was being spoken to?"""
    return any_of([weights[n] < 0 for n in V.AUDIENCE_SIGNALS if n in names])


def decide(heuristic: Column, named: Column, retried: Column, reliable: Column,
           own_voice: Column, llm: Column, s: SignalSettings) -> Column:
    """struct<band, method, confidence, ai_intent> from a score and the two certainties."""
    vetoed = is_true(own_voice < s.own_voice_veto)
    sure = is_true(named) & ~vetoed
    again = is_true(retried) & is_true(reliable) & ~vetoed
    blended = s.llm_weight * llm + (1.0 - s.llm_weight) * heuristic
    band = (F.when(sure | again | (heuristic >= s.accept), "accept")
            .when(heuristic < s.reject, "reject").otherwise("ambiguous"))
    method = (F.when(sure, "named").when(again, "retry")
              .when((heuristic >= s.accept) | (heuristic < s.reject), "heuristic")
              .when(llm.isNull(), "heuristic_default").otherwise("llm"))
    confidence = (F.when(sure | again, 1.0)
                  .when((heuristic >= s.accept) | (heuristic < s.reject), heuristic)
                  .otherwise(F.coalesce(blended, heuristic)))
    return F.struct(band.alias("band"), method.alias("method"),
                    confidence.alias("confidence"),
                    (confidence >= s.accept).alias("ai_intent"))


def classify(df: DataFrame, text: Column, ctx: TextContext = TextContext(),
             settings: SignalSettings = SignalSettings()) -> DataFrame:
    """Adds the decision columns and the tri-state ``ai_directed`` verdict."""
    d = heuristic_score(df, text, ctx, settings)
    names = d.schema["weights"].dataType.names
    w = F.col("weights")
    none = F.lit(None).cast("double")
    retried = w["retry_of_ignored"].isNotNull() if "retry_of_ignored" in names \
        else F.lit(False)
    named = w["assistant_name"].isNotNull() if "assistant_name" in names else F.lit(False)
    d = d.withColumn("decision", decide(
        F.col("heuristic"), named, retried,
        F.lit(True) if ctx.reliable is None else F.coalesce(ctx.reliable, F.lit(True)),
        none if ctx.own_voice is None else ctx.own_voice,
        none if ctx.llm_score is None else ctx.llm_score, settings))
    return d.select("*", "decision.*").drop("decision").withColumn(
        "ai_directed", F.when(F.col("ai_intent"), True)
        .when(has_audience(w, names), False))


def explain(top: int = 6) -> Column:
    """The strongest signals first, as one readable line."""
    ranked = F.slice(F.array_sort(F.transform("signals", lambda s, i: F.struct(
        (-F.abs(s["w"])).alias("k"), i.alias("i"), s["signal"].alias("n"),
        s["w"].alias("w")))), 1, top)
    return F.array_join(F.transform(ranked, lambda s: F.concat(
        s["n"], F.when(s["w"] >= 0, "+").otherwise(""), F.format_string("%.2f", s["w"]))), ", ")


def decision_json() -> Column:
    return F.to_json(F.struct(
        "ai_intent", F.round("confidence", 4).alias("confidence"), "band", "method",
        F.round("heuristic", 4).alias("heuristic"),
        F.transform("signals", lambda s: F.struct(
            s["signal"].alias("signal"), F.round(s["w"], 3).alias("w"),
            s["detail"].alias("match"))).alias("signals")))

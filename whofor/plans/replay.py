"""The whole decision order over recorded segments, as one event table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor.functions import text as T
from whofor.functions.scalars import is_true
from whofor.operators.catalogue import CORE, Catalogue
from whofor.operators.conversation import score_conversations
from whofor.operators.gate import GateInputs, GateModel, gate_decide
from whofor.operators.parsing import parse_intent
from whofor.operators.signals import SignalSettings
from whofor.operators.teacher import addressed_distribution, slow_path_decision

EVENT = "struct<step:int,stage:string,event:string,detail:string>"


@dataclass(frozen=True)
class ReplaySettings:
    fast_mode: str = "shadow"        # off | shadow | on
    gate_mode: str = "shadow"        # off | shadow | skip
    can_act: bool = True             # is there anything to hand a decision to?


def _event(step: int, stage: str, event, detail: Column | str | None = None) -> Column:
    detail = F.lit(detail) if detail is None or isinstance(detail, str) else detail
    event = F.lit(event) if isinstance(event, str) else event
    return F.struct(F.lit(step).alias("step"), F.lit(stage).alias("stage"),
                    event.alias("event"), detail.cast("string").alias("detail"))


def replay(segments: DataFrame, settings: ReplaySettings = ReplaySettings(),
           signals: SignalSettings = SignalSettings(), catalogue: Catalogue = CORE,
           gate_model: GateModel | None = None) -> DataFrame:
    """One row per emitted event: ``turn, conv_id, at_s, step, stage, event, detail``.

    ``segments`` holds, per turn: conversation position (``conv_id, at_s, turn,
    role``; assistant rows carry its lines), the voice estimate, the recorded
    gate inputs, the fast decision (``route, intent``) and the transcript.
    Every stage filters before the next, costlier one.
    """
    s = settings
    heard = segments.where("role = 'user'")
    wrong_voice = is_true(F.col("voice_confident")) & ~is_true(F.col("is_wearer"))
    fast = F.lit(s.fast_mode) != "off"
    on = s.fast_mode == "on"
    handled = F.lit(on) & ((F.col("route") == "ignore")
                           | ((F.col("route") == "act") & F.lit(s.can_act)))
    d = gate_decide(heard, GateInputs(), s.gate_mode, gate_model, gate_model is not None)
    d = d.withColumns({"wrong_voice": wrong_voice, "handled": ~wrong_voice & is_true(handled)})
    silent = T.strip(F.coalesce(F.col("text"), F.lit(""))) == ""
    d = d.withColumns({
        "gated": ~F.col("wrong_voice") & ~F.col("handled") & F.col("skip"),
        "empty": silent})
    none = F.lit(None).cast(EVENT)
    shown = ~F.col("wrong_voice")
    past = shown & ~F.col("handled")
    acted = F.col("handled") & (F.col("route") == "act")
    early = F.array_compact(F.array(
        F.when(F.col("wrong_voice"), _event(1, "audio", "segment_dropped", "not_own_voice")),
        F.when(shown & fast, _event(2, "slu", "slu_decided", F.col("route"))),
        F.when(F.col("handled") & ~acted, _event(3, "audio", "segment_dropped", "system_one")),
        F.when(acted, _event(3, "slu", "decision_delivered", "system_one")),
        F.when(past & F.lit(s.gate_mode != "off"), _event(4, "system", "gate_scored",
                                                          F.col("would_skip").cast("string"))),
        F.when(F.col("gated"), _event(5, "audio", "segment_dropped", "gate")),
        F.when(past & ~F.col("gated"), _event(6, "stt", "transcribe_started")),
        F.when(past & ~F.col("gated") & F.col("empty"),
               _event(7, "stt", "transcript_rejected", "empty")),
        F.when(past & ~F.col("gated") & ~F.col("empty"),
               _event(7, "stt", "transcript_ready", F.col("text"))), none))
    keep = ["turn", "conv_id", "at_s"]
    first = d.select(*keep, F.explode(early).alias("e"))

    # What reaches the text side, with the assistant's lines and what was already answered.
    reached = d.where(acted | (past & ~F.col("gated") & ~F.col("empty"))) \
        .withColumn("acted", acted) \
        .withColumn("text", F.when(acted, F.concat(F.lit("("), F.col("intent"), F.lit(")")))
                    .otherwise(F.col("text")))
    columns = ["conv_id", "at_s", "turn", "role", "text", "reliable", "driving", "llm_score",
               "own_voice", "acted"]
    said = reached.withColumn("own_voice", F.when(is_true(F.col("voice_confident")),
                                                  F.col("p_own")))
    lines = segments.where("role = 'assistant'").withColumns({
        "acted": F.lit(False), "own_voice": F.lit(None).cast("double")})
    scored = score_conversations(said.select(*columns).unionByName(lines.select(*columns)),
                                 signals).where("method <> 'acted'")
    p = parse_intent(scored, F.col("text"), catalogue, signals.name, signals.aliases,
                     read_once=signals.read_once)
    p = p.withColumn("addressed", addressed_distribution(
        F.col("text"), F.col("confidence"), is_true(F.col("ai_intent")), F.lit(True)))
    p = slow_path_decision(p, catalogue)
    ai = is_true(F.col("ai_intent"))
    late = F.array_compact(F.array(
        F.when(fast | F.lit(s.can_act), _event(8, "slu", "slu_system_two", F.col("slow_route"))),
        F.when(ai, _event(9, "intent", "intent_accepted",
                          F.round("confidence", 3).cast("string")))
        .otherwise(_event(9, "intent", "intent_ignored",
                          F.round("confidence", 3).cast("string"))),
        F.when(ai & F.lit(s.can_act), _event(10, "slu", "decision_delivered", "system_two"))))
    second = p.select(*keep, F.explode(late).alias("e"))
    return first.unionByName(second).select(*keep, "e.*")

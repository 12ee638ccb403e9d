"""Scoring whole conversations, where a verdict is evidence for the next one.

Everything that does not depend on earlier verdicts is scored natively first.
What is left per row is a few numbers and flags: two logits, which of the last
four utterances sound the same, and how old they are. A verdict reaches no
further than 25 seconds, so 25 seconds of silence ends an episode and episodes
are independent. An episode is cut into pieces that are read side by side
(``chain``), so one without any silence is read by many tasks.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import replace
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from whofor import fixed as V
from whofor.functions import text as T
from whofor.functions.scalars import is_true, sigmoid, total
from whofor.operators import chain
from whofor.operators.context import KEYS, _lookback, since_ai, users
from whofor.operators.signals import SignalSettings, TextContext, decide, has_audience, weigh
from whofor.session import cut_lineage

EXCHANGE_SECONDS = 25.0
RETRY_SECONDS = 20.0
RETRY_RATIO = 0.82
RETRY_DEPTH = 4

VERDICT_TYPE = ("heuristic double, band string, method string, confidence double, "
                "ai_intent boolean, ai_directed boolean, human_exchange boolean, retry boolean")
FACTS = ["whole_logit", "tail_logit", "named_whole", "named_tail", "audience_whole",
         "audience_tail", "sounds_whole", "sounds_tail", "gap_s", "reliable", "own_voice",
         "llm_score", "acted"]


def similar(a: str, b: str) -> bool:
    """Ratcliff-Obershelp ratio above the retry line, cheapest bounds first."""
    m = SequenceMatcher(None, a, b)
    return (m.real_quick_ratio() > RETRY_RATIO and m.quick_ratio() > RETRY_RATIO
            and m.ratio() > RETRY_RATIO)


@F.pandas_udf(ArrayType(IntegerType()))
def _sounds_like(text: pd.Series, earlier: pd.Series) -> pd.Series:
    """How many utterances back each similar one is. Only candidate pairs arrive here."""
    out = []
    for t, cands in zip(text, earlier):
        if t is None or cands is None or len(cands) == 0:
            out.append([])
        else:
            out.append([int(c["back"]) for c in cands if similar(t, c["body"])])
    return pd.Series(out)


def prepare(df: DataFrame, settings: SignalSettings = SignalSettings()) -> DataFrame:
    """User rows with the ``FACTS`` a verdict needs, and their ``upos`` in the conversation."""
    d = users(df).withColumn("body", T.clean(F.coalesce("text", F.lit(""))))
    d = _lookback(d, "upos", {"__prev": F.struct("at_s", "body", "upos")}, RETRY_DEPTH)
    ctx = TextContext(
        reliable=F.col("reliable"), own_voice=F.col("own_voice"), driving=F.col("driving"),
        since_ai=since_ai(F.col("at_s"), F.col("last_ai_at")),
        last_ai_text=F.col("last_ai_text"))
    # Read where they stand: with the join, scoring took longer (README).
    d = weigh(d, F.col("text"), ctx, replace(settings, read_once=False))

    def candidates(body):
        la = F.length(body)

        def near(p):
            lb = F.length(p["body"])
            # 2 * min / sum bounds the ratio from above, so this drops no true match.
            bound = 2.0 * F.least(la, lb) > RETRY_RATIO * (la + lb)
            return (F.col("at_s") - p["at_s"] <= RETRY_SECONDS) & ((la + lb == 0) | bound)
        return F.transform(F.filter("__prev", near), lambda p: F.struct(
            (F.col("upos") - p["upos"]).cast("int").alias("back"), p["body"].alias("body")))
    names_w = set(d.schema["whole"].dataType.names)
    names_t = set(d.schema["tail"].dataType.names)
    d = d.withColumns({
        "sounds_whole": _sounds_like(F.col("body"), candidates(F.col("body"))),
        "sounds_tail": _sounds_like(F.col("tail_body"), candidates(F.col("tail_body"))),
        "named_whole": F.col("whole.assistant_name").isNotNull(),
        "named_tail": is_true(F.col("tail.assistant_name").isNotNull()),
        "audience_whole": is_true(has_audience(F.col("whole"), names_w)),
        "audience_tail": is_true(has_audience(F.col("tail"), names_t)),
        "reliable": F.coalesce("reliable", F.lit(True)),
        "acted": is_true(F.col("acted")) if "acted" in d.columns else F.lit(False)})
    return d.drop("whole", "tail", "body", "tail_body", "tail_text", "whole_p", "tail_p",
                  "__prev")


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


class VerdictChain:
    """The last few verdicts of one episode, and the next one given a row's facts."""

    def __init__(self, settings: SignalSettings, recent=()):
        self.s = settings
        w = dict(settings.weights)
        self.exchange_w = w["human_exchange_in_progress"]
        self.retry_w = w["retry_of_ignored"]
        self.recent = deque(recent, maxlen=RETRY_DEPTH)      # newest first

    def next(self, f) -> tuple:
        s, past = self.s, self.recent
        if f["acted"]:
            # Another path already answered this one: it counts as said to the assistant.
            past.appendleft(True)
            return None, "accept", "acted", 1.0, True, True, False, False
        gap = f["gap_s"]
        exchange = bool(past) and gap is not None and gap <= EXCHANGE_SECONDS \
            and past[0] is False

        def ignored(backs):
            return any(b <= len(past) and past[b - 1] is not True for b in backs)
        base = self.exchange_w if exchange else 0.0
        again_w, again_t = ignored(f["sounds_whole"]), ignored(f["sounds_tail"])
        p = _sigmoid(f["whole_logit"] + base + (self.retry_w if again_w else 0.0))
        named, audience, again = f["named_whole"], f["audience_whole"], again_w
        if f["tail_logit"] is not None and not math.isnan(f["tail_logit"]):
            tail = _sigmoid(f["tail_logit"] + base + (self.retry_w if again_t else 0.0))
            if tail > p:
                p, named, audience, again = tail, f["named_tail"], f["audience_tail"], again_t
        own, llm = f["own_voice"], f["llm_score"]
        vetoed = own is not None and own == own and own < s.own_voice_veto
        band, method, confidence = "ambiguous", "heuristic_default", p
        if named and not vetoed:
            band, method, confidence = "accept", "named", 1.0
        elif again and f["reliable"] and not vetoed:
            band, method, confidence = "accept", "retry", 1.0
        elif p >= s.accept or p < s.reject:
            band, method = ("accept" if p >= s.accept else "reject"), "heuristic"
        elif llm is not None and llm == llm:
            method, confidence = "llm", s.llm_weight * llm + (1.0 - s.llm_weight) * p
        accepted = confidence >= s.accept
        directed = True if accepted else (False if audience else None)
        past.appendleft(directed)
        return p, band, method, confidence, accepted, directed, exchange, again


def settle_verdict(exchange: Column, again_whole: Column, again_tail: Column,
                   s: SignalSettings = SignalSettings()) -> dict[str, Column]:
    """``VERDICT_TYPE`` of a row of facts, given what its episode looked like just before it."""
    weights = dict(s.weights)
    base = F.when(exchange, weights["human_exchange_in_progress"]).otherwise(0.0)

    def p(logit, again):
        return sigmoid(F.col(logit) + base + F.when(again, weights["retry_of_ignored"]).otherwise(0.0), 30.0)
    whole = p("whole_logit", again_whole)
    tail = F.when(F.col("tail_logit").isNotNull() & ~F.isnan("tail_logit"), p("tail_logit", again_tail))
    use_tail = is_true(tail > whole)

    def chosen(a, b):
        return F.when(use_tail, b).otherwise(a)
    again = chosen(again_whole, again_tail)
    done = decide(F.greatest(whole, tail), chosen(F.col("named_whole"), F.col("named_tail")), again,
                  F.col("reliable"), F.nanvl(F.col("own_voice"), F.lit(None).cast("double")),
                  F.nanvl(F.col("llm_score"), F.lit(None).cast("double")), s)
    directed = F.when(done["ai_intent"], True).when(chosen(F.col("audience_whole"), F.col("audience_tail")), False)
    acted = F.col("acted")

    def unless_acted(value, other):
        return F.when(acted, other).otherwise(value)
    return {"heuristic": F.when(~acted, F.greatest(whole, tail)),
            "band": unless_acted(done["band"], F.lit("accept")), "method": unless_acted(done["method"], F.lit("acted")),
            "confidence": unless_acted(done["confidence"], F.lit(1.0)),
            "ai_intent": unless_acted(done["ai_intent"], F.lit(True)),
            "ai_directed": unless_acted(directed, F.lit(True)),
            "human_exchange": ~acted & exchange, "retry": ~acted & again}


def score_conversations(df: DataFrame, settings: SignalSettings = SignalSettings()) -> DataFrame:
    """User rows with the verdict each would have got, in order, inside its conversation.

    Each row's verdict is worked out for all eight cases of what may have come before (an exchange
    with somebody going on, the whole or the tail not answered before); ``chain`` finds the case.
    """
    d = prepare(df, settings)
    keep = d.columns
    cases = [settle_verdict(F.lit(bool(k & 4)), F.lit(bool(k & 2)), F.lit(bool(k & 1)), settings)["ai_directed"]
             for k in range(8)]
    code = total([F.when(c, chain.YES).when(~c, chain.NO).otherwise(chain.OPEN) * 3 ** k for k, c in enumerate(cases)])

    def mask(backs):
        bit = F.array(*[F.lit(1 << k) for k in range(RETRY_DEPTH)])
        return F.aggregate(backs, F.lit(0), lambda acc, b: acc.bitwiseOR(F.get(bit, b - 1)))
    d = d.withColumns({
        "near": is_true(F.col("gap_s") <= EXCHANGE_SECONDS), "whole": mask("sounds_whole"), "tail": mask("sounds_tail"),
        "outcomes": code.cast("int"), "place": F.col("upos").cast("long"),
        "piece": F.floor(F.col("upos") / chain.PIECE).cast("long")})
    # Scored once: the scan reads a few numbers of each row, the verdicts read the rest.
    d = cut_lineage(d)
    episode = [*KEYS, "episode"]
    starts = chain.piece_starts(chain.piece_maps(d, episode), episode)
    found = chain.settled_flags(d, starts, episode)
    verdicts = settle_verdict(*[F.col(f"__{n}") for n in chain.FLAGS], settings)
    found = found.withColumnsRenamed({n: f"__{n}" for n in chain.FLAGS})
    return found.select(*[c for c in keep if c not in FACTS], *[v.alias(n) for n, v in verdicts.items()])


# -- the second opinion, prepared and read back -------------------------------------------

SETTING_TEXT = {
    "others": "There is a conversation with other people going on around the speaker; assume "
              "a sentence was for a person unless there is a reason to think otherwise.",
    "solo": "Nobody else has been heard; a sentence that carries on a recent exchange is "
            "probably for the assistant.",
    "unknown": "It is not known whether anybody else is present.",
}
TIEBREAK_TEXT = {"cautious": "When you cannot tell, answer 4 or lower.",
                 "balanced": "When you cannot tell, answer 4 or 5."}


#: What speaks for either side, and how sure to be: the judge's criteria.
FOR_ASSISTANT = (
    "it wants a fact that no one in the room would be likely to know",
    "only a machine could do what it asks, such as timing, reckoning or starting a program",
    "it picks up what {name} said a moment ago")
FOR_PERSON = (
    "the speaker was already talking with someone and this goes on from there",
    "it is about something they mean to do together",
    "someone would have to use their hands for it",
    "it tells of, or asks about, a person's own life or views",
    "its subject is someone spoken of as he, she or they")
CAUTIONS = (
    "A question may be for anyone; that it is one decides nothing.",
    "The word {name} can be a name or a plain word; inside a sentence it need not be a call.",
    "Where you waver, say so with a digit from the middle rather than choose a side.")


def criteria_text(name: str) -> str:
    """The criteria as two lists and the cautions."""
    def listed(head, items):
        return "\n".join([head, *[f"- {i}" for i in items]])
    return "\n\n".join([
        listed(f"Signs that it was for {name}:", FOR_ASSISTANT), listed("Signs that it was for a person:", FOR_PERSON),
        "\n".join(CAUTIONS)]).replace("{name}", name)


def adjudication_requests(scored: DataFrame, name: str = V.DEFAULT_NAME) -> DataFrame:
    """Ambiguous rows only, with the prompt a second opinion would be asked.

    ``scored`` comes from ``score_conversations``: the room is described from
    the last six verdicts and the context lines carry what each was.
    """
    said = F.struct("text", "ai_directed")
    d = _lookback(scored, "upos", {"__six": said}, 6).where("band = 'ambiguous'")

    def verdicts(value):
        return F.size(F.filter("__six", lambda u: is_true(u["ai_directed"] == F.lit(value))))
    others = verdicts(False) > 0
    setting = F.when(others, "others").when(verdicts(True) >= 2, "solo").otherwise("unknown")
    tiebreak = F.when(~others & (verdicts(True) >= 2), "balanced").otherwise("cautious")
    last3 = F.slice("__six", F.greatest(F.size("__six") - 3, F.lit(0)) + 1, F.lit(3))
    lines = F.transform(
        F.filter(last3, lambda u: T.strip(u["text"]) != T.strip(F.col("text"))),
        lambda u: F.concat(
            F.lit("- earlier, "),
            F.when(u["ai_directed"], "to the assistant")
            .when(~u["ai_directed"], "to someone else").otherwise("unclear who to"),
            F.lit(': "'), T.strip(u["text"]), F.lit('"')))
    age = since_ai(F.col("at_s"), F.col("last_ai_at"))
    spoke = F.when((F.length("last_ai_text") > 0) & (age < 60), F.array(F.concat(
        F.lit("- the assistant said "), F.format_string("%.0f", age), F.lit('s ago: "'),
        T.strip(F.col("last_ai_text")), F.lit('"')))).otherwise(F.array().cast("array<string>"))
    history = F.array_join(F.concat(lines, spoke), "\n")
    look = F.create_map(*[F.lit(x) for kv in SETTING_TEXT.items() for x in kv])
    tie = F.create_map(*[F.lit(x) for kv in TIEBREAK_TEXT.items() for x in kv])
    return d.withColumns({
        "setting": setting, "tiebreak": tiebreak, "context_lines": F.concat(lines, spoke)}) \
        .withColumn("system_prompt", F.concat_ws(
            "\n\n", F.lit(f"Judge whether a spoken sentence was for the assistant {name}."),
            look[F.col("setting")], F.lit(criteria_text(name)), tie[F.col("tiebreak")],
            F.lit("Answer with one digit: 0 is certainly a person, 9 is certainly the "
                  "assistant."))) \
        .withColumn("user_prompt", F.concat(
            F.lit("Context:\n"),
            F.when(history == "", "- (no recent context)").otherwise(history),
            F.lit('\n\nSentence just spoken: "'), T.strip(F.col("text")),
            F.lit('"\n\nDigit:'))).drop("__six")


def read_adjudication(reply) -> tuple:
    """(score column, error column) from a reply: its first digit over nine."""
    digit = F.regexp_extract(F.coalesce(reply, F.lit("")), "[0-9]", 0)
    score = F.when(digit != "", digit.try_cast("int") / 9.0)
    error = F.when(digit == "", F.concat(F.lit("no digit in "), F.substring(
        F.coalesce(reply, F.lit("")), 1, 40)))
    return score, error

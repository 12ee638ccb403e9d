"""Safety tables of the gate and the router, policy, splits and training."""

import random

import pytest
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.operators import gate as G
from whofor.operators import policy as P
from whofor.operators import router as R
from whofor.operators import splits as S
from whofor.operators.catalogue import CORE, Catalogue

N = len(V.FEATURE_NAMES)
MODEL = G.GateModel((0.0,) * N, -3.0, (0.0,) * N, (1.0,) * N, 0.4)
COLD = dict(dict.fromkeys(V.FEATURE_NAMES, 0.0), voiced_ratio=0.5, duration=3.0, p_own=0.5,
            vad_confidence=0.95, is_wearer=0.5, since_ai_log=20.0, ignored_run=2.0)


def decide(spark, mode="skip", model=MODEL, protect=True, **changes):
    d = spark.createDataFrame([tuple(float(v) for v in {**COLD, **changes}.values())],
                              ", ".join(f"{n} double" for n in COLD))
    return G.gate_decide(d, G.context_from_features(), mode, model, model is not None,
                         protect).first()


def test_learned_skip_and_what_forbids_it(spark):
    assert decide(spark)["skip"]
    for why, change in {"asked": {"awaiting_answer": 1.0}, "confirmation": {"confirming": 1.0},
                        "offer": {"offer_pending": 1.0}, "follow-up": {"since_ai_log": 1.0},
                        "enrolled": {"voice_confident": 1.0, "is_wearer": 1.0},
                        "voiced": {"voiced_ratio": 0.0},
                        "non-finite": {"f0_mean": float("nan")}}.items():
        r = decide(spark, **change)
        assert not r["would_skip"] and why in r["reason"], why
    assert decide(spark, protect=False, voice_confident=1.0, is_wearer=1.0)["would_skip"]


def test_no_threshold_and_shadow_never_skip(spark):
    from dataclasses import replace
    r = decide(spark, model=replace(MODEL, threshold=None))
    assert not r["would_skip"] and "threshold" in r["reason"]
    r = decide(spark, mode="shadow")
    assert r["would_skip"] and not r["skip"]
    assert not decide(spark, mode="off")["skip"]


def test_threshold_budgets(spark):
    rows = list(zip([0.05, 0.1, 0.2, 0.3, 0.6, 0.02, 0.9], [True] * 5 + [False] * 2,
                    [True, True, False, True, True, True, True]))
    d = spark.createDataFrame(rows, "p double, y boolean, may boolean")
    for budget, want in ((0.0, 0.05), (0.2, 0.1), (0.9, 0.5)):
        got = G.choose_threshold(d, F.col("p"), F.col("may"), F.col("y"), budget).first()[0]
        assert got == want


def predictions(spark, cases):
    rows = []
    for i, (who, intent, p, slots) in enumerate(cases):
        rest = (1 - p) / (len(CORE.names) - 1)
        rows.append((i, {V.ASSISTANT: who, V.HUMAN: (1 - who) / 2, V.MEDIA: (1 - who) / 2},
                     {n: (p if n == intent else rest) for n in CORE.names}, slots or {}))
    return spark.createDataFrame(rows, "i int, addressed map<string,double>, "
                                       "intents map<string,double>, slot_probs map<string,map<string,double>>")


OPEN = R.Thresholds(0.2, 0.8, 0.8, 0.8)


def routes(spark, cases, t=OPEN, cat=CORE, **state):
    s = R.StateColumns(**{k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))
                          for k, v in state.items()})
    return [r["route"] for r in R.route(predictions(spark, cases), t, cat, s).orderBy("i").collect()]


def test_router_rules(spark):
    assert routes(spark, [(0.01, "stop", 0.95, None), (0.999, "stop", 0.999, None)],
                  R.Thresholds()) == ["escalate"] * 2
    assert routes(spark, [(0.05, "stop", 0.95, None), (0.95, "stop", 0.95, None),
                          (0.95, "open_request", 0.99, None), (0.95, "stop", 0.6, None),
                          (0.7, "stop", 0.99, None), (0.95, "confirm.yes", 0.97, None),
                          (0.95, "timer.cancel", 0.97, None)]) == \
        ["ignore", "act", "escalate", "escalate", "escalate", "escalate", "escalate"]
    for state in ({"since_ai": 3.0}, {"awaiting_answer": True}, {"confirming": True}):
        assert routes(spark, [(0.05, "stop", 0.95, None)], **state) == ["escalate"]
    assert routes(spark, [(0.95, "confirm.yes", 0.97, None)], awaiting_answer=True) == ["act"]
    assert routes(spark, [(0.95, "timer.cancel", 0.97, None)], active=["timer_running"]) == ["act"]


def test_router_slots_and_confidence(spark):
    zero = {str(v): 0.0 for v in V.TIMER_DURATIONS}
    key = "timer.set:duration"
    cases = [(0.95, "timer.set", 0.95, {key: {**zero, "420": 0.95}}),
             (0.95, "timer.set", 0.95, {key: {**zero, V.OTHER: 0.95}}),
             (0.95, "timer.set", 0.95, {key: {**zero, "420": 0.5, "480": 0.5}}),
             (0.95, "timer.set", 0.95, None)]
    assert routes(spark, cases) == ["act", "escalate", "escalate", "escalate"]
    strict = CORE.extended(Catalogue.of([{"name": "stop", "min_confidence": 0.99}]))
    d = [(0.95, "stop", 0.95, None), (0.95, "stop", 0.995, None)]
    assert routes(spark, d, cat=strict) == ["escalate", "act"]
    t = OPEN.tighten(R.Thresholds(ignore_below=0.4, act_intent=0.5))
    assert (t.act_intent, t.ignore_below) == (0.8, 0.2)


def test_provenance(spark):
    cols = "source string, license string, consent string"
    rows = [("ami", "", ""), ("common_voice", None, None), ("custom", "CC-BY-NC-4.0", ""),
            ("ami", "CC0-1.0", ""), ("consented", "", ""), ("some_podcast", "", ""),
            ("custom", "CC-BY-4.0", ""), ("consented", "", "Release ")]
    got = P.resolve_provenance(spark.createDataFrame(rows, cols)).collect()
    assert [r["p_license"] for r in got] == ["CC-BY-4.0", "CC0-1.0", None, None, None, None,
                                             "CC-BY-4.0", "consent"]
    assert [r["refusal"] is None for r in got] == [True, True, False, False, False, False, True, True]
    d = spark.createDataFrame([("synthetic_say", "", ""), ("ami", "CC-BY-4.0", ""),
                               ("shadow_log", "none", ""), ("consented", "consent", "release"),
                               ("consented", "consent", "")], cols)
    assert [r[0] for r in d.select(P.row_trainable()).collect()] == [False, True, False, True, False]
    assert [r[0] for r in d.select(P.row_trainable(True)).collect()] == [True, True, False, True, False]


# -- splits ------------------------------------------------------------------------------------------

def greedy(sizes, fractions):
    """The rule applied to one component at a time."""
    total = sum(s * n for s, n in sizes)
    targets, filled = [f * total for f in fractions], [0.0] * len(fractions)
    out = {}
    for size, n in sorted(sizes, reverse=True):
        take = [0] * len(fractions)
        for _ in range(n):
            k = max(range(len(fractions)), key=lambda s: (targets[s] - filled[s]) / targets[s])
            take[k] += 1
            filled[k] += size
        out[size] = take
    return out


def test_dealing_in_bulk_equals_dealing_one_by_one():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [(s, rng.choice([1, 3, 40, 1500, 9000])) for s in rng.sample(range(1, 60), 6)]
        total = sum(s * n for s, n in sizes)
        got, want = S.deal(sizes, total, (0.6, 0.2, 0.2)), greedy(sizes, (0.6, 0.2, 0.2))
        assert all(sum(got[s]) == n for s, n in sizes)
        # Two splits can be equally in need; which goes first then is rounding noise, so the
        # rows dealt to a split may differ by a component of each size and no more.
        for k in range(3):
            a, b = (sum(s * d[s][k] for s in d) for d in (got, want))
            assert abs(a - b) <= sum(s for s, _ in sizes)


def test_a_long_chain_is_one_component(spark):
    rows = [(i, f"p{i}+p{i + 1}", "", "") for i in range(150)] + [(500, "", "", ""), (501, "", "", "")]
    d = spark.createDataFrame(rows, "row_id long, speaker string, session string, room string")
    got = S.row_components(d, ["speaker", "session", "room"], "row_id") \
        .groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [1, 1, 150]


def test_split_is_disjoint_with_a_hot_session(spark):
    rows = [(i, f"s{i % 200}", f"x{i % 40}" if i % 3 else "hot", "") for i in range(1200)]
    rows += [(9000 + i, "a+b" if i == 0 else "ab"[i % 2], "", "") for i in range(4)]
    d = spark.createDataFrame(rows, "row_id long, speaker string, session string, room string")
    out = S.group_split(d, ("speaker",)).cache()
    assert out.count() == len(rows) and S.check_disjoint(out, ("speaker",)).count() == 0
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(counts[0] / len(rows) - 0.6) < 0.02 and set(counts) == {0, 1, 2}
    assert out.where("row_id >= 9000").select("split").distinct().count() == 1


def test_train_gate_end_to_end(spark):
    from whofor.plans.gate_training import GateTraining, train_gate
    rng = random.Random(0)
    rows = []
    for i in range(600):
        label = rng.choices(V.GATE_LABELS, [0.3, 0.35, 0.3, 0.05])[0]
        mine = label == V.ASSISTANT
        f = {**COLD, "duration": max(0.4, rng.gauss(2 if mine else 5, 1)),
             "vad_confidence": rng.uniform(0.9 if mine else 0.6, 1.0),
             "ignored_run": float(rng.randrange(2 if mine else 5)), "since_ai_log": 8.1887}
        rows.append((i, label, "ami", "CC-BY-4.0", "", f"k{i % 60}", f"x{i % 45}", "", "m",
                     *[float(f[n]) for n in V.FEATURE_NAMES]))
    d = spark.createDataFrame(rows, "row_id long, label string, source string, license string, "
                                    "consent string, speaker string, session string, room string, mic string, "
                                    + ", ".join(f"{n} double" for n in V.FEATURE_NAMES))
    r = train_gate(d, GateTraining(max_false_skip=0.05, group_by=("speaker",), ignore_uncertain=True))
    head = {(x["split"], x["layer"]): x for x in r.headline.collect()}
    assert head[("select", "model")]["false_skip_rate"] <= 0.05
    assert 0 < r.model.threshold <= 0.5
    with pytest.raises(ValueError):
        train_gate(d.withColumn("source", F.lit("shadow_log")), GateTraining())

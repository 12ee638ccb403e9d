"""Sequential operators against a loop over the whole stream, and stream against batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from whofor.operators import conversation as CV
from whofor.operators import frames as E
from whofor.operators.shadow import gate_turns
from whofor.operators.signals import SignalSettings
from whofor.streaming import twins

CFG = E.SegmentSettings(min_speech_ms=96, min_silence_ms=160, min_segment_ms=64,
                        max_segment_ms=1600, preroll_s=0.13)


def frame_rows(seed=0):
    rng = random.Random(seed)
    rows = []
    for stream, n in ((1, 2500), (2, 120), (3, 7)):
        p, i = 0.1, 0
        while i < n:
            run, p = rng.choice([1, 2, 4, 9, 30, 70]), rng.choice([0.1, 0.9, 0.7])
            for _ in range(min(run, n - i)):
                rows.append((stream, i, i * 0.032, p + rng.random() / 20))
                i += 1
    return rows


def test_segments_equal_one_pass_over_each_stream(spark):
    rows = frame_rows()
    d = spark.createDataFrame(rows, "stream_id long, frame_idx long, at_s double, prob double")
    got = sorted(tuple(r) for r in E.detect_segments(d, CFG).collect())
    want, states = [], {}
    for sid, _, at, p in rows:
        done = E.advance(states.setdefault(sid, E.SegmentState()), CFG, at, p)
        if done is not None:
            want.append((sid, *done))
    assert len(want) > 20 and any(w[-1] for w in want)
    assert [g[:4] for g in got] == [pytest.approx(w[:4]) for w in sorted(want)]
    assert [g[-1] for g in got] == [w[-1] for w in sorted(want)]
    assert [tuple(g[4:6]) for g in got] == [pytest.approx(w[4:6]) for w in sorted(want)]
    assert E.islands(d, CFG).select("stream_id", "island").distinct().count() > 10


@pytest.mark.parametrize("cfg", [
    E.SegmentSettings(min_speech_ms=96, min_silence_ms=160, min_segment_ms=64, max_segment_ms=640, preroll_s=0.4),
    E.SegmentSettings(min_speech_ms=32, min_silence_ms=64, min_segment_ms=0, max_segment_ms=200, preroll_s=0.0),
    E.SegmentSettings(min_speech_ms=64, min_silence_ms=96, min_segment_ms=32, max_segment_ms=160, preroll_s=0.3)])
def test_a_stretch_without_silence_is_split(spark, cfg):
    """Fifty full segments in a row and more, with pauses too short to close one."""
    rng = random.Random(6)
    rows = [(1, i, i * 0.032, 0.2 if rng.random() < 0.04 else 0.9) for i in range(1500)]
    rows += [(2, i, i * 0.032, 0.9 if rng.random() < 0.8 else 0.1) for i in range(700)]
    rows += [(3, i, i * 0.032, rng.choice([0.1, 0.9])) for i in range(600)]
    d = spark.createDataFrame(rows, "stream_id long, frame_idx long, at_s double, prob double").repartition(4)
    want, states = [], {}
    for sid, _, at, p in rows:
        done = E.advance(states.setdefault(sid, E.SegmentState()), cfg, at, p)
        if done is not None:
            want.append((sid, *done))
    got = sorted(tuple(r) for r in E.detect_segments(d, cfg).collect())
    assert len(want) > 50 and [g[-1] for g in got] == [w[-1] for w in sorted(want)]
    assert [g[:-1] for g in got] == [pytest.approx(w[:-1]) for w in sorted(want)]


def test_energy_activity_equals_numpy(spark):
    rng = np.random.default_rng(2)
    levels = np.abs(rng.normal(0.01, 0.01, 450))
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(levels)],
                              "stream_id long, frame_idx long, rms double")
    got = [r["prob"] for r in E.energy_vad(d).orderBy("frame_idx").collect()]
    for i, v in enumerate(levels + 1e-9):
        seen = (levels + 1e-9)[max(0, i - 99):i + 1]
        noise = 1e-3 if len(seen) < 10 else max(np.percentile(seen, 20), 1e-5)
        p = np.clip((np.log10(v / (noise * 3) + 1e-9) + 0.5) / 1.2, 0, 1)
        assert got[i] == pytest.approx(p, abs=1e-9)


LINES = ["Nova, stop", "what time is it?", "he said it was closed", "let's go to the beach",
         "turn it up", "turn it up a bit", "yeah", "can you pass me that cup", "set a timer",
         "we should eat soon. what is the capital of Peru?", "make it ten instead", "make it ten"]


def talk(seed=1, convs=4):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        t = 0.0
        for k in range(250 if c == 0 else 30):
            t += rng.choice([2.0, 6.0, 14.0, 40.0])
            ai = rng.random() < 0.2
            rows.append((c, t, k, "assistant" if ai else "user",
                         "shall I go on?" if ai else rng.choice(LINES), rng.random() > 0.1,
                         rng.choice([None, 0.2, 0.9]), rng.choice([None, 0.1, 0.9]), False))
    return rows


TALK = ("conv_id long, at_s double, turn long, role string, text string, reliable boolean, "
        "own_voice double, llm_score double, driving boolean")


def verdicts_by_loop(facts):
    """One chain per conversation, from scratch: ages are looked up, episodes ignored."""
    s, out, history = SignalSettings(), {}, {}
    for f in sorted(facts, key=lambda r: (r["conv_id"], r["upos"])):
        past = history.setdefault(f["conv_id"], [])
        f = f.asDict()
        f["sounds_whole"] = [b for b in f["sounds_whole"]]
        chain = CV.VerdictChain(s, [v for v, _ in reversed(past[-4:])])
        out[(f["conv_id"], f["upos"])] = chain.next(f)[:6]
        past.append((chain.recent[0], f["at_s"]))
    return out


def test_episodes_do_not_change_a_verdict(spark):
    d = spark.createDataFrame(talk(), TALK)
    facts = CV.prepare(d).collect()
    want = verdicts_by_loop(facts)
    got = CV.score_conversations(d).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[(r["conv_id"], r["upos"])]
        assert (r["band"], r["method"], r["ai_intent"], r["ai_directed"]) == (w[1], w[2], w[4], w[5])
    assert any(r["retry"] for r in got) and any(r["human_exchange"] for r in got)


@pytest.mark.parametrize("piece", [1, 7, 256])
def test_an_episode_without_quiet_is_read_in_pieces(spark, piece, monkeypatch):
    """Every field of every verdict equals one chain over the whole conversation."""
    monkeypatch.setattr(CV.chain, "PIECE", piece)
    rng, rows = random.Random(5), []
    for c in range(3):
        for k in range(300 if c == 0 else 9):
            rows.append((c, k * rng.choice([1.0, 2.0]) / 2 + k, k, "user", rng.choice(LINES), rng.random() > 0.1,
                         rng.choice([None, 0.2, 0.9]), rng.choice([None, 0.1, 0.9]), False))
    d = spark.createDataFrame(rows, TALK).withColumn("acted", F.col("turn") % 17 == 3)
    facts = CV.prepare(d).collect()
    assert len({(f["conv_id"], f["episode"]) for f in facts}) == 3
    want, chains = {}, {}
    for f in sorted(facts, key=lambda r: (r["conv_id"], r["upos"])):
        want[(f["conv_id"], f["upos"])] = chains.setdefault(f["conv_id"], CV.VerdictChain(SignalSettings())).next(f.asDict())
    got = CV.score_conversations(d).collect()
    assert len(got) == len(want)
    names = [c.split()[0] for c in CV.VERDICT_TYPE.split(", ")]
    for r in got:
        for name, value in zip(names, want[(r["conv_id"], r["upos"])]):
            assert r[name] == (pytest.approx(value) if isinstance(value, float) else value), name
    assert any(r["retry"] for r in got) and any(r["human_exchange"] for r in got) and any(r["method"] == "acted" for r in got)


def test_an_assistant_that_never_spoke_is_not_recent(spark):
    """Nothing said is no follow-up: the pronoun rule and the follow-up bonus stay silent."""
    from whofor.operators import context as X
    rows = [(1, 5.0, 0, "user", "she told me it was closed", True, None, None, False),
            (2, 4.0, 0, "assistant", "done", True, None, None, False),
            (2, 5.0, 1, "user", "she told me it was closed", True, None, None, False)]
    d = spark.createDataFrame(rows, TALK)
    since = {r["conv_id"]: r["s"] for r in X.users(d).select(
        "conv_id", X.since_ai(F.col("at_s"), F.col("last_ai_at")).alias("s")).collect()}
    assert since == {1: 1e9, 2: 1.0}
    got = {r["conv_id"]: r["heuristic"] for r in CV.score_conversations(d).collect()}
    assert got[1] < got[2]


def test_retry_and_exchange_rules(spark):
    rows = [(1, 0.0, 0, "user", "turn on the lamp over there", True, None, None, False),
            (1, 5.0, 1, "user", "turn on the lamp over there", True, None, None, False),
            (2, 0.0, 0, "user", "let's go, she said it was fine", True, None, None, False),
            (2, 9.0, 1, "user", "the lamp is on", True, None, None, False),
            (2, 60.0, 2, "user", "the lamp is on again now", True, None, None, False)]
    got = {(r["conv_id"], r["turn"]): r for r in
           CV.score_conversations(spark.createDataFrame(rows, TALK)).collect()}
    assert not got[(1, 0)]["ai_intent"] and got[(1, 1)]["method"] == "retry"
    assert got[(2, 0)]["ai_directed"] is False and got[(2, 1)]["human_exchange"]
    assert got[(2, 1)]["ai_directed"] is None and not got[(2, 2)]["human_exchange"]


def test_second_opinion_requests(spark):
    d = spark.createDataFrame(talk(3, 2), TALK).withColumn("llm_score", F.lit(None).cast("double"))
    rows = CV.adjudication_requests(CV.score_conversations(d)).collect()
    assert rows and {r["setting"] for r in rows} <= {"others", "solo", "unknown"}
    assert all(r["user_prompt"].endswith("Digit:") for r in rows)
    for r in rows:
        asked = r["system_prompt"]
        assert asked.count("\n- ") == len(CV.FOR_ASSISTANT) + len(CV.FOR_PERSON) and "{name}" not in asked
        assert CV.SETTING_TEXT[r["setting"]] in asked and CV.TIEBREAK_TEXT[r["tiebreak"]] in asked


def run_stream(spark, tmp_path, df, build, name, order=None, files=3):
    """Feed ``df`` as a few files, in order, and return what the stream emits."""
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    parts = df.orderBy(*order) if order else df
    rows = parts.collect()
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size:(k + 1) * size], df.schema).coalesce(1) \
            .write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (build(stream).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_segments_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(40):
        loud = rng.random() < 0.5
        for _ in range(rng.choice([5, 20, 40])):
            rows.append((1, i, i * 0.032, 0.2 if loud else 0.002 + rng.random() / 1000))
            i += 1
    d = spark.createDataFrame(rows, "stream_id long, frame_idx long, at_s double, rms double")
    want = sorted(tuple(r) for r in E.detect_segments(E.energy_vad(d), CFG).collect())
    got = sorted(tuple(r) for r in run_stream(
        spark, tmp_path, d, lambda s: twins.stream_segments(s, CFG), "segs", ["frame_idx"]))
    assert len(want) > 3 and [g[:4] for g in got] == [pytest.approx(w[:4]) for w in want]


def test_streamed_verdicts_equal_batch(spark, tmp_path):
    d = spark.createDataFrame(talk(7, 2), TALK)
    facts = CV.prepare(d).select("conv_id", "upos", *CV.FACTS)
    want = {(r["conv_id"], r["upos"]): r["method"] for r in CV.score_conversations(d).collect()}
    got = run_stream(spark, tmp_path, facts, twins.stream_verdicts, "verdicts", ["upos"])
    assert {(r["conv_id"], r["upos"]): r["method"] for r in got} == want


def test_streamed_turns_equal_batch(spark, tmp_path):
    rows = []
    for k in range(40):
        rows.append((f"t{k}", k * 30, 1, "gate_scored", k % 2 == 0, float(k), 1.0, None))
        e = ["intent_accepted", "intent_ignored", "transcript_rejected", "segment_dropped", None][k % 5]
        if e:
            rows.append((f"t{k}", k * 30 + 1, 2, e, None, None, None, "gate" if k % 2 else "other"))
    rows.append(("late", 90000, 1, "gate_scored", False, 1.0, 1.0, None))
    rows.append(("later", 180000, 1, "gate_scored", False, 1.0, 1.0, None))
    d = spark.createDataFrame(rows, "turn string, s long, ord int, event string, would_skip boolean, "
                                    "latency_ms double, feature_ms double, reason string") \
        .withColumn("ts", F.timestamp_seconds("s"))
    want = {r["turn"]: r["verdict"] for r in gate_turns(
        d, ["ts", "ord"], ["would_skip", "latency_ms", "feature_ms"]).collect()}
    got = run_stream(spark, tmp_path, d, twins.stream_gate_turns, "turns", ["ts", "ord"])
    got = {r["turn"]: r["verdict"] for r in got}
    assert len(got) >= 40 and all(want[t] == v for t, v in got.items())


def test_live_totals_stream(spark, tmp_path):
    d = spark.createDataFrame([("act", "agree"), ("ignore", "s1_would_miss"), ("escalate", "escalated")] * 5,
                              "route string, agreement string")
    d.write.parquet(str(tmp_path / "in"))
    seen = []
    q = twins.stream_live_stats(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")),
                                lambda f, i: seen.extend(f.collect())) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert (seen[-1]["utterances"], seen[-1]["decided_fast"], seen[-1]["agreed"]) == (15, 10, 5)


def test_overheard_looks_through_dense_speech(spark):
    """Sixty remarks within three minutes: the buffer holds forty, a larger one holds all."""
    from whofor.operators import context as X
    rows = [("c", i, "user", f"remark number {i}", float(i), i >= 5, True) for i in range(60)]
    rows.append(("c", 60, "user", "and now", 60.0, False, True))
    d = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, at_s double, "
                                    "ai_directed boolean, reliable boolean")
    def last(**more):
        return X.overheard(d, **more).where("turn = 60").first()["overheard"]
    assert last() == [] and last(keep=100) == [f"remark number {i}" for i in range(1, 5)]


def test_shuffled_turn_events_equal_batch(spark, tmp_path):
    """Events of a turn come in any order across micro-batches; verdicts alone go to the side table."""
    import random
    rows = []
    for k in range(24):
        rows += [(f"t{k}", 10 + k, 1, "gate_scored", False, 1.0, 1.0, None),
                 (f"t{k}", 12 + k, 1, "gate_scored", True, 2.0, 1.0, None),
                 (f"t{k}", 14 + k, 1, "intent_accepted", None, None, None, None),
                 (f"t{k}", 14 + k, 2 if k % 2 else 0, "intent_ignored", None, None, None, None)]
    rows.append(("alone", 20, 1, "intent_accepted", None, None, None, None))
    random.Random(4).shuffle(rows)
    rows += [("far", 90000, 1, "gate_scored", False, 1.0, 1.0, None), ("farther", 180000, 1, "gate_scored", False, 1.0, 1.0, None)]
    rows = [(*r, i) for i, r in enumerate(rows)]
    d = spark.createDataFrame(rows, "turn string, s long, ord int, event string, would_skip boolean, "
                                    "latency_ms double, feature_ms double, reason string, arrival int") \
        .withColumn("ts", F.timestamp_seconds("s"))
    want = {r["turn"]: (r["verdict"], r["latency_ms"]) for r in gate_turns(
        d, ["ts", "ord"], ["would_skip", "latency_ms", "feature_ms"]).collect()}
    got = run_stream(spark, tmp_path, d, twins.stream_gate_turns, "shuffled", ["arrival"])
    got = {r["turn"]: (r["verdict"], r["latency_ms"]) for r in got}
    assert len(got) >= 24 and all(want[t] == v for t, v in got.items())
    late = run_stream(spark, tmp_path / "late", d, twins.stream_late_verdicts, "lates", ["arrival"])
    assert [tuple(r) for r in late] == [("alone", "accepted")]


def shuffled_within(rows, at, reach, seed):
    """Rows moved forward or back in their order of arrival by less than ``reach`` seconds."""
    r = random.Random(seed)
    return sorted(rows, key=lambda x: at(x) + r.random() * reach)


def test_shuffled_verdicts_equal_batch(spark, tmp_path):
    d = spark.createDataFrame(talk(7, 3), TALK)
    facts = CV.prepare(d).select("conv_id", "upos", "at_s", *CV.FACTS)
    want = {(r["conv_id"], r["upos"]): r["method"] for r in CV.score_conversations(d).collect()}
    rows = shuffled_within(facts.collect(), lambda r: r["at_s"], 40.0, 3)
    ends = [r.asDict() | {"at_s": 1e6 + 1000 * k, "conv_id": 99, "upos": k} for k, r in enumerate(rows[:3])]
    full = spark.createDataFrame([*rows, *[tuple(e[c] for c in facts.columns) for e in ends]], facts.schema) \
        .withColumn("arrival", F.monotonically_increasing_id()).withColumn("ts", F.timestamp_seconds("at_s"))
    got = run_stream(spark, tmp_path, full, lambda s: twins.stream_verdicts(s, late="60 seconds"), "shuffled_verdicts",
                     ["arrival"], files=6)
    got = {(r["conv_id"], r["upos"]): r["method"] for r in got if r["conv_id"] != 99}
    assert got == want
    left = spark.read.format("statestore").option("stateVarName", "recent").load(str(tmp_path / "ck")).collect()
    assert {r["key"]["conv_id"] for r in left} <= {99}, "idle conversations leave the state"


def test_shuffled_frames_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(40):
        loud = rng.random() < 0.5
        for _ in range(rng.choice([5, 20, 40])):
            rows.append((1, i, i * 0.032, 0.2 if loud else 0.002 + rng.random() / 1000))
            i += 1
    d = spark.createDataFrame(rows, "stream_id long, frame_idx long, at_s double, rms double")
    want = sorted(tuple(r) for r in E.detect_segments(E.energy_vad(d), CFG).collect())
    rows = shuffled_within(rows, lambda r: r[2], 1.0, 5) + [(2, k, 1e5 + 1e5 * k, 0.1) for k in range(2)]
    d = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)],
                              "stream_id long, frame_idx long, at_s double, rms double, arrival long") \
        .withColumn("ts", F.timestamp_seconds(F.col("at_s") + 1000))
    got = sorted(tuple(r) for r in run_stream(spark, tmp_path, d, lambda s: twins.stream_segments(s, CFG, "2 seconds"),
                                              "shuffled_segs", ["arrival"], files=5))
    assert len(want) > 3 and [g[:4] for g in got] == [pytest.approx(w[:4]) for w in want]


def test_streamed_recent_latency_equals_batch(spark, tmp_path):
    from whofor.operators.shadow import recent_latency
    r = random.Random(9)
    rows = [(k, k, r.random() * 90) for k in range(900)]
    rows += rows[100:110]
    r.shuffle(rows)
    d = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "at long, row_id long, ms double, arrival long")
    got = run_stream(spark, tmp_path, d, lambda s: twins.stream_recent_latency(s, 200, 4), "latency", ["arrival"], files=4)
    want = recent_latency(d.dropDuplicates(["row_id"]), [F.desc("at")], "row_id").first()["p50_ms"]
    last = max(got, key=lambda x: (x["newest_at"], x["n"]))
    finals = [x["p50_ms"] for x in got if (x["n"], x["newest_at"]) == (200, 899)]
    assert (last["n"], last["newest_at"]) == (200, 899) and want in finals

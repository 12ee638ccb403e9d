"""Audio kernels against plain loops, files round trips, students on toy data."""

import json
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions import audio as A
from whofor.operators import clips as D
from whofor.operators import heads as H
from whofor.operators import metrics as Q
from whofor.operators import speakers as SP
from whofor.operators.catalogue import CORE
from whofor.plans import student_training as ST
from whofor.sources import events as EV
from whofor.sources import manifests as M
from whofor.sources import sessions as SS


def voice(seconds, f0=140.0, seed=0, level=0.1):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * A.RATE)) / A.RATE
    phase = 2 * np.pi * np.cumsum(f0 * (1 + 0.1 * np.sin(np.pi * t))) / A.RATE
    x = sum(np.sin(k * phase) / k for k in range(1, 8)) * (np.sin(9.4 * t) > -0.3)
    return (level * x + 0.005 * rng.standard_normal(t.size)).astype(np.float32)


def naive_prosody(x):
    """Frame by frame, with a direct correlation."""
    count = (x.size - 480) // 160
    f0, shape, energy = [], [], []
    hz = np.fft.rfftfreq(512, 1 / A.RATE)
    for i in range(max(0, count)):
        f = x[i * 160:i * 160 + 480].astype(np.float64)
        energy.append((f ** 2).mean())
        c = f - f.mean()
        e0 = float(c @ c)
        if e0 >= 1e-8:
            r = [float(c[:480 - k] @ c[k:]) / e0 for k in range(229)]
            k = 45 + int(np.argmax(r[45:229]))
            if r[k] >= 0.35:
                f0.append(A.RATE / k)
        p = np.abs(np.fft.rfft(f * np.hanning(480), 512)) ** 2
        if p.sum() >= 1e-8:
            edge = int(np.searchsorted(np.cumsum(p), 0.85 * p.sum()))
            shape.append((hz @ p / p.sum(), hz[min(edge, 256)],
                          p[hz < 1000].sum() / (p[hz >= 1000].sum() + 1e-8)))
    out = dict.fromkeys(V.PROSODY_NAMES, 0.0)
    out["zcr"] = float(np.mean(np.signbit(x)[1:] != np.signbit(x)[:-1]))
    if f0:
        q = max(1, len(f0) // 4)
        out.update(f0_mean=np.mean(f0), f0_std=np.std(f0), voiced_ratio=len(f0) / count)
        if len(f0) >= 4:
            out["f0_slope"] = (np.mean(f0[-q:]) - np.mean(f0[:q])) / max(1.0, np.mean(f0))
    if shape:
        m = np.mean(shape, axis=0)
        out.update(spectral_centroid=m[0], spectral_rolloff=m[1], spectral_tilt_log=np.log1p(m[2]))
    if energy and max(energy) > 1e-8:
        out["pause_before"] = int(np.argmax(np.array(energy) > 0.02 * max(energy))) * 160 / A.RATE
    return out


def test_prosody_equals_frame_by_frame():
    rng = np.random.default_rng(1)
    cases = [voice(0.5), voice(2.0, 210, 2), (0.1 * rng.standard_normal(8000)).astype(np.float32),
             np.zeros(8000, np.float32), np.concatenate([np.zeros(4000, np.float32), voice(0.5)])]
    for x in cases:
        got, want = A.prosody(x), naive_prosody(x)
        for n in V.PROSODY_NAMES:
            assert got[n] == pytest.approx(want[n], rel=1e-3, abs=1e-3), n
    assert A.prosody(np.zeros(100)) == dict.fromkeys(V.PROSODY_NAMES, 0.0)
    a, b = A.prosody(voice(1.0)), A.prosody(voice(1.0) * 0.05)
    assert all(a[n] == pytest.approx(b[n], rel=2e-3, abs=2e-3) for n in a)


def test_pooling_and_filterbanks(spark):
    x = (0.1 * np.sin(np.arange(24000) * 0.05)).astype(np.float32)
    v = D.logmel_vector(x)
    assert v.shape == (384,) and np.isfinite(v).all()
    np.testing.assert_allclose(D.logmel_vector(x * 0.1), v, atol=1e-3)
    assert np.isfinite(D.logmel_vector(np.zeros(100, np.float32))).all()
    assert A.fbank_frames(x).shape == (148, 80) and A.fbank_frames(np.zeros(10)).shape == (0, 80)
    frames = np.random.default_rng(0).normal(size=(11, 3))
    d = spark.createDataFrame([("a", t, [float(x) for x in f]) for t, f in enumerate(frames)],
                              "id string, t int, frame array<double>")
    got = D.pool_frames(d, 3, "stats_thirds").first()["vector"]
    np.testing.assert_allclose(got, A.pool(frames, "stats_thirds"), atol=1e-9)


def write_wav(path, x, rate=A.RATE, width=2, channels=1):
    full = {1: 127, 2: 32767, 4: 2147483000}[width]
    pcm = np.clip(x, -1, 1) * full
    data = (pcm + 128).astype("u1") if width == 1 else pcm.astype(f"<i{width}")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(np.repeat(data, channels).tobytes())


def test_gate_rows_from_a_manifest(spark, tmp_path):
    write_wav(tmp_path / "public.wav", voice(1.0))
    write_wav(tmp_path / "mine.wav", voice(2.0, seed=4), width=4, channels=2)
    write_wav(tmp_path / "slow.wav", voice(1.0), rate=8000)
    cols = ["row_number", "path", "label", "source", "license", "consent", "speaker", "session",
            "room", "mic", "start", "end", "since_ai", "awaiting_answer", "confirming",
            "offer_pending", "ignored_run", "accepted_recently", "p_own", "voice_confident",
            "is_wearer", "vad_confidence"]

    def row(n, name, label, source, license="", consent="", **kw):
        base = dict.fromkeys(cols, "")
        base.update(row_number=n, path=str(tmp_path / name), label=label, source=source,
                    license=license, consent=consent, **kw)
        return tuple(base[c] for c in cols)
    rows = [row(1, "public.wav", V.HUMAN, "ami"),
            row(2, "mine.wav", V.ASSISTANT, "consented", consent="release", start="0.2", end="1.8",
                since_ai="4", awaiting_answer="yes"),
            row(3, "public.wav", V.HUMAN, "custom", "CC-BY-NC-4.0"),
            row(4, "slow.wav", V.HUMAN, "ami"), row(5, "gone.wav", V.HUMAN, "ami"),
            row(6, "public.wav", "nobody", "ami")]
    m = spark.createDataFrame(rows, "row_number int, " + ", ".join(f"`{c}` string" for c in cols[1:]))
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))
    out = {r["row_number"]: r for r in D.build_gate_rows(m, files).collect()}
    assert [out[n]["error"] is None for n in range(1, 7)] == [True, True, False, False, False, False]
    assert out[2]["duration"] == pytest.approx(1.6, abs=0.01) and out[2]["awaiting_answer"] == 1.0
    gone = D.deletable_sources(D.build_gate_rows(m, files), m).collect()
    assert [r["path"].endswith("mine.wav") for r in gone] == [True]


def test_recipes_are_rebuilt_from_their_seed(spark):
    x = (0.3 * np.sin(np.arange(8000) * 0.03)).astype(np.float32)
    for seed in range(8):
        a, info = A.retake(x, seed, x)
        b, _ = A.retake(x, seed, x)
        assert np.isfinite(a).all() and np.abs(a).max() <= 1 and a.size > x.size and "level_db" in info
        np.testing.assert_array_equal(a, b)
        assert np.isfinite(A.noise_clip(seed)[0]).all()
    d = spark.createDataFrame([("x", V.HUMAN, "p"), ("y", V.ASSISTANT, "q")], "id string, g_addressed string, path string")
    rows = {r["id"]: r for r in D.expand_recipes(d, 2, noise=3).collect()}
    assert set(rows) == {"x", "x-a0", "x-a1", "y", "y-a0", "y-a1", "noise00-0000", "noise00-0001", "noise00-0002"}
    assert rows["y-a1"]["augment"]["babble"] == ["p"] and rows["y"]["augment"] is None


def test_clips_leave_a_worker_in_pieces(spark):
    """A batch of small rows becomes many clips or frames; they are not held together."""
    class Runs:
        """Stands for a table; keeps the function that its tasks would run."""
        def __init__(self, d):
            self.sparkSession, self.columns, self.schema = d.sparkSession, d.columns, d.schema

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            self.run = run
            return spark.createDataFrame([], schema)

    d = spark.createDataFrame([("x", None)], "id string, pcm array<float>")
    clip = np.sin(np.arange(4000) * 0.03).astype(np.float32)
    noise = pd.DataFrame({"id": [f"n{i}" for i in range(400)], "augment": None, "pcm": None,
                          "generate": [{"kind": "noise", "seed": i} for i in range(400)]})
    tones = pd.DataFrame({"id": [f"t{i}" for i in range(1200)], "pcm": [clip] * 1200})
    for job, batch, made in ((D.augment_clips, noise, "pcm"), (D.fbank_frames, tones, "frames")):
        held = Runs(d)
        job(held)
        size, ids = [], []
        for piece in held.run(iter([batch])):
            size.append(sum(sum(x.nbytes for x in v) if isinstance(v, list) else v.nbytes for v in piece[made]))
            ids += list(piece["id"])
        assert ids == list(batch["id"]) and len(size) > 2 and max(size) < D.PIECE_BYTES + (1 << 20)
    rows = D.fbank_frames(spark.createDataFrame([("t", clip.tolist())], d.schema)).orderBy("t").collect()
    np.testing.assert_allclose([r["frame"] for r in rows], A.fbank_frames(clip))


def test_specs(spark):
    specs = ["parakeet:org/m-110m@L8:stats_thirds", "logmel:64:stats", "gate:20"]
    d = spark.createDataFrame([(s,) for s in specs], "s string").withColumn("p", D.parse_spec(F.col("s")))
    got = [tuple(r["p"]) for r in d.collect()]
    assert got == [("parakeet", "org/m-110m", 8, "stats_thirds"), ("logmel", "64", None, "stats"),
                   ("gate", None, None, "stats")]
    back = d.select(D.format_spec(F.col("p.kind"), F.col("p.repo"), F.col("p.layers"), F.col("p.pooling")))
    assert [r[0] for r in back.collect()] == specs


# -- files -------------------------------------------------------------------------------------------

def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "path": "x.wav", "augment": {"seed": 1, "babble": ["b.wav", "/c.wav"]}}\n\n{"id": "b", "path": null}\n')
    d = M.read_manifest(spark, str(tmp_path / "m.jsonl"))
    rows = {r["id"]: r for r in M.absolute_paths(d).collect()}
    assert rows["a"]["path"] == f"{tmp_path}/x.wav"
    assert rows["a"]["augment"]["babble"] == [f"{tmp_path}/b.wav", "/c.wav"]
    M.write_manifest(d.select("id", "path", "start"), str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {"id": "b", "path": None, "start": None} in lines
    with pytest.raises(Exception):
        M.write_manifest(d.select("id", F.lit(float("nan")).alias("x")), str(tmp_path / "bad"))


def test_feature_rows_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(V.HUMAN, *[float(i) for i in range(20)])],
                              "label string, " + ", ".join(f"{n} double" for n in V.FEATURE_NAMES))
    M.write_feature_rows(d, str(tmp_path / "f"))
    r = M.read_feature_rows(spark, str(tmp_path / "f")).first()
    assert (r["label"], r["speaker"], r["offer_pending"]) == (V.HUMAN, "", 19.0)
    M.write_feature_rows(d.drop("zcr"), str(tmp_path / "g"))
    with pytest.raises(Exception, match="zcr"):
        M.read_feature_rows(spark, str(tmp_path / "g")).collect()


def test_event_log(spark, tmp_path):
    lines = [{"t": 1.0, "event": "gate_scored", "turn": "a", "would_skip": True, "latency_ms": 2.0},
             {"t": 2.0, "event": "slu_decided", "turn": "a", "route": "ignore", "latency_ms": {"system_one": 15.0},
              "addressed": {"value": V.HUMAN, "p": 0.9, "probs": {V.ASSISTANT: 0.05}}},
             {"t": 3.0, "event": "session_start"}]
    (tmp_path / "log").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    d = EV.read_event_log(spark, str(tmp_path / "log"))
    assert d.count() == 2
    one = EV.as_decisions(d.where("event = 'slu_decided'")).first()
    assert (one["ms"], one["p_assistant"]) == (15.0, 0.05)
    EV.write_event_log(d.withColumn("mono", F.col("t")), str(tmp_path / "out"), ["would_skip", "route"])
    assert EV.read_event_log(spark, str(tmp_path / "out")).count() == 2
    s = EV.read_event_log(spark, str(tmp_path / "log"), streaming=True)
    assert s.isStreaming


def test_sessions_and_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", V.HUMAN), ("b", V.ASSISTANT)], "id string, g_addressed string")
    vec = spark.createDataFrame([("a", [1.0], 0.0, "x:y/z@L1"), ("b", [2.0], 0.0, "x:y/z@L1"),
                                 ("a", [3.0], 0.0, "gate:20")], "id string, vector array<float>, encode_ms double, spec string")
    SS.write_session(rows, vec, {"session": "s1", "kind": "collect"}, str(tmp_path / "s1"))
    got = SS.list_sessions(SS.read_metadata(spark, str(tmp_path / "s1/session"))).first()
    assert got["rows"] == 2 and got["counts"] == {V.ASSISTANT: 1, V.HUMAN: 1}
    v = SS.load_vectors(spark, [str(tmp_path / "s1/vectors")], "x:y/z@L1")
    assert v.count() == 2
    with pytest.raises(ValueError, match="one encoder"):
        SS.load_vectors(spark, [str(tmp_path / "s1/vectors")])


# -- students -----------------------------------------------------------------------------------------

def toy(spark, n=600):
    rng = np.random.default_rng(1)
    kinds = [(V.ASSISTANT, "stop", {}), (V.ASSISTANT, "time.now", {}),
             (V.ASSISTANT, "timer.set", {"duration": "420"}), (V.ASSISTANT, V.OPEN_REQUEST, {}),
             (V.HUMAN, None, {}), (V.MEDIA, None, {})]
    rows, vecs = [], []
    for k in range(n):
        who, intent, slots = kinds[k % 6]
        x = rng.standard_normal(12) * 0.3
        x[k % 6] += 3.0
        vecs.append((f"r{k}", [float(v) for v in x], 1.0, 0, "logmel:64:stats"))
        rows.append((f"r{k}", f"s{k % 15}", who, intent, slots, "noise", "CC0-1.0", "", "toy",
                     {a: 0.9 if a == who else 0.05 for a in V.ADDRESSEES}, who == V.ASSISTANT,
                     intent or V.OPEN_REQUEST, 1.0, slots, None, 50.0))
    r = spark.createDataFrame(rows, "id string, speaker string, g_addressed string, g_intent string, "
                              "g_slots map<string,string>, source string, license string, consent string, category string, "
                              "t_addressed map<string,double>, t_accept boolean, t_intent string, t_intent_p double, "
                              "t_slots map<string,string>, t_intent_probs map<string,double>, stt_ms double")
    return r, spark.createDataFrame(vecs, "id string, vector array<float>, encode_ms double, seq int, spec string")


def test_student_learns_within_budgets(spark):
    rows, vecs = toy(spark)
    r = ST.train_student(rows, vecs, ST.StudentTraining(targets="teacher", max_iter=20, max_wrong_act=0.1,
                                                        max_false_activation=0.1))
    rep = r.report.first()
    assert rep["addressed_accuracy"] > 0.95 and rep["intent_accuracy"] > 0.95 and rep["addressed_auc"] > 0.95
    assert rep["false_ignore_rate"] <= 0.05 and rep["false_activation_rate"] <= 0.1
    assert rep["stt_avoided"] > 0.3 and r.holdout_ids.count() == rep["rows"]
    table = H.model_table(spark, r.model)
    assert H.model_problems(table).count() == 0
    again = H.load_heads(table, r.model.temperatures)
    x = np.ones((1, 12))
    for h, z in r.model.logits(x).items():
        np.testing.assert_allclose(again.logits(x)[h], z)
    bad = table.withColumn("bias", F.when(F.col("part") == "intent", float("nan")).otherwise(F.col("bias")))
    with pytest.raises(ValueError):
        H.load_heads(bad)
    assert ST.fast_path_problem(r.model, "other") and not ST.fast_path_problem(r.model, "logmel:64:stats")
    row = ST.sweep_row(r.report, "e", "teacher", 0)
    assert row.columns == list(V.SWEEP_COLUMNS)
    line = ST.sweep_markdown(ST.sweep_summary(row.unionByName(row))).first()["line"]
    assert line.startswith("| e | teacher | 0 | 2 |") and "±" in line


def test_targets(spark):
    rows, _ = toy(spark, 12)
    d = rows.withColumn("g_slots", F.when(F.col("id") == "r2", F.create_map(F.lit("duration"), F.lit("777")))
                        .otherwise(F.col("g_slots")))
    got = {r["id"]: r for r in H.build_targets(d, CORE, "gold").collect()}
    assert got["r2"]["y_timer_set__duration"][-1] == 1.0
    assert all((got[k]["y_intent"] is not None) == (got[k]["g_addressed"] == V.ASSISTANT) for k in got)
    d = rows.withColumn("t_intent_probs", F.create_map(F.lit("stop"), F.lit(0.7), F.lit("cancel"), F.lit(0.3)))
    y = {r["id"]: r["y_intent"] for r in H.build_targets(d, CORE, "teacher").collect()}["r0"]
    assert y[CORE.names.index("stop")] == pytest.approx(0.7)


def test_hidden_layer_scores(spark):
    rng = np.random.default_rng(0)
    names = H.head_names(CORE)
    heads = {h: (rng.normal(size=(5, len(c))), rng.normal(size=len(c))) for h, c in names.items()}
    m = H.HeadsModel(np.zeros(4), np.ones(4), heads, names, {}, (rng.normal(size=(4, 5)), np.zeros(5)))
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],), (None,), ([float("nan")] * 4,)], "vector array<double>")
    got = H.score_heads(d, m).collect()
    z = m.logits(np.array([[1.0, 2, 3, 4]]))["addressed"][0]
    want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    np.testing.assert_allclose([got[0]["addressed"][a] for a in V.ADDRESSEES], want)
    assert [r["addressed"] is None for r in got] == [False, True, True, True]


def test_sweep_joins_vectors_once_an_encoder(spark, monkeypatch):
    """Every configuration trains on the same joined rows, and takes its own filter of them."""
    calls, seen, join = [], [], ST.H.join_vectors
    monkeypatch.setattr(ST.H, "join_vectors", lambda *a: calls.append(1) or join(*a))

    def trained(d, spec, cfg, catalogue):
        seen.append((spec, cfg.targets, cfg.seed, sorted((r["id"], r["vector"][0]) for r in d.collect())))
        return ST.StudentResult(None, spark.range(1), None, None, {})
    monkeypatch.setattr(ST, "train_joined", trained)
    monkeypatch.setattr(ST, "sweep_row", lambda report, *a: report)
    monkeypatch.setattr(ST.P, "row_trainable", lambda internal: F.col("id") != "c")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    vectors = spark.createDataFrame([("a", [1.0], 0.0, 0, "s"), ("a", [2.0], 0.0, 1, "s"), ("b", [3.0], 0.0, 0, "s"),
                                     ("c", [4.0], 0.0, 0, "s")], "id string, vector array<double>, encode_ms double, seq int, spec string")
    out = ST.sweep(rows, {"s": vectors}, ("gold", "mix"), (0, 1))
    assert out.count() == 4 and len(calls) == 1
    assert seen == [("s", m, k, [("a", 2.0), ("b", 3.0)]) for m in ("gold", "mix") for k in (0, 1)]


def test_voice_sweep_takes_the_middle_of_a_tie(spark):
    d = spark.createDataFrame([(0.8 - i / 50, True) for i in range(8)] + [(-0.05 + i / 200, False) for i in range(8)],
                              "similarity double, is_owner boolean")
    r = SP.sweep_voice_threshold(d).first()
    assert 0.2 < r["threshold"] < 0.5 and r["separated"] and r["bystander_passed"] == 0.0


def test_auc_and_ece(spark):
    rng = np.random.default_rng(2)
    s = np.round(rng.random(400), 2)
    y = rng.random(400) < s
    d = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    pos, neg = s[y], s[~y]
    want = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert Q.auc(d, F.col("s"), F.col("y")).first()[0] == pytest.approx(want)


def test_vectors_keep_table_order_past_many_partitions(spark):
    """Row numbers carry the partition in their high bits; table order must not mix with them."""
    far = 40_000 << 33
    rows = [("a", 0, far + 5, 1.0), ("a", 1, 3, 2.0), ("b", 0, 1, 1.0), ("b", 0, far, 2.0)]
    d = spark.createDataFrame(rows, "id string, i int, row long, v double").withColumn(
        "seq", F.struct(F.col("i").alias("table"), F.lit("f").alias("file"), F.lit(0).alias("block"), F.col("row")))
    got = {r["id"]: r["v"] for r in d.groupBy("id").agg(F.max_by("v", "seq").alias("v")).collect()}
    assert got == {"a": 2.0, "b": 2.0}
    names = SS.table_order(1, F.lit("f"), F.lit(0), F.col("row"))
    assert d.select(names.alias("s")).schema["s"].dataType.names == ["table", "file", "block", "row"]


def test_wide_vectors_are_summed_in_one_buffer(spark):
    """2048 dimensions: pooled frames and enrolled profiles equal NumPy."""
    rng = np.random.default_rng(3)
    frames = rng.normal(size=(7, 2048))
    d = spark.createDataFrame([("a", t, f.tolist()) for t, f in enumerate(frames)], "id string, t int, frame array<double>")
    got = D.pool_frames(d, 2048, "stats_thirds").first()["vector"]
    np.testing.assert_allclose(got, A.pool(frames, "stats_thirds"), atol=1e-9)
    from whofor.operators import speakers as SP
    clips = spark.createDataFrame([("s", f.tolist()) for f in frames] + [("t", frames[0].tolist()), ("u", None)],
                                  "who string, v array<double>")
    rows = {r["who"]: r["profile"] for r in SP.enrol(clips, ["who"], "v", 2048).collect()}
    mean = (frames / np.linalg.norm(frames, axis=1, keepdims=True)).mean(axis=0)
    np.testing.assert_allclose(rows["s"], mean / np.linalg.norm(mean), atol=1e-9)
    assert rows["t"] is None and "u" not in rows


def test_a_blank_feature_fails_whatever_is_selected(spark, tmp_path):
    d = spark.createDataFrame([("x", *[float(i) for i in range(20)])],
                              "label string, " + ", ".join(f"{n} double" for n in V.FEATURE_NAMES))
    M.write_feature_rows(d.drop(V.FEATURE_NAMES[19]), str(tmp_path / "g"))
    three = M.read_feature_rows(spark, str(tmp_path / "g")).select(*V.FEATURE_NAMES[:3])
    with pytest.raises(Exception, match=V.FEATURE_NAMES[19]):
        three.collect()
    with pytest.raises(Exception, match=V.FEATURE_NAMES[19]):
        M.read_feature_rows(spark, str(tmp_path / "g")).count()


def head_loss(model, X, y, head, l2, floor):
    """The objective of one head, by its definition."""
    W, b = model.heads[head]
    z = ((X - model.mean) / model.scale) @ W + b
    logp = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
    zero = b - np.log(np.exp(b - b.max()).sum()) - b.max()
    k = len(b)
    return (-(y * logp).sum() - floor * zero.sum()) / (len(y) + floor * k) + 0.5 * l2 * (W ** 2).sum()


@pytest.mark.parametrize("dim,l2", [(6, 1e-2), (2048, 1.0)])
def test_heads_are_at_the_minimum(spark, dim, l2):
    """No direction lowers the loss, and the multinomial regression of the library does not reach a lower one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    from whofor.operators import heads as H
    rng = np.random.default_rng(1)
    n = 90
    X = rng.normal(size=(n, dim)) * 3 + 1
    soft = rng.dirichlet([1, 1, 1], size=n)
    names = H.head_names()
    rows = [(X[i].tolist(), soft[i].tolist(), *[None if (i % 2 and h != "intent") else rng.dirichlet(np.ones(len(c))).tolist()
                                                for h, c in list(names.items())[1:]]) for i in range(n)]
    ddl = "vector array<double>, " + ", ".join(f"{H.target_column(h)} array<double>" for h in names)
    d = spark.createDataFrame(rows + [(None, *[[1.0 / len(c)] * len(c) for c in names.values()])], ddl).repartition(3)
    m = H.fit_heads(d, l2=l2, max_iter=200)
    got = head_loss(m, X, soft, "addressed", l2, H.WEIGHT_FLOOR)
    for scale in (1e-3, 1e-2):
        for _ in range(5):
            W, b = m.heads["addressed"]
            other = H.HeadsModel(m.mean, m.scale, {"addressed": (W + scale * rng.normal(size=W.shape),
                                                                 b + scale * rng.normal(size=b.shape))}, {})
            assert head_loss(other, X, soft, "addressed", l2, H.WEIGHT_FLOOR) > got
    if dim < 100:
        z = (X - m.mean) / m.scale
        flat = [(Vectors.dense(z[i]), float(k), float(soft[i, k])) for i in range(n) for k in range(3)]
        lr = LogisticRegression(family="multinomial", weightCol="w", regParam=l2, standardization=False, maxIter=200)
        fit = lr.fit(spark.createDataFrame(flat, ["features", "label", "w"]))
        ref = H.HeadsModel(m.mean, m.scale, {"addressed": (fit.coefficientMatrix.toArray().T, fit.interceptVector.toArray())}, {})
        assert got <= head_loss(ref, X, soft, "addressed", l2, H.WEIGHT_FLOOR) + 1e-6
        t = H.calibrated(d.where("vector is not null"), m).temperatures
        one = H.calibrate_temperature(d.where("vector is not null").select(
            F.array(*[F.lit(0.0)] * 3).alias("z"), H.target_column("addressed")), "z", H.target_column("addressed"))
        assert set(t) == set(names) and one.first()["temperature"] > 0

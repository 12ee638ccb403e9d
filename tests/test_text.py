"""Golden values for durations, parses, signals and catalogues."""

import pytest
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions import text as T
from whofor.operators import catalogue as C
from whofor.operators import parsing as P
from whofor.operators import signals as S
from whofor.operators import teacher as K
from whofor.operators import corpus as CO


def column(spark, values, fn):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in d.withColumn("x", fn(F.col("t"))).orderBy("i").collect()]


def test_durations(spark):
    cases = {"7 minutes": 420, "half an hour": 1800, "an hour and a half": 5400,
             "two and a half minutes": 150, "three quarters of an hour": 2700,
             "1 hour 30 minutes": 5400, "ninety seconds": 90, "twenty-five minutes": 1500,
             "a quarter of an hour": 900, "half a minute": 30, "nothing here": None,
             "sixteen mins": 960, "0 minutes": None}
    assert column(spark, list(cases), T.parse_duration) == list(cases.values())


def parse(spark, texts, catalogue=C.CORE, **kw):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = P.parse_intent(d, F.col("t"), catalogue, **kw).orderBy("i").collect()
    return [(r["parse_intent"], dict(r["parse_slots"]), r["parse_method"]) for r in rows]


def test_short_commands_are_anchored(spark):
    got = [r[0] for r in parse(spark, ["Nova, stop.", "I told him to stop", "play",
                                       "play some jazz", "set a timer",
                                       "Hey Nova, could you set a timer for 7 minutes please?"])]
    assert got == ["stop", "open_request", "media.resume", "open_request", "open_request", "timer.set"]


def test_examples_and_aliases(spark):
    agent = C.CORE.extended(C.Catalogue.of([
        {"name": "lights.set", "examples": ["set the lights to {level}"],
         "slots": [{"name": "level", "type": "enum", "values": ["low", "high"]}]}]))
    assert parse(spark, ["Nova, set the lights to HIGH"], agent) == \
        [("lights.set", {"level": "high"}, "example")]
    assert parse(spark, ["Hey Jova, cancel the timer"], aliases=("Jova",))[0][0] == "timer.cancel"


def scores(spark, texts, **ctx):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    d = S.classify(d, F.col("t"), S.TextContext(**ctx))
    return {r["t"]: r for r in d.collect()}


def test_named_and_physical_requests(spark):
    r = scores(spark, ["Nova, what time is it", "the novas are bright", "can you pass me that",
                       "remind me to grab the bag", "hold on a second", "is nova any good"])
    assert r["Nova, what time is it"]["method"] == "named"
    assert r["the novas are bright"]["method"] != "named"

    def fired(t):
        return {s["signal"] for s in r[t]["signals"]}
    assert "physical_request" in fired("can you pass me that")
    assert "physical_request" not in fired("remind me to grab the bag")
    assert "physical_request" not in fired("hold on a second")
    assert "assistant_name_mentioned" in fired("is nova any good")


def test_own_voice_vetoes_the_name(spark):
    r = scores(spark, ["Nova, stop"], own_voice=F.lit(0.2))["Nova, stop"]
    assert r["method"] != "named" and "not_own_voice" in {s["signal"] for s in r["signals"]}


def test_tail_keeps_audience_evidence(spark):
    t = "we should eat soon. what is the capital of Peru?"
    r = scores(spark, [t, "what is the capital of Peru?"])
    assert r[t]["scored_clause"] == "what is the capital of Peru?"
    assert r[t]["heuristic"] < r["what is the capital of Peru?"]["heuristic"]
    assert r[t]["ai_directed"] is False


def test_momentum_and_topic(spark):
    r = scores(spark, ["and in celsius", "tides and currents"], since_ai=F.lit(4.0),
               last_ai_text=F.lit("Tides follow the moon. Shall I go on?"))
    names = {s["signal"]: s["w"] for s in r["tides and currents"]["signals"]}
    assert names["answering_ai_question"] == 1.2
    assert names["topical_continuity"] == pytest.approx(round(1.3 / 3 * (1 - 0.5 * 4 / 45), 3))
    assert names["followup_window"] == pytest.approx(0.6 * (1 - 0.04))


def test_followups(spark):
    assert column(spark, ["go on", "go on then, what time is it", "say that again please", "no"],
                  lambda c: T.wants_more_detail(c) | T.wants_repeat(c)) == [True, False, True, False]


def test_catalogue_round_trip_and_checks(spark):
    rows = C.intent_rows(spark, C.CORE)
    again = C.from_rows(rows)
    assert again.names == C.CORE.names and list(again.slot_heads()) == ["timer.set:duration"]
    text = C.write_catalogue(rows)
    assert C.from_rows(C.read_catalogue(text.select("json"), "json")).names == C.CORE.names
    assert C.check_catalogue(rows, C.slot_table(rows)).count() == 0
    bad = C.intent_rows(spark, C.Catalogue.of([{"name": "Lights Off"}, {"name": "x.y", "when": ["never"]}]))
    assert {r["problem"] for r in C.check_catalogue(bad, C.slot_table(bad)).collect()} == \
        {"bad intent name", "unknown context"}


# -- the judge --------------------------------------------------------------------------------------

def judged(spark, texts, who, intent=None, weight=1.0):
    import numpy as np

    def ask_who(ts):
        p = np.full((len(ts), 3), 0.01)
        p[:, who] = 1.0
        return p / p.sum(1, keepdims=True)

    def ask_what(ts):
        p = np.full((len(ts), len(C.CORE.names)), 0.01)
        p[:, C.CORE.names.index(intent or "stop")] = 1.0
        return p / p.sum(1, keepdims=True)
    d = spark.createDataFrame([(t, True, True) for t in texts],
                              "transcript string, reliable boolean, tail_reliable boolean")
    j = K.judge_batch(d, "transcript", ask_who, ask_what)
    return {r["transcript"]: r for r in K.label_transcripts(d, j, weight).collect()}, j


def test_judge_overrules_a_cold_engine(spark):
    r, _ = judged(spark, ["a little louder"], 0, "volume.up")
    r = r["a little louder"]
    assert r["t_accept"] and r["t_intent"] == "volume.up"
    assert r["t_judge_addressed"][V.ASSISTANT] > 0.9 > 0.5 > r["t_engine_addressed"][V.ASSISTANT]
    assert sum(r["t_intent_probs"].values()) == pytest.approx(1.0)


def test_rules_keep_exact_parses(spark):
    r, _ = judged(spark, ["set a timer for 7 minutes", "could you time my eggs"], 0, "timer.set")
    assert r["set a timer for 7 minutes"]["t_slots"] == {"duration": "420"}
    assert r["set a timer for 7 minutes"]["t_intent_probs"]["timer.set"] > 0.85
    assert r["could you time my eggs"]["t_intent"] == "open_request"


def test_a_second_run_asks_nothing(spark, tmp_path):
    """Answers are kept by normalised text: only what is new is asked, and asked once."""
    import numpy as np
    asked = spark.sparkContext.accumulator(0)

    def who(ts):
        asked.add(len(ts))
        return np.tile([0.8, 0.1, 0.1], (len(ts), 1))

    def what(ts):
        return np.full((len(ts), len(C.CORE.names)), 1.0 / len(C.CORE.names))

    def run(*texts):
        d = spark.createDataFrame([(t,) for t in texts], "said string")
        return {r["judge_key"]: r["judge_addressed"][V.ASSISTANT]
                for r in K.judge_with_store(d, "said", who, what, str(tmp_path / "answers")).collect()}
    first = run("turn it up", "Turn  it up", "stop", "", None)
    assert set(first) == {"turn it up", "stop", ""} and first["stop"] == pytest.approx(0.8) and asked.value == 2
    assert run("STOP", "turn it up", "") == first and asked.value == 2
    assert set(run("stop", "go on")) == {"stop", "go on"} and asked.value == 3


def test_repeats_are_asked_once_and_unlikely_texts_skip_the_second_question(spark):
    r, j = judged(spark, ["did you feed the cat", "Did you feed  the cat", ""], 1)
    rows = {x["judge_key"]: x for x in j.collect()}
    assert len(rows) == 2 and rows["did you feed the cat"]["judge_intent"] == {}
    assert not r["did you feed the cat"]["t_accept"]
    assert r[""]["t_method"] == "no_transcript"


def test_blend_weight(spark):
    r, _ = judged(spark, ["a little louder"], 0, weight=0.5)
    r = r["a little louder"]
    want = 0.5 * r["t_judge_addressed"][V.ASSISTANT] + 0.5 * r["t_engine_addressed"][V.ASSISTANT]
    assert r["t_addressed"][V.ASSISTANT] == pytest.approx(want)


def test_corpus_is_deterministic_and_labelled(spark):
    a = CO.build_corpus(spark, size=400, seed=3)
    b = CO.build_corpus(spark, size=400, seed=3).repartition(7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    timers = a.where("g_intent = 'timer.set'").withColumn("d", T.parse_duration(F.col("text")))
    bad = timers.where(F.col("d").cast("string") != F.col("g_slots")["duration"])
    assert timers.count() > 5 and bad.count() == 0
    assert a.where(F.col("text").contains("{")).count() == 0


def _readings(pattern: str) -> list[str]:
    """Some texts that match: each alternative written out, optional parts left out and put in."""
    from re import _parser as P

    def of(items):
        texts = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "SUBPATTERN":
                more = of(arg[3])
            elif name == "BRANCH":
                more = [t for branch in arg[1] for t in of(branch)]
            elif name == "MAX_REPEAT":
                more = ([""] if arg[0] == 0 else []) + of(arg[2])
            elif name == "IN":
                more = [next((chr(v) for o, v in arg if str(o) == "LITERAL"), " ")]
            else:
                more = [""]
            texts = [t + m for t in texts for m in more]
        return texts
    return of(P.parse(pattern))


def test_leads_lose_no_match(spark):
    """A pattern that is tried only at its first letters finds what it finds anywhere."""
    texts = [f"{before}{t}{after}" for name in V.LEADS for t in _readings(V.PATTERNS[name])
             for before in ("", "so, ", "x", "to ", "é") for after in ("", "!", " now", "s")]
    assert len(texts) > 3000
    d = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    c = F.col("t")
    row = d.agg(*[F.sum(F.when(T.found_named(c, n) != T.found(c, V.PATTERNS[n]), 1).otherwise(0)).alias(n) for n in V.LEADS],
                *[F.count_if(T.found(c, V.PATTERNS[n])).alias(f"{n}_hits") for n in V.LEADS]).first().asDict()
    assert all(row[n] == 0 and row[f"{n}_hits"] > 10 for n in V.LEADS), row


def test_last_sentence_and_blanks_as_by_parts(spark):
    texts = ["", " ", "one", "One. two three", "One.  two", "a. b c.  \n ", "a? b c", "x!  y z", "a.b c d", " . x y", "Mr. X said so! Did he\tsay?　",
             "a.\nb c\n.\nd e ", "...  a b", "a. . .", "a b. c d. ", " a.  b  c  d ", "long. " * 40 + "the end", "a \t b\n\nc   d", "\u0085a.\u0085 b c. d e\u0085"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?])(?=\s)"), T.strip), lambda s: s != "")
    whole = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    tail = F.element_at(parts, -1)
    by_parts = F.when((F.size(parts) >= 2) & (T.word_count(whole(tail)) >= 2), tail)
    rows = d.select("t", by_parts.alias("want"), T.last_sentence(c).alias("got"), whole(c).alias("w"), T.collapse(c).alias("g")).collect()
    assert [(r["t"], r["want"], r["w"]) for r in rows] == [(r["t"], r["got"], r["g"]) for r in rows]
    assert sum(r["got"] is not None for r in rows) > 8


def test_cpu_bound_scans_are_spread(spark, tmp_path):
    """A table beyond a few megabytes a core in one row group was one task."""
    from whofor.session import SPLIT_BYTES, spread_small
    path = str(tmp_path / "wide.parquet")
    spark.range(0, 800_000, numPartitions=1).select("id", *[F.xxhash64("id", F.lit(k)).alias(f"c{k}") for k in range(5)]) \
        .write.option("compression", "none").parquet(path)
    d = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert sum(f.stat().st_size for f in (tmp_path / "wide.parquet").iterdir()) > 2 * cores * SPLIT_BYTES
    sizes = [r["count"] for r in spread_small(d).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 800_000 and len(sizes) > 2 * cores and max(sizes) < 800_000 / cores


def test_a_reply_is_read_once(spark):
    """Shares are looked up or bound once; the reply's patterns are not run again for every option."""
    d = spark.createDataFrame([(r,) for r in ("A", "answer: b)", " c ", "42?", None, "z", "Bob", "d")], "r string")
    p = K.option_probs(F.col("r"), 4)
    got = {r["r"]: r["p"] for r in d.select("r", p.alias("p")).collect()}
    first = [0.9, 0.1 / 3, 0.1 / 3, 0.1 / 3]
    for reply, at in (("A", 0), ("answer: b)", 1), (" c ", 2), ("Bob", 1), ("d", 3)):
        assert got[reply] == pytest.approx(first[-at:] + first[:-at] if at else first, abs=1e-12)
    assert got["42?"] == got[None] == got["z"] == [0.25] * 4
    assert str(p).count("regexp_extract") <= 6 and "lambdafunction" not in str(p)
    q = K.normalised_probs(F.split("r", "x").cast("array<double>"))
    e = spark.createDataFrame([("1x3",), ("2",)], "r string").select(q.alias("q")).collect()
    assert [r["q"] for r in e] == [[0.25, 0.75], [1.0]] and str(q).count("split") == 1


def test_repeated_texts_are_read_once(spark):
    texts = ["Nova, set a timer for 7 minutes", "we should eat soon. what is the capital of Peru?", None, "",
             "sam, can you pass me that", "It said no. Nova, stop", "yeah", "is Nova any good, do you think"]
    d = spark.createDataFrame([(i, texts[i % len(texts)], i % 3 > 0, (i % 5) / 4.0) for i in range(80)],
                              "i int, t string, reliable boolean, own double")
    ctx = S.TextContext(reliable=F.col("reliable"), own_voice=F.col("own"), driving=F.col("i") % 2 == 0,
                        since_ai=F.lit(5.0), last_ai_text=F.lit("The capital of Peru?"))
    once = S.SignalSettings(bystanders=("sam",))
    each = S.SignalSettings(bystanders=("sam",), read_once=False)
    found = [P.parse_intent(S.classify(d, F.col("t"), ctx, s), F.col("t"), read_once=s.read_once).orderBy("i").collect()
             for s in (once, each)]
    assert len(found[0]) == 80
    assert [r.asDict(True) for r in found[0]] == [{k: r.asDict(True)[k] for k in found[0][0].asDict()} for r in found[1]]
    plan = S.classify(d, F.col("t"), ctx, once).select("band")._jdf.queryExecution().optimizedPlan().toString()
    # No pattern is tried above the join that brings each text's facts.
    assert "RLIKE" in plan and "RLIKE" not in plan.split("Join LeftOuter")[0]

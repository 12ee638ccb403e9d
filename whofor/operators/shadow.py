"""Event-log analytics: what the gate and the fast path would have done, per turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import count_if, is_true, rate, safe_div
from whofor.operators.ordering import first_ranked
from whofor.operators.quantiles import quantiles
from whofor.session import cut_lineage

GATE_EVENTS = ("gate_scored", "intent_accepted", "intent_ignored", "transcript_rejected",
               "segment_dropped")


VERDICTS = ("accepted", "ignored", "skipped")


def verdict_of(event: Column, reason: Column) -> Column:
    """What an event says became of its turn, as a position in VERDICTS, or null."""
    return (F.when(event == "intent_accepted", 0).when(event == "intent_ignored", 1)
            .when((event == "segment_dropped") & is_true(reason == "gate"), 2))


def gate_turns(events: DataFrame, order: Column | list[str],
               gate_fields: list[str]) -> DataFrame:
    """One row per turn the gate scored: its last decision and the turn's last verdict.

    ``order`` places events inside a turn: one number (time in microseconds),
    or columns (time, then position in the log). A number and plain fields keep
    the whole aggregate in hash maps on both sides of its one shuffle; with
    several columns Spark sorts instead. A rejected transcript counts only when
    nothing better is known.
    """
    at = F.struct(*order) if isinstance(order, list) else order
    e, said = F.col("event"), verdict_of(F.col("event"), F.col("reason"))
    gate = e == "gate_scored"
    per = (events.where((F.coalesce(F.col("turn").cast("string"), F.lit("")) != "")
                        & e.isin(*GATE_EVENTS))
           .groupBy("turn").agg(
        *[F.max_by(f, F.when(gate, at)).alias(f) for f in gate_fields],
        F.max(gate.cast("int")).alias("scored"),
        F.max_by(said, F.when(said.isNotNull(), at)).alias("said"),
        F.max((e == "transcript_rejected").cast("int")).alias("rejected")))
    names = F.array(*[F.lit(v) for v in VERDICTS])
    verdict = F.coalesce(F.get(names, F.col("said")), F.when(F.col("rejected") == 1, "no_transcript"),
                         F.lit("unknown"))
    return per.where("scored = 1").select("turn", *gate_fields, verdict.alias("verdict"))


def gate_shadow_report(turns: DataFrame) -> DataFrame:
    """Headline row: scored, would skip, would have skipped something accepted, latency."""
    would = is_true(F.col("would_skip"))
    # Turns are assembled once: everything below reads four short columns of them.
    t = cut_lineage(turns.select(
        would.alias("would"), (would & is_true(F.col("verdict") == "accepted")).alias("wrong"),
        F.col("latency_ms").alias("latency"),
        F.when(F.col("feature_ms") != 0, F.col("feature_ms")).alias("feature")))
    a = t.groupBy().agg(
        F.count(F.lit(1)).alias("scored"), count_if(F.col("would")).alias("would_skip"),
        count_if(F.col("wrong")).alias("would_skip_but_accepted"))
    return with_percentiles(a, t, ["latency", "feature"], 3)


def with_percentiles(row: DataFrame, df: DataFrame, metrics: list[str], digits: int) -> DataFrame:
    """A one-row frame with ``<metric>_p50`` and ``<metric>_p95``, all metrics in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"))
    q = quantiles(long.select("m.*"), ["metric"], F.col("value"), {"p50": 0.5, "p95": 0.95}, digits)
    wide = q.groupBy().agg(*[F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}")
                             for m in metrics for p in ("p50", "p95")])
    return row.withColumn("__q", wide.select(F.struct(*wide.columns)).scalar()) \
        .select(*row.columns, *[F.col("__q")[c].alias(c) for c in wide.columns])


def would_skip_by_verdict(turns: DataFrame) -> DataFrame:
    return turns.where(is_true(F.col("would_skip"))).groupBy("verdict") \
        .agg(F.count(F.lit(1)).alias("turns"))


def dangerous_skips(turns: DataFrame) -> DataFrame:
    return turns.where(is_true(F.col("would_skip")) & (F.col("verdict") == "accepted"))


def shadow_feature_rows(turns: DataFrame) -> DataFrame:
    """Unlabelled feature rows from turns that logged all 20 features (a map column)."""
    full = F.size(F.array_intersect(F.map_keys("features"),
                                    F.array(*map(F.lit, V.FEATURE_NAMES)))) \
        == len(V.FEATURE_NAMES)
    blank = F.lit("")
    meta = {"label": blank, "source": F.lit("shadow_log"), "license": F.lit("none"),
            "consent": blank, "speaker": blank, "session": blank, "room": blank, "mic": blank,
            "feature_ms": F.col("feature_ms").cast("string"),
            "intent_verdict": F.when(F.col("verdict") == "unknown", "").otherwise(
                F.col("verdict"))}
    return turns.where(is_true(full)).select(
        "turn", *[c.alias(n) for n, c in meta.items()],
        *[F.col("features")[n].cast("double").alias(n) for n in V.FEATURE_NAMES])


# -- fast path against slow path -----------------------------------------------------------

def decision_pairs(events: DataFrame, order: list[str]) -> DataFrame:
    """The last fast and the last slow decision of every turn that has a fast one.

    Events carry ``route, intent, slots(map), p_assistant, transcript, ms``.
    """
    at = F.struct(*order)
    rec = F.struct("route", "intent", "slots", "p_assistant", "transcript", "ms")
    fast, slow = F.col("event") == "slu_decided", F.col("event") == "slu_system_two"
    per = (events.where((F.coalesce(F.col("turn").cast("string"), F.lit("")) != "")
                        & (fast | slow))
           .groupBy("turn").agg(F.max_by(rec, F.when(fast, at)).alias("fast"),
                                F.max_by(rec, F.when(slow, at)).alias("slow"),
                                F.max(fast.cast("int")).alias("f"),
                                F.max(slow.cast("int")).alias("s")))
    return per.where("f = 1").select(
        "turn", "fast", F.when(F.col("s") == 1, F.col("slow")).alias("slow"))


def _pairs(slots: Column) -> Column:
    """A map as sorted text, so two maps compare equal whatever their order."""
    return F.to_json(F.array_sort(F.map_entries(F.coalesce(
        slots, F.create_map().cast("map<string,string>")))))


def disagreement(df: DataFrame) -> DataFrame:
    """Pairs with ``kind``: how the two paths differ where it matters, or null."""
    f, s = F.col("fast"), F.col("slow")
    differ = ~f["intent"].eqNullSafe(s["intent"]) | (_pairs(f["slots"]) != _pairs(s["slots"]))
    return df.withColumn("kind", F.when(s.isNull(), F.lit(None)).when(
        (f["route"] == "ignore") & (s["route"] == "act"), "would_have_missed").when(
        (f["route"] == "act") & (s["route"] != "act"), "would_have_acted_on_ignored").when(
        (f["route"] == "act") & differ, "would_have_acted_differently"))


def agreement_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(
        F.concat_ws(" / ", "fast.route", F.coalesce("slow.route", F.lit("system_two_not_run")))
        .alias("routes")).agg(F.count(F.lit(1)).alias("turns"))


def fast_vs_slow_report(pairs: DataFrame) -> DataFrame:
    d = cut_lineage(disagreement(pairs).select(
        F.col("fast.route").isin("act", "ignore").alias("spared"), "kind", F.col("fast.ms").alias("fast")))
    a = d.groupBy().agg(
        F.count(F.lit(1)).alias("turns"), count_if(F.col("spared")).alias("would_have_avoided_stt"),
        *[count_if(is_true(F.col("kind") == k)).alias(k) for k in (
            "would_have_missed", "would_have_acted_on_ignored", "would_have_acted_differently")])
    return with_percentiles(a, d, ["fast"], 2).withColumnsRenamed(
        {"fast_p50": "fast_p50_ms", "fast_p95": "fast_p95_ms"})


def agreement(route: Column, intent: Column, slots: Column, accepted: Column,
              t_intent: Column, t_slots: Column, has_model: Column | None = None,
              has_teacher: Column | None = None) -> Column:
    """How a fast decision compares with what the words said; only its own slots count."""
    acc = is_true(accepted)
    fits = is_true(F.forall(F.map_entries(slots), lambda e: is_true(
        F.try_element_at(t_slots, e["key"]) == e["value"])))
    out = F.when(~is_true(has_model), "no_model") if has_model is not None \
        else F.when(route.isNull(), "no_model")
    if has_teacher is not None:
        out = out.when(~is_true(has_teacher), "no_teacher")
    return (out.when(route == "escalate", "escalated")
            .when((route == "ignore") & ~acc, "agree").when(route == "ignore", "s1_would_miss")
            .when(~acc, "s1_would_act_on_ignored")
            .when(intent.eqNullSafe(t_intent) & fits, "agree").otherwise("different_intent"))


COMPARED = ("agree", "s1_would_miss", "s1_would_act_on_ignored", "different_intent")


def live_totals(df: DataFrame) -> DataFrame:
    """Running counts for a dashboard; the same aggregate in batch or streaming."""
    a = df.groupBy().agg(
        F.count(F.lit(1)).alias("utterances"),
        count_if(F.col("route").isin("act", "ignore")).alias("decided_fast"),
        count_if(F.col("agreement").isin(*COMPARED)).alias("compared"),
        count_if(F.col("agreement") == "agree").alias("agreed"))
    return a.withColumns({
        "stt_avoided": F.round(safe_div(F.col("decided_fast"), F.greatest(
            F.col("utterances"), F.lit(1))), 3),
        "agreement_rate": rate(F.col("agreed"), F.col("compared"), 3)})


def recent_latency(df: DataFrame, order: list, row_id: str, n: int = 200) -> DataFrame:
    """Median of the newest ``n`` latencies."""
    last = first_ranked(df.withColumn("__k", F.lit(0)), ["__k"], order, n, F.col(row_id))
    return last.groupBy().agg(F.round(F.percentile("ms", F.lit(0.5)), 1).alias("p50_ms"))


# -- labels kept while trying ------------------------------------------------------------------

def latest_labels(labels: DataFrame, order: list[str]) -> DataFrame:
    """One label per utterance: the newest replaces what came before."""
    rest = [c for c in labels.columns if c != "id"]
    return labels.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("l")) \
        .select("id", "l.*")


def save_labelled(rows: DataFrame, vectors: DataFrame, session: str, consent: str, room: str,
                  speaker: str) -> tuple[DataFrame, DataFrame]:
    """(rows, vectors) of a saved session: prefixed ids, only encoders every row has."""
    total = rows.groupBy().agg(F.count_distinct("id").alias("n")).scalar()
    mine = vectors.join(rows.select("id"), "id", "left_semi")
    full = mine.groupBy("spec").agg(F.count_distinct("id").alias("n")) \
        .withColumn("__t", total).where("n = __t").select("spec")
    new_id = F.concat(F.lit(session + "-"), F.col("id").cast("string"))
    kept = mine.join(full, "spec", "left_semi").withColumn("id", new_id)
    return (rows.withColumns({
        "id": new_id, "session": F.lit(session), "room": F.lit(room),
        "consent": F.lit(consent), "speaker": F.lit(speaker or "me")}), kept)


def discard(rows: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    return rows.join(gone, "id", "left_anti"), vectors.join(gone, "id", "left_anti")


def top_intents(intents: Column, k: int = 3) -> Column:
    """array<struct<intent, p>> of the k most probable, p at 3 places; ties keep map order."""
    ranked = F.slice(F.array_sort(F.transform(F.map_entries(intents), lambda e, i: F.struct(
        (-e["value"]).alias("k"), i.alias("i"), e["key"].alias("n")))), 1, k)
    return F.transform(ranked, lambda r: F.struct(
        r["n"].alias("intent"), F.round(-r["k"], 3).alias("p")))


def session_summary(rows: DataFrame, by: str = "session") -> DataFrame:
    """Rows per session with counts per label and per step as maps."""
    def counts(col):
        per = rows.where(F.col(col).isNotNull()) \
            .groupBy(by, F.col(col).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy(by).agg(F.map_from_entries(F.array_sort(
            F.collect_list(F.struct("k", "n")))).alias(f"per_{col}"))
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    return total.join(counts("g_addressed"), by, "left").join(counts("step"), by, "left")


def turn_timeline(events: DataFrame, order: list[str]) -> DataFrame:
    """Every event with the milliseconds since the one before it in the same turn."""
    d = events.where(F.coalesce(F.col("turn").cast("string"), F.lit("")) != "")
    # A turn is one utterance: a handful of events, ordered where they meet.
    turn = Window.partitionBy("turn").orderBy(*order)
    return d.select(
        "turn", "event", "t", F.row_number().over(turn).cast("long").alias("step"),
        F.round((F.col("t") - F.lag("t").over(turn)) * 1000.0, 3).alias("since_previous_ms"),
        F.round((F.col("t") - F.first("t").over(turn)) * 1000.0, 3).alias("since_start_ms"))


def stage_funnel(events: DataFrame) -> DataFrame:
    return events.groupBy("stage", "event").agg(F.count(F.lit(1)).alias("events"))

"""Evaluation: truth, rates, calibration, ranking quality, reports.

Reports are wide conditional aggregates (one shuffle of partial sums), and
exact quantiles and ranks go through ``quantiles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import (argmax, bound, count_if, is_true, rate, rate_columns,
                                      safe_div, wilson_upper)
from whofor.operators.ordering import first_ranked, settle
from whofor.operators.parsing import no_slots
from whofor.operators.quantiles import quantiles, running_sums
from whofor.session import cut_lineage

# -- truth and outcomes --------------------------------------------------------------------


def truth(df: DataFrame, mode: str = "auto") -> DataFrame:
    """Adds ``true_addressed, true_intent, true_slots``: gold if known, else the teacher."""
    has_gold = F.coalesce(F.col("g_addressed"), F.lit("")) != ""
    gold = {"gold": F.lit(True), "teacher": F.lit(False)}.get(mode, has_gold)
    fill = (F.lit(mode == "auto") & is_true(F.col("g_addressed") == V.ASSISTANT)
            & F.col("g_intent").isNull() & F.col("t_intent").isNotNull())
    known = F.col("t_addressed").isNotNull()
    rest, _ = argmax([(a, F.try_element_at(F.col("t_addressed"), F.lit(a)))
                      for a in (V.HUMAN, V.MEDIA)])
    t_addr = F.when(is_true(F.col("t_accept")), V.ASSISTANT).otherwise(rest)
    t_slots = F.coalesce(F.col("t_slots"), no_slots())
    return df.withColumns({
        "true_addressed": F.when(gold, F.col("g_addressed")).when(known, t_addr),
        "true_intent": F.when(gold & fill, F.col("t_intent")).when(gold, F.col("g_intent"))
        .when(known & (t_addr == V.ASSISTANT), F.col("t_intent")),
        "true_slots": F.when(gold & fill, t_slots)
        .when(gold, F.coalesce(F.col("g_slots"), no_slots()))
        .when(known, t_slots).otherwise(no_slots())})


def _as_int(c: Column) -> Column:
    return c.try_cast("double").cast("long")


def outcome_correct(kind: Column, intent: Column, slots: Column, addressed: Column,
                    true_intent: Column, true_slots: Column) -> Column:
    """Was the outcome right: every slot of the truth must be there with its value."""
    served = F.forall(F.map_entries(true_slots), lambda e: is_true(
        _as_int(F.try_element_at(slots, e["key"])) == _as_int(e["value"])))
    return (F.when(~is_true(addressed == V.ASSISTANT), kind == "ignore")
            .when((kind != "act") | ~is_true(intent == true_intent), False)
            .when(true_intent == V.OPEN_REQUEST, True).otherwise(served))


def act_correct(intent: Column, slots: Column, addressed: Column, true_intent: Column,
                true_slots: Column) -> Column:
    """Would acting be right: every predicted slot must equal the truth and be on the list."""
    fits = F.forall(F.map_entries(slots), lambda e: (e["value"] != V.OTHER) & is_true(
        _as_int(e["value"]) == _as_int(F.try_element_at(true_slots, e["key"]))))
    return is_true((addressed == V.ASSISTANT) & (intent == true_intent)) & fits


# -- scores -----------------------------------------------------------------------------------

def auc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """One row ``auc``: the chance a positive outranks a negative, ties counting half."""
    counts = df.select(score.cast("double").alias("s"), positive.alias("y")) \
        .where(F.col("s").isNotNull() & F.col("y").isNotNull()) \
        .groupBy("s").agg(count_if(F.col("y")).alias("pos"), count_if(~F.col("y")).alias("neg"))
    run = running_sums(counts, "s", ["neg"])
    return run.groupBy().agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        safe_div(F.col("u"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def expected_calibration_error(df: DataFrame, p: Column, correct: Column, bins: int = 10,
                               by: list[str] = ()) -> DataFrame:
    """Gap between stated confidence and accuracy over right-closed bins."""
    b = F.least(F.greatest(F.ceil(p * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    per = df.where(p.isNotNull()).groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"),
        F.avg(F.when(correct, 1.0).otherwise(0.0)).alias("acc"))
    return per.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def slot_accuracy(df: DataFrame) -> DataFrame:
    """Argmax of a slot head against the true value, or 'other' when it is off the list."""
    d = df.where((F.col("true_addressed") == V.ASSISTANT) & (F.size("true_slots") > 0)) \
        .select("true_intent", "slot_probs", F.explode("true_slots").alias("slot", "value"))
    dist = F.try_element_at(F.col("slot_probs"), F.concat_ws(":", "true_intent", "slot"))
    d = d.withColumn("dist", dist).where(F.size("dist") > 0)
    best = F.element_at(F.array_sort(F.transform(
        F.map_entries("dist"), lambda e, i: F.struct((-e["value"]).alias("p"), i.alias("i"),
                                                     e["key"].alias("k")))), 1)["k"]
    want = F.when(F.array_contains(F.map_keys("dist"), F.col("value")), F.col("value")) \
        .otherwise(V.OTHER)
    return d.groupBy().agg(F.count(F.lit(1)).alias("slots"),
                           F.avg(F.when(best == want, 1.0).otherwise(0.0)).alias("accuracy"))


# -- threshold search ----------------------------------------------------------------------------

def choose_act_thresholds(df: DataFrame, ignore_below: float | None, max_wrong_act: float,
                          max_false_activation: float, margin_z: float = 1.0,
                          grid=V.ACT_GRID) -> DataFrame:
    """The (addressed, intent, slot) grid point with the most correct acts in budget.

    Rows need ``p_assistant, p_intent, p_slot, floor, actable, correct,
    is_assist``. Every row is reduced to the highest grid index it passes on
    each axis, so the search runs over at most len(grid)^3 counted cells
    however many rows there are; suffix sums over the three axes turn cell
    counts into counts at or above a grid point. No row comes back when no
    point fits the budgets.
    """
    levels = list(grid)

    def passed(p, extra=None):
        ok = [(p >= g) if extra is None else (p >= F.greatest(F.lit(g), extra)) for g in levels]
        return F.aggregate(F.array(*[F.when(c, 1).otherwise(0) for c in ok]), F.lit(-1),
                           lambda a, x: a + x)
    keep = is_true(F.col("actable"))
    if ignore_below is not None:
        keep = keep & (F.col("p_assistant") >= ignore_below)
    open_ = is_true(keep & (F.col("p_intent") >= F.col("floor")))

    def reached(p):
        return F.when(open_, passed(p)).otherwise(-1)
    # Rows are read once: those out of the search fall into cells of their own and still count as non.
    every = cut_lineage(df.select(
        reached(F.col("p_assistant")).alias("a"), reached(F.col("p_intent")).alias("i"),
        reached(F.col("p_slot")).alias("s"), F.col("correct"), F.col("is_assist"))
        .groupBy("a", "i", "s").agg(
        F.count(F.lit(1)).alias("acts"), count_if(~is_true(F.col("correct"))).alias("wrong"),
        count_if(~is_true(F.col("is_assist"))).alias("false_act")))
    cells = every.where((F.col("a") >= 0) & (F.col("i") >= 0) & (F.col("s") >= 0))
    names = ["acts", "wrong", "false_act"]
    axes = ["a", "i", "s"]
    n = len(levels)
    d = cells
    for axis in axes:
        # A cell counts towards every grid index up to its own: at most n copies of <= n^3 rows.
        others = [x for x in axes if x != axis]
        d = d.withColumn(axis, F.explode(F.sequence(F.lit(0), F.col(axis)))) \
            .groupBy(*others, axis).agg(*[F.sum(c).alias(c) for c in names])
    n_non = every.groupBy().agg(F.greatest(F.coalesce(F.sum("false_act"), F.lit(0)), F.lit(1)).alias("n_non"))
    d = d.withColumn("n_non", n_non.scalar())
    ok = d.where((bound(F.col("wrong"), F.col("acts"), margin_z) <= max_wrong_act + 1e-12)
                 & (bound(F.col("false_act"), F.col("n_non"), margin_z)
                    <= max_false_activation + 1e-12))
    table = F.array(*[F.lit(float(g)) for g in levels])
    at = {x: F.get(table, F.col(x)) for x in axes}
    best = F.max_by(
        F.struct(at["a"].alias("act_addressed"), at["i"].alias("act_intent"),
                 at["s"].alias("act_slot"), "acts", "wrong", "false_act"),
        # most correct acts, then the largest sum, then the first in grid order
        F.struct((F.col("acts") - F.col("wrong")).alias("c"),
                 (at["a"] + at["i"] + at["s"]).alias("t"),
                 (-(F.col("a") * n * n + F.col("i") * n + F.col("s"))).alias("o")))
    return ok.groupBy().agg(best.alias("b")).where(F.col("b").isNotNull()).select("b.*")


# -- the student report -------------------------------------------------------------------------

def judged(df: DataFrame, mode: str = "auto") -> DataFrame:
    """Routed rows with truth and the boolean facts every report counts."""
    d = truth(df, mode)
    values = F.transform_values("slots", lambda k, v: v["value"])
    d = d.withColumns({
        "is_assist": is_true(F.col("true_addressed") == V.ASSISTANT),
        "has_truth": F.col("true_addressed").isNotNull(),
        "slot_values": values,
    })
    d = d.withColumns({
        "act_ok": (F.col("route") == "act") & act_correct(
            F.col("intent"), F.col("slot_values"), F.col("true_addressed"),
            F.col("true_intent"), F.col("true_slots")),
        "addr_ok": is_true(F.col("who") == F.col("true_addressed")),
        "intent_row": F.col("is_assist") & F.col("true_intent").isNotNull(),
        "intent_ok": is_true(F.col("intent") == F.col("true_intent")),
        "non": F.col("has_truth") & ~F.col("is_assist")})
    return settle(d, ["is_assist", "has_truth", "act_ok", "addr_ok", "intent_row", "intent_ok",
                      "non"])


def evaluate(j: DataFrame) -> DataFrame:
    """The headline row for ``judged`` rows: routes, budgets, accuracy. One aggregate."""
    def r(x):
        return F.col("route") == x
    typed = F.col("is_assist") & F.col("true_intent").isNotNull() \
        & (F.col("true_intent") != V.OPEN_REQUEST)
    facts = {
        "rows": F.count(F.lit(1)),
        **{x: count_if(r(x)) for x in V.ROUTES},
        "assist": count_if(F.col("is_assist")), "non": count_if(F.col("non")),
        "f_ign": count_if(r("ignore") & F.col("is_assist")),
        "f_act": count_if(r("act") & F.col("non")),
        "c_ign": count_if(r("ignore") & F.col("non")),
        "w_act": count_if(r("act") & ~F.col("act_ok")),
        "t_act": count_if(F.col("act_ok") & typed), "typed": count_if(typed),
        "known": count_if(F.col("has_truth")),
        "addr": count_if(F.col("has_truth") & F.col("addr_ok")),
        "int_n": count_if(F.col("intent_row")),
        "int_ok": count_if(F.col("intent_row") & F.col("intent_ok"))}
    a = j.groupBy().agg(*[c.alias(f"_{k}") for k, c in facts.items()])

    def c(k):
        return F.col(f"_{k}")
    return a.select(
        c("rows").alias("rows"), *[c(x).alias(x) for x in V.ROUTES],
        rate(c("act") + c("ignore"), c("rows")).alias("stt_avoided"),
        *rate_columns("false_ignore", c("f_ign"), c("assist")),
        *rate_columns("false_activation", c("f_act"), c("non")),
        *rate_columns("correct_ignore", c("c_ign"), c("non")),
        *rate_columns("wrong_act", c("w_act"), c("act")),
        *rate_columns("typed_acted", c("t_act"), c("typed")),
        rate(c("addr"), c("known")).alias("addressed_accuracy"),
        rate(c("int_ok"), c("int_n")).alias("intent_accuracy"))


def intent_confusions(j: DataFrame, k: int = 10) -> DataFrame:
    return (j.where(F.col("intent_row") & ~F.col("intent_ok"))
            .groupBy(F.col("true_intent").alias("true"), F.col("intent").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "true", "predicted").limit(k))


def teacher_vs_gold(df: DataFrame) -> DataFrame:
    d = df.where(F.col("t_addressed").isNotNull() & F.col("g_addressed").isNotNull())
    acc, gold = is_true(F.col("t_accept")), F.col("g_addressed") == V.ASSISTANT
    a = d.groupBy().agg(
        F.count(F.lit(1)).alias("n"), count_if(acc == gold).alias("hit"),
        count_if(acc & ~gold).alias("fa"), count_if(~gold).alias("non"),
        count_if(~acc & gold).alias("miss"), count_if(gold).alias("pos"),
        count_if(acc & gold).alias("served"),
        count_if(acc & gold & F.col("t_intent").eqNullSafe(F.col("g_intent"))).alias("same"))
    return a.select(F.col("n").alias("rows"), rate(F.col("hit"), F.col("n")).alias("accuracy"),
                    *rate_columns("false_activation", F.col("fa"), F.col("non")),
                    *rate_columns("missed", F.col("miss"), F.col("pos")),
                    rate(F.col("same"), F.col("served")).alias("intent_accuracy_on_accepted"))


def end_to_end(j: DataFrame) -> DataFrame:
    """Fast path where it decided, the teacher where it escalated, against the teacher alone."""
    known = F.col("has_truth") & F.col("t_addressed").isNotNull()
    acc = is_true(F.col("t_accept"))
    t_kind = F.when(acc, "act").otherwise("ignore")
    t_intent = F.when(acc, F.col("t_intent"))
    t_slots = F.when(acc, F.coalesce(F.col("t_slots"), no_slots())).otherwise(no_slots())
    esc = F.col("route") == "escalate"
    kind = F.when(esc, t_kind).otherwise(F.col("route"))
    intent = F.when(esc, t_intent).when(F.col("route") == "act", F.col("intent"))
    slots = F.when(esc, t_slots).when(F.col("route") == "act", F.col("slot_values")) \
        .otherwise(no_slots())
    want = (F.col("true_addressed"), F.col("true_intent"), F.col("true_slots"))
    d = j.select(known.alias("known"), esc.alias("esc"),
                 outcome_correct(kind, intent, slots, *want).alias("hybrid"),
                 outcome_correct(t_kind, t_intent, t_slots, *want).alias("teacher"),
                 F.col("stt_ms").cast("double").alias("stt_ms"),
                 F.col("encode_ms").cast("double").alias("encode_ms"))
    k = F.col("known")
    a = d.groupBy().agg(
        count_if(k).alias("rows"), count_if(k & F.col("hybrid")).alias("h"),
        count_if(k & F.col("teacher")).alias("t"), count_if(k & F.col("esc")).alias("calls"),
        F.avg("stt_ms").alias("stt"), F.avg("encode_ms").alias("enc"))
    return a.where("rows > 0").select(
        "rows", rate(F.col("h"), F.col("rows")).alias("hybrid_correct"),
        rate(F.col("t"), F.col("rows")).alias("teacher_only_correct"),
        F.col("calls").alias("stt_calls_hybrid"), F.col("rows").alias("stt_calls_teacher_only"),
        F.round("stt", 2).alias("ms_teacher_only"),
        F.round(F.col("enc") + F.col("stt") * F.col("calls") / F.col("rows"), 2)
        .alias("ms_hybrid"))


def breakdown(j: DataFrame, key: str) -> DataFrame:
    wrong = ((F.col("route") == "ignore") & F.col("is_assist")) \
        | ((F.col("route") == "act") & ~F.col("act_ok"))
    return j.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("?")).alias(key)).agg(
        F.count(F.lit(1)).alias("n"),
        *[count_if(F.col("route") == r).alias(r) for r in V.ROUTES],
        F.round(F.avg(F.when(F.col("addr_ok"), 1.0).otherwise(0.0)), 4)
        .alias("addressed_accuracy"),
        count_if(wrong).alias("wrong_decisions"))


def worst_false_ignores(j: DataFrame, k: int = 10) -> DataFrame:
    return (j.where((F.col("route") == "ignore") & F.col("is_assist"))
            .select("id", F.round("p_assistant", 4).alias("p_assistant"))
            .orderBy("p_assistant", "id").limit(k))


def false_activations(j: DataFrame, order: str, k: int = 10) -> DataFrame:
    return (j.where((F.col("route") == "act") & F.col("non"))
            .select(order, "id", F.col("intent").alias("acted_as"),
                    F.col("true_addressed").alias("truth")).orderBy(order).limit(k))


def source_accuracy(by_source: DataFrame) -> DataFrame:
    """Weighted accuracy of real and of synthetic sources from a per-source breakdown."""
    def acc(names):
        here = F.col("source").isin(*names)
        return F.round(safe_div(
            F.sum(F.when(here, F.col("addressed_accuracy") * F.col("n"))),
            F.sum(F.when(here, F.col("n")))), 4)
    return by_source.groupBy().agg(
        acc(V.REAL_SOURCES).alias("real_addressed_acc"),
        acc(V.SYNTHETIC_SOURCES).alias("synthetic_addressed_acc"))


def holdout_rows(df: DataFrame, holdout_ids: DataFrame) -> DataFrame:
    return df.join(holdout_ids.select("id"), "id", "left_semi")


def sample_rows(df: DataFrame, limit: int, seed: int, row_id: str, order: list) -> DataFrame:
    """A uniform sample without replacement, in the original order.

    The same ids for the same seed in any partitioning; each partition only
    keeps ``limit`` candidates before the merge.
    """
    draw = F.xxhash64(F.lit(seed), F.col(row_id))
    return df.withColumn("__h", draw).orderBy("__h", row_id).limit(limit).drop("__h") \
        .orderBy(*order)


def latency_percentiles(df: DataFrame, value: Column, by: list[str] = (),
                        digits: int = 3) -> DataFrame:
    return quantiles(df, list(by), value, {"p50": 0.5, "p95": 0.95}, digits)


# -- the gate report ------------------------------------------------------------------------------

def gate_classes(df: DataFrame) -> DataFrame:
    """Per label: n, skipped, rate. Labels nobody has still get a row."""
    d = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                count_if(F.col("would_skip")).alias("skipped"))
    every = df.sparkSession.createDataFrame([(x,) for x in V.GATE_LABELS], "label string")
    return every.join(d, "label", "left").select(
        "label", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("skipped", F.lit(0)).alias("skipped"),
        rate(F.col("skipped"), F.col("n")).alias("skip_rate"))


def gate_headline(df: DataFrame) -> DataFrame:
    pos = F.col("label") == V.ASSISTANT
    a = df.groupBy().agg(
        F.count(F.lit(1)).alias("rows"), count_if(pos).alias("n"),
        count_if(pos & F.col("would_skip")).alias("k"),
        count_if(pos & (F.col("awaiting_answer") >= 0.5)).alias("asked"))
    return a.select("rows", rate(F.col("k"), F.col("n")).alias("false_skip_rate"),
                    F.round(wilson_upper(F.col("k"), F.col("n")), 4).alias("false_skip_upper95"),
                    F.col("asked").alias("asked_a_question_rows"))


def gate_worst_groups(df: DataFrame, keys=V.GROUP_KEYS) -> DataFrame:
    """For each grouping key: how many groups, and the one with the worst false-skip rate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"),
                                         F.col(k).cast("string").alias("value")) for k in keys]))
    per = (df.where(F.col("label") == V.ASSISTANT)
           .select(pairs.alias("p"), "would_skip").select("p.*", "would_skip")
           .where(F.coalesce("value", F.lit("")) != "")
           .groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"),
                                        count_if(F.col("would_skip")).alias("k")))
    r = F.col("k") / F.col("n")
    return per.groupBy("key").agg(
        F.count(F.lit(1)).alias("groups"),
        F.max_by(F.struct("value", "n", "k"),
                 F.struct(r.alias("r"), F.col("n"), F.col("value"))).alias("w")).select(
        "key", "groups", F.col("w.value").alias("worst"),
        rate(F.col("w.k"), F.col("w.n")).alias("worst_false_skip_rate"),
        F.col("w.n").alias("worst_n"))


def gate_misses(df: DataFrame, why: Column) -> DataFrame:
    return df.where((F.col("label") == V.ASSISTANT) & F.col("would_skip")).select(
        "row_id", "source", "speaker", "session", F.col("learned_confidence").alias("p"),
        why.alias("why"))


# -- the bench summary --------------------------------------------------------------------------

def bench_outcomes(df: DataFrame) -> DataFrame:
    """Adds ``correct`` to per-clip bench results."""
    return df.withColumn("correct", outcome_correct(
        F.col("decision"), F.col("intent"), F.col("slots"), F.col("gold_addressed"),
        F.col("gold_intent"), F.col("gold_slots")))


def bench_summary(df: DataFrame) -> DataFrame:
    """Per system: correctness, budgets, calls avoided and latency; rows need ``correct``."""
    assist = F.col("gold_addressed") == V.ASSISTANT
    act = F.col("decision") == "act"
    typed = assist & F.col("gold_intent").isNotNull() & (F.col("gold_intent") != V.OPEN_REQUEST)
    ok = is_true(F.col("correct"))
    d = df.select("system", assist.alias("assist"), act.alias("act"), typed.alias("typed"),
                  ok.alias("ok"), is_true(F.col("stt_called")).alias("stt"),
                  is_true(F.col("intent") == F.col("gold_intent")).alias("same"), "ms")
    a, t = F.col("assist"), F.col("act")
    facts = d.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("ok")).alias("ok"),
        count_if(~a & t).alias("fa"), count_if(~a).alias("non"),
        count_if(a & ~t).alias("miss"), count_if(a).alias("pos"),
        count_if(a & t).alias("served"), count_if(a & t & F.col("same")).alias("same"),
        count_if(F.col("typed")).alias("typed"),
        count_if(F.col("typed") & F.col("ok")).alias("typed_ok"),
        count_if(F.col("stt")).alias("calls"), F.avg("ms").alias("mean"))
    # Typed clips count in both sets, so all four ranks come from one pass.
    sets = d.select("system", "ms", F.explode(F.when(F.col("typed"), F.array(F.lit("typed"), F.lit("all")))
                                              .otherwise(F.array(F.lit("all")))).alias("set"))
    q = quantiles(sets, ["system", "set"], F.col("ms"), {"p50": 0.5, "p95": 0.95}, 2)
    ranks = q.groupBy("system").agg(*[
        F.max(F.when(F.col("set") == s, F.col(p))).alias(f"{name}{p}_ms")
        for s, name in (("all", ""), ("typed", "typed_")) for p in ("p50", "p95")])
    return facts.join(ranks, "system", "left").select(
        "system", F.col("n").alias("clips"), rate(F.col("ok"), F.col("n")).alias("correct"),
        *rate_columns("false_activation", F.col("fa"), F.col("non")),
        *rate_columns("missed", F.col("miss"), F.col("pos")),
        rate(F.col("same"), F.col("served")).alias("intent_accuracy_when_served"),
        rate(F.col("typed_ok"), F.col("typed")).alias("typed_correct"),
        F.col("calls").alias("stt_calls"),
        rate(F.col("n") - F.col("calls"), F.col("n")).alias("stt_avoided"),
        "p50_ms", "p95_ms", F.round("mean", 2).alias("mean_ms"), "typed_p50_ms", "typed_p95_ms")


def bench_shares(df: DataFrame, key: str) -> DataFrame:
    """Clips and share correct per system and ``key`` (category, decided_by)."""
    return df.groupBy("system", F.coalesce(F.col(key), F.lit("?")).alias(key)).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(is_true(F.col("correct")), 1.0).otherwise(0.0)), 4)
        .alias("correct"))


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, row_id: str) -> DataFrame:
    return first_ranked(df, keys, order, k, F.col(row_id))

"""Train, threshold and judge the multi-head model; sweep configurations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import is_true
from whofor.operators import gate as G
from whofor.operators import heads as H
from whofor.operators import metrics as Q
from whofor.operators import policy as P
from whofor.operators import splits as S
from whofor.operators.catalogue import CORE, Catalogue, by_intent
from whofor.operators.ordering import settle
from whofor.operators.quantiles import quantiles
from whofor.operators.router import StateColumns, Thresholds, route, tops, why_not_act
from whofor.session import cut_lineage


@dataclass(frozen=True)
class StudentTraining:
    targets: str = "mix"
    gold_weight: float = 0.5
    truth: str = "auto"
    fractions: tuple = (0.6, 0.2, 0.2)
    group_by: tuple = ("speaker",)
    seed: int = 0
    l2: float = 1e-4
    max_iter: int = 60
    max_false_ignore: float = 0.01
    max_wrong_act: float = 0.01
    max_false_activation: float = 0.01
    margin_z: float = 1.0
    allow_internal: bool = False


@dataclass
class StudentResult:
    model: H.HeadsModel
    report: DataFrame
    holdout_ids: DataFrame
    provenance: DataFrame
    card: dict


def act_facts(df: DataFrame, catalogue: Catalogue = CORE) -> DataFrame:
    """Scored rows with what the threshold search needs and no threshold changes."""
    d = tops(df, catalogue)
    permissive = Thresholds(act_addressed=0.0, act_intent=0.0, act_slot=0.0)
    bare = Catalogue(tuple({**i, "min_confidence": None} for i in catalogue.intents),
                     catalogue.name, catalogue.version)
    floors = by_intent(F.col("intent"), {i["name"]: i.get("min_confidence")
                                         for i in catalogue.intents}, 0.0)
    values = F.transform_values("slots", lambda k, v: v["value"])
    worst = F.array_min(F.transform(F.map_values("slots"), lambda v: v["p"]))
    d = d.withColumns({
        "actable": why_not_act(permissive, bare, StateColumns()).isNull(),
        "floor": floors.cast("double"), "p_slot": F.coalesce(worst, F.lit(1.0)),
        "is_assist": is_true(F.col("true_addressed") == V.ASSISTANT),
        "correct": Q.act_correct(F.col("intent"), values, F.col("true_addressed"),
                                 F.col("true_intent"), F.col("true_slots"))})
    return settle(d, ["actable", "floor", "p_slot", "is_assist", "correct"])


def search_facts(scored: DataFrame, catalogue: Catalogue = CORE) -> DataFrame:
    """The few columns the searches read, scored once and kept."""
    return cut_lineage(act_facts(scored, catalogue).select(
        "p_assistant", "p_intent", "p_slot", "floor", "actable", "correct", "is_assist"))


def choose_thresholds(scored: DataFrame, cfg: StudentTraining = StudentTraining(),
                      catalogue: Catalogue = CORE) -> tuple[Thresholds, dict]:
    """Thresholds within the error budgets on scored rows with truth columns."""
    facts = search_facts(scored, catalogue)
    t = G.choose_threshold(facts, F.col("p_assistant"), F.lit(True), F.col("is_assist"),
                           cfg.max_false_ignore).first()["threshold"]
    ignore_below = None if t is None else round(t, 6)
    best = Q.choose_act_thresholds(facts, ignore_below, cfg.max_wrong_act,
                                   cfg.max_false_activation, cfg.margin_z).first()
    if best is None:
        return Thresholds(ignore_below=ignore_below), {
            "act": "no threshold combination met the act budgets"}
    return Thresholds(ignore_below, best["act_addressed"], best["act_intent"],
                      best["act_slot"]), {"acts": best["acts"], "wrong": best["wrong"],
                                          "false_activations": best["false_act"]}


def full_report(j: DataFrame) -> DataFrame:
    """The headline row with ranking, calibration, slots, end-to-end and encode time joined on.

    Every part is one row, attached as scalars so nothing is multiplied. ``j`` is kept once, so
    rows are not scored again for each part.
    """
    j = cut_lineage(j)
    known = j.where("has_truth")
    p_top = F.col("p_who")
    parts = {
        "addressed_auc": F.round(Q.auc(known, F.col("p_assistant"), F.col("is_assist"))
                                 .scalar(), 4),
        "addressed_ece": F.round(Q.expected_calibration_error(known, p_top, F.col("addr_ok"))
                                 .scalar(), 4),
        "intent_ece": F.round(Q.expected_calibration_error(
            j.where("intent_row"), F.col("p_intent"), F.col("intent_ok")).scalar(), 4),
        "slot_accuracy": F.round(Q.slot_accuracy(j).select("accuracy").scalar(), 4),
        "encode_ms_p50": quantiles(j, [], F.col("encode_ms"), {"p50": 0.5}, 3)
        .select("p50").scalar()}
    names = ("hybrid_correct", "teacher_only_correct", "stt_calls_hybrid")
    e2e = Q.end_to_end(j).select(F.struct(*names)).scalar()
    d = Q.evaluate(j).withColumns({**parts, "__e2e": e2e})
    return d.withColumns({c: F.col(f"__e2e.{c}") for c in names}).drop("__e2e")


def train_student(rows: DataFrame, vectors: DataFrame, cfg: StudentTraining = StudentTraining(),
                  catalogue: Catalogue = CORE) -> StudentResult:
    """Join -> split by voice -> targets -> fit -> calibrate -> thresholds -> holdout report."""
    return train_joined(joined_rows(rows, vectors, cfg), encoder_name(vectors), cfg, catalogue)


def joined_rows(rows: DataFrame, vectors: DataFrame, cfg: StudentTraining) -> DataFrame:
    return H.join_vectors(rows.where(P.row_trainable(cfg.allow_internal)), vectors)


def encoder_name(vectors: DataFrame) -> str:
    return vectors.select("spec").first()["spec"] if "spec" in vectors.columns else ""


def train_joined(d: DataFrame, spec: str, cfg: StudentTraining = StudentTraining(),
                 catalogue: Catalogue = CORE) -> StudentResult:
    """``train_student`` on rows that have their vectors."""
    if cfg.targets in ("teacher", "mix"):
        d = d.where(F.size("t_addressed") > 0)
    d = S.group_split(d, cfg.group_by, cfg.fractions, cfg.seed, "id")
    d = H.build_targets(Q.truth(d, cfg.truth), catalogue, cfg.targets, cfg.gold_weight)
    d = cut_lineage(d)
    sizes = {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    for k, name in enumerate(("train", "select", "holdout")):
        if not sizes.get(k):
            raise ValueError(f"the {name} split is empty; add data or change the grouping")
    train, select, holdout = (d.where(F.col("split") == k) for k in range(3))
    model = H.fit_heads(train, catalogue, encoder=spec, l2=cfg.l2, max_iter=cfg.max_iter)
    model = H.calibrated(select, model)
    thresholds, info = choose_thresholds(H.score_heads(select, model), cfg, catalogue)
    model.thresholds = thresholds
    routed = route(H.score_heads(holdout, model), thresholds, catalogue)
    card = {"targets": cfg.targets, "splits": sizes, "selection": info, "encoder": spec,
            "thresholds": thresholds}
    model.card = card
    return StudentResult(model, full_report(Q.judged(routed, cfg.truth)), holdout.select("id"),
                         P.provenance_summary(d.where("split < 2"), "clips"), card)


def sweep(rows: DataFrame, encoders: dict[str, DataFrame], targets, seeds,
          cfg: StudentTraining = StudentTraining(), catalogue: Catalogue = CORE) -> DataFrame:
    """One row of metrics per (encoder, targets, seed).

    The loop is over configurations, a handful; each run is a set of distributed jobs over the
    whole table. Vectors are joined once an encoder.
    """
    out = None
    for spec, vectors in encoders.items():
        joined, name = cut_lineage(joined_rows(rows, vectors, cfg)), encoder_name(vectors)
        for mode in targets:
            for seed in seeds:
                r = train_joined(joined, name, replace(cfg, targets=mode, seed=seed), catalogue)
                row = cut_lineage(sweep_row(r.report, spec, mode, seed))
                out = row if out is None else out.unionByName(row)
    return out


def sweep_row(report: DataFrame, encoder: str, targets: str, seed: int,
              by_source: DataFrame | None = None) -> DataFrame:
    acc = Q.source_accuracy(by_source) if by_source is not None else None

    def part(name):
        return F.lit(None).cast("double") if acc is None else acc.select(name).scalar()
    cols = {
        "encoder": F.lit(encoder), "targets": F.lit(targets), "hidden": F.lit(0),
        "seed": F.lit(seed), "rows_holdout": F.col("rows"), "stt_avoided": F.col("stt_avoided"),
        "act": F.col("act"), "ignore": F.col("ignore"), "escalate": F.col("escalate"),
        "false_ignore": F.col("false_ignore_rate"),
        "false_ignore_up95": F.col("false_ignore_upper95"),
        "false_activation": F.col("false_activation_rate"),
        "false_activation_up95": F.col("false_activation_upper95"),
        "wrong_act": F.col("wrong_act_rate"), "typed_acted": F.col("typed_acted_rate"),
        "addressed_acc": F.col("addressed_accuracy"), "addressed_auc": F.col("addressed_auc"),
        "addressed_ece": F.col("addressed_ece"), "intent_acc": F.col("intent_accuracy"),
        "slot_acc": F.col("slot_accuracy"), "hybrid_correct": F.col("hybrid_correct"),
        "teacher_correct": F.col("teacher_only_correct"),
        "encode_ms_p50": F.col("encode_ms_p50"),
        "real_addressed_acc": part("real_addressed_acc"),
        "synthetic_addressed_acc": part("synthetic_addressed_acc")}
    return report.select(*[cols[c].alias(c) for c in V.SWEEP_COLUMNS])


def sweep_summary(results: DataFrame) -> DataFrame:
    """Mean and population deviation over seeds, one row per configuration."""
    metrics = ("stt_avoided", "false_ignore", "false_activation", "wrong_act", "typed_acted",
               "addressed_auc", "intent_acc", "hybrid_correct", "teacher_correct",
               "real_addressed_acc", "encode_ms_p50")
    return results.groupBy("encoder", "targets", "hidden").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(m).alias(f"{m}_{k}") for m in metrics
          for k, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def sweep_markdown(summary: DataFrame) -> DataFrame:
    """The summary as table lines, one per configuration."""
    metrics = [c[:-5] for c in summary.columns if c.endswith("_mean")]

    def cell(m):
        mean, sd = F.col(f"{m}_mean"), F.col(f"{m}_sd")
        return F.when(mean.isNull(), "–").when(F.col("n") == 1, F.format_string("%.3f", mean)) \
            .otherwise(F.format_string("%.3f ± %.3f", mean, sd))
    return summary.select("encoder", "targets", "hidden", F.concat(
        F.lit("| "), F.concat_ws(" | ", "encoder", "targets", F.col("hidden").cast("string"),
                                 F.col("n").cast("string"), *[cell(m) for m in metrics]),
        F.lit(" |")).alias("line"))


# -- the fast path ---------------------------------------------------------------------------------

def fast_path_problem(model: H.HeadsModel, encoder: str, catalogue: Catalogue = CORE) -> str | None:
    """Why a model must not be used with this encoder and catalogue, or None."""
    if encoder != model.encoder:
        return f"model was trained on {model.encoder}, encoder is {encoder}"
    untrained = sorted(set(catalogue.names) - set(model.classes["intent"]))
    return f"intents the model was not trained on: {', '.join(untrained)}" if untrained else None


def fast_decision(df: DataFrame, model: H.HeadsModel, encoder: str,
                  catalogue: Catalogue = CORE, state: StateColumns = StateColumns(),
                  thresholds: Thresholds | None = None) -> DataFrame:
    """Routed rows; a vector that cannot be scored escalates with p = 0."""
    problem = fast_path_problem(model, encoder, catalogue)
    if problem:
        raise ValueError(problem)
    t = model.thresholds or Thresholds()
    t = t.tighten(thresholds) if thresholds is not None else t
    d = route(H.score_heads(df, model), t, catalogue, state)
    ok = F.col("addressed").isNotNull()
    return d.withColumns({
        "route": F.when(ok, F.col("route")).otherwise("escalate"),
        "reason": F.when(ok, F.col("reason")).otherwise("the vector could not be scored"),
        "who": F.when(ok, F.col("who")).otherwise(V.ASSISTANT),
        "p_who": F.when(ok, F.col("p_who")).otherwise(0.0),
        "intent": F.when(ok & (F.col("route") != "ignore"), F.col("intent")),
        "p_intent": F.when(ok & (F.col("route") != "ignore"), F.col("p_intent"))})


def evaluate_sessions(model: H.HeadsModel, rows: DataFrame, vectors: DataFrame,
                      sessions: list[str], awaiting_answer: bool = False,
                      catalogue: Catalogue = CORE) -> DataFrame:
    """The full report on chosen recorded sessions, cold or with a question open."""
    from whofor.sources.sessions import session_data
    r, v = session_data(rows, vectors, sessions, model.encoder)
    state = StateColumns(since_ai=F.lit(2.0), awaiting_answer=F.lit(True)) if awaiting_answer \
        else StateColumns()
    joined = H.join_vectors(r, v.withColumn("seq", F.lit(0)) if "seq" not in v.columns else v)
    routed = route(H.score_heads(joined, model), model.thresholds or Thresholds(), catalogue,
                   state)
    return full_report(cut_lineage(Q.judged(routed)))

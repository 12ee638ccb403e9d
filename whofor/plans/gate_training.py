"""Train, threshold and judge a logistic gate from a feature table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.operators import gate as G
from whofor.operators import gate_model as M
from whofor.operators import metrics as Q
from whofor.operators import policy as P
from whofor.operators import splits as S
from whofor.session import cut_lineage

SPLITS = ("train", "select", "holdout")


@dataclass(frozen=True)
class GateTraining:
    max_false_skip: float = 0.01
    max_threshold: float = 0.5
    fractions: tuple = (0.6, 0.2, 0.2)
    group_by: tuple = ("speaker", "session", "room")
    seed: int = 0
    l2: float = 1.0
    allow_internal: bool = False
    protect_wearer: bool = True
    ignore_uncertain: bool = False


@dataclass
class GateResult:
    model: G.GateModel
    refused: DataFrame
    counts: DataFrame
    headline: DataFrame          # split, layer, false_skip_rate, ...
    provenance: DataFrame
    misses_target: bool


def decided(rows: DataFrame, model: G.GateModel | None, protect: bool = True) -> DataFrame:
    """Stored feature rows with the decision the gate makes on them (shadow mode)."""
    return G.gate_decide(rows, G.context_from_features(), "shadow", model,
                         learned=model is not None, protect_wearer=protect)


def _headline(rows: DataFrame, split: str, layer: str) -> DataFrame:
    return Q.gate_headline(rows).select(F.lit(split).alias("split"), F.lit(layer).alias("layer"),
                                        "*")


def train_gate(rows: DataFrame, cfg: GateTraining = GateTraining()) -> GateResult:
    """Policy -> split -> fit -> calibrate -> threshold -> report. Needs ``row_id``."""
    allowed: Column = P.gate_trainable(cfg.allow_internal)
    refused = P.refusal_report(rows, allowed)
    usable = rows.where(allowed & F.col("label").isin(*V.GATE_LABELS))
    split = cut_lineage(S.group_split(usable, cfg.group_by, cfg.fractions, cfg.seed))
    if S.check_disjoint(split, cfg.group_by).limit(1).count():
        raise RuntimeError("a key value spans two splits")
    problem = S.split_problem(split, len(cfg.fractions)).limit(1).collect()
    if problem:
        raise ValueError(f"{SPLITS[problem[0]['split']]}: {problem[0]['problem']}")
    train, select, holdout = (split.where(F.col("split") == k) for k in range(3))
    model = M.platt_calibrate(select, M.fit_logistic(train, cfg.l2))
    model = M.rounded(model, None)
    protected = [V.ASSISTANT] + ([] if cfg.ignore_uncertain else [V.UNCERTAIN])
    scored = G.eligibility(select, model, cfg.protect_wearer)
    t = G.choose_threshold(scored, F.col("p"), F.col("may_skip"),
                           F.col("label").isin(*protected), cfg.max_false_skip,
                           cfg.max_threshold).first()["threshold"]
    model = replace(model, threshold=round(t, 6))
    headline = _headline(decided(select, model, cfg.protect_wearer), "select", "model")
    for layer, m in (("model", model), ("rules", None)):
        headline = headline.unionByName(_headline(
            decided(holdout, m, cfg.protect_wearer), "holdout", layer))
    headline = cut_lineage(headline)
    seen = headline.where("split = 'holdout' and layer = 'model'").first()["false_skip_rate"]
    return GateResult(model, refused, S.split_counts(split), headline,
                      P.provenance_summary(split.where("split < 2")),
                      (seen or 0.0) > cfg.max_false_skip)


def evaluate_gate(rows: DataFrame, model: G.GateModel | None = None,
                  protect: bool = True) -> DataFrame:
    """Per layer: the headline on unseen labelled rows; rules always, the model when given."""
    known = rows.where(F.col("label").isin(*V.GATE_LABELS))
    out = _headline(decided(known, None, protect), "unseen", "rules")
    if model is not None:
        out = out.unionByName(_headline(decided(known, model, protect), "unseen", "model"))
    return out.drop("split")

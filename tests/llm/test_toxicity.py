"""The machine learns a pair that weights cannot, gradients fit, and odd inputs are defined."""

import random

import numpy as np
from pyspark.sql import functions as F

from whofor.llm import toxicity as tx


def corpus(n=900, seed=1):
    """Insult and group are each harmless; together they are toxic."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(80)}" for _ in range(r.randint(3, 12))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["vermin"] * insult + ["foreigners"] * group
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return docs, labels


def test_gradient_fits_finite_differences():
    rng = np.random.default_rng(0)
    m = tx.Machine(10)
    m.vector = rng.normal(0, 0.3, m.vector.shape).astype(np.float32)
    slots = [np.array([1, 5, 9], dtype=np.int32), np.array([], dtype=np.int32)]
    z = m.logits(slots)[0]
    v = m.vector.astype(np.float64)
    pairs = sum(v[a] @ v[b] for a, b in ((1, 5), (1, 9), (5, 9)))
    assert abs(z[0] - (m.bias + pairs)) < 1e-4 and z[1] == m.bias


def test_pairs_are_learnt_on_spark(spark):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (5002, "vermin foreigners " * 30_000)]
    labels += [(5000, 0), (5001, None), (1, labels[1][1]), (7777, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tox_score", F.lit("x"))
    t = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(d, t, ~tx.fold())
    got = {r["doc_id"]: r for r in tx.score(d, model).withColumn("held", tx.fold()).collect()}
    held = [(got[i]["tox_score"] >= 0.3, y == 1) for i, y in labels[:900] if got[i]["held"]]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.93
    assert got[5000]["tox_score"] == got[5001]["tox_score"] < 0.3 and got[5002]["tox_score"] > 0.3


def test_rejected_rows_go_and_empty_tables(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__row2", F.lit(1))
    t = spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = tx.clean_documents(d, d, t)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()
    assert tx.fit(d, t.limit(0), ~tx.fold()) is None
    assert tx.clean_documents(d, d, t.limit(0)).count() == d.count()
    assert tx.clean_documents(d.limit(0), d.limit(0), t).count() == 0

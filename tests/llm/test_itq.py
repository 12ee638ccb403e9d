"""Vector links against all pairs; recall at the threshold; balance of the codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from whofor.llm import itq


def brute(rows, threshold=0.93):
    good = {}
    for k, v, lab in rows:
        if k is None or v is None or lab is None or not len(v) or any(x is None for x in v):
            continue
        v = np.array(v, dtype=float)
        if np.isfinite(v).all() and (v != 0).any():
            v = v / abs(v).max()
            good.setdefault(k, (v / np.linalg.norm(v), lab))
    links, up = {k: 0 for k, _, _ in rows}, {k: k for k, _, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k
    keys = sorted(good)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            (x, la), (y, lb) = good[a], good[b]
            if la == lb and len(x) == len(y) and float(x @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {k: (links[k], root(k) if k is not None else None, k is None or root(k) == k) for k in links}


def corpus():
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for lab in (1, 2, None):
        for _ in range(25):
            base = rng.normal(size=24)
            for _ in range(int(rng.integers(1, 12))):
                v = (base + 0.25 * rng.normal(size=24) * rng.random()).astype(np.float32)
                rows.append((k, [float(x) for x in v], lab))
                k += 1
    rows += [(k + 1, rows[0][1], 1), (k + 2, rows[0][1], 1), (k + 2, rows[0][1], 1),
             (k + 3, [0.0] * 24, 1), (k + 4, [float("nan")] * 24, 1), (k + 5, None, 1), (k + 6, [], 1),
             (k + 7, [None] + [1.0] * 23, 1), (k + 8, [float("inf")] + [1.0] * 23, 1),
             (None, rows[0][1], 1), (k + 9, rows[0][1][:12], 1), (k + 10, rows[0][1][:12], 1),
             (k + 11, [1e300] * 24, 2), (k + 12, [1e-300] * 24, 2)]
    return rows


@pytest.mark.parametrize("block", [7, 2048])
def test_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int") \
        .withColumn("d", F.lit("x"))
    got = itq.near_vectors(df, miss=1e-6).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert itq.near_vectors(df).count() == 0


def test_recall_at_the_threshold_and_balance():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    y = x + 0.39 * rng.normal(size=x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    near = (x * y).sum(1) >= 0.93
    bits, tables = 8, itq.tables_for(8, 0.93, 1e-3)
    model = itq.learn(x, bits * tables)
    a, b = itq.encode(x, *model, bits), itq.encode(y, *model, bits)
    assert near.sum() > 500 and (a == b).any(axis=1)[near].mean() > 0.98
    assert np.bincount(a[:, 0], minlength=256).max() < 20 * len(x) / 256


@pytest.mark.parametrize("common", [0.0, 0.7, 0.9])
def test_recall_with_a_common_component(common):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x = (1 - common ** 2) ** 0.5 * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += common
    y = x + 0.37 / 8 * rng.normal(size=x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    near = (x * y).sum(1) >= 0.93
    bits, tables = itq.fitting(12, 0.93, 1e-3, itq.least_norm(x))
    model = itq.learn(x, bits * tables, rounds=5)
    a, b = itq.encode(x, *model, bits), itq.encode(y, *model, bits)
    assert near.sum() > 1000 and (a == b).any(axis=1)[near].mean() >= 0.998


def test_no_bits_make_one_table():
    assert itq.fitting(9, 0.93, 1e-3, 0.01) == (0, 1)
    x = np.eye(4)
    assert itq.encode(x, *itq.learn(x, 0), 0).tolist() == [[0]] * 4

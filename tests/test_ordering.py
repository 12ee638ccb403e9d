"""Ordered helpers against plain windows, with one key holding most rows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from whofor.operators import ordering as O
from whofor.operators.context import situate
from whofor.operators.quantiles import quantiles, running_sums


def skewed(spark, n=3000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 11).otherwise(0).alias("k"),
        ((F.col("id") * 7919) % 5000).cast("double").alias("t"), "id")


def test_positions_and_carry_match_plain_windows(spark):
    d = skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    v = F.when(F.col("id") % 5 == 0, F.col("id"))
    want = d.withColumn("pos", F.row_number().over(w) - 1).withColumn(
        "last", F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    got = O.number_rows(d, ["k"], ["t", "id"], F.floor(F.col("t") / 100).cast("long"))
    got = O.carry_last(got, ["k"], v, "last", size=64)
    assert sorted(map(tuple, got.select("id", "pos", "last").collect()), key=str) == \
        sorted(map(tuple, want.select("id", "pos", "last").collect()), key=str)


def test_overlapping_runs_see_their_neighbours(spark):
    d = skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    d = d.withColumn("pos", F.row_number().over(w) - 1)
    frame = w.rowsBetween(-7, 3)
    want = {r["id"]: r["s"] for r in d.withColumn("s", F.sum("id").over(frame)).collect()}
    runs = O.overlap(d, ["k"], back=7, ahead=3, size=50)
    got = O.own_rows(runs.withColumn(
        "s", F.sum("id").over(O.run_window(["k"]).rowsBetween(-7, 3))))
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_first_ranked_is_exact_for_a_hot_key(spark):
    got = O.first_ranked(skewed(spark), ["k"], ["t", "id"], 5, F.col("id"))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed(spark).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    assert {(r["k"], r["id"], r["rank"]) for r in got.collect()} == \
        {(r["k"], r["id"], r["rank"]) for r in want.collect()}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = [float(x) for x in np.concatenate([rng.normal(0, 50, 500), [5.0] * 300, [-2.0] * 40])]
    d = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "k int, v double")
    for r in quantiles(d, ["k"], F.col("v"), {"a": 0.05, "b": 0.5, "c": 0.95}).collect():
        mine = [v for i, v in enumerate(values) if i % 2 == r["k"]]
        np.testing.assert_allclose([r["a"], r["b"], r["c"]], np.percentile(mine, [5, 50, 95]))


def test_running_sums(spark):
    d = spark.createDataFrame([(float(i), i) for i in range(-50, 200)], "v double, n long")
    got = {r["v"]: r["n_before"] for r in running_sums(d, "v", ["n"]).collect()}
    total = 0
    for i in range(-50, 200):
        assert got[float(i)] == total
        total += i


def test_situate_matches_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(4):
        t = 0.0
        for k in range(400 if c == 0 else 60):
            t += float(rng.choice([2.0, 9.0, 30.0, 4000.0], p=[0.5, 0.3, 0.19, 0.01]))
            rows.append((c, t, k, str(rng.choice(["user", "assistant"])), f"t{k}"))
    d = spark.createDataFrame(rows, "conv_id long, at_s double, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in situate(d).collect()}
    for c in range(4):
        pos = upos = 0
        ai = user = prev = start = None
        for _, t, k, role, text in [r for r in rows if r[0] == c]:
            g = got[(c, k)]
            assert g["pos"] == pos
            assert g["last_ai_text"] == (ai[1] if ai else "")
            assert g["last_user_text"] == (user or "")
            if role == "user":
                gap = None if prev is None else t - prev
                start = upos if gap is None or gap > 25 else start
                assert (g["upos"], g["episode"]) == (upos, start)
                assert (g["gap_s"] is None) == (gap is None)
                upos, prev, user = upos + 1, t, text
            else:
                ai = (t, text)
            pos += 1


def test_ranges_stay_bounded_where_values_are_massed(spark):
    """A calibrated score: almost all distinct values next to 0 and 1."""
    from whofor.operators.quantiles import ranged
    rng = np.random.default_rng(8)
    v = np.concatenate((rng.random(4000) * 1e-6, 1 - rng.random(4000) * 1e-6, rng.random(200)))
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in ranged(d, ["v"]).groupBy("__b").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 3 * len(v) / len(sizes)
    got = quantiles(d, [], F.col("v"), {"a": 0.25, "b": 0.75}).first()
    assert np.allclose([got["a"], got["b"]], np.quantile(v, [0.25, 0.75]), rtol=0, atol=1e-12)

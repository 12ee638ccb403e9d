"""Held-out accuracy, the kernel against its definition, and the odd inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from whofor.llm import language as li

SEEDS = {"aa": "tha ren ing ow", "bb": "schei unge ver ach", "cc": "ión ado mente que"}


def corpus(n=240):
    r = random.Random(7)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(SEEDS))
        words = ["".join(r.choices(SEEDS[lang].split(), k=2)) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_odd_inputs(spark):
    rows = corpus() + [(900, None, "aa"), (901, "", "aa"), (902, "12 .. 3", "bb"), (903, "é", None),
                       (904, "ungeach " * 60_000, None), (905, "ungeach", "bb"), (905, "ungeach", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_score", F.lit("x"))
    model = li.fit(df, "text", "lang", F.col("doc_id") % 2 == 0, per_language=6)
    got = li.identify(df, model)
    assert sorted(got.columns) == ["doc_id", "lang", "lang_pred", "lang_score", "text"]
    by = {r["doc_id"]: r for r in got.collect()}
    held = [by[i] for i, _, _ in rows[:240] if i % 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(by[i]["lang_pred"] == "und" and by[i]["lang_score"] == 0 for i in (900, 901, 902))
    assert by[904]["lang_pred"] == by[905]["lang_pred"] == "bb" and by[903]["lang_pred"] in SEEDS
    assert all(0 <= r["lang_score"] <= 1 for r in by.values())


def test_nothing_to_learn_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = li.fit(df, "text", "lang", F.lit(True))
    assert model is None and li.identify(df, model).first()["lang_pred"] == "und"
    assert li.identify(df.limit(0), model).count() == 0


def test_presence_is_a_normalised_kernel():
    texts = [b"Abc abc", b"abc", b"xyz", b"abcabcabc " * 50]
    rows = li.presence(texts)
    kernel = rows @ rows.T
    assert np.allclose(np.diag(kernel), 1, atol=1e-5)
    assert kernel[0, 1] > kernel[1, 2] and np.allclose(li.presence([b"abc   abc"]), li.presence([b"abc abc"]))

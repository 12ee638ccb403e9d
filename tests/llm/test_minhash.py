"""Near copies against all pairs compared by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from whofor.llm import graph
from whofor.llm import minhash as mh


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


def corpus(seed=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß"]
    rows, key = [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"),
                 (905, "two one"), (906, "a b c d e f")], 0
    for _ in range(14):
        base = r.choices(vocab, k=r.randint(6, 260))
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocab)
            base = w if r.random() < 0.5 else base
            rows.append((key, " ".join(w).upper() if r.random() < 0.3 else "\n".join(w)))
            key += 1
    return rows


@pytest.mark.parametrize("seed", [4, 5])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in mh.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want and any(c != k for k, (_, c, _) in want.items())


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, long),
            (4, long + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = sorted(map(tuple, mh.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (None, 2, None, True),
                         (3, 39_996, 3, True), (4, 39_997, 3, False)], key=repr)
    kept = mh.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert mh.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(7, k) for k in range(500, 900)] + [(50, 51), (51, 50), (60, 60)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {k for k in got} == set(range(100, 401)) | {7, 50, 51} | set(range(500, 900))
    assert all(got[k] == 100 for k in range(100, 401)) and got[899] == 7 and got[51] == 50


def test_units_find_what_the_first_comparison_misses(spark, monkeypatch):
    """A family whose smallest member is far from most: links run along edits, in small blocks."""
    monkeypatch.setattr(mh, "BLOCK", 4)
    r = random.Random(9)
    for length in (150, 700):
        w, rows = [f"v{r.randrange(10 ** 6)}" for _ in range(length)], []
        for k in range(40):
            w = list(w)
            for _ in range(length // 75):
                w[r.randrange(length)] = f"v{r.randrange(10 ** 6)}"
            rows.append((k, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"])
               for x in mh.near_duplicates(df, broadcast_rows=0).collect()}
        assert got == brute(rows)

"""Spelling variants against all pairs of words compared by brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from whofor.llm import spelling
from whofor.llm.queries import QUERIES


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, slip=97, least=3):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if slip and h % slip == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            total[word] += 1
    n = {w: c for w, c in total.items() if len(w) >= 5 and c >= least}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdeEnstéÖß÷×"
    stems = ["".join(r.choices(letters, k=r.randint(4, 9))) for _ in range(60)]
    stems += ["".join(r.sample("abcdefg", 7)) for _ in range(40)]

    def variant():
        w = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            at = r.randrange(len(w) + 1)
            w[at:at + r.choice([0, 1])] = r.choice(["", r.choice(letters)])
        return "".join(w)
    rows = [(k, r.choice([" ", "-", "7", "_", "ā", "\n"]).join(variant() for _ in range(r.randint(1, 80))))
            for k in range(150)]
    return rows + [(900, None), (901, ""), (902, "12 34"), (None, stems[0] * 2 + " " + stems[1]), rows[0], rows[0],
                   (903, " ".join(stems) * 30)]


FIELDS = ("word", "n", "n_near", "form", "form_n", "root")


@pytest.mark.parametrize("seed,unit,top", [(1, 8192, 20_000), (2, 3, 10 ** 9)])
def test_words_equal_brute_force(spark, seed, unit, top, monkeypatch):
    """Also where subtrees are split to the last count and cut into blocks of one word."""
    monkeypatch.setattr(spelling, "TOP", top)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n")
    got = spelling.spelling_variants(df.repartition(5), slip=97, unit_words=unit)
    assert tuple(got.columns) == FIELDS
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[3] is not None for r in want) > 20


def test_registered_query(spark, tmp_path):
    rows = corpus(4)
    pq.write_table(pa.table({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": [t for _, t in rows],
                             "n": ["clash"] * len(rows)}), str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_spelling"](spark, str(tmp_path))
    assert sorted(tuple(r[f] for f in FIELDS) for r in got.collect()) == plain(rows)


def test_chain_of_forms_ends_at_its_root(spark):
    words = ["aaaaa" + "b" * k for k in range(9)]
    rows = [(k, (w + " ") * 3 * 2 ** k) for k, w in enumerate(words)]
    got = {r["word"]: r["root"] for r in spelling.spelling_variants(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w: words[-1] for w in words}


def test_empty_table_long_text_and_very_long_words(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(df).count() == 0
    long = "q" * 50_000
    rows = [(1, (long + " ") * 3 + (long[1:] + "z ") * 9 + "hello " * 300_000)]
    got = {r["word"]: r["form"] for r in spelling.spelling_variants(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {long: long[1:] + "z", long[1:] + "z": None, "hello": None}


@pytest.mark.parametrize("leaf,pairs", [(64, 1 << 20), (1, 1), (3, 40)])
def test_search_equals_all_pairs(leaf, pairs, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    r = random.Random(9)
    words = list({"".join(r.choices("abcdq", k=r.randint(1, 5))) for _ in range(500)})
    n = np.array([r.randint(1, 4) for _ in words])
    home = len(words) // 2
    got = {words[i]: (c, m, words[f]) for i, c, m, f in zip(*(x.tolist() for x in spelling.near_words(words, n, home)))}
    at, want = dict(zip(words, n.tolist())), {}
    for i, a in enumerate(words):
        near = [b for j, b in enumerate(words) if one_apart(a, b) and min(i, j) < home]
        if near:
            best = min(near, key=lambda b: (-at[b], b))
            want[a] = (len(near), at[best], best)
    assert got == want and len(got) > 100


def test_one_edit_equals_the_plain_test():
    r = random.Random(7)
    words = sorted({"".join(r.choices("ab", k=r.randint(1, 6))) for _ in range(300)})
    codes = spelling.letters(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if abs(len(a) - len(b)) <= 1:
                got = spelling.one_edit(codes[[i]], codes[[j]], len(a), len(b))[0, 0]
                assert bool(got) == one_apart(a, b), (a, b)
    assert np.array_equal(spelling.vectors(codes)[:, 0], [len(w) for w in words])

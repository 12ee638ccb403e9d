"""Buckets against the CRC of each feature's own bytes; the draw against a plain loop."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from whofor.llm import resample
from whofor.llm.queries import QUERIES


def features(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def buckets(text):
    return [zlib.crc32(f.encode()) % 10_000 for f in features(text)[1]]


def plain(rows, target):
    s, t = [0] * 10_000, [0] * 10_000
    for _, text in rows:
        for b in buckets(text):
            s[b] += 1
    for text in target:
        for b in buckets(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1.0) * (sum(s) + 10_000) / ((x + 1.0) * (sum(t) + 10_000))))
            for x, y in zip(s, t)]
    out = []
    for key, text in rows:
        words, found = features(text)
        weight = sum(gain[b] for b in buckets(text))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                    None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["Été", "a", "word", "X1", "straße", "日本語", "q" * 40] + [f"w{i}" for i in range(300)]

    def text(n):
        return "".join(r.choice(vocab) + r.choice([" ", "  ", ", ", "_", "\n", "\x00"]) for _ in range(n))
    rows = [(k, text(r.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for k in range(300)]
    rows += [(500, None), (501, ""), (502, "--"), (None, text(30)), (503, text(4000)), (504, "z" * 3000 + " " + "y" * 700),
             (505, ("u" * 300 + " ") * 25)]
    return rows + rows[:4], [text(50) for _ in range(20)] + [None, ""]


def test_buckets_equal_the_crc_of_each_feature(monkeypatch):
    rows, _ = corpus(1)
    texts = [None if t is None else t.encode() for _, t in rows]
    for chunk in (resample.CHUNK, 1, 7):
        monkeypatch.setattr(resample, "CHUNK", chunk)
        got = [[] for _ in texts]
        for mine, found in resample.feature_buckets(texts, 10_000):
            for i, b in zip(mine.tolist(), found.tolist()):
                got[i].append(b)
        assert [sorted(x) for x in got] == [sorted(buckets(t)) for _, t in rows]


def test_shift_cancels_for_every_length():
    r = random.Random(2)
    for n in [*range(0, 600), 70_000, 1 << 20]:
        a, b = r.randbytes(9), r.randbytes(n)
        got = resample.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ zlib.crc32(a + b)
        assert int(got) == zlib.crc32(b)


@pytest.mark.parametrize("seed", [3, 4])
def test_registered_query(spark, tmp_path, seed):
    rows, target = corpus(seed)
    pq.write_table(pa.table({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": [t for _, t in rows],
                             "weight": ["clash"] * len(rows)}), str(tmp_path / "documents.parquet"))
    pq.write_table(pa.table({"item_id": list(range(len(target))), "text": target}), str(tmp_path / "benchmark.parquet"))
    got = QUERIES["op13_resample"](spark, str(tmp_path)).collect()
    want = plain(rows, target)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got), key=str) == want
    assert sum(r[4] is not None for r in want) > 3


def test_target_like_documents_are_drawn_more_often(spark):
    r = random.Random(5)
    near, far = [f"n{i}" for i in range(50)], [f"f{i}" for i in range(50)]
    rows = [(k, " ".join(r.choices(near if k % 10 == 0 else far, k=25))) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([(" ".join(near),)], "text string")
    out = resample.importance_resample(docs.withColumn("rank", F.lit("x")).withColumn("lang", F.lit("en")), target)
    assert out.columns == ["doc_id", "lang", "n_features", "n_words", "weight", "score", "rank"]
    ranks = sorted((x["rank"], x["doc_id"]) for x in out.where("rank is not null").collect())
    assert [k for k, _ in ranks] == list(range(1, 51)) and all(d % 10 == 0 for _, d in ranks)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")
    assert resample.importance_resample(none, some).count() == 0
    (row,) = resample.importance_resample(some, none, share=(1, 1)).collect()
    assert row["rank"] == 1 and row["n_words"] == 90

"""Encoding against the reference tokenizer library, and window search against brute force."""

import hashlib
import random
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

from whofor.llm import bpe
from whofor.llm import decontaminate as wm

TEXTS = [None, "", " ", "\n\n  x", "It's we'll DON'T 123 4567 ³½ …—", "naïve Ünïcödé 漢字かな 🙂🙂",
         "a\u001c\u001db\u0085c d e", "x" * 5000, "tab\tand\r\nline  end ", "of the of the"]


def test_ids_equal_the_library_and_decode_back(spark):
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(TEXTS * 2)],
                                 "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(docs, bpe.tokenizer_path(), bpe.default_pattern(), keep=4)
    assert sorted(got.columns) == ["decoded", "doc_id", "n_tokens", "text", "token_ids"]
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(bpe.tokenizer_path()))}
    library = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks,
                                special_tokens={})
    rows = {r["doc_id"]: r for r in bpe.digests(got).collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS * 2):
        ids = library.encode_ordinary(t or "")
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table_encodes_to_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode_decode(docs, bpe.tokenizer_path(),
                                         bpe.default_pattern())).count() == 0


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = {}
    for key, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            iw = words_of(t)
            m = min(13, len(iw))
            windows = {tuple(iw[i:i + m]) for i in range(len(iw) - m + 1)} if m else set()
            for i in range(len(words) - m + 1 if m else 0):
                if tuple(words[i:i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found.add("" if item is None else str(item))
        out[key] = (len(words), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("shard_words", [20, 200_000])
def test_windows_equal_brute_force(spark, shard_words, monkeypatch):
    monkeypatch.setattr(wm, "PIECE", 17)
    r = random.Random(5)
    vocab = ["a", "b", "C", "é", "7", "dd"]
    items = [(1, "a"), (2, None), (3, "..."), (10, "b b C"), (None, "dd é é dd")]
    items += [(20 + k, " ".join(r.choices(vocab, k=r.randint(10, 60)))) for k in range(6)]
    items += [(20, "B b c")]
    docs = [(0, None), (1, ""), (2, "-- !!"), (3, "A"), (4, items[5][1].replace(" ", ", "))]
    for k in range(30):
        some = r.choices(vocab[1:], k=r.randint(1, 40))
        some[r.randint(0, len(some)):0] = words_of(r.choice(items)[1])[:r.randint(3, 40)]
        docs.append((10 + k, " ".join(some)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["item_ids"])
           for x in wm.find_items(df, bench, shard_words=shard_words).collect()}
    assert got == brute(docs, items)


def test_empty_benchmark_and_kept_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "q"), (1, "a b", "q"), (2, None, None)],
                                 "doc_id long, text string, n_words string")
    none = spark.createDataFrame([], "item_id long, text string")
    kept = wm.clean_documents(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r["doc_id"] for r in wm.clean_documents(docs, one).collect()] == [2]

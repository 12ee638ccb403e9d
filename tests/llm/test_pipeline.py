"""The pipeline on planted cases, against what plain loops keep; every query on a small table."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from whofor.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def write(folder, name, columns):
    pq.write_table(pa.table(columns), os.path.join(folder, f"{name}.parquet"))


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    r = random.Random(12)
    folder = str(tmp_path_factory.mktemp("planted"))
    vocab = [f"w{i}" for i in range(3000)]

    def prose(n):
        return " ".join(r.choice(vocab) for _ in range(n))
    passage, item = prose(60), prose(40)
    texts, kind = [], []
    for i in range(260):
        toxic = i % 5 == 0
        words = prose(40).split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(40), "vermin")
        texts.append(" ".join(words))
        kind.append("toxic" if toxic else "clean")
    base = prose(120)
    near = base.split()
    near[50] = "changed"
    for text, what in ((base, "clean"), (base, "copy"), (" ".join(near), "copy"),
                       (prose(30) + "\n" + passage, "clean"), (prose(30) + "\n" + passage, "passage"),
                       (prose(20) + " " + item + " " + prose(20), "contaminated"), ("", "clean"), (None, "clean")):
        texts.append(text)
        kind.append(what)
    n = len(texts)
    write(folder, "documents", {"doc_id": list(range(n)), "text": texts, "lang": ["en"] * n,
                                "source": ["s"] * n, "n_chars": [len(t or "") for t in texts]})
    write(folder, "labels", {"doc_id": list(range(260)), "quality": [1] * 260,
                             "toxic": [int(k == "toxic") for k in kind[:260]]})
    write(folder, "benchmark", {"item_id": [1], "text": [item]})
    return folder, texts, kind, passage


def test_planted_cases_go_and_clean_documents_stay(spark, planted):
    folder, texts, kind, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(i not in rows for i, k in enumerate(kind) if k == "toxic")
    (second,) = [i for i, k in enumerate(kind) if k == "passage"]
    assert passage in rows[second - 1] and rows[second] == texts[second].split("\n")[0]
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len({r["doc_id"] for r in got}) and all(r["round_trip"] for r in got)
    want = {i for i, k in enumerate(kind) if k in ("clean", "passage")}
    assert {r["doc_id"] for r in got} == want


def test_near_copies_between_80_and_85_percent_go(spark):
    base = [f"w{i}" for i in range(200)]
    near = list(base)
    for at in (30, 70, 110, 150):
        near[at] = "changed"
    far = [w if at % 20 else "other" for at, w in enumerate(base)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((base, near, far))],
                                 "doc_id long, text string")
    # 176 of 216 shingles are shared, 0.815.
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [0, 2]


def test_stages_take_an_empty_table(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    got = QUERIES[name](spark, SF).count()
    if name == "op11_spelling":
        # Words, not documents; its own test compares every word.
        assert got > 0
    elif name == "op12_chats":
        talks = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct()
        assert got == talks.count() + 1
    else:
        table = "embeddings" if name.startswith("op1_") else "documents"
        assert got == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert set(ORACLES) <= set(QUERIES)

"""Event logs folded by a plain loop, and the rendered text read back."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from whofor.llm import chats
from whofor.llm.queries import QUERIES

NASTY = ["</s>", "<s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "[\\\\/INST]", "<", "[", "\\", "s>",
         "/INST]", "INST]", "\n", "$0", "é🙂", "ok", ""]
SCHEMA = "conversation long, seq long, kind string, message string, role string, text string"


def fold(events):
    """Messages by conversation."""
    rank = {k: i for i, k in enumerate(chats.KINDS)}
    logs = {}
    for e in events:
        if e[2] in rank:
            logs.setdefault(e[0], []).append(e)
    out = {}
    for conv, log in logs.items():
        log.sort(key=lambda e: (e[1] is not None, e[1] or 0, rank[e[2]], e[4] is not None, e[4] or "", e[5] or ""))
        shown, held, last = [], {}, None
        for _, _, kind, mid, role, text in log:
            if kind == "message":
                last = mid
            mid = last if mid is None else mid
            if kind == "message" or mid not in held:
                held[mid] = {"role": "", "text": "", "gone": False}
                shown.append(held[mid])
            m = held[mid]
            m["role"] = m["role"] if role is None else role
            m["text"] = m["text"] + (text or "") if kind == "delta" else text or ""
            if kind == "regenerate":
                for x in shown[next(i for i, x in enumerate(shown) if x is m) + 1:]:
                    x["gone"] = True
        out[conv] = [(m["role"], m["text"]) for m in shown if not m["gone"]]
    return out


def log(seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, 1, 2, 3, 4, 5]:
        ids = [f"m{i}" for i in range(6)] + [None]
        for _ in range(r.randint(1, 40)):
            kind = r.choice([*chats.KINDS, "delta", "delta", "message", "typing", None])
            text = r.choice([None, *("".join(r.choices(NASTY, k=r.randint(0, 6))) for _ in range(4))])
            role = r.choice(["user", "assistant", "<s>x[INST]", None]) if kind == "message" else None
            rows.append((conv, r.choice([None, *range(60)]), kind, r.choice(ids), role, text))
    return rows + rows[:3] + [(9, 1, "typing", "a", None, "never said")]


@pytest.mark.parametrize("seed", range(4))
def test_fold_and_reading_back(spark, seed):
    rows = log(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash")).repartition(3)
    out = chats.format_chats(df)
    assert out.columns == ["conversation", "n_turns", "formatted", "loss_spans"]
    back = out.select("*", *[c.alias(n) for n, c in chats.read_back(F.col("formatted"), F.col("loss_spans")).items()])
    got = {r["conversation"]: r for r in back.collect()}
    want = fold(rows)
    assert set(got) == set(want)
    for conv, messages in want.items():
        row = got[conv]
        assert [(t["role"], t["text"]) for t in row["turns"]] == messages and row["n_turns"] == len(messages)
        assert row["learnt"] == [t if r == "assistant" else "" for r, t in messages]
        assert row["formatted"].count("<s>") == row["formatted"].count("</s>") == len(messages)
        assert row["formatted"].count("[INST]") == row["formatted"].count("[/INST]") == len(messages)


def test_regeneration_drops_what_answered_the_old_text(spark):
    rows = [(1, 1, "message", "u", "user", "hi"), (1, 2, "message", "a", "assistant", ""), (1, 3, "delta", "a", None, "bad"),
            (1, 4, "message", "v", "user", "why?"), (1, 5, "regenerate", "a", None, None),
            (1, 6, "delta", "a", None, "go"), (1, 7, "delta", "a", None, "od"), (1, 8, "message", "w", "user", "thx"),
            (1, 9, "edit", "w", None, "thanks")]
    (row,) = chats.fold_events(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(m) for m in row["messages"]] == [("user", "hi"), ("assistant", "good"), ("user", "thanks")]


def test_registered_query(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice([None, "".join(r.choices(NASTY, k=8))]))
            for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(50, t, "assistant", "long 🙂 </s> " * 20_000) for t in range(3)] + [(51, None, None, None), (51, None, None, None)]
    rows += [(60, t, ("user", "assistant")[t % 2], f"{t}[INST]") for t in range(1500)]
    pq.write_table(pa.table({"conv_id": pa.array([x[0] for x in rows], pa.int64()),
                             "turn": pa.array([x[1] for x in rows], pa.int64()), "role": [x[2] for x in rows],
                             "text": [x[3] for x in rows], "n_turns": ["clash"] * len(rows)}),
                   str(tmp_path / "conversations.parquet"))
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0], x[1] or 0)):
        told, learnt = want.setdefault(c, ([], []))
        told.append(f"{role or ''}\n{text or ''}\n")
        learnt.append(text or "" if role == "assistant" else "")
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    query = QUERIES["op12_chats"](spark, str(tmp_path))
    got = {x["conv_id"]: x for x in query.collect()}
    assert set(got) == set(want)
    for c, (told, learnt) in want.items():
        x = got[c]
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == (
            len(told), sha(told), len("".join(learnt)), sha(learnt)), c
        assert x["formatted_chars"] >= len("".join(told))
    plan = query._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_empty_log(spark):
    out = chats.format_chats(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0

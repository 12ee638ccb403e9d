"""Base patterns against a literal reading of their definition; the lexer on small sources."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from whofor.llm import secrets as sc


def plain_base(text):
    """The patterns as worded: match runs first, drop failing matches after."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_the_plain_reading():
    r = random.Random(1)
    bits = ["password", "PassWD", "secret", "toKen", "api_key", "apikey", "=", ":", " ", "\"", "'",
            "AKIA", "ABCDEFGH12345678", "AK", "0123456789abcdef", "deadbeef", "é", "\n", "abc", "=="]
    for _ in range(3000):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert [s for s in sc.secret_spans(text) if s[1] < 3] == plain_base(text)


@pytest.mark.parametrize("text, wanted", [
    ('dbPwd: "hT5k9Qz81LmP"', ["hT5k9Qz81LmP"]),
    ('part = "Zk93hsQ81xVb"\nuser.auth_key = part', ["Zk93hsQ81xVb"]),
    ('a = "Zk93hsQ8"; b = "1xVb77Wq"; private_key = a + b', ["Zk93hsQ8", "1xVb77Wq"]),
    ('{"client-credential": "9f8Gh2kLp0"}', ["9f8Gh2kLp0"]),
    ('public_key = "Zk93hsQ81xVb"', []),
    ('auth_key = "changeme-123"', []),
    ('if key == "Zk93hsQ81xVb": pass', []),
    ('the key : is under the mat', []),
])
def test_lexer(text, wanted):
    assert [text[a:b] for a, k, b in sc.secret_spans(text) if k == 3] == wanted


def test_query_columns_nulls_and_clashes(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é token = \"abcdef\"", "x"), (3, "é token=abcdef", "y"),
            (4, "AKIA" + "A" * 16 + " " + "0" * 24, None), (5, "z" * 100_000 + " secret:abcdef", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secret_spans string")
    got = sc.find_secrets(df)
    assert got.columns == ["doc_id", "text", "secret_spans"]
    for r in got.collect():
        assert [(s["start"], sc.KINDS.index(s["kind"]), s["stop"]) for s in r["secret_spans"]
                if s["kind"] != "literal"] == plain_base(r["text"] or "")
    assert sc.find_secrets(df.limit(0)).count() == 0
    joined = got.where("doc_id = 4").select(sc.spans_text(F.col("secret_spans"))).first()[0]
    assert joined == "access:0:20,hex:21:45" and len(hashlib.sha256(joined.encode()).hexdigest()) == 64

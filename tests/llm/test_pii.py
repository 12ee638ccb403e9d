"""Base patterns against the plain patterns; disclosure on a corpus with known counts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from whofor.llm import pii
from whofor.llm.queries import QUERIES

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True,
                  14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark):
    r = random.Random(3)
    bits = ["a", "B.c", "@", ".", "..", "-", " ", "1", "25", "255", "256", "4111111111111111", "+", "(",
            ")", "x@y.z", "%", "é", "🙂", "\n", "10.0.0.1", "+1 (555) 123-4567", "4111 1111 1111 1111",
            "a@b.c%d@e.f", "0001.2.3.4", "٣"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 18))) for _ in range(2500)]
    texts += [None, "", "1-" * 40_000 + "1", "9" * 9_000, "a@b" + ".c" * 40_000, "a" * 4_000,
              " ".join(["u%d@h.org" % i for i in range(700)]), "+1" + "2" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = df.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert len(got) == len(texts)
    for row in got:
        assert [(s["start"], s["kind"], s["stop"]) for s in row["s"]] == plain(texts[row["doc_id"]] or "")


def corpus(spark):
    near = "Zorblatt"
    rows = [(i, f"common word {near} a{i}b wrote ann@x.org about the common plan") for i in range(12)]
    rows += [(100 + i, "common word about the plan of nothing. " * 30) for i in range(20)]
    rows += [(200, f"Here {near.upper()} stands alone"), (201, None), (202, "")]
    return spark.createDataFrame(rows + rows[-3:], "doc_id long, text string") \
        .withColumn("personal_spans", F.lit(1))


def test_terms_that_disclose_are_marked_everywhere(spark):
    df = corpus(spark)
    forms = [pii.find_personal(df, bits=4.0, **more) for more in
             ({}, {"broadcast_rows": 0, "literal_rows": 0})]
    a, b = [sorted((r["doc_id"], r["t"] or "", str(r["personal_spans"])) for r in f.withColumn(
        "t", pii.sanitised(F.col("text"), F.col("personal_spans"))).collect()) for f in forms]
    assert a == b and len(a) == df.count()
    texts = dict((k, t) for k, t, _ in a)
    assert "Zorblatt" not in texts[3] and "[EMAIL]" in texts[3]
    assert "common word" in texts[3] and "common" in texts[100]
    assert texts[200].startswith("Here ") and "ZORBLATT" not in texts[200]


def test_two_different_texts_are_enough_and_copies_are_one(spark):
    rows = [(0, "Quibblefax wrote to bob@y.org on monday"), (1, "Yesterday Quibblefax met bob@y.org again"),
            (2, "Quibblefax alone"), (3, "Dupword alone")]
    rows += [(10 + i, "Dupword sits beside eve@z.org here") for i in range(9)]
    rows += [(100 + i, "common word about the plan of nothing. " * 30) for i in range(20)]
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), bits=4.0)
    marked = {r["doc_id"]: [s["match"] for s in r["personal_spans"]] for r in found.collect()}
    assert marked[2] == ["Quibblefax"] and marked[0] == ["Quibblefax", "bob@y.org"] and marked[3] == []


def test_registered_query_equals_the_plain_patterns(spark, tmp_path):
    """Also where kinds share a start, and on a very long text."""
    r = random.Random(11)
    bits = ["4111111111111111", "@x.org", "1.2.3.4", "@host.com", " ", "+1 555 123 4567", "+14155550123", "a", ".", "é", "300",
            "\n", "5500005555555559"]
    texts = ["mail 4111111111111111@x.org now", "1.2.3.4@host.com", "+14155550123@h.org 4111 1111 1111 1111", None, "", ""]
    texts += ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(300)]
    texts += ["no data here, " * 60_000 + "1.2.3.4@host.com"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash")) \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in QUERIES["op10_personal_data"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        base = plain(text or "")
        shown = ",".join(f"{pii.BASE[kind]}:{start}:{stop}" for start, kind, stop in base)
        x = got[k]
        assert x["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), text
        assert [x[f"n_{kind}"] for kind in pii.BASE] == [sum(b[1] == i for b in base) for i in range(4)]
        spans = [s for s in x["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == [s for s in shown.split(",") if s]
        order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_empty_table_and_no_python(spark):
    none = pii.find_personal(corpus(spark).limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "personal_spans"]
    plan = pii.find_personal(corpus(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

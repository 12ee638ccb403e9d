"""Secret scans: assignment-aware lexing beside three base patterns.

The lexer reads source and configuration text into name-literal pairs: it finds the operators
``=``, ``:``, ``:=`` and ``=>``, reads the name before one (bare, quoted, dotted or subscripted)
and the expression after it (quoted strings, bare words, and names joined by ``+``). Names
bound to literals are constants; a later use of the name carries the literals on, so the literal
behind ``part = "..."; password = part`` is scored by ``password`` and reported where it stands.
A literal's score is that of the parts of its target name plus that of its own shape.

Spans are in code points, end exclusive. Base spans (assign, access, hex) always stay; kind
``literal`` is added where a scored literal lies in no base span. Null and empty texts have no
spans. Other columns pass unchanged; columns named as the outputs are replaced.
"""

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.tokens import add_fields, read_table, slices

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
OUT = pa.struct([("secret_spans", pa.list_(SPAN))])
DDL = "struct<secret_spans: array<struct<kind: string, start: bigint, stop: bigint>>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run of the class that is long enough is the same span as a run whose length is checked after.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LIKELY = re.compile(rb"[=:]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")

OPERATOR = re.compile(r":=|=>|(?<![=!<>+*/%&|^~-])=(?![=>~])|(?<!:):(?![:/=])")
NAME = re.compile(r"""(?:([A-Za-z_$][\w$]*(?:[.-][\w$]+)*)|["']([^"'\n]+)["'])\]?[ \t]*$""")
LONGEST_NAME = 160
VALUE = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([^\s"'#;,()\[\]{}+]+))"""
                   r"""[ \t]*(\+?)""")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: What a part of a name says about the literal bound to it (fixed values, chosen here).
NAMES = {"password": 3, "passwd": 3, "pwd": 3, "pass": 2, "passphrase": 3, "secret": 3, "token": 3,
         "apikey": 3, "credential": 3, "credentials": 3, "bearer": 3, "auth": 2, "private": 2,
         "key": 2, "access": 1, "signing": 1, "encryption": 1, "session": 1, "api": 1, "salt": 1,
         "public": -3, "file": -2, "path": -2, "url": -2, "name": -2, "length": -3, "type": -3,
         "count": -3, "expiry": -3, "expires": -3, "policy": -3, "hint": -3, "field": -2,
         "prompt": -3, "label": -3, "primary": -3, "foreign": -3}
PLACEHOLDER = re.compile(r"(?i)x{3,}|\*{3,}|\.{3,}|changeme|example|placeholder|your[_-]|dummy"
                         r"|<[^>]*>|\$\{|\{\{|^(?:true|false|null|none|undefined)$")
ENOUGH = 5.0


def name_score(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    return float(sum(NAMES.get(p, 0) for p in dict.fromkeys(parts)))


def literal_score(literal: str) -> float:
    """Shape of a literal: length, entropy of its letters, mixed classes; placeholders lose."""
    n = len(literal)
    if n < 6:
        return -9.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    mixed = bool(re.search(r"[0-9]", literal)) + bool(re.search(r"[A-Za-z]", literal))
    score = (n >= 8) + (n >= 16) + (entropy >= 2.5) + (entropy >= 3.5) + (mixed == 2)
    return score - 4.0 * bool(PLACEHOLDER.search(literal)) - 3.0 * (literal.count(" ") > 1)


def pairs(text: str):
    """``name, literal spans`` for each assignment, constants carried on in reading order."""
    bound: dict[str, list[tuple[int, int]]] = {}
    for op in OPERATOR.finditer(text):
        left = NAME.search(text[max(0, op.start() - LONGEST_NAME):op.start()])
        if not left:
            continue
        name, at, spans = left[1] or left[2], op.end(), []
        while value := VALUE.match(text, at):
            group = value.lastindex if value.lastindex < 4 else \
                next(g for g in (1, 2, 3) if value[g] is not None)
            word = value[group]
            spans += bound.get(word, [(value.start(group), value.end(group))]) \
                if group == 3 else [(value.start(group), value.end(group))]
            at = value.end()
            if not value[4]:
                break
        if spans:
            bound[name] = spans
            yield name, spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, stop`` of the base patterns, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    starts, reach, added = [a for a, _, _ in base], [], set()
    for _, _, b in base:
        reach.append(max(b, reach[-1] if reach else 0))
    for name, spans in pairs(text) if "=" in text or ":" in text else ():
        named = name_score(name)
        if named < 2:
            continue
        for a, b in spans:
            before = bisect_right(starts, a)
            covered = before and reach[before - 1] >= b
            if not covered and named + literal_score(text[a:b]) >= ENOUGH:
                added.add((a, len(BASE), b))
    return sorted([*base, *added])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: kind, start and stop of every secret of the whole text."""

    @F.arrow_udf(returnType=DDL)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for run in slices(batch.cast(pa.binary())):
                for row in run:
                    found = secret_spans(row.decode("utf-8", "replace")) \
                        if row and LIKELY.search(row) else []
                    out.append({"secret_spans": [{"kind": KINDS[k], "start": a, "stop": b}
                                                 for a, k, b in found]})
            yield pa.array(out, type=OUT)

    return add_fields(docs, scanned(F.col(text).cast("string").cast("binary")), ["secret_spans"])


def spans_text(spans):
    """``kind:start:end`` of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return find_secrets(docs).select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"))

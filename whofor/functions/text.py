"""Text expressions: cleaning, topic words, numbers, durations, normalisation.

All JVM-side. Patterns are compiled once per task by Spark because they are
literals; nothing here needs a Python worker.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import literal_map, total
from whofor.session import spread_small


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Whitespace runs become one space; no space at the ends."""
    # A single blank is left as it is.
    return F.trim(F.regexp_replace(c, r"(?U) \s+|[^\S ]\s*", " "))


def clean(c: Column) -> Column:
    return collapse(F.lower(c))


def word_count(c: Column) -> Column:
    """Words of collapsed text."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def once_a_text(df: DataFrame, text: Column, read) -> DataFrame:
    """``df`` with the columns that ``read`` adds to a table of its distinct texts (``__said``).

    Only the texts are read, however often each was said; rows get the outcome by a join on the
    text, null taken as empty. Needs a table, not a stream, that holds the same texts whenever it is read.
    """
    d = df.withColumn("__said", F.coalesce(text, F.lit("")))
    texts = read(spread_small(d.select("__said").distinct()))
    # Every text is found; an outer join so that never the rows are what is broadcast.
    return d.drop(*[c for c in texts.columns if c != "__said"]).join(texts, "__said", "left").drop("__said")


def found(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def found_named(c: Column, name: str) -> Column:
    """Is the pattern of that name found? One that may begin anywhere is tried only at its first letters."""
    pattern = V.PATTERNS[name]
    return found(c, f"(?=[{V.LEADS[name]}])(?:{pattern})" if name in V.LEADS else pattern)


def _ends_with_any(w: Column, endings) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | F.endswith(w, F.lit(e))
    return out


def _stem(w: Column) -> Column:
    n = F.length(w)
    cut = (F.when(F.endswith(w, F.lit("ing")) & (n > 5), F.substring(w, 1, n - 3))
           .when(F.endswith(w, F.lit("ed")) & (n > 4), F.substring(w, 1, n - 2))
           .when(F.endswith(w, F.lit("s")) & (n > 3)
                 & ~_ends_with_any(w, V.NOT_PLURAL_ENDINGS), F.substring(w, 1, n - 1))
           .otherwise(w))
    return F.regexp_replace(cut, r"^(.{3,})e$", "$1")


def content_words(c: Column) -> Column:
    """Topic words, lightly stemmed and distinct; contractions count as their head."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+(?:'[a-z]+)?)"), F.lit(1))
    # "isn't" is "is": drop the n of n't along with the ending.
    heads = F.transform(raw, lambda w: F.regexp_replace(w, r"n'(?=t).*$|'.*$", ""))
    topical = F.filter(heads, lambda w: (F.length(w) >= 3) & ~w.isin(*V.STOPWORDS))
    stems = F.transform(topical, _stem)
    return F.array_distinct(F.filter(stems, lambda w: (w != "") & ~w.isin(*V.STOPWORDS)))


def name_pattern(name: str, aliases: tuple = ()) -> str | None:
    """The name's letters with optional separators between them, or null."""
    forms = []
    for form in (name, *aliases):
        letters = [ch for ch in (form or "").lower() if ch.isalnum()]
        if letters:
            forms.append(r"[\s\-\.']*".join(letters))
    return r"\b(?:" + "|".join(forms) + r")\b" if forms else None


def is_vocative(body: Column, pattern: str) -> Column:
    """Does the first mention address someone (opening, closing or set off by a comma)?"""
    at = F.regexp_instr(body, F.lit(pattern))
    word = F.regexp_extract(body, pattern, 0)
    before = F.substring(body, F.lit(1), at - 1)
    after = F.substring(body, at + F.length(word), F.length(body))
    opened = before.rlike(V.PATTERNS["vocative_lead"]) | F.endswith(F.rtrim(before), F.lit(","))
    return (at > 0) & opened & after.rlike(r"^(?:[,.?!\s]|$)")


def last_sentence(text: Column) -> Column:
    """The trailing clause when there are at least two sentences and it has two words."""
    tail = F.regexp_extract(text, V.PATTERNS["last_sentence"], 1)
    return F.when(word_count(collapse(tail)) >= 2, tail)


def is_only(text: Column, pattern: str, name: str = V.DEFAULT_NAME) -> Column:
    """Is the utterance the trigger and at most one other meaningful word?"""
    t = F.coalesce(text, F.lit(""))
    trigger = "(?i)(?:" + pattern + ")"
    at = F.regexp_instr(t, F.lit(trigger))
    hit = F.regexp_extract(t, trigger, 0)
    rest = F.concat(F.substring(t, F.lit(1), at - 1), F.lit(" "),
                    F.substring(t, at + F.length(hit), F.length(t)))
    filler = r"(?i)\b(?:" + "|".join((*V.FOLLOWUP_FILLER, re.escape(name.lower()))) \
        + r")\b|[^\w\s]"
    left = collapse(F.regexp_replace(rest, filler, " "))
    return (at > 0) & (word_count(left) <= 1)


def wants_repeat(text: Column, name: str = V.DEFAULT_NAME) -> Column:
    return is_only(text, V.PATTERNS["wants_repeat"], name)


def wants_more_detail(text: Column, name: str = V.DEFAULT_NAME) -> Column:
    return is_only(text, V.PATTERNS["wants_more_detail"], name)


# -- transcripts -> slots ---------------------------------------------------------------

def normalise(text: Column, name: str = V.DEFAULT_NAME, aliases: tuple = ()) -> Column:
    """Lower case without punctuation, the name or politeness."""
    t = F.regexp_replace(F.lower(text), "’", "'")
    t = F.regexp_replace(t, r"[^a-z0-9' ]+", " ")
    names = [re.escape(n.lower()) for n in (name, *aliases) if n]
    if names:
        t = F.regexp_replace(
            t, r"\b(?:hey|hi|ok(?:ay)?|yo)?\s*(?:" + "|".join(names) + r")\b", " ")
    t = F.trim(F.regexp_replace(t, " +", " "))
    for _ in range(3):
        t = F.trim(F.regexp_replace(t, V.POLITE_LEAD, ""))
        t = F.trim(F.regexp_replace(t, V.POLITE_TAIL, ""))
    return t


def normalise_literal(text: str) -> str:
    """The same cleaning for a catalogue example, done once where the plan is built."""
    t = re.sub(r"[^a-z0-9' ]+", " ", text.lower().replace("’", "'"))
    t = " ".join(t.split())
    for _ in range(3):
        t = re.sub(V.POLITE_TAIL, "", re.sub(V.POLITE_LEAD, "", t).strip()).strip()
    return t


def parse_number(c: Column) -> Column:
    """Digits, number words and tens-unit pairs as a double; null when it is neither."""
    w = F.trim(F.regexp_replace(c, "-", " "))
    parts = F.split(w, r"\s+")
    units, tens = literal_map(V.NUMBER_WORDS), literal_map(V.TENS_WORDS)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    words = (F.when(F.size(parts) == 1, F.coalesce(F.try_element_at(units, first),
                                                   F.try_element_at(tens, first)))
             .when(F.size(parts) == 2, F.try_element_at(tens, first)
                   + F.try_element_at(units, second)))
    return F.when(w.rlike(r"^\d+(?:\.\d+)?$"), w.try_cast("double")) \
        .otherwise(words.cast("double"))


def _unit_seconds(unit: Column) -> Column:
    return (F.when(F.startswith(unit, F.lit("h")), 3600.0)
            .when(F.startswith(unit, F.lit("m")), 60.0).otherwise(1.0))


def parse_duration(text: Column) -> Column:
    """Whole seconds named in the text, or null when no duration is named."""
    t = F.regexp_replace(F.lower(text), "-", " ")
    quarters3 = F.regexp_count(t, F.lit(V.DURATION_THREE_QUARTERS))
    t1 = F.regexp_replace(t, V.DURATION_THREE_QUARTERS, " ")
    halves = F.regexp_extract_all(t1, F.lit(V.DURATION_HALF_UNIT), F.lit(1))
    t2 = F.regexp_replace(t1, V.DURATION_HALF_UNIT, " ")
    quarters = F.regexp_count(t2, F.lit(V.DURATION_QUARTER_HOUR))
    t3 = F.regexp_replace(t2, V.DURATION_QUARTER_HOUR, " ")
    amounts = F.regexp_extract_all(t3, F.lit(V.DURATION_AMOUNT), F.lit(0))

    def seconds(m):
        n = parse_number(F.regexp_extract(m, V.DURATION_AMOUNT, 1))
        half = F.when(m.rlike(r"and\s+a\s+half"), 0.5).otherwise(0.0)
        per = _unit_seconds(F.regexp_extract(m, V.DURATION_AMOUNT, 3))
        return F.coalesce((n + half) * per, F.lit(0.0))

    def add(a, b):
        return a + b
    zero = F.lit(0.0)
    value = total([
        quarters3 * 2700.0, quarters * 900.0,
        F.aggregate(F.transform(halves, lambda u: 0.5 * _unit_seconds(u)), zero, add),
        F.aggregate(F.transform(amounts, seconds), zero, add)])
    # Only text that names a unit of time pays for the extraction.
    return F.when(t.rlike(r"hour|hr|min|sec"),
                  F.when(value > 0, F.bround(value, 0).cast("long")))


def example_pattern(example: str, slots: list[dict]) -> tuple[str, list[str]]:
    """A full-match pattern for a catalogue example, and the slot of each group."""
    names, out = [], []
    known = {s["name"] for s in slots}
    for piece in re.split(r"(\{[a-z_]+\})", example.lower()):
        slot = piece[1:-1] if piece.startswith("{") else None
        if slot in known:
            names.append(slot)
            out.append("(.+?)")
        elif normalise_literal(piece):
            out.append(re.escape(normalise_literal(piece)))
    body = r"\s*".join(out) if out else re.escape(normalise_literal(example))
    return "^" + body + "$", names


def coerce_slot(raw: Column, slot: dict) -> Column:
    """A raw slot string as its declared type, written as a string; null if it is not one."""
    if slot["type"] == "duration":
        whole = raw.rlike(r"^-?\d+(?:\.\d+)?$")
        return F.when(whole, raw.try_cast("double").cast("long")) \
            .otherwise(parse_duration(raw)).cast("string")
    if slot["type"] == "number":
        n = F.coalesce(raw.try_cast("double"), parse_number(raw))
        return n.cast("long").cast("string")
    key = F.lower(strip(raw))
    return F.try_element_at(
        literal_map({str(v).lower(): str(v) for v in reversed(slot["values"])}), key)


# -- rendering --------------------------------------------------------------------------

def describe_duration(seconds: Column) -> Column:
    """420 -> "7 minutes"; 0 -> "0 seconds"."""
    s = seconds.cast("long")
    h = F.floor(s / 3600)
    m = F.floor(F.pmod(s, F.lit(3600)) / 60)
    r = F.pmod(s, F.lit(60))

    def part(n, unit):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"),
                                      F.when(n == 1, "").otherwise("s")))
    text = F.concat_ws(" ", part(h, "hour"), part(m, "minute"), part(r, "second"))
    return F.when(text == "", "0 seconds").otherwise(text)

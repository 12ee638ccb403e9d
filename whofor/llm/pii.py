"""Personal data: base patterns, and terms that give protected values away.

Information-theoretic sanitisation in DataFrame functions only. Base patterns find protected
values (e-mail and IP addresses, card and phone numbers). Over the whole corpus, words standing
within a few words of a protected value are counted beside all their occurrences: a word that is
seen in ``least`` different texts near one value tells ``log2(p(value | word) / p(value))`` bits about it, and
discloses it when the posterior ``p(value | word)`` reaches a threshold as well. Such words are
marked wherever they stand: to be generalised, or at a higher posterior removed.

Spans are in code points, end exclusive. Base spans always stay. Null and empty texts have no
spans. Repeated rows are counted each; other columns pass unchanged, and columns named as the
outputs are replaced. An empty table gives an empty result.

Base patterns are written so that no group repeats more than a few hundred times in a row, since
the matcher recurses there; atomic groups in groups match what the plain repetition would.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.tokens import read_table
from whofor.session import cut_lineage

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalise", "remove")
SPANS = "array<struct<start:bigint,stop:bigint,kind:int,match:string>>"
WORD = r"[\p{L}\p{N}]+"
BLOCK = 256

LOCAL = "[A-Za-z0-9._%+-]"
# A match begins where the run of its letters begins, or where the last match ended.
EMAIL = (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++"
         r"(?>(?>\.[A-Za-z0-9-]++){1,300})++")
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?>(?>[\x20-]?[0-9]++){1,300})*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Cheap tests that every text with a match passes.
HINTS = {EMAIL: "@[A-Za-z0-9-]", IP: r"[0-9]\.[0-9]", CARD: r"[0-9](?:[\x20-]?[0-9]){13}",
         PHONE: r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def none() -> Column:
    return F.array().cast(SPANS)


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array, in blocks, so that work stays near linear."""
    def sums(part):
        return F.aggregate(part, F.array().cast("array<bigint>"), lambda acc, x: F.concat(
            acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)))
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                         lambda b: F.slice(values, (b - 1) * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda part: F.aggregate(
        part, F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    before = F.concat(F.array(F.lit(0).cast("bigint")), sums(totals))
    return F.flatten(F.zip_with(
        F.transform(blocks, sums), F.slice(before, F.lit(1), F.size(blocks)),
        lambda part, before: F.transform(part, lambda x: x + before)))


def pattern_spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches with their places.

    Splitting by the pattern gives what lies between the matches; lengths then give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (
        F.char_length(g) + F.char_length(m)).cast("bigint"))
    return F.zip_with(running_sum(sizes), found, lambda stop, m: F.struct(
        (stop - F.char_length(m)).alias("start"), stop.alias("stop"),
        F.lit(kind).alias("kind"), m.alias("match"))).cast(SPANS)


def luhn(digits: Column) -> Column:
    """Whether the check digit fits (for a string of digits)."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four base patterns, by start and then kind."""
    parts = []
    for k, (kind, pattern) in enumerate(zip(BASE, (EMAIL, IP, CARD, PHONE))):
        spans = F.filter(pattern_spans(text, pattern, k), lambda s: holds(kind, s["match"]))
        parts.append(F.when(text.rlike(HINTS[pattern]), spans).otherwise(none()))
    return in_order(F.concat(*parts))


def in_order(spans: Column) -> Column:
    """Spans by start and then kind."""
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(
        a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def around(text: Column, span: Column, near: int, width: int) -> Column:
    """The ``near`` words on each side of a span, of those whole in ``width`` code points."""
    start, stop = span["start"].cast("int"), span["stop"].cast("int")
    left = F.substring(text, F.greatest(start - width + 1, F.lit(1)), F.least(start, F.lit(width)))
    right = F.substring(text, stop + 1, F.lit(width))
    left = F.when(start > width, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.when(F.char_length(right) == width,
                   F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)
    a = words(left)
    return F.concat(F.slice(a, F.greatest(F.size(a) - near + 1, F.lit(1)), F.lit(near)),
                    F.slice(words(right), F.lit(1), F.lit(near)))


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows (counts no further than it must)."""
    return df.limit(limit + 1).count() <= limit


def disclosing_terms(docs: DataFrame, near: int, width: int, least: int, posterior: float,
                     bits: float, broadcast_rows: int) -> DataFrame:
    """``term, p``: words whose nearness to one protected value discloses it.

    ``docs`` holds ``text`` and base ``spans``. Only words near values are candidates; all their
    occurrences in the corpus are then counted. The candidates are broadcast up to
    ``broadcast_rows`` rows; beyond, every word is counted before an ordinary join.
    """
    hits = docs.where(F.size("spans") > 0).select("text", F.explode("spans").alias("s"))
    seen = hits.select(
        F.xxhash64("text").alias("in_text"),
        F.concat_ws(":", F.col("s.kind").cast("string"), F.lower("s.match")).alias("value"),
        around(F.col("text"), F.col("s"), near, width).alias("terms"))
    pairs = seen.select("value", "in_text", F.explode("terms").alias("term")) \
        .groupBy("term", "value").agg(F.count(F.lit(1)).alias("both"),
                                      F.count_distinct("in_text").alias("texts"))
    pairs = cut_lineage(pairs.where(F.col("texts") >= least).drop("texts"))
    term = pairs.select("term").distinct()
    every = docs.select(F.explode(words(F.col("text"))).alias("term"))
    marked = term.withColumn("wanted", F.lit(1))
    if bounded(term, broadcast_rows):
        counts = every.join(F.broadcast(marked), "term", "left") \
            .select(F.when(F.col("wanted") == 1, F.col("term")).alias("term")) \
            .groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = every.groupBy("term").agg(F.count(F.lit(1)).alias("n")) \
            .join(marked, "term", "left") \
            .groupBy(F.when(F.col("wanted") == 1, F.col("term")).alias("term")) \
            .agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first()["n"]
    values = seen.groupBy("value").agg(F.sum(F.size("terms")).alias("size"))
    p = F.least(F.col("both") / F.col("n"), F.lit(1.0))
    told = pairs.join(counts, "term").join(values, "value").where(
        (p >= posterior) & (F.log2(p * F.lit(float(total)) / F.col("size")) >= bits))
    return told.groupBy("term").agg(F.max(p).alias("p"))


def find_personal(docs: DataFrame, text: str = "text", near: int = 4, width: int = 160,
                  least: int = 2, posterior: float = 0.5, remove_at: float = 0.9,
                  bits: float = 10.0, broadcast_rows: int = 200_000,
                  literal_rows: int = 20_000) -> DataFrame:
    """``docs`` with ``personal_spans``: start, stop, kind and the matched text.

    Up to ``literal_rows`` disclosing terms become a set in the plan; beyond, they are joined.
    """
    columns = [c for c in docs.columns if c.lower() != "personal_spans"]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")) \
        .withColumn("spans", base_spans(F.col("text")))
    terms = cut_lineage(disclosing_terms(base, near, width, least, posterior, bits,
                                         broadcast_rows))
    tokens = pattern_spans(F.col("text"), WORD, 0)

    def marked(kind, keep):
        return F.transform(F.filter(tokens, lambda s: keep(F.lower(s["match"]))), lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"),
            s["match"].alias("match"))).cast(SPANS)
    n = len(BASE)
    if bounded(terms, literal_rows):
        rows = terms.collect()
        sets = [[r["term"] for r in rows if (r["p"] >= remove_at) == gone] for gone in (False, True)]
        added = [marked(n + k, lambda w, s=s: w.isin(s)) for k, s in enumerate(sets) if s]
        any_set = [t for s in sets for t in s]
        extra = F.when(F.exists(words(F.col("text")), lambda w: w.isin(any_set)),
                       F.concat(*added)).otherwise(none()) if added else none()
        found = base.withColumn("extra", extra)
    else:
        key = [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")]
        held = base.select(*key, F.explode(F.array_distinct(words(F.col("text")))).alias("term")) \
            .join(terms, "term").groupBy("k1", "k2").agg(
            F.collect_set(F.when(F.col("p") < remove_at, F.col("term"))).alias("t0"),
            F.collect_set(F.when(F.col("p") >= remove_at, F.col("term"))).alias("t1"))
        found = base.withColumns({"k1": key[0], "k2": key[1]}).join(held, ["k1", "k2"], "left") \
            .withColumn("extra", F.when(F.col("t0").isNotNull(), F.concat(
                marked(n, lambda w: F.array_contains("t0", w)),
                marked(n + 1, lambda w: F.array_contains("t1", w)))).otherwise(none()))
    inside = F.filter("extra", lambda e: ~F.exists("spans", lambda s: (
        s["start"] < e["stop"]) & (e["start"] < s["stop"])))
    return found.select("__row.*", in_order(F.concat("spans", inside)).alias("personal_spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind, and removed terms taken out."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        tag = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in BASE], F.lit("[TERM]"),
                                   F.lit("")), s["kind"] + 1)
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["stop"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], gap, tag).alias("out"), s["stop"].alias("at")))
    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2 ** 31 - 1)))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
        s["stop"].cast("string"))), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("personal_spans")

    def number(k):
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return find_personal(docs).select(
        "doc_id", *[number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"))

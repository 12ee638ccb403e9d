"""Benchmark decontamination: Wu-Manber search for benchmark windows in documents.

Words are the alphabet (A-Z in lower case, everything in ASCII but digits and letters
separates). A window is 13 consecutive words of a benchmark item; an item of fewer words is one
window. Windows of one length share a shift table over blocks of two words: a block that no
window holds lets the search skip almost a whole window, a block inside windows skips to where
it would stand at their end, and a block at a window's end opens a bucket whose windows are
compared word by word.

Null or empty texts have no words and are not contaminated; null or wordless items have no
window. Rows with one item_id are one item; a null item_id counts as the empty string. Other
columns pass unchanged; columns named as the outputs are replaced. An empty benchmark hits nothing.

The benchmark is dealt into shards of a bounded number of words, and only one shard's tables are
broadcast at a time; documents pass once per shard (for benchmarks up to the bound, once).
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.tokens import NOT_ALNUM, add_fields, folding, read_table, slices
from whofor.session import cut_lineage

WINDOW = 13
PIECE = 5_000
FIELDS = ["n_words", "n_hit", "item_ids"]
OUT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                 ("item_ids", pa.list_(pa.string())), ("__marks", pa.binary())])
DDL = "struct<n_words: bigint, n_hit: bigint, item_ids: array<string>, __marks: binary>"
FOLD = folding(NOT_ALNUM)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Tables:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, set]] = {}

    def add(self, window: tuple, item: str) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = window[end - b:end]
            self.shift[key] = min(self.shift.get(key, self.far), m - end)
        self.bucket.setdefault(window[m - b:], {}).setdefault(window, set()).add(item)

    def search(self, words: list, marks: bytearray, items: set) -> None:
        m, b, far = self.length, self.block, self.far
        shift, n, end = self.shift.get, len(words), self.length
        while end <= n:
            key = tuple(words[end - b:end])
            step = shift(key, far)
            if step:
                end += step
                continue
            found = self.bucket[key].get(tuple(words[end - m:end]))
            if found:
                marks[end - m:end] = b"\1" * m
                items |= found
            end += 1


def tables_of(pieces) -> list[Tables]:
    """Tables by window length of ``(item, words)`` pieces."""
    by_length: dict[int, Tables] = {}
    for item, words in pieces:
        words = [w.encode() for w in words]
        m = min(WINDOW, len(words))
        table = by_length.setdefault(m, Tables(m))
        for i in range(len(words) - m + 1):
            table.add(tuple(words[i:i + m]), item)
    return list(by_length.values())


def item_pieces(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """``item, words``: long items are cut, with an overlap that keeps every window whole."""
    words = F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER),
                                 F.lit(WORD), F.lit(0))
    cut = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                           words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - WINDOW), F.lit(PIECE))
    return cut.select("item", "words", F.explode(starts).alias("at")).select(
        "item", F.slice("words", F.col("at") + 1, F.lit(PIECE + WINDOW - 1)).alias("words"))


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", shard_words: int = 200_000) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and the sorted ``item_ids`` that occur in the text."""
    pieces = item_pieces(benchmark, item, item_text)
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    dealt = pieces.withColumn("__shard", F.pmod(F.hash("item", "words"), F.lit(shards)))
    out = docs
    for k in range(shards):
        rows = [(r["item"], r["words"]) for r in dealt.where(F.col("__shard") == k).collect()]
        out = scan(out, text, rows, first=k == 0, last=k == shards - 1)
        if k < shards - 1:
            out = cut_lineage(out)
    return out


def scan(docs: DataFrame, text: str, rows: list, first: bool, last: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf(returnType=DDL)
    def searched(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = tables_of(shared.value)
        for texts, marked, listed in batches:
            out, at = [], 0
            for run in slices(texts.cast(pa.binary())):
                for text in run:
                    words = (text or b"").translate(FOLD).split(b" ")
                    words = [w for w in words if w]
                    marks = bytearray(marked[at].as_py() or bytes(len(words)))
                    items = set(listed[at].as_py() or ())
                    for table in tables:
                        table.search(words, marks, items)
                    out.append({"n_words": len(words), "n_hit": sum(marks),
                                "item_ids": sorted(items),
                                "__marks": None if last else bytes(marks)})
                    at += 1
            yield pa.array(out, type=OUT)

    none = [F.lit(None).cast("binary"), F.lit(None).cast("array<string>")]
    state = none if first else [F.col("__marks"), F.col("item_ids")]
    return add_fields(docs, searched(F.col(text).cast("string").cast("binary"), *state),
                      FIELDS + ([] if last else ["__marks"])).drop(*["__marks"] * last)


def contaminated(share: int = 20):
    """Hit words, and at least one in ``share`` of all words."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs`` alone."""
    columns = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"),
                        F.col("text").alias("__text"))
    found = find_items(inner, benchmark, text="__text")
    return found.where(~contaminated()).select("__row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))

"""Importance resampling towards a target: hashed n-gram gains, prefix CRCs, a weighted draw.

Features are the runs of one to ``LONGEST`` words of a text, joined by one space; a feature's bucket
is the CRC-32 of its bytes modulo ``buckets``. Each text is scanned once: a running CRC is kept at
the end of every word, and the CRC of any run of words follows from the CRC before it and the one
at its end, since CRCs are linear over GF(2): crc(ab) = shift(crc(a), len b) ^ crc(b). The shift is
four table look-ups for runs of under ``NEAR`` bytes and a few more (squared shifts) for longer ones.

A bucket's gain is floor(1000 * ln) of its smoothed share in the target over its share in the
corpus. A document's weight is the sum of the gains of its features; its score adds a Gumbel draw
that hangs on ``seed`` and the id alone. Of the N documents with ``least_words`` words, the highest
scores are drawn: an exact sample without replacement in proportion to exp(weight / 1000).

Words are the alphanumeric ones, A-Z in lower case. Null and empty texts have no words, no features
and weight 0. Rows are scored each; rows with one id and score are ranked by weight, then features.
A null id counts as the empty string in the draw and comes first among ties. Columns named as the
outputs are replaced, others pass unchanged. An empty table gives an empty result; an empty target
has the smoothing alone. Only counts by bucket reach the driver and only gains are broadcast: both
are of the fixed size ``buckets``; ranks take one count per partition.
"""

import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.graph import stash
from whofor.llm.tokens import NOT_ALNUM, add_fields, as_bytes, folding, read_table, slices, small_batches

LONGEST, NEAR, CHUNK = 3, 256, 1 << 18
FOLD = folding(NOT_ALNUM)
PIECES = re.compile(rb" [^ ]+")
FIELDS = ["n_features", "n_words", "weight"]
DDL = "struct<n_features: bigint, n_words: bigint, weight: bigint>"
OUT = pa.struct([(f, pa.int64()) for f in FIELDS])


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


STEP = _byte_table()


def zero_byte(c: np.ndarray) -> np.ndarray:
    """What one more byte of zeros does to the linear part of a CRC."""
    return STEP[c & 0xFF] ^ (c >> np.uint32(8))


def _unit_table() -> np.ndarray:
    """Each byte value in each of the four places of a CRC."""
    return (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None])


def applied(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = table[0][c & 0xFF]
    for k in (1, 2, 3):
        out = out ^ table[k][(c >> np.uint32(8 * k)) & 0xFF]
    return out


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifts by 0 to ``NEAR`` - 1 bytes, and by ``NEAR`` times each power of two."""
    near = [_unit_table()]
    for _ in range(NEAR):
        near.append(zero_byte(near[-1]))
    far = [near.pop()]
    for _ in range(31):
        far.append(applied(far[-1], far[-1]))
    return np.stack(near).reshape(-1), far


SHIFT, SQUARES = _shift_tables()


def shifted(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs with ``by`` bytes after them, without those bytes' own part."""
    far = by // NEAR
    if far.any():
        at = np.flatnonzero(far)
        moved, c = c[at], c.copy()
        for k in range(int(far.max()).bit_length()):
            on = (far[at] >> k & 1).astype(bool)
            moved[on] = applied(SQUARES[k], moved[on])
        c[at] = moved
    base = (by % NEAR) << 10
    out = SHIFT[base + (c & 0xFF)]
    for k in (1, 2, 3):
        out = out ^ SHIFT[base + (256 * k + ((c >> np.uint32(8 * k)) & 0xFF))]
    return out


def feature_buckets(texts, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``text index, bucket`` of every feature of the texts, in arrays of a bounded length."""
    pieces: list[bytes] = []
    counts = []
    for t in texts:
        found = PIECES.findall(b" " + t.translate(FOLD)) if t else []
        counts.append(len(found))
        pieces += found
    owner = np.repeat(np.arange(len(counts)), counts)
    for lo in range(0, len(pieces), CHUNK):
        part = pieces[lo:lo + CHUNK + LONGEST - 1]
        n = len(part)
        ends = np.fromiter(accumulate(part, lambda c, w: zlib.crc32(w, c), initial=0), np.uint32, n + 1)
        # The CRC before a word includes the space before it.
        raw = ends[:-1] ^ np.uint32(0xFFFFFFFF)
        before = (STEP[(raw ^ 0x20) & 0xFF] ^ (raw >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
        stop = np.cumsum(np.fromiter(map(len, part), np.int64, n))
        start = np.concatenate(([0], stop[:-1])) + 1
        mine = owner[lo:lo + n]
        for k in range(LONGEST):
            m = min(n - k, CHUNK)
            if m <= 0:
                break
            ok = np.flatnonzero(mine[:m] == mine[k:k + m])
            crc = ends[ok + k + 1] ^ shifted(before[ok], stop[ok + k] - start[ok])
            yield mine[ok], (crc % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Features of all texts by bucket."""

    def counted(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for run in slices(batch.column(0)):
                for _, found in feature_buckets(run, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    small_batches(docs.sparkSession)
    found = docs.select(as_bytes(f"`{text}`").alias("text")).mapInArrow(counted, "bucket bigint, n bigint") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed share in the target over that in the source."""
    n, m = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * n / ((s + 1.0) * m)))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``n_features``, ``n_words`` and ``weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf(returnType=DDL)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gain = shared.value
        for batch in batches:
            parts = []
            for run in slices(batch.cast(pa.binary())):
                number, weight = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
                for mine, found in feature_buckets(run, len(gain)):
                    if len(mine):
                        first = np.flatnonzero(np.diff(mine, prepend=-1))
                        weight[mine[first]] += np.add.reduceat(gain[found], first)
                        number += np.bincount(mine, minlength=len(run))
                # One word has one feature, and each more brings three, but for the second's two.
                words = np.where(number < 3, number, number // 3 + 1)
                parts.append((number, words, weight))
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts)] or [pa.array([], pa.int64())] * 3
            yield pa.StructArray.from_arrays(columns, fields=list(OUT))
    return add_fields(docs, scored(as_bytes(f"`{text}`")), FIELDS)


def drawn(weights: DataFrame, key: str, least_words: int, share: tuple[int, int], seed: int) -> DataFrame:
    """``weights`` with ``score`` and the ``rank`` of the drawn rows.

    Rows are dealt to ranges by score and id and sorted there; the ranges' row counts make the
    ranks, so nothing is ordered in one place.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
                                  .cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    out = weights.withColumn("score", (F.col("weight") + noise).cast("long")) \
        .withColumn("__in", F.col("n_words") >= least_words)
    order = [F.desc("__in"), F.desc("score"), F.asc_nulls_first(f"`{key}`"), F.desc("weight"), F.desc("n_features")]
    n = max(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = stash(out.repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    sizes = sorted(ranged.groupBy(part.alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__in"), 1)).alias("able")).collect())
    take = sum(r["able"] for r in sizes) * share[0] // share[1]
    begins, before = [], 0
    for r in sizes:
        begins.append((r["p"], before))
        before += r["n"]
    begins = out.sparkSession.createDataFrame(begins, "__part int, __before long")
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return ranged.withColumn("__part", part).join(F.broadcast(begins), "__part").withColumn(
        "rank", F.when(rank <= take, rank)).drop("__part", "__before", "__at", "__in")


def importance_resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
                        target_text: str = "text", buckets: int = 10_000, least_words: int = 20,
                        share: tuple[int, int] = (5, 100), seed: int = 42) -> DataFrame:
    """``docs`` without their texts, with ``n_features``, ``n_words``, ``weight``, ``score``, ``rank``."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    names = {*FIELDS, "score", "rank"}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    return drawn(weighed(kept, gain, text).drop(text), key, least_words, share, seed)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resample(docs, read_table(spark, sf_dir, "benchmark").select("text")).select(
        "doc_id", "n_features", "weight", "score", "rank")

"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal axes is learnt on a bounded sample so that signs give balanced
binary codes (iterative quantisation; several rotations where more bits are wanted than the
vectors have dimensions). The code is cut into tables of ``bits`` bits; vectors of one label,
length and table entry share a bucket. Buckets are cut into blocks of a bounded size, every pair
of blocks is one unit of work, and inside it original vectors are compared in double precision.
A pair met in several tables counts only in the first table that holds it, so link counts are
exact without ever listing pairs: a unit returns link counts and a spanning set of links.

Two rows are compared only when labels are equal and not null and vectors have one length.
Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label or id, link with nothing. Rows that repeat an id and vector are one vector. Copies (equal
vectors of one label) share a representative, weighted by their number. Other columns are not
carried; an empty table gives an empty result.

Table count follows from ``miss``: the chance that a pair exactly at the threshold shares no
entry, with each bit differing as angle/pi. The angle is that about the sample's mean, where the
code cuts: vectors at the threshold whose distances from the mean are those of the nearest hundredth
of the sample. Bits follow the largest label, so that buckets keep their size as the table grows;
where a large common component would ask for more than ``TABLES`` tables, bits go down instead.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.graph import components, stash
from whofor.llm.tokens import read_table, small_batches

SAMPLE = 20_000
BUCKET = 128
TABLES = 256
BLOCK = 2_048
PART = "id bigint, links bigint, root bigint"


def learn(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 9) -> tuple:
    """Mean and projections (dimension x bits) whose signs are the code."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    y = x @ axes.T
    rng, out, d = np.random.default_rng(seed), [], x.shape[1]
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            signs = np.where(y @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(y.T @ signs)
            turn = u @ vt
        out.append(axes.T @ turn)
    return mean, np.hstack([np.zeros((d, 0)), *out])[:, :bits]


def tables_for(bits: int, threshold: float, miss: float, norm: float = 1.0) -> float:
    """Tables wanted where unit vectors have at least a distance of ``norm`` from the cut."""
    half = math.sqrt(max(0.0, 1 - threshold) / 2)
    same = (1 - 2 * math.asin(min(1.0, half / max(norm, half, 1e-12))) / math.pi) ** bits
    if same >= 1:
        return 1
    return max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same > 1e-12 else math.inf


def least_norm(sample: np.ndarray) -> float:
    """Distance from the mean that all but a hundredth of the sample have."""
    return float(np.quantile(np.linalg.norm(sample - sample.mean(axis=0), axis=1), 0.01))


def fitting(bits: int, threshold: float, miss: float, norm: float) -> tuple[int, int]:
    """At most ``bits`` bits, and their tables."""
    while tables_for(bits, threshold, miss, norm) > TABLES:
        bits -= 1
    return bits, tables_for(bits, threshold, miss, norm)


def encode(vectors: np.ndarray, mean, projection, bits: int) -> np.ndarray:
    """Table entries: one integer of ``bits`` bits per table."""
    if not bits:
        return np.zeros((len(vectors), 1), dtype=np.int64)
    signs = (vectors - mean) @ projection >= 0
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs.reshape(len(vectors), -1, bits) @ weights


def padded(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def unit_links(vectors, codes, side, table: int, weight, threshold: float):
    """Link weight of every vector of a unit, and the smallest row that links reach.

    ``side`` tells the two blocks apart (all equal: one block with itself). Works in tiles, so
    memory does not follow the number of pairs.
    """
    n = len(vectors)
    links, label = np.zeros(n, dtype=np.int64), np.arange(n)
    one = bool((side == side[0]).all())
    tile = max(1, (1 << 19) // n)
    for lo in range(0, n, tile):
        close = vectors[lo:lo + tile] @ vectors.T >= threshold
        i, j = np.nonzero(close)
        i += lo
        keep = (i < j) & (one | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 17):
            a, b = i[k:k + (1 << 17)], j[k:k + (1 << 17)]
            if table:
                first = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
                a, b = a[first], b[first]
            if not len(a):
                continue
            links += np.bincount(a, weight[b], n).astype(np.int64)
            links += np.bincount(b, weight[a], n).astype(np.int64)
            while True:
                low = np.minimum(label[a], label[b])
                before = label.copy()
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                label = label[label]
                if (label == before).all():
                    break
    while (label[label] != label).any():
        label = label[label]
    return links, label


def near_vectors(table: DataFrame, threshold: float = 0.93, key: str = "vec_id",
                 vector: str = "embedding", label: str = "label", miss: float = 1e-3,
                 bits: int | None = None) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row; see the module for the rules."""
    spark = table.sparkSession
    small_batches(spark)
    rows = table.select(F.col(f"`{key}`").cast("bigint").alias("id"),
                        F.col(f"`{label}`").cast("string").alias("label"),
                        F.col(f"`{vector}`").cast("array<double>").alias("v"))
    # Every step is a map over the components; the norm is that of the double values.
    fine = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
                      F.lit(False))
    peak = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.when(fine & (peak > 0), F.transform("v", lambda x: x / peak))) \
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))) \
        .withColumn("v", F.transform("v", lambda x: x / F.col("norm"))).drop("norm")
    digest = F.when(F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull(),
                    F.struct(F.xxhash64("label", "v").alias("d1"),
                             F.xxhash64("v", F.lit(1), "label").alias("d2")))
    rows = stash(rows.withColumn("d", digest))
    whole = rows.where("d is not null")
    reps = stash(whole.groupBy("d").agg(
        F.min("id").alias("id"), F.count_distinct("id").alias("weight"),
        F.first("label").alias("label"), F.first("v").alias("v")))
    facts = reps.groupBy("label", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.max("n"), F.sum("n"), F.max("d")).first()
    links = part_links(reps, facts, threshold, miss, bits) if facts[1] else \
        spark.createDataFrame([], PART)
    links = stash(links)
    found = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = reps.select("d", "weight", F.col("id").alias("rep")) \
        .join(counts.withColumnRenamed("id", "rep"), "rep", "left") \
        .join(found.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("d", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
                F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select("id", "d").join(named, "d", "left").select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def part_links(reps: DataFrame, facts, threshold: float, miss: float, bits: int | None) -> DataFrame:
    """``id, links, root`` partial link counts and spanning links from all units of work."""
    spark, (largest, total, width) = reps.sparkSession, facts
    bits = bits or min(30, max(4, math.ceil(math.log2(max(2, largest / BUCKET)))))
    step = -(-total // SAMPLE)
    sample = reps.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("v").limit(2 * SAMPLE)
    fitted = padded([r["v"] for r in sample.collect()] or [[1.0] * width], width)
    bits, tables = fitting(bits, threshold, miss, least_norm(fitted))
    model = spark.sparkContext.broadcast(learn(fitted, bits * tables))

    @F.arrow_udf(returnType="array<bigint>")
    def entries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mean, projection = model.value
        for batch in batches:
            codes = encode(padded(batch.to_pylist(), width), mean, projection, bits)
            yield pa.array(list(codes), type=pa.list_(pa.int64()))
    coded = reps.select("id", "weight", "v", F.xxhash64("label", F.size("v")).alias("g")) \
        .withColumn("codes", entries("v"))
    coded = stash(coded)
    placed = coded.select("id", "g", F.posexplode("codes").alias("t", "entry")) \
        .withColumn("bucket", F.xxhash64("g", "t", "entry"))
    blocks = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(
        "bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"))
    units = placed.join(blocks, "bucket").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb"))) \
        .select("id", "t", "bucket", "mine",
                F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")) \
        .select("id", "t", F.xxhash64("bucket", F.least("mine", "other"),
                                      F.greatest("mine", "other")).alias("unit"),
                (F.col("mine") > F.col("other")).cast("int").alias("side"))
    full = units.join(coded.select("id", "weight", "v", "codes"), "id")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = full.repartition(n, "unit").sortWithinPartitions("unit")

    def work(batches):
        held = None
        for batch in batches:
            part = {c: batch.column(c) for c in ("id", "t", "unit", "side", "weight")}
            part = {c: x.to_numpy(zero_copy_only=False) for c, x in part.items()}
            part["v"] = padded(batch.column("v").to_pylist(), width)
            part["codes"] = np.array(batch.column("codes").to_pylist()).reshape(-1, tables)
            if held is not None:
                part = {c: np.concatenate((held[c], part[c])) for c in part}
            cuts = np.flatnonzero(np.diff(part["unit"])) + 1
            ends = [0, *cuts.tolist()]
            yield from results(part, ends)
            held = {c: x[ends[-1]:] for c, x in part.items()}
        if held is not None and len(held["id"]):
            yield from results(held, [0, len(held["id"])])

    def results(part, ends):
        ids, links, roots = [], [], []
        for lo, hi in zip(ends, ends[1:]):
            if hi - lo < 2:
                continue
            u = {c: x[lo:hi] for c, x in part.items()}
            got, label = unit_links(u["v"], u["codes"], u["side"], int(u["t"][0]), u["weight"], threshold)
            some = np.flatnonzero(got)
            ids.append(u["id"][some])
            links.append(got[some])
            roots.append(u["id"][label[some]])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64))
                                              for x in (ids, links, roots)], ["id", "links", "root"])
    return dealt.mapInArrow(work, PART)


def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))

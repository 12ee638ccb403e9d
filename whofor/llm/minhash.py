"""MinHash near-dedup on word shingles.

A document's set holds its distinct shingles of five words (A-Z in lower case, words between
white space); fewer words make one shingle, no words an empty set that links with nothing. Sets
are hashed to 64-bit numbers, minima of many universal hashes form a signature, and bands of the
signature propose pairs. Documents with equal sets share one representative first, so copies cost
nothing. Each document is first compared with the smallest one it meets in any bucket. Buckets that
this leaves in several components are then searched in units: blocks of a bounded size, each pair
of blocks once. A unit compares signatures and, where they are close enough (five standard
deviations below the threshold), sketches of the smallest shingles, of which a set of up to
``SKETCH`` shingles consists wholly; it returns few candidates instead of all pairs of a bucket,
and a pair met in several bands counts in the first. All candidates are confirmed on full sets.

With 20 bands of 5 minima a pair at 0.85 is proposed with probability 1 - 8e-6 (at 0.8: 0.9996).

A null or empty text has an empty set. Rows of one id are one document; a row without an id has
no component and is kept. Extra columns are not carried; an empty table gives an empty result.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.graph import components, light, stash
from whofor.llm.tokens import SPACES, folding, hashed_words, mix, read_table, slices, small_batches

WIDTH = 5
FOLD = folding(SPACES)
BANDS, PER_BAND = 20, 5
SKETCH, BLOCK = 256, 1024
SIGN = pa.struct([("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                  ("bands", pa.list_(pa.int64()))])
SIGN_DDL = "struct<n: bigint, d1: bigint, d2: bigint, bands: array<bigint>>"
SETS = pa.struct([("shingles", pa.list_(pa.int64())), ("minima", pa.binary()), ("sketch", pa.binary())])
SETS_DDL = "struct<shingles: array<bigint>, minima: binary, sketch: binary>"
UNIT_DDL = "a bigint, b bigint"
_RNG = np.random.default_rng(77)
_HASHES = BANDS * PER_BAND
_A = _RNG.integers(1, 2 ** 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2 ** 63, _HASHES, dtype=np.uint64)
_FOLD_WORDS = [np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64)) for i in range(WIDTH + 1)]


def shingle_sets(texts, width: int = WIDTH):
    """For each text the sorted distinct 64-bit shingles."""
    words, at = hashed_words(texts, FOLD)
    n = len(words) - width + 1
    rolled = np.full(max(n, 0), width, dtype=np.uint64)
    for i in range(width if n > 0 else 0):
        rolled = rolled + words[i:i + n] * _FOLD_WORDS[i + 1]
    rolled = mix(rolled)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i >= width:
            yield np.unique(rolled[i:j - width + 1])
        elif j > i:
            one = np.uint64(j - i) + sum(words[i + k:i + k + 1] * _FOLD_WORDS[k + 1]
                                         for k in range(j - i))
            yield mix(one)
        else:
            yield words[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash over a set, in blocks of the set."""
    low = np.full(_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[k:k + 2048, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, PER_BAND).T.astype(np.uint64):
        keys = mix(keys * _FOLD_WORDS[1] + column)
    return keys


def signed(df: DataFrame, text: str) -> DataFrame:
    """Set size, a 128-bit digest of the set and its band keys."""

    @F.arrow_udf(returnType=SIGN_DDL)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            out = []
            for run in slices(batch.cast(pa.binary())):
                for s in shingle_sets(run):
                    out.append({"n": len(s),
                                "d1": int(mix(s + one).sum(dtype=np.uint64).view(np.int64)),
                                "d2": int(mix(s ^ two).sum(dtype=np.uint64).view(np.int64)),
                                "bands": band_keys(minima(s)).view(np.int64) if len(s) else None})
            yield pa.array(out, type=SIGN)
    small_batches(df.sparkSession)
    return df.withColumn("__s", sign(F.col(text).cast("string").cast("binary")))


def with_sets(df: DataFrame, text: str) -> DataFrame:

    @F.arrow_udf(returnType=SETS_DDL)
    def full(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [{"shingles": s.view(np.int64), "minima": minima(s).tobytes(),
                    "sketch": s[:SKETCH + 1].tobytes()}
                   for run in slices(batch.cast(pa.binary())) for s in shingle_sets(run)]
            yield pa.array(out, type=SETS)
    small_batches(df.sparkSession)
    return df.withColumn("__s", full(F.col(text).cast("string").cast("binary")))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return pairs.join(left, "a").join(right, "b").where(
        F.lit(100) * shared >= F.lit(percent) * union).select("a", "b").distinct()


def may_link(x: np.ndarray, y: np.ndarray, limit: float) -> bool:
    """Whether two sketches allow a similarity of ``limit`` (sure for sets that fit in one)."""
    top = min(x[-1] if len(x) > SKETCH else np.iinfo(np.uint64).max,
              y[-1] if len(y) > SKETCH else np.iinfo(np.uint64).max)
    whole = len(x) <= SKETCH and len(y) <= SKETCH
    if not whole:
        x, y = x[x <= top], y[y <= top]
    shared = len(np.intersect1d(x, y, assume_unique=True))
    union = max(len(x) + len(y) - shared, 1)
    slack = 0 if whole else 5 * math.sqrt(limit * (1 - limit) / union)
    return shared / union >= limit - slack - 1e-12


def unit_pairs(ids, parts, sides, low, sketches, band: int, limit: float, floor: float):
    """Candidate pairs of a unit: other component, not met in an earlier band, close sketches."""
    one = bool((sides == sides[0]).all())
    bands = low.reshape(len(low), BANDS, PER_BAND)
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        ok = (parts[rest] != parts[i]) & (one | (sides[rest] != sides[i])) & (ids[rest] != ids[i])
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            j = j[(low[j] == low[i]).mean(axis=1) >= floor]
        if len(j) and band:
            j = j[~(bands[j, :band] == bands[i, :band]).all(axis=2).any(axis=1)]
        for k in j.tolist():
            if may_link(sketches[i], sketches[k], limit):
                yield ids[i], ids[k]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    percent: int = 85, broadcast_rows: int = 300_000) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked when 100 * shared >= percent * union on their sets.
    """
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    signs = stash(signed(source, "text").select(
        "id", F.col("__s.n").alias("n"), F.col("__s.d1").alias("d1"), F.col("__s.d2").alias("d2"),
        F.col("__s.bands").alias("bands")))
    group = ["d1", "d2", "n"]
    some = signs.where("n > 0 and id is not null")
    reps = stash(some.groupBy(*group).agg(F.min("id").alias("rep")))
    own = some.join(reps.select(F.col("rep").alias("id"), *group), ["id", *group], "left_semi")
    rows = own.select(F.col("id").alias("rep"), F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"),
                                        F.count(F.lit(1)).alias("c")).where("lead < last").drop("last")
    members = stash(rows.join(shared, "bucket").distinct())
    wanted = members.select(F.col("rep").alias("id")).distinct()
    sets = stash(with_sets(source.join(light(wanted, broadcast_rows), "id", "left_semi"), "text").select(
        F.col("id").alias("rep"), F.col("__s.shingles").alias("shingles"),
        F.col("__s.minima").alias("minima"), F.col("__s.sketch").alias("sketch")))
    star = members.groupBy("rep").agg(F.min("lead").alias("a")).where("rep <> a") \
        .select("a", F.col("rep").alias("b"))
    links = stash(confirmed(star, sets, percent))
    across = stash(candidates(members, components(links), sets, percent / 100))
    links = stash(links.union(confirmed(across, sets, percent)))
    joined = components(links).select(F.col("node").alias("rep"), "component")
    labels = reps.select(*group, "rep").join(joined, "rep", "left").select(
        *group, F.coalesce("component", "rep").alias("component"))
    return signs.join(labels, group, "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))


def candidates(members: DataFrame, found: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """Candidate pairs between components that meet in a bucket."""
    spark = members.sparkSession
    placed = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left") \
        .select("bucket", "band", "rep", "c", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")) \
        .where("c0 < c1").select("bucket")
    nb = F.ceil(F.col("c") / BLOCK).cast("int")
    units = placed.join(split, "bucket", "left_semi").withColumn("mine", F.pmod(F.xxhash64("rep"), nb)) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1))) \
        .select("rep", "component", "band", F.xxhash64("bucket", F.least("mine", "other"),
                                                       F.greatest("mine", "other")).alias("unit"),
                (F.col("mine") > F.col("other")).cast("int").alias("side"))
    full = units.join(sets.select("rep", "minima", "sketch"), "rep")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    floor = limit - 5 * math.sqrt(limit * (1 - limit) / _HASHES)

    def work(batches):
        held = None
        for batch in batches:
            part = {c: batch.column(c).to_numpy(zero_copy_only=False)
                    for c in ("unit", "rep", "component", "band", "side")}
            part["minima"] = np.array([np.frombuffer(x, dtype=np.uint32)
                                       for x in batch.column("minima").to_pylist()]).reshape(-1, _HASHES)
            sketches = np.empty(len(part["rep"]), dtype=object)
            sketches[:] = batch.column("sketch").to_pylist()
            part["sketch"] = sketches
            if held is not None:
                part = {c: np.concatenate((held[c], part[c])) for c in part}
            ends = [0, *(np.flatnonzero(np.diff(part["unit"])) + 1).tolist()]
            yield from results(part, ends)
            held = {c: x[ends[-1]:] for c, x in part.items()}
        if held is not None and len(held["rep"]):
            yield from results(held, [0, len(held["rep"])])

    def results(part, ends):
        pairs = []
        for lo, hi in zip(ends, ends[1:]):
            u = {c: x[lo:hi] for c, x in part.items()}
            if hi - lo > 1 and (u["component"] != u["component"][0]).any():
                sketches = [np.frombuffer(x, dtype=np.uint64) for x in u["sketch"]]
                pairs += unit_pairs(u["rep"], u["component"], u["side"], u["minima"], sketches,
                                    int(u["band"][0]), limit, floor)
        if pairs:
            ids = np.sort(np.array(pairs, dtype=np.int64), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], ["a", "b"])
    small_batches(spark)
    return full.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(work, UNIT_DDL).distinct()


def kept_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group of near copies (that of the smallest doc_id), columns unchanged.

    Rows that repeat a kept doc_id are one document as well: one of them stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = stash(near_duplicates(docs, percent=percent).where("doc_id is not null"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*columns)
    twice = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    return left.join(twice, "doc_id", "left_anti").select(*columns).union(
        left.join(twice, "doc_id", "left_semi").select(*columns).dropDuplicates(["doc_id"]))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)

"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct alphanumeric words (A-Z in lower case) and the beginnings of longer
ones, hashed to a fixed number of slots. The machine gives every slot a weight and a vector; a
text's logit is the bias, the weights, and the inner products of all pairs of its terms' vectors,
so two terms can mean together what neither means alone. Pairs are summed in linear time through
squares of sums.

Only slots whose presence depends on the label in the training rows (``evidence``, a chi-square
bound, on at least ``least`` rows) are active: a long text's many neutral words would otherwise
drown pairs in chance products. Counts and bound are taken over all training rows.

Training rows are drawn by a hash of the id (``fit_rows`` bounds them; None takes all) and dealt
to a fixed number of lanes. In a round each lane takes one pass of adaptive gradient steps from
the shared parameters; Spark collects the parameters of the lanes, of fixed size, and every slot
becomes the mean over the lanes that met it.

Null and empty texts have no terms: their score is the bias. Labels other than 0 and 1 are left
out; without labels every score is 0.5 and nothing is predicted toxic. Other columns pass
unchanged; columns named as the outputs are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.graph import stash
from whofor.llm.tokens import (NOT_ALNUM, add_fields, folding, hash_words, joined, mix, read_table,
                               slices, small_batches, word_spans)

SLOTS, FACTORS, LANES, ROUNDS = 1 << 20, 8, 8, 8
BEGINNINGS = (4, 6)
FOLD = folding(NOT_ALNUM)
RATE, RIDGE, STEP_ROWS = 0.15, 1e-4, 16


def term_slots(texts) -> list[np.ndarray]:
    """Distinct slots of each text's terms."""
    text, at = joined(texts)
    buf = np.frombuffer(text.translate(FOLD), dtype=np.uint8)
    starts, ends = word_spans(buf)
    first = np.searchsorted(starts, at)
    kinds = [hash_words(buf, starts, ends)]
    for k, n in enumerate(BEGINNINGS, 1):
        short = hash_words(buf, starts, np.minimum(ends, starts + n))
        kinds.append(mix(short + np.uint64(k)))
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        long = [h[i:j][ends[i:j] - starts[i:j] > n] for h, n in zip(kinds[1:], BEGINNINGS)]
        out.append(np.unique(np.concatenate((kinds[0][i:j], *long)) % np.uint64(SLOTS)).astype(np.int32))
    return out


def active_of(slots: list[np.ndarray], active: np.ndarray) -> list[np.ndarray]:
    """Places of a text's slots in the sorted array of active slots."""
    out = []
    for s in slots:
        at = np.searchsorted(active, s)
        at[at == len(active)] = 0
        out.append(at[active[at] == s] if len(active) else s[:0])
    return out


class Machine:
    """Weights, vectors and the squared-gradient sums of the adaptive steps."""

    def __init__(self, size: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bias, self.bias_sum = -2.0, 1.0
        self.weight = np.zeros(size, dtype=np.float32)
        self.vector = rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)
        self.weight_sum = np.full(size, 0.1, dtype=np.float32)
        self.vector_sum = np.full((size, FACTORS), 0.1, dtype=np.float32)

    def logits(self, slots: list[np.ndarray]):
        """Logits of texts, and what the gradient needs: flat slots, rows, vectors, sums."""
        sizes = np.array([len(s) for s in slots])
        flat = np.concatenate(slots) if len(slots) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(slots)), sizes)
        v = self.vector[flat]
        linear = np.bincount(row, self.weight[flat], len(slots))
        square = np.bincount(row, (v * v).sum(axis=1), len(slots))
        total = np.stack([np.bincount(row, v[:, f], len(slots)) for f in range(FACTORS)], axis=1)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - square), flat, row, v, total

    def step(self, slots: list[np.ndarray], y: np.ndarray) -> None:
        z, flat, row, v, total = self.logits(slots)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32)
        self.bias_sum += float(err.sum()) ** 2
        self.bias -= RATE * float(err.sum()) / self.bias_sum ** 0.5
        used, where = np.unique(flat, return_inverse=True)
        gw = np.bincount(where, err[row], len(used)) + RIDGE * self.weight[used]
        pull = err[row, None] * (total[row].astype(np.float32) - v)
        gv = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(FACTORS)], axis=1) \
            + RIDGE * self.vector[used]
        self.weight_sum[used] += gw * gw
        self.vector_sum[used] += gv * gv
        self.weight[used] -= (RATE * gw / np.sqrt(self.weight_sum[used])).astype(np.float32)
        self.vector[used] -= (RATE * gv / np.sqrt(self.vector_sum[used])).astype(np.float32)

    def pack(self) -> bytes:
        return np.concatenate(([self.bias, self.bias_sum], self.weight, self.weight_sum,
                               self.vector.ravel(), self.vector_sum.ravel())).astype("<f4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> "Machine":
        x = np.frombuffer(data, dtype="<f4").copy()
        new, size = cls.__new__(cls), (len(x) - 2) // (2 + 2 * FACTORS)
        new.bias, new.bias_sum = float(x[0]), float(x[1])
        cuts = np.cumsum([2, size, size, size * FACTORS])
        new.weight, new.weight_sum = x[cuts[0]:cuts[1]], x[cuts[1]:cuts[2]]
        new.vector = x[cuts[2]:cuts[3]].reshape(size, FACTORS)
        new.vector_sum = x[cuts[3]:].reshape(size, FACTORS)
        return new


def merged(start: Machine, lanes: list[Machine]) -> Machine:
    """Mean of each slot over the lanes that changed it."""
    new = Machine.unpack(start.pack())
    for name in ("weight", "vector"):
        total, met = np.zeros_like(getattr(new, name)), np.zeros_like(getattr(new, name))
        sums = getattr(new, name + "_sum").copy()
        for lane in lanes:
            moved = getattr(lane, name + "_sum") > getattr(start, name + "_sum")
            met += moved
            total += np.where(moved, getattr(lane, name), 0)
            sums += getattr(lane, name + "_sum") - getattr(start, name + "_sum")
        setattr(new, name, np.where(met > 0, total / np.maximum(met, 1), getattr(new, name)))
        setattr(new, name + "_sum", sums)
    new.bias = float(np.mean([x.bias for x in lanes]))
    new.bias_sum = float(np.mean([x.bias_sum for x in lanes]))
    return new


def training(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, use: Column,
             fit_rows: int | None) -> DataFrame:
    """``slots, y``, each pair once: the draw is made on the labels, so texts are not moved."""
    known = labels.where(F.col(label).isin(0, 1) & use).groupBy(key).agg(F.max(label).alias("y"))
    if fit_rows:
        every = max(1, known.count() // fit_rows)
        known = known.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0)
        known = F.broadcast(known)       # at most about twice fit_rows short rows

    @F.arrow_udf(returnType="array<int>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s for run in slices(batch.cast(pa.binary())) for s in term_slots(run)],
                           type=pa.list_(pa.int32()))
    small_batches(docs.sparkSession)
    rows = docs.select(key, F.col(text).cast("string").cast("binary").alias("__t")).join(known, key)
    return stash(rows.select(terms("__t").alias("slots"), F.col("y").cast("int").alias("y"))
                 .dropDuplicates(["slots", "y"]))


def active_slots(rows: DataFrame, least: int, evidence: float) -> np.ndarray:
    """Slots that depend on the label, sorted (at most ``SLOTS``)."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).first()
    n, n1 = float(total["n"]), float(total["n1"])
    a, m = F.col("a"), F.col("m")
    chi = n * F.pow(a * n - m * n1, 2) / (m * (n - m + 1e-9) * n1 * (n - n1) + 1e-9)
    counts = rows.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.sum("y").cast("double").alias("a"))
    picked = counts.where((m >= least) & (chi >= evidence)).select("slot").collect()
    return np.sort(np.array([r[0] for r in picked], dtype=np.int32))


def fit(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text",
        label: str = "toxic", fit_rows: int | None = 20_000, least: int = 4,
        evidence: float = 12.0) -> tuple[np.ndarray, Machine] | None:
    """Train on labelled rows for which ``use`` (a condition on the labels' columns) holds."""
    rows = training(docs, labels, key, text, label, use, fit_rows)
    if rows.isEmpty():
        return None
    spark, active = docs.sparkSession, active_slots(rows, least, evidence)
    machine, slots = Machine(len(active)), spark.sparkContext.broadcast(active)

    @F.arrow_udf(returnType="array<int>")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = active_of([np.array(s, dtype=np.int32) for s in batch.to_pylist()], slots.value)
            yield pa.array(found, type=pa.list_(pa.int32()))
    lane = F.pmod(F.xxhash64("slots"), F.lit(LANES)).cast("int").alias("lane")
    rows = stash(rows.select(lane, F.xxhash64("slots").alias("h"), kept("slots").alias("slots"), "y"))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(machine.pack())

        def one_pass(batches, turn=turn, shared=shared):
            own, held = {}, {}
            for batch in batches:
                for lane, found, y in zip(*(batch.column(c).to_pylist() for c in ("lane", "slots", "y"))):
                    held.setdefault(lane, []).append((np.array(found, dtype=np.int32), y))
                    if len(held[lane]) == STEP_ROWS:
                        run(own, lane, held.pop(lane), shared)
            for lane in list(held):
                run(own, lane, held.pop(lane), shared)
            for lane, machine in own.items():
                yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([machine.pack()])],
                                                 ["lane", "model"])
        dealt = rows.repartition(LANES, "lane").sortWithinPartitions("lane", F.xxhash64("h", F.lit(turn)))
        lanes = dealt.mapInArrow(one_pass, "lane int, model binary").collect()
        machine = merged(machine, [Machine.unpack(bytes(r["model"])) for r in lanes])
        shared.destroy()
    return active, machine


def run(own: dict, lane: int, rows: list, shared) -> None:
    if lane not in own:
        own[lane] = Machine.unpack(shared.value)
    own[lane].step([s for s, _ in rows], np.array([y for _, y in rows], dtype=np.float32))


def score(docs: DataFrame, model: tuple[np.ndarray, Machine] | None, text: str = "text") -> DataFrame:
    """``docs`` with ``tox_score``, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model[0], model[1].pack()) if model else None)

    @F.arrow_udf(returnType="struct<tox_score: double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        active, own = None, None
        if shared.value is not None:
            active, own = shared.value[0], Machine.unpack(shared.value[1])
        for batch in batches:
            out = []
            for part in slices(batch.cast(pa.binary())):
                z = own.logits(active_of(term_slots(part), active))[0] if own else np.zeros(len(part))
                out += (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
            yield pa.array([{"tox_score": x} for x in out], type=pa.struct([("tox_score", pa.float64())]))
    return add_fields(docs, scored(F.col(text).cast("string").cast("binary")), ["tox_score"])


def fold(key: str = "doc_id") -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def clean_documents(docs: DataFrame, documents: DataFrame, labels: DataFrame,
                    threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, columns unchanged."""
    model = fit(documents, labels, ~fold())
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    scored = score(inner, model)
    return (scored.where(F.col("tox_score") < threshold) if model else scored).select("__row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~fold())
    scored = score(docs, model)
    return scored.select("doc_id", fold().alias("held_out"), F.col("tox_score").alias("score"),
                         ((F.col("tox_score") >= 0.3) & F.lit(model is not None)).cast("int")
                         .alias("predicted"))

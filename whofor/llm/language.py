"""Language identification by string kernels, Nyström landmarks and kernel ridge regression.

The kernel of two texts is a blended spectrum of n-gram presence: for n = 1, 2, 3 the share of
hashed byte n-grams (A-Z in lower case, all that is no letter as one blank) that both texts hold,
each normalised by the presence norms, weighted and summed. Landmarks are training documents
drawn by hash, as many from each language; a text becomes its kernel values against them, times
the inverse root of the landmarks' own kernel matrix. One-versus-rest ridge regression on these
features is solved from sums that every partition adds up over all training rows it is given
(``fit_rows`` bounds them by a hash draw; None takes all). Texts are scored in batches as matrix
products.

``und`` with score 0 for null texts and texts without a letter, and when nothing can be learnt.
Scores are the winner's share after a softmax of the regression values. Other columns pass
unchanged; columns named as the outputs are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.tokens import add_fields, read_table, slices, small_batches

SIZES = (256, 1 << 12, 1 << 14)
WEIGHTS = (0.2, 0.4, 0.4)
WIDTH = sum(SIZES)
SHARPNESS = 6.0
FIELDS = ["lang_pred", "lang_score"]
DDL = "struct<lang_pred: string, lang_score: double>"
OUT = pa.struct([("lang_pred", pa.string()), ("lang_score", pa.float64())])


def _folding() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else 0x20
    return table


FOLD = _folding()


def presence(texts) -> np.ndarray:
    """Rows of normalised, weighted 0/1 n-gram presence."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for row, text in zip(out, texts):
        b = FOLD[np.frombuffer(text or b"", dtype=np.uint8)].astype(np.uint32)
        if len(b):
            b = b[np.append(True, (b[1:] != 0x20) | (b[:-1] != 0x20))]
        b = np.concatenate(([0x20], b, [0x20])).astype(np.uint32)
        grams, at = b, 0
        for n, size in enumerate(SIZES, 1):
            if n > 1:
                grams = grams[:-1] * np.uint32(0x01000193) ^ (b[n - 1:] * np.uint32(0x9E3779B1))
            spread = grams * np.uint32(0x85EBCA6B) >> np.uint32(33 - size.bit_length())
            row[at:at + size][spread if n > 1 else grams] = 1
            at += size
    return normalised(out)


def runs(batch: pa.Array, rows: int = 64):
    """Texts of a batch, few at a time (a presence row is wide)."""
    for part in slices(batch.cast(pa.binary())):
        for k in range(0, len(part), rows):
            yield part[k:k + rows]


def has_letter(text) -> bool:
    return bool(text) and (text.translate(None, _NOT_ASCII_LETTER) != b""
                           or any(c.isalpha() for c in text.decode("utf-8", "replace")))


_NOT_ASCII_LETTER = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())


def training(docs: DataFrame, text: str, label: str, use: Column, rows: int | None) -> DataFrame:
    """``x, y`` of the rows to learn from; a hash of the text draws about ``rows`` of them."""
    picked = docs.where(use & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).cast("string").cast("binary").alias("x"), F.col(label).cast("string").alias("y"))
    every = max(1, picked.count() // rows) if rows else 1
    return picked.where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0)


def landmarks(picked: DataFrame, per_language: int) -> tuple[list[str], np.ndarray]:
    """The languages, and presence rows of one to two times ``per_language`` texts of each.

    Only packed presence bits (a few kilobytes a text) come to the driver.
    """

    @F.arrow_udf(returnType="binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.packbits(row > 0).tobytes() for part in runs(batch)
                            for row in presence(part)], type=pa.binary())
    counts = {r["y"]: r["count"] for r in picked.groupBy("y").count().collect()}
    if not counts:
        return [], np.zeros((0, WIDTH), dtype=np.float32)
    steps = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, max(1, n // per_language))])
    drawn = picked.where(F.pmod(F.xxhash64("x", F.lit("landmark")), steps[F.col("y")]) == 0)
    bits = [r[0] for r in drawn.select(packed("x")).limit(4 * per_language * len(counts)).collect()]
    rows = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8)).reshape(len(bits), -1)
    return sorted(counts), normalised(rows[:, :WIDTH].astype(np.float32))


def normalised(rows: np.ndarray) -> np.ndarray:
    at = 0
    for size, weight in zip(SIZES, WEIGHTS):
        part = rows[:, at:at + size]
        part *= np.sqrt(weight / np.maximum(part.sum(axis=1, keepdims=True), 1))
        at += size
    return rows


def fit(docs: DataFrame, text: str, label: str, use: Column, per_language: int = 24,
        fit_rows: int | None = 20_000, ridge: float = 1e-3):
    """Languages, feature projection and regression weights (None when there is nothing to learn)."""
    small_batches(docs.sparkSession)
    picked = training(docs, text, label, use, fit_rows)
    names, marks = landmarks(picked, per_language)
    if not len(marks):
        return None
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.ascontiguousarray(marks.T @ root.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast((names, features))
    m, k = features.shape[1] + 1, len(names)

    def sums(batches):
        names, features = shared.value
        total = np.zeros((m, m + k))
        for batch in batches:
            at, ys = 0, batch.column("y").to_pylist()
            for part in runs(batch.column("x")):
                phi = np.ones((len(part), m))
                phi[:, 1:] = presence(part) @ features
                y = np.full((len(part), k), -1.0)
                for row, name in zip(y, ys[at:at + len(part)]):
                    row[names.index(name)] = 1.0
                at += len(part)
                total += phi.T @ np.hstack((phi, y))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])
    cells = picked.mapInArrow(sums, "cell bigint, value double").groupBy("cell").agg(
        F.sum("value").alias("value")).collect()
    total = np.zeros(m * (m + k))
    for r in cells:
        total[r["cell"]] = r["value"]
    total = total.reshape(m, m + k)
    gram = total[:, :m] + ridge * max(total[0, 0], 1.0) * np.eye(m)
    return names, features, np.linalg.solve(gram, total[:, m:]).astype(np.float32)


def identify(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(returnType=DDL)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for part in runs(batch):
                known = [has_letter(t) and shared.value is not None for t in part]
                if any(known):
                    names, features, weights = shared.value
                    value = (presence(part) @ features) @ weights[1:] + weights[0]
                    share = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
                    share /= share.sum(axis=1, keepdims=True)
                    best = share.argmax(axis=1)
                out += [{"lang_pred": names[best[i]], "lang_score": float(share[i, best[i]])} if ok
                        else {"lang_pred": "und", "lang_score": 0.0} for i, ok in enumerate(known)]
            yield pa.array(out, type=OUT)
    return add_fields(docs, scored(F.col(text).cast("string").cast("binary")), FIELDS)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit(docs, "text", "lang", ~F.coalesce(held, F.lit(False)))
    return identify(docs.drop("lang"), model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"))

"""Byte-level words and 64-bit hashes in NumPy, and the column plumbing of the text operators.

Texts come in as UTF-8 bytes (a string column cast to binary). Words, lower case and hashes are
all defined on bytes, so nothing is decoded. Work arrays follow slices of about one megabyte
that end at word ends, so a very long text costs memory for its words, not for its bytes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.session import small_batches

SLICE, HASHED = 1 << 20, 1 << 15
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)

#: Separators of the white-space words: blank and the six controls from tab to return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Separators of the alphanumeric words: all of ASCII but digits and letters.
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())


def folding(separators: bytes) -> bytes:
    """Translation table: A-Z to a-z, every separator to a blank."""
    table = bytearray(range(256))
    for b in range(65, 91):
        table[b] = b + 32
    for b in separators:
        table[b] = 0x20
    return bytes(table)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORTH, _BACKWARD = _powers(_STEP, SLICE), _powers(_BACK, SLICE)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def joined(values) -> tuple[bytes, np.ndarray]:
    """All texts with a blank after each, and where each begins (and the end)."""
    texts = [v or b"" for v in values]
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return b" ".join(texts) + b" ", at


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not blanks (``buf`` ends with a blank)."""
    word = buf != 0x20
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def _hash_piece(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(piece)
    forth, back = (_FORTH, _BACKWARD) if n <= SLICE else (_powers(_STEP, n), _powers(_BACK, n))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[piece] * forth[:n], out=total[1:])
    return (total[ends] - total[starts]) * back[starts]


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASHED, side="right")))
        lo = starts[i]
        out[i:j] = _hash_piece(buf[lo:ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def hashed_words(values, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the index of each text's first word (and the end)."""
    text, at = joined(values)
    buf = np.frombuffer(text.translate(table), dtype=np.uint8)
    starts, ends = word_spans(buf)
    return hash_words(buf, starts, ends), np.searchsorted(starts, at)


def slices(array: pa.Array, limit: int = 2 * SLICE):
    """A batch in runs of rows of about ``limit`` bytes; a longer text stands alone."""
    values, size, run = array.to_pylist(), 0, []
    for v in values:
        n = len(v) if v else 0
        if run and size + n > limit:
            yield run
            size, run = 0, []
        run.append(v)
        size += n
    if run:
        yield run


def as_bytes(name: str) -> Column:
    return F.col(name).cast("string").cast("binary")


def add_fields(df: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """``df`` with the fields of a struct column; columns of the same names are replaced."""
    small_batches(df.sparkSession)
    lower = {n.lower() for n in names}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lower]
    return df.withColumn("__fields", result).select(
        *keep, *[F.col("__fields").getField(n).alias(n) for n in names])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

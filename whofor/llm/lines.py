"""Fuzzy line dedup: word pairs or SimHash blocks, edit similarity, one line kept per group.

A line is what stands between line feeds; its normal form is its alphanumeric words, A-Z in lower
case; in scripts written without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) each
character is a word. Lines of at least ``min_words`` words take part, shorter ones always stay.
Equal normal forms are one line. Lines are linked by the edit similarity of their words (1 - edits /
words of the longer one) at ``share`` or more. Lines meet in pigeonhole blocks of a SimHash: each of
``blocks`` blocks is the majority vote of a few words that the block's own draw takes from the line,
as many as make it rare; an edit that misses the draw leaves the block whole. A pair at 0.8 shares
one of ten blocks with a probability of about 0.97 or more (measured in the tests), a closer one
almost surely. Counts of the words of all texts give the draws their weights.
Two other ways to meet remain as options. ``blocks=0, radius=None`` meets every similar pair: an
edit takes at most two pairs of neighbouring words from a line, so two similar lines share one
among the first few of each in any common order, and rare pairs come first (about 0.4 keys a word).
A ``radius`` cuts the SimHash of the whole line into five blocks of 32 bits and compares lines that
share one and differ in at most so many bits. Lines of a bucket are compared by their hashes, folded
ones first; what these leave is verified by the edit similarity in units of a bounded size, which
return the links that connect their lines and no pairs. Of every connected group the first
occurrence stays (by id, then place in the text), all others go.

A null text stays null, an empty one empty; texts keep their remaining lines in order. Rows of one
id are one document: what stays, stays in each of them. Rows without an id come last and count as
one document. Columns pass unchanged except the text; ``n_lines`` and ``n_removed`` are added or
replaced. Up to ``broadcast_rows`` documents with lines to fetch or drop are broadcast (as places
in a text); beyond that they are joined by shuffles.
"""

import ctypes
import re
from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from whofor.llm.graph import components, light, stash
from whofor.llm.tokens import (NOT_ALNUM, folding, hash_words, hashed_words, mix, read_table, slices,
                               small_batches, word_spans)

FOLD = folding(bytes(b for b in NOT_ALNUM if b != 0x0A))
WORDS_ONLY = folding(NOT_ALNUM)
#: A character of a script without spaces, as UTF-8 and as code points.
UNSPACED = re.compile(rb"[\xE3-\xE9][\x80-\xBF]{2}|\xE0[\xB8-\xBB][\x80-\xBF]|"
                      rb"\xE1[\x80-\x82\x9E\x9F][\x80-\xBF]|\xF0[\xA0-\xBF][\x80-\xBF]{2}")
UNSPACED_POINTS = r"[\x{3000}-\x{9FFF}\x{0E00}-\x{0EFF}\x{1000}-\x{10BF}\x{1780}-\x{17FF}\x{20000}-\x{3FFFF}]"
BITS, PARITY, BLOCKS = 160, 192, 10
SLOTS, BLOCK, RUN = 1 << 17, 1024, 1 << 21
#: Cells of an array of drawn words, how much longer its longest line is, and words compared at once.
CELLS, WIDER, CODES = 1 << 16, 1.5, 1 << 18
#: Columns of a line beside its id, the hash of its document and its keys.
LINE = [("pos", pa.int32(), "int"), ("again", pa.bool_(), "boolean"), ("n", pa.int32(), "int"),
        *((c, pa.int64(), "bigint") for c in ("h1", "h2", "s1", "s2", "s3"))]
WORDS_DDL = "array<struct<h1: bigint, words: string>>"
WORDS = pa.list_(pa.struct([("h1", pa.int64()), ("words", pa.string())]))


def given_back(results: Iterator) -> Iterator:
    """Hands freed memory back to the system at the end: workers live on between stages."""
    yield from results
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spaced(text: bytes) -> bytes:
    """Blanks around each character of a script without spaces."""
    if text.isascii() or np.frombuffer(text, dtype=np.uint8).max() < 0xE0:
        return text
    return UNSPACED.sub(rb" \g<0> ", text)


def simhashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """160-bit SimHash of each run of word hashes, as three numbers per row."""
    out = np.zeros((len(first), 24), dtype=np.uint8)
    ends = np.append(first[1:], len(words))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + 8192, side="right")))
        part = words[first[lo]:ends[hi - 1]]
        marks = np.stack([mix(part ^ np.uint64(k * 0x5A5A5A5ADEADBEEF)) for k in range(3)], axis=1)
        on = np.unpackbits(marks.view(np.uint8)[:, :BITS // 8], axis=1)
        size = ends[lo:hi] - first[lo:hi]
        kind = np.uint8 if size.max() < 256 else np.int32
        count = np.add.reduceat(on, first[lo:hi] - first[lo], axis=0, dtype=kind)
        most = count > (size // 2).astype(kind)[:, None]
        out[lo:hi, :BITS // 8] = np.packbits(most, axis=1)
        lo = hi
    return out.view(np.uint64)


def long_words(size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words make the SimHash: those of five bytes or more, or all where fewer than three are.

    Short words are the frequent ones; counted alike they would make all lines of a language close.
    """
    long = size >= 5
    few = np.add.reduceat(long, first, dtype=np.int64) < 3
    return long | np.repeat(few, np.diff(np.append(first, len(size))))


def parities(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """192 bits per run of word hashes, each the parity of its words: an edit turns two at most."""
    bit = mix(words)
    bit -= bit // np.uint64(PARITY) * np.uint64(PARITY)
    part, mark = bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(part == np.uint64(k), mark, np.uint64(0)), first)
                     for k in range(PARITY // 64)], axis=1)


def edits_allowed(n, share: float):
    """Edits that leave lines with ``n`` words in the longer one similar."""
    return np.floor(n - share * n + 1e-9).astype(np.int64)


def pair_keys(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, counts: np.ndarray, share: float):
    """Keys of the rarest word pairs of each line, so many that similar lines have one in common.

    Returns them in one array, with their number per line. A key is the pair's rarity (the
    logarithm of the product of its words' counts) and 56 bits of its hash: its own order.
    """
    longest = np.arange(int(sizes.max() / share) + 2)
    common = np.minimum.accumulate((longest - 1 - 2 * edits_allowed(longest, share))[::-1])[::-1]
    taken = np.clip(sizes - common[sizes], 1, np.maximum(sizes - 1, 1))
    left = np.ones(len(words), dtype=bool)
    left[first + sizes - 1] = False
    left = np.flatnonzero(left)
    pairs = mix(words[left] * np.uint64(0xD6E8FEB86659FD93) + words[left + 1])
    often = np.log2(1.0 + counts[(words & np.uint64(SLOTS - 1)).astype(np.int64)])
    rarity = np.minimum((often[left] + often[left + 1]) * 4, 255).astype(np.uint64)
    keys = rarity << np.uint64(56) | pairs >> np.uint64(8)
    line = np.repeat(np.arange(len(sizes)), sizes - 1)
    keys = keys[np.lexsort((keys, line))]
    at = np.concatenate(([0], np.cumsum(sizes - 1)[:-1]))
    use = np.arange(len(keys)) - at[line] < taken[line]
    use[1:] &= (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
    return keys[use].view(np.int64), np.bincount(line[use], minlength=len(sizes))


def majority(votes: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Bits set in more than half of the ``n`` votes (three planes of counters, up to seven votes)."""
    ones, twos, fours = votes
    return np.choose((n // 2).astype(np.int64), [ones | twos | fours, twos | fours, fours | (twos & ones), fours])


def drawn_blocks(words: np.ndarray, first: np.ndarray, rarity: np.ndarray, bits: float, blocks: int) -> np.ndarray:
    """SimHash of each run of word hashes in ``blocks`` blocks of 32 bits, one column each.

    A block is the majority vote of the words that its own draw takes from the line: the first by
    weighted order (rarer words sooner), until their rarity in bits comes to ``bits`` or they are a
    third of the line (two words at least, seven at most). Lines that share those words share the
    block, whatever else differs.
    """
    sizes = np.diff(np.append(first, len(words)))
    out = np.empty((len(first), blocks), dtype=np.uint64)
    by_size = np.argsort(sizes, kind="stable")
    long, lo = sizes[by_size], 0
    while lo < len(first):
        # Lines of about one length are rows of one array, as many as the caches hold.
        hi = int(np.searchsorted(long, long[lo] * WIDER + 2, side="right"))
        hi = lo + max(1, int(np.searchsorted(long[lo:hi] * np.arange(1, hi - lo + 1), CELLS, side="right")))
        line = by_size[lo:hi]
        index = np.minimum(first[line][:, None] + np.arange(long[hi - 1]), len(words) - 1)
        out[line] = drawn_side_by_side(words[index], rarity[index], sizes[line], bits, blocks)
        lo = hi
    return (out >> np.uint64(32)).astype(np.uint32)


def drawn_side_by_side(words: np.ndarray, rarity: np.ndarray, sizes: np.ndarray, bits: float, blocks: int) -> np.ndarray:
    """The blocks of lines that are rows of ``words``, of ``sizes`` words each."""
    weight, n = -(1.0 / rarity).astype(np.float32), len(sizes)
    least = int(sizes.min())
    beyond = np.arange(least, words.shape[1]) >= sizes[:, None]
    most = np.clip((sizes + 1) // 3, 2, 7)
    out = np.empty((n, blocks), dtype=np.uint64)
    for b in range(blocks):
        if b % 2 == 0:
            draw = mix(words ^ np.uint64((b + 1) * 0x9E3779B97F4A7C15 & 2 ** 64 - 1))
        bit = (draw >> np.uint64(40)).astype(np.uint32) if b % 2 == 0 else draw.astype(np.uint32) >> np.uint32(8)
        order = bit.view(np.int32).astype(np.float32)
        order += np.float32(0.5)
        order *= np.float32(2.0 ** -24)
        np.log(order, out=order)
        order *= weight
        np.copyto(order[:, least:], np.float32(np.inf), where=beyond)
        planes = [np.zeros(n, dtype=np.uint64) for _ in range(3)]
        votes, have, last = np.zeros(n, dtype=np.int64), np.zeros(n), np.full(n, -1, dtype=np.float32)
        live = row = np.arange(n)
        while len(live):
            at = order.argmin(axis=1) if len(row) == len(order) else order[row].argmin(axis=1)
            low = order[row, at]
            order[row, at] = np.inf
            # A word that stands twice is taken once: of equal ones the first, then all go.
            fresh = low > last[live]
            if not fresh.all():
                twice = row[~fresh]
                order[twice] = np.where(order[twice] == low[~fresh][:, None], np.float32(np.inf), order[twice])
            new = np.flatnonzero(fresh & (low < np.inf))
            one, mine = (live[new], at[new]), live[new]
            last[mine] = low[new]
            h = draw[one]
            carry = planes[0][mine] & h
            planes[0][mine] ^= h
            more = planes[1][mine] & carry
            planes[1][mine] ^= carry
            planes[2][mine] ^= more
            votes[mine] += 1
            have[mine] += rarity[one]
            left = np.flatnonzero((have[live] < bits) & (votes[live] < most[live]) & (low < np.inf))
            live, row = live[left], row[left]
            if 2 * len(row) < len(order):
                order, row = order[row], np.arange(len(row))
        out[:, b] = mix(majority(planes, votes) ^ np.uint64(b + 1))
    return out


def line_hashes(texts, min_words: int, counts: np.ndarray | None = None, share: float = 0.8,
                blocks: int = 0, bits: float = 0.0):
    """Lines of at least ``min_words`` words of all texts, as arrays.

    ``text`` (index), ``pos`` (place), ``again`` (it stood in the text before), ``n`` (words), a
    128-bit identity ``h1, h2`` and the SimHash ``s1, s2, s3``. With word ``counts`` these three
    hold the parities of the words, and ``keys`` (``n_keys`` per line) the rarest word pairs, or the
    ``blocks`` drawn blocks of a SimHash.
    """
    buf = np.frombuffer(b"\n".join(spaced(t or b"") for t in texts).translate(FOLD) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(buf == 0x0A)
    blank = np.where(buf == 0x0A, np.uint8(0x20), buf)
    starts, stops = word_spans(blank)
    words = hash_words(blank, starts, stops)
    at = np.concatenate(([0], np.searchsorted(starts, ends)))
    line = np.flatnonzero(np.diff(at) >= min_words)
    per_text = np.cumsum([0] + [(t or b"").count(b"\n") + 1 for t in texts])
    text = np.searchsorted(per_text, line, side="right") - 1
    out = {"text": text, "pos": (line - per_text[text]).astype(np.int32)}
    if not len(line):
        empty = np.zeros(0, dtype=np.int64)
        return out | {"again": empty.astype(bool), "n": empty, "h1": empty, "h2": empty, "s1": empty,
                      "s2": empty, "s3": empty, "keys": empty, "n_keys": empty}
    sizes = at[line + 1] - at[line]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    index = np.arange(int(sizes.sum())) - np.repeat(first - at[line], sizes)
    own = words[index]
    place = (np.arange(len(own)) - np.repeat(first, sizes)).astype(np.uint64)
    turned = mix(own + place * np.uint64(0x9E3779B97F4A7C15))
    h1 = mix(np.add.reduceat(turned, first)).view(np.int64)
    h2 = mix(np.add.reduceat(mix(turned), first)).view(np.int64)
    keys, n_keys = np.zeros(0, dtype=np.int64), np.zeros(len(line), dtype=np.int64)
    if counts is None:
        use = long_words((stops - starts)[index], first)
        kept = np.add.reduceat(use, first, dtype=np.int64)
        sims = simhashes(own[use], np.concatenate(([0], np.cumsum(kept)[:-1]))).view(np.int64)
    else:
        sims = parities(own, first).view(np.int64)
        if blocks:
            often = np.maximum(counts[(own & np.uint64(SLOTS - 1)).astype(np.int64)], 1.0)
            rarity = np.log2(1.0 + max(counts.sum(), 1.0) / often)
            keys = drawn_blocks(own, first, rarity, bits, blocks).view(np.int32).ravel().astype(np.int64)
            n_keys = np.full(len(line), blocks)
        else:
            keys, n_keys = pair_keys(own, first, sizes, counts, share)
    order = np.lexsort((line, h2, h1, text))
    same = np.zeros(len(line), dtype=bool)
    same[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]]) \
        & (text[order[1:]] == text[order[:-1]])
    return out | {"again": same, "n": sizes, "h1": h1, "h2": h2, "keys": keys, "n_keys": n_keys,
                  **{f"s{k + 1}": sims[:, k].copy() for k in range(3)}}


def line_rows(batches: Iterator, hashes, blocks: int, paired_words: bool) -> Iterator:
    """Batches of ``id, k`` and the lines of ``text``: a row for each, with its drawn blocks two to a number."""
    for batch in batches:
        done = 0
        for run in slices(batch.column("text").cast(pa.binary()), RUN):
            lines = hashes(run)
            if len(lines["text"]):
                mine = pa.array(lines["text"] + done)
                out = {c: batch.column(c).take(mine) for c in ("id", "k")}
                out |= {c: pa.array(lines[c], type=kind) for c, kind, _ in LINE}
                if blocks:
                    two = np.zeros((len(mine), blocks + blocks % 2), dtype=np.int32)
                    two[:, :blocks] = lines["keys"].reshape(-1, blocks)
                    out |= {f"b{k}": pa.array(two[:, 2 * k].astype(np.int64) << 32 | two[:, 2 * k + 1].view(np.uint32).astype(np.int64))
                            for k in range(two.shape[1] // 2)}
                elif paired_words:
                    ends = np.concatenate(([0], np.cumsum(lines["n_keys"]))).astype(np.int32)
                    out["keys"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(lines["keys"], type=pa.int64()))
                yield pa.RecordBatch.from_pydict(out)
            done += len(run)


def block_bits(block: int) -> Column:
    """The 32 bits of a drawn block, of which two stand in a number."""
    two = F.col(f"b{block // 2}")
    return F.shiftright(F.shiftleft(two, 32) if block % 2 else two, 32).cast("int")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, bit-parallel over the first one."""
    skip = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[skip:], b[skip:]
    skip = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[:len(a) - skip], b[:len(b) - skip]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        d = ((((eq & up) + up) ^ up) | eq | down) & full
        right = down | ~(d | up) & full
        left = up & d
        score += bool(right & top) - bool(left & top)
        right = (right << 1 | 1) & full
        up = (left << 1 | ~(d | right)) & full
        down = right & d
    return score


def similar(a: str, b: str, share: float) -> bool:
    return similar_words(a.split(" "), b.split(" "), share)


def similar_words(x: list, y: list, share: float) -> bool:
    longer = max(len(x), len(y))
    allowed = longer - share * longer + 1e-9
    if abs(len(x) - len(y)) > allowed:
        return False
    if len(x) == len(y) and sum(map(ne, x, y)) <= allowed:
        return True
    # Words that only one line has are edits in any case; first those that the other has not at all.
    if max(len(x) - sum(map(set(y).__contains__, x)), len(y) - sum(map(set(x).__contains__, y))) > allowed:
        return False
    more = Counter(x)
    more.subtract(y)
    spare = [n for n in more.values() if n]
    if max(sum(n for n in spare if n > 0), -sum(n for n in spare if n < 0)) > allowed:
        return False
    return edit_distance(x, y) <= allowed


def word_counts(source: DataFrame) -> np.ndarray:
    """Words of all texts, counted in ``SLOTS`` slots of their hashes."""

    def count(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for run in slices(batch.column("text").cast(pa.binary())):
                words, _ = hashed_words([spaced(t or b"") for t in run], WORDS_ONLY)
                total += np.bincount((words & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])
    found = source.select("text").mapInArrow(lambda batches: given_back(count(batches)), "slot bigint, n bigint") \
        .groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def bucket_rows(distinct: DataFrame) -> DataFrame:
    """One row per line and block of its SimHash: the block's 32 bits and its number make the bucket."""
    low = F.lit((1 << 32) - 1)
    blocks = [F.col("s1").bitwiseAND(low), F.shiftrightunsigned("s1", 32),
              F.col("s2").bitwiseAND(low), F.shiftrightunsigned("s2", 32), F.col("s3")]
    keys = F.array(*[F.xxhash64(F.lit(k), b) for k, b in enumerate(blocks)])
    return distinct.select("h1", "sketch", F.explode(keys).alias("bucket"))


def block_rows(distinct: DataFrame) -> DataFrame:
    """One row per line and drawn block; the low byte of a bucket is the number of its block."""
    return distinct.select("h1", "sketch", F.posexplode("keys").alias("block", "bits")).select(
        "h1", "sketch", F.shiftleft(F.col("bits").cast("long"), 8).bitwiseOR(F.col("block").cast("long")).alias("bucket"))


def sketch() -> Column:
    """The hashes of a line folded to 56 bits, and its number of words (255: as many or more).

    Folded hashes differ in no more bits than whole ones.
    """
    folded = F.col("s1").bitwiseXOR(F.col("s2")).bitwiseXOR(F.col("s3"))
    return F.shiftleft(folded.bitwiseXOR(F.shiftrightunsigned(folded, 56)), 8) \
        .bitwiseOR(F.least("n", F.lit(255)).cast("long"))


def near(apart: np.ndarray, longer: np.ndarray, edits: np.ndarray, radius: int | None) -> np.ndarray:
    """Whether hashes so many bits ``apart`` allow lines to be similar, one ``longer`` by so many words."""
    return apart <= radius if radius is not None else (longer <= edits) & (apart + longer <= 2 * edits)


def sketches_near(part: dict, x, y, radius: int | None) -> np.ndarray:
    a, b = part["sketch"][x], part["sketch"][y]
    apart = np.bitwise_count((a ^ b).view(np.uint64) >> np.uint64(8)).astype(np.int64)
    n, m = part["n"][x], part["n"][y]
    ok = near(apart, np.abs(n - m), np.maximum(part["edits"][x], part["edits"][y]), radius)
    return ok if radius is not None else ok | (n == 255) | (m == 255)


def hashes_near(part: dict, x, y, radius: int | None) -> np.ndarray:
    """Lines of different sides (or all of a unit with one side) that no earlier block has brought together."""
    apart = sum(np.bitwise_count(part[s][x] ^ part[s][y]).astype(np.int64) for s in ("s1", "s2", "s3"))
    ok = near(apart, np.abs(part["n"][x] - part["n"][y]), np.maximum(part["edits"][x], part["edits"][y]), radius)
    at = np.flatnonzero(ok)
    x, y = x[at], y[at]
    new = part["one"][x] | (part["side"][x] != part["side"][y])
    for k in range(part["keys"].shape[1] - 1):
        new &= (part["keys"][x, k] != part["keys"][y, k]) | (part["block"][x] <= k)
    ok[at] = new
    return ok


def pairs_of_runs(run: np.ndarray, n: np.ndarray, share: float | None, test):
    """Places ``x, y`` of the pairs within each run that ``test`` leaves, a bounded number at once.

    With a ``share``, of lines with ``n`` words only those that the shorter one's length allows.
    """
    run = np.cumsum(np.concatenate(([0], run[1:] != run[:-1]))) << 32
    order = np.argsort(run + n, kind="stable")
    key, most = (run + n)[order], (1 << 32) - 1 if share is None else np.floor(n[order] / share + 1e-6).astype(np.int64)
    count = np.searchsorted(key, run[order] + most, side="right") - np.arange(1, len(key) + 1)
    ends, lo = np.cumsum(count), 0
    while lo < len(key):
        before = ends[lo] - count[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + (1 << 18), side="right")))
        x = np.repeat(np.arange(lo, hi), count[lo:hi])
        y = x + 1 + np.arange(len(x)) - np.repeat(ends[lo:hi] - count[lo:hi] - before, count[lo:hi])
        x, y = order[x], order[y]
        ok = test(x, y)
        yield x[ok], y[ok]
        lo = hi


def paired(run: np.ndarray, n: np.ndarray, share: float | None, test) -> np.ndarray:
    """Which rows stand in a pair that ``test`` leaves."""
    out = np.zeros(len(run), dtype=bool)
    for x, y in pairs_of_runs(run, n, share, test) if len(run) else ():
        out[x] = out[y] = True
    return out


def bucket_members(rows: DataFrame, radius: int | None, share: float) -> DataFrame:
    """``bucket, h1, c`` of lines whose sketches allow a similar line in the bucket.

    Buckets of more than ``BLOCK`` lines (``c``) pass whole.
    """
    most, window = BLOCK, None if radius is not None else share

    def work(batches):
        held = None
        for batch in batches:
            part = {c: batch.column(c).to_numpy() for c in ("bucket", "h1", "sketch", "c")}
            few = part["c"] <= most
            yield out(part, ~few)
            part = {c: x[few] for c, x in part.items()}
            if held is not None:
                part = {c: np.concatenate((held[c], part[c])) for c in part}
            # Rows of a bucket stand together; the last one may go on.
            last = int(np.argmax(part["bucket"] == part["bucket"][-1])) if len(part["bucket"]) else 0
            yield found({c: x[:last] for c, x in part.items()})
            held = {c: x[last:] for c, x in part.items()}
        if held is not None:
            yield found(held)

    def out(part, use):
        return pa.RecordBatch.from_arrays([pa.array(part[c][use]) for c in ("bucket", "h1", "c")], ["bucket", "h1", "c"])

    def found(part):
        n = part["sketch"] & 255
        part |= {"n": n, "edits": edits_allowed(n, share)}
        return out(part, paired(part["bucket"], n, window, lambda x, y: sketches_near(part, x, y, radius)))
    met = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("c > 1")
    return met.mapInArrow(lambda batches: given_back(work(batches)), "bucket bigint, h1 bigint, c bigint")


def in_units(members: DataFrame) -> DataFrame:
    """Members with their unit: a bucket, or of a large one each pair of its blocks."""
    nb = F.when(F.col("c") > BLOCK, F.ceil(F.col("c") / BLOCK)).otherwise(1).cast("int")
    return members.withColumn("mine", F.pmod(F.xxhash64("h1"), nb)) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1))) \
        .select("h1", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"),
                (F.col("mine") > F.col("other")).cast("int").alias("side"),
                F.col("bucket").bitwiseAND(255).cast("int").alias("block"))


def by_unit(rows: DataFrame, work, schema, share: float) -> DataFrame:
    """``work`` on batches that hold whole units, with the arrays that ``hashes_near`` reads."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def whole(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))
            if last or held and held[-1].column("unit")[-1].as_py() != unit[-1]:
                yield pa.concat_batches([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield pa.concat_batches(held)

    def arrays(batch):
        part = {c: batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("h1", "unit", "side", "block", "n", "s1", "s2", "s3")}
        part |= {s: part[s].view(np.uint64) for s in ("s1", "s2", "s3")}
        starts = np.flatnonzero(np.concatenate(([True], part["unit"][1:] != part["unit"][:-1])))
        low, high = np.minimum.reduceat(part["side"], starts), np.maximum.reduceat(part["side"], starts)
        n = part["n"].astype(np.int64)
        return part | {"n": n, "edits": edits_allowed(n, share), "keys": batch.column("keys").flatten().to_numpy()
                       .reshape(len(n), -1), "one": np.repeat(low == high, np.diff(np.append(starts, len(n))))}

    def results(batches):
        for batch in whole(batches):
            if batch.num_rows:
                yield work(batch, arrays(batch))
    return rows.repartition(n, "unit").sortWithinPartitions("unit") \
        .mapInArrow(lambda batches: given_back(results(batches)), schema)


def one_gap_apart(codes: np.ndarray, starts: np.ndarray, x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Which pairs of lines are similar when the words that the longer one has more stand in one place.

    The beginnings are compared word by word up to any place, the rest from the ends: an upper bound
    of the edits, the smallest over all places. Lines are ``codes[starts[i]:starts[i + 1]]``.
    """
    n = np.diff(starts)
    swap = n[x] < n[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    size, gap = n[y], n[x] - n[y]
    allowed, ends = edits_allowed(n[x], share), np.cumsum(n[y])
    ok, lo = np.zeros(len(x), dtype=bool), 0
    while lo < len(x):
        before = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + CODES, side="right")))
        at = ends[lo:hi] - size[lo:hi] - before
        step = np.arange(ends[hi - 1] - before)
        b = codes[step + np.repeat(starts[y[lo:hi]] - at, size[lo:hi])]
        a = step + np.repeat(starts[x[lo:hi]] - at, size[lo:hi])
        behind = (codes[a + np.repeat(gap[lo:hi], size[lo:hi])] != b).astype(np.int64)
        turn = np.cumsum((codes[a] != b) - behind)
        base = np.concatenate(([0], turn))[at]
        best = np.minimum(np.minimum.reduceat(turn, at) - base, 0)
        ok[lo:hi] = gap[lo:hi] + np.add.reduceat(behind, at) + best <= allowed[lo:hi]
        lo = hi
    return ok


def spanning(pairs, words: pa.Array, share: float) -> list:
    """Verified links among ``pairs`` (arrays ``x, y``), without those between lines connected already."""
    lists = pc.split_pattern(words, " ")
    starts, codes = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode().indices.to_numpy()
    up: dict = {}

    def root(i):
        while up.get(i, i) != i:
            up[i] = up.get(up[i], up[i])
            i = up[i]
        return i

    def line(i):
        return codes[starts[i]:starts[i + 1]].tolist()
    out = []
    for x, y in pairs:
        sure = one_gap_apart(codes, starts, x, y, share)
        # Pairs that are surely similar connect first, so that fewer of the others are left to verify.
        for known in (True, False):
            for i, j in zip(x[sure == known].tolist(), y[sure == known].tolist()):
                a, b = root(i), root(j)
                if a != b and (known or similar_words(line(i), line(j), share)):
                    up[b] = a
                    out.append((i, j))
    return out


def line_links(hashes: DataFrame, rows: DataFrame, text_of, radius: int | None, share: float) -> DataFrame:
    """Verified links ``a, b`` between distinct lines that meet in the buckets of ``rows``.

    Lines without a near one in their bucket go first, by sketches and then by whole hashes. Units
    return what connects their lines, fewer links than lines, however many pairs are similar.
    """
    members = in_units(stash(bucket_members(rows, radius, share)))
    joined, window = members.join(hashes, "h1"), None if radius is not None else share

    def kept(batch, part):
        return batch.filter(pa.array(paired(part["unit"], part["n"], window, lambda x, y: hashes_near(part, x, y, radius))))

    def linked(batch, part):
        pairs = pairs_of_runs(part["unit"], part["n"], window, lambda x, y: hashes_near(part, x, y, radius))
        out = spanning(pairs, batch.column("words"), share)
        ids = part["h1"][np.array(out, dtype=np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], ["a", "b"])
    met = stash(by_unit(joined, kept, joined.schema, share))
    texts = stash(text_of(met.select("h1").distinct()))
    return by_unit(met.join(texts, "h1"), linked, "a bigint, b bigint", share)


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5,
                        radius: int | None = 30, share: float = 0.8,
                        broadcast_rows: int = 300_000, blocks: int = 0) -> DataFrame:
    """``docs`` without lines that repeat, exactly or nearly, an earlier line of any document.

    With ``blocks`` lines meet in so many drawn blocks of a SimHash. Without, ``radius`` None
    compares all lines similar at ``share`` (0.8 or more), a number only those that blocks of the
    whole line's SimHash propose.
    """
    radius = None if blocks else radius
    spark = docs.sparkSession
    small_batches(spark)

    def hashed(batches):
        counts = None if common is None else common.value
        bits = 0.0 if counts is None else float(np.log2(counts.sum() + 2))
        yield from given_back(line_rows(batches, lambda run: line_hashes(run, min_words, counts, share, blocks, bits),
                                        blocks, radius is None))

    @F.arrow_udf(returnType=WORDS_DDL)
    def fetched(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, wanted in batches:
            out = []
            for t, places in zip(texts.cast(pa.binary()).to_pylist(), wanted.to_pylist()):
                lines = spaced((t or b"").translate(FOLD)).split(b"\n")
                out.append([{"h1": p["h1"], "words": b" ".join(lines[p["pos"]].split())
                             .decode("utf-8", "replace")} for p in places])
            yield pa.array(out, type=WORDS)

    names, body = docs.columns, F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{key}`").alias("id"), body.alias("text")) \
        .withColumn("k", F.xxhash64("id", "text"))
    common = spark.sparkContext.broadcast(word_counts(source)) if radius is None else None
    packed = [f"b{k}" for k in range((blocks + 1) // 2)]
    shape = StructType([StructField("id", source.schema["id"].dataType), *StructType.fromDDL(", ".join(
        ["k bigint", *(f"{c} {kind}" for c, _, kind in LINE), *(f"{c} bigint" for c in packed)]
        + ["keys array<bigint>"] * (radius is None and not blocks)))])
    lines = stash(source.mapInArrow(hashed, shape))
    once = lines.where(~F.col("again"))
    # All columns of one identity are equal; a maximum needs one field of the buffer, the first one two.
    distinct = stash(once.groupBy("h1", "h2").agg(
        F.min("id").alias("stay_id"), F.min("k").alias("k0"), F.max("k").alias("k1"),
        *[F.max(c).alias(c) for c in ["n", "s1", "s2", "s3", *packed]]))

    def text_of(wanted):
        """Words of distinct lines, each fetched from one text that holds it."""
        at = once.join(wanted, "h1", "left_semi").join(
            distinct.select("h1", F.col("k0").alias("k")), ["h1", "k"], "left_semi")
        places = at.groupBy("k").agg(F.collect_set(F.struct("h1", "pos")).alias("places"))
        return source.join(light(places, broadcast_rows), "k") \
            .select(F.explode(fetched(F.col("text").cast("binary"), F.col("places"))).alias("w")) \
            .select("w.*").dropDuplicates(["h1"])
    keys = F.array(*[block_bits(k) for k in range(blocks)]) if blocks else F.array(F.lit(0))
    hashes = distinct.select("h1", "n", "s1", "s2", "s3", keys.alias("keys"))
    sketched = hashes.withColumn("sketch", sketch())
    rows = block_rows(sketched) if blocks else bucket_rows(sketched) if radius is not None else \
        once.withColumn("sketch", sketch()).select("h1", "sketch", F.explode("keys").alias("bucket")).distinct()
    links = line_links(hashes, rows, text_of, radius, share)
    group = stash(components(stash(links)).select(F.col("node").alias("h1"), "component"))
    repeated = distinct.join(group, "h1", "left").where(F.col("component").isNotNull() | (F.col("k0") != F.col("k1")))
    held = stash(once.join(repeated.select("h1", "h2", "component", "stay_id"), ["h1", "h2"])
                 .select("k", "id", "pos", "component", "stay_id"))
    alone, grouped = F.col("component").isNull(), held.where("component is not null")
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "pos")).alias("stay"))
    stays = F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("pos") == F.col("stay.pos"))
    gone = held.where(alone & ~F.col("id").eqNullSafe(F.col("stay_id"))).select("k", "pos") \
        .union(grouped.join(first, "component").where(~stays).select("k", "pos")) \
        .union(lines.where("again").select("k", "pos")) \
        .groupBy("k").agg(F.collect_set("pos").alias("__gone"))
    out = docs.withColumn("__k", F.xxhash64(F.col(f"`{key}`"), body)).join(
        light(gone.withColumnRenamed("k", "__k"), broadcast_rows), "__k", "left")
    parts = F.split(body, "\n", -1)
    cleaned = F.when(F.col("__gone").isNull(), body).otherwise(F.array_join(F.filter(
        parts, lambda x, i: ~F.array_contains("__gone", i)), "\n"))
    counts = {"n_lines": F.when(F.coalesce(body, F.lit("")) == "", F.lit(0)).otherwise(F.size(parts)),
              "n_removed": F.coalesce(F.size("__gone"), F.lit(0))}
    return out.select(
        *[cleaned.alias(c) if c == text else counts[c].cast("long").alias(c) if c in counts
          else F.col(f"`{c}`") for c in names],
        *[v.cast("long").alias(c) for c, v in counts.items() if c not in names])


def kept_documents(docs: DataFrame, left_words: int = 5) -> DataFrame:
    """``docs`` with repeated lines taken out.

    Documents that lose a line and keep none of at least ``left_words`` words go.
    """
    inner = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    done = drop_repeated_lines(inner, blocks=BLOCKS)
    lost = (F.col("n_removed") > 0) & ~F.exists(F.split("text", "\n"), lambda x: F.size(F.filter(F.split(
        F.regexp_replace(x, UNSPACED_POINTS, " $0 "), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
        lambda w: w != "")) >= left_words)
    return done.where(~F.coalesce(lost, F.lit(False))).select(
        F.col("__row").withField("text", F.col("text")).alias("__row")).select("__row.*")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, blocks=BLOCKS).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))

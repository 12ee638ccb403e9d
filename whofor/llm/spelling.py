"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's frequency vector is its length and how many of its letters fall into each of ``GROUPS``
groups. One inserted, deleted or replaced letter adds at most one to one count and takes at most
one from another, so a depth-first search through the trie of the vectors, with a surplus and a
deficit of one to spend, reaches every word one edit away; the words of the leaves it reaches are
verified. The trie is dealt out by subtrees: nodes with more than ``unit_words`` words are split by
their next count, and words visit the subtrees that their own budget reaches. Two words of different
subtrees meet in the later one alone, so each pair is met once. A subtree that the last count still
leaves too large is cut into blocks that meet in pairs. The split nodes (at most a ``TOP``-th of
the words each, ``GROUPS`` levels) are all that is broadcast.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case; a run loses one letter where
a checksum of its document says so (a stand-in for typing slips, ``slip``; none if None). Words of
at least ``least_letters`` letters that occur ``least`` times are compared. A word's form is its
most frequent neighbour (ties: the smallest in code-point order) if that occurs at least twice as
often; the root is where forms lead. Null and empty texts have no words; a null id counts as the
empty string; each of several equal rows counts; other columns are not read. An empty table gives
an empty result.
"""

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm.graph import stash
from whofor.llm.tokens import as_bytes, folding, read_table, small_batches

GROUPS, TOP, LEAF, PAIRS = 16, 20_000, 64, 1 << 20
RUNS = re.compile("[a-zÀ-ÿ]+")
LOWER = folding(b"")
#: Letters by group; the byte 0 fills words up and belongs to none.
GROUP = np.array([GROUPS] + [b % GROUPS for b in range(1, 256)])


def slipped(word: str, start: int, slip: int | None) -> str:
    """The word, without one letter if its checksum (continued from ``start``) is a multiple."""
    h = zlib.crc32(word.encode(), start) if slip else 1
    if not slip or h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5,
                slip: int | None = 97) -> DataFrame:
    """``word, n`` over all texts; counts are combined before they are exchanged."""

    def counted(batches):
        total: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                found = Counter(RUNS.findall(t.translate(LOWER).decode("utf-8", "replace")))
                for word, n in found.items():
                    word = slipped(word, start, slip)
                    if len(word) >= least_letters:
                        total[word] += n
                if len(total) > 200_000:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                           pa.array(list(total.values()), pa.int64())], ["word", "n"])
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").cast("string").alias("id"), as_bytes(f"`{text}`").alias("text")) \
        .mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: list[str]) -> np.ndarray:
    """Letters of words (Latin-1), one row each, filled up with zeros by two at least."""
    width = max(map(len, words), default=0) + 2
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words),
                         dtype=np.uint8).reshape(len(words), width)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Length, then the number of letters in each group."""
    n = len(codes)
    at = np.repeat(np.arange(n) * (GROUPS + 1), codes.shape[1]) + GROUP[codes].ravel()
    counts = np.bincount(at, minlength=n * (GROUPS + 1)).reshape(n, GROUPS + 1)[:, :GROUPS]
    return np.concatenate((counts.sum(axis=1, keepdims=True), counts), axis=1)


def one_edit(x: np.ndarray, y: np.ndarray, lx: int, ly: int) -> np.ndarray:
    """Which words of ``x`` (rows, all ``lx`` long) are one edit from which of ``y`` (columns)."""
    if lx == ly:
        return (x[:, None, :lx] != y[None, :, :lx]).sum(axis=2) == 1
    if lx < ly:
        return one_edit(y, x, ly, lx).T
    head = x[:, None, :ly + 1] != y[None, :, :ly + 1]
    tail = x[:, None, 1:ly + 2] != y[None, :, :ly + 1]
    # The first letter that differs, and the place after the last that differs one further on.
    lead = head.argmax(axis=2)
    last = np.where(tail.any(axis=2), ly + 1 - tail[:, :, ::-1].argmax(axis=2), 0)
    return lead >= last


class Trie:
    """Depth-first search of many words at once in the trie of the first ``home`` words' vectors."""

    def __init__(self, codes: np.ndarray, home: int):
        self.codes, self.home, self.vec = codes, home, vectors(codes)
        self.order = np.lexsort(self.vec[:home].T[::-1])
        self.sorted = self.vec[self.order]

    def children(self, lo: int, hi: int, depth: int):
        edge = np.flatnonzero(np.diff(self.sorted[lo:hi, depth])) + lo + 1
        return zip([lo, *edge.tolist()], [*edge.tolist(), hi])

    def pairs(self):
        """Index pairs of words one edit apart, of which one at least is at home; each once."""
        asked = np.arange(len(self.codes))
        stack = []
        for lo, hi in self.children(0, self.home, 0):
            d = self.vec[:, 0] - self.sorted[lo, 0]
            for q, more, less in ((asked[d == 0], 1, 1), (asked[d == 1], 1, 0), (asked[d == -1], 0, 1)):
                stack.append((lo, hi, 1, q, np.full(len(q), more), np.full(len(q), less)))
        while stack:
            lo, hi, depth, q, more, less = stack.pop()
            if not len(q):
                continue
            if hi - lo <= LEAF or depth > GROUPS:
                yield from self.leaf(lo, hi, q)
                continue
            for a, b in self.children(lo, hi, depth):
                d = self.vec[q, depth] - self.sorted[a, depth]
                m, f = more - np.maximum(d, 0), less + np.minimum(d, 0)
                ok = (m >= 0) & (f >= 0)
                stack.append((a, b, depth + 1, q[ok], m[ok], f[ok]))

    def leaf(self, lo: int, hi: int, q: np.ndarray):
        size, length = int(self.vec[q[0], 0]), int(self.sorted[lo, 0])
        step = max(1, PAIRS // size // LEAF)
        for at in range(lo, hi, LEAF):
            w = self.order[at:min(at + LEAF, hi)]
            for k in range(0, len(q), step):
                part = q[k:k + step]
                i, j = np.nonzero(one_edit(self.codes[part], self.codes[w], size, length))
                a, b = part[i], w[j]
                once = (a >= self.home) | (a < b)
                yield a[once], b[once]


def near_words(words: list[str], n: np.ndarray, home: int):
    """``index, n_near, form_n, form`` (an index) of the words that have neighbours."""
    found = list(Trie(letters(words), home).pairs()) if home else []
    a = np.concatenate([p[0] for p in found]) if found else np.zeros(0, dtype=np.int64)
    b = np.concatenate([p[1] for p in found]) if found else a
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[target], -n[target], source))
    source, target = source[order], target[order]
    first = np.flatnonzero(np.diff(source, prepend=-1))
    return source[first], np.diff(np.append(first, len(source))), n[target[first]], target[first]


class Top:
    """The split nodes of the trie: which subtrees a word belongs to and visits."""

    def __init__(self, nodes: dict[tuple, dict[int, int]], limit: int):
        self.nodes, self.limit = nodes, limit
        self.reach = lru_cache(maxsize=200_000)(self._reach)
        self.depth = max(map(len, nodes), default=0) + 1

    def _reach(self, vec: tuple) -> tuple[str, int, list]:
        """The word's own subtree, its blocks, and the later ones that its budget reaches."""
        found, own = [], None
        stack = [((), 0, 0)]
        while stack:
            prefix, more, less = stack.pop()
            depth = len(prefix)
            for d in (0, 1, -1):
                # Of the length, one letter more leaves no deficit to spend, one less no surplus.
                m, f = (int(d < 0), int(d > 0)) if depth == 0 else (more + max(d, 0), less + max(-d, 0))
                count = vec[depth] - d
                held = self.nodes[prefix].get(count)
                if held is None or m > 1 or f > 1:
                    continue
                child = prefix + (count,)
                if child in self.nodes:
                    stack.append((child, m, f))
                    continue
                unit = (",".join(map(str, child)), -(-held // self.limit) if depth == GROUPS else 1)
                if child == vec[:len(child)]:
                    own = unit
                else:
                    found.append(unit)
        return own, [u for u in found if u[0] > own[0]]

    def route(self, word: str, vec: tuple) -> list[tuple[str, bool]]:
        (own, blocks), others = self.reach(vec[:self.depth])
        mine = zlib.crc32(word.encode()) % blocks
        return [(f"{own}/{mine}", True), *((f"{own}/{k}", False) for k in range(mine + 1, blocks)),
                *((f"{unit}/{k}", False) for unit, n in others for k in range(n))]


def top_nodes(words: DataFrame, limit: int) -> dict[tuple, dict[int, int]]:
    """Children of every node that is split, with their numbers of words; level by level.

    A level holds at most words / ``limit`` such nodes, with a few children each.
    """
    spark = words.sparkSession
    nodes, level = {}, words.withColumn("node", F.lit(""))
    split = [""]
    for depth in range(GROUPS + 1):
        kept = spark.createDataFrame([(p,) for p in split], "node string")
        level = level.join(F.broadcast(kept), "node", "left_semi") \
            .withColumn("node", F.concat_ws(",", F.slice("vec", 1, depth + 1).cast("array<string>")))
        split = []
        for row in level.groupBy("node").agg(F.count(F.lit(1)).alias("c")).collect():
            path = tuple(map(int, row["node"].split(",")))
            nodes.setdefault(path[:-1], {})[path[-1]] = row["c"]
            if row["c"] > limit:
                split.append(row["node"])
        if not split:
            break
    return nodes


def neighbours(words: DataFrame, unit_words: int = 8192) -> DataFrame:
    """``word, n_near, form, form_n`` of every word with words one edit away (``word, n`` distinct)."""
    spark = words.sparkSession

    @F.arrow_udf(returnType="array<int>")
    def vector(batch: pa.Array) -> pa.Array:
        return pa.array(vectors(letters(batch.to_pylist())).tolist(), pa.list_(pa.int32()))
    words = stash(words.withColumn("vec", vector("word")))
    limit = max(unit_words, words.count() // TOP)
    nodes = top_nodes(words, limit)
    if not nodes:
        return spark.createDataFrame([], "word string, n_near long, form string, form_n long")
    shared = spark.sparkContext.broadcast((nodes, limit))

    def routed(batches):
        top = Top(*shared.value)
        for batch in batches:
            vecs = batch.column("vec").flatten().to_numpy().reshape(-1, GROUPS + 1).tolist()
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                routes = [top.route(w, tuple(v)) for w, v in zip(part.column("word").to_pylist(),
                                                                 vecs[lo:lo + 4096])]
                at = np.repeat(np.arange(len(routes)), [len(r) for r in routes])
                flat = [x for r in routes for x in r]
                yield pa.RecordBatch.from_arrays(
                    [part.column("word").take(pa.array(at)), part.column("n").take(pa.array(at)),
                     pa.array([u for u, _ in flat]), pa.array([not h for _, h in flat])],
                    ["word", "n", "unit", "visits"])

    def searched(batches):
        held: list = []
        for batch in batches:
            units = batch.column("unit")
            turns = pc.not_equal(units[1:], units[:-1]).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(turns) + 1).tolist()]
            if held and held[-1].column("unit")[0].as_py() != units[0].as_py():
                yield from results(held)
                held = []
            for lo, hi in zip(ends, ends[1:]):
                yield from results([*held, batch.slice(lo, hi - lo)])
                held = []
            held.append(batch.slice(ends[-1]))
        if held:
            yield from results(held)

    def results(parts):
        table = pa.Table.from_batches(parts)
        words = table.column("word").to_pylist()
        home = len(words) - int(np.count_nonzero(table.column("visits").to_numpy()))
        at, count, form_n, form = near_words(words, table.column("n").to_numpy(), home)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in at.tolist()]), pa.array(count), pa.array(form_n),
                 pa.array([words[i] for i in form.tolist()])], ["word", "n_near", "form_n", "form"])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = words.mapInArrow(routed, "word string, n bigint, unit string, visits boolean") \
        .repartition(n, "unit").sortWithinPartitions("unit", "visits") \
        .mapInArrow(searched, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for links ``word, form``: each round doubles how far forms are followed.

    A form occurs at least twice as often as its word, so there are no circles, and rounds are
    about the logarithm of the logarithm of the largest count. Words that arrived only lead others.
    """
    now = stash(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("arrived")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"),
                           F.col("arrived").alias("there"))
        moved = now.where(~F.col("arrived")).join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.coalesce("there", F.lit(True)).alias("arrived"))
        now = stash(now.where("arrived").union(moved))
        if now.where(~F.col("arrived")).isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5,
                      least: int = 3, slip: int | None = None, unit_words: int = 8192) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of all texts."""
    words = stash(count_words(docs, key, text, least_letters, slip).where(F.col("n") >= least))
    near = stash(words.join(neighbours(words, unit_words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("form_n") >= 2 * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")]))
    ends = roots(near.where(F.col("form").isNotNull()))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(docs, slip=97)

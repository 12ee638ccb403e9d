"""Line dedup against all pairs of lines compared by brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from whofor.llm import lines as ld
from whofor.llm.queries import QUERIES


def norm(line):
    low = "".join(c.lower() if c.isascii() else c for c in line)
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, radius=30, share=0.8, min_words=5):
    """Links of lines that share a block, are within the radius and pass the edit similarity."""
    first, sims = {}, {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        for (pos, line), in zip(enumerate((text or "").split("\n"))):
            n = norm(line)
            if len(n.split()) >= min_words:
                first.setdefault(n, (key, pos))
    names = list(first)
    for n in names:
        got = ld.line_hashes([n.encode()], min_words)
        sims[n] = "".join(format(int(got[s][0]) & (2 ** 64 - 1), "064b") for s in ("s1", "s2", "s3"))
    up = {n: n for n in names}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            x, y = sims[a], sims[b]
            meet = any(x[k:k + 32] == y[k:k + 32] for k in (0, 32, 64, 96, 160))
            if meet and sum(p != q for p, q in zip(x, y)) <= radius:
                wa, wb = a.split(), b.split()
                if distance(wa, wb) <= max(len(wa), len(wb)) * (1 - share) + 1e-9:
                    up[root(a)] = root(b)
    stay = {}
    for n in names:
        stay[root(n)] = min(stay.get(root(n), first[n]), first[n])
    out = []
    for key, text in rows:
        kept, gone = [], 0
        for pos, line in enumerate(text.split("\n") if text else []):
            n = norm(line)
            drop = n in first and stay[root(n)] != (key, pos)
            gone += drop
            if not drop:
                kept.append(line)
        out.append((key, None if text is None else "\n".join(kept) if gone else text, gone))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "Straße"]
    pool = [r.choices(vocab, k=r.randint(3, 80)) for _ in range(25)]
    rows = [(90, None), (91, ""), (92, "\n\n"), (93, "a b c d\na b c d"), (94, "A, b! c d. e\nx\na b c d e")]
    for k in range(40):
        lines = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(pool)) if r.random() < 0.7 else r.choices(vocab, k=r.randint(1, 40))
            if r.random() < 0.5 and len(w) > 20:
                w[r.randrange(len(w))] = r.choice(vocab)
            lines.append(" ".join(w).upper() if r.random() < 0.2 else ",  ".join(w))
        rows.append((k, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    got = ld.drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()) == brute(rows)


def all_similar(rows, share=0.8, min_words=5):
    """What ``brute`` gives, by edit similarity alone, and the similar pairs."""
    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            if len(norm(line).split()) >= min_words:
                first.setdefault(norm(line), (key, pos))
    names, pairs = list(first), []
    group = {n: {n} for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            wa, wb = a.split(), b.split()
            if distance(wa, wb) <= max(len(wa), len(wb)) * (1 - share) + 1e-9:
                pairs.append((a, b))
                if group[a] is not group[b]:
                    group[a] |= group[b]
                    for n in group[b]:
                        group[n] = group[a]
    stay = {n: min(first[m] for m in group[n]) for n in names}
    out = []
    for key, text in rows:
        lines = text.split("\n") if text else []
        kept = [x for pos, x in enumerate(lines) if norm(x) not in first or stay[norm(x)] == (key, pos)]
        out.append((key, None if text is None else "\n".join(kept), len(lines) - len(kept)))
    return sorted(out), pairs


def edited_corpus(seed):
    """Lines beside copies with up to a fifth of their words changed, dropped or inserted."""
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(4000)]
    rows = corpus(seed)
    for k in range(150):
        n = r.choice([5, 6, 9, 10, 19, 20, 24, 25, 50, 100])
        line = r.choices(vocab, k=n)
        other = list(line)
        for at in r.sample(range(n), r.randint(1, n // 5)):
            other[at] = r.choice([r.choice(vocab), "", f"{other[at]} {r.choice(vocab)}"])
        rows += [(200 + 2 * k, " ".join(line)), (201 + 2 * k, " ".join(" ".join(other).split()))]
    return rows


@pytest.mark.parametrize("seed,block", [(3, 1024), (4, 3)])
def test_every_similar_line_is_met(spark, seed, block, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", block)
    rows = edited_corpus(seed)
    want, _ = all_similar(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ld.drop_repeated_lines(df, radius=None)
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()) == want


def test_recall_of_word_pairs_is_whole():
    rows = edited_corpus(5)
    _, pairs = all_similar(rows)
    names = sorted({n for p in pairs for n in p})
    counts = np.random.default_rng(1).integers(0, 9, ld.SLOTS)
    got = ld.line_hashes(["\n".join(names).encode()], 5, counts)
    at = np.cumsum([0, *got["n_keys"]])
    keys = {n: set(got["keys"][i:j].tolist()) for n, i, j in zip(names, at, at[1:])}
    assert len(pairs) > 100 and all(keys[a] & keys[b] for a, b in pairs)


def planted_pairs(n, edits, trials, r, vocab, weights):
    """Lines of ``n`` words beside copies with ``edits`` words changed to others of the corpus."""
    out = []
    for _ in range(trials):
        line = r.choices(vocab, weights, k=n)
        other = list(line)
        for at in r.sample(range(n), edits):
            other[at] = r.choices(vocab, weights)[0]
        out.append((" ".join(line), " ".join(other)))
    return out


@pytest.mark.parametrize("n,edits,least", [(10, 1, .98), (20, 1, .98), (50, 5, .98), (5, 1, .9), (10, 2, .9), (15, 3, .9),
                                           (25, 5, .9), (50, 10, .9), (100, 20, .9)])
def test_recall_of_drawn_blocks(n, edits, least):
    """Share of similar pairs with a block in common, on words as uneven as those of a language."""
    r = random.Random(n)
    vocab = [f"word{i}" for i in range(30_000)]
    weights = [1 / (i + 2) for i in range(30_000)]
    pairs = planted_pairs(n, edits, 300, r, vocab, weights)
    counts = np.zeros(ld.SLOTS)
    words, _ = ld.hashed_words([" ".join(r.choices(vocab, weights, k=400_000)).encode()], ld.WORDS_ONLY)
    np.add.at(counts, (words & np.uint64(ld.SLOTS - 1)).astype(np.int64), 1)
    a, b = [ld.line_hashes(["\n".join(p[k] for p in pairs).encode()], 5, counts, blocks=ld.BLOCKS, bits=28.0)
            ["keys"].reshape(-1, ld.BLOCKS) for k in (0, 1)]
    assert (a == b).any(axis=1).mean() >= least


def test_lines_met_in_blocks_equal_brute_force(spark):
    """A link that is missed can only leave a line in; with edits of one word in ten none is missed."""
    r = random.Random(8)
    vocab = [f"word{i}" for i in range(4000)]
    rows = corpus(6)[:5]
    for k in range(120):
        line = r.choices(vocab, k=r.choice([10, 12, 24, 60]))
        other = list(line)
        other[r.randrange(len(line))] = r.choice(["", r.choice(vocab), "new word"])
        rows += [(200 + 2 * k, " ".join(line)), (201 + 2 * k, "x\n" + " ".join(" ".join(other).split()))]
    rows += [(900 + k, " ".join(["one", "line", "that", "stands", f"here{k % 3}", *map(str, range(40))])) for k in range(60)]
    rows += [(990, "very long " * 40_000 + "\n" + " ".join(r.choices(vocab, k=30_000))), (991, "very long " * 40_000)]
    want, _ = all_similar([x for x in rows if x[0] < 990])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("x")).repartition(5)
    got = sorted((x["doc_id"], x["text"], x["n_removed"]) for x in ld.drop_repeated_lines(df, blocks=ld.BLOCKS).collect())
    assert [g for g in got if g[0] < 990] == want
    assert [(g[0], g[2]) for g in got if g[0] >= 990] == [(990, 0), (991, 1)]


def test_blocks_are_majority_votes_of_rare_words():
    for n in range(1, 8):
        hashes = [np.array([v], dtype=np.uint64) for v in (12, 10, 9, 7, 15, 3, 8)[:n]]
        planes = [np.zeros(1, dtype=np.uint64) for _ in range(3)]
        for h in hashes:
            carry = planes[0] & h
            planes[0] ^= h
            more = planes[1] & carry
            planes[1] ^= carry
            planes[2] ^= more
        want = sum(1 << b for b in range(4) if 2 * sum(int(h[0]) >> b & 1 for h in hashes) > n)
        assert int(ld.majority(planes, np.array([n]))[0]) == want


def test_registered_query_keeps_its_columns(spark, tmp_path):
    line = "this very line stands in several of the documents"
    rows = [(1, f"{line}\nonly here"), (2, f"x\n{line.upper()}!"), (3, None), (4, ""), (4, ""), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x["doc_id"], x["n_lines"], x["n_removed"], x["text_sha256"]) for x in QUERIES["op4_lines"](
        spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(1, 2, 0, sha(rows[0][1])), (2, 2, 1, sha("x")), (3, 0, 0, sha("")), (4, 0, 0, sha("")),
                   (None, 1, 1, sha(""))}


def test_pipeline_form_empty_tables_and_repeated_rows(spark):
    line = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"one two three four five\n{line}", "a"), (2, line, "b"), (3, f"short\n{line.upper()}", "c"),
            (4, f"short\nnone of the others has this\n{line}", "d"), (5, None, "e"), (6, "tiny", "f"),
            (6, "tiny", "f"), (None, "no id here but five words", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = ld.kept_documents(df)
    assert got.columns == df.columns
    texts = sorted((str(r["doc_id"]), r["text"]) for r in got.collect())
    assert texts == sorted([("1", rows[0][1]), ("4", "short\nnone of the others has this"), ("5", None),
                            ("6", "tiny"), ("6", "tiny"), ("None", "no id here but five words")], key=str)
    assert ld.kept_documents(df.limit(0)).count() == 0


def test_documents_with_any_word_left_stay_and_unspaced_scripts_take_part(spark):
    line = "this line stands in several of the documents"
    han = "我们今天在北京的图书馆里读了很多有意思的书"
    rows = [(1, line), (2, f"Hello there\n{line}"), (3, f"--\n{line}\n "), (4, f"第二行\n{han}"),
            (5, f"另外\n{han}"), (6, han.replace("北", "南")), (7, "ภาษาไทยไม่มีช่องว่าง"), (8, "ภาษาไทยไม่มีช่องว่าง")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.kept_documents(docs, left_words=1).collect()}
    assert got == {1: line, 2: "Hello there", 4: rows[3][1], 5: "另外", 7: rows[6][1]}


def test_simhash_distance_follows_edits():
    r = np.random.default_rng(5)
    words = [f"t{i}" for i in r.integers(0, 5000, 80)]
    first = " ".join(words)
    words[40] = "other"
    got = ld.line_hashes([first.encode(), None, (first + "\nx\n" + " ".join(words) + "\n" + first).encode()], 5)
    assert got["text"].tolist() == [0, 2, 2, 2] and got["pos"].tolist() == [0, 0, 2, 3]
    assert got["again"].tolist() == [False, False, False, True]
    bits = sum(bin(int(got[s][0] ^ got[s][2]) & (2 ** 64 - 1)).count("1") for s in ("s1", "s2", "s3"))
    assert 0 < bits < 30 and got["h1"][0] == got["h1"][3] != got["h1"][2]


@pytest.mark.parametrize("block", [1024, 7])
def test_links_stay_fewer_than_lines_in_a_large_group(spark, block, monkeypatch):
    """Fifteen groups of forty near copies: what is handed on follows the lines, not their pairs."""
    monkeypatch.setattr(ld, "BLOCK", block)
    made, by_unit = [], ld.by_unit

    def counted(rows, work, schema, *rest):
        out = by_unit(rows, work, schema, *rest)
        made.append(out)
        return out
    monkeypatch.setattr(ld, "by_unit", counted)
    r = random.Random(11)
    rows = []
    for g in range(15):
        line = [f"word{g}x{i}" for i in range(30)]
        for k in range(40):
            other = list(line)
            for at in r.sample(range(30), 5):
                other[at] = f"new{r.randrange(10 ** 9)}"
            rows.append((40 * g + k, " ".join(other)))
    want, pairs = all_similar(rows)
    got = ld.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), blocks=ld.BLOCKS)
    assert sorted((x["doc_id"], x["text"], x["n_removed"]) for x in got.collect()) == want
    met, links = made[0].count(), made[1].select(F.sort_array(F.array("a", "b")).alias("p"))
    assert links.count() < met <= 10 * len(rows) * -(-600 // block)
    if block == 1024:
        # Units here are buckets: each returns a forest of its own lines.
        assert links.count() <= 10 * (len(rows) - 15) and met <= 10 * len(rows)


def test_similar_equals_edit_distance():
    r = random.Random(3)
    for _ in range(600):
        a = [r.choice("abcdefgh") for _ in range(r.randint(1, 14))]
        b = list(a) if r.random() < .8 else [r.choice("abcdefgh") for _ in range(r.randint(1, 14))]
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b))] = r.choice(["a", "i", "b c"])
        b = " ".join(b).split()
        assert ld.edit_distance(a, b) == distance(a, b)
        assert ld.similar(" ".join(a), " ".join(b), .8) == (distance(a, b) <= max(len(a), len(b)) * .2 + 1e-9)


def test_words_of_all_texts_are_counted(spark):
    """Also beyond 20,000 texts: no draw, so the weights follow from the whole input."""
    d = spark.range(0, 24_000, numPartitions=3).select(
        F.when(F.col("id") % 7 != 0, F.concat_ws(" ", F.lit("alpha"), F.concat(F.lit("w"), F.col("id") % 50))).alias("text"),
        F.xxhash64("id").alias("k"))
    texts = [r["text"] for r in d.collect()]
    want = np.zeros(ld.SLOTS)
    words, _ = ld.hashed_words([(t or "").encode() for t in texts], ld.WORDS_ONLY)
    np.add.at(want, (words & np.uint64(ld.SLOTS - 1)).astype(np.int64), 1)
    np.testing.assert_array_equal(ld.word_counts(d), want)
    assert want.sum() == 2 * sum(t is not None for t in texts)


@pytest.mark.parametrize("codes", [1 << 18, 10])
def test_links_that_differ_in_one_place_need_no_edit_distance(codes, monkeypatch):
    """Most pairs are settled for a whole batch at once; what is settled so is never beyond the share."""
    calls, plain = [], ld.edit_distance
    monkeypatch.setattr(ld, "CODES", codes)
    monkeypatch.setattr(ld, "edit_distance", lambda a, b: calls.append(1) or plain(a, b))
    r = random.Random(17)
    lines, cut = [], []
    for _ in range(80):
        n, at = r.randint(10, 60), r.randint(1, 8)
        line = [f"w{i}" for i in r.choices(range(400), k=n)]
        cut.append((line, line[:at] + line[at + n // 10:]))
        other = [r.choice([w, w, w, w, "x", f"{w} y", ""]) for w in line]
        lines += [line, line[:at] + line[at + n // 10:], " ".join(other).split() or ["x"]]
    x = np.arange(0, len(lines), 3)
    words = pa.array([" ".join(w) for w in lines])
    assert ld.spanning([(x, x + 1)], words, .8) == [(i, i + 1) for i in x.tolist()] and not calls
    near = [(i, i + 2) for i in x.tolist() if distance(lines[i], lines[i + 2]) <= max(len(lines[i]), len(lines[i + 2])) * .2 + 1e-9]
    assert ld.spanning([(x + 2, x)], words, .8) and sorted((b, a) for a, b in ld.spanning([(x + 2, x)], words, .8)) == near


def test_drawn_blocks_equal_a_plain_loop(monkeypatch):
    """Lines of very different lengths, with words that stand often in one, side by side in small arrays."""
    monkeypatch.setattr(ld, "CELLS", 200)
    r = np.random.default_rng(23)
    sizes = np.array([5, 6, 7, 300, 5, 40, 41, 64, 9, 5, 20, 1])
    words = r.integers(0, 2 ** 63, 30, dtype=np.uint64)[r.integers(0, 30, sizes.sum())]
    words[11:311][::2] = words[11]
    rarity = (words % np.uint64(13)).astype(float) + 1
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    want = np.zeros((len(sizes), 5), dtype=np.uint32)
    for i, (lo, n) in enumerate(zip(first, sizes)):
        for b in range(5):
            draw = ld.mix(words[lo:lo + n] ^ np.uint64((b // 2 * 2 + 1) * 0x9E3779B97F4A7C15 & 2 ** 64 - 1))
            bit = (draw >> np.uint64(40 - b % 2 * 32)) & np.uint64(0xFFFFFF)
            order = np.log((bit.astype(np.float32) + np.float32(.5)) / np.float32(1 << 24)) * -(1 / rarity[lo:lo + n]).astype(np.float32)
            taken, have = [], 0.0
            for k in np.argsort(order, kind="stable"):
                if taken and (have >= 20 or len(taken) >= min(max((n + 1) // 3, 2), 7)):
                    break
                if not taken or order[k] != order[taken[-1]]:
                    taken.append(k)
                    have += rarity[lo + k]
            vote = sum(1 << j for j in range(64) if 2 * sum(int(draw[k]) >> j & 1 for k in taken) > len(taken))
            want[i, b] = ld.mix(np.array([vote ^ (b + 1)], dtype=np.uint64))[0] >> np.uint64(32)
    np.testing.assert_array_equal(ld.drawn_blocks(words, first, rarity, 20.0, 5), want)

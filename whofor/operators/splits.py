"""Leak-free splits: rows that share a speaker, session or room stay together.

Components are found on the graph of key values, not of rows: rows only say
which values occur together, and equal pairs collapse before the first
shuffle, so the iteration works on a graph far smaller than the table and one
speaker holding a third of the rows is still one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor.functions.scalars import count_if
from whofor.session import cut_lineage
from whofor import fixed as V

MAX_ROUNDS = 40


def key_nodes(keys: list[str]) -> Column:
    """array<string> of 'key=value' a row belongs to; a speaker "a+b" is both a and b."""
    def nodes(k):
        c = F.coalesce(F.col(k).cast("string"), F.lit(""))
        values = F.split(c, r"\+") if k == "speaker" else F.array(c)
        return F.transform(F.filter(values, lambda v: v != ""),
                           lambda v: F.concat(F.lit(k + "="), v))
    return F.array_distinct(F.concat(*[nodes(k) for k in keys]))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for an edge table ``(a, b)``: component = its smallest node.

    Alternating large-star and small-star steps, which halve the height of
    every tree, so a chain of n linked speakers needs about log2(n) rounds.
    Each step only aggregates a minimum per node (combined map-side) and joins
    it back; the lineage is cut every round and the edge set only shrinks.
    """
    def distinct(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                         F.least("a", "b").alias("b")).distinct()

    def star(df, large):
        # neighbours of u, both ways for a large star, smaller ones only for a small star
        both = df.union(df.select("b", "a")) if large else df
        low = both.groupBy("a").agg(F.min("b").alias("m")) \
            .select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if large:
            moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"),
                                                                 F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")) \
                .union(low.select("a", F.col("m").alias("b")))
        return distinct(moved)

    def fingerprint(df):
        r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]
    nodes = cut_lineage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    e = cut_lineage(distinct(edges))
    seen = fingerprint(e)
    for _ in range(MAX_ROUNDS):
        e = cut_lineage(star(star(e, True), False))
        now = fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise MAX_ROUNDS")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node",
                      "left").select("node", F.coalesce("root", "node").alias("component"))


def row_components(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """``df`` with ``component``; a row with no key value is a component of its own."""
    d = df.withColumn("__nodes", key_nodes(keys))
    # A row's values form a chain, which links them all with n - 1 edges.
    pairs = d.where(F.size("__nodes") > 0).select("__nodes").distinct()
    first = pairs.select(F.explode(F.transform(
        "__nodes", lambda v, i: F.struct(v.alias("a"), F.coalesce(
            F.get("__nodes", i + 1), v).alias("b")))).alias("e")).select("e.*").distinct()
    labels = connected_components(first)
    d = d.withColumn("node", F.coalesce(F.get("__nodes", F.lit(0)),
                                        F.concat(F.lit("row="), F.col(row_id).cast("string"))))
    return d.join(labels, "node", "left") \
        .withColumn("component", F.coalesce("component", "node")).drop("node", "__nodes")


def deal(sizes: list[tuple[int, int]], total: int, fractions) -> dict[int, list[int]]:
    """How many components of each size go to each split, largest sizes first.

    Equal sizes are interchangeable, so a class is dealt as counts: the next
    one always goes to the split with the largest (target - filled) / target.
    """
    targets = [max(f * total, 1e-9) for f in fractions]
    filled = [0.0] * len(targets)
    out = {}
    for size, count in sorted(sizes, reverse=True):
        # Skip ahead: everything above a level of need is certain to be dealt.
        lo, hi = -1.0 - size * count / min(targets), 1.0

        def upto(level):
            return [max(0, int((t - f - level * t) // size)) for t, f in zip(targets, filled)]
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(upto(mid)) > count else (lo, mid)
        take = upto(hi)
        left = count - sum(take)
        filled = [f + k * size for f, k in zip(filled, take)]
        for _ in range(left):
            k = max(range(len(targets)), key=lambda s: (targets[s] - filled[s]) / targets[s])
            take[k] += 1
            filled[k] += size
        out[size] = take
    return out


def group_split(df: DataFrame, keys=("speaker", "session", "room"), fractions=(0.6, 0.2, 0.2),
                seed: int = 0, row_id: str = "row_id", lanes: int = 256) -> DataFrame:
    """``df`` with ``component`` and ``split`` (0, 1, ...); no key value spans two splits.

    Only the histogram of component sizes reaches the driver: its distinct
    sizes number at most about sqrt(2 * rows). Components of one size are told
    apart by a seeded hash, ranked in lanes so no class is ordered in one task.
    """
    d = cut_lineage(row_components(df, list(keys), row_id))
    comps = d.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    comps = comps.withColumn("h", F.xxhash64(F.lit(seed), "component")) \
        .withColumn("lane", F.shiftright("h", 64 - 8).cast("long") + lanes // 2)
    hist = comps.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sum(r["size"] * r["n"] for r in hist)
    plan = deal([(r["size"], r["n"]) for r in hist], rows, fractions)
    from whofor.operators.ordering import number_rows
    ranked = number_rows(comps, ["size"], ["h", "component"], F.col("lane"), "rank")
    cuts = []
    for size, take in plan.items():
        edges, acc = [], 0
        for k in take[:-1]:
            acc += k
            edges.append(acc)
        cuts.append((int(size), edges))
    table = df.sparkSession.createDataFrame(cuts, "size long, edges array<long>")
    dealt = ranked.join(table, "size").withColumn(
        "split", F.size(F.filter("edges", lambda e: e <= F.col("rank"))).cast("int"))
    return d.join(dealt.select("component", "split"), "component")


def check_disjoint(df: DataFrame, keys=("speaker", "session", "room"),
                   split: str = "split") -> DataFrame:
    """Key values found in more than one split (there should be none)."""
    pairs = df.select(F.explode(key_nodes(list(keys))).alias("key_value"), split) \
        .groupBy("key_value").agg(F.min(split).alias("a"), F.max(split).alias("b"),
                                  F.count_distinct(split).alias("splits"))
    return pairs.where(F.col("a") != F.col("b")).select("key_value", "splits")


def split_counts(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("rows"))


def split_problem(df: DataFrame, n_splits: int = 3, label: str = "label",
                  positive: str = V.ASSISTANT, split: str = "split") -> DataFrame:
    """One row per split that is empty or has no positive row."""
    got = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"),
                                count_if(F.col(label) == positive).alias("positives"))
    every = df.sparkSession.range(n_splits).select(F.col("id").cast("int").alias(split))
    return every.join(got, split, "left").where(
        F.coalesce("positives", F.lit(0)) == 0).select(
        split, F.when(F.col("rows").isNull(), "the split is empty")
        .otherwise("the split has no assistant-directed rows").alias("problem"))

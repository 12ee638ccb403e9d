"""Connected components of links between ids, and tables kept in the shared folder."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whofor.session import cut_lineage, ensure_checkpoint_dir

MAX_ROUNDS = 60


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet under the checkpoint folder, and read from there.

    Computes an expensive pass exactly once; a lost executor only reads the files again. Files
    go with the folder, whose lifetime the cluster decides.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def light(df: DataFrame, limit: int) -> DataFrame:
    """A table for a join with texts: broadcast if it has at most ``limit`` rows."""
    df = stash(df)
    return F.broadcast(df) if df.count() <= limit else df


def _down(edges: DataFrame) -> DataFrame:
    """Edges as distinct pairs from the larger id to the smaller one."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                        F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the smallest id around the node."""
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return _down(up.join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved.union(low.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b``; the component is its smallest id.

    Alternates large-star and small-star until no edge changes. Minima are combined before the
    shuffle and then joined back, so a node with very many links is never one group in memory.
    Ids without links are not listed; null ids link with nothing.
    """
    now = cut_lineage(_down(edges.where("a is not null and b is not null")))

    def mark(e):
        r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]
    seen = mark(now)
    for _ in range(MAX_ROUNDS):
        now = cut_lineage(_small_star(_large_star(now)))
        found = mark(now)
        if found == seen:
            # A settled edge set is a set of stars: every node points at its component.
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct())
        seen = found
    raise RuntimeError("components did not settle; raise MAX_ROUNDS")

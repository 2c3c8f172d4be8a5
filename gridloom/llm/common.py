"""Shared helpers: a scratch area that every executor sees, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.shared import new_folder, stage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_of_id(column: str):
    """crc32 of the id's decimal text, the basis of the held-out folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def _moves(left: DataFrame, turn: int) -> DataFrame:
    """(node, to): the node of first rank among each node and its neighbours.

    Even turns rank by degree, most first, and then by a hash, odd ones by the hash alone, which is a
    new one each turn. `left` holds every edge once either way round.
    """
    by_degree = turn % 2 == 0
    mark = lambda degree, c: F.struct((-degree).alias("degree"), F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))
    known = left.withColumn("degree", F.lit(0).cast("long"))
    if by_degree:
        degrees = stage(left.groupBy("src").agg(F.count("*").alias("degree")), "degrees")
        known = left.join(degrees.withColumnRenamed("src", "dst"), "dst")
    least = known.groupBy("src").agg(F.min(mark(F.col("degree"), "dst")).alias("near"), F.count("*").alias("own"))
    own = F.col("own") if by_degree else F.lit(0).cast("long")
    return least.select(F.col("src").alias("node"), F.least("near", mark(own, "src"))["to"].alias("to"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) long edges -> (node, component): component is the smallest node reachable.

    Contraction: each round every node moves to the node of first rank among itself and its
    neighbours, and edges are drawn between the nodes that are left. Every other round ranks by
    degree, so that a star goes at once; the rounds between rank by a new hash. The node of last rank
    in a component always goes, so rounds end by themselves, and in a round by hash a fixed share goes
    on average whatever the shape and the ids, so they are about the logarithm of the largest
    component and their tables shrink. Moves are then followed back from the last round.
    A node of high degree is one row with partial minima; edges and members then meet such rows in
    joins of written tables, where adaptive execution may split the rows of a hub or a giant component.
    Self edges are allowed and keep a lone node; null ends are dropped.
    """
    clean = edges.where("src is not null and dst is not null").select("src", "dst")
    both = stage(clean.union(clean.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    nodes = both.select(F.col("src").alias("node")).distinct()
    left, moves = both.where("src <> dst"), []
    while not left.isEmpty():
        moved = stage(_moves(left, len(moves)), "moves")
        moves.append(moved)
        ends = lambda name: moved.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: B023, E731
        drawn = left.join(ends("src"), "src").join(ends("dst"), "dst").where("src_to <> dst_to")
        left = stage(drawn.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct(), "edges")
    if not moves:
        return nodes.select("node", F.col("node").alias("component"))
    roots = moves.pop()
    while moves:
        further = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = stage(moves.pop().join(further, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "roots")
    rooted = stage(nodes.join(roots, "node", "left").select("node", F.coalesce("to", "node").alias("root")), "roots")
    smallest = stage(rooted.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    return stage(rooted.join(smallest, "root").select("node", "component"), "labels")


def joined_components(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of connected_components() after further (src, dst) edges: only components that these touch are searched again."""
    ends = lambda name: parts.select(F.col("node").alias(name), F.col("component").alias(f"{name}_part"))
    placed = edges.join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    between = placed.select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst"))
    merged = connected_components(between)
    known = parts.join(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    fresh = merged.join(parts.select("node"), "node", "left_anti").select("node", "component")
    return known.select("node", F.coalesce("whole", "component").alias("component")).unionByName(fresh)

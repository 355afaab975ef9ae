"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


#: Links that one task joins by itself: so few bytes that no task's memory is at stake.
ONE_TASK = 500_000


def _forest(batches):
    """(node, least node that it reaches) of the links in these batches, by union and find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a < b:
                parent[b] = a
            else:
                parent[a] = b
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([find(x) for x in parent], pa.int64())], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): every node of links (a, b), and the smallest node that it reaches.

    At most ONE_TASK links, counted first, are joined by one task. Beyond that, each round joins every link with one minimum per node, so no task gathers a node's links; a hot node's links
    are split by the skew join. Rounds go on until the links no longer change, a logarithmic number of them.
    """
    pairs = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    pairs = stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = pairs.count()
    if n <= ONE_TASK:
        return stage(pairs.coalesce(1).mapInArrow(_forest, "id long, component long"), "components")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        floor = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        near = large.join(floor, F.col("a") == F.col("u"))
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(floor.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        after = stage(small, "links")
        stars = after.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
        tops = after.join(after.select(F.col("b").alias("t")).distinct(), F.col("a") == F.col("t"), "left_semi").limit(1).count()
        pairs = after
        if stars["n"] == stars["nodes"] and not tops:
            break
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

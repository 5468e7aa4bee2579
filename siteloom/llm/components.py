"""Connected components of a table of links.

Links that are counted few meet in one task, as a union of sets. Beyond that bound roots are hooked and pointers jumped:
each round is joins and map-side combined minima over the links and labels, written to the shared folder; the rounds
grow with the logarithm of the longest path. Nothing but a count reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release

#: Links that one task may hold, some 200 bytes each.
FEW_LINKS = 500_000


def _union(batches):
    up: dict = {}

    def root(v):
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    vertices = list(up)
    yield pa.record_batch([pa.array(vertices, pa.int64()), pa.array([root(v) for v in vertices], pa.int64())], names=["v", "c"])


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """v, c: every vertex of kept links (a, b) with the smallest vertex that it is connected with; a kept table."""
    few = FEW_LINKS if few is None else few
    if links.limit(few + 1).count() <= few:
        return keep(links.select("a", "b").coalesce(1).mapInArrow(_union, "v long, c long"), "labels")
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = keep(both.distinct(), "edges")
    labels = keep(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("c")), "labels")
    while True:
        near = edges.join(labels, "v").groupBy("u").agg(F.min("c").alias("m"))
        root = labels.join(near.withColumnRenamed("u", "v"), "v").groupBy("c").agg(F.min("m").alias("m"))
        root = keep(root.select(F.col("c").alias("r"), F.least("c", "m").alias("to")), "roots")
        if root.where(F.col("to") < F.col("r")).isEmpty():
            release(edges, root)
            return labels
        jump = root.select(F.col("r").alias("to"), F.col("to").alias("to2"))
        root2 = root.join(jump, "to", "left").select("r", F.coalesce("to2", "to").alias("to"))
        after = keep(labels.join(root2, labels["c"] == root2["r"]).select("v", F.col("to").alias("c")), "labels")
        release(labels, root)
        labels = after

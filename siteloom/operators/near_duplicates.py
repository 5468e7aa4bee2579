"""Clusters of pages whose 64-bit fingerprints differ in at most three bits, found by equal parts of the bits."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import simhash
from ..plans.tables import keep, numbered

MOST_BITS, BLOCKS = 3, 6


def fingerprinted(rows: DataFrame, text_col: str, out: str = "content_simhash") -> DataFrame:
    """rows without the text but with its fingerprint, in one Arrow pass."""
    kept = [f for f in rows.schema.fields if f.name != text_col]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            prints = [simhash(t) for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]
            yield pa.record_batch([*[batch.column(batch.schema.names.index(n)) for n in names], pa.array(prints, pa.string())], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, {out} string")


def candidates(pages: DataFrame) -> DataFrame:
    """Indexable HTML pages fetched as 200 without a redirect, that have a fingerprint."""
    return pages.where("content_simhash RLIKE '^[0-9a-f]{16}$' AND html_size_bytes > 0 AND status = 200 AND size(redirect_chain) = 0 AND indexability = 'Indexable'")


def near_pairs(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """fp1 < fp2, distance of distinct fingerprints (prints: content_simhash), by an equi-join on parts of the bits.

    The bits are cut into BLOCKS blocks; at most `most` of them can differ, so some BLOCKS - most blocks agree wholly, and
    their values are a key: 20 keys of 31 or 32 bits. Even a billion fingerprints leave few in a cell by chance.
    """
    fp = prints.select("content_simhash").distinct().withColumn("v", F.conv("content_simhash", 16, -10).cast("long"))
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in some) for some in combinations(range(BLOCKS), BLOCKS - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bands = fp.select("content_simhash", "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in signed])).alias("band", "value"))
    a, b = bands.alias("a"), bands.alias("b")
    near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.content_simhash") < F.col("b.content_simhash")))
    distance = F.bit_count(F.col("a.v").bitwiseXOR(F.col("b.v")))
    return near.where(distance <= most).select(F.col("a.content_simhash").alias("fp1"), F.col("b.content_simhash").alias("fp2"), distance.cast("long").alias("distance")).distinct()


def clusters(pages: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """url, cluster, cluster_size of pages (url, seq, content_simhash, content_hash) in clusters of different content."""
    prints = pages.select("content_simhash").distinct()
    pairs = keep(near_pairs(prints, most), "near-pairs")
    both = pairs.select(F.col("fp1").alias("u"), F.col("fp2").alias("v")).unionByName(pairs.select(F.col("fp2").alias("u"), F.col("fp1").alias("v")))
    labels = keep(prints.select(F.col("content_simhash").alias("u"), F.col("content_simhash").alias("c")), "near-labels")
    while True:
        low = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("low"))
        after = labels.join(low, "u", "left").select("u", F.least("c", F.coalesce("low", "c")).alias("c"))
        jump = after.select(F.col("u").alias("c"), F.col("c").alias("c2"))
        after = keep(after.join(jump, "c", "left").select("u", F.coalesce("c2", "c").alias("c")), "near-labels")
        moved = not after.join(labels.withColumnRenamed("c", "was"), "u").where("c <> was").isEmpty()
        labels = after
        if not moved:
            break
    rows = pages.join(labels, pages["content_simhash"] == labels["u"]).select("url", "seq", "content_simhash", "content_hash", "c")
    kinds = rows.groupBy("c").agg(
        F.count_distinct("content_simhash").alias("nodes"), F.count("*").alias("cluster_size"), F.min("seq").alias("first"),
        F.count_distinct("content_simhash", "content_hash").alias("versions"))
    kinds = kinds.where((F.col("nodes") > 1) | (F.col("versions") > F.col("nodes")))
    return rows.join(numbered(kinds, "cluster", "first"), "c").select("url", "cluster", "cluster_size")

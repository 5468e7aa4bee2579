"""Comments of posts with their votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threads(comments: DataFrame, votes: DataFrame, mine: Column) -> DataFrame:
    """comments (id, parent_id, status) as id, parent, score, my_vote for the approved ones.

    parent is null for roots, and for replies whose parent is missing or not approved, which become roots. votes
    (comment_id, value) are summed before the join; mine marks the viewer's votes. Without votes both figures are 0.
    """
    approved = comments.where("status = 'approved'").select("id", "parent_id")
    sums = votes.groupBy("comment_id").agg(F.sum("value").cast("long").alias("score"), F.max(F.when(mine, F.col("value"))).cast("long").alias("my_vote"))
    parents = approved.select(F.col("id").alias("parent"))
    rows = approved.join(parents, F.col("parent_id") == F.col("parent"), "left").join(sums, F.col("id") == F.col("comment_id"), "left")
    return rows.select("id", "parent", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("my_vote", F.lit(0)).alias("my_vote"))

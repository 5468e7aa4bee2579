"""Mobile usability of laid-out pages, from tables of a renderer: widths, text runs and the boxes of tap targets.

Spacing is a join on a grid of cells: a box is in all cells that it, widened by the least spacing, touches, and meets only
boxes of the same cell; a pair is counted in one of the cells that it shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL, SPACING, TARGET, MOST_TARGETS, FONT, SMALL_SHARE = 48, 8, 48, 600, 12, 0.25


def wide_content(layouts: DataFrame) -> DataFrame:
    """layouts: url, content_width, window_width."""
    return layouts.where(F.col("content_width") > F.col("window_width") + 1).select("url", F.lit("content-width").alias("id"), F.lit(1).cast("long").alias("node_count"))


def small_text(runs: DataFrame) -> DataFrame:
    """runs: url, chars, font_size."""
    small = F.sum(F.when(F.col("font_size") < FONT, F.col("chars")).otherwise(0))
    rows = runs.groupBy("url").agg(small.alias("node_count"), F.sum("chars").alias("total"))
    return rows.where((F.col("total") > 0) & (F.col("node_count") / F.col("total") > SMALL_SHARE)).select("url", F.lit("font-size").alias("id"), F.col("node_count").cast("long").alias("node_count"))


def small_targets(boxes: DataFrame) -> DataFrame:
    """boxes: url, i, x0, y0, x1, y1."""
    rows = boxes.where((F.col("x1") - F.col("x0") < TARGET) | (F.col("y1") - F.col("y0") < TARGET)).groupBy("url").agg(F.count("*").alias("node_count"))
    return rows.select("url", F.lit("tap-targets-size").alias("id"), "node_count")


def close_targets(boxes: DataFrame) -> DataFrame:
    """Pairs nearer than the least spacing in both directions that don't overlap, of pages with few enough targets."""
    few = boxes.groupBy("url").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_TARGETS).select("url")
    cells = lambda low, high: F.sequence(F.floor((F.col(low) - SPACING) / CELL), F.floor((F.col(high) + SPACING) / CELL))
    dealt = boxes.join(few, "url", "left_semi").withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    dealt = dealt.withColumns({"lx": F.floor((F.col("x0") - SPACING) / CELL), "ly": F.floor((F.col("y0") - SPACING) / CELL)})
    a, b = dealt.alias("a"), dealt.alias("b")
    c = F.col
    same = (c("a.url") == c("b.url")) & (c("a.cx") == c("b.cx")) & (c("a.cy") == c("b.cy")) & (c("a.i") < c("b.i"))
    # The pair's own cell: the first that both touch.
    once = (c("a.cx") == F.greatest("a.lx", "b.lx")) & (c("a.cy") == F.greatest("a.ly", "b.ly"))
    dx = F.greatest(c("a.x0") - c("b.x1"), c("b.x0") - c("a.x1"), F.lit(0))
    dy = F.greatest(c("a.y0") - c("b.y1"), c("b.y0") - c("a.y1"), F.lit(0))
    pairs = a.join(b, same & once).where(((dx != 0) | (dy != 0)) & (dx < SPACING) & (dy < SPACING))
    return pairs.groupBy(c("a.url").alias("url")).agg(F.count("*").alias("node_count")).select("url", F.lit("tap-targets-spacing").alias("id"), "node_count")


def audit(layouts: DataFrame, runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """url, id, node_count: a row per violation."""
    return wide_content(layouts).unionByName(small_text(runs)).unionByName(small_targets(boxes)).unionByName(close_targets(boxes))

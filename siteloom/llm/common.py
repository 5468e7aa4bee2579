"""Shared pieces of the training-data operators: text expressions, shared tables, ordered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import keep, new_path, numbered, release, scope, shared_folder, small

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "[\\x20\\x09-\\x0D]+"
#: A null doc_id sorts before every other and counts as one document.
NO_ID = -(2**63)

__all__ = ["keep", "new_path", "numbered", "release", "scope", "shared_folder", "small", "hot_join"]


def hot_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, few: int = 50_000) -> DataFrame:
    """rows joined with a kept table of keys, whose column n says how many rows have the key, without a hot task.

    A counted small table is broadcast. Of a larger one the keys that hold over a 20000th of its rows are: there are fewer
    than 20000 of these, and the others meet in a shuffle join.
    """
    if keys.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(keys), on)
    total = keys.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(keys.where(F.col(n) > total / 20_000))
    cold = rows.join(hot.select(on), on, "left_anti").join(keys.where(F.col(n) <= total / 20_000), on)
    return rows.join(hot, on).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same for pure ASCII, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, GAP), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Words of a text, 0 for null; the empty pieces of a split can only be its first and last."""
    parts = F.split(F.btrim(c, F.lit(SPACE)), GAP)
    return F.when(c.isNull() | (F.btrim(c, F.lit(SPACE)) == ""), 0).otherwise(F.size(parts)).cast("long")


def before(df: DataFrame, order: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """df(order bigint >= 0, unique) with the sum of value over all smaller orders.

    Two levels: sums inside blocks of `width` consecutive orders, and over the blocks; no task holds more than
    max(width, rows / width) rows.
    """
    block = F.floor(F.col(order) / width).cast("long")
    rows = df.withColumn("__block", block)
    sums = rows.groupBy("__block").agg(F.sum(value).alias("__sum"))
    upto = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__block", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums, "__block").withColumn(out, F.col("__base") + F.col("__in")).drop("__block", "__base", "__in")

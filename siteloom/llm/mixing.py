"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order, null last, weigh 5, 2, 1, repeating; they share `share` times the words of all documents,
a target stops at `most` times its source's words, and the excess is reshared by weight until none is above.

floor(target / words) of a source are certain whole copies of every document. For the rest of its target a document is
wanted once more with an inclusion probability in proportion to its size, min(1, rate * size), where the rate makes the
expected words equal to that rest: long documents may reach 1, a further certain copy. Each other document draws u from
a hash of its id and ranks by (u / (1 - u)) / (p / (1 - p)), the random odds by the inclusion odds; documents are taken
in that order while their words fit into what is left. The sample's size is so fixed in words, as that of the targets
is. What then still lacks is filled by one more copy of the one document whose words come nearest, if that lessens the
gap.

Edge cases: a null text has size 0, a null source is a source of its own, after all others; a null doc_id draws by its
text; identical rows draw alike, but only one of them is taken to fill a gap; a source without words has target 0; an empty table gives an empty table; only
doc_id, text and source are read, so other columns cannot clash. Reruns agree: nothing depends on partitions.

Scale: the rate of a source is found in a table of its distinct sizes, counted on the map side; the window over it holds
a row per size, not per document. The prefix of a source in rank order is found by two radix levels of 4096 buckets of the rank (counts combined on
the map side), then a window over the one boundary bucket, about 1 in 16 million rows of a source; a source that holds
a third of all rows therefore meets no single task. Tables with a row per source are broadcast only if counted small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small, word_count

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BUCKETS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, draw key and the uniform draw u in (0, 1)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("__key"))), 1, 13), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("__key"), F.monotonically_increasing_id().alias("__row"))
    return rows.withColumn("__u", (bits + F.lit(0.5)) / F.lit(float(2**52)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, __certain (copies of each document) and __rest (words of the target beyond those)."""
    cast = F.expr("CASE " + " ".join(f"WHEN (rn - 1) % {len(weights)} = {i} THEN {w}" for i, w in enumerate(weights)) + " END")
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("rn", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("w", cast)
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("w"))
    by_fill = Window.orderBy("fill", "rn")
    every = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open_w", F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("rate", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("capped")) / F.col("open_w"))
    s = s.withColumn("rate", F.min_by("rate", F.when(F.col("rate") <= F.col("fill"), F.struct("fill", "rn"))).over(every))
    s = s.withColumn("target", F.when(F.col("fill") < F.col("rate"), F.col("cap")).otherwise(F.col("w") * F.col("rate")))
    s = s.withColumn("__e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    return s.select(
        "source", "source_size", "target", F.floor("__e").alias("__certain"), (F.col("target") - F.floor("__e") * F.col("source_size")).alias("__rest"))


def rates(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """per_source with __rate, so that the expected words of min(1, __rate * size) are __rest, and __sure, the smallest size that reaches 1.

    With sizes in ascending order, a size is sure if its probability would reach 1 at the rate at which it and all smaller
    ones make up what the larger ones leave; a size that isn't sure has no sure one below it.
    """
    by_size = sizes.where("size > 0").groupBy("source", "size").agg((F.count("*") * F.col("size")).alias("__words"))
    rows = _by_source(by_size, per_source).withColumn("__square", (F.col("__words").cast("decimal(38,0)") * F.col("size")).cast("decimal(38,0)"))
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("__rest") - (F.col("source_size") - F.sum("__words").over(upto))
    rows = rows.withColumn("__sure", F.col("size") * left >= F.sum("__square").over(upto).cast("double"))
    found = rows.groupBy("source").agg(
        F.min(F.when(F.col("__sure"), F.col("size"))).alias("__sure"),
        F.coalesce(F.sum(F.when(F.col("__sure"), F.col("__words"))), F.lit(0)).alias("__whole"),
        F.sum(F.when(~F.col("__sure"), F.col("__square"))).cast("double").alias("__squares"))
    out = _by_source(per_source, found, "left")
    rest = F.col("__rest") - F.coalesce("__whole", F.lit(0))
    return out.select("source", "source_size", "target", "__certain", "__sure", rest.alias("__rest"), F.try_divide(rest, F.col("__squares")).alias("__rate"))


def _cut(rows: DataFrame, bucket: str, base: str) -> DataFrame:
    """Per source the bucket in which the words in rank order pass __rest, and the words before it."""
    sums = rows.groupBy("source", bucket, "__rest", base).agg(F.sum("__drawn").alias("__words"))
    run = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.col(base) + F.coalesce(F.sum("__words").over(run), F.lit(0)))
    return sums.where(F.col("__before") + F.col("__words") > F.col("__rest")).groupBy("source").agg(
        F.min(F.struct(bucket, "__before")).alias("__c")
    ).select("source", F.col("__c")[bucket].alias(f"{bucket}_cut"), F.col("__c")["__before"].alias(f"{bucket}_base"))


def _by_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    right = table.withColumnRenamed("source", "__s")
    return rows.join(right, rows["source"].eqNullSafe(right["__s"]), how).drop("__s")


def drawn(docs: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, source, size, source_size, target, copies."""
    rows = keep(sized(docs), "sizes")
    per_source = small(keep(rates(rows, small(keep(targets(rows), "targets"))), "rates"))
    rows = _by_source(rows, per_source).withColumn("__whole", F.coalesce(F.col("size") >= F.col("__sure"), F.lit(False)))
    rows = rows.withColumn("__chance", F.when(F.col("__whole"), 0.0).otherwise(F.coalesce(F.col("size") * F.col("__rate"), F.lit(0.0))))
    odds = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__chance") / (1 - F.col("__chance")))
    rows = rows.withColumn("__rank", F.when(F.col("__chance") > 0, odds / (1 + odds)).otherwise(F.lit(1.0)))
    drawn_by = F.when(F.col("__chance") > 0, F.col("size")).otherwise(0)
    rows = rows.withColumn("__drawn", drawn_by)
    rows = rows.withColumn("__b1", F.least(F.floor(F.col("__rank") * BUCKETS), F.lit(BUCKETS - 1)))
    rows = rows.withColumn("__b2", F.floor((F.col("__rank") * BUCKETS - F.col("__b1")) * BUCKETS)).withColumn("__zero", F.lit(0))
    cut1 = small(keep(_cut(rows, "__b1", "__zero"), "cut1"))
    rows = _by_source(rows, cut1, "left")
    edge1 = rows.where(F.col("__b1") == F.col("__b1_cut"))
    cut2 = small(keep(_cut(edge1, "__b2", "__b1_base"), "cut2"))
    rows = _by_source(rows, cut2, "left")
    edge2 = rows.where((F.col("__b1") == F.col("__b1_cut")) & (F.col("__b2") == F.col("__b2_cut")))
    fits = edge2.withColumn("__run", F.col("__b2_base") + F.sum("__drawn").over(Window.partitionBy("source").orderBy("__rank", "__key")))
    last = small(keep(
        fits.where(F.col("__run") <= F.col("__rest")).groupBy("source").agg(F.max(F.struct("__rank", "__key")).alias("__last")), "last"))
    rows = _by_source(rows, last, "left")
    in_first = F.col("__b1_cut").isNull() | (F.col("__b1") < F.col("__b1_cut"))
    in_second = (F.col("__b1") == F.col("__b1_cut")) & (F.col("__b2") < F.col("__b2_cut"))
    in_edge = (F.col("__b1") == F.col("__b1_cut")) & (F.col("__b2") == F.col("__b2_cut")) & (F.struct("__rank", "__key") <= F.col("__last"))
    chosen = (F.col("__chance") > 0) & (in_first | in_second | F.coalesce(in_edge, F.lit(False)))
    rows = rows.withColumn("__chosen", F.coalesce(chosen, F.lit(False)))
    lack = small(keep(rows.groupBy("source", "__rest").agg(F.sum(F.when(F.col("__chosen"), F.col("__drawn")).otherwise(0)).alias("__got"))
                      .select("source", (F.col("__rest") - F.col("__got")).alias("__lack")), "lack"))
    rows = _by_source(rows, lack)
    off = F.abs(F.col("__lack") - F.col("size"))
    fill = small(keep(
        rows.where(~F.col("__chosen") & (F.col("__chance") > 0) & (off < F.col("__lack"))).groupBy("source")
        .agg(F.min(F.struct(off.alias("__off"), F.col("__rank"), F.col("__key"), F.col("__row"))).alias("__f"))
        .select("source", F.col("__f")["__row"].alias("__fill")), "fill"))
    rows = _by_source(rows, fill, "left")
    extra = F.when(F.col("__whole") | F.col("__chosen") | F.coalesce(F.col("__fill") == F.col("__row"), F.lit(False)), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("__certain") + extra).cast("long").alias("copies"), "__key", "__u")


def digest(docs: DataFrame) -> DataFrame:
    return drawn(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    inner = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), key.alias("__key"))
    picks = drawn(docs).where("copies > 0").groupBy("__key").agg(F.max("copies").cast("int").alias("__copies"))
    out = inner.join(picks, "__key").withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         (CAST('0x' || md5('mix:' || CAST(doc_id AS VARCHAR))[1:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2.0::DOUBLE * source_size AS cap,
         2.0::DOUBLE * source_size / CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS fill FROM s0
), s2 AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY fill, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY fill, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM s1
), s3 AS (
  SELECT *, (SELECT rate FROM s2 WHERE rate <= fill ORDER BY fill, rn LIMIT 1) AS level FROM s2
), s4 AS (
  SELECT *, CASE WHEN fill < level THEN cap ELSE w * level END AS target FROM s3
), s5 AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e FROM s4
), s6 AS (
  SELECT *, floor(e) AS certain, target - floor(e) * source_size AS rest FROM s5
), z AS (
  SELECT d.source, d.size, CAST(count(*) * d.size AS BIGINT) AS words, any_value(s6.rest) AS rest, any_value(s6.source_size) AS source_size
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source WHERE d.size > 0 GROUP BY d.source, d.size
), y AS (
  SELECT source, size, words, size * (rest - (source_size - sum(words) OVER w)) >= CAST(sum(words * size) OVER w AS DOUBLE) AS sure
  FROM z WINDOW w AS (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING)
), x AS (
  SELECT source, min(size) FILTER (sure) AS sure, coalesce(sum(words) FILTER (sure), 0) AS whole, CAST(sum(words * size) FILTER (NOT sure) AS DOUBLE) AS squares
  FROM y GROUP BY source
), s AS (
  SELECT s6.source, source_size, target, certain, sure, rest - coalesce(whole, 0) AS rest, (rest - coalesce(whole, 0)) / nullif(squares, 0) AS rate
  FROM s6 LEFT JOIN x ON s6.source IS NOT DISTINCT FROM x.source
), r0 AS (
  SELECT d.*, s.source_size, s.target, s.certain, s.rest, coalesce(size >= sure, FALSE) AS whole,
         CASE WHEN coalesce(size >= sure, FALSE) THEN 0.0::DOUBLE ELSE coalesce(size * rate, 0.0::DOUBLE) END AS chance
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), r AS (
  SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS q, CASE WHEN chance > 0 THEN size ELSE 0 END AS drawn FROM r0
), c AS (
  SELECT *, chance > 0 AND sum(drawn) OVER (PARTITION BY source ORDER BY q, CAST(doc_id AS VARCHAR)) <= rest AS chosen FROM r
), g AS (
  SELECT *, rest - sum(CASE WHEN chosen THEN drawn ELSE 0 END) OVER (PARTITION BY source) AS lack FROM c
), f AS (
  SELECT *, row_number() OVER (PARTITION BY source, NOT chosen AND chance > 0 AND abs(lack - size) < lack
                               ORDER BY abs(lack - size), q, CAST(doc_id AS VARCHAR)) AS nth FROM g
)
SELECT doc_id, size, source_size, target,
       CAST(size * (certain + CASE WHEN whole OR chosen OR (chance > 0 AND abs(lack - size) < lack AND nth = 1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM f
"""

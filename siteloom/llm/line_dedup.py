"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

Only DataFrame functions run. A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z in lower case;
two 64-bit hashes with different seeds stand for it. A key of at least `min_chars` code points that at least
`min_docs` documents hold loses all its lines but those of the largest doc_id that holds it.

Edge cases: a null or empty text is one empty line; a null doc_id counts as one document below all others; rows that
share a doc_id are one document, and identical rows get identical results; an empty table gives an empty table; only
doc_id and text are read, so other columns cannot clash.

Scale: the first count is combined on the map side and only finds candidate keys; the exact count of documents and the
drops touch candidate keys only. Those are broadcast if counted few; else the hot ones are, and the rest meet in a
shuffle join, so that no key gathers in a task. The document text is shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SPACE, ascii_lower, hot_join, keep

MIN_CHARS, MIN_DOCS = 40, 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _identified(docs: DataFrame, more: list[str]) -> DataFrame:
    return docs.select(
        *more, "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"), F.xxhash64("text").alias("__text_hash"),
    )


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: __doc, __text_hash, __pos, __h1, __h2."""
    keys = F.transform(_lines(F.col("text")), lambda line: ascii_lower(F.btrim(line, F.lit(SPACE))))
    hashed = F.transform(keys, lambda k, i: F.when(
        F.char_length(k) >= min_chars,
        F.struct(i.alias("__pos"), F.xxhash64(k).alias("__h1"), F.xxhash64(F.lit(1), k).alias("__h2"))))
    return _identified(docs, []).select("__doc", "__text_hash", F.inline(F.filter(hashed, lambda x: x.isNotNull())))


def repeated_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Kept: keys that enough documents hold, their lines (__n), and the document that keeps them."""
    key = ["__h1", "__h2"]
    often = keep(lines.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_docs), "frequent-keys")
    # Salted by document: distinct pairs are hashed by both, and their counts are combined before they move by key.
    held = hot_join(lines.select(*key, "__doc"), often, key, "__n").distinct()
    found = held.groupBy(*key, "__n").agg(F.count("*").alias("__docs"), F.max("__doc").alias("__keeper"))
    return keep(found.where(F.col("__docs") >= min_docs).drop("__docs"), "repeated-keys")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: list[str] | None = None) -> DataFrame:
    """Per row of docs: the carried columns, n_lines, n_dropped and kept_text."""
    carry = ["doc_id"] if carry is None else carry
    lines = keep(long_lines(docs, min_chars), "lines")
    drops = (
        hot_join(lines, repeated_keys(lines, min_docs), ["__h1", "__h2"], "__n").where(F.col("__doc") != F.col("__keeper"))
        .groupBy("__doc", "__text_hash").agg(F.array_distinct(F.collect_list("__pos")).alias("__drop"))
    )
    rows = _identified(docs, [c for c in carry if c != "text"]).join(drops, ["__doc", "__text_hash"], "left")
    rows = rows.withColumn("__lines", _lines(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    return rows.select(
        *[c for c in carry if c != "text"],
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
        F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    out = without_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def apply(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines gone from text and n_chars brought up to date."""
    inner = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col("doc_id"), F.col("text"))
    out = without_repeated_lines(inner, carry=["doc_id", "__row"])
    new = {"text": F.when((F.col("n_dropped") == 0), F.col("__row.text")).otherwise(F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("__row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), v AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, l.line, l.pos, v.k IS NOT NULL AND l.doc_id <> v.keeper AS gone FROM l LEFT JOIN v USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

"""Search over pages and resources, custom searches, windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _any_contains(columns: tuple[str, ...], needle: str) -> Column:
    held = F.lit(False)
    for c in columns:
        held = held | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return held


def search_pages(pages: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring of url, title, meta description or h1; blank: all."""
    return pages.where(_any_contains(("url", "title", "meta_description", "h1"), needle)) if needle.strip() else pages


def search_resources(resources: DataFrame, needle: str) -> DataFrame:
    return resources.where(_any_contains(("url", "source_page", "alt_text"), needle)) if needle.strip() else resources


def status_bucket(status: Column) -> Column:
    return F.when(status > 0, F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("error")


def match_count(subject: Column, pattern: str, is_regex: bool = False) -> Column:
    """Non-overlapping matches: a literal in any case, or a regex as written."""
    regex = pattern if is_regex else "(?iu)\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(F.coalesce(subject, F.lit("")), F.lit(regex)).cast("long")


def custom_search_totals(rows: DataFrame, subject: str, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """rule, contains, missing: rows with and without a match of each (id, pattern, is_regex)."""
    counts = F.array(*[F.struct(F.lit(i).alias("rule"), match_count(F.col(subject), p, x).alias("n")) for i, p, x in rules])
    return rows.select(F.explode(counts).alias("c")).groupBy("c.rule").agg(F.count_if(F.col("c.n") > 0).alias("contains"), F.count_if(F.col("c.n") == 0).alias("missing"))


def sliding_limit(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """events with recent (events of the key in the last `seconds`, this one included) where that reaches the limit."""
    back = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(back)).where(F.col("recent") >= most)


def tumbling_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    return events.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def state_changes(events: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """Rows whose state differs from the one before of their key; a key's first row counts."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("was", F.lag(state).over(w)).where(~F.col(state).eqNullSafe(F.col("was")))


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """rows with repeated: whether another row has the value too."""
    return rows.withColumn("repeated", F.count("*").over(Window.partitionBy(column)) > 1)


def page_table(pages: DataFrame, found: DataFrame, inlinks: DataFrame, scores: DataFrame) -> DataFrame:
    """The columns of the page list with what other tables tell of a page."""
    counts = found.where("scope = 'page'").groupBy("url").agg(F.count("*").alias("n_issues"))
    rows = pages.select("url", "status", "indexability", "title", "title_length")
    rows = rows.join(inlinks.withColumnRenamed("target", "url"), "url", "left").join(scores, "url", "left").join(counts, "url", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("inlinks", "unique_inlinks", "n_issues")})


#: Labels of a page's details and their values; a null is left out. Fixed labels.
DETAILS = {"Title": "title", "Status": "CAST(status AS STRING)", "Indexability": "indexability", "Canonical": "canonical", "Redirects": "nullif(array_join(redirect_chain, ' -> '), '')", "Words": "CAST(word_count AS STRING)"}


def details(pages: DataFrame) -> DataFrame:
    """url, label, value: a row per known detail."""
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.expr(e).alias("value")) for k, e in DETAILS.items()])
    return pages.select("url", F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("x")).select("url", "x.label", "x.value")

"""Comparison of two crawls by URL key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalise
from . import issues

FIELDS = ("status", "indexability", "title", "meta_description", "h1", "canonical")
WORDS_CHANGED = 0.2


def host_input(value: str | None) -> str:
    """What a user gives as a host, with or without a scheme or path, as host[:port]; empty if it isn't one."""
    value = (value or "").strip()
    if not value:
        return ""
    found = normalise(value if re.match(r"(?i)[a-z][a-z0-9+.-]*://", value) else f"http://{value}")
    return re.match(r"https?://([^/?#]*)", found)[1] if found else ""


def url_key(url: Column, host_from: str | None = None, host_to: str | None = None) -> Column:
    """Without the fragment, with one host:port put for another."""
    bare = F.regexp_replace(url, "#.*$", "")
    one, two = host_input(host_from), host_input(host_to)
    if not one or not two or one == two:
        return bare
    return F.regexp_replace(bare, f"^([a-z]+://)\\Q{one}\\E(?=[/?#]|$)", F.lit(f"$1{two}"))


def side(pages: DataFrame, **mapping) -> DataFrame:
    """First page per key; collisions is how many share it beyond the first."""
    rows = pages.withColumn("key", url_key(F.col("url"), **mapping))
    if "canonical" in pages.columns:
        rows = rows.withColumn("canonical", url_key(F.col("canonical"), **mapping))
    first = F.min_by(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in FIELDS], "word_count"), "seq")
    return rows.groupBy("key").agg((F.count("*") - 1).alias("collisions"), first.alias("first")).select("key", "collisions", "first.*")


def collisions(before: DataFrame, after: DataFrame, **mapping) -> DataFrame:
    """One row: before, after; pages of each crawl whose key an earlier page has."""
    b, a = (side(p, **m).agg(F.coalesce(F.sum("collisions"), F.lit(0)).alias(n)) for p, m, n in ((before, mapping, "before"), (after, {}, "after")))
    return b.crossJoin(a)


def diff(before: DataFrame, after: DataFrame, **mapping) -> DataFrame:
    """key, kind (added, removed, changed), field, before, after: a row per added or removed page and per changed field."""
    b, a = side(before, **mapping), side(after)
    b = b.select("key", F.struct(*[c for c in b.columns if c != "key"]).alias("b"))
    a = a.select("key", F.struct(*[c for c in a.columns if c != "key"]).alias("a"))
    both = b.join(a, "key", "full_outer")
    changed = [F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("before"), F.col(f"a.{f}").alias("after"))) for f in FIELDS]
    far = F.abs(F.col("a.word_count") - F.col("b.word_count")) > WORDS_CHANGED * F.col("b.word_count")
    changed.append(F.when(far, F.struct(F.lit("word_count").alias("field"), F.col("b.word_count").cast("string").alias("before"), F.col("a.word_count").cast("string").alias("after"))))
    one = F.array(F.struct(F.lit("").alias("field"), F.col("b.status").alias("before"), F.col("a.status").alias("after")))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    rows = both.select("key", kind.alias("kind"), F.explode(F.when(kind == "changed", F.array_compact(F.array(*changed))).otherwise(one)).alias("x"))
    return rows.select("key", "kind", "x.field", F.coalesce("x.before", F.lit("")).alias("before"), F.coalesce("x.after", F.lit("")).alias("after"))


#: Signals that crawlers began to collect at some time, the issues that rest on them, and whether a crawl has them: some
#: page shows them, or nothing in it could have. Fixed values (the issues of each family).
FAMILIES = {
    "heading outline": ("h1TooLong", "missingH2", "multipleH2", "duplicateH2", "h2TooLong", "nonSequentialHeadings"),
    "title and meta counts": ("multipleTitles", "multipleMetaDescriptions", "metaRefresh", "paginationTargetError"),
    "internal outlinks": ("orphanPage", "internalRedirect", "singleInlink", "linksToErrorPages", "nonDescriptiveAnchors", "emptyAnchors"),
    "security headers": ("missingCsp", "missingFrameOptions", "missingContentTypeOptions", "missingReferrerPolicy", "mixedContent"),
    "hreflang links": ("hreflangMissingReturn", "hreflangMissingSelf", "hreflangMissingXDefault", "hreflangInvalidCode", "hreflangTargetError"),
    "image sizes": ("imageMissingDimensions", "largeImage"),
    "content fingerprints": ("nearDuplicateContent",),
    "raw and rendered": ("jsChangesTitle", "jsChangesCanonical", "jsChangesRobots", "jsAddsMostContent", "jsAddsLinks"),
}


def captured(pages: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """One row with a Boolean per family; one pass over the pages and one over the resources."""
    some = lambda test: F.coalesce(F.bool_or(F.coalesce(F.expr(test), F.lit(False))), F.lit(False))
    p = pages.agg(
        (some("size(heading_levels) > 0") | ~some("h1_count > 0")).alias("heading outline"), (some("title_count > 0") | ~some("coalesce(title, '') <> ''")).alias("title and meta counts"),
        (some("size(outlinks) > 0") | ~some("internal_link_count > 0")).alias("internal outlinks"), (some("security_headers_captured") | ~some("status IS NOT NULL")).alias("security headers"),
        (some("size(hreflang_links) > 0") | ~some("size(hreflang_values) > 0")).alias("hreflang links"), some("images_missing_dimensions > 0").alias("__shown"), some("image_count > 0").alias("__images"),
        (some("coalesce(content_simhash, '') <> ''") | ~some("word_count >= 20")).alias("content fingerprints"), (some("raw IS NOT NULL") | ~some("rendered")).alias("raw and rendered"))
    if resources is None:
        r = p.sparkSession.range(1).select(F.lit(False).alias("__sized"), F.lit(False).alias("__any"))
    else:
        r = resources.agg(some("content_length IS NOT NULL").alias("__sized"), some("resource_type = 'image'").alias("__any"))
    both = p.crossJoin(r).withColumn("image sizes", F.col("__shown") | F.col("__sized") | (~F.col("__images") & ~F.col("__any")))
    return both.select(*FAMILIES)


def incomparable(before: tuple, after: tuple) -> DataFrame:
    """issue_key of the issues whose count is unknown in at least one of two crawls (pages, resources)."""
    rows = captured(*before).unionByName(captured(*after))
    lost = rows.select(F.explode(F.array_compact(F.array(*[F.when(~F.col(f"`{f}`"), F.array(*[F.lit(k) for k in keys])) for f, keys in FAMILIES.items()]))).alias("keys"))
    return lost.select(F.explode("keys").alias("issue_key")).distinct()


def crawl_issues(pages: DataFrame, resources: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """All issues of a saved crawl. It tells neither its mode nor the linked set: links are those of its pages' outlinks."""
    links = pages.select(F.col("url").alias("source"), F.explode("outlinks").alias("o")).select("source", F.col("o.url").alias("target"))
    hreflang = pages.select(F.col("url").alias("source"), F.explode("hreflang_links").alias("h")).select("source", "h.lang", "h.href")
    return issues.issue_long(pages, issues.cross_flags(pages, links, hreflang, near, linked=links.select(F.col("target").alias("url")).distinct()), resources)


def issue_deltas(before: DataFrame, after: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """issue_key, before, after, comparable over two issue summaries; unknown: keys that one of the crawls can't tell."""
    b, a = (x.groupBy("issue_key").agg(F.sum("n").alias(n)) for x, n in ((before, "before"), (after, "after")))
    both = b.join(a, "issue_key", "full_outer").select("issue_key", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    if unknown is None:
        return both.withColumn("comparable", F.lit(True))
    return both.join(F.broadcast(unknown.withColumn("u", F.lit(True))), "issue_key", "left").withColumn("comparable", F.col("u").isNull()).drop("u")

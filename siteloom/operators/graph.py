"""Link graph: edges, inlinks, link score, breadth-first depth, URL tree, redirect chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.tables import keep


def edges(pages: DataFrame) -> DataFrame:
    """One row per outlink: source, pos, target, anchor, nofollow, is_image_link; self links left out."""
    out = pages.select(F.col("url").alias("source"), F.posexplode("outlinks").alias("pos", "o"))
    return out.select("source", "pos", F.col("o.url").alias("target"), "o.anchor", "o.nofollow", "o.is_image_link").where("source <> target")


def inlinks(links: DataFrame) -> DataFrame:
    """target, inlinks and unique_inlinks (distinct sources), self links left out."""
    return links.where("source <> target").groupBy("target").agg(F.count("*").alias("inlinks"), F.count_distinct("source").alias("unique_inlinks"))


def linked_urls(pages: DataFrame, links: DataFrame, hreflang: DataFrame) -> DataFrame:
    """Distinct URLs that any page names by link, pagination or hreflang (self links too)."""
    paged = pages.select(F.explode(F.array_compact(F.array("pagination_next", "pagination_prev"))).alias("url"))
    return links.select(F.col("target").alias("url")).unionByName(hreflang.select(F.col("href").alias("url"))).unionByName(paged).distinct()


def link_score(pages: DataFrame, links: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """url, link_score: PageRank over followed links to crawled pages, distinct per source, scaled to a maximum of 100.

    Each round is one join and one map-side combined sum; lineage is cut every five rounds. Dangling mass and n are
    scalars of one row.
    """
    nodes = keep(pages.select("url").distinct(), "score-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("link_score", F.lit(0.0))
    ok = links.where("NOT nofollow AND source <> target").select("source", "target").distinct()
    ok = ok.join(nodes.withColumnRenamed("url", "target"), "target", "left_semi").join(nodes.withColumnRenamed("url", "source"), "source", "left_semi")
    degree = ok.groupBy("source").agg(F.count("*").alias("degree"))
    graph = keep(ok.join(degree, "source").select("source", "target", (1.0 / F.col("degree")).alias("share")), "score-graph")
    sinks = nodes.join(graph.select(F.col("source").alias("url")).distinct(), "url", "left_anti").withColumn("sink", F.lit(True))
    nodes2 = keep(nodes.join(sinks, "url", "left").select("url", F.coalesce("sink", F.lit(False)).alias("sink")), "score-sinks")
    rank = nodes2.withColumn("r", F.lit(1.0 / n))
    for i in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("r"))), F.lit(0.0)).alias("lost"))
        given = graph.join(rank.select(F.col("url").alias("source"), "r"), "source").groupBy(F.col("target").alias("url")).agg(F.sum(F.col("r") * F.col("share")).alias("given"))
        rank = nodes2.join(given, "url", "left").crossJoin(F.broadcast(lost)).select(
            "url", "sink", (F.lit((1 - damping) / n) + damping * F.col("lost") / n + damping * F.coalesce("given", F.lit(0.0))).alias("r"))
        if i % 5 == 4 or i + 1 == rounds:
            rank = keep(rank, "score")
    top = rank.agg(F.max("r").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("url", (F.floor(F.col("r") / F.col("top") * 100 * 10 + 0.5) / 10).alias("link_score"))


def bfs_depth(links: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """url, depth: fewest clicks from the start URLs, up to `most`; a level is one join and one anti-join."""
    seen = keep(start.select("url").distinct().withColumn("depth", F.lit(0).cast("long")), "bfs")
    frontier = seen
    for d in range(1, most + 1):
        found = links.join(frontier.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        frontier = keep(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(d).cast("long")), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def url_tree(pages: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """node, label, level, total_pages, total_issues: a roll-up over host and path segments, the query left out."""
    rows = pages.select("url", "seq", urls.scheme_host(F.col("url")).alias("site"), urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    first = rows.groupBy("host").agg(F.min_by("site", "seq").alias("root"))
    rows = rows.join(first, "host")
    if issues is not None:
        rows = rows.join(issues.groupBy("url").agg(F.count("*").alias("n_issues")), "url", "left")
    else:
        rows = rows.withColumn("n_issues", F.lit(0))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumn("segments", segments)
    nodes = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda i: F.struct(
        F.concat_ws("/", F.col("root"), F.array_join(F.slice(F.col("segments"), F.lit(1), i), "/")).alias("node"), i.alias("level")))
    nodes = F.transform(nodes, lambda x: F.struct(F.regexp_replace(x["node"], "/$", "").alias("node"), x["level"].alias("level")))
    out = rows.select("n_issues", F.explode(nodes).alias("x"))
    return out.groupBy(F.col("x.node").alias("node"), F.col("x.level").cast("long").alias("level")).agg(
        F.count("*").alias("total_pages"), F.sum(F.coalesce("n_issues", F.lit(0))).cast("long").alias("total_issues"))


def ranked_siblings(tree: DataFrame) -> DataFrame:
    """node, parent (empty for a root), place among its siblings: most pages first, then by label."""
    root = F.col("level") == 0
    rows = tree.withColumn("parent", F.when(root, "").otherwise(F.regexp_replace("node", "/[^/]*$", ""))).withColumn("label", F.regexp_extract("node", "[^/]*$", 0))
    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("total_pages"), "label"))
    return rows.select("node", "parent", place.cast("long").alias("place"))


def first_inlinks(links: DataFrame, most: int) -> DataFrame:
    """At most so many inlinks of each target, in crawl order."""
    rows = links.where("source <> target")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("source", "pos"))).where(F.col("rn") <= most).drop("rn")


def follow_redirects(hops: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """url, final, chain (array), capped: hops(from_url, to_url) followed up to `most` times, loops stopped."""
    at = start.select("url", F.col("url").alias("final"), F.array().cast("array<string>").alias("chain"))
    for _ in range(most):
        step = at.join(hops, at["final"] == hops["from_url"], "left")
        go = F.col("to_url").isNotNull() & ~F.array_contains("chain", F.col("to_url")) & (F.col("to_url") != F.col("url"))
        at = step.select("url", F.when(go, F.col("to_url")).otherwise(F.col("final")).alias("final"),
                         F.when(go, F.concat("chain", F.array("final"))).otherwise(F.col("chain")).alias("chain"))
    more = at.join(hops.select(F.col("from_url").alias("final")).distinct().withColumn("capped", F.lit(True)), "final", "left")
    return more.select("url", "final", "chain", F.coalesce("capped", F.lit(False)).alias("capped"))


__all__ = ["edges", "inlinks", "linked_urls", "link_score", "bfs_depth", "url_tree", "follow_redirects"]

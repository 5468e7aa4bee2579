"""A simulated web over page_id: pages, links, hreflang links and resources by arithmetic, so that every rule can fire.

The column expressions are SQL that Spark and DuckDB read alike; n is the page's number and m the number of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import RESOURCE, complete


def _url(expr: str) -> str:
    tail = ("CASE ({0}) % 97 WHEN 1 THEN '/Upper' WHEN 2 THEN '/a_b' WHEN 3 THEN '?x=1' WHEN 4 THEN repeat('/long-path', 11) WHEN 5 THEN '/%C3%BC' WHEN 6 THEN '//x' WHEN 7 THEN '/a/b/a' "
            "WHEN 8 THEN '/a%20b' WHEN 9 THEN '?utm_source=x' WHEN 10 THEN '/?q=Search' ELSE '' END")
    return f"concat(CASE WHEN ({expr}) % 71 = 8 THEN 'http' ELSE 'https' END, '://example.com/p', CAST({expr} AS STRING), {tail.format(expr)})"


WIDE = "(m + m DIV 10)"
PAGE_COLUMNS = {
    "seq": "n",
    "url": _url("n"),
    "status": "CAST(CASE WHEN n % 46 = 2 THEN NULL WHEN n % 23 = 2 THEN NULL WHEN n % 23 = 5 THEN 404 WHEN n % 23 = 9 THEN 500 ELSE 200 END AS INT)",
    "hops": "CAST(CASE WHEN n % 19 = 3 THEN 1 + n % 2 ELSE 0 END AS INT)",
    "depth": "n % 6",
    "discovered_via_sitemap": "n % 2 = 0",
    "title": "CASE WHEN n % 10 = 4 THEN NULL WHEN n % 33 = 7 THEN concat('A title that goes on about topic ', CAST(n AS STRING), repeat(' and WWWWWW', 4)) WHEN n % 43 = 3 THEN 'Sorry: page not found' "
             "WHEN n % 41 = 9 THEN concat('  topic  ', CAST((n * 3) % (m * 4 DIV 5 + 1) AS STRING)) WHEN n % 59 = 10 THEN 'iii' ELSE concat('Page about topic ', CAST((n * 7) % (m * 4 DIV 5 + 1) AS STRING)) END",
    "h1": "CASE WHEN n % 10 = 6 THEN NULL WHEN n % 53 = 5 THEN concat('Topic', repeat(' a long heading', 6)) ELSE concat('Topic ', CAST((n * 3) % (m * 4 DIV 5 + 1) AS STRING)) END",
    "meta_description": "CASE WHEN n % 9 = 1 THEN NULL WHEN n % 27 = 2 THEN concat(CAST(n AS STRING), repeat(' all there is to know', 9)) WHEN n % 25 = 3 THEN concat('Wide ', CAST(n AS STRING), repeat(' MW', 45)) ELSE concat('All there is to know about ', CAST((n * 5) % (m * 4 DIV 5 + 1) AS STRING)) END",
    "content_hash": "concat('c', CAST((n * 11) % (m * 9 DIV 10 + 1) AS STRING))",
    "canonical": f"CASE WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 1 THEN {_url(f'(n * 3 + 1) % {WIDE}')} ELSE {_url('n')} END",
    "pagination_next": f"CASE WHEN n % 10 = 7 THEN {_url(f'(n + 31) % {WIDE}')} ELSE NULL END",
    "pagination_prev": f"CASE WHEN n % 20 = 11 THEN {_url(f'(n * 2 + 5) % {WIDE}')} ELSE NULL END",
    "noindex": "n % 29 = 5",
    "word_count": "(n * 37) % 900",
    "title_count": "CASE WHEN n % 37 = 1 THEN 2 ELSE 1 END", "meta_description_count": "CASE WHEN n % 39 = 4 THEN 2 ELSE 1 END",
    "h2": "CASE WHEN n % 7 = 0 THEN NULL WHEN n % 49 = 9 THEN concat('Part', repeat(' with a long name', 5)) ELSE concat('Part ', CAST((n * 13) % (m * 4 DIV 5 + 1) AS STRING)) END",
    "h2_count": "CASE WHEN n % 7 = 0 THEN 0 WHEN n % 11 = 4 THEN 3 ELSE 1 END", "outline": "CASE WHEN n % 12 = 5 THEN '1,3,2' WHEN n % 12 = 7 THEN '2,1,2,3' WHEN n % 91 = 0 THEN '' ELSE '1,2' END",
    "has_lorem_ipsum": "n % 61 = 6", "text_ratio_pct": "CASE WHEN n % 21 = 8 THEN 4.5 WHEN n % 21 = 9 THEN 10.0 ELSE 50.0 END", "missing_alt_count": "n % 4",
    "internal_nofollow_count": "n % 6", "is_minified": "n % 3 <> 0", "canonical_count": "CASE WHEN n % 47 = 3 THEN 2 ELSE 1 END", "canonical_is_relative": "n % 31 = 4",
    "meta_robots": "CASE WHEN n % 29 = 5 THEN 'noindex, follow' WHEN n % 34 = 6 THEN 'index, examplebot: Nofollow' WHEN n % 36 = 7 THEN 'NONE' WHEN n % 37 = 8 THEN 'max-snippet:20' ELSE NULL END",
    "x_robots_tag": "CASE WHEN n % 38 = 9 THEN 'max-image-preview: large' WHEN n % 38 = 10 THEN ' , ' WHEN n % 38 = 11 THEN 'examplebot: nofollow' ELSE NULL END",
    "meta_refresh": "CASE WHEN n % 44 = 2 THEN '0;url=/x' WHEN n % 44 = 3 THEN '' ELSE NULL END", "internal_link_count": "CASE n % 50 WHEN 1 THEN 0 WHEN 2 THEN 1500 WHEN 3 THEN 1000 ELSE 11 END",
    "external_link_count": "n % 14", "response_time_ms": "(n * 53) % 1200", "size": "CASE n % 58 WHEN 1 THEN 2000000 WHEN 2 THEN 1048576 ELSE 5000 END", "images_missing_dimensions": "n % 5",
    "has_open_graph": "n % 8 = 0", "has_twitter_card": "n % 9 = 0", "viewport": "CASE n % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'width=device-width' END",
    "n_mobile": "CASE WHEN n % 19 = 4 THEN 1 ELSE 0 END", "n_axe": "CASE WHEN n % 22 = 4 THEN 2 ELSE 0 END", "rendered": "n % 3 = 0", "has_raw": "n % 6 < 4",
    "raw_title": "CASE WHEN n % 15 = 0 THEN 'Raw title' ELSE NULL END", "raw_robots": "CASE WHEN n % 18 = 0 THEN 'nofollow' WHEN n % 18 = 3 THEN 'index, all' ELSE NULL END",
    "raw_words": "(n * 37) % 900 DIV (1 + n % 4)", "raw_links": "CASE n % 10 WHEN 3 THEN 5 WHEN 6 THEN 6 ELSE 11 END", "has_data_error": "n % 24 = 5", "has_data_type": "n % 2 = 1",
    "unsafe_cross_origin_links": "CASE WHEN n % 13 = 2 THEN 1 ELSE 0 END", "hsts": "n % 2 = 0", "mixed_content_count": "CASE WHEN n % 17 = 8 THEN 3 ELSE 0 END", "captured_headers": "n % 4 <> 0",
    "content_security_policy": "CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 'default-src x; Frame-Ancestors none' WHEN 2 THEN '  ' ELSE 'default-src x' END",
    "x_frame_options": "CASE n % 7 WHEN 0 THEN 'DENY' WHEN 1 THEN ' ' ELSE NULL END", "x_content_type_options": "CASE n % 9 WHEN 0 THEN ' NoSniff ' WHEN 1 THEN 'sniff' ELSE NULL END",
    "referrer_policy": "CASE n % 11 WHEN 0 THEN 'origin' WHEN 1 THEN '' ELSE NULL END", "lang": "CASE n % 16 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'en' END",
    "insecure_link_count": "CASE WHEN n % 26 = 3 THEN 4 ELSE 0 END",
    # Fingerprints in groups of 23 pages, most of them far from each other; pages 3 and 4 of a group are near, 5 and 6 equal.
    "fp": "(n DIV 23) * 987654321123457 + CASE n % 23 WHEN 3 THEN 64 WHEN 4 THEN 65 WHEN 5 THEN 4096 WHEN 6 THEN 4096 ELSE (n % 23) * 45678912345 END",
}
INDEXABILITY = (
    "CASE WHEN status IS NULL THEN (CASE WHEN n % 46 = 2 THEN 'Non-Indexable (robots.txt)' ELSE 'Error' END) "
    "WHEN status >= 400 THEN concat('Non-Indexable (', CAST(status AS STRING), ')') WHEN hops > 0 THEN 'Redirected' "
    "WHEN noindex THEN 'Non-Indexable (noindex)' WHEN canonical <> url THEN 'Canonicalised' ELSE 'Indexable' END")
_PLAIN_TARGET = f"CASE WHEN k = 11 THEN n DIV 10 ELSE (n * 7 + k) % {WIDE} END"
#: Nothing links to some pages, and one link each to some others.
LINK_TARGET = f"({_PLAIN_TARGET}) + CASE WHEN ({_PLAIN_TARGET}) % 15 = 3 OR (({_PLAIN_TARGET}) % 15 = 9 AND k <> 3) THEN 1 ELSE 0 END"
LINKS = {
    "source": _url("n"), "pos": "CAST(k AS INT)", "target": _url(LINK_TARGET),
    "anchor": "CASE k % 4 WHEN 0 THEN 'Read more' WHEN 1 THEN 'click here' WHEN 2 THEN '' ELSE 'Pricing' END", "nofollow": "(n + k) % 20 = 0",
}
HREFLANG = {
    "source": _url("n"), "lang": "CASE k WHEN 1 THEN CASE n % 35 WHEN 2 THEN 'en-uk' WHEN 12 THEN 'EN-us' WHEN 22 THEN 'german' ELSE 'de' END WHEN 2 THEN 'fr' ELSE 'x-default' END",
    "href": _url(f"CASE k WHEN 1 THEN CASE WHEN n % 5 = 2 THEN n + 5 ELSE n - 5 END WHEN 2 THEN (n * 2) % {WIDE} ELSE n END"),
}
RESOURCES = {
    "url": "concat(CASE WHEN n % 10 = 8 THEN 'http://localhost:3000/i' WHEN n % 10 = 9 THEN 'https://dev.localhost/i' ELSE 'https://cdn.example.com/i' END, CAST(n AS STRING))", "resource_type": "CASE WHEN n % 10 < 7 THEN 'image' ELSE 'link' END",
    "source_page": "CASE WHEN n % 40 = 8 THEN 'http://127.0.0.1/' ELSE concat('https://example.com/p', CAST(n AS STRING)) END", "status": "CAST(CASE WHEN n % 10 = 3 THEN 404 ELSE 200 END AS INT)", "is_insecure": "n % 10 = 5",
    "error": "CASE WHEN n % 20 = 1 THEN 'timeout' ELSE NULL END", "content_length": "(n * 977) % 200000",
}


def _duck(sql: str) -> str:
    return sql.replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")


def _select(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in cols.items())


#: Common table expressions for the DuckDB side: sim, links, hreflang, resources.
ORACLE_CTES = _duck(
    "base AS (SELECT page_id AS n, (SELECT count(*) FROM pages) AS m FROM pages), "
    f"sim0 AS (SELECT n, m, {_select(PAGE_COLUMNS)} FROM base), sim AS (SELECT *, {INDEXABILITY} AS indexability FROM sim0), "
    f"links AS (SELECT {_select(LINKS)} FROM base, range(1, 12) AS r(k) WHERE k <= 10 OR n % 10 = 0), "
    f"hreflang AS (SELECT {_select(HREFLANG)} FROM base, range(1, 4) AS r(k) WHERE n % 5 = 2 OR (n % 5 = 4 AND k = 1)), "
    f"resources AS (SELECT {_select(RESOURCES)} FROM base)")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("n"))
    return pages.crossJoin(F.broadcast(pages.agg(F.count("*").alias("m"))))  # one row


def sim_pages(spark: SparkSession, sf_dir: str, arrays: bool = True) -> DataFrame:
    """Full page rows; arrays: with outlinks and hreflang links, which are gathered from their tables."""
    base = _base(spark, sf_dir)
    rows = base.select("n", "m", *[F.expr(e).alias(c) for c, e in PAGE_COLUMNS.items()]).withColumn("indexability", F.expr(INDEXABILITY))
    chain = F.when(F.col("hops") > 0, F.transform(F.sequence(F.lit(1), F.col("hops")), lambda i: F.concat(F.col("url"), F.lit("?hop="), i.cast("string"))))
    c, one = F.col, lambda x, kind: F.array(x).cast(kind)
    raw = F.struct(c("raw_title").alias("title"), F.lit(None).cast("string").alias("meta_description"), F.lit(None).cast("string").alias("h1"), F.when(c("n") % 21 != 0, c("canonical")).alias("canonical"),
                   c("raw_robots").alias("meta_robots"), c("raw_words").cast("long").alias("word_count"), c("raw_links").cast("long").alias("internal_link_count"))
    found = lambda k: F.struct(F.lit("x").alias("id"), F.lit("minor").alias("impact"), F.lit("").alias("description"), F.lit("").alias("help_url"), F.lit(1).cast("long").alias("node_count"))
    mobile = lambda k: F.struct(F.lit("x").alias("id"), F.lit("").alias("description"), F.lit("").alias("help_url"), F.lit(1).cast("long").alias("node_count"))
    rows = rows.withColumns({
        "redirect_chain": chain, "redirect_url": F.when(c("hops") > 0, c("url")), "html_size_bytes": F.when(c("status").isNotNull(), c("size")).otherwise(0).cast("long"),
        "h1_count": c("h1").isNotNull().cast("long"), "title_length": F.coalesce(F.char_length("title"), F.lit(0)).cast("long"),
        "meta_description_length": F.coalesce(F.char_length("meta_description"), F.lit(0)).cast("long"), "content_type": F.lit("text/html"),
        "h2_values": F.array_repeat("h2", c("h2_count").cast("int")), "heading_levels": F.when(c("outline") != "", F.split("outline", ",").cast("array<int>")),
        "content_simhash": F.lpad(F.lower(F.hex("fp")), 16, "0"), "security_headers_captured": c("captured_headers"), "raw": F.when(c("has_raw"), raw),
        "accessibility_violations": F.when(c("n_axe") > 0, F.transform(F.sequence(F.lit(1), c("n_axe")), found)), "mobile_usability_violations": F.when(c("n_mobile") > 0, F.transform(F.sequence(F.lit(1), c("n_mobile")), mobile)),
        "structured_data_errors": F.when(c("has_data_error"), one(F.lit("bad"), "array<string>")), "structured_data_types": F.when(c("has_data_type"), one(F.lit("Article"), "array<string>")),
    })
    if not arrays:
        return complete(rows)
    links = sim_links(spark, sf_dir).groupBy(c("source").alias("l_source")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "target", "anchor", "nofollow"))), lambda x: F.struct(
        x["target"].alias("url"), x["anchor"].alias("anchor"), x["nofollow"].alias("nofollow"), F.lit(False).alias("is_image_link"))).alias("outlinks"))
    hreflang = sim_hreflang(spark, sf_dir).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("lang", "href"))).alias("hreflang_links"))
    rows = rows.join(hreflang, rows["url"] == hreflang["source"], "left").join(links, rows["url"] == links["l_source"], "left")
    return complete(rows.withColumn("hreflang_values", F.transform("hreflang_links", lambda x: x["lang"])))


def _exploded(spark, sf_dir, cols, top: int, where: str) -> DataFrame:
    rows = _base(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(top)))).where(where)
    return rows.select(*[F.expr(e).alias(c) for c, e in cols.items()])


def sim_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, LINKS, 11, "k <= 10 OR n % 10 = 0")


def sim_hreflang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, HREFLANG, 3, "n % 5 = 2 OR (n % 5 = 4 AND k = 1)")


def sim_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(_base(spark, sf_dir).select(*[F.expr(e).alias(c) for c, e in RESOURCES.items()]), RESOURCE)

"""Sinks: the CSV documents of pages, resources, links and issues, JSON snapshots and their reader, table backups."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import PAGE, RESOURCE, complete

BOM, CRLF = "﻿", "\r\n"


def safe_cell(c: Column, also_blank: bool = True) -> Column:
    """A leading = + - @, or TAB or CR if also_blank, would start a formula: such a cell gets an apostrophe in front."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]" if also_blank else "^[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_field(c: Column) -> Column:
    """A field of the issue documents: always quoted, quotes doubled, formulas neutralised."""
    return F.concat(F.lit('"'), F.replace(safe_cell(F.coalesce(c.cast("string"), F.lit("")), False), F.lit('"'), F.lit('""')), F.lit('"'))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _joined(name: str, sep: str) -> Column:
    return F.array_join(F.col(name).cast("array<string>"), sep)


def _number(name: str, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.col(name))


#: Headers of the pages document with their columns, in order. Fixed values (headers and separators).
PAGE_COLUMNS = [
    ("URL", "url"), ("Status", "status"), ("Status Text", "status_text"), ("Indexability", "indexability"), ("Depth", "depth"), ("Title", "title"), ("Title Length", "title_length"),
    ("Meta Description", "meta_description"), ("Meta Description Length", "meta_description_length"), ("H1", "h1"), ("H1 Count", "h1_count"), ("H1 Values", ("h1_values", " | ")),
    ("H2 Values", ("h2_values", " | ")), ("H2 Count", "h2_count"), ("Heading Levels", lambda: F.array_join(F.transform("heading_levels", lambda x: F.concat(F.lit("H"), x.cast("string"))), " > ")),
    ("Title Count", "title_count"), ("Meta Description Count", "meta_description_count"), ("Meta Refresh", "meta_refresh"), ("Pagination Next", "pagination_next"), ("Pagination Prev", "pagination_prev"),
    ("Word Count", "word_count"), ("Canonical", "canonical"), ("Meta Robots", "meta_robots"), ("Redirect URL", "redirect_url"), ("Content Type", "content_type"), ("Response Time (ms)", "response_time_ms"),
    ("Internal Links", "internal_link_count"), ("External Links", "external_link_count"), ("Images", "image_count"), ("Size (bytes)", "html_size_bytes"), ("Minified", "is_minified"),
    ("Minify Savings (%)", lambda: _number("minify_savings_pct", 0)), ("JS Rendered", "rendered"), ("HSTS", "hsts"), ("Content-Security-Policy", "content_security_policy"), ("X-Frame-Options", "x_frame_options"),
    ("X-Content-Type-Options", "x_content_type_options"), ("Referrer-Policy", "referrer_policy"), ("Mixed Content", "mixed_content_count"), ("Insecure Links", "insecure_link_count"),
    ("Missing Alt Images", "missing_alt_count"), ("Images Missing Dimensions", "images_missing_dimensions"), ("Lang", "lang"), ("Hreflang Values", ("hreflang_values", ", ")),
    ("Hreflang Links", lambda: F.array_join(F.transform("hreflang_links", lambda x: F.concat_ws(" ", x["lang"], x["href"])), ", ")), ("Internal Nofollow Links", "internal_nofollow_count"),
    ("Text/HTML Ratio (%)", lambda: _number("text_ratio_pct", 1)), ("Content Hash", "content_hash"), ("Content Simhash", "content_simhash"), ("X-Robots-Tag", "x_robots_tag"), ("Viewport", "viewport"),
    ("Has Open Graph", "has_open_graph"), ("Has Twitter Card", "has_twitter_card"), ("Canonical Count", "canonical_count"), ("Canonical Is Relative", "canonical_is_relative"),
    ("Unsafe Cross-Origin Links", "unsafe_cross_origin_links"), ("Lorem Ipsum", "has_lorem_ipsum"), ("Discovered Via Sitemap", "discovered_via_sitemap"), ("Redirect Chain", ("redirect_chain", " -> ")),
    ("Structured Data Types", ("structured_data_types", ", ")), ("Structured Data Errors", ("structured_data_errors", "; ")), ("Accessibility Violations", lambda: F.size("accessibility_violations").cast("string")),
    ("Mobile Usability Violations", lambda: F.size("mobile_usability_violations").cast("string")), ("Error", "error"),
]
RESOURCE_COLUMNS = [
    ("URL", "url"), ("Type", lambda: F.initcap("resource_type")), ("Source Page", "source_page"), ("Status", "status"), ("Status Text", "status_text"), ("Internal", "is_internal"), ("Alt Text", "alt_text"),
    ("Insecure", "is_insecure"), ("Size (bytes)", "content_length"), ("Error", "error"),
]


def _cell(what) -> Column:
    return what() if callable(what) else _joined(*what) if isinstance(what, tuple) else _text(what)


def ids_in_page_order(pages: DataFrame, column: str) -> list[str]:
    """Rule ids that any page has, by the first page that has them, shorter ids first; a rule list has few."""
    rows = pages.select("seq", F.explode(F.map_keys(column)).alias("id")).groupBy("id").agg(F.min("seq").alias("seq"))
    return [r.id for r in rows.orderBy("seq", F.length("id"), "id").collect()]


def custom_columns(pages: DataFrame, column: str, prefix: str, rules: list, second: str) -> list[tuple[str, str]]:
    """(id, header) of a custom column per rule that ran: the rules' own order first; a header used before gets (2), (3)."""
    found, out, used = ids_in_page_order(pages, column), [], set()
    labels = {r.id: next((x.strip() for x in (r.name, getattr(r, second)) if x.strip()), r.id) for r in reversed(rules)}
    for key in [*dict.fromkeys(r.id for r in rules if r.id in found), *[i for i in found if i not in labels]]:
        base = header = f"{prefix}: {labels.get(key, key)}"
        n = 1
        while header in used and prefix == "Extraction":
            n += 1
            header = f"{base} ({n})"
        used.add(header)
        out.append((key, header))
    return out


def pages_table(pages: DataFrame, searches: list = (), extractions: list = ()) -> DataFrame:
    """The pages document's cells, all of them safe strings; custom columns are blank where a rule never ran."""
    cells = [(h, _cell(w)) for h, w in PAGE_COLUMNS]
    cells += [(h, F.coalesce(F.try_element_at("custom_search_counts", F.lit(k)).cast("string"), F.lit(""))) for k, h in custom_columns(pages, "custom_search_counts", "Custom Search", list(searches), "pattern")]
    cells += [(h, F.coalesce(F.array_join(F.try_element_at("extracted", F.lit(k)), " | "), F.lit(""))) for k, h in custom_columns(pages, "extracted", "Extraction", list(extractions), "selector")]
    return pages.select(*[safe_cell(c).alias(h) for h, c in cells])


def resources_table(resources: DataFrame) -> DataFrame:
    return resources.select(*[safe_cell(_cell(w)).alias(h) for h, w in RESOURCE_COLUMNS])


def links_table(pages: DataFrame) -> DataFrame:
    """A row per outlink, repeated ones too."""
    rows = pages.select(F.col("url").alias("Source"), F.explode("outlinks").alias("o"))
    return rows.select(*[safe_cell(c.cast("string")).alias(h) for h, c in (("Source", F.col("Source")), ("Target", F.col("o.url")), ("Anchor", F.col("o.anchor")), ("Nofollow", F.col("o.nofollow")))])


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with a header each; df: a table of cells."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def issues_table(found: DataFrame, registry: DataFrame, places: DataFrame) -> DataFrame:
    """scope_pos, seq, pos and the cells of the issues document, a row per URL and issue: pages, then resources, in registry order."""
    rows = found.join(registry, ["issue_key", "scope"]).join(places, ["url", "scope"])
    return rows.select(F.when(F.col("scope") == "page", 0).otherwise(1).alias("scope_pos"), "seq", "pos", F.col("url").alias("URL"), F.col("issue_key").alias("Issue Key"), F.col("label").alias("Issue"),
                       F.col("severity").alias("Severity"), F.col("issue_group").alias("Group"))


def summary_table(summary: DataFrame) -> DataFrame:
    return summary.select("pos", F.col("issue_key").alias("Issue Key"), F.col("label").alias("Issue"), F.col("severity").alias("Severity"), F.col("issue_group").alias("Group"), F.col("n").alias("Count"))


def csv_lines(df: DataFrame, columns: list[str]) -> Column:
    """A row's line of a quoted document."""
    return F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in columns])


def write_document(df: DataFrame, order: list[str], columns: list[str], path: str) -> None:
    """Ordered text part files: a byte order mark and the header in the first, each line ended by CRLF."""
    head = BOM + ",".join(f'"{c}"' for c in columns)
    first = df.sparkSession.createDataFrame([(-1, head)], "part int, value string")
    lines = df.orderBy(*order).select(csv_lines(df, columns).alias("value")).withColumn("part", F.spark_partition_id())
    # Ranged by the place of the sorted partitions, so that part files follow each other in the document's order.
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    every = first.withColumn("at", F.lit(-1).cast("long")).select("at", "value").unionByName(lines.select("at", "value"))
    every.orderBy("at").select("value").write.mode("overwrite").option("lineSep", CRLF).text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One plain text file through the cluster's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_snapshot(pages: DataFrame, resources: DataFrame, path: str) -> None:
    """Two folders of JSON lines; the committer makes each appear whole or not at all."""
    pages.write.mode("overwrite").option("compression", "gzip").json(f"{path}/pages")
    resources.write.mode("overwrite").option("compression", "gzip").json(f"{path}/resources")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Older snapshots lack fields: those get their unknown values. Resources whose check was still running have none."""
    return complete(spark.read.schema(PAGE).json(f"{path}/pages")), complete(spark.read.schema(RESOURCE).json(f"{path}/resources"), RESOURCE)


def checked_count(resources: DataFrame) -> DataFrame:
    """Resources whose check had ended when a snapshot was taken."""
    return resources.where("status_text <> 'Checking'").agg(F.count("*").alias("checked"))


def backup(table: DataFrame, path: str, name: str, now: datetime.datetime) -> str:
    """A full table as gzipped JSON rows in a folder of its name and time; the folder."""
    out = f"{path}/{name}/{now:%Y-%m-%dT%H-%M-%SZ}"
    table.write.mode("overwrite").option("compression", "gzip").json(out)
    return out


def expired(backups: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """Backups (path, taken) older than the retention time."""
    return backups.where(F.col("taken") < now - F.make_dt_interval(F.lit(keep_days)))


"""The relational surface of a blog, a forum and their operation: queries over posts, comments, votes, users and backups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(posts: DataFrame, key: str, value) -> DataFrame:
    return posts.where(F.col(key) == F.lit(value))


def by_author(posts: DataFrame, author: Column, published: Column, order: list) -> DataFrame:
    return posts.where(published & author).orderBy(*order)


def categories_with_counts(categories: DataFrame, posts: DataFrame, name: str, category: str) -> DataFrame:
    """name, post_count of every category, 0 for one without posts."""
    counts = posts.groupBy(F.col(category).alias(name)).agg(F.count("*").alias("k"))
    return categories.join(counts, name, "left").select(name, F.coalesce("k", F.lit(0)).alias("post_count"))


def linkable(posts: DataFrame, columns: list[str], published: Column) -> DataFrame:
    return posts.where(published).select(*columns)


def pending_count(comments: DataFrame, pending: Column) -> DataFrame:
    return comments.agg(F.count_if(pending).alias("pending"))


def page_of(rows: DataFrame, wanted: Column, order: list, page: int, size: int) -> DataFrame:
    """One page of a list with `total`, the number of all rows, and `page`, the page shown: an asked one is moved into what there is."""
    kept = rows.where(wanted)
    total = kept.count()
    shown = min(max(page, 1), max(1, -(-total // size)))
    return kept.orderBy(*order).offset((shown - 1) * size).limit(size).withColumns({"total": F.lit(total).cast("long"), "page": F.lit(shown)})


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table after inserts and updates: a changed row takes the place of the one with its key."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def deleted(table: DataFrame, gone: Column) -> DataFrame:
    return table.where(~F.coalesce(gone, F.lit(False)))


def counted_views(posts: DataFrame, views: DataFrame, key: str, counter: str) -> DataFrame:
    """posts with a view added per row of views."""
    more = views.groupBy(key).agg(F.count("*").alias("__more"))
    return posts.join(more, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("__more", F.lit(0))).drop("__more")


def pruned_attempts(attempts: DataFrame, ts: str, now: Column, seconds: int) -> DataFrame:
    """Attempts that a lockout may still count."""
    return attempts.where(F.unix_micros(F.col(ts).cast("timestamp")) >= F.unix_micros(now) - seconds * 1_000_000)


def may_remove_admin(users: DataFrame, is_admin: Column) -> DataFrame:
    """One row: admins, allowed; the last admin may not go."""
    return users.agg(F.count_if(is_admin).alias("admins")).withColumn("allowed", F.col("admins") > 1)


def top(rows: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(value), *ties).limit(n)


def category_chart(posts: DataFrame, category: str, published: Column, n: int = 8) -> DataFrame:
    """The n largest categories of published posts; a blank one is Uncategorized."""
    name = F.coalesce(F.nullif(F.btrim(F.col(category)), F.lit("")), F.lit("Uncategorized"))
    return top(posts.where(published).groupBy(name.alias("category")).agg(F.count("*").alias("n")), "n", n, "category")


def status_share(posts: DataFrame, published: Column) -> DataFrame:
    """published, drafts and the share of published in percent."""
    rows = posts.agg(F.count_if(published).alias("published"), F.count("*").alias("total"))
    return rows.select("published", (F.col("total") - F.col("published")).alias("drafts"), (100.0 * F.col("published") / F.greatest(F.col("total"), F.lit(1))).alias("percent"))


def referenced_media(media: DataFrame, posts: DataFrame, key: str, content: str) -> DataFrame:
    """key, used: whether any post's content names the key as a whole media path; by an exact join on the paths found."""
    named = posts.select(F.explode(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit("/media/([A-Za-z0-9-]+\\.[A-Za-z0-9]+)"), F.lit(1))).alias(key)).distinct().withColumn("__used", F.lit(True))
    return media.join(named, key, "left").select(key, F.coalesce("__used", F.lit(False)).alias("used"))


def blog_sitemap(site: str, posts: DataFrame, authors: DataFrame) -> DataFrame:
    """url, change_frequency, priority: the home page, posts (path) and distinct authors (name)."""
    home = posts.sparkSession.createDataFrame([(site, "daily", 1.0)], "url string, change_frequency string, priority double")
    p = posts.select(F.concat(F.lit(site), F.col("path")).alias("url"), F.lit("monthly").alias("change_frequency"), F.lit(0.7).alias("priority"))
    a = authors.select("name").distinct().select(F.concat(F.lit(f"{site}/author/"), F.col("name")).alias("url"), F.lit("weekly").alias("change_frequency"), F.lit(0.4).alias("priority"))
    return reduce(DataFrame.unionByName, (home, p, a))


#: What a draft has to keep to: field and its least and most characters, words of the content, links. Fixed values.
DRAFT_LENGTHS = {"title": (40, 70), "excerpt": (140, 180), "meta_title": (30, 60), "meta_description": (140, 155)}
DRAFT_WORDS, DRAFT_TAKEAWAYS, DRAFT_FAQS, DRAFT_INTERNAL, DRAFT_EXTERNAL = (1300, 2400), 5, (3, 5), (3, 7), (2, 5)


def draft_errors(drafts: DataFrame, site: str, banned: list[str] = (), allowed_tags: list[str] = ()) -> DataFrame:
    """drafts (title, excerpt, meta_title, meta_description, content_html, takeaways, faqs) with errors, an array of what they break."""
    c = F.col
    out_of = lambda n, low, high: (n < low) | (n > high)
    html = F.coalesce("content_html", F.lit(""))
    plain = F.lower(F.regexp_replace(F.concat_ws(" ", *DRAFT_LENGTHS, html), "<[^>]+>", " "))
    words = F.size(F.filter(F.split(F.regexp_replace(html, "<[^>]+>", ""), "\\s+"), lambda w: w != ""))
    tags = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit("<([a-zA-Z0-9]+)"), F.lit(1)), F.lower))
    links = F.regexp_extract_all(html, F.lit("<a\\s[^>]*>"), F.lit(0))
    hrefs = F.transform(links, lambda x: F.regexp_extract(x, 'href="([^"]*)"', 1))
    internal = F.size(F.filter(hrefs, lambda h: h.startswith(site)))
    external = F.size(F.filter(hrefs, lambda h: h.startswith("http") & ~h.startswith(site)))
    bare = F.exists(links, lambda x: F.regexp_extract(x, 'href="([^"]*)"', 1).startswith("http") & ~F.regexp_extract(x, 'href="([^"]*)"', 1).startswith(site)
                    & ~(x.contains('target="_blank"') & x.contains('rel="noopener noreferrer"')))
    tests = {f"{k} length": out_of(F.char_length(F.coalesce(c(k), F.lit(""))), *b) for k, b in DRAFT_LENGTHS.items()}
    tests |= {
        "pipe in title": F.coalesce(c("title").contains("|"), F.lit(False)) | F.coalesce(c("meta_title").contains("|"), F.lit(False)),
        "takeaways": F.size("takeaways") != DRAFT_TAKEAWAYS, "faqs": out_of(F.size("faqs"), *DRAFT_FAQS), "dash": F.concat_ws(" ", *DRAFT_LENGTHS, html).rlike("[–—]"),
        "placeholder": plain.contains("[editor") | plain.contains("[insert"), "word count": out_of(words, *DRAFT_WORDS), "attribute": html.rlike("<\\w+[^>]*\\s(class|style|id)="),
        "heading link": html.rlike("(?s)<h[1-6][^>]*>(?:(?!</h[1-6]>).)*<a\\s"), "internal links": out_of(internal, *DRAFT_INTERNAL), "external links": out_of(external, *DRAFT_EXTERNAL), "external target": bare}
    if allowed_tags:
        tests["tags"] = F.size(F.array_except(tags, F.array(*[F.lit(t) for t in allowed_tags]))) > 0
    tests |= {f"banned: {b}": plain.contains(b.lower()) for b in banned}
    return drafts.withColumn("errors", F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])))

"""Queries over posts, comments, users and their operation, played by orders, customers and events."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import posts, urls
from ..operators import search
from ..sources import export
from . import relational
from .catalogue import _t, query
from .tables import new_path


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def post_lookup(spark, sf_dir):
    return relational.by_id(_t(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_custkey = (SELECT min(o_custkey) FROM orders)")
def posts_by_author(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    author = orders.agg(F.min("o_custkey")).first()[0]
    return relational.by_author(orders, F.col("o_custkey") == F.lit(author), F.col("o_orderstatus") == "O", [F.desc("o_orderdate"), "o_orderkey"]).select("o_orderkey", "o_orderdate")


@query("SELECT n_nationkey, count(c_custkey) AS post_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey")
def categories_with_counts(spark, sf_dir):
    return relational.categories_with_counts(_t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer").where("c_acctbal > 9000"), "n_nationkey", "c_nationkey")


@query("SELECT c_name, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def linkable_posts(spark, sf_dir):
    return relational.linkable(_t(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], F.col("c_acctbal") > 5000)


@query("SELECT count(*) AS pending FROM orders WHERE o_orderstatus = 'P'")
def pending_count(spark, sf_dir):
    return relational.pending_count(_t(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P")


@query("WITH k AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey, c_name, (SELECT count(*) FROM k) AS total, CAST(greatest(1, ceil((SELECT count(*) FROM k) / 20.0)) AS INT) AS page FROM k "
       "ORDER BY c_custkey OFFSET (SELECT CAST((greatest(1, ceil(count(*) / 20.0)) - 1) * 20 AS BIGINT) FROM k)")
def last_page(spark, sf_dir):
    rows = relational.page_of(_t(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING", ["c_custkey"], 10**6, 20)
    return rows.select("c_custkey", "c_name", "total", "page")


@query("WITH t AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, t WHERE epoch_us(ts) >= epoch_us(now) - 900000000")
def kept_attempts(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return relational.pruned_attempts(events, "ts", F.lit(now).cast("timestamp"), 900).select("event_id")


@query("SELECT event_id, recent FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent >= 3")
def comment_limit(spark, sf_dir):
    return search.sliding_limit(_t(spark, sf_dir, "events"), "event_type", "ts", 600, 3).select("event_id", "recent")


@query("SELECT count(*) AS admins, count(*) > 1 AS allowed FROM supplier WHERE s_nationkey = 3")
def admin_guard(spark, sf_dir):
    return relational.may_remove_admin(_t(spark, sf_dir, "supplier"), F.col("s_nationkey") == 3)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 6")
def top_views(spark, sf_dir):
    return relational.top(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 6, "c_custkey")


@query("SELECT CASE WHEN p_size % 7 = 0 THEN 'Uncategorized' ELSE p_brand END AS category, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY n DESC, category LIMIT 8")
def category_chart(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").withColumn("category", F.when(F.col("p_size") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_brand"))))
    return relational.category_chart(parts, "category", F.col("p_size") > 10)


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS published, count(*) FILTER (o_orderstatus <> 'F') AS drafts, 100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / greatest(count(*), 1) AS percent FROM orders")
def status_share(spark, sf_dir):
    return relational.status_share(_t(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'renamed' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'new') WHERE c_custkey % 10 <> 4")
def upsert_and_delete(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")
    changes = table.where("c_custkey % 10 = 3").withColumn("c_name", F.lit("renamed")).unionByName(spark.createDataFrame([(-1, "new")], "c_custkey long, c_name string"))
    return relational.deleted(relational.upserted(table, changes, "c_custkey"), F.col("c_custkey") % 10 == 4)


@query("SELECT c_custkey, c_nationkey + count(o_orderkey) AS views FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey")
def counted_views(spark, sf_dir):
    posts = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("views"))
    return relational.counted_views(posts, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "views")


_CONTENT = "concat('<img src=\"/media/f', CAST(o_orderkey % 50 AS {0}), '.png\"> and /media/g-', CAST(o_custkey % 30 AS {0}), '.jpg')"


@query("SELECT 'f' || CAST(i AS VARCHAR) || '.png' AS key, EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 50 = i AND o_orderkey % 3 = 0) AS used FROM range(0, 100) r(i)")
def media_usage(spark, sf_dir):
    media = spark.range(100).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".png")).alias("key"))
    posts = _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.expr(_CONTENT.format("STRING")).alias("content"))
    return relational.referenced_media(media, posts, "key", "content")


@query("SELECT 'https://blog.example' AS url, 'daily' AS change_frequency, 1.0::DOUBLE AS priority UNION ALL SELECT 'https://blog.example/p' || CAST(o_orderkey AS VARCHAR), 'monthly', 0.7 FROM orders WHERE o_orderstatus = 'O' UNION ALL "
       "SELECT DISTINCT 'https://blog.example/author/' || c_mktsegment, 'weekly', 0.4 FROM customer")
def blog_sitemap(spark, sf_dir):
    posts = _t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("/p"), F.col("o_orderkey").cast("string")).alias("path"))
    return relational.blog_sitemap("https://blog.example", posts, _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def backup_round_trip(spark, sf_dir):
    table = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    folder = export.backup(table, new_path(spark, "backup"), "nation", datetime.datetime(2026, 1, 2, 3, 4, 5))
    return spark.read.schema(table.schema).json(folder)


@query("WITH b AS (SELECT event_id, ts, (SELECT max(ts) FROM events) AS now FROM events) SELECT event_id FROM b WHERE ts < now - INTERVAL 2 DAY")
def expired_backups(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("taken"))
    now = events.agg(F.max("taken").alias("now"))
    return export.expired(events.crossJoin(F.broadcast(now)), F.col("now"), 2).select("event_id")


_DRAFT = {
    "title": "concat('A title ', repeat('x', {n} % 70), CASE WHEN {n} % 9 = 0 THEN '|' ELSE '' END)", "excerpt": "repeat('e', 130 + {n} % 60)", "meta_title": "repeat('m', 25 + {n} % 40)", "meta_description": "repeat('d', 135 + {n} % 25)",
    "content_html": "concat(CASE WHEN {n} % 4 = 0 THEN '<h2 class=\"x\">T</h2>' ELSE '<h2>T</h2>' END, repeat('<p>word word </p>', 600 + {n} % 900), repeat('<a href=\"https://site.example/a\">in</a> ', {n} % 9), "
                    "repeat(CASE WHEN {n} % 5 = 0 THEN '<a href=\"https://other.example/\">out</a> ' ELSE '<a href=\"https://other.example/\" target=\"_blank\" rel=\"noopener noreferrer\">out</a> ' END, {n} % 7), CASE WHEN {n} % 11 = 0 THEN ' cutting-Edge' ELSE '' END)",
}


@query("WITH d AS (SELECT page_id AS n, " + ", ".join(f"{e.format(n='page_id')} AS {k}" for k, e in _DRAFT.items()) + " FROM pages), e AS (SELECT n, unnest(list_filter(["
       "CASE WHEN length(title) NOT BETWEEN 40 AND 70 THEN 'title length' END, CASE WHEN length(excerpt) NOT BETWEEN 140 AND 180 THEN 'excerpt length' END, CASE WHEN length(meta_title) NOT BETWEEN 30 AND 60 THEN 'meta_title length' END, "
       "CASE WHEN length(meta_description) NOT BETWEEN 140 AND 155 THEN 'meta_description length' END, CASE WHEN contains(title, '|') THEN 'pipe in title' END, CASE WHEN n % 3 <> 0 THEN 'takeaways' END, CASE WHEN n % 8 NOT BETWEEN 3 AND 5 THEN 'faqs' END, "
       "CASE WHEN len(regexp_extract_all(content_html, 'word')) + n % 9 + n % 7 + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END NOT BETWEEN 1300 AND 2400 THEN 'word count' END, CASE WHEN n % 4 = 0 THEN 'attribute' END, "
       "CASE WHEN n % 9 NOT BETWEEN 3 AND 7 THEN 'internal links' END, CASE WHEN n % 7 NOT BETWEEN 2 AND 5 THEN 'external links' END, CASE WHEN n % 5 = 0 AND n % 7 > 0 THEN 'external target' END, CASE WHEN n % 11 = 0 THEN 'banned: cutting-edge' END], lambda x: x IS NOT NULL)) AS error FROM d) "
       "SELECT n, error FROM e")
def draft_errors(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), *[F.expr(e.format(n="page_id")).alias(k) for k, e in _DRAFT.items()])
    some = lambda k: F.transform(F.sequence(F.lit(0), k), lambda i: F.lit("x"))
    rows = rows.withColumns({"takeaways": some(F.when(F.col("n") % 3 == 0, 4).otherwise(2)), "faqs": F.slice(some(F.lit(8)), 1, (F.col("n") % 8).cast("int"))})
    found = relational.draft_errors(rows, "https://site.example", ["cutting-edge"], ["h2", "p", "a"])
    return found.select("n", F.explode("errors").alias("error"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a|b' || CAST(o_custkey AS VARCHAR) ELSE '' END AS points, CASE o_orderkey % 5 WHEN 0 THEN 'q?=yes' ELSE '' END AS faqs FROM orders")
def post_sections(spark, sf_dir):
    orders, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    json = F.when(k == 0, F.concat(F.lit('[" a ", "", 7, "b'), F.col("o_custkey").cast("string"), F.lit('", null]'))).when(k == 1, '{"a": 1}').when(k == 2, "[broken").when(k == 3, "")
    faq = F.when(k == 0, '[{"question": "q? ", "answer": "yes"}, {"question": "q"}, {"question": " ", "answer": "x"}, {"question": 1, "answer": "x"}, "s"]').when(k == 1, "null").when(k == 2, "{")
    rows = orders.select("o_orderkey", posts.takeaways(json).alias("t"), posts.faqs(faq).alias("f"))
    return rows.select("o_orderkey", F.array_join("t", "|").alias("points"), F.array_join(F.transform("f", lambda x: F.concat_ws("=", x["question"], x["answer"])), "|").alias("faqs"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages WHERE regexp_matches(url, '^https?://')")
def normal_urls(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.col("url").alias("raw"))
    return urls.normalised(rows, "raw", "url").where("url IS NOT NULL").select("page_id", "url")


@query("SELECT page_id, shown FROM (SELECT page_id, 'https://x/é/' || CAST(page_id AS VARCHAR) || '%2F%23' AS shown FROM pages)")
def displayed_urls(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://x/%C3%A9/"), F.col("page_id").cast("string"), F.lit("%2F%23")).alias("url"))
    return urls.displayed(rows, "url", "shown").select("page_id", "shown")

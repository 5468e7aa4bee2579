"""Named queries over the tables, each with the SQL that DuckDB checks it against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import posts, text, urls
from ..operators import comments, compare, graph, issues, near_duplicates, search
from ..sources import simweb, web
from ..sources.corpus import corpus_pages, corpus_urls, parsed_pages
from ..sources.schema import complete
from ..sources.web import robots_allowed
from .tables import keep

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pages: signals and rules that SQL can derive with regular expressions -----------------------------------------

_FIRST = "p AS (SELECT * FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, html, row_number() OVER (PARTITION BY regexp_replace(url, '#.*$', '') ORDER BY page_id) AS rn FROM pages) WHERE rn = 1)"
_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&amp;', '&', 'g'), '&quot;', '\"', 'g'), '&copy;', '©', 'g'), '&middot;', '·', 'g')"
_TITLE = "trim(" + _TEXT.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ")"


#: Visible text: without comments and inline tags, a space for every other tag, entities decoded.
_BODIES = (f"{_FIRST}, bodies AS (SELECT page_id AS doc_id, " + _TEXT.format("regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)(<body>.*)', 1), '(?s)<!--.*?-->', '', 'g'), '</?(?:a|b|html)(?:\\s[^>]*)?>', '', 'g'), '<[^>]+>', ' ', 'g')") + " AS text FROM p)")
_WORDS = "list_filter(string_split_regex(text, '\\s+'), x -> x <> '')".replace("x -> x", "lambda x: x")


@query(f"WITH {_FIRST}, t AS (SELECT page_id, {_TITLE} AS title FROM p) SELECT page_id AS seq, title FROM t WHERE title <> '' AND title IN (SELECT title FROM t GROUP BY title HAVING count(*) > 1)")
def duplicate_titles(spark, sf_dir):
    pages = corpus_pages(spark, sf_dir, "title").where("title IS NOT NULL").select("seq", "title")
    return pages.join(pages.groupBy("title").agg(F.count("*").alias("k")).where("k > 1").select("title"), "title", "left_semi")


@query(f"WITH {_FIRST}, t AS (SELECT length({_TITLE}) AS n FROM p) SELECT (n // 10) * 10 AS bucket, count(*) AS pages FROM t GROUP BY 1")
def title_length_buckets(spark, sf_dir):
    return corpus_pages(spark, sf_dir, "title_length").groupBy((F.floor(F.col("title_length") / 10) * 10).cast("long").alias("bucket")).agg(F.count("*").alias("pages"))


@query(f"WITH {_FIRST}, h AS (SELECT page_id, regexp_extract_all(html, '(?i)<h([1-6])[\\s>]', 1) AS v FROM p) SELECT page_id AS seq, array_to_string(v[1:200], ',') AS levels, CAST(len(list_filter(v, lambda x: x = '1')) AS BIGINT) AS h1_count, CAST(len(list_filter(v, lambda x: x = '2')) AS BIGINT) AS h2_count FROM h")
def heading_outline(spark, sf_dir):
    return corpus_pages(spark, sf_dir, "heading_levels", "h1_count", "h2_count").select("seq", F.array_join(F.col("heading_levels").cast("array<string>"), ",").alias("levels"), "h1_count", "h2_count")


#: The pages have one heading each: more of them by the page's number.
_MORE_HEADINGS = "concat(html, CASE page_id % 3 WHEN 0 THEN '<h3>x</h3>' WHEN 1 THEN '<h2>y</h2><h3>z</h3><h5>w</h5>' ELSE '<h2 class=\"a\">Part &amp; <b>two</b></h2><h3>Part</h3><h3> </h3>' END)"


@query(f"WITH {_FIRST}, h AS (SELECT page_id, list_transform(regexp_extract_all({_MORE_HEADINGS}, '(?i)<h([1-6])[\\s>]', 1), lambda x: CAST(x AS INT)) AS v FROM p) SELECT page_id AS seq FROM h WHERE len(list_filter(range(2, len(v) + 1), lambda i: v[i] - v[i-1] > 1)) > 0")
def heading_skips(spark, sf_dir):
    kept = corpus_urls(spark, sf_dir).select(F.col("seq").alias("page_id"))
    raw = _t(spark, sf_dir, "pages").select("page_id", F.col("url").alias("raw"), F.expr(_MORE_HEADINGS).alias("html")).join(kept, "page_id", "left_semi")
    return issues.evaluated(parsed_pages(raw, "heading_levels"), keys=("nonSequentialHeadings",)).where(F.size("issues") > 0).select("seq")


@query(f"WITH {_FIRST} SELECT page_id AS seq, strlen(html) AS html_size_bytes, floor((1 - strlen(trim(regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\\z)', '', 'g'), '\\s+', ' ', 'g')))::DOUBLE / strlen(html)) * 1000 + 0.5) / 10 AS saved_pct FROM p")
def html_size_and_minify(spark, sf_dir):
    return corpus_pages(spark, sf_dir, "html_size_bytes", "minify_savings_pct").select("seq", "html_size_bytes", (F.floor(F.col("minify_savings_pct") * 10 + 0.5) / 10).alias("saved_pct"))


@query(f"WITH {_BODIES}, w AS (SELECT doc_id AS seq, CAST(len({_WORDS}) AS BIGINT) AS word_count FROM bodies) SELECT * FROM w WHERE word_count < 200")
def word_count_audit(spark, sf_dir):
    return corpus_pages(spark, sf_dir, "word_count").where("word_count < 200").select("seq", "word_count")


_PATH = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END"
_QUERY = "CASE WHEN regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) END"
_URL_RULES = {
    "urlUppercase": "regexp_matches(regexp_replace(pq, '%[0-9A-Fa-f]{2}', '', 'g'), '[A-Z]')", "urlUnderscores": "contains(pq, '_')", "urlParameters": "q <> ''",
    "urlOver115": "length(url) > 115", "urlNonAscii": "regexp_matches(pq, '%[89A-Fa-f][0-9A-Fa-f]')", "urlMultipleSlashes": "contains(path, '//')",
    "urlRepetitivePath": "len(segs) <> len(list_distinct(segs))", "urlContainsSpace": "regexp_matches(pq, '%20| ')",
    "urlGaTracking": "len(list_filter(string_split(substr(q, 2), '&'), lambda x: regexp_matches(string_split(x, '=')[1], '(?i)^(?:utm_.+|_ga|_gl|gclid)$'))) > 0",
    "urlInternalSearch": "q <> '' AND regexp_matches(pq, '(?i)search')",
}


@query(f"WITH {_FIRST}, u AS (SELECT page_id, url, {_PATH} AS path, {_QUERY} AS q FROM p), v AS (SELECT *, path || q AS pq, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM u) "
       + " UNION ALL ".join(f"SELECT page_id AS seq, '{k}' AS issue_key FROM v WHERE {t}" for k, t in _URL_RULES.items()))
def url_audit(spark, sf_dir):
    return issues.exploded(issues.evaluated(corpus_urls(spark, sf_dir), keys=tuple(_URL_RULES)), "seq")


_WIDTH_MAP = "map([" + ", ".join(str(32 + i) for i in range(95)) + "], [" + ", ".join(f"{w}.0" for w in text.WIDTHS) + "])"


@query(f"WITH {_FIRST}, t AS (SELECT page_id, {_TITLE} AS title FROM p) SELECT page_id AS seq, CAST(floor(list_sum(list_transform(regexp_extract_all(title, '(?s).'), lambda c: coalesce({_WIDTH_MAP}[unicode(c)], {sum(text.WIDTHS)}.0 / 95))) * 20 / 1000 + 0.5) AS BIGINT) AS title_px FROM t")
def title_pixel_width(spark, sf_dir):
    return corpus_pages(spark, sf_dir, "title").select("seq", text.pixel_width(F.col("title"), 20).alias("title_px"))


@query(f"WITH {_FIRST}, h AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, strlen(html) AS n FROM p) SELECT host, count(*) AS pages, CAST(sum(n) AS BIGINT) AS bytes FROM h GROUP BY host")
def host_rollup(spark, sf_dir):
    return corpus_pages(spark, sf_dir, "html_size_bytes").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum("html_size_bytes").alias("bytes"))


@query(f"""WITH {_FIRST}, u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) AS site, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host,
  list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS segs FROM p), r AS (SELECT host, arg_min(site, page_id) AS root FROM u GROUP BY host),
  n AS (SELECT unnest(range(0, len(segs) + 1)) AS level, root, segs FROM u JOIN r USING (host))
  SELECT CASE WHEN level = 0 THEN root ELSE root || '/' || array_to_string(segs[1:level], '/') END AS node, level, count(*) AS total_pages FROM n GROUP BY ALL""")
def url_tree(spark, sf_dir):
    return graph.url_tree(corpus_urls(spark, sf_dir)).select("node", "level", "total_pages")


_HASH = f"CASE WHEN len({_WORDS}) = 0 THEN '' ELSE sha256(translate(array_to_string({_WORDS}, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END"


@query(f"""WITH {_BODIES}, t AS (SELECT p.*, text, nullif({_TITLE}, '') AS title, list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)(?:</h1>)', 1), lambda x: trim({_TEXT.format('x')})) AS h1s,
    regexp_extract_all(html, '(?s)<a href="([^"]*)">', 1) AS hrefs FROM p JOIN bodies ON doc_id = page_id)
  SELECT page_id AS seq, url, title, CAST(coalesce(length(title), 0) AS BIGINT) AS title_length, 1::BIGINT AS title_count, NULL::VARCHAR AS meta_description, 0::BIGINT AS meta_description_count,
    NULL::VARCHAR AS meta_robots, NULL::VARCHAR AS viewport, NULL::VARCHAR AS canonical, 0::BIGINT AS canonical_count, NULL::VARCHAR AS pagination_next, NULL::VARCHAR AS meta_refresh,
    nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang, array_to_string(h1s, '|') AS h1_values, CAST(len({_WORDS}) AS BIGINT) AS word_count, {_HASH} AS content_hash,
    contains(lower(text), 'lorem ipsum') AS has_lorem_ipsum, CAST(len(hrefs) AS BIGINT) AS internal_link_count, 0::BIGINT AS external_link_count, 0::BIGINT AS image_count, 0::BIGINT AS insecure_link_count,
    0::BIGINT AS mixed_content_count, CAST(len(list_filter(hrefs, lambda h: regexp_matches(h, 'zz'))) * 0 AS BIGINT) AS internal_nofollow_count, FALSE AS has_open_graph, FALSE AS has_twitter_card,
    '' AS structured_data_types, floor(strlen(text) * 1000.0::DOUBLE / strlen(html) + 0.5) / 10 AS text_ratio, 'Indexable' AS indexability FROM t""".replace("CAST(len(list_filter(hrefs, lambda h: regexp_matches(h, 'zz'))) * 0 AS BIGINT)", "0::BIGINT"))
def page_signals(spark, sf_dir):
    joined = lambda c: F.array_join(c, "|").alias(c)
    # From whole bytes with one division, as ten times the rounded percentage may miss a half.
    size = F.col("html_size_bytes")
    ratio = F.when(size > 0, F.floor(F.round(F.col("text_ratio_pct") * size / 100) * 1000 / size + 0.5) / 10).otherwise(0.0)
    return corpus_pages(spark, sf_dir).select(
        "seq", "url", "title", "title_length", "title_count", "meta_description", "meta_description_count", "meta_robots", "viewport", "canonical", "canonical_count", "pagination_next", "meta_refresh",
        "lang", joined("h1_values"), "word_count", "content_hash", "has_lorem_ipsum", "internal_link_count", "external_link_count", "image_count", "insecure_link_count", "mixed_content_count",
        "internal_nofollow_count", "has_open_graph", "has_twitter_card", joined("structured_data_types"), ratio.alias("text_ratio"), "indexability")


def _near(pages):
    return near_duplicates.clusters(near_duplicates.candidates(pages))


@query()
def issue_long(spark, sf_dir):
    # Kept, as the cross-page rules read the parsed pages many times.
    pages = keep(corpus_pages(spark, sf_dir), "pages")
    # Not graph.edges(): a link of a page to itself counts as a link to it here.
    links = pages.select(F.col("url").alias("source"), F.explode("outlinks").alias("o")).select("source", F.col("o.url").alias("target"))
    hreflang = pages.select(F.col("url").alias("source"), F.explode("hreflang_links").alias("h")).select("source", "h.lang", "h.href")
    flags = keep(issues.cross_flags(pages, links, hreflang, near=_near(pages)), "flags")
    return issues.issue_long(pages, flags).select("url", "issue_key")


_ENCODED = "url_encode({0})"
for _code, _char in (("2F", "/"), ("2C", ","), ("2A", "*"), ("24", "$"), ("26", "&"), ("3B", ";"), ("21", "!"), ("28", "("), ("29", ")"), ("2B", "+"), ("3A", ":"), ("3D", "="), ("40", "@"), ("25", "%")):
    _ENCODED = f"replace({_ENCODED}, '%{_code}', '{_char}')"
_LINKS = (f"{_FIRST}, a AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<a href=\"([^\"]*)\">(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?s)<a href=\"([^\"]*)\">(.*?)</a>', 2) AS texts FROM p), "
          f"o AS (SELECT page_id, url AS source, CAST(i - 1 AS INT) AS pos, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || {_ENCODED.format('regexp_replace(' + _TEXT.format('hrefs[i]') + ', ' + chr(39) + '#.*$' + chr(39) + ', ' + chr(39) * 2 + ')')} AS target, "
          f"trim(regexp_replace({_TEXT.format('texts[i]')}, '\\s+', ' ', 'g'))[1:200] AS anchor FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM a))")


@query(f"WITH {_LINKS} SELECT source, pos, target, anchor, FALSE AS nofollow, FALSE AS is_image_link FROM o WHERE source <> target")
def outlinks(spark, sf_dir):
    return graph.edges(corpus_pages(spark, sf_dir, "outlinks"))


_CMS_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{x}{chr(39)})' for x in signs)} THEN '{name}'" for name, signs in web.CMS) + " END"
_TECH_SQL = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{x}{chr(39)})' for x in signs)} THEN '{name}' END" for name, signs in web.TECHNOLOGIES) + "], lambda x: x IS NOT NULL)"
#: The pages hold no such signs: each page gets one behind its end, by its number.
_SIGNS = [s for _, signs in (*web.CMS, *web.TECHNOLOGIES) for s in signs]
_SIGNED = "html || CASE page_id % 40 " + " ".join(f"WHEN {i} THEN upper('{x}')" for i, x in enumerate(_SIGNS)) + " ELSE '' END"


@query(f"WITH s AS (SELECT page_id, lower({_SIGNED}) AS low FROM pages) SELECT page_id, {_CMS_SQL} AS cms, array_to_string({_TECH_SQL}, ',') AS technologies FROM s")
def tech_detect(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.expr(_SIGNED).alias("html"))
    return pages.select("page_id", web.detect_cms(F.col("html")).alias("cms"), F.array_join(web.detect_technologies(F.col("html")), ",").alias("technologies"))


_HEADERS = {
    "server": "CASE page_id % 11 WHEN 1 THEN 'nginx' WHEN 2 THEN 'CloudFlare-x' WHEN 3 THEN 'AkamaiGHost' END", "x-powered-by": "CASE WHEN page_id % 5 = 0 THEN 'PHP/8' END",
    "cf-ray": "CASE WHEN page_id % 13 = 4 THEN '1' END", "x-amz-cf-id": "CASE WHEN page_id % 17 = 5 THEN '2' END", "x-served-by": "CASE page_id % 7 WHEN 1 THEN 'Cache-x' WHEN 2 THEN 'other' END",
    "x-vercel-id": "CASE WHEN page_id % 19 = 6 THEN '3' END", "x-nf-request-id": "CASE WHEN page_id % 23 = 7 THEN '4' END", "x-akamai-request-id": "CASE WHEN page_id % 29 = 8 THEN '5' END",
}


@query("WITH h AS (SELECT page_id, " + ", ".join(f'{e} AS "{n}"' for n, e in _HEADERS.items()) + """ FROM pages) SELECT page_id, server, "x-powered-by" AS powered_by, CASE WHEN "cf-ray" IS NOT NULL OR lower(server) LIKE '%cloudflare%' THEN 'Cloudflare'
  WHEN "x-amz-cf-id" IS NOT NULL THEN 'Amazon CloudFront' WHEN lower("x-served-by") LIKE '%cache%' THEN 'Fastly' WHEN "x-vercel-id" IS NOT NULL THEN 'Vercel' WHEN "x-nf-request-id" IS NOT NULL THEN 'Netlify'
  WHEN "x-akamai-request-id" IS NOT NULL OR lower(server) LIKE '%akamaighost%' THEN 'Akamai' END AS cdn FROM h""")
def header_tech(spark, sf_dir):
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.expr(e).alias("v")) for n, e in _HEADERS.items()]), lambda x: x["v"].isNotNull()))
    return _t(spark, sf_dir, "pages").select("page_id", pairs.alias("headers")).select("page_id", web.detect_from_headers(F.col("headers")).alias("h")).select("page_id", "h.*")


@query("SELECT page_id, NOT (regexp_matches(pq, '^/[^?]*\\?') AND NOT regexp_matches(pq, '^/blog')) AS allowed FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS pq FROM pages)")
def robots_eval(spark, sf_dir):
    path_query = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    return _t(spark, sf_dir, "pages").select("page_id", robots_allowed(path_query, [("/*?", False), ("/blog", True)]).alias("allowed"))


# --- documents: custom search, fingerprints ------------------------------------------------------------------------

@query("SELECT 'the' AS rule, CAST(count_if(n > 0) AS BIGINT) AS contains, CAST(count_if(n = 0) AS BIGINT) AS missing FROM (SELECT len(regexp_extract_all(lower(text), 'the')) AS n FROM documents) UNION ALL "
       "SELECT 'num' AS rule, CAST(count_if(n > 0) AS BIGINT) AS contains, CAST(count_if(n = 0) AS BIGINT) AS missing FROM (SELECT len(regexp_extract_all(text, '[0-9]{4}')) AS n FROM documents)")
def custom_search_counts(spark, sf_dir):
    return search.custom_search_totals(_t(spark, sf_dir, "documents"), "text", [("the", "the", False), ("num", "[0-9]{4}", True)])


@query(f"WITH {_FIRST}, t AS (SELECT page_id, url, {_TITLE} AS title, trim({_TEXT.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?s)<h1>(.*?)</h1>' + chr(39) + ', 1)')}) AS h1 FROM p) SELECT page_id AS seq, url FROM t WHERE contains(lower(url), 'ing') OR contains(lower(title), 'ing') OR contains(lower(h1), 'ing')")
def search_pages(spark, sf_dir):
    return search.search_pages(corpus_pages(spark, sf_dir, "title", "meta_description", "h1"), "ING").select("seq", "url")


_NORM = "trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+', ' ', 'g'))"


@query(f"SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE {_NORM} <> '' GROUP BY {_NORM} HAVING count(*) > 1")
def content_hash_duplicates(spark, sf_dir):
    norm = text.collapse(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", norm.alias("norm")).where("norm <> ''")
    return rows.groupBy(F.sha2("norm", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1").drop("content_hash")


_EDGES = "'^[^\\pL\\pN]+|[^\\pL\\pN]+$'"
_PRINTS = f"""w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: lower(regexp_replace(x, {_EDGES}, '', 'g'))), lambda x: x <> '') AS v FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, array_to_string(v[i : i + 2], ' ') AS g FROM (SELECT doc_id, v, unnest(range(1, len(v) - 1)) AS i FROM w WHERE len(v) >= 20)),
  c AS (SELECT doc_id, g, count(*) AS k FROM s GROUP BY ALL),
  h AS (SELECT g, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda b: (strpos('0123456789ABCDEF', b[1]) * 16 + strpos('0123456789ABCDEF', b[2]) - 17)::UHUGEINT)),
    lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS f FROM (SELECT DISTINCT g FROM c)),
  b AS (SELECT doc_id, i, sum(CASE WHEN (f >> i::UBIGINT) & 1 = 1 THEN k ELSE -k END) > 0 AS one FROM c JOIN h USING (g), range(64) r(i) GROUP BY doc_id, i),
  dfp AS (SELECT doc_id, sum(CASE WHEN one AND i > 31 THEN 1::BIGINT << (i - 32) ELSE 0 END)::UBIGINT * 4294967296::UBIGINT + sum(CASE WHEN one AND i < 32 THEN 1::BIGINT << i ELSE 0 END)::UBIGINT AS v FROM b GROUP BY doc_id), fp AS (SELECT DISTINCT v FROM dfp)"""


@query(f"WITH {_PRINTS} SELECT printf('%016x', x.v) AS fp1, printf('%016x', y.v) AS fp2, CAST(bit_count(xor(x.v, y.v)::UBIGINT::BIT) AS BIGINT) AS distance FROM fp x JOIN fp y ON x.v < y.v AND bit_count(xor(x.v, y.v)::UBIGINT::BIT) <= 3")
def simhash_pairs(spark, sf_dir):
    prints = near_duplicates.fingerprinted(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text").where("content_simhash <> ''")
    return near_duplicates.near_pairs(prints)


_CLUSTERS = """e AS (SELECT x.v AS a, y.v AS b FROM fp x JOIN fp y ON x.v <> y.v AND bit_count(xor(x.v, y.v)::UBIGINT::BIT) <= 3), reach(v, c) AS (SELECT v, v FROM fp UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.v),
  l AS (SELECT v, min(c) AS c FROM reach GROUP BY v), r AS (SELECT {doc} AS doc, d.doc_id, l.c, l.v, {hash} AS h FROM dfp d JOIN l USING (v) JOIN {table} USING (doc_id)),
  k AS (SELECT c, count(*) AS cluster_size, min(doc_id) AS f FROM r GROUP BY c HAVING count(DISTINCT v) > 1 OR count(DISTINCT (v, h)) > count(DISTINCT v)),
  n AS (SELECT c, cluster_size, row_number() OVER (ORDER BY f) AS cluster FROM k)"""


@query(f"WITH RECURSIVE {_PRINTS}, {_CLUSTERS.format(doc='CAST(doc_id AS VARCHAR)', hash='md5(text)', table='documents')} SELECT doc AS url, cluster, cluster_size FROM r JOIN n USING (c)")
def near_duplicate_clusters(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("url"), F.md5("text").alias("content_hash"), "text")
    return near_duplicates.clusters(near_duplicates.fingerprinted(docs, "text").where("content_simhash <> ''"))


_S = f"""pg AS (SELECT p.*, text, nullif({_TITLE}, '') AS title, list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)(?:</h1>)', 1), lambda x: trim({_TEXT.format('x')})) AS h1s,
  len({_WORDS}) AS words, {_HASH} AS hash, strlen(text) * 100.0::DOUBLE / strlen(html) AS ratio, (1 - strlen(trim(regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\\z)', '', 'g'), '\\s+', ' ', 'g')))::DOUBLE / strlen(html)) * 100 AS saved,
  {_PATH} AS path, {_QUERY} AS q, {_PATH} || {_QUERY} AS pq, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS segs FROM p JOIN bodies ON doc_id = page_id)"""
_PX = f"CAST(floor(list_sum(list_transform(regexp_extract_all(title, '(?s).'), lambda c: coalesce({_WIDTH_MAP}[unicode(c)], {sum(text.WIDTHS)}.0 / 95))) * 20 / 1000 + 0.5) AS BIGINT)"
_NORMED = "trim(lower(regexp_replace({0}, '\\s+', ' ', 'g')))"
_PAGE_RULES = {
    **{k: "TRUE" for k in ("missingMeta", "missingH2", "missingCanonical", "missingSocialTags", "missingViewport", "missingStructuredData", "missingHreflang")},
    "missingTitle": "title IS NULL", "duplicateTitles": "title IN (SELECT title FROM pg GROUP BY title HAVING count(*) > 1)", "titleTooShort": "length(title) < 30", "titleTooLong": "length(title) > 60",
    "titleOverPixels": f"{_PX} > 561", "titleUnderPixels": f"{_PX} < 200", "titleSameAsH1": f"{_NORMED.format('title')} = {_NORMED.format('h1s[1]')}", "h1Issues": "len(list_filter(h1s, lambda x: x <> '')) <> 1",
    "h1TooLong": "len(list_filter(h1s, lambda x: length(x) > 70)) > 0", "duplicateH1": "h1s[1] <> '' AND h1s[1] IN (SELECT h1s[1] FROM pg GROUP BY h1s[1] HAVING count(*) > 1)",
    "duplicateContent": "hash <> '' AND hash IN (SELECT hash FROM pg GROUP BY hash HAVING count(*) > 1)", "loremIpsum": "contains(lower(text), 'lorem ipsum')",
    "soft404": "regexp_matches(lower(coalesce(title, '') || ' / ' || h1s[1]), '\\b(?:404|page not found|not found|no longer (?:exists|available))\\b')", "lowTextRatio": "ratio < 10", "lowWordCount": "words < 200", "unminified": "saved >= 10",
    "missingLang": "NOT regexp_matches(html, '<html lang=\"[^\"]')", "httpUrl": "url LIKE 'http:%'", "noInternalOutlinks": "page_id NOT IN (SELECT page_id FROM o)",
    "nonDescriptiveAnchors": "page_id IN (SELECT page_id FROM o WHERE list_contains([" + ", ".join(f"'{x}'" for x in text.EMPTY_WORDS) + "], lower(regexp_replace(anchor, '^[\\pP\\pS\\s]+|[\\pP\\pS\\s]+$', '', 'g'))))",
    "emptyAnchors": "page_id IN (SELECT page_id FROM o WHERE anchor = '')", "nearDuplicateContent": "url IN (SELECT doc FROM r JOIN n USING (c))", **_URL_RULES,
}
ORACLES["issue_long"] = (f"WITH RECURSIVE {_BODIES}, {_LINKS.removeprefix(_FIRST + ', ')}, {_PRINTS.replace('FROM documents WHERE text IS NOT NULL', 'FROM bodies')}, {_S}, {_CLUSTERS.format(doc='url', hash='hash', table='(SELECT page_id AS doc_id, url, hash FROM pg)')} "
                         + " UNION ALL ".join(f"SELECT url, '{k}' AS issue_key FROM pg WHERE {t}" for k, t in _PAGE_RULES.items()))


# --- the simulated web ---------------------------------------------------------------------------------------------

_SIM = f"WITH {simweb.ORACLE_CTES}"
_NON200 = "NOT (t.status IS NULL AND t.indexability = 'Non-Indexable (robots.txt)') AND (t.status IS DISTINCT FROM 200 OR t.hops > 0)"
_HAS_HTML = "{0}.status IS NOT NULL"
_LINKED = "SELECT target AS url FROM links UNION SELECT href FROM hreflang UNION SELECT pagination_next FROM sim WHERE pagination_next IS NOT NULL UNION SELECT pagination_prev FROM sim WHERE pagination_prev IS NOT NULL"


def _sim(spark, sf_dir, arrays=True):
    return simweb.sim_pages(spark, sf_dir, arrays), simweb.sim_links(spark, sf_dir), simweb.sim_hreflang(spark, sf_dir)


def _sim_issues(spark, sf_dir, *keys):
    # Only some rules read the arrays of a page row; cross-page rules read the link tables.
    tests = " ".join(issues.BY_KEY[k].test for k in keys)
    pages, links, hreflang = _sim(spark, sf_dir, "hreflang" in tests.replace("x_hreflang", "") or "has_empty" in tests)
    flags = issues.cross_flags(pages, links, hreflang, _near(pages) if "nearDuplicateContent" in keys else None, keys=keys) if any(issues.BY_KEY[k].cross for k in keys) else None
    return issues.exploded(issues.evaluated(pages, flags, keys), "url")


def _union(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT p.url, '{k}' AS issue_key FROM {body}" for k, body in parts.items())


_CANON = "sim p JOIN sim t ON p.canonical <> p.url AND t.url = p.canonical WHERE "
_DUP = "sim p WHERE p.status BETWEEN 200 AND 299 AND p.hops = 0 AND p.{0} IN (SELECT {0} FROM sim WHERE status BETWEEN 200 AND 299 AND hops = 0 GROUP BY {0} HAVING count(*) > 1)"
_HREF = ("hreflang e JOIN sim p ON p.url = e.source AND p.hops = 0 AND p.status IS NOT NULL JOIN sim t ON t.url = e.href WHERE ")
_BLOCKED = "(t.status IS NULL AND t.indexability = 'Non-Indexable (robots.txt)')"
_HREF_ERROR = f"(({_NON200}) OR (NOT {_BLOCKED} AND t.indexability <> 'Indexable'))"
_CROSS = {
    "duplicateTitles": _DUP.format("title"), "duplicateH1": _DUP.format("h1"), "duplicateMeta": _DUP.format("meta_description"), "duplicateContent": _DUP.format("content_hash"),
    "brokenCanonicalTarget": _CANON + "(t.status IS NULL OR t.status >= 400)", "canonicalToNonIndexable": _CANON + "t.indexability <> 'Indexable'", "canonicalToRedirect": _CANON + "(t.status BETWEEN 300 AND 399 OR t.hops > 0)",
    "internalRedirect": f"sim p WHERE p.hops > 0 AND p.url IN ({_LINKED})", "orphanPage": f"sim p WHERE p.discovered_via_sitemap AND p.url NOT IN ({_LINKED})",
    "paginationTargetError": "(SELECT url, unnest([pagination_next, pagination_prev]) AS to_url FROM sim) p LEFT JOIN sim t ON t.url = p.to_url WHERE p.to_url IS NOT NULL AND (t.url IS NULL OR t.status IS DISTINCT FROM 200 OR t.hops > 0)",
    "singleInlink": "sim p JOIN (SELECT target, count(DISTINCT source) AS k FROM links WHERE source <> target GROUP BY target) i ON i.target = p.url WHERE p.status BETWEEN 200 AND 299 AND p.depth > 0 AND i.k = 1",
    "linksToErrorPages": f"sim p JOIN links l ON l.source = p.url JOIN sim t ON t.url = l.target WHERE l.source <> l.target AND {_NON200}",
    "hreflangTargetError": _HREF + _HREF_ERROR,
    "hreflangMissingReturn": _HREF + f"NOT {_HREF_ERROR} AND t.status IS NOT NULL AND e.source <> e.href AND NOT EXISTS (SELECT 1 FROM hreflang b WHERE b.source = e.href AND b.href = e.source)",
    "notInSitemap": "sim p WHERE NOT p.discovered_via_sitemap AND p.depth > 0 AND p.status IS NOT NULL AND p.indexability = 'Indexable'",
}
_LOCAL = {
    "4xx5xx": "sim p WHERE p.status >= 400 OR (p.status IS NULL AND p.indexability <> 'Non-Indexable (robots.txt)')", "blockedByRobots": "sim p WHERE p.status IS NULL AND p.indexability = 'Non-Indexable (robots.txt)'",
    "missingTitle": "sim p WHERE p.status BETWEEN 200 AND 299 AND p.hops = 0 AND p.title IS NULL", "titleTooShort": "sim p WHERE p.title IS NOT NULL AND length(p.title) < 30",
    "missingMeta": "sim p WHERE p.status BETWEEN 200 AND 299 AND p.hops = 0 AND p.meta_description IS NULL", "metaTooShort": "sim p WHERE p.meta_description IS NOT NULL AND length(p.meta_description) < 70",
    "h1Issues": "sim p WHERE p.status BETWEEN 200 AND 299 AND p.hops = 0 AND p.h1 IS NULL", "lowWordCount": "sim p WHERE p.status BETWEEN 200 AND 299 AND p.word_count < 200",
    "missingCanonical": "sim p WHERE p.status BETWEEN 200 AND 299 AND p.hops = 0 AND p.canonical IS NULL", "canonicalised": "sim p WHERE p.indexability = 'Canonicalised'",
    "directiveNoindex": "sim p WHERE list_contains(directives, 'noindex')", "redirectChainTooLong": "sim p WHERE p.hops > 1", "redirectToError": "sim p WHERE p.hops > 0 AND p.status IS DISTINCT FROM 200",
    "deepPage": "sim p WHERE p.status IS NOT NULL AND p.depth > 3", "sitemapNonIndexable": "sim p WHERE p.discovered_via_sitemap AND p.indexability <> 'Indexable'",
    "sitemapNon200": "sim p WHERE p.discovered_via_sitemap AND (p.status IS DISTINCT FROM 200 OR p.hops > 0)",
    "nonDescriptiveAnchors": "sim p JOIN links l ON l.source = p.url WHERE lower(l.anchor) IN ('read more', 'click here')", "emptyAnchors": "sim p JOIN links l ON l.source = p.url WHERE l.anchor = ''",
    "hreflangMissingSelf": "sim p WHERE p.status IS NOT NULL AND p.hops = 0 AND p.url IN (SELECT source FROM hreflang) AND p.url NOT IN (SELECT source FROM hreflang WHERE href = source)",
    "hreflangMissingXDefault": "sim p WHERE p.status IS NOT NULL AND p.hops = 0 AND p.url IN (SELECT source FROM hreflang) AND p.url NOT IN (SELECT source FROM hreflang WHERE lang = 'x-default')",
}


_CONTENT = "p.status BETWEEN 200 AND 299 AND p.hops = 0"
_PIXELS = f"CAST(floor(list_sum(list_transform(regexp_extract_all(p.{{0}}, '(?s).'), lambda c: coalesce({_WIDTH_MAP}[unicode(c)], {sum(text.WIDTHS)}.0 / 95))) * {{1}} / 1000 + 0.5) AS BIGINT)"
_CLEAN = "trim(lower(regexp_replace(p.{0}, '\\s+', ' ', 'g')))"
_COMPARED = "p.status IS NOT NULL AND p.rendered AND p.has_raw"
_CAPTURED = "p.status IS NOT NULL AND p.captured_headers"
_NEAR = ("(SELECT a.url FROM (SELECT *, ('0x' || fp_hex)::UBIGINT AS v FROM sim WHERE status = 200 AND hops = 0 AND indexability = 'Indexable') a JOIN "
         "(SELECT *, ('0x' || fp_hex)::UBIGINT AS v FROM sim WHERE status = 200 AND hops = 0 AND indexability = 'Indexable') b ON a.url <> b.url AND "
         "(a.v <> b.v AND bit_count(xor(a.v, b.v)::BIT) <= 3 OR a.v = b.v AND a.content_hash <> b.content_hash)) p")
_LOCAL |= {
    "titleTooLong": "sim p WHERE length(p.title) > 60", "titleOverPixels": f"sim p WHERE p.title IS NOT NULL AND {_PIXELS.format('title', 20)} > 561",
    "titleUnderPixels": f"sim p WHERE p.title IS NOT NULL AND {_PIXELS.format('title', 20)} < 200", "titleSameAsH1": f"sim p WHERE p.title IS NOT NULL AND {_CLEAN.format('title')} = {_CLEAN.format('h1')}",
    "multipleTitles": "sim p WHERE p.title_count > 1", "metaTooLong": "sim p WHERE length(p.meta_description) > 155",
    "metaOverPixels": f"sim p WHERE p.meta_description IS NOT NULL AND {_PIXELS.format('meta_description', 14)} > 985", "metaUnderPixels": f"sim p WHERE p.meta_description IS NOT NULL AND {_PIXELS.format('meta_description', 14)} < 400",
    "multipleMetaDescriptions": "sim p WHERE p.meta_description_count > 1", "h1TooLong": "sim p WHERE length(p.h1) > 70",
    "missingH2": "sim p WHERE p.status BETWEEN 200 AND 299 AND p.h2_count = 0 AND (p.outline <> '' OR p.h1 IS NULL)", "multipleH2": "sim p WHERE p.h2_count > 1",
    "h2TooLong": "sim p WHERE p.h2_count > 0 AND length(p.h2) > 70", "nonSequentialHeadings": "sim p WHERE regexp_matches(p.outline, '1,[3-6]|2,[4-6]|3,[56]|4,6')", "loremIpsum": f"sim p WHERE {_CONTENT} AND p.has_lorem_ipsum",
    "soft404": f"sim p WHERE {_CONTENT} AND regexp_matches(lower(coalesce(p.title, '') || ' / ' || coalesce(p.h1, '')), '\\bpage not found\\b|\\b404\\b')", "lowTextRatio": "sim p WHERE p.status IS NOT NULL AND p.text_ratio_pct < 10",
    "missingAlt": "sim p WHERE p.missing_alt_count > 0", "nofollowLinks": "sim p WHERE p.internal_nofollow_count > 0", "unminified": "sim p WHERE p.status IS NOT NULL AND NOT p.is_minified",
    "multipleCanonical": "sim p WHERE p.canonical_count > 1", "canonicalIsRelative": f"sim p WHERE {_CONTENT} AND p.canonical_is_relative", "directiveNofollow": "sim p WHERE list_contains(directives, 'nofollow')",
    "directiveNone": "sim p WHERE list_contains(directives, 'none')", "xRobotsTagPresent": "sim p WHERE regexp_matches(p.x_robots_tag, '[a-z]')", "metaRefresh": "sim p WHERE coalesce(p.meta_refresh, '') <> ''",
    "noInternalOutlinks": f"sim p WHERE {_CONTENT} AND p.internal_link_count = 0", "highInternalOutlinks": f"sim p WHERE {_CONTENT} AND p.internal_link_count > 1000", "highExternalOutlinks": f"sim p WHERE {_CONTENT} AND p.external_link_count > 10",
    "slowResponse": "sim p WHERE p.response_time_ms > 600", "largeHtml": "sim p WHERE p.status IS NOT NULL AND p.size > 1048576", "imageMissingDimensions": "sim p WHERE p.images_missing_dimensions > 0",
    "missingSocialTags": "sim p WHERE p.status IS NOT NULL AND NOT p.has_open_graph AND NOT p.has_twitter_card", "missingViewport": "sim p WHERE p.status IS NOT NULL AND coalesce(p.viewport, '') = ''",
    "mobileUsabilityIssues": "sim p WHERE p.n_mobile > 0", "accessibilityIssues": "sim p WHERE p.n_axe > 0",
    "jsChangesTitle": "sim p WHERE p.rendered AND p.has_raw AND trim(regexp_replace(coalesce(p.title, ''), '\\s+', ' ', 'g')) <> coalesce(p.raw_title, '')", "jsChangesCanonical": "sim p WHERE p.rendered AND p.has_raw AND n % 21 = 0 AND p.canonical IS NOT NULL",
    "jsChangesRobots": "sim p WHERE p.rendered AND p.has_raw AND list_sort(list_filter(meta_directives, lambda x: x NOT IN ('all', 'index', 'follow'))) <> list_sort(list_filter(raw_directives, lambda x: x NOT IN ('all', 'index', 'follow')))",
    "jsAddsMostContent": "sim p WHERE p.rendered AND p.has_raw AND p.word_count > 0 AND p.raw_words < p.word_count * 0.5", "jsAddsLinks": "sim p WHERE p.rendered AND p.has_raw AND p.internal_link_count > p.raw_links + 5",
    "structuredDataErrors": "sim p WHERE p.has_data_error", "missingStructuredData": "sim p WHERE p.status IS NOT NULL AND NOT p.has_data_type", "insecureLinks": "sim p WHERE p.insecure_link_count > 0",
    "httpUrl": f"sim p WHERE {_CONTENT} AND p.url LIKE 'http:%'", "unsafeCrossOriginLinks": f"sim p WHERE {_CONTENT} AND p.unsafe_cross_origin_links > 0", "missingHsts": f"sim p WHERE {_CAPTURED} AND p.url LIKE 'https:%' AND NOT p.hsts",
    "mixedContent": "sim p WHERE p.url LIKE 'https:%' AND p.mixed_content_count > 0", "missingCsp": f"sim p WHERE {_CAPTURED} AND trim(coalesce(p.content_security_policy, '')) = ''",
    "missingFrameOptions": f"sim p WHERE {_CAPTURED} AND trim(coalesce(p.x_frame_options, '')) = '' AND NOT contains(lower(coalesce(p.content_security_policy, '')), 'frame-ancestors')",
    "missingContentTypeOptions": f"sim p WHERE {_CAPTURED} AND trim(lower(coalesce(p.x_content_type_options, ''))) <> 'nosniff'", "missingReferrerPolicy": f"sim p WHERE {_CAPTURED} AND trim(coalesce(p.referrer_policy, '')) = ''",
    "missingLang": "sim p WHERE p.status IS NOT NULL AND coalesce(p.lang, '') = ''", "missingHreflang": "sim p WHERE p.status IS NOT NULL AND p.url NOT IN (SELECT source FROM hreflang)",
    "hreflangInvalidCode": "sim p JOIN hreflang h ON h.source = p.url WHERE p.status IS NOT NULL AND p.hops = 0 AND h.lang IN ('en-uk', 'german')",
    "nearDuplicateContent": _NEAR, "duplicateH2": _DUP.format("h2"),
    **{k: f"(SELECT url, {_PATH} AS path, {_QUERY} AS q, status, {_PATH} || {_QUERY} AS pq, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS segs FROM sim) p WHERE p.status BETWEEN 200 AND 399 AND ({t})" for k, t in _URL_RULES.items()},
}
_DIRECTIVES = "list_distinct(list_filter(list_transform(string_split(lower({0}), ','), lambda x: CASE WHEN regexp_matches(trim(x), '^(max-snippet|max-image-preview|max-video-preview|unavailable_after):') THEN regexp_replace(trim(x), '\\s*:\\s*', ':') ELSE trim(regexp_replace(x, '^[^:]+:', '')) END), lambda x: x <> ''))"
_SIM = _SIM.replace(" AS indexability FROM sim0)", f" AS indexability, lpad(hex(fp), 16, '0') AS fp_hex, {_DIRECTIVES.format(chr(34) + 'meta_robots' + chr(34))} AS md, {_DIRECTIVES.format('x_robots_tag')} AS xd, "
                    f"coalesce({_DIRECTIVES.format('raw_robots')}, []) AS raw_directives, coalesce(md, []) AS meta_directives, list_distinct(list_concat(coalesce(md, []), coalesce(xd, []))) AS directives FROM sim0)", 1)


def _sim_query(name: str, *keys: str):
    every = _CROSS | _LOCAL
    QUERIES[name] = lambda spark, sf_dir: _sim_issues(spark, sf_dir, *keys)
    ORACLES[name] = f"{_SIM} " + _union({k: every[k] for k in keys})


_sim_query("duplicate_audit", "duplicateTitles", "duplicateH1", "duplicateMeta", "duplicateContent")
_sim_query("canonical_audit", "brokenCanonicalTarget", "canonicalToNonIndexable", "canonicalToRedirect", "missingCanonical", "canonicalised")
_sim_query("pagination_audit", "paginationTargetError")
_sim_query("hreflang_audit", "hreflangTargetError", "hreflangMissingReturn", "hreflangMissingSelf", "hreflangMissingXDefault")
_sim_query("orphan_audit", "orphanPage", "singleInlink", "linksToErrorPages")
_sim_query("redirect_audit", "internalRedirect", "redirectChainTooLong", "redirectToError")
_sim_query("sitemap_audit", "sitemapNonIndexable", "sitemapNon200", "notInSitemap")
_sim_query("response_audit", "4xx5xx", "blockedByRobots", "deepPage")
_sim_query("content_audit", "missingTitle", "titleTooShort", "missingMeta", "metaTooShort", "h1Issues", "lowWordCount", "directiveNoindex")
_sim_query("anchor_audit", "nonDescriptiveAnchors", "emptyAnchors")


_sim_query("title_audit", "titleTooLong", "titleOverPixels", "titleUnderPixels", "titleSameAsH1", "multipleTitles", "soft404")
_sim_query("description_audit", "metaTooLong", "metaOverPixels", "metaUnderPixels", "multipleMetaDescriptions", "loremIpsum", "lowTextRatio", "unminified")
_sim_query("heading_audit", "h1TooLong", "missingH2", "multipleH2", "duplicateH2", "h2TooLong", "nonSequentialHeadings")
_sim_query("near_duplicate_audit", "nearDuplicateContent")
_sim_query("directive_audit", "multipleCanonical", "canonicalIsRelative", "directiveNofollow", "directiveNone", "xRobotsTagPresent", "metaRefresh")
_sim_query("link_audit", "missingAlt", "nofollowLinks", "noInternalOutlinks", "highInternalOutlinks", "highExternalOutlinks", "unsafeCrossOriginLinks")
_sim_query("performance_audit", "slowResponse", "largeHtml", "imageMissingDimensions", "missingSocialTags", "missingViewport", "mobileUsabilityIssues", "accessibilityIssues")
_sim_query("javascript_audit", "jsChangesTitle", "jsChangesCanonical", "jsChangesRobots", "jsAddsMostContent", "jsAddsLinks", "structuredDataErrors", "missingStructuredData")
_sim_query("security_audit", "httpUrl", "insecureLinks", "missingHsts", "mixedContent", "missingCsp", "missingFrameOptions", "missingContentTypeOptions", "missingReferrerPolicy")
_sim_query("international_audit", "missingLang", "missingHreflang", "hreflangInvalidCode")
_RESOURCE = {
    "largeImage": "resources p WHERE resource_type = 'image' AND content_length > 102400", "broken": "resources p WHERE status >= 400 OR error IS NOT NULL", "insecureLinks": "resources p WHERE is_insecure",
    "outlinksToLocalhost": "resources p WHERE resource_type = 'link' AND regexp_matches(url, '^https?://([^/]*[.])?localhost[:/]') AND NOT regexp_matches(source_page, '^https?://127[.]0[.]0[.]1/')",
}


def _labelled(parts: dict[str, str], scope: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS issue_key, '{scope}' AS scope, count(*) AS n FROM (SELECT DISTINCT p.url FROM {body})" for k, body in parts.items())


_REGISTRY_SQL = ", ".join(f"({i}, '{r.key}', '{r.label.replace(chr(39), chr(39) * 2)}', '{r.severity}', '{r.group}', '{r.section}', '{r.scope}')" for i, r in enumerate(issues.REGISTRY))


@query(f"{_SIM}, c AS ({_labelled(_CROSS | _LOCAL, 'page')} UNION ALL {_labelled(_RESOURCE, 'resource')}), "
       f"g(pos, issue_key, label, severity, issue_group, section, scope) AS (VALUES {_REGISTRY_SQL}) SELECT g.*, coalesce(c.n, -1) AS n FROM g LEFT JOIN c USING (issue_key, scope)")
def issue_summary(spark, sf_dir):
    pages, links, hreflang = _sim(spark, sf_dir)
    pages = keep(pages, "sim")
    found = issues.issue_long(pages, issues.cross_flags(pages, links, hreflang, near=_near(pages)), simweb.sim_resources(spark, sf_dir))
    return issues.issue_summary(found)


@query(f"{_SIM} {_union(_RESOURCE)}")
def resource_audit(spark, sf_dir):
    return issues.exploded(issues.resource_issues(simweb.sim_resources(spark, sf_dir)), "url")


@query(f"{_SIM} SELECT target, count(*) AS inlinks, count(DISTINCT source) AS unique_inlinks FROM links WHERE source <> target GROUP BY target")
def inlink_counts(spark, sf_dir):
    return graph.inlinks(simweb.sim_links(spark, sf_dir))


@query(f"{_SIM} SELECT target, source, anchor FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source, pos) AS rn FROM links WHERE source <> target) WHERE rn <= 3")
def inlink_top3(spark, sf_dir):
    return graph.first_inlinks(simweb.sim_links(spark, sf_dir), 3).select("target", "source", "anchor")


def _rank_sql() -> str:
    parts = [_SIM.removeprefix("WITH "), "ok AS MATERIALIZED (SELECT DISTINCT source, target FROM links WHERE NOT nofollow AND source <> target AND source IN (SELECT url FROM sim) AND target IN (SELECT url FROM sim))",
             "g AS MATERIALIZED (SELECT source, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS share FROM ok)",
             "nd AS MATERIALIZED (SELECT url, url NOT IN (SELECT source FROM g) AS sink, (SELECT count(*) FROM sim) AS n FROM sim)", "r0 AS MATERIALIZED (SELECT url, 1.0::DOUBLE / n AS r FROM nd)"]
    for i in range(1, 21):
        parts.append(f"r{i} AS MATERIALIZED (SELECT nd.url, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM r{i-1} JOIN nd x USING (url) WHERE x.sink) / n + 0.85::DOUBLE * coalesce(s.given, 0) AS r "
                     f"FROM nd LEFT JOIN (SELECT target AS url, sum(r * share) AS given FROM g JOIN r{i-1} ON r{i-1}.url = g.source GROUP BY target) s USING (url))")
    return "WITH " + ", ".join(parts) + " SELECT url, floor(r / (SELECT max(r) FROM r20) * 100 * 10 + 0.5) / 10 AS link_score FROM r20"


@query(_rank_sql())
def link_score(spark, sf_dir):
    return graph.link_score(simweb.sim_pages(spark, sf_dir, False), simweb.sim_links(spark, sf_dir))


@query(f"WITH RECURSIVE {simweb.ORACLE_CTES}, b(url, depth) AS (SELECT 'https://example.com/p0', 0::BIGINT UNION SELECT l.target, b.depth + 1 FROM b JOIN links l ON l.source = b.url WHERE b.depth < 4) SELECT url, min(depth) AS depth FROM b GROUP BY url")
def bfs_depth(spark, sf_dir):
    start = spark.createDataFrame([("https://example.com/p0",)], "url string")
    return graph.bfs_depth(simweb.sim_links(spark, sf_dir), start, 4)


_AFTER = "after AS (SELECT CASE WHEN n % 13 = 0 THEN url || '-new' ELSE url END AS key, CASE WHEN n % 11 = 0 THEN 404 ELSE status END AS status, CASE WHEN n % 17 = 0 THEN title || ' 2' ELSE title END AS title, word_count + (n % 3) * 60 AS word_count FROM sim)"


@query(f"{_SIM}, {_AFTER}, j AS (SELECT coalesce(b.url, a.key) AS key, b.url AS u, a.key AS k, coalesce(CAST(b.status AS VARCHAR), '') AS s0, coalesce(CAST(a.status AS VARCHAR), '') AS s1, coalesce(b.title, '') AS t0, coalesce(a.title, '') AS t1, b.word_count AS w0, a.word_count AS w1 FROM sim b FULL JOIN after a ON a.key = b.url) "
       "SELECT key, 'added' AS kind, '' AS field, '' AS before, s1 AS after FROM j WHERE u IS NULL UNION ALL SELECT key, 'removed', '', s0, '' FROM j WHERE k IS NULL UNION ALL "
       "SELECT key, 'changed', 'status', s0, s1 FROM j WHERE u = k AND s0 <> s1 UNION ALL SELECT key, 'changed', 'title', t0, t1 FROM j WHERE u = k AND t0 <> t1 UNION ALL "
       "SELECT key, 'changed', 'word_count', CAST(w0 AS VARCHAR), CAST(w1 AS VARCHAR) FROM j WHERE u = k AND abs(w1 - w0) > 0.2 * w0")
def crawl_diff(spark, sf_dir):
    before = simweb.sim_pages(spark, sf_dir, False)
    n = F.col("seq")
    after = before.withColumns({
        "url": F.when(n % 13 == 0, F.concat("url", F.lit("-new"))).otherwise(F.col("url")), "status": F.when(n % 11 == 0, 404).otherwise(F.col("status")),
        "title": F.when(n % 17 == 0, F.concat("title", F.lit(" 2"))).otherwise(F.col("title")), "word_count": F.col("word_count") + (n % 3) * 60})
    return compare.diff(before, complete(after))


@query(f"{_SIM} SELECT CASE WHEN status > 0 THEN CAST(status // 100 AS VARCHAR) || 'xx' ELSE 'error' END AS bucket, count(*) AS pages FROM sim GROUP BY 1")
def status_histogram(spark, sf_dir):
    return simweb.sim_pages(spark, sf_dir, False).groupBy(search.status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("pages"))


# --- relational surface over orders, customers and events ----------------------------------------------------------

@query("SELECT coalesce(c_mktsegment, 'SEO') AS category, count(*) AS n FROM customer GROUP BY 1")
def category_counts(spark, sf_dir):
    return _t(spark, sf_dir, "customer").groupBy(F.coalesce("c_mktsegment", F.lit("SEO")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 4")
def recent_posts_topk(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(4).select("o_orderkey", "o_orderdate")


@query("SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_mktsegment IS NULL) AND (c_name ILIKE '%1%' OR CAST(c_custkey AS VARCHAR) ILIKE '%1%') ORDER BY c_custkey LIMIT 20 OFFSET 20")
def paged_list(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").where("(c_mktsegment = 'BUILDING' OR c_mktsegment IS NULL) AND (c_name ILIKE '%1%' OR CAST(c_custkey AS STRING) ILIKE '%1%')")
    return rows.orderBy("c_custkey").offset(20).limit(20).select("c_custkey", "c_name")


@query("SELECT o.o_orderkey, o.o_orderstatus, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
def moderation_join(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    orders = _t(spark, sf_dir, "orders")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").select("o_orderkey", "o_orderstatus", "c_name")


@query("SELECT DISTINCT n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_acctbal > 9000")
def distinct_authors(spark, sf_dir):
    customers, nations = _t(spark, sf_dir, "customer").where("c_acctbal > 9000"), _t(spark, sf_dir, "nation")
    return customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select("n_name").distinct()


@query("SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS score, max(CASE WHEN l_suppkey = 7 THEN 1 ELSE 0 END) AS mine FROM lineitem GROUP BY l_orderkey")
def vote_scores(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).cast("long").alias("score"), F.max(F.when(F.col("l_suppkey") == 7, 1).otherwise(0)).alias("mine"))


@query("WITH c AS (SELECT o_orderkey AS id, o_custkey AS up FROM orders WHERE o_orderstatus <> 'P'), v AS (SELECT l_orderkey AS id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS score, "
       "CAST(max(CASE WHEN l_suppkey = 7 THEN CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END END) AS BIGINT) AS my_vote FROM lineitem GROUP BY 1) "
       "SELECT c.id, p.id AS parent, coalesce(score, 0) AS score, coalesce(my_vote, 0) AS my_vote FROM c LEFT JOIN c p ON p.id = c.up LEFT JOIN v ON v.id = c.id")
def comment_threads(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"), F.when(F.col("o_orderstatus") != "P", "approved").otherwise("pending").alias("status"))
    votes = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("comment_id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("value"), "l_suppkey")
    return comments.threads(rows, votes, F.col("l_suppkey") == 7)


@query("SELECT c_custkey, '/' || trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') || '/' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS path FROM customer")
def post_paths(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", posts.post_path(F.col("c_mktsegment"), posts.slug(F.col("c_name"))).alias("path"))


@query("SELECT doc_id, CAST(greatest(1, floor(len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x0b]+'), lambda x: x <> '')) / 200 + 0.5)) AS BIGINT) AS minutes FROM documents")
def reading_time(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", posts.reading_minutes(F.col("text")).alias("minutes"))


@query("WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h([23])((?: [^>]*)?)>(.*?)</h[23]>', 1)) AS level, unnest(regexp_extract_all(html, '(?s)<h([23])((?: [^>]*)?)>(.*?)</h[23]>', 3)) AS inner_html FROM (SELECT page_id, " + _MORE_HEADINGS + " AS html FROM pages)), "
       "t AS (SELECT page_id, CAST(level AS INT) AS level, trim(replace(replace(replace(replace(replace(regexp_replace(inner_html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')) AS text FROM h) "
       "SELECT page_id, level, text, count(*) AS n FROM t WHERE text <> '' GROUP BY ALL")
def post_headings(spark, sf_dir):
    found = _t(spark, sf_dir, "pages").select("page_id", F.explode(posts.headings(F.expr(_MORE_HEADINGS))).alias("h"))
    return found.groupBy("page_id", "h.level", "h.text").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS posts, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS published, CAST(sum(coalesce(o_custkey, 0)) AS BIGINT) AS views FROM orders")
def post_stats(spark, sf_dir):
    return _t(spark, sf_dir, "orders").agg(F.count("*").alias("posts"), F.count_if(F.col("o_orderstatus") == "F").alias("published"), F.sum(F.coalesce("o_custkey", F.lit(0))).cast("long").alias("views"))


@query("SELECT event_id, recent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent >= 5")
def sliding_lockout(spark, sf_dir):
    return search.sliding_limit(_t(spark, sf_dir, "events"), "user_id", "ts", 86400, 5).select("event_id", "recent")


@query("SELECT event_type, epoch_us(ts) // 3600000000 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_limiter(spark, sf_dir):
    return search.tumbling_counts(_t(spark, sf_dir, "events"), "event_type", "ts", 3600)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE event_type IS DISTINCT FROM was")
def status_changes(spark, sf_dir):
    return search.state_changes(_t(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "event_type")

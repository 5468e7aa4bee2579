"""The rule registry: each rule is a key, its place in the report and a predicate.

Local rules are Boolean SQL over one page or resource row and the macros of page_macros(); cross-page rules name a flag
that cross_flags() joins to the page row. issue_long() evaluates a whole scope as one projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..plans.tables import keep
from .custom import search_filter
from .graph import inlinks, linked_urls

TITLE_MIN, TITLE_MAX, TITLE_MIN_PX, TITLE_MAX_PX = 30, 60, 200, 561
META_MIN, META_MAX, META_MIN_PX, META_MAX_PX = 70, 155, 400, 985
HEADING_MAX, LOW_WORDS, LOW_RATIO, DEEP, SLOW_MS = 70, 200, 10, 3, 600
LARGE_HTML, LARGE_IMAGE, URL_MAX = 1048576, 102400, 115
HIGH_INTERNAL, HIGH_EXTERNAL, RAW_WORDS, RAW_LINKS = 1000, 10, 0.5, 5


@dataclass(frozen=True)
class Rule:
    key: str
    scope: str
    group: str
    severity: str
    section: str
    test: str
    cross: bool = False

    @property
    def label(self) -> str:
        return LABELS[self.key]


#: What the report calls each rule. Fixed values.
LABELS = {
    "4xx5xx": "4xx/5xx/Error", "blockedByRobots": "Blocked by robots.txt",
    "missingTitle": "Missing title", "duplicateTitles": "Duplicate titles", "titleTooShort": "Title too short", "titleTooLong": "Title too long",
    "titleOverPixels": f"Title over {TITLE_MAX_PX} px", "titleUnderPixels": f"Title below {TITLE_MIN_PX} px", "titleSameAsH1": "Title same as H1", "multipleTitles": "Multiple titles",
    "missingMeta": "Missing meta desc.", "duplicateMeta": "Duplicate meta desc.", "metaTooLong": f"Meta desc. over {META_MAX} chars", "metaTooShort": f"Meta desc. below {META_MIN} chars",
    "metaOverPixels": f"Meta desc. over {META_MAX_PX} px", "metaUnderPixels": f"Meta desc. below {META_MIN_PX} px", "multipleMetaDescriptions": "Multiple meta desc.",
    "h1Issues": "H1 issues", "h1TooLong": f"H1 over {HEADING_MAX} chars", "duplicateH1": "Duplicate H1", "missingH2": "Missing H2", "multipleH2": "Multiple H2", "duplicateH2": "Duplicate H2",
    "h2TooLong": f"H2 over {HEADING_MAX} chars", "nonSequentialHeadings": "Non-sequential headings", "duplicateContent": "Duplicate content", "loremIpsum": "Lorem ipsum placeholder",
    "soft404": "Soft 404 pages", "nearDuplicateContent": "Near-duplicate content", "lowTextRatio": "Low text/HTML ratio", "lowWordCount": f"Low content (<{LOW_WORDS} words)",
    "missingAlt": "Missing alt text", "nofollowLinks": "Nofollow links", "unminified": "Unminified pages",
    "multipleCanonical": "Multiple canonical tags", "brokenCanonicalTarget": "Canonical points to broken page", "missingCanonical": "Missing canonical",
    "canonicalIsRelative": "Relative canonical URL", "canonicalised": "Canonicalised", "canonicalToNonIndexable": "Canonical to non-indexable page", "canonicalToRedirect": "Canonical to redirect",
    "directiveNoindex": "Noindex directive", "directiveNofollow": "Nofollow directive", "directiveNone": "None directive", "xRobotsTagPresent": "Directives in X-Robots-Tag",
    "redirectChainTooLong": "Long redirect chains", "internalRedirect": "Internal redirects", "redirectToError": "Redirects to a non-200 page", "metaRefresh": "Meta refresh",
    "paginationTargetError": "Pagination to non-200 or uncrawled URL", "orphanPage": "Orphan pages (sitemap only)", "deepPage": f"Deep pages (depth >{DEEP})",
    "sitemapNonIndexable": "Non-indexable URLs in sitemap", "sitemapNon200": "Non-200 URLs in sitemap", "notInSitemap": "Indexable URLs not in sitemap",
    "nonDescriptiveAnchors": "Non-descriptive anchor text", "emptyAnchors": "Links with empty anchor text", "singleInlink": "Only one inlink", "linksToErrorPages": "Links to non-200 pages",
    "noInternalOutlinks": "No internal outlinks", "highInternalOutlinks": f"Over {HIGH_INTERNAL:,} internal outlinks", "highExternalOutlinks": f"Over {HIGH_EXTERNAL} external outlinks",
    "outlinksToLocalhost": "Links to localhost", "slowResponse": f"Slow response (>{SLOW_MS}ms)", "largeHtml": "Large HTML (>1 MB)", "largeImage": "Large images (>100 KB)",
    "imageMissingDimensions": "Images missing width/height", "missingSocialTags": "Missing OG/Twitter tags", "missingViewport": "Missing viewport tag", "mobileUsabilityIssues": "Mobile usability issues",
    "jsChangesTitle": "JavaScript changes the title", "jsChangesCanonical": "JavaScript changes the canonical", "jsChangesRobots": "JavaScript changes meta robots",
    "jsAddsMostContent": f"Most content added by JavaScript (raw under {RAW_WORDS * 100:.0f}% of words)", "jsAddsLinks": f"JavaScript adds internal links (over {RAW_LINKS})",
    "structuredDataErrors": "Invalid structured data", "missingStructuredData": "No structured data", "accessibilityIssues": "Accessibility violations",
    "broken": "Broken links/images", "insecureLinks": "Insecure links", "httpUrl": "Page served over HTTP", "unsafeCrossOriginLinks": "Unsafe cross-origin links", "missingHsts": "Missing HSTS",
    "mixedContent": "Mixed content", "missingCsp": "Missing CSP", "missingFrameOptions": "Missing X-Frame-Options", "missingContentTypeOptions": "Missing X-Content-Type-Options",
    "missingReferrerPolicy": "Missing Referrer-Policy", "missingLang": "Missing lang attr.", "missingHreflang": "Missing hreflang", "hreflangMissingReturn": "Hreflang missing return link",
    "hreflangMissingSelf": "Hreflang missing self-reference", "hreflangMissingXDefault": "Hreflang missing x-default", "hreflangInvalidCode": "Invalid hreflang code",
    "hreflangTargetError": "Hreflang to non-200/non-indexable", "urlUppercase": "Uppercase in URL", "urlUnderscores": "Underscores in URL", "urlParameters": "URL has parameters",
    "urlOver115": f"URL over {URL_MAX} characters", "urlNonAscii": "Non-ASCII characters in URL", "urlMultipleSlashes": "Multiple slashes in URL", "urlRepetitivePath": "Repetitive path in URL",
    "urlContainsSpace": "Space in URL", "urlGaTracking": "GA tracking parameters in URL", "urlInternalSearch": "Internal search URL",
}


def _rules(section: str, rows: list[tuple]) -> list[Rule]:
    return [Rule(key, "resource" if test.startswith("resource:") else "page", group, severity, section, test.removeprefix("resource:").removeprefix("cross:"), test.startswith("cross:"))
            for key, group, severity, test in rows]


REGISTRY: list[Rule] = [
    *_rules("", [("4xx5xx", "response", "bad", "status >= 400 OR (status IS NULL AND NOT robots_blocked)")]),
    *_rules("Canonical & Indexing", [("blockedByRobots", "indexing", "warn", "robots_blocked")]),
    *_rules("Titles", [
        ("missingTitle", "content", "info", "is_content AND NOT has_title"),
        ("duplicateTitles", "content", "info", "cross:x_duplicate_title"),
        ("titleTooShort", "content", "info", f"has_title AND title_length < {TITLE_MIN}"),
        ("titleTooLong", "content", "info", f"title_length > {TITLE_MAX}"),
        ("titleOverPixels", "content", "info", f"has_title AND title_px > {TITLE_MAX_PX}"),
        ("titleUnderPixels", "content", "info", f"has_title AND title_px < {TITLE_MIN_PX}"),
        ("titleSameAsH1", "content", "info", "title_norm <> '' AND title_norm = h1_norm"),
        ("multipleTitles", "content", "warn", "title_count > 1"),
    ]),
    *_rules("Content", [
        ("missingMeta", "content", "info", "is_content AND NOT has_meta"),
        ("duplicateMeta", "content", "info", "cross:x_duplicate_meta_description"),
        ("metaTooLong", "content", "info", f"has_meta AND meta_description_length > {META_MAX}"),
        ("metaTooShort", "content", "info", f"has_meta AND meta_description_length < {META_MIN}"),
        ("metaOverPixels", "content", "info", f"has_meta AND meta_px > {META_MAX_PX}"),
        ("metaUnderPixels", "content", "info", f"has_meta AND meta_px < {META_MIN_PX}"),
        ("multipleMetaDescriptions", "content", "warn", "meta_description_count > 1"),
        ("h1Issues", "content", "info", "is_content AND h1_count <> 1"),
        ("h1TooLong", "content", "info", f"h1_longest > {HEADING_MAX}"),
        ("duplicateH1", "content", "info", "cross:x_duplicate_h1"),
        ("missingH2", "content", "info", "has_html AND is_2xx AND h2_count = 0 AND (size(heading_levels) > 0 OR h1_count = 0)"),
        ("multipleH2", "content", "info", "h2_count > 1"),
        ("duplicateH2", "content", "info", "cross:x_duplicate_h2"),
        ("h2TooLong", "content", "info", f"h2_longest > {HEADING_MAX}"),
        ("nonSequentialHeadings", "accessibility", "info", "skips_level"),
        ("duplicateContent", "content", "info", "cross:x_duplicate_content_hash"),
        ("loremIpsum", "content", "bad", "is_content AND has_lorem_ipsum"),
        ("soft404", "content", "warn", "is_content AND says_404"),
        ("nearDuplicateContent", "content", "warn", "cross:x_near_duplicate"),
        ("lowTextRatio", "content", "warn", f"has_html AND text_ratio_pct < {LOW_RATIO}"),
        ("lowWordCount", "content", "warn", f"is_2xx AND has_html AND word_count < {LOW_WORDS}"),
        ("missingAlt", "accessibility", "warn", "missing_alt_count > 0"),
        ("nofollowLinks", "links", "info", "internal_nofollow_count > 0"),
        ("unminified", "technical", "warn", "has_html AND NOT is_minified"),
    ]),
    *_rules("Canonical & Indexing", [
        ("multipleCanonical", "indexing", "warn", "canonical_count > 1"),
        ("brokenCanonicalTarget", "indexing", "bad", "cross:x_canonical_broken"),
        ("missingCanonical", "indexing", "warn", "has_html AND is_2xx AND coalesce(redirect_url, '') = '' AND coalesce(canonical, '') = ''"),
        ("canonicalIsRelative", "indexing", "warn", "is_content AND canonical_is_relative"),
        ("canonicalised", "indexing", "info", "indexability = 'Canonicalised'"),
        ("canonicalToNonIndexable", "indexing", "bad", "cross:x_canonical_non_indexable"),
        ("canonicalToRedirect", "indexing", "warn", "cross:x_canonical_redirect"),
        ("directiveNoindex", "indexing", "info", "array_contains(directives, 'noindex')"),
        ("directiveNofollow", "indexing", "info", "array_contains(directives, 'nofollow')"),
        ("directiveNone", "indexing", "warn", "array_contains(directives, 'none')"),
        ("xRobotsTagPresent", "indexing", "info", "size(header_directives) > 0"),
        ("redirectChainTooLong", "response", "warn", "size(redirect_chain) > 1"),
        ("internalRedirect", "response", "warn", "cross:size(redirect_chain) > 0 AND x_linked"),
        ("redirectToError", "response", "bad", "size(redirect_chain) > 0 AND NOT (status <=> 200)"),
        ("metaRefresh", "indexing", "warn", "coalesce(meta_refresh, '') <> ''"),
        ("paginationTargetError", "links", "warn", "cross:x_pagination_error"),
        ("orphanPage", "links", "warn", "cross:discovered_via_sitemap AND NOT x_linked"),
        ("deepPage", "links", "warn", f"has_html AND depth > {DEEP}"),
        ("sitemapNonIndexable", "indexing", "warn", "discovered_via_sitemap AND indexability <> 'Indexable'"),
        ("sitemapNon200", "indexing", "warn", "discovered_via_sitemap AND (NOT (status <=> 200) OR coalesce(redirect_url, '') <> '')"),
        ("notInSitemap", "indexing", "warn", "cross:x_sitemap_used AND NOT discovered_via_sitemap AND depth > 0 AND has_html AND indexability = 'Indexable'"),
    ]),
    *_rules("Links", [
        ("nonDescriptiveAnchors", "links", "warn", "has_empty_words"),
        ("emptyAnchors", "links", "warn", "has_empty_anchor"),
        ("singleInlink", "links", "warn", "cross:is_2xx AND has_html AND depth > 0 AND x_unique_inlinks = 1"),
        ("linksToErrorPages", "links", "warn", "cross:x_links_to_error"),
        ("noInternalOutlinks", "links", "warn", "is_content AND internal_link_count = 0"),
        ("highInternalOutlinks", "links", "info", f"is_content AND internal_link_count > {HIGH_INTERNAL}"),
        ("highExternalOutlinks", "links", "info", f"is_content AND external_link_count > {HIGH_EXTERNAL}"),
        ("outlinksToLocalhost", "links", "bad", "resource:resource_type = 'link' AND url_local AND NOT source_local"),
    ]),
    *_rules("Performance", [
        ("slowResponse", "response", "warn", f"response_time_ms > {SLOW_MS}"),
        ("largeHtml", "technical", "warn", f"html_size_bytes > {LARGE_HTML}"),
        ("largeImage", "technical", "warn", f"resource:resource_type = 'image' AND coalesce(content_length, 0) > {LARGE_IMAGE}"),
        ("imageMissingDimensions", "technical", "warn", "images_missing_dimensions > 0"),
    ]),
    *_rules("Meta & Social", [("missingSocialTags", "content", "info", "has_html AND NOT has_open_graph AND NOT has_twitter_card")]),
    *_rules("Mobile Usability", [
        ("missingViewport", "technical", "warn", "has_html AND coalesce(viewport, '') = ''"),
        ("mobileUsabilityIssues", "accessibility", "bad", "size(mobile_usability_violations) > 0"),
    ]),
    *_rules("JavaScript", [
        ("jsChangesTitle", "technical", "warn", "compared AND raw_title_norm <> title_ws"),
        ("jsChangesCanonical", "indexing", "bad", "compared AND raw_canonical_norm <> canonical_ws"),
        ("jsChangesRobots", "indexing", "bad", "compared AND NOT (raw_directives <=> meta_directives)"),
        ("jsAddsMostContent", "content", "warn", f"compared AND word_count > 0 AND raw.word_count < word_count * {RAW_WORDS}"),
        ("jsAddsLinks", "links", "warn", f"compared AND internal_link_count > raw.internal_link_count + {RAW_LINKS}"),
    ]),
    *_rules("Structured Data", [
        ("structuredDataErrors", "technical", "bad", "size(structured_data_errors) > 0"),
        ("missingStructuredData", "technical", "info", "has_html AND size(structured_data_types) = 0"),
    ]),
    *_rules("Accessibility", [("accessibilityIssues", "accessibility", "bad", "size(accessibility_violations) > 0")]),
    *_rules("Security", [
        ("broken", "links", "bad", "resource:status >= 400 OR coalesce(error, '') <> ''"),
        ("insecureLinks", "technical", "bad", "insecure_link_count > 0"),
        ("httpUrl", "technical", "bad", "is_content AND startswith(url, 'http:')"),
        ("unsafeCrossOriginLinks", "technical", "info", "is_content AND unsafe_cross_origin_links > 0"),
        ("missingHsts", "technical", "warn", "captured AND startswith(url, 'https:') AND NOT hsts"),
        ("mixedContent", "technical", "bad", "startswith(url, 'https:') AND mixed_content_count > 0"),
        ("missingCsp", "technical", "warn", "captured AND trim(coalesce(content_security_policy, '')) = ''"),
        ("missingFrameOptions", "technical", "warn", "captured AND trim(coalesce(x_frame_options, '')) = '' AND NOT frame_ancestors"),
        ("missingContentTypeOptions", "technical", "warn", "captured AND NOT (lower(trim(x_content_type_options)) <=> 'nosniff')"),
        ("missingReferrerPolicy", "technical", "warn", "captured AND trim(coalesce(referrer_policy, '')) = ''"),
    ]),
    *_rules("International", [
        ("missingLang", "indexing", "info", "has_html AND coalesce(lang, '') = ''"),
        ("missingHreflang", "indexing", "info", "has_html AND size(hreflang_values) = 0"),
        ("hreflangMissingReturn", "indexing", "warn", "cross:x_hreflang_no_return"),
        ("hreflangMissingSelf", "indexing", "warn", "hreflang_source AND NOT exists(hreflang_links, l -> l.href = url)"),
        ("hreflangMissingXDefault", "indexing", "info", "hreflang_source AND NOT exists(hreflang_links, l -> lower(trim(l.lang)) = 'x-default')"),
        ("hreflangInvalidCode", "indexing", "bad", "hreflang_source AND invalid_hreflang"),
        ("hreflangTargetError", "indexing", "bad", "cross:x_hreflang_error"),
    ]),
    *_rules("URL", [
        ("urlUppercase", "technical", "warn", "is_live AND unescaped RLIKE '[A-Z]'"),
        ("urlUnderscores", "technical", "info", "is_live AND contains(path_query, '_')"),
        ("urlParameters", "technical", "info", "is_live AND query <> ''"),
        ("urlOver115", "technical", "warn", f"is_live AND char_length(url) > {URL_MAX}"),
        ("urlNonAscii", "technical", "warn", "is_live AND path_query RLIKE '%[89A-Fa-f][0-9A-Fa-f]'"),
        ("urlMultipleSlashes", "technical", "warn", "is_live AND contains(path, '//')"),
        ("urlRepetitivePath", "technical", "info", "is_live AND size(segments) <> size(array_distinct(segments))"),
        ("urlContainsSpace", "technical", "warn", "is_live AND path_query RLIKE '%20| '"),
        ("urlGaTracking", "technical", "warn", f"is_live AND exists(query_names, q -> q RLIKE '{urls.TRACKING}')"),
        ("urlInternalSearch", "technical", "warn", "is_live AND query <> '' AND path_query RLIKE '(?i)search'"),
    ]),
]
BY_KEY = {r.key: r for r in REGISTRY}


def page_macros(pages: DataFrame, codes: dict[str, list[str]] | None = None) -> DataFrame:
    """pages with the derived columns that the rules share; none needs another row."""
    c = F.col
    codes = codes or iso_codes(pages.sparkSession)
    full = lambda name: F.coalesce(c(name), F.lit("")) != ""
    html = c("html_size_bytes") > 0
    two = F.coalesce((c("status") >= 200) & (c("status") < 300), F.lit(False))
    levels = c("heading_levels")
    code = lambda x: F.regexp_extract(F.lower(text.strip(x)), "^([a-z]{2})(?:-([a-z]{4}))?(?:-([a-z]{2}))?$", 0)
    part = lambda x, i: F.regexp_extract(F.lower(text.strip(x)), "^([a-z]{2})(?:-([a-z]{4}))?(?:-([a-z]{2}))?$", i)
    valid = lambda x: (F.lower(text.strip(x)) == "x-default") | (
        (code(x) != "") & part(x, 1).isin(codes["languages"]) & ((part(x, 2) == "") | part(x, 2).isin(codes["scripts"])) & ((part(x, 3) == "") | part(x, 3).isin(codes["regions"])))
    no_op = F.array(F.lit("all"), F.lit("index"), F.lit("follow"))
    names = F.transform(F.filter(F.split(F.regexp_replace("query", "^\\?", ""), "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))
    first = pages.withColumns({
        "has_html": html, "is_2xx": two, "is_content": html & two & (F.size("redirect_chain") == 0), "has_title": full("title"), "has_meta": full("meta_description"),
        "robots_blocked": c("status").isNull() & (c("indexability") == "Non-Indexable (robots.txt)"),
        "is_live": F.coalesce((c("status") >= 200) & (c("status") < 400), F.lit(False)), "path": urls.path(c("url")), "query": urls.query(c("url")),
        "title_px": text.pixel_width(c("title"), 20), "meta_px": text.pixel_width(c("meta_description"), 14),
        "title_norm": F.lower(text.collapse(c("title"))), "h1_norm": F.lower(text.collapse(c("h1"))),
        "h1_longest": F.array_max(F.concat(F.array(F.char_length(text.strip(F.coalesce(c("h1"), F.lit(""))))), F.transform("h1_values", lambda v: F.char_length(text.strip(v))))),
        "h2_longest": F.array_max(F.transform("h2_values", lambda v: F.char_length(text.strip(v)))),
        "skips_level": F.exists(F.transform(levels, lambda x, i: F.when(i > 0, x - F.get(levels, i - 1) > 1).otherwise(False)), lambda b: b),
        "says_404": c("title").rlike(text.SOFT_404) | c("h1").rlike(text.SOFT_404),
        "directives": text.directives(c("meta_robots"), c("x_robots_tag")), "header_directives": text.directives(c("x_robots_tag")),
        "has_empty_words": F.exists("outlinks", lambda o: text.norm_anchor(o["anchor"]).isin(*text.EMPTY_WORDS)),
        "has_empty_anchor": F.exists("outlinks", lambda o: text.strip(o["anchor"]) == ""),
        "compared": c("rendered") & c("raw").isNotNull(), "raw_title_norm": text.collapse(c("raw.title")), "title_ws": text.collapse(c("title")),
        "raw_canonical_norm": text.collapse(c("raw.canonical")), "canonical_ws": text.collapse(c("canonical")),
        "raw_directives": F.array_sort(F.array_except(text.directives(c("raw.meta_robots")), no_op)), "meta_directives": F.array_sort(F.array_except(text.directives(c("meta_robots")), no_op)),
        "captured": html & c("security_headers_captured"), "frame_ancestors": F.coalesce(c("content_security_policy").rlike("(?i)(^|;)\\s*frame-ancestors\\b"), F.lit(False)),
        "hreflang_source": html & (F.size("redirect_chain") == 0) & (F.size("hreflang_links") > 0), "invalid_hreflang": F.exists("hreflang_links", lambda x: ~valid(x["lang"])),
    })
    return first.withColumns({
        "path_query": F.concat("path", "query"), "unescaped": F.regexp_replace(F.concat("path", "query"), "%[0-9A-Fa-f]{2}", ""),
        "segments": F.filter(F.split("path", "/"), lambda s: s != ""), "query_names": names})


def resource_macros(resources: DataFrame) -> DataFrame:
    return resources.withColumns({"url_local": urls.is_local(urls.host(F.col("url"))), "source_local": urls.is_local(urls.host(F.col("source_page")))})


#: Codes of two letters that the JVM still lists and the report doesn't take. Fixed values.
NO_LANGUAGES = ("in", "iw", "ji", "mo", "tl")


def iso_codes(spark) -> dict[str, list[str]]:
    """Language, region and script codes as the JVM knows them, in lower case, without the languages the report doesn't take."""
    locale = spark._jvm.java.util.Locale
    scripts = {s for tag in locale.getAvailableLocales() if (s := tag.getScript())} | {"Latn", "Cyrl", "Arab", "Hans", "Hant"}
    return {"languages": [x.lower() for x in locale.getISOLanguages() if x.lower() not in NO_LANGUAGES], "regions": [x.lower() for x in locale.getISOCountries()], "scripts": sorted(s.lower() for s in scripts)}


_DUPLICATES = {f"x_duplicate_{n}": n for n in ("title", "meta_description", "h1", "h2", "content_hash")}
FLAGS = (*_DUPLICATES, "x_canonical_broken", "x_canonical_non_indexable", "x_canonical_redirect", "x_pagination_error", "x_linked", "x_single",
         "x_links_to_error", "x_hreflang_error", "x_hreflang_no_return", "x_near_duplicate")


def last_pages(pages: DataFrame) -> DataFrame:
    """One row per URL with what a link to it meets; of equal URLs the page crawled last."""
    blocked = F.col("status").isNull() & (F.col("indexability") == "Non-Indexable (robots.txt)")
    what = F.struct(
        F.col("status").alias("t_status"), F.col("indexability").alias("t_index"), F.col("redirect_url").alias("t_redirect"), (F.size("redirect_chain") > 0).alias("t_chain"),
        F.col("seq").alias("t_seq"), (F.col("html_size_bytes") > 0).alias("t_html"), blocked.alias("t_blocked"))
    return pages.groupBy(F.col("url").alias("t_url")).agg(F.max_by(what, "seq").alias("t")).select("t_url", "t.*")


def cross_flags(pages: DataFrame, links: DataFrame, hreflang: DataFrame, near: DataFrame | None = None, list_mode: bool = False, keys: tuple[str, ...] = (), linked: DataFrame | None = None) -> DataFrame:
    """url and flags, the x_ flags that hold for it; a row per URL that has any. Only joins that the rules named by keys need are made.

    All that the joins compare is one narrow row per page or link; pages' texts and bodies are not read. linked: the URLs
    that count as linked, if a crawl kept them.
    """
    wanted = {w for r in REGISTRY if r.cross and (not keys or r.key in keys) for w in re.findall(r"x_\w+", r.test)}
    html_2xx = (F.col("html_size_bytes") > 0) & F.coalesce((F.col("status") >= 200) & (F.col("status") < 300), F.lit(False)) & (F.size("redirect_chain") == 0)
    p = pages.withColumns({"h2": F.get("h2_values", F.lit(0)), "content": html_2xx})
    non200 = ~F.col("t_blocked") & (~F.col("t_status").eqNullSafe(200) | F.col("t_chain"))
    flags: list[DataFrame] = []

    def add(name: str, urls_: DataFrame) -> None:
        flags.append(urls_.select("url", F.lit(name).alias("flag")))

    for flag, name in _DUPLICATES.items():
        if flag in wanted:
            rows = p.where(F.col("content") & (F.coalesce(name, F.lit("")) != "")).select("url", name)
            often = rows.groupBy(name).agg(F.count("*").alias("k")).where("k > 1").select(name)
            add(flag, rows.join(often, name, "left_semi"))
    if wanted & {"x_canonical_broken", "x_canonical_non_indexable", "x_canonical_redirect"}:
        tests = {
            "x_canonical_broken": F.col("t_status").isNull() | (F.col("t_status") >= 400), "x_canonical_non_indexable": F.col("t_index") != "Indexable",
            "x_canonical_redirect": F.col("t_status").between(300, 399) | (F.coalesce("t_redirect", F.lit("")) != "")}
        canon = p.where("canonical <> url").select("url", "canonical").join(last_pages(pages), F.col("canonical") == F.col("t_url"))
        held = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
        flags.append(canon.select("url", F.explode_outer(held).alias("flag")).where("flag IS NOT NULL"))
    if "x_pagination_error" in wanted:
        paged = p.select("url", F.explode(F.array_compact(F.array("pagination_next", "pagination_prev"))).alias("to")).join(last_pages(pages), F.col("to") == F.col("t_url"), "left")
        lost = F.col("t_url").isNull() if not list_mode else F.lit(False)
        add("x_pagination_error", paged.where(lost | (F.col("t_url").isNotNull() & (~F.col("t_status").eqNullSafe(200) | F.col("t_chain")))))
    if "x_linked" in wanted:
        add("x_linked", linked_urls(pages, links, hreflang) if linked is None else linked)
    if "x_single" in wanted or "x_unique_inlinks" in wanted:
        add("x_single", inlinks(links).where("unique_inlinks = 1").select(F.col("target").alias("url")))
    if "x_links_to_error" in wanted:
        bad = last_pages(pages).where(non200).select("t_url")
        add("x_links_to_error", links.where("source <> target").join(bad, F.col("target") == F.col("t_url"), "left_semi").select(F.col("source").alias("url")).distinct())
    if wanted & {"x_hreflang_error", "x_hreflang_no_return"}:
        source = p.where("html_size_bytes > 0 AND size(redirect_chain) = 0").select(F.col("url").alias("source"), "seq")
        pairs = hreflang.join(source, "source").join(last_pages(pages), F.col("href") == F.col("t_url"))
        error = non200 | (~F.col("t_blocked") & (F.col("t_index") != "Indexable"))
        if "x_hreflang_error" in wanted:
            add("x_hreflang_error", pairs.where(error).select(F.col("source").alias("url")))
        if "x_hreflang_no_return" in wanted:
            # A target of another host that comes later is never queued; the scheme and the port may differ.
            same = urls.host(F.col("source")) == urls.host(F.col("href"))
            asked = pairs.where(~error & F.col("t_html") & (F.col("source") != F.col("href")) & (same | (F.col("t_seq") < F.col("seq"))))
            back = hreflang.select(F.col("source").alias("href"), F.col("href").alias("source")).distinct()
            add("x_hreflang_no_return", asked.join(back, ["source", "href"], "left_anti").select(F.col("source").alias("url")))
    if near is not None and "x_near_duplicate" in wanted:
        add("x_near_duplicate", near)
    if not flags:
        return pages.sparkSession.createDataFrame([], "url string, flags array<string>")
    every = flags[0]
    for f in flags[1:]:
        every = every.unionByName(f)
    return every.groupBy("url").agg(F.collect_set("flag").alias("flags"))


def with_flags(pages: DataFrame, flags: DataFrame) -> DataFrame:
    """pages with every x_ column; whether a sitemap was used is one value of all pages."""
    used = pages.agg(F.coalesce(F.bool_or("discovered_via_sitemap"), F.lit(False)).alias("x_sitemap_used"))
    rows = pages.join(flags, "url", "left").crossJoin(F.broadcast(used))
    has = lambda n: F.coalesce(F.array_contains("flags", n), F.lit(False))
    return rows.withColumns({n: has(n) for n in FLAGS}).withColumn("x_unique_inlinks", F.when(has("x_single"), 1).otherwise(0)).drop("flags")


def _page_rules(flags: DataFrame | None, keys: tuple[str, ...] | None = None) -> list[Rule]:
    return [r for r in REGISTRY if r.scope == "page" and (flags is not None or not r.cross) and (not keys or r.key in keys)]


def _rows_for(pages: DataFrame, flags: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """seq, url and the macros and flags that the rules name."""
    rows = page_macros(pages)
    if flags is not None:
        rows = with_flags(rows, flags)
    named = set(re.findall(r"\w+", " ".join(r.test for r in rules))) | {"seq", "url"}
    return rows.select(*[c for c in rows.columns if c in named])


def _held(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return rows.select("seq", "url", F.array_compact(F.array(*[F.when(F.expr(r.test), F.lit(r.key)) for r in rules])).alias("issues"))


def evaluated(pages: DataFrame, flags: DataFrame | None = None, keys: tuple[str, ...] | None = None) -> DataFrame:
    """A row per page: seq, url and issues, the keys that hold (of all rules or of `keys`) in registry order."""
    rules = _page_rules(flags, keys)
    return _held(_rows_for(pages, flags, rules), rules)


def resource_issues(resources: DataFrame) -> DataFrame:
    rules = [r for r in REGISTRY if r.scope == "resource"]
    held = [F.when(F.expr(r.test), F.lit(r.key)) for r in rules] + [F.when(F.col("is_insecure"), F.lit("insecureLinks"))]
    return resource_macros(resources).select("url", F.array_compact(F.array(*held)).alias("issues"))


def registry_table(spark) -> DataFrame:
    rows = [(i, r.key, r.label, r.severity, r.group, r.section, r.scope, r.cross) for i, r in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "pos int, issue_key string, label string, severity string, issue_group string, section string, scope string, cross_page boolean")


def exploded(rows: DataFrame, *cols) -> DataFrame:
    """A row per issue key. explode() would infer a filter that repeats every rule below the macros; explode_outer doesn't."""
    return rows.select(*cols, F.explode_outer("issues").alias("issue_key")).where(F.col("issue_key").isNotNull())


def issue_long(pages: DataFrame, flags: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """url, issue_key, scope: one row per issue of a page, then of a resource."""
    rules = _page_rules(flags)
    # The macros are written first: merged into a hundred rules, the optimizer would copy each into every rule.
    rows = keep(_rows_for(pages, flags, rules), "macros")
    out = exploded(_held(rows, rules), "url").withColumn("scope", F.lit("page"))
    if resources is not None:
        out = out.unionByName(exploded(resource_issues(resources), "url").withColumn("scope", F.lit("resource")))
    return out


def issue_summary(issues: DataFrame) -> DataFrame:
    """Every rule in registry order with its page or resource count, zero included."""
    counts = issues.groupBy("issue_key", "scope").agg(F.count("*").alias("n"))
    table = registry_table(issues.sparkSession)
    return table.join(counts, ["issue_key", "scope"], "left").select("pos", "issue_key", "label", "severity", "issue_group", "section", "scope", F.coalesce("n", F.lit(0)).alias("n"))


def scope_of(key: str) -> str:
    """The table that a filter's key is about; keys of custom searches are about pages."""
    return "page" if key.startswith("custom:") or key not in BY_KEY else BY_KEY[key].scope


def filtered(rows: DataFrame, key: str, scope: str = "page", flags: DataFrame | None = None) -> DataFrame:
    """Rows of a table that a filter's key leaves: `all`, a status bucket as 2xx, a rule, or custom:<id>:contains or :missing.

    A key that is about the other table leaves all rows.
    """
    if key == "all" or (key in BY_KEY and scope_of(key) != scope):
        return rows
    if re.fullmatch("[1-5]xx", key):
        return rows.where(F.floor(F.col("status") / 100) == int(key[0]))
    if key.startswith("custom:"):
        _, rule, kind = key.split(":", 2) if key.count(":") == 2 else ("", key[7:].rpartition(":")[0], key.rpartition(":")[2])
        return rows.where(search_filter(rule, kind)) if scope == "page" else rows
    rule = BY_KEY[key]
    if scope == "resource":
        return resource_macros(rows).where(F.expr(rule.test)).select(*rows.columns)
    held = evaluated(rows, flags, (key,)).where(F.size("issues") > 0).select("seq")
    return rows.join(held, "seq", "left_semi")


def section_totals(summary: DataFrame) -> DataFrame:
    """section, total, place: sections in the order of their first rule; rules without a section are in no total."""
    rows = summary.where("section <> ''").groupBy("section").agg(F.sum("n").cast("long").alias("total"), F.min("pos").alias("first"))
    # A row per section: a window over a dozen rows.
    return rows.select("section", "total", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))

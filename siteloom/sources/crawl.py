"""A crawl over tables: what a fetcher answered is input, everything else (scope, limits, order, rows, resume) is computed.

responses(url, method, status, headers, body, error, elapsed_ms, rendered_body) holds an answer per URL and method, hops
(from_url, to_url) the redirects, robots(site, pattern, allow) the rules that hold for this crawler.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import urls
from ..functions.page_parser import parse
from ..operators.graph import follow_redirects
from ..plans.tables import keep, small
from .schema import PAGE, PARSED, complete, struct_of
from .web import header, robots_pattern, robots_rules, robots_start, sitemap_locations

MOST_PAGES, MOST_DEPTH, MOST_LIST, MOST_HISTORY = 500, 10, 50_000, 50


# --- what to crawl -------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Scope:
    """Patterns that a URL has to match one of, and those it may match none of; exclusion wins."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("include", "exclude"):
            found = tuple(x for x in (p.strip() for p in getattr(self, name)) if x)
            for i, pattern in enumerate(found):
                try:
                    re.compile(pattern)
                except re.error as e:
                    raise ValueError(f"{name} pattern {i + 1}: {e}") from None
            object.__setattr__(self, name, found)

    def allows(self, url: Column) -> Column:
        bare = F.regexp_replace(url, "#.*$", "")
        held = lambda patterns: F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.regexp_like(bare, p))
        out = held(self.include) if self.include else F.lit(True)
        return out & ~held(self.exclude) if self.exclude else out


def with_scheme(url: str, prefer_https: bool = True) -> str:
    url = url.strip()
    return url if not url or re.match(r"(?i)https?://", url) else f"{'https' if prefer_https else 'http'}://{url}"


def remembered(history: list[str], url: str) -> list[str]:
    """The most recent first, each once, MOST_HISTORY at most."""
    url = url.strip()
    return [url, *[u for u in history if u != url]][:MOST_HISTORY] if url else history


def listed(spark: SparkSession, text: DataFrame, column: str = "value") -> DataFrame:
    """line, url, valid of the non-blank lines of a table (line number in `line`); of equal URLs the first."""
    def read(batches):
        for batch in batches:
            lines = [(x or "").strip() for x in batch.column(column).to_pylist()]
            found = [urls.normalise(x) if re.match(r"(?i)https?://", x) else None for x in lines]
            yield pa.record_batch([batch.column("line"), pa.array(lines, pa.string()), pa.array(found, pa.string())], names=["line", "raw", "url"])

    rows = text.select("line", column).mapInArrow(read, "line bigint, raw string, url string").where("raw <> ''")
    good = rows.where("url IS NOT NULL").groupBy("url").agg(F.min("line").alias("line"))
    return good.select("line", "url", F.lit(True).alias("valid")).unionByName(rows.where("url IS NULL").select("line", F.col("raw").alias("url"), F.lit(False).alias("valid")))


# --- in what order -------------------------------------------------------------------------------------------------

@dataclass
class State:
    """Tables of a stopped crawl: visited(url, depth, place), frontier (the same), linked(url); scheduled: how many pages."""

    visited: DataFrame
    frontier: DataFrame
    linked: DataFrame
    scheduled: int
    start: list[str] = field(default_factory=list)


def _placed(rows: DataFrame, *order) -> DataFrame:
    """place: ascending with the order, by a distributed sort."""
    return rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id())


def begin(spark: SparkSession, start: list[str]) -> State:
    found = list(dict.fromkeys(u for u in map(urls.normalise, start) if u))
    seeds = keep(spark.createDataFrame([(u, 0, i) for i, u in enumerate(found)], "url string, depth bigint, place bigint"), "seeds")
    return State(seeds, seeds, spark.createDataFrame([], "url string"), len(found), found)


def spider(state: State, links: DataFrame, scope: Scope = Scope(), most_pages: int = MOST_PAGES, most_depth: int = MOST_DEPTH, levels: int | None = None, list_mode: bool = False) -> State:
    """The state after `levels` more levels, or at the end. links: source, pos, target.

    A page's depth is its shortest path. Within a level, pages are scheduled by their parent's place and the link's
    position until there are most_pages; what the scope excludes still counts as linked.
    """
    done = 0
    while levels is None or done < levels:
        if state.frontier.isEmpty():
            break
        ahead = state.frontier.select(F.col("url").alias("source"), "depth", F.col("place").alias("parent"))
        found = keep(links.join(ahead, "source").select(F.col("target").alias("url"), "depth", "parent", "pos"), "found")
        linked = keep(state.linked.unionByName(found.select("url")).distinct(), "linked")
        room = most_pages - state.scheduled
        fresh = found.where(F.lit(not list_mode) & (F.col("depth") < most_depth) & scope.allows(F.col("url"))).join(state.visited.select("url"), "url", "left_anti")
        fresh = keep(fresh.groupBy("url").agg(F.min(F.struct("parent", "pos")).alias("at"), F.min("depth").alias("depth")), "fresh")
        chosen = fresh.orderBy("at", "url").limit(max(room, 0)) if fresh.count() > room else fresh
        frontier = keep(_placed(chosen, "at", "url").select("url", (F.col("depth") + 1).alias("depth"), "place"), "frontier")
        state = State(keep(state.visited.unionByName(frontier), "visited"), frontier, linked, state.scheduled + frontier.count(), state.start)
        done += 1
    return state


def rescoped(state: State, scope: Scope) -> State:
    """A stopped crawl under new patterns: what they exclude leaves the frontier and is unseen again; a start URL stays."""
    stays = scope.allows(F.col("url")) | F.col("url").isin(state.start)
    frontier, dropped = keep(state.frontier.where(stays), "frontier"), state.frontier.where(~stays).select("url")
    gone = dropped.count()
    return State(keep(state.visited.join(dropped, "url", "left_anti"), "visited"), frontier, state.linked, state.scheduled - gone, state.start)


# --- rows of what was fetched --------------------------------------------------------------------------------------

def allowed_by_robots(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """pages (url) with allowed: of the site's patterns that match, the longest decides, allow on a tie.

    A pattern meets the paths that begin with its text up to the first *, or are that text if a $ ends it; only those are
    searched for what follows. So work grows with pages and rules, not with their product, but for rules of a site that
    differ behind a * only.
    """
    def compiled(batches):
        for batch in batches:
            patterns = batch.column("pattern").to_pylist()
            start, whole, more = zip(*map(robots_start, patterns)) if patterns else ((), (), ())
            yield pa.record_batch([batch.column("site"), pa.array(start, pa.string()), pa.array(whole, pa.bool_()), pa.array([robots_pattern(p) if m else None for p, m in zip(patterns, more)], pa.string()),
                                   pa.array([len(p) for p in patterns], pa.int32()), batch.column("allow")], names=["site", "start", "whole", "regex", "size", "allow"])

    rules = robots.select("site", "pattern", "allow").distinct().mapInArrow(compiled, "site string, start string, whole boolean, regex string, size int, allow boolean")
    rules = keep(rules, "robots-rules")
    sizes = rules.where("NOT whole").groupBy("site").agg(F.collect_set(F.length("start")).alias("sizes"))
    site, path_query = urls.scheme_host(F.col("url")), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    at = pages.select("url").distinct().select("url", site.alias("site"), path_query.alias("path"))
    starts = F.transform(F.filter("sizes", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = at.select("url", "site", "path", F.col("path").alias("start"), F.lit(True).alias("whole")).unionByName(
        at.join(small(keep(sizes, "robots-sizes")), "site").select("url", "site", "path", F.explode(starts).alias("start"), F.lit(False).alias("whole")))
    met = keys.join(small(rules), ["site", "start", "whole"]).where("regex IS NULL OR regexp_like(path, regex)")
    best = met.groupBy("url").agg(F.max(F.struct("size", "allow")).alias("best"))
    return pages.join(best, "url", "left").withColumn("allowed", F.coalesce(F.col("best.allow"), F.lit(True))).drop("best")


def answered(responses: DataFrame) -> DataFrame:
    """One answer per URL: that to HEAD, unless it failed with 400 or more and GET was answered, then that; else GET's."""
    rank = F.when((F.col("method") == "HEAD") & (F.coalesce("status", F.lit(999)) < 400), 0).when(F.col("method") == "GET", 1).otherwise(2)
    row = F.struct(rank.alias("rank"), *[F.col(c) for c in responses.columns if c != "url"])
    return responses.groupBy("url").agg(F.min_by(row, rank).alias("r")).select("url", "r.*").drop("rank")


_RAW = ("title", "meta_description", "h1", "canonical", "meta_robots", "word_count", "internal_link_count")
_SIGNALS = struct_of(PARSED)


def _signals(columns: tuple[str, ...]) -> list[T.StructField]:
    return [f for f in _SIGNALS.fields if not columns or f.name in (*columns, "canonical", "meta_robots")]


def _parser(ended: bool, columns: tuple[str, ...]):
    wanted = tuple(f.name for f in _signals(columns))
    schema = to_arrow_schema(T.StructType([*[T.StructField(n, t) for n, t in (("url", T.StringType()), ("rendered", T.BooleanType()))], *_signals(columns), PAGE["raw"]]))

    def run(batches):
        for batch in batches:
            rows = []
            for url, at, body, shown in zip(*(batch.column(c).to_pylist() for c in ("url", "final", "body", "rendered_body"))):
                # With a rendered document its signals are the page's, and the plain one's are kept to compare.
                plain = parse(body, at, wanted if shown is None else _RAW if shown else {*wanted, *_RAW}, ended=ended)
                found = parse(shown, at, wanted, ended=ended) if shown else {k: plain[k] for k in wanted}
                rows.append({"url": url, "rendered": shown is not None, "raw": {k: plain[k] for k in _RAW} if shown is not None else None} | found)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def page_rows(requests: DataFrame, responses: DataFrame, hops: DataFrame, robots: DataFrame, start: list[str] = (), ended: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """Page rows of requests (seq, url, depth, discovered_via_sitemap), one each; ended: see parse().

    All columns, or what a fetch tells and the named signals only.

    Blocked by robots.txt: no status. No answer: an error row. Redirected, but not a start URL: the destination's status
    and headers, no content. Not HTML: the headers. HTML: all signals, resolved on the destination's URL.
    """
    at = keep(allowed_by_robots(requests, robots), "requests")
    chains = follow_redirects(hops, at.where("allowed").select("url"))
    rows = at.join(chains, "url", "left").join(answered(responses).withColumnRenamed("url", "final"), "final", "left")
    is_html = F.coalesce(F.contains(F.lower(header(F.col("headers"), "content-type")), F.lit("html")), F.lit(False))
    moved = F.col("final") != F.col("url")
    kind = (F.when(~F.col("allowed"), "blocked").when(F.col("status").isNull(), "failed").when(moved & ~F.col("url").isin(list(start)), "redirected")
            .when(F.col("error").isNotNull(), "unread").when(~is_html, "other").otherwise("html"))
    rows = keep(rows.withColumn("kind", kind), "answers")
    schema = ", ".join(["url string", "rendered boolean", *[f"{f.name} {f.dataType.simpleString()}" for f in _signals(columns)], f"raw {PAGE['raw'].dataType.simpleString()}"])
    parsed = rows.where("kind = 'html'").select("url", "final", "body", "rendered_body").mapInArrow(_parser(ended, columns), schema)
    rows = rows.drop("body", "rendered_body").join(parsed, "url", "left")
    h = lambda name: header(F.col("headers"), name)
    live = F.col("kind").isin("redirected", "unread", "other", "html")
    noindex = lambda c: F.coalesce(F.lower(c).contains("noindex"), F.lit(False))
    on = lambda c: F.when(live, c)
    indexability = (
        F.when(F.col("kind") == "blocked", "Non-Indexable (robots.txt)").when(F.col("kind").isin("failed", "unread"), "Non-Indexable (Error)")
        .when((F.col("status") >= 400) | (F.col("status") == 0), F.concat(F.lit("Non-Indexable ("), F.col("status").cast("string"), F.lit(")")))
        .when(moved, "Redirected").when(noindex(F.col("meta_robots")) | noindex(h("x-robots-tag")), "Non-Indexable (noindex)")
        .when((F.col("canonical") != F.col("url")) & (F.col("canonical") != F.col("final")), "Canonicalised").otherwise("Indexable"))
    text = F.when(F.col("kind") == "blocked", "Blocked").when(F.col("kind") == "failed", "Error").otherwise(
        F.concat(F.col("status").cast("string"), F.when(F.col("capped"), " (redirect loop or too many hops)").otherwise("")))
    rows = rows.withColumns({
        "status_text": text, "indexability": indexability, "content_type": on(h("content-type")), "redirect_url": F.when(live & moved, F.col("final")),
        "redirect_chain": on(F.col("chain")), "response_time_ms": F.col("elapsed_ms"), "hsts": on(h("strict-transport-security").isNotNull()),
        "content_security_policy": on(h("content-security-policy")), "x_frame_options": on(h("x-frame-options")), "x_content_type_options": on(h("x-content-type-options")),
        "referrer_policy": on(h("referrer-policy")), "x_robots_tag": on(h("x-robots-tag")), "security_headers_captured": live, "status": on(F.col("status")).cast("int")})
    return complete(rows)


def checked_resources(resources: DataFrame, responses: DataFrame) -> DataFrame:
    """Resource rows with status, error and size of the answer to HEAD, or to GET where HEAD failed."""
    found = answered(responses).select(F.col("url").alias("r_url"), F.col("status").alias("r_status"), F.col("error").alias("r_error"), F.expr("try_cast(try_element_at(headers, 'content-length') AS bigint)").alias("r_size"))
    rows = resources.drop("status", "status_text", "error", "content_length").join(found, resources["url"] == found["r_url"], "left")
    return rows.withColumns({"status": F.col("r_status").cast("int"), "status_text": F.coalesce(F.col("r_status").cast("string"), F.lit("Error")), "error": F.when(F.col("r_status").isNull(), F.coalesce("r_error", F.lit("no answer"))),
                             "content_length": F.col("r_size")}).drop("r_url", "r_status", "r_error", "r_size")


# --- robots.txt and sitemaps as tables -----------------------------------------------------------------------------

def robots_table(files: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """(site, pattern, allow) and (site, crawl_delay_ms) of files (site, text) for one crawler."""
    def read(batches):
        for batch in batches:
            rows = []
            for site, text in zip(batch.column("site").to_pylist(), batch.column("text").to_pylist()):
                rules, delay = robots_rules(text or "", agent)
                rows += [(site, p, a, None) for p, a in rules]
                rows += [(site, None, None, int(delay * 1000))] if delay is not None else []
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["site", "pattern", "allow", "crawl_delay_ms"])

    found = keep(files.select("site", "text").mapInArrow(read, "site string, pattern string, allow boolean, crawl_delay_ms bigint"), "robots")
    return found.where("pattern IS NOT NULL").select("site", "pattern", "allow"), found.where("crawl_delay_ms IS NOT NULL").select("site", "crawl_delay_ms")


def sitemap_urls(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct normal URLs of the sitemaps (url, xml) that roots (url) name; an index is followed one level deep."""
    def read(batches):
        for batch in batches:
            rows = []
            for url, xml in zip(batch.column("url").to_pylist(), batch.column("xml").to_pylist()):
                index, found = sitemap_locations(xml or "")
                rows += [(url, index, to) for x in found if (to := urls.normalise(x))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.string()))], names=["url", "is_index", "loc"])

    found = keep(files.select("url", "xml").mapInArrow(read, "url string, is_index boolean, loc string"), "sitemaps")
    top = found.join(roots.select("url").distinct(), "url", "left_semi")
    below = found.where("NOT is_index").join(top.where("is_index").select(F.col("loc").alias("url")).distinct(), "url", "left_semi")
    return top.where("NOT is_index").select("loc").unionByName(below.select("loc")).distinct().withColumnRenamed("loc", "url")


def sitemap_roots(sites: DataFrame, robots_files: DataFrame) -> DataFrame:
    """site, url: the sitemaps that a site's robots.txt names, else /sitemap.xml."""
    lines = robots_files.select("site", F.explode(F.split("text", "\r?\n")).alias("line"))
    named = lines.select("site", F.regexp_extract("line", "(?i)^\\s*sitemap\\s*:\\s*(\\S+)", 1).alias("url")).where("url <> ''").distinct()
    return sites.join(named, "site", "left").select("site", F.coalesce("url", F.concat("site", F.lit("/sitemap.xml"))).alias("url"))


# --- what is known of a site ---------------------------------------------------------------------------------------

def dispatch_times(requests: DataFrame, delays: DataFrame, delay_ms: int = 0) -> DataFrame:
    """requests (site, place) with at_ms, when each may start: a site's crawl delay (site, crawl_delay_ms) and the user's, the longer, lie between two."""
    wait = F.greatest(F.coalesce("crawl_delay_ms", F.lit(0)), F.lit(delay_ms))
    place = F.row_number().over(Window.partitionBy("site").orderBy("place")) - 1
    return requests.join(delays, "site", "left").withColumn("at_ms", (place * wait).cast("long")).drop("crawl_delay_ms")


def site_info(sites: DataFrame, responses: DataFrame, hosts: DataFrame) -> DataFrame:
    """sites (site) with llms_txt_url, llms_txt_found, and the lookup's ip_addresses, hosting_org and hosting_country.

    hosts: site, ip, org, isp, asn, country; the organisation is that of the first address, by its first known name.
    """
    rows = sites.withColumn("llms_txt_url", F.concat("site", F.lit("/llms.txt")))
    found = answered(responses).select(F.col("url").alias("llms_txt_url"), F.col("status").between(200, 299).alias("ok"))
    known = hosts.groupBy("site").agg(F.array_sort(F.collect_set("ip")).alias("ip_addresses"), F.min_by(F.struct(F.coalesce("org", "isp", "asn").alias("org"), "country"), "ip").alias("first"))
    rows = rows.join(found, "llms_txt_url", "left").join(known, "site", "left")
    return rows.select("site", "llms_txt_url", F.coalesce("ok", F.lit(False)).alias("llms_txt_found"), F.coalesce("ip_addresses", F.array().cast("array<string>")).alias("ip_addresses"),
                       F.col("first.org").alias("hosting_org"), F.col("first.country").alias("hosting_country"))

"""Sources that are functions of text: URL lists, robots.txt, sitemaps, headers and HTML of known technologies."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_low
from ..functions.urls import normalise


def url_list(text: str) -> tuple[list[str], list[str]]:
    """Valid and invalid lines; absolute http(s) only, fragments gone, the first of equals kept."""
    valid, invalid = {}, []
    for line in filter(None, (x.strip() for x in text.splitlines())):
        url = normalise(line)
        if url:
            valid.setdefault(url)
        else:
            invalid.append(line)
    return list(valid), invalid


def robots_rules(text: str, agent: str) -> tuple[list[tuple[str, bool]], float | None]:
    """(pattern, allowed) of the groups that name the agent, else of `*`, and the crawl delay."""
    token = re.match(r"[^/\s]*", agent)[0].lower()
    groups: dict[str, list] = {}
    delays: dict[str, float] = {}
    names: list[str] = []
    fresh = False
    for line in text.lstrip("﻿").splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*(names if fresh else []), value.lower()]
            fresh = True
            for n in names:
                groups.setdefault(n, [])
        elif field in ("allow", "disallow"):
            fresh = False
            if value:
                for n in names:
                    groups[n].append((value, field == "allow"))
        elif field == "crawl-delay":
            fresh = False
            try:
                for n in names:
                    delays.setdefault(n, float(value))
            except ValueError:
                pass
    own = token if token in groups else "*"
    return groups.get(own, []), delays.get(own)


def _robots_text(pattern: str) -> tuple[str, bool]:
    """The pattern in the escapes of a normal URL, and whether a $ ends it."""
    anchored = pattern.endswith("$")
    return quote(pattern.removesuffix("$") if anchored else pattern, safe="/%?=&*$:;,@!'()+~.-_"), anchored


def robots_pattern(pattern: str) -> str:
    text, anchored = _robots_text(pattern)
    body = "".join(".*" if c == "*" else re.escape(c) for c in text)
    return f"^{body}" + ("$" if anchored else "")


def robots_start(pattern: str) -> tuple[str, bool, bool]:
    """What every path begins with that the pattern matches, whether such a path is that text, and whether more than that text decides."""
    text, anchored = _robots_text(pattern)
    start, star, rest = text.partition("*")
    return start, anchored and not star, bool(star) and (anchored or bool(rest))


def robots_allowed(path_query: Column, rules: list[tuple[str, bool]]) -> Column:
    """The longest matching pattern decides, allow on a tie; without a match allowed. A plain CASE over the rules."""
    out = F.lit(True)
    for pattern, allowed in sorted(rules, key=lambda r: (len(r[0]), r[1])):
        out = F.when(path_query.rlike(robots_pattern(pattern)), F.lit(allowed)).otherwise(out)
    return out


def sitemap_locations(xml: str) -> tuple[bool, list[str]]:
    """Whether the document is an index, and its <loc> values."""
    try:
        root = ET.fromstring(xml.lstrip("﻿ \r\n\t"))
    except ET.ParseError:
        return False, [x.strip() for x in re.findall(r"<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>", xml, re.S)]
    return root.tag.endswith("sitemapindex"), [e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and (e.text or "").strip()]


#: Substrings of lower-cased HTML that give away a content system (the first that any sign of holds) or a library
#: (all that hold), and response headers that give away a network. Fixed values.
CMS = (
    ("WordPress", ("wp-content", "wp-includes")), ("Drupal", ("/sites/default/files", "drupal.settings")), ("Joomla", ("joomla!", "/media/jui/")),
    ("Shopify", ("cdn.shopify.com", "shopify.theme")), ("Wix", ("static.wixstatic.com", "wix.com")), ("Squarespace", ("squarespace",)),
    ("Webflow", ("cdn.webflow.com",)),
)
TECHNOLOGIES = (
    ("Next.js", ("_next/static", "__next_data__")), ("Nuxt.js", ("__nuxt__",)), ("Angular", ("ng-version",)), ("React", ("data-reactroot", "react-dom")),
    ("Vue.js", ("data-v-app", "vue.js", "__vue__")), ("jQuery", ("jquery",)), ("Bootstrap", ("bootstrap",)), ("Tailwind CSS", ("tailwind",)),
    ("Google Tag Manager", ("googletagmanager.com/gtm.js",)), ("Google Analytics", ("google-analytics.com", "gtag(")), ("jsDelivr CDN", ("cdn.jsdelivr.net",)),
)
#: (network, header, substring of its value; none: the header alone is enough), in order of precedence.
NETWORKS = (
    ("Cloudflare", "cf-ray", ""), ("Cloudflare", "server", "cloudflare"), ("Amazon CloudFront", "x-amz-cf-id", ""), ("Fastly", "x-served-by", "cache"),
    ("Vercel", "x-vercel-id", ""), ("Netlify", "x-nf-request-id", ""), ("Akamai", "x-akamai-request-id", ""), ("Akamai", "server", "akamaighost"),
)


def _any_sign(low: Column, signs: tuple[str, ...]) -> Column:
    held = F.lit(False)
    for sign in signs:
        held = held | low.contains(sign)
    return held


def detect_cms(html: Column) -> Column:
    low, out = ascii_low(html), F.lit(None).cast("string")
    for name, signs in reversed(CMS):
        out = F.when(_any_sign(low, signs), name).otherwise(out)
    return out


def detect_technologies(html: Column) -> Column:
    low = ascii_low(html)
    return F.array_compact(F.array(*[F.when(_any_sign(low, signs), F.lit(name)) for name, signs in TECHNOLOGIES]))


def header(headers: Column, name: str) -> Column:
    """A response header by its lower-case name; headers: map of lower-case names."""
    return F.try_element_at(headers, F.lit(name))


def detect_from_headers(headers: Column) -> Column:
    """struct<server, powered_by, cdn>."""
    cdn = F.lit(None).cast("string")
    for network, name, part in reversed(NETWORKS):
        value = header(headers, name)
        cdn = F.when(F.coalesce(ascii_low(value).contains(part), F.lit(False)) if part else value.isNotNull(), network).otherwise(cdn)
    return F.struct(header(headers, "server").alias("server"), header(headers, "x-powered-by").alias("powered_by"), cdn.alias("cdn"))


def accessibility_violations(json: Column) -> Column:
    """The violations of a scanner's JSON list: id, impact, description, help_url, node_count; empty for other input."""
    raw = F.from_json(json, "array<struct<id:string,impact:string,description:string,helpUrl:string,nodes:array<string>>>")
    return F.coalesce(F.transform(raw, lambda v: F.struct(
        F.coalesce(v["id"], F.lit("unknown")).alias("id"), v["impact"].alias("impact"), F.coalesce(v["description"], F.lit("")).alias("description"),
        F.coalesce(v["helpUrl"], F.lit("")).alias("help_url"), F.greatest(F.size(v["nodes"]), F.lit(0)).cast("long").alias("node_count"))),
        F.array().cast("array<struct<id:string,impact:string,description:string,help_url:string,node_count:bigint>>"))


def resource_queue(rows: DataFrame) -> DataFrame:
    """First discoverer of each resource URL by (seq, pos)."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("url").orderBy("seq", "pos"))).where("rn = 1").drop("rn")

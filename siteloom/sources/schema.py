"""Schemas of the page and resource tables; every column a page row may have, with the value of an unknown one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _parts(text: str) -> list[str]:
    """Parts of a comma list, commas inside angle brackets apart."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> T.DataType:
    head, _, inner = text.partition("<")
    inner = inner[:-1]
    if head == "array":
        return T.ArrayType(_type(inner))
    if head == "map":
        return T.MapType(*[_type(x) for x in _parts(inner)])
    if head == "struct":
        return T.StructType([T.StructField(n, _type(t)) for n, t in (x.split(":", 1) for x in _parts(inner))])
    return _PLAIN[head]


def struct_of(text: str) -> T.StructType:
    """The schema of a DDL list, also where no session runs (Python workers)."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (x.split(" ", 1) for x in _parts(text))])


_LINK = "array<struct<url:string,anchor:string,nofollow:boolean,is_image_link:boolean>>"
_VIOLATION = "array<struct<id:string,impact:string,description:string,help_url:string,node_count:bigint>>"
_RAW = "struct<title:string,meta_description:string,h1:string,canonical:string,meta_robots:string,word_count:bigint,internal_link_count:bigint>"
PARSED = (
    "title string, title_length bigint, title_count bigint, meta_description string, meta_description_length bigint, meta_description_count bigint, "
    "h1 string, h1_count bigint, h1_values array<string>, h2_count bigint, h2_values array<string>, heading_levels array<int>, meta_refresh string, "
    "meta_robots string, viewport string, has_open_graph boolean, has_twitter_card boolean, canonical string, canonical_count bigint, "
    "canonical_is_relative boolean, pagination_next string, pagination_prev string, lang string, hreflang_values array<string>, "
    "hreflang_links array<struct<lang:string,href:string>>, word_count bigint, content_hash string, content_simhash string, has_lorem_ipsum boolean, "
    f"internal_link_count bigint, external_link_count bigint, internal_nofollow_count bigint, unsafe_cross_origin_links bigint, outlinks {_LINK}, "
    "image_count bigint, missing_alt_count bigint, images_missing_dimensions bigint, insecure_link_count bigint, mixed_content_count bigint, "
    "html_size_bytes bigint, minify_savings_pct double, is_minified boolean, text_ratio_pct double, structured_data_types array<string>, "
    "structured_data_errors array<string>")
FETCHED = (
    "seq bigint, url string, depth bigint, status int, status_text string, content_type string, redirect_url string, redirect_chain array<string>, "
    "indexability string, response_time_ms bigint, rendered boolean, hsts boolean, content_security_policy string, x_frame_options string, "
    "x_content_type_options string, referrer_policy string, security_headers_captured boolean, x_robots_tag string, discovered_via_sitemap boolean, "
    f"accessibility_violations {_VIOLATION}, mobile_usability_violations {_VIOLATION.replace('impact:string,', '')}, "
    f"custom_search_counts map<string,bigint>, extracted map<string,array<string>>, raw {_RAW}, error string")
PAGE = struct_of(f"{FETCHED}, {PARSED}")
RESOURCE = struct_of(
    "url string, resource_type string, source_page string, alt_text string, status int, status_text string, is_internal boolean, is_insecure boolean, "
    "error string, content_length bigint")
#: Unknown values that aren't null or empty.
DEFAULTS = {"is_minified": True, "status_text": "", "indexability": "Indexable"}


def _unknown(field: T.StructField):
    kind = field.dataType
    if field.name in DEFAULTS:
        return F.lit(DEFAULTS[field.name])
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, (T.LongType, T.DoubleType)):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def complete(df: DataFrame, schema: T.StructType = PAGE) -> DataFrame:
    """df with every column of the schema; missing ones, and nulls where null isn't a value, get the unknown value."""
    nullable = (T.StringType, T.IntegerType, T.StructType)
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(_unknown(f).alias(f.name))
        elif isinstance(f.dataType, nullable) and f.name not in DEFAULTS:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.coalesce(F.col(f.name).cast(f.dataType), _unknown(f)).alias(f.name))
    return df.select(*cols)

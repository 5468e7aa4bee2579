"""Columns over stored posts: slugs, paths, headings with anchors, reading time, media keys. All of them stay in the JVM.

A null input gives null, but for reading_minutes (1) and the array functions (empty).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

SLUG_MAX, WORDS_A_MINUTE = 100, 200
_MARKS = "[\\u0300-\\u036f]"
_HEADING = "(?s)<h([23])((?: [^>]*)?)>(.*?)</h[23]>"
_MEDIA = "/media/([A-Za-z0-9-]+\\.[A-Za-z0-9]+)"


@cache
def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is an ASCII character and combining marks, and that character."""
    found = {}
    for code in range(0x80, 0x2FFF):
        parts = [x for x in unicodedata.normalize("NFD", chr(code)) if not "̀" <= x <= "ͯ"]
        if len(parts) == 1 and parts[0].isascii() and parts[0].isalnum():
            found[chr(code)] = parts[0]
    return "".join(found), "".join(found.values())


def _ascii(c: Column, also: str = "", to: str = "") -> Column:
    accented, plain = _accents()
    return F.regexp_replace(F.lower(F.regexp_replace(F.translate(c, accented + also, plain + to), _MARKS, "")), "[^a-z0-9]+", "-")


def slug(c: Column) -> Column:
    """At most SLUG_MAX characters of a-z, 0-9 and single hyphens between them."""
    return F.regexp_replace(F.substring(F.regexp_replace(_ascii(c, "đĐ", "dd"), "^-", ""), 1, SLUG_MAX), "-$", "")


def category_slug(c: Column) -> Column:
    return F.regexp_replace(_ascii(c), "^-|-$", "")


def post_path(category: Column, post_slug: Column) -> Column:
    """/category/slug, or /slug where the category is null or has no usable letter."""
    part = F.coalesce(category_slug(strip(category)), F.lit(""))
    return F.when(part == "", F.concat(F.lit("/"), post_slug)).otherwise(F.concat(F.lit("/"), part, F.lit("/"), post_slug))


def without_tags(c: Column) -> Column:
    # One pass is enough: what is left has no < before a later > but in "<>".
    return F.regexp_replace(c, "<[^>]+>", "")


def decoded(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def headings(html: Column) -> Column:
    """array<struct<id, text, level>> of the h2 and h3 with text; a repeated id gets -1, -2 and so on."""
    html = F.coalesce(html, F.lit(""))
    levels, inner = F.regexp_extract_all(html, F.lit(_HEADING), F.lit(1)), F.regexp_extract_all(html, F.lit(_HEADING), F.lit(3))
    read = F.zip_with(levels, inner, lambda level, body: F.struct(strip(decoded(without_tags(body))).alias("text"), level.cast("int").alias("level")))
    read = F.filter(read, lambda h: h["text"] != "")
    read = F.transform(read, lambda h: F.struct(F.coalesce(F.nullif(category_slug(h["text"]), F.lit("")), F.lit("section")).alias("slug"), h["text"].alias("text"), h["level"].alias("level")))

    def numbered(h, i):
        earlier = F.size(F.filter(F.slice(read, F.lit(1), i), lambda x: x["slug"] == h["slug"]))
        return F.struct(F.when(earlier > 0, F.concat_ws("-", h["slug"], earlier.cast("string"))).otherwise(h["slug"]).alias("id"), h["text"].alias("text"), h["level"].alias("level"))

    return F.transform(read, numbered)


def reading_minutes(c: Column) -> Column:
    body = strip(F.coalesce(c, F.lit("")))
    words = F.when(body == "", 0).otherwise(F.size(F.split(body, "(?U)\\s+")))
    return F.greatest(F.lit(1), F.floor(words / WORDS_A_MINUTE + 0.5)).cast("long")


def media_keys(content: Column, cover: Column) -> Column:
    """Distinct keys of /media/ paths in the content, then the cover's, a path or a bare key; other covers are not ours."""
    cover = F.coalesce(cover, F.lit(""))
    path = F.regexp_extract(cover, _MEDIA, 1)
    own = F.when(path != "", path).when(cover.rlike("^[A-Za-z0-9-]+\\.[A-Za-z0-9]+\\z"), cover)
    return F.array_distinct(F.concat(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(_MEDIA), F.lit(1)), F.array_compact(F.array(own))))


def removed_media(content: Column, cover: Column, content_after: Column, cover_after: Column) -> Column:
    return F.array_except(media_keys(content, cover), media_keys(content_after, cover_after))


def takeaways(c: Column) -> Column:
    """The non-blank strings of a JSON array, trimmed; empty for null or anything else."""
    raw = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    text = F.transform(raw, lambda v: F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))))
    return F.coalesce(F.filter(text, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def faqs(c: Column) -> Column:
    """array<struct<question, answer>> of a JSON array's objects that have both as non-blank strings; empty for anything else."""
    raw = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")

    def one(v, name):
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        return F.when(kind == "STRING", strip(F.try_variant_get(v, f"$.{name}", "string")))

    read = F.transform(raw, lambda v: F.struct(one(v, "question").alias("question"), one(v, "answer").alias("answer")))
    full = lambda x: x.isNotNull() & (x != "")
    return F.coalesce(F.filter(read, lambda x: full(x["question"]) & full(x["answer"])), F.array().cast("array<struct<question:string,answer:string>>"))

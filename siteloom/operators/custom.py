"""Custom search and custom extraction: rules that a user brings along, checked before a plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.page_parser import body_text
from ..functions.selectors import document, select, selector

MOST_RULES, MOST_VALUES, MOST_CHARS = 10, 10, 500
#: What the linear-time dialect of rules lacks: look-around and back references.
_BEYOND = re.compile(r"\(\?<?[=!]|\\[1-9]|\(\?P=")


@dataclass(frozen=True)
class Search:
    id: str
    pattern: str
    is_regex: bool = False
    scope: str = "html"
    name: str = ""


@dataclass(frozen=True)
class Extract:
    id: str
    selector: str
    mode: str = "text"
    attr: str = ""
    name: str = ""


def _named(kind: str, rule, place: int) -> str:
    return f'{kind} "{rule.name.strip()}"' if rule.name.strip() else f"{kind} {place + 1}"


def checked_searches(rules: list[Search]) -> list[Search]:
    """Rules that have a pattern; ValueError that names the first bad one."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} custom searches, not {len(rules)}")
    out = []
    for i, rule in enumerate(rules):
        if not rule.pattern.strip():
            continue
        label = _named("custom search", rule, i)
        if not rule.id.strip():
            raise ValueError(f"{label} has no id")
        if rule.scope not in ("html", "text"):
            raise ValueError(f"{label}: unknown scope {rule.scope}")
        if rule.is_regex:
            if _BEYOND.search(rule.pattern):
                raise ValueError(f"{label}: look-around and back references aren't supported")
            try:
                re.compile(rule.pattern)
            except re.error as e:
                raise ValueError(f"{label}: {e}") from None
        out.append(rule)
    return out


def checked_extractions(rules: list[Extract]) -> list[Extract]:
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} extractions, not {len(rules)}")
    out = []
    for i, rule in enumerate(rules):
        if not rule.selector.strip():
            continue
        label = _named("extraction", rule, i)
        if not rule.id.strip():
            raise ValueError(f"{label} has no id")
        try:
            selector(rule.selector)
        except ValueError as e:
            raise ValueError(f"{label}: {e}") from None
        if rule.mode not in ("text", "attr", "inner_html"):
            raise ValueError(f"{label}: unknown mode {rule.mode}")
        if rule.mode == "attr" and not rule.attr.strip():
            raise ValueError(f"{label} names no attribute")
        out.append(rule)
    return out


def extracted(html: str | None, rules: list[tuple[Extract, list]]) -> dict[str, list[str]]:
    """Rule id to its first values in document order; every rule has an entry."""
    root = document(html or "")
    out = {}
    for rule, compiled in rules:
        values = out[rule.id] = []
        for node in select(root, compiled):
            if rule.mode == "text":
                value = " ".join(node.text().split())
            elif rule.mode == "attr":
                value = node.attrs.get(rule.attr.strip().lower(), "").strip()
            else:
                value = node.inner_html().strip()
            if value:
                values.append(value[:MOST_CHARS])
            if len(values) == MOST_VALUES:
                break
    return out


def match_count(subject: Column, rule: Search) -> Column:
    """Non-overlapping matches: a literal in any case, or a regex as written."""
    pattern = rule.pattern if rule.is_regex else "(?iu)\\Q" + rule.pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(F.coalesce(subject, F.lit("")), F.lit(pattern)).cast("long")


def _reader(rules: list[Extract], want_text: bool, names: list[str]):
    def run(batches):
        compiled = [(r, selector(r.selector)) for r in rules]
        for batch in batches:
            pages = batch.column(batch.schema.names.index("html")).to_pylist()
            found = [list(extracted(h, compiled).items()) if compiled else [] for h in pages]
            texts = [body_text(h) if want_text else None for h in pages]
            yield pa.record_batch(
                [*[batch.column(batch.schema.names.index(n)) for n in names], pa.array(found, pa.map_(pa.string(), pa.list_(pa.string()))), pa.array(texts, pa.string())],
                names=[*names, "extracted", "body_text"])

    return run


def with_custom(pages: DataFrame, searches: list[Search] = (), extractions: list[Extract] = ()) -> DataFrame:
    """pages (with html) with custom_search_counts and extracted; every rule has an entry on every page.

    Searches of the HTML stay in the JVM; the visible text and the elements need one Arrow pass over the HTML.
    """
    searches, extractions = checked_searches(list(searches)), checked_extractions(list(extractions))
    need = bool(extractions) or any(r.scope == "text" for r in searches)
    if need:
        kept = [f for f in pages.schema.fields if f.name not in ("extracted", "body_text")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        pages = pages.mapInArrow(_reader(extractions, any(r.scope == "text" for r in searches), [f.name for f in kept]), f"{schema}, extracted map<string,array<string>>, body_text string")
    pairs = [x for r in searches for x in (F.lit(r.id), match_count(F.col("html" if r.scope == "html" else "body_text"), r))]
    counts = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>")
    return pages.withColumn("custom_search_counts", counts).drop("body_text")


def search_filter(rule_id: str, kind: str) -> Column:
    """Pages that contain the rule's pattern or miss it; a page on which the rule never ran is neither."""
    n = F.try_element_at("custom_search_counts", F.lit(rule_id))
    return F.coalesce(n > 0 if kind == "contains" else n == 0, F.lit(False))


def search_totals(pages: DataFrame, rules: list[Search]) -> DataFrame:
    """rule, contains, missing over the pages' counts; a rule that no page has is 0 and 0."""
    counts = pages.select(F.explode("custom_search_counts").alias("rule", "n")).groupBy("rule").agg(F.count_if(F.col("n") > 0).alias("contains"), F.count_if(F.col("n") == 0).alias("missing"))
    table = pages.sparkSession.createDataFrame([(r.id,) for r in rules], "rule string")
    return table.join(counts, "rule", "left").select("rule", F.coalesce("contains", F.lit(0)).alias("contains"), F.coalesce("missing", F.lit(0)).alias("missing"))


def extraction_ids(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(F.map_keys("extracted")).alias("rule")).distinct()


def reconciled(rules: list, previous: list, same, fresh) -> tuple[list, dict[str, str]]:
    """Rules of a continued crawl: one whose id meant something else before gets a fresh id; and the ids so renamed."""
    import dataclasses

    before = {r.id: r for r in previous}
    out, renamed = [], {}
    for r in rules:
        if r.id in before and not same(before[r.id], r):
            renamed[r.id] = fresh()
            r = dataclasses.replace(r, id=renamed[r.id])
        out.append(r)
    return out, renamed


def merged(previous: list, following: list) -> list:
    """All rules that pages of a continued crawl may have results for: the earlier ones, brought up to date, then the new."""
    by_id, known = {r.id: r for r in following}, {r.id for r in previous}
    return [by_id.get(r.id, r) for r in previous] + [r for r in following if r.id not in known]

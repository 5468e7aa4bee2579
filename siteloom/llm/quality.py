"""Quality rules: a threshold table compiled into one projection, without user functions.

Each row of RULES names a ratio, its bounds and the least number of words from which it holds; compiled() turns the
table into Boolean columns of one select. base_failed follows the fixed base rules; kept is false if base_failed, else
whether every rule of the table holds.

Edge cases: a null or empty text has no words and fails the base; ties and repeated rows are judged row by row; an
empty table gives an empty table; only doc_id and text are read, so other columns cannot clash.

Scale: no shuffle; a task holds one text at a time. Repeated 5-word windows are found by sorting a text's own window
hashes, so the work grows with n log n of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, word_list

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of English, German, French and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from "
    "der die das und ist von den mit im ein eine des auf für nicht sich dem "
    "le la les de des et un une du que qui dans pour par sur est en au "
    "el los las y una con por para se del como su al lo"
).split()
#: (rule, metric, lowest, highest, words from which the rule holds)
RULES = [
    ("word_length", "mean_word_chars", 2.0, 16.0, 10),
    ("symbols", "symbols_per_word", 0.0, 0.3, 10),
    ("exclamation", "bangs_per_word", 0.0, 0.5, 10),
    ("letters", "letter_words", 0.6, 1.0, 10),
    ("stop_words", "stop_words", 0.02, 1.0, 80),
    ("repeated_lines", "repeated_lines", 0.0, 0.5, 10),
]


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; hashes: of the windows in order."""
    paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(p):
        twice = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at):
        return F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda s, x: s + x)

    return _let(_let(paired, marked), covered)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that base and rules need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("__t")).select("doc_id", "__t", word_list(F.col("__t")).alias("__w"))
    base = base.withColumn("n_words", F.size("__w").cast("long"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
        lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(WINDOW)]))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    base = base.select(
        "doc_id", "n_words", "__t",
        F.when(F.col("n_words") >= WINDOW, windows).alias("__h"), lines.alias("__l"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("__stop"),
        F.size(F.filter("__w", lambda w: w.rlike("\\p{L}"))).alias("__letters"),
    )
    gone = lambda chars: F.char_length("__t") - F.char_length(F.translate("__t", chars, ""))
    return base.select(
        "doc_id", "n_words",
        F.char_length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__h").isNull() | (F.size(F.array_distinct("__h")) == F.size("__h")), 0)
        .otherwise(_repeat_words(F.col("__h"))).cast("long").alias("n_repeat_words"),
        gone("!").alias("__bangs"), "__stop", "__letters", F.size("__l").alias("__lines"),
    )


METRICS = {
    "mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "bangs_per_word": ("__bangs", "n_words"), "letter_words": ("__letters", "n_words"),
    "stop_words": ("__stop", "n_words"), "repeated_lines": ("n_dup_lines", "__lines"),
}


def compiled(rules: list[tuple]) -> dict[str, Column]:
    """rule -> true where it fails: compares products, so no division by zero."""
    out = {}
    for name, metric, low, high, least in rules:
        top, bottom = (F.col(c).cast("double") for c in METRICS[metric])
        out[name] = (F.col("n_words") >= least) & ((top < F.lit(low) * bottom) | (top > F.lit(high) * bottom))
    return out


def digest(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    fails = compiled(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    any_fails = F.lit(False)
    for failed in fails.values():
        any_fails = any_fails | failed
    failed_rules = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in fails.items()])), ",")
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~any_fails).alias("kept"), failed_rules.alias("failed_rules"),
    )


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FAILS = {
    name: f"(n_words >= {least} AND ({top} < {low} * {bottom} OR {top} > {high} * {bottom}))"
    for name, metric, low, high, least in RULES
    for top, bottom in [[{"__bangs": "bangs", "__letters": "letters", "__stop": "stops", "__lines": "lines"}.get(c, c) for c in METRICS[metric]]]
}
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n >= 2) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(replace(t, '!', '')) AS bangs, len(l) AS lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS stops,
         len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS letters
  FROM d LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(_FAILS.values())}) AS kept,
       concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _FAILS.items())}) AS failed_rules
FROM b
"""

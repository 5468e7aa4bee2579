"""Personal data by bootstrapped contextual extraction; only DataFrame functions run.

Base: four fixed patterns (email, ip, card, phone), leftmost and non-overlapping per kind; a match that fails its test
(parts of an ip, digits and Luhn sum of a card, digits of a phone) is dropped.

Bootstrapping: base spans, whole, and tokens outside them that hold a digit or @ are instances; numbers that follow each
other by one space are one token; tokens of under 6 characters are none. Seeds are the base spans and tokens that can
only be machine-made secrets (SECRET: long hexadecimal strings, keys with an issuer's prefix). Each occurrence has
lexical patterns: the two words to its left, the two to its right, and one on either side, none of which holds anything
of the instance itself; the word before with the coarse shape; and the exact shape. Digits of context words are alike.
In each round a pattern's confidence is the score of its distinct instances by their number plus one, patterns count only
with enough distinct instances that are seeds or were found with high confidence in a round before, and an instance's
score is the best confidence of its patterns; seeds stay at 1. After the rounds, seeds outside base spans and occurrences
that a pattern of high confidence matches are added, as kind `other`. Context is read from the 80 characters on either
side of an occurrence, which hold the two words that patterns take unless these are longer.

Edge cases: a null text is empty and has no spans; texts of any length are searched whole, with patterns that cannot
backtrack far; a null doc_id is kept; repeated rows get equal spans; an empty table gives an empty table; only doc_id
and text are read, so other columns cannot clash.

Scale: texts are never shuffled; what is shuffled is a row per match and per candidate token. Patterns and instances are
counted with map-side sums over distinct pairs, and joined by shuffle. Positions are running sums within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, keep

KINDS = ("email", "ip", "card", "phone")
#: As given, in forms that start only where a match can start and never backtrack into what they have taken.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[(]?[0-9][0-9()./-]*+(?![^\x20\x09-\x0D]))*+"
SECRET = r"^(?:(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,128}|(?:AKIA|ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,128})$"
ROUNDS, SEEDS, CONFIDENT = 2, 5, 0.85
CONTEXT = 80


def _luhn(digits: Column) -> Column:
    """Digit sum with every second digit from the right doubled, as a multiple of 10."""
    places = F.split(F.reverse(digits), "")
    # split(x, '') may leave an empty last piece.
    values = F.transform(F.filter(places, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10 == 0


def _passes(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.char_length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"))
        .when(kind == "card", F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", (n >= 9) & (n <= 15))
        .otherwise(True)
    )


def _matches(kind: str, pattern: str, may_match: Column) -> Column:
    """Array of (kind, i, gap, hit, left, right): the matches in order, each with the characters since the one before."""
    hits, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    # Bound to a variable, both arrays are evaluated once; the gap behind the last match has no hit.
    def placed(s):
        hit, gap = s["hits"], s["gaps"]
        at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
        left = lambda i: F.right(F.concat(F.right(at(gap, i - 1), F.lit(CONTEXT)), at(hit, i - 1), F.right(at(gap, i), F.lit(CONTEXT))), F.lit(CONTEXT))
        right = lambda i: F.left(F.concat(F.left(at(gap, i + 1), F.lit(CONTEXT)), at(hit, i + 1), F.left(at(gap, i + 2), F.lit(CONTEXT))), F.lit(CONTEXT))
        return F.transform(hit, lambda h, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.char_length(F.get(gap, i)).alias("gap"), h.alias("hit"), left(i).alias("left"), right(i).alias("right")))

    found = F.get(F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), placed), F.lit(0))
    return F.when(may_match, found).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,hit:string,left:string,right:string>>"))


def located(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, hit, left, right of every match; a row without matches has one row with a null kind."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digit, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    arrays = [
        _matches("email", PATTERNS["email"], at), _matches("ip", PATTERNS["ip"], digit & F.col("text").contains(".")),
        _matches("card", PATTERNS["card"], digit), _matches("phone", PATTERNS["phone"], digit & F.col("text").contains("+")),
        _matches("token", TOKEN, digit | at),
    ]
    found = rows.select("row", "doc_id", F.explode_outer(F.concat(*arrays)).alias("m"))
    found = found.select("row", "doc_id", "m.kind", "m.i", "m.gap", "m.hit", "m.left", "m.right").withColumn("n", F.char_length("hit"))
    run = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run))
    found = found.where(F.col("kind").isNull() | (F.col("kind") == "token") | _passes(F.col("kind"), F.col("hit")) | (F.col("i") == 0))
    # A first match that fails stays as the document's row, without kind.
    good = F.col("kind").isNotNull() & _passes(F.col("kind"), F.col("hit"))
    return found.select(
        "row", "doc_id", F.when(good, F.col("kind")).alias("kind"), (F.col("end") - F.col("n")).cast("long").alias("start"),
        F.col("end").cast("long").alias("end"), "hit", "left", "right")


def candidates(found: DataFrame) -> DataFrame:
    """Base spans, and tokens outside them without their edge marks: row, start, end, instance, patterns, base, seed."""
    base, token = F.col("kind").isin(*KINDS), F.col("kind") == "token"
    lead = F.char_length(F.regexp_extract("hit", "^[\\[(<{\"'`]*", 0))
    body = F.regexp_replace(F.regexp_replace("hit", "^[\\[(<{\"'`]*+", ""), "[\\])>}\"'`.,;:!?]++$", "")
    rows = found.where("kind IS NOT NULL").withColumn("body", F.when(token, body).otherwise(F.col("hit"))).withColumn("lead", F.when(token, lead).otherwise(0))
    rows = rows.withColumn("start", F.col("start") + F.col("lead")).withColumn("end", F.col("start") + F.char_length("body"))
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("row").orderBy("start", "end").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("reach", F.max(F.when(base, F.col("end"))).over(upto)).withColumn("next", F.min(F.when(base, F.col("start"))).over(onward))
    covered = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    # A token that a base span overlaps is no instance of its own: the whole span is.
    rows = rows.where(base | (token & (F.char_length("body") >= 6) & ~covered))
    plain = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(ascii_lower(c), "[0-9]++", "9"), "[\\x20\\x09-\\x0D]++", " "), F.lit(" "))
    # The marks at a token's edges belong to neither side; those at a base span's edges are taken off as well.
    left = plain(F.regexp_replace("left", "[\\[(<{\"'`]++$", ""))
    right = plain(F.regexp_replace("right", "^[\\])>}\"'`.,;:!?]++", ""))
    rows = rows.withColumn("l", left).withColumn("r", right)
    word, after = F.substring_index("l", " ", -1), F.substring_index("r", " ", 1)
    two_l, two_r = F.substring_index("l", " ", -2), F.substring_index("r", " ", 2)
    full = lambda c: c.contains(" ")
    shape = F.regexp_replace(F.translate(ascii_lower(F.col("body")), "bcdefghijklmnopqrstuvwxyz012345678", "a" * 25 + "9" * 9), "a++", "a")
    coarse = F.regexp_replace(shape, "9++", "9")
    patterns = F.array(
        F.when(full(two_l), F.concat_ws(" ", F.lit("left"), two_l)), F.when(full(two_r), F.concat_ws(" ", F.lit("right"), two_r)),
        F.when((word != "") & (after != ""), F.concat_ws(" ", F.lit("around"), word, F.lit("_"), after)),
        F.concat_ws(" ", F.lit("before"), word, coarse), F.concat_ws(" ", F.lit("shape"), shape))
    return rows.select("row", "start", "end", ascii_lower(F.col("body")).alias("instance"), base.alias("base"), (base | F.col("body").rlike(SECRET)).alias("seed"), F.array_compact(patterns).alias("patterns"))


def confident_patterns(tokens: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """Patterns whose confidence reaches the threshold after the rounds."""
    edges = keep(tokens.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-graph")
    own = keep(edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score")), "instances")
    for last in range(rounds):
        scored = edges.drop("seed").join(own, "instance")
        patterns = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.sum((F.col("score") >= confident).cast("long")).alias("seeds"))
        patterns = keep(patterns.where((F.col("seeds") >= seeds) & (F.col("confidence") >= confident / 2)), "patterns")
        if last + 1 < rounds:
            best = edges.join(patterns, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
            own = keep(own.join(best, "instance", "left").select("instance", F.greatest("score", F.coalesce("best", F.lit(0.0))).alias("score")), "instances")
    return patterns.where(F.col("confidence") >= confident).select("pattern")


def digest(docs: DataFrame) -> DataFrame:
    found = keep(located(docs), "matches")
    tokens = keep(candidates(found), "tokens")
    free = tokens.where("NOT seed").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    more = free.join(confident_patterns(tokens), "pattern").select("row", "start", "end").distinct()
    more = more.unionByName(tokens.where("seed AND NOT base").select("row", "start", "end"))
    spans = found.select("row", "doc_id", "kind", "start", "end").where("kind IS NULL OR kind <> 'token'").unionByName(
        more.withColumn("kind", F.lit("other")), allowMissingColumns=True)
    # A row without base matches may only have tokens: every row keeps one line.
    spans = spans.unionByName(found.where("kind = 'token'").groupBy("row").agg(F.min_by("doc_id", "start").alias("doc_id")), allowMissingColumns=True)
    place = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "other")]), F.col("kind"))
    one = F.struct(place.alias("place"), F.col("start"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    grouped = spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"__{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("all"))
    base = F.filter("all", lambda x: x["place"] <= len(KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    return grouped.select(
        "doc_id", *[F.coalesce(f"__{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))

from pyspark.sql import functions as F

from siteloom.functions import posts, text, urls
from siteloom.functions.page_parser import parse
from siteloom.operators.issues import REGISTRY
from siteloom.sources import web


def test_hashes():
    assert f"{text.fnv1a(b''):016x}" == "cbf29ce484222325" and f"{text.fnv1a(b'a'):016x}" == "af63dc4c8601ec8c"
    assert text.simhash("too short") == "" and len(text.simhash("word " * 30)) == 16


def test_simhash_equals_a_plain_loop():
    import random

    rng = random.Random(5)
    for n in (19, 20, 21, 300):
        words = [rng.choice(["Ärger", "the", "x", "ΣΑΣ", "a-b", "9", "don't", "longer" * 9]) for _ in range(n)]
        votes = [0] * 64
        for i in range(n - 2):
            h = text.fnv1a(" ".join(w.lower() for w in words[i : i + 3]).encode())
            votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
        want = f"{sum(1 << b for b, v in enumerate(votes) if v > 0):016x}" if n >= 20 else ""
        assert text.simhash(" ".join(words)) == want
        assert text.simhash(" \n - ".join(f'("{w}_,' for w in words)) == want


def test_urls():
    assert urls.normalise("HTTP://Example.com:80/a/../b?x=é#f") == "http://example.com/b?x=%C3%A9"
    assert urls.normalise("https://example.com") == "https://example.com/" and urls.normalise("ftp://x/") is None and urls.normalise(None) is None
    assert urls.resolve("https://example.com/a/b", "../c d") == "https://example.com/c%20d"
    assert all(urls.resolve("https://example.com/", h) is None for h in ("", "#x", "mailto:a@b", "javascript:1", None))


def test_parser_reads_signals():
    html = """<html lang=" en "><head><title> A &amp; B </title><meta name="description" content="d"><link rel="canonical" href="/c">
    <meta name=robots content="noindex"><meta name="googlebot"><link rel=alternate hreflang=de href=/de><script type="application/ld+json">{"@type":"Article","@graph":[{"@type":"Person"}]}</script></head>
    <body><h1>One</h1><h3>Three</h3><p>hello<p>world <a href="/x" rel="nofollow">go</a><a href="http://other.com/" target=_blank><img src=i.png></a><script>ignored words</script></body></html>"""
    r = parse(html, "https://example.com/p")
    assert (r["title"], r["lang"], r["canonical"], r["canonical_is_relative"]) == ("A & B", "en", "https://example.com/c", True)
    assert r["heading_levels"] == [1, 3] and r["word_count"] == 5 and r["structured_data_types"] == ["Person", "Article"]
    assert (r["internal_link_count"], r["internal_nofollow_count"], r["external_link_count"], r["unsafe_cross_origin_links"], r["insecure_link_count"]) == (1, 1, 1, 1, 1)
    assert (r["image_count"], r["missing_alt_count"], r["images_missing_dimensions"]) == (1, 1, 1)
    assert parse(None, "https://e.com/")["word_count"] == 0


def test_robots_and_sitemap():
    rules, delay = web.robots_rules("User-agent: a\nUser-agent: bot\nDisallow: /x\nAllow: /x/y$\nCrawl-delay: 2\nUser-agent: *\nDisallow: /", "Bot/1.0")
    assert rules == [("/x", False), ("/x/y$", True)] and delay == 2.0
    assert web.sitemap_locations("<urlset><url><loc> https://a/ </loc></url></urlset>") == (False, ["https://a/"])
    assert web.url_list("https://a.com/#x\nhttps://a.com/\nnope") == (["https://a.com/"], ["nope"])


def test_registry_is_whole():
    assert len(REGISTRY) == 105 and len({r.key for r in REGISTRY}) == 105 and sum(r.cross for r in REGISTRY) == 17
    assert {s: sum(r.severity == s for r in REGISTRY) for s in ("bad", "warn", "info")} == {"bad": 17, "warn": 50, "info": 38}


def test_columns(spark):
    df = spark.createDataFrame([("Click here…", "googlebot: noindex, max-snippet: 20", "/a/b?c")], "a string, r string, p string")
    row = df.select(text.norm_anchor(F.col("a")), text.directives(F.col("r")), text.pixel_width(F.lit("iii"), 1000), web.robots_allowed(F.col("p"), [("/a", False), ("/a/b", True)])).first()
    assert list(row) == ["click here", ["noindex", "max-snippet:20"], 666, True]


def test_posts(spark):
    html = "<h2>Giá &amp; <b>phí</b></h2><h3 class=x> </h3><h3>gia phi</h3><h2>!</h2><h1>no</h1>"
    rows = spark.createDataFrame([("Hướng dẫn Đặt: 2!", html, '<img src="/media/a-1.png"><img src="/media/b.jpg">/media/a-1.png', "c.webp"), (None, None, None, None)], "a string, h string, m string, k string")
    c = F.col
    got = rows.select(posts.slug(c("a")), posts.category_slug(c("a")), posts.headings(c("h")), posts.media_keys(c("m"), c("k")),
                      posts.removed_media(c("m"), c("k"), F.lit("/media/b.jpg"), F.lit("https://x/y")), posts.reading_minutes(c("a")), posts.post_path(F.lit(" ! "), F.lit("s"))).collect()
    assert list(got[0])[:2] == ["huong-dan-dat-2", "huong-dan-at-2"]
    assert [tuple(h) for h in got[0][2]] == [("gia-phi", "Giá & phí", 2), ("gia-phi-1", "gia phi", 3), ("section", "!", 2)]
    assert list(got[0])[3:] == [["a-1.png", "b.jpg", "c.webp"], ["a-1.png", "c.webp"], 1, "/s"]
    assert list(got[1]) == [None, None, [], [], [], 1, "/s"]
    assert [r[0] for r in rows.limit(1).select(posts.slug(F.lit("x" * 99 + " yz"))).collect()] == ["x" * 99]


def test_references_without_a_semicolon_stay_if_asked():
    from siteloom.functions.page_parser import parse

    html = ('<title>A &amp;&amp; B&amp;&amp</title><body><script type="application/ld+json">{"@type": "A&ampB"}</script><h1>x &copy y &amphello; &#38; &#38x; &#x26; &nope; &copy;&</h1>'
            '<a href="/q?a=1&copy=2&amp;b&amp">t &amp</a></body>')
    p, q = (parse(html, "https://e.com/", ended=e) for e in (True, False))
    assert (p["title"], p["title_length"], p["h1"]) == ("A && B&&amp", 11, "x &copy y &amphello; & &#38x; & &nope; ©&")
    assert (p["structured_data_types"], p["outlinks"][0]["url"], p["outlinks"][0]["anchor"]) == (["A&ampB"], "https://e.com/q?a=1&copy=2&b&amp", "t &amp")
    assert (q["title"], q["h1"], q["structured_data_types"]) == ("A && B&&", "x © y &hello; & &x; & &nope; ©&", ["A&ampB"])
    plain = "<title>A &amp; B</title><p>&copy; \ue000</p>"
    assert parse(plain, "https://e.com/", ended=True) == parse(plain, "https://e.com/")


def test_pages_and_fetched_rows_keep_a_reference_that_is_cut(spark, tmp_path):
    from siteloom.sources import crawl
    from siteloom.sources.corpus import corpus_pages

    html = "<title>a &amp;&amp</title><body>b&amp</body>"
    spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    row = corpus_pages(spark, str(tmp_path)).first()
    assert (row.title, row.title_length, row.text_ratio_pct) == ("a &&amp", 7, len(" b&amp ") / len(html) * 100)
    requests = spark.createDataFrame([(1, "https://e.com/", 0, False)], "seq long, url string, depth long, discovered_via_sitemap boolean")
    answer = "url string, method string, status int, headers map<string,string>, body string, error string, elapsed_ms long, rendered_body string"
    responses = spark.createDataFrame([("https://e.com/", "GET", 200, {"content-type": "text/html"}, html, None, 1, None)], answer)
    none = spark.createDataFrame([], "from_url string, to_url string"), spark.createDataFrame([], "site string, pattern string, allow boolean")
    assert [crawl.page_rows(requests, responses, *none, ended=e).first().title for e in (True, False)] == ["a &&amp", "a &&"]

import datetime
import time

import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.functions.selectors import document, select, selector
from siteloom.operators import compare, custom, graph, issues
from siteloom.sources import blog, crawl, export, simweb
from siteloom.sources.schema import PAGE, complete
from siteloom.streaming import trackers

SF = "/root/testdata/sf0.001"
HTML = """<html><body><div id=a class="x y"><p>one<p lang=en-US>two <b>bold</b></p><ul><li>1<li class=k>2<li data-v="a b">3</ul></div>
<section><h2>T</h2><p>after</p><a href="/p?q=1" title='say "hi"'>go</a><a>no</a></section></body></html>"""


@pytest.mark.parametrize("css, want", [
    ("p", ["one", "two bold", "after"]), ("div > p:first-child", ["one"]), ("#a.x.y li", ["1", "2", "3"]), ("li:nth-child(2n+1)", ["1", "3"]), ("li:not(.k)", ["1", "3"]), ("li.k + li", ["3"]), ("li ~ li", ["2", "3"]),
    ("[lang|=en]", ["two bold"]), ("[data-v~='b']", ["3"]), ("a[href^='/p'], h2", ["T", "go"]), ("a[href*='q=']", ["go"]), ("section > a:last-child", ["no"]), ("ul *", ["1", "2", "3"]), ("a[title$='\"hi\"' i]", ["go"]), ("body p b", ["bold"]), ("p b:only-child", ["bold"])])
def test_selectors(css, want):
    assert [" ".join(n.text().split()) for n in select(document(HTML), selector(css))] == want


@pytest.mark.parametrize("css", ["", "p >", "[", "p:hover", "a[b=", ":nth-child(x)", "p,,b", "..x"])
def test_bad_selectors_are_refused(css):
    with pytest.raises(ValueError):
        selector(css)


def test_rules_are_checked_and_named():
    S, E = custom.Search, custom.Extract
    with pytest.raises(ValueError, match='custom search "n"'):
        custom.checked_searches([S("a", "x"), S("b", "(", True, name="n")])
    with pytest.raises(ValueError, match="custom search 1 has no id"):
        custom.checked_searches([S(" ", "x")])
    with pytest.raises(ValueError, match="look-around"):
        custom.checked_searches([S("a", "(?=x)", True)])
    with pytest.raises(ValueError, match="at most 10"):
        custom.checked_searches([S(str(i), "x") for i in range(11)])
    with pytest.raises(ValueError, match="extraction 2 names no attribute"):
        custom.checked_extractions([E("a", "p"), E("b", "p", "attr")])
    assert custom.checked_searches([S("a", "  ")]) == [] and custom.checked_extractions([E("a", " ")]) == []
    with pytest.raises(ValueError, match="exclude pattern 2"):
        crawl.Scope(exclude=("", "a", "("))


def test_extraction_modes_and_caps():
    rules = [(r, selector(r.selector)) for r in (custom.Extract("t", "p"), custom.Extract("a", "a", "attr", "TITLE"), custom.Extract("h", "section p, h2", "inner_html"), custom.Extract("n", "video"))]
    assert custom.extracted(HTML, rules) == {"t": ["one", "two bold", "after"], "a": ['say "hi"'], "h": ["T", "after"], "n": []}
    many = "".join(f"<i>{'x' * 600}</i>" for _ in range(20))
    got = custom.extracted(many, [(custom.Extract("i", "i"), selector("i"))])["i"]
    assert len(got) == 10 and {len(x) for x in got} == {500}


def test_continued_rules():
    E = custom.Extract
    old, new = [E("a", "p"), E("b", "h1")], [E("a", "p", name="renamed"), E("b", "h2"), E("c", "b")]
    got, renamed = custom.reconciled(new, old, lambda x, y: x.selector == y.selector, lambda: "fresh")
    assert renamed == {"b": "fresh"} and [r.id for r in got] == ["a", "fresh", "c"]
    assert [(r.id, r.selector) for r in custom.merged(old, got)] == [("a", "p"), ("b", "h1"), ("fresh", "h2"), ("c", "b")]


def test_start_urls():
    assert crawl.with_scheme(" a.com ") == "https://a.com" and crawl.with_scheme("HTTP://a.com") == "HTTP://a.com" and crawl.with_scheme("a.com", False) == "http://a.com"
    assert crawl.remembered(["a", "b"], " b ") == ["b", "a"] and len(crawl.remembered([str(i) for i in range(50)], "x")) == 50
    assert urls.shown("https://x/caf%C3%A9%2F%20a") == "https://x/café%2F a" and urls.shown("https://x/%E9") == "https://x/%E9" and urls.shown("a%2") == "a%2"
    assert compare.host_input("https://Staging.example.com/x") == "staging.example.com" and compare.host_input("localhost:3000") == "localhost:3000" and compare.host_input(" ") == "" == compare.host_input("a b")


def test_spider_limits_list_mode_and_resume(spark):
    links = spark.createDataFrame([(f"https://e.com/{a}", p, f"https://e.com/{b}") for a, p, b in [(0, 0, 1), (0, 1, 2), (0, 2, "x9"), (1, 0, 3), (1, 1, 0), (2, 0, 4), (3, 0, 5)]], "source string, pos int, target string")
    at = lambda s: {r.url[14:]: r.depth for r in s.visited.collect()}
    start = crawl.begin(spark, ["https://e.com/0#x", "https://e.com/0"])
    scope = crawl.Scope(exclude=("/x",))
    assert at(crawl.spider(start, links, scope)) == {"0": 0, "1": 1, "2": 1, "3": 2, "4": 2, "5": 3}
    assert at(crawl.spider(start, links, scope, most_pages=4)) == {"0": 0, "1": 1, "2": 1, "3": 2}
    assert at(crawl.spider(start, links, scope, most_depth=1)) == {"0": 0, "1": 1, "2": 1}
    only = crawl.spider(start, links, scope, list_mode=True)
    assert at(only) == {"0": 0} and {r.url[14:] for r in only.linked.collect()} == {"1", "2", "x9"}
    stopped = crawl.spider(start, links, scope, levels=1)
    narrowed = crawl.rescoped(stopped, crawl.Scope(exclude=("/2$", "/0$")))
    assert narrowed.scheduled == 2 and at(narrowed) == {"0": 0, "1": 1}
    assert at(crawl.spider(narrowed, links, crawl.Scope(exclude=("/2$",)))) == {"0": 0, "1": 1, "3": 2, "5": 3}
    assert "x9" in {r.url[14:] for r in crawl.spider(start, links, scope).linked.collect()}


def test_redirects(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")] + [(f"n{i}", f"n{i + 1}") for i in range(12)], "from_url string, to_url string")
    got = {r.url: r for r in graph.follow_redirects(hops, spark.createDataFrame([("a",), ("c",), ("x",), ("n0",)], "url string")).collect()}
    assert (got["a"].final, got["a"].chain, got["a"].capped) == ("c", ["a", "b"], False) and got["c"].chain == []
    assert got["x"].capped and got["n0"].final == "n10" and got["n0"].capped


def test_rendered_pages_keep_the_plain_signals(spark):
    requests = spark.createDataFrame([(0, "https://e.com/", 0, False)], "seq long, url string, depth long, discovered_via_sitemap boolean")
    answer = [("https://e.com/", "GET", 200, {"content-type": "text/html"}, "<title>raw</title>", None, 7, "<title>shown</title><body><p>a b c")]
    responses = spark.createDataFrame(answer, "url string, method string, status int, headers map<string,string>, body string, error string, elapsed_ms long, rendered_body string")
    none = spark.createDataFrame([], "from_url string, to_url string")
    row = crawl.page_rows(requests, responses, none, spark.createDataFrame([], "site string, pattern string, allow boolean")).first()
    assert (row.title, row.raw.title, row.rendered, row.word_count, row.response_time_ms, row.redirect_chain) == ("shown", "raw", True, 3, 7, [])
    keys = {k for r in issues.evaluated(spark.createDataFrame([row], PAGE)).collect() for k in r.issues}
    assert {"jsChangesTitle", "jsAddsMostContent"} <= keys


def test_documents(spark, tmp_path):
    pages = complete(spark.createDataFrame([(1, "https://e.com/", "=1+1", {"s": 2}, {"e2": ["a", "b"], "e10": []}), (0, "https://e.com/b", '-say "x"', {}, {"z": ["q"]})],
                                           "seq long, url string, title string, custom_search_counts map<string,long>, extracted map<string,array<string>>"))
    table = export.pages_table(pages, [custom.Search("s", "pat", name="Same")], [custom.Extract("e10", "p"), custom.Extract("e2", "b", name="p")])
    assert len(export.PAGE_COLUMNS) == 64 and table.columns[64:] == ["Custom Search: Same", "Extraction: p", "Extraction: p (2)", "Extraction: z"]
    got = {r["URL"]: r for r in table.collect()}
    assert got["https://e.com/"]["Title"] == "'=1+1" and got["https://e.com/"]["Extraction: p (2)"] == "a | b" and got["https://e.com/b"]["Custom Search: Same"] == ""
    export.write_csv(table.select("URL", "Title"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2
    rows = pages.select("seq", F.col("url").alias("URL"), F.col("title").alias("Issue"))
    export.write_document(rows, ["seq"], ["URL", "Issue"], str(tmp_path / "doc"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert raw.decode() == '﻿"URL","Issue"\r\n"https://e.com/b","\'-say ""x"""\r\n"https://e.com/","\'=1+1"\r\n'
    export.write_text(spark, "é\n", f"file://{tmp_path}/note.txt")
    assert (tmp_path / "note.txt").read_text() == "é\n"
    row = spark.createDataFrame([("\tx", "+1")], "a string, b string").select(export.safe_cell(F.col("a")), export.safe_cell(F.col("a"), False), export.csv_field(F.col("b"))).first()
    assert list(row) == ["'\tx", "\tx", "\"'+1\""]


def test_snapshots_and_backups(spark, tmp_path):
    pages, resources = simweb.sim_pages(spark, SF), simweb.sim_resources(spark, SF)
    export.write_snapshot(pages, resources, str(tmp_path / "snap"))
    back, again = export.read_snapshot(spark, str(tmp_path / "snap"))
    assert back.schema.simpleString() == pages.schema.simpleString() and again.schema.simpleString() == resources.schema.simpleString()
    key = lambda df: sorted(repr(r.asDict(True)) for r in df.collect())
    assert key(back) == key(pages) and key(again) == key(resources)
    (tmp_path / "old" / "pages").mkdir(parents=True)
    (tmp_path / "old" / "resources").mkdir()
    (tmp_path / "old" / "pages" / "a.json").write_text('{"seq": 1, "url": "u"}\n')
    (tmp_path / "old" / "resources" / "a.json").write_text('{"url": "r", "status_text": "Checking"}\n')
    old, some = export.read_snapshot(spark, str(tmp_path / "old"))
    assert old.first().is_minified and old.first().outlinks == [] and export.checked_count(some).first().checked == 0
    assert export.backup(resources, str(tmp_path), "t", datetime.datetime(2026, 1, 2)).endswith("/t/2026-01-02T00-00-00Z")


def test_stream_states_equal_batch_after_every_batch(spark, tmp_path):
    pages = simweb.sim_pages(spark, SF)
    parts = [pages.where(F.col("seq") % 3 == i) for i in range(3)]
    tracked = trackers.Tracked()
    key = lambda df: sorted(repr(r.asDict(True)) for r in df.collect())
    for i, part in enumerate(parts):
        tracked.use(part, i)
        tracked.use(part, i)
        want = trackers.of_batch(pages.where(F.col("seq") % 3 <= i))
        for name in trackers.TRACKERS:
            assert key(tracked.states[name]) == key(want[name]), (i, name)


def test_comparable_families(spark):
    page = lambda **v: complete(spark.createDataFrame([(1, "u", 1)], "seq long, url string, x int").drop("x").withColumns({k: F.lit(x) for k, x in v.items()}))
    assert all(compare.captured(page()).first())
    lost = {r.issue_key for r in compare.incomparable((page(h1_count=2, word_count=30, status=200, rendered=True, internal_link_count=1, title="t", image_count=1), None), (page(), None)).collect()}
    assert lost == {k for f, keys in compare.FAMILIES.items() if f != "hreflang links" for k in keys}


def test_a_stopped_stream_goes_on_from_its_folder(spark, tmp_path):
    pages = simweb.sim_pages(spark, SF)
    key = lambda df: sorted(repr(r.asDict(True)) for r in df.collect())
    for i in range(2):
        pages.where(F.col("seq") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        tracked = trackers.Tracked(spark, f"file://{tmp_path}/states", ("duplicates", "pages", "progress"))
        assert tracked.last == i - 1
        trackers.track(rows, tracked, str(tmp_path / "checkpoint")).awaitTermination()
    want = trackers.of_batch(pages)
    assert all(key(trackers.Tracked(spark, f"file://{tmp_path}/states", ("duplicates", "pages", "progress")).states[n]) == key(want[n]) for n in ("duplicates", "pages", "progress"))


def test_blog_tables(spark):
    df = spark.createDataFrame([(1, "a", 1_700_000_000, None), (2, "a", None, 1_700_000_000_000)], "id long, username string, created_at long, password_changed_at long")
    users = blog.table(df, "users")
    assert users.columns == blog.USERS.names and dict(users.dtypes)["created_at"] == "timestamp"
    assert users.where("id = 1").first().created_at == users.where("id = 2").first().password_changed_at
    assert [tuple(r) for r in blog.repeated_keys(users, "users").collect()] == [("a", 2)]
    assert blog.table(df.select("id"), "settings").columns == ["key", "value"]


def test_throttling_keeps_the_last():
    now, got = [0.0], []
    t = trackers.Throttled(got.append, 1.0, lambda: now[0])
    for at, x in ((0.0, "a"), (0.2, "b"), (0.9, "c"), (1.1, "d"), (1.2, "e"), (1.3, "f")):
        now[0] = at
        t.offer(x)
    assert got == ["a", "d"]
    t.flush()
    t.flush()
    assert got == ["a", "d", "f"]
    t.offer("g")
    t.cancel()
    t.flush()
    assert got == ["a", "d", "f"]


def test_progress_tells_the_end(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in"))
    told: list = []
    listener = trackers.Progress(lambda rows, done: told.append((rows, done)))
    spark.streams.addListener(listener)
    rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    for _ in range(100):
        if told and told[-1][1]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert told[-1] == (30, True)


_RULES = "site string, pattern string, allow boolean"


def test_robots_equal_a_plain_loop(spark):
    import random
    import re

    from siteloom.sources.web import robots_pattern

    rng = random.Random(3)
    text = lambda letters, n: "/" + "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    rules = [(f"https://e{rng.randrange(3)}.com", text("ab/?é", 4) + rng.choice(["", "", "*", "*b", "*/*a", "**"]) + rng.choice(["", "$"]), rng.random() < 0.5) for _ in range(120)]
    rules += [("https://e0.com", p, False) for p in ("", "$", "*", "*$", "*b$", "/a.b", "/$a", "/%41")] + [("https://e1.com", "/ab", True), ("https://e1.com", "/ab", False)]
    pages = [f"https://e{rng.randrange(5)}.com{rng.choice(['', text('ab/?', 7), text('ab', 3).replace('b', '%C3%A9')])}" for _ in range(400)]
    pages += ["https://e0.com/a.b", "https://e0.com/axb", "https://e0.com/$a", "https://e0.com/%41"]

    def want(url):
        site, path = re.match("([a-z]+://[^/?#]*)(.*)", url).groups()
        return max(((len(p), allow) for s, p, allow in rules if s == site and re.search(robots_pattern(p), path)), default=(0, True))[1]

    rows = spark.createDataFrame([(i, u) for i, u in enumerate(pages)] + [(-1, None)], "seq long, url string")
    got = {r.seq: r.allowed for r in crawl.allowed_by_robots(rows, spark.createDataFrame(rules, _RULES)).collect()}
    assert got == {-1: True} | {i: want(u) for i, u in enumerate(pages)} and len(set(got.values())) == 2


def test_robots_with_many_rules_of_one_site(spark):
    n = 30_000
    pages = spark.range(n).select(F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("url"))
    rule = lambda end, allow: F.struct(F.lit("https://e.com").alias("site"), F.concat(F.lit("/"), F.col("id").cast("string"), F.lit(end)).alias("pattern"), F.lit(allow).alias("allow"))
    # A page's own rule is the longest that matches it.
    robots = spark.range(n).select(F.when(F.col("id") % 2 == 0, rule("$", False)).otherwise(rule("", True)).alias("r")).select("r.*")
    began = time.monotonic()
    got = crawl.allowed_by_robots(pages, robots).where("NOT allowed").count()
    assert got == n // 2 and time.monotonic() - began < 30


def test_fetched_rows_with_named_signals(spark):
    requests = spark.createDataFrame([(i, f"https://e.com/{i}", 0, False) for i in range(4)], "seq long, url string, depth long, discovered_via_sitemap boolean")
    html = '<title>T{}</title><meta name=robots content=noindex><h1>h</h1><a href="/x">x</a>'
    answers = [(f"https://e.com/{i}", "GET", 200, {"content-type": "text/html"}, html.format(i), None, 1, shown) for i, shown in enumerate([None, "", "<title>shown</title><link rel=canonical href=/c>", None])]
    responses = spark.createDataFrame(answers, "url string, method string, status int, headers map<string,string>, body string, error string, elapsed_ms long, rendered_body string")
    hops, robots = spark.createDataFrame([], "from_url string, to_url string"), spark.createDataFrame([("https://e.com", "/3", False)], _RULES)
    every, some = ({r.url: r for r in crawl.page_rows(requests, responses, hops, robots, columns=c).collect()} for c in ((), ("title",)))
    told = ("status", "indexability", "title", "canonical", "meta_robots", "rendered", "raw")
    assert {u: [r[c] for c in told] for u, r in some.items()} == {u: [r[c] for c in told] for u, r in every.items()}
    assert [every[f"https://e.com/{i}"].indexability for i in range(4)] == ["Non-Indexable (noindex)"] * 2 + ["Canonicalised", "Non-Indexable (robots.txt)"]
    assert [some["https://e.com/1"][c] for c in ("title", "h1", "word_count")] == ["T1", None, 0] and some["https://e.com/2"].raw.internal_link_count == 1

import duckdb
import pytest

from siteloom.plans import blog_queries, catalogue, crawl_queries  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["duplicate_titles", "heading_outline", "html_size_and_minify", "url_tree", "url_audit", "title_pixel_width", "page_signals", "rich_signals", "outlinks", "robots_table", "sitemap_walk", "custom_search_counts", "content_hash_duplicates",
        "inlink_counts", "crawl_diff", "issue_summary", "issue_long", "bfs_depth", "scoped_crawl", "fetched_pages", "mobile_audit", "custom_extraction", "pages_csv", "sliding_lockout", "status_changes",
        "vote_scores", "comment_threads", "post_paths", "reading_time", "simhash_pairs", "stream_windowed_counts", "draft_errors", "header_tech"]


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, want.fetchall())


def test_near_duplicates_of_made_up_fingerprints(spark):
    from siteloom.operators.near_duplicates import clusters, near_pairs

    prints = ["0000000000000000", "0000000000000007", "000000000000000f", "ffffffffffffffff", "7fffffffffffffff"]
    rows = spark.createDataFrame([(f"u{i}", i, p, f"h{i}") for i, p in enumerate(prints)], "url string, seq long, content_simhash string, content_hash string")
    assert sorted((r.fp1, r.fp2, r.distance) for r in near_pairs(rows).collect()) == [
        (prints[0], prints[1], 3), (prints[1], prints[2], 1), (prints[4], prints[3], 1)]
    assert {r.url: (r.cluster, r.cluster_size) for r in clusters(rows).collect()} == {"u0": (1, 3), "u1": (1, 3), "u2": (1, 3), "u3": (2, 2), "u4": (2, 2)}


def test_stream_equals_batch(spark, tmp_path):
    from siteloom.streaming.trackers import duplicate_titles_stream

    rows = spark.createDataFrame([(i, f"t{i % 7}" if i % 5 else None) for i in range(60)], "seq long, title string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    got = duplicate_titles_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "state"))
    want = rows.where("title IS NOT NULL").groupBy("title").count().where("count > 1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_rule_fires_in_the_simulated_web():
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    found = con.execute(catalogue.ORACLES["issue_summary"]).fetchall()
    assert len(found) == 105 and all(r[-1] > 0 for r in found)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_equal_urls_meet_their_last_page_once(spark):
    from siteloom.operators import issues
    from siteloom.sources.schema import complete

    rows = [(0, "https://e.com/a", 200, "https://e.com/t"), (1, "https://e.com/a", 200, "https://e.com/t"), (2, "https://e.com/t", 404, None), (3, "https://e.com/t", 200, None)]
    pages = complete(spark.createDataFrame(rows, "seq long, url string, status int, canonical string").selectExpr("*", "100L AS html_size_bytes"))
    none = spark.createDataFrame([], "source string, target string"), spark.createDataFrame([], "source string, lang string, href string")
    got = issues.evaluated(pages, issues.cross_flags(pages, *none, keys=("brokenCanonicalTarget",)), ("brokenCanonicalTarget",)).collect()
    assert len(got) == 4 and all(r.issues == [] for r in got)
    last = pages.withColumn("status", pages["status"] + (pages["seq"] == 3).cast("int") * 300)
    got = issues.evaluated(last, issues.cross_flags(last, *none, keys=("brokenCanonicalTarget",)), ("brokenCanonicalTarget",)).collect()
    assert sorted((r.seq, r.issues) for r in got) == [(0, ["brokenCanonicalTarget"]), (1, ["brokenCanonicalTarget"]), (2, []), (3, [])]


def test_missing_return_of_a_later_page_of_the_host_on_another_scheme_or_port(spark):
    from siteloom.operators import issues
    from siteloom.sources.schema import complete

    urls = ["http://e.com/a", "https://e.com/b", "https://e.com:8443/c", "https://f.com/d"]
    pages = complete(spark.createDataFrame(list(enumerate(urls)), "seq long, url string").selectExpr("*", "200 AS status", "100L AS html_size_bytes", "'Indexable' AS indexability"))
    links = spark.createDataFrame([], "source string, target string")
    hreflang = spark.createDataFrame([(urls[0], "de", urls[1]), (urls[1], "fr", urls[2]), (urls[2], "en", urls[3]), (urls[3], "en", urls[0])], "source string, lang string, href string")
    got = issues.cross_flags(pages, links, hreflang, keys=("hreflangMissingReturn",)).collect()
    # That of c is on another host and comes later; that of d came before.
    assert sorted(r.url for r in got) == sorted([urls[0], urls[1], urls[3]])


def test_text_ratio_rounds_halves_up(spark, tmp_path):
    ties = [(n, size) for size in (80, 240, 400, 2000, 5600) for n in range(2, size - 20) if n * 2000 % size == 0 and n * 2000 // size % 2][:250]
    rows = [(i, f"https://e.com/{i}", f"<body>{'x' * (n - 1)}<!--{'y' * (size - n - 12)}-->") for i, (n, size) in enumerate(ties)]
    spark.createDataFrame([*rows, (-1, "https://e.com/empty", "")], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.seq: r.text_ratio for r in catalogue.QUERIES["page_signals"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' WHERE page_id >= 0")
    want = dict(con.execute(f"SELECT seq, text_ratio FROM ({catalogue.ORACLES['page_signals']})").fetchall())
    assert got.pop(-1) == 0.0 and got == want == {i: (n * 2000 + size) // (2 * size) / 10 for i, (n, size) in enumerate(ties)}

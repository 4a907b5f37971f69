"""Literal cases of single operators."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftframe.functions import hosts, query_ops, text, urls
from siftframe.operators import aggregates, crawl, extract, filters, joins, limits, search, sets, windows
from siftframe.operators import projections as P
from siftframe.operators.crawl import crawl_frontier
from siftframe.plans import pipelines
from siftframe.sources import folders, readers, sinks


def values(spark, expr, *items):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, x string")
    return [r.y for r in df.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


def test_canonical_urls(spark):
    got = values(spark, urls.canonical, "https://Example.com/a/?utm_source=x&gclid=1&id=2#frag", "not a url", "https://a.com/x/", "https://a.com/x?utm_source=t", "https://a.com/?t=123e4567-e89b-12d3-a456-426614174000&t=5&param=12&q=1", "https://a.com/p q|r/", None)
    assert got == ["https://example.com/a?id=2", "not a url", "https://a.com/x", "https://a.com/x", "https://a.com/?q=1", "https://a.com/p q|r", ""]


def test_clean_urls(spark):
    got = values(spark, urls.clean, "https://A.com/x/?source=1&ref=2", "ftp://a.com/", "https://a.com", "junk")
    assert got == ["https://a.com/x/?source=1", "", "https://a.com/", "junk"]


def test_unwrap(spark):
    got = values(
        spark, urls.unwrap, "/url?q=https%3A%2F%2Fshop.example.com%2Fcart%2Fcheckout&sa=U", "https://r.search.yahoo.com/_ylt=x/RU=https%3A%2F%2Fnews.example%2Fx/RK=2",
        "//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.org%2Fz", "https://www.google.com/url?url=%2Furl%3Fq%3Dhttps%253A%252F%252Fa.example%252F", "https://a.example/plain", "",
    )
    assert got == ["https://shop.example.com/cart/checkout", "https://news.example/x", "https://example.org/z", "https://a.example/", "https://a.example/plain", ""]
    assert values(spark, urls.target, "https://www.google.com/search?q=x", "/url?q=https://b.example/%3Fa&sa=U") == ["", "https://b.example/?a"]


def test_resolve(spark):
    df = spark.createDataFrame([("/rel", 0), ("ftp://x/", 1), ("javascript:x()", 2), ("../up?x#f", 3), ("//o.example/y", 4), ("?q=1", 5), ("http://", 6)], "href string, k int").withColumn("base", F.lit("https://example.com/dir/page?z=1"))
    got = {r.k: r.resolved for r in P.resolve_links(df, "href", "base").collect()}
    assert got == {0: "https://example.com/rel", 1: None, 2: None, 3: "https://example.com/up?x", 4: "https://o.example/y", 5: "https://example.com/dir/page?q=1", 6: None}


def test_dot_segments(spark):
    from urllib.parse import urljoin

    rng = random.Random(1)
    paths = ["/" + "/".join(rng.choice(["a", "b", "..", ".", "...", "", "c.d"]) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    df = spark.createDataFrame([(p,) for p in paths], "href string").withColumn("base", F.lit("https://example.com/dir/page"))
    for r in P.resolve_links(df, "href", "base").collect():
        if "//" not in r.href:  # empty segments are no matter of dots
            want = urljoin("https://example.com/dir/page", r.href)
            assert r.resolved == (want if want.count("/") > 2 else want + "/"), r.href
    links = extract.extract_links(spark.createDataFrame([(1, "https://example.com/a/b/c", '<a href="../up">u</a><a href="./same">s</a>')], "page_id long, url string, html string"))
    assert [r.dst_url for r in links.orderBy("pos").collect()] == ["https://example.com/a/up", "https://example.com/a/b/same"]


def test_breadcrumb_and_index(spark):
    assert values(spark, urls.from_breadcrumb, "example.com › a › b", "example.com › a › ...", "nope", "https://x.example/p?a=1", "") == ["https://example.com/a/b", "https://example.com/", "", "https://x.example/p?a=1", ""]
    df = spark.createDataFrame([("https://x.example/q?z=1#f", "Index of /wp-content/uploads/backup"), ("https://x.example/q", "Other")], "url string, title string")
    assert [r.url for r in P.expand_index_of(df).collect()] == ["https://x.example/wp-content/uploads/backup", "https://x.example/q"]


def test_text(spark):
    assert values(spark, text.normal_query, "  a​  b  ", None) == ["a b", ""]
    assert values(spark, text.clean, "<b>a</b> &amp;lt;  b") == ["a < b"]
    assert values(spark, lambda c: text.clean(c, feed=True), "<b>a</b> &amp;lt;  b&apos;") == ["a &lt; b'"]
    assert values(spark, text.mask_credentials, "http://u:p@h/x", "http://h/x") == ["http://***@h/x", "http://h/x"]


def test_query_operators(spark):
    q = 'site:example.com inurl:login intitle:"admin panel" "exact phrase" -word filetype:pdf'
    df = spark.createDataFrame([(0, q), (1, "open source database"), (2, '"open source database"'), (3, "site:https://www.Example.com/path inurl:x"), (4, None)], "query_id int, q string")
    rows = {r.query_id: r for r in P.parse_query_operators(df).collect()}
    assert rows[0].operators == {"site": ["example.com"], "inurl": ["login"], "intitle": ["admin panel"], "filetype": ["pdf"]}
    assert {"admin panel", "exact phrase"} <= set(rows[0].phrases) and rows[0].exclusions == ["word"]
    assert not rows[1].is_dork and rows[1].operators == {}
    assert rows[2].is_dork and not rows[2].has_operators
    assert rows[3].site_targets == ["example.com"] and not rows[4].is_dork


def test_engine_support(spark):
    df = spark.createDataFrame([(0, "site:x.com inurl:login")], "query_id int, q string")
    q = P.parse_query_operators(df).withColumn("engine", F.explode(F.array(F.lit("bing"), F.lit("google"), F.lit("wiby"))))
    got = {r.engine: r.unsupported for r in joins.engine_support(q).collect()}
    assert got == {"bing": ["inurl"], "google": [], "wiby": ["site", "inurl"]}


def _results(spark, *rows):
    return spark.createDataFrame([(0, "e", 0, 0, k, t, u, "") for k, (t, u) in enumerate(rows)], "query_id int, engine string, engine_pos int, page int, pos int, title string, url string, snippet string")


def test_enforced_operators(spark):
    df = _results(spark, ("ok", "https://github.com/a/README.md"), ("sub", "https://docs.github.com/x.md"), ("host", "https://notgithub.com/x.md"), ("type", "https://github.com/x.pdf"), ("bad", "nope"))
    q = P.parse_query_operators(spark.createDataFrame([(0, 'site:github.com filetype:md "readme"')], "query_id int, q string"))
    assert [r.title for r in filters.enforce_operators(df, q).orderBy("pos").collect()] == ["ok", "sub"]
    q = P.parse_query_operators(spark.createDataFrame([(0, 'site:.com "checkout"')], "query_id int, q string"))
    df = _results(spark, ("a", "https://shop.example.com/"), ("b", "https://example.com/"), ("c", "https://x.co.uk/"), ("d", "https://x.net/"))
    assert [r.title for r in filters.enforce_operators(df, q).orderBy("pos").collect()] == ["a", "b"]


@pytest.mark.parametrize(
    ("policy", "gone"),
    [
        ({}, {"facebook"}), ({"dev": True, "social": False}, {"github", "so"}), ({k: True for k in ("social", "dev", "ugc", "forum", "blog")}, {"facebook", "github", "so", "scribd", "forum", "blog"}),
        ({"dev": True, "allow_domains": ["github.com"]}, {"facebook", "so"}), ({"dev": True, "ugc": True, "allow_domains": [".com"]}, set()), ({"exclude_domains": ["example.com"]}, {"facebook", "example"}),
    ],
)
def test_domain_filters(spark, policy, gone):
    rows = {"example": "https://www.example.com/", "facebook": "https://facebook.com/x", "github": "https://github.com/x", "so": "https://ru.stackoverflow.com/q", "scribd": "https://scribd.com/d", "forum": "https://y.org/forum/1", "blog": "https://z.wordpress.com/", "evil": "https://facebook.com.evil.test/"}
    df = _results(spark, *rows.items())
    kept = {r.title for r in filters.filter_domains(df, policy).collect()}
    assert set(rows) - kept == gone


def test_non_organic(spark):
    df = _results(spark, ("real", "https://a.com/"), ("v", "https://m.youtube.com/watch"), ("AI Overview: x", "https://b.com/"), ("reel", "https://www.instagram.com/reel/1"), ("profile", "https://www.instagram.com/x"))
    assert [r.title for r in filters.drop_non_organic(df).orderBy("pos").collect()] == ["real", "profile"]


def test_block_pages(spark):
    rows = [(0, "https://x/sorry/a", "<title>t</title>"), (1, "https://x/", "<title>Captcha</title>"), (2, "https://x/", "<title>t</title>our systems saw Unusual Traffic"), (3, "https://x/", "<title>t</title>robot <h3>r</h3>"), (4, "https://x/", "<title>t</title>robot"), (5, "https://x/", ""), (6, None, None)]
    got = {r.page_id: r.label for r in filters.classify_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {0: "blocked", 1: "blocked", 2: "blocked", 3: "ok", 4: "blocked", 5: "blocked", 6: "blocked"}


def test_private_hosts(spark):
    private = ["localhost", "127.0.0.1", "10.1.2.3", "192.168.1.1", "169.254.169.254", "172.16.0.1", "100.64.0.1", "metadata.google.internal", "x.local", "0.0.0.0", "", "y.internal."]
    assert all(values(spark, hosts.is_private_host, *private))
    assert not any(values(spark, hosts.is_private_host, "example.com", "8.8.8.8", "172.32.0.1"))


def test_numeric_hosts(spark):
    """A host that ends with a number is an address as browsers read it, or none at all."""
    private = ["10.0.0.1000", "10.0.0.256", "999.1.1.1", "1.2.3.4.5", "08.1.1.1", "a.1", "127.1", "0x7f.0.0.1", "2130706433", "0x7f000001", "0177.0.0.1", "172.1048577", "192.168.257", "4294967296", "0.1.2.3", "1..1", "99999999999999999999", "10.0.0.1000."]
    assert all(values(spark, hosts.is_private_host, *private))
    public = ["8.8.8.8", "134744072", "0x8.8.8.8", "8.526344", "172.15.255.255", "172.32.0.1", "100.63.1.1", "100.128.0.1", "169.253.1.1", "255.255.255.255", "10.example.com", "1.2.3.4.example", "x1"]
    assert not any(values(spark, hosts.is_private_host, *public))


def test_hosts(spark):
    assert [r and tuple(r) for r in values(spark, hosts.cpe, "cpe:2.3:a:nginx:nginx:1.18.0:*:*:*:*:*:*:*", "cpe:/a:openbsd:openssh:8.9", "", "nonsense", "cpe:2.3:a:-:x")] == [("nginx", "nginx", "1.18.0"), ("openbsd", "openssh", "8.9"), None, None, (None, "x", None)]
    assert values(spark, hosts.ip_number, "0.0.1.2", "x", None) == [258, None, None]
    df = spark.createDataFrame([("https://example.com/path", "t", None, None, None, None)], "url string, title string, ip string, ports array<int>, hostnames array<string>, org string")
    h = P.to_host_records(df).first().host
    assert (h.ip_str, h.port, h.hostnames) == (None, 443, ["example.com"])


def test_enrich(spark):
    df = spark.createDataFrame([("http://1.2.3.4", "1.2.3.4", None, None, None, None)], "url string, title string, ip string, ports array<int>, hostnames array<string>, org string")
    scan = spark.createDataFrame([("1.2.3.4", [80, 22], ["a.example", "1.2.3.4"], ["cpe:2.3:a:nginx:nginx:1.18.0:*"], [], ["CVE"])], "ip string, ports array<int>, hostnames array<string>, cpes array<string>, tags array<string>, vulns array<string>")
    h = joins.enrich_hosts(P.to_host_records(df), scan).first().host
    assert (h.ports, h.port, h.hostnames, h.product, h.version, h.vulns) == ([80, 22], 80, ["a.example"], "nginx", "1.18.0", ["CVE"])


def test_block_layout(spark):
    block = '<div class="g"><a href="/url?q=https%3A%2F%2Fsite{0}.example.com%2Fpage{0}&amp;sa=U"><h3>Result {0} &amp; x</h3></a><cite>site{0}.example.com</cite><div class="VwiC3b">Snip {0}</div><span class="LEwnzc">Jan 1, 2026</span></div>'
    bare = '<h3>Only heading</h3><p><cite>late.example › x</cite></p>'
    pages = [
        (1, "".join(block.format(k) for k in range(10))), (2, bare), (3, '<h3>T</h3><a href="https://www.google.com/x">own</a>'), (4, None), (5, ""),
        (6, '<h3>Head</h3><a href="https://after.example/">after</a><a href="https://around.example/"><h3>Around it</h3></a>'),
        (7, '<div class="x g"><h3>No link here</h3></div><div class="g"><h3>H</h3><a href="https://in.example/" ping="/url?q=https://in.example/longer">inside</a><div class="HiHjCd"><a href="https://l.example/">l</a></div></div>'),
    ]
    rows = extract.extract_blocks(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "rank").collect()
    assert [r.rank for r in rows if r.page_id == 1] == list(range(1, 11))
    assert (rows[0].title, rows[0].url, rows[0].date, rows[0].snippet) == ("Result 0 & x", "https://site0.example.com/page0", "Jan 1, 2026", "Snip 0")
    assert [(r.page_id, r.title, r.url) for r in rows if r.page_id > 1] == [
        (2, "Only heading", "https://late.example/x"), (6, "after", "https://after.example/"), (6, "Around it", "https://around.example/"), (7, "inside", "https://in.example/longer"),
    ]
    assert [(x.title, x.link) for x in rows[-1].sitelinks] == [("l", "https://l.example/")]


@pytest.mark.parametrize("layout", [extract.extract_blocks, extract.extract_cards, extract.extract_serp_features, extract.extract_organic, extract.extract_anchors, extract.extract_results])
def test_batches_without_results(spark, layout):
    """Empty tables, null and empty pages, engines without a rule, and partitions in which nothing is found."""
    pages = spark.createDataFrame([(1, "google", None), (2, "bing", ""), (3, "none", "<p>x"), (4, None, None), (5, "google", "<p>quiet</p>")], "page_id long, engine string, html string").repartition(5, "page_id")
    n = 5 if layout is extract.extract_serp_features else 0
    assert layout(pages).count() == n and layout(pages.limit(0)).count() == 0


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 30_000 + '<div class="g"><a href="https://deep.example/"><h3>Deep down</h3></a></div>' + "</div>" * 10
    pages = spark.createDataFrame([(1, "google", deep), (2, "google", "<<a <h3" + "<div class='g'" * 50), (3, "google", '<div class="g">' + "<h3>x</h3>" * 3_000)], "page_id long, engine string, html string")
    assert [r.url for r in extract.extract_blocks(pages).collect()] == ["https://deep.example/"]
    assert [r.url for r in extract.extract_organic(pages).collect()] == ["https://deep.example/"]
    assert extract.extract_serp_features(pages).count() == 3


def test_layout_hook(spark):
    def fn(batches):
        for pdf in batches:
            found = [[p, e, 0, h.upper(), ["https://hook.example/"], "", "s", "", []] for p, e, h in zip(pdf["page_id"], pdf["engine"], pdf["html"], strict=True) if h]
            yield extract._rows(found)

    pages = spark.createDataFrame([(1, "mine", "own layout"), (2, "mine", None)], "page_id long, engine string, html string").repartition(2, "page_id")
    assert [(r.page_id, r.title, r.url, r["rank"]) for r in extract.extract_results(pages, fn=fn).collect()] == [(1, "OWN LAYOUT", "https://hook.example/", 1)]


def test_results_of_all_layouts(spark):
    archive = '{"response":{"docs":[{"identifier":"book","title":"A book"}]}}'
    pages = [(1, "google", '<div class="g"><a href="https://g.example/"><h3>Google</h3></a></div>'), (2, "bing", '<h2><a href="https://b.example/">Bing</a></h2>'), (3, "archive", archive), (4, "wikipedia", '["q",["W"],["d"],["https://en.wikipedia.org/wiki/W"]]')]
    got = {(r.page_id, r.url) for r in extract.extract_results(spark.createDataFrame(pages, "page_id long, engine string, html string")).collect()}
    assert {(1, "https://g.example/"), (2, "https://b.example/"), (3, "https://archive.org/details/book")} <= got


def test_organic_cards(spark):
    card = '<div class="MjjYud"><div><div class="yuRUbf"><a href="https://o{0}.example/"><h3>Organic {0}</h3></a></div><cite>o{0}.example</cite></div><div><div class="VwiC3b">A snippet that is long enough {0}</div></div></div>'
    chrome = '<div class="x"><a href="https://chrome.example/"><h3>Chrome card</h3></a><h3>Other one</h3><h3>Other two</h3></div>'
    nav = '<nav><a href="https://nav.example/"><h3>Navigation</h3></a></nav>'
    pages = [(1, "<div id='rso'>" + "".join(card.format(k) for k in range(5)) + chrome + nav + "</div>"), (2, "<div id='rso'>" + "".join(card.format(k) for k in range(4)) + chrome + "</div>")]
    rows = extract.extract_organic(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "rank").collect()
    assert [r.title for r in rows if r.page_id == 1] == [f"Organic {k}" for k in range(5)]
    assert [r.title for r in rows if r.page_id == 2] == [*[f"Organic {k}" for k in range(4)], "Chrome card"]
    assert rows[1].snippet == "A snippet that is long enough 1" and rows[0].displayed_link == "o0.example"


def test_anchor_layouts(spark):
    pages = [
        (1, "bing", '<h2><a href="https://a.example/">Title a</a></h2><h2><a href="https://www.bing.com/x">own</a></h2>'), (2, "wiby", '<a class="tlink" href="https://b.example/">Title b</a>'),
        (3, "mojeek", '<a class="ob" href="https://c.example/">Title c</a>'), (4, "github", '<div class="search-title"><a href="/owner/repo">owner/repo</a></div><div class="search-title"><a href="/topics/x">t</a></div>'), (5, "none", "<a>x</a>"),
    ]
    got = {(r.page_id, r.url) for r in extract.extract_anchors(spark.createDataFrame(pages, "page_id long, engine string, html string")).collect()}
    assert got == {(1, "https://a.example/"), (2, "https://b.example/"), (3, "https://c.example/"), (4, "https://github.com/owner/repo")}


def test_payloads(spark):
    docs = '{"response":{"docs":[{"identifier":"hello_world","title":["Hi there"],"description":"d"},{"identifier":"skip/me","title":"x"}]}}'
    df = spark.createDataFrame([(1, docs), (2, "junk"), (3, None)], "query_id int, body string")
    assert [(r.url, r.title) for r in readers.read_result_json(df, "docs").collect()] == [("https://archive.org/details/hello_world", "Hi there")]
    search = '["q",["One","Two"],["a","b"],["https://en.wikipedia.org/wiki/One","https://evil.example/"]]'
    df = spark.createDataFrame([(1, search), (2, "[1]")], "query_id int, body string")
    assert [r.title for r in readers.read_result_json(df, "opensearch").collect()] == ["One"]
    df = spark.createDataFrame([(1, ")]}'\n" + '["q",["<b>openai</b>","x &amp; y",""]]'), (2, ""), (3, "{")], "query_id int, body string")
    assert sorted(r.suggestion for r in readers.read_result_json(df, "suggest").collect()) == ["openai", "x & y"]


def test_feeds(spark):
    rss = '<rss><item><title>A</title><link>https://a/</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><source url="https://p/">P</source></item><item><title>Tom &amp; Jerry &lt;3</title></item></rss>'
    rows = readers.read_news_rss(spark.createDataFrame([(1, rss), (2, "<rss/>")], "query_id int, body string"), "body").orderBy("pos").collect()
    assert [r.title for r in rows] == ["A", "Tom & Jerry <3"]
    assert rows[0].source == "P" and rows[0].published.year == 2026 and rows[1].source is None


def test_extras_that_cannot_be_read(spark):
    df = spark.createDataFrame([("<!--serp-extras:{bad-->",), ("none",), (None,)], "html string")
    assert [r.extras for r in readers.read_embedded_extras(df).collect()] == [None, None, None]


def test_positions_and_organic(spark):
    df = _results(spark, ("a", "https://a/"), ("b", "https://a/"), ("", "https://c/"), ("d", "https://d/"))
    assert [(r.url, r.position) for r in windows.with_position(df).orderBy("position").collect()] == [("https://a/", 1), ("https://d/", 2)]
    for n, kept in ((4, 6), (5, 5)):
        cards = spark.createDataFrame([(1, k, "s" if k < n else None, None) for k in range(n)] + [(1, 10 + k, None, "") for k in range(6 - n)] + ([(1, 20, None, None)] if n == 5 else []), "page_id int, pos int, snippet string, displayed_link string")
        assert windows.keep_organic(cards).count() == kept


def test_streaks_and_intervals(spark):
    rows = [(k, f"2026-01-01 00:00:{k:02d}", "a", ok) for k, ok in enumerate([False, False, False, True, False])]
    o = spark.createDataFrame(rows, "event_id int, ts string, key string, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    assert [r.streak for r in windows.failure_streak(o).orderBy("event_id").collect()] == [1, 2, 3, 0, 1]
    (r,) = windows.breaker_intervals(o).collect()
    assert (r.open_from.second, r.open_until.second) == (2, 3)


def test_top_up_and_stale_pages(spark):
    rows = [(0, "e", 0, 0, k, "t", f"https://a/{k}", "") for k in range(8)] + [(0, "e", 0, 1, k, "t", f"https://a/{k + 6}", "") for k in range(10)] + [(0, "e", 0, 2, 0, "t", "https://a/1", ""), (0, "e", 0, 3, 0, "t", "https://z/", "")]
    df = spark.createDataFrame(rows, "query_id int, engine string, engine_pos int, page int, pos int, title string, url string, snippet string")
    assert limits.top_up(df, 10).count() == 10
    assert limits.stop_at_stale_page(df).agg(F.max("page")).first()[0] == 1


def test_shards_and_hosts(spark):
    df = spark.createDataFrame([(k, f"https://h{k % 2}.example/{k}") for k in range(5)], "position int, url string")
    assert [r.position for r in sets.shard_rows(df, 0, 2).orderBy("position").collect()] == [0, 2, 4]
    assert [r.position for r in sets.one_per_host(df).orderBy("position").collect()] == [0, 1]


def test_crawl(spark):
    links = spark.createDataFrame([("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "d"), ("c", 1, "d"), ("d", 1, "e")], "src_url string, pos int, dst_url string")
    starts = spark.createDataFrame([("a",), ("z",)], "start_url string")
    got = lambda **kw: [(r.url, r.depth) for r in crawl_frontier(links, starts, **kw).where("start_url = 'a'").orderBy("visit_order").collect()]
    assert got(max_pages=8, max_depth=3) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert got(max_pages=3, max_depth=3) == [("a", 0), ("b", 1), ("c", 1)]
    assert got(max_pages=8, max_depth=0) == [("a", 0)]


def test_empty_tables(spark):
    empty = _results(spark, ("a", "https://a/")).limit(0)
    assert windows.dedupe_canonical(empty).count() == 0
    assert filters.filter_domains(empty).count() == 0
    assert sets.merge_engines(empty, 5).count() == 0
    assert extract.extract_blocks(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_operator_values(spark):
    assert values(spark, lambda c: query_ops.operator_values(c, "filetype"), 'ext:pdf filetype:"doc" ext:pdf', "filetype:") == [["pdf", "doc"], []]


def test_block_pages_of_engines(spark):
    serp = "".join(f'<div class="g"><a href="/url?q=https://s{k}.example/"><h3>T {k}</h3></a></div>' for k in range(3))
    cases = [
        ("mojeek", '<title>Captcha</title><script src="/js/vendor/altcha.js"></script>', None, True), ("qwant", "<title>Service unavailable</title><p>Prove you are human</p>", None, True),
        ("yandex", '<title>Are you not a robot?</title><div class="smartcaptcha"></div>', None, True), ("mojeek", '<ul class="results-standard"><li><a class="ob" href="https://e.example/a">Alpha</a></li></ul>', None, False),
        ("google_lite", '<noscript><meta http-equiv="refresh" content="0;url=/httpservice/retry/enablejs?sei=x"></noscript>', None, True), ("google", "<title>Enable JavaScript to use search</title>", None, True),
        ("google", "<div>Our systems have detected unusual traffic</div>", None, True), ("google", '<div id="captcha"></div>', None, True), ("google", serp, None, False), ("google", serp, "https://www.google.com/sorry/index", True),
        ("bing", '<title>b</title><li class="b_algo"><h2><a href="https://e.example/">About robots that are blocked</a></h2></li>', None, False), ("bing", "<title>b</title><p>You are blocked", None, True),
        ("brave", "<title>b</title><p>Just a moment...", None, True), ("duckduckgo", '<title>d</title><div id="captcha">x</div>', None, True), ("shodan", '<title>s</title><p>Please log in to search <a href="/host/1.1.1.1">h</a>', None, True),
        ("archive", '{"response": "captcha"}', None, False), ("other", None, None, True), (None, f"<title>t</title>{serp} captcha", None, False),
    ]
    df = spark.createDataFrame([(k, e, h, u) for k, (e, h, u, _) in enumerate(cases)], "page_id long, engine string, html string, url string")
    got = {r.page_id: r.label for r in filters.classify_pages(df).collect()}
    assert got == {k: "blocked" if b else "ok" for k, (*_, b) in enumerate(cases)}
    assert filters.classify_pages(df.limit(0)).count() == 0


def test_page_search(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "omega"]
    pages = [(k, f"https://h{k % 3}.example/{rng.choice(words)}/{k}.{'pdf' if k % 4 else 'html'}", " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=6))) for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, title string, text string")
    asked = ["intitle:alpha", 'inurl:beta "gamma delta"', "intext:omega -the", "site:h1.example intitle:the", 'filetype:pdf intext:gam', '"beta"']
    q = P.parse_query_operators(spark.createDataFrame(list(enumerate(asked)), "query_id int, q string"))
    ok = [
        lambda u, t, b: "alpha" in t, lambda u, t, b: "beta" in u and "gamma delta" in f"{t} {b}", lambda u, t, b: "omega" in b and "the" not in f"{t} {b}", lambda u, t, b: "h1.example" in u and "the" in t,
        lambda u, t, b: u.endswith(".pdf") and "gam" in b, lambda u, t, b: "beta" in f"{t} {b}",
    ]
    got = {(r.query_id, r.page_id) for r in search.search_pages(df, q).collect()}
    assert got == {(n, k) for n, f in enumerate(ok) for k, u, t, b in pages if f(u, t, b)} and len(got) > 20
    with pytest.raises(ValueError, match="three characters"):
        search.search_pages(df, P.parse_query_operators(spark.createDataFrame([(1, "plain words")], "query_id int, q string")))
    assert search.search_pages(df.limit(0), q).count() == 0


@pytest.mark.parametrize("bucket", [windows.BUCKET_S, 60])
def test_streaks_by_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(windows, "BUCKET_S", bucket)
    monkeypatch.setattr(windows._streaks, "__defaults__", (bucket,))
    rng, start = random.Random(4), datetime.datetime(2026, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=rng.randint(0, 4000)), f"k{rng.randint(0, 2)}", rng.random() < 0.35) for k in range(400)]
    o = spark.createDataFrame(rows, "event_id long, ts timestamp, key string, ok boolean")
    streak, want, spans, open_ = {}, {}, [], {}
    for k, ts, key, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        n = streak[key] = 0 if ok else streak.get(key, 0) + 1
        want[k] = n
        if ok and key in open_:
            a, b = open_.pop(key)
            spans.append((key, a, min(b, max(ts, a))))
        if n >= 3:
            if key in open_ and ts > open_[key][1]:
                spans.append((key, *open_.pop(key)))
            a = open_[key][0] if key in open_ else ts
            open_[key] = (a, ts + datetime.timedelta(milliseconds=120_000))
    spans += [(key, *s) for key, s in open_.items()]
    assert {r.event_id: r.streak for r in windows.failure_streak(o).collect()} == want
    assert Counter(map(tuple, windows.breaker_intervals(o).collect())) == Counter(spans)


def test_crawl_by_brute_force(spark):
    rng = random.Random(5)
    links = list({(f"p{rng.randint(0, 12)}", f"p{rng.randint(0, 40)}"): None for _ in range(200)}) + [("hub", f"p{k}") for k in range(300)] + [("hub", "p0")]
    rows = [(a, k, b) for k, (a, b) in enumerate(links) if a != b]
    df = spark.createDataFrame(rows, "src_url string, pos long, dst_url string")
    starts = sorted({a for a, _, _ in rows})
    for most, depth in ((5, 3), (12, 2), (1, 1)):
        want = []
        for s in starts:
            seen, queue = {s}, [(s, 0)]
            order = []
            while queue and len(order) < most:
                url, d = queue.pop(0)
                order.append((s, url, d, len(order) + 1))
                for _, _, b in sorted((r for r in rows if r[0] == url), key=lambda r: r[1]) if d < depth else ():
                    if b not in seen:
                        seen.add(b)
                        queue.append((b, d + 1))
            want += order
        got = crawl_frontier(df, spark.createDataFrame([(s,) for s in starts], "start_url string"), most, depth).collect()
        assert Counter(map(tuple, got)) == Counter(want)


def _crawled(rows, start, most, depth):
    seen, queue, order = {start}, [(start, 0)], []
    while queue and len(order) < most:
        url, d = queue.pop(0)
        order.append((start, url, d, len(order) + 1))
        for _, _, b in sorted((r for r in rows if r[0] == url), key=lambda r: r[1]) if d < depth else ():
            if b not in seen:
                seen.add(b)
                queue.append((b, d + 1))
    return order


@pytest.mark.parametrize("urls_a_task", [100, 500_000])
def test_crawl_by_number_of_links(spark, monkeypatch, urls_a_task):
    """Lists are dealt by the number of links, whatever the bytes; no start is joined again that has its pages."""
    monkeypatch.setattr(crawl, "LINKS_A_TASK", 100, raising=False)
    monkeypatch.setattr(crawl, "URLS_A_TASK", urls_a_task, raising=False)
    rng = random.Random(6)
    pairs = [(f"p{rng.randint(0, 60)}", f"p{rng.randint(0, 90)}") for _ in range(300)] + [("hub", f"p{k % 90}") for k in range(400)] + [(f"leaf{k}", "hub") for k in range(40)]
    pairs += rng.sample(pairs, 200) + [("p1", "p2")] * 100
    rows = [(a, k, b) for k, (a, b) in enumerate(pairs) if a != b]
    df = spark.createDataFrame(rows, "src_url string, pos long, dst_url string")
    assert len(crawl.link_lists(df, 12).inputFiles()) > 4
    linking = sorted({a for a, _, _ in rows})
    for starts, most, depth in ((None, 12, 2), (None, 6, 3), (None, 4, 0), ([*linking, "p90", "none"], 12, 3)):
        table = starts and spark.createDataFrame([(s,) for s in starts], "start_url string")
        got = crawl_frontier(df, table, most, depth).collect()
        assert Counter(map(tuple, got)) == Counter(r for s in starts or linking for r in _crawled(rows, s, most, depth))


def test_crawl_without_positions(spark):
    rows = [("a", None, f"n{k}") for k in range(9)] + [("a", k, f"n{k % 12}") for k in range(30)]
    df = spark.createDataFrame(rows, "src_url string, pos long, dst_url string")
    assert [r.dsts for r in crawl.link_lists(df, 4).collect()] == [["n0", "n1", "n2", "n3"]]
    only = df.unionByName(spark.createDataFrame([("a", None, "z"), ("a", None, "y")], df.schema))
    assert [r.dsts for r in crawl.link_lists(only, 4).collect()] == [["y", "z", "n0", "n1"]]


def test_host_order(spark):
    rows = [(1, "10.0.0.9", [1], []), (2, "9.1.1.1", [1, 2, 3], ["v"]), (3, None, None, ["v", "w"]), (4, "10.0.0.10", [1, 2, 3], None)]
    df = spark.createDataFrame([(p, (ip, ports, vulns)) for p, ip, ports, vulns in rows], "pos int, host struct<ip_str:string,ports:array<int>,vulns:array<string>>")
    order = lambda by: [r.pos for r in limits.sort_hosts(df, by).collect()]
    assert (order("ip"), order("ports"), order("vulns")) == ([2, 1, 4, 3], [2, 4, 1, 3], [3, 2, 1, 4])


def test_query_documents(spark, tmp_path):
    for k, body in enumerate(['{"queries": [" a ", "", "b"]}', '{"queries": "no list"}', "junk", '{"queries": [1, null, "x"]}']):
        (tmp_path / f"{k}.json").write_text(body)
    rows = readers.read_queries(spark, str(tmp_path)).collect()
    assert sorted(r.q for r in rows) == ["1", "a", "b", "x"] and {r.position for r in rows if r.q == "b"} == {2}
    (tmp_path / "many.json").write_text('{"queries": [' + ",".join('"q"' for _ in range(201)) + "]}")
    with pytest.raises(ValueError, match="more than 200"):
        readers.read_queries(spark, str(tmp_path))
    assert readers.read_queries(spark, str(tmp_path), 300).count() == 205
    (tmp_path / "many.json").write_text('{"queries": [' + ",".join('"q"' for _ in range(2001)) + "]}")
    with pytest.raises(ValueError, match="more than 2000"):
        readers.read_queries(spark, str(tmp_path), 5000)


def test_batch_takes_as_long_as_its_last_query(spark):
    rows = [(1, "2026-01-01 10:00:00", 5_000.0, True), (1, "2026-01-01 10:00:01", 1_500.5, False), (2, "2026-01-01 10:00:00", None, True)]
    df = spark.createDataFrame(rows, "batch_id int, ts string, duration_ms double, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    assert {r.batch_id: (r.batch_size, r.completed, r.duration_ms) for r in aggregates.batch_summary(df).collect()} == {1: (2, 1, 5_000.0), 2: (1, 1, 0.0)}


def test_search_paths(spark):
    google = '<div class="g"><a href="https://{0}/"><h3>Host {0}</h3></a></div>'
    pages = [(1, 1, "google", 1, google.format("8.8.8.8") + google.format("1.1.1.1") + google.format("www.facebook.com"), 40.0), (2, 1, "bing", 1, '<li class="b_algo"><h2><a href="https://b.example/">Bing</a></h2></li>', 5.0), (3, 2, "google", 1, "<p>unusual traffic", 7.0), (4, 2, "bing", 1, '<li class="b_algo"><h2><a href="https://c.example/">Bing</a></h2></li>', 5.0)]
    captured = spark.createDataFrame(pages, "page_id long, query_id long, engine string, page int, html string, duration_ms double")
    asked = [(1, "words", "google", {}), (2, "words", "google", {"fallback": "0"}), (3, "words", "google", {"auto_fallback": "false"})]
    q = pipelines.plan_queries(spark.createDataFrame(asked, "query_id long, q string, engines string, params map<string,string>"))
    tried = {r.query_id: r.try_list for r in q.collect()}
    assert tried == {1: ["google", "duckduckgo", "bing"], 2: ["google"], 3: ["google"]}
    out = {r.query_id: r for r in pipelines.search_fallback(captured, q).collect()}
    assert [x.url for x in out[1].results] == ["https://8.8.8.8/", "https://1.1.1.1/"] and out[1].duration_ms == 40.0
    assert not out[2].success and out[2].code == "EMPTY_RESULTS" and out[2]["count"] == 0 and not out[3].success
    hosts = pipelines.search_fallback(captured, q, hosts={"sort": "ip", "fields": ["ip_str"]}).where("query_id = 1").first()
    assert [x.url for x in hosts.results] == ["https://1.1.1.1/", "https://8.8.8.8/"]
    assert not pipelines.search_fallback(captured, q, hosts={"has_vulns": True}).where("query_id = 1 and engine = 'google'").first()
    merged, summary = pipelines.search_merge(captured, pipelines.plan_queries(spark.createDataFrame([(1, "words", "google,bing", {}), (2, "words", "google,bing", {})], "query_id long, q string, engines string, params map<string,string>")))
    assert sorted((r.query_id, r.url) for r in merged.collect()) == [(1, "https://1.1.1.1/"), (1, "https://8.8.8.8/"), (1, "https://b.example/"), (2, "https://c.example/")]
    assert {r.query_id: (r.engines_tried, r.engines_ok, r["count"], r.duration_ms) for r in summary.collect()} == {1: (2, 2, 3, 40.0), 2: (2, 1, 1, 7.0)}


def test_envelopes_are_written_and_read(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, "t", "https://a/", "s")], "query_id long, rank int, title string, url string, snippet string")
    o = spark.createDataFrame([(1, "e", True, "OK", 1.0), (2, "e", False, "EMPTY_RESULTS", 2.0)], "query_id long, engine string, ok boolean, code string, duration_ms double")
    sinks.write_envelopes(r, o, str(tmp_path / "e"), run_date="2026-01-01", fmt="parquet")
    got = {x.query_id: (x["count"], str(x.run_date), len(x.results)) for x in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert got == {1: (1, "2026-01-01", 1), 2: (0, "2026-01-01", 0)}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        folders.shared_dir(Session())
    assert folders.shared_dir(spark)

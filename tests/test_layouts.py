"""Spellings of attributes, page-local extraction, labels by title and source, rule tables, search over an index."""

import re
import uuid

import oracle
import pandas as pd
import pytest
from oracle import SF
from pyspark.sql import functions as F

from siftframe.functions import tags
from siftframe.operators import aggregates, extract, filters, search
from siftframe.operators import projections as P
from siftframe.plans import pipelines, q_pages, registry, views
from siftframe.sources.folders import new_folder
from siftframe.streaming import streams

PAGE = "https://site.example/dir/page"


def frame(spark, rows, schema="page_id long, url string, html string"):
    return spark.createDataFrame(rows, schema)


# --- attributes


@pytest.mark.parametrize(
    ("tag", "links"),
    [
        ('<a href="/one">x</a>', ["/one"]),
        ("<a href='/one'>x</a>", ["/one"]),
        ("<a href=/two>x</a>", ["/two"]),
        ("<a href=/two/>x</a>", ["/two/"]),
        ("<A HREF = '/three' >x</A >", ["/three"]),
        ("<a\nhref\n=\n/four\nclass=k>x</a>", ["/four"]),
        ('<a title="a > b" href="/five">x</a>', ["/five"]),
        ("<a title='a > \"b\"' href=/six>x</a>", ["/six"]),
        ("<a href=/q?a=b&amp;c='d'>x</a>", ["/q?a=b&c='d'"]),
        ("<a href=/it's>x</a><a href='/b'>y</a>", ["/it's", "/b"]),
        ('<a data-href="/data" ping=\'/ping\'>x</a>', ["/ping", "/data"]),
        ('<a href="/h" data-url=/u data-lpage="/l">x</a>', ["/h", "/u", "/l"]),
        ('<a href="/first" href="/second">x</a>', ["/first"]),
        ("<a disabled href='/flag'>x</a>", ["/flag"]),
        ('<a href="/open>x</a> <a href="/b">y</a>', ["/open>x</a> <a href="]),
        ("<a href=/one>x <a href=/two>y</a>", ["/one", "/two"]),
        ('<a href="/last">x', ["/last"]),
        ("<abbr href='/no'>x</abbr><area href=/no>", []),
        ("<!-- <a href='/no'>x</a> --><script>'<a href=/no>x</a>'</script><a href='/yes'>y</a>", ["/yes"]),
        ("<textarea><a href='/no'>x</a></textarea><template><a href=/no>x</a></template><!-- <a href='/no'>", []),
        ("<a href='#top'>x</a><a href=javascript:go()>x</a><a href='MAILTO:a@b'>x</a><a href=''>x</a><a>x</a>", []),
        ("<a href='\x01\x02/odd\x03'>x</a>", ["  /odd "]),
    ],
)
def test_attribute_spellings(spark, tag, links):
    """The grammar of a document's tags; what is never closed is taken up to the next end that there is."""
    rows = frame(spark, [(1, PAGE, tag)]).select(F.transform(tags.anchors(tags.shown(F.col("html"))), lambda a: F.array_compact(F.array(*[tags.attribute(a["tag"], n) for n in extract.LINK_DATA]))).alias("l"))
    found = [h.replace("&amp;", "&") for one in rows.first().l for h in one if h and not re.match(r"(?i)#|javascript:|mailto:", h)]
    assert found == links


def test_links_and_descriptions(spark):
    html = "<title>T</title><meta content='A &amp; B' name=description><meta property='og:description' content=later><body><a href='one'>One <b>x</b></a><a href=../two>Two</a><a href=\"/dir/one\">again</a><a ping=ftp://no/>f</a>"
    pages = frame(spark, [(1, PAGE, html), (2, PAGE, None), (3, None, html), (4, PAGE, "")])
    rows = extract.extract_links(pages).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.dst_url, r.text) for r in rows] == [(1, 1, "https://site.example/dir/one", "One x"), (1, 2, "https://site.example/two", "Two")]
    assert [r.description for r in extract.extract_page(pages).orderBy("page_id").collect()] == ["A & B", "", "A & B", ""]
    capped = extract.extract_links(frame(spark, [(1, PAGE, "".join(f"<a href=/p{k % 150}>t</a>" for k in range(400)))])).collect()
    assert [r.dst_url for r in sorted(capped, key=lambda r: r.pos)] == [f"https://site.example/p{k}" for k in range(100)]


def test_harvest_leaves_navigation_out(spark):
    html = "<title>t</title><nav class=x><a href='https://a.example/'>navigation</a></nav><div role='navigation' id=k><a href='https://b.example/'>navigation</a></div><a href='https://www.altcha.org/x'>a widget</a><a href='https://sub.site.example/'>own</a><a href=https://c.example/>Good one</a><a href=https://c.example/>Good again</a><a href='https://d.example/'>no</a>"
    got = extract.harvest_links(frame(spark, [(1, PAGE, html)]), frame(spark, [], "page_id long")).collect()
    assert [(r.title, r.url, r["rank"]) for r in got] == [("Good one", "https://c.example/", 1)]


# --- page-local extraction


@pytest.mark.parametrize("name", ["extract_blocks", "extract_anchors", "extract_cards", "extract_organic", "extract_links", "extract_results"])
def test_extraction_does_not_shuffle(spark, name):
    pages = views.pages(spark, SF).withColumn("engine", F.lit("google"))
    plan = getattr(extract, name)(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(?<!Broadcast)Exchange|Window|Sort\b", plan)


def test_stream_of_results_is_that_of_a_batch(spark, tmp_path):
    google = '<div class="g"><a href="https://g{0}.example/"><h3>Google {0}</h3></a></div><div class="g"><a href="https://g{0}.example/"><h3>Again</h3></a></div><div class="g"><a href="https://h.example/"><h3>Other</h3></a></div>'
    rows = [(k, "google", PAGE, google.format(k)) for k in range(5)] + [(10, "bing", PAGE, '<li class="b_algo"><h2><a href="https://b.example/">Bing</a></h2></li>'), (11, "bing", PAGE, "<p>access denied"), (12, "wikipedia", None, '["q",["Wiki"],["d"],["https://en.wikipedia.org/wiki/W"]]'), (13, "none", None, None)]
    pages = frame(spark, rows, "page_id long, engine string, url string, html string")
    for k in range(3):
        pages.where(F.col("page_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_available(streams.stream_results(stream), str(tmp_path / "out"))
    want = extract.extract_results(filters.classify_pages(pages).where("label = 'ok'"))
    assert sorted(map(tuple, out.drop("_batch").collect())) == sorted(map(tuple, want.collect()))
    assert {r.page_id for r in out.collect()} == {0, 1, 2, 3, 4, 10, 12} and out.where("page_id = 0").count() == 2


def test_navigation_is_no_result(spark):
    card = '<div class="MjjYud"><a href="https://{0}.example/"><h3>{1}</h3></a><cite>c</cite><div class="VwiC3b">a snippet that is long enough</div></div>'
    html = "<div id=rso>" + card.format("a", "Images") + card.format("b", "Real one") + card.format("c", "SIGN IN") + "</div>" + "".join(f'<div class="s75CSd"><a href="/search?q=x">{t}</a></div>' for t in ("Videos", "more", "real search"))
    pages = frame(spark, [(1, PAGE, html)])
    assert [(r.title, r["rank"]) for r in extract.extract_organic(pages).collect()] == [("Real one", 1)]
    assert extract.extract_serp_features(pages).first().related_searches == ["real search"]


def test_snippets_belong_to_the_heading_before_them(spark):
    html = '<div id=rso><div class=MjjYud><div><a href="https://a.example/"><h3>First</h3></a></div><div class=VwiC3b>of the first heading</div><div><a href="https://b.example/"><h3>Second</h3></a></div><div class=VwiC3b>of the second heading</div></div></div>'
    assert [r.snippet for r in extract.extract_organic(frame(spark, [(1, PAGE, html)])).orderBy("rank").collect()] == ["of the first heading", "of the second heading"]


# --- labels


SERP = "<html><h3>One</h3><h3>Two</h3><cite>c</cite></html>"


@pytest.mark.parametrize(
    ("engine", "html", "reason"),
    [
        ("mojeek", '<title>Captcha</title><script src="/js/vendor/altcha.js"></script>', "captcha title"),
        ("qwant", "<title>Service unavailable</title><p>Prove you are human</p>", "challenge title"),
        ("yandex", '<title>Are you not a robot?</title><div class="smartcaptcha"></div>', "challenge title"),
        ("mojeek", '<ul class="results-standard"><li><a class="ob" href="https://example.com/a">Alpha</a></li></ul>', None),
        ("brave", "<html><head><title>Just a moment...</title></head><body>short</body></html>", "strong: just a moment"),
        ("brave", "<html><title>x</title><body data-say='Just A Moment'>text</body></html>", "strong: just a moment"),
        ("mojeek", "<title>Search</title><body>ALTCHA widget</body>", "medium: altcha"),
        ("google", '<noscript><meta http-equiv="refresh" content="0;url=/httpservice/retry/enablejs?sei=x"></noscript>', "challenge script"),
        ("google_lite", "<title>Enable JavaScript to use search</title><html></html>", "challenge title"),
        ("google", "<div>Our systems have detected unusual traffic</div>", "strong: unusual traffic"),
        ("google", '<div id="captcha"></div>', "challenge script"),
        ("google", SERP, None),
        ("google_lite", SERP, None),
        ("google_lite", "<html><body>enablejs</body></html>", "medium: enablejs"),
        ("google", "<title>t</title>" + "words " * 200, "no result mark"),
        ("google", "<title>t</title><h3>only one</h3>" + "words " * 200, "no result mark"),
        ("google", "<title>t</title><a href='/url?q=x'>r</a>" + "words " * 200, None),
        ("google", "<title>t</title><a href='https://consent.google.com/x'>c</a>" + "words " * 200, "consent"),
        ("chrome", "<title>t</title>" + "words " * 200, None),
        ("wikipedia", '["captcha", [], [], []]', None),
        ("google", None, "no result mark"),
    ],
)
def test_labels(spark, engine, html, reason):
    page = frame(spark, [(1, engine, PAGE, html)], "page_id long, engine string, url string, html string")
    assert filters.classify_pages(page).first().reason == reason
    assert filters.classify_pages(page, filters.mark_table(page)).first().reason == reason


def test_rendered_pages_are_judged_by_what_they_show(spark):
    html = "<title>t</title><script>just a moment</script>" + "words " * 200
    rows = frame(spark, [(1, "google", PAGE, html, "render"), (2, "brave", PAGE, html, "render"), (3, "brave", PAGE, html, "lite"), (4, "brave", PAGE, html, None)], "page_id long, engine string, url string, html string, source string")
    assert [r.label for r in filters.classify_pages(rows).orderBy("page_id").collect()] == ["ok", "ok", "blocked", "blocked"]


# --- search


def test_a_search_moves_no_page_bodies(spark):
    pages = frame(spark, [(k, f"https://h{k % 3}.example/p{k}", f"Title {k}", f"some words of page {k} " * 3) for k in range(30)] + [(7, "https://h1.example/p7", "Title 7", "some words of page 7 " * 3)], "page_id long, url string, title string, text string")
    q = P.parse_query_operators(frame(spark, [(1, 'intitle:title "of page 7"'), (2, "site:h2.example intext:words"), (3, '"page 2"'), (4, "intitle:nothing")], "query_id int, q string"))
    name = f"t_{uuid.uuid4().hex}"
    search.index_pages(pages, name=name, buckets=3)
    index = search.open_index(spark, name)
    found = search.search_index(index, q)
    want = {(1, 7), *((2, k) for k in range(2, 30, 3)), *((3, k) for k in (2, *range(20, 30)))}
    assert sorted((r.query_id, r.page_id) for r in found.collect()) == sorted(want)
    assert "text" not in index.pieces.columns
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for few in (True, False):  # broadcast, and as if the candidates were many
            if not few:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
                search.broadcast_if_small, real = (lambda df, *a: df), search.broadcast_if_small
            plan = search.search_index(index, q)._jdf.queryExecution().sparkPlan().toString()
            full = search.search_index(index, q)
            tree = full._jdf.queryExecution().executedPlan().toString()
            full.collect()
            for part in re.split(r"Exchange hashpartitioning", tree)[1:]:
                assert not re.match(r"[^\n]*\n[^\n]*(?:FileScan|Project|Filter)[^\n]*\btext#", part)
            assert "text" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        search.broadcast_if_small = real
        spark.sql(f"drop table {name}_pages")
        spark.sql(f"drop table {name}_pieces")
    with pytest.raises(ValueError):
        search.search_index(index, P.parse_query_operators(frame(spark, [(1, "plain words")], "query_id int, q string")))


# --- batches, breakers


def test_answers_can_be_stored_and_taken_again(spark):
    queries = frame(spark, [(1, 1, 0, "k1"), (2, 1, 1, "k2"), (3, 1, 2, "k3")], "query_id long, batch_id long, position int, key string").withColumn("ts", F.expr("timestamp'2026-01-01 10:00:00'"))
    bing = '<li class="b_algo"><h2><a href="https://b{0}.example/">Bing {0}</a></h2></li>'
    pages = [(1, 1, "bing", 0, 1, bing.format(1) + bing.format(2)), (2, 1, "bing", 0, 2, bing.format(1) + bing.format(3)), (3, 2, "bing", 0, 1, "<p>access denied")]
    captured = frame(spark, pages, "page_id long, query_id long, engine string, engine_pos int, page int, html string")
    none = frame(spark, [], f"key string, stored_ts timestamp, engine string, count long, results {pipelines.ANSWER}")
    first, _ = pipelines.batch_search(captured, queries, none)
    got = {r.query_id: r for r in first.collect()}
    assert [(x["rank"], x.url) for x in got[1].results] == [(k, f"https://b{k}.example/") for k in (1, 2, 3)]
    assert (got[1].engine, got[1]["count"], got[1].ok) == ("bing", 3, True) and (got[2].results, got[2].ok, got[3]["count"]) == ([], False, 0)
    stored = pipelines.storable(first, queries)
    again, summary = pipelines.batch_search(captured.limit(0), queries.withColumn("ts", F.expr("ts + interval 1 minute")), stored)
    got = {r.query_id: r for r in again.collect()}
    assert (got[1].cached, got[1].engine, [x.url for x in got[1].results]) == (True, "bing", [f"https://b{k}.example/" for k in (1, 2, 3)])
    assert not got[2].cached and summary.first().completed == 1
    bare, _ = pipelines.batch_search(captured, queries, stored.select("key", "stored_ts"))
    assert [(r.engine, r.results) for r in bare.where("cached").collect()] == [(None, None)]


def test_breaker_state(spark):
    at = lambda s: F.expr(f"timestamp'2026-01-01 00:00:00' + interval {s} second")
    rows = [(1, 0, "a", False), (2, 10, "a", False), (3, 20, "a", False), (4, 0, "b", False), (5, 10, "b", False), (6, 20, "b", True), (7, 5, "c", False), (8, 500, "a", True)]
    log = frame(spark, rows, "event_id long, s int, key string, ok boolean").withColumn("ts", F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)"))
    state = lambda now: {r.key: (r.consecutive_fail, r.open, r.skip_remaining_ms) for r in aggregates.breaker_state(log, now).collect()}
    assert state(at(30)) == {"a": (3, True, 110_000), "b": (0, False, 0), "c": (1, False, 0)}
    assert state(at(140))["a"] == (3, False, 0) and state(at(600))["a"] == (0, False, 0)


def test_extras_come_from_the_first_page_that_has_them(spark):
    shown = '<div class="g"><a href="https://g.example/"><h3>Google</h3></a></div><h3>x</h3><div class="hgKElc">the answer</div>'
    rows = [(1, 1, "google", 1, "<h3>a</h3><h3>b</h3>"), (2, 1, "google", 2, shown), (3, 1, "google", 3, shown.replace("the answer", "other")), (4, 2, "bing", 1, shown), (5, 3, "google", 1, None)]
    out = pipelines.page_extras(frame(spark, rows, "page_id long, query_id long, engine string, page int, html string")).collect()
    assert [(r.query_id, r.engine, r.answer_box.answer, r.knowledge_graph) for r in out] == [(1, "google", "the answer", None)]


def test_fixture_of_spellings_changes_every_kind(spark):
    """The query of spellings is worth nothing if no page is spelled anew."""
    html = views.pages(spark, SF).select(q_pages.respelled(F.col("html")).alias("h"))
    kinds = {"single": r"""href='/""", "bare": r"HREF = /", "data": r'data-url="/', "spread": r"href\n=\n'/"}
    assert all(html.where(F.col("h").rlike(k)).count() > 0 for k in kinds.values())
    assert new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# --- character references


def test_references_without_semicolon(spark):
    """A title that was cut inside a reference keeps what is left of it, in blocks, cards and rendered pages alike; what
    ends with a semicolon is decoded, and odd references do not hide the tags behind them."""
    tails = ["and&amp", "and&am", "a &copy b", "x &#38", "&#; y", "&foo; z"]
    url, want = "https://a.example/x?a=1&amp;b=2", [f"R&D <x> {t}" for t in tails]
    titles = [f"R&amp;D &lt;x&gt; {t}" for t in tails]
    blocks = frame(spark, [(k, PAGE, f'<div class="g"><a href="{url}"><h3>{t}</h3></a></div><p>&#; &#;</p><div class="g"><a href="https://b.example/"><h3>second</h3></a></div>') for k, t in enumerate(titles)])
    cards = frame(spark, [(k, PAGE, f'<section class="result"><a class="result-title" href="{url}">{t}</a></section>') for k, t in enumerate(titles)])
    for fn in (extract.extract_blocks, extract.extract_organic):
        assert [r.title for r in fn(blocks).orderBy("page_id", "pos").collect()] == [x for w in want for x in (w, "second")]
    found = extract.extract_cards(cards.withColumn("engine", F.lit("ecosia"))).orderBy("page_id").collect()
    assert [(r.title, r.url) for r in found] == [(w, "https://a.example/x?a=1&b=2") for w in want]


def test_title_lists(spark):
    """A word that the title has to have rules out pages that only have it in their body, before any body is read."""
    rows = [(k, f"https://a.example/{k}", "zebra" if k < 3 else "page", "a zebra and common words") for k in range(60)]
    pages = frame(spark, rows, "page_id long, url string, title string, text string")
    q = P.parse_query_operators(frame(spark, [(1, 'intitle:ZEBRA "common words"')], "query_id int, q string"))
    index = search.index_pages(pages)
    assert search.candidates(index, search._needs(q)).count() == 3
    assert sorted(r.page_id for r in search.search_index(index, q).collect()) == [0, 1, 2]


def test_a_search_writes_no_pairs(spark, monkeypatch):
    """Pages and queries that all match make n * n rows. They are found inside the pages' rows: what a search writes on
    its way grows with pages and queries only."""
    n, sizes, real = 120, [], search.written

    def counted(df, name):
        out = real(df, name)
        sizes.append(out.count())
        return out

    pages = frame(spark, [(k, f"https://a.example/{k}", f"common title {k}", "some shared words") for k in range(n)], "page_id long, url string, title string, text string")
    index = search.index_pages(pages)
    monkeypatch.setattr(search, "written", counted)
    q = P.parse_query_operators(frame(spark, [(k, 'intitle:common "shared words"') for k in range(n)], "query_id int, q string"))
    assert search.search_index(index, q).count() == n * n
    assert max(sizes) <= n


@pytest.mark.parametrize("rows", [100_000, 2])
def test_index_by_brute_force(spark, monkeypatch, rows):
    """Short terms, odd letters, several sites, file types and exclusions over a saved index; also where queries are more
    than may be broadcast at once. Equal pages count once."""
    monkeypatch.setattr(search, "BROADCAST_ROWS", rows)
    words = ["the", "of", "a", "übergröße", "ou", "w\u00e9", "x𝒳y", "lang", "a b"]
    pages = [(k, f"https://{'abc'[k % 3]}.h{k % 2}.example/{words[k % 9]}/{k}.{'pdf' if k % 4 else 'html'}", f"{words[k % 5]} {words[k % 7]}", " ".join(words[(k * j) % 9] for j in range(1, 5))) for k in range(80)]
    df = frame(spark, pages + pages[:5], "page_id long, url string, title string, text string")
    asked = ['intitle:the -of', '"a b"', 'intitle:x𝒳y', 'intext:ÜBER intitle:of', 'site:h1.example site:a.h1.example -the', 'site:b.h0.example "ou" inurl:html', '"the" filetype:pdf -lang', 'site:.example intext:lang intitle:a', '"nowhere at all"', "site:h0.example"]
    q = P.parse_query_operators(frame(spark, list(enumerate(asked)), "query_id int, q string"))
    low = [(k, u.lower(), t.lower(), b.lower()) for k, u, t, b in pages]
    ok = [
        lambda u, t, b: "the" in t and "of" not in f"{t} {b}", lambda u, t, b: "a b" in f"{t} {b}", lambda u, t, b: "x𝒳y" in t, lambda u, t, b: "über" in b and "of" in t,
        lambda u, t, b: ".h1.example" in u and "the" not in f"{t} {b}", lambda u, t, b: "//b.h0.example" in u and "ou" in f"{t} {b}" and "html" in u, lambda u, t, b: "the" in f"{t} {b}" and u.endswith(".pdf") and "lang" not in f"{t} {b}",
        lambda u, t, b: "lang" in b and "a" in t, lambda u, t, b: False, lambda u, t, b: ".h0.example" in u,
    ]
    want = sorted((n, k) for n, f in enumerate(ok) for k, u, t, b in low if f(u, t, b))
    name = f"t_{uuid.uuid4().hex}"
    try:
        search.index_pages(df, name=name, buckets=3)
        assert sorted((r.query_id, r.page_id) for r in search.search_index(search.open_index(spark, name), q).collect()) == want
        assert sorted((r.query_id, r.page_id) for r in search.search_pages(df, q).collect()) == want
    finally:
        for table in ("pages", "pieces", "lengths"):
            spark.sql(f"drop table if exists {name}_{table}")
    assert {n for n, _ in want} == set(range(10)) - {8}


@pytest.mark.parametrize("n", [34, 36, 2])
def test_organic_query_with_few_results(spark, monkeypatch, tmp_path, n):
    """A query of fewer than five results: its pages keep every card, so the query's own may have none that is no result."""
    pages = [(k, f"https://a.example/{k}", f"<html><head><title>Page {k}</title></head><body>words</body></html>") for k in range(n)]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(oracle, "SF", str(tmp_path))
    monkeypatch.setattr(oracle, "TABLES", ["pages"])
    oracle.agree(spark, registry.queries()["x4_extract_organic"], registry.oracle_sql()["x4_extract_organic"])

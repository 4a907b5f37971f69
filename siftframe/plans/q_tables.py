"""Queries of filters, joins, aggregates, windows, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import aggregates as A
from ..operators import filters as FI
from ..operators import joins as J
from ..operators import limits as L
from ..operators import projections as P
from ..operators import search as SE
from ..operators import sets as U
from ..operators import windows as W
from ..sources.folders import written
from . import sqltext as S
from . import views as V

Q: dict = {}
SQL: dict = {}

RES = ["query_id", "engine", "page", "pos", "title", "url"]


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_TEXT = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))"""


# What each page is made to show, as a table of conditions; the first that holds is the reason.
_F1 = """with p as (select page_id, page_id % 4 as e, page_id % 5 as sign, page_id % 3 as way from pages),
r as (select page_id, case when page_id % 7 = 0 then 'url' when sign = 4 and e = 3 then 'login' when sign = 1 then 'strong: access denied'
  when sign = 3 and e = 0 then 'strong: our systems have detected' when sign = 3 and e in (1, 2) then 'strong: just a moment'
  when sign = 4 and e = 0 then 'challenge script' when sign = 4 and e = 2 then 'medium: altcha' when sign = 2 and e in (0, 2) and not (e = 0 and way > 0) then 'medium: robot'
  when e = 0 and way = 0 then 'no result mark' end as reason from p)
select page_id, reason, case when reason is null then 'ok' else 'blocked' end as label from r"""


@query(_F1)
def f1_classify_pages(spark, sf_dir):
    """Plain pages of four engines with a sign of a block page each. Pages of bing and shodan, and two of three of google,
    have a result of their engine. "Just a moment" stands in the text, in the title or in a script."""
    p = V.pages(spark, sf_dir)
    k, sign, way = F.col("page_id"), F.col("page_id") % 5, F.col("page_id") % 3
    engine = F.get(F.array(*[F.lit(e) for e in ("google", "bing", "brave", "shodan")]), (k % 4).cast("int"))
    result = (
        F.when((k % 4 == 0) & (way > 0), "<h3>one</h3><h3>two</h3>").when(k % 4 == 1, '<li class="x b_algo"><a href="http://a/">r</a></li>')
        .when(k % 4 == 3, '<a href="https://s.example/host/1.2.3.4">h</a>').otherwise("")
    )
    moment = F.when(way == 0, "<p>Just a moment...").when(way == 1, "<script>say('just a MOMENT')</script>").otherwise("")
    sign_html = (
        F.when(sign == 1, "<p>Access <b>denied</b>").when(sign == 2, "<p>ROBOT").when((sign == 3) & (k % 4 == 0), "<div>Our systems have detected something</div>")
        .when((sign == 3) & (k % 4 != 3), moment).when((sign == 4) & (k % 4 == 0), '<div id="captcha"></div>').when((sign == 4) & (k % 4 == 3), "<p>Please log in")
        .when((sign == 4) & (k % 4 == 2), "<p>ALTCHA widget").otherwise("")
    )
    titled = (sign == 3) & (k % 4).isin(1, 2) & (way == 2)
    html = F.when(titled, F.regexp_replace("html", r"(?is)<title[^>]*>.*?</title>", "<title>Just a moment...</title>")).otherwise(F.col("html"))
    url = F.when(k % 7 == 0, F.concat("url", F.lit("/sorry/x"))).otherwise(F.col("url"))
    p = p.select("page_id", engine.alias("engine"), url.alias("url"), F.concat(html, result, sign_html).alias("html"))
    return FI.classify_pages(p).select("page_id", "label", "reason")


@query("""select page_id, case when page_id % 3 = 1 then 'medium: robot' end as reason, case when page_id % 3 = 1 then 'blocked' else 'ok' end as label from pages""")
def f1_mark_table(spark, sf_dir):
    """Pages of an engine that the library does not know, all of them with a weak word: a row of the caller's table says what
    its results look like, and pages that have one are fine."""
    p = V.pages(spark, sf_dir)
    hit = F.when(F.col("page_id") % 3 == 0, "<hit-row>r</hit-row>").when(F.col("page_id") % 3 == 2, '<div class="own result">r</div>').otherwise("<div>none</div>")
    rules = FI.mark_table(p).unionByName(spark.createDataFrame([("Mine", '(?i)<hit-row|class="own result"')], "engine string, mark string"))
    shown = p.select("page_id", "url", F.lit("mine").alias("engine"), F.concat("html", F.lit("<p>a robot"), hit).alias("html"))
    return FI.classify_pages(shown, rules).select("page_id", "label", "reason")


@query("select page_id, page_id % 3 = 1 as has_results, page_id % 3 = 2 as soft_empty from pages")
def f2_looks_like_results(spark, sf_dir):
    k = F.col("page_id") % 3
    p = V.pages(spark, sf_dir, "page_id", "html").withColumn("html", F.when(k == 1, F.concat("html", F.lit("<cite>x</cite>"))).when(k == 2, F.substring("html", 1, 60)).otherwise(F.col("html")))
    return FI.looks_like_results(p).select("page_id", "has_results", "soft_empty")


@query(f"with {V.RESULTS} select {', '.join(RES)} from res where pos % 5 not in (1, 2)")
def f3_drop_non_organic(spark, sf_dir):
    r = V.results(spark, sf_dir)
    m = F.col("pos") % 5
    marked = r.withColumn("_u", F.col("url")).withColumn("_t", F.col("title")).withColumn("url", F.when(m == 1, "https://www.youtube.com/watch?v=1").otherwise(F.col("url"))).withColumn("title", F.when(m == 2, "AI Overview for you").otherwise(F.col("title")))
    return FI.drop_non_organic(marked).select("query_id", "engine", "page", "pos", F.col("_t").alias("title"), F.col("_u").alias("url"))


_H = S.host("url")


@query(rf"""with {V.RESULTS} select {", ".join(RES)} from res where {_H} = '' or {S.below(S.bare("url"), "example.net")} or not (
regexp_matches({S.bare("url")}, '(^|\.)(blog|blogs|weblog|forum|forums|board|boards|community|talk|discuss)\.') or {S.below(S.bare("url"), "spam-farm.example.org")})""")
def f4_filter_domains(spark, sf_dir):
    policy = {"blog": True, "forum": True, "exclude_domains": ["spam-farm.example.org"], "allow_domains": ["example.net"]}
    return FI.filter_domains(V.results(spark, sf_dir), policy).select(*RES)


@query(rf"""with {V.RESULTS}, c as (select distinct {S.bare("url")} as d from pages where {S.bare("url")} < 'm')
select {", ".join(RES)} from res where not exists (select 1 from c where {S.bare("url")} = d or ends_with({S.bare("url")}, '.' || d))""")
def f4_category_table(spark, sf_dir):
    """A caller's table in place of the built-in list: half of the hosts are of a category that the policy leaves out."""
    hosts = V.pages(spark, sf_dir, "url").select(urls.bare_host(F.col("url")).alias("domain")).distinct().where("domain < 'm'")
    policy = {"dev": True, "social": False}
    return FI.filter_domains(V.results(spark, sf_dir), policy, categories=hosts.withColumn("category", F.lit("dev"))).select(*RES)


@query(rf"""with {V.QUERIES}, {V.RESULTS[V.RESULTS.index("deco0") :]}, r as (select * replace (page_id_ as query_id) from (select *, pos as page_id_ from res))
select r.query_id, engine, page, pos, title, url from r join qs using (query_id)
where case query_id % 5 when 0 then contains(lower(url), 'en') when 1 then regexp_matches(lower({S.part("url", 3)}), '\.(pdf|html)$') when 3 then ({S.bare("url")} like '%.com') and contains(lower(url), 'page') when 4 then false else true end""")
def f5_enforce_operators(spark, sf_dir):
    r = V.results(spark, sf_dir).withColumn("query_id", F.col("pos").cast("long"))
    return FI.enforce_operators(r, P.parse_query_operators(V.queries(spark, sf_dir))).select(*RES)


@query(rf"""with {V.RESULTS}, c as (select query_id, engine_pos, page, pos, {S.clean("url")} as link from res where pos % 6 not in (1, 2, 3)),
f as (select query_id, link, min((engine_pos, page, pos)) as o from c group by query_id, link)
select query_id, link as url, row_number() over (partition by query_id order by o) as rank from f""")
def f6_drop_junk_links(spark, sf_dir):
    m = F.col("pos") % 6
    r = V.results(spark, sf_dir).withColumn("url", F.when(m == 1, "https://www.google.com/preferences").when(m == 2, "/search?q=x").otherwise(F.col("url")))
    r = r.withColumn("title", F.when(m == 3, "https://title.example/").otherwise(F.coalesce(F.nullif("title", F.lit("")), F.lit("t"))))
    return FI.drop_junk_links(r).select("query_id", "url", F.col("rank").cast("long"))


@query(rf"""with h as (select page_id, url, unnest(['http://10.0.0.' || page_id || '/', 'http://172.' || (page_id % 40) || '.1.1/', url, 'https://x.internal/', 'ftp://a.example/', 'http://100.64.1.1:8080/x']) as dst_url from pages)
select page_id, dst_url from h where dst_url = url or (dst_url like 'http://172.%' and not (page_id % 40 between 16 and 31))""")
def f7_guard_links(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "url")
    k = F.col("page_id")
    forms = F.array(F.concat(F.lit("http://10.0.0."), k.cast("string"), F.lit("/")), F.concat(F.lit("http://172."), (k % 40).cast("string"), F.lit(".1.1/")), F.col("url"), F.lit("https://x.internal/"), F.lit("ftp://a.example/"), F.lit("http://100.64.1.1:8080/x"))
    return FI.guard_links(p.select("page_id", F.explode(forms).alias("dst_url"))).select("page_id", "dst_url")


def _enriched(spark, sf_dir):
    return J.enrich_hosts(P.to_host_records(V.host_pages(spark, sf_dir)), V.scan(spark, sf_dir))


_ENRICH = rf"""with {V.HOST_PAGES}, {V.SCAN},
n0 as (select *, coalesce(list_filter(list_transform(hostnames, lambda x: trim(x)), lambda x: x <> '' and not regexp_full_match(x, '\d+\.\d+\.\d+\.\d+')), []) as names, {S.host("url")} as uh from hp),
n as (select page_id, coalesce(ip, case when regexp_full_match(uh, '\d+\.\d+\.\d+\.\d+') then uh end, any_ip) as ip_str,
case when page_id % 3 = 0 then 8080 when page_id % 2 = 0 then case when page_id % 3 * 100 > 0 then (page_id % 3 * 100)::int else 22 end when url like 'https:%' then 443 else 80 end as port,
case when page_id % 3 = 0 or list_contains(names, uh) then names else [uh] || names end as hn from n0),
en as (select n.page_id, n.ip_str, n.port, sc.ip is not null as scanned, coalesce(sc.ports, []) as ports, case when sc.ip is null then hn else hn || ['scan.example'] end as hostnames,
coalesce(sc.vulns, []) as vulns, vendor, product, version from n left join sc on n.ip_str = sc.ip)"""


@query(f"{_ENRICH} select page_id, ip_str, port, array_to_string(ports, ',') as ports, array_to_string(hostnames, ',') as hostnames, array_to_string(vulns, ',') as vulns, vendor, product, version from en")
def j1_enrich_hosts(spark, sf_dir):
    h = lambda f: F.array_join(F.col(f"host.{f}").cast("array<string>"), ",").alias(f)
    return _enriched(spark, sf_dir).select("page_id", "host.ip_str", "host.port", h("ports"), h("hostnames"), h("vulns"), "host.vendor", "host.product", "host.version")


@query(f"{_ENRICH} select page_id from en where len(ports) >= 2 and len(vulns) > 0")
def f8_filter_hosts(spark, sf_dir):
    return FI.filter_hosts(_enriched(spark, sf_dir), min_ports=2, has_vulns=True).select("page_id")


@query(f"with {V.RESULTS} select {', '.join(RES)} from res where pos % 5 not in (0, 1)")
def f9_valid_results(spark, sf_dir):
    m = F.col("pos") % 5
    r = V.results(spark, sf_dir).withColumn("_t", F.col("title")).withColumn("url", F.when(m == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url"))).withColumn("title", F.when(m == 1, "  ").otherwise("t"))
    return FI.valid_results(r).select("query_id", "engine", "page", "pos", F.col("_t").alias("title"), "url")


_LOOKUPS = rf"""with {V.SCAN}, d as (select doc_id, coalesce(nullif(regexp_extract(text, '\b(\d{{1,3}}(\.\d{{1,3}}){{3}})\b', 1), ''), case when doc_id % 3 = 0 then 'no address' else {V.address_sql("doc_id")} end) as ip from documents),
lu as (select doc_id, ip, regexp_full_match(ip, '\d{{1,3}}(\.\d{{1,3}}){{3}}') as valid, ip in (select ip from sc) as known from d)"""


def _lookups(spark, sf_dir):
    from ..functions.hosts import ip_in

    k = F.col("doc_id")
    other = F.when(k % 3 == 0, "no address").otherwise(V.address(k))
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(ip_in(F.col("text")), other).alias("ip"))
    return FI.label_ip_rows(d, V.scan(spark, sf_dir))


@query(f"{_LOOKUPS} select doc_id, ip, valid and known as found, case when not valid then 'INVALID_IP' when not known then 'NOT_FOUND' end as code from lu")
def f10_label_ip_rows(spark, sf_dir):
    return _lookups(spark, sf_dir).select("doc_id", "ip", "found", "code")


@query(f'{_LOOKUPS} select count(*) as "count", count(*) filter (valid and known) as found from lu')
def a8_host_lookup_summary(spark, sf_dir):
    return A.host_lookup_summary(_lookups(spark, sf_dir))


@query(rf"""with p as (select page_id, url, {S.bare("url")} as h, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, {_TEXT} as body from pages),
hs as (select distinct h from p), q as (select ('0x' || substr(md5(h), 1, 12))::bigint as query_id, h from hs),
b as (select p.*, regexp_replace(title, '\s+', ' ', 'g') || ' ' || body as both_ from p)
select 2 * query_id as query_id, page_id from q join b on b.h = q.h or ends_with(b.h, '.' || q.h) where contains(lower(url), 'http') and not contains(both_, 'the')
union all select 2 * query_id + 1, page_id from q join b on b.h = q.h or ends_with(b.h, '.' || q.h) where contains(both_, 'of') and contains(body, 'a')""")
def f11_search_pages(spark, sf_dir):
    p = V.pages(spark, sf_dir).select("page_id", "url", FI.title_of(F.col("html")).alias("title"), FI.visible_text(F.col("html")).alias("text"))
    names = V.pages(spark, sf_dir, "url").select(urls.bare_host(F.col("url")).alias("h")).distinct()
    number = F.conv(F.substring(F.md5("h"), 1, 12), 16, 10).cast("long")
    forms = F.array(F.concat(F.lit("site:"), "h", F.lit(" inurl:http -the")), F.concat(F.lit("site:"), "h", F.lit(' "of" intext:a')))
    q = names.select(number.alias("n"), F.posexplode(forms).alias("k", "q")).select((F.col("n") * 2 + F.col("k")).alias("query_id"), "q")
    return SE.search_pages(p, P.parse_query_operators(q)).select("query_id", "page_id")


_FREE = rf"""with p as (select page_id, lower(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\s+', ' ', 'g')) as title, {_TEXT} as body from pages),
w as (select page_id, title, body, string_split(title, ' ') as ts, string_split(body, ' ') as bs from p),
q as (select 2 * page_id as query_id, ts[1] as need_title, bs[3] || ' ' || bs[4] as phrase, bs[len(bs)] as never from w where len(bs) >= 6 and length(ts[1]) >= 3 and bs[3] || ' ' || bs[4] <> bs[len(bs)]),
q2 as (select query_id, need_title, phrase from q where regexp_full_match(need_title, '[a-z]+') and regexp_full_match(phrase, '[a-z]+ [a-z]+'))
select query_id, w.page_id as page_id from q2 join w on contains(title, need_title) and contains(title || ' ' || body, phrase)"""


@query(_FREE)
def f11_piece_index(spark, sf_dir):
    """Searches without site:, a phrase and a word of the title for each page, over a saved index that two searches share."""
    import uuid

    p = V.pages(spark, sf_dir).select("page_id", "url", FI.title_of(F.col("html")).alias("title"), FI.visible_text(F.col("html")).alias("text"))
    name = f"siftframe_{uuid.uuid4().hex}"
    p = SE.index_pages(p, name=name, buckets=16).pages
    first = F.split("text", " ", 6)
    last = F.lower(F.substring_index("text", " ", -1))
    words = p.select("page_id", F.lower(F.substring_index("title", " ", 1)).alias("t"), F.lower(F.concat_ws(" ", F.get(first, 2), F.get(first, 3))).alias("ph"), F.size(first).alias("n"), last.alias("z"))
    words = words.where("n >= 6 and length(t) >= 3 and t rlike '^[a-z]+$' and ph rlike '^[a-z]+ [a-z]+$' and ph <> z")
    q = P.parse_query_operators(words.select((2 * F.col("page_id")).alias("query_id"), F.concat(F.lit("intitle:"), "t", F.lit(' "'), "ph", F.lit('"')).alias("q")))
    q = written(q, "searches")
    halves = [SE.search_index(SE.open_index(spark, name), q.where(f"query_id % 4 = {k}")) for k in (0, 2)]
    return halves[0].unionByName(halves[1]).select("query_id", "page_id")


@query(rf"""with {V.QUERIES} select query_id, case query_id % 4 when 0 then 'bing' when 1 then 'google' when 2 then 'wiby' else 'unknown' end as engine,
case query_id % 5 when 0 then case query_id % 4 when 0 then 'site' when 1 then 'site,inurl' when 2 then '' else 'site' end
when 1 then case query_id % 4 when 2 then '' else 'site,filetype' end when 2 then ''
when 3 then case query_id % 4 when 0 then 'site,intitle' when 1 then 'site,inurl,intitle' when 2 then '' else 'site' end
else case query_id % 4 when 1 then 'allintext' else '' end end as supported from qs""")
def j2_engine_support(spark, sf_dir):
    q = P.parse_query_operators(V.queries(spark, sf_dir))
    names = F.array(*[F.lit(x) for x in ("bing", "google", "wiby", "unknown")])
    out = J.engine_support(q.withColumn("engine", F.get(names, (F.col("query_id") % 4).cast("int"))))
    return out.select("query_id", "engine", F.array_join("supported", ",").alias("supported"))


@query(rf"select page_id, url from pages where {S.bare('url')} like '%.net' or {S.below(S.bare('url'), 'example.org')}")
def j3_match_domains(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "url")
    rules = p.limit(1).select(F.explode(F.array(F.lit(".net"), F.lit("WWW.example.org"), F.lit(""))).alias("target"))
    return J.match_domains(p, rules).select("page_id", "url")


def _cache(spark, sf_dir, ttl=86_400):
    o = V.outcomes(spark, sf_dir)
    stored = o.where("ok").select("key", F.col("ts").alias("stored_ts"), F.col("event_id").alias("stored_id"))
    requests = o.where("not ok").select(F.col("event_id").alias("request_id"), "key", "ts")
    return (*J.split_cached(requests, stored, ttl), stored)


_CACHE = f"""with {V.OUTCOMES}, st as (select key, ts as stored_ts, event_id as stored_id from outc where ok), rq as (select event_id as request_id, key, ts from outc where not ok),
hit as (select request_id, rq.key, arg_max(stored_id, stored_ts) as stored_id from rq join st on rq.key = st.key and stored_ts <= ts and epoch(ts) - epoch(stored_ts) <= 3600 group by request_id, rq.key)"""


@query(f"{_CACHE} select request_id, rq.key as key, stored_id, stored_id is not null as hit from rq left join hit using (request_id)")
def j4_split_cached(spark, sf_dir):
    hits, misses, _ = _cache(spark, sf_dir, 3600)
    cols = ["request_id", "key", "stored_id", "hit"]
    return hits.withColumn("hit", F.lit(True)).select(*cols).unionByName(misses.withColumns({"stored_id": F.lit(None).cast("long"), "hit": F.lit(False)}).select(*cols))


@query(f'{_CACHE} select (select count(*) from hit) as hits, (select count(*) from rq) - (select count(*) from hit) as misses, (select count(*) from st) as "size"')
def a9_reuse_rate(spark, sf_dir):
    return A.reuse_rate(*_cache(spark, sf_dir, 3600))


@query(f"""with {V.RESULTS}, q as (select distinct query_id from res), s as (select query_id, list(title order by pos, engine_pos) as l from res group by query_id), n as (select query_id, list(url order by pos, engine_pos) filter (query_id % 2 = 0) as l from res group by query_id)
select query_id, array_to_string(s.l[1:10], '|') as suggestions, array_to_string(n.l[1:10], '|') as news from q left join s using (query_id) left join n using (query_id)""")
def j5_attach_enrichment(spark, sf_dir):
    r = V.results(spark, sf_dir)
    lists = lambda c, rows: rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "engine_pos", c))).alias("l")).select("query_id", F.transform("l", lambda x: x[c]).alias("l"))
    s, n = lists("title", r).withColumnRenamed("l", "suggestions"), lists("url", r.where("query_id % 2 = 0")).withColumnRenamed("l", "news")
    out = J.attach_enrichment(r.select("query_id").distinct(), s, n)
    return out.select("query_id", F.array_join("suggestions", "|").alias("suggestions"), F.array_join("news", "|").alias("news"))


_BREAKER = f"""with {V.OUTCOMES}, br as (select key, count(*) filter (code = 'OK') as ok, count(*) filter (code in ('BLOCKED', 'SORRY')) as blocked, count(*) filter (code in ('EMPTY_RESULTS', 'LITE_EMPTY')) as empty,
count(*) filter (code not in ('OK', 'BLOCKED', 'SORRY', 'EMPTY_RESULTS', 'LITE_EMPTY')) as error, arg_max(code, (ts, event_id)) as last_code from outc group by key)"""


@query(f"""{_BREAKER}, {V.LAST_STREAK}, reg as (select distinct 'k' || (page_id % 60) as engine from pages)
select engine, coalesce(ok, 0) as ok, coalesce(blocked, 0) as blocked, coalesce(empty, 0) as empty, coalesce(error, 0) as error, coalesce(consecutive_fail, 0) as consecutive_fail,
coalesce(skip_remaining_ms > 0, false) as "open", coalesce(skip_remaining_ms, 0) as skip_remaining_ms, last_code from reg left join br on br.key = engine left join ls on ls.key = engine""")
def j6_engine_status(spark, sf_dir):
    """Counters of each engine, and its breaker as it is at the newest outcome."""
    registry = V.pages(spark, sf_dir, "page_id").select(F.concat(F.lit("k"), (F.col("page_id") % 60).cast("string")).alias("engine")).distinct()
    o = V.outcomes(spark, sf_dir)
    state = A.breaker_state(o.join(F.broadcast(o.agg(F.max("ts").alias("now"))), F.lit(True)), F.col("now"))
    return J.engine_status(registry, A.breaker_counters(o), state)


_COUNTS = "count(*) filter (ok) as ok, count(*) filter (not ok) as fail, count(*) filter (source = 'lite') as lite, count(*) filter (source = 'render') as render"


@query(f"with {V.OUTCOMES} select count(*) as search, {_COUNTS} from outc")
def a1_outcome_totals(spark, sf_dir):
    return A.outcome_totals(V.outcomes(spark, sf_dir))


@query(f"""with {V.OUTCOMES}, k as (select outc.*, event_type from outc join events using (event_id)), s as (select * from k where event_type not in ('purchase', 'signup'))
select (select count(*) from s) as search, (select count(*) from s where ok) as ok, (select count(*) from s where not ok) as fail, (select count(*) from s where source = 'lite') as lite,
(select count(*) from s where source = 'render') as render, count(*) filter (event_type = 'purchase') as batch, count(*) filter (event_type = 'signup') as crawl from k""")
def a1_run_totals(spark, sf_dir):
    """Two kinds of events as runs of batches and crawls, which are no searches."""
    e = V.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", "batch").when(F.col("event_type") == "signup", "crawl").alias("kind"))
    return A.outcome_totals(V.outcomes(spark, sf_dir).join(e, "event_id"))


@query(f"with {V.OUTCOMES}, k as (select *, unnest(case when event_id % 10 = 0 then [key, 'all'] else [key] end) as one from outc) select one as key, {_COUNTS} from k group by one")
def a2_outcomes_by_key(spark, sf_dir):
    o = V.outcomes(spark, sf_dir).withColumn("key", F.when(F.col("event_id") % 10 == 0, F.concat("key", F.lit(",all"))).otherwise(F.col("key")))
    return A.outcomes_by_key(o)


@query(f"with {V.OUTCOMES}, l as (select duration_ms from outc where duration_ms >= 0 order by ts desc, event_id desc limit 500) select count(*) as n, floor(quantile_disc(duration_ms, 0.5) + 0.5)::bigint as p50, floor(quantile_disc(duration_ms, 0.95) + 0.5)::bigint as p95, floor(max(duration_ms) + 0.5)::bigint as max from l")
def a3_latency_percentiles(spark, sf_dir):
    return A.latency_percentiles(V.outcomes(spark, sf_dir))


@query(f"{_BREAKER} select * from br")
def a4_breaker_counters(spark, sf_dir):
    return A.breaker_counters(V.outcomes(spark, sf_dir))


@query(f"""with {V.OUTCOMES}, h as (select 'h' || (event_id % 7) as key, ts, event_id, case when code = 'TIMEOUT' then 'SOFT_BLOCK' else code end as code from outc)
select key, count(*) filter (code = 'OK') as ok, count(*) filter (code = 'BLOCKED') as blocked, count(*) filter (code = 'SOFT_BLOCK') as empty, count(*) filter (code = 'LITE_EMPTY') as error,
arg_max(code, (ts, event_id)) as last_code, count(*) as uses from h group by key""")
def a4_host_counters(spark, sf_dir):
    """Per host: a soft block counts as empty, an empty answer as an error, and every use counts."""
    host = F.concat(F.lit("h"), (F.col("event_id") % 7).cast("string"))
    o = V.outcomes(spark, sf_dir).withColumns({"key": host, "code": F.when(F.col("code") == "TIMEOUT", "SOFT_BLOCK").otherwise(F.col("code"))})
    return A.breaker_counters(o, per_host=True)


def _query_outcomes(spark, sf_dir):
    r = V.results(spark, sf_dir)
    return r.select("query_id", "engine", (F.col("pos") % 3 != 0).alias("ok"), F.when(F.col("pos") % 2 == 0, "lite").otherwise("render").alias("source"), (F.col("pos") % 97).cast("double").alias("duration_ms"), "engine_pos")


@query(f"""with {V.RESULTS} select query_id, count(distinct engine) as engines_tried, count(distinct engine) filter (pos % 3 <> 0) as engines_ok, max(pos % 97)::double as duration_ms,
array_to_string(list_sort(list(distinct case when pos % 2 = 0 then 'lite' else 'render' end)), '+') as sources, count(*) as "count" from res group by query_id""")
def a5_merge_summary(spark, sf_dir):
    return A.merge_summary(V.results(spark, sf_dir), _query_outcomes(spark, sf_dir))


@query(f"""with {V.OUTCOMES} select event_id // 100 as batch_id, count(*) as batch_size, count(*) filter (ok) as completed,
(max(epoch_us(ts) + floor(duration_ms * 1000)::bigint) - min(epoch_us(ts))) / 1000.0 as duration_ms from outc group by 1""")
def a6_batch_summary(spark, sf_dir):
    out = A.batch_summary(V.outcomes(spark, sf_dir).withColumn("batch_id", F.floor(F.col("event_id") / 100)))
    return out.withColumn("duration_ms", F.round("duration_ms", 4))


@query(f"with {V.RESULTS} select query_id, engine, pos, row_number() over (partition by query_id order by engine_pos, page, pos) as rank, row_number() over (partition by query_id, engine order by engine_pos, page, pos) as engine_rank from res")
def w1_with_ranks(spark, sf_dir):
    r = W.with_ranks(W.with_ranks(V.results(spark, sf_dir)), ["query_id", "engine"], out="engine_rank")
    return r.select("query_id", "engine", "pos", "rank", "engine_rank")


_FIRST = f"with {V.RESULTS}, fw as (select *, row_number() over (partition by query_id, url order by engine_pos, page, pos) as k from res)"


@query(f"{_FIRST} select {', '.join(RES)} from fw where k = 1")
def w2_first_wins(spark, sf_dir):
    return W.first_wins(V.results(spark, sf_dir)).select(*RES)


_CANON = f"with {V.RESULTS}, fc as (select *, row_number() over (partition by query_id, {S.canonical('url')} order by engine_pos, page, pos) as k from res), fd as (select *, row_number() over (partition by query_id order by engine_pos, page, pos) as r from fc where k = 1)"


@query(f"{_CANON} select {', '.join(RES)} from fd where r <= 25")
def w3_dedupe_canonical(spark, sf_dir):
    return W.dedupe_canonical(V.results(spark, sf_dir), 25).select(*RES)


@query(f"""with {V.RESULTS}, o as (select *, pos % 4 <> 0 or pos % 3 = 0 as organic from res), n as (select *, count(*) filter (organic) over (partition by query_id, page) as n from o),
k as (select * from n where n < 5 or organic) select query_id, page, engine, pos, row_number() over (partition by query_id, page order by pos, engine_pos) as rank from k""")
def w4_keep_organic(spark, sf_dir):
    r = V.results(spark, sf_dir).withColumn("snippet", F.when(F.col("pos") % 4 != 0, "s")).withColumn("displayed_link", F.when(F.col("pos") % 3 == 0, "d"))
    return W.keep_organic(r, by=("query_id", "page"), order=("pos", "engine_pos")).select("query_id", "page", "engine", "pos", "rank")


_STREAK = f"""with {V.OUTCOMES}, ru as (select *, count(*) filter (ok) over (partition by key order by ts, event_id rows unbounded preceding) as run from outc),
sk as (select *, count(*) filter (not ok) over (partition by key, run order by ts, event_id rows unbounded preceding) as streak from ru)"""


@query(f"{_STREAK} select event_id, key, streak from sk")
def w5_failure_streak(spark, sf_dir):
    return W.failure_streak(V.outcomes(spark, sf_dir)).select("event_id", "key", "streak")


@query(f"""{_STREAK}, bad as (select key, run, ts, event_id from sk where not ok and streak >= 3),
nw as (select *, case when lag(ts) over w is null or ts > lag(ts) over w + interval 6 hours then 1 else 0 end as fresh from bad window w as (partition by key, run order by ts, event_id)),
gr as (select *, sum(fresh) over (partition by key, run order by ts, event_id rows unbounded preceding) as g from nw),
sp as (select key, run, g, min(ts) as f, max(ts) + interval 6 hours as u from gr group by key, run, g), okt as (select key, run - 1 as run, ts as okts from sk where ok)
select sp.key as key, epoch_us(f) as open_from, epoch_us(case when okts is not null and okts < u then greatest(okts, f) else u end) as open_until from sp left join okt on sp.key = okt.key and sp.run = okt.run""")
def w6_breaker_intervals(spark, sf_dir):
    out = W.breaker_intervals(V.outcomes(spark, sf_dir), 3, 6 * 3_600_000)
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {c})").alias(c)
    return out.select("key", us("open_from"), us("open_until"))


@query(f"with {V.OUTCOMES} select event_id, key from (select *, row_number() over (partition by key order by ts desc, event_id desc) as k from outc) where k <= 7")
def w7_last_n(spark, sf_dir):
    return W.last_n(V.outcomes(spark, sf_dir), 7, order=("ts", "event_id")).select("event_id", "key")


@query(f"""with {V.RESULTS}, g as (select * from res where pos % 6 <> 0), f as (select *, row_number() over (partition by query_id, url order by engine_pos, page, pos) as k from g)
select query_id, url, trim(snippet) as snippet, row_number() over (partition by query_id order by engine_pos, page, pos) as position from f where k = 1""")
def w8_with_position(spark, sf_dir):
    r = V.results(spark, sf_dir).withColumn("title", F.when(F.col("pos") % 6 == 0, "").otherwise("t"))
    return W.with_position(r).select("query_id", "url", "snippet", "position")


@query(f"with {V.RESULTS} select {', '.join(RES)} from (select *, row_number() over (partition by query_id order by engine_pos, page, pos) as k from res) where k <= 10")
def l1_top_results(spark, sf_dir):
    return L.top_results(V.results(spark, sf_dir), 10).select(*RES)


def _sorted_hosts(spark, sf_dir):
    rows = P.to_host_records(V.host_pages(spark, sf_dir)).withColumn("pos", F.col("page_id"))
    rows = rows.withColumn("host", F.when(F.col("page_id") % 8 == 7, F.col("host").withField("ip_str", F.lit(None).cast("string"))).otherwise(F.col("host")))
    out = L.sort_hosts(rows, "ip").select("page_id", F.col("host.ip_str").alias("ip_str"))
    return out


@query(rf"""with {V.HOST_PAGES} select page_id, case when page_id % 8 = 7 then null else any_ip end as ip_str from hp""")
def l2_sort_hosts(spark, sf_dir):
    return _sorted_hosts(spark, sf_dir)


@query(f"""{_ENRICH}, q as (select en.*, page_id // 30 as query_id from en) select 'ports' as by_, page_id, row_number() over (partition by query_id order by len(ports) desc, page_id) as position from q
union all select 'vulns', page_id, row_number() over (partition by query_id order by len(vulns) desc, page_id) from q""")
def l2_host_orders(spark, sf_dir):
    """The places of each query's hosts by their number of ports and of vulnerabilities."""
    rows = _enriched(spark, sf_dir).select(V.query_of(F.col("page_id")).alias("query_id"), "page_id", "host")
    place = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(*L.host_order(by), "page_id"))
    parts = [rows.select(F.lit(by).alias("by_"), "page_id", place(by).alias("position")) for by in ("ports", "vulns")]
    return parts[0].unionByName(parts[1])


@query(f"""with {V.RESULTS}, rk as (select *, row_number() over (partition by query_id order by engine_pos, page, pos) as rank from res),
rq as (select query_id, case when query_id % 2 = 0 then 'google' else 'bing' end as e, 10 + query_id % 3 * 5 as num, query_id % 3 + 1 as pg from (select distinct query_id from res))
select query_id, engine, pos, rank from rk join rq using (query_id) where rank > (pg - 1) * case when e = 'google' then 10 else num end and rank <= (pg - 1) * case when e = 'google' then 10 else num end + num""")
def l3_page_slice(spark, sf_dir):
    r = W.with_ranks(V.results(spark, sf_dir))
    q = F.col("query_id")
    requests = r.select("query_id").distinct().select("query_id", F.when(q % 2 == 0, "google").otherwise("bing").alias("engine"), (10 + q % 3 * 5).cast("int").alias("num"), (q % 3 + 1).cast("int").alias("page"))
    return L.page_slice(r, requests).select("query_id", "engine", "pos", "rank")


@query(f"{_FIRST}, t as (select *, row_number() over (partition by query_id order by engine_pos, page, pos) as rank from fw where k = 1) select query_id, url, rank from t where rank <= 15")
def l4_top_up(spark, sf_dir):
    return L.top_up(V.results(spark, sf_dir), 15).select("query_id", "url", "rank")


def _staled(r):
    """Page 2 of every third query repeats page 1."""
    again = r.where("page = 1 and query_id % 3 = 0").withColumn("page", F.lit(2)).withColumn("pos", F.col("pos") + 1_000_000)
    return r.where("not (page = 2 and query_id % 3 = 0)").unionByName(again)


@query(f"with {V.RESULTS} select query_id, url, page, pos, engine from res where query_id % 3 <> 0 or page = 1")
def l5_stop_at_stale_page(spark, sf_dir):
    return L.stop_at_stale_page(_staled(V.results(spark, sf_dir)), order=("page", "pos", "engine_pos")).select("query_id", "url", "page", "pos", "engine")


@query("select page_id, array_to_string((regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))[1:3], ' ') as hrefs from pages")
def l6_cap_list(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "html").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("hrefs"))
    return L.cap_list(p, "hrefs", 3).withColumn("hrefs", F.array_join("hrefs", " "))


@query(f"""{_FIRST}, t as (select *, row_number() over (partition by query_id order by engine_pos, page, pos) as r from fw where k = 1), c as (select *, row_number() over (partition by query_id, {S.canonical("url")} order by engine_pos, page, pos) as kk from t where r <= 30)
select query_id, url, row_number() over (partition by query_id order by engine_pos, page, pos) as rank from c where kk = 1""")
def u1_merge_engines(spark, sf_dir):
    return U.merge_engines(V.results(spark, sf_dir), 30, canonical=True).select("query_id", "url", "rank")


@query(f"""with {V.RESULTS}, g as (select * from res where query_id % 4 <> 0 or engine_pos > 0), w as (select query_id, min(engine_pos) as win from g group by query_id), e as (select distinct query_id, engine, engine_pos from res)
select e.query_id as query_id, engine, case when engine_pos = win then 'OK' else 'EMPTY_RESULTS' end as code, case when engine_pos = win then (select count(*) from g where g.query_id = e.query_id and g.engine_pos = win) else 0 end as n
from e join w on e.query_id = w.query_id where engine_pos <= win""")
def u2_first_nonempty_engine(spark, sf_dir):
    r = V.results(spark, sf_dir)
    rows, tried = U.first_nonempty_engine(r.where("query_id % 4 <> 0 or engine_pos > 0"), r.select("query_id", "engine", "engine_pos").distinct())
    n = rows.groupBy("query_id", "engine").agg(F.count("*").alias("n"))
    return tried.join(n, ["query_id", "engine"], "left").select("query_id", "engine", "code", F.coalesce("n", F.lit(0)).alias("n"))


@query("select page_id, case when page_id % 4 = 0 then 'mojeek' when page_id % 3 = 0 then 'bing,google,duckduckgo' else 'mojeek,duckduckgo,bing' end as try_list from pages")
def u3_fallback_order(spark, sf_dir):
    k = F.col("page_id")
    p = V.pages(spark, sf_dir, "page_id").withColumn("engine_list", F.when((k % 3 == 0) & (k % 4 != 0), F.array(F.lit("bing"), F.lit("google"))).otherwise(F.array(F.lit("mojeek"))))
    return U.fallback_order(p.withColumn("off", k % 4 == 0), off="off").select("page_id", F.array_join("try_list", ",").alias("try_list"))


@query("select page_id, page_id % 3 as shard from pages")
def u4_shard_rows(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id").withColumn("position", F.col("page_id"))
    parts = [U.shard_rows(p, k, 3).withColumn("shard", F.lit(k).cast("long")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("page_id", "shard")


@query(f"select min(page_id) as page_id, {_H} as host from pages group by 2")
def u5_one_per_host(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "url").withColumn("position", F.col("page_id"))
    return U.one_per_host(p).select("page_id", urls.host(F.col("url")).alias("host"))


@query(rf"""with u as (select page_id, {S.canonical("url")} as c, {S.bare("url")} as h from pages), k as (select min(page_id) as page_id, c, h from u group by c, h)
select h as host, count(*) as pages, min(page_id) as first_page from k where not regexp_matches(h, '(^|\.)(blog|blogs|weblog)\.') group by h""")
def flagship_hosts(spark, sf_dir):
    """Canonical pages of each host, blogs left out: canonicalise, dedupe, filter, rank, count."""
    p = V.pages(spark, sf_dir, "page_id", "url").withColumns({"host": urls.bare_host(F.col("url")), "title": F.lit("")})
    kept = FI.filter_domains(W.dedupe_canonical(p, None, ("host",), ("page_id",)), {"blog": True, "social": False})
    ranked = W.with_ranks(kept, "host", ("page_id",))
    return ranked.groupBy("host").agg(F.count("*").alias("pages"), F.min_by("page_id", "rank").alias("first_page"))

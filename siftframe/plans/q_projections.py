"""Queries of the column jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import projections as P
from . import sqltext as S
from . import views as V

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"with {V.DECORATED} select page_id, k, {S.canonical('url')} as canonical_url from deco")
def p1_canonicalize_urls(spark, sf_dir):
    return P.canonicalize_urls(V.decorated(spark, sf_dir), "url", "canonical_url").select("page_id", "k", "canonical_url")


@query(f"with {V.DECORATED} select page_id, k, {S.clean('url')} as clean_url from deco")
def p2_clean_urls(spark, sf_dir):
    return P.clean_urls(V.decorated(spark, sf_dir), "url", "clean_url").select("page_id", "k", "clean_url")


@query(f"""with t as (select page_id, url, case when page_id % 6 = 4 then '' else {S.clean("url")} end as target from pages) select page_id, target from t""")
def p3_unwrap_redirects(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "url")
    enc = F.url_encode("url")
    packed = F.regexp_replace(F.translate(F.base64(F.col("url").cast("binary")), "+/\r\n", "-_"), "=", "")
    forms = F.array(
        F.concat(F.lit("/url?q="), enc, F.lit("&amp;sa=U")), F.concat(F.lit("//duckduckgo.com/l/?uddg="), enc, F.lit("&rut=1")), F.concat(F.lit("https://r.search.yahoo.com/_ylt=A/RU="), enc, F.lit("/RK=2")),
        F.concat(F.lit("https://www.bing.com/ck/a?!&p=1&u=a1"), packed, F.lit("&ntb=1")), F.lit("https://www.google.com/preferences"), F.concat(F.lit("https://www.google.com/url?url="), F.url_encode(F.concat(F.lit("/url?q="), enc))),
    )
    wrapped = p.select("page_id", F.get(forms, (F.col("page_id") % 6).cast("int")).alias("href"))
    return P.unwrap_redirects(wrapped, "href", "target").select("page_id", "target")


@query(r"""with h as (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)
select page_id, href, regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || href as resolved from h where href like '/%'""")
def p4_resolve_links(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "url", "html")
    links = p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).where("href like '/%'")
    return P.resolve_links(links, "href", "url").select("page_id", "href", "resolved")


@query(rf"select page_id, {S.host('url')} as host, {S.bare('url')} as bare_host, len(string_split({S.bare('url')}, '.')) as n_labels from pages")
def p5_host_columns(spark, sf_dir):
    return P.host_columns(V.pages(spark, sf_dir, "page_id", "url")).select("page_id", "host", "bare_host", F.size("host_labels").cast("long").alias("n_labels"))


@query(f"""with {V.DECORATED}, c as (select page_id, k, {S.clean("url")} as link from deco where k < 3),
l as (select page_id, first(link order by length(link) desc, k) as best_link from c where link <> '' group by page_id) select page_id, best_link from l""")
def p6_pick_best_link(spark, sf_dir):
    rows = V.decorated(spark, sf_dir).where("k < 3").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("k", "url"))).alias("u"))
    urls_ = F.transform("u", lambda x: x["url"])
    rows = rows.select("page_id", F.array(F.concat_ws(" ", F.get(urls_, 0), F.lit("/url?q=https://www.google.com/long/long/long/long/long/long/long/long/long/long/long"), F.get(urls_, 1)), F.get(urls_, 2), F.lit(None)).alias("candidates"))
    return P.pick_best_link(rows, "candidates").select("page_id", "best_link")


@query(rf"""with p as (select page_id, {S.host("url")} as h, {S.part("url", 3)} as path from pages)
select page_id, 'https://' || h || case when page_id % 3 = 0 then '/' else '/' || regexp_replace(path, '^/+|/+$', '', 'g') end as breadcrumb_url from p where page_id % 5 <> 0
union all select page_id, '' from p where page_id % 5 = 0""")
def p7_breadcrumb_to_url(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "url")
    shown = F.replace(F.regexp_replace(urls.path(F.col("url")), "^/+|/+$", ""), F.lit("/"), F.lit(" › "))
    cite = F.concat(F.lit("<b>"), urls.host(F.col("url")), F.lit("</b> › "), shown, F.when(F.col("page_id") % 3 == 0, " › ...").otherwise(""))
    rows = p.select("page_id", F.when(F.col("page_id") % 5 == 0, "no host here").otherwise(cite).alias("cite"))
    return P.breadcrumb_to_url(rows, "cite").select("page_id", "breadcrumb_url")


@query(rf"""select page_id, case when page_id % 2 = 0 then {S.part("url", 1)} || '://' || {S.host("url")} || '/files/p' || page_id else url end as url from pages""")
def p8_expand_index_of(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "url")
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Index of  /files//p"), F.col("page_id").cast("string"), F.lit("/"))).otherwise("Other")
    return P.expand_index_of(p.withColumn("title", title)).select("page_id", "url")


def _plain(x: str) -> str:
    x = f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
    return x


@query(rf"""with p as (select page_id, {_plain("html")} as t from pages)
select page_id, md5(trim(replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''))) as page_md5,
md5(trim(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'))) as feed_md5 from p""")
def p9_clean_text(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "html")
    rows = P.clean_text(P.clean_text(p, "html", "page_text"), "html", "feed_text", feed=True)
    return rows.select("page_id", F.md5("page_text").alias("page_md5"), F.md5("feed_text").alias("feed_md5"))


@query(r"""select conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '\s+', ' ', 'g')), 1, 512) as q from conversations""")
def p10_normalize_queries(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("q"))
    return P.normalize_queries(c)


_NAMES = {"site": "site", "inurl": "inurl", "intitle": "intitle", "allintext": "allintext", "filetype": "(?:filetype|ext)", "url": "url", "mime": "mime"}


def _p11_sql() -> str:
    unq = """case when len(v) >= 2 and v[1] = '"' and v[len(v)] = '"' then v[2:len(v) - 1] else v end"""
    cols = []
    for n, p in _NAMES.items():
        raw = rf"""list_transform(regexp_extract_all(q, '(?i)\b{p}:\s*("[^"]+"|[^\s]+)', 1), lambda v: {unq})"""
        cols.append(f"{raw} as l_{n}")
    first = lambda n: f"array_to_string(list_filter(l_{n}, lambda v, i: v <> '' and list_position(l_{n}, v) = i), '|') as op_{n}"
    return rf"""with {V.QUERIES}, a as (select query_id, q, {", ".join(cols)} from qs)
select query_id, {", ".join(first(n) for n in _NAMES)}, array_to_string(regexp_extract_all(q, '"([^"]{{2,}})"', 1), '|') as phrases, array_to_string(regexp_extract_all(q, '(?:^|\s)-(\S+)', 1), '|') as exclusions,
array_to_string(list_transform(l_site, lambda v: lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '^(?i)https?://', ''), '^(?i)www\.', ''), '^\*\.', '.'), '/.*$', ''))), '|') as site_targets,
query_id % 5 <> 2 as is_dork, query_id % 5 <> 2 as has_operators from a"""


@query(_p11_sql())
def p11_parse_query_operators(spark, sf_dir):
    rows = P.parse_query_operators(V.queries(spark, sf_dir))
    op = lambda n: F.coalesce(F.array_join(F.try_element_at("operators", F.lit(n)), "|"), F.lit("")).alias(f"op_{n}")
    join = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("query_id", *[op(n) for n in _NAMES], join("phrases"), join("exclusions"), join("site_targets"), "is_dork", "has_operators")


_HOST_SQL = rf"""with {V.HOST_PAGES},
n as (select *, coalesce(list_filter(list_transform(hostnames, lambda x: trim(x)), lambda x: x <> '' and not regexp_full_match(x, '\d+\.\d+\.\d+\.\d+')), []) as names, {S.host("url")} as uh from hp)
select page_id, coalesce(ip, case when regexp_full_match(uh, '\d+\.\d+\.\d+\.\d+') then uh end, any_ip) as ip_str,
case when page_id % 3 = 0 then 8080 when page_id % 2 = 0 then case when page_id % 3 * 100 > 0 then (page_id % 3 * 100)::int else 22 end when url like 'https:%' then 443 else 80 end as port,
array_to_string(case when page_id % 3 = 0 or list_contains(names, uh) then names else [uh] || names end, ',') as hostnames, trim(org) as org from n"""


@query(_HOST_SQL)
def p12_to_host_records(spark, sf_dir):
    rows = P.to_host_records(V.host_pages(spark, sf_dir))
    return rows.select("page_id", "host.ip_str", "host.port", F.array_join("host.hostnames", ",").alias("hostnames"), F.col("host.org").alias("org"))


@query("""select page_id, case page_id % 4 when 0 then 'v' || (page_id % 10) when 1 then 'openbsd' end as vendor, case page_id % 4 when 0 then 'nginx' when 1 then 'openssh' end as product,
case page_id % 4 when 0 then case when page_id % 8 = 0 then null else '1.' || page_id end when 1 then '8.9' end as version from pages""")
def p13_parse_cpe(spark, sf_dir):
    k = F.col("page_id")
    new = F.concat(F.lit("cpe:2.3:a:v"), (k % 10).cast("string"), F.lit(":nginx:"), F.when(k % 8 == 0, "*").otherwise(F.concat(F.lit("1."), k.cast("string"))), F.lit(":*:*:*"))
    forms = F.array(new, F.lit("cpe:/a:openbsd:openssh:8.9"), F.lit(" "), F.lit("nonsense"))
    rows = P.parse_cpe(V.pages(spark, sf_dir, "page_id").withColumn("name", F.get(forms, (k % 4).cast("int"))), "name")
    return rows.select("page_id", "cpe.vendor", "cpe.product", "cpe.version")


@query(rf"""with {V.HOST_PAGES}, a as (select page_id, case when page_id % 9 = 0 then 'none' else any_ip end as ip from hp)
select page_id, case when page_id % 9 <> 0 then ((split_part(ip, '.', 1)::bigint * 256 + split_part(ip, '.', 2)::bigint) * 256 + split_part(ip, '.', 3)::bigint) * 256 + split_part(ip, '.', 4)::bigint end as ip_number from a""")
def p14_ip_to_number(spark, sf_dir):
    k = F.col("page_id")
    ip = V.address(k)
    return P.ip_to_number(V.pages(spark, sf_dir, "page_id").withColumn("ip", F.when(k % 9 == 0, "none").otherwise(ip)), "ip").select("page_id", "ip_number")


@query(f"with r as ({_HOST_SQL}) select page_id, ip_str, port, 'tcp' as transport from r")
def p15_project_host_fields(spark, sf_dir):
    rows = P.project_host_fields(P.to_host_records(V.host_pages(spark, sf_dir)), ["ip_str", "port", "missing", "transport"])
    return rows.select("page_id", "host.*")


@query("select page_id, replace(url, '://', '://***@') as masked from pages")
def p16_mask_credentials(spark, sf_dir):
    p = V.pages(spark, sf_dir, "page_id", "url").withColumn("url", F.replace("url", F.lit("://"), F.lit("://user:pa55@")))
    return P.mask_credentials(p, "url", "masked").select("page_id", "masked")


@query("""select page_id, substr(sha256('{"page_id":' || page_id || ',"url":"' || url || '"}'), 1, 16) as fingerprint from pages""")
def p17_content_fingerprint(spark, sf_dir):
    return P.content_fingerprint(V.pages(spark, sf_dir, "page_id", "url"), ["page_id", "url"]).select("page_id", "fingerprint")


@query(f"with {V.OUTCOMES} select event_id, case when event_id % 11 = 0 then 'ERROR' when code in ('BLOCKED', 'TIMEOUT') then 'ENGINE_UNAVAILABLE' else code end as public_code from outc")
def p18_public_code(spark, sf_dir):
    o = V.outcomes(spark, sf_dir).withColumn("code", F.when(F.col("event_id") % 11 != 0, F.col("code")))
    return P.public_code(o).select("event_id", "public_code")


@query("""select page_id, case page_id % 5 when 0 then 'google_lite,bing' when 1 then 'google,duckduckgo,bing' when 2 then 'google' when 3 then 'chrome,yahoo,google_lite' else 'google,duckduckgo,bing' end as engine_list from pages""")
def p19_alias_engines(spark, sf_dir):
    forms = F.array(F.lit("GoogleLite, bing"), F.lit(" * "), F.lit(""), F.lit("chromium,Yahoo,,glite"), F.lit("ALL"))
    p = V.pages(spark, sf_dir, "page_id").withColumn("engines", F.get(forms, (F.col("page_id") % 5).cast("int")))
    return P.alias_engines(p).select("page_id", F.array_join("engine_list", ",").alias("engine_list"))


@query(rf"""with {V.QUERIES}, f as (select query_id, q, query_id % 4 as m, query_id % 5 <> 2 as ops from qs)
select query_id, case when m = 2 then false when m = 1 or ops then true end as social, case when m in (1, 3) or ops then true end as dev, case when m = 1 or ops then true end as blog,
case when m = 3 then 'a.com,b.com' else '' end as exclude_domains,
case query_id % 5 when 0 then regexp_extract(q, '^site:(\S+)', 1) when 1 then regexp_extract(q, '^SITE:https://www\.([^/]+)', 1) else '' end as allow_domains from f""")
def p20_resolve_filter_policy(spark, sf_dir):
    m = F.col("query_id") % 4
    params = F.when(m == 1, F.create_map(F.lit("unique"), F.lit("1"))).when(m == 2, F.create_map(F.lit("social"), F.lit("0"))).when(m == 3, F.create_map(F.lit("exclude"), F.lit("Dev, x"), F.lit("exclude_domains"), F.lit("A.com, b.com,")))
    rows = P.resolve_filter_policy(P.parse_query_operators(V.queries(spark, sf_dir)).withColumn("params", F.coalesce(params, F.create_map().cast("map<string,string>"))))
    return rows.select("query_id", "policy.social", "policy.dev", "policy.blog", F.array_join("policy.exclude_domains", ",").alias("exclude_domains"), F.array_join("policy.allow_domains", ",").alias("allow_domains"))


@query(f"""with {V.OUTCOMES} select event_id, event_id % 5 = 0 as network_failure, code = 'BLOCKED' as hard_block,
case when code in ('BLOCKED', 'TIMEOUT', 'LITE_EMPTY') then 'Engine "' || key || '" could not be reached from this network. No results were returned.' when event_id % 5 = 1 then 'Search failed' else message end as public_message from outc""")
def p21_classify_errors(spark, sf_dir):
    return P.classify_errors(V.outcomes(spark, sf_dir), engine="key").select("event_id", "network_failure", "hard_block", "public_message")

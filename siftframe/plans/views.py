"""Tables that the registered queries derive from the test tables, each in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.crawl import LINKS_A_TASK
from ..operators.filters import title_of
from ..sources.readers import read_pages

ENGINES = ("google", "bing", "duckduckgo")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet", list(columns) or None)


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, k, url): each page's url as it is, with a tracking key, with a fragment, and with a slash at the end."""
    base = pages(spark, sf_dir, "page_id", "url")
    bare = F.regexp_replace("url", "#.*$", "")
    mark = F.when(bare.contains("?"), "&").otherwise("?")
    forms = F.array(F.col("url"), F.concat(bare, mark, F.lit("utm_source=t&gclid=7")), F.concat(bare, F.lit("#x")), F.when(bare.contains("?"), bare).otherwise(F.concat(bare, F.lit("/"))))
    return base.select("page_id", F.posexplode(forms).alias("k", "url"))


DECORATED = """
deco0 as (select page_id, url, regexp_replace(url, '#.*$', '') as bare, unnest([0, 1, 2, 3]) as k from pages),
deco as (select page_id, k, case k when 0 then url when 1 then bare || case when contains(bare, '?') then '&' else '?' end || 'utm_source=t&gclid=7'
         when 2 then bare || '#x' else case when contains(bare, '?') then bare else bare || '/' end end as url from deco0)"""


def query_of(page_id):
    """The query that a page is a result of: as many queries as pages allow, with 30 pages each."""
    return F.floor(page_id / 30).cast("long")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows, a query for each 30 pages: each page comes from two or three engines under one of its spellings."""
    deco = decorated(spark, sf_dir).join(pages(spark, sf_dir, "page_id", "html").select("page_id", title_of(F.col("html")).alias("title")), "page_id")
    names = F.array(*[F.lit(e) for e in ENGINES])
    rows = deco.where("k < 3").where("(page_id + k) % 4 <> 0")
    return rows.select(
        query_of(F.col("page_id")).alias("query_id"), F.get(names, F.col("k")).alias("engine"), F.col("k").alias("engine_pos"),
        (F.floor(F.col("page_id") / 10) % 3 + 1).cast("int").alias("page"), F.col("page_id").cast("int").alias("pos"), "title", "url",
        F.concat(F.lit(" page "), F.col("page_id").cast("string"), F.lit(" ")).alias("snippet"),
    )


RESULTS = (
    DECORATED
    + """,
res as (select page_id // 30 as query_id, ['google', 'bing', 'duckduckgo'][k + 1] as engine, k as engine_pos, (page_id // 10 % 3 + 1)::int as page, page_id::int as pos,
        trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title, deco.url as url, ' page ' || page_id || ' ' as snippet
        from deco join pages using (page_id) where k < 3 and (page_id + k) % 4 <> 0)"""
)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an outcome log: 40 keys, two of five kinds are failures."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    code = F.when(kind == "error", F.when(F.col("event_id") % 3 == 0, "BLOCKED").otherwise("TIMEOUT")).when(kind == "view", "LITE_EMPTY").otherwise("OK")
    return e.select(
        "event_id", "ts", F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), (code == "OK").alias("ok"),
        F.when(F.col("event_id") % 2 == 0, "lite").otherwise("render").alias("source"), F.col("value").alias("duration_ms"), code.alias("code"),
        F.when(F.col("event_id") % 5 == 0, "net::ERR_CONNECTION_RESET").when(F.col("event_id") % 5 == 1, "").otherwise("Bad page").alias("message"),
    )


OUTCOMES = """
outc0 as (select *, case when event_type = 'error' then case when event_id % 3 = 0 then 'BLOCKED' else 'TIMEOUT' end when event_type = 'view' then 'LITE_EMPTY' else 'OK' end as code from events),
outc as (select event_id, ts, 'k' || (user_id % 40) as key, code = 'OK' as ok, case when event_id % 2 = 0 then 'lite' else 'render' end as source, value as duration_ms, code,
         case event_id % 5 when 0 then 'net::ERR_CONNECTION_RESET' when 1 then '' else 'Bad page' end as message from outc0)"""


#: The failures in a row that each key ends with, and for how long it is skipped yet at the time of the newest outcome.
LAST_STREAK = """
lr as (select *, count(*) filter (ok) over (partition by key order by ts, event_id rows unbounded preceding) as run, max(ts) over () as newest from outc),
lt as (select key, arg_max(run, (ts, event_id)) as run, max(ts) as last_ts, any_value(newest) as newest from lr group by key),
lc as (select lt.key as key, count(*) filter (not ok) as n, any_value(lt.last_ts) as last_ts, any_value(lt.newest) as newest from lt join lr on lr.key = lt.key and lr.run = lt.run group by lt.key),
ls as (select key, n as consecutive_fail, case when n >= 3 then greatest(epoch_ms(last_ts) + 120000 - epoch_ms(newest), 0) else 0 end as skip_remaining_ms from lc)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, q): one query with operators for each page, over its own host and words."""
    p = pages(spark, sf_dir, "page_id", "url")
    h = urls.bare_host(F.col("url"))
    word = F.element_at(F.split(h, r"\."), 1)
    forms = F.array(
        F.concat(F.lit("site:"), h, F.lit(' inurl:en "exact phrase" -spam')), F.concat(F.lit("SITE:https://www."), h, F.lit("/x filetype:pdf ext:html ")),
        F.concat(word, F.lit(" plain words")), F.concat(F.lit('intitle:"'), word, F.lit(' page" site:.com  -'), word, F.lit(" inurl:page")),
        F.concat(F.lit('"'), word, F.lit('" allintext:a allintext:a mime:"doc" url:x')),
    )
    return p.select(F.col("page_id").alias("query_id"), F.get(forms, (F.col("page_id") % 5).cast("int")).alias("q"))


QUERIES = r"""
q0 as (select page_id as query_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') as h from pages),
qs as (select query_id, case query_id % 5 when 0 then 'site:' || h || ' inurl:en "exact phrase" -spam' when 1 then 'SITE:https://www.' || h || '/x filetype:pdf ext:html '
       when 2 then split_part(h, '.', 1) || ' plain words' when 3 then 'intitle:"' || split_part(h, '.', 1) || ' page" site:.com  -' || split_part(h, '.', 1) || ' inurl:page'
       else '"' || split_part(h, '.', 1) || '" allintext:a allintext:a mime:"doc" url:x' end as q from q0)"""


def lines_as_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as a link table: from each line's part to the part of the next line of its order. A link that
    comes up in several orders has a row for each; its first position counts."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = li.repartition(max(1, -(-li.count() // LINKS_A_TASK)), "l_orderkey")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    step = li.withColumn("to", F.lead("l_partkey").over(w)).withColumn("n", F.row_number().over(w)).where("to is not null and to <> l_partkey")
    url = lambda c: F.concat(F.lit("https://p.example/"), F.col(c).cast("string"))
    # A link's position counts by order and line, so it fits in one number.
    return step.select(url("l_partkey").alias("src_url"), (F.col("l_orderkey") * 100 + F.col("n")).alias("pos"), url("to").alias("dst_url"))


LINKS = """
li0 as (select l_orderkey, l_partkey, lead(l_partkey) over w as nxt, row_number() over w as n from lineitem
        window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
lk as (select 'https://p.example/' || l_partkey as src_url, min(l_orderkey * 100 + n) as pos, 'https://p.example/' || nxt as dst_url from li0 where nxt is not null and nxt <> l_partkey group by l_partkey, nxt)"""


def address(k, first: int = 10):
    """An address of its own for each number under 790 million (251 ** 3 * 50)."""
    octet = lambda n: F.floor(k / 251**n) % 251
    return F.concat_ws(".", (first + 20 * octet(3)).cast("string"), *[octet(n).cast("string") for n in (2, 1, 0)])


def address_sql(k: str, first: int = 10) -> str:
    return f"(({first} + 20 * ({k} // {251**3} % 251)) || '.' || ({k} // {251**2} % 251) || '.' || ({k} // 251 % 251) || '.' || ({k} % 251))"


def host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search cards of hosts, one a page: an address or a name, ports and names."""
    p = pages(spark, sf_dir, "page_id", "url")
    k = F.col("page_id")
    ip = address(k)
    h = urls.host(F.col("url"))
    return p.select(
        "page_id", F.when(k % 3 == 0, F.concat(F.lit("http://"), ip, F.lit(":8080/"))).otherwise(F.col("url")).alias("url"), F.concat(F.lit("host "), ip).alias("title"),
        F.when(k % 4 == 0, ip).alias("ip"), F.when(k % 2 == 0, F.array((k % 3 * 100).cast("int"), F.lit(22))).alias("ports"),
        F.when(k % 5 < 3, F.array(F.concat(F.lit("a."), h), ip, F.lit(" "))).alias("hostnames"), F.when(k % 6 == 0, F.lit(" Org ")).alias("org"),
    )


HOST_PAGES = rf"""
hp0 as (select page_id as k, url, {address_sql("page_id")} as ip, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as h from pages),
hp as (select k as page_id, h, case when k % 3 = 0 then 'http://' || ip || ':8080/' else url end as url, 'host ' || ip as title, case when k % 4 = 0 then ip end as ip, ip as any_ip,
       case when k % 2 = 0 then [(k % 3 * 100)::int, 22] end as ports, case when k % 5 < 3 then ['a.' || h, ip, ' '] end as hostnames, case when k % 6 = 0 then ' Org ' end as org from hp0)"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host scan with a row for each page: two of three have the address of host_pages, the others one of their own."""
    k = F.col("page_id")
    p = pages(spark, sf_dir, "page_id")
    ip = F.when(k % 3 == 1, address(k, 11)).otherwise(address(k))
    cpe = F.when(k % 2 == 0, F.concat(F.lit("cpe:2.3:a:nginx:nginx:1."), (k % 20).cast("string"), F.lit(":*:*:*:*:*:*:*"))).otherwise("cpe:/a:openbsd:openssh:-")
    return p.select(
        ip.alias("ip"), F.array(F.lit(22), (k % 9 + 80).cast("int")).alias("ports"), F.array(F.lit("scan.example"), ip).alias("hostnames"),
        F.array(F.lit("junk"), cpe).alias("cpes"), F.array(F.lit("cloud")).alias("tags"),
        F.when(k % 4 == 0, F.array(F.lit("CVE-1"), F.lit("CVE-2"))).otherwise(F.array().cast("array<string>")).alias("vulns"),
    )


SCAN = f"""
sc0 as (select page_id, case when page_id % 3 = 1 then {address_sql("page_id", 11)} else {address_sql("page_id")} end as ip from pages),
sc as (select ip, [22, (page_id % 9 + 80)::int] as ports, ['scan.example', ip] as hostnames,
       case when page_id % 2 = 0 then 'nginx' else 'openbsd' end as vendor, case when page_id % 2 = 0 then 'nginx' else 'openssh' end as product,
       case when page_id % 2 = 0 then '1.' || (page_id % 20) end as version, case when page_id % 4 = 0 then ['CVE-1', 'CVE-2'] else []::varchar[] end as vulns from sc0)"""

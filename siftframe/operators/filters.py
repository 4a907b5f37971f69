"""Filters and page labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hosts, text, urls
from ..functions.text import any_of
from ..sources.readers import broadcast_if_small
from .joins import host_categories
from .windows import ORDER, first_wins, with_ranks

# Urls of block pages.
BLOCK_URL = r"(?i)/sorry/|showcaptcha|/(?:captcha|recaptcha|challenge|sorry)/|/consent\?"
# Phrases that tell a block page wherever they stand in its text.
STRONG = [
    "unusual traffic", "automated queries", "access denied", "you do not have permission", "403 - forbidden", "prove you are human",
    "verify you are human", "request has been blocked", "went wrong during verification", "cannot process your search", "blocked your request",
    "verifying you're not a bot", "drag the slider", "not yet available in your country", "temporarily unavailable", "http 403",
    "service unavailable", "service indisponible", "verification required", "i'm not a robot", "protected by altcha", "waiting for verification",
    "verifying your request", "something went wrong during verification",
]
# Words that tell one only where a page has no results.
MEDIUM = ["captcha", "challenge", "robot", "anomaly", "verification", "blocked", "consent", "before you continue", "email us", "persists", "forbidden", "enablejs"]
# Further phrases, titles and marks of pages that were fetched without a browser; google has its own.
PLAIN_STRONG = ["are you not a robot", "вы не робот", "just a moment", "wait a moment", "aggressive bot activity", "barraged by queries from bots"]
PLAIN_TITLE = r"(?i)^(?:captcha|are you not a robot|вы не робот|service unavailable)\??$"
PLAIN_MARK = r"(?i)altcha\.js|data-altcha|smartcaptcha|showcaptcha|\banomaly"
# Those of strong phrases that also count anywhere in the source of a plain page, and google's own.
RAW_STRONG = ["unusual traffic", "prove you are human", "verify you are human", "protected by altcha", "verification required", "service unavailable"]
GOOGLE_RAW = ["unusual traffic", "our systems have detected", "to continue, please type the characters"]
# The consent wall of google, and what a plain page of it has at least of a result page.
CONSENT = r"(?i)consent\.google\.com|before you continue to google"
GOOGLE_SERP = r"(?is)<h3.*<h3|/url\?q=|<cite"
# Marks of challenge scripts of google; the box of a captcha; what a login wall says.
GOOGLE_MARK = r"(?i)/sorry/|/recaptcha/|id=\"captcha\"|g-recaptcha|/httpservice/retry/enablejs"
GOOGLE_TITLE = r"(?i)^enable javascript to use search$"
CAPTCHA_BOX = r"(?i)id=\"captcha\""
LOGIN = ["please log in", "log in to search", "create a free account"]
# What a result looks like in the pages of an engine, and in those of any other.
RESULT_MARK = r"(?i)<h3|/url\?q=|<cite"
RESULT_MARKS = {
    "google": r"(?i)<h3", "google_lite": r"(?i)<h3", "chrome": r"(?i)<h3",
    "bing": r"(?i)<li\b[^>]*class=\"[^\"]*\bb_algo\b",
    "brave": r"(?i)class=\"[^\"]*\b(?:snippet|result-wrapper)\b[^\"]*\"[\s\S]*?<a\b[^>]*href=\"http",
    "mojeek": r"(?i)<ul\b[^>]*class=\"[^\"]*\bresults-standard\b[\s\S]*?<a\b",
    "startpage": r"(?i)(?:class=\"[^\"]*\b(?:w-gl__result|result)\b|data-testid=\"result\")[\s\S]*?<a\b[^>]*href=\"http",
    "yahoo": r"(?i)class=\"[^\"]*(?:\balgo\b|\balgo-sr\b)",
    "duckduckgo": r"(?i)id=\"links\"[\s\S]*?class=\"[^\"]*\bresult\b",
    "duckduckgo_lite": r"(?i)<a\b[^>]*class=\"[^\"]*\bresult-link\b",
    "qwant": r"(?i)(?:data-testid=\"[^\"]*web-result|<article\b)[\s\S]*?<a\b[^>]*href=\"http",
    "ecosia": r"(?i)<a\b[^>]*class=\"[^\"]*\bresult-title\b|<article\b[^>]*class=\"[^\"]*\bresult\b[\s\S]*?<a\b[^>]*href=\"http",
    "swisscows": r"(?i)(?:class=\"[^\"]*\bweb-results\b|<article\b)[\s\S]*?<a\b[^>]*href=\"http",
    "seznam": r"(?i)(?:data-dot=\"results\"|<h3)[\s\S]*?<a\b[^>]*href=\"http",
    "yandex": r"(?i)class=\"[^\"]*\b(?:serp-item|OrganicTitle-Link|organic__url)\b",
    "shodan": r"(?i)<a\b[^>]*href=\"[^\"]*/host/|class=\"[^\"]*\b(?:result|search-result)\b",
    "marginalia": r"(?i)<(?:section|article|main)\b[\s\S]*?<a\b[^>]*href=\"http",
    "wiby": r"(?i)<a\b[^>]*href=\"http",
    "github": r"(?i)data-hovercard-type=\"repository\"|class=\"[^\"]*\bsearch-title\b|<a\b[^>]*href=\"/",
    "wikipedia": r"(?i)class=\"[^\"]*\bmw-search-results?\b|<a\b[^>]*href=\"/wiki/",
    "archive": r"(?i)<a\b[^>]*href=\"[^\"]*/details/|class=\"[^\"]*\bitem-ia\b",
}
GOOGLES, JSON_ENGINES = ("google", "google_lite", "chrome"), ("archive", "wikipedia")
# Titles of generated answers.
AI_TITLES = ("ai mode", "ai overview", "ai overviews", "try ai mode", "search labs", "show more", "show all", "show more ai overview", "ask follow up", "ask a follow up")
AI_PREFIX = r"(?i)^(?:ai\s+(?:mode|overview)\b|try\s+ai\s+mode\b)"


def title_of(html: Column) -> Column:
    return text.collapse(F.regexp_extract(text.text(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    """The words of a page: without scripts, styles, head and tags, white space collapsed."""
    return text.strip_tags(F.regexp_replace(text.text(html), r"(?is)<(script|style|head)\b[^>]*>.*?</\1>", " "))


def mark_table(df: DataFrame, marks: dict[str, str] = RESULT_MARKS) -> DataFrame:
    """The marks as a table (engine, mark), which a caller may extend or replace; it has a row an engine."""
    return df.sparkSession.createDataFrame(list(marks.items()), "engine string, mark string")


def classify_pages(pages: DataFrame, marks: dict[str, str] | DataFrame = RESULT_MARKS) -> DataFrame:
    """pages with label (ok or blocked) and reason (null for ok).

    A page is judged by the url, by a title that is only "captcha", by strong phrases in its text or title and, for a
    host search, by a login wall. Where it has no result, weaker words count too, and having neither title nor 300
    characters of text. What a result looks like is the engine's mark (`marks`: a dictionary, or a table as mark_table
    gives it, which is broadcast after a check of its size); engines without one, and pages without the column
    `engine`, are judged by headings and displayed links.

    Pages with an engine that were fetched plainly (all but those whose column `source`, if there is one, is render) are
    also judged by their source: titles, scripts and phrases of challenges wherever they stand, and for google a consent
    wall, or nothing at all that a result page has. Payloads of engines that answer in JSON are never blocked. Null
    pages count as empty."""
    html, url = text.text(F.col("html")), text.text(F.col("url"))
    known = "engine" in pages.columns
    engine = F.lower(text.text(F.col("engine"))) if known else F.lit("")
    plain = (engine != "") & (F.coalesce(F.col("source"), F.lit("lite")) != "render") if "source" in pages.columns else engine != ""
    google, lite_google = engine.isin(*GOOGLES), plain & engine.isin("google", "google_lite")
    rows = pages
    bare = ~html.rlike(RESULT_MARK)
    if known and isinstance(marks, dict):
        rows = rows.withColumn("_mark", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in marks.items() for x in pair]), engine), F.lit(RESULT_MARK)))
    elif known:
        table = broadcast_if_small(marks.select(F.lower("engine").alias("_engine"), F.col("mark").alias("_mark")))
        rows = rows.join(table, engine == F.col("_engine"), "left").withColumn("_mark", F.coalesce("_mark", F.lit(RESULT_MARK))).drop("_engine")
    if known:
        bare = ~F.expr("rlike(coalesce(html, ''), _mark)")
    page = text.computed(rows.withColumn("_title", title_of(F.col("html"))), "_text", F.lower(visible_text(F.col("html"))))
    low, title = F.col("_text"), F.col("_title")
    found = lambda words, where: F.regexp_extract(where, f"({any_of(words)})", 1)
    # What the title says is looked at as well as the text; of a plain page, the whole source.
    raw = F.lower(html)
    own = F.when(plain & ~google, found([*PLAIN_STRONG, *RAW_STRONG], raw)).when(plain, found(GOOGLE_RAW, raw)).otherwise("")
    strong = let_first(found(STRONG, F.concat_ws(" ", low, F.lower(title))), own)
    weak = let_first(found(MEDIUM, low), F.when(low.contains("altcha"), "altcha").otherwise(""))
    wall = (engine == "shodan") & (url.rlike("(?i)/login") | (found(LOGIN, low) != ""))
    page = text.computed(page, "_found", F.struct(strong.alias("strong"), F.when(bare, weak).otherwise("").alias("medium"), bare.alias("bare"), wall.alias("wall")))
    pick = {"strong": F.col("_found.strong"), "medium": F.col("_found.medium")}
    script = F.when(plain & google, html.rlike(GOOGLE_MARK)).when(plain, html.rlike(PLAIN_MARK) | ((engine == "duckduckgo") & html.rlike(CAPTCHA_BOX))).otherwise(False)
    titled = F.when(plain & google, title.rlike(GOOGLE_TITLE)).when(plain, title.rlike(PLAIN_TITLE)).otherwise(False)
    reason = (
        F.when(url.rlike(BLOCK_URL), "url")
        .when(F.col("_found.wall"), "login")
        .when(title.rlike(r"(?i)^captcha$"), "captcha title")
        .when(titled, "challenge title")
        .when(pick["strong"] != "", F.concat(F.lit("strong: "), pick["strong"]))
        .when(script, "challenge script")
        .when(pick["medium"] != "", F.concat(F.lit("medium: "), pick["medium"]))
        .when(lite_google & ~html.rlike("(?i)<h3") & html.rlike(CONSENT), "consent")
        .when(lite_google & ~html.rlike(GOOGLE_SERP), "no result mark")
        .when(F.col("_found.bare") & (title == "") & (F.length(low) < 300), "empty")
    )
    payload = engine.isin(*JSON_ENGINES) & html.rlike(r"^\s*[\[{]")
    page = page.withColumn("reason", F.when(~payload, reason)).select(*pages.columns, "reason")
    return page.withColumn("label", F.when(F.col("reason").isNull(), "ok").otherwise("blocked"))


def let_first(a: Column, b: Column) -> Column:
    """The first of two strings that is not empty."""
    return text.let(a, lambda x: F.when(x != "", x).otherwise(b))


def looks_like_results(pages: DataFrame, status: str | None = None) -> DataFrame:
    """pages with has_results (two headings, or a wrapper link, or a cite) and soft_empty (no heading and under 80
    characters, or status 429 or 403)."""
    html = text.text(F.col("html"))
    n = lambda p: F.regexp_count(html, F.lit(p))
    soft = (n("(?i)<h3") == 0) & (F.length(html) < 80)
    if status:
        soft = soft | F.coalesce(F.col(status).isin(429, 403), F.lit(False))
    return pages.withColumn("has_results", (n("(?i)<h3") >= 2) | (n(r"(?i)/url\?q=") >= 1) | (n("(?i)<cite") >= 1)).withColumn("soft_empty", soft)


def is_ai_title(title: Column) -> Column:
    t = F.trim(text.text(title))
    return F.lower(t).isin(*AI_TITLES) | t.rlike(AI_PREFIX)


def drop_non_organic(results: DataFrame, *, video: bool = True, ai: bool = True) -> DataFrame:
    """Without videos and without the headings of generated answers; a null url or title is neither."""
    if video:
        results = results.where(~urls.is_video(F.col("url")))
    return results.where(~is_ai_title(F.col("title"))) if ai else results


# First labels and paths of blogs and forums.
BLOG_LABEL, FORUM_LABEL = r"(?i)^(?:blog|blogs|weblog)$", r"(?i)^(?:forum|forums|board|boards|community|talk|discuss)$"
BLOG_PATH = r"(?i)(?:^|/)(?:blog|blogs|weblog)(?:/|$)"
FORUM_PATH = r"(?i)(?:showthread|viewtopic|viewforum|showpost|viewthread)\.php|(?:^|/)(?:forums?|boards?|community|discuss(?:ion)?s?|threads?|topic/|t-\d|t/\d)(?:/|$|\?)|/index\.php\?(?:topic|board)="
DEFAULTS = {"social": True, "dev": False, "ugc": False, "forum": False, "blog": False}


def filter_domains(results: DataFrame, policy: dict | None = None, *, policy_col: str | None = None, categories: DataFrame | None = None) -> DataFrame:
    """Without the results whose host belongs to a category that the policy leaves out.

    policy: {social, dev, ugc, forum, blog: bool, exclude_domains, allow_domains: lists}, the same for all rows, or in
    policy_col a struct as resolve_filter_policy makes it. Unset categories take their defaults (social only). Rows
    without a host stay; an allowed host stays whatever else it is. Categories come from a literal map of the fixed
    domain list, looked up by host suffix, or from `categories` (domain, category), a table of the caller that the
    distinct hosts are joined with; forums and blogs are also known by a label of the host or a part of the path."""
    policy = policy or {}
    rows = host_categories(results, "url", "_cats", categories)
    u = text.text(F.col("url"))
    host, lab = urls.host(u), urls.labels(u)
    full_path = F.concat(urls.path(u), F.when(urls.query(u) != "", F.concat(F.lit("?"), urls.query(u))).otherwise(""))
    cat = {c: F.array_contains("_cats", c) for c in DEFAULTS}
    cat["forum"] = cat["forum"] | F.exists(lab, lambda x: x.rlike(FORUM_LABEL)) | full_path.rlike(FORUM_PATH)
    cat["blog"] = cat["blog"] | F.exists(lab, lambda x: x.rlike(BLOG_LABEL)) | host.rlike(r"(?:^|\.)blogspot\.") | urls.path(u).rlike(BLOG_PATH)
    if policy_col:
        on = {c: F.coalesce(F.col(f"{policy_col}.{c}"), F.lit(d)) for c, d in DEFAULTS.items()}
        lists = [F.col(f"{policy_col}.{k}") for k in ("allow_domains", "exclude_domains")]
    else:
        on = {c: F.lit(d if policy.get(c) is None else policy[c]) for c, d in DEFAULTS.items()}
        lists = [F.array(*[F.lit(d) for d in policy.get(k, [])]).cast("array<string>") for k in ("allow_domains", "exclude_domains")]
    allowed, excluded = (F.exists(F.coalesce(x, F.array().cast("array<string>")), lambda t: _matches(host, t)) for x in lists)
    bad = excluded
    for c in DEFAULTS:
        bad = bad | (on[c] & cat[c])
    return rows.where((host == "") | allowed | ~bad).drop("_cats")


def _matches(host: Column, target: Column) -> Column:
    """A host is a target or below it; ".com" is a suffix rule."""
    h = F.regexp_replace(host, r"^www\.", "")
    t = F.regexp_replace(F.lower(target), r"^www\.", "")
    below = F.when(t.startswith("."), (h == F.substring(t, 2, 1 << 30)) | h.endswith(t)).otherwise((h == t) | h.endswith(F.concat(F.lit("."), t)))
    return (h != "") & (t != "") & below


def enforce_operators(results: DataFrame, queries: DataFrame, by: str = "query_id") -> DataFrame:
    """The results that obey their query's site:, filetype:/mime: and inurl:; other operators are not enforced. queries
    has `by` and the columns of parse_query_operators. A result whose query is unknown stays."""
    q = queries.select(F.col(by).alias("_q"), F.col("operators").alias("_ops"), F.col("site_targets").alias("_sites"))
    rows = results.join(q, results[by] == F.col("_q"), "left")
    u = text.text(F.col("url"))
    values = lambda k: F.coalesce(F.try_element_at("_ops", F.lit(k)), F.array().cast("array<string>"))
    sites = F.coalesce("_sites", F.array().cast("array<string>"))
    kinds = F.transform(F.concat(values("filetype"), values("mime")), lambda v: F.lower(F.regexp_replace(v, r"^\.", "")))
    file_path = F.lower(urls.path(u))
    ok_site = (F.size(sites) == 0) | F.exists(sites, lambda t: _matches(urls.host(u), t))
    ok_kind = (F.size(kinds) == 0) | F.exists(kinds, lambda k: file_path.endswith(F.concat(F.lit("."), k)))
    ok_url = F.forall(values("inurl"), lambda t: F.lower(u).contains(F.lower(t)))
    return rows.where(ok_site & ok_kind & ok_url).select(*[results[c] for c in results.columns])


# Paths and hosts of an engine's own pages.
JUNK_PATH = r"(?i)^/(?:sorry|imgres|aclk|setprefs|search)\b"
JUNK_HOST = r"(?i)(?:^|\.)(?:webcache\.googleusercontent\.com|gstatic\.com|googleadservices\.com|googleusercontent\.com)$"


def drop_junk_links(results: DataFrame, by=("query_id",), order=ORDER) -> DataFrame:
    """Result rows without the engine's own pages, caches, ads and static files, without titles that are empty, those of
    generated answers, or urls; urls unwrapped and cleaned, one row each, ranked."""
    title, raw = F.trim(text.text(F.col("title"))), text.text(F.col("url"))
    rel = raw.rlike(r"(?i)^/(?:goto|url)\?")
    wrapper = raw.rlike(r"(?i)/(?:url|goto)\?")
    own = urls.host(raw).rlike(r"(?i)(?:^|\.)google\.com$") & ~wrapper
    junk = (raw == "") | raw.rlike(JUNK_PATH) | urls.host(raw).rlike(JUNK_HOST) | urls.is_video(raw) | own
    rows = results.where((title != "") & ~is_ai_title(title) & ~title.rlike(urls.HTTP) & (rel | ~junk))
    link = F.when(rel, raw).otherwise(urls.clean(urls.unwrap(raw)))
    rows = text.computed(rows.withColumn("title", title), "url", link).where(F.col("url").rlike(urls.HTTP) | F.col("url").rlike(r"(?i)^/(?:goto|url)\?"))
    return with_ranks(first_wins(rows, "url", by, order), by, order)


def guard_links(links: DataFrame, url: str = "dst_url", origin: str | None = None) -> DataFrame:
    """Links to public hosts only; with `origin`, only those of the same scheme and host (ports are not compared)."""
    def ok(u: Column) -> Column:
        public = u.rlike(urls.HTTP) & ~hosts.is_private_host(urls.host(u))
        return public & (urls.scheme(u) == urls.scheme(F.col(origin))) & (urls.host(u) == urls.host(F.col(origin))) if origin else public

    return links.where(text.let(urls.unwrap(F.col(url)), ok))


def filter_hosts(df: DataFrame, *, min_ports: int | None = None, has_vulns: bool = False, host: str = "host") -> DataFrame:
    """Hosts with at least min_ports ports, and with a vulnerability; rows without a host go when either is asked."""
    if min_ports:
        df = df.where(F.size(F.coalesce(F.col(f"{host}.ports"), F.array().cast("array<int>"))) >= min_ports)
    return df.where(F.size(F.coalesce(F.col(f"{host}.vulns"), F.array().cast("array<string>"))) > 0) if has_vulns else df


def valid_results(results: DataFrame) -> DataFrame:
    """Results with an http url and a title that is not blank."""
    return results.where(text.text(F.col("url")).rlike(urls.HTTP) & (F.trim(text.text(F.col("title"))) != ""))


def label_ip_rows(df: DataFrame, scan: DataFrame, ip: str = "ip") -> DataFrame:
    """df with found and code: INVALID_IP, NOT_FOUND, or null for those in the scan."""
    known = scan.select(F.trim("ip").alias("_ip")).distinct().withColumn("_known", F.lit(True))
    rows = df.join(known, F.trim(F.col(ip)) == F.col("_ip"), "left")
    valid = hosts.is_ip(F.col(ip))
    rows = rows.withColumn("found", valid & F.col("_known").isNotNull())
    return rows.withColumn("code", F.when(~valid, "INVALID_IP").when(~F.col("found"), "NOT_FOUND")).drop("_ip", "_known")

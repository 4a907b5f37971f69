"""URL expressions. Parts are taken by anchored patterns, because parse_url refuses urls that browsers accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decode_entities, let, text, trim_space

# Query keys that only track. Canonical urls drop `source` as well; cleaned urls keep it.
TRACKING = "utm_[a-z0-9_]+|gclid|dclid|fbclid|yclid|msclkid|igshid|mc_cid|mc_eid|ref|ref_src|ved|usg|sa|sxsrf|ei|gs_lcp|sourceid|ie|oe"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
HTTP = r"(?i)^https?://"


def is_absolute(url: Column) -> Column:
    return url.rlike(ABSOLUTE)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ABSOLUTE, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ABSOLUTE, 2))


def path(url: Column) -> Column:
    """The path; "/" where an absolute url has none."""
    return let(F.regexp_extract(url, ABSOLUTE, 3), lambda p: F.when((p == "") & is_absolute(url), "/").otherwise(p))


def query(url: Column) -> Column:
    """Without its question mark."""
    return F.substring(F.coalesce(F.regexp_extract(url, ABSOLUTE, 4), F.lit("")), 2, 1 << 30)


def host(url: Column) -> Column:
    """Lower-case host without port, empty where the url is not absolute."""
    return F.lower(F.regexp_extract(text(url), HOST, 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def labels(url: Column) -> Column:
    """The parts of the host without www."""
    return F.filter(F.split(bare_host(url), r"\."), lambda x: x != "")


def port(url: Column) -> Column:
    p = F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d{1,5})(?:[/?#]|$)", 1)
    return F.when(p != "", p.cast("int"))


def suffixes(host_: Column) -> Column:
    """A host and every suffix of it that begins at a label, longest first: a.b.c, b.c, c."""
    parts = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def site_value(value: Column) -> Column:
    """The bare host that a site: value names; ".com" stays a suffix."""
    v = F.regexp_replace(value, r"(?i)^https?://", "")
    v = F.regexp_replace(v, r"(?i)^www\.", "")
    v = F.regexp_replace(v, r"^\*\.", ".")
    return F.lower(F.regexp_replace(v, r"/.*$", ""))


def kept_query(query_: Column, keys: str) -> Column:
    """The pairs of a query whose key is not dropped. Keys are dropped whole: one t that is a UUID, or one param of 1 to
    6 digits, takes every pair of that key with it. The bytes of the pairs that stay are not touched."""
    pairs = F.split(query_, "&")
    key = lambda x: F.regexp_extract(x, r"^([^=]*)", 1)
    t = F.exists(pairs, lambda x: x.rlike(rf"^t=(?i:{UUID})$"))
    param = F.exists(pairs, lambda x: x.rlike(r"^param=\d{1,6}$"))
    gone = lambda x: key(x).rlike(rf"^(?i:{keys})$") | ((key(x) == "t") & t) | ((key(x) == "param") & param)
    return F.array_join(F.filter(pairs, lambda x: ~gone(x)), "&")


def _joined(url: Column, path_: Column, keys: str) -> Column:
    tail = let(kept_query(query(url), keys), lambda k: F.when(k != "", F.concat(F.lit("?"), k)).otherwise(""))
    return F.concat(scheme(url), F.lit("://"), authority(url), path_, tail)


def canonical(url) -> Column:
    """One spelling of a url: no fragment, no tracking keys, no slashes at the end, scheme and host in lower case.
    What is not an absolute url stays as it is; null becomes the empty string."""

    def one(u):
        p = F.regexp_replace(path(u), r"/+$", "")
        whole = _joined(u, F.when(p == "", "/").otherwise(p), TRACKING + "|source")
        return F.when(is_absolute(u), F.regexp_replace(whole, r"/$", "")).otherwise(u)

    return let(text(url), one)


def clean(url) -> Column:
    """An http or https url without fragment and tracking keys; other schemes become empty, other text stays."""

    def one(u):
        ok = F.when(u.rlike(HTTP), _joined(u, path(u), TRACKING)).otherwise("")
        return F.when(is_absolute(u), ok).otherwise(u)

    return let(text(url), one)


def decoded(c: Column) -> Column:
    """Percent-decoded; unchanged where that fails. A plus sign stays."""
    return let(c, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def param(url: Column, name: str) -> Column:
    """The first value of a query key, form-decoded, empty if there is none."""
    return let(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), lambda raw: F.coalesce(F.try_url_decode(raw), raw))


def _https(c: Column) -> Column:
    return F.regexp_replace(c, "^//", "https://")


WRAPPER = r"^/(?:url|goto)\?|^(?i:https?)://(?:[^/?#]*\.)?(?i:google\.com)(?::\d+)?/(?i:url|goto)/?\?"
WRAPPER_HOST = r"(?i)^https?://(?:[^/?#@]*@)?(?:(?:[^/?#:]*\.)?google\.com|[^/?#:]*(?:googleusercontent\.com|gstatic\.com|googleadservices\.com))(?::\d+)?(?:[/?#]|$)"


def _unwrap_once(url: Column) -> Column:
    names = [let(param(url, k), lambda v: F.when(v != "", v)) for k in ("url", "q", "u")]
    inner = _https(decode_entities(decoded(F.coalesce(*names, F.lit("")))))
    return F.when(url.rlike(WRAPPER), let(inner, lambda v: F.when(v != "", v).otherwise(url))).otherwise(url)


def _other_wrappers(u: Column) -> Column:
    uddg, ru = param(u, "uddg"), decoded(F.regexp_extract(u, r"/RU=([^/]+)", 1))
    packed = F.translate(F.regexp_extract(u, r"[?&]u=a[13]([A-Za-z0-9_-]+)", 1), "-_", "+/")
    plain = let(packed, lambda x: F.try_to_binary(F.rpad(x, (F.ceil(F.length(x) / 4) * 4).cast("int"), "="), F.lit("base64")).cast("string"))
    web = lambda c: let(c, lambda v: F.when(v.rlike(HTTP), v))
    return F.coalesce(
        F.when(u.rlike(r"^(?i:https?://(?:[^/?#]*\.)?duckduckgo\.com)/l/?\?"), web(uddg)), web(ru),
        F.when(u.rlike(r"^(?i:https?://(?:[^/?#]*\.)?bing\.com)/ck/"), web(plain)), u,
    )


def unwrap(href, hops: int = 4) -> Column:
    """The target of a result link: up to `hops` redirect wrappers (/url?q=, /goto?url=), then a uddg= wrapper, a /RU=.../
    segment, or a u=a1<base64url> wrapper. Links that are no wrapper stay."""
    u = _https(decode_entities(trim_space(text(href))))
    u = F.aggregate(F.sequence(F.lit(1), F.lit(hops)), u, lambda at, _: _unwrap_once(at))
    return let(u, _other_wrappers)


def target(href) -> Column:
    """The cleaned target of a result link; empty where it is no http url or still belongs to the wrapper's own hosts."""
    return let(decoded(unwrap(href)), lambda u: F.when(~u.rlike(HTTP) | u.rlike(WRAPPER_HOST), "").otherwise(clean(u)))


# Hosts and paths of videos.
VIDEO_HOST = r"(?i)(?:^|\.)(?:youtube\.com|youtu\.be|ytimg\.com|googlevideo\.com|ggpht\.com|youtube-nocookie\.com|fb\.watch)$"
VIDEO_PATH = r"(?i)(?:(?:^|\.)(?:facebook\.com|fb\.watch)/.*/(?:videos?|watch)\b|(?:^|\.)(?:instagram\.com|instagr\.am)/(?:reel|reels|tv|p)/)"


def is_video(url: Column) -> Column:
    return host(url).rlike(VIDEO_HOST) | F.concat(host(url), path(text(url))).rlike(VIDEO_PATH)


def best_link(candidates: Column) -> Column:
    """Of an array of strings, each of several links between white space: the longest cleaned target that is neither
    wrapper nor video, the first of equals, empty if there is none."""
    parts = F.flatten(F.transform(F.filter(candidates, lambda x: x.isNotNull()), lambda x: F.split(trim_space(x), r"\s+")))
    links = F.filter(F.transform(parts, target), lambda x: (x != "") & ~is_video(x))
    best = F.aggregate(links, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.coalesce(best, F.lit(""))


def _crumbs(c: Column, parts: Column) -> Column:
    first = F.coalesce(F.get(parts, 0), F.lit(""))
    host_ = F.split_part(F.regexp_replace(first, HTTP, ""), F.lit("/"), F.lit(1))
    rest = F.filter(F.transform(F.slice(parts, 2, 100_000), lambda x: F.regexp_replace(x, "^/+", "")), lambda x: x != "")
    tail = F.when(c.rlike(r"\.{3}|…"), "").otherwise(F.array_join(rest, "/"))

    def built(h):
        bare = F.lower(F.regexp_replace(h, r"(?i)^www\.", ""))
        real = bare.rlike(r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$") & (F.length(bare) < 80)
        return F.when(real, clean(F.concat(F.lit("https://"), h, F.lit("/"), tail))).otherwise("")

    direct = let(target(c), lambda t: F.when(t != "", t).otherwise(clean(c)))
    whole = let(F.when(c.rlike(HTTP) & (F.size(parts) == 1), direct), lambda d: F.when((d != "") & ~d.rlike(WRAPPER_HOST), d))
    return F.coalesce(whole, let(host_, built))


def from_breadcrumb(cite: Column) -> Column:
    """The url that a displayed path names: "host › a › b" is https://host/a/b. Shortened ones keep the host only; the
    host must look like one and be under 80 characters, else the result is empty."""
    parts = lambda c: F.filter(F.transform(F.split(c, "[›>]"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "...") & (x != "…"))
    return let(cite, lambda c: let(parts(c), lambda p: _crumbs(c, p)))


def index_of(url: Column, title: Column) -> Column:
    """Where the title is "Index of /path", the url with that path and neither query nor fragment."""
    p = F.regexp_replace(F.regexp_extract(text(title), r"(?i)^index\s+of\s+(/[A-Za-z0-9_.~+/-]*)", 1), r"/{2,}", "/")
    tidy = let(p, lambda x: F.when(F.length(x) > 1, F.regexp_replace(x, r"/+$", "")).otherwise(x))
    return let(url, lambda u: let(tidy, lambda x: F.when((x != "") & u.rlike(HTTP), F.concat(scheme(u), F.lit("://"), authority(u), x)).otherwise(u)))


def without_dots(path_: Column) -> Column:
    """An absolute path without dot segments: "." goes, ".." takes the segment before it along; the last of either
    leaves a slash at the end."""

    def step(done, x):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == ".", done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    def fold(p):
        parts = F.slice(F.split(p, "/"), 2, 1 << 20)
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        tail = F.when(p.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(p.rlike(r"/\.{1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))).otherwise(p)

    return let(path_, fold)


def resolve(href: Column, base: Column) -> Column:
    """An absolute http url without its fragment and dot segments, from a link and the page it is on; null for other
    schemes. Handles absolute links, //host, /path, ?query and relative paths."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    mark = lambda q: let(q, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise(""))

    def full(h):
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
            .when(h.startswith("/"), F.concat(root, h))
            .when(h == "", F.concat(root, path(base), mark(query(base))))
            .when(h.startswith("?"), F.concat(root, path(base), h))
            .otherwise(F.concat(root, folder, h))
        )

    def tidy(f):
        return F.when(f.rlike(HTTP) & is_absolute(f) & is_absolute(base), F.concat(scheme(f), F.lit("://"), authority(f), without_dots(path(f)), mark(query(f))))

    return let(let(F.regexp_replace(trim_space(text(href)), r"#.*$", ""), full), tidy)

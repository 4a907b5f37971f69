"""Expressions over IP addresses, CPE names and host records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import let, text, trim_space

IP = r"^\d{1,3}(?:\.\d{1,3}){3}$"
# Private ranges, by their first two numbers and the bits that count.
PRIVATE = ((0, 0, 8), (10, 0, 8), (127, 0, 8), (169, 254, 16), (192, 168, 16), (172, 16, 12), (100, 64, 10))
IP_IN_TEXT = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"


def is_ip(c: Column) -> Column:
    return trim_space(text(c)).rlike(IP)


def ip_in(c: Column) -> Column:
    """The first dotted quad in a text, or null."""
    found = F.regexp_extract(text(c), IP_IN_TEXT, 1)
    return F.when(found != "", found)


def ip_number(c: Column) -> Column:
    """A dotted quad as one number, null for anything else; parts over 255 are not refused."""
    parts = F.split(text(c), r"\.")
    part = lambda k: F.element_at(parts, k).cast("long")
    return F.when(text(c).rlike(IP), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def _known(c: Column) -> Column:
    v = F.trim(F.coalesce(c, F.lit("")))
    return F.when(~v.isin("", "*", "-"), v)


def cpe(c: Column) -> Column:
    """struct(vendor, product, version) of a CPE 2.3 name or an old cpe:/ one; null for other text. Fields that are
    missing, blank, * or - are null."""
    raw = trim_space(text(c))
    new, old = F.split(raw, ":"), F.split(F.substring(raw, 6, 1 << 30), ":")
    of = lambda parts, first: F.struct(*[_known(F.get(parts, first + k)).alias(n) for k, n in enumerate(("vendor", "product", "version"))])
    return F.when(raw.startswith("cpe:2.3:"), of(new, 3)).when(raw.startswith("cpe:/"), of(old, 1))


#: A host that a browser reads as an IPv4 address: its last part is a number.
NUMERIC_HOST = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$"


def _address(h: Column) -> Column:
    """The address of a numeric host as browsers read it (hexadecimal and octal parts; the last part fills what is left),
    as one number; null if it is none."""
    octal = lambda x: F.when(x == "0x", F.lit("0")).when(x.startswith("0x"), F.conv(F.substring(x, 3, 99), 16, 10)).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(x.rlike("^(?:0|[1-9][0-9]*)$"), x)
    parts = F.transform(F.split(h, r"\."), lambda x: octal(x).try_cast("long"))

    def number(p):
        n = F.size(p)
        fits = (n <= 4) & F.forall(p, lambda x: x.isNotNull()) & F.forall(F.slice(p, 1, n - 1), lambda x: x < 256) & (F.element_at(p, -1) < F.pow(F.lit(256), 5 - n))
        placed = F.transform(p, lambda x, k: F.when(k < n - 1, x * F.pow(F.lit(256), 3 - k).cast("long")).otherwise(x))
        return F.when(fits, F.aggregate(placed, F.lit(0).cast("long"), lambda x, y: x + y))

    return let(parts, number)


def is_private_host(h: Column) -> Column:
    """Loopback, private, link-local and shared address ranges, metadata services and local names; empty counts too, and
    so does a host that ends with a number and is no address, which no browser would ask for."""
    def private(h):
        named = h.isin("", "localhost", "localhost.localdomain", "metadata.google.internal", "metadata.google", "::1", "[::1]")
        local = h.endswith(".local") | h.endswith(".internal") | h.endswith(".localhost")
        inside = lambda n, first, bits: F.shiftright(n, 32 - bits) == first >> 32 - bits
        ranges = lambda n: F.coalesce(F.reduce(F.array(*[inside(n, (a << 24) + (b << 16), bits) for a, b, bits in PRIVATE]), F.lit(False), lambda x, y: x | y), F.lit(True))
        return named | local | F.when(h.rlike(NUMERIC_HOST), let(_address(h), ranges)).otherwise(False)

    return let(F.regexp_replace(F.lower(text(h)), r"\.$", ""), private)


def host_record(url: Column, title: Column, ip: Column, ports: Column, hostnames: Column, org: Column) -> Column:
    """A host struct: the port of the url, else the first port, else that of the scheme; the address of the field, the
    host, the url or the title; names without addresses, the url's host first. What cannot be known is null."""
    raw = F.when(text(url).rlike(urls.HTTP), text(url)).otherwise(F.concat(F.lit("http://"), text(url)))
    h = urls.host(raw)
    h = F.when(h != "", h)
    valid = F.filter(F.coalesce(ports, F.array().cast("array<int>")), lambda p: p > 0)
    by_scheme = F.when(h.isNull(), F.lit(None).cast("int")).when(urls.scheme(raw) == "https", 443).when(urls.scheme(raw) == "http", 80)
    names = F.filter(F.transform(F.coalesce(hostnames, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: (x != "") & ~is_ip(x))
    own = h.isNotNull() & ~is_ip(h) & ~F.array_contains(names, F.coalesce(h, F.lit("")))
    names = F.when(own, F.concat(F.array(h), names)).otherwise(names)
    address = F.coalesce(F.when(is_ip(ip), F.trim(ip)), F.when(is_ip(h), h), ip_in(url), ip_in(title))
    none = lambda kind: F.lit(None).cast(kind)
    empty = F.array().cast("array<string>")
    return F.struct(
        address.alias("ip_str"), F.coalesce(urls.port(raw), F.try_element_at(valid, F.lit(1)), by_scheme).alias("port"), F.lit("tcp").alias("transport"),
        none("string").alias("product"), none("string").alias("version"), none("string").alias("vendor"),
        names.alias("hostnames"), names.alias("domains"), F.trim(org).alias("org"), F.trim(org).alias("isp"),
        F.array().cast("array<int>").alias("ports"), empty.alias("cpes"), empty.alias("tags"), empty.alias("vulns"),
    )

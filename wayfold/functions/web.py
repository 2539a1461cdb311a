"""Hosts, domains and admission rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions.text import col_of


def host_of(url) -> Column:
    """Host in lower case, empty when the URL has none."""
    return F.coalesce(F.lower(F.try_parse_url(col_of(url), F.lit("HOST"))), F.lit(""))


def registrable_domain(host) -> Column:
    """eTLD+1 with the two-part public suffixes in the fixed list."""
    h = F.regexp_replace(F.lower(F.coalesce(col_of(host), F.lit(""))), r"^\.+|\.+$", "")
    two_part = "|".join(suffix.replace(".", r"\.") for suffix in rules.TWO_PART_SUFFIXES)
    found = F.regexp_extract(h, rf"([^.]+\.(?:{two_part})|[^.]+\.[^.]+)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), h)


def is_platform(domain) -> Column:
    return registrable_domain(domain).isin(rules.PLATFORM_DOMAINS)


def same_domain(email, page_domain) -> Column:
    """Address and page share a registrable domain; false when either is missing."""
    value = F.coalesce(col_of(email), F.lit(""))
    at = F.instr(value, "@")
    domain = F.lower(F.substring(value, at + 1, F.length(value)))
    page = F.coalesce(col_of(page_domain), F.lit(""))
    return (at > 0) & (page != "") & (registrable_domain(domain) == registrable_domain(page))


def _octets(host: Column) -> Column:
    return F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))


def _private_ipv4(octets: Column) -> Column:
    a, b, c = octets[0], octets[1], octets[2]
    return ((a == 0) | (a == 10) | (a == 127) | ((a == 169) & (b == 254))
            | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
            | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19))
            | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
            | (a >= 224))


def block_reason(url) -> Column:
    """Why a URL may not be fetched, or null.  Name resolution is not done."""
    u = col_of(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    bracket = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    host = F.lower(F.when(bracket != "", bracket).otherwise(
        F.regexp_replace(F.regexp_replace(host_port, r":\d*$", ""), r"\.+$", "")))
    port_text = F.regexp_extract(host_port, r":(\d+)$", 1)
    port = F.when((bracket != "") & ~host_port.rlike(r"\]:\d+$"), F.lit(None).cast("int")) \
        .otherwise(port_text.try_cast("int"))
    port = F.coalesce(port, F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80)))
    path = F.lower(F.regexp_replace(
        F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", ""))
    parts = F.struct(F.coalesce(scheme, F.lit("")).alias("scheme"), host.alias("host"), (bracket != "").alias("six"),
                     port.alias("port"), path.alias("path"))
    return F.transform(F.array(parts), _judge)[0]


def _ending(values) -> str:
    return "(" + "|".join(v.replace(".", r"\.") for v in values) + ")$"


def _judge(p: Column) -> Column:
    """First admission rule that refuses the parts of a URL."""
    host = p["host"]
    ipv4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    octets = _octets(host)
    private4 = ipv4 & ~F.exists(octets, lambda x: x > 255) & _private_ipv4(octets)
    private6 = p["six"] & host.rlike(
        r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89a-f][0-9a-f]:|ff[0-9a-f]{2}:|2001:db8:|::ffff:)")
    return (F.when(~p["scheme"].isin(rules.ALLOWED_SCHEMES), "BLOCKED_SCHEME")
            .when((host == "") | host.isin(rules.BLOCKED_HOSTNAMES) | host.rlike(_ending(rules.BLOCKED_HOST_SUFFIXES)), "BLOCKED_HOSTNAME")
            .when(host.isin(rules.METADATA_ADDRESSES), "BLOCKED_METADATA_ENDPOINT")
            .when(private4 | private6, "BLOCKED_PRIVATE_IP")
            .when(~p["port"].isin(rules.ALLOWED_PORTS), "BLOCKED_PORT")
            .when(p["path"].rlike(_ending(rules.BLOCKED_EXTENSIONS)), "BLOCKED_FILE_TYPE"))


def response_block_reason(mime, byte_count, limit: int = rules.FETCH_MAX_BYTES) -> Column:
    """Why a response is refused: content type first, then size.  A missing type passes."""
    base = F.lower(F.trim(F.substring_index(col_of(mime), ";", 1)))
    allowed = reduce(lambda x, y: x | y, [base.startswith(p) for p in rules.ALLOWED_MIME_PREFIXES])
    return (F.when((F.length(base) > 0) & ~allowed, "DISALLOWED_MIME_TYPE")
            .when(col_of(byte_count) > limit, "RESPONSE_TOO_LARGE"))

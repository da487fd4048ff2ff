"""URL columns: parts, canonical form, safety and domain tests.

Parts are taken by pattern and not by a strict URI parser, so that an odd character in a
path does not turn a usable link into null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow.functions.text import _col, clean

# Query keys that only track visits, host suffixes that are not public.
TRACKING_KEYS = ("gclid", "fbclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"
PRIVATE_SUFFIXES = (".localhost", ".local", ".internal")
RESERVED_SUFFIXES = (".localhost", ".local", ".internal", ".test", ".invalid")

# IPv4 addresses that are not globally reachable (0/8, 10/8, 100.64/10, 127/8, 169.254/16,
# 172.16/12, 192.0.0/24 but .9 and .10, 192.0.2/24, 192.168/16, 198.18/15, 198.51.100/24, 203.0.113/24, 240/4).
PRIVATE_IPV4 = (r"^(?:(?:0|10|127)\.\d+\.\d+\.\d+|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d+\.\d+|169\.254\.\d+\.\d+"
                r"|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|192\.0\.0\.(?!(?:9|10)$)\d+|192\.0\.2\.\d+|192\.168\.\d+\.\d+"
                r"|198\.1[89]\.\d+\.\d+|198\.51\.100\.\d+|203\.0\.113\.\d+|(?:24\d|25[0-5])\.\d+\.\d+\.\d+)$")

# One http(s) address: no user or password, a host, and no port but 80 or 443.
SAFE = r"(?is)^https?://(?::?@)?(?:\[[^\]]*\]|[^/?#@:\[\]]+)(?::(?:0*(?:80|443))?)?(?:[/?#].*)?$"

# The usual public address, told by one pattern: a lower-case dotted host that ends in a public name, and printable characters behind it.
USUAL_PUBLIC = r"^https?://(?:[a-z0-9-]+\.)+(?!(?:localhost|local|internal)(?:[/?#]|\z))[a-z]{2,63}(?:[/?#][!-\[\]-~]*)?\z"

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, index)


def scheme(url) -> Column:
    return F.lower(_part(_col(url), 1))


def authority(url) -> Column:
    return _part(_col(url), 2)


def path(url) -> Column:
    return _part(_col(url), 3)


def query(url) -> Column:
    return _part(_col(url), 4)


def userinfo(url) -> Column:
    return F.regexp_extract(authority(url), "^(.*)@", 1)


def _host_port(url) -> Column:
    return F.regexp_replace(authority(url), "^.*@", "")


def host(url) -> Column:
    bracketed = F.regexp_extract(_host_port(url), r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(bracketed != "", bracketed).otherwise(F.regexp_extract(_host_port(url), r"^([^:\[]*)", 1)))


def port(url) -> Column:
    """Port text, empty when none is given."""
    return F.regexp_extract(_host_port(url), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)


def is_safe_url(url) -> Column:
    """An http(s) address with a host, no credentials and a normal port."""
    return clean(url).rlike(SAFE)


def _canonical_query(text: Column) -> Column:
    def decode(piece):
        plus = F.replace(piece, F.lit("+"), F.lit(" "))
        return F.coalesce(F.try_url_decode(piece), plus)

    def encode(piece):
        return F.replace(F.replace(F.url_encode(piece), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    pairs = F.transform(
        F.filter(F.split(text, "&"), lambda p: p != ""),
        lambda p: F.struct(decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"),
                           decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX))
                    & ~F.lower(p["k"]).isin(*TRACKING_KEYS))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")


def canonical_url(url) -> Column:
    """Lower-case scheme and host, root path for none, sorted query without tracking keys, no
    fragment; null when the address is not safe."""
    value = clean(url)
    params = F.when(query(value) == "", F.lit("")).otherwise(_canonical_query(query(value)))
    way = path(value)
    joined = F.concat(scheme(value), F.lit("://"), F.lower(authority(value)), F.when(way == "", "/").otherwise(way),
                      F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)))
    return F.when(is_safe_url(url), joined)


def lead_id(canonical) -> Column:
    return F.substring(F.sha2(_col(canonical), 256), 1, 20)


def is_public_url(url) -> Column:
    """A safe address that also looks public: a dotted, non-local host and no private literal IP."""
    value = F.coalesce(_col(url), F.lit(""))
    return F.when(value.rlike(USUAL_PUBLIC), True).otherwise(_is_public(value))


def _is_public(value: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(F.lower(value), r"^https?://(?::?@)?([^/?#@:\[\]]+)", 1), r"\.+$", "")
    local = "|".join(suffix.replace(".", r"\.") for suffix in PRIVATE_SUFFIXES)
    return (value.rlike(SAFE) & ~value.rlike(r"[\x00-\x20\x7f\\]") & F.contains(name, F.lit("."))
            & ~name.rlike(f"(?:{local})$|{PRIVATE_IPV4}"))


def _in_domains(name: Column, domains: Column) -> Column:
    return F.exists(domains, lambda d: (name == F.lower(d)) | F.endswith(name, F.concat(F.lit("."), F.lower(d))))


def domain_allowed(url, domains) -> Column:
    """The host is one of the domains or lies under one."""
    return F.coalesce(_in_domains(host(F.coalesce(_col(url), F.lit(""))), _col(domains)), F.lit(False))


def valid_domain(value) -> Column:
    """Public DNS name: labels of at most 63, alphabetic top label, no reserved suffix."""
    name = normal_domain(value)
    labels = F.split(name, r"\.")
    reserved = F.lit(False)
    for suffix in RESERVED_SUFFIXES:
        reserved = reserved | F.endswith(name, F.lit(suffix))
    return ((F.char_length(name) <= 253) & name.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")
            & F.forall(labels, lambda p: ~F.startswith(p, F.lit("-")) & ~F.endswith(p, F.lit("-")) & (F.char_length(p) <= 63))
            & F.element_at(labels, -1).rlike("^[a-z]{2,63}$") & ~reserved)


def normal_domain(value) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(_col(value), F.lit("")))), r"\.+$", "")


def allowed_url(url, domains) -> Column:
    """The address with a lower-case host and no fragment when it lies in the domains, else empty."""
    value = F.coalesce(_col(url), F.lit(""))
    name = normal_domain(host(value))
    standard = F.when(scheme(value) == "https", "443").otherwise("80")
    ok = ((F.char_length(value) <= 4096) & ~value.rlike(r"[\x00-\x20\\]") & scheme(value).isin("http", "https")
          & ~F.contains(authority(value), F.lit("@")) & valid_domain(host(value))
          & ((port(value) == "") | (F.regexp_replace(port(value), "^0+", "") == standard))
          & _in_domains(name, _col(domains)))
    way = path(value)
    out = F.concat(scheme(value), F.lit("://"), name, F.when(way == "", "/").otherwise(way),
                   F.when(query(value) == "", "").otherwise(F.concat(F.lit("?"), query(value))))
    return F.when(F.coalesce(ok, F.lit(False)), out).otherwise("")


def _without_dots(way: Column) -> Column:
    """Drop '.' segments and let '..' remove the segment before it."""
    folded = F.aggregate(
        F.split(way, "/"), F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .when(part == ".", done).otherwise(F.concat(done, F.array(part))))
    tail = F.when(way.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    joined = F.concat(F.array_join(folded, "/"), tail)
    return F.when(way.rlike(r"(^|/)\.\.?(/|$)"), joined).otherwise(way)


def resolve(base, link) -> Column:
    """Absolute form of a link found on a page."""
    page, target = _col(base), F.trim(_col(link))
    root = F.concat(scheme(page), F.lit("://"), authority(page))
    folder = F.regexp_replace(path(page), "[^/]*$", "")
    target_path = F.regexp_extract(target, "(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    full_path = F.when(F.startswith(target, F.lit("/")), target_path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), target_path))
    return (F.when(target == "", page)
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
            .when(F.startswith(target, F.lit("//")), F.concat(scheme(page), F.lit(":"), target))
            .when(F.startswith(target, F.lit("#")), F.concat(F.regexp_replace(page, "(?s)#.*$", ""), target))
            .when(F.startswith(target, F.lit("?")), F.concat(root, path(page), target))
            .otherwise(F.concat(root, _without_dots(full_path), rest)))

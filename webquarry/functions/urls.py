"""URL functions as column expressions. `parse_url` is not used: it refuses URLs that browsers and crawlers accept."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
IPV6 = r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^(?=.*::)(?!.*::.*::)[0-9A-Fa-f:]+$"
#: Rules of public suffixes, where no list is given; `public_suffixes` reads a whole list.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk",
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn", "com.hk", "com.tw", "org.tw", "edu.tw", "gov.tw",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.nz", "org.nz", "com.br", "com.mx", "com.ar", "com.tr", "com.sg", "com.my", "co.in", "co.id", "co.th", "co.za", "com.ua", "co.il",
)


def text(url) -> Column:
    return F.coalesce(url.cast("string"), F.lit(""))


def part(url, k: int) -> Column:
    return F.regexp_extract(text(url), URL, k)


def valid(url) -> Column:
    """Whether a parser takes it: no control signs, no broken escapes, no space in the host."""
    return ~text(url).rlike(r"[\x00-\x1f\x7f]") & ~part(url, 3).rlike(r"%(?![0-9A-Fa-f]{2})") & ~part(url, 2).rlike(r"[ <>\"\\^`{|}]") & ~text(url).startswith(":")


def scheme(url) -> Column:
    return F.lower(part(url, 1))


def netloc(url) -> Column:
    """Host and port, without user information."""
    return F.regexp_replace(part(url, 2), r"^.*@", "")


def hostname(url) -> Column:
    return F.regexp_replace(F.regexp_replace(netloc(url), r":[0-9]*$", ""), r"^\[(.*)\]$", "$1")


def port(url) -> Column:
    return F.regexp_extract(netloc(url), r":([0-9]+)$", 1)


def decoded(path) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def path(url) -> Column:
    return F.when(part(url, 3).contains("%"), decoded(part(url, 3))).otherwise(part(url, 3))


def query(url) -> Column:
    return F.regexp_replace(part(url, 4), r"^\?", "")


def is_ip(host) -> Column:
    return host.rlike(IPV4) | host.rlike(IPV6)


#: A public suffix list that one of Spark's own libraries brings.
SUFFIX_LIST = "mozilla/public-suffix-list.txt"


def public_suffixes(spark: SparkSession, path: str | None = None) -> tuple[str, ...]:
    """Rules of a public suffix list (a rule a line, comments after //), names in their ASCII form. Without a path the list among Spark's libraries; TWO_LABEL_SUFFIXES where there is none."""
    if path:
        lines = [r[0] for r in spark.read.text(path).toLocalIterator()]
    else:
        found = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(SUFFIX_LIST)
        if found is None:
            return TWO_LABEL_SUFFIXES
        lines = bytes(found.readAllBytes()).decode().splitlines()
        found.close()
    rules = [line.split()[0] for line in lines if line.strip() and not line.startswith("//")]
    return tuple(sorted({ascii_name(r) for r in rules}))


def ascii_name(rule: str) -> str:
    try:
        return rule if rule.isascii() else ".".join(label.encode("idna").decode() for label in rule.split("."))
    except UnicodeError:  # no host name is written so
        return rule


def among(name, names) -> Column:
    """Whether a name without spaces is one of many: they are lines of a constant table, and a CRC tells the line. Thousands of literals would take seconds to plan."""
    lines = [" "] * max(1, len(names) // 4)
    for own in names:
        lines[zlib.crc32(own.encode()) % len(lines)] += own + " "
    at = (F.crc32(name.cast("binary")) % len(lines) + 1).cast("int")
    return F.contains(F.element_at(F.split(F.lit("\n".join(lines)), "\n"), at), F.concat(F.lit(" "), name, F.lit(" ")))


def registered(host, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    """The registrable domain of a host name; null where there is none above the suffix.

    suffixes: rules of a public suffix list. The longest that fits counts, a star is any one label, a rule with ! is no suffix; a name that none fits has a suffix of one label.
    """
    kinds: dict[tuple[str, int], list[str]] = {}
    for rule in suffixes:
        kind = rule[0] if rule[0] in "!*" else ""
        kinds.setdefault((kind, rule.count(".") + 1), []).append(rule[{"!": 1, "*": 2}.get(kind, 0) :])
    longest = range(max((k for _, k in kinds), default=1), 1, -1)

    def above(labels):
        n = F.size(labels)

        def tail(k):
            return F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), F.lit(k)), ".")

        found = F.when(F.array_contains(labels, ""), F.lit(None).cast("string"))
        for k in longest:
            if ("!", k) in kinds:
                found = found.when(among(tail(k), kinds["!", k]), tail(k))
        for k in longest:
            fits = among(tail(k), kinds.get(("", k), []))
            if ("*", k) in kinds:
                fits = fits | ((n >= k) & among(tail(k - 1), kinds["*", k]))
            found = found.when(fits, F.when(n > k, tail(k + 1)))
        return found.otherwise(F.when(n > 1, tail(2)))

    # In a lambda, so that the host is found and split once.
    return F.get(F.transform(F.array(F.split(host, r"\.")), above), F.lit(0))


def base_domain(url, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    """The label below the public suffix; an address as it is; the host where nothing is below the suffix."""
    host = hostname(url)
    domain = registered(host, suffixes)
    return F.when(~valid(url) | (netloc(url) == ""), F.lit("")).when(is_ip(host), host).otherwise(F.coalesce(F.substring_index(domain, ".", 1), host))


def blacklisted_domain(url, domains, parts, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    host = hostname(url)
    name = F.when(is_ip(host), host).otherwise(F.coalesce(registered(host, suffixes), host))
    hit = name.isin(*domains)
    for p in parts:
        hit = hit | netloc(url).contains(p)
    return valid(url) & (host != "") & hit


def same_site(url, base) -> Column:
    """An address always is; else the host contains the base label, wherever."""
    return valid(url) & (netloc(url) != "") & (is_ip(hostname(url)) | ((base != "") & F.contains(hostname(url), base)))


def origin(url) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def directory(url) -> Column:
    """The path up to its last slash; / where it has none."""
    return F.when(~valid(url) | ~path(url).contains("/"), F.lit("/")).otherwise(F.regexp_extract(path(url), r"(?s)^(.*/)", 1))


def join(scheme_, base, root, found) -> Column:
    """An absolute URL for what was found in a page; empty for nothing."""
    slash = F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(found.isin("", "/", "//"), F.lit(""))
        .when(found.startswith("http://") | found.startswith("https://"), found)
        .when(found.startswith("//"), F.concat(scheme_, F.lit(":"), found))
        .when(found.startswith("/"), F.concat(base, found))
        .when(found.startswith("js/") | found.contains("/"), F.concat(base, F.lit("/"), found))
        .otherwise(F.concat(base, slash, found))
    )


def sanitized(name) -> Column:
    return F.left(F.regexp_replace(name, r"[^a-zA-Z0-9._\-]", "_"), F.lit(200))


def folder(url) -> Column:
    tail = F.when(path(url).isin("", "/"), F.lit("")).otherwise(F.concat(F.lit("_"), F.ltrim(path(url), F.lit("/"))))
    return sanitized(F.when(~valid(url) | (netloc(url) == ""), text(url)).otherwise(F.concat(netloc(url), tail)))


def single_slashes(url) -> Column:
    """Runs of slashes after :// as one, in the query too."""
    at = F.instr(url, "://")
    return F.when(at == 0, url).otherwise(F.concat(F.left(url, at + 2), F.regexp_replace(F.substr(url, at + 3), "/{2,}", "/")))


def ancestors(url, depth: int) -> Column:
    """Parents of a URL's path, nearest first, with a slash at the end; without query and fragment."""
    segments = F.filter(F.split(part(url, 3), "/"), lambda s: s != "")
    n = F.size(segments)
    head = F.concat(scheme(url), F.lit("://"), part(url, 2))
    up = F.sequence(F.lit(1), F.greatest(F.least(F.lit(depth), n - 1), F.lit(1)))
    found = F.transform(up, lambda k: F.concat(head, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), F.greatest(n - k, F.lit(0))), "/"), F.lit("/")))
    return F.when(valid(url) & (n > 1) & F.lit(depth > 0), found).otherwise(F.array().cast("array<string>"))


def kind_of_request(url) -> Column:
    """js, no_js or static, by the ending of a captured request's path."""
    ending = F.lower(F.regexp_extract(path(url), r"(\.[^./]*)$", 1))
    return F.when(~valid(url), F.lit("static")).when(ending == ".js", F.lit("js")).when(ending == "", F.lit("no_js")).otherwise(F.lit("static"))

"""Targets, liveness, and what home pages name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import urls

#: Fixed value: most bytes of a body that are kept.
BODY_CAP = 16 << 20


def target_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines that are neither blank nor comments; neither checked nor made distinct."""
    line = F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return lines.select(line.alias("target")).filter((F.col("target") != "") & ~F.col("target").startswith("#"))


def read_targets(spark: SparkSession, path: str, first: str | None = None) -> DataFrame:
    found = target_lines(spark.read.text(path))
    return spark.createDataFrame([(first,)], "target string").unionByName(found) if first else found


def parsed(targets: DataFrame, column: str = "target", suffixes=urls.TWO_LABEL_SUFFIXES) -> DataFrame:
    """target with scheme, host, port, base_domain, folder; lines without scheme or host are left out."""
    u = F.col(column)
    ok = urls.valid(u) & (urls.scheme(u) != "") & (urls.netloc(u) != "")
    return targets.filter(ok).withColumns({"scheme": urls.scheme(u), "host": urls.hostname(u), "port": urls.port(u), "base_domain": urls.base_domain(u, suffixes), "folder": urls.folder(u)})


def base_of(scheme, host, port):
    return F.concat(scheme, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")))


def error_class(error):
    """refused, dns, timeout, tls, or the first 80 signs of the error on one line."""
    low = F.lower(error)
    return (
        F.when(low.rlike("connection refused|actively refused|connectex"), "refused")
        .when(low.contains("no such host"), "dns")
        .when(low.rlike("timeout|deadline exceeded"), "timeout")
        .when(low.contains("tls"), "tls")
        .otherwise(F.left(F.translate(error, "\r\n", "  "), F.lit(80)))
    )


def liveness(answers: DataFrame) -> DataFrame:
    """url, alive, reason from (url, http_status, error): any status is alive."""
    alive = F.col("http_status").isNotNull()
    return answers.select("url", alive.alias("alive"), F.when(~alive, error_class(F.coalesce("error", F.lit("")))).alias("reason"))


def capped(bodies: DataFrame, cap: int = BODY_CAP) -> DataFrame:
    """body cut to cap bytes, with truncated; skipped for attachments, where there is a content_disposition."""
    size = F.octet_length("body")
    out = bodies.withColumns({"truncated": size > cap, "body": F.when(size > cap, F.substring(F.col("body").cast("binary"), 1, cap).cast("string")).otherwise(F.col("body"))})
    if "content_disposition" in bodies.columns:
        out = out.withColumn("skipped", F.coalesce(F.lower("content_disposition").contains("attachment"), F.lit(False)))
    return out


SCRIPT_SRC = r"""(?is)<script\b[^>]*?\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def resolved(base, found):
    """A reference against an absolute URL: absolute, scheme-relative, rooted, or beside it; dot segments are taken out."""
    scheme, root, folder = urls.scheme(base), urls.origin(base), urls.directory(base)
    whole = (
        F.when(found.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), found)
        .when(found.startswith("//"), F.concat(scheme, F.lit(":"), found))
        .when(found.startswith("/"), F.concat(root, found))
        .otherwise(F.concat(root, folder, found))
    )
    plain = F.regexp_replace(whole, r"/\./", "/")
    for _ in range(4):
        plain = F.regexp_replace(plain, r"(?<=[^/:])/[^/?#.][^/?#]*/\.\./", "/")
    return plain


def homepage(bodies: DataFrame) -> DataFrame:
    """target, url, kind, source: each target as base_url, and the scripts that its page names. bodies: target, body."""
    found = F.filter(F.array(*[F.regexp_extract_all("body", F.lit(SCRIPT_SRC), F.lit(k)) for k in (1, 2, 3)]), lambda x: x.isNotNull())
    each = F.filter(F.transform(F.flatten(found), lambda x: F.regexp_replace(F.trim(x), "/+$", "")), lambda x: x != "")
    scripts = bodies.select("target", F.explode(each).alias("found")).select("target", resolved(F.col("target"), F.col("found")).alias("url"), F.lit("js").alias("kind"))
    own = bodies.select("target", F.col("target").alias("url"), F.lit("base_url").alias("kind"))
    return own.unionByName(scripts).withColumn("source", F.lit("homepage"))


def captured(requests: DataFrame) -> DataFrame:
    """target, url, kind, source of captured requests, each once; inline data is left out."""
    kept = requests.filter(~F.col("url").startswith("data:") & ~F.col("url").startswith("blob:")).dropDuplicates(["target", "url"])
    return kept.select("target", "url", urls.kind_of_request(F.col("url")).alias("kind"), F.lit("chromedp").alias("source"))


def homepages(bodies: DataFrame, requests: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """target, url, kind, source by the mode: "on" captured requests, "off" the scripts that pages name, "auto" captured ones for the targets that have any."""
    if mode not in ("on", "off", "auto"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "on" and requests is None:
        raise ValueError("there are no captured requests")
    if mode == "off" or requests is None:
        return homepage(bodies)
    if mode == "on":
        return captured(requests)
    return captured(requests).unionByName(homepage(bodies.join(requests.select("target").distinct(), "target", "left_anti")))

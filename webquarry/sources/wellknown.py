"""Readers of documents at well-known places: robots, sitemaps, OpenID, OpenAPI, service mappings, source maps.

Each takes bodies (target, url, body) that were fetched with status 200, and gives rows; none is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import jsonwalk, urls

# Where the documents are.
DOCUMENTS = ("/robots.txt", "/sitemap.xml", "/.well-known/security.txt", "/.well-known/openid-configuration")
OPENAPI_PATHS = ("/openapi.json", "/openapi.yaml", "/swagger.json", "/v2/api-docs", "/v3/api-docs", "/swagger/v1/swagger.json", "/api-docs")
MAPPING_PATHS = ("/actuator", "/actuator/mappings", "/actuator/env")
OPENID_FIELDS = (
    "authorization_endpoint", "token_endpoint", "userinfo_endpoint", "jwks_uri", "registration_endpoint",
    "introspection_endpoint", "revocation_endpoint", "end_session_endpoint", "device_authorization_endpoint",
)
# Verbs of an operation.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
OPENAPI = "struct<paths:map<string,map<string,string>>,servers:array<struct<url:string>>,host:string,basePath:string,schemes:array<string>>"
SOURCE_MAP = "struct<version:int,sources:array<string>,sourcesContent:array<string>,sections:array<struct<map:struct<sources:array<string>,sourcesContent:array<string>>>>>"


def wanted(targets: DataFrame, spark: SparkSession) -> DataFrame:
    """target, url of every document to look for."""
    paths = F.array(*[F.lit(p) for p in DOCUMENTS + OPENAPI_PATHS + MAPPING_PATHS])
    return targets.select("target", F.explode(F.transform(paths, lambda p: F.concat(urls.origin(F.col("target")), p))).alias("url"))


def readable(bodies: DataFrame) -> DataFrame:
    kept = (F.col("status") == 200) & (F.octet_length("body") > 0)
    return bodies.filter(kept & ~F.coalesce("skipped", F.lit(False)) if "skipped" in bodies.columns else kept)


def robots_path(base, value):
    """An absolute URL for a path of a robots file, without wildcards; null for none."""
    p = F.trim(F.replace(F.regexp_replace(F.trim(value), r"\$\z", ""), F.lit("*"), F.lit("")))
    p = F.regexp_replace(p, "/{2,}", "/")
    bad = p.rlike(r"[\\$?]") | (F.regexp_replace(p, "^/+|/+$", "") == "")
    return F.when(~bad, F.concat(base, F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))))


def robots(bodies: DataFrame) -> DataFrame:
    """target, url, kind, source of allow and disallow lines; sitemaps have the kind sitemap."""
    lines = bodies.select("target", F.explode(F.split("body", "\r?\n")).alias("line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    lines = lines.filter(~F.col("line").startswith("#") & F.col("line").contains(":"))
    key = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.regexp_replace(F.substr("line", F.instr("line", ":") + 1), "#.*$", ""))
    rows = lines.select("target", key.alias("key"), value.alias("value")).filter((F.col("value") != "") & F.col("key").isin("allow", "disallow", "sitemap"))
    url = robots_path(urls.origin(F.col("target")), F.col("value"))
    is_map = F.col("key") == "sitemap"
    rows = rows.withColumns({
        "url": F.when(is_map & F.col("value").rlike("^https?://"), F.col("value")).otherwise(url),
        "kind": F.when(is_map, "sitemap").when(F.col("value").contains("/api/"), "api_path").otherwise("static_url"),
    })
    return rows.filter(F.col("url").isNotNull()).select("target", "url", "kind", F.lit("robots.txt").alias("source"))


LOCATION = r"(?s)<(?:\w+:)?loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc>"


def locations(body, element: str):
    blocks = F.regexp_extract_all(body, F.lit(rf"(?s)<(?:\w+:)?{element}(?:\s[^>]*)?>.*?</(?:\w+:)?{element}>"), F.lit(0))
    found = F.transform(blocks, lambda b: F.trim(F.regexp_extract(b, LOCATION, 1)))

    def plain(x):
        for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))
        return x

    found = F.transform(found, plain)
    return F.filter(found, lambda x: x != "")


def sitemaps(bodies: DataFrame) -> DataFrame:
    """target, url of pages, and of one level of sitemaps below, whose bodies are in bodies too. bodies: target, url, body, nested."""
    top = bodies.filter(~F.coalesce("nested", F.lit(False)))
    below = top.select("target", "url", F.explode(locations(F.col("body"), "sitemap")).alias("map")).filter("map != url").select("target", F.col("map").alias("url")).distinct()
    inner = bodies.join(below, ["target", "url"], "left_semi")
    pages = top.unionByName(inner).filter(F.col("body").rlike(r"<(?:\w+:)?urlset[\s>]"))
    found = pages.select("target", F.explode(locations(F.col("body"), "url")).alias("url"))
    return found.select("target", "url", F.lit("no_js").alias("kind"), F.lit("sitemap.xml").alias("source"))


def openid(bodies: DataFrame) -> DataFrame:
    each = F.filter(F.array(*[F.get_json_object("body", f"$.{name}") for name in OPENID_FIELDS]), lambda x: x.isNotNull() & (x != ""))
    return bodies.select("target", F.explode(each).alias("url"), F.lit("api_path").alias("kind"), F.lit("wellknown:openid").alias("source"))


def server_base(doc, origin):
    """Where the paths of an API description are: its first server, its host, or the target."""
    server = F.trim(F.get(doc["servers"], F.lit(0))["url"])
    secure = F.exists(doc["schemes"], lambda s: F.lower(s) == "https")
    scheme = F.when(F.coalesce(F.size(doc["schemes"]), F.lit(0)) <= 0, F.lit("https")).when(secure, F.lit("https")).otherwise(F.lower(F.get(doc["schemes"], F.lit(0))))
    base = F.coalesce(doc["basePath"], F.lit(""))
    base = F.when(base == "", base).otherwise(F.regexp_replace(F.when(base.startswith("/"), base).otherwise(F.concat(F.lit("/"), base)), "/+$", ""))
    return (
        F.when(F.coalesce(server, F.lit("")) != "", F.regexp_replace(server, "/+$", ""))
        .when(F.coalesce(doc["host"], F.lit("")) != "", F.concat(scheme, F.lit("://"), doc["host"], base))
        .otherwise(F.regexp_replace(origin, "/+$", ""))
    )


def openapi(bodies: DataFrame) -> DataFrame:
    """target, url, methods, source of each path of an API description."""
    docs = bodies.select("target", "url", F.from_json("body", OPENAPI).alias("doc")).filter(F.size("doc.paths") > 0)
    source = F.when(urls.path(F.col("url")).contains("swagger"), "swagger.json").otherwise("openapi.json")
    rows = docs.select("target", server_base(F.col("doc"), urls.origin(F.col("target"))).alias("base"), source.alias("source"), F.explode("doc.paths").alias("path", "operations")).filter("path != ''")
    methods = F.sort_array(F.transform(F.filter(F.map_keys("operations"), lambda m: F.lower(m).isin(*VERBS)), lambda m: F.upper(m)))
    rooted = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))
    url = F.when(F.col("base") == "", F.col("path")).otherwise(F.concat(F.regexp_replace("base", "/+$", ""), rooted))
    return rows.select("target", url.alias("url"), F.coalesce(methods, F.array().cast("array<string>")).alias("methods"), "source")


def mappings(bodies: DataFrame) -> DataFrame:
    """target, url, source of the paths that a service's management page maps."""
    rows = bodies.select("target", F.explode(jsonwalk.mapped_paths("body")).alias("path"))
    return rows.select("target", F.concat(F.regexp_replace(urls.origin(F.col("target")), "/+$", ""), "path").alias("url"), F.lit("actuator/mappings").alias("source"))


def source_map(bodies: DataFrame, key: list[str]) -> DataFrame:
    """key columns, path, content of each source with content in version 3 maps, indexed ones too."""
    maps = bodies.select(*key, F.from_json("body", SOURCE_MAP).alias("m")).filter("m.version = 3")
    pair = "array<struct<path:string,content:string>>"

    def both(sources, contents):
        return F.transform(contents, lambda c, k: F.struct(F.coalesce(F.get(sources, k), F.lit("")).alias("path"), c.alias("content"))).cast(pair)

    none = F.array().cast(pair)
    sections = F.flatten(F.transform("m.sections", lambda s: F.coalesce(both(s["map"]["sources"], s["map"]["sourcesContent"]), none)))
    everything = F.concat(F.coalesce(both(F.col("m.sources"), F.col("m.sourcesContent")), none), F.coalesce(sections, none))
    return maps.select(*key, F.explode(everything).alias("s")).select(*key, "s.path", "s.content").filter("content != ''")


def discovered(bodies: DataFrame) -> DataFrame:
    """target, url, kind, source, methods of all that documents at well-known places tell; operations of API descriptions have the kind endpoint.

    bodies: target, url, status, body. A document is known by its place at the target's origin; nested sitemaps are those that others name.
    """
    bodies = readable(bodies).select("target", "url", "body", urls.origin(F.col("target")).alias("origin"))

    def at(*paths: str) -> DataFrame:
        return bodies.filter(F.array_contains(F.transform(F.array(*[F.lit(p) for p in paths]), lambda p: F.concat("origin", p)), F.col("url")))

    def there(rows: DataFrame, kind: str, source: str) -> DataFrame:
        return rows.select("target", "url", F.lit(kind).alias("kind"), F.lit(source).alias("source"))

    named = robots(at("/robots.txt"))
    maps = at("/sitemap.xml").select("target", "url").unionByName(named.filter("kind = 'sitemap'").select("target", "url")).distinct().withColumn("top", F.lit(True))
    maps = bodies.join(maps, ["target", "url"], "left").select("target", "url", "body", F.col("top").isNull().alias("nested"))
    described, health = at(*OPENAPI_PATHS), at(*MAPPING_PATHS)
    parts = [
        named.filter("kind != 'sitemap'"), sitemaps(maps),
        there(at("/.well-known/security.txt"), "static_url", "wellknown:security.txt"),
        there(at("/.well-known/openid-configuration"), "static_url", "wellknown:openid"), openid(at("/.well-known/openid-configuration")),
        there(described, "static_url", "wellknown:openapi"), there(health, "api_path", "wellknown:actuator"),
        mappings(at("/actuator/mappings")).withColumn("kind", F.lit("api_path")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    none = F.lit(None).cast("array<string>")
    return out.withColumn("methods", none).distinct().unionByName(openapi(described).withColumn("kind", F.lit("endpoint")))

"""Planning of requests: candidates from paths and bases, methods, ancestors. Plans are tables; nothing is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webquarry.functions import urls, values
from webquarry.functions.dialect import any_of
from webquarry.sources.targets import base_of

# Words in a path that suggest a change of state.
ACTION_WORDS = (
    "create", "add", "insert", "new", "register", "update", "edit", "set", "modify", "put", "patch", "delete", "remove", "destroy",
    "cancel", "reset", "save", "submit", "login", "logout", "signin", "signout", "signup", "upload", "import", "export", "send",
    "publish", "approve", "reject", "change", "enable", "disable", "toggle", "do", "exec", "run",
)
#: Fixed value: bytes of a planned URL.
MAX_URL = 2048
STRINGS = "array<string>"


def dangerous(url):
    return F.lower(url).rlike(any_of(values.DANGER))


def action_word(url):
    path = F.when(urls.valid(url), urls.path(url)).otherwise(url)
    tokens = F.transform(F.regexp_extract_all(path, F.lit("[A-Z][a-z]*|[a-z]+|[0-9]+"), F.lit(0)), lambda t: F.lower(t))
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ACTION_WORDS]))


def declared_method(verb):
    """The request kind for a declared verb; null for others."""
    return F.when(verb == "POST", F.lit("POST_JSON")).when(verb.isin("GET", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"), verb)


def methods_for(url, methods, strategy):
    """Declared methods; without any, by the strategy: all, conservative, or else by action words."""
    declared = F.array_distinct(F.filter(F.transform(F.coalesce(methods, F.array().cast(STRINGS)), declared_method), lambda m: m.isNotNull()))
    lit = lambda *names: F.array(*[F.lit(n) for n in names])
    return (
        F.when(F.size(declared) > 0, declared)
        .when(strategy == "all", lit("GET", "POST_FORM", "POST_JSON"))
        .when((strategy == "conservative") | ~action_word(url), lit("GET"))
        .otherwise(lit("GET", "POST_JSON"))
    )


def body_for(method, parameters):
    """Body of a planned request; null without one."""
    form = F.array_join(F.transform(parameters, lambda p: F.concat(p, F.lit("="))), "&")
    quoted = F.transform(parameters, lambda p: F.concat(F.lit('"'), F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":""')))
    return F.when((method == "POST_FORM") & (F.size(parameters) > 0), form).when(method == "POST_JSON", F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")))


def http_verb(method):
    return F.when(method.isin("POST_FORM", "POST_JSON"), "POST").when(method.isin("", "GET"), "GET").otherwise(method)


def request_content_type(method):
    return F.when(method == "POST_FORM", "application/x-www-form-urlencoded").when(method.isin("POST_JSON", "PUT", "PATCH"), "application/json")


def placed(base, path):
    return F.when(path.rlike("^https?://"), path).when(path.startswith("/"), F.concat(base, path)).otherwise(F.concat(base, F.lit("/"), path))


def merged(rows: DataFrame) -> DataFrame:
    """target, url, methods: rows (target, url, methods, order) of a URL as one, methods in order of arrival, each once."""
    grouped = rows.filter("url != ''").groupBy("target", "url").agg(F.sort_array(F.collect_set(F.struct("order", "methods"))).alias("all"))
    return grouped.select("target", "url", F.array_distinct(F.flatten(F.transform("all", lambda x: x["methods"]))).alias("methods"))


def probe_targets(targets: DataFrame, paths: DataFrame, seeds: DataFrame, endpoints: DataFrame) -> DataFrame:
    """target, url, methods. targets: parsed; paths: target, path, method; seeds: target, url, kind; endpoints: target, path, methods."""
    bases = targets.select("target", base_of(F.col("scheme"), F.col("host"), F.col("port")).alias("base")).distinct()
    none = F.array().cast(STRINGS)
    own = F.when(F.coalesce("method", F.lit("")) != "", F.array("method")).otherwise(none)
    first = paths.join(bases, "target").select("target", placed(F.col("base"), F.col("path")).alias("url"), own.alias("methods"), F.lit(0).alias("order"))
    second = seeds.filter("kind = 'no_js'").select("target", "url", none.alias("methods"), F.lit(1).alias("order"))
    third = endpoints.filter("path != ''").join(bases, "target").select("target", placed(F.col("base"), F.col("path")).alias("url"), F.coalesce("methods", none).alias("methods"), F.lit(2).alias("order"))
    return merged(first.unionByName(second).unionByName(third))


def hints(paths: DataFrame) -> DataFrame:
    """target, path, method: one verb a path; where bodies disagree, the last by the alphabet (it is a race elsewhere)."""
    return paths.filter("coalesce(method, '') != ''").groupBy("target", "path").agg(F.max("method").alias("method"))


def permuted(targets: DataFrame, discovered: DataFrame, paths: DataFrame, single: bool = False) -> DataFrame:
    """target, url, methods, source: discovered bases x API prefixes x path endings of each target.

    targets: parsed; discovered: target, url, kind; paths: target, path, place, and method if one is declared. Joins are on the target.
    """
    known = targets.filter("base_domain != ''").select("target", "base_domain").distinct()
    u = F.col("url")
    pages = discovered.filter("kind = 'no_js'").join(known, "target").filter(urls.same_site(u, F.col("base_domain")))
    pages = pages.select("target", urls.origin(u).alias("tree"), urls.path(u).alias("path"), urls.scheme(u).alias("scheme")).distinct()
    trees = pages.select("target", F.col("tree").alias("base"))
    deep = pages.filter(~F.col("path").isin("", "/"))
    at = F.instr("path", "api/")
    with_api = deep.filter(at > 0).select("target", "tree", F.concat(F.left("path", at - 1), F.lit("api")).alias("prefix"))
    parents = with_api.select("target", "tree", F.regexp_replace(F.regexp_replace("prefix", "/[^/]*$", ""), "/+$", "").alias("up")).filter("up != ''").select("target", F.concat("tree", "up").alias("base"))
    usable = paths.filter((F.octet_length("path") > 2) & ~F.col("path").startswith("http")).select("target", F.col("path").alias("api"), "place", F.coalesce("method", F.lit("")).alias("method"))
    inside = deep.filter(at == 0).join(usable, "target").filter((F.col("path") != F.col("api")) & (F.instr("path", F.col("api")) > 0))
    cut = F.regexp_replace(F.left("path", F.instr("path", F.col("api")) - 1), "/+$", "")
    truncated = inside.select("target", "tree", cut.alias("up")).filter("up != ''").select("target", F.concat("tree", "up").alias("base"))
    split = F.instr("api", "api/")
    api_prefixes = usable.filter(split > 0).select("target", F.concat(F.lit("/"), F.ltrim(F.left("api", split - 1), F.lit("/")), F.lit("api")).alias("prefix"))
    prefixes = api_prefixes.unionByName(with_api.select("target", F.concat(F.lit("/"), F.ltrim("prefix", F.lit("/"))).alias("prefix"))).distinct()
    ending = F.when(split > 0, F.concat(F.lit("/"), F.substr("api", split + 4))).otherwise(F.concat(F.lit("/"), F.ltrim("api", F.lit("/"))))
    ends = usable.select("target", ending.alias("ending"), "api", "place", "method")
    # Origins of an ending in order: a second one clears the hint, a third one sets it anew.
    origins = F.transform(F.sort_array(F.collect_set(F.when(F.col("method") != "", F.struct("place", "api", "method")))), lambda x: F.struct(x["api"].alias("api"), x["method"].alias("method")))
    ends = ends.groupBy("target", "ending").agg(origins.alias("origins"))
    blank = F.struct(F.lit("").alias("api"), F.lit("").alias("method"))
    hint = F.aggregate("origins", blank, lambda had, x: F.when((had["api"] != "") & (had["api"] != x["api"]), blank).otherwise(x))["method"]
    ends = ends.select("target", "ending", F.when(hint != "", F.array(hint)).otherwise(F.array().cast(STRINGS)).alias("methods"))
    bases = parents.unionByName(truncated).unionByName(trees).distinct()
    joined = bases.join(prefixes, "target", "left" if single else "inner").select("target", "base", "prefix")
    if single:  # without any prefix: the bases themselves, and /api below them
        fallback = F.when(F.col("prefix").isNull(), F.array(F.lit(""), F.lit("/api"))).otherwise(F.array("prefix"))
        joined = joined.select("target", "base", F.explode(fallback).alias("prefix"))
    joined = joined.select("target", F.concat("base", "prefix").alias("front")).distinct()
    plan = joined.join(ends, "target").join(known, "target").withColumn("url", F.concat("front", "ending"))
    plan = plan.filter(F.octet_length("url") <= MAX_URL).withColumn("url", urls.single_slashes(F.col("url")))
    plan = plan.filter(~urls.path(u).isin("", "/") & urls.same_site(u, F.col("base_domain")))
    first = W.partitionBy("target", "url").orderBy("front", "ending")
    return plan.withColumn("n", F.row_number().over(first)).filter("n = 1").select("target", "url", "methods", F.lit("permutate").alias("source"))


def requests(plan: DataFrame, strategy: str = "action-aware", parameters=None) -> DataFrame:
    """target, url, method, http_verb, content_type, body: a row for each request; dangerous URLs have the method SKIPPED_DANGEROUS."""
    u = F.col("url")
    parameters = F.array(*[F.lit(p) for p in parameters or ()]).cast(STRINGS)
    methods = F.when(dangerous(u), F.array(F.lit("SKIPPED_DANGEROUS"))).otherwise(methods_for(u, F.col("methods"), F.lit(strategy)))
    rows = plan.select("target", "url", F.explode(methods).alias("method"))
    skipped = F.col("method") == "SKIPPED_DANGEROUS"
    m = F.col("method")
    return rows.withColumns({"http_verb": F.when(~skipped, http_verb(m)), "content_type": request_content_type(m), "body": body_for(m, parameters)})


def ancestor_plan(results: DataFrame, planned: DataFrame, depth: int = 2) -> DataFrame:
    """target, url, methods, source: parents of URLs that answered 2xx, without those planned before."""
    hits = results.filter("status_code between 200 and 299 and coalesce(source, '') != 'ancestor_recurse'")
    found = hits.select("target", F.explode(urls.ancestors(F.col("url"), depth)).alias("url")).distinct()
    new = found.join(planned.select("target", "url").distinct(), ["target", "url"], "left_anti")
    return new.select("target", "url", F.array(F.lit("GET")).alias("methods"), F.lit("ancestor_recurse").alias("source"))

"""Extraction of scripts, static files, API paths and front-end routes from text bodies.

Patterns of a tier are one alternation: at each place the first alternative that matches takes the text, and
if its filter refuses the value, nothing else is tried there. Tiers go one after another. All groups of an
alternation are read by aligned `regexp_extract_all`, so the scan stays in the JVM and needs no shuffle; the
candidates, not the bodies, are shuffled once to keep the first of each kind and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webquarry.functions import candidates, dialect, values

# Verbs that a declaration may have.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
#: Bodies over so many bytes are not searched for a bundler's chunk map.
CHUNK_MAP_BYTES = 4 << 20


def groups_in(pattern: str) -> int:
    """Capturing groups of a pattern in RE2 syntax."""
    import re

    bare = re.sub(r"\\.", "", pattern)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)|\(\?P?<", bare))


def tiers() -> list[tuple[str, list[tuple[str, str, str, int, bool]]]]:
    """(filter, alternatives), an alternative being (id, kind, pattern, group, slash)."""
    return [
        ("extra", [(i, kind, p, g, slash) for i, kind, p, g, slash in values.EXTRAS]),
        ("js", [(f"js_{k}", "js", p, 0, False) for k, p in enumerate(values.JS_PATTERNS)]),
        ("static", [(f"static_{k}", "static", p, 0, False) for k, p in enumerate(values.STATIC_PATTERNS)]),
        ("api", [(f"api_{k}", "api", p, g, False) for k, (p, g) in enumerate(values.API_PATTERNS)]),
    ]


#: Signs (private use) that part the groups of a match, and begin and end it; bodies that have them take the way without.
PART, BEGIN, STOP = "\ue000", "\ue001", "\ue002"


def scan(body: Column, alternatives, tier: int) -> Column:
    """array<struct<raw, tier, which, place>>: the non-overlapping matches of an alternation, in order, and which alternative took each.

    One pass of the alternation writes the groups of each match into its place, one plain pass reads them.
    """
    union = F.lit("(?d)" + "|".join(f"({dialect.java(p).removeprefix('(?d)')})" for _, _, p, _, _ in alternatives))
    numbers, at = [], 1
    for _, _, p, group, _ in alternatives:
        numbers.append(at + group)
        at += 1 + groups_in(p)

    def match(raw, which, place):
        return F.struct(F.when(raw != "", raw).alias("raw"), F.lit(tier).alias("tier"), F.when(raw != "", which).cast("int").alias("which"), place.alias("place"))

    written = F.regexp_replace(body, union, F.lit(BEGIN + PART.join(f"${n}" for n in numbers) + STOP))
    pieces = F.regexp_extract_all(written, F.lit(f"{BEGIN}([^{STOP}]*){STOP}"), F.lit(1))
    fast = F.transform(pieces, lambda m, place: match(F.trim(m, F.lit(PART)), F.length(m) - F.length(F.ltrim(m, F.lit(PART))), place))
    # Without the signs: a pass for each group.
    names = [f"g{k}" for k in range(len(numbers))]
    zipped = F.arrays_zip(*[F.regexp_extract_all(body, union, F.lit(n)).alias(name) for n, name in zip(numbers, names)])

    def chosen(m, place):
        which = F.lit(None).cast("int")
        for k in reversed(range(len(names))):
            which = F.when(m[names[k]] != "", F.lit(k)).otherwise(which)
        return match(F.coalesce(*[F.nullif(m[n], F.lit("")) for n in names], F.lit("")), which, place)

    return F.when(body.rlike(f"[{PART}{BEGIN}{STOP}]"), F.transform(zipped, chosen)).otherwise(fast)


def looked_up(column: int | str, nothing) -> Column:
    """A column of the alternative that (tier, which) names, by literal arrays."""
    out = nothing
    for k, (_, alternatives) in enumerate(tiers()):
        out = F.when(F.col("tier") == k + 1, F.get(F.array(*[F.lit(a[column]) for a in alternatives]), F.col("which"))).otherwise(out)
    return out


def base_url(body: Column) -> Column:
    """The first declared base URL by its place, or null."""
    each = [F.struct(F.regexp_instr(body, F.lit(dialect.java(p))).alias("at"), F.lit(k).alias("k"), F.regexp_extract(body, dialect.java(p), 1).alias("value")) for k, p in enumerate(values.BASE_URL)]
    found = F.array_min(F.filter(F.array(*each), lambda x: x["at"] > 0))["value"]
    return F.when(body.contains("baseURL"), found)


def base_urls(body: Column) -> Column:
    """All declared base URLs of one body, distinct, by the place where their declarations begin; at one place in the order of the patterns."""

    def found(k: int, pattern: str) -> Column:
        # Where matches begin: what lies before each, added up.
        p = dialect.java(pattern)
        values_, wholes = F.regexp_extract_all(body, F.lit(p), F.lit(1)), F.regexp_extract_all(body, F.lit(p), F.lit(0))
        between = F.split(F.regexp_replace(body, F.lit(p), F.lit(STOP)), STOP)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        places = F.aggregate(
            F.arrays_zip(F.slice(between, F.lit(1), F.size(wholes)).alias("b"), wholes.alias("w")),
            start,
            lambda s, x: F.struct((s["at"] + F.length(x["b"]) + F.length(x["w"])).alias("at"), F.array_append(s["all"], s["at"] + F.length(x["b"])).alias("all")),
        )["all"]
        return F.transform(F.arrays_zip(places.alias("at"), values_.alias("value")), lambda x: F.struct(x["at"].alias("at"), F.lit(k).alias("k"), x["value"].alias("value")))

    every = F.array_sort(F.concat(*[found(k, p) for k, p in enumerate(values.BASE_URL)]))
    return F.array_distinct(F.transform(F.filter(every, lambda x: x["value"] != ""), lambda x: x["value"]))


def method_pairs(body: Column) -> Column:
    """array<struct<path, method>> of declared requests: path before verb first, then verb before path; distinct."""
    def read(pattern, path, verb):
        p = F.lit(dialect.java(pattern))
        both = F.arrays_zip(F.regexp_extract_all(body, p, F.lit(path)).alias("p"), F.regexp_extract_all(body, p, F.lit(verb)).alias("m"))
        return F.transform(both, lambda x: F.struct(x["p"].alias("path"), F.upper(x["m"]).alias("method")))

    pairs = F.concat(read(values.METHOD_AFTER, 1, 2), read(values.METHOD_BEFORE, 2, 1))
    pairs = F.array_distinct(F.filter(pairs, lambda x: x["method"].isin(*VERBS) & (x["path"] != "")))
    return F.when(body.contains("method"), pairs).otherwise(F.array().cast("array<struct<path:string,method:string>>"))


def routes(body: Column) -> Column:
    """Declared front-end routes, distinct, in order."""
    p = F.lit(dialect.java(values.ROUTE))
    both = F.arrays_zip(F.regexp_extract_all(body, p, F.lit(1)).alias("a"), F.regexp_extract_all(body, p, F.lit(2)).alias("b"))
    found = F.transform(both, lambda x: F.trim(F.when(x["a"] != "", x["a"]).otherwise(x["b"])))
    found = F.array_distinct(F.filter(found, lambda r: ~r.isin("", "/", "*") & ~r.startswith(":")))
    return F.when(body.contains("component"), found).otherwise(F.array().cast("array<string>"))


def rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def chunk_urls(body: Column) -> Column:
    """Scripts that a bundler's runtime names by a map of chunks."""
    p = dialect.java(values.WEBPACK)
    base, mapping = F.regexp_extract(body, p, 1), F.regexp_extract(body, p, 2)
    pairs = F.transform(F.filter(F.split(mapping, ","), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    pairs = F.filter(pairs, lambda x: x["k"].startswith('"') & x["v"].startswith('"'))
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit(":"), x["v"])), ","), F.lit("}"))
    entries = F.map_entries(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))
    found = F.transform(entries, lambda e: F.concat(F.lit("/"), base, e["key"], F.lit("."), e["value"], F.lit(".js")))
    return F.when(body.contains('.p+"') & (F.octet_length(body) <= CHUNK_MAP_BYTES) & (F.size(pairs) > 0), F.coalesce(found, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def with_base(base: Column, value: Column) -> Column:
    """value under base: unchanged if it is absolute or there already."""
    root = F.regexp_replace(base, "/+$", "")
    there = (root != "") & ((value == root) | F.startswith(value, F.concat(root, F.lit("/"))) | F.startswith(value, F.concat(root, F.lit("?"))))
    return (
        F.when(base.isNull() | (value == "") | value.startswith("http://") | value.startswith("https://") | there, value)
        .when(value.startswith("/"), F.concat(root, value))
        .otherwise(F.concat(root, F.lit("/"), value))
    )


def extract(bodies: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """key columns, kind, value, pattern, method (null if none is declared), place: what each body has, first of each kind and value."""
    text = F.coalesce(F.col(body), F.lit(""))
    found = bodies.select(
        *key,
        base_url(text).alias("base"),
        method_pairs(text).alias("declared"),
        F.transform(routes(text), rooted).alias("routes"),
        F.concat(*[scan(text, alternatives, k + 1) for k, (_, alternatives) in enumerate(tiers())]).alias("matches"),
        chunk_urls(text).alias("chunks"),
    )
    def plain(tier):
        return lambda v, k: F.struct(v.alias("raw"), F.lit(tier).alias("tier"), F.lit(0).alias("which"), k.alias("place"))

    everything = F.concat(F.transform("chunks", plain(0)), F.col("matches"), F.transform("routes", plain(9)))
    rows = found.select(*key, "base", "declared", "routes", F.explode(everything).alias("m")).select(*key, "base", "declared", "routes", "m.*").filter(F.col("raw").isNotNull())
    rows = rows.withColumns({
        "pattern": looked_up(0, F.when(F.col("tier") == 0, "webpack_chunk").otherwise("vue_router_route")),
        "kind": looked_up(1, F.when(F.col("tier") == 0, "js").otherwise("frontend_route")),
        "slash": looked_up(4, F.lit(False)),
    })
    tier = F.col("tier")

    def cleaned(bare):
        slashed = F.when(F.col("slash") & ~bare.startswith("/") & ~bare.contains("://"), F.concat(F.lit("/"), bare)).otherwise(bare)
        return F.when(tier.isin(0, 1, 9), slashed).when(tier == 2, candidates.script(bare)).when(tier == 3, candidates.static(bare)).otherwise(candidates.api(bare))

    value = candidates.let(F.when(tier.isin(0, 9), F.col("raw")).otherwise(candidates.stripped(F.col("raw"))), cleaned)
    rows = rows.withColumn("value", value).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    # A script that another tier has taken is a script as well.
    also = (F.col("kind") != "js") & tier.between(1, 4) & F.col("value").rlike(r"\.[mc]?js\z")
    own, copy = F.struct("kind", tier.alias("order")), F.struct(F.lit("js").alias("kind"), F.lit(5).alias("order"))
    rows = rows.withColumn("as", F.explode(F.when(also, F.array(own, copy)).otherwise(F.array(own)))).select(*key, "base", "declared", "routes", "value", "pattern", "place", "tier", F.col("as.kind").alias("kind"), F.col("as.order").alias("order"))
    # Under names of their own: a name that the same select gives anew would be taken for the new one inside a lambda.
    rows = rows.withColumnsRenamed({"value": "bare", "kind": "taken"})
    api, bare = F.col("taken") == "api", F.col("bare")
    is_route = api & F.array_contains("routes", rooted(bare))
    said = F.filter("declared", lambda x: x["path"] == bare)
    rows = rows.select(
        *key,
        F.when(is_route, F.lit("frontend_route")).otherwise(F.col("taken")).alias("kind"),
        F.when(is_route, rooted(bare)).when(api, with_base(F.col("base"), bare)).otherwise(bare).alias("value"),
        "pattern",
        F.when(api & ~is_route & (F.size(said) > 0), F.get(said, F.size(said) - 1)["method"]).alias("method"),
        (F.col("order").cast("long") * (1 << 40) + F.col("tier").cast("long") * (1 << 36) + F.col("place").cast("long")).alias("place"),
    )
    first = W.partitionBy(*key, "kind", "value").orderBy("place")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")

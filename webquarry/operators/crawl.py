"""Breadth-first crawl over a table of bodies: one join for each depth, visited URLs left out by an anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions import urls
from webquarry.sources.wellknown import source_map

from .extract import extract

#: Fixed value: default depth.
MAX_DEPTH = 3


def persist(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, where one is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() is not None else df


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node, depth: what is reached from seeds (node) over edges (src, dst), at its least depth; the lineage is cut at each level."""
    frontier = persist(seeds.select("node").distinct())
    visited = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()
        frontier = persist(found.join(visited.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return visited


def found_in(bodies: DataFrame) -> DataFrame:
    """target, referer, kind, url, method, pattern of what bodies (target, url, body) name; scripts and files as absolute URLs."""
    rows = extract(bodies, ["target", "url"])
    u, value = F.col("url"), F.col("value")
    absolute = urls.join(urls.scheme(u), urls.origin(u), urls.directory(u), value)
    kind = F.when(F.col("kind") == "static", "static_url").when(F.col("kind") == "api", "api_path").otherwise(F.col("kind"))
    out = rows.select("target", u.alias("referer"), kind.alias("kind"), F.when(F.col("kind").isin("js", "static"), absolute).otherwise(value).alias("url"), "method", "pattern")
    return out.filter("url != ''")


def crawl(bodies: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, suffixes=urls.TWO_LABEL_SUFFIXES) -> DataFrame:
    """target, url, kind, referer, depth, source, method of everything that pages within depth name.

    bodies: target, url, status, body, and skipped if known; seeds: target, url, kind. What a body names is found once for all
    bodies, then the levels are joins of keys; bodies themselves are not moved again.
    """
    ok = (F.col("status") == 200) & (F.octet_length("body") > 0)
    if "skipped" in bodies.columns:
        ok = ok & ~F.coalesce("skipped", F.lit(False))
    usable = bodies.filter(ok).dropDuplicates(["target", "url"])
    found = persist(found_in(usable))
    known = seeds.filter(F.col("kind").isin("js", "no_js", "base_url")).select("target", "url").distinct()
    bases = seeds.select("target").distinct().withColumn("base", urls.base_domain(F.col("target"), suffixes))
    node = F.struct("target", "url")
    scripts = found.filter("kind = 'js'").join(bases, "target").filter(urls.same_site(F.col("url"), F.col("base")))
    edges = persist(scripts.select(F.struct("target", F.col("referer").alias("url")).alias("src"), node.alias("dst")))
    reached = levels(edges, known.select(node.alias("node")), max_depth - 1).select("node.target", F.col("node.url").alias("referer"), "depth")
    out = found.join(reached, ["target", "referer"]).withColumns({"depth": F.col("depth") + 1, "source": F.lit("crawl")})
    maps = out.filter("pattern = 'sourcemap_ref'").select("target", "referer", "url")
    content = usable.select("target", "url", "body").join(maps, ["target", "url"])
    parts = source_map(content, ["target", "referer"]).withColumn("part", F.monotonically_increasing_id())
    inner = extract(parts.select("target", "referer", "part", F.col("content").alias("body")), ["target", "referer", "part"])
    u, value = F.col("referer"), F.col("value")
    absolute = urls.join(urls.scheme(u), urls.origin(u), urls.directory(u), value)
    kind = F.when(F.col("kind") == "static", "static_url").when(F.col("kind") == "api", "api_path").otherwise(F.col("kind"))
    inner = inner.select("target", F.when(F.col("kind").isin("js", "static"), absolute).otherwise(value).alias("url"), kind.alias("kind"), "referer", F.lit(0).alias("depth"), F.lit("sourcemap").alias("source"), "method").filter("url != ''")
    return out.select("target", "url", "kind", "referer", "depth", "source", "method").unionByName(inner)

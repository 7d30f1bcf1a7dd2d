"""URL filters: a trie over reversed host labels, then path segments, broadcast; the longest match decides.

A rule is (verdict, host, path). It fits its host and every subdomain, if the url's path starts with the
rule's path. Of the rules that fit, the one with the longest host + path wins, then the one with the longer host; block wins over allow for
the same host and path. Up to `BROADCAST_RULES` rules go out as a broadcast trie; more rules are matched by
a join on every host suffix and path prefix that a rule length allows, with the same results.

Defined cases: a null url, or one without "://", has an empty host and path and gets the default verdict;
so does an url that no rule fits. A rule without a host is refused. Repeated rows are judged one by one.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The trie of so many rules stays within about 100 MB of an executor's memory.
BROADCAST_RULES = 200_000
DEFAULT = "allow"


class Trie:
    """Nodes are dicts: host labels from the right, then "/" to the path part, whole segments, and last pieces by their length under ""."""

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            if not host:
                raise ValueError("a rule needs a host")
            path = "/" + (path or "").removeprefix("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path[1:].split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            ends = node.setdefault("", {}).setdefault(len(last), {})
            if ends.get(last, ("allow",))[0] != "block":
                ends[last] = (verdict, host + path, (len(host + path), len(host)))

    def find(self, host: str, path: str):
        """(verdict, rule) of the longest rule that fits, or None."""
        best, node = (None, None, (0, 0)), self.root
        if not host or not path.startswith("/"):
            return None
        segments = path[1:].split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get("/")
            for k, segment in enumerate(segments):
                if below is None:
                    break
                for n, ends in below.get("", {}).items():
                    found = ends.get(segment[:n]) if n <= len(segment) else None
                    if found and found[2] > best[2]:
                        best = found
                below = below.get("/" + segment) if k + 1 < len(segments) else None
        return best[:2] if best[1] else None


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (A-Z in lower case) and path, both empty without "://"."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def by_trie(parts: DataFrame, rules) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(Trie(rules))
    names = parts.columns
    schema = parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("")}).schema

    def run(batches):
        trie, memo = shared.value, {}
        for b in batches:
            found = []
            for key in zip(b.column(names.index("host")).to_pylist(), b.column(names.index("path")).to_pylist()):
                if key not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[key] = trie.find(*key) or (DEFAULT, None)
                found.append(memo[key])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for _, r in found], pa.string()), pa.array([v for v, _ in found], pa.string())], [*names, "rule", "verdict"])

    return mapped(parts, run, schema)


def by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same verdicts for any number of rules: distinct (host, path) pairs spread to host suffixes, joined on the host; then the prefix test."""
    rules = rules.select("verdict", F.col("host").alias("rule_host"), F.concat(F.lit("/"), F.regexp_replace(F.coalesce("path", F.lit("")), "^/", "")).alias("rule_path"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    if not rules.filter("coalesce(rule_host, '') = ''").isEmpty():
        raise ValueError("a rule needs a host")
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    pairs = parts.select("host", "path").distinct().filter(F.col("host") != "")
    labels = F.split("host", r"\.")
    spread = pairs.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    heads = F.filter("lengths", lambda n: n <= F.length("path"))
    spread = spread.join(lengths, "rule_host").withColumn("rule_path", F.explode(F.transform(heads, lambda n: F.left("path", n)))).drop("lengths")
    fits = spread.join(rules, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("verdict")), F.struct(F.length(rule), F.length("rule_host"))).alias("best"))
    best = best.select("host", "path", "best.rule", "best.verdict")
    return parts.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(DEFAULT)))


def filter_urls(df: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """df with host, path, rule and verdict; own columns of these names are replaced. rules: a sequence, or a DataFrame (verdict, host, path)."""
    parts = with_parts(df.drop("host", "path", "rule", "verdict"), url)
    if isinstance(rules, DataFrame):
        first = rules.select("verdict", "host", "path").limit(BROADCAST_RULES + 1).collect()
        if len(first) > BROADCAST_RULES:
            return by_join(parts, rules)
        rules = [tuple(r) for r in first]
    elif len(rules) > BROADCAST_RULES:
        return by_join(parts, df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string"))
    return by_trie(parts, rules)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

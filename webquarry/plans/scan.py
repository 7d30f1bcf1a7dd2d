"""A whole scan over tables: documents at well-known places, home pages, crawl, planned requests, ancestors, answers, report.

Nothing is sent. What a fetcher has brought is a table of bodies, what planned requests were answered is a table of
answers; each stage is a plan over them, kept as a table under the run's folder, and a resumed run reads what is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import urls
from webquarry.operators import crawl, report, responses
from webquarry.operators.rules import RuleSet
from webquarry.sources import targets as target_source
from webquarry.sources import wellknown

from . import probes
from .session import Config, State


class Scan:
    """suffixes: rules of public suffixes, by default a whole list. targets: target lines. bodies: target, url, status, body. answers: target, url, method, status_code, content_type, response. requests: target, url, captured by a browser."""

    def __init__(self, spark: SparkSession, targets: DataFrame, bodies: DataFrame, answers: DataFrame, requests: DataFrame | None = None, config: Config | None = None, rules: RuleSet | None = None, folder: str = "", name: str = "all", time=None, suffixes=None):
        self.spark, self.bodies, self.answers, self.requests = spark, bodies, answers, requests
        self.suffixes = urls.public_suffixes(spark) if suffixes is None else suffixes
        self.targets = target_source.parsed(targets, suffixes=self.suffixes)
        self.config, self.rules, self.time = config or Config(), rules, time
        self.state = State(folder, name, spark) if folder and self.config.resume else None
        self.ran: list[str] = []

    def kept(self, stage: str, compute) -> DataFrame:
        """Output of a stage: read if a run before has kept it, else computed (and kept, if the run has a folder)."""
        if self.state is None:
            self.ran.append(stage)
            found = crawl.persist(compute())  # several stages read it
            return found if self.spark.sparkContext.getCheckpointDir() is not None else found.persist()
        if not self.state.is_done(stage):
            self.ran.append(stage)
        return self.state.table(self.spark, stage, compute)

    def wellknown(self) -> DataFrame:
        return self.kept("wellknown", lambda: wellknown.discovered(self.bodies))

    def homepage(self) -> DataFrame:
        pages = self.bodies.filter("status = 200").select("target", "url", "body").join(self.targets.select("target"), "target", "left_semi").filter("url = target")
        return self.kept("homepage", lambda: target_source.homepages(pages.select("target", "body"), self.requests, self.config.chrome))

    def crawled(self, seeds: DataFrame) -> DataFrame:
        return self.kept("crawl", lambda: crawl.crawl(self.bodies, seeds, self.config.max_depth, self.suffixes))

    def planned(self, found: DataFrame, seeds: DataFrame, endpoints: DataFrame) -> DataFrame:
        """target, url, methods, source: what was found, and what known bases, prefixes and endings make together."""
        paths = found.filter("kind = 'api_path'").select("target", F.col("url").alias("path"), "method", F.xxhash64("referer", "url").alias("place"))
        first = probes.probe_targets(self.targets, paths, seeds, endpoints).withColumn("source", F.lit("crawl"))
        made = probes.permuted(self.targets, seeds.unionByName(found.filter("kind = 'no_js'").select("target", "url", "kind")), paths)
        known = first.select("target", "url")
        return first.unionByName(made.join(known, ["target", "url"], "left_anti"))

    def answered(self, plan: DataFrame) -> DataFrame:
        asked = probes.requests(plan, self.config.fanout).join(plan.select("target", "url", "source"), ["target", "url"])
        return responses.probed(asked.select("target", "url", "method", "body", "source"), self.answers)

    def run(self) -> DataFrame:
        """The events of the stages that the configuration asks for."""
        stages, empty = self.config.stages(), "target string, url string, kind string, source string, methods array<string>"
        known = self.wellknown() if "wellknown" in stages else self.spark.createDataFrame([], empty)
        home = self.homepage() if "homepage" in stages else self.spark.createDataFrame([], "target string, url string, kind string, source string")
        seeds = home.select("target", "url", "kind").unionByName(known.filter("kind != 'endpoint'").select("target", "url", "kind")).distinct()
        found = self.crawled(seeds) if "crawl" in stages else self.spark.createDataFrame([], "target string, url string, kind string, referer string, depth int, source string, method string")
        pages = known.filter("kind != 'endpoint'").unionByName(home, allowMissingColumns=True).select("target", "url", "kind", "source").distinct()
        discovered, results, hits = pages.unionByName(found, allowMissingColumns=True), None, None
        if "probe" in stages:
            endpoints = known.filter("kind = 'endpoint'").select("target", F.col("url").alias("path"), "methods")
            plan = self.kept("probe_plan", lambda: self.planned(found, seeds, endpoints))
            results = self.kept("probe", lambda: self.answered(plan))
            if "ancestor_recurse" in stages and self.config.ancestor_depth > 0:
                above = probes.ancestor_plan(results, plan, self.config.ancestor_depth)
                results = results.unionByName(self.kept("ancestor_recurse", lambda: self.answered(above)))
            if "postprocess" in stages:
                saved = self.answers.join(results.filter("kept and not duplicate").select("target", "url", "method", "body_path"), ["target", "url", "method"])
                hits, links = responses.processed(saved.select("target", F.col("body_path").alias("file"), F.col("response").alias("body")), self.rules)
                hits = self.kept("postprocess", lambda: hits)
                discovered = discovered.unionByName(links, allowMissingColumns=True)
        if self.state is not None:
            self.state.keep_seen(discovered.select("target", "url"))
            self.state.finish()
        return report.finished(report.report(discovered, results, hits, self.time), self.targets, stages, self.time)

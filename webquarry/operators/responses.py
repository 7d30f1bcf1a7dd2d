"""Responses: what is kept, duplicates by content, statistics, rule hits and links in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webquarry.functions import jsonwalk, urls

from . import rules as rule_engine


def kept(status, content_type, body, texts=None):
    """200, JSON or XML, and no text that marks noise."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    noise = rule_engine.is_black_text(body, texts) if texts is not None else rule_engine.is_black_text(body)
    return F.coalesce((status == 200) & (low.contains("xml") | low.contains("json")) & ~noise, F.lit(False))


def body_path(folder, method, url):
    prefix = F.when(method == "POST_FORM", "POST_DATA").when(method == "POST_JSON", "POST_JSON").otherwise("GET")
    return F.concat(folder, F.lit("/response/"), prefix, F.lit("_"), urls.sanitized(url), F.lit(".txt"))


def probed(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """Results of planned requests: one row for each that was answered or skipped.

    plan: target, url, method, body, source; answers: target, url, method, status_code, content_type, response. Bodies are hashed
    before the window, which sees hashes only; first of a target's equal bodies is the one with the least (url, method).
    """
    skipped = plan.filter("method = 'SKIPPED_DANGEROUS'").select("target", "url", "method", "source")
    response = F.col("response")
    keep = kept(F.col("status_code"), F.col("content_type"), response)
    lean = answers.select(
        "target", "url", "method", "status_code", "content_type",
        F.coalesce(F.octet_length("response"), F.lit(0)).cast("long").alias("size"), keep.alias("kept"),
        F.when(keep & (F.octet_length("response") > 0), F.sha2(response.cast("binary"), 256)).alias("body_sha256"),
    )
    rows = plan.filter("method != 'SKIPPED_DANGEROUS'").join(lean, ["target", "url", "method"])
    order = W.partitionBy("target", "body_sha256").orderBy("url", "method")
    rows = rows.withColumn("duplicate", F.col("body_sha256").isNotNull() & (F.row_number().over(order) > 1))
    path = F.when(F.col("body_sha256").isNotNull() & ~F.col("duplicate"), body_path(urls.folder(F.col("target")), F.col("method"), F.col("url"))).otherwise(F.lit(""))
    rows = rows.select("target", "url", "method", "status_code", "content_type", "size", path.alias("body_path"), F.when(F.octet_length("body") > 0, "<params>").alias("parameter"), "body_sha256", "kept", "duplicate", "source")
    return rows.unionByName(skipped.withColumns({"status_code": F.lit(0), "size": F.lit(0).cast("long"), "kept": F.lit(False), "duplicate": F.lit(False)}), allowMissingColumns=True)


def first_bodies(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, sha256, duplicate: by content, the least key first."""
    hashed = bodies.select(F.col(key), F.sha2(F.coalesce(F.col(body), F.lit("")).cast("binary"), 256).alias("sha256"))
    firsts = hashed.groupBy("sha256").agg(F.min(key).alias("first_key"))
    return hashed.join(firsts, "sha256").select(key, "sha256", (F.col(key) != F.col("first_key")).alias("duplicate"))


def statistics(results: DataFrame) -> DataFrame:
    return results.groupBy("target").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("kept").alias("kept"),
        F.count_if("duplicate").alias("duplicates"),
        F.count_if(F.col("method") == "SKIPPED_DANGEROUS").alias("skipped"),
        F.lit(0).cast("long").alias("failed"),
    )


def json_discoveries(bodies: DataFrame) -> DataFrame:
    """target, url, kind, source of the links in JSON bodies (target, body)."""
    rows = bodies.select("target", F.explode(jsonwalk.json_urls(F.col("body"))).alias("url"))
    return rows.select("target", "url", F.lit("api_path").alias("kind"), F.lit("json_walk").alias("source"))


def parameters(bodies: DataFrame) -> DataFrame:
    """Distinct parameter names in bodies."""
    return bodies.select(F.explode(jsonwalk.json_parameters("body")).alias("parameter")).distinct()


def read_saved(spark: SparkSession, folder: str, target: str | None = None) -> DataFrame:
    """target, file, body of the answers that a run has saved as response/*.txt under a folder; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/response")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "target string, file string, body string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path.toString())
    return found.select(F.lit(target).cast("string").alias("target"), F.col("path").alias("file"), F.col("content").cast("string").alias("body"))


def processed(saved: DataFrame, rules: rule_engine.RuleSet | None = None) -> tuple[DataFrame, DataFrame]:
    """Saved answers (target, file, body): rule hits, and the links of those that are JSON, whose referer is the file."""
    hits = rule_engine.apply(saved.select("target", "file", "body"), rules)
    links = saved.select("target", F.col("file").alias("referer"), F.explode(jsonwalk.json_urls(F.col("body"))).alias("url"))
    return hits, links.select("target", "url", F.lit("api_path").alias("kind"), "referer", F.lit("json_walk").alias("source"))

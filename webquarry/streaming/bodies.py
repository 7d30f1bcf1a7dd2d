"""Bodies as a stream of files: rules and extraction as they come, events appended as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.operators import report, rules

BODIES = "target string, url string, status int, content_type string, body string"


def read(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(BODIES).option("maxFilesPerTrigger", max_files).parquet(path)


def hit_events(bodies: DataFrame, rule_set: rules.RuleSet | None = None) -> DataFrame:
    """Events of rule hits; stateless, so a stream of any length needs no state."""
    hits = rules.apply(bodies.select("target", F.col("url").alias("file"), "body"), rule_set)
    return report.events(hits, "rule_hit", report.HIT)


def append(events: DataFrame, path: str, checkpoint: str):
    """A query that appends events as lines; each body once, by the checkpoint."""
    lines = events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "true"}).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

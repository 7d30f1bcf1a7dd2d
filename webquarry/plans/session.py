"""Settings of a run: capacity tiers, configuration, and the state of stages, whose outputs are kept as tables."""

from __future__ import annotations

import json
import os
import tempfile
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webquarry.functions import urls

# Name, CPUs, GiB, crawl workers, fetch workers, probe workers, requests a second and host, targets at once.
TIERS = (
    ("tiny", 1, 1, 16, 16, 32, 3, 1),
    ("small", 2, 2, 32, 32, 64, 5, 2),
    ("small-fat", 2, 4, 48, 48, 96, 5, 2),
    ("medium", 4, 4, 64, 64, 128, 8, 4),
    ("medium-fat", 4, 8, 96, 96, 192, 10, 4),
    ("big", 8, 8, 128, 128, 256, 15, 8),
    ("big-fat", 8, 16, 192, 192, 384, 20, 8),
    ("huge", 16, 16, 256, 256, 512, 25, 16),
    ("huge-fat", 16, 32, 384, 384, 768, 30, 16),
)
STAGES = ("wellknown", "homepage", "crawl", "probe", "ancestor_recurse", "postprocess")
STATE_SCHEMA = "1"


def tier_table(spark: SparkSession) -> DataFrame:
    rows = [(k, n, c, g << 30, *rest) for k, (n, c, g, *rest) in enumerate(TIERS)]
    return spark.createDataFrame(rows, "place int, tier string, min_cpu int, min_ram long, workers int, fetch_workers int, probe_workers int, qps int, targets int")


def pick_tiers(hosts: DataFrame, tiers: DataFrame) -> DataFrame:
    """Columns of hosts (cpu, ram in bytes, 0: unknown) with the last tier whose needs are met; the first if none is. tiers has nine rows."""
    first = F.lit(TIERS[0][0])
    fits = (F.col("cpu") >= F.col("min_cpu")) & ((F.col("ram") == 0) | (F.col("ram") >= F.col("min_ram")))
    best = hosts.join(F.broadcast(tiers), fits, "left").groupBy(*hosts.columns).agg(F.max_by("tier", "place").alias("tier"))
    return best.withColumn("tier", F.coalesce("tier", first))


@dataclass
class Config:
    """What a run is told; defaults are fixed values."""

    targets: list[str] = field(default_factory=list)
    rules_path: str = ""
    max_depth: int = 3
    ancestor_depth: int = 2
    fanout: str = "action-aware"
    body_cap: int = 16 << 20
    formats: tuple[str, ...] = ("jsonl",)
    no_probe: bool = False
    collect_only: bool = False
    skip_wellknown: bool = False
    #: Home pages: "on" takes captured requests, "off" the scripts that pages name, "auto" captured ones where a target has any.
    chrome: str = "auto"
    resume: bool = True

    def stages(self) -> list[str]:
        out = [s for s in STAGES if not (self.skip_wellknown and s == "wellknown")]
        if self.collect_only or self.no_probe:
            out = [s for s in out if s not in ("probe", "ancestor_recurse")]
        return [s for s in out if s != "postprocess"] if self.collect_only else out


class State:
    """Stages done for a target and their outputs: a small JSON file, and a Parquet table for each stage, which a resumed run reads instead of computing it.

    With a session, the file is in the file system of the folder, where the tables are (on a cluster the driver's disk is another one).
    """

    def __init__(self, folder: str, target: str, spark: SparkSession | None = None):
        self.folder, self.spark, self.path = folder, spark, Path(folder) / "state.json"
        self.data = {"schema": STATE_SCHEMA, "target": target, "started_at": time.time(), "stages_done": {}, "stats": {}}
        self.loaded, self.corrupt = False, ""
        text = self.read()
        if text is not None:
            try:
                found = json.loads(text)
            except ValueError as e:
                self.corrupt = str(e)
                return
            if found.get("target") not in (None, "", target):
                raise ValueError(f"state of another target: {found['target']!r}, not {target!r}")
            self.data, self.loaded = self.data | found, True

    def place(self, name: str):
        """A file of the folder, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> str | None:
        if self.spark is None:
            return self.path.read_text() if self.path.exists() else None
        path, files = self.place("state.json")
        if not files.exists(path):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(path.toString()).collect())

    def is_done(self, stage: str) -> bool:
        return bool(self.data["stages_done"].get(stage))

    def save(self) -> None:
        """In one move, so that a run that is stopped leaves the old file or the new one."""
        self.data["updated_at"] = time.time()
        text = json.dumps(self.data)
        if self.spark is None:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            handle, name = tempfile.mkstemp(dir=self.path.parent)
            with os.fdopen(handle, "w") as f:
                f.write(text)
            os.replace(name, self.path)
            return
        new, files = self.place("state.json.new")
        out = files.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        old, _ = self.place("state.json")
        files.delete(old, False)
        files.rename(new, old)

    def done(self, stage: str, **stats: int) -> None:
        self.data["stages_done"][stage] = True
        self.data["stats"] |= stats
        self.save()

    def finish(self) -> None:
        self.data["finished_at"] = time.time()
        self.save()

    def table(self, spark: SparkSession, stage: str, compute) -> DataFrame:
        """Output of a stage, computed and kept if it isn't done."""
        where = f"{self.folder}/stage-{stage}"
        if not self.is_done(stage):
            compute().write.mode("overwrite").parquet(where)
            self.done(stage)
        return spark.read.parquet(where)

    def keep_seen(self, found: DataFrame) -> None:
        """The URLs (target, url) that a run has seen, as a table beside the stages."""
        if not self.is_done("seen"):
            found.distinct().write.mode("overwrite").parquet(f"{self.folder}/seen")
            self.done("seen")

    def seen(self, spark: SparkSession) -> DataFrame:
        if not self.is_done("seen"):
            return spark.createDataFrame([], "target string, url string")
        return spark.read.parquet(f"{self.folder}/seen")

    def unseen(self, spark: SparkSession, found: DataFrame) -> DataFrame:
        """Rows of found (target, url, ...) that no run before has seen."""
        return found.join(self.seen(spark), ["target", "url"], "left_anti")


def paced(plan: DataFrame, qps: float) -> DataFrame:
    """plan (target, url, ...) with due_ms: when each request of a host may go out at qps a second, in order of target and url.

    Hosts are put in order by themselves, hashes of the url as buckets, so that a host with most of the plan is not one task.
    """
    host = urls.hostname(F.col("url"))
    rows = plan.withColumns({"_host": host, "_bucket": F.pmod(F.xxhash64("target", "url"), F.lit(1024))})
    sums = rows.groupBy("_host", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_host").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_host", "_bucket").orderBy("target", "url")) - 1
    rows = rows.withColumn("_at", inside).join(sums.select("_host", "_bucket", before.alias("_before")), ["_host", "_bucket"])
    return rows.withColumn("due_ms", F.floor((F.col("_before") + F.col("_at")) * (1000.0 / qps)).cast("long")).drop("_host", "_bucket", "_at", "_before")


def retried(status, failed):
    """Whether an answer calls for another attempt."""
    return failed | (status >= 500) | (status == 429)

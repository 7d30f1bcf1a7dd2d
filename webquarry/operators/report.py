"""Events of a run as one typed table, its summary, the consumers' questions, and what is written."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "1.0"
KINDS = ("base_url", "no_js", "js", "static_url", "api_path", "frontend_route")
text, number, flag = T.StringType(), T.LongType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DISCOVERED = struct(target=text, url=text, referer=text, kind=text, depth=T.IntegerType(), source=text, method=text)
API_PATH = struct(target=text, referer=text, api_path=text, pattern=text, method=text)
PROBE = struct(target=text, url=text, method=text, status_code=T.IntegerType(), content_type=text, size=number, body_path=text, referer=text, parameter=text, body_sha256=text, kept=flag, duplicate=flag, source=text)
HIT = struct(target=text, kind=text, rule_id=text, group=text, matches=T.ArrayType(text), url=text, file=text)
SUMMARY = struct(duration_ms=number, urls_discovered=number, js_fetched=number, api_paths=number, probes=number, rule_hits=number)
EVENT = struct(schema=text, time=T.TimestampType(), target=text, event=text, discovered_url=DISCOVERED, api_path=API_PATH, probe=PROBE, rule_hit=HIT, stage=text, summary=SUMMARY)


def payload(rows: DataFrame, kind: T.StructType):
    """A struct of the kind from columns of rows; what is missing, empty, 0 or false where it may be left out is null."""
    always = {"target", "url", "kind", "api_path", "method", "status_code", "size", "kept", "rule_id", "matches"}
    fields = []
    for f in kind.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if f.name not in always or (f.name == "method" and "status_code" not in kind.names):
            if isinstance(f.dataType, T.StringType):
                c = F.nullif(c, F.lit(""))
            elif isinstance(f.dataType, T.BooleanType):
                c = F.when(c, c)
            elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
                c = F.when(c != 0, c)
        fields.append(c.alias(f.name))
    return F.struct(*fields)


def events(rows: DataFrame, event: str, kind: T.StructType, time=None, name: str | None = None) -> DataFrame:
    """Rows as events with one payload, all other payloads null."""
    columns = [F.lit(SCHEMA).alias("schema"), (time if time is not None else F.current_timestamp()).alias("time"), F.col("target").cast("string").alias("target"), F.lit(event).alias("event")]
    for f in EVENT.fields[4:]:
        columns.append(payload(rows, kind).alias(f.name) if f.name == (name or event) else F.lit(None).cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def report(discovered: DataFrame, probes: DataFrame | None = None, hits: DataFrame | None = None, time=None) -> DataFrame:
    """All events. API paths and routes are events of their own beside their discovered_url."""
    out = events(discovered, "discovered_url", DISCOVERED, time)
    apis = discovered.filter("kind = 'api_path' and source in ('crawl', 'sourcemap')").withColumns({"api_path": F.col("url"), "pattern": F.col("source")})
    out = out.unionByName(events(apis, "api_path", API_PATH, time))
    out = out.unionByName(events(discovered.filter("kind = 'frontend_route'"), "frontend_route", DISCOVERED, time, "discovered_url"))
    for rows, event, kind in ((probes, "probe", PROBE), (hits, "rule_hit", HIT)):
        if rows is not None:
            out = out.unionByName(events(rows, event, kind, time))
    return out


def summary(report: DataFrame) -> DataFrame:
    """target and counters: one aggregation of the events. Links from JSON bodies are not counted as discovered."""
    url = (F.col("event") == "discovered_url") & (F.coalesce("discovered_url.source", F.lit("")) != "json_walk")
    return report.groupBy("target").agg(
        F.count_if(url).alias("urls_discovered"),
        F.count_if(url & (F.col("discovered_url.kind") == "js")).alias("js_fetched"),
        F.count_if(F.col("event") == "api_path").alias("api_paths"),
        F.count_if(F.col("event") == "probe").alias("probes"),
        F.count_if(F.col("event") == "rule_hit").alias("rule_hits"),
    )


def finished(report: DataFrame, targets: DataFrame, stages, time=None) -> DataFrame:
    """report with a stage event for each target and stage, and a summary event with the counts of each target."""
    each = targets.select("target").distinct()
    begun = each.select("target", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    marks = begun.select(F.lit(SCHEMA).alias("schema"), (time if time is not None else F.current_timestamp()).alias("time"), "target", F.lit("stage").alias("event"), "stage")
    counts = each.join(summary(report), "target", "left").na.fill(0)
    ends = events(counts, "summary", SUMMARY, time)
    return report.unionByName(marks, allowMissingColumns=True).unionByName(ends)


def write_all(report: DataFrame, *sinks) -> None:
    """The report to several sinks (functions of a report); it is computed once. All sinks are tried, then the first failure is raised."""
    report = report.persist()
    failed = []
    try:
        for sink in sinks:
            try:
                sink(report)
            except Exception as e:  # the other sinks must not miss it
                failed.append(e)
    finally:
        report.unpersist()
    if failed:
        raise failed[0]


def kept_urls(report: DataFrame) -> DataFrame:
    return report.filter("event = 'probe' and probe.kept").select("probe.target", "probe.url")


def scripts(report: DataFrame) -> DataFrame:
    return report.filter("event = 'discovered_url' and discovered_url.kind = 'js'").select("target", "discovered_url.url")


def json_answers(report: DataFrame) -> DataFrame:
    return report.filter("event = 'probe' and probe.status_code = 200 and lower(probe.content_type) like '%json%'").select("probe.target", "probe.url", "probe.size")


def hits_by_kind(report: DataFrame) -> DataFrame:
    return report.filter("event = 'rule_hit'").groupBy("rule_hit.kind").agg(F.count(F.lit(1)).alias("hits"))


def sensitive_matches(report: DataFrame) -> DataFrame:
    return report.filter("event = 'rule_hit' and rule_hit.kind = 'sensitive'").select("target", "rule_hit.rule_id", F.explode("rule_hit.matches").alias("match"))


def targets_by_rule(report: DataFrame) -> DataFrame:
    return report.filter("event = 'rule_hit'").groupBy("rule_hit.rule_id").agg(F.count_distinct("target").alias("targets"), F.count(F.lit(1)).alias("hits"))


#: Most signs of a cell.
CELL = 32_760


def cell(value):
    return F.left(F.regexp_replace(value.cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), F.lit(CELL))


def joined(matches):
    return F.array_join(matches, " | ")


# Names of sheets, in order.
SHEETS = (
    "首页自动加载的所有URL列表", "首页自动加载的JS_URL列表", "首页自动加载的属于目标的非JS_URL列表", "所有存活的js", "所有存活的静态url",
    "API接口列表", "前端路由 (Vue Router)", "探测响应", "hae检测结果", "敏感信息检测结果",
)


def sheets(report: DataFrame) -> dict[str, DataFrame]:
    """The ten sheets of a workbook as tables."""
    found = report.filter("event = 'discovered_url'").select("target", "discovered_url.url", "discovered_url.kind", "discovered_url.referer", "discovered_url.source", "discovered_url.depth")
    home = F.col("source").isin("homepage", "chromedp")
    hits = report.filter("event = 'rule_hit'").select("target", "rule_hit.rule_id", "rule_hit.kind", "rule_hit.group", joined(F.col("rule_hit.matches")).alias("matches"), "rule_hit.file", "rule_hit.url")
    tables = (
        found,
        found.filter(home & (F.col("kind") == "js")),
        found.filter(home & F.col("kind").isin("no_js", "base_url")),
        found.filter("kind = 'js'"),
        found.filter("kind = 'static_url'"),
        report.filter("event = 'api_path'").select("target", "api_path.api_path", "api_path.method", "api_path.referer", "api_path.pattern"),
        report.filter("event = 'frontend_route'").select("target", F.col("discovered_url.url").alias("path"), "discovered_url.source", "discovered_url.referer"),
        report.filter("event = 'probe' and probe.kept").select("target", "probe.url", "probe.method", "probe.status_code", "probe.content_type", "probe.size", "probe.body_path", "probe.body_sha256", "probe.duplicate", "probe.source"),
        hits.filter("kind != 'sensitive'"),
        hits.filter("kind = 'sensitive'"),
    )
    return {name: table.select(*[cell(F.col(c)).alias(c) for c in table.columns]) for name, table in zip(SHEETS, tables)}


def write_jsonl(report: DataFrame, path: str, by_target: bool = False) -> None:
    """One object a line, absent fields left out; by target in folders of their own, or all together."""
    lines = report.select("target", F.to_json(F.struct(*report.columns), {"ignoreNullFields": "true"}).alias("value"))
    if by_target:
        from webquarry.functions import urls

        lines.select(urls.folder(F.col("target")).alias("folder"), "value").write.mode("append").partitionBy("folder").text(path)
    else:
        lines.select("value").write.mode("append").text(path)


def csv_tables(report: DataFrame) -> dict[str, DataFrame]:
    probes = report.filter("event = 'probe' and probe.kept").select(
        F.coalesce("probe.target", "target").alias("Target"), F.col("probe.url").alias("URL"), F.col("probe.method").alias("Method"), F.col("probe.status_code").alias("Status"),
        F.col("probe.content_type").alias("Content-Type"), F.col("probe.size").alias("Size"), F.col("probe.body_path").alias("Body Path"), F.col("probe.body_sha256").alias("SHA256"), F.col("probe.source").alias("Source"),
    )
    h = F.col("rule_hit")
    hits = report.filter("event = 'rule_hit'")
    first = [F.coalesce(h["target"], F.col("target")).alias("Target"), h["rule_id"].alias("Rule ID")]
    last = [h["group"].alias("Group"), joined(h["matches"]).alias("Matches"), h["file"].alias("File"), h["url"].alias("URL")]
    return {"probes": probes, "fingerprints": hits.filter(h["kind"] != "sensitive").select(*first, h["kind"].alias("Kind"), *last), "sensitive": hits.filter(h["kind"] == "sensitive").select(*first, *last)}


def write_csv(report: DataFrame, path: str) -> None:
    for name, table in csv_tables(report).items():
        table.write.mode("append").option("header", True).csv(f"{path}/{name}")


def write_xlsx(report: DataFrame, path: str, max_rows: int = 1_048_575) -> None:
    """A workbook of the ten sheets on the driver, streamed row by row; a report with a sheet that a workbook can't hold is refused before."""
    report = report.persist()
    names = sheets(report)
    for name, table in names.items():
        if table.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"more than {max_rows} rows for the sheet {name}; write CSV instead")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        parts = range(1, len(names) + 1)
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in parts)
        out.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        out.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in parts) + "</Relationships>")
        out.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(parts, names)) + "</sheets></workbook>")
        for k, table in zip(parts, names.values()):
            with out.open(f"xl/worksheets/sheet{k}.xml", "w") as sheet:
                write = lambda s, sheet=sheet: sheet.write(s.encode())
                line = lambda values: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for v in values) + "</row>"
                write(f'{head}<worksheet xmlns="{main}"><sheetData>' + line(table.columns))
                for row in table.toLocalIterator():
                    write(line(row))
                write("</sheetData></worksheet>")
    report.unpersist()

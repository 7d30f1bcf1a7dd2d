"""URLs, documents, plans, responses, reports, state."""

import json
import zipfile

import os

import pytest
from pyspark.sql import functions as F

from webquarry import cli
from webquarry.functions import jsonwalk, urls
from webquarry.operators import crawl, report, responses, rules
from webquarry.plans import probes, session
from webquarry.sources import targets, wellknown
from webquarry.streaming import bodies as stream


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, base",
    [("https://api.example.co.uk/x", "example"), ("http://10.0.0.1:80/", "10.0.0.1"), ("http://localhost/", "localhost"), ("", ""), ("https://a.b.shop.com", "shop")],
)
def test_base_domain(spark, url, base):
    assert one(spark, url, urls.base_domain) == base


def test_base_domain_by_a_public_suffix_list(spark):
    want = {
        "a.github.io": "a", "www.x.co.ke": "x", "co.ke": "co.ke", "www.ck": "www", "q.www.ck": "www", "a.b.ck": "a", "b.ck": "b.ck", "city.kawasaki.jp": "city",
        "z.x.y.kawasaki.jp": "x", "x.elb.amazonaws.com.cn": "x.elb.amazonaws.com.cn", "y.x.elb.amazonaws.com.cn": "y", "t.example.com": "example", "nosuchending": "nosuchending",
        "a.nosuchending": "a", "a..com": "a..com", "com": "com", "shop.xn--55qx5d.cn": "shop",
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    base = urls.base_domain(F.concat(F.lit("https://"), "host", F.lit("/x")), urls.public_suffixes(spark))
    assert {r["host"]: r["base"] for r in hosts.select("host", base.alias("base")).collect()} == want


def test_public_suffixes_of_a_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("// a list\n\nlocal.test comment\n*.deep.test\n!my.deep.test\n")
    found = urls.public_suffixes(spark, str(tmp_path / "list.txt"))
    assert set(found) == {"local.test", "*.deep.test", "!my.deep.test"}
    got = [one(spark, f"http://{h}/", lambda u: urls.base_domain(u, found)) for h in ("a.local.test", "a.b.deep.test", "a.my.deep.test", "a.b.test")]
    assert got == ["a", "a", "my", "b"]


GROUPS = r"""
rules:
- group: Maybe Vulnerability
  rule:
  - {name: Java Deserialization, loaded: true, f_regex: 'rO0AB', s_regex: 'x', sensitive: false}
  - {name: 'Two  Names_of.it/', loaded: false, f_regex: 'two', sensitive: true}
- group: Some Group
  rule:
  - {name: One, loaded: true, f_regex: '(one)'}
  - {name: one, loaded: true, f_regex: '(one)+'}
  - {name: Bad, loaded: true, f_regex: '(?=x)'}
  - {name: None, loaded: true, f_regex: ''}
  - {name: '!!', loaded: true, f_regex: 'x'}
"""


def test_rules_of_a_file_of_groups(spark, tmp_path):
    found, notes = rules.from_groups(GROUPS)
    assert [(r.id, r.kind, r.enabled) for r in found] == [("vuln-java-deserialization", "vuln", True), ("vuln-two-names-of-it", "sensitive", False), ("some-group-one", "fingerprint", True), ("some-group-one-2", "fingerprint", True)]
    assert len(notes) == 4 and rules.from_groups("") == ([], [])
    own = [rules.Rule("java_deserialization", "vuln", "z", "other"), rules.Rule("sec-two-names-of-it", "vuln", "z", "p"), rules.Rule("q", "vuln", "z", " (one) "), rules.Rule("stays", "vuln", "A", "s"), rules.Rule("", "vuln", "A", "s")]
    assert [r.id for r in rules.merged(found, own)] == ["stays", "vuln-java-deserialization", "vuln-two-names-of-it", "some-group-one", "some-group-one-2"]
    (tmp_path / "groups.yaml").write_text(GROUPS)
    (tmp_path / "own.yaml").write_text(rules.to_yaml(own[:4]))
    assert cli.main(["convert", str(tmp_path / "groups.yaml"), str(tmp_path / "new.yaml"), "--rules", str(tmp_path / "own.yaml")]) == 0
    assert [r.id for r in rules.load(str(tmp_path / "new.yaml")).rules] == ["stays", "vuln-java-deserialization", "some-group-one", "some-group-one-2"]


def test_url_parts_that_strict_parsers_refuse(spark):
    assert one(spark, "http://h/{id}?q=1#f", urls.path) == "/{id}"
    assert one(spark, "http://u:p@h:81/a%20b", urls.hostname) == "h"
    assert one(spark, "http://h/a%20b", urls.path) == "/a b"
    assert one(spark, "http://h//a//b?c//d", urls.single_slashes) == "http://h/a/b?c/d"
    assert one(spark, "https://h/a/b/c?x#y", lambda u: urls.ancestors(u, 5)) == ["https://h/a/b/", "https://h/a/"]
    assert one(spark, "https://h/a", lambda u: urls.ancestors(u, 5)) == []


def test_robots_wildcards(spark):
    body = "Disallow: /a/*/b$\nAllow: //\n# x\nDisallow: /p?q\nSITEMAP: map.xml"
    rows = wellknown.robots(spark.createDataFrame([("https://t.net/", body)], "target string, body string")).collect()
    assert {(r["url"], r["kind"]) for r in rows} == {("https://t.net/a/b", "static_url"), ("https://t.net/map.xml", "sitemap")}


def test_json_walks():
    assert jsonwalk.links_of('{"a":[{"HREF":"/x"},{"url":3},{"path":"data:x"},{"link":"a/b"}]}') == ["/x", "a/b"]
    assert jsonwalk.links_of("no") == []
    assert jsonwalk.parameters_of('{"top":1,"data":{"id":1,"param":"p1"},"msg":"\'name\' parameter missing"}') == ["id", "param", "p1", "name", "missing"]
    deep = "[" * 5000 + "]" * 5000
    assert jsonwalk.links_of(deep) == []


def test_fanout_and_bodies(spark):
    def methods(url, declared, strategy):
        row = spark.createDataFrame([(url, declared)], "u string, m array<string>").select(probes.methods_for(F.col("u"), F.col("m"), F.lit(strategy)).alias("x")).first()
        return row["x"]

    assert methods("https://delete.net/list", None, "") == ["GET"]
    assert methods("https://h/saveUser", None, "") == ["GET", "POST_JSON"]
    assert methods("https://h/saveUser", ["POST", "TRACE", "POST"], "all") == ["POST_JSON"]
    assert methods("https://h/x", ["TRACE"], "all") == ["GET", "POST_FORM", "POST_JSON"]
    got = spark.range(1).select(probes.body_for(F.lit("POST_FORM"), F.array(F.lit("a"), F.lit("b"))).alias("f"), probes.body_for(F.lit("POST_JSON"), F.array().cast("array<string>")).alias("j")).first()
    assert (got["f"], got["j"]) == ("a=&b=", "{}")


def permuted(spark, paths, pages, single=False):
    t = targets.parsed(spark.createDataFrame([("https://www.shop.net/",)], "target string"))
    d = spark.createDataFrame([("https://www.shop.net/", p, "no_js") for p in pages], "target string, url string, kind string")
    p = spark.createDataFrame([("https://www.shop.net/", a, m, k) for k, (a, m) in enumerate(paths)], "target string, path string, method string, place long")
    return {r["url"]: list(r["methods"]) for r in probes.permuted(t, d, p, single).collect()}


def test_permutation(spark):
    got = permuted(spark, [("/api/user/list", "GET"), ("order/add", None)], ["https://www.shop.net/app/home", "https://evil.com/x"])
    assert got == {"https://www.shop.net/api/user/list": ["GET"], "https://www.shop.net/api/order/add": []}
    assert permuted(spark, [("/user/list", None)], ["https://www.shop.net/app"]) == {}
    assert permuted(spark, [("/user/list", None)], ["https://www.shop.net/app"], True) == {"https://www.shop.net/user/list": [], "https://www.shop.net/api/user/list": []}


def test_permutation_hint_of_three_origins(spark):
    got = permuted(spark, [("/a/api/x/y", "GET"), ("/b/api/x/y", "PUT"), ("/c/api/x/y", "HEAD")], ["https://www.shop.net/home"])
    assert {tuple(m) for m in got.values()} == {("HEAD",)}


def test_responses_keep_first_of_equal_bodies(spark):
    plan = spark.createDataFrame([("t", f"u{k}", "GET", None, "crawl") for k in range(4)] + [("t", "u9", "SKIPPED_DANGEROUS", None, "crawl")], "target string, url string, method string, body string, source string")
    rows = [("t", "u0", "GET", 200, "text/JSON", "{}"), ("t", "u1", "GET", 200, "application/json", "{}"), ("t", "u2", "GET", 200, "application/json", '{"status":404}'), ("t", "u3", "GET", 500, "application/json", "x")]
    got = {r["url"]: r for r in responses.probed(plan, spark.createDataFrame(rows, "target string, url string, method string, status_code int, content_type string, response string")).collect()}
    assert [got[f"u{k}"]["kept"] for k in range(4)] == [True, True, False, False]
    assert (got["u0"]["duplicate"], got["u1"]["duplicate"], got["u1"]["body_path"]) == (False, True, "")
    assert got["u9"]["method"] == "SKIPPED_DANGEROUS"


def test_levels_have_least_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    got = {r["node"]: r["depth"] for r in crawl.levels(edges, spark.createDataFrame([(1,)], "node int"), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def test_rules_loading(tmp_path, monkeypatch, capsys):
    assert rules.embedded().count() == {"sensitive": 53, "fingerprint": 14, "vuln": 5}
    own = tmp_path / "own.yaml"
    own.write_text("rules:\n- {id: a, kind: vuln, pattern: 'x+'}\n- {id: b, pattern: '(?=x)'}\n- {id: c, pattern: y, enabled: false}\n")
    found = rules.load(str(own))
    assert ([r.id for r in found.rules], set(found.errors)) == (["a"], {"b"})
    user = tmp_path / "u" / "rules.yaml"
    assert len(rules.load("", user).rules) == 72 and user.exists()
    user.write_text(": [")
    assert rules.load("", user).source.startswith("embedded(user-fallback")
    assert cli.main(["validate", "--rules", str(own)]) == 1
    to = tmp_path / "dump.yaml"
    assert cli.main(["dump", str(to)]) == 0 and cli.main(["dump", str(to)]) == 1 and cli.main(["dump", "--force", str(to)]) == 0
    assert len(rules.load(str(to)).rules) == 72
    with pytest.raises(OSError):
        rules.load(str(tmp_path / "none.yaml"))


def test_rule_hits(spark):
    body = 'Authorization: eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc mail a@b.org and a@b.org'
    got = {r["rule_id"]: list(r["matches"]) for r in rules.apply(spark.createDataFrame([("f", body), ("n", None)], "file string, body string")).collect()}
    assert "fp-json-web-token" in got and got["info-email"] == ["a@b.org"]


def sample_report(spark):
    found = spark.createDataFrame([("https://t.net", "/api/x", "api_path", "crawl", 1, "GET"), ("https://t.net", "a.js", "js", "homepage", 0, None)], "target string, url string, kind string, source string, depth int, method string")
    hits = spark.createDataFrame([("https://t.net", "sensitive", "r1", "g", ["a", "b"], "f.txt")], "target string, kind string, rule_id string, group string, matches array<string>, file string")
    return report.report(found, None, hits)


def test_report_and_sinks(spark, tmp_path):
    events = sample_report(spark).cache()
    assert {r["event"]: r["count"] for r in events.groupBy("event").count().collect()} == {"discovered_url": 2, "api_path": 1, "rule_hit": 1}
    s = report.summary(events).first()
    assert (s["urls_discovered"], s["js_fetched"], s["api_paths"], s["rule_hits"]) == (2, 1, 1, 1)
    report.write_jsonl(events, str(tmp_path / "lines"), True)
    lines = [json.loads(line) for f in (tmp_path / "lines").rglob("part-*") for line in f.read_text().splitlines()]
    hit = next(x for x in lines if x["event"] == "rule_hit")
    assert hit["rule_hit"]["matches"] == ["a", "b"] and "probe" not in hit
    report.write_csv(events, str(tmp_path / "csv"))
    assert "a | b" in "".join(f.read_text() for f in (tmp_path / "csv" / "sensitive").glob("part-*"))
    report.write_xlsx(events, str(tmp_path / "r.xlsx"))
    with zipfile.ZipFile(tmp_path / "r.xlsx") as book:
        assert len([n for n in book.namelist() if n.startswith("xl/worksheets/")]) == 10
        assert "a | b" in book.read("xl/worksheets/sheet10.xml").decode()


def test_state(spark, tmp_path):
    state = session.State(str(tmp_path / "s"), "https://t")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert state.table(spark, "crawl", compute).count() == 3
    again = session.State(str(tmp_path / "s"), "https://t")
    assert again.loaded and again.is_done("crawl") and again.table(spark, "crawl", compute).count() == 3 and len(calls) == 1
    with pytest.raises(ValueError):
        session.State(str(tmp_path / "s"), "https://other")
    (tmp_path / "s" / "state.json").write_text("{")
    assert session.State(str(tmp_path / "s"), "https://t").corrupt


def test_stages():
    assert "probe" not in session.Config(collect_only=True).stages()
    assert session.Config(skip_wellknown=True).stages()[0] == "homepage"


def test_stream(spark, tmp_path):
    rows = [("https://t", "u1", 200, "text/html", "mail a@b.org"), ("https://t", "u2", 200, "text/html", "none")]
    spark.createDataFrame(rows, stream.BODIES).write.parquet(str(tmp_path / "in"))
    query = stream.append(stream.hit_events(stream.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x["rule_hit"]["rule_id"] for x in lines] == ["info-email"]


def test_media_types_are_literals(spark):
    from webquarry.functions import candidates

    rows = spark.createDataFrame([("/text/x-user/list",), ("/a/text/x-java/b",), ("/api/text/html",)], "raw string")
    assert [r[0] for r in rows.select(candidates.api(F.col("raw"))).collect()] == ["/text/x-user/list", None, None]


def test_bodies_with_the_signs_of_the_scan_are_scanned(spark):
    from webquarry.operators import extract

    body = 'a="/js/x.js";b="/js/y.js"'
    alternatives = dict(extract.tiers())["js"]
    rows = spark.createDataFrame([(body,), (body + extract.BEGIN + extract.PART,)], "body string").select(extract.scan(F.col("body"), alternatives, 2).alias("m")).collect()
    assert rows[0]["m"] == rows[1]["m"] and [(x["raw"], x["which"], x["place"]) for x in rows[0]["m"]] == [('="/js/x.js', 3, 0), ('="/js/y.js', 3, 1)]


def test_a_mark_over_4_mib_is_found(spark):
    from webquarry.operators import extract

    body = "x" * (5 << 20) + ' get("/api/v1/far/away") ' + "y" * 100
    got = extract.extract(spark.createDataFrame([(1, body)], "id int, body string"), ["id"]).collect()
    assert ("api", "/api/v1/far/away") in {(r["kind"], r["value"]) for r in got}


def test_scan_is_resumed(spark, tmp_path):
    from webquarry.plans import queries, session

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    one = queries.whole_scan(spark, folder, folder=str(tmp_path / "run"), time=F.lit("2024-01-01").cast("timestamp"))
    first = one.run().drop("time").toJSON().collect()
    again = queries.whole_scan(spark, folder, folder=str(tmp_path / "run"), time=F.lit("2024-01-01").cast("timestamp"))
    second = again.run().drop("time").toJSON().collect()
    assert one.ran and not again.ran and sorted(first) == sorted(second)
    state = session.State(str(tmp_path / "run"), "all", spark)
    assert state.loaded and state.seen(spark).count() > 0
    assert state.unseen(spark, state.seen(spark).limit(3).unionByName(spark.createDataFrame([("t", "new")], "target string, url string"))).count() == 1
    only = queries.whole_scan(spark, folder, config=session.Config(collect_only=True)).run()
    assert {r[0] for r in only.select("event").distinct().collect()} == {"discovered_url", "api_path", "stage", "summary"}


def test_saved_answers_are_read_and_processed(spark, tmp_path):
    from webquarry.operators import responses

    assert responses.read_saved(spark, str(tmp_path)).count() == 0
    (tmp_path / "response").mkdir()
    (tmp_path / "response" / "GET_a.txt").write_text(' {"url": "/next/page", "mail": "a@b.net"}')
    (tmp_path / "response" / "GET_b.txt").write_text("plain")
    (tmp_path / "response" / "GET_c.log").write_text('{"url": "/no"}')
    hits, links = responses.processed(responses.read_saved(spark, str(tmp_path), "https://t/"))
    assert [(r["url"], r["source"], r["referer"].rsplit("/", 1)[1]) for r in links.collect()] == [("/next/page", "json_walk", "GET_a.txt")]
    assert "info-email" in {r["rule_id"] for r in hits.collect()}


def test_all_sinks_are_tried(spark):
    from webquarry.operators import report

    got = []

    def fails(r):
        raise OSError("full")

    with pytest.raises(OSError):
        report.write_all(spark.range(3), fails, lambda r: got.append(r.count()))
    assert got == [3]


def test_requests_of_a_host_are_paced(spark):
    from webquarry.plans import session

    plan = spark.createDataFrame([("t", f"https://h{k % 2}.net/{k}") for k in range(40)], "target string, url string")
    due = sorted(r["due_ms"] for r in session.paced(plan, 5).collect())
    assert due == sorted(x for k in range(20) for x in (200 * k, 200 * k))

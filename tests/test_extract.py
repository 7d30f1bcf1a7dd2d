import pytest

from webquarry.operators.extract import extract, groups_in


def found(spark, body):
    rows = extract(spark.createDataFrame([(1, body)], "id int, body string"), ["id"]).collect()
    return {(r["kind"], r["value"], r["method"]) for r in rows}


def test_paths_and_decoys(spark):
    got = found(spark, 'get("/api/v1/users");x="btn-primary";t="a.b.c.d";m="application/json";i="/img/logo.png";')
    assert ("api", "/api/v1/users", None) in got
    assert not {v for _, v, _ in got} & {"btn-primary", "a.b.c.d", "application/json", "/img/logo.png"}


def test_base_url_and_methods(spark):
    got = found(spark, 'axios.create({headers:{a:1},baseURL:"/svc/"});r({url:"/auth/login",data:{b:2},method:"post"});r({method:"PUT",url:"/svc/set"})')
    assert ("api", "/svc/auth/login", "POST") in got
    assert ("api", "/svc/set", "PUT") in got


def test_later_pair_wins(spark):
    got = found(spark, 'r({method:"get",url:"/a/one"});r({url:"/a/one",x:1,method:"delete"})')
    assert {m for k, v, m in got if (k, v) == ("api", "/a/one")} == {"GET"}  # verb before path is read after path before verb


def test_routes_are_not_prefixed(spark):
    got = found(spark, 'axios.create({baseURL:"/api"});r=[{path:"/leave",component:A},{component:B,path:"sub/one"},{path:":id",component:C}]')
    assert ("frontend_route", "/leave", None) in got
    assert ("frontend_route", "/sub/one", None) in got
    assert not any(v == "/api/leave" for k, v, _ in got if k == "api")


def test_chunks_and_scripts(spark):
    got = found(spark, 'function j(t){return e.p+"static/js/"+{"a":"b"}[t]+"."+{"home":"h1","x":"h2"}[t]+".js"};u="/lib/app.js";n="/_nuxt/entry.mjs"')
    assert ("js", "/static/js/home.h1.js", None) in got
    assert ("js", "/lib/app.js", None) in got
    assert ("js", "/_nuxt/entry.mjs", None) in got


@pytest.mark.parametrize("body", ["", None, "no candidates here", "x" * 100_000])
def test_nothing(spark, body):
    assert found(spark, body) == set()


def test_groups():
    assert groups_in(r"(a)(?:b)[(](?P<n>c)\(") == 2

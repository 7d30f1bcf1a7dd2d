"""Queries over the tables of a folder, each with the SQL that gives the same rows.

The tables hold no scripts, so bodies are put together from their columns by SQL that both engines read (`@name`
stands for a table). Every query reads its tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import candidates, jsonwalk, urls, values
from webquarry.operators import crawl, extract, report, responses, rules
from webquarry.plans import probes, samples, scan, session
from webquarry.sources import targets, wellknown

#: A table in SQL that both engines read.
TABLE = re.compile(r"@(region|nation|customer|supplier|part|orders|lineitem|events|documents|pages)\b")
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = TABLE.sub(r"\1", oracle)
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = sorted(set(TABLE.findall(sql)))
    frames = {f"t_{n}": table(spark, sf_dir, n) for n in names}
    return spark.sql(TABLE.sub(r"{t_\1}", sql.replace("{", "{{").replace("}", "}}")), **frames)


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2_any(words) -> str:
    return sql_text("|".join(re.sub(r"([^0-9A-Za-z_\x80-\U0010ffff])", r"\\\1", w) for w in words))


# ---- rules ------------------------------------------------------------------------------------------------


def rules_sql(table_name: str, key: str, column: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT {key}, {sql_text(i)} AS rule_id, {sql_text(k)} AS kind, {sql_text(g)} AS \"group\", list_sort(list_filter(list_distinct(regexp_extract_all({column}, {sql_text(p)})), lambda m: m <> '')) AS found FROM {table_name}"
        for i, k, g, p in values.RULES
    )
    return f"SELECT {key}, rule_id, kind, \"group\", len(found)::BIGINT AS n, array_to_string(found, chr(10)) AS matches FROM ({each}) WHERE len(found) > 0"


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan, dealt to all cores where its files make fewer splits than there are; large inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def hits(spark, sf_dir, name, key, column) -> DataFrame:
    return rules.apply(spread(table(spark, sf_dir, name).select(key, F.col(column).alias("body"))))


def shown(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, "rule_id", "kind", "group", F.size("matches").cast("long").alias("n"), F.array_join(F.array_sort("matches"), "\n").alias("matches"))


query("rules_documents", rules_sql("documents", "doc_id", "text"))(lambda s, d: shown(hits(s, d, "documents", "doc_id", "text"), "doc_id"))
query("rules_pages", rules_sql("pages", "page_id", "html"))(lambda s, d: shown(hits(s, d, "pages", "page_id", "html"), "page_id"))
query("rules_page_urls", rules_sql("pages", "page_id", "url"))(lambda s, d: shown(hits(s, d, "pages", "page_id", "url"), "page_id"))


@query("rules_by_kind", f"SELECT kind, count(*)::BIGINT AS hits FROM ({rules_sql('documents', 'doc_id', 'text')} UNION ALL {rules_sql('pages', 'page_id', 'html')}) GROUP BY kind")
def rules_by_kind(spark, sf_dir):
    both = hits(spark, sf_dir, "documents", "doc_id", "text").select("kind").unionAll(hits(spark, sf_dir, "pages", "page_id", "html").select("kind"))
    return rules.hits_by_kind(both)


@query("rule_count", "SELECT * FROM (VALUES ('sensitive', 53::BIGINT), ('fingerprint', 14::BIGINT), ('vuln', 5::BIGINT)) t(kind, n)")
def rule_count(spark, sf_dir):
    return rules.rule_table(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("rule_groups", "SELECT DISTINCT p_type AS name, lower(p_type) AS slug, lower(p_type) AS prefix, 'fingerprint' AS kind FROM part")
def rule_groups(spark, sf_dir):
    name = F.col("p_type")
    return table(spark, sf_dir, "part").select(name.alias("name"), rules.slug(name).alias("slug"), rules.group_prefix(name).alias("prefix"), rules.inferred_kind(name, F.lit(False)).alias("kind")).distinct()


def texts_sql(texts) -> str:
    """id, place, body: each sample for each nation, by SQL that both engines read."""
    # Signs that stand for others here: an at sign would name a table, a backslash means more to one engine than to the other.
    rows = " UNION ALL ".join(f"SELECT {k} AS place, {sql_text(t.replace('@@', '§').replace('@', '¤'))} AS form" for k, t in enumerate(texts))
    return f"SELECT n_nationkey * 1000 + place AS id, place, replace(replace(replace(form, '§', lower(replace(n_name, '_', ''))), '~', chr(92)), '¤', chr(64)) AS body FROM @nation, ({rows}) f"


RULE_BODIES = texts_sql([t for _, t in samples.RULE_TEXTS])


@query("rules_samples", f"WITH b AS MATERIALIZED ({RULE_BODIES}) " + rules_sql("b", "id", "body"))
def rules_samples(spark, sf_dir):
    """Hits and near misses of each rule."""
    return shown(rules.apply(spread(made(spark, sf_dir, RULE_BODIES).select("id", "body"))), "id")


@query("rules_sampled", "SELECT rule_id, n_nations FROM (VALUES " + ", ".join(f"({sql_text(i)}, 25::BIGINT)" for i, _ in samples.RULE_TEXTS if i) + ") t(rule_id, n_nations)")
def rules_sampled(spark, sf_dir):
    """In how many nations' samples a rule hits the text that is made for it: all, for each rule."""
    made_for = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(samples.RULE_TEXTS) if i], "place int, made_for string")
    found = rules.apply(spread(made(spark, sf_dir, RULE_BODIES))).join(F.broadcast(made_for), "place").filter("rule_id = made_for")
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_nations"))


# ---- bodies of scripts ------------------------------------------------------------------------------------

SCRIPTS = """
SELECT n_nationkey AS id, 'https://app.t' || CAST(n_nationkey AS STRING) || '.net' AS target,
  'https://app.t' || CAST(n_nationkey AS STRING) || '.net/static/app.js' AS url,
  'var r=axios.create({headers:{a:1},baseURL:"/api/v' || CAST(n_regionkey AS STRING) || '"});'
  || 'r({url:"/nation' || CAST(n_nationkey AS STRING) || '/list",headers:{b:2},method:"get"});'
  || 'r({method:"delete",url:"/nation/' || CAST(n_nationkey AS STRING) || '/item"});'
  || 'var t=[{path:"/view/n' || CAST(n_nationkey AS STRING) || '",component:V},{component:S,path:"sub' || CAST(n_nationkey AS STRING) || '"},{path:"*",component:N}];'
  || 'function c(t){return e.p+"static/js/"+({}[t]||t)+"."+{"chunk' || CAST(n_nationkey AS STRING) || '":"h' || CAST(n_regionkey AS STRING) || '","b":"c1"}[t]+".js"}' AS body
FROM @nation
"""


@query("base_url", f"SELECT id, regexp_extract(body, {sql_text(values.BASE_URL[0])}, 1) AS base FROM ({SCRIPTS})")
def base_url(spark, sf_dir):
    return made(spark, sf_dir, SCRIPTS).select("id", extract.base_url(F.col("body")).alias("base"))


def pairs_sql(p, path, verb):
    return f"SELECT id, unnest(regexp_extract_all(body, {sql_text(p)}, {path})) AS path, upper(unnest(regexp_extract_all(body, {sql_text(p)}, {verb}))) AS method FROM ({SCRIPTS})"


@query("method_pairs", f"SELECT DISTINCT id, path, method FROM ({pairs_sql(values.METHOD_AFTER, 1, 2)} UNION ALL {pairs_sql(values.METHOD_BEFORE, 2, 1)}) WHERE method IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS')")
def method_pairs(spark, sf_dir):
    return made(spark, sf_dir, SCRIPTS).select("id", F.explode(extract.method_pairs(F.col("body"))).alias("p")).select("id", "p.path", "p.method")


@query("routes", f"""SELECT DISTINCT id, route FROM (SELECT id, trim(coalesce(nullif(unnest(regexp_extract_all(body, {sql_text(values.ROUTE)}, 1)), ''), unnest(regexp_extract_all(body, {sql_text(values.ROUTE)}, 2)))) AS route FROM ({SCRIPTS}))
WHERE route NOT IN ('', '/', '*') AND route NOT LIKE ':%'""")
def routes(spark, sf_dir):
    return made(spark, sf_dir, SCRIPTS).select("id", F.explode(extract.routes(F.col("body"))).alias("route"))


@query("chunk_urls", f"""SELECT id, '/' || regexp_extract(body, {sql_text(values.WEBPACK)}, 1) || unnest(regexp_extract_all(m, '"([^"]*)":"([^"]*)"', 1)) || '.' || unnest(regexp_extract_all(m, '"([^"]*)":"([^"]*)"', 2)) || '.js' AS url
FROM (SELECT id, body, regexp_extract(body, {sql_text(values.WEBPACK)}, 2) AS m FROM ({SCRIPTS}))""")
def chunk_urls(spark, sf_dir):
    return made(spark, sf_dir, SCRIPTS).select("id", F.explode(extract.chunk_urls(F.col("body"))).alias("url"))


#: What the scripts above hold, by the semantics of the extractor.
FOUND = """
SELECT id, kind, value, method FROM (
  SELECT n_nationkey AS id, 'api' AS kind, '/api/v' || n_regionkey || '/nation' || n_nationkey || '/list' AS value, 'GET' AS method FROM nation
  UNION ALL SELECT n_nationkey, 'api', '/api/v' || n_regionkey || '/nation/' || n_nationkey || '/item', 'DELETE' FROM nation
  UNION ALL SELECT n_nationkey, 'api', '/api/v' || n_regionkey, NULL FROM nation
  UNION ALL SELECT n_nationkey, 'api', '/api/v' || n_regionkey || '/static/js', NULL FROM nation WHERE FALSE
  UNION ALL SELECT n_nationkey, 'static', '/api/v' || n_regionkey, NULL FROM nation
  UNION ALL SELECT n_nationkey, 'static', '/nation' || n_nationkey || '/list', NULL FROM nation
  UNION ALL SELECT n_nationkey, 'static', '/nation/' || n_nationkey || '/item', NULL FROM nation
  UNION ALL SELECT n_nationkey, 'static', '/view/n' || n_nationkey, NULL FROM nation
  UNION ALL SELECT n_nationkey, 'frontend_route', '/view/n' || n_nationkey, NULL FROM nation
  UNION ALL SELECT n_nationkey, 'frontend_route', '/sub' || n_nationkey, NULL FROM nation
  UNION ALL SELECT n_nationkey, 'js', '/static/js/chunk' || n_nationkey || '.h' || n_regionkey || '.js', NULL FROM nation
  UNION ALL SELECT n_nationkey, 'js', '/static/js/b.c1.js', NULL FROM nation)
"""


@query("extract_scripts", FOUND)
def extract_scripts(spark, sf_dir):
    return extract.extract(made(spark, sf_dir, SCRIPTS), ["id"]).select("id", "kind", "value", "method")


def tier_sql(patterns, kind: str) -> str:
    union = sql_text("|".join(f"({p})" for p in patterns))
    groups = [f"regexp_extract_all(html, {union}, {k + 1})" for k in range(len(patterns))]
    chosen = "CASE " + " ".join(f"WHEN coalesce(g{k}, '') <> '' THEN '{kind}_{k}'" for k in range(len(patterns))) + " END"
    value = "coalesce(" + ", ".join(f"nullif(g{k}, '')" for k in range(len(patterns))) + ")"
    return f"SELECT page_id, {chosen} AS pattern, {value} AS raw FROM (SELECT page_id, {', '.join(f'unnest({g}) AS g{k}' for k, g in enumerate(groups))} FROM pages)"


@query("scan_static", f"SELECT page_id, pattern, raw, count(*)::BIGINT AS n FROM ({tier_sql(values.STATIC_PATTERNS, 'static')}) GROUP BY ALL")
def scan_static(spark, sf_dir):
    alternatives = dict(extract.tiers())["static"]
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(extract.scan(F.col("html"), alternatives, 3)).alias("m"))
    return rows.groupBy("page_id", F.concat(F.lit("static_"), F.col("m.which").cast("string")).alias("pattern"), F.col("m.raw").alias("raw")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_js", f"SELECT page_id, pattern, raw, count(*)::BIGINT AS n FROM ({tier_sql(values.JS_PATTERNS, 'js').replace('html,', 'body,').replace('FROM pages', 'FROM (SELECT page_id, url || chr(34) || chr(47) || page_id || chr(46) || chr(106) || chr(115) || chr(34) || html AS body FROM pages)')}) GROUP BY ALL")
def scan_js(spark, sf_dir):
    alternatives = dict(extract.tiers())["js"]
    body = F.concat("url", F.lit('"/'), F.col("page_id").cast("string"), F.lit('.js"'), "html")
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(extract.scan(body, alternatives, 2)).alias("m"))
    return rows.groupBy("page_id", F.concat(F.lit("js_"), F.col("m.which").cast("string")).alias("pattern"), F.col("m.raw").alias("raw")).agg(F.count(F.lit(1)).alias("n"))


# ---- candidate filters ------------------------------------------------------------------------------------

RAW = r"""
SELECT DISTINCT replace(form, '@@', link) AS raw FROM
  (SELECT url AS link FROM @pages UNION ALL SELECT '/' || p_name FROM @part UNION ALL SELECT '/' || lower(p_type) || '/' || CAST(p_partkey AS STRING) FROM @part) a,
  (SELECT '@@' AS form UNION ALL SELECT '"@@/list"' UNION ALL SELECT '/static@@.js' UNION ALL SELECT '="./lib@@.mjs?v=1"' UNION ALL SELECT chr(92) || '/v1@@%2Fitems' UNION ALL SELECT 'text/x-java@@'
   UNION ALL SELECT '$@@' UNION ALL SELECT 'a.b.c' UNION ALL SELECT '__webpack_x' UNION ALL SELECT 'btn-primary' UNION ALL SELECT '@@.PNG' UNION ALL SELECT 'https://api.t.net:8443@@?q=1'
   UNION ALL SELECT 'href=@@' UNION ALL SELECT '/a/b/c/d/e/f/g/h/i@@' UNION ALL SELECT '/1/2/3' UNION ALL SELECT '''@@/docs/''') b
"""
BLACK = re2_any(values.DOMAIN_BLACKLIST)
UNESCAPE = "ltrim(rtrim(replace(replace(replace({}, '%3A', ':'), '%2F', '/'), '\\\\', ''), '\\'), '=')"
PLAIN = r"replace(replace(replace(replace(replace(raw, '\/', '/'), ' ', ''), chr(34), ''), chr(39), ''), './', '/')"
JS_SQL = f"SELECT raw, s AS value FROM (SELECT raw, {UNESCAPE.format(PLAIN)} AS s FROM ({RAW})) WHERE s <> '' AND NOT regexp_matches(s, {BLACK})"
STRIP = "rtrim(trim(trim({}), chr(34) || chr(39)), '/')"


@query("js_filter", JS_SQL)
def js_filter(spark, sf_dir):
    return made(spark, sf_dir, RAW).select("raw", candidates.script(F.col("raw")).alias("value")).filter("value is not null")


STATIC_SQL = f"SELECT raw, s AS value FROM (SELECT raw, {STRIP.format('raw')} AS s FROM ({RAW})) WHERE octet_length(encode(s)) >= 3 AND NOT regexp_matches(s, '\\.[mc]?js$') AND NOT regexp_matches(lower(s), {re2_any(values.STATIC_FILE_PARTS)}) AND NOT regexp_matches(s, {BLACK})"


@query("static_filter", STATIC_SQL)
def static_filter(spark, sf_dir):
    return made(spark, sf_dir, RAW).select("raw", candidates.static(F.col("raw")).alias("value")).filter("value is not null")


API_SQL = f"""
WITH a AS (SELECT raw, replace(replace(replace(replace(raw, ' ', ''), '\\/', '/'), chr(34), ''), chr(39), '') AS s FROM ({RAW})
  WHERE raw <> '' AND NOT regexp_matches(raw, {re2_any(values.MEDIA_TYPES)})
    AND NOT regexp_matches(ltrim(trim(raw, chr(34) || chr(39)), '/'), '^(' || {re2_any(values.API_ROOTS)} || ')')),
b AS (SELECT raw, regexp_replace({UNESCAPE.format('s')}, '^href=', '') AS s FROM a),
c AS (SELECT raw, s, CASE WHEN contains(s, '://') THEN regexp_extract(s, '^(?:([a-zA-Z][a-zA-Z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 3) || regexp_extract(s, '^[^?#]*(\\?[^#]+)?', 1) ELSE s END AS path FROM b
  WHERE s NOT IN ('', 'href') AND NOT regexp_matches(s, {re2_any(values.URL_SUBSTRINGS)}) AND NOT regexp_matches(lower(regexp_replace(s, '\\?.*$', '')), '(' || {re2_any(values.API_FILE_ENDS)} || ')$')),
e AS (SELECT raw, path, regexp_replace(path, '\\?.*$', '') AS bare FROM c WHERE path <> ''
  AND NOT (octet_length(encode(path)) < 30 AND regexp_matches(path, '^[a-z][a-z0-9-]*$')) AND NOT regexp_matches(path, '^[A-Za-z]+(\\.[A-Za-z]+){{2,}}$')
  AND NOT contains(path, '__webpack_') AND NOT (regexp_matches(path, '^_+[A-Za-z0-9]*$') AND octet_length(encode(path)) >= 2)),
f AS (SELECT *, string_split(trim(bare, '/'), '/') AS segments FROM e WHERE bare <> '')
SELECT raw, path AS value FROM f WHERE len(segments) <= 8 AND len(list_filter(segments, lambda x: octet_length(encode(x)) > 80)) = 0
  AND len(list_filter(segments, lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 2)) > 0
"""


@query("api_filter", API_SQL)
def api_filter(spark, sf_dir):
    return made(spark, sf_dir, RAW).select("raw", candidates.api(F.col("raw")).alias("value")).filter("value is not null")


# ---- extraction of whole pages ----------------------------------------------------------------------------


#: Where the value groups of the alternatives are in each tier's alternation, counted from the patterns.
VALUE_GROUPS = {"extra": (2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28), "js": (1, 2, 3, 4), "static": (1, 2, 3), "api": (1, 2, 3, 4, 6, 8, 10, 11, 12, 14)}


def matches_sql(tier: str, alternatives, source: str, key: str, body: str) -> str:
    """key, tier, kind, slash, pattern, place, bare: what an alternation takes from bodies, as `extract.scan` reads it."""
    union = sql_text("|".join(f"({p})" for _, _, p, _, _ in alternatives))
    columns = [f"unnest(regexp_extract_all({body}, {union}, {g})) AS g{k}" for k, g in enumerate(VALUE_GROUPS[tier])]
    columns.append(f"unnest(range(len(regexp_extract_all({body}, {union})))) AS place")
    values_ = [f"nullif(g{k}, '')" for k in range(len(alternatives))]
    pick = lambda c: "CASE " + " ".join(f"WHEN coalesce(g{k}, '') <> '' THEN {sql_text(a[c]) if c < 4 else a[c]}" for k, a in enumerate(alternatives)) + " END"
    raw = f"coalesce({', '.join(values_)})"
    return f"SELECT {key}, '{tier}' AS tier, {pick(1)} AS kind, {pick(4)} AS slash, {pick(0)} AS pattern, place, {STRIP.format(raw)} AS bare FROM (SELECT {key}, {', '.join(columns)} FROM {source})"


def extracted_sql(source: str, key: str, body: str) -> str:
    """key, kind, value, pattern of bodies without declared bases, verbs, routes and chunk maps."""
    return f"""WITH m AS ({' UNION ALL '.join(matches_sql(t, a, source, key, body) for t, a in extract.tiers())}),
v AS (SELECT DISTINCT 'extra' AS tier, slash, bare, CASE WHEN slash AND NOT starts_with(bare, '/') AND NOT contains(bare, '://') THEN '/' || bare ELSE bare END AS value FROM m WHERE tier = 'extra' AND bare <> ''
UNION ALL SELECT 'js', FALSE, raw, value FROM ({JS_SQL.replace(f'({RAW})', "(SELECT DISTINCT bare AS raw FROM m WHERE tier = 'js')")})
UNION ALL SELECT 'static', FALSE, raw, value FROM ({STATIC_SQL.replace(f'({RAW})', "(SELECT DISTINCT bare AS raw FROM m WHERE tier = 'static')")})
UNION ALL SELECT 'api', FALSE, raw, value FROM ({API_SQL.replace(f'({RAW})', "(SELECT DISTINCT bare AS raw FROM m WHERE tier = 'api')")})),
t AS (SELECT *, CASE tier WHEN 'extra' THEN 1 WHEN 'js' THEN 2 WHEN 'static' THEN 3 ELSE 4 END AS tier_no FROM m JOIN v USING (tier, slash, bare)),
f AS (SELECT {key}, kind, value, pattern, tier_no AS ord, tier_no, place FROM t),
g AS (SELECT * FROM f UNION ALL SELECT {key}, 'js', value, pattern, 5, tier_no, place FROM f WHERE kind <> 'js' AND regexp_matches(value, '\\.[mc]?js$'))
SELECT {key}, kind, value, arg_min(pattern, ord * 1000000000000 + tier_no * 100000000000 + place) AS pattern FROM g GROUP BY {key}, kind, value"""


EXTRACT_BODIES = texts_sql(samples.EXTRACT_TEXTS)
EXTRACTED = f"SELECT page_id, kind, value FROM ({extracted_sql('pages', 'page_id', 'html')})"


@query("extract_samples", extracted_sql(f"({EXTRACT_BODIES})", "id", "body"))
def extract_samples(spark, sf_dir):
    """Each pattern of each tier, with its id, and what the filters refuse."""
    return extract.extract(made(spark, sf_dir, EXTRACT_BODIES).select("id", "body"), ["id"]).select("id", "kind", "value", "pattern")


BASES = texts_sql([t for t, _ in samples.BASE_TEXTS])


@query("base_url_list", "SELECT n_nationkey * 1000 + place AS id, replace(bases, '@@', lower(replace(n_name, '_', ''))) AS bases FROM nation, (VALUES " + ", ".join(f"({k}, {sql_text(b)})" for k, (_, b) in enumerate(samples.BASE_TEXTS)) + ") t(place, bases)")
def base_url_list(spark, sf_dir):
    return made(spark, sf_dir, BASES).select("id", F.array_join(extract.base_urls(F.col("body")), "|").alias("bases"))


MESSAGES = texts_sql([t for t, _ in samples.MESSAGE_TEXTS])


@query("parameter_messages", "SELECT n_nationkey * 1000 + place AS id, name FROM nation, (VALUES " + ", ".join(f"({k}, {sql_text(n)})" for k, (_, n) in enumerate(samples.MESSAGE_TEXTS)) + ") t(place, name) WHERE name <> ''")
def parameter_messages(spark, sf_dir):
    return made(spark, sf_dir, MESSAGES).select("id", F.explode(jsonwalk.json_parameters("body")).alias("name"))


@query("extract_pages", EXTRACTED)
def extract_pages(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body")))
    return extract.extract(pages, ["page_id"]).select("page_id", "kind", "value")


# ---- urls -------------------------------------------------------------------------------------------------

SPLIT = """SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '//([^/?#]*)', 1) AS host, regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path,
regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, coalesce(nullif(regexp_extract(url, '//[^/?#]*([^?#]*/)', 1), ''), '/') AS directory FROM pages"""


@query("url_split", SPLIT)
def url_split(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.hostname(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.origin(u).alias("origin"), urls.directory(u).alias("directory"))


@query("url_base", """SELECT page_id, list_extract(string_split(regexp_extract(url, '//([^/?#]*)', 1), '.'), -2) AS base, contains(regexp_extract(url, '//([^/?#]*)', 1), 'th') AS same,
left(regexp_replace(regexp_extract(url, '//([^/?#]*)', 1) || CASE WHEN regexp_extract(url, '//[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '' ELSE '_' || ltrim(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/') END, '[^a-zA-Z0-9._-]', '_', 'g'), 200) AS folder FROM pages""")
def url_base(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.base_domain(u).alias("base"), urls.same_site(u, F.lit("th")).alias("same"), urls.folder(u).alias("folder"))


#: Hosts under suffixes of one label and more, under a star, under an exception, and suffixes themselves.
SUFFIXED = """SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'www.n' || s_suppkey || '.co.uk' WHEN 1 THEN 'a.n' || s_suppkey || '.github.io' WHEN 2 THEN 'a.b.n' || s_suppkey || '.com.cn'
WHEN 3 THEN 'a.b.n' || s_suppkey || '.ck' WHEN 4 THEN 'n' || s_suppkey || '.www.ck' WHEN 5 THEN 'n' || s_suppkey || '.kawasaki.jp' WHEN 6 THEN '10.0.0.' || (s_suppkey % 200)
WHEN 7 THEN 'a.n' || s_suppkey || '.org' ELSE 'n' || s_suppkey END AS host FROM @supplier"""


@query("base_domains", f"""SELECT s_suppkey, host, CASE s_suppkey % 9 WHEN 3 THEN 'b' WHEN 4 THEN 'www' WHEN 5 THEN host WHEN 6 THEN host ELSE 'n' || s_suppkey END AS base FROM ({SUFFIXED})""")
def base_domains(spark, sf_dir):
    url = F.concat(F.lit("https://"), F.col("host"), F.lit("/x"))
    return made(spark, sf_dir, SUFFIXED).withColumn("base", urls.base_domain(url, urls.public_suffixes(spark)))


LINKS = "SELECT page_id, url, link FROM @pages, (SELECT '/a' AS link UNION ALL SELECT '//cdn.t.net/x.js' UNION ALL SELECT 'js/y.js' UNION ALL SELECT 'z.js' UNION ALL SELECT 'q/z.js' UNION ALL SELECT '/' UNION ALL SELECT 'https://t.net/') l"


@query("url_join", f"""SELECT page_id, link, CASE WHEN link IN ('', '/', '//') THEN '' WHEN regexp_matches(link, '^https?://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
WHEN starts_with(link, '/') THEN origin || link WHEN contains(link, '/') THEN origin || '/' || link ELSE origin || directory || link END AS joined FROM ({LINKS}) JOIN ({SPLIT}) USING (page_id)""")
def url_join(spark, sf_dir):
    u = F.col("url")
    return made(spark, sf_dir, LINKS).select("page_id", "link", urls.join(urls.scheme(u), urls.origin(u), urls.directory(u), F.col("link")).alias("joined"))


@query("url_ancestors", f"""SELECT page_id, unnest(list_transform(generate_series(1, least(2, len(s) - 1)), lambda k: origin || '/' || array_to_string(s[1:len(s) - k], '/') || '/')) AS parent
FROM (SELECT page_id, origin, list_filter(string_split(path || '/deep', '/'), lambda x: x <> '') AS s FROM ({SPLIT})) WHERE len(s) > 1""")
def url_ancestors(spark, sf_dir):
    deeper = F.concat(urls.origin(F.col("url")), urls.path(F.col("url")), F.lit("/deep?x=1#y"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(urls.ancestors(deeper, 2)).alias("parent"))


@query("url_kinds", f"SELECT page_id, CASE WHEN regexp_extract(path, '(\\.[^./]*)$', 1) = '' THEN 'no_js' WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) = '.js' THEN 'js' ELSE 'static' END AS kind FROM ({SPLIT})")
def url_kinds(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.kind_of_request(F.col("url")).alias("kind"))


# ---- targets and documents at well-known places ------------------------------------------------------------

LINES = "SELECT CASE WHEN page_id % 5 = 0 THEN '# ' || url WHEN page_id % 5 = 1 THEN '   ' WHEN page_id % 5 = 2 THEN '  ' || url || ' ' ELSE url END AS value FROM @pages"


@query("target_parse", f"SELECT trim(value) AS target, regexp_extract(value, '([a-z]+)://', 1) AS scheme, regexp_extract(value, '//([^/?#]*)', 1) AS host, '' AS port FROM ({LINES}) WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')")
def target_parse(spark, sf_dir):
    return targets.parsed(targets.target_lines(made(spark, sf_dir, LINES))).select("target", "scheme", "host", "port")


ANSWERS = """SELECT event_type || CAST(event_id AS STRING) AS url, CASE WHEN event_id % 3 = 0 THEN CAST(200 AS INT) END AS http_status,
CASE event_id % 6 WHEN 1 THEN 'dial tcp: Connection refused' WHEN 2 THEN 'lookup: no such host' WHEN 4 THEN 'TLS handshake timeout' ELSE 'tls: bad certificate' END AS error FROM @events"""


@query("liveness", f"SELECT url, http_status IS NOT NULL AS alive, CASE WHEN http_status IS NULL THEN CASE WHEN lower(error) LIKE '%connection refused%' THEN 'refused' WHEN lower(error) LIKE '%no such host%' THEN 'dns' WHEN lower(error) LIKE '%timeout%' THEN 'timeout' ELSE 'tls' END END AS reason FROM ({ANSWERS})")
def liveness(spark, sf_dir):
    return targets.liveness(made(spark, sf_dir, ANSWERS))


HOMES = "SELECT 'https://h' || CAST(n_nationkey AS STRING) || '.net/app/' AS target, '<html><script src=\"/js/' || lower(n_name) || '.js\"></script><SCRIPT async src=''lib/a.js''></SCRIPT></html>' AS body FROM @nation"


@query("homepage", f"""SELECT target, target AS url, 'base_url' AS kind FROM ({HOMES}) UNION ALL SELECT target, regexp_extract(target, '^(.*net)', 1) || '/js/' || regexp_extract(body, 'js/([a-z_0-9]*).js', 1) || '.js', 'js' FROM ({HOMES})
UNION ALL SELECT target, target || 'lib/a.js', 'js' FROM ({HOMES})""")
def homepage(spark, sf_dir):
    return targets.homepage(made(spark, sf_dir, HOMES)).select("target", "url", "kind")


ROBOTS = "SELECT 'https://r' || CAST(n_nationkey AS STRING) || '.net' AS target, 'User-agent: *' || chr(10) || 'Disallow: /api/' || lower(n_name) || '*$ # no' || chr(10) || 'Allow: static//' || lower(n_name) || chr(13) || chr(10) || 'Disallow: /x?y' || chr(10) || 'Sitemap: https://s.net/' || lower(n_name) AS body FROM @nation"


@query("robots", f"""SELECT target, target || '/api/' || n AS url, 'api_path' AS kind FROM (SELECT target, regexp_extract(body, 'api/([a-z_0-9]*)', 1) AS n FROM ({ROBOTS}))
UNION ALL SELECT target, target || '/static/' || regexp_extract(body, 'api/([a-z_0-9]*)', 1), 'static_url' FROM ({ROBOTS}) UNION ALL SELECT target, 'https://s.net/' || regexp_extract(body, 'api/([a-z_0-9]*)', 1), 'sitemap' FROM ({ROBOTS})""")
def robots(spark, sf_dir):
    return wellknown.robots(made(spark, sf_dir, ROBOTS)).select("target", "url", "kind")


MAPS = """SELECT 'https://m.net' AS target, 'https://m.net/' || CAST(n_nationkey AS STRING) || '.xml' AS url, n_nationkey > 0 AS nested,
CASE WHEN n_nationkey = 0 THEN '<sitemapindex><sitemap><loc>https://m.net/1.xml</loc></sitemap><sitemap><loc> https://m.net/2.xml </loc></sitemap></sitemapindex>'
ELSE '<urlset xmlns="x"><url><loc>https://m.net/p' || CAST(n_nationkey AS STRING) || '?a=1&amp;b=2</loc></url></urlset>' END AS body FROM @nation"""


@query("sitemaps", "SELECT 'https://m.net' AS target, 'https://m.net/p' || n || '?a=1&b=2' AS url FROM (VALUES (1), (2)) t(n)")
def sitemaps(spark, sf_dir):
    return wellknown.sitemaps(made(spark, sf_dir, MAPS)).select("target", "url")


APIS = """SELECT 'https://o' || CAST(n_nationkey AS STRING) || '.net' AS target, 'https://o' || CAST(n_nationkey AS STRING) || '.net/v2/swagger.json' AS url,
'{"paths":{"/n/' || CAST(n_nationkey AS STRING) || '":{"get":{},"post":{"x":1},"summary":"s"}},' || CASE WHEN n_nationkey % 3 = 0 THEN '"servers":[{"url":"https://srv.net/v1/"}]' WHEN n_nationkey % 3 = 1 THEN '"host":"h.net","basePath":"b/","schemes":["HTTP"]' ELSE '"x":1' END || '}' AS body FROM @nation"""


@query("openapi", f"""SELECT target, CASE WHEN contains(body, 'servers') THEN 'https://srv.net/v1' WHEN contains(body, 'basePath') THEN 'http://h.net/b' ELSE target END || regexp_extract(body, '"(/n/[0-9]+)"', 1) AS url, 'GET,POST' AS methods, 'swagger.json' AS source FROM ({APIS})""")
def openapi(spark, sf_dir):
    return wellknown.openapi(made(spark, sf_dir, APIS)).select("target", "url", F.array_join("methods", ",").alias("methods"), "source")


OPENID = "SELECT 'https://i' || CAST(s_suppkey AS STRING) || '.net' AS target, '{\"token_endpoint\":\"https://i/t' || CAST(s_suppkey AS STRING) || '\",\"jwks_uri\":\"\",\"userinfo_endpoint\":\"/u\",\"issuer\":\"no\"}' AS body FROM @supplier"


@query("openid", f"SELECT target, json_extract_string(body, '$.token_endpoint') AS url FROM ({OPENID}) UNION ALL SELECT target, '/u' FROM ({OPENID})")
def openid(spark, sf_dir):
    return wellknown.openid(made(spark, sf_dir, OPENID)).select("target", "url")


MAPPINGS = """SELECT 'https://a' || CAST(s_suppkey AS STRING) || '.net' AS target, '{"contexts":{"a":[{"patterns":["/m' || CAST(s_suppkey AS STRING) || '","no"]},{"predicate":"{GET [/p' || CAST(s_suppkey AS STRING) || '], produces}"},{"predicate":"( /q && x)"}]}}' AS body FROM @supplier"""


@query("service_mappings", f"SELECT target, target || '/m' || regexp_extract(body, '/m([0-9]+)', 1) AS url FROM ({MAPPINGS}) UNION ALL SELECT target, target || '/q' FROM ({MAPPINGS})")
def service_mappings(spark, sf_dir):
    return wellknown.mappings(made(spark, sf_dir, MAPPINGS)).select("target", "url")


SOURCE_MAPS = """SELECT n_nationkey AS id, '{"version":' || CASE WHEN n_nationkey % 4 = 0 THEN '2' ELSE '3' END || ',"sources":["a' || CAST(n_nationkey AS STRING) || '.ts","b.ts"],"sourcesContent":["x();",""],"sections":[{"map":{"sources":["s.ts"],"sourcesContent":["y();"]}}]}' AS body FROM @nation"""


@query("source_maps", f"SELECT id, 'a' || id || '.ts' AS path, 'x();' AS content FROM ({SOURCE_MAPS}) WHERE id % 4 <> 0 UNION ALL SELECT id, 's.ts', 'y();' FROM ({SOURCE_MAPS}) WHERE id % 4 <> 0")
def source_maps(spark, sf_dir):
    return wellknown.source_map(made(spark, sf_dir, SOURCE_MAPS), ["id"])


# ---- JSON -------------------------------------------------------------------------------------------------

DOCS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'not json' ELSE '{"code":0,"data":{"Href":"/orders/' || CAST(o_orderkey AS STRING) || '","list":[{"url":"https://t.net/' || CAST(o_custkey AS STRING) || '","name":"/no"},{"link":5,"path":"javascript:x"}]},"msg":"parameter ''key' || o_orderstatus || ''' missing"}' END AS body FROM @orders"""


@query("json_links", f"SELECT id, json_extract_string(body, '$.data.Href') AS url FROM ({DOCS}) WHERE id % 7 <> 0 UNION ALL SELECT id, json_extract_string(body, '$.data.list[0].url') FROM ({DOCS}) WHERE id % 7 <> 0")
def json_links(spark, sf_dir):
    return made(spark, sf_dir, DOCS).select("id", F.explode(jsonwalk.json_urls(F.col("body"))).alias("url"))


@query("parameters", "SELECT unnest(['Href', 'list', 'url', 'name', 'link', 'path']) AS parameter UNION SELECT 'key' || o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
def parameters(spark, sf_dir):
    return responses.parameters(made(spark, sf_dir, DOCS))


# ---- plans ------------------------------------------------------------------------------------------------

SITES = "SELECT DISTINCT 'https://s' || CAST(n_regionkey AS STRING) || '.shop.net:8443/' AS target FROM @nation"
PATHS = """SELECT 'https://s' || CAST(n_regionkey AS STRING) || '.shop.net:8443/' AS target, CASE n_nationkey % 4 WHEN 0 THEN '/api/v1/' || lower(n_name) WHEN 1 THEN 'user/' || lower(n_name) WHEN 2 THEN 'https://x.net/' || lower(n_name) ELSE '/deleteAll/' || CAST(n_nationkey AS STRING) END AS path,
CASE WHEN n_nationkey % 3 = 0 THEN 'POST' END AS method, n_nationkey AS place FROM @nation"""
SEEDS = "SELECT 'https://s' || CAST(n_regionkey AS STRING) || '.shop.net:8443/' AS target, 'https://s' || CAST(n_regionkey AS STRING) || '.shop.net:8443/app/api/v1/n' || CAST(n_nationkey AS STRING) AS url, CASE WHEN n_nationkey % 2 = 0 THEN 'no_js' ELSE 'js' END AS kind FROM @nation"
ENDPOINTS = "SELECT 'https://s' || CAST(n_regionkey AS STRING) || '.shop.net:8443/' AS target, '/api/v1/' || lower(n_name) AS path, array('GET', 'PUT') AS methods FROM @nation"
PLACED = "CASE WHEN regexp_matches(path, '^https?://') THEN path WHEN starts_with(path, '/') THEN rtrim(target, '/') || path ELSE target || path END"
PROBE_SQL = f"""SELECT target, url, array_to_string(list_sort(list_distinct(flatten(list(methods)))), ',') AS methods FROM (
SELECT target, {PLACED} AS url, CASE WHEN method IS NULL THEN []::VARCHAR[] ELSE [method] END AS methods FROM ({PATHS})
UNION ALL SELECT target, url, []::VARCHAR[] FROM ({SEEDS}) WHERE kind = 'no_js'
UNION ALL SELECT target, rtrim(target, '/') || path, ['GET', 'PUT'] FROM ({ENDPOINTS.replace("array('GET', 'PUT') AS methods", '1 AS one')})) GROUP BY target, url"""


def planned(spark, sf_dir) -> DataFrame:
    return probes.probe_targets(targets.parsed(made(spark, sf_dir, SITES)), made(spark, sf_dir, PATHS), made(spark, sf_dir, SEEDS), made(spark, sf_dir, ENDPOINTS))


@query("probe_targets", PROBE_SQL)
def probe_targets(spark, sf_dir):
    return planned(spark, sf_dir).select("target", "url", F.array_join(F.array_sort("methods"), ",").alias("methods"))


WORDS = "['" + "', '".join(probes.ACTION_WORDS) + "']"
REQUESTS_SQL = f"""SELECT target, url, method, CASE method WHEN 'POST_JSON' THEN 'POST' WHEN 'SKIPPED_DANGEROUS' THEN NULL ELSE method END AS http_verb, CASE WHEN method IN ('POST_JSON', 'PUT') THEN 'application/json' END AS content_type,
CASE method WHEN 'POST_JSON' THEN '{{"id":"","q":""}}' END AS body FROM (SELECT target, url, unnest(CASE WHEN regexp_matches(lower(url), {re2_any(values.DANGER)}) THEN ['SKIPPED_DANGEROUS']
WHEN methods <> '' THEN list_transform(string_split(methods, ','), lambda m: CASE m WHEN 'POST' THEN 'POST_JSON' ELSE m END)
WHEN list_has_any(list_transform(regexp_extract_all(regexp_extract(url, '//[^/]*([^?#]*)', 1), '[A-Z][a-z]*|[a-z]+|[0-9]+'), lambda t: lower(t)), {WORDS}) THEN ['GET', 'POST_JSON'] ELSE ['GET'] END) AS method FROM ({PROBE_SQL}))"""


@query("requests", REQUESTS_SQL)
def requests(spark, sf_dir):
    return probes.requests(planned(spark, sf_dir), parameters=["id", "q"])


@query("fanout", """SELECT strategy, url, CASE strategy WHEN 'all' THEN 'GET,POST_FORM,POST_JSON' WHEN 'conservative' THEN 'GET' ELSE CASE WHEN act THEN 'GET,POST_JSON' ELSE 'GET' END END AS methods
FROM (SELECT unnest(['all', 'conservative', 'action-aware']) AS strategy, 'https://create.net/v1/' || w || p_partkey AS url, w <> 'view' AS act FROM part, (VALUES ('view'), ('saveItem'), ('user_add')) t(w))""")
def fanout(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.lit(x) for x in ("view", "saveItem", "user_add")])).alias("w"), F.lit("all,conservative,action-aware").alias("s"))
    rows = rows.select(F.explode(F.split("s", ",")).alias("strategy"), F.concat(F.lit("https://create.net/v1/"), "w", F.col("p_partkey").cast("string")).alias("url"))
    return rows.select("strategy", "url", F.array_join(probes.methods_for(F.col("url"), F.lit(None).cast("array<string>"), F.col("strategy")), ",").alias("methods"))


@query("permutation", f"""WITH s AS (SELECT DISTINCT target FROM ({SEEDS}) WHERE kind = 'no_js'), b AS (SELECT target, unnest(['', '/app']) AS base FROM s),
p AS (SELECT target, '/app/api' AS prefix FROM s UNION SELECT target, '/api' FROM ({PATHS}) WHERE contains(path, 'api/')),
e AS (SELECT target, CASE WHEN starts_with(path, '/api/') THEN substring(path, 5) WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS ending, coalesce(method, '') AS methods FROM ({PATHS}) WHERE NOT starts_with(path, 'http'))
SELECT DISTINCT target, rtrim(target, '/') || base || prefix || ending AS url, methods, 'permutate' AS source FROM b JOIN p USING (target) JOIN e USING (target)""")
def permutation(spark, sf_dir):
    found = probes.permuted(targets.parsed(made(spark, sf_dir, SITES)), made(spark, sf_dir, SEEDS), made(spark, sf_dir, PATHS))
    return found.select("target", "url", F.array_join("methods", ",").alias("methods"), "source")


# ---- responses and events ---------------------------------------------------------------------------------

ANSWERED = """SELECT 'https://t' || CAST(user_id % 5 AS STRING) || '.net/' AS target, 'https://t' || CAST(user_id % 5 AS STRING) || '.net/a/b/' || CAST(event_id AS STRING) AS url, 'GET' AS method,
CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INT) AS status_code, CASE WHEN event_id % 4 = 0 THEN 'text/html' ELSE 'Application/JSON' END AS content_type,
CASE WHEN event_id % 9 = 0 THEN '{"status":404}' WHEN event_id % 10 = 0 THEN '' ELSE props END AS response, 'crawl' AS source FROM @events"""
PROBED_SQL = f"""SELECT target, url, status_code, kept, body_sha256, coalesce(body_sha256 IS NOT NULL AND row_number() OVER (PARTITION BY target, body_sha256 ORDER BY url, method) > 1, FALSE) AS duplicate FROM (
SELECT *, CASE WHEN kept AND response <> '' THEN sha256(response) END AS body_sha256 FROM (SELECT *, status_code = 200 AND lower(content_type) LIKE '%json%' AND NOT contains(response, '"status":404') AS kept FROM ({ANSWERED})))"""


def results(spark, sf_dir) -> DataFrame:
    answers = made(spark, sf_dir, ANSWERED)
    plan = answers.select("target", "url", "method", F.lit(None).cast("string").alias("body"), "source")
    return responses.probed(plan, answers.drop("source"))


@query("probed", PROBED_SQL)
def probed(spark, sf_dir):
    return results(spark, sf_dir).select("target", "url", "status_code", "kept", "body_sha256", "duplicate")


@query("probe_statistics", f"SELECT target, count(*)::BIGINT AS total, sum(kept::INT)::BIGINT AS kept, sum(duplicate::INT)::BIGINT AS duplicates, 0::BIGINT AS skipped, 0::BIGINT AS failed FROM ({PROBED_SQL}) GROUP BY target")
def probe_statistics(spark, sf_dir):
    return responses.statistics(results(spark, sf_dir))


@query("ancestor_plan", f"""SELECT DISTINCT target, u AS url FROM (SELECT target, unnest([rtrim(target, '/') || '/a/b/', rtrim(target, '/') || '/a/']) AS u FROM ({ANSWERED}) WHERE status_code = 200)""")
def ancestor_plan(spark, sf_dir):
    found = results(spark, sf_dir)
    return probes.ancestor_plan(found, found).select("target", "url")


@query("body_dedup", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, doc_id <> min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS duplicate FROM documents")
def body_dedup(spark, sf_dir):
    return responses.first_bodies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("black_text", f"SELECT doc_id, {' OR '.join(f'contains(body, {sql_text(t)})' for t in values.BLACK_TEXT)} AS noise FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN '\"code\":404' WHEN 1 THEN '未登录!' ELSE '\"msg\":\"未登录!\"' END AS body FROM documents)")
def black_text(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 3 == 0, '"code":404').when(F.col("doc_id") % 3 == 1, "未登录!").otherwise('"msg":"未登录!"')
    return table(spark, sf_dir, "documents").select("doc_id", rules.is_black_text(F.concat(F.coalesce("text", F.lit("")), tail)).alias("noise"))


EDGES = "SELECT o_custkey AS src, (o_orderkey * 7 + 3) % 500 AS dst FROM @orders"


@query("crawl_levels", f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({EDGES})), r(node, depth) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def crawl_levels(spark, sf_dir):
    edges = made(spark, sf_dir, EDGES).distinct()
    sources = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return crawl.levels(edges, sources, 3)


PAGES = """SELECT DISTINCT 'https://app.t.net/' AS target, 'https://app.t.net/s/' || CAST(n_nationkey AS STRING) || '.js' AS url, CAST(CASE WHEN n_nationkey % 5 = 4 THEN 404 ELSE 200 END AS INT) AS status,
'import "/s/' || CAST(n_nationkey * 2 + 1 AS STRING) || '.js";get("/api/n' || CAST(n_nationkey AS STRING) || '/get")' AS body FROM @nation"""


@query("crawl_scripts", f"""WITH RECURSIVE p AS (SELECT regexp_extract(url, '/s/([0-9]+)', 1)::INT AS n, status FROM ({PAGES})), r(n, depth) AS (SELECT 0, 0 UNION ALL SELECT r.n * 2 + 1, r.depth + 1 FROM r JOIN p USING (n) WHERE status = 200 AND r.depth < 2)
SELECT 'https://app.t.net/s/' || (n * 2 + 1) || '.js' AS url, 'js' AS kind, (depth + 1)::INT AS depth FROM r JOIN p USING (n) WHERE status = 200 UNION ALL SELECT '/api/n' || n || '/get', 'api_path', (depth + 1)::INT FROM r JOIN p USING (n) WHERE status = 200
UNION ALL SELECT 'https://app.t.net/api/n' || n || '/get', 'static_url', (depth + 1)::INT FROM r JOIN p USING (n) WHERE status = 200""")
def crawl_scripts(spark, sf_dir):
    bodies = made(spark, sf_dir, PAGES)
    seeds = bodies.filter("url like '%/s/0.js'").select("target", "url", F.lit("js").alias("kind"))
    return crawl.crawl(bodies, seeds).select("url", "kind", "depth")


def events(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    u = F.col("url")
    found = pages.select(urls.origin(u).alias("target"), "url", F.lit("").alias("referer"), urls.kind_of_request(u).alias("kind"), F.lit(0).alias("depth"), F.lit("chromedp").alias("source"), F.lit(None).cast("string").alias("method"))
    hit = rules.apply(spread(pages.select(urls.origin(u).alias("target"), u.alias("file"), F.col("html").alias("body"))))
    return report.report(found, results(spark, sf_dir), hit, F.lit("2024-01-01 00:00:00").cast("timestamp"))


PAGE_HITS = f"SELECT origin AS target, url AS file, h.* FROM ({rules_sql('pages', 'page_id', 'html')}) h JOIN pages USING (page_id) JOIN ({SPLIT}) USING (page_id)"


@query("event_counts", f"SELECT event, n FROM (SELECT 'discovered_url' AS event, count(*)::BIGINT AS n FROM pages UNION ALL SELECT 'probe', count(*)::BIGINT FROM events UNION ALL SELECT 'rule_hit', count(*)::BIGINT FROM ({PAGE_HITS})) WHERE n > 0")
def event_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("summary", f"""SELECT target, sum(u)::BIGINT AS urls_discovered, 0::BIGINT AS js_fetched, 0::BIGINT AS api_paths, sum(p)::BIGINT AS probes, sum(h)::BIGINT AS rule_hits FROM (
SELECT origin AS target, 1 AS u, 0 AS p, 0 AS h FROM ({SPLIT}) UNION ALL SELECT target, 0, 1, 0 FROM ({ANSWERED}) UNION ALL SELECT target, 0, 0, 1 FROM ({PAGE_HITS})) GROUP BY target""")
def summary(spark, sf_dir):
    return report.summary(events(spark, sf_dir))


@query("kept_urls", f"SELECT target, url FROM ({PROBED_SQL}) WHERE kept")
def kept_urls(spark, sf_dir):
    return report.kept_urls(events(spark, sf_dir))


@query("json_answers", f"SELECT target, url, octet_length(encode(response))::BIGINT AS size FROM ({ANSWERED}) WHERE status_code = 200 AND lower(content_type) LIKE '%json%'")
def json_answers(spark, sf_dir):
    return report.json_answers(events(spark, sf_dir))


@query("hits_by_kind", f"SELECT kind, count(*)::BIGINT AS hits FROM ({PAGE_HITS}) GROUP BY kind")
def hits_by_kind(spark, sf_dir):
    return report.hits_by_kind(events(spark, sf_dir))


@query("sensitive_matches", f"SELECT target, rule_id, unnest(string_split(matches, chr(10))) AS match FROM ({PAGE_HITS}) WHERE kind = 'sensitive'")
def sensitive_matches(spark, sf_dir):
    return report.sensitive_matches(events(spark, sf_dir))


@query("targets_by_rule", f"SELECT rule_id, count(DISTINCT target)::BIGINT AS targets, count(*)::BIGINT AS hits FROM ({PAGE_HITS}) GROUP BY rule_id")
def targets_by_rule(spark, sf_dir):
    return report.targets_by_rule(events(spark, sf_dir))


@query("sheet_rows", f"""SELECT sheet, n::BIGINT AS n FROM (SELECT unnest([{', '.join(sql_text(x) for x in report.SHEETS)}]) AS sheet, unnest([(SELECT count(*) FROM pages), 0, (SELECT count(*) FROM ({SPLIT}) WHERE NOT regexp_matches(path, '[.][^./]*$')), 0, 0, 0, 0,
(SELECT count(*) FROM ({PROBED_SQL}) WHERE kept), (SELECT count(*) FROM ({PAGE_HITS}) WHERE kind <> 'sensitive'), (SELECT count(*) FROM ({PAGE_HITS}) WHERE kind = 'sensitive')]) AS n)""")
def sheet_rows(spark, sf_dir):
    found = report.sheets(events(spark, sf_dir))
    rows = [t.agg(F.lit(n).alias("sheet"), F.count(F.lit(1)).alias("n")) for n, t in found.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("sheet_cells", f"""SELECT {sql_text(report.SHEETS[0])} AS sheet, concat_ws('|', origin, url, CASE WHEN regexp_extract(path, '(\\.[^./]*)$', 1) = '' THEN 'no_js' WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) = '.js' THEN 'js' ELSE 'static' END, 'chromedp') AS cells FROM pages JOIN ({SPLIT}) USING (page_id)
UNION ALL SELECT {sql_text(report.SHEETS[7])}, concat_ws('|', target, url, 'GET', '200', 'Application/JSON', octet_length(encode(response)), CASE WHEN body_sha256 IS NOT NULL AND NOT duplicate THEN regexp_replace(regexp_extract(target, '//([^/]*)', 1), '[^a-zA-Z0-9._-]', '_', 'g') || '/response/GET_' || regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') || '.txt' END, body_sha256, CASE WHEN duplicate THEN 'true' END, 'crawl')
FROM ({PROBED_SQL}) JOIN (SELECT target, url, response FROM ({ANSWERED})) USING (target, url) WHERE kept
UNION ALL SELECT CASE kind WHEN 'sensitive' THEN {sql_text(report.SHEETS[9])} ELSE {sql_text(report.SHEETS[8])} END, concat_ws('|', target, rule_id, kind, "group", array_to_string(list_sort(string_split(matches, chr(10))), ' | '), file) FROM ({PAGE_HITS})""")
def sheet_cells(spark, sf_dir):
    found = report.sheets(events(spark, sf_dir))
    rows = []
    for name in (report.SHEETS[0], report.SHEETS[7], report.SHEETS[8], report.SHEETS[9]):
        columns = [F.array_join(F.array_sort(F.split("matches", r" \| ")), " | ") if c == "matches" else F.col(c) for c in found[name].columns]
        rows.append(found[name].select(F.lit(name).alias("sheet"), F.concat_ws("|", *columns).alias("cells")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ---- a whole scan -----------------------------------------------------------------------------------------

# The script is found on the home page, and again when the crawl reads that page.
SCAN_TARGETS = "SELECT 'https://w' || CAST(n_nationkey AS STRING) || '.shop.net/' AS target FROM @nation"
SCAN_BODIES = """SELECT target, rtrim('/', target) || place AS url, CAST(200 AS INT) AS status, body FROM (SELECT 'https://w' || CAST(n_nationkey AS STRING) || '.shop.net/' AS target, n_nationkey AS n FROM @nation) t,
(SELECT '/' AS place, '<script src="/js/app.js"></script>' AS body, 1 AS every UNION ALL SELECT '/robots.txt', 'Disallow: /api/hidden' || chr(10) || 'Sitemap: /maps/s.xml', 1 UNION ALL SELECT '/.well-known/security.txt', 'Contact: x', 2
UNION ALL SELECT '/js/app.js', 'get("/api/v1/item/get")', 1 UNION ALL SELECT '/openapi.json', '{"paths":{"/api/v2/list":{"get":{}}}}', 5) b WHERE n % every = 0""".replace("rtrim('/', target)", "left(target, length(target) - 1)")
SCAN_ANSWERS = """SELECT 'https://w' || CAST(n_nationkey AS STRING) || '.shop.net/' AS target, 'https://w' || CAST(n_nationkey AS STRING) || '.shop.net/api/v1/item/get' AS url, 'GET' AS method, CAST(200 AS INT) AS status_code, 'application/json' AS content_type,
'{"data":{"url":"/deep/' || CAST(n_nationkey AS STRING) || '","mail":"a' || CAST(n_nationkey AS STRING) || chr(64) || 'b.net"}}' AS response FROM @nation
UNION ALL SELECT 'https://w' || CAST(n_nationkey AS STRING) || '.shop.net/', 'https://w' || CAST(n_nationkey AS STRING) || '.shop.net/api/v1/', 'GET', CAST(403 AS INT), 'text/html', 'no' FROM @nation"""
#: A hit row for each rule that the kept answer of a target has.
SCAN_HITS = f"SELECT count(*) FROM ({rules_sql(f'(SELECT * FROM ({SCAN_ANSWERS}) WHERE status_code = 200)', 'url', 'response')})"
SCAN_SQL = f"""SELECT event, kind, n::BIGINT AS n FROM (VALUES ('discovered_url', 'base_url', 25), ('discovered_url', 'js', 50), ('discovered_url', 'api_path', 75), ('discovered_url', 'static_url', 43), ('api_path', '', 25),
('probe', '', 50), ('stage', '', 150), ('summary', '', 25), ('rule_hit', '', ({SCAN_HITS}))) t(event, kind, n)"""


def whole_scan(spark, sf_dir, **options) -> scan.Scan:
    return scan.Scan(spark, made(spark, sf_dir, SCAN_TARGETS), made(spark, sf_dir, SCAN_BODIES), made(spark, sf_dir, SCAN_ANSWERS), **options)


def counted(found: DataFrame) -> DataFrame:
    return found.groupBy("event", F.coalesce(F.when(F.col("event") == "discovered_url", F.col("discovered_url.kind")), F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_events", SCAN_SQL)
def scan_events(spark, sf_dir):
    return counted(whole_scan(spark, sf_dir).run())


@query("scan_summary", f"SELECT 'https://w' || n_nationkey || '.shop.net/' AS target, (6 + CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS urls_discovered, 2::BIGINT AS js_fetched, 1::BIGINT AS api_paths, 2::BIGINT AS probes FROM nation")
def scan_summary(spark, sf_dir):
    found = whole_scan(spark, sf_dir).run().filter("event = 'summary'")
    return found.select("target", *[F.col(f"summary.{c}").alias(c) for c in ("urls_discovered", "js_fetched", "api_paths", "probes")])


@query("homepage_modes", f"""SELECT mode, count(*)::BIGINT AS n FROM (SELECT 'on' AS mode FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'off' FROM nation, range(3) UNION ALL SELECT 'auto' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'auto' FROM nation, range(3) WHERE n_nationkey % 2 = 1) GROUP BY mode""")
def homepage_modes(spark, sf_dir):
    homes = made(spark, sf_dir, HOMES)
    requests = made(spark, sf_dir, "SELECT 'https://h' || CAST(n_nationkey AS STRING) || '.net/app/' AS target, 'https://h.net/' || CAST(n_nationkey AS STRING) AS url FROM @nation WHERE n_nationkey % 2 = 0")
    out = None
    for mode in ("on", "off", "auto"):
        rows = targets.homepages(homes, requests, mode).groupBy(F.lit(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


HOSTS = "SELECT DISTINCT CAST(p_size % 20 AS INT) AS cpu, CAST(p_size % 5 AS BIGINT) * 8589934592 AS ram FROM @part"


@query("tiers", f"SELECT cpu, ram, coalesce((SELECT max_by(tier, place) FROM (VALUES {', '.join(f'({k}, {sql_text(t[0])}, {t[1]}, {t[2] << 30})' for k, t in enumerate(session.TIERS))}) t(place, tier, c, r) WHERE cpu >= c AND (ram = 0 OR ram >= r)), 'tiny') AS tier FROM ({HOSTS})")
def tiers(spark, sf_dir):
    return session.pick_tiers(made(spark, sf_dir, HOSTS), session.tier_table(spark))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_by_kind(spark, sf_dir)


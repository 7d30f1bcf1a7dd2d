"""Main text of web pages by a site style tree.

Pages of a host are merged into one tree, whose nodes are the paths of elements (tag, class, id and role). For each node the table
has in how many pages it is, which sequences of child styles it has there, which contents, and which share of a page's words is in its branch.
Importance of a node is entropy weighed by that share. Presentation: the entropy of its child styles over the pages; content:
one minus the mean entropy of its contents over the pages; joined as (1 - g^l) * presentation + g^l * content for l
styles. A page's branches are judged from the body down. A branch goes when its importance is under the threshold. One that holds
most of a page's words, in leaves directly below it, is the content of the host: nothing below it goes by its share, only boxes
(div, section, span and the like) whose content and style are the same on all pages. A paragraph, heading or list of its own is
never judged by its share, so short parts of an article stay.

What tags, classes, ids and roles say is a prior beside the tree: an article or main part is content, menus, headers, footers, forms,
comments, adverts and the like have importance 0. It decides alone for hosts with fewer than MIN_PAGES pages and for what no entropy
can tell (readers' comments are as varied as articles); `prior=False` turns it off.

The tree is never collected: its nodes are sums over all pages, whichever host they are of, so a host with
a third of the pages is added up in parts like any other. Judged nodes are broadcast up to
BROADCAST_NODES; more are joined to the pages.

Defined cases: null or empty html gives an empty text; markup that is cut off ends there, and an unclosed
script or style takes the rest. If pruning would leave nothing of a page (say, all pages of a host are
copies), the page keeps what was not low by its tags. Repeated pages count like others. A null url is a host of its own.
"""

from __future__ import annotations

import html as entities
import math
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mapped, pieces, table
from .url_filter import with_parts

GAMMA, THRESHOLD, MIN_PAGES = 0.9, 0.3, 4
#: Importance under which a branch beside the content goes, and the share of a page's words from which a branch is its content.
BESIDE, CONTENT = 0.15, 0.5
#: Verdicts on nodes.
LOW, CORE, SAME = 1, 2, 4
#: Elements that stand for text themselves: never judged by their share of a page.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead tfoot caption figcaption br hr html body main article".split())
BROADCAST_NODES = 500_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An open element of the key ends where one of these begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form".split())
NOISE_TAGS = frozenset("nav footer aside form head menu dialog button select svg canvas object audio video iframe noscript template".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar rail footer comment comments disqus reply replies cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended widget login search skip toolbar pagination pager copyright".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|/?[a-zA-Z][^>]*(?P<odd>>|\Z)|/[^>]*>)", re.S
)
ATTR = re.compile(r"""(class|id|role|href)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def key_of(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


class Page:
    """Blocks of a page in order: [path, text, noisy, in an article, links]; and the child styles of each path."""

    def __init__(self, html: str):
        self.blocks: list = []
        self.styles: dict[str, list] = {}
        # open elements: tag, path of its block, noisy, in an article, is a block
        self.open: list = [("", "", False, False, True)]
        self.text: list = []
        self.links: list = []
        self.read(html)

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text or self.links:
            _, path, noisy, article, _ = self.open[-1]
            self.blocks.append([path, text, noisy, article, self.links])
            self.links = []
        self.text = []

    def close_to(self, depth: int):
        while len(self.open) > depth:
            if self.open[-1][4]:
                self.flush()
            self.open.pop()

    def find(self, tags, scope) -> int:
        """Place of the innermost open element among tags, not looking beyond scope; 0 if there is none."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in scope:
                return 0
        return 0

    def begin(self, tag: str, attrs: str):
        if tag in CLOSES_P and (k := self.find(("p",), SCOPE)):
            self.close_to(k)
        if tag in ENDS and (k := self.find(ENDS[tag], SCOPE)):
            self.close_to(k)
        found = {name.lower(): value.strip("\"'") for name, value in ATTR.findall(attrs)} if attrs else {}
        _, path, noisy, article, _ = self.open[-1]
        if tag in INLINE:
            self.styles.setdefault(path, []).append(tag)
            if "href" in found:
                self.links.append(found["href"])
            if tag in VOID:
                self.text.append(" ")
                return
            if noisy or not is_noise("span", found, article):
                self.open.append((tag, path, noisy, article, False))
                return
        self.flush()
        name = tag + "".join("." + re.sub(r"\d+", "0", found[a]).replace("/", "_") for a in ("class", "id", "role") if a in found)
        self.styles.setdefault(path, []).append(name)
        if tag in VOID:
            return
        noisy = noisy or is_noise(tag, found, article)
        self.open.append((tag, f"{path}/{name}", noisy, (article or tag in ("article", "main")) and not noisy, True))

    def read(self, html: str):
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            if m is None:
                self.text.append(entities.unescape(html[at:]))
                break
            if m.start() > at:
                self.text.append(entities.unescape(html[at : m.start()]))
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if k := self.find((tag,), () if tag not in INLINE else SCOPE):
                    self.close_to(k)
                elif tag == "p" or tag == "br":
                    self.text.append(" ")
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                stop = html.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else n
                continue
            self.begin(tag, m["attrs"])
        self.close_to(1)
        self.flush()

    def candidates(self, prior: bool = True) -> list:
        """Blocks that their tags do not rule out: those of the article or main part where the page has one."""
        clean = [b for b in self.blocks if b[1] and not (prior and b[2])]
        return [b for b in clean if prior and b[3]] or clean

    def shares(self) -> dict[str, list]:
        """Of each path, the share of the page's words in its branch, and in leaves directly below it."""
        own: dict[str, int] = {}
        for path, text, *_ in self.blocks:
            if text:
                own[path] = own.get(path, 0) + text.count(" ") + 1
        whole = max(1, sum(own.values()))
        found: dict[str, list] = {}
        for path, n in own.items():
            branch = path
            while branch:
                found.setdefault(branch, [0.0, 0.0])[0] += n / whole
                branch = branch[: branch.rfind("/")]
        for path, n in own.items():
            above = path[: path.rfind("/")]
            if tag_of(path) in FLOW and above:
                found[above][1] += n / whole
        return found

    def main_text(self, host: str, verdicts, prior: bool = True) -> str:
        """verdicts: of nodes by key. The prior's content is the article or main part; without one, the tree tells where it is."""
        blocks = self.candidates(prior)
        known: dict[str, bool] = {}
        kept = []
        for b in blocks:
            if b[0] not in known:
                known[b[0]] = stays(b[0], host, verdicts, prior and b[3])
            if known[b[0]]:
                kept.append(b)
        return "\n".join(b[1] for b in kept or blocks)


def tag_of(path: str) -> str:
    return path[path.rfind("/") + 1 :].split(".", 1)[0]


def branches(path: str):
    """path and all above it, from the top down."""
    at = path.find("/", 1)
    while at > 0:
        yield path[:at]
        at = path.find("/", at + 1)
    if path:
        yield path


def stays(path: str, host: str, verdicts, content: bool) -> bool:
    """Whether the tree keeps a block, judged from the top down."""
    for branch in branches(path):
        verdict, flow = verdicts.get(key_of(f"{host}\0{branch}"), 0), tag_of(branch) in FLOW
        if verdict & SAME and not flow and branch == path:
            return False
        if verdict & LOW and not flow and not content:
            return False
        content = content or bool(verdict & CORE)
    return True


def is_noise(tag: str, found: dict, article: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not article:
        return True
    if tag in ("html", "body", "main"):
        return False
    if not found:
        return False
    if found.get("role", "").lower() in NOISE_ROLES:
        return True
    words = re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower())
    return any(w in NOISE_WORDS for w in words)


def node_sums(pages: DataFrame) -> DataFrame:
    """node, kind, value, t, l over all pages. kind 0: pages with the node; 1: pages with a child style; 2: a content, t its occurrences and l the sum of x ln x over pages; 3, 4: shares of words in the branch, and in leaves directly below."""

    def run(batches):
        sums: dict = {}

        def flush():
            cols = [array("q"), array("b"), array("q"), array("d"), array("d")]
            for (node, kind, value), (t, x) in sums.items():
                for c, v in zip(cols, (node, kind, value, t, x)):
                    c.append(v)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, d)) for c, d in zip(cols, (np.int64, np.int8, np.int64, float, float))], ["node", "kind", "value", "t", "l"])

        for b in batches:
            for host, html in zip(b.column(0), b.column(1)):
                host, page = host.as_py(), Page(html.as_py() or "")
                own: dict = {}
                blocks_of = {b[0] for b in page.blocks}
                for path, text, _, _, links in page.blocks:
                    node = key_of(f"{host}\0{path}")
                    own[node, 0, 0] = 1
                    for content in ([text] if text else []) + ["href:" + x for x in links]:
                        k = (node, 2, key_of(content))
                        own[k] = own.get(k, 0) + 1
                    style = page.styles.get(path, [])
                    own[node, 1, key_of(" ".join(style))] = 1
                for path, (share, leaves) in page.shares().items():
                    node = key_of(f"{host}\0{path}")
                    own[node, 0, 0] = 1
                    own[node, 3, 0], own[node, 4, 0] = share, leaves
                    if path not in blocks_of:
                        own[node, 1, key_of(" ".join(page.styles.get(path, [])))] = 1
                for k, t in own.items():
                    seen, x = sums.get(k), t * math.log(t) if k[1] == 2 else 0.0
                    if seen is None:
                        sums[k] = [t, x]
                    else:
                        seen[0] += t
                        seen[1] += x
                if len(sums) > 200_000:
                    yield flush()
        if sums:
            yield flush()

    rows = mapped(pages.select("host", "html"), run, "node long, kind byte, value long, t double, l double")
    return rows.groupBy("node", "kind", "value").agg(F.sum("t").alias("t"), F.sum("l").alias("l"))


def importance(pages: DataFrame) -> DataFrame:
    """node, pages, presentation, content, share, leaves, importance, verdict (of LOW, CORE and SAME)."""
    kind, t = F.col("kind"), F.col("t")
    sums = node_sums(pages).groupBy("node").agg(
        F.sum(F.when(kind == 0, t)).alias("pages"),
        F.sum(F.when(kind == 1, t)).alias("styled"),
        F.sum(F.when(kind == 1, t * F.log(t))).alias("style_log"),
        F.count(F.when(kind == 1, 1)).alias("styles"),
        F.avg(F.when(kind == 2, F.log(t) - F.col("l") / t)).alias("entropy"),
        F.sum(F.when(kind == 3, t)).alias("share"),
        F.sum(F.when(kind == 4, t)).alias("leaves"),
    )
    base = F.log(F.greatest(F.col("pages"), F.lit(2.0)))
    presentation = F.least(F.lit(1.0), (F.log("styled") - F.col("style_log") / F.col("styled")) / base)
    content = F.greatest(F.lit(0.0), 1 - F.coalesce("entropy", F.lit(0.0)) / base)
    weight = F.pow(F.lit(GAMMA), "styles")
    sums = sums.withColumns({"presentation": presentation, "content": content, "share": F.coalesce("share", F.lit(0.0)) / F.col("pages"), "leaves": F.coalesce("leaves", F.lit(0.0)) / F.col("pages")})
    joined = (1 - weight) * F.col("presentation") + weight * F.col("content")
    judged = F.col("pages") >= MIN_PAGES
    sums = sums.withColumns({"joined": joined, "importance": F.when(judged, joined * F.col("share")).otherwise(F.lit(1.0))})
    core = (F.col("share") >= CONTENT) & (F.col("leaves") >= F.col("share") / 2)
    bits = F.when(F.col("importance") < BESIDE, LOW).otherwise(0) + F.when(core, CORE).otherwise(0) + F.when((F.col("joined") < THRESHOLD) & F.col("entropy").isNotNull(), SAME).otherwise(0)
    return sums.select("node", "pages", "presentation", "content", "share", "leaves", "importance", F.when(judged, bits).otherwise(0).alias("verdict"))


def extract(pages: DataFrame, prior: bool = True, tree: bool = True) -> DataFrame:
    """pages (url, html, more columns) with text and n_chars; own columns of these names are replaced. prior, tree: what judges blocks."""
    pages = pages.drop("text", "n_chars", "host", "path")
    names = pages.columns
    hosted = with_parts(pages).drop("path")
    spark = pages.sparkSession
    if tree:
        judged = cut(importance(hosted).filter("verdict > 0").select("node", "verdict"))
    else:
        judged = spark.createDataFrame([], "node long, verdict int")
    schema = pages.withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    html = names.index("html")
    few = judged.count() <= BROADCAST_NODES
    if few:
        shared = spark.sparkContext.broadcast(dict(map(tuple, judged.collect())))
        source = hosted
    else:
        shared = None
        source = with_verdicts(hosted, judged)

    def run(batches):
        for b in batches:
            hosts = b.column(b.schema.get_field_index("host")).to_pylist()
            own = None if few else b.column(b.schema.get_field_index("verdicts"))
            texts = []
            for first, some in pieces(b.column(html)):
                for k, page in enumerate(some, first):
                    verdicts = shared.value if few else {x["node"]: x["verdict"] for x in own[k].as_py() or ()}
                    texts.append(Page(page or "").main_text(hosts[k], verdicts, prior))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(names))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return mapped(source, run, schema)


def with_verdicts(hosted: DataFrame, judged: DataFrame) -> DataFrame:
    """hosted with `verdicts`, the judged nodes that a page has: by a join of the pages' nodes, which are keys of 8 bytes."""
    names = hosted.columns

    def run(batches):
        for b in batches:
            keys, nodes = [], []
            for host, html, own in zip(b.column(0), b.column(1), b.column(2)):
                found = {key_of(f"{host.as_py()}\0{branch}") for path in {x[0] for x in Page(html.as_py() or "").blocks} for branch in branches(path)}
                keys += [own.as_py()] * len(found)
                nodes += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], ["own", "node"])

    own = F.xxhash64("host", "html")
    have = mapped(hosted.select("host", "html", own.alias("own")), run, "own long, node long").distinct()
    marked = have.join(judged, "node").groupBy("own").agg(F.collect_list(F.struct("node", "verdict")).alias("verdicts"))
    return hosted.withColumn("own", own).join(marked, "own", "left").select(*names, "verdicts")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

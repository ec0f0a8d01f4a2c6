"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is an element's place,
the path of tags, classes and ids from the root, digits as one. Over the host's
m pages a node has the presentation styles that its children form (the sequence
of their labels) and, where it holds text itself, content nodes: its texts.

    style(E)   = -sum p log_m p         over the styles of E: 0 where every page
                                        lays E out alike, 1 where each its own way
    content(c) = 1 - log_m n            of a text on n pages: 0 on all, 1 on one
    share(E)   = sum words x content    over the texts below E, as a share of
                                        the same sum over the whole tree
    imp(E)     = 1 - (1 - style(E)) (1 - share(E))

A node laid out alike on every page is a template, and its children are slots:
slots of low importance go, with all below them. What lies under a node that
pages lay out freely is the writer's own; there only content nodes of low
importance go, texts that nearly every page of the host repeats.

Markup enters as a weight of ``MARKUP`` on the logit of importance, which is
held within ``MOST`` of 0: minus for an element that declares itself
navigation, footer, form, advertisement, comments and so on, and, on a page that
declares its article, for all outside of it; plus for the article (``article``,
``main``, role main), for what is inside, and for the page's heading (``h1``)
with the nodes around it. Since MARKUP is larger than MOST, declared slots fall
to the markup, all others to the tree, and repeated texts go wherever they are.
A declared article of which nothing would be left keeps its repeated texts:
copies of one article are no template.

Character references are decoded, white space (any that Unicode calls so)
becomes one space, blocks are joined by one space.

Defined cases: a null or empty page has empty text; a null or odd url has no
host, and its page is judged by its markup alone, as is a node on fewer than
``MIN_PAGES`` pages; elements deeper than ``MAX_DEPTH`` count as part of the
one at that depth; repeated rows get a row each and count as pages; an unclosed
element ends with its parent, a page cut short at its end; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, table

#: Slots below this importance go; nodes below this style entropy are templates.
LOW, TEMPLATE = 0.45, 0.45
#: Content nodes below this importance go.
LOW_TEXT = 0.05
MIN_PAGES, MAX_DEPTH = 8, 64
#: The markup's weight, and the bound of an importance's logit.
MARKUP, MOST = 4.0, 3.9

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body button caption head html legend option optgroup select tbody td tfoot th thead title tr".split())
#: A start tag ends an open element of these names, up to a holder.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th"),
}
HOLDERS = frozenset("ul ol menu dl select table article main section aside nav footer header form div body html".split())
#: What declares itself no part of an article. Of a class or id, parts between
#: marks count for the first list, whole names (after a prefix such as site-)
#: for the second, whose words also name parts of articles.
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select fieldset head search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation topnav breadcrumb breadcrumbs sidebar sidebars cookie cookies consent gdpr "
    "newsletter subscribe signup login comment comments commentlist disqus pagination pager".split()
)
WHOLE_NAMES = frozenset(
    "header masthead footer foot banner aside rail menu menus notice notices alert popup modal overlay search share sharing social related recommended respond discussion replies "
    "reply widget toolbar copyright disclaimer promotion".split()
)
PREFIXES = frozenset("site page main global top bottom left right sticky".split())
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART, DIGITS = re.compile(r"[a-z]+"), re.compile(r"[0-9]+")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Node:
    __slots__ = ("label", "noise", "main", "title", "parts", "path", "depth", "tag")

    def __init__(self, tag: str, label: str, path: int, depth: int, noise: bool, main: bool):
        self.tag, self.label, self.path, self.depth, self.noise, self.main, self.title = tag, label, path, depth, noise, main, False
        self.parts: list[Node | str] = []


def _declares_noise(names: list[str]) -> bool:
    for name in names:
        parts = NAME_PART.findall(name)
        if not NOISE_NAMES.isdisjoint(parts) or name in WHOLE_NAMES or (len(parts) == 2 and parts[0] in PREFIXES and parts[1] in WHOLE_NAMES):
            return True
    return False


def _element(tag: str, rest: str, parent: Node, inside_main: bool) -> Node:
    label, noise, main = tag, tag in NOISE_TAGS or tag == "header" and not inside_main, tag in MAIN_TAGS
    if len(rest) > 1:
        found = {}
        for name, value in ATTRIBUTE.findall(rest):
            found.setdefault(name.lower(), value.strip("\"'"))
        names = " ".join(found[k] for k in ("class", "id") if found.get(k)).lower().split()
        if names:
            label = f"{tag}.{DIGITS.sub('0', ' '.join(sorted(names)))}"
            if tag not in ("html", "body"):
                noise = noise or (not NOISE_NAMES.isdisjoint(names) if main else _declares_noise(names))
        role = found.get("role", "").lower()
        noise = noise or role in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        main = main or role in MAIN_ROLES
    deep = parent.depth >= MAX_DEPTH
    return Node(tag, label, parent.path if deep else _hash(f"{parent.path}/{label}"), parent.depth + 1, noise, main and not noise)


def parse(page: str) -> Node:
    """The element tree; raw-text elements and comments are left out."""
    root = Node("", "", 0, 0, False, False)
    stack, at, size = [root], 0, len(page)
    mains = 0
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    mains -= sum(n.main for n in stack[i:])
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in HOLDERS:
                    break  # an inline end tag doesn't end the block around it
            continue
        rest = m[3]
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in CLOSES_P or tag in ENDS:
            wanted = ("p", *ENDS.get(tag, ())) if tag in CLOSES_P else ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in wanted:
                    mains -= sum(n.main for n in stack[i:])
                    del stack[i:]
                elif stack[i].tag in HOLDERS and not (tag in ("tr", "td", "th", "tbody", "tfoot", "thead") and stack[i].tag not in ("table",)):
                    break
        node = _element(tag, rest, stack[-1], mains > 0)
        stack[-1].parts.append(node)
        if tag == "h1":
            for around in (node, *reversed(stack)):
                if around.title:
                    break
                around.title = True
        if tag not in VOID and not rest.endswith("/>"):
            stack.append(node)
            mains += node.main
    return root


def own_text(node: Node) -> str:
    return " ".join(markup.unescape("".join(p for p in node.parts if isinstance(p, str))).split())


def observe(page: str) -> tuple[dict[int, int], dict[tuple[int, int], int], dict[int, tuple[int, ...]]]:
    """What one page says: the style of every node, the words of every (node,
    text), and every node's ancestors, itself included. Nodes marked as noise
    are in it: the tree has no need of the markup's weight."""
    styles: dict[int, set] = {}
    contents: dict[tuple[int, int], int] = {}
    above: dict[int, tuple[int, ...]] = {}
    stack: list[tuple[Node, tuple[int, ...]]] = [(parse(page), ())]
    while stack:
        node, chain = stack.pop()
        children = [p for p in node.parts if isinstance(p, Node)]
        styles.setdefault(node.path, set()).add("|".join(c.label for c in children))
        if not chain or chain[-1] != node.path:  # below MAX_DEPTH a node shares its parent's path
            chain = (*chain, node.path)
        above[node.path] = chain
        text = own_text(node)
        if text:
            contents[node.path, _hash(text)] = text.count(" ") + 1
        stack += [(c, chain) for c in children]
    return {k: _hash("\n".join(sorted(v))) for k, v in styles.items()}, contents, above


NOTHING: frozenset = frozenset()


def extract(page: str, low: frozenset[int] | set[int] = NOTHING, repeated: frozenset | set = NOTHING) -> str:
    """The text of a page without its branches of low importance; ``low``: the
    slots, ``repeated``: the (node, text) of low importance in the host's tree."""
    root = parse(page)

    def has_main(top: Node) -> bool:
        todo = [top]
        while todo:
            node = todo.pop()
            if node.main:
                return True
            todo += [p for p in node.parts if isinstance(p, Node) and not p.noise]
        return False

    declared = has_main(root)
    places = {node for node, _ in repeated}

    def read(repeated: frozenset | set) -> str:
        out: list[str] = []
        # (item, inside an article); a string is text that is ready
        todo: list[tuple[Node | str, bool]] = [(root, False)]
        while todo:
            item, inside = todo.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            if item.noise or not declared and item.path in low and not item.title:
                out.append(" ")
                continue
            inside = inside or item.main
            edge = " " if item.tag in BLOCK or not item.tag else ""
            if edge:
                out.append(edge)
                todo.append((edge, inside))
            heard = bool(repeated) and item.path in places and (item.path, _hash(own_text(item))) in repeated
            silent = declared and not inside or heard or not declared and item.path in low and item.tag != "h1"
            for p in reversed(item.parts):
                if isinstance(p, Node):
                    todo.append((p, inside))
                else:
                    todo.append((" " if silent else markup.unescape(p) if "&" in p else p, inside))
        return " ".join("".join(out).split())

    text = read(repeated)
    return text or (read(NOTHING) if declared and repeated else text)


def host_of(url: str = "url"):
    """Lower-case host with its port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def observations(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, n, size, above) of (host, html) pages: kind 0
    the styles, with the node's ancestors; kind 1 the texts, with their words.
    Pages are counted within a batch, then by one aggregation over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            size: dict = {}
            above: dict[tuple[str, int], tuple[int, ...]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if host is None or not page:
                    continue
                styles, contents, chains = observe(page)
                count.update((host, node, 0, value) for node, value in styles.items())
                for (node, value), words in contents.items():
                    count[host, node, 1, value] += 1
                    size[host, node, 1, value] = words
                above.update(((host, node), chain) for node, chain in chains.items())
            keys = list(count)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int64())]
            columns += [pa.array([count[k] for k in keys], pa.int64()), pa.array([size.get(k) for k in keys], pa.int64()), pa.array([None if k[2] else list(above[k[:2]]) for k in keys], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "node", "kind", "value", "n", "size", "above"])

    seen = map_arrow(pages.select("host", "html"), run, "host string, node long, kind int, value long, n long, size long, above array<long>")
    return seen.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"), F.min("size").alias("size"), F.min("above").alias("above"))


def contents(observed: DataFrame) -> DataFrame:
    """(host, node, value, n, m, size, content) of every content node; m pages
    have the node."""
    keys = ["host", "node"]
    pages = observed.where("kind = 0").groupBy(*keys).agg(F.sum("n").alias("m"))
    log = lambda c: F.log(F.col(c).cast("double"))
    content = F.when(F.col("m") > 1, 1 - log("n") / log("m")).otherwise(F.lit(1.0))
    return observed.where("kind = 1").join(pages, keys).select(*keys, "value", "n", "m", "size", content.alias("content"))


def importance(observed: DataFrame) -> DataFrame:
    """(host, node, m, style, share, free, importance) of every node of every
    host's tree; free is the largest style entropy above the node."""
    keys = ["host", "node"]
    nodes = observed.where("kind = 0").groupBy(*keys).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nlogn"), F.min("above").alias("above"))
    # entropy to base m from counts: (log m - sum n log n / m) / log m
    style = F.when(F.col("m") > 1, 1 - F.col("nlogn") / F.col("m") / F.log(F.col("m").cast("double"))).otherwise(F.lit(1.0))
    nodes = nodes.select(*keys, "m", "above", F.greatest(style, F.lit(0.0)).alias("style"))
    said = contents(observed).groupBy(*keys).agg(F.sum(F.col("n") * F.col("size") * F.col("content")).alias("said"))
    below = nodes.join(said, keys).select("host", F.explode("above").alias("node"), "said").groupBy(*keys).agg(F.sum("said").alias("said"))
    whole = below.where("node = 0").select("host", F.col("said").alias("whole"))
    upper = nodes.select("host", F.col("node").alias("a"), F.col("style").alias("a_style"))
    free = nodes.select(*keys, F.explode("above").alias("a")).where("a <> node").join(upper, ["host", "a"]).groupBy(*keys).agg(F.max("a_style").alias("free"))
    share = F.coalesce(F.when(F.col("whole") > 0, F.col("said") / F.col("whole")), F.lit(0.0))
    judged = nodes.join(below, keys, "left").join(whole, "host", "left").join(free, keys, "left")
    judged = judged.select(*keys, "m", "style", share.alias("share"), F.coalesce("free", F.lit(0.0)).alias("free"))
    return judged.withColumn("importance", 1 - (1 - F.col("style")) * (1 - F.col("share")))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", low: float = LOW, template: float = TEMPLATE, low_text: float = LOW_TEXT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    from weftline.session import materialize, release

    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", host_of("url"))
    observed = materialize(observations(source), "observations")
    weak = importance(observed).where((F.col("m") >= min_pages) & (F.col("importance") < low) & (F.col("free") < template) & (F.col("node") != 0))
    again = contents(observed).where((F.col("m") >= min_pages) & (F.col("content") < low_text))
    listed = weak.select("host", F.col("node").alias("slot"), F.lit(None).cast("struct<node:long,value:long>").alias("text")).unionByName(
        again.select("host", F.lit(None).cast("long").alias("slot"), F.struct("node", "value").alias("text"))
    )
    # One short row per host; written first, so that its size is known when
    # the join is planned and the pages move only if it is large. Then a large
    # host's pages are split as a skewed join side.
    listed = materialize(listed.groupBy(F.col("host").alias("weak_host")).agg(F.collect_set("slot").alias("low"), F.collect_set("text").alias("repeated")), "style-tree")
    release(observed)
    joined = source.join(listed, F.col("host") == F.col("weak_host"), "left").select("page_id", "url", "html", "weak_host", "low", "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, out = {None: (NOTHING, NOTHING)}, []
            for i, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if host not in known:
                    known[host] = frozenset(batch.column(4)[i].as_py()), frozenset((t["node"], t["value"]) for t in batch.column(5)[i].as_py())
                out.append(extract(page, *known[host]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(source.dtypes)
    return map_arrow(joined, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

"""HTML extraction with site style trees.

The DOMs of all pages of a host are merged into one tree: a node is a path of tags (with their first class).  Per
node, presentation styles are the sequences of its children's labels, and contents are its blocks of text.

- Presentation importance: the entropy of a node's styles over its m pages, to the base m (1 if m is 1): a node that
  is built the same way everywhere is template.
- Content importance: 1 minus the mean, over its blocks, of log_m of the number of pages that have the block: text that
  stands on all pages is template.
- Composite importance of a branch: the mean over its nodes, weighted by how often they come with it and by GAMMA to
  the depth below it, so that a branch is judged by all that it holds.

Branches of low importance that hold none of high importance are removed from each page of the host that has enough
pages to tell.  Markup that says what it is (menus, headers, footers, asides, forms, scripts, adverts, notices, comments)
has importance 0.  Where a page has an article or main element, its text is taken from there, less the branches of low
importance inside.  What is inside is counted by distinct articles instead of pages, as copies of one article on a host
would look like template otherwise; the element itself stays, and stays whole where nothing else would be left of it.

Words in a class, id or role say what a branch is, not what a page is: they don't touch html, body, article and main
elements, nor an element that holds nearly all (``WRAPPER``) of the text of its article, or of its page where that has
none.  Where every article or main element of a page is below such words, they don't touch what holds one of these
and more than half of the page's text.

Inline and empty elements are no nodes: their text belongs to the block around them, and goes or stays with it.

Statistics are counted inside each task first; what is shuffled are counts by host, node and block, and one short list
of branches a host.  Pages meet that list in a join that adaptive execution can split for hosts with many pages.

Edge cases.  An empty table gives none.  A null or blank page gives an empty text.  Unclosed, misplaced and cut-off tags are closed as a browser
would.  A null url is a host of its own (``""``).  Rows that repeat a page_id keep a row each, and
count as pages of their own.  Very long and very deep pages are handled whole, elements deeper than ``DEPTH`` as
siblings.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

GAMMA = 0.7
#: Branches below this importance are removed, on hosts with at least MIN_PAGES pages that have them.
THRESHOLD = 0.3
MIN_PAGES = 5
#: Elements inside each other; a deeper one stands beside its parent, as in browsers.
DEPTH = 512
#: An element with at least this share of the text is a wrapper, whatever it is called.
WRAPPER = 0.9
#: Counts that a task holds before it hands them on.
HELD = 200_000

#: A quote begins a value only after an equals sign; every alternative takes what it can, so that nothing is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)*)(?:>|\Z)", re.S)
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
_CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are no nodes of a tree.
_NO_NODE = _INLINE | _VOID
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that end an open one of the same kind; and what holds them.
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}
_NOISE_TAGS = frozenset("head title script style noscript template iframe nav aside footer form button select option input textarea dialog svg canvas object embed map audio video".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead topbar toolbar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social comment comments reply replies disqus respond related recommended widget pagination pager skip contentinfo complementary search".split()
)
_MAIN = frozenset(("article", "main"))
_WHOLE = _MAIN | {"html", "body"}


class Node:
    __slots__ = ("label", "tag", "noise", "worded", "children", "parent", "path", "depth", "inside")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _CLASS.finditer(attributes)} if attributes else {}
        names = found.get("class", "").split()
        self.tag = "main" if found.get("role", "").lower() == "main" else tag
        self.label = f"{tag}.{names[0]}" if names else tag
        words = {w for v in found.values() for w in re.split(r"[^a-z]+", v.lower()) if w}
        self.worded = tag not in _NOISE_TAGS and self.tag not in _WHOLE and bool(words & _NOISE_WORDS)
        self.inside = self.tag in _MAIN or (parent is not None and parent.inside)
        self.noise = tag in _NOISE_TAGS or self.worded or (tag == "header" and not self.inside)  # an article's header is its title
        self.children: list = []
        self.depth = 0 if parent is None else parent.depth + 1
        self.parent = parent
        self.path = "" if parent is None else parent.path if tag in _NO_NODE else f"{parent.path}/{self.label}"


def parse(page: str) -> Node:
    """The DOM; texts are children of type str, raw as in the source."""
    root = Node("", "", None)
    at = root
    i = 0
    while True:
        m = _TOKEN.search(page, i)
        if m is None:
            if i < len(page):
                at.children.append(page[i:])
            return _spared(root)
        if m.start() > i:
            at.children.append(page[i : m.start()])
        i = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            up = at
            while up.parent is not None and up.tag != tag and not up.label.startswith(f"{tag}."):
                up = up.parent
            if up.parent is not None:
                at = up.parent
            continue
        if tag in _ENDS_P:
            at = _close(at, "p", ("div", "article", "section", "body", "td", "li", "button"))
        if tag in _SAME:
            at = _close(at, tag, _SAME[tag])
            if tag in ("dt", "dd"):
                at = _close(at, "dd" if tag == "dt" else "dt", _SAME[tag])
        if tag in ("body",):
            at = _close(at, "head", ())
        if at.depth >= DEPTH:
            at = at.parent
        node = Node(tag, m[3], at)
        at.children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, i)
            node.children.append(page[i : end.start() if end else len(page)])
            i = end.end() if end else len(page)
        elif tag not in _VOID and not _CLOSED.search(m[3]):
            at = node


def _close(at: Node, tag: str, inside: tuple[str, ...]) -> Node:
    """The parent of the innermost open ``tag``, unless one of ``inside`` lies between."""
    up = at
    while up.parent is not None and up.tag not in inside:
        if up.tag == tag:
            return up.parent
        up = up.parent
    return at


def _main(node: Node) -> list[Node]:
    """The outermost article or main elements that aren't noise."""
    out, work = [], [node]
    while work:
        x = work.pop()
        if x.noise:
            continue
        if x.tag in _MAIN:
            out.append(x)
        else:
            work.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def _spared(root: Node) -> Node:
    """The DOM, where wrappers are no noise for the words in their names."""
    if not _main(root):
        _spare(root, True)
    for x in _main(root):
        _spare(x, False)
    return root


def _spare(scope: Node, around_main: bool) -> None:
    total, work = -1, [scope]
    while work:
        x = work.pop()
        if x.noise:
            if not x.worded:
                continue
            total, own = _size(scope) if total < 0 else total, _size(x)
            if own < WRAPPER * total and not (around_main and 2 * own > total and _holds_main(x)):
                continue
            x.noise = False
        work.extend(c for c in x.children if isinstance(c, Node))


def _size(node: Node) -> int:
    """Characters of text below a node, whatever its words say."""
    n, work = 0, [node]
    while work:
        for c in work.pop().children:
            if isinstance(c, str):
                n += len(c.strip())
            elif not c.noise or c.worded:
                work.append(c)
    return n


def _holds_main(node: Node) -> bool:
    work = [node]
    while work:
        x = work.pop()
        if x.tag in _MAIN:
            return True
        work.extend(c for c in x.children if isinstance(c, Node) and (not c.noise or c.worded))
    return False


def blocks(roots: list[Node], removed: frozenset[str] = frozenset(), left_out: frozenset[Node] = frozenset()) -> list[tuple[str, str]]:
    """(path, text) of the blocks below ``roots`` in page order, without noise, ``removed`` branches and the nodes ``left_out``."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    place = ""

    def flush():
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            out.append((place, text))

    work: list = [(r, True) for r in reversed(roots)]
    while work:
        x, opening = work.pop()
        if isinstance(x, str):
            if not held:
                place = opening
            held.append(x)
            continue
        if not opening:
            flush()
            continue
        if x.noise or x in left_out or (x.path in removed and x.tag not in _NO_NODE and x.tag not in _MAIN):
            if x.tag not in _INLINE:
                flush()
            continue
        if x.tag == "br":
            held.append(" ")
            continue
        if x.tag not in _INLINE:
            flush()
            work.append((x, False))
        for c in reversed(x.children):
            work.append((c, x.path) if isinstance(c, str) else (c, True))
    flush()
    return out


def extract(page: str, removed: frozenset[str] = frozenset()) -> str:
    root = parse(page)
    main = _main(root)
    return " ".join(t for _, t in (blocks(main, removed) or blocks(main) if main else blocks([root], removed)))


def _styles(root: Node, main: frozenset[Node]):
    """(path, style, whether it is inside ``main``) of every element that is neither noise nor inline.  A style: the children's labels, runs of one label as one."""
    work = [(root, False)]
    while work:
        x, inside = work.pop()
        if x.noise:
            continue
        inside = inside or x in main
        below = [c for c in x.children if isinstance(c, Node)]
        if x.tag not in _NO_NODE:
            labels = [c.label for c in below if c.tag not in _NO_NODE]
            yield x.path, ",".join(a for a, b in zip(labels, [None, *labels], strict=False) if a != b), inside
        work.extend((c, inside) for c in below)


def _host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


STAT_SCHEMA = "host string, path string, kind string, item long, article long, pages long"


def statistics(pages: DataFrame) -> DataFrame:
    """(host, path, kind, item, pages): in how many pages of the host (inside of articles: in how many distinct articles) a node has a style, a block, or is there at all."""

    def run(batches):
        held: Counter = Counter()

        def out():
            rows = list(held.items())
            held.clear()
            columns = [pa.array([k[i] for k, _ in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in rows], pa.int64())], ["host", "path", "kind", "item", "article", "pages"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page or "")
                main = _main(root)
                own = blocks(main)
                article = _hash("\n".join(t for _, t in own))
                seen = set()
                for path, style, inside in _styles(root, frozenset(main)):
                    seen.add((host, path, "node", 0, article if inside else None))
                    seen.add((host, path, "style", _hash(style), article if inside else None))
                for path, text in own:
                    seen.add((host, path, "block", _hash(text), article))
                for path, text in blocks([root], left_out=frozenset(main)):
                    seen.add((host, path, "block", _hash(text), None))
                held.update(seen)
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    counted = pages.mapInArrow(run, STAT_SCHEMA)
    per_article = counted.groupBy("host", "path", "kind", "item", "article").agg(F.sum("pages").alias("pages"))
    return per_article.groupBy("host", "path", "kind", "item").agg(F.sum(F.when(F.col("article").isNull(), F.col("pages")).otherwise(1)).alias("pages"))


def _hash(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def importances(stats: DataFrame) -> DataFrame:
    """(host, path, pages, importance): the composite importance of each branch."""
    share = F.col("pages").cast("double")
    per = stats.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "node", F.col("pages"))).alias("m"),
        F.sum(F.when(F.col("kind") == "style", share * F.log(share))).alias("plogp"),
        F.avg(F.when(F.col("kind") == "block", F.log(share))).alias("spread"),
    )
    base = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    styles = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), (F.log(F.col("m").cast("double")) - F.col("plogp") / F.col("m")) / base)).otherwise(1.0)
    contents = 1 - F.col("spread") / base
    node = per.where("m is not null").select("host", "path", "m", F.coalesce(F.when(F.col("m") > 1, contents), styles).alias("own"))
    # Each node counts for all branches that it is in.
    parts = F.split("path", "/")
    depth = F.size(parts)
    up = F.explode(F.sequence(F.lit(1), depth)).alias("k")
    spread = node.select("host", "path", "m", "own", up)
    above = F.array_join(F.slice(F.split("path", "/"), 1, F.col("k")), "/")
    weight = F.col("m") * F.pow(F.lit(GAMMA), F.size(F.split("path", "/")) - F.col("k"))
    branch = spread.select("host", above.alias("branch"), weight.alias("w"), "own", F.when(F.col("k") == F.size(F.split("path", "/")), F.col("m")).alias("pages"))
    return branch.groupBy("host", F.col("branch").alias("path")).agg(F.max("pages").alias("pages"), (F.sum(F.col("w") * F.col("own")) / F.sum("w")).alias("importance"))


SCHEMA = "page_id long, url string, text string, n_chars long"


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    hosted = pages.select("page_id", "url", "html", _host().alias("host"))
    stats = statistics(hosted.select("host", "html"))
    # A branch goes where it and all that it holds are of low importance: what only leads to a branch that stays, stays.
    told = importances(stats).where(F.col("pages") >= min_pages)
    parts = F.split("path", "/")
    above = F.array_join(F.slice(parts, 1, F.col("k")), "/")
    held = told.select("host", "path", "importance", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).select("host", above.alias("path"), "importance")
    low = held.groupBy("host", "path").agg(F.max("importance").alias("highest")).where((F.col("highest") < threshold) & (F.col("path") != ""))
    removed = low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("removed"))  # templates' nodes, not pages
    removed = store.saved(removed, "style-tree")  # of known size, so that a short list is broadcast

    def run(batches):
        for batch in batches:
            texts = [extract(h or "", frozenset(r or ())) for h, r in zip(batch.column("html").to_pylist(), batch.column("removed").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = hosted.join(removed, "host", "left").select("page_id", "url", "html", "removed")
    return met.mapInArrow(run, SCHEMA)

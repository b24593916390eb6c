"""HTML extraction by a site style tree: nodes of a host's pages are merged, their importance comes from the entropy of
how they look and what they say, and branches of low importance leave each page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wicker.llm.common import checkpointed

# Element names of HTML and what they mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg select datalist button".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements without an end tag that hide all that follows; other unclosed raw elements hide nothing.
ENDLESS = {"script", "style", "textarea", "title"}
CHROME = set("nav footer header aside form menu dialog".split())
MARKED = re.compile(r"ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|notice|consent|gdpr|sidebar|side|menu|nav\w*|footer|header|masthead|comments?|disqus|replies|related|share|sharing|social|newsletter|subscribe|login|search|popup|modal|breadcrumbs?|widget")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""", re.S)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
OPEN = re.compile(r"<[/!?]?[A-Za-z]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An element of a page: its style is its name with class, id and role, digits aside; path holds the styles above it.
    wrapper is true where nothing but class words outside an article ruled it out: an article in it may still count.
    marked is true where class words speak against the element itself."""

    __slots__ = ("tag", "path", "prior", "wrapper", "marked", "children", "text")

    def __init__(self, tag: str, path: int, prior: float | None, wrapper: bool = False, marked: bool = False):
        self.tag, self.path, self.prior, self.wrapper, self.marked, self.children, self.text = tag, path, prior, wrapper, marked, [], []


def host(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def parse(html: str, bulk: frozenset[int] | set[int] = frozenset()) -> tuple[Node, list[tuple[list[Node], str]]]:
    """The root and the blocks in page order: the elements around each and its text. prior is 0 for elements whose style
    says that they aren't the article, 1 for the article and what it holds, 0.5 for an article in a wrapper whose class
    words speak against it, None where style says nothing. Class words don't count for the paths in bulk, which hold the
    bulk of their host's text.

    Unclosed and misnested elements end where their parents do or where a sibling begins; hidden elements, scripts and
    the like have no text. All white space of a block is one space, whatever Unicode has as such."""
    root = Node("", 0, None)
    stack, blocks, parts, at = [root], [], [], 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append((list(stack), text))
            stack[-1].text.append(text)

    def element(name: str, closing: str, attributes: str) -> None:
        if name in BLOCK:
            flush()
        if closing:
            if any(x.tag == name for x in stack):
                while stack.pop().tag != name:
                    pass
            return
        if name == "br":
            parts.append(" ")
        if name in VOID or name in RAW:
            return
        for i in range(len(stack) - 1, 0, -1):  # a sibling ends what HTML lets stay open
            if stack[i].tag in CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i].tag in BLOCK and not (name in BLOCK and stack[i].tag == "p"):
                break
            if name in BLOCK and stack[i].tag == "p":
                del stack[i:]
                break
        named, unseen = [], False
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role"):
                named.append((key, value.lower()))
            unseen |= key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and bool(UNSEEN.search(value))
        style = re.sub(r"\d+", "", name + " " + " ".join(v for _, v in named).lower())
        marked = name not in ("html", "body", "article", "main") and any(MARKED.fullmatch(w.strip("-_")) for _, v in named for w in re.sub(r"\d+", "", v).split())
        top = stack[-1]
        path = xxhash.xxh64_intdigest(f"{top.path}/{style}") >> 1
        prior, wrapper = top.prior, top.wrapper
        chrome = unseen or name == "head" or name in CHROME and not (name == "header" and prior in (1, 0.5))
        main = name in ("article", "main") or any(k == "role" and "main" in v.split() for k, v in named)
        if chrome:
            prior, wrapper = 0, False
        elif prior == 0:
            if main and wrapper:
                prior, wrapper = 0.5, False
        elif marked and path not in bulk:
            prior, wrapper = 0, prior is None
        elif main and prior is None:
            prior = 1
        node = Node(name, path, prior, wrapper, marked)
        top.children.append(node)
        stack.append(node)

    m = TAG.search(html)
    while m:
        name = (m[2] or "").lower()
        if m.start() > at:
            parts.append(unescape(html[at : m.start()]))
        at = m.end()
        if name in RAW and not m[1] and not m[3].endswith("/"):  # what it holds is no markup: on after its end tag
            end = RAW_END[name].search(html, at)
            at = end.end() if end else len(html) if name in ENDLESS else at
        elif name:
            element(name, m[1], m[3])
        m = TAG.search(html, at)
    if at < len(html):  # a tag that the page's end cuts off is no text
        cut = OPEN.search(html, max(at, html.rfind(">") + 1))
        parts.append(unescape(html[at : cut.start() if cut else len(html)]))
    flush()
    return root, blocks


def style_rows(root: Node, blocks: list[tuple[list[Node], str]]) -> Iterator[tuple[int, int, int, int]]:
    """For each path of the page: (path, kind, value, number). Kinds 0 and 1, of those that style doesn't rule out, inside the
    article too: how it looks there (its children's styles in order) and what it says in all its elements, as hashes.
    Kind 2, of elements that class words speak against: the thousandths of the page's text that they hold."""
    todo, nodes, held = [root], {}, Counter()
    while todo:
        node = todo.pop()
        todo.extend(reversed(node.children))
        if node.prior != 0:
            look, says = nodes.setdefault(node.path, ({}, []))
            look.update(dict.fromkeys(c.path for c in node.children))
            says.extend(node.text)
    for path, (look, says) in nodes.items():
        yield path, 0, xxhash.xxh64_intdigest(" ".join(map(str, look))) >> 1, 1
        if says:
            yield path, 1, xxhash.xxh64_intdigest("\n".join(says)) >> 1, 1
    for above, text in blocks:
        for path in {x.path for x in above if x.marked}:
            held[path] += len(text)
    total = sum(len(text) for _, text in blocks)
    for path, n in held.items():
        yield path, 2, 0, 1000 * n // total


def unimportant(pages: DataFrame, least_pages: int = 3, threshold: float = 0.3, bulk: float = 0.5) -> DataFrame:
    """(host, path) of the style tree's nodes of low importance: those on at least ``least_pages`` pages of the host whose
    text and look hardly vary. Importance is the larger of both entropies, to the base of the number of pages: 1 if all
    pages differ, 0 if all agree. Nodes that style rules out aren't judged so, but where class words alone speak against
    one that holds more than ``bulk`` of the text of the host's pages on average, it is in the result as -1 - path: the
    words say nothing there. Path 0, the page itself, is in the result for each host with ``least_pages`` pages: there the
    tree can judge.

    Counts are summed in each batch and again before the shuffle, so a host with a third of all pages costs no more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = Counter()
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                site = xxhash.xxh64_intdigest(host(url)) >> 1
                for path, kind, value, n in style_rows(*parse(html or "")):
                    count[site, path, kind, value] += n
            rows = [(*k, n) for k, n in count.items()]
            if rows:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], ["host", "path", "kind", "value", "n"])

    seen = pages.select("url", "html").mapInArrow(run, "host long, path long, kind long, value long, n long")
    value = seen.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    kind = value.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    of = lambda c, *kinds: F.when(F.col("kind").isin(*kinds), F.col(c))
    imp = F.when(F.col("m") < least_pages, 1.0).otherwise((F.ln("m") - F.col("s") / F.col("m")) / F.ln("m"))
    node = kind.withColumn("imp", imp).groupBy("host", "path").agg(F.max(of("imp", 0, 1)).alias("imp"), F.max(of("kind", 0, 1)).alias("says"), F.max(of("m", 0, 1)).alias("m"), F.max(of("m", 2)).alias("held"))
    node = checkpointed(node)
    site = node.where("path = 0").select("host", F.col("m").alias("pages"))
    low = node.where((F.col("path") != 0) & (F.col("imp") < threshold) & (F.col("says") == 1)).select("host", "path")
    wide = node.where("held > 0").join(site, "host").where((F.col("pages") >= least_pages) & (F.col("held") > 1000 * bulk * F.col("pages"))).select("host", (-1 - F.col("path")).alias("path"))
    return low.union(wide).union(site.where(F.col("pages") >= least_pages).select("host", F.lit(0).cast("long")))


def article(html: str, low: set[int]) -> str:
    """The page's blocks without those whose element style rules out or has low importance on its host; low is what
    unimportant() has for it.

    Style is a prior only. Blocks that it takes for the article go like others if they are of low importance, unless more would
    go of it than stays on the page: then the host's pages are copies of each other, and the article stays. Where the host
    has too few pages to judge, the article's blocks stay alone if they are at least half of the text. An article in a
    marked wrapper counts on pages that have no other."""
    blocks = [(above[-1], text) for above, text in parse(html, {-1 - path for path in low if path < 0})[1] if above[-1].prior != 0]
    best = max((node.prior for node, _ in blocks if node.prior), default=1)
    found = [(node.prior == best, node.path in low and node.tag not in ("", "html", "body"), text) for node, text in blocks if node.prior in (best, None)]
    size = lambda rows: sum(len(text) for *_, text in rows)
    kept = [x for x in found if not x[1]]
    if size(x for x in found if x[0] and x[1]) > size(kept):
        kept = [x for x in found if x[0] or not x[1]]
    styled = [x for x in kept if x[0]]
    if 0 not in low and 2 * size(styled) >= size(kept):
        kept = styled or kept
    return "\n".join(text for *_, text in kept)


def extract(pages: DataFrame, bound: int = 200_000) -> DataFrame:
    """page_id, url, text: the main text of each page; a null or empty html gives an empty text, a null url is a host of
    its own name. Every row of pages gives a row; other columns are left out.

    The pruned nodes and judged hosts are few: up to ``bound`` of them go to every task. Beyond that they are joined by host, as one set for
    each host, and adaptive execution splits the pages of a hot host."""
    low = checkpointed(unimportant(pages))
    many = low.limit(bound + 1).count() > bound
    held = {} if many else low.groupBy("host").agg(F.collect_set("path").alias("low")).toPandas().set_index("host")["low"].map(set).to_dict()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(3).to_pylist() if many else [held.get(xxhash.xxh64_intdigest(host(u)) >> 1, ()) for u in batch.column(1).to_pylist()]
            text = [article(h or "", set(x or ())) for h, x in zip(batch.column(2).to_pylist(), sets)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    if many:
        rows = by_host(rows, low)
    return rows.mapInArrow(run, "page_id long, url string, text string")


def by_host(rows: DataFrame, low: DataFrame) -> DataFrame:
    """rows with low, the set of their host's pruned paths."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([xxhash.xxh64_intdigest(host(u)) >> 1 for u in b.column(1).to_pylist()], pa.int64())], ["page_id", "url", "html", "host"])

    named = rows.mapInArrow(name, "page_id long, url string, html string, host long")
    return named.join(low.groupBy("host").agg(F.collect_set("path").alias("low")), "host", "left").select("page_id", "url", "html", "low")

"""Main text of web pages by consensus host paths.

Every page is read into a light tree. Paragraph text scores the containers around it; the best container votes,
with its generalised tag-class path (digits become #), for the path of its host. Votes are summed in Spark, each
host's strongest path is joined back, and the page is read again: containers on the winning path are the article,
and a page without one falls back to its own best container. Menus, notices, comments and the like are left out
inside containers too, but not an element marked like that around most of the page's text.

Winning paths are as many as hosts. They are broadcast only while their measured size is within a bound; beyond
it the join shuffles by host, which Spark splits where a host is hot.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize

#: Bytes of winning paths that may be broadcast.
BROADCAST_BYTES = 4 << 20
#: Elements that are nested deeper stand beside each other, as browsers do it too.
DEPTH = 256

# Fixed values of HTML: elements without content, with raw text, and such that a start tag closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
# Elements of other languages, where in them HTML begins again, and HTML elements that end them.
_FOREIGN, _INTEGRATION = frozenset(("svg", "math")), frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Blocks that belong to a container around them.
_HELD = frozenset("p h1 h2 h3 h4 h5 h6 li pre td th tr tbody ul ol dl dt dd table blockquote figure figcaption".split())
_CLOSES_P = _BLOCK - frozenset("html body td th tr tbody thead tfoot".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body table ul ol dl article section main div td th aside nav header footer form blockquote svg math foreignobject".split())
# Elements and words of class names or ids that are not part of an article.
_OUT = frozenset("nav aside footer form button select dialog menu object audio video canvas head script style textarea title noscript template iframe svg annotation annotation-xml xmp".split())
_OUT_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus disclaimer footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup popular promo promoted promotion rail recommended related replies reply respond search share sharing sidebar signup skip skyscraper social sponsor sponsored sponsors subscribe subscription tagcloud tags toc toolbar topbar widget widgets".split()
)
# Words of class names that also stand at an element around the whole page, to tell how it is laid out.
_LAYOUT_WORDS = frozenset("ad ads advert adverts advertising banner breadcrumb breadcrumbs header footer menu nav navbar navigation notice notices pager pagination promo rail search share sharing sidebar social tags toc toolbar topbar widget widgets".split())
# Why an element is left out: for good, by its class or id, or by a mark that an element around the whole page may have too.
_FIRM, _CLASS, _LAYOUT = 1, 2, 3
# A class or id with "header" is the site's unless one of these words tells that it is the article's.
_ARTICLE_WORDS = frozenset("article content entry post story title".split())
_SPACE, _TAG_NAME = re.compile(r"[ \t\n\r\f/]*+"), re.compile(r"[^ \t\n\r\f/>]++")
_ATTRIBUTE_NAME, _EQUALS, _BARE_VALUE = re.compile(r"=?[^ \t\n\r\f/>=]*+"), re.compile(r"[ \t\n\r\f]*+=[ \t\n\r\f]*+"), re.compile(r"[^ \t\n\r\f>]*+")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\r\f/>])", re.I | re.A) for name in _RAW | _FOREIGN}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "label", "parent", "parts", "out", "link", "heading", "depth", "foreign", "holder", "holds")

    def __init__(self, tag: str, label: str, parent: Node | None, out: int, link: bool):
        self.tag, self.label, self.parent, self.out, self.link = tag, label, parent, out, link
        self.parts: list = []
        self.heading = self.holds = False  # holds: an article or main element that is not left out is under it
        self.depth = parent.depth + 1 if parent is not None else 0
        self.foreign = tag in _FOREIGN or parent is not None and parent.foreign and parent.tag not in _INTEGRATION
        #: The container that the node's text counts for.
        self.holder = self if parent is None or tag in _BLOCK and tag not in _HELD else parent.holder

    def path(self) -> str:
        labels, node = [], self
        while node is not None and node.tag not in ("html", "body", ""):
            labels.append(node.label)
            node = node.parent
        return ">".join(reversed(labels))


def _is_out(tag: str, attributes: dict[str, str]) -> int:
    """Why an element is left out, 0 if it is not."""
    if tag in _OUT and tag != "form":
        return _FIRM
    out = _LAYOUT if tag == "form" else 0
    if not attributes:
        return out
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ("navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert"):
        return _FIRM
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return _FIRM
    if tag in ("html", "body", "main"):
        return 0
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in ("has", "no", "with", "without", "js") and (not _OUT_WORDS.isdisjoint(words) or "header" in words and _ARTICLE_WORDS.isdisjoint(words)):
            if not _LAYOUT_WORDS.issuperset(_OUT_WORDS.intersection(words)):
                return _CLASS
            out = _LAYOUT
    return out


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """("text", text), ("start", name, attributes, whether it closes itself) and ("end", name) of a page, in one pass forward.

    The states are those of the HTML standard: a quote opens only a value, and an unfinished tag or comment at the
    page's end is dropped. Only a quote that is never closed ends at the next >, so that no text is lost behind it.
    Contents of raw elements are left out. So that nothing behind them is lost either, a raw or foreign element that
    closes itself is empty, and so is one without an end tag, but for scripts and styles: what follows those is theirs.
    """
    at, n, unclosed = 0, len(page), set()
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", page[at:], {}, False
            return
        if begin > at:
            yield "text", page[at:begin], {}, False
        head = page[begin + 1 : begin + 2]
        closing = head == "/"
        letter = page[begin + 2 : begin + 3] if closing else head
        if letter.isascii() and letter.isalpha():
            name = _TAG_NAME.match(page, begin + 1 + closing)
            at = name.end()
            attributes: dict[str, str] = {}
            bare_end = -1
            while True:
                at = _SPACE.match(page, at).end()
                if at >= n:
                    return
                if page[at] == ">":
                    break
                key = _ATTRIBUTE_NAME.match(page, at)
                at, value = key.end(), ""
                equals = _EQUALS.match(page, at)
                if equals:
                    at = equals.end()
                    quote = page[at : at + 1]
                    if quote and quote in "\"'":
                        end = -1 if quote in unclosed else page.find(quote, at + 1)
                        if end < 0:
                            unclosed.add(quote)
                            end = page.find(">", at)
                            if end < 0:
                                return
                            value, at = page[at + 1 : end], end
                        else:
                            value, at = page[at + 1 : end], end + 1
                    else:
                        bare = _BARE_VALUE.match(page, at)
                        value, at = bare[0], bare.end()
                        bare_end = at
                attributes.setdefault(key[0].lower(), value)
            low = name[0].lower()
            alone = page[at - 1] == "/" and at != bare_end
            end = None
            if not closing and not alone and (low in _RAW or low in _FOREIGN):
                end = None if low in unclosed else _RAW_END[low].search(page, at)
                if end is None:
                    unclosed.add(low)
                    if low in ("script", "style"):
                        return
                    alone = True
            yield ("end" if closing else "start"), low, attributes, alone
            at = end.start() if end is not None and low in _RAW else at + 1
        elif page.startswith("!--", begin + 1):
            if page.startswith((">", "->"), begin + 4):
                at = page.find(">", begin) + 1
                continue
            end = _COMMENT_END.search(page, begin + 4)
            if end is None:
                return
            at = end.end()
        elif head and head in "!?/":
            end = page.find(">", begin)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "<", {}, False
            at = begin + 1


def parse(page: str) -> Node:
    """The page's tree. Tags that are not closed end where HTML lets them end; stray end tags are ignored."""
    root = Node("", "", None, 0, False)
    node = root
    for kind, name, attributes, alone in tokens(page):
        if kind == "text":
            node.parts.append(name)
            continue
        if kind == "end":
            up = node
            while up.parent is not None and up.tag != name and not (up.tag in _SCOPE and name not in _BLOCK):
                up = up.parent
            if up.parent is not None and up.tag == name:
                node = up.parent
            continue
        if name in _BREAKOUT:
            while node.foreign and node.tag not in _INTEGRATION:
                node = node.parent
        closes = _CLOSED_BY.get(name, ())
        if name in _CLOSES_P:
            closes = (*closes, "p")
        for closed in closes:
            up = node
            while up.parent is not None and up.tag != closed and (up.tag not in _SCOPE or (up.tag in ("td", "th") and closed == "tr")):
                up = up.parent
            if up.parent is not None and up.tag == closed:
                node = up.parent
        if name in _VOID:
            node.parts.append(None if name == "hr" else " ")
            continue
        label = name
        if "class" in attributes:
            label = ".".join([name, *sorted(_DIGITS.sub("#", c) for c in attributes["class"].split())])
        child = Node(name, label, node, _is_out(name, attributes), name == "a" or node.link)
        node.parts.append(child)
        if not alone and child.depth < DEPTH:
            node = child
        if name in ("h1", "h2", "h3"):
            up = child
            while up is not None and not up.heading:
                up.heading = True
                up = up.parent
    _keep_wrappers(root)
    _mark_articles(root)
    return root


def _in_order(root: Node) -> list[Node]:
    """All nodes, each before those under it."""
    order = [root]
    for node in order:
        order += [p for p in node.parts if isinstance(p, Node)]
    return order


def _mark_articles(root: Node) -> None:
    for node in reversed(_in_order(root)):
        node.holds = any(isinstance(p, Node) and (p.holds or p.tag in ("article", "main") and not p.out) for p in node.parts)


def _keep_wrappers(root: Node) -> None:
    """Unmarks elements that hold more than half of the page's unlinked text by their layout mark, unless an article is marked up."""
    order, stack, layout = [], [root], False
    while stack:
        node = stack.pop()
        if node.out in (_FIRM, _CLASS) or node.tag == "header":
            continue
        if node.tag in ("article", "main") and not node.out:
            return
        layout = layout or node.out == _LAYOUT
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    if not layout:
        return
    sizes: dict[Node, int] = {}
    for node in reversed(order):
        own = 0 if node.link else sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        sizes[node] = sizes.get(node, 0) + own
        if node.parent is not None:
            sizes[node.parent] = sizes.get(node.parent, 0) + sizes[node]
    for node in order:
        if node.out == _LAYOUT and 2 * sizes[node] > sizes[root]:
            node.out = 0


def _keep_classes(root: Node) -> None:
    """Unmarks forms and all elements that are left out by class or id."""
    for node in _in_order(root):
        if node.out != _FIRM:
            node.out = 0
    _mark_articles(root)


def _left_out(node: Node, within: bool) -> bool:
    """A header is kept where it stands within an article and has a heading; an element that holds an article is never left out."""
    if node.tag == "header":
        return bool(node.out) or not (within and node.heading)
    return bool(node.out)


def blocks(node: Node, within: bool = False) -> list[str]:
    """Texts of the blocks under a node, in page order, white space collapsed, character references decoded."""
    out: list[str] = []
    run: list[str] = []

    def close():
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack = [iter(node.parts)]
    blocky = [True]
    inside = [within or node.tag in ("article", "main")]
    while stack:
        for part in stack[-1]:
            if part is None:
                close()
            elif isinstance(part, str):
                run.append(part)
            elif part.tag not in _RAW and not (_left_out(part, inside[-1]) and not part.holds):
                stack.append(iter(part.parts))
                blocky.append(part.tag in _BLOCK)
                inside.append(inside[-1] or part.tag in ("article", "main"))
                if blocky[-1]:
                    close()
                break
        else:
            stack.pop()
            inside.pop()
            if blocky.pop():
                close()
    return out


def best_container(root: Node) -> tuple[Node, float] | None:
    """The container with the highest score, and the score: characters of paragraph text, links discounted.

    A paragraph scores its container in full and the one above by half; an article or main element around the
    winner takes its place, and else the nearest container that adds a heading and little other text.
    """
    scores: dict[Node, float] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        text, linked = 0, 0
        for part in node.parts:
            if isinstance(part, str):
                text += len(part.strip())
            elif part is not None and part.tag not in _RAW and not (part.tag != "header" and part.out and not part.holds):
                stack.append(part)
        if node.link:
            linked = text
        holder = node.holder
        if text and holder.tag != "header":
            gain = text - 2 * linked
            scores[holder] = scores.get(holder, 0) + gain
            if holder.parent is not None:
                scores[holder.parent] = scores.get(holder.parent, 0) + gain / 2
    scores = {n: s for n, s in scores.items() if s > 0}
    if not scores:
        return None
    best = max(scores, key=scores.get)
    score, up = scores[best], best
    while up is not None:
        if up.tag in ("article", "main"):
            return up, score
        up = up.parent
    return (best if best.heading else _with_heading(best)), score


def _size(parts: list, tag: str) -> int:
    """Characters of the blocks of some parts of an element."""
    beside = Node(tag, tag, None, 0, False)
    beside.parts = parts
    return sum(map(len, blocks(beside)))


def _with_heading(best: Node) -> Node:
    """The nearest container above that adds a heading and little other text. What stands beside a container is read once: a block's text is that of its parts."""
    own = size = _size(best.parts, best.tag)
    down, up = best, best.parent
    while up is not None and up.tag not in ("", "html", "body"):
        size = size + _size([None if p is down else p for p in up.parts], up.tag) if down.tag in _BLOCK else _size(up.parts, up.tag)
        if size > 1.3 * own + 200:
            break
        if up.heading:
            return up
        down, up = up, up.parent
    return best


def _on_path(root: Node, path: str) -> list[Node]:
    """Outermost nodes with the path, in page order."""
    if not path:
        return []
    labels, found = path.split(">"), []

    def walk(node, depth):
        for part in node.parts:
            if isinstance(part, Node):
                if part.tag in ("html", "body"):
                    walk(part, depth)
                elif part.label == labels[depth]:
                    if depth + 1 == len(labels):
                        if not part.out:
                            found.append(part)
                    else:
                        walk(part, depth + 1)

    walk(root, 0)
    return found


def vote(page: str) -> tuple[str, float] | None:
    best = best_container(parse(page))
    return (best[0].path(), best[1]) if best else None


def extract(page: str, path: str | None) -> str:
    """The article of a page: its containers on the host's path, or its own best container.

    Where nothing is left, forms and what is left out by class or id count too.
    """
    if not page:
        return ""
    root = parse(page)
    found = [b for node in _on_path(root, path) for b in blocks(node)] if path else []
    if not found:
        best = best_container(root)
        found = blocks(best[0]) if best else []
    if not found:
        _keep_classes(root)
        best = best_container(root)
        found = blocks(best[0]) if best else []
    return "\n\n".join(found)


def host(url: str = "url"):
    """Lower-cased host and port; "" where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path, votes, weight): the path of each host that most of its pages' best containers have.

    Ties go to the larger text, then to the path that sorts first.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            hosts, pages = batch.column("__host"), batch.column("__html")
            rows = {}
            for i in range(batch.num_rows):
                voted = vote(pages[i].as_py())
                if voted and voted[0]:
                    key = (hosts[i].as_py(), voted[0])
                    n, w = rows.get(key, (0, 0.0))
                    rows[key] = (n + 1, w + voted[1])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array([v[0] for v in rows.values()], pa.int64()), pa.array([v[1] for v in rows.values()], pa.float64())], ["host", "path", "n", "w"])

    votes = pages.where(F.col(page).isNotNull()).select(host(url).alias("__host"), F.col(page).alias("__html")).mapInArrow(run, "host string, path string, n long, w double")
    summed = votes.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum(F.round("w")).alias("w"))
    best = summed.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("w")).alias("w"), "path")).alias("b"))
    return best.select("host", "b.path", (-F.col("b.n")).alias("votes"), (-F.col("b.w")).alias("weight"))


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", page: str = "html") -> DataFrame:
    """Columns `keep`, and text: the page's article, blocks joined by an empty line ("" where there is none).

    A null or empty page has no text; a null or malformed url has the host ""; repeated rows stay. keep must not hold
    the name text; other columns of any name are left out.
    """
    if "text" in {k.lower() for k in keep}:
        raise ValueError("a column to keep has the name of the result: text")
    from pyspark.sql.types import StringType, StructType

    paths = materialize(host_paths(pages, url, page).select("host", "path"))
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    paths = paths.withColumnsRenamed({"host": "__host", "path": "__path"})
    source = pages.select(*keep, host(url).alias("__host"), F.coalesce(page, F.lit("")).alias("__html"))
    joined = source.join(F.broadcast(paths) if size <= BROADCAST_BYTES else paths, "__host", "left").select(*keep, "__html", "__path")
    schema = StructType([pages.schema[k] for k in keep]).add("text", StringType())

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            pages, paths = batch.column("__html"), batch.column("__path")
            texts = [extract(pages[i].as_py(), paths[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return joined.mapInArrow(run, schema)

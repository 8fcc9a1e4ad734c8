"""Main text of pages: site templates found by counting element subtrees per host, then removed.

A first pass hashes the subtrees of every page, inside its main elements and outside, and counts, in Spark, on how
many different pages of a host each occurs. A second pass drops the subtrees that recur, along with elements that
never hold main text by their tag, role or class, and writes the blocks that remain.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import small_side
from riskweave.session import materialise

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = RAW | frozenset("head nav header footer aside form button select svg canvas object template dialog menu label audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
#: Names of parts that are not main text. A class or id counts if it consists of such names alone: "ad", "cookie-notice", but not "with-sidebar".
_PART = (
    r"(?:ad|ads|advert\w*+|adsense|banner|sponsor\w*+|promo\w*+|cookie\w*+|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|nav|navbar|navigation|menu|"
    r"breadcrumbs?|sidebar|side-bar|footer|masthead|comments?|commentlist|disqus|respond|share|sharing|social|related|recommended|widget|pagination|pager|skip-link|toolbar|login)"
)
PARTS = re.compile(rf"(?:^|(?<=\s)){_PART}(?:[_-]{_PART})*(?=$|\s)", re.IGNORECASE)
#: An open tag is closed by one of these that follows, up to the nearest of the second set.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "td", "th", "tr", "li", "dd", "dt", "caption", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption"} | {"li", "dd", "dt", "td", "th", "tr"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "head": {"body"},
}
CLOSERS = {tag: [open_ for open_, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}
INLINE = frozenset("a abbr b big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split())
#: Running text: its id is an anchor that readers jump to, and names no part of the page.
PROSE = frozenset("p blockquote pre".split())
#: Never taken for a part of the site on their own, only with a recurring element around them.
LONE = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot blockquote q pre caption figcaption legend summary".split())
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag up to its end, quoted parts whole; nothing else is tried where it stops.
TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
#: Decimal references whose digits are more than the interpreter reads as one number.
LONG_NUMBER = re.compile(r"&#([0-9]{9,});?")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANKS = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)  # nodes and strings


def unescape(text: str) -> str:
    """Character references decoded; a number of any length is read, one past Unicode becomes U+FFFD."""
    if "&#" in text:
        text = LONG_NUMBER.sub(lambda m: f"&#{digits};" if len(digits := m[1].lstrip("0") or "0") < 9 else "\ufffd", text)
    return html.unescape(text)


class OpenElements:
    """The elements open at a place, and where each tag, block and limit stands among them.

    With those places an end tag or an implied end is found in constant time, however deep elements nest.
    """

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.limits: list[int] = [0]  # open elements that no implied end reaches across

    def push(self, node: Node) -> None:
        at, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        if tag not in INLINE and tag not in CLOSED_BY:
            self.limits.append(at)

    def cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]
        for places in (self.blocks, self.limits):
            while places and places[-1] >= at:
                places.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def end(self, tag: str) -> None:
        """An end tag closes the nearest element of its tag; one of an inline element does not reach across blocks."""
        at = self.last(tag)
        if at and not (tag in INLINE and self.blocks and self.blocks[-1] > at):
            self.cut(at)

    def imply_ends(self, tag: str) -> None:
        """Close what a start tag closes, up to the nearest limit."""
        openers = CLOSERS.get(tag, ())
        while openers and (at := max(map(self.last, openers))) > self.limits[-1]:
            self.cut(at)


def parse(source: str) -> Node:
    """A tree of elements and texts in linear time; never fails, and needs no closing tags.

    Elements nest in lists, not in calls, so depth has no limit. Where a quote in a tag is open to the end of the
    page, that tag and all later ones end at their first ``>``; a tag without any is text.
    """
    root = Node("html")
    opened, pos, shown, n, quotes = OpenElements(root), 0, 0, len(source), True
    last_end = source.rfind(">")

    def text_until(end: int) -> None:
        if shown < end:
            opened.stack[-1].children.append(unescape(source[shown:end]))

    while (at := source.find("<", pos)) >= 0:
        if source.startswith("<!--", at):
            text_until(at)
            m = COMMENT_END.search(source, at + 4)
            pos = shown = m.end() if m else n
            continue
        name = NAME.match(source, at)
        if not name:
            if source.startswith(("<!", "<?", "</"), at):
                text_until(at)
                end = source.find(">", at)
                pos = shown = end + 1 if end >= 0 else n
            else:
                pos = at + 1
            continue
        if name.end() > last_end:
            break
        end = TAG_REST.match(source, name.end()).end() if quotes else n
        if end >= n or source[end] != ">":
            quotes, end = False, source.find(">", name.end())
        text_until(at)
        pos = shown = end + 1
        tag, rest = name[2].lower(), source[name.end() : end]
        if name[1]:
            opened.end(tag)
            continue
        opened.imply_ends(tag)
        node = Node(tag, rest)
        opened.stack[-1].children.append(node)
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            m = RAW_END[tag].search(source, pos)
            node.children.append(source[pos : m.start() if m else n])
            end = source.find(">", m.end()) if m else -1
            pos = shown = end + 1 if end >= 0 else n
            continue
        opened.push(node)
    text_until(n)
    return root


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def is_main(node: Node) -> bool:
    if node.tag in ("article", "main"):
        return True
    return bool(node.attributes) and ("articleBody" in node.attributes or attributes(node.attributes).get("role") == "main")


def is_dropped(node: Node) -> bool:
    """Parts that hold no main text whatever the site."""
    if node.tag in DROPPED:
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    a = attributes(node.attributes)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    names = [a.get("class", "")] if node.tag in PROSE else [a.get("class", ""), a.get("id", "")]
    return a.get("role", "").lower() in DROPPED_ROLES or any(map(PARTS.search, names))


def _walk(root: Node):
    """Nodes with their depth-first order, children before parents (no recursion)."""
    stack, out = [root], []
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return reversed(out)


def hash_of(values: list[int]) -> int:
    """A signed 64-bit hash of hashes in their order."""
    import xxhash

    value = xxhash.xxh64(b"".join(v.to_bytes(8, "little", signed=True) for v in values)).intdigest()
    return value - (1 << 64) if value >> 63 else value


def subtree_hashes(root: Node) -> dict[int, int]:
    """A 64-bit hash of each subtree (tag, folded text and children), by the node's ``id``; raw elements too."""
    import xxhash

    out: dict[int, int] = {}
    for node in _walk(root):
        h = xxhash.xxh64(node.tag.encode())
        for c in node.children:
            if isinstance(c, Node):
                h.update(b"\x01" + out[id(c)].to_bytes(8, "little", signed=True))
            elif c := BLANKS.sub(" ", c).strip():
                h.update(b"\x02" + c.encode("utf-8", "surrogatepass"))
        value = h.intdigest()
        out[id(node)] = value - (1 << 64) if value >> 63 else value
    return out


def holding_text(root: Node) -> set[int]:
    """The ``id`` of each node with text in or below it."""
    out: set[int] = set()
    for node in _walk(root):
        if any(id(c) in out if isinstance(c, Node) else c.strip() for c in node.children):
            out.add(id(node))
    return out


def main_elements(root: Node, texts: set[int]) -> list[Node]:
    """The outermost main elements in page order, or none if they hold no text.

    Those that are in dropped parts, or would be dropped themselves, count if there are no others with text.
    """
    for strict in (True, False):
        mains, stack = [], [root]
        while stack:
            node = stack.pop()
            if strict and is_dropped(node):
                continue
            if is_main(node):
                mains.append(node)
                continue
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if any(id(m) in texts for m in mains):
            return mains
    return []


def candidates(root: Node, mains: list[Node], texts: set[int]) -> list[Node]:
    """Subtrees that may belong to the site: with text, neither a main element nor around one, not dropped anyway.

    A lone heading, paragraph, list item, quotation, cell or inline element is none; what surrounds it may be.
    """
    tops = set(map(id, mains))
    around: set[int] = set()
    for node in _walk(root):
        if id(node) in tops or any(isinstance(c, Node) and id(c) in around for c in node.children):
            around.add(id(node))
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) not in around and is_dropped(node):
            continue
        if id(node) not in around and node.tag not in ("html", "body") and node.tag not in LONE and id(node) in texts:
            out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return out


def main_text(root: Node, removed: frozenset[int] | set[int]) -> str:
    """Blocks of text in page order, one a line, without the subtrees whose hashes are ``removed``.

    If the page has main elements, only what is in them counts; else all that is left. Main elements of which
    nothing would be left keep their text.
    """
    mains = main_elements(root, holding_text(root))
    if mains and removed and (text := _blocks(mains, removed, subtree_hashes(root))):
        return text
    return _blocks(mains, frozenset(), {}) if mains else _blocks([root], removed, subtree_hashes(root) if removed else {})


def _blocks(tops: list[Node], removed: frozenset[int] | set[int], hashes: dict[int, int]) -> str:
    lines, current = [], []

    def close():
        line = BLANKS.sub(" ", "".join(current)).strip()
        current.clear()
        if line:
            lines.append(line)

    for top in tops:
        close()
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                current.append(item)
            elif item is not top and (is_dropped(item) or hashes.get(id(item)) in removed):
                if item.tag in BLOCKS:
                    close()
            elif item.tag == "br":
                current.append(" ")
            else:
                block = item.tag in BLOCKS
                if block:
                    close()
                    todo.append(None)
                todo.extend(reversed(item.children))
        close()
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    """Host of a URL, lower-cased, without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html", min_pages: int = 3, share: float = 0.2) -> DataFrame:
    """``(page_id, url, text)``, a row for each row of ``pages``.

    A subtree, in a main element or outside, is the site's if it occurs on ``share`` or more, and on
    ``min_pages`` or more, of its host's pages whose bodies (main elements, or else the whole page) differ; copies of one body count once, so a page with many
    copies keeps its text. Null and empty pages give empty text. Pages of a null or hostless URL share the empty host. Repeated rows each get
    their row. Extra columns are ignored.
    """
    key = F.xxhash64(F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html_column), F.lit("")))
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html"), host_of(F.col(url)).alias("host"), key.alias("key"))

    def hashed(frames):
        for f in frames:
            rows = []
            for host, k, source in zip(f["host"], f["key"], f["html"]):
                root = parse(source or "")
                hashes = subtree_hashes(root)
                texts = holding_text(root)
                mains = main_elements(root, texts)
                body = hash_of([hashes[id(m)] for m in mains]) if mains else hashes[id(root)]
                found = {hashes[id(node)] for node in candidates(root, mains, texts)}
                rows.extend((host, k, body, subtree) for subtree in (None, *found))
            # As objects: pandas makes floats of integers beside None.
            yield pd.DataFrame(rows, columns=["host", "key", "body", "subtree"], dtype=object).astype({"key": "int64", "body": "int64", "subtree": "Int64"})

    found = given.select("host", "key", "html").mapInPandas(hashed, "host string, key long, body long, subtree long")
    found = materialise(found, "subtrees")
    # The row without a subtree counts the page itself.
    counted = found.select("host", "subtree", "body").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    counted = materialise(counted, "counted")
    sizes = counted.where("subtree is null").select("host", F.col("n").alias("pages"))
    recurring = counted.where("subtree is not null").join(small_side(sizes, 64), "host").where(F.col("n") >= share * F.col("pages")).select("host", "subtree")
    removed = found.where("subtree is not null").select("host", "subtree", "key").distinct().join(recurring, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("removed"))
    removed = materialise(removed, "removed")

    @F.pandas_udf("string")
    def text_of(sources: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([main_text(parse(s or ""), set(g.tolist()) if g is not None else frozenset()) for s, g in zip(sources, gone)], dtype=object)

    joined = given.join(small_side(removed, 256), "key", "left")
    return joined.select("page_id", "url", text_of("html", "removed").alias("text"))

"""Main text of web pages by consensus host paths.

Every page scores its containers: a block of text counts for the element it
stands in, half for the element around that, less its link text.  The best
container's path, tags and classes without digits, is the page's vote.  Votes
are summed per host in Spark; each page is then read again under its host's
winning path, and falls back to its own best container where it has no such
element.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are cut by their tag, role or class before scoring and
extraction alike.  A heading inside the article is part of it.  A tag ends at the
last > of the page at the latest; an open comment reaches to the end.  Null or empty
html, and pages without text, give an empty text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SIBLING_SCOPE = frozenset("ul ol dl table select article section div body".split())

DROPPED_TAGS = frozenset("nav header footer aside form script style noscript template textarea title head iframe svg math canvas object button select menu dialog noembed noframes xmp audio video map search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark an element as no part of the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted "
    "promotion recommended related replies responses share sharing sidebar skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
#: An element that holds these marks the article itself, whatever else its class says.
ARTICLE_TAGS = frozenset(["article", "main"])

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|$))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:[\"'][^>]*+)?)>|<[!?/][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_COMMENT_END = re.compile(r"<!--(?:>|->)|-->|--!>")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass(slots=True)
class Node:
    tag: str
    part: str  # what the element adds to its path; empty for inline elements
    digest: Digest  # of the whole path
    parent: Node | None
    dropped: bool
    link: bool
    score: float = 0.0
    order: int = 0


class Digest:
    """Digest of a path, extended part by part, so that deep pages need no path strings."""

    __slots__ = ("hasher", "value")

    def __init__(self, hasher):
        self.hasher, self.value = hasher, hasher.digest()

    def longer(self, part: str) -> Digest:
        hasher = self.hasher.copy()
        hasher.update(part.encode("utf-8", "surrogatepass"))
        return Digest(hasher)


def _digest(path: str) -> Digest:
    return Digest(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16))


def path_of(node: Node) -> str:
    """Tags and classes from the root to the element."""
    parts = []
    while node is not None:
        parts.append(node.part)
        node = node.parent
    return "".join(reversed(parts))


@dataclass(slots=True)
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def _attributes(source: str) -> dict[str, str]:
    return {m[0].lower(): entities.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(source)} if source.strip(" /\t\n") else {}


def _drops(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROPPED_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ARTICLE_TAGS or tag in ("body", "html"):
        return False
    named = attributes.get("class", "") + " " + attributes.get("id", "")
    return not DROPPED_WORDS.isdisjoint(_WORD.findall(_CAMEL.sub(" ", named).lower())) if named != " " else False


def blocks_of(html: str) -> list[Block]:
    """Blocks of text outside dropped elements, in page order, with the elements they stand in."""
    root = Node("", "", _digest(""), None, False, False)
    stack, out, count = [root], [], 0
    open_tags: Counter = Counter()  # elements on the stack by tag: most searches of it need not start
    current: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.dropped or not text:
            return
        if current is None:
            if text.isspace():
                return
            home = top
            while home.tag in INLINE and home.parent is not None:
                home = home.parent
            current = Block(home)
            out.append(current)
        current.parts.append(text)
        if top.link:
            current.linked += len(text)

    def close_to(depth: int) -> None:
        nonlocal current
        if any(n.tag not in INLINE for n in stack[depth:]):
            current = None
        open_tags.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    def push(node: Node) -> None:
        stack.append(node)
        open_tags[node.tag] += 1

    size = len(html)
    last = html.rfind(">") + 1  # no tag ends beyond; an open comment reaches to the end
    while at < size:
        m = _MARKUP.search(html, at, last) if at < last else None
        if m is None:
            comment = html.find("<!--", at)
            add(html[at:] if comment < 0 else html[at:comment])
            break
        add(html[at : m.start()])
        at = m.end()
        if at == last and html.startswith("<!--", m.start()) and not _COMMENT_END.search(html, m.start(), at):
            break
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "br":
                add(" ")
            depth = len(stack) - 1 if open_tags[tag] else 0
            while depth and stack[depth].tag != tag:
                if tag in INLINE and stack[depth].tag not in INLINE:
                    depth = 0
                    break
                depth -= 1
            if depth:
                close_to(depth)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                add(" ")
            continue
        if tag in CLOSES_P:
            depth = len(stack) - 1 if open_tags["p"] else 0
            while depth and stack[depth].tag != "p" and (stack[depth].tag in INLINE):
                depth -= 1
            if depth and stack[depth].tag == "p":
                close_to(depth)
        elif tag in SIBLINGS:
            depth = len(stack) - 1 if any(open_tags[t] for t in SIBLINGS[tag]) else 0
            while depth and stack[depth].tag not in SIBLING_SCOPE:
                if stack[depth].tag in SIBLINGS[tag]:
                    close_to(depth)
                    break
                depth -= 1
        attributes = _attributes(m.group(3))
        if tag not in INLINE:
            current = None
        if tag in VOID:
            continue
        top = stack[-1]
        if tag in INLINE:
            part, digest = "", top.digest
        else:
            classes = " ".join(sorted(_DIGITS.sub("", c) for c in attributes.get("class", "").split()))
            part = f">{tag}.{classes}" if classes.strip() else f">{tag}"
            digest = top.digest.longer(part)
        count += 1
        dropped = top.dropped or _drops(tag, attributes)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            body = html[at : end.start() if end else size]
            at = end.start() if end else size
            push(Node(tag, part, digest, top, dropped, top.link))
            if not dropped:
                add(body)
            continue
        if m.group(3).endswith("/") and tag in ("svg", "math", "path"):
            continue
        push(Node(tag, part, digest, top, dropped, top.link or tag == "a", 0.0, count))
    return out


def best_container(blocks: list[Block]) -> Node | None:
    """The element with the highest score; the earliest of equals."""
    scored: dict[int, Node] = {}
    for block in blocks:
        gain = sum(map(len, block.parts)) - 2 * block.linked
        home = block.node
        if home.tag in ("p", "li", "pre", "td", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "figcaption") and home.parent is not None:
            home = home.parent
        share, node = 1.0, home
        for _ in range(3):
            if node is None:
                break
            boost = 2.0 if node.tag in ARTICLE_TAGS else 1.0
            node.score += gain * share * boost
            scored[id(node)] = node
            node, share = node.parent, share / 2
    best = max(scored.values(), key=lambda n: (n.score, -n.order), default=None)
    return best


def _under(blocks: list[Block], chosen: Callable[[Node], bool]) -> list[Block]:
    """Blocks in or under a chosen element; every element is asked once."""
    known: dict[int, bool] = {}
    out = []
    for block in blocks:
        node, climbed = block.node, []
        while node is not None and id(node) not in known and not chosen(node):
            climbed.append(id(node))
            node = node.parent
        found = node is not None and known.get(id(node), True)
        if node is not None:
            known[id(node)] = found
        known.update(dict.fromkeys(climbed, found))
        if found:
            out.append(block)
    return out


def main_text(html: str | None, path: str | None = None) -> str:
    """Text under the elements of the path, or else of the best container."""
    blocks = blocks_of(html or "")
    chosen: list[Block] = []
    if path is not None:
        wanted = _digest(path).value
        chosen = _under(blocks, lambda n: n.digest.value == wanted and n.tag not in INLINE)
    if not chosen:
        best = best_container(blocks)
        chosen = _under(blocks, lambda n: n is best) if best is not None else []
    return " ".join(t for t in (b.text() for b in chosen) if t)


def host_of(column: str):
    """Lower-case host of a URL without port; empty for null or other strings."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(column), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter = Counter()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            best = best_container(blocks_of(html or ""))
            if best is not None:
                votes[host, path_of(best)] += 1
        if votes:
            yield pa.RecordBatch.from_pydict({"host": [k[0] for k in votes], "path": [k[1] for k in votes], "votes": list(votes.values())})


def host_paths(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, path): the path with the most votes of each host's pages, the first by name among equals."""
    rows = pages.select(host_of(url_column).alias("host"), F.col(html_column).alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), F.col("path").alias("path"))).alias("won")).select("host", "won.path")


_TEXTS = "page_id bigint, url string, text string, n_chars bigint"


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    The winning paths are written first, so Spark knows their size and sends
    them to all tasks only if they are small; else pages meet them by host.
    """
    paths = materialize(host_paths(pages, url_column, html_column), "host-paths")
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), host_of(url_column).alias("host"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, path) for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(work, _TEXTS)

"""Pages of HTML: a small tree and what is taken from it, inside Arrow batches. No page meets another, nothing is shuffled."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from yelken.functions import text, urls
from yelken.lexicon import NOISE_NAMES, SILENT_TAGS
from yelken.operators.timestamps import find_date, parse_instant

NOISE_SHARE = 0.6  # a block that holds at least this share of the paragraphs' text is the story whatever its name
LEAST_BODY = 150
_BLOCKS = {"p", "h2", "h3", "h4", "li", "blockquote"}
_OUTER = {"p", "li", "blockquote"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
_ENDS_P = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "table", "header", "footer", "main", "nav", "aside", "form", "figure", "hr", "pre", "dl"}
# Types of structured data that may describe a story.
STORY_TYPES = {"NewsArticle", "Article", "ReportageNewsArticle", "BlogPosting", "WebPage"}


def _name_pattern() -> re.Pattern:
    """Names anywhere in a class or id, those marked whole only between word ends; a hyphen in a name may be missing."""
    free = [w.replace("-", "-?") for w, whole in NOISE_NAMES if not whole]
    alone = [w for w, whole in NOISE_NAMES if whole]
    return re.compile("|".join(free) + "|" + rf"(?:\b|[-_])(?:{'|'.join(alone)})(?:\b|[-_])", re.I)


_NOISE_NAME = _name_pattern()


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This node and all below, in order of the page; not recursive, as pages can be deep."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def texts(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return out

    def paragraph_length(self, direct: bool = False) -> int:
        found = (c for c in self.children if isinstance(c, Node)) if direct else self.walk()
        return sum(len(joined(n.texts())) for n in found if n.tag == "p")


def joined(parts: list[str]) -> str:
    return " ".join(p.strip() for p in parts if p.strip())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        open_tags = []
        node = self.at
        while node.parent is not None:
            open_tags.append(node.tag)
            node = node.parent
        if tag in _ENDS_P and "p" in open_tags and not {"li", "td", "blockquote"} & set(open_tags[: open_tags.index("p")]):
            self.handle_endtag("p")
        elif tag == "li" and "li" in open_tags and not {"ul", "ol"} & set(open_tags[: open_tags.index("li")]):
            self.handle_endtag("li")
        made = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        if tag not in _VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(page: str) -> Node:
    """The page's tree; comments are left out, unclosed paragraphs and list items end where the next block begins."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def without_noise(root: Node) -> Node:
    """The tree without silent elements and without blocks named as furniture that hold less than NOISE_SHARE of the paragraphs' text."""
    for node in root.walk():
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in SILENT_TAGS]
    total = root.paragraph_length() or 1
    for node in root.walk():
        node.children = [c for c in node.children if isinstance(c, str) or not _NOISE_NAME.search(f"{c.attrs.get('class', '')} {c.attrs.get('id', '')}") or c.paragraph_length() / total >= NOISE_SHARE]
    return root


def lines_of_page(page: str | None) -> list[str]:
    """Lines of a page's paragraphs, subheadings, list items and quotations, those inside one another once; of a page without any all its text."""
    if not page:
        return []
    root = without_noise(tree(page))
    for node in root.walk():
        node.children = ["\n" if not isinstance(c, str) and c.tag == "br" else c for c in node.children]
    blocks, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in _BLOCKS:
            blocks.append(node)
        if node.tag not in _OUTER:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    if not blocks:
        return "\n".join(root.texts()).split("\n")
    return [line for b in blocks for line in " ".join(b.texts()).split("\n")]


def body_of_page(page: str | None, selectors: tuple[tuple[str, str], ...] = ()) -> list[str]:
    """Lines of the block that holds the story: the first that a selector (tag, word of its class; either may be '') finds with more than LEAST_BODY
    characters, else the block with most text in paragraphs of its own if that is long enough, else all paragraphs."""
    if not page:
        return []
    root = tree(page)
    for tag, name in selectors:
        for node in root.walk():
            if (not tag or node.tag == tag) and (not name or name in node.attrs.get("class", "").split()) and node.tag:
                if len(joined(node.texts())) > LEAST_BODY:
                    return [joined([x]) for x in node.texts() if x.strip()]
                break
    best, most = None, 0
    for node in root.walk():
        if node.tag in ("article", "div", "section", "main") and (n := node.paragraph_length(direct=True)) > most:
            best, most = node, n
    if best is not None and most >= LEAST_BODY:
        return [joined([x]) for x in best.texts() if x.strip()]
    return [joined(n.texts()) for n in root.walk() if n.tag == "p"]


def _objects(data: object) -> Iterator[dict]:
    if isinstance(data, list):
        for item in data:
            yield from _objects(item)
    elif isinstance(data, dict):
        yield from _objects(data.get("@graph", []))
        yield data


def story_data(page: str | None) -> dict:
    """The structured data of a page's story: the last NewsArticle, else the first other of STORY_TYPES, that has a headline or body."""
    best: dict = {}
    for script in re.findall(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", page or "", re.S | re.I):
        for raw in (script, re.sub(r"[\r\n\t]+", " ", script)):
            try:
                data = json.loads(raw, strict=False)
            except ValueError:
                continue
            for x in _objects(data):
                kinds = x.get("@type")
                kinds = {k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)}
                if kinds & STORY_TYPES and (x.get("headline") or x.get("articleBody")) and ("NewsArticle" in kinds or not best):
                    best = x
            break
    return best


def _over(f: Callable[[str | None], object], kind: DataType):
    @F.pandas_udf(kind)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(f)

    return run


_LD = StructType([StructField(f, StringType()) for f in ("headline", "articleBody", "description", "datePublished", "dateCreated")])
_LINES = ArrayType(StringType())
_lines, _all_text = _over(lines_of_page, _LINES), _over(lambda p: joined(tree(p).texts()) if p else "", StringType())


@F.pandas_udf(_LD)
def _story(pages: pd.Series) -> pd.DataFrame:
    found = [story_data(p) for p in pages]
    text_of = lambda v: v if isinstance(v, str) else None
    return pd.DataFrame({k: [text_of(x.get(k)) for x in found] for k in ("headline", "articleBody", "description", "datePublished", "dateCreated")}, dtype=object)


def lines_of(page: Column) -> Column:
    """ARRAY<STRING>, see lines_of_page."""
    return _lines(page)


def body_lines(page: Column, selectors: tuple[tuple[str, str], ...] = ()) -> Column:
    """ARRAY<STRING>, see body_of_page."""
    return _over(lambda p: body_of_page(p, selectors), _LINES)(page)


def story(page: Column) -> Column:
    """STRUCT of the story's structured data, see story_data; fields that aren't texts are NULL."""
    return _story(page)


def canonical(page: Column, base: Column, fetched: Column, article: str) -> Column:
    """The page's canonical address if it is an article's (path matches ``article``) of the site, else the fetched one."""
    tag = F.regexp_extract(page, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'>\s]+)""", 1)
    own = urls.normalize_url(F.nullif(tag, F.lit("")), base)
    return F.coalesce(F.when(urls.is_article(own, article), own), fetched)


def published(page: Column, ld: Column, meta: Column, zone: Column) -> Column:
    """BIGINT instant of a page: structured data, metadata, the first time element, the first date in the text's first 4,000 characters."""
    iso = lambda c: parse_instant(F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), c), zone)
    tag = F.regexp_extract(page, r"(?is)<time\b([^>]*)>(.*?)</time>", 1)
    inner = F.regexp_replace(F.regexp_extract(page, r"(?is)<time\b[^>]*>(.*?)</time>", 1), "<[^>]*>", " ")
    stamp = F.coalesce(F.nullif(F.regexp_extract(tag, r"""(?i)datetime\s*=\s*["']([^"']+)""", 1), F.lit("")), inner)
    return F.coalesce(iso(ld["datePublished"]), iso(ld["dateCreated"]), iso(meta), parse_instant(stamp, zone), parse_instant(find_date(F.left(_all_text(page), F.lit(4000))), zone))


def cleaned(page: Column, title: Column) -> Column:
    """A page's story lines, cleaned and joined by LF."""
    made = text.normalize_unicode(F.array_join(lines_of(page), "\n"))
    return F.array_join(text.kept_lines(F.split(made, "\n"), text.title_key(title)), "\n")

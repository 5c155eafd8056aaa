"""Reader text from HTML pages: the best-scored container's blocks, link density, structured data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of HTML by their part in a page, and words that mark a container as none of the text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template nav footer aside form iframe svg button".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre".split())
CONTAINERS = frozenset("article main section div body".split())
BESIDES = frozenset("ad ads advert comments cookie menu newsletter promo related share sidebar sponsored".split())


@dataclass
class Container:
    tag: str
    terms: list[str]
    blocks: list[str] = field(default_factory=list)
    links: int = 0

    @property
    def chars(self) -> int:
        return sum(len(b.replace(" ", "")) for b in self.blocks)

    @property
    def density(self) -> float:
        return min(1.0, self.links / self.chars) if self.chars else 0.0

    def score(self) -> float:
        """Characters of text outside links, less four for each inside: what a container gains by a menu it loses.

        A single block counts half, as captions and teasers are; what names itself an article counts half again, and what
        names itself something beside the text a tenth.
        """
        gain = (self.chars - 5 * min(self.links, self.chars)) * (1.0 if len(self.blocks) > 1 else 0.5)
        if gain > 0:
            gain *= 1.5 if self.tag == "article" else 1.25 if self.tag == "main" else 1.0
            gain *= 0.1 if BESIDES.intersection(self.terms) else 1.0
        return gain


class Reader(HTMLParser):
    """Collects the text blocks of every open container; a hidden element's text is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Container | None, bool]] = []
        self.done: list[Container] = []
        self.hidden, self.anchors, self.text, self.linked, self.title, self.in_title = 0, 0, [], 0, "", False

    def _flush(self):
        block = " ".join("".join(self.text).split())
        if block:
            for _, c, _ in self.open:
                if c:
                    c.blocks.append(block)
                    c.links += self.linked
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCKS or tag in CONTAINERS:
            self._flush()
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        terms = named.replace("-", " ").replace("_", " ").split()
        hide = tag in HIDDEN or not BESIDES.isdisjoint(terms)
        self.open.append((tag, Container(tag, terms) if tag in CONTAINERS else None, hide))
        self.hidden += hide
        self.anchors += tag == "a"
        self.in_title |= tag == "title"

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.open):
            return
        if tag in BLOCKS or tag in CONTAINERS:
            self._flush()
        while self.open:
            t, c, hide = self.open.pop()
            self.hidden -= hide
            self.anchors -= t == "a"
            self.in_title &= t != "title"
            if c:
                self.done.append(c)
            if t == tag:
                break

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)
            self.linked += len("".join(data.split())) if self.anchors else 0

    def best(self) -> Container:
        self._flush()
        self.done += [c for _, c, _ in reversed(self.open) if c]
        self.open = []
        return max(self.done, key=Container.score, default=Container("", []))


def read_page(html: str) -> tuple[str, str, list[str], float]:
    """(title, container's tag, blocks, link density) of a page."""
    r = Reader()
    r.feed(html)
    r.close()
    c = r.best()
    return " ".join(r.title.split()), c.tag, c.blocks, c.density


def page_blocks(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, container, blocks, density) of every page; null and empty pages have no blocks."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [read_page(t or "") for t in b.column(1).to_pylist()]
            cols = [[r[k] for r in rows] for k in range(4)]
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", "title", "container", "blocks", "density"])

    return df.select(F.col(id_col).cast("long").alias("id"), html_col).mapInArrow(batches, "id long, title string, container string, blocks array<string>, density double")


def readable(blocks: Column) -> Column:
    """The quality gate: null for readable blocks, else the first reason against them."""
    n, chars = F.size(blocks), F.length(F.array_join(blocks, ""))
    short = F.size(F.filter(blocks, lambda b: F.length(b) < 35))
    repeated = n - F.size(F.array_distinct(blocks))
    return (
        F.when(chars < 150, "short").when((n == 1) & (chars < 250), "one short paragraph")
        .when((n >= 3) & (2 * repeated >= n), "repeated").when((n >= 4) & (short > 0.6 * n), "fragments")
    )


def structured_bodies(html: Column) -> Column:
    """articleBody, or else headline, of each JSON-LD script of a page, in order."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    found = F.transform(scripts, lambda s: F.coalesce(F.get_json_object(s, "$.articleBody"), F.get_json_object(s, "$.headline")))
    return F.filter(found, lambda x: x.isNotNull())


def plain_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space folded: all built-in functions."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))

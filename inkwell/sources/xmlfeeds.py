"""RSS, RDF and Atom feeds from bytes to typed item rows: encodings, namespaces, relative addresses, media, content.

A feed is read as a tree; an item's fields are found by looking up names in their vocabularies among its own children,
so what a vendor's element or an entry's copied source holds is never taken for the item's.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feeds import GUARDED, MAX_BODY, MAX_ITEMS, byline

# Vocabularies by the names of their namespaces, limits, image endings.
VOCABULARIES = {
    "": "", "http://purl.org/rss/1.0/": "", "http://my.netscape.com/rdf/simple/0.9/": "", "http://www.w3.org/2005/Atom": "", "http://purl.org/atom/ns#": "", "http://backend.userland.com/rss2": "",
    "http://purl.org/dc/elements/1.1/": "dc", "http://purl.org/rss/1.0/modules/content/": "content", "http://search.yahoo.com/mrss/": "media", "http://search.yahoo.com/mrss": "media",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf", "http://www.w3.org/1999/xhtml": "xhtml",
}
XML_BASE = "{http://www.w3.org/XML/1998/namespace}base"
MAX_NESTING, MAX_IMAGES = 64, 8
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".avif", ".gif")

_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")
#: A run that UTF-8 read as Windows-1252 leaves: a lead byte's letter and what follows it.
_MOJIBAKE = re.compile("(?:[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3})+")
#: The byte of each letter in Windows-1252; characters numbered as bytes stand for these too.
_WESTERN = {chr(b): b for b in range(128, 256)} | {bytes([b]).decode("cp1252"): b for b in range(128, 256) if bytes([b]).decode("cp1252", "ignore")}


def decoded(raw: bytes, told: str | None = None) -> str:
    """A feed's text: by its byte order mark, else as UTF-8 where it is that, else as it is told or declares, else as Windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    declared = _DECLARED.match(raw[:200])
    names = ["utf-8", told, declared[1].decode() if declared else None, "cp1252"]
    for name in names:
        try:
            if name and codecs.lookup(name).name not in ("utf-16", "utf-32"):
                return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def repaired(text: str) -> str:
    """Text whose UTF-8 was once read as Windows-1252, set right run by run: only where a run's bytes are UTF-8 again."""

    def once(m: re.Match) -> str:
        try:
            return bytes(_WESTERN[c] for c in m[0]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return m[0]

    return _MOJIBAKE.sub(once, text)


def _name(tag: str) -> tuple[str | None, str]:
    """(vocabulary, local name); None for a vocabulary that is not known."""
    if not isinstance(tag, str):
        return None, ""
    space, _, local = tag.rpartition("}")
    return VOCABULARIES.get(space[1:] if space else ""), local


def _base(node: ElementTree.Element, above: str) -> str:
    own = node.get(XML_BASE)
    return urljoin(above, own) if own else above


def _all_text(node: ElementTree.Element) -> str:
    return "".join(node.itertext())


def _markup(node: ElementTree.Element) -> str:
    """The markup inside an element, without namespace prefixes."""
    out = [escaped(node.text or "")]
    for child in node:
        local = _name(child.tag)[1]
        attributes = "".join(f' {k.rpartition("}")[2]}="{escaped(v)}"' for k, v in sorted(child.attrib.items()))
        out.append(f"<{local}{attributes}>{_markup(child)}</{local}>{escaped(child.tail or '')}")
    return "".join(out)


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _number(text: str | None) -> int | None:
    try:
        return int(text.strip()) if text else None
    except ValueError:
        return None


class Item:
    """The fields of one item or entry. Of a field that stands more than once, the first that holds text counts."""

    def __init__(self, node: ElementTree.Element, base: str):
        self.base = _base(node, base)
        self.found: dict[str, str] = {}
        self.images: list[tuple[int, str]] = []
        self.guid_is_link = True
        for child in node:
            vocabulary, local = _name(child.tag)
            if vocabulary is not None and not (vocabulary == "" and local == "source"):
                self._take(child, vocabulary, local, _base(child, self.base))

    def _set(self, field: str, text: str) -> None:
        if not self.found.get(field, "").strip():
            self.found[field] = text

    def _take(self, node: ElementTree.Element, vocabulary: str, local: str, base: str) -> None:
        name = f"{vocabulary}:{local}" if vocabulary else local
        if name in ("title", "description", "summary", "pubDate", "published", "updated", "dc:date"):
            self._set({"summary": "description", "pubDate": "published"}.get(name, name), _all_text(node))
        elif name in ("guid", "id"):
            if not self.found.get("guid", "").strip():
                self.guid_is_link = (node.get("isPermaLink") or "").lower() != "false"
            self._set("guid", _all_text(node))
        elif name == "link":
            if (href := node.get("href")) is None:
                self._set("link", urljoin(base, _all_text(node).strip()) if _all_text(node).strip() else "")
            elif node.get("rel", "alternate") == "alternate":
                self._set("link", urljoin(base, href.strip()))
        elif name in ("author", "dc:creator"):
            inner = [c for c in node if _name(c.tag) == ("", "name")]
            self._set("author", _all_text(inner[0]) if inner else _all_text(node))
        elif name in ("category", "dc:subject"):
            self._set("category", node.get("term") or _all_text(node))
        elif name in ("content:encoded", "content"):
            kind = node.get("type", "text" if name == "content" else "html")
            self._set("content", _markup(node) if kind == "xhtml" else _all_text(node))
        elif name in ("enclosure", "media:content", "media:thumbnail"):
            self._image(node, name, base)
        if name in ("media:group", "media:content"):
            for child in node:
                if (inside := _name(child.tag))[0] == "media":
                    self._take(child, *inside, _base(child, base))

    def _image(self, node: ElementTree.Element, name: str, base: str) -> None:
        raw, kind, medium, width = node.get("url"), (node.get("type") or "").lower(), (node.get("medium") or "").lower(), _number(node.get("width"))
        if not raw or len(self.images) >= MAX_IMAGES:
            return
        ending = raw.split("?")[0].split("#")[0].lower().endswith(IMAGES)
        sized = name == "media:content" and medium in ("", "image") and (width is not None or ending)
        if kind.startswith("image/") or (not kind and (name == "media:thumbnail" or medium == "image" or sized or ending)):
            self.images.append((width or 0, urljoin(base, raw.strip())))

    def row(self) -> tuple:
        text = lambda k: repaired(self.found.get(k, "")).strip() or None
        guid, link = text("guid"), text("link")
        if link is None and guid and self.guid_is_link and re.match(r"https?://", guid):
            link = guid
        # the widest rendition; the first of equal ones
        image = max(self.images, key=lambda i: i[0])[1] if self.images else None
        published = text("published") or text("dc:date") or text("updated")
        return guid or link, text("title"), link, published, text("description"), text("content"), text("author"), text("category"), image


def feed_items(body: str, address: str = "") -> list[tuple]:
    """(feed title, guid, title, link, published, description, content, author, category, image) of a feed's items.

    Nothing for texts that declare entities or attribute lists, are malformed, too long or too deep, or are no feed.
    """
    if len(body) > MAX_BODY or re.search(r"(?i)<!(ENTITY|ATTLIST)", body[:GUARDED]):
        return []
    try:
        root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", body))
    except ElementTree.ParseError:
        return []
    level, nesting = [root], 0
    while level:
        level, nesting = [c for n in level for c in n], nesting + 1
        if nesting > MAX_NESTING:
            return []
    kind, base = _name(root.tag), _base(root, address)
    channels = [c for c in root if _name(c.tag) == ("", "channel")]
    if kind == ("", "rss") and channels:
        inside, base, item = channels[0], _base(channels[0], base), "item"
    elif kind == ("rdf", "RDF"):
        inside, item = root, "item"
    elif kind == ("", "feed"):
        inside, item = root, "entry"
    else:
        return []
    titled = channels[0] if channels else inside
    title = next((_all_text(c).strip() for c in titled if _name(c.tag) == ("", "title")), "")
    nodes = [c for c in inside if _name(c.tag) == ("", item)][:MAX_ITEMS]
    return [(repaired(title) or None, *Item(n, base).row()) for n in nodes]


COLUMNS = ("feed", "guid", "title", "link", "published", "description", "content", "author", "category", "image")


def parsed_feeds(df: DataFrame, id_col: str, body_col: str, address_col: str | None = None) -> DataFrame:
    """(id, pos, feed, guid, title, link, published, description, content, author, category, image): a row for each item.

    ``body_col`` holds bytes or text, ``address_col`` where the feed was fetched, which relative addresses start from.
    Null bodies give nothing; ids may repeat.
    """
    address = F.col(address_col) if address_col else F.lit("")
    read = df.select(F.col(id_col).alias("id"), F.col(body_col).cast("binary").alias("b"), F.coalesce(address, F.lit("")).alias("a")).where("b IS NOT NULL")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, at, pos = [], [], []
            for k, (body, where) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for p, row in enumerate(feed_items(decoded(body), where)):
                    rows.append(row)
                    at.append(k)
                    pos.append(p)
            fields = list(zip(*rows)) if rows else [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), *(pa.array(f, pa.string()) for f in fields)], ["id", "pos", *COLUMNS])

    kind = dict(read.dtypes)["id"]
    made = read.mapInArrow(batches, f"id {kind}, pos int, " + ", ".join(f"{c} string" for c in COLUMNS))
    return made.withColumn("author", byline(F.col("author")))

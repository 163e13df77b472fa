"""Web pages as arrays of elements.

Python only turns a page's markup into an outline, one entry per element that
a job asks for; choosing among the entries is left to Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, MapType, StructType

from keystead.schemas import INT, STRING, typed

# pos/end: order of the start tags an element covers; path: its ancestors as tag.class…>
ELEMENT = typed({
    "pos": INT, "end": INT, "path": STRING, "tag": STRING, "id": STRING,
    "classes": ArrayType(STRING), "attrs": MapType(STRING, STRING), "text": STRING,
})
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
PAGES_AT_ONCE = 64  # outlines built before they are handed on, to bound a task's memory
SILENT_TAGS = frozenset(["script", "style", "template"])


class _Outline(HTMLParser):
    def __init__(self, wanted: frozenset[str], with_text: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.with_text = wanted, with_text
        self.open, self.texts, self.found, self.count = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        classes = values.get("class", "").split()
        path = self.open[-1]["path"] + ".".join([self.open[-1]["tag"], *self.open[-1]["classes"]]) + ">" if self.open else ""
        node = {"pos": self.count, "path": path, "tag": tag, "id": values.get("id"), "classes": classes, "attrs": list(values.items()), "from": len(self.texts)}
        self.count += 1
        self.open.append(node)
        names = {tag, "#" + values.get("id", ""), *("." + c for c in classes)}
        node["keep text"] = bool(names & self.with_text)
        if names & self.wanted:
            self.found.append(node)
        if tag in VOID_TAGS:
            self._close()

    def handle_endtag(self, tag):
        if any(node["tag"] == tag for node in self.open):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if not (self.open and self.open[-1]["tag"] in SILENT_TAGS):
            self.texts.append(data)

    def _close(self) -> str:
        node = self.open.pop()
        node["end"], node["to"] = self.count, len(self.texts)
        return node["tag"]

    def elements(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        while self.open:
            self._close()
        for node in self.found:
            start, end = node.pop("from"), node.pop("to")
            node["text"] = "".join(self.texts[start:end]) if node.pop("keep text") else None
        return self.found


# A tag in the form nearly all pages use, its attributes, and tags whose content is read by rules of its own.
ANY_TAG = re.compile(r"(<[^<>]*>)")
PLAIN_TAG = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&<>]*")*)>')
PLAIN_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9-]*)="([^"]*)"')
OWN_RULES = SILENT_TAGS | frozenset("iframe noembed noframes noscript plaintext textarea title xmp".split())
KNOWN_TAGS = 4096  # tags remembered by a task


class _PlainOutline:
    """The same elements for pages of plain tags alone, which one split tells from their texts; other pages go to ``_Outline``."""

    def __init__(self, wanted: frozenset[str], with_text: frozenset[str]):
        self.wanted, self.with_text, self.known = wanted, with_text, {}

    def tag(self, written: str) -> tuple:
        """name, whether it ends an element, step of a path (None: stays empty), its node without a place (None: not wanted);
        empty if the tag is not plain."""
        if len(self.known) >= KNOWN_TAGS:
            self.known.clear()
        match = PLAIN_TAG.fullmatch(written)
        found = ()
        if match and match[2] not in OWN_RULES and not (match[1] and match[3]):
            name, values = match[2], dict(PLAIN_ATTRIBUTE.findall(match[3]))
            classes = values.get("class", "").split()
            names = {name, "#" + values.get("id", ""), *("." + c for c in classes)}
            node = {"tag": name, "id": values.get("id"), "classes": classes, "attrs": list(values.items()), "keep text": bool(names & self.with_text)}
            step = None if name in VOID_TAGS else ".".join([name, *classes]) + ">"
            found = name, bool(match[1]), step, node if names & self.wanted else None
        self.known[written] = found
        return found

    def elements(self, html: str) -> list[dict]:
        pieces = ANY_TAG.split(html)
        texts, tags = pieces[::2], pieces[1::2]
        known, opened, found, count, path = self.known, [], [], 0, ""
        plain = html.count("<") == len(tags)
        for at, written in enumerate(tags if plain else [], 1):
            own = known.get(written)
            if own is None:
                own = self.tag(written)
            if not own:
                plain = False
                break
            name, ends, step, node = own
            if ends:
                if opened and (opened[-1][0] == name or any(tag == name for tag, _, _ in opened)):
                    tag = None
                    while tag != name:
                        tag, path, node = opened.pop()
                        if node is not None:
                            node["end"], node["to"] = count, at
                continue
            if node is not None:
                node = {**node, "pos": count, "path": path, "from": at}
                found.append(node)
            count += 1
            if step is not None:
                opened.append((name, path, node))
                path += step
            elif node is not None:
                node["end"], node["to"] = count, at
        if not plain:
            return _Outline(self.wanted, self.with_text).elements(html)
        if "&" in html:
            texts = [unescape(text) for text in texts]
        for node in found:
            start, end = node.pop("from"), node.pop("to", len(texts))
            node.setdefault("end", count)
            node["text"] = "".join(texts[start:end]) if node.pop("keep text") else None
        return found


def with_elements(
    pages: DataFrame, wanted: list[str], structure: list[str] | None = None, html: str = "html"
) -> DataFrame:
    """Replaces the markup by ``elements``: those with a wanted tag, ``#id`` or ``.class`` (H1, H2).

    Elements named only in ``structure`` come without their text, which nested
    containers would otherwise repeat at every level.
    """
    with_text = frozenset(wanted)
    names = with_text | frozenset(structure or [])
    kept = [c for c in pages.columns if c != html]
    schema = StructType([pages.schema[c] for c in kept]).add("elements", ArrayType(ELEMENT))
    arrow_type = to_arrow_type(ArrayType(ELEMENT))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = _PlainOutline(names, with_text)
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(start, PAGES_AT_ONCE)
                parsed = [plain.elements(page or "") for page in part.column(html).to_pylist()]
                columns = [part.column(c) for c in kept] + [pa.array(parsed, arrow_type)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "elements"])

    return pages.select(*kept, html).mapInArrow(outline, schema)


def choose(
    elements: Column,
    tag: str | None = None,
    id: str | None = None,
    cls: str | None = None,
    attr: tuple[str, str] | None = None,
    path: str | None = None,
    inside: Column | None = None,
) -> Column:
    """The elements that meet every given condition, in page order."""

    def fits(e: Column) -> Column:
        tests = [F.lit(True)]
        if tag:
            tests.append(e["tag"] == tag)
        if id:
            tests.append(F.coalesce(e["id"] == id, F.lit(False)))
        if cls:
            tests.append(F.array_contains(e["classes"], cls))
        if attr:
            tests.append(F.coalesce(F.try_element_at(e["attrs"], F.lit(attr[0])) == attr[1], F.lit(False)))
        if path:
            tests.append(e["path"].rlike(path))
        if inside is not None:
            tests.append((e["pos"] > inside["pos"]) & (e["pos"] < inside["end"]))
        result = tests[0]
        for test in tests[1:]:
            result = result & test
        return result

    return F.filter(elements, fits)


def first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))

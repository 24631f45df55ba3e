"""Label and data pairs, image links and titles of detail pages.

Pages are parsed by the standard library's parser in Arrow batches; patterns
that one expression covers stay with the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.functions import text as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def text(self) -> str:
        parts: list[str] = []
        todo: list = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                if s := node.strip():
                    parts.append(s)
            else:
                todo += reversed(node.children)
        return " ".join(parts)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.nodes: list[_Node] = []

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def _data_for(label: _Node) -> str:
    """Text of the first non-empty data div after the label, else of the cell that holds it."""
    is_data = lambda n: isinstance(n, _Node) and n.tag == "div" and "data" in n.classes()
    siblings = label.parent.children
    later = siblings[next(i for i, n in enumerate(siblings) if n is label) + 1 :]
    cell = label.parent
    while cell is not None and cell.tag != "td":
        cell = cell.parent
    for node in [*later, *(cell.children if cell is not None else [])]:
        if is_data(node) and (found := node.text()):
            return found
    return ""


def parse_page(html: str | None) -> tuple[list[tuple[str, str]], list[str]]:
    """(raw label, data) pairs in order, and the sources of all images."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    pairs = []
    for node in tree.nodes:
        if node.tag == "div" and any("label" in c for c in node.classes()):
            if data := _data_for(node):
                pairs.append((node.text(), data))
    return pairs, [n.attrs["src"] for n in tree.nodes if n.tag == "img" and n.attrs.get("src")]


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html", carried: Sequence[str] = ()) -> DataFrame:
    """key, pairs (label, value in order) and images of each page, and the carried columns as they are."""
    own = [key, *carried]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))
        for batch in batches:
            parsed = [parse_page(t) for t in batch.column(len(own)).to_pylist()]
            pairs = pa.array([[{"label": a, "value": b} for a, b in p] for p, _ in parsed], pair)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pairs, pa.array([i for _, i in parsed], pa.list_(pa.string()))], names=[*own, "pairs", "images"])

    return pages.select(*own, html).mapInArrow(run, f"{kinds}, pairs array<struct<label:string,value:string>>, images array<string>")


def page_fields(pages: DataFrame, key: str = "page_id", html: str = "html", carried: Sequence[str] = ()) -> DataFrame:
    """key, fields (map of cleaned label to value; a later label replaces an earlier one) and image_urls of attachments.

    carried: columns that come along with their rows, so that nothing has to be joined to the pages again.
    """
    cleaned = F.transform("pairs", lambda p: F.struct(T.clean_label(p["label"]).alias("k"), p["value"].alias("v")))
    merged = F.aggregate(
        F.filter(cleaned, lambda p: p["k"] != ""), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )
    return parse_pages(pages, key, html, carried).select(key, *carried, merged.alias("fields"), F.filter("images", lambda s: F.contains(s, F.lit(C.ATTACHMENT))).alias("image_urls"))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def attachments(html: Column) -> Column:
    """Sources of attachment images, by pattern."""
    return F.filter(F.regexp_extract_all(html, F.lit(r'<img [^>]*src="([^"]*)"'), F.lit(1)), lambda s: F.contains(s, F.lit(C.ATTACHMENT)))

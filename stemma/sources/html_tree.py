"""Web pages as element trees, and the objects in them: headings, paragraphs, lists, links, images, code, formulas, tables.

The parser runs inside tasks and gives a page one row: its elements in page order, each with its parent and
table, those that are objects or cells with the text they cover. Everything else is column work over these
rows, and only Markdown of tables is shuffled.

Defined results: a null page has no elements; an unclosed element ends where its parent does, or where
another of its kind begins that cannot lie inside it; a closing tag without an open element is skipped;
scripts and styles have no text; character references are decoded.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(["script", "style", "template"])
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
BLOCKS = HEADINGS | frozenset("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
# An opening tag ends open elements of these names, up to the nearest element that bounds them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS |= {x: {"tr", "td", "th", "thead", "tbody", "tfoot", "caption"} for x in ("thead", "tbody", "tfoot")}
BOUNDS = frozenset("table ul ol dl select".split())
KINDS = {"a": "link", "img": "image", "pre": "code", "code": "code", "math": "formula", "table": "table", "p": "paragraph", "li": "item"} | dict.fromkeys(sorted(HEADINGS), "heading")
TEXTS = frozenset(KINDS) | {"td", "th", "caption", "figcaption", "title"}
NOTED = frozenset(["caption", "pre", "code"])
BATCH_ELEMENTS = 20_000
WIDEST_SPAN = 1000  # what browsers allow for a colspan; a rowspan ends with its table

_ELEMENT = "node int, parent int, depth int, tag string, attrs map<string,string>, text string, up string, table int, caption string, language string, row int, col int, rowspan int, colspan int"


# An element is a list: the fields of _ELEMENT, then where its text starts and stops, and the row element it lies in.
PARENT, TAG, ATTRS, TEXT, TABLE, CAPTION, LANGUAGE, ROW, COL, ROWSPAN, COLSPAN, START, STOP, LINE = 1, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16


def _number(value: str | None) -> int:
    digits = (value or "").strip()
    return int(digits) if digits.isascii() and digits.isdigit() else 1


class _Builder:
    """Elements from the tags and texts of a page, in their order."""

    def __init__(self):
        self.text, self.size, self.elements, self.open = [], 0, [], []
        self.silent, self.rows, self.busy, self.cells, self.noted = 0, {}, {}, [], False

    def _close(self, depth: int) -> None:
        """End the open elements from this depth on."""
        for e in self.open[depth:]:
            e[STOP] = self.size
            if e[TAG] in BLOCKS:
                self.text.append(" ")
                self.size += 1
            elif e[TAG] in SILENT:
                self.silent -= 1
        del self.open[depth:]

    def _end_by(self, tag: str, block: bool) -> None:
        open_ = self.open
        if block and tag != "br":
            for depth in range(len(open_) - 1, -1, -1):  # a paragraph holds no block
                up = open_[depth][TAG]
                if up == "p":
                    self._close(depth)
                    break
                if up in BLOCKS:
                    break
        names = ENDS.get(tag)
        if names:
            first = None
            for depth in range(len(open_) - 1, -1, -1):
                up = open_[depth][TAG]
                if up in BOUNDS:
                    break
                if up in names:
                    first = depth
            if first is not None:
                self._close(first)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        block = tag in BLOCKS
        if block or tag in ENDS:
            self._end_by(tag, block)
        if block:
            self.text.append(" ")
            self.size += 1
        node, size = len(self.elements), self.size
        if self.open:
            over = self.open[-1]
            e = [node, over[0], len(self.open), tag, attrs, None, over[TAG], over[TABLE], None, None, None, None, None, None, size, size, over[LINE]]
        else:
            e = [node, None, 0, tag, attrs, None, None, None, None, None, None, None, None, None, size, size, None]
        self.elements.append(e)
        if tag == "td" or tag == "th":
            if e[LINE] is not None:
                self._cell(e)
        elif tag == "tr":
            if e[TABLE] is not None:
                e[ROW] = self.rows[e[TABLE]] = self.rows.get(e[TABLE], -1) + 1
            e[LINE] = e
        elif tag == "table":
            e[TABLE], e[LINE] = node, None
        elif tag in NOTED:
            self.noted = True
        if tag not in VOID:
            self.open.append(e)
            if tag in SILENT:
                self.silent += 1

    def _cell(self, e: list) -> None:
        """Give a cell its row, column and spans in the grid of its table; cells above reach down by their rowspan."""
        r = e[LINE][ROW]
        if r is None:
            return
        taken = self.busy.get(e[TABLE])
        if taken is None:
            taken = self.busy[e[TABLE]] = {}
        c = 0
        while taken.get(c, -1) >= r:
            c += 1
        wide = high = 1
        if e[ATTRS]:
            wide, high = min(max(1, _number(e[ATTRS].get("colspan"))), WIDEST_SPAN), _number(e[ATTRS].get("rowspan"))
        e[ROW], e[COL], e[COLSPAN], e[ROWSPAN] = r, c, wide, high
        for k in range(c, c + wide):
            taken[k] = r + high - 1 if high else float("inf")  # 0: down to the end of the table
        self.cells.append(e)

    def end(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            up = self.open[depth][TAG]
            if up == tag:
                return self._close(depth)
            if up == "table":
                return

    def data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            self.size += len(data)

    def finish(self) -> list[list]:
        """The elements, with their text, and caption and language where they have one."""
        self._close(0)
        text, elements = "".join(self.text), self.elements
        for e in self.cells:
            left = self.rows[e[TABLE]] - e[ROW] + 1
            e[ROWSPAN] = min(e[ROWSPAN] or left, left)
        for e in elements:
            if e[TAG] in TEXTS:
                e[TEXT] = text[e[START] : e[STOP]]
        for e in elements if self.noted else ():
            if e[TAG] == "caption":
                if e[TABLE] is not None and elements[e[TABLE]][CAPTION] is None:
                    elements[e[TABLE]][CAPTION] = e[TEXT]
            elif e[TAG] in ("pre", "code"):
                for word in e[ATTRS].get("class", "").split():
                    for mark in ("language-", "lang-"):
                        if e[LANGUAGE] is None and word.startswith(mark) and len(word) > len(mark):
                            e[LANGUAGE] = word[len(mark) :]
                up = None if e[PARENT] is None else elements[e[PARENT]]
                if up and up[TAG] == "pre" and e[LANGUAGE] and up[LANGUAGE] is None:
                    up[LANGUAGE] = e[LANGUAGE]
        return elements


class _Reader(HTMLParser):
    """The general way to the tags and texts of a page."""

    def __init__(self, to: _Builder):
        super().__init__(convert_charrefs=True)
        self.to, self.handle_endtag, self.handle_data = to, to.end, to.data

    def handle_starttag(self, tag, attrs):
        self.to.start(tag, {k: v or "" for k, v in reversed(attrs)})  # the first of repeated attributes counts

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)


class _Tag(HTMLParser):
    """What the general reader makes of one tag."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.found = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append((True, tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.found.append((False, tag, None))

    def handle_data(self, data):
        self.found.append((None, None, None))


MARKUP = re.compile("(<[^<>]*>)")
PLAIN = re.compile(r"""<(?:/[a-z][a-z0-9]*[ \t\n]*|[a-z][a-z0-9]*(?:[ \t\n]+[a-z_][a-z0-9_-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`/]+))?)*[ \t\n]*/?)>""", re.I)
RAW = frozenset("script style template textarea title xmp iframe noembed noframes noscript plaintext svg math".split())  # what lies inside may be read otherwise
KNOWN_TAGS, LONGEST_KNOWN = 8192, 200
_known: dict[str, tuple | None] = {}


def _plain_tag(markup: str) -> tuple | None:
    """(opens, tag, attributes) of a tag that no text around it can change, else None. Tags seen often are read once."""
    found = _Tag(markup).found if PLAIN.fullmatch(markup) else []
    tag = found[0] if len(found) == 1 and found[0][0] is not None and found[0][1] not in RAW else None
    if len(markup) <= LONGEST_KNOWN:
        if len(_known) >= KNOWN_TAGS:
            _known.clear()
        _known[markup] = tag
    return tag


def _read_plain(html: str) -> _Builder | None:
    """Pages of plain tags and texts are cut at once; None where there is anything else, as a comment, script or stray bracket."""
    parts = MARKUP.split(html)
    if html.count("<") != len(parts) // 2:
        return None
    to, text = _Builder(), True
    start, end, data, known = to.start, to.end, to.data, _known
    for part in parts:
        if text:
            if part:
                data(unescape(part) if "&" in part else part)
        else:
            tag = known.get(part) or _plain_tag(part)
            if tag is None:
                return None
            if tag[0]:
                start(tag[1], tag[2])
            else:
                end(tag[1])
        text = not text
    return to


def parse(html: str | None) -> list[list]:
    """Elements in page order, each a list that begins with the fields of _ELEMENT."""
    to = _read_plain(html) if html else _Builder()
    if to is None:
        to = _Builder()
        reader = _Reader(to)
        reader.feed(html)
        reader.close()
    return to.finish()


def _packed(pages: list[list[list]]) -> pa.Array:
    """Elements of pages as one Arrow array, field by field."""
    columns = list(zip(*chain.from_iterable(pages)))
    kinds = {"int": pa.int32(), "string": pa.string()}
    fields, names = [], []
    for at, (name, kind) in enumerate(c.split(" ", 1) for c in _ELEMENT.split(", ")):
        values = columns[at] if columns else ()
        if name == "attrs":
            sizes = np.cumsum([0, *map(len, values)])
            keys, texts = chain.from_iterable(values), chain.from_iterable(v.values() for v in values if v)
            fields.append(pa.MapArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(list(keys), pa.string()), pa.array(list(texts), pa.string())))
        else:
            fields.append(pa.array(values, kinds[kind]))
        names.append(name)
    ends = pa.array(np.cumsum([0] + [len(page) for page in pages]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names))


def trees(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `elements` in page order; `html` is left out. A task holds the elements of a few pages at a time."""
    keep = [c for c in pages.columns if c not in (html, "elements")]

    def run(batches):
        for b in batches:
            texts, rest = b.column(len(keep)), [b.column(i) for i in range(len(keep))]
            first, parsed, n = 0, [], 0
            for i in range(b.num_rows):
                parsed.append(parse(texts[i].as_py()))
                n += len(parsed[-1])
                if n >= BATCH_ELEMENTS or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([c.slice(first, len(parsed)) for c in rest] + [_packed(parsed)], names=[*keep, "elements"])
                    first, parsed, n = i + 1, [], 0

    kind = f"array<struct<{','.join(c.replace(' ', ':', 1) for c in _ELEMENT.split(', '))}>>"
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("elements", T._parse_datatype_string(kind))])
    return pages.select(*keep, html).mapInArrow(run, schema)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def elements(tree: DataFrame) -> DataFrame:
    """One row per element; a page's columns that are named like one of these are replaced."""
    names = {c.split()[0] for c in _ELEMENT.split(", ")}
    keep = [c for c in tree.columns if c not in names | {"elements", "_e"}]
    return tree.select(*keep, F.explode("elements").alias("_e")).select(*keep, "_e.*")


def _rest(tree: DataFrame, found: DataFrame) -> list[str]:
    return [c for c in tree.columns if c in found.columns and c not in {n.split()[0] for n in _ELEMENT.split(", ")}]


def objects(tree: DataFrame) -> DataFrame:
    """(kind, node, level, text, target, language, caption) of the objects of every page.

    `level` is that of a heading; `target` the address of a link or image; `text` of an image its alternative
    text; `language` that named by the class of code; code keeps its white space.
    """
    e = elements(tree)
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("tag")]
    rows = e.withColumn("kind", kind).where("kind IS NOT NULL AND NOT (tag = 'code' AND coalesce(up, '') = 'pre') AND NOT (tag = 'a' AND NOT map_contains_key(attrs, 'href'))")
    text = F.when(F.col("kind") == "code", F.col("text")).when(F.col("kind") == "image", F.coalesce(F.col("attrs")["alt"], F.lit(""))).otherwise(squeezed(F.col("text")))
    return rows.select(
        *_rest(tree, rows), "kind", "node", F.when(F.col("kind") == "heading", F.substring("tag", 2, 1).cast("int")).alias("level"), text.alias("text"),
        F.coalesce(F.col("attrs")["href"], F.col("attrs")["src"]).alias("target"), "language", squeezed(F.col("caption")).alias("caption"),
    )


def cells(tree: DataFrame) -> DataFrame:
    """(table, row, col, rowspan, colspan, header, text) of every cell of every table; `table` is its element's node."""
    rows = elements(tree).where("col IS NOT NULL")
    return rows.select(*_rest(tree, rows), "table", "row", "col", "rowspan", "colspan", (F.col("tag") == "th").alias("header"), squeezed(F.col("text")).alias("text"))


def grid(found: DataFrame) -> DataFrame:
    """Cells spread over all places they cover."""
    ys, xs = F.sequence("row", F.col("row") + F.col("rowspan") - 1), F.sequence("col", F.col("col") + F.col("colspan") - 1)
    rest = [c for c in found.columns if c not in ("row", "col", "rowspan", "colspan")]
    return found.select(*rest, F.explode(ys).alias("row"), "col", "colspan").select(*rest, "row", F.explode(xs).alias("col"))


def markdown(found: DataFrame, key: str) -> DataFrame:
    """(key, table, rows, columns, markdown): each table as Markdown, its first row as head; a spanned place repeats its text."""
    text = F.replace(F.col("text"), F.lit("|"), F.lit("\\|"))
    lines = grid(found).groupBy(key, "table", "row").agg(F.sort_array(F.collect_list(F.struct("col", text.alias("t")))).alias("c"))
    lines = lines.select(key, "table", "row", F.get("c.col", F.size("c") - 1).alias("last"), "c")
    whole = lines.groupBy(key, "table").agg(F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("row", "c"))).alias("r"))
    width = F.col("last") + 1
    at = lambda c, i: F.coalesce(F.get(F.transform(F.filter(c, lambda x: x["col"] == i), lambda x: x["t"]), F.lit(0)), F.lit(""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: at(r["c"], i)), " | "), F.lit(" |"))
    made = F.transform("r", line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return whole.select(key, "table", F.size("r").alias("rows"), width.alias("columns"), F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, 2, F.size("r"))), "\n").alias("markdown"))

"""Stored pages, read once: what an operator wants of a page is made where it is parsed, so markup goes no further."""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.naming import col
from . import css

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Open elements that a start tag ends, and the containers that stop the search for them.
_ITEMS = {tag: frozenset(ends.split()) for tag, ends in {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th",
    "th": "td th", "thead": "tr td th", "tbody": "tr td th thead"}.items()}
_WALLS = {tag: frozenset(walls.split()) for tag, walls in {
    "li": "ul ol", "dt": "dl", "dd": "dl", "option": "select",
    **dict.fromkeys(("tr", "td", "th", "thead", "tbody"), "table")}.items()}
_BLOCKS = frozenset(
    "p div ul ol dl table section article aside header footer nav form pre blockquote hr h1 h2 h3 h4 h5 h6 "
    "address main figure fieldset".split())
_INLINE = frozenset("b i em strong span a u small font big code".split())
# Elements whose text is not part of the page's text.
SILENT = frozenset({"script", "style", "template"})

_CHUNK_CHARS = 1 << 21  # markup per output batch, which bounds the memory of a task
# Cells of tables in a batch, and elements and texts of a page that are held before finished rows of its table are let go.
_BATCH_CELLS, _HELD = 1 << 15, 1 << 14
_CELLS = "__cells"
# The greatest spans of a table cell, and the characters that a plain name does not hold.
_MOST_COLUMNS, _MOST_ROWS = 1000, 65534
UNPLAIN = frozenset(" .#:[],()>\"'`")


def plain(name: str) -> bool:
    return bool(name) and UNPLAIN.isdisjoint(name)


def shape_classes(classes: Sequence[str]) -> list[str]:
    """The first two plain class names: what tells sibling blocks apart."""
    return [c for c in dict.fromkeys(classes) if plain(c)][:2]


@dataclass(slots=True)
class Element:
    """An element owns the text pieces first + 1 … last of its page, so text is stored once however deep it is nested."""
    tag: str
    attrs: dict[str, str]
    classes: list[str]
    parent: int
    first: int
    last: int
    place: tuple[int, int, int]  # table, row and cell among those of the page, the table and the row
    link: str | None  # the first link inside
    has_text: bool = False


@dataclass
class Parsed:
    elements: list[Element]
    texts: list[str] = field(default_factory=list)

    def text(self, e: Element) -> str:
        """The element's text pieces joined by blanks."""
        return " ".join(self.texts[e.first:e.last])

    def select(self, lists: Sequence[css.Selectors]) -> list[list[Element]]:
        found = css.select(css.Page(
            [e.tag for e in self.elements], [e.attrs for e in self.elements], [e.classes for e in self.elements],
            [e.parent for e in self.elements], [e.has_text for e in self.elements]), lists)
        return [[self.elements[i] for i in some] for some in found]


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.unlinked = 0  # open elements from here on have no link yet
        self.tables: list[list[int]] = []  # [table, row, cell] of the open tables
        self.table_count = 0

    def updatepos(self, i, j):
        return j  # line and column numbers are not used

    def _tag(self, depth: int) -> str:
        return self.elements[self.open[depth]].tag

    def _close_to(self, depth: int) -> None:
        for at in self.open[depth:]:
            self.elements[at].last = len(self.texts)
            if self.elements[at].tag == "table":
                self.tables.pop()
        del self.open[depth:]
        self.unlinked = min(self.unlinked, depth)

    def _end_implied(self, tag: str) -> None:
        if tag in _ITEMS:
            walls, ends, cut = _WALLS[tag], _ITEMS[tag], None
            for depth in range(len(self.open) - 1, -1, -1):
                name = self._tag(depth)
                if name in walls:
                    break
                if name in ends:
                    cut = depth
            if cut is not None:
                self._close_to(cut)
        elif tag in _BLOCKS:
            depth = len(self.open) - 1
            while depth >= 0 and self._tag(depth) in _INLINE:
                depth -= 1
            if depth >= 0 and self._tag(depth) == "p":
                self._close_to(depth)

    def handle_starttag(self, tag, attrs):
        self._end_implied(tag)
        known = {k: v or "" for k, v in reversed(attrs)}  # the first mention of an attribute counts
        place = (-1, -1, -1)
        if tag == "table":
            self.tables.append([self.table_count, -1, -1])
            self.table_count += 1
        elif self.tables and tag in ("tr", "td", "th"):
            here = self.tables[-1]
            here[1:] = [here[1] + 1, -1] if tag == "tr" else [max(here[1], 0), here[2] + 1]
            place = tuple(here)
        if tag == "a" and "href" in known:
            for at in self.open[self.unlinked:]:
                if self.elements[at].link is None:
                    self.elements[at].link = known["href"]
            self.unlinked = len(self.open)
        self.elements.append(Element(
            tag, known, known["class"].split() if "class" in known else [], self.open[-1] if self.open else -1,
            len(self.texts), len(self.texts), place, (known.get("href") or None) if tag == "a" else None))
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self._tag(depth) == tag:
                self._close_to(depth)
                return

    def handle_data(self, data):
        text = data.strip()
        if text and self.open:
            self.elements[self.open[-1]].has_text = True
            if self._tag(-1) in SILENT:
                return
        if text:
            self.texts.append(text)


def read_markup(html: str | None) -> Parsed:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close_to(0)
    return Parsed(reader.elements, reader.texts)


def parse_pages(pages: DataFrame, html: str, fields: Sequence[tuple[str, str]], make: Callable[[Parsed], tuple]) -> DataFrame:
    """Replace the markup column by what ``make`` finds in each page, one value for each of ``fields`` (name, SQL type).

    Every other column stays; of equal names the new one counts. Pages are parsed in the partitions they are read in.
    """
    names = [name for name, _ in fields]
    keep = [c for c in pages.columns if c != html and c not in names]
    schema = T.StructType([*[f for f in pages.schema if f.name in keep],
                           *[T.StructField(name, T._parse_datatype_string(sql)) for name, sql in fields]])
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The other columns pass through as they are; only the new ones are made of Python values.
        for batch in batches:
            markup = batch.column(len(keep)).to_pylist()
            volume = np.cumsum([len(h or "") for h in markup]) // _CHUNK_CHARS
            begins = [0, *(np.flatnonzero(np.diff(volume)) + 1).tolist(), len(markup)]
            for begin, end in zip(begins, begins[1:]):
                made = list(zip(*[make(read_markup(h)) for h in markup[begin:end]]))
                kept = [batch.column(i).slice(begin, end - begin) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.array(v, t) for v, t in zip(made, arrow.types[len(keep):])]], schema=arrow)

    return pages.select(*[col(c) for c in [*keep, html]]).mapInArrow(parse, schema)


def _span(e: Element, name: str, most: int) -> int:
    value = e.attrs.get(name, "").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() else 1


class _Pause(Exception):
    """The reader stopped behind a whole piece of markup, at this place of what it was given."""


class _RowReader(_Reader):
    """Rows of one table while its page is read: elements and texts of rows that are done are let go."""

    def __init__(self, number: int) -> None:
        super().__init__()
        self.number = number
        self.most = _HELD
        self.waiting: list[tuple[int, list[Element]]] = []  # (row, its cells) of the table, not given out yet
        self.seen = 0  # elements that are in their rows

    def updatepos(self, i, j):
        if len(self.elements) + len(self.texts) > self.most:
            raise _Pause(j)
        return j

    def read(self, html: str | None) -> Iterator[list[tuple[int, int, bool, str]]]:
        """The rows in order; of each the cells (rowspan, colspan, whether a header, text)."""
        self.rawdata = html or ""
        for last_step in (lambda: self.feed(""), self.close):
            paused = True
            while paused:
                try:
                    last_step()
                    paused = False
                except _Pause as pause:
                    self.rawdata = self.rawdata[pause.args[0]:]
                    yield from self._done()
                    self._let_go()
        self._close_to(0)
        yield from self._done()

    def _done(self) -> Iterator[list[tuple[int, int, bool, str]]]:
        """Rows that have another one behind them, or whose table is closed, up to the first with an open cell."""
        for e in self.elements[self.seen:]:
            if e.place[0] == self.number and e.tag in ("tr", "td", "th"):
                if not self.waiting or self.waiting[-1][0] != e.place[1]:
                    self.waiting.append((e.place[1], []))
                if e.tag != "tr":
                    self.waiting[-1][1].append(e)
        self.seen = len(self.elements)
        now = next((row for number, row, _ in self.tables if number == self.number), None)
        still = {id(self.elements[i]) for i in self.open}
        n = 0
        while n < len(self.waiting) and self.waiting[n][0] != now and not any(id(e) in still for e in self.waiting[n][1]):
            yield [(_span(e, "rowspan", _MOST_ROWS), _span(e, "colspan", _MOST_COLUMNS), e.tag == "th", " ".join(self.texts[e.first:e.last]))
                   for e in self.waiting[n][1]]
            n += 1
        del self.waiting[:n]

    def _let_go(self) -> None:
        """Keep the open elements, the cells that wait and the texts from the first of these on."""
        cells = {id(e): e for _, some in self.waiting for e in some}
        drop = min((e.first for e in cells.values()), default=len(self.texts))
        self.elements = [self.elements[i] for i in self.open]
        self.open = list(range(len(self.open)))
        self.seen = len(self.elements)
        del self.texts[:drop]
        for e in {**cells, **{id(e): e for e in self.elements}}.values():
            e.first, e.last = max(e.first - drop, 0), max(e.last - drop, 0)
        # Where much must stay, the next look comes the later.
        self.most = max(_HELD, 2 * (len(self.elements) + len(self.texts) + len(cells)))


def _read_rows(page: Parsed, number: int) -> Iterator[list[tuple[int, int, bool, str]]]:
    """The rows of a table of a page that has been read, as those of a ``_RowReader``."""
    rows: dict[int, list[Element]] = {}
    for e in page.elements:
        if e.place[0] == number and e.tag in ("tr", "td", "th"):
            rows.setdefault(e.place[1], [])
            if e.tag != "tr":
                rows[e.place[1]].append(e)
    for row in range(max(rows, default=-1) + 1):
        yield [(_span(e, "rowspan", _MOST_ROWS), _span(e, "colspan", _MOST_COLUMNS), e.tag == "th", page.text(e)) for e in rows.get(row, [])]


def table_grid(html: str | Parsed | None, number: int = 0) -> Iterator[tuple[int, int, bool, str]]:
    """(row, column, whether a header, text) of a table's cells; a cell stands at every place that it spans.

    Spans that reach below the last row add rows, as they do for the usual readers of such tables. Cells come row by row
    while the page is read, so a long table is never held as a whole; those of a page read before come from its elements.
    """
    rows = _read_rows(html, number) if isinstance(html, Parsed) else _RowReader(number).read(html)
    carried: dict[int, tuple[int, bool, str]] = {}  # column -> rows to come, and the cell
    row = 0
    while (cells := next(rows, None)) is not None or carried:
        now, carried, column = carried, {}, 0
        out: list[tuple[int, int, bool, str]] = []

        def put(rest: int, header: bool, text: str) -> None:
            nonlocal column
            out.append((row, column, header, text))
            if rest:
                carried[column] = (rest - 1, header, text)
            column += 1

        for rowspan, colspan, header, text in cells or ():
            for _ in range(colspan):
                while column in now:
                    put(*now.pop(column))
                put(rowspan - 1, header, text)
        for column in sorted(now):
            put(*now[column])
        yield from out
        row += 1


def page_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cells of the first table of each page: (…, row_no, col_no, is_header, text)."""
    keep = [c for c in pages.columns if c != html]
    cell = T._parse_datatype_string("struct<row_no: int, col_no: int, is_header: boolean, text: string>")
    schema = T.StructType([*[f for f in pages.schema if f.name in keep], T.StructField(_CELLS, T.ArrayType(cell))])
    arrow, cells_arrow = to_arrow_schema(schema), to_arrow_schema(cell)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A page's cells come in as many rows as it takes; the other columns are repeated for each of those.
        for batch in batches:
            owners: list[int] = []
            sizes: list[int] = []
            cells: list[tuple] = []

            def made() -> pa.RecordBatch:
                columns = [pa.array(v, t) for v, t in zip(zip(*cells), cells_arrow.types)]
                runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()),
                                                pa.StructArray.from_arrays(columns, fields=list(cells_arrow)), type=arrow.types[-1])
                kept = [batch.column(i).take(pa.array(owners, pa.int64())) for i in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, runs], schema=arrow)

            for i in range(batch.num_rows):
                grid = table_grid(batch.column(len(keep))[i].as_py())
                while some := list(islice(grid, _BATCH_CELLS - len(cells))):
                    owners.append(i)
                    sizes.append(len(some))
                    cells += some
                    if len(cells) == _BATCH_CELLS:
                        yield made()
                        for filled in (owners, sizes, cells):
                            filled.clear()
            if cells:
                yield made()

    made_cells = pages.select(*[col(c) for c in [*keep, html]]).mapInArrow(parse, schema)
    return made_cells.select(*[col(c) for c in keep], F.inline(_CELLS))

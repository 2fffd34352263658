"""HTML tables as occupancy grids: placement, features, classes, column bands and record plans, one table at a time.

Placing a cell depends on all rows before it, so a table is read in one go; all that is derived from it is derived
there too, as a table is a row of its page's batch and nothing of it needs a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import cached_property

from quire.functions import html_tree as H

MAX_SPAN = 1000  # as browsers do
_ROW_HOLDERS = frozenset(("thead", "tbody", "tfoot", "form", "div", "center"))
_CELL_HOLDERS = frozenset(("form", "div", "center"))
_BLOCKS = frozenset(("table", "dl", "blockquote", "pre", "hr", "h1", "h2", "h3", "h4", "h5", "h6"))
CLASSES = ("SHELL", "LAYOUT", "DATA", "HYBRID", "CATALOG", "UNKNOWN")
MARGIN = 0.15


@dataclass
class Cell:
    cell: int
    row: int
    col: int
    row_span: int
    col_span: int
    is_header: bool
    text: str
    is_empty: bool
    links: int
    images: int
    inlineable: bool
    is_bold: bool
    slots: list[tuple[int, int]]
    node: H.Node

    @cached_property
    def kind(self) -> str:
        if self.is_empty:
            return "empty"
        if not self.images and not self.links and self.text[:1].isalpha():  # no year, no number
            return "longText" if len(self.text) > 80 else "shortText"
        if self.images and len(self.text) < 3:
            return "image"
        if self.links and len(self.text) < 40:
            return "link"
        if re.fullmatch(r"\d{4}", self.text):
            return "year"
        if re.fullmatch(r"[\d\s.,–—-]+", self.text):
            return "number"
        if self.images or self.links:
            return "mixed"
        return "longText" if len(self.text) > 80 else "shortText"

    @property
    def position(self) -> int | None:
        """The number of a cell that is one link to a numbered part: [3]."""
        found = re.fullmatch(r"\[\s*(\d{1,3})\s*\]", self.text)
        return int(found[1]) if found and self.links == 1 else None


@dataclass
class Grid:
    table: H.Node
    seq: int = 0  # among the tables of a page, in document order
    nesting: int = 0  # tables around it
    cells: list[Cell] = field(default_factory=list)
    n_rows: int = 0
    n_cols: int = 0
    nested: int = 0  # tables inside it
    bordered: bool = False
    warnings: list[str] = field(default_factory=list)

    def rows(self) -> dict[int, list[Cell]]:
        """The cells that begin in each row."""
        found: dict[int, list[Cell]] = defaultdict(list)
        for c in self.cells:
            found[c.row].append(c)
        return found

    @property
    def trailing(self) -> int:
        """Rows at the end, never the first, with nothing but empty cells; a row in which a cell with content goes on isn't empty."""
        last = max((c.row + c.row_span - 1 for c in self.cells if not c.is_empty), default=0)
        return max(0, self.n_rows - max(last, 0) - 1) if self.cells else 0

    def live(self) -> list[Cell]:
        end = self.n_rows - self.trailing
        return [c for c in self.cells if c.row < end]


def own_rows(table: H.Node) -> list[H.Node]:
    rows, stack = [], table.children[::-1]
    while stack:
        node = stack.pop()
        if node.tag == "tr":
            rows.append(node)
        elif node.tag in _ROW_HOLDERS:
            stack.extend(reversed(node.children))
    return rows


def own_cells(row: H.Node) -> list[H.Node]:
    cells, stack = [], row.children[::-1]
    while stack:
        node = stack.pop()
        if node.tag in ("td", "th"):
            cells.append(node)
        elif node.tag in _CELL_HOLDERS:
            stack.extend(reversed(node.children))
    return cells


def number(text: str | None) -> int | None:
    """The integer that a text begins with."""
    found = re.match(r"\s*(\d{1,9})", text) if text else None
    return int(found[1]) if found else None


def _span(node: H.Node, name: str, zero: int) -> int:
    n = number((node.attrs or {}).get(name))
    return 1 if n is None else zero if n == 0 else min(n, MAX_SPAN)


def _cell(i: int, node: H.Node, r: int, c: int, down: int, across: int, slots: list[tuple[int, int]]) -> Cell:
    inner = node.children
    if all(n.kind == "text" for n in inner):  # most cells
        text = H.collapsed("".join([n.value for n in inner]))
        return Cell(i, r, c, down, across, node.tag == "th", text, not text, 0, 0, True, node.tag == "th", slots, node)
    text = H.text_of(node)
    links = images = bold = paragraphs = 0
    blocks = False
    for n in H.below(node):
        tag = n.tag
        if tag == "#text":
            continue
        if tag == "a" and "href" in n.attrs:
            links += 1
        elif tag == "img":
            images += 1
        elif tag in ("b", "strong"):
            bold += len(H.text_of(n))
        elif tag == "p":
            paragraphs += bool(H.text_of(n))
        blocks = blocks or tag in _BLOCKS or tag in ("ul", "ol") and sum(c.tag == "li" for c in n.children) > 1
    return Cell(i, r, c, down, across, node.tag == "th", text, not text and not images, links, images, paragraphs <= 1 and not blocks, node.tag == "th" or bool(text) and bold >= 0.9 * len(text), slots, node)


def place(table: H.Node) -> Grid:
    """The grid of a table; the first claim on a slot wins.  rowspan 0 reaches the last row, colspan 0 is 1."""
    rows = own_rows(table)
    grid = Grid(table, n_rows=len(rows), bordered=(number((table.attrs or {}).get("border")) or 0) > 0)
    grid.nested = [n.tag for n in H.below(table)].count("table")
    taken: set[tuple[int, int]] = set()
    for r, row in enumerate(rows):
        c = 0
        for node in own_cells(row):
            while (r, c) in taken:
                c += 1
            if not node.attrs or "rowspan" not in node.attrs and "colspan" not in node.attrs:  # most cells
                taken.add((r, c))
                grid.cells.append(_cell(len(grid.cells), node, r, c, 1, 1, [(r, c)]))
                c += 1
                if c > grid.n_cols:
                    grid.n_cols = c
                continue
            down = max(1, min(_span(node, "rowspan", grid.n_rows - r), grid.n_rows - r))
            across = _span(node, "colspan", 1)
            if (number((node.attrs or {}).get("colspan")) or 0) > MAX_SPAN:
                grid.warnings.append("clamped span")
            slots = [(y, x) for y in range(r, r + down) for x in range(c, c + across) if (y, x) not in taken]
            if len(slots) < down * across:
                grid.warnings.append("overlapping spans")
            taken.update(slots)
            grid.cells.append(_cell(len(grid.cells), node, r, c, down, across, slots))
            c += across
            grid.n_cols = max(grid.n_cols, c)
    return grid


def grids(root: H.Node) -> list[Grid]:
    """All tables of a page, innermost first, in document order among those of one depth."""
    found, stack = [], [(root, 0)]
    if root.tree is not None:  # nothing but the tables is looked at
        ends: list[int] = []  # of the tables around
        for node in root.tree.order[root.at : root.to]:
            if node.tag == "table":
                while ends and ends[-1] <= node.at:
                    ends.pop()
                grid = place(node)
                grid.seq, grid.nesting = len(found), len(ends)
                found.append(grid)
                ends.append(node.to)
        stack = []
    while stack:
        node, depth = stack.pop()
        if node.tag == "table":
            grid = place(node)
            grid.seq, grid.nesting = len(found), depth
            found.append(grid)
            depth += 1
        stack.extend((c, depth) for c in reversed(node.children))
    return sorted(found, key=lambda g: (-g.nesting, g.seq))


# -- classes


def picture_paired(grid: Grid) -> float:
    """Of the rows of a grid of two columns that have two cells and any content, the share that pairs one picture with words."""
    if grid.n_cols != 2:
        return 0.0
    pairs = [[c.kind for c in row] for row in grid.rows().values() if len(row) == 2 and not all(c.is_empty for c in row)]
    worded = ("shortText", "longText", "link", "mixed")
    return sum(k.count("image") == 1 and sum(x in worded for x in k) == 1 for k in pairs) / len(pairs) if pairs else 0.0


def features(grid: Grid, frequency: float = 0.0) -> dict:
    """What the class of a table is judged by; empty rows at its end don't count."""
    live = grid.live()
    n, rows = len(live), defaultdict(list)
    for c in live:
        rows[c.row].append(c)
    neighbours = [a.kind == b.kind for row in rows.values() for a, b in zip(row, row[1:])]
    columns: dict[int, list[Cell]] = defaultdict(list)
    for c in live:
        for x in sorted({x for _, x in c.slots}):
            columns[x].append(c)
    entropy = []
    for cells in columns.values():
        kinds = Counter(c.kind for c in cells)
        entropy.append(math.log2(len(cells)) - sum(k * math.log2(k) for k in kinds.values()) / len(cells))
    first, headers = rows.get(0, []), sum(c.is_header for c in live)
    lone = lambda c: c.links == 1 and len(c.text) < 40
    widths = [sum(c.col_span for c in row) / max(1, grid.n_cols) for row in rows.values()]
    mean = sum(widths) / max(1, len(widths))
    area = max(1, grid.n_rows * grid.n_cols)
    return {
        "rows": grid.n_rows - grid.trailing,
        "cols": grid.n_cols,
        "cell_count": n,
        "nested_tables": grid.nested,
        "rowspan_count": sum(c.row_span > 1 for c in live),
        "colspan_count": sum(c.col_span > 1 for c in live),
        "has_header_row": len(first) >= 2 and (all(c.is_header for c in first) or headers >= len(first)),
        "header_cells": headers,
        "empty_ratio": sum(c.is_empty for c in live) / max(1, n),
        "avg_text_len": sum(len(c.text) for c in live) / max(1, n),
        "max_text_len": max((len(c.text) for c in live), default=0),
        "link_density": sum(c.links for c in live) / max(1, n),
        "image_density": sum(c.images for c in live) / max(1, n),
        "neighbour_similarity": sum(neighbours) / len(neighbours) if neighbours else 0.0,
        "column_entropy": sum(entropy) / len(entropy) if entropy else 0.0,
        "width_variance": sum((w - mean) ** 2 for w in widths) / max(1, len(widths)),
        "has_border": grid.bordered,
        "content_cells": sum(not c.is_empty for c in live),
        "prosey_cells": sum(len(c.text) > 120 for c in live),
        "grid_regularity": sum(len(c.slots) for c in grid.cells) / area,
        "link_column": any(sum(not c.is_empty for c in cells) >= 3 and all(c.is_empty or lone(c) for c in cells) for cells in columns.values()),
        "picture_paired": picture_paired(grid),
        "corpus_frequency": frequency,
    }


def scores(f: dict) -> dict[str, float]:
    """Additive evidence for each class."""
    plain = not f["has_border"] and not f["has_header_row"]
    spans = f["colspan_count"] + f["rowspan_count"] > f["rows"]
    header = f["has_header_row"]
    return {
        "SHELL": f["corpus_frequency"] * 0.8 + 0.2 * (f["avg_text_len"] < 8 and f["cell_count"] > 3) + 0.2 * (f["image_density"] > 0.6 and f["avg_text_len"] < 5),
        "LAYOUT": 0.35 * (f["nested_tables"] > 0) + 0.2 * (f["empty_ratio"] > 0.35) + 0.25 * (f["max_text_len"] > 300) + 0.15 * (f["grid_regularity"] < 0.8) + 0.15 * plain + 0.15 * (f["rows"] <= 2) + 0.15 * spans - 0.3 * header,
        "DATA": 0.35 * header + 0.2 * (f["grid_regularity"] > 0.95) + 0.15 * (f["neighbour_similarity"] < 0.5) + 0.2 * (f["column_entropy"] < 0.6) + 0.15 * (f["rows"] >= 3 and f["cols"] >= 2)
        + (0.1 if f["max_text_len"] < 120 else -0.2) + 0.05 * f["has_border"] - 0.35 * (f["nested_tables"] > 0) - 0.25 * (f["empty_ratio"] > 0.35),
        "HYBRID": 0.4 * (header and f["nested_tables"] > 0) + 0.2 * (f["image_density"] > 0.2 and header) + 0.2 * (f["max_text_len"] > 200 and f["grid_regularity"] > 0.9 and f["cols"] >= 2),
        "CATALOG": 0.3 * (f["image_density"] > 0.3 and f["cols"] == 2 and f["rows"] >= 2) + 0.1 * (f["cols"] == 2),
        "UNKNOWN": 0.15,
    }


def classify(f: dict, peers: int = 0) -> tuple[str, float, int]:
    """(class, confidence, tier): gates in their order, else scores, of which the best must lead by MARGIN.

    peers: other tables of the page all of whose rows pair a picture with words.
    """
    gates = (
        (f["corpus_frequency"] > 0.7, "SHELL", 0.95),
        (f["rows"] == 1 and f["cols"] == 1, "LAYOUT", 0.97),
        (f["content_cells"] == 1 and f["cell_count"] > 1, "LAYOUT", 0.9),
        (f["has_header_row"] and f["rows"] >= 3 and f["cols"] >= 2 and f["max_text_len"] < 400, "DATA", 0.93),
        (f["link_column"], "DATA", 0.88),
        (f["rows"] >= 3 and f["grid_regularity"] == 1 and f["max_text_len"] < 80 and f["cols"] >= 2 and f["empty_ratio"] < 0.2, "DATA", 0.85),
        (f["nested_tables"] > 0 and f["prosey_cells"] > 1, "HYBRID", 0.8),
        (f["cols"] == 2 and f["picture_paired"] == 1 and (f["rows"] >= 2 or peers >= 1), "CATALOG", 0.85),
    )
    for test, kind, sure in gates:
        if test:
            return kind, sure, 1
    ranked = sorted(((round(s, 9), -i, k) for i, (k, s) in enumerate(scores(f).items())), reverse=True)
    lead = round(ranked[0][0] - ranked[1][0], 9)
    return "UNKNOWN" if lead < MARGIN else ranked[0][2], max(0.0, min(1.0, ranked[0][0])), 2


# -- plans


def column_bands(grid: Grid, cells: list[Cell] | None = None) -> list[tuple[int, int]]:
    """[start, end) of the columns that most full-width rows agree on; a header row with no more of them wins."""
    rows: dict[int, list[Cell]] = defaultdict(list)
    for c in grid.cells if cells is None else cells:
        rows[c.row].append(c)
    full = {r: row for r, row in rows.items() if max(c.col + c.col_span for c in row) == grid.n_cols}
    votes: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for r, row in sorted(full.items()):
        votes[tuple(sorted(c.col for c in row))].append(r)
    if not votes:
        return []
    bounds = min(votes, key=lambda b: (-len(votes[b]), len(b), votes[b][0]))
    head = next((tuple(sorted(c.col for c in row)) for r, row in sorted(full.items()) if r < 2 and len(row) >= 2 and all(c.is_header for c in row)), None)
    if head is not None and len(head) <= len(bounds):
        bounds = head
    bounds = sorted(set(bounds))
    return list(zip(bounds, [*bounds[1:], grid.n_cols]))


def fold_ordinals(bands: list[tuple[int, int]], cells: list[Cell], most: int = 8) -> list[tuple[int, int]]:
    """Bands of a strip of numbered links ([1] [2] [3] ...) become one, where there are more than ``most`` bands."""
    if len(bands) <= most:
        return bands
    starts = {start: i for i, (start, _) in enumerate(bands)}
    by_row: dict[int, dict[int, Cell]] = defaultdict(dict)
    for c in cells:
        if c.col in starts:
            by_row[c.row][starts[c.col]] = c
    foreign = {i for row in by_row.values() for i, c in row.items() if not c.is_empty and c.position is None}
    joined: set[int] = set()  # bands that go with the one before
    for row in by_row.values():
        run: list[int] = []
        for i in [*range(len(bands)), None]:
            c = row.get(i) if i is not None else None
            n = c.position if c is not None and i not in foreign else None
            if n is not None and (not run or n > row[run[-1]].position):
                run.append(i)
                continue
            if len(run) >= 3:
                joined.update(run[1:])
            run = [i] if n is not None else []
    out: list[tuple[int, int]] = []
    for i, (start, end) in enumerate(bands):
        if i in joined and out:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def leading_caption(grid: Grid) -> Cell | None:
    """The first cell, if it alone fills the first row, is bold, and the body isn't."""
    rows = grid.rows()
    first, rest = rows.get(0, []), [c for c in grid.live() if c.row > 0 and not c.is_empty]
    if len(first) == 1 and first[0].col_span >= grid.n_cols > 1 and first[0].is_bold and not first[0].is_empty and first[0].row_span == 1 and rest and not all(c.is_bold for c in rest):
        return first[0]
    return None


def planned(cells: list[Cell], bands: list[tuple[int, int]], n_cols: int) -> dict[tuple[int, int], dict]:
    """(row, band) -> what its cells hold together."""
    out: dict[tuple[int, int], dict] = {}
    starts = [start for start, _ in bands]
    for c in cells:
        b = bisect_right(starts, c.col) - 1
        if b >= 0 and c.col < bands[b][1]:
            x = out.get((c.row, b))
            if x is None:
                x = out[c.row, b] = {"cells": [], "crosses": False}
            x["cells"].append(c)
            x["crosses"] |= c.col + c.col_span > bands[b][1] and c.col + c.col_span != n_cols
    for x in out.values():
        if len(x["cells"]) == 1:  # most of them
            c = x["cells"][0]
            x.update(text=c.text, n_sources=1, is_empty=c.is_empty, is_header=c.is_header, links=c.links, images=c.images, text_len=len(c.text), blocks=not c.inlineable)
            continue
        held = sorted(x["cells"], key=lambda c: (c.col, c.text))
        x.update(
            text=" ".join(c.text for c in held), n_sources=len(held), is_empty=all(c.is_empty for c in held), is_header=all(c.is_header for c in held), links=sum(c.links for c in held),
            images=sum(c.images for c in held), text_len=sum(len(c.text) for c in held), blocks=not all(c.inlineable for c in held),
        )
    return out


@dataclass
class Plan:
    bands: list[tuple[int, int]]
    n_body: int
    header: bool
    failure: str | None
    matrix: dict[tuple[int, int], dict]

    def occupied(self) -> list[int]:
        """Bands that some cell fills or a header names, unless fewer than two would be left."""
        filled = sorted({b for (_, b), x in self.matrix.items() if not x["is_empty"]})
        return filled if len(filled) >= 2 else list(range(len(self.bands)))


def plan(grid: Grid, min_rows: int = 2, min_cols: int = 2, max_cols: int = 8, below: int = 0) -> Plan:
    """Whether a table, from row ``below`` on, is a record matrix, or the first reason why not."""
    cells = [c for c in grid.live() if c.row >= below]
    bands = fold_ordinals(column_bands(grid, [c for c in grid.cells if c.row >= below]), cells, max_cols)
    matrix = planned(cells, bands, grid.n_cols)
    rows = sorted({r for r, _ in matrix})
    top = rows[0] if rows else 0
    first = [x for (r, _), x in matrix.items() if r == top]
    body = [x for (r, _), x in matrix.items() if r != top]
    filled = [x for x in matrix.values() if not x["is_empty"]]
    real = len(first) == len(bands) and all(x["is_header"] for x in first)
    media = lambda x: x["links"] > 0 or x["images"] > 0
    labels = len(first) == len(bands) and all(not x["is_empty"] and not media(x) and 1 <= x["text_len"] <= 60 for x in first) and any(map(media, body))
    header = bool(first) and (real or labels and len(rows) >= 3)
    picture = lambda x: x["images"] > 0 and x["text_len"] < 3
    n_body, failure = len(rows) - header, None
    per_band: dict[int, list[dict]] = defaultdict(list)
    long: Counter = Counter()
    for (r, b), x in matrix.items():
        if not x["is_empty"]:
            per_band[b].append(x)
        long[r] += x["text_len"] > 180
    tests = (
        (grid.n_rows - grid.trailing - below < min_rows, "too-small"),
        (not bands, "no-bands"),
        (len(bands) < min_cols, "too-small"),
        (len(bands) > max_cols, "too-many-columns"),
        (any(x["crosses"] for x in matrix.values()), "cell-crosses-band"),
        (any(x["blocks"] for x in matrix.values()), "cell-needs-blocks"),
        (len(rows) < min_rows, "no-body"),
        (any(n > 1 for n in long.values()), "prose-matrix"),
        (any(len(x) >= 2 and sum(map(picture, x)) >= 0.6 * len(x) for x in per_band.values()), "media-lane"),
        (len(filled) >= 4 and sum(x["images"] > 0 for x in filled) >= 0.5 * len(filled), "media-catalog"),
        (n_body == 0, "no-body"),
    )
    failure = next((what for test, what in tests if test), None)
    return Plan(bands, n_body, header, failure, matrix)


def wide_enough(confidence: float, header: bool, n_bands: int, least: float = 0.75) -> bool:
    """Whether a verdict from outside that a table holds data is believed."""
    return confidence >= least and (header or n_bands >= 3)


def synthesized_header(p: Plan, canonical: dict[str, str] | None = None) -> dict[int, str]:
    """A label for each band: the dominant text (60 % of three cells and more, 24 characters at most), a link sign for bare links, else ''."""
    out = {}
    for b in range(len(p.bands)):
        held = [x for (_, k), x in p.matrix.items() if k == b and not x["is_empty"]]
        if not held:
            continue
        counts = Counter(x["text"] for x in held)
        text, n = min(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        label = ""
        if len(held) >= 3 and n >= 0.6 * len(held) and len(text) <= 24:
            label = text
        elif sum(x["links"] for x in held) == len(held) and max(x["text_len"] for x in held) < 40:
            label = "🔗"
        out[b] = (canonical or {}).get(label.lower(), label)
    return out

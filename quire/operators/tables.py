"""HTML tables of pages as rows: cells, slots, features, classes, bands and plans.

A page is one row, and all its tables are read in its batch (quire.functions.grids), innermost first.  Each of these relations
is one narrow map over the pages: no exchange, whatever the size of the corpus.  They are keyed by the page's id
(table_id) and the table's place in it (seq).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.functions import batches as B, grids as G, html_tree as H

SHORT, FEW, MOST_SEEN = 2000, 16, 5000  # characters and rows of the pages that are kept with their rows, and how many of them
KEY = "table_id bigint, seq int"
CELLS = (
    f"{KEY}, nesting int, n_rows int, n_cols int, nested int, bordered boolean, cell int, row int, col int, row_span int, col_span int, is_header boolean, text string, is_empty boolean, "
    "links int, images int, inlineable boolean, is_bold boolean, kind string, slots array<struct<row:int,col:int>>"
)
FEATURES = (
    f"{KEY}, rows int, cols int, cell_count int, nested_tables int, rowspan_count int, colspan_count int, has_header_row boolean, header_cells int, empty_ratio double, avg_text_len double, max_text_len int, "
    "link_density double, image_density double, neighbour_similarity double, column_entropy double, width_variance double, has_border boolean, content_cells int, prosey_cells int, grid_regularity double, "
    "link_column boolean, picture_paired double, corpus_frequency double"
)


def _each(tables: DataFrame, id_col: str, html: str, schema: str, of: Callable[[list[G.Grid]], Iterable[dict]]) -> DataFrame:
    """Rows that ``of`` makes of all grids of each page; a short page whose like was seen in the same task isn't read again."""
    seen: dict[str, list[dict]] = {}

    def rows(i: int, text: str | None) -> Iterator[dict]:
        text = text or ""
        made = seen.get(text)
        if made is None:
            made = list(of(G.grids(H.build(text)[0])))
            if len(text) <= SHORT and len(made) <= FEW:
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen[text] = made
        for row in made:
            yield {"table_id": i, **row}

    return B.rows_of(tables, id_col, html, schema, rows, "table_id")


def grid_cells(tables: DataFrame, id_col: str = "table_id", html: str = "html") -> DataFrame:
    """One row for each cell of every table of each HTML text (schema CELLS).

    A null text or one without a table has no rows.  Spans are clamped to grids.MAX_SPAN, rowspan 0 reaches the last row, colspan 0 is 1.
    """

    def of(grids: list[G.Grid]) -> Iterator[dict]:
        for g in grids:
            fixed = {"seq": g.seq, "nesting": g.nesting, "n_rows": g.n_rows, "n_cols": g.n_cols, "nested": g.nested, "bordered": g.bordered}
            for c in g.cells:
                own = {k: getattr(c, k) for k in ("cell", "row", "col", "row_span", "col_span", "is_header", "text", "is_empty", "links", "images", "inlineable", "is_bold", "kind")}
                yield {**fixed, **own, "slots": [{"row": y, "col": x} for y, x in c.slots]}

    return _each(tables, id_col, html, CELLS, of)


def grid_warnings(tables: DataFrame, id_col: str = "table_id", html: str = "html") -> DataFrame:
    """(table_id, seq, warning, n): overlapping and clamped spans."""
    of = lambda grids: ({"seq": g.seq, "warning": w, "n": g.warnings.count(w)} for g in grids for w in sorted(set(g.warnings)))
    return _each(tables, id_col, html, f"{KEY}, warning string, n int", of)


def grid_slots(cells: DataFrame) -> DataFrame:
    """(table_id, seq, row, col, cell, text, is_origin): every occupied slot."""
    s = cells.select("table_id", "seq", "cell", "text", F.col("row").alias("r"), F.col("col").alias("c"), F.explode("slots").alias("s"))
    return s.select("table_id", "seq", "s.row", "s.col", "cell", "text", ((F.col("s.row") == F.col("r")) & (F.col("s.col") == F.col("c"))).alias("is_origin"))


def trailing_empty(tables: DataFrame, id_col: str = "table_id", html: str = "html") -> DataFrame:
    """(table_id, seq, n_rows, n_trailing): rows at the end, never the first, that are empty."""
    of = lambda grids: ({"seq": g.seq, "n_rows": g.n_rows, "n_trailing": g.trailing} for g in grids)
    return _each(tables, id_col, html, f"{KEY}, n_rows int, n_trailing int", of)


def table_features(tables: DataFrame, id_col: str = "table_id", html: str = "html") -> DataFrame:
    """One row of features for each table (schema FEATURES)."""
    return _each(tables, id_col, html, FEATURES, lambda grids: ({"seq": g.seq, **G.features(g)} for g in grids))


def classify_tables(tables: DataFrame, id_col: str = "table_id", html: str = "html") -> DataFrame:
    """(table_id, seq, class, confidence, tier): gates first, then scores with a margin; tables of one page know of each other's pictures."""

    def of(grids: list[G.Grid]) -> Iterator[dict]:
        paired = {g.seq for g in grids if G.picture_paired(g) == 1}
        for g in grids:
            kind, sure, tier = G.classify(G.features(g), len(paired - {g.seq}))
            yield {"seq": g.seq, "class": kind, "confidence": sure, "tier": tier}

    return _each(tables, id_col, html, f"{KEY}, class string, confidence double, tier int", of)


def column_bands(tables: DataFrame, id_col: str = "table_id", html: str = "html") -> DataFrame:
    """(table_id, seq, band, start, end)."""
    of = lambda grids: ({"seq": g.seq, "band": i, "start": a, "end": b} for g in grids for i, (a, b) in enumerate(G.column_bands(g)))
    return _each(tables, id_col, html, f"{KEY}, band int, start int, end int", of)


def planned_cells(tables: DataFrame, id_col: str = "table_id", html: str = "html") -> DataFrame:
    """(table_id, seq, row, band, text, n_sources, is_empty, links, images): cells dealt to the bands of their table."""

    def of(grids: list[G.Grid]) -> Iterator[dict]:
        for g in grids:
            for (row, band), x in G.planned(g.live(), G.column_bands(g), g.n_cols).items():
                yield {"seq": g.seq, "row": row, "band": band, **{k: x[k] for k in ("text", "n_sources", "is_empty", "links", "images")}}

    return _each(tables, id_col, html, f"{KEY}, row int, band int, text string, n_sources int, is_empty boolean, links int, images int", of)


def plan_tables(tables: DataFrame, id_col: str = "table_id", html: str = "html", **limits) -> DataFrame:
    """(table_id, seq, n_bands, n_body, header, failure): whether a table is a record matrix, or the first reason why not."""

    def of(grids: list[G.Grid]) -> Iterator[dict]:
        for g in grids:
            p = G.plan(g, **limits)
            yield {"seq": g.seq, "n_bands": len(p.bands), "n_body": p.n_body, "header": p.header, "failure": p.failure}

    return _each(tables, id_col, html, f"{KEY}, n_bands int, n_body int, header boolean, failure string", of)


def occupied_bands(tables: DataFrame, id_col: str = "table_id", html: str = "html") -> DataFrame:
    """(table_id, seq, band): the bands that some cell fills, unless fewer than two would be left."""
    of = lambda grids: ({"seq": g.seq, "band": b} for g in grids for b in G.plan(g).occupied())
    return _each(tables, id_col, html, f"{KEY}, band int", of)


def synthesized_header(tables: DataFrame, id_col: str = "table_id", html: str = "html", canonical: dict[str, str] | None = None) -> DataFrame:
    """(table_id, seq, band, label).  canonical: a vocabulary of labels, lower-case synonym to house label."""
    of = lambda grids: ({"seq": g.seq, "band": b, "label": label} for g in grids for b, label in G.synthesized_header(G.plan(g), canonical).items())
    return _each(tables, id_col, html, f"{KEY}, band int, label string", of)

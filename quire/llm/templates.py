"""HTML extraction with site templates removed (operator 8).

Every block element's subtree (tags, attributes, texts) is hashed, Spark counts on how many distinct pages of a
host each hash occurs, and subtrees that recur on many pages of their host are deleted before the text is taken.

A page is parsed once.  Its blocks (hash, and the block around it) and its text (pieces, each with the innermost block that holds it) are
written, counted, and put together again without the pieces of templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.functions import html_tree as H
from quire.llm import shared, words as W

MIN_PAGES = 5  # fewer pages may share a list or a card that is their content
MIN_SHARE = 0.2  # of the pages of a host
BROADCAST_SUBTREES = 2_000_000
_SPACE = re.compile(r"[\s\ufeff]+")
_FRAME = frozenset(("html", "head", "body"))
_HIDDEN = frozenset(("head", "script", "style", "noscript", "template"))


def subtree_hashes(root: H.Node) -> dict[int, int]:
    """id(node) -> hash, for block elements that hold text; html, head, body and what is hidden are left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag not in _HIDDEN:
            stack.extend(node.children)
    digest: dict[int, bytes] = {}
    held: set[int] = set()
    found: dict[int, int] = {}
    for node in reversed(order):
        if node.kind == "text":
            value = node.value.strip()
            if value:
                held.add(id(node))
            digest[id(node)] = xxhash.xxh64_digest(value.encode("utf-8", "replace")) if value else b""
        elif node.kind == "element" and node.tag not in _HIDDEN:
            parts = [node.tag.encode("utf-8", "replace"), *(f"{k}={v}".encode("utf-8", "replace") for k, v in sorted((node.attrs or {}).items())), b">"]
            for child in node.children:
                parts.append(digest[id(child)])
                if id(child) in held:
                    held.add(id(node))
            digest[id(node)] = whole = xxhash.xxh64_digest(b"\0".join(parts))
            if id(node) in held and node.tag in H.BLOCK and node.tag not in _FRAME:
                found[id(node)] = int.from_bytes(whole, "big", signed=True) or 1
        else:
            digest[id(node)] = b""
    return found


def cut(root: H.Node, templates) -> int:
    """Delete the outermost subtrees whose hash is in templates; how many they are.  What extract() does to a page, on its tree."""
    hashes, removed, stack = subtree_hashes(root), 0, [root]
    while stack:
        node = stack.pop()
        gone = [child for child in node.children if hashes.get(id(child)) in templates]
        if gone:
            removed += len(gone)
            dropped = set(map(id, gone))
            node.children = [child for child in node.children if id(child) not in dropped]
        stack.extend(node.children)
    return removed


def flat(root: H.Node) -> tuple[list[int], list[int], list[str], list[int]]:
    """(hash of each block, place of the block around it or -1, pieces of text, place of the innermost block that holds each)."""
    hashes = subtree_hashes(root)
    blocks: list[int] = []
    around: list[int] = []
    pieces: list[str] = []
    owners: list[int] = []
    stack = [(root, -1)]
    while stack:
        node, owner = stack.pop()
        value = ""
        if node.kind == "text":
            value = node.value
        elif node.kind == "element" and node.tag not in _HIDDEN:
            own = hashes.get(id(node))
            if own is not None:
                blocks.append(own)
                around.append(owner)
                owner = len(blocks) - 1
            if node.tag == "br" or node.tag in H.BLOCK:
                value = " "
            stack.extend([(child, owner) for child in reversed(node.children)])
        if value:
            if owners and owners[-1] == owner:
                pieces[-1] += value
            else:
                pieces.append(value)
                owners.append(owner)
    return blocks, around, pieces, owners


def without(blocks: list[int], around: list[int], pieces: list[str], owners: list[int], templates) -> tuple[str, int]:
    """(text, subtrees deleted) of a page: blocks in templates go with all that they hold."""
    gone, removed = [], 0
    for own, up in zip(blocks, around):
        inside = up >= 0 and gone[up]
        gone.append(inside or own in templates)
        removed += gone[-1] and not inside
    return _SPACE.sub(" ", "".join(p for p, o in zip(pieces, owners) if o < 0 or not gone[o])).strip(), removed


def host_of(url) -> F.Column:
    """The host of a URL, lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


_FLAT = "page bigint, blocks array<bigint>, around array<int>, pieces array<string>, owners array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """pages (id, url, html, host) with _FLAT instead of the html; page tells pages with different html apart."""
    kind = dict(pages.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, 3):
            made, own = [], []
            for html in batch.column(3).to_pylist():
                made.append(flat(H.build(html or "")[0]))
                own.append(None if html is None else xxhash.xxh64_intdigest(html.encode("utf-8", "replace")) - (1 << 63))
            columns = [pa.array([m[i] for m in made], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.int64()), *columns], ["id", "url", "host", "page", "blocks", "around", "pieces", "owners"])

    return pages.select("id", "url", "host", "html").mapInArrow(run, f"id {kind}, url string, host bigint, {_FLAT}")


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree): the hashes that occur on at least min_pages distinct pages and min_share of all of the host.

    pages is as parsed() makes it; pages with the same html count once, so that a page that is copied isn't a template.
    """
    given = pages.where("host IS NOT NULL AND page IS NOT NULL")
    held = F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), "blocks"))).alias("subtree")  # 0 stands for the page
    counts = given.select("host", "page", held).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    counts = shared.written(counts.where((F.col("n") >= min_pages) | (F.col("subtree") == 0)), "subtrees")
    sizes = counts.where("subtree = 0").select("host", F.col("n").alias("pages"))
    found = counts.where("subtree <> 0").join(sizes, "host").where(F.col("n") >= F.greatest(F.lit(min_pages), F.col("pages") * min_share)).select("host", "subtree")
    found = shared.written(found, "templates")
    shared.drop(counts)
    return found


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    broadcast_subtrees: int = BROADCAST_SUBTREES,
) -> DataFrame:
    """One row for each row of pages: id, url, text (without templates), n_removed (subtrees deleted).

    html, head, body and page copies are no templates (see template_subtrees).  A page whose URL is null or has no host
    keeps all its text; null html gives an empty text.  Null ids and repeated rows give their row each.  An empty table gives
    an empty result.  Other columns are ignored, whatever their names.

    The template hashes are sent to every task while there are at most broadcast_subtrees; beyond that, they join
    the pages by host.
    """
    spark = pages.sparkSession
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    given = given.withColumn("host", F.when(host_of(F.col("url")).isNotNull(), F.xxhash64(host_of(F.col("url")))))
    read = shared.written(parsed(given), "parsed")
    templates = template_subtrees(read, min_pages, min_share)
    kind = dict(given.dtypes)["id"]
    schema = f"`{id_col}` {kind}, `{url_col}` string, text string, n_removed bigint"
    fields = [id_col, url_col, "text", "n_removed"]

    def rows(batch: pa.RecordBatch, known) -> pa.RecordBatch:
        made = [without(*page, known(i)) for i, page in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3, 7))))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], fields)

    def piece_bytes(lists: pa.Array) -> np.ndarray:
        """Of all pieces of each page."""
        total = np.concatenate([[0], np.cumsum(W.text_bytes(lists.flatten()))])
        return np.diff(total[np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())])])

    columns = ["id", "url", "host", "blocks", "around", "pieces", "owners"]
    if templates.count() <= broadcast_subtrees:
        table = templates.toArrow()
        order = np.argsort(table["host"].to_numpy(), kind="stable")
        hosts, subtrees = table["host"].to_numpy()[order], table["subtree"].to_numpy()[order]
        sent = spark.sparkContext.broadcast((hosts, subtrees))

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hosts, subtrees = sent.value
            at = np.flatnonzero(np.concatenate([[True], hosts[1:] != hosts[:-1]])) if len(hosts) else np.zeros(0, np.int64)
            of = {int(hosts[a]): frozenset(subtrees[a:b].tolist()) for a, b in zip(at, np.append(at[1:], len(hosts)))}
            for batch in W.slices(batches, 5, length=piece_bytes):
                host = batch.column(2).to_pylist()
                yield rows(batch, lambda i: of.get(host[i], frozenset()))

        return read.select(*columns).mapInArrow(by_broadcast, schema)

    lists = templates.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))
    joined = read.join(lists, "host", "left").select(*columns, "subtrees")

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, 5, length=piece_bytes):
            lists = batch.column(7).to_pylist()
            yield rows(batch, lambda i: frozenset(lists[i] or ()))

    return joined.mapInArrow(by_join, schema)

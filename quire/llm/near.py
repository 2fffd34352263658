"""SimHash near-duplicates found with an LSH forest (operator 2).

Fingerprint: 512 bits, the sign of the summed random +-1 vectors of a text's word pairs, so the
share of differing bits grows with the angle between the word-pair counts of two texts.

Forest: each try orders the fingerprints by its own random permutation of the bits and is descended
where it is dense (more than ``leaf`` fingerprints share a prefix).  From its deepest prefixes it climbs to shorter
ones, and compares at each what the longer ones kept apart, until the prefix is short enough for the target: with
T tries, two fingerprints that differ in a share ``design`` of their bits share a prefix of ``depth`` bits in at
least one try with probability 1 - (1 - (1 - design) ** depth) ** T, and climbing ends at the greatest depth for which
that reaches ``recall``.  T is the least number of tries for which such a prefix still leaves cells of about ``leaf``
fingerprints.  Sparse cells are compared at shorter prefixes, where recall is higher.

All pairs of a cell are verified by all 512 bits, without any cap on partners, except those that are in one group
already; so a dense cluster, which the deep prefixes join, costs no square.  A cell of more than
``block`` fingerprints is dealt into blocks, and every two of them meet in a task of their own.

Only one fingerprint of equal ones enters the forest.  Groups are connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import shared, words as W

BITS = 512
RADIUS = 0.20  # share of bits in which near-duplicates may differ: a cosine of word-pair counts of about 0.81
DESIGN = RADIUS  # share of differing bits for which the recall is promised: nearer pairs meet more often
RECALL = 0.95
LEAF = 1024
BLOCK = 1 << 17  # fingerprints of a cell that one task holds, or two times as many


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 64) bytes, and the number of words of each text."""
    found = W.scan(texts)
    n = np.diff(found.first)
    at, pairs = W.windows(found, 2)
    features, doc = pairs, found.doc[at]
    lone = np.flatnonzero(n == 1)
    if len(lone):
        features = np.concatenate([features, found.hashes[found.first[lone]]])
        doc = np.concatenate([doc, lone])
        order = np.argsort(doc, kind="stable")
        features, doc = features[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(n) + 1))
    result = np.zeros((len(n), BITS // 8), np.uint8)
    salts = W.mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = 1 << 14
    for a in range(0, len(n)):
        lo, hi = first[a], first[a + 1]
        if hi > lo:
            ones = np.zeros(BITS, np.int64)
            for at in range(lo, hi, step):
                some = W.mix(features[at : min(at + step, hi), None] ^ salts[None, :])
                ones += np.unpackbits(some.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
            result[a] = np.packbits(2 * ones > hi - lo)
    return result, n


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def tries(n: int, design: float = DESIGN, recall: float = RECALL, leaf: int = LEAF) -> tuple[int, int]:
    """(number of tries, greatest prefix depth) for n distinct fingerprints."""
    depth = min(31, max(0, math.ceil(math.log2(max(n, 1) / leaf))))
    meet = (1 - design) ** depth
    return (1 if depth == 0 else math.ceil(math.log(1 - recall) / math.log(1 - meet))), depth


def _link(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the components of i[x] and j[x]; label[v] is the least index of v's component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _compare(rows: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int) -> None:
    """Link all pairs of left (or of left and right) that differ in at most radius bits; pairs of one group are skipped.

    Half of the bits are looked at first: if more than radius differ there, the pair is far.
    """
    half = [np.ascontiguousarray(rows[:, i]) for i in range(4)]
    while len(left):
        group = label[left[0]]
        mine = label[left] == group
        if mine.sum() > 32:  # many of one group: only those outside of it are left to be compared
            mine[np.flatnonzero(mine)[256:]] = False
            block, left = left[mine], left[~mine]
            others = left if right is None else right
            others = others[label[others] != group]
        else:
            block, others = left[:256], left if right is None else right
            left = left[256:]
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            far = np.bitwise_count(half[0][block, None] ^ half[0][None, some]).astype(np.uint16)
            for column in half[1:]:
                far += np.bitwise_count(column[block, None] ^ column[None, some])
            i, j = np.nonzero(far <= radius)
            i, j = block[i], some[j]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            for part in range(0, len(i), 1 << 16):
                a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                near = np.bitwise_count(rows[a] ^ rows[b]).sum(axis=1) <= radius
                _link(label, a[near], b[near])


def cell_links(ids: np.ndarray, rows: np.ndarray, keys: np.ndarray, start: int, depth: int, radius: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id of its local group) in one cell of one try; keys are 32 permuted bits, alike in the first ``start``."""
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    rows = np.ascontiguousarray(rows[order]).view(np.uint64)
    label = np.arange(len(ids))

    def climb(lo: int, hi: int, at: int) -> None:
        if hi - lo <= leaf or at >= 31:
            _compare(rows, label, np.arange(lo, hi), None, radius)
            return
        mid = lo + int(np.searchsorted((keys[lo:hi] >> (31 - at)) & 1, 1))
        climb(lo, mid, at + 1)
        climb(mid, hi, at + 1)
        if at >= depth:  # the prefix is shared as often as the target asks: nothing may be left out
            _compare(rows, label, np.arange(lo, mid), np.arange(mid, hi), radius)

    climb(0, len(ids), start)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    linked = root != ids
    return ids[linked], root[linked]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (node, root: bigint) other than each component's least node.

    Alternates large-star and small-star steps until the links are stars.  The least neighbour of a node is an
    aggregate, combined before the shuffle, and joins its links, which adaptive execution splits at hubs; each step is
    written to the shared folder.
    """
    spark = links.sparkSession
    links = shared.written(links.select("node", "root").where("node <> root").distinct(), "links")
    before = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if mark == before:
            return links
        before = mark
        both = links.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        large = shared.written(large, "links")
        down = large.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).where("u <> v")
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("m").alias("root")), F.struct(F.col("v").alias("node"), F.col("m").alias("root")))).alias("x")).select("x.node", "x.root")
        after = shared.written(small.where("node <> root").distinct(), "links")
        shared.drop(links, large)
        links = after


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: float = RADIUS,
    design: float | None = None,
    recall: float = RECALL,
    leaf: int = LEAF,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, duplicate_of) for every document that has a near-duplicate with a lesser id: the least id of its group.

    Ids are integers; a row with a null id and a text without words (null, empty, only signs) are never
    grouped.  Rows that repeat an id count as one document and share its group.  An empty table gives an
    empty result.  Other columns are ignored, whatever their names.  The recall is that of a pair at ``design``, by
    default the radius, so of every pair that counts as near.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            rows, n = fingerprints(batch.column(1))
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), _binary(rows).filter(some)], ["doc_id", "print"])

    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    printed = shared.written(given.mapInArrow(prints, "doc_id bigint, print binary"), "prints")
    nodes = shared.written(printed.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    total = nodes.count()
    count, depth = tries(total, radius if design is None else design, recall, leaf)
    start, far = max(0, depth - 4), round(radius * BITS)
    chosen = [np.random.default_rng(1000 + t).permutation(BITS)[:32] for t in range(count)]

    def cells_of(prints: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bits = np.unpackbits(_rows(prints), axis=1)
        for t in range(count):
            key = np.ascontiguousarray(np.packbits(bits[:, chosen[t]], axis=1)).view(">u4").ravel().astype(np.int64)
            yield (key >> (32 - start)) + (t << 32), key

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, _ in cells_of(batch.column(0)) if len(batch) else ():
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, key in cells_of(batch.column(1)) if len(batch) else ():
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(key), batch.column(0), batch.column(1)], ["cell", "key", "node", "print"])

    def link(cells: pa.Table) -> pa.Table:
        node, root = cell_links(cells["node"].to_numpy(), _rows(cells["print"]), cells["key"].to_numpy(), start, depth, far, leaf)
        return pa.table({"node": node, "root": root})

    placed = nodes.select("node", "print").mapInArrow(place, "cell bigint, key bigint, node bigint, print binary")
    task = ["cell"]
    if total > block:
        large = nodes.select("print").mapInArrow(sizes, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > block)
        large = shared.written(large.select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cells")
        if not large.isEmpty():
            # Spark sends the few large cells to all tasks if their table is small
            mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
            placed = placed.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine)
            placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            placed = placed.select("cell", "key", "node", "print", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
            task = ["cell", "one", "two"]
    links = placed.groupBy(*task).applyInArrow(link, "node bigint, root bigint")
    copies = printed.join(nodes.where("n > 1").select("print", "node"), "print").where("doc_id <> node").select("doc_id", "node")
    # an id that comes with several texts links their groups
    several = shared.written(printed.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    twice = not several.isEmpty()
    if twice:
        links = links.unionByName(copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), F.col("node").alias("root")))
        copies = copies.join(several, "doc_id", "left_anti")
    roots = components(links)
    joined = copies.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("duplicate_of"))
    found = shared.written(joined.unionByName(roots.select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))), "duplicates")
    shared.drop(printed, nodes, several, roots, *([large] if total > block else []))
    return found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those whose near-duplicate group has a lesser id; of rows that repeat an id, one stays.

    All columns are kept.  Rows with a null id, and texts without words under distinct ids, stay.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).select(F.col("doc_id").alias(id_col))
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    repeated = shared.written(repeated, "repeated")
    kept = docs.join(gone, id_col, "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    row = shared.fresh(docs.columns, "__row")
    order = F.struct(F.xxhash64(text_col), F.xxhash64(*[f"`{c}`" for c, kind in docs.dtypes if not kind.startswith("map")]))
    one = kept.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(row)).select(f"{row}.*")
    return kept.join(repeated, id_col, "left_anti").select(docs.columns).unionByName(one)

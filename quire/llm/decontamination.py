"""Benchmark decontamination with spaced seeds (operator 7).

Fixed masks over SPAN consecutive words choose the positions that are hashed; the others may be
substituted.  The hashes of all benchmark windows under all masks are joined with those of all training
windows.  A hit fixes a diagonal (training position minus benchmark position); along it the words are
compared one by one, and the best run that tolerates substitutions is the overlap.

The masks lose nothing: whichever words are substituted, at most MAX_SUBSTITUTED of them, an overlap of
LONG words or more holds a window that one of MASKS hashes alike, and one of MIN_ITEM + 1 words or more a
window for one of LIGHT_MASKS, which more texts share by chance.  Items of at most MIN_ITEM words are
looked for as they are, without substitutions, if they have the ``min_item`` words that the caller asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import words as W

MASKS = ("110111", "1101000011", "11100011", "1011011", "11111")
LIGHT_MASKS = ("1111", "11011", "1100011")
LONG = 10  # words; least overlap for which MASKS are enough
MIN_OVERLAP = 13  # words; an item that is shorter must be there whole
MIN_ITEM = 5  # words; items up to this size must be there unchanged, and shorter ones are left out unless asked for
MAX_SUBSTITUTED = 0.25  # of the words of an overlap
BROADCAST_BYTES = 64 << 20
SIEVE_BITS = 28  # of the bitmap of benchmark seeds that is sent to all tasks when the seeds themselves are too many: 32 MB
_P = 0xA0761D6478BD642F


def _positions(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(hashes: np.ndarray, doc_end: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of each window of one text under a mask."""
    at = np.flatnonzero(np.arange(len(hashes)) + len(mask) <= doc_end)
    total, power = np.full(len(at), salt + 1, np.uint64), np.uint64(_P)
    for i in _positions(mask):
        total = total * power + hashes[at + i]
    return at, W.mix(total)


def _masks(masks: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Every mask with the least and greatest overlap it is for."""
    every = [(m, LONG, np.iinfo(np.int64).max) for m in masks] + [(m, MIN_ITEM + 1, LONG - 1) for m in LIGHT_MASKS]
    return every + [("1" * n, n, n) for n in range(1, MIN_ITEM + 1)]


def _least(size: np.ndarray, min_overlap: int, min_item: int) -> np.ndarray:
    """The least overlap with items of these sizes, as it chooses the masks: 0 for items that are left out."""
    asked = np.where(size > MIN_ITEM, np.maximum(np.minimum(size, min_overlap), MIN_ITEM + 1), size)
    return np.where(size >= max(1, min_item), asked, 0)


def best_run(same: np.ndarray, max_substituted: float, least: int) -> tuple[int, int, int] | None:
    """(start, end, matches) of the longest run of at least ``least`` places that starts and ends on a match and has at most that share of mismatches; the first of equals."""
    hit = np.flatnonzero(same)
    if len(hit) < (1 - max_substituted) * least:
        return None
    # a run from hit a to hit b is good if matches >= (1 - s) * length: compare b - a + 1 with hits
    score = np.arange(len(hit)) - (1 - max_substituted) * hit  # grows by one a match, falls with the length
    best = None
    low = np.minimum.accumulate(score)
    for b in range(len(hit) - 1, -1, -1):
        # the earliest a with score[b] + 1 - score[a] >= 1 - s
        bound = score[b] + max_substituted + 1e-9
        a = int(np.searchsorted(-low, -bound, "left"))
        if a <= b:
            length = int(hit[b] - hit[a] + 1)
            if length >= least and (best is None or length >= best[1] - best[0]):
                best = (int(hit[a]), int(hit[b]) + 1, b - a + 1)
        if best is not None and hit[b] + 1 - hit[0] < best[1] - best[0]:
            break
    return best


def overlap(train: np.ndarray, item: np.ndarray, diagonal: int, max_substituted: float, min_overlap: int) -> tuple[int, int, int] | None:
    """(first training word, end, matches) of the overlap on a diagonal."""
    lo, hi = max(0, -diagonal), min(len(item), len(train) - diagonal)
    if hi <= lo:
        return None
    found = best_run(train[lo + diagonal : hi + diagonal] == item[lo:hi], max_substituted, min(min_overlap, len(item)))
    return None if found is None else (found[0] + lo + diagonal, found[1] + lo + diagonal, found[2])


class Index:
    """The seeds of benchmark items, sorted by hash, with a bitmap that most training windows fail."""

    def __init__(self, items: list[int], tokens: list[np.ndarray], masks: tuple[str, ...], min_overlap: int = MIN_OVERLAP, min_item: int = MIN_ITEM):
        keep = [i for i, t in enumerate(tokens) if len(t) >= max(1, min_item)]
        self.items, self.tokens = [items[i] for i in keep], [tokens[i] for i in keep]
        flat = np.concatenate([np.zeros(0, np.uint64), *self.tokens])
        size = np.array([len(t) for t in self.tokens], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        item_of = np.repeat(np.arange(len(size)), size)
        least = _least(size, min_overlap, min_item)
        self.masks = [(salt, m) for salt, (m, low, high) in enumerate(_masks(masks)) if ((low <= least) & (least <= high)).any()]
        rows = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for salt, mask in self.masks:
            _, low, high = _masks(masks)[salt]
            at, value = seeds(flat, np.repeat(first[1:], size), mask, salt)
            good = (low <= least[item_of[at]]) & (least[item_of[at]] <= high)
            at, value = at[good], value[good]
            rows.append((value, item_of[at], at - first[item_of[at]]))
        self.hashes, self.item, self.offset = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.item, self.offset = self.hashes[order], self.item[order], self.offset[order]
        bits = max(16, int(8 * len(self.hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(self.hashes >> self.shift).astype(np.int64)] = True

    def hits(self, found: W.Words) -> np.ndarray:
        """Distinct (text, item, diagonal) rows of a chunk of texts."""
        parts = [np.zeros((0, 3), np.int64)]
        ends = found.doc_end
        for salt, mask in self.masks:
            at, value = seeds(found.hashes, ends, mask, salt)
            some = self.bitmap[(value >> self.shift).astype(np.int64)]
            at, value = at[some], value[some]
            left, right = np.searchsorted(self.hashes, value, "left"), np.searchsorted(self.hashes, value, "right")
            n = right - left
            which = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, np.int64)
            at = np.repeat(at, n)
            text = np.searchsorted(found.first, at, "right") - 1
            parts.append(np.stack([text, self.item[which], at - found.first[text] - self.offset[which]], axis=1))
        return np.unique(np.concatenate(parts), axis=0)


def _best(found: W.Words, hits: np.ndarray, tokens, max_substituted: float, min_overlap: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """The longest overlap of each (text, item); the earliest of equals."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, item, diagonal in hits.tolist():
        run = overlap(found.hashes[found.first[text] : found.first[text + 1]], tokens[item], diagonal, max_substituted, min_overlap)
        if run is not None:
            have = best.get((text, item))
            if have is None or (have[0] - have[1], have[0]) > (run[0] - run[1], run[0]):
                best[text, item] = run
    return best


_FIELDS = ["doc_id", "item_id", "start_word", "end_word", "matched"]
_SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, matched bigint"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], _FIELDS)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_overlap: int = MIN_OVERLAP,
    max_substituted: float = MAX_SUBSTITUTED,
    broadcast_bytes: int = BROADCAST_BYTES,
    min_item: int = MIN_ITEM,
) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, matched): the longest overlap of each document with each benchmark item.

    An overlap has at least min_overlap words (or the whole of a shorter item) and at most max_substituted of
    them differ; an item of MIN_ITEM words or fewer must be there unchanged.  No overlap is missed while max_substituted
    is at most MAX_SUBSTITUTED; beyond that the masks lose some.  A document is one row; rows that repeat an id give their rows again, and those with a null id
    or no words none.  Items with a null id or text, or of fewer than min_item words (by default five, as shorter ones are common
    phrases; 1 takes all that have a word), are left out; repeated items count once.  An empty table on either side gives an empty result.  Other columns are ignored.

    The seeds are sent to every task while they need at most broadcast_bytes (measured on the benchmark
    first); beyond that, training and benchmark seeds meet in a shuffle join, for which a bitmap of fixed size
    sieves the training seeds.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("item")).where(F.col("item_id").isNotNull() & F.col("item").isNotNull()).distinct()
    # each word of an item gives at most one seed a mask, of about 32 bytes
    need = items.agg(F.sum(F.regexp_count("item", F.lit(r"\S+")) * (32 * (max(len(masks), len(LIGHT_MASKS)) + 1)))).first()[0] or 0
    if need <= broadcast_bytes:
        return _by_broadcast(given, items, masks, min_overlap, max_substituted, min_item)
    return _by_join(given, items, masks, min_overlap, max_substituted, min_item)


def _by_broadcast(given: DataFrame, items: DataFrame, masks, min_overlap: int, max_substituted: float, min_item: int) -> DataFrame:
    rows = items.orderBy("item_id", "item").toArrow()
    found = W.scan(rows["item"])
    tokens = [found.hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:])]
    index = given.sparkSession.sparkContext.broadcast(Index(rows["item_id"].to_pylist(), tokens, masks, min_overlap, min_item))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in W.slices(batches):
            found = W.scan(batch.column(1))
            best = _best(found, known.hits(found), known.tokens, max_substituted, min_overlap)
            if best:
                ids = batch.column(0).to_pylist()
                yield _batch([(ids[text], known.items[item], *run) for (text, item), run in sorted(best.items())])

    return given.mapInArrow(search, _SCHEMA)


def _by_join(given: DataFrame, items: DataFrame, masks, min_overlap: int, max_substituted: float, min_item: int) -> DataFrame:
    def seed(whole: bool, sieve=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.slices(batches, max_bytes=W.CHUNK_BYTES // 4):
                found = W.scan(batch.column(1))
                least = _least(np.diff(found.first), min_overlap, min_item)
                for salt, (mask, low, high) in enumerate(_masks(masks)):
                    at, value = seeds(found.hashes, found.doc_end, mask, salt)
                    text = np.searchsorted(found.first, at, "right") - 1
                    if whole:
                        good = (low <= least[text]) & (least[text] <= high)
                    else:
                        bit = value >> np.uint64(64 - SIEVE_BITS)
                        good = (sieve.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at, value, text = at[good], value[good], text[good]
                    ids = batch.column(0).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), ids, pa.array(at - found.first[text])], ["seed", "id", "at"])

        return run

    theirs = items.mapInArrow(seed(True), "seed bigint, item_id bigint, offset bigint")
    sieve = given.sparkSession.sparkContext.broadcast(_sieve(theirs.select("seed")))
    ours = given.mapInArrow(seed(False, sieve), "seed bigint, doc_id bigint, at bigint")
    hits = ours.join(theirs, "seed").select("doc_id", "item_id", (F.col("at") - F.col("offset")).alias("diagonal")).distinct()
    hits = hits.groupBy("doc_id", "item_id").agg(F.collect_list("diagonal").alias("diagonals"))
    pairs = hits.join(given, "doc_id").join(items, "item_id").select("doc_id", "text", "item_id", "item", "diagonals")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found, asked = W.scan(batch.column(1)), W.scan(batch.column(3))
            tokens = [asked.hashes[a:b] for a, b in zip(asked.first[:-1], asked.first[1:])]
            rows = np.array([(i, i, d) for i, ds in enumerate(batch.column(4).to_pylist()) for d in sorted(ds)], np.int64).reshape(-1, 3)
            best = _best(found, rows, tokens, max_substituted, min_overlap)
            if best:
                ids, names = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                yield _batch([(ids[i], names[i], *run) for (i, _), run in sorted(best.items())])

    return pairs.mapInArrow(verify, _SCHEMA)


def _sieve(seeds: DataFrame) -> np.ndarray:
    """The bitmap of the first SIEVE_BITS bits of all seeds.  Pages of 8 KB are made by tasks, the driver puts them together."""

    def page(batch: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[batch["bit"].to_numpy()] = 1
        return pa.table({"page": batch["page"].slice(0, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    bit = F.shiftrightunsigned("seed", 64 - SIEVE_BITS)
    marked = seeds.select(F.shiftright(bit, 16).cast("int").alias("page"), bit.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bit")).distinct()
    result = np.zeros(1 << SIEVE_BITS - 3, np.uint8)
    for row in marked.groupBy("page").applyInArrow(page, "page int, bits binary").toArrow().to_pylist():
        result[row["page"] << 13 : (row["page"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that overlap with no benchmark item; same columns.  Null ids and texts without words stay."""
    leaked = contaminated(docs, benchmark, id_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(leaked, id_col, "left_anti").select(docs.columns)

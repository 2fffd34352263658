"""Exact substring deduplication by super-k-mers (operator 9).

A *window* is a run of K words of a text.  Its minimiser is the least hash among its runs of M words;
consecutive windows that share a minimiser form a super-k-mer, which travels as one packed string of
words to the bucket of its minimiser.  Equal windows have equal minimisers, so they meet in one bucket,
where sorting finds and counts them.

Only super-k-mers whose minimiser occurs more than once can hold a repeated window.  So the minimisers
are counted first (a few numbers a super-k-mer), and only super-k-mers with a repeated minimiser are packed.
That drops nothing: the other windows occur once.

A task reads its buckets one after another, sorted by minimiser, so that it holds one bucket at a time.  A bucket of
more than HOT super-k-mers, such as that of a passage in a third of all documents, isn't held at all: its windows become
rows, whose least document and position is found by aggregation, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm import shared, words as W

K = 50
M = 8
HOT = 20_000  # super-k-mers of a bucket that a task sorts; they hold at most K - M + 1 windows each


def super_kmers(hashes: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(start, windows, minimiser, loop) of each super-k-mer of a chunk of texts; start counts words of the chunk.

    loop: its minimiser is there more than once, so that windows may repeat inside it.
    """
    n = len(hashes)
    doc_end = np.repeat(first[1:], np.diff(first))
    found = W.Words(np.zeros(0, np.uint8), np.zeros(1), np.zeros(0), np.zeros(0), hashes, first)
    at, value = W.windows(found, m)
    runs = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    runs[at] = value
    low, size, width = runs, 1, k - m + 1
    while size * 2 <= width:
        pair = low.copy()
        pair[:-size] = np.minimum(low[:-size], low[size:]) if size < n else low[:-size]
        low, size = pair, size * 2
    if size < width < n + size:
        rest, pair = width - size, low.copy()
        pair[:-rest] = np.minimum(low[:-rest], low[rest:])
        low = pair
    window = np.flatnonzero(np.arange(n) + k <= doc_end)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    least = low[window]
    new = np.concatenate([[True], (np.diff(window) != 1) | (least[1:] != least[:-1]) | (doc_end[window[1:]] != doc_end[window[:-1]])])
    opens = np.flatnonzero(new)
    length = np.diff(np.append(opens, len(window)))
    start, minimiser = window[opens], least[opens]
    span = length + width - 1  # runs of M words in it
    edge = np.concatenate([[0], np.cumsum(span)])
    inside = np.arange(edge[-1]) - np.repeat(edge[:-1] - start, span)
    same = np.concatenate([[0], np.cumsum(runs[inside] == np.repeat(minimiser, span))])
    return start, length, minimiser, same[edge[1:]] - same[edge[:-1]] > 1


def packed_words(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The folded words of a chunk with a space after each, and the offset of each word in it."""
    folded = found.folded
    size = found.ends - found.starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(found.starts - to[:-1], size) + np.arange(to[-1])
    last = to[1:] - 1
    source[last] = 0
    result = folded[source] if len(folded) else np.zeros(0, np.uint8)
    result[last] = 32
    return result, to


def _windows_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, second hash, minimiser, document, position) of the windows in packed super-k-mers."""
    for batch in W.slices(batches, 3):
        found = W.scan(batch.column(3).cast(pa.string()))
        at, value = W.windows(found, k)
        again = W.hashed(found.data, found.starts[at], found.ends[at + k - 1]) if len(at) else value
        row = found.doc[at]
        document, start = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
        yield value, again, batch.column(0).to_numpy()[row], document[row], start[row] + at - found.first[row]


def repeated_windows(packed: pa.Array, document: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(document, position, first document) of the windows of whole buckets that equal one before them in the order of document and position.

    Windows are sorted by a hash, document and position; then their words are compared.
    """
    found = W.scan(packed.cast(pa.string()))
    at, value = W.windows(found, k)
    row = found.doc[at]
    document, position = document[row], start[row].astype(np.int64) + at - found.first[row]
    lo, size = found.starts[at], found.ends[at + k - 1] - found.starts[at] if len(at) else at
    order = np.lexsort((position, document, value))
    document, position, lo, size, value = document[order], position[order], lo[order], size[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
    later = (document != document[head]) | (position != position[head])
    same = (size == size[head]) & W.same_bytes(found.data, lo, lo[head], np.minimum(size, size[head]))
    other = np.flatnonzero(~same)
    if len(other):  # hashes collide: these windows are sorted out by their words
        data, first = found.data.tobytes(), {}
        for i in other.tolist():
            h = first.setdefault(data[lo[i] : lo[i] + size[i]], i)
            head[i], later[i] = h, (document[i], position[i]) != (document[h], position[h])
    return document[later], position[later], document[head][later]


def _spans(document: np.ndarray, position: np.ndarray, origin: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows as (document, first word, end, least first document)."""
    order = np.lexsort((position, document))
    document, position, origin = document[order], position[order], origin[order]
    new = np.ones(len(document), bool)
    new[1:] = (document[1:] != document[:-1]) | (position[1:] > position[:-1] + 1)
    opens = np.flatnonzero(new)
    if not len(opens):
        return document, position, position, origin
    closes = np.append(opens[1:], len(document)) - 1
    return document[opens], position[opens], position[closes] + k, np.minimum.reduceat(origin, opens)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): the spans of each document whose windows of k words all occurred before.

    The first occurrence of a window is that with the least (doc_id, position); all others lie in a span.
    Spans of a document neither overlap nor touch; first_doc_id is the least document that has the first
    occurrence of one of the span's windows (the document itself for repeats inside it).  Words are counted
    from 0 (see ``words``).  Texts of fewer than k words, empty and null ones and rows with a null id have no
    spans.  Ids are integers; rows that repeat an id count as one document.  Other columns are ignored, whatever their names.

    Windows are compared by their words, in buckets of more than ``hot`` super-k-mers by two hashes of 64 bits and the
    minimiser.
    """

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found = W.scan(batch.column(1))
            start, length, least, loop = super_kmers(found.hashes, found.first, k, m)
            doc = np.searchsorted(found.first, start, "right") - 1
            ids = batch.column(0).to_numpy()[doc] if len(start) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), pa.array(ids), pa.array((start - found.first[doc]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(loop)],
                ["minimiser", "doc_id", "start", "n", "loop"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found = W.scan(batch.column(1))
            packed, at = packed_words(found)
            data = packed.tobytes()
            lists = batch.column(2)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            runs = lists.flatten()
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            least, start, n = (runs.field(i).to_numpy() for i in range(3))
            hot = runs.field(3).to_numpy(zero_copy_only=False)
            lo = found.first[row] + start
            hi = np.minimum(lo + n + k - 1, found.first[row + 1])
            good = hi > lo
            least, start, row, lo, hi, hot = least[good], start[good], row[good], lo[good], hi[good], hot[good]
            pieces = [data[a : b - 1] for a, b in zip(at[lo].tolist(), at[hi].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(least), batch.column(0).take(pa.array(row)), pa.array(start), pa.array(pieces, pa.binary()), pa.array(hot)], ["minimiser", "doc_id", "start", "packed", "hot"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None

        def buckets() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            document, start, packed = (whole.column(i).chunk(0) for i in (1, 2, 3))
            return _rows_of(_spans(*repeated_windows(packed, document.to_numpy(), start.to_numpy(), k), k))

        for batch in batches:
            if not len(batch):
                continue
            least = batch.column(0).to_numpy()
            edges = np.flatnonzero(least[1:] != least[:-1]) + 1
            cut = int(edges[-1]) if len(edges) else 0 if last not in (None, least[0]) else None
            if cut is not None and n + cut >= HOT:  # whole buckets only, and no more of them than a large one holds
                held.append(batch.slice(0, cut))
                yield buckets()
                held, n = [batch.slice(cut)], len(batch) - cut
            else:
                held, n = [*held, batch], n + len(batch)
            last = least[-1]
        if held:
            yield buckets()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _windows_of(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["value", "again", "minimiser", "doc_id", "at"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows_of(_spans(*(batch.column(i).to_numpy() for i in range(3)), k))

    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counted = shared.written(given.mapInArrow(minimisers, "minimiser bigint, doc_id bigint, start int, n int, loop boolean"), "minimisers")
    times = counted.groupBy("minimiser").agg(F.count("*").alias("times"), F.max("loop").alias("loop")).where("times > 1 OR loop").select("minimiser", (F.col("times") > hot).alias("hot"))
    times = shared.written(times, "times")
    wanted = counted.drop("loop").join(times, "minimiser").groupBy("doc_id").agg(F.collect_list(F.struct("minimiser", "start", "n", "hot")).alias("runs"))
    schema = "doc_id bigint, start_word bigint, end_word bigint, first_doc_id bigint"
    packed = given.join(wanted, "doc_id").select("doc_id", "text", "runs").mapInArrow(pack, "minimiser bigint, doc_id bigint, start int, packed binary, hot boolean")
    if times.where("hot").isEmpty():
        spans, made = packed.drop("hot").repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(sort, schema), [counted, times]
    else:
        packed = shared.written(packed, "packed")
        made = [counted, times, packed]
        spans = packed.where("NOT hot").drop("hot").repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(sort, schema)
        rows = packed.where("hot").drop("hot").mapInArrow(windows, "value bigint, again bigint, minimiser bigint, doc_id bigint, at bigint")
        of = ["value", "again", "minimiser"]
        first = rows.groupBy(*of).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = rows.join(first, of).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
        spans = spans.unionByName(later.select("doc_id", "at", F.col("first.doc_id").alias("origin")).mapInArrow(joined, schema))
    found = shared.written(merged(spans), "spans")
    shared.drop(*made)
    return found


def _rows_of(spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.int64)) for x in spans], ["doc_id", "start_word", "end_word", "first_doc_id"])


def merged(spans: DataFrame) -> DataFrame:
    """Spans that overlap or touch, united."""
    before = Window.partitionBy("doc_id").orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("start_word") > F.max("end_word").over(before)).cast("int"), F.lit(1))
    numbered = spans.withColumn("opens", opens).withColumn("span", F.sum("opens").over(upto))
    return numbered.groupBy("doc_id", "span").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc_id").alias("first_doc_id")).drop("span")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", k: int = K, m: int = M) -> DataFrame:
    """docs with the spans of repeated_spans cut out of their texts; same columns.

    ``size_col``, where there is such a column, is set to the new length of a cut text.  A document that is
    cut and has no word left goes; documents that aren't cut stay as they are, empty ones and null ids included.
    """
    spans = repeated_spans(docs, id_col, text_col, k, m)
    own, cuts = shared.fresh(docs.columns, "__id"), shared.fresh(docs.columns, "__spans")
    lists = spans.groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts))
    size = docs.columns.index(size_col) if size_col in docs.columns else None
    at, columns = docs.columns.index(text_col), docs.columns
    joined = docs.join(lists, docs[id_col].cast("bigint") == lists[own], "left").select(*columns, cuts)
    kind = docs.schema[columns[size]].dataType.simpleString() if size is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, at):
            spans = batch.column(len(columns)).to_pylist()
            if not any(spans):
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], columns)
                continue
            found = W.scan(batch.column(at))
            data, texts, keep = found.data.tobytes(), batch.column(at).to_pylist(), np.ones(len(batch), bool)
            sizes = batch.column(size).to_pylist() if size is not None else None
            for i, cuts in enumerate(spans):
                if not cuts or texts[i] is None:
                    continue
                lo, hi = int(found.first[i]), int(found.first[i + 1])
                pieces, since, words = [], int(found.offsets[i]), hi - lo
                for span in cuts:
                    a, b = lo + span["start_word"], min(lo + span["end_word"], hi)
                    if a < b:
                        pieces.append(data[since : int(found.starts[a])])
                        since, words = int(found.ends[b - 1]), words - (b - a)
                pieces.append(data[since : int(found.offsets[i + 1])])
                texts[i], keep[i] = b"".join(pieces).decode(), words > 0
                if sizes is not None:
                    sizes[i] = len(texts[i])
            out = list(batch.columns[:-1])
            out[at] = pa.array(texts, out[at].type)
            if sizes is not None:
                out[size] = pa.array(sizes, out[size].type)
            yield pa.RecordBatch.from_arrays(out, columns).filter(pa.array(keep))

    assert kind is None or kind in ("bigint", "int"), f"{size_col} is {kind}"
    return joined.mapInArrow(cut, docs.schema)

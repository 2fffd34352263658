"""Quality rules: repetition measured with a suffix array (operator 6).

The words of a text are its alphabet.  A suffix array of every text, made by prefix
doubling for a whole chunk of texts at once, gives the longest common prefix of
neighbouring suffixes; each LCP interval of at least ``min_repeat`` words is a maximal
repeated substring.  The leftmost occurrence in an interval is the original, the spans of
the others are united, which gives the covered share of the text; the longest common prefix
of all is its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import words as W

MIN_REPEAT = 5
MAX_COVERED = 0.5
MAX_LONGEST = 100


def repeats(tokens: np.ndarray, first: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest repeat, covered words) of each text; text i has tokens[first[i]:first[i + 1]]."""
    texts, n = len(first) - 1, len(tokens)
    longest, covered = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if n < 2:
        return longest, covered
    doc = np.repeat(np.arange(texts), np.diff(first))
    doc_end = np.repeat(first[1:], np.diff(first))
    kinds, ids = np.unique(tokens, return_inverse=True)
    key = doc * len(kinds) + ids
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    alone = new & np.concatenate([new[1:], [True]])
    active, k, levels = order[~alone], 1, [(1, rank.copy())]
    while len(active):
        after = active + k
        inside = after < doc_end[active]
        key = rank[active] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        by = np.argsort(key)
        active, key = active[by], key[by]
        old, index = rank[active], np.arange(len(active))
        new = np.concatenate([[True], np.diff(key) != 0])
        old_first = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(old) != 0]), index, 0))
        new_first = np.maximum.accumulate(np.where(new, index, 0))
        rank[active] = old + new_first - old_first
        k *= 2
        levels.append((k, rank.copy()))
        active = active[~(new & np.concatenate([new[1:], [True]]))]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    x, y = suffixes[:-1], suffixes[1:]
    least = max((level for level in levels if level[0] <= min_repeat), key=lambda level: level[0])[1]
    near = least[x] == least[y]
    x, y = x[near], y[near]
    lcp = np.zeros(len(x), np.int64)
    for k, at in reversed(levels):
        inside = (x + lcp < doc_end[x]) & (y + lcp < doc_end[y])
        lcp += np.where(inside & (at[np.where(inside, x + lcp, 0)] == at[np.where(inside, y + lcp, 0)]), k, 0)
    long = lcp >= min_repeat
    if not long.any():
        return longest, covered
    np.maximum.at(longest, doc[x[long]], lcp[long])
    joined = np.zeros(n + 1, bool)  # joined[j]: suffixes j - 1 and j are in one interval
    joined[1 + np.flatnonzero(near)[long]] = True
    member = joined[:-1] | joined[1:]
    members = suffixes[member]
    opens = np.flatnonzero(~joined[:-1][member])
    original = np.repeat(np.minimum.reduceat(members, opens), np.diff(np.append(opens, len(members))))
    copies = members[members != original]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, copies, 1)
    np.add.at(edges, copies + min_repeat, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return longest, total[first[1:]] - total[first[:-1]]


def repetition_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """One row for each row of docs: the id, n_words, longest_repeat (words), repeated_fraction.

    Repeats shorter than ``min_repeat`` words don't count.  A null or empty text, or one without a
    word, has 0 words, no repeat and fraction 0.  Null ids and repeated rows are scored like any other;
    other columns are ignored, whatever their names.  An empty table gives an empty one.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found = W.scan(batch.column(1))
            longest, covered = repeats(found.hashes, found.first, min_repeat)
            n = np.diff(found.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(longest), pa.array(covered / np.maximum(n, 1))], names
            )

    names = [id_col, "n_words", "longest_repeat", "repeated_fraction"]
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(score, f"`{id_col}` {kind}, n_words bigint, longest_repeat bigint, repeated_fraction double")


def quality_filter(
    docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """The rows of docs whose repeats cover at most ``max_covered`` of the words and are at most ``max_longest`` words long.

    All columns are kept as they are.  Texts without words (null, empty) have no repeat and stay;
    repeated rows all stay or all go.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, at):
            found = W.scan(batch.column(at))
            longest, covered = repeats(found.hashes, found.first, min_repeat)
            good = (covered <= max_covered * np.diff(found.first)) & (longest <= max_longest)
            yield batch.filter(pa.array(good))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(keep, docs.schema)

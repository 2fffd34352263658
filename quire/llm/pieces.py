"""Token counts by a linear longest-match automaton (operator 5).

The vocabulary is a trie.  Where no child fits the next character, a failure link leads to the node of what is left
after popping the longest pieces that are complete; how many pieces that pops is computed beforehand.  So the number of
greedy longest-match pieces of a word takes one pass over its characters, with no pieces built and nothing read twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import shared, words as W

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # begins the first piece of a word
_MEMO = 1 << 19  # words
_MEMO_BYTES = 64  # longer words aren't kept


class Automaton:
    """Counts greedy longest-match pieces.  A character that begins no piece counts as its UTF-8 bytes (byte fallback)."""

    def __init__(self, vocabulary: list[str]):
        self.next: list[dict[str, int]] = [{}]
        piece, parent, char = [False], [0], [""]
        for word in sorted(set(vocabulary) - {""}):
            at = 0
            for c in word:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                    parent.append(at)
                    char.append(c)
                at = to
            piece[at] = True
        # fail[v]: the node of what is left of v's characters after popping pops[v] pieces, as no longer piece fits from v
        n = len(self.next)
        self.fail, self.pops = [0] * n, [0] * n
        level = list(self.next[0].values())
        while level:
            following = []
            for v in level:
                following += self.next[v].values()
                if piece[v]:
                    self.pops[v] = 1
                elif parent[v] == 0:
                    self.pops[v] = _bytes(char[v])
                else:
                    self.fail[v], popped = self._step(self.fail[parent[v]], char[v])
                    self.pops[v] = self.pops[parent[v]] + popped
            level = following

    def _step(self, at: int, c: str) -> tuple[int, int]:
        """The node after reading c at a node, and the pieces popped for it."""
        popped = 0
        while c not in self.next[at]:
            if at == 0:
                return 0, popped + _bytes(c)
            popped += self.pops[at]
            at = self.fail[at]
        return self.next[at][c], popped

    def count(self, word: str) -> int:
        follow, fail, pops = self.next, self.fail, self.pops
        at = total = 0
        for c in word:
            while c not in follow[at]:
                if at == 0:
                    total += _bytes(c)
                    break
                total += pops[at]
                at = fail[at]
            else:
                at = follow[at][c]
        while at:
            total += pops[at]
            at = fail[at]
        return total


def _bytes(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


def load_vocabulary(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a sentencepiece model (read on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, index of each text's first word) of the words between ASCII white space."""
    data, offsets = W.raw(texts)
    n = len(data)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    edge = np.concatenate([[True], ~word]), np.concatenate([~word, [True]])
    starts = np.flatnonzero(word & (edge[0][:-1] | cut[:-1]))
    ends = np.flatnonzero(word & (edge[1][1:] | cut[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


class Counter:
    """Counts the pieces of whole texts; words met before are looked up, by their bytes."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        data, starts, ends, first = _split(texts)
        example, kind = W.kinds_of(data, starts, ends)
        known, count, buffer = self.known, self.automaton.count, data.tobytes()
        if len(known) > _MEMO:
            known.clear()
        words = [buffer[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist())]
        size = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(size < 0).tolist():
            word = words[i]
            size[i] = n = count(MARK + word.decode("utf-8", "replace"))
            if len(word) <= _MEMO_BYTES:
                known[word] = n
        total = np.concatenate([[0], np.cumsum(size[kind])])
        return total[first[1:]] - total[first[:-1]]


def with_token_counts(docs: DataFrame, text_col: str = "text", count_col: str = "n_tokens", keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of docs (by default all but the text) and the number of greedy pieces of the text.

    Words are separated by ASCII white space, each is matched with MARK before it.  A null, empty or blank
    text has 0 pieces.  Rows are handled one by one: null ids, repeated rows and further columns don't
    matter; a column called like count_col is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ((text_col, count_col) if keep is None else (count_col,))]
    own = shared.fresh(keep, "__text")
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(own))
    at = len(keep)
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(load_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(automaton.value)
        for batch in W.slices(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count(batch.column(at)))], [*keep, count_col])

    return given.mapInArrow(run, given.drop(own).withColumn(count_col, F.lit(0).cast("bigint")).schema)

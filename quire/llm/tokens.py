"""Token-ID output as Parquet list columns, and selective reads of it (operator 1).

Texts become byte-level BPE token ids.  The splitting pattern is evaluated with numpy over the code points of a chunk of texts;
BPE itself runs once for each distinct piece, later ones are looked up.  Ids are written by Spark's Parquet writer as array<int>
with the encoding, row-group size and page size that are asked for, sorted by id within a file, so that column and page
indexes let a reader skip the token pages of documents it doesn't want and leave out the tokens altogether.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.llm import shared, words as W

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that _pieces evaluates; a tokenizer made with it must give the same ids.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MEMO = 1 << 19  # pieces
_MEMO_BYTES = 64  # longer pieces aren't kept
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(pattern, text):
            table[found.start() : found.end()] = kind
    return table


class Tokenizer:
    """encode(texts) gives all ids end to end and the offset of each text's first id."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.bpe = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # the place of each piece met in first and size, by its bytes
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _pieces(self, points: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Where pieces begin; cut marks the code points that begin a text."""
        n = len(points)
        kind = self.classes[points]
        begin = cut.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # white space before something else: its last character is cut off, and joins what follows if it is ' '
        text_end = np.ones(n, bool)
        text_end[:-1] = cut[1:]
        space = kind == _SPACE
        last = space & ~text_end
        last[:-1] &= ~space[1:]
        begin |= last
        joins = last & (points == 32)
        begin[1:] &= ~joins[:-1] | cut[1:]
        # contractions: a run of signs that is nothing but an apostrophe, or begins with one, and has no space before
        apostrophe = np.flatnonzero((points == 39) & begin)
        for suffix in ("s", "d", "m", "t", "ll", "ve", "re"):
            k = len(suffix)
            at = apostrophe[apostrophe + k < n]
            for i, c in enumerate(suffix):
                at = at[(points[at + 1 + i] == ord(c)) & ~cut[at + 1 + i]]
            begin[at + 1] = False
            after = at + 1 + k
            begin[after[after < n]] = True
        return np.flatnonzero(begin)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = W.raw(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        try:
            text = data.tobytes().decode("utf-8")
        except UnicodeDecodeError:  # bytes that are no UTF-8 become U+FFFD, text by text
            whole = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            return self.encode(pa.array(whole, pa.large_string()))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each code point
        text_at = np.searchsorted(byte_at, offsets)
        n = len(points)
        cut = np.zeros(n + 1, bool)
        cut[text_at] = True
        starts = self._pieces(points, cut[:n])
        a, b = byte_at[starts], byte_at[np.append(starts[1:], n)]
        example, kind = W.kinds_of(data, a, b)
        slot = self._slots(data.tobytes(), a[example].tolist(), b[example].tolist())[kind]
        first, size = self.first[slot], self.size[slot]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - to[:-1], size) + np.arange(to[-1])]
        return ids, to[np.searchsorted(starts, text_at)]

    def _slots(self, data: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
        """The place of each piece data[start:end] in first and size."""
        if len(self.size) > _MEMO:
            self._forget()
        pieces = [data[a:b] for a, b in zip(starts, ends)]
        slots = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(slots < 0)
        if len(new):
            core, ranks, lists = self.bpe._core_bpe, self.bpe._mergeable_ranks, []
            for i, at in enumerate(new.tolist(), len(self.size)):
                piece = pieces[at]
                rank = ranks.get(piece)
                lists.append([rank] if rank is not None else core.encode_single_piece(piece))
                if len(piece) <= _MEMO_BYTES:
                    self.known[piece] = i
            size = np.array(list(map(len, lists)), np.int64)
            slots[new] = len(self.size) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))])
        return slots


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def token_ids(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, ranks: str = RANKS) -> DataFrame:
    """The columns ``keep`` of docs (by default all but the text), n_tokens and token_ids (array<int>).

    A null or empty text has no tokens (an empty list).  Rows are handled one by one: null ids, repeated rows and
    further columns don't matter; columns called n_tokens or token_ids are replaced.
    """
    ours = ("n_tokens", "token_ids")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ours and (keep is not None or c != text_col)]
    own = shared.fresh(keep, "__text")
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(own))
    table = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(table.value)
        for batch in W.slices(batches, at):
            ids, first = tokenizer.encode(batch.column(at))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(first)), lists], [*keep, *ours])

    schema = given.drop(own).withColumn("n_tokens", F.lit(0).cast("bigint")).withColumn("token_ids", F.array(F.lit(0))).schema
    return given.mapInArrow(run, schema)


def write_tokens(tokens: DataFrame, path: str, sort_col: str = "doc_id", encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 256) -> None:
    """Write a table made by token_ids.

    encoding: 'dictionary' (ids as dictionary indexes, bit-packed) or 'delta' (DELTA_BINARY_PACKED, no dictionary).
    Rows are sorted by sort_col within each file; nulls come first.  Small pages and the page index of every column
    let readers skip within row groups.  An empty table gives files without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    options = {
        "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "compression": "zstd",
    }
    tokens.sortWithinPartitions(sort_col).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Selective read: only the pages of the columns asked for, of rows for which ``where`` can hold."""
    rows = spark.read.parquet(path)
    if where is not None:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", **options) -> DataFrame:
    """token_ids of all rows written to the shared folder by write_tokens, and read again."""
    path = shared.new_path(docs.sparkSession, "tokens")
    write_tokens(token_ids(docs, text_col, [id_col]), path, id_col, encoding, **options)
    return read_tokens(docs.sparkSession, path)

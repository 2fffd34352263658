"""Word scanning and rolling hashes over Arrow string columns, vectorised with numpy.

A *word* is a maximal run of letters, marks and digits; everything else separates.  In scripts that don't set words apart (Chinese
characters, kana, Thai, Lao, Burmese, Khmer) each character is a word.  Case is folded before hashing where the small letter is written with
as many bytes.  Offsets are byte offsets into the UTF-8 text.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _FOLD[_b] = _b + 32 if 65 <= _b <= 90 else _b

#: Scripts that don't set words apart.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_OTHER, _WORD, _ALONE = 0, 1, 2


def _class_of(point: int) -> int:
    if unicodedata.category(chr(point))[0] not in "LMN":
        return _OTHER
    return _ALONE if any(a <= point <= b for a, b in _UNSPACED) else _WORD


def _lower_of(point: int) -> int:
    """The small letter, if it is one character that takes as many bytes in UTF-8."""
    small = chr(point).lower()
    size = lambda p: 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
    return ord(small) if len(small) == 1 and size(ord(small)) == size(point) else point


_CLASS = np.array([_OTHER if 0xD800 <= p < 0xE000 else _class_of(p) for p in range(0x10000)], np.uint8)
_LOWER = np.array([p if 0xD800 <= p < 0xE000 else _lower_of(p) for p in range(0x10000)], np.uint32)


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(data in small letters with zeros for what separates, places before and after characters that are words by themselves)."""
    out = _FOLD[data]
    cuts = [np.zeros(0, np.int64)]
    for size, least, most in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((data >= least) & (data < most))
        at = at[at + size <= len(data)]
        if not len(at):
            continue
        point = data[at].astype(np.uint32) & np.uint32((1 << 7 - size) - 1)
        for k in range(1, size):
            point = point << np.uint32(6) | data[at + k] & np.uint8(0x3F)
        if size < 4:
            kind, small = _CLASS[point], _LOWER[point]
        else:
            kinds, which = np.unique(point, return_inverse=True)
            kind = np.array([_class_of(p) if p < 0x110000 else _OTHER for p in kinds.tolist()], np.uint8)[which]
            small = np.array([_lower_of(p) if p < 0x110000 else p for p in kinds.tolist()], np.uint32)[which]
        gone = at[kind == _OTHER]
        for k in range(size):
            out[gone + k] = 0
        changed = np.flatnonzero((small != point) & (kind != _OTHER))
        for k in range(size):
            bits = small[changed] >> np.uint32(6 * (size - 1 - k))
            out[at[changed] + k] = (bits & np.uint32(0x3F) | np.uint32(0x80)) if k else (bits | np.uint32((0xF00 >> size) & 0xFF))
        alone = at[kind == _ALONE]
        cuts += [alone, alone + size]
    return out, np.concatenate(cuts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_LONG = 1 << 12  # bytes; a longer string is hashed by itself, so that one long word doesn't cost a round for all


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as a number; zeros follow the last."""
    return np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string data[start:end].

    Every eight bytes are mixed into what came before by a bijection that isn't linear, so that no family of strings
    collides by its algebra, as it would for polynomials modulo 2**64.
    """
    size = ends - starts
    result = mix(size.astype(np.uint64) * _ODD)
    if not len(data) or not len(starts):
        return result
    eights = _eights(data)
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        result[i] = int.from_bytes(digest, "little")
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[live], size[live]
    while len(live):
        some = eights[at] & _KEEP[np.minimum(left, 8)]
        result[live] = mix((result[live] ^ some) * _ODD)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return result


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] and data[b:b + size] are alike, for each of the places."""
    result = np.ones(len(a), bool)
    for i in np.flatnonzero((a != b) & (size > _LONG)).tolist():
        result[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    live = np.flatnonzero((a != b) & (size > 0) & (size <= _LONG))
    if not len(live):
        return result
    eights, x, y, left = _eights(data), a[live], b[live], size[live]
    while len(live):
        good = ((eights[x] ^ eights[y]) & _KEEP[np.minimum(left, 8)]) == 0
        result[live[~good]] = False
        more = good & (left > 8)
        live, x, y, left = live[more], x[more] + 8, y[more] + 8, left[more] - 8
    return result


def kinds_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(example, kind): strings of one kind have the same bytes, those of the string example[kind].

    Hashes only suggest the kinds: the bytes of each string are compared with those of its example, and where hashes
    collide a string is a kind by itself.
    """
    _, example, kind = np.unique(hashed(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    good = (size == size[example][kind]) & same_bytes(data, starts, starts[example][kind], np.minimum(size, size[example][kind]))
    for i in np.flatnonzero(~good).tolist():  # a collision: it is a kind of its own
        kind[i] = len(example)
        example = np.append(example, i)
    return example, kind


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and len(texts) + 1 offsets; null counts as ''."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of the chunk
    offsets: np.ndarray  # byte offsets of the texts
    starts: np.ndarray  # of each word
    ends: np.ndarray
    hashes: np.ndarray  # uint64
    first: np.ndarray  # index of each text's first word, and the number of words
    folded: np.ndarray | None = None  # data in small letters

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def doc_end(self) -> np.ndarray:
        """For each word, the index after its text's last word."""
        return np.repeat(self.first[1:], np.diff(self.first))


def scan(texts: pa.Array) -> Words:
    data, offsets = raw(texts)
    n = len(data)
    small, cuts = folded(data)
    word = small != 0
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[cuts] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = True, ~word[:-1]
        after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | cut[:-1]))
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return Words(data, offsets, starts, ends, hashed(small, starts, ends), np.searchsorted(starts, offsets), small)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each run of k words inside one text, and its hash."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(np.arange(n) + k <= words.doc_end)
    # runs of 1, 2, 4 ... words by doubling; those that k is the sum of make the run of k
    power, size, whole, done = words.hashes, 1, np.full(len(at), k, np.uint64), 0
    while True:
        if k & size:
            whole = mix((whole ^ power[at + done]) * _ODD)
            done += size
        if size * 2 > k:
            return at, whole
        power = mix((power[:-size] ^ _ODD) * _ODD + power[size:])
        size *= 2


def text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(size: np.ndarray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about max_bytes each, where rows have these sizes; a larger row is alone."""
    total = np.concatenate([[0], np.cumsum(size)])
    at, n = 0, len(size)
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + max_bytes, "right")) - 1)
        yield at, to
        at = to


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, max_bytes: int = CHUNK_BYTES, length=text_bytes) -> Iterator[pa.RecordBatch]:
    """The record batches cut into slices of about max_bytes of the text column."""
    for batch in batches:
        if len(batch):
            for at, to in chunks(length(batch.column(text)), max_bytes):
                yield batch.slice(at, to - at)

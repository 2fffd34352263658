"""Decoding of page bytes and quarantine of server-side markup."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import batches as B

_NAMES = {
    "utf-8": ("utf8", "unicode-1-1-utf-8", "ascii", "us-ascii"),
    "koi8-r": ("koi", "koi8", "koi8r", "koi8-ru", "cskoi8r"),
    "ibm866": ("ibm-866", "cp866", "cp-866", "866"),
    "windows-1251": ("win1251", "win-1251", "x-cp1251", "cp1251", "cp-1251", "windows1251"),
    "windows-1252": ("latin1", "latin-1", "iso8859-1", "iso-8859-1", "cp1252", "cp-1252", "windows1252"),
    "x-mac-cyrillic": ("mac-cyrillic", "maccyrillic"),
}
ALIASES = {alias: codec for codec, names in _NAMES.items() for alias in names}
PYTHON = {"windows-1251": "cp1251", "windows-1252": "cp1252", "koi8-r": "koi8_r", "ibm866": "cp866", "iso-8859-5": "iso8859_5", "x-mac-cyrillic": "mac_cyrillic", "utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}
CANDIDATES = ("windows-1251", "koi8-r", "ibm866", "iso-8859-5", "windows-1252")
_DECLARED = (re.compile(r"<\?xml\s[^>]*?\bencoding\s*=\s*[\"']?([\w.:-]+)", re.I), re.compile(r"<meta\s[^>]*?\bcontent\s*=\s*[\"'][^\"'>]*charset\s*=\s*([\w.:-]+)", re.I), re.compile(r"<meta\s[^>]*?\bcharset\s*=\s*[\"']?([\w.:-]+)", re.I))
_BIGRAMS = frozenset("ст но то на ен ов ни ра во ко ос ро ер ре ит не по ка та ор ал ол ем ия ри го ет ле ан ве те ть ас ар ли ла".split())
#: UTF-8 read as Latin-1, or as windows-1251 (of which the letters and signs that Russian doesn't use follow Р and С).
_MOJIBAKE = re.compile("[ÃÐÑ][\u0080-\u00bf]|вЂ|[РС][ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї°±µ¶·№]")


_PAIRS, _NATIVE = re.compile("(?=([а-яё]{2}))"), re.compile("[а-яё]")
_CONTROL = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]")


def codec_label(c: Column | str) -> Column:
    """A charset label in its normal form."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.lower(F.trim(F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")))
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, bare), bare)


def sniff_charset(content: Column | str) -> Column:
    """The charset that the first 1024 bytes declare: XML declaration, then meta content, then meta charset; or null."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    found = [F.nullif(F.regexp_extract(head, "(?i)" + p.pattern, 1), F.lit("")) for p in _DECLARED]
    return codec_label(F.coalesce(*found))


def bom(content: Column | str) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be")


def decoded_with(codec: str, data: bytes) -> str | None:
    try:
        return data.decode(PYTHON.get(codec, codec), "replace")
    except LookupError:
        return None


def plausibility(text: str) -> float:
    """Share of common pairs among neighbouring Cyrillic letters, and of Cyrillic among all letters, less what looks broken.

    What is broken counts by itself, not by its share: a character that can't be decoded rules a codec out.
    """
    if not text:
        return 0.0
    lower = text.lower()
    pairs = _PAIRS.findall(lower)
    common = sum(map(_BIGRAMS.__contains__, pairs)) / len(pairs) if pairs else 0.0
    return 100 * common + 20 * len(_NATIVE.findall(lower)) / max(1, sum(map(str.isalpha, lower))) - 50 * text.count("�") - 25 * len(_CONTROL.findall(text)) - 10 * len(_MOJIBAKE.findall(text))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of each byte, what it is; of each pair of bytes, its class; of each class, what it is) under all CANDIDATES, of one byte a character each."""
    alone, pairs = np.zeros((len(CANDIDATES), 4, 256), np.int64), np.zeros((len(CANDIDATES), 3, 256, 256), bool)
    for k, codec in enumerate(CANDIDATES):
        chars = bytes(range(256)).decode(PYTHON[codec], "replace")
        lower = [c.lower() for c in chars]
        alone[k] = [[bool(_NATIVE.fullmatch(c)) for c in lower], [c.isalpha() for c in lower], [c == "\ufffd" for c in chars], [bool(_CONTROL.fullmatch(c)) for c in chars]]
        pairs[k, 0] = np.logical_and.outer(alone[k, 0] > 0, alone[k, 0] > 0)
        pairs[k, 1] = [[a + b in _BIGRAMS for b in lower] for a in lower]
        pairs[k, 2] = [[bool(_MOJIBAKE.fullmatch(a + b)) for b in chars] for a in chars]
    classes, of = np.unique(np.packbits(pairs.reshape(-1, 1 << 16), axis=0).T, axis=0, return_inverse=True)
    meaning = np.unpackbits(classes, axis=1)[:, : 3 * len(CANDIDATES)].T.astype(np.int64)
    return alone.reshape(-1, 256), of.reshape(-1).astype(np.uint16), meaning


_ALONE: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def plausibilities(data: bytes) -> list[float]:
    """plausibility() of data under each of CANDIDATES, from how often each byte and each class of pairs occurs.

    No match of _MOJIBAKE begins where another ends, so that its matches are pairs like the others.
    """
    if not data:
        return [0.0] * len(CANDIDATES)
    if not _ALONE:
        _ALONE.append(_tables())
    alone, of, meaning = _ALONE[0]
    own = np.frombuffer(data, np.uint8)
    one = (alone @ np.bincount(own, minlength=256)).reshape(-1, 4).tolist()
    two = (meaning @ np.bincount(of[(own[:-1].astype(np.uint16) << 8) | own[1:]], minlength=meaning.shape[1])).reshape(-1, 3).tolist()
    return [100 * (common / pairs if pairs else 0.0) + 20 * native / max(1, letters) - 50 * lost - 25 * control - 10 * broken for (native, letters, lost, control), (pairs, common, broken) in zip(one, two)]


def garbled(text: str, share: float = 0.01) -> bool:
    """Whether a text reads like bytes that were decoded by the wrong codec."""
    return len(_MOJIBAKE.findall(text)) > share * max(1, len(text))


def decide(data: bytes | None) -> dict:
    """The text of page bytes and how it was found: byte-order mark, clean declaration, strict UTF-8, best score, fallback."""
    data = data or b""
    nul = data.count(b"\0")
    mark = next((c for sig, c in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")) if data.startswith(sig)), None)
    if mark is None:
        data = data.replace(b"\0", b" ")
    head = data[:1024].decode("latin-1")
    found = next((m for m in (p.search(head) for p in _DECLARED) if m), None)
    declared = found[1].strip().strip("\"'").lower() if found else None
    declared = ALIASES.get(declared, declared)
    uncertain, text, codec, source = False, None, None, None
    if mark:
        text, codec, source = decoded_with(mark, data), mark, "bom"
    if text is None and declared:
        attempt = decoded_with(declared, data)
        if attempt is not None and "�" not in attempt and not garbled(attempt):
            text, codec, source = attempt, declared, "declared"
    if text is None:
        try:
            text, codec, source = data.decode("utf-8"), "utf-8", "utf-8"
            if garbled(text):
                text = None
        except UnicodeDecodeError:
            pass
        if text is None:
            scored = sorted(((p, -i, c) for i, (c, p) in enumerate(zip(CANDIDATES, plausibilities(data)))), reverse=True)
            best, second = scored[0], scored[1]
            uncertain = best[0] - second[0] < 10
            if best[0] <= 0:
                text, codec, source = decoded_with("windows-1252", data), "windows-1252", "fallback"
            else:
                text, codec, source = decoded_with(best[2], data), best[2], "score"
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    return {"text": text, "codec": codec, "source": source, "declared": declared, "replacement_chars": text.count("�"), "nul_bytes": nul if mark is None else 0, "uncertain": uncertain}


DECODED = "text string, codec string, source string, declared string, replacement_chars int, nul_bytes int, uncertain boolean"


def decode_pages(pages: DataFrame, content: str = "content") -> DataFrame:
    """pages with DECODED instead of the bytes.  Null bytes give an empty text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keep = [c for c in pages.columns if c != content]
    given = pages.select(*keep, content)
    kinds = StructType([*given.drop(content).schema, *StructType.fromDDL(DECODED)])
    arrow = to_arrow_schema(StructType.fromDDL(DECODED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            out = pa.RecordBatch.from_pylist([decide(b) for b in batch.column(len(keep)).to_pylist()], schema=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out.columns], [*keep, *out.schema.names])

    return given.mapInArrow(run, kinds)


# -- server-side islands

_ISLAND = (
    ("php", re.compile(r"<\?(?:php|=)", re.I), "?>"), ("asp", re.compile(r"<%"), "%>"), ("ssi", re.compile(r"<!--#"), "-->"), ("xml", re.compile(r"<\?xml\b", re.I), "?>"), ("php", re.compile(r"<\?(?!xml)", re.I), "?>"),
)


def islands(text: str) -> tuple[str, list[dict]]:
    """(text with server markup blanked, of the same length and lines; what was found).  An XML declaration is recorded and kept."""
    found, pieces, at = [], [], 0
    while True:
        hits = [(m.start(), i) for i, (_, p, _) in enumerate(_ISLAND) if (m := p.search(text, at))]
        if not hits:
            break
        start, i = min(hits)
        kind, _, close = _ISLAND[i]
        end = text.find(close, start)
        open_ended = end < 0
        end = len(text) if open_ended else end + len(close)
        raw = text[start:end]
        found.append({"kind": kind, "start": start, "end": end, "line": text.count("\n", 0, start) + 1, "raw": raw, "unterminated": open_ended})
        pieces.append(text[at:start])
        if open_ended:
            pieces.append(raw[:2])
            at = start + 2
            continue
        pieces.append(raw if kind == "xml" else "".join("\n" if c == "\n" else " " for c in raw))
        at = end
    pieces.append(text[at:])
    return "".join(pieces), found


def quarantine(pages: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, clean, kind, start, end, line, raw, unterminated): a row for each island, one with null kind for a page without."""
    schema = f"{id_col} bigint, clean string, kind string, start int, end int, line int, raw string, unterminated boolean"

    def of(i: int, value: str | None) -> Iterator[dict]:
        clean, found = islands(value or "")
        return ({id_col: i, "clean": clean, **f} for f in found or [{}])

    return B.rows_of(pages, id_col, text, schema, of)

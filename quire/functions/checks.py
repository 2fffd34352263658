"""What a document holds and whether it is sound: facts, scores, conservation and the rules, one document at a time.

A document is a row; everything here is read off its blocks once, so that no rule costs a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

from quire.functions import markdown as M

WEIGHTS = {"text": 0.3, "headings": 0.1, "links": 0.15, "images": 0.1, "directives": 0.1, "cells": 0.15, "shape": 0.1}
AXES = ("text", "headings", "links", "images", "directives", "cells")
SILENT = ("anchor",)  # directives that don't count while the expected document has none
SHINGLE = 5
_JOIN = re.compile(r"([^\W\d_])[-‐‑–—]\s*([^\W\d_])")
_DASHES = re.compile("[-‐‑–—]")
_WORD = re.compile(r"[^\W_]+")
_ASCII = "".join(chr(i) if chr(i).isalnum() else " " for i in range(128))  # what _WORD leaves out as spaces
_MARKS, _SIGNS, _INLINE = re.compile(r"[\\*_`~=]"), re.compile(r"[*_`~]"), re.compile(r"\\(.)|[*_`~]|==")
_SCHEME, _DOT, _PAGES, _ESCAPED = re.compile(r"[a-z][a-z\d+.-]*:"), re.compile(r"^\./"), re.compile(r"^pages/"), re.compile(r"\\(.)")
_TO = r"\(([^\s)]+)(?:\s+\"[^\"]*\")?\)"
IMAGE = re.compile(r"!\[([^\]]*)\]" + _TO)
LINK = re.compile(r"(?<!!)\[((?:\[[^\]]*\]|[^\[\]])*)\]" + _TO)


def normalized(text: str) -> str:
    """Lower case, no soft hyphens, words joined at hyphens, letters and digits only, single spaces."""
    return " ".join(words_of(text))


def words_of(text: str) -> list[str]:
    """The words of normalized(text)."""
    text = text.lower().replace("­", "")
    text = _JOIN.sub(r"\1\2", text) if _DASHES.search(text) else text
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text)


def shingles(text: str, size: int = SHINGLE) -> list[str]:
    """Runs of words of a text; a shorter one is a single shingle, an empty one none."""
    return shingles_of(words_of(text), size)


def shingles_of(words: list[str], size: int = SHINGLE) -> list[str]:
    if len(words) < size:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def plain(text: str) -> str:
    """Markdown's inline syntax off, the words kept."""
    if "](" in text:
        text = LINK.sub(r"\1", IMAGE.sub(r"\1", text) if "![" in text else text)
    return _INLINE.sub(lambda m: m[1] or "", text) if _MARKS.search(text) else text


def label(text: str) -> str:
    return normalized(_SIGNS.sub("", text) if _SIGNS.search(text) else text)


def target(text: str) -> str:
    """Spellings of one destination become equal."""
    v = text.strip(" ").lower()
    v = _ESCAPED.sub(r"\1", v) if "\\" in v else v
    if v.startswith("/#/"):
        return v[1:]
    if v.startswith("//") or _SCHEME.match(v):
        return v.rstrip("/")
    return _PAGES.sub("", _DOT.sub("", v).lstrip("/"))


def cells_of(block: dict) -> list[str]:
    return block["text"].split("\x1f")


def prose(blocks: list[dict]) -> str:
    """The visible text of a document, in order."""
    out = []
    for b in sorted((b for b in blocks if b["kind"] not in ("directive", "rule")), key=lambda b: b["line"]):
        out.append(b["text"].replace("\x1f", " ") if b["kind"] in ("table-row",) else b["text"].replace("\\\n", "\n"))
    out += [b["props"][k] for b in blocks if b["kind"] == "directive" for k in ("caption",) if b["props"].get(k)]
    return " ".join(plain("\n".join(out)).split())


def facts(blocks: list[dict]) -> Iterator[tuple[str, str]]:
    """(axis, item): headings, links, images, directives and cells, one for each occurrence."""
    for b in blocks:
        kind, text, props = b["kind"], b["text"], b["props"]
        if kind == "directive":
            yield "directives", b["name"]
            if props.get("src"):
                yield "links" if b["name"] == "document" else "images", target(props["src"])
            if props.get("link"):
                yield "links", target(props["link"])
        elif kind != "code":
            if kind == "heading":
                yield "headings", f"{b['depth']}\t{label(plain(text))}"
            if "](" in text:
                yield from (("links", target(m[2])) for m in LINK.finditer(text))
                if "![" in text:
                    yield from (("images", target(m[2])) for m in IMAGE.finditer(text))
            if kind == "table-row" and b["depth"] > 0:
                yield from (("cells", x) for c in cells_of(b) if (x := label(plain(c))))


def tables(blocks: list[dict]) -> list[dict]:
    """Columns, body rows and folded body cells of each table in order."""
    out: dict[tuple, dict] = {}
    for b in blocks:
        if b["kind"] == "table-row":
            t = out.setdefault((b["parent"], b["name"]), {"cols": 0, "rows": -1, "cells": set()})
            t["cols"], t["rows"] = max(t["cols"], len(cells_of(b))), t["rows"] + 1
            if b["depth"] > 0:
                t["cells"].update(c.lower() for c in cells_of(b))
    return list(out.values())


def shape_agreement(expected: list[dict], actual: list[dict]) -> float:
    """Tables paired greedily by shared cells; half for the columns' ratio, half for the rows', over the larger number of tables."""
    if not expected and not actual:
        return 1.0
    if not expected or not actual:
        return 0.0
    ratio = lambda a, b: 1.0 if a == b == 0 else min(a, b) / max(a, b)
    free, total = list(range(len(actual))), 0.0
    for e in expected:
        best = max(free, key=lambda i: (len(set(e["cells"]) & set(actual[i]["cells"])) / max(1, len(set(e["cells"]))), -i), default=None)
        if best is None:
            break
        free.remove(best)
        total += 0.5 * ratio(e["cols"], actual[best]["cols"]) + 0.5 * ratio(e["rows"], actual[best]["rows"])
    return total / max(len(expected), len(actual))


def f1(expected: Counter, actual: Counter) -> dict:
    e, a = sum(expected.values()), sum(actual.values())
    m = shared(expected, actual)
    return {**rates(e, a, m), "missing": sorted((expected - actual).elements())[:8]}


def rates(e: int, a: int, m: int) -> dict:
    """Recall, precision and f1 of m matches among e expected and a actual items."""
    recall = m / e if e else 1.0
    precision = m / a if a else float(not e)
    return {"expected": e, "actual": a, "matched": m, "recall": recall, "precision": precision, "f1": 2 * recall * precision / (recall + precision) if recall + precision else 0.0}


def shared(expected: Counter, actual: Counter) -> int:
    """How many items two bags share, with multiplicity."""
    both = list(expected.keys() & actual.keys())
    return sum(map(min, map(expected.__getitem__, both), map(actual.__getitem__, both)))


def shared_runs(expected: list[str], actual: list[str], size: int = SHINGLE) -> tuple[int, int, int]:
    """(shingles of expected, of actual, shared with multiplicity) of two lists of words, as by shingles_of() and shared().

    Words are numbered and their runs packed into one number each, which is numbered again before it would overflow.
    """
    if len(expected) < size or len(actual) < size:
        left, right = Counter(shingles_of(expected, size)), Counter(shingles_of(actual, size))
        return left.total(), right.total(), shared(left, right)
    words = expected + actual
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    own = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    wide = bits = len(ids).bit_length()
    n = len(words) - size + 1
    code = own[:n]
    for k in range(1, size):
        if wide + bits > 63:
            kinds, code = np.unique(code, return_inverse=True)
            wide = len(kinds).bit_length()
        code = (code << bits) | own[k : n + k]
        wide += bits
    kinds, code = np.unique(code, return_inverse=True)
    left, right = code[: len(expected) - size + 1], code[len(expected) :]
    both = np.minimum(np.bincount(left, minlength=len(kinds)), np.bincount(right, minlength=len(kinds)))
    return len(left), len(right), int(both.sum())


def scores(expected: str | None, actual: str | None) -> tuple[dict[str, dict], float, float]:
    """(scores by axis, agreement of table shapes, overall) of two documents."""
    sides = []
    for text in (expected, actual):
        blocks = M.read(text)[0]
        bags: dict[str, Counter] = {axis: Counter() for axis in AXES}
        for axis, item in facts(blocks):
            bags[axis][item] += 1
        bags["text"].update(shingles(prose(blocks)))
        sides.append((bags, tables(blocks)))
    (want, shapes), (have, made) = sides
    for name in SILENT:
        if not want["directives"][name]:
            del have["directives"][name]
    axes = {axis: f1(want[axis], have[axis]) for axis in AXES}
    shape = shape_agreement(shapes, made)
    return axes, shape, sum(WEIGHTS[axis] * axes[axis]["f1"] for axis in AXES) + WEIGHTS["shape"] * shape


def conserved(source: str, output: str, accounted: str = "") -> tuple[int, int, int, float]:
    """(total, lost, excused, recall) of the shingles of a source in its output.

    A lost shingle is excused if it holds a word of the text whose removal is accounted for.
    """
    before, after = words_of(source), words_of(output)
    if before == after:
        return (max(len(before) - SHINGLE + 1, 1) if before else 0), 0, 0, 1.0
    want, have = Counter(shingles_of(before)), Counter(shingles_of(after))
    words, total, lost, excused = set(normalized(accounted).split()), sum(want.values()), 0, 0
    for shingle, n in want.items():
        gone = max(0, n - have[shingle])
        if gone:
            lost += gone
            excused += gone if words and not words.isdisjoint(shingle.split()) else 0
    return total, lost, excused, 1 - (lost - excused) / total if total else 1.0


def bag_lost(want: Iterable[str], have: Iterable[str]) -> tuple[int, int]:
    """(missing, extra) with multiplicity."""
    a, b = Counter(want), Counter(have)
    return sum((a - b).values()), sum((b - a).values())


# -- rules

PALETTE = ("black", "gold", "red", "white")
_RAW = re.compile(r"(?<!\\)</?[A-Za-z][A-Za-z\d]*(?:\s[^<>]*)?>")
_JUMP = re.compile(r"\]\(#([^)\s]+)\)")
_PLACEHOLDER = re.compile(r"(?:column|field|поле|столбец)\s*\d+", re.I)
_IDENT = re.compile(r"[\w.:-]+")


def validate(text: str | None, frames: bool = True, signatures: bool = True, columns_property: bool = False, blocks: list[dict] | None = None) -> list[tuple[str, str, str]]:
    """(code, severity, path): the rules that a document breaks."""
    blocks = M.read(text)[0] if blocks is None else blocks
    by_path = {b["path"]: b for b in blocks}
    children: dict[str, list[dict]] = defaultdict(list)
    for b in blocks:
        children[b["parent"]].append(b)
    out: list[tuple[str, str, str]] = []
    for b in blocks:
        if b["kind"] == "directive":
            out += ((code, severity, b["path"]) for code, severity in _directive(b, children[b["path"]], by_path.get(b["parent"]), frames, signatures, columns_property))
            around = {by_path[p]["name"] for p in _ancestors(b["path"]) if p in by_path}
            if b["name"] == "frame" and "frame" in around:
                out.append(("frame-nested", "error", b["path"]))
            if b["name"] == "nav" and "align" in around:
                out.append(("nav-in-align", "error", b["path"]))
        else:
            out += ((code, severity, b["path"]) for code, severity in _block(b))
    return [*out, *_whole(blocks)]


def _ancestors(path: str) -> Iterator[str]:
    while "/" in path:
        path = path.rsplit("/", 1)[0]
        yield path


def _directive(b: dict, kids: list[dict], up: dict | None, frames: bool, signatures: bool, columns_property: bool) -> Iterator[tuple[str, str]]:
    p, name, inside = b["props"], b["name"], up["name"] if up else ""
    empty = lambda k: not p.get(k, "").strip()
    given = lambda k, ok: k not in p or p[k] in ok
    error = lambda code, test: [(code, "error")] if test else []
    if name == "align":
        yield from error("align-position", p.get("position") not in ("left", "center", "right", "justify"))
        if any(k["name"] == "frame" for k in kids if k["kind"] == "directive"):
            yield "align-wraps-frame", "warning"
    elif name == "image":
        yield from error("image-src", empty("src"))
        if inside == "images":
            yield from error("image-grouped-layout", "position" in p or "size" in p)
        else:
            yield from error("image-position", p.get("position") not in ("left", "center", "right"))
            yield from error("image-size", p.get("size") not in ("small", "medium", "large"))
        yield from error("image-frame", not given("frame", PALETTE))
        yield from error("image-link-empty", "link" in p and empty("link"))
    elif name == "images":
        yield from error("images-columns", p.get("columns") not in ("2", "3", "4"))
        yield from error("images-children", len(kids) < 2)
        yield from error("images-children-kind", any(k["name"] != "image" for k in kids))
    elif name == "document":
        yield from error("document-props", empty("src") or empty("title"))
        yield from error("document-mode", not given("mode", ("link", "embed")) or "mode" not in p)
    elif name == "columns":
        yield from error("columns-arity", not 2 <= len(kids) <= 4)
        yield from error("columns-children", any(k["name"] != "column" for k in kids))
        yield from error("columns-count", not given("columns", ("2", "3", "4")))
        yield from error("columns-count-mismatch", p.get("columns") in ("2", "3", "4") and int(p["columns"]) != len(kids))
        yield from error("columns-property-unsupported", "columns" in p and not columns_property)
        yield from error("divider-unsupported", p.get("divider") == "true" and not columns_property)
    elif name == "column":
        yield from error("column-outside-columns", inside != "columns")
    elif name == "nav":
        items = [k for k in kids if k["kind"] == "list-item"]
        yield from error("nav-ordered", any(k["name"] == "ordered" for k in items))
        yield from error("nav-empty", not items)
        yield from error("nav-active", "active" in p and sum(label(plain(k["text"])) == label(p["active"]) for k in items) != 1)
    elif name == "frame":
        yield from error("frame-unsupported", not frames)
        yield from error("frame-palette", p.get("frame") not in PALETTE)
    elif name == "signature":
        yield from error("signature-unsupported", not signatures)
    elif name == "lead":
        yield from error("lead-nested", inside != "")
    elif name == "anchor":
        yield from error("anchor-identifier-empty", empty("id"))
        yield from error("anchor-identifier-invalid", not empty("id") and not _IDENT.fullmatch(p["id"]))


def _block(b: dict) -> Iterator[tuple[str, str]]:
    kind, text = b["kind"], b["text"]
    if kind == "heading" and not plain(text).strip():
        yield "heading-empty", "error"
    if kind == "table-row" and b["depth"] == 0 and any(_PLACEHOLDER.fullmatch(c) for c in cells_of(b)):
        yield "table-header-placeholder", "error"
    if kind != "code":
        if text.count("==") % 2:
            yield "highlight-unbalanced", "warning"
        if "<" in text and _RAW.search(text):
            yield "raw-html", "error"
    if kind in ("quote", "list-item") and re.match(r":::\s*[A-Za-z]", text):
        yield "directive-inside-prefixed-block", "error"


def _whole(blocks: list[dict]) -> Iterator[tuple[str, str, str]]:
    """Rules over all of a document."""
    heads = sorted((b for b in blocks if b["kind"] == "heading"), key=lambda b: b["line"])
    yield from (("heading-skips-level", "warning", b["path"]) for a, b in zip(heads, heads[1:]) if b["depth"] > a["depth"] + 1)
    if blocks and sum(b["depth"] == 1 for b in heads) != 1:
        yield "h1-count", "error", "document"
    idents: dict[str, str] = {}
    for b in sorted((b for b in blocks if b["kind"] == "directive" and b["name"] == "anchor" and b["props"].get("id")), key=lambda b: b["line"]):
        if idents.setdefault(b["props"]["id"], b["path"]) != b["path"]:
            yield "anchor-duplicate", "error", b["path"]
    used, defined = set(), set()
    widths: dict[tuple, int] = {}
    for b in blocks:
        if b["kind"] == "table-row":
            n = int(b["props"]["cells"])
            if widths.setdefault((b["parent"], b["name"]), n) != n:
                yield "table-ragged", "error", b["path"]
        if b["kind"] not in ("code", "directive"):
            if "](#" in b["text"] and any(ident not in idents for ident in _JUMP.findall(b["text"])):
                yield "anchor-target-missing", "warning", b["path"]
            if "[^" in b["text"]:
                used.update(re.findall(r"\[\^([^\]]+)\](?!:)", b["text"]))
                defined.update(re.findall(r"^\[\^([^\]]+)\]:", b["text"], re.M))
    yield from (("footnote-undefined", "error", "document") for _ in used - defined)
    yield from (("footnote-unreferenced", "warning", "document") for _ in defined - used)
    if over_budget(blocks):
        yield "complexity-budget", "warning", "document"


def over_budget(blocks: list[dict], per_1000: float = 25, max_depth: int = 4, total: int = 40) -> bool:
    """More directives than readers can bear; anchors don't count."""
    real = [b for b in blocks if b["kind"] == "directive" and b["name"] != "anchor"]
    deepest = max((b["depth"] + 1 for b in real), default=0)
    if not real:
        return False
    words = sum(len(b["text"].split()) for b in blocks if b["kind"] != "directive")
    return len(real) > total or deepest > max_depth or words >= 200 and len(real) * 1000 / words > per_1000


def lint(text: str | None, max_line: int = 2200) -> Iterator[tuple[str, int]]:
    """(code, line): long lines, fences that don't balance, leaked server markup."""
    text = text or ""
    lines, depth = text.split("\n"), 0
    for i, line in enumerate(lines, 1):
        if len(line) > max_line:
            yield "line-too-long", i
        if not line.startswith("::"):  # nothing of a fence
            continue
        if M.opened_by(line) is not None:
            depth += 1
        elif M.closes(line):
            if depth == 0:
                yield "fence-unbalanced", i
            depth = max(0, depth - 1)
    if depth:
        yield "fence-unbalanced", len(lines)
    if re.search(r"<!--#|<%|<\?=|<\?php", text):
        yield "server-markup-leaked", 0


def verify(made: dict, minimum: float = 0.995, max_line: int = 2200, profile: dict | None = None) -> dict:
    """The gate that a converted page (compile.convert's result) must pass.

    state: review-required where words, links or images are lost, a table of data was taken apart, or a rule of severity
    error is broken; structurally-valid where only decisions are left to a reviewer; else complete.
    """
    text = made["markdown"]
    blocks = M.read(text)[0]
    total, lost, excused, recall = conserved(made["source_text"], prose(blocks), made["accounted"])
    found = defaultdict(list)
    for axis, item in facts(blocks):
        found[axis].append(item)
    links, images = (bag_lost(map(target, made[k] or []), found[k]) for k in ("links", "images"))
    problems = sum(severity == "error" for _, severity, _ in validate(text, blocks=blocks, **(profile or {}))) + sum(code != "line-too-long" for code, _ in lint(text, max_line))
    reviews = sum(x["terminal"] == "REVIEW" for x in made["ledger"] or [])
    lost_tables = made.get("lost_tables") or 0
    bad = recall < minimum or links[0] or images[0] or problems or lost_tables
    return {
        "recall": recall, "missing_links": links[0], "extra_links": links[1], "missing_images": images[0], "extra_images": images[1], "lost_tables": lost_tables, "problems": problems, "reviews": reviews,
        "state": "review-required" if bad else "structurally-valid" if reviews else "complete",
    }

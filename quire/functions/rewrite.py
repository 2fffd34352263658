"""Rewriting of a page's tree before it is turned into a document, and the record of each change.

The stages follow one another: sanitize, drop the head, take out site chrome, join broken words, normalize, find the
outline.  Each changes the tree in place and returns records; a node is known by ``pre``, its place in the tree as
it was read (see html_tree.numbered).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from quire.functions import html_tree as H

BEHAVIOUR = frozenset(("script", "noscript", "template"))
PLUGINS = frozenset(("applet", "object", "embed", "param"))
FORMS = frozenset(("button", "fieldset", "form", "input", "label", "legend", "select", "textarea"))
STYLES = frozenset(("style", "link"))
_SUSPECT = BEHAVIOUR | PLUGINS | FORMS | STYLES | {"#comment", "img", "meta"}
_HANDLER = re.compile("on[a-z]+")
URL_ATTRIBUTES = frozenset(("href", "src", "action", "background", "cite", "data", "longdesc", "usemap"))
TRACKERS = re.compile(r"//[^/]*(?:counter|tracker|top100|hotlog|mc\.yandex|google-analytics|liveinternet|spylog)[^/]*/", re.I)
UNSAFE = re.compile(r"[\s\x00-\x1f]*(?:javascript|vbscript|file|data:text/html)\s*[:;,]", re.I)
#: Removals that take no words of the page's author along.
SILENT = frozenset(("script", "noscript", "template", "style", "head", "#comment"))
_EDGE = " \t\r\n\f\v\u00a0\u2002\u2003\u2009\u200b\ufeff"


@dataclass
class Record:
    stage: str
    pre: int
    tag: str
    action: str  # remove, unwrap, keep, join, review, heading
    reason: str
    text: str = ""  # what a reader no longer sees
    subsumed_by: int | None = None  # the removed node around it

    @property
    def loses_words(self) -> bool:
        return self.action == "remove" and bool(self.text) and self.tag not in SILENT and self.subsumed_by is None


def detach(node: H.Node) -> None:
    """Take a subtree out."""
    H.thawed(node)
    if node.parent is not None:
        node.parent.children = [c for c in node.parent.children if c is not node]
        node.parent = None


def unwrap(node: H.Node, children: list[H.Node] | None = None) -> None:
    """Put a node's children (or the given nodes) in its place."""
    H.thawed(node)
    up = node.parent
    if up is None:
        return
    inner = node.children if children is None else children
    for child in inner:
        child.parent = up
    at = next(i for i, c in enumerate(up.children) if c is node)
    up.children[at : at + 1] = inner
    node.parent, node.children = None, []


def elements(root: H.Node) -> Iterator[H.Node]:
    return (n for n in H.below(root) if n.kind == "element")


def above(node: H.Node) -> Iterator[H.Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def within(root: H.Node, node: H.Node) -> bool:
    """Whether a node is still in the tree."""
    return node is root or any(n is root for n in above(node))


def pixels(node: H.Node, name: str) -> int | None:
    value = node.attrs.get(name) if node.attrs else None
    found = re.match(r"\s*(\d{1,6})", value) if value else None
    return int(found[1]) if found else None


# -- sanitizing


def sanitize(root: H.Node, styles: bool = True, forms: bool = False) -> list[Record]:
    """Comments, behaviour, plugins, trackers, refreshes and (if asked) styles and forms go; so do event handlers and unsafe URLs."""
    out: list[Record] = []
    gone: list[H.Node] = []
    stack: list[tuple[H.Node, int | None]] = [(c, None) for c in reversed(root.children)]
    while stack:
        node, outer = stack.pop()
        if node.kind == "text":
            continue
        why = _removal(node, styles, forms) if node.tag in _SUSPECT else None
        if why:
            out.append(Record("sanitize", node.pre, node.tag, "remove", why, H.text_of(node) if node.kind == "element" else "", outer))
            outer = node.pre
            gone.append(node)
        elif node.kind == "element" and node.attrs:
            bad = [k for k, v in node.attrs.items() if k[:2] == "on" and _HANDLER.fullmatch(k) or k in URL_ATTRIBUTES and UNSAFE.match(v)]
            for k in bad:
                del node.attrs[k]
                out.append(Record("sanitize", node.pre, node.tag, "keep", "event handler" if k.startswith("on") else "unsafe URL"))
        if node.children:
            stack += [(c, outer) for c in reversed(node.children)]
    for node in gone:
        detach(node)
    return out


def _removal(node: H.Node, styles: bool, forms: bool) -> str | None:
    if node.kind == "comment":
        return "comment"
    if node.kind != "element":
        return None
    a = node.attrs or {}
    if node.tag in BEHAVIOUR:
        return "behaviour"
    if node.tag in PLUGINS:
        return "plugin"
    if forms and node.tag in FORMS:
        return "form"
    if styles and node.tag in STYLES:
        return "style"
    if node.tag == "img":
        w, h = pixels(node, "width"), pixels(node, "height")
        if TRACKERS.search(a.get("src", "")) or w is not None and h is not None and w <= 1 and h <= 1:
            return "tracker"
    if node.tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
        return "refresh"
    return None


def drop_head(root: H.Node) -> list[Record]:
    head = next((n for n in H.walk(root) if n.tag == "head"), None)
    if head is None:
        return []
    detach(head)
    return [Record("head", head.pre, "head", "remove", "head")]


def remove_chrome(root: H.Node, shapes: frozenset[str], fingerprint: Callable[[H.Node], str], tags: frozenset[str], max_share: float = 0.25, max_run: int = 300) -> list[Record]:
    """The outermost elements with the shape of stable chrome go, if they hold little of the page and no long text."""
    out: list[Record] = []
    whole = len(H.text_of(root))
    stack = list(reversed(root.children))
    while stack:
        node = stack.pop()
        if node.kind == "element" and node.tag in tags and fingerprint(node) in shapes:
            text = H.text_of(node)
            if len(text) <= max_share * whole and max((len(n.value.strip()) for n in H.walk(node) if n.kind == "text"), default=0) <= max_run:
                out.append(Record("chrome", node.pre, node.tag, "remove", "chrome", text))
                detach(node)
                continue
        stack.extend(reversed(node.children))
    return out


# -- broken words

HYPHENS = "-‐­"
_HYPHEN = re.compile(f"[{HYPHENS}]")
_LETTERS = r"[^\W\d_]+"
_BROKEN = re.compile(rf"({_LETTERS})([{HYPHENS}])([ \t]*\r?\n?[ \t]*)(?=({_LETTERS}))")
_TOKEN_SIGNS = "._~/@+%&=?#:-"
_INLINE = frozenset(("a", "abbr", "acronym", "b", "big", "em", "font", "i", "s", "small", "span", "strong", "sub", "sup", "tt", "u", "nobr"))


def title_case(word: str) -> bool:
    """A capital, and a small letter after it."""
    return bool(word) and word[0].isalpha() and word[0] != word[0].lower() and word[1:] != word[1:].upper()


def in_identifier(text: str, start: int, end: int) -> bool:
    """Whether [start, end) lies in what looks like an address, a path or a file name."""
    sign = lambda c: c.isalnum() or c in _TOKEN_SIGNS
    while start > 0 and sign(text[start - 1]):
        start -= 1
    while end < len(text) and sign(text[end]):
        end += 1
    token = text[start:end].strip(_TOKEN_SIGNS)
    return any(c in "/@:%" for c in token) or any(a.isalnum() and b == "." and c.isalnum() for a, b, c in zip(token, token[1:], token[2:]))


def in_compound(text: str, start: int, end: int) -> bool:
    """Whether [start, end) lies in a name of three parts and more, as in Rostov-na-Donu."""
    part = lambda c: c.isalpha() or c in HYPHENS
    while start > 0 and part(text[start - 1]):
        start -= 1
    while end < len(text) and part(text[end]):
        end += 1
    parts = re.split(f"[{HYPHENS}]", text[start:end])
    return len(parts) >= 3 and title_case(parts[0]) and title_case(parts[-1])


@dataclass
class Lookup:
    """What is known of words: counts of plain and of hyphenated forms (lower case), a dictionary, and legal breaks."""

    counts: dict[str, int]
    dictionary: frozenset[str] | None = None
    breaks: Callable[[str, int], bool] | None = None


def decide_hyphen(left: str, right: str, hyphen: str, at_line_edge: bool | None, identifier: bool, compound: bool, known: Lookup) -> tuple[str, int, float]:
    """(verdict, rule, confidence) of one hyphen: the first rule that applies.  at_line_edge None: not known."""
    whole, parts = (left + right).lower(), f"{left}-{right}".lower()
    attested, hyphened = known.counts.get(whole, 0), known.counts.get(parts, 0)
    listed = known.dictionary is not None and whole in known.dictionary
    fragments = known.dictionary is not None and left.lower() in known.dictionary and right.lower() in known.dictionary
    legal = known.breaks is not None and known.breaks(left + right, len(left))
    if identifier:
        return "PRESERVE", 0, 0.99
    if hyphen == "­":
        return "JOIN", 1, 1.0
    if at_line_edge is False:
        return "PRESERVE", 2, 0.98
    if compound or title_case(left) and title_case(right):
        return "PRESERVE", 3, 0.92
    if attested >= 1:
        return "JOIN", 4, min(0.99, 0.85 + attested / 100)
    if hyphened >= 2:
        return "PRESERVE", 5, min(0.98, 0.85 + hyphened / 100)
    if legal and listed:
        return "JOIN", 6, 0.88
    if listed and not fragments:
        return "JOIN", 6, 0.82
    return ("REVIEW", 6, 0.6) if legal else ("REVIEW", 7, 0.5)


def has_hyphen(text: str) -> bool:
    return _HYPHEN.search(text) is not None


def broken_at(text: str) -> list[tuple[str, str]]:
    """(left, right) of the candidates of hyphens_of."""
    return [(left, right) for left, _, _, right in _BROKEN.findall(text)]


def hyphens_of(text: str) -> Iterator[dict]:
    """Candidates: letters, a hyphen, white space at most, letters.  Neighbours may share letters."""
    for m in _BROKEN.finditer(text):
        start, end = m.start(1), m.end(4)
        # letters between spaces are no part of an address, nor of a longer name
        if text[start - 1 : start].isspace() and text[end : end + 1].isspace():
            yield {"left": m[1], "hyphen": m[2], "right": m[4], "at_line_edge": "\n" in m[3], "start": m.start(2), "end": m.end(3), "in_identifier": False, "in_compound": False}
            continue
        yield {"left": m[1], "hyphen": m[2], "right": m[4], "at_line_edge": "\n" in m[3], "start": m.start(2), "end": m.end(3), "in_identifier": in_identifier(text, start, end), "in_compound": in_compound(text, start, end)}


def join_words(text: str, known: Lookup) -> tuple[str, list[dict]]:
    """(text with its broken words joined, decisions).  A decision has the span [start, end) of the hyphen in the text given."""
    out, at, made = [], 0, []
    for c in hyphens_of(text):
        verdict, rule, sure = decide_hyphen(c["left"], c["right"], c["hyphen"], c["at_line_edge"], c["in_identifier"], c["in_compound"], known)
        c["verdict"], c["rule"], c["confidence"] = verdict, rule, sure
        made.append(c)
        if verdict == "JOIN":
            out.append(text[at : c["start"]])
            at = c["end"]
    return "".join(out) + text[at:], made


def patched(text: str, decisions: list[dict]) -> str:
    """What the decisions make of a text, played back; must equal join_words' result."""
    keep, at = [], 0
    for d in decisions:
        if d["verdict"] == "JOIN":
            keep.append(text[at : d["start"]])
            at = d["end"]
    return "".join([*keep, text[at:]])


def dehyphenate(root: H.Node, known: Lookup) -> list[Record]:
    """Broken words of all texts are joined, also across an inline element that holds nothing but a hyphen."""
    out: list[Record] = []
    order = H.below(root)
    if not any(_HYPHEN.search(n.value) for n in order if n.kind == "text"):
        return out
    for node in order:
        if node.kind == "text" and _HYPHEN.search(node.value):
            node.value, made = join_words(node.value, known)
            for d in made:
                action = {"JOIN": "join", "REVIEW": "review"}.get(d["verdict"], "keep")
                out.append(Record("dehyphenate", node.pre, "#text", action, f"rule {d['rule']}", d["left"] + d["hyphen"] + d["right"]))
        kids = node.children
        for before, mid, after in zip(kids, kids[1:], kids[2:]):
            if before.kind == after.kind == "text" and mid.kind == "element" and mid.tag in _INLINE:
                sign = H.text_buffer(mid)
                left, right = re.search(rf"{_LETTERS}$", before.value), re.match(_LETTERS, after.value)
                if len(sign) == 1 and sign in HYPHENS and left and right:
                    whole = before.value + sign + after.value
                    a, b = left.start(), len(before.value) + 1 + right.end()
                    verdict, rule, _ = decide_hyphen(left[0], right[0], sign, None, in_identifier(whole, a, b), in_compound(whole, a, b), known)
                    if verdict == "JOIN":
                        for n in H.walk(mid):
                            if n.kind == "text":
                                n.value = ""
                    out.append(Record("dehyphenate", mid.pre, mid.tag, {"JOIN": "join", "REVIEW": "review"}.get(verdict, "keep"), f"rule {rule}", left[0] + sign + right[0]))
    return out


# -- normalizing

_MAY_BE_EMPTY, _WRAPPERS = frozenset(("p", "div")), frozenset(("div", "span"))
PRESENTATION = frozenset(("font", "center", "big", "small", "tt", "nobr", "basefont"))
_SPACER = re.compile(r"(?:^|/)(?:1x1|blank|clear|dot|pixel|shim|spacer)[\w.-]*\.(?:gif|jpg|png)$", re.I)
_ENTITY = re.compile(r"&(?:#\d+|amp|gt|lt|nbsp|quot);")
_HEADING = re.compile("h[1-6]")


def normalize(root: H.Node, invisible: frozenset[int] = frozenset()) -> list[Record]:
    """Presentation folds into its parents, and what only holds space goes.  invisible: measured nodes (pre) that nobody sees."""
    tags = {n.tag for n in H.below(root)}
    if "center" in tags:  # may become a div
        tags.add("div")
    out = fold_presentation(root) if tags & PRESENTATION else []
    out += drop_spacers(root) if "img" in tags else []
    out += drop_invisible(root, invisible)
    out += drop_empty(root) if tags & _MAY_BE_EMPTY else []
    out += demote_quotations(root) if "blockquote" in tags else []
    out += unwrap_tables(root) if "table" in tags else []
    return out + (collapse_wrappers(root) if tags & _WRAPPERS else [])


def fold_presentation(root: H.Node) -> list[Record]:
    """font, center and their like give size, colour and alignment to their parent and go; one that sizes only a part of its parent's text stays."""
    out = []
    for node in elements(root):
        if node.tag not in PRESENTATION or node.parent is None:
            continue
        up, a = node.parent, node.attrs
        style = {k: a[k] for k in ("size", "color") if a.get(k)}
        if "size" in style and H.text_of(node) != H.text_of(up):
            a.update({f"data-{k}": v for k, v in style.items()})
            out.append(Record("normalize", node.pre, node.tag, "keep", "sets a part of its line"))
            continue
        if node.tag == "center":
            style["align"] = "center"
        for k, v in style.items():
            if up.kind == "element" and up.attrs is not None:
                up.attrs.setdefault(f"data-{k}", v)
        if node.tag == "center" and len(up.children) > 1:  # its own alignment doesn't hold for its siblings
            node.tag, node.attrs = "div", {**a, "align": "center"}
            if up.attrs is not None and up.attrs.get("data-align") == "center":
                del up.attrs["data-align"]
            out.append(Record("normalize", node.pre, "center", "keep", "centres a part of its parent"))
            continue
        unwrap(node)
        out.append(Record("normalize", node.pre, node.tag, "unwrap", "presentation"))
    return out


def is_spacer(node: H.Node) -> bool:
    w, h = pixels(node, "width"), pixels(node, "height")
    return bool(_SPACER.search((node.attrs or {}).get("src", ""))) or w is not None and h is not None and min(w, h) <= 2


def drop_spacers(root: H.Node) -> list[Record]:
    return _drop(root, lambda n: n.tag == "img" and is_spacer(n), "spacer")


def holding(root: H.Node, test: Callable[[H.Node], bool]) -> set[int]:
    """id of every node that is, or holds, one for which test is true; each node is visited once."""
    found: set[int] = set()
    for node in H.walk(root):
        if id(node) not in found and test(node):
            found.add(id(node))
            for up in above(node):
                if id(up) in found:
                    break
                found.add(id(up))
    return found


def drop_invisible(root: H.Node, invisible: frozenset[int]) -> list[Record]:
    """Containers that were measured as invisible and hold nothing."""
    if not invisible:
        return []
    held = holding(root, lambda n: n.tag == "img" or n.kind == "text" and n.value.strip(_EDGE) != "")
    return _drop(root, lambda n: n.pre in invisible and n.tag not in H.VOID and n.tag not in ("html", "body") and id(n) not in held, "invisible")


def drop_empty(root: H.Node) -> list[Record]:
    """p and div without text, images and links."""
    held = holding(root, lambda n: n.kind == "text" and n.value.strip(_EDGE) != "" or n.tag == "img" or n.tag == "a" and bool(n.attrs))
    if not any(n.tag in _MAY_BE_EMPTY and id(n) not in held for n in H.below(root)):
        return []
    return _drop(root, lambda n: n.tag in _MAY_BE_EMPTY and id(n) not in held, "empty")


def _drop(root: H.Node, test: Callable[[H.Node], bool], why: str) -> list[Record]:
    out, stack = [], list(reversed(root.children))
    while stack:
        node = stack.pop()
        if node.kind == "element" and test(node):
            out.append(Record("normalize", node.pre, node.tag, "remove", why))
            detach(node)
        else:
            stack.extend(reversed(node.children))
    return out


def demote_quotations(root: H.Node, share: float = 0.35) -> list[Record]:
    """A blockquote that holds tables or headings, much of the page, or nothing, is an indent."""
    out, whole = [], len(H.text_of(root))
    for node in elements(root):
        if node.tag != "blockquote":
            continue
        inner = [n.tag for n in H.walk(node) if n.kind == "element"]
        size = len(H.text_of(node))
        why = (
            "indent around tables" if "table" in inner else "indent around headings" if any(map(_HEADING.fullmatch, inner)) else "indent of most of the page" if whole and size >= share * whole
            else "empty indent" if not size and "img" not in inner else None
        )
        if why:
            out.append(Record("normalize", node.pre, "blockquote", "unwrap", why))
            unwrap(node)
    return out


def unwrap_tables(root: H.Node) -> list[Record]:
    """A table of one cell without border and background is a wrapper."""
    from quire.functions import grids as G

    out = []
    for node in elements(root):
        if node.tag != "table":
            continue
        a = node.attrs or {}
        cells = [c for r in G.own_rows(node) for c in G.own_cells(r)]
        if len(cells) != 1 or len(G.own_rows(node)) != 1 or (pixels(node, "border") or 0) > 0 or a.get("bgcolor") or a.get("background"):
            continue
        if border_width(cells[0]) >= 2:
            continue
        out.append(Record("normalize", node.pre, "table", "unwrap", "table of one cell"))
        unwrap(node, cells[0].children)
    return out


def border_width(node: H.Node) -> float:
    """Pixels of the border that an inline style draws."""
    found = re.search(r"(?:^|;)\s*border(?:-width)?\s*:[^;]*?(\d+(?:\.\d+)?)", (node.attrs or {}).get("style", ""), re.I)
    return float(found[1]) if found else 0.0


def collapse_wrappers(root: H.Node) -> list[Record]:
    """A div or span without attributes whose only content is another div or span."""
    out = []
    for node in elements(root):
        if node.tag in ("div", "span") and not node.attrs and node.parent is not None:
            inner = [c for c in node.children if c.kind != "text" or c.value.strip()]
            if len(inner) == 1 and inner[0].tag in ("div", "span"):
                out.append(Record("normalize", node.pre, node.tag, "unwrap", "wrapper"))
                unwrap(node)
    return out


def double_decoded(root: H.Node) -> list[int]:
    """Texts (pre) that still look like entities after they were decoded: escaped twice at the source, not to be decoded again."""
    return [n.pre for n in H.walk(root) if n.kind == "text" and _ENTITY.search(n.value)]


# -- outline

_texts: dict[int, str] | None = None  # of the nodes of a tree while only its attributes change
_looks: dict[tuple[str, int], object] = {}  # how those nodes are set, by what is asked; attributes that say so don't change


def text_of(node: H.Node) -> str:
    if _texts is None or node.tree is not None:
        return H.text_of(node)
    text = _texts.get(id(node))
    if text is None:
        text = _texts[id(node)] = H.text_of(node)
    return text


def once(f: Callable[[H.Node], object]) -> Callable[[H.Node], object]:
    """f, asked once for each node of a tree whose texts are kept."""

    def kept(node: H.Node) -> object:
        if _texts is None:
            return f(node)
        key = (f.__name__, id(node))
        if key not in _looks:
            _looks[key] = f(node)
        return _looks[key]

    return kept


_BOLD = frozenset(("b", "strong"))
LEGACY_PX = {1: 10, 2: 13, 3: 16, 4: 18, 5: 24, 6: 32, 7: 48}
_CANDIDATES = frozenset(("p", "div", "td", "th", "span", "font", "b", "strong", "center", "li", "a", "h1", "h2", "h3", "h4", "h5", "h6"))
_EMPHASIS = frozenset(("b", "strong", "i", "em", "u", "s", "nobr", "big", "small", "sup", "sub"))
_LIFT = frozenset(("span", "font", "b", "strong", "i", "em", "u", "a", "center", "p", "div"))


def css_px(value: str) -> float | None:
    found = re.fullmatch(r"\s*(-?\d*\.?\d+)\s*(px|pt|em|rem|%)?\s*", value.lower())
    if not found:
        return None
    n = float(found[1])
    return {"pt": n * 4 / 3, "em": n * 16, "rem": n * 16, "%": n / 100 * 16}.get(found[2], n)


def declared_px(node: H.Node) -> float | None:
    """The font size that an element asks for: by style, or by a size of 1 to 7 or relative to 3."""
    a = node.attrs
    if not a:
        return None
    return _px(a.get("style", ""), a.get("data-size") or (a.get("size", "") if node.tag in ("font", "basefont") else ""))


@lru_cache(4096)
def _px(style: str, size: str) -> float | None:
    for pattern in (r"font-size\s*:\s*([^;]+)", r"(?:^|;)\s*font\s*:[^;]*?(\d[\d.]*(?:px|pt|em|%))"):
        found = re.search(pattern, style, re.I) if style else None
        if found and (px := css_px(found[1])) is not None:
            return px
    if re.fullmatch(r"\s*[+-]?\d\s*", size):
        n = int(size)
        return LEGACY_PX[max(1, min(7, 3 + n if size.strip()[0] in "+-" else n))]
    return None


def _sized(tree: H.Frozen) -> bool:
    """Whether any element asks for a size."""
    if tree.sized is None:
        tree.sized = any(n.attrs and declared_px(n) is not None for n in tree.order)
    return tree.sized


def _sided(tree: H.Frozen) -> bool:
    """Whether any element may ask for an alignment."""
    if tree.sided is None:
        tree.sided = "center" in tree.tags or any(a and ("style" in a or "align" in a or "data-align" in a) for a in [n.attrs for n in tree.order])
    return tree.sided


@once
def font_px(node: H.Node) -> float:
    """The size of an element's text: declared by it, by the one element inside that holds all of its text, or by an ancestor; 16 otherwise."""
    if node.tree is not None and not _sized(node.tree):
        return 16.0
    text = text_of(node)
    inner = node
    while True:
        px = declared_px(inner)
        if px is not None:
            return px
        held = [c for c in inner.children if c.kind == "element" and text_of(c) == text]
        if len(held) != 1:
            break
        inner = held[0]
    return next((px for up in above(node) if (px := declared_px(up)) is not None), 16.0)


@once
def is_bold(node: H.Node) -> bool:
    text = text_of(node)
    style = (node.attrs or {}).get("style")
    if node.tag in ("b", "strong", "th") or style and re.search(r"font-weight\s*:\s*(?:bold|[6-9]00)", style, re.I):
        return True
    if node.tree is not None and not node.tree.tags & _BOLD:
        return False
    if any(n.tag in ("b", "strong") and text_of(n) == text for n in H.walk(node)):
        return True
    return any(up.tag in ("b", "strong") for up, _ in zip(above(node), range(4)))


def alignment(node: H.Node, hops: int = 4) -> str | None:
    """The alignment that an element or one of its near ancestors asks for."""
    if node.tree is not None and not _sided(node.tree):
        return None
    for n, _ in zip([node, *above(node)], range(hops + 1)):
        a = n.attrs
        if not a and n.tag not in ("center", "td", "th", "table", "body"):
            continue
        a = a or {}
        side = _side(a.get("style") or "", a.get("align") or a.get("data-align") or ("center" if n.tag == "center" else ""))
        if side:
            return side
        if n.tag in ("td", "th", "table", "body"):
            return None
    return None


@lru_cache(4096)
def _side(style: str, align: str) -> str | None:
    found = re.search(r"text-align\s*:\s*([\w-]+)", style, re.I) if style else None
    return fold_align((found[1] if found else align).lower().strip())


@lru_cache(4096)
def fold_align(value: str) -> str | None:
    value = re.sub(r"^-(?:khtml|moz|ms|webkit)-", "", value)
    return {"centre": "center", "middle": "center", "center": "center", "end": "right", "right": "right", "start": "left", "left": "left", "justify": "justify"}.get(value)


@once
def prominence(node: H.Node) -> float:
    text = text_of(node)
    shouted = len(text) <= 60 and text.upper() == text and text.lower() != text and any(map(str.isalpha, text))
    return font_px(node) / 16 * (1.15 if is_bold(node) else 1) * (1.05 if alignment(node) == "center" else 1) * (1.1 if shouted else 1)


_SENTENCE = re.compile(r"[.!?]\s")


def label_like(text: str) -> bool:
    """Names something: has a letter, isn't a sentence, doesn't lead on, and is short."""
    return text[-1:] not in (",", ";", ":") and any(map(str.isalpha, text)) and not _SENTENCE.search(text) and len(text.split()) <= 10


def tight(node: H.Node, text: str) -> bool:
    """Whether no element inside but emphasis holds all of the text."""
    for c in node.children:
        if c.kind == "element" and c.tag not in _EMPHASIS and len(text_of(c)) >= len(text):
            return False
    return True


def block_host(node: H.Node) -> H.Node:
    """The outermost block that holds nothing but a node's text."""
    text, best = text_of(node), node
    for up in above(node):
        if up.tag not in _LIFT or text_of(up) != text:
            break
        if up.tag in H.BLOCK:
            best = up
    return best


def own_line(node: H.Node) -> bool:
    """Whether nothing else stands on a node's line: blocks, breaks or edges are on both of its sides."""
    at = node
    while at.tag not in H.BLOCK and at.parent is not None:
        siblings = at.parent.children
        i = siblings.index(at)
        sides = [c for side in (range(i - 1, -1, -1), range(i + 1, len(siblings))) if (c := next((siblings[k] for k in side if siblings[k].kind == "element" or siblings[k].kind == "text" and siblings[k].value.strip()), None)) is not None]
        if any(c.kind == "text" or c.tag != "br" and c.tag not in H.BLOCK for c in sides):
            return False
        if len(sides) == 2 or at.parent.tag in H.BLOCK:
            return True
        at = at.parent
    return True


def follows_image(node: H.Node) -> bool:
    """Whether the last thing before a node, in its own or a near ancestor's siblings, is a picture without words."""
    at = node
    for _ in range(3):
        up = at.parent
        if up is None:
            return False
        for k in range(up.children.index(at) - 1, -1, -1):
            c = up.children[k]
            if c.kind == "element" and (text_of(c) or c.tag == "img" or any(x.tag == "img" for x in H.walk(c))) or c.kind == "text" and c.value.strip():
                return c.kind == "element" and not text_of(c)
        at = up
    return False


def content_follows(node: H.Node, least: int = 40) -> bool:
    """Whether text of some length, or a picture, comes after a node."""
    at = node
    for up in above(node):
        for k in range(up.children.index(at) + 1, len(up.children)):
            c = up.children[k]
            if c.kind == "text" and len(c.value.strip()) > least or c.kind == "element" and (c.tag == "img" or len(text_of(c)) > least or any(x.tag == "img" for x in H.walk(c))):
                return True
        at = up
    return False


def body_baseline(root: H.Node, least: int = 200) -> float:
    """The upper median of the prominence of blocks that hold much text; 1 where there are none."""
    found = sorted(prominence(n) for n in elements(root) if n.tag in ("p", "div", "td") and len(t := text_of(n)) >= least and tight(n, t))
    return found[len(found) // 2] if found else 1.0


def signature(node: H.Node) -> str:
    """What labels of one template share: a class, or weight and size."""
    cls = (node.attrs or {}).get("class", "").strip()
    return f"{node.tag}.{cls}" if cls else f"{node.tag} {'bold' if is_bold(node) else 'plain'} {round(font_px(node))} {alignment(node) or ''}"


def recover_headings(root: H.Node, sections: bool = True, **limits) -> list[Record]:
    """As _recover_headings; texts are read once."""
    global _texts
    _texts = {}
    _looks.clear()
    try:
        return _recover_headings(root, sections, **limits)
    finally:
        _texts = None
        _looks.clear()


def _recover_headings(root: H.Node, sections: bool = True, title_least: float = 1.25, section_least: float = 1.12, title_max: int = 120, section_max: int = 70) -> list[Record]:
    """Marks (attribute data-heading) of what is set like a title and like section labels; h1 to h6 count as marked.

    The title is the most prominent short block; sections stand out from the body but less than it.  Stacks of equal labels,
    captions under pictures, many labels inside nested tables, and labels with nothing after them aren't sections.
    """
    offsets, total = {}, 0
    found = []
    order = H.below(root)
    tags = {n.tag for n in order}
    headed, linked = bool(tags & H.HEADINGS), "a" in tags
    for n in order:
        offsets[id(n)] = total
        if n.kind == "text":
            total += len(n.value.strip())
        elif n.kind == "element" and n.tag in _CANDIDATES and n.tag not in H.HEADINGS:
            text = text_of(n)
            if text and len(text) <= title_max and tight(n, text) and not (headed and any(up.tag in H.HEADINGS for up in above(n))):
                if (not linked or sum([len(text_of(x)) for x in [n, *H.below(n)] if x.tag == "a"]) < len(text)) and own_line(n):
                    found.append((n, text))
    if not found:
        return []
    base = body_baseline(root)
    ranked = sorted(((prominence(n) / base, i, n, t) for i, (n, t) in enumerate(found)), key=lambda x: (-x[0], x[1]))
    out: list[Record] = []
    explicit = headed and any(n.tag in H.HEADINGS and text_of(n) for n in order)
    top = ranked[0][0]
    if top < title_least and not explicit:
        return []
    if not explicit:
        host = block_host(ranked[0][2])
        host.attrs["data-heading"] = "1"
        out.append(Record("headings", host.pre, host.tag, "heading", "title", ranked[0][3]))
    if not sections:
        return out
    picked = [(i, n, t) for rel, i, n, t in ranked[0 if explicit else 1 :] if section_least <= rel < (0.98 * top if not explicit else float("inf")) and len(t) <= section_max and label_like(t)]
    nested = [x for x in picked if sum(up.tag == "table" for up in above(x[1])) > 1]
    dropped = {id(n) for _, n, _ in nested} if len(nested) > 4 else set()
    picked.sort()
    for (_, a, at), (_, b, _) in zip(picked, picked[1:]):
        if signature(a) == signature(b) and offsets[id(b)] - offsets[id(a)] <= len(at.replace(" ", "")) + at.count(" ") and not within(a, b):
            dropped.update((id(a), id(b)))
    marked = [n for _, n, _ in picked if id(n) not in dropped]
    for node in marked:
        host = block_host(node)
        inside = any("data-heading" in (n.attrs or {}) for n in [host, *above(host), *H.walk(host)] if n.kind == "element")
        if inside or follows_image(node) or not content_follows(node):
            continue
        host.attrs["data-heading"] = "2"
        out.append(Record("headings", host.pre, host.tag, "heading", "section", text_of(host)))
    return [*out, *centered_sections(root, offsets), *bullet_sections(root, offsets), *complete_templates(root)]


def _open(node: H.Node) -> bool:
    """Whether a node may still become a heading."""
    return not any("data-heading" in (n.attrs or {}) or _HEADING.fullmatch(n.tag) for n in [node, *above(node), *H.walk(node)] if n.kind == "element")


def centered_sections(root: H.Node, offsets: dict[int, int], least: int = 3, gap: int = 150) -> list[Record]:
    """Short centred blocks of one template, three and more, with prose between them; not where the prose is centred too."""
    if root.tree is not None and not _sided(root.tree):
        return []
    blocks = [(n, t) for n in elements(root) if n.tag in ("p", "div", "td") and (t := text_of(n)) and tight(n, t)]
    long = [n for n, t in blocks if len(t) >= 200]
    if sum(alignment(n) == "center" for n in long) > 0.5 * len(long):
        return []
    groups: dict[str, list[H.Node]] = {}
    for n, t in blocks:
        if len(t) <= 70 and label_like(t) and alignment(n) == "center" and _open(n) and not any(x.tag in ("a", "img") for x in H.walk(n)) and not follows_image(n):
            groups.setdefault(signature(n), []).append(n)
    out = []
    for nodes in groups.values():
        starts = [offsets[id(n)] for n in nodes if id(n) in offsets]
        if len(nodes) >= least and all(b - a >= gap for a, b in zip(starts, starts[1:])):
            for n in nodes:
                if content_follows(n):
                    n.attrs["data-heading"] = "2"
                    out.append(Record("headings", n.pre, n.tag, "heading", "centred section", text_of(n)))
    return out


_BULLETS = "•·▪◦●■◆►*"


def bullet_sections(root: H.Node, offsets: dict[int, int], least: int = 3, body: int = 100) -> list[Record]:
    """Three and more labels that begin with the same bullet, each over a body of text."""
    groups: dict[str, list[H.Node]] = {}
    for n in elements(root):
        if n.tag in ("p", "div", "td") and 2 < len(text := text_of(n)) <= 70 and text[0] in _BULLETS and tight(n, text) and label_like(text[1:].strip()) and _open(n):
            groups.setdefault(text[0], []).append(n)
    if not groups:
        return []
    total = sum(len(n.value.strip()) for n in H.walk(root) if n.kind == "text")
    out = []
    for nodes in groups.values():
        starts = [offsets.get(id(n), 0) for n in nodes]
        bodies = [b - a - len(text_of(n)) for n, a, b in zip(nodes, starts, [*starts[1:], total])]
        if len(nodes) >= least and min(bodies) >= body:
            for n in nodes:
                n.attrs["data-heading"] = "3"
                out.append(Record("headings", n.pre, n.tag, "heading", "bulleted section", strip_glyphs(text_of(n))))
    return out


def strip_glyphs(text: str) -> str:
    """A label without the ornaments before it."""
    return text.lstrip(_BULLETS + " " + "–—-").strip() or text


def complete_templates(root: H.Node, least: int = 2) -> list[Record]:
    """Where two and more labels with a class are marked, the other short labels with that class are marked too, at their least depth."""
    depth: dict[str, list[int]] = {}
    for n in elements(root):
        cls = (n.attrs or {}).get("class", "").strip()
        if cls and n.attrs.get("data-heading") in ("2", "3"):
            depth.setdefault(f"{n.tag}.{cls}", []).append(int(n.attrs["data-heading"]))
    out = []
    if not depth:
        return out
    for n in elements(root):
        cls = (n.attrs or {}).get("class", "").strip()
        known = depth.get(f"{n.tag}.{cls}") if cls else None
        if known and len(known) >= least and (text := text_of(n)) and len(text) <= 70 and label_like(text) and _open(n) and content_follows(n):
            n.attrs["data-heading"] = str(min(known))
            out.append(Record("headings", n.pre, n.tag, "heading", "template", text))
    return out


def prose_align(root: H.Node, least: int = 120, samples: int = 2) -> str | None:
    """The alignment of most of the text in long blocks; of equals the first of left, justify, center, right."""
    weight: Counter = Counter()
    n = 0
    for node in elements(root):
        if node.tag in ("p", "div", "td", "blockquote") and len(text := text_of(node)) >= least and tight(node, text):
            side = alignment(node) or "left"
            weight[side] += len(text)
            n += 1
    order = ("left", "justify", "center", "right")
    return min(weight, key=lambda s: (-weight[s], order.index(s))) if n >= samples else None


def distinctive(side: str | None, baseline: str | None) -> bool:
    if side is None:
        return False
    if baseline is None:
        return side in ("center", "right")
    flat = lambda s: "left" if s == "justify" else s
    return flat(side) != flat(baseline)


# -- frames

_NAMED = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "maroon": (128, 0, 0), "gold": (255, 215, 0), "yellow": (255, 255, 0), "silver": (192, 192, 192), "gray": (128, 128, 128), "orange": (255, 165, 0)}


def palette(color: str | None) -> str | None:
    """The nearest of black, white, red and gold, or null for what is none of them."""
    value = (color or "").strip().lower()
    rgb = _NAMED.get(value)
    if (m := re.fullmatch(r"#?([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})", value)) is not None:
        rgb = tuple(int(x, 16) for x in m.groups())
    elif (m := re.fullmatch(r"#([0-9a-f])([0-9a-f])([0-9a-f])", value)) is not None:
        rgb = tuple(int(x, 16) * 17 for x in m.groups())
    elif (m := re.match(r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", value)) is not None:
        rgb = tuple(map(int, m.groups()))
    if rgb is None:
        return None
    r, g, b = rgb
    if max(rgb) <= 90:
        return "black"
    if min(rgb) >= 225:
        return "white"
    if r >= 130 and g < 0.55 * r and b < 0.55 * r:
        return "red"
    if r >= 150 and 0.55 * r <= g <= 1.05 * r and b < 0.7 * g:
        return "gold"
    return None


def frame_evidence(node: H.Node, page_len: int) -> tuple[str, str] | None:
    """(palette, why) of a block that its author set apart: a border of two pixels and more, the box of a single cell, or a tinted panel.

    Frames hold 20 characters and more, 60 % of the page at most, and no table.
    """
    a = node.attrs or {}
    if node.tag != "table" and not a.get("style") and not a.get("bgcolor"):
        return None
    text = H.text_of(node)
    if len(text) < 20 or page_len and len(text) > 0.6 * page_len or node.tag != "table" and any(n.tag == "table" for n in H.walk(node)):
        return None
    style = a.get("style", "")
    width = border_width(node)
    if width >= 2:
        found = re.search(r"border[^;]*?(#[0-9a-f]{3,6}|rgba?\([^)]*\)|\b(?:" + "|".join(_NAMED) + r")\b)", style, re.I)
        color = palette(found[1] if found else "black")
        return (color, "border") if color else None
    if node.tag == "table":
        from quire.functions import grids as G

        cells = [c for r in G.own_rows(node) for c in G.own_cells(r)]
        if len(cells) == 1 and (pixels(node, "border") or 0) > 0 and not any(n.tag == "table" for n in H.walk(node)):
            return palette(a.get("bordercolor")) or "black", "box of one cell"
        return None
    tint = palette(a.get("bgcolor") or (m[1] if (m := re.search(r"background(?:-color)?\s*:\s*([^;\s]+)", style, re.I)) else None))
    if node.tag in ("td", "div") and tint in ("red", "gold"):
        return tint, "tinted panel"
    return None


# -- links

_SCHEME = re.compile(r"//|[A-Za-z][A-Za-z\d+.-]*:")
_ABSOLUTE = re.compile(r"(?:[A-Za-z][A-Za-z\d+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(.*)", re.S)
_RESOURCE = re.compile(r"\.(?:7z|aac|bmp|docx?|flac|gif|gz|jpe?g|m4a|midi?|mp3|og[ag]|pdf|png|rar|svg|txt|wav|webp|zip)$", re.I)
_PAGE = re.compile(r"\.html?$", re.I)


def rewrite_target(raw: str, profile) -> tuple[str, str]:
    """(kind, href): as links.rewrite_target, for one text."""
    v = re.sub(r"</?[A-Za-z][A-Za-z\d]*(?:\s[^<>]*)?>", "", raw.strip(" ")).strip(" ")
    if v == "":
        return "empty", v
    if re.match(r"\s*(?:data|file|javascript|vbscript):", v, re.I):
        return "unsafe", ""
    if v.startswith("#"):
        return "anchor", v
    if v[:7].lower() == "mailto:":
        return "mailto", v
    absolute, rest = bool(_SCHEME.match(v)), v
    if absolute:
        found = _ABSOLUTE.fullmatch(v)
        if found is None or found[1].lower() not in profile.internal_hosts:
            return "external", v
        rest = found[2]
    before, _, fragment = rest.partition("#")
    path, _, query = before.partition("?")
    base = path.rsplit("/", 1)[-1]
    if _RESOURCE.search(path) or not _PAGE.search(path):
        if absolute:
            return "resource" if _RESOURCE.search(path) else "external", v
        return "resource", site_relative(v, profile)
    route = base if any(k in path for k in profile.keep_extension_under) else _PAGE.sub("", base)
    if route == "":
        return "external", v
    return "entry", "/#/" + route + (f"?{query}" if query else "") + (f"#{fragment}" if fragment else "")


def site_relative(path: str, profile) -> str:
    """As links.site_relative."""
    bare = re.sub(r"^(?:\./)+", "", path.lstrip("/"))
    parts = bare.split("/")
    fixed = path == "" or re.match(r"[?#]|//|[A-Za-z][A-Za-z\d+.-]*:", path) or re.search(r"[<>]|://", path)
    if fixed or len(parts) < 2 or ".." in parts or any(p.lower() in profile.content_roots for p in parts):
        return path
    return "/../" + bare


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)

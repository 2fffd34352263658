"""From a page to a Markdown document with directives, and the record of what happened to its nodes.

``convert`` runs the stages in their order: quarantine, tree, sanitize, chrome, broken words, normalize, outline, inventory of
what must survive, tables, blocks, sequence passes, one title, text.  Blocks are (kind, value, props, children); inline
content is Markdown text made on the way.
"""

from __future__ import annotations

import json
import re
import sys
from dataclasses import dataclass, field, replace  # noqa: F401  (replace is for callers)

from quire.functions import decode as D, grids as G, html_tree as H, markdown as M, rewrite as R
from quire.functions.build import downgraded
from quire.functions.profiles import LinkProfile, TargetProfile

STRONG, EMPHASIS, DELETED = frozenset(("b", "strong")), frozenset(("i", "em", "cite", "var", "dfn")), frozenset(("s", "strike", "del"))
DROPPED = R.BEHAVIOUR | R.STYLES | R.PLUGINS | {"head"}
CAPTION = 300
_SPACE, _UNEVEN = re.compile(r"[ \t\r\n\f]+"), re.compile(r"[\t\r\n\f]|  ")
_WRAP = re.compile(r"\s*\\\n\s*")
_ORDINAL = re.compile(r"^([0-9]{1,3})([.)])\s+(.*)$", re.S)
_BULLET = re.compile(r"^([•·▪◦●■–—-])\s+(.*)$", re.S)
_LEADER = re.compile(r"^(.*?)\.{4,}(.*)$", re.S)
_DATE = re.compile(r"^(?:\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}\s+[^\W\d_]+\s+\d{4}(?:\s*г\.?)?)$")
_RULE = re.compile(r"^([*•·=~_—–-])(?:\s*\1){2,}$")
_OPEN, _SHUT = "«“„", "»”"
ICONS = {"mp3": "♪", "midi": "♪", "mid": "♪", "note": "♪", "notes": "♪", "sound": "♪", "audio": "♪", "pdf": "📄", "doc": "📄", "text": "📄", "txt": "📄", "zip": "📦", "download": "⬇", "save": "⬇", "mail": "✉", "email": "✉", "home": "⌂", "back": "←", "left": "←", "prev": "←", "next": "→", "right": "→", "up": "↑", "top": "↑", "down": "↓", "new": "✱", "photo": "📷", "foto": "📷", "video": "▶"}


@dataclass(frozen=True)
class Options:
    """How pages are converted."""

    links: LinkProfile = LinkProfile()
    target: TargetProfile = TargetProfile()
    chrome: frozenset[str] = frozenset()  # shapes of stable chrome
    columns: bool = True  # keep lanes of layout tables as columns, where the target has them
    sections: bool = True  # look for section labels, not for the title alone
    labels: tuple[tuple[str, str], ...] = ()  # vocabulary of column labels: lower-case synonym, house label
    classes: tuple[tuple[int, str], ...] = ()  # classes of tables decided elsewhere, by the table's place in its page


@dataclass
class Block:
    kind: str  # heading, paragraph, list, table, quote, rule, code, image, directive
    text: str = ""
    depth: int = 0
    items: list = field(default_factory=list)
    props: dict = field(default_factory=dict)
    children: list = field(default_factory=list)
    name: str = ""


@dataclass
class Page:
    options: Options = Options()
    ledger: list = field(default_factory=list)  # (node, terminal, note)
    accounted: list = field(default_factory=list)
    identifiers: set = field(default_factory=set)
    length: int = 0  # of the page's text
    align: str | None = None  # of its prose
    depth: int = 0  # tables around what is being lowered
    bounded: int = 0  # columns and frames around it
    targets: dict = field(default_factory=dict)  # a link's address -> where it leads
    paired: int = 0  # tables all of whose rows pair a picture with words
    grids: dict = field(default_factory=dict)  # id of a table -> its grid
    frequency: dict = field(default_factory=dict)  # place of a table -> share of the corpus that has its shape
    lost_tables: int = 0
    records: list = field(default_factory=list)  # (table, class, confidence, tier, plan)

    def note(self, node: H.Node, terminal: str, why: str = "") -> None:
        self.ledger.append((str(node.pre), terminal, why))


def is_block(node: H.Node) -> bool:
    return node.kind == "element" and (node.tag in H.BLOCK or "data-heading" in (node.attrs or {}))


def holds_block(node: H.Node) -> bool:
    for n in H.below(node):
        if n.kind == "element" and (n.tag in H.BLOCK or n.attrs and "data-heading" in n.attrs):
            return True
    return False


# -- inline


def inline(nodes: list[H.Node], page: Page, mark: str = "") -> str:
    out = []
    for node in nodes:
        if node.kind == "text":
            out.append(M.escape(_SPACE.sub(" ", node.value) if _UNEVEN.search(node.value) else node.value))
        elif node.kind == "comment":
            page.note(node, "REMOVED", "comment")
        elif node.tag in DROPPED:
            page.note(node, "REMOVED", "behaviour")
            page.accounted.append(H.text_of(node))
        elif node.tag == "br":
            out.append("\\\n")
        elif node.tag == "img":
            out.append(image_inline(node, page))
        elif node.tag == "a":
            out.append(link(node, page))
        elif node.tag in STRONG:
            out.append(wrap(inline(node.children, page, mark + "b"), "**" if "b" not in mark else ""))
        elif node.tag in EMPHASIS:
            out.append(wrap(inline(node.children, page, mark + "i"), "*" if "i" not in mark else ""))
        elif node.tag in DELETED:
            out.append(wrap(inline(node.children, page, mark), "~~"))
        else:
            out.append(inline(node.children, page, mark))
    return "".join(out)


def wrap(text: str, sign: str) -> str:
    """text between signs; white space and breaks at its edges stay outside."""
    if not sign:
        return text
    body = text.strip(" \n\\") if not text.endswith("\\\\") else text.strip(" \n")
    if not body:
        return text
    at = text.index(body)
    return text[:at] + "\\\n".join(sign + x.strip() + sign if x.strip() else x for x in body.split("\\\n")) + text[at + len(body) :]


def href_of(node: H.Node, page: Page) -> str:
    """Where a link leads in the document; '' for one that leads nowhere safe."""
    raw = (node.attrs or {}).get("href", "")
    if raw not in page.targets:
        kind, href = R.rewrite_target(raw, page.options.links)
        page.targets[raw] = "" if kind in ("empty", "unsafe") else target(href)
    return page.targets[raw]


def link(node: H.Node, page: Page) -> str:
    label = inline(node.children, page)
    href = href_of(node, page)
    body = label.strip(" \n\\")
    if not href or not body:
        return label
    at = label.index(body)
    return label[:at] + f"[{body}]({href})" + label[at + len(body) :]


def target(href: str) -> str:
    """A destination without signs that Markdown would read."""
    return re.sub(r"[\s()<>]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), href)


def decorative(node: H.Node) -> bool:
    a = node.attrs or {}
    src = a.get("src", "").strip()
    size = [int(m[0]) if (m := re.match(r"\d+", a.get(k, ""))) else None for k in ("width", "height")]
    if not src or re.search(r"(?i)(?:^|/)(?:spacer|blank|pixel|line|bullet|dot|bg)\d*\.(?:gif|png|jpe?g)$", src):
        return True
    known = [s for s in size if s is not None]
    badge = 400 if not a.get("alt", "").strip() else 196  # a sign without a name may be larger
    return bool(known) and (min(known) <= 3 or len(known) == 2 and known[0] * known[1] <= badge)


def icon(node: H.Node) -> str | None:
    """The glyph of a small picture whose file is named for what it stands for."""
    stem = re.search(r"([A-Za-z]+)[\d_-]*\.\w+$", (node.attrs or {}).get("src", ""))
    size = [s for k in ("width", "height") if (s := R.pixels(node, k)) is not None]
    return ICONS.get(stem[1].lower()) if stem and size and max(size) <= 32 else None


def src_of(node: H.Node, page: Page) -> str:
    """Where a picture is, seen from the document."""
    return target(R.site_relative(node.attrs["src"].strip(), page.options.links))


def image_inline(node: H.Node, page: Page) -> str:
    if (glyph := icon(node)) and node.parent is not None and (node.parent.tag == "a" or H.text_of(node.parent)):
        page.note(node, "MERGED_INTO", "icon")
        return glyph
    if decorative(node):
        page.note(node, "REMOVED", "decorative")
        return ""
    return f"![{M.escape(_SPACE.sub(' ', (node.attrs or {}).get('alt', '').strip()))}]({src_of(node, page)})"


# -- blocks


def blocks_of(nodes: list[H.Node], page: Page, align: str | None = None) -> list[Block]:
    out: list[Block] = []
    run: list[H.Node] = []

    def flush() -> None:
        if run:
            out.extend(phrasing(run, page))
            run.clear()

    for node in nodes:
        if node.kind == "element" and (is_block(node) or node.tag not in DROPPED and holds_block(node)):
            flush()
            out.extend(lower(node, page))
        else:
            run.append(node)
    flush()
    return passes(out, page)


def lower(node: H.Node, page: Page) -> list[Block]:
    tag, attrs = node.tag, node.attrs or {}
    out = anchors(node, page)
    if tag in H.HEADINGS or "data-heading" in attrs:
        depth = int(tag[1]) if tag in H.HEADINGS else int(attrs["data-heading"])
        text = unwrapped(inline(node.children, page)).strip()
        if not text and any(n.tag == "img" for n in H.walk(node)):
            return out + [b for n in node.children for b in figure(n, page)]
        page.note(node, "EMITTED", f"heading-{depth}")
        if tag not in H.HEADINGS:
            text = R.strip_glyphs(re.sub(r"^\*\*(.*)\*\*$", r"\1", text) if text.count("**") == 2 else text)
        return out + ([Block("heading", text, depth)] if text else [])
    if tag in ("ul", "ol", "dir", "menu"):
        return out + lists(node, page)
    if tag == "hr":
        return out + [Block("rule")]
    if tag == "blockquote":
        inner = blocks_of(node.children, page)
        return out + ([Block("quote", children=inner)] if inner else [])
    if tag == "pre":
        return out + [Block("code", preformatted("".join("\n" if n.tag == "br" else n.value or "" for n in H.walk(node) if n.kind == "text" or n.tag == "br")))]
    if tag == "table":
        return out + table(node, page)
    if tag == "nav":
        return out + menu(node, page)
    if tag == "dl":
        items = [Block("paragraph", (f"**{t}**" if c.tag == "dt" else t)) for c in node.children if c.tag in ("dt", "dd") and (t := inline(c.children, page).strip())]
        return out + items
    frame = R.frame_evidence(node, page.length) if tag in ("div", "p", "td") and not page.bounded else None
    if frame:
        page.bounded += 1
        inner = blocks_of(node.children, page)
        page.bounded -= 1
        page.note(node, "EMITTED", f"frame: {frame[1]}")
        return out + ([Block("directive", name="frame", props={"frame": frame[0]}, children=inner)] if inner else [])
    inner = blocks_of(node.children, page)
    side = R.fold_align((attrs.get("align") or attrs.get("data-align") or (m[1] if (m := re.search(r"text-align\s*:\s*([\w-]+)", attrs.get("style", ""), re.I)) else "") or ("center" if tag == "center" else "")).lower())
    if side in ("center", "right") and R.distinctive(side, page.align) and inner and all(b.kind in ("paragraph", "image") for b in inner) and not page.bounded:
        if all(b.kind == "image" for b in inner):
            for b in inner:
                b.props.setdefault("position", side)
            return out + inner
        return out + [Block("directive", name="align", props={"position": side}, children=inner)]
    return out + inner


def anchors(node: H.Node, page: Page) -> list[Block]:
    found = []
    for n in [node, *([c for c in node.children if c.tag == "a"] if node.tag in ("p", "div", "td") or node.tag in H.HEADINGS else [])]:
        ident = ((n.attrs or {}).get("id") or ((n.attrs or {}).get("name") if n.tag == "a" else "") or "").strip()
        if ident and re.fullmatch(r"[\w.:-]+", ident) and ident not in page.identifiers and n.tag == "a":
            page.identifiers.add(ident)
            found.append(Block("directive", name="anchor", props={"id": ident}))
    return found


def preformatted(text: str) -> str:
    """Tabs expanded, common indent off, blank runs collapsed."""
    lines = [line.expandtabs(8).rstrip() for line in text.strip("\n").split("\n")]
    indent = min((len(x) - len(x.lstrip()) for x in lines if x), default=0)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x[indent:] for x in lines))


def phrasing(run: list[H.Node], page: Page) -> list[Block]:
    held = {n.tag for n in run}
    links = 0
    for n in run:
        if n.children:
            inner = [x.tag for x in H.below(n)]
            held.update(inner)
            links += inner.count("a")
        links += n.tag == "a"
    if "img" in held and not any(H.text_of(n) for n in run if n.kind == "text" or n.kind == "element" and n.tag not in DROPPED):
        return gallery([b for n in run for b in figure(n, page)])
    made = menu_of_run(run, page) if links >= 2 else None
    if made:
        return made
    out: list[Block] = []
    for n in run:
        out += anchors(n, page) if n.kind == "element" and n.tag == "a" else []
    text = inline(run, page)
    if "\\\n" not in text and not text.rstrip().endswith("\\"):
        return out + (lined([text.strip()]) if text.strip() else [])
    groups = [g.strip() for g in re.split(r"(?:\\\n\s*){2,}", text)]
    for group in groups:
        group = re.sub(r"(?<!\\)((?:\\\\)*)\\$", r"\1", group)  # a break at the end breaks nothing
        lines = [x.strip() for x in group.split("\\\n") if x.strip()]
        if lines:
            out += lined(lines)
    return out


def lined(lines: list[str]) -> list[Block]:
    """Lines of one group: numbered items, dot leaders, a drawn rule, else a paragraph in which wraps are joined."""
    if len(lines) >= 3:
        ordinal = [_ORDINAL.match(x) for x in lines]
        if all(ordinal) and all(int(a[1]) < int(b[1]) for a, b in zip(ordinal, ordinal[1:])):
            if any(m[1][0] == "0" for m in ordinal):  # 01, 02: as written, since a list would count 1, 2
                return [Block("list", name="bullet", items=[(0, f"{m[1]}\\. {m[3].strip()}") for m in ordinal], depth=1)]
            return [Block("list", name="ordered", items=[(0, m[3].strip()) for m in ordinal], depth=int(ordinal[0][1]), props={"numbers": [m[1] for m in ordinal]})]
        leader = [_LEADER.match(x) for x in lines]
        if all(leader):
            return [Block("table", items=[["", ""], *([m[1].strip(), m[2].strip()] for m in leader)])]
    if len(lines) >= 4 and lines[0].endswith(":") and all(len(x) <= 80 and x[-1] in ";,." for x in lines[1:]) and all(x[-1] in ";," for x in lines[1:-1]):
        return [Block("paragraph", lines[0]), Block("list", name="bullet", items=[(0, x) for x in lines[1:]], depth=1)]
    if len(lines) == 1 and _RULE.match(lines[0].replace("\\", "")):
        return [Block("rule")]
    if len(lines) == 1:
        return [Block("paragraph", lines[0])]
    joined = [lines[0]]
    for line in lines[1:]:
        before = joined[-1]
        if len(before) >= 60 and not re.search(r"[.!?…:;»”\")]\s*$", before) and (re.search(r"[,–—-]\s*$", before) or re.match(r"[^\W\d_]", line) and line[0].islower()):
            joined[-1] = before + " " + line
        else:
            joined.append(line)
    return [Block("paragraph", "\\\n".join(joined))]


def figure(node: H.Node, page: Page) -> list[Block]:
    out = []
    for img in [node] if node.tag == "img" else [n for n in H.walk(node) if n.tag == "img"]:
        if decorative(img):
            page.note(img, "REMOVED", "decorative")
            continue
        a = img.attrs
        width = int(m[0]) if (m := re.match(r"\d+", a.get("width", ""))) else None
        props = {"src": src_of(img, page), "position": {"left": "left", "right": "right"}.get(a.get("align", "").lower(), "center"), "size": "medium" if width is None else "large" if width >= 380 else "medium" if width >= 190 else "small"}
        alt = a.get("alt", "").strip()
        if alt and len(alt) <= CAPTION and not re.search(r"(?i)\.(?:bmp|gif|jpg|jpeg|png)$", alt):
            props["caption"] = _SPACE.sub(" ", alt)
        up = img.parent
        if up is not None and up.tag == "a" and (href := href_of(up, page)):
            props["link"] = href
        if (height := R.pixels(img, "height")) is not None:
            props["height"] = height
        out.append(Block("image", props=props))
    return out


def menu_of_run(run: list[H.Node], page: Page) -> list[Block] | None:
    """Three short items and more in a line, set apart by signs or spaces: links to distinct targets, and at most one that is no link, the place where one is."""
    items: list[H.Node | str] = []
    stack = list(reversed(run))
    while stack:
        node = stack.pop()
        if node.kind == "text":
            items += [x for x in (p.strip() for p in re.split(r"[|•·/\[\]\u00a0]|\s{2,}", node.value)) if x]
        elif node.tag == "a" and href_of(node, page):
            items.append(node)
        elif node.tag in ("img", "a") or node.tag in DROPPED:
            return None
        else:
            stack.extend(reversed(node.children))
    links = [x for x in items if isinstance(x, H.Node)]
    plain = [x for x in items if isinstance(x, str)]
    if page.bounded or len(items) < 3 or len(links) < 2 or len(plain) > 1 or any(n.tag == "img" for a in links for n in H.walk(a)):
        return None
    labels = [x if isinstance(x, str) else H.text_of(x) for x in items]
    if not all(0 < len(x) <= 40 for x in labels) or len(set(labels)) < len(labels) or len({href_of(a, page) for a in links}) < len(links) or any(x[-1] in ".,;:" for x in plain):
        return None
    active = {"active": plain[0]} if plain else {}
    listed = [(0, M.escape(x) if isinstance(x, str) else link(x, page).strip()) for x in items]
    return [Block("directive", name="nav", props=active, children=[Block("list", name="bullet", items=listed, depth=1)])]


def gallery(images: list[Block]) -> list[Block]:
    """Two pictures and more in a row, of similar height, are one group of two to four columns."""
    heights = [b.props["height"] for b in images if "height" in b.props]
    for b in images:
        b.props.pop("height", None)
    alike = len(heights) < 2 or max(heights) <= 2.5 * max(1, min(heights))
    if len(images) < 2 or not alike or any(b.kind != "image" for b in images):
        return images
    inner = [Block("image", props={k: v for k, v in b.props.items() if k not in ("position", "size")}) for b in images]
    return [Block("directive", name="images", props={"columns": min(4, max(2, len(inner)))}, children=inner)]


def lists(node: H.Node, page: Page, depth: int = 0) -> list[Block]:
    items: list[tuple[int, str]] = []
    for child in node.children:
        if child.tag in ("ul", "ol"):
            items += [(d, t) for b in lists(child, page, depth + 1) for d, t in b.items]
            continue
        if child.kind != "element":
            continue
        inner = [c for c in child.children if c.tag not in ("ul", "ol")]
        if any(is_block(c) for c in inner):
            text = " ".join(b.text for b in blocks_of(inner, page) if b.text)
        else:
            text = inline(inner, page)
        text = unwrapped(text).strip()
        if text:
            items.append((depth, text))
        for c in child.children:
            if c.tag in ("ul", "ol"):
                items += [(d, t) for b in lists(c, page, depth + 1) for d, t in b.items]
    return [Block("list", name="ordered" if node.tag == "ol" else "bullet", items=items, depth=1)] if items else []


def menu(node: H.Node, page: Page) -> list[Block]:
    """A navigation directive: two links and more to distinct targets; else what is in it."""
    links = [n for n in H.walk(node) if n.tag == "a" and href_of(n, page) and H.text_of(n)]
    if len({href_of(n, page) for n in links}) >= 2 and len("".join(H.text_of(n) for n in links)) >= 0.6 * len(H.text_of(node).replace(" ", "")):
        listed = Block("list", name="bullet", items=[(0, link(n, page)) for n in links], depth=1)
        rest = [n for n in H.walk(node) if n.kind == "text" and n.value.strip() and not any(up.tag == "a" for up in _up(n))]
        return [Block("directive", name="nav", children=[listed]), *[Block("paragraph", M.escape(n.value.strip())) for n in rest]]
    return blocks_of(node.children, page)


def _up(node: H.Node):
    while node.parent is not None:
        node = node.parent
        yield node


def table(node: H.Node, page: Page) -> list[Block]:
    """A menu, a figure with its caption, a record matrix, columns, a frame, or cells in reading order: what the grid shows."""
    grid = page.grids.get(id(node)) or G.place(node)
    captions = [Block("paragraph", t) for c in node.children if c.tag == "caption" and (t := inline(c.children, page).strip())]
    loose = [Block("paragraph", M.escape(c.value.strip())) for c in node.children if c.kind == "text" and c.value.strip()]
    page.depth += 1
    out = menu_of_grid(grid, page) or figure_of_grid(grid, page)
    if out is None:
        kind, sure, tier = G.classify(G.features(grid, page.frequency.get(grid.seq, 0.0)), page.paired - (G.picture_paired(grid) == 1))
        kind = dict(page.options.classes).get(grid.seq, kind)
        plan = None
        if kind in ("DATA", "HYBRID"):
            out, plan = data_region(grid, page, kind)
        if out is None:
            out = layout(grid, page) or decomposed(grid, page)
        page.records.append((grid.seq, kind, sure, tier, plan))
    page.depth -= 1
    return captions + out + loose


def menu_of_grid(grid: G.Grid, page: Page) -> list[Block] | None:
    """Three rows and more of one link each, to distinct targets, in one column: a menu."""
    rows = [row for row in grid.rows().values() if not all(c.is_empty for c in row)]
    links = [[n for n in H.walk(c.node) if n.tag == "a" and href_of(n, page)] for row in rows for c in row if not c.is_empty]
    if grid.nested or len(rows) < 3 or any(len(row) != 1 for row in rows) or any(len(x) != 1 for x in links):
        return None
    only = [x[0] for x in links]
    whole = all(H.text_of(a) == c.text and len(c.text) <= 40 for a, c in zip(only, (c for row in rows for c in row)))
    if not whole or len({href_of(a, page) for a in only}) < len(only) or page.bounded:
        return None
    page.note(grid.table, "EMITTED", "nav")
    return [Block("directive", name="nav", children=[Block("list", name="bullet", items=[(0, link(a, page).strip()) for a in only], depth=1)])]


def figure_of_grid(grid: G.Grid, page: Page) -> list[Block] | None:
    """A picture over, under or beside a short text: an image with its caption."""
    filled = [c for c in grid.cells if not c.is_empty]
    if len(filled) != 2 or grid.nested or {c.kind for c in filled} & {"image"} == set():
        return None
    picture, words = sorted(filled, key=lambda c: c.kind != "image")
    if words.images or picture.images != 1 or not 0 < len(words.text) <= CAPTION or words.links or not words.inlineable or any(H.HEADINGS & {n.tag} or "data-heading" in (n.attrs or {}) for n in [words.node, *H.walk(words.node)]):
        return None
    made = figure(next(n for n in H.walk(picture.node) if n.tag == "img"), page)
    if len(made) != 1 or "caption" in made[0].props and made[0].props["caption"] != words.text:
        return None
    made[0].props.pop("height", None)
    made[0].props["caption"] = words.text
    page.note(grid.table, "EMITTED", "figure")
    return made


def data_region(grid: G.Grid, page: Page, kind: str) -> tuple[list[Block] | None, str]:
    """(blocks, what the plan came to); no blocks where the table isn't a record matrix."""
    title = G.leading_caption(grid)
    below = 1 if title is not None else 0
    plan = G.plan(grid, below=below)
    if plan.failure == "too-small" and not page.bounded and (record := single_record(grid)):
        head = ["🔗" if c.links == 1 and len(c.text) < 40 else "" for c in record]
        page.note(grid.table, "EMITTED", "table")
        return [Block("table", items=[head, [unwrapped(inline(c.node.children, page)).strip() for c in record]])], "table"
    if plan.failure is not None or page.bounded:
        if kind == "DATA":
            page.lost_tables += plan.failure not in (None, "too-small", "no-body", "media-lane", "media-catalog")
            page.note(grid.table, "REVIEW", f"data table taken apart: {plan.failure or 'inside columns'}")
        return None, plan.failure or "inside columns"
    bands = plan.occupied()
    if not plan.header and len(bands) < 3 and not any(x["links"] for x in plan.matrix.values()):
        return None, "two lanes"  # nothing says that these are records
    rows = sorted({r for r, _ in plan.matrix})
    cell = lambda r, b: " ".join(filter(None, (unwrapped(inline(c.node.children, page)).strip() for c in sorted(plan.matrix[r, b]["cells"], key=lambda c: c.col)))) if (r, b) in plan.matrix else ""
    matrix = [[cell(r, b) for b in bands] for r in rows]
    head = matrix.pop(0) if plan.header else [G.synthesized_header(plan, dict(page.options.labels)).get(b, "") for b in bands]
    if not plan.header:  # a label that stands for a whole column isn't repeated as a fact of its own
        head = ["🔗" if h == "🔗" else dict(page.options.labels).get(h.lower(), "") for h in head]
    page.note(grid.table, "EMITTED", "table")
    above = [Block("paragraph", t)] if title is not None and (t := inline(title.node.children, page).strip()) else []
    return above + [Block("table", items=[head, *matrix])], "table"


def single_record(grid: G.Grid) -> list[G.Cell]:
    """The cells of a table of one row that names something and leads to it: a text without links, and cells of one short link each beside it."""
    filled = [c for c in grid.live() if not c.is_empty]
    lone = [c for c in filled if c.links == 1 and len(c.text) < 40 and not c.images]
    if len({c.row for c in filled}) != 1 or not 2 <= len(filled) <= 8 or not lone or filled[0].links or any(c.images or not c.inlineable or len(c.text) > 180 for c in filled):
        return []
    return filled


def rails(grid: G.Grid) -> set[int]:
    """The flanks of a page in three columns whose centre holds the most text, each at most half of it."""
    if grid.n_cols != 3:
        return set()
    size = [sum(len(c.text) for c in grid.cells if c.col == x) for x in range(3)]
    return {0, 2} if size[1] and max(size[0], size[2]) <= 0.5 * size[1] else set()


def lane_columns(grid: G.Grid) -> set[int]:
    """Columns that are filled at least half as often as the busiest one."""
    busy = [sum(not c.is_empty for c in grid.cells if c.col == x) for x in range(grid.n_cols)]
    return {x for x, n in enumerate(busy) if n and n >= 0.5 * max(busy)}


def row_bands(grid: G.Grid) -> list[list[int]]:
    """Rows tied to one another by cells that span them."""
    ends, out = {}, []
    for c in grid.cells:
        ends[c.row] = max(ends.get(c.row, c.row), c.row + c.row_span - 1)
    end = -1
    for r in range(grid.n_rows):
        if r > end:
            out.append([])
        out[-1].append(r)
        end = max(end, ends.get(r, r))
    return out


def bare_links(grid: G.Grid) -> bool:
    """One row of nothing but single links: a pager."""
    rows = [row for row in grid.rows().values() if not all(c.is_empty for c in row)]
    return len(rows) == 1 and len(rows[0]) >= 2 and all(c.kind == "link" and c.links == 1 for c in rows[0] if not c.is_empty)


_BOUNDED = ("paragraph", "image", "list", "quote")


def layout(grid: G.Grid, page: Page) -> list[Block] | None:
    """Two or three lanes side by side become columns, band by band, where every lane holds plain blocks; none elsewhere."""
    most = 4 if bare_links(grid) else 3
    if not page.options.columns or page.bounded or grid.nested or not 2 <= grid.n_cols <= most or rails(grid):
        return None
    lanes = lane_columns(grid)
    if len(lanes) < 2:
        return None
    saved = len(page.ledger), len(page.accounted), set(page.identifiers)
    page.bounded += 1
    out: list[Block] = []
    for band in row_bands(grid):
        held: dict[int, list[Block]] = {}
        menus: list[Block] = []
        for c in grid.cells:
            if c.row in band and not c.is_empty:
                for b in blocks_of(c.node.children, page):
                    (menus if b.kind == "directive" and b.name == "nav" else held.setdefault(c.col, [])).append(b)
        columns = [Block("directive", name="column", children=blocks) for x, blocks in sorted(held.items()) if blocks]
        if len(columns) >= 2 and all(b.kind in _BOUNDED for c in columns for b in c.children):
            out.append(Block("directive", name="columns", children=columns))
        else:
            out += [b for c in columns for b in c.children]
        out += menus
    page.bounded -= 1
    if any(b.kind == "directive" and b.name == "columns" for b in out):
        page.note(grid.table, "EMITTED", "columns")
        return out
    del page.ledger[saved[0] :], page.accounted[saved[1] :]
    page.identifiers = saved[2]
    return None


def decomposed(grid: G.Grid, page: Page) -> list[Block]:
    """Cells in reading order; a rule where empty rows, two and more of them, part the others."""
    page.note(grid.table, "MERGED_INTO", "decomposed")
    frame = R.frame_evidence(grid.table, page.length) if not page.bounded else None
    page.bounded += frame is not None
    rows = grid.rows()
    inner = sorted(r for r in range(grid.n_rows) if rows.get(r) and all(c.is_empty for c in rows[r]) and 0 < r < grid.n_rows - 1 - grid.trailing)
    out: list[Block] = []
    for r in range(grid.n_rows):
        if r in inner and len(inner) >= 2 and out and out[-1].kind != "rule":
            out.append(Block("rule"))
        for c in rows.get(r, ()):
            if not c.is_empty:
                own = R.frame_evidence(c.node, page.length) if frame is None and not page.bounded else None
                page.bounded += own is not None
                blocks = blocks_of(c.node.children, page) if "data-heading" not in (c.node.attrs or {}) else lower(c.node, page)
                page.bounded -= own is not None
                out += [Block("directive", name="frame", props={"frame": own[0]}, children=blocks)] if own and blocks else blocks
    page.bounded -= frame is not None
    while out and out[-1].kind == "rule":
        out.pop()
    return [Block("directive", name="frame", props={"frame": frame[0]}, children=out)] if frame and out else out


# -- sequence passes


def passes(blocks: list[Block], page: Page | None = None) -> list[Block]:
    if len(blocks) < 2:  # nothing before or after
        return highlighted(blocks)
    page = page or Page()
    out = sections_after_rules(labels_before_lists(dates(continued(blocks)), page), page)
    return highlighted(captions(aligned(subordinated(quotations(bulleted(out))))))


def bare(text: str) -> str:
    """Inline Markdown as a reader sees it."""
    return re.sub(r"\\(.)", r"\1", re.sub(r"(?<!\\)[*~`]|==", "", text)).strip()


def highlighted(blocks: list[Block], least: int = 64) -> list[Block]:
    """A long quotation inside a paragraph that holds a whole sentence is marked."""
    def mark(m: re.Match) -> str:
        inner = m[0][1:-1]
        return f"=={m[0]}==" if len(inner) > least and re.search(r"[.!?…]", inner) and "](" not in inner and "*" not in inner and "==" not in inner else m[0]

    for b in blocks:
        if b.kind == "paragraph" and ("«" in b.text or "“" in b.text) and not re.fullmatch(r"[«“][^«»“”]*[»”][.,]?", b.text.strip()):
            b.text = re.sub(r"[«“][^«»“”\n]*[»”]", mark, b.text)
    return blocks


def continued(blocks: list[Block]) -> list[Block]:
    """A paragraph that goes on with the next number joins the list before it."""
    out: list[Block] = []
    for b in blocks:
        last = out[-1] if out else None
        m = _ORDINAL.match(b.text) if b.kind == "paragraph" else None
        if m and last is not None and last.kind == "list" and last.name == "ordered" and int(m[1]) == (last.depth or 1) + sum(d == 0 for d, _ in last.items):
            last.items.append((0, unwrapped(m[3]).strip()))
            last.props.setdefault("numbers", []).append(m[1])
        else:
            out.append(b)
    return out


def labels_before_lists(blocks: list[Block], page: Page) -> list[Block]:
    """Short labels before lists become headings: all of them if there are two and more, else one that is shouted or bold."""
    if page.depth >= 2 or page.bounded:
        return blocks
    found, alone = [], []
    for i, (b, after) in enumerate(zip(blocks, blocks[1:])):
        if b.kind != "paragraph" or after.kind != "list":
            continue
        text = bare(b.text)
        name = text.rstrip(": ")
        if b.kind != "paragraph" or after.kind != "list" or "](" in b.text or "\n" in b.text or not 4 <= len(name) <= 60 or len(name.split()) > 8 or re.search(r"[.!?]", name):
            continue
        found.append(i)
        letters = [c for c in name if c.isalpha()]
        if text == name and (len(letters) >= 3 and name.upper() == name and name.lower() != name or re.fullmatch(r"\*\*[^*]+\*\*", b.text.strip())):
            alone.append(i)
    for i in found if len(found) >= 2 else alone:
        blocks[i] = Block("heading", re.sub(r"[:\s]+(\**)$", r"\1", blocks[i].text).strip("*"), 3 if len(found) >= 2 else 2)
    return blocks


def sections_after_rules(blocks: list[Block], page: Page) -> list[Block]:
    """A short label between a rule and 200 characters and more of content is a section."""
    if page.depth >= 2 or page.bounded:
        return blocks
    sizes = [size_of(b) for b in blocks]
    for i in range(1, len(blocks) - 1):
        b = blocks[i]
        if blocks[i - 1].kind == "rule" and b.kind == "paragraph" and "](" not in b.text and "\n" not in b.text and 6 <= len(text := bare(b.text)) <= 90 and len(text.split()) <= 12:
            if not re.search(r"[.!?]\s", text) and text[-1] not in ",;" and sum(sizes[i + 1 :]) >= 200:
                blocks[i] = Block("heading", b.text.strip("*"), 2)
    return blocks


def size_of(b: Block) -> int:
    return len(b.text) + sum(len(t) for row in b.items for t in (row if isinstance(row, list) else row[1:])) + sum(map(size_of, b.children))


def quotations(blocks: list[Block]) -> list[Block]:
    """A quotation that opens at the start of one paragraph and closes at the end of a later one is a block quotation."""
    out: list[Block] = []
    i = 0
    while i < len(blocks):
        j = i
        if blocks[i].kind == "paragraph" and any(c in blocks[i].text for c in _OPEN) and bare(blocks[i].text)[:1] in tuple(_OPEN):
            depth = 0
            while j < len(blocks) and blocks[j].kind == "paragraph" and j - i < 12:
                depth += sum(blocks[j].text.count(c) for c in _OPEN) - sum(blocks[j].text.count(c) for c in _SHUT)
                if depth <= 0:
                    break
                j += 1
            else:
                j = i
            if j > i and depth == 0 and bare(blocks[j].text).rstrip(".,")[-1:] in tuple(_SHUT):
                out.append(Block("quote", children=blocks[i : j + 1]))
                i = j + 1
                continue
        out.append(blocks[i])
        i += 1
    return out


def subordinated(blocks: list[Block]) -> list[Block]:
    """Paragraphs set wholly in italics are quotations, if that recurs and most of the prose is upright."""
    italic = [b.kind == "paragraph" and len(b.text) >= 60 and re.fullmatch(r"\*(?!\*)[^*]+(?<!\*)\*", b.text.strip()) is not None for b in blocks]
    prose = sum(b.kind == "paragraph" and len(b.text) >= 60 for b in blocks)
    if sum(italic) < 2 or sum(italic) * 2 >= prose:
        return blocks
    out: list[Block] = []
    for i, b in enumerate(blocks):
        if italic[i] and not (out and out[-1].kind == "image"):
            inner = Block("paragraph", b.text.strip().strip("*"))
            if i and italic[i - 1] and out and out[-1].kind == "quote":
                out[-1].children.append(inner)
            else:
                out.append(Block("quote", children=[inner]))
        else:
            out.append(b)
    return out


def bulleted(blocks: list[Block]) -> list[Block]:
    """Two paragraphs and more in a row with the same opening mark become a list."""
    out: list[Block] = []
    i = 0
    while i < len(blocks):
        j, mark, items = i, None, []
        while j < len(blocks) and blocks[j].kind == "paragraph" and (m := _BULLET.match(blocks[j].text)) and mark in (None, m[1]):
            mark = m[1]
            items.append((0, unwrapped(m[2])))
            j += 1
        if len(items) >= 2:
            out.append(Block("list", name="bullet", items=items, depth=1))
            i = j
        else:
            out.append(blocks[i])
            i += 1
    return out


def dates(blocks: list[Block]) -> list[Block]:
    """Two date labels and more, each before content, become headings."""
    hits = [i for i, b in enumerate(blocks) if b.kind == "paragraph" and _DATE.match(b.text.strip("*")) and i + 1 < len(blocks)]
    if len(hits) >= 2:
        for i in hits:
            blocks[i] = Block("heading", blocks[i].text.strip("*"), 3)
    return blocks


def aligned(blocks: list[Block]) -> list[Block]:
    """Neighbouring alignments of one side are one."""
    out: list[Block] = []
    for b in blocks:
        if out and b.kind == "directive" and b.name == "align" and out[-1].kind == "directive" and out[-1].name == "align" and out[-1].props == b.props:
            out[-1].children += b.children
        else:
            out.append(b)
    return out


def captions(blocks: list[Block]) -> list[Block]:
    """An image without a caption takes the short emphasised paragraph after it."""
    out: list[Block] = []
    for b in blocks:
        m = re.fullmatch(r"\*([^*]+)\*", b.text) if b.kind == "paragraph" else None
        if m and len(m[1]) <= CAPTION and out and out[-1].kind == "image" and "caption" not in out[-1].props and "](" not in m[1]:
            out[-1].props["caption"] = re.sub(r"\\(.)", r"\1", m[1])
        else:
            out.append(b)
    return out


def single_title(blocks: list[Block], title: str | None) -> list[Block]:
    """One h1: the first one, else the first heading, else the page's title; no level is skipped."""
    heads = [b for b in blocks if b.kind == "heading"]
    if not heads:
        return ([Block("heading", M.escape(title), 1)] if title else []) + blocks
    for b, depth in zip(heads, levels([b.depth for b in heads])):
        b.depth = depth
    return blocks


def levels(given: list[int]) -> list[int]:
    """Heading levels with one title and none skipped.

    A skipped level is lifted as a whole: its later headings follow the first, until a higher one shows that the level has its parent.
    """
    first = given.index(1) if 1 in given else None
    depths = [1 if i == (first or 0) and (first is not None or i == 0) else max(2, d) for i, d in enumerate(given)]
    out: list[int] = []
    lifted: dict[int, int] = {}
    before = 1
    for d in depths:
        if d in lifted:
            before = lifted[d]
        elif d > before + 1:
            before = lifted[d] = before + 1
        else:
            lifted = {k: v for k, v in lifted.items() if k <= d}
            before = d
        out.append(before)
    return out


# -- writing


_READ_AS_BLOCK = re.compile(r":|#{1,6}\s|[-+]\s|>|\d+[.)]\s")


def unwrapped(text: str) -> str:
    """text in one line: its breaks are spaces."""
    return _WRAP.sub(" ", text) if "\\\n" in text else text


def serialize(blocks: list[Block]) -> str:
    return M.normalize_output("\n\n".join(filter(None, map(_write, blocks))))


def _write(b: Block) -> str:
    if b.kind == "heading":
        return "#" * min(6, b.depth) + " " + unwrapped(b.text)
    if b.kind == "paragraph":
        return "\n".join([("\\" + x if _READ_AS_BLOCK.match(x) else x) for x in b.text.split("\n")])
    if b.kind == "rule":
        return "---"
    if b.kind == "code":
        return "```\n" + b.text + "\n```"
    if b.kind == "quote":
        return "\n".join("> " + x if x else ">" for x in serialize(b.children).rstrip("\n").split("\n"))
    if b.kind == "list":
        counts: dict[int, int] = {}
        lines = []
        for depth, text in b.items:
            counts = {d: n for d, n in counts.items() if d <= depth}
            counts[depth] = counts.get(depth, (b.depth or 1) - 1 if depth == 0 else 0) + 1
            lines.append("  " * depth + (f"{counts[depth]}. " if b.name == "ordered" else "- ") + text)
        return "\n".join(lines)
    if b.kind == "table":
        rows = ["| " + " | ".join(c or "" for c in row) + " |" for row in b.items]
        return "\n".join([rows[0], "|" + " --- |" * len(b.items[0]), *rows[1:]])
    if b.kind == "image":
        return _fence("image", b.props, "")
    if b.name == "anchor":
        return f"::anchor{{#{b.props['id']}}}"
    return _fence(b.name, b.props, serialize(b.children).rstrip("\n"))


def _fence(name: str, props: dict, body: str) -> str:
    head = "".join(f"\n{k}: {v}" for k, v in props.items())
    return f"::: {name}{head}\n" + (f"\n{body}\n" if body else "") + ":::"


def convert(html: str | None, options: Options = Options(), known: R.Lookup | None = None, fingerprint=None, invisible: frozenset[int] = frozenset(), frequency: dict[str, float] | None = None, trace: list | None = None) -> dict:
    """A page as a document: markdown, and source_text, accounted (removed text), links and images of the source, for the gate; the ledger and the tables.

    known: what is known of words, to join broken ones.  fingerprint: shape of a subtree, with options.chrome.
    invisible: nodes (pre) that a measurement found invisible.  frequency: how much of the corpus has a shape, for tables.  trace: takes
    (stage, what it left) for each stage.  Null counts as empty.
    """
    clean, found = D.islands(html or "")
    keep = (lambda stage, content: trace.append((stage, content() if callable(content) else content))) if trace is not None else lambda stage, content: None
    keep("00-source", html or "")
    keep("01-quarantined", clean)
    root = H.numbered(H.build(clean)[0])
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * H.depth_of(root) + 1000))
    title = next((H.text_of(n) for n in H.walk(root) if n.tag == "title"), None)
    records = [*R.sanitize(root), *R.drop_head(root)]
    keep("02-sanitized", lambda: H.to_html(root))
    if options.chrome and fingerprint is not None:
        from quire.operators.pages import FINGERPRINT_TAGS

        records += R.remove_chrome(root, options.chrome, fingerprint, frozenset(FINGERPRINT_TAGS))
    keep("03-without-chrome", lambda: H.to_html(root))
    records += R.dehyphenate(root, known or R.Lookup({}))
    keep("04-words-joined", lambda: H.to_html(root))
    records += R.normalize(root, invisible)
    tags = H.frozen(root).tree.tags
    records += R.recover_headings(root, options.sections)
    keep("05-normalized", lambda: H.to_html(root))
    page = Page(options)
    terminal = {"remove": "REMOVED", "unwrap": "MERGED_INTO", "review": "REVIEW", "heading": "EMITTED"}
    page.ledger = [(f"island:{x['start']}", "REMOVED", f"{x['kind']} markup") for x in found if x["kind"] != "xml" and not x["unterminated"]]
    page.ledger += [(str(r.pre), terminal[r.action], r.reason) for r in records if r.action in terminal]
    body = next((n for n in H.walk(root) if n.tag == "body"), root)
    source = H.text_of(body)
    page.length, page.align = len(source), R.prose_align(body)
    shown = lambda n: H.text_of(n) or any(x.tag == "img" for x in H.below(n))
    links = [href for n in H.below(body) if n.tag == "a" and (href := href_of(n, page)) and shown(n) and not _only_decoration(n)] if "a" in tags else []
    images = [src_of(n, page) for n in H.below(body) if n.tag == "img" and not decorative(n) and not (icon(n) and n.parent is not None and (n.parent.tag == "a" or H.text_of(n.parent)))] if "img" in tags else []
    grids = G.grids(body) if "table" in tags else []
    page.grids = {id(g.table): g for g in grids}
    page.frequency = {g.seq: frequency.get(fingerprint(g.table), 0.0) for g in grids} if frequency and fingerprint is not None else {}
    page.paired = sum(G.picture_paired(g) == 1 for g in grids)
    blocks, lost = downgraded(single_title(blocks_of(body.children, page), title), options.target)
    page.ledger += [("document", "MERGED_INTO", f"{what}: {how}") for what, how in lost]
    page.accounted += _numbers(blocks)
    tables = [{"seq": seq, "class": kind, "confidence": sure, "tier": tier, "plan": plan} for seq, kind, sure, tier, plan in page.records]
    markdown = serialize(blocks)
    keep("06-tables", lambda: json.dumps(tables, ensure_ascii=False))
    keep("07-document", markdown)
    keep("08-ledger", lambda: json.dumps(page.ledger, ensure_ascii=False))
    H.released(root)
    return {"markdown": markdown, "source_text": source, "accounted": " ".join(filter(None, page.accounted)), "ledger": page.ledger, "links": links, "images": images, "tables": tables, "lost_tables": page.lost_tables}


def _numbers(blocks: list[Block]) -> list[str]:
    """Numbers of the source that the markers of lists stand for now."""
    return [n for b in blocks for n in [*b.props.get("numbers", ()), *_numbers(b.children)]]


def _only_decoration(node: H.Node) -> bool:
    """Whether a link holds nothing that comes out: no words, no icon, and pictures that are left out."""
    if H.text_of(node):
        return False
    pictures = [n for n in H.walk(node) if n.tag == "img"]
    return bool(pictures) and all(decorative(n) and not icon(n) for n in pictures)

"""Tolerant HTML tree construction, without dependencies.

One regular expression finds the tags; a stack machine builds the tree: implied html, head, body,
tbody and tr, automatic closing, active formatting elements that are opened again, and foster
parenting of content that a table can't hold.  Of the adoption agency only closing and reopening
of formatting elements is done.  Entities are decoded once.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset(("area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes"))
RCDATA = frozenset(("title", "textarea"))
HEAD = frozenset(("base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"))
FORMATTING = frozenset(("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"))
CLOSES_P = frozenset(
    ("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt", "summary", "listing")
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TABLE_PARTS = frozenset(("caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "td", "th"))
TABLE_CONTEXT = frozenset(("table", "thead", "tbody", "tfoot", "tr"))
SCOPE = frozenset(("html", "table", "td", "th", "caption", "template", "object", "applet", "marquee"))
_P, _BUTTON_SCOPE, _LIST_SCOPE, _TERM_SCOPE, _TABLE_SCOPE = frozenset("p"), SCOPE | {"button"}, SCOPE | {"ul", "ol", "menu", "dir"}, SCOPE | {"dl"}, frozenset({"table", "html"})
_CELLS, _BODIES, _ROW = frozenset(("td", "th")), frozenset(("tbody", "thead", "tfoot")), frozenset(("tr",))
BLOCK = frozenset(
    ("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
)
_BREAKS = BLOCK | {"br"}
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<decl>[!?])[^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("kind", "tag", "attrs", "value", "parent", "children", "start", "end", "synthetic", "closed", "pre", "tree", "at", "to")

    def __init__(self, kind: str, tag: str, attrs: dict[str, str] | None, value: str | None, start: int, end: int, synthetic: bool = False):
        self.pre = -1  # place in document order, once numbered()
        self.tree: Frozen | None = None  # with the places [at, to) of its subtree, once frozen()
        self.kind, self.tag, self.attrs, self.value = kind, tag, attrs, value
        self.start, self.end, self.synthetic = start, end, synthetic
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.closed = False


def attributes(text: str) -> tuple[dict[str, str], bool]:
    """The attributes, lower-case names, first value wins; whether a name came twice."""
    found: dict[str, str] = {}
    twice = False
    for name, a, b, c in _ATTR.findall(text):
        name = name.lower()
        if name in found:
            twice = True
            continue
        value = a or b or c
        found[name] = unescape(value) if "&" in value else value
    return found, twice


class _Builder:
    def __init__(self) -> None:
        self.root = Node("element", "#root", {}, None, 0, 0, True)
        self.stack = [self.root]
        self.tags: dict[str, int] = {"#root": 1}  # open elements by tag: most searches of a deep stack end here
        self.html = self.head = self.body = None
        self.active: list[Node | None] = []
        self.warnings: list[str] = []

    # -- insertion
    def push(self, node: Node, foster: bool = True) -> None:
        at = self.stack[-1]
        if foster and at.tag in TABLE_CONTEXT and node.tag not in TABLE_PARTS and node.kind != "comment" and node.tag not in ("form", "script", "style", "template"):
            table = next((e for e in reversed(self.stack) if e.tag == "table"), None)
            if table is not None and table.parent is not None:
                siblings = table.parent.children
                node.parent = table.parent
                siblings.insert(siblings.index(table), node)
                return
        node.parent = at
        at.children.append(node)

    def open(self, tag: str, attrs: dict[str, str], start: int, end: int, synthetic: bool = False) -> Node:
        node = Node("element", tag, attrs, None, start, end, synthetic)
        self.push(node)
        self.enter(node)
        return node

    def enter(self, node: Node) -> None:
        self.stack.append(node)
        self.tags[node.tag] = self.tags.get(node.tag, 0) + 1
        node.closed = False

    def leave(self, at: int | None = None) -> Node:
        node = self.stack.pop()
        self.tags[node.tag] -= 1
        node.closed = True
        if at is not None:
            node.end = at
        return node

    def need_html(self, at: int) -> None:
        if self.html is None:
            self.html = self.open("html", {}, at, at, True)

    def need_body(self, at: int) -> None:
        self.need_html(at)
        if self.body is None:
            self.cut_to(self.html, at)
            if self.head is None:
                self.head = self.open("head", {}, at, at, True)
                self.leave()
            self.body = self.open("body", {}, at, at, True)

    # -- closing
    def pop_to(self, node: Node, at: int) -> None:
        self.cut_to(node, at)
        self.leave(at)

    def in_scope(self, tags: frozenset[str] | set[str], stop: frozenset[str] = SCOPE) -> Node | None:
        open_tags = self.tags
        for tag in tags:
            if open_tags.get(tag):
                break
        else:
            return None
        for node in reversed(self.stack):
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
        return None

    def close_p(self, at: int) -> None:
        node = self.in_scope(_P, _BUTTON_SCOPE)
        if node is not None:
            self.pop_to(node, at)

    def reconstruct(self, at: int) -> None:
        if not self.active:
            return
        i = len(self.active)
        while i and self.active[i - 1] is not None and self.active[i - 1].closed:
            i -= 1
        for j in range(i, len(self.active)):
            old = self.active[j]
            self.active[j] = self.open(old.tag, dict(old.attrs), at, at, True)

    def marker(self) -> None:
        self.active.append(None)

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # -- tokens
    def text(self, value: str, start: int, end: int) -> None:
        blank = value.isspace()
        if self.body is None and (self.head is None or self.stack[-1] is not self.head):
            if blank:
                return
            self.need_body(start)
        elif self.body is None:
            if blank:
                return
            self.need_body(start)
        active = self.active
        if active and not blank and active[-1] is not None and active[-1].closed:
            self.reconstruct(start)
        at = self.stack[-1]
        if blank and at.tag in TABLE_CONTEXT:
            return
        node = Node("text", "#text", None, unescape(value) if "&" in value else value, start, end)
        if at.tag not in TABLE_CONTEXT and at.children and at.children[-1].kind == "text":
            at.children[-1].value += node.value
            at.children[-1].end = end
            return
        self.push(node)

    def start_tag(self, tag: str, attrs: dict[str, str], start: int, end: int) -> Node | None:
        if tag == "html":
            if self.html is None:
                self.html = self.open("html", attrs, start, end)
            else:
                for k, v in attrs.items():
                    self.html.attrs.setdefault(k, v)
            return None
        if tag == "head":
            self.need_html(start)
            if self.head is None and self.body is None:
                self.head = self.open("head", attrs, start, end)
            return None
        if tag in ("body", "frameset"):
            self.need_html(start)
            if self.body is None:
                self.cut_to(self.html, start)
                if self.head is None:
                    self.head = self.open("head", {}, start, start, True)
                    self.leave()
                self.body = self.open("body", attrs, start, end)
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return None
        if self.body is None:
            self.need_html(start)
            if tag in HEAD:
                if self.head is None:
                    self.head = self.open("head", {}, start, start, True)
                elif self.head.closed:
                    self.enter(self.head)
            else:
                self.need_body(start)
        elif tag == "td" or tag == "th" or tag == "tr":
            at = self.row_part(tag, start)
            if at is not None:
                node = Node("element", tag, attrs, None, start, end)
                node.parent = at
                at.children.append(node)
                self.enter(node)
                if tag != "tr":
                    self.active.append(None)
                return node
        if tag in CLOSES_P:
            self.close_p(start)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.leave(start)
        elif tag == "li":
            node = self.in_scope({"li"}, _LIST_SCOPE)
            if node is not None:
                self.pop_to(node, start)
        elif tag in ("dd", "dt"):
            node = self.in_scope({"dd", "dt"}, _TERM_SCOPE)
            if node is not None:
                self.pop_to(node, start)
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.leave(start)
        elif tag in TABLE_PARTS:
            if not self.table_part(tag, start):
                return None
        elif tag == "table" and self.stack[-1].tag in TABLE_CONTEXT:
            table = self.in_scope({"table"}, frozenset({"td", "th", "caption", "html"}))
            if table is not None:
                self.pop_to(table, start)
        if tag == "a":
            old = next((e for e in reversed(self.active) if e is None or e.tag == "a"), None)
            if old is not None:
                self.end_format("a", start)
        if tag == "nobr" and self.in_scope({"nobr"}):
            self.end_format("nobr", start)
        if tag not in TABLE_PARTS and tag not in HEAD and tag not in ("table", "hr") and tag not in CLOSES_P:
            self.reconstruct(start)
        if tag == "image":
            tag = "img"
        node = Node("element", tag, attrs, None, start, end)
        self.push(node)
        if tag not in VOID:
            self.enter(node)
            if tag in FORMATTING:
                like = [e for e in self.active if e is not None and e.tag == tag and e.attrs == attrs]
                if len(like) >= 3:
                    self.active.remove(like[0])
                self.active.append(node)
            elif tag in ("td", "th", "caption", "object", "applet", "marquee"):
                self.marker()
        return node

    def row_part(self, tag: str, at: int) -> Node | None:
        """What a cell or row goes into where nothing is open inside the cell or row before it, as in most tables; what was open is closed.  Else null."""
        stack = self.stack
        k = len(stack) - 1
        cell = stack[k].tag in _CELLS
        if cell:
            k -= 1
        if stack[k].tag != "tr" or tag == "tr" and stack[k - 1].tag not in _BODIES:
            return None
        if cell:
            self.clear_to_marker()
            self.leave(at)
        if tag == "tr":
            self.leave(at)
        return stack[-1]

    def table_part(self, tag: str, at: int) -> bool:
        table = next((e for e in reversed(self.stack) if e.tag in ("table", "template")), None)
        if table is None or table.tag != "table":
            return False

        def close(tags: set[str] | frozenset[str]) -> None:
            node = self.in_scope(tags, _TABLE_SCOPE)
            if node is not None:
                if node.tag in ("td", "th", "caption"):
                    self.clear_to_marker()
                self.pop_to(node, at)

        close(_CELLS if tag in ("td", "th") else {"td", "th", "caption"})
        if tag in ("td", "th"):
            if self.in_scope(_ROW, _TABLE_SCOPE) is None:
                if self.in_scope(_BODIES, _TABLE_SCOPE) is None:
                    self.cut_to(table, at)
                    self.open("tbody", {}, at, at, True)
                self.open("tr", {}, at, at, True)
            self.cut_to(self.in_scope(_ROW, _TABLE_SCOPE), at)
        elif tag == "tr":
            close(_ROW)
            body = self.in_scope(_BODIES, _TABLE_SCOPE)
            if body is None:
                self.cut_to(table, at)
                self.open("tbody", {}, at, at, True)
            else:
                self.cut_to(body, at)
        elif tag == "col":
            if self.stack[-1].tag != "colgroup":
                close(_ROW)
                close(_BODIES)
                self.cut_to(table, at)
                self.open("colgroup", {}, at, at, True)
        else:
            close(_ROW)
            close({"tbody", "thead", "tfoot", "colgroup"})
            self.cut_to(table, at)
        return True

    def cut_to(self, node: Node, at: int) -> None:
        """Close all that is open inside node."""
        while self.stack[-1] is not node:
            self.leave(at)

    def end_format(self, tag: str, at: int) -> None:
        node = next((e for e in reversed(self.active) if e is not None and e.tag == tag), None)
        if node is None:
            other = self.in_scope({tag})
            if other is not None:
                self.pop_to(other, at)
            return
        self.active.remove(node)
        if not node.closed and self.in_scope({tag}) is not None:
            # inner formatting elements stay active, and are opened again by what follows
            self.pop_to(node, at)

    def end_tag(self, tag: str, start: int, end: int) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head is not None and not self.head.closed:
                self.pop_to(self.head, end)
            return
        if tag == "br":
            self.start_tag("br", {}, start, end)
            return
        if tag == "p" and self.in_scope(_P, _BUTTON_SCOPE) is None:
            self.need_body(start)
            self.push(Node("element", "p", {}, None, start, end, True))
            return
        if tag in FORMATTING:
            self.end_format(tag, end)
            return
        if tag in HEADINGS:
            node = self.in_scope(HEADINGS)
        elif tag in TABLE_PARTS or tag == "table":
            node = self.in_scope({tag}, _TABLE_SCOPE - {tag})
            if node is not None and (tag in ("td", "th", "caption") or self.in_scope({"td", "th", "caption"}, _TABLE_SCOPE) is not None):
                self.clear_to_marker()
        else:
            node = self.in_scope({tag})
        if node is not None:
            self.pop_to(node, end)


def build(source: str) -> tuple[Node, list[str]]:
    """(root, warnings).  The root has tag '#root'; null source counts as ''."""
    b, at, n = _Builder(), 0, len(source)
    match, text, lower = _TOKEN.search, b.text, None
    while at < n:
        found = match(source, at)
        if found is None:
            text(source[at:], at, n)
            break
        start, end = found.span()
        if start > at:
            text(source[at:start], at, start)
        at = end
        comment, decl, close, tag, raw = found.groups()
        if comment is not None:
            node = Node("comment", "#comment", None, comment, start, end)
            b.push(node)
            continue
        if decl:
            continue
        tag = tag.lower()
        if close:
            b.end_tag(tag, start, end)
            continue
        attrs, twice = attributes(raw) if raw and not raw.isspace() else ({}, False)
        if twice:
            b.warnings.append(f"duplicate attribute on {tag}")
        node = b.start_tag(tag, attrs, start, end)
        if node is not None and (tag in RAW or tag in RCDATA):
            if lower is None:
                lower = source.lower()
            stop = lower.find("</" + tag, at)
            stop = n if stop < 0 else stop
            if stop > at:
                value = source[at:stop]
                inner = Node("text", "#text", None, unescape(value) if tag in RCDATA and "&" in value else value, at, stop)
                inner.parent = node
                node.children.append(inner)
            close = source.find(">", stop)
            at = n if close < 0 else close + 1
            node.end = at
            if b.stack[-1] is node:
                b.leave()
    for node in b.stack:
        node.end = n
    if b.html is None and n:
        b.need_body(n)
    return b.root, b.warnings


class Frozen:
    """A tree whose nodes and texts stay as they are: its nodes in document order, and its text, read once for all of its subtrees."""

    __slots__ = ("order", "buffer", "offsets", "texts", "tags", "sized", "sided")

    def __init__(self, order: list[Node], buffer: str, offsets: list[int]):
        self.order, self.buffer, self.offsets = order, buffer, offsets
        self.texts: list[str | None] = [None] * len(order)
        self.tags = {n.tag for n in order}
        self.sized: bool | None = None  # whether some element asks for a size of its text, and for a side; null if that wasn't looked for
        self.sided: bool | None = None


def frozen(root: Node) -> Node:
    """root, which is read from now on by walk, below and text_of in time that follows what they return; attributes may still change."""
    order = [root, *below(root)]
    parts: list[str] = []
    offsets: list[int] = []
    length = 0
    for i, node in enumerate(order):
        node.at, node.to = i, i + 1
        offsets.append(length)
        if node.kind == "text":
            parts.append(node.value)
            length += len(node.value)
        elif node.tag in _BREAKS and node.kind == "element":
            parts.append(" ")
            length += 1
    offsets.append(length)
    for i in range(len(order) - 1, 0, -1):
        node = order[i]
        up = node.parent
        if node.to > up.to:
            up.to = node.to
    tree = Frozen(order, "".join(parts), offsets)
    for node in order:
        node.tree = tree
    return root


def thawed(root: Node) -> Node:
    """root, which may change again."""
    if root.tree is not None:
        for node in root.tree.order:
            node.tree = None
    return root


def released(root: Node) -> None:
    """Parts a frozen tree that isn't used any more, so that its nodes go at once and aren't left to the collector of cycles."""
    order = root.tree.order
    for node in order:
        node.parent = node.tree = None
    order.clear()


def walk(root: Node):
    """Nodes below root in document order."""
    return iter(below(root)) if root.tree is not None else _walk(root)


def _walk(root: Node):
    stack = root.children[::-1]
    while stack:
        node = stack.pop()
        yield node
        if node.children:
            stack += node.children[::-1]


def below(root: Node) -> list[Node]:
    """As walk, at once."""
    if root.tree is not None:
        return root.tree.order[root.at + 1 : root.to]
    out: list[Node] = []
    stack = root.children[::-1]
    while stack:
        node = stack.pop()
        out.append(node)
        if node.children:
            stack += node.children[::-1]
    return out


def numbered(root: Node) -> Node:
    """root, with each node's place in document order in ``pre``, as in the node table."""
    root.pre = 0
    for i, node in enumerate(below(root), 1):
        node.pre = i
    return root


def depth_of(root: Node) -> int:
    """Elements and texts around the deepest node."""
    depth = -1
    level = [root]
    while level:
        depth += 1
        level = [c for n in level for c in n.children]
    return depth


def collapsed(text: str) -> str:
    """White space (of Unicode, and the byte order mark) as single spaces, none at the edges."""
    return " ".join((text.replace("\ufeff", " ") if "\ufeff" in text else text).split())


def text_of(root: Node, skip: frozenset[str] = frozenset()) -> str:
    """Texts in document order, one space on entry to br and block elements, white space collapsed."""
    tree = root.tree
    if tree is not None and not skip:
        text = tree.texts[root.at]
        if text is None:
            text = tree.texts[root.at] = collapsed(tree.buffer[tree.offsets[root.at] : tree.offsets[root.to]])
        return text
    parts: list[str] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.kind == "text":
            parts.append(node.value)
        elif node.kind == "element" and node.tag not in skip:
            if node.tag in _BREAKS:
                parts.append(" ")
            if node.children:
                stack += node.children[::-1]
    return collapsed("".join(parts))


def flatten(root: Node) -> list[dict]:
    """Rows of the node table in document order (nested-set form), with [text_start, text_end) into text_buffer(root)."""
    rows: list[dict] = []
    length = 0
    stack: list[tuple[Node | None, int | None, int, str]] = [(root, None, 0, "")]
    open_rows: list[dict] = []
    while stack:
        node, parent_pre, depth, path = stack.pop()
        if node is None:  # all below the last open row has been seen
            row = open_rows.pop()
            row["post"], row["text_end"] = len(rows) - 1, length
            if open_rows:
                up = open_rows[-1]
                up["links"] += row["links"]
                up["images"] += row["images"]
                up["sub_depth"] = max(up["sub_depth"], row["sub_depth"] + 1 if row["kind"] == "element" else row["sub_depth"])
            continue
        row = {
            "pre": len(rows), "post": 0, "parent_pre": parent_pre, "depth": depth, "node_id": path, "kind": node.kind, "tag": node.tag,
            "attrs": node.attrs, "value": node.value, "start_offset": node.start, "end_offset": node.end, "synthetic": node.synthetic,
            "text_start": length, "text_end": length, "text_len": 0, "links": int(node.tag == "a" and "href" in (node.attrs or {})), "images": int(node.tag == "img"), "sub_depth": 0,
        }
        rows.append(row)
        open_rows.append(row)
        if node.kind == "text":
            length += len(node.value)
        elif node.kind == "element" and (node.tag == "br" or node.tag in BLOCK):
            length += 1
        seen: dict[str, int] = {}
        below = []
        for child in node.children:
            seen[child.tag] = seen.get(child.tag, 0) + 1
            below.append((child, row["pre"], depth + 1, f"{path}/{child.tag}[{seen[child.tag]}]"))
        stack.append((None, None, 0, ""))
        stack.extend(reversed(below))
    buffer = text_buffer(root)
    for row in rows:
        row["text_len"] = len(collapsed(buffer[row["text_start"] : row["text_end"]]))
    return rows


def places(root: Node, tags: frozenset[str] | set[str]) -> list[dict]:
    """pre, post, tag and attrs, as in flatten(), of the elements with these tags."""
    order = [root, *below(root)]
    last: dict[int, int] = {}
    rows: list[dict] = []
    for pre in range(len(order) - 1, -1, -1):
        node = order[pre]
        end = last.pop(id(node), pre)
        up = id(node.parent)
        if end > last.get(up, -1):
            last[up] = end
        if node.tag in tags:
            rows.append({"pre": pre, "post": end, "tag": node.tag, "attrs": node.attrs})
    return rows[::-1]


def escape(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if attribute else text


def to_html(root: Node) -> str:
    """The subtree as HTML; reading it again gives the same tree where tags may nest as they do."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.kind == "text":
            out.append(node.value if node.parent is not None and node.parent.tag in RAW else escape(node.value))
        elif node.kind == "comment":
            out.append(f"<!--{node.value}-->")
        else:
            if node.tag != "#root":
                out.append("<" + node.tag + "".join(f' {k}="{escape(v, True)}"' for k, v in (node.attrs or {}).items()) + ">")
                if node.tag not in VOID:
                    stack.append(f"</{node.tag}>")
            stack.extend(reversed(node.children))
    return "".join(out)


def text_buffer(root: Node) -> str:
    parts: list[str] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.kind == "text":
            parts.append(node.value)
        elif node.kind == "element":
            if node.tag in _BREAKS:
                parts.append(" ")
            stack.extend(reversed(node.children))
    return "".join(parts)

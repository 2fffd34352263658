"""Output blocks that can't break the rules of the format, and what is done where a renderer can't show one.

A builder raises BuildError instead of making what the validator would reject.  A downgrade gives blocks that the target can show,
and a record of what is lost.
"""

from __future__ import annotations

import re

from quire.functions.checks import PALETTE
from quire.functions.profiles import TargetProfile


class BuildError(ValueError):
    pass


def _need(kind: str, what: str, value: str | None) -> str:
    value = (value or "").strip()
    if not value or "\n" in value:
        raise BuildError(f"{kind}: {what} must be one line that isn't empty")
    return value


def _one_of(kind: str, what: str, value, allowed: tuple) -> str:
    if str(value) not in allowed:
        raise BuildError(f"{kind}: {what} must be one of {', '.join(allowed)}, not {value!r}")
    return str(value)


def _children(kind: str, children: list, banned: tuple[str, ...] = (), least: int = 1) -> list:
    if len(children) < least:
        raise BuildError(f"{kind}: needs {least} children and more")
    for child in children:
        if child.kind == "directive" and child.name in banned:
            raise BuildError(f"{kind}: can't hold {child.name}")
        if child.kind == "directive" and banned:
            _children(kind, child.children, banned, 0)
    return children


def _block(kind: str, **fields):
    from quire.functions.compile import Block

    return Block(kind, **fields)


def anchor(ident: str):
    ident = _need("anchor", "id", ident)
    if not re.fullmatch(r"[\w.:-]+", ident):
        raise BuildError(f"anchor: {ident!r} can't be written in braces")
    return _block("directive", name="anchor", props={"id": ident})


def align(position: str, children: list):
    return _block("directive", name="align", props={"position": _one_of("align", "position", position, ("left", "center", "right", "justify"))}, children=_children("align", children, ("columns", "column", "nav", "frame")))


def _optional(props: dict, **given) -> dict:
    for key, value in given.items():
        if value is not None:
            props[key] = _one_of("image", key, value, PALETTE) if key == "frame" else _need("image", key, value)
    return props


def image(src: str, position: str = "center", size: str = "medium", **optional):
    """A picture by itself; optional: alt, caption, link, frame."""
    props = {"src": _need("image", "src", src), "position": _one_of("image", "position", position, ("left", "center", "right")), "size": _one_of("image", "size", size, ("small", "medium", "large"))}
    return _block("image", props=_optional(props, **optional))


def grouped_image(src: str, **optional):
    """A picture of a group, which has no place and size of its own."""
    if {"position", "size"} & set(optional):
        raise BuildError("image: position and size belong to pictures outside of groups")
    return _block("image", props=_optional({"src": _need("image", "src", src)}, **optional))


def images(columns: int, children: list):
    if any(c.kind != "image" or {"position", "size"} & set(c.props) for c in children):
        raise BuildError("images: holds grouped images only")
    return _block("directive", name="images", props={"columns": _one_of("images", "columns", columns, ("2", "3", "4"))}, children=_children("images", children, least=2))


def document(src: str, title: str, mode: str = "link"):
    return _block("directive", name="document", props={"src": _need("document", "src", src), "title": _need("document", "title", title), "mode": _one_of("document", "mode", mode, ("link", "embed"))})


def column(children: list):
    return _block("directive", name="column", children=_children("column", children, ("columns", "column", "nav", "frame")))


def columns(children: list, target: TargetProfile = TargetProfile(), divider: bool = False):
    if not 2 <= len(children) <= 4 or any(c.kind != "directive" or c.name != "column" for c in children):
        raise BuildError("columns: holds two to four columns")
    props = {}
    if divider and target.columns_property:
        props["divider"] = "true"
    if len(children) == 4 and target.columns_property:
        props["columns"] = "4"
    return _block("directive", name="columns", props=props, children=children)


def nav(items: list[tuple[int, str]], active: str | None = None, title: str | None = None):
    if not items:
        raise BuildError("nav: needs items")
    props = {k: _need("nav", k, v) for k, v in (("title", title), ("active", active)) if v is not None}
    if active is not None and sum(re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", t).strip() == active.strip() for _, t in items) != 1:
        raise BuildError("nav: active must be the label of one item")
    return _block("directive", name="nav", props=props, children=[_block("list", name="bullet", items=items, depth=1)])


def frame(palette: str, children: list, target: TargetProfile = TargetProfile()):
    if not target.frames:
        raise BuildError("frame: the target has no frames")
    return _block("directive", name="frame", props={"frame": _one_of("frame", "frame", palette, PALETTE)}, children=_children("frame", children, ("frame",)))


def signature(children: list, target: TargetProfile = TargetProfile()):
    if not target.signatures:
        raise BuildError("signature: the target has no signatures")
    if any(c.kind != "paragraph" for c in children):
        raise BuildError("signature: holds paragraphs only")
    return _block("directive", name="signature", children=_children("signature", children))


def lead(children: list):
    if any(c.kind not in ("paragraph", "list", "quote") for c in children):
        raise BuildError("lead: holds plain blocks only")
    return _block("directive", name="lead", children=_children("lead", children))


# -- downgrades

_PLAIN = ("paragraph", "list", "quote", "code", "rule")


def downgraded(blocks: list, target: TargetProfile) -> tuple[list, list[tuple[str, str]]]:
    """(blocks that the target can show, records (construct, what is lost))."""
    out, lost = [], []
    for b in blocks:
        b.children, inner = downgraded(b.children, target)
        lost += inner
        if b.kind == "directive" and b.name == "frame" and not target.frames:
            quotable = all(c.kind in _PLAIN for c in b.children)
            lost.append(("frame", f"{b.props.get('frame')} frame as a " + ("quotation" if quotable else "plain section")))
            out += [_block("quote", children=b.children)] if quotable else b.children
        elif b.kind == "directive" and b.name == "signature" and not target.signatures:
            lost.append(("signature", "closing credit as paragraphs"))
            out += b.children
        elif b.kind == "directive" and b.name == "columns" and not target.columns_property and {"divider", "columns"} & set(b.props):
            lost += [(f"columns.{k}", "left out, as the target would show it as text") for k in ("divider", "columns") if k in b.props]
            b.props = {k: v for k, v in b.props.items() if k not in ("divider", "columns")}
            out.append(b)
        else:
            out.append(b)
    return out, lost

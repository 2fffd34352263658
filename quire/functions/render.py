"""Documents as HTML pages, for looking at them and for measuring them: every block carries its path, line and kind."""

from __future__ import annotations

import re

from quire.functions import markdown as M
from quire.functions.html_tree import escape

STYLE = """
.document-page { max-width: 60rem; margin: auto; font: 16px/1.5 serif }
.columns, .images { display: grid; grid-template-columns: repeat(var(--tracks), 1fr); gap: 1rem }
.align[data-position=left] { text-align: left } .align[data-position=center] { text-align: center } .align[data-position=right] { text-align: right }
figure { margin: 1rem auto } figure.left { float: left } figure.right { float: right } figure img { max-width: 100% }
.frame { border: 2px solid; padding: 1rem }
""".strip()
WIDTH = {"small": "22%", "medium": "42%", "large": "68%"}
_INLINE = re.compile(r"\\(?P<raw>.)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^\s)]+)\)|\[(?P<label>(?:\\.|[^\]])*)\]\((?P<href>[^\s)]+)\)|\*\*(?P<strong>.+?)\*\*|\*(?P<em>[^*]+)\*|~~(?P<gone>.+?)~~|==(?P<mark>.+?)==|`(?P<code>[^`]+)`", re.S)


def inline(text: str, base: str = "/pages") -> str:
    """Inline Markdown as HTML."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(escape(text[at : m.start()]))
        at = m.end()
        kind = m.lastgroup
        if kind == "raw":
            out.append("<br>" if m["raw"] == "\n" else escape(m["raw"]))
        elif kind == "src":
            out.append(f'<img src="{escape(resolved(m["src"], base), True)}" alt="{escape(m["alt"], True)}">')
        elif kind == "href":
            out.append(f'<a href="{escape(resolved(m["href"], base), True)}">{inline(m["label"], base)}</a>')
        elif kind == "code":
            out.append(f"<code>{escape(m['code'])}</code>")
        else:
            tag = {"strong": "strong", "em": "em", "gone": "s", "mark": "mark"}[kind]
            out.append(f"<{tag}>{inline(m[kind], base)}</{tag}>")
    return "".join([*out, escape(text[at:])])


def resolved(target: str, base: str) -> str:
    """A target as a browser reaches it: relative files lie below base."""
    if re.match(r"[#?]|//|[A-Za-z][A-Za-z\d+.-]*:", target) or target.startswith("/"):
        return target
    return f"{base}/{target}"


def render(text: str | None, title: str = "", base: str = "/pages", annotate: bool = False) -> str:
    """The page of a document."""
    blocks = M.read(text)[0]
    children: dict[str, list[dict]] = {}
    for b in blocks:
        children.setdefault(b["parent"], []).append(b)
    body = _blocks(children.get("", []), children, base)
    cls = "document-page annotated" if annotate else "document-page"
    return f'<!doctype html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{escape(title)}</title>\n<style>{STYLE}</style>\n</head>\n<body>\n<article class="{cls}">\n{body}\n</article>\n</body>\n</html>\n'


def _mark(b: dict, kind: str | None = None, **more: str | None) -> str:
    given = {"data-path": b["path"], "data-line": str(b["line"]), "data-kind": kind or b["name"] or b["kind"], **{k.replace("_", "-"): v for k, v in more.items()}}
    return "".join(f' {k}="{escape(v, True)}"' for k, v in given.items() if v)


def _blocks(blocks: list[dict], children: dict[str, list[dict]], base: str) -> str:
    out, i = [], 0
    while i < len(blocks):
        b = blocks[i]
        run = [b]
        if b["kind"] in ("list-item", "table-row"):  # items and rows in a row are one list, one table
            while i + len(run) < len(blocks) and (n := blocks[i + len(run)])["kind"] == b["kind"] and (n["name"] == b["name"] or b["kind"] == "list-item" and n["depth"] > 0):
                run.append(n)
        out.append(_list(run, base) if b["kind"] == "list-item" else _table(run, base) if b["kind"] == "table-row" else _block(b, children, base))
        i += len(run)
    return "\n".join(out)


def _list(items: list[dict], base: str) -> str:
    tag = "ol" if items[0]["name"] == "ordered" else "ul"
    out, depth = [f"<{tag}{_mark(items[0], 'list')}>"], 0
    for item in items:
        while depth < item["depth"]:
            out.append(f"<{tag}>")
            depth += 1
        while depth > item["depth"]:
            out.append(f"</{tag}>")
            depth -= 1
        out.append(f"<li{_mark(item, 'item')}>{inline(item['text'], base)}</li>")
    return "\n".join([*out, *[f"</{tag}>"] * (depth + 1)])


def _table(rows: list[dict], base: str) -> str:
    line = lambda r, tag: "<tr>" + "".join(f"<{tag}>{inline(c, base)}</{tag}>" for c in r["text"].split("\x1f")) + "</tr>"
    bare = not rows[0]["text"].replace("\x1f", "").strip()
    return f"<table{_mark(rows[0], 'table', data_bare='true' if bare else None)}>\n<thead>{line(rows[0], 'th')}</thead>\n<tbody>\n" + "\n".join(line(r, "td") for r in rows[1:]) + "\n</tbody>\n</table>"


def _block(b: dict, children: dict[str, list[dict]], base: str) -> str:
    kind, text = b["kind"], b["text"]
    if kind == "heading":
        return f"<h{b['depth']}{_mark(b)}>{inline(text, base)}</h{b['depth']}>"
    if kind == "paragraph":
        return f"<p{_mark(b)}>{inline(text, base)}</p>"
    if kind == "quote":
        return f"<blockquote{_mark(b)}>{inline(text, base)}</blockquote>"
    if kind == "rule":
        return f"<hr{_mark(b)}>"
    if kind == "code":
        return f"<pre{_mark(b)}><code>{escape(text)}</code></pre>"
    name, p, inner = b["name"], b["props"], children.get(b["path"], [])
    if name == "image":
        return _image(b, base, True)
    if name == "images":
        n = p.get("columns") if p.get("columns") in ("2", "3", "4") else "2"
        return f'<div class="images" style="--tracks:{n}"{_mark(b)}>\n' + "\n".join(_image(c, base, False) if c["name"] == "image" else _block(c, children, base) for c in inner) + "\n</div>"
    if name == "document":
        return f'<div class="document"{_mark(b, data_mode=p.get("mode"))}><a href="{escape(resolved(p.get("src", ""), base), True)}">{escape(p.get("title", ""))}</a></div>'
    if name == "anchor":
        return f'<a id="{escape(p.get("id", ""), True)}"{_mark(b)}></a>'
    body = _blocks(inner, children, base)
    if name == "columns":
        return f'<div class="columns" style="--tracks:{max(1, len(inner))}"{_mark(b)}>\n{body}\n</div>'
    if name == "nav":
        return f"<nav{_mark(b, data_active=p.get('active'))}>\n" + (f"<p>{escape(p['title'])}</p>\n" if p.get("title") else "") + f"{body}\n</nav>"
    cls = name if name in ("align", "column", "frame", "lead", "signature") else "unknown"
    return f'<div class="{cls}"{_mark(b, data_position=p.get("position"), data_frame=p.get("frame"))}>\n{body}\n</div>'


def _image(b: dict, base: str, alone: bool) -> str:
    p = b["props"]
    picture = f'<img src="{escape(resolved(p.get("src", ""), base), True)}" alt="{escape(p.get("alt", ""), True)}">'
    if p.get("link"):
        picture = f'<a href="{escape(resolved(p["link"], base), True)}">{picture}</a>'
    caption = f"<figcaption>{inline(p['caption'], base)}</figcaption>" if p.get("caption") else ""
    place = p.get("position") if alone and p.get("position") in ("left", "center", "right") else None
    width = f' style="width:{WIDTH[p["size"]]}"' if alone and p.get("size") in WIDTH else ""
    return f"<figure{f' class={chr(34)}{place}{chr(34)}' if place else ''}{width}{_mark(b)}>{picture}{caption}</figure>"


def launcher(names: list[str]) -> str:
    """A page that leads to rendered documents."""
    items = "\n".join(f'<li><a href="{escape(n, True)}.html">{escape(n)}</a></li>' for n in names)
    return f'<!doctype html>\n<meta charset="utf-8">\n<title>Documents</title>\n<ul>\n{items}\n</ul>\n'

"""Whole runs: the corpus scan, and pages to documents with a conservation gate."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from quire.functions import batches as B, checks as K, compile as C, decode as D, html_tree as H, rewrite as R
from quire.operators import pages as P, text_ops as O

LEDGER = "array<struct<node:string,terminal:string,note:string>>"
TABLES = "array<struct<seq:int,class:string,confidence:double,tier:int,plan:string>>"
GATE = "recall double, missing_links int, extra_links int, missing_images int, extra_images int, lost_tables int, problems int, reviews int, state string"
MADE = {"markdown": "string", "source_text": "string", "accounted": "string", "links": "array<string>", "images": "array<string>", "ledger": LEDGER, "tables": TABLES}
CONVERTED = ", ".join(f"{k} {v}" for k, v in MADE.items()) + ", " + GATE
MAX_CHROME = 1_000_000


def broken_words(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, word): the forms, joined and hyphenated, that the words broken on each page may have; what a page asks of the lexicon."""

    kind = dict(pages.dtypes)[id_col]

    def of(i, text: str | None) -> list[dict]:
        words: set[str] = set()
        if not text or "&" not in text and not R.has_hyphen(text):  # no node can hold one
            return []
        root = H.build(D.islands(text)[0])[0]
        for node in H.walk(root):
            if node.kind == "text" and R.has_hyphen(node.value):
                for left, right in R.broken_at(node.value):
                    words.add((left + right).lower())
                    words.add(f"{left}-{right}".lower())
            kids = node.children
            for a, mid, b in zip(kids, kids[1:], kids[2:]) if len(kids) > 2 else ():
                if a.kind == b.kind == "text" and mid.kind == "element" and H.text_buffer(mid) in tuple(R.HYPHENS):
                    words |= {f"{x}{sign}{y}".lower() for x in a.value.split()[-1:] for y in b.value.split()[:1] for sign in ("", "-")}
        return [{id_col: i, "words": sorted(words)}] if words else []

    # a row for each page until here: words become rows where that is cheap
    return B.rows_of(pages, id_col, html, f"`{id_col}` {kind}, words array<string>", of, kind=kind).select(id_col, F.explode("words").alias("word"))


def with_lookups(pages: DataFrame, lexicon: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """pages with ``known``: how often the corpus has the forms of each page's broken words.

    Pages ask by word, the lexicon (word, hyphenated, n) answers in an equi-join, and the answers go back by page; both are as many
    as there are broken words, whatever the size of the lexicon.
    """
    asked = broken_words(pages, id_col, html)
    found = asked.join(lexicon.select("word", "n"), "word").groupBy(id_col).agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return pages.join(found, id_col, "left")


def convert_pages(pages: DataFrame, id_col: str = "page_id", html: str = "html", profile: dict[str, DataFrame] | None = None, options: C.Options = C.Options(), min_recall: float = 0.995, max_line: int = 2200, invisible: str | None = None, classes: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """(id, CONVERTED) of every row of pages: its document, what its conversion kept, and whether that passes the gate.

    A narrow map, with one join before it if profile (as made by scan) has a lexicon.  Stable chrome is sent to all tasks after its size
    is checked; where there is more of it than MAX_CHROME shapes, each page gets the shapes it has, in a join.
    invisible: a column of nodes (array<int>) that a measurement found invisible; classes: one of classes of tables decided elsewhere,
    array of (seq, class).  Repeated ids give a row each.
    only: the columns of CONVERTED that are asked for; the others aren't made, nor is the gate where none of its columns is among them.
    """
    columns = [html]
    columns += [c for c in (invisible, classes) if c]
    if profile is not None and "lexicon" in profile:
        pages, columns = with_lookups(pages, profile["lexicon"], id_col, html), [*columns, "known"]
    shapes: frozenset[str] = frozenset()
    if profile is not None and "stable_chrome" in profile:
        chrome = profile["stable_chrome"].select("fingerprint").distinct()
        some = chrome.limit(MAX_CHROME + 1).collect()
        if len(some) <= MAX_CHROME:
            shapes = frozenset(r.fingerprint for r in some)
        else:
            own = P.fingerprints(pages, id_col, html).select(F.col("page_id").alias(id_col), "fingerprint").distinct().join(chrome, "fingerprint")
            pages = pages.join(own.groupBy(id_col).agg(F.collect_set("fingerprint").alias("shapes")), id_col, "left")
            columns.append("shapes")
    frequent: dict[str, float] = {}
    if profile is not None and "fingerprint_freq" in profile:
        # at most ten shapes for each element of a page have a tenth of the pages, so that there are few of them in any corpus
        common = profile["fingerprint_freq"].where("frequency >= 0.1").select("fingerprint", "frequency")
        some = common.limit(MAX_CHROME + 1).collect()
        if len(some) <= MAX_CHROME:
            frequent = {r.fingerprint: r.frequency for r in some}
    rules = options.target.rules()
    kind = "string" if dict(pages.dtypes)[id_col] == "string" else "bigint"

    schema = {**MADE, **dict(x.split() for x in GATE.split(", "))}
    wanted = tuple(schema) if only is None else only
    gated = any(k not in MADE for k in wanted)

    def of(i: int, text: str | None, *more) -> list[dict]:
        extra = dict(zip(columns[1:], more))
        chrome = frozenset(extra.get("shapes") or shapes)
        known = R.Lookup({w["word"]: w["n"] for w in extra.get("known") or ()})
        made = C.convert(text, C.replace(options, chrome=chrome, classes=tuple((x["seq"], x["class"]) for x in extra.get(classes) or ())), known, P.fingerprint, frozenset(extra.get(invisible) or ()), frequent)
        made["ledger"] = [{"node": n, "terminal": t, "note": w} for n, t, w in made["ledger"]]
        if gated:
            made.update(K.verify(made, min_recall, max_line, rules))
        return [{id_col: i, **{k: made[k] for k in wanted}}]

    return B.rows_of(pages, id_col, columns, f"`{id_col}` {kind}, " + ", ".join(f"{k} {schema[k]}" for k in wanted), of, kind=kind)


def artifacts(pages: DataFrame, id_col: str = "page_id", html: str = "html", options: C.Options = C.Options()) -> DataFrame:
    """(page_id, stage, content): what each stage of the conversion left of every page, from 00-source to 08-ledger and 09-gate."""

    def of(i: int, text: str | None) -> Iterator[dict]:
        trace: list[tuple[str, str]] = []
        made = C.convert(text, options, trace=trace)
        made["ledger"] = [{"node": n, "terminal": t, "note": w} for n, t, w in made["ledger"]]
        trace.append(("09-gate", json.dumps(K.verify(made, profile=options.target.rules()))))
        return ({"page_id": i, "stage": stage, "content": content} for stage, content in trace)

    return B.rows_of(pages, id_col, html, "page_id bigint, stage string, content string", of, "page_id")


def scan(pages: DataFrame, id_col: str = "page_id", html: str = "html", threshold: float = 0.7) -> dict[str, DataFrame]:
    """The corpus profile: fingerprint_freq, stable_chrome, lexicon.

    The shapes, a row each with its counts, are kept (in memory or on disk) once they are counted: two parts of the profile are read off them.
    """
    total = pages.agg(F.countDistinct(id_col)).first()[0]
    frequency = P.fingerprint_frequency(P.fingerprints(pages, id_col, html)).persist()
    kind = "string" if dict(pages.dtypes)[id_col] == "string" else "bigint"
    texts = B.rows_of(pages, id_col, html, f"page_id {kind}, text string", lambda i, t: [{"page_id": i, "text": _words(t)}], "page_id", kind)
    return {"fingerprint_freq": frequency.withColumn("frequency", F.col("pages") / F.lit(max(1, total))), "stable_chrome": P.stable_chrome(frequency, total, threshold), "lexicon": O.lexicon(texts)}


def _words(text: str | None) -> str:
    """The text of a page, line ends kept, as the lexicon reads it."""
    root = H.numbered(H.build(D.islands(text or "")[0])[0])
    R.sanitize(root)
    R.drop_head(root)
    return H.text_buffer(root)


def encoding_report(decoded: DataFrame, keep: list[str]) -> DataFrame:
    """What was declared and chosen for each file, and whether the choice is sure."""
    return decoded.select(*keep, "declared", "codec", "source", "replacement_chars", "uncertain")


def table_frequency(pages: DataFrame, profile: dict[str, DataFrame], id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, seq, fingerprint, frequency): how much of the corpus has the shape of each table; 0 if unseen."""

    def of(i: int, text: str | None) -> Iterator[dict]:
        tables = [n for n in H.walk(H.build(text or "")[0]) if n.tag == "table"]
        return ({"page_id": i, "seq": k, "fingerprint": P.fingerprint(n)} for k, n in enumerate(tables))

    shapes = B.rows_of(pages, id_col, html, "page_id bigint, seq int, fingerprint string", of, "page_id")
    return shapes.join(profile["fingerprint_freq"].select("fingerprint", "frequency"), "fingerprint", "left").select("page_id", "seq", "fingerprint", F.coalesce("frequency", F.lit(0.0)).alias("frequency"))


def changes(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, stage, node, tag, action, reason, loses_words): all that the rewriting stages do to each page."""

    def of(i: int, text: str | None) -> Iterator[dict]:
        root = H.numbered(H.build(D.islands(text or "")[0])[0])
        for r in [*R.sanitize(root), *R.drop_head(root), *R.dehyphenate(root, R.Lookup({})), *R.normalize(root), *R.recover_headings(root)]:
            yield {"page_id": i, "stage": r.stage, "node": r.pre, "tag": r.tag, "action": r.action, "reason": r.reason, "loses_words": r.loses_words}

    return B.rows_of(pages, id_col, html, "page_id bigint, stage string, node int, tag string, action string, reason string, loses_words boolean", of, "page_id")

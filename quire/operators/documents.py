"""Markdown documents: blocks, facts, scores, validation, lint and differences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import batches as B, checks as K, markdown as M, text as T

BLOCKS = "path string, parent string, ord int, kind string, name string, depth int, line int, text string, props map<string,string>"


def read_blocks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, BLOCKS) of every document; a null document has no blocks."""
    return B.rows_of(docs, id_col, text, f"{id_col} bigint, {BLOCKS}", lambda i, t: ({id_col: i, **b, "props": list(b["props"].items())} for b in M.read(t)[0]))


def read_warnings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, code, line): what the reader found odd."""
    return B.rows_of(docs, id_col, text, f"{id_col} bigint, code string, line int", lambda i, t: ({id_col: i, "code": c, "line": n} for c, n in M.read(t)[1]))


# -- facts and scores: a document is a row, and all of it is read in its batch (quire.functions.checks)


def facts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, axis, item): headings, links, images, directives and cells of every document, one row for each occurrence."""
    return B.rows_of(docs, id_col, text, f"{id_col} bigint, axis string, item string", lambda i, t: ({id_col: i, "axis": a, "item": x} for a, x in K.facts(M.read(t)[0])))


def prose_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, prose): the visible text of every document, in order."""
    return B.rows_of(docs, id_col, text, f"{id_col} bigint, prose string", lambda i, t: [{id_col: i, "prose": K.prose(M.read(t)[0])}])


def axis_scores(pairs: DataFrame, id_col: str, expected: str, actual: str) -> DataFrame:
    """(id, axis, expected, actual, matched, recall, precision, f1, missing): text and five inventories of each pair of documents.

    anchor directives don't count while the expected document has none of them.  missing: the first eight items that lack.
    """
    schema = f"{id_col} bigint, axis string, expected bigint, actual bigint, matched bigint, recall double, precision double, f1 double, missing array<string>"
    return B.rows_of(pairs, id_col, [expected, actual], schema, lambda i, e, a: ({id_col: i, "axis": axis, **x} for axis, x in K.scores(e, a)[0].items()))


def overall_scores(pairs: DataFrame, id_col: str, expected: str, actual: str) -> DataFrame:
    """(id, shape, overall): agreement of table shapes, and the weighted mean of it and the axes."""

    def of(i: int, e: str | None, a: str | None):
        _, shape, overall = K.scores(e, a)
        return [{id_col: i, "shape": shape, "overall": overall}]

    return B.rows_of(pairs, id_col, [expected, actual], f"{id_col} bigint, shape double, overall double", of)


def corpus_score(scores: DataFrame) -> DataFrame:
    """(documents, mean, least): of overall scores."""
    return scores.agg(F.count("*").alias("documents"), F.avg("overall").alias("mean"), F.min("overall").alias("least"))


def report(axes: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """(id, line): one line of fixed width for each document: the overall score, table shapes and the axes."""
    cell = lambda name: F.lpad(F.format_string("%.1f", 100 * F.max(F.when(F.col("axis") == name, F.col("f1")))), 7, " ")
    per = axes.groupBy(id_col).agg(F.concat(*[cell(a) for a in K.AXES]).alias("cells"))
    pct = lambda c: F.lpad(F.format_string("%.1f", 100 * F.col(c)), 7, " ")
    return per.join(scores, id_col).select(id_col, F.concat(F.rpad(F.col(id_col).cast("string"), 12, " "), pct("overall"), pct("shape"), F.col("cells")).alias("line"))


# -- validation


def validate(docs: DataFrame, id_col: str, text: str, frames: bool = True, signatures: bool = True, columns_property: bool = False) -> DataFrame:
    """(id, code, severity, path): the rules that each document breaks."""
    of = lambda i, t: ({id_col: i, "code": c, "severity": s, "path": p} for c, s, p in K.validate(t, frames, signatures, columns_property))
    return B.rows_of(docs, id_col, text, f"{id_col} bigint, code string, severity string, path string", of)


def lint(docs: DataFrame, id_col: str, text: str, max_line: int = 2200) -> DataFrame:
    """(id, code, line): long lines, fences that don't balance, leaked server markup."""
    return B.rows_of(docs, id_col, text, f"{id_col} bigint, code string, line int", lambda i, t: ({id_col: i, "code": c, "line": n} for c, n in K.lint(t, max_line)))


# -- differences


def align(a: list, b: list, similarity, gap: float = 0.325) -> list[tuple[int | None, int | None]]:
    """Global alignment of least cost; ties go to substitution, then deletion, then insertion.

    What two sides share at their start and end is paired off first, and each similarity is computed once.  At the end, where the
    path is read from, what is wholly alike is shared, wherever it stands: pairing it costs nothing, so that no path is better, and ties go to it.
    """
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and ((p := a[n - 1 - tail]) == (q := b[m - 1 - tail]) or similarity(p, q) == 1):
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    cost = [[j * gap for j in range(len(y) + 1)]]
    back = [[2] * (len(y) + 1)]
    for i, p in enumerate(x):
        above, row, moves = cost[-1], [(i + 1) * gap], [1]
        for j, q in enumerate(y):
            options = (above[j] + 1 - similarity(p, q), above[j + 1] + gap, row[j] + gap)
            least = min(options)
            row.append(least)
            moves.append(next(k for k, c in enumerate(options) if c <= least + 1e-9))
        cost.append(row)
        back.append(moves)
    path: list[tuple[int | None, int | None]] = [(n - 1 - k, m - 1 - k) for k in range(tail)]
    i, j = len(x), len(y)
    while i or j:
        move = back[i][j] if i and j else 1 if i else 2
        i, j = i - (move < 2), j - (move != 1)
        path.append((head + i if move < 2 else None, head + j if move != 1 else None))
    return path[::-1] if not head else [*((k, k) for k in range(head)), *path[::-1]]


def similar(a: dict, b: dict) -> float:
    """0 for blocks of different kinds, else how alike their texts are, or their targets if these are more so; directives also need their name."""
    if a["kind"] != b["kind"] or (a["kind"] == "directive" and a["name"] != b["name"]):
        return 0.0
    if a["kind"] == "rule":
        return 1.0
    if a["kind"] == "directive":
        keys = set(a["props"]) | set(b["props"])
        return 1.0 if not keys else sum(a["props"].get(k) == b["props"].get(k) for k in keys) / len(keys)
    if a["text"] == b["text"]:
        return 1.0
    ta, tb = _tokens(a), _tokens(b)
    return max(_dice(ta[0], ta[1], tb[0], tb[1]), 0.9 if ta[2] and ta[2] == tb[2] else 0.0)


def _tokens(block: dict) -> tuple[list[str], set, tuple[str, ...]]:
    """Words, pairs of words and link targets of a block, kept with it."""
    if "tokens" not in block:
        text = block["text"]
        words = K.normalized(K.plain(text)).split()
        block["tokens"] = words, set(zip(words, words[1:])), tuple(sorted(K.target(m[2]) for p in (K.LINK, K.IMAGE) for m in p.finditer(text)))
    return block["tokens"]


def _dice(wa: list[str], pa: set, wb: list[str], pb: set) -> float:
    if not wa or not wb:
        return float(not wa and not wb)
    if len(wa) < 2 or len(wb) < 2:
        return len(set(wa) & set(wb)) / len(set(wa) | set(wb))
    return 2 * len(pa & pb) / (len(pa) + len(pb))


def homes(blocks: list[dict]) -> dict[str, str]:
    """Where each text of a document stands: folded text -> place; the strongest place wins."""
    found: dict[str, str] = {}

    def put(text: str, place: str) -> None:
        key = K.normalized(K.plain(text))
        if key and (key not in found or PLACES.index(place) < PLACES.index(found[key])):
            found[key] = place

    names = {b["path"]: b["name"] for b in blocks if b["kind"] == "directive"}
    for b in blocks:
        inside = names.get(b["parent"], "")
        kind, text = b["kind"], b["text"]
        if kind == "directive":
            put(b["props"].get("caption", ""), "caption-echo")
            continue
        if kind == "table-row":
            for cell in K.cells_of(b):
                put(cell, "in-table")
            continue
        place = {"heading": "in-heading", "list-item": "in-nav" if inside == "nav" else "in-list", "quote": "in-quote"}.get(kind, "in-align" if inside == "align" else "in-paragraph")
        put(text, place)
        if "\\\n" in text:
            for line in text.split("\\\n"):
                put(line, "in-break-run")
    return found


PLACES = ("in-paragraph", "in-break-run", "in-heading", "in-list", "in-table", "in-quote", "caption-echo", "in-nav", "in-align")


def home_of(text: str, places: dict[str, str]) -> str:
    """Where another document has a text: one of PLACES, absorbed by a longer text (three words and more), or unattested."""
    key = K.normalized(K.plain(text))
    if key in places:
        return places[key]
    if len(key.split()) >= 3 and any(f" {key} " in f" {host} " for host in places):
        return "absorbed"
    return "unattested"


def text_homes(pairs: DataFrame, id_col: str, produced: str, reference: str) -> DataFrame:
    """(id, path, text, home): the texts of the reference that the produced document hasn't as such, and where it has them."""

    def of(i: int, p: str | None, r: str | None):
        places, theirs = homes(M.read(p)[0]), M.read(r)[0]
        for b in theirs:
            if b["kind"] in ("paragraph", "heading", "list-item", "quote"):
                home = home_of(b["text"], places)
                own = homes([b]).get(K.normalized(K.plain(b["text"])))
                if own and home != own:
                    yield {id_col: i, "path": b["path"], "text": b["text"], "home": home}

    return B.rows_of(pairs, id_col, [produced, reference], f"{id_col} bigint, path string, text string, home string", of)


def self_echo(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, path, caption): captions whose words a document repeats in a paragraph."""

    def of(i: int, t: str | None):
        blocks = M.read(t)[0]
        said = {K.normalized(K.plain(b["text"])) for b in blocks if b["kind"] == "paragraph"}
        return ({id_col: i, "path": b["path"], "caption": b["props"]["caption"]} for b in blocks if b["kind"] == "directive" and K.normalized(b["props"].get("caption", "")) in said - {""})

    return B.rows_of(docs, id_col, text, f"{id_col} bigint, path string, caption string", of)


ALLOWED = {
    "align": {"position"}, "anchor": {"id"}, "columns": set(), "document": {"src", "title", "mode"}, "frame": {"frame", "title"}, "image": {"src", "position", "size", "alt", "caption", "link", "frame"}, "images": {"columns", "frame"},
    "nav": {"title", "active"}, "column": set(), "lead": set(), "signature": set(),
}


def off_profile(docs: DataFrame, id_col: str, text: str, columns_property: bool = False) -> DataFrame:
    """(id, path, name, property): properties that the target doesn't know."""
    more = {"columns", "divider"} if columns_property else set()

    def of(i: int, t: str | None):
        for b in M.read(t)[0]:
            if b["kind"] == "directive" and b["name"] in ALLOWED:
                for key in sorted(set(b["props"]) - ALLOWED[b["name"]] - (more if b["name"] == "columns" else set())):
                    yield {id_col: i, "path": b["path"], "name": b["name"], "property": key}

    return B.rows_of(docs, id_col, text, f"{id_col} bigint, path string, name string, property string", of)


def rendered(docs: DataFrame, id_col: str, text: str, title: str | None = None, base: str = "/pages") -> DataFrame:
    """(id, html): every document as a page."""
    from quire.functions.render import render

    columns = [text, title] if title else [text]
    return B.rows_of(docs, id_col, columns, f"{id_col} bigint, html string", lambda i, t, *more: [{id_col: i, "html": render(t, more[0] or "" if more else "", base)}])


def render_ledger(ledger: DataFrame, most: int = 30) -> DataFrame:
    """(place, line): the most urgent classes of a defect ledger, one line of fixed width each."""
    top = ledger.orderBy(F.desc("rank"), F.desc("instances"), "class").limit(most)
    line = F.concat(F.rpad("class", 32, " "), F.rpad("severity", 10, " "), *[F.lpad(F.col(c).cast("string"), 9, " ") for c in ("instances", "documents", "defects", "rank")])
    place = F.row_number().over(Window.orderBy(F.desc("rank"), F.desc("instances"), "class"))
    return top.select(place.alias("place"), line.alias("line"))


def compared(p: dict, r: dict) -> list[tuple[str, str]]:
    """(class, severity) of what differs between two blocks of one kind that were paired."""
    out = []
    if p["kind"] == "list-item":
        out += [("list.kind", "major")] if p["name"] != r["name"] else []
        out += [("list.depth", "minor")] if p["depth"] != r["depth"] else []
    if p["text"] == r["text"]:
        return out
    if p["kind"] == "table-row":
        a, b = K.cells_of(p), K.cells_of(r)
        return [*out, *([("table.columns", "major")] if len(a) != len(b) else [("table.cell", "minor")] * sum(x != y for x, y in zip(a, b)))]
    if K.normalized(K.plain(p["text"])) != K.normalized(K.plain(r["text"])):
        return [*out, ("text", "minor")]
    count = lambda t, sign: len(re.findall(sign, t))
    if _tokens(p)[2] != _tokens(r)[2]:
        out.append(("inline.refs", "major"))
    if count(p["text"], r"\\\n") != count(r["text"], r"\\\n"):
        out.append(("lineation", "minor"))
    if any(count(p["text"], sign) != count(r["text"], sign) for sign in (r"(?<!\\)\*", r"~~", "==")):
        out.append(("inline.emphasis", "minor"))
    return out or [("text", "minor")]


def diff(produced: str | None, reference: str | None) -> list[dict]:
    """Findings of a pair of documents: blocks missing, extra, moved, or that differ."""
    a, b = M.read(produced)[0], M.read(reference)[0]
    pairs = align(a, b, similar)
    found, lost, extra = [], [], []
    for i, j in pairs:
        if i is not None and j is not None and similar(a[i], b[j]) > 0:
            p, r = a[i], b[j]
            if p["kind"] == "heading" and p["depth"] != r["depth"]:
                found.append(("heading.depth", "major", p, r))
            if p["kind"] == "directive":
                found += [(f"directive.{k}", "major", p, r) for k in sorted(set(p["props"]) | set(r["props"])) if p["props"].get(k) != r["props"].get(k)]
            else:
                found += [(what, severity, p, r) for what, severity in compared(p, r)]
        else:
            if i is not None:
                extra.append(a[i])
            if j is not None:
                lost.append(b[j])
    # the same content elsewhere: paired by similarity, greatest first
    candidates = sorted(((similar(p, r), -x, -y) for x, p in enumerate(extra) for y, r in enumerate(lost) if similar(p, r) >= 0.65), reverse=True)
    used_p, used_r = set(), set()
    for _, x, y in candidates:
        if -x not in used_p and -y not in used_r:
            used_p.add(-x)
            used_r.add(-y)
            found.append(("order.moved", "major", extra[-x], lost[-y]))
    found += [(f"extra.{p['kind']}", "major", p, None) for x, p in enumerate(extra) if x not in used_p]
    found += [(f"missing.{r['kind']}", "critical", None, r) for y, r in enumerate(lost) if y not in used_r]
    return [{"class": c, "severity": s, "path": (p or r)["path"], "produced": p["text"] if p else None, "reference": r["text"] if r else None} for c, s, p, r in found]


FINDINGS = "class string, severity string, path string, produced string, reference string"


def diff_documents(pairs: DataFrame, id_col: str, produced: str, reference: str) -> DataFrame:
    """(id, finding_id, FINDINGS): how each produced document differs from its reference; equal documents have no row."""
    schema = f"{id_col} bigint, finding_id string, {FINDINGS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, p, r in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seen = set()
                for f in diff(p, r):
                    key = T.fnv1a32_of(f"{i}|{f['class']}|{f['path']}|{(f['reference'] or f['produced'] or '')[:160]}")
                    if key not in seen:
                        seen.add(key)
                        rows.append((i, key, f["class"], f["severity"], f["path"], f["produced"], f["reference"]))
            names = [id_col, "finding_id", "class", "severity", "path", "produced", "reference"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.string()) for k in range(7)], names)

    return pairs.select(F.col(id_col).cast("bigint"), produced, reference).mapInArrow(run, schema)


def triage(findings: DataFrame, sources: DataFrame, id_col: str) -> DataFrame:
    """findings with coverage and verdict: is what differs attested by the source (id, source)?

    A missing text that the source has (coverage at least 0.95) is a defect of the converter, one that it lacks (at most
    0.5) an inconsistency of the reference; an extra text the other way round; typography alone is acceptable.
    """
    src = sources.select(F.col(id_col).alias(id_col), T.words_of(T.normalize_for_compare("source")).alias("src"))
    f = findings.join(src, id_col, "left").withColumn("needle", T.words_of(T.normalize_for_compare(F.coalesce("reference", "produced"))))
    f = f.withColumn("coverage", F.when(F.size("needle") == 0, 0.0).otherwise(F.size(F.array_intersect("needle", "src")) / F.size(F.array_distinct("needle"))))
    same = T.normalize_for_compare("produced") == T.normalize_for_compare("reference")
    missing, extra = F.col("class").startswith("missing."), F.col("class").startswith("extra.")
    verdict = (
        F.when((F.col("class") == "text") & same, "acceptable-alternative")
        .when(missing & (F.col("coverage") >= 0.95), "converter-defect")
        .when(missing & (F.col("coverage") <= 0.5), "reference-inconsistency")
        .when(extra & (F.col("coverage") >= 0.95), "reference-inconsistency")
        .when(extra & (F.col("coverage") <= 0.5), "converter-defect")
        .when(missing | extra, "ambiguous")
        .otherwise("converter-defect")
    )
    return f.withColumn("verdict", verdict).drop("src", "needle")


def severity_weight(severity: Column) -> Column:
    return F.when(severity == "critical", 5).when(severity == "major", 3).otherwise(1)


def defect_ledger(findings: DataFrame) -> DataFrame:
    """(class, severity, instances, documents, four verdict counts, rank), most urgent first when ordered by rank, instances, class."""
    v = lambda name: F.sum((F.col("verdict") == name).cast("int"))
    worst = F.max(severity_weight(F.col("severity")))
    per = findings.groupBy("class").agg(
        worst.alias("w"), F.count("*").alias("instances"), F.countDistinct("doc").alias("documents"), v("converter-defect").alias("defects"), v("acceptable-alternative").alias("acceptable"), v("reference-inconsistency").alias("inconsistent"), v("ambiguous").alias("ambiguous")
    )
    severity = F.when(F.col("w") == 5, "critical").when(F.col("w") == 3, "major").otherwise("minor")
    return per.select("class", severity.alias("severity"), "instances", "documents", "defects", "acceptable", "inconsistent", "ambiguous", (F.col("defects") * F.col("w") * F.col("documents")).alias("rank"))


def ledger_by_document(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, findings, defects, critical, major, minor) for all documents, those without findings included."""
    n = lambda c: F.sum(c.cast("int"))
    per = findings.groupBy("doc").agg(
        F.count("*").alias("findings"), n(F.col("verdict") == "converter-defect").alias("defects"), n(F.col("severity") == "critical").alias("critical"), n(F.col("severity") == "major").alias("major"), n(F.col("severity") == "minor").alias("minor")
    )
    return docs.select("doc").join(per, "doc", "left").fillna(0)

"""Documents, evaluation, layout and bookkeeping over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import text as T
from quire.operators import decisions as B, documents as D, layout as L
from quire.plans.registry import query
from quire.plans.text_queries import norm, sh
from quire.sources import tables


def region_docs(load, changed: bool = False) -> DataFrame:
    """A document for each region: title, a table of nations, a link each, an image."""
    n = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("nm", F.translate("n_name", "_", " "))
    per = n.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "nm"))).alias("x"))
    rows = F.expr("filter(x, r -> r.n_nationkey % 2 = 0)") if changed else F.col("x")
    table = F.concat(F.lit("| key | name |\n| --- | :-: |\n"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), r["n_nationkey"], F.lit(" | "), r["nm"], F.lit(" |"))), "\n"))
    links = F.array_join(F.transform("x", lambda r: F.concat(F.lit("- [go "), r["n_nationkey"], F.lit("](/n/"), r["n_nationkey"], F.lit(")"))), "\n")
    image = "" if changed else "\n\n::: image\nsrc: pages/a.jpg\nposition: left\nsize: small\n:::\n\n"
    md = F.concat(F.lit("# "), F.col("r_name"), F.lit(" region\n\n" + (image or "\n\n") + "## Nations\n\n"), table, F.lit("\n\n"), links, F.lit("\n"))
    return per.select(F.col("r_regionkey").cast("bigint").alias("doc"), md.alias("md"))


@query("""SELECT n_regionkey::BIGINT AS doc, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS "row", n_nationkey::VARCHAR AS key, replace(n_name, '_', ' ') AS name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def md_table_cells(load, spark) -> DataFrame:
    b = D.read_blocks(region_docs(load), "doc", "md").where("kind = 'table-row' AND depth > 0")
    c = F.split("text", "\x1f")
    return b.select("doc", F.col("depth").cast("bigint").alias("row"), c[0].alias("key"), c[1].alias("name"))


@query("""WITH n AS (SELECT r_regionkey::BIGINT AS doc, count(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
 SELECT doc, 'headings' AS axis, 2 AS n FROM n UNION ALL SELECT doc, 'links', c FROM n UNION ALL SELECT doc, 'images', 1 FROM n UNION ALL SELECT doc, 'directives', 1 FROM n UNION ALL SELECT doc, 'cells', 2 * c FROM n""")
def md_facts(load, spark) -> DataFrame:
    return D.facts(region_docs(load), "doc", "md").groupBy("doc", "axis").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT r_regionkey::BIGINT AS doc, count(*) AS c, sum((n_nationkey % 2 = 0)::INT) AS e FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
 a AS (SELECT doc, 'headings' AS axis, 2.0 AS x, 2.0 AS y, 2.0 AS m FROM n UNION ALL SELECT doc, 'links', c, c, c FROM n UNION ALL SELECT doc, 'images', 1, 0, 0 FROM n UNION ALL SELECT doc, 'directives', 1, 0, 0 FROM n UNION ALL SELECT doc, 'cells', 2 * c, 2 * e, 2 * e FROM n)
 SELECT doc, axis, x::BIGINT AS expected, y::BIGINT AS actual, m::BIGINT AS matched, round(m / x, 6) AS recall, round(CASE WHEN y = 0 THEN 0 ELSE m / y END, 6) AS "precision", round(CASE WHEN m = 0 THEN 0 ELSE 2 * m / (x + y) END, 6) AS f1 FROM a""")
def axis_scores(load, spark) -> DataFrame:
    pairs = region_docs(load).join(region_docs(load, True).withColumnRenamed("md", "made"), "doc")
    s = D.axis_scores(pairs, "doc", "md", "made").where("axis <> 'text'").drop("missing")
    return s.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


@query("SELECT r_regionkey::BIGINT AS doc, 1.0::DOUBLE AS shape, 1.0::DOUBLE AS overall FROM region")
def overall_score_identity(load, spark) -> DataFrame:
    """A document scored against itself."""
    s = D.overall_scores(region_docs(load).withColumn("same", F.col("md")), "doc", "md", "same")
    return s.select("doc", F.round("shape", 6).alias("shape"), F.round("overall", 6).alias("overall"))


@query("""WITH n AS (SELECT r_regionkey::BIGINT AS doc, count(*) AS c, sum((n_nationkey % 2 = 0)::INT) AS e FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT doc, round(0.5 + 0.5 * e / c, 6) AS shape FROM n""")
def table_shape_agreement(load, spark) -> DataFrame:
    pairs = region_docs(load).join(region_docs(load, True).withColumnRenamed("md", "made"), "doc")
    return D.overall_scores(pairs, "doc", "md", "made").select("doc", F.round("shape", 6).alias("shape"))


def order_lists(load) -> DataFrame:
    """For each customer with orders a document that lists them with their links (md), and one that lacks every third (made)."""
    o = tables.spread(load("orders").select("o_custkey", "o_orderkey"), "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    text = lambda keys: F.concat(F.lit("# Customer "), "o_custkey", F.lit("\n\nAll of the orders that are known are listed here\n\n"), F.array_join(F.transform(keys, lambda x: F.concat(F.lit("- [order "), x, F.lit("](/o/"), x, F.lit(")"))), "\n"), F.lit("\n"))
    return o.select(F.col("o_custkey").alias("doc"), text("k").alias("md"), text(F.filter("k", lambda x: x % 3 != 0)).alias("made"))


LISTS = """o AS (SELECT o_custkey AS doc, list_sort(list(o_orderkey)) AS k, list_filter(list_sort(list(o_orderkey)), lambda x: x % 3 <> 0) AS m FROM orders GROUP BY 1),
 t AS (SELECT doc, k, m, string_split('customer ' || doc || ' all of the orders that are known are listed here' || array_to_string(list_transform(k, lambda x: ' order ' || x), ''), ' ') AS w, string_split('customer ' || doc || ' all of the orders that are known are listed here' || array_to_string(list_transform(m, lambda x: ' order ' || x), ''), ' ') AS v FROM o)"""


@query(f"""WITH {LISTS}, a AS (SELECT doc, item, count(*) AS a FROM (SELECT doc, unnest({sh('w')}) AS item FROM t) GROUP BY ALL), b AS (SELECT doc, item, count(*) AS b FROM (SELECT doc, unnest({sh('v')}) AS item FROM t) GROUP BY ALL),
 x AS (SELECT doc, sum(a) AS e, sum(b) AS n, sum(least(a, b)) AS m FROM (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.doc = b.doc AND a.item = b.item) GROUP BY doc)
 SELECT x.doc, 1.0 AS shape, round(0.3 * 2 * x.m / (x.e + x.n) + 0.15 * (CASE WHEN len(t.m) = 0 THEN 0 ELSE 2 * len(t.m) / (len(t.k) + len(t.m)) END) + 0.55, 6) AS overall FROM x JOIN t ON x.doc = t.doc""")
def overall_score(load, spark) -> DataFrame:
    """Documents scored against those that lack a third of their list."""
    return D.overall_scores(order_lists(load), "doc", "md", "made").select("doc", "shape", F.round("overall", 6).alias("overall"))


@query(f"WITH {LISTS} SELECT doc, 'missing.list-item' AS class, 'critical' AS severity, len(k) - len(m) AS n FROM t WHERE len(k) > len(m)")
def missing_items(load, spark) -> DataFrame:
    """What the shorter documents lack, to the item: the alignment pairs all others."""
    return D.diff_documents(order_lists(load), "doc", "made", "md").groupBy("doc", "class", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {LISTS}, s AS (SELECT count(*) AS documents FROM t) SELECT documents, 1.0 AS mean, 1.0 AS least FROM s")
def corpus_score(load, spark) -> DataFrame:
    """The mean over a corpus of documents scored against themselves."""
    s = D.corpus_score(D.overall_scores(order_lists(load).withColumn("same", F.col("md")), "doc", "md", "same"))
    return s.select("documents", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"))


@query("""SELECT p_partkey AS doc, '<h1 data-path="/0" data-line="1" data-kind="heading">' || p_name || '</h1>' || chr(10) || '<p data-path="/1" data-line="3" data-kind="paragraph">made by <strong>' || p_brand || '</strong>, <a href="/#/' || p_partkey || '">a &amp; b</a></p>' || chr(10)
 || '<ul data-path="/2" data-line="5" data-kind="list">' || chr(10) || '<li data-path="/2" data-line="5" data-kind="item">' || p_type || '</li>' || chr(10) || '<li data-path="/3" data-line="6" data-kind="item">size ' || p_size || '</li>' || chr(10) || '</ul>' || chr(10)
 || '<div class="align" data-path="/4" data-line="8" data-kind="align" data-position="right">' || chr(10) || '<p data-path="/4/0" data-line="11" data-kind="paragraph">signed</p>' || chr(10) || '</div>' AS article FROM part""")
def rendered_documents(load, spark) -> DataFrame:
    """Documents as HTML, with the path and line of each block."""
    md = F.concat(F.lit("# "), "p_name", F.lit("\n\nmade by **"), "p_brand", F.lit("**, [a & b](/#/"), "p_partkey", F.lit(")\n\n- "), "p_type", F.lit("\n- size "), "p_size", F.lit("\n\n::: align\nposition: right\n\nsigned\n:::\n"))
    html = D.rendered(tables.spread(load("part")).select(F.col("p_partkey").alias("doc"), md.alias("md")), "doc", "md")
    return html.select("doc", F.regexp_extract("html", r'(?s)<article class="document-page">\n(.*)\n</article>', 1).alias("article"))


@query("""SELECT p_partkey AS doc, CASE p_partkey % 6 WHEN 0 THEN 'in-heading' WHEN 1 THEN 'in-list' WHEN 2 THEN 'in-table' WHEN 3 THEN 'caption-echo' WHEN 4 THEN 'absorbed' ELSE 'unattested' END AS home FROM part""")
def text_homes(load, spark) -> DataFrame:
    """Where the produced document has a paragraph of its reference."""
    k, t = F.col("p_partkey") % 6, F.concat(F.lit("about the "), "p_name")
    made = F.when(k == 0, F.concat(F.lit("# "), t)).when(k == 1, F.concat(F.lit("- "), t)).when(k == 2, F.concat(F.lit("| "), t, F.lit(" | b |\n| - | - |\n"))).when(k == 3, F.concat(F.lit("::: image\nsrc: a.png\ncaption: "), t, F.lit("\n:::"))).when(k == 4, F.concat(F.lit("all "), t, F.lit(" and more"))).otherwise("nothing of it")
    return D.text_homes(load("part").select(F.col("p_partkey").alias("doc"), made.alias("made"), t.alias("md")), "doc", "made", "md").select("doc", "home")


@query("""SELECT p_partkey AS doc, 'self-echo' AS class, p_name AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'off-profile', 'colour' FROM part WHERE p_partkey % 3 = 0""")
def echoes_and_strays(load, spark) -> DataFrame:
    """Captions that are said again, and properties that no target knows."""
    k = F.col("p_partkey")
    md = F.concat(F.lit("# t\n\n::: image\nsrc: a.png\nposition: left\nsize: small\ncaption: "), "p_name", F.when(k % 3 == 0, "\ncolour: red").otherwise(""), F.lit("\n:::\n\n"), F.when(k % 2 == 0, F.col("p_name")).otherwise("other words"), F.lit("\n"))
    docs = load("part").select(k.alias("doc"), md.alias("md"))
    echo = D.self_echo(docs, "doc", "md").select("doc", F.lit("self-echo").alias("class"), F.col("caption").alias("value"))
    return echo.unionByName(D.off_profile(docs, "doc", "md").select("doc", F.lit("off-profile").alias("class"), F.col("property").alias("value")))


BAD = [
    ("::: align\nposition: up\n\n::: frame\nframe: red\n\nx\n:::\n:::", ["align-position", "align-wraps-frame"]),
    ("::: image\nposition: left\nsize: huge\n:::", ["image-src", "image-size"]),
    ("::: images\ncolumns: 7\n\n::: image\nsrc: a\nsize: small\n:::\n:::", ["images-columns", "images-children", "image-grouped-layout"]),
    ("::: columns\n\n::: column\n\na\n:::\n:::", ["columns-arity"]),
    ("::: columns\ncolumns: 3\n\n::: column\n\na\n:::\n\n::: column\n\nb\n:::\n:::", ["columns-count-mismatch", "columns-property-unsupported"]),
    ("::: align\nposition: left\n\n::: nav\nactive: zz\n\n1. a\n2. b\n:::\n:::", ["nav-ordered", "nav-active", "nav-in-align"]),
    ("::: frame\nframe: pink\n\n::: frame\nframe: red\n\nx\n:::\n:::", ["frame-palette", "frame-nested"]),
    ("::anchor{#a}\n\n::anchor{#a}\n\n[x](#b) ==y", ["anchor-duplicate", "anchor-target-missing", "highlight-unbalanced"]),
    ("#### deep\n\n<b>raw</b>\n\n> ::: frame", ["heading-skips-level", "raw-html", "directive-inside-prefixed-block"]),
    ("| Field 1 | b |\n| - | - |\n| 1 |\n", ["table-header-placeholder", "table-ragged"]),
    ("a[^1] b\n\n[^2]: note", ["footnote-undefined", "footnote-unreferenced"]),
    ("# second\n\n::: document\nsrc: x\nmode: open\n:::", ["h1-count", "document-props", "document-mode"]),
    ("fine", []),
]


def bad_docs(load) -> DataFrame:
    k = F.col("p_partkey") % len(BAD)
    md = F.lit("")
    for i, (text, _) in enumerate(BAD):
        md = F.when(k == i, F.lit("# title\n\n" + text)).otherwise(md)
    return tables.spread(load("part")).select(F.col("p_partkey").alias("doc"), md.alias("md"))


@query("SELECT p_partkey AS doc, k.code FROM part JOIN (VALUES " + ", ".join(f"({i}, '{c}')" for i, (_, codes) in enumerate(BAD) for c in codes) + f") k(i, code) ON p_partkey % {len(BAD)} = k.i")
def validator_findings(load, spark) -> DataFrame:
    """Documents with known defects: exactly their codes are found."""
    return D.validate(bad_docs(load), "doc", "md").select("doc", "code")


@query("""WITH k AS (SELECT p_partkey AS doc, p_partkey % 4 AS k FROM part) SELECT doc, 'fence-unbalanced' AS code, CASE k WHEN 1 THEN 6 ELSE 4 END AS line FROM k WHERE k IN (1, 2) UNION ALL SELECT doc, 'server-markup-leaked', 0 FROM k WHERE k = 3 UNION ALL SELECT doc, 'line-too-long', 3 FROM k WHERE k = 3""")
def fence_balance(load, spark) -> DataFrame:
    k = F.col("p_partkey") % 4
    ok = "::: align\nposition: left\n:::\n"
    md = F.when(k == 0, ok + ok).when(k == 1, ok + "::: frame\nx\n").when(k == 2, ok + ":::\n" + ok).otherwise(F.concat(F.lit("<?php x ?>\n\n"), F.repeat(F.lit("y"), 2300)))
    return D.lint(tables.spread(load("part")).select(F.col("p_partkey").alias("doc"), md.alias("md")), "doc", "md").select("doc", "code", "line")


@query("SELECT doc_id, (doc_id % 2)::BIGINT AS findings FROM documents")
def diff_identity(load, spark) -> DataFrame:
    """No document differs from itself; one with a heading added differs by that."""
    d = load("documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("t"))
    u = d.withColumn("u", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("# an added heading of its own\n\n"), "t")).otherwise(F.col("t")))
    found = D.diff_documents(u, "doc_id", "u", "t").groupBy("doc_id").agg(F.count("*").alias("findings"))
    return d.select("doc_id").join(found, "doc_id", "left").fillna(0)


@query("""WITH r AS (SELECT r_regionkey::BIGINT AS doc, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
 SELECT doc, 'missing.directive' AS class, 'critical' AS severity, count(DISTINCT doc) AS n FROM r GROUP BY doc UNION ALL SELECT doc, 'missing.table-row', 'critical', sum((n_nationkey % 2)::INT) FROM r GROUP BY doc HAVING sum((n_nationkey % 2)::INT) > 0""")
def diff_findings(load, spark) -> DataFrame:
    """Documents without an image and every other table row, against the whole ones."""
    pairs = region_docs(load).join(region_docs(load, True).withColumnRenamed("md", "made"), "doc")
    return D.diff_documents(pairs, "doc", "made", "md").groupBy("doc", "class", "severity").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS doc, k.class, k.produced, k.reference FROM part JOIN (VALUES (0, 'text', 'one two three four', 'one two three five'), (1, 'order.moved', 'alpha beta gamma delta', 'alpha beta gamma delta'), (2, 'heading.depth', 'A title', 'A title'), (3, 'missing.paragraph', NULL, 'lost words of it')) k(i, class, produced, reference) ON p_partkey % 4 = k.i""")
def nw_alignment(load, spark) -> DataFrame:
    """Pairs of documents that differ in one way each: an edited text, a moved paragraph, a heading's depth, a lost paragraph."""
    k = F.col("p_partkey") % 4
    made = F.when(k == 0, "# t\n\none two three four\n\nlast").when(k == 1, "alpha beta gamma delta\n\none of them\n\nand another one").when(k == 2, "# A title\n\nx").otherwise("# t\n\nx")
    md = F.when(k == 0, "# t\n\none two three five\n\nlast").when(k == 1, "one of them\n\nand another one\n\nalpha beta gamma delta").when(k == 2, "## A title\n\nx").otherwise("# t\n\nlost words of it\n\nx")
    return D.diff_documents(load("part").select(F.col("p_partkey").alias("doc"), made.alias("made"), md.alias("md")), "doc", "made", "md").select("doc", "class", "produced", "reference")


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN {norm('text')} = '' THEN 'reference-inconsistency' ELSE 'converter-defect' END WHEN 1 THEN 'reference-inconsistency' WHEN 2 THEN 'acceptable-alternative' ELSE 'converter-defect' END AS verdict FROM documents""")
def triage_verdicts(load, spark) -> DataFrame:
    k = F.col("doc_id") % 4
    d = load("documents")
    f = d.select(
        "doc_id",
        F.when(k < 2, "missing.paragraph").when(k == 2, "text").otherwise("extra.paragraph").alias("class"),
        F.when(k == 2, F.upper("text")).when(k == 3, F.lit("zzqqx yyqqx")).alias("produced"),
        F.when(k == 0, F.col("text")).when(k == 1, F.lit("zzqqx wwqqx")).when(k == 2, F.upper("text")).alias("reference"),
    )
    return D.triage(f, d.select("doc_id", F.col("text").alias("source")), "doc_id").select("doc_id", "verdict")


FINDINGS = "f AS (SELECT event_type AS class, user_id AS doc, CASE WHEN value > 80 THEN 'critical' WHEN value > 40 THEN 'major' ELSE 'minor' END AS severity, ['converter-defect', 'acceptable-alternative', 'reference-inconsistency', 'ambiguous'][1 + event_id % 4] AS verdict FROM events)"


def event_findings(load) -> DataFrame:
    v = F.array(*map(F.lit, ("converter-defect", "acceptable-alternative", "reference-inconsistency", "ambiguous")))
    severity = F.when(F.col("value") > 80, "critical").when(F.col("value") > 40, "major").otherwise("minor")
    return load("events").select(F.col("event_type").alias("class"), F.col("user_id").alias("doc"), severity.alias("severity"), F.element_at(v, (F.col("event_id") % 4 + 1).cast("int")).alias("verdict"))


@query(f"""WITH {FINDINGS}, g AS (SELECT class, max(CASE severity WHEN 'critical' THEN 5 WHEN 'major' THEN 3 ELSE 1 END) AS w, count(*) AS instances, count(DISTINCT doc) AS documents, count(*) FILTER (verdict = 'converter-defect') AS defects, count(*) FILTER (verdict = 'acceptable-alternative') AS acceptable,
 count(*) FILTER (verdict = 'reference-inconsistency') AS inconsistent, count(*) FILTER (verdict = 'ambiguous') AS ambiguous FROM f GROUP BY class)
 SELECT class, CASE w WHEN 5 THEN 'critical' WHEN 3 THEN 'major' ELSE 'minor' END AS severity, instances, documents, defects, acceptable, inconsistent, ambiguous, defects * w * documents AS rank FROM g""")
def defect_ledger(load, spark) -> DataFrame:
    return D.defect_ledger(event_findings(load))


@query(f"""WITH {FINDINGS}, d AS (SELECT c_custkey AS doc FROM customer) SELECT d.doc, count(f.doc) AS findings, count(*) FILTER (verdict = 'converter-defect') AS defects, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor FROM d LEFT JOIN f ON d.doc = f.doc GROUP BY d.doc""")
def ledger_by_document(load, spark) -> DataFrame:
    return D.ledger_by_document(event_findings(load), load("customer").select(F.col("c_custkey").alias("doc")))


@query(f"WITH {FINDINGS} SELECT class, doc, verdict FROM f WHERE starts_with(class, 'p') AND doc IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND verdict = 'ambiguous'")
def finding_filters(load, spark) -> DataFrame:
    """By class prefix, verdict, and the documents of a list."""
    listed = load("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc"))
    found = event_findings(load).where(F.col("class").startswith("p") & (F.col("verdict") == "ambiguous"))
    return found.join(listed, "doc", "left_semi").select("class", "doc", "verdict")


@query(f"""WITH {FINDINGS}, g AS (SELECT class, max(CASE severity WHEN 'critical' THEN 5 WHEN 'major' THEN 3 ELSE 1 END) AS w, count(*) AS i, count(DISTINCT doc) AS d, count(*) FILTER (verdict = 'converter-defect') AS x FROM f GROUP BY class),
 r AS (SELECT *, x * w * d AS rank, row_number() OVER (ORDER BY x * w * d DESC, i DESC, class) AS place FROM g)
 SELECT place::INT AS place, rpad(class, 32, ' ') || rpad(CASE w WHEN 5 THEN 'critical' WHEN 3 THEN 'major' ELSE 'minor' END, 10, ' ') || lpad(i::VARCHAR, 9, ' ') || lpad(d::VARCHAR, 9, ' ') || lpad(x::VARCHAR, 9, ' ') || lpad(rank::BIGINT::VARCHAR, 9, ' ') AS line FROM r WHERE place <= 30""")
def ledger_lines(load, spark) -> DataFrame:
    """The thirty most urgent classes, as lines."""
    return D.render_ledger(D.defect_ledger(event_findings(load)))


ALIGNED = "b AS (SELECT user_id AS page, (event_id % 400)::BIGINT AS text_len, ['left', 'right', 'center', 'justify'][1 + (event_id * 7 + user_id) % 4] AS align FROM events)"


def aligned(load) -> DataFrame:
    a = F.array(*map(F.lit, ("-moz-left", "END", "centre", "justify")))
    return load("events").select(F.col("user_id").alias("page"), (F.col("event_id") % 400).alias("text_len"), L.fold_text_align(F.element_at(a, ((F.col("event_id") * 7 + F.col("user_id")) % 4 + 1).cast("int"))).alias("align"))


MODE = f"{ALIGNED}, g AS (SELECT page, align, sum(text_len) AS w, count(*) AS n, sum(count(*)) OVER (PARTITION BY page) AS a FROM b WHERE text_len >= 120 GROUP BY page, align), m AS (SELECT page, align FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w DESC, CASE align WHEN 'left' THEN 0 WHEN 'justify' THEN 1 WHEN 'center' THEN 2 ELSE 3 END) AS k FROM g WHERE a >= 2) WHERE k = 1)"


@query(f"WITH {MODE} SELECT * FROM m")
def prose_alignment_mode(load, spark) -> DataFrame:
    return L.prose_alignment(aligned(load), "page")


@query(f"WITH {MODE} SELECT b.page, count(*) FILTER (CASE WHEN m.align IS NULL THEN b.align IN ('center', 'right') ELSE replace(b.align, 'justify', 'left') <> replace(m.align, 'justify', 'left') END) AS distinctive, count(*) AS n FROM b LEFT JOIN m ON b.page = m.page GROUP BY b.page")
def distinctive_alignment(load, spark) -> DataFrame:
    b = aligned(load)
    m = L.prose_alignment(b, "page").withColumnRenamed("align", "base")
    d = b.join(m, "page", "left").withColumn("d", L.distinctive_align(F.col("align"), F.col("base")))
    return d.groupBy("page").agg(F.sum(F.col("d").cast("int")).alias("distinctive"), F.count("*").alias("n"))


BOXES = "x AS (SELECT user_id AS page, event_id AS id, (event_id * 37 % 900)::DOUBLE AS x, (event_id * 53 % 2000)::DOUBLE AS y, (20 + event_id % 60)::DOUBLE AS w, (10 + event_id % 17)::DOUBLE AS h FROM events)"


def boxes(load) -> DataFrame:
    e = F.col("event_id")
    return load("events").select(F.col("user_id").alias("page"), e.alias("id"), (e * 37 % 900).cast("double").alias("x"), (e * 53 % 2000).cast("double").alias("y"), (20 + e % 60).cast("double").alias("w"), (10 + e % 17).cast("double").alias("h"))


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, id) AS i FROM x),
 w AS (SELECT page, id, x, y, i, 0 AS band, y AS ay, h AS ah FROM o WHERE i = 1
  UNION ALL SELECT o.page, o.id, o.x, o.y, o.i, CASE WHEN least(o.y + o.h, w.ay + w.ah) - greatest(o.y, w.ay) > 0.5 * least(o.h, w.ah) THEN w.band ELSE w.band + 1 END,
   CASE WHEN least(o.y + o.h, w.ay + w.ah) - greatest(o.y, w.ay) > 0.5 * least(o.h, w.ah) THEN w.ay ELSE o.y END, CASE WHEN least(o.y + o.h, w.ay + w.ah) - greatest(o.y, w.ay) > 0.5 * least(o.h, w.ah) THEN w.ah ELSE o.h END FROM w JOIN o ON o.page = w.page AND o.i = w.i + 1)
 SELECT page, id, band, (row_number() OVER (PARTITION BY page ORDER BY band, x, y, id) - 1)::INT AS rank FROM w""")
def row_bands(load, spark) -> DataFrame:
    return L.row_bands(boxes(load), "page")


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, id) AS i FROM x),
 w AS (SELECT page, id, i, 0 AS lane, x AS ax, w AS aw FROM o WHERE i = 1 UNION ALL SELECT o.page, o.id, o.i, CASE WHEN least(o.x + o.w, w.ax + w.aw) - greatest(o.x, w.ax) > 0.5 * least(o.w, w.aw) THEN w.lane ELSE w.lane + 1 END,
  CASE WHEN least(o.x + o.w, w.ax + w.aw) - greatest(o.x, w.ax) > 0.5 * least(o.w, w.aw) THEN w.ax ELSE o.x END, CASE WHEN least(o.x + o.w, w.ax + w.aw) - greatest(o.x, w.ax) > 0.5 * least(o.w, w.aw) THEN w.aw ELSE o.w END FROM w JOIN o ON o.page = w.page AND o.i = w.i + 1)
 SELECT page, id, lane FROM w""")
def box_lanes(load, spark) -> DataFrame:
    return L.lanes(boxes(load), "page")


@query(f"""WITH {BOXES}, c AS (SELECT page, id, x, y, w, h, CASE WHEN id % 3 = 0 THEN 'right' END AS a, CASE WHEN id % 2 = 0 THEN 'right' END AS b FROM x), s AS (SELECT *, CASE WHEN abs(x) <= 4 AND abs(1000 - x - w) <= 4 THEN 'left' WHEN abs(x - (1000 - x - w)) <= 4 THEN 'center' WHEN abs(1000 - x - w) <= 4 THEN 'right' ELSE 'left' END AS shown FROM c)
 SELECT page, id AS block, 'layout.align.mismatch' AS class, coalesce(a, shown) AS produced, coalesce(b, shown) AS reference FROM s WHERE coalesce(a, shown) <> coalesce(b, shown)""")
def layout_findings(load, spark) -> DataFrame:
    """Two renderings of the same boxes that declare other alignments."""
    b = boxes(load).withColumnsRenamed({"id": "block"}).withColumns({"cx": F.lit(0.0), "cw": F.lit(1000.0)})
    side = lambda n: b.withColumn("text_align", F.when(F.col("block") % n == 0, "right"))
    return L.compare_layouts(side(3), side(2), "page")


@query(f"WITH {BOXES} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY floor(y / 100), x, y, id) - 1 AS rank FROM x")
def reading_ranks(load, spark) -> DataFrame:
    return L.reading_ranks(boxes(load).withColumn("band", F.floor(F.col("y") / 100)), "page").select("page", "id", "rank")


@query(f"WITH {BOXES} SELECT id, CASE WHEN greatest(50 - x, x + w - 850) > 1 THEN greatest(50 - x, x + w - 850) ELSE 0 END AS overflow, CASE WHEN abs(x - 50) <= 4 AND abs(850 - x - w) <= 4 THEN NULL WHEN abs((x - 50) - (850 - x - w)) <= 4 THEN 'center' WHEN abs(850 - x - w) <= 4 THEN 'right' ELSE 'left' END AS align FROM x")
def box_geometry(load, spark) -> DataFrame:
    c = (F.col("x"), F.col("w"), F.lit(50.0), F.lit(800.0))
    return boxes(load).select("id", L.overflow(*c).alias("overflow"), L.box_alignment(*c).alias("align"))


@query("""WITH v AS (SELECT p_partkey, p_size AS s, p_partkey % 5 AS k FROM part) SELECT p_partkey, round(CASE k WHEN 0 THEN s WHEN 1 THEN s * 4 / 3.0 WHEN 2 THEN s * 16 WHEN 3 THEN s * 0.16 END, 6) AS px, CASE greatest(1, least(7, CASE WHEN k = 0 THEN 3 + s % 5 WHEN k = 1 THEN 3 - s % 5 ELSE s % 9 END)) WHEN 1 THEN 10 WHEN 2 THEN 13 WHEN 3 THEN 16 WHEN 4 THEN 18 WHEN 5 THEN 24 WHEN 6 THEN 32 ELSE 48 END AS legacy FROM v""")
def font_sizes(load, spark) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size")
    css = F.concat(s, F.when(k == 0, "px").when(k == 1, "pt").when(k == 2, "EM").when(k == 3, "%").otherwise(" wide"))
    old = F.when(k == 0, F.concat(F.lit("+"), s % 5)).when(k == 1, F.concat(F.lit("-"), s % 5)).otherwise((s % 9).cast("string"))
    return load("part").select("p_partkey", F.round(L.css_px(css), 6).alias("px"), L.legacy_px(old).alias("legacy"))


@query("""WITH s AS (SELECT l_orderkey AS doc, list_sort(list(round(l_quantity / 16, 6)) FILTER (l_quantity * 10 >= 200)) AS s FROM lineitem GROUP BY 1) SELECT doc, CASE WHEN s IS NULL OR len(s) = 0 THEN 1 ELSE s[len(s) // 2 + 1] END AS baseline FROM s""")
def body_baseline(load, spark) -> DataFrame:
    b = load("lineitem").select(F.col("l_orderkey").alias("doc"), F.round(F.col("l_quantity") / 16, 6).alias("score"), (F.col("l_quantity") * 10).alias("text_len"))
    return L.body_baseline(b, "doc")


@query("""WITH b AS (SELECT o_custkey AS doc, o_orderkey AS ord, 'Label ' || o_orderkey AS text, round(1 + (o_orderkey % 7) / 10.0, 6) AS score, length('Label ' || o_orderkey) AS text_len FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, ord) AS k, max(score) OVER (PARTITION BY doc) AS top FROM b)
 SELECT doc, ord, CASE WHEN k = 1 AND score >= 1.25 THEN 1 ELSE 2 END AS depth FROM r WHERE (k = 1 AND score >= 1.25) OR (k > 1 AND score >= 1.12 AND (score < 0.98 * top OR top < 1.25))""")
def heading_recovery(load, spark) -> DataFrame:
    text = F.concat(F.lit("Label "), "o_orderkey")
    b = load("orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), text.alias("text"), F.round(1 + F.col("o_orderkey") % 7 / 10, 6).alias("score"), F.length(text).alias("text_len"))
    return L.headings(b, "doc")


@query("""WITH RECURSIVE d AS (SELECT conv_id, turn, 1 + (turn * 5 + conv_id) % 6 AS depth, row_number() OVER w AS i, min(CASE WHEN 1 + (turn * 5 + conv_id) % 6 = 1 THEN turn END) OVER (PARTITION BY conv_id) AS t1, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 c AS (SELECT conv_id, turn, depth, i, CASE WHEN turn = coalesce(t1, t0) THEN 1 ELSE greatest(2, depth) END AS d FROM d),
 w AS (SELECT conv_id, turn, depth, 0::BIGINT AS i, 0::BIGINT AS level, 1::BIGINT AS before, [0, 0, 0, 0, 0, 0]::BIGINT[] AS l FROM c WHERE i = 1
  UNION ALL SELECT c.conv_id, c.turn, c.depth, c.i, x.level, x.level, list_transform(range(1, 7), lambda k: CASE WHEN k = c.d AND w.l[k] = 0 AND c.d > w.before + 1 THEN w.before + 1 WHEN w.l[c.d] = 0 AND c.d <= w.before + 1 AND k > c.d THEN 0 ELSE w.l[k] END)
  FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1, LATERAL (SELECT CASE WHEN w.l[c.d] > 0 THEN w.l[c.d] WHEN c.d > w.before + 1 THEN w.before + 1 ELSE c.d END AS level) x)
 SELECT conv_id, turn, depth::BIGINT AS depth, level FROM w WHERE i > 0""")
def heading_level_lift(load, spark) -> DataFrame:
    h = load("conversations").select("conv_id", F.col("turn").alias("ord"), (1 + (F.col("turn") * 5 + F.col("conv_id")) % 6).cast("int").alias("depth"))
    return L.enforce_single_title(h, "conv_id").select("conv_id", F.col("ord").alias("turn"), "depth", "level")


@query("""WITH b AS (SELECT conv_id, turn, length(text) AS text_len FROM conversations) SELECT conv_id, turn, (coalesce(sum(text_len) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM b""")
def text_offsets(load, spark) -> DataFrame:
    b = load("conversations").select("conv_id", F.col("turn").alias("ord"), F.length("text").alias("text_len"))
    return L.text_offsets(b, "conv_id").select("conv_id", F.col("ord").alias("turn"), "offset")


@query("""WITH l AS (SELECT o_custkey AS doc, o_orderkey AS ord, o_orderpriority AS signature, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY doc, signature ORDER BY i) AS g FROM l), r AS (SELECT doc, min(i) AS opens, count(*) AS n FROM g GROUP BY doc, signature, g)
 SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY opens) AS run, n FROM r QUALIFY n >= 2""")
def stacked_templates(load, spark) -> DataFrame:
    l = load("orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("signature"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return L.stacked_templates(l, "doc")


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS ord, 1 + (l_linenumber % 4 = 0)::INT AS gap FROM lineitem), g AS (SELECT *, sum((gap >= 2)::INT) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT DISTINCT * FROM l)) SELECT doc, grp::BIGINT AS grp, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 3""")
def enumerated_items(load, spark) -> DataFrame:
    l = load("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), (1 + (F.col("l_linenumber") % 4 == 0).cast("int")).alias("gap"), F.concat("l_linenumber", F.lit(") item")).alias("text")).distinct()
    return L.enumerated_groups(L.line_groups(l, "doc"), "doc")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, unnest(range(1, len(l))) AS i, l FROM l) SELECT doc_id, count(*) FILTER (NOT regexp_matches(l[i], '[.!?…:;»”")]\\s*$') AND (regexp_matches(l[i], '[,–—-]\\s*$') OR regexp_matches(l[i + 1], '^\\s*\\p{Ll}'))) AS wraps, count(*) AS breaks FROM p GROUP BY doc_id""")
def wrap_breaks(load, spark) -> DataFrame:
    from pyspark.sql import Window

    l = load("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    l = l.withColumn("following", F.lead("l").over(Window.partitionBy("doc_id").orderBy("i"))).where("following IS NOT NULL")
    wrap = L.is_wrap_break(F.col("l"), F.col("following"), F.lit(0), F.lit(0))
    return l.groupBy("doc_id").agg(F.sum(wrap.cast("int")).alias("wraps"), F.count("*").alias("breaks"))


@query("""SELECT l_orderkey AS doc, l_linenumber AS ord, 'part ' || l_partkey AS label, l_quantity::BIGINT::VARCHAR AS value FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 3""")
def leader_tables(load, spark) -> DataFrame:
    text = F.concat(F.lit("part "), "l_partkey", F.lit(" ..... "), F.col("l_quantity").cast("bigint"))
    return L.leader_rows(load("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), text.alias("text")), "doc")


@query("""WITH w AS (SELECT user_id AS page, list_sort(list((event_id % 700)::BIGINT) FILTER (event_id % 400 >= 200)) AS w FROM events GROUP BY 1) SELECT page, w[len(w) // 4 + 1] AS width FROM w""")
def content_width(load, spark) -> DataFrame:
    b = load("events").select(F.col("user_id").alias("page"), (F.col("event_id") % 700).alias("w"), (F.col("event_id") % 400).alias("text_len"))
    return L.content_width(b, "page")


@query("""WITH v AS (SELECT p_partkey, (p_partkey * 7 % 700)::DOUBLE AS w, (p_size + 1)::DOUBLE AS h, CASE WHEN p_partkey % 3 = 0 THEN 500.0 END AS c, CASE p_partkey % 4 WHEN 0 THEN 'a/spacer1.gif' WHEN 1 THEN '' ELSE 'p/' || p_partkey || '.jpg' END AS src, CASE p_partkey % 5 WHEN 0 THEN 'photo.jpg' WHEN 1 THEN 'Photo 3' WHEN 2 THEN '' ELSE p_name END AS alt FROM part)
 SELECT p_partkey, CASE WHEN c IS NOT NULL THEN CASE WHEN w / c >= 0.92 THEN 'large' WHEN w / c >= 0.55 THEN 'medium' ELSE 'small' END WHEN w >= 380 THEN 'large' WHEN w >= 190 THEN 'medium' ELSE 'small' END AS size,
 src = '' OR p_partkey % 4 = 0 OR w * h <= 196 OR least(w, h) <= 3 OR ((w / h >= 6 OR w = 0 OR h / w >= 6) AND alt = '') AS decorative, CASE WHEN p_partkey % 5 > 2 THEN p_name_ END AS caption FROM (SELECT v.*, p_name AS p_name_ FROM v JOIN part USING (p_partkey))""")
def image_rules(load, spark) -> DataFrame:
    k = F.col("p_partkey")
    v = load("part").select(
        "p_partkey", (k * 7 % 700).cast("double").alias("w"), (F.col("p_size") + 1).cast("double").alias("h"), F.when(k % 3 == 0, 500.0).alias("c"),
        F.when(k % 4 == 0, "a/spacer1.gif").when(k % 4 == 1, "").otherwise(F.concat(F.lit("p/"), k, F.lit(".jpg"))).alias("src"),
        F.when(k % 5 == 0, "photo.jpg").when(k % 5 == 1, "Photo 3").when(k % 5 == 2, "").otherwise(F.col("p_name")).alias("alt"),
    )
    return v.select("p_partkey", L.size_token(F.col("w"), F.col("c")).alias("size"), L.is_decorative(F.col("src"), F.col("w"), F.col("h"), F.col("alt")).alias("decorative"), L.caption_from_alt(F.col("alt")).alias("caption"))


@query("""SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 'black' WHEN 1 THEN 'gold' WHEN 2 THEN 'red' WHEN 3 THEN 'white' WHEN 4 THEN 'red' WHEN 5 THEN 'gold' WHEN 6 THEN 'black' END AS palette, CASE n_nationkey % 2 WHEN 0 THEN '♪' END AS glyph, n_nationkey % 3 = 0 AS rule FROM nation""")
def colours_and_glyphs(load, spark) -> DataFrame:
    colours = ["#000", "Gold", "rgb(200, 10, 10)", "#FFFFFF", "#cc0000", "ffcc33", "navy", "plaid"]
    k = F.col("n_nationkey")
    c = F.element_at(F.array(*map(F.lit, colours)), (k % 8 + 1).cast("int"))
    src = F.when(k % 2 == 0, F.when(k % 4 == 0, "i/MP3.gif").otherwise(F.concat(F.lit("i/Note"), k, F.lit(".gif")))).otherwise("i/cover.gif")
    return load("nation").select("n_nationkey", L.palette(c).alias("palette"), L.icon_glyph(src).alias("glyph"), L.drawn_rule(F.when(k % 3 == 0, "* * *").otherwise("*-*")).alias("rule"))


CALLS = "c AS (SELECT event_id AS seq, user_id % 20 AS job, event_type AS model, (value * 10)::BIGINT AS i, (value * 3)::BIGINT AS o FROM events)"


def calls(load) -> DataFrame:
    return load("events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("job"), F.col("event_type").alias("model"), F.round(F.col("value") * 10).cast("bigint").alias("input_tokens"), F.round(F.col("value") * 3).cast("bigint").alias("output_tokens"))


@query(f"WITH {CALLS.replace('(value * 10)::BIGINT', 'round(value * 10)::BIGINT').replace('(value * 3)::BIGINT', 'round(value * 3)::BIGINT')}, r AS (SELECT *, row_number() OVER w AS n, sum(i) OVER w AS si, sum(o) OVER w AS so FROM c WINDOW w AS (PARTITION BY job ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT seq, job, si::BIGINT AS sum_input, n <= 300 AND si <= 90000 AND so <= 30000 AS allowed FROM r")
def budget_running(load, spark) -> DataFrame:
    return B.budget(calls(load), "job", 300, 90000, 30000).select("seq", "job", "sum_input", "allowed")


@query(f"WITH {CALLS.replace('(value * 10)::BIGINT', 'round(value * 10)::BIGINT').replace('(value * 3)::BIGINT', 'round(value * 3)::BIGINT')} SELECT model, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(CASE WHEN model = 'purchase' THEN (sum(i) * 2.5 + sum(o) * 10) / 1e6 ELSE 0 END, 6) AS cost FROM c GROUP BY model")
def plan_cost(load, spark) -> DataFrame:
    prices = spark.createDataFrame([("purchase", 2.5, 10.0)], "model string, input_price double, output_price double")
    return B.plan_cost(calls(load), prices).withColumn("cost", F.round("cost", 6))


@query("SELECT doc_id, sha256(text) AS source_sha256 FROM documents WHERE lang <> 'en'")
def job_identity(load, spark) -> DataFrame:
    """What a resumed run has left to do when the English documents are done."""
    d = load("documents")
    jobs = B.job_identity(d.select("doc_id", "lang", "text"), "text", "1", "default")
    done = jobs.where("lang = 'en'").select("source_sha256", "engine_version", "profile_id", "doc_id")
    # keyed by content and id here, since copies share their content
    left = jobs.join(done.select("source_sha256", "doc_id"), ["source_sha256", "doc_id"], "left_anti")
    return left.select("doc_id", "source_sha256")


@query("SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN 'cached' ELSE 'review' END AS decision, CASE WHEN event_id % 3 = 0 THEN 'deterministic' WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN 'cache' ELSE 'review' END AS source FROM events")
def cached_decisions(load, spark) -> DataFrame:
    e = load("events").select(F.col("event_id").alias("key"))
    items = e.withColumn("deterministic", F.when(F.col("key") % 3 == 0, "yes"))
    cache = e.where("key % 2 = 0").select("key", F.lit("cached").alias("value"), F.when(F.col("key") % 5 == 0, 0.5).otherwise(0.9).alias("confidence"))
    return B.decide(items, cache).select("key", "decision", "source")


@query("SELECT o_custkey AS page_id, count(*) FILTER (o_orderstatus = 'O') AS emitted, count(*) FILTER (o_orderstatus = 'F') AS removed, count(*) FILTER (o_orderstatus = 'P') AS review FROM orders GROUP BY 1")
def ledger_terminals(load, spark) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "EMITTED").when(F.col("o_orderstatus") == "F", "REMOVED").otherwise("REVIEW")
    ledger = load("orders").select(F.col("o_custkey").alias("page_id"), kind.alias("terminal_kind"))
    return B.terminal_counts(ledger, "page_id").select("page_id", "emitted", "removed", "review")


@query("SELECT o_orderkey AS node, 'no-terminal' AS problem FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT -n_nationkey - 1, 'undeclared' FROM nation")
def ledger_totality(load, spark) -> DataFrame:
    declared = load("orders").select(F.col("o_orderkey").alias("node"))
    ledger = declared.where("node % 50 <> 0").withColumn("terminal_kind", F.lit("EMITTED")).unionByName(load("nation").select((-F.col("n_nationkey") - 1).cast("bigint").alias("node"), F.lit("REMOVED").alias("terminal_kind")))
    return B.totality(declared, ledger, ["node"])


@query("""WITH b AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE turn % 4 WHEN 0 THEN '•' WHEN 1 THEN '•' WHEN 2 THEN '–' END AS mark FROM conversations),
 m AS (SELECT *, coalesce((mark IS DISTINCT FROM lag(mark) OVER (PARTITION BY conv_id ORDER BY i))::INT, 1) AS o FROM b), r AS (SELECT *, sum(o) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM m)
 SELECT conv_id, mark, count(*) AS n FROM r WHERE mark IS NOT NULL GROUP BY conv_id, run, mark HAVING count(*) >= 2""")
def bulleted_runs(load, spark) -> DataFrame:
    """Turns that begin with a bullet, a dash or neither: those with one mark in a row are a list."""
    k = F.col("turn") % 4
    text = F.concat(F.when(k < 2, "• ").when(k == 2, "– ").otherwise("no "), F.lit("x"))
    return L.bulleted_runs(load("conversations").select("conv_id", F.col("turn").alias("ord"), text.alias("text")), "conv_id").select("conv_id", "mark", "n")


@query(f"SELECT item_id, {norm('text')} AS t FROM benchmark")
def benchmark_words(load, spark) -> DataFrame:
    return load("benchmark").select("item_id", T.normalize_for_compare("text", normal_form=True).alias("t"))

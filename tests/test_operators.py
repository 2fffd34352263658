"""Operators over Spark on small tables."""

import pytest
from pyspark.sql import functions as F

from quire.functions import links as L, text as T
from quire.operators import documents as D, pages as P, text_ops as O
from quire.plans import convert as C
from quire.sources import files as S, runs
from quire.streaming import pages as ST


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "left, right, hyphen, edge, rule, verdict",
    [
        ("ги", "тара", "­", True, 1, "JOIN"), ("ги", "тара", "-", False, 2, "PRESERVE"), ("Нью", "Йорк", "-", True, 3, "PRESERVE"), ("ги", "тара", "-", True, 4, "JOIN"),
        ("кое", "кто", "-", True, 5, "PRESERVE"), ("сло", "варь", "-", True, 6, "JOIN"), ("дом", "музей", "-", True, 7, "REVIEW"),
    ],
)
def test_hyphen_rules(spark, left, right, hyphen, edge, rule, verdict):
    lexicon = spark.createDataFrame([("гитара", False, 3), ("кое-кто", True, 2)], "word string, hyphenated boolean, n bigint")
    words = spark.createDataFrame([("словарь",), ("дом",), ("музей",), ("доммузей",)], "word string")
    c = spark.createDataFrame([(left, right, hyphen, edge)], "left string, right string, hyphen string, at_line_edge boolean")
    r = O.hyphen_decisions(c, lexicon, words).first()
    assert (r.rule, r.verdict) == (rule, verdict)


@pytest.mark.parametrize(
    "href, kind, out",
    [
        ("", "empty", ""), ("javascript:x()", "unsafe", ""), ("#a", "anchor", "#a"), ("mailto:a@b.c", "mailto", "mailto:a@b.c"), ("http://other.com/x.htm", "external", "http://other.com/x.htm"),
        ("http://example.org/a/b.htm?q=1#h", "entry", "/#/b?q=1#h"), ("c.HTML", "entry", "/#/c"), ("photo/b/x.jpg", "resource", "/../photo/b/x.jpg"), ("images/x.jpg", "resource", "images/x.jpg"), ("<i>y.htm</i>", "entry", "/#/y"), ("archive/z.htm", "entry", "/#/z.htm"),
    ],
)
def test_link_policy(spark, href, kind, out):
    t = L.rewrite_target(F.lit(href))
    r = spark.range(1).select(t.kind.alias("k"), t.href.alias("h")).first()
    assert (r.k, r.h) == (kind, out)


@pytest.mark.parametrize(
    "p, r, kind",
    [("a", "a", "equal"), ("a  b", "a b", "whitespace"), ("«a»", '"a"', "typography.quotes"), ("a – b", "a - b", "typography.dash"), ("a...", "a…", "typography.ellipsis"), ("ги- тара", "гитара", "hyphenation.unjoined"), ("гитара", "ги-тара", "hyphenation.joined"), ("A b", "a B", "case"), ("!", "a", "content.empty"), ("a b c d", "a b c e", "content.edited"), ("a", "z", "content")],
)
def test_text_difference_classes(spark, p, r, kind):
    assert one(spark, T.classify_text(F.lit(p), F.lit(r))) == kind


def test_texts(spark):
    assert one(spark, T.normalize_for_compare(F.lit("Ги- Та­ра — «X», 2 ﻿"))) == "гитара x 2"
    assert one(spark, T.nfc(F.lit("é"))) == "é"
    assert one(spark, T.shingles(F.lit("a b"))) == ["a b"] and one(spark, T.shingles(F.lit(""))) == []
    assert one(spark, T.text_similarity(F.lit(""), F.lit(""))) == 1.0 and one(spark, T.text_similarity(F.lit("a b c"), F.lit("a b d"))) == 0.5
    assert one(spark, T.fnv1a32(F.lit("a"))) == "e40c292c"
    some = ["", "a", "ab", None, "Ключ", "x" * 500, "😀b"]
    df = spark.createDataFrame([(t,) for t in some], "t string").coalesce(1).select("t", T.fnv1a32("t").alias("h"))
    assert [(r.t, r.h) for r in df.collect()] == [(t, None if t is None else T.fnv1a32_of(t)) for t in some]


def test_conservation(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "a b c d e f", ""), (2, "a b c d e f", "a b c d", ""), (3, "x y a b c d e", "a b c d e", "x y"), (4, "", "", "")], "id bigint, s string, o string, r string")
    got = {r.id: (r.ok, round(r.recall, 3)) for r in O.conservation(df, "id", "s", "o", "r").collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.0), 3: (True, 1.0), 4: (True, 1.0)}


def test_corpus_of_one_page_has_no_chrome(spark):
    html = "<title>t</title><body><div class=menu><ul><li>home<li>about</ul></div><div><div><p>{}</p></div></div>"
    df = spark.createDataFrame([(i, html.format(f"text number {"abcd"[i] * 3} " * 20)) for i in range(4)], "page_id bigint, html string")
    chrome = lambda d: P.stable_chrome(P.fingerprint_frequency(P.fingerprints(d)), d.count())
    assert chrome(df.where("page_id = 0")).count() == 0
    found = chrome(df)
    assert found.count() >= 1
    made = C.convert_pages(df, profile={"stable_chrome": found})
    assert all("home" not in r.markdown and "text number" in r.markdown and r.state == "complete" for r in made.collect())
    C.MAX_CHROME, most = 0, C.MAX_CHROME  # too many shapes to send: each page gets its own
    try:
        joined = C.convert_pages(df, profile={"stable_chrome": found})
        assert sorted(r.markdown for r in joined.collect()) == sorted(r.markdown for r in made.collect())
    finally:
        C.MAX_CHROME = most


def test_sanitizing_accounts_for_what_it_removes(spark):
    html = "<body><!-- c --><script>x()</script><noscript><style>s</style></noscript><img src=a.gif width=1 height=1><p onclick=x><a href='javascript:y'>t</a></p><meta http-equiv=Refresh>"
    nodes = P.parse_pages(spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string"))
    gone = {(r.tag, r.reason, r.subsumed_by is not None) for r in P.removals(nodes).collect()}
    assert gone == {("#comment", "comment", False), ("script", "behaviour", False), ("noscript", "behaviour", False), ("style", "style", True), ("img", "tracker", False), ("meta", "refresh", False)}
    left = P.sanitize(nodes).where("page_id = 1")
    assert {r.tag for r in left.collect()} == {"#root", "html", "head", "body", "p", "a", "#text"}
    assert all(not r.attrs for r in left.where("tag IN ('p', 'a')").collect())
    assert nodes.where("page_id = 2").count() == 1


def test_scores_of_identical_documents_are_one(spark):
    md = "# T\n\ntext with [a](b.htm) and ![x](y.png)\n\n| k | v |\n|--|--|\n| 5 | 6 |\n"
    df = spark.createDataFrame([(1, md, md), (2, md, ""), (3, "", "")], "id bigint, e string, a string")
    got = {r.id: round(r.overall, 6) for r in D.overall_scores(df, "id", "e", "a").collect()}
    assert got[1] == 1.0 and got[3] == 1.0 and got[2] < 0.3


def test_equal_files_are_converted_once_and_kept_apart(spark, tmp_path):
    source, output = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("a", "b", "c"):
        (source / f"{name}.htm").write_text("<h1>Same</h1><p>text")
    (source / "d.htm").write_text("<h1>Other</h1>")
    first = runs.corpus_run(spark, str(source), output).collect()
    assert sorted((r.stem, r.markdown, r.state) for r in first) == [(x, "# Same\n\ntext\n", "complete") for x in "abc"] + [("d", "# Other\n", "complete")]
    (source / "e.htm").write_text("<h1>Same</h1><p>text")
    assert [(r.stem, r.markdown) for r in runs.corpus_run(spark, str(source), output).collect()] == [("e", "# Same\n\ntext\n")]
    done = spark.read.parquet(output + "/runs")
    assert done.count() == 5 and runs.summary(done).agg({"documents": "sum"}).first()[0] == 5


def test_pages_that_share_an_id_have_a_row_each(spark):
    df = spark.createDataFrame([(1, "<p>one"), (1, "<p>two"), (None, "<p>three"), (2, None), (3, "")], "page_id bigint, html string")
    made = C.convert_pages(df).collect()
    assert sorted(r.markdown for r in made) == ["", "", "one\n", "three\n", "two\n"]
    assert {(bool(r.markdown), r.state) for r in made} == {(False, "complete"), (True, "review-required")}  # a document needs a title


def test_scan_profile_and_decisions(spark, tmp_path):
    source, output = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    menu = "<div class=menu><ul><li>home<li>about</ul></div>"
    words = ["alpha", "beta", "gamma", "delta"]
    for i, w in enumerate(words):
        rest = "the gui-\ntar is here " if i else "a guitar is here "
        (source / f"{w}.htm").write_text(f"<title>{w}</title><body>{menu}<div><div><p>{rest}{(w + ' ') * 60}</div></div><table><tr><td>{w} one<td>x y</table>")
    profile = runs.corpus_scan(spark, str(source), str(tmp_path / "profile"))
    assert profile["lexicon"].where("word = 'guitar'").first().n == 1 and profile["encodings"].count() == 4
    made = runs.corpus_run(spark, str(source), output, profile=str(tmp_path / "profile"))
    docs = {r.stem: r for r in made.collect()}
    assert all("home" not in r.markdown and "guitar" in r.markdown for r in docs.values())
    asked = runs.escalations(made)
    answers = asked.selectExpr("key", "'DATA' AS value", "0.9 AS confidence")
    again = runs.corpus_run(spark, str(source), str(tmp_path / "other"), profile=str(tmp_path / "profile"), decisions=answers)
    assert asked.count() == sum(t["class"] == "UNKNOWN" for r in docs.values() for t in r.tables)
    assert all(t["class"] != "UNKNOWN" for r in again.collect() for t in r.tables)


@pytest.mark.parametrize("raw", ["", " x.htm ", "javascript:a", "#a", "mailto:a@b", "http://example.org/a/b.htm?q=1#h", "//www.example.org/x.pdf", "c.HTML", "photo/b/x.jpg", "images/x.jpg", "<i>y.htm</i>", "archive/z.htm", "../a/b.gif", "./q/r.png", "http://other.net", "tel:5", "a b.htm", "x", "http://example.org/"])
def test_both_forms_of_the_link_policy_agree(spark, raw):
    from quire.functions import profiles, rewrite as R

    t = L.rewrite_target(F.lit(raw))
    r = spark.range(1).select(t.kind.alias("k"), t.href.alias("h")).first()
    assert (r.k, r.h) == R.rewrite_target(raw, profiles.LinkProfile())


def test_both_forms_of_text_folding_agree(spark):
    from quire.functions import checks as K, rewrite as R

    texts = ["Ги- Та­ра — «X», 2", "a_b c-d e - f", "", "  x  ", "Ünï-cödé 3.5%", "a–b—c", "don't stop"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_for_compare("t").alias("n"), T.shingles("t").alias("s"))
    assert [(r.n, r.s) for r in df.collect()] == [(K.normalized(t), K.shingles(t)) for t in texts]
    lexicon = spark.createDataFrame([("гитара", False, 3), ("кое-кто", True, 2)], "word string, hyphenated boolean, n bigint")
    words = spark.createDataFrame([("словарь",), ("дом",), ("музей",), ("доммузей",)], "word string")
    known = R.Lookup({"гитара": 3, "кое-кто": 2}, frozenset(("словарь", "дом", "музей", "доммузей")))
    cases = [("ги", "тара", h, e, i, c) for h in "-­" for e in (True, False) for i in (True, False) for c in (True, False)] + [("Нью", "Йорк", "-", True, False, False), ("кое", "кто", "-", True, False, False), ("сло", "варь", "-", True, False, False), ("дом", "музей", "-", True, False, False)]
    df = spark.createDataFrame(cases, "left string, right string, hyphen string, at_line_edge boolean, in_identifier boolean, in_compound boolean")
    for r in O.hyphen_decisions(df, lexicon, words).collect():
        assert (r.verdict, r.rule, r.confidence) == R.decide_hyphen(r.left, r.right, r.hyphen, r.at_line_edge, r.in_identifier, r.in_compound, known)


def test_layout_comparison(spark):
    from quire.operators import layout

    schema = "page bigint, block string, x double, y double, w double, h double, cx double, cw double, text_align string"
    a = spark.createDataFrame([(1, "p1", 0.0, 0.0, 100.0, 20.0, 0.0, 100.0, "left"), (1, "p2", 0.0, 30.0, 100.0, 20.0, 0.0, 100.0, None), (1, "p3", 60.0, 60.0, 80.0, 20.0, 0.0, 100.0, None), (1, "p4", 0.0, 90.0, 9.0, 9.0, 0.0, 100.0, None)], schema)
    b = spark.createDataFrame([(1, "p1", 0.0, 30.0, 100.0, 20.0, 0.0, 100.0, "right"), (1, "p2", 0.0, 0.0, 100.0, 20.0, 0.0, 100.0, None), (1, "p3", 20.0, 60.0, 80.0, 20.0, 0.0, 100.0, None)], schema)
    found = {(r.block, r["class"]) for r in layout.compare_layouts(a, b, "page").collect()}
    assert found == {("p1", "layout.align.mismatch"), ("p1", "layout.order.mismatch"), ("p2", "layout.order.mismatch"), ("p3", "layout.align.mismatch"), ("p3", "layout.containment.mismatch")}
    assert layout.compare_layouts(a, a, "page").count() == 0
    assert [r.lane for r in layout.lanes(a.withColumnRenamed("block", "id"), "page").orderBy("id").collect()] == [0, 0, 1, 0]


def test_files_runs_and_streams(spark, tmp_path):
    source, output = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.htm").write_bytes("<title>t</title><p>Где".encode("cp1251"))
    (source / "b.HTML").write_text("<p>two")
    (source / "c.txt").write_text("no")
    assert sorted(r.stem for r in S.html_files(spark, str(source)).collect()) == ["a", "b"]
    assert runs.corpus_run(spark, str(source), output).count() == 2
    assert runs.corpus_run(spark, str(source), output).count() == 0  # all is done
    (source / "d.html").write_text("<p>three")
    assert [r.stem for r in runs.corpus_run(spark, str(source), output).collect()] == ["d"]
    S.export_documents(spark.read.parquet(output + "/runs").select("stem", F.col("markdown").alias("text")), str(tmp_path / "md"))
    docs = S.documents(spark, str(tmp_path / "md"))
    assert sorted(r.stem for r in docs.collect()) == ["a", "b", "d"]
    paired = S.pair(docs, docs.where("stem <> 'b'").unionByName(spark.createDataFrame([("z", "x")], "stem string, text string")))
    assert {(r.stem, bool(r.produced), bool(r.reference)) for r in paired.collect()} == {("a", True, True), ("b", True, False), ("d", True, True), ("z", False, True)}

    pages = spark.createDataFrame([(1, "u", "<p>one"), (2, "u", "<p>two")], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    query = ST.convert_stream(ST.page_stream(spark, str(tmp_path / "pages")), str(tmp_path / "stream"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 2
    profile = C.scan(pages)
    S.save_profile(profile, str(tmp_path / "profile"))
    assert S.load_profile(spark, str(tmp_path / "profile"))["lexicon"].count() == 2


def test_plans_push_down_and_stay_apart(spark):
    """Interval joins keep their equality on the page; scans read what is asked for."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = P.menus(P.parse_pages(pages))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan

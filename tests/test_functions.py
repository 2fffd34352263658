"""Functions without Spark: trees, decoding, islands, documents, geometry."""

import pytest
from hypothesis import given, settings, strategies as st

from quire.functions import build as Bu, checks as K, compile as C, decode as D, grids as G, hooks as Ho, html_tree as H, markdown as M, render as Re, rewrite as R, text as T
from quire.functions.profiles import PROFILES
from quire.operators import documents as Docs, layout as L
from quire.sources import runs

PLAIN = PROFILES["plain"]


def shape(node):
    inner = ",".join(shape(c) for c in node.children)
    return (repr(node.value) if node.kind == "text" else node.tag) + (f"({inner})" if inner else "")


def body(html):
    return shape(next(n for n in H.walk(H.build(html)[0]) if n.tag == "body"))


@pytest.mark.parametrize(
    "html, tree",
    [
        ("<p>a<p>b", "body(p('a'),p('b'))"),
        ("<p><b>a<p>b</b>c", "body(p(b('a')),p(b('b'),'c'))"),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", "body(table(tbody(tr(td('1'),td('2')),tr(td('3')))),'x')"),
        ("<table>foo<tr><td>a</table>", "body('foo',table(tbody(tr(td('a')))))"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "body(ul(li('a'),li('b',ul(li('c')))))"),
        ("<a href=1>x<a href=2>y</a>", "body(a('x'),a('y'))"),
        ("<table><td>x<table><tr><td>y</table>z</table>w", "body(table(tbody(tr(td('x',table(tbody(tr(td('y')))),'z')))),'w')"),
        ("a &amp; &lt;b&gt;", "body('a & <b>')"),
        ("<h1>a<h2>b", "body(h1('a'),h2('b'))"),
        ("<dl><dt>a<dd>b<dt>c", "body(dl(dt('a'),dd('b'),dt('c')))"),
        ("<br></p>", "body(br,p)"),
        ("plain < text", "body('plain < text')"),
    ],
)
def test_tree(html, tree):
    assert body(html) == tree


@given(st.text(alphabet="<>/abptrdliu =\"'&;!-\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text_gives_a_sound_tree(html):
    rows = H.flatten(H.build(html)[0])
    assert [r["pre"] for r in rows] == list(range(len(rows)))
    ids = [r["node_id"] for r in rows]
    assert len(set(ids)) == len(ids)
    for r in rows[1:]:
        up = rows[r["parent_pre"]]
        assert up["pre"] < r["pre"] <= r["post"] <= up["post"] and r["depth"] == up["depth"] + 1
        assert up["text_start"] <= r["text_start"] <= r["text_end"] <= up["text_end"]


def test_depth_has_no_bound():
    deep = "<div>" * 20_000 + "all the way down" + "</div>" * 20_000
    rows = H.flatten(H.build("<div>" * 3_000 + "x")[0])
    assert max(r["depth"] for r in rows) == 3_003
    assert C.convert(deep)["markdown"] == "all the way down\n"
    assert C.convert("<ul><li>" * 300 + "x")["markdown"].strip().endswith("x")


@given(st.text(alphabet="<>/abptrdliu =\"'&;!-\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_written_trees_read_the_same_text(html):
    root = H.build(html)[0]
    assert H.text_of(H.build(H.to_html(root))[0]) == H.text_of(root)


def test_duplicate_attributes():
    root, warnings = H.build("<p ID=a id=b class='x y'>")
    node = next(n for n in H.walk(root) if n.tag == "p")
    assert node.attrs == {"id": "a", "class": "x y"} and warnings


CYRILLIC = "Выдающийся гитарист родился в городе, где прошло его детство, и стал известен как исполнитель."


@pytest.mark.parametrize("codec", ["utf-8", "koi8-r", "windows-1251", "ibm866"])
def test_decoding_finds_the_charset(codec):
    found = D.decide(CYRILLIC.encode(D.PYTHON[codec]))
    assert (found["text"], found["codec"]) == (CYRILLIC, codec)


def test_decoding_cascade():
    assert D.decide(b"\xef\xbb\xbfa\r\nb\rc")["text"] == "a\nb\nc"
    assert D.decide("<meta charset=cp1251>Где".encode("cp1251"))["source"] == "declared"
    assert D.decide(b"a\0b")["text"] == "a b" and D.decide(b"a\0b")["nul_bytes"] == 1
    assert D.decide(None)["text"] == "" and D.decide(b"")["codec"] == "utf-8"


@given(st.text(alphabet="<?php%>=!-#\nx ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_islands_keep_length_and_lines(text):
    clean, found = D.islands(text)
    assert len(clean) == len(text) and [i for i, c in enumerate(clean) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert all(text[f["start"] : f["end"]] == f["raw"] for f in found)


def place(html):
    return G.place(next(n for n in H.walk(H.build(html)[0]) if n.tag == "table"))


def grid(html):
    g = place(html)
    slots = {s: c.cell for c in g.cells for s in c.slots}
    return [[slots.get((r, c)) for c in range(g.n_cols)] for r in range(g.n_rows)], g.warnings


def test_grids():
    assert grid("<table><tr><td>a<td>b<tr><td>c<td>d</table>")[0] == [[0, 1], [2, 3]]
    assert grid("<table><tr><td colspan=2>a<tr><td>c<td>d</table>")[0] == [[0, 0], [1, 2]]
    assert grid("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>")[0] == [[0, 1], [0, 2]]
    assert grid("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>")[0] == [[0, 1], [0, 2], [0, 3]]
    assert len(grid("<table><tr><td colspan=999999>a</table>")[0][0]) == G.MAX_SPAN
    assert grid("<table><tr><td>a<td>b<td>c<tr><td>d</table>")[0] == [[0, 1, 2], [3, None, None]]
    assert grid("<table><tr><td>a<td><table><tr><td>x</table><tr><td>c</table>")[0] == [[0, 1], [2, None]]
    assert grid("<table><tr><td>a<td rowspan=2>b<tr><td colspan=2>c</table>")[1] == ["overlapping spans"]
    large = place("<table>" + "<tr><td colspan=400 rowspan=400>x" + "<tr>" * 399 + "</table>")
    assert sum(len(c.slots) for c in large.cells) == 160_000 and not large.warnings  # nothing is cut down
    assert place("<table><tr><td colspan=5000>a</table>").warnings == ["clamped span"]


def test_all_tables_of_a_page_innermost_first():
    found = G.grids(H.build("<table><tr><td>a<table><tr><td>b<td>c</table></table><p>x</p><table><tr><th>k<tr><td>d</table>")[0])
    assert [(g.seq, g.nesting, [c.text for c in g.cells]) for g in found] == [(1, 1, ["b", "c"]), (0, 0, ["a b c"]), (2, 0, ["k", "d"])]
    assert [g.nested for g in found] == [0, 1, 0]


def test_table_shapes():
    strip = "<table>" + ("<tr><td>name" + "".join(f"<td><a href={i}.htm>[{i}]</a>" for i in range(1, 10))) * 2 + "</table>"
    assert len(G.column_bands(place(strip))) == 10 and len(G.plan(place(strip)).bands) == 2  # a strip of numbered parts is one column
    titled = place("<table><tr><td colspan=2><b>Works</b><tr><td>a<td>1<tr><td>b<td>2<tr><td>c<td>3</table>")
    assert G.leading_caption(titled).text == "Works" and G.plan(titled, below=1).failure is None
    assert G.wide_enough(0.8, False, 3) and not G.wide_enough(0.8, False, 2) and not G.wide_enough(0.7, True, 5)
    rows = "<tr><td><img src=p.jpg><td>words about it"
    assert G.picture_paired(place(f"<table>{rows * 3}</table>")) == 1 and G.classify(G.features(place(f"<table>{rows * 2}</table>")))[0] == "CATALOG"
    assert G.classify(G.features(place(f"<table>{rows}</table>")))[0] != "CATALOG" and G.classify(G.features(place(f"<table>{rows}</table>")), 1)[0] == "CATALOG"


LEXICON = R.Lookup({"гитара": 3, "кое-кто": 2}, frozenset(("словарь", "дом", "музей", "доммузей")))


@pytest.mark.parametrize(
    "text, result",
    [
        ("ги-\nтара", "гитара"), ("ги-тара", "ги-тара"), ("Нью-\nЙорк", "Нью-\nЙорк"), ("кое-\nкто", "кое-\nкто"), ("сло-\nварь", "словарь"), ("дом-\nмузей", "дом-\nмузей"),
        ("ги­тара", "гитара"), ("see www.ги-\nтара.com", "see www.ги-\nтара.com"), ("Ростов-на-\nДону", "Ростов-на-\nДону"), ("a@ги-\nтара", "a@ги-\nтара"),
    ],
)
def test_broken_words(text, result):
    joined, made = R.join_words(text, LEXICON)
    assert joined == result == R.patched(text, made)


def test_broken_words_across_elements():
    root = H.numbered(H.build("<p>ги<span>-</span>тара и кое<b>-</b>кто, сло<i>-</i> варь</p>")[0])
    made = R.dehyphenate(root, LEXICON)
    assert H.text_of(root) == "гитара и кое-кто, сло- варь" and [r.action for r in made] == ["join", "keep"]


def test_entities_that_were_escaped_twice_are_reported():
    root = H.numbered(H.build("<p>a &amp;lt; b</p><p>c &lt; d</p>")[0])
    assert len(R.double_decoded(root)) == 1


def test_outline():
    body = "<p>" + "long enough to be the body of a page and more than a label could hold " * 4
    page = f"<p><font size=6>Title of it</font>{body}<p><b><font size=4>First part</font></b>{body}<p><b><font size=4>Second part</font></b>{body}<p><img src=x.jpg width=300><p><b><font size=4>Under a picture</font></b>{body}<p><b><font size=4>Nothing follows</font></b>"
    made = C.convert(page)["markdown"].split("\n\n")
    assert [x for x in made if x.startswith("#")] == ["# Title of it", "## First part", "## Second part"]
    centred = body + "".join(f"<p align=center>part {x}</p>{body}" for x in "abc")
    assert [x for x in C.convert("<h1>t</h1>" + centred)["markdown"].split("\n\n") if x.startswith("##")] == ["## part a", "## part b", "## part c"]
    bullets = "".join(f"<p>• label {x}</p>{body}" for x in "abc")
    assert [x for x in C.convert("<h1>t</h1>" + bullets)["markdown"].split("\n\n") if x.startswith("##")] == ["## label a", "## label b", "## label c"]


def test_scripts_forms_and_trackers():
    root = H.numbered(H.build("<form><input></form><p>x<noscript>n<script>s</script></noscript><img src=//counter.x.net/a>")[0])
    made = R.sanitize(root, forms=True)
    assert [(r.tag, r.reason, r.subsumed_by is None) for r in made] == [("form", "form", True), ("input", "form", False), ("noscript", "behaviour", True), ("script", "behaviour", False), ("img", "tracker", True)]
    assert not any(r.loses_words for r in made) and H.text_of(root) == "x"


def test_frames_and_palette():
    assert [R.palette(c) for c in ("#000", "white", "rgb(200, 10, 10)", "ffcc33", "navy", None)] == ["black", "white", "red", "gold", None, None]
    rest = "<p>" + "words of the page around it " * 10
    assert "::: frame\nframe: black\n" in C.convert(f"<h1>t</h1><table border=2><tr><td>a notice in a box of its own</table>{rest}")["markdown"]
    assert "::: frame" not in C.convert("<h1>t</h1><table border=2><tr><td>a notice that is nearly all of the page</table>x")["markdown"]


def test_scores_and_rules():
    md = "# T\n\ntext with [a](b.htm) and ![x](y.png)\n\n| k | v |\n|--|--|\n| 5 | 6 |\n"
    axes, shape, overall = K.scores(md, md)
    assert shape == 1 and abs(overall - 1) < 1e-9 and all(x["f1"] == 1 for x in axes.values())
    assert K.scores(md, "")[2] < 0.3 and K.scores("", "")[2] > 0.999
    assert K.scores("# a", "::anchor{#x}\n\n# a")[0]["directives"]["f1"] == 1.0  # anchors don't count while the expected side has none
    assert K.conserved("a b c d e f", "a b c d") == (2, 2, 0, 0.0) and K.conserved("x y a b c d e", "a b c d e", "x y")[3] == 1.0
    assert [c for c, _, _ in K.validate("# a\n\n::: column\nx\n:::\n")] == ["column-outside-columns"]
    assert K.validate("") == [] and list(K.lint(":::\n")) == [("fence-unbalanced", 1)]


def test_reader():
    blocks, warnings = M.read("# T\n\n" + "::: columns" + "\n\n" + "::: column\n\na\n:::" + "\n\n" + "::: column\n\n- x\n  - y\n:::\n:::\n\n| k | v |\n|--|--|\n| 1 \\| 2 |\n\n::anchor{#z}\n\n> q\n\n1. one\n\n---\n")
    assert not warnings
    assert [(b["kind"], b["name"], b["depth"]) for b in blocks] == [
        ("heading", "", 1), ("directive", "columns", 0), ("directive", "column", 1), ("paragraph", "", 0), ("directive", "column", 1), ("list-item", "bullet", 0), ("list-item", "bullet", 1),
        ("table-row", "t17", 0), ("table-row", "t17", 1), ("directive", "anchor", 0), ("quote", "", 0), ("list-item", "ordered", 0), ("rule", "", 0),
    ]
    assert blocks[8]["text"] == "1 | 2\x1f"
    assert [w[0] for w in M.read("::: odd\nx")[1]] == ["unknown-directive", "unclosed-fence"]
    assert [w[0] for w in M.read("::anchor{x}\n\n::: columns\nstray\n:::")[1]] == ["malformed-property-line", "malformed-property-line", "stray-content-in-container"]
    assert M.read(None) == ([], [])


def test_lines_of_the_format():
    assert [M.opened_by(x) for x in ("::: nav", ":::nav\t", "::: ", "::: 1a", ":: nav", "::: a b", " ::: nav")] == ["nav", "nav", None, None, None, None, None]
    assert [M.closes(x) for x in (":::", ":::  ", "::: x", "::::")] == [True, True, False, False]
    assert [M.leaf_of(x) for x in ("::anchor{#a}", "::a-b{x=1 y}  ", "::a{b}c", "::{a}", ":::a{b}")] == [("anchor", "#a"), ("a-b", "x=1 y"), None, None, None]
    assert [M.property_of(x) for x in ("src: a: b", "size:", "a b: c", ": x", "1: y")] == [("src", "a: b"), ("size", ""), None, None, None]
    assert [M.heading_of(x) for x in ("# a", "###### b ##", "####### c", "#d", "## C#", "# ")] == [(1, "a"), (6, "b"), None, None, (2, "C#"), (1, "")]


@given(st.text(alphabet="#:|-> \nab1.*[]()", max_size=80))
@settings(max_examples=300, deadline=None)
def test_no_document_differs_from_itself(text):
    assert Docs.diff(text, text) == []


def test_differences():
    found = Docs.diff("# T\n\none two three four\n", "# T\n\none two three five\n\nlost paragraph here\n")
    assert sorted(f["class"] for f in found) == ["missing.paragraph", "text"]
    assert Docs.diff("# A\n", "## A\n")[0]["class"] == "heading.depth"
    moved = Docs.diff("a b c d e\n\nx y z w v\n", "x y z w v\n\na b c d e\n")
    assert [f["class"] for f in moved] == ["order.moved"]
    assert Docs.align([1, 2, 3], [1, 3], lambda a, b: float(a == b)) == [(0, 0), (1, None), (2, 1)]


@pytest.mark.parametrize(
    "produced, reference, classes",
    [
        ("one two three", "one *two* three", ["inline.emphasis"]), ("see [a](b) now", "see [a](c) now", ["inline.refs"]), ("a line\\\nmore of it", "a line more of it", ["lineation"]), ("- x y\n", "1. x y\n", ["list.kind"]), ("- a\n  - b c\n", "- a\n- b c\n", ["list.depth"]),
        ("| a | b |\n| - | - |\n| one two | 3 4 |", "| a | b |\n| - | - |\n| one two | 3 5 |", ["table.cell"]), ("| a b | c d |\n| - | - |", "| a b | c d | e |\n| - | - | - |", ["table.columns"]), ("one, two three", "one two three", ["text"]), ("one two three", "one two four", ["text"]),
    ],
)
def test_what_differs_between_paired_blocks(produced, reference, classes):
    assert [f["class"] for f in Docs.diff(produced, reference)] == classes


def test_converting_pages():
    html = (
        "<title>Page</title><body><h1>Head &amp; more</h1><p>First <b>bold</b> and <a href='x.htm'>link</a>.<br><br>Second.</p><ul><li>one<li>two</ul>"
        "<table><tr><th>k<th>v<tr><td>5<td>6<tr><td>3<td>4</table><center><p>mid</p></center><img src=p.jpg width=400 alt='A picture'><p><i>ignored</i></p>"
        "<blockquote>said</blockquote><hr><p>1) x<br>2) y<br>3) z</p><script>no()</script><a name=here></a>"
    )
    made = C.convert(html)
    md = made["markdown"]
    assert md.startswith("# Head & more\n\nFirst **bold** and [link](/#/x).\n\nSecond.\n\n- one\n- two\n\n| k | v |\n| --- | --- |\n| 5 | 6 |")
    assert "::: align\nposition: center\n\nmid\n:::" in md and "::: image\nsrc: p.jpg\nposition: center\nsize: large\ncaption: A picture\n:::" in md
    assert "> said" in md and "\n---\n" in md and "1. x\n2. y\n3. z" in md and "no()" not in md and "::anchor{#here}" in md
    assert [x[1:] for x in made["ledger"]].count(("REMOVED", "head")) == 1 and made["links"] == ["/#/x"] and made["images"] == ["p.jpg"]
    assert C.convert(None)["markdown"] == "" and C.convert("")["ledger"] == []
    assert C.convert(html) == C.convert(html)


def test_levels_and_bands():
    assert C.levels([3, 1, 5, 2, 4]) == [2, 1, 2, 2, 3] and C.levels([3, 3]) == [1, 2] and C.levels([1, 3, 3, 2, 3]) == [1, 2, 2, 2, 3] and C.levels([]) == []
    assert L.bands_of([(0, 10, 0), (2, 10, 5), (9, 10, 0), (30, 5, 0)]) == [0, 0, 1, 2]


def test_finding_ids():
    assert T.fnv1a32_of("") == "811c9dc5" and T.fnv1a32_of("a") == "e40c292c"


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"max_line": 10, /* x */ "profile": "a//b"} // end')
    config, origin = runs.load_config(str(file), env={"QUIRE_MIN_RECALL": "0.5"}, chrome_threshold=0.9)
    assert (config.max_line, config.profile, config.min_recall, config.chrome_threshold) == (10, "a//b", 0.5, 0.9)
    assert origin["min_recall"] == "environment" and origin["max_calls"] == "default"
    with pytest.raises(ValueError):
        runs.load_config(env={}, nonsense=1)


def test_builders_keep_the_rules():
    good = [
        Bu.anchor("a"), Bu.align("right", [C.Block("paragraph", "x")]), Bu.image("a.png", caption="c"), Bu.images(2, [Bu.grouped_image("a.png"), Bu.grouped_image("b.png")]), Bu.document("a.pdf", "A"), Bu.frame("red", [C.Block("paragraph", "x")]),
        Bu.columns([Bu.column([C.Block("paragraph", "x")]), Bu.column([C.Block("paragraph", "y")])]), Bu.nav([(0, "[a](b)"), (0, "c")], active="c"), Bu.signature([C.Block("paragraph", "x")]), Bu.lead([C.Block("paragraph", "x")]),
    ]
    text = C.serialize([C.Block("heading", "t", 1), *good])
    assert [c for c, severity, _ in K.validate(text) if severity == "error"] == []
    one = [C.Block("paragraph", "x")]
    for bad in (
        lambda: Bu.anchor("a b"), lambda: Bu.align("up", one), lambda: Bu.align("left", []), lambda: Bu.align("left", [Bu.nav([(0, "a")])]), lambda: Bu.image(""), lambda: Bu.image("a", size="huge"), lambda: Bu.image("a", frame="pink"), lambda: Bu.grouped_image("a", size="small"),
        lambda: Bu.images(2, [Bu.grouped_image("a")]), lambda: Bu.images(5, [Bu.grouped_image("a")] * 2), lambda: Bu.images(2, [Bu.image("a")] * 2), lambda: Bu.document("a", ""), lambda: Bu.columns([Bu.column(one)]), lambda: Bu.nav([]), lambda: Bu.nav([(0, "a")], active="b"),
        lambda: Bu.frame("red", [Bu.frame("red", one)]), lambda: Bu.frame("red", one, PLAIN), lambda: Bu.signature(one, PLAIN), lambda: Bu.signature([C.Block("rule")]), lambda: Bu.lead([Bu.anchor("a")]), lambda: Bu.column([Bu.nav([(0, "a")])]),
    ):
        with pytest.raises(Bu.BuildError):
            bad()


def test_downgrades_say_what_is_lost():
    one = [C.Block("paragraph", "x")]
    made, lost = Bu.downgraded([Bu.frame("red", one), Bu.frame("gold", [Bu.image("a.png")]), Bu.signature(one)], PLAIN)
    assert [b.kind for b in made] == ["quote", "image", "paragraph"] and [what for what, _ in lost] == ["frame", "frame", "signature"]
    framed = "<h1>t</h1><div style='border: 3px solid red'>a notice that is set apart</div><p>" + "words around it " * 20
    plain = C.convert(framed, C.Options(target=PLAIN))
    assert "> a notice" in plain["markdown"] and ":::" not in plain["markdown"] and any("frame" in note for _, _, note in plain["ledger"])


def test_rendering():
    page = Re.render("# T & t\n\na **b** *c* ~~d~~ ==e== `f` \\* [g](h.pdf) ![i](j.png)\\\nk\n\n1. one\n2. two\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\n::: images\ncolumns: 3\n\n::: image\nsrc: x.png\nlink: /#/y\ncaption: z\n:::\n:::\n\n::anchor{#q}\n\n---\n\n> said\n", "title")
    for part in ("<strong>b</strong> <em>c</em> <s>d</s> <mark>e</mark> <code>f</code> * ", '<a href="/pages/h.pdf">g</a> <img src="/pages/j.png" alt="i"><br>k', "<ol ", "<td>2</td>", '--tracks:3"', '<a href="/#/y"><img src="/pages/x.png" alt=""></a><figcaption>z</figcaption>', '<a id="q"', "<hr ", "T &amp; t</h1>"):
        assert part in page, part
    assert Re.render(None).count("<article") == 1 and 'href="a.html"' in Re.launcher(["a"])
    again = C.convert(page)["markdown"]
    assert "# T & t" in again and "| 1 | 2 |" in again.replace("| a | b |", "| a | b |")


def test_hooks_take_only_good_answers():
    asked = []

    def resolver(answer):
        def run(hook, payload):
            asked.append(payload)
            if isinstance(answer, Exception):
                raise answer
            return answer

        return run

    ask = lambda n, answer, **more: Ho.settle(Ho.TABLE_CLASS, {"n": n}, resolver=resolver(answer), **more)
    cache, budget = {}, Ho.Budget(3, 1000, 1000)
    good = {"value": "DATA", "confidence": 0.9, "input_tokens": 5, "output_tokens": 5}
    assert Ho.settle(Ho.TABLE_CLASS, {}, certain="LAYOUT") == ("LAYOUT", "deterministic")
    assert ask(1, good, cache=cache, budget=budget) == ("DATA", "model") and ask(1, good, cache=cache, budget=budget) == ("DATA", "cache")
    assert (budget.calls, budget.input, budget.output) == (1, 5, 5) and len(asked) == 1
    assert ask(2, {"value": "DATA", "confidence": 0.5}, cache=cache) == ("review", "not sure") and ask(3, {"value": "odd", "confidence": 1}, cache=cache) == ("review", "invalid")
    assert ask(4, RuntimeError(), cache=cache, budget=budget) == ("review", "failed") and budget.calls == 1
    assert ask(4, good, cache=cache) == ("review", "failed before")  # a run doesn't repeat what failed
    assert ask(5, good, cache=cache, budget=Ho.Budget(0, 9, 9)) == ("review", "over budget") and Ho.settle(Ho.TABLE_CLASS, {}) == ("review", "no resolver")
    assert Ho.permitted("join-hyphenated-word") and not Ho.permitted("rewrite")
    assert Ho.table_question(place("<table><tr><td>a<td>b</table>"))["cells"] == [["a", "b"]]


def test_command_line(tmp_path, capsys):
    from quire import cli

    page = tmp_path / "p.htm"
    page.write_bytes("<title>Имя</title><h1>Имя</h1><p>слово".encode("cp1251"))
    out = str(tmp_path / "p.md")
    assert cli.main(["convert", str(page), "--out", out]) == 0 and open(out, encoding="utf-8").read() == "# Имя\n\nслово\n"
    assert cli.main(["inspect", str(page)]) == 0 and '"state": "complete"' in capsys.readouterr().out
    assert cli.main(["validate", out]) == 0
    bad = tmp_path / "bad.md"
    bad.write_text("::: frame\nframe: pink\n")
    assert cli.main(["validate", str(bad)]) == 1 and "frame-palette" in capsys.readouterr().out
    assert cli.main(["render", out, "--out", str(tmp_path / "html")]) == 0 and (tmp_path / "html" / "index.html").exists()
    assert cli.main(["config"]) == 0 and "min_recall = 0.995  (default)" in capsys.readouterr().out

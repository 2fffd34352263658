"""Text reconstruction, links, conservation, scores and text differences over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import links as L, text as T
from quire.operators import text_ops as O
from quire.plans.registry import query

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '(\p{{L}})[‐‑–—-]\s*(\p{{L}})', '\1\2', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def norm(x: str) -> str:
    return NORM.format(x=x)


def edited(c="text"):
    """Every seventh word is dropped."""
    w = T.words_of(T.normalize_for_compare(c))
    return F.array_join(F.filter(w, lambda x, i: i % 7 != 6), " ")


BASE = f"""base AS (SELECT doc_id, CASE WHEN {norm('text')} = '' THEN [] ELSE string_split({norm('text')}, ' ') END AS w FROM documents),
 two AS (SELECT doc_id, w, list_filter(w, lambda x, i: (i - 1) % 7 <> 6) AS v FROM base)"""


def sh(w: str, k: int = 5) -> str:
    return f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < {k} THEN [array_to_string({w}, ' ')] ELSE list_transform(range(0, len({w}) - {k - 1}), lambda i: array_to_string({w}[i + 1 : i + {k}], ' ')) END"


@query(f"SELECT doc_id, {norm('text')} AS normalized, length({norm('text')}) AS n FROM documents")
def normalize_compare(load, spark) -> DataFrame:
    n = T.normalize_for_compare("text")
    return load("documents").select("doc_id", n.alias("normalized")).withColumn("n", F.length("normalized").cast("bigint"))


@query(
    f"WITH {BASE}, s AS (SELECT doc_id, unnest({sh('w')}) AS item FROM two), c AS (SELECT doc_id, item, count(*) AS n FROM s GROUP BY ALL) "
    "SELECT doc_id, sum(n)::BIGINT AS n_shingles, count(*) AS n_distinct, max(n) AS most FROM c GROUP BY doc_id"
)
def shingle_counts(load, spark) -> DataFrame:
    return O.row_shingles(load("documents"), "doc_id", "text")


F1_SQL = """SELECT {k}, expected::BIGINT AS expected, actual::BIGINT AS actual, matched::BIGINT AS matched,
 round(CASE WHEN expected = 0 THEN 1 ELSE matched / expected END, 6) AS recall,
 round(CASE WHEN actual = 0 THEN 0 ELSE matched / actual END, 6) AS "precision",
 round(CASE WHEN matched = 0 THEN 0 ELSE 2 * matched / (expected + actual) END, 6) AS f1 FROM f"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    f"WITH {BASE}, a AS (SELECT doc_id, item, count(*) AS a FROM (SELECT doc_id, unnest({sh('w')}) AS item FROM two) GROUP BY ALL),"
    f" b AS (SELECT doc_id, item, count(*) AS b FROM (SELECT doc_id, unnest({sh('v')}) AS item FROM two) GROUP BY ALL),"
    " j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.item = b.item),"
    " f AS (SELECT doc_id, sum(a) AS expected, sum(b) AS actual, sum(least(a, b)) AS matched FROM j GROUP BY 1) " + F1_SQL.format(k="doc_id")
)
def doc_shingle_f1(load, spark) -> DataFrame:
    """Five-word shingles of each document against an edited copy."""
    scores = O.row_shingle_f1(load("documents").select("doc_id", "text", edited().alias("other")), "doc_id", "text", "other")
    return rounded(scores, "recall", "precision", "f1")


@query(
    "WITH l AS (SELECT l_orderkey AS k, l_partkey % 40 AS item, count(*) FILTER (l_linenumber % 2 = 0) AS a, count(*) FILTER (l_linenumber % 3 <> 0) AS b FROM lineitem GROUP BY ALL),"
    " f AS (SELECT k, sum(a) AS expected, sum(b) AS actual, sum(least(a, b)) AS matched FROM l GROUP BY k HAVING sum(a) + sum(b) > 0) " + F1_SQL.format(k="k AS l_orderkey")
)
def multiset_f1_by_key(load, spark) -> DataFrame:
    """Bags whose items are rows: those of an order that are even, against those that aren't multiples of three."""
    l = load("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).cast("string").alias("item"))
    return rounded(O.multiset_f1(l.where("l_linenumber % 2 = 0"), l.where("l_linenumber % 3 <> 0"), ["l_orderkey"]), "recall", "precision", "f1")


@query(
    f"WITH {BASE}, a AS (SELECT doc_id, item, count(*) AS a FROM (SELECT doc_id, unnest(w) AS item FROM two) GROUP BY ALL),"
    " b AS (SELECT doc_id, item, count(*) AS b FROM (SELECT doc_id, unnest(list_concat(v, ['added', 'added'])) AS item FROM two) GROUP BY ALL)"
    " SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.item, b.item) AS item, greatest(coalesce(a, 0) - coalesce(b, 0), 0)::BIGINT AS missing, greatest(coalesce(b, 0) - coalesce(a, 0), 0)::BIGINT AS extra"
    " FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.item = b.item WHERE coalesce(a, 0) <> coalesce(b, 0)"
)
def bag_diff_words(load, spark) -> DataFrame:
    docs = load("documents").select("doc_id", "text", F.concat(edited(), F.lit(" added added")).alias("other"))
    return O.row_bag_diff(docs, "doc_id", "text", "other")


@query(
    f"""WITH lines AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS head FROM documents),
 b AS (SELECT doc_id, {norm('text')} AS s, {norm("substr(text, length(head) + 2)")} AS o, {norm('head')} AS h FROM lines),
 w AS (SELECT doc_id, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS s, CASE WHEN o = '' THEN [] ELSE string_split(o, ' ') END AS o, string_split(h, ' ') AS h FROM b),
 a AS (SELECT doc_id, h, item, count(*) AS a FROM (SELECT doc_id, h, unnest({sh('s')}) AS item FROM w) GROUP BY ALL),
 c AS (SELECT doc_id, item, count(*) AS b FROM (SELECT doc_id, unnest({sh('o')}) AS item FROM w) GROUP BY ALL),
 l AS (SELECT a.doc_id, a.a, greatest(a.a - coalesce(c.b, 0), 0) AS gone, list_has_any(string_split(a.item, ' '), a.h) AS seam FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.item = c.item),
 f AS (SELECT doc_id, sum(a)::BIGINT AS total, sum(gone)::BIGINT AS lost, sum(CASE WHEN seam THEN gone ELSE 0 END)::BIGINT AS excused FROM l GROUP BY doc_id),
 g AS (SELECT d.doc_id, coalesce(total, 0) AS total, coalesce(lost, 0) AS lost, coalesce(excused, 0) AS excused FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id)
 SELECT *, round(CASE WHEN total = 0 THEN 1 ELSE 1 - (lost - excused) / total END, 6) AS recall, CASE WHEN total = 0 THEN true ELSE 1 - (lost - excused) / total >= 0.995 END AS ok FROM g"""
)
def seam_shingles(load, spark) -> DataFrame:
    """Conservation of documents whose first line was removed and accounted for."""
    head = F.substring_index("text", "\n", 1)
    docs = load("documents").withColumn("head", head).withColumn("rest", F.expr("substring(text, length(head) + 2)"))
    return rounded(O.conservation(docs, "doc_id", "text", "rest", "head"), "recall")


LEX = r"lex AS (SELECT word, contains(word, '-') AS hyphenated, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(text, '\p{L}+-[ \t]*\r?\n\s*\p{L}+', ' ', 'g')), '\p{L}+(?:-\p{L}+)*')) AS word FROM documents) GROUP BY ALL)"


@query(f"WITH {LEX} SELECT * FROM lex")
def lexicon(load, spark) -> DataFrame:
    return O.lexicon(load("documents"))


@query(f"WITH {LEX} SELECT hyphenated, count(*) AS n_words, sum(n)::BIGINT AS n_tokens, max(n) AS most FROM lex GROUP BY hyphenated")
def lexicon_stats(load, spark) -> DataFrame:
    return O.lexicon(load("documents")).groupBy("hyphenated").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"))


def broken(load) -> DataFrame:
    """Every long word of every document, broken by a hyphen that depends on the document and the word's place."""
    docs = load("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{L}{6,})"), 1)).alias("pos", "w"))
    k = (F.col("doc_id") + F.col("pos")) % 4
    left = F.expr("substring(w, 1, int(floor(length(w) / 2)))")
    return docs.select(
        "doc_id", "pos",
        F.when(k == 3, F.concat(F.lit("q"), left)).otherwise(left).alias("left"),
        F.expr("substring(w, int(floor(length(w) / 2)) + 1)").alias("right"),
        F.when(k == 1, "­").otherwise("-").alias("hyphen"),
        (k != 2).alias("at_line_edge"),
        ((F.col("doc_id") + F.col("pos")) % 11 == 0).alias("in_identifier"),
        ((F.col("doc_id") + F.col("pos")) % 13 == 0).alias("in_compound"),
    )


@query(
    rf"""WITH {LEX}, x AS (SELECT doc_id, regexp_extract_all(text, '\p{{L}}{{6,}}') AS ws FROM documents), w AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS w FROM x),
 c AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 4 = 3 THEN 'q' ELSE '' END || substr(w, 1, length(w) // 2) AS l, substr(w, length(w) // 2 + 1) AS r, (doc_id + pos) % 4 AS k FROM w),
 j AS (SELECT c.*, coalesce(p.n, 0) AS nj, coalesce(h.n, 0) AS nh FROM c LEFT JOIN lex p ON p.word = lower(l || r) AND NOT p.hyphenated LEFT JOIN lex h ON h.word = lower(l || '-' || r) AND h.hyphenated),
 t AS (SELECT *, regexp_matches(l, '^\p{{Lu}}\p{{Ll}}+$') AND regexp_matches(r, '^\p{{Lu}}\p{{Ll}}+$') AS titles FROM j),
 d AS (SELECT *, CASE WHEN (doc_id + pos) % 11 = 0 THEN 0 WHEN k = 1 THEN 1 WHEN k = 2 THEN 2 WHEN (doc_id + pos) % 13 = 0 OR titles THEN 3 WHEN nj >= 1 THEN 4 WHEN nh >= 2 THEN 5 ELSE 7 END AS rule FROM t)
 SELECT doc_id, pos, l || r AS joined, rule, CASE rule WHEN 1 THEN 'JOIN' WHEN 4 THEN 'JOIN' WHEN 7 THEN 'REVIEW' ELSE 'PRESERVE' END AS verdict,
 round(CASE rule WHEN 0 THEN 0.99 WHEN 1 THEN 1 WHEN 2 THEN 0.98 WHEN 3 THEN 0.92 WHEN 4 THEN least(0.99, 0.85 + nj / 100) WHEN 5 THEN least(0.98, 0.85 + nh / 100) ELSE 0.5 END, 6) AS confidence FROM d"""
)
def hyphen_decisions(load, spark) -> DataFrame:
    decided = O.hyphen_decisions(broken(load), O.lexicon(load("documents")))
    return rounded(decided.select("doc_id", "pos", "joined", "rule", "verdict", "confidence"), "confidence")


@query(r"SELECT doc_id, text AS restored, length(text) AS n FROM documents")
def soft_hyphen_removed(load, spark) -> DataFrame:
    """Soft hyphens set into every long word and taken out again."""
    wounded = F.regexp_replace("text", r"(\p{L}{3})(\p{L}{3})", "$1­$2")
    return load("documents").select("doc_id", O.join_soft_hyphens(wounded).alias("restored")).withColumn("n", F.length("restored").cast("bigint"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z]{4})([a-z]{4})', '\1-' || chr(10) || '\2', 'g'), '(\p{L})', '\1\1', 'g') AS t FROM documents),
 m AS (SELECT doc_id, regexp_extract_all(t, '\p{L}[-\x{AD}‐][ \t]*\r?\n?[ \t]*\p{L}') AS x FROM w)
 SELECT doc_id, len(x) AS n, len(list_filter(x, lambda y: contains(y, chr(10)))) AS at_edge FROM m WHERE len(x) > 0"""
)
def hyphen_candidates(load, spark) -> DataFrame:
    """Candidates of whole texts, their own hyphens and those that break every run of eight small letters (letters are doubled in SQL, which can't look ahead)."""
    docs = load("documents").select("doc_id", F.regexp_replace("text", "([a-z]{4})([a-z]{4})", "$1-\n$2").alias("text"))
    return O.hyphen_candidates(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("at_line_edge").cast("int")).alias("at_edge"))


PROFILE = L.LinkProfile(internal_hosts=("ththre.example.com", "therha.example.com", "m.ththth.example.net"), content_roots=("images", "music"), keep_extension_under=("keep/",))


def hrefs(load) -> DataFrame:
    """Targets of many kinds made of the parts' names."""
    p = load("part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_").alias("s"))
    k = F.col("p_partkey") % 14
    forms = ["", " javascript:go('{}') ", "#{}", "MAILTO:{}@x.org", "http://other.net/{}.htm", "http://ththre.example.com/a/{}.htm?x=1#y", "images/{}.JPG", "a/b/{}.png", "../{}.gif", "sub/{}.html#top", "keep/{}.htm", "<b>{}.htm</b>", "{}", "//therha.example.com/{}.pdf"]
    href = F.lit("")
    for i, form in enumerate(forms):
        a, _, b = form.partition("{}")
        href = F.when(k == i, F.concat(F.lit(a), F.col("s") if "{}" in form else F.lit(""), F.lit(b))).otherwise(href)
    return p.select("p_partkey", "s", href.alias("href"))


@query(
    r"""WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS s, p_partkey % 14 AS k FROM part)
 SELECT p_partkey, CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'unsafe' WHEN 2 THEN 'anchor' WHEN 3 THEN 'mailto' WHEN 4 THEN 'external' WHEN 5 THEN 'entry' WHEN 9 THEN 'entry' WHEN 10 THEN 'entry' WHEN 11 THEN 'entry' ELSE 'resource' END AS kind,
 CASE k WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '#' || s WHEN 3 THEN 'MAILTO:' || s || '@x.org' WHEN 4 THEN 'http://other.net/' || s || '.htm' WHEN 5 THEN '/#/' || s || '?x=1#y' WHEN 6 THEN 'images/' || s || '.JPG'
  WHEN 7 THEN '/../a/b/' || s || '.png' WHEN 8 THEN '../' || s || '.gif' WHEN 9 THEN '/#/' || s || '#top' WHEN 10 THEN '/#/' || s || '.htm' WHEN 11 THEN '/#/' || s WHEN 12 THEN s ELSE '//therha.example.com/' || s || '.pdf' END AS href,
 k IN (1, 5, 7, 9, 10, 11) AS rewritten FROM p"""
)
def rewrite_targets(load, spark) -> DataFrame:
    t = L.rewrite_target("href", PROFILE)
    return hrefs(load).select("p_partkey", t.kind.alias("kind"), t.href.alias("out"), t.rewritten.alias("rewritten")).withColumnRenamed("out", "href")


@query(
    r"""SELECT page_id, CASE WHEN split_part(url, '/', 3) IN ('ththre.example.com', 'therha.example.com', 'm.ththth.example.net') AND regexp_matches(split_part(split_part(url, '#', 1), '?', 1), '\.html$') THEN 'entry' ELSE 'external' END AS kind FROM pages"""
)
def page_target_kinds(load, spark) -> DataFrame:
    return load("pages").select("page_id", L.rewrite_target("url", PROFILE).kind.alias("kind"))


@query(r"SELECT page_id, regexp_replace(lower(trim(url)), '/+$', '') AS folded, '#/x/' || page_id AS route, 'music/a.mp3' AS resource FROM pages")
def fold_targets(load, spark) -> DataFrame:
    return load("pages").select("page_id", T.fold_target("url").alias("folded"), T.fold_target(F.concat(F.lit("/#/X/"), "page_id")).alias("route"), T.fold_target(F.lit(" ./pages/Music/A.mp3")).alias("resource"))


TRANSLIT = ("zh", "kh", "ts", "ch", "sh", "shch", "yu", "ya")


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-{2,}', '-', 'g'), '-') || '-zhshchyaba' AS slug, '/#/' || 'x-' || p_partkey AS link FROM part")
def slug_translit(load, spark) -> DataFrame:
    c = F.concat(F.regexp_replace("p_name", "[^A-Za-z0-9]+", " "), F.lit(" ЖЩъЯба"))
    return load("part").select("p_partkey", L.transliterate_slug(c).alias("slug"), L.entry_link(F.concat(F.lit("x-"), "p_partkey")).alias("link"))


@query(r"""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) WHEN n_nationkey % 3 = 1 THEN '/../a/' || n_name || '/x.png' ELSE 'images/' || n_name END AS asset,
 CASE WHEN n_nationkey % 3 = 0 THEN '/pages/' || lower(n_name) WHEN n_nationkey % 3 = 1 THEN '/pages/a/' || n_name || '/x.png' ELSE '/pages/images/' || n_name END AS resource FROM nation""")
def asset_paths(load, spark) -> DataFrame:
    k, name = F.col("n_nationkey") % 3, F.col("n_name")
    path = F.when(k == 0, F.lower(name)).when(k == 1, F.concat(F.lit("/./a/"), name, F.lit("/x.png"))).otherwise(F.concat(F.lit("images/"), name))
    plain = F.when(k == 1, F.concat(F.lit("a/"), name, F.lit("/x.png"))).otherwise(path)
    return load("nation").select("n_nationkey", L.site_relative(plain, PROFILE).alias("asset"), L.resource_path(plain, PROFILE).alias("resource"))


PAIR = """p AS (SELECT doc_id, doc_id % 12 AS k, 'Say "' || trim(regexp_replace(regexp_replace(text, '[^\\p{L} ]|ß', ' ', 'g'), '\\s+', ' ', 'g')) || '" - it... well-made' AS r FROM documents)"""


@query(
    f"""WITH {PAIR} SELECT doc_id, CASE k WHEN 0 THEN 'equal' WHEN 1 THEN 'whitespace' WHEN 2 THEN 'typography.quotes' WHEN 3 THEN 'typography.dash' WHEN 4 THEN 'typography.ellipsis' WHEN 5 THEN 'hyphenation.joined'
 WHEN 6 THEN 'hyphenation.unjoined' WHEN 7 THEN 'case' WHEN 8 THEN 'content.empty' WHEN 9 THEN 'content.edited' WHEN 10 THEN 'content' ELSE 'hyphenation.mixed' END AS difference, CASE WHEN k IN (8, 10) THEN 'critical' ELSE 'minor' END AS severity FROM p"""
)
def text_diff_class(load, spark) -> DataFrame:
    """Pairs that differ in a known way."""
    body = T.collapse(F.regexp_replace("text", r"[^\p{L} ]|ß", " "))
    r = F.concat(F.lit('Say "'), body, F.lit('" - it... well-made'))
    k = F.col("doc_id") % 12
    produced = (
        F.when(k == 0, F.col("r"))
        .when(k == 1, F.regexp_replace("r", " ", "\n "))
        .when(k == 2, F.regexp_replace(F.regexp_replace("r", '"$', "x"), '"', "«"))
        .when(k == 3, F.regexp_replace(F.regexp_replace("r", '"', "”"), " - ", " — "))
        .when(k == 4, F.regexp_replace("r", r"\.\.\.", "…"))
        .when(k == 5, F.regexp_replace("r", "well-made", "wellmade"))
        .when(k == 6, F.regexp_replace("r", "Say", "Sa-y"))
        .when(k == 7, F.upper("r"))
        .when(k == 8, F.lit("--- !!!"))
        .when(k == 9, F.concat("r", F.lit(" sure")))
        .when(k == 10, F.lit("0 1 2 3 4 5 6 7 8 9"))
        .otherwise(F.regexp_replace(F.regexp_replace("r", "well-made", "wellmade"), "Say", "Sa-y"))
    )
    docs = load("documents").select("doc_id", r.alias("r"))
    return docs.select("doc_id", T.classify_text(produced, F.col("r")).alias("difference")).withColumn("severity", T.severity_of("difference"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\x{AD}', '', 'g'), '(\p{L})[‐‑–—-]\s*(\p{L})', '\1\2', 'g') AS text FROM documents)),
 v AS (SELECT doc_id, w, list_filter(w, lambda x, i: (i - 1) % 5 <> 4) AS v FROM w),
 g AS (SELECT doc_id, len(w) AS n, len(v) AS m, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS b, list_distinct(w) AS da, list_distinct(v) AS db FROM v)
 SELECT doc_id, round(CASE WHEN n = 0 AND m = 0 THEN 1 WHEN n = 0 OR m = 0 THEN 0 WHEN n < 2 OR m < 2 THEN len(list_intersect(da, db)) / len(list_distinct(list_concat(da, db))) ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS similarity FROM g"""
)
def bigram_dice(load, spark) -> DataFrame:
    other = F.array_join(F.filter(T.similarity_tokens("text"), lambda x, i: i % 5 != 4), " ")
    return load("documents").select("doc_id", F.round(T.text_similarity("text", other), 6).alias("similarity"))


@query(f"SELECT p_partkey, {norm('p_name')} AS label FROM part")
def fold_labels(load, spark) -> DataFrame:
    return load("part").select("p_partkey", T.fold_label(F.concat(F.lit("**"), "p_name", F.lit("** `"))).alias("label"))


@query(
    "SELECT n_nationkey, n || ' see ' || n || ' and alt' || n_nationkey || ' item' AS visible, 'see ' || n || ' now' AS inline FROM (SELECT n_nationkey, replace(n_name, '_', '') AS n FROM nation)"
)
def markdown_visible_text(load, spark) -> DataFrame:
    name, key = F.col("n_name"), F.col("n_nationkey")
    md = F.concat(F.lit("# "), name, F.lit("\n\n> see [**"), name, F.lit('**](/x "t") and ![alt'), key, F.lit("](a.png)\n\n---\n- item\n"))
    inline = F.concat(F.lit("see [`"), name, F.lit("`](http://x/y) n\\ow"))
    return load("nation").select("n_nationkey", T.visible_text(md).alias("visible"), T.strip_inline(inline).alias("inline"))

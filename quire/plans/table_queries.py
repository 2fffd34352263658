"""Tables built from relational rows, so that SQL over those rows is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators import tables as G
from quire.plans.registry import query
from quire.sources import tables


def regions(load) -> DataFrame:
    """A table for each region: the region spans all its nations."""
    n = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    per = n.groupBy("r_regionkey", "r_name").agg(rows.alias("rows"))
    line = F.transform("rows", lambda x, i: F.concat(F.when(i == 0, F.concat(F.lit("<tr><td rowspan="), F.size("rows"), F.lit(">"), "r_name", F.lit("</td>"))).otherwise("<tr>"), F.lit("<td>"), x["n_name"], F.lit("</td><td>"), x["n_nationkey"], F.lit("</td></tr>")))
    return per.select(F.col("r_regionkey").alias("table_id"), F.concat(F.lit("<table border=1>"), F.array_join(line, ""), F.lit("</table>")).alias("html"))


def orders_tables(load, header: bool = True) -> DataFrame:
    """A table for each customer with orders: key, date, priority, price; every seventh lacks the price in its last row."""
    o = tables.spread(load("orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy").alias("y"), "o_orderpriority", F.floor("o_totalprice").cast("string").alias("p")), "o_custkey")
    per = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "y", "o_orderpriority", "p"))).alias("rows"))
    hole = lambda i: (F.col("o_custkey") % 7 == 0) & (i == F.size("rows") - 1)
    line = F.transform(
        "rows",
        lambda x, i: F.concat(
            F.lit("<tr><td><a href='/o/"), x["o_orderkey"], F.lit("'>"), x["o_orderkey"], F.lit("</a><td>"), x["y"], F.lit("<td>"), x["o_orderpriority"], F.when(hole(i), "").otherwise(F.concat(F.lit("<td>"), x["p"]))
        ),
    )
    head = F.when(F.col("o_custkey") % 3 == 0, "<tr><th>key<th>year<th>priority<th>price").otherwise("")
    return per.select(F.col("o_custkey").alias("table_id"), F.concat(F.lit("<table>"), head, F.array_join(line, ""), F.lit("</table>")).alias("html"))


@query(
    """WITH n AS (SELECT n_regionkey AS t, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
 s AS (SELECT t AS table_id, r AS "row", 0 AS col, (SELECT r_name FROM region WHERE r_regionkey = t) AS text, r = 0 AS is_origin FROM n UNION ALL SELECT t, r, 1, n_name, true FROM n UNION ALL SELECT t, r, 2, n_nationkey::VARCHAR, true FROM n)
 SELECT * FROM s"""
)
def grid_slots(load, spark) -> DataFrame:
    return G.grid_slots(G.grid_cells(regions(load))).select("table_id", "row", "col", "text", "is_origin")


@query(
    """WITH o AS (SELECT o_custkey AS table_id, count(*) + (o_custkey % 3 = 0)::INT AS n FROM orders GROUP BY o_custkey)
 SELECT table_id, n AS n_rows, CASE WHEN n = 1 AND table_id % 7 = 0 THEN 3 ELSE 4 END AS n_cols, round(1 - (table_id % 7 = 0 AND n > 1)::INT / (4.0 * n), 6) AS regularity FROM o"""
)
def grid_regularity(load, spark) -> DataFrame:
    f = G.table_features(orders_tables(load))
    return f.select("table_id", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), F.round("grid_regularity", 6).alias("regularity"))


KINDS = """o AS (SELECT o_custkey AS t, o_orderkey::VARCHAR AS k, strftime(o_orderdate, '%Y') AS y, o_orderpriority AS p, floor(o_totalprice)::BIGINT::VARCHAR AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 c AS (SELECT t, i, 0 AS col, 'link' AS kind, k AS text, 1 AS links FROM o UNION ALL SELECT t, i, 1, 'year', y, 0 FROM o UNION ALL SELECT t, i, 2, 'shortText', p, 0 FROM o
  UNION ALL SELECT t, i, 3, CASE WHEN regexp_matches(v, '^[0-9]{4}$') THEN 'year' ELSE 'number' END, v, 0 FROM o WHERE NOT (t % 7 = 0 AND i = n)
  UNION ALL SELECT DISTINCT t, 0, h.col, 'shortText', h.text, 0 FROM o, (VALUES (0, 'key'), (1, 'year'), (2, 'priority'), (3, 'price')) h(col, text) WHERE t % 3 = 0),
 w AS (SELECT *, lead(kind) OVER (PARTITION BY t, i ORDER BY col) AS nk FROM c),
 b AS (SELECT t, count(DISTINCT i) AS rows, max(col) + 1 AS cols, count(*) AS cell_count, avg(length(text)) AS avg_text_len, max(length(text)) AS max_text_len, sum(links) / count(*) AS link_density, avg((kind = nk)::INT) AS neighbour_similarity, count(*) / (count(DISTINCT i) * (max(col) + 1)) AS reg FROM w GROUP BY t),
 e AS (SELECT t, avg(h) AS column_entropy FROM (SELECT t, col, log2(sum(m)) - sum(m * log2(m)) / sum(m) AS h FROM (SELECT t, col, kind, count(*) AS m FROM c GROUP BY ALL) GROUP BY ALL) GROUP BY t)"""


@query(
    f"""WITH {KINDS} SELECT b.t AS table_id, rows, cols, cell_count, round(avg_text_len, 6) AS avg_text_len, max_text_len, round(link_density, 6) AS link_density, round(coalesce(neighbour_similarity, 0), 6) AS neighbour_similarity,
 abs(round(column_entropy, 6)) AS column_entropy, round(reg, 6) AS grid_regularity, b.t % 3 = 0 AS has_header_row,
 4 * (b.t % 3 = 0)::INT AS header_cells, 0 AS nested_tables, 0 AS rowspan_count, 0 AS colspan_count, 0.0 AS empty_ratio, 0.0 AS image_density, 0.0 AS picture_paired, false AS has_border, cell_count AS content_cells, 0 AS prosey_cells,
 round(CASE WHEN b.t % 7 = 0 AND cols = 4 THEN (1.0 / rows) * (1 - 1.0 / rows) / 16 ELSE 0 END, 6) AS width_variance, nl = n0 AND n0 >= 3 AS link_column, 0.0 AS corpus_frequency
 FROM b JOIN e ON b.t = e.t JOIN (SELECT t, sum((col = 0 AND links = 1)::INT) AS nl, sum((col = 0)::INT) AS n0 FROM c GROUP BY t) l ON l.t = b.t"""
)
def table_features(load, spark) -> DataFrame:
    f = G.table_features(orders_tables(load))
    kinds = dict(f.dtypes)
    return f.select("table_id", *[F.abs(F.round(c, 6)).alias(c) if kinds[c] == "double" else c for c in f.columns if c not in ("table_id", "seq")])


@query(
    f"""WITH {KINDS}, l AS (SELECT t, sum((col = 0 AND links = 1)::INT) AS nl, sum((col = 0)::INT) AS n0 FROM c GROUP BY t),
 f AS (SELECT b.*, column_entropy AS h, t % 3 = 0 AS hdr, nl = n0 AND n0 >= 3 AS lc FROM b JOIN e USING (t) JOIN l USING (t)),
 s AS (SELECT *, round(0.35 * hdr::INT + 0.2 * (reg > 0.95)::INT + 0.15 * (coalesce(neighbour_similarity, 0) < 0.5)::INT + 0.2 * (h < 0.6)::INT + 0.15 * (rows >= 3 AND cols >= 2)::INT + 0.1, 9) AS data,
  round(0.15 * (reg < 0.8)::INT + 0.15 * (NOT hdr)::INT + 0.15 * (rows <= 2)::INT - 0.3 * hdr::INT, 9) AS layout, round(0.2 * (avg_text_len < 8 AND cell_count > 3)::INT, 9) AS shell, 0.1 * (cols = 2)::INT AS catalog FROM f),
 r AS (SELECT *, list_sort([data, layout, shell, catalog, 0.0, 0.15]::DOUBLE[], 'DESC') AS x FROM s)
 SELECT t AS table_id, CASE WHEN hdr AND rows >= 3 THEN 'DATA' WHEN lc THEN 'DATA' WHEN rows >= 3 AND reg = 1 THEN 'DATA' WHEN round(x[1] - x[2], 9) < 0.15 THEN 'UNKNOWN' WHEN x[1] = data THEN 'DATA' WHEN x[1] = layout THEN 'LAYOUT' ELSE 'SHELL' END AS class,
 round(CASE WHEN hdr AND rows >= 3 THEN 0.93 WHEN lc THEN 0.88 WHEN rows >= 3 AND reg = 1 THEN 0.85 ELSE least(1, greatest(0, x[1])) END, 6) AS confidence, CASE WHEN hdr AND rows >= 3 OR lc OR rows >= 3 AND reg = 1 THEN 1 ELSE 2 END AS tier FROM r"""
)
def table_class(load, spark) -> DataFrame:
    return G.classify_tables(orders_tables(load)).drop("seq").withColumn("confidence", F.round("confidence", 6))


def wide_tables(load) -> DataFrame:
    """Rows of 7 + 1 + 1 physical columns, the second row subdivided, for each supplier nation."""
    s = load("supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))
    line = F.transform("rows", lambda x, i: F.concat(F.lit("<tr><td colspan=7>"), x["s_name"], F.lit("</td><td>"), x["s_suppkey"], F.lit("</td><td><a href=x>"), i, F.lit("</a></td></tr>")))
    extra = "<tr><td>p<td>q<td colspan=5>r<td>s<td>t</tr>"
    return s.select(F.col("s_nationkey").cast("bigint").alias("table_id"), F.concat(F.lit("<table>"), F.array_join(line, ""), F.lit(extra + "</table>")).alias("html"))


@query("SELECT t AS table_id, b.band, b.s AS start, b.e AS \"end\" FROM (SELECT DISTINCT s_nationkey AS t FROM supplier), (VALUES (0, 0, 7), (1, 7, 8), (2, 8, 9)) b(band, s, e)")
def column_bands(load, spark) -> DataFrame:
    return G.column_bands(wide_tables(load)).drop("seq")


@query(
    """WITH s AS (SELECT s_nationkey AS table_id, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS "row", count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
 SELECT table_id, "row", 0 AS band, s_name AS text, 1 AS n_sources FROM s UNION ALL SELECT table_id, "row", 1, s_suppkey::VARCHAR, 1 FROM s UNION ALL SELECT table_id, "row", 2, "row"::VARCHAR, 1 FROM s
 UNION ALL SELECT DISTINCT table_id, n, b.band, b.t, b.k FROM s, (VALUES (0, 'p q r', 3), (1, 's', 1), (2, 't', 1)) b(band, t, k)"""
)
def planned_matrix(load, spark) -> DataFrame:
    return G.planned_cells(wide_tables(load)).select("table_id", "row", "band", "text", "n_sources")


@query(
    """SELECT p_partkey AS table_id, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 2 END AS n_bands,
 CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 2 END AS n_body, p_partkey % 6 = 5 AS header,
 CASE p_partkey % 6 WHEN 1 THEN 'too-small' WHEN 2 THEN 'too-many-columns' WHEN 3 THEN 'cell-needs-blocks' WHEN 4 THEN 'media-lane' END AS failure FROM part"""
)
def table_plans(load, spark) -> DataFrame:
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}" for c in cells)
    forms = ["<table>" + row("a {}", "b") * 3, "<table>" + row("{}") * 3, "<table>" + row("{}", *"abcdefgh") * 3, "<table>" + row("{}<ul><li>x<li>y</ul>", "z") * 3, "<table>" + row("<img src=a.png>", "{}") * 3, "<table><tr><th>k<th>v" + row("{}", "1") + row("{}", "2")]
    html = F.lit("")
    for i, form in enumerate(forms):
        html = F.when(k == i, F.replace(F.lit(form), F.lit("{}"), name)).otherwise(html)
    return G.plan_tables(tables.spread(load("part")).select(F.col("p_partkey").alias("table_id"), html.alias("html"))).drop("seq")


@query(
    """WITH l AS (SELECT l_orderkey AS table_id, l_linestatus AS s, l_returnflag AS f, l_linenumber AS i FROM lineitem),
 c AS (SELECT table_id, 0 AS band, s AS t FROM l UNION ALL SELECT table_id, 1, f FROM l),
 n AS (SELECT table_id, band, t, count(*) AS n, sum(count(*)) OVER (PARTITION BY table_id, band) AS a FROM c GROUP BY table_id, band, t),
 r AS (SELECT *, row_number() OVER (PARTITION BY table_id, band ORDER BY n DESC, t) AS k FROM n)
 SELECT table_id, band, CASE WHEN a >= 3 AND n >= 0.6 * a THEN t ELSE '' END AS label FROM r WHERE k = 1 UNION ALL SELECT DISTINCT table_id, 2, '🔗' FROM l"""
)
def synth_header(load, spark) -> DataFrame:
    l = tables.spread(load("lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag"), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_linestatus", "l_returnflag"))).alias("rows"))
    line = F.transform("rows", lambda x, i: F.concat(F.lit("<tr><td>"), x["l_linestatus"], F.lit("<td>"), x["l_returnflag"], F.lit("<td><a href=x>"), i, F.lit("</a>")))
    t = l.select(F.col("l_orderkey").alias("table_id"), F.concat(F.lit("<table>"), F.array_join(line, ""), F.lit("</table>")).alias("html"))
    return G.synthesized_header(t).drop("seq")


@query(
    """WITH o AS (SELECT o_custkey AS table_id, count(*) AS n FROM orders GROUP BY 1) SELECT table_id, (table_id % 4)::INT AS n_trailing FROM o"""
)
def trailing_empty_rows(load, spark) -> DataFrame:
    per = tables.spread(load("orders").select("o_custkey", "o_orderkey"), "o_custkey").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k"))
    body = F.array_join(F.transform("k", lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("<td>&nbsp;"))), "")
    t = per.select(F.col("o_custkey").alias("table_id"), F.concat(F.lit("<table>"), body, F.repeat(F.lit("<tr><td>&nbsp;<td>"), (F.col("o_custkey") % 4).cast("int")), F.lit("</table>")).alias("html"))
    return G.trailing_empty(t).select("table_id", "n_trailing")

"""URL filters: pattern rules found by their rarest literal token (operator 3).

Each rule is a regular expression.  Its literal tokens (maximal alphanumeric runs that every match must contain as
whole tokens; of the words of a group, one) are counted among the tokens of all URLs, and the rule is indexed by the rarest.  URL tokens
join the index; only the rules fetched that way run their regular expression.  A rule that has no such token runs on all URLs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from quire.llm import shared

BROADCAST_RULES = 200_000
MAX_WORDS = 64  # alternatives of a token; a part of a pattern with more isn't used to find the rule
FREE_RULES = 1000  # rules without a token that a URL meets at a time

#: (rule_id, action, pattern): a block list and its exceptions; RE2 and Java read these alike.
RULES: list[tuple[int, str, str]] = [
    (1, "block", r"^https?://([^/]+\.)?spam-farm\.example\.org(/|$)"),
    (2, "block", r"^https?://([^/]+\.)?cheap-pills\.example\.com(/|$)"),
    (3, "block", r"[?&]utm_source=feed(&|$)"),
    (4, "block", r"[?&]ref=x(&|$)"),
    (5, "block", r"/(login|signin|logout)(/|\?|$)"),
    (6, "block", r"[?&]sessionid=[0-9a-f]+"),
    (7, "block", r"^https?://([^/]+\.)?casino[a-z0-9-]*\."),
    (8, "block", r"/wp-admin/"),
    (9, "block", r"/cgi-bin/"),
    (10, "block", r"[?&]replytocom=[0-9]+"),
    (11, "block", r"^https?://ads?\."),
    (12, "block", r"/print/[0-9]+(\.html)?$"),
    (13, "block", r"[?&]page=[0-9]{3,}"),
    (14, "block", r"\.(jpg|jpeg|png|gif|zip|exe)(\?|$)"),
    (15, "block", r"^https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}[:/]"),
    (16, "block", r"^https?://m\.[^/]+/.*#top$"),
    (17, "block", r"/de/[0-9]+\.html$"),
    (18, "block", r"xn--[a-z0-9]+"),
    (101, "allow", r"^https?://www\.cheap-pills\.example\.com/en/[0-9]+/$"),
    (102, "allow", r"^https?://blog\.[^/]+/en/[0-9]+\?utm_source=feed$"),
    (103, "allow", r"/docs/print/[0-9]+\.html$"),
]


_WORDS = re.compile(r"\((?:\?:)?([A-Za-z0-9]+(?:\|[A-Za-z0-9]+)*)\)(?![*?+{])")
_EDGES = re.compile(r"\((?:\?:)?(?:\\[^A-Za-z0-9]|[^A-Za-z0-9()\[\]{}*+?.\\|])(?:\|(?:\\[^A-Za-z0-9]|[^A-Za-z0-9()\[\]{}*+?.\\|]))*\)(?![*?+{])")


def literal_tokens(pattern: str) -> list[list[str]] | None:
    """Sets of alphanumeric runs, of each of which any match of a pattern contains one as a whole token, lower case.

    Read from the top level of the pattern only: a run is one token, with an optional character two, and a group of plain
    words is a token for each word; other groups, classes, alternatives and quantified characters end a run.  A run counts only
    between literal non-alphanumeric characters, groups of these, or anchors, since another neighbour could make the URL's token
    longer.  A pattern with a top-level | has none.  None stands for a pattern that is malformed.
    """
    try:
        re.compile(pattern)
    except re.error:
        return None
    parts, depth, i, n = [], 0, 0, len(pattern)  # ("lit", c) | ("opt", c) | ("words", [...]) | ("edge",) | ("any",)
    while i < n:
        c = pattern[i]
        if c == "\\":
            escaped = pattern[i + 1] if i + 1 < n else ""
            if depth == 0:
                parts.append(("any", "") if escaped.isalnum() else ("lit", escaped))
            i += 2
            continue
        if c == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            end = pattern.find("]", end + 1)
            if end < 0:
                return None
            if depth == 0:
                parts.append(("edge" if _no_alnum(pattern[i : end + 1]) else "any", ""))
            i = end + 1
            continue
        if c == "(":
            words, edges = _WORDS.match(pattern, i), _EDGES.match(pattern, i)
            if depth == 0 and (words or edges):
                parts.append(("words", words[1].split("|")) if words else ("edge", ""))
                i = (words or edges).end()
                continue
            depth += 1
            if depth == 1:
                parts.append(("any", ""))
        elif c == ")":
            depth -= 1
        elif depth == 0:
            if c == "|":
                return []
            if c in "*?+{":
                if c == "{":
                    i = pattern.find("}", i)
                    if i < 0:
                        return None
                kind, last = parts[-1] if parts else ("any", "")
                if c == "?" and kind == "lit" and last.isalnum():
                    parts[-1] = ("opt", last)
                elif parts and c != "+":
                    parts[-1] = ("any", "")
                elif parts:
                    parts.append(("any", ""))
            elif c in "^$":
                parts.append(("edge", ""))
            elif c == ".":
                parts.append(("any", ""))
            else:
                parts.append(("lit", c))
        i += 1
    found, runs, left = [], [""], False
    for kind, c in [*parts, ("any", "")]:
        if kind == "words":
            runs = [r + w for r in runs for w in c]
        elif kind in ("lit", "opt") and c.isalnum() and c.isascii():
            runs = [r + c for r in runs] + (runs if kind == "opt" else [])
        else:
            ends = kind in ("edge", "lit")
            if left and ends and all(runs) and len(runs) <= MAX_WORDS:
                found.append(sorted({r.lower() for r in runs}))
            runs, left = [""], ends
            continue
        if len(runs) > MAX_WORDS:
            runs = runs[: MAX_WORDS + 1]  # too many to be looked up: this part counts for none
    return found


def _no_alnum(cls: str) -> bool:
    """Whether a character class, of literal members only, matches no letter and no digit."""
    return cls[1] != "^" and not re.search(r"[A-Za-z0-9\\]", cls[1:-1]) and not re.search(r"[^\[]-[^\]]", cls)


def rules_table(spark: SparkSession, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([Row(rule_id=i, action=a, pattern=p) for i, a, p in rules], "rule_id bigint, action string, pattern string")


def url_tokens(url) -> F.Column:
    """Distinct lower-case alphanumeric runs of a URL."""
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def url_decisions(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, url, n_block, n_allow, first_rule, decision.

    n_block and n_allow count the distinct rules that match, first_rule is the least id of the matching rules
    of the deciding action; an allow rule outweighs all block rules.  decision is 'block', 'allow', or 'pass' where nothing matches.  A
    null URL matches nothing.  Rows are told apart by (id, url): repeated rows give their row each, all alike,
    and null ids are kept.  Rules with a null pattern or id, and malformed ones, are left out.  Empty tables on either side are fine.
    Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    listed = rules.select("rule_id", "action", "pattern").where("rule_id IS NOT NULL AND pattern IS NOT NULL")
    tokens = F.udf(literal_tokens, "array<array<string>>")  # runs once a rule
    listed = shared.written(listed.withColumn("tokens", tokens("pattern")), "rules").where("tokens IS NOT NULL")
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    distinct = urls.where("url IS NOT NULL").select("url").distinct()
    exploded = distinct.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    small = listed.count() <= BROADCAST_RULES
    send = F.broadcast if small else (lambda df: df)
    sets = listed.select("rule_id", F.posexplode("tokens").alias("pos", "set"))
    wanted = sets.select("rule_id", "pos", F.explode("set").alias("token"))
    counts = exploded.join(send(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    totals = wanted.join(counts, "token", "left").groupBy("rule_id", "pos").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count("*").alias("size"))
    rarest = totals.groupBy("rule_id").agg(F.min(F.struct("n", "size", "pos")).alias("x")).select("rule_id", "x.pos")
    index = wanted.join(rarest, ["rule_id", "pos"]).select("rule_id", "token")
    keyed = listed.join(index, "rule_id").select("token", "rule_id", "action", "pattern")
    free = listed.where(F.size("tokens") == 0).select("rule_id", "action", "pattern")
    candidates = exploded.join(send(keyed), "token").select("url", "rule_id", "action", "pattern")
    # rules that no token leads to meet every URL: in one task each group of them, by a key that both sides carry
    slots = max(1, -(-free.count() // FREE_RULES))
    groups = free.withColumn("slot", F.pmod(F.xxhash64("rule_id"), F.lit(slots))).groupBy("slot").agg(F.collect_list(F.struct("rule_id", "action", "pattern")).alias("rules"))
    spread = distinct.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    everywhere = spread.join(send(groups), "slot").select("url", F.explode("rules").alias("r")).select("url", "r.*")
    matched = candidates.unionByName(everywhere).where(F.expr("url RLIKE pattern")).select("url", "rule_id", "action")
    block, allow = F.col("action") == "block", F.col("action") == "allow"
    verdicts = matched.groupBy("url").agg(
        F.countDistinct(F.when(block, F.col("rule_id"))).alias("n_block"),
        F.countDistinct(F.when(allow, F.col("rule_id"))).alias("n_allow"),
        F.min(F.when(block, F.col("rule_id"))).alias("b"),
        F.min(F.when(allow, F.col("rule_id"))).alias("a"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return urls.join(verdicts, "url", "left").select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        zero("n_block"),
        zero("n_allow"),
        F.coalesce("a", "b").alias("first_rule"),
        F.when(F.col("n_allow") > 0, "allow").when(F.col("n_block") > 0, "block").otherwise("pass").alias("decision"),
    )


def oracle(rules: list[tuple[int, str, str]] = RULES) -> str:
    """DuckDB SQL for url_decisions over pages: every rule on every URL."""
    values = ", ".join("({}, '{}', '{}')".format(i, a, p.replace("'", "''")) for i, a, p in rules)
    return f"""
    WITH rules(rule_id, action, pattern) AS (VALUES {values}),
    hits AS (SELECT DISTINCT p.url, r.rule_id, r.action FROM (SELECT DISTINCT url FROM pages) p JOIN rules r ON regexp_matches(p.url, r.pattern)),
    verdicts AS (SELECT url, count(*) FILTER (action = 'block') AS n_block, count(*) FILTER (action = 'allow') AS n_allow,
                        min(rule_id) FILTER (action = 'block') AS b, min(rule_id) FILTER (action = 'allow') AS a FROM hits GROUP BY url)
    SELECT p.page_id, p.url, coalesce(n_block, 0)::BIGINT AS n_block, coalesce(n_allow, 0)::BIGINT AS n_allow, coalesce(a, b)::BIGINT AS first_rule,
           CASE WHEN n_allow > 0 THEN 'allow' WHEN n_block > 0 THEN 'block' ELSE 'pass' END AS decision
    FROM pages p LEFT JOIN verdicts v ON p.url = v.url"""

"""Text reconstruction, bags of items and conservation."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import batches as B, checks as K, text as T

# -- lexicon


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, hyphenated, n): word counts; hyphens that end a line don't make a word."""
    masked = F.regexp_replace(F.col(text), r"\p{L}+-[ \t]*\r?\n\s*\p{L}+", " ")
    word = F.explode(F.regexp_extract_all(F.lower(masked), F.lit(f"({T.WORD})"), 1)).alias("word")
    return docs.select(word).groupBy("word").agg(F.count("*").alias("n")).select("word", F.col("word").contains("-").alias("hyphenated"), "n")


# -- hyphens


def hyphen_candidates(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, seq, left, hyphen, right, at_line_edge): letters, a hyphen, white space at most, letters."""
    gap = r"(\p{L}+)([-­‐])([ \t]*\r?\n?[ \t]*)(?=(\p{L}+))"
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(rf"({gap})"), 1)).alias("seq", "m")
    rights = F.regexp_extract_all(F.col(text), F.lit(gap), 4)
    rows = docs.select(F.col(id_col), rights.alias("rights"), found)
    part = lambda i: F.regexp_extract("m", r"(\p{L}+)([-­‐])([ \t]*\r?\n?[ \t]*)$", i)
    return rows.select(id_col, "seq", part(1).alias("left"), part(2).alias("hyphen"), F.element_at("rights", F.col("seq") + 1).alias("right"), part(3).contains("\n").alias("at_line_edge"))


def _title(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}[\p{Ll}]+$")


def hyphen_decisions(candidates: DataFrame, lexicon: DataFrame, dictionary: DataFrame | None = None, measured_edges: bool = True) -> DataFrame:
    """candidates (left, right, hyphen, at_line_edge, [in_identifier, in_compound]) with verdict, rule, confidence, joined.

    The lexicon (word, hyphenated, n) is joined twice, for the joined and for the hyphenated form; both are
    equi-joins, so Spark broadcasts a small lexicon and shuffles a large one.  measured_edges: at_line_edge is
    known; without it rule 2 never fires.
    """
    c = candidates
    for name in ("in_identifier", "in_compound"):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(False))
    c = c.withColumn("joined", F.concat("left", "right")).withColumn("__j", F.lower("joined")).withColumn("__h", F.lower(F.concat_ws("-", "left", "right")))
    plain = lexicon.where(~F.col("hyphenated")).select(F.col("word").alias("__j"), F.col("n").alias("__nj"))
    hyphened = lexicon.where("hyphenated").select(F.col("word").alias("__h"), F.col("n").alias("__nh"))
    c = c.join(plain, "__j", "left").join(hyphened, "__h", "left")
    if dictionary is not None:
        words = dictionary.select(F.lower("word").alias("w")).distinct()
        c = c.join(words.select(F.col("w").alias("__j"), F.lit(True).alias("__dj")), "__j", "left")
        c = c.withColumn("__l", F.lower("left")).withColumn("__r", F.lower("right"))
        c = c.join(words.select(F.col("w").alias("__l"), F.lit(True).alias("__dl")), "__l", "left").join(words.select(F.col("w").alias("__r"), F.lit(True).alias("__dr")), "__r", "left")
    else:
        c = c.withColumns({k: F.lit(None).cast("boolean") for k in ("__dj", "__dl", "__dr")})
    nj, nh = F.coalesce("__nj", F.lit(0)), F.coalesce("__nh", F.lit(0))
    both = F.coalesce("__dl", F.lit(False)) & F.coalesce("__dr", F.lit(False))
    rules = [
        (F.col("in_identifier"), 0, "PRESERVE", F.lit(0.99)),
        (F.col("hyphen") == "­", 1, "JOIN", F.lit(1.0)),
        (~F.col("at_line_edge") & F.lit(measured_edges), 2, "PRESERVE", F.lit(0.98)),
        (F.col("in_compound") | (_title(F.col("left")) & _title(F.col("right"))), 3, "PRESERVE", F.lit(0.92)),
        (nj >= 1, 4, "JOIN", F.least(F.lit(0.99), 0.85 + nj / 100)),
        ((nh >= 2) & (nj == 0), 5, "PRESERVE", F.least(F.lit(0.98), 0.85 + nh / 100)),
        (F.coalesce("__dj", F.lit(False)) & ~both, 6, "JOIN", F.lit(0.82)),
        (F.lit(True), 7, "REVIEW", F.lit(0.5)),
    ]
    rule = verdict = confidence = F.lit(None)
    for test, number, what, sure in reversed(rules):
        rule = F.when(test, number).otherwise(rule)
        verdict = F.when(test, what).otherwise(verdict)
        confidence = F.when(test, sure).otherwise(confidence)
    keep = [x for x in candidates.columns]
    return c.select(*keep, "joined", rule.cast("int").alias("rule"), verdict.alias("verdict"), confidence.cast("double").alias("confidence"))


def join_soft_hyphens(c: Column | str) -> Column:
    """Soft hyphens, and white space after them, removed between letters."""
    return F.regexp_replace(T.col(c), r"(?<=\p{L})­\s*(?=\p{L})", "")


# -- bags


def bag_counts(items: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    return items.groupBy(*keys, item).agg(F.count("*").alias("n"))


def both_bags(source: DataFrame, output: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, a, b): how often each item is in either bag; one aggregation over the union, combined on the map side, instead of a join."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    left = source.select(*keys, item, one.alias("a"), none.alias("b"))
    right = output.select(*keys, item, none.alias("a"), one.alias("b"))
    return left.unionByName(right).groupBy(*keys, item).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def bag_diff(source: DataFrame, output: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """(keys, item, missing, extra): items of the two bags that don't balance, with multiplicity."""
    both = both_bags(source, output, keys, item)
    return both.where("a <> b").select(*keys, item, F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("missing"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("extra"))


def multiset_f1(expected: DataFrame, actual: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """(keys, expected, actual, matched, recall, precision, f1); a pair of empty bags has no row."""
    both = both_bags(expected, actual, keys, item)
    sums = both.groupBy(*keys).agg(F.sum("a").alias("expected"), F.sum("b").alias("actual"), F.sum(F.least("a", "b")).alias("matched"))
    return with_f1(sums)


def with_f1(df: DataFrame) -> DataFrame:
    """recall, precision and f1 of columns expected, actual and matched; 1 where nothing is expected and nothing is there."""
    recall = F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.col("matched") / F.col("expected"))
    precision = F.when(F.col("actual") == 0, F.when(F.col("expected") == 0, 1.0).otherwise(0.0)).otherwise(F.col("matched") / F.col("actual"))
    df = df.withColumn("recall", recall).withColumn("precision", precision)
    return df.withColumn("f1", F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))))


def exploded(docs: DataFrame, keys: list[str], items: Column) -> DataFrame:
    return docs.select(*keys, F.explode(items).alias("item"))


# -- bags of one document: it is a row, and so are its bags; nothing of them needs a shuffle


def row_bag_diff(docs: DataFrame, id_col: str, source: str, output: str) -> DataFrame:
    """(id, item, missing, extra): what doesn't balance between the words (normalized) of two texts of each row, with multiplicity."""

    def of(i, s: str | None, o: str | None):
        a, b = Counter(K.normalized(s or "").split()), Counter(K.normalized(o or "").split())
        return ({id_col: i, "item": x, "missing": max(0, a[x] - b[x]), "extra": max(0, b[x] - a[x])} for x in a | b if a[x] != b[x])

    return B.rows_of(docs, id_col, [source, output], f"{id_col} bigint, item string, missing bigint, extra bigint", of)


def row_shingle_f1(docs: DataFrame, id_col: str, expected: str, actual: str, size: int = 5) -> DataFrame:
    """(id, expected, actual, matched, recall, precision, f1) of the shingles of two texts of each row; a pair of empty bags has no row."""
    schema = f"{id_col} bigint, expected bigint, actual bigint, matched bigint, recall double, precision double, f1 double"

    def of(i, e: str | None, a: str | None):
        found = K.rates(*K.shared_runs(K.words_of(e or ""), K.words_of(a or ""), size))
        return [{id_col: i, **found}] if found["expected"] or found["actual"] else []

    return B.rows_of(docs, id_col, [expected, actual], schema, of)


def row_shingles(docs: DataFrame, id_col: str, text: str, size: int = 5) -> DataFrame:
    """(id, n_shingles, n_distinct, most): how many shingles each text has, and how often the most frequent; an empty text has no row."""

    def of(i, t: str | None):
        bag = Counter(K.shingles(t or "", size))
        return [{id_col: i, "n_shingles": bag.total(), "n_distinct": len(bag), "most": max(bag.values())}] if bag else []

    return B.rows_of(docs, id_col, text, f"{id_col} bigint, n_shingles bigint, n_distinct bigint, most bigint", of)


def conservation(pairs: DataFrame, id_col: str, source: str, output: str, accounted: str | None = None, minimum: float = 0.995) -> DataFrame:
    """(id, total, lost, excused, recall, ok) of each pair of source and output texts.

    Source shingles that the output lacks are lost, unless they are shingles of the accounted (removed) text or a
    seam: a shingle that holds a word of it.  A source without shingles has recall 1.
    """

    def of(i, s: str | None, o: str | None, removed: str | None = None):
        total, lost, excused, recall = K.conserved(s or "", o or "", removed or "")
        return [{id_col: i, "total": total, "lost": lost, "excused": excused, "recall": recall, "ok": recall >= minimum}]

    return B.rows_of(pairs, id_col, [source, output, *([accounted] if accounted else [])], f"{id_col} bigint, total bigint, lost bigint, excused bigint, recall double, ok boolean", of)

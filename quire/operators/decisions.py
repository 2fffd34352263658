"""Decisions, budgets, job identity and the provenance ledger, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from quire.sources import tables

TERMINALS = ("EMITTED", "MERGED_INTO", "MOVED_TO", "REMOVED", "REVIEW")


def job_identity(pages: DataFrame, content: str, engine: str, profile: str) -> DataFrame:
    """pages with source_sha256, engine_version and profile_id: the key under which finished work is known."""
    return pages.withColumns({"source_sha256": F.sha2(F.col(content).cast("binary"), 256), "engine_version": F.lit(engine), "profile_id": F.lit(profile)})


def remaining(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose key no finished run has."""
    return jobs.join(done.select("source_sha256", "engine_version", "profile_id"), ["source_sha256", "engine_version", "profile_id"], "left_anti")


def decide(items: DataFrame, cache: DataFrame, minimum: float = 0.75) -> DataFrame:
    """items (key, deterministic) with decision and source: what is certain, else what the cache (key, value, confidence) has, else review."""
    known = cache.select("key", "value", "confidence")
    joined = items.join(known, "key", "left")
    hit = F.col("value").isNotNull() & (F.col("confidence") >= minimum)
    decision = F.when(F.col("deterministic").isNotNull(), F.col("deterministic")).when(hit, F.col("value")).otherwise("review")
    source = F.when(F.col("deterministic").isNotNull(), "deterministic").when(hit, "cache").otherwise("review")
    return joined.select(*items.columns, decision.alias("decision"), source.alias("source"))


def budget(calls: DataFrame, key: str, max_calls: int, max_input: int, max_output: int) -> DataFrame:
    """calls (seq, input_tokens, output_tokens) with running totals and whether the budget allows each; all three limits count."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = calls.withColumns({"n": F.row_number().over(Window.partitionBy(key).orderBy("seq")), "sum_input": F.sum("input_tokens").over(w), "sum_output": F.sum("output_tokens").over(w)})
    return run.withColumn("allowed", (F.col("n") <= max_calls) & (F.col("sum_input") <= max_input) & (F.col("sum_output") <= max_output))


def plan_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, calls, input_tokens, output_tokens, cost) at prices (model, input_price, output_price) a million tokens."""
    per = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = (F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))) / 1e6
    return per.join(prices, "model", "left").select("model", "calls", "input_tokens", "output_tokens", cost.alias("cost"))


def resolver_stats(decisions: DataFrame) -> DataFrame:
    """(hook, deterministic, cache, review)."""
    n = lambda s: F.sum((F.col("source") == s).cast("int")).alias(s)
    return decisions.groupBy("hook").agg(n("deterministic"), n("cache"), n("review"))


def totality(declared: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): declared nodes without a terminal state, and states of nodes that nobody declared; empty for a total pass.

    Both sides are dealt by their keys and grouped once, where they meet; a key that holds a null has no match.
    """
    ended = ledger.where(F.col("terminal_kind").isin(*TERMINALS)).select(*keys, F.lit(False).alias("__known"))
    both = tables.spread(declared.select(*keys, F.lit(True).alias("__known")).unionByName(ended), *keys)
    per = both.groupBy(*keys).agg(F.bool_or("__known").alias("__known"), F.bool_or(~F.col("__known")).alias("__ended"))
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    found = F.array_compact(F.array(F.when(F.col("__known") & (~F.col("__ended") | null), "no-terminal"), F.when(F.col("__ended") & (~F.col("__known") | null), "undeclared")))
    return per.select(*keys, F.explode(found).alias("problem"))


def terminal_counts(ledger: DataFrame, key: str) -> DataFrame:
    """(key, one count for each terminal state)."""
    n = lambda t: F.sum((F.col("terminal_kind") == t).cast("int")).alias(t.lower())
    return ledger.groupBy(key).agg(*map(n, TERMINALS))

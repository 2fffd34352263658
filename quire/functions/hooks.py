"""Questions that rules leave open, and the rules by which an answer from outside is taken.

A hook names a question, says what answers are allowed, and how each table or text is asked.  ``settle`` takes an item through
the stages in their order: what is certain needs no question; then the cache; then, within the budget, the resolver; whatever
isn't a valid and confident answer ends as "review".  Nothing here reaches a network: a resolver is a function that is given.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.functions import grids as G

REVIEW = "review"


@dataclass(frozen=True)
class Hook:
    """A kind of question: its version changes when old answers no longer fit; least is the confidence that is believed."""

    name: str
    version: int
    allowed: tuple[str, ...]
    least: float = 0.75

    def key(self, payload: dict) -> str:
        """The same for equal questions, whatever asks them."""
        return hashlib.sha256(json.dumps([self.name, self.version, payload], sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def valid(self, answer: dict | None) -> bool:
        """Whether an answer is {"value": one of allowed, "confidence": 0 to 1}."""
        if not isinstance(answer, dict) or answer.get("value") not in self.allowed:
            return False
        sure = answer.get("confidence")
        return isinstance(sure, (int, float)) and not isinstance(sure, bool) and 0 <= sure <= 1


TABLE_CLASS = Hook("table.classify", 1, tuple(k for k in G.CLASSES if k != "UNKNOWN"))
TABLE_RECORDS = Hook("table.records", 1, ("header", "body"))
TEXT_SEGMENT = Hook("text.segment", 1, ("paragraph", "heading", "caption", "list"))


@dataclass
class Budget:
    """Calls and tokens that a run may use.  What is reserved for a call is released if it fails, and settled by what it used."""

    max_calls: int
    max_input: int
    max_output: int
    calls: int = 0
    input: int = 0
    output: int = 0
    by_model: dict = field(default_factory=dict)

    def reserve(self, input_tokens: int, output_tokens: int) -> bool:
        if self.calls + 1 > self.max_calls or self.input + input_tokens > self.max_input or self.output + output_tokens > self.max_output:
            return False
        self.calls, self.input, self.output = self.calls + 1, self.input + input_tokens, self.output + output_tokens
        return True

    def release(self, input_tokens: int, output_tokens: int) -> None:
        self.calls, self.input, self.output = self.calls - 1, self.input - input_tokens, self.output - output_tokens

    def settle(self, model: str, reserved: tuple[int, int], used: tuple[int, int]) -> None:
        self.input += used[0] - reserved[0]
        self.output += used[1] - reserved[1]
        calls, i, o = self.by_model.get(model, (0, 0, 0))
        self.by_model[model] = (calls + 1, i + used[0], o + used[1])


def estimated_tokens(payload: dict) -> int:
    """A guess on the safe side: a token for every three characters."""
    return -(-len(json.dumps(payload, ensure_ascii=False)) // 3)


def settle(
    hook: Hook, payload: dict, certain: str | None = None, cache: dict[str, dict] | None = None, resolver: Callable[[Hook, dict], dict] | None = None, budget: Budget | None = None, model: str = "default", output_tokens: int = 200
) -> tuple[str, str]:
    """(answer, where it is from: deterministic, cache, model, or why it is left to review).

    cache is read and written; a question whose call failed is remembered there too, so that a run doesn't repeat it.
    """
    if certain is not None:
        return certain, "deterministic"
    cache = {} if cache is None else cache
    key = hook.key(payload)
    if key in cache:
        found = cache[key]
        if not hook.valid(found):
            return REVIEW, "failed before"
        return (found["value"], "cache") if found["confidence"] >= hook.least else (REVIEW, "not sure")
    if resolver is None:
        return REVIEW, "no resolver"
    need = estimated_tokens(payload), output_tokens
    if budget is not None and not budget.reserve(*need):
        return REVIEW, "over budget"
    try:
        answer = resolver(hook, payload)
    except Exception:  # whatever a resolver raises, the item goes to review
        if budget is not None:
            budget.release(*need)
        cache[key] = {}
        return REVIEW, "failed"
    if budget is not None:
        used = (answer.get("input_tokens", need[0]), answer.get("output_tokens", need[1])) if isinstance(answer, dict) else need
        budget.settle(model, need, used)
    cache[key] = {"value": answer.get("value"), "confidence": answer.get("confidence")} if isinstance(answer, dict) else {}
    if not hook.valid(answer):
        return REVIEW, "invalid"
    return (answer["value"], "model") if answer["confidence"] >= hook.least else (REVIEW, "not sure")


def table_question(grid: G.Grid) -> dict:
    """What is asked of a table: its features, and the beginning of its cells."""
    return {"features": {k: round(v, 3) if isinstance(v, float) else v for k, v in G.features(grid).items()}, "cells": [[c.text[:60] for c in row] for _, row in sorted(grid.rows().items())][:12]}


#: Changes of text that a run may make by itself (mechanical), and those that it may only propose (editorial).
MECHANICAL = frozenset(("join-hyphenated-word", "preserve-break", "collapse-space", "decode-entity"))
EDITORIAL = frozenset(("rewrite", "translate", "correct-spelling", "reorder"))


def permitted(kind: str) -> bool:
    return kind in MECHANICAL

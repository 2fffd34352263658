"""Chat formatting with minimum-cost role repair (operator 10).

Legal conversations are read by an automaton: an optional system turn, then user and assistant in turn, ending
with the assistant.  Dynamic programming over (turns read, automaton state) finds the cheapest repair:

    keep a turn                                       0
    merge a turn into the one before (its text joins) 1   (2 if the turn's own role is another)
    relabel a turn                                    2   (1 if its role is unknown or null)
    insert an empty turn                              3

Of equally cheap repairs the first in the order keep, merge, relabel, insert is taken, at the earliest turn.
The repaired turns are rendered with role markers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm import words as W

ROLES = ("system", "user", "assistant")
# state: the role of the turn last written; "" at the start
_NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
_FINAL = ("assistant",)
KEEP, MERGE, MERGE_OTHER, RELABEL, RELABEL_UNKNOWN, INSERT = 0, 1, 2, 2, 1, 3


@lru_cache(maxsize=1 << 16)
def repair(roles: tuple[str | None, ...]) -> tuple[int, tuple[tuple[str, str], ...]]:
    """(cost, steps) of the cheapest repair; a step is (what, role), and all but 'insert' take the next turn.

    No turns at all stay no turns, at no cost.
    """
    n = len(roles)
    if not n:
        return 0, ()
    rest: list[dict[str, tuple[int, tuple]]] = [{} for _ in range(n + 1)]  # the best from here on
    for i in range(n, -1, -1):
        best = {}
        for state in ("", *ROLES):
            options: list[tuple[int, int, tuple]] = []
            if i == n and state in _FINAL:
                options.append((0, 0, ()))
            if i < n:
                role = roles[i] if roles[i] in ROLES else None
                for to in _NEXT[state]:
                    if to == role:
                        options.append((KEEP + rest[i + 1][to][0], 1, (("keep", to), to, 1)))
                    else:
                        options.append(((RELABEL_UNKNOWN if role is None else RELABEL) + rest[i + 1][to][0], 3, (("relabel", to), to, 1)))
                if state:
                    options.append(((MERGE if role in (state, None) else MERGE_OTHER) + rest[i + 1][state][0], 2, (("merge", state), state, 1)))
            best[state] = min(options, default=None, key=lambda o: o[:2])
        # insertions: at most one after another of each role, relaxed until nothing gets cheaper
        for _ in range(4):
            for state in ("", *ROLES):
                for to in _NEXT[state]:
                    if best[to] is not None and (best[state] is None or INSERT + best[to][0] < best[state][0]):
                        best[state] = (INSERT + best[to][0], 4, (("insert", to), to, 0))
        rest[i] = {s: (b[0], b[2]) for s, b in best.items()}
    cost, i, state, steps = rest[0][""][0], 0, "", []
    while rest[i][state][1]:
        step, state_to, taken = rest[i][state][1]
        steps.append(step)
        i, state = i + taken, state_to
    return cost, tuple(steps)


def repaired(turns: list[tuple[str | None, str | None]]) -> tuple[int, list[tuple[str, str]]]:
    """(cost, turns) of a conversation; texts merged into one turn are joined by a line break."""
    cost, steps = repair(tuple(role for role, _ in turns))
    result, at = [], 0
    for what, role in steps:
        if what == "insert":
            result.append((role, ""))
            continue
        text = turns[at][1] or ""
        at += 1
        if what == "merge":
            result[-1] = (role, result[-1][1] + "\n" + text if result[-1][1] and text else result[-1][1] or text)
        else:
            result.append((role, text))
    return cost, result


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: id, n_turns, cost, roles (after repair), rendered.

    Turns are taken in the order of turn_col, ties in that of role and text; null turns come last.  Repeated rows are
    turns like others (and get merged).  Roles are compared in lower case without white space around; an unknown or null
    role may become any.  A null text counts as empty.  Each row with a null id is a conversation by itself, as nothing says
    what it belongs to.  An empty table gives an empty result.  Other columns are ignored, whatever their names.  A conversation
    becomes one row, so one task holds it.
    """
    role = F.lower(F.trim(F.col(role_col)))
    turn = F.struct(F.col(turn_col).isNull().alias("z"), F.col(turn_col).alias("t"), role.alias("r"), F.col(text_col).alias("x"))
    given = conversations.select(F.col(id_col).alias("id"), turn.alias("turn"))
    grouped = given.where("id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    grouped = grouped.unionByName(given.where("id IS NULL").select("id", F.array("turn").alias("turns")))
    rows = grouped.select(F.col("id").alias(id_col), F.col("turns.r").alias("r"), F.col("turns.x").alias("x"))

    def text_bytes(lists: pa.Array) -> np.ndarray:
        """Of all texts of each conversation."""
        each = pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(each)])
        to = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        return np.diff(total[to])

    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, 2, length=text_bytes):
            n, costs, roles, texts = [], [], [], []
            for r, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                cost, turns = repaired(list(zip(r, x)))
                n.append(len(turns))
                costs.append(cost)
                roles.append(" ".join(role for role, _ in turns))
                texts.append(render(turns))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(costs, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], [id_col, "n_turns", "cost", "roles", "rendered"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_turns bigint, cost bigint, roles string, rendered string")

"""Chat formatting by minimum-cost role repair.

A legal conversation has at most one system turn, first; then user and
assistant take turns, user first and assistant last.  Dynamic programming over
this automaton chooses, for every turn, its role, a merge with the turn before,
or an empty turn put in before it.  A long conversation is cut into segments:
each gives the costs between all pairs of states, these are joined, and every
segment is repaired between the states fixed for its ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, runs_of, sorted_runs, store, table

#: States: what the last turn was.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant",
           "developer": "system", "instruction": "system"}
#: Costs: joining a turn to the one before, an empty turn, and giving a turn another role.
MERGE, INSERT, RELABEL, UNKNOWN = 2, 4, 5, 3
SEGMENT = 1024  # turn numbers a segment
FAR = 1 << 40
TEMPLATE = "<|{role}|>\n{text}\n"


def role_of(name: str | None) -> int:
    """State of a role name, 0 if it is unknown."""
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def moves() -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state before, state after) -> (cost, action, empty turns before) of one turn."""
    out = {}
    legal = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            if t in legal[s]:
                out[s, t] = (0, "keep", ())
            elif s == t:
                out[s, t] = (MERGE, "merge", ())
            elif t != SYSTEM:  # one empty turn leads there
                between = next((x for x in legal[s] if t in legal[x]), None)
                if between is not None:
                    out[s, t] = (INSERT, "insert", (between,))
    return out


MOVES = moves()
#: Cost of giving a turn of role r (0: unknown) the role t.
GIVE = np.array([[FAR, UNKNOWN, UNKNOWN, UNKNOWN]] + [[FAR] + [0 if r == t else RELABEL for t in (1, 2, 3)] for r in (1, 2, 3)], np.int64)
GIVE[0, SYSTEM] += 1  # an unknown role is rather no system turn
END = np.array([0, INSERT * 2, INSERT, 0], np.int64)  # what it takes to end with an assistant turn
STEP = np.full((4, 4, 4), FAR, np.int64)  # [role, before, after]
for (_s, _t), (_c, _, _) in MOVES.items():
    STEP[:, _s, _t] = np.minimum(FAR, _c + GIVE[:, _t])


def join_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product of two cost tables."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def segment_costs(roles: np.ndarray) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        m = join_costs(m, STEP[r])
    return m


def repair(roles: np.ndarray, first: int, last: int) -> list[int]:
    """States after each turn of a cheapest way from ``first`` to ``last``; of equal ones the least state first."""
    togo = np.full((len(roles) + 1, 4), FAR, np.int64)
    togo[-1, last] = 0
    for k in range(len(roles) - 1, -1, -1):
        togo[k] = np.minimum((STEP[roles[k]] + togo[k + 1][None, :]).min(axis=1), FAR)
    out, s = [], first
    for k, r in enumerate(roles):
        s = int(np.argmin(STEP[r][s] + togo[k + 1]))
        out.append(s)
    return out


def ends(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """States at the ends of the segments of one conversation, on a cheapest way through all of them."""
    togo = [END]
    for m in reversed(tables):
        togo.append(np.minimum((m + togo[-1][None, :]).min(axis=1), FAR))
    togo.reverse()
    out, s = [], START
    for k, m in enumerate(tables):
        t = int(np.argmin(m[s] + togo[k + 1]))
        out.append((s, t))
        s = t
    return out


def format_rows(f: pd.DataFrame, template: str) -> pd.DataFrame:
    """Repaired turns of one segment (sorted), with its end states in s_in, s_out, is_last."""
    roles = f["role_no"].to_numpy()
    states = repair(roles, int(f["s_in"].iat[0]), int(f["s_out"].iat[0]))
    rows, before = [], int(f["s_in"].iat[0])
    for k, (r, s, text) in enumerate(zip(roles, states, f["text"])):
        cost, action, empty = MOVES[before, s]
        cost += int(GIVE[r, s])
        if action == "keep" and r != s:
            action = "relabel"
        shown = "".join(template.format(role=ROLES[x], text="") for x in empty)
        shown += text + "\n" if action == "merge" else template.format(role=ROLES[s], text=text)
        if k == len(roles) - 1 and f["is_last"].iat[0]:
            for x in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(s, ()):
                shown += template.format(role=ROLES[x], text="")
                cost += INSERT
        rows.append((ROLES[s], action, ",".join(ROLES[x] for x in empty), cost, shown))
        before = s
    got = pd.DataFrame(rows, columns=["new_role", "action", "inserted_before", "cost", "rendered"])
    for k, c in enumerate(("conv_id", "turn", "role")):
        got.insert(k, c, f[c].to_numpy())
    return got


RESULT = "conv_id long, turn long, role string, new_role string, action string, inserted_before string, cost long, rendered string"


def format_chats(turns: DataFrame, template: str = TEMPLATE, segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``turns``: its new role, action (keep, relabel, merge, insert),
    the empty turns before it, its cost, and its part of the rendered conversation.

    ``rendered`` in the order of (turn, role, text) makes the conversation.  Turns are ordered
    by number, null first, then role and text; a null text is empty; an unknown or null role is
    given the cheapest one.  Rows without conv_id are one conversation.  A conversation is
    dealt to segments of ``segment`` turn numbers, so that a very long one is no single group.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(1 << 53))))
    rows = rows.withColumn("place", F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "block"))
    order = ["place", F.col("conv_id").asc_nulls_first(), "block", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text"]

    def groups(f):
        """Bounds of the (conv_id, block) runs within a frame of whole places."""
        key = pd.factorize(pd.MultiIndex.from_arrays([f["conv_id"].astype("Int64").astype(str), f["block"]]))[0]
        return zip(*runs_of(key))

    def tables(frames):
        for f in sorted_runs(frames, "place"):
            f["role_no"] = [role_of(r) for r in f["role"]]
            out = [(f["conv_id"].iat[a], f["block"].iat[a], segment_costs(f["role_no"].to_numpy()[a:b]).ravel().tolist()) for a, b in groups(f)]
            got = pd.DataFrame(out, columns=["conv_id", "block", "m"])
            got["conv_id"] = got["conv_id"].astype("Int64")
            yield got

    def through(key, f):
        f = f.sort_values("block")
        got = ends([np.array(m, np.int64).reshape(4, 4) for m in f["m"]])
        f["s_in"], f["s_out"] = [a for a, _ in got], [b for _, b in got]
        f["is_last"] = [False] * (len(f) - 1) + [True]
        f["conv_id"] = f["conv_id"].astype("Int64")
        return f[["conv_id", "block", "s_in", "s_out", "is_last"]]

    def render(frames):
        for f in sorted_runs(frames, "place"):
            f["role_no"] = [role_of(r) for r in f["role"]]
            got = pd.concat([format_rows(f.iloc[a:b], template) for a, b in groups(f)], ignore_index=True)
            got["conv_id"], got["turn"] = got["conv_id"].astype("Int64"), got["turn"].astype("Int64")
            yield got

    costs = rows.repartition("place").sortWithinPartitions(*order).mapInPandas(tables, "conv_id long, block long, m array<long>")
    fixed = costs.groupBy("conv_id").applyInPandas(through, "conv_id long, block long, s_in int, s_out int, is_last boolean")
    fixed = store(fixed).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "s_in", "s_out", "is_last")
    full = rows.join(fixed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    return full.repartition("place").sortWithinPartitions(*order).mapInPandas(render, RESULT)


@query("op2_chat_format")
def op2(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))

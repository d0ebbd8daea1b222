import itertools

import numpy as np

from termflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block string"


def cheapest(roles):
    best = None
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        s, cost = 0, 0
        for r, t in zip(roles, states):
            if (s, t) not in chat.MOVES:
                break
            cost += chat.MOVES[s, t][0] + int(chat.GIVE[r, t])
            s = t
        else:
            cost += int(chat.END[s])
            best = cost if best is None else min(best, cost)
    return best


def legal(rendered):
    roles = [x.split("|>")[0] for x in rendered.split("<|")[1:]]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles)) and len(roles) % 2 == 0


def test_minimum_cost_and_legal(llm):
    rng = np.random.default_rng(0)
    names = [None, "system", "user", "assistant", "Human", "bot", "tool"]
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 7))):
            rows.append((conv, turn, names[rng.integers(0, len(names))], f"t{turn}" if rng.random() < 0.9 else None, "b"))
    df = llm.createDataFrame(rows, SCHEMA)
    whole = chat.format_chats(df).toPandas()
    parts = chat.format_chats(df, segment=2).toPandas()
    assert len(whole) == len(parts) == len(rows)
    for got in (whole, parts):
        for conv, g in got.groupby("conv_id"):
            g = g.sort_values("turn")
            assert legal("".join(g["rendered"])), g
            assert g["cost"].sum() == cheapest([chat.role_of(r) for c, _, r, _, _ in rows if c == conv])


def test_actions(llm):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "user", "there", ""), (1, 2, "assistant", "yes", ""), (2, 0, "assistant", "first", ""), (None, None, None, None, None), (3, 5, "user", "end", "")]
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(llm.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 1].action == "merge" and got[1, 1].rendered == "there\n"
    assert got[2, 0].action == "insert" and got[2, 0].inserted_before == "user"
    assert got[3, 5].rendered == "<|user|>\nend\n<|assistant|>\n\n" and got[3, 5].cost == chat.INSERT
    assert got[None, None].new_role == "user"
    assert chat.format_chats(llm.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_long(llm):
    rows = [(1, 0, "user", "a", "")] * 2 + [(2, k, "user" if k % 2 == 0 else "assistant", "x" * 50000 if k == 3 else "y", "") for k in range(40)]
    got = chat.format_chats(llm.createDataFrame(rows, SCHEMA), segment=8).toPandas()
    assert len(got) == 42 and got[got.conv_id == 2].cost.sum() == 0

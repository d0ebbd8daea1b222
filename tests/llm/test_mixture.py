import pytest

from termflow.llm.mixture import mix


def fill(sizes, share=1.5, most=2.0):
    """Water-filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = budget - sum(full.values())
        total = sum(weight[s] for s in open_)
        target = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | target
        full |= {s: most * sizes[s] for s in over}


ROWS = [(i, "w " * (1 + i % 7) + "é", f"src{i % 5}" if i % 11 else None) for i in range(300)] + [(900, None, "src1"), (901, "", "src2"), (902, "a b c\x0bd", "Z")]


def test_targets_and_taken(make_docs):
    got = mix(make_docs(ROWS)).toPandas()
    assert len(got) == len(ROWS)
    got["s"] = got["source"].where(got["source"].notna(), None)
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len([w for w in (t or "").replace("\x0b", " ").split(" ") if w])
    want = fill(sizes)
    for s, g in got.groupby(got["source"].fillna("~")):
        s = None if s == "~" else s
        assert g["source_size"].iat[0] == sizes[s] == g["size"].sum()
        assert g["target"].iat[0] == pytest.approx(want[s])
        assert abs(g["taken"].sum() - want[s]) <= 1
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    again = mix(make_docs(ROWS[::-1])).toPandas().sort_values("doc_id")
    assert (again["taken"].to_numpy() == got.sort_values("doc_id")["taken"].to_numpy()).all()


def test_whole_documents_and_edges(make_docs):
    got = mix(make_docs(ROWS), whole=True).toPandas()
    assert (got["taken"] == got["copies"] * got["size"]).all()
    for _, g in got.groupby(got["source"].fillna("~")):
        assert abs(g["taken"].sum() - g["target"].iat[0]) <= g["size"].max()
    assert mix(make_docs([])).count() == 0
    assert [r.taken for r in mix(make_docs([(1, None), (2, "")])).collect()] == [0, 0]
    twice = mix(make_docs([(1, "a b c"), (1, "a b c"), (None, "d e")])).toPandas()
    assert len(twice) == 3 and twice["taken"].sum() == 12


def test_many_buckets(make_docs, monkeypatch):
    from termflow.llm import mixture
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 5)
    got = mixture.mix(make_docs(ROWS)).toPandas()
    for _, g in got.groupby(got["source"].fillna("~")):
        assert abs(g["taken"].sum() - g["target"].iat[0]) <= 1

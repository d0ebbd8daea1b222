import random

import pytest

from termflow.llm.common import SHARED_KEYS, components, with_key

N = 1000


def shuffled(seed):
    ids = list(range(N))
    random.Random(seed).shuffle(ids)
    return ids


@pytest.mark.parametrize("chain", [list(range(N)), [0, *range(N - 1, 0, -1)], [1, *range(1300, 100, -1)], shuffled(1), shuffled(2)],
                         ids=["sorted", "two basins", "two basins, gap", "random", "random 2"])
def test_chains(llm, chain):
    """Every node of a chain finds its end, however far; a second chain and a star stay apart."""
    far = 10_000
    edges = [*zip(chain, chain[1:]), *((far + a, far + b) for a, b in zip(chain, chain[1:])), *((5 * far, 5 * far + k) for k in range(-9, 9))]
    got = {r.node: r.root for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    low = min(chain)
    want = {i: low for i in chain} | {far + i: far + low for i in chain} | {5 * far + k: 5 * far - 9 for k in range(-9, 9)}
    assert got == want


def test_no_edges(llm):
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_row_keys(llm):
    """Rows whose id stands once keep it; the others follow by (id, text), however the table is laid out."""
    rows = [(9, "a"), (3, "b"), (7, "x"), (7, "y"), (None, "z"), (None, "u"), (7, "x"), ((1 << 62) + 5, "v")]
    keys = []
    for parts in (1, 3, 7):
        docs = llm.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").repartition(parts)
        got = with_key(docs, key="_k").collect()
        assert sorted(r._k for r in got if r.doc_id in (9, 3)) == [3, 9] and len({r._k for r in got}) == len(rows)
        rest = sorted((r._k, r.doc_id, r.text) for r in got if r._k >= SHARED_KEYS)
        assert [r[1] for r in rest] == [7, 7, 7, (1 << 62) + 5, None, None] and [r[0] - SHARED_KEYS for r in rest] == list(range(6))
        keys.append(rest)
    assert keys[0] == keys[1] == keys[2]
    assert with_key(llm.createDataFrame([], "doc_id long, text string")).count() == 0

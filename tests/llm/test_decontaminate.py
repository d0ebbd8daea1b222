import hashlib
import random
import re

import pytest

from termflow.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(rows, items):
    wins = {}
    for item, text in items:
        ws = words(text)
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            wins.setdefault(tuple(ws[i:i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        ws, hit, found = words(text), set(), set()
        for i in range(len(ws)):
            for n in {len(w) for w in wins}:
                if (w := tuple(ws[i:i + n])) in wins and len(w) == n:
                    hit |= set(range(i, i + n))
                    found |= wins[w]
        names = sorted({str(x) for x in found if x is not None})
        out.append((doc, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, items, **more):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find(docs, bench, **more).selectExpr("doc_id", "found").collect()
    return sorted(((r.doc_id, r.found.n_words, sum(x.after - x.first for x in r.found.runs), len(r.found["items"]),
                    hashlib.sha256(",".join(r.found["items"]).encode()).hexdigest()) for r in got), key=str)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["é", "Ñu", "a", "b1", "zz", "the", "of", "x"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    items = [(k, say(rng.choice([3, 9, 10, 14, 30]))) for k in range(25)] + [(3, say(12)), (None, say(11)), (77, None), (78, ""), (79, "?!")]
    items += [(100 + k, items[4][1]) for k in range(5)]
    rows = [(k, say(rng.randrange(40))) for k in range(60)]
    rows += [(200 + k, say(5) + items[rng.randrange(26)][1].upper() + " " + say(5) + items[rng.randrange(26)][1]) for k in range(40)]
    return rows + [(None, None), (None, ""), (5, "..."), rows[70], rows[70]], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(llm, seed, monkeypatch):
    rows, items = case(seed)
    want = brute(rows, items)
    assert result(llm, rows, items) == want
    monkeypatch.setattr(dc, "SLICE_BYTES", 40)  # texts far longer than a slice
    assert sorted(out_of(dc.Scanner(dc.Windows([(str(i) if i is not None else None, dc.normal(t).split()) for i, t in items if dc.normal(t).split()], 10), 10), rows), key=str) == want


def out_of(scanner, rows):
    for (doc, _), (n, places, groups) in zip(rows, scanner.scan([t for _, t in rows])):
        names = sorted({x for g in groups for x in scanner.block.items[g]})
        yield doc, n, sum(e - s for s, e in dc.merged(places)), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def test_blocks_of_a_large_benchmark(llm):
    rows, items = case(3)
    assert result(llm, rows, items, most=600) == brute(rows, items)


def test_long_items_in_pieces():
    text = dc.normal(" ".join(f"w{k % 37}" for k in range(500)))
    whole = dc.Windows([("1", text.split())], 10)
    cut = dc.Windows([("1", ws) for _, ws in dc.pieces(text, 100, 9)], 10)
    assert sorted(whole.hashes.tolist()) == sorted(cut.hashes.tolist())
    assert [ws for _, ws in dc.pieces(b"", 10, 2)] == [[]] and [f for f, _ in dc.pieces(b"a b c d e", 2, 1)] == [0, 1, 2, 3]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "mix64", lambda h: h & dc.np.uint64(7))
    rows, items = case(4)
    scanner = dc.Scanner(dc.Windows([(str(i) if i is not None else None, dc.normal(t).split()) for i, t in items if dc.normal(t).split()], 10), 10)
    assert sorted(out_of(scanner, rows), key=str) == brute(rows, items)


def test_removal(llm):
    item = "one two three four five six seven eight nine ten eleven"
    docs = llm.createDataFrame([(1, f"Keep this. {item.title()}! And this.", 4), (2, "clean, whole  text", 5), (3, None, 6), (4, item, 7)], "doc_id long, text string, found int")
    bench = llm.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    spans = {r.doc_id: r.text for r in dc.decontaminate(docs, bench).collect()}
    assert spans == {1: "Keep this. ! And this.", 2: "clean, whole  text", 3: None, 4: ""}
    left = dc.decontaminate(docs, bench, remove="documents")
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3}
    assert dc.decontaminate(docs, bench.limit(0)).count() == 4 and dc.decontaminate(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        dc.find(docs, bench)
    with pytest.raises(ValueError):
        dc.decontaminate(docs, bench, remove="all")

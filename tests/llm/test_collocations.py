import random
import re
from collections import Counter

import pytest

from termflow.llm import collocations as co


def brute(rows, least=10, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in wanted.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        rows_ = []
        for p, a in wanted.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((" ".join(p), a, f[p[:k]], f[p[k:]], score))
        rows_.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i + 1, p, a, l, r, totals[lang], s) for i, (p, a, l, r, s) in enumerate(rows_[:top])]
    return sorted(out)


def text(rng, n, vocabulary):
    phrases = ["new york city", "The the THE", "é ñ\x00u", "x\ty  z"]
    word = lambda: rng.choice(phrases) if rng.random() < .2 else f"w{min(int(rng.paretovariate(.7)), vocabulary)}"
    return "".join(word() + rng.choice([" ", " ", " ", "\t", ". ", "\n", ";"]) for _ in range(n))


def rows_of(seed, vocabulary=60):
    rng = random.Random(seed)
    rows = [(rng.choice(["en", "de", None, "und", "x"]), text(rng, rng.randrange(200), vocabulary)) for _ in range(120)]
    return rows + [("en", None), (None, ""), ("fr", "only a few words"), ("", "a b " * 30), ("en", text(rng, 4000, vocabulary))] + rows[:10]


def result(spark, rows, **more):
    docs = spark.createDataFrame([(1, lang, t, 3, "p", 5) for lang, t in rows], "doc_id long, lang string, text string, n long, phrase string, a int")
    return sorted(tuple(r) for r in co.mine(docs, **more).collect())


def test_equals_brute_force(llm):
    rows = rows_of(1)
    assert result(llm, rows) == brute(rows)


@pytest.mark.parametrize("top", [1, 5, 40])
def test_bounded_growth_settles_the_last_place(llm, monkeypatch, top):
    rows = rows_of(2)
    monkeypatch.setattr(co, "FIRST_BAND", 1)
    monkeypatch.setattr(co, "DEEPER", 2)
    assert result(llm, rows, top=top) == brute(rows, top=top)


def test_bounds_are_admissible(llm):
    f = Counter()
    for lang, t in rows_of(3):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").lower()):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    for p, a in f.items():
        if len(p) == 3:
            assert min(a * a * 10**6 // (f[p[:k]] * f[p[k:]]) for k in (1, 2)) <= f[p[:2]] * 10**6 // f[p[:1]]


def test_small_slices_and_flushes(llm, monkeypatch):
    rows = rows_of(4, 300)
    parts = []
    for name, value in (("SLICE_BYTES", 50), ("MOST_PHRASES", 30), ("MOST_WORDS", 40)):
        monkeypatch.setattr(co, name, value)
    for m in (1, 2, 3):
        counter, got = co.Counter(m, None), Counter()
        for _, t in rows:
            seen = 0
            for first, ws in co.pieces(co.folded(t), co.SLICE_BYTES, m - 1):
                counter.add("en", ws, first + len(ws) - seen)
                seen = first + len(ws)
                if counter.full():
                    parts += list(counter.rows())
        parts += list(counter.rows())
        for b in parts:
            for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if p is not None:
                    got[p] += n
        want = Counter()
        for _, t in rows:
            for piece in co.folded(t).split(b"."):
                ws = piece.split()
                want.update(b" ".join(ws[i:i + m]) for i in range(len(ws) - m + 1))
        assert got == want
        parts = []


def test_large_counts_are_exact(llm):
    row = llm.sql("select 400000000000000L a, 400000000000000L l, 400000000000003L r").select(co._score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * (4 * 10**14) ** 2 // (4 * 10**14 * (4 * 10**14 + 3))


def test_empty(llm):
    assert result(llm, []) == [] and result(llm, [("en", None), (None, " . ")]) == []

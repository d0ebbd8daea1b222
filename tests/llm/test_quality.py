import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from termflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    ws = WORD.findall(text)
    windows = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é|\x0b", max_size=120))
def test_counts(text):
    assert quality.measure(text) == brute(text)


def test_wide_vocabulary():
    ws = [f"w{i % 4001}".encode() for i in range(9000)]
    assert quality.repeated_window_words(ws) == brute(" ".join(w.decode() for w in ws))[4]


def test_verdicts(llm, make_docs):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice([f"word{i}" for i in range(300)], 60)) for _ in range(60)]
    junk = [" ".join(rng.choice([f"%%{i}##" for i in range(300)], 60)) for _ in range(40)]
    rows = [*enumerate(good), *((100 + i, t) for i, t in enumerate(junk)), (200, None), (201, ""), (202, "too short"), (None, good[0]), (None, good[0]), (203, "a b c d e f " * 30)]
    labels = llm.createDataFrame([(i, 1, 0) for i in range(30)] + [(100, 0, 0), (None, 1, 0), (29, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(make_docs(rows), labels).toPandas()
    assert len(got) == len(rows)
    one = got[got.doc_id.notna()].set_index("doc_id")
    assert one.loc[list(range(60)), "kept"].all() and not one.loc[list(range(100, 140)), "kept"].any()
    assert not one.loc[[200, 201, 202, 203], "kept"].any() and one.loc[[200, 201, 202, 203], "base_failed"].all()
    assert got[got.doc_id.isna()].kept.all()
    for i, t in rows:
        if i is not None:
            assert tuple(one.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == brute(t or "")
    empty = labels.where("false")
    assert quality.quality(make_docs([]), labels).count() == 0
    assert quality.quality(make_docs(rows[:70]), empty).where("kept").count() == 60 + 10


def test_buckets_and_threshold_follow_the_labels(llm, make_docs, monkeypatch):
    """Junk of ordinary letters is told from prose among 150,000 trusted pairs, and every score equals a plain-dictionary count."""
    rng = np.random.default_rng(5)
    prose = [" ".join(f"w{i}" for i in rng.integers(0, 1500, 500)) for _ in range(400)]
    junk = [" ".join(f"w{i}" for i in np.r_[rng.integers(0, 1500, 420), rng.integers(9000, 9400, 80)]) for _ in range(250)]
    rows = [*enumerate(prose), *((1000 + i, t) for i, t in enumerate(junk))]
    labels = llm.createDataFrame([(i, 1, 0) for i in range(380)] + [(1000 + i, 0, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows).repartition(2)
    got = quality.quality(docs, labels).toPandas().set_index("doc_id")
    assert got.loc[list(range(400)), "kept"].mean() > 0.97
    assert got.loc[[1000 + i for i in range(150, 250)], "kept"].mean() < 0.03
    rules = quality.Rules(docs, labels)
    picked = quality.labelled_rows(docs, labels).where("part = 'trusted'").collect()
    want = plain_ratios([r.text for r in picked], [t for _, t in rows], rules.buckets)
    for i, t in rows[::7]:
        means = [sum(want[k][g] for g in grams) / len(grams) for k, grams in enumerate(plain_grams(t, rules.buckets))]
        assert abs(got.llr[i] - sum(means) / 2) < 1e-6
        assert got.kept[i] == (not got.base_failed[i] and got.llr[i] >= rules.threshold)
    monkeypatch.setattr(quality, "HELD_GRAMS", 100)
    monkeypatch.setattr(quality, "MOST_GRAMS", 10_000)
    monkeypatch.setattr(quality, "TASKS", 1)
    again = quality.quality(docs.repartition(7), labels).toPandas().set_index("doc_id").loc[got.index]
    assert (got.llr == again.llr).all() and (got.kept == again.kept).all()


def plain_grams(text, buckets):
    """Buckets of words and pairs, one by one."""
    h = [zlib.crc32(w.encode()) + 1 for w in WORD.findall(text.lower())]
    mix = lambda v: int(quality.mix64(np.array([v % 2**64], np.uint64))[0]) % buckets
    return [[mix(a) for a in h], [mix(a * 0x9E3779B97F4A7C15 + b) for a, b in zip(h, h[1:])]]


def plain_ratios(trusted, raw, buckets):
    out = []
    sides = [[plain_grams(t, buckets) for t in texts] for texts in (trusted, raw)]
    for k in range(2):
        seen, full = (Counter(g for grams in side for g in grams[k]) for side in sides)
        share = sum(seen.values()) / sum(full.values())
        out.append({g: math.log((seen[g] + 1) / (n * share + 1)) for g, n in full.items()})
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 65535), st.integers(1, 2**62), max_size=50))
def test_packed_blocks(counts):
    block = np.zeros(quality.BUCKETS, np.uint64)
    for k, v in counts.items():
        block[k] = v
    at, n = quality.unpacked(quality.packed(block))
    assert dict(zip(at.tolist(), n.tolist())) == counts


def test_trusted_words_are_bounded(llm, make_docs, monkeypatch):
    docs = make_docs([(i, "w " * (5 if i % 2 else 50)) for i in range(40)])
    labels = llm.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "LONGEST_TRUSTED", 20)
    monkeypatch.setattr(quality, "TRUSTED_WORDS", 33)
    picked = quality.labelled_rows(docs, labels).collect()
    assert len(picked) == 6 and all(len(r.text.split()) == 5 for r in picked)


def test_best_threshold():
    good, bad = np.linspace(-0.2, 0.3, 50), np.linspace(-2, -0.6, 30)
    assert abs(quality.best_threshold(good, bad) + 0.4) < 1e-9
    assert quality.best_threshold(good, bad[:5]) == quality.THRESHOLD


def test_every_labelled_row_is_learnt_from(llm, make_docs):
    """More trusted rows, held rows and words than were taken once."""
    rows = [*((i, f"good text {i}") for i in range(21_000)), *((100_000 + i, f"bad text {i}") for i in range(10_500)), (21_000, "long " * 70_000)]
    labels = llm.createDataFrame([(i, int(i < 100_000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    picked = quality.labelled_rows(make_docs(rows), labels).groupBy("part").count().collect()
    found = {r["part"]: r["count"] for r in picked}
    held = labels.where("pmod(xxhash64(doc_id, 'held'), 5) = 0").groupBy("quality").count().collect()
    held = {r["quality"]: r["count"] for r in held}
    assert held[0] > 2_000 and found == {"good": held[1], "bad": held[0], "trusted": 21_001 - held[1]}
    assert held[1] > 2_000 or found["trusted"] > 17_000
    whole = quality.labelled_rows(make_docs(rows), labels.where("quality = 1"))
    assert whole.count() == 21_001 and whole.where("length(text) = 350000 and part = 'trusted'").count() == 1


def test_buckets_stay_bounded_while_every_gram_counts(llm, make_docs, monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 64)
    monkeypatch.setattr(quality, "MOST_BUCKETS", 128)
    texts = [" ".join(f"w{i}" for i in range(k, k + 50)) for k in range(40)]
    docs = make_docs([*enumerate(texts)])
    rules = quality.Rules(docs, llm.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int"))
    assert rules.buckets == 128
    want = plain_ratios(texts[:30], texts, 128)
    for k in range(2):
        assert all(abs(rules.shared.value[k][g] - x) < 1e-5 for g, x in want[k].items())

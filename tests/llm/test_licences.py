import re

from termflow.llm.licences import BASE, evaluate, expressions, scan, shunting_yard


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in BASE.items() for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(ws), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_scan_against_brute_force(make_docs):
    texts = ["Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY", "All rights\nreserved. GNU General Public License, version 3", None, "", "é cc by é", "ccby all rights reservedx",
             "nothing here " * 2000 + "all rights reserved", "cc by", "cc by"]
    got = {r.doc_id: r for r in scan(make_docs(list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert scan(make_docs([])).count() == 0
    assert scan(make_docs([(None, "cc by"), (None, "cc by")])).count() == 2


def test_expressions(make_docs):
    texts = ["SPDX-License-Identifier: MIT OR Apache-2.0", "spdx-license-identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "MIT License and the Mozilla Public License"]
    got = [r for r in scan(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert [r.expressions for r in got] == ["mit or apache-2.0", "gpl-2.0 with classpath-exception", "mit and mpl"]
    assert [round(r.score, 3) for r in got] == [1.0, 0.6, 0.7]
    assert expressions([], []) == []


def test_shunting_yard():
    assert shunting_yard("mit or gpl and bsd".split()) == ["mit", "gpl", "bsd", "and", "or"]
    assert evaluate(shunting_yard("( mit or gpl ) and mpl".split())) == 0.7
    assert evaluate(shunting_yard("gpl with classpath-exception or reserved".split())) == 0.4 + 0.2
    for bad in ("mit or", "or mit", "( mit", "mit )", "mit gpl", ""):
        assert shunting_yard(bad.split()) is None


def test_tagged_expressions(make_docs):
    texts = ["# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: MIT AND (LicenseRef-x OR Artistic-2.0)\ncc by",
             "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: 0BSD OR\n", "SPDX-License-Identifier: (MIT OR", "SPDX-License-Identifier: MIT or see the notes. All rights reserved", "# SPDX-License-Identifier: MIT OR\n#   Apache-2.0\n# next", "SPDX-License-Identifier:\n  ISC\nand more"]
    got = scan(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.expressions for r in got] == ["( mit or apache-2.0 ) and gpl-3.0", "bsl-1.0", "mit and ( licenseref-x or artistic-2.0 ); cc-by",
                                           "gpl-2.0 with classpath-exception", "0bsd", "( mit", "mit; reserved", "mit or apache-2.0", "isc"]
    assert [round(r.score, 3) for r in got] == [0.4, 0.5, 0.5, 0.6, 0.5, 0.0, 0.0, 1.0, 1.0]
    assert got[2].labels == "artistic-2.0,cc-by,licenseref-x,mit" and got[0].labels == "apache-2.0,gpl-3.0,mit"
    for r, t in zip(got, texts):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)

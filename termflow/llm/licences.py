"""License scans: an Aho-Corasick automaton finds identifier tags and notice
phrases, a shunting-yard parser evaluates and/or/with expressions of them."""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table, text_of

#: Base phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels (SPDX short names in lower case).
NOTICES = {
    "mit license": "mit", "apache license": "apache", "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "creative commons attribution": "cc-by", "public domain": "public-domain", "unlicense": "unlicense",
    "isc license": "isc", "zlib license": "zlib", "classpath exception": "classpath-exception",
}
#: Words of SPDX identifiers after a tag, and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2.0", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc": "isc",
    "mpl 2 0": "mpl", "epl 2 0": "epl", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "gpl 2 0 only": "gpl-2.0", "gpl 2 0 or later": "gpl-2.0",
    "gpl 3 0 only": "gpl-3.0", "gpl 3 0 or later": "gpl-3.0", "lgpl 2 1 or later": "lgpl",
    "agpl 3 0 or later": "agpl", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc",
    "cc0 1 0": "cc0", "unlicense": "unlicense", "zlib": "zlib", "classpath exception 2 0": "classpath-exception",
}
#: How freely text under a label may be used, 0 to 1; labels that are not listed count 0.5.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "apache-2.0": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "cc0": 1.0,
    "public-domain": 1.0, "unlicense": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6,
    "cc-by-sa": 0.6, "gpl": 0.4, "gpl-2.0": 0.4, "gpl-3.0": 0.4, "agpl": 0.3, "cc-by-nd": 0.2,
    "cc-by-nc": 0.2, "classpath-exception": 0.2, "reserved": 0.0,
}
TAG = "spdx license identifier"
OPERATORS = {"or": 1, "and": 2, "with": 3}

_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
              for c in range(256))


def normal_words(text: str) -> list[bytes]:
    """A-Z lowered, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


_W = r"0-9A-Za-z\x80-\U0010ffff"
#: A tag in the raw text, with what stands between it and its expression on the line.
_TAGGED = re.compile(rf"(?<![{_W}])SPDX[^{_W}]+License[^{_W}]+Identifier(?![{_W}])[^{_W}(\r\n]*", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[ \t]*([()]|[0-9A-Za-z](?:[0-9A-Za-z.:+-]*[0-9A-Za-z+])?)")
#: The first token after a line break and comment signs.
_WRAPPED = re.compile(rf"[ \t]*[\r\n][^{_W}()]*" + _TOKEN.pattern)


def tagged_tokens(text: str, at: int = 0) -> tuple[list[str], int]:
    """Labels, operators and parentheses of the expression at ``at``, and the place of its end.

    An identifier outside the fixed list is a label of its own, in lower case.  Prose may
    follow: after a small-letter operator it takes more than small letters to be one, and
    after a line break only identifiers of the list go on with the expression."""
    out: list[str] = []
    depth, operand, listed, small, last = 0, True, False, False, at
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            m, listed = _WRAPPED.match(text, at), True
        if m is None:
            break
        t = m[1].lower()
        if t in "()":
            if t == "(" and not operand or t == ")" and (operand or not depth):
                break
            depth += 1 if operand else -1
            out.append(t)
        elif t in OPERATORS:
            if operand:
                break
            out.append(t)
            operand, small = True, m[1] == t
        else:
            known = IDENTIFIERS.get(" ".join(w.decode() for w in normal_words(t.removesuffix("+"))))
            if not operand or known is None and (listed or small and m[1].isalpha() and m[1] == t):
                break
            out.append(known or t)
            operand = False
        at = m.end()
        if not operand:
            listed, last = False, at
    while out and operand and (out[-1] in OPERATORS or out[-1] == "("):  # an operator without a right side ends before it
        if out.pop() != "(":
            operand = False
    return out, last


def shunting_yard(tokens: list[str]) -> list[str] | None:
    """Infix tokens (labels, and/or/with, parentheses) to postfix; None if malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in OPERATORS:
            if operand:
                return None
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> float:
    """Openness of an expression: ``and`` binds to the strictest side, ``or`` lets
    the reader choose the freest, ``with`` adds what its exception gives."""
    stack: list[float] = []
    for t in postfix:
        if t in OPERATORS:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if t == "and" else max(a, b) if t == "or" else min(1.0, a + b))
        else:
            stack.append(OPENNESS.get(t, 0.5))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """One automaton over normalised text ' w1 w2 ... '; a pattern is a word
    sequence between single spaces."""
    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES)):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, label))
    found[TAG] = [("tag", "")]
    a = ahocorasick.Automaton()
    for phrase, kinds in found.items():
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, kinds))
    a.make_automaton()
    return a


def expressions(hits: list[tuple[int, int, list[tuple[str, str]]]], ws: list[bytes], tagged: list[tuple[int, int, list[str]]] = ()) -> list[list[str]]:
    """Infix expressions: those of tags, and notice labels that stand apart by nothing but one operator.

    ``hits`` are (first word, number of words, kinds), ``tagged`` (first word, word after, tokens)
    of the expressions after tags; at one place the longest notice phrase wins."""
    names: dict[int, tuple[int, str]] = {}
    for start, n, kinds in hits:
        for kind, label in kinds:
            if kind in ("base", "notice") and n > names.get(start, (0, ""))[0]:
                names[start] = (n, label)
    after = {start: (end, tokens) for start, end, tokens in tagged}
    out, taken = [], -1
    for start in sorted({*names, *after}):
        if start < taken:
            continue
        if start in after:
            taken, line = after[start]
            out.append(line)
            continue
        at, line = start, []
        while at in names:
            n, label = names[at]
            line.append(label)
            at += n
            op = ws[at].decode("utf-8", "surrogatepass") if at < len(ws) else ""
            step = next((s for s in (at + 1, at + 2, at + 3) if s in names), None)
            if op not in OPERATORS or step is None:
                break
            line.append(op)
            at = step
        out.append(line)
        taken = at
    return out


def tagged_places(text: str) -> list[tuple[int, int, list[str]]]:
    """(first word, word after, tokens) of the expression after every tag of a text."""
    out, words, spot = [], 0, 0
    for m in _TAGGED.finditer(text):
        tokens, end = tagged_tokens(text, m.end())
        words += len(normal_words(text[spot:m.end()]))
        spot = m.end()
        if tokens:
            out.append((words, words + max(1, len(normal_words(text[spot:end]))), tokens))
    return out


def scan_texts(texts: list[str], auto: ahocorasick.Automaton) -> pd.DataFrame:
    rows = []
    for text in texts:
        ws = normal_words(text)
        line = " " + b" ".join(ws).decode("utf-8", "surrogatepass") + " "
        hits, spot, words = [], 0, 0
        for opening, n, kinds in sorted(_places(auto, line), key=lambda x: x[:2]):
            words += line.count(" ", spot, opening)
            spot = opening
            hits.append((words, n, kinds))
        base = sorted((s, n, label) for s, n, kinds in hits for kind, label in kinds if kind == "base")
        tagged = tagged_places(text) if any(k == "tag" for *_, kinds in hits for k, _ in kinds) else []
        exprs = expressions(hits, ws, tagged) if hits else []
        values = [evaluate(p) for e in exprs if (p := shunting_yard(e))]
        labels = {x for e in exprs for x in e if x not in OPERATORS and x not in "()"} | {label for *_, label in base}
        rows.append((len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                     ",".join(sorted({label for *_, label in base})), ",".join(sorted(labels)),
                     min(values) if values else 0.0, "; ".join(" ".join(e) for e in exprs)))
    return pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"])


def _places(auto, line):
    """(place of the opening space, number of words, kinds) of every match."""
    for end, (n, kinds) in auto.iter(line):
        opening = end
        for _ in range(n):
            opening = line.rfind(" ", 0, opening)
        yield opening, n, kinds


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, expressions string")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base phrase places, labels, the openness
    (0 to 1) of the strictest licence expression, and the expressions.

    A null text counts as empty (no words, empty labels, score 0).  Repeated
    rows and null ids are scanned on their own; other columns are not read.  No shuffle.
    """
    def run(frames):
        auto = automaton()
        for f in frames:
            got = scan_texts(f["text"].tolist(), auto)
            got.insert(0, "doc_id", f["doc_id"])
            for c in ("first_word", "last_word", "doc_id"):
                got[c] = got[c].astype("Int64")
            yield got

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id long, {RESULT}")


@query("op1_license_scan")
def op1(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))

"""HTML extraction by minimum-cut labelling.

A page falls into text blocks.  Classifier costs of each block are its
capacities to the two terminals, neighbours in the page and in the tree are
joined by smoothness edges, and a maximum flow parts content from boilerplate."""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table

#: Elements that break a text, elements without text of the page, elements without an end.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                       "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot "
                       "th thead tr ul".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id or role that speak for boilerplate or for content.
BOILERPLATE_TAGS = frozenset("nav footer aside header form menu dialog button label fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation footer header masthead "
                              "comment comments respond reply replies disqus cookie cookies consent notice alert promo promotion sponsored sponsor related recommended "
                              "share sharing social subscribe newsletter signup login popup modal overlay breadcrumb breadcrumbs pagination pager widget "
                              "toolbar search complementary contentinfo copyright legal teaser".split())
CONTENT_WORDS = frozenset("article articlebody content main post entry story body text".split())
#: First parts of names that tell of something elsewhere on the page, last parts of names of page-wide wrappers,
#: elements of forms, elements that quote or list within a text, and words of articles that are not the page's.
ELSEWHERE = frozenset("has have with without no not hide hidden show is".split())
PAGE_WORDS = frozenset("page layout site app shell outer root".split())
FORM_TAGS = frozenset("form fieldset label button dialog".split())
WITHIN_TEXT = frozenset("blockquote pre q code".split())
ARTICLES_ELSEWHERE = frozenset("comment comments reply replies respond teaser ad ads advert advertisement promo sponsored sponsor related recommended".split())
#: Weights of the classifier and of the smoothness edges.
WEIGHTS = {"bias": 1.0, "container": 6.0, "length": 2.0, "sentence": 1.0, "heading": 1.0, "links": 4.0, "short": 1.0, "next": 0.5, "sibling": 0.5}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


CONTENT, UNKNOWN, WRAPPER, FORM, BOILERPLATE = 1, 0, -1, -2, -3


def leaning(tag: str, attributes: str, inherited: int) -> int:
    """What an element says of the text in it; the innermost element that tells decides.

    ``CONTENT``, ``UNKNOWN``, or against it: ``WRAPPER`` (a page-wide element whose name merely mentions a listed word), ``FORM``, ``BOILERPLATE``.
    Names of a class, id or role count one by one; one that starts with has-, with-, no- and the like says what the page has elsewhere.  An
    article within a wrapper or form is content again, a main element within anything; their own names do not speak
    against them, but for comments and teasers marked up as articles.  A header within an article holds its title, and a quotation or listing in it belongs to it."""
    names = []
    if attributes and ("class" in attributes or "id" in attributes or "role" in attributes):
        for _, a, b, c in _ATTRIBUTE.findall(attributes):
            names += [w for n in (a or b or c).lower().split() if (w := _WORD.findall(n)) and w[0] not in ELSEWHERE]
    words = {w for n in names for w in n}
    if tag == "main":
        return CONTENT
    if tag == "article":
        return BOILERPLATE if words & ARTICLES_ELSEWHERE or inherited == BOILERPLATE else CONTENT
    if tag in ("body", "html"):
        return inherited
    if tag in BOILERPLATE_TAGS and not (tag == "header" and inherited > 0):
        return BOILERPLATE if tag not in FORM_TAGS else min(inherited, FORM)
    against = [n for n in names if set(n) & BOILERPLATE_WORDS - ({"header"} if inherited > 0 else set())]
    if against and not (inherited > 0 and tag in WITHIN_TEXT):
        wraps = all(len(n) > 1 and n[-1] in PAGE_WORDS for n in against)
        return min(inherited, WRAPPER) if wraps else BOILERPLATE
    if words & CONTENT_WORDS:
        return CONTENT if inherited >= WRAPPER else inherited
    return inherited


class Block:
    __slots__ = ("text", "tag", "lean", "parent", "linked")

    def __init__(self, text, tag, lean, parent, linked):
        self.text, self.tag, self.lean, self.parent, self.linked = text, tag, lean, parent, linked


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order.  An element that is left open ends with its parent."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    # open elements: (tag, leaning, number of the element, is a block)
    stack = [("", 0, 0, True)]
    number = anchors = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                owner = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][3])
                out.append(Block(text, stack[owner][0], stack[-1][1], stack[max(0, owner - 1)][2], linked))
            parts.clear()
        linked = 0

    def add(text):
        nonlocal linked
        if "&" in text:
            text = unescape(text)
        parts.append(text)
        if anchors:
            linked += len(text)

    def close(k):
        nonlocal anchors
        while len(stack) > k:
            tag = stack.pop()[0]
            anchors -= tag == "a"

    at = 0
    search = _TOKEN.search
    while m := search(page, at):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCK_TAGS:
                flush()
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k and (tag in BLOCK_TAGS or not any(s[3] for s in stack[k + 1:])):
                close(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            continue
        attributes = m.group(3)
        if tag in RAW_TAGS:
            if tag == "head":  # the body may start without the head's end
                end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                if end:
                    at = end.start() if end.group().lower().startswith("<body") else end.end()
                continue
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th")}.get(tag, ("td", "th"))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table"):
                        break
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p"), 0)
            if k:
                close(k)
        number += 1
        anchors += tag == "a"
        lean = stack[-1][1]
        if attributes or tag in BOILERPLATE_TAGS or tag in CONTENT_TAGS:
            lean = leaning(tag, attributes, lean)
        if not attributes.endswith("/"):
            stack.append((tag, lean, number, tag in BLOCK_TAGS))
        else:
            anchors -= tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return out


def costs(b: Block) -> tuple[float, float]:
    """(capacity from the content terminal, capacity to the boilerplate terminal) of a block."""
    w, n = WEIGHTS, len(b.text)
    content = w["bias"] + w["length"] * min(1.0, n / 200)
    boiler = w["bias"] + w["links"] * min(1.0, b.linked / n)
    if b.text[-1] in ".!?:;…”\"'»":
        content += w["sentence"]
    elif n < 25:
        boiler += w["short"]
    if b.tag in ("h1", "h2", "h3"):
        content += w["heading"]
    if b.lean > 0:
        content += w["container"]
    elif b.lean < 0:
        boiler += w["container"] * (0.25 if b.lean == WRAPPER else 2)
    return content, boiler


def min_cut(content: list[float], boiler: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay on the content side of a minimum cut.

    Nodes whose own capacities outweigh all their edges are settled first (no cut would part
    them from that terminal) and pass their edges on to their neighbours' capacities; what is
    left goes through augmenting paths."""
    n = len(content)
    content, boiler = content[:], boiler[:]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[j][i] = near[i].get(j, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(content[i] - boiler[i]) > sum(near[i].values()):
            side[i] = content[i] > boiler[i]
            for j, c in near[i].items():
                del near[j][i]
                if side[i]:
                    content[j] += c
                else:
                    boiler[j] += c
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if not left:
        return side
    source, sink = n, n + 1
    residual: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left}
    residual[source], residual[sink] = {}, {}
    for i in left:
        both = min(content[i], boiler[i])  # flow straight through
        residual[source][i], residual[i][source] = content[i] - both, 0.0
        residual[i][sink], residual[sink][i] = boiler[i] - both, 0.0
    while True:
        come = {source: source}
        wave = deque([source])
        while wave and sink not in come:
            u = wave.popleft()
            for v, c in residual[u].items():
                if c > 1e-12 and v not in come:
                    come[v] = u
                    wave.append(v)
        if sink not in come:
            break
        path, v = [], sink
        while v != source:
            path.append((come[v], v))
            v = come[v]
        flow = min(residual[u][v] for u, v in path)
        for u, v in path:
            residual[u][v] -= flow
            residual[v][u] = residual[v].get(u, 0.0) + flow
    for i in left:
        side[i] = i in come
    return side


def main_text(page: str) -> str:
    """Content blocks in page order, joined by line feeds; empty if there are none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    capacities = [costs(b) for b in blocks]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[(i - 1, i)] = WEIGHTS["next"]
        if b.parent in last:  # the nearest block before it under the same element
            edges[(last[b.parent], i)] = edges.get((last[b.parent], i), 0.0) + WEIGHTS["sibling"]
        last[b.parent] = i
    side = min_cut([c for c, _ in capacities], [c for _, c in capacities], edges)
    return "\n".join(b.text for b, keep in zip(blocks, side) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page, or one without content, has an empty text.  Pages are
    read on their own, so repeated rows and null ids pass through.  No shuffle.
    """
    def run(frames):
        for f in frames:
            texts = [main_text(p) for p in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


@query("op7_html_text")
def op7(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))

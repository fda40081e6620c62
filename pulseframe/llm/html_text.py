"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes text blocks with their chain of open elements. A linear classifier over the innermost telling element,
length, punctuation and link density gives each block log-odds of being content; times the share of a full line that it
holds, they are its cost for either label and its capacity to the two terminals. So a short line follows its neighbours: blocks
that follow each other, and blocks with a near common ancestor, are joined by smoothness edges of the same
size as the costs. The maximum flow's source side is the content. On a page whose cut keeps nothing, all
blocks outside boilerplate elements get PRIOR more, since a page has some content.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import table
from .textops import slices

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Element names by role (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
SKIPPED = frozenset("script style noscript template head title svg math canvas object iframe audio video textarea select datalist".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
CLOSED_BY = {"p": None, "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Log-odds of the block classifier: by element, by word in class, id or role. Of all elements around a block the
#: most negative one counts, if there is one, else the most positive one.
ELEMENTS = dict.fromkeys("nav footer aside form menu button dialog fieldset header".split(), -7.0) | {"article": 1.25, "main": 1.0}
BAD_WORDS = dict.fromkeys(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login social share sharing related recommended comment comments commentlist reply replies respond disqus discussion popup modal overlay widget toolbar pagination pager copyright legal disclaimer skip hidden search contentinfo complementary".split(),
    -7.0,
)
GOOD_WORDS = dict.fromkeys("article content post entry story main body text prose".split(), 1.0)
#: Characters of a full line; what a block gets where a page would have no content, if its log-odds are over BOILERPLATE.
LINE, PRIOR, BOILERPLATE = 80, 6.0, -3.5
NEXT_EDGE, OWN_EDGE, ABOVE_EDGE, APART = 0.6, 1.0, 0.5, 0.2


class _Open:
    __slots__ = ("tag", "number", "weight", "skip", "article", "link")

    def __init__(self, tag, number, weight, skip, article, link):
        self.tag, self.number, self.weight, self.skip, self.article, self.link = tag, number, weight, skip, article, link


def _weight(tag: str, attributes: str, up: _Open) -> tuple[float, bool]:
    weight, skip = 0.0, False
    inside = up.article
    if tag in ELEMENTS and not (tag == "header" and inside):
        weight = ELEMENTS[tag]
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                skip = True
            elif name in ("class", "id", "role"):
                words = [w.lower() for w in _WORDS.findall(value)]
                bad = any(w in BAD_WORDS for w in words)
                good = any(w in GOOD_WORDS for w in words)
                weight = min(weight, -7.0) if bad else max(weight, 1.0) if good and weight >= 0 else weight
    return weight, skip


def blocks(page: str) -> list[tuple[str, float, tuple[int, int, int]]]:
    """(text, classifier score, numbers of its own element, the one around that and the innermost telling one) of every
    non-empty block."""
    out: list[tuple[str, float, tuple[int, int, int]]] = []
    stack = [_Open("", 0, 0.0, False, False, False)]
    parts: list[str] = []
    linked = 0
    made, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                holders = [x for x in stack if x.tag not in INLINE]
                told = next((x.number for x in reversed(holders) if x.weight), 0)
                out.append((text, _score(text, holders, linked), (holders[-1].number, holders[-2].number if len(holders) > 1 else 0, told)))
            parts.clear()
        linked = 0

    def close_to(k: int) -> None:
        flush()
        del stack[k:]

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            piece = m[0]
            if (piece[0] != "<" or piece == "<") and not stack[-1].skip:
                parts.append(piece)
                if stack[-1].link:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag not in INLINE:
                flush()
            if k:
                if any(x.tag not in INLINE for x in stack[k:]):
                    close_to(k)
                else:
                    del stack[k:]
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                if tag == "br":
                    parts.append(" ")
                continue
        else:
            flush()
            shut = CLOSED_BY.get(tag)
            k = 0
            if tag in PARAGRAPH_ENDS:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag not in INLINE), 0)
                k = k if stack[k].tag == "p" else 0
            elif shut:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in shut.split() or stack[i].tag in ("ul", "ol", "dl", "table")), 0)
                k = k if stack[k].tag in shut.split() else 0
            if k:
                close_to(k)
            if tag in VOID:
                continue
        if (m[3] or "").rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        up = stack[-1]
        weight, skip = _weight(tag, m[3] or "", up) if tag not in INLINE or m[3] else (0.0, False)
        made += 1
        stack.append(_Open(tag, made, weight, up.skip or skip or tag in SKIPPED, up.article or tag in ("article", "main"), up.link or tag == "a"))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            stack.pop()
    flush()
    return out


def _score(text: str, holders: list[_Open], linked: int) -> float:
    """Capacity to the content terminal (positive) or the other one."""
    size = len(text)
    told = [x.weight for x in holders if x.weight]
    odds = min(told) if told and min(told) < 0 else max(told, default=0.0)
    tag = holders[-1].tag
    row = tag in ("li", "td", "th", "dt", "dd", "label", "option")
    odds += 2.0 if size >= 200 else 1.0 if size >= LINE else (-0.5 if row or size >= 25 else -2.25)
    odds += 0.5 if text[-1] in ".!?…\"”:" else -0.5
    share = min(1.0, linked / size)
    odds -= 4.0 * share if share > 0.3 else 0.0
    odds += 0.5 if tag in ("p", "h1", "h2", "h3", "blockquote", "pre") or row and odds > -3 else 0.0
    return odds * min(1.0, size / LINE)


def cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of a minimum cut: node i pays max(0, score) if off the source side, max(0, -score) if on it,
    and every edge whose ends differ pays its weight.

    A node whose terminal outweighs its open edges has its score's label in some minimum cut; such nodes
    are settled first, their edges becoming their neighbours' terminal capacity. Maximum flow labels
    the rest.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    score, label = list(scores), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(score[i]) >= sum(near[i].values()):
            label[i] = score[i] > 0
            for j, w in near[i].items():
                score[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
        for i in rest:
            a, b = (source, i) if score[i] > 0 else (i, sink)
            room[a][b] = abs(score[i])
            room[b][a] = 0.0
        side = _max_flow(room, source, sink)
        for i in rest:
            label[i] = i in side
    return label


def _max_flow(room: dict[int, dict[int, float]], source: int, sink: int) -> set[int]:
    """Saturates the network by shortest augmenting paths; the nodes that the source still reaches."""
    while True:
        came, todo = {source: source}, deque([source])
        while todo and sink not in came:
            i = todo.popleft()
            for j, r in room[i].items():
                if r > 1e-9 and j not in came:
                    came[j] = i
                    todo.append(j)
        if sink not in came:
            return set(came)
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= flow
            room[j][i] = room[j].get(i, 0.0) + flow


def page_edges(found: list[tuple[str, float, tuple[int, int, int]]]) -> dict[tuple[int, int], float]:
    """Smoothness edges between each block and the one before, the last one of its element, and the last one of the element
    around that; an edge that leaves or enters a telling element has APART of its weight."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[str, int], int] = {}
    for i, (_, _, (own, above, told)) in enumerate(found):
        links = [(i - 1, NEXT_EDGE)] if i else []
        links += [(last[k], w) for k, w in ((("own", own), OWN_EDGE), (("above", above), ABOVE_EDGE)) if k in last]
        for j, w in links:
            edges[j, i] = edges.get((j, i), 0.0) + (w if found[j][2][2] == told else w * APART)
        last["own", own] = last["above", above] = i
    return edges


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    scores, edges = [s for _, s, _ in found], page_edges(found)
    keep = cut(scores, edges)
    if not any(keep):
        share = [min(1.0, len(text) / LINE) for text, _, _ in found]
        keep = cut([s + PRIOR * x if s > BOILERPLATE * x else s for s, x in zip(scores, share)], edges)
    return "\n".join(text for (text, _, _), yes in zip(found, keep) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. A null or empty page, and one without content, has an empty
    text. Repeated rows stay; a very long page comes in a batch of its own; a tie between labels goes to boilerplate unless a
    neighbour is content; no rows give none; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def op6_mincut_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page of `pages`."""
    return extract(table(spark, sf_dir, "pages"))

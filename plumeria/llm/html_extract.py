"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, the runs of text between block-level tags. A classifier's cost of calling a block
boilerplate becomes the capacity from the content terminal, its cost of calling it content the capacity to the
boilerplate terminal: the log-odds of what the block looks like (length, links, marks, kind of tag), by a logistic
regression fitted to a sample of pages, and of where it stands (the tags and names of its ancestors). Blocks that follow
one another, and blocks that are close in the tree, are tied by smoothness edges, whose capacity is the cost of
labelling them differently and of the same size as the classifier's. The maximum flow then separates content from
boilerplate at the least total cost. All capacities are hundredths of a natural logarithm of odds.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.words import slices

#: Tags that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame h1 h2 h3 h4 h5 h6 header hr html iframe input legend li main menu nav "
    "noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul "
    "video audio object svg".split()
)
#: Tags without content, and tags whose content isn't markup.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp noframes".split())
#: Tags whose content is never text of the page.
DROPPED_TAGS = frozenset(
    "head script style title template noframes textarea iframe object svg canvas audio video select datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Evidence of a tag for content.
TAG_EVIDENCE = (
    dict.fromkeys("nav aside footer menu dialog".split(), -400)
    | dict.fromkeys("form button noscript fieldset".split(), -250)
    | dict.fromkeys("article main".split(), 200)
)
#: Words in class, id or role, their evidence as a whole name, and as a part of one ("cookie-bar").
HINTS = {
    "comment": (-600, -500, "comment comments commentlist respond reply replies disqus"),
    "strong": (
        -320,
        -250,
        "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
        "menu menubar breadcrumb breadcrumbs sidebar footer masthead toolbar notice notices alert cookie cookies consent gdpr "
        "popup modal newsletter subscribe subscription signup login share sharing pagination pager copyright skip complementary "
        "contentinfo",
    ),
    "weak": (
        -200,
        -80,
        "side rail aside widget widgets topbar search social related recommended recommendations trending popular overlay "
        "legal disclaimer tags",
    ),
    "content": (150, 80, "article post entry story content main maincontent body text articlebody hentry"),
}
WORDS = {word: (whole, part) for whole, part, words in HINTS.values() for word in words.split()}
#: A name with one of these says what state the page is in ("comments-open") and nothing of the element.
STATES = frozenset("no has have with without is not open closed enabled disabled on off show hide".split())
#: Evidence from which an element stays boilerplate whatever is in it, and that of text outside of a page's article.
SETTLED, OUTSIDE, MOST, LEAST = -350, -220, 320, -900
#: Smoothness of blocks that follow one another (over 1 + their distance), of siblings, and of cousins.
NEXT, NEAR, COUSIN = 90, 60, 30
#: Ancestors within which two blocks count as close.
REACH = 8
#: Tags that end an open paragraph, and tags that end an open one of the same kind.
_ENDS_P = BLOCK_TAGS - {"br", "button", "input", "select", "option", "optgroup", "textarea", "title", "iframe", "noscript", "canvas", "object", "svg", "video", "audio"}
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"ul", "ol", "dl", "table", "menu", "select", "body", "article", "div", "section"}

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?]|/)")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)))?)""")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKS = re.compile(r"[.!?;:,\u2026\u3001\u3002]")
_ENDINGS = tuple(".!?\u2026\u3002\"\u201d\u00bb")


@dataclass(slots=True)
class Node:
    """An open element: its tag, its evidence for content with that of its ancestors, its parent.

    ``block`` is the nearest block-level element or the root, none where the element is one itself.
    """

    tag: str
    parent: Node | None
    depth: int
    evidence: int = 0
    dropped: bool = False
    link: bool = False
    heading: bool = False
    block: Node | None = None


@dataclass(slots=True)
class Block:
    text: str
    parent: Node
    linked: int
    heading: bool


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from behind its name, and the place behind its end; a tag that doesn't end has the rest."""
    found: dict[str, str] = {}
    while (match := _ATTRIBUTE.match(page, at)) is not None:
        at = match.end()
        if match[1]:
            return found, at
        value = next((x for x in match.group(3, 4, 5) if x is not None), "")
        found.setdefault(match[2].lower(), html.unescape(value) if "&" in value else value)
    return found, len(page)


def _named(name: str) -> int:
    """The evidence of one name in class, id or role."""
    words = _WORD.findall(_CAMEL.sub(" ", name).lower())
    if STATES.intersection(words):
        return 0
    found = [WORDS[x][len(words) > 1] for x in words if x in WORDS]
    return min(found) if found and min(found) < 0 else max(found, default=0)


def _evidence(tag: str, given: dict[str, str], parent: Node) -> int:
    """What an element and its ancestors say of its text: more than 0 for content, less for boilerplate."""
    above = parent.evidence
    if tag in ("body", "html"):
        return above
    own = TAG_EVIDENCE.get(tag, -300 if tag == "header" and above < 100 else 0)
    names = [x for k in ("class", "id", "role") if k in given for x in given[k].split()]
    hints = [_named(x) for x in names]
    own += min(0, *hints) + max(0, *hints) if len(hints) > 1 else sum(hints)
    if own < 0:
        return max(LEAST, min(above, 0) + own)
    if own > 0 and above > SETTLED:
        return min(MOST, max(above, 0) + own)
    return above


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order: text with references decoded and white space made single."""
    root = Node("", None, 0)
    node, found, parts = root, [], []
    open_: Counter[str] = Counter()
    linked, heading, at, end = 0, False, 0, len(page)

    def close() -> None:
        nonlocal linked, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, owner, min(linked, len(text)), heading))
            parts.clear()
        linked, heading = 0, False

    def leave(top: Node) -> None:
        """Close all elements below and with ``top``."""
        nonlocal node
        while node is not top:
            open_[node.tag] -= 1
            node = node.parent
        open_[top.tag] -= 1
        node = top.parent

    owner, begin = root, 0
    while begin < end:
        match = _TAG.search(page, at)
        if match is None:
            stop = end
        else:
            stop = match.start()
        if stop > begin and not node.dropped:
            text = page[begin:stop]
            if "&" in text:
                text = html.unescape(text)
            if not parts:
                owner = node.block or node
            parts.append(text)
            if node.link:
                linked += len(text.strip())
            heading = heading or node.heading
        if match is None:
            break
        if match[2] is None:  # comments, declarations, and end tags without a name
            at = match.end()
            if match[0] == "<!--":
                if page.startswith((">", "->"), at):
                    at = page.index(">", at) + 1
                else:
                    closing = _COMMENT_END.search(page, at)
                    at = closing.end() if closing else end
            else:
                closed = page.find(">", at)
                at = closed + 1 if closed >= 0 else end
            begin = at
            continue
        given, at = attributes(page, match.end())
        begin = at
        tag = match[2].lower()
        if tag in BLOCK_TAGS:
            close()
        if match[1]:
            if open_[tag]:
                top = node
                while top.tag != tag:
                    if tag == "p" and top.tag in _SCOPES:
                        break
                    top = top.parent
                if top.tag == tag:
                    leave(top)
            continue
        if tag in VOID_TAGS:
            continue
        ends = (("p",) if tag in _ENDS_P else ()) + _ENDS_SAME.get(tag, ())
        if any(open_[x] for x in ends):
            top, last = node, None
            while top.parent is not None and top.tag not in _SCOPES:
                if top.tag in ends:
                    last = top
                top = top.parent
            if last is not None:
                leave(last)
        if tag == "body" and node.dropped:  # a head that wasn't closed
            while node.parent is not None and node.dropped:
                leave(node)
        if tag in RAW_TAGS:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = begin = closing.end() if closing else end
            continue
        if tag in ("svg", "path", "circle") and page[at - 2 : at] == "/>":
            continue
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(given.get("style", "")))
        child = Node(tag, node, node.depth + 1, _evidence(tag, given, node))
        child.dropped = node.dropped or tag in DROPPED_TAGS or hidden
        child.link = node.link or tag == "a"
        child.heading = node.heading or tag in HEADINGS
        child.block = None if tag in BLOCK_TAGS else node.block or node
        node = child
        open_[tag] += 1
    close()
    return found


#: What a block looks like: the constant and these features, and the weights that a fit begins from and is drawn to.
LOOKS = ("constant", "length", "links", "marks", "ended", "heading", "paragraph", "item", "digits")
PRIOR = np.array([-1.6, 0.45, -3.5, 0.6, 0.8, 1.0, 0.4, -0.4, -1.0])
#: Bounds of the log-odds of looks; links lower the least one by so much.
LEAST_LOOKS, MOST_LOOKS, LINKED_LOOKS = -1.8, 2.4, 0.6


def looks(block: Block) -> list[float]:
    text, tag = block.text, block.parent.tag
    size = len(text)
    return [
        1.0, math.log1p(size), block.linked / size, min(1.0, 20 * len(_MARKS.findall(text)) / size), float(text.endswith(_ENDINGS)),
        float(block.heading), float(tag in ("p", "blockquote", "pre")), float(tag in ("li", "td", "th", "dd", "dt")),
        sum(map(str.isdigit, text[:1000])) / min(size, 1000),
    ]


def capacities(found: list[Block], weights: np.ndarray = PRIOR) -> list[tuple[int, int]]:
    """For each block (cost of calling it boilerplate, cost of calling it content).

    Text outside of what a page marks as its article, where it marks any, speaks for itself less.
    """
    if not found:
        return []
    features = np.array([looks(x) for x in found])
    seen = np.clip(features @ weights, LEAST_LOOKS - LINKED_LOOKS * features[:, 2], MOST_LOOKS)
    articles = any(x.parent.evidence > 0 for x in found)
    out = []
    for block, odds in zip(found, np.rint(seen * 100).astype(int).tolist(), strict=True):
        odds += block.parent.evidence or OUTSIDE * articles
        out.append((max(0, odds), max(0, -odds)))
    return out


def _distance(a: Node, b: Node) -> int:
    """The steps between two elements through their common ancestor, or 2 * REACH where there are more."""
    for steps in range(2 * REACH):
        if a is b:
            return steps
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return 2 * REACH


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity): blocks that follow one another, and the next block of the same parent or grandparent."""
    edges, last = [], {}
    for j, block in enumerate(found):
        if j:
            edges.append((j - 1, j, NEXT // (1 + _distance(found[j - 1].parent, block.parent))))
        i = last.get(id(block.parent))
        if i is not None and block.parent.parent is not None:
            edges.append((i, j, NEAR))
        last[id(block.parent)] = j
        above = block.parent.parent
        if above is not None:
            i = last.get(-id(above))
            if i is not None and i != j:
                edges.append((i, j, COUSIN))
            last[-id(above)] = j
    return [x for x in edges if x[2]]


def minimum_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it stays with the source in the minimum cut with the fewest nodes there.

    ``terminals`` has the capacities from the source and to the sink; what a node can pass straight on is taken off
    first. The rest is pushed along shortest paths, all of one length at a time, until none is left.
    """
    n = len(terminals)
    surplus = [a - b for a, b in terminals]
    left: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        left[i][j] = left[i].get(j, 0) + c
        left[j][i] = left[j].get(i, 0) + c
    near = [list(x) for x in left]
    while True:
        level = [0 if x > 0 else -1 for x in surplus]
        queue = deque(i for i in range(n) if surplus[i] > 0)
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or surplus[i] < 0
            for j, c in left[i].items():
                if c > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for start in [i for i in range(n) if surplus[i] > 0]:
            while surplus[start] > 0:
                path = [start]
                while path and surplus[path[-1]] >= 0:
                    i = path[-1]
                    if place[i] == len(near[i]):
                        path.pop()
                        if path:
                            place[path[-1]] += 1
                        continue
                    j = near[i][place[i]]
                    if left[i][j] > 0 and level[j] == level[i] + 1:
                        path.append(j)
                    else:
                        place[i] += 1
                if not path:
                    break
                steps = list(zip(path[:-1], path[1:], strict=True))
                flow = min(surplus[start], -surplus[path[-1]], *(left[i][j] for i, j in steps))
                surplus[start] -= flow
                surplus[path[-1]] += flow
                for i, j in steps:
                    left[i][j] -= flow
                    left[j][i] += flow


def main_text(page: str, weights: np.ndarray = PRIOR) -> tuple[str, int, int, int]:
    """(main text, blocks kept, blocks found, blocks that the edges set against their own costs) of a page."""
    found = blocks(page)
    costs = capacities(found, weights)
    kept = minimum_cut(costs, smoothness(found))
    content = [x.text for x, keep in zip(found, kept, strict=True) if keep]
    moved = sum((a > b) != keep for (a, b), keep in zip(costs, kept, strict=True) if a != b)
    return " ".join(content), len(content), len(found), moved


#: Pages that a fit samples, blocks of a page that it takes at most, and its hold on the prior weights.
SAMPLE, PAGE_BLOCKS, HOLD = 1000, 64, 0.02
#: Evidence from which a block's place is its label in a fit.
SURE = 200


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        rows = []
        for page in batch.column(0).to_pylist():
            sure = [x for x in blocks(page or "") if abs(x.parent.evidence) >= SURE]
            step = len(sure) // PAGE_BLOCKS + 1
            rows += [(int(x.parent.evidence > 0), looks(x)) for x in sure[::step]]
        columns = [pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "looks"])


def fit(pages: DataFrame, page: str = "html", page_id: str = "page_id", sample: int = SAMPLE) -> np.ndarray:
    """The weights of what content looks like, learned from the blocks whose place in the page labels them.

    A logistic regression over at most ``sample`` pages, those of the least hashes of id, and ``PAGE_BLOCKS`` blocks of
    each, drawn to ``PRIOR`` by a squared penalty; without sure blocks of both kinds it is ``PRIOR``. The driver gets
    the features of at most ``sample * PAGE_BLOCKS`` blocks.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(page).cast("string").alias("html")).where("_id IS NOT NULL")
    chosen = rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(sample).distinct()
    taken = rows.join(F.broadcast(chosen), "_id").select("html")
    found = taken.mapInArrow(_labelled, "label int, looks array<double>").limit(sample * PAGE_BLOCKS).collect()
    found = sorted((x["label"], tuple(x["looks"])) for x in found)
    y = np.array([x for x, _ in found], float)
    if not 0 < y.sum() < len(y):
        return PRIOR
    x = np.array([x for _, x in found])
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both kinds weigh the same
    w = PRIOR.copy()
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + HOLD * (w - PRIOR)
        bend = (x * (each * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def extract(pages: DataFrame, weights: np.ndarray | None = None, page: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars, kept_blocks, blocks, moved_blocks) of every row of ``pages``.

    The text joins the blocks that the minimum cut calls content, in page order, by one space; it is empty for a null
    or empty page and for one without content, and nothing of it is capped. ``weights`` are those of ``fit``, or the
    prior ones. Null and repeated ids are kept, an empty table gives an empty result, and other columns are ignored,
    whatever their names.
    """
    weights = PRIOR if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = [main_text(x, weights) if x else ("", 0, 0, 0) for x in batch.column(2).to_pylist()]
            text, *counts = zip(*rows, strict=True)
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string())]
            columns += [pa.array([len(x) for x in text], pa.int64()), *(pa.array(x, pa.int32()) for x in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "kept_blocks", "blocks", "moved_blocks"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    schema = "page_id long, url string, text string, n_chars long, kept_blocks int, blocks int, moved_blocks int"
    return rows.mapInArrow(run, schema)

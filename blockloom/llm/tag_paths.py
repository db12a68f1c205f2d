"""Main text of web pages by tag-path ratios.

Every text block of a page hangs on a path of tags (with their classes) from the root. For each path of a
page the length of its text, its punctuation and its link text are added up over all its blocks;
their ratios per block, smoothed over the paths in page order and fused by a geometric mean, score
the path. From the root the search goes down as long as one child holds half of the score below a node,
which leaves out menus, notices and footers beside the article; below the node that it ends at, paths above a
threshold that is relative to the best one are content. Element names and words of classes, ids
and roles weigh the scores and decide nothing by themselves. Parsing follows HTML's rules for void
elements, implied end tags, raw text elements and comments, in one pass over the page; elements
deeper than DEPTH stay in the last one above, as in browsers, so that time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import unused
from blockloom.llm.words import slices

THRESHOLD = 0.12  # of the best path's score
SHARE = 0.5  # of the score below a node, for the search to go down to a child
DEPTH = 512
STRONG, WEAK, LIKELY = 0.05, 0.3, 2.0  # weights of a path with such an element on it
# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option legend".split())
NEVER = frozenset("head nav footer aside form button select option fieldset svg math canvas audio video object menu dialog".split())
HOLDS = frozenset("body article main section div td center table tbody tr".split())  # blocks that an article may fill by itself
IMPLIED = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
SURE_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login"
    r"|share|sharing|comments?|comment-?list|disqus|replies|widget|pagination|pager|toolbar|copyright)(?=$|[\s_-])",
    re.I,
)
MAY_BE_NOISE = re.compile(r"(?:^|[\s_-])(?:promo\w*|side|header|notice|alert|social|related|recommend\w*|reply|legal|disclaimer|teasers?)(?=$|[\s_-])", re.I)
MAY_BE_TEXT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|text|body|main)(?=$|[\s_-])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|(?=[\s/]|\Z))", re.I)
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…、。，！？؟।]")
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu".split())


def _described(name: str, attributes: str, inside: bool) -> tuple[str, float]:
    """Label of an element on a path, and its weight; a hidden one weighs nothing."""
    if name in NEVER or name == "header" and not inside:
        weight = STRONG
    elif name in ("article", "main"):
        weight = LIKELY
    else:
        weight = 1.0
    if not attributes:
        return name, weight
    label = name
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return name, 0.0
        if key == "class":
            label = f"{name}.{value}"
        if key == "role" and value.lower() in ROLES:
            weight = STRONG
        if key in ("class", "id") and weight == 1.0 and name not in ("html", "body"):
            if SURE_NOISE.search(value):
                weight = STRONG
            elif MAY_BE_TEXT.search(value):
                weight = LIKELY if name in HOLDS else 1.0
            elif MAY_BE_NOISE.search(value) and name != "header":
                weight = WEAK
    return label, weight


class Page:
    """Paths of a page, each with its parent and weight, and its text blocks in order."""

    def __init__(self, page: str) -> None:
        self.parent, self.name, self.weight = [0], [""], [1.0]  # by path; 0 is the root
        self.known: dict[tuple[int, str, float], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # path, text, characters in links
        self.stack: list[tuple[str, int]] = [("", 0)]  # name, path
        self.open: Counter[str] = Counter()
        self.held: list[str] = []
        self.linked = self.where = 0
        self._read(page)

    def _flush(self) -> None:
        if self.held:
            text = _SPACE.sub(" ", html.unescape("".join(self.held))).strip()
            self.held.clear()
            if text:
                self.blocks.append((self.where, text, self.linked))
        self.linked = 0

    def _close(self, k: int) -> None:
        if any(name in BLOCK for name, _ in self.stack[k:]):
            self._flush()
        for name, _ in self.stack[k:]:
            self.open[name] -= 1
        del self.stack[k:]

    def _say(self, text: str) -> None:
        if not text:
            return
        path = self.stack[-1][1]
        if not self.weight[path]:
            return
        if not self.held:
            if text.isspace():
                return
            self.where = path
        self.held.append(text)
        if self.open["a"]:
            self.linked += len(text.strip())

    def _above(self, names: tuple[str, ...] | frozenset[str], stop: tuple[str, ...] | frozenset[str]) -> int:
        """The nearest open element of these names, 0 if there is none before one of `stop`."""
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name in names:
                return i
            if name in stop:
                return 0
        return 0

    def _end(self, name: str) -> None:
        if not self.open[name]:
            if name == "br":
                self._flush()
            return
        k = self._above((name,), () if name in BLOCK else BLOCK)  # a block is not closed by an inline end tag
        if k:
            self._close(k)

    def _begin(self, name: str, attributes: str) -> None:
        if name in CLOSES_P and self.open["p"] and (k := self._above(("p",), ("td", "div", "article", "section", "li", "blockquote"))):
            self._close(k)
        if name in IMPLIED:
            ends, scope = IMPLIED[name]
            if any(self.open[x] for x in ends.split()) and (k := self._above(tuple(ends.split()), scope)):
                self._close(k)
        if name in BLOCK:
            self._flush()
        if len(self.stack) > DEPTH or attributes.rstrip().endswith("/") and name not in BLOCK:
            return
        at = self.stack[-1][1]
        label, weight = _described(name, attributes, bool(self.open["article"] or self.open["main"]))
        if name in BLOCK or weight != 1.0:
            key = (at, label, weight)
            if key not in self.known:
                self.known[key] = len(self.parent)
                self.parent.append(at)
                self.name.append(name)
                # an element that is likely text counts once, and doesn't make up for noise around it
                above = self.weight[at]
                self.weight.append(above * weight if weight < 1 or above == 1 else above)
            at = self.known[key]
        self.stack.append((name, at))
        self.open[name] += 1

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                self._say(page[at:])
                break
            self._say(page[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._end(name)
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            elif name in VOID:
                if name in ("hr", "br"):
                    self._flush()
            else:
                self._begin(name, m[3])
        self._flush()


def content(page: str, threshold: float = THRESHOLD, weigh: bool = True) -> list[str]:
    """Texts of the content blocks, in page order. Without `weigh` names and classes of elements have no say."""
    p = Page(page)
    if not p.blocks:
        return []
    own = list(dict.fromkeys(b[0] for b in p.blocks))  # paths with text, in page order
    row = {path: i for i, path in enumerate(own)}
    at = np.array([row[b[0]] for b in p.blocks])
    count = np.bincount(at)
    total = np.bincount(at, [len(b[1]) for b in p.blocks])
    plain = np.maximum(total - np.bincount(at, [b[2] for b in p.blocks]), 0)
    marks = np.bincount(at, [len(_MARKS.findall(b[1])) for b in p.blocks])
    kernel = np.array([0.1, 1.0, 0.1])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid") / kernel.sum()
    weight = np.array([p.weight[path] for path in own]) if weigh else np.ones(len(own))
    fused = np.sqrt(smooth(plain / count) * smooth((marks + 0.5) / count)) * (plain / np.maximum(total, 1)) * weight
    # the score below each node, and down from the root to where it is
    below = np.zeros(len(p.parent))
    np.add.at(below, own, fused**2 * count)
    for path in range(len(p.parent) - 1, 0, -1):  # children come after their parents
        below[p.parent[path]] += below[path]
    children: dict[int, list[int]] = {}
    for path in range(1, len(p.parent)):
        children.setdefault(p.parent[path], []).append(path)
    node = 0
    while True:
        down = [c for c in children.get(node, ()) if below[c] >= SHARE * below[node] and (c in children or p.name[c] in HOLDS)]
        if not down or not below[node]:
            break
        node = max(down, key=lambda c: below[c])
    inside = np.zeros(len(p.parent), bool)
    inside[node] = True
    for path in range(node + 1, len(p.parent)):
        inside[path] = inside[p.parent[path]]
    inside = inside[own]
    good = inside & (fused > 0) & (fused >= threshold * fused[inside].max(initial=0))
    # a heading or a short paragraph belongs to the content when a sibling path is content
    homes = {p.parent[own[i]] for i in np.flatnonzero(good)} | {own[i] for i in np.flatnonzero(good)}
    best = weight[good].max(initial=0)
    good |= inside & (plain > 0.5 * total) & (weight >= 0.25 * best) & np.array([p.parent[path] in homes for path in own])
    return [b[1] for b, i in zip(p.blocks, at, strict=True) if good[i]]


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`pages` without the HTML and with the main text: content blocks joined by one newline, white
    space inside a block reduced to one space, empty if there is none. A null page is empty. Rows
    may repeat, other columns may be null and are carried along; one that is named like the
    text column is replaced. An empty table gives an empty result.
    """
    names = [c for c in pages.columns if c not in (html_col, text_col)]
    source = pages.select(*names, F.col(html_col).cast("string").alias(spare := unused(pages, "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, spare):
                texts = ["\n".join(content(page, threshold)) if page else "" for page in part.column(spare).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], [*names, text_col])

    return source.mapInArrow(run, source.drop(spare).schema.add(text_col, "string"))


def op4_tag_paths(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))

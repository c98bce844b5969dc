"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its path of open tags. Per path, text length and punctuation are added up and
divided by the number of nodes; the ratios are smoothed along the page, fused by multiplication, and paths above a threshold
are content. The article or main element, elsewhere the lowest common ancestor of all content, is the container; its blocks that
are not set apart as something else are the text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"(?P<name>[^\s\"'<>/=]+)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？…]")

_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_FENCE = set("ul ol dl table article section div main body".split())
#: Tags, and whole words of class, id or role, that set a part of a page apart from its article.
APART_TAGS = set("nav aside footer button dialog menu label input option audio video canvas noscript template svg object select annotation annotation-xml".split())
APART_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promotion reaction reactions related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget contentinfo complementary alert".split()
)
#: Words for parts that can be longer than the article itself.
LONG_WORDS = set("comment comments disqus outbrain reaction reactions related reply replies taboola".split())
_PLACES = "site page main top bottom left right primary secondary global mobile".split()
_THINGS = "banner footer menu nav navbar navigation sidebar".split()
_TOPICS = "ad ads comment comments cookie newsletter related share sharing social sponsored".split()
_SHAPES = "area banner bar box buttons form links list notice popup posts section signup stories widget wrapper".split()
_COMPOUND = {f"{a}-{b}" for x, y in ((_PLACES, _THINGS), (_TOPICS, _SHAPES)) for a in x for b in y}
#: Parts that are never a container, and blocks that belong to it from above.
_PARTS = set("ul ol dl table".split())
#: Elements that mark a box of the article as a part of it without punctuation.
_KEEPS = set("header hgroup h1 h2 h3 h4 h5 h6 pre blockquote table figure dl math code".split())
_LEADS = set("p h1 h2 h3 h4 h5 h6 blockquote".split())
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())


class _Node:
    __slots__ = ("path", "text", "block", "marks")

    def __init__(self, path: tuple[str, ...], text: str, block: int, marks: tuple[int, ...]):
        self.path, self.text, self.block, self.marks = path, text, block, marks


def _apart(tag: str, rest: str, inside: tuple[str, ...]) -> tuple[bool, float, str]:
    """Whether a tag opens a part of its own, the share of the content from which its marks do not count (0: no mark), and its name in the path."""
    name, apart = tag, tag in APART_TAGS or (tag == "header" and "article" not in inside and "main" not in inside)
    limit = 0.5 if tag == "form" else 0.0
    for m in _ATTRIBUTE.finditer(rest):
        value = (m["a"] or m["b"] or m["c"] or "").lower()
        kind = m["name"].lower()
        if kind in ("hidden", "aria-hidden"):
            apart |= kind == "hidden" or value == "true"
        elif kind == "style":
            apart |= "display:none" in value.replace(" ", "")
        elif kind in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
            words = {w.replace("_", "-") for w in value.split()}
            if words & APART_WORDS or words & _COMPOUND:
                limit = max(limit, 0.9 if any(w.split("-")[0] in LONG_WORDS for w in words) else 0.5)
            name = f"{tag}.{value}"
    return apart, limit, name


def text_nodes(page: str) -> list[_Node]:
    """Text outside parts set apart, with path and block number, in page order.

    Tags set a part apart whatever it holds; a word of class, id or role, and a form, only if it does not hold most of the content.
    """
    stack: list[tuple[str, str, bool, int]] = []  # tag, name in the path, set apart, number of the mark or -1
    nodes, block, at = [], 0, 0
    limits: list[float] = []

    def leave(k: int) -> None:
        del stack[k:]

    def add(text: str) -> None:
        if text and not (stack and any(s[2] for s in stack)):
            text = html.unescape(text)
            if text.strip() or (nodes and nodes[-1].block == block):
                nodes.append(_Node(tuple(s[1] for s in stack), text, block, tuple(s[3] for s in stack if s[3] >= 0)))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in _BLOCK:
            block += 1
        if m["end"]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                leave(k)
            continue
        if tag == "br":
            add(" ")
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in _CLOSES.get(tag, ()):
                    leave(i)
                    break
                if stack[i][0] in _FENCE:
                    break
        apart, limit, name = _apart(tag, m["rest"], tuple(s[0] for s in stack))
        if not m["rest"].endswith("/"):
            stack.append((tag, name, apart, len(limits) if limit else -1))
            if limit:
                limits.append(limit)
    if at < len(page):
        add(page[at:])
    return _unmarked(nodes, limits)


def _unmarked(nodes: list[_Node], limits: list[float]) -> list[_Node]:
    """The nodes whose marks all are overruled, that is, open elements with more than such a share of the text of content paths."""
    if not any(n.marks for n in nodes):
        return nodes
    chosen, held, total = content_paths(nodes), [0] * len(limits), 0
    for n in nodes:
        if n.path in chosen:
            size = len(n.text.strip())
            total += size
            for k in n.marks:
                held[k] += size
    return [n for n in nodes if all(held[k] > limits[k] * total for k in n.marks)]


def _smooth(x: np.ndarray, radius: int = 2) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(1, radius / 2)) ** 2)
    return np.convolve(np.pad(x, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_paths(nodes: list[_Node], factor: float = 0.5) -> set[tuple[str, ...]]:
    """Paths whose fused ratio of text and punctuation per node reaches `factor` times its mean, weighted by length."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        length[n.path] += len(n.text.strip())
        marks[n.path] += len(_PUNCTUATION.findall(n.text))
        count[n.path] += 1
    text = _smooth(np.array([length[n.path] / count[n.path] for n in nodes]))
    mark = _smooth(np.array([marks[n.path] / count[n.path] for n in nodes]))
    fused = text * (1 + mark)
    weight = np.array([len(n.text.strip()) for n in nodes], float)
    limit = factor * float((fused * weight).sum() / max(1.0, weight.sum()))
    score: dict[tuple[str, ...], float] = {}
    for n, f in zip(nodes, fused.tolist(), strict=True):
        score[n.path] = max(score.get(n.path, 0.0), f)
    return {p for p, s in score.items() if s >= limit}


def _tag(name: str) -> str:
    return name.split(".")[0]


def _container(paths: set[tuple[str, ...]]) -> tuple[str, ...]:
    """The lowest common ancestor of the paths that is neither in a list or table nor a paragraph or an inline element."""
    lo, hi = min(paths), max(paths)
    common = lo[: next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))]
    common = common[: next((i for i, name in enumerate(common) if _tag(name) in _PARTS), len(common))]
    while common and _tag(common[-1]) not in _FENCE | {"html"}:
        common = common[:-1]
    return common


def _kept(nodes: list[_Node], chosen: set[tuple[str, ...]]) -> list[bool]:
    """For pages without article and main: blocks of the container, and titles and paragraphs that lead to it from above."""
    container = _container(chosen)
    depth = len(container)
    above = {p[:k] for p in chosen for k in range(len(p) + 1)}
    first = next(i for i, n in enumerate(nodes) if n.path[:depth] == container and n.text.strip())
    keep = []
    for i, n in enumerate(nodes):
        if n.path[:depth] == container:
            below = _tag(n.path[depth]) if len(n.path) > depth else None
            keep.append(below is None or below in _TEXT_TAGS or below not in _BLOCK or n.path[: depth + 1] in above)
            continue
        tags = [_tag(name) for name in n.path]
        at = next((k for k, tag in enumerate(tags) if tag in _LEADS), None)
        keep.append(i < first and at is not None and "a" not in tags and (tags[at] == "h1" or n.path[:at] == container[:at]))
    return keep


def _inside(nodes: list[_Node], chosen: set[tuple[str, ...]]) -> list[bool]:
    """For article and main: chosen paths, their neighbours, and further boxes that read like text.

    The home of a path is all before its first text element. Paths at home where a chosen path is, or on the way to it, are its
    neighbours. What is left are boxes without any chosen path; one is dropped if half of its text is links, or if it has no
    punctuation and nothing but bare text.
    """
    homes: dict[tuple[str, ...], tuple[str, ...]] = {}
    for n in nodes:
        if n.path not in homes:
            tags = [_tag(name) for name in n.path]
            start = next(i for i, tag in enumerate(tags) if tag in ("article", "main")) + 1
            end = next((i for i in range(start, len(tags)) if tags[i] in _TEXT_TAGS or tags[i] in _KEEPS), len(tags))
            while end > start and tags[end - 1] not in _BLOCK:
                end -= 1
            homes[n.path] = n.path[:end]
    near = {()}
    for home in {homes[p] for p in chosen}:
        near.update(home[:k] for k in range(1, len(home) + 1))
    boxes: dict[tuple[str, ...], list[int]] = {}
    of: dict[tuple[str, ...], tuple[str, ...] | None] = {}
    for p, home in homes.items():
        of[p] = None if p in chosen or home in near else home[: next(k for k in range(1, len(home) + 1) if home[:k] not in near)]
    for n in nodes:
        if (box := of[n.path]) is not None:
            tags = {_tag(name) for name in n.path[len(box) - 1 :]}
            size = len(n.text.strip())
            x = boxes.setdefault(box, [0, 0, 0])
            x[0] += size
            x[1] += size if "a" in tags else 0
            x[2] += len(_PUNCTUATION.findall(n.text)) + bool(tags & _KEEPS)
    return [(box := of[n.path]) is None or (2 * boxes[box][1] < boxes[box][0] and boxes[box][2] > 0) for n in nodes]


def main_text(page: str | None) -> str:
    """The article's blocks, white space folded, joined by an empty line; '' if there is none."""
    nodes = text_nodes(page or "")
    if not any(n.text.strip() for n in nodes):
        return ""
    named = [i for i, n in enumerate(nodes) if any(p.split(".")[0] in ("article", "main") for p in n.path)]
    if named:
        nodes = [nodes[i] for i in named]
    chosen = content_paths(nodes)
    keep = (_inside if named else _kept)(nodes, chosen)
    blocks: dict[int, list[str]] = {}
    for n, k in zip(nodes, keep, strict=True):
        if k:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in lines if x)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """`pages` without `page`, with `text`, for every row; null and empty pages give ''. A column `text` is replaced."""
    kept = [c for c in pages.columns if c not in (page, "text")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            texts = pa.array([main_text(p.as_py()) for p in rows.column(len(kept))], pa.string())
            yield pa.record_batch([*rows.columns[:-1], texts], names=[*kept, "text"])

    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(page).alias("__page"))
    schema = pages.select(*[F.col(f"`{c}`") for c in kept]).schema.add("text", "string")
    return rows.mapInArrow(run, schema)

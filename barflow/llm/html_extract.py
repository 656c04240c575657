"""Main text of web pages by minimum-cut labelling of their blocks.

Each block of text gets the cost of being called boilerplate or content as a terminal capacity; neighbours in the page and
in the same container are tied by smoothness edges. The minimum cut separates content from boilerplate. Pages are dealt by
Spark; one page's graph has a node per block.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.words import slices

# Element names of the HTML standard by role.
RAW = "script style textarea title".split()
#: Elements without text of the page. One that is not closed ends at the next block's tag.
HIDDEN = "noscript template svg iframe object select button".split()
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOISE = set("nav footer aside form header menu dialog head".split())
CONTENT = {"article", "main"}
#: What the opening of an element closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}

NOISE_NAMES = set(
    "ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead cookie cookies consent notice "
    "gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies pagination pager toolbar skip commentlist thread threads discussion respond complementary contentinfo search".split()
)
#: Words that stand beside a noise word in the name of a box of noise; in an article any other word gives the name a meaning of its own.
LAYOUT_NAMES = set(
    "area articles bar block body bottom box button buttons container content form header icons inner item items left link links list outer panel post posts right "
    "section slot title top unit wrap wrapper".split()
)
#: Whole names of page headers, where they stand outside the article.
HEADER_NAMES = set("header site-header page-header main-header global-header top-header".split())
CONTENT_NAMES = set("article post entry content story body main".split())

_ATTRS = r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+"
_SKIPPED = r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + rf")(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
_TOKEN = re.compile(
    _SKIPPED + rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})>|<[!?/][^>]*+>?|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_HIDDEN = re.compile(_SKIPPED + rf"|<(?P<end>/?)(?P<tag>{'|'.join(HIDDEN)})(?=[\s/>])(?P<attrs>{_ATTRS})>|<[a-zA-Z/]{_ATTRS}>", re.S | re.I)
_SOME_HIDDEN = re.compile(rf"<(?:{'|'.join(HIDDEN)})\b", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Block:
    text: str
    parent: int
    noise: float
    content: bool
    heading: bool
    linked: int
    #: Within an article or main element, with no noise between.
    inside: bool = False
    title: bool = False


@dataclass(frozen=True)
class Costs:
    """Weights of the block classifier (fixed, in log odds) and of the smoothness edges."""

    bias: float = -0.5
    inside: float = 3.0
    noise: float = -6.0
    words: float = 0.1
    most_words: int = 30
    marks: float = 0.5
    links: float = -4.0
    links_inside: float = -1.0
    heading: float = 1.0
    title: float = 1.5
    bare: float = 1.5
    next_same: float = 0.6
    next_other: float = 0.2
    same_parent: float = 0.4


@dataclass
class _Element:
    tag: str
    box: int
    noise: float = 0.0
    content: bool = False
    parts: list = field(default_factory=list)
    #: Noise by an element that is no main text whatever it holds, or by a name that is nothing but noise.
    firm: bool = False
    plain: bool = False
    #: 1 in an article, 2 in main.
    depth: int = 0


def _hidden(page: str) -> dict[int, int]:
    """Start of each hidden element that is closed: its end."""
    ends: dict[int, int] = {}
    if _SOME_HIDDEN.search(page):
        opened: dict[str, list[int]] = {tag: [] for tag in HIDDEN}
        for m in _HIDDEN.finditer(page):
            if m["tag"] is None:
                continue
            starts = opened[m["tag"].lower()]
            if m["attrs"].endswith("/") and not m["end"]:
                ends[m.start()] = m.end()
            elif not m["end"]:
                starts.append(m.start())
            elif starts:
                ends[starts.pop()] = m.end()
    return ends


def _is_noise(name: set[str]) -> bool:
    """Whether a name, cut into words, means nothing but noise: noise words, layout words, numbers and sizes."""
    return all(w in NOISE_NAMES or w in LAYOUT_NAMES or not w or w[0].isdigit() or len(w) == 1 for w in name)


def blocks(page: str, costs: Costs = Costs()) -> list[Block]:
    """Blocks of a page in order. Unclosed and stray tags are taken as browsers do in the plain cases."""
    out: list[Block] = []
    stack = [_Element("", 0)]
    held: list[str] = []
    state = {"linked": 0, "links": 0, "boxes": 1}

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            top = next(e for e in reversed(stack) if e.tag == "" or e.tag in BLOCK)
            box = next((e.box for e in reversed(stack) if e.tag not in ("p", "li", "b") and (e.tag == "" or e.tag in BLOCK)), 0)
            heading = len(top.tag) == 2 and top.tag[0] == "h" and top.tag[1].isdigit()
            inner = stack[-1]
            out.append(Block(text, box, inner.noise, inner.content, heading, state["linked"], inner.depth > 0 and not inner.noise, top.tag == "h1"))
        held.clear()
        state["linked"] = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            if stack[-1].tag == "a":
                state["links"] -= 1
            stack.pop()

    ends, shown, cut_off = _hidden(page), 0, False
    for m in _TOKEN.finditer(page):
        if m.start() < shown:
            continue
        text = m["text"]
        if text is not None:
            if cut_off:
                continue
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if state["links"]:
                state["linked"] += len(text.split())
            continue
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() in ("title", "textarea"):
                flush()
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            if tag == "iframe":
                flush()
            if not m["end"]:
                shown = ends.get(m.start(), 0)
                cut_off = cut_off or not shown
            continue
        if tag in BLOCK:
            cut_off = False
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if at:
                close(at)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            shut = CLOSES.get(tag, set()) | ({"p"} if tag not in ("body", "html") else set())
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in shut), 0)
            between = {e.tag for e in stack[at + 1 :]} & BLOCK if at else set()
            if at and not between - {"p"}:
                close(at)
        top = stack[-1]
        noise, content, firm, plain, depth = top.noise, top.content, top.firm, top.plain, top.depth
        if tag in CONTENT:
            content = True
            level = 1 + (tag == "main")
            # what wrappers are called says nothing of the main text; within main, a plain noise name still does
            if level > depth and (level == 2 or not firm) or level == 1 and not firm and not plain:
                noise, firm, plain = 0.0, False, False
            depth = max(depth, level)
        if tag in NOISE and not (tag == "header" and content):
            noise, firm = costs.noise, firm or tag != "form"
        if m["attrs"] and "=" in m["attrs"]:
            named = ["".join(g).lower() for g in _NAMED.findall(m["attrs"])]
            parts = [set(re.split(r"[^a-z0-9]+", x)) for x in " ".join(named).split()]
            names = set().union(*parts)
            if not content and tag in BLOCK and HEADER_NAMES & set(" ".join(named).split()):
                noise = costs.noise
            if names & NOISE_NAMES and tag not in ("body", "html", "main"):
                silent = [x for x in parts if x & NOISE_NAMES and (not depth or _is_noise(x))]
                if silent and not any(x & CONTENT_NAMES and not x & NOISE_NAMES for x in parts):
                    noise, plain = costs.noise, plain or any(x <= NOISE_NAMES for x in parts)
            elif names & CONTENT_NAMES and tag in BLOCK:
                content = True
        if tag == "a":
            state["links"] += 1
        state["boxes"] += 1
        stack.append(_Element(tag, state["boxes"], noise, content, firm=firm, plain=plain, depth=depth))
    flush()
    return out


def score(b: Block, costs: Costs) -> float:
    """Log odds that a block is content."""
    words = b.text.count(" ") + 1
    s = costs.bias + b.noise + costs.words * min(words, costs.most_words)
    s += (costs.links_inside if b.inside else costs.links) * min(1.0, b.linked / words)
    s += costs.inside * b.content + costs.heading * (b.heading and b.content)
    return s + costs.marks * (b.text[-1] in ".!?:;…\"'")


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: positive scores hang on the source, negative on the sink, edges carry flow both ways.

    Flow is sent along shortest paths to one node with an open deficit after the other. A node that no excess can reach
    any more never becomes reachable again, so it is looked at once.
    """
    left = list(scores)
    near: list[dict[int, float]] = [{} for _ in scores]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    dead = [False] * len(left)
    for sink, deficit in enumerate(scores):
        while deficit < 0 and left[sink] < -1e-12 and not dead[sink]:
            came, queue, found = {sink: sink}, deque([sink]), -1
            while queue and found < 0:
                v = queue.popleft()
                for u in near[v]:
                    if u not in came and not dead[u] and near[u][v] > 1e-12:
                        came[u] = v
                        if left[u] > 1e-12:
                            found = u
                            break
                        queue.append(u)
            if found < 0:
                for v in came:
                    dead[v] = True
                break
            flow, u = min(left[found], -left[sink]), found
            while u != sink:
                flow = min(flow, near[u][came[u]])
                u = came[u]
            left[found] -= flow
            left[sink] += flow
            u = found
            while u != sink:
                v = came[u]
                near[u][v] -= flow
                near[v][u] += flow
                u = v
    side = [x > 1e-12 for x in left]
    queue = deque(i for i, x in enumerate(side) if x)
    while queue:
        u = queue.popleft()
        for v, w in near[u].items():
            if w > 1e-12 and not side[v]:
                side[v] = True
                queue.append(v)
    return side


def scores(found: list[Block], costs: Costs) -> list[float]:
    """Log odds of a page's blocks. A page that marks no content takes every block for likelier content; a main heading
    outside the marked content counts as its title, unless there is one inside."""
    marked = any(b.content and not b.noise for b in found)
    titled = any(b.title and b.content and not b.noise for b in found)
    return [score(b, costs) + (0.0 if marked else costs.bare) + costs.title * (marked and not titled and b.title and not b.noise) for b in found]


def main_text(page: str, costs: Costs = Costs()) -> str:
    """Content blocks of a page, one per line."""
    found = blocks(page, costs)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, costs.next_same if found[i - 1].parent == b.parent else costs.next_other))
        if last.get(b.parent, i - 1) != i - 1:
            edges.append((last[b.parent], i, costs.same_parent))
        last[b.parent] = i
    side = cut(scores(found, costs), edges)
    return "\n".join(b.text for b, x in zip(found, side, strict=True) if x)


def extract(pages: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text.

    A null or empty html gives an empty text. Markup, comments, scripts and styles are no text; character references are
    decoded. A page that ends early is read as far as it goes. Lists of links and oddly named elements of an article are text; a
    page without article, main or named content is text where nothing marks noise. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(x) if x else "" for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")

"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks of text at block-level tags. A logistic regression gives each block its
log-odds of being content; the positive part is the capacity from the source, the negative part that
to the sink, bounded by CAPACITY. Edges between neighbours in the page and between blocks that are
close in the tree smooth the labels; the source side of the minimum cut is the content. Graphs are of
one page, so each page is a row of a map; nothing is shuffled.

The classifier is fitted on the given pages: at most `sample_pages` pages (of least hash of the id) with
at most PAGE_BLOCKS blocks each. Their labels are weak: a block votes by the landmarks around it
(tags, roles, whole words of class and id); blocks under boilerplate landmarks inside of content ones, or
under one kind only, are labelled, those under content landmarks inside of boilerplate ones are not.
Features are the tags and name words on a block's path (in three sampled pages or more, the VOCABULARY most frequent),
the kinds of landmark seen and last seen, length, links and punctuation. The ridge pulls weights to
PRIOR, not to zero, so that pages without labels are judged too. Names such as has-sidebar or
no-comments describe a layout and don't vote.

Defined cases: null, empty or tag-free html gives its text, if any, as one block; unclosed and
crossed tags follow the stack of open elements; hidden elements and blocks without text are dropped; very long
pages are taken whole, in time linear in their length but for the flow; equal scores keep nothing that
no edge pulls to the content; repeated rows are treated alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, PAGE_BLOCKS, VOCABULARY = 500, 200, 400
CAPACITY = 8.0
SLICE = 200
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style noscript template textarea title svg iframe object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img nobr mi mn mo mrow msup msub mfrac msqrt mtext semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Votes of the weak labels.
APART = frozenset("nav aside footer form menu dialog button fieldset".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup "
    "sidebar rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus respond reply replies related recommended recommendations share sharing social "
    "pagination pager paging skip login search tags".split()
)
ABOUT = frozenset("article content post entry story main body text".split())
#: First words of names that say what a layout has or lacks.
LAYOUT = frozenset("has no with without is hide show js".split())
#: Where weights are pulled to: what is known without any page.
PRIOR = {"bias": -1.5, "words": 0.8, "links": -5.0, "stops": 0.5, "last:away": -10.0, "seen:away": -1.0, "last:about": 4.0, "seen:about": 1.0, "t:p": 1.0, "t:blockquote": 1.0, "t:pre": 1.0, "t:li": -0.5, "notice": -2.0}


@dataclass
class Block:
    text: str
    features: tuple[str, ...]
    numbers: tuple[float, float, float]
    path: tuple[int, ...]
    label: int | None


@dataclass
class Open:
    """An open element: tag, features of the path to it, the last vote (-1, 1, 0: none), whether a content vote
    was seen before a boilerplate one, whether it is hidden, and its number."""

    tag: str
    path: frozenset[str] = frozenset()
    vote: int = 0
    mixed: bool = False
    hidden: bool = False
    number: int = 0


def attributes_of(source: str) -> dict[str, str]:
    """Names in lower case; of equal names the first one counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def name_words(names: str) -> set[str]:
    """Lower-case words of class and id names without those that describe a layout."""
    out: set[str] = set()
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x]
        if parts and parts[0] not in LAYOUT:
            out.update(parts)
    return out


def opened(parent: Open, tag: str, source: str, number: int) -> Open:
    held = attributes_of(source) if source.strip() else {}
    words, role = name_words(f"{held.get('class', '')} {held.get('id', '')}"), held.get("role", "").lower()
    whole = tag in ("html", "body")
    away = not whole and (tag in APART or role in APART_ROLES or bool(words & AWAY) or (tag == "header" and parent.vote <= 0))
    about = not whole and (tag in ("article", "main") or role in ("main", "article") or bool(words & ABOUT))
    if away and about and not (tag in APART or role in APART_ROLES):
        if tag in ("article", "main") or role in ("main", "article"):
            away = False
        else:  # such as post-comments, content-sidebar: the thing that it is comes last, and what it is of first
            about = False
    vote = -1 if away else 1 if about else parent.vote
    seen = {f"seen:{'away' if away else 'about'}"} if away or about else set()
    hidden = parent.hidden or "hidden" in held or held.get("aria-hidden", "").lower() == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
    path = parent.path | seen | {f"t:{tag}"} | {f"n:{w}" for w in words} if not whole else parent.path
    return Open(tag, path, vote, parent.mixed or (vote == 1 and parent.vote == -1), hidden, number)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order."""
    stack = [Open("")]
    out: list[Block] = []
    text: list[str] = []
    unclosed: set[str] = set()
    links = made = 0

    def flush() -> None:
        nonlocal links
        if text and not stack[-1].hidden:
            whole = " ".join(markup.unescape("".join(text)).split())
            if whole:
                at = stack[-1]
                words = whole.count(" ") + 1
                last = {-1: ("last:away",), 1: ("last:about",), 0: ()}[at.vote]
                notice = ("notice",) if words < 15 and ("©" in whole or "rights reserved" in whole.lower()) else ()
                label = None if at.vote == 0 or (at.vote == 1 and at.mixed) else int(at.vote == 1)
                numbers = (math.log1p(words), min(1.0, links / max(1, len(whole))), float(whole[-1] in ".!?…。！？:"))
                out.append(Block(whole, (*sorted(at.path), *last, *notice), numbers, tuple(e.number for e in stack), label))
        text.clear()
        links = 0

    at, n, last_end = 0, len(page), page.rfind(">")
    while at < n:
        m = TAG.search(page, at) if page.find("<", at) <= last_end or page.find("<!", at) >= 0 else None
        end = m.start() if m else n
        if end > at:
            text.append(page[at:end])
            if any(e.tag == "a" for e in stack[-4:]):
                links += end - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        source = m[3] or m[6] or ""
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if close is None:
                unclosed.add(tag)
            at = close.end() if close else (n if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag == "head":
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in VOID or source.endswith("/") and tag in INLINE:
            continue
        made += 1
        stack.append(opened(stack[-1], tag, source, made))
    flush()
    return out


@dataclass
class Costs:
    """Weights of the classifier; a feature without one counts nothing."""

    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))

    def score(self, block: Block) -> float:
        w = self.weights
        words, links, stops = block.numbers
        raw = w["bias"] + w["words"] * words + w["links"] * links + w["stops"] * stops + sum(w.get(f, 0.0) for f in block.features)
        return max(-CAPACITY, min(CAPACITY, raw))


def fit_costs(pages: list[list[Block]], *, ridge: float = 2.0) -> Costs:
    """Most probable weights for the labelled blocks of some pages, with a normal prior around PRIOR. Each block
    counts twice, with its landmarks and without, so that names and text are learned for pages that have none."""
    seen = Counter(f for page in pages for f in {f for block in page for f in block.features})
    names = sorted({f for f, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= 3} | set(PRIOR))
    at = {f: k for k, f in enumerate(names)}
    blocks = [block for page in pages for block in page if block.label is not None]
    x, y = np.zeros((len(blocks), len(names))), np.array([b.label for b in blocks], float)
    for k, block in enumerate(blocks):
        x[k, [at["bias"], at["words"], at["links"], at["stops"]]] = (1.0, *block.numbers)
        x[k, [at[f] for f in block.features if f in at]] = 1.0
    unseen = x.copy()
    unseen[:, [at[f] for f in names if f.startswith(("last:", "seen:"))]] = 0.0
    x, y = np.vstack([x, unseen]), np.r_[y, y]
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names)), x.T @ (y - p) - ridge * (w - prior))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Costs({f: float(v) for f, v in zip(names, w)})


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, and to the next block of the same parent."""
    edges, last = [], {}
    for k, block in enumerate(blocks):
        if k:
            a, b = blocks[k - 1].path, block.path
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            edges.append((k - 1, k, 0.4 + 1.2 / (1 + len(a) + len(b) - 2 * same)))
        parent = block.path[:-1]
        if parent in last and last[parent] < k - 1:
            edges.append((last[parent], k, 0.3))
        last[parent] = k
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut; augmenting paths by breadth-first search."""
    n = len(scores)
    source, sink = [max(0.0, s) for s in scores], [max(0.0, -s) for s in scores]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    while True:
        came = {k: -1 for k in range(n) if source[k] > 1e-12}
        queue, end = deque(came), None
        while queue:
            k = queue.popleft()
            if sink[k] > 1e-12:
                end = k
                break
            for x, c in room[k].items():
                if c > 1e-12 and x not in came:
                    came[x] = k
                    queue.append(x)
        if end is None:
            return [k in came for k in range(n)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(source[path[-1]], sink[end], *(room[b][a] for a, b in zip(path, path[1:])))
        source[path[-1]] -= flow
        sink[end] -= flow
        for a, b in zip(path, path[1:]):
            room[b][a] -= flow
            room[a][b] += flow


def main_text(page: str | None, costs: Costs | None = None) -> str:
    blocks, costs = blocks_of(page or ""), costs or Costs()
    if not blocks:
        return ""
    keep = min_cut([costs.score(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def learn_costs(pages: DataFrame, *, sample_pages: int = SAMPLE_PAGES) -> Costs:
    """The classifier for these pages, fitted on a bounded sample of them."""
    sample = pages.where("html is not null").select(F.xxhash64("page_id").alias("h"), "page_id", F.col("html").alias("html")).orderBy("h", "page_id", "html").limit(sample_pages)
    kind = "array<struct<features:array<string>,numbers:array<double>,label:int>>"

    def cut(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.struct([("features", pa.list_(pa.string())), ("numbers", pa.list_(pa.float64())), ("label", pa.int32())])
        for batch in texts:
            made = [[{"features": list(b.features), "numbers": list(b.numbers), "label": b.label} for b in blocks_of(h)[:PAGE_BLOCKS]] for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(listed))], ["blocks"])

    rows = sample.select("html").mapInArrow(cut, f"blocks {kind}").collect()  # at most sample_pages * PAGE_BLOCKS blocks
    return fit_costs([[Block("", tuple(b["features"]), tuple(b["numbers"]), (), b["label"]) for b in r["blocks"]] for r in rows])


def extract_main_text(pages: DataFrame, costs: Costs | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(costs or learn_costs(pages))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [main_text(h, held) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    parts = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    return parts.mapInArrow(extract, f"page_id {parts.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

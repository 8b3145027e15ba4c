"""Main text of web pages: a tree-structured graphical model over the DOM, by sum-product message passing.

Every node of a page's tree, block elements and runs of text, is content or not. A node's own potential is a
linear function of its tag, of what its names hint at, of its text's length, links and stops; an edge's potential
depends on both ends' states and the kind of child. Messages go from the leaves to the top, then down again, for all
pages of a slice level by level; the product at a node is its exact marginal. A run of text is kept where its marginal is at least one half.

The model is trained by maximum likelihood (the gradient is what the labels count less what the marginals expect) on
labelled pages: LAYOUTS pages that are put together from labelled parts, and at most SAMPLED pages of the table
itself, at most SAMPLE_BYTES long, those with the smallest hashes of page_id and url, whose own <article> or <main> labels them. Half of these have
their telling tags replaced by <div>, so that the model learns what else marks an article.

A null html counts as empty; a page without text has the text ''. White space, no-break spaces included, becomes one space within a block; <br> is
white space. Pages of any length are read whole. Rows are mapped one by one, so repeated rows and null ids change nothing. Other
columns aren't used. An empty table gives an empty table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import batches_of, rows_of
from corpuspack.llm.dom import GROUP_NAMES, HINT_NAMES, HINTS, Page

#: Labelled pages from parts, and bounds of the sample of pages that label themselves.
LAYOUTS, SAMPLED, SAMPLE_BYTES = 400, 300, 100_000
ROUNDS, RATE = 150, 0.2
#: Characters of pages that share message passing.
SLICE_CHARS = 1 << 20

N_GROUPS, N_HINTS = len(GROUP_NAMES), len(HINT_NAMES)
_AT = {name: k for k, name in enumerate(GROUP_NAMES)}
_TELLING = np.array([name in ("article", "main", "nav", "header", "footer", "aside", "form") for name in GROUP_NAMES])
_APART = np.array([name in ("nav", "footer", "aside", "form") for name in GROUP_NAMES])
_APART_HINTS = sum(1 << k for k, name in enumerate(HINT_NAMES) if name not in ("content", "share"))
#: Numbers that describe a node: length, links, stops, share of the page, words, ending; and the constant.
N_NUMBERS = 7
N_FEATURES = 2 * N_GROUPS + N_HINTS + 2 * N_NUMBERS
#: Kinds of edges, by the child: a run of text, an element, one that its tag or names set apart.
N_KINDS = 3


@dataclass
class Forest:
    """The trees of several pages as one, with a description of each node. ``start``: first node of each page, and the end."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    features: np.ndarray
    start: np.ndarray
    runs: np.ndarray
    group: np.ndarray
    hints: np.ndarray

    @classmethod
    def of(cls, pages: list[Page], plain: bool = False) -> Forest:
        """``plain``: with <div> in place of all telling tags."""
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        start = np.concatenate(([0], np.cumsum(sizes)))
        page = np.repeat(np.arange(len(pages)), sizes)
        join = lambda name: np.concatenate([np.frombuffer(getattr(p, name), np.int32) for p in pages]).astype(np.int64)
        parent, group, hints = join("parent"), join("group"), join("hints")
        parent = np.where(parent >= 0, parent + start[page], -1)
        levels = [np.flatnonzero(parent < 0)]
        depth = np.zeros(len(parent), np.int64)
        for k in _rising(parent):
            depth[k] = depth[parent[k]] + 1
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        runs = np.array([(r[0] + s, *r[1:]) for p, s in zip(pages, start) for r in p.runs], np.int64).reshape(-1, 7)
        is_run = np.zeros(len(parent), bool)
        is_run[runs[:, 0]] = True
        shown = np.where(plain & _TELLING[group], _AT["div"], group)
        # sums of characters, links, words, stops and endings over each node's subtree
        sums = np.zeros((len(parent), 5))
        sums[runs[:, 0]] = runs[:, 1:6]
        for level in reversed(levels[1:]):
            np.add.at(sums, parent[level], sums[level])
        chars, links, words, stops, endings = sums.T
        whole = np.maximum(chars[start[:-1]][page], 1)
        numbers = np.stack(
            [
                np.log1p(chars) / 5,
                links / np.maximum(chars, 1),
                np.minimum(8 * stops / np.maximum(words, 1), 3),
                chars / whole,
                np.log1p(words) / 3,
                endings / np.maximum(endings, 1) if is_run.all() else np.minimum(endings, 1),
                np.ones(len(parent)),
            ],
            axis=1,
        )
        features = np.zeros((len(parent), N_FEATURES))
        every = np.arange(len(parent))
        # a run is described by the element around it
        around = np.where(is_run, shown[np.maximum(parent, 0)], shown)
        features[every, around + N_GROUPS * is_run] = 1
        features[:, 2 * N_GROUPS : 2 * N_GROUPS + N_HINTS] = (hints[:, None] >> np.arange(N_HINTS)) & 1
        at = 2 * N_GROUPS + N_HINTS
        features[~is_run, at : at + N_NUMBERS] = numbers[~is_run]
        features[is_run, at + N_NUMBERS :] = numbers[is_run]
        kind = np.where(is_run, 0, np.where((hints > 0) | _TELLING[shown], 2, 1))
        return cls(parent, levels, kind, features, start, runs, group, hints)


def _rising(parent: np.ndarray) -> Iterator[np.ndarray]:
    """Nodes level by level from below the top: those whose parents are in the level before."""
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(len(parent) + 1))
    level = np.flatnonzero(parent < 0)
    while len(level):
        counts = first[level + 1] - first[level]
        total = counts.sum()
        if not total:
            return
        level = order[np.arange(total) - np.repeat(np.cumsum(counts) - counts - first[level], counts)]
        yield level


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of features, for content against the rest
    edges: np.ndarray  # (kind, parent's state, child's state)


def _log_sum(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


def marginals(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log beliefs of each node's two states, and of each edge's four (at the child); both normalised."""
    n = len(forest.parent)
    up = np.zeros((n, 2))  # a node's potential and all messages from below
    up[:, 1] = forest.features @ model.weights
    to_parent, down = np.zeros((n, 2)), np.zeros((n, 2))
    edge = model.edges[forest.kind]
    for level in reversed(forest.levels[1:]):
        to_parent[level] = _log_sum(edge[level] + up[level][:, None, :])
        np.add.at(up, forest.parent[level], to_parent[level])
    rest = np.zeros((n, 2))  # at the parent, without what this child told it
    for level in forest.levels[1:]:
        above = forest.parent[level]
        rest[level] = up[above] + down[above] - to_parent[level]
        down[level] = _log_sum(np.swapaxes(edge[level], 1, 2) + rest[level][:, None, :])
    nodes = up + down
    nodes -= _log_sum(nodes)[:, None]
    pairs = edge + rest[:, :, None] + up[:, None, :]
    pairs -= np.logaddexp(_log_sum(pairs[:, 0]), _log_sum(pairs[:, 1]))[:, None, None]
    return nodes, pairs


def learn(examples: list[tuple[Forest, np.ndarray]]) -> Model:
    """Maximum likelihood by adaptive gradient steps; that they are few keeps weights small."""
    weights, edges = np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2))
    state = [np.zeros_like(x) for x in (weights, edges, weights, edges)]
    scale = sum(len(f.parent) for f, _ in examples)
    for step in range(1, ROUNDS + 1):
        slopes = [np.zeros_like(weights), np.zeros_like(edges)]
        for forest, label in examples:
            nodes, pairs = marginals(forest, Model(weights, edges))
            slopes[0] = slopes[0] + forest.features.T @ (label - np.exp(nodes[:, 1]))
            child = np.flatnonzero(forest.parent >= 0)
            wrong = -np.exp(pairs[child])
            wrong[np.arange(len(child)), label[forest.parent[child]], label[child]] += 1
            np.add.at(slopes[1], forest.kind[child], wrong)
        for k, (value, slope) in enumerate(zip((weights, edges), slopes)):
            slope = slope / scale
            state[k] = 0.9 * state[k] + 0.1 * slope
            state[k + 2] = 0.99 * state[k + 2] + 0.01 * slope**2
            value += RATE * state[k] / (1 - 0.9**step) / (np.sqrt(state[k + 2] / (1 - 0.99**step)) + 1e-8)
    return Model(weights, edges)


# Labelled pages

#: Characters that label a run of text in a labelled page: content, and the rest.
GOOD, OTHER = "\x01", "\x02"


def run_labels(page: Page) -> np.ndarray:
    """Whether each run of a labelled page is content."""
    return np.array([GOOD in text for text in page.texts], bool)


def labelled_page(draw: random.Random) -> str:
    """A page put together from parts, each run of its text labelled by a character."""
    letters = "abcdefghijklmnopqrstuvwxyzéüß"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
    words = lambda low, high: " ".join(word() for _ in range(draw.randint(low, high)))

    def sentences(n: int) -> str:
        parts = (words(2, 14).capitalize() + draw.choice(("", ", " + words(1, 8))) + draw.choice("...!?") for _ in range(n))
        return " ".join(parts)

    def run(text: str, good: bool) -> str:
        return (GOOD if good else OTHER) + text

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def tag(name: str, body: str, *hints: str, named: float = 0.7) -> str:
        value = draw.choice(HINTS[draw.choice(hints)].split()) if hints and draw.random() < named else draw.choice(("", word()))
        value = draw.choice((value, value, f"{value}-{word()}", f"{word()}_{value}")) if value else ""
        attribute = f' {draw.choice(("class", "id"))}="{value}"' if value else ""
        return f"<{name}{attribute}>{body}</{name}>"

    def links(n: int) -> str:
        item = lambda: f"<li>{run(link(words(1, 4)), False)}</li>"
        return f"<ul>{''.join(item() for _ in range(n))}</ul>" if draw.random() < 0.8 else run(" | ".join(link(words(1, 3)) for _ in range(n)), False)

    def small(low: int = 1, high: int = 3) -> str:
        text = draw.choice((lambda: words(2, 12), lambda: sentences(draw.randint(low, high)), lambda: link(words(1, 6)) + " " + words(0, 6)))()
        return draw.choice(("{}", "<p>{}</p>", "<div>{}</div>", "<span>{}</span>")).format(run(text, False))

    def paragraph(good: bool = True) -> str:
        text = sentences(draw.choice((1, 1, 2, 4, 8))) if draw.random() < 0.9 else words(1, 4)
        if draw.random() < 0.2:
            text += " " + link(words(1, 4)) + " " + words(1, 6) + "."
        return f"<p>{run(draw.choice(('{}', '{}', '<b>{}</b>', '{}<br>')).format(text), good)}</p>"

    def content() -> str:
        kind = draw.random()
        if kind < 0.7:
            return paragraph()
        if kind < 0.8:
            return f"<h{(n := draw.randint(2, 4))}>{run(words(1, 7), True)}</h{n}>"
        if kind < 0.88:
            return f"<ul>{''.join(f'<li>{run(sentences(1), True)}</li>' for _ in range(draw.randint(1, 5)))}</ul>"
        if kind < 0.92:
            return f"<blockquote>{paragraph()}</blockquote>"
        if kind < 0.95:
            return f"<pre>{run(words(3, 20), True)}</pre>"
        if kind < 0.98:
            cells = lambda: "".join(f"<td>{run(words(1, 3), True)}</td>" for _ in range(3))
            return f"<table>{''.join(f'<tr>{cells()}</tr>' for _ in range(draw.randint(1, 4)))}</table>"
        return f"<figure><img src=x><figcaption>{run(sentences(1), True)}</figcaption></figure>"

    comment = lambda: tag(draw.choice(("div", "li", "article")), run(words(1, 2), False) + f"<p>{run(sentences(draw.randint(1, 4)), False)}</p>", "comment")
    field = lambda: tag("form", f"<label>{run(words(1, 3), False)}</label><input><button>{word()}</button>" + draw.choice(("", small())), "form", "notice")
    noise = (
        lambda: tag(draw.choice(("nav", "div", "nav")), links(draw.randint(2, 9)), "menu"),
        lambda: tag("header", draw.choice(("", small())) + links(draw.randint(1, 6)), "frame"),
        lambda: tag(draw.choice(("aside", "div")), f"<h3>{run(words(1, 3), False)}</h3>" + draw.choice((links, lambda n: "".join(paragraph(False) for _ in range(min(n, 2)))))(draw.randint(2, 6)), "side", named=0.95),
        lambda: tag("div", small(), "advert", named=0.95),
        lambda: tag(draw.choice(("div", "section")), small(1, 4), "notice", named=0.95),
        lambda: tag(draw.choice(("div", "ul")), run(" ".join(link(word()) for _ in range(draw.randint(2, 5))), False), "share"),
        field,
    )
    inner = (noise[3], noise[4], noise[5], field, noise[2])
    before = "".join(draw.choice(noise)() for _ in range(draw.randint(0, 4)))
    title = f"<h1>{run(words(2, 12), True)}</h1>"
    parts = [draw.choice((title, title, title, f"<header>{title}</header>"))] if draw.random() < 0.8 else []
    for _ in range(draw.choice((0, 1, 2, 4, 8, 16))):
        parts.append(content())
        if draw.random() < 0.08:
            parts.append(draw.choice(inner)())
    parts = parts or [paragraph()]
    if draw.random() < 0.2:
        parts.append(tag(draw.choice(("div", "section", "ol")), "".join(comment() for _ in range(draw.randint(1, 4))), "comment", named=0.97))
    name = draw.choice(("article", "article", "article", "main", "div", "div", "section"))
    body = tag(name, "".join(parts), "content", named=0.5 if name in ("article", "main") else 0.9)
    bare = draw.random()
    if bare < 0.1:  # no element around the article
        body = "".join(parts) if bare > 0.02 else run(sentences(3), True)
    elif draw.random() < 0.3:
        body = tag("div", body, *draw.choice((("content",), ())))
    after = []
    if draw.random() < 0.3:
        after.append(tag(draw.choice(("section", "div")), f"<h2>{run(words(1, 3), False)}</h2>" + "".join(comment() for _ in range(draw.randint(1, 6))), "comment", named=0.97))
    after += [draw.choice(noise)() for _ in range(draw.randint(0, 3))]
    if draw.random() < 0.9:
        after.append(tag(draw.choice(("footer", "footer", "div")), small() + draw.choice(("", links(3))), "frame", named=0.9))
    return f"<html><head><title>{words(2, 6)}</title></head><body>{before}{body}{''.join(after)}</body></html>"


def _spread(forest: Forest, runs: np.ndarray) -> np.ndarray:
    """Labels of all nodes from those of runs: of the elements that hold content, those above the innermost one that
    holds all of a page's content are not content, unless they hold nothing else."""
    held = np.zeros((len(forest.parent), 2))
    held[forest.runs[:, 0], runs.astype(int)] = 1
    for level in reversed(forest.levels[1:]):
        np.add.at(held, forest.parent[level], held[level])
    page = np.repeat(np.arange(len(forest.start) - 1), np.diff(forest.start))
    other, good = held.T
    whole = (good > 0) & (good == good[forest.start[:-1]][page])
    innermost = whole.copy()
    innermost[forest.parent[np.flatnonzero(whole & (forest.parent >= 0))]] = False
    return ((good > 0) & (~whole | innermost | (other == 0))).astype(np.int64)


def self_labels(forest: Forest) -> np.ndarray:
    """Content is what lies in the <article>, or in <main> where a page has none, but not in a part that is set apart."""
    article, main = forest.group == _AT["article"], forest.group == _AT["main"]
    page = np.repeat(np.arange(len(forest.start) - 1), np.diff(forest.start))
    has = np.bincount(page, article, len(forest.start) - 1) > 0
    top = np.where(has[page], article, main)
    apart = _APART[forest.group] | (forest.hints & _APART_HINTS > 0)
    inside = top.copy()
    for level in forest.levels[1:]:
        inside[level] = (inside[level] | inside[forest.parent[level]]) & ~(apart[level] & ~top[level])
    return inside.astype(np.int64)


def train(pages: DataFrame) -> Model:
    """A model for ``pages`` (page_id, url, html). SAMPLED pages of bounded length come to the driver."""
    draw = random.Random(0)
    made = [Page(labelled_page(draw)) for _ in range(LAYOUTS)]
    forest = Forest.of(made)
    examples = [(forest, _spread(forest, np.concatenate([*map(run_labels, made)])))]
    telling = F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.octet_length("html") <= SAMPLE_BYTES)
    told = pages.where(telling).select("html", F.xxhash64("page_id", "url").alias("nth"))
    # Hashes alone find the bound, so that pages which are not chosen never leave their tasks.
    last = told.select("nth").orderBy("nth").limit(SAMPLED).agg(F.max("nth")).first()[0]
    chosen = told.where(F.col("nth") <= F.lit(last)).groupBy("nth").agg(F.min("html").alias("html"))
    found = [Page(row["html"]) for row in chosen.orderBy("nth").collect()]
    for part, plain in ((found[::2], False), (found[1::2], True)):
        if part:
            label = self_labels(Forest.of(part))
            examples.append((Forest.of(part, plain), label))
    return learn(examples)


def texts_of(model: Model, sources: list[str]) -> list[str]:
    pages = [Page(source) for source in sources]
    forest = Forest.of(pages)
    nodes, _ = marginals(forest, model)
    content = nodes[forest.runs[:, 0], 1] >= np.log(0.5)
    ends = np.cumsum([len(p.runs) for p in pages])
    return [p.text(np.flatnonzero(part)) for p, part in zip(pages, np.split(content, ends[:-1]))]


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, size = [], 0
            for row in rows_of(batches, "page_id", "url", "html"):
                held.append(row)
                size += len(row[2] or "") + 64
                if size >= SLICE_CHARS:
                    yield from told(held)
                    held, size = [], 0
            if held:
                yield from told(held)

        def told(held):
            for (page, url, _), text in zip(held, texts_of(model, [html or "" for *_, html in held])):
                yield (page, url, text), len(text) + 64

        yield from batches_of(rows(), pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]))

    wanted = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    return wanted.mapInArrow(work, "page_id bigint, url string, text string")

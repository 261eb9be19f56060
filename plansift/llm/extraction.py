"""Operator 11: main text of pages by a graphical model over the DOM.

Every block element and every text run of a page is a node that is content or
not. A node has a potential from what it looks like (element, names in class and
id, words, links, sentences, place), an edge between parent and child one by the
kind of the child. The graph is a tree, so one pass of messages from the leaves
to the root and one back give every node's exact marginal (sum-product); runs
whose marginal is at least one half are the text. The passes work level by
level on many pages at once.

Weights maximise the likelihood of labelled pages; its gradient is the
difference between observed and expected features, and the expectations come
from the same two passes. Labelled are layouts with marks (``layouts``) and
pages of the table that name their parts themselves: in ``article`` or ``main``
is content, but for navigation, asides, forms, footers and named extras inside
it. At most MAX_LABELLED such pages with at most MAX_CHARS characters are drawn
by a hash of the id; extraction covers whole pages of all rows.

Defined results: null, empty and blank html give an empty text, as do pages
without content. Nesting of any depth and pages of any length are read whole;
pages that break off are read as far as they go. Repeated rows get equal
results; an empty table gives no rows (its model is that of the layouts). Null ids and urls stay null.
Columns besides page_id, url and html are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm import dom
from plansift.llm.common import group_by_checked, md5_unit
from plansift.llm.layouts import labelled_pages

MAX_LABELLED = 300
MAX_CHARS = 40_000
LAYOUTS = 700
#: Nodes of a batch of pages that are worked on together.
BATCH_NODES = 20_000
PENALTY = 2e-4
STEPS = 160
RATE = 0.12


@dataclass
class Model:
    """Log potentials: one weight per feature for content, and per edge kind for (parent, child) = (0, 0), (0, 1), (1, 0), (1, 1)."""

    node: np.ndarray
    edge: np.ndarray


@dataclass
class Beliefs:
    """Marginals of nodes, and of (parent, child) pairs at children; log of the sum over all labellings."""

    content: np.ndarray
    pair: np.ndarray
    log_sum: float


def levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def sum_product(trees: dom.Forest, model: Model, by_level: list[np.ndarray] | None = None) -> Beliefs:
    """Exact marginals of all trees by messages to the roots and back."""
    by_level = levels(trees.depth) if by_level is None else by_level
    n = len(trees.parent)
    up = np.zeros((n, 2))
    up[:, 1] = model.node[trees.codes].sum(axis=1)
    edge = model.edge[trees.edge].reshape(n, 2, 2)
    to_parent, to_child = np.zeros((n, 2)), np.zeros((n, 2))
    for nodes in by_level[:0:-1]:
        message = np.logaddexp(edge[nodes, :, 0] + up[nodes, :1], edge[nodes, :, 1] + up[nodes, 1:])
        to_parent[nodes] = message
        np.add.at(up, trees.parent[nodes], message)
    for nodes in by_level[1:]:
        parent = trees.parent[nodes]
        rest = up[parent] + to_child[parent] - to_parent[nodes]
        to_child[nodes] = np.logaddexp(edge[nodes, 0] + rest[:, :1], edge[nodes, 1] + rest[:, 1:])
    total = up + to_child
    log_sum = np.logaddexp(total[:, 0], total[:, 1])
    content = np.exp(total[:, 1] - log_sum)
    has = trees.parent >= 0
    parent = np.where(has, trees.parent, 0)
    rest = up[parent] + to_child[parent] - to_parent
    pair = np.exp(rest[:, :, None] + edge + up[:, None, :] - log_sum[:, None, None]).reshape(n, 4) * has[:, None]
    return Beliefs(content, pair, float(log_sum[~has].sum()))


def element_labels(trees: dom.Forest, words: np.ndarray) -> np.ndarray:
    """Labels of runs as marked; an element is content if most words below it are."""
    label = trees.label * trees.is_run
    own = words * label
    total = words.copy()
    for nodes in levels(trees.depth)[:0:-1]:
        np.add.at(own, trees.parent[nodes], own[nodes])
        np.add.at(total, trees.parent[nodes], total[nodes])
    return np.where(trees.is_run, label, 2 * own > total)


def fit(pages: list[dom.Page]) -> Model:
    """Weights that maximise the penalised likelihood of labelled pages."""
    trees, by_level = dom.forest(pages), None
    words = np.fromiter((t.count(" ") + 1 if t else 0 for p in pages for t in p.text), np.int64)
    label = element_labels(trees, words)
    by_level = levels(trees.depth)
    n, has = len(label), trees.parent >= 0
    seen_node = np.bincount(trees.codes[label == 1].ravel(), minlength=dom.N_FEATURES)
    seen_edge = np.bincount(4 * trees.edge[has] + 2 * label[trees.parent[has]] + label[has], minlength=4 * dom.EDGE_KINDS).reshape(-1, 4)
    model = Model(np.zeros(dom.N_FEATURES), np.zeros((dom.EDGE_KINDS, 4)))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (model.node, model.edge)]
    for step in range(1, STEPS + 1):
        found = sum_product(trees, model, by_level)
        expected = np.bincount(trees.codes.ravel(), np.repeat(found.content, trees.codes.shape[1]), dom.N_FEATURES)
        pairs = np.zeros((dom.EDGE_KINDS, 4))
        np.add.at(pairs, trees.edge, found.pair)
        for (first, second), weight, gradient in zip(moments, (model.node, model.edge), ((seen_node - expected) / n, (seen_edge - pairs) / n), strict=True):
            gradient = gradient - PENALTY * weight
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient * gradient - second)
            weight += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model


def own_labels(page: dom.Page) -> bool:
    """Label the runs of a page by the parts it names; False if it names no article."""
    if 1 not in page.zone:
        return False
    page.label = [int(zone == 1 and near in (0, 4)) for zone, near in zip(page.zone, page.near, strict=True)]
    return True


def train(pages: DataFrame, layouts: int = LAYOUTS, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from layouts and from at most ``max_labelled`` pages of the table that name their parts."""
    named = pages.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.length("html") <= MAX_CHARS)).select(
        "html", md5_unit("page", F.col("page_id"), F.md5("html")).alias("u"))
    # the numbers alone are sorted; only the pages drawn come to the driver
    last = named.select("u").orderBy("u").limit(max_labelled).agg(F.max("u")).first()[0]
    drawn = named.filter(F.col("u") <= F.lit(last)).limit(max_labelled).collect() if last is not None else []
    own = [page for page in (dom.read(row["html"]) for row in drawn) if own_labels(page)]
    return fit([dom.read(source) for source in labelled_pages(layouts)] + own)


def blocks_of(sources: list[str | None], model: Model) -> list[list[tuple[str, float]]]:
    """Text runs of each page with their marginals, in page order."""
    found: list[list[tuple[str, float]]] = []
    held: list[dom.Page] = []
    nodes = 0

    def settle() -> None:
        nonlocal nodes
        if held:
            content = sum_product(dom.forest(held), model).content.tolist()
            at = 0
            for page in held:
                found.append([(text, content[at + i]) for i, text in enumerate(page.text) if text is not None])
                at += len(page.text)
        held.clear()
        nodes = 0

    for source in sources:
        held.append(dom.read(source))
        nodes += len(held[-1].parent)
        if nodes >= BATCH_NODES:
            settle()
    settle()
    return found


def extract(pages: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars and blocks (text, content: its marginal, kept) of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = blocks_of(part.column("html").to_pylist(), model)
                texts = ["\n".join(text for text, p in blocks if p >= least) for blocks in found]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in found])]), pa.int32())
                flat = [x for blocks in found for x in blocks]
                each = pa.StructArray.from_arrays([
                    pa.array([t for t, _ in flat], pa.string()), pa.array([p for _, p in flat], pa.float64()), pa.array([p >= least for _, p in flat], pa.bool_())],
                    names=["text", "content", "kept"])
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.ListArray.from_arrays(offsets, each)], ["page_id", "url", "text", "n_chars", "blocks"])

    rows = group_by_checked(pages, {"page_id", "url", "html"})
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, blocks array<struct<text:string,content:double,kept:boolean>>")

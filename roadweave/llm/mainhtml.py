"""Main text of web pages: boosted trees judge the nodes of a page, and a decoding over the tree makes their choices agree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost, common
from .dom import HEADINGS, Page, attribute_tokens, punctuation
from .pagegen import labelled_page

#: The classifier's sample: so many generated pages, of which each node that holds text is a labelled row.
SAMPLE_PAGES, N_TREES, DEPTH = 2500, 30, 5
#: What it costs to keep one of two like neighbours only, in margins.
AGREE = 2.5
#: A name on fewer sample pages than this says nothing.
LEAST_PAGES = 3
FEATURES = 35


@dataclass
class Nodes:
    """Nodes of many pages that hold text: their features, and where each page's lie."""

    x: np.ndarray
    page: list[Page]
    node: list[np.ndarray]  # for each page, the numbers of its nodes


def names_of(page: Page, i: int) -> tuple[str, list[str]]:
    """A node's tag as a name, and its attributes' names."""
    return "<" + page.tag[i], attribute_tokens(page.attributes[i]) if page.attributes[i] else []


def features_of(page: Page, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes that hold text, a row of features each).

    ``weights``: how much more often nodes with a name are article than others.
    """
    n = len(page.tag)
    end, parent, depth = np.array(page.end), np.array(page.parent), np.array(page.depth, float)
    leaf = np.zeros((n, 6))  # blocks, characters, words, marks, characters in links, characters in paragraphs
    heads = np.zeros(n)
    tag_w, low, high, total = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    up = np.zeros((n, 4))  # smallest and largest weight of names and of tags, up to the root
    order, last = np.zeros(n), {}
    before = np.full(n, -1)
    for i in range(n):
        tag, text, p = page.tag[i], page.text.get(i), page.parent[i]
        if text is not None:
            size = len(text)
            leaf[i] = 1, size, text.count(" ") + 1, punctuation(text), page.linked[i], size if page.tag[p] == "p" else 0
        else:
            heads[i] = tag in HEADINGS
            tag_w[i] = weights.get("<" + tag, 0.0)
            if page.attributes[i]:
                own = [weights.get(t, 0.0) for t in attribute_tokens(page.attributes[i])]
                if own:
                    low[i], high[i], total[i] = min(own), max(own), sum(own)
        if p >= 0:
            a, b, c, d = up[p]
            up[i] = min(a, low[i]), max(b, high[i]), min(c, tag_w[i]), max(d, tag_w[i])
            if p in last:
                before[i] = last[p]
                order[i] = order[last[p]] + 1
            last[p] = i
    sums = np.vstack([np.zeros(7), np.cumsum(np.column_stack([leaf, heads]), axis=0)])
    at = np.arange(n)
    blocks, chars, words, marks, linked, in_p, titles = (sums[end] - sums[at]).T
    holds = np.flatnonzero(chars > 0)
    if not len(holds):
        return holds, np.empty((0, FEATURES))
    up_at = np.maximum(parent, 0)
    after = np.full(n, -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    count = np.zeros(n)
    np.maximum.at(count, up_at[1:], order[1:] + 1)
    density = linked / np.maximum(chars, 1)
    size = end - at
    log = np.log1p
    side = lambda v, k: np.where(k >= 0, v[np.maximum(k, 0)], -1.0)
    leaf_parent = np.where(leaf[:, 0] > 0, up_at, at)  # a block of text is judged with the element around it
    x = np.column_stack([
        leaf[:, 0], tag_w[leaf_parent], total[leaf_parent], low[leaf_parent], high[leaf_parent], up, tag_w[up_at], low[up_at], high[up_at], depth, log(chars), log(words), density, words / np.maximum(blocks, 1),
        marks / np.maximum(words, 1), log(blocks), chars / size, chars / chars[0], sums[at, 1] / chars[0], order / np.maximum(count[up_at], 1), log(count[up_at]), chars / np.maximum(chars[up_at], 1),
        side(log(chars), before), side(log(chars), after), side(density, before), side(density, after), in_p / np.maximum(chars, 1), titles, log(blocks[up_at]), density[up_at], side(marks, before) > 0, log(sums[end, 6]),
    ])
    return holds, x[holds].astype(float)


def decode(page: Page, holds: np.ndarray, margin: np.ndarray, agree: float = AGREE) -> list[int]:
    """The blocks of text to keep: the consistent choice of greatest total.

    Each node is open or closed; what lies below a closed node is closed.  An
    open node counts its margin, a closed one the opposite, and neighbours of
    the same tag and attributes that are chosen differently cost ``agree``.
    An element around one block of text and that block are chosen alike.
    """
    n = len(page.tag)
    score = np.zeros(n)
    score[holds] = margin
    score, closed = score.tolist(), [0.0] * n
    opened, children = score[:], [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parent[i]].append(i)
    chosen: list = [None] * n  # of an open node's children: which are open
    for i in range(n - 1, -1, -1):
        closed[i] = -score[i]
        if not children[i]:
            continue
        if len(children[i]) == 1 and children[i][0] in page.text:  # an element around one block is one with it
            opened[i] += score[children[i][0]]
            closed[i] += closed[children[i][0]]
            chosen[i] = [True]
            continue
        up, down, trace, last = 0.0, 0.0, [], -1  # the best so far whose last child is open, or closed
        for c in children[i]:
            cost = agree if last >= 0 and page.tag[c] and page.tag[c] == page.tag[last] and page.attributes[c] == page.attributes[last] else 0.0
            stay_up, stay_down = up >= down - cost, down >= up - cost
            trace.append((stay_up, stay_down))
            up, down = (up if stay_up else down - cost) + opened[c], (down if stay_down else up - cost) + closed[c]
            closed[i] += closed[c]
            last = c
        opened[i] += max(up, down)
        state, states = up > down, []
        for stay_up, stay_down in reversed(trace):
            states.append(state)
            state = state if (stay_up if state else stay_down) else not state
        chosen[i] = states[::-1]
    is_open, out = [True] + [False] * (n - 1), []
    for i in range(n):
        if is_open[i]:
            for c, state in zip(children[i], chosen[i] or ()):
                is_open[c] = state
            if i in page.text:
                out.append(i)
    return out


@dataclass
class Extractor:
    """What a fit has learned: the weights of names, and the trees."""

    weights: dict[str, float]
    trees: boost.Trees

    def blocks(self, pages: list[Page]) -> list[list[int]]:
        """Of each page the blocks of its article."""
        found = [features_of(p, self.weights) for p in pages]
        x = np.concatenate([f[1] for f in found]) if found else np.empty((0, FEATURES))
        margin, ends = self.trees.margin(x), np.cumsum([len(f[0]) for f in found])
        return [decode(p, f[0], margin[e - len(f[0]) : e]) for p, f, e in zip(pages, found, ends)]

    def texts(self, htmls: list[str | None]) -> list[str]:
        pages = [Page(h or "") for h in htmls]
        return ["\n\n".join(p.text[i] for i in b) for p, b in zip(pages, self.blocks(pages))]


def _labels(page: Page, truth: list[tuple[str, bool]]) -> np.ndarray:
    """Whether each node holds article text."""
    good = np.zeros(len(page.tag))
    for i, (_, g) in zip(sorted(page.text), truth, strict=True):
        good[i] = g
    sums = np.concatenate([[0], np.cumsum(good)])
    return (sums[np.array(page.end)] > sums[: len(good)]).astype(float)


def _name_counts(batches) -> Iterator[pd.DataFrame]:
    """For each sample page and name: how many of its nodes that hold text are article, and how many are not."""
    for batch in batches:
        rows = []
        for seed in batch["id"].tolist():
            html, truth = labelled_page(seed)
            page = Page(html)
            good, seen = _labels(page, truth), {}
            texts = np.cumsum([0, *(i in page.text for i in range(len(page.tag)))])
            for i in range(len(page.tag)):
                if page.end[i] > i + 1 and texts[page.end[i]] > texts[i]:
                    tag, names = names_of(page, i)
                    for name in {tag, *names}:
                        own = seen.setdefault(name, [0.0, 0.0])
                        own[int(good[i])] = 1.0  # a page counts once for each
            rows += [(name, a, b) for name, (a, b) in seen.items()]
        yield pd.DataFrame(rows, columns=["name", "bad", "good"])


def _labelled_rows(batches, weights: dict[str, float]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for seed in batch["id"].tolist():
            html, truth = labelled_page(seed)
            page = Page(html)
            holds, x = features_of(page, weights)
            yield pd.DataFrame({"x": list(x), "label": _labels(page, truth)[holds]})


_fitted: dict[tuple, Extractor] = {}


def fit(spark: SparkSession, n_pages: int = SAMPLE_PAGES, n_trees: int = N_TREES, depth: int = DEPTH) -> Extractor:
    """An extractor learned from the first ``n_pages`` labelled pages of :mod:`pagegen`.

    That sample is the only bound.  It does not depend on any table, so that
    a process fits once for each choice of parameters.
    """
    key = (n_pages, n_trees, depth)
    if key not in _fitted:
        seeds = spark.range(0, n_pages, 1, spark.sparkContext.defaultParallelism)
        counts = seeds.mapInPandas(_name_counts, "name string, bad double, good double").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        rows = counts.where(F.col("bad") + F.col("good") >= LEAST_PAGES).collect()  # names of the generator only
        whole = sum(r["good"] for r in rows if r["name"][0] == "<") / sum(r["bad"] + r["good"] for r in rows if r["name"][0] == "<")
        prior = float(np.log(whole / (1 - whole)))
        weights = {r["name"]: float(np.log((r["good"] + 1) / (r["bad"] + 1))) - prior for r in sorted(rows)}
        labelled = seeds.mapInPandas(partial(_labelled_rows, weights=weights), "x array<double>, label double")
        labelled = common.stored(labelled, "page-nodes").select(array_to_vector("x").alias("features"), "label")
        _fitted[key] = Extractor(weights, boost.fit(labelled, n_trees, depth))
    return _fitted[key]


@common.tidy
def _extract(batches, model: Extractor, html: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index(html)
        for first, values in common.slices(batch, html):
            rest = [batch.column(k).slice(first, len(values)) for k in range(batch.num_columns) if k != at]
            texts = model.texts([None if v is None else v.decode("utf-8", "replace") for v in values])
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], [*(c for c in batch.schema.names if c != html), "text"])


def main_text(pages: DataFrame, html: str = "html", model: Extractor | None = None) -> DataFrame:
    """``pages`` without ``html``, plus text STRING: the article's blocks in page order, two line feeds between them.

    A page becomes a tree of its block-level elements and the blocks of text
    between their tags; scripts, styles, comments in the markup, buttons and
    the like never become text.  Character references are decoded, white space
    within a block becomes one space.  For each node boosted trees give a
    margin from its text, links and marks, its share and place in the page,
    its neighbours, and the tags and names of itself and the elements around
    it.  Of all choices in which nothing below a dropped node is kept, that of
    the greatest sum of margins decides.  Pages are worked on one by one, whole, without a shuffle.

    A null or empty page, and one without article, has an empty text.  Repeated
    rows each give a row.  An empty table stays empty.  A column called text is
    replaced, others come along.  Null bytes and invalid UTF-8 are let pass.
    """
    model = model or fit(pages.sparkSession)
    rest = pages.drop("text") if html != "text" else pages
    carried = [c for c in rest.columns if c != html]
    hidden = common.fresh(rest, *(f"mt_{k}" for k in range(len(carried))), "mt_html")
    read = rest.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(carried, hidden)], F.col(html).cast("binary").alias(hidden[-1]))
    kinds = [f"{h} {rest.schema[c].dataType.simpleString()}" for c, h in zip(carried, hidden)]
    found = read.mapInArrow(partial(_extract, model=model, html=hidden[-1]), ", ".join([*kinds, "text string"]))
    return found.select(*[F.col(h).alias(c) for c, h in zip(carried, hidden)], "text")

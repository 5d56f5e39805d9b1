"""Main text of pages by a tree-structured graphical model.

Each element and each stretch of text is a node that is content or not. Its traits (name, words of
class and id, length and links of a text) give it a potential, and a parent and its child share
one. Sum-product messages from the leaves to the root and back give every node's probability of
being content, exact on a tree. Texts whose probability is at least one half are kept.

The potentials are counted on labelled pages (`html_labelled`), in which an element marked
`data-main` gives its state to everything below it.
"""

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import tokens
from leakscope.llm.common import mapped
from leakscope.llm.html_labelled import labelled_pages
from leakscope.llm.html_tree import Node, Page, parse


@dataclass
class Model:
    prior: tuple[float, float]
    #: share[child is a text][parent state][child state]
    share: tuple
    #: log odds of content for each trait
    odds: dict[str, float]


def _states(page: Page) -> list[int]:
    """State of each node of a labelled page: that of the nearest marked element above it.

    An unmarked element is content if something below it is.
    """
    states: list[int | None] = []
    for n in page.nodes:
        states.append(int(n.main) if n.main is not None else
                      states[n.parent] if n.parent >= 0 else None)
    holds = [s == 1 for s in states]
    for i in range(len(states) - 1, 0, -1):
        holds[page.nodes[i].parent] |= holds[i]
    return [int(h) if s is None else s for s, h in zip(states, holds)]


# How much a kind of trait counts: words of class and id most, as they are given on purpose; names
# and positions less, as they depend on each other.
WEIGHTS = {"word": 1.6, "hidden": 1.6, "tag": 0.8, "tags": 0.5, "text": 0.5, "in": 0.5}


def train(pages: list[str], smooth: float = 0.5) -> Model:
    """Potentials counted on labelled pages."""
    seen, total = (Counter(), Counter()), [0, 0]
    pairs, roots = Counter(), [1, 1]
    for html in pages:
        page = parse(html)
        states = _states(page)
        for node, s in zip(page.nodes, states):
            seen[s].update(node.traits)
            total[s] += 1
            if node.parent >= 0:
                pairs[node.tag == "#text", states[node.parent], s] += 1
            else:
                roots[s] += 1
    odds = {
        t: WEIGHTS[t.partition(":")[0]] * (math.log((seen[1][t] + smooth) / (total[1] + 2 * smooth))
                     - math.log((seen[0][t] + smooth) / (total[0] + 2 * smooth)))
        for t in {*seen[0], *seen[1]}
    }
    share = tuple(
        tuple(tuple((pairs[k, a, b] + smooth) / (pairs[k, a, 0] + pairs[k, a, 1] + 2 * smooth)
                    for b in (0, 1)) for a in (0, 1))
        for k in (False, True))
    return Model((roots[0] / sum(roots), roots[1] / sum(roots)), share, odds)


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Probability of being content for each node; parents stand before their children."""
    n = len(nodes)
    shares = [model.share[node.tag == "#text"] for node in nodes]
    own = []
    for i, node in enumerate(nodes):
        x = sum(model.odds.get(t, 0.0) for t in node.traits)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
        own.append([(1 - p) * (model.prior[0] if i == 0 else 1.0),
                    p * (model.prior[1] if i == 0 else 1.0)])
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):  # from the leaves to the root
        (a, b), share = own[i], shares[i]
        m0, m1 = share[0][0] * a + share[0][1] * b, share[1][0] * a + share[1][1] * b
        s = m0 + m1
        up[i] = m0, m1 = m0 / s, m1 / s
        parent = own[nodes[i].parent]
        parent[0] *= m0
        parent[1] *= m1
        s = parent[0] + parent[1]
        parent[0] /= s
        parent[1] /= s
    out = [0.0] * n
    for i in range(n):  # and back
        (a, b), share = own[i], shares[i]
        if i:
            p0, p1 = own[nodes[i].parent]
            p0, p1 = p0 / up[i][0], p1 / up[i][1]  # what the parent believes without this child
            a *= p0 * share[0][0] + p1 * share[1][0]
            b *= p0 * share[0][1] + p1 * share[1][1]
        s = a + b
        own[i] = [a / s, b / s]
        out[i] = b / s
    return out


def main_text(html: str, model: Model) -> str:
    """Kept texts of the page: pieces of a block by blanks, blocks by line breaks."""
    page = parse(html)
    if not page.texts:
        return ""
    keep = marginals(page.nodes, model)
    blocks: list[tuple[int, list[str]]] = []
    for node, block, text in page.texts:
        if keep[node] >= 0.5:
            if not blocks or blocks[-1][0] != block:
                blocks.append((block, []))
            blocks[-1][1].append(text)
    return "\n".join(" ".join(parts) for _, parts in blocks)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (columns page_id, url, html).

    Null or empty html, or a page without article text, gives an empty text. Null ids and urls and
    repeated rows are kept; other columns are ignored. The whole page is read.
    """
    model = model or train(labelled_pages())

    def run(batches):
        for (ids, urls), htmls in tokens.parts(batches):
            texts = [main_text(h, model) for h in htmls]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    columns = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return mapped(columns, run, "page_id long, url string, text string, n_chars long")

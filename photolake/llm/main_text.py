"""Main text of web pages by minimum cuts: a classifier's costs of a block are its capacities to the terminals, blocks that
are next to each other or near in the document tree hold together by smoothness edges, and a maximum flow separates content
from boilerplate.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import HEADINGS, HINT, MAIN, Block, Page
from .shared import freeing
from .words import pieces

#: Pages that the classifier learns from at most, and blocks of each.
MAX_TRAINING_PAGES, MAX_TRAINING_BLOCKS = 2000, 50
#: Capacities are whole numbers of this part of a unit of log odds.
UNIT = 1000
FEATURES = ("one", "words", "linked", "ends", "marks", "heading", "item", "digits", "capitals")
# Where the corpus says nothing: weights of the log odds of content by the text of a block alone.
PRIOR = np.array([-1.6, 0.9, -4.0, 1.0, 0.5, 0.5, -0.4, -1.0, -0.5])
#: The corpus counts as at most so many blocks beside the prior, whose precision is the second number.
EVIDENCE, PRECISION = 200.0, 4.0
#: Log odds by markup: in an article, by a hint, outside of the page's articles, outside of what hints point at, beside them;
#: the most that text may say.
IN_MAIN, BY_HINT, OUTSIDE, UNHINTED, ASIDE, MOST = 4.0, 1.5, -2.5, -2.0, -9.0, 2.5
#: Capacities of edges to the next block, to the next of the same parent and of the same grandparent.
NEXT, SIBLING, COUSIN = 0.3, 0.8, 0.4
_MARKS, _ENDS = ".,;:!?…。，", (".", "!", "?", "…", ":", "”", "\"", "»", "。")


def features(block: Block) -> list[float]:
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    raw = np.frombuffer(text.encode(), np.uint8)
    between = lambda a, b: np.count_nonzero((raw >= ord(a)) & (raw <= ord(b))) / n
    return [
        1.0, float(np.log1p(words)), block.linked / n, float(text.endswith(_ENDS)), min(1.0, sum(map(text.count, _MARKS)) * 4 / words),
        float(block.tag in HEADINGS), float(block.tag in ("li", "dd", "dt", "option")), between("0", "9"), between("A", "Z"),
    ]


def minimum_cut(prefers: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of the smallest minimum cut.

    ``prefers`` > 0 is a capacity from the source, < 0 one to the sink; ``edges`` (a, b, capacity) hold both ways. A node that
    prefers a side by more than all its open edges carry is settled, and its edges become preferences of its
    neighbours; what is left is settled by a maximum flow.
    """
    n, prefers = len(prefers), list(prefers)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    held = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        a = todo.popleft()
        if side[a] is not None or -held[a] < prefers[a] <= held[a]:
            continue
        side[a] = prefers[a] > 0 and prefers[a] > held[a]
        for b, c in near[a].items():
            if side[b] is None:
                prefers[b] += c if side[a] else -c
                held[b] -= c
                todo.append(b)
    core = [a for a in range(n) if side[a] is None]
    if core:
        place = {a: k for k, a in enumerate(core)}
        links = [(place[a], place[b], c) for a in core for b, c in near[a].items() if a < b and b in place]
        for a, content in zip(core, _by_flow([prefers[a] for a in core], links), strict=True):
            side[a] = content
    return [bool(s) for s in side]


def _by_flow(prefers: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Maximum flow by shortest augmenting levels; the source's side is what its residual edges reach."""
    n = len(prefers)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, left = [], []

    def add(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((there, back))

    for a, p in enumerate(prefers):
        if p > 0:
            add(source, a, p, 0)
        elif p < 0:
            add(a, sink, -p, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if left[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if not left[e])
                a = to[path[full] ^ 1]
                del path[full:]
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if left[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def graph(page: Page, weights: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Terminal capacities and smoothness edges of a page's blocks."""
    blocks, beside = page.blocks, page.set_aside()
    has_main = any(b.zone == MAIN and not s for b, s in zip(blocks, beside, strict=True))
    hinted = [len(b.text) * (b.zone == HINT) for b, s in zip(blocks, beside, strict=True) if not s]
    most_hinted = 2 * sum(hinted) >= sum(len(b.text) for b, s in zip(blocks, beside, strict=True) if not s)
    said = np.array([features(b) for b in blocks]) @ weights if blocks else ()
    prefers = []
    for b, aside, text in zip(blocks, beside, said, strict=True):
        markup = ASIDE if aside else IN_MAIN if b.zone == MAIN else OUTSIDE if has_main else BY_HINT if b.zone == HINT else UNHINTED if most_hinted else 0.0
        prefers.append(round(UNIT * (markup + min(MOST, max(-MOST, float(text))))))
    edges = [(i, i + 1, round(UNIT * NEXT)) for i in range(len(blocks) - 1)]
    for above, weight in (("parent", SIBLING), ("grandparent", COUSIN)):
        last: dict[int, int] = {}
        for i, b in enumerate(blocks):
            group = getattr(b, above)
            if group in last and (group or above == "parent"):  # to be two steps below the page itself says nothing
                edges.append((last[group], i, round(UNIT * weight)))
            last[group] = i
    return prefers, edges


def main_text(html: str, weights: np.ndarray = PRIOR) -> str:
    """Blocks on the content's side of the page's minimum cut, in page order."""
    page = Page(html)
    content = minimum_cut(*graph(page, weights))
    return " ".join(b.text for b, c in zip(page.blocks, content, strict=True) if c)


def training_rows(html: str) -> list[tuple[list[float], bool]]:
    """Features of blocks whose markup tells what they are: in an article, or set aside on a page that has one."""
    page = Page(html)
    beside = page.set_aside()
    told = [(b, not s) for b, s in zip(page.blocks, beside, strict=True) if s or b.zone == MAIN]
    if not any(c for _, c in told):
        return []
    step = max(1, len(told) // MAX_TRAINING_BLOCKS)
    return [(features(b), c) for b, c in told[::step][:MAX_TRAINING_BLOCKS]]


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights around PRIOR (maximum a posteriori, Newton steps, halved while they overshoot); the prior itself where there are no rows."""
    weights, scale = PRIOR.copy(), min(1.0, EVIDENCE / max(len(y), 1))

    def loss(w: np.ndarray) -> float:
        return scale * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + PRECISION / 2 * ((w - PRIOR) ** 2).sum()

    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = scale * x.T @ (p - y) + PRECISION * (weights - PRIOR)
        curve = scale * (x * (p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        while np.abs(step).max() >= 1e-10 and loss(weights - step) > loss(weights):
            step = step / 2
        weights -= step
        if np.abs(step).max() < 1e-10:
            break
    return np.round(weights, 6)


def learned_weights(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = MAX_TRAINING_PAGES) -> np.ndarray:
    """Weights of the text features, from about ``most`` pages at the most, chosen by a hash of the key.

    At most MAX_TRAINING_BLOCKS blocks of a page come to the driver: 100,000 rows of nine numbers by the defaults.
    """
    n = pages.count()
    share = int(1_000_000 * min(1.0, most / max(n, 1)))
    rows = pages.select(F.col(key).alias("key_"), F.col(html).alias("html_"))
    chosen = rows.where(F.pmod(F.xxhash64("key_", F.xxhash64("html_")), F.lit(1_000_000)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html_"):
                told = [r for h in piece.column(1) for r in training_rows(h.as_py() or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in told], pa.list_(pa.float64())), pa.array([r[1] for r in told], pa.bool_())], ["x", "y"])

    found = chosen.mapInArrow(freeing(run), "x array<double>, y boolean").toArrow()
    if not found.num_rows:
        return PRIOR
    x = np.array(found.column("x").to_pylist())
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort([y, *x.T])  # sums don't depend on how the rows came
    return fitted(x[order], y[order])


def extract_main_text(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", most: int = MAX_TRAINING_PAGES) -> DataFrame:
    """One row for each row of ``pages``: key, url, text (the main text), n_chars (its code points, long).

    The main text leaves out menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader
    comments. Character references are decoded, white space in a block becomes one space, blocks are joined in page order by
    one space. A null or empty page, and one without an article, has an empty text; a null URL stays null; repeated rows
    are read each; other columns are not read; an empty table gives none. Reads whole pages. Besides the scan of the bounded
    sample that the classifier learns from, one scan without a shuffle; a task holds one page at a time.
    """
    weights = pages.sparkSession.sparkContext.broadcast(learned_weights(pages, key, html, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html_"):
                texts = pa.array([main_text(h.as_py() or "", weights.value) for h in piece.column(2)], pa.large_string())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), texts, pc.cast(pc.utf8_length(texts), pa.int64())], ["key_", "url_", "text", "n_chars"])

    kinds = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key_"), F.col(url).alias("url_"), F.col(html).alias("html_"))
    out = rows.mapInArrow(freeing(run), f"key_ {kinds[0]}, url_ {kinds[1]}, text string, n_chars bigint")
    return out.select(F.col("key_").alias(key), F.col("url_").alias(url), "text", "n_chars")


#: DuckDB SQL of the same rows for pages whose article is marked up as one element and holds nothing else, as in the given tables.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '</?(p|h1|br|li|ul)[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d"""

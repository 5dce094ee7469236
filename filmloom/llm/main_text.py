"""Main text of web pages by a tree-structured graphical model over the block tree.

Every block element and every run of text is a variable: main text or not. A variable has a log-linear potential over its
features (tag, words of its class, id and role, lengths, share of links, punctuation), and each
parent and child have a joint potential that depends on the kind of edge. Messages passed from the leaves to the page and back
(sum-product) give the exact marginal of each variable; runs above one half are the text.

The model is trained here by the gradient of the exact likelihood, on at most ``TRAIN_PAGES`` pages, the first in the
order of a hash: as they are, if exactly one ``article`` marks their text, and with
their blocks laid out anew in many forms (``page_layouts``), so that other layouts than the corpus's own are known too. Its size
does not grow with the corpus. All pages are then read in full.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm.page_layouts import Layout
from filmloom.llm.page_tree import LANDMARKS, Page, parse

TRAIN_PAGES = 400  # labelled pages the model is fitted on
LAYOUTS = 3  # new layouts for each of them
WIDTH = 1 << 14  # hashed features
EDGES = 5  # kinds of parent-child edges
STEPS = 100
PENALTY = 3e-5
TOGETHER = 2 << 20  # characters of pages labelled at once
LEAVES = frozenset("p li h1 h2 h3 h4 td tr ul ol blockquote".split())

_SEEN: dict[tuple, list[int]] = {}


def _slots(key: tuple, features: Callable[..., list[str]]) -> list[int]:
    """Hashed features of what ``key`` holds after its first entry, kept for the next node like it."""
    at = _SEEN.get(key)
    if at is None:
        at = [zlib.crc32(f.encode()) % WIDTH for f in features(*key[1:])]
        if len(_SEEN) < 100_000:
            _SEEN[key] = at
    return at


def _of_name(tag: str, above: str, *names: str) -> list[str]:
    return ["e", f"t{tag}", f"t{tag}|{above}", *[f"n{name}" for name in names or [""]]]


def _of_shape(size: int, link: int, part: int, paragraphs: int, runs: int) -> list[str]:
    return [f"s{size}", f"l{link}", f"l{link}|{min(size, 9)}", f"w{part}", f"p{paragraphs}", f"r{runs}"]


def _of_run(size: int, link: int, above: str, dense: int, stops: int, words: int, place: int, digits: int) -> list[str]:
    return ["r", f"S{size}", f"L{link}", f"L{link}|{min(size, 9)}", f"T{above}", f"T{above}|{min(size, 8)}", f"P{dense}", f"P{stops}|{words}", f"A{place}", f"D{digits}"]


def _of_words(*words: str) -> list[str]:
    return [f"W{w}" for w in words]


def _share(part: int, whole: int) -> int:
    return 0 if not part else 1 + min(3, 4 * part // max(whole, 1))


def features(page: Page) -> tuple[list[list[int]], list[int]]:
    """Feature numbers of each node and the kind of the edge above it."""
    n = len(page.tags)
    chars, links, runs, paragraphs, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    total = 0
    for i in range(n):
        before[i] = total
        if page.texts[i] is not None:
            chars[i], links[i], runs[i] = len(page.texts[i]), page.linked[i], 1
            total += chars[i]
        paragraphs[i] += page.tags[i] == "p"
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        runs[p] += runs[i]
        paragraphs[p] += paragraphs[i]
    out, edges = [], []
    for i in range(n):
        parent = page.parents[i]
        above = page.tags[parent] if parent >= 0 else ""
        size, link = chars[i].bit_length(), _share(links[i], chars[i])
        if page.texts[i] is None:
            tag, names = page.tags[i], page.names[i][:24]
            f = _slots(("name", tag, above, *names), _of_name) + _slots(("shape", size, link, _share(chars[i], total), min(paragraphs[i], 4), min(runs[i], 6)), _of_shape)
            edges.append(3 if tag in LANDMARKS else 2 if names else 4 if tag in LEAVES else 1)
        else:
            text = page.texts[i]
            stops = sum(map(text.count, ".!?,;"))
            words = text[:4000].split(" ")
            digits = _share(sum(map(str.isdigit, text[:200])), min(len(text), 200))
            f = _slots(("run", size, link, above, _share(100 * stops, 16 * len(text)), min(stops, 3), min(len(words).bit_length(), 6), 5 * before[i] // max(total, 1), digits), _of_run)
            if len(words) <= 4:
                f = f + _slots(("words", *[w[:24].lower().strip(".,:!?") for w in words]), _of_words)
            if text[0] in "©|»":
                f = f + _slots(("words", text[0]), _of_words)
            edges.append(0)
        out.append(f)
    return out, edges


class Forest:
    """Many pages as arrays."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        slots, owners, parents, depths, edges, starts = [], [], [], [], [], [0]
        for page in pages:
            at = starts[-1]
            each, kinds = features(page)
            for i, f in enumerate(each):
                slots += f
                owners += [at + i] * len(f)
            parents += [p + at if p >= 0 else -1 for p in page.parents]
            depths += page.depths
            edges += kinds
            starts.append(at + len(each))
        self.starts, self.n = np.array(starts), starts[-1]
        self.slots, self.owners = np.array(slots, np.int64), np.array(owners, np.int64)
        self.parents, self.edges = np.array(parents, np.int64), np.array(edges, np.int64)
        depth = np.array(depths, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of main text of each node, joint one of each edge ``[parent, child]``, and the log partition sum."""
        up, down = np.zeros((self.n, 2)), np.zeros((self.n, 2))
        up[:, 1] = np.bincount(self.owners, unary[self.slots], self.n)
        message, joint = np.zeros((self.n, 2)), np.zeros((self.n, 2, 2))
        for level in self.levels[:0:-1]:
            message[level] = np.logaddexp(*(pair[self.edges[level], :, c] + up[level, c, None] for c in (0, 1)))
            for side in (0, 1):
                up[:, side] += np.bincount(self.parents[level], message[level, side], self.n)
        for level in self.levels[1:]:
            above = self.parents[level]
            rest = up[above] - message[level] + down[above]
            down[level] = np.logaddexp(*(pair[self.edges[level], p, :] + rest[:, p, None] for p in (0, 1)))
            joint[level] = rest[:, :, None] + pair[self.edges[level]] + up[level][:, None, :]
        belief = up + down
        norm = np.logaddexp(belief[:, 0], belief[:, 1])
        inner = self.parents >= 0
        joint[inner] = np.exp(joint[inner] - norm[inner, None, None])
        return np.exp(belief[:, 1] - norm), joint, float(norm[~inner].sum())


def fit(pages: list[Page], labels: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the edges, by Adam on the exact log-likelihood."""
    forest, y = Forest(pages), np.array([x for each in labels for x in each], np.int64)
    weight = np.zeros(WIDTH + EDGES * 4)
    inner = forest.parents >= 0
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edges[inner], y[forest.parents[inner]], y[inner]), 1)
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, STEPS + 1):
        p, joint, _ = forest.marginals(weight[:WIDTH], weight[WIDTH:].reshape(EDGES, 2, 2))
        expected = np.zeros((EDGES, 2, 2))
        for e in range(EDGES):
            expected[e] = joint[inner & (forest.edges == e)].sum(0)
        slope = np.concatenate([np.bincount(forest.slots, (y - p)[forest.owners], WIDTH), (seen - expected).ravel()]) / max(forest.n, 1) - PENALTY * weight
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weight += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return weight[:WIDTH], weight[WIDTH:].reshape(EDGES, 2, 2)


_OUTER = {"nav": 0, "aside": 0, "footer": 0, "header": 0, "form": 0, "article": 1}


def own_labels(page: Page) -> list[int] | None:
    """Labels of a page that marks its text itself: one ``article``, and no named part inside it is known to hold other things."""
    if page.tags.count("article") != 1:
        return None
    out = [0] * len(page.tags)
    for i in range(1, len(out)):
        tag, held = page.tags[i], out[page.parents[i]]
        out[i] = _OUTER.get(tag, held) if tag != "header" or not held else held
        if held and page.texts[i] is None and page.names[i] and tag != "article":
            return None
    return out


def marked_labels(page: Page) -> list[int]:
    out = [0] * len(page.tags)
    for i in range(1, len(out)):
        out[i] = out[page.parents[i]] if page.marks[i] is None else int(page.marks[i])
    return out


def training_set(sources: list[str], seed: int = 0, layouts: int = LAYOUTS) -> tuple[list[Page], list[list[int]]]:
    """Labelled pages from page sources: those that mark their text, and new layouts of their blocks."""
    pages, labels, texts, prose, short = [], [], [], [], []
    for source in sources:
        page = parse(source)
        own = own_labels(page)
        if own is None:
            continue
        pages.append(page)
        labels.append(own)
        texts.append([t for t, y in zip(page.texts, own, strict=True) if y and t])
        prose += [t for t in texts[-1] if len(t) > 60][:4]
        short += [t for t, y in zip(page.texts, own, strict=True) if t and not y and len(t) < 40][:8]
    rng = random.Random(seed)
    layout = Layout(rng, prose, short)
    for blocks in (texts or [layout.prose]):
        for _ in range(layouts if texts else 600):
            chosen = [b[:2000] for b in rng.sample(blocks, rng.randint(1, min(len(blocks), 12)))] if blocks else layout.prose[:1]
            if rng.random() < 0.08:  # a text may be very short
                chosen = [" ".join(b.split(" ")[:rng.randint(1, 4)]) for b in chosen[:2]]
            page = parse(layout.page(chosen))
            pages.append(page)
            labels.append(marked_labels(page))
    return pages, labels


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """The model, fitted in one task on ``most`` pages of the table, the first by the hash of their source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = sorted(s for batch in batches for s in batch.column(0).to_pylist())
        unary, pair = fit(*training_set(sources))
        yield pa.RecordBatch.from_arrays([pa.array([unary.tobytes()]), pa.array([pair.tobytes()])], ["unary", "pair"])

    short = pages.select("html", F.xxhash64("html").alias("h")).filter(F.length("html").between(200, 100_000))
    first = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(most).collect()]  # numbers only, at most ``most``
    sample = short.filter(F.col("h").isin(first)).groupBy("h").agg(F.min("html").alias("html")).select("html")
    row = sample.coalesce(1).mapInArrow(run, "unary binary, pair binary").first()
    if row is None:  # no page was in the sample's partition
        unary, pair = fit(*training_set([]))
        return unary, pair
    return np.frombuffer(row[0]), np.frombuffer(row[1]).reshape(EDGES, 2, 2)


def main_texts(sources: list[str], unary: np.ndarray, pair: np.ndarray, limit: float = 0.5) -> list[str]:
    """Main text of each page: its chosen runs, joined by an empty line."""
    out: list[str] = []
    at = 0
    while at < len(sources):
        to, size = at, 0
        while to < len(sources) and (to == at or size + len(sources[to]) <= TOGETHER):
            size += len(sources[to])
            to += 1
        forest = Forest([parse(s) for s in sources[at:to]])
        p, _, _ = forest.marginals(unary, pair)
        for page, a in zip(forest.pages, forest.starts, strict=False):
            out.append("\n\n".join(t for i, t in enumerate(page.texts) if t and p[a + i] > limit))
        at = to
    return out


def extracted(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``: main text of the whole ``html``.

    A null or empty html, or one without main text, gives an empty text. Repeated rows give a row each; ids and urls may be null; other columns
    are not read. An empty table gives none. Equal rows give equal texts whatever else is in the table, given the model.
    """
    unary, pair = model if model is not None else train(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts([s or "" for s in batch.column(2).to_pylist()], unary, pair)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")

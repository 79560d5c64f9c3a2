"""Main text of web pages: boosted trees score DOM nodes, a decoding over the tree picks consistent ones.

Each page becomes a tree of its block elements and of the elements with a class,
id or role; other inline elements belong to the node around them. A node's
features are its own and its subtree's text, density, share of link text,
attribute tokens, tag, depth and sibling statistics. The trees are fitted on
the nodes of a bounded sample of pages, labelled by what HTML says of its own
parts (``article`` and ``main`` against ``nav``, ``footer``, forms and nodes
named as adverts). Versions of the sample pages with other markup for the same
parts, and all of it again without tag features, let the other features learn.

Decoding takes the set of nodes with the largest total score, weighted by text,
in which no node is kept below one that is dropped.

Null, empty and text-free html give an empty text. Broken markup is closed as
browsers do. Nothing is cut from what is kept.
"""

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.boosting import Trees, fit_trees
from lexmill.llm.texts import slices

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea svg select title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("html body table td th ul ol dl article section main div aside nav header footer form button".split())
GROUPS = {
    "article": "article main", "nav": "nav menu", "header": "header", "footer": "footer address", "aside": "aside dialog", "form": "form fieldset button input label",
    "head": "head title", "section": "section div body", "p": "p blockquote pre", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol li dl dt dd", "table": "table tbody tr td th",
}
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS.values()) for tag in tags.split()}
GOOD_TOKENS = frozenset("article body content entry main post story text".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form header legal login masthead menu meta modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar warning widget alert".split()
)
BAD_GROUPS = [GROUP_OF[t] for t in ("nav", "header", "footer", "aside", "form", "head")]

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PARTS = re.compile(r"[a-zA-Z]+")
N_FEATURES = 16 + 3 * len(GROUPS)
TAG_FEATURES = slice(16, N_FEATURES)


class Page:
    """A page's nodes in the order in which they open, so that parents come before children, and its text runs."""

    def __init__(self, source: str):
        self.tags, self.parent, self.good, self.bad = ["#root"], [-1], [0], [0]
        self.runs: list[tuple[int, str, bool]] = []  # node, text, in a link
        self._parse(source)

    def _open(self, tag: str, attributes: str, above: int) -> int:
        tokens = [t.lower() for value in NAMED.findall(attributes) for t in PARTS.findall(value)] if attributes.strip() else []
        self.tags.append(tag)
        self.parent.append(above)
        self.good.append(sum(t in GOOD_TOKENS for t in tokens))
        self.bad.append(sum(t in BAD_TOKENS for t in tokens))
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        stack = [("#root", 0)]  # tag, its node (that around it for inline elements)
        links = at = 0
        size = len(source)
        while at < size:
            found = TOKEN.search(source, at)
            to = found.start() if found else size
            if to > at:
                self.runs.append((stack[-1][1], html.unescape(source[at:to]), links > 0))
            if not found:
                break
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                links = self._close(stack, tag, links)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if tag in VOID:
                self.runs.append((stack[-1][1], " ", False))
                continue
            if tag in ENDS_P:
                links = self._imply(stack, frozenset(["p"]), links)
            if tag in CLOSED_BY:
                links = self._imply(stack, CLOSED_BY[tag], links)
            block = tag not in INLINE
            node = stack[-1][1]
            if block or NAMED.search(found[3]):
                node = self._open(tag, found[3], node)
            if block:
                self.runs.append((node, " ", False))
            if not found[3].rstrip().endswith("/"):
                stack.append((tag, node))
                links += tag == "a"

    def _pop(self, stack: list[tuple[str, int]], links: int) -> int:
        tag, node = stack.pop()
        if tag not in INLINE:
            self.runs.append((node, " ", False))
            self.runs.append((stack[-1][1], " ", False))
        return links - (tag == "a")

    def _close(self, stack: list[tuple[str, int]], tag: str, links: int) -> int:
        if any(t == tag for t, _ in stack[1:]):
            while stack[-1][0] != tag:
                links = self._pop(stack, links)
            return self._pop(stack, links)
        return links

    def _imply(self, stack: list[tuple[str, int]], tags: frozenset[str], links: int) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    links = self._pop(stack, links)
                break
            if stack[i][0] in SCOPES and stack[i][0] not in tags:
                break
        return links

    def measures(self) -> list[tuple]:
        """A row of raw measures per node: see ``features``."""
        n, parent = len(self.tags), self.parent
        own, link, words, marks, first = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        seen = 0
        for node, text, linked in self.runs:
            if text == " ":
                continue
            blanks = text.count(" ")
            size = len(text) - blanks
            if not own[node]:
                first[node] = seen
            own[node] += size
            if linked:
                link[node] += size
            words[node] += blanks + 1
            marks[node] += text.count(".") + text.count(",")
            seen += size
        group = [GROUP_OF.get(t, -1) for t in self.tags]
        sub, sub_link, below, kids, listed, holds = own.copy(), link.copy(), [0] * n, [0] * n, [g == GROUP_OF["li"] for g in group], [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            sub[p] += sub[i]
            sub_link[p] += sub_link[i]
            below[p] += below[i] + 1
            kids[p] += 1
            listed[p] += listed[i]
            holds[p] |= holds[i] | (1 << group[i] if group[i] >= 0 else 0)
        depth, good_above, bad_above, above = [0] * n, [0] * n, [0] * n, [0] * n
        alike: dict[tuple[int, int], list[int]] = {}
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            good_above[i], bad_above[i] = good_above[p] + self.good[p], bad_above[p] + self.bad[p]
            above[i] = above[p] | (1 << group[p] if group[p] >= 0 else 0)
            same = alike.setdefault((p, group[i]), [0, 0])
            same[0] += 1
            same[1] += sub[i]
        total = max(sub[0], 1)
        rows = []
        for i in range(n):
            p = max(parent[i], 0)
            same = alike.get((p, group[i]), (1, sub[i])) if i else (1, sub[0])
            rows.append((own[i], sub[i], sub[i] / (below[i] + 1), kids[i], kids[p], sub_link[i] / max(sub[i], 1), depth[i], same[0] / max(kids[p], 1), same[1] / max(sub[p], 1), first[i] / total, marks[i] / max(words[i], 1), listed[i] / (below[i] + 1), self.good[i], self.bad[i], good_above[i], bad_above[i], 1 << group[i] if group[i] >= 0 else 0, above[i], holds[i]))
        return rows

    def weak_labels(self) -> np.ndarray:
        """1, 0, or -1 where HTML says nothing."""
        labels = np.full(len(self.tags), -1)
        for i in range(1, len(self.tags)):
            group = GROUP_OF.get(self.tags[i], -1)
            if labels[self.parent[i]] == 0 or group in BAD_GROUPS or self.bad[i]:
                labels[i] = 0
            elif labels[self.parent[i]] == 1 or group == GROUP_OF["article"] or self.good[i]:
                labels[i] = 1
        return labels

    def text(self, scores: np.ndarray, own: np.ndarray) -> str:
        """The text of the best consistent choice of nodes."""
        n = len(self.tags)
        gain = (scores * np.log1p(own)).tolist()
        for i in range(n - 1, 0, -1):
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        keep = [False] * n
        keep[0] = gain[0] > 0
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and gain[i] > 0
        return " ".join("".join(text if keep[node] else " " for node, text, _ in self.runs).split())


def features(measures: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features per node, and the characters of text in the node itself; sizes count as logarithms."""
    table = np.array(measures, np.float64).reshape(-1, 19)
    own = table[:, 0].copy()
    table[:, :5] = np.log1p(table[:, :5])
    bits = table[:, 16:].astype(np.int64)[:, :, None] >> np.arange(len(GROUPS)) & 1
    return np.concatenate([table[:, :16], bits.reshape(len(table), -1)], axis=1), own


def variants(source: str, pick: int) -> list[tuple[str, int]]:
    """The page, and versions of it that say the same with other markup: named containers, asides in the article, the article alone.

    With each goes the label of nodes of which HTML says nothing.
    """
    found = re.search(r"<article[^>]*>(.*)</article>", source, re.S | re.I)
    if not found:
        return [(source, -1)]
    good, bad = sorted(GOOD_TOKENS), sorted(BAD_TOKENS)
    inside = re.findall(r"<p>([^<]{20,300})", found[1])
    remarks = "".join(f"<p>{t}</p>" for t in inside[: 1 + pick % 3])
    named = f'<section class="{bad[pick % len(bad)]}">{remarks}</section>'
    tag = ("aside", "header", "form", "footer", "nav")[pick % 5]
    noted = (f"<{tag}>{remarks}</{tag}>{found[1]}" if tag == "header" else f"{found[1]}<{tag}>{remarks}</{tag}>") + named
    start, end = source[: found.start()], source[found.end() :]
    outer = [re.sub(r"<(?:nav|footer)\b", f'<div class="{bad[(pick + 7) % len(bad)]}"', re.sub(r"</(?:nav|footer)\b", "</div", part)) for part in (start, end)]
    return [
        (source, -1),
        (f"{start}<article>{noted}</article>{end}", -1),
        (f'{outer[0]}<div class="{good[pick % len(good)]}">{noted}</div>{outer[1]}', -1),
        (f"<html><body>{found[1]}</body></html>" if pick % 2 else found[1], 1),
        (re.sub(r"<[^>]*>", " ", found[1]), 1),
    ]


def fit(pages: DataFrame, *, key: str = "page_id", source: str = "html", sample_pages: int = 120, sample_nodes: int = 20_000) -> Trees:
    """Fit on at most ``sample_nodes`` labelled nodes of at most ``sample_pages`` pages, drawn by hash of the key."""
    ids = [r["k"] for r in pages.where(F.col(source).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(sample_pages).collect()]
    if not ids:
        return fit_trees(np.zeros((0, N_FEATURES)), np.zeros(0))
    chosen = pages.where(F.col(key).isin(ids)).select(F.col(key).alias("k"), F.col(source).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, source in zip(batch.column("k").to_pylist(), batch.column("source").to_pylist(), strict=True):
                made = []
                for text, otherwise in variants(source, key % 997):
                    page = Page(text)
                    labels = page.weak_labels()
                    labels[labels < 0] = otherwise
                    rows, own = features(page.measures())
                    some = np.flatnonzero(labels >= 0)
                    made.append(np.concatenate([labels[some, None], own[some, None], rows[some]], axis=1))
                made = np.concatenate(made).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(made), pa.int64()), pa.array(range(len(made)), pa.int64()), pa.array([r.tobytes() for r in made], pa.binary())], ["k", "node", "row"])

    rows = chosen.withColumn("k", F.xxhash64("k")).mapInArrow(run, "k long, node long, row binary").orderBy("k", "node", "row").limit(sample_nodes).collect()
    if not rows:
        return fit_trees(np.zeros((0, N_FEATURES)), np.zeros(0))
    table = np.array([np.frombuffer(r["row"], np.float32) for r in rows]).astype(np.float64)
    labels, own, full = table[:, 0], table[:, 1], table[:, 2:]
    bare = full.copy()
    bare[:, TAG_FEATURES] = 0
    weights = 0.1 + np.log1p(own)
    return fit_trees(np.concatenate([full, bare]), np.concatenate([labels, labels]), np.concatenate([2 * weights, weights]))


def extract(df: DataFrame, model: Trees, source: str = "html") -> DataFrame:
    """Replace ``source`` by ``text``, the main text, and ``n_chars``, its code points; narrow."""
    kept = [c for c in df.columns if c not in (source, "text", "n_chars")]
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                pages = [Page(x or "") for x in part.column(source).to_pylist()]
                measured = [p.measures() for p in pages]
                rows, own = features([row for m in measured for row in m])
                scores = shared.value.score(rows)
                texts, at = [], 0
                for page, m in zip(pages, measured, strict=True):
                    texts.append(page.text(scores[at : at + len(m)], own[at : at + len(m)]))
                    at += len(m)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return df.mapInArrow(run, schema)

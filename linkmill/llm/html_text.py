"""HTML extraction: the article's text, chosen by a linear-chain conditional random field over a page's text blocks."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_pages

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:[\s=>]|\Z)|display\s*:\s*none""", re.I)
_ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
# Tag names of the HTML standard by how they shape text.
RAW = {"script", "style", "textarea", "title", "iframe"}
DROPPED = {"template", "noscript", "svg", "object", "canvas", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
#: In place of the names of a hidden or dropped element, which ends where its end tag or the parser closes it.
HIDDEN = ("hidden",)
#: Dropped elements that cannot hold other blocks, so that the start of one ends them.
SHALLOW = {"svg", "select"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def is_hidden(attributes: str) -> bool:
    """Whether a start tag has the attribute ``hidden`` or a style without display; other attributes' values don't count."""
    if not _HIDDEN.search(attributes):
        return False
    return any(name.lower() == "hidden" or name.lower() == "style" and _NO_DISPLAY.search(value) for name, value in _ATTRIBUTES.findall(attributes))


def blocks(html: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """Leaf text blocks of a page in order: text, ancestors (as ``tag`` and ``.name`` of class, id or role), share of link text.

    Inline markup and ``br`` don't end a block; any other tag does. Comments, hidden parts and the contents of scripts,
    styles and the like are left out. Unclosed and stray tags are tolerated: a hidden or dropped element ends with its end
    tag, with that of its parent, or where HTML implies its end; only raw text (scripts, styles) may run to the end of the page.
    """
    html = html or ""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                path = tuple(x for tag, names in stack if tag not in INLINE or names for x in (tag, *names))
                out.append((text, path, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        begin = m.start() if m else size
        if begin > at and not any(names is HIDDEN for _, names in stack):
            parts.append(html[at:begin])
            if links:
                linked += begin - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    links = 0
                    break
            continue
        hidden = is_hidden(m[3])
        if hidden and (tag in VOID or m[3].endswith("/")):
            continue
        if tag in RAW or tag == "head":
            flush()
            if not m[3].endswith("/"):
                at = _head_end(html, at) if tag == "head" else _raw_end(html, at, tag)
            continue
        if tag in DROPPED:
            if m[3].endswith("/"):
                continue
            hidden = True
        if tag not in INLINE:
            flush()
            if tag in VOID:
                continue
            if tag in BLOCKS:
                for k, (t, _) in enumerate(stack):
                    if t in SHALLOW:  # the parser leaves it for a block
                        del stack[k:]
                        break
            shut = CLOSES.get(tag, ()) if tag in CLOSES else {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    links = 0
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ("p", "td", "th"):
                    break
        elif tag == "br":
            parts.append(" ")
            continue
        elif tag in VOID:
            continue
        if tag == "a":
            links += 1
        names = tuple(f".{t}" for a in _NAMES.findall(m[3]) for t in "".join(a).lower().split()) if m[3] else ()
        stack.append((tag, HIDDEN if hidden else names))
    flush()
    return out


def _raw_end(html: str, at: int, tag: str) -> int:
    """Behind the first end tag of raw text, which holds no markup."""
    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
    return end.end() if end else len(html)


def _head_end(html: str, at: int) -> int:
    """Behind ``</head>``, or at the body; a head with neither is read on, as its own elements are dropped by their tags."""
    end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(html, at)
    return at if not end else end.end() if end[0][1] == "/" else end.start()


def _level(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def path_features(path: tuple[str, ...]) -> list[str]:
    out = {f"in:{x}" for x in path}
    out |= {f"part:{w}" for x in path if x[0] == "." for w in re.split(r"[^a-z]+", x) if w}
    tags = [x for x in path if x[0] != "."]
    return [*out, "tag:" + (tags[-1] if tags else ""), "two:" + "/".join(tags[-2:])]


def text_features(text: str, link: float) -> list[str]:
    n = text.count(" ") + 1
    out = [f"words:{_level(n, (2, 3, 5, 10, 20, 50))}", f"link:{_level(link, (0.01, 0.3, 0.8))}", f"stop:{text[-1] in '.!?:;\"'}"]
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    return out


class Crf:
    """Two states (article or not) in a chain; weights by feature and state, and by pairs of states."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, pairs: np.ndarray, ends: np.ndarray):
        self.index, self.pairs, self.ends = features, pairs.tolist(), ends.tolist()
        self.gain = (weights[:, 1] - weights[:, 0]).tolist()  # in a two-state chain only the difference matters
        self.paths: dict[tuple[str, ...], float] = {}

    def __getstate__(self):
        return self.__dict__ | {"paths": {}}

    def gains(self, page: list[tuple[str, tuple[str, ...], float]]) -> list[float]:
        out = []
        for text, path, link in page:
            known = self.paths.get(path)
            if known is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                known = self.paths[path] = sum(self.gain[self.index[f]] for f in path_features(path) if f in self.index)
            out.append(known + sum(self.gain[self.index[f]] for f in text_features(text, link) if f in self.index))
        return out

    def decode(self, page: list[tuple[str, tuple[str, ...], float]]) -> list[bool]:
        """The likeliest states of a page's blocks (Viterbi)."""
        gains = self.gains(page)
        if not gains:
            return []
        (a, b), (c, d) = self.pairs
        no, yes = self.ends[0], self.ends[1] + gains[0]
        back = []
        for g in gains[1:]:
            from_no, from_yes = no + a >= yes + c, no + b > yes + d
            back.append((not from_no, not from_yes))
            no, yes = (no + a if from_no else yes + c), (no + b if from_yes else yes + d) + g
        state = yes > no
        out = [state]
        for to_no, to_yes in reversed(back):
            state = to_yes if state else to_no
            out.append(state)
        return out[::-1]


def train(n_pages: int = 500, rounds: int = 120, l2: float = 1e-3, rate: float = 0.1, seed: int = 5) -> Crf:
    """Fits the field to ``n_pages`` labelled pages by the gradient of its likelihood (forward-backward, Adam)."""
    pages = []
    for html, labels in labelled_pages(n_pages, seed):
        found = blocks(html)
        if [b[0] for b in found] == [unescape(t) for t, _ in labels]:
            pages.append((found, [int(y) for _, y in labels]))
    features: dict[str, int] = {}
    longest = max(len(f) for f, _ in pages)
    row, column = [], []
    states = np.full((len(pages), longest), -1)
    for p, (found, labels) in enumerate(pages):
        states[p, : len(labels)] = labels
        for t, (text, path, link) in enumerate(found):
            for f in path_features(path) + text_features(text, link):
                row.append(p * longest + t)
                column.append(features.setdefault(f, len(features)))
    row, column = np.array(row), np.array(column)
    here = states >= 0
    gold = np.zeros((*states.shape, 2))
    gold[here, states[here]] = 1
    pair_gold = np.array([[((states[:, :-1] == i) & (states[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    n = len(features)
    theta = np.zeros(2 * n + 6)
    m = v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, pairs, ends = theta[: 2 * n].reshape(n, 2), theta[2 * n : 2 * n + 4].reshape(2, 2), theta[2 * n + 4 :]
        emit = np.stack([np.bincount(row, w[column, s], minlength=here.size) for s in (0, 1)], -1).reshape(*states.shape, 2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + ends
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + pairs, axis=1) + emit[:, t]
            forward[:, t] = np.where(here[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(pairs + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(here[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        marginal = np.exp(forward + backward - total[:, None, None]) * here[..., None]
        joint = np.exp(forward[:, :-1, :, None] + pairs + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * here[:, 1:, None, None]
        miss = (gold - marginal).reshape(-1, 2)
        grad = np.concatenate([np.stack([np.bincount(column, miss[row, s], minlength=n) for s in (0, 1)], -1).ravel(), (pair_gold - joint.sum((0, 1))).ravel(), (gold[:, 0] - marginal[:, 0]).sum(0)]) / len(pages) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(features, theta[: 2 * n].reshape(n, 2), theta[2 * n : 2 * n + 4].reshape(2, 2), theta[2 * n + 4 :])


def main_text(html: str | None, crf: Crf) -> str:
    page = blocks(html)
    return "\n".join(b[0] for b, keep in zip(page, crf.decode(page), strict=True) if keep)


def html_text(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    The text is that of the blocks which the field marks as article, in page order, joined by a line feed. It is empty if
    there are none, also for null and empty html. The field is trained on a fixed number of generated, labelled pages
    (:mod:`.html_pages`), so its cost does not depend on the input. Repeated rows get the same result; an empty table gives
    an empty one.
    """
    crf = crf or train()

    def per_batch(batches):
        for b in batches:
            texts = [main_text(h, crf) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string"))
    return rows.mapInArrow(per_batch, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between tags that begin or end a block, with character references decoded and white space
(also no-break spaces) as one space; `br` is white space. A block is seen as its tag path (tags, class and id words of itself and its
ancestors), a vector of hashed words and a few measures (length, share of link text, punctuation, place). An LSTM reads a page's
blocks forwards, another backwards, and a block's label follows from both states, so from the whole page. Weights are learned here by
numpy, from at most MAX_PAGES pages of at most MAX_CHARS characters whose markup says what is what (article or main against nav, footer and
the like), as they are and redrawn: the same texts in other containers, with named, unnamed and misleading ones, and with headers,
notices, adverts, forms, sidebars and reader comments around and between them.

Cases: a null or empty page has no blocks and gives an empty text; scripts, styles, comments, titles and form fields are no blocks;
markup that is cut off or unclosed is read as far as it goes; repeated rows are labelled alike; pages are whole, however long, and a
page's label does not depend on its neighbours in the table; a table without labelled pages is labelled by a model of made texts.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Block

#: Pages that the model is fitted on (those of the smallest hash), and their characters, at most.
MAX_PAGES = 256
MAX_CHARS = 30_000
MAX_BLOCKS = 80
HIDDEN = 24
WORD_BINS = 64
STEPS = 360
#: Cells (pages x blocks) that the labeller holds at once, unless one page has more.
CELLS = 1 << 14

# Elements of HTML by their kind.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page.
RAW_TAGS = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "object")
#: An element of the first kind is ended by a start of one of these.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "head": {"body"},
}
#: Elements that an end or an implied end does not look past.
SCOPES = frozenset("table ul ol dl article section div nav footer header aside main body html form".split())
#: Tags and names of containers of the main text, and of others by their kind.
MAIN_TAGS = ("article", "main")
OTHER_TAGS = ("nav", "footer", "aside", "form")
MAIN_NAMES = "article content main post entry story body text page blog news single detail".split()
OTHER_NAMES = {
    "header": "header masthead top banner logo site brand tagline".split(),
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs toc links topics".split(),
    "notice": "notice cookie cookies consent gdpr alert message warning popup modal overlay privacy".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner commercial".split(),
    "form": "form search login signup subscribe newsletter register contact".split(),
    "aside": "sidebar side aside widget related recommended popular trending teaser more share social tags author bio".split(),
    "comments": "comment comments reply replies discussion disqus respond feedback reader readers thread".split(),
    "footer": "footer bottom copyright legal imprint colophon credits".split(),
}
NEUTRAL_NAMES = "wrap wrapper inner outer container row col box block section grid item left right center".split()

_RAW = "|".join(RAW_TAGS)
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-z/!?][^>]*(?:>|\Z)", re.I | re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

Leaf = tuple[tuple[str, ...], str, float]


@lru_cache(1 << 14)
def _opened(tag: str, attributes: str) -> tuple[str, ...]:
    """Marks of an element: its tag and the words of its class, id and role."""
    words = [w.lower() for m in _NAMES.finditer(attributes) for part in m.groups() if part for w in _PARTS.findall(part)]
    return (tag, *(f".{w}" for w in dict.fromkeys(words)))


def leaves(page: str | None) -> list[Leaf]:
    """The blocks of a page in order: marks of the path (the last element's first), text, and the share of its text in links."""
    page = page or ""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = open_links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            path = tuple(dict.fromkeys([f"={next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), '')}", *(m for _, marks in reversed(stack) for m in marks)]))
            out.append((path, text, min(1.0, links / len(text))))
        parts.clear()
        links = 0

    def close(tags: set[str], scopes: frozenset[str]) -> None:
        nonlocal open_links
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                open_links -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in scopes:
                return

    def text(lo: int, hi: int) -> None:
        nonlocal links
        if hi > lo:
            said = html.unescape(page[lo:hi])
            parts.append(said)
            links += len(said.strip()) if open_links else 0

    at = 0
    for m in _TOKEN.finditer(page):
        text(at, m.start())
        at = m.end()
        raw, end, tag, attributes = m.groups()
        if tag is None:
            if raw and raw.lower() == "textarea":
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if end:
            if tag != "br":
                close({tag}, SCOPES - {tag} if tag not in SCOPES else frozenset())
            continue
        if tag in BLOCK_TAGS:
            close({"p"}, SCOPES)
        for open_tag, by in ENDED_BY.items():
            if tag in by:
                close({open_tag}, SCOPES)
        if tag == "a" and open_links:
            close({"a"}, SCOPES)
        if tag not in VOID_TAGS:
            stack.append((tag, _opened(tag, attributes)))
            open_links += tag == "a"
    text(at, len(page))
    flush()
    return out


def told(path: tuple[str, ...]) -> int | None:
    """What markup says of a block: 1 for main text, 0 for other, None if neither or both."""
    other = any(t in path for t in OTHER_TAGS) or any(f".{n}" in path for kind in OTHER_NAMES.values() for n in kind)
    main = any(t in path for t in MAIN_TAGS)
    return None if main == other else int(main)


class Redrawer:
    """Makes pages of known labels out of texts of main and other blocks."""

    def __init__(self, main: list[list[str]], other: list[str], seed: int = 5) -> None:
        self.rng = np.random.default_rng(seed)
        made = lambda n: " ".join("".join(self.rng.choice(list("aeioulnrst"), self.rng.integers(2, 9))) for _ in range(n)).capitalize() + "."
        self.main = main or [[made(int(n)) for n in self.rng.integers(4, 60, 8)] for _ in range(20)]
        self.other = other or [made(int(n)) for n in self.rng.integers(1, 9, 40)]

    def _pick(self, of) -> str:
        return of[int(self.rng.integers(len(of)))]

    def _chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def _box(self, tags: str, names: list[str], named: float) -> tuple[str, ...]:
        """Marks of a container: its tag, maybe names of its kind, maybe neutral ones."""
        out = [self._pick(tags.split())]
        if out[0] in ("div", "section", "ul", "ol") or self._chance(0.4):
            out += [f".{self._pick(names)}"] if self._chance(named) else []
            out += [f".{self._pick(NEUTRAL_NAMES)}"] if self._chance(0.4) else []
        return tuple(out)

    def _leaf(self, tag: str, text: str, inside: Iterable[tuple[str, ...]], links: float, label: int) -> tuple[tuple[str, ...], str, float, int]:
        marks = [m for box in reversed([("html",), ("body",), *inside]) for m in box]
        return tuple(dict.fromkeys([f"={tag}", tag, *marks])), text, links, label

    def _short(self) -> str:
        text = self._pick(self.other) if self._chance(0.7) else self._pick(self._pick(self.main))
        words = text.split()
        return " ".join(words[: int(self.rng.integers(1, 12))]) or "x"

    def _region(self, kind: str, inside: list[tuple[str, ...]]) -> list:
        tags = {"header": "header header div", "nav": "nav nav div ul", "notice": "div div section dialog", "ad": "div div aside", "form": "form form div", "aside": "aside div section", "comments": "div section ol ul", "footer": "footer footer div"}[kind]
        box = self._box(tags, OTHER_NAMES[kind], 0.9 if kind in ("comments", "ad", "aside", "notice") else 0.7)
        at = [*inside, box]
        leaf = self._leaf
        if kind == "nav":
            return [leaf("li" if self._chance(0.8) else "div", " ".join(self._short().split()[:3]), at, 1.0, 0) for _ in range(self.rng.integers(2, 12))]
        if kind == "header":
            return [leaf(self._pick(("div", "h1", "p", "span")), self._short(), at, float(self._chance(0.4)), 0) for _ in range(self.rng.integers(1, 3))]
        if kind == "form":
            return [leaf(self._pick(("div", "p", "label", "form")), self._short(), at, 0.0, 0) for _ in range(self.rng.integers(1, 5))]
        if kind == "aside":
            out = [leaf(self._pick(("h2", "h3", "h4")), self._short(), at, 0.0, 0)] if self._chance(0.6) else []
            return out + [leaf(self._pick(("li", "li", "p", "div")), self._short() if self._chance(0.7) else self._pick(self._pick(self.main)), at, self._pick((1.0, 1.0, 0.0)), 0) for _ in range(self.rng.integers(1, 8))]
        if kind == "comments":
            out = [leaf(self._pick(("h2", "h3")), self._short(), at, 0.0, 0)] if self._chance(0.6) else []
            for _ in range(self.rng.integers(1, 8)):
                one = self._box("div li article", OTHER_NAMES["comments"], 0.7)
                out += [leaf("div", self._short(), [*at, one], self._pick((0.0, 1.0)), 0)] if self._chance(0.4) else []
                out.append(leaf(self._pick(("p", "p", "div")), self._pick(self._pick(self.main)), [*at, one], 0.0, 0))
            return out
        if kind == "footer":
            return [leaf(self._pick(("footer", "p", "div", "li")) if box[0] == "footer" else self._pick(("p", "div", "li")), ("© " if self._chance(0.4) else "") + self._short(), at, self._pick((0.0, 0.0, 1.0)), 0) for _ in range(self.rng.integers(1, 5))]
        return [leaf(self._pick(("p", "div", "div")), self._short() if self._chance(0.6) else self._pick(self._pick(self.main)), at, self._pick((0.0, 0.0, 1.0)), 0) for _ in range(self.rng.integers(1, 3))]

    def page(self) -> list[tuple[tuple[str, ...], str, float, int]]:
        outer = [self._box("div section", NEUTRAL_NAMES, 0.5)] if self._chance(0.4) else []
        out: list = []
        for kind, p in (("header", 0.5), ("nav", 0.8), ("notice", 0.25), ("ad", 0.4), ("form", 0.2), ("aside", 0.15)):
            if self._chance(p):
                out += self._region(kind, outer if self._chance(0.5) else [])
        box = [*outer, self._box("article article main div section", MAIN_NAMES, 0.7)]
        box += [self._box("article div section", MAIN_NAMES, 0.6)] if self._chance(0.3) else []
        texts = self._pick(self.main)[: MAX_BLOCKS // 2]
        head = [*box, ("header",)] if self._chance(0.25) else box
        out += [self._leaf("h1", texts[0], head, 0.0, 1)] if self._chance(0.8) else []
        for text in texts[1:]:
            kind, within = self._pick("p p p p p p p h2 h3 blockquote li td pre figcaption dd div".split()), box
            within = [*box, {"li": ("ul",), "td": ("table",), "figcaption": ("figure",), "dd": ("dl",)}[kind]] if kind in ("li", "td", "figcaption", "dd") else box
            text = " ".join(text.split()[: int(self.rng.integers(2, 9))]) if kind in ("h2", "h3", "figcaption") or self._chance(0.1) else text
            out.append(self._leaf(kind, text, within, float(self.rng.random() * 0.4) if self._chance(0.2) else 0.0, 1))
            if self._chance(0.06):
                out += self._region(self._pick(("ad", "aside", "notice", "form")), box)
        if self._chance(0.2):
            out += self._region("comments", box)
        for kind, p in (("comments", 0.3), ("aside", 0.4), ("ad", 0.2), ("form", 0.15), ("nav", 0.15), ("footer", 0.85)):
            if self._chance(p):
                out += self._region(kind, outer if self._chance(0.5) else [])
        return out[:MAX_BLOCKS] if out else self.page()


def word_bins(texts: list[str]) -> np.ndarray:
    """Hashed words of each text: square roots of their shares, WORD_BINS columns."""
    block = Block(pa.record_batch([pa.array(texts, pa.large_string())], names=["t"]), "t", lower=True)
    cell = block.doc * WORD_BINS + (block.hash % np.uint64(WORD_BINS)).astype(np.int64)
    bins = np.bincount(cell, minlength=len(texts) * WORD_BINS).reshape(len(texts), WORD_BINS)
    return np.sqrt(bins / np.maximum(block.count, 1)[:, None])


def measures(leaf: list[Leaf]) -> np.ndarray:
    """Length, share of link text, punctuation, end mark, capitals, place and depth of each block of a page."""
    n = len(leaf)
    out = np.empty((n, 8))
    for i, (path, text, links) in enumerate(leaf):
        size = len(text)
        out[i] = (np.log1p(size) / 6, links, text[-1] in ".!?…\"”»", 10 * (text.count(",") + text.count(".")) / size, "©" in text, i / n, (n - i) / n, min(size, 30) / 30)
    return out


class Labeller:
    """A bidirectional LSTM over blocks; weights are a dict of arrays."""

    def __init__(self, marks: list[str], seed: int = 3) -> None:
        rng, h = np.random.default_rng(seed), HIDDEN
        self.marks = {m: i for i, m in enumerate(marks)}
        scale = lambda n, m: rng.normal(0, 1 / np.sqrt(n), (n, m))
        self.w = {}
        for d in "fb":
            self.w |= {f"path_{d}": scale(len(marks) + 1, 4 * h) * 0.5, f"words_{d}": scale(WORD_BINS, 4 * h), f"measures_{d}": scale(8, 4 * h), f"state_{d}": scale(h, 4 * h), f"bias_{d}": np.zeros(4 * h)}
            self.w[f"bias_{d}"][h : 2 * h] = 1
        self.w |= {"out": scale(2 * h, 1)[:, 0], "out_path": np.zeros(len(marks) + 1), "out_bias": np.zeros(1)}
        self._of_path: dict = {}

    def paths(self, leaf: Iterable[Leaf]) -> np.ndarray:
        """Marks of each block's path as shares of one vector; marks that the training has not seen are left out."""
        out = []
        for path, *_ in leaf:
            row = self._of_path.get(path)
            if row is None:
                row = np.zeros(len(self.marks) + 1)
                row[[self.marks[m] for m in path if m in self.marks]] = 1
                if len(self._of_path) < 1 << 14:
                    self._of_path[path] = row
            out.append(row)
        return np.array(out)

    def forward(self, path: np.ndarray, words: np.ndarray, measure: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Logits (pages x blocks), and what the gradient needs. Inputs are pages x blocks x columns; mask is 1 for blocks."""
        w, h = self.w, HIDDEN
        b, t = mask.shape
        states, kept = [], []
        for d in "fb":
            x = path @ w[f"path_{d}"] + words @ w[f"words_{d}"] + measure @ w[f"measures_{d}"] + w[f"bias_{d}"]
            s, c, all_s, trace = np.zeros((b, h)), np.zeros((b, h)), np.zeros((b, t, h)), []
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                z = x[:, i] + s @ w[f"state_{d}"]
                gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
                new = np.tanh(z[:, 3 * h :])
                m = mask[:, i, None]
                c_now = gate[:, h : 2 * h] * c + gate[:, :h] * new
                squashed = np.tanh(c_now)
                trace.append((i, s, c, gate, new, squashed))
                s, c = m * gate[:, 2 * h :] * squashed + (1 - m) * s, m * c_now + (1 - m) * c
                all_s[:, i] = s
            states.append(all_s)
            kept.append(trace)
        both = np.concatenate(states, 2)
        return both @ w["out"] + path @ w["out_path"] + w["out_bias"], [both, kept]

    def gradient(self, path: np.ndarray, words: np.ndarray, measure: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean loss of the blocks and its gradient."""
        w, h = self.w, HIDDEN
        logit, (both, kept) = self.forward(path, words, measure, mask)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        total = mask.sum()
        loss = -(mask * (label * np.log(p + 1e-12) + (1 - label) * np.log(1 - p + 1e-12))).sum() / total
        d_logit = mask * (p - label) / total
        g = {"out": np.einsum("bt,bth->h", d_logit, both), "out_path": np.einsum("bt,btp->p", d_logit, path), "out_bias": np.array([d_logit.sum()])}
        for k, d in enumerate("fb"):
            d_state = d_logit[:, :, None] * w["out"][k * h : (k + 1) * h]
            d_x = np.zeros((*mask.shape, 4 * h))
            d_rec = np.zeros_like(w[f"state_{d}"])
            d_s, d_c = np.zeros((len(mask), h)), np.zeros((len(mask), h))
            for i, s, c, gate, new, squashed in reversed(kept[k]):
                m = mask[:, i, None]
                d_s = d_s + d_state[:, i]
                now, d_out = m * d_s, gate[:, 2 * h :]
                d_cell = now * d_out * (1 - squashed**2) + m * d_c
                d_gate = np.concatenate([d_cell * new, d_cell * c, now * squashed], 1) * gate * (1 - gate)
                d_z = np.concatenate([d_gate, d_cell * gate[:, :h] * (1 - new**2)], 1)
                d_x[:, i] = d_z
                d_rec += s.T @ d_z
                d_s = d_z @ w[f"state_{d}"].T + (1 - m) * d_s
                d_c = d_cell * gate[:, h : 2 * h] + (1 - m) * d_c
            flat = d_x.reshape(-1, 4 * h)
            g |= {f"path_{d}": path.reshape(len(flat), -1).T @ flat, f"words_{d}": words.reshape(len(flat), -1).T @ flat, f"measures_{d}": measure.reshape(len(flat), -1).T @ flat, f"bias_{d}": flat.sum(0), f"state_{d}": d_rec}
        return float(loss), g

    def label(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """Whether each block of each page is main text. Pages are read together with others of like length."""
        out = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(pages[order[to]]) <= CELLS:
                to += 1
            some = [pages[i] for i in order[at:to]]
            logit, _ = self.forward(*padded(self, some))
            for i, row in zip(order[at:to], logit, strict=True):
                out[i] = row[: len(pages[i])] > 0
            at = to
        return out


def features(model: Labeller, pages: list[list[Leaf]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of path, words and measures of all blocks, page by page."""
    flat = [leaf for p in pages for leaf in p]
    return model.paths(flat), word_bins([leaf[1] for leaf in flat]), np.concatenate([measures([leaf[:3] for leaf in p]) for p in pages])


def padded(model: Labeller, pages: list[list[Leaf]], had: list[tuple[np.ndarray, ...]] | None = None) -> tuple[np.ndarray, ...]:
    """Features of pages in arrays of pages x blocks x columns, and the mask of blocks."""
    t = max(len(p) for p in pages)
    mask = (np.arange(t) < np.array([len(p) for p in pages])[:, None]).astype(float)
    had = had or [features(model, pages)]
    return *(_spread(np.concatenate([x[i] for x in had]), mask) for i in range(3)), mask


def _spread(rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.zeros((*mask.shape, rows.shape[1]))
    out[mask > 0] = rows
    return out


def fit(pages: list[str], steps: int = STEPS, batch: int = 24, rate: float = 0.01, seed: int = 11) -> Labeller:
    """A labeller from pages whose markup tells main text from other, as they are and redrawn."""
    known, main, other = [], [], []
    for page in pages:
        leaf = leaves(page)
        said = [told(path) for path, _, _ in leaf]
        if 1 in said:
            main.append([text for (_, text, _), s in zip(leaf, said, strict=True) if s == 1])
            if None not in said:
                known.append([(*x, s) for x, s in zip(leaf, said, strict=True)][:MAX_BLOCKS])
        other += [text for (_, text, _), s in zip(leaf, said, strict=True) if s == 0]
    draw, rng = Redrawer(main, other), np.random.default_rng(seed)
    drawn = [draw.page() for _ in range(900)]
    model = Labeller(sorted({m for page in [*known, *drawn] for path, *_ in page for m in path}))
    mean = {k: np.zeros_like(v) for k, v in model.w.items()}
    square = {k: np.zeros_like(v) for k, v in model.w.items()}
    known, drawn = ([(p, features(model, [p])) for p in some] for some in (known, drawn))
    for step in range(1, steps + 1):
        some = [known[int(rng.integers(len(known)))] if known and rng.random() < 0.3 else drawn[int(rng.integers(len(drawn)))] for _ in range(batch)]
        path, words, measure, mask = padded(model, [p for p, _ in some], [x for _, x in some])
        label = _spread(np.array([[x[3]] for p, _ in some for x in p], float), mask)[:, :, 0]
        path = path * (rng.random(path.shape) > 0.1)  # marks that are now and then not seen
        _, g = model.gradient(path, words, measure, mask, label)
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / norm) + 1e-5 * model.w[k]
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.001 * (v * v - square[k])
            model.w[k] -= rate * min(1.0, 2 * (1 - step / (steps + 1))) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


def main_text(page: str | None, model: Labeller) -> str:
    leaf = leaves(page)
    return "\n".join(text for (_, text, _), keep in zip(leaf, model.label([leaf])[0], strict=True) if keep)


def learn(table: DataFrame, html_col: str = "html") -> Labeller:
    """A labeller fitted, in one task, on a bounded number of pages of bounded length whose markup names their main text."""
    page = F.col(html_col)
    rows = table.where((F.length(page) <= MAX_CHARS) & F.lower(page).rlike("<(article|main)[\\s>]")).select(page.alias("page"))
    rows = rows.orderBy(F.xxhash64("page"), "page").limit(MAX_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([p for batch in batches for p in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((list(model.marks), model.w))])], ["model"])

    fitted = rows.repartition(1).mapInArrow(run, "model binary").first()
    if fitted is None:  # an empty table has no task
        return fit([])
    marks, weights = pickle.loads(fitted.model)
    model = Labeller(marks)
    model.w = weights
    return model


def extract(table: DataFrame, model: Labeller, keep: Iterable[str], html_col: str = "html") -> DataFrame:
    """The columns `keep` of table with text and n_chars of the main text of html_col; columns of these names are replaced."""
    keep = list(keep)
    names = [f"k{i}" for i in range(len(keep))]
    rows = table.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(html_col).alias("page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "page")
    told_model = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its = told_model.value
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index("page"))
            texts: list[str] = []
            for lo in range(0, len(pages), 512):
                cut = [leaves(p) for p in pages.slice(lo, 512).to_pylist()]
                texts += ["\n".join(x[1] for x, ok in zip(leaf, fine, strict=True) if ok) for leaf, fine in zip(cut, its.label(cut), strict=True)]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    out = rows.mapInArrow(run, f"{schema}, text string, n_chars long")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "text", "n_chars")

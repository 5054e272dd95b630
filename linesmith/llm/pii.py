"""Personal data by expressions and a skip-chain conditional random field.

The base kinds are found by regular expressions with checks. Around them stands a field over the tokens that hold a digit or
an @ (no others can belong to these kinds): each token has a label (none, email, ip, card, phone), neighbours in the text
share a chain potential, and all tokens of a document with the same form share a skip potential through a form variable, so that
a token repeated n times costs n edges. A form is of a kind: a mailbox, an address with its dots, or all the digits of a card or phone,
in as many words as they come. Similar forms (a phone without its country or area code, mailboxes that differ in dots or a tag)
share a potential of their own through a variable for what they have in common; numbers that merely end alike do not. Tokens in
base spans are observed. Loopy sum-product messages carry labels to distant repeats, and a token that has a repeat or a similar
token in its document is added if its posterior is high enough.

The potentials are fitted piecewise: Spark counts, over all documents, labels by token shape, by neighbouring pair and by
agreement within forms and among similar ones; the tables have at most 5 * SHAPES + 29 rows and go to the driver. The expressions that label the tokens miss
entities, so a token outside of their spans that is linked to one inside, by form or a similar form, counts as not labelled,
and agreement is counted among labelled entities alone. Documents are independent in the
search, so nothing but these counts is shuffled.

Cases: a null or empty text has no spans and the digest of the empty string (redaction leaves it as it is); repeated rows keep
one row each; an empty table gives an empty result and flat potentials; other columns are not read by `find_pii` and are
passed on by `redact_pii`, which works on the named text column alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Block, blocks

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_MAILBOX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_REGEX = {
    # A match begins at the first digit of a run and takes whole runs, so the pattern may say so; long runs are read once.
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_NEEDS = {"phone": "+"}
_MARK = np.zeros(256, bool)
_MARK[[64, *range(48, 58)]] = True
_BUCKET = np.array([0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7])
#: Shapes that can occur: digits (8 groups), @, dots (0 to 3), plus, parenthesis, hyphen.
SHAPES = 8 * 2 * 4 * 2 * 2 * 2
THRESHOLD = 0.5
#: Agreeing repeats, and similar forms, that are taken to have been seen before the first: that numbers of a known entity's very digits, in a form
#: that its kind allows, are that entity is the method's assumption; what is counted adds to it or speaks against it.
SAME_PRIOR, SIMILAR_PRIOR = 400, 400
#: How far a token's shape, and a neighbour, can speak against a label. The expressions that label tokens miss what they are not made for, so that a
#: shape or a pair that is never labelled tells less than its count says.
MOST_AGAINST, MOST_BESIDE = 2.0, 1.0
#: A number without its area code has so many digits, with marks between them, and so many without marks.
_LEAST_LOCAL, _LEAST_PLAIN = 7, 8
#: Words that one number may be written in.
_RUN = 5
_NUMBER, _NUMERIC, _ADDRESS = re.compile("[0-9]+"), re.compile(r"[0-9().+/-]+"), re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_ROUNDS = 16
_EDGE = ".,;:!?\"'<>[]{}|*#&%$="

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = "".join(c for c in found if "0" <= c <= "9")
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def emails(text: str) -> list[Span]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, looked for from each @ so that long runs cost no more than their length."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        box = text[free:at]
        start = len(box.rstrip(_MAILBOX)) + free
        if start < at and (m := _HOST.match(text, at)):
            out.append((0, start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    return emails(text) + [(k, m.start(), m.end()) for k, kind in enumerate(KINDS) if k and _NEEDS.get(kind, "") in text for m in _REGEX[kind].finditer(text) if _passes(kind, m[0])]


def shape(core: str) -> str:
    digits = sum("0" <= c <= "9" for c in core)
    return f"{_BUCKET[min(digits, 20)]}{int('@' in core)}{min(core.count('.'), 3)}{int('+' in core)}{int('(' in core or ')' in core)}{int('-' in core)}"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _dotted(text: str) -> str:
    return "i" + ".".join(part.lstrip("0") or "0" for part in text.split("."))


def entity_form(kind: int, text: str) -> str:
    """What repeats of an entity have in common, by its kind: the mailbox, the numbers between the dots, or all digits."""
    if kind == 0:
        return text.split("@")[0].lower() + "@"
    return _dotted(text) if kind == 1 else ("c" if kind == 2 else "p") + _digits(text)


def plain_mailbox(form: str) -> str:
    """What mailboxes that differ in dots or a tag have in common."""
    return form[:-1].split("+")[0].replace(".", "") + "@"


def local_forms(phone: str) -> list[str]:
    """Digits under which a number is also written, without its country or area code: what follows a mark inside, or one to three first digits if there is none."""
    groups = _NUMBER.findall(phone)
    whole = "".join(groups)
    cuts = np.cumsum([len(g) for g in groups[:-1]]).tolist() if len(groups) > 1 else [1, 2, 3]
    return [rest for c in cuts if len(rest := whole[c:].lstrip("0")) >= (_LEAST_LOCAL if len(groups) > 1 else _LEAST_PLAIN)]


class Tokens:
    """The marked tokens of the documents of a block, their base labels, and the links between them."""

    def __init__(self, b: Block) -> None:
        total = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(_MARK[b.data], out=total[1:])
        marked = np.flatnonzero(total[b.end] > total[b.start])
        doc = np.searchsorted(b.first, marked, "right") - 1
        self.texts: dict[int, str] = {i: b.text_bytes(i).decode() for i in np.unique(doc).tolist()}
        self.base: dict[int, list[Span]] = {i: base_spans(t) for i, t in self.texts.items()}
        points = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum((b.data & 0xC0) != 0x80, out=points[1:])
        self.doc, self.span, self.shape, self.label = doc, [], [], []
        forms: dict[tuple[int, str], int] = {}
        number = lambda i, f: forms.setdefault((i, f), len(forms))
        self.form: list[int] = []
        #: Tokens that an entity begins with.
        self.begins: list[bool] = []
        alike: dict[tuple[int, str], list[int]] = defaultdict(list)
        at, cores, last = -1, [], -1
        for w, i in zip(marked.tolist(), doc.tolist(), strict=True):
            if i != at:  # labels of the places of a document, the first kind winning
                at, origin = i, points[b.off[i]]
                mine = sorted((s, e, k) for k, s, e in self.base[i])
                begins = [s for s, _, _ in mine]
                last = -1
            s, e = int(points[b.start[w]] - origin), int(points[b.end[w]] - origin)
            core = self.texts[i][s:e]
            s += len(core) - len(core.lstrip(_EDGE))
            core = core.strip(_EDGE)
            e = s + len(core)
            near = [(k, a, z) for a, z, k in mine[max(0, int(np.searchsorted(begins, s)) - 4 * len(KINDS)) : int(np.searchsorted(begins, e))] if a < e and z > s] if mine else []
            self.span.append((s, e))
            self.shape.append(shape(core))
            cores.append(core)
            f = None
            if near:
                kind, a, z = min(near)
                f = entity_form(kind, self.texts[i][a:z])
            elif "@" in core:
                f = core.split("@")[0].lower() + "@"
            elif _ADDRESS.fullmatch(core) and _passes("ip", core):
                f = _dotted(core)
            self.label.append(1 + min(near)[0] if near else 0)
            self.begins.append(bool(near) and min(near)[1] != last)
            last = min(near)[1] if near else -1
            self.form.append(-1 if f is None else number(i, f))
        self._numbers(marked.tolist(), doc.tolist(), cores, number, alike)
        self.n_forms = len(forms)
        for (i, f), which in forms.items():
            if f.endswith("@"):
                alike[i, plain_mailbox(f)].append(which)
        groups = sorted({tuple(sorted(set(g))) for g in alike.values() if len(set(g)) > 1})
        self.n_groups = len(groups)
        #: Pairs of a form and a group of similar forms.
        self.similar = np.array([(f, g) for g, members in enumerate(groups) for f in members], np.int64).reshape(-1, 2)
        self.label, self.form = np.array(self.label, np.int64), np.array(self.form, np.int64)
        # Tokens that are no entity by themselves but linked to one, by repeats and similar forms.
        has = np.flatnonzero(self.form >= 0)
        named, near = np.zeros(self.n_forms, bool), np.zeros(self.n_groups, bool)
        named[self.form[has][self.label[has] > 0]] = True
        near[self.similar[:, 1][named[self.similar[:, 0]]]] = True
        named[self.similar[:, 0][near[self.similar[:, 1]]]] = True
        self.open = np.zeros(len(self.label), bool)
        self.open[has] = (self.label[has] == 0) & named[self.form[has]]
        left = np.flatnonzero((np.diff(marked) == 1) & (np.diff(doc) == 0)) if len(marked) else np.zeros(0, np.int64)
        self.left = left[(self.form[left] < 0) | (self.form[left] != self.form[left + 1])]  # token t and t + 1 are neighbours, and not of one number

    def _numbers(self, words: list[int], doc: list[int], cores: list[str], number, alike: dict) -> None:
        """Forms of the numbers outside of entities that have the digits of a card or phone of their document, or of a phone without its first codes.

        They may be written in several words. Numbers of other digits, be they longer, shorter or alike at the end, are linked with nothing.
        """
        whole: dict[tuple[int, str], str] = {}
        local: dict[tuple[int, str], str] = {}
        for i, spans in self.base.items():
            for kind, s, e in spans:
                if kind >= 2:
                    f = entity_form(kind, self.texts[i][s:e])
                    whole[i, f[1:]] = f
                    if kind == 3:
                        local |= {(i, rest): f for rest in local_forms(self.texts[i][s:e]) if (i, rest) not in local}
        if not whole:
            return
        plain = [not self.label[t] and self.form[t] < 0 and _NUMERIC.fullmatch(core) is not None for t, core in enumerate(cores)]
        t = 0
        while t < len(words):
            run = 0
            while plain[t] and run < _RUN and t + run < len(words) and plain[t + run] and doc[t + run] == doc[t] and words[t + run] == words[t] + run:
                run += 1
            for n in range(run, 0, -1):
                digits = _digits("".join(cores[t : t + n]))
                marks = n > 1 or any(c in "-()./" for c in cores[t])
                bare = digits.lstrip("0")
                f = whole.get((doc[t], digits)) or whole.get((doc[t], bare))
                known = local.get((doc[t], bare)) if marks or len(bare) >= _LEAST_PLAIN else None
                if f is None and known is not None:
                    f = "v" + bare
                    alike[doc[t], known] += [number(doc[t], known), number(doc[t], f)]
                if f is not None:
                    self.form[t : t + n] = [number(doc[t], f)] * n
                    self.shape[t : t + n] = [shape("".join(cores[t : t + n])), *[""] * (n - 1)]  # one number has one shape
                    t += n - 1
                    break
            t += 1

    def counts(self) -> dict[tuple[str, str], int]:
        out: dict[tuple[str, str], int] = defaultdict(int)
        for s, k, unsure in zip(self.shape, self.label.tolist(), self.open.tolist(), strict=True):
            if not unsure:
                out[f"u{s}", LABELS[k]] += 1
        for t in self.left[~self.open[self.left] & ~self.open[self.left + 1]].tolist():
            out[f"c{LABELS[self.label[t]]}", LABELS[self.label[t + 1]]] += 1
        known = (self.form >= 0) & (self.label > 0) & np.array(self.begins, bool)
        votes = np.zeros((self.n_forms, len(LABELS)), np.int64)
        np.add.at(votes, (self.form[known], self.label[known]), 1)
        groups = np.zeros((self.n_groups, len(LABELS)), np.int64)
        np.add.at(groups, self.similar[:, 1], votes[self.similar[:, 0]] > 0)
        for key, v in (("s", votes), ("g", groups)):
            v = v[v.sum(1) > 1]
            out[key, "same"] += int(v.max(1).sum()) if len(v) else 0
            out[key, "other"] += int(v.sum() - v.max(1).sum()) if len(v) else 0
        return out


class Model:
    """Log potentials, from the counts."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        n = len(LABELS)
        by: dict[str, np.ndarray] = defaultdict(lambda: np.full(n, 0.5))
        chain = np.full((n, n), 1.0)
        for (key, value), c in counts.items():
            if key[0] == "u":
                by[key[1:]][LABELS.index(value)] += c
            elif key[0] == "c":
                chain[LABELS.index(key[1:]), LABELS.index(value)] += c
        self.unary = {s: np.maximum(u := np.log(v / v.sum()), u.max() - MOST_AGAINST) for s, v in by.items()}
        self.flat = np.log(np.full(n, 1 / n))
        p = chain / chain.sum()
        self.chain = np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -MOST_BESIDE, MOST_BESIDE)
        agree = lambda key, prior: float(np.clip(np.log((counts.get((key, "same"), 0) + prior) / (counts.get((key, "other"), 0) + 1)), 0, 6))
        self.skip, self.similar = agree("s", SAME_PRIOR) * np.eye(n), agree("g", SIMILAR_PRIOR) * np.eye(n)


def messages(unary: np.ndarray, edges: np.ndarray, kind: np.ndarray, potentials: np.ndarray, rounds: int = _ROUNDS) -> np.ndarray:
    """Posteriors by loopy sum-product. unary: log, by node and label; edges: node pairs; kind: the potential of each."""
    m = np.zeros((2, len(edges), unary.shape[1]))  # to the second node, to the first
    a, z = (edges[:, 0], edges[:, 1]) if len(edges) else (np.zeros(0, np.int64),) * 2
    pot = np.exp(potentials)[kind] if len(edges) else np.zeros((0, unary.shape[1], unary.shape[1]))
    for _ in range(rounds if len(edges) else 0):
        belief = unary.copy()
        np.add.at(belief, z, m[0])
        np.add.at(belief, a, m[1])
        new = np.empty_like(m)
        for side, (source, p) in enumerate(((a, pot), (z, pot.transpose(0, 2, 1)))):
            out = belief[source] - m[1 - side]
            out = np.exp(out - out.max(1, keepdims=True))
            out = np.log(np.einsum("ei,eij->ej", out, p) + 1e-300)
            new[side] = out - out.max(1, keepdims=True)
        m = 0.5 * m + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, z, m[0])
    np.add.at(belief, a, m[1])
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def added_spans(t: Tokens, model: Model, threshold: float = THRESHOLD) -> dict[int, list[Span]]:
    """By document: spans that the field adds to the base ones."""
    out: dict[int, list[Span]] = defaultdict(list)
    n, k = len(t.label), len(LABELS)
    has = np.flatnonzero(t.form >= 0)
    open_ = np.flatnonzero(t.open)
    if not len(open_):
        return out
    unary = np.zeros((n + t.n_forms + t.n_groups, k))
    unary[:n] = [model.unary.get(s, model.flat) for s in t.shape]
    seen = np.flatnonzero(t.label > 0)
    unary[seen] = -30.0
    unary[seen, t.label[seen]] = 0.0
    edges = np.concatenate([np.stack([t.left, t.left + 1], 1), np.stack([has, n + t.form[has]], 1), t.similar + [n, n + t.n_forms]])
    kind = np.repeat(np.arange(3), [len(t.left), len(has), len(t.similar)])
    post = messages(unary, edges, kind, np.stack([model.chain, model.skip, model.similar]))[:n]
    best = post[:, 1:].argmax(1) + 1
    for i in open_.tolist():
        if post[i, best[i]] >= threshold:
            d, (s, e) = int(t.doc[i]), t.span[i]
            last = out[d][-1] if out[d] else None
            if last and last[0] == best[i] - 1 and last[2] + 1 == s:
                out[d][-1] = (last[0], last[1], e)
            else:
                out[d].append((int(best[i]) - 1, s, e))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, str], int] = defaultdict(int)  # SHAPES * 5 + 27 keys at most
    for batch in batches:
        for b in blocks(batch, "text"):
            for key, c in Tokens(b).counts().items():
                total[key] += c
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([v for _, v in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["key", "value", "n"])


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The potentials from the counts over all documents."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "key string, value string, n long").groupBy("key", "value").agg(F.sum("n").alias("n"))
    return Model({(r.key, r.value): r.n for r in rows.collect()})


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points, by kind, then start)."""
    model = model or fit(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for b in blocks(batch, "text"):
                t = Tokens(b)
                added = added_spans(t, model)
                counts, sha, spans = np.zeros((len(KINDS), b.n), np.int64), [nothing] * b.n, [""] * b.n
                for i, base in t.base.items():
                    for k, _, _ in base:
                        counts[k, i] += 1
                    if base or i in added:
                        sha[i] = hashlib.sha256(_said(base).encode()).hexdigest()
                        spans[i] = _said(sorted(base + added.get(i, [])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts), pa.array(sha), pa.array(spans)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans, one mark for their union."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, the text without its personal data."""
    model = model or fit(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, text_col):
                t = Tokens(b)
                added = added_spans(t, model)
                new = {i: redacted(t.texts[i], base + added.get(i, [])) for i, base in t.base.items() if base or i in added}
                j = b.batch.schema.get_field_index(text_col)
                column = b.batch.column(j)
                if new:
                    column = pa.array([new.get(i, x) for i, x in enumerate(column.to_pylist())], column.type)
                yield b.batch.set_column(j, b.batch.schema.field(j), column)

    return docs.mapInArrow(run, docs.schema)

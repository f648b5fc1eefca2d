"""Personal data: patterns, and a skip-chain conditional random field that keeps a document's labels consistent.

The patterns give base spans, which always stay. The field's nodes are a document's tokens that hold a digit, ``@`` or ``+``
and the tokens beside them; all other tokens are fixed as "none". Neighbours share chain potentials; repeated or similar
tokens share skip potentials: each with the one before it and with one that a pattern labels, however far off. Loopy sum-product message passing, exact along each run of neighbours and
each series of similar tokens in turn until a document's messages settle, gives each token's label probabilities, and
confident tokens outside the base spans are added.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.llm.common import bounded_sample, column_of, map_texts, sampled_texts, slices, small_batches, texts_of

#: Fixed: the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
MARK = re.compile(r"[0-9@+]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, so the lookbehind changes no match but keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class PiiParams:
    #: Documents with digits or ``@`` that the field is fitted on, at most.
    sample_docs: int = 2000
    #: Probability from which a token outside the base spans is added.
    confidence: float = 0.95
    #: A document's messages have settled when a round would change none of them by more than this.
    tolerance: float = 1e-4
    #: Messages may circle for ever; a document that hasn't settled by then keeps its last ones. Each round carries labels
    #: along whole series, so this doesn't bound how far apart similar tokens can be.
    most_rounds: int = 500
    #: The share of its last value that a message keeps at first; it grows with the rounds, so that circling dies down.
    damping: float = 0.3
    steps: int = 150
    ridge: float = 1e-4
    #: What equal labels of linked tokens are worth before fitting; fitting is drawn back to it.
    skip_prior: float = 8.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards, so that long runs without one cost nothing."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start."""
    if not MARK.search(text):
        return []
    spans = [(0, a, b) for a, b in _emails(text)]
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return spans


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


N_LABELS = len(KINDS) + 1  # the last is "none"
NONE = len(KINDS)


def _shape(token: str) -> np.ndarray:
    digits = [c for c in token if "0" <= c <= "9"]
    n, core = len(digits), token.strip(".,;:!?()[]\"'#*$%&|")
    parts = core.split(".")
    all_digits = core.isascii() and core.isdigit()
    return np.array(
        [
            1.0,
            n == 0,
            1 <= n <= 4,
            5 <= n <= 8,
            9 <= n <= 12,
            13 <= n <= 19,
            n > 19,
            "@" in token,
            "@" in token and "." in token.partition("@")[2],
            token.startswith("+"),
            token.startswith("("),
            "-" in core,
            len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts),
            len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
            all_digits,
            all_digits and 13 <= n <= 19 and luhn(core),
            any(map(str.isalpha, core)),
            any(map(str.isalpha, core)) and n > 0,
            "=" in token or '"' in token,
        ],
        dtype=np.float64,
    )


N_SHAPE = len(_shape("x"))


def _key(token: str) -> str | None:
    """Tokens with equal keys are repeated or similar: the same digits, or the same letters and digits of an address."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    if len(digits) >= 6 and not any(map(str.isalpha, token)):
        return digits
    core = "".join(c for c in token.lower() if c.isalnum() or c in "@.").strip(".")
    return core if len(core) >= 5 and any(c.isdigit() or c == "@" for c in core) else None


class Field:
    """The nodes and links of a batch of documents, side by side in one graph."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]) -> None:
        self.doc, self.start, self.end, label, shapes = [], [], [], [], []
        chain: list[tuple[int, int]] = []
        skip: list[tuple[int, int]] = []
        border: list[int] = []
        group: list[int] = []
        n_groups = 0
        for d, (text, found) in enumerate(zip(texts, spans)):
            if not MARK.search(text):
                continue
            tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
            marked = [i for i, (a, b) in enumerate(tokens) if MARK.search(text, a, b)]
            use = sorted({j for i in marked for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)})
            order = sorted((a, b, k) for k, a, b in found)
            at, last, seen = 0, -2, {}
            for i in use:
                a, b = tokens[i]
                node = len(self.doc)
                while at < len(order) and order[at][1] <= a:
                    at += 1
                covering = [k for x, y, k in order[at : at + 4] if x < b and y > a]
                self.doc.append(d)
                self.start.append(a)
                self.end.append(b)
                label.append(covering[0] if covering else NONE)
                shapes.append(_shape(text[a:b]))
                if i == last + 1:
                    chain.append((node - 1, node))
                else:
                    border += [node] if i else []
                    if last >= 0:
                        border.append(node - 1)
                last = i
                key = _key(text[a:b])
                group.append(-1)
                if key is not None:
                    if key in seen:
                        skip.append((seen[key], node))
                        group[node] = group[seen[key]]
                    else:
                        group[node], n_groups = n_groups, n_groups + 1
                    seen[key] = node
            if use and use[-1] < len(tokens) - 1:
                border.append(len(self.doc) - 1)
        self.n = len(self.doc)
        self.label = np.array(label, dtype=np.int64)
        self.shape = np.array(shapes, dtype=np.float64).reshape(self.n, N_SHAPE)
        self.chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        self.skip = np.array(skip, dtype=np.int64).reshape(-1, 2)
        self.border = np.bincount(np.array(border, dtype=np.int64), minlength=self.n) if self.n else np.zeros(0, np.int64)
        # by node and label, whether its key has an occurrence of that label that no skip link joins to it: along the links
        # alone, evidence would fade with the number of occurrences between
        self.far = np.zeros((self.n, N_LABELS))
        if n_groups:
            keyed = np.flatnonzero(np.array(group) >= 0)
            of, own = np.array(group)[keyed], np.eye(N_LABELS)[self.label[keyed]]
            counts = np.zeros((n_groups, N_LABELS))
            np.add.at(counts, of, own)
            self.far[keyed] = counts[of] - own - _neighbours(self, self.skip, self.label)[keyed] > 0
            self.far[:, NONE] = 0


@dataclass(frozen=True)
class PiiModel:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    params: PiiParams


def _neighbours(field: Field, pairs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """By node and label, how many linked nodes have the label."""
    out = np.zeros((field.n, N_LABELS))
    np.add.at(out, (pairs[:, 0], labels[pairs[:, 1]]), 1)
    np.add.at(out, (pairs[:, 1], labels[pairs[:, 0]]), 1)
    return out


def fit_field(field: Field, params: PiiParams) -> PiiModel:
    """Pseudo-likelihood: each token's label given its shape and its neighbours' labels, by Adam."""
    prior = params.skip_prior * np.diag([1.0] * NONE + [0.0])
    unary, chain, skip = np.zeros((N_SHAPE, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), prior.copy()
    if not field.n:
        unary[0, NONE] = 10.0
        return PiiModel(unary, chain, skip, params)
    beside = _neighbours(field, field.chain, field.label)
    beside[:, NONE] += field.border
    linked = _neighbours(field, field.skip, field.label) + field.far
    truth = np.eye(N_LABELS)[field.label]
    weight = 1 / np.maximum(1, truth.sum(axis=0))
    weight = (weight / weight.max())[field.label] ** 0.5
    weight /= weight.sum()
    theta = [unary, chain, skip]
    inputs = [field.shape, beside, linked]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, params.steps + 1):
        z = sum(x @ t for x, t in zip(inputs, theta))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        e = (p / p.sum(axis=1, keepdims=True) - truth) * weight[:, None]
        for k, (x, t) in enumerate(zip(inputs, theta)):
            g = x.T @ e
            if k:
                g = (g + g.T) / 2  # a link's potential is the same from both ends
            g = g + params.ridge * (10 * (t - prior) if k == 2 else t)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            theta[k] = t - 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return PiiModel(*theta, params)


def _jumps(source: np.ndarray, target: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For directed links that form paths, by doubling: the links that have others before them, and those to multiply by."""
    into = np.full(n, -1)
    into[target] = np.arange(len(target))
    before, out = into[source], []
    while len(live := np.flatnonzero(before >= 0)):
        out.append((live, before[live]))
        before[live] = before[before[live]]
    return out


def _along(links: list[tuple[np.ndarray, np.ndarray]], inside: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Messages of all links in both directions, exact along each path, given what each node has from elsewhere."""
    new = []
    for source, jumps in links:
        z = inside[source][:, :, None] + potential
        product = np.exp(z - z.max(axis=(1, 2), keepdims=True))
        for live, before in jumps:
            joined = product[before] @ product[live]
            product[live] = joined / joined.max(axis=(1, 2), keepdims=True)
        message = np.log(np.maximum(product.sum(axis=1), 1e-300))
        new.append(message - message.max(axis=1, keepdims=True))
    return np.concatenate(new)


def marginals(model: PiiModel, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each node by loopy message passing until each document settles; base labels are observed. And by document
    whether its messages settled.

    Neighbours form paths, and so do the occurrences of a key. A round solves all paths of neighbours exactly, given the
    messages along keys, and then those of keys, given the messages of neighbours. A fixed point is one of plain loopy
    message passing, but a label reaches every occurrence of its key in one round.
    """
    p = model.params
    unary = field.shape @ model.unary + field.border[:, None] * model.chain[NONE][None, :] + field.far @ model.skip
    observed = field.label != NONE
    unary[observed] += 20 * np.eye(N_LABELS)[field.label[observed]]
    doc = np.array(field.doc, dtype=np.int64)
    kinds = [(field.chain, model.chain), (field.skip, model.skip)]
    belief = unary.copy()
    calm = np.ones(int(doc.max(initial=-1)) + 1, dtype=bool)
    pairs = [k for k, _ in kinds]
    messages = [np.zeros((2 * len(k), N_LABELS)) for k in pairs]
    stale = True
    for turn in range(p.most_rounds):
        if not sum(map(len, pairs)):
            break
        if stale:
            links = [[(k[:, 0], _jumps(k[:, 0], k[:, 1], field.n)), (k[:, 1], _jumps(k[:, 1], k[:, 0], field.n))] for k in pairs]
            targets = [np.concatenate([k[:, 1], k[:, 0]]) for k in pairs]
        step, change = (1 - p.damping) / (1 + turn / 50), np.zeros(int(doc[-1]) + 1)
        for at in (0, 1):
            if not len(pairs[at]):
                continue
            inside = unary.copy()
            np.add.at(inside, targets[1 - at], messages[1 - at])
            moved = _along(links[at], inside, kinds[at][1]) - messages[at]
            np.maximum.at(change, doc[targets[at]], np.abs(moved).max(axis=1))
            messages[at] += step * moved
        settled = change <= p.tolerance
        stale = turn == p.most_rounds - 1 or any(settled[doc[k[:, 0]]].any() for k in pairs)
        if stale:
            if turn == p.most_rounds - 1:
                for k in pairs:
                    calm[doc[k[:, 0]][~settled[doc[k[:, 0]]]]] = False
            for at, k in enumerate(pairs):
                over = settled[doc[k[:, 0]]] | (turn == p.most_rounds - 1)
                both = np.tile(over, 2)
                np.add.at(belief, targets[at][both], messages[at][both])
                pairs[at], messages[at] = k[~over], messages[at][~both]
    z = np.exp(belief - belief.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True), calm


def added_spans(model: PiiModel, texts: list[str], base: list[list[tuple[int, int, int]]]) -> tuple[list[list[tuple[int, int, int]]], list[bool]]:
    """By text, confident tokens that no base span touches, without the marks around them; and whether its messages settled."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    field = Field(texts, base)
    if not field.n:
        return out, [True] * len(texts)
    p, calm = marginals(model, field)
    if not calm.all():
        warnings.warn(f"{(~calm).sum()} documents keep the messages of round {model.params.most_rounds}, which hadn't settled", stacklevel=2)
    best = p[:, :NONE].argmax(axis=1)
    for i in np.flatnonzero((p[np.arange(field.n), best] >= model.params.confidence) & (field.label == NONE)):
        text = texts[field.doc[i]]
        a, b = field.start[i], field.end[i]
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if any("0" <= c <= "9" or c == "@" for c in text[a:b]):
            out[field.doc[i]].append((int(best[i]), a, b))
    return out, [*calm.tolist(), *[True] * (len(texts) - len(calm))]


def fit(docs: DataFrame, params: PiiParams = PiiParams()) -> PiiModel:
    """A model from a bounded sample of the texts that hold a mark; the patterns' spans are its labels.

    ``docs`` has doc_id and text; null ids and texts take no part, nor do texts without a digit or ``@``; of repeated ids the least
    text counts, and other columns are ignored. Without such texts nothing is added to the patterns' spans.
    """
    marked = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    ids = bounded_sample(marked.select("doc_id").where("doc_id is not null"), "doc_id", params.sample_docs)
    rows = sampled_texts(marked, ids.distinct())

    def cut(batch):
        # only what the field has nodes for: each mark's surroundings travel, not whole texts
        found = []
        for key, t in zip(column_of(batch, "doc_id").cast("string").to_pylist(), texts_of(batch)):
            tokens = [(m.start(), m.end()) for m in TOKEN.finditer(t)]
            near, last = [], None
            for i, (a, b) in enumerate(tokens):
                if any(MARK.search(t, *tokens[j]) for j in (i - 2, i - 1, i, i + 1, i + 2) if 0 <= j < len(tokens)):
                    near.append(t[a:b] if last is None else t[last:b])
                    last = b
                elif last is not None:
                    near.append(" ")
                    last = None
            found.append((key, "".join(near)))
        return {"key": [k for k, _ in found], "near": [n for _, n in found]}

    near = sorted((r["key"], r["near"]) for r in map_texts(rows, "key string, near string", cut).collect())
    texts = [n for _, n in near]
    return fit_field(Field(texts, [base_spans(t) for t in texts]), params)


def find(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points), settled of every row, in one pass without a shuffle.

    ``base`` has the patterns' matches, ``spans`` those and the added ones, both by kind, then start. Null and empty texts have
    none. Repeated rows give repeated results; other columns are ignored. ``settled`` is false where the messages of a document
    didn't settle in ``most_rounds``, so that its added spans are those of the last round.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    span = "array<struct<kind: string, start: long, end: long>>"

    def one(batch):
        texts = texts_of(batch)
        base = [base_spans(t) for t in texts]
        added, settled = added_spans(shared.value, texts, base)
        as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        return {"doc_id": column_of(batch, "doc_id"), "base": [as_rows(b) for b in base], "spans": [as_rows(sorted(b + a)) for b, a in zip(base, added)], "settled": settled}

    return map_texts(docs.select("doc_id", "text"), f"doc_id {kind}, base {span}, spans {span}, settled boolean", one)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first span, in angle brackets."""
    out, done = [], 0
    merged: list[list[int]] = []
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[done:a], f"<{KINDS[k]}>"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars``, where there is such a column, counted anew.

    Null texts stay null. All other columns and all rows stay as they are. Documents whose messages don't settle are redacted by those of
    the last round, with a warning in the worker's log; ``find`` tells which.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for part in slices(batches, "text"):
            raw = part.column(at).to_pylist()
            texts = [t or "" for t in raw]
            base = [base_spans(t) for t in texts]
            added, _ = added_spans(shared.value, texts, base)
            new = [None if r is None else replaced(t, b + a) if b or a else t for r, t, b, a in zip(raw, texts, base, added)]
            columns = part.columns
            columns[at] = pa.array(new, part.schema.field(at).type)
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array([len(n) if n is not None and n is not r and n != r else o for n, r, o in zip(new, raw, old)], part.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

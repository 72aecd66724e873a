"""Personal data by patterns and a skip-chain conditional random field.

Patterns with checks give base spans.  A CRF over tokens that hold a digit or an at sign then adds
spans: its potentials are token features, labels of adjoining tokens, and labels of distant
tokens that repeat or resemble each other (skip edges).  Loopy message passing over each
document makes labels of the same entity agree; tokens of base spans keep their labels.  It is
trained by pseudo-likelihood on a bounded sample of pattern-labelled documents and altered
copies of their entities.

Edge cases: a null or empty text has no spans; very long texts are searched whole, in time
proportional to their length; repeated rows give equal rows; an empty table gives no rows (and a
model that adds nothing); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents that the CRF learns from: those with digits or at signs, first by a hash of their id.
SAMPLE_DOCS = 3000
#: Messages have settled when none moves further than this; after so many rounds, or four for each token, steps are halved.
SETTLED, PATIENCE, SURE = 1e-4, 200, 0.9

# Patterns of base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMERIC = re.compile(r"[0-9][0-9.]*")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if n % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Every match starts at the leftmost local character before an at sign, after the match before it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    for m in NUMERIC.finditer(text):  # an address lies in one run of digits and dots; runs are short
        if m.group().count(".") >= 3:
            for x in IP.finditer(m.group()):
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in x.group().split("."))):
                    found["ip"].append((m.start() + x.start(), m.start() + x.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found["phone"].append(m.span())
    return found


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


# Tokens and graph


CORE = re.compile(r"[0-9@]\S*")


def tokens(text: str) -> list[Span]:
    """Runs of non-white characters that hold a digit or an at sign, without punctuation around them."""
    found, done = [], 0
    for m in CORE.finditer(text):
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = end = m.end()
        while end > start and text[end - 1] in ".,;:!?\"'":
            end -= 1
        while start < end and text[start] in "\"'":
            start += 1
        if end > start:
            found.append((start, end))
    return found


def size_of(n: int) -> str:
    return str(n) if n in (0, 7, 8, 9, 10, 11, 16) else "1-3" if n < 4 else "4-6" if n < 7 else "12-15" if n < 16 else "17-19" if n < 20 else "20+"


def shape(token: str) -> list[str]:
    digits = NOT_DIGIT.sub("", token)
    letters = sum(c.isalpha() for c in token)
    parts = token.split(".")
    out = [
        "bias",
        f"digits {size_of(len(digits))}",
        f"letters {min(letters, 3)}",
        f"dots {min(len(parts) - 1, 4)}",
        f"hyphens {min(token.count('-'), 3)}",
        f"plus {token[0] == '+'}",
        f"round {'(' in token or ')' in token}",
        f"only digits {len(digits) == len(token)}",
        f"at {token.count('@') if token.count('@') < 2 else 2} {'.' in token.rpartition('@')[2]}",
        f"other {any(c in token for c in '=/_\"#:')}",
    ]
    if len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append("four parts")
    if 12 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)} {letters == 0}")
    return out


def key_of(token: str) -> str:
    """Tokens with the same key are the same or alike: long digit strings without separators, else lower-cased characters."""
    digits = NOT_DIGIT.sub("", token)
    if len(digits) >= 7 and not any(c.isalpha() for c in token):
        return digits[-10:] if len(digits) <= 15 else digits
    return token.lower()


class Graph:
    """Tokens of a document with their features, chain edges and skip edges."""

    def __init__(self, text: str, spans: dict[str, list[Span]]):
        at = tokens(text)
        self.build(at, [text[a:b] for a, b in at], spans)

    @classmethod
    def of(cls, at: list[Span], words: list[str], spans: dict[str, list[Span]]) -> Graph:
        """The graph of a text's tokens, without the text."""
        graph = cls.__new__(cls)
        graph.build(at, words, spans)
        return graph

    def build(self, at: list[Span], words: list[str], spans: dict[str, list[Span]]) -> None:
        self.at = at
        joint = [i for i in range(len(words) - 1) if self.at[i + 1][0] - self.at[i][1] <= 2]
        self.features = [shape(w) for w in words]
        for i in joint:
            self.features[i].append(f"next digits {size_of(len(NOT_DIGIT.sub('', words[i + 1])))}")
            self.features[i + 1].append(f"previous {words[i][0] == '+'} {size_of(len(NOT_DIGIT.sub('', words[i])))}")
        self.chain = [(i, i + 1) for i in joint]
        # Each mention is linked to the one before it, so that edges grow with mentions, not with pairs; runs of adjoining tokens have a key too.
        last: dict[str, int] = {}
        self.skip = []
        runs = {i: "" for i in range(len(words))}
        for i in joint:
            runs[i + 1] = (runs[i] or words[i]) + words[i + 1]
        for i, w in enumerate(words):
            for k in {key_of(w), key_of(runs[i]) if runs[i] else key_of(w)}:
                if k in last and len(k) >= 4:
                    self.skip.append((last[k], i))
                last[k] = i
        self.known = np.zeros(len(words), np.int64)
        marks = sorted((a, b, n) for n, k in enumerate(KINDS, 1) for a, b in spans[k])
        j = 0
        for i, (a, b) in enumerate(self.at):
            while j < len(marks) and marks[j][1] <= a:
                j += 1
            if j < len(marks) and marks[j][0] < b:
                self.known[i] = marks[j][2]


class SkipChainCrf:
    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        k = len(LABELS)
        self.unary, self.chain, self.skip = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros((k, k))

    @classmethod
    def train(cls, graphs: list[Graph], steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> SkipChainCrf:
        """Pseudo-likelihood: each label given the features and its neighbours' labels."""
        model = cls(sorted({f for g in graphs for fs in g.features for f in fs}))
        y = np.concatenate([g.known for g in graphs]) if graphs else np.zeros(0, np.int64)
        if not len(y):
            return model
        # Tokens with the same features share a row of x.
        alike: dict[tuple[str, ...], int] = {}
        own, chain, skip, base = [], [], [], 0
        for g in graphs:
            own += [alike.setdefault(tuple(fs), len(alike)) for fs in g.features]
            chain += [(base + a, base + b) for a, b in g.chain]
            skip += [(base + a, base + b) for a, b in g.skip]
            base += len(g.features)
        own = np.array(own)
        k, n = len(LABELS), len(y)
        x = np.zeros((len(alike), len(model.index)), np.float32)
        for fs, i in alike.items():
            x[i, [model.index[f] for f in fs]] = 1
        near = []
        for edges in (chain, skip):
            e = np.array(edges, np.int64).reshape(-1, 2)
            back, ahead = np.zeros((n, k)), np.zeros((n, k))
            np.add.at(back, (e[:, 1], y[e[:, 0]]), 1)
            np.add.at(ahead, (e[:, 0], y[e[:, 1]]), 1)
            near.append((back, ahead))
        target = np.eye(k)[y]
        sums = [np.full_like(p, 1e-8) for p in (model.unary, model.chain, model.skip)]
        for _ in range(steps):
            s = (x @ model.unary)[own]
            for (back, ahead), p in zip(near, (model.chain, model.skip), strict=True):
                s = s + back @ p + ahead @ p.T
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            d = target - p / p.sum(axis=1, keepdims=True)
            sums_d = np.stack([np.bincount(own, c, len(alike)) for c in d.T], axis=1)
            grads = [x.T @ sums_d, *(back.T @ d + (ahead.T @ d).T for back, ahead in near)]
            for param, grad, total in zip((model.unary, model.chain, model.skip), grads, sums, strict=True):
                grad = grad / n - decay * param / 10
                total += grad**2
                param += rate * grad / np.sqrt(total)
        return model

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product over the document's graph, tokens of base spans held fast."""
        k, n = len(LABELS), len(g.at)
        rows = [i for i, fs in enumerate(g.features) for f in fs if f in self.index]
        cols = [self.index[f] for fs in g.features for f in fs if f in self.index]
        own = np.zeros((n, k))
        np.add.at(own, rows, self.unary[cols])
        held = g.known > 0
        own[held] = -50.0
        own[held, g.known[held]] = 50.0
        edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
        if len(edges):
            pot = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
            right, left = np.zeros((len(edges), k)), np.zeros((len(edges), k))
            step, n_rounds = 0.5, 0
            while True:
                belief = own.copy()
                np.add.at(belief, edges[:, 1], right)
                np.add.at(belief, edges[:, 0], left)
                to_right = logsum((belief[edges[:, 0]] - left)[:, :, None] + pot, 1)
                to_left = logsum((belief[edges[:, 1]] - right)[:, None, :] + pot, 2)
                moved = max(np.abs(to_right - right).max(), np.abs(to_left - left).max())
                right, left = right + step * (to_right - right), left + step * (to_left - left)
                if moved < SETTLED:
                    break
                n_rounds += 1
                if n_rounds % max(PATIENCE, 4 * n) == 0:
                    step /= 2  # they swing: damp them more, and let go of those that swing even so
                    if step < 1e-3:
                        break
            np.add.at(own, edges[:, 1], right)
            np.add.at(own, edges[:, 0], left)
        own -= own.max(axis=1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(axis=1, keepdims=True)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    out = (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)
    return out - out.max(axis=1, keepdims=True)


def entities(text: str, spans: dict[str, list[Span]]) -> dict[str, list[str]]:
    """The entities of each kind."""
    return {kind: [text[a:b] for a, b in spans[kind]] for kind in KINDS}


def altered(found: dict[str, list[str]], rng: random.Random) -> tuple[str, dict[str, list[Span]]]:
    """A short text that mentions each entity as it is and again in another form, all labelled."""
    parts, marks, at = [], {k: [] for k in KINDS}, 0

    def say(piece: str, kind: str | None = None) -> None:
        nonlocal at
        if kind:
            marks[kind].append((at, at + len(piece)))
        parts.append(piece + " ")
        at += len(piece) + 1

    for kind in KINDS:
        for whole in found[kind]:
            digits = NOT_DIGIT.sub("", whole)
            other = {"email": whole.upper(), "ip": whole, "card": ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "phone": rng.choice([f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", digits[-10:], whole.lstrip("+")])}[kind]
            for piece, k in ((whole, kind), ("and", None), (str(rng.randrange(100, 9999)), None), ("or", None), (other, kind), ("then", None)):
                say(piece, k)
    return "".join(parts), marks


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 7) -> SkipChainCrf:
    """Learn from a bounded, documented sample: all tokens of the first ``sample_docs`` documents with digits or at signs by hash."""
    # Keys are chosen first, so that one task orders numbers, not texts; a key's copies are one document.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").filter(F.col("text").rlike("[0-9@]"))
    chosen = keyed.select("doc_id", "text_hash").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(sample_docs)
    keys = F.broadcast(docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema))  # at most ``sample_docs`` rows
    same = keyed.doc_id.eqNullSafe(keys.doc_id) & (keyed.text_hash == keys.text_hash)
    held = keyed.join(keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text")
    schema = pa.schema([("tokens", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # only tokens, their places and the base spans go to the driver
            rows = []
            for t in b.column(1).to_pylist():
                at, spans = tokens(t), base_spans(t)
                rows.append(json.dumps([at, [t[a:e] for a, e in at], spans, entities(t, spans)]))
            yield batch(schema, [rows])

    rng, graphs = random.Random(seed), []
    for (row,) in sorted(arrow_map(held, run, "tokens string").collect()):
        at, words, spans, found = json.loads(row)
        graphs.append(Graph.of(at, words, spans))
        if any(found.values()):
            graphs.append(Graph(*altered(found, rng)))
    return SkipChainCrf.train([g for g in graphs if g.at])


def added_spans(text: str, spans: dict[str, list[Span]], model: SkipChainCrf) -> dict[str, list[Span]]:
    """Spans that the CRF is sure of and that touch no base span."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    g = Graph(text, spans)
    if not model.index or not g.at or g.known.all():
        return out
    p = model.marginals(g)
    best = p.argmax(axis=1)
    last = None
    for i, (a, b) in enumerate(g.at):
        if g.known[i] or not best[i] or p[i, best[i]] < SURE:
            last = None
            continue
        own = out[KINDS[best[i] - 1]]
        if last == (i - 1, best[i]) and a - g.at[i - 1][1] <= 2:
            own[-1] = (own[-1][0], b)
        else:
            own.append((a, b))
        last = (i, best[i])
    return out


def find(docs: DataFrame, model: SkipChainCrf) -> DataFrame:
    """Per row: doc_id, counts of base spans, base_sha256, spans, n_added."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = base_spans(text or "")
                more = added_spans(text or "", spans, model)
                every = {k: spans[k] + more[k] for k in KINDS}
                rows.append((doc, *(len(spans[k]) for k in KINDS), hashlib.sha256(joined(spans).encode()).hexdigest(), joined(every), sum(map(len, more.values()))))
            yield batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(schema))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, model: SkipChainCrf) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first names the whole."""
    spans = base_spans(text)
    more = added_spans(text, spans, model)
    marks = sorted((a, b, k) for k in KINDS for a, b in spans[k] + more[k])
    if not marks:
        return text
    out, at = [], 0
    for n, (a, b, kind) in enumerate(marks):
        if a >= at or not n:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SkipChainCrf) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars`` counted anew, other columns as they are."""
    names = docs.columns
    i = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([t if t is None else redacted(t, model) for t in b.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if j == i else c for j, c in enumerate(b.columns)], names=b.schema.names)

    out = arrow_map(docs, run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in names else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))

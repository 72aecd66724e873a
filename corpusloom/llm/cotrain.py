"""Document quality by co-training on two views.

One classifier sees a document's text, its words and their layout; the other its metadata alone, language,
source and length (n_chars).  The views share no feature.  Each is fitted on labelled documents; over rounds, each
gives the documents of an unlabelled pool that it is surest of to the other as training rows.  Both are then
calibrated on labelled documents held out from training and their log odds are added, less those of the
base rate, as of views that are independent given the class.

A document is bad if its label says low quality or toxic.  Both classifiers are fitted on
bounded samples (``LABELLED`` and ``POOL`` documents, first by a hash of their id); every document
is scored on its whole text.

Edge cases: a null or empty text has no words and scores by its metadata; labels with a null
quality are not used and a null toxicity counts as none; of several labels of a document the
worst counts; without labels of both classes every document has the score 1 and is kept; repeated
rows score equally; an empty table gives no rows; extra columns are ignored or carried along.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, table

LABELLED, POOL, ROUNDS, GIVEN = 8000, 4000, 3, 200
BUCKETS, LEAST_DOCS, LEAST_Z, PREFIX = 1 << 22, 3, 2.5, 4
BINS, THRESHOLD = 16, 0.5
CACHE = 200_000
STRIP = b".,;:!?\"'()"

UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's words and of the beginnings of longer ones."""
    words = {w.strip(STRIP) for w in set((text or "").lower().encode("utf-8", "surrogatepass").split())}
    starts = {w.decode("utf-8", "replace")[:PREFIX] for w in words if len(w) > PREFIX}
    return np.unique(np.array([zlib.crc32(w) % BUCKETS for w in words] + [zlib.crc32(s.encode(), 1) % BUCKETS for s in starts], np.int32))


def layout(text: str | None) -> list[float]:
    """Numbers of the text view: the shape of the text, whatever its words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    words = raw.split()
    lines = raw.split(b"\n")
    count = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    ends = sum(map(raw.count, (b"!!", b"##", b"%%", b"$$", b"&&", b"**", b" | ")))
    return [
        math.log1p(len(lines)),
        math.log1p(n / len(lines)),
        count(UPPER),
        count(DIGITS),
        count(MARKS),
        ends / max(len(words), 1),
        len(set(words)) / max(len(words), 1),
        len(set(lines)) / len(lines),
        n / max(len(words), 1),
    ]


def length(n_chars: int | None) -> list[float]:
    """The number of the metadata view; an unknown length counts as none."""
    return [math.log1p(max(n_chars or 0, 0))]


N_LAYOUT = len(layout(""))


def bins(numbers: list[float], edges: list) -> list[int]:
    return [i * BINS + int(np.searchsorted(e, x)) for i, (e, x) in enumerate(zip(edges, numbers, strict=True))]


def quantiles(numbers: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(numbers[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(numbers.shape[1])]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class SparseLogistic:
    """Logistic regression on rows of distinct feature numbers; ``scale`` is what a feature counts where it is."""

    def __init__(self, size: int, scale: np.ndarray | None = None):
        self.w, self.b, self.scale = np.zeros(size), 0.0, np.ones(size) if scale is None else scale

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 100, rate: float = 0.3, decay: float = 1e-4) -> SparseLogistic:
        lengths = np.array([len(r) for r in rows])
        cols = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        of_row = np.repeat(np.arange(len(rows)), lengths)
        total, total_b = np.full(len(self.w), 1e-6), 1e-6
        for _ in range(steps):
            s = np.bincount(of_row, (self.w * self.scale)[cols], len(rows)) + self.b
            d = (sigmoid(s) - y) * weight / weight.sum()
            g = np.bincount(cols, d[of_row], len(self.w)) * self.scale + decay * self.w
            total += g * g
            self.w -= rate * g / np.sqrt(total)
            total_b += d.sum() ** 2
            self.b -= rate * d.sum() / math.sqrt(total_b)
        return self

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        w = self.w * self.scale
        return np.array([w[r].sum() + self.b for r in rows])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of log odds for margins (smoothed targets)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mid, spread = margin.mean(), max(margin.std(), 1e-6)
    z = np.stack([(margin - mid) / spread, np.ones(len(y))], axis=1)
    w, total = np.array([1.0, 0.0]), np.full(2, 1e-6)
    for _ in range(500):
        g = z.T @ (sigmoid(z @ w) - t) / len(y)
        total += g * g
        w -= 0.5 * g / np.sqrt(total)
    slope = max(float(w[0]), 0.0) / spread
    return slope, float(w[1]) - slope * mid


@dataclass
class Model:
    """What scoring needs: it is as large as the samples' vocabulary, whatever the corpus."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    layout_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    text_bias: float = 0.0
    edges: list = field(default_factory=list)  # inner bin edges of each layout number
    length_edges: list = field(default_factory=list)
    prior: float = 0.0  # log odds of being bad
    categories: dict = field(default_factory=dict)
    meta_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    meta_bias: float = 0.0
    text_scale: tuple = (1.0, 0.0)
    meta_scale: tuple = (1.0, 0.0)
    trained: bool = False

    def meta_row(self, n_chars: int | None, lang: str | None, source: str | None) -> np.ndarray:
        own = bins(length(n_chars), self.length_edges)
        own += [BINS + self.categories[k] for k in (("lang", lang), ("source", source)) if k in self.categories]
        return np.array(own, np.int64)


def fit_views(text_rows, layouts, meta, y, pool_text, pool_layouts, pool_meta) -> Model:
    """Co-train on labelled rows and an unlabelled pool; the fourth labelled row calibrates.

    ``meta`` has (n_chars, lang, source) of each row.
    """
    m = Model()
    y = np.asarray(y, float)
    hold = np.arange(len(y)) % 4 == 3
    if min(y[~hold].sum(), (1 - y[~hold]).sum()) < 2 or min(y[hold].sum(), (1 - y[hold]).sum()) < 1:
        return m
    train, held = np.flatnonzero(~hold), np.flatnonzero(hold)
    m.buckets, ratio = telling([text_rows[i] for i in train], y[train])
    m.edges = quantiles(np.array(layouts)[train])
    m.length_edges = quantiles(np.array([length(n) for n, _, _ in meta])[train])
    names = sorted({(k, v) for i in train for k, v in zip(("lang", "source"), meta[i][1:], strict=True) if v is not None})
    m.categories = {c: i for i, c in enumerate(names)}

    def text_row(words, shape):
        at = np.minimum(np.searchsorted(m.buckets, words), len(m.buckets) - 1)
        return np.concatenate([at[m.buckets[at] == words], len(m.buckets) + np.array(bins(shape, m.edges))])

    texts, pool_texts = ([text_row(r, x) for r, x in zip(*rows, strict=True)] for rows in ((text_rows, layouts), (pool_text, pool_layouts)))
    own, pool_own = ([m.meta_row(*x) for x in rows] for rows in (meta, pool_meta))
    scale = np.concatenate([ratio, np.ones(N_LAYOUT * BINS)])
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels for the text view and for the metadata view
    sides = ((texts, pool_texts, len(scale), scale), (own, pool_own, BINS + len(names), None))
    for turn in range(ROUNDS + 1):
        views = []
        for (rows, pool, size, weights), extra in zip(sides, given, strict=True):
            more = sorted(extra)
            views.append(SparseLogistic(size, weights).fit([rows[i] for i in train] + [pool[i] for i in more], np.concatenate([y[train], [extra[i] for i in more]]), np.concatenate([np.ones(len(train)), np.full(len(more), 0.5)])))
        scales = [platt(view.margin([rows[i] for i in held]), y[held]) for view, (rows, *_) in zip(views, sides, strict=True)]
        if turn == ROUNDS or not len(pool_texts):
            break
        for view, (a, b), (_, pool, *_), extra in zip(views, scales, sides, reversed(given), strict=True):
            p = sigmoid(a * view.margin(pool) + b)
            rate = y[train].mean()
            for sign, share in ((1, rate), (0, 1 - rate)):
                order = np.argsort(-p if sign else p, kind="stable")
                sure = [i for i in order[: int(GIVEN * share) + 1] if (p[i] > 0.95 if sign else p[i] < 0.05)]
                extra.update((int(i), float(sign)) for i in sure if int(i) not in extra)
    weights = views[0].w * views[0].scale
    m.weights, m.layout_weights, m.text_bias = weights[: len(m.buckets)], weights[len(m.buckets) :], views[0].b
    m.meta_weights, m.meta_bias = views[1].w, views[1].b
    m.text_scale, m.meta_scale = scales
    rate = (y.sum() + 1) / (len(y) + 2)
    m.prior = math.log(rate / (1 - rate))
    m.trained = True
    return m


def telling(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that speak for bad documents beyond chance, and their log ratios.

    Features that speak for good ones are left out: short clean texts lack them too.
    """
    values, at = np.unique(np.concatenate(rows), return_inverse=True)
    of_row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bad, every = np.bincount(at, y[of_row], len(values)), np.bincount(at, minlength=len(values))
    rate = y.mean()
    z = (bad - every * rate) / np.sqrt(every * rate * (1 - rate))
    use = (every >= LEAST_DOCS) & (z >= LEAST_Z)
    if not use.any():
        use[np.argmax(z)] = True
    good = every - bad
    ratio = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))
    return values[use], ratio[use]


def _columns(docs: DataFrame) -> list:
    has = set(docs.columns)
    get = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    return [get("doc_id", "long"), get("text", "string"), get("lang", "string"), get("source", "string"), get("n_chars", "long")]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    order = [F.xxhash64("doc_id"), "doc_id"]
    truth = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.when((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0)).alias("bad"))
    )
    # Ids are chosen first, so that only the sample's texts are read into features.
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    chosen = ids.join(truth, "doc_id").orderBy(*order).limit(labelled)
    others = ids.join(truth, "doc_id", "left_anti").orderBy(*order).limit(pool).withColumn("bad", F.lit(None).cast("int"))
    bad_of = {r["doc_id"]: r["bad"] for r in chosen.union(others).collect()}
    if not bad_of:
        return Model()
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in bad_of], "doc_id long"))  # at most labelled + pool ids
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.binary()), ("layout", pa.list_(pa.float64())), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(schema, [b.column(0), [text_features(t).tobytes() for t in texts], [layout(t) for t in texts], b.column(2), b.column(3), b.column(4)])

    rows = arrow_map(docs.select(*_columns(docs)).join(wanted, "doc_id", "left_semi"), run, "doc_id long, features binary, layout array<double>, lang string, source string, n_chars long").collect()
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=lambda r: bytes(r["features"]))}.values(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    own = [[r for r in rows if (bad_of[r["doc_id"]] is not None) == has] for has in (True, False)]
    parts = [([np.frombuffer(bytes(r["features"]), np.int32) for r in x], [list(r["layout"]) for r in x], [(r["n_chars"], r["lang"], r["source"]) for r in x]) for x in own]
    return fit_views(*parts[0], [bad_of[r["doc_id"]] for r in own[0]], *parts[1])


class Scorer:
    """Probabilities of being bad: of both views and combined."""

    def __init__(self, m: Model):
        self.m = m
        self.of_bucket = {int(k): float(w) for k, w in zip(m.buckets, m.weights, strict=True) if w} if m.trained else {}
        self.of_word: dict[bytes, tuple[float, str]] = {}

    def word(self, w: bytes) -> tuple[int, str]:
        core = w.strip(STRIP)
        return zlib.crc32(core) % BUCKETS, core.decode("utf-8", "replace")[:PREFIX] if len(core) > PREFIX else ""

    def __call__(self, text, lang, source, n_chars) -> tuple[float, float, float]:
        m = self.m
        if not m.trained:
            return 0.0, 0.0, 0.0
        buckets, starts, known = set(), set(), self.of_word
        for w in set((text or "").lower().encode("utf-8", "surrogatepass").split()):
            f = known.get(w)
            if f is None:
                k, s = self.word(w)
                k2 = zlib.crc32(s.encode(), 1) % BUCKETS if s else -1
                f = (k if k in self.of_bucket else -1, k2 if k2 in self.of_bucket else -1)
                if len(known) < CACHE:
                    known[w] = f
            buckets.add(f[0])
            starts.add(f[1])
        buckets |= starts
        buckets.discard(-1)
        shape = float(m.layout_weights[bins(layout(text), m.edges)].sum())
        t = m.text_scale[0] * (math.fsum(self.of_bucket[b] for b in buckets) + shape + m.text_bias) + m.text_scale[1]
        d = m.meta_scale[0] * (float(m.meta_weights[m.meta_row(n_chars, lang, source)].sum()) + m.meta_bias) + m.meta_scale[1]
        return float(sigmoid(t)), float(sigmoid(d)), float(sigmoid(t + d - m.prior))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, text_score, metadata_score, quality_score (chances of being good), kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_score", pa.float64()), ("metadata_score", pa.float64()), ("quality_score", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            p = [scorer(*row) for row in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            yield batch(schema, [b.column(0), *([1 - x[i] for x in p] for i in range(3)), [1 - x[2] >= threshold for x in p]])

    return arrow_map(docs.select(*_columns(docs)), run, "doc_id long, text_score double, metadata_score double, quality_score double, kept boolean")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    names = docs.columns
    at = {c: names.index(c) for c in ("text", "lang", "source", "n_chars") if c in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            cols = [b.column(at[c]).to_pylist() if c in at else [None] * b.num_rows for c in ("text", "lang", "source", "n_chars")]
            yield b.filter(pa.array([1 - scorer(*row)[2] >= threshold for row in zip(*cols, strict=True)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

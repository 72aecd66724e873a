"""Brown class-based bigram language model.

P(word | word before) = P(class | class before) * P(word | class).  Exchange clustering finds the
classes.  The most frequent words are exchanged first, one by one, which seeds the classes; then passes
over the whole vocabulary follow: each counts, for every training word, its neighbours by class, and every
word, frequent or not, moves to the class that raises the class bigrams' mutual information most, all by
the same exact gain, in parallel.  Passes end when the mutual information settles; one that lowers it is
taken back.  Class transitions are smoothed towards class frequencies.  Words give up part of their counts to
words that training never saw, whose share is spread over spellings by a byte bigram model of the training words.

Work is columnar: a block of documents and a part of the vocabulary exchange arrays, so rows in shuffles
are blocks times parts, whatever the number of tokens.  A word that is crowded in a block sends a
histogram of its neighbours.

Edge cases: a null or empty text is the end token alone; texts of any length are scored whole;
repeated rows count and score each time; a null id counts as a training document; without
training documents the score is the base score; an empty table gives no rows; extra columns are ignored.
Of classes that gain equally, a word keeps its own, else takes the first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, drop, release, shuffle_count, stored, table, workspace

#: Classes; words that seed them, from at most (HEAD + 2)^2 counts; rounds over these.
CLASSES, HEAD, PASSES = 48, 1000, 6
#: Passes over the whole vocabulary end when one adds less than this share of the mutual information.
SETTLED = 0.05
#: Count that each word gives up to unseen words of its class.
DISCOUNT = 0.5
#: A block of documents ends with so many distinct words or tokens.
BLOCK_WORDS, BLOCK_TOKENS = 400_000, 4_000_000
#: Words of a part whose gains are computed at once; counts up to SMALL are looked up.
STEP, SMALL = 16_384, 8


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case; runs of characters other than space and tab to carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _training() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1


def _i4(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


# Blocks of documents and parts of the vocabulary


BLOCKED = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()), ("ids", pa.binary()), ("part", pa.int32()), ("words", pa.binary()), ("n", pa.binary())])
BLOCKED_SQL = "kind string, block long, doc_id long, training boolean, ids binary, part int, words binary, n binary"


def blocks_of(docs: DataFrame, parts: int) -> DataFrame:
    """Documents as numbers of their block's words, and each block's words with their training counts.

    A block is a scan partition, or a piece of one once its words or tokens are many; nothing is shuffled.
    Rows of kind ``doc`` hold doc_id, training and ids; those of kind ``word`` hold one part's words, joined by spaces,
    their numbers (ids) and counts (n).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 20
        index: dict[bytes, int] = {}
        counts, tokens = np.zeros(0, np.int64), 0

        def dictionary() -> pa.RecordBatch:
            names = list(index)
            part = np.array([zlib.crc32(w) % parts for w in names])
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    rows.append(("word", block, None, None, own.astype(np.int32).tobytes(), p, b" ".join([names[i] for i in own.tolist()]), counts[own].tobytes()))
            return batch(BLOCKED, [list(c) for c in zip(*rows, strict=True)])

        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            while rows:
                out, used = [], []
                for doc, text, training in rows:
                    ids = np.array([index.setdefault(w, len(index)) for w in words_of(text)], np.int32)
                    tokens += len(ids)
                    out.append((doc, training, ids.tobytes()))
                    if training:
                        used.append(ids)
                    if len(index) > BLOCK_WORDS or tokens > BLOCK_TOKENS:
                        break
                rows = rows[len(out) :]
                counts = np.concatenate([counts, np.zeros(len(index) - len(counts), np.int64)])
                if used:
                    counts += np.bincount(np.concatenate(used), minlength=len(counts))
                m, none = len(out), pa.nulls(len(out))
                doc, training, ids = (list(c) for c in zip(*out, strict=True))
                yield batch(BLOCKED, [["doc"] * m, [block] * m, doc, training, ids, none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())])
                if len(index) > BLOCK_WORDS or tokens > BLOCK_TOKENS:
                    if index:
                        yield dictionary()
                    index.clear()
                    counts, tokens = np.zeros(0, np.int64), 0
                    block += 1
        if index:
            yield dictionary()

    return arrow_map(docs.select("doc_id", "text", "training"), run, BLOCKED_SQL)


PARTS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("local", pa.binary()), ("index", pa.binary()), ("n", pa.binary()), ("spelled", pa.binary()), ("chars", pa.binary())])
PARTS_SQL = "kind string, part int, block long, local binary, index binary, n binary, spelled binary, chars binary"


def byte_pairs(words: list[bytes]) -> np.ndarray:
    """Counts of neighbouring bytes in the words; 256 stands for both ends."""
    out = np.zeros(257 * 257, np.int64)
    if words:
        sizes = np.array([len(w) for w in words])
        text = np.full(sizes.sum() + len(words) + 1, 256, np.int64)
        text[np.delete(np.arange(len(text)), np.append(0, np.cumsum(sizes + 1)))] = np.frombuffer(b"".join(words), np.uint8)
        out += np.bincount(text[:-1] * 257 + text[1:], minlength=len(out))
    return out


def parts_of(dictionary: DataFrame) -> DataFrame:
    """The vocabulary by parts: a row of kind ``part`` with all its words, counts and byte pairs, and a row for each block.

    A block's row holds its numbers of the part's words, their places in the part, their counts over all training
    documents, and the spellings of those that training never saw.
    """

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        names = [x.split(b" ") for x in t.column("words").to_pylist()]
        every = sorted({w for own in names for w in own})
        at = {w: i for i, w in enumerate(every)}
        total, places = np.zeros(len(every), np.int64), []
        for own, n in zip(names, t.column("n").to_pylist(), strict=True):
            places.append(np.array([at[w] for w in own]))
            total[places[-1]] += np.frombuffer(n, np.int64)
        rows = [("part", part, -1, None, None, total.tobytes(), b" ".join(every), byte_pairs([w for w, n in zip(every, total.tolist(), strict=True) if n]).tobytes())]
        for block, local, place in zip(t.column("block").to_pylist(), t.column("ids").to_pylist(), places, strict=True):
            order = np.argsort(place)
            place = place[order]
            n = total[place]
            new = b" ".join([every[i] for i in place[n == 0].tolist()])
            rows.append(("block", part, block, _i4(local)[order].tobytes(), place.astype(np.int32).tobytes(), n.tobytes(), new, None))
        return pa.Table.from_batches([batch(PARTS, [list(c) for c in zip(*rows, strict=True)])])

    return dictionary.select("block", "ids", "part", "words", "n").groupBy("part").applyInArrow(run, PARTS_SQL)


class Block:
    """A block's words: where they stand in their parts, and the class or code of each."""

    def __init__(self, words: pa.Table):
        kinds = words.column("kind").to_pylist()
        part, cls = words.column("part").to_pylist(), {}
        if "classes" in words.column_names:
            cls = {p: c for p, c, kind in zip(part, words.column("classes").to_pylist(), kinds, strict=True) if kind == "classes"}
        own = sorted((p, i) for i, (p, kind) in enumerate(zip(part, kinds, strict=True)) if kind == "block")
        take = lambda name: [words.column(name)[i].as_py() for _, i in own]
        self.parts = [p for p, _ in own]
        self.index = [_i4(x) for x in take("index")]
        self.local = np.concatenate([_i4(x) for x in take("local")] or [np.zeros(0, np.int32)])
        self.n = np.concatenate([np.frombuffer(x, np.int64) for x in take("n")] or [np.zeros(0, np.int64)])
        self.spelled = take("spelled")
        self.ends = np.cumsum([len(x) for x in self.index])
        self.classes = np.concatenate([np.frombuffer(cls[p], np.uint8) for p in self.parts]).astype(np.int64) if cls else None

    def stream(self, docs: pa.Table, code: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Training texts as one row of places in the block's words, -1 at ends, and their codes."""
        place = np.full(len(self.local) + 1, -1, np.int64)
        place[self.local] = np.arange(len(self.local))
        stop = np.array([-1], np.int32)
        ids = np.concatenate([stop, *(x for raw in docs.column("ids").to_pylist() for x in (_i4(raw), stop))])
        at = place[ids]
        return at, np.append(code, end)[at]


def _meet(texts: DataFrame, words: DataFrame, run, schema: str) -> DataFrame:
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, schema)


# Exchange clustering


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int = CLASSES, passes: int = PASSES, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the frequent words, and class bigram counts; the last two words keep classes of their own.

    From the classes ``start`` of the frequent words, the symbols after them are all other words by class, and the end.

    Each word in turn moves to the class that raises sum f(N(a,b)) - sum f(N(a,.)) - sum f(N(.,b)) most, f(x) = x log x.
    """
    m = len(counts) - 2 if start is None else len(start)
    k = max(1, min(classes, m)) if start is None else len(counts) - m - 1
    own = np.append(np.arange(m) % k, [k, k + 1]) if start is None else np.concatenate([start, np.arange(k), [k + 1]])
    hot = np.eye(k + 2)[own]
    table = hot.T @ counts @ hot
    for _ in range(passes):
        moved = 0
        for w in range(m):
            row, col, twice = counts[w] @ hot, counts[:, w] @ hot, counts[w, w]
            row[own[w]] -= twice
            col[own[w]] -= twice
            a = own[w]
            table[a] -= row
            table[:, a] -= col
            table[a, a] -= twice
            block, block_t = table[:k], table[:, :k].T
            gain = (xlogx(block + row) - xlogx(block)).sum(axis=1) + (xlogx(block_t + col) - xlogx(block_t)).sum(axis=1)
            d = np.arange(k)
            at, r, c = block[d, d], row[:k], col[:k]
            gain += xlogx(at + r + c + twice) - xlogx(at + r) - xlogx(at + c) + xlogx(at)
            # Counts between w and a class belong to that class's sums wherever w goes.
            sums_r, sums_c = table.sum(axis=1)[:k] + c, table.sum(axis=0)[:k] + r
            n_r, n_c = row.sum() + twice, col.sum() + twice
            gain -= xlogx(sums_r + n_r) - xlogx(sums_r) + xlogx(sums_c + n_c) - xlogx(sums_c)
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            moved += best != a
            hot[w, a], hot[w, best] = 0, 1
            own[w] = best
            table[best] += row
            table[:, best] += col
            table[best, best] += twice
        if not moved:
            break
    return own[:m], table


def information(table: np.ndarray) -> float:
    """Mutual information of neighbouring classes in natural units, from their counts."""
    n = table.sum()
    return float((xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum() + xlogx(n)) / n) if n else 0.0


def head_bigrams(texts: DataFrame, places: DataFrame, head: dict[int, tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Counts of neighbours among the ``m`` frequent words, all others together, and the end: at most (m + 2)^2."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    size = m + 2

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        own = Block(words)
        code = np.concatenate([_head_code(p, i, head, m) for p, i in zip(own.parts, own.index, strict=True)] or [np.zeros(0, np.int64)])
        _, codes = own.stream(docs, code, m + 1)
        pair, n = np.unique(codes[:-1] * size + codes[1:], return_counts=True)
        return pa.Table.from_arrays([pa.array(pair), pa.array(n)], schema=schema)

    rows = _meet(texts, places, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size**2)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def _head_code(part: int, index: np.ndarray, head: dict, other: int) -> np.ndarray:
    """For places of a part the frequent words' codes, else ``other``."""
    code = np.full(len(index), other, np.int64)
    if part in head and len(index):
        places, codes = head[part]
        at = np.minimum(np.searchsorted(index, places), len(index) - 1)
        hit = index[at] == places
        code[at[hit]] = codes[hit]
    return code


CLASSED = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("classes", pa.binary())])
CLASSED_SQL = "kind string, part int, block long, classes binary"


def first_classes(places: DataFrame, head: dict, groups: np.ndarray, k: int) -> DataFrame:
    """Classes to start from: the frequent words have theirs, all others share class ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.append(groups, k)
        for b in batches:
            part, block, index, n = (b.column(i).to_pylist() for i in range(4))
            index = [_i4(i) if i is not None else np.arange(len(x) // 8, dtype=np.int32) for i, x in zip(index, n, strict=True)]
            yield batch(CLASSED, [["classes"] * b.num_rows, part, block, [of[_head_code(p, i, head, len(groups))].astype(np.uint8).tobytes() for p, i in zip(part, index, strict=True)]])

    return arrow_map(places.select("part", "block", "index", "n"), run, CLASSED_SQL)


AROUND = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("index", pa.binary()), ("n", pa.binary()), ("around", pa.binary()), ("crowded", pa.binary()), ("histogram", pa.binary()), ("classes", pa.binary()), ("table", pa.binary())])
AROUND_SQL = "part int, block long, index binary, n binary, around binary, crowded binary, histogram binary, classes binary, table binary"


def neighbours(texts: DataFrame, places: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """For each block and part the classes around every training token, by word; and each block's counts of class pairs (part -1)."""
    end, width = k + 1, k + 2

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        own = Block(words)
        at, code = own.stream(docs, own.classes if own.classes is not None else np.zeros(0, np.int64), end)
        pairs = np.bincount(code[:-1] * width + code[1:], minlength=width * width)
        rows = [(-1, -1, None, None, None, None, None, None, pairs.tobytes())]
        tokens = np.flatnonzero(at >= 0)
        place = at[tokens]
        near = np.stack([code[tokens - 1], code[tokens + 1]], axis=1)
        count = np.bincount(place, minlength=len(own.local))
        crowded = count > 2 * width
        of_crowded = np.cumsum(crowded) - 1
        hot = crowded[place]
        cell = of_crowded[place[hot]] * (2 * width)
        histogram = np.bincount(np.concatenate([cell + near[hot, 0], cell + width + near[hot, 1]]), minlength=int(crowded.sum()) * 2 * width).reshape(-1, 2 * width)
        place, near = place[~hot], near[~hot].astype(np.uint8)
        near = near[np.argsort(place, kind="stable")]
        count[crowded] = 0
        stops = np.cumsum(count)
        a = t = h = 0
        for p, index, z in zip(own.parts, own.index, own.ends, strict=True):
            u = int(stops[z - 1])
            more = int(crowded[a:z].sum())
            rows.append((p, int(docs.column("block")[0].as_py()) if len(docs) else int(words.column("block")[0].as_py()), index.tobytes(), count[a:z].astype(np.int32).tobytes(), near[t:u].tobytes(), index[crowded[a:z]].tobytes(), histogram[h : h + more].tobytes(), own.classes[a:z].astype(np.uint8).tobytes(), None))
            a, t, h = z, u, h + more
        return pa.Table.from_batches([batch(AROUND, [list(c) for c in zip(*rows, strict=True)])])

    both = places.filter("kind = 'block'").select("kind", "part", "block", "local", "index", "n", "spelled", F.lit(None).cast("binary").alias("classes"))
    both = both.union(classes.filter("block >= 0").select("kind", "part", "block", *[F.lit(None).cast("binary").alias(c) for c in ("local", "index", "n", "spelled")], "classes"))
    return _meet(texts, both, run, AROUND_SQL)


def gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """What sum f(N(a,b)) - sum f(N(a,.)) - sum f(N(.,b)), f(x) = x log x, gains when words without a class enter each of k classes.

    ``left`` and ``right`` count the classes before and after each word, ``own`` is its present class, which ``table`` still counts it in.
    """
    n_words, t = len(left), table
    out = np.zeros((n_words, k))
    for counts, base in ((right, t[:k].T), (left, t[:, :k])):  # base[d, c]: pairs of class c with neighbour d
        for r in range(1, SMALL + 1):
            hit = counts == r
            if hit.any():
                out += hit.astype(np.float32) @ (xlogx(base + r) - xlogx(base)).astype(np.float32)
        w, d = np.nonzero(counts > SMALL)
        for i in range(0, len(w), 100_000):
            ww, dd = w[i : i + 100_000], d[i : i + 100_000]
            np.add.at(out, ww, xlogx(base[dd] + counts[ww, dd][:, None]) - xlogx(base[dd]))
    size = right.sum(axis=1)
    row, col = t.sum(axis=1), t.sum(axis=0)
    # The word still counts in its neighbours' pairs with its own class: take it out there.
    at, c = np.arange(n_words), np.arange(k)
    ra, la = right[at, own][:, None], left[at, own][:, None]
    for add, gone, held in ((ra, left[:, :k], t[:k][:, own].T), (la, right[:, :k], t[own][:, :k])):
        less = np.maximum(held - gone, 0)
        out += xlogx(less + add) - xlogx(less) - (xlogx(held + add) - xlogx(held))
    # Pairs within the new class take the neighbours of both sides.
    both, r, l = t[c, c], right[:, :k], left[:, :k]
    out += xlogx(both + r + l) - xlogx(both + r) - xlogx(both + l) + xlogx(both)
    n = size[:, None]
    out -= xlogx(row[:k] + n) - xlogx(row[:k]) + xlogx(col[:k] + n) - xlogx(col[:k])
    # The present class: what it would lose.
    inside = own < k
    i, a = at[inside], own[inside]
    if len(i):
        tr, tl = t[a], t[:, a].T
        gone_r, gone_l = np.minimum(right[i], tr), np.minimum(left[i], tl)
        stay = (xlogx(tr) - xlogx(tr - gone_r)).sum(axis=1) + (xlogx(tl) - xlogx(tl - gone_l)).sum(axis=1)
        m = np.arange(len(i))
        # Pairs within the class are in both sums: count them once, with both sides taken out.
        inner, both = tr[m, a], np.minimum(right[i, a] + left[i, a], tr[m, a])
        stay -= 2 * xlogx(inner) - xlogx(inner - gone_r[m, a]) - xlogx(inner - gone_l[m, a])
        stay += xlogx(inner) - xlogx(inner - both)
        s = size[inside]
        stay -= xlogx(row[a]) - xlogx(np.maximum(row[a] - s, 0)) + xlogx(col[a]) - xlogx(np.maximum(col[a] - s, 0))
        out[i, a] = stay
    return out


def exchanged(around: DataFrame, table: np.ndarray, k: int) -> DataFrame:
    """Classes after a pass: every word of every part in the class that gains most."""
    width = k + 2

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        get = lambda name, kind: [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
        index, classes = get("index", np.int32), get("classes", np.uint8)
        size = int(max((x.max(initial=-1) for x in index), default=-1)) + 1
        own = np.zeros(size, np.int64)
        for i, c in zip(index, classes, strict=True):
            own[i] = c
        place = np.concatenate([np.repeat(i, n) for i, n in zip(index, get("n", np.int32), strict=True)])
        near = np.concatenate(get("around", np.uint8)).reshape(-1, 2)
        crowded, histogram = np.concatenate(get("crowded", np.int32)), np.concatenate(get("histogram", np.int64)).reshape(-1, 2 * width)
        new = own.copy()
        for lo in range(0, size, STEP):
            rows = min(STEP, size - lo)
            use = (place >= lo) & (place < lo + rows)
            cell = (place[use] - lo).astype(np.int64) * (2 * width)
            counts = np.bincount(np.concatenate([cell + near[use, 0], cell + width + near[use, 1]]), minlength=rows * 2 * width).reshape(rows, 2 * width)
            use = (crowded >= lo) & (crowded < lo + rows)
            np.add.at(counts, crowded[use] - lo, histogram[use])
            known = counts.any(axis=1)
            if not known.any():
                continue
            counts, mine = counts[known].astype(float), own[lo : lo + rows][known]
            gain = gains(counts[:, :width], counts[:, width:], mine, table, k)
            best = gain.argmax(axis=1)
            inside = np.flatnonzero(mine < k)
            stays = inside[gain[inside, best[inside]] <= gain[inside, mine[inside]] + 1e-9]
            best[stays] = mine[stays]
            new[lo + np.flatnonzero(known)] = best
        rows = [("classes", part, b, new[i].astype(np.uint8).tobytes()) for b, i in zip(t.column("block").to_pylist(), index, strict=True)]
        rows.append(("classes", part, -1, new.astype(np.uint8).tobytes()))
        return pa.Table.from_batches([batch(CLASSED, [list(c) for c in zip(*rows, strict=True)])])

    return around.filter("part >= 0").select("part", "block", "index", "n", "around", "crowded", "histogram", "classes").groupBy("part").applyInArrow(run, CLASSED_SQL)


def _pair_table(around: DataFrame, k: int) -> np.ndarray:
    """The sum of all blocks' class pairs."""
    size = (k + 2) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    rows = arrow_map(around.filter("part = -1").select("table"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(k + 2, k + 2)


def settle(texts: DataFrame, places: DataFrame, classes: DataFrame, k: int, path: str) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Passes until the mutual information settles: (classes, counts of class pairs, information of each pass)."""
    found: list[float] = []
    kept: tuple[DataFrame, np.ndarray] | None = None
    while True:
        at = len(found)
        around = stored(neighbours(texts, places, classes, k), f"{path}/around-{at}", free=True)
        pairs = _pair_table(around, k)
        found.append(information(pairs))
        # The first pass has all tail words in one class; its information is not compared.
        if at > 1 and found[-1] < found[-2]:
            return (*kept, found)
        if at > 1 and found[-1] <= found[-2] * (1 + SETTLED):
            return classes, pairs, found
        kept = (classes, pairs)
        classes = stored(exchanged(around, pairs, k), f"{path}/classes-{at + 1}", free=True)
        drop(texts.sparkSession, f"{path}/around-{at}")


# The model


@dataclass
class ClassModel:
    """Numbers of the model; as large as the number of classes squared and of bytes squared."""

    train_tokens: int
    distinct: int
    ends: int
    totals: np.ndarray  # tokens of each class
    sizes: np.ndarray  # words of each class
    chars: np.ndarray  # log10 chances of a byte after another, 256 for both ends
    log_p: np.ndarray | None = None  # transitions, last two rows and columns: end, unseen

    @property
    def k(self) -> int:
        return len(self.totals)

    def fit_transitions(self, counts: np.ndarray) -> None:
        k = self.k
        order = [*range(k), k + 1]  # counts have a spare class before the end
        counts = counts[np.ix_(order, order)]
        prior = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * (k + 1))
        p = (counts + (k + 1) * prior) / (counts.sum(axis=1, keepdims=True) + k + 1)
        p = np.vstack([p, prior])  # after an unseen word, class frequencies
        unseen = np.where(self.totals > 0, DISCOUNT * self.sizes / np.maximum(self.totals, 1), 1.0)
        self.log_p = np.log10(np.column_stack([p, p[:, :k] @ unseen]))


def char_model(pairs: np.ndarray) -> np.ndarray:
    """log10 chances of byte pairs, each byte's followers smoothed by one for every byte and the end."""
    pairs = pairs.reshape(257, 257) + 1.0
    pairs[256, 256] = 1e-300  # no word is empty
    return np.log10(pairs / pairs.sum(axis=1, keepdims=True))


def spelling(words: list[bytes], chars: np.ndarray) -> np.ndarray:
    """log10 chances of the words' spellings."""
    if not words:
        return np.zeros(0)
    sizes = np.array([len(w) for w in words])
    text = np.full(sizes.sum() + len(words) + 1, 256, np.int64)
    stops = np.append(0, np.cumsum(sizes + 1))
    text[np.delete(np.arange(len(text)), stops)] = np.frombuffer(b"".join(words), np.uint8)
    steps = chars[text[:-1], text[1:]]
    return np.add.reduceat(steps, stops[:-1])


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("known_score", pa.float64())])


def scored(texts: DataFrame, places: DataFrame, classes: DataFrame | None, model: ClassModel) -> DataFrame:
    """Per document: counts, base score, score, and the part of the score that is due to known words."""
    n, v, k = model.train_tokens, model.distinct, model.k

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not len(docs):
            return SCORED.empty_table()
        own = Block(words)
        size = len(own.local)
        count, code, emit = np.zeros(size), np.full(size, k + 1, np.int64), np.zeros(size + 1)
        seen = own.n > 0
        count[own.local] = own.n
        if n:
            if own.classes is not None and seen.any():
                code[own.local[seen]] = own.classes[seen]
                emit[own.local[seen]] = np.log10((own.n[seen] - DISCOUNT) / model.totals[own.classes[seen]])
            new = [w for x in own.spelled if x for w in x.split(b" ")]
            emit[own.local[~seen]] = spelling(new, model.chars)
        base = np.log10((np.append(count, model.ends) + 0.5) / (n + 0.5 * (v + 1)))
        code = np.append(code, k)
        known = np.append(count > 0, model.ends > 0)
        out = []
        for doc, raw, training in zip(docs.column("doc_id").to_pylist(), docs.column("ids").to_pylist(), docs.column("training").to_pylist(), strict=True):
            ids = np.append(_i4(raw), size)
            first = float(base[ids].sum())
            if n:
                c = np.append(k, code[ids])
                steps = model.log_p[c[:-1], c[1:]] + emit[ids]
                own_score, known_score = float(steps.sum()), float(steps[known[ids]].sum())
            else:
                own_score = known_score = first
            out.append((doc, not training, len(ids), int(known[ids].sum()), n, first, own_score, known_score))
        return pa.Table.from_batches([batch(SCORED, [list(c) for c in zip(*out, strict=True)])])

    both = places.filter("kind = 'block'").select("kind", "part", "block", "local", "index", "n", "spelled", F.lit(None).cast("binary").alias("classes"))
    if classes is not None:
        both = both.union(classes.filter("block >= 0").select("kind", "part", "block", *[F.lit(None).cast("binary").alias(c) for c in ("local", "index", "n", "spelled")], "classes"))
    return _meet(texts, both, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double")


def class_sizes(places: DataFrame, classes: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and words of each class."""
    whole = places.filter("kind = 'part'").select("part", "n").join(classes.filter("block = -1").select("part", "classes"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            for n, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                # A part's last words may lack a training count, and so a class.
                n, c = np.frombuffer(n, np.int64), np.frombuffer(c, np.uint8)
                n = n[: len(c)]
                seen = n > 0
                total += np.bincount(c[seen], n[seen], k).astype(np.int64)[:k]
                words += np.bincount(c[seen], minlength=k)[:k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total), pa.array(words)], names=["class", "n", "words"])

    out = np.zeros((2, k))
    for r in arrow_map(whole, run, "class long, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        out[:, r["class"]] = r["n"], r["words"]
    return out[0], out[1]


def word_classes(places: DataFrame, classes: DataFrame) -> DataFrame:
    """(word, n, class) of every training word."""
    whole = places.filter("kind = 'part'").select("part", "n", "spelled").join(classes.filter("block = -1").select("part", "classes"), "part")
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, names, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                n, c = np.frombuffer(n, np.int64), np.frombuffer(c, np.uint8)
                rows = [(w, m, g) for w, m, g in zip(names.split(b" "), n.tolist(), c.tolist()) if m]
                if rows:
                    yield batch(schema, [list(x) for x in zip(*rows, strict=True)])

    return arrow_map(whole, run, "word binary, n long, class int")


@dataclass
class Trained:
    texts: DataFrame
    places: DataFrame
    classes: DataFrame | None
    model: ClassModel
    information: list[float]

    def scores(self) -> DataFrame:
        return scored(self.texts, self.places, self.classes, self.model)


def frequent(places: DataFrame, most: int) -> list:
    """(word, part, place) of the most frequent training words."""
    schema = pa.schema([("n", pa.int64()), ("word", pa.binary()), ("part", pa.int32()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, bytes, int, int]] = []  # of all parts of the task
        for b in batches:
            for part, n, names in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, names = np.frombuffer(n, np.int64), names.split(b" ")
                top = np.lexsort((np.arange(len(n)), -n))[:most]
                best += [(-int(n[i]), names[i], part, i) for i in top[n[top] > 0].tolist()]
                best = sorted(best)[:most]
        if best:
            n, word, part, place = zip(*best, strict=True)
            yield batch(schema, [[-x for x in n], list(word), list(part), list(place)])

    rows = arrow_map(places.filter("kind = 'part'").select("part", "n", "spelled"), run, "n long, word binary, part int, place int")
    return rows.orderBy(F.desc("n"), "word").limit(most).collect()


def train(docs: DataFrame, classes: int = CLASSES, head_words: int = HEAD) -> Trained:
    """Learn from the documents of all folds but one."""
    spark = docs.sparkSession
    path = workspace(spark, "brown")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _training().alias("training"))
    numbered = blocks_of(docs, 2 * shuffle_count(spark))
    numbered.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/blocks")
    blocks = spark.read.schema(numbered.schema).parquet(f"{path}/blocks")
    texts = blocks.filter("kind = 'doc'").select("block", "doc_id", "training", "ids")
    places = stored(parts_of(blocks.filter("kind = 'word'")), f"{path}/places", free=True)
    drop(spark, f"{path}/blocks/kind=word")
    ends = texts.filter("training").count()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()]
            chars = sum((np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()), np.zeros(257 * 257, np.int64))
            cell = np.flatnonzero(chars)
            cell, amount = np.append(cell, [-1, -2]), np.append(chars[cell], [sum(int((x > 0).sum()) for x in n), sum(int(x.sum()) for x in n)])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(amount)], names=["cell", "n"])

    found = arrow_map(places.filter("kind = 'part'").select("n", "chars"), sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 257^2
    cell, amount = found.column("cell").to_numpy(), found.column("n").to_numpy()
    words, tokens = (int(amount[cell == x].sum()) for x in (-1, -2))
    chars = np.zeros(257 * 257)
    chars[cell[cell >= 0]] = amount[cell >= 0]
    model = ClassModel(tokens + ends, words + (ends > 0), ends, np.zeros(0), np.zeros(0), char_model(chars))
    if not ends:
        return Trained(texts, places, None, model, [])
    top = frequent(places, head_words)
    head: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p in sorted({r["part"] for r in top}):
        own = sorted((r["place"], i) for i, r in enumerate(top) if r["part"] == p)
        head[p] = np.array([x for x, _ in own], np.int32), np.array([i for _, i in own])
    training = texts.filter("training").select("block", "ids")
    block_places = places.filter("kind = 'block'").select("kind", "part", "block", "local", "index", "n", "spelled")
    groups, pairs = exchange(head_bigrams(training, block_places, head, len(top)), classes)
    k = len(pairs) - 2
    start = stored(first_classes(places, head, groups, k), f"{path}/classes-0", free=True)
    own, counts, information_ = settle(training, places, start, k, path)
    model.totals, model.sizes = class_sizes(places, own, k)
    model.fit_transitions(counts)
    return Trained(texts, places, own, model, information_)


def score_documents(docs: DataFrame, classes: int = CLASSES, head_words: int = HEAD) -> DataFrame:
    """Train on the documents of all folds but one and score every document."""
    return train(docs, classes, head_words).scores()


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))

"""Exact removal of long repeats by run-length indexes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Every window
of that length picks its smallest hashed k-gram as its anchor, so equal windows have equal anchors;
a document is cut into stretches of windows with one anchor.  Stretches that occur whole more than once
are counted as such before any shuffle of text.  Of the others only those go on whose anchor, with
half a window to its left or right, occurs again; their bytes are dealt to blocks by anchor.  For each
block a suffix order and its run-compressed Burrows-Wheeler transform are built: samples at run ends
hold, for a text position, the position before it in suffix order and the length of their match.
Matching statistics stream from these samples along the text, one byte shorter for each step, so
samples of at least ``LENGTH`` bytes mark all long matches, at both of their ends.

An anchor with more stretches than a block may hold is settled by counting its windows' 128-bit digests, which
are aggregated before they meet, so that a passage that a third of all documents share crowds no task.

Edge cases: a null or empty text has no bytes; texts of any length are read whole; rows that
repeat a document are each an occurrence; matches never cross documents; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, shuffle_count, stored, table, workspace

LENGTH, GRAM = 400, 32
#: Stretches of one anchor that an index block takes, and stretches that a block should have.
ANCHOR_MOST, BLOCK = 6000, 4000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(2 * len(self.up), n)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    n = len(v)
    pad = -n % width
    full = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def stretches(raw: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM):
    """Stretches of windows with one anchor: arrays of fp, left, right, pos, first and last window start."""
    n = len(raw)
    up, down = powers.get(n + 1)
    t = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * up[:n], dtype=np.uint64)])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams >> np.uint64(32) << np.uint64(32)) | place, length - gram + 1) & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:] - 1, len(least) - 1)
    pos = least[first].astype(np.int64)
    half = (length - gram) // 2

    def of(a, b):
        ok = (a >= 0) & (b <= n)
        a, b = np.where(ok, a, 0), np.where(ok, b, 0)
        return np.where(ok, mix((sums[b] - sums[a]) * down[a]), mix(pos.astype(np.uint64) * np.uint64(BASE) + np.uint64(n)))

    return grams[pos], of(pos - half, pos), of(pos + gram, pos + gram + half), pos, first, last


STRETCH = pa.schema([("fp", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("whole", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def all_stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        np.seterr(over="ignore")
        powers = Powers()
        for b in batches:
            parts = []
            for doc, text_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                fp, left, right, _, first, last = stretches(raw, powers, length, gram)
                view = memoryview(raw)
                whole = pa.array([xxhash.xxh3_128_digest(view[a : z + length]) for a, z in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
                parts.append((fp.view(np.int64), left.view(np.int64), right.view(np.int64), whole, pa.repeat(pa.scalar(doc, pa.int64()), len(fp)), np.full(len(fp), text_hash), first.astype(np.int32), last.astype(np.int32)))
            if parts:
                yield batch(STRETCH, [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*parts, strict=True)])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text")), run, "fp long, left long, right long, whole binary, doc_id long, text_hash long, first int, last int")


# The index of a block


def suffix_order(symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffix array of strings that each end with a symbol 0 of its own (at ``ends``), by prefix doubling.

    Also gives the ranks of all positions by a prefix shorter than ``length``, and that prefix's length.
    """
    n = len(symbols)
    end_of = np.repeat(ends, np.diff(np.append(-1, ends)))
    key, place = np.zeros(n, np.uint64), np.arange(n)
    for j in range(7):
        key = (key << np.uint64(9)) | np.where(place + j <= end_of, symbols[np.minimum(place + j, n - 1)], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    new[: len(ends)] = True  # end symbols sort first; each differs from the others
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    h, kept, kept_h = 7, None, 0
    while True:
        if h <= length:
            kept, kept_h = rank.copy(), h
        open_ = ~new | ~np.append(new[1:], True)
        slots = np.flatnonzero(open_)
        if not len(slots):
            return order, kept, kept_h
        at = order[slots]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + h, end_of[at])].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        key = key[by]
        new[slots] = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new[slots], slots, 0))
        rank[order[slots]] = start
        h *= 2


def match_lengths(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the matches at pairs of positions; an end symbol matches nothing."""
    out, step, n = np.zeros(len(a), np.int64), 64, len(symbols)
    live = np.arange(len(a))
    while len(live):
        i = a[live] + out[live]
        j = b[live] + out[live]
        reach = np.arange(step)
        x, y = symbols[np.minimum(i[:, None] + reach, n - 1)], symbols[np.minimum(j[:, None] + reach, n - 1)]
        same = (x == y) & (x != 0)
        run = np.where(same.all(axis=1), step, np.argmin(same, axis=1))
        out[live] += run
        live = live[run == step]
    return out


def long_matches(strings: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each string, starts and ends of stretches that are covered by matches of at least ``length`` bytes."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[ends] = 0
    order, kept, h = suffix_order(symbols, ends, length)
    # Burrows-Wheeler transform; the symbol before a string's start is the string's own.
    before = symbols[order - 1].astype(np.int64)
    starts = np.append(0, ends[:-1] + 1)
    is_start = np.zeros(len(symbols), bool)
    is_start[starts] = True
    first = is_start[order]
    heads = np.flatnonzero(np.append(False, (before[1:] != before[:-1]) | first[1:] | first[:-1]))
    here, there = order[heads], order[heads - 1]  # samples: a position and its predecessor in suffix order
    end_of = np.repeat(ends, sizes + 1)
    fits = (end_of[here] - here >= length) & (end_of[there] - there >= length)
    here, there = here[fits], there[fits]
    for off in sorted({0, *range(h, length - h + 1, h), length - h}):
        same = kept[here + off] == kept[there + off]
        here, there = here[same], there[same]
    size = match_lengths(symbols, here, there)
    change = np.zeros(len(symbols) + 1, np.int64)
    for at in (here, there):
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
    covered = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(ends, a)
    cut = np.searchsorted(of, np.arange(len(strings) + 1))
    return [(a[i:j] - s, z[i:j] - s) for i, j, s in zip(cut[:-1], cut[1:], starts, strict=True)]


SPAN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
SPAN_SQL = "doc_id long, text_hash long, start int, end int"


def indexed_spans(pieces: DataFrame, length: int, blocks: int) -> DataFrame:
    """Long matches among pieces(fp, doc_id, text_hash, first, body), an index for each block of anchors."""

    def run(t: pa.Table) -> pa.Table:
        found = long_matches(t.column("body").to_pylist(), length)
        rows = [(d, h, f + a, f + z) for d, h, f, (xs, ys) in zip(t.column("doc_id").to_pylist(), t.column("text_hash").to_pylist(), t.column("first").to_pylist(), found, strict=True) for a, z in zip(xs.tolist(), ys.tolist(), strict=True)]
        return pa.Table.from_batches([batch(SPAN, [list(c) for c in zip(*rows, strict=True)])]) if rows else SPAN.empty_table()

    return pieces.withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks))).groupBy("block").applyInArrow(run, SPAN_SQL)


def counted_spans(pieces: DataFrame, length: int, path: str) -> DataFrame:
    """The same for anchors with very many stretches: windows that share a 128-bit digest."""
    schema = pa.schema([("key", pa.binary()), *SPAN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            doc, text_hash, first, body = (b.column(b.schema.names.index(c)).to_pylist() for c in ("doc_id", "text_hash", "first", "body"))
            for d, h, f, x in zip(doc, text_hash, first, body, strict=True):
                m = range(len(x) - length + 1)
                view = memoryview(x)
                keys = pa.array([xxhash.xxh3_128_digest(view[i : i + length]) for i in m], pa.binary())
                yield batch(schema, [keys, pa.repeat(pa.scalar(d, pa.int64()), len(m)), [h] * len(m), [f + i for i in m], [f + i + length for i in m]])

    rows = stored(arrow_map(pieces, run, f"key binary, {SPAN_SQL}"), f"{path}/windows")
    # Counts are a table of their own, so that the join's skewed keys can be split.
    again = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), f"{path}/windows-again")
    return rows.join(again, "key", "left_semi").select("doc_id", "text_hash", "start", "end")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, start, end): byte stretches, perhaps overlapping, that repeats cover."""
    spark = docs.sparkSession
    path = workspace(spark, "rlindex")
    every = stored(all_stretches(docs, length, gram), f"{path}/stretches")

    def again(df: DataFrame, *cols: str) -> DataFrame:
        """Keys that occur more than once, as a table of their own: a join with it can split crowded keys."""
        return stored(df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1").select(*cols), f"{path}/again-{'-'.join(cols)}")

    shared = stored(every.join(again(every, "fp"), "fp", "left_semi"), f"{path}/shared", free=True)
    whole = shared.groupBy("fp", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash", "first", "last", "left", "right")).alias("one"))
    whole = stored(whole, f"{path}/whole")
    full = shared.join(whole.filter("copies > 1").select("fp", "whole"), ["fp", "whole"], "left_semi").select("doc_id", "text_hash", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    # One stretch for each content; of those with copies it stands for all.
    single = whole.select("fp", "copies", "one.*")
    likely = stored(
        single.join(again(single, "fp", "left").withColumn("l", F.lit(True)), ["fp", "left"], "left")
        .join(again(single, "fp", "right").withColumn("r", F.lit(True)), ["fp", "right"], "left")
        .filter("l OR r")
        .select("fp", "copies", "doc_id", "text_hash", "first", "last"),
        f"{path}/likely",
    )
    groups = stored(likely.groupBy("fp").agg(F.count("*").alias("n"), F.min("copies").alias("least")).filter("n > 1 AND least = 1"), f"{path}/groups")
    wanted = likely.join(groups.select("fp", "n"), "fp").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("fp", "n", "first", "last")).alias("cuts"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "cuts")
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("body", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text_hash, text, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows = [(c["fp"], c["n"], doc, text_hash, c["first"], raw[c["first"] : c["last"] + length]) for c in cuts]
                yield batch(schema, [list(c) for c in zip(*rows, strict=True)])

    # A row that repeats a document has copies of all of its stretches; one of them is enough here.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "text", "cuts")
    pieces = stored(arrow_map(joined, cut, "fp long, n long, doc_id long, text_hash long, first int, body binary").dropDuplicates(["fp", "doc_id", "text_hash", "first"]), f"{path}/pieces")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spans = indexed_spans(pieces.filter(F.col("n") <= ANCHOR_MOST), length, max(shuffle_count(spark), -(-total // BLOCK)))
    spans = spans.union(counted_spans(pieces.filter(F.col("n") > ANCHOR_MOST), length, path))
    return full.union(spans)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes that are left if ``with_text``."""
    path = workspace(docs.sparkSession, "rlindex-spans")
    spans = stored(repeated_spans(docs, length), f"{path}/spans")
    lists = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in own or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for a, z in merged:
                    kept.append(raw[at:a])
                    at = z
                left = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            if rows:
                yield batch(schema, [list(c) for c in zip(*rows, strict=True)])

    joined = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "spans")
    return arrow_map(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

"""Near-duplicate detection: one-permutation MinHash with optimal densification.

A document's shingle hashes are dealt to bins by their upper bits; each bin keeps its smallest
hash, and an empty bin copies from a bin that a universal hash of (bin, attempt) finds.  Bands of
bins name buckets; in a bucket, members are compared with its smallest document (a star): first in
a few bands, then in all of them, but only across components.  Members that then still lie in
different components are compared too, so that no link is lost: in small buckets in pairs, in
others where the sets' differences from one document of the bucket's group share enough
rare shingles.  Every link is confirmed on full shingle sets.

Edge cases: a null text, or one without words, has no shingles and is linked with nothing; a
text of fewer words than a shingle is one shingle; equal sets form one class without being
expanded into pairs; rows that share an id are one document with all their links; a null id is
returned unlinked and kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, stored, table, workspace

#: 512 bins in 64 bands of 8: at a similarity of 0.8 a pair shares no band with a chance of 8e-6, at 0.3 one with 0.4 %.
BINS, ROWS_PER_BAND = 512, 8
#: Bands of the first stars, which join most of a group; buckets of so many members are compared in pairs at once.
FIRST_BANDS, PAIRED = 8, 6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CACHE = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = value
        return value


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    total = np.full(len(h) - width + 1, np.uint64(width)) * GOLDEN
    for i in range(width):
        total = mix(total * GOLDEN + h[i : len(h) - width + 1 + i])
    return np.unique(total)


@lru_cache(maxsize=4)
def probes(bins: int) -> np.ndarray:
    """Bins that each empty bin tries, in order."""
    with np.errstate(over="ignore"):
        i = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(4 * bins, dtype=np.uint64)[None, :]
        return (mix(i + GOLDEN) % np.uint64(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation signature with optimal densification of a sorted set."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    starts = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) << shift)
    filled = np.append(starts[1:], len(shingles)) > starts
    value = shingles[np.minimum(starts, len(shingles) - 1)]
    empty, tries = np.flatnonzero(~filled), probes(bins)
    for attempt in range(tries.shape[1]):
        if not len(empty):
            break
        source = tries[empty, attempt]
        ok = filled[source]
        value[empty[ok]] = value[source[ok]]
        empty = empty[~ok]
    else:
        value[empty] = value[np.flatnonzero(filled)[0]]
    return value


def band_hashes(sig: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    bands = sig.reshape(-1, rows)
    h = np.arange(len(bands), dtype=np.uint64) * GOLDEN + np.uint64(1)
    for i in range(rows):
        h = mix(h * GOLDEN + bands[:, i])
    return h.view(np.int64)


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set) and bands of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        np.seterr(over="ignore")
        for b in batches:
            ids, sizes, keys, bands = b.column(0), [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width, hashes)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_hashes(signature(s)) if len(s) else None)
            yield batch(SKETCH, [ids, sizes, keys, bands])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        np.seterr(over="ignore")
        for b in batches:
            yield batch(schema, [b.column(0), [shingle_set(t, width, hashes).tobytes() for t in b.column(1).to_pylist()]])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, shingles binary")


def with_sets(pairs: DataFrame, docs: DataFrame, width: int, path: str) -> DataFrame:
    """pairs(a, b) with both full sets: a, b, x, y."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(full_sets(docs.join(ends, "doc_id", "left_semi"), width).distinct(), f"{path}-sets", "none")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    return left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")


def confirmed(edges: DataFrame, docs: DataFrame, width: int, percent: int, path: str) -> DataFrame:
    """Those of edges(a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], schema=schema)

    return stored(arrow_map(with_sets(edges, docs, width, path), run, "a long, b long").distinct(), f"{path}-links", free=True)


def by_differences(rest: DataFrame, docs: DataFrame, width: int, percent: int, path: str) -> DataFrame:
    """Pairs (a, b) of rest(pivot, doc, component) that may be similar across components.

    With D(x) the symmetric difference of x and the pivot c, two sets are similar only if
    |D(x) & D(y)| >= (|D(x)| + |D(y)| - r (|x| + |y|)) / 2, r = (100 - percent) / (100 + percent).  As sets
    similar to c are of one component, one of the two isn't: |D(y)| > r (|y| + |c|).  So at least
    t = (|D(x)| + r (|c| - |x|)) / 2 elements are shared, and one of the |D(x)| - t + 1 rarest of D(x) is in D(y).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_()), ("rarest", pa.int64()), ("n", pa.int64()), ("elements", pa.list_(pa.int64()))])
    less, more = 100 - percent, 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, rarest, sizes, elements = [], [], [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                c, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                d = np.setxor1d(c, y, assume_unique=True)
                near.append(len(d) * more <= less * (len(c) + len(y)))
                rarest.append(len(d) - max(1, -(-(more * len(d) + less * (len(c) - len(y))) // (2 * more))) + 1)
                sizes.append(len(y))
                elements.append(d.view(np.int64))
            yield batch(schema, [b.column(0), b.column(1), near, rarest, sizes, elements])

    duos = stored(rest.select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct(), f"{path}-duos")
    diffs = stored(arrow_map(with_sets(duos, docs, width, path), run, "a long, b long, near boolean, rarest long, n long, elements array<long>"), f"{path}-diffs", "none")
    labels = rest.select(F.col("pivot").alias("a"), F.col("doc").alias("b"), "component").distinct()
    rows = stored(diffs.join(labels, ["a", "b"]).select("a", "b", "near", "rarest", "n", "component", F.size("elements").alias("d"), F.explode("elements").alias("e")), f"{path}-elements")
    shared = rows.groupBy("a", "e").agg(F.count("*").alias("times")).filter("times > 1")
    # Places by rarity; elements of one set only match nothing and come first.
    met = rows.join(shared, ["a", "e"]).withColumn("left", F.count("*").over(Window.partitionBy("a", "b")))
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy("times", "e")) + F.col("d") - F.col("left"))
    placed = stored(placed.select("a", "e", "b", "near", "rarest", "n", "component", "d", "place"), f"{path}-placed")
    x = placed.filter("place <= rarest").select("a", "e", *(F.col(c).alias(f"{c}_x") for c in ("b", "n", "component", "d", "place")))
    y = placed.filter("NOT near").select("a", "e", *(F.col(c).alias(f"{c}_y") for c in ("b", "n", "component", "d", "place")))
    # From their first shared element on, two differences can share no more than what is left of either.
    most = 1 + F.least(F.col("d_x") - F.col("place_x"), F.col("d_y") - F.col("place_y"))
    enough = most * (2 * more) >= (F.col("d_x") + F.col("d_y")) * more - (F.col("n_x") + F.col("n_y")) * less
    pairs = x.join(y, ["a", "e"]).filter((F.col("component_x") != F.col("component_y")) & enough).select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b"))
    own = diffs.filter("near AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.union(own).distinct()


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links(a, b).

    Alternates large-star and small-star steps; each needs a minimum for each node and a join, no list
    of neighbours.  Tables of each step are written to the shared folder.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}-0")
    before, step = mark(edges), 0
    while before[0]:
        step += 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, f"{path}-{step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small, f"{path}-{step}-small")
        after = mark(edges)
        if after == before:
            break
        before = after
    own = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    path = workspace(spark, "minhash")
    rows = stored(sketches(docs, width), f"{path}/sketches", free=True)
    classes = stored(
        rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        f"{path}/classes",
        free=True,
    )
    # Sets of up to three shingles have no partner but equal sets.
    members = classes.filter("n > 3").select(F.posexplode("bands").alias("band", "bucket"), "doc")
    crowded = members.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("bucket")
    shared = stored(members.join(crowded, "bucket"), f"{path}/shared", free=True)
    sizes = classes.select("doc", "n")
    links = spark.createDataFrame([], "a long, b long")
    checked, found = links, spark.createDataFrame([], "node long, component long")
    for name in ("first", "all", "rest"):
        at = shared.filter(F.col("band") < FIRST_BANDS) if name == "first" else shared
        at = at.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        torn = at.groupBy("bucket").agg(
            F.min("component").alias("pivot"), F.max("component").alias("hi"), F.count("*").alias("size"), F.min(F.struct("doc", "component")).alias("center")
        ).filter("pivot < hi")
        if name != "rest":
            pairs = at.join(torn, "bucket").filter("component <> center.component").select(F.least("doc", "center.doc").alias("a"), F.greatest("doc", "center.doc").alias("b"))
        else:
            rest = stored(at.join(torn.filter("size > 2"), "bucket").select("bucket", "doc", at.component, "pivot", "size"), f"{path}/rest")
            few = rest.filter(F.col("size") <= PAIRED)
            x, y = few.alias("x"), few.alias("y")
            pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component"))).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
            many = rest.filter(F.col("size") > PAIRED)
            if not many.isEmpty():
                pairs = pairs.union(by_differences(many, docs, width, percent, f"{path}/differences"))
        sized = pairs.distinct().join(sizes.withColumnsRenamed({"doc": "a", "n": "m"}), "a").join(sizes.withColumnsRenamed({"doc": "b"}), "b")
        alike = F.least("m", "n") * 100 >= F.greatest("m", "n") * percent
        edges = stored(sized.filter(alike).select("a", "b").join(checked, ["a", "b"], "left_anti"), f"{path}/edges-{name}")
        if edges.isEmpty():
            continue
        checked = checked.union(edges)
        links = links.union(confirmed(edges, docs, width, percent, f"{path}/{name}"))
        found = stored(components(links, f"{path}/components-{name}"), f"{path}/found-{name}")

    by_class = classes.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component_id"))
    return rows.join(by_class, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
        ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common_n >= 80 * (x.k + y.k - common_n)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS low FROM w UNION SELECT sym.b, reach.low FROM reach JOIN sym ON sym.a = reach.node WHERE reach.low < sym.b),
c AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, c.low AS component_id, c.low = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""

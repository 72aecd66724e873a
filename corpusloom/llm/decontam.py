"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

One pass over the corpus stores the token postings (term, document, position) of every term that test
windows hold, and an end mark for each document.  Each window's lists are then intersected from its
rarest term on, shifted by the terms' offsets: the two rarest lists leave candidate starts, and the
lists of all other terms, read in the candidates' documents alone, must hold every other place.  What
is left are exact phrase matches; proximity matches come from the same lists.

Edge cases: a null or empty text has no words; an item shorter than a window is one window; an
item without words has none; repeated documents and items are found each time and positions
count once; an item whose id is null still hits words but isn't listed; empty tables give
no hits; only the named columns of the inputs are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, workspace

WINDOW = 10
#: Sides of joins are broadcast up to so many counted rows and characters, and joined by shuffle beyond.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16 << 20
#: No word is empty, so the empty term can mark ends.
END = ""


def words_of(text: Column) -> Column:
    """ASCII lower case; runs of characters other than ASCII punctuation, spaces and controls."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words) of each document; the pair names a document's text."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every window of each item: item_id, win (its words)."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return words.select("item_id", "w", F.explode(starts).alias("p")).select("item_id", F.slice("w", F.col("p"), window).alias("win")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table only if its counted rows and characters stay under the limits."""
    size = df.agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("chars")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and (size["chars"] or 0) <= BROADCAST_CHARS else df


def vocabulary_of(windows: DataFrame) -> DataFrame:
    """(term, term_id) of every term of the windows, and of the end mark."""
    terms = windows.select(F.explode("win").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id() + 1)
    return terms.union(windows.sparkSession.createDataFrame([(END, 0)], "term string, term_id long"))


def build_postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term_id, doc_id, text_hash, pos) of the vocabulary; that of the end mark has the document's length as pos."""
    words = F.concat(F.coalesce(F.col("words"), F.array().cast("array<string>")), F.array(F.lit(END)))
    every = _tokens(docs).select("doc_id", "text_hash", F.posexplode(words).alias("pos", "term"))
    return every.join(_small(vocabulary), "term").select("term_id", "doc_id", "text_hash", "pos")


def rarest_first(windows: DataFrame, vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its places from the rarest term on: win_id, win, places (array of n, term_id, o).

    Windows with a term that the corpus lacks can't occur and are left out.
    """
    own = windows.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id())
    placed = own.select("win", "win_id", F.posexplode("win").alias("o", "term")).join(vocabulary, "term").join(counts, "term_id", "left")
    ranked = placed.groupBy("win_id").agg(
        F.first("win").alias("win"), F.sort_array(F.collect_list(F.struct("n", "term_id", "o"))).alias("places"), F.count("n").alias("known")
    )
    return ranked.filter(F.col("known") == F.size("win")).select("win_id", "win", "places")


def _starts(postings: DataFrame, chosen: DataFrame, nth: int) -> DataFrame:
    """Starts of windows that the lists of their ``nth`` rarest terms allow."""
    place = F.get("places", F.lit(nth))
    term = chosen.select("win_id", place["term_id"].alias("term_id"), place["o"].alias("o")).filter("term_id IS NOT NULL")
    found = postings.join(_small(term), "term_id").select("win_id", "doc_id", "text_hash", (F.col("pos") - F.col("o")).alias("start"))
    return found.filter("start >= 0").distinct()


def _same(a: DataFrame, b: DataFrame, *names: str):
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[c])
    return on


def phrase_matches(postings: DataFrame, chosen: DataFrame, path: str) -> DataFrame:
    """Exact places of windows: win_id, doc_id, text_hash, start."""
    at = ("win_id", "doc_id", "text_hash", "start")
    first, second = _starts(postings, chosen, 0), _starts(postings, chosen, 1)
    both = first.join(second, _same(first, second, *at), "left_semi")
    single = chosen.filter(F.size("places") == 1).select(F.col("win_id").alias("w"))
    both = stored(both.union(first.join(_small(single), F.col("win_id") == F.col("w"), "left_semi")), f"{path}/candidates")
    # What the other terms' lists must hold for a candidate, and what they hold in candidates' documents.
    others = chosen.select("win_id", F.explode(F.slice("places", 3, F.greatest(F.size("places") - 2, F.lit(1)))).alias("p")).select("win_id", "p.term_id", "p.o")
    expected = both.join(_small(others), "win_id").select(*at, "term_id", (F.col("start") + F.col("o")).alias("pos"))
    where = stored(both.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct(), f"{path}/where")
    held = postings.filter("term_id > 0").join(_small(where), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left_semi").distinct()
    missing = expected.join(held, _same(expected, held, "doc_id", "text_hash", "pos", "term_id"), "left_anti").select(*at).distinct()
    return both.join(missing, _same(both, missing, *at), "left_anti")


def proximity_matches(postings: DataFrame, vocabulary: DataFrame, term_a: str, term_b: str, slop: int) -> DataFrame:
    """Documents in which two indexed terms stand at most ``slop`` places apart."""
    named = lambda term, name: postings.join(_small(vocabulary.filter(F.col("term") == term)), "term_id").select("doc_id", "text_hash", F.col("pos").alias(name))
    a, b = named(term_a, "pos_a"), named(term_b, "pos_b")
    # Places are joined by cell of ``slop`` words, so that no document's places are all paired.
    cell = lambda c: F.floor(c / F.lit(max(slop, 1)))
    near = a.withColumn("cell", F.explode(F.array(*[cell(F.col("pos_a")) + d for d in (-1, 0, 1)]))).join(b.withColumn("cell", cell(F.col("pos_b"))), ["doc_id", "text_hash", "cell"])
    return near.filter((F.abs(F.col("pos_a") - F.col("pos_b")) <= slop) & (F.col("pos_a") != F.col("pos_b"))).drop("cell")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    path = workspace(spark, "decontam")
    windows = stored(test_windows(items, window), f"{path}/windows")
    vocabulary = stored(vocabulary_of(windows), f"{path}/terms")
    postings = stored(build_postings(docs, vocabulary), f"{path}/postings")
    counts = stored(postings.groupBy("term_id").agg(F.count("*").alias("n")), f"{path}/counts")
    chosen = stored(rarest_first(windows, vocabulary, counts), f"{path}/chosen")
    places = stored(phrase_matches(postings, chosen, path).join(_small(chosen.select("win_id", "win")), "win_id").drop("win_id"), f"{path}/places")
    key = ["doc_id", "text_hash"]
    hit = places.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.size("win") - 1)).alias("pos")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    listed = (
        places.select(*key, "win")
        .distinct()
        .join(_small(windows), "win")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    found = hit.join(listed, (hit.doc_id.eqNullSafe(listed.doc_id)) & hit.text_hash.eqNullSafe(listed.text_hash)).select(hit.doc_id.alias("found_id"), hit.text_hash.alias("found_hash"), "n_hit", "ids")
    # The end marks are the documents and their lengths.
    all_docs = postings.filter("term_id = 0").select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return all_docs.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & F.col("text_hash").eqNullSafe(F.col("found_hash")), "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP5_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
items AS (
  SELECT DISTINCT id AS item_id, array_to_string(words[p:p + 9], ' ') AS win, least(10, len(words)) AS n
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p) WHERE side = 'i' AND len(words) > 0),
sizes AS (SELECT DISTINCT n FROM items),
found AS (
  SELECT d.doc_id, d.p, d.n, i.item_id
  FROM (SELECT id AS doc_id, n, unnest(range(1, len(words) - n + 2)) AS p, words FROM w CROSS JOIN sizes WHERE side = 'd') d
  JOIN items i ON i.n = d.n AND i.win = array_to_string(d.words[d.p:d.p + d.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, LATERAL (SELECT unnest(range(p, p + n)) AS q) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT w.id AS doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.id LEFT JOIN ids ON ids.doc_id = w.id WHERE side = 'd'
"""

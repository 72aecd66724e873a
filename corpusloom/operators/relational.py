"""Filters, set operations and joins of the knowledge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.tables import checkpointed


#: Phrases that are broadcast to the scan of texts, of ten words on average at most.
PHRASES_MOST = 200_000
#: Parts among which pairs of titles are dealt to be compared.
COMPARED = 200


#: Rows of a part that ``dealt`` makes, about.
PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys to as many parts as their number asks for; adaptive plans merge parts of narrow rows to few large ones."""
    return df.repartition(df.count() // PART_ROWS + 1, *keys)


def latest_per_key(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of each key's row that is last in ``order``; one partial aggregation, no self join."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``gone``."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def within_scope(df: DataFrame, work: str, sources: list | None = None, work_set: list | None = None, excluded: list | None = None) -> DataFrame:
    """Rows of the source works and of the work set, without excluded works.

    Rows without a work go as soon as any of these is active.
    """
    keep = F.lit(True)
    if sources:
        keep = keep & F.col(work).isin(sources)
    if work_set:
        keep = keep & F.col(work).isin(work_set)
    if excluded:
        keep = keep & ~F.col(work).isin(excluded)
    return df.filter(F.coalesce(keep, F.lit(False)))


def repeated_margins(df: DataFrame, doc: str, kind: str, page: str, text: str) -> DataFrame:
    """Rows whose kind and text stand on at least two pages of a document: running headers and footers."""
    norm = T.match_text(F.col(text))
    # A 128-bit digest stands for the text, so that lines aren't shuffled.
    hits = df.withColumn("norm", norm).filter("norm <> ''").withColumn("norm", F.unhex(F.md5("norm")))
    many = hits.groupBy(doc, kind, "norm").agg((F.min(page) < F.max(page)).alias("many")).filter("many").drop("many")
    return hits.join(many, [doc, kind, "norm"], "left_semi").drop("norm")


def adjacent_duplicates(df: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Rows whose text equals the last non-empty one before them."""
    own = df.withColumn("norm", T.squeeze(F.lower(text))).filter("norm <> ''")
    return own.withColumn("prior", F.lag("norm").over(Window.partitionBy(doc).orderBy(order))).filter("norm = prior").drop("norm", "prior")


def bad_provenance(df: DataFrame, id_col: str, sources: str, valid: DataFrame, valid_id: str) -> DataFrame:
    """Ids of rows with no sources, or with a source that isn't a valid id."""
    one = df.select(id_col, F.explode_outer(sources).alias("s"))
    ok = valid.select(F.col(valid_id).alias("s")).distinct()
    return one.join(ok, "s", "left_anti").select(id_col).distinct()


def repair_ids(df: DataFrame, given: str, valid: DataFrame, valid_id: str, prefix: int) -> DataFrame:
    """Each given id with the valid id that equals it or that alone begins with it; null if there is none.

    Candidates meet by their first ``prefix`` characters, so the join is an equi join.
    """
    v = valid.select(F.col(valid_id).alias("v")).distinct().withColumn("k", F.left("v", F.lit(prefix)))
    g = df.select(given).distinct().withColumn("k", F.left(given, F.lit(prefix)))
    met = g.join(v, "k").filter(F.startswith("v", F.col(given)))
    only = met.groupBy(given).agg(F.count("*").alias("n"), F.max(F.when(F.col("v") == F.col(given), F.col("v"))).alias("same"), F.min("v").alias("one"))
    return g.join(only, given, "left").select(given, F.coalesce("same", F.when(F.col("n") == 1, F.col("one"))).alias("repaired"))


def owning_span(points: DataFrame, spans: DataFrame, on: str, start: str, end: str, span_start: str, span_end: str, span_id: str, point_id: str) -> DataFrame:
    """The smallest span of the same element around each point range; ties go to the smaller id."""
    p = points.select(on, point_id, F.col(start).alias("_s"), F.col(end).alias("_e"))
    met = p.join(spans, on).filter((F.col(span_start) <= F.col("_s")) & (F.col(span_end) >= F.col("_e")))
    best = met.groupBy(on, point_id).agg(F.min_by(span_id, F.struct(F.col(span_end) - F.col(span_start), F.col(span_id))).alias("owner"))
    return p.select(on, point_id).join(best, [on, point_id], "left")


def unique_prefixes(titles: DataFrame, doc: str, title: str, least_words: int = 2, least_chars: int = 7) -> DataFrame:
    """(phrase, doc): word prefixes of titles that belong to one document only."""
    w = T.scope_tokens(F.col(title))
    cut = titles.select(doc, w.alias("w")).filter(F.size("w") >= least_words)
    phrases = cut.select(doc, F.explode(F.transform(F.sequence(F.lit(least_words), F.size("w")), lambda n: F.array_join(F.slice("w", F.lit(1), n), " "))).alias("phrase"))
    phrases = phrases.filter(F.length("phrase") >= least_chars).distinct()
    return phrases.groupBy("phrase").agg(F.min(doc).alias(doc), F.max(doc).alias("hi")).filter(F.col(doc) == F.col("hi")).drop("hi")


def mentions(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, doc: str) -> DataFrame:
    """(text_id, doc) where a text holds a phrase at word boundaries.

    Each phrase is anchored on its word that the fewest phrases have; where a text's word is an anchor, the words
    around it are compared with the phrase in place.  No n-grams leave the scan, and phrases may be of any length.
    """
    w = texts.select(text_id, T.scope_tokens(F.col(text)).alias("w"))
    p = phrases.filter("phrase <> ''").select(doc, F.split("phrase", " ").alias("all")).distinct()
    words = p.select("all", F.posexplode("all").alias("o", "word"))
    rare = words.groupBy("word").agg(F.count("*").alias("n"))
    anchor = words.join(rare, "word").groupBy("all").agg(F.min(F.struct("n", "o", "word")).alias("a")).select("all", F.col("a.o").alias("o"), F.col("a.word").alias("word"))
    anchored = p.join(anchor, "all")
    size = anchored.agg(F.count("*").alias("n"), F.sum(F.size("all")).alias("words")).first()
    side = F.broadcast(anchored) if size["n"] <= PHRASES_MOST and (size["words"] or 0) <= 10 * PHRASES_MOST else anchored
    at = w.select(text_id, "w", F.posexplode("w").alias("pos", "word")).join(side, "word")
    start = F.col("pos") - F.col("o")
    held = (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("all")) == F.col("all"))
    return at.filter(held).select(text_id, doc).distinct()


def violations(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child keys that no parent has."""
    return child.select(F.col(fk).alias("key")).filter("key IS NOT NULL").distinct().join(parent.select(F.col(pk).alias("key")), "key", "left_anti")


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(y.join(x, key, "left_anti").withColumn("missing_in", F.lit("left")))


def register(new: DataFrame, known: DataFrame, digest: str, order: str) -> DataFrame:
    """Each new row with ``duplicate``: its digest is known already or an earlier new row has it."""
    first = new.groupBy(digest).agg(F.min(order).alias("_first"))
    seen = known.select(digest).distinct().withColumn("_known", F.lit(True))
    return new.join(first, digest).join(seen, digest, "left").withColumn("duplicate", F.coalesce("_known", F.lit(False)) | (F.col(order) > F.col("_first"))).drop("_first", "_known")


def resolve_labels(atoms: DataFrame, entries: DataFrame, scope: str, label: str, entry: str, order: str, identity: str) -> DataFrame:
    """Each (scope, label) atom with its entry: one entry, or entries of one identity (the first); else why not."""
    index = entries.groupBy(scope, label).agg(F.count("*").alias("n"), F.min(identity).alias("lo"), F.max(identity).alias("hi"), F.min_by(entry, order).alias("first"))
    same = (F.col("n") == 1) | (F.col("lo") == F.col("hi"))
    return atoms.join(index, [scope, label], "left").withColumns({"entry": F.when(same, F.col("first")), "failure": F.when(F.col("n").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "ambiguous")}).drop("n", "lo", "hi", "first")


def fuzzy_title_pairs(works: DataFrame, with_author: float = 0.86, alone: float = 0.90) -> DataFrame:
    """Pairs of works(work_id, title, year, author) that may be one: same year, no identifier conflict, similar titles.

    Works meet by year and by one of their titles' three rarest words, not by year alone.
    Ratios are found once for titles, whatever the number of works that bear them.  ``alone`` is the higher limit.
    """
    if alone < with_author:
        raise ValueError("works of different authors need the higher ratio")
    w = works.withColumn("t", T.scope_normalize(F.col("title")))
    held = w.filter("t <> ''").groupBy("t", "year").agg(F.count("*").alias("works"))
    words = held.groupBy("t").agg(F.sum("works").alias("works")).select("t", "works", F.explode(F.array_distinct(F.split("t", " "))).alias("word"))
    rank = Window.partitionBy("t").orderBy("n", "word")
    rare = words.join(words.groupBy("word").agg(F.sum("works").alias("n")), "word").withColumn("r", F.row_number().over(rank)).filter("r <= 3").select("t", "word")
    dated = held.select("t", "year").join(rare, "t")
    a, b = dated.hint("merge").alias("a"), dated.alias("b")
    met = a.join(b, (F.col("a.year") == F.col("b.year")) & (F.col("a.word") == F.col("b.word"))).select(F.col("a.t").alias("lt"), F.col("b.t").alias("rt")).distinct()
    # No more characters match than the shorter title has; the rest are compared in parts of their own, being few but slow.
    most = 2 * F.least(F.length("lt"), F.length("rt")) / (F.length("lt") + F.length("rt"))
    near = met.filter(most >= with_author).repartition(COMPARED)
    alike = checkpointed(T.similar_pairs(near, "lt", "rt", with_author))
    # Where authors decide, distinct names are compared, and works meet by them too.
    names = w.select("year", "t", "author").distinct().withColumn("k", F.explode(T.author_keys(F.col("author"))))
    one, two = (names.select("year", F.col("t").alias(f"{x}t"), F.col("author").alias(f"{x}a"), "k").hint("merge") for x in "lr")
    known = one.join(alike.filter(F.col("ratio") < alone), "lt").join(two, ["year", "rt", "k"]).select("year", "lt", "la", "rt", "ra", "ratio").distinct()
    left, right = (w.select("year", F.col("work_id").alias(f"{side}_id"), F.col("t").alias(f"{side[0]}t"), F.col("author").alias(f"{side[0]}a")).hint("merge") for side in ("left", "right"))
    sure = left.join(alike.filter(F.col("ratio") >= alone), "lt").join(right, ["year", "rt"])
    likely = left.join(known.filter(T.authors_compatible(F.col("la"), F.col("ra"))), ["year", "lt", "la"]).join(right, ["year", "rt", "ra"])
    every = [x.filter("left_id < right_id").select("left_id", "right_id", "ratio") for x in (sure, likely)]
    return every[0].union(every[1])


def any_of(c: Column, cues: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, cues)), lambda x: F.contains(F.lower(c), x))

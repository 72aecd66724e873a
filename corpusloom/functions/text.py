"""Text normalisation, identifiers and small rules as Column expressions.

Only Unicode normal forms, character references and the sequence-matching ratio need Python; these
are Arrow-batched Pandas UDFs.  Everything else stays in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Words and labels that rules compare with.
TITLE_STOP_WORDS = ("a", "an", "and", "for", "from", "in", "of", "on", "or", "the", "to", "via", "with")
TOPIC_LABELS = (
    ("volume", ("volume", "体积")),
    ("intermediate shape", ("intermediate", "中间形")),
    ("topology", ("topology", "拓扑")),
    ("smoothness", ("smooth", "光滑")),
    ("limitations", ("limitation", "限制", "问题", "drawback")),
)
SECTION_KINDS = ("abstract", "introduction", "method", "result", "discussion", "conclusion", "references")
ELEMENT_KINDS = (
    (("table",), "table"),
    (("equation", "formula", "equation_interline"), "formula"),
    (("image", "figure", "chart"), "figure"),
    (("ref_text", "reference"), "reference"),
    (("page_footnote", "footnote"), "footnote"),
    (("header",), "header"),
    (("footer",), "footer"),
    (("page_number",), "page_number"),
    (("code",), "code"),
    (("list",), "list"),
    (("list_item",), "list_item"),
)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(StringType())
def normal_form(text: pd.Series, form: pd.Series) -> pd.Series:
    import unicodedata

    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form, strict=True)])


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    import html

    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, by longest matching blocks."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def similar_pairs(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs whose ``sequence_ratio`` reaches ``least``, with the ratio.

    Not a filter on a column: a filter would be moved before the deal of pairs to parts and compare them there, once more.
    """

    def run(batches):
        from difflib import SequenceMatcher

        for pdf in batches:
            found = []
            for x, y in zip(pdf[a], pdf[b], strict=True):
                m = SequenceMatcher(None, x, y, autojunk=False)
                found.append(m.ratio() if m.quick_ratio() >= least else 0.0)
            yield pdf.assign(ratio=found)[lambda d: d["ratio"] >= least]

    return pairs.select(a, b).mapInPandas(run, f"{a} string, {b} string, ratio double")


def normalize_lines(c: Column) -> Column:
    """Line feeds unified, other white space collapsed, lines stripped, at most one blank line in a row."""
    one = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[^\S\n]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(one, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def normalize_text(c: Column) -> Column:
    return normalize_lines(normal_form(c, F.lit("NFC")))


def plain_text(c: Column) -> Column:
    return normalize_text(unescape(F.regexp_replace(c, r"<[^>]+>", "")))


def match_text(c: Column) -> Column:
    """Lower case without tags, with one kind of dash and single spaces."""
    return squeeze(F.translate(F.lower(F.regexp_replace(c, r"<[^>]+>", "")), "–—‑", "---"))


def strip_heading_number(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\s*(\d+(\.\d+)*\.?|[A-Z]\.)\s+", ""))


def doi(c: Column) -> Column:
    """A DOI as documents name it."""
    bare = F.regexp_replace(F.trim(c), r"[.,;)\]}]+$", "")
    return F.lower(F.regexp_replace(bare, r"(?i)^https?://(dx\.)?doi\.org/", ""))


def registry_doi(c: Column) -> Column:
    """A DOI as identity records keep it; null if nothing is left."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.nullif(F.regexp_replace(F.lower(F.trim(bare)), r"[.,;)]+$", ""), F.lit(""))


def arxiv(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"(?i)^(https?://arxiv\.org/(abs|pdf)/|arxiv:\s*)", "")
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(bare)), r"\.pdf$", ""), r"v\d+$", "")
    return F.nullif(F.regexp_replace(bare, r"[.,;)]+$", ""), F.lit(""))


def scope_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def scope_normalize(c: Column) -> Column:
    return F.array_join(scope_tokens(c), " ")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether normalised text holds a normalised phrase at word boundaries; an empty phrase is nowhere."""
    return F.coalesce((phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))), F.lit(False))


def residual_query(query: Column, titles: Column) -> Column:
    """The query without the titles, longest first, whatever their case."""
    by_length = F.array_sort(F.filter(F.array_distinct(titles), lambda t: t.isNotNull() & (t != "")), lambda a, b: F.length(b) - F.length(a))
    quoted = lambda t: F.concat(F.lit(r"(?i)\Q"), t, F.lit(r"\E"))
    return squeeze(F.aggregate(by_length, query, lambda q, t: F.regexp_replace(q, quoted(t), F.lit(" "))))


def aliases(title: Column) -> Column:
    """Hyphenated and upper-case tokens, acronyms of three to five initials, and upper-case words of four letters."""
    stop = F.array(*map(F.lit, TITLE_STOP_WORDS))
    tokens = F.filter(F.regexp_extract_all(title, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda t: ~F.array_contains(stop, F.lower(t)))
    marked = F.regexp_extract_all(title, F.lit("([A-Za-z]{3,}(?:-[A-Za-z0-9]+)+|[A-Z]{3,})"), F.lit(1))
    initials = F.transform(F.filter(tokens, lambda t: t.rlike("^[A-Za-z]")), lambda t: F.substring(t, 1, 1))
    acronyms = F.transform(F.filter(F.array(*map(F.lit, (3, 4, 5))), lambda n: n <= F.size(initials)), lambda n: F.array_join(F.slice(initials, F.lit(1), n), ""))
    capitals = F.filter(tokens, lambda t: t.rlike("^[A-Z]{4,}$"))
    every = F.transform(F.concat(marked, acronyms, capitals), scope_normalize)
    return F.array_distinct(F.filter(every, lambda a: F.length(a) >= 3))


def topics(residual: Column, most: int = 6) -> Column:
    """Labels whose cues occur, then up to four further words that aren't stop words."""
    low = F.lower(residual)
    has = lambda cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(low, c))
    labels = F.array_compact(F.array(*[F.when(has(cues), F.lit(label)) for label, cues in TOPIC_LABELS]))
    stop = F.array(*map(F.lit, TITLE_STOP_WORDS))
    words = F.filter(F.regexp_extract_all(residual, F.lit("([A-Za-z]{4,}|[\\x{4e00}-\\x{9fff}]{2,})"), F.lit(1)), lambda t: ~F.array_contains(stop, F.lower(t)))
    few = F.filter(F.slice(words, 1, 4), lambda t: ~F.array_contains(labels, F.lower(t)))
    return F.slice(F.concat(labels, few), 1, most)


def search_terms(query: Column, most: int = 20) -> Column:
    """Distinct word or hyphen tokens of at least two characters; ASCII ones, if there are any."""
    every = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"([\p{L}\p{N}_-]{2,})"), F.lit(1)))
    ascii_only = F.filter(every, lambda t: t.rlike(r"^[\x00-\x7F]+$"))
    return F.slice(F.when(F.size(ascii_only) > 0, ascii_only).otherwise(every), 1, most)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def count_words(c: Column) -> Column:
    """White-space tokens; none in blank text."""
    flat = squeeze(F.coalesce(c, F.lit("")))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def sentences(c: Column) -> Column:
    """Sentences of a text: parted after end marks that white space follows."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?;。！？；])\s+"), squeeze), lambda s: s != "")


def first_text(*cells: Column) -> Column:
    """The first cell that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cells])


def element_text(kind: Column, text: Column, markdown: Column, markup: Column, latex: Column) -> Column:
    filled = lambda *cells: F.coalesce(*[F.nullif(c, F.lit("")) for c in cells], F.lit(""))
    return F.when(kind == "table", filled(markdown, text, markup)).when(kind == "formula", filled(latex, text, markdown)).otherwise(filled(text, markdown))


def element_kind(label: Column, text: Column, heading: Column, has_asset: Column) -> Column:
    """The canonical kind of a parser's element label, by the first rule that holds."""
    low = F.lower(label)
    out = F.when(heading, "title")
    for labels, kind in ELEMENT_KINDS:
        test = low.isin(*labels)
        if kind == "figure":
            test = test | has_asset
            out = out.when(test & F.lower(text).rlike(r"^\s*table\b"), "table")
        out = out.when(test, kind)
    prose = low.isin("text", "paragraph", "aside_text")
    return out.when(prose & text.rlike(r"^\s*([-•]|\d+[.)])\s+"), "list_item").when(prose, "paragraph").otherwise("other")


def section_kind(title: Column) -> Column:
    low, out = F.lower(title), F.when(F.lit(False), "")
    for kind in SECTION_KINDS:
        out = out.when(F.contains(low, F.lit(kind)), kind)
    return out.otherwise("body")


def is_english(c: Column, share: float = 0.85) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(F.length(F.regexp_replace(c, r"[^A-Za-z]", "")) > letters * share, "en").otherwise("und")


def mentions_concept(text: Column, concept: Column) -> Column:
    """Whether each word of four letters and more of a concept occurs, by its first five letters."""
    long = F.filter(scope_tokens(concept), lambda t: F.length(t) >= 4)
    return (F.size(long) > 0) & F.forall(long, lambda t: F.contains(F.lower(text), F.substring(t, 1, 5)))


def shortened(c: Column, most: int, keep: int) -> Column:
    flat = squeeze(c)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, keep), F.lit("..."))).otherwise(flat)


# References and citations


def reference_label(raw: Column) -> Column:
    """The label that a bibliography entry begins with: [x], (x) or n."""
    got = F.regexp_extract(raw, r"^\s*(?:\[([^\]]{1,20})\]|\(([^)]{1,20})\)|(\d{1,4})[.)])\s*", 0)
    return F.nullif(F.trim(F.regexp_replace(got, r"^\s*[\[(]|[\]).]\s*$", "")), F.lit(""))


def label_kind(label: Column) -> Column:
    return F.when(label.rlike(r"^\d+$"), "numeric").when(label.isNotNull(), "symbolic")


def reference_fields(raw: Column) -> dict[str, Column]:
    """Year, DOI, URL and arXiv id of a bibliography entry."""
    body = F.regexp_replace(raw, r"^\s*(\[[^\]]{1,20}\]|\d{1,4}[.)])\s*", "")
    part = lambda p: F.nullif(F.regexp_extract(body, p, 1), F.lit(""))
    return {
        "year": part(r"(?<!\d)((?:18|19|20)\d{2})(?!\d)").cast("int"),
        "doi": doi(part(r"(10\.\d{4,9}/[^\s\"<>]+)")),
        "url": F.regexp_replace(part(r"(https?://[^\s<>]+)"), r"[.,;]+$", ""),
        "arxiv_id": part(r"(?i)arxiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)"),
    }


def split_authors(c: Column) -> Column:
    parts = F.split(F.regexp_replace(c, r"(?i)\s+(and|&)\s+", ", "), ",")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def year_first_identity(raw: Column) -> tuple[Column, Column]:
    """(title, authors) of entries such as "A. One and B. Two. 2001. A title. Place"."""
    pattern = r"^(?:\[[^\]]+\]\s*|\d+[.)]\s*)?(.+?)[.,]\s*\(?((?:19|20)\d{2})[a-z]?\)?\.\s*([^.]+)\."
    authors, title = F.regexp_extract(raw, pattern, 1), F.trim(F.regexp_extract(raw, pattern, 3))
    good = (authors.contains(",") | F.lower(authors).contains(" and ")) & (F.size(F.split(title, r"\s+")) >= 2)
    return F.when(good, title), F.when(good, split_authors(authors))


def authors_compatible(a: Column, b: Column) -> Column:
    """Equal names, or a first or last name part of two letters and more of one among the parts of both."""
    x, y = scope_tokens(a), scope_tokens(b)
    ends = lambda t: F.filter(F.array(F.get(t, F.lit(0)), F.get(t, F.size(t) - 1)), lambda p: F.length(p) >= 2)
    both = F.array_intersect(x, y)
    return F.coalesce((scope_normalize(a) == scope_normalize(b)) | F.arrays_overlap(F.concat(ends(x), ends(y)), both), F.lit(False))


def author_keys(c: Column) -> Column:
    """Keys of which compatible names share at least one: the parts of a name, and the whole of it."""
    return F.array_distinct(F.concat(scope_tokens(c), F.array(F.concat(F.lit("="), scope_normalize(c)))))


def citation_atoms(inner: Column, widest: int = 20) -> Column:
    """Keys in a bracket: parts at commas and semicolons, numeric ranges counted out; null if a range is not sound."""
    joined = F.regexp_replace(inner, r"(?<=\d)\s+(?=\d)", "")
    parts = F.filter(F.transform(F.split(F.translate(joined, ";", ","), ","), lambda p: F.trim(p)), lambda p: p != "")
    span = r"^(\d+)\s*[-–−—]\s*(\d+)$"
    # A value that is used often is the only element of an array, as it would be found anew at each use.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    found = lambda p: F.struct(F.regexp_extract(p, span, 1).alias("x"), F.regexp_extract(p, span, 2).alias("y"))
    number = lambda c: F.when(c != "", c.cast("int"))

    def counted(p: Column, x: Column, y: Column) -> Column:
        sound = (y > x) & (y - x <= widest)
        return F.when(x.isNull(), F.array(p)).when(sound, F.transform(F.sequence(x, F.greatest(F.least(y, x + widest), x)), lambda n: n.cast("string")))

    def expand(p: Column) -> Column:
        ends = once(found(p), lambda e: counted(p, number(e["x"]), number(e["y"])))
        return F.when(p.rlike("[-–−—]"), ends).otherwise(F.array(p))

    return once(F.transform(parts, expand), lambda every: F.when((F.size(every) > 0) & F.forall(every, lambda e: e.isNotNull()), F.flatten(every)))


def is_author_year(inner: Column) -> Column:
    return inner.rlike(r"(19|20)\d{2}") & ~F.regexp_replace(inner, r"\s+", "").rlike(r"^[\d,;\-–−—]+$")


def surnames(authors: Column) -> Column:
    """Last names of an author list, letters only, lower case."""
    people = F.filter(F.transform(F.split(F.regexp_replace(authors, r"(?i)\s*(\band\b|&)\s*", ","), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"(?i)^(et al\.?|eds?\.?)$"))
    return F.filter(F.transform(people, lambda p: F.lower(F.regexp_replace(F.element_at(F.split(p, r"\s+"), -1), r"[^\p{L}]", ""))), lambda s: s != "")


def author_year_keys(authors: Column, year: Column) -> Column:
    """Forms by which a text may cite an entry: first author, first et al., first and second, each with the year."""
    s = surnames(authors)
    one, two = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    y = year.cast("string")
    key = lambda *p: F.concat(*p, F.lit("|"), y)
    return F.array_distinct(F.array_compact(F.array(key(one), key(one, F.lit(" et al")), key(one, F.lit(" and "), two))))


def identity_key(doi_: Column, arxiv_: Column, title: Column, year: Column) -> Column:
    """What identifies a work: its DOI, else its arXiv id, else its title and year."""
    by_title = F.concat(F.lit("title:"), F.substring(scope_normalize(title), 1, 120), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(F.concat(F.lit("doi:"), registry_doi(doi_)), F.concat(F.lit("arxiv:"), arxiv(arxiv_)), by_title)


def link_citations(answer: Column, ids: Column) -> Column:
    """Brackets around known chunk ids become evidence links."""
    plain = F.translate(answer, "【】［］", "[][]")
    return F.aggregate(ids, plain, lambda t, i: F.replace(t, F.concat(F.lit("["), i, F.lit("]")), F.concat(F.lit("[evidence:"), i, F.lit("]"))))

"""Main text of web pages by two-pass block rules.

First pass: each text block is decided by length, link density and stop-word density.  Second
pass: blocks left undecided take the label of the nearest decided neighbours in the same region.
Scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and reader
comments are known by their elements or class names and never take part.

In an article a long block without stop words is left to its neighbours, as articles hold such blocks (lists,
names, words of other languages); outside of one it is rejected.  Pages are read in time proportional to their length.

Edge cases: a null or empty page gives an empty text; unclosed elements, comments and
references are read as browsers do; repeated pages give equal rows; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, table

# Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their
    there they this to was we were which will with you
    aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist
    mit nach nicht noch nur oder sich sie sind so um und von vor war wie wird zu zum zur über
    au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais ne nous ou où par pas plus pour
    qui que sa se ses son sont sur un une vous
    al como con del el ella entre era esta este fue ha hay las lo los más muy nos para pero por porque sin sobre su sus
    también una uno y ya""".split()
)

# Element names by their part in a page.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head title".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
CONTAINERS = frozenset("div section article main body ul ol dl table blockquote figure details fieldset".split()) | CHROME
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre hr address figcaption summary legend option center html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME_NAMES = frozenset(
    """ad ads adv advert advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination
    pager popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored
    subscribe toolbar widget""".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>\"'<]*+)>")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PIECES = re.compile(r"[\s_\-]+")

LONG_WORDS, STOPS_HIGH, STOPS_LOW, LINKS_MOST = 12, 0.20, 0.08, 0.5


class Markup:
    """The tags of a page from left to right; what a search has once not found is not searched again, so the whole takes linear time."""

    def __init__(self, page: str):
        self.page, lower = page, page.lower()
        self.lower = lower if len(lower) == len(page) else page.translate(ASCII_LOWER)  # places must agree
        self.gone: set[str] = set()

    def find(self, what: str, at: int, lower: bool = False) -> int:
        if what in self.gone:
            return -1
        found = (self.lower if lower else self.page).find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the bracket that ends a tag, outside of quotes where these are closed."""
        i = at
        while True:
            end = self.find(">", i)
            if end < 0:
                return -1
            double, single = self.page.find('"', i, end), self.page.find("'", i, end)
            if double < 0 and single < 0:
                return end
            quote, mark = (double, '"') if single < 0 or 0 <= double < single else (single, "'")
            shut = self.find(mark, quote + 1)
            if shut < 0:  # a quote that is never closed doesn't count
                return self.find(">", at)
            i = shut + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag: where it starts and ends, whether it closes, its name (empty for comments) and attributes."""
        page = self.page
        while True:
            start = self.find("<", at)
            if start < 0:
                return None
            plain = PLAIN.match(page, start)
            if plain:
                return start, plain.end(), bool(plain[1]), plain[2].lower(), plain[3]
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            m = TAG.match(page, start)
            if m or page[start + 1 : start + 2] in ("!", "?"):
                end = self.tag_end(m.end()) if m else self.find(">", start)
                if end < 0:
                    return None
                return start, end + 1, bool(m and m[1]), m[2].lower() if m else "", page[m.end() : end] if m else ""
            at = start + 1

    def closing(self, name: str, at: int) -> int:
        """The end of the closing tag of an element whose content isn't read, or -1."""
        while (start := self.find(f"</{name}", at, lower=True)) >= 0:
            after = self.page[start + len(name) + 2 : start + len(name) + 3]
            if not (after.isalnum() or after in ("-", "_")):
                end = self.find(">", start)
                return end + 1 if end >= 0 else -1
            at = start + 1
        return -1


class Block:
    __slots__ = ("label", "length", "links", "region", "text", "words")

    def __init__(self, text: str, links: int, region: int):
        self.text, self.links, self.region, self.label = text, links, region, None
        self.words, self.length = text.split(" "), len(text)


def is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in CHROME and not (in_article and name == "header"):
        return True
    for key, value in NAMES.findall(attributes):
        value = value.strip("\"'").lower()
        if key.lower() == "role":
            if value in CHROME_ROLES:
                return True
        elif any(x in CHROME_NAMES and not (in_article and x in ("header", "masthead")) for x in PIECES.split(value)):
            return True
    return False


def blocks_of(page: str) -> tuple[list[Block], set[int]]:
    """Text blocks outside page furniture, and the numbers of regions that are articles."""
    blocks: list[Block] = []
    articles: set[int] = set()
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # name, in furniture, region
    parts: list[str] = []
    links = regions = at = 0
    in_link = False

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text and not stack[-1][1]:
                blocks.append(Block(text, links, stack[-1][2]))
            parts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if text and not stack[-1][1]:
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                links += len("".join(text.split()))

    markup, end, open_ = Markup(page), len(page), Counter()
    while at < end:
        tag = markup.next(at)
        if tag is None:
            say(page[at:])
            break
        start, stop, closing, name, attributes = tag
        if start > at:
            say(page[at:start])
        at = stop
        if not name:
            continue
        if name in SKIPPED and not closing:
            if name == "head":  # may be left open: ends where the body begins
                shut, body = markup.closing("head", at), markup.find("<body", at, lower=True)
                if shut >= 0 and (body < 0 or shut <= body):
                    at = shut
                elif body >= 0:
                    at = body
            elif not attributes.endswith("/"):
                shut = markup.closing(name, at)
                at = shut if shut >= 0 else (end if name in ("script", "style", "textarea", "title") else at)
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            continue
        close()
        in_link = False
        if name not in CONTAINERS:
            continue
        if closing:
            while open_[name]:
                gone = stack.pop()[0]
                open_[gone] -= 1
                if gone == name:
                    break
        else:
            _, chrome, region = stack[-1]
            inside = region in articles
            if (name in ("article", "main") or re.search(r"""\brole\s*=\s*["']?main\b""", attributes, re.I)) and not chrome and not inside:
                regions += 1
                region = regions
                articles.add(region)
            stack.append((name, chrome or is_chrome(name, attributes, inside), region))
            open_[name] += 1
    close()
    return blocks, articles


def decide(blocks: list[Block], articles: set[int]) -> list[Block]:
    """The blocks of the main text."""
    has_article = any(b.region in articles for b in blocks)
    for b in blocks:
        inside = b.region in articles
        solid = b.length - b.text.count(" ")
        if (has_article and not inside) or b.links > LINKS_MOST * solid:
            b.label = False
        elif len(b.words) >= LONG_WORDS:
            density = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in b.words) / len(b.words)
            if density >= STOPS_HIGH:
                b.label = True
            elif density < STOPS_LOW and not inside:
                b.label = False
    before: list[tuple[int, bool] | None] = []
    last: dict[int, tuple[int, bool]] = {}
    for i, b in enumerate(blocks):
        before.append(last.get(b.region))
        if b.label is not None:
            last[b.region] = (i, b.label)
    chosen, coming = [], {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        label = b.label
        if label is None:
            inside = b.region in articles
            near = [x for x in (before[i], coming.get(b.region)) if x]
            # In an article only blocks between two rejected ones are rejected; elsewhere the nearer neighbour decides.
            if inside:
                label = not (len(near) == 2 and not near[0][1] and not near[1][1])
            else:
                least = min((abs(i - j) for j, _ in near), default=0)
                label = any(good for j, good in near if abs(i - j) == least)
        else:
            coming[b.region] = (i, label)
        if label:
            chosen.append(b)
    return chosen[::-1]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in decide(*blocks_of(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield batch(schema, [b.column(0), b.column(1), texts, [len(t) for t in texts]])

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url"), F.col("html")), run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

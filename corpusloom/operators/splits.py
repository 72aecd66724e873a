"""Splits of texts that are longer than a chunk may be: tables by rows under their header, anything else at spaces or by force."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES = "array<struct<start:int,end:int,kind:string>>"


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def table_parts(text: Column, limit: int, count: Callable[[Column], Column] = n_words) -> Column:
    """A table's parts of at most ``limit`` tokens: its first two lines, then as many rows as fit.

    A table that fits, or has no more than two lines, is one part.  A row that doesn't fit beside the header is a part
    with it; where that is the first row, the header stands alone before it.  Null for null.
    """
    lines = F.split(text, "\n")
    header, rows = F.slice(lines, 1, 2), F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array_join(header, "\n").alias("open"))

    def place(state: Column, row: Column) -> Column:
        longer = F.concat_ws("\n", state["open"], row)
        full = F.struct(F.array_append(state["done"], state["open"]).alias("done"), F.concat(F.array_join(header, "\n"), F.lit("\n"), row).alias("open"))
        return F.when(count(longer) > limit, full).otherwise(F.struct(state["done"].alias("done"), longer.alias("open")))

    packed = F.aggregate(rows, start, place, lambda s: F.array_append(s["done"], s["open"]))
    return F.when((count(text) <= limit) | (F.size(lines) <= 2), F.array(text)).when(text.isNotNull(), packed)


def cut_at_space(text: str, a: int, b: int, limit: int, count: Callable[[str], int]) -> int | None:
    """Where to cut text[a:b] so that the left side fits: after the last space up to the middle, else before the first one beyond.

    ``count`` must not fall as a text grows, so the last fitting space is found by bisection.
    """
    middle = a + (b - a) // 2
    after = [i + 1 for i in range(a, middle) if text[i].isspace()]
    n = bisect_right(after, limit, key=lambda i: count(text[a:i]))
    if n:
        return after[n - 1]
    beyond = next((i for i in range(middle, b) if text[i].isspace()), None)
    return beyond if beyond is not None and beyond > a and count(text[a:beyond]) <= limit else None


def forced_pieces(text: str, limit: int, count: Callable[[str], int]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of pieces that cover a text and fit: kind is how the earliest cut at either end was made, ``space`` or ``force``."""
    todo, pieces = [(0, len(text), None, None, 0)], []
    while todo:
        a, b, left, right, depth = todo.pop()
        if count(text[a:b]) <= limit or b - a < 2:
            pieces.append((a, b, min((c for c in (left, right) if c), default=(0, "force"))[1]))
            continue
        at = cut_at_space(text, a, b, limit, count)
        cut = (depth, "force" if at is None else "space")
        at = a + (b - a) // 2 if at is None else at
        todo += [(at, b, cut, right, depth + 1), (a, at, left, cut, depth + 1)]
    return pieces


def force_split(limit: int, count: Callable[[str], int] | None = None) -> Callable[[Column], Column]:
    """Arrow-batched ``forced_pieces``; tokens are words unless ``count`` says otherwise.  Null for null, one empty piece for an empty text."""
    counted = count or (lambda s: len(s.split()))

    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b, "kind": k} for a, b, k in forced_pieces(t, limit, counted)])

    return pieces

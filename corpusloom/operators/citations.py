"""Citation mentions in running text, with their places."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

BRACKET = re.compile(r"\[([^\[\]]{1,240})\]")
PAREN = re.compile(r"\(([^()]*\b(?:19|20)\d{2}[a-z]?[^()]*)\)")
INLINE = re.compile(r"\b([A-Z][\w'’-]+(?: (?:and|&) [A-Z][\w'’-]+| et al\.?)?),? \(?((?:19|20)\d{2}[a-z]?)\)?")
MATH = re.compile(r"[=+*/\\^_{}<>∈∞]|^\s*-?\d*\.\d+|^\s*0\s*,\s*1\s*$")


def is_citation(inner: str) -> bool:
    """Not a formula, an interval or a bare year."""
    return not MATH.search(inner) and not re.fullmatch(r"\s*(?:19|20)\d{2}\s*", inner) and bool(re.search(r"\w", inner))


def mentions_of(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, inner): brackets first, then author-year parentheses, then names with years; none overlap."""
    found = [("bracket", m.start(), m.end(), m[1]) for m in BRACKET.finditer(text) if is_citation(m[1])]
    masked = list(text)

    def mask(spans) -> str:
        for _, a, z, _ in spans:
            masked[a:z] = " " * (z - a)
        return "".join(masked)

    for kind, pattern, group in (("parenthesis", PAREN, 1), ("inline", INLINE, 0)):
        found += [(kind, m.start(), m.end(), m[group]) for m in pattern.finditer(mask(found))]
    return sorted(found, key=lambda f: f[1])


def extract_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, i, *m) for k, t in zip(pdf[key], pdf[text], strict=True) for i, m in enumerate(mentions_of(t or ""))], columns=[key, "n", "kind", "start", "end", "inner"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, n int, kind string, start int, end int, inner string")

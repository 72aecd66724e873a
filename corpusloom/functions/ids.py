"""Deterministic identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own name space; ids of other systems never collide with ours.
NAMESPACE, VERSION = "corpusloom", "1"
SEPARATOR = "\x1f"


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 32 hex digits of the SHA-256 of all parts; null if a part is null or empty."""
    cells = [p.cast("string") for p in parts]
    whole = F.concat_ws(SEPARATOR, F.lit(NAMESPACE), F.lit(prefix), F.lit(VERSION), *cells)
    bad = [c.isNull() | (c == "") for c in cells]
    test = bad[0]
    for b in bad[1:]:
        test = test | b
    return F.when(~test, F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(whole, 256), F.lit(32))))


def set_id(prefix: str, members: Column, *parts: Column) -> Column:
    """A stable id that doesn't depend on the members' order."""
    return stable_id(prefix, *parts, F.array_join(F.sort_array(members), ","))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name: the first 16 bytes of a SHA-1 with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))

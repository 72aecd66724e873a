"""Bounded-space online best-fit packing of tokenized documents.

A fixed number of bins is open at a time.  A bitset, one bit for each amount of free
space, finds the open bin that an item fills best; when no open bin takes an item and all
are in use, the fullest one closes.

Edge cases: a null text is empty and gives one piece that holds the end token alone; documents
of any length are cut into whole pieces behind a shorter first one; repeated rows are packed
as they come; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, batch, table

SEQUENCE, END_ID, OPEN_BINS = 1024, 2, 256


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest from U+0100 on."""
    own = {b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD}
    rest = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """A function from a text to its ids, for the byte-level BPE vocabulary at ``path``.

    Strings of added tokens give those tokens' ids, as the `tokenizers` library does by default.
    """
    import public_tokenizers
    import tiktoken

    of = _byte_of_char()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all")


class BestFit:
    """Bounded-space best fit: ``place`` gives (sequence number, offset) for an item's length."""

    def __init__(self, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS, first_id: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first_id
        self.bits = 0  # bit f: an open bin has f free tokens
        self.bins: dict[int, list[int]] = {}  # free space -> its bins
        self.count = 0

    def _take(self, free: int) -> int:
        own = self.bins[free]
        number = own.pop()
        if not own:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        at_least = self.bits >> length
        if at_least:
            free = length + ((at_least & -at_least).bit_length() - 1)
            number = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.next, self.capacity
            self.next += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free


OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)``; a row per piece, with its token ids if ``with_ids``.

    Each scan partition packs on its own in one pass, so nothing is shuffled and memory is bounded by a
    batch and the open bins.  Items are placed online, in the order in which they come, so batches don't
    matter.  Sequence numbers hold the partition's number in their upper bits.
    """
    schema = OUT.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = load_encoder(tokenizer)
        fit = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                cut = len(ids) % capacity or min(capacity, len(ids))
                for n, (i, j) in enumerate(zip([0, *range(cut, len(ids), capacity)], [*range(cut, len(ids), capacity), len(ids)], strict=True)):
                    rows.append([doc, n, i, j - i, zlib.crc32(ids[i:j].tobytes()), 0, 0, *([ids[i:j]] if with_ids else [])])
            for r in rows:
                r[5], r[6] = fit.place(r[3])
            if rows:
                yield batch(schema, [list(c) for c in zip(*rows, strict=True)])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())

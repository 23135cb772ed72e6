"""Lexical terms and blocks of items, for the operators that hold documents against a stated set of items.

A term is a run of ASCII letters, ASCII digits and characters beyond ASCII; only A to Z
are folded. In UTF-8 all bytes of a character beyond ASCII are above 0x7F, so terms are
cut on bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a byte becomes before texts are split at spaces: folded if A to Z, a space if ASCII and no letter or digit.
FOLDED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: A longer text is split by stretches of this many bytes, so that only some of its terms are held as objects.
STRETCH = 4 << 20
#: Texts of items that a task holds at once have at most this many bytes, or are one item.
BLOCK_BYTES = 2 << 20

_gap = re.compile(b"[^0-9A-Za-z\x80-\xff]")


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, as one list or, for a long text, several; no term is cut."""
    at = 0
    while len(text) - at > STRETCH:
        gap = _gap.search(text, at + STRETCH)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(FOLDED).split()
        at = end
    yield (text[at:] if at else text).translate(FOLDED).split()


def item_blocks(items: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows (item_id, text) of the items that have a text, block by block.

    A block holds at most ``most_bytes`` of text, or one item alone; all rows of an
    item are in one block. Blocks come to the driver one at a time.
    """
    items = items.select("item_id", "text").filter("text is not null and text != ''")
    size = F.octet_length("text") + 64
    n = max(1, math.ceil((items.agg(F.sum(size)).first()[0] or 0) / most_bytes))
    while True:
        block = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n)).alias("block")
        fullest = items.groupBy(block).agg(F.sum(size).alias("b"), F.min("item_id").alias("x"), F.max("item_id").alias("y")).filter(F.col("b") > most_bytes).filter("x != y or (x is null) != (y is null)")
        if fullest.isEmpty():
            break
        n *= 2
    for b in range(n):
        rows = items.filter(block == b).toArrow()
        if rows.num_rows:
            yield rows

"""Removal of benchmark passages from training text, by an FM-index per shard of documents.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one
window. A word of a document inside any occurrence of a window is hit.

1. The distinct windows of a block of items are the phrases; their words get numbers.
2. A task takes documents by shards of bounded text. A word that no phrase has becomes a separator, and
   stretches with fewer words than the shortest phrase hold none. What is left of a shard is its
   indexed text: suffix order, Burrows-Wheeler transform, wavelet matrix and sampled places (``fm_index``).
3. All phrases are searched backward at once. Each occurrence is located and mapped to its
   document and words.
4. Occurrences of a document merge to removal spans; phrases give the items.

Nothing is shuffled: a document's result needs its own text and the phrases only. Items go
to tasks in blocks of bounded text (``terms.item_blocks``). With several blocks the frame passes through one
step for each, which adds its spans to those before, within one Spark stage.

Nulls: a null text has no words and no hit; a null doc_id is kept as it is; a null item_id has
windows like others but isn't among the ids of items. Empty texts and items have no words. Very long
texts are taken whole: words by stretches, the index by shards that overlap by a phrase less a word. Ties don't arise.
Repeated documents are each held against all; rows of items with one item_id count as one item. An empty
table of documents gives no rows, one of items no hits. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import pieces, to_bytes
from shopweave.llm.fm_index import FMIndex
from shopweave.llm.terms import BLOCK_BYTES, FOLDED, item_blocks, term_lists

WINDOW = 10
#: Text bytes of a shard, and symbols of an index.
SHARD_BYTES = 24 << 20
SHARD_SYMBOLS = 1 << 22
#: Pairs of document and item that are made at once.
PAIRS = 1 << 22

SPANS = "array<struct<start: long, end: long>>"
FOUND = f"n_words long, spans {SPANS}, item_ids array<long>"


@dataclass
class Phrases:
    """Distinct windows of a block of items, over numbered words; 0 is no word."""

    numbers: dict[bytes, int]
    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray  #: items of phrase p are items[first[p]:first[p + 1]]
    items: np.ndarray  #: ids, null ones left out

    @classmethod
    def of(cls, ids: list[int | None], texts: list[bytes], window: int) -> Phrases:
        numbers: dict[bytes, int] = {}
        symbols: list[int] = []
        known: dict[bytes, int] = {}
        start, length, holders = [], [], []
        for item_id, text in zip(ids, texts):
            words = [numbers.setdefault(w, len(numbers) + 1) for w in chain.from_iterable(term_lists(text))]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                p = known.setdefault(np.array(words[i : i + window], "<i4").tobytes(), len(start))
                if p == len(start):
                    start.append(len(symbols) + i)
                    length.append(min(window, len(words)))
                    holders.append(set())
                if item_id is not None:
                    holders[p].add(item_id)
            symbols += words
        first = np.cumsum([0, *map(len, holders)])
        return cls(numbers, np.array(symbols, np.int32), np.array(start, np.int64), np.array(length, np.int64), first, np.array([i for h in holders for i in sorted(h)], np.int64))


def numbered(texts: list[bytes], numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of every word, 0 if unknown; bounds of each text's words)."""
    parts, bounds = [], [0]
    for text in texts:
        n = 0
        for words in term_lists(text):
            parts.append(np.fromiter(map(numbers.get, words, [0] * len(words)), np.int32, len(words)))
            n += len(words)
        bounds.append(bounds[-1] + n)
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(bounds)


def stretches(numbers: np.ndarray, bounds: np.ndarray, least: int, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of known words that lie in one text and have ``least`` words; long ones cut with an overlap."""
    known = numbers > 0
    text_start = np.zeros(len(numbers) + 1, bool)
    text_start[bounds] = True
    begin = np.flatnonzero(known & (text_start[:-1] | ~np.append(False, known[:-1])))
    end = np.flatnonzero(known & (text_start[1:] | ~np.append(known[1:], False))) + 1
    long = end - begin >= least
    begin, end = begin[long], end[long]
    step = most - overlap
    times = np.maximum(1, -(-(end - begin - overlap) // step))
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start = np.repeat(begin, times) + nth * step
    return start, np.minimum(np.repeat(end, times) - start, most)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch in one document become one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    far = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(doc * far + end)
    new = np.append(True, doc[1:] * far + start[1:] > reach[:-1])[: len(doc)]
    last = np.append(new[1:], True)[: len(doc)]
    return doc[new], start[new], reach[last] - doc[new] * far


def occurrences(texts: list[bytes], phrases: Phrases, shard_symbols: int) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
    """(words of each text, merged spans, and the pairs (text, phrase) that occur) by indexes of bounded size."""
    numbers, bounds = numbered(texts, phrases.numbers)
    spans, pairs, n = (np.empty(0, np.int64),) * 3, np.empty(0, np.int64), len(phrases.start)
    if n and len(numbers):
        least, most = int(phrases.length.min()), int(phrases.length.max())
        start, length = stretches(numbers, bounds, least, max(shard_symbols, 2 * most), most - 1)
        lot = np.cumsum(length + 1) // shard_symbols
        for a, b in zip(*(np.searchsorted(lot, np.unique(lot), side) for side in ("left", "right"))):
            s, l = start[a:b], length[a:b]
            at = np.cumsum(l + 1) - l  # of each stretch in the index; a 0 before every one and at the end
            text = np.zeros(int(at[-1] + l[-1]) + 1, np.int32)
            inside = np.arange(l.sum()) - np.repeat(np.cumsum(l) - l, l)
            text[np.repeat(at, l) + inside] = numbers[np.repeat(s, l) + inside]
            for phrase, place in FMIndex(text, len(phrases.numbers) + 1).occurrences(phrases.symbols, phrases.start, phrases.length):
                k = np.searchsorted(at, place, "right") - 1
                word = s[k] + place - at[k]
                doc = np.searchsorted(bounds, word, "right") - 1
                spans = merged(*(np.concatenate(x) for x in zip(spans, (doc, word, word + phrases.length[phrase]))))
                pairs = np.union1d(pairs, doc * n + phrase)
    doc, begin, end = spans
    return np.diff(bounds), (doc, begin - bounds[doc], end - bounds[doc]), pairs // max(n, 1), pairs % max(n, 1)


def items_of(doc: np.ndarray, phrase: np.ndarray, phrases: Phrases, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, item id) of the distinct pairs, by lots of whole documents."""
    times = phrases.first[phrase + 1] - phrases.first[phrase]
    out = []
    lots = np.searchsorted(doc, np.unique(doc[np.searchsorted(np.cumsum(times), np.arange(0, times.sum(), PAIRS), "right")])) if times.sum() else np.empty(0, np.int64)
    for a, b in zip(lots, np.append(lots[1:], len(doc))):
        t = times[a:b]
        nth = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        pair = np.stack([np.repeat(doc[a:b], t), phrases.items[np.repeat(phrases.first[phrase[a:b]], t) + nth]])
        pair = pair[:, np.lexsort(pair[::-1])]
        out.append(pair[:, np.append(True, (pair[:, 1:] != pair[:, :-1]).any(0))])
    both = np.concatenate(out, 1) if out else np.empty((2, 0), np.int64)
    return both[0], both[1]


def lists(doc: np.ndarray, n_docs: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), values)


def scan(phrases: Phrases, again: bool, keep_text: bool, shard_bytes: int, shard_symbols: int) -> Callable:
    """The step of one block of items; ``again``: rows come with the spans and items of the blocks before."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", shard_bytes):
            n = piece.num_rows
            n_words, spans, doc, phrase = occurrences(to_bytes(piece["text"]), phrases, shard_symbols)
            items = items_of(doc, phrase, phrases, n)
            if again:
                old = piece["spans"]
                at, flat = np.repeat(np.arange(n), old.value_lengths().to_numpy()), old.flatten()
                spans = merged(*(np.concatenate(x) for x in zip(spans, (at, flat.field("start").to_numpy(), flat.field("end").to_numpy()))))
                old = piece["item_ids"]
                items = tuple(np.concatenate(x) for x in zip(items, (np.repeat(np.arange(n), old.value_lengths().to_numpy()), old.flatten().to_numpy())))
                both = np.unique(np.stack(items), axis=1)  # a block has all rows of an item, so ids of two blocks differ; only the order is made
                items = both[0], both[1]
            out = {"doc_id": piece["doc_id"]} | ({"text": piece["text"]} if keep_text else {}) | {
                "n_words": pa.array(n_words, pa.int64()),
                "spans": lists(spans[0], n, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans[1:]], ["start", "end"])),
                "item_ids": lists(items[0], n, pa.array(items[1], pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(out)

    return step


def removal_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep_text: bool = False, block_bytes: int = BLOCK_BYTES,
                  shard_bytes: int = SHARD_BYTES, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(doc_id, n_words, spans, item_ids), on request with the text: spans [start, end) of hit words, apart and in order; ids of the items that occur."""
    blocks = (Phrases.of(b["item_id"].to_pylist(), to_bytes(b["text"].combine_chunks()), window) for b in item_blocks(items, block_bytes))
    blocks = [p for p in blocks if len(p.start)] or [Phrases.of([], [], window)]
    frame = docs.select("doc_id", "text")
    for k, phrases in enumerate(blocks):
        text = keep_text or k < len(blocks) - 1
        frame = frame.mapInArrow(scan(phrases, k > 0, text, shard_bytes, shard_symbols), "doc_id long, " + ("text string, " if text else "") + FOUND)
    return frame


def cut(found: DataFrame) -> DataFrame:
    """``removal_spans(..., keep_text=True)`` with a column ``clean_text``: the text without what lies between a span's first and last character."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(b"[^ ]+")
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist()):
                if text and spans:
                    ends = {x for s in spans for x in (s["start"], s["end"] - 1)}
                    at = {i: m.span() for i, m in enumerate(word.finditer(text.translate(FOLDED))) if i in ends}
                    for s in reversed(spans):
                        text = text[: at[s["start"]][0]] + text[at[s["end"] - 1][1] :]
                out.append(None if text is None else text.decode())
            yield batch.append_column("clean_text", pa.array(out, pa.string()))

    return found.mapInArrow(remove, f"doc_id long, text string, {FOUND}, clean_text string")


def hits(found: DataFrame) -> DataFrame:
    """The columns of the report: words, hit words, items and their digest for each document."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    names = F.concat_ws(",", F.array_sort(F.col("item_ids").cast("array<string>")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from b where len(w) > 0)),
h as (select r, i, n, item_id from (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from v))) join v using (n, g)),
x as (select r, count(distinct i) as n_hit from (select r, unnest(range(i, i + n)) as i from h) group by r),
y as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join x using (r) left join y using (r)
"""

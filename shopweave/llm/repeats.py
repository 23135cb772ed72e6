"""Removal of passages that recur anywhere, by repeated-phrase automata.

A window is ``WINDOW`` consecutive words; a window whose words also start anywhere
else recurs, and every word that a recurring window covers goes. Windows are judged on
the input.

1. Each window has an anchor: of its phrases of ``PHRASE`` words, the one with the
   smallest hash. Equal windows have equal anchors, and neighbouring windows mostly
   share theirs, so a text has few. Anchors are counted over all texts.
2. Texts with an anchor that recurs are fetched. Around each such anchor, the stretch
   that its windows cover is cut out; equal stretches are one variant.
3. Variants are dealt to shards by anchor, so equal windows meet. A shard counts its
   windows word by word, joins confirmed neighbours to passages, compiles the passages
   into an Aho-Corasick automaton over words, and streams all its stretches through it.
   Shards hold about ``SHARD`` variants, however many there are in all. An anchor met more
   than ``HOT`` times may have very many variants; its windows are dealt each by itself, by
   all their words, in the same way.
4. The places found go back to all texts that have the variant, and the words are cut.

Hashes only route; what is removed was matched word by word. (Texts whose word
sequences have one sha-256 are equal: they recur as a whole.) Every text takes
part whole. Frequent stretches are combined on the map side, so a shard gets at
most two rows of a variant from each task.

Null texts and texts under ``WINDOW`` words lose nothing. Repeated rows are copies
of one another. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import Shared, pieces, to_bytes
from shopweave.llm.words import Words, flat_words, grams

WINDOW = 35
PHRASE = 12
SHARD = 2000
HOT = 5000
SEEN = 200_000


def anchors(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, its place, first window, last window) of the anchors of one text, in order.

    Of equal hashes the leftmost counts, so an anchor depends on its window's words alone.
    """
    if len(hashes) < window:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty
    g = grams(hashes, phrase)
    span = window - phrase + 1
    at = np.arange(len(g))
    width = 1
    while 2 * width <= span:  # at[i]: where the minimum of g[i : i + width] is
        left, right = at[: len(at) - width], at[width:]
        at = np.where(g[right] < g[left], right, left)
        width *= 2
    left, right = at[: len(g) - span + 1], at[span - width : span - width + len(g) - span + 1]
    best = np.where(g[right] < g[left], right, left)
    first = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    return g[best[first]], best[first], first, np.append(first[1:], len(best)) - 1


def listed(w: Words, i: int) -> list[bytes]:
    return [w.buffer[a:b] for a, b in zip(w.start[w.first[i] : w.first[i + 1]].tolist(), w.end[w.first[i] : w.first[i + 1]].tolist())]


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def read_rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def sketched(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, mark, n_words, sha, anchors): a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            w = flat_words(to_bytes(batch.column("text")))
            n = len(w.first) - 1
            found = [anchors(w.hash[w.first[i] : w.first[i + 1]], window, phrase)[0].view(np.int64) for i in range(n)]
            shas = [digest(listed(w, i)) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(w.first), pa.int64()), pa.array(shas), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "mark", "n_words", "sha", "anchors"],
            )

    return read_rows(docs).mapInArrow(run, "doc_id long, mark long, n_words long, sha string, anchors array<long>")


def stretches(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """(place, at, dealt, variant, stretch): the stretches around recurring anchors of ``texts`` (place, copies, recurring, hot, text).

    ``dealt`` is what a stretch is dealt by. The words stand only in the first two rows that
    a task has of a variant. A text that has copies gives its rows twice, with a null place.
    """
    names = ["place", "at", "dealt", "variant", "stretch"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in pieces(batches, "text", 1 << 20):
            w = flat_words(to_bytes(batch.column("text")))
            places, copies, recurring, hot = (batch.column(c).to_pylist() for c in ("place", "copies", "recurring", "hot"))
            rows: list[list] = [[] for _ in names]
            for i, place in enumerate(places):
                often, alone = set(recurring[i]), set(hot[i])
                base = w.first[i]
                hashes, _, first, last = anchors(w.hash[base : w.first[i + 1]], window, phrase)
                for h, a, b in zip(hashes.view(np.int64).tolist(), first.tolist(), last.tolist()):
                    if h not in often:
                        continue
                    for x, y in [(k, k) for k in range(a, b + 1)] if h in alone else [(a, b)]:
                        words = b" ".join([w.buffer[c:d] for c, d in zip(w.start[base + x : base + y + window].tolist(), w.end[base + x : base + y + window].tolist())])
                        variant = hashlib.blake2b(words, digest_size=16, key=h.to_bytes(8, "little", signed=True)).digest()
                        dealt = int.from_bytes(variant[:8], "little", signed=True) if h in alone else h
                        for _ in range(2 if copies[i] > 1 else 1):
                            seen[variant] += 1
                            if seen[variant] <= 2 or copies[i] == 1:
                                for column, value in zip(rows, (place if copies[i] == 1 else None, x, dealt, variant, words if seen[variant] <= 2 else None)):
                                    column.append(value)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names)

    return texts.select("place", "copies", "recurring", "hot", "text").mapInArrow(run, "place long, at long, dealt long, variant binary, stretch binary")


def passages(variants: dict[bytes, list[int]], often: dict[bytes, int], window: int) -> set[tuple[int, ...]]:
    """The maximal runs of windows that recur, over all variants (word ids); ``often``: how often a variant was met, two at most."""
    counts: Counter = Counter()
    for key, ids in variants.items():
        for k in range(len(ids) - window + 1):
            counts[tuple(ids[k : k + window])] += often[key]
    found = set()
    for ids in variants.values():
        start = None
        for k in range(len(ids) - window + 2):
            recurs = k <= len(ids) - window and counts[tuple(ids[k : k + window])] > 1
            if recurs and start is None:
                start = k
            elif not recurs and start is not None:
                found.add(tuple(ids[start : k - 1 + window]))
                start = None
    return found


def locate(variants: dict[bytes, bytes], often: dict[bytes, int], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """(first word, word after the last) of every passage in each variant, by one automaton over words."""
    number: dict[bytes, int] = {}
    ids = {key: [number.setdefault(w, len(number)) for w in text.split(b" ")] for key, text in variants.items()}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for passage in passages(ids, often, window):
        automaton.add_word(passage)
    if not len(automaton):
        return {}
    automaton.make_automaton()
    return {key: spans for key, x in ids.items() if (spans := [(end + 1 - n, end + 1) for end, n in automaton.iter(tuple(x))])}


def located(found: DataFrame, shards: int, window: int) -> DataFrame:
    """(variant, spans): spans of recurring passages in each variant that has any; spans are first * 2^32 + end."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variants: dict[bytes, bytes] = {}
        often: dict[bytes, int] = {}
        for batch in batches:
            for v, text in zip(batch.column("variant").to_pylist(), batch.column("stretch").to_pylist()):
                variants[v] = text
                often[v] = min(2, often.get(v, 0) + 1)
        spans = locate(variants, often, window)
        yield pa.RecordBatch.from_arrays([pa.array(list(spans), pa.binary()), pa.array([[a << 32 | b for a, b in s] for s in spans.values()], pa.list_(pa.int64()))], ["variant", "spans"])

    dealt = found.filter("stretch is not null").select(F.pmod(F.xxhash64("dealt"), F.lit(shards)).alias("shard"), "variant", "stretch")
    return dealt.groupBy("shard").applyInArrow(run, "variant binary, spans array<long>")


def cut(texts: DataFrame) -> DataFrame:
    """(place, n_removed, kept_sha256, kept) of ``texts`` (place, text, spans of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            removed, shas = [], []
            for text, spans in zip(to_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edge[s >> 32] += 1
                    edge[s & 0xFFFFFFFF] -= 1
                stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                removed.append(len(words) - len(stay))
                shas.append(digest([words[k] for k in stay]))
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(removed, pa.int64()), pa.array(shas)], ["place", "n_removed", "kept_sha256"])

    return texts.select("place", "text", "spans").mapInArrow(run, "place long, n_removed long, kept_sha256 string")


def passage_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, copies, spans): the sketched rows with ``place``; the word sequences that several rows have;
    and per place of the other texts, its text and the spans of words that recur."""
    shared = Shared(docs.sparkSession, "repeats")
    rows = shared.table(sketched(docs, window, phrase).withColumn("place", F.monotonically_increasing_id()), "rows")
    long_enough = rows.filter(F.col("n_words") >= window)
    groups = shared.table(long_enough.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("place")), "groups")

    every = long_enough.select("place", F.explode("anchors").alias("anchor"))
    often = shared.table(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    recurring = every.join(often, "anchor").groupBy("place").agg(F.collect_set("anchor").alias("recurring"), F.collect_set(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot"))
    chosen = rows.select("place", "doc_id", "mark").join(groups.select("place", "copies"), "place").join(recurring, "place")
    chosen = chosen.select("place", "copies", "recurring", "hot", F.col("doc_id").alias("id"), F.col("mark").alias("m"))
    texts = read_rows(docs).join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & F.col("mark").eqNullSafe(F.col("m")))
    texts = shared.table(texts.select("place", "copies", "recurring", "hot", "text"), "texts")

    found = shared.table(stretches(texts, window, phrase), "stretches")
    shards = max(1, -(-found.filter("stretch is not null").count() // shard))
    places = found.filter("place is not null").select("place", "at", "variant").join(located(found, shards, window), "variant")
    moved = places.select("place", F.explode(F.transform("spans", lambda s: s + F.col("at") * F.lit((1 << 32) + 1))).alias("span"))
    spans = moved.groupBy("place").agg(F.collect_set("span").alias("spans"))
    return rows, groups.filter("copies > 1").select("sha", "copies"), texts.filter("copies = 1").select("place", "text").join(spans.hint("merge"), "place")


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): a row per row of ``docs``."""
    rows, copies, spans = passage_spans(docs, window, phrase, shard, hot)
    out = rows.select("place", "doc_id", "n_words", "sha").join(copies, "sha", "left").join(cut(spans), "place", "left")
    gone = F.col("copies").isNotNull()
    return out.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(digest([]))).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, i, md5(array_to_string(w[i : i + 34], ' ')) as g from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
rep as (select g from win group by g having count(*) > 1),
cov as (select distinct r, i + unnest(range(0, 35)) as j from win join rep using (g)),
word as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
kept as (select r, string_agg(x, ' ' order by j) as t, count(*) as n from word anti join cov using (r, j) group by r)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
"""

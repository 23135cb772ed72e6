"""Ranked lexical search by bag deduplication.

1. Each document becomes its bag: the terms that any item has, with their counts, and
   its length n in terms. Documents become short here: other terms only count towards n.
2. N, L and the number of documents of each item term are counted over all bags.
3. Documents of one bag and one length class m score alike for every item. They are
   found by a hash of both; the bag itself stays in the grouping key, so that two bags of
   one hash are never taken for one. Of a class, the ``k`` smallest doc_ids are kept, cut on
   the map side first (a class that holds a third of all rows sends k rows from a task).
4. Every class is scored once against all items that share a term with it. A task keeps,
   per item, the k best classes by score and smallest member: a class behind k others
   can't place a member. These expand to their members by ascending doc_id, and the
   k best rows of each item over all tasks are its result.

Items are a stated query set: they are held by tasks in blocks of bounded size
(``terms.item_blocks``), each block against all documents.

Nulls: a null text has no terms and is in no result; a null doc_id ranks after all others of
its score; a null item_id is an item like others. Empty texts and items give no
rows. Very long texts are read whole, by stretches. Ties of score go by doc_id. Repeated
documents are documents each; rows of items with one item_id are one item with all their
terms. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopweave.llm.common import Shared, pieces, to_bytes
from shopweave.llm.terms import BLOCK_BYTES, item_blocks, term_lists

#: Rows of a result per item.
K = 10
#: Scores that a task holds at once: classes of a slice times items of a block.
SLICE = 1 << 22
#: Text bytes that a task splits at once.
PIECE = 8 << 20


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag): a bag is pairs (term, count) of four-byte integers, by ascending term."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            lengths, found = [], []
            for text in to_bytes(piece["text"]):
                n, count = 0, Counter()
                for terms in term_lists(text):
                    n += len(terms)
                    count.update(map(vocabulary.get, terms))
                count.pop(None, None)
                lengths.append(n)
                found.append(np.array(sorted(count.items()), "<u4").tobytes())
            out = pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(lengths, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "bag"])
            yield out.filter(pa.array(np.array(lengths, np.int64) > 0))

    return docs.select("doc_id", "text").mapInArrow(split, "doc_id long, n long, bag binary")


def flat_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all pairs of the bags."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], "<u4", (ends[-1] - ends[0]) // 4, ends[0]).reshape(-1, 2) if ends[-1] > ends[0] else np.empty((0, 2), np.uint32)
    return np.repeat(np.arange(len(column)), np.diff(ends) // 8), flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)


def term_documents(found: DataFrame, size: int) -> DataFrame:
    """(term, df) over all bags; a task sends one row per term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(flat_bags(batch["bag"])[1], minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["term", "df"])

    return found.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def classes(found: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, bag, members): each distinct bag and m once, with its k smallest doc_ids in order."""
    m = (F.lit(10) + F.expr(f"(cast(90 * n as decimal(38, 0)) * {n_docs}L) div {n_terms}L")).alias("m")
    rows = found.filter("octet_length(bag) > 0").select("doc_id", m, "bag").withColumn("hash", F.xxhash64("bag", "m"))
    key = ["hash", "m", "bag"]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last()))).filter(F.col("nth") <= k)
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nth", "doc_id"))).getField("doc_id").alias("members")).drop("hash")


class Best:
    """Per item the k first rows by (score falling, id rising, null last), of all that were put in."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.score, self.id, self.null, self.ref = (np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool, np.int64))

    def put(self, item, score, id, null, ref) -> None:
        item, score, id, null, ref = (np.concatenate(x) for x in zip((self.item, self.score, self.id, self.null, self.ref), (item, score, id, null, ref)))
        order = np.lexsort((ref, id, null, -score, item))
        first = np.searchsorted(item[order], item[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.item, self.score, self.id, self.null, self.ref = item[order], score[order], id[order], null[order], ref[order]
        full = np.bincount(self.item, minlength=len(self.least)) >= self.k
        last = np.searchsorted(self.item, np.flatnonzero(full), "right") - 1
        self.least[full] = self.score[last]


def ranked(found: DataFrame, weights: np.ndarray, starts: np.ndarray, postings: np.ndarray, n_items: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task's classes the k best rows of each item."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, members, seen = Best(n_items, k), {}, 0
        rows = max(1, SLICE // n_items)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                row, term, tf = flat_bags(part["bag"])
                value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * part["m"].to_numpy(zero_copy_only=False)[row]))
                times = starts[term + 1] - starts[term]
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                scores = np.zeros(part.num_rows * n_items, np.int64)
                np.add.at(scores, np.repeat(row, times) * n_items + postings[np.repeat(starts[term], times) + place], np.repeat(value, times))
                scores = scores.reshape(-1, n_items)
                r, item = np.nonzero(scores >= best.least)
                lists = part["members"]
                heads = lists.flatten().take(pa.array(np.append(0, np.cumsum(lists.value_lengths().to_numpy())[:-1])))
                null, id = heads.is_null().to_numpy(zero_copy_only=False), heads.fill_null(0).to_numpy()
                best.put(item, scores[r, item], id[r], null[r], seen + r)
                for j in set((best.ref[best.ref >= seen] - seen).tolist()):
                    members[seen + j] = lists[j].as_py()
                members = {j: members[j] for j in set(best.ref.tolist())}
                seen += part.num_rows
        rows = [(i, s, x) for i, s, j in zip(best.item.tolist(), best.score.tolist(), best.ref.tolist()) for x in members[j]]
        last = Best(n_items, k)
        last.put(*(np.array(x, t) for x, t in zip(zip(*[(i, s, x or 0, x is None, 0) for i, s, x in rows]) if rows else [[]] * 5, (np.int64, np.int64, np.int64, bool, np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array(last.item), pa.array(last.id, mask=last.null), pa.array(last.score)], ["item", "doc_id", "score"])

    rows = found.select("m", "bag", "members").mapInArrow(score, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark, shared = docs.sparkSession, Shared(docs.sparkSession, "bag-search")
    out = None
    for b, block in enumerate(item_blocks(items, block_bytes)):
        terms: dict = {}
        for item_id, text in zip(block["item_id"].to_pylist(), to_bytes(block["text"].combine_chunks())):
            held = terms.setdefault(item_id, set())
            for some in term_lists(text):
                held.update(some)
        ids = sorted(terms, key=lambda i: (i is None, i))
        vocabulary = {t: j for j, t in enumerate(sorted(set().union(*terms.values())))}
        found = shared.table(bags(docs, vocabulary), f"bags-{b}")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not vocabulary:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in term_documents(found, len(vocabulary)).collect():  # the terms of a block: bounded with it
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        pairs = np.array([(vocabulary[t], i) for i, x in enumerate(ids) for t in terms[x]], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        starts = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))
        rows = ranked(classes(found, n_docs, n_terms, k), weights, starts, np.ascontiguousarray(pairs[:, 1]), len(ids), k)
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        rows = rows.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = rows if out is None else out.unionAll(rows)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


ORACLE_SQL = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
c as (select count(*)::bigint as n_docs, sum(len(t))::bigint as n_terms from d where len(t) > 0),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
f as (select doc_id, r, n, term, count(*)::bigint as tf from (select doc_id, r, len(t)::bigint as n, unnest(t) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from f, c group by term),
s as (select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
      from q join f using (term) join w using (term), c group by all),
o as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from o where rank <= 10
"""

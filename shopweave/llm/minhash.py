"""Near-duplicate detection by circulant MinHash with exact Jaccard verification.

A text's set holds the 64-bit hashes of its distinct word shingles. Two fixed
permutations of the 32-bit numbers make all signature coordinates: the first
scatters the set, and coordinate k is the minimum of the second one over the
scattered set shifted circularly by k. Coordinates are cut into bands of ``ROWS``;
the number of bands follows from the similarity so that a pair at the threshold
misses all bands with probability ``MISS`` at most.

Texts with equal sets are one node. Nodes that share a band value are linked to
the smallest of them, which groups candidates; then links are confirmed on full
sets, exactly, inside each group. A task gets a group's sets once and looks
only for links between parts that aren't connected yet. Groups over ``BLOCK``
shingles are split: nodes meet in several random blocks first; parts found so are
then cut into blocks again and every two blocks that aren't of one part are
compared, so no link between different texts is lost and no task holds more
than two blocks.

Null and wordless texts have an empty set and are linked with nothing. Texts with
fewer words than a shingle have one shingle, the whole sequence. Rows that repeat
both ``doc_id`` and text are one document; a null ``doc_id`` takes part by its text
but never names a component that has another id. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import Shared, pieces, to_bytes
from shopweave.llm.components import components
from shopweave.llm.words import SPREAD, flat_words, grams, mix64

ROWS = 5
MISS = 1e-7
BLOCK = 1 << 20
BLOCKINGS = 2


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a non-empty set."""
    scattered = mix32((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(size, dtype=np.uint32)
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(scattered), 1024):
        grid = scattered[k : k + 1024, None] + shifts
        np.minimum(low, mix32(grid, 0x21F0AAAD, 0xD35A2D97).min(0), out=low)
    return low


def band_values(sig: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of ``ROWS`` coordinates; equal values of different bands differ."""
    grid = sig.reshape(-1, ROWS).astype(np.uint64)
    return mix64((grid * SPREAD[:ROWS]).sum(1, dtype=np.uint64) + np.arange(1, len(grid) + 1, dtype=np.uint64) * SPREAD[ROWS]).view(np.int64)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted set of each text's shingles, A to Z in lower case."""
    w = flat_words(texts, lower=True)
    every = grams(w.hash, width)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(grams(w.hash[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): the mark tells rows with one ``doc_id`` and different texts apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, node, bands): a row per row; node and bands are null for an empty set."""
    count = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            sets = shingle_sets(to_bytes(batch.column("text")), width)
            nodes = [node_of(s) if len(s) else None for s in sets]
            bands = [band_values(signature(s, count * ROWS)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "mark", "n_shingles", "node", "bands"],
            )

    return keyed(docs).mapInArrow(run, "doc_id long, mark long, n_shingles long, node long, bands array<long>")


class Parts:
    """Union-find over positions."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a


def link(sets: list[np.ndarray], labels: list[int], percent: int) -> np.ndarray:
    """Roots (positions) after every link of at least ``percent`` between different parts is found.

    A set is compared with all others at once. Members of the largest part needn't be
    taken up: a link from it to another part is found from the other end.
    """
    parts = Parts(labels)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    ids, local = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    todo = np.ones(len(sets), bool)
    has = np.zeros(len(ids), bool)
    while True:
        roots = parts.roots()
        largest = np.bincount(roots).argmax()
        open_ = np.flatnonzero(todo & (roots != largest)) if not todo.all() else np.array([0])
        if not len(open_):
            return roots
        for x in open_[:64]:
            mine = local[starts[x] : starts[x] + sizes[x]]
            has[mine] = True
            both = np.add.reduceat(has[local], starts, dtype=np.int64)
            has[mine] = False
            todo[x] = False
            for y in np.flatnonzero(100 * both >= percent * (sizes + sizes[x] - both)):
                parts.join(int(x), int(y))


def link_groups(rows: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """(*keys, node, root): parts of each group of ``rows`` (*keys, node, part, shingles)."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("node")
        nodes = table.column("node").to_numpy()
        once = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        nodes = nodes[once]
        part = table.column("part").to_numpy()[once]
        raw = table.column("shingles")
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in once]
        roots = link(sets, part.tolist(), percent)
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()] * len(nodes), k.type) for k in key), pa.array(nodes), pa.array(nodes[roots])], [*keys, "node", "root"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", node long, root long")


def candidate_groups(rows: DataFrame, shared: Shared) -> DataFrame:
    """(node, grp): nodes that share a band value, directly or by way of others."""
    values = rows.filter("node is not null").select("node", F.explode("bands").alias("value"))
    ends = values.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("value", "low")
    ends = shared.table(ends, "ends")  # read plainly, so that Spark can split a value that very many nodes have
    stars = values.join(ends, "value").filter("node != low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    return components(stars.distinct(), shared, "candidates").withColumnRenamed("root", "grp")


def components_of(docs: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, stays): a row per row of ``docs``.

    One row of a component stays: the first by doc_id, nulls last, then by the text's hash. Rows alike in both stay or go together.
    """
    shared = Shared(docs.sparkSession, "near")
    rows = shared.table(signed(docs, width, percent), "rows")
    groups = candidate_groups(rows, shared)
    chosen = (
        rows.filter("node is not null").select("node", "n_shingles", F.struct("doc_id", "mark").alias("row"))
        .join(groups, "node")
        .groupBy("node", "grp", "n_shingles")
        .agg(F.min("row").alias("row"))
        .select("node", "grp", "n_shingles", "row.doc_id", "row.mark")
    )
    chosen = shared.table(chosen, "chosen")
    weight = chosen.groupBy("grp").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("blocks"))
    members = chosen.join(weight, "grp")
    sets = shared.table(node_sets(docs, members, width), "sets")

    first = sets.withColumn("turn", F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, BLOCKINGS - 1).otherwise(0))))
    first = first.withColumn("blk", F.pmod(F.xxhash64("node", "turn"), F.col("blocks")).cast("int")).withColumn("part", F.col("node"))
    met = shared.table(link_groups(first.select("grp", "turn", "blk", "blocks", "node", "part", "shingles"), percent, ["grp", "blocks", "turn", "blk"]), "met")
    small = met.filter("blocks = 1").select("node", "root")
    big = met.filter("blocks > 1")
    final = small
    if not big.isEmpty():
        parts = components(big.select(F.col("node").alias("u"), F.col("root").alias("v")), shared, "parts")
        final = small.unionByName(across(sets.filter("blocks > 1"), parts, percent, block, shared))

    joined = rows.join(final, "node", "left").select("doc_id", "mark", "n_shingles", "node", F.coalesce("root", "node").alias("part"))
    joined = shared.table(joined, "parted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))  # null ids last
    names = joined.filter("part is not null").groupBy("part").agg(first.alias("first"))
    names = shared.table(names.select("part", F.col("first.doc_id").alias("named"), F.col("first.mark").alias("named_mark")), "names")
    out = joined.join(names, "part", "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("named")))
    stays = F.col("part").isNull() | (F.col("doc_id").eqNullSafe(F.col("named")) & (F.col("mark") == F.col("named_mark")))
    return out.select("doc_id", "mark", "n_shingles", "component_id", stays.alias("stays"))


def node_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(node, grp, blocks, n_shingles, shingles): the full sets of the candidate nodes, from whole texts.

    Candidates are a share of the texts, so this is a shuffle at every size.
    """
    text = keyed(docs)
    m = members.select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "node", "grp", "blocks", "n_shingles")
    found = text.join(m.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & F.col("mark").eqNullSafe(F.col("m"))).select("node", "grp", "blocks", "n_shingles", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()  # a repeated row's set is sent once by a task
        for batch in pieces(batches, "text", 1 << 20):
            fresh = []
            for i, n in enumerate(batch.column("node").to_pylist()):
                if n not in last:
                    fresh.append(i)
                    last.add(n)
            last = last if len(last) < 100_000 else set()
            if fresh:
                batch = batch.take(pa.array(fresh))
                sets = [s.tobytes() for s in shingle_sets(to_bytes(batch.column("text")), width)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "grp", "blocks", "n_shingles")), pa.array(sets, pa.binary())], ["node", "grp", "blocks", "n_shingles", "shingles"])

    return found.mapInArrow(run, "node long, grp long, blocks int, n_shingles long, shingles binary")


def across(sets: DataFrame, parts: DataFrame, percent: int, block: int, shared: Shared) -> DataFrame:
    """(node, root) of the nodes in large groups, after the links between blocks too.

    Nodes of a large part get blocks of their own; those of small parts share blocks. Two
    blocks of one large part aren't compared.
    """
    placed = sets.join(parts.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = shared.table(placed.dropDuplicates(["node"]), "placed")
    sums = placed.groupBy("grp", "part").agg(F.sum("n_shingles").alias("n"))
    sums = sums.withColumn("own", F.col("n") * 4 >= block)
    own = sums.filter("own").select("grp", "part", F.ceil(F.col("n") / block).alias("cuts"))
    mixed = sums.filter("not own").groupBy("grp").agg(F.ceil(F.sum("n") / block).alias("mixed_cuts"))
    b = placed.join(own, ["grp", "part"], "left").join(mixed, "grp", "left")
    b = b.withColumn("alone", F.when(F.col("cuts").isNotNull(), F.col("part"))).withColumn("cut", F.pmod(F.xxhash64("node"), F.coalesce("cuts", "mixed_cuts")))
    b = shared.table(b.withColumn("blk", F.xxhash64("grp", "alone", "cut")).select("grp", "node", "part", "alone", "blk", "shingles"), "blocks")
    blocks = b.select("grp", "blk", "alone").distinct()
    other = blocks.select("grp", F.col("blk").alias("blk2"), F.col("alone").alias("alone2"))
    pairs = blocks.join(other, "grp").filter("blk <= blk2 and (alone is null or alone2 is null or alone != alone2)").select("grp", "blk", "blk2")
    ends = pairs.select("grp", F.col("blk").alias("a"), F.col("blk2").alias("b"), F.col("blk").alias("mine")).unionByName(
        pairs.filter("blk != blk2").select("grp", F.col("blk").alias("a"), F.col("blk2").alias("b"), F.col("blk2").alias("mine"))
    )
    rows = b.select("grp", "node", "part", "shingles", F.col("blk").alias("mine")).join(ends, ["grp", "mine"])
    met = link_groups(rows.select("grp", "a", "b", "node", "part", "shingles"), percent, ["grp", "a", "b"])
    links = met.join(b.select("node", F.col("part").alias("p1")), "node").join(b.select(F.col("node").alias("root"), F.col("part").alias("p2")), "root")
    roots = components(links.select(F.col("p1").alias("u"), F.col("p2").alias("v")), shared, "joined")
    return b.select("node", "part").join(roots.select(F.col("node").alias("part"), "root"), "part", "left").select("node", F.coalesce("root", "part").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row per row of ``docs``; component_id is the smallest doc_id of the component.

    ``kept`` says whether the row's doc_id is its component_id: of rows that share that id, all are kept.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return components_of(docs, width, percent, block).select("doc_id", "n_shingles", "component_id", kept)


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their component, with all their columns."""
    gone = components_of(docs, width, percent).filter("not stays").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m")).distinct()
    mark = F.xxhash64(F.col("text").cast("string"))
    return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (mark == F.col("__m")), "left_anti")

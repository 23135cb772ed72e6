"""Language-model scoring by logistic context mixing.

A text is its words (A to Z in lower case), each followed by a space, then one end
symbol, as bytes. A byte is eight binary choices, most significant first. Four bit
predictors see the last byte, two, three, or the whole word so far; each hashes its
context and the bits so far to a slot of a table of counts. Their log odds are
combined by weights that a gate picks (how well the two longest contexts are known),
and the result is refined by an adaptive map from odds and last byte to a learned
probability. That spells a word; a second predictor sees the word before (or that the text begins):
the counts of what followed it in training, less a discount each, and the mass taken off goes to
the words as spelled. While a text is scored, its earlier words count too: with a share given by
their frequency so far, they are mixed into the next word's probability. A text's
probability is the equal mixture over several such shares, each with and without the word before, so
what suits the text takes over as it goes on.

Nothing is sampled. Word counts of all training texts are summed by one shuffle;
contexts don't reach over a space, so the slot counts of all training bytes follow
exactly from the distinct words and their counts. Weights and maps are learned online
in one pass over the distinct words, each weighted by its full count, with its own occurrence
taken out of the counts first; tasks learn side by side, and their weights are averaged by how much each
gate saw. Model and word counts are then fixed, so a text's score doesn't depend on
the task that computes it.

The tables grow with the input. Contexts of up to three bytes are bounded by the alphabet: they are counted
exactly, and their table has two slots or more for each. What the whole-word predictor sees after three bytes
is shared only by words that begin alike, so distinct words are dealt by their first three bytes to shards,
more of them the more words there are, and each shard counts its own words into a table with a slot for each of
their bits. Where a shard's worth of words begins alike (links, say), a longer prefix deals them, and the shards get the
counts of the contexts up to there from the driver, so all counts stay exact. A word's cost is worked out once, in its shard.

Pairs of a word and the next are counted over all training texts in shards by the word before, in packed arrays: a
chunk of texts sends each shard its distinct pairs and their counts once, and the shard answers with the counts of all
chunks and with what it knows of the words before. Chunk and answers then meet by a shuffle. The pairs after a word with more than a
quarter of a shard's tokens are spread over several shards by the second word; such words go to every task, ``HEAVY`` at
most. A word before is known by 64 bits, the word after it by 40. The texts are read twice by place, so they must
come from a stored table (or in a fixed order). A chunk whose numbers of pairs differ between the reads is an error; other changes aren't noticed.

Null text is empty: just the end symbol. Rows with a null ``doc_id`` are scored but
neither held out nor learned from. Texts of any length are scored whole. Without
training rows every predictor is even and the base score is 0 per token. An empty
table gives an empty table.
"""

from __future__ import annotations

import math
import os.path
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import Shared, pieces, to_bytes
from shopweave.llm.langid import held_out
from shopweave.llm.words import SPREAD, STEP, flat_words, joined_hashes, mix64

HELD_OUT_MOD = 10
SLOT_BITS = 20  # where no other size is given
SLOTS = 1 << SLOT_BITS
CONTEXTS = 4
SHORT = 3  # contexts of so many bytes at most are in the table of all words; longer ones in a shard's
SHARD_BITS = 1 << 21  # bits of the distinct words in a shard
SPLIT = 4000  # prefixes at most that are split in a round
LEVELS = np.array([1, 2, 4, 10, 40, 200])  # of how well a context is known
GATES = (len(LEVELS) + 1) ** 2
SHARES = np.array([0.0, 0.03, 0.15, 0.5])  # of a text's own earlier words, by expert
EXPERTS = 2 * len(SHARES)  # each share without and with the word before
SHARD_TOKENS = 2_000_000  # tokens in a shard of pairs
HEAVY = 1_000_000  # words at most whose pairs are spread over shards
CHUNK_BYTES = 8 << 20
HASHED_BYTES = 1 << 17  # of texts whose words are hashed at once
#: Arrays of a chunk's tokens, and of what it is told, with their kinds.
CODED = {"number": np.int32, "start": np.int64, "shard": np.int64, "heavy": np.int64, "n_bytes": np.int64, "ids": np.int64, "no_id": np.bool_, "held": np.bool_}
TOLD = {"n": np.int64, "cost": np.float32, "followers": np.int32, "met": np.int64}
COUNTED_BYTES = 32 << 20  # of all words that a task holds before it counts them
CELLS = (64, 33)  # last byte (low bits), log odds from -8 to 8 by halves
BATCH = 1024
BLANKS = b" \t\n\v\f\r"
INSIDE = bytes(b not in BLANKS for b in range(256))
LOWER = bytes(range(256)).lower()
END = b"\n"
BEGIN_HASH, END_HASH = 1, 2
LN10 = math.log(10)
Z = np.uint64


def units(words: list[bytes]) -> list[bytes]:
    """The bytes that stand for each word; the end symbol stands for itself."""
    return [w if w == END else w + b" " for w in words]


class Sizes(NamedTuple):
    """Slots by predictor, as powers of two: each of the short contexts, and the whole word."""

    short: int = SLOT_BITS
    long: int = SLOT_BITS

    def slots(self) -> int:
        return (SHORT << self.short) + (1 << self.long)


def slot_of(context: np.ndarray, node: np.ndarray, row: int, sizes: Sizes) -> np.ndarray:
    out = node * SPREAD[8 + row]
    out ^= context
    out *= STEP
    out >>= Z(64 - (sizes.short if row < SHORT else sizes.long))
    out += Z(row << sizes.short)
    return out.view(np.int64)


class Bits:
    """The bits of many words: for each of eight levels, slots by context (rows) and the bit."""

    def __init__(self, words: list[bytes], sizes: Sizes = Sizes()):
        self.sizes = sizes
        coded = units(words)
        flat = np.frombuffer(b"".join(coded), np.uint8).astype(Z)
        sizes = np.array([len(u) for u in coded], np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.nth = nth = np.arange(len(flat)) - self.start[self.word]
        back = [np.append(np.full(k, 32, Z), flat[:-k]) if len(flat) > k else np.full(len(flat), 32, Z) for k in (1, 2, 3)]
        for k, b in enumerate(back, 1):
            b[nth < k] = 32
        prefix = np.zeros(len(flat), Z)  # of all bytes before, in the word
        value = (flat + Z(1)) * STEP ** nth.astype(Z)
        total = np.cumsum(value)
        prefix[1:] = total[:-1]
        prefix -= np.repeat(np.append(Z(0), total)[self.start], sizes)
        orders = [back[0], back[0] | back[1] << Z(8), back[0] | back[1] << Z(8) | back[2] << Z(16), prefix * Z(2) + nth.astype(Z)]
        self.orders = orders[:SHORT]
        self.contexts = [(c + Z(1)) * SPREAD[k] for k, c in enumerate(orders)]
        self.last = back[0].astype(np.int64) & (CELLS[0] - 1)
        self.flat = flat

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(8):
            node = (self.flat | Z(256)) >> Z(8 - k)
            bit = self.flat >> Z(7 - k) & Z(1)
            slots = np.stack([slot_of(c, node, i, self.sizes) for i, c in enumerate(self.contexts)])
            np.copyto(slots[SHORT], slots[SHORT - 1], where=self.nth < SHORT)  # the word so far is short
            yield slots, bit.astype(np.float32)


def odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n0, n1 = n0.astype(np.float32), n1.astype(np.float32)
    return np.clip(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), -8, 8)


def in_pairs(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The counts of zeros and ones of each slot side by side (as real and imaginary part), so one look-up finds both."""
    return np.stack([n0, n1], axis=1).view(np.result_type(n0, np.complex64))[:, 0]


def known(n: np.ndarray) -> np.ndarray:
    """How well a context is known, from 0 on."""
    out = np.zeros(n.shape, np.int8)
    for level in LEVELS.astype(n.dtype):
        out += (n >= level).view(np.int8)
    return out


def gate_of(longer: np.ndarray, longest: np.ndarray) -> np.ndarray:
    return longer.astype(np.int64) * (len(LEVELS) + 1) + longest


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def mix(st: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Log odds weighted by the gate's weights (a row per context)."""
    out = st[0] * weights[0][gate]
    for c in range(1, CONTEXTS):
        out += st[c] * weights[c][gate]
    return out


def cell(last: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return last * CELLS[1] + np.rint((np.clip(mixed, -8, 8) + 8) * 2).astype(np.int32)


def learn(batches: Iterator[tuple[list[bytes], np.ndarray]], n0: np.ndarray, n1: np.ndarray, sizes: Sizes = Sizes()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One online pass: (weights by gate, what each gate saw, map sums of bits and of all).

    Every occurrence counts alike: a batch moves a gate's weights by its pull over the curvature of
    all that the gate has seen so far, so a word of any mass makes a bounded step.
    """
    weights = np.full((GATES, CONTEXTS), 0.3)
    seen = np.zeros(GATES)
    curve = np.zeros((GATES, CONTEXTS, CONTEXTS))
    maps = np.zeros((2, CELLS[0] * CELLS[1]))
    pairs = in_pairs(n0, n1)
    for words, times in batches:
        for k in range(0, len(words), BATCH):
            bits = Bits(words[k : k + BATCH], sizes)
            mass = times[k : k + BATCH][bits.word]
            pull, held = np.zeros((GATES, CONTEXTS)), np.zeros(GATES)
            for slots, bit in bits.levels():
                found = pairs.take(slots)
                a, b = found.real - (1 - bit), found.imag - bit  # without this occurrence
                gate = gate_of(known(a[2] + b[2]), known(a[3] + b[3]))
                st = odds(np.maximum(a, 0), np.maximum(b, 0))
                mixed = mix(st, weights.T.astype(np.float32), gate)
                p = squash(mixed.astype(np.float64))
                err, bend = (bit - p) * mass, np.maximum(p * (1 - p), 0.01) * mass
                order = gate.astype(np.int8).argsort(kind="stable")  # bits of a gate lie together, and are summed by one product
                bounds = np.append(0, np.cumsum(np.bincount(gate, minlength=GATES)))
                x = st.take(order, axis=1).astype(np.float64)
                weighted = np.vstack([x * bend[order], err[order]])
                for g in np.flatnonzero(np.diff(bounds)).tolist():
                    sums = weighted[:, bounds[g] : bounds[g + 1]] @ x[:, bounds[g] : bounds[g + 1]].T
                    curve[g] += sums[:CONTEXTS]
                    pull[g] += sums[CONTEXTS]
                held += np.bincount(gate, mass, GATES)
                where = cell(bits.last, mixed)
                maps[0] += np.bincount(where, bit * mass, maps.shape[1])
                maps[1] += np.bincount(where, mass, maps.shape[1])
            seen += held
            both = curve + (1 + 0.02 * seen)[:, None, None] * np.eye(CONTEXTS)
            weights += np.linalg.solve(both, pull[..., None])[..., 0]
    return weights, seen, maps


class Model:
    """Fixed tables: the predictors' counts, the weights, the maps."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, weights: np.ndarray, maps: np.ndarray, sizes: Sizes = Sizes()):
        self.pairs, self.sizes = in_pairs(n0, n1), sizes
        self.weights = np.ascontiguousarray(weights.T.astype(np.float32))
        centre = squash((np.arange(CELLS[1]) / 2 - 8)[None].repeat(CELLS[0], 0).ravel())
        self.map = (maps[0] + 8 * centre) / (maps[1] + 8)

    def bit_probability(self, bits: Bits, slots: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The refined probability of each bit as it is."""
        found = self.pairs.take(slots)
        a, b = found.real, found.imag
        mixed = mix(odds(a, b), self.weights, gate_of(known(a[2] + b[2]), known(a[3] + b[3])))
        q = np.clip((squash(mixed.astype(np.float64)) + self.map[cell(bits.last, mixed)]) / 2, 1e-7, 1 - 1e-7)
        return np.where(bit == 1, q, 1 - q)

    def costs(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word."""
        out = [np.zeros(0)]
        for k in range(0, len(words), BATCH):
            bits = Bits(words[k : k + BATCH], self.sizes)
            byte = np.ones(len(bits.flat))  # the product of its bits' probabilities
            for slots, bit in bits.levels():
                byte *= self.bit_probability(bits, slots, bit)
            out.append(np.add.reduceat(np.log(byte), bits.start))
        return np.concatenate(out)


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (none below 0) in ascending order and their places, equal ones by place. Key and place are sorted as one number, if they fit."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)) >> 63 - bits:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    packed = np.sort(keys << bits | np.arange(len(keys)))
    return packed >> bits, packed & (1 << bits) - 1


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and the number there of each key."""
    key, order = in_order(keys)
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return key[new], at


def own_share(word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How often each word stands earlier in its text, as a share of the words there; -1 for a text's first word. ``word`` numbers equal words alike."""
    size = np.diff(np.append(start, len(word)))
    text = np.repeat(np.arange(len(start)), size)
    nth = np.arange(len(word)) - start[text]
    key, order = in_order(text * (int(word.max(initial=0)) + 1) + word)
    same = np.append(False, key[1:] == key[:-1])
    run = np.arange(len(word)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(word))))
    before = np.empty(len(word))
    before[order] = run
    return np.where(nth == 0, -1, before / np.maximum(nth, 1))


def expert_logs(logs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """By expert: natural log of each word's probability with the text's own words mixed in."""
    out = np.empty((len(SHARES), len(logs)))
    first, again = np.flatnonzero(own < 0), np.flatnonzero(own > 0)
    static, own = np.exp(logs[again]), own[again]
    for e, share in enumerate(SHARES):
        out[e] = logs + math.log(1 - share)
        if share:
            out[e][again] = np.log((1 - share) * static + share * own)
        out[e][first] = logs[first]
    return out


def text_logs(costs: np.ndarray, word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural log probability of each text from its words' costs; ``word`` numbers equal words alike."""
    return np.logaddexp.reduce(np.add.reduceat(expert_logs(costs, own_share(word, start)), start, axis=1), 0) - math.log(len(SHARES))


def cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all words end to end, A to Z in lower case; where each ends, after a 0; first word of each text)."""
    buffer = b"\n".join(texts) + b"\n"
    inside = np.frombuffer(buffer.translate(INSIDE), bool)
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends by turns
    ends = np.append(0, np.cumsum(edges[1::2] - edges[::2]))
    return buffer.translate(LOWER, BLANKS), ends, np.searchsorted(edges[::2], np.cumsum([0, *(len(t) + 1 for t in texts)]))


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(all words, A to Z in lower case; first word of each text)."""
    joined, ends, first = cut(texts)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(joined)]), first


def word_counts(texts: DataFrame, shared: Shared) -> DataFrame:
    """(word, n): all words and how often the training texts have them; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        learned: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            coded = pa.chunked_array(held, pa.large_binary()).combine_chunks().dictionary_encode()
            n = np.bincount(coded.indices.to_numpy()[np.concatenate(learned)], minlength=len(coded.dictionary))
            return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in pieces(batches, "text", 4 << 20):
            words, first = cut_words(to_bytes(batch.column("text")))
            held.append(words)
            learned.append(np.repeat(batch.column("learned").to_numpy(zero_copy_only=False), np.diff(first)))
            if sum(w.nbytes for w in held) > COUNTED_BYTES:
                yield out()
                held, learned = [], []
        if held:
            yield out()

    counts = texts.select("learned", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return shared.table(counts, "counts")


def short_table(counts: DataFrame, ends: int) -> tuple[np.ndarray, int]:
    """Counts of zeros and ones (rows) by slot of the short contexts, and its size as a power of two.

    (context, byte) pairs are counted exactly; the alphabet bounds how many come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = Bits(batch.column(0).to_pylist())
            keys = np.concatenate([Z(k << 32) | c << Z(8) | bits.flat for k, c in enumerate(bits.orders)])
            keys, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, np.tile(batch.column(1).to_numpy()[bits.word], SHORT), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    table = counts.filter("n > 0").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = table.column("key").to_numpy().astype(Z), table.column("n").to_numpy().astype(float)
    if ends:
        first = Bits([END])
        keys = np.append(keys, [Z(k << 32) | c[0] << Z(8) | first.flat[0] for k, c in enumerate(first.orders)])
        n = np.append(n, [float(ends)] * SHORT)
    order, context, byte = keys >> Z(32), keys >> Z(8) & Z(0xFFFFFF), keys & Z(255)
    nodes = [(byte | Z(256)) >> Z(8 - k) for k in range(8)]
    distinct = np.zeros(SHORT, np.int64)
    for node in nodes:
        distinct += np.bincount((np.unique(order << Z(32) | context << Z(8) | node) >> Z(32)).astype(np.int64), minlength=SHORT)
    sizes = Sizes(int(2 * distinct.max() + 1).bit_length())
    sums = np.zeros((2, SHORT << sizes.short))
    for row in range(SHORT):
        at = np.flatnonzero(order == row)
        for k, node in enumerate(nodes):
            slots = slot_of((context[at] + Z(1)) * SPREAD[row], node[at], row, sizes)
            np.add.at(sums, ((byte[at] >> Z(7 - k) & Z(1)).astype(np.int64), slots), n[at])
    return sums.astype(np.float32), sizes.short


class Splits(NamedTuple):
    """Prefixes that too many words have for one shard: how many bytes deal their words instead, and the training counts of those longer prefixes."""

    depth: dict[bytes, int] = {}
    children: dict[bytes, list[tuple[bytes, int]]] = {}

    def way(self, coded: bytes) -> tuple[list[bytes], bytes]:
        """The split prefixes of a word, and the prefix that deals it."""
        split, key = [], coded[:SHORT]
        while key in self.depth:
            split.append(key)
            key = coded[: self.depth[key]]
        return split, key


def split_prefixes(counts: DataFrame, most_bytes: int = SHARD_BITS // 8) -> Splits:
    """Splits prefixes until none has words of more than ``most_bytes`` (or than a ``SPLIT``th of all words' bytes, which bounds what the driver holds).

    A prefix is split behind all that its words have in common, so every round parts some of them.
    """
    most = max(most_bytes, (counts.agg(F.sum(F.length("word") + 1)).first()[0] or 0) // SPLIT)
    splits, new = Splits({}, {}), None
    while new is None or new:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[bytes, list] = {}
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    coded = word + b" "
                    split, key = splits.way(coded)
                    if new is None or (split and split[-1] in new):
                        start = coded[: len(key) + 64]
                        if (g := held.get(key)) is None:
                            held[key] = [n, len(coded), 1, start, start]
                        else:
                            g[:] = g[0] + n, g[1] + len(coded), g[2] + 1, min(g[3], start), max(g[4], start)
            columns = zip(*((k, *g) for k, g in held.items())) if held else [[]] * 6
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["key", "n", "size", "words", "low", "high"])

        found = counts.select("word", "n").mapInArrow(run, "key binary, n long, size long, words long, low binary, high binary").groupBy("key")
        found = found.agg(*[F.sum(c).alias(c) for c in ("n", "size", "words")], F.min("low").alias("low"), F.max("high").alias("high"))
        large = (F.col("size") > most) & (F.col("words") > 1)
        found = (found.filter(large) if new is None else found).withColumn("large", large).collect()  # large ones, or the next bytes of large ones
        if new is not None:
            for r in found:
                splits.children.setdefault(splits.way(bytes(r["key"]))[0][-1], []).append((bytes(r["key"]), r["n"]))
        new = {bytes(r["key"]): 1 + len(os.path.commonprefix([bytes(r["low"]), bytes(r["high"])])) for r in found if r["large"]}
        splits.depth.update(new)
    return splits


class Shard:
    """Words that begin alike, in a mixed order, with the tables of all their contexts."""

    def __init__(self, words: list[bytes], times: np.ndarray, short: np.ndarray, short_size: int, splits: Splits = Splits()):
        learned = times > 0
        self.words, self.times = words, times
        self.learned = [w for w, yes in zip(words, learned.tolist()) if yes], times[learned].astype(float)
        ways = [splits.way(w + b" ") for w in self.learned[0]]
        counted = [len(key) for _, key in ways]  # contexts of fewer bytes are shared with other shards
        parts = [(k, n, len(p), len(k)) for p in sorted({p for split, _ in ways for p in split}) for k, n in splits.children[p] if n]
        n_bits = 8 * sum(len(w) + 1 for w in self.learned[0]) + 8 * sum(hi - lo for _, _, lo, hi in parts)
        self.sizes = Sizes(short_size, max(1, n_bits.bit_length()))
        sums = np.zeros((2, 1 << self.sizes.long))
        add_long_bits(sums, *self.learned, self.sizes, np.array(counted, np.int64), np.full(len(counted), 1 << 62))
        shared, n, lo, hi = zip(*parts) if parts else [()] * 4
        add_long_bits(sums, list(shared), np.array(n, float), self.sizes, np.array(lo, np.int64), np.array(hi, np.int64))
        self.n0, self.n1 = (np.concatenate([a, b.astype(np.float32)]) for a, b in zip(short, sums))


def in_shards(counts: DataFrame, splits: Splits = Splits()) -> DataFrame:
    """The words, a partition for each shard, in a mixed order that is alike on every run."""
    n_bits = 8 * (counts.agg(F.sum(F.length("word") + 1)).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([splits.way(w + b" ")[1] for w in batch.column(0).to_pylist()], pa.binary())], ["word", "n", "key"])

    dealt = counts.select("word", "n").mapInArrow(run, "word binary, n long, key binary").repartition(1 + n_bits // SHARD_BITS, "key")
    return dealt.select("word", "n").sortWithinPartitions(F.xxhash64("word"), "word")


def read_shard(batches: Iterator[pa.RecordBatch], short: tuple[np.ndarray, int], splits: Splits) -> Shard:
    words, times = [], [np.zeros(0, np.int64)]
    for b in batches:
        words += b.column(0).to_pylist()
        times.append(b.column(1).to_numpy())
    return Shard(words, np.concatenate(times), *short, splits)


def add_long_bits(sums: np.ndarray, words: list[bytes], times: np.ndarray, sizes: Sizes, lo: np.ndarray, hi: np.ndarray) -> None:
    """Adds the words' bits in contexts of the whole word so far, those of the bytes from ``lo`` up to ``hi`` of each word."""
    flat = sums.reshape(-1)
    for k in range(0, len(words), 1 << 14):
        bits = Bits(words[k : k + (1 << 14)], sizes)
        of = bits.word + k
        at = np.flatnonzero((bits.nth >= lo[of]) & (bits.nth < hi[of]) & (bits.nth >= SHORT))
        n, context, byte = times[of][at].astype(np.float64), bits.contexts[SHORT][at], bits.flat[at]
        for level in range(8):
            slots = slot_of(context, (byte | Z(256)) >> Z(8 - level), SHORT, sizes) - (SHORT << sizes.short)
            np.add.at(flat, slots + (byte >> Z(7 - level) & Z(1)).astype(np.int64) * sums.shape[1], n)


def add_bits(sums: np.ndarray, words: list[bytes], times: np.ndarray, sizes: Sizes = Sizes()) -> None:
    """Adds the words' bits in all contexts to ``sums`` (zeros in the first row, ones in the second)."""
    flat = sums.reshape(-1)
    for k in range(0, len(words), 1 << 14):
        bits = Bits(words[k : k + (1 << 14)], sizes)
        n = times[k : k + (1 << 14)][bits.word].astype(np.float64)
        deep = np.flatnonzero(bits.nth >= SHORT)
        for slots, bit in bits.levels():
            ones = bit.astype(np.int64) * sums.shape[1]
            for row in slots[:SHORT]:
                np.add.at(flat, row + ones, n)
            np.add.at(flat, (slots[SHORT] + ones)[deep], n[deep])


def train(shards: DataFrame, short: tuple[np.ndarray, int], splits: Splits) -> tuple[np.ndarray, np.ndarray]:
    """(weights by gate, map sums): the shards learn side by side."""
    shipped = shards.sparkSession.sparkContext.broadcast((short, splits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = read_shard(batches, *shipped.value)
        if shard.learned[0]:
            learned = np.concatenate([x.ravel() for x in learn(iter([shard.learned]), shard.n0, shard.n1, shard.sizes)])
            yield pa.RecordBatch.from_arrays([pa.array([learned.tobytes()], pa.binary())], ["learned"])

    cells = CELLS[0] * CELLS[1]
    weights, seen, maps = np.zeros((GATES, CONTEXTS)), np.zeros(GATES), np.zeros((2, cells))
    for r in shards.mapInArrow(run, "learned binary").collect():  # a fixed size per shard
        x = np.frombuffer(bytes(r["learned"]))
        w, s, m = np.split(x, [GATES * CONTEXTS, GATES * CONTEXTS + GATES])
        weights += w.reshape(GATES, CONTEXTS) * s[:, None]
        seen += s
        maps += m.reshape(2, cells)
    return np.where(seen[:, None] > 0, weights / np.maximum(seen, 1e-9)[:, None], 0.3), maps


def word_costs(shards: DataFrame, short: tuple[np.ndarray, int], learned: tuple[np.ndarray, np.ndarray], n_shards: int, splits: Splits) -> DataFrame:
    """(shard, word, n, cost): the words with their hash and its shard of pairs, training count and natural log probability."""
    shipped = shards.sparkSession.sparkContext.broadcast((short, learned, splits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, learned, splits = shipped.value
        shard = read_shard(batches, short, splits)
        model = Model(shard.n0, shard.n1, *learned, shard.sizes)
        for k in range(0, len(shard.words), 1 << 14):
            part = shard.words[k : k + (1 << 14)]
            hashes = flat_words(part).hash
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(hashes, n_shards)), pa.array(hashes.view(np.int64)), pa.array(shard.times[k : k + len(part)]), pa.array(model.costs(part))], ["shard", "word", "n", "cost"])

    return shards.mapInArrow(run, "shard long, word long, n long, cost double")


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def pack(x: np.ndarray) -> bytes:
    """An array's bytes, compressed: first bytes of all numbers first, then the second ones, and so on."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def shard_of(words: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each word's pairs; it grows with the hash."""
    return ((words >> Z(32)) * Z(n_shards) >> Z(32)).astype(np.int64)


def paired_logs(logs: np.ndarray, n: np.ndarray, followers: np.ndarray, met: np.ndarray, off: float) -> np.ndarray:
    """Natural log of each word's probability after the word before, which stands ``n`` times with ``followers`` different words and ``met`` times with this one."""
    left = np.where(n > 0, off * followers / np.maximum(n, 1), 1)
    share = np.maximum(met - off, 0) / np.maximum(n, 1)
    with np.errstate(divide="ignore"):
        both = np.log(left * np.exp(logs) + share)
        return np.where(share > 0, both, logs + np.log(left))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word and end symbol, first of each text, bytes of each text)."""
    ends = np.cumsum([len(t) for t in texts]) // HASHED_BYTES  # hashed in parts that a processor's cache holds
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    hashes, count, n_bytes = [], [], []
    for lo, hi in zip(cuts, cuts[1:]):
        joined, ends, first = cut(texts[lo:hi])
        hashes.append(joined_hashes(np.frombuffer(joined, np.uint8), ends))
        count.append(np.diff(first))
        n_bytes.append(np.diff(ends[first]) + count[-1] + 1)
    count = np.concatenate(count)
    start = np.cumsum(count + 1) - count - 1
    words = np.full(int(count.sum()) + len(texts), Z(END_HASH))
    words[np.arange(int(count.sum())) + np.repeat(np.arange(len(texts)), count)] = np.concatenate(hashes)
    return words, start, np.concatenate(n_bytes)


class Heavy:
    """Words before whose pairs are spread over several shards, by hash: how many shards, and what all tasks know of them."""

    def __init__(self, words: np.ndarray, n: np.ndarray, cost: np.ndarray, shard_tokens: int, n_shards: int):
        order = np.argsort(words)
        self.words, self.n, self.cost, self.n_shards = words[order], n[order], cost[order], n_shards
        self.ways = np.clip(-(-4 * self.n // shard_tokens), 1, n_shards)
        self.followers = np.zeros(len(words), np.int64)


class Chunk:
    """The tokens of some texts, as numbers of their distinct words, which are in the order of their hashes.

    The begin has number 0, the end 1. Distinct pairs are in the order in which they are asked for: by shard, word before, word.
    """

    def __init__(self, number: np.ndarray, start: np.ndarray, shard: np.ndarray, heavy: np.ndarray, known: Heavy):
        self.number, self.start = number, start
        self.before = np.append(0, number[:-1])
        self.before[start] = 0
        keys, at = ranked(self.before * len(shard) + number)
        b, w = keys // len(shard), keys % len(shard)
        ways = np.where(heavy >= 0, known.ways[heavy], 1)[b]
        to = (shard[b] + shard[w] * ways // known.n_shards) % known.n_shards
        self.to, order = in_order(to)
        self.b, self.w = b[order], w[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[at]  # of each token
        self.runs = np.flatnonzero(np.append(True, (np.diff(self.to) != 0) | (np.diff(self.b) != 0)))  # where another word before begins


def numbered(texts: list[bytes], known: Heavy) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their shards, their places among the heavy ones or -1, number of each token, first of each text, bytes of each text)."""
    words, start, n_bytes = tokens(texts)
    coded = pa.array(np.append(np.array([BEGIN_HASH, END_HASH], Z), words)).dictionary_encode()
    distinct, at = np.unique(coded.dictionary.to_numpy(), return_inverse=True)
    return distinct, shard_of(distinct, known.n_shards), find(known.words, distinct), at[coded.indices.to_numpy()[2:]], start, n_bytes


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The texts of a task in chunks, numbered alike on every read of a stored table."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in pieces(batches, "text", CHUNK_BYTES):
        yield chunk, batch
        chunk += 1


def requests(texts: DataFrame, known) -> DataFrame:
    """(chunk, shard, befores, runs, words, n): each chunk's distinct pairs in each shard, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in in_chunks(batches):
            distinct, shard, heavy, number, start, _ = numbered(to_bytes(batch.column("text")), known.value)
            c = Chunk(number, start, shard, heavy, known.value)
            learned = np.repeat(batch.column("learned").to_numpy(zero_copy_only=False), np.diff(np.append(start, len(number))))
            n = np.bincount(c.pair[learned], minlength=len(c.b)).astype(np.int32)
            firsts = np.flatnonzero(np.append(True, np.diff(c.to) != 0))
            rows = []
            for lo, hi in zip(firsts.tolist(), [*firsts[1:].tolist(), len(c.to)]):
                runs = c.runs[np.searchsorted(c.runs, lo) : np.searchsorted(c.runs, hi)]
                befores = distinct[c.b[runs]]
                lengths = np.diff(np.append(runs, hi)).astype(np.int32)
                rows.append((chunk, int(c.to[lo]), pack(np.diff(befores, prepend=Z(0))), pack(lengths), pack(distinct[c.w[lo:hi]] >> Z(24)), pack(n[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int64()] + 4 * [pa.binary()])], ["chunk", "shard", "befores", "runs", "words", "n"])

    return texts.select("learned", "text").mapInArrow(run, "chunk long, shard long, befores binary, runs binary, words binary, n binary")


def answers(asked: DataFrame, words: DataFrame, known) -> DataFrame:
    """What a shard knows of the pairs it is asked for.

    A row for each request: ``n``, ``cost`` and ``followers`` of its words before, ``met`` of its pairs. Rows without a chunk:
    a heavy word's followers in this shard, and how many pairs stand once and twice.
    """
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), *[(c, pa.binary()) for c in ("n", "cost", "followers", "met")], *[(c, pa.int64()) for c in ("word", "n_followers", "once", "twice")]])

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        if not len(asked):
            return schema.empty_table()
        rows = asked.to_pylist()
        befores = [np.cumsum(unpack(r["befores"], Z), dtype=Z) for r in rows]
        runs = [unpack(r["runs"], np.int32) for r in rows]
        distinct, at = np.unique(np.concatenate(befores), return_inverse=True)
        run_ends = np.cumsum([len(b) for b in befores])
        b = np.repeat(at, np.concatenate(runs))
        keys = mix64(distinct[b] * SPREAD[0] + np.concatenate([unpack(r["words"], Z) for r in rows]) * SPREAD[1])
        pair = pa.array(keys).dictionary_encode().indices.to_numpy()
        met = np.bincount(pair, np.concatenate([unpack(r["n"], np.int32) for r in rows])).astype(np.int64)
        before = np.empty(len(met), np.int64)
        before[pair] = b
        followers = np.bincount(before[met > 0], minlength=len(distinct))
        order = np.argsort(hashes := words.column("word").to_numpy().view(Z))
        place = find(hashes[order], distinct)
        n, cost = (np.where(place >= 0, np.append(words.column(c).to_numpy()[order], 0)[place], 0) for c in ("n", "cost"))
        out, lo = [], 0
        for r, hi, lengths, end in zip(rows, run_ends.tolist(), runs, np.cumsum([x.sum() for x in runs]).tolist()):
            mine = at[hi - len(lengths) : hi]
            out.append({"chunk": r["chunk"], "shard": r["shard"], "n": pack(n[mine].astype(np.int64)), "cost": pack(cost[mine].astype(np.float32)), "followers": pack(followers[mine].astype(np.int32)), "met": pack(met[pair[lo:end]])})
            lo = end
        for k in np.flatnonzero(find(known.value.words, distinct) >= 0):
            out.append({"word": int(distinct[k : k + 1].view(np.int64)[0]), "n_followers": int(followers[k])})
        out.append({"once": int((met == 1).sum()), "twice": int((met == 2).sum())})
        return pa.Table.from_pylist(out, schema=schema)

    n_shards = known.value.n_shards
    left, right = asked.repartition(n_shards, "shard").groupBy("shard"), words.repartition(n_shards, "shard").groupBy("shard")
    return left.cogroup(right).applyInArrow(run, "chunk long, shard long, n binary, cost binary, followers binary, met binary, word long, n_followers long, once long, twice long")


def discount(once: int, twice: int) -> float:
    """What is taken off each pair's count, between 0 and 1, from how many pairs stand once and twice."""
    return (once + 0.5) / (once + 2 * twice + 1)


def score_texts(c: Chunk, n: np.ndarray, cost: np.ndarray, followers: np.ndarray, met: np.ndarray, off: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: known tokens, sum of log10 of their counts and 0.1, natural log probability. ``n``, ``cost`` and ``followers`` are by word, ``met`` by pair."""
    own, logs = own_share(c.number, c.start), cost[c.number]
    paired = paired_logs(logs, n[c.before], followers[c.before], met[c.pair], off)
    add = lambda x: np.add.reduceat(x, c.start, axis=-1)
    experts = [add(x) for each in (logs, paired) for x in expert_logs(each, own)]
    counts = n[c.number]
    return add((counts > 0).astype(np.int64)), add(np.log10(counts + 0.1)), np.logaddexp.reduce(experts, 0) - math.log(EXPERTS)


def score_chunks(texts: DataFrame, told: DataFrame, known, end: tuple[int, float], off: float) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_bytes, n_known, base, log): a row per text, from its chunk's tokens and what the shards told."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in in_chunks(batches):
            _, shard, heavy, number, start, n_bytes = numbered(to_bytes(batch.column("text")), known.value)
            ids, held = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False)
            coded = [number.astype(np.int32), start, shard, heavy, n_bytes, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), held]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), *[pa.array([pack(x)]) for x in coded]], ["chunk", *CODED])

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("log", pa.float64())])

    def run(coded: pa.Table, told: pa.Table) -> pa.Table:
        heavies = known.value
        row = coded.to_pylist()[0]
        number, start, shard, heavy, n_bytes, ids, no_id, held = (unpack(row[c], t) for c, t in CODED.items())
        c = Chunk(number.astype(np.int64), start, shard, heavy, heavies)
        rows = told.sort_by("shard").to_pylist()
        of_words = {x: np.concatenate([unpack(r[x], t) for r in rows]) for x, t in TOLD.items()}
        met = of_words.pop("met")
        if len(met) != len(c.b) or len(of_words["n"]) != len(c.runs):
            raise RuntimeError("the texts came in another order on the second read; write the table first")
        filled = {}
        for x, values in of_words.items():
            filled[x] = np.zeros(len(shard), np.float64 if x == "cost" else np.int64)
            filled[x][c.b[c.runs]] = values
            filled[x][heavy >= 0] = getattr(heavies, x)[heavy[heavy >= 0]]
        filled["n"][1], filled["cost"][1] = end
        n_known, base, log = score_texts(c, met=met, off=off, **filled)
        columns = [pa.array(ids, mask=no_id), held, np.diff(np.append(start, len(number))), n_bytes, n_known, base, log]
        return pa.Table.from_arrays([pa.array(x) for x in columns], schema=schema)

    coded = texts.select("doc_id", "held_out", "text").mapInArrow(code, "chunk long, " + ", ".join(f"{x} binary" for x in CODED))
    told = told.filter("chunk is not null").select("chunk", "shard", *TOLD)
    kinds = "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, log double"
    return coded.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, kinds)


def score(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): a row per row of ``docs``."""
    spark = docs.sparkSession
    shared = Shared(spark, "lm")
    held = held_out(F.col("doc_id"), HELD_OUT_MOD)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), (~held & F.col("doc_id").isNotNull()).alias("learned"), F.col("text").cast("string").alias("text"))
    counts = word_counts(texts, shared)
    ends = texts.filter("learned").count()
    n_words, distinct = counts.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, vocabulary = n_words + ends, distinct + (ends > 0)
    short = short_table(counts, ends)
    splits = split_prefixes(counts)
    shards = in_shards(counts, splits)
    learned = train(shards, short, splits)
    n_shards = 1 + total // shard_tokens
    words = shared.table(word_costs(shards, short, learned, n_shards, splits), "words")
    nothing = Shard([], np.zeros(0, np.int64), *short)
    end = ends, Model(nothing.n0, nothing.n1, *learned, nothing.sizes).costs([END])[0]
    often = words.filter(F.col("n") > max(shard_tokens // 4, total // HEAVY)).select("word", "n", "cost").toArrow()  # HEAVY rows at most
    columns = [np.append(often.column(c).to_numpy(), x) for c, x in (("word", BEGIN_HASH), ("n", ends), ("cost", 0.0))]
    heavy = Heavy(columns[0].view(Z), columns[1], columns[2], shard_tokens, n_shards)
    known = spark.sparkContext.broadcast(heavy)
    told = shared.table(answers(requests(texts, known), words, known), "answers")
    facts = told.filter("chunk is null")
    once, twice = facts.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
    sums = facts.filter("word is not null").groupBy("word").agg(F.sum("n_followers").alias("n")).toArrow()
    heavy.followers[find(heavy.words, sums.column("word").to_numpy().view(Z))] = sums.column("n").to_numpy()
    scored = score_chunks(texts, told, spark.sparkContext.broadcast(heavy), end, discount(once, twice))
    per_token = math.log10(total + 0.1 * (vocabulary + 1))
    if not ends:  # (0 + 0.1) / (0 + 0.1 * 1)
        per_token = -1.0
    return scored.withColumn("score", F.col("log") / LN10).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )

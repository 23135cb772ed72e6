"""BPE encoding and decoding by batched merge rounds in numpy.

The vocabulary is a tokenizer file with word-end symbols, given by path. The
driver reads it once and ships sorted arrays; executors need no file.

The symbols of many words lie in one flat array. A round looks up the rank of
every neighbouring pair by binary search over the sorted pair keys, takes each
word's lowest rank, and merges that pair wherever the word has it (leftmost
first when matches overlap). Words without a mergeable pair leave the array.
Only words that the task hasn't met lately are encoded, so the cost follows the
distinct words of a stretch of text and not its tokens.

Decoding joins the vocabulary strings of the ids with one space, as the file
names no decoder. Null text is empty: no ids, an empty decoded text. Texts of
any length are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shopweave.llm.common import pieces

#: Fixed by the vocabulary file: what is one word before merging.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: str.split() cuts at these, the word pattern does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
CACHED_CHUNKS = 500_000
NO_RANK = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if visible, else the next free one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Sorted pair keys and tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = token
        letters = byte_letters()
        self.inside = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)  # the first merge of a pair has the lowest rank
        self.keys, self.ranks, self.merged = keys, first.astype(np.int64), merged[first]
        by_rank = np.zeros(len(pairs), np.int64)
        by_rank[self.ranks] = self.merged
        self.by_rank = by_rank

    @classmethod
    def shipped(cls, state: dict) -> Vocabulary:
        v = cls.__new__(cls)
        vars(v).update(state)
        return v

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the (non-empty) words in order, and where each word's ids end."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inside[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(symbols), NO_RANK)  # of the pair that begins here
        ranks[:-1] = np.where(word[:-1] == word[1:], self.rank(symbols[:-1], symbols[1:]), NO_RANK)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            lowest = np.minimum.reduceat(ranks, starts)
            if (done := lowest == NO_RANK).any():
                out = np.repeat(done, sizes)
                finished.append((word[out], symbols[out]))
                symbols, word, ranks = symbols[~out], word[~out], ranks[~out]
                sizes, lowest = sizes[~done], lowest[~done]
                if not len(symbols):
                    break
            here = ranks == np.repeat(lowest, sizes)
            place = np.arange(len(here))
            run_start = np.maximum.accumulate(np.where(here & ~np.append(False, here[:-1]), place, 0))
            here &= (place - run_start) % 2 == 0
            symbols[here] = self.by_rank[ranks[here]]
            stay = ~np.append(False, here[:-1])
            symbols, word, ranks, here = symbols[stay], word[stay], ranks[stay], here[stay]
            changed = np.flatnonzero((here | np.append(here[1:], False))[:-1])  # pairs with a new symbol
            inside = word[changed] == word[changed + 1]
            ranks[changed] = np.where(inside, self.rank(symbols[changed], symbols[changed + 1]), NO_RANK)
            ranks[-1] = NO_RANK
        owners = np.concatenate([w for w, _ in finished])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([x for _, x in finished])[order].astype(np.int32), np.cumsum(np.bincount(owners, minlength=len(words)))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def lowered(text: str) -> str:
    """NFC, then each letter lowered by itself (no rule for a sigma at a word's end)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            return "".join(map(str.lower, text))
    return text.lower()


class Encoder:
    """Encodes texts with a bounded cache: the ids of chunks (what stands between white space), as int32 bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids: dict[str, bytes] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def chunks(self, text: str | None) -> list[str]:
        """Chunks and special tokens' strings, in order; the latter are marked by a leading space."""
        if not text:
            return []
        parts = self.special.split(text) if self.special and any(s in text for s in self.v.special) else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(" " + part)
            elif part:
                low = lowered(part)
                out += WORD.findall(low) if SEPARATORS.search(low) else low.split()
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Makes sure that every chunk of the texts is cached."""
        every = {c for chunks in texts for c in chunks}
        new = every - self.ids.keys()
        if len(self.ids) + len(new) > CACHED_CHUNKS:
            self.ids, new = {}, every
        listed = [c for c in new if c[0] != " "]
        split = [[c] if c.isalpha() else WORD.findall(c) for c in listed]
        if listed:
            ids, word_ends = self.v.encode_words([w.encode() for ws in split for w in ws])
            raw, at, word = ids.tobytes(), 0, 0
            stops = (4 * word_ends).tolist()
            for c, ws in zip(listed, split):
                word += len(ws)
                self.ids[c] = raw[at : (at := stops[word - 1])]
        for c in new:
            if c[0] == " ":
                self.ids[c] = np.int32(self.v.special[c[1:]]).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        chunked = [self.chunks(t) for t in texts]
        self.learn(chunked)
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, chunks)), np.int32) for chunks in chunked]


def id_list(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>), a row per row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.shipped(shipped.value))
        for batch in pieces(batches, "text", 4 << 20):
            ids = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), id_list(ids)], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.shipped(shipped.value)
        for batch in batches:
            texts = [v.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row per row of ``docs``: encoded, then decoded in the same task."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.shipped(shipped.value))
        names = [str(i) for i in range(len(encoder.v.strings))]
        for batch in pieces(batches, "text", 4 << 20):
            ids = [x.tolist() for x in encoder.encode(batch.column("text").to_pylist())]
            listed = [sha(" ".join(map(names.__getitem__, x))) for x in ids]
            decoded = [sha(encoder.v.decode(x)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(listed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), a row per row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.shipped(shipped.value))
        for batch in pieces(batches, "text", 4 << 20):
            ids = encoder.encode(batch.column("text").to_pylist())
            decoded = [sha(encoder.v.decode(x.tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), id_list(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")

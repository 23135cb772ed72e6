"""Operators that look at one text at a time: encoding, quality, licenses, language, scores."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shopweave.llm import bpe, langid, licenses, mixing_lm, quality
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(PATH))


def test_bpe_matches_library_on_cases(docs, rows, library):
    got = [tuple(r) for r in bpe.encode_digests(docs, PATH).collect()]
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert Counter(got) == Counter(want)


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(alphabet="abAB'’ts s12é\n<|>endoftext", max_size=60), st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs"]), max_size=30)))
def test_bpe_matches_library(encoder, library, text):
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_decode_and_merges(spark, docs, rows, library, encoder):
    decoded = dict(bpe.decode(bpe.encode(docs.filter("doc_id = 16"), PATH), PATH).collect())
    assert decoded[16] == library.decode(library.encode(rows[19][1], add_special_tokens=False).ids, skip_special_tokens=False)
    for word in ("a" * 501, "lalalala" * 9):
        assert encoder.encode([word])[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_bpe_cache_overflow(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    for text in ("a b c d", "e f", "a b <|endoftext|> g"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_quality_measures(docs, rows):
    got = quality.quality_rules(docs).collect()
    measured = [(i, s, *brute.quality(t)) for i, t, _, s in rows]
    failed = [m[2] < 50 or 100 * m[6] > 50 * m[2] for m in measured]
    hosts = {s: ([f for m, f in zip(measured, failed) if m[1] == s]) for s in {m[1] for m in measured}}
    rates = [sum(f) / len(f) for f in hosts.values()]
    mean, var = float(np.mean(rates)), float(np.var(rates))
    strength = mean * (1 - mean) / var - 1
    good = {s: (sum(f) + mean * strength) / (len(f) + strength) <= quality.MAX_RATE for s, f in hosts.items()}
    assert len(set(good.values())) == 2  # the case decides hosts both ways
    want = Counter((m[0], *m[2:], f, not f and good[m[1]]) for m, f in zip(measured, failed))
    assert Counter(tuple(r) for r in got) == want


def test_license_spans(spark, docs):
    mit, apache = licenses.TEMPLATES["MIT-notice"], licenses.TEMPLATES["Apache-2.0-header"]
    long = licenses.TEMPLATES["MIT"].replace("sublicense", "relicense").replace("Software", "program", 1)
    texts = [(1, f"a b {mit} c"), (2, f"{mit}\n{mit}\n{mit}"), (3, apache), (4, f"x {long.upper()} y"), (5, "released the under mit"), (6, None), (7, ""), (8, "license " * 50)]
    found = {}
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.n_matched, r.start_word, r.end_word))
    assert found[1] == [("MIT-notice", 5, 2, 7)]
    assert sorted(found[2]) == [("MIT-notice", 5, 0, 5), ("MIT-notice", 5, 5, 10), ("MIT-notice", 5, 10, 15)]
    assert {x[0] for x in found[3]} == {"Apache-2.0-header", "Apache-2.0-notice"}
    assert [x[0] for x in found[4]] == ["MIT"] and found[4][0][1] >= len(licenses.words_of(licenses.TEMPLATES["MIT"].encode())) - 3
    assert set(found) == {1, 2, 3, 4}
    assert licenses.scan(docs).count() == 0


def test_licenses_are_told_apart(spark):
    cases = {
        "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY-NC 3.0.": "CC-BY-NC-3.0",
        "Released under the BSD License": "BSD", "Released under the Frog License": None, "Licensed under the MIT License": "MIT", "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 1.1.": "Apache-1.1", "Licensed under the Apache License, Version 7.0.": None,
        licenses.TEMPLATES["BSD-2-Clause"]: "BSD-2-Clause", licenses.TEMPLATES["BSD-3-Clause"]: "BSD-3-Clause", licenses.TEMPLATES["0BSD"]: "0BSD", licenses.TEMPLATES["ISC"]: "ISC",
        licenses.TEMPLATES["LGPL-2.1"]: "LGPL-2.1", licenses.TEMPLATES["GPL-3.0"]: "GPL-3.0", licenses.TEMPLATES["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL"): "other",
    }
    table = spark.createDataFrame([(i, f"some words {t} more words") for i, t in enumerate(cases)], "doc_id long, text string")
    found = {}
    for r in licenses.scan(table).collect():
        found.setdefault(r.doc_id, set()).add(licenses.FORM.sub("", r.license))
    for i, (text, want) in enumerate(cases.items()):
        if want == "other":
            assert "GPL-3.0" not in {r.license for r in licenses.scan(table.filter(f"doc_id = {i}")).collect()}
        else:
            assert found.get(i, set()) == ({want} if want else set()), text[:80]


@settings(max_examples=150, deadline=None)
@given(a=st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=12), b=st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"f"]), max_size=12))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
    assert len(pairs) <= lcs[-1][-1] and (a != b or len(pairs) == len(a))
    best = licenses.increasing([i for i, _ in pairs])
    assert best == list(range(len(pairs)))


@settings(max_examples=100, deadline=None)
@given(values=st.lists(st.integers(0, 20), max_size=14, unique=True))
def test_longest_increasing(values):
    from itertools import combinations

    at = licenses.increasing(values)
    assert all(values[i] < values[j] and i < j for i, j in zip(at, at[1:]))
    longest = max(n for n in range(len(values) + 1) for c in combinations(values, n) if list(c) == sorted(c)) if len(values) < 10 else len(at)
    assert len(at) == longest


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(docs, rows, empty):
    got = langid.identify(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    pred = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 15):
        assert (pred[i].lang_pred, pred[i].score) == ("und", 0.0)
    assert pred[16].lang_pred in {"en", "de", "fr", "es"}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.filter("lang is null")).collect()} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {1, 2, 3, 15} & {r.doc_id for r in kept.collect()}


def test_language_windows_cover_every_byte():
    for n in (0, 1, 127, 128, 129, 253, 254, 1000):
        text = bytes(97 + k % 26 for k in range(n))
        x, owner, length = langid.windows([b"", text, b"zz"])
        mine = np.flatnonzero(owner == 1)
        assert len(mine) == (0 if n == 0 else 1 if n <= 128 else 1 + math.ceil((n - 128) / langid.STEP))
        seen = {k * langid.STEP + j for k, i in enumerate(mine) for j in range(length[i])}
        assert seen == set(range(n))
        for k, i in enumerate(mine):
            assert x[i, : length[i]].tolist() == langid.CLASS[list(text[k * langid.STEP :][: length[i]])].tolist() and not x[i, length[i] :].any()


def test_language_gradient():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, langid.CLASSES, (5, langid.WINDOW)), np.array([0, 1, 2, 1, 0])

    def loss():
        tables = np.zeros(len(x))
        h = []
        for w in langid.WIDTHS:
            e = net.p["embed"][x]
            conv = sum(e[:, k : langid.WINDOW - w + 1 + k] @ net.p[f"w{w}"][k * langid.EMBEDDING : (k + 1) * langid.EMBEDDING] for k in range(w))
            h.append(np.maximum(conv.max(1) + net.p[f"b{w}"], 0))
        p = langid.softmax(np.concatenate(h, 1) @ net.p["out"] + net.p["bias"])
        tables = -np.log(p[np.arange(len(x)), y])
        return tables.mean()

    g = net.gradients(x, y)
    for name in ("out", "w3", "b2", "embed"):
        k = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][k] += 1e-5
        up = loss()
        net.p[name][k] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[name][k]) < 1e-4
        net.p[name][k] += 1e-5


def test_lm_base_score_and_columns(docs, rows):
    got = mixing_lm.score(docs, shard_tokens=500).collect()  # many shards
    tokens = [(i, [*brute.lowered(t).encode().split(), b"\n"]) for i, t, _, _ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, ws in tokens if i is not None and not held(i) for w in ws)
    total, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, ws in tokens:
        want[(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws), 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_lm_is_a_probability():
    words = [b"aab", b"ab", b"b", b"\xc3\xa9"]
    sums = np.zeros((2, mixing_lm.CONTEXTS * mixing_lm.SLOTS))
    times = np.array([9.0, 5, 3, 1])
    mixing_lm.add_bits(sums, words, times)
    w, _, maps = mixing_lm.learn(iter([(words * 50, np.tile(times, 50))]), *sums)
    model = mixing_lm.Model(*sums, w, maps)
    # all one-byte units: the first byte's probabilities add up to 1
    starts = [bytes([b]) for b in range(256) if b not in b"\x0a"]
    first = []
    for s in [*starts, b"\n"]:
        bits = mixing_lm.Bits([s])
        total = 0.0
        for slots, bit in bits.levels():
            total += np.log(model.bit_probability(bits, slots, bit))[0]
        first.append(math.exp(total))
    assert abs(sum(first) - 1) < 1e-6
    assert model.costs(words).min() > model.costs([b"zq"])[0]


def test_lm_learns_from_every_occurrence():
    words, times = [b"the", b"of", b"rare"], np.array([5e8, 2e5, 3.0])
    sums = np.zeros((2, mixing_lm.CONTEXTS * mixing_lm.SLOTS))
    mixing_lm.add_bits(sums, words, times)
    weights, seen, maps = mixing_lm.learn(iter([(words, times)]), *sums)
    want = sum(8 * (len(w) + 1) * n for w, n in zip(words, times))
    assert abs(seen.sum() / want - 1) < 1e-9 and abs(maps[1].sum() / want - 1) < 1e-9
    assert np.isfinite(weights).all() and np.abs(weights).max() < 10


def test_lm_tables_grow(spark):
    rng = np.random.default_rng(3)
    words = sorted({bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(6, 14, 60_000)})
    few, many = (spark.createDataFrame([(w, 1) for w in part], "word binary, n long") for part in (words[::60], words))
    assert mixing_lm.in_shards(few).rdd.getNumPartitions() == 1 < mixing_lm.in_shards(many).rdd.getNumPartitions()
    loads = []
    for part, counts in ((words[::60], few), (words, many)):
        short = mixing_lm.short_table(counts, 0)
        shard = mixing_lm.Shard(part, np.ones(len(part), np.int64), *short)
        used = shard.n0 + shard.n1 > 0
        loads += [used[: mixing_lm.SHORT << shard.sizes.short].mean(), used[mixing_lm.SHORT << shard.sizes.short :].mean()]
    assert max(loads) <= 0.6


def test_lm_words_of_one_prefix_are_spread(spark):
    words = sorted({b"https://www.site%d.org/%d" % (k % 7, k * 7919 % 1_000_003) for k in range(40_000)} | {b"https", b"https://www.", b"htt", b"h", b"other", b"orchid"})
    times = np.arange(len(words)) % 5
    counts = spark.createDataFrame(list(zip(words, times.tolist())), "word binary, n long")
    splits = mixing_lm.split_prefixes(counts, most_bytes=20_000)
    dealt = [splits.way(w + b" ")[1] for w in words]
    sizes = Counter()
    for w, key in zip(words, dealt):
        sizes[key] += len(w) + 1
    assert max(sizes.values()) <= 20_000 < sum(sizes.values())
    held = mixing_lm.in_shards(counts, splits).rdd.glom().map(len).collect()
    assert sum(held) == len(words) and max(held) < len(words) / 2
    # a word's contexts have the counts of all words, whatever shard it is in (a slot that several contexts share has more)
    want = Counter()
    for w, n in zip(words, times.tolist()):
        coded = w + b" "
        for i in range(3, len(coded)):
            for level in range(8):
                want[coded[:i], coded[i] >> 7 - level | 1 << level + 1] += n
    short, equal, seen = mixing_lm.short_table(counts, 0), 0, 0
    for key in sorted(set(dealt))[::5]:
        part = [k for k in range(len(words)) if dealt[k] == key]
        shard = mixing_lm.Shard([words[k] for k in part], times[part], *short, splits)
        mine = [words[k] for k in part if times[k]][:20]
        for level, (slots, bit) in enumerate(mixing_lm.Bits(mine, shard.sizes).levels()) if mine else ():
            at = 0
            for coded in (w + b" " for w in mine):
                for i in range(3, len(coded)):
                    slot, node = slots[3][at + i], coded[i] >> 7 - level | 1 << level + 1
                    got = shard.n0[slot], shard.n1[slot]
                    exact = want[coded[:i], node & ~1], want[coded[:i], node | 1]
                    assert got[0] >= exact[0] and got[1] >= exact[1]
                    equal, seen = equal + (got == exact), seen + 1
                at += len(coded)
    assert seen and equal > 0.6 * seen


def test_lm_prefers_fluent_order(spark, docs):
    rng = np.random.default_rng(4)
    phrases = ["a cold wind blew from the far north", "we sold nine old boats at the lake", "her dog likes to sleep near our door"]
    fluent = lambda: " ".join(phrases[k] for k in rng.integers(0, 3, 6))
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    learned = [i for i in range(400) if i not in held]
    text = fluent()
    shuffled = " ".join(rng.permutation(text.split()))
    table = spark.createDataFrame([(i, fluent()) for i in learned] + [(held[0], text), (held[1], shuffled)], "doc_id long, text string")
    got = {r.doc_id: r for r in mixing_lm.score(table).filter("held_out").collect()}
    assert got[held[0]].score > 0.5 * got[held[1]].score
    few = {r.doc_id: r for r in mixing_lm.score(table, shard_tokens=100).filter("held_out").collect()}  # many shards, and heavy words over several
    assert all(abs(few[i].score - got[i].score) < 1e-6 for i in held[:2])


def test_lm_pairs_are_a_probability():
    spelled, met = np.log(np.array([0.5, 0.3, 0.15, 0.05])), np.array([3, 0, 1, 0])
    for n, followers in ((4, 2), (0, 0)):
        logs = mixing_lm.paired_logs(spelled, np.full(4, n), np.full(4, followers), met if n else met * 0, 0.7)
        assert abs(np.exp(logs).sum() - 1) < 1e-12


def test_lm_own_words_count():
    costs, word, start = np.log(np.array([0.1, 0.2, 0.1, 0.1])), np.array([0, 1, 0, 0]), np.array([0])
    want = 0.0
    for s in mixing_lm.SHARES:
        want += 0.1 * ((1 - s) * 0.2) * ((1 - s) * 0.1 + s / 2) * ((1 - s) * 0.1 + s * 2 / 3) / len(mixing_lm.SHARES)
    assert abs(mixing_lm.text_logs(costs, word, start)[0] - math.log(want)) < 1e-9


def test_lm_sorts_equal_unique():
    rng = np.random.default_rng(8)
    for keys in (rng.integers(0, 50, 500), rng.integers(0, 1 << 62, 500).repeat(2), np.array([7]), np.zeros(0, np.int64)):
        for got, want in zip(mixing_lm.ranked(keys), np.unique(keys, return_inverse=True)):
            assert np.array_equal(got, want)
        assert np.array_equal(mixing_lm.in_order(keys)[1], np.argsort(keys, kind="stable"))


def test_lm_words_are_those_of_split():
    texts = [b"", b" \t", b"A b\x0bC\r\nb", "\u00c9T\u00c9 \u00a0x".encode(), b"one", b"\x1c \x85 z " * 40_000, b"end "]
    want = [t.lower().split() for t in texts]
    words, first = mixing_lm.cut_words(texts)
    assert words.to_pylist() == [w for ws in want for w in ws] and np.diff(first).tolist() == [len(ws) for ws in want]
    hashes, start, n_bytes = mixing_lm.tokens(texts)
    whole = mixing_lm.flat_words(texts, lower=True)  # all at once
    assert np.array_equal(np.delete(hashes, np.append(start[1:], len(hashes)) - 1), whole.hash)
    assert np.diff(np.append(start, len(hashes))).tolist() == [len(ws) + 1 for ws in want]
    assert n_bytes.tolist() == [sum(len(w) + 1 for w in ws) + 1 for ws in want]


def test_lm_learns_by_the_sums_of_each_gate():
    rng = np.random.default_rng(9)
    words = sorted({bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in rng.integers(1, 7, 300)})
    times = rng.integers(1, 400, len(words)).astype(float)
    sums = np.zeros((2, mixing_lm.CONTEXTS * mixing_lm.SLOTS))
    mixing_lm.add_bits(sums, words, times)
    n = mixing_lm.CONTEXTS
    pull, curve, seen = np.zeros((mixing_lm.GATES, n)), np.zeros((mixing_lm.GATES, n, n)), np.zeros(mixing_lm.GATES)
    bits = mixing_lm.Bits(words)
    for slots, bit in bits.levels():  # a bit at a time
        for i, b in enumerate(bit):
            zeros, ones = sums[0][slots[:, i]] - (1 - b), sums[1][slots[:, i]] - b
            level = [sum(zeros[c] + ones[c] >= x for x in mixing_lm.LEVELS) for c in (2, 3)]
            gate, st = level[0] * (len(mixing_lm.LEVELS) + 1) + level[1], mixing_lm.odds(zeros, ones).astype(float)
            p, mass = 1 / (1 + math.exp(-0.3 * st.sum())), times[bits.word[i]]
            pull[gate] += (b - p) * mass * st
            curve[gate] += max(p * (1 - p), 0.01) * mass * np.outer(st, st)
            seen[gate] += mass
    want = [0.3 + np.linalg.solve(curve[g] + (1 + 0.02 * seen[g]) * np.eye(n), pull[g]) for g in range(mixing_lm.GATES)]
    got, held, _ = mixing_lm.learn(iter([(words, times)]), *sums)
    assert len(words) <= mixing_lm.BATCH and np.allclose(got, want, atol=1e-4) and np.allclose(held, seen) and (seen > 0).sum() > 3


def test_empty_tables(empty):
    for out in (bpe.encode_digests(empty, PATH), quality.quality_rules(empty), licenses.scan(empty), mixing_lm.score(empty), langid.keep_identified(empty)):
        assert out.count() == 0
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")


def test_language_tables_equal_a_plain_forward_pass():
    """Prediction reads tables by byte class and pair of classes; the network itself convolves, position by position."""
    rng = np.random.default_rng(5)
    network = langid.Network(["aa", "bb", "cc"])
    for name in network.p:
        network.p[name] = network.p[name] + rng.normal(0, 0.2, network.p[name].shape).astype(np.float32)
    grid, owner, length = langid.windows([b"short", b"x" * 300, "été à Paris".encode() * 30, b""])
    hidden = []
    for row in grid:
        embedded = network.p["embed"][row]
        for w in langid.WIDTHS:
            spans = [embedded[k : k + w].ravel() for k in range(langid.WINDOW - w + 1)]
            hidden.append(np.maximum(np.max([s @ network.p[f"w{w}"] for s in spans], 0) + network.p[f"b{w}"], 0))
    hidden = np.concatenate(hidden).reshape(len(grid), -1)
    logits = hidden @ network.p["out"] + network.p["bias"]
    want = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.abs(network.tables().probabilities(grid) - want).max() < 1e-4
    labels, scores = network.tables().predict([b"x" * 300, b"12 34", b""])
    mass = (want[owner == 1] * length[owner == 1][:, None]).sum(0)
    assert labels == [network.labels[mass.argmax()], langid.UNKNOWN, langid.UNKNOWN] and scores[1:] == [0.0, 0.0]
    assert abs(scores[0] - mass.max() / mass.sum()) < 1e-4


def test_license_scan_against_every_window_of_every_template(spark):
    """Without any filter, bound or order of templates: all windows are aligned, the best one splits its range, and overlaps are settled by hand."""
    templates = {"A": "alpha beta gamma delta epsilon zeta eta theta iota kappa", "B": "alpha beta gamma delta lambda mu nu xi omicron pi", "C-notice": "beta gamma delta", "D": "one two one two one three"}
    telling = {"A": ("epsilon zeta",), "B": ("lambda mu",), "C-notice": ("gamma",), "D": ("three",)}
    rng = np.random.default_rng(12)
    words = sorted({w for t in templates.values() for w in t.split()} | {"noise", "other"})
    texts = []
    for _ in range(60):
        pieces = []
        for _ in range(int(rng.integers(1, 6))):
            w = templates[str(rng.choice(list(templates)))].split() if rng.random() < 0.7 else [str(x) for x in rng.choice(words, 8)]
            for at in rng.choice(len(w), int(rng.integers(0, 3))):
                w[at] = str(rng.choice(words))
            pieces += w[: int(rng.integers(3, len(w) + 1))] if rng.random() < 0.3 else w
        texts.append(" ".join(pieces))

    def copies(text, name):
        want, size = templates[name].split(), len(templates[name].split())
        size += max(2, size // 5)
        phrases, out, ranges = [p.split() for p in telling[name]], [], [(0, len(text))]
        while ranges:
            low, high = ranges.pop(0)
            tried = []
            for i in range(max(1, high - low - size + 1) if high > low else 0):
                window = text[low:high][i : i + size]
                both = sum((Counter(window) & Counter(want)).values())
                pairs = licenses.align([w.encode() for w in window], [w.encode() for w in want])
                place = {j: a for a, j in pairs}
                whole = all(any(want[k : k + len(p)] == p for k in range(len(want))) for p in phrases)
                for p in phrases:
                    k = next(k for k in range(len(want)) if want[k : k + len(p)] == p)
                    whole &= all(place.get(k + x) is not None and place[k + x] == place.get(k, -1) + x for x in range(len(p)))
                if len(pairs) >= 0.8 * len(want) and whole:
                    tried.append((-both, i, pairs))
            if tried:
                _, i, pairs = min(tried)
                out.append((low + i + pairs[0][0], low + i + pairs[-1][0] + 1, len(pairs), name, len(want)))
                ranges += [(low, out[-1][0]), (out[-1][1], high)]
        return out

    want = set()
    for n, text in enumerate(texts):
        left = sorted((c for name in templates for c in copies(text.split(), name)), key=lambda c: (c[4] - 2 * c[2], c[1] - c[0], c[0], c[3]))
        kept = []
        for c in left:
            if all(c[1] <= k[0] or k[1] <= c[0] or (c[3][0] == k[3][0] and ("notice" in c[3]) != ("notice" in k[3])) for k in kept):
                kept.append(c)
        want |= {(n, c[3], c[2], c[0], c[1]) for c in kept}
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates, 0.8, telling).collect()
    got = {(r.doc_id, r.license, r.n_matched, r.start_word, r.end_word) for r in found}
    assert len(got) == len(found) > 40 and got == want

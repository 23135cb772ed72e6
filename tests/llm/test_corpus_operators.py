"""Operators that look at many texts together: copies, near copies, repeats, shards, mixtures."""

import zlib
from collections import Counter

import numpy as np
import pytest

from shopweave.llm import budget, exact_dedup, minhash, repeats, sharding
from shopweave.llm.common import Shared
from shopweave.llm.components import components
from tests.llm import brute
from tests.llm.conftest import frame


def test_exact_groups(docs, rows, empty):
    got = exact_dedup.exact_groups(docs, counters=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(brute.exact([(i, t) for i, t, _, _ in rows]))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("counters", [1, 1024])
def test_drop_copies(docs, rows, empty, counters):
    kept = exact_dedup.drop_copies(docs, counters)
    assert kept.columns == docs.columns
    want = {(k, s) for _, k, _, s in brute.exact([(i, t) for i, t, _, _ in rows])}
    got = [(r.doc_id, brute.exact([(0, r.text)])[0][3]) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert exact_dedup.drop_copies(empty, counters).count() == 0


def test_misra_gries_keeps_the_frequent(spark):
    values = ["hot"] * 300 + ["warm"] * 120 + [f"v{k}" for k in range(500)]
    np.random.default_rng(3).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "digest string").repartition(3)
    found = {r.digest: r.estimate for r in exact_dedup.misra_gries(df, "digest", 8).collect()}
    assert {"hot", "warm"} <= set(found) and len(found) <= 8
    assert 300 - 920 / 9 <= found["hot"] <= 300


@pytest.mark.parametrize("width,percent,block", [(3, 85, 1 << 20), (5, 80, 1 << 20), (3, 85, 400)])
def test_near_duplicates(spark, distinct, width, percent, block):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(60)]
    near = []
    for k in range(40):  # a group whose members differ from a base and from one another
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            w[at] = f"x{rng.integers(1000)}"
        near.append((3000 + k, " ".join(w), "en", "src1"))
    rows = [r for r in distinct if len(r[1] or "") < 20_000] + near
    got = minhash.near_duplicates(frame(spark, rows), width, percent, block).collect()
    want = brute.near([(i, t) for i, t, _, _ in rows], width, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for i, _, c in want if i >= 3000}) > 1  # some stay apart


def test_near_duplicates_with_null_and_repeated_ids(docs, rows, empty):
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(rows)
    base = [r for r in got if r.n_shingles == 118]
    assert {r.component_id for r in base} == {6} and [r.doc_id for r in base if r.kept] == [6]
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id in (1, 2, 3, 4)} == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True)}
    assert sum(r.doc_id is None and r.component_id is None and r.kept for r in got) == 2
    kept = minhash.drop_near_copies(docs, 3, 85)
    assert kept.columns == docs.columns
    assert {6, 13, 14} <= {r.doc_id for r in kept.collect()} and not {7, 8, 9} & {r.doc_id for r in kept.collect()}
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("ids", [(None, None, None), (5, 5, 8), (5, 5, None)])
def test_one_row_of_a_near_group_is_kept(spark, ids):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join([*base, *f"end number {k}".split()]) for k in range(3)]
    docs = frame(spark, [(i, t, "en", "src1") for i, t in zip(ids, texts)] + [(None, "quite another text that stands alone", "en", "src1"), (None, None, None, None)])
    got = minhash.near_duplicates(docs, 3, 80).collect()
    group = [r for r in got if r.n_shingles > 50]
    assert {r.component_id for r in group} == {ids[0]} and [r.doc_id for r in group if r.kept] == [i for i in ids if i == ids[0]]
    kept = [r.text for r in minhash.drop_near_copies(docs, 3, 80).collect()]
    assert len(kept) == 3 and sum(t in texts for t in kept) == 1


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 900, np.uint64))
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, np.uint64)])
    same = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(same - 0.8) < 0.05
    assert (minhash.signature(a, 50) == minhash.signature(a[::-1].copy(), 50)).all()
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65521)
    assert len(np.unique(minhash.mix32(x.copy(), 0x21F0AAAD, 0xD35A2D97))) == len(np.unique(x))


def test_bands_follow_the_threshold():
    for percent in (80, 85, 95):
        n = minhash.bands_for(percent)
        assert (1 - (percent / 100) ** minhash.ROWS) ** n <= minhash.MISS < (1 - (percent / 100) ** minhash.ROWS) ** (n - 1)


def test_components(spark):
    rng = np.random.default_rng(4)
    ids = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)]
    edges = list(zip(ids[:100], ids[1:100])) + [(ids[150], x) for x in ids[151:220]] + [(ids[220], ids[221]), (ids[221], ids[220]), (ids[230], ids[230])]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), Shared(spark, "t"), "c").collect())
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(len, groups.values())) == [2, 70, 100]
    assert components(spark.createDataFrame([], "u long, v long"), Shared(spark, "t"), "c").count() == 0


@pytest.mark.parametrize("window,phrase,shard,hot", [(35, 12, 2000, 5000), (7, 3, 4, 5000), (7, 3, 4, 1), (5, 1, 3, 2)])
def test_repeats(docs, rows, window, phrase, shard, hot):
    got = repeats.remove_repeats(docs, window, phrase, shard, hot).collect()
    want = Counter((i, *x) for (i, *_), x in zip(rows, brute.repeats([t for _, t, _, _ in rows], window)))
    assert Counter(tuple(r) for r in got) == want
    assert any(0 < r.n_removed < r.n_words for r in got)


def test_repeats_of_periodic_text(spark, empty):
    texts = ["a b c " * 20, "a b c d " * 3 + "a b c", "z " * 9, "q r s t u v w", "q r s t u v w x", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in repeats.remove_repeats(df, 6, 2).collect())
    assert got == [(i, *x) for i, x in enumerate(brute.repeats(texts, 6))]
    assert repeats.remove_repeats(empty).count() == 0


def test_anchors_depend_on_windows_alone():
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 6, 300).astype(np.uint64)
    for window, phrase in ((35, 12), (6, 2), (9, 1)):
        g = repeats.grams(hashes, phrase)
        h, at, first, last = repeats.anchors(hashes, window, phrase)
        assert first[0] == 0 and last[-1] == len(hashes) - window and (first[1:] == last[:-1] + 1).all()
        for k in range(len(h)):
            for i in range(first[k], last[k] + 1):
                span = g[i : i + window - phrase + 1]
                assert i + int(span.argmin()) == at[k] and span.min() == h[k]


@pytest.mark.parametrize("shards,bucket", [(24, 1 << 20), (3, 2000)])
def test_shards(spark, docs, rows, empty, shards, bucket):
    stored = Shared(spark, "t").table(docs, "docs")
    written = sharding.shuffled_shards(stored, shards, bucket_bytes=bucket)
    got = written.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _, _ in rows)
    places = {s: sorted(r.slot for r in got if r.shard == s) for s in range(shards)}
    assert all(p == list(range(len(p))) for p in places.values())
    assert max(map(len, places.values())) - min(map(len, places.values())) <= 1
    again = sharding.shuffled_shards(stored, shards, bucket_bytes=bucket).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ids != [i for i, *_ in rows]
    for r in sharding.shard_digest(written).collect():
        assert r.law == "rows" and r.grown_shard is None
    digest = Counter((r.doc_id, r["size"], r.text_crc32) for r in sharding.shard_digest(written).collect())
    assert digest == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert sharding.shuffled_shards(Shared(spark, "t").table(empty, "docs")).count() == 0


@pytest.mark.parametrize("share,epochs", [(0.6, 2), (0.3, 1), (1.7, 2), (3.0, 2)])
def test_mixture(docs, rows, share, epochs):
    weights = {"domain": {"=group3": 0.5}, "lang": {"=en": 2.0, "~": 0.25}, "source": {"=src1": 3.0}}
    got = Counter((r.doc_id, r.epoch) for r in budget.mix_rows(docs, budget=share, max_epochs=epochs, weights=weights).collect())
    assert got == brute.mix(rows, share, epochs, weights, budget.SEED)


def test_mixture_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(budget, "RANGE_ROWS", 8)
    rows = [(k, "w " * (1 + k % 7), "en", "src1") for k in range(500)] + [(7, "same id", "en", "src1")] * 5
    got = Counter((r.doc_id, r.epoch) for r in budget.mix_rows(frame(spark, rows), budget=0.45, max_epochs=1, weights={}).collect())
    assert got == brute.mix(rows, 0.45, 1, {}, budget.SEED)


def test_mixture_documents(docs, empty):
    out = budget.mix_documents(docs, budget=0.5, max_epochs=1)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert budget.mix_documents(empty).count() == 0


def test_shortfalls_of_leaves(spark):
    rows = [(k, "w " * (500 if k == 0 else 3 + k % 5), "en", f"src{k % 3}") for k in range(60)]
    docs = frame(spark, rows)
    got = {r.source: r for r in budget.shortfalls(docs, budget=0.5, max_epochs=1).collect()}
    chosen = Counter()
    for r in budget.mix_documents(docs, budget=0.5, max_epochs=1).collect():
        chosen["=" + r.source] += len(r.text.split())
    assert len(got) == 3 and all(r.taken == chosen[s] and abs(r.shortfall - (r.share - r.taken)) < 1e-9 for s, r in got.items())
    assert all(-1e-6 <= r.shortfall < (500 if s == "=src0" else 8) for s, r in got.items())
    assert budget.shortfalls(docs.limit(0)).count() == 0

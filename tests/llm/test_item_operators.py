"""Ranked search and decontamination against brute force, with nulls, ties, repeats and items of every length."""

import random
from collections import Counter

import numpy as np
import pytest

from shopweave.llm import bag_search, decontaminate, terms
from shopweave.llm.fm_index import FMIndex, suffix_order
from tests.llm import brute


def item_frame(spark, rows):
    extra = (7, 7, "x", 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], "item_id long, text string, term long, n long, bag string, spans long")


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(2)
    long = next(t for i, t, _, _ in rows if i == 10).split()
    out = [(1, " ".join(long[45:70])), (2, " ".join(long[50:58])), (3, " ".join(long[3:14]).upper()), (3, " ".join(long[5:14])), (3, " ".join(long[3:14]).upper())]
    out += [(4, None), (5, ""), (6, "!?.,"), (None, " ".join(long[20:33])), (7, "lonely"), (8, "w w"), (-9, "É é a-b_c"), (12, "nowhere to be found at all")]
    return out + [(100 + k, " ".join(rng.sample(long, rng.randint(1, 20)))) for k in range(12)]


@pytest.mark.parametrize("k,block", [(10, terms.BLOCK_BYTES), (3, 400), (1, terms.BLOCK_BYTES)])
def test_search(spark, docs, rows, items, k, block):
    got = bag_search.search(docs, item_frame(spark, items), k, block).collect()
    assert Counter(map(tuple, got)) == Counter(brute.search([(i, t) for i, t, _, _ in rows], items, k))


def test_search_of_nothing(spark, docs, empty, items):
    assert bag_search.search(empty, item_frame(spark, items)).count() == 0
    got = bag_search.search(docs, item_frame(spark, []))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_copies_are_one_class_and_expand_by_id(spark):
    rows = [(i, "alpha beta beta") for i in range(500, 0, -1)] + [(1000 + i, f"alpha gamma{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = bag_search.bags(docs, {b"alpha": 0, b"beta": 1})
    classes = bag_search.classes(found, 550, 1600, 10).collect()
    assert sorted(len(c.members) for c in classes) == [10, 10] and list(range(1, 11)) in [c.members for c in classes]
    got = bag_search.search(docs, item_frame(spark, [(1, "beta")])).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 11)) and len({r.score for r in got}) == 1


def test_item_blocks_hold_all_rows_of_an_item(spark):
    rows = [(i, "x" * n) for i in range(30) for n in (10, 20)] + [(99, "y" * 5000), (None, "z")]
    blocks = [b.to_pylist() for b in terms.item_blocks(item_frame(spark, rows), 500)]
    assert Counter((r["item_id"], r["text"]) for b in blocks for r in b) == Counter(rows)
    where = Counter(i for b in blocks for i in {r["item_id"] for r in b})
    assert set(where.values()) == {1} and len(blocks) > 5


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    text = ("Ab1 é-x " * 500 + "y" * 900 + " end").encode()
    whole = [t for part in terms.term_lists(text) for t in part]
    monkeypatch.setattr(terms, "STRETCH", 64)
    assert [t for part in terms.term_lists(text) for t in part] == whole and whole[:3] == [b"ab1", "é".encode(), b"x"]


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        v = int(rng.integers(2, 9))
        text = np.concatenate([[0], np.tile(rng.integers(0, v, int(rng.integers(1, 60))), int(rng.integers(1, 5))), [0]]).astype(np.int32)
        order = suffix_order(text)
        number = np.where(text == 0, np.cumsum(text == 0) - 1000, text).tolist()
        assert order.tolist() == sorted(range(len(text)), key=lambda i: number[i:])
        phrases = [rng.integers(1, v, int(rng.integers(1, 6))).tolist() for _ in range(15)]
        length = np.array([len(p) for p in phrases])
        found = set()
        for p, at in FMIndex(text, v).occurrences(np.array(sum(phrases, []), np.int32), np.cumsum(length) - length, length):
            pairs = list(zip(p.tolist(), at.tolist()))
            assert not found & set(pairs)
            found |= set(pairs)
        assert found == {(j, i) for j, p in enumerate(phrases) for i in range(len(text)) if text[i : i + len(p)].tolist() == p}


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 300, "shard_bytes": 2000, "shard_symbols": 40}])
def test_decontaminate(spark, docs, rows, items, limits):
    got = decontaminate.hits(decontaminate.removal_spans(docs, item_frame(spark, items), **limits)).collect()
    want = brute.leaks([(i, t) for i, t, _, _ in rows], items, 10)
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r.contaminated for r in got) > 3


def test_spans_are_merged_and_cut(spark):
    item = " ".join(f"w{k}" for k in range(25))
    text = f"Start, here. {item.replace('w3 ', 'W3; ')} middle {item} {item}! The END"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean text")], "doc_id long, text string")
    found = decontaminate.removal_spans(docs, item_frame(spark, [(5, item)]), keep_text=True)
    rows = {r.doc_id: r for r in decontaminate.cut(found).collect()}
    assert [(s.start, s.end) for s in rows[1].spans] == [(2, 27), (28, 78)] and rows[1].item_ids == [5]
    assert rows[1].clean_text == "Start, here.  middle ! The END"
    assert rows[2].clean_text is None and rows[3].clean_text == "clean text" and rows[3].spans == []


def test_nothing_to_hold_against(spark, docs, rows, empty, items):
    got = decontaminate.hits(decontaminate.removal_spans(docs, item_frame(spark, []))).collect()
    assert len(got) == len(rows) and not any(r.contaminated for r in got)
    assert decontaminate.hits(decontaminate.removal_spans(empty, item_frame(spark, items))).count() == 0

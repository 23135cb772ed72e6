"""The conversation trie against brute force, over one shard, many shards and spilling queues."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopweave.llm import prefix_trie as T
from shopweave.llm.common import Shared
from tests.llm import brute

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_frame(spark, rows):
    extra = (7, 7, "x", 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], "conv_id long, turn long, role string, text string, depth long, part long, key string, conv long")


def cases():
    rng = random.Random(4)
    texts = [f"word{k} " * rng.randint(0, 5) for k in range(4)] + ["", "a  b\tc", "x" * 5000]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(70) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "hot turn") for c in range(100, 160) for t in range(3)] + [(c, 3, "user", f"own {c % 7}") for c in range(100, 160)]
    rows += [(7, None, "user", "first of all"), (7, None, None, None), (8, 0, None, "x"), (8, 0, None, "x"), (8, 0, "user", None), (None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(-5, 0, "user", "below"), (-25, 1, "user", "zero"), (3021, 0, "user", "short"), (3033, 0, "a", "b")]  # donors absent
    rows += [(500, t, "user", f"long {t % 3}") for t in range(400)] + [(501, t, "user", f"long {t % 3}") for t in range(300)]
    rng.shuffle(rows)
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("shards,queue_rows", [(None, T.QUEUE_ROWS), (1, 4), (23, 4)])
def test_prefix_trie(spark, shards, queue_rows):
    rows = cases()
    got = T.prefix_trie(turn_frame(spark, rows).repartition(5), shards, queue_rows)
    assert ordered(got.select(*COLUMNS).collect()) == ordered(brute.trie(rows))


def test_nothing(spark):
    assert T.prefix_trie(turn_frame(spark, [])).count() == 0
    assert T.prefix_trie(turn_frame(spark, [(None, 0, "user", "x")])).count() == 0


def test_positions_and_keys_do_not_depend_on_the_tasks(spark):
    """A conversation that holds most rows is spread over tasks, and its nodes are the same."""
    rows = [(20, t, "user", f"turn {t}") for t in range(900)] + [(c, 0, "user", "x") for c in range(41, 99)]
    keys = []
    for shards in (1, 16):
        shared = Shared(spark, "test-trie")
        table = shared.table(T.running(T.by_range(T.rebuilt(turn_frame(spark, rows), shared), shards, "conv", "pos")), "running")
        sizes = [r["count"] for r in table.groupBy("part").count().collect()]
        assert max(sizes) <= 2.5 * sum(sizes) / shards
        found = T.path_rows(table, T.offsets(table))
        keys.append(sorted(map(tuple, found.select("conv", "depth", "k1", "k2", "pdepth", "p1", "p2", "ends").fillna(-1).collect())))
        assert found.filter("conv = 20").agg(F.count_distinct("k1", "k2")).first()[0] == 901
    assert keys[0] == keys[1]


def test_targets_form_trees_of_their_own(spark):
    """Many shards, few nodes each: the tree of targets is dealt to shards again."""
    rows = [(c, t, "user", f"{c % (2 + t)}") for c in range(1000, 1200) for t in range(4)]
    small = T.SHARD_NODES
    T.SHARD_NODES = 12
    try:
        got = ordered(T.prefix_trie(turn_frame(spark, rows), 40, 16).select(*COLUMNS).collect())
    finally:
        T.SHARD_NODES = small
    assert got == ordered(brute.trie(rows))


def test_queue_adds_up_and_spills():
    rng = np.random.default_rng(2)
    queue, plain = T.Queue(2, 50), {}
    last = 0
    for _ in range(40):
        at = rng.integers(last, last + 40, 30)
        key = T.order_key(np.zeros(30, np.int64), np.full(30, 5), np.zeros(30, np.int64), at)
        queue.push(key, np.stack([at, np.ones(30, np.int64)], 1))
        for x in at.tolist():
            s, n = plain.get(x, (0, 0))
            plain[x] = s + x, n + 1
        last += 5
        through = T.order_key(np.zeros(1, np.int64), np.full(1, 5), np.zeros(1, np.int64), np.array([last - 1]))[0]
        got, value = queue.pop(through)
        mine = sorted(x for x in plain if x < last)
        assert got.view(">u8").reshape(-1, 4)[:, 3].tolist() == mine and [tuple(v) for v in value.tolist()] == [plain.pop(x) for x in mine]
    assert queue.runs
    assert len(queue.pop(None)[0]) == len(plain) and not queue.runs

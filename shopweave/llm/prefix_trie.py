"""The trie of rebuilt conversations, with subtree totals by time-forward processing.

Turns of a conversation are ordered by turn (null first), then by the digest of role and text. The rebuilt
conversation c has the first h turns of conversation c - c % 20 and then c's own turns after its
first h; h = crc32(c) % 4. A node is a distinct sequence of first turns, the root the empty one.

1. Turns become digests and word counts. They are sorted by ranges over (conversation, order), so one conversation may
   lie in many tasks; positions count on over tasks from a small table of the ranges' ends (``offsets``).
2. Rebuilt turns are sorted in the same way. The key of a sequence is a pair of 64-bit polynomials in its
   turns' digests, which goes on from task to task too: no task needs a whole conversation.
3. Nodes are the groups of one depth and key, combined on the map side.
4. Nodes are dealt to shards by ranges over the first cells of their path, so that a subtree mostly lies together. In a shard, nodes
   are sorted externally by reverse level order. Each takes the messages of its children from a
   priority queue that spills (``Queue``), adds its own, and sends the sum to its parent.
5. Messages to nodes of other shards remain at the end. Their targets, each with its nearest target above, are a smaller tree with
   the same task: it is solved in the same way, by one task if it is small, else by shards again.
6. A second run within the shards adds what came from outside.
7. Conversations that end at a node are sorted by ranges over (node, conversation), joined to long strings, and these
   go to the node's digest in order.

Nulls: a null turn comes first, null role or text is empty, rows without a conv_id belong to no
conversation. Empty texts are turns with no words. Very long texts are digested whole. Ties of
turn go by digest of role and text; repeated rows are turns each. A conversation that rebuilding leaves without turns
is a member of the root alone. An empty table has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopweave.llm.common import Shared

#: Conversations of one stretch of this many ids share the first turns of the stretch's first id.
STRETCH = 20
#: Nodes of a shard.
SHARD_NODES = 1 << 20
#: Messages that a queue holds in memory before it writes a sorted run.
QUEUE_ROWS = 1 << 18
#: Multipliers of the two polynomials, odd.
LANES = np.array([0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Cells of a path by which shards are dealt, in pairs of 32 bits.
CELLS = 8

NODE = ["depth", "k1", "k2"]
SIGNATURE = [f"s{i}" for i in range(CELLS // 2)]


def ranges(spark, rows: int) -> int:
    """Tasks for a sort of so many rows by ranges."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / SHARD_NODES))


def by_range(frame: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows in order over all tasks, with the number of their task as ``part``."""
    return frame.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def batched(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, object]]:
    """Each batch with rows, and the first value of ``column`` in the next one."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held, batch[column][0].as_py()
            held = batch
    if held is not None:
        yield held, None


def running(frame: DataFrame) -> DataFrame:
    """Rows (part, conv, key, words), in order, with what is known within their task.

    ``local`` counts a conversation's rows from 0, (a1, a2) and (b1, b2) are the polynomials up to the row without and with it, ``last`` says
    whether the task has no later row of the conversation, s0, s1, … are cells of the path so far.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, count, sums, cells = None, 0, np.zeros(2, np.uint64), np.zeros(CELLS + 1, np.uint32)
        for batch, following in batched(batches, "conv"):
            ids, n = batch["conv"].to_numpy(), batch.num_rows
            first = np.append(ids[0] != conv, ids[1:] != ids[:-1])
            head = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            goes_on = head < 0  # rows of the conversation that the batch before ended with
            local = np.arange(n) - np.where(goes_on, -count, head)
            digest = np.frombuffer(b"".join(batch["key"].to_pylist()), "<u8").reshape(n, 2)
            sum_after, sum_before = np.empty((n, 2), np.uint64), np.empty((n, 2), np.uint64)
            for k in range(2):
                term = digest[:, k] * LANES[k] ** local.astype(np.uint64)
                total = np.cumsum(term, dtype=np.uint64)
                base = np.where(goes_on, np.uint64(0) - sums[k], (total - term)[np.maximum(head, 0)])
                sum_after[:, k], sum_before[:, k] = total - base, total - base - term
            cell = (sum_after[:, 0] * LANES[1] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            path = np.zeros((n, CELLS), np.uint32)
            for k in range(CELLS):  # the cell at depth k + 1
                here = local >= k + 1
                at = np.where(goes_on, k + 1 - count, head + k + 1)
                path[here, k] = np.where(at[here] < 0, cells[k + 1], cell[np.maximum(at[here], 0)])
            packed = (path[:, 0::2].astype(np.uint64) << np.uint64(32) | path[:, 1::2]) >> np.uint64(1)
            conv, count, sums = ids[-1], int(local[-1]) + 1, sum_after[-1]
            cells = np.append(np.uint32(0), path[-1])
            yield pa.RecordBatch.from_pydict({
                "part": batch["part"], "conv": batch["conv"], "local": local, "key": batch["key"], "words": batch["words"], "last": np.append(ids[1:] != ids[:-1], following != ids[-1]),
                "a1": sum_before[:, 0].view(np.int64), "a2": sum_before[:, 1].view(np.int64), "b1": sum_after[:, 0].view(np.int64), "b2": sum_after[:, 1].view(np.int64),
                **{s: packed[:, k].astype(np.int64) for k, s in enumerate(SIGNATURE)},
            })

    return frame.select("part", "conv", "key", "words").mapInArrow(step, "part int, conv long, local long, key binary, words long, last boolean, a1 long, a2 long, b1 long, b2 long, " + ", ".join(f"{s} long" for s in SIGNATURE))


def offsets(table: DataFrame) -> dict[tuple[int, int], tuple[int, int, int, bool]]:
    """For conversations in several tasks: (part, conv) to (rows before, both polynomials before, rows after?).

    Only the first and the last conversation of a task can be in another one: two entries a task at most.
    """
    ends = table.groupBy("part").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi")).select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("conv"))
    split = ends.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    rows = table.filter("last").join(split, "conv", "left_semi").select("conv", "part", "local", "b1", "b2").collect()
    found, before = {}, {}
    rows.sort()
    for k, (conv, part, local, b1, b2) in enumerate(rows):
        n, x, y = before.get(conv, (0, 0, 0))
        found[part, conv] = n, x, y, k + 1 < len(rows) and rows[k + 1][0] == conv
        before[conv] = n + local + 1, *((s + pow(int(lane), n, 1 << 64) * b) % (1 << 64) for s, lane, b in zip((x, y), LANES, (b1, b2)))
    return found


def path_rows(table: DataFrame, at: dict) -> DataFrame:
    """(conv, depth, k1, k2, pdepth, p1, p2, words, ends, s0, …): a row per node on the path of each conversation."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, part = batch["conv"].to_numpy(), batch["part"].to_numpy()
            depth, ends = batch["local"].to_numpy().copy(), batch["last"].to_numpy(zero_copy_only=False).copy()
            keys = {c: batch[c].to_numpy().view(np.uint64).copy() for c in ("a1", "a2", "b1", "b2")}
            signature = {s: batch[s].to_numpy().copy() for s in SIGNATURE}
            head = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])))
            for i, j in zip(head, np.append(head[1:], len(conv))):
                if (held := at.get((int(part[i]), int(conv[i])))) is not None:
                    n, x, y, more = held
                    depth[i:j] += n
                    for c, lane, s in (("a1", 0, x), ("a2", 1, y), ("b1", 0, x), ("b2", 1, y)):
                        keys[c][i:j] = keys[c][i:j] * np.uint64(pow(int(LANES[lane]), n, 1 << 64)) + np.uint64(s)
                    if more:
                        ends[i:j] = False
                    if n:
                        for s in SIGNATURE:
                            signature[s][i:j] = -1  # cells of the tasks before are not known here
            none = depth == 0
            yield pa.RecordBatch.from_pydict({
                "conv": batch["conv"], "depth": depth, "k1": keys["b1"].view(np.int64), "k2": keys["b2"].view(np.int64), "pdepth": pa.array(depth - 1, mask=none),
                "p1": pa.array(keys["a1"].view(np.int64), mask=none), "p2": pa.array(keys["a2"].view(np.int64), mask=none), "words": batch["words"], "ends": ends, **signature,
            })

    return table.mapInArrow(step, "conv long, depth long, k1 long, k2 long, pdepth long, p1 long, p2 long, words long, ends boolean, " + ", ".join(f"{s} long" for s in SIGNATURE))


def rebuilt(turns: DataFrame, shared: Shared) -> DataFrame:
    """(conv, pos, key, words) of the rebuilt conversations in order of pos, each with a row at -1 for the root."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").alias("t"), F.unhex(F.substring(digest, 1, 32)).alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).filter("conv is not null")
    rows = shared.table(rows, "turns")
    table = shared.table(running(by_range(rows, ranges(rows.sparkSession, rows.count()), "conv", "t", "key")).select("part", "conv", "local", "key", "words", "last", "b1", "b2"), "positions")
    at = [(part, conv, n) for (part, conv), (n, *_) in offsets(table).items()]
    before = rows.sparkSession.createDataFrame(at, "part int, conv long, n long")  # two rows a task at most
    own = table.join(F.broadcast(before), ["part", "conv"], "left").select("conv", (F.col("local") + F.coalesce("n", F.lit(0))).alias("pos"), "key", "words")
    h = F.crc32(F.col("conv").cast("string")) % 4
    all_convs = own.filter("pos = 0").select("conv")
    heads = own.filter("pos < 3").select(F.col("conv").alias("donor"), "pos", "key", "words")
    copied = all_convs.select("conv", (F.col("conv") - F.col("conv") % STRETCH).alias("donor"), h.alias("h")).join(heads, "donor").filter("pos < h")
    root = all_convs.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(bytes(16)).alias("key"), F.lit(0).cast("long").alias("words"))
    return root.unionByName(copied.select("conv", "pos", "key", "words")).unionByName(own.filter(F.col("pos") >= h))


class Queue:
    """Messages by ascending target, those of one target added up; beyond ``most`` rows they go to sorted runs in scratch files.

    The files are this task's alone, have no name, and end with the task; a repeated task makes its own.
    """

    BLOCK = 1 << 14

    def __init__(self, width: int, most: int):
        self.width, self.most, self.fresh, self.held, self.runs = width, most, [], 0, []
        self.record = np.dtype([("key", "S32"), ("value", "<i8", (width,))])

    def push(self, key: np.ndarray, value: np.ndarray) -> None:
        self.fresh.append((key, value))
        self.held += len(key)
        if self.held > self.most:
            key, value = self.sorted(self.fresh)
            if len(key) > self.most // 2:
                file = tempfile.TemporaryFile()
                rows = np.empty(len(key), self.record)
                rows["key"], rows["value"] = key, value
                rows.tofile(file)
                file.seek(0)
                self.runs.append([file, np.empty(0, self.record)])
                key, value = key[:0], value[:0]
            self.fresh, self.held = [(key, value)], len(key)

    def sorted(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        parts = [p for p in parts if len(p[0])]
        if not parts:
            return np.empty(0, "S32"), np.empty((0, self.width), np.int64)
        key, value = (np.concatenate(x) for x in zip(*parts))
        if len(key) > 1:
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.append(True, key[1:] != key[:-1])
            key, value = key[first], np.add.reduceat(value, np.flatnonzero(first))
        return key, value

    def pop(self, through: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All messages with a target up to ``through`` (None: all), in order."""
        taken, kept = [], []
        for run in self.runs:
            while True:
                if not len(run[1]):
                    run[1] = np.fromfile(run[0], self.record, self.BLOCK)
                n = len(run[1]) if through is None else int(np.searchsorted(run[1]["key"], through, "right"))
                if n:
                    taken.append((run[1]["key"][:n], run[1]["value"][:n]))
                run[1] = run[1][n:]
                if len(run[1]) or not n:
                    break
            if len(run[1]):
                kept.append(run)
            else:
                run[0].close()
        self.runs = kept
        key, value = self.sorted(self.fresh)
        n = len(key) if through is None else int(np.searchsorted(key, through, "right"))
        self.fresh, self.held = [(key[n:], value[n:])], len(key) - n
        return self.sorted([(key[:n], value[:n]), *taken]) if taken else (key[:n], value[:n])


def order_key(shard: np.ndarray, depth: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Bytes that sort by shard, falling depth and key."""
    out = np.empty((len(depth), 4), ">u8")
    out[:, 0], out[:, 1] = shard, (1 << 62) - depth
    out[:, 2], out[:, 3] = k1.view(np.uint64), k2.view(np.uint64)
    return out.view("S32")[:, 0]


TREE = ["depth", "k1", "k2", "pdepth", "p1", "p2", "conv_id", "n_convs", "leaves", "saved"]


def time_forward(tree: DataFrame, shards: int, carries: bool, queue_rows: int) -> DataFrame:
    """One run over the nodes of all shards, each in reverse level order.

    ``tree`` has TREE, the shard, and for targets of messages from other shards their totals (g_leaves, g_saved, g_children; null
    elsewhere). ``carries``: returns the messages that leave their shard, else the nodes with their totals.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = Queue(5, queue_rows)

        def sent(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            at = np.ascontiguousarray(key).view(">u8").reshape(-1, 4).astype(np.uint64).T.copy().view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ((1 << 62) - at[1], at[2], at[3], *value[:, :3].T.copy())], [*NODE, "g_leaves", "g_saved", "g_children"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch[c].fill_null(0).to_numpy(zero_copy_only=False)
            shard, depth = column("shard").astype(np.int64), column("depth")
            key = order_key(shard, depth, column("k1"), column("k2"))
            parent = order_key(shard, column("pdepth"), column("p1"), column("p2"))
            has_parent, target = batch["pdepth"].is_valid().to_numpy(zero_copy_only=False), batch["g_leaves"].is_valid().to_numpy(zero_copy_only=False)
            own = np.stack([column("leaves"), column("saved"), np.zeros(len(key), np.int64), column("g_leaves"), column("g_saved")], 1)
            head = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (shard[1:] != shard[:-1])))
            for i, j in zip(head, np.append(head[1:], len(key))):
                at, value = queue.pop(key[j - 1])
                place = np.searchsorted(key[i:j], at)
                met = key[i:j][np.minimum(place, j - i - 1)] == at
                value_here = value[met]
                value_here[target[i:j][place[met]], 3:] = 0  # what comes from outside is known for a target
                own[i + place[met]] += value_here
                if carries and not met.all():
                    yield sent(at[~met], value[~met])
                up = np.flatnonzero(has_parent[i:j]) + i
                message = own[up].copy()
                message[:, 2] = 1
                queue.push(parent[up], message)
            if not carries:
                yield pa.RecordBatch.from_pydict({c: batch[c] for c in TREE[:8]} | {
                    "n_leaves": own[:, 0] + own[:, 3], "saved_tokens": own[:, 1] + own[:, 4], "n_children": own[:, 2] + column("g_children"),
                })
        at, value = queue.pop(None)
        if carries and len(at):
            yield sent(at, value)

    rows = tree.repartition(shards, "shard").sortWithinPartitions("shard", F.col("depth").desc(), *[unsigned(k) for k in ("k1", "k2")])
    rows = rows.select("shard", *TREE, "g_leaves", "g_saved", "g_children")
    if carries:
        return rows.mapInArrow(step, "depth long, k1 long, k2 long, g_leaves long, g_saved long, g_children long").groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("g_leaves", "g_saved", "g_children")])
    return rows.mapInArrow(step, ", ".join(f"{c} long" for c in TREE[:8]) + ", n_leaves long, saved_tokens long, n_children long")


def unsigned(name: str):
    """Order of 64 bits without a sign: the sign bit turned over."""
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)))


def subtree_totals(tree: DataFrame, paths: DataFrame, shared: Shared, level: int, shards: int | None, queue_rows: int) -> DataFrame:
    """TREE's first columns with n_leaves and saved_tokens summed over each subtree, and n_children.

    ``paths`` has (conv, depth, k1, k2) for all nodes on the path of each conv_id of the tree.
    """
    spark = tree.sparkSession
    none = [F.lit(None).cast("long").alias(c) for c in ("g_leaves", "g_saved", "g_children")]
    if shards is None:
        shards = ranges(spark, tree.count())
    if shards == 1:
        return time_forward(tree.withColumn("shard", F.lit(0)).select("*", *none), 1, False, queue_rows)
    dealt = tree.repartitionByRange(shards, *SIGNATURE, "conv_id", "depth").withColumn("shard", F.spark_partition_id())
    dealt = shared.table(dealt, f"shards-{level}")
    targets = shared.table(time_forward(dealt.select("*", *none), shards, True, queue_rows), f"targets-{level}")
    if not targets.isEmpty():
        ids = targets.join(dealt.select(*NODE, "conv_id", *SIGNATURE), NODE)
        found = shared.table(ids, f"target-nodes-{level}")
        over = Window.partitionBy("conv").orderBy("depth")
        above = paths.join(found.select(F.col("conv_id").alias("conv")).distinct(), "conv", "left_semi").select("conv", *NODE).join(targets.select(*NODE), NODE, "left_semi")
        above = above.select(F.col("conv").alias("conv_id"), *NODE, *[F.lag(c).over(over).alias(p) for c, p in zip(NODE, ("pdepth", "p1", "p2"))])
        small = found.join(above, ["conv_id", *NODE]).select(*NODE, "pdepth", "p1", "p2", "conv_id", F.lit(0).cast("long").alias("n_convs"), F.col("g_leaves").alias("leaves"), F.col("g_saved").alias("saved"), *SIGNATURE)
        small = shared.table(small, f"target-tree-{level}")
        n = small.count()
        fewer = 1 if n <= SHARD_NODES else math.ceil(n / SHARD_NODES)
        above_targets = subtree_totals(small, paths, shared, level + 1, fewer, queue_rows).select(*NODE, F.col("n_leaves").alias("g_leaves"), F.col("saved_tokens").alias("g_saved"))
        full = shared.table(above_targets.join(targets.select(*NODE, "g_children"), NODE), f"target-totals-{level}")
        dealt = dealt.join(full, NODE, "left")
    else:
        dealt = dealt.select("*", *none)
    return time_forward(dealt, shards, False, queue_rows)


def end_digests(rows: DataFrame, n: int) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which a conversation ends."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = [batch[c].to_numpy() for c in NODE]
                first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], 0)))
                ids = batch["conv"].cast(pa.string()).to_pylist()
                text = [",".join(ids[i:j]) for i, j in zip(first, np.append(first[1:], batch.num_rows))]
                yield pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in cols], batch["conv"].take(pa.array(first)), pa.array(text, pa.string())], [*NODE, "conv", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch[c].to_pylist() for c in (*NODE, "ids")]):
                if key == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [*NODE, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], [*NODE, "ends_sha256"])

    parts = by_range(rows.filter("ends").select(*NODE, "conv"), n, *NODE, "conv").select(*NODE, "conv").mapInArrow(strings, "depth long, k1 long, k2 long, conv long, ids string")
    return parts.repartition(n, *NODE).sortWithinPartitions(*NODE, "conv").select(*NODE, "ids").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shards: int | None = None, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its key."""
    spark, shared = turns.sparkSession, Shared(turns.sparkSession, "prefix-trie")
    rows = shared.table(rebuilt(turns.select("conv_id", "turn", "role", "text"), shared), "rebuilt")
    n = ranges(spark, rows.count()) if shards is None else shards
    table = shared.table(running(by_range(rows, n, "conv", "pos")), "running")
    paths = path_rows(table, offsets(table))
    nodes = paths.groupBy(*NODE).agg(
        *[F.min(p).alias(p) for p in ("pdepth", "p1", "p2")], F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
        F.max("words").alias("words"), F.sum(F.col("ends").cast("long")).alias("n_ends"), *[F.max(s).alias(s) for s in SIGNATURE],
    )
    tree = nodes.select(*TREE[:8], (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), *SIGNATURE)
    tree = shared.table(tree, "tree")
    totals = shared.table(subtree_totals(tree, paths.select("conv", *NODE), shared, 0, shards, queue_rows), "totals")
    parents = totals.select(F.col("depth").alias("pdepth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = shared.table(end_digests(paths, n), "ends")
    out = totals.join(parents, ["pdepth", "p1", "p2"], "left").join(ends, NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("k1", "k2")]).alias("node_key"),
    )


ORACLE_SQL = r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
o as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, sha256(strlen(role)::varchar || ':' || role || text)) as w from t group by conv_id),
h as (select conv_id, w, list_reduce(list_prepend(4294967295, flatten([[ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(conv_id::varchar, '')])),
             lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end) as x from o),
g as (select conv_id, w, xor(x, 4294967295) % 4 as h from h),
r as (select g.conv_id, coalesce(d.w, [])[1 : h] || g.w[h + 1 :] as w from g left join o d on d.conv_id = g.conv_id - g.conv_id % 20),
p as (select conv_id, w[1 : d] as k, d, d = len(w) as ends from (select conv_id, w, unnest(range(len(w) + 1)) as d from r)),
n as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * coalesce(len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')), 0) as saved, count(*) = sum(ends::int) as leaf,
             sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from p group by k, d),
u as (select a.k, a.d, sum(b.saved)::bigint as saved_tokens, sum(b.leaf::int)::bigint as n_leaves, sum((b.d = a.d + 1)::int)::bigint as n_children
      from n a join (select k, saved, leaf, d, unnest(range(d + 1)) as up from n) b on b.up = a.d and b.k[1 : up] = a.k group by a.k, a.d)
select n.conv_id, n.d as depth, m.conv_id as parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
from n join u using (k, d) left join n m on m.d = n.d - 1 and m.k = n.k[1 : n.d - 1]
"""

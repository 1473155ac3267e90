"""Totals over the trie of conversation prefixes, by time-forward processing.

Every distinct sequence of first turns is a node. A node's name is a chain of 128-bit digests, computed
while the turns of a conversation stream by in order, so equal prefixes of any two conversations get one
name and no text is shuffled but for sorting turns.

Subtree totals travel from children to parents as messages in time: a shard's nodes are
sorted from the deepest level up, and a priority queue that spills to sorted runs delivers each message when its
parent comes by. Shards are cut by the number of conversations through a node. Tier 0 holds nodes with at
most ``fanout`` conversations, tier 1 those with at most ``fanout`` squared, and so on; a shard is a
whole subtree within its tier, so it has at most ``fanout`` nodes a level whatever is popular. One tier after
the other runs in parallel over its shards, and the totals of its shard roots, summed per parent
map-side, start the next tier. A first turn that a third of all conversations share is thus one node of
a high tier, and its children are spread over many shards of lower ones.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.sources.storage import materialise

FANOUT = 512
QUEUE = 65_536  # messages held in memory before the queue spills
TEXT_BYTES = 1_000_000  # of joined conversation ids in one row
ROOT = b"\x00" * 16


def turn_table(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, said: digest of role and text, chars of the text), turns NULL first, then by role and text.

    Rows without a conversation id belong to no conversation and are left out. Turns are streamed in
    order and numbered; a conversation of any length is sorted by Spark, with spilling.
    """
    role, text = C.text_of(role), C.text_of(text)
    rows = conversations.select(C.name(conv).alias("conv"), C.name(turn).alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # The length of the role keeps role and text apart.
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.filter(F.col("conv").isNotNull()).select(
        "conv", F.row_number().over(order).cast("bigint").alias("pos"),
        F.unhex(F.substring(F.sha2(both, 256), 1, 32)).alias("said"), F.length("text").cast("bigint").alias("chars"))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv, part, pos, said, chars): the turns of conversations that begin like another one, in order of (part, pos).

    Conversation c takes its first h turns from conversation c - c % ``every`` and the others
    from its own turns after the first h, where h is the CRC-32 of the decimal id modulo ``most``. A row with part -1
    stands for the conversation itself, so one without turns is there too.
    """
    turns = materialise(turns, "turns")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = turns.filter(F.col("pos") > head).withColumn("part", F.lit(1))
    convs = turns.filter("pos = 1").select("conv", head.alias("head"), (F.col("conv") - F.col("conv") % every).alias("base"))
    # At most ``most`` - 1 turns of a base, for at most 2 * ``every`` conversations.
    first = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "base")
    taken = convs.join(first, "base").filter(F.col("pos") <= F.col("head")).withColumn("part", F.lit(0))
    marks = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("pos"),
                         F.lit(ROOT).alias("said"), F.lit(0).cast("bigint").alias("chars"))
    names = marks.columns
    return marks.select(names).unionByName(own.select(names)).unionByName(taken.select(names))


def _paths(batches: Iterator) -> Iterator:
    """Names the nodes on each conversation's path: key, its parent's, depth; ``is_end`` at the last turn."""
    import pyarrow as pa

    now = None
    conv, depth, key = None, 0, ROOT
    for batch in batches:
        out: list[tuple] = []
        for c, part, said, chars in zip(*(batch.column(x).to_pylist() for x in ("conv", "part", "said", "chars"))):
            if part == -1:
                if now:
                    out.append((*now, True))
                conv, depth, key, parent = c, 0, ROOT, None
            else:
                if now:
                    out.append((*now, False))
                depth, parent = depth + 1, key
                key = hashlib.blake2b(parent + said, digest_size=16).digest()
            now = (conv, depth, key, parent, chars)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _types(batch))], names=_NAMES)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, True), _types(batch))], names=_NAMES)


_NAMES = ["conv", "depth", "key", "parent", "chars", "is_end"]


def _types(batch) -> list:
    import pyarrow as pa

    return [batch.schema.field("conv").type, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]


def paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, chars, is_end), one row per conversation and node on its path, the root included."""
    kind = turns.schema["conv"].dataType.simpleString()
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "part", "pos").select("conv", "part", "said", "chars")
    return ordered.mapInArrow(_paths, f"conv {kind}, depth bigint, key binary, parent binary, chars bigint, is_end boolean")


class SpillingQueue:
    """A priority queue of picklable tuples that keeps ``limit`` in memory and sorted runs of the rest.

    Runs go to an unnamed file of the task, as Spark's own sorts do; it is gone when the task ends, and a
    repeated task starts its own.
    """

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.file = limit, [], [], None

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            keep = self.limit // 2  # the first to be needed stay in memory
            run = [heapq.heappop(self.heap) for _ in range(len(self.heap))]
            self.heap, spilled = run[:keep], run[keep:]
            at = self.file.seek(0, 2)
            for m in spilled:
                pickle.dump(m, self.file)
            self.runs.append((spilled[0], at, len(spilled)))
            heapq.heapify(self.runs)

    def head(self) -> tuple | None:
        """The first message, left in place."""
        tops = [x for x in (self.heap[0] if self.heap else None, self.runs[0][0] if self.runs else None) if x is not None]
        return min(tops, default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, at, left = self.runs[0]
            self.file.seek(at)
            pickle.load(self.file)
            after = self.file.tell()
            if left > 1:
                heapq.heapreplace(self.runs, (pickle.load(self.file), after, left - 1))
            else:
                heapq.heappop(self.runs)
            return message
        return heapq.heappop(self.heap)


def forward(nodes: Iterator[tuple], limit: int = QUEUE) -> Iterator[tuple]:
    """(key, children, leaves, saved) of nodes (shard, depth, key, parent, own, children, leaves, saved).

    Nodes come by shard, deepest first, then by key, with what lower tiers have sent them; ``own`` is what the node itself
    saves. Totals go on to the parent unless the node is its shard's root.
    """
    queue, shard_now = SpillingQueue(limit), None
    for shard, depth, key, parent, own, children, leaves, saved in nodes:
        if shard != shard_now:
            assert queue.head() is None  # every message has met its parent within its shard
            shard_now = shard
        while (head := queue.head()) is not None and head[:2] == (-depth, key):
            _, _, more_leaves, more_saved = queue.pop()
            children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
        saved += own
        if children == 0:
            leaves = 1
        if key != shard:
            queue.push((1 - depth, parent, leaves, saved))
        yield key, children, leaves, saved


def _forward_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["shard", "depth", "key", "parent", "own", "children", "leaves", "saved"]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(x).to_pylist() for x in names))

    held: list[tuple] = []

    def made():
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=["key", "children", "leaves", "saved"])

    for row in forward(rows()):
        held.append(row)
        if len(held) == 10_000:
            yield made()
            held.clear()
    if held:
        yield made()


def shards(nodes: DataFrame, on_path: DataFrame, tiers: int) -> DataFrame:
    """(key, shard) of all nodes: the name of the topmost node above it, or itself, of the same tier.

    Counts fall along a path, so the topmost node of a tier on the path of a conversation lies as deep as
    the path has nodes of higher tiers.
    """
    if tiers == 1:
        return nodes.select("key", F.lit(ROOT).alias("shard"))
    high = nodes.filter("tier > 0").select("key", "tier")
    above = on_path.join(high, "key").groupBy("conv").agg(*[F.count_if(F.col("tier") > t).alias(f"above_{t}") for t in range(tiers)])
    tops = above.select("conv", F.posexplode(F.array(*[f"above_{t}" for t in range(tiers)])).alias("tier", "depth"))
    roots = tops.join(on_path.select("conv", "depth", F.col("key").alias("shard")), ["conv", "depth"])
    return nodes.select("key", "tier", "conv").join(roots, ["conv", "tier"]).select("key", "shard")


def ends(on_path: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the ids of the conversations that end at a node, ascending, comma-joined.

    A digest is sequential, the text it reads is not: range partitions join their ids first, and only these long strings
    meet per node, as a stream.
    """
    import pyarrow as pa

    def join(batches: Iterator) -> Iterator:
        key, first, size, texts, part = None, None, 0, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], kind), pa.array([",".join(texts)])], names=["key", "first", "ids"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
                if texts and (k != key or size > TEXT_BYTES):
                    yield row()
                    texts, size = [], 0
                if not texts:
                    key, first = k, c
                texts.append(str(c))
                size += len(texts[-1]) + 1
        if texts:
            yield row()

    def digest(batches: Iterator) -> Iterator:
        key, h, done = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    h.update(b"," + ids.encode())
                    continue
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
                done = []
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

    kind = on_path.schema["conv"].dataType.simpleString()
    last = on_path.filter("is_end").select("key", "conv")
    joined = last.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(join, f"key binary, first {kind}, ids string")
    met = joined.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return met.mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(conv, depth, parent_conv, n_convs, n_children, n_leaves, saved, ends_sha256), one row per node.

    ``turns`` has rows (conv, part, pos, said, chars) with a row of part -1 per conversation, as ``rebuilt`` gives them.
    ``conv`` is the node's smallest member. Equal conversations are members of the same nodes; a conversation of no turns
    is a member of the root alone; without conversations there is no node. Very long conversations are chains
    that stream through one task as rows of some 60 bytes.
    """
    on_path = materialise(paths(turns), "trie-paths")
    n_convs = on_path.filter("depth = 0").count()
    tiers = 1
    while fanout ** tiers < n_convs:
        tiers += 1
    # Rows of a node are summed map-side first, so a node on every path is one row a task.
    # What a name stands for is part of the group's key: minima of binary columns would be sorted for.
    counted = on_path.groupBy("key", "depth", "parent", "chars").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"))
    tier: Column = reduce(lambda a, t: a + (F.col("n_convs") > fanout ** t).cast("int"), range(1, tiers), F.lit(0))
    nodes = materialise(counted.withColumn("tier", tier), "trie-nodes")
    placed = materialise(nodes.join(shards(nodes, on_path, tiers), "key"), "trie-shards") if tiers > 1 else nodes.withColumn("shard", F.lit(ROOT))

    none = F.lit(0).cast("bigint")
    own = ((F.col("n_convs") - 1) * F.col("chars")).alias("own")
    done, sent = [], None
    for t in range(tiers):
        here = placed.filter(F.col("tier") == t).select("key", "shard", "depth", "parent", own)
        if sent is None:
            here = here.select("*", none.alias("children"), none.alias("leaves"), none.alias("saved"))
        else:
            here = here.join(sent, "key", "left").fillna(0, ["children", "leaves", "saved"])
        ordered = here.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "key")
        totals = materialise(ordered.mapInArrow(_forward_batches, "key binary, children bigint, leaves bigint, saved bigint"), "trie-totals")
        done.append(totals)
        if t + 1 < tiers:
            # Shard roots speak to nodes of any higher tier: what a later tier needs is kept until then.
            roots = placed.filter((F.col("tier") == t) & (F.col("key") == F.col("shard"))).select("key", F.col("parent").alias("to"))
            up = totals.join(roots, "key").groupBy(F.col("to").alias("key")).agg(
                F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            sent = up if sent is None else sent.unionByName(up).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
            sent = materialise(sent, "trie-sent")
    totals = reduce(DataFrame.unionByName, done)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = nodes.join(totals, "key").join(ends(on_path), "key", "left")
    return whole.join(parents, "parent", "left").select(
        "conv", "depth", "parent_conv", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        "saved", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

"""Operator 13, the prefix trie of conversations, from one global sort.

A conversation becomes one row: the 16-byte digests of its turns, one after the other, and each turn's number of words. No
text is shuffled. The rows are range-sorted over all partitions by these digests and the id, so those that begin with the same
turns lie together, and every trie node is an interval of rows in which neighbours share at least the node's depth of turns.

Each partition sweeps over its rows with a stack of open nodes: a neighbour that shares less closes the deeper ones. What a
node needs adds up over its rows, given how much each row shares with the one before and the one after:

* children: rows that begin one, as they share no more than the node's depth with the row before;
* leaves: rows that share less than their own length with the row after;
* saved tokens: of every row but the node's first, the words of the turns from the node's own on that it shares with the row before.

So nodes that are open across a border between partitions are stitched by adding up their parts. The two rows at a border
tell how many turns they share; these numbers (one a partition) say in which partition an open node began, which with its
depth names it. Only such nodes are aggregated over partitions, and only their ids travel as runs of text, hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

WORD = r"[^\x20\x09-\x0D]+"
_DIGEST = 16
_ROWS = 1 << 13
#: Bytes of sorted rows that a partition gets, about.
_PARTITION_BYTES = 8 << 20


def turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): a row a conversation, its turns in order as structs of digest and number of words.

    A null turn number comes first; equal ones are ordered by role, then by the text's SHA-256. A null role or text is empty.
    Rows without an id take no part.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, _DIGEST)
    rows = df.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), F.sha2(text.cast("binary"), 256).alias("of_text"),
        digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("turn", "role", "of_text", "digest", "words")))
    return rows.groupBy("conv").agg(F.transform(in_order, lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words"))).alias("turns"))


def spliced(conversations: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Every conversation with its first ``taken`` turns replaced by those of conversation ``base`` (fewer, if that has fewer).

    At most ``most`` turns are taken. A base that does not exist gives none.
    """
    heads = conversations.select(F.col("conv").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    rows = conversations.withColumn("_base", base).withColumn("_taken", taken).join(heads, "_base", "left")
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("_taken") > 0, F.slice(F.coalesce("_head", none), 1, F.greatest("_taken", F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("_taken") + 1, F.greatest(F.size("turns") - F.col("_taken"), F.lit(0)))
    return rows.select("conv", F.concat(head, rest).alias("turns"))


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two conversations share from the beginning."""
    n = min(len(a), len(b)) // _DIGEST
    if a[: n * _DIGEST] == b[: n * _DIGEST]:
        return n
    x, y = (np.frombuffer(s, "u8", 2 * n) for s in (a, b))
    return int(np.argmax(x != y)) // 2


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last key of a partition that has rows."""
    first = last = pid = None
    for batch in batches:
        if batch.num_rows:
            pid, keys = batch.column("pid")[0].as_py(), batch.column("key")
            first, last = keys[0].as_py() if first is None else first, keys[len(keys) - 1].as_py()
    if pid is not None:
        yield pa.record_batch([pa.array([pid], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], ["pid", "first", "last"])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, first, last = (batch.column(c).to_pylist() for c in ("before", "first", "last"))
        shared = [-1 if a is None else _shared(a, b) for a, b in zip(before, first, strict=True)]
        across = [_shared(a, b) for a, b in zip(first, last, strict=True)]
        yield pa.record_batch([batch.column("pid"), pa.array(shared, pa.int32()), pa.array(across, pa.int32())], ["pid", "shared", "across"])


class _Node:
    __slots__ = ("began", "children", "count", "depth", "ends", "leaves", "least", "saved", "waiting", "words")

    def __init__(self, depth: int, words: int, conv: int, began: int) -> None:
        self.depth, self.words, self.least, self.began = depth, words, conv, began
        self.count = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.waiting: list[tuple] = []  # closed children, until this node's conv_id is known


class _Sweep:
    """The stack of open nodes of one partition; ``out`` gets rows of _OUT.

    ``borders``: (pid, shared, across) of all partitions with rows, in order: how many turns the first row shares with the
    row before it (-1: there is none), and with the partition's last row.
    """

    def __init__(self, pid: int, borders: list[tuple[int, int, int]]) -> None:
        pids = [b[0] for b in borders]
        at = pids.index(pid)
        self.pid, self.before = pid, borders[at][1]
        self.after = borders[at + 1][1] if at + 1 < len(pids) else -1
        through = -np.minimum.accumulate(np.array([min(b[1:]) for b in borders[:at]][::-1], np.int64))
        # an open node began in the last partition before whose rows do not all share its depth with each other and the row before
        self.began = lambda depth: pids[at - 1 - int(np.searchsorted(through, -depth, "right"))]
        self.stack: list[_Node] = []
        self.out: list[tuple] = []
        self.key: bytes | None = None

    def row(self, conv: int, key: bytes, words: list[int]) -> None:
        """The next row; ``words[d]``: the words of its first d turns."""
        length = len(key) // _DIGEST
        if self.key is None:
            shared = self.before
            self.stack = [_Node(d, words[d], conv, self.began(d)) for d in range(shared + 1)]
        else:
            shared = _shared(self.key, key)
            self._last_was_leaf(shared)
            self._close(shared)
        self.stack += [_Node(d, words[d], conv, self.pid) for d in range(shared + 1, length + 1)]
        for node in self.stack[max(shared, 0) : -1]:
            node.children += 1
        if shared >= 0:  # down to that depth, this row is not its nodes' first
            self.stack[shared].saved += words[shared]
        top = self.stack[-1]
        top.count += 1
        top.least = min(top.least, conv)
        top.ends.append(conv)
        self.key = key

    def end(self) -> None:
        if self.key is not None:
            self._last_was_leaf(self.after)
            self._close(-1, self.after)

    def _last_was_leaf(self, shared: int) -> None:
        self.stack[-1].leaves += shared < self.stack[-1].depth

    def _close(self, depth: int, after: int = -1) -> None:
        """Close the nodes below ``depth``; those down to ``after`` go on in the next partition."""
        while self.stack and self.stack[-1].depth > depth:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            begins_here, crosses = node.began == self.pid, node.began != self.pid or node.depth <= after
            saved = node.saved - (node.count - begins_here) * (above.words if above else 0)
            ids = ",".join(map(str, node.ends))
            for child in node.waiting:
                parent = (None, node.began) if crosses else (node.least, None)
                self.out.append((0, *child[:2], parent[0], *child[2:], None, parent[1], self.pid, None))
            own = (node.least, node.depth, node.count, node.children, node.leaves, saved)
            if crosses:
                self.out.append((1, *own[:2], None, *own[2:], None, node.began, above.began if above else None, self.pid, ids if node.ends else None))
            elif above:
                above.waiting.append((*own, hashlib.sha256(ids.encode()).hexdigest()))
            else:
                self.out.append((0, *own[:2], None, *own[2:], hashlib.sha256(ids.encode()).hexdigest(), None, None, self.pid, None))
            if above:
                above.count += node.count
                above.leaves += node.leaves
                above.saved += node.saved
                above.least = min(above.least, node.least)


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OUT = f"part int, {_NODE}, began int, parent_began int, pid int, ends string"
_FIELDS = [f.split() for f in _OUT.split(", ")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], [name for name, _ in _FIELDS])


def _swept(borders: list[tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            if batch.num_rows and sweep is None:
                sweep = _Sweep(batch.column("pid")[0].as_py(), borders)
            for conv, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv", "key", "words")), strict=True):
                sweep.row(conv, key, [0, *accumulate(words)])
                if len(sweep.out) >= _ROWS:
                    yield _batch(sweep.out)
                    sweep.out.clear()
        if sweep:
            sweep.end()
            for at in range(0, len(sweep.out), _ROWS):
                yield _batch(sweep.out[at : at + _ROWS])
        common.release()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node over its runs of ids, which come in order."""
    at, digest, done = None, None, []
    for batch in batches:
        for began, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("began", "depth", "ends")), strict=True):
            if (began, depth) != at:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (began, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if at is not None:
        done.append((*at, digest.hexdigest()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)], ["began", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the prefix trie of (conv, turns), with distinct ids, as ``turns`` and ``spliced`` give them.

    conv_id: the smallest conversation that begins with the node's turns (a member); depth: their number, 0 for the root;
    parent_conv_id: null for the root; n_convs: members; n_children; n_leaves: childless nodes in the node's subtree, itself
    included; saved_tokens: (members - 1) times the words of a node's last turn, summed over the subtree; ends_sha256: over
    the decimal ids, ascending and comma-joined, of the members that have just these turns. A conversation without turns
    belongs to the root alone. Equal conversations share all nodes. An empty table gives no node, not even a root.

    A conversation is one row (24 bytes a turn); equal ones are split over partitions by their ids. A partition's open and
    waiting nodes are held by its task.
    """
    rows = common.checkpointed(
        conversations.select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), "")).alias("key"), F.col("turns.words").alias("words"))
    )
    size = rows.agg(F.coalesce(F.sum(F.lit(32) + F.size("words") * 24), F.lit(0))).first()[0]
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // _PARTITION_BYTES))
    ordered = rows.repartitionByRange(partitions, "key", "conv").sortWithinPartitions("key", "conv").withColumn("pid", F.spark_partition_id())
    ordered = common.checkpointed(ordered)
    edges = ordered.mapInArrow(_edges, "pid int, first binary, last binary").withColumn("before", F.lag("last").over(Window.orderBy("pid")))  # a row a partition
    borders = sorted(tuple(r) for r in edges.mapInArrow(_borders, "pid int, shared int, across int").collect())  # three numbers a partition
    swept = common.checkpointed(ordered.mapInArrow(_swept(borders), _OUT))

    parts = swept.filter("part = 1")
    runs = parts.filter("ends IS NOT NULL").select("began", "depth", "pid", "ends").repartition("began", "depth").sortWithinPartitions("began", "depth", "pid")
    ends = runs.mapInArrow(_hashed, "began int, depth long, ends_sha256 string")
    stitched = parts.groupBy("began", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _SUMS], F.min("parent_began").alias("parent_began"))
    stitched = stitched.join(ends, ["began", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    stitched = common.checkpointed(stitched)

    place = lambda began, depth: F.shiftleft(F.col(began).cast("long"), 32) + depth
    own = ["conv_id", "depth", *_SUMS, "ends_sha256"]
    below = swept.filter("part = 0 AND parent_began IS NOT NULL").select(*own, "parent_began").union(stitched.filter("depth > 0").select(*own, "parent_began"))
    parents = stitched.select(place("began", F.col("depth")).alias("_parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    total = stitched.agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    below = common.join_counted(below.withColumn("_parent", place("parent_began", F.col("depth") - 1)), parents, "_parent", "conv_id", total)
    order = [f.split()[0] for f in _NODE.split(", ")]
    root = stitched.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return swept.filter("part = 0 AND parent_began IS NULL").select(order).union(below.select(order)).union(root.select(order))

"""Conversation prefix trie: which openings conversations share, how often, and what storing each opening once would save.

Turns become 64-bit ids of (role, text). Conversations are dealt to shards by range of their id sequences, so that a shared opening lies in one shard or in
neighbouring ones. Within a shard they are rows of a padded matrix of turn ids, sorted by numpy's lexsort; where a column changes from one row to the next, or an earlier
column has, a node starts, so the OR-accumulated change masks mark all node starts of all depths, and reduceat aggregates each depth. The matrix is
made a block of columns at a time, from rows that are long enough, so one long conversation among short ones costs little.

A node can lie in several shards only if it is on the path of a shard's first or last conversation (beyond `key_depth` turns: below it). Such boundary nodes are
few; their counts are summed by key, each is given a home shard that counts its own leaf and savings, and a second pass over the shards adds up subtrees. So no task
sees more than its shard, however many conversations are alike; only a digest of the ends of a boundary node is, as SHA-256 has to be, one
stream of sorted pieces, of which a batch is held at a time.

Turns are ordered by number (null first), equal numbers by turn id; null role or text is empty. Rows of null conv_id belong to no conversation and are left out. Repeated rows
are turns of their own. The head that a conversation takes over comes from the original turns of conv_id - conv_id % 100 (% as in SQL, which keeps the sign), none
if there is no such conversation. A conversation may be turnless; then it ends in the root. An empty table has no root and gives no rows. Only conv_id, turn, role, text are read.
One conversation is one row of 12 bytes a turn.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import MULTIPLIER, mixed, saved

#: Turns of a shard, about; ids in the key of the range; turns of which at most an opening is taken over; ids in a piece of a digest's stream; cells of a matrix.
SHARD_TURNS, KEY_DEPTH, HEAD, PIECE, CELLS = 500_000, 16, 5, 4096, 4_000_000
NOBODY = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, every: int = 100, head: int = HEAD) -> DataFrame:
    """conv_id, ids (of its rebuilt turns), sizes (their code points); turns: conv_id, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.xxhash64(role, text).alias("id"), F.length(text).alias("size"))
    mine = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    own = saved(mine.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")), "turns")
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, head).alias("ids0"), F.slice("sizes", 1, head).alias("sizes0"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (head + 1)).cast("int")

    def both(name: str):
        first = F.slice(F.coalesce(f"{name}0", F.array().cast(own.schema[name].dataType)), F.lit(1), taken)
        return F.concat(first, F.slice(name, taken + 1, F.size(name))).alias(name)

    return own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left").select("conv_id", both("ids"), both("sizes"))


class Trie:
    """Nodes of the conversations of one shard, by depth and then by path; the root is node 0."""

    def __init__(self, rows: pa.Table, key_depth: int = KEY_DEPTH, cells: int = CELLS):
        self.key_depth, self.cells = key_depth, cells
        rows = rows.sort_by("conv_id")
        self.conv = rows["conv_id"].to_numpy()
        lists = rows["ids"].combine_chunks()
        self.flat = lists.flatten().to_numpy()
        sizes = rows["sizes"].combine_chunks().flatten().to_numpy()
        self.length = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        most = len(self.flat) + 1
        self.parent, self.depth, self.n, self.least, self.size = (np.zeros(most, dtype=np.int64) for _ in range(5))
        self.last, self.path = np.zeros(most, dtype=np.int64), np.zeros(most, dtype=np.uint64)
        self.low, self.high = np.zeros(most, dtype=bool), np.zeros(most, dtype=bool)
        self.n[0], self.least[0], self.low[0], self.high[0] = len(self.conv), self.conv.min(), True, True
        self.end = np.zeros(len(self.conv), dtype=np.int64)
        self.levels = [0, 1]
        self._grow(sizes, *self._ends_of_range())
        self.count = self.levels[-1]
        for name in ("parent", "depth", "n", "least", "size", "last", "path", "low", "high"):
            setattr(self, name, getattr(self, name)[: self.count])
        self.inner = np.zeros(self.count, dtype=bool)
        self.inner[self.parent[1:]] = True
        self.edge = self.low | self.high

    def _matrix(self, values: np.ndarray, rows: np.ndarray, first: int, width: int, pad: int) -> np.ndarray:
        column = first + np.arange(width)
        inside = column < self.length[rows][:, None]
        at = np.minimum(self.start[rows][:, None] + column, max(0, len(values) - 1))
        return np.where(inside, values[at] if len(values) else pad, pad)

    def _ends_of_range(self) -> tuple[np.ndarray, np.ndarray]:
        """The first ids of the first and of the last conversation in the order of the range."""
        everyone = np.arange(len(self.conv))
        width = int(min(self.key_depth, self.length.max()))
        keys = self._matrix(self.flat, everyone, 0, width, np.iinfo(np.int64).min)
        order = np.lexsort((np.minimum(self.length, width), *keys.T[::-1]))
        cut = lambda row: self.flat[self.start[row] : self.start[row] + min(width, self.length[row])]
        return cut(order[0]), cut(order[-1])

    def _grow(self, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        dense = (np.unique(self.flat, return_inverse=True)[1] + 1).astype(np.int32)
        group = np.zeros(len(self.conv), dtype=np.int64)
        active, at = np.flatnonzero(self.length > 0), 0
        while len(active):
            width = int(min(max(8, self.cells // len(active)), self.length[active].max() - at))
            matrix = self._matrix(dense, active, at, width, 0)
            order = np.lexsort((*matrix.T[::-1], group[active]))
            rows, matrix = active[order], matrix[order]
            change = np.ones((len(rows), width + 1), dtype=bool)
            change[1:, 0] = group[rows[1:]] != group[rows[:-1]]
            change[1:, 1:] = matrix[1:] != matrix[:-1]
            change = np.logical_or.accumulate(change, axis=1)[:, 1:]
            for j in range(width):
                self._level(rows, matrix[:, j] > 0, np.flatnonzero(change[:, j]), at + j, sizes, low, high)
            group[rows] = np.cumsum(change[:, -1])
            at += width
            active = active[self.length[active] > at]

    def _level(self, rows: np.ndarray, real: np.ndarray, starts: np.ndarray, before: int, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Nodes of one depth (before + 1): each start opens a segment of rows, a node where they have a turn there."""
        node = real[starts]
        old = self.levels[-1]
        new = slice(old, old + int(node.sum()))
        numbers = np.where(node, old + np.cumsum(node) - 1, 0)
        first = rows[starts[node]]
        turn = self.start[first] + before
        up = self.parent[new] = self.end[first]
        self.depth[new], self.size[new], self.last[new] = before + 1, sizes[turn], self.flat[turn]
        self.n[new] = np.add.reduceat(np.ones(len(rows), dtype=np.int64), starts)[node]
        self.least[new] = np.minimum.reduceat(self.conv[rows], starts)[node]
        self.path[new] = mixed(self.path[up] * MULTIPLIER + self.flat[turn].view(np.uint64) + np.uint64(before + 1))
        for side, ids in ((self.low, low), (self.high, high)):
            side[new] = side[up] & (self.flat[turn] == ids[before] if before < len(ids) else before >= self.key_depth)
        self.end[rows[real]] = np.repeat(numbers, np.diff(np.append(starts, len(rows))))[real]
        self.levels.append(new.stop)

    def subtree(self, own: np.ndarray) -> np.ndarray:
        """Sum of own over each node's subtree, itself included."""
        out = own.copy()
        for d in range(len(self.levels) - 2, 0, -1):
            up = self.parent[self.levels[d] : self.levels[d + 1]]
            starts = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
            out[up[starts]] += np.add.reduceat(out[self.levels[d] : self.levels[d + 1]], starts)
        return out

    def ends(self) -> list[tuple[int, list[str]]]:
        """Node and the ascending conv_ids, as decimals, of those that end in it."""
        order = np.argsort(self.end, kind="stable")
        at = self.end[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ids = list(map(str, self.conv[order].tolist()))
        return [(int(at[a]), ids[a:b]) for a, b in zip(starts, np.append(starts[1:], len(at)))]


KEY = ["depth", "path", "last"]
_EDGES = "shard int, node long, depth long, path long, last long, n long, least long, inner boolean"
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, path long, last long, pieces array<string>"


def _edges(trie: Trie, shard: int) -> pa.Table:
    """The boundary nodes of a shard."""
    at = np.flatnonzero(trie.edge)
    return pa.table({"shard": np.full(len(at), shard, dtype=np.int32), "node": at, "depth": trie.depth[at], "path": trie.path[at].view(np.int64), "last": trie.last[at], "n": trie.n[at], "least": trie.least[at], "inner": trie.inner[at]})


def _nodes(trie: Trie, shard: int, edges: pa.Table, piece: int) -> pa.Table:
    """All nodes of a shard; boundary nodes with their key, this shard's part of their sums and the pieces of their ends."""
    at = edges["node"].to_numpy()
    home, n, least, inner = np.ones(trie.count, dtype=bool), trie.n, trie.least, trie.inner
    home[at], n[at], least[at], inner[at] = edges["home"].to_numpy() == shard, edges["n"].to_numpy(), edges["least"].to_numpy(), edges["inner"].to_numpy(zero_copy_only=False)
    children = np.bincount(trie.parent[1:], weights=home[1:], minlength=trie.count).astype(np.int64)
    leaves = trie.subtree((~inner & home).astype(np.int64))
    tokens = trie.subtree(np.where(home, (n - 1) * trie.size, 0))
    digests: list[str | None] = [NOBODY] * trie.count
    pieces: list[list[str] | None] = [None] * trie.count
    for node in at.tolist():
        digests[node], pieces[node] = None, []
    for node, ids in trie.ends():
        if trie.edge[node]:
            pieces[node] = [",".join(ids[k : k + piece]) for k in range(0, len(ids), piece)]
        else:
            digests[node] = hashlib.sha256(",".join(ids).encode()).hexdigest()
    keyed = lambda x: pa.array(x, pa.int64(), mask=~trie.edge)
    parent = pa.array(least[trie.parent], mask=trie.depth == 0)
    return pa.table({
        "conv_id": least, "depth": trie.depth, "parent_conv_id": parent, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": tokens, "ends_sha256": pa.array(digests, pa.string()),
        "shard": pa.array(np.full(trie.count, shard, dtype=np.int32)), "path": keyed(trie.path.view(np.int64)), "last": keyed(trie.last), "pieces": pa.array(pieces, pa.list_(pa.string())),
    })


def _digests(batches):
    """SHA-256 of the pieces of each node, which come sorted and side by side."""
    now, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "digest"])

    for batch in batches:
        for *key, piece in zip(*(batch[c].to_pylist() for c in (*KEY, "piece"))):
            if key != now:
                if now:
                    yield done()
                now, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if now:
        yield done()


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, key_depth: int = KEY_DEPTH, piece: int = PIECE, cells: int = CELLS) -> DataFrame:
    """One row for each node: conv_id (least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows = saved(rebuilt(conversations), "rebuilt")
    turns = rows.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / shard_turns))
    dealt = rows.repartitionByRange(shards, F.slice("ids", 1, key_depth), F.xxhash64("ids"), "conv_id")
    dealt = saved(dealt.withColumn("shard", F.spark_partition_id()), "shards")

    def edges_of(rows: pa.Table) -> pa.Table:
        return _edges(Trie(rows, key_depth, cells), rows["shard"][0].as_py())

    def nodes_of(rows: pa.Table, edges: pa.Table) -> pa.Table:
        return _nodes(Trie(rows, key_depth, cells), rows["shard"][0].as_py(), edges, piece)

    edges = saved(dealt.groupBy("shard").applyInArrow(edges_of, _EDGES), "edges")
    whole = edges.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("inner").alias("inner"), F.min("shard").alias("home"))
    known = edges.select("shard", "node", *KEY).join(whole, KEY).select("shard", "node", "n", "least", "inner", "home")
    nodes = saved(dealt.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(nodes_of, _NODES), "nodes")
    within = nodes.filter("path IS NULL").drop("shard", "path", "last", "pieces")
    parts = nodes.filter("path IS NOT NULL")
    pieces = parts.select(*KEY, "shard", F.posexplode("pieces").alias("no", "piece")).repartition(*KEY).sortWithinPartitions(*KEY, "shard", "no").select(*KEY, "piece")
    digests = pieces.mapInArrow(_digests, "depth long, path long, last long, digest string")
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    joined = parts.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("conv_id", "parent_conv_id", "n_convs")], *sums).join(digests, KEY, "left")
    return within.unionByName(joined.select(*[c for c in within.columns if c != "ends_sha256"], F.coalesce("digest", F.lit(NOBODY)).alias("ends_sha256")))

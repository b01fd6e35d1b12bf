"""Conversation prefix trie: padded matrices of turn ids, one for each range shard of the sorted conversations.

Conversations with the same turns are one class before anything else, so copies cost one row. A class is a row of 128-bit
turn ids, cut into panels of ``PANEL`` turns; a panel row carries the digest of the turns before it, so panels of all
depths go through the same pass and no conversation, however long, is one value. Rows are range-partitioned by (panel,
digest, ids), so rows that share a prefix are neighbours, and a shard of about ``SHARD`` rows is one padded matrix: numpy
lexsort puts it in order, a comparison of each row with the one before, OR-accumulated over the columns, marks where nodes
start, and ``reduceat`` between the marks aggregates the nodes of each depth.

Every start is marked once in the whole table: the first row of a shard is compared with the last of the shard before.
So all figures of a node are sums and minima over its rows, also the sums over its subtree, in which each node counts at
its start; and a node that lies in several shards is put together from their parts by a plain aggregate over its digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.parts import global_row_number
from weftline.session import cut_lineage, release

#: Turns of a panel, rows of a shard, ids in a piece of a node's list.
PANEL, SHARD, PIECE = 32, 16_384, 4096
#: Conversations of a family, whose first member lends its first turns, and the most turns lent plus one.
FAMILY, LENT = 100, 6
NO_IDS = sha256(b"").hexdigest()


def turns_in_order(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, chars): the turns of each conversation from 1, with a 128-bit key of role and text.

    Null turns come first; equal ones are ordered by role and then by the key. Null role or text is empty; rows without a
    conversation are left out. The position is one in the whole table less that of the conversation's first row, so a
    conversation that holds most rows is ordered by many tasks.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    flat = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"), key.alias("key"), F.length(t).cast("long").alias("chars"))
    placed = cut_lineage(global_row_number(flat, [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()], "at").drop("role", "turn"))
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "key", "chars")


def rebuilt(turns: DataFrame, family: int = FAMILY, lent: int = LENT) -> tuple[DataFrame, DataFrame]:
    """The conversations after each took the first turns of its family's first member in place of its own.

    Gives (conv_id, d, key, chars) and the ids of all conversations, those without any turn left among them. How many turns
    are lent, ``crc32(conv_id) % lent``, does not depend on the conversation's length; at most ``lent - 1`` rows of a first
    member meet at most ``family`` conversations.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % lent).alias("h"))
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < lent))
    lenders = sizes.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = cut_lineage(convs.join(lenders, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    taken = convs.join(heads.withColumnRenamed("conv_id", "base"), "base").where("pos <= h").select("conv_id", F.col("pos").alias("d"), "key", "chars")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "key", "chars")
    return taken.unionByName(own), convs.select("conv_id")


def _running(value: Column, *, before: bool) -> Column:
    """Sum over the panels of a conversation before or behind a row."""
    w = Window.partitionBy("conv_id").orderBy(F.col("panel") if before else F.col("panel").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _classes(sequences: DataFrame) -> DataFrame:
    """(conv_id, n_convs, ends_sha256) per distinct sequence (h1, h2, n): smallest id, how many, digest of the sorted ids.

    Ids of one sequence can be most of the table, and a digest is sequential. So ranges of the sorted ids are joined into
    pieces in parallel first, and the digest reads the few pieces of a sequence in order.
    """
    key = ["h1", "h2", "n"]
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sequences.repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id").select(F.concat_ws(":", *key).alias("k"), "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            names, ids = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            cut = np.unique(np.concatenate([np.arange(s, e, PIECE) for s, e in zip(cut, np.r_[cut[1:], len(ids)], strict=True)]))
            stops = np.r_[cut[1:], len(ids)]
            yield pa.RecordBatch.from_pydict({"k": names[cut].tolist(), "first": ids[cut], "n_convs": stops - cut, "ids": [",".join(map(str, ids[s:e].tolist())) for s, e in zip(cut, stops, strict=True)]})

    def digests(batches: Iterator[pa.RecordBatch]):
        now, first, count, running = None, 0, 0, None
        for b in batches:
            out = []
            for k, f, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now:
                    if now is not None:
                        out.append((first, count, running.hexdigest()))
                    now, first, count, running = k, f, 0, sha256()
                running.update((("," if count else "") + ids).encode())
                count += n
            yield _rows(out)
        if now is not None:
            yield _rows([(first, count, running.hexdigest())])

    def _rows(out: list) -> pa.RecordBatch:
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["conv_id", "n_convs", "ends_sha256"])

    joined = ordered.mapInArrow(pieces, "k string, first long, n_convs long, ids string")
    return joined.repartition("k").sortWithinPartitions("k", "first").mapInArrow(digests, "conv_id long, n_convs long, ends_sha256 string")


def _panels(turns: DataFrame, convs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Panel rows of the classes, and the classes.

    A row has the digest of the turns before it (``prefix``) and up to its end (``following``), the ids and sizes of its
    turns, the characters behind it and whether the conversation ends in it.
    """
    panel = F.floor((F.col("d") - 1) / width).cast("int")
    cells = turns.groupBy("conv_id", panel.alias("panel")).agg(F.array_sort(F.collect_list(F.struct("d", "key", "chars"))).alias("c"))
    cells = cut_lineage(cells.select("conv_id", "panel", F.col("c.key").alias("ids"), F.col("c.chars").alias("chars")))
    # The digest of a sequence is a sum over its panels, so a long one is summed in parts.
    halves = [F.xxhash64("panel", "ids").cast("decimal(38,0)"), F.xxhash64("ids", "panel", F.lit("2")).cast("decimal(38,0)")]
    sums = cells.groupBy("conv_id").agg(*[F.sum(x).alias(f"h{k}") for k, x in enumerate(halves, 1)], F.sum(F.size("ids")).alias("n"))
    zero = F.lit(0).cast("decimal(38,0)")
    sequences = convs.join(sums, "conv_id", "left").select("conv_id", *[F.coalesce(h, zero).alias(h) for h in ("h1", "h2")], F.coalesce("n", F.lit(0)).alias("n"))
    classes = cut_lineage(_classes(sequences))
    named = classes.select("conv_id", "n_convs").join(cells, "conv_id", "left")

    def digest(plus: list[Column] | None = None) -> Column:
        past = [_running(x, before=True) for x in halves]
        return F.unhex(F.md5(F.concat_ws(":", *[(p if plus is None else p + q).cast("string") for p, q in zip(past, plus or past, strict=True)])))

    size = F.coalesce(F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    rows = named.select(
        "conv_id", "n_convs", F.coalesce("panel", F.lit(0)).alias("panel"), F.when(F.col("panel") > 0, digest()).otherwise(F.lit(b"")).alias("prefix"),
        F.when(F.col("panel").isNotNull(), digest(halves)).alias("following"), F.coalesce("ids", F.array().cast("array<binary>")).alias("ids"),
        F.coalesce("chars", F.array().cast("array<bigint>")).alias("chars"), _running(size, before=False).cast("long").alias("chars_behind"),
        F.lead("panel").over(Window.partitionBy("conv_id").orderBy("panel")).isNull().alias("ends"))
    return rows, classes


BEHIND = ["own_behind", "leaves_behind", "starts_behind"]
_KEY = ["panel", "prefix", "ids", "more", "conv_id"]


def _sharded(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows in range shards, written once, and per shard its neighbours' nearest rows."""
    spark = rows.sparkSession
    rows = rows.withColumn("more", ~F.col("ends"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // size))
    placed = cut_lineage(rows.repartitionByRange(parts, *_KEY).withColumn("shard", F.spark_partition_id()))
    edges = placed.groupBy("shard").agg(F.min(F.struct(*_KEY)).alias("low"), F.max(F.struct(*_KEY)).alias("high"))
    w = Window.orderBy("shard")  # one row for a shard
    return placed, edges.select("shard", F.lag("high").over(w).alias("up"), F.lead("low").over(w).alias("down"))


class _Matrix:
    """One shard in order: ids padded to a matrix, starts of nodes, and how far the neighbours agree."""

    def __init__(self, table: pa.Table, edges: pa.Table) -> None:
        ids = table.column("ids").combine_chunks()
        size = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        width = max(1, int(size.max()))
        live = np.arange(width) < size[:, None]
        halves = np.frombuffer(b"".join(ids.flatten().to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        m = np.zeros((len(size), width, 2), np.uint64)
        m[live] = halves
        head = [np.array([int.from_bytes(p[:8], "big"), int.from_bytes(p[8:], "big")], np.uint64) for p in table.column("prefix").to_pylist()]
        head, panel = np.stack(head), table.column("panel").to_numpy()
        more = ~table.column("ends").to_numpy(zero_copy_only=False)
        conv = table.column("conv_id").to_numpy()
        columns = [m[:, c, k] for c in range(width) for k in range(2)]
        order = np.lexsort((conv, more, *columns[::-1], head[:, 1], head[:, 0], panel))
        self.table = table.take(pa.array(order))
        self.size, self.live, self.panel, self.head, self.more, self.conv = size[order], live[order], panel[order], head[order], more[order], conv[order]
        m = m[order]
        chars = np.zeros(live.shape, np.int64)
        chars[live] = table.column("chars").combine_chunks().flatten().to_numpy()
        self.chars = chars[order]
        edge = edges.to_pylist()[0]
        low = self._agreeing(m[0], self.size[0], self.panel[0], self.head[0], edge["up"])
        high = self._agreeing(m[-1], self.size[-1], self.panel[-1], self.head[-1], edge["down"])
        #: Columns shared with the row above the shard and the one below; -1: not even the digest before.
        self.up, self.down = low, high
        other = (self.panel[1:] != self.panel[:-1]) | (self.head[1:] != self.head[:-1]).any(axis=1)
        change = np.empty((len(size), width + 1), bool)
        change[0] = np.arange(-1, width) >= low
        change[1:, 0], change[1:, 1:] = other, (m[1:] != m[:-1]).any(axis=2)
        change = np.logical_or.accumulate(change, axis=1)
        #: Column 0 is the node before the panel (the root in panel 0), column c + 1 that of the panel's turn c.
        self.starts = change & np.concatenate([np.ones((len(size), 1), bool), self.live], axis=1)
        # The node of a row's end has children if the next row goes on from it.
        shared = np.empty(len(size), np.int64)
        shared[:-1] = np.where(change[1:].any(axis=1), change[1:].argmax(axis=1), width + 1) - 1
        shared[-1] = high
        follows = np.empty(len(size), bool)
        follows[:-1] = shared[:-1] >= self.size[:-1]
        follows[-1] = edge["down"] is not None and high >= self.size[-1]
        self.leaf = ~self.more & ~follows

    @staticmethod
    def _agreeing(ids: np.ndarray, size: int, panel: int, head: np.ndarray, edge: dict | None) -> int:
        if edge is None or edge["panel"] != panel or (int.from_bytes(edge["prefix"][:8], "big"), int.from_bytes(edge["prefix"][8:], "big")) != tuple(head.tolist()):
            return -1
        for c in range(min(int(size), len(edge["ids"]))):
            if (int.from_bytes(edge["ids"][c][:8], "big"), int.from_bytes(edge["ids"][c][8:], "big")) != tuple(ids[c].tolist()):
                return c
        return min(int(size), len(edge["ids"]))

    def behind(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def _owned(table: pa.Table, edges: pa.Table) -> pa.Table:
    """Per panel row what starts in it: characters of nodes, leaves, and whether its first turn does."""
    x = _Matrix(table, edges)
    first = x.starts[:, 1] if x.starts.shape[1] > 1 else np.zeros(len(x.conv), bool)
    return pa.table({"conv_id": x.conv, "panel": x.panel, "own": (x.chars * x.starts[:, 1:]).sum(axis=1), "leaves": x.leaf.astype(np.int64), "starts": first.astype(np.int64)})


_PARTS = "depth int, node binary, parent_node binary, conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends long"


def _nodes(table: pa.Table, edges: pa.Table, panel: int) -> pa.Table:
    """Nodes of a shard; those that others may add to, or whose children lie in other panels, with their digests."""
    x = _Matrix(table, edges)
    rows, width = x.live.shape
    copies = x.behind("n_convs")
    whole = np.concatenate([np.zeros((rows, 1), np.int64), x.chars], axis=1)
    past = lambda a: np.cumsum(a[:, ::-1], axis=1)[:, ::-1]
    total = (past(whole) + x.behind("chars_behind")[:, None]) * copies[:, None]
    own = past(whole * x.starts) + x.behind("own_behind")[:, None]
    leaves = x.leaf + x.behind("leaves_behind")
    following, prefixes, ids, beyond = x.table.column("following"), x.table.column("prefix"), x.table.column("ids"), x.behind("starts_behind")
    digests: dict[tuple[int, int], bytes] = {}

    def name(row: int, c: int) -> bytes:
        """Digest of the node at a column of a row, the same in every shard."""
        if c == panel:
            return b"P" + int(x.panel[row] + 1).to_bytes(8, "big") + following[row].as_py()
        if c == 0:
            return b"P" + int(x.panel[row]).to_bytes(8, "big") + prefixes[row].as_py()
        if (row, c) not in digests:
            digests[row, c] = b"N" + md5(int(x.panel[row]).to_bytes(8, "big") + prefixes[row].as_py() + b"".join(ids[row].as_py()[:c])).digest()
        return digests[row, c]

    out = []
    above, above_node = np.full(rows, -1, np.int64), None
    for c in range(width + 1):
        pick = np.flatnonzero(x.panel == 0) if c == 0 else np.flatnonzero(x.live[:, c - 1])
        if not len(pick):
            above_node = None if c == 0 else above_node
            continue
        first = np.flatnonzero(np.r_[True, x.starts[pick[1:], c]])
        count = np.diff(np.r_[first, len(pick)])
        smallest = np.minimum.reduceat(x.conv[pick], first)
        below = x.starts[pick, c + 1].astype(np.int64) if c < width else np.zeros(len(pick), np.int64)
        if c == panel:
            below = below + beyond[pick]
        ended = np.where(~x.more[pick] & (x.size[pick] == c), x.conv[pick], -1)
        # Shared with a neighbour shard, or continued in another panel.
        split = np.zeros(len(first), bool)
        split[0] |= pick[0] == 0 and x.up >= c
        split[-1] |= pick[-1] == rows - 1 and x.down >= c
        if c == panel:
            split |= np.logical_or.reduceat(x.more[pick], first)
        if c == 0:
            split[:] = True
        leads = pick[first]
        node = [name(int(r), c) if s else None for r, s in zip(leads, split, strict=True)]
        if c == 0:
            up, parent = [None] * len(first), np.full(len(first), -1)
        elif c == 1:
            up, parent = [name(int(r), 0) for r in leads], np.full(len(first), -1)
        else:
            which = above[leads]
            up, parent = [above_node[k][0] for k in which], np.array([above_node[k][1] for k in which])
        out.append(pa.table({
            "depth": pa.array(x.panel[leads] * panel + c, pa.int32()), "node": pa.array(node, pa.binary()), "parent_node": pa.array(up, pa.binary()), "conv_id": smallest,
            "parent": pa.array(parent, pa.int64(), mask=np.array([u is not None for u in up]) | (c == 0)), "n_convs": np.add.reduceat(copies[pick], first), "n_children": np.add.reduceat(below, first),
            "n_leaves": np.add.reduceat(leaves[pick], first), "saved": np.add.reduceat((total - own)[pick, c], first), "ends": pa.array(m := np.maximum.reduceat(ended, first), pa.int64(), mask=m < 0)}))
        above = np.full(rows, -1, np.int64)
        above[pick] = np.repeat(np.arange(len(first)), count)
        above_node = [(n, int(s)) for n, s in zip(node, smallest, strict=True)]
    return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip("depth node parent_node conv_id parent n_convs n_children n_leaves saved ends".split(), [pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 7, strict=True)})


def trie(turns: DataFrame, convs: DataFrame, panel: int = PANEL, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie over (conv_id, d, key, chars), d from 1 without gaps; ``convs`` has the ids of all conversations.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node. An empty
    table has no nodes, not even the root; conversations without turns end at the root.
    """
    rows, classes = _panels(turns, convs, panel)
    zeros = [F.lit(0).cast("long").alias(c) for c in BEHIND]
    rows = cut_lineage(rows)
    # What starts in later panels is summed up for the earlier ones of the same conversation.
    later, edges = _sharded(rows.where("panel > 0").select("*", *zeros), shard)
    owned = later.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_owned, "conv_id long, panel int, own long, leaves long, starts long")
    sums = owned.unionByName(rows.where("panel = 0 AND NOT ends").select("conv_id", "panel", *[F.lit(0).cast("long").alias(c) for c in ("own", "leaves", "starts")]))
    nearest = F.coalesce(F.lead("starts").over(Window.partitionBy("conv_id").orderBy("panel")), F.lit(0))
    behind = sums.select("conv_id", "panel", _running(F.col("own"), before=False).alias(BEHIND[0]), _running(F.col("leaves"), before=False).alias(BEHIND[1]), nearest.alias(BEHIND[2]))
    whole = rows.join(behind, ["conv_id", "panel"], "left").na.fill(0, BEHIND)
    placed, edges = _sharded(whole, shard)
    parts = cut_lineage(placed.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(lambda t, e: _nodes(t, e, panel), _PARTS))
    release(rows, later)
    split = parts.where("node IS NOT NULL").groupBy("node").agg(
        F.min("depth").alias("depth"), F.max("parent_node").alias("parent_node"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends").alias("ends"))
    split = cut_lineage(split)
    nodes = parts.where("node IS NULL").unionByName(split)
    above = split.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above"))
    digests = classes.select(F.col("conv_id").alias("ends"), "ends_sha256")
    return nodes.join(above, "parent_node", "left").join(digests, "ends", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("above", "parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, family: int = FAMILY, lent: int = LENT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations; see ``turns_in_order``, ``rebuilt`` and ``trie`` for ties, nulls and empty
    tables. Repeated rows are turns of their own; further columns are ignored, whatever their names."""
    turns = cut_lineage(turns_in_order(conversations, conv_id, turn, role, text))
    return trie(*rebuilt(turns, family, lent))

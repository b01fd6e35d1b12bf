"""N-gram Jaccard self-join of documents by signature trees.

A document's set holds its distinct shingles of ``words`` words (A-Z lowered, words split at white space); a
shorter text is one shingle, a text without words has the empty set and links with nothing. Two documents link
when ``100 * |x & y| >= percent * |x | y|``.

1. Shingles get one global order, rare first, from a sketch of fixed size that counted all of them. Sets that link
   share a shingle among their first ``n - ceil(percent * n / 100) + 1``, so the sets that hold a shingle there form
   a *block*, and no linking pair is outside all blocks. Very common shingles come last and open no block. In the block
   of their first common shingle, what two sets hold from there on must suffice for the overlap; other pairs are passed.
2. Every member of a block is compared with the block's first set and the one before it, in an order of each block's
   own. This joins most near copies, of groups of any size, at linear cost.
3. The other members of a block that are not yet one component become a signature tree: sets, leaves, branches; a node
   holds the OR of its sets' shingle bitmaps, their size range and the most shingles a bitmap can hide. Pairs of nodes
   are followed downwards together while their sizes fit, they span more than one component, and the largest possible
   overlap reaches the smallest one needed. What is left of set pairs is compared exactly.

Copies of a set are one node throughout, so groups of copies cost nothing but their rows. No step needs a group in
one task: blocks stream in sorted order, branches have about ``BRANCH`` sets, and pairs inside a component are skipped.
Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import graph, sketch
from weftline.llm.hashing import SPACED, mix, small_batches, text_buffer, words_of
from weftline.llm.memory import frugal
from weftline.session import cut_lineage, release

#: log2 of the counters that order shingles, and of the bitmap of sets to be compared. Fixed: they bound what is broadcast.
ORDER_BITS, WANTED_BITS = 22, 22
#: Smallest and largest bitmap of a set, bits; sets in a leaf and in a branch.
BITS, LEAF, BRANCH = (1024, 32768), 32, 4096
#: Sets that a task remembers to have met, so that copies near each other go out once; others meet after the shuffle.
MET = 1 << 16
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each slice of rows with the sorted distinct shingle hashes of its texts (column ``text``, ending in a separator)."""
    seeds = np.resize(_SEEDS, words)
    for batch in small_batches(batches, "text"):
        h, first = words_of(*text_buffer(batch.column(batch.schema.get_field_index("text"))), SPACED)
        runs = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
        for j in range(words):
            runs += h[j : j + len(runs)] * seeds[j]
        runs = mix(runs)
        sets = []
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= words:
                x = np.sort(runs[s : e - words + 1])
                sets.append(x[np.r_[True, x[1:] != x[:-1]]])
            elif e > s:
                sets.append(mix(np.array([(h[s:e] * seeds[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s)])))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield batch, sets


def set_id(x: np.ndarray) -> int:
    """Signed 64-bit identity of a set."""
    total = int(mix(x + _SEEDS[7]).sum(dtype=np.uint64)) + len(x) * int(_SEEDS[9])
    return int(mix(np.array([total & (1 << 64) - 1], dtype=np.uint64)).view(np.int64)[0])


def prefix(x: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the global order (class of count, hash)."""
    keep = len(x) - (percent * len(x) + 99) // 100 + 1
    rank = np.frexp(counts[(x & np.uint64(len(counts) - 1)).astype(np.int64)].astype(np.float32))[1]
    return x[np.lexsort((x, rank))[:keep]]


def signature(x: np.ndarray) -> bytes:
    """Bitmap of a set: sixteen bits for each shingle, rounded up to a power of two, between the two ends of ``BITS``."""
    size = min(max(BITS[0], 1 << (16 * len(x) - 1).bit_length()), BITS[1])
    bits = np.zeros(size, dtype=np.uint8)
    bits[((x >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with ``size`` bits."""
    while bits.shape[1] * 64 > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _table(raw: list[bytes], size: int) -> np.ndarray:
    """Signatures of any sizes as rows of one table of ``size`` bits."""
    out = np.empty((len(raw), size // 64), dtype=np.uint64)
    each = np.array([len(b) for b in raw])
    for n in np.unique(each):
        at = np.flatnonzero(each == n)
        out[at] = folded(np.frombuffer(b"".join([raw[k] for k in at]), dtype=np.uint64).reshape(len(at), n // 8), size)
    return out


def _blocks(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(token, hub, prev, sid, n and rest of each, several): the members after the first of each block of two sets or more.

    Each stands beside the block's first member and the one before it, in an order by hash that is another in each
    block. ``rest``: how many shingles a set has from this one on, in the global order. ``several`` is false only where
    the block has no further member, so that no pair is left besides these.
    """
    counts = sketch.count_hashes(texts.select("text"), lambda bs: (np.concatenate(s) for _, s in shingle_sets(bs, words)), ORDER_BITS)

    def rows(batches):
        seen: set[int] = set()
        for _, sets in shingle_sets(batches, words):
            parts, ids, sizes, rests = [], [], [], []
            for x in sets:
                if len(x) and (sid := set_id(x)) not in seen:
                    _meet(seen, sid)
                    parts.append(prefix(x, counts, percent))
                    ids.append(sid)
                    sizes.append(len(x))
                    rests.append(np.arange(len(x), len(x) - len(parts[-1]), -1, dtype=np.int32))
            if parts:
                each = [len(p) for p in parts]
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(np.concatenate(parts).view(np.int64)), "sid": pa.array(np.repeat(np.array(ids, np.int64), each)),
                    "n": pa.array(np.repeat(np.array(sizes, np.int32), each)), "rest": pa.array(np.concatenate(rests))})

    def groups(batches):
        # Of the group at hand: token, first and latest member (set, size, rest), and how many came after the first.
        token, hub, latest, after = None, None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t, *member = (b.column(k).to_numpy() for k in range(4))
            new = np.r_[token is None or t[0] != token, t[1:] != t[:-1]]
            # Copies of a set, met in several tasks, follow each other.
            again = ~new & np.r_[latest is not None and member[0][0] == latest[0], member[0][1:] == member[0][:-1]]
            kept = np.flatnonzero(~again)
            t, new, member = t[kept], new[kept], [c[kept] for c in member]
            if not len(t):
                continue
            starts, which = np.flatnonzero(new), np.cumsum(new) - 1
            # The first members of all groups in this batch; the last row stands for the group carried over.
            hubs = [np.append(c[starts], 0 if hub is None else hub[k]).astype(c.dtype) for k, c in enumerate(member)]
            before = [np.r_[0 if latest is None else latest[k], c[:-1]].astype(c.dtype) for k, c in enumerate(member)]
            out = np.flatnonzero(~new)
            each = np.bincount(which[out] + 1, minlength=len(starts) + 1)
            each[0] += after
            if len(out):
                group = which[out]
                # Whether the block may have a third member: in the batch's last group that is not known yet.
                several = (each[group + 1] > 1) | (group == which[-1])
                rows = [t[out], *[h[group] for h in hubs], *[c[out] for c in before], *[c[out] for c in member], several]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["token", "hub", "hub_n", "hub_rest", "prev", "prev_n", "prev_rest", "sid", "n", "rest", "several"])
            after = int(each[which[-1] + 1])
            token, hub, latest = t[-1], [h[which[-1]] for h in hubs], [c[-1] for c in member]

    by_token = texts.select("text").mapInArrow(frugal(rows), "token long, sid long, n int, rest int").repartition("token")
    ordered = by_token.sortWithinPartitions("token", F.xxhash64("sid", "token"), "sid")
    return ordered.mapInArrow(frugal(groups), "token long, hub long, hub_n int, hub_rest int, prev long, prev_n int, prev_rest int, sid long, n int, rest int, several boolean")


def _members(texts: DataFrame, wanted: np.ndarray, words: int) -> DataFrame:
    """(doc_id, text_key, n, sid) of every row; the signature where the set is in a block, once per task."""
    wanted = np.packbits(wanted > 0)

    def rows(batches):
        seen: set[int] = set()
        for batch, sets in shingle_sets(batches, words):
            ids = [set_id(x) for x in sets]
            bits = []
            for x, sid in zip(sets, ids, strict=True):
                new = len(x) and _holds(wanted, sid) and sid not in seen
                if new:
                    _meet(seen, sid)
                bits.append(signature(x) if new else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")), "text_key": batch.column(batch.schema.get_field_index("text_key")),
                "n": pa.array([len(x) for x in sets], pa.int32()), "sid": pa.array(ids, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return texts.mapInArrow(frugal(rows), "doc_id long, text_key long, n int, sid long, bits binary")


def _meet(seen: set[int], sid: int) -> None:
    if len(seen) >= MET:
        seen.clear()
    seen.add(sid)


def _holds(packed: np.ndarray, key: int) -> int:
    at = key & (len(packed) * 8 - 1)
    return int(packed[at >> 3]) >> (7 - (at & 7)) & 1


def _sets(texts: DataFrame, every: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(sid, tokens) of the sets in ``pairs``, and of few others: only texts whose hash is wanted are read into sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    keys = every.groupBy("sid").agg(F.min("text_key").alias("text_key")).join(ids, "sid").select("text_key")
    wanted = np.packbits(sketch.count_hashes(keys, sketch.hashes_of_column("text_key"), WANTED_BITS) > 0)

    def rows(batches):
        seen: set[int] = set()

        def chosen():
            for batch in batches:
                at = batch.column(batch.schema.get_field_index("text_key")).to_numpy() & (len(wanted) * 8 - 1)
                yield batch.filter(pa.array((wanted[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

        for _, sets in shingle_sets(chosen(), words):
            new = [(sid, x.view(np.int64)) for x in sets if len(x) and (sid := set_id(x)) not in seen and not _meet(seen, sid)]
            if new:
                yield pa.RecordBatch.from_pydict({"sid": pa.array([i for i, _ in new], pa.int64()), "tokens": pa.array([x for _, x in new], pa.list_(pa.int64()))})

    return texts.select("text_key", "text").mapInArrow(frugal(rows), "sid long, tokens array<long>").dropDuplicates(["sid"])


def _signatures(every: DataFrame) -> DataFrame:
    """(sid, n, bits), each set once."""
    return every.where("bits IS NOT NULL").select("sid", "n", "bits").dropDuplicates(["sid"])


def _fits(n1: str, n2: str, rest1: str, rest2: str, percent: int):
    """Whether sizes, and what follows the shingle of the block, allow a link."""
    return F.expr(f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND {100 + percent} * least({rest1}, {rest2}) >= {percent} * ({n1} + {n2})")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact comparison."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.withColumn("o", shared).where(F.expr(f"100 * o >= {percent} * (size(x) + size(y) - o)")).select("a", "b")


def _may_link(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose largest possible overlap, by their signatures, is enough."""
    both = pairs.join(signatures.select(F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("b1")), "a").join(
        signatures.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("b2")), "b").select("a", "b", "n1", "n2", "b1", "b2")

    def enough(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                n1, n2 = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
                raw1, raw2 = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                ok = np.zeros(batch.num_rows, dtype=bool)
                size = np.array([8 * min(len(x), len(y)) for x, y in zip(raw1, raw2, strict=True)])
                for n in np.unique(size):
                    at = np.flatnonzero(size == n)
                    x, y = _table([raw1[i] for i in at], int(n)), _table([raw2[i] for i in at], int(n))
                    ok[at] = (100 + percent) * _most(x, y, n1[at], n2[at]) >= percent * (n1[at] + n2[at])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(frugal(enough), "a long, b long")


def _most(x: np.ndarray, y: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Largest possible overlap of sets by their bitmaps, row by row: shared bits, and shingles that hide behind others'."""
    hidden = np.minimum(n1 - np.bitwise_count(x).sum(axis=1, dtype=np.int64), n2 - np.bitwise_count(y).sum(axis=1, dtype=np.int64))
    return np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + hidden


class Tree:
    """Signature tree of a branch's sets: leaves of ``LEAF`` sets, alike in component and size, under one root."""

    def __init__(self, sid, n, comp, rest, bits):
        order = np.lexsort((n, comp))
        self.sid, self.n, self.comp, self.rest, self.bits = sid[order], n[order], comp[order], rest[order], bits[order]
        self.hidden = self.n - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.starts = np.arange(0, len(sid), LEAF)
        self.union = np.bitwise_or.reduceat(self.bits, self.starts)
        self.lo_n, self.hi_n = np.minimum.reduceat(self.n, self.starts), np.maximum.reduceat(self.n, self.starts)
        self.lo_c, self.hi_c = np.minimum.reduceat(self.comp, self.starts), np.maximum.reduceat(self.comp, self.starts)
        self.most_hidden, self.most_rest = np.maximum.reduceat(self.hidden, self.starts), np.maximum.reduceat(self.rest, self.starts)

    def pairs(self, other: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets of both trees that may link and are of different components, by following pairs of leaves that may hold some."""
        left, right = [], []
        for k, s in enumerate(self.starts):
            need = percent * (self.lo_n[k] + other.lo_n)
            open_ = ~((self.lo_c[k] == self.hi_c[k]) & (other.lo_c == other.hi_c) & (self.lo_c[k] == other.lo_c))
            open_ &= (100 * self.hi_n[k] >= percent * other.lo_n) & (100 * other.hi_n >= percent * self.lo_n[k])
            open_ &= (100 + percent) * np.minimum(self.most_rest[k], other.most_rest) >= need
            at = np.flatnonzero(open_)
            shared = np.bitwise_count(self.union[k] & other.union[at]).sum(axis=1, dtype=np.int64)
            at = at[(100 + percent) * (shared + np.minimum(self.most_hidden[k], other.most_hidden[at])) >= need[at]]
            if not len(at):
                continue
            own = np.arange(s, min(s + LEAF, len(self.sid)))
            far = (other.starts[at][:, None] + np.arange(LEAF)).ravel()
            far = far[far < len(other.sid)] if at[-1] == len(other.starts) - 1 else far
            need = percent * (self.n[own][:, None] + other.n[far][None, :])
            may = (self.comp[own][:, None] != other.comp[far][None, :]) & ((100 + percent) * np.minimum(self.rest[own][:, None], other.rest[far][None, :]) >= need)
            may &= 100 * np.minimum(self.n[own][:, None], other.n[far][None, :]) >= percent * np.maximum(self.n[own][:, None], other.n[far][None, :])
            i, j = np.nonzero(may)
            for c in range(0, len(i), 8192):
                x, y = own[i[c : c + 8192]], far[j[c : c + 8192]]
                most = np.bitwise_count(self.bits[x] & other.bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(self.hidden[x], other.hidden[y])
                ok = (100 + percent) * most >= percent * (self.n[x] + other.n[y])
                left.append(self.sid[x[ok]])
                right.append(other.sid[y[ok]])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])


def _tree_pairs(blocks: DataFrame, signatures: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Table of pairs (a, b) of different components that the dual traversal of the blocks' trees leaves over."""
    # The block's first set has met all others; what is left are pairs among those.
    rows = blocks.where("several").select("token", "sid", "n", "rest").join(found.withColumnsRenamed({"node": "sid", "component": "comp"}), "sid", "left")
    rows = marked = cut_lineage(rows.withColumn("comp", F.coalesce("comp", "sid")))
    # Blocks of several components; those with the same sets (a passage has many shingles) become one, with the largest rests.
    same = [F.bit_xor(F.xxhash64("sid")).alias("f1"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("f2"), F.count("*").alias("c")]
    mixed = cut_lineage(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *same).where("lo != hi").drop("lo", "hi"))
    one = mixed.join(mixed.groupBy("f1", "f2", "c").agg(F.min("token").alias("one")), ["f1", "f2", "c"]).select("token", "one")
    rows = cut_lineage(rows.join(one, "token").groupBy(F.col("one").alias("token"), "sid").agg(F.max("n").alias("n"), F.max("comp").alias("comp"), F.max("rest").alias("rest")))
    release(marked, mixed)
    # Branches of bounded size; a block that has several is followed in all pairs of branches whose bounds allow it.
    sizes = rows.groupBy("token").agg(F.ceil(F.count("*") / BRANCH).cast("int").alias("branches"))
    placed = rows.join(sizes, "token").withColumn("branch", F.pmod(F.xxhash64("sid"), F.col("branches")).cast("int"))
    nodes = placed.where("branches > 1").groupBy("token", "branch").agg(
        F.min("n").alias("lo_n"), F.max("n").alias("hi_n"), F.max("rest").alias("rest"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    a, b = nodes.alias("a"), nodes.alias("b")
    open_ = F.expr("a.branch < b.branch AND NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo)"
                   f" AND 100 * a.hi_n >= {percent} * b.lo_n AND 100 * b.hi_n >= {percent} * a.lo_n"
                   f" AND {100 + percent} * least(a.rest, b.rest) >= {percent} * (a.lo_n + b.lo_n)")
    several = a.join(b, (F.col("a.token") == F.col("b.token")) & open_).select(F.col("a.token").alias("token"), F.col("a.branch").alias("b1"), F.col("b.branch").alias("b2"))
    unit, member = ["token", "b1", "b2", "side"], ["sid", "n", "comp", "rest"]
    alone = placed.select("token", F.col("branch").alias("b1"), F.col("branch").alias("b2"), F.lit(1).alias("side"), *member)
    sides = [several.join(placed.withColumnRenamed("branch", own), ["token", own]).select("token", "b1", "b2", F.lit(k).alias("side"), *member) for k, own in ((1, "b1"), (2, "b2"))]

    def together(df: DataFrame) -> DataFrame:
        return df.repartition("token", "b1", "b2").sortWithinPartitions(*unit)

    def units(batches):
        """The rows of each unit as columns: token, b1, b2, side, sid, n, comp, rest, and what follows as lists."""
        key, parts = None, []

        def whole():
            return [np.concatenate([p[k] for p in parts]) for k in range(8)], [x for p in parts for x in p[8]]

        for batch in batches:
            columns = [batch.column(k).to_numpy().astype(np.int64) for k in range(8)]
            starts = np.flatnonzero(np.r_[np.ones(min(1, batch.num_rows), bool), np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)])
            rest = batch.column(8).to_pylist() if batch.num_columns > 8 else []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                now = tuple(int(c[s]) for c in columns[:3])
                if parts and key != now:
                    yield whole()
                    parts = []
                key = now
                parts.append((*(c[s:e] for c in columns), rest[s:e]))
        if parts:
            yield whole()

    def fitting(batches):
        """Members that have some other in the unit whose size, rest and component allow a link, before bitmaps are fetched."""
        for columns, _ in units(batches):
            side, _, n, comp, rest = columns[3:]
            left = np.flatnonzero(side == 1)
            right = np.flatnonzero(side == 2) if (side == 2).any() else left
            kept = np.zeros(len(side), dtype=bool)
            for k in range(0, len(left), 256):
                own = left[k : k + 256]
                need = percent * (n[own][:, None] + n[right][None, :])
                may = (comp[own][:, None] != comp[right][None, :]) & ((100 + percent) * np.minimum(rest[own][:, None], rest[right][None, :]) >= need)
                may &= 100 * np.minimum(n[own][:, None], n[right][None, :]) >= percent * np.maximum(n[own][:, None], n[right][None, :])
                kept[own] |= may.any(axis=1)
                kept[right] |= may.any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=[*unit, *member])

    def follow(batches):
        for columns, raw in units(batches):
            side, sid, n, comp, rest = columns[3:]
            table = _table(raw, 8 * min(map(len, raw)))
            trees = [Tree(sid[at], n[at], comp[at], rest[at], table[at]) for k in (1, 2) if len(at := np.flatnonzero(side == k))]
            x, y = trees[0].pairs(trees[-1], percent)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    schema = ", ".join(f"{c} long" for c in [*unit, *member])
    light = cut_lineage(together(alone.union(sides[0]).union(sides[1])).mapInArrow(frugal(fitting), schema))
    release(rows)
    full = light.join(signatures.select("sid", "bits"), "sid").select(*unit, *member, "bits")
    pairs = cut_lineage(together(full).mapInArrow(frugal(follow), "a long, b long").distinct())
    release(light)
    return pairs


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, leads) per row.

    component_id is the smallest id reachable by links, itself included. One document of each component leads: the one
    with this id, of several the one with the smallest ``text_key`` (hash of the text); documents without words always
    lead. Rows with a null or repeated id keep their own text's links; a null id is never a component's name unless the
    component has no other. A null text is an empty one. An empty table gives an empty result, other columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    blocks = cut_lineage(_blocks(texts, words, percent))
    wanted = sketch.count_hashes(blocks.select("sid").union(blocks.select("hub")), sketch.hashes_of_column("sid"), WANTED_BITS)
    every = cut_lineage(_members(texts, wanted, words))
    signatures = cut_lineage(_signatures(every))
    stars = [blocks.where(_fits(f"{k}_n", "n", f"{k}_rest", "rest", percent)).select(F.least(k, "sid").alias("a"), F.greatest(k, "sid").alias("b")) for k in ("hub", "prev")]
    stars = stars[0].union(stars[1]).distinct()
    stars = cut_lineage(_may_link(stars, signatures, percent))
    near = cut_lineage(_linked(stars, _sets(texts, every, stars, words), percent))
    found = cut_lineage(graph.components(near))
    rest = _tree_pairs(blocks, signatures, found, percent)
    if not rest.isEmpty():
        more = cut_lineage(_linked(rest, _sets(texts, every, rest, words), percent))
        found = cut_lineage(graph.components(near.union(more)))
        release(more)
    release(blocks, signatures, stars, near, rest)
    rows = every.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("node"))
    rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    names = rows.where("component IS NOT NULL").groupBy("component").agg(first)
    leads = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return rows.join(names, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "text_key", (F.col("first").isNull() | leads).alias("leads"))

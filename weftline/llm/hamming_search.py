"""Nearest vectors by inner product: learned rotated binary codes, multi-index hashing in shards, rerank on floats.

Equal vectors are one class that keeps as many of its smallest ids as an answer can hold. Inner product becomes angle with
one more component, ``sqrt(M**2 - |x|**2)`` for the longest norm ``M`` and 0 for a query. A rotation learned on a bounded
sample (iterative quantisation of the leading directions) gives ``BITS`` signs.

A shard holds a bounded share of the classes with their codes cut into substrings of ``WIDTH`` bits, each with an index
of the values that occur. A query with radius r looks up, in every substring, all values within floor(r / substrings) bits:
by pigeonhole no code within r is missed. What is found is checked on the whole code and scored on the vectors. Where the
values to look up would be more than the shard holds, the codes themselves are compared, which finds the same.

The radius is the query's own. It follows from a lower bound of the last answer's score, so an upper bound of its angle:
the sample tells how far codes of vectors at such an angle lie apart but for one in ``1 / (1 - CAUGHT)``, and every code
within that distance is retrieved. A query's first bound is the k-th score among the values within ``PROBE`` bits in its
first shard; then shards come in waves, each as many as all before, and a wave starts from the bounds of those before it.
So the radius follows from the data at every size, recall does not hang on a cap of candidates, and a wave gives about as
many answers as the one before. A query that met too few takes all codes. Queries go through a shard in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from weftline.session import cut_lineage, release

#: Bits of a code and of a substring, bits flipped in the first round, share of codes the radius must catch.
BITS, WIDTH, PROBE, CAUGHT = 128, 16, 2, 0.98
#: Classes and bytes of the sample that rotation and radii are learned on.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
#: Most bytes of vectors in a shard, and classes from which on one more shard is worth a task of its own; queries of a
#: block, pairs of a block.
SHARD_BYTES, SHARD_ROWS, BLOCK, PAIRS = 32 << 20, 4096, 256, 1 << 22


def rotation(sample: np.ndarray, bits: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Directions, one a column, whose signs are the code: leading directions of the sample, turned until the signs lie
    close to them; as many independent turns as the bits need."""
    r = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(sample.T @ sample)
    out = []
    while sum(x.shape[1] for x in out) < bits:
        lead = axes[:, ::-1][:, :bits]
        v = sample @ lead
        turn, _ = np.linalg.qr(r.normal(size=(lead.shape[1], lead.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        out.append(lead @ turn)
    return np.concatenate(out, axis=1)[:, :bits]


def codes_of(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Substrings of the codes, one row of 16-bit numbers for a vector."""
    return np.packbits(x @ turn >= 0, axis=1).view(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def radii(sample: np.ndarray, codes: np.ndarray, caught: float, bins: int = 40) -> np.ndarray:
    """For each of ``bins`` equal ranges of the cosine from -1 to 1, the distance that the caught share of codes keeps.

    The larger of what the sample's pairs show and what signs of independent directions would give; never less for a
    wider angle.
    """
    bits = codes.shape[1] * WIDTH
    edge = np.arange(bins) * 2 / bins - 1
    p = np.arccos(edge) / np.pi
    out = np.ceil(bits * p + 2.06 * np.sqrt(bits * p * (1 - p)))  # 2.06: the normal quantile of 0.98
    seen: list[list] = [[] for _ in range(bins)]
    for k in np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(int):
        cosine, apart = sample @ sample[k], distances(codes, codes[k])
        place = np.clip(((cosine + 1) * bins / 2).astype(int), 0, bins - 1)
        for b in np.unique(place):
            seen[b].append(apart[place == b])
    for b, parts in enumerate(seen):
        if parts and len(apart := np.concatenate(parts)) >= 50:
            out[b] = max(out[b], np.quantile(apart, caught))
    return np.minimum(np.maximum.accumulate(out[::-1])[::-1], bits).astype(np.int32)


@cache
def flips(width: int, most: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``most`` of them set."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)], np.uint16)


class Shard:
    """Classes of a shard: their vectors, codes, and for each substring the values in order with the rows they lead to."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, ids: list[np.ndarray]) -> None:
        self.vectors, self.codes, self.words = vectors, codes, np.ascontiguousarray(codes).view(np.uint64)
        self.count = np.array([len(i) for i in ids], np.int64)
        self.ids, self.first = np.concatenate(ids), np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.index = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable").astype(np.int32)
            values, start = np.unique(codes[order, j], return_index=True)
            self.index.append((values, np.append(start, len(order)), order))

    def found(self, code: np.ndarray, most: int) -> np.ndarray:
        """Rows with a substring at most so many bits from the query's, each once."""
        hit = np.zeros(len(self.codes), bool)
        for j, (values, start, order) in enumerate(self.index):
            if most <= 4 and len(flips(WIDTH, most)) < len(values):
                probe = code[j] ^ flips(WIDTH, most)
                at = np.searchsorted(values, probe)
                at = at[values[np.minimum(at, len(values) - 1)] == probe]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= most)
            n = start[at + 1] - start[at]
            hit[order[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return np.flatnonzero(hit)

    def within(self, codes: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which rows have a code within each query's radius."""
        most = radius // codes.shape[1]
        out = np.zeros((len(codes), len(self.codes)), bool)
        narrow = np.array([r <= 4 and len(flips(WIDTH, int(r))) < len(self.codes) // 4 for r in most])
        for q in np.flatnonzero(narrow):
            rows = self.found(codes[q], int(most[q]))
            out[q, rows[distances(self.codes[rows], codes[q]) <= radius[q]]] = True
        wide = np.flatnonzero(~narrow)
        if len(wide):
            words = np.ascontiguousarray(codes[wide]).view(np.uint64)
            apart = sum(np.bitwise_count(words[:, None, w] ^ self.words[None, :, w]).astype(np.int16) for w in range(words.shape[1]))
            out[wide] = apart <= radius[wide, None]
        return out

    def best(self, x: np.ndarray, own: np.ndarray, among: np.ndarray, bound: np.ndarray, k: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): for each query its k best among the marked rows and not under its bound, its own id left out.

        The k + 1 best rows are picked on a matrix product with some slack, and their scores computed anew.
        """
        with np.errstate(invalid="ignore", over="ignore"):
            rough = np.where(among, x @ self.vectors.astype(np.float64).T, -np.inf)
            slack = 1e-9 * scale * np.sqrt((x * x).sum(axis=1))
            least = bound - slack
            if rough.shape[1] > k + 1:
                least = np.fmax(least, np.partition(rough, -k - 1, axis=1)[:, -k - 1] - slack)
            q, rows = np.nonzero(among & ~(rough < least[:, None]))
        score = exact(self.vectors[rows].astype(np.float64), x[q])
        n = self.count[rows]
        ids = self.ids[np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())] if len(rows) else self.ids[:0]
        q, score = np.repeat(q, n), np.repeat(score, n)
        other = (ids != own[q]) & ~(score < bound[q])
        q, ids, score = q[other], ids[other], score[other]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], ids[place < k], score[place < k]


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on, so that they do not depend on the batch."""
    out = np.zeros(len(x))
    for c in range(x.shape[1]):
        out += x[:, c] * q[..., c]
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, bits: int = BITS, caught: float = CAUGHT, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` nearest others found.

    Nearness is the inner product in double precision; ties go to the smaller id. Vectors that are null, empty, zero or
    hold null or non-finite components and rows without an id take no part; vectors of different lengths do not meet.
    Equal vectors under several ids are candidates of their own; repeated rows of one id are one, and an id with several
    vectors asks and answers with each. With ``k`` others at
    most all are given. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    single = isinstance(vectors.schema[embedding].dataType.elementType, FloatType)
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(f"array<{element}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = cut_lineage(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite).withColumn("class", F.xxhash64("v")))
    # The k + 1 smallest ids of a class are all that can be an answer; each task drops the others before the shuffle.
    smallest = Window.partitionBy("class", "v").orderBy("id")
    kept = rows.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    classes = cut_lineage(kept.groupBy("class", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    learned, tasks = {}, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for dim, longest, n in classes.groupBy(F.size("v").alias("d")).agg(F.max(norm), F.count("*")).collect():  # a row for each length
        most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        picked = classes.where(F.size("v") == dim).orderBy(F.hash("class"), "class").limit(most).select("v").collect()
        x = longer(np.array([r["v"] for r in picked], np.float64), longest)
        turn = rotation(x, bits)
        count = max(-(-n * dim * np.dtype(kind).itemsize // shard_bytes), min(tasks, -(-n // shard_rows)))
        learned[dim] = (longest, turn, radii(x, codes_of(x, turn), caught), count)
    shared = vectors.sparkSession.sparkContext.broadcast(learned)
    asked = cut_lineage(rows.where(F.col("id") % every == 0).select("id", "v").distinct())
    shards = F.element_at(F.create_map(*[F.lit(x) for d, m in learned.items() for x in (d, int(m[3]))]), F.size("v")) if learned else F.lit(1)
    stored = classes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("class", F.lit(1)), shards).cast("int").alias("shard"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("bound"), "v", "ids")

    def search(queries: DataFrame, low: int, high: int) -> DataFrame:
        """The k best of each query in each of the shards from ``low`` on, those under its bound left out."""
        several = F.explode(F.sequence(F.lit(low), F.least(F.lit(high), shards.cast("int")) - 1))
        spread = queries.where(shards > low).select(F.size("v").alias("dim"), several.alias("shard"), F.lit(True).alias("asks"), "id", "bound", "v", F.lit(None).cast("array<bigint>").alias("ids"))
        both = stored.where((F.col("shard") >= low) & (F.col("shard") < high)).unionByName(spread)
        tasks = max(1, sum(max(0, min(high, m[3]) - low) for m in learned.values()))
        return both.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "asks").mapInArrow(answer, "id long, vec_id long, score double")

    def answer(batches: Iterator[pa.RecordBatch]):
        key, shard, parts = None, None, []
        for batch in batches:
            head = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            at = 0
            while at < len(head):
                dim, number, asks = head[at]
                if key != (dim, number):
                    key, shard, parts = (dim, number), None, []
                if asks and shard is None:
                    whole = np.concatenate([p for p, _ in parts])
                    longest, turn = shared.value[dim][:2]
                    codes = np.concatenate([codes_of(longer(whole[s : s + 4096].astype(np.float64), longest), turn) for s in range(0, len(whole), 4096)])
                    shard, parts = Shard(whole, codes, [i for _, p in parts for i in p]), []
                most = max(1, min(BLOCK, PAIRS // len(shard.codes))) if asks else 4096
                stop = at + 1
                while stop < len(head) and stop < at + most and head[stop] == head[at]:
                    stop += 1
                part = batch.slice(at, stop - at)
                x = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if asks:
                    yield block(shard, dim, part.column(3).to_numpy(), np.array(part.column(4).fill_null(-np.inf).to_pylist()), x.astype(np.float64))
                else:
                    parts.append((x.astype(kind), [np.array(i, np.int64) for i in part.column(6).to_pylist()]))
                at = stop

    def block(shard: Shard, dim: int, ids: np.ndarray, bound: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        longest, turn, table, _ = shared.value[dim]
        size = np.sqrt((x * x).sum(axis=1))
        codes = codes_of(np.concatenate([x / size[:, None], np.zeros((len(x), 1))], axis=1), turn)
        fresh = np.flatnonzero(np.isneginf(bound))
        if len(fresh):  # no bound yet: the k-th score of what the first look-ups meet
            met = np.zeros((len(fresh), len(shard.codes)), bool)
            for row, q in enumerate(fresh):
                met[row, shard.found(codes[q], PROBE)] = True
            q, _, score = shard.best(x[fresh], ids[fresh], met, bound[fresh], k, longest)
            full = np.flatnonzero(np.bincount(q, minlength=len(fresh)) == k)
            bound = bound.copy()
            bound[fresh[full]] = score[np.searchsorted(q, full, side="right") - 1]
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            cosine = bound / size / longest
        place = np.clip(((np.where(np.isfinite(cosine), cosine, -1) + 1) * len(table) / 2).astype(int), 0, len(table) - 1)
        radius = np.where(np.isfinite(cosine), table[place], turn.shape[1])
        q, names, score = shard.best(x, ids, shard.within(codes, radius), bound, k, longest)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names), pa.array(score)], ["id", "vec_id", "score"])

    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "vec_id")
    answers, low = None, 0
    while low < max([1, *(m[3] for m in learned.values())]):
        high, before = max(1, 2 * low), answers
        bound = F.lit(None).cast("double").alias("bound")
        told = asked.select("id", "v", bound) if before is None else asked.join(before.where(F.col("rank") == k).select("id", F.col("score").alias("bound")), "id", "left").select("id", "v", "bound")
        seen = search(told, low, high)
        seen = seen if before is None else seen.unionByName(before.select("id", "vec_id", "score"))
        answers = cut_lineage(seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        if before is not None:
            release(before)
        low = high
    release(asked)
    return answers.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def longer(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest norm with the component that makes them as long as it."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

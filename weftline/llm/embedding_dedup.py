"""Embedding near-dedup: spherical k-means cells, cosine products of blocks inside them, components of what links.

Equal vectors are one class. Centroids are fitted on a bounded sample of classes; every class then goes to its home
cell and visits the cells whose border is near: with ``|x - y| <= sqrt(2 - 2t)`` for linked unit vectors, of any linked
pair at least one visits the other's home if a vector at home in ``c`` visits all ``e`` with
``x.c - x.e <= sqrt(2 - 2t) * |c - e| / 2``. So no link is lost at any choice of centroids.

In a cell the homes, cut into chunks of ``CHUNK``, are multiplied with all rows of the cell in blocks; a pair is counted
at one place only. A block gives counts of links and a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from weftline.llm import graph
from weftline.session import cut_lineage, release

#: Classes and bytes of the sample for the centroids; classes for each cell, and most cells.
SAMPLE, SAMPLE_BYTES, PER_CELL, CELLS = 8192, 64 << 20, 2048, 512
#: Homes multiplied at once, and rows of a block.
CHUNK, BLOCK = 4096, 512


def centroids_of(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors, begun at evenly spaced rows, empty cells taking the worst served."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        s = sample @ c.T
        home = s.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        for k in np.flatnonzero(norms < 1e-12):
            sums[k] = sample[s.max(axis=1).argsort()[k % len(sample)]]
            norms[k] = np.linalg.norm(sums[k])
        c = sums / norms[:, None]
    return c


def _forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the linked pairs (true cells of the mask) connect, at most one for each member."""
    i, j = np.nonzero(mask)
    if len(i) <= len(left) + len(right):
        return left[i], right[j]
    names = np.concatenate([left, right])
    label = np.arange(len(names))
    a, b = i, j + len(left)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.unique(np.concatenate([a, b]))
    return names[member], names[label[member]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Rows link from a cosine of ``threshold`` on, computed in double precision; those that are null, zero, empty or hold
    null or non-finite components link with nothing, nor do vectors of different lengths. Repeated rows link with each
    other like any others; a null id is never a component's name unless the component has no other, and is not kept.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[embedding].dataType.elementType, FloatType)
    dtype = np.dtype("<f4" if single else "<f8")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("cid", F.when(F.col("v").isNotNull() & (F.size("v") > 0) & finite, F.xxhash64("v")))
    rows = cut_lineage(rows)
    classes = cut_lineage(rows.where("cid IS NOT NULL").groupBy("cid", "v").agg(F.count("*").alias("copies")))
    tables = {}
    for dim, n in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():  # one row for each length
        most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        picked = classes.where(F.size("v") == dim).orderBy(F.xxhash64("cid"), "cid").limit(most).select("v").collect()
        x = np.array([r["v"] for r in picked], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        tables[dim] = centroids_of(x, max(1, min(CELLS, n // PER_CELL, len(x))))
    shared = spark.sparkContext.broadcast(tables)
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-9

    def visits(s: np.ndarray, home: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which cells each vector visits, its home among them; s: cosines with all centroids."""
        apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
        return s[np.arange(len(s)), home][:, None] - s <= reach * apart[home]

    def unit(values: list) -> np.ndarray:
        x = np.array(values, dtype=np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size):
                pick = np.flatnonzero(size == dim)
                raw = np.stack([flat[at[k] : at[k] + dim] for k in pick])
                c = shared.value[int(dim)]
                s = unit(raw) @ c.T
                home = s.argmax(axis=1)
                r, cell = np.nonzero(visits(s, home, c))
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([dim] * len(r), pa.int32()), "cell": pa.array(cell, pa.int32()), "home": pa.array(home[r], pa.int32()),
                    "cid": batch.column(0).take(pa.array(pick[r])), "copies": batch.column(2).take(pa.array(pick[r])),
                    "v": pa.array([raw[k].astype(dtype).tobytes() for k in r], pa.binary())})

    placed = cut_lineage(classes.select("cid", "v", "copies").mapInArrow(place, "dim int, cell int, home int, cid long, copies long, v binary"))
    chunks = placed.where("cell = home").groupBy("dim", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # Each row goes to all chunks of a cell as a visitor, and to its own chunk at home as a home.
    spread = placed.join(chunks, ["dim", "cell"]).withColumn("own", F.when(F.col("cell") == F.col("home"), F.pmod(F.xxhash64("cid"), F.col("chunks"))))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    spread = spread.withColumn("visitor", F.coalesce(F.col("own") != F.col("chunk"), F.lit(True)))
    spread = spread.select("dim", "cell", "chunk", "visitor", "home", "own", "cid", "copies", "v").repartition("dim", "cell", "chunk")

    def links(batches: Iterator[pa.RecordBatch]):
        group, homes = None, None
        pending: list[tuple] = []

        def rows_of(b: pa.RecordBatch, dim: int) -> dict:
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), dtype=dtype).reshape(b.num_rows, dim).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            return {"cid": b.column("cid").to_numpy(), "copies": b.column("copies").to_numpy(), "home": b.column("home").to_numpy(), "own": b.column("own").fill_null(-1).to_numpy(), "x": x / n[:, None], "raw": x, "norm": n}

        def product(h: dict, p: dict, same: bool):
            dim, cell, chunk = group
            linked = h["x"] @ p["x"].T
            edge = np.argwhere(np.abs(linked - threshold) < 1e-9)
            mask = linked >= threshold
            for i, j in edge:  # too near to call after scaling: the plain formula decides
                mask[i, j] = h["raw"][i] @ p["raw"][j] / (h["norm"][i] * p["norm"][j]) >= threshold
            if same:
                mask &= h["cid"][:, None] < p["cid"][None, :]
            elif mask.any():
                at_home = p["home"] == cell
                # Two homes of a cell are counted in the chunk of the smaller; else in the smaller cell if both are visited.
                mask &= ~at_home[None, :] | (h["cid"][:, None] < p["cid"][None, :])
                c = shared.value[dim]
                seen = visits(h["x"] @ c.T, np.full(len(h["cid"]), cell), c)[:, p["home"]]
                mask &= at_home[None, :] | (p["home"] > cell)[None, :] | ~seen
            if not mask.any():
                return None
            counts = mask.astype(np.int64)
            a, b = _forest(mask, h["cid"], p["cid"])
            i, j = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
            left, right = (counts @ p["copies"])[i], (h["copies"] @ counts)[j]
            return pa.RecordBatch.from_pydict({
                "a": pa.array(np.concatenate([h["cid"][i], p["cid"][j], a])), "b": pa.array([None] * (len(i) + len(j)) + b.tolist(), pa.int64()),
                "links": pa.array(np.concatenate([left, right, np.zeros(len(a), np.int64)]))})

        def gathered():
            """The homes of the group in one table, and their products among themselves."""
            nonlocal homes
            if pending:
                homes = {k: np.concatenate([p[k] for p in pending]) for k in pending[0]}
                pending.clear()
                for s in range(0, len(homes["cid"]), BLOCK):
                    yield product(homes, {k: v[s : s + BLOCK] for k, v in homes.items()}, True)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("dim", "cell", "chunk", "visitor")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if group != tuple(keys[s][:3]):
                    yield from filter(None, gathered())
                    group, homes = tuple(int(k) for k in keys[s][:3]), None
                for t in range(s, e, BLOCK):
                    part = rows_of(batch.slice(t, min(BLOCK, e - t)), group[0])
                    if not keys[s][3]:
                        pending.append(part)
                        continue
                    yield from filter(None, gathered())
                    if homes is not None and (out := product(homes, part, False)) is not None:
                        yield out
        yield from filter(None, gathered())

    found = cut_lineage(spread.sortWithinPartitions("dim", "cell", "chunk", "visitor").mapInArrow(links, "a long, b long, links long"))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("others"))
    joined = cut_lineage(graph.components(found.where("b IS NOT NULL").select("a", "b")))
    about = classes.select("cid", "copies").join(counted, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    about = about.select("cid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    whole = cut_lineage(rows.select("vec_id", "cid").join(about, "cid", "left"))
    release(rows, classes, placed, found, joined)
    names = whole.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("name"))
    out = whole.join(names, "component", "left").withColumn("component_id", F.coalesce("name", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))

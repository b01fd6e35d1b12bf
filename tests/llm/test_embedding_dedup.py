import numpy as np
import pytest
from brute import Union

from weftline.llm import embedding_dedup


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())


def expected(rows):
    ids = [i for i, _ in rows]
    union, links = Union(ids), dict.fromkeys(ids, 0)
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    for k, (i, x) in enumerate(good):
        for j, y in good[:k]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    return sorted((i, links[i], union.find(i), union.find(i) == i) for i in ids)


@pytest.mark.parametrize(("dim", "per_cell", "chunk"), [(2, 20, 16), (8, 40, 8), (64, 30, 4096)])
def test_equals_all_pairs(spark, dim, per_cell, chunk, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", per_cell)
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    x = base[rng.integers(0, 60, 240)] + rng.normal(size=(240, dim)) * rng.choice([0, 0.05, 0.2], (240, 1))
    rows = [(k, [float(a) for a in np.float32(v)]) for k, v in enumerate(x)]
    assert run(spark, rows) == expected(rows)


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [-1.0, 0.0])]
    assert run(spark, rows, "double") == expected(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, component long")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [("4", 2, 4, True), ("4", 2, 4, True), ("None", 2, 4, False)]


def test_a_large_group_of_equal_vectors_costs_its_rows(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(3000)] + [(5000, [1.0, 2.0, 3.01])]
    got = run(spark, rows)
    assert {r[1] for r in got} == {3000} and {r[2] for r in got} == {0}

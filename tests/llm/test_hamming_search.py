import numpy as np
import pytest

from weftline.llm import hamming_search


def brute(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, float)
    groups = {}
    for i, v in good.items():
        groups.setdefault(len(v), []).append(i)
    out = []
    for ids in groups.values():
        ids = np.array(sorted(ids))
        all_of = np.stack([good[i] for i in ids])
        for q in ids[ids % every == 0]:
            score = hamming_search.exact(all_of, good[q])
            near = [n for n in np.lexsort((ids, -score)) if ids[n] != q][:k]
            out += [(int(q), n, int(ids[m]), float(score[m])) for n, m in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, id int, shard string")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hamming_search.nearest(df, **kw).collect())


def recall(got, want):
    return len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}) / len(want)


@pytest.mark.parametrize(("shape", "least"), [("directions", 0.95), ("clusters", 0.95), ("lengths", 0.95), ("copies", 0.95)])
def test_recall_against_all_pairs(spark, shape, least):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32))
    if shape == "clusters":
        x = r.normal(size=(60, 32))[r.integers(0, 60, 3000)] + 0.2 * x
    if shape == "lengths":  # norms over four orders: the longest are near everything
        x *= 10 ** r.uniform(-2, 2, (3000, 1))
    if shape == "copies":  # a third of the rows close to one vector
        x[:1000] = x[0] + 0.01 * x[:1000]
    rows = [(k, [float(a) for a in np.float32(v)]) for k, v in enumerate(x)]
    got, want = run(spark, rows, shard_rows=500), brute(rows)
    assert recall(got, want) >= least
    exact = {(w[0], w[2]): w[3] for w in brute(rows, 3000)}
    assert all(exact[g[0], g[2]] == g[3] for g in got)  # the very measure
    by = {}
    for q, n, i, s in got:
        by.setdefault(q, []).append((n, -s, i))
    assert all([n for n, *_ in v] == list(range(1, 21)) and v == sorted(v, key=lambda t: t[1:]) for v in by.values()) and len(by) == 150


def test_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(tuple(r) for r in hamming_search.nearest(df).select("query_id", "rank", "vec_id", "score").collect())
    assert recall(got, brute(rows)) >= 0.95


def test_every_code_within_the_radius_is_found():
    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << 16, (500, 8)).astype(np.uint16)
    codes[100:400] = codes[0] ^ (np.uint16(1) << r.integers(0, 16, (300, 8)).astype(np.uint16)) * (r.random((300, 8)) < 0.5)
    shard = hamming_search.Shard(np.zeros((500, 1), np.float32), codes, [np.array([k]) for k in range(500)])
    for radius in (0, 5, 7, 8, 20, 47, 64, 128):
        found = shard.found(codes[0], radius // 8)
        assert (shard.within(codes[:3], np.full(3, radius)) == (hamming_search.distances(codes[None], codes[:3, None]) <= radius)).all()
        assert set(np.flatnonzero(hamming_search.distances(codes, codes[0]) <= radius)) <= set(found.tolist()) and len(set(found)) == len(found)


def test_edges(spark):
    v = [1.0, 2.0, -1.0]
    rows = [(k, v) for k in range(0, 3000, 3)] + [(20, [2.0, 4.0, -2.0]), (40, [1.0, 0.0, 0.0]), (41, [1.0, 2.0]), (80, [3.0, 1.0])]
    rows += [(100001, None), (100002, []), (100003, [0.0] * 3), (100004, [1.0, None, 2.0]), (100005, [float("nan"), 1.0, 1.0]), (100006, [float("inf"), 1.0, 1.0]), (100020, [0.0] * 3), (None, v), (40, [1.0, 0.0, 0.0])]
    got = run(spark, rows, "double")
    assert got == brute(rows)  # ties to the smaller ids, the query's own left out, fewer than 20 where there are fewer
    assert run(spark, []) == [] and run(spark, [(20, v)], "double") == []
    large = [(k, [1e200 * (k + 1), 1e200, -1e200]) for k in range(30)]
    assert {g[0] for g in run(spark, large, "double")} == {0, 20}

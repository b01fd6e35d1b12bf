import random

import pytest
from brute import jaccard_components as expected

from weftline.llm import ngram_join


def run(spark, texts):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def corpus(rng, n):
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(4, 80))] for _ in range(12)]
    passage = [f"p{k}" for k in range(30)]
    texts = {}
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 500)}"
        if rng.random() < 0.3:
            w += passage
        texts[i] = " ".join(w).upper() if i % 7 == 0 else " \t\n".join(w)
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 4)  # so that trees have several levels
    monkeypatch.setattr(ngram_join, "BRANCH", 8)
    texts = corpus(random.Random(seed), 160)
    assert run(spark, texts) == expected(texts)


def test_tree_alone_finds_what_the_first_set_misses(spark):
    # b and c share most words with a without linking to it, and link with each other.
    common = [f"c{k}" for k in range(60)]
    a = common + [f"a{k}" for k in range(25)]
    b = common + [f"b{k}" for k in range(25)]
    c = common + [f"b{k}" for k in range(24)]
    texts = {k: " ".join(w) for k, w in enumerate([a, b, c])}
    assert run(spark, texts) == expected(texts)


def test_edges(spark):
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (4, None, 3), (5, " \n", 3), (6, "two words", 4), (7, "TWO words", 5), (8, "one two words", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["leads"]) for r in ngram_join.jaccard_components(df).collect())
    assert got == [(0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True)]
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_long_text_and_a_large_group(spark):
    rng = random.Random(5)
    long = [f"x{rng.randint(0, 10**6)}" for _ in range(60_000)]
    texts = {1: " ".join(long), 2: " ".join(long[:-50]), 3: "y" * 2_000_000}
    core = [f"k{k}" for k in range(200)]
    for i in range(10, 400):  # near copies of one text, and exact ones
        w = list(core)
        if i % 3:
            w[i % 200] = f"u{i}"
        texts[i] = " ".join(w)
    got = run(spark, texts)
    assert got[2][1] == 1 and got[3] == (1, 3)
    assert {got[i][1] for i in range(10, 400)} == {10}

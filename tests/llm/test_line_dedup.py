import random

import pytest
from brute import repeated_lines
from pyspark.sql import functions as F

from weftline.llm.line_dedup import dedup_lines


def run(spark, texts, min_words, schema="doc_id long, text string"):
    out = dedup_lines(spark.createDataFrame(list(texts), schema), min_words=min_words)
    return {r["id"]: (r["lines"], r["removed"], r["text"]) for r in out.select(F.col("row.doc_id").alias("id"), "lines", "removed", "text").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs_of_places(spark, seed):
    rng = random.Random(seed)
    lines = ["a b", "c", "d e f", " a b ", "g h i j k l m n", "", "o p q"]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for i in range(12)}
    got = run(spark, texts.items(), 8)
    for i, gone in repeated_lines(texts, 8).items():
        parts = texts[i].split("\n")
        assert got[i] == (len(parts), len(gone), "\n".join(p for k, p in enumerate(parts) if k not in gone)), i


def test_match_grows_both_ways_across_different_copies(spark):
    # The long line's first copy stands among other lines; the run as a whole occurs first in document 2.
    long = " ".join(f"w{k}" for k in range(60))
    texts = {1: f"x\n{long}\ny", 2: f"left side\n{long}\nright side", 3: f"own\nleft side\n{long}\nright side\nown too"}
    got = run(spark, texts.items(), 50)
    assert got[2] == (3, 1, "left side\nright side")
    assert got[3] == (5, 3, "own\nown too")


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(None, long, "p"), (1, long, "q"), (2, None, "r"), (3, "", "s"), (4, "one\nlong", "t"), (5, long, "u"), (5, long, "u"), (6, f"{long}\n\n{long}", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = sorted(dedup_lines(df).select("row.doc_id", "row.removed", "lines", F.col("removed").alias("n"), "text").collect(), key=str)
    by = {(r["doc_id"], r["removed"]): (r["lines"], r["n"], r["text"]) for r in got}
    assert len(got) == 8
    assert by[None, "p"] == (1, 0, long)  # no id comes first
    assert by[1, "q"] == (1, 1, "") and by[5, "u"] == (1, 1, "") and by[6, "v"][1:] == (3, "")
    assert by[2, "r"] == (0, 0, None) and by[3, "s"] == (1, 0, "") and by[4, "t"] == (2, 0, "one\nlong")
    assert dedup_lines(df.limit(0)).count() == 0


def test_very_long_text_and_a_common_run(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    texts = [(i, f"{passage}\nown {i}") for i in range(300)] + [(999, "\n".join(f"line {k}" for k in range(20_000)))]
    got = run(spark, texts, 50)
    assert got[0] == (2, 0, f"{passage}\nown 0") and all(got[i] == (2, 1, f"own {i}") for i in range(1, 300))
    assert got[999][1] == 0

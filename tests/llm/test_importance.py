import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from weftline.llm import importance


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def expected(docs, target, percent=5):
    s, t = np.zeros(10000), np.zeros(10000)
    for _, text in docs:
        np.add.at(s, buckets_of(text), 1)
    for text in target:
        np.add.at(t, buckets_of(text), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        b, h = buckets_of(text), int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    n = percent * len(able) // 100
    return sorted(((*r[:4], k if k <= n else None) for k, r in enumerate(able, 1)), key=str), sorted(((*r[:4], None) for r in rows if r[4] < 20), key=str)


def run(spark, docs, target, **kw):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, weight int, words int")
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.resample(d, spark.createDataFrame([(x,) for x in target], "text string"), **kw).collect()), key=str)


def test_equals_the_plain_formulas(spark):
    r = random.Random(3)
    vocabulary = ["Alpha", "beta", "gänse", "数据", "x" * 63, "y" * 64, "z" * 65, "long" * 400, "A1", "7"]
    docs = [(k, " ".join(r.choice(vocabulary) + r.choice(["", ".", " -- ", "\n", "　"]) for _ in range(r.choice([0, 1, 2, 3, 25, 60])))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, " .,! \x00"), (None, "word " * 30), (12, docs[12][1]), (403, "w" * 3_000_000 + " tail of a very long word " * 3), (404, "many words in one text " * 90_000)]
    target = ["alpha beta gänse " * 5, None, "", "数据 7"]
    able, rest = expected(docs, target)
    assert run(spark, docs, target) == sorted([*able, *rest], key=str)
    able, rest = expected(docs, target, 50)
    assert run(spark, docs, target, percent=50) == sorted([*able, *rest], key=str)


def test_empty_tables(spark):
    assert run(spark, [], ["a"]) == []
    docs = [(k, f"one two three {k} " * 10) for k in range(40)]
    able, rest = expected(docs, [])
    assert run(spark, docs, []) == sorted([*able, *rest], key=str)


@pytest.mark.parametrize("longest", [5, 64, 65, 700, 100_000])
def test_checksums_of_spans(longest):
    r = np.random.default_rng(longest)
    data = r.integers(0, 256, 120_000).astype(np.uint8)
    start = r.integers(0, 100_000 - 1, 400)
    end = np.minimum(start + r.integers(1, longest + 1, 400), len(data))
    assert importance.crc_of_spans(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_pieces_of_any_size_give_the_same_features(monkeypatch):
    texts = ["a b c d e", "", "f", "g h " + "i" * 300 + " j k", "...", "l m"]
    data, offsets = np.frombuffer("".join(t + "\n" for t in texts).encode(), np.uint8), np.cumsum([0] + [len(t) + 1 for t in texts])
    want = sorted((k, zlib.crc32(" ".join(words_of(t)[i : i + n]).encode())) for k, t in enumerate(texts) for n in (1, 2, 3) for i in range(len(words_of(t)) - n + 1))
    for size in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", size)
        assert sorted((int(o), int(c)) for owner, crc in importance.features(data, offsets) for o, c in zip(owner, crc, strict=True)) == want

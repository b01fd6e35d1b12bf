import random
import zlib
from hashlib import sha256

import pytest

from weftline.llm import prefix_trie


def rebuilt(rows):
    """What each conversation is once its family's first member lent its first turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def nodes_of(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {n: [m for m in members if len(m) == len(n) + 1 and m[:-1] == n] for n in members}

    def below(n):
        yield n
        for k in kids[n]:
            yield from below(k)

    out = []
    for n, of in members.items():
        sub = list(below(n))
        ends = sorted(c for c in of if len(convs[c]) == len(n))
        out.append((min(of), len(n), min(members[n[:-1]]) if n else None, len(of), len(kids[n]), sum(not kids[k] for k in sub),
                    sum((len(members[k]) - 1) * len(k[-1][1]) for k in sub if k), sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def sorted_nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize(("panel", "shard"), [(2, 7), (3, 1000), (32, 5)])
def test_equals_the_plain_trie(spark, panel, shard):
    r = random.Random(panel)
    convs = {}
    for c in range(150):
        start = convs[r.randrange(c)][: r.randrange(9)] if c and r.random() < 0.7 else []
        convs[c] = (start + [(r.choice(["user", "assistant"]), r.choice(["a", "bb", "c é", ""])) for _ in range(r.choice([0, 1, 3, 8]))])[:12]
    for c in range(150, 170):  # copies
        convs[c] = convs[c % 7]
    turns = spark.createDataFrame([(c, d, zlib.crc32(repr(t).encode()).to_bytes(16, "big"), len(t[1])) for c, v in convs.items() for d, t in enumerate(v, 1)], "conv_id long, d long, key binary, chars long")
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert sorted_nodes(prefix_trie.trie(turns, ids, panel, shard)) == nodes_of(convs)


def test_rebuilding_ties_nulls_and_clashing_columns(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["x", "yy", None, "é" * 3])) for c in [*range(0, 12), 100, 101, 217, 300] for t in range(r.choice([1, 2, 7, 40]))]
    rows += [(5, None, "system", "first"), (None, 1, "user", "nobody's"), (7, 900, "user", "twice"), (7, 900, "user", "twice")]
    df = spark.createDataFrame([(*x, 1, "k", 2) for x in rows], SCHEMA + ", d int, key string, panel int")
    assert sorted_nodes(prefix_trie.prefix_trie(df)) == nodes_of(rebuilt(rows))
    tied = spark.createDataFrame([(1, 1, "user", "b"), (1, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, 1, "user", "b")], SCHEMA)
    assert {x["n_convs"] for x in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_in_order(tied), lent=1)).collect()} == {2}
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_conversation_and_many_copies(spark):
    rows = [(300, t, "user", f"t{t}") for t in range(400)] + [(c, t, "user", f"s{t}") for c in range(1000, 3000) for t in range(2)]
    got = sorted_nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == nodes_of(rebuilt(rows))

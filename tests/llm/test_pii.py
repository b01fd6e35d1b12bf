import hashlib
import re

import pytest

from weftline.llm import pii

P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(P.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


ODD = ["a@b.co_x@y.z q@r.s.t@u.v", "1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.1", "4111 1111 1111 1111 4111-1111-1111-1111x5555555555554444", "+1 (988) 555-2485 ++12 345 678 9012) +1", "",
       "é😀a@b.cc +4915112345678.", "1" * 3000 + " a" * 10, "x" * 20_000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "..@..", "%@a.b", None, "9" * 39 + ".1.1.1"]


def test_base_spans_equal_plain_search(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = given + [(10**9 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(df)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, got[i]["spans"], want)
        assert set(want.split(",")) <= set(got[i]["spans"].split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in P] == [want.count(k) for k in P]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"words and more, call me +1 (212) 555-{1000 + k} today") for k in range(9)]
    rows += [(20, "please call me 0755/9912-44 today"), (21, "seen 0755/9912-44 again"), (22, "the year 2024-1999 was good")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[20] == "phone:15:27" and got[21] == "phone:5:17" and got[22] == ""
    assert got[0] == "phone:24:41"


def test_patterns_without_support_discover_nothing(spark):
    rows = [(k, f"call me +1 (212) 555-{1000 + k} today") for k in range(4)] + [(k, f"call me {k}0755/9912 today") for k in range(10, 13)]
    got = pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["spans"] for r in got if r["doc_id"] >= 10} == {""}


def test_edges(spark):
    df = spark.createDataFrame([(None, "a@b.cc"), (1, "a@b.cc"), (1, "a@b.cc"), (1, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pii.digest(pii.personal_data(df)).collect())
    assert got == [("1", 0, ""), ("1", 1, "email:0:6"), ("1", 1, "email:0:6"), ("None", 1, "email:0:6")]
    assert pii.personal_data(df.limit(0)).count() == 0


def chain(links):
    """Each context holds eight known phones, what the context before makes known, and one more identifier."""
    names = [f"{chr(97 + k)}line" for k in range(links)]
    rows = []
    for k, name in enumerate(names):
        rows += [f"ring {name} +1 (212) 555-{1000 + j} today" for j in range(8)]
        rows.append(f"ring {name} " + (f"0755/99{k - 1:02d}-44 today" if k else "+1 (212) 555-1008 today"))
        rows.append(f"ring {name} 0755/99{k:02d}-44 today")
    return list(enumerate(rows))


def test_chains_of_contexts_are_followed_to_their_end(spark):
    rows = chain(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_data(df)).collect()}
    assert all(got[i].startswith("phone:") for i, _ in rows)


def test_a_chain_beyond_the_safety_stop_is_an_error(spark):
    scanned = pii.scan(spark.createDataFrame(chain(4), "doc_id long, text string"))
    known = scanned.selectExpr("explode(base) AS s").select("s.context", "s.value", "s.kind")
    free = scanned.selectExpr("explode(free) AS s").select("s.value", "s.context").select("context", "value")
    with pytest.raises(RuntimeError):
        pii.bootstrap(known, free, most_rounds=3)

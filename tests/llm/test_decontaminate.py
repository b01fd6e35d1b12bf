import random

from brute import word_edits

from weftline.llm import decontaminate


def edited(rng, words, n, vocabulary):
    w = list(words)
    for _ in range(n):
        k, how = rng.randrange(len(w)), rng.random()
        if how < 0.5:
            w[k] = rng.choice(vocabulary)
        elif how < 0.75:
            del w[k]
        else:
            w.insert(k, rng.choice(vocabulary))
    return w


def test_recall_and_exact_edits(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ["th", "er", "on", "an", "re", "in", "st"] for b in ["e", "at", "ing", "ion", "ou", "ly", "ed", "he"]]
    items = {k: [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))] for k in range(30)}
    docs, planted = {}, {}
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if i % 2:
            k = rng.randrange(30)
            at = rng.randrange(len(w))
            w[at:at] = edited(rng, items[k], int(len(items[k]) * rng.choice([0, 0, 0.05, 0.1])), vocabulary)
            planted[i] = k
        docs[i] = ", ".join(w).upper() if i % 3 else " ".join(w)
    found = decontaminate.contaminated(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found.collect()}
    truth = {}
    for i, t in docs.items():
        words = t.lower().replace(",", "").split()
        for k, w in items.items():
            if (e := word_edits(w, words)) * 100 <= 20 * len(w):
                truth[i, k] = e
    assert set(got) <= set(truth)
    assert all(got[p] == truth[p] for p in got)
    assert len(got) >= 0.95 * len(truth)
    exact = {p for p, e in truth.items() if e == 0}
    assert exact <= set(got)
    assert all(i in planted for i, _ in got)


def test_edges(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    docs = spark.createDataFrame([(None, f"x {item}", 1), (1, None, 2), (2, "", 3), (3, f"{item}.", 4), (3, f"{item}.", 4), (3, "clean words here", 5), (4, "a " * 200_000 + item, 6), (5, "the quick", 7)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "the quick"), (10, ""), (7, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["item_words"], r["edits"]) for r in decontaminate.contaminated(docs, bench).collect())
    # The item of two words is met wherever they follow each other.
    assert got == [(0, 7, 10, 0), (0, 9, 2, 0), (3, 7, 10, 0), (3, 9, 2, 0), (4, 7, 10, 0), (4, 9, 2, 0), (5, 9, 2, 0)]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_match_whole_runs_only(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ["th", "er", "on", "an"] for b in ["e", "at", "ing"]]
    items = {n * 10 + k: [rng.choice(vocabulary) for _ in range(n)] for n in range(1, 6) for k in range(4)}
    docs = {d: [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 30, 400]))] for d in range(200)}
    for d in range(0, 200, 5):
        at = rng.randrange(len(docs[d]) + 1)
        docs[d][at:at] = items[rng.choice(list(items))]
    truth = {(d, i) for d, t in docs.items() for i, w in items.items() if any(t[k : k + len(w)] == w for k in range(len(t)))}
    found = decontaminate.contaminated(
        spark.createDataFrame([(d, "; ".join(t)) for d, t in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == truth and len(found) == len(truth) and len({i for _, i in truth}) > 15
    assert all(r["edits"] == 0 and r["item_words"] == r["item_id"] // 10 for r in found)


def test_scripts_without_blanks_and_other_separators(spark):
    items = {
        1: "\u6625\u7720\u4e0d\u89c9\u6653\u5904\u5904\u95fb\u557c\u9e1f\u591c\u6765\u98ce\u96e8\u58f0\u82b1\u843d\u77e5\u591a\u5c11",
        2: "\u3044\u308d\u306f\u306b\u307b\u3078\u3068\u3061\u308a\u306c\u308b\u3092",
        3: "\u0e01\u0e32\u0e23\u0e17\u0e14\u0e2a\u0e2d\u0e1a\u0e04\u0e27\u0e32\u0e21\u0e23\u0e39\u0e49",
        4: "\u043e\u0434\u0438\u043d \u0434\u0432\u0430 \u0442\u0440\u0438 \u0447\u0435\u0442\u044b\u0440\u0435 \u043f\u044f\u0442\u044c \u0448\u0435\u0441\u0442\u044c \u0441\u0435\u043c\u044c",
        5: "el ni\u00f1o que vio la luna llena", 6: "\u82b1\u9e1f\u98ce\u6708"}
    docs = {
        11: "\u300c" + items[1][:5] + "\uff0c" + items[1][5:10] + "\u3002" + items[1][10:] + "\u300d\u5b8c",
        12: "\u3042\u3042" + items[2] + "\u3042",
        13: items[3] + " \u0e01",
        14: "\u00ab" + items[4].replace(" ", "\u00a0") + "\u00bb",
        15: "\u201cEl\u00a0ni\u00f1o\u2014que vio la luna llena\u201d",
        16: "x\u82b1\u9e1f\u98ce\u6708x",
        17: items[1].replace("\u9e1f", "\u732b").replace("\u98ce", "\u72ac"),
        18: "\u82b1\u9e1f\u6708\u98ce"}
    found = decontaminate.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found.collect()}
    assert got == {(11, 1): 0, (12, 2): 0, (13, 3): 0, (14, 4): 0, (15, 5): 0, (16, 6): 0, (17, 1): 2}


def test_recall_of_every_length_at_the_most_edits(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ["th", "er", "on", "an", "re", "in", "st"] for b in ["e", "at", "ing", "ion", "ou", "ly"] for c in ["s", "m", "k", "d"]]
    lengths = [6, 7, 9, 10, 12, 16, 17, 23, 24, 34, 50, 52, 74, 100]
    items = {n * 100 + k: [rng.choice(vocabulary) for _ in range(n)] for n in lengths for k in range(20)}
    docs = {}
    for i, w in items.items():
        before, after = ([rng.choice(vocabulary) for _ in range(40)] for _ in range(2))
        most = len(w) // 5
        docs[i, "inside"] = before + edited(rng, w, most, vocabulary) + after
        docs[i, "end"] = before + edited(rng, w, most, vocabulary)
        docs[i, "cut"] = before + w[: len(w) - most]
        docs[i, "first"] = before + [rng.choice(vocabulary), *w[1:]] + after
        docs[i, "second"] = [w[0], rng.choice(vocabulary), *w[2:]] + after
    keys = dict(enumerate(docs))
    found = decontaminate.contaminated(
        spark.createDataFrame([(d, " ".join(docs[k])) for d, k in keys.items()], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    got = {(keys[r["doc_id"]], r["item_id"]): r["edits"] for r in found}
    assert all(e == word_edits(items[i], docs[k]) for (k, i), e in got.items())
    share = {(n, how): sum((k, k[0]) in got for k in docs if k[0] // 100 == n and k[1] == how) / 20 for n in lengths for how in ("inside", "end", "cut", "first", "second")}
    assert all(s == 1 for (_, how), s in share.items() if how in ("first", "second")), share
    assert all(s == 1 for (n, _), s in share.items() if n < 10), share
    assert min(share.values()) >= 0.9 and sum(share.values()) / len(share) >= 0.99, share

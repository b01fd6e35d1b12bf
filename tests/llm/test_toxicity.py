import random

import corpus_pipeline
import pytest

from weftline.llm import toxicity

GROUPS = [["gray", "teal", "blue"]]


def labelled(rng, n, biased):
    """Toxic texts hold an insult; in the biased sample they also name one group more often."""
    words, insults = [f"w{k}" for k in "abcdefghijklmnopqrst"], ["idiotic", "rubbish", "pathetic"]
    rows = []
    for i in range(n):
        w = [rng.choice(words) + rng.choice("xyz") for _ in range(12)]
        toxic = rng.random() < 0.3
        if toxic and rng.random() < 0.8:
            w[rng.randrange(12)] = rng.choice(insults)
        if rng.random() < (0.7 if toxic and biased else 0.1):
            w[rng.randrange(12)] = "gray"
        elif rng.random() < 0.1:
            w[rng.randrange(12)] = rng.choice(["teal", "blue"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def frames(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_penalty_evens_out_identity_terms(spark):
    docs, labels = frames(spark, labelled(random.Random(1), 800, biased=True))
    plain = toxicity.fit(docs, labels, groups=GROUPS, counterfactual=0.0)
    fair = toxicity.fit(docs, labels, groups=GROUPS, counterfactual=10.0)

    def gap(m):
        return abs(m.score("wax way gray waz") - m.score("wax way teal waz"))

    assert gap(fair) < 0.1 * gap(plain)
    rng = random.Random(9)
    neutral = [" ".join(["gray", *(f"w{rng.choice('abcdefghijklmnopqrst')}{rng.choice('xyz')}" for _ in range(11))]) for _ in range(200)]
    false = {m.bias: sum(m.score(t) >= toxicity.THRESHOLD for t in neutral) for m in (plain, fair)}
    assert false[fair.bias] < 0.7 * false[plain.bias]
    assert sum(fair.score(t.replace("gray", "idiotic")) > 0.5 for t in neutral) > 190


def test_held_out_accuracy_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 500
    hit = got[got.toxic == 1].predicted.mean()
    false = got[got.toxic == 0].predicted.mean()
    assert hit >= 0.93 and false <= 0.01


def test_swaps(spark):
    words = toxicity.words_of
    assert toxicity.swapped(words("a teal a"), GROUPS) == [words("a a blue"), words("a a gray")]
    assert toxicity.swapped(words("a"), GROUPS) == []


def test_edges(spark):
    docs = spark.createDataFrame([(None, "idiotic", 1.0), (1, None, 2.0), (2, "", 3.0), (3, "wax " * 100_000, 4.0), (3, "wax", 4.0)], "doc_id long, text string, score double")
    _, labels = frames(spark, labelled(random.Random(2), 50, biased=False))
    empty = labels.limit(0)
    got = toxicity.classify(docs, empty).collect()
    assert [r["score"] for r in got] == [0.5] * 5 and {r["predicted"] for r in got} == {1}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.classify(docs, one).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] is None)["held_out"] is False


@pytest.mark.parametrize("words", [["idiotic", "b"], ["b", "idiotic"]])
def test_column_and_model_agree(spark, words):
    m = toxicity.Model(-1.0, {"idiotic": 2.0, "idio*": 0.25, "b": 0.1})
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    assert toxicity.with_score(df, m).first()["score"] == pytest.approx(m.score("b idiotic"), abs=1e-15)


def test_single_neutral_and_toxic_texts(spark):
    docs, labels = frames(spark, labelled(random.Random(1), 800, biased=True))
    plain = toxicity.fit(docs, labels, groups=GROUPS, counterfactual=0.0)
    fair = toxicity.fit(docs, labels, groups=GROUPS, counterfactual=10.0)
    assert fair.score("wax way gray waz") < toxicity.THRESHOLD < plain.score("wax way gray waz")
    assert fair.score("wax idiotic way") > 0.5 > fair.score("wax way")


def test_passages_do_not_fade_in_long_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    given = toxicity.with_score(docs, model).join(labels, "doc_id").where(toxicity.held_out(docs["doc_id"])).select("text", "toxic", "score").toPandas()
    toxic, clean = given[given.toxic == 1], given[given.toxic == 0]
    assert (clean.score >= toxicity.THRESHOLD).mean() <= 0.01
    # The same passage amid clean text, short and long.
    calm = [w for t in clean[clean.score < 0.01].text for w in (t or "").split() if "!" not in w and not w.isupper()][:5000]
    passage = "disgusting idiot stupid worthless pathetic".split()
    scores = [model.score(" ".join([*calm[: n // 2], *passage, *calm[n // 2 : n]])) for n in (250, 5000)]
    assert min(scores) >= toxicity.THRESHOLD


@pytest.mark.parametrize("label", [None, 1])
def test_pipeline_without_both_labels_rejects_nothing(spark, tmp_path, label):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)] + [(None, None)], "doc_id long, text string")
    spark.createDataFrame([(k, label) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).count() == 21

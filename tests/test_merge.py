"""Merge of children: partition, owner and values against a sequential replay."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.operators import merge

SCHEMA = "slug string, ord bigint, id string, name string, context string, max_output string, modality string, rate_limit string"


def replay(rows):
    """Fold rows one by one: a row joins the groups of its keys, the oldest group absorbs the others."""
    groups, where = [], {}
    for i, (a, b, values) in enumerate(rows):
        hit = sorted({where[k] for k in (("a", a), ("b", b)) if k in where})
        if not hit:
            groups.append({"first": i, "values": dict(values), "keys": set(), "n": 0})
            g = len(groups) - 1
        else:
            g = hit[0]
            for other in hit[1:]:
                for f, v in groups[other]["values"].items():
                    groups[g]["values"][f] = groups[g]["values"].get(f) or v
                groups[g]["keys"] |= groups[other]["keys"]
                groups[g]["n"] += groups[other]["n"]
                groups[other]["dead"] = True
            for f, v in values.items():
                groups[g]["values"][f] = groups[g]["values"].get(f) or v
        groups[g]["n"] += 1
        groups[g]["keys"] |= {("a", a), ("b", b)}
        for k in groups[g]["keys"]:
            where[k] = g
    return {g["first"]: (g["n"], tuple(g["values"].get(f) for f in ("context", "rate_limit"))) for g in groups if not g.get("dead")}


def merged(spark, cases, **options):
    rows = []
    for slug, members in cases.items():
        for i, (a, b, values) in enumerate(members):
            rows.append((slug, i, f"b{b}", f"a{a}", values.get("context"), None, None, values.get("rate_limit")))
    out = {}
    for r in merge.merge_children(spark.createDataFrame(rows, SCHEMA), **options).collect():
        out.setdefault(r.slug, {})[r.ord] = (r.members, (r.context, r.rate_limit))
    return out


def test_bridge_keeps_fold_order(spark):
    rows = [(3, 1, {}), (2, 0, {"context": "1K"}), (0, 1, {"context": "2K"}), (2, 1, {"context": "3K"})]
    got = merged(spark, {"x": rows})["x"]
    assert got == {0: (4, ("2K", None))}


@pytest.mark.parametrize("seed", [7, 8])
def test_random_groups_equal_replay(spark, seed):
    rnd = random.Random(seed)
    cases = {}
    for n in range(400):
        size, keys = rnd.randint(2, 12), rnd.randint(2, 6)
        members = []
        for i in range(size):
            values = {f: f"{i}{u}" for f, u in (("context", "K"), ("rate_limit", " RPM")) if rnd.random() < 0.4}
            members.append((rnd.randrange(keys), rnd.randrange(keys), values))
        cases[f"s{n}"] = members
    got = merged(spark, cases)
    wrong = {s: (got.get(s), replay(m), m) for s, m in cases.items() if got.get(s) != replay(m)}
    assert not wrong, (len(wrong), next(iter(wrong.items())))


@pytest.mark.parametrize("order", ["shuffled", "forwards", "backwards"])
def test_long_chain_equals_replay(spark, order, monkeypatch):
    """Links of a chain in any order: few rounds, each of logarithmically many steps."""
    rnd = random.Random(3)
    n = 2000
    chain = [(i, i, {"context": f"{i}K"} if i % 7 == 3 else {}) for i in range(n)]
    links = [(i, i + 1, {"rate_limit": f"{i} RPM"} if i % 11 == 5 else {}) for i in range(n - 1)]
    links = {"shuffled": rnd.sample(links, n - 1), "forwards": links, "backwards": links[::-1]}[order]
    rounds, levels = [], merge._levels
    monkeypatch.setattr(merge, "_levels", lambda claims: rounds.append(len(out := levels(claims))) or out)
    rows = chain + links
    assert merged(spark, {"c": rows})["c"] == replay(rows)
    assert len(rounds) <= 8 and max(rounds) <= 13, rounds


def test_young_key_that_joins_older_ones_in_turn(spark):
    rows = [(i, i, {"context": f"{i}K"} if i % 3 else {}) for i in range(40)] + [(100, i, {}) for i in reversed(range(40))] + [(i, 101, {"rate_limit": f"{i} RPM"}) for i in range(40)]
    assert merged(spark, {"c": rows})["c"] == replay(rows)


def test_hot_key_is_one_row(spark):
    """A third of all rows share one key pair; they collapse before anything meets."""
    rows = [(0, 0, {"context": "1K"} if i == 500 else {}) for i in range(1000)] + [(i, i, {}) for i in range(1, 2000)]
    got = merged(spark, {"h": rows})["h"]
    assert got[0] == (1000, ("1K", None)) and len(got) == 2000


PARTIALS = (
    "source string, source_url string, prio int, pos bigint, slug string, name string, category string, country string, flag string, url string, "
    "base_url string, description string, source_updated_at string, more_models string, synced_at string"
)


def test_two_sources_fixture(spark):
    p = spark.createDataFrame([
        ("A", "https://a.example", 0, 0, "groq", "Groq", "provider_api", None, None, "https://console.groq.com/keys", None, "", None, None, "2026-01-01T00:00:00Z"),
        ("B", "https://b.example", 1, 0, "groq", "Groq Cloud", None, "US", "", None, None, "See [docs](https://x) for 30 RPM", None, "+1 more", "2026-01-03T00:00:00Z"),
        ("B", "https://b.example", 1, 1, "together-ai", "Together AI", None, None, None, None, None, None, None, "+99 more models", "2026-01-03T00:00:00Z"),
        ("B", "https://b.example", 1, 2, "", "No slug", None, None, None, None, None, None, None, None, "2026-01-03T00:00:00Z"),
    ], PARTIALS)
    m = spark.createDataFrame([
        ("groq", 0, "llama-3.3-70b-versatile", "Llama 3.3 70B Versatile", "128K", "32K", "Text", None),
        ("groq", 1, "mixtral-8x7b", "Mixtral 8x7B", "32K", None, "Text", None),
        ("groq", 100, "llama-3.3-70b-versatile", "Llama 3.3 70B", None, None, "", "200 RPM, 100K TPM"),
        ("groq", 101, "whisper-large", "Whisper", "131K", "8K", "Audio", None),
        ("together-ai", 102, "together-llama-3", "Llama 3", "8K", None, "Text", "60 RPM"),
    ], SCHEMA)
    models = merge.merge_children(m)
    got = {r.slug: r for r in merge.merge_entities(p, models, "2026-01-02T00:00:00Z").collect()}
    assert set(got) == {"groq", "together-ai"}
    groq = got["groq"]
    assert (groq.name, groq.category, groq.country, groq.flag) == ("Groq", "provider_api", "US", None)
    assert [s.name for s in groq.sources] == ["A", "B"] and groq.synced_at == "2026-01-03T00:00:00Z"
    assert groq.description == "See docs for 30 RPM" and groq.free_limit == "30 RPM/IP"
    assert groq.model_count == 3 and groq.max_context == "128K" and groq.modalities == ["text", "audio"]
    assert groq.domain == "groq.com" and groq.logo == "/logos/groq.png" and groq.more_models is None
    assert got["together-ai"].more_models == "+99 more models" and got["together-ai"].logo is None
    rows = {r.id: r for r in models.where("slug = 'groq'").collect()}
    shared = rows["llama-3.3-70b-versatile"]
    assert (shared.context, shared.rate_limit, shared.members) == ("128K", "200 RPM, 100K TPM", 2)
    assert rows["whisper-large"].context is None and rows["whisper-large"].max_output is None


def test_authoritative_source(spark):
    m = spark.createDataFrame([Row(slug="a", id="1"), Row(slug="a", id="2"), Row(slug="b", id="2")])
    live = spark.createDataFrame([Row(slug="a", id="1"), Row(slug="c", id="9")])
    got = sorted(map(tuple, merge.keep_authoritative(m, live).collect()))
    assert got == [("a", "1"), ("b", "2")]
    assert merge.keep_authoritative(m, live.where(F.lit(False))).count() == 3


def test_rollup_counts_each_spelling_once(spark):
    rows = [("s", k, m, c) for k, (m, c) in enumerate([("Text", "8K"), ("Audio", "8192"), ("Text", "8K"), (None, None), ("Text + Vision", "4K"), ("Text", "8k")] * 3)]
    models = spark.createDataFrame(rows + [("t", 0, None, None)], "slug string, ord long, modality string, context string")
    got = merge.child_rollup(models)
    assert {r.slug: (r.model_count, r.modalities) for r in got.collect()} == {"s": (18, ["text", "vision", "audio"]), "t": (1, [])}
    direct = models.groupBy("slug").agg(merge.max_context(F.col("context"), F.col("ord")).alias("max_context"))
    assert sorted(got.select("slug", "max_context").collect()) == sorted(direct.collect())
    assert "Aggregate [slug" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Aggregate") == 2


def test_pairs_that_nothing_bridges_are_not_joined(spark):
    """Names repeat, ids do not: no pair waits for a count of its keys."""
    cols = "slug string, ord long, id string, name string, context string, max_output string, modality string, rate_limit string"
    rows = [("s", k, f"id-{k}", f"name {k % 3}", f"{k}K" if k > 2 else None, None, None, None) for k in range(9)]
    nodes, edges = merge._nodes(merge.key_pairs(spark.createDataFrame(rows, cols), "slug", "ord"), "slug")
    assert edges is None and nodes.count() == 3 and "Join" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    got = merge.merge_children(spark.createDataFrame([*rows, (None, 0, "id-0", "name 0", None, None, None, None)], cols))
    assert sorted((r.slug, r.id, r.ord, r.members, r.context) for r in got.collect()) == [("s", f"id-{k}", k, 3, f"{k + 3}K") for k in range(3)]


def test_rows_whose_keys_occur_once_are_written_once(spark, monkeypatch):
    """No exchange, pair or node for a row that nothing else can meet: tables that are written hold hardly more rows than come in."""
    written, cut = [], merge.cut_lineage
    monkeypatch.setattr(merge, "cut_lineage", lambda df: written.append((out := cut(df)).count()) or out)
    rows = [(i, i, {"context": f"{i}K"}) for i in range(1000)] + [(5, 2000, {}), (2001, 5, {"rate_limit": "1 RPM"}), (2001, 2000, {})]
    assert merged(spark, {"s": rows})["s"] == replay(rows)
    assert sum(written) <= 1100


@pytest.mark.parametrize("places", [1, 8, 1 << 16])
def test_keys_that_share_a_place_count_as_repeated(spark, monkeypatch, places):
    """A bitmap that is too small makes more nodes, and the same children."""
    monkeypatch.setattr(merge, "PLACES", places)
    rnd = random.Random(places)
    cases = {f"s{n}": [(rnd.randrange(40), rnd.randrange(40), {"context": f"{i}K"} if i % 3 else {}) for i in range(30)] for n in range(20)}
    cases["once"] = [(i, i, {"rate_limit": f"{i} RPM"}) for i in range(30)] + [(7, 7, {"context": "9K"}), (100, 8, {})]
    assert merged(spark, cases) == {s: replay(m) for s, m in cases.items()}


def test_rows_of_an_entity_are_sorted_by_checksums(spark):
    """Keys of one entity begin alike, so that a sort by them compares whole rows; the aggregates that sort lead with a checksum."""
    cols = "slug string, ord long, id string, name string, context string, max_output string, modality string, rate_limit string"
    pairs = merge.key_pairs(spark.createDataFrame([("s", 1, "i", "n", "1K", None, None, None)], cols), "slug", "ord")
    nodes, _ = merge._nodes(pairs, "slug")
    for df in (pairs, nodes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate(key=[_groupingexpression#" in plan and "SortAggregate(key=[slug#" not in plan and "_h" not in df.columns


def test_any_facet_is_one_of_the_facets(spark):
    from weftline.functions import facets

    rows = [(m,) for m in ["Text", "Audio + video", "none", "", None, "Embeddings", "code", "encoder", "RERANK"]]
    df = spark.createDataFrame(rows, "m string")
    got = df.select(facets.has_any_facet(F.col("m")).alias("some"), F.size(facets.facets_of(F.col("m"))).alias("n")).collect()
    assert [r.some for r in got] == [r.n > 0 for r in got] and {r.some for r in got} == {True, False}

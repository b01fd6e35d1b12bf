"""Shape guard, floors, snapshot diff and quarantine on the documented scenarios."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import changelog, diff, gates, quarantine, shape

MODEL = "slug string, ord bigint, id string, name string, context string, max_output string, modality string, rate_limit string"
PROVIDER = "slug string, name string, url string, base_url string, description string"


def models(spark, rows):
    return spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], MODEL)


def provider(spark, n=1, url="https://a.example"):
    return spark.createDataFrame([(f"p{i}", f"P{i}", url, None, None) for i in range(n)], PROVIDER)


def found(spark, m, p=None):
    return {(r.rule, r.field): r.severity for r in shape.shape_issues(p if p is not None else provider(spark), m, []).collect()}


def test_shape_incident_and_small_sample(spark):
    scores = ["81", "55", "52", "49", "40", "45", "47", "71"]
    rows = [(f"m{i}", f"Model {i}", scores[i % 8], "256K", "text", "30 RPM") for i in range(30)]
    assert found(spark, models(spark, rows))[("context-shape", "context")] == "fatal"
    assert found(spark, models(spark, rows[:5]))[("context-shape", "context")] == "warn"
    samples = shape.shape_samples(models(spark, rows), []).where("rule = 'context-shape'").first().samples
    assert samples == ["81", "55", "52"]


def test_shape_healthy_has_no_issue(spark):
    contexts = ["128K", "1M", "Up to 10M", "Varies", "8192", None]
    outs = ["8K", "Shared w/ context", "Configurable", None]
    rates = ["30 RPM", "Community-powered, no hard cap", None, "10,000 neurons/day"]
    rows = [(f"m{i}", f"Model {i}", contexts[i % 6], outs[i % 4], "Text + Vision", rates[i % 4]) for i in range(90)]
    assert found(spark, models(spark, rows)) == {}


def test_shape_rules(spark):
    def one(**kw):
        base = {"id": "m{i}", "name": "Model {i}", "context": "128K", "max_output": "8K", "modality": "text", "rate_limit": "30 RPM"}
        return lambda i, bad: tuple((kw.get(k, v) if bad else v) and (kw.get(k, v) if bad else v).format(i=i) for k, v in base.items())

    def run(kw, bad, total=22):
        make = one(**kw)
        return found(spark, models(spark, [make(i, i < bad) for i in range(total)]))

    assert run({"name": "<span>Model {i}</span>"}, 12)[("leftover-markup-entity", "name")] == "fatal"
    assert run({"name": "Ren&#39;Py Chat"}, 1, 2)[("leftover-markup-entity", "name")] == "warn"
    assert run({"id": "same"}, 2)[("duplicate-id-in-provider", "id")] == "warn"
    assert run({"modality": "81"}, 15)[("modality-unrecognised", "modality")] == "fatal"
    assert run({"context": "30 RPM"}, 22)[("column-swap-identical", "context/rateLimit")] == "fatal"
    assert run({"max_output": None}, 25, 25)[("all-null-collapse", "maxOutput")] == "warn"
    assert run({"id": " "}, 22)[("empty-id", "id")] == "fatal"
    ok = models(spark, [one()(i, False) for i in range(3)])
    assert found(spark, ok, provider(spark, 22, "/relative/path"))[("invalid-url", "url")] == "fatal"


@pytest.mark.parametrize("providers,models_,ok", [(13, 85, True), (12, 85, False), (13, 84, False), (50, 300, True)])
def test_floor(spark, providers, models_, ok):
    counts = spark.createDataFrame([("s", providers, models_)], "source string, providers bigint, models bigint")
    base = spark.createDataFrame([("s", 27, 170)], "source string, providers bigint, models bigint")
    assert gates.source_floor(counts, base).first().ok is ok


def test_baselines_fall_back_and_roll(spark):
    stored = spark.createDataFrame([("a", 10, 100, "x"), ("b", None, 5, "x")], gates.BASELINE_SCHEMA)
    fallback = spark.createDataFrame([("a", 1, 1), ("b", 13, 149)], "source string, providers bigint, models bigint")
    base = gates.effective_baselines(stored, fallback)
    assert sorted(map(tuple, base.collect())) == [("a", 10, 100), ("b", 13, 149)]
    counts = spark.createDataFrame([("a", 12, 400), ("new", 3, 7)], "source string, providers bigint, models bigint")
    got = {r.source: (r.providers, r.models) for r in gates.roll_baselines(counts, base, "now").collect()}
    assert got == {"a": (12, 150), "new": (3, 7)}


# --- snapshot diff ---------------------------------------------------------------------------

P = "slug string, name string, description string, base_url string, free_limit string, max_context string"
M = "slug string, pos bigint, id string, name string, context string, max_output string, modality string, rate_limit string"


def snap(spark, entities, context=lambda s, i: "128K", description=lambda s: "text"):
    p = [(s, s, description(s), None, None, None) for s in entities]
    m = [(s, i, x, x, context(s, i), None, "text", None) for s, ids in entities.items() for i, x in enumerate(ids)]
    return diff.Snapshot(spark.createDataFrame(p, P), spark.createDataFrame(m, M))


def ids(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


def run_diff(spark, prev, nxt, t=diff.Thresholds()):
    rows = diff.diff_report(snap(spark, prev), snap(spark, nxt), t).collect()
    return sorted((r.rule, r.slug, r.severity) for r in rows)


BASE = {"a": ids("a", 5), "b": ids("b", 3), "c": ids("c", 4)}
DIFFS = {
    "one id swapped": (BASE, {**BASE, "a": ids("a", 4) + ["new"]}, []),
    "provider gone": (BASE, {"a": BASE["a"], "c": BASE["c"]}, [("disappeared", "b", "error"), ("total-drop", None, "error")]),
    "shrunk": ({"a": ids("a", 10), "b": ids("b", 30)}, {"a": ids("a", 5), "b": ids("b", 30)}, [("shrunk", "a", "error")]),
    "no previous": ({}, BASE, [("no-previous", None, "warn")]),
    "all ids replaced": ({"a": ids("a", 5)}, {"a": ids("z", 5)}, [("churned", "a", "error")]),
    "gone but grew": (BASE, {"a": ids("a", 9), "b2": ids("n", 5), "c": BASE["c"]}, [("disappeared", "b", "warn")]),
    "two gone": (BASE, {"a": ids("a", 30), "x": ["1"], "y": ["2"]}, [("disappeared", "b", "error"), ("disappeared", "c", "error")]),
    "churn but grew": ({"a": ids("a", 5)}, {"a": ids("z", 6)}, [("churned", "a", "warn")]),
}


@pytest.mark.parametrize("name", DIFFS)
def test_diff(spark, name):
    prev, nxt, want = DIFFS[name]
    assert run_diff(spark, prev, nxt) == sorted(want, key=lambda x: (x[0], str(x[1])))


@pytest.mark.parametrize("changed,level", [(0, None), (2, None), (6, "warn"), (30, "error")])
def test_field_churn(spark, changed, level):
    e = {"a": ids("a", 30)}
    new = snap(spark, e, context=lambda s, i: f"{40 + i}" if i < changed else "128K")
    rows = {(r.level, r.field): r for r in diff.field_churn(snap(spark, e), new, diff.Thresholds()).collect()}
    got = rows[("model", "context")]
    assert (got.eligible, got.changed, got.severity) == (30, changed, level)


def test_value_appearing_is_no_change(spark):
    e = {"a": ids("a", 25)}
    rows = diff.field_churn(snap(spark, e, context=lambda s, i: None), snap(spark, e), diff.Thresholds())
    assert rows.where("field = 'context'").first().eligible == 0


def test_provider_level_churn(spark):
    e = {f"p{i}": ["x"] for i in range(12)}
    rows = diff.field_churn(snap(spark, e), snap(spark, e, description=lambda s: "new"), diff.Thresholds())
    assert rows.where("field = 'description'").first().severity == "error"


# --- quarantine ------------------------------------------------------------------------------

A = "slug string, kind string, magnitude bigint, detail string"


def step(spark, state, anomalies, day, total=24):
    rows = quarantine.reconcile(state, spark.createDataFrame(anomalies, A), F.lit(total), f"2026-01-{day:02d}T00:00:00Z")
    rows = [r.asDict() for r in rows.collect()]
    out = spark.createDataFrame(
        [tuple(r[c] for c in quarantine.STATE_COLUMNS) for r in rows if r["outcome"] in ("held", "kept")], quarantine.STATE_SCHEMA
    )
    return out, {r["slug"]: (r["outcome"], r["streak"]) for r in rows}, (rows[0]["fatal"] if rows else None)


def empty(spark):
    return spark.createDataFrame([], quarantine.STATE_SCHEMA)


def test_confirmed_after_three_runs(spark):
    s, state = [("a", "shrunk", 13, "39 -> 13")], empty(spark)
    for day, want in ((1, ("held", 1)), (2, ("held", 2)), (3, ("accepted", 3))):
        state, got, _ = step(spark, state, s, day)
        assert got == {"a": want}
    assert state.count() == 0


def test_cleared_when_back(spark):
    gone = [("a", "disappeared", 0, "")]
    state, _, _ = step(spark, empty(spark), gone, 1)
    state, got, _ = step(spark, state, gone, 2)
    assert got == {"a": ("held", 2)}
    state, got, _ = step(spark, state, [], 3)
    assert got["a"][0] == "cleared" and state.count() == 0


def test_magnitude_tolerance(spark):
    state, _, _ = step(spark, empty(spark), [("a", "shrunk", 27, "")], 1)
    state, got, _ = step(spark, state, [("a", "shrunk", 28, "")], 2)
    assert got == {"a": ("held", 2)}
    state, got, _ = step(spark, state, [("a", "shrunk", 5, "")], 3)
    assert got == {"a": ("held", 1)} and state.first().first_seen == "2026-01-01T00:00:00Z"


def test_mass_anomaly_stops(spark):
    state, got, fatal = step(spark, empty(spark), [(f"p{i}", "disappeared", 0, "") for i in range(12)], 1)
    assert fatal == "mass-anomaly" and state.count() == 0 and set(got.values()) == {("stopped", 1)}


def test_flapping_is_stale_after_a_week(spark):
    state, _, _ = step(spark, empty(spark), [("a", "shrunk", 10, "")], 1)
    state, got, _ = step(spark, state, [("a", "shrunk", 90, "")], 4)
    assert got == {"a": ("held", 1)}
    kept, got, fatal = step(spark, state, [("a", "shrunk", 20, "")], 10)
    assert fatal == "stale-quarantine" and got["a"][0] == "kept" and kept.count() == 1


def test_one_anomaly_per_slug(spark):
    prev, nxt = {"a": ids("a", 20), "b": ids("b", 3)}, {"a": ids("z", 4), "b": ids("b", 3)}
    stats = diff.provider_stats(snap(spark, prev), snap(spark, nxt))
    rows = quarantine.anomalies_from_stats(stats, diff.Thresholds()).collect()
    assert [(r.slug, r.kind, r.magnitude) for r in rows] == [("a", "shrunk", 4)]


def test_carry_forward(spark):
    prev = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "slug string, v string")
    nxt = spark.createDataFrame([("a", "new"), ("b", "new")], "slug string, v string")
    held = spark.createDataFrame([("a",), ("c",), ("zz",)], "slug string")
    assert sorted(map(tuple, quarantine.carry_forward(nxt, prev, held).collect())) == [("a", "old"), ("b", "new"), ("c", "old")]


def test_changelog_upsert_replaces_date(spark):
    log = spark.createDataFrame([("2026-01-01", "model_added", "a", "A", "1", "m"), ("2026-01-02", "model_added", "a", "A", "2", "n")], changelog.CHANGE_SCHEMA)
    today = spark.createDataFrame([("model_removed", "a", "A", "3", "o")], "kind string, slug string, provider string, id string, name string")
    got = sorted((r.date, r.kind) for r in changelog.upsert(log, today, "2026-01-02").collect())
    assert got == [("2026-01-01", "model_added"), ("2026-01-02", "model_removed")]
    assert changelog.upsert(log, today.where("false"), "2026-01-02").count() == 2
    assert changelog.upsert(log, today, "2026-01-03", n=1).count() == 1

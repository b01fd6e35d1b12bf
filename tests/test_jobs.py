"""Enrichment, near duplicates, limiter, streams and whole runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import duplicates, enrich, gates, limiter, listing, parts, quarantine, recommend, search
from weftline.plans import sync
from weftline.sources import snapshots
from weftline.sources.registry import SourceSpec
from weftline.streaming import limiter as stream_limiter
from weftline.streaming import runs

LOOKUP = "lookup map<string, struct<models: map<string, struct<limit: struct<context: bigint, output: bigint>>>>>"
MODEL = "slug string, id string, name string, context string, max_output string"


def test_enrich_fixture(spark):
    def lim(c, o):
        return {"limit": {"context": c, "output": o}}

    raw = {
        "groq": {"models": {"llama-3.3-70b-versatile": lim(131072, 32768), "llama3-8b-8192": lim(8192, 8192), "whisper-large-v3": lim(448000, 448000)}},
        "openrouter": {"models": {"llama3-8b-8192": lim(9999, 8192)}},
        "mistral": {"models": {"mistral-small-latest": lim(32768, 4096)}},
    }
    index = enrich.build_unique_index(enrich.flatten_lookup(spark.createDataFrame([(raw,)], LOOKUP)))
    models = spark.createDataFrame([
        ("a", "llama-3.3-70b-versatile", "Llama", None, None), ("a", "llama3-8b-8192", "Llama 8B", None, None),
        ("b", "whisper-large-v3", "W", "448K", "448K"), ("c", "unknown", "U", None, None),
    ], MODEL)
    got = {r.id: (r.context, r.max_output, r.fills) for r in enrich.enrich_models(models, index).collect()}
    assert got["llama-3.3-70b-versatile"] == ("131072" if 131072 % 1024 else "128K", "32K", 2)
    assert got["llama3-8b-8192"] == (None, "8K", 1)
    assert got["whisper-large-v3"] == ("448K", "448K", 0) and got["unknown"] == (None, None, 0)


def brute(names, k):
    out = {}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            a, b = names[i], names[j]
            if a == b or (len(a) >= k and len(b) >= k and (a in b or b in a)):
                key = (a, b) if len(a) >= len(b) else (b, a)
                out[key] = out.get(key, 0) + 1
    return out


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    groups = {g: ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 14))) for _ in range(25)] for g in range(30)}
    groups[0] = ["abababab" * 2] * 20 + ["abababab"] * 10 + ["b" * 30] * 5
    rows = [(str(g), n) for g, names in groups.items() for n in names]
    df = spark.createDataFrame(rows, "slug string, name string")
    got = {}
    for r in duplicates.near_duplicates(df, F.col("name"), ["slug"], 4).collect():
        got[int(r.slug), r.key] = (r.equal, r.containing, r.pairs, r.examples)
    want = {}
    for g, names in groups.items():
        for (outer, inner), n in brute(names, 4).items():
            equal, others, pairs = want.get((g, inner), (0, [], 0))
            want[g, inner] = (n, others, pairs) if outer == inner else (equal, [*others, outer], pairs + n)
    assert got == {k: (e, len(o), n, ",".join(sorted(o)[:3])) for k, (e, o, n) in want.items()}


EVENT = "k string, id bigint, ts timestamp"


def events(spark, rows):
    base = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(k, i, base + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(rows)], EVENT)


def brute_limit(rows, window, limit):
    kept, out = {}, {}
    for i, (k, s) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        mine = [t for t in kept.get(k, []) if t > s - window]
        out[i] = len(mine) < limit
        kept[k] = mine + [s] if out[i] else mine
    return out


def some_events():
    rnd = random.Random(11)
    return [(rnd.choice("aaab"), rnd.randint(0, 3000)) for _ in range(1500)]


def test_limiter_batch(spark):
    rows = some_events()
    for window, limit in ((60, 5), (20, 1), (300, 7)):
        got = {r.id: r.accepted for r in limiter.sliding_limit(events(spark, rows), "k", "ts", "id", window, limit).collect()}
        assert got == brute_limit(rows, window, limit)


@pytest.mark.parametrize(("window", "limit", "step"), [(60, 5, 4), (60, 5, 0.2), (600, 30, 1), (7, 1, 3)])
def test_limiter_splits_a_hot_key(spark, window, limit, step, monkeypatch):
    """All events are of one key that is never idle: many chunks, decided at once, as if one after the other."""
    rnd = random.Random(window)
    rows, at = [], 0.0
    for _ in range(3000):
        at += rnd.expovariate(1 / step) if rnd.random() < 0.98 else 2 * step
        rows.append(("hot", int(at)))
    rounds, turn = [], limiter._in_turn
    monkeypatch.setattr(limiter, "_in_turn", lambda *a: rounds.append(a[-1]) or turn(*a))
    df = events(spark, rows)
    got = {r.id: r.accepted for r in limiter.sliding_limit(df, "k", "ts", "id", window, limit, 200).collect()}
    assert got == brute_limit(rows, window, limit)
    timed = df.select("k", "id", limiter.micros(df, "ts").alias("us"))
    assert limiter._chunks(timed, "k", "id", window * 1_000_000, limit, 200).select("run", "chunk").distinct().count() >= 8
    assert rounds.count(True) <= 17


def test_limiter_edges(spark):
    rows = [(None, 1), (None, 2), ("a", 1), ("a", 1), ("a", 1), ("b", 5)]
    df = events(spark, rows).unionByName(events(spark, [("a", 1)]).withColumn("id", F.lit(99).cast("bigint")).withColumn("ts", F.lit(None).cast("timestamp")))
    got = {r.id: r.accepted for r in limiter.sliding_limit(df, "k", "ts", "id", 60, 1).collect()}
    assert got == brute_limit(rows, 60, 1)
    assert limiter.sliding_limit(events(spark, rows).limit(0), "k", "ts", "id").collect() == []


def test_limiter_stream(spark, tmp_path):
    rows = sorted(some_events(), key=lambda r: r[1])
    late = {300, 450}  # arrive in the second file, after newer ones of their key
    df = events(spark, rows)
    for n, (lo, hi) in enumerate([(0, 500), (500, 900), (900, 1500)]):
        here = (F.col("id") >= lo) & (F.col("id") < hi) & ~F.col("id").isin(*late)
        df.where(here | F.col("id").isin(*late) if n == 1 else here).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = stream_limiter.sliding_limit_stream(stream, "k", "ts", "id", 60, 5)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    q.trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r.late} == late
    on_time = {i: row for i, row in enumerate(rows) if i not in late}
    want = brute_limit([on_time.get(i, ("nobody", row[1])) for i, row in enumerate(rows)], 60, 5)
    assert {i: r.accepted for i, r in got.items() if i not in late} == {i: want[i] for i in on_time}


def test_limit_step_busy_key_late_rows_and_idle_state(spark, tmp_path):
    """A busy key over several batches in small chunks, late rows of a key and of a forgotten key, a batch run twice."""
    rnd = random.Random(5)
    rows, at = [], 0.0
    for _ in range(900):
        at += rnd.expovariate(1 / 3)
        rows.append((rnd.choice(["hot", "hot", "hot", "b"]), int(at)))
    rows += [("old", 5), (None, int(at) + 1), (None, int(at) + 2), ("new", int(at) + 4000)]
    batches = [rows[:300] + rows[900:901], rows[300:600], rows[600:900] + rows[901:903], rows[903:], [("hot", 10), ("old", 20), ("new", int(at) + 4001)]]
    root, step = str(tmp_path / "r"), stream_limiter.limit_step(str(tmp_path / "r"), "k", "ts", "id", 60, 5, 3600, 40)
    want, late, kept, seen, clock, first = {}, set(), {}, {}, None, 0
    for n, batch in enumerate(batches):
        base = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
        df = spark.createDataFrame([(k, first + i, base + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(batch)], EVENT)
        for _ in range(2 if n == 1 else 1):
            step(df, n)
        fresh = {}
        for i, (k, s) in sorted(enumerate(batch), key=lambda x: (x[1][1], x[0])):
            if s < seen.get(k, s) or (clock is not None and s < clock - 3600):
                late.add(first + i)
                continue
            mine = [t for t in kept.get(k, []) if t > s - 60]
            want[first + i] = len(mine) < 5
            kept[k], fresh[k] = (mine + [s] if want[first + i] else mine), s
        seen |= {k: max(s, seen.get(k, s)) for k, s in fresh.items()}
        clock = max([*fresh.values(), *([] if clock is None else [clock])])
        first += len(batch)
    out = spark.read.option("basePath", f"{root}/decisions").parquet(f"{root}/decisions").collect()
    assert len(out) == first and {r.id for r in out if r.late} == late and len(late) == 2
    assert {r.id: r.accepted for r in out if not r.late} == want
    state = snapshots.read_latest(spark, root, "state", "k string, log array<bigint>, seen bigint").collect()
    assert {r.k for r in state} == {"new"}  # all others were idle for an hour


def test_quarantine_stream(spark, tmp_path):
    days = [[("a", "shrunk", 13), ("b", "disappeared", 0)], [("a", "shrunk", 13)], [("a", "shrunk", 14)], []]
    root = str(tmp_path / "q")
    step = runs.quarantine_step(root)
    for n, day in enumerate(days):
        at = f"2026-01-0{n + 1}T00:00:00Z"
        rows = [(at, 24, s, k, m, "") for s, k, m in day] + [(at, 24, None, None, None, None)]
        spark.createDataFrame(rows, runs.ANOMALY_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
        runs.start(runs.landed(spark, str(tmp_path / "landed"), runs.ANOMALY_SCHEMA), step, str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(f"{root}/outcomes")
    got = {(int(r.run_id), r.slug): (r.outcome, r.streak) for r in out.collect()}
    assert got == {(0, "a"): ("held", 1), (0, "b"): ("held", 1), (1, "a"): ("held", 2), (1, "b"): ("cleared", 1), (2, "a"): ("accepted", 3)}
    assert snapshots.read_latest(spark, root, "state", quarantine.STATE_SCHEMA).count() == 0


def test_search_by_index_equals_search_of_all_rows(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.choice([1, 1, 2, 3, 5])))
    p = [(f"s{k}", rnd.choice(["", word(), f"{word()} {word()}"])) for k in range(40)]
    m = [(s, pos, rnd.choice([word(), ""]), word()) for s, _ in p for pos in range(rnd.choice([0, 1, 6]))] + [("gone", 0, "ab", "ab")]
    providers, models = spark.createDataFrame(p, "slug string, name string"), spark.createDataFrame(m, "slug string, pos bigint, id string, name string")
    search.publish_index(providers, models, str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    texts = {s: " ".join([n.lower(), *[f"{name} {i}".lower() for t, _, i, name in sorted(m, key=lambda x: (x[0], x[1], x[2])) if t == s]]) for s, n in p}
    for q in ["a", "ab", "abé", "b a", "a b a", "é ab", " Ab ", "aab", "zz", "a a", "bb é b"]:
        want = {s for s, t in texts.items() if q.strip().lower() in t}
        assert {r.slug for r in search.text_hits(index, q).collect()} == want, q
        assert {r.slug for r in search.text_hits(index.rows, q).collect()} == want, q


def test_published_listing_pages(spark, tmp_path):
    rows = [(i, i * 7 % 101) for i in range(205)]
    df = spark.createDataFrame(rows, "id bigint, x bigint").repartition(3)
    order = [F.col("x").desc(), F.col("id").asc()]
    listing.publish_listing(df, order, str(tmp_path / "l"))
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for page, at in ((0, 0), (1, 0), (2, 20), (11, 200), (99, 200)):
        got = listing.listed_page(spark, str(tmp_path / "l"), page, 20)
        assert [tuple(r) for r in got.collect()] == want[at : at + 20] and got.columns == ["id", "x"]
        assert [tuple(r) for r in listing.paginate(df, order, page, 20).collect()] == want[at : at + 20]
    assert len(listing.listed_page(spark, str(tmp_path / "l"), 4, 20).inputFiles()) < len(spark.read.parquet(str(tmp_path / "l/rows")).inputFiles())
    listing.publish_listing(df.limit(0), order, str(tmp_path / "e"))
    assert listing.listed_page(spark, str(tmp_path / "e"), 3, 20).collect() == []


def test_global_row_number(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    rows = parts.global_row_number(df, [F.col("x").asc(), F.col("id").desc()]).collect()
    want = sorted(range(5000), key=lambda i: (i % 7, -i))
    assert [r.id for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(1, 5001))


def test_search_text_is_one_text_at_any_size(spark):
    p = spark.createDataFrame([("a", "A", 3000, ["text"], None, None), ("b", "B two", 1, ["text"], None, None)], "slug string, name string, model_count bigint, modalities array<string>, max_context string, free_limit string")
    m = spark.createDataFrame([("a", i, f"id-{i:04d}", f"Name {i:04d}") for i in range(3000)] + [("b", 1, "x", None)], "slug string, pos bigint, id string, name string")
    items, rows = search.slim_list(p), search.search_rows(p, m)
    assert rows.count() == 3003

    def hits(q):
        return sorted(r.slug for r in search.filter_list(items, rows, q, ["text"]).collect())

    assert hits("ID-2999") == ["a"] and hits("a name 0000") == ["a"] and hits("two x") == ["b"]
    assert hits("id-1499 name 1500 id-1500 name 1501") == ["a"]  # over three models
    assert hits("id-1499 name 1501") == [] and hits("9 b two") == [] and hits("") == ["a", "b"]


def test_recommend(spark):
    p = spark.createDataFrame([("a", "A", ["text", "vision"]), ("b", "B", ["text"])], "slug string, name string, modalities array<string>")
    m = spark.createDataFrame([
        ("a", 1, "m1", "M1", "128K", None, "Text + Vision", "30 RPM"), ("a", 2, "m2", "M2", "128K", "8K", "Text + Vision", "30 RPM"),
        ("a", 3, "m3", "M3", None, None, None, "Unlimited"), ("b", 4, "m4", "M4", "1M", None, "Audio", None),
    ], "slug string, ord bigint, id string, name string, context string, max_output string, modality string, rate_limit string")
    got = recommend.recommend(p, m, recommend.Criteria("vision", 8000)).collect()
    assert [(r.slug, r.id) for r in got] == [("a", "m2")] and len(got[0].reasons) == 3 and got[0].tradeoffs == []
    free = recommend.recommend(p, m, recommend.Criteria()).collect()
    assert [(r.slug, r.id) for r in free] == [("a", "m3"), ("b", "m4")]


P = "pos bigint, slug string, name string, url string, description string"
M = "slug string, pos bigint, id string, name string, context string, max_output string, modality string, rate_limit string"


def source(spark, name, prio, sizes, size="128K"):
    p = spark.createDataFrame([(i, s, s.title(), f"https://{s}.example.com", f"Text {s}") for i, s in enumerate(sizes)], P)
    rows = [(s, 1000 * i + j, f"{s}-m{j}", f"{s} m{j}", size, "8K", "Text", "30 RPM") for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return SourceSpec(name, f"https://{name}.example", prio, p, spark.createDataFrame(rows, M), "2026-01-01T00:00:00.000Z")


def run(spark, root, day, specs, **kw):
    base = spark.createDataFrame([], gates.BASELINE_SCHEMA)
    return sync.run_sync(spark, specs, root, sync.SyncOptions(f"run-{day}", f"2026-01-0{day}T12:00:00.000Z", base, **kw))


def test_runs_hold_then_accept(spark, tmp_path):
    root = str(tmp_path / "cat")
    full = {f"p{i}": 30 for i in range(24)}
    less = {**full, "p3": 13}
    assert run(spark, root, 1, [source(spark, "a", 0, full)]).outcome.startswith("ok")
    for day, want in ((2, 30), (3, 30), (4, 13)):
        result = run(spark, root, day, [source(spark, "a", 0, less)])
        assert result.outcome.startswith("ok")
        models = snapshots.read_latest(spark, root, "models", sync.MODEL_SCHEMA)
        assert models.where("slug = 'p3'").count() == want
    log = snapshots.read_latest(spark, root, "changelog", "date string, kind string, slug string, provider string, id string, name string")
    got = {(r.date, r.kind): r.n for r in log.groupBy("date", "kind").agg(F.count("*").alias("n")).collect()}
    assert got == {("2026-01-01", "provider_added"): 24, ("2026-01-04", "model_removed"): 17}


def test_corrupt_source_is_skipped_and_bad_merge_stops(spark, tmp_path):
    root = str(tmp_path / "cat")
    full = {f"p{i}": 10 for i in range(6)}
    assert run(spark, root, 1, [source(spark, "a", 0, full), source(spark, "b", 1, full)]).outcome == "ok"
    mixed = run(spark, root, 2, [source(spark, "a", 0, full), source(spark, "b", 1, full, size="81")])
    status = {r.label: r.status for r in mixed.report.where("section = 'source'").collect()}
    assert status == {"a": "ok", "b": "shape-fatal"} and mixed.outcome == "ok-with-warnings"
    assert run(spark, root, 3, [source(spark, "a", 0, full, size="81")]).outcome == "aborted-all-sources-failed"
    gone = run(spark, root, 4, [source(spark, "a", 0, {"p0": 10, "p1": 10, "p2": 10, "p3": 1})])
    assert gone.outcome == "aborted-diff-guard"
    assert snapshots.latest_run(spark, root) == "run-2"
    forced = run(spark, root, 5, [source(spark, "a", 0, {"p0": 10, "p1": 10, "p2": 10, "p3": 1})], allow_shrink=True)
    assert forced.outcome == "ok-with-warnings" and forced.providers.count() == 4


def test_report_lines_say_what_a_reader_needs(spark):
    rows = [("r", "ok-with-warnings", "quarantine", "a", "held", None, None, "9 -> 3 (run 1/3, 2 left)"), ("r", "ok-with-warnings", "source", "src", "ok", 3, 40, None),
            ("r", "ok-with-warnings", "merged", None, None, 3, 40, None), ("r", "ok-with-warnings", "shape", "invalid-url url", "fatal", None, 4, "4/10; e.g. /x")]
    rows += [("r", "ok-with-warnings", "shape", f"w{k:02}", "warn", None, 1, "m") for k in range(25)]
    got = sync.report_lines(spark.createDataFrame(rows, sync.REPORT_SCHEMA), shown=20).orderBy("place").collect()
    assert [r.line for r in got[:4]] == ["source [ok] src (3 providers, 40 models)", "merged (3 providers, 40 models)", "shape [fatal] invalid-url url (4 models) 4/10; e.g. /x", "shape [warn] w00 (1 models) m"]
    assert got[-1].line == "quarantine [held] a 9 -> 3 (run 1/3, 2 left)" and len(got) == 24
    assert [r.more for r in got if r.more] == [5]


def test_damaged_snapshot_file_reads_as_absent(spark, tmp_path):
    schema = "slug string, n bigint"
    spark.createDataFrame([("a", 1)], schema).write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in snapshots.read_fail_open(spark, str(tmp_path / "t"), schema).collect()] == [("a", 1)]
    (tmp_path / "t" / "part-damaged.parquet").write_bytes(b"no parquet at all")
    assert snapshots.read_fail_open(spark, str(tmp_path / "t"), schema).count() == 0
    assert snapshots.read_fail_open(spark, str(tmp_path / "none"), schema).count() == 0


@pytest.mark.parametrize("harm", ["none", "cut", "changed", "gone", "more", "list"])
def test_a_run_reads_whole_or_not_at_all(spark, tmp_path, harm):
    schema = "slug string, sources array<struct<name: string>>, n bigint"
    rows = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("slug"), F.array(F.struct(F.lit("x").alias("name"))).alias("sources"), F.col("id").alias("n"))
    root = str(tmp_path / "r")
    snapshots.publish_run({"t": rows.where("n < 10").coalesce(1), "other": rows.limit(5)}, root, "run-1")
    snapshots.publish_run({"t": rows.repartition(4), "other": rows.limit(5)}, root, "run-2")
    files = sorted((tmp_path / "r/t/run_id=run-2").glob("*.parquet"))
    assert len(files) == 4
    for crc in files[0].parent.glob(".*.crc"):
        crc.unlink()
    if harm == "cut":
        files[1].write_bytes(files[1].read_bytes()[:-200])
    if harm == "changed":
        other = str(tmp_path / "other")
        spark.read.schema(schema).parquet(str(files[1])).withColumn("n", F.col("n") + F.when(F.col("n") % 7 == 0, 1).otherwise(0)).coalesce(1).write.parquet(other)
        files[1].write_bytes(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    if harm == "gone":
        files[1].unlink()
    if harm == "more":
        (files[0].parent / "part-more.parquet").write_bytes(files[1].read_bytes())
    if harm == "list":
        for f in (tmp_path / "r/files/run_id=run-2").glob("*.parquet"):
            f.write_bytes(b"PAR1")
        for crc in (tmp_path / "r/files/run_id=run-2").glob(".*.crc"):
            crc.unlink()
    assert snapshots.read_latest(spark, root, "t", schema).count() == (4000 if harm == "none" else 0)
    assert snapshots.read_latest(spark, root, "other", schema).count() == (0 if harm == "list" else 5)
    assert snapshots.read_latest(spark, root, "t", schema, before="run-2").count() == 10


def test_search_index_has_a_gram_once_a_block(spark, tmp_path):
    providers = spark.createDataFrame([("s", "Some Name")], "slug string, name string")
    models = spark.range(20_000).select(F.lit("s").alias("slug"), F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("same words").alias("name"))
    search.publish_index(providers, models, str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    blocks = -(-20_001 // search.BLOCK)
    assert index.rows.groupBy("block").count().agg(F.max("count")).first()[0] <= search.BLOCK
    assert index.postings.where("gram = 'wor'").count() == index.rows.select("block").distinct().count() == blocks
    assert [r.slug for r in search.text_hits(index, "19998 same words 19999").collect()] == ["s"]


def test_large_joined_tables_are_not_broadcast(spark, tmp_path):
    """Half a million rows are a small file, and 25 to 50 MB of the driver's memory for each join that broadcasts them."""
    from checks import bind

    rows = bind.BROADCAST_ROWS + 1 if hasattr(bind, "BROADCAST_ROWS") else 500_001
    for name, n in (("part", rows), ("supplier", 20), ("lineitem", 100)):
        given = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(1)
        key = {"part": "p_partkey", "supplier": "s_suppkey", "lineitem": "l_orderkey"}[name]
        spark.range(n).join(given.drop(key)).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = bind.view(spark, str(tmp_path), "prev_p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
    small = bind.view(spark, "/root/testdata/sf0.001", "prev_p")._jdf.queryExecution().executedPlan().toString()
    assert small.count("BroadcastHashJoin") == 2

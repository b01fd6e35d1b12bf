"""Semi-structured readers on the documented layouts."""

import json

from weftline.sources import html_tables, json_payloads, markdown, projects, snapshots

ROWS = [("Gemini 3.5 Flash", "250,000 tokens/minute<br>20 requests/day"), ("Gemma 3 27B Instruct", "15,000 tokens/minute<br>14,400 requests/day")]


def table(head, cells):
    th = "".join(f"<th>{h}</th>" for h in head)
    trs = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells)
    return f"<table><thead><tr>{th}</tr></thead><tbody>{trs}</tbody></table>"


def simple(spark, html):
    df = spark.createDataFrame([(1, html)], "k int, table_html string")
    return sorted((r.name, r.rate_limit) for r in html_tables.html_table_simple_rows(df, ["k"]).collect())


def header_error(spark, html):
    df = spark.createDataFrame([(1, html)], "k int, html string")
    return html_tables.html_table_header_map(df, html_tables.SIMPLE_COLUMNS, "name").first().header_error


def test_simple_table_by_header(spark):
    want = [("Gemini 3.5 Flash", "250,000 tokens/minute, 20 requests/day"), ("Gemma 3 27B Instruct", "15,000 tokens/minute, 14,400 requests/day")]
    assert simple(spark, table(["Model Name", "Model Limits"], ROWS)) == want
    assert simple(spark, table(["Model Limits", "Model Name"], [r[::-1] for r in ROWS])) == want
    assert simple(spark, table(["MODEL", "Rate Limit"], ROWS)) == want
    assert simple(spark, table(["Model Name"], [r[:1] for r in ROWS])) == [(n, None) for n, _ in want]


def test_simple_table_header_errors(spark):
    assert header_error(spark, table(["Score", "Model Limits"], ROWS)) == "no-name-column"
    assert header_error(spark, "<table><tr><td>x</td></tr></table>") == "no-thead"
    assert header_error(spark, "<table><thead><tr></tr></thead></table>") == "no-headers"


def test_attribute_rows(spark):
    html = (
        "<table><thead><tr><th>Provider</th><th>Model</th><th>Score</th><th>Context</th><th>Modality</th><th>Rate Limit</th></tr></thead><tbody id='m'>"
        '<tr data-provider="Groq" data-modality="text,vision" data-free="1"><td><a>Groq</a></td><td><a class="model-link" href="#">Llama 3</a> new</td><td>81</td><td>256K</td><td></td><td>30 RPM</td></tr>'
        '<tr data-provider="Groq" data-modality=""><td></td><td>Abbreviation</td><td>1</td><td>1K</td><td></td><td>x</td></tr>'
        '<tr data-provider="Groq"><td></td><td>Zero</td><td>5</td><td>0</td><td></td><td>See provider page</td></tr></tbody></table>'
    )
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = {r.id: (r.context, r.modality, r.rate_limit, r.slug) for r in html_tables.html_table_rows(df).collect()}
    assert got == {"llama-3": ("256K", "text + vision", "30 RPM", "groq"), "zero": (None, "", None, "groq")}


README = """# List
intro
## Free Providers
### [Groq](https://groq.com)

Fast models.

**Limits:** 20 requests/minute<br>50 requests/day

- Model A-1
- [Model B-2](https://b.example)
- Open and Proprietary Mistral models
- mistral-7b-instruct
### Mistral (La Plateforme)
""" + table(["Model Name", "Model Limits"], ROWS) + """
## Free Providers with trial credits
### Other
- x-1
"""


def test_markdown_catalogue(spark):
    docs = spark.createDataFrame([(1, README)], "doc_id int, text string")
    sections = markdown.markdown_sections(docs, ["doc_id"])
    assert [r.heading for r in sections.orderBy("section").collect()] == ["__preamble__", "Free Providers", "Free Providers with trial credits"]
    blocks = markdown.markdown_blocks(markdown.free_sections(sections, ["doc_id"]), ["doc_id"])
    got = {r.name: (r.slug, r.url, r.description) for r in markdown.provider_blocks(blocks, ["doc_id"]).collect()}
    assert got == {"Groq": ("groq", "https://groq.com", "Fast models."), "Mistral": ("mistral-ai", None, None)}
    rows = sorted((r.block, r.name, r.rate_limit) for r in markdown.dispatch_by_format(blocks, ["doc_id", "block"]).collect())
    limit = "20 requests/minute, 50 requests/day"
    assert rows[:3] == [(1, "Model A-1", limit), (1, "Model B-2", limit), (1, "mistral-7b-instruct", limit)]
    assert [r[1] for r in rows[3:]] == [n for n, _ in ROWS]


def nested(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return json_payloads.ingest_nested_json(spark.createDataFrame(rows, "doc_id int, payload string"))


def model(i, **kw):
    return {"id": f"m{i}", "name": f"M {i}", "context": "128K", "modality": "Text", **kw}


def test_nested_json_errors(spark):
    r = nested(spark, ["[1]", {"items": []}, {"providers": {}}, {"providers": []}, "oops", {"providers": [{"name": "A", "models": []}]}])
    got = {x.doc_id: x.error for x in r.errors.collect()}
    assert got == {0: "not-an-object", 1: "providers-not-an-array", 2: "providers-not-an-array", 3: "providers-empty", 4: "not-an-object"}


def test_nested_json_guards(spark):
    def rules(models):
        return {x.rule for x in json_payloads.nested_shape_guard(nested(spark, [{"providers": [{"name": "A", "models": models}]}]).stats).collect()}

    assert rules([model(i) for i in range(25)]) == set()
    assert rules([{**model(i), "context": None, "ctx": "1K"} for i in range(25)]) == {"fill-context"}
    assert rules([model(i, id={"x": 1}) for i in range(25)]) == {"fill-id"}
    one = [model(i) for i in range(25)]
    one[3]["context"] = {"v": 1}
    assert rules(one) == set()
    got = nested(spark, [{"providers": [{"name": "A", "models": one + [{"name": "+ 9 more"}]}]}])
    assert got.models.where("context is null").count() == 1 and got.providers.first().more_models == "9 more"
    bad = nested(spark, [{"providers": [{"name": 1} for _ in range(4)] + [{"name": "B", "models": "x"}]}])
    assert {x.rule for x in json_payloads.nested_shape_guard(bad.stats).collect()} == {"entry-shape"}


def api(spark, rows):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "ord int, payload string")
    return json_payloads.ingest_json_suffix_filter(df)


def test_suffix_feed(spark):
    def row(i, free=True, **kw):
        return {"id": f"v/m{i}" + (":free" if free else ""), "name": f"M{i}", "context_length": 131072,
                "architecture": {"input_modalities": ["text", "image"]}, "top_provider": {"max_completion_tokens": 8192}, **kw}

    paid = [row(100 + i, False) for i in range(20)]
    good = api(spark, [row(i) for i in range(10)] + paid)
    assert good.failures.count() == 0 and good.models.count() == 10
    r = good.models.first()
    assert (r.context, r.max_output, r.modality, r.rate_limit) == ("131K", "8K", "Text + Vision", None)
    assert {x.rule for x in api(spark, [row(i, False) for i in range(30)]).failures.collect()} == {"no-suffix-match"}
    renamed = [{k: v for k, v in row(i).items() if k != "context_length"} for i in range(10)]
    assert {x.rule for x in api(spark, renamed + paid).failures.collect()} == {"fill-context"}
    moved = [{**row(i), "architecture": {"in": ["text"]}} for i in range(10)]
    assert {x.rule for x in api(spark, moved + paid).failures.collect()} == {"fill-modality"}


def test_fanout_floor(spark):
    keys = spark.createDataFrame([(str(i),) for i in range(10)], "key string")
    meta = spark.createDataFrame([(str(i),) for i in range(5)], "key string")
    assert projects.fanout_coverage(keys, meta, "key").first().ok is True
    assert projects.fanout_coverage(keys, meta.where("key < '4'"), "key").first().ok is False


def test_unpublished_run_stays_invisible(spark, tmp_path):
    root = str(tmp_path / "cat")
    one = spark.createDataFrame([("a",)], "slug string")
    snapshots.publish_run({"t": one}, root, "run-1")
    spark.createDataFrame([("b",)], "slug string").write.parquet(f"{root}/t/run_id=run-2")
    assert [r.slug for r in snapshots.read_latest(spark, root, "t", "slug string").collect()] == ["a"]
    snapshots.publish_run({"t": one.unionAll(one)}, root, "run-3")
    assert snapshots.read_latest(spark, root, "t", "slug string").count() == 2
    assert snapshots.read_latest(spark, root, "t", "slug string", before="run-3").count() == 1
    raw = spark.createDataFrame([('{"slug": "x"}',), ("not json",)], "value string")
    assert snapshots.parse_json_fail_open(raw, "slug string").where("slug is not null").count() == 1


def test_pages_are_dealt_out_before_they_are_parsed(spark):
    html = "<table><thead><tr><th>Provider</th><th>Model</th><th>Context</th></tr></thead><tbody><tr data-provider='x'></tr><tr data-provider=\"acme\"><td></td><td>M</td><td>8K</td></tr></tbody></table>"
    rows = html_tables.html_table_rows(spark.createDataFrame([(k, html) for k in range(6)], "page_id long, html string").coalesce(1))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    before, dealt, below = plan.partition("Repartition")
    assert dealt and "header_error" in before and "regexp" not in below
    assert sorted((r.page_id, r.provider, r.name, r.context) for r in rows.collect()) == [(k, "acme", "M", "8K") for k in range(6)]

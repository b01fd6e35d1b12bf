"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import dates, facets, numbers, text


def apply(spark, fn, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


CASES = [
    (text.clean_str, {" a ": "a", "—": None, "N/A": None, "n/A": "n/A", "": None, " x ": "x", "None": None}),
    (text.strip_md_links, {"[Ollama API](https://x)": "Ollama API", "![alt](u) `code`": "alt code", "plain": "plain"}),
    (text.safe_url, {"https://a.b": "https://a.b", "javascript:x": None, "/rel": None, "HTTP://a": "HTTP://a", "http://": None, "ftp://a": None}),
    (text.slugify, {"Google AI (Studio)": "google-ai-studio", "--A  b--": "a-b", "": ""}),
    (text.canonical_slug, {"Gemini API": "google-gemini", "Groq Cloud": "groq", "Else": "else"}),
    (text.decode_entities, {"&amp;lt;": "<", "&#39;&quot;": "'\"", "&#65;&#x42;&#X43;": "ABC", "&#38;#65;": "&#65;", "a&nbsp;b": "a b"}),
    (text.html_text_of, {"<b>a</b>\n<i> b</i>": "a b"}),
    (text.model_key, {
        "Meta: Llama 3.3 70B (free)": "llama3370b", "moonshotai/kimi-k2.6:free": "kimik26", "MoonshotAI: Kimi K2.6 (free)": "kimik26",
        "OpenAI GPT-4o": "gpt4o", "command-r-08-2024": "commandr082024", "qwen-7b-instruct": "qwen7b", "whisper-large-v3-turbo": "whisperlargev3turbo",
    }),
    (text.cluster_key, {"@cf/meta/llama-3.1-8b-instruct": "llama-3-1-8b", "Llama 3.1 8B": "llama-3-1-8b"}),
    (text.enrich_norm_key, {"@cf/meta/x:free": "meta/x", "Vendor/Model": "model", "a": "a"}),
    (text.domain_of, {
        "https://www.a.example.com/x": "example.com", "https://x.co.id/a": "x.co.id", "http://a.b.ac.id": "b.ac.id", "/rel": None,
        "https://console.groq.com/keys": "groq.com", "https://user@h.io:80/": "h.io",
    }),
    (text.domain_from_name, {"Chutes.ai": "chutes.ai", "Agnes AI": None, "Grok (xAI)": None}),
    (text.slug_name, {"Mistral (La Plateforme)": "Mistral", "X": "X"}),
    (numbers.ctx_num, {"256K": 256e3, "1M": 1e6, "Up to 10M": 10e6, "131,072": 131.0, "Varies": 0.0, None: 0.0, "1.2.3K": 1200.0}),
    (numbers.parse_context_tokens, {"131,072": None, "128k": 128e3, " 1 M": 1e6, "8192": 8192.0, "Up to 1M": None}),
    (numbers.clean_ctx_str, {"Up to 10M": "10M", "1.0M": "1M", "1.5M": "1.5M", "128K (8K on free)": "128K (8K on free)"}),
    (numbers.looks_like_context, {
        "128K": True, "1M": True, "8192": True, "32k": True, "128K (8K on free)": True, "Up to 10M": True, "Varies": True, "~200K": True,
        "Shared w/ context": True, "81": False, "45": False, "$25/month": False, "Jun 30, 2026": False, "85%": False, None: False, "0999": False, "01000": True,
    }),
    (numbers.looks_like_rate_limit, {"30 RPM": True, "10,000 neurons/day": True, "256K": False, None: False, "See provider page": True}),
    (numbers.rate_limit_per_day, {"200 RPM, 1,000 requests/day": 1000.0, "2 RPM": 2880.0, "fair use": None, None: None, "1.5 rpd": 1.5}),
    (numbers.rate_limit_unlimited, {"Unlimited": True, "no hard cap": True, "30 RPM": False, None: False}),
    (numbers.free_limit_of, {
        "Get $5 now": "$5 kredit", "$5 one-time": None, "~1 M tokens / month": "~1M token/bln", "1K credits daily": "1K kredit", "": None,
        "500 API calls per day": "500 calls/hari", "10,000 Neurons": "10,000 Neurons/hari", "50 requests/day": "50 req/hari", "20 RPM per IP": "20 RPM/IP",
        "~30+ free models": "~30+ model free", "Permanent": "Free (permanen)", "No signup": "Free, no signup", "nothing": None,
    }),
    (facets.facets_of, {"Text + Vision": ["vision", "text"], "": [], None: [], "Code": ["code"], "encoder": [], "Speech": ["audio"], "Reranking": ["reranking"]}),
    (dates.fmt_date, {"2026-05-03T18:00:00Z": "3 Mei 2026", "bad": "bad"}),
    (dates.rfc822, {"2026-08-22": "Sat, 22 Aug 2026 00:00:00 GMT"}),
    (text.valid_email, {"a@b.c": True, "a b@c.d": False, "a@b": False}),
    (text.is_section_descriptor, {"Open and Proprietary Mistral models": True, "mistral-7b models": False, "Mistral Large": False}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_cases(spark, fn, cases):
    assert dict(zip(cases, apply(spark, fn, list(cases)))) == cases


def test_number_formats(spark):
    tokens = {32768: "32K" if 32768 % 1000 == 0 else "32K", 131072: "128K", 1048576: "1M", 200000: "200K", 1000000: "1M", 777: "777", 0: None}
    assert dict(zip(tokens, apply(spark, numbers.fmt_tokens, list(tokens), "x bigint"))) == tokens
    context = {1048576: "1.049M", 2000000: "2M", 131072: "131K", 999: "999", 0: None, 1500: "2K"}
    assert dict(zip(context, apply(spark, numbers.fmt_context, list(context), "x bigint"))) == context


def test_more_note(spark):
    df = spark.createDataFrame([("+15 more", 20), ("+15 more", 10), ("and others", 99), ("1,000 additional", 1000)], "x string, n int")
    got = [r[0] for r in df.select(numbers.reconcile_more_note(F.col("x"), F.col("n"))).collect()]
    assert got == [None, "+15 more", "and others", None]


def test_candidate_keys(spark):
    df = spark.createDataFrame([("meta/llama-3:free", "Llama 3"), ("x", "X"), (None, None)], "i string, n string")
    got = [r[0] for r in df.select(text.candidate_keys(F.col("i"), F.col("n"))).collect()]
    assert got[0] == ["llama-3", "llama 3"] and got[1] == ["x"] and got[2] == []

"""JSON sources read by field name with type guards; a value of the wrong type is NULL, never a guess."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import facets, numbers, text
from weftline.session import cut_lineage

NUMERIC = r"\A(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)\z"


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _type_at(v: Column, path: str) -> Column:
    return F.schema_of_variant(_at(v, path))


def str_or_null(v: Column, path: str) -> Column:
    """A non-empty JSON string, else NULL."""
    return F.when(_type_at(v, path) == "STRING", text.null_if_empty(F.try_variant_get(v, path, "string")))


def num_or_null(v: Column, path: str) -> Column:
    return F.when(_type_at(v, path).rlike(NUMERIC), F.try_variant_get(v, path, "double"))


def scalar_or_null(v: Column, path: str) -> Column:
    """A JSON string or non-zero number as clean text; objects, arrays and booleans are NULL."""
    kind = _type_at(v, path)
    number = F.when(F.try_variant_get(v, path, "double") != 0, F.try_variant_get(v, path, "string"))
    return text.clean_str(
        F.when(kind == "STRING", F.try_variant_get(v, path, "string")).when(kind.rlike(NUMERIC), number)
    )


def is_array(v: Column, path: str) -> Column:
    return F.coalesce(_type_at(v, path).startswith("ARRAY"), F.lit(False))


@dataclass
class NestedIngest:
    providers: DataFrame  # one row per usable entry
    models: DataFrame  # one row per (entry, id), first wins
    stats: DataFrame  # one row per document: entry and fill counts
    errors: DataFrame  # documents whose top level is not usable


def _shredded(payloads: DataFrame, doc: str, payload: str) -> DataFrame:
    """(doc_id, error, source_updated_at, entry, the entry's fields, pos, model): typed rows of one parse."""
    # Generated rows, so that later columns read the parsed value instead of parsing again.
    docs = payloads.select(F.col(doc).alias("doc_id"), F.inline(F.array(F.struct(F.try_parse_json(F.col(payload)).alias("v")))))
    v, e, m = F.col("v"), F.col("e"), F.col("m")
    entries = F.try_variant_get(v, "$.providers", "array<variant>")
    error = (
        F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not-an-object")
        .when(~is_array(v, "$.providers"), "providers-not-an-array")
        .when(F.size(entries) == 0, "providers-empty")
    )
    checked = docs.select("doc_id", F.inline(F.array(F.struct(error.alias("error"), str_or_null(v, "$.lastUpdated").alias("source_updated_at"), entries.alias("entries")))))
    spread = checked.select("doc_id", "error", "source_updated_at", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("entries"))).alias("entry", "e"))
    fields = F.struct(
        str_or_null(e, "$.name").alias("name"),
        str_or_null(e, "$.category").alias("category"),
        str_or_null(e, "$.country").alias("country"),
        str_or_null(e, "$.flag").alias("flag"),
        text.safe_url(str_or_null(e, "$.url")).alias("url"),
        text.safe_url(str_or_null(e, "$.baseUrl")).alias("base_url"),
        str_or_null(e, "$.description").alias("description"),
        (_at(e, "$.models").isNotNull() & ~is_array(e, "$.models") & (_type_at(e, "$.models") != "VOID")).alias("bad_models"),
        F.when(is_array(e, "$.models"), F.try_variant_get(e, "$.models", "array<variant>")).alias("models"),
    )
    entry = spread.select("doc_id", "error", "source_updated_at", "entry", F.inline(F.array(fields))).withColumn("bad_name", text.is_blank(F.col("name")))
    models = F.posexplode_outer(F.when(~F.col("bad_name"), F.col("models"))).alias("pos", "m")
    model = F.struct(
        text.blank_to_null(str_or_null(m, "$.id")).alias("id"),
        str_or_null(m, "$.name").alias("name"),
        scalar_or_null(m, "$.context").alias("context"),
        scalar_or_null(m, "$.maxOutput").alias("max_output"),
        str_or_null(m, "$.modality").alias("modality"),
        scalar_or_null(m, "$.rateLimit").alias("rate_limit"),
    )
    return entry.select("*", models).withColumn("model", F.when(F.col("pos").isNotNull(), model)).drop("models", "m")


def ingest_nested_json(payloads: DataFrame, doc: str = "doc_id", payload: str = "payload") -> NestedIngest:
    """Documents of the form {"providers": [{"name", "models": [...]}]}.

    Each document is parsed once, into typed rows that are written once: one for each model, one for an entry without
    models, one for a document that is not usable. Everything else reads those.
    """
    rows = cut_lineage(_shredded(payloads, doc, payload))
    errors = rows.where("error is not null").select("doc_id", "error")
    entries = rows.where("entry is not null and coalesce(pos, 0) = 0")
    usable = entries.where(~F.col("bad_name"))
    raw = rows.where("pos is not null").select(
        "doc_id", "entry", text.canonical_slug(F.col("name")).alias("slug"), "pos", *[F.col(f"model.{c}").alias(c) for c in ("id", "name", "context", "max_output", "modality", "rate_limit")])
    fields = ["name", "context", "max_output", "modality", "rate_limit"]
    models = (
        raw.where("id is not null")
        .groupBy("doc_id", "entry", "slug", "id")
        .agg(F.min_by(F.struct("pos", *fields), "pos").alias("first"))
        .select("doc_id", "entry", "slug", "id", "first.*")
    )
    notes = (
        raw.where("id is null and name is not null")
        .groupBy("doc_id", "entry")
        .agg(F.min_by("name", "pos").alias("note"))
        .select("doc_id", "entry", text.trim_all(F.regexp_replace("note", rf"\A\+{text.WS}*", "")).alias("more_models"))
    )
    providers = (
        usable.withColumn("slug", text.canonical_slug(F.col("name")))
        .drop("error", "pos", "model", "bad_models", "bad_name")
        .join(notes, ["doc_id", "entry"], "left")
    )
    per_entry = entries.groupBy("doc_id").agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("bad_name") | F.col("bad_models")).alias("bad_entries"),
    )
    per_model = raw.groupBy("doc_id").agg(
        F.count("*").alias("model_entries"),
        F.count("id").alias("with_id"),
        F.count("context").alias("with_context"),
        F.count("modality").alias("with_modality"),
    )
    stats = per_entry.join(per_model, "doc_id", "left").na.fill(0)
    return NestedIngest(providers, models, stats, errors)


def nested_shape_guard(stats: DataFrame) -> DataFrame:
    """Rules that reject a whole nested payload feed; one row per rule that fires."""
    totals = stats.agg(*[F.sum(c).alias(c) for c in stats.columns if c != "doc_id"])
    entries, rows = F.col("entries"), F.col("model_entries")
    rules = [F.when((entries >= 5) & (F.col("bad_entries") / entries > 0.5), F.lit("entry-shape"))]
    for field in ("id", "context", "modality"):
        rules.append(F.when((rows >= 20) & (F.col(f"with_{field}") / rows < 0.1), F.lit(f"fill-{field}")))
    return totals.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), "entries", "bad_entries", "model_entries")


@dataclass
class SuffixIngest:
    models: DataFrame
    stats: DataFrame  # one row of counts
    failures: DataFrame  # rules that reject the feed


def ingest_json_suffix_filter(rows: DataFrame, payload: str = "payload", ord_col: str = "ord", suffix: str = ":free") -> SuffixIngest:
    """API model objects, one per row; only ids with the suffix stay, the first row of an id wins."""
    v = F.col("v")
    parsed = rows.select(F.col(ord_col).alias("ord"), F.try_parse_json(F.col(payload)).alias("v")).select(
        "ord",
        str_or_null(v, "$.id").alias("id"),
        F.coalesce(scalar_or_null(v, "$.name"), str_or_null(v, "$.id")).alias("name"),
        num_or_null(v, "$.context_length").alias("context_tokens"),
        num_or_null(v, "$.top_provider.max_completion_tokens").alias("output_tokens"),
        facets.modality_from_array(
            F.when(is_array(v, "$.architecture.input_modalities"),
                   F.try_variant_get(v, "$.architecture.input_modalities", "array<string>"))
        ).alias("modality"),
    )
    kept = F.coalesce(F.col("id").endswith(suffix), F.lit(False))
    cols = ["name", "context_tokens", "output_tokens", "modality"]
    first = (
        parsed.where(kept).groupBy("id").agg(F.min_by(F.struct("ord", *cols), "ord").alias("f")).select("id", "f.*")
    )
    models = first.select(
        "id", "name",
        numbers.fmt_context(F.col("context_tokens")).alias("context"),
        numbers.fmt_context(F.col("output_tokens")).alias("max_output"),
        "modality",
        F.lit(None).cast("string").alias("rate_limit"),
        "ord",
    )
    stats = first.agg(
        F.count("*").alias("kept"), F.count("context_tokens").alias("with_context"), F.count("modality").alias("with_modality"),
    ).withColumn("total", parsed.agg(F.count("*").alias("n")).scalar())
    enough = F.col("kept") >= 5
    rules = [
        F.when((F.col("total") >= 20) & (F.col("kept") == 0), F.lit("no-suffix-match")),
        F.when(enough & (F.col("with_context") / F.col("kept") < 0.2), F.lit("fill-context")),
        F.when(enough & (F.col("with_modality") / F.col("kept") < 0.2), F.lit("fill-modality")),
    ]
    failures = stats.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), "total", "kept")
    return SuffixIngest(models, stats, failures)

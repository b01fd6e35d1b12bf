"""Value-shape guard: does each field still look like itself? One aggregate per input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import facets, fixed, numbers, text

MIN_SAMPLE = 20
FATAL_RATIO = 0.5
MODEL_FIELDS = ["context", "max_output", "modality", "rate_limit"]
PROVIDER_URLS = ["url", "base_url"]


def severity(count: Column, total: Column) -> Column:
    """NULL without findings; fatal when a large enough sample is mostly wrong; else warn."""
    return F.when(count <= 0, None).when((total >= MIN_SAMPLE) & (count / total > FATAL_RATIO), "fatal").otherwise("warn")


def _stated(c: str) -> Column:
    return ~text.is_blank(F.col(c))


def model_rules() -> list[tuple[str, str, Column, Column, Column]]:
    """(rule, field, counted row, bad row, sample value) over model rows."""
    ctx, rate = F.col("context"), F.col("rate_limit")
    both = ctx.isNotNull() & rate.isNotNull()
    same = _stated("context") & (text.trim_all(ctx) == text.trim_all(rate))
    return [
        ("context-shape", "context", _stated("context"), ~numbers.looks_like_context(ctx), ctx),
        ("maxoutput-shape", "maxOutput", _stated("max_output"), ~numbers.looks_like_context(F.col("max_output")), F.col("max_output")),
        ("column-swap-identical", "context/rateLimit", both, same, ctx),
        ("column-swap-context-looks-like-ratelimit", "context", _stated("context"),
         numbers.looks_like_rate_limit(ctx) & ~numbers.looks_like_context(ctx), ctx),
        ("ratelimit-is-bare-context-token", "rateLimit", _stated("rate_limit"), numbers.is_bare_size(rate), rate),
        ("modality-unrecognised", "modality", _stated("modality"), ~facets.has_any_facet(F.col("modality")), F.col("modality")),
        ("leftover-markup-entity", "name", _stated("name"), text.has_markup_or_entity(F.col("name")), F.col("name")),
        ("leftover-markup-entity", "id", _stated("id"), text.has_markup_or_entity(F.col("id")), F.col("id")),
        ("empty-id", "id", F.lit(True), text.is_blank(F.col("id")), F.lit(None).cast("string")),
        ("empty-name", "name", F.lit(True), text.is_blank(F.col("name")), F.lit(None).cast("string")),
    ]


def provider_rules() -> list[tuple[str, str, Column, Column, Column]]:
    urls = [
        ("invalid-url", "baseUrl" if c == "base_url" else c, _stated(c), text.safe_url(F.col(c)).isNull(), F.col(c)) for c in PROVIDER_URLS
    ]
    return [
        ("leftover-markup-entity", "name", _stated("name"), text.has_markup_or_entity(F.col("name")), F.col("name")),
        ("leftover-markup-entity", "description", _stated("description"), text.has_markup_or_entity(F.col("description")), F.col("description")),
        *urls,
    ]


def _counts(df: DataFrame, group: list[str], rules: list, collapse: list[tuple[str, str]]) -> DataFrame:
    """One aggregate: (rule, field, count, total) rows for share rules and all-NULL columns."""
    aggs = [F.count("*").alias("rows")]
    entries = []
    for i, (rule, field, counted, bad, _) in enumerate(rules):
        aggs += [F.count_if(counted & bad).alias(f"b{i}"), F.count_if(counted).alias(f"t{i}")]
        entries.append(F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.col(f"b{i}").alias("count"), F.col(f"t{i}").alias("total")))
    for col, field in collapse:
        aggs.append(F.count_if(_stated(col)).alias(f"s_{col}"))
        empty = (F.col(f"s_{col}") == 0) & (F.col("rows") >= MIN_SAMPLE)
        entries.append(F.struct(F.lit("all-null-collapse").alias("rule"), F.lit(field).alias("field"),
                                F.when(empty, F.col("rows")).otherwise(0).alias("count"), F.col("rows").alias("total")))
    return df.groupBy(*group).agg(*aggs).select(*group, F.inline(F.array(*entries)))


def duplicate_ids(models: DataFrame, group: list[str]) -> DataFrame:
    """Repeats of an id inside one provider; copies collapse on the map side."""
    per = models.groupBy(*group, "slug", "id").agg(F.count("*").alias("n"))
    extra = F.when(F.col("id").isNotNull(), F.col("n") - 1).otherwise(0)
    return per.groupBy(*group).agg(F.sum(extra).alias("count"), F.sum("n").alias("total")).select(
        *group, F.lit("duplicate-id-in-provider").alias("rule"), F.lit("id").alias("field"), "count", "total"
    )


ALWAYS_WARN = ["duplicate-id-in-provider", "all-null-collapse"]
FIELD_NAMES = {"max_output": "maxOutput", "rate_limit": "rateLimit", "base_url": "baseUrl"}


def shape_counts(providers: DataFrame, models: DataFrame, group: list[str]) -> DataFrame:
    """Counts of every rule per group (``source``, or nothing for a merged catalogue)."""
    def collapse(cols: list[str]) -> list[tuple[str, str]]:
        return [(c, FIELD_NAMES.get(c, c)) for c in cols]

    m = _counts(models, group, model_rules(), collapse(MODEL_FIELDS))
    p = _counts(providers, group, provider_rules(), collapse(PROVIDER_URLS))
    rows = m.unionByName(p).unionByName(duplicate_ids(models, group))
    # Provider and model names share one rule.
    return rows.groupBy(*group, "rule", "field").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def shape_issues(providers: DataFrame, models: DataFrame, group: list[str]) -> DataFrame:
    counts = shape_counts(providers, models, group)
    level = F.when(F.col("rule").isin(ALWAYS_WARN) & (F.col("count") > 0), "warn").otherwise(severity(F.col("count"), F.col("total")))
    share = F.floor(F.col("count") / F.col("total") * 100 + 0.5).cast("bigint")
    message = F.concat(
        F.lit('Field "'), "field", F.lit('": '), F.col("count").cast("string"), F.lit("/"), F.col("total").cast("string"),
        F.lit(" ("), share.cast("string"), F.lit("%) break rule "), "rule",
    )
    return (
        counts.withColumn("severity", level).where("severity is not null")
        .withColumn("ratio", F.col("count") / F.col("total")).withColumn("message", message)
    )


def _offending(df: DataFrame, group: list[str], rules: list, kind: int, place: Column) -> DataFrame:
    """(group, rule, field, kind, slug, ord, value) of every value that breaks a rule, all rules in one pass."""
    entries = [
        F.when(counted & bad & value.isNotNull(), F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), value.alias("value")))
        for rule, field, counted, bad, value in rules
    ]
    return df.select(*group, F.lit(kind).alias("kind"), "slug", place.cast("bigint").alias("ord"), F.inline(F.array_compact(F.array(*entries))))


def shape_samples(models: DataFrame, group: list[str], n: int = 3, providers: DataFrame | None = None) -> DataFrame:
    """First offending values per rule, at most n, providers before models: the group limit prunes before the shuffle."""
    bad_rows = _offending(models, group, model_rules(), 1, F.col("ord"))
    if providers is not None:
        place = F.col("pos") if "pos" in providers.columns else F.lit(None)
        bad_rows = _offending(providers, group, provider_rules(), 0, place).unionByName(bad_rows)
    w = Window.partitionBy(*group, "rule", "field").orderBy("kind", "slug", "ord")
    first = bad_rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return first.groupBy(*group, "rule", "field").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("xs")).select(
        *group, "rule", "field", F.col("xs.value").alias("samples")
    )


def shape_stats(providers: DataFrame, models: DataFrame, group: list[str]) -> DataFrame:
    m = models.groupBy(*group).agg(
        F.count("*").alias("models"), F.count("context").alias("with_context"), F.count("max_output").alias("with_max_output"),
        F.count("rate_limit").alias("with_rate_limit"), F.count_if(_stated("modality")).alias("with_modality"),
    )
    p = providers.groupBy(*group).agg(F.count("*").alias("providers"))
    if group:
        return p.join(m, group, "left").na.fill(0)
    one = m.select(F.struct("*")).scalar()
    return p.select("providers", *[one[c].alias(c) for c in m.columns])


def shape_report(providers: DataFrame, models: DataFrame, group: list[str]) -> DataFrame:
    """Issues with samples."""
    issues = shape_issues(providers, models, group)
    samples = shape_samples(models, group, providers=providers)
    return issues.join(samples, [*group, "rule", "field"], "left")


def rule_counts(df: DataFrame, rule: str, group: list[str], field: str | None = None) -> DataFrame:
    """One rule alone over model rows."""
    picked = [r for r in model_rules() + provider_rules() if r[0] == rule and (field is None or r[1] == field) and _covered(df, r)]
    # A column may be covered by a model rule and a provider rule: one row for each (rule, field) all the same.
    rows = _counts(df, group, list({r[:2]: r for r in reversed(picked)}.values())[::-1], [])
    return rows.withColumn("severity", severity(F.col("count"), F.col("total")))


def _covered(df: DataFrame, rule: tuple) -> bool:
    need = {"maxOutput": "max_output", "rateLimit": "rate_limit", "baseUrl": "base_url", "context/rateLimit": "context"}
    return need.get(rule[1], rule[1]) in df.columns


def scorelike_guard(models: DataFrame, group: list[str]) -> DataFrame:
    """Contexts that are bare one- to three-digit numbers: a score column read as context."""
    stated = text.null_if_empty(F.col("context")).isNotNull()
    bare = stated & F.col("context").rlike(r"\A[0-9]{1,3}\z")
    return models.groupBy(*group).agg(F.count_if(stated).alias("total"), F.count_if(bare).alias("scorelike")).withColumn(
        "failed", (F.col("total") >= MIN_SAMPLE) & (F.col("scorelike") / F.col("total") > FATAL_RATIO)
    )


def row_assertions(providers: DataFrame, models: DataFrame) -> DataFrame:
    """Broken rows of a merged catalogue: slug, rule, severity. Any error stops a run."""
    bad_ref = F.exists("sources", lambda s: text.null_if_empty(s["name"]).isNull() | text.null_if_empty(s["url"]).isNull() | text.null_if_empty(s["synced_at"]).isNull())
    no_source = F.coalesce(F.size("sources") < 1, F.lit(True)) | text.null_if_empty(F.col("synced_at")).isNull()
    rules = {
        "missing-sources": no_source,
        "incomplete-source-ref": bad_ref,
        "context-without-models": (F.col("model_count") == 0) & text.null_if_empty(F.col("max_context")).isNotNull(),
        "max-context-sentinel": F.col("max_context").isin("—", "-"),
        "empty-slug-or-name": text.null_if_empty(F.col("slug")).isNull() | text.null_if_empty(F.col("name")).isNull(),
        "invalid-category": F.col("category").isNotNull() & ~F.col("category").isin(fixed.PROVIDER_CATEGORIES),
    }
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    none = F.lit(None).cast("string")
    on_providers = providers.select("slug", none.alias("id"), F.explode(flags).alias("rule"), F.lit("error").alias("severity"))
    descriptor = text.is_section_descriptor(F.col("id")) | text.is_section_descriptor(F.col("name"))
    on_models = models.select("slug", "id", F.explode(F.array_compact(F.array(
        F.when(descriptor, F.struct(F.lit("section-descriptor").alias("rule"), F.lit("error").alias("severity"))),
        F.when(F.col("modality") == "", F.struct(F.lit("empty-modality").alias("rule"), F.lit("warn").alias("severity"))),
    ))).alias("x")).select("slug", "id", "x.rule", "x.severity")
    return on_providers.unionByName(on_models)

"""Published forms of the catalogue: flat, nested, text lines, URL inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import dates, fixed, text
from weftline.operators.parts import global_row_number

MODEL_COLUMNS = ["id", "name", "context", "max_output", "modality", "rate_limit"]


def flat_models(providers: DataFrame, models: DataFrame, slug: str | None = None) -> DataFrame:
    """One row per model with its provider's slug and name."""
    scoped = providers if slug is None else providers.where(F.col("slug") == slug)
    named = scoped.select("slug", F.col("name").alias("provider_name"))
    return models.join(named, "slug").select(F.col("slug").alias("provider"), "provider_name", *MODEL_COLUMNS)


def nested_catalog(providers: DataFrame, models: DataFrame) -> DataFrame:
    """(slug, row, json): the document of a provider as ordered rows, the provider at 0 and each nested model from 1 on.

    A provider has no size bound, so its document stays rows at every size; a writer puts the models between brackets.
    """
    options = {"ignoreNullFields": "false"}
    head = providers.select("slug", F.lit(0).cast("bigint").alias("row"), F.to_json(F.struct("slug", "name", "category", "max_context"), options).alias("json"))
    placed = global_row_number(models.join(providers.select("slug"), "slug").select("slug", "ord", *MODEL_COLUMNS), [F.col("slug").asc(), F.col("ord").asc(), F.col("id").asc()])
    first = placed.groupBy("slug").agg(F.min("position").alias("first"))
    body = placed.join(first, "slug").select("slug", (F.col("position") - F.col("first") + 1).alias("row"), F.to_json(F.struct(*MODEL_COLUMNS), options).alias("json"))
    return head.unionByName(body)


OPTIONAL = [("context", "Context"), ("max_output", "Max Output"), ("modality", "Modality"), ("rate_limit", "Rate Limit")]


def entity_markdown(providers: DataFrame, models: DataFrame) -> DataFrame:
    """Text document lines per provider, ordered by (slug, block, pos, sub).

    A document is kept as lines because a provider has no size bound; blank lines separate blocks.
    Optional model columns appear only when some model of the provider states a value.
    """
    def stated(c: str) -> Column:
        return text.null_if_empty(F.col(c)).isNotNull()

    lines = [
        (1, 0, F.lit(True), F.concat(F.lit("## "), "name")), (1, 1, F.lit(True), F.lit("")),
        (2, 0, stated("url"), F.concat(F.lit("URL: "), "url")), (2, 1, stated("base_url"), F.concat(F.lit("Base URL: "), "base_url")),
        (2, 2, stated("url") | stated("base_url"), F.lit("")),
        (3, 0, stated("description"), F.col("description")), (3, 1, stated("description"), F.lit("")),
        (4, 0, F.size("modalities") > 0, F.concat(F.lit(fixed.DOC_MODALITIES), F.array_join("modalities", ", "))),
        (4, 1, F.size("modalities") > 0, F.lit("")),
        (5, 0, stated("free_limit"), F.concat(F.lit(fixed.DOC_FREE), "free_limit")), (5, 1, stated("free_limit"), F.lit("")),
        (9, 0, stated("more_models"), F.col("more_models")), (9, 1, stated("more_models"), F.lit("")),
        (10, 0, F.lit(True), F.lit(fixed.DOC_SOURCES)), (12, 0, F.lit(True), F.lit("")),
    ]

    def line(block: int, pos: int, cond: Column, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(block).alias("block"), F.lit(pos).cast("bigint").alias("pos"), value.alias("line")))

    fixed_lines = providers.select("slug", F.inline(F.array_compact(F.array(*[line(*x) for x in lines]))))
    refs = providers.select("slug", F.posexplode("sources").alias("at", "s")).select(
        "slug", F.lit(11).alias("block"), F.col("at").cast("bigint").alias("pos"),
        F.concat(F.lit("- "), "s.name", F.lit(" ("), "s.url", F.lit(") — synced "), dates.iso_day(F.col("s.synced_at"))).alias("line"),
    )
    flags = models.groupBy("slug").agg(*[F.bool_or(stated(c)).alias(f"has_{c}") for c, _ in OPTIONAL])

    def row(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    head = row([F.lit("Model")] + [F.when(F.col(f"has_{c}"), F.lit(label)) for c, label in OPTIONAL])
    rule = row([F.lit("---")] + [F.when(F.col(f"has_{c}"), F.lit("---")) for c, _ in OPTIONAL])
    top = flags.select("slug", F.inline(F.array(line(6, 0, F.lit(True), head), line(6, 1, F.lit(True), rule), line(8, 0, F.lit(True), F.lit("")))))
    cells = [text.escape_cell(F.col("name"))] + [
        F.when(F.col(f"has_{c}"), text.escape_cell(F.coalesce(F.col(c), F.lit("-")))) for c, _ in OPTIONAL
    ]
    body = models.join(flags, "slug").select("slug", F.lit(7).alias("block"), F.col("ord").cast("bigint").alias("pos"), row(cells).alias("line"))
    return fixed_lines.unionByName(refs).unionByName(top).unionByName(body)


def index_lines(providers: DataFrame, base: str) -> DataFrame:
    """One line per provider: name, link, model count and the largest context when known."""
    context = text.null_if_empty(F.col("max_context"))
    bits = F.concat_ws(", ", F.concat(F.col("model_count").cast("string"), F.lit(fixed.INDEX_MODELS)), F.concat(F.lit(fixed.INDEX_CONTEXT), context))
    return providers.select(
        "slug", F.concat(F.lit("- ["), "name", F.lit(f"]({base}/provider/"), "slug", F.lit("): "), bits, F.lit(".")).alias("line")
    )


def url_inventory(base: str, providers: DataFrame, facets: DataFrame, clusters: DataFrame, offers: DataFrame, projects_synced_at: str) -> DataFrame:
    """Every published URL with change frequency, priority and last modification.

    ``facets`` has column facet, ``clusters`` column key, ``offers`` slug and sources.
    """
    latest = providers.agg(F.max("synced_at").alias("m")).scalar()
    checked = F.array_max(F.transform("sources", lambda s: s["checked_at"]))
    offers_latest = offers.agg(F.max(checked).alias("m")).scalar()

    def rows(df: DataFrame, path: Column, freq: str, priority: float, modified: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit(base), path).alias("url"), F.lit(freq).alias("change_frequency"),
            F.lit(priority).alias("priority"), modified.cast("string").alias("last_modified"),
        )

    def fixed_route(path: str, freq: str, priority: float, modified: Column) -> DataFrame:
        one = providers.sparkSession.range(1)
        return rows(one, F.lit(path), freq, priority, modified)

    offer_time = F.coalesce(offers_latest.cast("string"), latest)
    parts = [
        fixed_route("", "daily", 1.0, latest),
        fixed_route("/opensource", "daily", 0.9, F.lit(projects_synced_at)),
        rows(providers, F.concat(F.lit("/provider/"), "slug"), "weekly", 0.7, F.coalesce("source_updated_at", "synced_at", latest)),
        rows(facets, F.concat(F.lit("/gratis/"), "facet"), "weekly", 0.6, latest),
        rows(clusters, F.concat(F.lit("/model/"), "key"), "weekly", 0.6, latest),
        fixed_route("/changelog", "daily", 0.5, latest),
        fixed_route("/pilih", "weekly", 0.8, latest),
        fixed_route("/fallback", "weekly", 0.7, latest),
        fixed_route("/modal-gratis", "weekly", 0.9, offer_time),
        rows(offers, F.concat(F.lit("/modal-gratis/"), "slug"), "monthly", 0.6, checked),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""HTML tables read by header label. A missing required column is an error, never a neighbouring one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import fixed, text
from weftline.functions.text import WS


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def header_labels(html: Column) -> Column:
    """Normalised <th> labels of the first <thead>; NULL without a <thead>."""
    thead = text.first_match(html, r"(?is)<thead[\s>].*?</thead>", 0)
    return F.transform(_all(thead, r"(?is)<th(?:\s[^>]*)?>.*?</th>"), lambda th: text.header_key(text.html_text_of(th)))


def column_position(labels: Column, aliases: list[str]) -> Column:
    """1-based position of the first alias present; NULL when none is."""
    return F.coalesce(*[F.nullif(F.array_position(labels, F.lit(a)), F.lit(0)) for a in aliases])


def html_table_header_map(pages: DataFrame, columns: dict[str, list[str]], required: str, html: str = "html") -> DataFrame:
    """Adds ``<name>_at`` per column and ``header_error``."""
    out = pages.withColumn("labels", header_labels(F.col(html)))
    for name, aliases in columns.items():
        out = out.withColumn(f"{name}_at", column_position(F.col("labels"), aliases))
    return out.withColumn(
        "header_error",
        F.when(F.col("labels").isNull(), "no-thead")
        .when(F.size("labels") == 0, "no-headers")
        .when(F.col(f"{required}_at").isNull(), f"no-{required}-column"),
    )


def _cell(cells: Column, at: Column) -> Column:
    return F.try_element_at(cells, at.cast("int"))


def _stated(c: Column) -> Column:
    """Clean text where a bare 0 means nothing."""
    clean = text.clean_str(c)
    return F.when(clean != "0", clean)


CATALOGUE_COLUMNS = {
    "context": fixed.CONTEXT_HEADERS,
    "max_output": fixed.MAX_OUTPUT_HEADERS,
    "rate_limit": fixed.RATE_LIMIT_HEADERS,
}


def html_table_rows(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Attribute rows: provider and modality from <tr> attributes, cells by mapped header.

    Pages are dealt out before they are parsed, as many small ones fit into one split of a file. Every page's rows are
    exploded; the first row of a (page, provider, id) wins.
    """
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ats = [f"{c}_at" for c in CATALOGUE_COLUMNS]
    # A generated row, so that the filter reads the header instead of parsing it again before pages are dealt out.
    header = F.inline(F.array(F.struct(*ats, "header_error")))
    mapped = html_table_header_map(pages, CATALOGUE_COLUMNS, "context", html).select(page, html, header).where("header_error is null")
    body = F.regexp_extract(F.col(html), r"(?s)<tbody.*</tbody>", 0)
    rows = mapped.select(page, *ats, F.posexplode(_all(body, r"(?s)<tr[\s>].*?</tr>")).alias("pos", "tr"))
    attrs = F.substring_index("tr", ">", 1)
    cells = F.col("cells")
    name_cell = _cell(cells, F.lit(2))
    link = r'(?s)<a[^>]+class="model-link"[^>]*>(.*?)</a>'
    any_link = r"(?s)<a[^>]*>(.*?)</a>"
    tags = F.array_join(
        F.filter(F.transform(F.split("modality_attr", ","), text.trim_all), lambda t: t != ""), " + "
    )
    rate = text.html_text_of(_cell(cells, F.col("rate_limit_at")))
    parsed = (
        rows.withColumn("provider", text.null_if_empty(F.regexp_extract(attrs, r'data-provider="([^"]*)"', 1)))
        .withColumn("modality_attr", F.regexp_extract(attrs, r'data-modality="([^"]*)"', 1))
        .withColumn("cells", _all(F.col("tr"), r"(?s)<td(?:\s[^>]*)?>.*?</td>"))
        .withColumn("name", text.html_text_of(F.coalesce(text.first_match(name_cell, link), text.first_match(name_cell, any_link), name_cell)))
        .where("provider is not null and name is not null and name <> ''")
        .where(~text.is_junk_name(F.col("name")))
        .select(
            page, "pos", "provider", text.canonical_slug(F.col("provider")).alias("slug"),
            text.slugify(F.col("name")).alias("id"), "name",
            _stated(text.html_text_of(_cell(cells, F.col("context_at")))).alias("context"),
            _stated(text.html_text_of(_cell(cells, F.col("max_output_at")))).alias("max_output"),
            tags.alias("modality"),
            F.when(~rate.rlike(rf"(?i)\Asee{WS}+provider{WS}+page\z"), text.clean_str(rate)).alias("rate_limit"),
        )
    )
    kept = ["pos", "name", "context", "max_output", "modality", "rate_limit"]
    return (
        parsed.groupBy(page, "provider", "slug", "id")
        .agg(F.min_by(F.struct(*kept), "pos").alias("f"))
        .select(page, "provider", "slug", "id", "f.*")
    )


SIMPLE_COLUMNS = {"name": fixed.MODEL_NAME_HEADERS, "limits": fixed.MODEL_LIMIT_HEADERS}


def html_table_simple_rows(tables: DataFrame, keys: list[str], html: str = "table_html") -> DataFrame:
    """Two-column tables embedded in a text: model name and optional limits."""
    bare = tables.withColumn(html, F.col(html))
    mapped = html_table_header_map(bare, SIMPLE_COLUMNS, "name", html).where("header_error is null")
    body = F.coalesce(text.first_match(F.col(html), r"(?is)<tbody[\s>].*?</tbody>", 0), F.col(html))
    rows = mapped.select(*keys, "name_at", "limits_at", F.posexplode(_all(body, r"(?is)<tr[\s>].*?</tr>")).alias("pos", "tr"))
    cells = _all(F.col("tr"), r"(?is)<td(?:\s[^>]*)?>(.*?)</td>", 1)
    limits = text.squeeze(
        F.regexp_replace(F.regexp_replace(_cell(F.col("cells"), F.col("limits_at")), r"(?i)<br\s*/?>", ", "), "<[^>]+>", "")
    )
    name = text.trim_all(text.decode_entities(F.regexp_replace(_cell(F.col("cells"), F.col("name_at")), "<[^>]+>", "")))
    return (
        rows.withColumn("cells", cells)
        .withColumn("name", name)
        .where("name is not null and name <> ''")
        .where(~text.is_note(F.col("name")) & ~text.is_section_descriptor(F.col("name")))
        .select(*keys, "pos", text.slugify(F.col("name")).alias("id"), "name", text.clean_str(limits).alias("rate_limit"))
    )

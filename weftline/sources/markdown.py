"""Markdown catalogues: sections, provider blocks, bullets and labelled limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.text import LINK, WS, WS_SET
from weftline.sources.html_tables import html_table_simple_rows


def _sections(docs: DataFrame, keys: list[str], body: str, mark: str, pos: str) -> DataFrame:
    """Parts of a text at headings of one level; part 0 is the text before the first heading."""
    parts = docs.select(*keys, F.posexplode(F.split(F.col(body), rf"(?m)^{mark} (?=.)", -1)).alias(pos, "part"))
    head = F.regexp_extract("part", r"\A(.*)", 1)
    return parts.select(
        *keys, pos,
        F.when(F.col(pos) > 0, text.trim_all(head)).alias("heading"),
        F.when(F.col(pos) > 0, F.substr("part", F.length(head) + 1)).otherwise(F.col("part")).alias("body"),
    )


def markdown_sections(docs: DataFrame, keys: list[str], body: str = "text") -> DataFrame:
    """Second-level sections; the text before the first heading is ``__preamble__``."""
    parts = _sections(docs, keys, body, "##", "section")
    return parts.withColumn("heading", F.coalesce("heading", F.lit("__preamble__")))


def markdown_blocks(sections: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Third-level blocks of each section; text before the first block is left out."""
    return _sections(sections, keys, body, "###", "block").where("block > 0")


def free_sections(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Per document the first section about free providers that is not about trials."""
    heading = F.lower("heading")
    wanted = sections.where(heading.contains("free providers") & ~heading.contains("trial"))
    return (
        wanted.groupBy(*keys)
        .agg(F.min_by(F.struct("section", "heading", "body"), "section").alias("s"))
        .select(*keys, "s.*")
    )


def heading_name(heading: Column) -> Column:
    linked = text.first_match(heading, rf"\A{LINK}", 1)
    plain = F.regexp_replace(heading, rf"{WS}*\(.*?\){WS}*\z", "")
    return text.trim_all(F.coalesce(linked, plain))


def heading_url(heading: Column) -> Column:
    return text.safe_url(text.trim_all(text.first_match(heading, r"\A\[[^\]]+\]\(([^)]+)\)", 1)))


def limits_text(c: Column) -> Column:
    unlinked = F.regexp_replace(c, LINK, "$1")
    return text.clean_str(text.squeeze(F.regexp_replace(unlinked, rf"(?i)<br{WS}*/?>", ", ")))


def labelled_limits(body: Column) -> Column:
    """Value of a **Limits** label: up to a blank line or the next marker, else the rest of the line."""
    label = rf"\*\*Limits[^*]*\*\*[:{WS_SET}]*"
    block = rf"(?s){label}(.*?)(?:\n\n|\n(?=[*#\-]|\z))"
    inline = rf"{label}(.+)"
    return limits_text(F.when(body.rlike(block), F.regexp_extract(body, block, 1)).otherwise(text.first_match(body, inline, 1)))


def prose_line(body: Column) -> Column:
    """First line that is neither markup nor boilerplate."""
    skip = rf"(?i)\A[*#<|>!\-]|\AModels{WS}*share|<br|\ARoutes{WS}+to"
    lines = F.transform(F.split(body, "\n"), text.trim_all)
    return text.clean_str(F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.rlike(skip)), F.lit(1)))


def markdown_bullets(blocks: DataFrame, keys: list[str], body: str = "body", limit: str | None = "shared_limit") -> DataFrame:
    """Bullet items as models; notes and section descriptors are left out."""
    lines = blocks.select(
        *keys, *([limit] if limit else []), F.posexplode(F.split(F.col(body), "\n")).alias("pos", "raw")
    ).withColumn("line", text.trim_all(F.col("raw")))
    name = text.trim_all(F.regexp_replace(text.trim_all(F.substr("line", F.lit(3))), rf"\A{LINK}", "$1"))
    return (
        lines.where(F.col("line").startswith("- ") | F.col("line").startswith("* "))
        .withColumn("name", name)
        .where("name <> ''")
        .where(~text.is_note(F.col("name")) & ~text.is_section_descriptor(F.col("name")))
        .select(
            *keys, "pos", text.slugify(F.col("name")).alias("id"), "name",
            (F.col(limit) if limit else F.lit(None).cast("string")).alias("rate_limit"),
        )
    )


def provider_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Provider-level fields of each block."""
    return (
        blocks.withColumn("name", heading_name(F.col("heading")))
        .where("name <> ''")
        .select(
            *keys,
            text.canonical_slug(text.slug_name(F.col("name"))).alias("slug"), "name",
            heading_url(F.col("heading")).alias("url"),
            prose_line(F.col("body")).alias("description"),
        )
    )


def dispatch_by_format(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Models of each block: from its table when it has one, else from its bullets."""
    table = text.first_match(F.col("body"), r"(?is)<table.*?</table>", 0)
    marked = blocks.withColumn("table_html", table)
    from_tables = html_table_simple_rows(marked.where("table_html is not null"), keys)
    bulleted = marked.where("table_html is null").withColumn("shared_limit", labelled_limits(F.col("body")))
    from_bullets = markdown_bullets(bulleted, keys)
    rows = from_tables.unionByName(from_bullets)
    return (
        rows.groupBy(*keys, "id")
        .agg(F.min_by(F.struct("pos", "name", "rate_limit"), "pos").alias("f"))
        .select(*keys, "id", "f.*")
    )

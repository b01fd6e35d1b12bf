"""Modality facets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import fixed
from weftline.functions.text import null_if_empty, text_or_empty, trim_all

# Facets in the order they are tested: text comes last.
TEST_ORDER = [f for f in fixed.MODALITY_ORDER if f != "text"] + ["text"]


def clean_modality(c: Column) -> Column:
    return null_if_empty(trim_all(c))


def has_facet(c: Column, facet: str) -> Column:
    """NULL modality matches nothing."""
    return F.lower(text_or_empty(c)).rlike(fixed.FACET_WORDS[facet])


def facets_of(c: Column) -> Column:
    flags = [F.when(has_facet(c, f), F.lit(f)) for f in TEST_ORDER]
    return F.array_compact(F.array(*flags))


def has_any_facet(c: Column) -> Column:
    """Whether a facet is found; the search ends with the first."""
    return reduce(or_, [has_facet(c, f) for f in fixed.MODALITY_ORDER])


def facet_flags(c: Column) -> dict[str, Column]:
    """One boolean per facet; aggregates with bool_or, so no set is collected."""
    return {f: has_facet(c, f) for f in fixed.MODALITY_ORDER}


def ordered_facets(flags: dict[str, Column]) -> Column:
    """Facets whose flag is true, in canonical order."""
    return F.array_compact(F.array(*[F.when(flags[f], F.lit(f)) for f in fixed.MODALITY_ORDER]))


def any_facets(modality: Column) -> Column:
    """Aggregate: the facets any row of the group carries."""
    return ordered_facets({f: F.bool_or(flag) for f, flag in facet_flags(modality).items()})


def modality_from_array(c: Column) -> Column:
    words = [("text", "Text"), ("image", "Vision"), ("audio", "Audio"), ("video", "Video")]
    parts = [F.when(F.array_contains(c, word), F.lit(label)) for word, label in words]
    return null_if_empty(F.concat_ws(" + ", *parts))


def facet_position(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in fixed.MODALITY_ORDER]), c)

"""String hygiene, keys, URLs and markup as column expressions.

Whitespace is Unicode whitespace throughout, and word boundaries are ASCII: both are written
out because Java's defaults differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import fixed

# One whitespace character, and the same set inside a character class.
WS_SET = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{WS_SET}]"
# The same characters as plain text, for trimming without a regex.
WS_CHARS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
# ASCII word boundary before / after a word character.
WB = "(?<![A-Za-z0-9_])"
WE = "(?![A-Za-z0-9_])"

_HOST = r"[^/\\?#:@<>^|%\[\]\x00-\x20]+|\[[0-9a-fA-F:.]+\]"
_AUTHORITY = r"[/\\]*(?:[^/\\?#@]*@)?(" + _HOST + r")(?::[0-9]*)?(?:[/\\?#].*)?[\x00-\x20]*\z"
HTTP_URL = r"(?is)\A[\x00-\x20]*https?:" + _AUTHORITY
ANY_URL = r"(?is)\A[\x00-\x20]*[a-z][a-z0-9+.\-]*:" + _AUTHORITY

LINK = r"\[([^\]]+)\]\([^)]+\)"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group of the first match, NULL when nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def drop_first(c: Column, pattern: str) -> Column:
    """Remove only the first match of a pattern."""
    return F.regexp_replace(c, f"(?s)\\A(.*?)(?:{pattern})(.*)\\z", "$1$2")


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return null_if_empty(trim_all(c))


def is_blank(c: Column) -> Column:
    """NULL, empty or only whitespace."""
    return ~F.coalesce(c.rlike(f"[^{WS_SET}]"), F.lit(False))


def clean_str(c: Column) -> Column:
    trimmed = blank_to_null(c)
    return F.when(~trimmed.isin(fixed.SENTINELS), trimmed)


def strip_md_links(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "!?" + LINK, "$1"), "`([^`]+)`", "$1")


def safe_url(c: Column) -> Column:
    """The URL when it is absolute http(s) with a host, else NULL."""
    return F.when(c.rlike(HTTP_URL), c)


def slugify(c: Column) -> Column:
    lowered = F.lower(text_or_empty(c))
    dashed = F.regexp_replace(F.translate(lowered, "()", ""), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]", "")


header_key = alnum_key


def canonical_slug(c: Column) -> Column:
    """Slug of a name after resolving known other spellings; the table has a fixed size."""
    slug = slugify(c)
    table = F.create_map(*[F.lit(part) for pair in fixed.SLUG_ALIASES.items() for part in pair])
    return F.coalesce(F.try_element_at(table, slug), slug)


def slug_name(c: Column) -> Column:
    return trim_all(drop_first(c, rf"(?i:{WS}*\({WS}*La{WS}+Plateforme{WS}*\))"))


def _code_unit(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n % 65536), 4, "0")), "UTF-16BE")


def decode_entities(c: Column) -> Column:
    """Named entities in fixed order, then numeric ones; each distinct numeric entity is replaced once."""
    named = c
    for entity, char in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]:
        named = F.replace(named, F.lit(entity), F.lit(char))
    codes = F.array_distinct(F.regexp_extract_all(named, F.lit("&#([0-9]+|[xX][0-9a-fA-F]+);"), F.lit(1)))

    def number(x: Column) -> Column:
        hexed = x.rlike("^[xX]")
        return F.coalesce(F.when(hexed, F.conv(F.substr(x, F.lit(2)), 16, 10)).otherwise(x).try_cast("bigint"), F.lit(0))

    def put(acc: Column, x: Column) -> Column:
        # "&" itself comes last, so that it forms no new entity.
        return F.when(x == "38", acc).otherwise(F.replace(acc, F.concat(F.lit("&#"), x, F.lit(";")), _code_unit(number(x))))

    return F.replace(F.aggregate(codes, named, put), F.lit("&#38;"), F.lit("&"))


def html_text_of(c: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")))


def _bare_model_name(c: Column) -> Column:
    """Lower-cased name without path, free markers, vendor words and cosmetic suffixes."""
    last = F.substring_index(trim_all(F.lower(text_or_empty(c))), "/", -1)
    # One look tells whether any of the steps below finds something to drop.
    plain = ~last.rlike(rf"free|:|{'|'.join(fixed.COSMETIC_SUFFIXES)}|\A(?:{'|'.join(fixed.VENDORS)})")
    paid = F.regexp_replace(last, rf"\(free\)|:free{WE}|{WB}free{WE}", " ")
    unprefixed = F.regexp_replace(paid, rf"\A[a-z0-9.{WS_SET}]+:{WS}*", "")
    unbranded = F.regexp_replace(unprefixed, rf"\A(?:{'|'.join(fixed.VENDORS)})[{WS_SET}:]+", "")
    return F.when(plain, last).otherwise(F.regexp_replace(unbranded, rf"[-_{WS_SET}]?(?:{'|'.join(fixed.COSMETIC_SUFFIXES)}){WE}", ""))


def model_key(c: Column) -> Column:
    return F.regexp_replace(_bare_model_name(c), "[^a-z0-9]+", "")


def cluster_key(c: Column) -> Column:
    return F.btrim(F.regexp_replace(_bare_model_name(c), "[^a-z0-9]+", "-"), F.lit("-"))


def enrich_norm_key(c: Column) -> Column:
    key = F.regexp_replace(trim_all(F.lower(text_or_empty(c))), r"\A@", "")
    return F.regexp_replace(F.regexp_replace(key, r":free\z", ""), r"\A[^/]+/", "")


def candidate_keys(model_id: Column, name: Column) -> Column:
    """Distinct lookup keys a model may be listed under."""
    mid, nm = text_or_empty(model_id), text_or_empty(name)
    paid = r"(?i):free\z"
    vendor = r"\A[^/]+/"
    from_id = [
        mid,
        F.regexp_replace(mid, paid, ""),
        F.regexp_replace(mid, vendor, ""),
        F.regexp_replace(F.regexp_replace(mid, vendor, ""), paid, ""),
    ]
    from_name = [nm, F.regexp_replace(nm, paid, ""), F.regexp_replace(nm, vendor, "")]
    differs = F.lower(nm) != F.lower(mid)
    keys = [enrich_norm_key(k) for k in from_id]
    keys += [F.when(differs, enrich_norm_key(k)) for k in from_name]
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull() & (k != "")))


def _registrable(host: Column) -> Column:
    bare = F.regexp_replace(F.lower(host), r"\Awww\.", "")
    parts = F.split(bare, r"\.")
    second = rf"\A.*?(?:[^.]+\.(?:{'|'.join(fixed.SECOND_LEVEL)})\.[A-Za-z0-9_]{{2,3}})\z"
    n = F.size(parts)
    tail3 = F.array_join(F.slice(parts, -3, 3), ".")
    tail2 = F.array_join(F.slice(parts, -2, 2), ".")
    return F.when(n <= 2, bare).when(bare.rlike(second), tail3).otherwise(tail2)


def domain_of(*urls: Column) -> Column:
    """Registrable domain of the first URL that parses."""
    hosts = [first_match(u, ANY_URL) for u in urls]
    return _registrable(F.coalesce(*hosts))


def domain_from_name(c: Column) -> Column:
    name = F.lower(trim_all(c))
    return F.when(name.rlike(r"\A[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,24}\z"), name)


def domain_for(slug: Column, name: Column, url: Column, base_url: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in fixed.DOMAIN_ALIASES.items() for part in pair])
    return F.coalesce(domain_of(url, base_url), domain_from_name(name), F.try_element_at(table, slug))


def license_clean(c: Column) -> Column:
    return F.when(~c.isin(fixed.EMPTY_LICENSES), c)


def looks_like_raw_id(c: Column) -> Column:
    return c.contains("/") | c.startswith("@")


def has_markup_or_entity(c: Column) -> Column:
    tag = r"</?[a-zA-Z!][^>]*>"
    entity = r"(?i)&(?:amp|lt|gt|quot|#39|nbsp|#[0-9]+|#x[0-9a-f]+);"
    return F.coalesce((c.contains("<") & c.rlike(tag)) | (c.contains("&") & c.rlike(entity)), F.lit(False))


def escape_xml(c: Column) -> Column:
    out = c
    for raw, escaped in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def escape_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def is_note(c: Column) -> Column:
    return c.rlike(rf"(?i)\A(?:{'|'.join(fixed.NOTE_OPENINGS)})")


def is_section_descriptor(c: Column) -> Column:
    """Ends with the word "models" and carries no version token."""
    name = text_or_empty(c)
    return name.rlike(rf"(?i){WB}models{WS}*\z") & ~name.rlike(r"[0-9\-/]")


def is_junk_name(c: Column) -> Column:
    return F.lower(c).isin(fixed.JUNK_NAMES)


def valid_email(c: Column) -> Column:
    return c.rlike(rf"\A[^@{WS_SET}]+@[^@{WS_SET}]+\.[^@{WS_SET}]+\z")

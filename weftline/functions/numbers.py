"""Sizes, limits and scores read from source text. The text stays; numbers are derived views."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import facets
from weftline.functions.text import (
    WB, WE, WS, first_match, is_blank, null_if_empty, text_or_empty, trim_all,
)

_LEADING_FLOAT = r"\A([0-9]+\.?[0-9]*|\.[0-9]+)"


def _float_prefix(c: Column) -> Column:
    return null_if_empty(F.regexp_extract(c, _LEADING_FLOAT, 1)).try_cast("double")


def ctx_num(c: Column) -> Column:
    """First number anywhere times its K/M/B unit; 0 when there is none."""
    pattern = rf"([0-9.]+){WS}*([KkMmBb]?)"
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    factor = F.when(unit == "k", F.lit(1e3)).when(unit == "m", F.lit(1e6)).when(unit == "b", F.lit(1e9)).otherwise(F.lit(1.0))
    return F.coalesce(_float_prefix(F.regexp_extract(c, pattern, 1)) * factor, F.lit(0.0))


def parse_context_tokens(c: Column) -> Column:
    """Whole text is a number with an optional K or M; NULL otherwise."""
    text = F.upper(trim_all(c))
    pattern = rf"\A([0-9.]+){WS}*([KM])?\z"
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.when(unit == "M", F.lit(1e6)).when(unit == "K", F.lit(1e3)).otherwise(F.lit(1.0))
    return F.when(text.rlike(pattern), _float_prefix(F.regexp_extract(text, pattern, 1)) * factor)


def clean_ctx_str(c: Column) -> Column:
    bare = F.regexp_replace(trim_all(c), rf"(?i)\Aup{WS}+to{WS}+", "")
    return F.regexp_replace(bare, rf"([0-9]+)\.0+{WS}*([KkMmBb]){WE}", "$1$2")


def plain_number(n: Column) -> Column:
    """Digits as written: whole numbers without a fraction."""
    whole = n.cast("bigint")
    return F.when(n == whole, whole.cast("string")).otherwise(n.cast("string"))


def fmt_tokens(n: Column) -> Column:
    """Shorten only when nothing is lost."""
    def exact(step: int, unit: str) -> tuple[Column, Column]:
        return (n >= step) & (n % step == 0), F.concat((n / step).cast("bigint").cast("string"), F.lit(unit))

    steps = [exact(1_000_000, "M"), exact(1_000, "K"), exact(1 << 20, "M"), exact(1 << 10, "K")]
    out = F.when(n.isNull() | (n <= 0), F.lit(None).cast("string"))
    for cond, text in steps:
        out = out.when(cond, text)
    return out.otherwise(plain_number(n))


def fmt_context(n: Column) -> Column:
    millions = n / F.lit(1e6)
    fixed3 = F.round(millions, 3).cast("decimal(30,3)").cast("string")
    short = F.when(millions % 1 == 0, plain_number(millions)).otherwise(F.regexp_replace(fixed3, r"\.?0+$", ""))
    return (
        F.when(n.isNull() | (n == 0), F.lit(None).cast("string"))
        .when(n >= 1_000_000, F.concat(short, F.lit("M")))
        .when(n >= 1_000, F.concat(F.floor(n / F.lit(1e3) + 0.5).cast("string"), F.lit("K")))
        .otherwise(plain_number(n))
    )


def no_token_context(modality: Column, model_id: Column, name: Column) -> Column:
    """Embedding, reranking and transcription models have no token window."""
    s = F.lower(F.concat_ws(" ", text_or_empty(modality), text_or_empty(model_id), text_or_empty(name)))
    return s.rlike(
        "embed|rerank|whisper|transcrib|speech.?to.?text"
        rf"|{WB}stt{WE}|audio{WS}*(?:→|->|to){WS}*text"
    )


_AMOUNT = r"([0-9,]+(?:\.[0-9]+)?)"
PER_DAY = rf"(?i){_AMOUNT}{WS}*(?:rpd|requests?{WS}*/{WS}*day|req(?:uests?)?{WS}*/{WS}*day|requests?{WS}+per{WS}+day)"
PER_MINUTE = (
    rf"(?i){_AMOUNT}{WS}*(?:rpm|requests?{WS}*/{WS}*min(?:ute)?|req(?:uests?)?{WS}*/{WS}*min|requests?{WS}+per{WS}+minute)"
)
UNLIMITED = rf"(?i){WB}unlimited{WE}|no hard cap|no cap{WE}"


def _amount(c: Column, pattern: str) -> Column:
    return _float_prefix(F.translate(first_match(c, pattern), ",", ""))


def rate_limit_raw(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def rate_limit_unlimited(c: Column) -> Column:
    return F.coalesce(rate_limit_raw(c).rlike(UNLIMITED), F.lit(False))


def rate_limit_per_day(c: Column) -> Column:
    """Requests per day: the smaller of the daily and the per-minute statement; NULL when unstated."""
    raw = rate_limit_raw(c)
    return F.least(_amount(raw, PER_DAY), _amount(raw, PER_MINUTE) * 1440)


def parse_rate_limit(c: Column) -> Column:
    return F.struct(
        rate_limit_raw(c).alias("raw"),
        rate_limit_per_day(c).alias("per_day"),
        rate_limit_unlimited(c).alias("unlimited"),
    )


def rate_limit_score(c: Column) -> Column:
    return (
        F.when(rate_limit_unlimited(c), F.lit(float("inf")))
        .otherwise(F.coalesce(rate_limit_per_day(c), F.lit(-1.0)))
    )


def score_linear(modality: Column, context: Column, max_output: Column, rate_limit: Column, wanted: str | None) -> Column:
    """Modality match, then rate-limit generosity, context size and a stated output size."""
    match = F.when(facets.has_facet(modality, wanted), F.lit(100_000.0)).otherwise(F.lit(0.0)) if wanted else F.lit(0.0)
    rl = rate_limit_score(rate_limit)
    generosity = F.when(rl == math.inf, F.lit(10_000.0)).when(rl > 0, F.log10(rl + 1) * 100).otherwise(F.lit(0.0))
    cn = ctx_num(context)
    window = F.when(cn > 0, F.log10(cn + 1) * 10).otherwise(F.lit(0.0))
    stated = F.when(null_if_empty(max_output).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    return match + generosity + window + stated


def _period(c: Column) -> Column:
    return (
        F.when(c.rlike(rf"(?i)/{WS}*day|per{WS}+day|daily"), F.lit("/hari"))
        .when(c.rlike(rf"(?i)/{WS}*month|per{WS}+month|monthly"), F.lit("/bln"))
        .otherwise(F.lit(""))
    )


def free_limit_of(c: Column) -> Column:
    """Short free-allowance label stated by a description; the first rule that applies decides."""
    money = r"\$[0-9,]+(?:\.[0-9]+)?"
    passing = rf"(?i)one[- ]?time|expir|trial|sign[- ]?up{WS}+credit"
    tokens = rf"(?i)([~]?[0-9.,]+{WS}*[KMB]){WE}[^.]*?tokens?({WS}*/{WS}*[A-Za-z0-9_]+)?"
    credits = rf"(?i)([0-9.,]+{WS}*[KMB]){WE}[^.]*?credits?"

    def squashed(pattern: str) -> Column:
        return F.regexp_replace(F.regexp_extract(c, pattern, 1), f"{WS}+", "")

    def labelled(pattern: str, suffix: Column) -> tuple[Column, Column]:
        return c.rlike(pattern), F.concat(F.regexp_extract(c, pattern, 1), suffix)

    rules = [
        (c.rlike(money) & c.rlike(passing), F.lit(None).cast("string")),
        (c.rlike(money), F.concat(F.regexp_extract(c, money, 0), F.lit(" kredit"))),
        (c.rlike(tokens), F.concat(squashed(tokens), F.lit(" token"), _period(F.regexp_extract(c, tokens, 0)))),
        (c.rlike(credits), F.concat(squashed(credits), F.lit(" kredit"), _period(F.regexp_extract(c, credits, 0)))),
        labelled(rf"(?i)([0-9,]+){WS}*(?:API{WS}+)?calls?", F.concat(F.lit(" calls"), _period(c))),
        labelled(rf"(?i)([0-9,]+){WS}*Neurons?", F.lit(" Neurons/hari")),
        labelled(rf"(?i)([0-9,]+){WS}*req(?:uests?)?{WS}*/?{WS}*day", F.lit(" req/hari")),
        labelled(rf"(?i)([0-9,]+){WS}*RPM(?:{WS}*(?:per IP|/IP))?", F.lit(" RPM/IP")),
        labelled(rf"(?i)([~]?[0-9]+\+?){WS}*(?:permanently{WS}+)?free models?", F.lit(" model free")),
        (c.rlike("(?i)permanent"), F.lit("Free (permanen)")),
        (c.rlike("(?i)no (registration|signup|sign-up)"), F.lit("Free, no signup")),
    ]
    out = F.when(is_blank(c), F.lit(None).cast("string"))
    for cond, value in rules:
        out = out.when(cond, value)
    return out


_SIZE = rf"[0-9]+(?:\.[0-9]+)?{WS}*[KMB]"
# One pattern, so that guards with many rules stay small plans: a word, or an optional "up to" or "~",
# then a size with unit or a whole number of at least 1000, then anything in parentheses.
CONTEXT_LIKE = (
    rf"(?is)\A{WS}*(?:varies|model-dependent|unlimited|configurable|shared{WS}*w/?{WS}*context"
    rf"|(?:(?:up{WS}+to|~){WS}*)?(?:~{WS}*)?(?:{_SIZE}|0*[1-9][0-9]{{3,}}){WS}*(?:\(.*)?){WS}*\z"
)
RATE_LIKE = (
    "(?i)unlimited|community-powered|credit-metered|preview limits|dependent on|no hard cap|session/weekly"
    rf"|see{WS}+provider{WS}+page|[0-9][0-9,.]*{WS}*[KMB]?{WS}*(?:RPM|RPD|RPS|TPM|TPD|TPS){WE}"
    rf"|{WB}requests?{WE}.*/|/{WS}*(?:minute|hour|day|month){WE}|{WB}calls?{WE}|{WB}neurons?{WE}"
)


def looks_like_context(c: Column) -> Column:
    return F.coalesce(c.rlike(CONTEXT_LIKE), F.lit(False))


def looks_like_rate_limit(c: Column) -> Column:
    return F.coalesce(c.rlike(RATE_LIKE), F.lit(False))


def is_bare_size(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"(?i)\A{WS}*{_SIZE}{WS}*\z"), F.lit(False))


def reconcile_more_note(note: Column, model_count: Column) -> Column:
    """Drop a "+N more" note once the merged list covers N; other notes stay."""
    text = null_if_empty(note)
    claimed = F.translate(first_match(text, rf"(?i)([0-9][0-9,]*){WS}*(?:more|additional)"), ",", "").try_cast("bigint")
    return F.when(claimed.isNull() | (claimed > model_count), text)

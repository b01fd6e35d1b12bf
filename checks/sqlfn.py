"""The scalar functions written a second time, as SQL text for the comparison engine (RE2 regexes)."""

from __future__ import annotations

from weftline.functions import fixed

W = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WIN = W[1:-1]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(x: str, pat: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(to)}, 'g')"


def rep1(x: str, pat: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(to)})"


def has(x: str, pat: str) -> str:
    return f"regexp_matches({x}, {q(pat)})"


def ext(x: str, pat: str, g: int = 1) -> str:
    """NULL when there is no match."""
    return f"(CASE WHEN regexp_matches({x}, {q(pat)}) THEN regexp_extract({x}, {q(pat)}, {g}) END)"


def low(x: str) -> str:
    return f"lower(coalesce({x}, ''))"


def trim(x: str) -> str:
    return rep(x, f"^{W}+|{W}+$")


def squeeze(x: str) -> str:
    return f"trim({rep(x, W + '+', ' ')})"


def blank_null(x: str) -> str:
    return f"nullif({trim(x)}, '')"


def clean_str(x: str) -> str:
    bad = ", ".join(q(s) for s in fixed.SENTINELS)
    t = blank_null(x)
    return f"(CASE WHEN {t} NOT IN ({bad}) THEN {t} END)"


def strip_links(x: str) -> str:
    return rep(rep(x, r"!?\[([^\]]+)\]\([^)]+\)", r"\1"), "`([^`]+)`", r"\1")


HOST = r"([^/\\?#:@<>^|%\[\]\x00-\x20]+|\[[0-9a-fA-F:.]+\])"
AUTH = r"[/\\]*(?:[^/\\?#@]*@)?" + HOST + r"(?::[0-9]*)?(?:[/\\?#].*)?[\x00-\x20]*$"
HTTP = r"(?is)^[\x00-\x20]*https?:" + AUTH
ANY = r"(?is)^[\x00-\x20]*[a-z][a-z0-9+.\-]*:" + AUTH


def safe_url(x: str) -> str:
    return f"(CASE WHEN {has(x, HTTP)} THEN {x} END)"


def slugify(x: str) -> str:
    return rep(rep(rep(low(x), "[()]"), "[^a-z0-9]+", "-"), "^-+|-+$")


def alnum(x: str) -> str:
    return rep(low(x), "[^a-z0-9]")


def canonical_slug(x: str) -> str:
    s = slugify(x)
    rows = ", ".join(f"{q(a)}: {q(slug)}" for a, slug in fixed.SLUG_ALIASES.items())
    return f"coalesce((MAP {{{rows}}})[{s}], {s})"


def bare_model(x: str) -> str:
    last = f"split_part({trim(low(x))}, '/', -1)"
    s = rep(last, r"\(free\)|:free\b|\bfree\b", " ")
    s = rep(s, rf"^[a-z0-9.{WIN}]+:{W}*")
    s = rep(s, rf"^(?:{'|'.join(fixed.VENDORS)})[{WIN}:]+")
    return rep(s, rf"[-_{WIN}]?(?:instruct|chat|preview|latest)\b")


def model_key(x: str) -> str:
    return rep(bare_model(x), "[^a-z0-9]+")


def cluster_key(x: str) -> str:
    return rep(rep(bare_model(x), "[^a-z0-9]+", "-"), "^-+|-+$")


def norm_key(x: str) -> str:
    return rep(rep(rep(trim(low(x)), "^@"), ":free$"), "^[^/]+/")


def candidate_keys(i: str, n: str) -> str:
    """SQL list of distinct candidate keys."""
    i, n = f"coalesce({i}, '')", f"coalesce({n}, '')"
    paid, ven = "(?i):free$", "^[^/]+/"
    ks = [norm_key(v) for v in (i, rep(i, paid), rep(i, ven), rep(rep(i, ven), paid))]
    ks += [f"CASE WHEN lower({n}) <> lower({i}) THEN {norm_key(v)} END" for v in (n, rep(n, paid), rep(n, ven))]
    return f"list_sort(list_distinct(list_filter([{', '.join(ks)}], lambda k: k IS NOT NULL AND k <> '')))"


def domain_of(x: str) -> str:
    host = rep(f"lower({ext(x, ANY)})", r"^www\.")
    return registrable(host)


def registrable(host: str) -> str:
    second = rf"^(?:{'|'.join(fixed.SECOND_LEVEL)})\.[A-Za-z0-9_]{{2,3}}$"
    parts = f"string_split({host}, '.')"
    return (
        f"(CASE WHEN len({parts}) <= 2 THEN {host} "
        f"WHEN regexp_matches(array_to_string({parts}[-2:], '.'), {q(second)}) THEN array_to_string({parts}[-3:], '.') "
        f"ELSE array_to_string({parts}[-2:], '.') END)"
    )


def domain_name(x: str) -> str:
    t = f"lower({trim(x)})"
    return f"(CASE WHEN {has(t, r'^[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,24}$')} THEN {t} END)"


def domain_for(slug: str, name: str, url: str, base: str) -> str:
    return f"coalesce({domain_of(url)}, {domain_of(base)}, {domain_name(name)}, CASE WHEN {slug} = 'xai' THEN 'x.ai' END)"


def facet(x: str, f: str) -> str:
    words = {"code": r"\bcode\b"}.get(f, fixed.FACET_WORDS[f])
    return has(low(x), words)


def facet_list(cond) -> str:
    """List of facets in canonical order; cond maps a facet to a SQL boolean."""
    items = ", ".join(f"CASE WHEN {cond(f)} THEN '{f}' END" for f in fixed.MODALITY_ORDER)
    return f"list_filter([{items}], lambda f: f IS NOT NULL)"


def float_prefix(x: str) -> str:
    return f"TRY_CAST({ext(x, r'^([0-9]+\.?[0-9]*|\.[0-9]+)')} AS DOUBLE)"


def ctx_num(x: str) -> str:
    pat = rf"([0-9.]+){W}*([KkMmBb]?)"
    num = float_prefix(f"regexp_extract({x}, {q(pat)}, 1)")
    unit = f"lower(regexp_extract({x}, {q(pat)}, 2))"
    return f"coalesce({num} * CASE {unit} WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1.0 END, 0.0)"


def parse_ctx(x: str) -> str:
    t = f"upper({trim(x)})"
    pat = rf"^([0-9.]+){W}*([KM])?$"
    return (
        f"(CASE WHEN {has(t, pat)} THEN {float_prefix(f'regexp_extract({t}, {q(pat)}, 1)')} * "
        f"CASE regexp_extract({t}, {q(pat)}, 2) WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1.0 END END)"
    )


def clean_ctx(x: str) -> str:
    return rep(rep(trim(x), rf"(?i)^up{W}+to{W}+"), rf"([0-9]+)\.0+{W}*([KkMmBb])\b", r"\1\2")


def fmt_tokens(x: str) -> str:
    def part(step: int, u: str) -> str:
        return f"WHEN {x} >= {step} AND {x} % {step} = 0 THEN CAST({x} // {step} AS VARCHAR) || '{u}'"

    return (
        f"(CASE WHEN {x} IS NULL OR {x} <= 0 THEN NULL {part(1000000, 'M')} {part(1000, 'K')} {part(1048576, 'M')} "
        f"{part(1024, 'K')} ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) END)"
    )


def fmt_context(x: str) -> str:
    """x is an integer expression."""
    dec = rf"regexp_replace(CAST(CAST(round({x} / 1e6, 3) AS DECIMAL(30,3)) AS VARCHAR), '\.?0+$', '')"
    return (
        f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN NULL WHEN {x} >= 1000000 THEN {dec} || 'M' "
        f"WHEN {x} >= 1000 THEN CAST(CAST(floor({x} / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) END)"
    )


def no_token(m: str, i: str, n: str) -> str:
    s = f"lower(concat_ws(' ', coalesce({m}, ''), coalesce({i}, ''), coalesce({n}, '')))"
    return has(s, rf"embed|rerank|whisper|transcrib|speech.?to.?text|\bstt\b|audio{W}*(?:→|->|to){W}*text")


AMT = r"([0-9,]+(?:\.[0-9]+)?)"
RPD = rf"(?i){AMT}{W}*(?:rpd|requests?{W}*/{W}*day|req(?:uests?)?{W}*/{W}*day|requests?{W}+per{W}+day)"
RPM = rf"(?i){AMT}{W}*(?:rpm|requests?{W}*/{W}*min(?:ute)?|req(?:uests?)?{W}*/{W}*min|requests?{W}+per{W}+minute)"


def rl_raw(x: str) -> str:
    return f"(CASE WHEN {blank_null(x)} IS NOT NULL THEN {x} END)"


def rl_day(x: str) -> str:
    a = float_prefix(f"replace({ext(x, RPD)}, ',', '')")
    b = float_prefix(f"replace({ext(x, RPM)}, ',', '')")
    return f"least({a}, {b} * 1440)"


def rl_unlimited(x: str) -> str:
    return f"coalesce({has(x, r'(?i)\bunlimited\b|no hard cap|no cap\b')}, false)"


def score(mod: str, ctx: str, out: str, rl: str, wanted: str | None) -> str:
    match = f"CASE WHEN {facet(mod, wanted)} THEN 100000.0 ELSE 0.0 END" if wanted else "0.0"
    day = rl_day(rl)
    gen = f"CASE WHEN {rl_unlimited(rl)} THEN 10000.0 WHEN {day} > 0 THEN log10({day} + 1) * 100 ELSE 0.0 END"
    cn = ctx_num(ctx)
    return (
        f"({match} + {gen} + CASE WHEN {cn} > 0 THEN log10({cn} + 1) * 10 ELSE 0.0 END "
        f"+ CASE WHEN nullif({out}, '') IS NOT NULL THEN 1.0 ELSE 0.0 END)"
    )


def _period(x: str) -> str:
    return (
        f"CASE WHEN {has(x, rf'(?i)/{W}*day|per{W}+day|daily')} THEN '/hari' "
        f"WHEN {has(x, rf'(?i)/{W}*month|per{W}+month|monthly')} THEN '/bln' ELSE '' END"
    )


def free_limit(x: str) -> str:
    money = r"\$[0-9,]+(?:\.[0-9]+)?"
    tok = rf"(?i)([~]?[0-9.,]+{W}*[KMB])\b[^.]*?tokens?({W}*/{W}*[A-Za-z0-9_]+)?"
    cred = rf"(?i)([0-9.,]+{W}*[KMB])\b[^.]*?credits?"

    def g(pat: str, n: int = 1) -> str:
        return f"regexp_extract({x}, {q(pat)}, {n})"

    calls = rf"(?i)([0-9,]+){W}*(?:API{W}+)?calls?"
    neurons = rf"(?i)([0-9,]+){W}*Neurons?"
    reqs = rf"(?i)([0-9,]+){W}*req(?:uests?)?{W}*/?{W}*day"
    rpm = rf"(?i)([0-9,]+){W}*RPM(?:{W}*(?:per IP|/IP))?"
    frees = rf"(?i)([~]?[0-9]+\+?){W}*(?:permanently{W}+)?free models?"
    return (
        f"(CASE WHEN {blank_null(x)} IS NULL THEN NULL "
        f"WHEN {has(x, money)} THEN CASE WHEN {has(x, rf'(?i)one[- ]?time|expir|trial|sign[- ]?up{W}+credit')} THEN NULL ELSE {g(money, 0)} || ' kredit' END "
        f"WHEN {has(x, tok)} THEN {rep(g(tok), W + '+')} || ' token' || {_period(g(tok, 0))} "
        f"WHEN {has(x, cred)} THEN {rep(g(cred), W + '+')} || ' kredit' || {_period(g(cred, 0))} "
        f"WHEN {has(x, calls)} THEN {g(calls)} || ' calls' || {_period(x)} "
        f"WHEN {has(x, neurons)} THEN {g(neurons)} || ' Neurons/hari' "
        f"WHEN {has(x, reqs)} THEN {g(reqs)} || ' req/hari' "
        f"WHEN {has(x, rpm)} THEN {g(rpm)} || ' RPM/IP' "
        f"WHEN {has(x, frees)} THEN {g(frees)} || ' model free' "
        f"WHEN {has(x, '(?i)permanent')} THEN 'Free (permanen)' "
        f"WHEN {has(x, '(?i)no (registration|signup|sign-up)')} THEN 'Free, no signup' END)"
    )


def looks_ctx(x: str) -> str:
    raw = blank_null(x)
    core = trim(rep(raw, rf"(?i)^(?:up{W}+to|~){W}*"))
    core = trim(rep(f"split_part({core}, '(', 1)", rf"^{W}*~{W}*"))
    words = has(raw, rf"(?i)^(?:varies|model-dependent|unlimited|configurable|shared{W}*w/?{W}*context)$")
    size = has(core, rf"(?i)^[0-9]+(?:\.[0-9]+)?{W}*[KMB]$")
    digits = f"({has(core, '^[0-9]+$')} AND coalesce(TRY_CAST({core} AS DOUBLE), 0) >= 1000)"
    return f"coalesce({words} OR {size} OR {digits}, false)"


def looks_rl(x: str) -> str:
    pat = (
        "(?i)unlimited|community-powered|credit-metered|preview limits|dependent on|no hard cap|session/weekly"
        rf"|see{W}+provider{W}+page|[0-9][0-9,.]*{W}*[KMB]?{W}*(?:RPM|RPD|RPS|TPM|TPD|TPS)\b"
        rf"|\brequests?\b.*/|/{W}*(?:minute|hour|day|month)\b|\bcalls?\b|\bneurons?\b"
    )
    return f"coalesce({has(blank_null(x), pat)}, false)"


def bare_size(x: str) -> str:
    return has(trim(x), rf"(?i)^[0-9]+(?:\.[0-9]+)?{W}*[KMB]$")


def markup(x: str) -> str:
    return (
        f"coalesce({has(x, r'</?[a-zA-Z!][^>]*>')} OR "
        f"{has(x, r'(?i)&(?:amp|lt|gt|quot|#39|nbsp|#[0-9]+|#x[0-9a-f]+);')}, false)"
    )


def more_note(x: str, n: str) -> str:
    claimed = f"TRY_CAST(replace({ext(x, rf'(?i)([0-9][0-9,]*){W}*(?:more|additional)')}, ',', '') AS BIGINT)"
    return f"(CASE WHEN {claimed} IS NULL OR {claimed} > {n} THEN nullif({x}, '') END)"


def decode(x: str) -> str:
    s = x
    for e, c in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]:
        s = f"replace({s}, {q(e)}, {q(c)})"
    return s


def decode_numeric(x: str) -> str:
    """Decimal entities of an already named-decoded text."""
    codes = f"list_distinct(regexp_extract_all({x}, '&#([0-9]+);', 1))"
    return f"list_reduce(list_prepend({x}, {codes}), lambda acc, n: replace(acc, '&#' || n || ';', chr(CAST(n AS INTEGER))))"


def text_of(x: str) -> str:
    return squeeze(decode(rep(x, "<[^>]+>", " ")))


def is_note(x: str) -> str:
    return has(x, rf"(?i)^(?:{'|'.join(fixed.NOTE_OPENINGS)})")


def is_descriptor(x: str) -> str:
    return f"({has(f'coalesce({x}, {q("")})', rf'(?i)\bmodels{W}*$')} AND NOT {has(f'coalesce({x}, {q("")})', r'[0-9\-/]')})"


def is_junk(x: str) -> str:
    return f"lower({x}) IN ({', '.join(q(j) for j in fixed.JUNK_NAMES)})"


def severity(c: str, t: str) -> str:
    return f"CASE WHEN {c} <= 0 THEN NULL WHEN {t} >= 20 AND {c} / {t} > 0.5 THEN 'fatal' ELSE 'warn' END"

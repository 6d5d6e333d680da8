"""Building blocks for the checking SQL, written against DuckDB's dialect and independent of
the engine's expressions: only the fixed values and the search profile are shared."""

from __future__ import annotations

import re

from postings_engine import fixed_values as fv

from .projection import PROFILE, projection_sql

RUN = "(SELECT max(ts) FROM events)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c: str, *patterns: str) -> str:
    return f"regexp_matches({c}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def any_in(c: str, needles) -> str:
    return "(" + " OR ".join([f"contains({c}, {q(n)})" for n in needles] or ["false"]) + ")"


def word(c: str, w: str) -> str:
    return f"regexp_matches(' ' || {c} || ' ', {q('[^a-z0-9]' + re.escape(w) + '[^a-z0-9]')})"


def any_word(c: str, words) -> str:
    return "(" + " OR ".join([word(c, w) for w in words] or ["false"]) + ")"


def first_of(c: str, words, test=word) -> str:
    """First word (list order) that passes, else null."""
    return "CASE " + " ".join(f"WHEN {test(c, w)} THEN {q(w)}" for w in words) + " END" if words else "NULL"


def label(c: str, rules, default: str) -> str:
    arms = " ".join(f"WHEN {rx(c, *((p,) if isinstance(p, str) else p))} THEN {q(name)}" for name, p in rules)
    return f"(CASE {arms} ELSE {default} END)"


def norm(c: str) -> str:
    flat = f"translate(lower(strip_accents({c})), '‐‑‒–—―', '------')"
    return f"trim(regexp_replace({flat}, '[^\\p{{L}}\\p{{N}}_\\-/+.,:;()£$€@''&]+', ' ', 'g'))"


NEGATORS = "|".join(re.escape(n) for n in fv.NEGATORS)


def unnegated(c: str, patterns) -> str:
    """For each pattern: cut the text before every match, look at the 45 characters that
    precede each cut."""
    tests = []
    for p in patterns:
        marked = f"regexp_replace({c}, {q('(' + p + ')')}, chr(1) || '\\1', 'g')"
        tests.append(
            f"(regexp_matches({c}, {q(p)}) AND list_transform([string_split({marked}, chr(1))], lambda sg: list_bool_or(list_transform("
            f"range(2, len(sg) + 1), lambda i: NOT regexp_matches(right(array_to_string(sg[1:i-1], ''), 45), {q(NEGATORS)}))))[1])")
    return "(" + " OR ".join(tests or ["false"]) + ")"


def html_text(c: str) -> str:
    """Markup to text; covers the entities that occur in the tables."""
    out = c
    for tag in ("script", "style"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)<br\\s*/?>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?i)</(p|div|li|h[1-6]|tr)>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?i)<li[^>]*>', chr(10) || '- ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    out = f"regexp_replace({out}, '[ \\t\\r\\f\\v]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


AUTH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"


def netloc(c):
    return f"regexp_extract({c}, {q(AUTH + '([^/?#]*)')}, 1)"


def host(c):
    return f"lower(regexp_extract({c}, {q(AUTH + '(?:[^/?#]*@)?([^/?#:@]*)')}, 1))"


def path(c):
    return f"regexp_extract({c}, {q(r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)')}, 1)"


def scheme(c):
    return f"lower(regexp_extract({c}, {q(r'^([A-Za-z][A-Za-z0-9+.\-]*):')}, 1))"


def no_www(c):
    return f"regexp_replace({host(c)}, '^www\\.', '')"


def url_key(c):
    return (f"lower({no_www(c)} || regexp_replace(regexp_replace({path(c)}, ';[^/]*$', ''), '/+$', ''))")


def company_slug(c):
    head = f"trim(string_split_regex({c}, '\\s*[|·—–]\\s*')[1])"
    base = norm(f"(CASE WHEN {head} <> '' THEN {head} ELSE {c} END)")
    return f"regexp_replace(regexp_replace({base}, {q(fv.COMPANY_FILLER)}, ' ', 'g'), '[^a-z0-9]', '', 'g')"


def title_slug(c):
    out = norm(c)
    for p in (fv.TITLE_REFERENCE, r"#\d{3,}", fv.TITLE_FILLER, r"\(.*?\)"):
        out = f"regexp_replace({out}, {q(p)}, ' ', 'g')"
    return f"regexp_replace({out}, '[^a-z0-9]', '', 'g')"


# ------------------------------------------------------------------------- places


def home(c: str, prof=PROFILE) -> str:
    tests = [word(c, t) if len(t) <= 3 else f"contains({c}, {q(t)})" for t in prof.home_terms]
    return "(" + " OR ".join(tests + [f"contains({c}, {q(t)})" for t in prof.home_city_terms]) + ")"


def worldwide(c: str) -> str:
    tails = f"regexp_extract_all({c}, '\\banywhere\\b((?:\\s+(?:in|within|across)\\s+(?:the\\s+)?[a-z]+)?)', 1)"
    hit = f"list_bool_or(list_transform({tails}, lambda t: t = '' OR regexp_matches(t, '^\\s+(?:in|within|across)\\s+world$')))"
    return f"({any_in(c, fv.WORLDWIDE_TERMS)} OR coalesce({hit}, false))"


def foreign(c: str, prof=PROFILE) -> str:
    return first_of(c, prof.foreign_terms, lambda x, w: f"(starts_with({x}, {q(w)}) OR {word(x, w)})")


def city_lookup(c: str, prof=PROFILE) -> str:
    return f"map {{{', '.join(f'{q(k)}: {q(v)}' for k, v in prof.city_countries.items())}}}[{c}]"


def location_country(c: str, prof=PROFILE) -> str:
    metro = f"trim(regexp_extract({c}, {q(fv.METRO)}, 1))"
    parts = f"list_filter(list_transform(string_split({c}, ','), lambda x: {city_lookup('trim(x)')}), lambda y: y IS NOT NULL)"
    return (f"(CASE WHEN {c} = '' OR {home(c)} THEN '' ELSE coalesce({foreign(c)}, {city_lookup(metro)}, {parts}[1], '') END)")


def strong_home(hay: str, header: str, prof=PROFILE) -> str:
    return f"({home(header)} OR {any_in(hay, prof.confirmations)})"


def explicit_home(hay: str, header: str, prof=PROFILE) -> str:
    sentence = (f"list_bool_or(list_transform(string_split_regex({hay}, '[.!?;\\n]+'), lambda s: {home('s')} "
                f"AND NOT {any_in('s', prof.incidental)} AND {any_in('s', fv.ELIGIBILITY_CONTEXT)}))")
    return f"({strong_home(hay, header)} OR coalesce({sentence}, false))"


def restricted(hay: str) -> str:
    """Ordered list of the places restriction phrases name."""
    found = "flatten([" + ", ".join(f"regexp_extract_all({hay}, {q(p)}, 1)" for p in fv.COUNTRY_RESTRICTION) + "])"
    strip = lambda x: f"regexp_replace(regexp_replace({x}, '^[ .,\\-]+|[ .,\\-]+$', '', 'g'), '^the\\s+', '')"
    cut = f"trim(string_split_regex({strip('x')}, {q(fv.RESTRICTION_TAIL)})[1])"
    return f"list_filter(list_transform({found}, lambda x: {cut}), lambda y: y <> '')"


# -------------------------------------------------------------------------- tables

P = f"p AS ({projection_sql()})"
KEPT_TAGS = "list_filter(string_split(tag_text, ','), lambda t: t <> '')"
N = f"""n0 AS (SELECT *, {norm('title')} AS n_title, {norm('description')} AS n_body,
  {norm(f"array_to_string({KEPT_TAGS}, ' ')")} AS n_tags, {norm('location_raw')} AS n_location,
  {norm('employment_type_raw')} AS n_employment, {norm('company')} AS n_company, {norm(netloc('url') + ' || ' + path('url'))} AS n_url FROM p),
n AS (SELECT *, concat_ws(' ', nullif(n_title, ''), nullif(n_company, ''), nullif(n_location, ''), nullif(n_body, ''),
  nullif(n_employment, ''), nullif(n_tags, ''), nullif(n_url, '')) AS hay FROM n0)"""
K = f"""k AS (SELECT *, {company_slug('company')} AS company_slug, {title_slug('title')} AS title_slug,
  CASE WHEN {url_key('url')} <> '' THEN {url_key('url')} ELSE {url_key('apply_url')} END AS url_key FROM p),
kf AS (SELECT *, substr(sha1(company_slug || '|' || title_slug), 1, 16) AS fingerprint FROM k)"""


def select(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


# ------------------------------------------------------------------- relevance gates

PR = PROFILE
A, B = PR.core_terms
CORE = {
    "core_title": word("n_title", A), "core_body": f"({word('hay', A)} OR contains(n_tags, {q(A)}))",
    "second_title": word("n_title", B), "second_body": f"({word('hay', B)} OR contains(n_tags, {q(B)}))",
    "adjacent_title": any_in("n_title", PR.secondary_terms), "adjacent_body": any_in("hay", PR.secondary_terms),
    "core_mentions": f"((length(hay) - length(replace(hay, {q(A)}, ''))) // {len(A)} + len(regexp_extract_all(hay, {q(chr(92) + 'b' + B + chr(92) + 'b')})))",
}
REL = f"""r0 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in CORE.items())} FROM n),
r1 AS (SELECT *, core_title OR second_title OR adjacent_title AS names_work FROM r0),
rel AS (SELECT *, CASE
  WHEN {any_word('n_title', PR.hard_title_exclusions)} THEN 1
  WHEN NOT (core_body OR second_body OR adjacent_title) THEN 2
  WHEN NOT (core_title OR second_title OR {any_word('n_title', PR.hands_on_title_tokens)}) THEN 3
  WHEN NOT names_work AND {rx('n_title', *PR.title_exclusion_patterns)} THEN 4
  WHEN NOT names_work AND core_mentions < {PR.min_body_core_mentions} THEN 5
  WHEN NOT (core_body OR second_body OR (adjacent_title AND adjacent_body)) THEN 6
  WHEN NOT core_title AND {any_in('n_title', PR.competing_stacks)} THEN 7 ELSE 0 END AS gate FROM r1)"""

# --------------------------------------------------------- arrangement and eligibility

FIRST_MARKER = "(" + " OR ".join(
    f"(contains(n_body, {q(m)}) AND NOT regexp_matches(right(substr(n_body, 1, instr(n_body, {q(m)}) - 1), 45), {q(NEGATORS)}))"
    for m in fv.REMOTE_MARKERS) + ")"
ARR = (f"CASE WHEN {unnegated('hay', fv.HYBRID)} THEN 'hybrid' WHEN {unnegated('hay', fv.ONSITE)} THEN 'onsite' "
       f"WHEN {any_in('hay', fv.REMOTE_MARKERS)} OR is_remote THEN 'remote' ELSE 'unknown' END")
IS_HOME = lambda x: f"({home(x)} OR {worldwide(x)})"


def elig_ctes(source: str) -> str:
    """From `source` (match-text columns) to `el` with remote_status, eligibility, passed,
    el_category, prospect_worthy and arrangement."""
    h = PR.home_label
    return f"""e0 AS (SELECT *, n_title || ' ' || n_location || ' ' || n_tags AS header FROM {source}),
e1 AS (SELECT *, header || ' ' || n_body AS r_hay FROM e0),
e2 AS (SELECT *, {unnegated('r_hay', fv.HYBRID + fv.ONSITE)} AS office, {any_in('header', fv.REMOTE_MARKERS)} OR {FIRST_MARKER} AS marker,
  {unnegated('r_hay', PR.residency_patterns)} AS resid, {worldwide('r_hay')} AS world, {any_in('r_hay', fv.INTERNATIONAL_CONTRACTOR)} AS intl,
  {strong_home('r_hay', 'header')} AS strong, {explicit_home('r_hay', 'header')} AS explicit, {home('n_location')} OR {home('n_title')} AS home_here,
  coalesce({first_of('r_hay', PR.region_terms)}, '') AS region, {any_in('r_hay', PR.region_excluding_home_terms)} AS excl,
  {location_country('n_location')} AS based, {restricted('r_hay')} AS places, {ARR} AS arrangement FROM e1),
e3 AS (SELECT *, explicit OR coalesce(list_bool_or(list_transform(places, lambda x: {IS_HOME('x')})), false) AS home_ok,
  list_filter(places, lambda x: NOT {IS_HOME('x')} AND ({foreign('x')}) IS NOT NULL)[1] AS bound FROM e2),
e4 AS (SELECT *, CASE WHEN office THEN 1 WHEN NOT marker AND NOT is_remote AND truncated_description AND home_here THEN 2
  WHEN NOT marker AND NOT is_remote THEN 3 WHEN resid AND NOT strong AND NOT world THEN 4 WHEN bound IS NOT NULL AND NOT strong AND NOT world THEN 5
  WHEN excl AND NOT home_ok AND NOT world THEN 6 WHEN world THEN 11 WHEN home_here THEN 12 WHEN home_ok AND region <> '' THEN 13 WHEN home_ok THEN 14
  WHEN intl THEN 15 WHEN region <> '' THEN 7 WHEN based <> '' THEN 8 ELSE 9 END AS ground FROM e3),
el AS (SELECT *, ground > 10 AS passed, CASE WHEN ground <= 3 THEN 'not_remote' WHEN ground <= 9 THEN 'ineligible' ELSE '' END AS el_category,
  CASE ground WHEN 1 THEN 'Hybrid / On-site' WHEN 2 THEN 'Unknown — description truncated by the source' WHEN 3 THEN 'Not stated' WHEN 4 THEN 'Remote (US only)'
    WHEN 5 THEN 'Remote (country restricted)' WHEN 6 THEN 'Remote (region excludes {h})' WHEN 7 THEN 'Remote — regional ({h} unconfirmed)'
    WHEN 8 THEN 'Remote — ' || {initcap('based')} WHEN 9 THEN 'Remote — region unstated' WHEN 11 THEN 'Remote — Worldwide'
    WHEN 13 THEN 'Remote — regional ({h} confirmed via "' || region || '")' WHEN 15 THEN 'Remote — International contractor' ELSE 'Remote — {h}' END AS remote_status,
  CASE ground WHEN 1 THEN 'N/A' WHEN 2 THEN '{h} location, remote working unconfirmed' WHEN 3 THEN 'N/A' WHEN 4 THEN 'Not eligible — US residency/authorisation required'
    WHEN 5 THEN 'Not eligible — ' || {initcap('bound')} || ' residency required' WHEN 6 THEN 'Not eligible — {h} not confirmed' WHEN 7 THEN 'Unconfirmed — ask before applying'
    WHEN 8 THEN 'Not eligible — advertised for ' || {initcap('based')} WHEN 9 THEN 'Unconfirmed — no eligible location stated' WHEN 11 THEN 'Eligible — worldwide / work from anywhere'
    WHEN 12 THEN 'Eligible — {h} named in the location' WHEN 15 THEN 'Eligible — hires international remote contractors'
    ELSE 'Eligible — {h} explicitly permitted in the posting' END AS eligibility,
  ground IN (2, 6, 7, 9) OR (ground = 4 AND explicit) AS prospect_worthy FROM e4)"""


def initcap(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


ARR_LABEL = "CASE arrangement WHEN 'remote' THEN 'Remote' WHEN 'hybrid' THEN 'Hybrid' WHEN 'onsite' THEN 'On-site' ELSE 'Not stated' END"

# ------------------------------------------------------------------------------- pay


def currency(c: str) -> str:
    arms = "".join(f" WHEN regexp_matches(upper({c}), '\\b{code}\\b') THEN '{code}'" for code in fv.CURRENCY_CODES)
    arms += "".join(f" WHEN contains({c}, {q(s)}) THEN '{code}'" for s, code in fv.CURRENCY_SYMBOLS)
    return f"(CASE{arms} ELSE '' END)"


def amount_list(c: str) -> str:
    p = q("(?i)" + fv.AMOUNT)
    grabs = [f"regexp_extract_all({c}, {p}, {g})" for g in (1, 2, 3)]
    keep = "NOT (regexp_matches(replace(t[2], ',', ''), '^(19|20)\\d{2}$') AND coalesce(t[1], '') = '')"
    value = "CAST(regexp_replace(t[2], '[,\\s]', '', 'g') AS DOUBLE) * CASE lower(coalesce(t[3], '')) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END"
    return f"list_transform(list_filter(list_zip({', '.join(grabs)}), lambda t: {keep}), lambda t: {value})"


def pay_ctes(source: str, col: str, prefix: str = "") -> str:
    """amounts of one text column -> {prefix}smin, smax, dmin, dmax, cur."""
    w = lambda lo, hi: f"list_filter({prefix}vals, lambda v: v >= {lo} AND v <= {hi})"
    return f"""{prefix}y0 AS (SELECT *, {amount_list(col)} AS {prefix}vals, {currency(col)} AS {prefix}cur,
  regexp_matches(lower({col}), {q(fv.HOURLY_WORDS)}) AS {prefix}hourly, regexp_matches(lower({col}), {q(fv.DAY_RATE_WORDS)}) AS {prefix}daily FROM {source}),
{prefix}y1 AS (SELECT *, CASE WHEN {prefix}hourly AND len({w(8, 500)}) > 0 THEN 'h' WHEN {prefix}daily AND len({w(80, 4000)}) > 0 THEN 'd' ELSE 'a' END AS {prefix}kind FROM {prefix}y0),
{prefix}y AS (SELECT *, CASE WHEN {prefix}kind = 'a' THEN list_min({w(12000, 1000000)}) END AS {prefix}smin, CASE WHEN {prefix}kind = 'a' THEN list_max({w(12000, 1000000)}) END AS {prefix}smax,
  CASE {prefix}kind WHEN 'h' THEN round_even(list_min({w(8, 500)}) * 8, 0) WHEN 'd' THEN list_min({w(80, 4000)}) END AS {prefix}dmin,
  CASE {prefix}kind WHEN 'h' THEN round_even(list_max({w(8, 500)}) * 8, 0) WHEN 'd' THEN list_max({w(80, 4000)}) END AS {prefix}dmax FROM {prefix}y1)"""


PAY_LINE = "(?i)" + "|".join(re.escape(t) for t in fv.PAY_LINE_TOKENS)


def resolved_pay(source: str) -> str:
    """-> `pay` with salary_min/max, day_rate_min/max, currency."""
    line = f"array_to_string(list_filter(string_split_regex(description, '\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: regexp_matches(lower(l), {q(PAY_LINE)})), ' ')"
    return f"""{pay_ctes(source, 'salary_raw', 'f_')},
b0 AS (SELECT *, nullif(salary_min, 0) AS pmin, nullif(salary_max, 0) AS pmax FROM f_y),
b1 AS (SELECT *, coalesce(pmin, pmax, f_smin, f_smax, f_dmin, f_dmax) IS NULL AS silent, {line} AS pay_line FROM b0),
{pay_ctes('b1', 'pay_line', 'g_')},
b2 AS (SELECT * EXCLUDE (salary_min, salary_max, salary_currency), coalesce(pmin, CASE WHEN silent THEN g_smin ELSE f_smin END) AS smin, coalesce(pmax, CASE WHEN silent THEN g_smax ELSE f_smax END) AS smax,
  CASE WHEN silent THEN g_dmin ELSE f_dmin END AS dmin, CASE WHEN silent THEN g_dmax ELSE f_dmax END AS dmax,
  coalesce(nullif(salary_currency, ''), CASE WHEN silent THEN g_cur ELSE f_cur END) AS salary_currency FROM g_y),
b3 AS (SELECT *, coalesce(smin < {fv.DAY_RATE_CEILING} AND dmin IS NULL, false) AS flip FROM b2),
b4 AS (SELECT *, CASE WHEN NOT flip THEN smin END AS s1, CASE WHEN NOT flip THEN smax END AS s2, CASE WHEN flip THEN smin ELSE dmin END AS d1, CASE WHEN flip THEN smax ELSE dmax END AS d2 FROM b3),
pay AS (SELECT *, CASE WHEN s1 > s2 THEN s2 ELSE s1 END AS salary_min, CASE WHEN s1 > s2 THEN s1 ELSE s2 END AS salary_max,
  CASE WHEN d1 > d2 THEN d2 ELSE d1 END AS day_rate_min, CASE WHEN d1 > d2 THEN d1 ELSE d2 END AS day_rate_max FROM b4)"""


def usd(amount: str, cur: str) -> str:
    table = ", ".join(f"'{k}': {float(v)!r}::DOUBLE" for k, v in fv.CURRENCY_TO_USD.items())
    return f"(nullif({amount}, 0) * map {{{table}}}[upper(coalesce(nullif({cur}, ''), 'USD'))])"


ANNUAL = (f"coalesce({usd('coalesce(nullif(salary_max, 0), nullif(salary_min, 0))', 'salary_currency')}, "
          f"{usd('coalesce(nullif(day_rate_max, 0), nullif(day_rate_min, 0))', 'salary_currency')} * {fv.CONTRACT_DAYS_PER_YEAR})")

# -------------------------------------------------------------------- classification

YEARS3 = fv.YEARS[2].split("(?!")[0]
NOT_YEARS = re.search(r"\(\?!\(\?:(.*?)\)", fv.YEARS[2]).group(1)


def years(c: str) -> str:
    """The third form forbids some following words: take the word, then test it."""
    third = (f"list_transform(list_filter(regexp_extract_all({c}, {q(YEARS3 + '[a-z]+')}), "
             f"lambda m: NOT regexp_matches(m, {q(r'\s(?:' + NOT_YEARS + ')$')})), lambda m: regexp_extract(m, '^(\\d{{1,2}})', 1))")
    found = f"flatten([regexp_extract_all({c}, {q(fv.YEARS[0])}, 1), regexp_extract_all({c}, {q(fv.YEARS[1])}, 1), {third}])"
    return f"list_max(list_filter(list_transform({found}, lambda x: CAST(x AS INTEGER)), lambda v: v BETWEEN 1 AND 25))"


EMPLOYMENT = (f"(CASE WHEN n_employment <> '' THEN {label('n_employment', fv.DECLARED_EMPLOYMENT, 'NULL')} END)")
EMPLOYMENT = f"coalesce({EMPLOYMENT}, {label('hay', fv.EMPLOYMENT, '''CASE WHEN contains(hay, 'salary') OR contains(hay, 'benefits') THEN 'Full Time' ELSE 'Unknown' END''')})"
SENIORITY_Y = f"TRY_CAST(regexp_extract(hay, {q(fv.SENIORITY_YEARS)}, 1) AS INTEGER)"
SENIORITY = (f"coalesce({label('n_title', fv.SENIORITY, 'NULL')}, CASE WHEN {SENIORITY_Y} >= 8 THEN 'Lead' WHEN {SENIORITY_Y} >= 4 THEN 'Senior' "
             f"WHEN {SENIORITY_Y} >= 2 THEN 'Mid' WHEN {SENIORITY_Y} IS NOT NULL THEN 'Junior' END, {label('hay', fv.SENIORITY, q('Unspecified'))})")
LEVEL_OF = lambda c: "(CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.SENIORITY_TO_LEVEL.items()) + " END)"
LEVEL = (f"coalesce({LEVEL_OF(label('n_title', fv.SENIORITY, 'NULL'))}, CASE WHEN required_years <= 2 THEN 'Beginner' WHEN required_years <= 4 THEN 'Medium' "
         f"WHEN required_years IS NOT NULL THEN 'Senior' END, CASE WHEN {rx('hay', *fv.BEGINNER_PHRASES)} THEN 'Beginner' WHEN {rx('hay', *fv.SENIOR_PHRASES)} THEN 'Senior' END, "
         f"{LEVEL_OF('seniority')}, 'Not specified')")
TEAM = "TRY_CAST(regexp_extract(hay, '\\bteam of (\\d{1,4})\\b', 1) AS INTEGER)"
SIZE = "CASE " + " ".join(
    f"WHEN {rx('hay', p)} THEN " + (q(v) if v else f"CASE WHEN {TEAM} <= 10 THEN '1-10' WHEN {TEAM} <= 50 THEN '11-50' WHEN {TEAM} <= 200 THEN '51-200' ELSE '201+' END")
    for p, v in fv.COMPANY_SIZE) + " WHEN contains(hay, 'startup') OR contains(hay, 'start-up') THEN 'Startup (small)' ELSE 'Unknown' END"
SIGNAL = any_in("hay", fv.STARTUP_SIGNALS)
STAGE = label("hay", fv.STARTUP_STAGE, f"CASE WHEN {SIGNAL} THEN 'Unspecified stage' ELSE 'N/A' END")
PARTNER = (f"(({' + '.join(f'contains(hay, {q(s)})::INT' for s in fv.PARTNERSHIP_SIGNALS)}) >= 2 OR "
           f"({any_in('hay', fv.STRONG_PARTNERSHIP_SIGNALS)} AND employment_type IN ('Contract', 'Freelance', 'Unknown')))")


def skill(term: str) -> str:
    f = lambda ps: [p.replace("{t}", term) for p in ps]
    return (f"CASE WHEN {word('n_title', term)} OR {word('n_tags', term)} THEN 'Yes' WHEN NOT {word('hay', term)} THEN 'No' "
            f"WHEN {rx('hay', *f(fv.CORE_REQUIRED))} THEN 'Yes' WHEN {rx('hay', *f(fv.CORE_PREFERRED))} THEN 'Preferred' ELSE 'Mentioned' END")


def class_ctes(source: str) -> str:
    """-> `cl` with every label."""
    return f"""c0 AS (SELECT *, {EMPLOYMENT} AS employment_type, {SENIORITY} AS seniority, {years('hay')} AS required_years, {SIZE} AS company_size,
  {label('hay', fv.INDUSTRY, q(fv.DEFAULT_INDUSTRY))} AS industry, {STAGE} AS startup_stage, {skill(A)} AS core_skill_required, {skill(B)} AS secondary_skill_required FROM {source}),
c1 AS (SELECT *, startup_stage <> 'N/A' OR {SIGNAL} AS is_startup, {PARTNER} AS is_partnership, {LEVEL} AS experience_level,
  {label('hay', fv.CONTRACT_TYPE, "CASE WHEN employment_type IN ('Contract', 'Freelance') THEN 'Unspecified contract' WHEN employment_type IN ('Full Time', 'Part Time') THEN 'Permanent' ELSE 'N/A' END")} AS contract_type FROM c0),
cl AS (SELECT *, CASE WHEN is_partnership THEN 'Partnership / Agency' WHEN employment_type = 'Freelance' THEN 'Freelance Project'
  WHEN employment_type = 'Contract' THEN 'Contract Role' WHEN is_startup THEN 'Startup Role' ELSE 'Permanent Job' END AS opportunity_type FROM c1)"""


# ------------------------------------------------------------------------ enrichment

MAILS = f"list_transform(regexp_extract_all(description, {q(fv.EMAIL)}), lambda e: regexp_replace(e, '^[.,;:]+|[.,;:]+$', '', 'g'))"
GOOD_MAILS = (f"list_filter({MAILS}, lambda e: NOT regexp_matches(lower(e), '\\.(png|jpg|jpeg|gif|svg|webp)$') AND NOT {any_in('lower(e)', fv.UNUSABLE_EMAIL_PARTS)})")
EMAIL = f"coalesce(list_filter({GOOD_MAILS}, lambda e: {any_in('lower(e)', fv.PREFERRED_EMAIL_PARTS)})[1], {GOOD_MAILS}[1], '')"
PHONE_CORE = fv.PHONE.replace(r"(?<![\w])", "").replace(r"(?![\w])", "")
PHONES = f"regexp_extract_all(' ' || description || ' ', {q('[^0-9A-Za-z_](' + PHONE_CORE + ')[^0-9A-Za-z_]')}, 1)"
DIGITS = "regexp_replace(t, '\\D', '', 'g')"
PHONE = f"coalesce(trim(list_filter({PHONES}, lambda t: length({DIGITS}) BETWEEN 9 AND 15 AND NOT starts_with({DIGITS}, '20'))[1]), '')"
HEAD = "description"
PERSON = [
    (f"(?:our|the)\\s+({fv.ROLE_WORDS})[,:]?\\s+({fv.PERSON_NAME})", 2, 1), (f"({fv.PERSON_NAME}),\\s*({fv.ROLE_WORDS})", 1, 2),
    (f"(?:contact|speak to|reach out to|attention|attn\\.?|ask for|please contact)\\s+(?:our\\s+)?({fv.PERSON_NAME})", 1, 0)]


def person(which: str) -> str:
    arms = []
    for p, n, r in PERSON:
        name = f"trim(regexp_extract({HEAD}, {q(p)}, {n}))"
        value = name if which == "name" else (f"trim(regexp_extract({HEAD}, {q(p)}, {r}))" if r else "''")
        arms.append(f"WHEN {name} <> '' AND NOT regexp_matches({name}, {q(fv.NOT_A_PERSON)}) THEN {value}")
    return f"(CASE {' '.join(arms)} ELSE '' END)"


AGG = lambda u: f"({no_www(u)} = '' OR {any_in(no_www(u), fv.AGGREGATOR_HOSTS)})"
OWN = lambda u: f"(CASE WHEN {u} <> '' AND NOT {AGG(u)} THEN {u} END)"
ORIGIN = lambda u: f"(CASE WHEN {OWN(u)} IS NOT NULL AND {scheme(u)} <> '' THEN {scheme(u)} || '://' || {host(u)} END)"
DOMAIN = "lower(regexp_extract(public_email, '@([^@]*)$', 1))"
SITE = (f"coalesce(nullif(company_website, ''), {ORIGIN('apply_url')}, {ORIGIN('url')}, CASE WHEN contains({DOMAIN}, '.') AND NOT {any_in(DOMAIN, fv.AGGREGATOR_HOSTS)} "
        f"AND {DOMAIN} NOT IN ({', '.join(map(q, fv.FREE_MAILBOXES))}) THEN 'https://' || {DOMAIN} END, '')")
STATED = lambda u: (f"(CASE WHEN {OWN(u)} IS NOT NULL AND regexp_matches({u}, {q(fv.CAREERS_URL)}) AND regexp_extract({path(u)}, {q(fv.CAREERS_PATH)}, 1) <> '' "
                    f"THEN {scheme(u)} || '://' || {host(u)} || regexp_extract({path(u)}, {q(fv.CAREERS_PATH)}, 1) END)")


def enrich_ctes(source: str) -> str:
    """-> `en` with contacts, site, careers page and links."""
    return f"""en0 AS (SELECT *, {EMAIL} AS public_email, {PHONE} AS public_phone, {person('name')} AS best_contact_name, {person('role')} AS found_role FROM {source}),
en1 AS (SELECT * EXCLUDE (company_website), {SITE} AS company_website, coalesce({STATED('apply_url')}, {STATED('url')}) AS stated FROM en0),
en AS (SELECT *, coalesce(stated, CASE WHEN company_website <> '' THEN regexp_replace(company_website, '/+$', '') || '/careers' END, '') AS careers_page,
  stated IS NULL AND company_website <> '' AS careers_page_guessed,
  CASE WHEN company <> '' THEN 'https://www.linkedin.com/search/results/companies/?keywords=' || replace(url_encode(company), '%20', '+') ELSE '' END AS linkedin,
  CASE WHEN found_role <> '' THEN found_role WHEN best_contact_name <> '' THEN 'Hiring contact' WHEN direct_employer THEN 'Direct employer — no agency in between' ELSE '' END AS contact_role,
  CASE WHEN apply_url <> '' THEN apply_url ELSE url END AS application_url, CASE WHEN url <> '' THEN url ELSE apply_url END AS original_job_url FROM en1)"""


# --------------------------------------------------------------------------- scoring

LOCAL = lambda ts: f"CAST(({ts}) AT TIME ZONE 'UTC' AT TIME ZONE '{PR.timezone}' AS DATE)"
AGE = f"(CASE WHEN posted_at IS NOT NULL THEN greatest(datediff('day', {LOCAL('posted_at')}, {LOCAL(RUN)}), 0) END)"


def applied(c: str, wide: bool) -> str:
    early = f"contains(lower({c}), 'among the first')" + (f" OR contains(lower({c}), 'first 25')" if wide else "")
    return (f"(CASE WHEN {c} = '' THEN NULL WHEN {early} THEN 10 WHEN contains(lower({c}), 'over 200') THEN 250 "
            f"ELSE TRY_CAST(replace(regexp_extract(lower({c}), '(\\d[\\d,]*)', 1), ',', '') AS INTEGER) END)")


def table_case(c: str, table: dict, default) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN {q(k)} THEN {float(v)}::DOUBLE" for k, v in table.items()) + f" ELSE {float(default)}::DOUBLE END)"


def weights(c: str, table: dict) -> str:
    return "(" + " + ".join(f"CASE WHEN {word(c, w)} THEN {float(v)}::DOUBLE ELSE 0 END" for w, v in table.items()) + ")"


HAS_PAY = "coalesce(nullif(salary_min, 0), nullif(salary_max, 0), nullif(day_rate_min, 0), nullif(day_rate_max, 0)) IS NOT NULL"
SKILLS = {k: v for k, v in PR.skills.items() if k not in PR.core_terms}
TITLED = word("n_title", A)
FIT = " + ".join([
    f"{table_case('core_skill_required', fv.CORE_POINTS, 0)} + CASE WHEN {TITLED} THEN 4.0::DOUBLE ELSE 0 END + {table_case('secondary_skill_required', fv.SECONDARY_POINTS, 0)}",
    f"least({weights('hay', SKILLS)}, 22)", f"least({weights('hay', PR.domain_keywords)}, 8)", table_case("seniority", fv.SENIORITY_POINTS, 3),
    f"CASE WHEN required_years IS NULL THEN 0 WHEN required_years <= {PR.years_experience} THEN 4 WHEN required_years <= {PR.years_experience + 3} THEN 2 ELSE -4 END",
    f"CASE WHEN starts_with(remote_status, 'Remote — {PR.home_country}') THEN 10 WHEN contains(remote_status, 'Worldwide') OR contains(remote_status, 'Europe/EMEA') OR contains(remote_status, {q(PR.region_terms[0])}) THEN 8 WHEN contains(remote_status, 'International contractor') THEN 6 ELSE 0 END",
    "CASE WHEN age IS NULL THEN 0 WHEN age <= 0 THEN 12 WHEN age = 1 THEN 9 WHEN age <= 3 THEN 6 ELSE 3 END",
    "CASE WHEN n_fit IS NULL THEN 0 WHEN n_fit <= 25 THEN 8 WHEN n_fit <= 75 THEN 2 WHEN n_fit <= 150 THEN -6 WHEN n_fit <= 200 THEN -10 ELSE -14 END",
    f"CASE WHEN company_size IN ({', '.join(map(q, fv.SMALL_SIZE_LABELS))}) THEN 6 WHEN company_size IN ({', '.join(map(q, fv.LARGE_SIZE_LABELS))}) THEN -6 ELSE 0 END",
    f"CASE WHEN {HAS_PAY} THEN 3 ELSE 0 END", f"CASE WHEN {TITLED} THEN 0 ELSE -least({weights('hay', PR.competing_stacks)}, 12) END",
    "CASE WHEN contains(hay, 'recruitment agency') OR contains(hay, 'our client') THEN -3 ELSE 0 END + CASE WHEN employment_type = 'Part Time' THEN -2 ELSE 0 END"])
NET = " + ".join([
    "CASE WHEN public_email <> '' THEN 25 ELSE 0 END", "CASE WHEN best_contact_name <> '' THEN 15 ELSE 0 END", "CASE WHEN public_phone <> '' THEN 10 ELSE 0 END",
    "CASE WHEN careers_page <> '' THEN 10 ELSE 0 END", "CASE WHEN company_website <> '' THEN 8 ELSE 0 END", "CASE WHEN linkedin <> '' THEN 7 ELSE 0 END",
    f"CASE WHEN application_url = '' THEN 0 WHEN {any_in('lower(application_url)', fv.APPLY_BOARD_DOMAINS)} THEN 5 ELSE 20 END", "CASE WHEN is_startup THEN 10 ELSE 0 END",
    f"CASE WHEN company_size IN ({', '.join(map(q, fv.TINY_SIZE_LABELS))}) THEN 5 ELSE 0 END", "CASE WHEN is_partnership THEN 5 ELSE 0 END",
    "CASE WHEN contains(hay, 'hiring manager') OR contains(hay, 'founder') OR contains(hay, 'cto') THEN 5 ELSE 0 END"])
NAME = "trim(coalesce(nullif(company, ''), 'Undisclosed'))"
DOMAIN_TEXT = f"concat_ws(' ', n_title, {norm('industry')}, n_body)"
FACTORS = [
    "CASE WHEN n_wide IS NULL THEN 0.96 WHEN n_wide <= 15 THEN 1.05 WHEN n_wide <= 25 THEN 1.03 WHEN n_wide <= 75 THEN 0.98 WHEN n_wide <= 150 THEN 0.85 WHEN n_wide <= 200 THEN 0.74 ELSE 0.6 END",
    "CASE WHEN age IS NULL THEN 0.9 WHEN age <= 1 THEN 1.03 WHEN age <= 7 THEN 1.0 WHEN age <= 21 THEN 0.9 WHEN age <= 45 THEN 0.76 ELSE 0.58 END",
    f"CASE WHEN contains(remote_status, {q(PR.home_country)}) THEN 1.06 WHEN contains(remote_status, 'Worldwide') THEN 0.85 WHEN contains(lower(remote_status), 'regional') THEN 0.98 WHEN contains(remote_status, 'On-site') OR contains(remote_status, 'Hybrid') THEN 1.04 WHEN remote_status IN ('', 'Not stated') THEN 0.7 ELSE 1 END",
    "CASE lower(seniority) WHEN 'senior' THEN 1.04 WHEN 'junior' THEN 0.5 WHEN 'mid' THEN 0.94 ELSE 1 END",
    "CASE core_skill_required WHEN 'Yes' THEN 1.08 WHEN 'No' THEN 0.78 ELSE 1 END",
    f"CASE WHEN {any_in('lower(source)', fv.BID_SOURCES)} THEN 0.4 WHEN regexp_matches({NAME}, {q('(?i)' + fv.BOARD_AS_EMPLOYER)}) THEN 0.75 WHEN regexp_matches({NAME}, {q('(?i)' + fv.AGENCY_NAME)}) THEN 0.84 WHEN {any_in('lower(source)', fv.DIRECT_SOURCES)} THEN 1.05 WHEN {any_in('lower(source)', fv.AGGREGATOR_SOURCES)} THEN 0.88 ELSE 1 END",
    f"CASE WHEN {any_word('domain_text', PR.domain_keywords)} THEN 1.06 ELSE 1 END",
    "CASE WHEN public_email <> '' OR best_contact_name <> '' THEN 1.04 ELSE 1 END",
    f"CASE WHEN required_years > {PR.years_experience + 3} THEN 0.82 WHEN required_years > {PR.years_experience} THEN 0.9 ELSE 1 END",
    f"CASE WHEN company_size IN ({', '.join(map(q, fv.TINY_SIZE_LABELS))}) THEN 1.05 WHEN company_size IN ({', '.join(map(q, fv.LARGE_SIZE_LABELS))}) THEN 0.88 ELSE 1 END"]
PRODUCT = " * ".join(f"CAST({f} AS DOUBLE)" for f in FACTORS)


def score_ctes(source: str) -> str:
    """From classified, priced, enriched rows with remote_status -> `sc` with the three scores."""
    return f"""s0 AS (SELECT *, {AGE} AS age, {applied('applicants', False)} AS n_fit, {applied('applicants', True)} AS n_wide, {DOMAIN_TEXT} AS domain_text FROM {source}),
s1 AS (SELECT *, CAST(least(greatest(round_even(CAST({FIT} AS DOUBLE), 0), 0), 100) AS INTEGER) AS cv_fit_score, CAST(least(greatest(CAST({NET} AS DOUBLE), 0), 100) AS INTEGER) AS networking_score,
  greatest({fv.CHANCE_FLOOR}::DOUBLE, least({fv.CHANCE_CEILING}::DOUBLE, {PRODUCT})) AS multiplier FROM s0),
sc AS (SELECT *, CAST(least(greatest(round_even(cv_fit_score * multiplier, 0), 1), {fv.CHANCE_MAX}) AS INTEGER) AS match_score FROM s1)"""


# ---------------------------------------------------------------------------- screen

MARKETS = PR.excluded_markets
MARKET_NAMES = "|".join(MARKETS)
LOC_MARKET = f"(n_location <> '' AND NOT {worldwide('n_location')} AND ({any_word('n_location', MARKETS)} OR {location_country('n_location')} IN ({', '.join(map(q, MARKETS))})))"
SCOPES = [r"(?:only|exclusively)?\s*(?:for|from|in|based in|located in|residing in)\s+({markets})\b"] + list(fv.MARKET_SCOPE[1:])
MARKET = f"({LOC_MARKET} OR (NOT {worldwide('lb')} AND {unnegated('n_body', [p.format(markets=MARKET_NAMES) for p in SCOPES])}))"


def lead_ctes(source: str) -> str:
    return ", ".join([class_ctes(source), enrich_ctes("cl"), resolved_pay("en"), score_ctes("pay")])


def screen_ctes() -> str:
    """-> `scr` with category and the lead columns of every relevant, fresh posting."""
    days = PR.freshness_days
    start = f"(CAST({LOCAL(RUN)} - {days - 1} AS TIMESTAMP) AT TIME ZONE '{PR.timezone}' AT TIME ZONE 'UTC')"
    return ", ".join([P, N, REL, f"""f0 AS (SELECT *, posted_at IS NULL OR posted_at >= {start} AS fresh, n_location || ' ' || n_body AS lb FROM rel WHERE title <> '' AND url <> ''),
f1 AS (SELECT *, {MARKET} AS bad_market FROM f0 WHERE gate = 0 AND fresh)""", elig_ctes("f1"),
        f"""v AS (SELECT * EXCLUDE (remote_status, eligibility), CASE WHEN el_category = 'not_remote' THEN {ARR_LABEL} ELSE remote_status END AS remote_status,
  CASE WHEN el_category = 'not_remote' THEN eligibility ELSE eligibility END AS eligibility, passed OR el_category = 'not_remote' AS ok FROM el)""",
        lead_ctes("v"), f"""scr AS (SELECT *, {ANNUAL} AS annual_usd, CASE WHEN bad_market THEN 'low_rate_market' WHEN NOT ok THEN 'ineligible'
  WHEN {ANNUAL} < {PR.salary_floor_usd} THEN 'low_pay' WHEN match_score < {fv.MIN_QUALIFY_SCORE} THEN 'low_score' ELSE '' END AS category FROM sc)"""])


# ------------------------------------------------------------------------- duplicates

FILLED = ("public_email", "public_phone", "best_contact_name", "contact_role", "company_website", "careers_page")


def merged_ctes(source: str) -> str:
    """From rows with a merge_key -> `mg`: the row each group ends with, one row folded in after another."""
    pay = "(coalesce(nullif({0}.salary_min, 0), nullif({0}.salary_max, 0)) IS NOT NULL)"
    rank = lambda t: (f"[CAST({t}.public_email <> '' AS BIGINT), CAST({t}.company_website <> '' AS BIGINT), CAST(coalesce(nullif({t}.salary_min, 0), nullif({t}.day_rate_min, 0)) IS NOT NULL AS BIGINT), "
                      f"CAST({t}.application_url <> '' AND NOT contains({t}.application_url, 'remoteok') AS BIGINT), {t}.match_score, length({t}.description)]")
    win = f"{rank('r')} > {rank('f')}"
    filled = ", ".join(f"CASE WHEN win THEN coalesce(nullif(r.{c}, ''), f.{c}) ELSE coalesce(nullif(f.{c}, ''), r.{c}) END AS {c}" for c in FILLED)

    def paid(c):
        return f"CASE WHEN win THEN CASE WHEN {pay.format('r')} OR NOT {pay.format('f')} THEN r.{c} ELSE f.{c} END ELSE CASE WHEN {pay.format('f')} OR NOT {pay.format('r')} THEN f.{c} ELSE r.{c} END END AS {c}"
    currency = (f"CASE WHEN win THEN CASE WHEN {pay.format('r')} OR NOT {pay.format('f')} THEN r.salary_currency ELSE coalesce(nullif(r.salary_currency, ''), f.salary_currency) END "
                f"ELSE CASE WHEN {pay.format('f')} OR NOT {pay.format('r')} THEN f.salary_currency ELSE coalesce(nullif(f.salary_currency, ''), r.salary_currency) END END AS salary_currency")
    kept = ", ".join(f"CASE WHEN win THEN r.{c} ELSE f.{c} END AS {c}" for c in ("posting_id", "day_rate_min", "application_url", "match_score", "description"))
    names = ["merge_key", "rn", "posting_id", "day_rate_min", "application_url", "match_score", "description", *FILLED, "salary_min", "salary_max", "salary_currency", "posted_at"]
    return f"""mr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY seq) AS rn FROM {source}),
mf AS (SELECT {', '.join(names)} FROM mr WHERE rn = 1 UNION ALL
  SELECT r.merge_key, r.rn, {kept}, {filled}, {paid('salary_min')}, {paid('salary_max')}, {currency},
    CASE WHEN win THEN CASE WHEN r.posted_at IS NOT NULL THEN least(r.posted_at, f.posted_at) END ELSE CASE WHEN f.posted_at IS NOT NULL THEN least(f.posted_at, r.posted_at) END END
  FROM mf f JOIN mr r ON r.merge_key = f.merge_key AND r.rn = f.rn + 1, LATERAL (SELECT {win} AS win)),
mc AS (SELECT merge_key, count(*) AS copies, min(seq) AS first_seq FROM mr GROUP BY merge_key),
mg AS (SELECT mf.*, copies, first_seq FROM mf JOIN mc ON mf.merge_key = mc.merge_key AND mf.rn = mc.copies)"""

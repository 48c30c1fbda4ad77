"""SQL fragments of the oracle side, written for DuckDB and independent of the Spark expressions."""

from __future__ import annotations

import re

from kontor import vocab as V


def text(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def blank(c: str) -> str:
    return f"(trim(coalesce({c}, '')) = '')"


def fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def norm(c: str) -> str:
    return f"trim(regexp_replace({fold(text(c))}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def clean(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('nan', 'none', '<na>', 'nat') THEN '' ELSE trim({c}) END)"


def key(n: str, c: str) -> str:
    return f"trim(regexp_replace({fold(f'''trim(coalesce({n}, '')) || ' ' || trim(coalesce({c}, ''))''')}, '\\s+', ' ', 'g'))"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def email(c: str) -> str:
    v = f"lower(trim(coalesce({c}, '')))"
    pattern = (r"^[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
               r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$")
    return (f"(CASE WHEN NOT regexp_matches({v}, '{pattern}') OR split_part({v}, '@', 2) IN ({listed(V.PLACEHOLDER_DOMAINS)}) "
            f"OR split_part({v}, '@', 1) IN ({listed(V.PLACEHOLDER_LOCALS + V.TECHNICAL_LOCALS)}) "
            f"OR regexp_matches({v}, '\\.(png|jpg|gif|css|js)$') THEN '' ELSE {v} END)")


def _let(name: str, value: str, body: str) -> str:
    """A value that is worked out once, however often the body names it."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _pieces(groups: tuple[int, ...], separator: str) -> str:
    at, parts = 1, []
    for size in groups:
        parts.append(f"its.n[{at}:{at + size - 1 if size else ''}]")
        at += size
    return f"rtrim({f' || {chr(39)}{separator}{chr(39)} || '.join(parts)}, '{separator}')"


def phone(c: str, p: str) -> str:
    """Columns p_raw … p (value), p_reason, p_type; later ones refer to earlier ones."""
    codes, planned = "|".join(V.COUNTRY_CODES.split()), dict.fromkeys(x[0] for x in V.NUMBER_PLAN)
    leads = {}  # longest leading digits first
    for k, (code, tokens, *_) in enumerate(V.NUMBER_PLAN):
        for token in tokens.split():
            leads.setdefault((len(re.sub(r"\[.*?\]", "x", token)), k, code), []).append(token)
    plan = " ".join(f"WHEN regexp_matches(its, '^{code} ({'|'.join(tokens)})') THEN {k}"
                    for (_, k, code), tokens in sorted(leads.items(), reverse=True))
    fits = " ".join(f"WHEN {k} THEN length(its.n) BETWEEN {least} AND {most}" for k, (_, _, least, most, *_) in enumerate(V.NUMBER_PLAN))
    shape = " ".join(f"WHEN {k} THEN {_pieces(groups, '-' if code == '1' else ' ')}" for k, (code, _, _, _, groups, _) in enumerate(V.NUMBER_PLAN))
    kind = " ".join(f"WHEN {k} THEN '{x[-1]}'" for k, x in enumerate(V.NUMBER_PLAN))
    low, high = V.OTHER_NUMBERS
    return f"""
 trim(regexp_replace(regexp_replace(split_part(regexp_replace(trim(coalesce({c}, '')), '^\\s*tel\\s*:\\s*', '', 'i'), '?', 1),
   '(?:ext\\.?|extension|durchwahl|dw\\.?|x)\\s*(\\d+)\\s*$', ' ext. \\1', 'i'), '\\s+', ' ', 'g')) AS {p}_raw,
 regexp_replace({p}_raw, '[^0-9]', '', 'g') AS {p}_digits, regexp_extract({p}_raw, ' ext\\. (\\d+)$', 1) AS {p}_ext,
 regexp_replace({p}_raw, ' ext\\. (\\d+)$', '') AS {p}_core, regexp_matches({p}_raw, '^(\\+|00)') AS {p}_intl,
 CASE WHEN {p}_intl THEN regexp_replace(regexp_replace({p}_core, '^00', ''), '[^0-9]', '', 'g')
   ELSE regexp_replace(regexp_replace({p}_core, '[^0-9]', '', 'g'), '^0', '') END AS {p}_nat,
 CASE WHEN {p}_intl THEN regexp_extract({p}_nat, '^({codes})', 1) ELSE '49' END AS {p}_code,
 {_let('its', f"{{'c': {p}_code, 'n': {p}_nat, 'i': {p}_intl}}", f"regexp_replace(CASE WHEN its.i THEN its.n[length(its.c) + 1:] ELSE its.n END, CASE WHEN its.c IN ({listed(V.TRUNK_CODES)}) THEN '^0' ELSE '^$' END, '')")} AS {p}_num,
 {_let('its', f"{p}_code || ' ' || {p}_num", f"CASE {plan} WHEN starts_with(its, ' ') OR split_part(its, ' ', 1) IN ({listed(planned)}) THEN -1 ELSE 1000 END")} AS {p}_plan,
 {_let('its', f"{{'c': {p}_code, 'n': {p}_num, 'p': {p}_plan}}", f"(its.c <> '1' OR its.n[4:4] >= '2') AND CASE its.p {fits} WHEN 1000 THEN length(its.c || its.n) BETWEEN {low} AND {high} ELSE false END")} AS {p}_fits,
 CASE WHEN {p}_raw = '' THEN 'leer' WHEN length({p}_digits) < 7 THEN 'zu wenige Ziffern oder lokale Nummer ohne Vorwahl'
   WHEN length({p}_digits) > 15 THEN 'zu viele Ziffern'
   WHEN replace({p}_digits, {p}_digits[1:1], '') = '' OR replace({p}_digits, {p}_digits[1:2], '') = '' THEN 'wiederholte Zahlenfolge'
   WHEN regexp_matches({p}_digits, '^(19|20)\\d{{6}}$') OR {p}_digits IN ('0123456789', '9876543210') THEN 'Datum oder technische Zahlenfolge'
   WHEN NOT {p}_intl AND {p}_raw[1:1] <> '0' THEN 'lokale Nummer ohne Vorwahl'
   WHEN regexp_matches({p}_core, '[^0-9+\\s()./\\\\\\-]') OR {p}_code = '' THEN 'nicht parsebar'
   WHEN NOT {p}_fits THEN 'ungültige Vorwahl oder Rufnummer' ELSE '' END AS {p}_reason,
 CASE WHEN {p}_reason <> '' THEN '' ELSE {_let('its', f"{{'c': {p}_code, 'n': {p}_num, 'p': {p}_plan}}", f"'+' || its.c || ' ' || CASE its.p {shape} ELSE its.n END")} || CASE WHEN {p}_ext = '' THEN '' ELSE ' ext. ' || {p}_ext END END AS {p},
 CASE WHEN {p}_reason <> '' THEN 'unknown' ELSE CASE {p}_plan {kind} ELSE 'other' END END AS {p}_type"""


def _parts(p: str) -> str:
    drop = listed(V.TRACKING_PARAMETERS)
    return f"""
 lower(regexp_extract({p}_url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS {p}_scheme, regexp_extract({p}_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS {p}_host,
 regexp_replace(regexp_extract({p}_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS {p}_path,
 array_to_string(list_filter(string_split(regexp_extract({p}_url, '\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.')
   AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ({drop})), '&') AS {p}_query,
 regexp_matches(lower({p}_path), '\\.(pdf|jpg|jpeg|png|gif|webp|svg|zip|doc|docx|xls|xlsx|ppt|pptx)$') AS {p}_doc,
 {p}_scheme IN ('http', 'https') AND {p}_host <> '' AND regexp_replace(lower({p}_host), '^www\\.', '') NOT IN ({listed(V.BLACKLISTED_HOSTS)}) AS {p}_ok"""


def website(c: str, p: str) -> str:
    return f"""
 CASE WHEN regexp_matches({text(c)}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN {text(c)} ELSE 'https://' || {text(c)} END AS {p}_url, {_parts(p)},
 CASE WHEN {text(c)} = '' OR NOT {p}_ok OR {p}_doc THEN '' ELSE rtrim({p}_scheme || '://' || lower({p}_host) || CASE WHEN {p}_path = '' THEN '/' ELSE {p}_path END
   || CASE WHEN {p}_query = '' THEN '' ELSE '?' || {p}_query END, '/') END AS {p}"""


def clean_url(c: str, p: str) -> str:
    return f"""
 trim(coalesce({c}, '')) AS {p}_url, {_parts(p)},
 CASE WHEN NOT {p}_ok THEN '' ELSE {p}_scheme || '://' || {p}_host || CASE WHEN {p}_path = '' OR {p}_doc THEN '/' ELSE {p}_path END
   || CASE WHEN {p}_query = '' THEN '' ELSE '?' || {p}_query END END AS {p}"""


def postal(c: str) -> str:
    v = f"regexp_replace({clean(c)}, '\\s+', '', 'g')"
    n = f"try_cast(replace({v}, ',', '.') AS decimal(38, 9))"
    return (f"(CASE WHEN regexp_matches({v}, '^[+-]?\\d+$') THEN ltrim({v}, '+') WHEN {n} IS NOT NULL AND {n} = floor({n}) "
            f"THEN cast(cast({n} AS bigint) AS varchar) ELSE {v} END)")


_HOUSE = "\\d+\\s*[a-z]?|\\d+\\s*-\\s*\\d+"


def words(c: str) -> str:
    return f"trim(regexp_replace(strip_accents({fold(clean(c))}), '[\\s.,]+', ' ', 'g'))"


def street(c: str) -> str:
    cut = f"trim(regexp_replace({words(c)}, '^(.*?)\\b(?:{_HOUSE})\\b', '\\1 '))"
    spelled = f"regexp_replace(regexp_replace({cut}, '(?:strasse|str)\\b', 'strasse', 'g'), '(?:platz|pl)\\b', 'platz', 'g')"
    return f"trim(regexp_replace(regexp_replace({spelled}, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def house(c: str) -> str:
    return f"regexp_replace(regexp_extract({words(c)}, '\\b({_HOUSE})\\b', 1), '\\s+', '', 'g')"


def status(website_: str, phone_ok: str, email_ok: str) -> str:
    return (f"CASE WHEN {blank(website_)} THEN 'Nicht gefunden' WHEN {phone_ok} AND {email_ok} THEN 'Vollständig' "
            f"WHEN {phone_ok} OR {email_ok} THEN 'Aktiv' ELSE 'Nicht aktiv' END")


_FIELDS = ("KUNDENNAME", "CITY", "STRASSE", "PLZ", "TELEFON", "EMAIL", "WEBSITE")

# Normalised import rows: n(row_no, cells, n_name, n_city, n_phone, n_email, n_website, n_address, n_all, n_filled, points)
NORMALIZED = f"""WITH n AS (SELECT *, {norm('KUNDENNAME')} AS n_name, {norm('CITY')} AS n_city, {email('EMAIL')} AS n_email, {street('STRASSE')} AS n_address,
 {phone('TELEFON', 'n_phone')}, {website('WEBSITE', 'n_website')},
 concat_ws('|', n_name, n_city, {norm('STRASSE')}, {postal('PLZ')}, CASE WHEN n_phone = '' THEN {fold(text('TELEFON'))} ELSE n_phone END,
   CASE WHEN n_email = '' THEN {fold(text('EMAIL'))} ELSE n_email END, CASE WHEN n_website = '' THEN {fold(text('WEBSITE'))} ELSE n_website END) AS n_all,
 {' + '.join(f"CASE WHEN {blank(f)} THEN 0 ELSE 1 END" for f in _FIELDS)} AS n_filled,
 35 * (n_name <> '')::int + 10 * (n_city <> '')::int + 20 * (n_website <> '')::int + 15 * (n_phone <> '')::int + 15 * (n_email <> '')::int AS points
 FROM {{source}})"""

_CONFLICTS = " || ".join(
    f"CASE WHEN count(DISTINCT nullif(n_{f}, '')) > 1 THEN '{f},' ELSE '' END" for f in ("city", "address", "phone", "email", "website"))
_DIFFERENCES = " || ".join(f"CASE WHEN count(DISTINCT nullif({text(f)}, '')) > 1 THEN '{f},' ELSE '' END" for f in _FIELDS)
_MASTER = "arg_min(row_no, ((n_phone = '' OR n_email = '')::int, (n_website = '')::int, (n_address = '')::int, -n_filled, row_no))"
PROFILE = f"count(*) AS size, min(row_no) AS first_row, {_MASTER} AS master_row, {_CONFLICTS} AS conflicts, {_DIFFERENCES} AS differences"

# Name groups ng and near-typo groups sg on top of n
GROUPS = f"""
ng AS (SELECT n_name, CASE WHEN count(DISTINCT n_all) = 1 THEN 'identical' WHEN {_CONFLICTS} = '' THEN 'safe' ELSE 'unsafe' END AS category, {PROFILE}
  FROM n WHERE n_filled > 0 AND n_name <> '' GROUP BY n_name HAVING count(*) > 1),
single AS (SELECT min(row_no) AS row_no, n_name, min(n_city) AS n_city, replace(n_name, ' ', '') AS compact FROM n WHERE n_filled > 0 AND n_name <> '' GROUP BY n_name HAVING count(*) = 1),
sig AS (SELECT DISTINCT row_no, n_name, n_city, unnest(list_append(list_transform(range(1, length(compact) + 1), lambda i: compact[:i - 1] || compact[i + 1:]), compact)) AS s FROM single),
edge AS (SELECT DISTINCT a.row_no AS ra, b.row_no AS rb FROM sig a JOIN sig b ON a.n_city = b.n_city AND a.s = b.s AND a.row_no < b.row_no
  WHERE 100.0 * (length(a.n_name) + length(b.n_name) - CASE WHEN length(a.n_name) = length(b.n_name) THEN 2 ELSE 1 END) / (length(a.n_name) + length(b.n_name)) >= 90
    AND regexp_extract_all(a.n_name, '\\d+') = regexp_extract_all(b.n_name, '\\d+')),
link AS (SELECT ra AS v, rb AS u FROM edge UNION SELECT rb, ra FROM edge),
reach(v, u) AS (SELECT v, u FROM link UNION SELECT r.v, l.u FROM reach r JOIN link l ON r.u = l.v),
comp AS (SELECT v AS row_no, least(v, min(u)) AS component FROM reach GROUP BY v),
sg AS (SELECT component, 'unsafe' AS category, {PROFILE} FROM n JOIN comp USING (row_no) GROUP BY component)"""


def normalized(query: str, source: str = "v_import", groups: bool = False) -> str:
    base = NORMALIZED.replace("{source}", source)
    if groups:
        base = base.replace("WITH n AS", "WITH RECURSIVE n AS", 1) + "," + GROUPS
    return f"{base}\n{query}"

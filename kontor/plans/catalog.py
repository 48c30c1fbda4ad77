"""Query catalogue: every operator as a query over the driver tables, with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import address as A
from kontor.functions import contacts as C
from kontor.functions import text as T
from kontor.functions import web as U
from kontor.operators import crm, dashboard, enrich, filters, imprint, merge, pages, quality, research, similarity
from kontor.operators.common import attach, keep_first, nth_of_key, with_row_no
from kontor.plans import oracle as O
from kontor.plans.views import NOW, load, with_views
from kontor.session import tune
from kontor.sources import tables
from kontor.streaming import streams


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


CATALOG: dict[str, Query] = {}
_DAY = NOW[:10]


class Inputs:
    """Lazy access to the tables and views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("pages", "documents", "part", "events"):
            return load(self.spark, self.sf_dir, name)
        return load(self.spark, self.sf_dir, "v_import" if name == "imported" else f"v_{name}")


def query(name: str, operators: str, sql: str | None = None, *views: str):
    """Register a function of the inputs under a name."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(tune(spark), sf_dir))

        CATALOG[name] = Query(run, with_views(sql, *views) if sql and views else sql, operators)
        return fn

    return register


def rows(name: str, operators: str, where: str, source: str = "v_customers"):
    """A filter query: the row numbers that pass."""
    return query(name, operators, f"SELECT row_no FROM {source} WHERE {where}", source)


_norm = O.normalized

# ------------------------------------------------------------------ quality
query("dashboard_quality", "A1 X1-X3 X12-X15 W1", _norm("""SELECT cast(round_even((sum(points) + 5 * (count(*) - (count(*) FILTER (n_name <> '') - count(DISTINCT (n_name, n_city)) FILTER (n_name <> '')))) / count(*), 0) AS bigint) AS quality_score,
  count(*) FILTER (trim(coalesce("TELEFON", '')) <> '' AND n_phone = '') AS invalid_phone, count(*) FILTER (trim(coalesce("EMAIL", '')) <> '' AND n_email = '') AS invalid_email,
  count(*) FILTER (n_name <> '') - count(DISTINCT (n_name, n_city)) FILTER (n_name <> '') AS duplicates FROM n"""), "v_import")(
    lambda i: quality.dashboard_quality(i.imported))
query("repeat_flag", "W1", f"""SELECT row_no, n_name <> '' AND row_number() OVER (PARTITION BY n_name, n_city ORDER BY row_no) > 1 AS repeat
  FROM (SELECT row_no, {O.norm('"KUNDENNAME"')} AS n_name, {O.norm('"CITY"')} AS n_city FROM v_import)""", "v_import")(
    lambda i: quality.repeat_flag(i.imported).select("row_no", "repeat"))
query("normalized_rows", "D2 X2 X3 X10 X12 X14 X15", _norm("SELECT row_no, n_name, n_city, n_phone, n_email, n_website, n_address, n_filled = 0 AS n_empty FROM n"), "v_import")(
    lambda i: quality.normalize_rows(i.imported).select("row_no", "n_name", "n_city", "n_phone", "n_email", "n_website", "n_address", "n_empty"))
_POSTAL_TEXT = O.text('"PLZ"')
query("import_issues", "D8 W2", _norm(f"""SELECT row_no, row_no + 2 AS excel_row, f.kind AS kind, f.field AS field, f.v AS original_value FROM n, LATERAL (SELECT unnest([
  {{'kind': 'empty_row', 'field': '', 'v': '', 'ok': n_filled = 0}},
  {{'kind': 'missing', 'field': 'KUNDENNAME', 'v': '', 'ok': n_filled > 0 AND n_name = ''}}, {{'kind': 'missing', 'field': 'CITY', 'v': '', 'ok': n_filled > 0 AND n_city = ''}},
  {{'kind': 'invalid_phone', 'field': 'TELEFON', 'v': {O.text('"TELEFON"')}, 'ok': NOT {O.blank('"TELEFON"')} AND n_phone = ''}},
  {{'kind': 'invalid_email', 'field': 'EMAIL', 'v': {O.text('"EMAIL"')}, 'ok': NOT {O.blank('"EMAIL"')} AND n_email = ''}},
  {{'kind': 'website_normalizable', 'field': 'WEBSITE', 'v': {O.text('"WEBSITE"')}, 'ok': n_website <> '' AND n_website <> rtrim({O.text('"WEBSITE"')}, '/')}},
  {{'kind': 'invalid_postal_code', 'field': 'PLZ', 'v': {_POSTAL_TEXT}, 'ok': regexp_matches({_POSTAL_TEXT}, '^[+-]?\\d+[.,]\\d+$') AND NOT regexp_matches({_POSTAL_TEXT}, '[.,]0+$')}},
  {{'kind': 'short_postal_code', 'field': 'PLZ', 'v': {O.postal('"PLZ"')}, 'ok': regexp_matches({O.postal('"PLZ"')}, '^\\d{{1,4}}$')}}]) AS f) WHERE f.ok"""), "v_import")(
    lambda i: quality.issues(i.imported).drop("message"))
query("issues_view", "F27", _norm(f"""SELECT row_no + 2 AS excel_row, 'TELEFON' AS field, 'Ungültige Telefonnummer' AS message, {O.text('"TELEFON"')} AS original_value
  FROM n WHERE NOT {O.blank('"TELEFON"')} AND n_phone = ''"""), "v_import")(
    lambda i: quality.issues_view(quality.issues(i.imported), "phones"))
_GROUP_COLUMNS = "category, size, first_row, master_row, CASE WHEN category = 'identical' THEN '' ELSE conflicts END AS conflicts, differences"


def _group_text(groups: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(","))), "")
    return groups.select("category", "size", "first_row", "master_row", joined("conflicts").alias("conflicts"), joined("differences").alias("differences"))


query("name_groups", "D3 D4 D5 D6 A19", _norm(f"SELECT {_GROUP_COLUMNS} FROM ng", groups=True), "v_import")(
    lambda i: _group_text(quality.name_groups(quality.normalize_rows(i.imported), quality.data_columns(i.imported))))
query("similar_groups", "D7 J12 X18 X19", _norm("SELECT category, size, first_row, master_row, conflicts, differences FROM sg", groups=True), "v_import")(
    lambda i: _group_text(quality.similar_groups(quality.normalize_rows(i.imported), quality.data_columns(i.imported))))
query("near_typo_edges", "J12", _norm("SELECT ra AS row_a, rb AS row_b FROM edge", groups=True), "v_import")(
    lambda i: similarity.blocked_similar(_single_names(i.imported)))


def _single_names(df: DataFrame) -> DataFrame:
    named = quality.normalize_rows(df).filter("NOT n_empty AND n_name <> ''")
    return named.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("row_no"), F.min("n_city").alias("n_city")).filter("n = 1")


_ALL_GROUPS = "SELECT category, size, conflicts FROM ng UNION ALL SELECT category, size, conflicts FROM sg"
_SCORE = "cast(round_even((s.points - 5 * g.repeats) / nullif(s.n, 0), 0) AS bigint) AS quality_score"
query("import_summary", "A2 A3 D9", _norm(f"""SELECT total_rows, valid_records, missing_customer_name, missing_city, invalid_phones, invalid_emails, empty_websites, normalizable_websites, empty_rows,
  identical_duplicates, similar_groups, {_SCORE} FROM (SELECT count(*) AS total_rows, count(*) FILTER (n_filled > 0 AND n_name <> '') AS valid_records, count(*) FILTER (n_filled > 0 AND n_name = '') AS missing_customer_name,
   count(*) FILTER (n_filled > 0 AND n_city = '') AS missing_city, count(*) FILTER (NOT {O.blank('"TELEFON"')} AND n_phone = '') AS invalid_phones,
   count(*) FILTER (NOT {O.blank('"EMAIL"')} AND n_email = '') AS invalid_emails, count(*) FILTER (n_filled > 0 AND n_website = '') AS empty_websites,
   count(*) FILTER (n_website <> '' AND n_website <> rtrim({O.text('"WEBSITE"')}, '/')) AS normalizable_websites, count(*) FILTER (n_filled = 0) AS empty_rows,
   sum(points + 5) FILTER (n_filled > 0) AS points, count(*) FILTER (n_filled > 0) AS n FROM n) s,
  (SELECT cast(coalesce(sum(size - 1) FILTER (category = 'identical'), 0) AS bigint) AS identical_duplicates, count(*) FILTER (category <> 'identical') AS similar_groups, sum(size - 1) AS repeats FROM ({_ALL_GROUPS})) g""", groups=True), "v_import")(
    lambda i: quality.import_summary(i.imported))
query("quality_score", "A3", _norm(f"""SELECT {_SCORE} FROM (SELECT sum(points + 5) FILTER (n_filled > 0) AS points, count(*) FILTER (n_filled > 0) AS n FROM n) s,
  (SELECT sum(size - 1) AS repeats FROM ({_ALL_GROUPS})) g""", groups=True), "v_import")(
    lambda i: quality.quality_score(quality.normalize_rows(i.imported), quality.duplicate_groups(i.imported)))
_CELLS = ("KUNDENNAME", "CITY", "STRASSE", "PLZ", "TELEFON", "EMAIL", "WEBSITE")
_MERGED = """, t AS (SELECT n.*, g.master_row, g.category FROM n LEFT JOIN (SELECT * FROM ng WHERE category <> 'unsafe') g ON n.n_name = g.n_name AND n.n_filled > 0),
 m AS (SELECT row_no, """ + ", ".join(
    f"""CASE WHEN {O.blank(f'"{c}"')} THEN coalesce((SELECT arg_min(o."{c}", o.row_no) FROM t o WHERE o.master_row = t.row_no AND o.row_no <> t.row_no AND NOT {O.blank(f'o."{c}"')}), "{c}") ELSE "{c}" END AS "{c}" """
    for c in _CELLS) + " FROM t WHERE master_row IS NULL OR master_row = row_no)"
query("merge_groups", "D10", _norm("SELECT * FROM m", groups=True).replace("\nSELECT * FROM m", _MERGED + "\nSELECT * FROM m"), "v_import")(
    lambda i: quality.merge_groups(i.imported))
_CLEANED = f"""SELECT row_no, "KUNDENNAME", "CITY", "STRASSE", {O.postal('"PLZ"')} AS "PLZ",
  CASE WHEN {O.blank('"TELEFON"')} THEN "TELEFON" WHEN n_phone <> {O.text('"TELEFON"')} THEN n_phone ELSE "TELEFON" END AS "TELEFON",
  CASE WHEN {O.blank('"EMAIL"')} THEN "EMAIL" ELSE n_email END AS "EMAIL",
  CASE WHEN n_website <> '' AND n_website <> rtrim({O.text('"WEBSITE"')}, '/') THEN n_website ELSE "WEBSITE" END AS "WEBSITE" FROM n WHERE NOT {O.blank('"KUNDENNAME"')}"""
query("clean_rows", "D11 X9", _norm(_CLEANED), "v_import")(lambda i: quality.clean_rows(i.imported))
query("import_report", "A13 D12", _norm(f"""SELECT (SELECT count(*) FROM n) AS rows_before, (SELECT count(*) FROM m WHERE {O.blank('"KUNDENNAME"')}) AS skipped_rows, count(*) AS rows_after,
  count(*) FILTER (NOT {O.blank('c."TELEFON"')} AND c.n_phone <> {O.text('c."TELEFON"')}) AS corrected_phones, count(*) FILTER (NOT {O.blank('c."EMAIL"')} AND c.n_email = '') AS discarded_emails,
  count(*) FILTER (c.n_website <> '' AND c.n_website <> rtrim({O.text('c."WEBSITE"')}, '/')) AS normalized_websites,
  (SELECT cast(coalesce(sum(size - 1), 0) AS bigint) FROM ng WHERE category = 'identical') AS removed_identical, (SELECT count(*) FROM ng WHERE category = 'safe') AS merged_groups,
  (SELECT count(*) FROM (SELECT conflicts, category FROM ng UNION ALL SELECT conflicts, category FROM sg) WHERE conflicts <> '' AND category <> 'identical') AS open_conflicts
  FROM (SELECT *, {O.email('"EMAIL"')} AS n_email, {O.phone('"TELEFON"', 'n_phone')}, {O.website('"WEBSITE"', 'n_website')} FROM m WHERE NOT {O.blank('"KUNDENNAME"')}) c""", groups=True).replace("\nSELECT (SELECT count", _MERGED + "\nSELECT (SELECT count"), "v_import")(
    lambda i: quality.import_report(i.imported))
query("unchanged_report", "D12", _norm("""SELECT (SELECT count(*) FROM n) AS rows_before, (SELECT count(*) FROM n) AS rows_after, 0::bigint AS removed_identical, 0::bigint AS merged_groups, 0::bigint AS skipped_rows,
  0::bigint AS corrected_phones, 0::bigint AS discarded_emails, 0::bigint AS normalized_websites, (SELECT count(*) FROM ng WHERE conflicts <> '' AND category <> 'identical') AS open_conflicts""", groups=True), "v_import")(
    lambda i: quality.unchanged_report(i.imported, quality.name_groups(quality.normalize_rows(i.imported), list(_CELLS))))
query("groups_view", "F30", _norm(f"""SELECT CASE g.category WHEN 'identical' THEN 'Identisch' WHEN 'safe' THEN 'Sicher zusammenführbar' ELSE 'Unsicher' END AS label, size, first_row + 2 AS first_excel_row,
  {O.text('"KUNDENNAME"')} AS name, {O.text('"CITY"')} AS city, replace(rtrim(differences, ','), ',', ', ') AS differences, CASE WHEN g.category = 'identical' THEN '' ELSE replace(rtrim(conflicts, ','), ',', ', ') END AS conflicts
  FROM ng g JOIN v_import ON first_row = row_no""", groups=True), "v_import")(
    lambda i: quality.groups_view(quality.name_groups(quality.normalize_rows(i.imported), list(_CELLS)), i.imported).drop("group_id"))
query("exact_duplicates", "D1 O1", """SELECT row_no, "KUNDENNAME", "CITY" FROM v_customers QUALIFY count(*) OVER (PARTITION BY "KUNDENNAME", "CITY") > 1""", "v_customers")(
    lambda i: quality.exact_duplicates(i.customers).select("row_no", "KUNDENNAME", "CITY"))
# Literal numbers of many countries and what becomes of them, dealt to the customers by their number.
_NUMBERS = (
    ("+33 1 42 68 53 00", "+33 1 42 68 53 00", "fixed"), ("0033 (0)6 12 34 56 78", "+33 6 12 34 56 78", "mobile"), ("+39 06 1234 5678", "+39 06 1234 5678", "fixed"),
    ("+39 312 345 6789", "+39 312 345 6789", "mobile"), ("+34 912345678", "+34 912 34 56 78", "fixed"), ("+34 612-345-678", "+34 612 34 56 78", "mobile"),
    ("+31 (0)20 123 4567", "+31 20 123 4567", "fixed"), ("+31 6 12345678", "+31 6 12345678", "mobile"), ("+32 2 123 45 67", "+32 2 123 45 67", "fixed"),
    ("+32 470/12.34.56", "+32 470 12 34 56", "mobile"), ("+352 621 123 456", "+352 621 123 456", "mobile"), ("+44 (0)20 7946 0018", "+44 20 7946 0018", "fixed"),
    ("+44 7400 123456", "+44 7400 123456", "mobile"), ("+48 22 123 45 67", "+48 22 123 45 67", "fixed"), ("+420 601 123 456", "+420 601 123 456", "mobile"),
    ("+45 32123456", "+45 32 12 34 56", "fixed"), ("+46 8 123 456 78", "+46 8 123 456 78", "fixed"), ("+47 406 12 345", "+47 406 12 345", "mobile"),
    ("+351 212 345 678", "+351 212 345 678", "fixed"), ("+36 1 234 5678", "+36 1 234 5678", "fixed"), ("+43 664 123456", "+43 664 123456", "mobile"),
    ("+41 44 668 18 00", "+41 44 668 18 00", "fixed"), ("+1 212 555 0123", "+1 212-555-0123", "fixed"), ("+1 800 234 5678", "+1 800-234-5678", "hotline"),
    ("+49 (0)30 901820", "+49 30 901820", "fixed"), ("0171 2345678", "+49 171 2345678", "mobile"), ("+886 2 2345 6789", "+886 223456789", "other"),
    ("+210 1234567", "", "unknown"), ("+999 1234567", "", "unknown"), ("+33 1 42 68", "", "unknown"), ("+1 212 155 0123", "", "unknown"), ("+45 1234567", "", "unknown"))
_NUMBER_ROWS = ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(_NUMBERS))


def _dealt_numbers(df: DataFrame) -> DataFrame:
    given = F.element_at(F.split(F.lit("|".join(x[0] for x in _NUMBERS)), r"\|"), (F.col("row_no") % len(_NUMBERS) + 1).cast("int"))
    return C.with_phone(df.select("row_no", given.alias("given")), F.col("given"), "phone").select("row_no", "given", "phone", F.col("phone_type").alias("kind"))


# Names in several scripts and their comparison forms.
_SCRIPTS = (
    ("\u0391\u0301\u03bb\u03c6\u03b1  \u0395\u03a0\u0395", "άλφα επε"), ("\u0418\u0306\u043e\u0433\u0443\u0440\u0442 \u041e\u041e\u041e", "йогурт ооо"),
    ("\u1112\u1161\u11ab\u1100\u116e\u11a8 \u1109\u1161", "한국 사"), ("\ufb01nanz \ufb03x", "finanz ffix"), ("\uff21\uff22 \u2460", "ab 1"), ("\u30ab\u3099\u30b9", "ガス"),
    ("\uff76\uff9e\uff7d", "ガス"), ("\u3392 Funk", "mhz funk", "MHz funk MHz funk"), ("Cafe\u0301", "café"), ("\u05e9\u05c1alom", "ש alom", "שׁalom שׁalom"), ("\u1e9b\u0323", "ṩ"), ("\ud55c\uae00", "한글"))
_SCRIPT_ROWS = ", ".join(f"({k}, '{b}', '{key[0] if key else b + ' ' + b}')" for k, (_, b, *key) in enumerate(_SCRIPTS))


def _dealt_names(df: DataFrame) -> DataFrame:
    given = F.element_at(F.split(F.lit("|".join(x[0] for x in _SCRIPTS)), r"\|"), (F.col("row_no") % len(_SCRIPTS) + 1).cast("int"))
    return df.select("row_no", given.alias("given")).select("row_no", T.norm_name(F.col("given")).alias("n_name"), T.company_key(F.col("given"), F.col("given")).alias("company_key"))


query("names_of_scripts", "X2 X3 X4", f"""SELECT row_no, n_name, company_key FROM v_import JOIN (VALUES {_SCRIPT_ROWS}) t(k, n_name, company_key) ON row_no % {len(_SCRIPTS)} = k""", "v_import")(
    lambda i: _dealt_names(i.imported))
query("phones_of_countries", "X14", f"""SELECT row_no, given, phone, kind FROM v_import JOIN (VALUES {_NUMBER_ROWS}) t(k, given, phone, kind) ON row_no % {len(_NUMBERS)} = k""", "v_import")(
    lambda i: _dealt_numbers(i.imported))
# All pairs of names; those a banded edit distance leaves are compared by their longest common subsequence, a bit a character.
_PAIRS = """WITH nm AS (SELECT coalesce("KUNDENNAME", '') AS name, count(*) AS n FROM v_import GROUP BY 1),
 near AS (SELECT a.name AS x, b.name AS y, a.n AS n_a, b.n AS n_b, (1::bigint << length(a.name)) - 1 AS every FROM nm a JOIN nm b ON a.name < b.name
   WHERE a.name <> '' AND levenshtein(a.name, b.name) <= (length(a.name) + length(b.name)) // 10),
 masks AS (SELECT *, list_transform(string_split(y, ''), lambda c: list_sum(list_transform(range(length(x)), lambda i: CASE WHEN x[i + 1] = c THEN 1::bigint << i ELSE 0 END))::bigint) AS m FROM near),
 common AS (SELECT *, length(x) - bit_count(list_reduce(list_concat([every], m), lambda r, h: ((r + (r & h)) | (r - (r & h))) & every)) AS lcs FROM masks),
 pairs AS (SELECT x AS name_a, y AS name_b, n_a, n_b, 200.0::double * lcs / (length(x) + length(y)) AS match, n_a * n_b AS row_pairs FROM common WHERE 200 * lcs >= 90 * (length(x) + length(y))
   UNION ALL SELECT name, name, n, n, 100.0, n * (n - 1) // 2 FROM nm WHERE n > 1)"""
query("similar_names", "J11 X17", f"{_PAIRS} SELECT * FROM pairs", "v_import")(lambda i: similarity.similar_pairs(i.imported))
query("duplicate_statistics", "A12", f"""{_PAIRS} SELECT (SELECT count(*) FROM v_import) AS rows, (SELECT cast(coalesce(sum(n), 0) AS bigint) FROM (SELECT count(*) AS n FROM v_import GROUP BY "KUNDENNAME", "CITY") WHERE n > 1) AS exact_duplicates,
  cast(2 * sum(row_pairs) AS bigint) AS similar_duplicates FROM pairs""", "v_import")(lambda i: similarity.duplicate_statistics(i.imported))

# ------------------------------------------------------------------ filters
_C = lambda f: (lambda i: f(i.customers).select("row_no"))
_COLUMNS = ("ID", "KUNDENNAME", "CITY", "STRASSE", "PLZ", "TELEFON", "EMAIL", "WEBSITE", "STATUS", "PRIORITÄT", "TAGS", "NÄCHSTE_WIEDERVORLAGE", "ANALYZED_AT",
            "WEBSITE_SCORE_CATEGORY", "HAS_IMPRINT", "HAS_OPENING_HOURS", "INDUSTRY", "SOCIAL_MEDIA", "ENRICHMENT_STATUS", "LAST_CHECK")
rows("search", "F1", " OR ".join(f"""regexp_matches(lower(coalesce(cast("{c}" AS varchar), '')), 'ort [ab]|messe')""" for c in _COLUMNS))(_C(lambda d: filters.search(d, " Ort [ab]|Messe ")))
rows("search_literal", "F1", " OR ".join(f"""contains(lower(coalesce(cast("{c}" AS varchar), '')), 'str. 1')""" for c in _COLUMNS))(_C(lambda d: filters.search(d, "Str. 1", literal=True)))
_STATUS = O.fold(O.clean('"STATUS"'))
for _k, _allowed in V.STATUS_FILTERS.items():
    if _allowed:
        rows(f"status_{_k}", "F2 X5", f"{_STATUS} IN ({O.listed(_allowed)})")(_C(lambda d, k=_k: filters.status_filter(d, k)))
rows("priority_filter", "F3", """coalesce("PRIORITÄT", '') = 'Hoch'""")(_C(lambda d: filters.priority_filter(d, "Hoch")))
rows("tag_filter", "F4", """contains(lower(coalesce("TAGS", '')), 'messe')""")(_C(lambda d: filters.tag_filter(d, "MESSE")))
rows("followups_only", "F5", """trim(coalesce("NÄCHSTE_WIEDERVORLAGE", '')) <> ''""")(_C(filters.followups_only))
_ANALYZED = """trim(coalesce("ANALYZED_AT", '')) <> ''"""
rows("score_category_filter", "F6", """"WEBSITE_SCORE_CATEGORY" = 'Gut'""")(_C(lambda d: filters.score_filter(d, "Gut")))
rows("score_not_analyzed", "F6", f"NOT ({_ANALYZED})")(_C(lambda d: filters.score_filter(d, "Nicht analysiert")))
rows("score_without_imprint", "F6", f'{_ANALYZED} AND NOT "HAS_IMPRINT"')(_C(lambda d: filters.score_filter(d, "Ohne Impressum")))
rows("industry_filter", "F7", """contains(lower("INDUSTRY"), 'economy')""")(_C(lambda d: filters.industry_filter(d, "Economy")))
rows("social_filter", "F8", """trim("SOCIAL_MEDIA") = ''""")(_C(lambda d: filters.social_filter(d, False)))
rows("hours_filter", "F9", '"HAS_OPENING_HOURS"')(_C(lambda d: filters.hours_filter(d, True)))
_OLD = """coalesce(try_cast("ANALYZED_AT" AS timestamp) < TIMESTAMP '{}' - INTERVAL 30 DAY, true)""".format(NOW)
rows("analysis_age_filter", "F10", _OLD)(_C(lambda d: filters.analysis_age_filter(d, 30, NOW)))
rows("combined_filter", "F11", "(" + " OR ".join(f"""regexp_matches(lower(coalesce(cast("{c}" AS varchar), '')), 'ort')""" for c in _COLUMNS)
     + f""") AND {_STATUS} IN ('vollständig', 'aktiv') AND "PRIORITÄT" = 'Normal' AND {_OLD} AND trim("SOCIAL_MEDIA") <> '' """)(
    _C(lambda d: filters.filtered_customers(d, {"text": "ort", "status": "complete_or_active", "priority": "Normal", "age_days": 30, "social": True}, NOW)))
rows("missing_phone", "F12", O.blank('"TELEFON"'))(_C(lambda d: filters.missing(d, "TELEFON")))
_FIRST = """QUALIFY row_number() OVER (PARTITION BY "KUNDENNAME", "CITY" ORDER BY row_no) = 1"""
rows("inactive_worklist", "F13 W3", f"{_STATUS} IN ('nicht aktiv', 'nicht gefunden') {_FIRST}")(_C(filters.inactive_worklist))
rows("keep_first", "W3", f"true {_FIRST}")(_C(lambda d: keep_first(d, ("KUNDENNAME", "CITY"))))
for _scope in ("contactable", "not_found"):
    rows(f"export_{_scope}", "F15", f"{_STATUS} IN ({O.listed(V.STATUS_FILTERS[V.EXPORT_SCOPES[_scope]])})")(_C(lambda d, s=_scope: filters.export_select(d, s)))
query("export_columns", "F16 F26", f"""SELECT {O.clean('"KUNDENNAME"')} AS "KUNDENNAME", {O.clean('"CITY"')} AS "CITY", {O.postal('"PLZ"')} AS "PLZ", {O.clean('"STRASSE"')} AS "STRASSE", {O.clean('"TELEFON"')} AS "TELEFON",
  {O.clean('"EMAIL"')} AS "EMAIL", {O.clean('"WEBSITE"')} AS "WEBSITE", {O.clean('"STATUS"')} AS "STATUS" FROM v_customers""", "v_customers")(
    lambda i: filters.cell_display(filters.export_columns(i.customers, crm=False, enrichment=False)))
rows("older_than", "F18", """coalesce(try_strptime("LAST_CHECK", '%Y-%m-%d %H:%M') < TIMESTAMP '2024-01-01', true)""")(
    _C(lambda d: d.filter(filters.older_than(F.col("LAST_CHECK"), "2024-01-01"))))
rows("is_current", "F19", f"""coalesce(try_cast("ANALYZED_AT" AS timestamp) >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY, false)""")(
    _C(lambda d: d.filter(filters.is_current(F.col("ANALYZED_AT"), NOW))))
query("first_column", "F22", """SELECT row_no, "TELEFON" AS value FROM v_customers""", "v_customers")(
    lambda i: i.customers.select("row_no", filters.first_column(i.customers, V.PHONE_COLUMNS).alias("value")))
query("research_worklist", "F23 J7", f"""SELECT c.row_no FROM v_customers c LEFT JOIN v_companies k ON coalesce(c."KUNDENNAME", '') = k.company_name AND coalesce(c."CITY", '') = k.city
  WHERE {O.blank('c."WEBSITE"')} OR {O.blank('c."EMAIL"')} OR {O.fold(O.clean('c."STATUS"'))} = 'nicht gefunden'
  QUALIFY row_number() OVER (PARTITION BY c."KUNDENNAME", c."CITY" ORDER BY row_no) = 1""", "v_customers", "v_companies")(
    lambda i: filters.research_worklist(i.customers, {"no_website": True, "no_email": True, "not_found": True}).select("row_no"))
_STALE = """coalesce(try_strptime(k.last_check, '%Y-%m-%d %H:%M') < TIMESTAMP '{}' - INTERVAL 15 DAY, true)""".format(NOW)
query("research_worklist_cached", "F23 F18", f"""SELECT c.id FROM v_companies c LEFT JOIN v_companies k ON c.company_name = k.company_name AND c.city = k.city AND k.id % 2 = 0 WHERE k.id IS NULL OR {_STALE}
  QUALIFY row_number() OVER (PARTITION BY c.company_name, c.city ORDER BY c.id) = 1""", "v_companies")(
    lambda i: filters.research_worklist(_as_customers(i.companies), {"only_new": True, "older_than": True, "older_days": 15}, i.companies.filter("id % 2 = 0"), NOW).select("id"))


def _as_customers(companies: DataFrame) -> DataFrame:
    return companies.select("id", F.col("id").alias("row_no"), F.col("company_name").alias("KUNDENNAME"), F.col("city").alias("CITY"),
                            F.col("website").alias("WEBSITE"), F.col("phone").alias("TELEFON"), F.col("email").alias("EMAIL"), F.col("status").alias("STATUS"))


_CURRENT = f"""coalesce(try_cast("ANALYZED_AT" AS timestamp) >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY, false)"""
rows("enrichment_worklist", "F24", f"""NOT {O.blank('"WEBSITE"')} AND "WEBSITE_SCORE_CATEGORY" = 'Schwach' AND NOT {_CURRENT} QUALIFY row_number() OVER (PARTITION BY "ID", "KUNDENNAME", "CITY" ORDER BY row_no) = 1""")(
    _C(lambda d: filters.enrichment_worklist(d, "weak", NOW)))
query("valid_website", "F25 X13", f"""SELECT row_no, CASE WHEN w_doc THEN '' ELSE w END AS valid_website FROM (SELECT row_no, {O.clean_url('"WEBSITE"', 'w')} FROM v_customers)""", "v_customers")(
    lambda i: filters.with_valid_website(i.customers).select("row_no", "valid_website"))
query("worklist_preview", "A14", f"""SELECT total, source, selected, greatest(0, source - selected) AS skipped, CASE WHEN s < 60 THEN 'unter 1 Minute' WHEN m = 1 THEN 'ca. 1 Minute' WHEN m < 60 THEN 'ca. ' || m || ' Minuten'
  ELSE 'ca. ' || (m // 60) || ' Std. ' || (m % 60) || ' Min.' END AS estimate FROM (SELECT *, selected * 5 AS s, (selected * 5) // 60 AS m FROM (SELECT count(*) AS total, count(*) FILTER ({_STATUS} = 'aktiv') AS source,
  count(*) FILTER ({_STATUS} = 'aktiv' AND "PRIORITÄT" = 'Hoch') AS selected FROM v_customers))""", "v_customers")(
    lambda i: filters.worklist_preview(i.customers, filters.status_filter(i.customers, "active"), filters.priority_filter(filters.status_filter(i.customers, "active"), "Hoch")))
query("export_preview", "A17", f"""SELECT count(*) AS total, count(*) FILTER ("PRIORITÄT" = 'Hoch') AS visible, count(*) FILTER ({_STATUS} = 'vollständig') AS selected, '' AS message FROM v_customers""", "v_customers")(
    lambda i: filters.export_preview(i.customers, filters.priority_filter(i.customers, "Hoch"), filters.export_select(i.customers, "complete")))
_KEYSET = """SELECT DISTINCT "KUNDENNAME", "CITY" FROM v_customers WHERE "PRIORITÄT" = 'Hoch'"""
rows("selected_rows", "J6 F15", f"""EXISTS (SELECT 1 FROM ({_KEYSET}) k WHERE coalesce(k."KUNDENNAME", '') = coalesce(v_customers."KUNDENNAME", '') AND coalesce(k."CITY", '') = coalesce(v_customers."CITY", ''))""")(
    lambda i: filters.export_select(i.customers, "selected", filters.priority_filter(i.customers, "Hoch").select("KUNDENNAME", "CITY")).select("row_no"))
query("only_new", "J7", """SELECT c.id FROM v_companies c WHERE NOT EXISTS (SELECT 1 FROM v_companies k WHERE k.id % 3 = 0 AND k.company_name = c.company_name AND k.city = c.city)""", "v_companies")(
    lambda i: filters.only_new(_as_customers(i.companies), i.companies.filter("id % 3 = 0")).select("id"))

# ------------------------------------------------------------------ scalar functions on whole tables
query("phone_validation", "X14", f"SELECT id, p AS value, p_reason AS reason, p_type AS number_type FROM (SELECT id, {O.phone('phone', 'p')} FROM v_companies)", "v_companies")(
    lambda i: C.with_phone(i.companies, F.col("phone"), "value").select("id", "value", F.col("value_reason").alias("reason"), F.col("value_type").alias("number_type")))
query("contact_status", "X16", f"SELECT id, {O.status('website', '''(p <> '')''', f'''({O.email('email')} <> '')''')} AS status FROM (SELECT id, website, email, {O.phone('phone', 'p')} FROM v_companies)", "v_companies")(
    lambda i: C.with_phone(i.companies, F.col("phone"), "p").select("id", C.contact_status(F.col("website"), F.col("p") != "", C.email(F.col("email")) != "").alias("status")))
query("clean_page_urls", "X13 SC4", f"SELECT page_id, u AS clean FROM (SELECT page_id, {O.clean_url('url', 'u')} FROM pages)")(
    lambda i: U.with_clean_url(i.pages, F.col("url"), "clean").select("page_id", "clean"))
query("normalized_websites", "X12", f"SELECT page_id, u AS website FROM (SELECT page_id, {O.website('url', 'u')} FROM pages)")(
    lambda i: U.with_website(i.pages, F.col("url"), "website").select("page_id", "website"))
query("company_keys", "X4", f"SELECT row_no, {O.key('''\"KUNDENNAME\"''', '''\"CITY\"''')} AS company_key FROM v_customers", "v_customers")(
    lambda i: i.customers.select("row_no", T.company_key(F.col("KUNDENNAME"), F.col("CITY")).alias("company_key")))
query("streets_and_postal_codes", "X7 X9 X10", f"""SELECT row_no, {O.street('"STRASSE"')} AS street, {O.house('"STRASSE"')} AS house_number, {O.postal('"PLZ"')} AS postal FROM v_customers""", "v_customers")(
    lambda i: i.customers.select("row_no", A.street_name(F.col("STRASSE")).alias("street"), A.house_number(F.col("STRASSE")).alias("house_number"), A.normalize_postal_code(F.col("PLZ")).alias("postal")))
query("maps_urls", "X8", """SELECT id, 'https://www.google.com/maps/search/?api=1&query=' || url_encode(array_to_string(list_filter([trim(company_name), trim(street), zipcode, trim(city), country], lambda x: x <> ''), ', ')) AS url FROM v_companies""", "v_companies")(
    lambda i: i.companies.select("id", T.maps_url(*[F.col(c) for c in ("company_name", "street", "zipcode", "city", "country")]).alias("url")))
query("display_values", "X1 X6 X21", f"""SELECT row_no, CASE WHEN {O.clean('"STATUS"')} = '' THEN '-' ELSE {O.clean('"STATUS"')} END AS status, {O.text('"KUNDENNAME"')} AS name FROM v_customers""", "v_customers")(
    lambda i: i.customers.select("row_no", T.display_value(F.col("STATUS"), "-").alias("status"), T.collapse(T.as_text(F.col("KUNDENNAME"))).alias("name")))
query("street_agreement", "X11", f"""SELECT row_no, CASE WHEN length(replace(ln, ' ', '')) < 3 THEN 'match' WHEN length(replace(rn, ' ', '')) < 3 THEN 'missing' WHEN replace(ln, ' ', '') <> replace(rn, ' ', '') THEN 'conflict'
  WHEN lh <> '' AND rh <> '' AND lh <> rh THEN 'conflict' ELSE 'match' END AS state FROM (SELECT row_no, {O.street('c."STRASSE"')} AS ln, {O.house('c."STRASSE"')} AS lh, {O.street('k.street')} AS rn, {O.house('k.street')} AS rh
  FROM v_customers c JOIN v_companies k ON c.row_no = k.id)""", "v_customers", "v_companies")(
    lambda i: i.customers.join(i.companies.select(F.col("id").alias("row_no"), "street"), "row_no").select("row_no", A.street_match(F.col("STRASSE"), F.col("street")).alias("state")))

# ------------------------------------------------------------------ CRM
_CRM_OUT = ("ANSPRECHPARTNER", "KUNDENSTATUS", "TAGS", "NOTIZEN", "LETZTER_KONTAKT")
query("with_crm", "J1 SC6", """SELECT c.id, coalesce(trim(k.contact_person), '') AS "ANSPRECHPARTNER", CASE WHEN k.id IS NULL THEN 'Interessent' ELSE trim(k.customer_stage) END AS "KUNDENSTATUS", coalesce(trim(k.tags), '') AS "TAGS",
  coalesce(trim(k.notes), '') AS "NOTIZEN", coalesce(trim(k.last_contact_at), '') AS "LETZTER_KONTAKT" FROM v_companies c LEFT JOIN v_companies k ON k.id % 4 <> 3 AND trim(c.company_name) = k.company_name AND trim(c.city) = k.city""", "v_companies")(
    lambda i: crm.with_crm(_as_customers(i.companies), i.companies.filter("id % 4 <> 3")).select("id", *_CRM_OUT))
query("apply_crm", "J10b", """SELECT row_no, CASE WHEN b.id IS NOT NULL THEN coalesce(b.tags, '') ELSE c."TAGS" END AS "TAGS" FROM (SELECT id AS row_no, company_name, city, 'alt' AS "TAGS" FROM v_companies) c
  LEFT JOIN v_companies b ON b.id % 2 = 0 AND c.company_name = b.company_name AND c.city = b.city""", "v_companies")(
    lambda i: crm.apply_crm(_as_customers(i.companies).withColumn("TAGS", F.lit("alt")), i.companies.filter("id % 2 = 0")).select("row_no", "TAGS"))
query("activity_timeline", "J3 O3",
    f"""SELECT a.id, c.id AS for_company FROM v_companies c JOIN v_activities a ON a.company_id = c.id UNION ALL
  SELECT a.id, c.id FROM v_companies c JOIN v_activities a ON a.company_id IS NULL AND a.company_key = {O.key('c.company_name', 'c.city')}""", "v_companies", "v_activities")(
    lambda i: crm.activity_timeline(i.companies, i.activities).select("id", "for_company"))
query("activity_counts", "J4", """SELECT c.id, count(a.id) AS activity_count FROM v_companies c LEFT JOIN v_activities a ON a.company_id = c.id GROUP BY c.id""", "v_companies", "v_activities")(
    lambda i: crm.with_activity_count(i.companies, i.activities).select("id", "activity_count"))
query("link_orphans", "J5", """SELECT a.id, coalesce(a.company_id, c.id) AS company_id FROM v_activities a LEFT JOIN v_companies c ON a.company_id IS NULL AND a.company_name = c.company_name AND a.city = c.city""", "v_companies", "v_activities")(
    lambda i: crm.link_orphans(i.activities, i.companies).select("id", "company_id"))
query("due_follow_ups", "F17 O4", f"""SELECT id, follow_up_at FROM v_activities WHERE coalesce(follow_up_at, '') <> '' AND follow_up_at <= '{_DAY}T00:00'""", "v_activities")(
    lambda i: crm.due_follow_ups(i.activities, f"{_DAY}T00:00").select("id", "follow_up_at"))
query("crm_counts", "A5", f"""SELECT open_follow_ups, overdue_follow_ups, today_activities, prospects, customers, high_priority FROM (SELECT count(*) FILTER (coalesce(follow_up_at, '') <> '') AS open_follow_ups,
  count(*) FILTER (try_cast(nullif(follow_up_at, '') AS timestamp) <= TIMESTAMP '{NOW}') AS overdue_follow_ups, count(*) FILTER (starts_with(occurred_at, '{_DAY}')) AS today_activities FROM v_activities),
  (SELECT count(*) FILTER (customer_stage = 'Interessent') AS prospects, count(*) FILTER (customer_stage = 'Kunde') AS customers, count(*) FILTER (priority = 'Hoch') AS high_priority FROM v_companies)""", "v_companies", "v_activities")(
    lambda i: crm.crm_counts(i.companies, i.activities, NOW))
query("deletable_companies", "J18", """SELECT id FROM v_companies c WHERE NOT (id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM v_activities a WHERE a.company_id = c.id))""", "v_companies", "v_activities")(
    lambda i: crm.deletable(i.companies, i.activities, i.companies.filter("id % 2 = 0").select("id"))[0].select("id"))
query("save_crm", "SK8", f"""SELECT id, customer_stage, tags, CASE WHEN hit THEN '{NOW}' ELSE updated_at END AS updated_at FROM (SELECT c.id, CASE WHEN b.id IS NULL THEN c.customer_stage ELSE 'Kunde' END AS customer_stage,
  CASE WHEN b.id IS NULL THEN c.tags ELSE '' END AS tags, c.updated_at, b.id IS NOT NULL AS hit FROM v_companies c LEFT JOIN (SELECT * FROM v_companies WHERE id % 3 = 1) b ON c.company_name = b.company_name AND c.city = b.city)
  UNION ALL SELECT (SELECT max(id) FROM v_companies) + row_number() OVER (ORDER BY 'Neu ' || company_name, city), 'Kunde', '', '{NOW}' FROM v_companies WHERE id % 3 = 2""", "v_companies")(
    lambda i: crm.save_crm(i.companies, i.companies.filter("id % 3 > 0").select(
        F.when(F.col("id") % 3 == 2, F.concat(F.lit("Neu "), "company_name")).otherwise(F.col("company_name")).alias("company_name"), "city",
        F.lit("Kunde").alias("customer_stage")), NOW).select("id", "customer_stage", "tags", "updated_at"))
query("add_activities", "SK9", """SELECT id, company_name, activity_type, occurred_at FROM v_activities UNION ALL
  SELECT (SELECT max(id) FROM v_activities) + row_number() OVER (ORDER BY id), company_name, CASE WHEN id % 2 = 0 THEN 'Sonstiges' ELSE 'Termin' END, '2024-01-20T10:00' FROM v_companies""", "v_companies", "v_activities")(
    lambda i: crm.add_activities(i.activities, i.companies, i.companies.select(
        F.col("id").alias("batch_no"), "company_name", "city", F.when(F.col("id") % 2 == 0, " ").otherwise("Termin").alias("activity_type"), F.lit("").alias("subject"),
        F.lit("").alias("description"), F.lit("2024-01-20T10:00").alias("occurred_at"), F.lit(None).cast("string").alias("follow_up_at")), "2024-01-20T10:00:00")[0].select(
            "id", "company_name", "activity_type", "occurred_at"))
query("update_activities", "SK10", """SELECT id, CASE WHEN id % 3 = 0 THEN 'Notiz' ELSE activity_type END AS activity_type, CASE WHEN id % 3 = 0 THEN 'neu' ELSE subject END AS subject FROM v_activities WHERE id % 7 <> 0""", "v_activities")(
    lambda i: crm.delete_activities(crm.update_activities(i.activities, i.activities.filter("id % 3 = 0").select(
        "id", F.lit("Notiz").alias("activity_type"), F.lit(" neu ").alias("subject"))), i.activities.filter("id % 7 = 0").select("id")).select("id", "activity_type", "subject"))
query("complete_follow_ups", "SK11", """SELECT id, CASE WHEN k THEN NULL ELSE follow_up_at END AS follow_up_at, k AND follow_up_at IS NOT NULL AS completed FROM (SELECT *, company_key IN (SELECT company_key FROM v_activities WHERE activity_type = 'Angebot') AS k FROM v_activities)""", "v_activities")(
    lambda i: crm.complete_follow_ups(i.activities, i.activities.filter("activity_type = 'Angebot'")).select("id", "follow_up_at", "completed"))

# ------------------------------------------------------------------ stored duplicates
_RANKED = f"""WITH ranked AS (SELECT *, {O.norm('company_name')} AS n_name, {O.norm('city')} AS n_city, coalesce((SELECT count(*) FROM v_activities a WHERE a.company_id = v_companies.id), 0) AS activity_count, {O.phone('phone', 'p')}, {O.clean_url('website', 'w')},
 {' + '.join(f"(NOT {O.blank(f)})::int" for f in V.MERGE_FIELDS)} AS filled FROM v_companies)"""
_COMPANY_CONFLICTS = " || ".join(f"CASE WHEN count(DISTINCT nullif(trim({f}), '')) > 1 THEN '{f},' ELSE '' END" for f in sorted(f for f in V.MERGE_FIELDS if f not in V.MERGE_NOT_CONFLICTING))
_COMPANY_MASTER = f"arg_min(id, ((activity_count = 0)::int, (lower(status) <> 'vollständig')::int, (p = '' OR {O.email('email')} = '')::int, (w = '')::int, -filled, id))"
_CGROUPS = f"{_RANKED}, g AS (SELECT n_name, n_city, count(*) AS size, min(id) AS group_id, {_COMPANY_MASTER} AS master_id, {_COMPANY_CONFLICTS} AS conflicts FROM ranked GROUP BY ALL HAVING count(*) > 1)"
_joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(","))), "")
query("company_groups", "D13 D14 D15 J4", f"{_CGROUPS} SELECT *, conflicts = '' AS exact FROM g", "v_companies", "v_activities")(
    lambda i: merge.company_groups(i.companies, i.activities).withColumn("conflicts", _joined("conflicts")))
query("company_conflicts", "D14", f"""SELECT n_name, n_city, field, array_to_string(list_sort(list(DISTINCT value)), '|') AS values FROM (SELECT {O.norm('company_name')} AS n_name, {O.norm('city')} AS n_city, unnest([{', '.join(f"{{'field': '{f}', 'value': nullif(trim({f}), '')}}" for f in V.MERGE_FIELDS if f not in V.MERGE_NOT_CONFLICTING)}], recursive := true) FROM v_companies)
  WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1""".replace("GROUP BY ALL", "GROUP BY n_name, n_city, field"), "v_companies")(
    lambda i: merge.company_conflicts(i.companies).withColumn("values", F.array_join("values", "|")))
query("auto_mergeable", "F32 O7", f"{_CGROUPS} SELECT group_id, size - 1 AS removed FROM g WHERE conflicts = ''", "v_companies", "v_activities")(
    lambda i: merge.auto_mergeable(merge.company_groups(i.companies, i.activities)).select("group_id", "removed"))
_FIRSTS = ("website", "phone", "owner", "last_check", "contact_person", "direct_phone")
_MERGE_SQL = f"""{_CGROUPS}, mem AS (SELECT r.*, g.master_id FROM ranked r JOIN (SELECT * FROM g WHERE conflicts = '') g USING (n_name, n_city)),
 f AS (SELECT master_id, {', '.join(f"coalesce(arg_min(trim({c}), id) FILTER (NOT {O.blank(c)}), '') AS {c}" for c in (*_FIRSTS, 'email'))}, coalesce(max(nullif(last_contact_at, '')), '') AS last_contact_at, coalesce(min(nullif(next_follow_up_at, '')), '') AS next_follow_up_at FROM mem GROUP BY master_id),
 tg AS (SELECT master_id, string_agg(tag, ', ' ORDER BY id, pos) AS tags FROM (SELECT master_id, id, pos, trim(tag) AS tag FROM (SELECT master_id, id, unnest(string_split_regex(coalesce(tags, ''), '[,;]')) AS tag, generate_subscripts(string_split_regex(coalesce(tags, ''), '[,;]'), 1) AS pos FROM mem) WHERE trim(tag) <> '' QUALIFY row_number() OVER (PARTITION BY master_id, lower(trim(tag)) ORDER BY id, pos) = 1) GROUP BY master_id),
 nt AS (SELECT master_id, string_agg(note, '{V.NOTES_SEPARATOR}' ORDER BY id) AS notes FROM (SELECT master_id, id, trim(notes) AS note FROM mem WHERE NOT {O.blank('notes')} QUALIFY row_number() OVER (PARTITION BY master_id, trim(notes) ORDER BY id) = 1) GROUP BY master_id),
 ff AS (SELECT f.* EXCLUDE (website, phone, email, direct_phone), {O.phone('phone', 'vp')}, {O.phone('direct_phone', 'vd')}, {O.clean_url('website', 'vw')}, {O.email('email')} AS ve FROM f)"""
query("merge_companies", "D16 O8", _MERGE_SQL + """ SELECT c.id, CASE WHEN ff.master_id IS NULL THEN c.website ELSE vw END AS website, CASE WHEN ff.master_id IS NULL THEN c.phone ELSE vp END AS phone, CASE WHEN ff.master_id IS NULL THEN c.email ELSE ve END AS email,
  CASE WHEN ff.master_id IS NULL THEN c.direct_phone ELSE vd END AS direct_phone, CASE WHEN ff.master_id IS NULL THEN c.owner ELSE ff.owner END AS owner, CASE WHEN ff.master_id IS NULL THEN c.tags ELSE coalesce(tg.tags, '') END AS tags,
  CASE WHEN ff.master_id IS NULL THEN c.notes ELSE coalesce(nt.notes, '') END AS notes, CASE WHEN ff.master_id IS NULL THEN c.last_contact_at ELSE ff.last_contact_at END AS last_contact_at, CASE WHEN ff.master_id IS NULL THEN c.next_follow_up_at ELSE ff.next_follow_up_at END AS next_follow_up_at, c.street
  FROM v_companies c LEFT JOIN ff ON c.id = ff.master_id LEFT JOIN tg ON c.id = tg.master_id LEFT JOIN nt ON c.id = nt.master_id WHERE c.id NOT IN (SELECT id FROM mem WHERE id <> master_id)""", "v_companies", "v_activities")(
    lambda i: merge.merge_companies(i.companies, i.activities)["companies"].select("id", "website", "phone", "email", "direct_phone", "owner", "tags", "notes", "last_contact_at", "next_follow_up_at", "street"))
_MAP_KEYS = f"SELECT id AS member, master_id, {O.key('company_name', 'city')} AS k FROM mem"
query("repoint_activities", "J19", _MERGE_SQL + f""", mp AS ({_MAP_KEYS}), mk AS (SELECT k, arg_min(master_id, member) AS master_id FROM mp GROUP BY k), j AS (SELECT a.*, coalesce(i.master_id, mk.master_id) AS master_id FROM v_activities a LEFT JOIN mp i ON a.company_id = i.member LEFT JOIN mk ON a.company_key = mk.k)
  SELECT j.id, coalesce(j.master_id, j.company_id) AS company_id, CASE WHEN j.master_id IS NULL THEN j.company_key ELSE {O.key('m.company_name', 'm.city')} END AS company_key, CASE WHEN j.master_id IS NULL THEN j.company_name ELSE m.company_name END AS company_name FROM j LEFT JOIN v_companies m ON j.master_id = m.id""", "v_companies", "v_activities")(
    lambda i: merge.merge_companies(i.companies, i.activities)["activities"].select("id", "company_id", "company_key", "company_name"))
query("merge_rejected", "D16 O7", f"{_CGROUPS} SELECT group_id, conflicts FROM g WHERE conflicts <> ''", "v_companies", "v_activities")(
    lambda i: merge.merge_companies(i.companies, i.activities)["rejected"].select("group_id", _joined("unresolved").alias("conflicts")))
_ITEMS = f"""SELECT id AS company_id, company_name AS company, city, coalesce(phone, '') AS before, p AS after, CASE WHEN p <> '' THEN 'gültig' WHEN {O.blank('phone')} THEN 'leer' ELSE 'ungültig' END AS rating, p_reason AS reason, coalesce(status, '') AS status_before,
  {O.status('website', '''(p <> '')''', f'''({O.email('email')} <> '')''')} AS status_after FROM (SELECT *, {O.phone('phone', 'p')} FROM v_companies)"""
query("phone_cleanup_preview", "D17", _ITEMS, "v_companies")(lambda i: merge.phone_cleanup_preview(i.companies))
query("phone_cleanup_apply", "D18", f"SELECT company_id AS id, after AS phone, status_after AS status FROM ({_ITEMS})", "v_companies")(
    lambda i: merge.phone_cleanup_apply(i.companies, merge.phone_cleanup_preview(i.companies)).select("id", "phone", "status"))
query("phone_cleanup_summary", "A16", f"""SELECT count(*) AS total, count(*) FILTER (rating = 'gültig') AS valid, count(*) FILTER (rating = 'ungültig') AS invalid, count(*) FILTER (before <> after) AS changed, count(*) FILTER (status_before <> status_after) AS status_changes FROM ({_ITEMS})""", "v_companies")(
    lambda i: merge.phone_cleanup_summary(merge.phone_cleanup_preview(i.companies)))
query("cleanup_filter", "F28", f"SELECT company_id FROM ({_ITEMS}) WHERE status_before <> status_after", "v_companies")(
    lambda i: filters.cleanup_filter(merge.phone_cleanup_preview(i.companies), "status").select("company_id"))
query("apply_phone_cleanup", "J10", f"""SELECT c.id, t.after AS "TELEFON", t.status_after AS "STATUS" FROM v_companies c LEFT JOIN (SELECT company, city, arg_max(after, company_id) AS after, arg_max(status_after, company_id) AS status_after FROM ({_ITEMS}) GROUP BY ALL) t ON c.company_name = t.company AND c.city = t.city""", "v_companies")(
    lambda i: merge.apply_phone_cleanup(_as_customers(i.companies), merge.phone_cleanup_preview(i.companies)).select("id", "TELEFON", "STATUS"))

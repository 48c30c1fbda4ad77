"""Second half of the query catalogue: research results, pages, website analysis, tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import contacts as C
from kontor.functions import text as T
from kontor.operators import crm, dashboard, enrich, filters, imprint, merge, pages, quality, research
from kontor.operators.common import nth_of_key, with_row_no
from kontor.plans import oracle as O
from kontor.plans.catalog import _as_customers, query
from kontor.plans.views import NOW, load
from kontor.session import fresh_path, written
from kontor.sources import snapshots, tables
from kontor.streaming import streams

# ------------------------------------------------------------------ research results
_CUST = f"""WITH c AS (SELECT *, {O.key('"KUNDENNAME"', '"CITY"')} AS k, {O.street('"STRASSE"')} || '|' || {O.house('"STRASSE"')} AS st FROM v_customers),
r AS (SELECT *, {O.key(O.clean('company'), O.clean('city'))} AS k, CASE WHEN length(replace({O.street('street')}, ' ', '')) >= 3 THEN {O.street('street')} || '|' || {O.house('street')} END AS st FROM v_results),
t AS (SELECT *, CASE WHEN customer_id IN (SELECT "ID" FROM c) THEN 1 WHEN (k, st) IN (SELECT k, st FROM c) THEN 2 ELSE 3 END AS tier FROM r),
h AS (SELECT c.row_no, t.* EXCLUDE (k, st) FROM c JOIN t ON t.tier = 1 AND t.customer_id = c."ID" UNION ALL SELECT c.row_no, t.* EXCLUDE (k, st) FROM c JOIN t ON t.tier = 2 AND t.k = c.k AND t.st = c.st
  UNION ALL SELECT c.row_no, t.* EXCLUDE (k, st) FROM c JOIN t ON t.tier = 3 AND t.k = c.k),
w AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY result_no DESC) = 1)"""
query("apply_results", "J8", _CUST + f""" SELECT c.row_no, CASE WHEN w.row_no IS NULL THEN c."WEBSITE" ELSE {O.clean('w.website')} END AS "WEBSITE", CASE WHEN w.row_no IS NULL THEN c."EMAIL" ELSE {O.clean('w.email')} END AS "EMAIL",
  CASE WHEN w.row_no IS NULL THEN c."STATUS" ELSE w.status END AS "STATUS", w.source AS "SOURCE", CASE WHEN w.row_no IS NULL THEN c."LAST_CHECK" ELSE w.last_check END AS "LAST_CHECK" FROM c LEFT JOIN w USING (row_no)""", "v_customers", "v_results")(
    lambda i: research.apply_results(i.customers.drop("ANALYZED_AT", "WEBSITE_SCORE_CATEGORY", "HAS_IMPRINT", "INDUSTRY", "ENRICHMENT_STATUS"), i.results).select("row_no", "WEBSITE", "EMAIL", "STATUS", "SOURCE", "LAST_CHECK"))
query("apply_results_stale", "J8 SK12", _CUST + f""", u AS (SELECT c.row_no, w.result_no, c."INDUSTRY", a.u AS old_site, b.u AS new_site FROM c LEFT JOIN w USING (row_no) LEFT JOIN (SELECT row_no, {O.clean_url('"WEBSITE"', 'u')} FROM c) a USING (row_no)
  LEFT JOIN (SELECT row_no, {O.clean_url(O.clean('website'), 'u')} FROM w) b USING (row_no)) SELECT row_no, CASE WHEN coalesce(max(old_site <> new_site) OVER (PARTITION BY result_no), false) AND result_no IS NOT NULL THEN '' ELSE "INDUSTRY" END AS "INDUSTRY" FROM u""", "v_customers", "v_results")(
    lambda i: research.apply_results(i.customers, i.results).select("row_no", "INDUSTRY"))
query("apply_enrichment", "J9", _CUST.replace("WHEN (k, st) IN (SELECT k, st FROM c) THEN 2 ELSE 3", "ELSE 3") + """ SELECT c.row_no, CASE WHEN w.row_no IS NULL THEN c."INDUSTRY" ELSE w.status END AS "INDUSTRY" FROM c LEFT JOIN w USING (row_no)""", "v_customers", "v_results")(
    lambda i: research.apply_enrichment(i.customers, i.results.select("result_no", "company", "city", "customer_id", F.col("status").alias("INDUSTRY"))).select("row_no", "INDUSTRY"))
query("enrichment_offer", "J14 F25", _CUST.replace("WHEN (k, st) IN (SELECT k, st FROM c) THEN 2 ELSE 3", "ELSE 3") + f""", s AS (SELECT result_no, min(row_no) AS row_no FROM h WHERE success AND {O.blank('error_message')} GROUP BY result_no)
  SELECT result_no, s.row_no, u AS "WEBSITE", coalesce(try_cast(c."ANALYZED_AT" AS timestamp) >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY, false) AS skipped FROM s JOIN (SELECT result_no, {O.clean_url('website', 'u')} FROM v_results) x USING (result_no) JOIN c ON c.row_no = s.row_no WHERE u <> '' AND NOT u_doc""", "v_customers", "v_results")(
    lambda i: research.enrichment_offer(i.results, i.customers, NOW).drop("analyzed_at"))
_RKEY = f"CASE WHEN customer_id IS NOT NULL THEN 'id|' || customer_id ELSE 'company|' || {O.key('company', 'city')} END"
query("run_summary", "A11 X22", f"""SELECT result_no, rk AS result_key, successful, bool_or(successful) OVER (PARTITION BY rk) AND u <> '' AND NOT u_doc AS with_website FROM (SELECT *, {_RKEY} AS rk, success AND {O.blank('error_message')} AS successful, {O.clean_url('website', 'u')} FROM v_results)""", "v_results")(
    lambda i: research.run_summary(i.results).withColumn("result_key", F.concat_ws("|", "result_key.kind", "result_key.key")))
query("key_intersection", "O9", f"SELECT result_no FROM (SELECT result_no, {_RKEY} AS rk FROM v_results) WHERE rk IN (SELECT {_RKEY} FROM v_results WHERE result_no % 5 = 1)", "v_results")(
    lambda i: research.key_intersection(i.results, i.results.filter("result_no % 5 = 1").withColumn(
        "result_key", research.result_key(F.col("customer_id"), F.col("company"), F.col("city")))).select("result_no"))
query("pair_before_after", "J15", """WITH b AS (SELECT trim(coalesce("KUNDENNAME", '')) AS n, trim(coalesce("CITY", '')) AS c, trim(coalesce("EMAIL", '')) AS e, row_number() OVER (PARTITION BY n, c ORDER BY row_no) AS nth FROM v_customers),
  r AS (SELECT result_no, trim(company) AS n, trim(city) AS c, row_number() OVER (PARTITION BY n, c ORDER BY result_no) AS nth FROM v_results) SELECT result_no, coalesce(e, '') AS old_email FROM r LEFT JOIN b USING (n, c, nth)""", "v_customers", "v_results")(
    lambda i: research.pair_before_after(i.customers, i.results).select("result_no", "old_email"))
_CHANGED = " || ".join(f"CASE WHEN old_{f} <> trim({f}) THEN '{n},' ELSE '' END" for f, n in (("website", "website"), ("phone", "telefon"), ("email", "email"), ("status", "status")))
query("build_change", "X24", f"SELECT result_no, trim(website) AS new_website, {_CHANGED} AS changed FROM v_paired", "v_paired")(
    lambda i: research.build_change(i.paired).select("result_no", "new_website", F.array_join(F.transform("changed_fields", lambda x: F.concat(x, F.lit(","))), "").alias("changed")))
_NEW = "(SELECT *, website AS new_website, phone AS new_phone, email AS new_email, status AS new_status FROM v_paired)"
_REPORT_SQL = {
    "changed": f"({_CHANGED}) <> ''", "errors": "NOT success OR error_message <> ''", "incomplete": "new_status IN ('Aktiv', 'Nicht aktiv')", "status_change": "old_status <> new_status",
    "new_phone": "old_phone = '' AND new_phone <> ''", "new_email": "old_email = '' AND new_email <> ''",
    "website": "new_website <> '' AND new_website <> old_website"}
for _name, _where in _REPORT_SQL.items():
    query(f"report_{_name}", "F14", f"SELECT result_no FROM {_NEW} WHERE {_where}", "v_paired")(
        lambda i, n=_name: research.report_filter(research.build_change(i.paired), n).select("result_no"))
query("report_all_criteria", "F29", f"SELECT result_no FROM {_NEW} WHERE ({_CHANGED}) <> '' AND NOT success AND new_status IN ('Aktiv', 'Nicht aktiv')", "v_paired")(
    lambda i: research.report_filter_and(research.build_change(i.paired), changed=True, errors=True, incomplete=True).select("result_no"))
_COUNT = lambda name, where: f"count(*) FILTER ({where}) AS {name}"
_COUNTERS = ", ".join([
    "count(*) AS processed", *[_COUNT(n, f"success AND new_status = '{s}'") for n, s in (("complete", "Vollständig"), ("active", "Aktiv"), ("inactive", "Nicht aktiv"), ("not_found", "Nicht gefunden"), ("contacts_still_incomplete", "Nicht aktiv"))],
    _COUNT("websites_found", "old_website = '' AND new_website <> ''"), _COUNT("websites_corrected", "old_website <> '' AND new_website <> '' AND old_website <> new_website"),
    _COUNT("phones_found", _REPORT_SQL["new_phone"]), _COUNT("emails_found", _REPORT_SQL["new_email"])])
query("research_report", "A10", f"SELECT {_COUNTERS}, count(*) FILTER (NOT success) + (SELECT count(*) FROM v_paired WHERE error_message <> '') AS errors, 1000000::bigint AS total, greatest(0, 1000000 - count(*)) AS skipped, 90.0::double AS duration_seconds, false AS cancelled FROM {_NEW}", "v_paired")(
    lambda i: research.research_report(research.build_change(i.paired), i.paired.filter("error_message <> ''"), 1_000_000, started_at="2024-01-01T00:00:00", finished_at="2024-01-01T00:01:30"))
query("report_text", "A18", f"SELECT processed || ' Firmen geprüft – ' || complete || ' vollständig – ' || active || ' aktiv – ' || inactive || ' nicht aktiv – ' || not_found || ' nicht gefunden – ' || errors || ' Fehler' AS summary_text FROM (SELECT {_COUNTERS}, count(*) FILTER (NOT success) AS errors FROM {_NEW})", "v_paired")(
    lambda i: research.report_text(research.research_report(research.build_change(i.paired))))
query("recent_changes", "W10", "SELECT result_no, company FROM v_paired ORDER BY result_no DESC LIMIT 5", "v_paired")(
    lambda i: research.recent_changes(i.paired).select("result_no", "company"))
query("customer_of_change", "F31", """SELECT r.company, r.city, (SELECT min(row_no) FROM v_customers WHERE coalesce("KUNDENNAME", '') = r.company AND coalesce("CITY", '') = r.city) AS row_no FROM (SELECT DISTINCT company, city FROM v_results) r""", "v_customers", "v_results")(
    lambda i: research.customer_of_change(i.customers, i.results))

# ------------------------------------------------------------------ candidates and addresses
query("rank_candidates", "W4 O5c", f"""SELECT company_name, pos, score, row_number() OVER (PARTITION BY company_name, city ORDER BY score DESC, pos) AS rank FROM (SELECT *, regexp_replace(lower(u_host), '^www\\.', '') AS d,
  (SELECT coalesce(sum(CASE WHEN contains(d, w) THEN 40 ELSE 0 END + CASE WHEN contains(lower(title), w) THEN 20 ELSE 0 END), 0) FROM (SELECT unnest(string_split(lower(company_name), ' ')) AS w) WHERE length(w) >= 3)
   + CASE WHEN contains(d, '.de') THEN 5 ELSE 0 END AS score FROM (SELECT *, {O.clean_url('url', 'u')} FROM v_candidates)) WHERE u <> ''""", "v_candidates")(
    lambda i: research.rank_candidates(i.candidates).select("company_name", "pos", "score", "rank"))


def _requests(i) -> DataFrame:
    return i.companies.select(F.col("id").alias("result_no"), F.concat(F.col("company_name"), F.when(F.col("id") % 9 == 0, " neu").otherwise("")).alias("company_name"), "city",
                              F.when(F.col("id") % 3 == 0, F.concat(F.lit("Musterstr. "), (F.col("id") % 40 + 1).cast("string"))).when(F.col("id") % 3 == 1, "Nebenweg 3").otherwise("").alias("street"))


_REQ = "(SELECT id AS result_no, company_name || CASE WHEN id % 9 = 0 THEN ' neu' ELSE '' END AS company_name, city, CASE WHEN id % 3 = 0 THEN 'Musterstr. ' || (id % 40 + 1) WHEN id % 3 = 1 THEN 'Nebenweg 3' ELSE '' END AS street FROM v_companies)"
query("cached_result", "J20 X16", f"""SELECT result_no, hit, coalesce(w, '') AS website, coalesce(p, '') AS phone, hit AND (w <> coalesce(c.website, '') OR p <> coalesce(c.phone, '') OR e <> coalesce(c.email, '') OR {O.status('w', "(p <> '')", "(e <> '')")} <> coalesce(c.status, '')) AS changed
  FROM (SELECT r.*, k.id AS cid, k.id IS NOT NULL AND (r.street = '' OR ({O.street('r.street')} = {O.street('k.street')} AND ({O.house('r.street')} = {O.house('k.street')}))) AS hit FROM {_REQ} r LEFT JOIN v_companies k ON r.company_name = k.company_name AND r.city = k.city)
  LEFT JOIN (SELECT *, {O.phone('phone', 'p')}, {O.clean_url('website', 'w')}, {O.email('email')} AS e FROM v_companies) c ON c.id = cid""", "v_companies")(
    lambda i: research.cached_result(_requests(i), i.companies).select("result_no", "hit", "website", "phone", "changed"))
query("address_agreement", "J13", f"""SELECT id, CASE WHEN en = '' THEN 'match' WHEN (a = en AND ah = eh AND id % 4 <> 1) OR (b = en AND bh = eh) THEN 'match' ELSE 'conflict' END AS state FROM (SELECT id, {O.street('street')} AS en, {O.house('street')} AS eh, {O.street("'Musterstr. ' || (id % 20 + 1)")} AS a, {O.house("'Musterstr. ' || (id % 20 + 1)")} AS ah,
  {O.street("'Musterstrasse ' || (id % 40 + 2)")} AS b, {O.house("'Musterstrasse ' || (id % 40 + 2)")} AS bh FROM v_companies)""", "v_companies")(
    lambda i: i.companies.select("id", _state(F.col("street")).alias("state")))


def _state(street):
    from kontor.functions import address as A

    number = lambda mod, plus: (F.col("id") % mod + plus).cast("string")
    place = lambda prefix, mod, plus, postal: F.struct(F.concat(F.lit(prefix), number(mod, plus)).alias("street"), postal.alias("zipcode"), F.lit("").alias("city"))
    return A.address_state(street, F.col("zipcode"), F.col("city"), F.array(
        place("Musterstr. ", 20, 1, F.when(F.col("id") % 4 == 1, "99999").otherwise("01067")), place("Musterstrasse ", 40, 2, F.lit(""))))


# ------------------------------------------------------------------ dashboard
_STATUS = O.fold(O.clean('"STATUS"'))
_STATUS_COUNTS = ", ".join(["count(*) AS total", *[_COUNT(n, f"{_STATUS} = '{s}'") for n, s in (("complete", "vollständig"), ("active", "aktiv"), ("inactive", "nicht aktiv"), ("not_found", "nicht gefunden"))],
                            *[_COUNT(f"missing_{n}", O.blank(f'"{c}"')) for n, c in (("website", "WEBSITE"), ("phone", "TELEFON"), ("email", "EMAIL"))]])
query("status_counts", "A4", f"SELECT {_STATUS_COUNTS} FROM v_customers", "v_customers")(lambda i: dashboard.status_counts(i.customers))
_SUMMARY = """coalesce(avg(website_score), 0) AS average_website_score, count(*) FILTER (website_score >= 80) AS very_good_websites, count(*) FILTER (website_score < 40) AS weak_websites, count(*) FILTER (NOT has_imprint) AS websites_without_imprint,
 count(*) FILTER (NOT has_privacy_policy) AS websites_without_privacy, count(*) FILTER (has_opening_hours) AS websites_with_opening_hours, count(*) FILTER (has_social_media) AS websites_with_social_media FROM v_enrichments WHERE enrichment_status = 'Erfolgreich'"""
query("enrichment_summary", "A6", f"SELECT count(*) AS analyses, {_SUMMARY}", "v_enrichments")(lambda i: dashboard.enrichment_summary(i.enrichments))
query("enrichment_errors", "A7", "SELECT count(*) FILTER (enrichment_status = 'Fehler') AS website_analysis_errors FROM v_enrichments", "v_enrichments")(lambda i: dashboard.enrichment_error_count(i.enrichments))
_INDUSTRY = f"""SELECT CASE WHEN "INDUSTRY" = '' THEN 'Unklar' ELSE "INDUSTRY" END AS industry, count(*) AS n FROM v_customers WHERE NOT {O.blank('"ANALYZED_AT"')} GROUP BY 1 ORDER BY n DESC, industry LIMIT 8"""
query("industry_distribution", "A8 O5a", _INDUSTRY, "v_customers")(lambda i: dashboard.industry_distribution(i.customers))
_COVER = ", ".join(_COUNT(n, f"""NOT {O.blank('"WEBSITE"')} AND {x} {O.blank('"ANALYZED_AT"')}""") for n, x in (("websites_analyzed", "NOT"), ("websites_not_analyzed", "")))
query("website_coverage", "A9", f"SELECT {_COVER} FROM v_customers", "v_customers")(lambda i: dashboard.website_coverage(i.customers))


def _dashboard(i) -> DataFrame:
    changes = research.build_change(i.paired)
    full = dashboard.dashboard(i.customers, i.companies, i.activities, i.enrichments, filters.priority_filter(i.customers, "Hoch"),
                               changes, research.research_report(changes), NOW)
    return full.withColumns({"recent_changes": F.array_join("recent_changes", ";"),
                             "industry_distribution": F.array_join(F.array_sort(F.transform(F.map_entries("industry_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";")})


query("dashboard", "A15 A1 A4-A9 W10")(_dashboard)

# ------------------------------------------------------------------ tables
query("scan_companies", "SC2 O2", "SELECT id, company_name FROM v_companies", "v_companies")(lambda i: tables.scan_companies(i.companies).select("id", "company_name"))
query("decode_enrichments", "SC3", """SELECT company_key, cast(result_json->>'website_score' AS int) AS score, cast(result_json->>'has_imprint' AS boolean) AS has_imprint, 'Schwach' AS category, 'Hotel' AS industry, result_json->'social_media'->>'facebook' AS facebook FROM v_enrichments""", "v_enrichments")(
    lambda i: tables.decode_enrichments(i.enrichments).select("company_key", F.col("result.website_score").alias("score"), F.col("result.has_imprint").alias("has_imprint"),
                                                               F.col("result.website_score_category").alias("category"), F.col("result.industry.industry").alias("industry"), F.col("result.social_media.facebook").alias("facebook")))
query("scan_pages", "SC4", "SELECT page_id AS pos, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site FROM pages")(lambda i: tables.scan_pages(i.pages).select("pos", "site"))
query("lookup", "SC6", "SELECT event_id, coalesce(c.priority, 'Normal') AS priority FROM (SELECT event_id, user_id AS id FROM events) e LEFT JOIN (SELECT * FROM v_companies WHERE id % 2 = 0) c USING (id)", "v_companies")(
    lambda i: tables.lookup(i.events.select("event_id", F.col("user_id").alias("id")), i.companies.filter("id % 2 = 0"), ["id"], {"priority": "Normal"}).select("event_id", "priority"))
query("ensure_columns", "SC7", f"SELECT id, 'Normal' AS priority, '' AS notes2, '2023-01-01T00:00:00' AS created_at, '{NOW}' AS updated_at FROM v_companies", "v_companies")(
    lambda i: tables.ensure_columns(i.companies.select("id", F.lit("Normal").alias("priority"), "created_at"), {"priority": "x", "notes2": ""}, NOW))
query("upsert_companies", "SK7", f"""SELECT c.id, CASE WHEN b.company_name IS NULL THEN c.status ELSE b.status END AS status, c.tags, c.created_at FROM v_companies c LEFT JOIN (SELECT company, city, arg_max(status, result_no) AS status, company AS company_name FROM u GROUP BY company, city) b ON c.company_name = b.company AND c.city = b.city
  UNION ALL SELECT (SELECT max(id) FROM v_companies) + row_number() OVER (ORDER BY company, city), arg_max(status, result_no), '', '{NOW}' FROM u WHERE NOT EXISTS (SELECT 1 FROM v_companies c WHERE c.company_name = u.company AND c.city = u.city) GROUP BY company, city""".replace(
      "FROM u ", "FROM (SELECT o_orderkey AS result_no, CASE WHEN o_orderkey % 3 = 0 THEN 'Neu ' ELSE '' END || company_name AS company, city, o_orderstatus AS status FROM orders JOIN v_companies ON o_custkey = id) u "), "v_companies")(
    lambda i: tables.upsert(i.companies, _company_changes(i), ["company_name", "city"], ["status"], NOW, order="result_no").select("id", "status", "tags", "created_at"))


def _company_changes(i) -> DataFrame:
    from kontor.plans.views import load

    orders = i.spark.read.parquet(f"{i.sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("result_no"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"))
    named = i.companies.select("id", "company_name", "city")
    return orders.join(named, "id").select("result_no", "city", "status", F.concat(F.when(F.col("result_no") % 3 == 0, "Neu ").otherwise(""), "company_name").alias("company_name"))




def _bucketed(i) -> str:
    """The companies in buckets, after a change of one key in a hundred and a few new companies."""
    folder = fresh_path(i.spark, "companies")
    snapshots.create(i.companies, folder, ["company_name", "city"])
    old = i.companies.filter("id % 97 = 0").select("company_name", "city", F.concat(F.lit("X"), F.col("id").cast("string")).alias("status"))
    new = i.companies.filter("id % 193 = 0").select(F.concat(F.lit("Neu "), "company_name").alias("company_name"), "city", F.lit("Y").alias("status"))
    snapshots.upsert(i.spark, folder, old.unionByName(new), ["company_name", "city"], ["status"], NOW)
    return folder


_CHANGED = "(SELECT company_name, city FROM v_companies WHERE id % 97 = 0 UNION ALL SELECT 'Neu ' || company_name, city FROM v_companies WHERE id % 193 = 0)"
_BUCKET = "CAST('0x' || md5(company_name || chr(31) || city)[1:8] AS bigint) % 64"
query("upsert_buckets", "SK7", f"""SELECT id, CASE WHEN id % 97 = 0 THEN 'X' || id ELSE status END AS status, tags, CASE WHEN id % 97 = 0 THEN '{NOW}' ELSE updated_at END AS updated_at FROM v_companies
  UNION ALL SELECT (SELECT max(id) FROM v_companies) + row_number() OVER (ORDER BY 'Neu ' || company_name, city), 'Y', '', '{NOW}' FROM v_companies WHERE id % 193 = 0""", "v_companies")(
    lambda i: snapshots.read(i.spark, _bucketed(i)).select("id", "status", "tags", "updated_at"))
query("upsert_buckets_touched", "SK7", f"""SELECT CAST(b AS int) AS bucket, CASE WHEN b IN (SELECT {_BUCKET} FROM {_CHANGED}) THEN 1 ELSE 0 END::bigint AS version, count(*) AS rows FROM (
  SELECT {_BUCKET} AS b FROM v_companies UNION ALL SELECT {_BUCKET} FROM {_CHANGED} WHERE starts_with(company_name, 'Neu ')) GROUP BY b""", "v_companies")(
    lambda i: snapshots.manifest(i.spark, _bucketed(i)).select("bucket", "version", "rows"))


def _stale_in_buckets(i) -> DataFrame:
    folder = fresh_path(i.spark, "enrichments")
    snapshots.create(i.enrichments, folder, ["company_key"])
    snapshots.mark_stale(i.spark, folder, i.enrichments.filter("company_id % 111 = 0"), NOW)
    return snapshots.read(i.spark, folder).select("company_key", "enrichment_status")


query("mark_stale_buckets", "SK12", "SELECT company_key, CASE WHEN company_id % 111 = 0 THEN 'Veraltet' ELSE enrichment_status END AS enrichment_status FROM v_enrichments", "v_enrichments")(_stale_in_buckets)


query("save_enrichment", "SK6", f"""SELECT company_key, website_score, industry, has_imprint, has_social_media, CASE WHEN company_id % 2 = 0 THEN '{NOW}' END AS updated_at FROM (SELECT company_key, company_id, website_score, CASE WHEN company_id % 2 = 0 THEN 'Hotel' ELSE industry END AS industry, has_imprint, has_social_media FROM v_enrichments)""", "v_enrichments")(
    lambda i: tables.save_enrichment(i.enrichments.withColumn("updated_at", F.lit(None).cast("string")), tables.decode_enrichments(i.enrichments.filter("company_id % 2 = 0")).select(
        F.col("result").withField("company_key", F.col("company_key")).alias("result")), NOW).select("company_key", "website_score", "industry", "has_imprint", "has_social_media", "updated_at"))
query("mark_stale", "SK12", "SELECT company_key, CASE WHEN company_id % 3 = 0 THEN 'Veraltet' ELSE enrichment_status END AS enrichment_status, CASE WHEN company_id % 3 = 0 THEN 'Veraltet' ELSE 'Erfolgreich' END AS stored FROM v_enrichments", "v_enrichments")(
    lambda i: tables.mark_stale(i.enrichments, i.enrichments.filter("company_id % 3 = 0").select("company_key"), NOW).select("company_key", "enrichment_status", F.get_json_object("result_json", "$.enrichment_status").alias("stored")))
query("import_report_rows", "SK3", "SELECT 'Zeilen vorher' AS \"Kennzahl\", cast(count(*) AS varchar) AS \"Wert\" FROM v_import", "v_import")(
    lambda i: tables.import_report_rows(i.imported.agg(F.count(F.lit(1)).alias("rows_before")).withColumns({c: F.lit("") for c in (
        "source_path", "analyzed_at", "rows_after", "removed_identical", "merged_groups", "skipped_rows", "corrected_phones", "discarded_emails", "normalized_websites", "open_conflicts")})).filter("Kennzahl = 'Zeilen vorher'"))
query("ingest_row_numbers", "SC1 W2", "SELECT count(*) AS n, count(DISTINCT page_id) AS numbers, min(page_id) AS lowest, max(page_id) AS highest FROM (SELECT row_number() OVER () - 1 AS page_id FROM pages)")(
    lambda i: with_row_no(i.pages).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_no").alias("numbers"), F.min("row_no").alias("lowest"), F.max("row_no").alias("highest")))

# ------------------------------------------------------------------ pages


def _parsed(i) -> DataFrame:
    """Every page is parsed once, however many branches a query has."""
    return written(pages.parse_pages(tables.scan_pages(i.pages)), "parsed")


_UNESCAPED = "trim(regexp_replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '\\s+', ' ', 'g'))"
# Character references are read as a browser reads them, also those that a cut title leaves without semicolon.
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
for _name, _sign in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
    _TITLE = f"regexp_replace({_TITLE}, '&{_name};?', '{_sign}', 'g')"
_TITLE = f"trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g'))"
query("parse_pages", "E1 E4 E8", f"""SELECT page_id AS pos, {_TITLE} AS title, len(regexp_extract_all(html, '<h[12][^>]*>')) AS headings, len(regexp_extract_all(html, '<a [^>]*href=')) AS links, contains(html, '<form') AS has_form FROM pages""")(
    lambda i: _parsed(i).select("pos", T.collapse(F.col("title")).alias("title"), F.size("headings").cast("bigint").alias("headings"), F.size("links").cast("bigint").alias("links"), "has_form"))
_KIND = "CASE " + " ".join(f"WHEN regexp_matches({{v}}, '{'|'.join(w)}') THEN '{k}'" for k, w in V.PAGE_KEYWORDS.items()) + " ELSE 'home' END"
query("classify_pages", "E2", f"SELECT page_id AS pos, {_KIND.format(v='v')} AS kind FROM (SELECT page_id, {O.fold(f'''url || ' ' || {_UNESCAPED}''')} AS v FROM pages)")(
    lambda i: _parsed(i).select("pos", "kind"))
query("internal_links", "E3", f"""SELECT pos, link FROM (SELECT pos, {O.clean_url('target', 'l')}, l AS link FROM (SELECT page_id AS pos, regexp_extract(url, '^(https?://[^/?#]*)', 1) || h AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="(/[^"]*)"', 1)) AS h FROM pages))) WHERE link <> '' AND NOT regexp_matches(lower(link), '/login|/konto|/account|captcha')""")(
    lambda i: pages.internal_links(_parsed(i)).select("pos", "link"))
query("page_frontier", "W8 O5b")(lambda i: pages.frontier(enrich.clean_pages(_parsed(i))))
query("first_pages_of_kind", "W9")(lambda i: pages.first_of_kind(_parsed(i)))
query("contact_links", "E16 O5b")(lambda i: pages.contact_frontier(_parsed(i)))
query("contact_candidates", "E15 O6")(lambda i: pages.contact_candidates(_parsed(i)).select("pos", F.size("phones").alias("phones"), F.size("emails").alias("emails"), F.size("addresses").alias("addresses")))
query("site_contacts", "E17 W6 W7 J13")(lambda i: pages.site_contacts(pages.contact_candidates(_parsed(i)).select(F.col("pos").alias("start"), "pos", "phones", "emails", "addresses"), ["start"]).select(
    "start", "phone", "email", F.size("addresses").alias("addresses")))
_DOC_MAILS = "unnest(regexp_extract_all(text, '([A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1))"
_RANK = "CASE " + " ".join(f"WHEN starts_with(e, '{p}') THEN {k}" for k, p in enumerate(V.PREFERRED_MAILBOXES)) + " ELSE 99 END"
query("document_emails", "W7 X15", f"""SELECT doc_id, arg_min(e, ({_RANK}, e)) AS email FROM (SELECT doc_id, {O.email('m')} AS e FROM (SELECT doc_id, {_DOC_MAILS} AS m FROM documents)) WHERE e <> '' GROUP BY doc_id""")(
    lambda i: pages.choose_email(i.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pages._EMAIL_IN_TEXT), F.lit(1))).alias("value")), ["doc_id"], C.email(F.col("value"))))
_DOC_PHONES = "unnest(regexp_extract_all(text, '(?:\\+|00)?\\d[\\d\\s/().-]{5,}\\d'))"
query("document_phones", "W6 X14", f"""SELECT doc_id, arg_min(p, (CASE p_type WHEN 'fixed' THEN 0 WHEN 'mobile' THEN 1 WHEN 'other' THEN 2 ELSE 3 END, v)) FILTER (p <> '') AS phone FROM (SELECT doc_id, v, {O.phone('v', 'p')} FROM (SELECT doc_id, {_DOC_PHONES} AS v FROM documents)) GROUP BY doc_id""")(
    lambda i: pages.choose_phone(i.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"((?:\+|00)?\d[\d\s/().-]{5,}\d)"), F.lit(1))).alias("value"), F.lit("text").alias("source"),
                                                     F.lit("").alias("context"), F.lit(False).alias("require_context")), ["doc_id"], F.col("value")))
_WORDS = [w for words, _ in V.INDUSTRIES.values() for w in words]
query("industry_keywords", "J17", "SELECT doc_id, array_to_string(list_filter([" + O.listed(_WORDS) + "], lambda w: contains(lower(text), w)), '|') AS words FROM documents")(
    lambda i: i.documents.select("doc_id", F.array_join(enrich.keywords_in(F.lower("text"), _WORDS), "|").alias("words")))
_POINTS = ", ".join(f"{{'p': -least(1.0::double, 0.22::double * ({' + '.join(f'''contains(t, '{w}')::int''' for w in words)})), 'i': {k}, 'n': '{name}'}}" for k, (name, (words, _)) in enumerate(V.INDUSTRIES.items()))
query("document_industry", "E18", f"""SELECT doc_id, CASE WHEN -b.p < 0.4 OR coalesce(-b.p + s.p < 0.12, false) OR b IS NULL THEN 'Unklar' ELSE b.n END AS industry, coalesce(s.n, '') AS alternative FROM (SELECT doc_id, r[1] AS b, r[2] AS s FROM (SELECT doc_id, list_sort(list_filter([{_POINTS}], lambda x: x.p < 0)) AS r FROM (SELECT doc_id, lower(text) AS t FROM documents)))""")(
    lambda i: enrich.with_industry(i.documents.select("doc_id", F.lower("text").alias("t"), F.array().cast("array<string>").alias("types")), "t", "types").select(
        "doc_id", F.col("industry.industry").alias("industry"), F.col("industry.alternative").alias("alternative")))


def _site_requests(i) -> DataFrame:
    return i.pages.select(F.col("page_id").alias("result_no"), F.concat(F.lit("Firma "), F.col("page_id").cast("string")).alias("company"), F.lit("Berlin").alias("city"),
                          F.col("url").alias("website"), F.col("page_id").alias("customer_id"))


query("analyze_sites", "E5 E6 E18-E22 X20 X23 X25")(lambda i: enrich.analyze_sites(_site_requests(i), _parsed(i), NOW).select(
    "result_no", F.col("result.website_score").alias("website_score"), F.col("result.website_score_category").alias("category"), F.col("result.has_https").alias("has_https"),
    F.col("result.industry.industry").alias("industry"), F.col("result.short_description").alias("short_description"), F.col("result.enrichment_status").alias("enrichment_status"),
    F.array_join(enrich.missing_labels("result.website_score_details"), ", ").alias("missing"), F.array_join(enrich.active_platforms("result.social_media"), ", ").alias("platforms")))
query("page_opening_hours", "E6")(lambda i: enrich.with_page_hours(_parsed(i)).select("pos", F.size("hours_text.entries").alias("entries")))
query("page_social_links", "E5 X23")(lambda i: _parsed(i).select("pos", enrich.social_profiles(F.transform("links", lambda x: x["url"])).alias("profiles")).select(
    "pos", F.size("profiles").alias("profiles")))
query("page_imprints", "E7 E9-E14 X21 X23")(lambda i: imprint.extract_imprint(_parsed(i).withColumn("company", F.lit(""))).select(
    "pos", F.col("imprint.legal_form").alias("legal_form"), F.col("imprint.imprint_extraction_confidence").alias("confidence"), imprint.has_company_data().alias("has_data"),
    imprint.formatted_address().alias("address")))
query("imprint_address_agreement", "J16", f"""SELECT id, CASE WHEN en = '' THEN 'match' WHEN en = {O.street("'Musterstr.'")} AND eh = cast(id % 20 + 1 AS varchar) THEN CASE WHEN id % 4 = 1 THEN 'conflict' ELSE 'match' END ELSE 'conflict' END AS address_state FROM (SELECT id, {O.street('street')} AS en, {O.house('street')} AS eh FROM v_companies)""", "v_companies")(
    lambda i: imprint.compare_imprint_address(i.companies.select("id", F.col("street").alias("STRASSE"), F.col("zipcode").alias("PLZ"), F.struct(
        F.lit("Musterstr.").alias("imprint_street"), (F.col("id") % 20 + 1).cast("string").alias("imprint_house_number"),
        F.when(F.col("id") % 4 == 1, "99999").otherwise("01067").alias("imprint_postal_code")).alias("imprint"))).select("id", "address_state"))
query("cache_hit", "F20", f"""SELECT r.id, coalesce(ru = su AND try_cast(nullif(analyzed_at, '') AS timestamp) >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND analysis_version = '1.1', false) AS hit FROM (SELECT id, {O.key('company_name', 'city')} AS company_key, {O.clean_url('website', 'ru')} FROM v_companies) r
  LEFT JOIN (SELECT company_key, analyzed_at, analysis_version, {O.clean_url('website', 'su')} FROM v_enrichments) e USING (company_key)""", "v_companies", "v_enrichments")(
    lambda i: enrich.cache_hit(i.companies.select("id", F.col("company_name").alias("company"), "city", "website"), i.enrichments, NOW).select("id", "hit"))
query("with_enrichment", "J2 F21", f"""SELECT r.id, cast(CASE WHEN e.company_key IS NOT NULL THEN score END AS int) AS "WEBSITE_SCORE", CASE WHEN e.company_key IS NOT NULL THEN 'Hotel' END AS "INDUSTRY" FROM (SELECT id, {O.key('company_name', 'city')} AS company_key, {O.clean_url('website', 'ru')} FROM v_companies) r
  LEFT JOIN (SELECT company_key, website_score AS score, {O.clean_url('website', 'su')} FROM v_enrichments) e ON r.company_key = e.company_key AND ru = su""", "v_companies", "v_enrichments")(
    lambda i: enrich.with_enrichment(_as_customers(i.companies), tables.decode_enrichments(i.enrichments)).select("id", "WEBSITE_SCORE", "INDUSTRY"))


def _research(i, force: bool) -> DataFrame:
    view = lambda name: load(i.spark, i.sf_dir, name)
    parsed = written(pages.parse_pages(tables.scan_pages(view("v_offer_pages"))), "parsed")
    done = research.research(view("v_requests").drop("k"), view("v_stored"), view("v_offers"), parsed, NOW, force_refresh=force)
    return done.drop("country", "zipcode", "city")


# What a check of company k must give: whether the store answers, and which site shows the requested address.
_FIRST = "(k % 5 = 3 OR k % 4 = 0)"  # the first site agrees: no street to compare, or the right address
_CHECKS = f"""SELECT *, CASE WHEN {{hit}} THEN 'store' WHEN {{first}} AND {_FIRST} THEN 'first' WHEN k % 11 <> 5 AND k % 3 = 0 THEN 'second' ELSE '' END AS via
  FROM (SELECT r.*, host, s.id, s.owner AS held, coalesce(s.status, '') AS held_status, k % 6 = 0 OR k % 6 = 1 AS stored FROM v_requests r JOIN v_site USING (k) LEFT JOIN v_stored s USING (company_name))"""
_REASON = f"""CASE via WHEN 'store' THEN '' WHEN 'first' THEN {{first}} WHEN 'second' THEN 'Adresse plausibel'
  ELSE CASE WHEN k % 11 = 5 THEN 'Kein passender Webauftritt' WHEN k % 3 = 1 OR k % 4 = 2 THEN 'Adresse auf Website nicht gefunden' ELSE 'Straße stimmt nicht überein' END END"""
_ACCEPTED = "CASE WHEN k % 5 = 3 THEN 'Bisherige Firmenbewertung' ELSE 'Adresse plausibel' END"


def _checked(hit: str, first: str, reason: str) -> str:
    return f"""SELECT company_name, street, CASE via WHEN 'second' THEN 'https://zwei-' || host || '/' WHEN '' THEN '' ELSE 'https://' || host || '/' END AS website,
  CASE via WHEN 'store' THEN '+49 30 ' || (500000 + k) WHEN 'first' THEN '+49 30 ' || (200000 + k) WHEN 'second' THEN '+49 221 ' || (600000 + k) ELSE '' END AS phone,
  CASE WHEN via = 'store' OR (via = 'first' AND k % 2 = 0) THEN 'info@' || host ELSE '' END AS email, coalesce(held, '') AS owner,
  CASE WHEN via = '' THEN 'Nicht gefunden' WHEN via = 'store' OR (via = 'first' AND k % 2 = 0) THEN 'Vollständig' ELSE 'Aktiv' END AS status,
  CASE via WHEN 'store' THEN CASE WHEN k % 4 = 3 THEN 'SQLite' ELSE 'Website' END WHEN '' THEN 'Keine Website' ELSE 'Website' END AS source,
  CASE via WHEN 'store' THEN '2024-01-02 10:00' ELSE '{NOW[:16]}' END AS last_check, id AS customer_id, {_REASON.format(first=reason)} AS match_reason,
  via <> 'store' OR k % 4 < 2 AS changed FROM ({_CHECKS.format(hit=hit, first=first)})"""


_CHECK_VIEWS = ("v_site", "v_requests", "v_offers", "v_stored")
query("research", "E23 E24 E17 W4 W5 J13 J20", _checked("stored AND (k % 6 = 1 OR k % 5 = 3)", "k % 11 <> 5", _ACCEPTED), *_CHECK_VIEWS)(lambda i: _research(i, False))
# Forced: the store never answers, but its site is tried first, and then gives no reason of its own.
query("research_forced", "E23 E24 F20 W5 J13 J20", _checked("false", "(stored OR k % 11 <> 5)", f"CASE WHEN stored THEN '' ELSE {_ACCEPTED} END"), *_CHECK_VIEWS)(lambda i: _research(i, True))
query("first_accepted_candidate", "W4 W5 J13", """SELECT company_name, city, CASE WHEN k % 5 = 3 OR k % 4 = 0 THEN 'https://' || host || '/' WHEN k % 3 = 0 THEN 'https://zwei-' || host || '/' ELSE '' END AS website,
  CASE WHEN k % 5 = 3 THEN 'Bisherige Firmenbewertung' WHEN k % 4 = 0 OR k % 3 = 0 THEN 'Adresse plausibel' WHEN k % 4 = 2 OR k % 3 = 1 THEN 'Adresse auf Website nicht gefunden' ELSE 'Straße stimmt nicht überein' END AS match_reason
  FROM v_requests JOIN v_site USING (k) WHERE k % 11 <> 5""", "v_site", "v_requests")(lambda i: _accepted(i))


def _accepted(i) -> DataFrame:
    """Candidates judged by the addresses that their own pages show."""
    view = lambda name: load(i.spark, i.sf_dir, name)
    found = pages.contact_candidates(enrich.clean_pages(pages.parse_pages(tables.scan_pages(view("v_offer_pages")))))
    contacts = pages.site_contacts(found, ["site"]).withColumnRenamed("site", "domain")
    ranked = research.rank_candidates(view("v_offers")).join(view("v_requests").select("company_name", "city", "street", "zipcode"), ["company_name", "city"])
    judged = research.first_accepted_candidate(ranked.join(contacts, "domain", "left"))
    return judged.select("company_name", "city", "website", "match_reason")


# ------------------------------------------------------------------ streams: driven to completion over the table's files


def _drained(i, name: str, transform, mode: str) -> DataFrame:
    """Run a stream over a whole table with an availableNow trigger and return its final result."""
    source = i.spark.read.parquet(f"{i.sf_dir}/{name}.parquet")
    stream = i.spark.readStream.schema(source.schema).parquet(f"{i.sf_dir}/{name}*.parquet")
    target = f"stream_{name}_{mode}_{abs(hash(i.sf_dir)) % 10_000}"
    run = transform(stream).writeStream.outputMode(mode).format("memory").queryName(target).trigger(availableNow=True).start()
    run.awaitTermination()
    return i.spark.table(target)


query("stream_latest_by_key", "T-2", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")(
    lambda i: _latest(i))


def _latest(i) -> DataFrame:
    """Events arrive in two lots; the second lot changes the keys it has and leaves the others as the first lot left them."""
    source, table, log = (fresh_path(i.spark, name) for name in ("events", "latest", "latest-log"))
    events = i.events.select(F.col("user_id").cast("string").alias("user_id"), "event_id", "event_type")
    snapshots.create(events.limit(0), table, ["user_id"])
    for part in ("event_id % 3 > 0", "event_id % 3 = 0"):
        events.filter(part).write.mode("append").parquet(source)
        stream = i.spark.readStream.schema(events.schema).parquet(source)
        streams.keep_latest(stream, ["user_id"], "event_id", table).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return snapshots.read(i.spark, table).select(F.col("user_id").cast("long").alias("user_id"), "event_id")


def _order_changes(s: DataFrame) -> DataFrame:
    yes = lambda k: F.when(F.col("o_orderkey") % k == 0, "x").otherwise("")
    status = F.when(F.col("o_orderstatus") == "F", "Vollständig").when(F.col("o_orderstatus") == "O", "Aktiv").otherwise("Nicht aktiv")
    return s.select((F.col("o_orderkey") % 7 != 0).alias("success"), status.alias("new_status"), yes(2).alias("old_website"), yes(3).alias("new_website"),
                    yes(5).alias("old_phone"), yes(2).alias("new_phone"), yes(3).alias("old_email"), yes(5).alias("new_email"))


query("stream_report_counters", "T-3 T-4", """SELECT count(*) AS processed, count(*) FILTER (o_orderkey % 7 = 0) AS failed, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderstatus = 'O') AS active,
  count(*) FILTER (o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0) AS websites_found, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0) AS phones_found FROM orders""")(
    lambda i: _drained(i, "orders", lambda s: streams.stream_report_counters(_order_changes(s)), "complete").select("processed", "failed", "complete", "active", "websites_found", "phones_found"))
query("stream_activity_counts", "T-5", f"""SELECT date_trunc('day', ts)::timestamp AS day, count(*) AS activities, count(*) FILTER (event_id % 4 = 0) AS open_follow_ups FROM events GROUP BY 1""")(
    lambda i: _drained(i, "events", lambda s: streams.stream_activity_counts(s.select(
        F.col("ts").cast("timestamp").alias("occurred_ts"), F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("follow_up_at")), NOW), "complete").select(
            F.col("day").cast("timestamp_ntz").alias("day"), "activities", "open_follow_ups"))

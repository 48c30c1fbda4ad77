"""Website operators over small sites in which every rule has something to find; expectations follow from the site's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.operators import enrich, imprint, pages, refresh
from kontor.plans.catalog import query
from kontor.plans.views import load
from kontor.session import written
from kontor.sources import tables


def _parsed(i) -> DataFrame:
    return written(pages.parse_pages(tables.scan_pages(load(i.spark, i.sf_dir, "v_sites"))), "parsed")


_NOTICE = "k % 4 <> 1"  # sites with a full legal notice
_CONTACT = "k % 5 <> 4"  # sites with a contact page
query("site_frontier", "W8 O5b", f"""SELECT page_id AS pos, url AS page_url, 0 AS rank FROM v_sites UNION ALL SELECT 4 * k, base || '/impressum', 1 FROM v_site UNION ALL SELECT 4 * k, base || '/datenschutz', 2 FROM v_site
  UNION ALL SELECT 4 * k, base || '/kontakt', 3 FROM v_site WHERE {_CONTACT}""", "v_sites")(
    lambda i: pages.frontier(enrich.clean_pages(_parsed(i))).select("pos", "page_url", "rank"))
query("site_first_pages", "W9", f"""SELECT host AS site, base || '/impressum' AS imprint_url, base || '/datenschutz' AS privacy_url, CASE WHEN {_CONTACT} THEN base || '/kontakt' END AS contact_url,
  NULL::varchar AS about_url, CASE WHEN {_CONTACT} THEN base || '/kontakt' END AS form_url FROM v_site""", "v_site")(lambda i: pages.first_of_kind(_parsed(i)))
query("site_contact_pages", "E16 O5b", """SELECT page_id AS pos, url AS page_url, 0 AS rank FROM v_sites UNION ALL SELECT 4 * k, base || '/impressum', 1 FROM v_site UNION ALL SELECT 4 * k, base || '/kontakt', 2 FROM v_site""", "v_sites")(
    lambda i: pages.contact_frontier(enrich.clean_pages(_parsed(i))).select("pos", "page_url", "rank"))
query("site_candidates", "E15 O6", f"""SELECT p.page_id AS pos, CASE p.page_id % 4 WHEN 0 THEN '030 ' || (200000 + k) || '/text' || CASE WHEN k % 3 = 1 THEN ';00 - 17/text' ELSE '' END
    WHEN 2 THEN CASE WHEN {_NOTICE} THEN '030 ' || (300000 + k) || '/imprint;030 999999/imprint;' || (100000000 + k) || '/imprint' ELSE '' END ELSE '' END AS phones,
  CASE p.page_id % 4 WHEN 1 THEN 'info@' || host WHEN 2 THEN CASE WHEN {_NOTICE} THEN 'webmaster@' || host || ';info@' || host ELSE '' END ELSE '' END AS emails,
  CASE WHEN p.page_id % 4 = 2 THEN CASE WHEN {_NOTICE} THEN 'GmbH Anschrift Musterstr. ' || (k % 40 + 1) || '/01067/Dresden Geschäftsführer' ELSE 'Hauptstr. 1/10115/Berlin' END ELSE '' END AS addresses
  FROM v_sites p JOIN v_site ON starts_with(p.url, base || '/')""", "v_sites")(
    lambda i: pages.contact_candidates(_parsed(i)).select(
        "pos", F.array_join(F.transform("phones", lambda x: F.concat_ws("/", x["value"], x["source"])), ";").alias("phones"), F.array_join("emails", ";").alias("emails"),
        F.array_join(F.transform("addresses", lambda a: F.concat_ws("/", a["street"], a["zipcode"], a["city"])), ";").alias("addresses")))


def _contacts(i) -> DataFrame:
    stored = enrich.clean_pages(_parsed(i))
    reached = pages.contact_frontier(stored).select(F.col("url").alias("start"), F.col("page_url").alias("url"), "rank")
    bundles = reached.join(pages.contact_candidates(stored).drop("site", "pos"), "url").withColumnRenamed("rank", "pos")
    found = pages.site_contacts(bundles, ["start"]).filter(F.endswith("start", F.lit("de/")))
    return found.select("start", "phone", "email", F.array_join(F.transform("addresses", lambda a: a["zipcode"]), ";").alias("zipcodes"))


query("site_contacts_found", "E17 W6 W7", f"""SELECT base || '/' AS start, '+49 30 ' || (200000 + k) AS phone, CASE WHEN {_NOTICE} OR {_CONTACT} THEN 'info@' || host ELSE '' END AS email,
  CASE WHEN {_NOTICE} THEN '01067' ELSE '10115' END AS zipcodes FROM v_site""", "v_site")(_contacts)


def _walked(i) -> DataFrame:
    return enrich.clean_pages(written(pages.parse_pages(tables.scan_pages(load(i.spark, i.sf_dir, "v_walks"))), "parsed"))


# The queue from a site's start page: the contact page comes after the legal notice, or is found only through it.
_QUEUE = """SELECT k, base, unnest(path) AS page, unnest(range(len(path))) AS rank FROM (SELECT k, base, CASE
  WHEN k % 3 = 0 AND k % 4 <> 1 THEN ['/', '/impressum', '/kontakt/start', '/impressum/en', '/kontakt/berlin']
  WHEN k % 3 = 0 THEN ['/', '/impressum', '/kontakt/start', '/kontakt/berlin', '/kontakt/hamburg']
  WHEN k % 4 <> 1 THEN ['/', '/impressum', '/kontakt/start', '/impressum/en', '/kontakt/berlin'] ELSE ['/', '/impressum'] END AS path FROM v_site)"""
query("site_contact_walk", "E16 O5b", f"SELECT 8 * k AS pos, base || page AS page_url, CAST(rank AS int) AS rank FROM ({_QUEUE})", "v_site")(
    lambda i: pages.contact_frontier(_walked(i)).filter("pos % 8 = 0").select("pos", "page_url", "rank"))


def _walk_contacts(i) -> DataFrame:
    stored = _walked(i)
    reached = pages.contact_frontier(stored).filter("pos % 8 = 0").select(F.col("url").alias("start"), F.col("page_url").alias("url"), "rank")
    bundles = reached.join(pages.contact_candidates(stored).drop("site", "pos"), "url").withColumnRenamed("rank", "pos")
    return pages.site_contacts(bundles, ["start"]).select("start", "phone", "email")


query("site_contact_walk_found", "E16 E17 W6 W7", """SELECT base || '/' AS start, CASE WHEN k % 3 = 0 OR k % 4 <> 1 THEN '+49 30 ' || (400000 + k) ELSE '' END AS phone,
  CASE WHEN k % 3 = 0 AND k % 4 = 1 THEN 'info@' || host WHEN k % 3 = 0 OR k % 4 <> 1 THEN 'x@' || host ELSE '' END AS email FROM v_site""", "v_site")(_walk_contacts)


def _entries(name: str):
    return F.array_join(F.transform(f"{name}.entries", lambda e: F.concat_ws(" ", e["day"], F.array_join(e["periods"], ","), e["closed"].cast("string"))), ";").alias(name)


query("site_hours", "E6", """SELECT page_id AS pos, CASE WHEN page_id % 12 = 0 THEN 'Montag 08:00–18:00 false;Dienstag 08:00–18:00 false' ELSE '' END AS hours_spec,
  CASE WHEN page_id % 12 = 4 THEN 'Montag 09:00–17:00 false;Mittwoch  true' ELSE '' END AS hours_text FROM v_sites""", "v_sites")(
    lambda i: enrich.with_page_hours(_parsed(i)).select("pos", _entries("hours_spec"), _entries("hours_text")))
query("site_social_links", "E5 X23", """SELECT page_id AS pos, CASE WHEN page_id % 8 = 0 THEN 'instagram=https://instagram.com/b' || translate(CAST(page_id // 4 AS varchar), '0123456789', 'abcdefghij') ELSE '' END AS profiles FROM v_sites""", "v_sites")(
    lambda i: _parsed(i).select("pos", F.array_join(F.transform(enrich.social_profiles(F.transform("links", lambda x: x["url"])), lambda x: F.concat_ws("=", x["platform"], x["url"])), ";").alias("profiles")))
_WHEN = lambda value: f"CASE WHEN {_NOTICE} THEN {value} ELSE '' END"
query("site_imprints", "E7 E4 E8-E14 X21 X23", f"""SELECT 4 * k + 2 AS pos, CASE WHEN {_NOTICE} THEN '' ELSE 'Max Muster' END AS owners, {_WHEN("'Dr. Max Müller;Erika Muster'")} AS directors, {_WHEN("'GmbH'")} AS legal_form, {_WHEN("'Beispiel ' || w || ' GmbH'")} AS company,
  {_WHEN("'Musterstr. ' || (k % 40 + 1) || ', 01067 Dresden'")} AS address, {_WHEN("'+49 30 ' || (300000 + k)")} AS phone, {_WHEN("'info@' || host")} AS email, {_WHEN("'DE' || (100000000 + k)")} AS vat_id, {_WHEN("'HRB ' || (1000 + k)")} AS register,
  {_WHEN("'Amtsgericht Dresden'")} AS court, CASE WHEN {_NOTICE} THEN 1.0 ELSE 0.65 END::double AS confidence, true AS has_data FROM v_site""", "v_site")(
    lambda i: imprint.extract_imprint(_parsed(i).filter("kind = 'imprint'").withColumn("company", F.lit(""))).select(
        "pos", F.array_join("imprint.owner_names", ";").alias("owners"), F.array_join("imprint.managing_director_names", ";").alias("directors"), F.col("imprint.legal_form").alias("legal_form"),
        F.col("imprint.imprint_company_name").alias("company"), imprint.formatted_address().alias("address"), F.col("imprint.imprint_phone").alias("phone"), F.col("imprint.imprint_email").alias("email"),
        F.col("imprint.vat_id").alias("vat_id"), F.concat_ws(" ", F.nullif("imprint.commercial_register_type", F.lit("")), F.nullif("imprint.commercial_register_number", F.lit(""))).alias("register"),
        F.col("imprint.register_court").alias("court"), F.col("imprint.imprint_extraction_confidence").alias("confidence"), imprint.has_company_data().alias("has_data")))


def _analysis(i) -> DataFrame:
    """Every site once, and two requests in three hundred that cannot be analysed."""
    site = load(i.spark, i.sf_dir, "v_site")
    website = F.when(F.col("k") % 50 == 7, F.concat("base", F.lit("/preise.pdf"))).when(F.col("k") % 50 == 11, "https://nicht-da.de").otherwise(F.col("base"))
    requests = site.select(F.col("k").alias("result_no"), F.concat(F.lit("Firma "), "w").alias("company"), F.lit("Berlin").alias("city"), website.alias("website"), F.col("k").alias("customer_id"))
    result = enrich.analyze_sites(requests, _parsed(i), "2024-01-20")
    return result.select(
        "result_no", F.col("result.enrichment_status").alias("enrichment_status"), F.col("result.website_score").alias("website_score"), F.col("result.website_score_category").alias("category"),
        F.col("result.industry.industry").alias("industry"), F.col("result.short_description").alias("short_description"), F.col("result.contact_page_url").alias("contact_page"),
        F.array_join(enrich.missing_labels("result.website_score_details"), ",").alias("missing"), F.array_join(enrich.active_platforms("result.social_media"), ",").alias("platforms"),
        enrich.display_hours("result.opening_hours").alias("hours"), F.col("result.imprint_data.imprint_city").alias("imprint_city")).filter("enrichment_status <> 'Fehler'")


_MAIL = f"({_NOTICE} OR {_CONTACT})"
_POINTS = f"100 - CASE WHEN {_CONTACT} THEN 0 ELSE 10 END - CASE WHEN {_MAIL} THEN 0 ELSE 10 END - CASE WHEN k % 3 = 2 THEN 10 ELSE 0 END - CASE WHEN k % 2 = 1 THEN 5 ELSE 0 END - CASE WHEN k % 3 = 0 THEN 0 ELSE 5 END"
query("site_analysis", "E18-E22 E5 E6 X20 X21 X23", f"""SELECT k AS result_no, 'Erfolgreich' AS enrichment_status, ({_POINTS})::int AS website_score, CASE WHEN {_POINTS} >= 80 THEN 'Sehr gut' ELSE 'Gut' END AS category, 'Bäckerei' AS industry,
  'Unsere Bäckerei bietet täglich frische Backwaren in Berlin an.' AS short_description, CASE WHEN {_CONTACT} THEN base || '/kontakt' ELSE '' END AS contact_page,
  array_to_string(list_filter([CASE WHEN NOT {_CONTACT} THEN 'Kontaktseite' END, CASE WHEN NOT {_MAIL} THEN 'Gültige E-Mail' END, CASE WHEN k % 3 = 2 THEN 'Öffnungszeiten' END, CASE WHEN k % 2 = 1 THEN 'Social Media' END, CASE WHEN k % 3 <> 0 THEN 'Strukturierte Daten' END], lambda x: x IS NOT NULL), ',') AS missing,
  CASE WHEN k % 2 = 0 THEN 'instagram' ELSE '' END AS platforms, CASE k % 3 WHEN 0 THEN 'Montag: 08:00–18:00' || chr(10) || 'Dienstag: 08:00–18:00' WHEN 1 THEN 'Montag: 09:00–17:00' || chr(10) || 'Mittwoch: geschlossen' ELSE '' END AS hours,
  {_WHEN("'Dresden'")} AS imprint_city FROM v_site WHERE k % 50 NOT IN (7, 11)""", "v_site")(_analysis)


def _failures(i) -> DataFrame:
    requests = load(i.spark, i.sf_dir, "v_site").select(
        F.col("k").alias("result_no"), F.concat(F.lit("Firma "), "w").alias("company"), F.lit("Berlin").alias("city"),
        F.when(F.col("k") % 2 == 0, F.concat("base", F.lit("/preise.pdf"))).otherwise("https://nicht-da.de/").alias("website"), F.col("k").alias("customer_id"))
    return enrich.analyze_sites(requests, _parsed(i), "2024-01-20").select(
        "result_no", F.col("result.enrichment_status").alias("enrichment_status"), (F.col("result.enrichment_error") != "").alias("has_reason"),
        F.contains("result.enrichment_error", F.lit("Dokument")).alias("is_document"))


query("site_failures", "E22 X25", "SELECT k AS result_no, 'Fehler' AS enrichment_status, true AS has_reason, k % 2 = 0 AS is_document FROM v_site", "v_site")(_failures)


# ------------------------------------------------------------------ repeated analysis
def _requested(i) -> DataFrame:
    site = load(i.spark, i.sf_dir, "v_site")
    website = F.when(F.col("k") % 50 == 7, F.concat("base", F.lit("/preise.pdf"))).when(F.col("k") % 50 == 11, "https://nicht-da.de").otherwise(F.col("base"))
    return site.select(F.col("k").alias("result_no"), F.concat(F.lit("Firma "), "w").alias("company"), F.lit("Berlin").alias("city"), website.alias("website"), F.col("k").alias("customer_id"))


def _second_run(i, changed, **options) -> DataFrame:
    """The analysis of all sites, then again ten days later, over the pages as ``changed`` left them."""
    stored = tables.scan_pages(load(i.spark, i.sf_dir, "v_sites"))
    first = written(refresh.refresh_analysis(_requested(i), stored, None, "2024-01-20"), "analysis")
    again = refresh.refresh_analysis(_requested(i), changed(stored), refresh.stored_results(first), "2024-01-30", **options)
    return again.select("result_no", F.coalesce("result.from_cache", F.lit(False)).alias("from_cache"), F.col("result.enrichment_status").alias("enrichment_status"),
                        F.col("result.website_score").alias("website_score"), F.col("result.analyzed_at").alias("analyzed_at"), F.col("result.website_title").alias("website_title"))


def _expected(cached: str) -> str:
    fine = "k % 50 NOT IN (7, 11)"
    return f"""SELECT k AS result_no, {cached} AS from_cache, CASE WHEN {fine} THEN 'Erfolgreich' ELSE 'Fehler' END AS enrichment_status, CASE WHEN {fine} THEN {_POINTS} END::int AS website_score,
  CASE WHEN {cached} THEN '2024-01-20' ELSE '2024-01-30' END AS analyzed_at, CASE WHEN {fine} THEN 'Bäckerei ' || w || CASE WHEN {cached} THEN '' ELSE {{new}} END END AS website_title FROM v_site"""


_RETITLED = lambda p: p.withColumn("html", F.when((F.col("pos") % 40 == 12), F.replace("html", F.lit("</title>"), F.lit(" neu</title>"))).otherwise(F.col("html")))
query("analysis_second_run", "E22 F20", _expected("(k % 50 <> 7)").replace("{new}", "''"), "v_site")(lambda i: _second_run(i, lambda p: p))
query("analysis_forced", "E22 F20", _expected("false").replace("{new}", "''"), "v_site")(lambda i: _second_run(i, lambda p: p, force_refresh=True))
query("analysis_changed_sites", "E22 F20", _expected("(k % 50 <> 7 AND (k % 10 <> 3 OR k % 50 = 11))").replace("{new}", "' neu'"), "v_site")(lambda i: _second_run(i, _RETITLED))
# A page that no start page links to, or one that is gone (the privacy page, ten points), changes a site; the order of its pages does not.
query("analysis_pages_come_and_go", "E22 F20", _expected("(k % 50 <> 7 AND (k % 50 = 11 OR (k % 6 <> 1 AND k % 6 <> 2)))").replace("{new}", "''").replace(_POINTS, f"{_POINTS} - CASE WHEN k % 6 = 1 THEN 10 ELSE 0 END"), "v_site")(
    lambda i: _second_run(i, lambda p: p.filter("NOT (pos % 24 = 7)").unionByName(p.filter("pos % 24 = 8").withColumns({"url": F.concat("url", F.lit("karriere")), "html": F.lit("<p>Stellen</p>")})).orderBy(F.desc("pos"))))
